"""Quality by a generalised additive model with pairwise interactions.

Shallow trees are boosted in turn, one feature after the other, each a few cuts
of the feature's bins; their sum is one lookup table a feature. Then the pairs
whose coarse bins explain most of what is left are boosted the same way. A text
is scored by one addition a table (see Lou et al., "Accurate Intelligible Models
with Pairwise Interactions", 2013).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from terracell.llm.base import held_out, labelled_sample, map_rows, texts
from terracell.llm.statistics import BASE, RATIOS, measure

MAX_ROWS, BINS, COARSE, PAIRS, ROUNDS, RATE, LEAVES = 20_000, 64, 8, 6, 150, 0.15, 3
FEATURES = (*BASE, *RATIOS)


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + 1.0)


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Leaf values by bin of a tree of up to LEAVES leaves over ordered bins."""
    spans, out = [(0, len(g))], np.zeros(len(g))
    while len(spans) < LEAVES:
        best = (1e-6, None)
        for k, (lo, hi) in enumerate(spans):
            if hi - lo > 1:
                cg, ch = np.cumsum(g[lo:hi]), np.cumsum(h[lo:hi])
                won = _gain(cg[:-1], ch[:-1]) + _gain(cg[-1] - cg[:-1], ch[-1] - ch[:-1]) - _gain(cg[-1], ch[-1])
                won = np.where((ch[:-1] >= 1) & (ch[-1] - ch[:-1] >= 1), won, 0)
                at = int(won.argmax())
                best = max(best, (float(won[at]), (k, lo + at + 1)), key=lambda x: x[0])
        if best[1] is None:
            break
        k, cut = best[1]
        spans[k : k + 1] = [(spans[k][0], cut), (cut, spans[k][1])]
    for lo, hi in spans:
        out[lo:hi] = g[lo:hi].sum() / (h[lo:hi].sum() + 1.0)
    return out


def _grid_tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A tree over two features' coarse bins: one cut of the first, then one of the second in either part."""
    best, out = -1.0, np.zeros_like(g)
    for flip in (False, True):
        a, b = (g.T, h.T) if flip else (g, h)
        for cut in range(1, len(a)):
            leaf, won = np.zeros_like(a), 0.0
            for part in (slice(0, cut), slice(cut, None)):
                pg, ph = a[part].sum(0), b[part].sum(0)
                cg, ch = np.cumsum(pg), np.cumsum(ph)
                each = _gain(cg[:-1], ch[:-1]) + _gain(cg[-1] - cg[:-1], ch[-1] - ch[:-1])
                at = int(each.argmax())
                won += float(each[at])
                leaf[part, : at + 1] = cg[at] / (ch[at] + 1.0)
                leaf[part, at + 1 :] = (cg[-1] - cg[at]) / (ch[-1] - ch[at] + 1.0)
            if won > best:
                best, out = won, leaf.T if flip else leaf
    return out


@dataclass
class AdditiveModel:
    """bias + a table for each feature's bins + a table for each pair's coarse bins."""

    edges: list[np.ndarray]
    coarse: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        for f, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            z += table[np.searchsorted(edges, x[:, f], side="right")]
        for a, b, table in self.pairs:
            z += table[np.searchsorted(self.coarse[a], x[:, a], side="right"), np.searchsorted(self.coarse[b], x[:, b], side="right")]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _cuts(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0)


def fit(x: np.ndarray, y: np.ndarray) -> AdditiveModel:
    """Boost the tables; with one class only, its smoothed share is every score."""
    n, width = x.shape
    edges, coarse = [_cuts(x[:, f], BINS) for f in range(width)], [_cuts(x[:, f], COARSE) for f in range(width)]
    share = (y.sum() + 0.5) / (n + 1)
    model = AdditiveModel(edges, coarse, [np.zeros(len(e) + 1) for e in edges], [], float(np.log(share / (1 - share))))
    if n == 0 or y.min() == y.max():
        return model
    at = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(edges)]
    z = np.full(n, model.bias)

    def slope():
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for f in range(width):
            g, h = slope()
            step = RATE * _tree(np.bincount(at[f], g, len(edges[f]) + 1), np.bincount(at[f], h, len(edges[f]) + 1))
            model.tables[f] += step
            z += step[at[f]]
    low = [np.searchsorted(c, x[:, f], side="right") for f, c in enumerate(coarse)]

    def grid(a, b):
        g, h = slope()
        shape = (len(coarse[a]) + 1, len(coarse[b]) + 1)
        cell = low[a] * shape[1] + low[b]
        return cell, (np.bincount(cell, v, shape[0] * shape[1]).reshape(shape) for v in (g, h))

    ranked = []
    for a in range(width):
        for b in range(a + 1, width):
            if len(coarse[a]) and len(coarse[b]):
                ranked.append((-float(_gain(*grid(a, b)[1]).sum()), a, b))
    for _, a, b in sorted(ranked)[:PAIRS]:
        model.pairs.append((a, b, np.zeros((len(coarse[a]) + 1, len(coarse[b]) + 1))))
    for _ in range(ROUNDS // 3):
        for a, b, table in model.pairs:
            cell, (g, h) = grid(a, b)
            step = RATE * _grid_tree(g, h)
            table += step
            z += step.ravel()[cell]
    return model


def _measured(rows: list[bytes]) -> np.ndarray:
    return np.array([measure(t) for t in rows], float).reshape(len(rows), len(FEATURES))


def train(docs: DataFrame, labels: DataFrame, modulus: int = 3, remainder: int = 1, max_rows: int = MAX_ROWS) -> AdditiveModel:
    """Fit on up to ``max_rows`` labelled rows that aren't held out; their statistics, not their texts, reach the driver."""
    sample = labelled_sample(docs, labels, "quality", max_rows, ~held_out("doc_id", modulus, remainder))

    def run(batches):
        for b in batches:
            x = _measured(texts(b.column(0)))
            yield pa.RecordBatch.from_arrays([pa.array([*x], pa.list_(pa.float64())), b.column(1)], names=["x", "y"])

    rows = map_rows(sample, run, "x array<double>, y int").collect()
    x = np.array([r.x for r in rows], float).reshape(len(rows), len(FEATURES))
    y = np.array([r.y > 0 for r in rows], float)
    order = np.lexsort((*x.T, y))
    return fit(x[order], y[order])


def score(docs: DataFrame, model: AdditiveModel, column: str = "score") -> DataFrame:
    """``docs`` with a quality score from 0 to 1 of every whole text; null texts count as empty.

    A column of that name already there is replaced.
    """
    docs = docs.select(*[c for c in docs.columns if c != column])
    at = docs.columns.index("text")

    def run(batches):
        for b in batches:
            found = model.score(_measured(texts(b.column(at))))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.float64())], names=[*b.schema.names, column])

    return map_rows(docs, run, StructType([*docs.schema.fields]).add(column, DoubleType()))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row for each row of ``docs``.

    Null and empty texts are scored as empty ones. A null id is held out. Without
    labels every score is one half. Repeated rows score alike. Texts are measured
    whole. Other columns are ignored.
    """
    found = score(docs.select("doc_id", "text"), train(docs, labels))
    return found.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
