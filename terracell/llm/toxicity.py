"""Toxicity by noisy-channel deobfuscation.

A character model of order four is counted over all documents and all letters
that occur. Every token that could hide a word (digits or symbols among letters,
a letter twice or more in a row, letters of another script that look alike, single
letters set apart) becomes a lattice of restorations: leetspeak and look-alikes may
be read as letters of a script that stands beside them, repeats and separators may
be dropped, gaps may be word breaks. Viterbi search, exact and without a beam, finds
the likeliest restoration under the character model. A token of plain letters, none
repeated, has a lattice of one path and needs no search. The restored text's words
and word beginnings are then scored by a logistic model.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field
from functools import cache
from os.path import commonprefix

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from terracell.llm.base import held_out, labelled_sample, map_rows, texts
from terracell.plans.durable import discard, durable

#: Characters of the longest n-gram, and cells that n-grams are counted in by hash: the bound of what is broadcast (4 bytes a cell).
ORDER, CELL_BITS, PART_BITS = 4, 22, 14
BOUND = " "
#: What a character may stand for among Latin letters (fixed values, by custom of leetspeak and by look).
READS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "&": "a", "€": "e", "£": "l", "¡": "i",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "к": "k", "м": "m", "т": "t", "н": "h", "в": "b",
    "α": "a", "ε": "e", "ο": "o", "ι": "i", "ρ": "p", "τ": "t", "υ": "u", "ν": "v", "κ": "k",
}
#: The same among Cyrillic and among Greek letters (fixed values).
SCRIPTS = (
    (0x400, 0x530, {"0": "о", "3": "з", "4": "ч", "6": "б", "@": "а", "$": "с", "a": "а", "e": "е", "o": "о", "p": "р", "c": "с", "y": "у", "x": "х", "k": "к", "m": "м", "t": "т", "h": "н", "b": "в"}),
    (0x370, 0x400, {"0": "ο", "3": "ε", "4": "α", "1": "ι", "7": "τ", "@": "α", "a": "α", "e": "ε", "o": "ο", "i": "ι", "p": "ρ", "t": "τ", "u": "υ", "v": "ν", "k": "κ"}),
)
LEET_COST, DROP_SYMBOL, DROP_DIGIT, DROP_REPEAT, DROP_DOUBLE, BREAK_COST, WIDE_BREAK_COST = 1.0, 3.0, 7.0, 0.3, 4.0, 3.0, 0.5
#: Labelled rows to learn from at most; documents of either sort that a feature must stand in; how far from chance (G) it must be.
MAX_ROWS, MIN_DOCUMENTS, LEAST_G = 12_000, 5, 25.0
CACHE = 300_000
#: Characters whose n-grams a task counts at once: bounds its memory where batches and texts are long.
WINDOW = 1 << 18
#: Characters after which what all states agree on is set down, so that states stay short.
SETTLE = 256

_EDGES = re.compile(r"^[^\w@$!|+(&€£¡]+|[^\w@$!|+&€£]+$")
_DECORATION = re.compile(r"^([^\w])\1\1+|([^\w])\2\2+$|[!&+|(]+$")
_RUN = re.compile(r"(.)\1")
_APART = re.compile(r"[\s._*\-][^\W_][\s._*\-]{1,3}[^\W_][\s._*\-]")
_SPACED = re.compile(r"(?<![^\s._*\-])(?:[^\s._*\-][\s._*\-]{1,3}){2,}[^\s._*\-](?![^\s._*\-])")
_GAP = re.compile(r"[\s._*\-]+")
_JOINT = re.compile(r"[^\w@$!|+(&€£¡.*\-]+")
#: Characters at a token's edges that are never part of a word, the commonest of them.
_PUNCTUATION = ".,;:?"
_INVISIBLE = dict.fromkeys([0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF])
_HIDDEN = re.compile("[" + "".join(map(chr, _INVISIBLE)) + "]")
_STEP, _MIX, _WORD = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, (1 << 64) - 1


@cache
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(n).isalpha() for n in range(0x110000)), bool, 0x110000)


def _cell(gram: str) -> int:
    h = 0
    for c in gram:
        h = (h * _STEP + ord(c)) & _WORD
    return ((h ^ h >> 32) * _MIX & _WORD) >> 64 - CELL_BITS


def _cells(symbols: np.ndarray, starts: int | None = None):
    """For each order from 1 to ORDER the cells of all n-grams that don't run over a word's bound, of those that start at the first ``starts`` places."""
    h, inside = symbols, np.ones(len(symbols), bool)
    for order in range(1, min(ORDER, len(symbols)) + 1):
        if order > 1:
            h = h[:-1] * np.uint64(_STEP) + symbols[order - 1 :]
            inside = inside[:-1] & (symbols[order - 2 : -1] != ord(BOUND)) if order > 2 else inside[:-1]
        own = h[:starts][inside[:starts]]
        yield ((own ^ (own >> np.uint64(32))) * np.uint64(_MIX) >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def count_characters(docs: DataFrame) -> np.ndarray:
    """Counts of n-grams of 1 to ORDER letters over all documents, by cell.

    Each task sums its own cells; Spark sums those that occur. What is gathered grows with the n-grams that the corpus has, up to 2 ** CELL_BITS cells.
    """

    def run(batches):
        _LAST[:] = _SCORED[:] = [None, None]  # a new model is in the making
        total = np.zeros(1 << CELL_BITS, np.int64)
        for b in batches:
            text = "\n".join(t.decode("utf-8", "replace") for t in texts(b.column(0))).lower()
            points = np.frombuffer(f"\n{text}\n".encode("utf-32-le", "replace"), "<u4")
            del text
            word = _letters()[points]
            kept = np.concatenate([[True], word[1:] | word[:-1]])
            symbols = np.where(word, points, np.uint32(ord(BOUND)))[kept]
            del points, word, kept
            for at in range(0, len(symbols), WINDOW):
                for cells in _cells(symbols[at : at + WINDOW + ORDER - 1].astype(np.uint64), WINDOW):
                    np.add.at(total, cells, 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["cell", "n"])

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros(1 << PART_BITS, np.float32)
        out[rows.cell.to_numpy() & (1 << PART_BITS) - 1] = rows.n
        return pd.DataFrame({"part": [int(rows.cell.iloc[0]) >> PART_BITS], "counts": [out.tobytes()]})

    summed = map_rows(docs.select("text"), run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    counts = np.zeros(1 << CELL_BITS, np.float32)
    for r in summed.groupBy(F.shiftright("cell", PART_BITS)).applyInPandas(pack, "part int, counts binary").collect():
        counts[r.part << PART_BITS : (r.part + 1) << PART_BITS] = np.frombuffer(r.counts, np.float32)
    return counts


class CharacterModel:
    """-ln P(last character | those before it) of an n-gram, each order backed by the next lower one in proportion to how little it was seen."""

    def __init__(self, counts: np.ndarray):
        self.counts, self.known = counts, {}
        single = np.append(np.flatnonzero(_letters()), ord(BOUND)).astype(np.uint64)
        self.total = float(counts[np.unique(next(_cells(single)))].sum(dtype=np.float64))

    def share(self, gram: str) -> float:
        if len(gram) == 1:
            return (float(self.counts[_cell(gram)]) + 1) / (self.total + 1000)
        return (float(self.counts[_cell(gram)]) + 10 * self.share(gram[1:])) / (float(self.counts[_cell(gram[:-1])]) + 10)

    def cost(self, gram: str) -> float:
        out = self.known.get(gram)
        if out is None:
            if len(self.known) >= CACHE:
                self.known.clear()
            out = self.known[gram] = -math.log(self.share(gram))
        return out

    def __reduce__(self):
        return _model_of, (self.counts, self.total)


def _model_of(counts: np.ndarray, total: float) -> CharacterModel:
    model = CharacterModel.__new__(CharacterModel)
    model.counts, model.known, model.total = counts, {}, total
    return model


def lattice(span: str) -> list[list[tuple[str, float]]]:
    """For each place of a lower-cased span, what may be written there and at which cost; a gap is one place."""
    scripts = [READS, *(reads for lo, hi, reads in SCRIPTS if any(lo <= ord(c) < hi for c in span))]
    gaps = {m.start(): m.group() for m in _GAP.finditer(span)}
    out, run, before, at = [], 0, "", 0
    while at < len(span):
        if at in gaps:
            wide = len(gaps[at]) > 1
            out.append([("", 1.0 if wide else 0.0), (BOUND, WIDE_BREAK_COST if wide else BREAK_COST)])
            run, before, at = 0, "", at + len(gaps[at])
            continue
        c, arcs = span[at], []
        run, before = run + 1 if c == before else 1, c
        letter = c.isalpha()
        if letter:
            arcs.append((c, 0.0))
            if run > 1:
                arcs.append(("", DROP_REPEAT if run > 2 or span[at + 1 : at + 2] == c else DROP_DOUBLE))
        arcs += [(r, LEET_COST) for reads in scripts for r in reads.get(c, "")]
        if not letter:
            arcs.append(("", DROP_REPEAT if run > 1 else DROP_DIGIT if c.isdigit() else DROP_SYMBOL))
        out.append(arcs)
        at += 1
    return out


def search(places: list[list[tuple[str, float]]], model: CharacterModel) -> tuple[float, str]:
    """The path of least cost through a lattice, by exact Viterbi search: (cost, words with single spaces).

    A state is the last ORDER - 1 characters of the word at hand, its beginning included: all that the model looks at.
    """
    keep, cost_of, known = ORDER - 1, model.cost, model.known
    states: dict[str, tuple[float, str]] = {BOUND: (0.0, "")}
    settled = ""
    for at, arcs in enumerate(places):
        new: dict[str, tuple[float, str]] = {}
        for state, (cost, text) in states.items():
            for out, price in arcs:
                if out == "":
                    to, total, said = state, cost + price, text
                elif out == BOUND:
                    if state == BOUND:  # a break beside a break says nothing
                        to, total, said = state, cost + price, text
                    else:
                        to, total, said = BOUND, cost + price + cost_of(state + BOUND), text + BOUND
                else:
                    gram = state + out
                    own = known.get(gram)
                    to, total, said = gram[-keep:], cost + price + (cost_of(gram) if own is None else own), text + out
                old = new.get(to)
                if old is None or total < old[0] or (total == old[0] and said < old[1]):
                    new[to] = (total, said)
        states = new
        if at % SETTLE == SETTLE - 1:
            agreed = len(commonprefix([text for _, text in states.values()]))
            settled += next(iter(states.values()))[1][:agreed]
            states = {k: (cost, text[agreed:]) for k, (cost, text) in states.items()}
    cost, text = min((cost + (0.0 if state == BOUND else cost_of(state + BOUND)), text) for state, (cost, text) in states.items())
    return cost, (settled + text).strip()


def decode(span: str, model: CharacterModel) -> str:
    """The likeliest restoration of a lower-cased span: words with single spaces."""
    return search(lattice(span), model)[1]


class Restorer:
    """Words of restored texts. Decoding is remembered by token, up to CACHE of them."""

    def __init__(self, model: CharacterModel):
        self.model, self.known = model, {}

    def token(self, raw: str) -> tuple[str, ...]:
        """Restored words of one token; its letters as they stand come too where they differ."""
        core = raw.strip(_PUNCTUATION)
        if not (core.isalpha() and core.isascii()):
            core = _EDGES.sub("", _DECORATION.sub("", raw))
        if core.isalpha() and core.isascii() and not _RUN.search(core):
            return (core,)
        parts = [p for p in re.split(r"[\W\d_]+", core) if p]
        if not parts:
            return ()
        plain = len(parts) == 1 and parts[0] == core
        if plain and not _RUN.search(core) and not any(c in READS for c in core):
            return (core,)
        whole = core if plain else _GAP.sub("", core)
        # Words may be joined by any symbols (addresses, lists): pieces are restored as well as the whole.
        joined = _JOINT.split(core)
        pieces = dict.fromkeys([whole, *(_GAP.sub("", p) for p in joined), *(p for j in joined for p in _GAP.split(j))])
        found = [w for p in pieces for w in ((p,) if p.isalpha() and p.isascii() and not _RUN.search(p) else decode(p, self.model).split())]
        return tuple(dict.fromkeys([*found, *parts]))

    def lowered(self, text: str) -> str:
        return (text.translate(_INVISIBLE) if _HIDDEN.search(text) else text).lower()

    def spaced(self, text: str) -> set[str]:
        """Restored words of a lower-cased text that are written letter by letter."""
        if not _APART.search(f" {text} "):
            return set()
        return {w for m in _SPACED.finditer(text) for w in decode(m.group(), self.model).split()}

    def words(self, text: str) -> set[str]:
        text = self.lowered(text)
        found = self.spaced(text)
        known = self.known
        for raw in set(text.split()):
            got = known.get(raw)
            if got is None:
                if len(known) >= CACHE:
                    known.clear()
                got = known[raw] = self.token(raw)
            found.update(got)
        return found


#: The restorer of the model that this worker saw last: tokens stay known from task to task.
_LAST: list = [None, None]


def _restorer(model: CharacterModel) -> Restorer:
    if _LAST[0] is not model:
        _LAST[:] = [model, Restorer(model)]
    return _LAST[1]


#: The same for the features of tokens under the scorer that this worker saw last.
_SCORED: list = [None, None]


def _memo(scorer: Scorer) -> dict:
    if _SCORED[0] is not scorer:
        _SCORED[:] = [scorer, {}]
    return _SCORED[1]


#: Lengths of word beginnings that are features beside the word itself.
BEGINNINGS = (4, 5, 6)


def _features(word: str) -> tuple[str, ...]:
    return (f"={word}", *(word[:n] for n in BEGINNINGS if len(word) > n))


@dataclass
class Scorer:
    """A logistic model over presence of restored words and word beginnings."""

    language: CharacterModel
    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -20.0

    def active(self, words) -> tuple[str, ...]:
        return tuple({f for w in words for f in _features(w) if f in self.weights})

    def of(self, documents: list[bytes], restorer: Restorer, memo: dict) -> list[float]:
        """Scores of whole texts; ``memo`` keeps the features of up to CACHE tokens."""
        out = []
        for t in documents:
            text = restorer.lowered(t.decode("utf-8", "replace"))
            active = set(self.active(restorer.spaced(text)))
            for raw in set(text.split()):
                hit = memo.get(raw)
                if hit is None:
                    if len(memo) >= CACHE:
                        memo.clear()
                    hit = memo[raw] = self.active(restorer.token(raw))
                if hit:
                    active.update(hit)
            z = self.bias + sum(self.weights[f] for f in sorted(active))
            out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
        return out


def _fit(rows: list[list[int]], y: np.ndarray, n: int, l2: float = 1.0, steps: int = 12) -> tuple[np.ndarray, float]:
    """Logistic regression with an L2 penalty, by Newton steps whose equations are solved by conjugate gradients.

    Only the features that are present are held: memory goes with them, not with rows times features.
    """
    at = np.repeat(np.arange(len(rows)), [len(r) + 1 for r in rows])
    of = np.array([f for r in rows for f in (*r, n)], np.int64)
    times = lambda v: np.bincount(at, v[of], len(rows))
    back = lambda v: np.bincount(of, v[at], n + 1)
    w, penalty = np.zeros(n + 1), np.append(np.full(n, l2), 1e-3)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(times(w), -30, 30)))
        curve = p * (1 - p)
        curved = lambda v, c=curve: back(c * times(v)) + penalty * v
        step, r = np.zeros(n + 1), back(y - p) - penalty * w
        goal, d = 1e-20 * (r @ r), r.copy()
        for _ in range(4 * (n + 1)):
            size = r @ r
            if size <= goal:
                break
            image = curved(d)
            a = size / (d @ image)
            step, r = step + a * d, r - a * image
            d = r + (r @ r) / size * d
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w[:n], float(w[n])


def train(docs: DataFrame, labels: DataFrame, modulus: int = 5, remainder: int = 0, max_rows: int = MAX_ROWS) -> Scorer:
    """Count the character model over all of ``docs``; fit the scorer on up to ``max_rows`` labelled rows that aren't held out."""
    language = CharacterModel(count_characters(docs))
    sample = labelled_sample(docs, labels, "toxic", max_rows, ~held_out("doc_id", modulus, remainder))
    shared = docs.sparkSession.sparkContext.broadcast(language)

    def restored(batches):
        restorer = _restorer(shared.value)
        for b in batches:
            found = [sorted(restorer.words(t.decode("utf-8", "replace"))) for t in texts(b.column(0))]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(found, pa.list_(pa.string()))], names=["y", "words"])

    seen = durable(map_rows(sample, restored, "y int, words array<string>"))
    totals = {r.y > 0: r["count"] for r in seen.groupBy("y").count().collect()}
    if not totals.get(True):
        discard(sample, seen)
        return Scorer(language)
    features = F.array_distinct(F.flatten(F.transform("words", lambda w: F.filter(F.array(F.concat(F.lit("="), w), *(F.when(F.length(w) > n, F.substr(w, F.lit(1), F.lit(n))) for n in BEGINNINGS)), lambda f: f.isNotNull()))))
    counted = seen.select("y", F.explode(features).alias("f")).groupBy("f").agg(F.sum((F.col("y") > 0).cast("int")).alias("toxic"), F.sum((F.col("y") <= 0).cast("int")).alias("clean"))
    p, q = (F.col("toxic") + 0.5) / (totals[True] + 1), (F.col("clean") + 0.5) / (totals.get(False, 0) + 1)
    telling = counted.where((F.col("toxic") >= MIN_DOCUMENTS) & (p > 2 * q) & (2 * F.col("toxic") * F.log(p / q) >= LEAST_G))
    chosen = {f: k for k, f in enumerate(sorted(r.f for r in telling.select("f").collect()))}

    def rows(batches):
        for b in batches:
            found = [sorted({chosen[f] for w in words for f in _features(w) if f in chosen}) for words in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32())), b.column(0)], names=["x", "y"])

    active = sorted((r.x, int(r.y > 0)) for r in map_rows(seen, rows, "x array<int>, y int").collect())
    discard(sample, seen)
    weights, bias = _fit([x for x, _ in active], np.array([y for _, y in active], float), len(chosen))
    return Scorer(language, {f: float(weights[k]) for f, k in chosen.items()}, bias)


def score(docs: DataFrame, scorer: Scorer, column: str = "score") -> DataFrame:
    """``docs`` with a toxicity score from 0 to 1 of every whole text; null texts count as empty.

    A column of that name already there is replaced.
    """
    docs = docs.select(*[c for c in docs.columns if c != column])
    shared = docs.sparkSession.sparkContext.broadcast(scorer)
    at = docs.columns.index("text")

    def run(batches):
        model = shared.value
        restorer, memo = _restorer(model.language), _memo(model)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(model.of(texts(b.column(at)), restorer, memo), pa.float64())], names=[*b.schema.names, column])

    schema = StructType([*docs.schema.fields]).add(column, DoubleType())
    return map_rows(docs, run, schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row for each row of ``docs``.

    Null and empty texts are scored as empty ones. A null id is held out. Without
    toxic labels to learn from every score is near 0. Repeated rows score alike.
    Texts are read whole; tokens and spaced-out spans are decoded whole, however
    long. Other columns are ignored.
    """
    found = score(docs.select("doc_id", "text"), train(docs, labels))
    return found.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
