"""Quality rules as a learned decision list.

Sequential covering learns rules for low quality from labelled statistics: each
rule grows by the threshold test of most FOIL gain on two thirds of the rows, is
pruned on the rest, and removes the rows that it covers before the next one is
learned (see Cohen, "Fast Effective Rule Induction", 1995). The list is applied
as one ordered Spark conditional expression.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructType

from terracell.llm.base import labelled_sample, map_rows, texts
from terracell.llm.statistics import BASE, RATIOS, measure

#: Bounds of what is learned from, of a rule, and of the list; a rule must be right this often on rows it wasn't grown on.
MAX_ROWS, MAX_TESTS, MAX_RULES, THRESHOLDS, LEAST_PRECISION, LEAST_COVER = 20_000, 4, 12, 48, 0.9, 5
#: Rules test ratios, which mean the same in a short text and a long one, and the number of words.
TESTED = ("n_words", *RATIOS)

Test = tuple[str, str, float]
Rule = list[Test]


def _holds(x: np.ndarray, rule: Rule) -> np.ndarray:
    on = np.ones(len(x), bool)
    for name, sign, value in rule:
        v = x[:, TESTED.index(name)]
        on &= v <= value if sign == "<=" else v > value
    return on


def _grow(x: np.ndarray, bad: np.ndarray) -> Rule:
    rule: Rule = []
    on = np.ones(len(x), bool)
    while len(rule) < MAX_TESTS:
        p, n = bad[on].sum(), (~bad)[on].sum()
        if not p or not n:
            break
        best, now = (1e-9, None), math.log2(p / (p + n))
        for f, name in enumerate(TESTED):
            v, b = x[on, f], bad[on]
            for value in np.unique(np.quantile(v, np.linspace(0, 1, THRESHOLDS + 1)[1:-1], method="nearest")):
                for sign, hit in (("<=", v <= value), (">", v > value)):
                    hp, hn = int(b[hit].sum()), int((~b)[hit].sum())
                    if hp >= LEAST_COVER:
                        gain = hp * (math.log2(hp / (hp + hn)) - now)
                        if gain > best[0]:
                            best = (gain, (name, sign, float(value)))
        if best[1] is None:
            break
        rule.append(best[1])
        on = _holds(x, rule)
    return rule


def _prune(rule: Rule, x: np.ndarray, bad: np.ndarray) -> tuple[Rule, float, int]:
    """The rule's beginning that is best on other rows, with its smoothed precision and cover there."""
    best: tuple[float, Rule, float, int] = (-2.0, [], 0.0, 0)
    for n in range(len(rule), 0, -1):
        on = _holds(x, rule[:n])
        p, q = int(bad[on].sum()), int((~bad)[on].sum())
        worth = (p - q) / (p + q) if p + q else -1.0
        if worth > best[0]:
            best = (worth, rule[:n], (p + 0.5) / (p + q + 1), p + q)
    return best[1:]


def learn(x: np.ndarray, bad: np.ndarray) -> list[Rule]:
    """Rules in order; a text is of low quality if one holds. Rows: TESTED statistics and whether they are labelled low."""
    rules: list[Rule] = []
    part = np.arange(len(x)) % 3
    left = np.ones(len(x), bool)
    while len(rules) < MAX_RULES and bad[left & (part < 2)].sum() >= LEAST_COVER:
        grow, prune = left & (part < 2), left & (part == 2)
        rule, right, cover = _prune(_grow(x[grow], bad[grow]), x[prune], bad[prune])
        if not rule or right < LEAST_PRECISION or cover < LEAST_COVER:
            break
        rules.append(rule)
        left &= ~_holds(x, rule)
    return rules


def expression(rules: list[Rule]) -> Column:
    """The list as an ordered conditional: false at the first rule that holds, else true."""
    out = None
    for rule in rules:
        on = F.lit(True)
        for name, sign, value in rule:
            on = on & (F.col(name) <= value if sign == "<=" else F.col(name) > value)
        out = F.when(on, False) if out is None else out.when(on, False)
    return F.lit(True) if out is None else out.otherwise(True)


def statistics(docs: DataFrame) -> DataFrame:
    """``docs`` without its text, with the statistics of each whole text; null texts count as empty.

    Columns that a statistic's name clashes with are replaced.
    """
    names = (*BASE, *RATIOS)
    kept = [c for c in docs.columns if c not in names]
    docs = docs.select(*kept)
    others = [c for c in kept if c != "text"]
    schema = StructType([docs.schema[c] for c in others])
    for n in names:
        schema = schema.add(n, LongType() if n in BASE else DoubleType())
    at = {c: kept.index(c) for c in kept}

    def run(batches):
        for b in batches:
            columns = list(zip(*map(measure, texts(b.column(at["text"]))), strict=True)) or [()] * len(names)
            arrays = [pa.array(v, pa.int64() if n in BASE else pa.float64()) for n, v in zip(names, columns, strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(at[c]) for c in others), *arrays], names=[*others, *names])

    return map_rows(docs, run, schema)


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> list[Rule]:
    """Rules from the statistics of up to ``max_rows`` labelled texts."""
    rows = statistics(labelled_sample(docs, labels, "quality", max_rows)).select("y", *TESTED).collect()
    x = np.array([r[1:] for r in rows], float).reshape(len(rows), len(TESTED))
    bad = np.array([r.y == 0 for r in rows], bool)
    order = np.lexsort((*x.T, bad))
    shuffled = order[np.random.default_rng(7).permutation(len(order))]
    return learn(x[shuffled], bad[shuffled])


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, BASE, base_failed, kept, rules), one row for each row of ``docs``.

    A null or empty text has no words and fails the base rules. Without labels
    there are no learned rules and the base rules decide alone. Repeated rows and
    rows without an id each return a row. Texts are measured whole. Other columns
    are ignored.
    """
    rules = train(docs, labels)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return (
        statistics(docs.select("doc_id", "text"))
        .withColumn("base_failed", failed)
        .select("doc_id", *BASE, "base_failed", (~F.col("base_failed") & expression(rules)).alias("kept"))
    )
