"""A corpus pipeline: each stage's rows are written as Parquet and reread as the next one's input.

Every stage takes documents with nulls in any column, empty and very long texts,
repeated rows and ids, and returns them as they are; an empty table stays empty.
A null or empty text is neither toxic nor of quality unless the labels teach so.
Columns beyond those of documents pass through to the last stage but one; ``score``
and the like may be among them, since stages name their own columns apart. The
mixture's epochs show as repeated rows: the stage returns the columns of documents,
so ``mixing.mix`` has to be called for ``epoch`` and ``mix_key``. Packing puts uses
of one document into places of their own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from terracell.llm import mixing, packing, quality_model, simhash, toxicity
from terracell.llm.base import table
from terracell.plans.durable import durable


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxicity: documents scored 0.5 or more go."""
    scored = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")), "_score")
    return scored.where("_score < 0.5").select(*docs.columns)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: documents scored under 0.5 go."""
    scored = quality_model.score(docs, quality_model.train(docs, table(spark, sf_dir, "labels")), "_score")
    return scored.where("_score >= 0.5").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near-dedup: one document of each group at five-word-shingle similarity 0.8 stays; SimHash gives the first candidates, rare shingles the rest."""
    return simhash.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing to target weights: a row for each time that a document is used."""
    return mixing.mix(docs).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str, with_ids: bool = False) -> DataFrame:
    """Best-fit packing of all uses into sequences; ``with_ids`` adds the token ids, which make up the corpus."""
    return packing.pack(docs, with_ids=with_ids)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", without_toxic),
    ("quality", good_quality),
    ("near_dedup", near_dedup),
    ("mixing", mixed),
    ("packing", packed),
]

#: No SQL: learned models, shingle hashes and token ids. tests/llm holds run() against plain Python versions of the last three stages, given what the two models keep.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = durable(docs)
    return docs
