"""What the operators of this package share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terracell.plans.durable import durable
from terracell.plans.forest import Forest  # noqa: F401
from terracell.plans.shipping import ship

#: Rows and bytes of an Arrow batch: bounds a Python worker's memory where texts are long.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def map_rows(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with bounded batches."""
    small_batches(df.sparkSession)
    return df.mapInArrow(f, schema)


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null counts as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def held_out(column: str, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves the remainder; a null id is held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(modulus)) == remainder, F.lit(True))


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, max_rows: int, learn_from: Column | None = None) -> DataFrame:
    """(text, y): at most ``max_rows`` labelled texts, those of the lowest id hashes; durable.

    A label is the largest that its id has; ids and labels that are null don't count.
    """
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(target).isNotNull())
    if learn_from is not None:
        rows = rows.where(learn_from)
    chosen = rows.groupBy("doc_id").agg(F.max(target).cast("int").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    # At most max_rows pairs of numbers: small enough for every executor.
    found = docs.select(F.col("doc_id"), "text").join(F.broadcast(durable(chosen)), "doc_id")
    return durable(found.select("text", "y"))
