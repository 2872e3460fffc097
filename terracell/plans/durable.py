"""Tables that cut lineage and outlive executors.

``durable`` writes a DataFrame as Parquet into the shared folder named by
``spark.checkpoint.dir`` and reads it back: losing an executor later costs a
re-read, not a recomputation, and a plan that is used twice is computed once.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
#: Rows that are worth a task of their own, and tasks that a stage has at least.
ROWS_A_TASK, LEAST_TASKS = 250_000, 8


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder, by setting or by ``setCheckpointDir``; in local mode, where none is set, a temporary one."""
    folder = spark.conf.get(_SETTING, None)
    if not folder:
        given = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = given.get() if given.isDefined() else None
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {_SETTING} to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="terracell-")
        spark.conf.set(_SETTING, folder)
    return folder.rstrip("/")


def sized(df: DataFrame, rows: int, rows_a_task: int = ROWS_A_TASK) -> DataFrame:
    """``df``, whose last stage reads up to ``rows`` rows, in no more tasks than those are worth; nothing moves."""
    return df.coalesce(max(LEAST_TASKS, -(-rows // rows_a_task)))


def durable(df: DataFrame) -> DataFrame:
    """Materialise ``df`` once, in the shared folder."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/terracell/{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._terracell_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete durable tables that no later plan reads."""
    for table in tables:
        path = getattr(table, "_terracell_path", None)
        if path:
            spark = table.sparkSession
            hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
