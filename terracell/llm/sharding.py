"""Sharding by a permutation-filled lookup table.

Shards take turns claiming slots of a prime-sized table, each by its own
preference order (an offset and a stride from two hashes of its name), until
every slot is taken (see Eisenbud et al., "Maglev", 2016). A row's slot is a
hash of its key; the table, of fixed size, is broadcast. Adding or removing a
shard moves little more than the slots it gains or loses.
"""

from __future__ import annotations

import math

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A prime; the table's rows and so the bound of what is broadcast.
SLOTS = 65_537
SHARDS = 256


def lookup_table(names: list[str], slots: int = SLOTS) -> np.ndarray:
    """The shard number that owns each slot."""
    if not names or len(set(names)) != len(names):
        raise ValueError("shards need distinct names, at least one")
    if slots < 100 * len(names) or any(slots % d == 0 for d in range(2, math.isqrt(slots) + 1)):
        raise ValueError("the table's size must be a prime of 100 slots a shard or more")
    offset = [xxhash.xxh64_intdigest(n.encode(), 1) % slots for n in names]
    stride = [xxhash.xxh64_intdigest(n.encode(), 2) % (slots - 1) + 1 for n in names]
    owner, free = np.full(slots, -1, np.int32), slots
    at = offset[:]
    while True:
        for k in range(len(names)):
            while owner[at[k]] >= 0:
                at[k] = (at[k] + stride[k]) % slots
            owner[at[k]] = k
            free -= 1
            if not free:
                return owner


def assign_shards(rows: DataFrame, key: str = "doc_id", names: list[str] | None = None, slots: int = SLOTS) -> DataFrame:
    """``rows`` with ``slot`` and ``shard``; rows of equal keys share a shard, so do all without a key.

    Columns of those names already there are replaced, after the key is read. An
    empty key is a key like any other. No row moves: placement is one hash and one
    broadcast lookup.
    """
    names = names or [f"shard-{k:05d}" for k in range(SHARDS)]
    owner = lookup_table(names, slots)
    spark, own = rows.sparkSession, [c for c in rows.columns if c not in ("slot", "shard")]
    # `slots` rows of two numbers, whatever the data's size.
    table = spark.createDataFrame([(s, names[k]) for s, k in enumerate(owner.tolist())], "slot int, shard string")
    placed = rows.select(*own, F.pmod(F.xxhash64(F.col(key)), F.lit(slots)).cast("int").alias("slot"))
    return placed.join(F.broadcast(table), "slot").select(*own, "slot", "shard")


def write_shards(rows: DataFrame, path: str, key: str = "doc_id", names: list[str] | None = None, slots: int = SLOTS, files_a_shard: int = 4) -> None:
    """Write ``path``/shard=.../ as Parquet; a shard's rows, also those of one key, are salted over ``files_a_shard`` tasks."""
    placed = assign_shards(rows, key, names, slots)
    hashed = [c for c in placed.columns if "map<" not in placed.schema[c].dataType.simpleString()]
    # By content and by the partition it comes from: a lost task deals its rows out alike again.
    salt = F.pmod(F.xxhash64(F.spark_partition_id(), *hashed), F.lit(files_a_shard))
    placed.withColumn("_salt", salt).repartition("shard", "_salt").drop("_salt").write.partitionBy("shard").parquet(path)
