"""Tiles: their index, files, and operations on each."""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from terracell.errors import ValidationError
from terracell.frame import PointFrame


def tiled(cloud: PointFrame, tile_size: float = 500.0, overlap: float = 0.0, drop_far_edge: bool = False) -> DataFrame:
    """The cloud with tile_col and tile_row; with an overlap, a row for each tile that a point is in.

    Points on the far edges belong to the last tiles, unless ``drop_far_edge``
    keeps tiles half-open there too.
    """
    if tile_size <= 0 or overlap < 0:
        raise ValidationError("tiles have a size, and no negative overlap")
    b, df = cloud.nonempty(), cloud.df
    for name, axis, k in (("tile_col", "x", 0), ("tile_row", "y", 1)):
        n = max(1, math.ceil(b.extent(k) / tile_size))
        at = F.col(axis) - F.lit(b.low[k])
        own = F.floor(at / F.lit(tile_size)).cast("long")
        last = F.lit(n - 1).cast("long")
        if overlap:
            lo = F.greatest(F.lit(0).cast("long"), F.floor((at - F.lit(overlap)) / F.lit(tile_size)).cast("long"))
            hi = F.least(last, F.floor((at + F.lit(overlap)) / F.lit(tile_size)).cast("long"))
            df = df.withColumn(name, F.explode(F.sequence(F.least(lo, hi), hi)))
        else:
            df = df.withColumn(name, own if drop_far_edge else F.least(own, last))
            if drop_far_edge:
                df = df.where(F.col(name) <= last)
    return df


def tile_table(cloud: PointFrame, tile_size: float = 500.0, overlap: float = 0.0, drop_far_edge: bool = False) -> DataFrame:
    """(tile_col, tile_row, xmin, ymin, xmax, ymax, point_count) of tiles that hold points."""
    b = cloud.nonempty()
    counts = tiled(cloud, tile_size, overlap, drop_far_edge).groupBy("tile_col", "tile_row").agg(F.count("*").alias("point_count"))
    ends = {f"{a}{e}": F.lit(b.low[k]) + (F.col(t) + j) * F.lit(tile_size) for a, t, k in (("x", "tile_col", 0), ("y", "tile_row", 1)) for e, j in (("min", 0), ("max", 1))}
    return counts.withColumns(ends).select("tile_col", "tile_row", "xmin", "ymin", "xmax", "ymax", "point_count")


def write_tiles(cloud: PointFrame, path: str, tile_size: float = 500.0, overlap: float = 0.0, files_a_tile: int = 4) -> None:
    """Parquet partitioned by tile_col and tile_row, all attributes kept; a dense tile's rows are dealt over several files."""
    salt = F.pmod(F.xxhash64("pid"), F.lit(files_a_tile))
    tiled(cloud, tile_size, overlap).withColumn("_salt", salt).repartition("tile_col", "tile_row", "_salt").drop("_salt").write.partitionBy("tile_col", "tile_row").parquet(path)


def process_tiles(cloud: PointFrame, operation: Callable[[pd.DataFrame], pd.DataFrame], schema: StructType | str, tile_size: float = 500.0, overlap: float = 0.0) -> DataFrame:
    """``operation`` on every tile, in parallel; a tile must fit a task's memory."""
    return tiled(cloud, tile_size, overlap).groupBy("tile_col", "tile_row").applyInPandas(operation, schema)
