"""Grids: their edges, the cell of a point, and dense tables of cells."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terracell.frame import Bounds


@dataclass(frozen=True)
class GridSpec:
    """Cells of edge ``res`` from (x0, y0); ``nx`` columns and ``ny`` rows."""

    x0: float
    y0: float
    res: float
    nx: int
    ny: int

    @classmethod
    def edges_of(cls, bounds: Bounds, res: float, least: int = 0) -> GridSpec:
        """Bins between edges low, low + res, ... past high; counted as floating-point steps count them."""
        n = [max(least, len(np.arange(bounds.low[a], bounds.high[a] + res, res)) - 1) for a in (0, 1)]
        return cls(bounds.low[0], bounds.low[1], res, n[0], n[1])

    @classmethod
    def nodes_of(cls, bounds: Bounds, res: float) -> GridSpec:
        """ceil(extent / res) + 1 nodes, two at least."""
        n = [max(2, int(np.ceil(bounds.extent(a) / res)) + 1) for a in (0, 1)]
        return cls(bounds.low[0], bounds.low[1], res, n[0], n[1])

    @property
    def cells(self) -> int:
        return self.nx * self.ny

    def col(self, x: Column) -> Column:
        return self._index(x, self.x0, self.nx)

    def row(self, y: Column) -> Column:
        return self._index(y, self.y0, self.ny)

    def _index(self, v: Column, origin: float, n: int) -> Column:
        at = F.floor((v - F.lit(origin)) / F.lit(self.res)).cast("long")
        return F.greatest(F.lit(0).cast("long"), F.least(at, F.lit(n - 1).cast("long")))

    def dense(self, spark: SparkSession) -> DataFrame:
        """(row, col) of every cell, made on the executors."""
        return spark.range(self.cells).select(F.expr(f"id div {max(1, self.nx)}").alias("row"), (F.col("id") % max(1, self.nx)).alias("col"))

    def centres(self, cells: DataFrame) -> DataFrame:
        half = self.res / 2
        return cells.withColumn("x", F.lit(self.x0) + F.col("col") * F.lit(self.res) + F.lit(half)).withColumn("y", F.lit(self.y0) + F.col("row") * F.lit(self.res) + F.lit(half))

    def nodes(self, cells: DataFrame) -> DataFrame:
        return cells.withColumn("x", F.lit(self.x0) + F.col("col") * F.lit(self.res)).withColumn("y", F.lit(self.y0) + F.col("row") * F.lit(self.res))
