"""Tiles of space with halos, for neighbour searches on arrays.

Space falls into units, cubes at least as long as a search reaches; a tile is a
cube of units and a task's group of rows. Every point goes to its own tile and to
those whose halo it lies in, so that a tile holds all that its own points can reach
and no table of pairs is made: what is shuffled are the points and their halos.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Points that a tile has, by and large; a tile of more than four times as many is cut, down to twice its halo.
ROWS = 100_000
#: Bits of a tile's place along an axis.
_BITS = 20


def finite(axes: str) -> Column:
    """Whether a row has a place at all; without one it is near nothing, itself included."""
    out = None
    for a in axes:
        one = F.col(a).isNotNull() & ~F.isnan(a) & (F.abs(a) < F.lit(math.inf))
        out = one if out is None else out & one
    return F.coalesce(out, F.lit(False))


@dataclass(frozen=True)
class Tiling:
    """``side`` units to a tile, from ``low`` on; ``tiles`` along each axis; copies to tiles within ``halo`` units."""

    axes: str
    low: tuple[float, ...]
    unit: float
    side: int
    tiles: tuple[int, ...]
    halo: int

    @classmethod
    def of(cls, df: DataFrame, axes: str, unit: float, halo: int = 1, rows: int | None = None) -> Tiling | None:
        """A tiling of the points of ``df``; None if it has no row. Points outside its box may be dealt as well."""
        rows = rows or ROWS
        ends = df.agg(F.count("*").alias("n"), *(f(a).alias(f"{f.__name__}_{a}") for a in axes for f in (F.min, F.max))).first()
        if not ends.n:
            return None
        low = tuple(float(ends[f"min_{a}"]) for a in axes)
        extent = [float(ends[f"max_{a}"]) - lo for a, lo in zip(axes, low, strict=True)]
        flat = [e for e in extent if e > unit * halo] or [unit]
        wide = (math.prod(flat) * rows / ends.n) ** (1 / len(flat))
        least = max(2 * halo, math.ceil(max(extent) / unit / (1 << _BITS - 1)))
        side = max(least, math.ceil(min(wide, max(extent) + unit) / unit))
        while True:
            made = cls(axes, low, unit, side, tuple(int(e // unit) // side + 1 for e in extent), halo)
            if side == least or df.groupBy(made._key([made._tile(a, 0) for a in axes])).count().agg(F.max("count")).first()[0] <= 4 * rows:
                return made
            side = max(least, side // 2)

    def _tile(self, axis: str, shift: int) -> Column:
        k = self.axes.index(axis)
        unit = F.floor((F.col(axis) - F.lit(self.low[k])) / F.lit(self.unit)).cast("double") + F.lit(float(shift))
        return F.least(F.greatest(F.floor(unit / F.lit(float(self.side))), F.lit(0)), F.lit(self.tiles[k] - 1)).cast("long")

    def _key(self, places: list[Column]) -> Column:
        out = F.lit(0).cast("long")
        for p in places:
            out = F.shiftleft(out, _BITS) + p
        return out.alias("tile")

    def home(self, df: DataFrame) -> DataFrame:
        """Every row, with its own tile's number."""
        return df.select(self._key([self._tile(a, 0) for a in self.axes]), *df.columns)

    def dealt(self, df: DataFrame) -> DataFrame:
        """Every row once for each tile that it lies in or in the halo of."""
        names = df.columns
        for a in self.axes:
            df = df.withColumn(f"_{a}", F.explode(F.sequence(self._tile(a, -self.halo), self._tile(a, self.halo))))
        return df.select(self._key([F.col(f"_{a}") for a in self.axes]), *names)

    def units(self, p: np.ndarray) -> np.ndarray:
        """Each point's unit along each axis."""
        return np.floor((p - np.array(self.low)) / self.unit).astype(np.int64)

    def owned(self, units: np.ndarray, tile: int) -> np.ndarray:
        """Which of the units lie in the tile itself."""
        at = np.clip(units // self.side, 0, np.array(self.tiles) - 1)
        key = np.zeros(len(at), np.int64)
        for k in range(at.shape[1]):
            key = (key << _BITS) + at[:, k]
        return key == tile


def arrays(rows: pa.Table, names: str | list[str]) -> np.ndarray:
    """Columns of a table as one array of doubles, a row a row."""
    return np.stack([rows.column(n).to_numpy() for n in names], axis=1).astype(float, copy=False)


def by_tile(parts: DataFrame, run: Callable[[int, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``run(tile, rows)`` of every tile's rows."""

    def one(rows: pa.Table) -> pa.Table:
        return run(rows.column("tile")[0].as_py(), rows)

    return parts.groupBy("tile").applyInArrow(one, schema)
