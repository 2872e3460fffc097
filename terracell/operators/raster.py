"""Rasters: surface and terrain models, interpolation, derivatives, and a GeoTIFF writer.

A raster is a DataFrame (row, col, value) with its GridSpec; it is made dense
only where its meaning asks for it.
"""

from __future__ import annotations

import math
import struct
from dataclasses import dataclass
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terracell.errors import ExportError, RasterError
from terracell.frame import GROUND_CLASS, PointFrame
from terracell.plans.durable import durable
from terracell.plans.grid import GridSpec
from terracell.plans.neighbours import nearest_k

NODATA = -9999.0
METHODS = ("idw", "nearest")
#: Most cells that may be gathered in one place, for a file.
MAX_DENSE = 50_000_000


@dataclass(frozen=True, eq=False)
class Raster:
    df: DataFrame
    grid: GridSpec
    crs: str = ""
    nodata: float = NODATA

    def dense(self) -> np.ndarray:
        """(ny, nx) on the driver; refused over MAX_DENSE cells."""
        if self.grid.cells > MAX_DENSE:
            raise RasterError(f"{self.grid.cells} cells are too many to gather")
        out = np.full((self.grid.ny, self.grid.nx), self.nodata)
        rows = self.df.toPandas()
        out[rows["row"].to_numpy(int), rows["col"].to_numpy(int)] = rows["value"].fillna(self.nodata).to_numpy(float)
        return out


def idw_interpolate(queries: DataFrame, points: DataFrame, power: float = 2.0, max_dist: float | None = None, k: int = 12, nodata: float = NODATA, keep: tuple = ("row", "col")) -> DataFrame:
    """``keep`` columns and value: mean of the k nearest points' z, weighted by 1 / d ** power; a hit's own z. queries: x, y; points: pid, x, y, z."""
    if power <= 0:
        raise RasterError("the power is positive")
    near = nearest_k(queries, points, k, "xy", keep, ("pid", "z"))
    d2, z = F.col("d2"), F.col("b_z")
    usable = F.lit(True) if max_dist is None else d2 <= F.lit(max_dist * max_dist)
    weight = F.when((d2 > 0) & usable, 1 / (d2 if power == 2 else F.pow(d2, F.lit(power / 2))))
    out = near.groupBy(*(f"a_{c}" for c in keep)).agg(
        F.min("d2").alias("least"), F.min_by("b_z", F.struct("d2", "b_pid")).alias("hit"), F.sum(weight * z).alias("wz"), F.sum(weight).alias("w")
    )
    value = F.when(F.col("least") == 0, F.col("hit")).when(F.col("w") > 0, F.col("wz") / F.col("w")).otherwise(F.lit(nodata))
    return out.select(*(F.col(f"a_{c}").alias(c) for c in keep), value.alias("value"))


def nearest_interpolate(queries: DataFrame, points: DataFrame, max_dist: float | None = None, nodata: float = NODATA, keep: tuple = ("row", "col")) -> DataFrame:
    """``keep`` columns and value: z of the nearest point, nodata beyond ``max_dist``."""
    near = nearest_k(queries, points, 1, "xy", keep, ("pid", "z"))
    value = F.col("b_z") if max_dist is None else F.when(F.col("d2") <= F.lit(max_dist * max_dist), F.col("b_z")).otherwise(F.lit(nodata))
    return near.select(*(F.col(f"a_{c}").alias(c) for c in keep), value.alias("value"))


def _interpolate(method: str, queries: DataFrame, points: DataFrame, nodata: float) -> DataFrame:
    return (idw_interpolate if method == "idw" else nearest_interpolate)(queries, points, nodata=nodata)


def _checked(cloud: PointFrame, resolution: float, method: str) -> GridSpec:
    if resolution <= 0 or method not in METHODS:
        raise RasterError("a raster needs a positive resolution and a known method")
    return GridSpec.edges_of(cloud.nonempty(RasterError), resolution, least=1)


def max_z(cloud: PointFrame, grid: GridSpec) -> DataFrame:
    return cloud.df.groupBy(grid.row(F.col("y")).alias("row"), grid.col(F.col("x")).alias("col")).agg(F.max("z").alias("value"))


def create_dsm(cloud: PointFrame, resolution: float = 1.0, method: str = "idw", nodata: float = NODATA) -> Raster:
    """Highest z a cell; empty cells are interpolated from all points."""
    grid = _checked(cloud, resolution, method)
    top = durable(max_z(cloud, grid))
    empty = grid.centres(grid.dense(cloud.df.sparkSession).join(top, ["row", "col"], "left_anti"))
    return Raster(top.unionByName(_interpolate(method, empty, cloud.df, nodata)), grid, cloud.meta.crs, nodata)


def create_dtm(cloud: PointFrame, resolution: float = 1.0, method: str = "idw", ground_class: int = GROUND_CLASS, nodata: float = NODATA) -> Raster:
    """Every cell of the whole cloud's grid is interpolated from ground points at its centre."""
    grid = _checked(cloud, resolution, method)
    cloud.require("classification", error=RasterError)
    ground = cloud.df.where(F.col("classification") == ground_class)
    if ground.isEmpty():
        raise RasterError("no ground points")
    return Raster(_interpolate(method, grid.centres(grid.dense(cloud.df.sparkSession)), ground, nodata), grid, cloud.meta.crs, nodata)


create_dem = create_dtm


def node_dem(cloud: PointFrame, resolution: float = 1.0, k: int = 12, power: float = 2.0) -> Raster:
    """Elevations at grid nodes from all points; distances count as 1e-10 at least."""
    grid = GridSpec.nodes_of(cloud.nonempty(RasterError), resolution)
    near = nearest_k(grid.nodes(grid.dense(cloud.df.sparkSession)), cloud.df, k, "xy", ("row", "col"), ("pid", "z"))
    w = 1 / F.pow(F.greatest(F.sqrt("d2"), F.lit(1e-10)), F.lit(power))
    return Raster(near.groupBy(F.col("a_row").alias("row"), F.col("a_col").alias("col")).agg((F.sum(w * F.col("b_z")) / F.sum(w)).alias("value")), grid, cloud.meta.crs)


def _stencil(raster: Raster, name_of) -> DataFrame:
    """Each cell of a dense raster with its 3 x 3 surroundings, edges repeated: two window passes, no self-join."""
    df = raster.df
    cols = Window.partitionBy("row").orderBy("col")
    df = df.select("row", "col", F.col("value").alias("c"), F.coalesce(F.lag("value").over(cols), F.col("value")).alias("w"), F.coalesce(F.lead("value").over(cols), F.col("value")).alias("e"))
    rows = Window.partitionBy("col").orderBy("row")
    out = {name_of(0, k): F.col(v) for v, k in (("w", -1), ("c", 0), ("e", 1))}
    for v, k in (("w", -1), ("c", 0), ("e", 1)):
        out[name_of(-1, k)] = F.coalesce(F.lag(v).over(rows), F.col(v))
        out[name_of(1, k)] = F.coalesce(F.lead(v).over(rows), F.col(v))
    return df.select("row", "col", *(e.alias(n) for n, e in out.items()))


def _named(dr: int, dc: int) -> str:
    return f"v{'msp'[dr + 1]}{'msp'[dc + 1]}"


def slope_aspect(raster: Raster) -> DataFrame:
    """(row, col, slope, aspect) in degrees, by central differences, one-sided at the edges."""
    s, g = _stencil(raster, _named), raster.grid

    def difference(low: str, high: str, index: str, n: int):
        inner = (F.col(index) > 0) & (F.col(index) < n - 1)
        return (F.col(high) - F.col(low)) / F.when(inner, 2 * g.res).otherwise(g.res)

    df = s.withColumns({"gx": difference("vsm", "vsp", "col", g.nx), "gy": difference("vms", "vps", "row", g.ny)})
    slope = F.degrees(F.atan(F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy"))))
    aspect = F.degrees(F.atan2(-F.col("gx"), F.col("gy")))
    return df.select("row", "col", slope.alias("slope"), F.when(aspect < 0, aspect + 360).otherwise(aspect).alias("aspect"))


def hillshade(raster: Raster, azimuth: float = 315.0, altitude: float = 45.0) -> DataFrame:
    """(row, col, shade) from 0 to 255, by Horn's differences."""
    v = {n: F.col(n) for n in ("vmm", "vms", "vmp", "vsm", "vsp", "vpm", "vps", "vpp")}
    gx = ((v["vmp"] + 2 * v["vsp"] + v["vpp"]) - (v["vmm"] + 2 * v["vsm"] + v["vpm"])) / (8 * raster.grid.res)
    gy = ((v["vpm"] + 2 * v["vps"] + v["vpp"]) - (v["vmm"] + 2 * v["vms"] + v["vmp"])) / (8 * raster.grid.res)
    df = _stencil(raster, _named).withColumns({"gx": gx, "gy": gy})
    zenith, az = math.radians(90 - altitude), math.radians((360 - azimuth + 90) % 360)
    slope = F.atan(F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")))
    lit = F.lit(math.cos(zenith)) * F.cos(slope) + F.lit(math.sin(zenith)) * F.sin(slope) * F.cos(F.lit(az) - F.atan2(F.col("gy"), -F.col("gx")))
    return df.select("row", "col", (255 * F.greatest(F.lit(0.0), lit)).alias("shade"))


def moving(df: DataFrame, value: str, w: int, how: str, out: str) -> DataFrame:
    """Moving min, max or sum over (2w + 1)-cell squares of a dense raster, cut at the edges: one window pass by row, one by column."""
    f = {"min": F.min, "max": F.max, "sum": F.sum}[how]
    by_row = Window.partitionBy("row").orderBy("col").rangeBetween(-w, w)
    by_col = Window.partitionBy("col").orderBy("row").rangeBetween(-w, w)
    return df.withColumn(out, f(value).over(by_row)).withColumn(out, f(out).over(by_col))


def sinkholes(raster: Raster, depth: float = 0.5, window: int = 5) -> DataFrame:
    """(row, col, value, depth): local minima deeper than ``depth`` under their window's mean."""
    w = window // 2
    df = moving(raster.df.withColumn("one", F.lit(1.0)), "value", w, "min", "low")
    df = moving(moving(df, "value", w, "sum", "total"), "one", w, "sum", "cells")
    under = F.col("total") / F.col("cells") - F.col("value")
    return df.where((F.col("value") == F.col("low")) & (under > depth)).select("row", "col", "value", under.alias("depth"))


def flood_mask(raster: Raster, percentile: float = 10.0) -> DataFrame:
    """(row, col, value, flooded): cells at or under a percentile of all."""
    from terracell.operators.metrics import exact_percentiles

    level = exact_percentiles(raster.df, "value", [percentile / 100])[0]
    return raster.df.withColumn("flooded", F.col("value") <= F.lit(level))


def export_geotiff(raster: Raster, path: str) -> None:
    """A single-band float64 GeoTIFF, north up, with nodata; its folder must exist. Gathers up to MAX_DENSE cells."""
    target, grid = Path(path), raster.grid
    if not target.parent.is_dir():
        raise ExportError(f"no folder {target.parent}")
    data = raster.dense()[::-1].astype("<f8").tobytes()
    nodata = f"{raster.nodata:g}\0".encode()
    scale = struct.pack("<3d", grid.res, grid.res, 0)
    tie = struct.pack("<6d", 0, 0, 0, grid.x0, grid.y0 + grid.ny * grid.res, 0)
    code = int(raster.crs.rpartition(":")[2]) if raster.crs.rpartition(":")[2].isdigit() else 32767
    keys = struct.pack("<12H", 1, 1, 0, 2, 1024, 0, 1, 1, 3072, 0, 1, code)
    entries = [
        (256, 4, 1, grid.nx), (257, 4, 1, grid.ny), (258, 3, 1, 64), (259, 3, 1, 1), (262, 3, 1, 1), (273, 4, 1, None), (277, 3, 1, 1), (278, 4, 1, grid.ny), (279, 4, 1, len(data)), (339, 3, 1, 3),
        (33550, 12, 3, scale), (33922, 12, 6, tie), (34735, 3, 12, keys), (42113, 2, len(nodata), nodata),
    ]
    at = 8 + 2 + 12 * len(entries) + 4
    blob, directory = b"", struct.pack("<H", len(entries))
    start = at + sum(len(v) for *_, v in entries if isinstance(v, bytes) and len(v) > 4)
    for tag, kind, count, v in entries:
        if isinstance(v, bytes) and len(v) > 4:
            field, blob = struct.pack("<I", at + len(blob)), blob + v
        elif isinstance(v, bytes):
            field = v.ljust(4, b"\0")
        else:
            field = struct.pack("<I", start if v is None else v)
        directory += struct.pack("<HHI", tag, kind, count) + field
    try:
        target.write_bytes(struct.pack("<2sHI", b"II", 42, 8) + directory + struct.pack("<I", 0) + blob + data)
    except OSError as e:
        raise ExportError(str(e)) from e
