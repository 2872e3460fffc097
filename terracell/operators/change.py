"""Change between epochs: M3C2 distances, volumes, cross-sections."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terracell.errors import ChangeError, ValidationError
from terracell.frame import PointFrame
from terracell.functions.eigen import covariance, eigenvalues, least_vector
from terracell.plans.columns import Columns
from terracell.plans.grid import GridSpec
from terracell.plans.neighbours import cell
from terracell.plans.tiles import Tiling, arrays, by_tile, finite


#: Points of a tile by and large, which a task holds with its halo and both epochs.
TILE_POINTS = 50_000
_SUMS = ["s_x", "s_y", "s_z", *(f"s_{p}" for p in ("xx", "xy", "xz", "yy", "yz", "zz"))]


def _placed(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*names, *(F.col(c).cast("double").alias(c) for c in "xyz")).where(finite("xyz"))


def _sides(tile: int, rows: pa.Table) -> tuple[pa.Table, list[pa.Table]]:
    side = rows.column("side").to_numpy()
    return rows.filter(pa.array(side == 0)), [rows.filter(pa.array(side == k)) for k in (1, 2)]


def _normals(cores: DataFrame, cloud: DataFrame, radius: float) -> DataFrame:
    """(pid, x, y, z, nx, ny, nz) of the core points with three neighbours or more, turned up; searched tile by tile, so no pairs are made."""
    tiling = Tiling.of(cores.select(*"xyz").unionAll(cloud.select(*"xyz")), "xyz", radius * (1 + 1e-9), rows=TILE_POINTS)
    parts = tiling.home(cores).select("tile", F.lit(0).alias("side"), "pid", *"xyz").unionAll(tiling.dealt(cloud).select("tile", F.lit(1), F.lit(None).cast("long"), *"xyz"))

    def run(tile: int, rows: pa.Table) -> pa.Table:
        q, (p, _) = _sides(tile, rows)
        x, y = arrays(q, ["x", "y", "z"]), arrays(p, ["x", "y", "z"])
        sums = Columns(y, np.arange(len(y))).balls(x, radius) if len(x) and len(y) else np.zeros((len(x), 10))
        n = np.rint(sums[:, 0]).astype(np.int64)
        enough = n >= 3
        out = {"pid": q.column("pid").to_numpy()[enough], **{c: x[enough, k] for k, c in enumerate("xyz")}, "n": n[enough]}
        return pa.table({**out, **{c: sums[enough, k + 1] for k, c in enumerate(_SUMS)}})

    sums = by_tile(parts, run, "pid long, x double, y double, z double, n long, " + ", ".join(f"{c} double" for c in _SUMS))
    found = least_vector(eigenvalues(covariance(sums), clamp=False))
    up = F.when((F.col("nz") < 0) | (F.col("nz") == 0) & ((F.col("ny") < 0) | (F.col("ny") == 0) & (F.col("nx") < 0)), -1.0).otherwise(1.0)
    return found.withColumn("_up", up).select("pid", *"xyz", *((F.col(f"n{c}") * F.col("_up")).alias(f"n{c}") for c in "xyz"))


def _cylinders(core: DataFrame, clouds: tuple[DataFrame, DataFrame], radius: float, depth: float) -> DataFrame:
    """(pid, nx, ny, nz, n1, m1, s1, n2, m2, s2): number, mean and deviation, along the normal, of both clouds' points in each core point's cylinder."""
    tiling = Tiling.of(clouds[0].select(*"xyz").unionAll(clouds[1].select(*"xyz")), "xyz", math.hypot(radius, depth) * (1 + 1e-9), rows=2 * TILE_POINTS)
    names = ["pid", *"xyz", "nx", "ny", "nz"]
    parts = tiling.home(core).select("tile", F.lit(0).alias("side"), *names)
    for k, cloud in enumerate(clouds):
        parts = parts.unionAll(tiling.dealt(cloud).select("tile", F.lit(k + 1), F.lit(None).cast("long"), *"xyz", *(F.lit(None).cast("double") for _ in range(3))))

    def run(tile: int, rows: pa.Table) -> pa.Table:
        q, epochs = _sides(tile, rows)
        x, normals = arrays(q, ["x", "y", "z"]), arrays(q, ["nx", "ny", "nz"])
        out = {c: q.column(c) for c in ("pid", "nx", "ny", "nz")}
        for k, p in enumerate(epochs, 1):
            y = arrays(p, ["x", "y", "z"])
            sums = Columns(y, np.arange(len(y))).cylinders(x, normals, radius, depth) if len(x) and len(y) else np.zeros((len(x), 3))
            n = np.rint(sums[:, 0])
            mean = sums[:, 1] / np.maximum(n, 1)
            out |= {f"n{k}": n.astype(np.int64), f"m{k}": mean, f"s{k}": np.sqrt(np.maximum(sums[:, 2] / np.maximum(n, 1) - mean * mean, 0))}
        return pa.table(out)

    return by_tile(parts, run, "pid long, nx double, ny double, nz double, " + ", ".join(f"n{k} long, m{k} double, s{k} double" for k in (1, 2)))


def m3c2(epoch1: PointFrame, epoch2: PointFrame, core_points: DataFrame | None = None, normal_scale: float = 1.0, projection_scale: float = 1.0, max_cylinder_depth: float = 10.0, registration_error: float = 0.0, confidence: float = 0.95) -> DataFrame:
    """(pid, distance, lod, nx, ny, nz, n1, n2, significant) at the core points (pid, x, y, z; by default epoch 1).

    Normals are turned up (nz >= 0), so a positive distance is a rise. Without a
    normal, or points of both epochs in the cylinder, distance and lod are null.
    """
    if min(normal_scale, projection_scale, max_cylinder_depth) <= 0 or registration_error < 0 or not 0 < confidence < 1:
        raise ChangeError("scales and depth are positive, the error isn't negative, confidence lies between 0 and 1")
    if min(c.bounds.n if c.bounds else 0 for c in (epoch1, epoch2)) < 3:
        raise ChangeError("both epochs need three points")
    cores = (epoch1.df if core_points is None else core_points).select("pid", "x", "y", "z")
    one, two = _placed(epoch1.df), _placed(epoch2.df)
    stats = _cylinders(_normals(_placed(cores, "pid"), one, normal_scale), (one, two), projection_scale, max_cylinder_depth)
    both = (F.col("n1") > 0) & (F.col("n2") > 0)
    spread = F.col("s1") * F.col("s1") / F.greatest("n1", F.lit(1)) + F.col("s2") * F.col("s2") / F.greatest("n2", F.lit(1)) + F.lit(registration_error**2)
    z = NormalDist().inv_cdf((1 + confidence) / 2)
    out = cores.select("pid").join(stats, "pid", "left")
    out = out.withColumns({"distance": F.when(both, F.col("m2") - F.col("m1")), "lod": F.when(both, F.lit(z) * F.sqrt(spread))})
    # What rounding makes of equal means is no change, even where one point alone gives a lod of 0.
    significant = F.coalesce(F.abs("distance") > F.col("lod") + F.lit(1e-12 * max_cylinder_depth), F.lit(False))
    return out.select("pid", "distance", "lod", "nx", "ny", "nz", F.coalesce("n1", F.lit(0)).alias("n1"), F.coalesce("n2", F.lit(0)).alias("n2"), significant.alias("significant"))


def mean_z(cloud: PointFrame, grid: GridSpec, name: str) -> DataFrame:
    return cloud.df.groupBy(grid.row(F.col("y")).alias("row"), grid.col(F.col("x")).alias("col")).agg(F.avg("z").alias(name))


def compute_volume(surface: PointFrame, reference: PointFrame | float, resolution: float = 1.0, method: str = "grid") -> DataFrame:
    """One row: cut (surface above reference), fill, net, areas. The reference is a cloud or an elevation."""
    if method != "grid" or resolution <= 0:
        raise ValidationError("volumes need the grid method and a positive resolution")
    a = surface.nonempty()
    flat = not isinstance(reference, PointFrame)
    b = a if flat else reference.nonempty()
    low = [min(a.low[k], b.low[k]) for k in (0, 1)]
    high = [max(a.high[k], b.high[k]) for k in (0, 1)]
    n = [math.ceil((high[k] - low[k]) / resolution) for k in (0, 1)]
    if min(n) < 1:
        raise ValidationError("the clouds have no extent")
    grid, area = GridSpec(low[0], low[1], resolution, n[0], n[1]), resolution * resolution
    top = mean_z(surface, grid, "s")
    cells = top.withColumn("r", F.lit(float(reference))) if flat else top.join(mean_z(reference, grid, "r"), ["row", "col"])
    d = F.col("s") - F.col("r")
    sums = {"cut": F.sum(F.greatest(d, F.lit(0.0))), "fill": F.sum(F.greatest(-d, F.lit(0.0))), "area": F.count("*"), "cut_area": F.count(F.when(d > 0, 1)), "fill_area": F.count(F.when(d < 0, 1))}
    out = cells.agg(*(F.coalesce(e * F.lit(area), F.lit(0.0)).alias(k) for k, e in sums.items()))
    return out.withColumns({"net": F.col("cut") - F.col("fill"), "resolution": F.lit(float(resolution))})


def polyline_segments(polyline) -> list[tuple]:
    """(index, ax, ay, dx, dy, length2, station) of the segments that have a length."""
    line = np.asarray(polyline, float)
    if line.ndim != 2 or len(line) < 2 or line.shape[1] not in (2, 3):
        raise ValidationError("a polyline is two or more vertices of x, y")
    out, station = [], 0.0
    for k, ((ax, ay), (bx, by)) in enumerate(zip(line[:-1, :2].tolist(), line[1:, :2].tolist(), strict=True)):
        length = math.hypot(bx - ax, by - ay)
        if length >= 1e-12:
            out.append((k, ax, ay, bx - ax, by - ay, length * length, station))
        station += length
    return out


def _stationed(points: DataFrame, segments: DataFrame, width: float, by: tuple = ()) -> DataFrame:
    """(*by, pid, z, station) of points within ``width`` of a line; ties go to its earlier segment.

    Segments are cut into cells of at least the corridor's width by their own
    extent, so a point meets only segments that pass near it.
    """
    edge = max(width, 1e-9)
    reach = segments
    for axis, d in (("x", "dx"), ("y", "dy")):
        lo, hi = F.least(F.col(f"a{axis}"), F.col(f"a{axis}") + F.col(d)), F.greatest(F.col(f"a{axis}"), F.col(f"a{axis}") + F.col(d))
        reach = reach.withColumn(f"_{axis}", F.explode(F.sequence(cell(lo - F.lit(width), edge), cell(hi + F.lit(width), edge))))
    # Of the segment's box, only cells whose centre is near enough to its line.
    cx, cy = (F.col("_x") + 0.5) * F.lit(edge), (F.col("_y") + 0.5) * F.lit(edge)
    off = F.abs((cx - F.col("ax")) * F.col("dy") - (cy - F.col("ay")) * F.col("dx")) / F.sqrt("length2")
    reach = reach.where(off <= F.lit(width + edge * 0.7072))
    put = points.select("pid", "x", "y", "z", cell(F.col("x"), edge).alias("_x"), cell(F.col("y"), edge).alias("_y"))
    pairs = put.join(reach, ["_x", "_y"])
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((F.col("x") - F.col("ax")) * F.col("dx") + (F.col("y") - F.col("ay")) * F.col("dy")) / F.col("length2")))
    pairs = pairs.withColumn("t", t)
    ox, oy = F.col("x") - F.col("ax") - F.col("t") * F.col("dx"), F.col("y") - F.col("ay") - F.col("t") * F.col("dy")
    pairs = pairs.withColumn("d", F.sqrt(ox * ox + oy * oy)).where(F.col("d") <= F.lit(width))
    pairs = pairs.withColumn("station", F.col("first") + F.col("t") * F.sqrt("length2"))
    best = pairs.groupBy(*by, "pid").agg(F.min_by(F.struct("z", "station"), F.struct("d", "index")).alias("b"))
    return best.select(*by, "pid", "b.*")


_SEGMENT = "index int, ax double, ay double, dx double, dy double, length2 double, first double"


def extract_cross_section(cloud: PointFrame, polyline, width: float = 1.0, resolution: float = 0.1) -> DataFrame:
    """(bin, station, elevation, n): mean z along a line, of points within ``width``; empty bins are left out; station is the bin's middle."""
    if width <= 0 or resolution <= 0:
        raise ValidationError("width and resolution are positive")
    cloud.nonempty()
    lines = polyline_segments(polyline)
    length = sum(math.sqrt(s[5]) for s in lines)
    bins = max(1, len(np.arange(0, length + resolution, resolution)) - 1)
    near = _stationed(cloud.df, cloud.df.sparkSession.createDataFrame(lines, _SEGMENT), width)
    at = F.least(F.floor(F.col("station") / F.lit(resolution)).cast("long"), F.lit(bins - 1))
    out = near.groupBy(at.alias("bin")).agg(F.avg("z").alias("elevation"), F.count("*").alias("n"))
    return out.select("bin", ((F.col("bin") + 0.5) * F.lit(resolution)).alias("station"), "elevation", "n")


def profile_lines(polyline, interval: float, width: float) -> list[tuple[int, tuple]]:
    """(profile, segment) across the line every ``interval``, each 2 * width long, along the left-hand normal."""
    lines = polyline_segments(polyline)
    length = sum(math.sqrt(s[5]) for s in lines)
    out = []
    for k, s in enumerate(np.arange(0, length + interval / 2, interval).tolist()):
        s = min(s, length)
        _, ax, ay, dx, dy, length2, first = next((x for x in lines if s <= x[6] + math.sqrt(x[5])), lines[-1])
        size = math.sqrt(length2)
        t = (s - first) / size
        px, py, ux, uy = ax + t * dx, ay + t * dy, -dy / size, dx / size
        out.append((k, (0, px - ux * width, py - uy * width, 2 * width * ux, 2 * width * uy, 4 * width * width, 0.0)))
    return out


def extract_profiles(cloud: PointFrame, polyline, interval: float = 10.0, width: float = 5.0, resolution: float = 0.1) -> DataFrame:
    """(profile_id, bin, station, elevation, n): cross-sections across a line, all in one job."""
    if min(interval, width, resolution) <= 0:
        raise ValidationError("interval, width and resolution are positive")
    cloud.nonempty()
    lines = [(k, *s) for k, s in profile_lines(polyline, interval, width)]
    near = _stationed(cloud.df, cloud.df.sparkSession.createDataFrame(lines, f"profile_id int, {_SEGMENT}"), width, ("profile_id",))
    bins = max(1, len(np.arange(0, 2 * width + resolution, resolution)) - 1)
    at = F.least(F.floor(F.col("station") / F.lit(resolution)).cast("long"), F.lit(bins - 1))
    out = near.groupBy("profile_id", at.alias("bin")).agg(F.avg("z").alias("elevation"), F.count("*").alias("n"))
    return out.select("profile_id", "bin", ((F.col("bin") + 0.5) * F.lit(resolution)).alias("station"), "elevation", "n")
