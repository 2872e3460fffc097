"""Statistics, density, coverage and canopy height."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terracell.errors import PlatformError, ValidationError
from terracell.frame import GROUND_CLASS, PointFrame
from terracell.plans.grid import GridSpec
from terracell.plans.neighbours import nearest_k

PERCENTILES = (5, 25, 50, 75, 95)


#: Bins of a pass that narrows a percentile down, and values that are gathered in the end.
BINS, GATHERED = 2048, 20_000


def exact_percentiles(df: DataFrame, column: str, shares: list[float], gathered: int = GATHERED) -> list[float | None]:
    """Percentiles as linear interpolation between order statistics, without gathering or sorting the column.

    Every pass counts values in BINS bins of each interval that still holds a wanted
    order statistic; the bin that holds it is the next interval, until that has few
    values or only one. Nulls don't count.
    """
    v = F.col(column).cast("double")
    n, low, high = df.agg(F.count(v), F.min(v), F.max(v)).first()
    if not n:
        return [None] * len(shares)
    wanted = sorted({k for s in shares for k in (int(s * (n - 1)), min(n - 1, int(s * (n - 1)) + 1))})
    found: dict[int, float] = {}
    spans = [(low, high, 0, n, wanted)]  # least and greatest value, values before, values within, ranks sought
    while spans:
        small = [s for s in spans if s[0] == s[1] or s[3] <= gathered]
        spans = [s for s in spans if s not in small]
        for lo, hi, before, _, ranks in small:
            values = [lo] * (max(ranks) - before + 1) if lo == hi else [r[0] for r in df.where((v >= lo) & (v <= hi)).select(v).orderBy(v).limit(max(ranks) - before + 1).collect()]
            found.update({k: values[k - before] for k in ranks})
        if not spans:
            break
        of, bin_ = F.lit(None).cast("int"), F.lit(None).cast("int")
        for k, (lo, hi, *_) in enumerate(spans):
            inside = (v >= lo) & (v <= hi)
            place = F.least(F.lit(BINS - 1), F.floor((v / 2 - F.lit(lo / 2)) / F.lit((hi / 2 - lo / 2) / BINS)).cast("int"))
            of, bin_ = F.when(inside, F.lit(k)).otherwise(of), F.when(inside, place).otherwise(bin_)
        rows = df.select(of.alias("k"), bin_.alias("b"), v.alias("v")).where("k is not null").groupBy("k", "b").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        counted = sorted(rows.collect(), key=lambda r: (r.k, r.lo))  # BINS rows an interval at most
        new = []
        for k, (_, _, before, _, ranks) in enumerate(spans):
            for r in (r for r in counted if r.k == k):
                here = [x for x in ranks if before <= x < before + r.n]
                if here:
                    new.append((r.lo, r.hi, before, r.n, here))
                before += r.n
        spans = new
    out = []
    for s in shares:
        k = int(s * (n - 1))
        a, b = found[k], found[min(n - 1, k + 1)]
        out.append(a + (b - a) * (s * (n - 1) - k))
    return out


def cloud_statistics(cloud: PointFrame, exact: bool = True) -> DataFrame:
    """One row: count, bounds, centroid, z statistics and percentiles, intensity statistics (null if absent).

    Exact percentiles take a few passes of histograms; ``exact=False`` takes the
    mergeable sketch instead.
    """
    cloud.nonempty()
    z = "z"
    shares = [p / 100 for p in PERCENTILES]
    pct = F.array(*(F.lit(p) for p in exact_percentiles(cloud.df, z, shares))) if exact else F.percentile_approx(z, shares, 10_000)
    has = cloud.has("intensity")
    out = cloud.df.agg(
        F.count("*").alias("n_points"),
        *(F.min(c).alias(f"{c}_min") for c in "xyz"),
        *(F.max(c).alias(f"{c}_max") for c in "xyz"),
        *(F.avg(c).alias(f"{c}_mean") for c in "xyz"),
        F.stddev_pop(z).alias("z_std"),
        pct.alias("_p"),
        (F.avg("intensity") if has else F.lit(None).cast("double")).alias("intensity_mean"),
        (F.stddev_pop("intensity") if has else F.lit(None).cast("double")).alias("intensity_std"),
    )
    return out.withColumns({f"z_p{p}": F.col("_p")[k] for k, p in enumerate(PERCENTILES)}).drop("_p")


def _cells(cloud: PointFrame, resolution: float) -> tuple[GridSpec, DataFrame]:
    if resolution <= 0:
        raise ValidationError("the resolution is positive")
    grid = GridSpec.edges_of(cloud.nonempty(), resolution)
    counts = cloud.df.groupBy(grid.row(F.col("y")).alias("row"), grid.col(F.col("x")).alias("col")).agg(F.count("*").alias("count"))
    return grid, counts


def point_density(cloud: PointFrame, resolution: float = 1.0, dense: bool = True) -> DataFrame:
    """(row, col, count): points a cell; empty cells too if ``dense``."""
    grid, counts = _cells(cloud, resolution)
    if not dense:
        return counts
    return grid.dense(cloud.df.sparkSession).join(counts, ["row", "col"], "left").na.fill(0, ["count"])


def coverage_statistics(cloud: PointFrame, resolution: float = 1.0) -> DataFrame:
    """One row: density over occupied cells, share of empty cells, total and covered area."""
    grid, counts = _cells(cloud, resolution)
    area = resolution * resolution
    d = F.col("count") / F.lit(area)
    return counts.agg(
        F.avg(d).alias("mean_density"), F.min(d).alias("min_density"), F.max(d).alias("max_density"), F.stddev_pop(d).alias("std_density"),
        (1 - F.count("*") / F.lit(grid.cells)).alias("gap_fraction"), F.lit(grid.cells * area).alias("total_area"), (F.count("*") * area).alias("covered_area"),
    )


def fill_nearest(cells: DataFrame, missing: DataFrame, value: str) -> DataFrame:
    """Cells of ``missing`` with the value of the nearest cell in index space (ties: lowest row, then column)."""
    q = missing.select(F.col("col").cast("double").alias("x"), F.col("row").cast("double").alias("y"), "row", "col")
    p = cells.select((F.col("row") * F.lit(1 << 31) + F.col("col")).alias("pid"), F.col("col").cast("double").alias("x"), F.col("row").cast("double").alias("y"), value)
    near = nearest_k(q, p, 1, "xy", ("row", "col"), ("pid", value))
    return near.select(F.col("a_row").alias("row"), F.col("a_col").alias("col"), F.col(f"b_{value}").alias(value))


def canopy_height_model(cloud: PointFrame, resolution: float = 1.0, ground_class: int = GROUND_CLASS) -> DataFrame:
    """(row, col, chm): highest vegetation over lowest ground a cell, at least 0; 0 without vegetation.

    Cells without ground take that of the nearest cell that has some.
    """
    if cloud.meta.platform == "terrestrial":
        raise PlatformError("canopy height needs a view from above")
    cloud.require("classification")
    if resolution <= 0:
        raise ValidationError("the resolution is positive")
    grid = GridSpec.edges_of(cloud.nonempty(), resolution)
    ground = F.col("classification") == ground_class
    from terracell.plans.durable import durable

    cells = durable(
        cloud.df.groupBy(grid.row(F.col("y")).alias("row"), grid.col(F.col("x")).alias("col")).agg(F.min(F.when(ground, F.col("z"))).alias("ground"), F.max(F.when(~ground, F.col("z"))).alias("top"))
    )
    known = cells.where("ground is not null").select("row", "col", "ground")
    if known.isEmpty():
        raise ValidationError("no ground points")
    # Only cells with vegetation need a ground height: where there is none the result is 0.
    filled = known.unionByName(fill_nearest(known, cells.where("ground is null and top is not null").select("row", "col"), "ground"))
    veg = cells.where("top is not null").select("row", "col", "top").join(filled, ["row", "col"])
    high = veg.select("row", "col", F.greatest(F.lit(0.0), F.col("top") - F.col("ground")).alias("chm"))
    return grid.dense(cloud.df.sparkSession).join(high, ["row", "col"], "left").na.fill(0.0, ["chm"])


def segment_sizes(labels: DataFrame) -> DataFrame:
    """(label, size), noise excluded."""
    return labels.where("label >= 0").groupBy("label").agg(F.count("*").alias("size"))


