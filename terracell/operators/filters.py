"""Filters and samplers of point clouds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terracell.errors import ValidationError
from terracell.frame import PointFrame
from terracell.plans.neighbours import cell, nearest_k, radius_pairs


def crop(cloud: PointFrame, box: tuple[float, float, float, float, float, float]) -> PointFrame:
    """Points inside (xmin, ymin, zmin, xmax, ymax, zmax), faces included; the filter reaches the Parquet scan."""
    if len(box) != 6 or any(box[k] >= box[k + 3] for k in range(3)):
        raise ValidationError("a box is three lower and three greater upper bounds")
    inside = [F.col(c).between(float(box[k]), float(box[k + 3])) for k, c in enumerate("xyz")]
    return cloud.filter(inside[0] & inside[1] & inside[2])


def voxel_keys(cloud: PointFrame, size: float) -> list[Column]:
    low = cloud.nonempty().low
    return [cell(F.col(c) - F.lit(low[k]), size).alias(f"v{c}") for k, c in enumerate("xyz")]


def voxel_downsample(cloud: PointFrame, size: float, keep: str = "first") -> PointFrame:
    """One point a voxel: that of the lowest pid, or (keep="centroid") the mean of its points."""
    if size <= 0:
        raise ValidationError("a voxel's size is positive")
    keys = voxel_keys(cloud, size)
    if keep == "centroid":
        others = [c for c in ("intensity",) if cloud.has(c)]
        out = cloud.df.groupBy(*keys).agg(F.min("pid").alias("pid"), *(F.avg(c).alias(c) for c in ("x", "y", "z", *others)))
        return cloud.with_df(out.drop("vx", "vy", "vz"))
    if keep != "first":
        raise ValidationError("keep is 'first' or 'centroid'")
    first = cloud.df.groupBy(*keys).agg(F.min_by(F.struct(*cloud.df.columns), "pid").alias("p"))
    return cloud.with_df(first.select("p.*"))


def exact_sample(df: DataFrame, k: int, seed: int = 0, key: str = "pid") -> DataFrame:
    """Exactly min(k, rows) rows, those of the lowest seeded hashes; no row moves.

    Counts by 65,536 hash buckets tell the bucket of the k-th hash; only that
    bucket is ordered.
    """
    h = F.xxhash64(F.col(key), F.lit(seed))
    counts = {r.b: r["count"] for r in df.groupBy(F.shiftright(h, 48).alias("b")).count().collect()}
    left = k
    for b in sorted(counts):
        if counts[b] >= left:
            break
        left -= counts[b]
    else:
        return df
    if left <= 0:
        return df.limit(0)
    inside = df.where(F.shiftright(h, 48) == b).select(h.alias("h"), F.col(key).alias("k")).orderBy("h", "k").limit(left)
    edge = inside.agg(F.max(F.struct("h", "k")).alias("e")).first().e
    return df.where((h < edge.h) | ((h == edge.h) & (F.col(key) <= edge.k)))


def random_downsample(cloud: PointFrame, fraction: float, seed: int = 0) -> PointFrame:
    """Exactly max(1, int(n * fraction)) points, the same ones for the same seed."""
    if not 0 < fraction <= 1:
        raise ValidationError("a fraction is over 0 and at most 1")
    n = cloud.nonempty().n
    return cloud.with_df(exact_sample(cloud.df, max(1, int(n * fraction)), seed))


def mean_neighbour_distance(cloud: PointFrame, k: int) -> DataFrame:
    """(pid, mean_d): mean distance to the k nearest others. Self is a neighbour at distance 0, of rank 1 but for coincident points."""
    near = nearest_k(cloud.df, cloud.df, k + 1)
    return near.groupBy(F.col("a_pid").alias("pid")).agg((F.sum(F.sqrt("d2")) / k).alias("mean_d"))


def statistical_outlier_removal(cloud: PointFrame, nb_neighbors: int = 20, std_ratio: float = 2.0) -> tuple[PointFrame, DataFrame]:
    """Points whose mean distance to their neighbours is at most mean + ratio * population deviation of all; and (pid, keep)."""
    if nb_neighbors < 1 or std_ratio <= 0:
        raise ValidationError("neighbours and ratio are positive")
    if nb_neighbors >= cloud.nonempty().n:
        raise ValidationError("fewer points than neighbours")
    from terracell.plans.durable import durable

    d = durable(mean_neighbour_distance(cloud, nb_neighbors))
    whole = d.agg(F.avg("mean_d").alias("m"), F.stddev_pop("mean_d").alias("s")).first()
    mask = d.select("pid", (F.col("mean_d") <= F.lit(whole.m + std_ratio * whole.s)).alias("keep"))
    return cloud.with_df(cloud.df.join(mask.where("keep"), "pid", "left_semi")), mask


def radius_outlier_removal(cloud: PointFrame, radius: float, min_neighbors: int = 2) -> tuple[PointFrame, DataFrame]:
    """Points with ``min_neighbors`` others within the radius, bound included; and (pid, neighbours, keep)."""
    if radius <= 0 or min_neighbors < 1:
        raise ValidationError("radius and neighbours are positive")
    cloud.nonempty()
    counts = radius_pairs(cloud.df, cloud.df, radius).groupBy(F.col("a_pid").alias("pid")).agg((F.count("*") - 1).alias("neighbours"))
    mask = counts.withColumn("keep", F.col("neighbours") >= min_neighbors)
    return cloud.with_df(cloud.df.join(mask.where("keep"), "pid", "left_semi")), mask
