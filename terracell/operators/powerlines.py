"""Power lines: heights above ground, wires, pylons, catenaries and clearance."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terracell.errors import SegmentationError
from terracell.frame import GROUND_CLASS, PointFrame
from terracell.operators.cluster import cluster_dbscan
from terracell.operators.raster import idw_interpolate
from terracell.operators.shape import knn_features
from terracell.plans.durable import durable
from terracell.plans.neighbours import nearest_within

WIRE_EPS, WIRE_MIN, PYLON_EPS, PYLON_MIN, VERTICALITY = 3.0, 5, 5.0, 3, 0.6


@dataclass(frozen=True)
class PowerLines:
    """points: pid, hag, wire, pylon, segment_id, violation; segments and pylons: one row each."""

    points: DataFrame
    segments: DataFrame
    pylons: DataFrame


def height_above_ground(cloud: DataFrame, ground: DataFrame, k: int = 3) -> DataFrame:
    """(pid, hag): z over ground interpolated, by inverse distance, from the k nearest ground points in the plane.

    A triangulation of all ground would need one task; this needs none, equals it
    on level ground, and hits ground points exactly.
    """
    surface = idw_interpolate(cloud.select("pid", "x", "y"), ground, k=k, keep=("pid",))
    return cloud.select("pid", "z").join(surface, "pid").select("pid", (F.col("z") - F.col("value")).alias("hag"))


def fit_catenary(t: np.ndarray, z: np.ndarray, rounds: int = 100) -> tuple[float, float, float, float]:
    """(a, x0, z0, rmse) of z = a cosh((t - x0) / a) + z0, by Levenberg-Marquardt; rmse is infinite if it fails."""
    if len(t) < 5:
        return float("nan"), float("nan"), float("nan"), float("inf")

    def model(p):
        u = np.clip((t - p[1]) / p[0], -50, 50)
        return p[0] * np.cosh(u) + p[2], u

    def error(p):
        with np.errstate(all="ignore"):
            r = model(p)[0] - z
            return r, float(r @ r)

    a = max(float(np.ptp(t)), 1.0)
    p, damp = np.array([a, float(np.median(t)), float(z.min()) - a]), 1e-3
    r, cost = error(p)
    for _ in range(rounds):
        u = model(p)[1]
        j = np.column_stack([np.cosh(u) - u * np.sinh(u), -np.sinh(u), np.ones(len(t))])
        g, h = j.T @ r, j.T @ j
        try:
            step = np.linalg.solve(h + damp * np.diag(np.diag(h) + 1e-12), -g)
        except np.linalg.LinAlgError:
            break
        new = p + step
        if new[0] > 1e-6 and (got := error(new))[1] < cost:
            small = cost - got[1] < 1e-12 * (1 + cost)
            p, (r, cost), damp = new, got, damp / 3
            if small:
                break
        else:
            damp *= 4
            if damp > 1e12:
                break
    rmse = float(np.sqrt(cost / len(t)))
    return (*map(float, p), rmse) if np.isfinite(rmse) else (float("nan"), float("nan"), float("nan"), float("inf"))


def _catenaries(wires: DataFrame) -> DataFrame:
    """(segment_id, a, x0, z0, rmse): one wire, a cluster of bounded extent, is one task's group."""

    def one(key, w: pd.DataFrame) -> pd.DataFrame:
        xy = w[["x", "y"]].to_numpy(float)
        centred = xy - xy.mean(0)
        axis = np.linalg.eigh(centred.T @ centred)[1][:, 1]
        axis = axis if axis[np.abs(axis).argmax()] > 0 else -axis
        return pd.DataFrame([(key[0], *fit_catenary(centred @ axis, w.z.to_numpy(float)))], columns=["segment_id", "a", "x0", "z0", "rmse"])

    return wires.groupBy("segment_id").applyInPandas(one, "segment_id int, a double, x0 double, z0 double, rmse double")


def _ends(wires: DataFrame) -> DataFrame:
    """(segment_id, both ends' x and y): extremes along the principal XY axis, in closed form."""
    axis = wires.groupBy("segment_id").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.covar_pop("x", "x").alias("cxx"), F.covar_pop("x", "y").alias("cxy"), F.covar_pop("y", "y").alias("cyy"))
    angle = F.atan2(2 * F.col("cxy"), F.col("cxx") - F.col("cyy")) / 2
    t = (F.col("x") - F.col("mx")) * F.cos("angle") + (F.col("y") - F.col("my")) * F.sin("angle")
    along = wires.join(axis.withColumn("angle", angle), "segment_id").withColumn("t", t)
    at = F.struct("x", "y")
    return along.groupBy("segment_id").agg(F.min_by(at, F.struct("t", "pid")).alias("a"), F.max_by(at, F.struct("t", "pid")).alias("b"))


def detect_powerlines(
    cloud: PointFrame, min_height_above_ground: float = 3.0, max_height_above_ground: float = 50.0, linearity_threshold: float = 0.7, ground_class: int = GROUND_CLASS, catenary_fit: bool = True,
    min_clearance: float | None = None, strict: bool = True, min_wire_span: float = 50.0, max_pylon_xy_extent: float = 5.0, min_pylon_z_extent: float = 8.0, max_wire_height_std: float = 3.0, pylon_association_radius: float = 10.0,
) -> PowerLines:
    """Wires are linear, pylons upright, both in a band above ground. ``strict`` keeps only clusters of a wire's or a pylon's size, and wires that run between pylons."""
    cloud.nonempty(SegmentationError)
    cloud.require("classification", error=SegmentationError)
    if not 0 <= min_height_above_ground < max_height_above_ground or not 0 < linearity_threshold <= 1:
        raise SegmentationError("bad height band or linearity threshold")
    ground = durable(cloud.df.where(F.col("classification") == ground_class).select("pid", "x", "y", "z"))
    rest = durable(cloud.df.where(F.col("classification") != ground_class).select("pid", "x", "y", "z"))
    if len(ground.take(3)) < 3 or rest.isEmpty():
        raise SegmentationError("power lines need ground and other points")
    hag = durable(height_above_ground(rest, ground))
    band = durable(rest.join(hag, "pid").where(F.col("hag").between(min_height_above_ground, max_height_above_ground)))
    n = band.count()
    if not n:
        raise SegmentationError("no points in the height band")
    shape = knn_features(band, min(20, n))
    kinds = durable(band.join(shape, "pid").withColumns({"w": F.col("linearity") >= linearity_threshold, "p": (F.col("verticality") >= VERTICALITY) & (F.col("linearity") < linearity_threshold / 2)}))

    def clustered(flag: str, eps: float, least: int) -> DataFrame:
        own = kinds.where(flag).select("pid", "x", "y", "z", "hag")
        if own.isEmpty():
            return own.withColumn("label", F.lit(0)).limit(0)
        labels = cluster_dbscan(PointFrame(own), eps, least).where("label >= 0")
        return durable(own.join(labels, "pid"))

    wires, pylons = clustered("w", WIRE_EPS, WIRE_MIN), clustered("p", PYLON_EPS, PYLON_MIN)
    wide, tall = [F.max(c) - F.min(c) for c in "xy"], F.max("z") - F.min("z")
    stats = wires.groupBy("label").agg(F.sqrt(wide[0] * wide[0] + wide[1] * wide[1]).alias("span"), F.stddev_pop("z").alias("z_std"), F.count("*").alias("n_points"))
    towers = pylons.groupBy("label").agg(F.greatest(*wide).alias("xy_extent"), tall.alias("z_extent"), *(F.avg(c).alias(c) for c in "xyz"), F.count("*").alias("n_points"))
    if strict:
        stats = stats.where((F.col("span") >= min_wire_span) & (F.col("z_std") <= max_wire_height_std))
        towers = towers.where((F.col("xy_extent") <= max_pylon_xy_extent) & (F.col("z_extent") >= min_pylon_z_extent))
    stats, towers = durable(stats), durable(towers.withColumnRenamed("label", "pylon_id"))
    kept = durable(wires.join(stats.select("label"), "label").withColumnRenamed("label", "segment_id"))
    if strict and towers.count() >= 2:
        ends = _ends(kept)
        posts = towers.select(F.col("pylon_id").cast("long").alias("pid"), "x", "y")
        by = {k: nearest_within(ends.select("segment_id", f"{k}.x", f"{k}.y").withColumn("pid", F.col("segment_id").cast("long")), posts, pylon_association_radius, "xy").select(F.col("a_pid").cast("int").alias("segment_id")) for k in "ab"}
        held = durable(by["a"].join(by["b"], "segment_id"))
        kept = durable(kept.join(held, "segment_id", "left_semi"))
        stats = stats.join(held.withColumnRenamed("segment_id", "label"), "label", "left_semi")
    segments = stats.withColumnRenamed("label", "segment_id")
    if catenary_fit and not kept.isEmpty():
        segments = segments.join(_catenaries(kept), "segment_id", "left")
    wire = kept.select("pid", "segment_id", F.lit(True).alias("wire")) if strict else kinds.where("w").select("pid", F.lit(True).alias("wire")).join(kept.select("pid", "segment_id"), "pid", "left")
    pylon = (pylons.join(towers.select(F.col("pylon_id").alias("label")), "label") if strict else kinds.where("p")).select("pid", F.lit(True).alias("pylon"))
    points = rest.select("pid").join(hag, "pid").join(wire, "pid", "left").join(pylon, "pid", "left")
    low = F.lit(False) if min_clearance is None else F.col("wire") & (F.col("hag") < min_clearance)
    points = points.na.fill(False, ["wire", "pylon"]).withColumn("violation", low)
    return PowerLines(points.select("pid", "hag", "wire", "pylon", "segment_id", "violation"), segments, towers)
