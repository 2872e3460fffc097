"""Normals and per-point shape descriptors, from moments of neighbourhoods."""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terracell.errors import FeatureError, ValidationError
from terracell.frame import PointFrame
from terracell.functions.eigen import PAIRS, covariance, eigenvalues, least_vector, moment_sums
from terracell.plans.durable import durable
from terracell.plans.neighbours import nearest_k, radius_pairs
from terracell.plans.search import Tree
from terracell.plans.tiles import Tiling, arrays, by_tile, finite

FEATURES = ("linearity", "planarity", "sphericity", "omnivariance", "anisotropy", "eigenentropy", "curvature")


def neighbourhoods(queries: DataFrame, cloud: DataFrame, radius: float) -> DataFrame:
    """Pairs within the radius, self included."""
    return radius_pairs(queries, cloud, radius)


def moments(queries: DataFrame, cloud: DataFrame, radius: float, max_nn: int | None = None) -> DataFrame:
    """(pid, n, s_x ... s_zz) of each query's neighbourhood, self included; only the ``max_nn`` closest points (ties: lowest pid). Queries without any neighbour are missing."""
    if max_nn is None:
        return neighbourhoods(queries, cloud, radius).groupBy(F.col("a_pid").alias("pid")).agg(*moment_sums())
    names = ["n", *(f"s_{c}" for c in "xyz"), *(f"s_{p}" for p in PAIRS)]
    asked, given = (d.where(finite("xyz")).select("pid", *(F.col(c).cast("double").alias(c) for c in "xyz")) for d in (queries, cloud))
    ddl = "pid long, n long, " + ", ".join(f"{n} double" for n in names[1:])
    done, reach = cloud.sparkSession.createDataFrame([], ddl), min(radius, spacing(given, max_nn))
    while True:
        tiling = Tiling.of(asked.unionAll(given), "xyz", reach * (1 + 1e-9))
        if tiling is None:
            return done
        left, right = tiling.home(asked).withColumn("side", F.lit(0)), tiling.dealt(given).withColumn("side", F.lit(1))
        found = durable(by_tile(left.unionAll(right), partial(_moments, max_nn=max_nn, reach=reach, last=reach >= radius, names=names), ddl + ", x double, y double, z double"))
        done = done.unionByName(found.where("x is null").drop("x", "y", "z"))
        asked = found.where("x is not null").select("pid", "x", "y", "z")
        if reach >= radius or asked.isEmpty():
            return done
        reach = min(radius, 3 * reach)


def _moments(tile: int, rows: pa.Table, max_nn: int, reach: float, last: bool, names: list[str]) -> pa.Table:
    """Moments of the tile's queries and, with their place, those of which more may lie beyond reach."""
    own = rows.column("side").to_numpy() == 0
    q, p = (rows.filter(pa.array(k)) for k in (own, ~own))
    pid, x = q.column("pid").to_numpy(), arrays(q, ["x", "y", "z"])
    parts, short = [[np.zeros(0, np.int64)] * 2 + [np.zeros(0)] * (len(names) - 1)], np.ones(len(pid), bool)
    if len(q) and len(p):
        tree = Tree(arrays(p, ["x", "y", "z"]), p.column("pid").to_numpy())
        for some, which, point, _ in tree.closest(x, max_nn, reach):
            n = np.bincount(which, minlength=len(some))
            full = n > 0 if last else n == max_nn
            d = tree.p[point] - x[some][which]
            sums = [np.bincount(which, v, minlength=len(some))[full] for v in (*d.T, *(d[:, "xyz".index(a)] * d[:, "xyz".index(b)] for a, b in PAIRS))]
            parts.append([pid[some[full]], n[full], *sums])
            short[some[full]] = False
    out = dict(zip(["pid", *names], (np.concatenate(v) for v in zip(*parts, strict=True)), strict=True))
    table = pa.table({**out, **{c: pa.nulls(len(out["pid"]), pa.float64()) for c in "xyz"}})
    if last or not short.any():
        return table
    left = pa.table({"pid": pid[short], **{c: x[short, k] for k, c in enumerate("xyz")}})
    return pa.concat_tables([table, left.select(["pid", *"xyz"])], promote_options="default")


def spacing(cloud: DataFrame, k: int) -> float:
    """About how far the k-th nearest of evenly spread points would be."""
    ends = cloud.agg(F.count("*").alias("n"), *(f(c) for c in "xyz" for f in (F.min, F.max))).first()
    if not ends.n:
        return math.inf
    sides = [max(ends[2 * k + 2] - ends[2 * k + 1], 0.0) for k in range(3)]
    flat = [s for s in sides if s > 1e-6 * max(sides)]
    return (math.prod(flat) * k / ends.n) ** (1 / len(flat)) if flat else math.inf


def auto_radius(cloud: PointFrame) -> float:
    """Twice the mean distance to the nearest other point."""
    near = nearest_k(cloud.df, cloud.df, 2).where("n = 2")
    return 2 * near.agg(F.avg(F.sqrt("d2"))).first()[0]


def normals_at(queries: DataFrame, cloud: DataFrame, radius: float, max_nn: int | None = None) -> DataFrame:
    """(pid, n, nx, ny, nz) by PCA; queries without any neighbour are missing. Under three neighbours: (0, 0, 1)."""
    sums = moments(queries, cloud, radius, max_nn)
    found = least_vector(eigenvalues(covariance(sums), clamp=False))
    few = F.col("n") < 3
    return found.select("pid", "n", F.when(few, 0.0).otherwise(F.col("nx")).alias("nx"), F.when(few, 0.0).otherwise(F.col("ny")).alias("ny"), F.when(few, 1.0).otherwise(F.col("nz")).alias("nz"))


def estimate_normals(cloud: PointFrame, radius: float | None = None, max_nn: int = 30) -> PointFrame:
    """Adds unit normals, their largest component positive."""
    if max_nn < 3 or cloud.nonempty().n < 3:
        raise ValidationError("normals need three points and three neighbours")
    if radius is not None and radius <= 0:
        raise ValidationError("the radius is positive")
    found = normals_at(cloud.df, cloud.df, radius or auto_radius(cloud), max_nn)
    return cloud.with_df(cloud.df.drop("nx", "ny", "nz").join(found.drop("n"), "pid"))


def orient_normals_to_viewpoint(cloud: PointFrame, viewpoint: tuple[float, float, float]) -> PointFrame:
    """Flips normals that point away from the viewpoint."""
    cloud.require("nx", "ny", "nz")
    if len(viewpoint) != 3:
        raise ValidationError("a viewpoint has three coordinates")
    toward = sum((F.col(f"n{c}") * (F.lit(float(v)) - F.col(c)) for c, v in list(zip("xyz", viewpoint, strict=True))[1:]), F.col("nx") * (F.lit(float(viewpoint[0])) - F.col("x")))
    df = cloud.df.withColumn("_away", toward < 0)
    return cloud.with_df(df.withColumns({f"n{c}": F.when(F.col("_away"), -F.col(f"n{c}")).otherwise(F.col(f"n{c}")) for c in "xyz"}).drop("_away"))


def geometric_features(cloud: PointFrame, radius: float, max_nn: int | None = 30) -> DataFrame:
    """(pid, n, FEATURES): eigenvalue shape descriptors; all 0 under three neighbours or without extent."""
    if radius <= 0:
        raise ValidationError("the radius is positive")
    if cloud.nonempty(FeatureError).n < 3:
        raise FeatureError("features need three points")
    sums = moments(cloud.df, cloud.df, radius, max_nn)
    df = eigenvalues(covariance(sums))
    l1, l2, l3 = (F.col(k) for k in ("l1", "l2", "l3"))
    total = l1 + l2 + l3

    def entropy(v):
        p = v / total
        return F.when(p > 1e-12, -p * F.ln(p)).otherwise(0.0)

    formulas = {
        "linearity": (l1 - l2) / l1,
        "planarity": (l2 - l3) / l1,
        "sphericity": l3 / l1,
        "omnivariance": F.cbrt(l1 * l2 * l3),
        "anisotropy": (l1 - l3) / l1,
        "eigenentropy": entropy(l1) + entropy(l2) + entropy(l3),
        "curvature": l3 / total,
    }
    usable = (F.col("n") >= 3) & (l1 >= 1e-12)
    return df.select("pid", "n", *(F.when(usable, e).otherwise(0.0).alias(k) for k, e in formulas.items()))


def knn_features(cloud: DataFrame, k: int = 20) -> DataFrame:
    """(pid, linearity, planarity, sphericity, verticality) over the k nearest, self included, by sample covariance."""
    sums = nearest_k(cloud, cloud, k).groupBy(F.col("a_pid").alias("pid")).agg(*moment_sums())
    df = least_vector(eigenvalues(covariance(sums, sample=True), clamp=False))
    l1, usable = F.col("l1"), F.col("l1") > 1e-12
    return df.select(
        "pid",
        F.when(usable, (l1 - F.col("l2")) / l1).otherwise(0.0).alias("linearity"),
        F.when(usable, (F.col("l2") - F.col("l3")) / l1).otherwise(0.0).alias("planarity"),
        F.when(usable, F.col("l3") / l1).otherwise(0.0).alias("sphericity"),
        (1 - F.abs("nz")).alias("verticality"),
    )
