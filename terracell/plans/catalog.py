"""Registered queries of the point-cloud operators and the SQL that checks them.

The tables hold no clouds, so points are arithmetic on the orders table, written
once and run by both engines. Every query covers all points.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terracell.frame import Acquisition, PointFrame, ScanPosition
from terracell.functions import crs
from terracell.operators import change, cluster, colour, export, filters, ground, mesh, metrics, model, powerlines, primitives, raster, registration, shape, tiling
from terracell.plans.durable import shared_folder
from terracell.plans.grid import GridSpec
from terracell.plans.neighbours import nearest_k, nearest_within, radius_pairs
from terracell.sources import formats
from terracell.streaming import ingest

VIEW = """
SELECT o_orderkey AS pid,
  CAST((o_orderkey * 7919) % 10007 AS DOUBLE) / 100.0 AS x,
  CAST((o_orderkey * 104729) % 10009 AS DOUBLE) / 100.0 AS y,
  CAST((o_orderkey * 7919) % 10007 AS DOUBLE) / 2000.0
    + CASE WHEN o_orderkey % 3 = 0 THEN CAST((o_orderkey * 31) % 1700 AS DOUBLE) / 100.0
           ELSE CAST(o_orderkey % 10 AS DOUBLE) / 100.0 END AS z,
  o_totalprice / 1000.0 AS intensity,
  CAST(CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 2 END AS SMALLINT) AS classification,
  CAST(1 + o_orderkey % 3 AS SMALLINT) AS return_number
FROM orders"""
P = f"p AS ({VIEW})"
BOUNDS = "b AS (SELECT count(*) AS n, min(x) AS x0, min(y) AS y0, min(z) AS z0, max(x) AS x1, max(y) AS y1, max(z) AS z1 FROM p)"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
FLAGSHIP = "g1_geometric_features"


def points(spark: SparkSession, sf_dir: str, platform: str = "aerial") -> PointFrame:
    df = spark.sql(VIEW.replace("FROM orders", "FROM {orders}"), orders=spark.read.parquet(f"{sf_dir}/orders.parquet"))
    return PointFrame(df, Acquisition(platform=platform))


def second_epoch(cloud: PointFrame) -> PointFrame:
    """The cloud with every fourth point raised by one half."""
    return cloud.with_df(cloud.df.withColumn("z", F.col("z") + F.when(F.col("pid") % 4 == 0, 0.5).otherwise(0.0)))


def query(name: str, sql: str | None = None, given: Callable = points):
    """Register a function of a cloud (or of what ``given`` loads)."""

    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(given(spark, sf_dir))
        if sql:
            ORACLE[name] = sql
        return f

    return add


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n), digits) + F.lit(0.0) for n in names})


def r(e: str, name: str, digits: int = 6) -> str:
    return f"round({e}, {digits}) + 0.0 AS {name}"


def cells(res: float) -> str:
    """SQL: each point's row and col as GridSpec.edges_of places them, over (p, b)."""

    def at(axis: str) -> str:
        n = f"greatest(1, CAST(ceil(({axis}1 + {res} - {axis}0) / {res}) AS BIGINT) - 1)"
        return f"greatest(0, least({n} - 1, CAST(floor(({axis} - {axis}0) / {res}) AS BIGINT)))"

    return f"{at('y')} AS row, {at('x')} AS col"


def grid_size(res: float) -> str:
    return "g AS (SELECT " + ", ".join(f"greatest(1, CAST(ceil(({a}1 + {res} - {a}0) / {res}) AS BIGINT) - 1) AS n{a} FROM b" if a == "y" else f"greatest(1, CAST(ceil(({a}1 + {res} - {a}0) / {res}) AS BIGINT) - 1) AS n{a}" for a in "xy") + ")"


def dense_cells() -> str:
    return "d AS (SELECT t.row AS row, s.col AS col FROM (SELECT unnest(range(ny)) AS row FROM g) t, (SELECT unnest(range(nx)) AS col FROM g) s)"


def near(radius: float, axes: str = "xyz", a: str = "p", b: str = "p") -> str:
    """SQL: pairs ap, bp within a radius, with d2 and offsets."""
    d2 = " + ".join(f"(b.{c} - a.{c}) * (b.{c} - a.{c})" for c in axes)
    box = " AND ".join(f"b.{c} BETWEEN a.{c} - {radius * 1.000001} AND a.{c} + {radius * 1.000001}" for c in axes[:2])
    return f"(SELECT a.pid AS ap, b.pid AS bp, {d2} AS d2, " + ", ".join(f"b.{c} - a.{c} AS d{c}" for c in axes) + f" FROM {a} a JOIN {b} b ON {box} WHERE {d2} <= {radius * radius})"


# ---- filters and projections

@query("f1_crop", f"WITH {P} SELECT pid, x, y, z FROM p WHERE x BETWEEN 20 AND 60 AND y BETWEEN 10 AND 70 AND z BETWEEN 0.5 AND 12")
def _(c):
    return filters.crop(c, (20, 10, 0.5, 60, 70, 12)).df.select("pid", "x", "y", "z")


VOXEL = "CAST(floor((x - x0) / 4.0) AS BIGINT), CAST(floor((y - y0) / 4.0) AS BIGINT), CAST(floor((z - z0) / 4.0) AS BIGINT)"


@query("f2_voxel_downsample", f"WITH {P}, {BOUNDS} SELECT min(pid) AS pid, arg_min(x, pid) AS x, arg_min(z, pid) AS z FROM p, b GROUP BY {VOXEL}")
def _(c):
    return filters.voxel_downsample(c, 4.0).df.select("pid", "x", "z")


@query("f2_voxel_centroid", f"WITH {P}, {BOUNDS} SELECT min(pid) AS pid, {r('avg(x)', 'x', 10)}, {r('avg(y)', 'y', 10)}, {r('avg(z)', 'z', 10)} FROM p, b GROUP BY {VOXEL}")
def _(c):
    return rounded(filters.voxel_downsample(c, 4.0, "centroid").df.select("pid", "x", "y", "z"), "x", "y", "z", digits=10)


@query("f3_random_downsample_count", f"WITH {P} SELECT greatest(1, CAST(floor(count(*) * 0.25) AS BIGINT)) AS n, CAST(0 AS BIGINT) AS strangers FROM p")
def _(c):
    out = filters.random_downsample(c, 0.25, seed=3).df
    return out.join(c.df.select("pid", F.lit(1).alias("known")), "pid", "left").agg(F.count("*").alias("n"), F.count(F.when(F.col("known").isNull(), 1)).alias("strangers"))


KNN = 6


@query("f4_statistical_outlier_removal", f"""WITH {P}, q AS {near(9)}, k AS (SELECT ap, d2, row_number() OVER (PARTITION BY ap ORDER BY d2, bp) AS n FROM q),
m AS (SELECT ap, sum(sqrt(d2)) / {KNN} AS d FROM k WHERE n <= {KNN + 1} GROUP BY ap), t AS (SELECT avg(d) + 2.0 * stddev_pop(d) AS top FROM m)
SELECT ap AS pid, d <= top AS keep FROM m, t""")
def _(c):
    return filters.statistical_outlier_removal(c, KNN, 2.0)[1]


@query("f5_radius_outlier_removal", f"WITH {P} SELECT ap AS pid, count(*) - 1 AS neighbours, count(*) - 1 >= 4 AS keep FROM {near(1.5)} GROUP BY ap")
def _(c):
    return filters.radius_outlier_removal(c, 1.5, 4)[1]


@query("f7_ground_points", f"WITH {P} SELECT pid, z FROM p WHERE classification = 2")
def _(c):
    return c.ground_points().df.select("pid", "z")


@query("f8_first_returns", f"WITH {P} SELECT pid, return_number FROM p WHERE return_number = 1")
def _(c):
    return c.first_returns().df.select("pid", "return_number")


@query("f9_viewpoint_mask")
def _(c):
    return mesh.viewpoint_mask(PointFrame(c.df, Acquisition(scan_positions=(ScanPosition(50, 50, 60),))))


@query("f10_reproject_mercator", f"""WITH {P} SELECT pid, {r('6378137.0 * radians(x / 10)', 'x', 4)}, {r('6378137.0 * ln(tan(pi() / 4 + radians(y / 10) / 2))', 'y', 4)}, z FROM p""")
def _(c):
    df = c.df.select("pid", (F.col("x") / 10).alias("x"), (F.col("y") / 10).alias("y"), "z")
    return rounded(crs.transform_coordinates(df, "EPSG:4326", "EPSG:3857"), "x", "y", digits=4)


@query("f10_reproject_utm_round_trip", f"WITH {P} SELECT pid, {r('x / 20', 'x')}, {r('y / 2', 'y')} FROM p")
def _(c):
    df = c.df.select("pid", (F.col("x") / 20).alias("x"), (F.col("y") / 2).alias("y"))
    there = crs.transform_coordinates(df, "EPSG:4326", "EPSG:32631")
    return rounded(crs.transform_coordinates(there, "EPSG:32631", "EPSG:4326"), "x", "y")


@query("f11_colorize", f"""WITH {P}, q AS (SELECT pid, CAST(floor(x / 2.5) AS BIGINT) AS c, CAST(floor((y - 80.0) / -2.5) AS BIGINT) AS r FROM p)
SELECT pid, CAST(CASE WHEN c BETWEEN 0 AND 31 AND r BETWEEN 0 AND 31 THEN (7 * r + c) % 256 ELSE 9 END AS SMALLINT) AS red,
CAST(CASE WHEN c BETWEEN 0 AND 31 AND r BETWEEN 0 AND 31 THEN (r + 5 * c) % 256 ELSE 8 END AS SMALLINT) AS green,
CAST(CASE WHEN c BETWEEN 0 AND 31 AND r BETWEEN 0 AND 31 THEN (r * c) % 256 ELSE 7 END AS SMALLINT) AS blue FROM q""")
def _(c):
    rows, cols = np.indices((32, 32))
    image = np.stack([(7 * rows + cols) % 256, (rows + 5 * cols) % 256, (rows * cols) % 256], -1)
    return colour.colorize_from_array(c, image, (2.5, 0, 0, 0, -2.5, 80), (9, 8, 7)).df.select("pid", "red", "green", "blue")


# ---- spatial joins

@query("j1_radius_join", f"WITH {P} SELECT ap AS pid, count(*) AS n, {r('sum(sqrt(d2))', 'total')} FROM {near(1.5)} GROUP BY ap")
def _(c):
    pairs = radius_pairs(c.df, c.df, 1.5)
    return rounded(pairs.groupBy(F.col("a_pid").alias("pid")).agg(F.count("*").alias("n"), F.sum(F.sqrt("d2")).alias("total")), "total")


@query("j2_knn_join", f"WITH {P}, k AS (SELECT ap, bp, d2, row_number() OVER (PARTITION BY ap ORDER BY d2, bp) AS n FROM {near(9)}) SELECT ap AS pid, bp AS neighbour, CAST(n AS INTEGER) AS n, {r('d2', 'd2')} FROM k WHERE n <= 4")
def _(c):
    return rounded(nearest_k(c.df, c.df, 4).select(F.col("a_pid").alias("pid"), F.col("b_pid").alias("neighbour"), "n", "d2"), "d2")


@query("j3_nearest_within", f"""WITH {P}, u AS (SELECT * FROM p WHERE classification = 1), v AS (SELECT * FROM p WHERE classification = 2),
k AS (SELECT ap, bp, d2, row_number() OVER (PARTITION BY ap ORDER BY d2, bp) AS n FROM {near(3, 'xyz', 'u', 'v')}) SELECT ap AS pid, bp AS neighbour, {r('d2', 'd2')} FROM k WHERE n = 1""")
def _(c):
    found = nearest_within(c.df.where("classification = 1"), c.df.where("classification = 2"), 3.0)
    return rounded(found.select(F.col("a_pid").alias("pid"), F.col("b_pid").alias("neighbour"), "d2"), "d2")


def embeddings(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("pid"), F.col("embedding").cast("array<double>").alias("fpfh"), (F.col("vec_id") % 5 == 0).alias("target"))


@query("j4_descriptor_match", f"""WITH e AS (SELECT vec_id AS pid, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
k AS (SELECT a.pid AS pid, b.pid AS m, list_distance(a.v, b.v) AS d FROM e a, e b WHERE a.pid % 5 <> 0 AND b.pid % 5 = 0)
SELECT pid, arg_min(m, (d, m)) AS match, {r('min(d)', 'd')} FROM k GROUP BY pid""", embeddings)
def _(e):
    found = registration.match_descriptors(e.where("not target"), e.where("target"))
    return rounded(found.select("pid", "match", F.sqrt("d2").alias("d")), "d")


@query("j7_polyline_distance", f"""WITH {P}, s AS (SELECT * FROM (VALUES (0, 10.0, 10.0, 70.0, 40.0, 0.0), (1, 80.0, 50.0, -20.0, 45.0, 80.622577)) s(i, ax, ay, dx, dy, f)),
k AS (SELECT pid, i, greatest(0.0, least(1.0, ((x - ax) * dx + (y - ay) * dy) / (dx * dx + dy * dy))) AS t, ax, ay, dx, dy, x, y FROM p, s),
q AS (SELECT pid, i, sqrt((x - ax - t * dx) * (x - ax - t * dx) + (y - ay - t * dy) * (y - ay - t * dy)) AS d FROM k)
SELECT pid, {r('min(d)', 'd')} FROM q WHERE d <= 5.0 GROUP BY pid""")
def _(c):
    lines = change.polyline_segments([(10, 10), (80, 50), (60, 95)])
    near_ = change._stationed(c.df, c.df.sparkSession.createDataFrame(lines, change._SEGMENT), 5.0)
    joined = near_.join(c.df.select("pid", "x", "y"), "pid")
    best = None
    for _, ax, ay, dx, dy, l2, _ in lines:
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((F.col("x") - ax) * dx + (F.col("y") - ay) * dy) / l2))
        d = F.sqrt((F.col("x") - ax - t * dx) * (F.col("x") - ax - t * dx) + (F.col("y") - ay - t * dy) * (F.col("y") - ay - t * dy))
        best = d if best is None else F.least(best, d)
    return rounded(joined.select("pid", best.alias("d")), "d")


# ---- normals and features

MOMENTS = f"""m AS (SELECT ap AS pid, count(*) AS n, sum(dx) AS sx, sum(dy) AS sy, sum(dz) AS sz, sum(dx*dx) AS sxx, sum(dx*dy) AS sxy, sum(dx*dz) AS sxz,
sum(dy*dy) AS syy, sum(dy*dz) AS syz, sum(dz*dz) AS szz FROM {near(2)} GROUP BY ap),
c AS (SELECT pid, n, sxx/n-sx/n*sx/n AS xx, sxy/n-sx/n*sy/n AS xy, sxz/n-sx/n*sz/n AS xz, syy/n-sy/n*sy/n AS yy, syz/n-sy/n*sz/n AS yz, szz/n-sz/n*sz/n AS zz FROM m),
c1 AS (SELECT *, (xx+yy+zz)/3 AS q FROM c), c2 AS (SELECT *, sqrt(((xx-q)*(xx-q)+(yy-q)*(yy-q)+(zz-q)*(zz-q)+2*(xy*xy+xz*xz+yz*yz))/6) AS pp FROM c1),
c3 AS (SELECT *, CASE WHEN pp > 1e-150 THEN ((xx-q)*((yy-q)*(zz-q)-yz*yz)-xy*(xy*(zz-q)-yz*xz)+xz*(xy*yz-(yy-q)*xz))/(2*pp*pp*pp) ELSE 0 END AS h FROM c2),
c4 AS (SELECT *, acos(greatest(-1.0, least(1.0, h)))/3 AS phi FROM c3),
e AS (SELECT *, q+2*pp*cos(phi) AS e1, q+2*pp*cos(phi+2*pi()/3) AS e3 FROM c4)"""
FEATURE_SQL = f"""WITH {P}, {MOMENTS}, l AS (SELECT pid, n, greatest(e1, 0.0) AS a, greatest(3*q-e1-e3, 0.0) AS b, greatest(e3, 0.0) AS c FROM e),
f AS (SELECT *, n >= 3 AND a >= 1e-12 AS ok, a+b+c AS s FROM l)
SELECT pid, n, {r('CASE WHEN ok THEN (a-b)/a ELSE 0.0 END', 'linearity')}, {r('CASE WHEN ok THEN (b-c)/a ELSE 0.0 END', 'planarity')}, {r('CASE WHEN ok THEN c/a ELSE 0.0 END', 'sphericity')},
{r('CASE WHEN ok THEN (a-c)/a ELSE 0.0 END', 'anisotropy')}, {r('CASE WHEN ok THEN c/s ELSE 0.0 END', 'curvature')} FROM f"""


@query("g1_geometric_features", FEATURE_SQL)
def _(c):
    names = ("linearity", "planarity", "sphericity", "anisotropy", "curvature")
    return rounded(shape.geometric_features(c, 2.0, None).select("pid", "n", *names), *names)


@query("n1_estimate_normals", f"""WITH {P}, {MOMENTS}, v AS (SELECT pid, n, e3, e1, 3*q-e1-e3 AS e2, (xy*yz-xz*(yy-e3)) AS ax, (xz*xy-(xx-e3)*yz) AS ay, ((xx-e3)*(yy-e3)-xy*xy) AS az, (xy*(zz-e3)-xz*yz) AS bx, (xz*xz-(xx-e3)*(zz-e3)) AS by_, ((xx-e3)*yz-xy*xz) AS bz,
((yy-e3)*(zz-e3)-yz*yz) AS cx, (yz*xz-xy*(zz-e3)) AS cy, (xy*yz-(yy-e3)*xz) AS cz FROM e),
w AS (SELECT *, ax*ax+ay*ay+az*az AS la, bx*bx+by_*by_+bz*bz AS lb, cx*cx+cy*cy+cz*cz AS lc FROM v),
u AS (SELECT pid, CASE WHEN la >= lb AND la >= lc THEN abs(az)/sqrt(la) WHEN lb >= lc THEN abs(bz)/sqrt(lb) ELSE abs(cz)/sqrt(lc) END AS nz FROM w WHERE greatest(la, lb, lc) > 0),
f AS (SELECT pid, n, n >= 5 AND e2 - e3 > 0.01 * e1 AS clear FROM v)
SELECT f.pid AS pid, f.n AS n, clear, CASE WHEN f.n < 3 THEN 1.0 WHEN clear THEN round(nz, 5) + 0.0 END AS upright FROM f LEFT JOIN u ON u.pid = f.pid""")
def _(c):
    # Every point; the direction itself only where it is told apart from others (clear), and where it is set (under 3 neighbours).
    df = shape.normals_at(c.df, c.df, 2.0)
    gaps = shape.eigenvalues(shape.covariance(shape.neighbourhoods(c.df, c.df, 2.0).groupBy(F.col("a_pid").alias("pid")).agg(*shape.moment_sums())), clamp=False)
    told = df.join(gaps.select("pid", ((F.col("n") >= 5) & (F.col("l2") - F.col("l3") > 0.01 * F.col("l1"))).alias("clear")), "pid")
    return rounded(told.select("pid", "n", "clear", F.when((F.col("n") < 3) | F.col("clear"), F.abs("nz")).alias("upright")), "upright", digits=5)


@query("n1_normals_of_all")
def _(c):
    return shape.normals_at(c.df, c.df, 2.0).select("pid", "nx", "ny", "nz")


@query("n2_orient_normals", f"""WITH {P}, q AS (SELECT pid, x, y, z, (pid % 7 - 3) / 5.0 AS nx, (pid % 5 - 2) / 5.0 AS ny, (pid % 3 - 1) / 5.0 AS nz FROM p),
s AS (SELECT *, CASE WHEN nx * (50.0 - x) + ny * (50.0 - y) + nz * (99.0 - z) < 0 THEN -1.0 ELSE 1.0 END AS k FROM q)
SELECT pid, {r('nx * k', 'nx')}, {r('ny * k', 'ny')}, {r('nz * k', 'nz')} FROM s""")
def _(c):
    df = c.df.withColumns({"nx": (F.col("pid") % 7 - 3) / 5.0, "ny": (F.col("pid") % 5 - 2) / 5.0, "nz": (F.col("pid") % 3 - 1) / 5.0})
    return rounded(shape.orient_normals_to_viewpoint(c.with_df(df), (50, 50, 99)).df.select("pid", "nx", "ny", "nz"), "nx", "ny", "nz")


KNN_SHAPE = f"""WITH {P}, k AS (SELECT *, row_number() OVER (PARTITION BY ap ORDER BY d2, bp) AS r FROM {near(9)}),
{MOMENTS.replace(f"FROM {near(2)} GROUP BY ap", "FROM k WHERE r <= 8 GROUP BY ap")},
l AS (SELECT pid, e1 * n / (n - 1) AS a, (3*q-e1-e3) * n / (n - 1) AS b, e3 * n / (n - 1) AS c FROM e)
SELECT pid, {r('CASE WHEN a > 1e-12 THEN (a-b)/a ELSE 0.0 END', 'linearity')}, {r('CASE WHEN a > 1e-12 THEN (b-c)/a ELSE 0.0 END', 'planarity')}, {r('CASE WHEN a > 1e-12 THEN c/a ELSE 0.0 END', 'sphericity')} FROM l"""


@query("g2_knn_features", KNN_SHAPE)
def _(c):
    return rounded(shape.knn_features(c.df, 8).drop("verticality"), "linearity", "planarity", "sphericity")


# ---- metrics

@query("m1_cloud_statistics", f"""WITH {P} SELECT count(*) AS n_points, {', '.join(f'min({a}) AS {a}_min, max({a}) AS {a}_max' for a in 'xyz')}, {', '.join(r(f'avg({a})', f'{a}_mean') for a in 'xyz')},
{r('stddev_pop(z)', 'z_std')}, {', '.join(r(f'quantile_cont(z, {q / 100})', f'z_p{q}') for q in metrics.PERCENTILES)}, {r('avg(intensity)', 'intensity_mean')}, {r('stddev_pop(intensity)', 'intensity_std')} FROM p""")
def _(c):
    df = metrics.cloud_statistics(c)
    return rounded(df, *(n for n in df.columns if n != "n_points" and not n.endswith(("_min", "_max"))))


@query("m2_point_density", f"WITH {P}, {BOUNDS}, {grid_size(3.0)}, {dense_cells()}, k AS (SELECT {cells(3.0)} FROM p, b), n AS (SELECT row, col, count(*) AS c FROM k GROUP BY ALL) SELECT d.row AS row, d.col AS col, coalesce(c, 0) AS count FROM d LEFT JOIN n USING (row, col)")
def _(c):
    return metrics.point_density(c, 3.0)


@query("m3_coverage_statistics", f"""WITH {P}, {BOUNDS}, {grid_size(0.8)}, k AS (SELECT {cells(0.8)} FROM p, b), n AS (SELECT row, col, count(*) / 0.64 AS c FROM k GROUP BY ALL)
SELECT {r('avg(c)', 'mean_density')}, {r('min(c)', 'min_density')}, {r('max(c)', 'max_density')}, {r('stddev_pop(c)', 'std_density')}, {r('1 - count(*) / CAST(any_value(nx * ny) AS DOUBLE)', 'gap_fraction')}, {r('any_value(nx * ny) * 0.64', 'total_area')}, {r('count(*) * 0.64', 'covered_area')} FROM n, g""")
def _(c):
    df = metrics.coverage_statistics(c, 0.8)
    return rounded(df, *df.columns)


@query("m4_canopy_height_model", f"""WITH {P}, {BOUNDS}, {grid_size(2.0)}, {dense_cells()}, k AS (SELECT {cells(2.0)}, z, classification FROM p, b),
n AS (SELECT row, col, min(CASE WHEN classification = 2 THEN z END) AS lo, max(CASE WHEN classification <> 2 THEN z END) AS hi FROM k GROUP BY row, col),
m AS (SELECT a.row AS row, a.col AS col, arg_min(v.lo, ((v.row-a.row)*(v.row-a.row)+(v.col-a.col)*(v.col-a.col), v.row, v.col)) AS lo FROM n a, n v WHERE a.lo IS NULL AND a.hi IS NOT NULL AND v.lo IS NOT NULL GROUP BY a.row, a.col)
SELECT d.row AS row, d.col AS col, {r('coalesce(greatest(0.0, n.hi - coalesce(n.lo, m.lo)), 0.0)', 'chm')} FROM d LEFT JOIN n USING (row, col) LEFT JOIN m USING (row, col)""")
def _(c):
    return rounded(metrics.canopy_height_model(c, 2.0), "chm")


@query("m5_bounds_centroid", f"WITH {P}, {BOUNDS} SELECT b.*, {', '.join(r(f'(SELECT avg({a}) FROM p)', f'c{a}') for a in 'xyz')} FROM b")
def _(c):
    ends = [f(a).alias(f"{a}{k}") for k, f in ((0, F.min), (1, F.max)) for a in "xyz"]
    return rounded(c.df.agg(F.count("*").alias("n"), *ends, *(F.avg(a).alias(f"c{a}") for a in "xyz")), "cx", "cy", "cz")


@query("m6_max_z", f"WITH {P}, {BOUNDS}, k AS (SELECT {cells(2.5)}, z FROM p, b) SELECT row, col, max(z) AS value FROM k GROUP BY row, col")
def _(c):
    return raster.max_z(c, GridSpec.edges_of(c.bounds, 2.5, 1))


@query("m7_mean_z", f"WITH {P}, {BOUNDS}, k AS (SELECT {cells(2.5)}, z FROM p, b) SELECT row, col, {r('avg(z)', 'value', 10)} FROM k GROUP BY row, col")
def _(c):
    return rounded(change.mean_z(c, GridSpec.edges_of(c.bounds, 2.5, 1), "value"), "value", digits=10)


@query("m8_segment_sizes", f"WITH {P} SELECT CAST(pid % 11 - 1 AS INTEGER) AS label, count(*) AS size FROM p WHERE pid % 11 >= 1 GROUP BY ALL")
def _(c):
    return metrics.segment_sizes(c.df.select("pid", (F.col("pid") % 11 - 1).cast("int").alias("label")))


# ---- rasters

CENTRES = "s AS (SELECT row, col, x0 + col * {0} + {0} / 2 AS x, y0 + row * {0} + {0} / 2 AS y FROM d, b)"


def idw_sql(targets: str, source: str = "p", k: int = 12) -> str:
    return f"""k AS (SELECT t.row AS row, t.col AS col, p.pid AS pid, p.z AS z, (p.x-t.x)*(p.x-t.x)+(p.y-t.y)*(p.y-t.y) AS d2 FROM {targets} t JOIN {source} p ON p.x BETWEEN t.x - 9 AND t.x + 9 AND p.y BETWEEN t.y - 9 AND t.y + 9),
i AS (SELECT *, row_number() OVER (PARTITION BY row, col ORDER BY d2, pid) AS n FROM k),
v AS (SELECT row, col, CASE WHEN min(d2) = 0 THEN arg_min(z, (d2, pid)) ELSE sum(CASE WHEN d2 > 0 THEN z / d2 END) / sum(CASE WHEN d2 > 0 THEN 1 / d2 END) END AS value FROM i WHERE n <= {k} GROUP BY row, col)"""


@query("r1_idw_interpolate", f"WITH {P}, {BOUNDS}, {grid_size(3.0)}, {dense_cells()}, {CENTRES.format(3.0)}, {idw_sql('s')} SELECT row, col, {r('value', 'value')} FROM v")
def _(c):
    grid = GridSpec.edges_of(c.bounds, 3.0)
    return rounded(raster.idw_interpolate(grid.centres(grid.dense(c.df.sparkSession)), c.df), "value")


@query("r2_nearest_interpolate", f"""WITH {P}, {BOUNDS}, {grid_size(3.0)}, {dense_cells()}, {CENTRES.format(3.0)},
k AS (SELECT t.row AS row, t.col AS col, arg_min(p.z, ((p.x-t.x)*(p.x-t.x)+(p.y-t.y)*(p.y-t.y), p.pid)) AS z, min((p.x-t.x)*(p.x-t.x)+(p.y-t.y)*(p.y-t.y)) AS d2 FROM s t JOIN p ON p.x BETWEEN t.x - 9 AND t.x + 9 AND p.y BETWEEN t.y - 9 AND t.y + 9 GROUP BY t.row, t.col)
SELECT row, col, {r('CASE WHEN d2 <= 0.25 THEN z ELSE -9999.0 END', 'value')} FROM k""")
def _(c):
    grid = GridSpec.edges_of(c.bounds, 3.0)
    return rounded(raster.nearest_interpolate(grid.centres(grid.dense(c.df.sparkSession)), c.df, 0.5), "value")


@query("r3_create_dsm", f"""WITH {P}, {BOUNDS}, {grid_size(1.5)}, {dense_cells()}, {CENTRES.format(1.5)}, q AS (SELECT {cells(1.5)}, z FROM p, b), m AS (SELECT row, col, max(z) AS top FROM q GROUP BY row, col),
h AS (SELECT s.* FROM s LEFT JOIN m USING (row, col) WHERE top IS NULL), {idw_sql('h')} SELECT row, col, {r('top', 'value')} FROM m UNION ALL SELECT row, col, {r('value', 'value')} FROM v""")
def _(c):
    return rounded(raster.create_dsm(c, 1.5).df, "value")


@query("r4_create_dtm", f"WITH {P}, u AS (SELECT * FROM p WHERE classification = 2), {BOUNDS}, {grid_size(3.0)}, {dense_cells()}, {CENTRES.format(3.0)}, {idw_sql('s', 'u')} SELECT row, col, {r('value', 'value')} FROM v")
def _(c):
    return rounded(raster.create_dtm(c, 3.0).df, "value")


@query("r8_node_dem", f"""WITH {P}, {BOUNDS}, g AS (SELECT greatest(2, CAST(ceil((x1 - x0) / 4.0) AS BIGINT) + 1) AS nx, greatest(2, CAST(ceil((y1 - y0) / 4.0) AS BIGINT) + 1) AS ny FROM b), {dense_cells()},
s AS (SELECT row, col, x0 + col * 4.0 AS x, y0 + row * 4.0 AS y FROM d, b),
k AS (SELECT t.row AS row, t.col AS col, p.pid AS pid, p.z AS z, (p.x-t.x)*(p.x-t.x)+(p.y-t.y)*(p.y-t.y) AS d2 FROM s t JOIN p ON p.x BETWEEN t.x - 15 AND t.x + 15 AND p.y BETWEEN t.y - 15 AND t.y + 15),
i AS (SELECT *, row_number() OVER (PARTITION BY row, col ORDER BY d2, pid) AS n FROM k)
SELECT row, col, {r('sum(z / greatest(d2, 1e-20)) / sum(1 / greatest(d2, 1e-20))', 'value')} FROM i WHERE n <= 12 GROUP BY row, col""")
def _(c):
    return rounded(raster.node_dem(c, 4.0).df, "value")


SURFACE = f"WITH {P}, {BOUNDS}, {grid_size(10.0)}, {dense_cells()}, q AS (SELECT {cells(10.0)}, z FROM p, b), m AS (SELECT row, col, max(z) AS v FROM q GROUP BY row, col), t AS (SELECT d.row AS row, d.col AS col, coalesce(v, 0.0) AS v FROM d LEFT JOIN m USING (row, col)), e AS (SELECT max(row) AS mr, max(col) AS mc FROM t)"
AROUND = "a AS (SELECT t.row AS row, t.col AS col, mr, mc, t.v AS c, " + ", ".join(
    f"(SELECT v FROM t u WHERE u.row = least(mr, greatest(0, t.row + {dr})) AND u.col = least(mc, greatest(0, t.col + {dc}))) AS v{'msp'[dr + 1]}{'msp'[dc + 1]}" for dr in (-1, 0, 1) for dc in (-1, 0, 1)
) + " FROM t, e)"


def surface(c: PointFrame) -> raster.Raster:
    grid = GridSpec.edges_of(c.bounds, 10.0, 1)
    high = grid.dense(c.df.sparkSession).join(raster.max_z(c, grid), ["row", "col"], "left").na.fill(0.0, ["value"])
    return raster.Raster(high, grid)


@query("r9_slope_aspect", f"""{SURFACE}, {AROUND}, k AS (SELECT row, col, (vsp - vsm) / CASE WHEN col > 0 AND col < mc THEN 20.0 ELSE 10.0 END AS gx, (vps - vms) / CASE WHEN row > 0 AND row < mr THEN 20.0 ELSE 10.0 END AS gy FROM a),
w AS (SELECT row, col, degrees(atan(sqrt(gx*gx+gy*gy))) AS s, degrees(atan2(-gx, gy)) AS d FROM k) SELECT row, col, {r('s', 'slope')}, {r('CASE WHEN d < 0 THEN d + 360 ELSE d END', 'aspect')} FROM w""")
def _(c):
    return rounded(raster.slope_aspect(surface(c)), "slope", "aspect")


@query("r9_hillshade", f"""{SURFACE}, {AROUND}, k AS (SELECT row, col, ((vmp+2*vsp+vpp)-(vmm+2*vsm+vpm))/80.0 AS gx, ((vpm+2*vps+vpp)-(vmm+2*vms+vmp))/80.0 AS gy FROM a)
SELECT row, col, {r('255 * greatest(0.0, cos(radians(45.0)) * cos(atan(sqrt(gx*gx+gy*gy))) + sin(radians(45.0)) * sin(atan(sqrt(gx*gx+gy*gy))) * cos(radians(135.0) - atan2(gy, -gx)))', 'shade', 5)} FROM k""")
def _(c):
    return rounded(raster.hillshade(surface(c)), "shade", digits=5)


@query("r9_sinkholes", f"""{SURFACE}, w AS (SELECT a.row AS row, a.col AS col, a.v AS v, min(u.v) AS lo, avg(u.v) AS m FROM t a JOIN t u ON abs(a.row - u.row) <= 2 AND abs(a.col - u.col) <= 2 GROUP BY a.row, a.col, a.v)
SELECT row, col, v AS value, {r('m - v', 'depth')} FROM w WHERE v = lo AND m - v > 0.5""")
def _(c):
    return rounded(raster.sinkholes(surface(c), 0.5), "depth")


@query("r9_flood_mask", f"{SURFACE}, f AS (SELECT quantile_cont(v, 0.1) AS level FROM t) SELECT row, col, v AS value, v <= level AS flooded FROM t, f")
def _(c):
    return raster.flood_mask(surface(c), 10.0)


# ---- ground, clusters, primitives

def pmf_sql(cell: float, top: int) -> str:
    at = lambda a: f"greatest(0, least(greatest(2, CAST(ceil(({a}1 - {a}0) / {cell}) AS BIGINT) + 1) - 1, CAST(floor(({a} - {a}0) / {cell}) AS BIGINT)))"
    out = f"""WITH {P}, {BOUNDS}, g AS (SELECT greatest(2, CAST(ceil((x1 - x0) / {cell}) AS BIGINT) + 1) AS nx, greatest(2, CAST(ceil((y1 - y0) / {cell}) AS BIGINT) + 1) AS ny FROM b), {dense_cells()},
k AS (SELECT pid, z, {at('y')} AS row, {at('x')} AS col FROM p, b), low AS (SELECT row, col, min(z) AS z FROM k GROUP BY row, col),
hole AS (SELECT d.* FROM d LEFT JOIN low USING (row, col) WHERE low.z IS NULL),
fill AS (SELECT h.row AS row, h.col AS col, arg_min(l.z, ((l.row-h.row)*(l.row-h.row)+(l.col-h.col)*(l.col-h.col), l.row, l.col)) AS z FROM hole h, low l GROUP BY h.row, h.col),
s0 AS (SELECT row, col, z, CAST('inf' AS DOUBLE) AS lim FROM (SELECT * FROM low UNION ALL SELECT * FROM fill))"""
    for w in range(1, top + 1):
        step = f"s{w - 1}"
        for k, (f, by, over) in enumerate((("min", "row", "col"), ("min", "col", "row"), ("max", "row", "col"), ("max", "col", "row"))):
            out += f", s{w}_{k} AS (SELECT row, col, {f}(z) OVER (PARTITION BY {by} ORDER BY {over} RANGE BETWEEN {w} PRECEDING AND {w} FOLLOWING) AS z, lim FROM {step})"
            step = f"s{w}_{k}"
        out += f", s{w} AS (SELECT row, col, z, least(lim, z + {min(0.15 + 0.3 * w * cell, 2.5)}) AS lim FROM {step})"
    return out + f" SELECT pid, CAST(CASE WHEN k.z <= lim THEN 2 ELSE 1 END AS SMALLINT) AS classification FROM k JOIN s{top} USING (row, col)"


@query("c2_ground_pmf", pmf_sql(2.0, 5))
def _(c):
    return ground.classify_ground_pmf(c.with_df(c.df.drop("classification")), 2.0, max_window_size=10.0).df.select("pid", "classification")


@query("c1_ground_csf")
def _(c):
    return ground.classify_ground_csf(c.with_df(c.df.drop("classification")), 2.0).df.select("pid", "classification")


def csf_sql(res: float, steps: int) -> str:
    """The cloth after a number of steps too small for it to come to rest."""
    n = {a: f"greatest(2, CAST(ceil(({a}1 - {a}0) / {res}) AS BIGINT) + 1)" for a in "xy"}
    at = lambda a: f"greatest(0, least(n{a} - 1, CAST(floor(({a} - {a}0) / d{a} + 0.5) AS BIGINT)))"
    out = f"""WITH {P}, {BOUNDS}, g AS (SELECT *, (x1 - x0) / (nx - 1) AS dx, (y1 - y0) / (ny - 1) AS dy FROM (SELECT {n['x']} AS nx, {n['y']} AS ny, * FROM b)), {dense_cells()},
t AS (SELECT row, col, x0 + col * dx AS x, y0 + row * dy AS y, z1 FROM d, g),
c0 AS MATERIALIZED (SELECT row, col, any_value(z1) - arg_min(p.z, ((p.x-t.x)*(p.x-t.x)+(p.y-t.y)*(p.y-t.y), p.pid)) AS s FROM t JOIN p ON p.x BETWEEN t.x - 15 AND t.x + 15 AND p.y BETWEEN t.y - 15 AND t.y + 15 GROUP BY row, col),
s0 AS (SELECT row, col, s, s AS c FROM c0)"""
    for k in range(1, steps + 1):
        ends = " + ".join(f"coalesce({f}(a) OVER (PARTITION BY {by} ORDER BY {over}), a)" for by, over in (("col", "row"), ("row", "col")) for f in ("lag", "lead"))
        out += f", a{k} AS (SELECT row, col, s, 0.9 * c + 0.1 * s AS a FROM s{k - 1}), s{k} AS MATERIALIZED (SELECT row, col, s, greatest(s, 0.3 * a + 0.175 * ({ends})) AS c FROM a{k})"
    return out + f""", k AS (SELECT pid, z, z1, {at('y')} AS row, {at('x')} AS col FROM p, g)
SELECT pid, CAST(CASE WHEN abs(k.z - (z1 - c)) <= {res / 2} THEN 2 ELSE 1 END AS SMALLINT) AS classification FROM k JOIN s{steps} USING (row, col)"""


@query("c1_ground_csf_steps", csf_sql(2.0, 12))
def _(c):
    return ground.classify_ground_csf(c.with_df(c.df.drop("classification")), 2.0, iterations=12).df.select("pid", "classification")


@query("d1_cluster_dbscan", f"""WITH RECURSIVE {P}, q AS MATERIALIZED {near(0.8)}, k AS MATERIALIZED (SELECT ap AS pid FROM q GROUP BY ap HAVING count(*) >= 3),
e AS MATERIALIZED (SELECT ap AS a, bp AS b FROM q WHERE ap IN (SELECT pid FROM k) AND bp IN (SELECT pid FROM k)),
t(pid, root) AS (SELECT a, b FROM e UNION SELECT t.pid, e.b FROM t JOIN e ON t.root = e.a WHERE e.b < t.pid OR e.b < t.root OR true),
m AS (SELECT pid, min(root) AS root FROM t GROUP BY pid), n AS (SELECT pid, dense_rank() OVER (ORDER BY root) - 1 AS label FROM m),
w AS (SELECT ap AS pid, min(label) AS label FROM q JOIN n ON n.pid = bp GROUP BY ap)
SELECT p.pid AS pid, CAST(coalesce(label, -1) AS INTEGER) AS label FROM p LEFT JOIN w USING (pid)""")
def _(c):
    return cluster.cluster_dbscan(c, 0.8, 3)


@query("d2_tree_tops", f"""WITH {P}, {BOUNDS}, g AS (SELECT greatest(2, CAST(ceil((x1 - x0) / 2.0) AS BIGINT) + 1) AS nx, greatest(2, CAST(ceil((y1 - y0) / 2.0) AS BIGINT) + 1) AS ny FROM b),
k AS (SELECT greatest(0, least(ny - 1, CAST(floor((y - y0) / 2.0) AS BIGINT))) AS row, greatest(0, least(nx - 1, CAST(floor((x - x0) / 2.0) AS BIGINT))) AS col, z - z0 AS h FROM p, b, g),
t AS (SELECT row, col, max(h) AS h FROM k GROUP BY row, col), w AS (SELECT a.row AS row, a.col AS col, a.h AS h, max(u.h) AS m FROM t a JOIN t u ON abs(a.row - u.row) <= 1 AND abs(a.col - u.col) <= 1 GROUP BY a.row, a.col, a.h)
SELECT row, col, {r('h', 'height')} FROM w WHERE h = m AND h >= 2.0""")
def _(c):
    return rounded(cluster.tree_tops(c, 2.0), "height")


@query("d2_segment_trees")
def _(c):
    return cluster.segment_trees(c, 2.0)


@query("d2_stems_per_hectare")
def _(c):
    return cluster.stems_per_hectare(c, cluster.segment_trees(c, 2.0))


@query("d2_building_footprints", f"""WITH RECURSIVE {P}, {BOUNDS}, {grid_size(2.0)}, k AS (SELECT {cells(2.0)}, z - z0 AS h FROM p, b),
t AS MATERIALIZED (SELECT row, col, row * any_value(nx) + col AS node, max(h) AS h FROM k, g GROUP BY row, col HAVING max(h) >= 14),
e AS MATERIALIZED (SELECT a.node AS a, b.node AS b FROM t a JOIN t b ON abs(a.row - b.row) + abs(a.col - b.col) = 1),
r(node, root) AS (SELECT node, node FROM t UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node),
m AS (SELECT node, min(root) AS footprint FROM r GROUP BY node)
SELECT footprint, count(*) AS cells, count(*) * 4.0 AS area, {r('min(x0 + col * 2.0)', 'xmin')}, {r('max(y0 + row * 2.0) + 2.0', 'ymax')}, {r('max(h)', 'height')} FROM m JOIN t USING (node), b GROUP BY footprint HAVING count(*) * 4.0 >= 20""")
def _(c):
    found = cluster.building_footprints(c, 2.0, 14.0, 20.0)
    return rounded(found.select("footprint", "cells", "area", "xmin", "ymax", "height"), "xmin", "ymax", "height")


@query("d3_detect_powerlines")
def _(c):
    found = powerlines.detect_powerlines(c, min_height_above_ground=1.0, linearity_threshold=0.6, strict=False, min_clearance=4.0)
    return rounded(found.points.select("pid", "hag", "wire", "pylon", "violation"), "hag")


@query("d3_height_above_ground", f"""WITH {P}, u AS (SELECT * FROM p WHERE classification = 2), t AS (SELECT * FROM p WHERE classification = 1),
k AS (SELECT t.pid AS pid, t.z AS tz, u.pid AS g, u.z AS z, (u.x-t.x)*(u.x-t.x)+(u.y-t.y)*(u.y-t.y) AS d2 FROM t JOIN u ON u.x BETWEEN t.x - 9 AND t.x + 9 AND u.y BETWEEN t.y - 9 AND t.y + 9),
i AS (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY d2, g) AS n FROM k)
SELECT pid, {r('any_value(tz) - CASE WHEN min(d2) = 0 THEN arg_min(z, (d2, g)) ELSE sum(CASE WHEN d2 > 0 THEN z / d2 END) / sum(CASE WHEN d2 > 0 THEN 1 / d2 END) END', 'hag')} FROM i WHERE n <= 3 GROUP BY pid""")
def _(c):
    return rounded(powerlines.height_above_ground(c.df.where("classification = 1"), c.df.where("classification = 2")), "hag")


def with_plane(spark, sf_dir):
    """The cloud with its ground on one plane."""
    c = points(spark, sf_dir)
    return c.with_df(c.df.withColumn("z", F.when(F.col("classification") == 2, F.col("x") / 20).otherwise(F.col("z"))))


@query("p1_detect_planes", f"WITH {P} SELECT pid FROM p WHERE classification = 2 OR abs(z - x / 20) / sqrt(1 + 1 / 400.0) <= 0.005", with_plane)
def _(c):
    return primitives.detect_planes(c, 0.005, max_planes=1)[0].inliers


@query("p1_planes_of_the_cloud")
def _(c):
    found = primitives.detect_planes(c, 0.1)
    rows = [(k, float(p.normal[0]), float(p.normal[1]), float(p.normal[2]), p.d, p.n_inliers, p.rmse) for k, p in enumerate(found)]
    return c.df.sparkSession.createDataFrame(rows, "plane int, nx double, ny double, nz double, d double, n_inliers long, rmse double")


def with_cylinder(spark, sf_dir):
    """The cloud with its ground rolled up to an upright cylinder, with normals."""
    c = points(spark, sf_dir)
    angle, on = F.col("x") * math.pi / 50, F.col("classification") == 2
    return c.with_df(c.df.select(
        "pid", F.when(on, 150 + 5 * F.cos(angle)).otherwise(F.col("x")).alias("x"), F.when(on, 50 + 5 * F.sin(angle)).otherwise(F.col("y")).alias("y"), F.when(on, F.col("y") / 5).otherwise(F.col("z")).alias("z"),
        F.when(on, F.cos(angle)).otherwise(0.0).alias("nx"), F.when(on, F.sin(angle)).otherwise(0.6).alias("ny"), F.when(on, 0.0).otherwise(0.8).alias("nz"),
    ))


@query("p2_detect_cylinders", f"WITH {P} SELECT pid FROM p WHERE classification = 2", with_cylinder)
def _(c):
    return primitives.detect_cylinders(c, 0.05, (1.0, 20.0))[0].inliers


# ---- registration

def moved(c: PointFrame) -> tuple[PointFrame, np.ndarray]:
    m = np.eye(4)
    a = math.radians(0.02)
    m[:2, :2] = [[math.cos(a), -math.sin(a)], [math.sin(a), math.cos(a)]]
    m[:3, 3] = (0.03, -0.04, 0.02)
    return c.with_df(registration.transformed(c.df, m)), m


def _back() -> dict[str, float]:
    """What undoes ``moved``: R' and -R' t."""
    a, t = math.radians(0.02), (0.03, -0.04, 0.02)
    turn = [[math.cos(a), math.sin(a), 0.0], [-math.sin(a), math.cos(a), 0.0], [0.0, 0.0, 1.0]]
    rows = [[*row, -sum(x * y for x, y in zip(row, t, strict=True))] for row in turn] + [[0.0, 0.0, 0.0, 1.0]]
    return {f"m{i}{j}": rows[i][j] for i in range(4) for j in range(4)}


BACK_SQL = "SELECT " + ", ".join(f"round(CAST({v!r} AS DOUBLE), 3) + 0.0 AS {n}" for n, v in _back().items()) + ", CAST(1.0 AS DOUBLE) AS fitness, CAST(0.0 AS DOUBLE) AS inlier_rmse, true AS converged"


def _found(c: PointFrame, found) -> DataFrame:
    return rounded(found.table(c.df.sparkSession).drop("n_iterations"), *_back(), "fitness", "inlier_rmse", digits=3)


@query("i1_icp_auto", BACK_SQL)
def _(c):
    return _found(c, registration.icp(moved(c)[0], shape.estimate_normals(c, 6.0)))


@query("i2_icp_point_to_point", BACK_SQL)
def _(c):
    return _found(c, registration.icp_point_to_point(moved(c)[0], c))


@query("i3_icp_point_to_plane", BACK_SQL)
def _(c):
    return _found(c, registration.icp_point_to_plane(moved(c)[0], shape.estimate_normals(c, 6.0)))


@query("i4_fpfh")
def _(c):
    df = c.df.withColumns({"nx": F.lit(0.0), "ny": F.sin(F.col("pid") % 7), "nz": F.cos(F.col("pid") % 7)})
    return registration.compute_fpfh(c.with_df(df), 1.5).select("pid", F.transform("fpfh", lambda v: F.round(v, 6)).alias("fpfh"))


@query("i6_align_scans", "SELECT CAST(0 AS INTEGER) AS scan, " + ", ".join(f"CAST({float(k[1] == k[2])} AS DOUBLE) AS {k}" for k in _back()) + " UNION ALL SELECT CAST(1 AS INTEGER), " + ", ".join(f"round(CAST({v!r} AS DOUBLE), 3) + 0.0" for v in _back().values()))
def _(c):
    found = registration.align_scans([c, moved(c)[0]])
    rows = [(k, *(float(v) for v in t.ravel())) for k, t in enumerate(found.transforms)]
    return rounded(c.df.sparkSession.createDataFrame(rows, "scan int, " + ", ".join(f"{n} double" for n in _back())), *_back(), digits=3)


@query("i7_apply_transform", f"WITH {P} SELECT pid, {r('0.8 * x - 0.6 * y + 5.0', 'x')}, {r('0.6 * x + 0.8 * y - 3.0', 'y')}, {r('z + 1.0', 'z')} FROM p")
def _(c):
    m = [[0.8, -0.6, 0, 5], [0.6, 0.8, 0, -3], [0, 0, 1, 1], [0, 0, 0, 1]]
    return rounded(registration.transformed(c.df, m).select("pid", "x", "y", "z"), "x", "y", "z")


# ---- change, volumes, profiles, tiles

@query("h1_m3c2")
def _(c):
    df = change.m3c2(c, second_epoch(c), normal_scale=3.0, projection_scale=1.5, max_cylinder_depth=4.0)
    return rounded(df, "distance", "lod", "nx", "ny", "nz", digits=5)


@query("v1_compute_volume", f"""WITH {P}, {BOUNDS}, q AS (SELECT pid, z, z + CASE WHEN pid % 4 = 0 THEN 0.5 ELSE 0.0 END AS z2, greatest(0, least(CAST(ceil((y1 - y0) / 2.5) AS BIGINT) - 1, CAST(floor((y - y0) / 2.5) AS BIGINT))) AS row, greatest(0, least(CAST(ceil((x1 - x0) / 2.5) AS BIGINT) - 1, CAST(floor((x - x0) / 2.5) AS BIGINT))) AS col FROM p, b),
k AS (SELECT row, col, avg(z2) - avg(z) AS d FROM q GROUP BY row, col)
SELECT {r('sum(greatest(d, 0.0)) * 6.25', 'cut', 4)}, {r('sum(greatest(-d, 0.0)) * 6.25', 'fill', 4)}, {r('sum(d) * 6.25', 'net', 4)}, {r('count(*) * 6.25', 'area')}, CAST(2.5 AS DOUBLE) AS resolution FROM k""")
def _(c):
    df = change.compute_volume(second_epoch(c), c, 2.5)
    return rounded(rounded(df.select("cut", "fill", "net", "area", "resolution"), "cut", "fill", "net", digits=4), "area")


LINE = [(5, 5), (90, 60), (40, 95)]


def stations_sql(segments: list[tuple], width: float, by: str = "") -> str:
    rows = ", ".join(f"({k}, {i}, {ax!r}, {ay!r}, {dx!r}, {dy!r}, {l2!r}, {f!r})" for k, (i, ax, ay, dx, dy, l2, f) in segments)
    return f"""s AS (SELECT * FROM (VALUES {rows}) s(profile_id, i, ax, ay, dx, dy, l2, f)),
k AS (SELECT pid, z, x, y, s.*, greatest(0.0, least(1.0, ((x - ax) * dx + (y - ay) * dy) / l2)) AS t FROM p, s),
q AS (SELECT pid, z, profile_id, i, f + t * sqrt(l2) AS station, sqrt((x - ax - t * dx) * (x - ax - t * dx) + (y - ay - t * dy) * (y - ay - t * dy)) AS d FROM k),
n AS (SELECT profile_id, pid, arg_min(z, (d, i)) AS z, arg_min(station, (d, i)) AS station FROM q WHERE d <= {width} GROUP BY profile_id, pid)"""


def _plain(segments) -> list[tuple]:
    return [(int(k), tuple(float(v) if j else int(v) for j, v in enumerate(s))) for k, s in segments]


LENGTH = sum(math.sqrt(s[5]) for s in change.polyline_segments(LINE))
BINS = max(1, len(np.arange(0, LENGTH + 2.0, 2.0)) - 1)


@query("x1_cross_section", f"""WITH {P}, {stations_sql(_plain((0, s) for s in change.polyline_segments(LINE)), 3.0)}, w AS (SELECT least({BINS - 1}, CAST(floor(station / 2.0) AS BIGINT)) AS bin, z FROM n)
SELECT bin, {r('(bin + 0.5) * 2.0', 'station', 10)}, {r('avg(z)', 'elevation', 10)}, count(*) AS n FROM w GROUP BY bin""")
def _(c):
    return rounded(change.extract_cross_section(c, LINE, 3.0, 2.0), "station", "elevation", digits=10)


@query("x2_profiles", f"""WITH {P}, {stations_sql(_plain(change.profile_lines(LINE, 20.0, 6.0)), 6.0)}, w AS (SELECT profile_id, least({len(np.arange(0, 12.0 + 1.5, 1.5)) - 2}, CAST(floor(station / 1.5) AS BIGINT)) AS bin, z FROM n)
SELECT profile_id, bin, {r('(bin + 0.5) * 1.5', 'station', 10)}, {r('avg(z)', 'elevation', 10)}, count(*) AS n FROM w GROUP BY profile_id, bin""")
def _(c):
    return rounded(change.extract_profiles(c, LINE, 20.0, 6.0, 1.5), "station", "elevation", digits=10)


TILE = "{0} AS (SELECT pid, x, y, z, least(greatest(1, CAST(ceil((x1 - x0) / 20.0) AS BIGINT)) - 1, CAST(floor((x - x0) / 20.0) AS BIGINT)) AS tile_col, least(greatest(1, CAST(ceil((y1 - y0) / 20.0) AS BIGINT)) - 1, CAST(floor((y - y0) / 20.0) AS BIGINT)) AS tile_row, x0, y0 FROM p, b)"


@query("t1_tiles", f"WITH {P}, {BOUNDS}, {TILE.format('t')} SELECT tile_col, tile_row, {r('any_value(x0) + tile_col * 20.0', 'xmin')}, {r('any_value(y0) + (tile_row + 1) * 20.0', 'ymax')}, count(*) AS point_count FROM t GROUP BY tile_col, tile_row")
def _(c):
    return rounded(tiling.tile_table(c, 20.0).select("tile_col", "tile_row", "xmin", "ymax", "point_count"), "xmin", "ymax")


@query("t1_tiles_overlap", f"""WITH {P}, {BOUNDS}, g AS (SELECT greatest(1, CAST(ceil((x1 - x0) / 20.0) AS BIGINT)) AS nx, greatest(1, CAST(ceil((y1 - y0) / 20.0) AS BIGINT)) AS ny FROM b),
c AS (SELECT unnest(range(nx)) AS tile_col FROM g), w AS (SELECT unnest(range(ny)) AS tile_row FROM g)
SELECT tile_col, tile_row, count(*) AS point_count FROM p, b, g, c, w WHERE tile_col BETWEEN floor((x - x0 - 2.0) / 20.0) AND floor((x - x0 + 2.0) / 20.0) AND tile_row BETWEEN floor((y - y0 - 2.0) / 20.0) AND floor((y - y0 + 2.0) / 20.0) GROUP BY tile_col, tile_row""")
def _(c):
    return tiling.tile_table(c, 20.0, 2.0).select("tile_col", "tile_row", "point_count")


@query("t3_process_tiles", f"WITH {P}, {BOUNDS}, {TILE.format('t')} SELECT tile_col, tile_row, max(z) AS top FROM t GROUP BY tile_col, tile_row")
def _(c):
    def top(p):
        return p.groupby(["tile_col", "tile_row"], as_index=False).agg(top=("z", "max"))

    return tiling.process_tiles(c, top, "tile_col long, tile_row long, top double", 20.0)


# ---- exports, models, meshes

def _written(c: PointFrame, suffix: str) -> PointFrame:
    """The cloud written to a file of the shared folder and read back."""
    spark = c.df.sparkSession
    folder = Path(shared_folder(spark).removeprefix("file://")) / "files"  # a mounted path, as these formats are read by plain file calls
    folder.mkdir(parents=True, exist_ok=True)
    path = str(folder / f"{uuid.uuid4().hex}{suffix}")
    formats.write(c, path)
    return formats.read(spark, path)


ROUND_TRIP = f"WITH {P} SELECT {r('x', 'x', 2)}, {r('y', 'y', 2)}, {{}} FROM p"


@query("k1_parquet_round_trip", ROUND_TRIP.format("z, pid, intensity, classification"))
def _(c):
    return rounded(_written(c, ".parquet").df.select("x", "y", "z", "pid", "intensity", "classification"), "x", "y", digits=2)


@query("k2_las_round_trip", ROUND_TRIP.format("CAST(floor(intensity) AS DOUBLE) AS intensity, classification, return_number"))
def _(c):
    back = _written(c.with_df(c.df.withColumn("z", F.round("z", 2))), ".las").df
    return rounded(back.select("x", "y", F.col("intensity").cast("double").alias("intensity"), F.col("classification").cast("smallint").alias("classification"), F.col("return_number").cast("smallint").alias("return_number")), "x", "y", digits=2)


@query("k3_ply_round_trip", ROUND_TRIP.format("z"))
def _(c):
    return rounded(_written(c, ".ply").df.select("x", "y", "z"), "x", "y", digits=2)


@query("k4_text_round_trip", ROUND_TRIP.format(r("z", "z", 4)))
def _(c):
    return rounded(rounded(_written(c, ".xyz").df.select("x", "y", "z"), "x", "y", digits=2), "z", digits=4)


@query("k4_text_lines", f"WITH {P} SELECT printf('%.6f %.6f %.6f %.6f', x, y, z, intensity) AS value FROM p")
def _(c):
    path = f"{shared_folder(c.df.sparkSession)}/{uuid.uuid4().hex}"
    formats.write_text(c, path)
    return c.df.sparkSession.read.text(path)


@query("k6_tileset_chunks", f"WITH {P}, k AS (SELECT CAST(floor((row_number() OVER (ORDER BY pid) - 1) / 700) AS BIGINT) AS chunk, x FROM p) SELECT chunk, count(*) AS n, min(x) AS x_min FROM k GROUP BY chunk")
def _(c):
    return export.chunk_table(c, 700).select("chunk", "n", "x_min")


@query("k7_octree_leaves", f"""WITH RECURSIVE {P}, {BOUNDS}, s AS (SELECT greatest(x1 - x0, y1 - y0, z1 - z0) / 64 AS e FROM b),
c AS MATERIALIZED (SELECT pid, least(63, CAST(floor((x - x0) / e) AS BIGINT)) AS i, least(63, CAST(floor((y - y0) / e) AS BIGINT)) AS j, least(63, CAST(floor((z - z0) / e) AS BIGINT)) AS k FROM p, b, s),
f AS MATERIALIZED (SELECT pid, 'r' || string_agg(CAST(((i >> (5 - d)) & 1) + 2 * ((j >> (5 - d)) & 1) + 4 * ((k >> (5 - d)) & 1) AS VARCHAR), '' ORDER BY d) AS path FROM c, range(6) t(d) GROUP BY pid),
n AS MATERIALIZED (SELECT left(path, d + 1) AS node, d, count(*) AS n FROM f, range(7) t(d) GROUP BY ALL)
SELECT node, n FROM n a WHERE (n <= 400 OR d = 6) AND (d = 0 OR (SELECT b.n FROM n b WHERE b.node = left(a.node, a.d)) > 400)""")
def _(c):
    return export.octree_table(c, 6, 400)


HUES = {"red": "v q p p t v", "green": "t v v q p p", "blue": "p p t v v q"}


@query("k9_segment_colors", f"""WITH {P}, l AS (SELECT pid, CAST(pid % 13 - 1 AS INTEGER) AS label FROM p), h AS (SELECT *, label / CAST((SELECT max(label) + 1 FROM l) AS DOUBLE) * 6 AS h FROM l),
c AS (SELECT pid, label, CAST(floor(h) AS BIGINT) % 6 AS s, 0.9 AS v, 0.9 * (1 - 0.8) AS p, 0.9 * (1 - 0.8 * (h - floor(h))) AS q, 0.9 * (1 - 0.8 * (1 - (h - floor(h)))) AS t FROM h)
SELECT pid, label, {', '.join(f"CAST(floor(255 * CASE WHEN label < 0 THEN 0.5 " + ' '.join(f'WHEN s = {k} THEN {e}' for k, e in enumerate(order.split())) + f" END) AS SMALLINT) AS {name}" for name, order in HUES.items())} FROM c""")
def _(c):
    return colour.segment_colors(c.df.select("pid", (F.col("pid") % 13 - 1).cast("int").alias("label")))


@query("l1_prepare_features", f"""WITH {P}, m AS (SELECT avg(x) AS mx, avg(y) AS my, avg(z) AS mz, max(intensity) AS mi FROM p), w AS (SELECT max(sqrt((x-mx)*(x-mx)+(y-my)*(y-my)+(z-mz)*(z-mz))) AS rad FROM p, m)
SELECT pid, round(CAST(CAST((x - mx) / rad AS FLOAT) AS DOUBLE), 9) + 0.0 AS fx, round(CAST(CAST((z - mz) / rad AS FLOAT) AS DOUBLE), 9) + 0.0 AS fz, round(CAST(CAST(intensity / mi AS FLOAT) AS DOUBLE), 9) + 0.0 AS fi FROM p, m, w""")
def _(c):
    df = model.prepare_features(c)
    return rounded(df.select("pid", *(F.col("features")[k].cast("double").alias(n) for k, n in ((0, "fx"), (2, "fz"), (3, "fi")))), "fx", "fz", "fi", digits=9)


@query("l2_predict", f"WITH {P} SELECT pid, CAST(CASE WHEN z > 8 THEN 1 ELSE 0 END AS INTEGER) AS label FROM p")
def _(c):
    folder = Path(shared_folder(c.df.sparkSession)) / "models"
    folder.mkdir(parents=True, exist_ok=True)
    path = folder / f"{uuid.uuid4().hex}.onnx"
    weights = np.zeros((4, 2))
    weights[2, 1] = 1.0  # class 1 scores z, class 0 scores 8
    path.write_bytes(model.linear_onnx(weights, np.array([8.0, 0.0])))
    return model.predict_semantic(c, str(path), normalize=False).select("pid", "label")


@query("b3_grid_mesh", f"""{SURFACE}, s AS (SELECT a.row AS row, a.col AS col FROM t a JOIN t b ON b.row = a.row AND b.col = a.col + 1 JOIN t c ON c.row = a.row + 1 AND c.col = a.col JOIN t d ON d.row = a.row + 1 AND d.col = a.col + 1)
SELECT row * (mc + 1) + col + h AS a, CASE WHEN h = 0 THEN row * (mc + 1) + col + 1 ELSE (row + 1) * (mc + 1) + col + 1 END AS b, (row + 1) * (mc + 1) + col AS c FROM s, e, range(2) q(h)""")
def _(c):
    return mesh.grid_mesh(surface(c)).faces


def event_stream(spark, sf_dir):
    """The events as a stream of points."""
    path = f"{sf_dir}/events.parquet"
    at = {"x": (F.col("user_id") % 50).cast("double"), "y": F.col("value") / 10, "ts": F.col("ts").cast("timestamp")}
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*").withColumns(at)


@query("e1_event_density", "SELECT CAST(floor(value / 10) AS BIGINT) AS row, CAST(user_id % 50 AS BIGINT) AS col, CAST(count(*) AS BIGINT) AS count FROM events GROUP BY ALL", event_stream)
def _(e):
    folder = f"{shared_folder(e.sparkSession)}/{uuid.uuid4().hex}"

    def keep(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{folder}/batch{batch}")

    counted = ingest.stream_density(e.select("ts", "x", "y"), 1.0, window="1 hour")
    run = counted.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    last = run.lastProgress["batchId"]
    return e.sparkSession.read.parquet(f"{folder}/batch{last}").groupBy("row", "col").agg(F.sum("count").alias("count"))
