"""Spatial joins by cell hashing.

A radius join puts one side's points into cells of edge r and copies the other
side's points to the cells around their own: an equi-join on the cell, then the
exact distance. Every pair meets once. Catalyst has no such rewrite; written as
a plain distance condition the join would be a nested loop.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from terracell.plans.durable import durable
from terracell.plans.search import Tree
from terracell.plans.tiles import Tiling, arrays, by_tile, finite


def cell(axis: Column, edge: float) -> Column:
    return F.floor(axis / F.lit(edge)).cast("long")


def around(df: DataFrame, axes: str, edge: float, prefix: str = "c") -> DataFrame:
    """Each row once for each of the 3 ** d cells around its own."""
    for a in axes:
        df = df.withColumn(f"_{a}", F.explode(F.array(*(F.lit(k).cast("long") for k in (-1, 0, 1))))).withColumn(f"{prefix}{a}", cell(F.col(a), edge) + F.col(f"_{a}")).drop(f"_{a}")
    return df


def distance2(axes: str, left: str = "a", right: str = "b") -> Column:
    total = None
    for c in axes:
        d = F.col(f"{right}.{c}") - F.col(f"{left}.{c}")
        total = d * d if total is None else total + d * d
    return total


def radius_pairs(a: DataFrame, b: DataFrame, r: float, axes: str = "xyz", keep_a: tuple = ("pid",), keep_b: tuple = ("pid",)) -> DataFrame:
    """Pairs at distance r or less: a's columns as a_*, b's as b_*, d2, and offsets d<axis> = b - a.

    The side copied to neighbour cells should be the smaller one: a. Size
    estimates don't count the copies, so the join is told never to broadcast them.
    """
    left = around(a.select(*dict.fromkeys((*keep_a, *axes))), axes, r)
    right = b.select(*dict.fromkeys((*keep_b, *axes)), *(cell(F.col(c), r).alias(f"c{c}") for c in axes))
    on = [F.col(f"a.c{c}") == F.col(f"b.c{c}") for c in axes]
    joined = left.alias("a").hint("merge").join(right.alias("b"), on)
    return joined.select(
        *(F.col(f"a.{c}").alias(f"a_{c}") for c in keep_a),
        *(F.col(f"b.{c}").alias(f"b_{c}") for c in keep_b),
        distance2(axes).alias("d2"),
        *((F.col(f"b.{c}") - F.col(f"a.{c}")).alias(f"d{c}") for c in axes),
    ).where(F.col("d2") <= F.lit(r * r))


def nearest_within(a: DataFrame, b: DataFrame, r: float, axes: str = "xyz", keep_a: tuple = ("pid",), keep_b: tuple = ("pid",)) -> DataFrame:
    """For each row of a that has one, b's nearest row within r (ties: lowest pid); searched tile by tile, so no pairs are made."""
    keep_b = tuple(dict.fromkeys(("pid", *keep_b)))
    places = [F.col(c).cast("double").alias(c) for c in axes]
    asked = a.where(finite(axes)).select(*places, *(F.col(c).alias(f"a_{c}") for c in keep_a))
    given = b.where(finite(axes)).select(*places, *(F.col(c).alias(f"b_{c}") for c in keep_b))
    kinds = {**{f"a_{c}": asked.schema[f"a_{c}"] for c in keep_a}, **{f"b_{c}": given.schema[f"b_{c}"] for c in keep_b}}
    schema = T.StructType([T.StructField(n, f.dataType) for n, f in kinds.items()] + [T.StructField(n, T.DoubleType()) for n in ("d2", *(f"d{c}" for c in axes))])
    tiling = Tiling.of(asked.select(*axes).unionAll(given.select(*axes)), axes, r * (1 + 1e-9))
    if tiling is None:
        return a.sparkSession.createDataFrame([], schema)
    shape = to_arrow_schema(schema)
    whole = [*axes, *kinds]
    left, right = tiling.home(asked), tiling.dealt(given)
    sides = [d.select("tile", F.lit(k).alias("side"), *(F.col(n) if n in d.columns else F.lit(None).cast(kinds[n].dataType).alias(n) for n in whole)) for k, d in ((0, left), (1, right))]

    def run(tile: int, rows: pa.Table) -> pa.Table:
        side = rows.column("side").to_numpy()
        q, p = (rows.filter(pa.array(side == k)) for k in (0, 1))
        if not len(q) or not len(p):
            return shape.empty_table()
        x, y = arrays(q, list(axes)), arrays(p, list(axes))
        tree = Tree(y, p.column("b_pid").to_numpy())
        point, d2 = tree.nearest(x, r)
        has = np.flatnonzero(point >= 0)
        of = tree.order[point[has]]
        out = {**{f"a_{c}": q.column(f"a_{c}").take(has) for c in keep_a}, **{f"b_{c}": p.column(f"b_{c}").take(of) for c in keep_b}, "d2": d2[has]}
        off = y[of] - x[has]
        return pa.table({**out, **{f"d{c}": off[:, k] for k, c in enumerate(axes)}}).cast(shape)

    return by_tile(sides[0].unionAll(sides[1]), run, schema)


def nearest_k(queries: DataFrame, points: DataFrame, k: int, axes: str = "xyz", keep_a: tuple = ("pid",), keep_b: tuple = ("pid",), edge: float | None = None) -> DataFrame:
    """The k nearest points of each query (ties: lowest pid), as radius_pairs gives them, with rank n from 1.

    Rounds with growing cells: a query is settled once its k-th neighbour is no
    farther than the cell edge, as every point that near lies in the block around
    it. The rest go on with thrice the edge. When one block spans all points the
    remaining queries are settled by what is there.
    """
    q = durable(queries.select(*dict.fromkeys((*keep_a, *axes))))
    p = durable(points.select(*dict.fromkeys(("pid", *keep_b, *axes))))
    ends = [f(c).alias(f"{f.__name__}{c}") for c in axes for f in (F.min, F.max)]
    whole = p.agg(F.count("*").alias("n"), *ends).first()
    asked = q.agg(F.count("*").alias("n"), *ends).first()
    span = max([max(whole[f"max{c}"], asked[f"max{c}"]) - min(whole[f"min{c}"], asked[f"min{c}"]) for c in axes], default=0.0) if whole.n and asked.n else 0.0
    if not edge:
        sides = [max(whole[f"max{c}"] - whole[f"min{c}"], 1e-9) for c in axes] if whole.n else [1.0]
        flat = [s for s in sides if s > 1e-6 * max(sides)]
        edge = (math.prod(flat) * k / max(1, whole.n)) ** (1 / len(flat))  # half as far again as the k-th of evenly spread points
        # Points gather on surfaces: where a point's own cell holds more than half of k, cells shrink as on a sheet.
        full = p.groupBy(*(cell(F.col(c), edge) for c in axes)).count().agg(F.sum(F.col("count") * F.col("count")) / F.sum("count")).first()[0] or 0
        edge *= min(1.0, math.sqrt(k / 2 / full)) if full else 1.0
    edge = max(edge, span * 1e-6, 1e-9)
    done, left = None, q
    rank = Window.partitionBy(*(f"a_{c}" for c in keep_a)).orderBy("d2", "b_pid")
    kept = tuple(dict.fromkeys(("pid", *keep_b)))
    while True:
        last = edge >= span
        near = _candidates(left, p, edge, axes, keep_a, kept)
        if not last:
            near = near.where(F.col("d2") <= F.lit(edge * edge))  # all that can settle a query; ranked no further
        ranked = near.withColumn("n", F.row_number().over(rank)).where(F.col("n") <= k)
        if not last:
            ranked = durable(ranked)
            settled = ranked.where(F.col("n") == k).select(*(F.col(f"a_{c}") for c in keep_a))
            part = ranked.join(settled, [f"a_{c}" for c in keep_a], "left_semi")
            left = durable(left.join(settled.toDF(*keep_a), list(keep_a), "left_anti"))
        else:
            part = ranked
        done = part if done is None else done.unionByName(part)
        if last or left.isEmpty():
            return done
        edge *= 3


def _candidates(a: DataFrame, b: DataFrame, edge: float, axes: str, keep_a: tuple, keep_b: tuple) -> DataFrame:
    left = around(a, axes, edge)
    right = b.select("*", *(cell(F.col(c), edge).alias(f"c{c}") for c in axes))
    on = [F.col(f"a.c{c}") == F.col(f"b.c{c}") for c in axes]
    return left.alias("a").hint("merge").join(right.alias("b"), on).select(
        *(F.col(f"a.{c}").alias(f"a_{c}") for c in keep_a),
        *(F.col(f"b.{c}").alias(f"b_{c}") for c in keep_b),
        distance2(axes).alias("d2"),
        *((F.col(f"b.{c}") - F.col(f"a.{c}")).alias(f"d{c}") for c in axes),
    )

