"""Connected components of an edge table.

Each task first contracts the edges that it holds to stars around their least
nodes; what is left is joined up by alternating large and small stars (Kiveris
et al., "Connected Components in MapReduce and Beyond", 2014). Every step is a
map-side combined minimum and one join of two durable tables, both of which
adaptive execution can split when a hub owns many edges. Nothing is collected
but one row a round.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terracell.plans.durable import discard, durable, sized
from terracell.plans.forest import spanning_stars

#: Edges that a task contracts at once: bounds its memory, not its input.
CONTRACTED = 2_000_000


def _contract(batches):
    def stars(held):
        u, v = (np.concatenate([b.column(k).to_numpy() for b in held]) for k in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in spanning_stars(u, v)], names=["u", "v"])

    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= CONTRACTED:
            yield stars(held)
            held, n = [], 0
    if n:
        yield stars(held)


def _are_stars(edges: DataFrame, n: int) -> bool:
    """Whether every node is either a centre or a leaf of one centre."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("leaf")), F.struct(F.col("v").alias("node"), F.lit(0).alias("leaf")))).alias("e")).select("e.*")
    roles = ends.groupBy("node").agg(F.sum("leaf").alias("leaf"), F.min("leaf").alias("least"))
    return sized(roles.where("leaf > 1 or leaf = 1 and least = 0"), 2 * n).isEmpty()


def _star(edges: DataFrame, n: int, large: bool) -> DataFrame:
    """n edges (u > v) -> the same components, nearer to stars around their minima."""
    if large:
        arcs = edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")
    else:
        arcs = edges
    least = durable(sized(arcs.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m")), 2 * n))
    if large:
        new = sized(arcs.where("v > u").join(least, "u"), 2 * n).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        kept = least.select("u", F.col("m").alias("v"))
        new = sized(arcs.join(least, "u"), n).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(kept)
    out = durable(sized(new.where("u <> v").distinct(), 2 * n).mapInArrow(_contract, "u long, v long"))
    discard(least)
    return out


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node that has an edge to another node; root is the least node of its component.

    Loops, repeated edges and both directions of an edge are allowed; null ends are ignored.
    """
    current = durable(
        edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v"))
        .mapInArrow(_contract, "u long, v long")
    )
    rounds, n = 0, current.count()
    while not _are_stars(current, n):
        if (rounds := rounds + 1) > max_rounds:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
        for large in (True, False):
            new = _star(current, n, large)
            discard(current)
            current, n = new, new.count()
    roots = sized(current.select(F.col("v").alias("node")).distinct(), n).withColumn("root", F.col("node"))
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
