"""Web exports: 3D Tiles point clouds and octrees. Executors write the points' files; the driver writes one index.

Paths may be of any file system that Hadoop knows.
"""

from __future__ import annotations

import json
import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terracell.errors import ExportError
from terracell.frame import PointFrame
from terracell.plans.durable import durable


def _write(spark: SparkSession, path: str, data: bytes) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).create(hadoop, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def _write_parts(rows: DataFrame, path: str) -> None:
    """(name, content) rows as files of a folder that driver and executors share."""

    def put(batch):
        from pathlib import Path

        for r in batch:
            target = Path(path) / r.name
            target.parent.mkdir(parents=True, exist_ok=True)
            partial = target.with_suffix(f".{r.attempt}.part")
            partial.write_bytes(r.content)
            partial.replace(target)  # a retried task replaces the same bytes

    rows.withColumn("attempt", F.spark_partition_id()).foreachPartition(put)


def pnts(xyz: np.ndarray, rgb: np.ndarray | None, centre: np.ndarray) -> bytes:
    """A .pnts tile: 28-byte header, feature table padded to 8, float positions about a centre."""
    head = {"POINTS_LENGTH": len(xyz), "RTC_CENTER": centre.tolist(), "POSITION": {"byteOffset": 0}}
    body = (xyz - centre).astype("<f4").tobytes()
    if rgb is not None:
        head["RGB"] = {"byteOffset": len(body)}
        body += rgb.astype("u1").tobytes()
    body += b"\0" * (-len(body) % 8)
    text = json.dumps(head, separators=(",", ":")).encode()
    text += b" " * (-(28 + len(text)) % 8)
    return struct.pack("<4s6I", b"pnts", 1, 28 + len(text) + len(body), len(text), len(body), 0, 0) + text + body


def chunks(cloud: PointFrame, max_points_per_tile: int = 50_000) -> DataFrame:
    """The cloud with ``chunk``: runs of that many points in pid order.

    Ranks come from counts by pid range, so no task orders the whole cloud.
    """
    df = cloud.df
    width = F.lit(max(1, max_points_per_tile))
    part = F.floor(F.col("pid") / width).cast("long")
    counts = df.groupBy(part.alias("_part")).count()
    # One row a range of pids; they are ordered to number what comes before each.
    before = counts.select("_part", (F.sum("count").over(Window.orderBy("_part")) - F.col("count")).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_part").orderBy("pid")) - 1
    return df.withColumn("_part", part).withColumn("_rank", rank).join(before, "_part").withColumn("chunk", F.floor((F.col("_before") + F.col("_rank")) / width).cast("long")).drop("_part", "_rank", "_before")


def chunk_table(cloud: PointFrame, max_points_per_tile: int = 50_000) -> DataFrame:
    """(chunk, n, bounds) of each tile."""
    return chunks(cloud, max_points_per_tile).groupBy("chunk").agg(F.count("*").alias("n"), *(f(c).alias(f"{c}_{f.__name__}") for c in "xyz" for f in (F.min, F.max)))


def export_3dtiles(cloud: PointFrame, path: str, max_points_per_tile: int = 50_000, geometric_error: float = 10.0) -> None:
    """tileset.json and tile_<chunk>.pnts in a shared folder."""
    cloud.nonempty(ExportError)
    centre = np.array(cloud.centroid().first(), float)
    has = cloud.has("red")
    columns = ["chunk", "pid", "x", "y", "z", *(["red", "green", "blue"] if has else [])]

    def one(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("pid")
        rgb = p[["red", "green", "blue"]].to_numpy() if has else None
        return pd.DataFrame({"name": [f"tile_{p.chunk.iloc[0]}.pnts"], "content": [pnts(p[["x", "y", "z"]].to_numpy(float), rgb, centre)]})

    split = durable(chunks(cloud, max_points_per_tile).select(*columns))
    _write_parts(split.groupBy("chunk").applyInPandas(one, "name string, content binary"), path)

    def box(r) -> list[float]:
        middle, half = [(r[f"{c}_min"] + r[f"{c}_max"]) / 2 for c in "xyz"], [(r[f"{c}_max"] - r[f"{c}_min"]) / 2 for c in "xyz"]
        return [*middle, half[0], 0, 0, 0, half[1], 0, 0, 0, half[2]]

    ends = [f(c).alias(f"{c}_{f.__name__}") for c in "xyz" for f in (F.min, F.max)]
    tiles = [{"boundingVolume": {"box": box(r)}, "geometricError": 0, "content": {"uri": f"tile_{r.chunk}.pnts"}} for r in split.groupBy("chunk").agg(*ends).orderBy("chunk").toLocalIterator()]
    whole = split.agg(*ends).first()
    index = {"asset": {"version": "1.0"}, "geometricError": geometric_error, "root": {"boundingVolume": {"box": box(whole)}, "geometricError": geometric_error, "refine": "ADD", "children": tiles}}
    _write(cloud.df.sparkSession, f"{path}/tileset.json", json.dumps(index).encode())


def octree(cloud: PointFrame, max_depth: int = 10, max_points_per_node: int = 50_000, drop_far_faces: bool = False) -> DataFrame:
    """The cloud with ``node``: its leaf's path of octant digits (x is 1, y 2, z 4) from the root "r".

    The full path of every point is arithmetic on its position in a cube of the
    longest side; leaves are the shortest prefixes with few enough points. A pass
    a level counts the nodes still too full. ``drop_far_faces`` keeps nodes
    half-open at the cube's far faces too, once the root is split.
    """
    b = cloud.nonempty(ExportError)
    side = max(b.extent(k) for k in range(3))
    n = 1 << max_depth
    at = {}
    for k, c in enumerate("xyz"):
        cell = F.floor((F.col(c) - F.lit(b.low[k])) / F.lit(side / n)).cast("long") if side else F.lit(0).cast("long")
        at[c] = cell if drop_far_faces else F.least(cell, F.lit(n - 1).cast("long"))
    df = cloud.df.withColumns({f"_{c}": e for c, e in at.items()})
    if drop_far_faces and b.n > max_points_per_node:
        df = df.where(F.greatest("_x", "_y", "_z") < n)
    digits = [sum((F.shiftright(f"_{c}", max_depth - 1 - d).bitwiseAND(F.lit(1)) * F.lit(1 << k) for k, c in list(enumerate("xyz"))[1:]), F.shiftright("_x", max_depth - 1 - d).bitwiseAND(F.lit(1))) for d in range(max_depth)]
    df = df.withColumn("_path", F.concat(F.lit("r"), *(d.cast("string") for d in digits)))
    cells = durable(df.groupBy("_path").count())
    leaf, full = None, cells.withColumn("node", F.substring("_path", 1, 1))
    for depth in range(max_depth + 1):
        node = F.substring("_path", 1, depth + 1)
        sizes = durable(full.groupBy(node.alias("node")).agg(F.sum("count").alias("n")))
        done = sizes.where(F.col("n") <= max_points_per_node) if depth < max_depth else sizes
        now = full.drop("node").withColumn("node", node).join(done.select("node"), "node", "left_semi").select("_path", "node")
        leaf = now if leaf is None else leaf.unionByName(now)
        if depth == max_depth or done.count() == sizes.count():
            break
        full = full.drop("node").withColumn("node", node).join(done.select("node"), "node", "left_anti")
    return df.join(durable(leaf), "_path").drop("_path", "_x", "_y", "_z")


def octree_table(cloud: PointFrame, max_depth: int = 10, max_points_per_node: int = 50_000) -> DataFrame:
    """(node, n) of the leaves."""
    return octree(cloud, max_depth, max_points_per_node).groupBy("node").agg(F.count("*").alias("n"))


def export_potree(cloud: PointFrame, path: str, max_depth: int = 10, max_points_per_node: int = 50_000) -> None:
    """metadata.json and <node>.bin, float triples about the cube's corner, in a shared folder."""
    b = cloud.nonempty(ExportError)
    low, side = np.array(b.low), max(b.extent(k) for k in range(3))

    def one(p: pd.DataFrame) -> pd.DataFrame:
        xyz = p.sort_values("pid")[["x", "y", "z"]].to_numpy(float) - low
        return pd.DataFrame({"name": [f"{p.node.iloc[0]}.bin"], "content": [xyz.astype("<f4").tobytes()]})

    split = durable(octree(cloud, max_depth, max_points_per_node).select("node", "pid", "x", "y", "z"))
    _write_parts(split.groupBy("node").applyInPandas(one, "name string, content binary"), path)
    nodes = [{"name": r.node, "points": r["count"]} for r in split.groupBy("node").count().orderBy("node").toLocalIterator()]
    index = {"version": "2.0", "points": sum(r["points"] for r in nodes), "boundingBox": {"min": low.tolist(), "max": (low + side).tolist()}, "maxDepth": max_depth, "nodes": nodes}
    _write(cloud.df.sparkSession, f"{path}/metadata.json", json.dumps(index).encode())


