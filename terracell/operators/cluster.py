"""Density clustering and tree segmentation."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terracell.errors import PlatformError, SegmentationError
from terracell.frame import PointFrame
from terracell.operators.raster import moving
from terracell.plans.blocks import sweep, to_blocks, to_cells
from terracell.plans.components import connected_components
from terracell.plans.density import HALO, cell_edge, clusters
from terracell.plans.durable import discard, durable
from terracell.plans.grid import GridSpec
from terracell.plans.numbering import numbered
from terracell.plans.tiles import Tiling, arrays, by_tile, finite


def cluster_dbscan(cloud: PointFrame, eps: float, min_samples: int = 10, use_2d: bool = False) -> DataFrame:
    """(pid, label): clusters numbered by their lowest core point, a border point in the lowest-numbered one that reaches it, noise -1."""
    if eps <= 0 or min_samples < 1:
        raise SegmentationError("eps and min_samples are positive")
    cloud.nonempty(SegmentationError)
    axes = "xy" if use_2d else "xyz"
    placed, lost = cloud.df.where(finite(axes)), cloud.df.where(~finite(axes)).select("pid", F.lit(-1).alias("label"))
    tiling = Tiling.of(placed, axes, cell_edge(eps, len(axes)), HALO)
    if tiling is None:
        return lost

    def run(tile: int, rows: pa.Table) -> pa.Table:
        pid, p = rows.column("pid").to_numpy(), arrays(rows, list(axes))
        units = tiling.units(p)
        if tiling.owned(units, tile).any():
            found, (a, b) = clusters(pid, p, units, lambda u: tiling.owned(u, tile), eps, min_samples)
        else:
            found, (a, b) = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)), (np.zeros(0, np.int64),) * 2
        node = pa.array(np.concatenate([found[1], a]), mask=np.concatenate([found[1] < 0, np.zeros(len(a), bool)]) if len(found[1]) + len(a) else None)
        kind = np.concatenate([found[2].astype(np.int32), np.full(len(a), 2, np.int32)])
        return pa.table({"pid": np.concatenate([found[0], b]), "node": node, "kind": kind}, schema=_FOUND)

    # (pid, node, kind): 0 a core point or noise, 1 a border point and a cluster that reaches it, 2 an edge between nodes.
    found = durable(by_tile(tiling.dealt(placed.select("pid", *axes)), run, "pid long, node long, kind int"))
    joined = connected_components(found.where("kind = 2"), "pid", "node")
    nodes = found.where("kind < 2 and node is not null").select("node").distinct()
    root = durable(nodes.join(joined, "node", "left").select("node", F.coalesce("root", "node").alias("root")))
    number = numbered(root.select("root").distinct(), "root", "label").withColumn("label", F.col("label").cast("int"))
    of = durable(root.join(number, "root").select("node", "label"))
    inside = found.where("kind = 0").join(of, "node", "left").select("pid", F.coalesce("label", F.lit(-1)).cast("int").alias("label"))
    border = found.where("kind = 1").join(of, "node").groupBy("pid").agg(F.min("label").alias("label"))
    return inside.unionByName(border).unionByName(lost)


_FOUND = pa.schema([("pid", pa.int64()), ("node", pa.int64()), ("kind", pa.int32())])


def tree_grid(cloud: PointFrame, resolution: float, max_raster_size: int | None) -> GridSpec:
    """The canopy grid; coarsened if a side would have over ``max_raster_size`` cells, where that is given."""
    longest = max(cloud.bounds.extent(0), cloud.bounds.extent(1))
    if max_raster_size and math.ceil(longest / resolution) + 1 > max_raster_size:
        resolution = longest / (max_raster_size - 1)
    return GridSpec.nodes_of(cloud.bounds, resolution)


def canopy(cloud: PointFrame, grid: GridSpec) -> DataFrame:
    """(row, col, height): highest point over the cloud's lowest; 0 where none is."""
    tops = cloud.df.groupBy(grid.row(F.col("y")).alias("row"), grid.col(F.col("x")).alias("col")).agg((F.max("z") - F.lit(cloud.bounds.low[2])).alias("height"))
    return grid.dense(cloud.df.sparkSession).join(tops, ["row", "col"], "left").na.fill(0.0, ["height"])


def tree_tops(cloud: PointFrame, resolution: float = 1.0, min_height: float = 2.0, min_crown_area: float = 4.0, max_raster_size: int | None = None) -> DataFrame:
    """(row, col, height): canopy cells that are the highest of their window and high enough."""
    cloud.nonempty(SegmentationError)
    grid = tree_grid(cloud, resolution, max_raster_size)
    size = max(3, math.ceil(math.sqrt(min_crown_area) / grid.res) | 1)
    return moving(canopy(cloud, grid), "height", size // 2, "max", "top").where((F.col("height") == F.col("top")) & (F.col("height") >= min_height)).select("row", "col", "height")


#: A cell that no crown has reached.
_FREE = np.inf


def flood(depth: np.ndarray, level: np.ndarray, steps: np.ndarray, crown: np.ndarray, fixed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Grow crowns over ``depth`` from the cells that are ``fixed``: (level, steps, crown) of every cell.

    A cell takes the least of what its four neighbours offer: the level at which it
    is reached (the deepest cell on the way), the steps on that level, the crown's
    number. A neighbour's offer is always more than the neighbour's own, so the
    least open offer is final, and only one assignment of the whole raster
    satisfies all cells, however it is computed.
    """
    ny, nx = depth.shape
    best = np.full((3, ny, nx), _FREE)
    queue = [(level[r, c], steps[r, c], crown[r, c], int(r), int(c)) for r, c in np.argwhere(fixed & (level < _FREE))]
    heapq.heapify(queue)
    done = np.zeros((ny, nx), bool)
    while queue:
        at, n, of, r, c = heapq.heappop(queue)
        if done[r, c]:
            continue
        done[r, c] = True
        best[:, r, c] = at, n, of
        for y, x in ((r - 1, c), (r + 1, c), (r, c - 1), (r, c + 1)):
            if 0 <= y < ny and 0 <= x < nx and not done[y, x] and not fixed[y, x]:
                d = depth[y, x]
                heapq.heappush(queue, (d, 1.0, of, y, x) if d > at else (at, n + 1, of, y, x))
    return best[0], best[1], best[2]


def watershed(cells: DataFrame, markers: DataFrame, grid: GridSpec, side: int | None = None) -> DataFrame:
    """(row, col, crown): the crown of each cell that one reaches; cells: row, col, depth (65535 where missing); markers: row, col, crown (exact as a double).

    Every block grows its crowns anew from its markers and from what stands at its
    neighbours' rims, until no block's rim changes any more.
    """
    layers = ["level", "steps", "crown"]
    given = cells.join(markers, ["row", "col"], "left").select("row", "col", "depth", F.coalesce("crown", F.lit(-1.0)).alias("marker"))
    blocks = to_blocks(given, grid, {"depth": 65535.0, "marker": -1.0}, side)

    def first(arrays, core, corner):
        own = arrays["marker"] >= 0
        return {"level": np.where(own, arrays["depth"], _FREE), "steps": np.where(own, 0.0, _FREE), "crown": np.where(own, arrays["marker"], _FREE)}

    def grow(arrays, core, corner):
        rim = np.ones(arrays["depth"].shape, bool)
        rim[core] = False
        marked = arrays["marker"] >= 0
        start = [np.where(rim, arrays[n], np.where(marked, v, _FREE)) for n, v in zip(layers, (arrays["depth"], 0.0, arrays["marker"]), strict=True)]
        out = flood(arrays["depth"], *start, rim | marked)
        edge = np.ones(arrays["depth"][core].shape, bool)
        edge[1:-1, 1:-1] = False
        same = all(np.array_equal(o[core][edge], arrays[n][core][edge]) for o, n in zip(out, layers, strict=True))
        return {**{n: o[core] for n, o in zip(layers, out, strict=True)}, "changed": not same}

    current = durable(sweep(blocks, grid, ["depth", "marker"], 0, first, layers, side=side))
    while True:
        new = durable(sweep(current, grid, ["depth", "marker", *layers], 1, grow, layers, "changed boolean", side))
        discard(current)
        settled = new.where("changed").isEmpty()
        current = new.drop("changed")
        current._terracell_path = new._terracell_path
        if settled:
            return to_cells(current, grid, ["crown"], side).where(F.col("crown") < F.lit(_FREE))


def segment_trees(cloud: PointFrame, resolution: float = 1.0, min_height: float = 2.0, min_crown_area: float = 4.0, max_raster_size: int | None = None) -> DataFrame:
    """(pid, label): crowns by marker-controlled watershed of the canopy raster; -1 below ``min_height`` and in crowns of too few points."""
    if cloud.meta.platform == "terrestrial":
        raise PlatformError("crowns need a view from above")
    if min(resolution, min_crown_area) <= 0:
        raise SegmentationError("resolution and crown area are positive")
    cloud.nonempty(SegmentationError)
    grid = tree_grid(cloud, resolution, max_raster_size)
    tops = durable(tree_tops(cloud, resolution, min_height, min_crown_area, max_raster_size))
    if tops.isEmpty():
        raise SegmentationError("no tree-tops")
    node = F.col("row") * F.lit(grid.nx) + F.col("col")
    named = tops.select("row", "col", node.alias("node"))
    beside = [named.alias("a").join(named.alias("b"), (F.col("b.row") == F.col("a.row") + dr) & (F.col("b.col") == F.col("a.col") + dc)).select(F.col("a.node").alias("a"), F.col("b.node").alias("b")) for dr, dc in ((0, 1), (1, 0))]
    joined = connected_components(beside[0].unionByName(beside[1]))
    rooted = durable(named.join(joined, "node", "left").select("row", "col", F.coalesce("root", "node").alias("root")))
    numbers = numbered(rooted.select("root").distinct(), "root", "crown")
    markers = rooted.join(numbers, "root").select("row", "col", F.col("crown").cast("double").alias("crown"))
    heights = canopy(cloud, grid).where("height > 0")
    highest = F.lit(max(cloud.bounds.high[2] - cloud.bounds.low[2], 1e-12))
    depth = heights.select("row", "col", F.rint((1 - F.col("height") / highest) * 65535).alias("depth"))
    crowns = watershed(depth, markers, grid).select(F.col("row").alias("_row"), F.col("col").alias("_col"), F.col("crown").cast("int").alias("crown"))
    high = F.col("z") - F.lit(cloud.bounds.low[2]) >= min_height
    placed = cloud.df.select("pid", high.alias("high"), grid.row(F.col("y")).alias("_row"), grid.col(F.col("x")).alias("_col")).join(crowns, ["_row", "_col"], "left")
    raw = durable(placed.select("pid", F.when(F.col("high"), F.col("crown")).alias("label")))
    large = raw.where("label is not null").groupBy("label").count().where(F.col("count") >= min_crown_area / (grid.res * grid.res)).select("label")
    return raw.join(large.withColumn("ok", F.lit(True)), "label", "left").select("pid", F.when(F.col("ok"), F.col("label")).otherwise(-1).cast("int").alias("label"))


def tree_table(cloud: PointFrame, labels: DataFrame) -> DataFrame:
    """(label, x, y, height, crown_area_points): a row a crown: its highest point, its height over the cloud's lowest point, its number of points."""
    top = F.max_by(F.struct("x", "y", "z"), F.struct("z", -F.col("pid"))).alias("top")
    rows = cloud.df.select("pid", "x", "y", "z").join(labels.where("label >= 0"), "pid").groupBy("label").agg(top, F.count("*").alias("points"))
    return rows.select("label", F.col("top.x").alias("x"), F.col("top.y").alias("y"), (F.col("top.z") - F.lit(cloud.bounds.low[2])).alias("height"), "points")


def stems_per_hectare(cloud: PointFrame, labels: DataFrame) -> DataFrame:
    """One row: crowns, hectares of the cloud's rectangle, crowns a hectare, mean and greatest crown height."""
    hectares = max(cloud.bounds.extent(0) * cloud.bounds.extent(1), 1e-12) / 10_000
    n = F.count("*")
    return tree_table(cloud, labels).agg(n.alias("stems"), F.lit(hectares).alias("hectares"), (n / F.lit(hectares)).alias("per_hectare"), F.avg("height").alias("mean_height"), F.max("height").alias("top_height"))


def building_footprints(cloud: PointFrame, resolution: float = 1.0, min_height: float = 2.5, min_area: float = 20.0) -> DataFrame:
    """(footprint, cells, area, xmin, ymin, xmax, ymax, height): 4-connected canopy cells of ``min_height`` or more, of ``min_area`` or more in all."""
    cloud.nonempty(SegmentationError)
    grid = GridSpec.edges_of(cloud.bounds, resolution, 1)
    tops = cloud.df.groupBy(grid.row(F.col("y")).alias("row"), grid.col(F.col("x")).alias("col")).agg((F.max("z") - F.lit(cloud.bounds.low[2])).alias("height"))
    cells = durable(tops.where(F.col("height") >= min_height).withColumn("node", F.col("row") * F.lit(grid.nx) + F.col("col")))
    beside = [cells.alias("a").join(cells.alias("b"), (F.col("b.row") == F.col("a.row") + dr) & (F.col("b.col") == F.col("a.col") + dc)).select(F.col("a.node").alias("a"), F.col("b.node").alias("b")) for dr, dc in ((0, 1), (1, 0))]
    roots = connected_components(beside[0].unionByName(beside[1]))
    area = F.lit(resolution * resolution)
    west, south = F.lit(grid.x0) + F.col("col") * F.lit(resolution), F.lit(grid.y0) + F.col("row") * F.lit(resolution)
    named = cells.join(roots, "node", "left").select(F.coalesce("root", "node").alias("footprint"), west.alias("x"), south.alias("y"), "height")
    return named.groupBy("footprint").agg(
        F.count("*").alias("cells"), (F.count("*") * area).alias("area"), F.min("x").alias("xmin"), F.min("y").alias("ymin"),
        (F.max("x") + F.lit(resolution)).alias("xmax"), (F.max("y") + F.lit(resolution)).alias("ymax"), F.max("height").alias("height"),
    ).where(F.col("area") >= min_area)
