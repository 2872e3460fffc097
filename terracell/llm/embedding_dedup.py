"""Embedding near-dedup by PCA-ordered, tiled comparison.

Equal vectors of one label are one node with a count, so copies are never
compared. Nodes are compared in the basis of the corpus's principal axes, most
variance first. After d leading dimensions the cosine of a pair is at most its
partial product plus the product of both suffix norms (Cauchy-Schwarz); a pair
is given up as soon as that bound falls under the threshold, mostly after a few
dimensions. Where many pairs of a tile are left, the next dimensions are added as
one matrix product; where few are, pair by pair.

The leading axes also cut the space: unit vectors of cosine c or more differ by
at most sqrt(2 - 2c) in any coordinate, so cells of that width are compared only
with themselves and the cells next to them, each pair of cells once. The larger
a label, the more axes cut it, up to AXES. Within cells, nodes are dealt in hashed
blocks, so a task compares two blocks of bounded size however many nodes share a
cell. A node goes once to every tile that it takes part in, in its own precision:
tiles can't fetch vectors by id without a file system that every worker can open.
"""

from __future__ import annotations

import math
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terracell.llm.base import Forest, map_rows
from terracell.plans.components import connected_components
from terracell.plans.durable import discard, durable, sized

BLOCK_ROWS = 8192
#: Axes that may cut a label's space, and how many times more nodes call for one more of them.
AXES, GROWTH = 4, 8
#: Leading dimensions after which pairs are tested, as shares of all.
STAGES = (0.125, 0.25, 0.5, 1.0)
SLACK = 1e-9
#: Cells of a product, and numbers gathered for pairs, that are held at once.
CELLS_AT_ONCE, GATHERED = 1 << 21, 1 << 22
#: A product is made whole while more than one in this many of its cells may be links.
SPARSE = 16
#: Numbers that the matrices of principal axes may have in all; vectors of lengths beyond that keep their own axes, which only prune less.
AXIS_CELLS = 1 << 23


def unit_vectors(column: pa.Array) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, unit vectors in double precision) for each length; vectors that are null, empty, zero or not finite are left out."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = np.asarray(column.flatten().to_numpy(zero_copy_only=False), float)
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(sizes) else sizes
    out = []
    for d in np.unique(sizes[sizes > 0]).tolist():
        rows = np.flatnonzero(sizes == d)
        x = values[first[rows][:, None] + np.arange(d)]
        top = np.abs(x).max(1)
        good = np.isfinite(top) & (top > 0)
        x = x[good] / top[good, None]
        out.append((d, rows[good], x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]))
    return out


def principal_axes(vectors: DataFrame, embedding_col: str) -> dict[int, np.ndarray]:
    """For the vector lengths that most rows have, all vectors' principal axes as columns, most variance first.

    Second moments are summed per task and length; matrices of AXIS_CELLS numbers in all reach the driver.
    """
    known, room = [], AXIS_CELLS
    lengths = vectors.groupBy(F.size(embedding_col).alias("d")).count().where("d > 0").orderBy(F.desc("count"), "d").limit(1024).collect()
    for r in lengths:
        if r.d * r.d <= room:
            known.append(r.d)
            room -= r.d * r.d

    def moments(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for d, _, x in unit_vectors(b.column(0)):
                if d in known:
                    sums[d] = sums.get(d, 0) + x.T @ x
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], names=["d", "m"])

    def add(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(key[0] * key[0])
        for m in rows.m:
            total += np.frombuffer(m)
        return pd.DataFrame({"d": [key[0]], "m": [total.tobytes()]})

    parts = map_rows(vectors.select(embedding_col), moments, "d int, m binary")
    some = parts.groupBy("d", F.spark_partition_id() % 64).applyInPandas(add, "d int, m binary").coalesce(32)
    axes = {}
    for d, m in some.groupBy("d").applyInPandas(add, "d int, m binary").coalesce(8).collect():
        _, vectors_ = np.linalg.eigh(np.frombuffer(m).reshape(d, d))
        axes[d] = np.ascontiguousarray(vectors_[:, ::-1])
    return axes


def tile_links(a: np.ndarray, b: np.ndarray, threshold: float):
    """Chunks of (i, j, cosine) with cosine >= threshold but for SLACK; rows are unit vectors in principal axes."""
    dims = a.shape[1]
    cuts = sorted({max(1, math.ceil(s * dims)) for s in STAGES})
    suffix = [[np.sqrt(np.maximum(0.0, (x[:, c:] ** 2).sum(1))) for c in cuts] for x in (a, b)]
    least = threshold - SLACK
    rows = max(1, CELLS_AT_ONCE // max(1, len(b)))
    for at in range(0, len(a), rows):
        x, rest = a[at : at + rows], [s[at : at + rows] for s in suffix[0]]
        dot, s = x[:, : cuts[0]] @ b[:, : cuts[0]].T, 0
        live = dot + rest[0][:, None] * suffix[1][0][None] >= least
        while s + 1 < len(cuts) and np.count_nonzero(live) * SPARSE > live.size:
            s += 1
            dot += x[:, cuts[s - 1] : cuts[s]] @ b[:, cuts[s - 1] : cuts[s]].T
            live &= dot + rest[s][:, None] * suffix[1][s][None] >= least
        all_i, all_j = np.nonzero(live)
        step = max(1, GATHERED // dims)
        for k in range(0, len(all_i), step):
            i, j = all_i[k : k + step], all_j[k : k + step]
            found = dot[i, j]
            for t in range(s + 1, len(cuts)):
                found = found + np.einsum("ij,ij->i", x[i, cuts[t - 1] : cuts[t]], b[j, cuts[t - 1] : cuts[t]])
                on = found + rest[t][i] * suffix[1][t][j] >= least
                i, j, found = i[on], j[on], found[on]
            if len(i):
                yield i + at, j, found


def _sure(p: np.ndarray, q: np.ndarray, dot: np.ndarray, raw: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs reach the threshold; those too near it to tell in rotated axes are measured in their own."""
    sure = dot >= threshold
    edge = np.flatnonzero(np.abs(dot - threshold) <= SLACK)
    step = max(1, GATHERED // raw.shape[1])
    for k in range(0, len(edge), step):
        e = edge[k : k + step]
        sure[e] = np.einsum("ij,ij->i", raw[p[e]], raw[q[e]]) >= threshold
    return sure


def _tiles(nodes: DataFrame, n: int) -> DataFrame:
    """(uid, w, dims, embedding, cell, kind, i, j, side): every one of n nodes once for each tile that it takes part in.

    Kind 0: block i of a cell against block j of its visitors, nodes of the cells before it; block i
    against itself where j is 0. Kind 1: blocks i and j of one cell, i < j.
    """
    c = [f"c{k}" for k in range(AXES)]
    group = ["label", "dims"]
    few = lambda df: sized(df, n)
    finest = durable(few(nodes.groupBy(*group, *c).agg(F.count("*").alias("n"))))
    wanted = F.ceil(F.log(float(GROWTH), F.sum("n") / BLOCK_ROWS) - 1e-9).cast("int")
    cut = few(finest.groupBy(*group).agg(F.greatest(F.lit(0), F.least(F.lit(AXES), wanted)).alias("k")))
    masked = [F.when(F.col("k") > i, F.col(x)).otherwise(0).cast("int").alias(f"m{i}") for i, x in enumerate(c)]
    m = [f"m{i}" for i in range(AXES)]
    of_finest = durable(few(finest.join(cut, group)).select(*group, *c, "k", *masked, "n"))
    cells = durable(few(of_finest.groupBy(*group, *m).agg(F.first("k").alias("k"), F.sum("n").alias("n"))).withColumn("cell", F.monotonically_increasing_id()))
    ahead = [o for o in product((-1, 0, 1), repeat=AXES) if o > (0,) * AXES]
    used = [max(i for i, x in enumerate(o) if x) for o in ahead]  # an offset counts where its last axis cuts
    offsets = F.array(*(F.struct(F.lit(u).alias("last"), *(F.lit(x).alias(f"o{i}") for i, x in enumerate(o))) for o, u in zip(ahead, used, strict=True)))
    moved = cells.where("k > 0").select(*group, "cell", "n", "k", *m, F.explode(offsets).alias("o")).where("o.last < k")
    moved = moved.select(*group, F.col("cell").alias("of"), F.col("n").alias("of_n"), *((F.col(f"m{i}") + F.col(f"o.o{i}")).alias(f"m{i}") for i in range(AXES)))
    steps = durable(few(moved.join(cells.select(*group, *m, "cell", "n"), [*group, *m])).select("of", "of_n", "cell", "n"))
    blocks = lambda n: F.ceil(n / BLOCK_ROWS).cast("int")
    visited = few(steps.groupBy("cell").agg(blocks(F.sum("of_n")).alias("visiting")))
    counts = durable(few(cells.select("cell", blocks(F.col("n")).alias("own")).join(visited, "cell", "left")).na.fill(0, ["visiting"]))
    # A cell has 3 ** AXES / 2 cells ahead of it at most.
    onward = few(few(steps.select("of", "cell").join(counts, "cell")).groupBy(F.col("of").alias("cell")).agg(F.collect_list(F.struct("cell", "own", "visiting")).alias("ahead")))
    plan = few(few(cells.select(*group, *m, "cell", "n").join(counts, "cell")).join(onward, "cell", "left"))
    plan = few(of_finest.drop("n").join(plan, [*group, *m])).where("n > 1 or visiting > 0 or ahead is not null").select(*group, *c, "cell", "own", "visiting", "ahead")
    mine = F.pmod(F.xxhash64("uid"), F.col("own").cast("long")).cast("int")
    plan = durable(plan)
    discard(finest, of_finest, cells, steps, counts)
    rows = nodes.select("uid", "w", *group, *c, "embedding").join(plan, [*group, *c]).withColumn("block", mine)

    def upto(n):
        return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

    def tile(cell, kind, i, j, side):
        return F.struct(cell.alias("cell"), F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), F.lit(side).alias("side"))

    cell, block, own, visiting = (F.col(x) for x in ("cell", "block", "own", "visiting"))
    visits = F.transform(
        F.coalesce("ahead", F.array().cast("array<struct<cell:bigint,own:int,visiting:int>>")),
        lambda t: F.transform(upto(t["own"]), lambda i: tile(t["cell"], 0, i, F.pmod(F.xxhash64("uid"), t["visiting"].cast("long")).cast("int"), 1)),
    )
    tiles = F.concat(
        F.transform(upto(F.greatest(F.lit(1), visiting)), lambda j: tile(cell, 0, block, j, 0)),
        F.transform(F.filter(upto(own), lambda j: j > block), lambda j: tile(cell, 1, block, j, 0)),
        F.transform(F.filter(upto(own), lambda i: i < block), lambda i: tile(cell, 1, i, block, 1)),
        F.flatten(visits),
    )
    return rows.select("uid", "w", "dims", "embedding", F.explode(tiles).alias("t")).select("uid", "w", "dims", "embedding", "t.*")


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", embedding_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row for each row of ``vectors``.

    Only vectors of equal, non-null labels and equal length are compared. Vectors
    that are null, empty, zero or hold a null or non-finite component link with
    nothing. Every row is a vector of its own: rows that repeat an id may link with
    one another, and equal vectors always do. Null ids are kept as null; a
    component's id is its smallest non-null id. Other columns are ignored.
    """
    given = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(embedding_col).alias("embedding"))
    label_kind, vector_kind, id_kind = (given.schema[c].dataType.simpleString() for c in ("label", "embedding", "vec_id"))
    # 128 bits and the length name a vector; a null element leaves no trace in a hash, but such vectors are no nodes.
    named = given.withColumns({"dims": F.size("embedding"), "h": F.xxhash64("embedding"), "g": F.xxhash64(F.lit(1), "embedding")})
    usable = named.where("label is not null and dims > 0")
    axes = principal_axes(usable, "embedding")
    shared = vectors.sparkSession.sparkContext.broadcast(axes)
    width = math.sqrt(max(2 - 2 * threshold, 0.0)) + 1e-6
    c = [f"c{k}" for k in range(AXES)]

    def place(batches):
        known = shared.value
        for b in batches:
            cells, ok = np.zeros((b.num_rows, AXES), np.int32), np.zeros(b.num_rows, bool)
            for d, rows, x in unit_vectors(b.column(2)):
                k = min(d, AXES)
                cells[rows[:, None], np.arange(k)] = np.floor((x @ known[d][:, :k] if d in known else x[:, :k]) / width)
                ok[rows] = True
            out = pa.RecordBatch.from_arrays([*b.columns, *(pa.array(cells[:, k]) for k in range(AXES))], names=[*b.schema.names, *c])
            yield out.filter(pa.array(ok))

    placed = map_rows(usable, place, f"vec_id {id_kind}, label {label_kind}, embedding {vector_kind}, dims int, h long, g long, " + ", ".join(f"{x} int" for x in c))
    key = ["label", "dims", "h", "g"]
    folded = placed.groupBy(*key).agg(F.count("*").alias("w"), F.min("vec_id").alias("least"), *(F.first(x).alias(x) for x in (*c, "embedding")))
    nodes = durable(folded.withColumn("uid", F.monotonically_increasing_id()))
    n = nodes.count()

    def compare(found):
        uid, w, side = (found.column(x).to_numpy() for x in ("uid", "w", "side"))
        (dims, _, raw), own_kind = unit_vectors(found.column("embedding").combine_chunks())[0], found.column("kind")[0].as_py() == 0
        x = raw @ shared.value[dims] if dims in shared.value else raw
        home, other = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        links, forest = np.zeros(len(uid), np.int64), Forest(len(uid))

        def join(a, b, same):
            for p, q, dot in tile_links(x[a], x[b], threshold):
                if same:
                    p, q, dot = (v[p < q] for v in (p, q, dot))
                p, q = a[p], b[q]
                on = _sure(p, q, dot, raw, threshold)
                p, q = p[on], q[on]
                for a_end, b_end in ((p, q), (q, p)):
                    links[:] += np.bincount(a_end, w[b_end], len(uid)).astype(np.int64)
                forest.union(p, q)

        if own_kind and found.column("j")[0].as_py() == 0:
            join(home, home, True)
        if len(home) and len(other):
            join(home, other, False)
        root, linked = forest.roots(), links > 0
        # A chain through a component's members: no node gets more than two edges from a tile.
        order = np.lexsort((np.arange(len(uid)), root))
        peer = uid.copy()
        chained = root[order[1:]] == root[order[:-1]]
        peer[order[1:][chained]] = uid[order[:-1][chained]]
        return pa.table({"uid": uid[linked], "links": links[linked], "peer": peer[linked]})

    found = durable(_tiles(nodes, n).groupBy("cell", "kind", "i", "j").applyInArrow(compare, "uid long, links long, peer long"))
    roots = connected_components(found, "uid", "peer")
    few = lambda df: sized(df, n)
    links = few(found.groupBy("uid").agg(F.sum("links").alias("links")))
    known = durable(
        few(few(nodes.select("uid", *key, "w", "least").join(links, "uid", "left")).join(roots.withColumnRenamed("node", "uid"), "uid", "left"))
        .select(*key, "least", (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("root", "uid").alias("root"))
    )
    of_root = few(known.groupBy("root").agg(F.min("least").alias("component_id")))
    of_node = durable(few(known.join(of_root, "root")).select(*key, "n_links", "component_id"))
    discard(nodes, found, known)
    rows = named.select("vec_id", *key).join(of_node, key, "left")
    component = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return rows.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
