"""Rasters as square blocks of cells, for stencils that no window function expresses.

A block is a row: its place and, for every layer, the bytes of an array. A sweep
sends each block's margins to the blocks around it and calls a function of the
block with its halo; nothing larger than a block and its halo is ever in one
place, whatever the raster's extent.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terracell.plans.grid import GridSpec

#: Cells of a block's side.
SIDE = 512

Layers = dict[str, np.ndarray]


def _span(block: int, n: int, side: int) -> tuple[int, int]:
    return block * side, min(n, (block + 1) * side)


def to_blocks(cells: DataFrame, grid: GridSpec, layers: dict[str, float], side: int | None = None) -> DataFrame:
    """(br, bc, layer...): every block of the grid, from rows (row, col, layer...); cells without a row have the layer's default."""
    side = side or SIDE
    spark, names = cells.sparkSession, list(layers)
    nbr, nbc = -(-grid.ny // side), -(-grid.nx // side)

    def gather(rows: pa.Table) -> pa.Table:
        br, bc = rows.column("br")[0].as_py(), rows.column("bc")[0].as_py()
        (r0, r1), (c0, c1) = _span(br, grid.ny, side), _span(bc, grid.nx, side)
        known = np.flatnonzero(rows.column("row").is_valid().to_numpy())
        at = rows.column("row").to_numpy(zero_copy_only=False)[known].astype(np.int64) - r0, rows.column("col").to_numpy(zero_copy_only=False)[known].astype(np.int64) - c0
        out = {"br": [br], "bc": [bc]}
        for n in names:
            a = np.full((r1 - r0, c1 - c0), layers[n], float)
            a[at] = rows.column(n).to_numpy(zero_copy_only=False)[known]
            out[n] = [a.tobytes()]
        return pa.table(out, schema=pa.schema([("br", pa.int64()), ("bc", pa.int64()), *((n, pa.binary()) for n in names)]))

    own = cells.select(F.floor(F.col("row") / side).alias("br"), F.floor(F.col("col") / side).alias("bc"), "row", "col", *(F.col(n).cast("double").alias(n) for n in names))
    every = spark.range(nbr * nbc).select(F.expr(f"id div {nbc}").alias("br"), (F.col("id") % nbc).alias("bc"), *(F.lit(None).cast("long").alias(x) for x in ("row", "col")), *(F.lit(None).cast("double").alias(n) for n in names))
    return own.unionByName(every).groupBy("br", "bc").applyInArrow(gather, "br long, bc long, " + ", ".join(f"{n} binary" for n in names))


def sweep(blocks: DataFrame, grid: GridSpec, layers: list[str], halo: int, f: Callable[[Layers, tuple[slice, slice], tuple[int, int]], dict], out: list[str], numbers: str = "", side: int | None = None) -> DataFrame:
    """Apply ``f`` to each block with up to ``halo`` cells around it.

    ``f(arrays, core, corner)`` sees the layers with their halo (cut at the raster's
    edge), where the block lies in them, and the (row, col) of their first cell. It
    returns arrays of the block's own shape for ``out`` and values for ``numbers``
    (a DDL list). Other layers are carried along.
    """
    side = side or SIDE
    if halo > side:
        raise ValueError("a halo is no wider than a block")
    nbr, nbc = -(-grid.ny // side), -(-grid.nx // side)
    carried = [c for c in blocks.columns if c not in ("br", "bc", *out) and c not in [n.split()[0] for n in numbers.split(", ") if n]]
    sent = [("br", pa.int64()), ("bc", pa.int64()), ("dr", pa.int32()), ("dc", pa.int32()), *((n, pa.binary()) for n in dict.fromkeys([*layers, *carried]))]

    def shape(br: int, bc: int) -> tuple[int, int]:
        (r0, r1), (c0, c1) = _span(br, grid.ny, side), _span(bc, grid.nx, side)
        return r1 - r0, c1 - c0

    def margins(batches):
        for b in batches:
            for k in range(b.num_rows):
                row = {c: b.column(c)[k].as_py() for c in b.schema.names}
                br, bc = row["br"], row["bc"]
                rows: dict[str, list] = {n: [] for n, _ in sent}
                arrays = {n: np.frombuffer(row[n]).reshape(shape(br, bc)) for n in layers}
                for dr in (-1, 0, 1):
                    for dc in (-1, 0, 1):
                        if not (0 <= br + dr < nbr and 0 <= bc + dc < nbc) or (halo == 0 and (dr or dc)):
                            continue
                        near = [slice(None) if d == 0 else slice(-halo, None) if d > 0 else slice(0, halo) for d in (dr, dc)]
                        whole = dr == dc == 0
                        for n, v in (("br", br + dr), ("bc", bc + dc), ("dr", dr), ("dc", dc)):
                            rows[n].append(v)
                        for n in dict.fromkeys([*layers, *carried]):
                            rows[n].append(row[n] if whole else arrays[n][near[0], near[1]].tobytes() if n in arrays else None)
                yield pa.RecordBatch.from_arrays([pa.array(rows[n], t) for n, t in sent], names=[n for n, _ in sent])

    kinds = {"long": pa.int64(), "double": pa.float64(), "array<double>": pa.list_(pa.float64()), "boolean": pa.bool_()}
    extra = [tuple(n.split()) for n in numbers.split(", ") if n]
    schema = [("br", pa.int64()), ("bc", pa.int64()), *((n, pa.binary()) for n in [*carried, *out]), *((n, kinds[t]) for n, t in extra)]

    def run(rows: pa.Table) -> pa.Table:
        found = {(r["dr"], r["dc"]): r for r in rows.to_pylist()}
        home = found[0, 0]
        br, bc = home["br"], home["bc"]
        (r0, r1), (c0, c1) = _span(br, grid.ny, side), _span(bc, grid.nx, side)
        top, left = max(0, r0 - halo), max(0, c0 - halo)
        bottom, right = min(grid.ny, r1 + halo), min(grid.nx, c1 + halo)
        arrays = {n: np.empty((bottom - top, right - left)) for n in layers}
        for (dr, dc), r in found.items():
            rows_ = slice(r0 - top, r1 - top) if dr == 0 else slice(0, r0 - top) if dr > 0 else slice(r1 - top, bottom - top)
            cols_ = slice(c0 - left, c1 - left) if dc == 0 else slice(0, c0 - left) if dc > 0 else slice(c1 - left, right - left)
            for n in layers:
                part = arrays[n][rows_, cols_]
                arrays[n][rows_, cols_] = np.frombuffer(r[n]).reshape(part.shape)
        core = slice(r0 - top, r1 - top), slice(c0 - left, c1 - left)
        result = f(arrays, core, (top, left))
        row = {"br": br, "bc": bc, **{n: home[n] for n in carried}, **{n: np.ascontiguousarray(result[n], float).tobytes() for n in out}, **{n: result[n] for n, _ in extra}}
        return pa.table({n: [row[n]] for n, _ in schema}, schema=pa.schema(schema))

    ddl = ", ".join(["br long", "bc long", *(f"{n} binary" for n in [*carried, *out]), *(f"{n} {t}" for n, t in extra)])
    strips = blocks.mapInArrow(margins, "br long, bc long, dr int, dc int, " + ", ".join(f"{n} binary" for n, _ in sent[4:]))
    return strips.groupBy("br", "bc").applyInArrow(run, ddl)


def to_cells(blocks: DataFrame, grid: GridSpec, layers: list[str], side: int | None = None) -> DataFrame:
    """(row, col, layer...) of every cell."""
    side = side or SIDE

    def spread(batches):
        for b in batches:
            for k in range(b.num_rows):
                (r0, r1), (c0, c1) = _span(b.column(0)[k].as_py(), grid.ny, side), _span(b.column(1)[k].as_py(), grid.nx, side)
                rows, cols = np.divmod(np.arange((r1 - r0) * (c1 - c0)), c1 - c0)
                arrays = [pa.array(rows + r0, pa.int64()), pa.array(cols + c0, pa.int64()), *(pa.array(np.frombuffer(b.column(2 + i)[k].as_py())) for i in range(len(layers)))]
                yield pa.RecordBatch.from_arrays(arrays, names=["row", "col", *layers])

    return blocks.select("br", "bc", *layers).mapInArrow(spread, "row long, col long, " + ", ".join(f"{n} double" for n in layers))
