"""Point-cloud files as Spark data sources: LAS, PLY and PCD through Python data sources, text natively.

``read`` and ``write`` choose by suffix. Parquet is the engine's own format and
takes pushdown, pruning and partitioning; the others are for exchange.
"""

from __future__ import annotations

import struct
from collections.abc import Callable
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from terracell.errors import CodecError, StorageError, ValidationError
from terracell.frame import Acquisition, PointFrame, platform_of
from terracell.operators.filters import exact_sample
from terracell.plans.durable import discard, durable

READABLE = (".las", ".laz", ".ply", ".pcd", ".xyz", ".txt", ".csv", ".parquet")
WRITABLE = (".las", ".laz", ".ply", ".xyz", ".txt", ".csv", ".parquet")
#: Records of a binary file that one task reads.
RECORDS = 1_000_000
#: Points that a single exchange file may hold; more go to Parquet or tiles.
MAX_FILE_POINTS = 200_000_000

# Little-endian LAS point records (fixed values of the public LAS 1.4 specification, formats 0 to 3 and 6 to 8).
_HEAD = [("X", "<i4"), ("Y", "<i4"), ("Z", "<i4"), ("intensity", "<u2")]
_OLD = [*_HEAD, ("returns", "u1"), ("classification", "u1"), ("angle", "i1"), ("user", "u1"), ("source", "<u2")]
_NEW = [*_HEAD, ("returns", "u1"), ("flags", "u1"), ("classification", "u1"), ("user", "u1"), ("angle", "<i2"), ("source", "<u2"), ("time", "<f8")]
_RGB, _TIME = [("red", "<u2"), ("green", "<u2"), ("blue", "<u2")], [("time", "<f8")]
LAS_FORMATS = {0: _OLD, 1: _OLD + _TIME, 2: _OLD + _RGB, 3: _OLD + _TIME + _RGB, 6: _NEW, 7: _NEW + _RGB, 8: [*_NEW, *_RGB, ("nir", "<u2")]}
CRS_RECORD = 2112


def las_header(path: str) -> dict:
    """What a LAS header tells; only the header and its records are read."""
    with open(path, "rb") as f:
        head = f.read(375)
        if head[:4] != b"LASF" or len(head) < 227:
            raise StorageError(f"{path} is no LAS file")
        size, offset, n_records, kind, length, old_n = struct.unpack_from("<HIIBHI", head, 94)
        scale, origin, ends = struct.unpack_from("<3d", head, 131), struct.unpack_from("<3d", head, 155), struct.unpack_from("<6d", head, 179)
        minor = head[25]
        n = struct.unpack_from("<Q", head, 247)[0] if minor >= 4 and size >= 375 else old_n
        f.seek(size)
        crs = ""
        for _ in range(n_records):
            record = f.read(54)
            if len(record) < 54:
                break
            _, number, bytes_ = struct.unpack_from("<16sHH", record, 2)
            body = f.read(bytes_)
            if number == CRS_RECORD:
                crs = body.rstrip(b"\0").decode("utf-8", "replace")
    return {"n": n, "offset": offset, "format": kind & 0x7F, "compressed": bool(kind & 0x80), "length": length, "scale": scale, "origin": origin, "low": ends[1::2], "high": ends[0::2], "crs": crs, "scanner": head[26:58].rstrip(b"\0").decode("ascii", "replace")}


class _Range(InputPartition):
    def __init__(self, lo: int, hi: int):
        super().__init__((lo, hi))


class _RangeReader(DataSourceReader):
    """Reads ranges of fixed-size records, one task each."""

    def __init__(self, path: str, n: int):
        self.path, self.n = path, n

    def partitions(self):
        return [_Range(lo, min(lo + RECORDS, self.n)) for lo in range(0, self.n, RECORDS)] or [_Range(0, 0)]

    def read(self, partition):
        lo, hi = partition.value
        for at in range(lo, hi, 65_536):
            columns = self.columns(at, min(at + 65_536, hi))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + len(columns[0]))), *map(pa.array, columns)], names=["pid", *self.names])


class LasSource(DataSource):
    """LAS 1.0 to 1.4, point formats 0 to 3 and 6 to 8, as raw scaled columns; colours stay 16-bit here."""

    names = ("x", "y", "z", "intensity", "classification", "return_number", "number_of_returns")

    @classmethod
    def name(cls):
        return "terracell_las"

    def schema(self):
        head = las_header(self.options["path"])
        colour = ", red int, green int, blue int" if "red" in dict(LAS_FORMATS.get(head["format"], [])) else ""
        return "pid long, x double, y double, z double, intensity double, classification short, return_number short, number_of_returns short" + colour

    def reader(self, schema):
        head = las_header(self.options["path"])
        if head["compressed"]:
            raise CodecError("LAZ needs a codec that is not installed")
        if head["format"] not in LAS_FORMATS:
            raise StorageError(f"point format {head['format']}")
        kind, old = np.dtype(LAS_FORMATS[head["format"]]), head["format"] < 6

        class Reader(_RangeReader):
            names = (*LasSource.names, *(("red", "green", "blue") if "red" in kind.names else ()))

            def columns(self, lo, hi):
                with open(self.path, "rb") as f:
                    f.seek(head["offset"] + lo * head["length"])
                    raw = np.frombuffer(f.read((hi - lo) * head["length"]), np.uint8)
                rows = raw[: len(raw) // head["length"] * head["length"]].reshape(-1, head["length"])[:, : kind.itemsize]
                p = np.ascontiguousarray(rows).view(kind)[:, 0]
                out = [p[c] * s + o for c, s, o in zip("XYZ", head["scale"], head["origin"], strict=True)]
                r = p["returns"].astype(np.int16)
                number, of = (r & 7, r >> 3 & 7) if old else (r & 15, r >> 4 & 15)
                c = p["classification"].astype(np.int16)
                out += [p["intensity"].astype(float), c & 31 if old else c, number, of]
                return out + [p[k].astype(np.int32) for k in ("red", "green", "blue") if k in kind.names]

        return Reader(self.options["path"], head["n"])


_PLY = {"char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2", "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8"}


def _ply_header(path: str) -> tuple[int, list[tuple[str, str]], int, bool]:
    with open(path, "rb") as f:
        if f.readline().strip() != b"ply":
            raise StorageError(f"{path} is no PLY file")
        n, fields, text, element = 0, [], True, ""
        for line in iter(f.readline, b""):
            w = line.decode("ascii", "replace").split()
            if w[:1] == ["format"]:
                text = w[1] == "ascii"
                if w[1] == "binary_big_endian":
                    raise StorageError("big-endian PLY")
            elif w[:1] == ["element"]:
                element = w[1]
                n = int(w[2]) if element == "vertex" else n
            elif w[:1] == ["property"] and element == "vertex":
                fields.append((w[-1], "<" + _PLY[w[1]]))
            elif w[:1] == ["end_header"]:
                return n, fields, f.tell(), text
    raise StorageError(f"{path} has no end_header")


def _pcd_header(path: str) -> tuple[int, list[tuple[str, str]], int, bool]:
    head, kinds = {}, {("F", "4"): "<f4", ("F", "8"): "<f8", ("U", "1"): "u1", ("U", "2"): "<u2", ("U", "4"): "<u4", ("I", "1"): "i1", ("I", "2"): "<i2", ("I", "4"): "<i4"}
    with open(path, "rb") as f:
        for line in iter(f.readline, b""):
            w = line.decode("ascii", "replace").split()
            if w and not w[0].startswith("#"):
                head[w[0].upper()] = w[1:]
            if w[:1] == ["DATA"]:
                break
        at = f.tell()
    if "FIELDS" not in head or head.get("DATA", [""])[0] not in ("ascii", "binary"):
        raise StorageError(f"{path} is no ascii or binary PCD file")
    fields = [(n, kinds[t, s]) for n, t, s in zip(head["FIELDS"], head["TYPE"], head["SIZE"], strict=True)]
    return int(head["POINTS"][0]), fields, at, head["DATA"][0] == "ascii"


class _TableSource(DataSource):
    """Points as a table of named numbers, text or little-endian, after a header."""

    def _head(self):
        raise NotImplementedError

    def _columns(self):
        names = [n for n, _ in self._head()[1]]
        out = {k: (k,) for k in "xyz"}
        out |= {k: (k, f"normal_{k[1]}") for k in ("nx", "ny", "nz")} | {k: (k,) for k in ("red", "green", "blue")} | {"intensity": ("intensity",)}
        found = {k: next((a for a in alias if a in names), None) for k, alias in out.items()}
        if "rgb" in names and not found["red"]:
            found |= {"red": "rgb", "green": "rgb", "blue": "rgb"}
        if "normal_x" in names:
            found |= {f"n{c}": f"normal_{c}" for c in "xyz"}
        return {k: v for k, v in found.items() if v}

    def schema(self):
        return "pid long, " + ", ".join(f"{k} {'short' if k in ('red', 'green', 'blue') else 'double'}" for k in self._columns())

    def reader(self, schema):
        n, fields, offset, text = self._head()
        wanted, kind = self._columns(), np.dtype(fields)
        if not n:
            raise StorageError("no points")

        class Reader(_RangeReader):
            names = tuple(wanted)

            def columns(self, lo, hi):
                with open(self.path, "rb") as f:
                    f.seek(offset)
                    if text:
                        for _ in range(lo):
                            f.readline()
                        rows = np.array([f.readline().split() for _ in range(hi - lo)], float)
                        p = {name: rows[:, k] for k, (name, _) in enumerate(fields)}
                    else:
                        f.seek(offset + lo * kind.itemsize)
                        p = np.frombuffer(f.read((hi - lo) * kind.itemsize), kind)
                return [self.value(p, k, v) for k, v in wanted.items()]

            @staticmethod
            def value(p, name, column):
                v = np.asarray(p[column])
                if column == "rgb":
                    packed = v.astype("<f4").view("<u4") if v.dtype.kind == "f" else v.astype("<u4")
                    return (packed >> {"red": 16, "green": 8, "blue": 0}[name] & 255).astype(np.int16)
                if name in ("red", "green", "blue"):
                    return (np.clip(v * 255, 0, 255) if v.dtype.kind == "f" and not text else np.clip(v, 0, 255)).astype(np.int16)
                return v.astype(float)

        return Reader(self.options["path"], n)


class PlySource(_TableSource):
    @classmethod
    def name(cls):
        return "terracell_ply"

    def _head(self):
        return _ply_header(self.options["path"])


class PcdSource(_TableSource):
    @classmethod
    def name(cls):
        return "terracell_pcd"

    def _head(self):
        return _pcd_header(self.options["path"])


def _text(spark: SparkSession, path: str) -> DataFrame:
    """x y z [intensity] by white space or commas, '#' comments; later columns are ignored. Row identity is file order."""
    lines = spark.read.text(path).withColumn("pid", F.monotonically_increasing_id())
    body = F.trim(F.regexp_replace("value", "#.*$", ""))
    rows = lines.select("pid", F.split(F.regexp_replace(body, r"^[,\s]+|[,\s]+$", ""), r"\s*,\s*|\s+").alias("v"), body.alias("b")).where("b <> ''")
    first = rows.select(F.size("v").alias("n")).first()
    if first is None:
        raise StorageError(f"{path} has no points")
    if first.n < 3:
        raise StorageError(f"{path} has under three columns")
    columns = [F.col("v")[k].cast("double").alias(c) for k, c in enumerate("xyz")]
    return rows.select("pid", *columns, *([F.col("v")[3].cast("double").alias("intensity")] if first.n > 3 else []))


def read(spark: SparkSession, path: str, platform: str | None = None, subsample: float | None = None, seed: int = 0) -> PointFrame:
    """A cloud from a file, by its suffix. ``subsample`` keeps exactly max(1, int(n * subsample)) points."""
    remote = "://" in path
    if not remote and not Path(path).exists():
        raise StorageError(f"no file {path}")
    if subsample is not None and not 0 < subsample <= 1:
        raise ValidationError("subsample is over 0 and at most 1")
    suffix = Path(path).suffix.lower()
    if suffix not in READABLE:
        raise ValidationError(f"can't read {suffix or 'a file without suffix'}")
    meta = Acquisition(platform=platform_of(platform))
    if suffix == ".parquet":
        df = spark.read.parquet(path)
    elif suffix in (".las", ".laz"):
        head = las_header(path)
        if head["compressed"]:
            raise CodecError("LAZ needs a codec that is not installed")
        spark.dataSource.register(LasSource)
        df = spark.read.format("terracell_las").option("path", path).load()
        if "red" in df.columns:
            top = df.agg(F.greatest(F.max("red"), F.max("green"), F.max("blue"), F.lit(1))).first()[0]
            df = df.withColumns({c: F.floor(F.col(c) * F.lit(255.0 / top)).cast("short") for c in ("red", "green", "blue")})
        meta = Acquisition(platform=platform_of(platform), scanner_model=head["scanner"], crs=head["crs"])
    elif suffix in (".ply", ".pcd"):
        source = PlySource if suffix == ".ply" else PcdSource
        spark.dataSource.register(source)
        df = spark.read.format(source.name()).option("path", path).load()
    else:
        df = _text(spark, path)
    cloud = PointFrame(df, meta)
    if subsample is not None and subsample < 1:
        n = cloud.nonempty(StorageError).n
        cloud = cloud.with_df(exact_sample(df, max(1, int(n * subsample)), seed))
    return cloud


def read_tiled(spark: SparkSession, path: str, bbox: tuple[float, float, float, float] | None = None, tile_size: float | None = None, origin: tuple[float, float] | None = None, resolution: float | None = None, max_points: int | None = None, platform: str | None = None, seed: int = 42) -> PointFrame:
    """A window of a tiled Parquet cloud: an inclusive (xmin, ymin, xmax, ymax), thinned to voxels, cut to a number of points.

    With the tiling's origin and size the window also prunes partitions.
    """
    from terracell.operators.filters import voxel_downsample

    df = spark.read.parquet(path)
    if bbox is not None:
        if len(bbox) != 4 or bbox[0] > bbox[2] or bbox[1] > bbox[3]:
            raise ValidationError("a window is xmin, ymin, xmax, ymax")
        df = df.where(F.col("x").between(float(bbox[0]), float(bbox[2])) & F.col("y").between(float(bbox[1]), float(bbox[3])))
        if tile_size and origin:
            lo, hi = [int((bbox[k] - origin[k]) // tile_size) for k in (0, 1)], [int((bbox[k + 2] - origin[k]) // tile_size) for k in (0, 1)]
            df = df.where(F.col("tile_col").between(lo[0] - 1, hi[0]) & F.col("tile_row").between(lo[1] - 1, hi[1]))
    cloud = PointFrame(df.drop("tile_col", "tile_row"), Acquisition(platform=platform_of(platform)))
    if resolution:
        cloud = voxel_downsample(cloud, resolution)
    return cloud if max_points is None else cloud.with_df(exact_sample(cloud.df, max_points, seed))


def tiled_metadata(spark: SparkSession, path: str) -> DataFrame:
    """One row: count, bounds and columns of a Parquet cloud; min, max and count come from file statistics where the reader allows."""
    df = spark.read.parquet(path)
    return df.agg(F.count("*").alias("n_points"), *(f(c).alias(f"{c}_{f.__name__}") for c in "xyz" for f in (F.min, F.max))).withColumn("columns", F.lit(",".join(df.columns)))


#: Points that a task encodes, and those of a batch of it.
TASK_POINTS, BATCH_POINTS = 250_000, 20_000


def _encoded(cloud: PointFrame, columns: list[str], path: str, head: bytes, encode: Callable[[dict[str, np.ndarray]], bytes]) -> None:
    """A file of ``head`` and of every point, by pid, as ``encode`` makes bytes of columns.

    Executors sort and encode; the driver holds one batch's bytes at a time and appends them to the file.
    """
    n = cloud.nonempty(StorageError).n
    if n > MAX_FILE_POINTS:
        raise StorageError(f"{n} points in one file; write Parquet or tiles")
    parts = -(-n // TASK_POINTS)

    def run(batches):
        part, k = TaskContext.get().partitionId(), 0
        for b in batches:
            for at in range(0, b.num_rows, BATCH_POINTS):
                rows = b.slice(at, BATCH_POINTS)
                body = encode({c: rows.column(c).to_numpy(zero_copy_only=False) for c in columns})
                yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([k]), pa.array([body], pa.binary())], names=["part", "k", "body"])
                k += 1

    df = cloud.df.select("pid", *columns).repartitionByRange(parts, "pid").sortWithinPartitions("pid")
    held = durable(df.mapInArrow(run, "part long, k long, body binary"))
    try:
        with open(path, "wb") as f:
            f.write(head)
            for part in range(parts):
                for row in held.where(F.col("part") == part).orderBy("k").select("body").toLocalIterator():
                    f.write(row.body)
    finally:
        discard(held)


def _packed(kind: np.dtype, fill: Callable[[dict[str, np.ndarray], np.ndarray], None]) -> Callable[[dict[str, np.ndarray]], bytes]:
    """An encoder of fixed-size records."""

    def encode(p: dict[str, np.ndarray]) -> bytes:
        out = np.zeros(len(p["x"]), kind)
        fill(p, out)
        return out.tobytes()

    return encode


def _write_las(cloud: PointFrame, path: str) -> None:
    rgb = cloud.has("red")
    extra = [c for c in ("intensity", "classification", "return_number", "number_of_returns") if cloud.has(c)]
    columns = ["x", "y", "z", *extra, *(["red", "green", "blue"] if rgb else [])]
    kind, ends = np.dtype(LAS_FORMATS[2 if rgb else 0]), cloud.nonempty(StorageError)
    n, low = ends.n, [float(v) for v in ends.low]
    scale = 65535 if "intensity" in extra and cloud.df.agg(F.max("intensity")).first()[0] <= 1 else 1

    def fill(p: dict[str, np.ndarray], out: np.ndarray) -> None:
        for c, o in zip("xyz", low, strict=True):
            out[c.upper()] = np.round((p[c] - o) / 0.001)
        if "intensity" in extra:
            out["intensity"] = np.clip(p["intensity"] * scale, 0, 65535)
        if "classification" in extra:
            out["classification"] = p["classification"].astype(int) & 31
        one = np.ones(len(out), int)
        number, of = (p[c].astype(int) if c in extra else one for c in ("return_number", "number_of_returns"))
        out["returns"] = np.minimum(number, 7) | np.minimum(of, 7) << 3
        for c in ("red", "green", "blue") if rgb else ():
            out[c] = p[c].astype(int) * 257

    bounds = [float(v) for k in range(3) for v in (ends.high[k], ends.low[k])]
    wkt = cloud.meta.crs.encode()
    record = struct.pack("<H16sHH32s", 0, b"LASF_Projection", CRS_RECORD, len(wkt) + 1, b"WKT") + wkt + b"\0" if wkt else b""
    head = bytearray(375)
    struct.pack_into("<4sHH", head, 0, b"LASF", 0, 16 if wkt else 0)
    head[24:26] = bytes((1, 4))
    struct.pack_into("<32s32sHHHIIBHI", head, 26, cloud.meta.scanner_model.encode()[:32], b"terracell", 1, 2000, 375, 375 + len(record), 1 if wkt else 0, 2 if rgb else 0, kind.itemsize, n)
    struct.pack_into("<3d3d6d", head, 131, 0.001, 0.001, 0.001, *low, *bounds)
    struct.pack_into("<Q", head, 247, n)
    _encoded(cloud, columns, path, bytes(head) + record, _packed(kind, fill))


def _write_ply(cloud: PointFrame, path: str) -> None:
    columns = [("x", "double"), ("y", "double"), ("z", "double")]
    columns += [(c, "double") for c in ("nx", "ny", "nz") if cloud.has(c)] + [(c, "uchar") for c in ("red", "green", "blue") if cloud.has(c)]
    n, kind = cloud.nonempty(StorageError).n, np.dtype([(c, "<" + _PLY[k]) for c, k in columns])

    def fill(p: dict[str, np.ndarray], out: np.ndarray) -> None:
        for c, _ in columns:
            out[c] = p[c]

    head = ["ply", "format binary_little_endian 1.0", f"element vertex {n}", *(f"property {k} {c}" for c, k in columns), "end_header", ""]
    _encoded(cloud, [c for c, _ in columns], path, "\n".join(head).encode(), _packed(kind, fill))


def _write_text(cloud: PointFrame, path: str, separator: str) -> None:
    columns = ["x", "y", "z", *(["intensity"] if cloud.has("intensity") else [])]
    line = separator.join(["%.6f"] * len(columns)) + "\n"

    def encode(p: dict[str, np.ndarray]) -> bytes:
        values = np.stack([p[c].astype(float) for c in columns], axis=1)
        return (line * len(values) % tuple(values.ravel().tolist())).encode()

    _encoded(cloud, columns, path, f"# {separator.join(columns)}\n".encode(), encode)


def write_text(cloud: PointFrame, path: str, separator: str = " ") -> None:
    """A folder of text parts, written by the executors: for clouds too large for a file."""
    columns = ["x", "y", "z", *(["intensity"] if cloud.has("intensity") else [])]
    cloud.df.select(F.concat_ws(separator, *(F.format_string("%.6f", c) for c in columns))).write.text(path)


def write(cloud: PointFrame, path: str, compress: bool | None = None) -> None:
    """A file of the suffix's format; Parquet is a folder, written by the executors."""
    suffix = Path(path).suffix.lower()
    if suffix not in WRITABLE:
        raise ValidationError(f"can't write {suffix or 'a file without suffix'}")
    if suffix == ".laz" or suffix == ".las" and compress:
        raise CodecError("LAZ needs a codec that is not installed")
    try:
        if suffix == ".parquet":
            cloud.df.write.parquet(path)
        elif suffix == ".las":
            _write_las(cloud, path)
        elif suffix == ".ply":
            _write_ply(cloud, path)
        else:
            _write_text(cloud, path, "," if suffix == ".csv" else " ")
    except OSError as e:
        raise StorageError(str(e)) from e


def from_arrays(spark: SparkSession, xyz: np.ndarray, meta: Acquisition | None = None, **columns) -> PointFrame:
    """A cloud from NumPy arrays, validated as they are taken; pid is the row number."""
    import pandas as pd

    xyz = np.asarray(xyz, float)
    if xyz.ndim != 2 or xyz.shape[1] != 3:
        raise ValidationError("coordinates are n x 3")
    data = {"pid": np.arange(len(xyz)), **{c: xyz[:, k] for k, c in enumerate("xyz")}}
    for name, v in columns.items():
        v = np.asarray(v)
        if len(v) != len(xyz) or v.ndim != 1:
            raise ValidationError(f"{name} needs {len(xyz)} values")
        data[name] = v.astype(np.int16) if v.dtype.kind in "ub" else v
    schema = ", ".join(f"{k} {'long' if k == 'pid' else 'double' if np.asarray(v).dtype.kind == 'f' else 'short'}" for k, v in data.items())
    return PointFrame(spark.createDataFrame(pd.DataFrame(data), schema), meta or Acquisition())
