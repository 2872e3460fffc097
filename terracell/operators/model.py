"""Point-wise model inference: features as columns, sessions on executors."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terracell.errors import ModelError
from terracell.frame import PointFrame

CLASS_NAMES = ("unlabeled", "ground", "low vegetation", "medium vegetation", "high vegetation", "building", "water", "bridge", "vehicle")


def prepare_features(cloud: PointFrame, use_rgb: bool = True, use_intensity: bool = True, use_normals: bool = False, normalize: bool = True) -> DataFrame:
    """(pid, features): float32 xyz, about its mean and by its largest radius, then rgb / 255, intensity / max, normals."""
    cloud.nonempty(ModelError)
    xyz = [F.col(c) for c in "xyz"]
    if normalize:
        mean = cloud.centroid().first()
        xyz = [F.col(c) - F.lit(m) for c, m in zip("xyz", mean, strict=True)]
        radius = cloud.df.agg(F.max(F.sqrt(reduce(lambda a, b: a + b, (e * e for e in xyz))))).first()[0]
        xyz = [e / F.lit(radius) for e in xyz] if radius > 0 else xyz
    out = list(xyz)
    if use_rgb and cloud.has("red"):
        out += [F.col(c) / F.lit(255.0) for c in ("red", "green", "blue")]
    if use_intensity and cloud.has("intensity"):
        top = (cloud.df.agg(F.max("intensity")).first()[0] or 0.0) if normalize else 0.0
        out.append(F.col("intensity") / F.lit(float(top)) if normalize and top > 0 else F.col("intensity"))
    if use_normals and cloud.has("nx"):
        out += [F.col(c) for c in ("nx", "ny", "nz")]
    return cloud.df.select("pid", F.array(*(e.cast("float") for e in out)).alias("features"))


def onnx_session(path: str) -> Callable[[np.ndarray], np.ndarray]:
    try:
        import onnxruntime
    except ImportError as e:
        raise ModelError("ONNX models need onnxruntime") from e
    session = onnxruntime.InferenceSession(path, providers=["CPUExecutionProvider"])
    name = session.get_inputs()[0].name
    return lambda x: np.asarray(session.run(None, {name: x[None]})[0])[0]


def _field(number: int, value: int | bytes | str) -> bytes:
    """A field of the protocol buffer format: a varint, or a length and bytes."""

    def varint(n: int) -> bytes:
        out = b""
        while n > 127:
            out, n = out + bytes((n & 127 | 128,)), n >> 7
        return out + bytes((n,))

    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    data = value.encode() if isinstance(value, str) else value
    return varint(number << 3 | 2) + varint(len(data)) + data


def linear_onnx(weights: np.ndarray, bias: np.ndarray) -> bytes:
    """An ONNX model: scores = features @ weights + bias, of (1, points, features)."""

    def tensor(name: str, a: np.ndarray) -> bytes:
        return b"".join(_field(1, n) for n in a.shape) + _field(2, 1) + _field(8, name) + _field(9, np.ascontiguousarray(a, "<f4").tobytes())

    def value(name: str, last: int) -> bytes:
        dims = b"".join(_field(1, d) for d in (_field(1, 1), _field(2, "points"), _field(1, last)))
        return _field(1, name) + _field(2, _field(1, _field(1, 1) + _field(2, dims)))

    def node(kind: str, inputs: tuple, output: str) -> bytes:
        return b"".join(_field(1, i) for i in inputs) + _field(2, output) + _field(4, kind)

    w, b = np.atleast_2d(weights), np.atleast_1d(bias)
    graph = _field(1, node("MatMul", ("x", "w"), "m")) + _field(1, node("Add", ("m", "b"), "y")) + _field(2, "linear") + _field(5, tensor("w", w)) + _field(5, tensor("b", b))
    graph += _field(11, value("x", w.shape[0])) + _field(12, value("y", w.shape[1]))
    return _field(1, 8) + _field(7, graph) + _field(8, _field(2, 13))


def torch_session(path: str) -> Callable[[np.ndarray], np.ndarray]:
    try:
        import torch
    except ImportError as e:
        raise ModelError("TorchScript models need torch, which is not installed") from e
    model = torch.jit.load(path, map_location="cpu").eval()

    def run(x: np.ndarray) -> np.ndarray:
        with torch.no_grad():
            return torch.softmax(model(torch.from_numpy(x[None])), -1).numpy()[0]

    return run


BACKENDS: dict[str, Callable[[str], Callable[[np.ndarray], np.ndarray]]] = {"onnx": onnx_session, "torch": torch_session}


def predict_semantic(cloud: PointFrame, model_path: str, backend: str = "onnx", batch_size: int = 4096, class_names: tuple[str, ...] = CLASS_NAMES, **features) -> DataFrame:
    """(pid, label, class_name, probabilities): one session a task, batches of ``batch_size`` points, the likeliest class."""
    if backend not in BACKENDS:
        raise ModelError(f"unknown backend {backend}")
    if not Path(model_path).exists():
        raise ModelError(f"no model {model_path}")
    return predict_with(prepare_features(cloud, **features), lambda: BACKENDS[backend](model_path), batch_size, class_names)


def predict_with(features: DataFrame, open_session: Callable[[], Callable[[np.ndarray], np.ndarray]], batch_size: int = 4096, class_names: tuple[str, ...] = CLASS_NAMES) -> DataFrame:
    """Predictions of any session, from (pid, features)."""

    def run(batches):
        session = open_session()
        for b in batches:
            x = np.stack(b.column(1).to_numpy(zero_copy_only=False)).astype(np.float32) if b.num_rows else np.zeros((0, 1), np.float32)
            out = [session(x[at : at + batch_size]) for at in range(0, len(x), batch_size)]
            p = np.concatenate(out).astype(np.float32) if out else np.zeros((0, 1), np.float32)
            label = p.argmax(1).astype(np.int32)
            names = [class_names[k] if k < len(class_names) else str(k) for k in label]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(label), pa.array(names, pa.string()), pa.array(list(p), pa.list_(pa.float32()))], names=["pid", "label", "class_name", "probabilities"])

    return features.select("pid", "features").mapInArrow(run, "pid long, label int, class_name string, probabilities array<float>")
