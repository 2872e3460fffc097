"""Colours: from images, and of segments for a viewer."""

from __future__ import annotations

import colorsys

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terracell.errors import CodecError, StorageError, ValidationError
from terracell.frame import PointFrame


def image_table(cloud: PointFrame, image: np.ndarray) -> DataFrame:
    """(_row, _col, r, g, b) of an image on the driver."""
    image = np.asarray(image)
    if image.ndim != 3 or image.shape[2] < 3:
        raise ValidationError("an image is rows x columns x 3")
    rows, cols = np.indices(image.shape[:2])
    return cloud.df.sparkSession.createDataFrame(pd.DataFrame({"_row": rows.ravel().astype("int64"), "_col": cols.ravel().astype("int64"), **{c: image[..., k].ravel().astype("int16") for k, c in enumerate("rgb")}}))


def colorize_from_table(cloud: PointFrame, pixels: DataFrame, transform: tuple, nodata_color: tuple[int, int, int] = (0, 0, 0), truncate: bool = False) -> PointFrame:
    """red, green, blue of the pixel under each point: an equi-join on pixel row and column; outside, ``nodata_color``.

    transform: x step, row skew, x origin, column skew, y step, y origin. All other
    columns stay. ``truncate`` rounds pixel positions toward zero instead of down.
    """
    if len(transform) != 6 or not transform[0] or not transform[4]:
        raise ValidationError("a transform is six numbers with steps that aren't zero")
    at = {"_col": (F.col("x") - F.lit(float(transform[2]))) / F.lit(float(transform[0])), "_row": (F.col("y") - F.lit(float(transform[5]))) / F.lit(float(transform[4]))}
    toward = (lambda e: F.when(e < 0, F.ceil(e)).otherwise(F.floor(e))) if truncate else F.floor
    base = cloud.df.drop("red", "green", "blue").withColumns({k: toward(e).cast("long") for k, e in at.items()})
    out = base.join(pixels, ["_row", "_col"], "left")
    colours = {n: F.coalesce(F.col(c), F.lit(v)).cast("short") for n, c, v in zip(("red", "green", "blue"), "rgb", nodata_color, strict=True)}
    return cloud.with_df(out.withColumns(colours).drop("_row", "_col", "r", "g", "b"))


def colorize_from_array(cloud: PointFrame, image: np.ndarray, transform: tuple, nodata_color: tuple[int, int, int] = (0, 0, 0), truncate: bool = False) -> PointFrame:
    return colorize_from_table(cloud, image_table(cloud, image), transform, nodata_color, truncate)


def colorize_from_raster(cloud: PointFrame, path: str, band_order: tuple[int, int, int] = (1, 2, 3)) -> PointFrame:
    """Colours from three bands of a raster file in the cloud's reference system."""
    try:
        import rasterio
    except ImportError as e:
        raise CodecError("raster files need rasterio, which is not installed") from e
    try:
        with rasterio.open(path) as f:
            image, t = np.stack([f.read(b) for b in band_order], -1).astype(np.uint8), f.transform
    except Exception as e:
        raise StorageError(str(e)) from e
    return colorize_from_array(cloud, image, (t.a, t.b, t.c, t.d, t.e, t.f))


def segment_colors(labels: DataFrame) -> DataFrame:
    """``labels`` with red, green, blue: a hue for each label, evenly spaced; grey noise."""
    n = labels.agg(F.max("label")).first()[0]
    n = 1 if n is None else max(1, n + 1)
    h = F.col("label") / F.lit(n) * 6
    sector, part = F.floor(h) % 6, h - F.floor(h)
    s, v = 0.8, 0.9
    p, q, t = F.lit(v * (1 - s)), v * (1 - s * part), v * (1 - s * (1 - part))
    v = F.lit(v)
    order = ((v, t, p), (q, v, p), (p, v, t), (p, q, v), (t, p, v), (v, p, q))

    def channel(k: int):
        e = F.when(sector == 0, order[0][k])
        for i in range(1, 6):
            e = e.when(sector == i, order[i][k])
        return F.when(F.col("label") < 0, F.lit(0.5)).otherwise(e)

    return labels.withColumns({c: F.floor(channel(k) * 255).cast("short") for k, c in enumerate(("red", "green", "blue"))})


def segment_color(label: int, n: int) -> tuple[float, float, float]:
    return (0.5, 0.5, 0.5) if label < 0 else colorsys.hsv_to_rgb(label / max(1, n), 0.8, 0.9)


def view(clouds: list[PointFrame], max_points: int = 1_000_000, labels: list[DataFrame] | None = None) -> list[pd.DataFrame]:
    """Point tables for any viewer, one a cloud, thinned to ``max_points`` each; clusters have no screen."""
    from terracell.operators.filters import exact_sample

    if not clouds:
        raise ValueError("nothing to show")
    if labels is not None and len(labels) != len(clouds):
        raise ValueError("labels for each cloud")
    out = []
    for k, c in enumerate(clouds):
        df = exact_sample(c.df, max_points)
        out.append((segment_colors(df.drop("red", "green", "blue").join(labels[k], "pid")) if labels else df).orderBy("pid").toPandas())
    return out
