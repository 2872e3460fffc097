"""Streaming ingest of points: tiles kept as Parquet, densities as a watermarked aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from terracell.errors import ValidationError
from terracell.plans.neighbours import cell


def stream_tiles(points: DataFrame, path: str, checkpoint: str, tile_size: float, origin: tuple[float, float] = (0.0, 0.0), **trigger) -> StreamingQuery:
    """Append a stream of points to tile_col/tile_row partitions; exactly once, as the file sink commits."""
    if not points.isStreaming or tile_size <= 0:
        raise ValidationError("tiles need a stream and a positive size")
    at = {"tile_col": cell(F.col("x") - F.lit(origin[0]), tile_size), "tile_row": cell(F.col("y") - F.lit(origin[1]), tile_size)}
    writer = points.withColumns(at).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy("tile_col", "tile_row")
    return (writer.trigger(**trigger) if trigger else writer).start()


def stream_density(points: DataFrame, resolution: float, time: str = "ts", window: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """(window, row, col, count) a time window and cell; rows later than ``late`` are dropped by the watermark."""
    if resolution <= 0:
        raise ValidationError("the resolution is positive")
    return points.withWatermark(time, late).groupBy(F.window(time, window), cell(F.col("y"), resolution).alias("row"), cell(F.col("x"), resolution).alias("col")).agg(F.count("*").alias("count"))
