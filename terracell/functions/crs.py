"""Map projections as column expressions: WGS 84, Web Mercator and UTM; others through pyproj where it is installed."""

from __future__ import annotations

import math
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terracell.errors import CrsError
from terracell.frame import PointFrame

# The WGS 84 ellipsoid and the UTM scale.
A, FLATTENING, SCALE = 6378137.0, 1 / 298.257223563, 0.9996
N = FLATTENING / (2 - FLATTENING)
RADIUS = A / (1 + N) * (1 + N**2 / 4 + N**4 / 64)
# Krüger's series in n to the fourth order (fixed values).
ALPHA = (N / 2 - 2 * N**2 / 3 + 5 * N**3 / 16 + 41 * N**4 / 180, 13 * N**2 / 48 - 3 * N**3 / 5 + 557 * N**4 / 1440, 61 * N**3 / 240 - 103 * N**4 / 140, 49561 * N**4 / 161280)
BETA = (N / 2 - 2 * N**2 / 3 + 37 * N**3 / 96 - N**4 / 360, N**2 / 48 + N**3 / 15 - 437 * N**4 / 1440, 17 * N**3 / 480 - 37 * N**4 / 840, 4397 * N**4 / 161280)
ECCENTRICITY = math.sqrt(FLATTENING * (2 - FLATTENING))


def _kind(crs: str) -> tuple[str, int, bool] | None:
    code = crs.upper().removeprefix("EPSG:")
    if code == "4326":
        return "lonlat", 0, False
    if code == "3857":
        return "mercator", 0, False
    if code.isdigit() and (32601 <= int(code) <= 32660 or 32701 <= int(code) <= 32760):
        return "utm", int(code) % 100, int(code) >= 32700
    return None


def _atanh(v: Column) -> Column:
    return F.ln((1 + v) / (1 - v)) / 2


def _to_lonlat(df: DataFrame, kind: tuple) -> DataFrame:
    """Adds _lon and _lat. Each step reads the columns of the one before: nested expressions would grow with their product."""
    name, zone, south = kind
    x, y = F.col("x"), F.col("y")
    if name == "lonlat":
        return df.withColumns({"_lon": x, "_lat": y})
    if name == "mercator":
        return df.withColumns({"_lon": F.degrees(x / A), "_lat": F.degrees(2 * F.atan(F.exp(y / A)) - math.pi / 2)})
    df = df.withColumns({"_xi": (y - (1e7 if south else 0.0)) / (SCALE * RADIUS), "_eta": (x - 5e5) / (SCALE * RADIUS)})
    xi1, eta1 = F.col("_xi"), F.col("_eta")
    for k, b in enumerate(BETA, 1):
        xi1 = xi1 - b * F.sin(2 * k * F.col("_xi")) * F.cosh(2 * k * F.col("_eta"))
        eta1 = eta1 - b * F.cos(2 * k * F.col("_xi")) * F.sinh(2 * k * F.col("_eta"))
    df = df.withColumns({"_xi1": xi1, "_eta1": eta1}).withColumn("_sin", F.sin("_xi1") / F.cosh("_eta1"))
    df = df.withColumn("_t1", F.col("_sin") / F.sqrt(1 - F.col("_sin") * F.col("_sin"))).withColumn("_tau", F.col("_t1"))
    # The isometric latitude's inverse: tau of the sphere, corrected by Newton steps.
    tau, t1 = F.col("_tau"), F.col("_t1")
    for _ in range(3):
        df = df.withColumn("_s", F.sinh(ECCENTRICITY * _atanh(ECCENTRICITY * tau / F.sqrt(1 + tau * tau))))
        df = df.withColumn("_ti", tau * F.sqrt(1 + F.col("_s") * F.col("_s")) - F.col("_s") * F.sqrt(1 + tau * tau))
        df = df.withColumn("_tau", tau + (t1 - F.col("_ti")) / F.sqrt(1 + F.col("_ti") * F.col("_ti")) * (1 + (1 - ECCENTRICITY**2) * tau * tau) / ((1 - ECCENTRICITY**2) * F.sqrt(1 + tau * tau)))
    return df.withColumns({"_lon": zone * 6 - 183 + F.degrees(F.atan2(F.sinh("_eta1"), F.cos("_xi1"))), "_lat": F.degrees(F.atan(tau))})


def _from_lonlat(df: DataFrame, kind: tuple) -> DataFrame:
    """Sets x and y from _lon and _lat."""
    name, zone, south = kind
    lon, lat = F.col("_lon"), F.col("_lat")
    if name == "lonlat":
        return df.withColumns({"x": lon, "y": lat})
    if name == "mercator":
        return df.withColumns({"x": A * F.radians(lon), "y": A * F.ln(F.tan(math.pi / 4 + F.radians(lat) / 2))})
    df = df.withColumns({"_sin": F.sin(F.radians(lat)), "_dl": F.radians(lon - (zone * 6 - 183))})
    df = df.withColumn("_t", F.sinh(_atanh(F.col("_sin")) - ECCENTRICITY * _atanh(ECCENTRICITY * F.col("_sin"))))
    df = df.withColumns({"_xi1": F.atan2(F.col("_t"), F.cos("_dl")), "_eta1": _atanh(F.sin("_dl") / F.sqrt(1 + F.col("_t") * F.col("_t")))})
    xi, eta = F.col("_xi1"), F.col("_eta1")
    for k, a in enumerate(ALPHA, 1):
        xi = xi + a * F.sin(2 * k * F.col("_xi1")) * F.cosh(2 * k * F.col("_eta1"))
        eta = eta + a * F.cos(2 * k * F.col("_xi1")) * F.sinh(2 * k * F.col("_eta1"))
    return df.withColumns({"x": 5e5 + SCALE * RADIUS * eta, "y": (1e7 if south else 0.0) + SCALE * RADIUS * xi})


def transform_coordinates(df: DataFrame, source: str, target: str) -> DataFrame:
    """x (east, longitude) and y (north, latitude) in another reference system; z stays."""
    if not source or not target:
        raise CrsError("both reference systems must be known")
    if source == target:
        return df
    a, b = _kind(source), _kind(target)
    if a and b:
        return _from_lonlat(_to_lonlat(df, a), b).select(*df.columns)
    try:
        from pyproj import CRS, Transformer

        CRS.from_user_input(source), CRS.from_user_input(target)
    except ImportError as e:
        raise CrsError(f"{source} to {target} needs pyproj, which is not installed") from e
    except Exception as e:
        raise CrsError(str(e)) from e

    def run(parts):
        t = Transformer.from_crs(source, target, always_xy=True)
        for p in parts:
            p["x"], p["y"] = t.transform(p.x.to_numpy(), p.y.to_numpy())
            yield p

    return df.mapInPandas(run, df.schema)


def reproject(cloud: PointFrame, target: str, source: str | None = None) -> PointFrame:
    """The cloud in another reference system; its metadata follow, other columns stay."""
    known = source or cloud.meta.crs
    if not known:
        raise CrsError("the cloud's reference system is unknown")
    return PointFrame(transform_coordinates(cloud.df, known, target), replace(cloud.meta, crs=target))


