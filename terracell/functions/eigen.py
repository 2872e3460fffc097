"""Moments of neighbourhoods and the eigen-system of a symmetric 3 x 3 matrix, as column expressions.

Moments are sums over offsets from the query point, not over raw coordinates,
so that map coordinates of millions of metres cancel before they are squared.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAIRS = ("xx", "xy", "xz", "yy", "yz", "zz")


def moment_sums(prefix: str = "d") -> list[Column]:
    """Aggregates n, s_x..s_z and s_xx..s_zz of offsets dx, dy, dz; all combine map-side."""
    firsts = [F.sum(f"{prefix}{c}").alias(f"s_{c}") for c in "xyz"]
    seconds = [F.sum(F.col(f"{prefix}{p[0]}") * F.col(f"{prefix}{p[1]}")).alias(f"s_{p}") for p in PAIRS]
    return [F.count("*").alias("n"), *firsts, *seconds]


def covariance(moments: DataFrame, sample: bool = False) -> DataFrame:
    """Adds c_xx..c_zz: population covariance, or over n - 1."""
    n = F.col("n")
    scale = n / F.greatest(n - 1, F.lit(1)) if sample else F.lit(1.0)
    return moments.withColumns({f"c_{p}": (F.col(f"s_{p}") / n - F.col(f"s_{p[0]}") / n * F.col(f"s_{p[1]}") / n) * scale for p in PAIRS})


def eigenvalues(df: DataFrame, clamp: bool = True) -> DataFrame:
    """Adds l1 >= l2 >= l3 of the matrix c_*, by the trigonometric solution of its cubic."""
    c = {p: F.col(f"c_{p}") for p in PAIRS}
    q = (c["xx"] + c["yy"] + c["zz"]) / 3
    df = df.withColumn("_q", q)
    dev = {p: (c[p] - F.col("_q") if p[0] == p[1] else c[p]) for p in PAIRS}
    p2 = dev["xx"] * dev["xx"] + dev["yy"] * dev["yy"] + dev["zz"] * dev["zz"] + 2 * (dev["xy"] * dev["xy"] + dev["xz"] * dev["xz"] + dev["yz"] * dev["yz"])
    df = df.withColumn("_p", F.sqrt(p2 / 6))
    det = dev["xx"] * (dev["yy"] * dev["zz"] - dev["yz"] * dev["yz"]) - dev["xy"] * (dev["xy"] * dev["zz"] - dev["yz"] * dev["xz"]) + dev["xz"] * (dev["xy"] * dev["yz"] - dev["yy"] * dev["xz"])
    p = F.col("_p")
    half = F.when(p > 1e-150, det / (2 * p * p * p)).otherwise(0.0)
    df = df.withColumn("_phi", F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), half))) / 3)
    l1 = F.col("_q") + 2 * p * F.cos("_phi")
    l3 = F.col("_q") + 2 * p * F.cos(F.col("_phi") + F.lit(2 * math.pi / 3))
    df = df.withColumns({"l1": l1, "l3": l3}).withColumn("l2", 3 * F.col("_q") - F.col("l1") - F.col("l3"))
    if clamp:
        df = df.withColumns({k: F.greatest(F.col(k), F.lit(0.0)) for k in ("l1", "l2", "l3")})
    return df.drop("_q", "_p", "_phi")


def least_vector(df: DataFrame, value: str = "l3", names: tuple[str, str, str] = ("nx", "ny", "nz")) -> DataFrame:
    """Adds the unit eigenvector of ``value``: the longest cross product of two rows of C - value I.

    Its sign is fixed: the component of largest magnitude is positive. Where all
    products vanish the direction isn't unique: any vector across the main axis,
    or (0, 0, 1) if there is none.
    """
    v = F.col(value)
    rows = [
        (F.col("c_xx") - v, F.col("c_xy"), F.col("c_xz")),
        (F.col("c_xy"), F.col("c_yy") - v, F.col("c_yz")),
        (F.col("c_xz"), F.col("c_yz"), F.col("c_zz") - v),
    ]

    def cross(a, b):
        return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]

    made = {}
    for k, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
        for axis, e in zip("xyz", cross(rows[i], rows[j]), strict=True):
            made[f"_{k}{axis}"] = e
    df = df.withColumns(made)
    df = df.withColumns({f"_m{k}": sum((F.col(f"_{k}{a}") * F.col(f"_{k}{a}") for a in "yz"), F.col(f"_{k}x") * F.col(f"_{k}x")) for k in range(3)})
    df = df.withColumn("_m", F.greatest("_m0", "_m1", "_m2"))
    scale = F.col("c_xx") + F.col("c_yy") + F.col("c_zz")
    unique = F.col("_m") > F.lit(1e-24) * scale * scale * scale * scale
    pick = {a: F.when(F.col("_m0") == F.col("_m"), F.col(f"_0{a}")).when(F.col("_m1") == F.col("_m"), F.col(f"_1{a}")).otherwise(F.col(f"_2{a}")) / F.sqrt("_m") for a in "xyz"}
    # Rank one: rows are along the main axis; take a vector across the first one.
    flat = F.sqrt(F.col("c_xx") * F.col("c_xx") + F.col("c_xy") * F.col("c_xy"))
    across = {"x": F.when(flat > 0, -F.col("c_xy") / flat).otherwise(0.0), "y": F.when(flat > 0, F.col("c_xx") / flat).otherwise(F.when(F.col("c_yy") > F.col("c_zz"), 0.0).otherwise(0.0)), "z": F.when(flat > 0, 0.0).otherwise(F.when(F.col("c_yy") > 0, 1.0).otherwise(1.0))}
    df = df.withColumns({f"_v{a}": F.when(unique, pick[a]).otherwise(across[a]) for a in "xyz"})
    ax, ay, az = (F.abs(f"_v{a}") for a in "xyz")
    lead = F.when((ax >= ay) & (ax >= az), F.col("_vx")).when(ay >= az, F.col("_vy")).otherwise(F.col("_vz"))
    sign = F.when(lead < 0, -1.0).otherwise(1.0)
    df = df.withColumns({n: F.col(f"_v{a}") * sign for n, a in zip(names, "xyz", strict=True)})
    return df.drop(*made, "_m", "_m0", "_m1", "_m2", "_vx", "_vy", "_vz")
