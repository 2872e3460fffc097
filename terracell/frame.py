"""A point cloud: a DataFrame with one row a point, and how it was acquired."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terracell.errors import ValidationError

PLATFORMS = ("unknown", "aerial", "terrestrial", "uav")
GROUND_CLASS, UNASSIGNED_CLASS = 2, 1
OPTIONAL = ("intensity", "classification", "red", "green", "blue", "nx", "ny", "nz", "return_number", "number_of_returns")


@dataclass(frozen=True)
class ScanPosition:
    x: float
    y: float
    z: float
    roll: float = 0.0
    pitch: float = 0.0
    yaw: float = 0.0
    scan_id: str = ""


@dataclass(frozen=True)
class Acquisition:
    """Metadata of a survey; kept on the driver, never a column."""

    platform: str = "unknown"
    scanner_model: str = ""
    scan_date: str = ""
    crs: str = ""
    density: float | None = None
    scan_positions: tuple[ScanPosition, ...] = ()
    flight_altitude: float | None = None
    scan_angles: tuple[float, float] | None = None
    photogrammetric: bool = False


def platform_of(name: str | None) -> str:
    """Lower-cased platform; an unheard-of name is 'unknown'."""
    name = (name or "").lower()
    return name if name in PLATFORMS else "unknown"


@dataclass(frozen=True)
class Bounds:
    n: int
    low: tuple[float, float, float]
    high: tuple[float, float, float]

    def extent(self, axis: int) -> float:
        return self.high[axis] - self.low[axis]


@dataclass(frozen=True, eq=False)
class PointFrame:
    """``df`` has pid, x, y, z and any of OPTIONAL. Operations return new frames; rows have no order, ties go to the lowest pid."""

    df: DataFrame
    meta: Acquisition = field(default_factory=Acquisition)

    def __post_init__(self):
        if missing := {"pid", "x", "y", "z"} - set(self.df.columns):
            raise ValidationError(f"a cloud needs columns {sorted(missing)}")
        for group in (("red", "green", "blue"), ("nx", "ny", "nz")):
            if 0 < len(set(group) & set(self.df.columns)) < 3:
                raise ValidationError(f"columns {group} come together")

    def with_df(self, df: DataFrame) -> PointFrame:
        return replace(self, df=df)

    def has(self, *columns: str) -> bool:
        return set(columns) <= set(self.df.columns)

    def require(self, *columns: str, error: type[Exception] = ValidationError) -> None:
        """A schema check: launches no job."""
        if not self.has(*columns):
            raise error(f"the cloud has no {', '.join(c for c in columns if c not in self.df.columns)}")

    @cached_property
    def bounds(self) -> Bounds | None:
        """Count and box of the cloud, one aggregate, computed once; None if empty."""
        row = self.df.agg(F.count("*").alias("n"), *(f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in "xyz")).first()
        return Bounds(row.n, tuple(row[f"min_{c}"] for c in "xyz"), tuple(row[f"max_{c}"] for c in "xyz")) if row.n else None

    def nonempty(self, error: type[Exception] = ValidationError) -> Bounds:
        if self.bounds is None:
            raise error("the cloud is empty")
        return self.bounds

    def centroid(self) -> DataFrame:
        return self.df.agg(*(F.avg(c).alias(c) for c in "xyz"))

    def filter(self, condition: Column | str) -> PointFrame:
        return self.with_df(self.df.where(condition))

    def ground_points(self) -> PointFrame:
        self.require("classification")
        return self.filter(F.col("classification") == GROUND_CLASS)

    def first_returns(self) -> PointFrame:
        self.require("return_number")
        return self.filter(F.col("return_number") == 1)

    def pipe(self, operator: Callable, *args, **kwargs):
        return operator(self, *args, **kwargs)


def optional_columns(df: DataFrame) -> list[str]:
    return [c for c in OPTIONAL if c in df.columns]
