"""terracell: a PySpark-native engine for point clouds as distributed DataFrames."""

from terracell.frame import PointFrame

__all__ = ["PointFrame"]
__version__ = "0.1.0"
