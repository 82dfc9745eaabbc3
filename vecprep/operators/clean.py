"""Zero removal and normalization."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vector as V
from ..schema import require
from .order import reordinal


def remove_zeros(df: DataFrame, tolerance: float = V.ZERO_TOLERANCE, vec: str = "vec", ord: str = "ord", check: bool = True) -> DataFrame:
    """Vectors whose norm exceeds the tolerance, numbered anew; an error if none remains (``check``)."""
    if tolerance < 0:
        raise ValueError("the tolerance must not be negative")
    kept = require(df, vec, ord).filter(~V.is_zero(V.norm(F.col(vec)), tolerance))
    if check and kept.isEmpty():
        raise ValueError("no vector remains after zero removal")
    return reordinal(kept, ord)


def all_unit(df: DataFrame, tolerance: float = V.NORM_TOLERANCE, vec: str = "vec") -> bool:
    """Whether every vector has unit norm; an empty set has."""
    return bool(df.agg(F.coalesce(F.every(V.is_unit(V.norm(F.col(vec)), tolerance)), F.lit(True))).collect()[0][0])


def normalize(df: DataFrame, zero_tolerance: float = V.ZERO_TOLERANCE, vec: str = "vec") -> DataFrame:
    return require(df, vec).withColumn(vec, V.normalize(F.col(vec), zero_tolerance))


def normalize_if_needed(df: DataFrame, zero_tolerance: float = V.ZERO_TOLERANCE, tolerance: float = V.NORM_TOLERANCE, vec: str = "vec") -> tuple[DataFrame, bool]:
    """The set as it is if it is of unit norm already, else normalized; whether it changed."""
    if all_unit(df, tolerance, vec):
        return df, False
    return normalize(df, zero_tolerance, vec), True
