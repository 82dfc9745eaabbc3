"""Exact duplicates: removal and reports.

Vectors are equal as Spark groups them: -0.0 equals 0.0 and NaN equals NaN; ``nan_distinct`` keeps vectors with a NaN
apart. Reports never gather a group: the lines of a group come from a ranking that keeps ten rows a group before the
shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vector as V
from ..schema import require
from .order import first_unsorted, reordinal, with_previous

OTHER_LINES = 10
TOP = 100


def _key(vec: str, ord: str, nan_distinct: bool) -> list[Column]:
    return [F.col(vec), F.when(V.has_nan(F.col(vec)), F.col(ord)).alias("_apart")] if nan_distinct else [F.col(vec)]


def groups(df: DataFrame, vec: str = "vec", ord: str = "ord", nan_distinct: bool = False) -> DataFrame:
    """One row per distinct vector: vec, first_ord, cnt."""
    found = require(df, vec, ord).groupBy(*_key(vec, ord, nan_distinct)).agg(F.min(ord).alias("first_ord"), F.count("*").alias("cnt"))
    return found.select(F.col(vec), "first_ord", "cnt")


def dedup(df: DataFrame, vec: str = "vec", ord: str = "ord", nan_distinct: bool = False) -> DataFrame:
    """Distinct vectors in sorted order, each with its first ordinal and count."""
    return groups(df, vec, ord, nan_distinct).orderBy(vec, "first_ord")


def dedup_adjacent(df: DataFrame, vec: str = "vec", ord: str = "ord") -> DataFrame:
    """The first of each run of equal neighbours, numbered anew: ord, vec, first_ord (in the input)."""
    rows = with_previous(df, vec, "_previous", ord)
    kept = rows.filter(F.col("_previous").isNull() | (F.col("_previous") != F.col(vec)))
    return reordinal(kept.select(F.col(ord).alias("first_ord"), F.col(vec)), "first_ord", "ord")


def dedup_sorted(df: DataFrame, vec: str = "vec", ord: str = "ord") -> DataFrame:
    """``dedup_adjacent`` of a set that must be sorted; an error names the first line that isn't."""
    line = first_unsorted(df, vec, ord).collect()[0][0]
    if line is not None:
        raise ValueError(f"not sorted: line {line} is below the line before it")
    return dedup_adjacent(df, vec, ord)


def report(df: DataFrame, threshold: int = 1, vec: str = "vec", ord: str = "ord") -> DataFrame:
    """Vectors that occur more than ``threshold`` times: vec, cnt, first_line (1-based), head (4 components)."""
    found = groups(df, vec, ord).filter(F.col("cnt") > threshold)
    return found.select(F.col(vec), "cnt", (F.col("first_ord") + 1).alias("first_line"), V.prefix(F.col(vec), 4).alias("head"))


def lines(df: DataFrame, include_first: bool = False, limit: int = OTHER_LINES, vec: str = "vec", ord: str = "ord") -> DataFrame:
    """Up to ``limit`` lines of each repeated vector, the first left out unless asked for: first_line, nth, line."""
    key = Window.partitionBy(vec).orderBy(ord)
    ranked = require(df, vec, ord).select(vec, ord, F.row_number().over(key).alias("nth")).filter(F.col("nth") <= limit + (not include_first))
    repeated = groups(df, vec, ord).filter("cnt > 1").select(F.col(vec).alias("_vec"), (F.col("first_ord") + 1).alias("first_line"))
    found = ranked.join(repeated, F.col(vec) == F.col("_vec"))
    return found.filter(F.lit(include_first) | (F.col("nth") > 1)).select("first_line", F.col("nth").cast("int").alias("nth"), (F.col(ord) + 1).alias("line"))


def histogram(df: DataFrame, vec: str = "vec", ord: str = "ord") -> DataFrame:
    """How many distinct vectors occur how often: cnt, vectors."""
    return groups(df, vec, ord).groupBy("cnt").agg(F.count("*").alias("vectors"))


def top(df: DataFrame, n: int = TOP, threshold: int = 1, vec: str = "vec", ord: str = "ord") -> DataFrame:
    """The ``n`` most frequent vectors beyond the threshold, ties in vector order."""
    return report(df, threshold, vec, ord).orderBy(F.desc("cnt"), vec).limit(n)


def totals(df: DataFrame, vec: str = "vec", ord: str = "ord") -> DataFrame:
    """One row: processed, unique, removed."""
    total, distinct = F.coalesce(F.sum("cnt"), F.lit(0)), F.count("*")
    return groups(df, vec, ord).agg(total.alias("processed"), distinct.alias("unique"), (total - distinct).alias("removed"))
