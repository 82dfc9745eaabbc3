"""Validation and slicing of ground truth, wide rows (query_ord, ids).

A permissive scan (see ``sources.ivecs``) adds ``declared`` (the row length that the file states) and ``error``; a row
with an error ends its file and counts in lengths but not among the rows read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vector as V
from ..schema import require


def _scan(gt: DataFrame) -> DataFrame:
    require(gt, "query_ord", "ids")
    if "declared" not in gt.columns:
        gt = gt.withColumn("declared", F.size("ids").cast("long"))
    return gt if "error" in gt.columns else gt.withColumn("error", F.lit(None).cast("string"))


def duplicate_ids(gt: DataFrame) -> DataFrame:
    """query_ord, id and cnt of ids that occur more than once in a row."""
    read = _scan(gt).filter("error IS NULL AND size(array_distinct(ids)) < size(ids)")
    return read.select("query_ord", F.explode("ids").alias("id")).groupBy("query_ord", "id").agg(F.count("*").alias("cnt")).filter("cnt > 1")


def negative_count(ids: Column) -> Column:
    return F.size(F.filter(ids, lambda x: x < 0))


def negative_ids(gt: DataFrame) -> DataFrame:
    """query_ord and cnt of rows with negative ids."""
    return _scan(gt).filter("error IS NULL").select("query_ord", negative_count(F.col("ids")).cast("long").alias("cnt")).filter("cnt > 0")


def wrong_lengths(gt: DataFrame, k: int) -> DataFrame:
    """query_ord, length and kind (short, overlong) of rows whose declared length isn't ``k``."""
    kind = F.when(F.col("declared") < k, "short").otherwise("overlong")
    return _scan(gt).filter((F.col("declared") > 0) & (F.col("declared") != k)).select("query_ord", F.col("declared").alias("length"), kind.alias("kind"))


def validate(gt: DataFrame, k: int) -> DataFrame:
    """One row: rows read, greatest length and id, numbers of faulty rows by kind, the error, and the verdict."""
    read, length = F.col("error").isNull(), F.col("declared")
    bad = {
        "duplicate_rows": read & (F.size(F.array_distinct("ids")) < F.size("ids")),
        "negative_rows": read & (negative_count(F.col("ids")) > 0),
        "short_rows": (length > 0) & (length < k),
        "overlong_rows": length > k,
    }
    out = _scan(gt).agg(
        F.count_if(read).alias("num_rows"),
        F.coalesce(F.max(F.greatest(length, F.lit(0))), F.lit(0)).alias("max_row_length"),
        F.max(F.when(read, F.array_max("ids"))).cast("long").alias("max_ordinal"),
        *[F.count_if(c).alias(name) for name, c in bad.items()],
        F.min("error").alias("fatal_error"),
    )
    clean = F.col("fatal_error").isNull()
    for name in bad:
        clean &= F.col(name) == 0
    return out.withColumn("passed", clean)


def slice_ids(gt: DataFrame, max_base: int, k: int, drop_negative: bool = False) -> DataFrame:
    """Neighbours below ``max_base`` in their order, the first ``k``: the ground truth of the first max_base vectors.

    Right because a row lists its neighbours best first; a row may end up with fewer than k.
    """
    if max_base <= 0 or k <= 0:
        raise ValueError("max_base and k must be positive")
    kept = F.slice(V.ids_below(F.col("ids"), max_base, drop_negative), 1, k)
    return require(gt, "query_ord", "ids").select("query_ord", kept.alias("ids"))


def short_count(gt: DataFrame, k: int) -> DataFrame:
    """One row: how many queries have fewer than ``k`` neighbours."""
    return gt.agg(F.count_if(F.size("ids") < k).alias("short_count"))
