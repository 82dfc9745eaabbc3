"""Norm statistics, histogram and summary of a vector set. Every profile is one aggregation (the histogram two)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vector as V
from ..schema import require

BINS = 100


def norms(df: DataFrame, vec: str = "vec") -> DataFrame:
    return require(df, vec).withColumn("norm", V.norm(F.col(vec)))


def zero_count(norm: Column, tolerance: float = V.ZERO_TOLERANCE, inclusive: bool = True) -> Column:
    return F.count_if(V.is_zero(norm, tolerance, inclusive))


def unnormalized_count(norm: Column, tolerance: float = V.NORM_TOLERANCE) -> Column:
    return F.count_if(V.norm_deviation(norm) > tolerance)


def all_normalized(norm: Column, tolerance: float = V.NORM_TOLERANCE) -> Column:
    return F.coalesce(F.every(V.is_unit(norm, tolerance)), F.lit(True))


def norm_stats(df: DataFrame, vec: str = "vec") -> DataFrame:
    n = F.col("norm")
    return norms(df, vec).agg(F.min(n).alias("min"), F.max(n).alias("max"), F.avg(n).alias("mean"), F.max(V.norm_deviation(n)).alias("max_abs_deviation_from_1"))


def norm_errors(df: DataFrame, vec: str = "vec") -> DataFrame:
    """Largest and mean deviation from unit norm; 0 for an empty set."""
    e = V.norm_deviation(F.col("norm"))
    return norms(df, vec).agg(F.coalesce(F.max(e), F.lit(0.0)).alias("max_error"), F.coalesce(F.avg(e), F.lit(0.0)).alias("mean_error"))


def norm_histogram(df: DataFrame, vec: str = "vec", bins: int = BINS) -> DataFrame:
    """Non-empty bins of equal logarithmic width between the least and the greatest non-zero norm.

    Columns bin, low, high, cnt. Exact zeros are bin -1 with edges 0. If all norms are equal there is one bin
    [m, 1.01 m]. The extremes always fall into the first and last bin, however the edges round.
    """
    rows = norms(df, vec).select("norm")
    ends = rows.filter("norm > 0").agg(F.min("norm").alias("least"), F.max("norm").alias("most"))
    width = F.log10("most") - F.log10("least")
    place = F.floor((F.log10("norm") - F.log10("least")) / width * bins)
    bin_ = F.when(F.col("norm") == 0, F.lit(-1)).when(F.col("least") == F.col("most"), F.lit(0)).otherwise(F.greatest(F.least(place, F.lit(bins - 1)), F.lit(0)))
    counted = rows.crossJoin(F.broadcast(ends)).groupBy(bin_.cast("int").alias("bin"), "least", "most").agg(F.count("*").alias("cnt"))
    edge = lambda k: F.pow(F.lit(10.0), F.log10("least") + k * width / bins)
    zero, single = F.col("bin") < 0, F.col("least") == F.col("most")
    low = F.when(zero, 0.0).when(single, F.col("least")).otherwise(edge(F.col("bin")))
    high = F.when(zero, 0.0).when(single, F.col("least") * 1.01).otherwise(edge(F.col("bin") + 1))
    return counted.select("bin", low.alias("low"), high.alias("high"), "cnt")


def summary(df: DataFrame, norm_tolerance: float = V.NORM_TOLERANCE, zero_tolerance: float = V.ZERO_TOLERANCE, vec: str = "vec", ord: str = "ord") -> DataFrame:
    """One row: total, dim, normalized, zero_count (strict), unnormalized, norm statistics and the first vector."""
    n = F.col("norm")
    return norms(require(df, ord), vec).agg(
        F.count("*").alias("total"),
        F.max(F.size(vec)).alias("dim"),
        # A norm may be off by the tolerance itself.
        F.coalesce(F.every(V.is_unit(n, norm_tolerance, inclusive=True)), F.lit(True)).alias("normalized"),
        zero_count(n, zero_tolerance, inclusive=False).alias("zero_count"),
        unnormalized_count(n, norm_tolerance).alias("unnormalized"),
        F.min(n).alias("norm_min"),
        F.max(n).alias("norm_max"),
        F.avg(n).alias("norm_mean"),
        F.max(V.norm_deviation(n)).alias("norm_max_deviation"),
        F.min_by(vec, ord).alias("first_vector"),
    )
