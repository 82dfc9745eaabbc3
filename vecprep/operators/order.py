"""Ordinals, sorting, sortedness, truncation, shuffling and sampling.

A running number over all rows is never taken by one task: rows fall into bins that are a function of their order key,
bins are counted (one small row each) and summed, and rows are numbered within bins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import require
from ..tables import materialise, shuffle_partitions

#: Ordinals per bin where the order is the old ordinal.
BIN_WIDTH = 1 << 20
#: Hexadecimal digits of the hash that make a bin of a shuffle: 65,536 bins.
BIN_DIGITS = 4


def _number(df: DataFrame, bin_: Column, order: list[Column], name: str) -> DataFrame:
    """A dense 0-based number ``name`` in the order of (bin, order); bins ascend with the order."""
    rows = df.withColumn("_bin", bin_)
    counts = rows.groupBy("_bin").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(F.col("_bin").alias("_b"), before.alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_bin").orderBy(*order))
    numbered = rows.withColumn("_in", inside).join(starts, F.col("_bin") == F.col("_b"))
    kept = [c for c in df.columns if c != name]
    return numbered.select(*kept, (F.col("_start") + F.col("_in") - 1).cast("long").alias(name))


def reordinal(df: DataFrame, ord: str = "ord", name: str = "ord") -> DataFrame:
    """Dense ordinals 0..n-1 in the order of the old ones (after a filter, say)."""
    return _number(require(df, ord), F.floor(F.col(ord) / BIN_WIDTH), [F.col(ord)], name)


def shuffle_key(ord: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), ord.cast("string")).cast("binary"))


def shuffle(df: DataFrame, seed: int = 42, ord: str = "ord", name: str = "ord") -> DataFrame:
    """A seeded permutation: new ordinals by the hash of seed and old ordinal, whatever the partitioning."""
    key = shuffle_key(F.col(ord), seed)
    return _number(require(df, ord).withColumn("_key", key), F.substring("_key", 1, BIN_DIGITS), [F.col("_key"), F.col(ord)], name).drop("_key")


def sort(df: DataFrame, vec: str = "vec", ord: str = "ord") -> DataFrame:
    """Lexicographic order of the vectors, duplicates kept, equal ones by ordinal: a range shuffle and a spilling sort."""
    return require(df, vec, ord).orderBy(vec, ord)


def sorted_ordinals(df: DataFrame, name: str = "sorted_ord", vec: str = "vec", ord: str = "ord") -> DataFrame:
    """``sort`` with dense ordinals; the sorted rows are written once so that they are numbered as they lie."""
    require(df, vec, ord)
    parts = shuffle_partitions(df.sparkSession)
    rows = df.repartitionByRange(parts, vec, ord).sortWithinPartitions(vec, ord)
    rows = rows.withColumns({"_bin": F.spark_partition_id(), "_in": F.monotonically_increasing_id()})
    rows = materialise(rows, "sorted")
    counts = rows.groupBy("_bin").agg(F.count("*").alias("_n"), F.min("_in").alias("_low"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(F.col("_bin").alias("_b"), (before - F.col("_low")).alias("_shift"))
    return rows.join(starts, F.col("_bin") == F.col("_b")).select(*df.columns, (F.col("_in") + F.col("_shift")).cast("long").alias(name))


def with_previous(df: DataFrame, column: str, name: str, ord: str = "ord", width: int = BIN_WIDTH) -> DataFrame:
    """The value of ``column`` in the row before, in order of ``ord``; null in the first row.

    Within bins of ordinals by a window; a bin's first row takes the last value of the bin before it.
    """
    rows = require(df, column, ord).withColumn("_bin", F.floor(F.col(ord) / width))
    last = rows.groupBy("_bin").agg(F.max_by(F.struct(column), F.col(ord)).alias("_last"))
    carried = last.select(F.col("_bin").alias("_b"), F.lag("_last").over(Window.orderBy("_bin")).alias("_carried"))
    before = F.lag(F.struct(column)).over(Window.partitionBy("_bin").orderBy(ord))
    joined = rows.withColumn("_before", before).join(carried, F.col("_bin") == F.col("_b"))
    return joined.select(*df.columns, F.coalesce("_before", "_carried").getField(column).alias(name))


def first_unsorted(df: DataFrame, vec: str = "vec", ord: str = "ord") -> DataFrame:
    """One row: ``first_violation``, the 1-based line of the first vector below the one before it, null if sorted."""
    rows = with_previous(df, vec, "_previous", ord)
    return rows.agg(F.min(F.when(F.col(vec) < F.col("_previous"), F.col(ord) + 1)).alias("first_violation"))


def first_unsorted_bytes(df: DataFrame, vec: str = "vec", ord: str = "ord") -> DataFrame:
    """``first_unsorted`` by the bytes of little-endian records, their length first, as unsigned numbers."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            raw, size = lists.flatten().to_numpy(zero_copy_only=False).astype("<f4").tobytes(), np.asarray(lists.value_lengths())
            ends = 4 * np.cumsum(size)
            records = [int(n).to_bytes(4, "little") + raw[b - 4 * n : b] for n, b in zip(size.tolist(), ends.tolist(), strict=True)]
            yield pa.record_batch([batch.column(0), pa.array(records, pa.binary())], ["ord", "record"])

    rows = require(df, vec, ord).select(F.col(ord).cast("long").alias("ord"), F.col(vec).cast("array<float>").alias("vec"))
    return first_unsorted(rows.mapInArrow(encode, "ord long, record binary"), "record", "ord")


def truncate(df: DataFrame, n: int, ord: str = "ord") -> DataFrame:
    """The first ``n`` vectors in order; fewer if there are fewer."""
    return require(df, ord).filter(F.col(ord) < n)


def sample(df: DataFrame, n: int, seed: int = 42, ord: str = "ord") -> DataFrame:
    """Exactly ``n`` rows without replacement, the ones of least hash."""
    key = shuffle_key(F.col(ord), seed)
    return require(df, ord).orderBy(key, ord).limit(n)


def at(df: DataFrame, index: int, ord: str = "ord") -> DataFrame:
    """The row at a 0-based place; an error if there is none."""
    row = require(df, ord).filter(F.col(ord) == index)
    if row.isEmpty():
        raise IndexError(f"no row {index}")
    return row
