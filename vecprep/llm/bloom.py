"""A Bloom filter of fixed size over ids, to read few rows of a wide table without shuffling it.

It never misses an id. Its bits are bounded whatever the number of ids, so it may be broadcast; once it fills up it lets
through more rows than wanted, which costs work and no correctness.
"""

from __future__ import annotations

from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import mix

#: 8 MB at most.
MOST_BITS = 26
SLICE_BITS = 15
HASHES = 3


class Bloom:
    def __init__(self, bits: np.ndarray):
        self.bits = bits

    def mask(self, ids: pa.Array) -> pa.Array:
        """Which ids may be in the filter; null isn't."""
        return pa.array(self.may_hold(ids.fill_null(0).to_numpy(zero_copy_only=False)) & ~np.asarray(ids.is_null()))

    def may_hold(self, ids: np.ndarray) -> np.ndarray:
        place = places(ids, len(self.bits) * 8)
        return (self.bits[place >> 3] >> (place & 7) & 1).all(axis=0)


def places(ids: np.ndarray, size: int) -> np.ndarray:
    """HASHES x ids: the bits of each id."""
    h = mix(np.asarray(ids, np.int64).view(np.uint64) ^ np.uint64(0xB5297A4D3F84D5B5))
    step = mix(h) | np.uint64(1)
    return np.stack([(h + np.uint64(k) * step) % np.uint64(size) for k in range(HASHES)]).astype(np.int64)


def bloom_of(ids: DataFrame) -> Bloom:
    """From one column of non-null longs. Each slice of the filter is made by one task from the bits that fall into it."""
    n = ids.count()
    width = max(SLICE_BITS, min(MOST_BITS, max(1, 10 * n).bit_length()))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bit = np.unique(places(b.column(0).to_numpy(), 1 << width))
            yield pa.record_batch([pa.array(bit >> SLICE_BITS), pa.array((bit & ((1 << SLICE_BITS) - 1)).astype(np.int32))], ["part", "bit"])

    def make(group: pa.Table) -> pa.Table:
        bits = np.zeros(1 << SLICE_BITS, np.uint8)
        bits[group["bit"].to_numpy()] = 1
        return pa.table([pa.array([group["part"][0].as_py()], pa.int64()), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], ["part", "data"])

    parts = ids.mapInArrow(spread, "part long, bit int").distinct().groupBy("part").applyInArrow(make, "part long, data binary")
    out = np.zeros((1 << width) // 8, np.uint8)
    for row in parts.toArrow().to_pylist():
        at = row["part"] << (SLICE_BITS - 3)
        out[at : at + (1 << (SLICE_BITS - 3))] = np.frombuffer(row["data"], np.uint8)
    return Bloom(out)


def without(df: DataFrame, column: str, gone: DataFrame) -> DataFrame:
    """``df`` without the rows whose id is in ``gone`` (one column of distinct longs); only rows that may be are joined.

    Python sees the ids alone; the other columns stay where they are.
    """
    held = df.sparkSession.sparkContext.broadcast(bloom_of(gone))

    @F.pandas_udf("boolean")
    def doubtful(ids: pd.Series) -> pd.Series:
        return pd.Series(np.asarray(held.value.mask(pa.array(ids, pa.int64(), from_pandas=True))))

    name, mark = gone.columns[0], f"_doubtful_{uuid4().hex}"
    marked = df.withColumn(mark, doubtful(F.col(column).cast("long")))
    gone = gone.withColumnRenamed(name, "_gone_id")
    met = marked.filter(mark).join(gone, F.col(column) == gone["_gone_id"], "left_anti")
    return marked.filter(~F.col(mark)).unionByName(met).drop(mark)
