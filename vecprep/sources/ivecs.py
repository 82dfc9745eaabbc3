"""ivecs files: neighbour id lists, whose lengths may vary.

A file of equal rows is split by records, wherever it lies; any other is read by one task in order, from a mounted path. The permissive mode reports what a
strict one refuses: it returns the rows before a fault and one last row with the error.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..schema import GROUND_TRUTH, GROUND_TRUTH_SCAN, require
from . import codec
from .fvecs import BATCH_BYTES, PARTITION_BYTES, Records, remote_records, write_parts


def scan_rows(path: str, endian: str = "little") -> Iterator[tuple[int, int, np.ndarray | None, str | None]]:
    """(row, declared length, ids or None, error or None), row by row; stops at the first error."""
    order = codec.order_of(endian)
    with open(path, "rb") as f:
        row = 0
        while head := f.read(4):
            if len(head) < 4:
                yield row, 0, None, f"Error reading dimension at row {row}: unexpected end of file."
                return
            n = int(np.frombuffer(head, order + "i4")[0])
            if n <= 0:
                yield row, 0, None, f"Error: non-positive vector dimension {n} at row {row}."
                return
            body = f.read(4 * n)
            if len(body) < 4 * n:
                yield row, n, None, f"Error reading vector data at row {row}: expected {4 * n} bytes, got {len(body)}. Unexpected end of file."
                return
            yield row, n, np.frombuffer(body, order + "i4").astype(np.int32), None
            row += 1


def _batch(rows: list[tuple[int, int, np.ndarray | None, str | None]], permissive: bool) -> pa.RecordBatch:
    ids = [r[2] if r[2] is not None else np.zeros(0, np.int32) for r in rows]
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)), pa.array(np.concatenate(ids)))
    columns = [pa.array([r[0] for r in rows], pa.int64()), lists]
    if permissive:
        columns += [pa.array([r[1] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.string())]
    return pa.record_batch(columns, ["query_ord", "ids", "declared", "error"][: len(columns)])


class IvecsReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"].removeprefix("file://")
        self.endian, self.permissive = options.get("endian", "little"), options.get("mode") == "permissive"
        self.shape: codec.Layout | None = None
        try:
            shape = codec.layout(self.path, self.endian)
            if shape.count and not self.permissive and self._equal(shape):
                self.shape = shape
        except ValueError:
            pass  # rows of several lengths, or a fault that the scan will meet

    def _equal(self, shape: codec.Layout) -> bool:
        """Whether every record states the same length: one strided look through the mapped file."""
        words = np.memmap(self.path, codec.order_of(self.endian) + "i4", "r")
        return bool((words[:: shape.dim + 1] == shape.dim).all())

    def partitions(self) -> list[InputPartition]:
        if self.shape is None:
            return [Records(self.path, 0, -1)]
        each = max(1, PARTITION_BYTES // self.shape.record_bytes)
        return [Records(self.path, i, min(i + each, self.shape.count)) for i in range(0, self.shape.count, each)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        assert isinstance(partition, Records)
        if self.shape is not None:
            rows = max(1, BATCH_BYTES // self.shape.record_bytes)
            for first, body in codec.read_records(partition.path, self.shape, partition.start, partition.end, "i4", self.endian, rows):
                yield _batch([(first + i, len(x), x, None) for i, x in enumerate(body)], False)
            return
        held, size = [], 0
        for row in scan_rows(partition.path, self.endian):
            if row[3] is not None and not self.permissive:
                raise ValueError(f"{partition.path}: {row[3]}")
            held.append(row)
            size += 4 * (row[1] + 1)
            if size >= BATCH_BYTES:
                yield _batch(held, self.permissive)
                held, size = [], 0
        if held:
            yield _batch(held, self.permissive)


class IvecsSource(DataSource):
    """Options: endian; mode=permissive adds the columns declared and error."""

    @classmethod
    def name(cls) -> str:
        return "ivecs"

    def schema(self):
        return GROUND_TRUTH_SCAN if self.options.get("mode") == "permissive" else GROUND_TRUTH

    def reader(self, schema) -> DataSourceReader:
        return IvecsReader(self.options)


def read_ivecs(spark: SparkSession, path: str, endian: str = "little", permissive: bool = False) -> DataFrame:
    """(query_ord, ids); permissive: also declared and error. A missing file is one row with the error if permissive."""
    if "://" in path and not path.startswith("file://"):
        return _read_remote(spark, path, endian, permissive)
    if not os.path.exists(path.removeprefix("file://")):
        if not permissive:
            raise FileNotFoundError(path)
        return spark.createDataFrame([(0, [], 0, f"File not found: '{path}'")], GROUND_TRUTH_SCAN)
    spark.dataSource.register(IvecsSource)
    reader = spark.read.format("ivecs").option("endian", endian)
    return (reader.option("mode", "permissive") if permissive else reader).load(path)


def _read_remote(spark: SparkSession, path: str, endian: str, permissive: bool) -> DataFrame:
    """Rows of one length from a store that only Spark's readers open; rows of several lengths need a mounted path."""
    rows = remote_records(spark, path, "i4", endian)
    rows = spark.createDataFrame([], GROUND_TRUTH) if rows is None else rows.select(F.col("ord").alias("query_ord"), F.col("values").alias("ids"))
    return rows.select("*", F.size("ids").cast("long").alias("declared"), F.lit(None).cast("string").alias("error")) if permissive else rows


def row_at(spark: SparkSession, path: str, index: int) -> list[int]:
    """One row by its 0-based place."""
    rows = read_ivecs(spark, path).filter(F.col("query_ord") == index).collect() if index >= 0 else []
    if not rows:
        raise IndexError(f"{path}: no row {index}")
    return list(rows[0]["ids"])


def write_ivecs(gt: DataFrame, target: str, k: int | None = None, pad: int | None = None, ragged: bool = False, endian: str = "little") -> None:
    """Rows in order of ``query_ord`` as one file. Rows must be of one length unless ``ragged``; ``pad`` fills up to k."""
    require(gt, "query_ord", "ids")
    ids = F.col("ids").cast("array<bigint>")
    if pad is not None:
        if k is None:
            raise ValueError("padding needs k")
        ids = F.slice(F.concat(ids, F.array_repeat(F.lit(pad).cast("bigint"), k)), 1, k)
    rows = gt.select(F.col("query_ord").alias("ord"), ids.alias("ids"))
    limit = 2**31 - 1
    worst, low, high = rows.agg(F.max(F.greatest(F.coalesce(F.array_max("ids"), F.lit(0)), -1 - F.coalesce(F.array_min("ids"), F.lit(0)))), F.min(F.size("ids")), F.max(F.size("ids"))).collect()[0]
    if worst is not None and worst > limit:
        raise OverflowError(f"id {worst} doesn't fit 32 bits")
    if not ragged and low != high:
        raise ValueError(f"rows have {low} to {high} ids; pad them or write ragged rows")

    def encode(lists: pa.Array) -> bytes:
        return codec.encode_lists(lists.flatten().to_numpy(zero_copy_only=False), np.asarray(lists.value_lengths()), endian)

    write_parts(rows, encode, target)
