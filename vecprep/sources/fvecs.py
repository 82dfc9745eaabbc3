"""fvecs files: a splittable Spark data source, a writer and byte-order conversion.

``spark.read.format("fvecs")`` needs the file on a path that driver and executors share. A path with another scheme
goes through Spark's own binary record reader (``read_fvecs`` chooses).
"""

from __future__ import annotations

import os
import shutil
from collections.abc import Iterator
from pathlib import Path
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.assemble import shard_id
from ..schema import VECTORS, require
from ..tables import materialise, shared_dir, shuffle_partitions
from . import codec

PARTITION_BYTES = 64 << 20
BATCH_BYTES = 8 << 20


class Records(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


class FvecsReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"].removeprefix("file://")
        self.endian = options.get("endian", "little")
        self.shape = codec.layout(self.path, self.endian)
        self.first = max(0, int(options.get("ord_start", 0)))
        self.last = min(self.shape.count, int(options.get("ord_end", self.shape.count)))
        self.each = max(1, int(options.get("partition_bytes", PARTITION_BYTES)) // self.shape.record_bytes)

    def partitions(self) -> list[InputPartition]:
        return [Records(self.path, i, min(i + self.each, self.last)) for i in range(self.first, self.last, self.each)] or [Records(self.path, 0, 0)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        assert isinstance(partition, Records)
        rows = max(1, BATCH_BYTES // max(1, self.shape.record_bytes))
        for first, body in codec.read_records(partition.path, self.shape, partition.start, partition.end, "f4", self.endian, rows):
            n, dim = body.shape
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * dim), pa.array(body.ravel()))
            yield pa.record_batch([pa.array(np.arange(first, first + n, dtype=np.int64)), lists], ["ord", "vec"])


class FvecsSource(DataSource):
    """Options: endian (little, big), ord_start and ord_end (a range of ordinals, found by seeking), partition_bytes."""

    @classmethod
    def name(cls) -> str:
        return "fvecs"

    def schema(self):
        return VECTORS

    def reader(self, schema) -> DataSourceReader:
        return FvecsReader(self.options)


def _is_local(path: str) -> bool:
    return "://" not in path or path.startswith("file://")


def read_fvecs(spark: SparkSession, path: str, endian: str = "little", ord_start: int | None = None, ord_end: int | None = None) -> DataFrame:
    """(ord, vec) of a file; every record's dimension is checked as it is read."""
    if not _is_local(path):
        return _read_remote(spark, path, endian, ord_start, ord_end)
    codec.order_of(endian)
    codec.layout(path.removeprefix("file://"), endian)  # a malformed file fails here, with the record's number
    spark.dataSource.register(FvecsSource)
    reader = spark.read.format("fvecs").option("endian", endian)
    for name, value in (("ord_start", ord_start), ("ord_end", ord_end)):
        if value is not None:
            reader = reader.option(name, str(value))
    return reader.load(path)


def remote_records(spark: SparkSession, path: str, kind: str, endian: str) -> DataFrame | None:
    """(ord, values) of a file of equal records in a store that only Spark's readers open; None if it is empty.

    Spark splits the file at record borders and records stay in the JVM until whole batches are decoded. A record's number
    is its place in its split plus the records of the splits before.
    """
    order = codec.order_of(endian)
    head = spark.sparkContext.binaryRecords(path, 4).take(1)
    if not head:
        return None
    dim = int(np.frombuffer(head[0], order + "i4")[0])
    if dim <= 0:
        raise ValueError(f"{path}: non-positive dimension {dim} at record 0")
    jvm = spark.sparkContext._jvm
    records = spark.sparkContext._jsc.binaryRecords(path, 4 * (dim + 1)).rdd()
    raw = DataFrame(spark._jsparkSession.createDataset(records, jvm.org.apache.spark.sql.Encoders.BINARY()).toDF(), spark)
    rows = raw.select(F.col("value").alias("raw"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place"))
    parts = rows.groupBy("part").agg(F.count("*").alias("n"), F.min("place").alias("low"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = parts.select(F.col("part").alias("p"), (before - F.col("low")).alias("shift"))  # one row per split

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ords, data = batch.column(0).to_numpy(), batch.column(1)
            _, offsets, body = data.buffers()
            at = np.frombuffer(offsets, np.int32)[data.offset : data.offset + len(data) + 1] if len(data) else np.zeros(1, np.int32)
            words = np.frombuffer(body, order + "i4", (at[-1] - at[0]) // 4, at[0]).reshape(len(data), dim + 1) if len(data) else np.zeros((0, dim + 1), order + "i4")
            wrong = np.flatnonzero(words[:, 0] != dim)
            if len(wrong):
                raise ValueError(f"{path}: inconsistent dimension {words[wrong[0], 0]} at record {ords[wrong[0]]}, expected {dim}")
            values = np.ascontiguousarray(words[:, 1:]).view(order + kind).astype("=" + kind).ravel()
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(data) + 1, dtype=np.int32) * dim), pa.array(values))
            yield pa.record_batch([batch.column(0), lists], ["ord", "values"])

    numbered = rows.join(F.broadcast(shift), F.col("part") == F.col("p")).select((F.col("place") + F.col("shift")).cast("long").alias("ord"), "raw")
    return numbered.mapInArrow(decode, f"ord long, values array<{'float' if kind == 'f4' else 'int'}>")


def _read_remote(spark: SparkSession, path: str, endian: str, ord_start: int | None, ord_end: int | None) -> DataFrame:
    rows = remote_records(spark, path, "f4", endian)
    if rows is None:
        return spark.createDataFrame([], VECTORS)
    rows = rows.withColumnRenamed("values", "vec")
    return rows.filter((F.col("ord") >= (ord_start or 0)) & (F.lit(True) if ord_end is None else F.col("ord") < ord_end))


def vector_at(spark: SparkSession, path: str, index: int, endian: str = "little") -> list[float]:
    """One vector by its 0-based place; only that record is read."""
    rows = read_fvecs(spark, path, endian, index, index + 1).filter(F.col("ord") == index).collect() if index >= 0 else []
    if not rows:
        raise IndexError(f"{path}: no record {index}")
    return list(rows[0]["vec"])


def write_parts(df: DataFrame, encode, target: str) -> None:
    """Write records into one file: encoded where they lie, range by range, as part files that are then joined in order.

    ``df`` must have the columns ord and a list. Executors write no file themselves; parts travel through Spark's binary
    rows in the shared folder and the driver streams them to a temporary file that replaces the target at the end.
    """
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/parts-{uuid4().hex}"
    ordered = df.repartitionByRange("ord").sortWithinPartitions("ord")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                yield pa.record_batch([pa.array([batch.column(0)[0].as_py()], pa.int64()), pa.array([encode(batch.column(1))], pa.binary())], ["first", "data"])

    ordered.mapInArrow(run, "first long, data binary").write.parquet(folder)
    temporary = f"{target}.{uuid4().hex}.tmp"
    try:
        with open(temporary, "wb") as out:
            for row in spark.read.parquet(folder).orderBy("first").toLocalIterator(prefetchPartitions=False):
                out.write(row["data"])
        os.replace(temporary, target)
    finally:
        Path(temporary).unlink(missing_ok=True)
        shutil.rmtree(folder.removeprefix("file://").removeprefix("file:"), ignore_errors=True)


def write_fvecs(df: DataFrame, target: str, endian: str = "little") -> None:
    """The vectors in order of ``ord`` as one file; all must have one dimension."""
    require(df, "ord", "vec")
    low, high = df.agg(F.min(F.size("vec")), F.max(F.size("vec"))).collect()[0]
    if low != high:
        raise ValueError(f"inconsistent dimension: {low} to {high}")

    def encode(vectors: pa.Array) -> bytes:
        return codec.encode_matrix(vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1), "f4", endian)

    write_parts(df.select("ord", F.col("vec").cast("array<float>").alias("vec")), encode, target)


def write_shards(df: DataFrame, folder: str, size: int, base: str, endian: str = "little") -> list[tuple[str, int]]:
    """The vectors in order of ``ord``, a dense number, as files of ``size`` vectors, written where they lie.

    Each task writes whole shards into ``folder``, an absolute path that all machines share: as a temporary file of its own
    attempt that takes the shard's name once it is complete, so a lost executor leaves no half shard. Names and numbers of
    vectors, in order; no vector passes the driver.
    """
    require(df, "ord", "vec")
    low, high, total = df.agg(F.min(F.size("vec")), F.max(F.size("vec")), F.count("*")).collect()[0]
    if low != high:
        raise ValueError(f"inconsistent dimension: {low} to {high}")
    if not os.path.isabs(folder):
        raise ValueError(f"the output folder must be absolute: {folder}")
    os.makedirs(folder, exist_ok=True)
    codec.order_of(endian)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt, now, out, n = TaskContext.get().taskAttemptId(), None, None, 0

        def finish() -> pa.RecordBatch:
            out.close()
            name = f"{base}_{n}_{now}.fvecs"
            os.replace(out.name, os.path.join(folder, name))
            return pa.record_batch([pa.array([now], pa.int64()), pa.array([name]), pa.array([n], pa.int64())], ["shard", "name", "n"])

        try:
            for batch in batches:
                ids = batch.column(0).to_numpy()
                cuts = np.append(np.flatnonzero(np.diff(ids, prepend=-1)), len(ids))
                for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    if ids[a] != now:
                        if out is not None:
                            yield finish()
                        now, n = int(ids[a]), 0
                        out = open(os.path.join(folder, f".{base}_{now}.{attempt}.tmp"), "wb")
                    rows = batch.column(2).slice(a, b - a)
                    out.write(codec.encode_matrix(rows.flatten().to_numpy(zero_copy_only=False).reshape(b - a, -1), "f4", endian))
                    n += b - a
            if out is not None:
                yield finish()
        finally:
            if out is not None:
                Path(out.name).unlink(missing_ok=True)

    rows = df.select(shard_id(F.col("ord"), size).cast("long").alias("shard"), "ord", F.col("vec").cast("array<float>").alias("vec"))
    parts = min(-(-max(total, 1) // size), max(shuffle_partitions(df.sparkSession), 1024))
    rows = rows.repartition(parts, "shard").sortWithinPartitions("shard", "ord")
    found = materialise(rows.mapInArrow(run, "shard long, name string, n long"), "shards").orderBy("shard").collect()
    return [(r["name"], r["n"]) for r in found]


def swap_endianness(spark: SparkSession, source: str, target: str, input_endian: str = "little") -> int:
    """The same vectors in the other byte order; the number of records. Nothing is left behind if it fails."""
    if os.path.realpath(source) == os.path.realpath(target):
        raise ValueError("input and output are the same file")
    rows = read_fvecs(spark, source, input_endian)
    write_fvecs(rows, target, "big" if input_endian == "little" else "little")
    return codec.layout(source, input_endian).count
