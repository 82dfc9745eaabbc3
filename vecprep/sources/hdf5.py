"""HDF5 data sets as vector sets. Needs h5py, which is imported when first used."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..schema import VECTORS
from .fvecs import BATCH_BYTES, PARTITION_BYTES, Records

SUFFIXES = (".h5", ".hdf5")


def _h5py():
    try:
        import h5py
    except ImportError as e:
        raise ImportError("reading HDF5 needs the package h5py") from e
    return h5py


def is_candidate(item) -> bool:
    """A two-dimensional numeric data set."""
    return getattr(item, "ndim", None) == 2 and np.issubdtype(item.dtype, np.number)


def check_dataset(file, path: str, key: str, flatten: bool = False):
    """The data set under a key, or an error that says why it can't be read."""
    if key not in file:
        raise ValueError(f"{path}: there is no '{key}'")
    item = file[key]
    if not hasattr(item, "dtype"):
        raise ValueError(f"{path}: '{key}' isn't a data set")
    if not np.issubdtype(item.dtype, np.number):
        raise ValueError(f"{path}: '{key}' isn't numeric")
    if item.ndim != 2 and not (flatten and item.ndim > 2):
        raise ValueError(f"{path}: '{key}' has {item.ndim} dimensions")
    return item


def dataset_keys(path: str, keys: Sequence[str] = ()) -> list[str]:
    """The given keys, checked, or all candidates of the file, groups searched through; none is an error."""
    with _h5py().File(path, "r") as file:
        if keys:
            for key in keys:
                check_dataset(file, path, key)
            return list(keys)
        found: list[str] = []
        file.visititems(lambda name, item: found.append(name) if is_candidate(item) else None)
    if not found:
        raise ValueError(f"{path}: no two-dimensional numeric data set")
    return sorted(found)


class Hdf5Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.key = options["path"].removeprefix("file://"), options.get("key", "data")
        self.flatten = options.get("flatten", "false") == "true"
        with _h5py().File(self.path, "r") as file:
            self.shape = check_dataset(file, self.path, self.key, self.flatten).shape
        self.inner = int(np.prod(self.shape[1:-1], dtype=np.int64))  # rows of vectors in one entry of the first axis

    def partitions(self) -> list[InputPartition]:
        each = max(1, PARTITION_BYTES // max(1, 4 * self.inner * self.shape[-1]))
        return [Records(self.path, i, min(i + each, self.shape[0])) for i in range(0, self.shape[0], each)] or [Records(self.path, 0, 0)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        assert isinstance(partition, Records)
        step = max(1, BATCH_BYTES // max(1, 4 * self.inner * self.shape[-1]))
        with _h5py().File(partition.path, "r") as file:
            data = file[self.key]
            for i in range(partition.start, partition.end, step):
                body = np.asarray(data[i : min(i + step, partition.end)], np.float32).reshape(-1, self.shape[-1])
                n, dim = body.shape
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * dim), pa.array(body.ravel()))
                yield pa.record_batch([pa.array(np.arange(n, dtype=np.int64) + i * self.inner), lists], ["ord", "vec"])


class Hdf5Source(DataSource):
    """Options: key (default data), flatten (leading dimensions become rows)."""

    @classmethod
    def name(cls) -> str:
        return "hdf5"

    def schema(self):
        return VECTORS

    def reader(self, schema) -> DataSourceReader:
        return Hdf5Reader(self.options)


def read_hdf5(spark: SparkSession, path: str, key: str = "data", flatten: bool = False) -> DataFrame:
    _h5py()
    spark.dataSource.register(Hdf5Source)
    return spark.read.format("hdf5").option("key", key).option("flatten", str(flatten).lower()).load(path)


def split_uri(uri: str) -> tuple[str, str]:
    """``file.h5:key`` as path and key."""
    path, _, key = uri.rpartition(":")
    if not key or Path(path).suffix.lower() not in SUFFIXES:
        raise ValueError(f"not an HDF5 data set (file.h5:key): {uri}")
    return path, key
