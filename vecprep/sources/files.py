"""Finding and opening files of any supported kind."""

from __future__ import annotations

from pathlib import Path
from urllib.parse import unquote

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .fvecs import read_fvecs
from .hdf5 import SUFFIXES, read_hdf5, split_uri


def find_files(folder: str, suffixes: tuple[str, ...], recursive: bool = False) -> list[str]:
    """Files with one of the suffixes, in any case, sorted by path."""
    root = Path(folder)
    if not root.is_dir():
        raise NotADirectoryError(folder)
    found = root.rglob("*") if recursive else root.iterdir()
    return sorted(str(p) for p in found if p.is_file() and p.suffix.lower() in suffixes)


def read_vectors(spark: SparkSession, uri: str, endian: str = "little") -> DataFrame:
    """(ord, vec) of an fvecs file or of ``file.h5:key``; an HDF5 file without a key is refused."""
    if "://" not in uri and ":" in uri:
        return read_hdf5(spark, *split_uri(uri))
    if Path(uri).suffix.lower() in SUFFIXES:
        raise ValueError(f"an HDF5 file needs a key: {uri}:key")
    return read_fvecs(spark, uri, endian)


def first_row(spark: SparkSession, path: str) -> tuple[list[str], Row | None]:
    """Column names of a Parquet table and its first row; no more than that is read.

    Of several files the first by name counts that has a row, whatever their sizes (Spark starts with the largest).
    """
    df = spark.read.parquet(path)
    place = lambda uri: F.regexp_replace(uri, "^([^:/]+):/+", "$1:/")  # noqa: E731 (file:/a and file:///a are the same)
    for file in sorted(df.inputFiles(), key=unquote):
        # Spark opens only the files that a condition on their metadata leaves.
        if rows := df.filter(place(F.col("_metadata.file_path")) == place(F.lit(file))).limit(1).collect():
            return df.columns, rows[0]
    return df.columns, None
