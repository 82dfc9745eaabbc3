"""Readers and writers: fvecs, ivecs, HDF5, Parquet, YAML."""

from .files import find_files, first_row, read_vectors
from .fvecs import read_fvecs, swap_endianness, write_fvecs
from .ivecs import read_ivecs, write_ivecs

__all__ = ["find_files", "first_row", "read_fvecs", "read_ivecs", "read_vectors", "swap_endianness", "write_fvecs", "write_ivecs"]
