"""Record files of 32-bit words: a length, then as many components.

An fvecs file has float32 components and one length throughout; an ivecs file has int32 components and may mix lengths.
Either byte order.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

ENDIAN = {"little": "<", "big": ">"}


def order_of(endian: str) -> str:
    if endian not in ENDIAN:
        raise ValueError(f"unknown byte order '{endian}'; there are little and big")
    return ENDIAN[endian]


@dataclass(frozen=True)
class Layout:
    """Dimension and number of records of a file of equal records."""

    dim: int
    count: int

    @property
    def record_bytes(self) -> int:
        return 4 * (self.dim + 1)


def layout(path: str, endian: str = "little") -> Layout:
    """From the first length and the file's size alone; an empty file has dimension 0 and no records."""
    size = os.path.getsize(path)
    if size == 0:
        return Layout(0, 0)
    if size < 4:
        raise ValueError(f"{path}: truncated header")
    with open(path, "rb") as f:
        dim = int(np.frombuffer(f.read(4), order_of(endian) + "i4")[0])
    if dim <= 0:
        raise ValueError(f"{path}: non-positive dimension {dim} at record 0")
    if size % (4 * (dim + 1)):
        locate_fault(path, endian)
    return Layout(dim, size // (4 * (dim + 1)))


def locate_fault(path: str, endian: str) -> None:
    """Walk the records of a file that isn't a whole number of them and say what is wrong where."""
    size, kind = os.path.getsize(path), order_of(endian) + "i4"
    with open(path, "rb") as f:
        at, record, dim = 0, 0, None
        while at < size:
            f.seek(at)
            head = f.read(4)
            if len(head) < 4:
                raise ValueError(f"{path}: truncated header at record {record}")
            d = int(np.frombuffer(head, kind)[0])
            if d <= 0:
                raise ValueError(f"{path}: non-positive dimension {d} at record {record}")
            if dim is not None and d != dim:
                raise ValueError(f"{path}: inconsistent dimension {d} at record {record}, expected {dim}")
            dim = d
            at += 4 * (d + 1)
            if at > size:
                raise ValueError(f"{path}: truncated payload at record {record}")
            record += 1


def read_records(path: str, shape: Layout, start: int, end: int, kind: str, endian: str, rows: int) -> Iterator[tuple[int, np.ndarray]]:
    """Records [start, end) as (first ordinal, matrix); every length is checked."""
    order = order_of(endian)
    with open(path, "rb") as f:
        f.seek(start * shape.record_bytes)
        for first in range(start, end, rows):
            n = min(rows, end - first)
            raw = np.fromfile(f, order + "i4", n * (shape.dim + 1)).reshape(-1, shape.dim + 1)
            if len(raw) < n:
                raise ValueError(f"{path}: truncated payload at record {first + len(raw)}")
            wrong = np.flatnonzero(raw[:, 0] != shape.dim)
            if len(wrong):
                raise ValueError(f"{path}: inconsistent dimension {raw[wrong[0], 0]} at record {first + wrong[0]}, expected {shape.dim}")
            body = np.ascontiguousarray(raw[:, 1:])
            yield first, body.view(order + kind).astype("=" + kind)


def encode_matrix(rows: np.ndarray, kind: str, endian: str) -> bytes:
    """Records of equal length."""
    order = order_of(endian)
    n, dim = rows.shape
    out = np.empty((n, dim + 1), order + "i4")
    out[:, 0] = dim
    out[:, 1:] = np.ascontiguousarray(rows.astype(order + kind)).view(order + "i4")
    return out.tobytes()


def encode_lists(values: np.ndarray, lengths: np.ndarray, endian: str) -> bytes:
    """int32 records of any lengths from their values laid end to end."""
    order = order_of(endian)
    out = np.empty(len(values) + len(lengths), order + "i4")
    heads = np.cumsum(lengths) - lengths + np.arange(len(lengths))
    body = np.ones(len(out), bool)
    body[heads] = False
    out[heads], out[body] = lengths, values
    return out.tobytes()
