"""Names of data-set files: shared prefixes, pair scores, keys as file names, bin edges as text."""

from __future__ import annotations

import math
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F


def stem_tokens(name: str) -> list[str]:
    return Path(name).stem.split("_")


def shared_prefix(a: str, b: str) -> list[str]:
    """Leading ``_``-separated tokens that two file stems have in common."""
    x, y = stem_tokens(a), stem_tokens(b)
    n = next((i for i, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))
    return x[:n]


def dataset_name(tokens: Sequence[str]) -> str:
    """All tokens, numeric ones too, joined again."""
    return "_".join(tokens)


def match_rank(a: str, b: str) -> tuple[int, int, str] | None:
    """How well two files go together: number of tokens, length, prefix; None if nothing is shared."""
    name = dataset_name(tokens := shared_prefix(a, b))
    return (len(tokens), len(name), name) if name else None


def shared_prefix_column(a: Column, b: Column) -> Column:
    """``dataset_name(shared_prefix(a, b))`` for columns of stems."""
    x, y = F.split(a, "_"), F.split(b, "_")
    same = F.zip_with(x, y, lambda p, q: F.coalesce(p == q, F.lit(False)))
    first = F.array_position(same, F.lit(False)).cast("int")
    n = F.when(first == 0, F.least(F.size(x), F.size(y))).otherwise(first - 1)
    return F.array_join(F.slice(x, F.lit(1), n), "_")


def key_as_file_name(key: str) -> str:
    return key.replace("/", "__")


def bin_edge(value: float, span: float, largest: float) -> str:
    """A histogram edge: fixed decimals in a narrow range of ordinary size, else scientific."""
    if 0 < span < 1 and 1e-4 <= largest <= 1e4:
        return f"{value:.{min(12, max(0, math.ceil(-math.log10(span)) + 2))}f}"
    return f"{value:.6e}"
