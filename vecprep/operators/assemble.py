"""Concatenation, pairing of files, sharding and query/base splits."""

from __future__ import annotations

from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import dataset_name, match_rank, shared_prefix
from ..schema import require
from .order import reordinal, sample


def dimension(df: DataFrame, vec: str = "vec") -> int | None:
    """The common length of all vectors, None if there are none; an error if they differ."""
    low, high = df.agg(F.min(F.size(vec)), F.max(F.size(vec))).collect()[0]
    if low != high:
        raise ValueError(f"inconsistent dimension: {low} to {high}")
    return low


def concat(a: DataFrame, b: DataFrame, vec: str = "vec", ord: str = "ord") -> DataFrame:
    """The vectors of ``a``, then those of ``b``; dimensions must agree."""
    x, y = dimension(a, vec), dimension(b, vec)
    if None not in (x, y) and x != y:
        raise ValueError(f"dimensions differ: {x} and {y}")
    shift = a.agg(F.coalesce(F.max(ord) + 1, F.lit(0)).alias("_shift"))
    moved = b.crossJoin(F.broadcast(shift)).withColumn(ord, F.col(ord) + F.col("_shift")).drop("_shift")
    return a.unionByName(moved)


def larger_first(a: tuple[str, DataFrame], b: tuple[str, DataFrame], **columns: str) -> DataFrame:
    """``concat`` of two named sets, the larger first, ties by name."""
    (_, first), (_, second) = sorted((a, b), key=lambda x: (-x[1].count(), x[0]))
    return concat(first, second, **columns)


def best_partners(names: Sequence[str]) -> dict[str, str]:
    """Each file's best partner: most shared leading tokens, then the longer, then the greater prefix, then the first."""
    ordered, out = sorted(names), {}
    for a in ordered:
        ranked = [(rank, -i) for i, b in enumerate(ordered) if a != b and (rank := match_rank(a, b)) is not None]
        if ranked:
            out[a] = ordered[-max(ranked)[1]]
    return out


def pair_files(names: Sequence[str]) -> tuple[dict[str, tuple[str, str]], list[str]]:
    """Files that are each other's best partner, by shared prefix, and the rest; two pairs with one prefix are an error."""
    best = best_partners(names)
    pairs: dict[str, tuple[str, str]] = {}
    for a in sorted(names):
        b = best.get(a)
        if b is not None and a < b and best.get(b) == a:
            name = dataset_name(shared_prefix(a, b))
            if name in pairs:
                raise ValueError(f"two pairs share the prefix '{name}'")
            pairs[name] = (a, b)
    used = {x for pair in pairs.values() for x in pair}
    return pairs, [x for x in sorted(names) if x not in used]


def shard_id(ord: Column, size: int) -> Column:
    if size <= 0:
        raise ValueError("the shard size must be positive")
    return F.floor(ord / size)


def shards(df: DataFrame, size: int, base: str = "x", ord: str = "ord") -> DataFrame:
    """shard_id, n and the file name of each shard: full ones ``base_size_i``, the rest ``base_n_i``."""
    counted = require(df, ord).groupBy(shard_id(F.col(ord), size).alias("shard_id")).agg(F.count("*").alias("n"))
    return counted.withColumn("name", F.concat(F.lit(f"{base}_"), F.col("n").cast("string"), F.lit("_"), F.col("shard_id").cast("string")))


def split(df: DataFrame, num_query: int, num_base: int | None = None, seed: int = 42, ord: str = "ord") -> tuple[DataFrame, DataFrame]:
    """``num_query`` sampled rows and (the first ``num_base`` of) the others, both in file order and numbered anew."""
    total = require(df, ord).count()
    if num_query > total:
        raise ValueError(f"{num_query} queries were asked of {total} vectors")
    chosen = sample(df, num_query, seed, ord).select(F.col(ord).alias("_chosen"))
    query = reordinal(df.join(chosen, F.col(ord) == F.col("_chosen"), "left_semi"), ord)
    base = reordinal(df.join(chosen, F.col(ord) == F.col("_chosen"), "left_anti"), ord)
    return query, base if num_base is None else base.filter(F.col(ord) < num_base)


def shard_folder(base: Path, name: str) -> Path:
    """Where a shard goes; the folder must be absolute."""
    if not base.is_absolute():
        raise ValueError(f"the output folder must be absolute: {base}")
    return base / name
