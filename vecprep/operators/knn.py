"""Exact k nearest neighbours by brute force, L2 or inner product.

The default works on blocks: base rows are scored against blocks of queries by one matrix product in double precision,
every candidate within rounding of the k-th is scored again component by component, as an SQL engine would, and each
task returns its own k best per query; a window keeps the k best of those (ties to the smaller id). Queries are
broadcast only if they and their best rows fit ``BROADCAST_BYTES`` (counted first); otherwise query blocks are sent to blocks of base rows by
an equi-join on block numbers. ``strategy="expr"`` ranks as column expressions do whatever a vector holds: pairs of
finite vectors of one length go by blocks, whose scores equal the expressions' bit by bit, and only those of a vector that
is null, of another length, or holds a null or non-finite component are crossed and scored by the expressions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vector as V
from ..schema import require
from ..tables import materialise

METRICS = ("l2", "ip")
BROADCAST_BYTES = 64 << 20
QUERY_ROWS = 1024
BASE_ROWS = 8192
#: Scores held at once (8 MB), and bytes of vectors that are scored again at once.
QUERY_TILE = 256
BASE_TILE = 4096
SCORED_BYTES = 8 << 20
#: More rows than this times k near a query's k-th are cut by the tile's own k-th first.
MANY = 4
#: Components beyond this could make the kernel's sums infinite.
MOST = 1e100
FOUND = "query_ord long, base_ord long, score double"


def _matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)


def _in_order(x: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    """Scores of row pairs, summed component by component from the first."""
    total = np.zeros(len(x))
    for d in range(x.shape[1]):
        total += x[:, d] * q[:, d] if metric == "ip" else (q[:, d] - x[:, d]) * (q[:, d] - x[:, d])
    return total


class Best:
    """The k best base rows of each query among the blocks added so far, ties to the smaller id.

    A block is taken in tiles of ``BASE_TILE`` rows by ``QUERY_TILE`` queries, so that the arrays beside block and queries
    stay small however many rows tie. Once k rows are known, only rows that come near a query's k-th are scored again.
    """

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int, metric: str):
        self.query_ids, self.q, self.k, self.metric = ids, q, k, metric
        self.qq = np.einsum("ij,ij->i", q, q)
        self.cost = np.full((len(q), k), np.inf)  # ascending; inner products are negated
        self.ids = np.full((len(q), k), np.iinfo(np.int64).max)

    def add(self, x: np.ndarray, ids: np.ndarray) -> None:
        for i in range(0, len(x), BASE_TILE):
            tile, tile_ids = x[i : i + BASE_TILE], ids[i : i + BASE_TILE]
            xx = np.einsum("ij,ij->i", tile, tile)
            for j in range(0, len(self.q), QUERY_TILE):
                self._tile(slice(j, j + QUERY_TILE), tile, tile_ids, xx)

    def _tile(self, at: slice, x: np.ndarray, ids: np.ndarray, xx: np.ndarray) -> None:
        q, qq, cost, best = self.q[at], self.qq[at], self.cost[at], self.ids[at]
        rough = q @ x.T
        rough *= -1 if self.metric == "ip" else -2
        if self.metric == "l2":
            rough += qq[:, None]
            rough += xx
        # Rounding of a sum of d products is below d * eps * |q| * |x|.
        slack = 8 * x.shape[1] * np.finfo(float).eps * (np.sqrt(qq) + np.sqrt(xx.max(initial=0.0))) ** 2
        near = rough <= (cost[:, -1] + slack)[:, None]
        many = np.flatnonzero(np.count_nonzero(near, axis=1) > MANY * self.k)
        if len(many):
            cut = np.partition(rough[many], self.k - 1, axis=1)[:, self.k - 1]
            near[many] &= rough[many] <= (cut + slack[many])[:, None]
        row, col = np.nonzero(near)
        del rough, near
        if not len(row):
            return
        step = max(1, SCORED_BYTES // (16 * x.shape[1]))
        score = np.concatenate([_in_order(x[col[i : i + step]], q[row[i : i + step]], self.metric) for i in range(0, len(row), step)])
        touched, place = np.unique(row, return_inverse=True)
        row = np.concatenate([np.repeat(np.arange(len(touched)), self.k), place])
        score = np.concatenate([cost[touched].ravel(), -score if self.metric == "ip" else score])
        found = np.concatenate([best[touched].ravel(), ids[col]])
        order = np.lexsort((found, score, row))
        start = np.searchsorted(row[order], np.arange(len(touched)))
        keep = order[start[:, None] + np.arange(self.k)]
        cost[touched], best[touched] = score[keep], found[keep]

    def found(self) -> Iterator[pa.RecordBatch]:
        for j in range(0, len(self.q), QUERY_ROWS):
            cost = self.cost[j : j + QUERY_ROWS]
            row, col = np.nonzero(cost < np.inf)
            score = -cost[row, col] if self.metric == "ip" else cost[row, col]
            yield pa.record_batch([pa.array(c) for c in (self.query_ids[j + row], self.ids[j + row, col], score)], ["query_ord", "base_ord", "score"])


def _broadcast_kernel(queries, k: int, metric: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for batch in batches:
            best = best or Best(*queries.value, k, metric)
            for i in range(0, len(batch), BASE_ROWS):
                part = batch.slice(i, BASE_ROWS)
                best.add(_matrix(part.column(1)), part.column(0).to_numpy())
        if best:
            yield from best.found()

    return run


def _pack(rows: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for i in range(0, len(batch), rows):
                part = batch.slice(i, rows)
                data = part.column(0).to_numpy().astype("<i8").tobytes() + _matrix(part.column(1)).astype("<f8").tobytes()
                yield pa.record_batch([pa.array([number]), pa.array([len(part)], pa.int32()), pa.array([data], pa.binary())], ["block", "n", "data"])
                number += 1

    return run


def _unpack(data: pa.Buffer, n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(data, "<i8", n), np.frombuffer(data, "<f8", offset=8 * n).reshape(n, -1)


def _block_kernel(k: int, metric: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for qn, queries, n, data in zip(*(batch.column(c) for c in range(4)), strict=True):
                q_ids, q = _unpack(queries.as_buffer(), qn.as_py())
                ids, x = _unpack(data.as_buffer(), n.as_py())
                best = Best(q_ids, q, k, metric)
                best.add(x, ids)
                yield from best.found()

    return run


def _by_blocks(base: DataFrame, query: DataFrame, k: int, metric: str) -> DataFrame:
    shards = materialise(base.mapInArrow(_pack(BASE_ROWS), "block long, n int, data binary"), "knn-base")
    blocks = query.mapInArrow(_pack(QUERY_ROWS), "block long, n int, data binary")
    numbers = shards.agg(F.collect_list("block").alias("numbers"))  # 8 bytes for each block of base rows
    sent = blocks.crossJoin(F.broadcast(numbers)).select(F.explode("numbers").alias("block"), F.col("n").alias("qn"), F.col("data").alias("queries"))
    return sent.join(shards, "block").select("qn", "queries", "n", "data").mapInArrow(_block_kernel(k, metric), FOUND)


def _by_kernel(base: DataFrame, query: DataFrame, k: int, metric: str, broadcast_bytes: int) -> DataFrame:
    n, d = query.agg(F.count("*"), F.coalesce(F.max(F.size("vec")), F.lit(0))).collect()[0]
    if n == 0:
        return base.sparkSession.createDataFrame([], FOUND)
    if n * (8 * d + 8 + 16 * k) > broadcast_bytes:  # each task also holds the best rows of all queries
        return _by_blocks(base, query, k, metric)
    rows = query.toArrow()
    vectors = rows["vec"].combine_chunks()
    data = (rows["ord"].to_numpy(), _matrix(vectors if isinstance(vectors, pa.Array) else vectors.chunk(0)))
    return base.mapInArrow(_broadcast_kernel(base.sparkSession.sparkContext.broadcast(data), k, metric), FOUND)


def _crossed(base: DataFrame, query: DataFrame, metric: str) -> DataFrame:
    """All pairs, scored by column expressions."""
    b, q = F.col("_base.vec"), F.col("_query.vec")
    score = V.dot(q, b) if metric == "ip" else V.squared_distance(q, b)
    pairs = base.select(F.struct("ord", "vec").alias("_base")).crossJoin(query.select(F.struct("ord", "vec").alias("_query")))
    return pairs.select(F.col("_query.ord").alias("query_ord"), F.col("_base.ord").alias("base_ord"), score.alias("score"))


def _as_expressions(base: DataFrame, query: DataFrame, k: int, metric: str, broadcast_bytes: int) -> DataFrame:
    """What the kernel can't rank (see above) is looked for first: most sets have none and cross nothing."""
    d = query.agg(F.mode(F.size("vec"))).collect()[0][0] or 0
    fits = F.forall("vec", lambda x: F.coalesce(F.abs(x.cast("double")) < MOST, F.lit(False)))
    whole = F.coalesce(F.col("ord").isNotNull() & (F.size("vec") == d) & (F.size("vec") > 0) & fits, F.lit(False))
    found = _by_kernel(base.filter(whole), query.filter(whole), k, metric, broadcast_bytes)
    if query.filter(~whole).limit(1).count():
        found = found.unionByName(_crossed(base.filter(whole), query.filter(~whole), metric))
    if base.filter(~whole).limit(1).count():
        found = found.unionByName(_crossed(base.filter(~whole), query, metric))
    return found


STRATEGIES = {"blocks": _by_kernel, "expr": _as_expressions}


def knn(base: DataFrame, query: DataFrame, k: int, metric: str = "l2", strategy: str = "blocks", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Long neighbours (query_ord, rank, base_ord, score) of (ord, vec) sets, best first; fewer than k if base is smaller.

    Scores are squared distances (``l2``, ascending) or inner products (``ip``, descending). Rank counts from 1.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric '{metric}'; there are {', '.join(METRICS)}")
    if k <= 0:
        raise ValueError("k must be positive")
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy '{strategy}'")
    base, query = require(base, "ord", "vec").select("ord", "vec"), require(query, "ord", "vec").select("ord", "vec")
    found = STRATEGIES[strategy](base, query, k, metric, broadcast_bytes)
    best = F.desc("score") if metric == "ip" else F.asc("score")
    rank = F.row_number().over(Window.partitionBy("query_ord").orderBy(best, "base_ord"))
    ranked = found.withColumn("rank", rank).filter(F.col("rank") <= k)
    return ranked.select("query_ord", F.col("rank").cast("int").alias("rank"), "base_ord", "score")


def wide(neighbors: DataFrame) -> DataFrame:
    """Ground truth rows (query_ord, ids) in order of rank; a query has at most k neighbours."""
    ids = F.transform(F.array_sort(F.collect_list(F.struct("rank", "base_ord"))), lambda x: x["base_ord"])
    return neighbors.groupBy("query_ord").agg(ids.alias("ids"))


def long(ground_truth: DataFrame) -> DataFrame:
    """(query_ord, rank, base_ord) of wide ground truth."""
    return ground_truth.select("query_ord", F.posexplode("ids").alias("_at", "base_ord")).select("query_ord", (F.col("_at") + 1).alias("rank"), F.col("base_ord").cast("long").alias("base_ord"))
