"""Exact top-k by inner product of quantised vectors, with MaxScore.

Terms are a vector's places; a vector posts floor(256 * x) to each. A shard keeps a posting list per place, in the order
of its vectors (every vector posts to every place, so a list holds the values alone). A place d contributes q_d * v_d, at
least its least and at most its greatest value in the shard, so q_d * v_d less the least is an impact between 0 and the
place's bound. For a query the places are sorted by bound; the longest run of small bounds that together can't reach the
score to beat is non-essential. The essential places' postings are added up for all vectors of the shard. Then, from the
largest bound down, the other places are probed for those vectors only whose score so far plus the bounds still open can
reach the score to beat, which rises with what the vectors have for sure (the k-th best score so far plus the least that
is still open). Equal scores go to the smaller id, so a vector stays in while it can tie. Shards' lists are merged by a
window that keeps k rows per query.

Queries meet shards as blocks: a block of up to ``QUERIES`` queries is sent to each shard by the shard's number (8 bytes a
shard are gathered per vector length), never row by row. Each block meets one shard first; the k-th best scores there go
along to all shards as the scores to beat.

Vectors that are null or hold null or non-finite components take no part, nor do null ids; vectors of another length
than the query's aren't its candidates. Of several rows with a query's id the least vector asks; none of them is its own
candidate. Scores must fit a 64-bit integer. An empty table, or one without queries, gives an empty result. Other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import drop, materialise

SHARD = 4096
QUERIES = 1024
#: Places probed at a time.
STEP = 8
_BLOCK = "id long, dim int, data binary"


def _pack(size: int, scale: float) -> Callable:
    """Rows (id, vector) as blocks of up to ``size`` vectors of one length: ids, then the values place by place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            lengths = np.asarray(batch.column(1).value_lengths())
            for dim in np.unique(lengths):
                part = batch.filter(pa.array(lengths == dim))
                ids = part.column(0).to_numpy()
                x = np.floor(part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1) * scale)
                for i in range(0, len(ids), size):
                    data = ids[i : i + size].astype("<i8").tobytes() + np.ascontiguousarray(x[i : i + size].T, "<f8").tobytes()
                    yield pa.record_batch([pa.array([number], pa.int64()), pa.array([dim], pa.int32()), pa.array([data], pa.binary())], ["id", "dim", "data"])
                    number += 1

    return run


def _unpack(data: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids, and values as places x vectors."""
    n = len(data) // (8 * (dim + 1))
    return np.frombuffer(data, "<i8", n), np.frombuffer(data, "<f8", n * dim, 8 * n).reshape(dim, n)


def _exact(postings: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both in the smallest type in which every sum of products is exact."""
    most = np.abs(q).max(initial=0) * np.abs(postings).max(initial=0) * max(len(postings), 1)
    kind = np.float32 if most < 2.0**24 else np.float64 if most < 2.0**53 else np.int64
    return postings.astype(kind), q.astype(kind)


class Shard:
    """Posting lists of one length of vectors, with the least and greatest value of each."""

    def __init__(self, ids: np.ndarray, postings: np.ndarray):
        self.ids, self.postings = ids, postings
        self.low, self.high = postings.min(axis=1), postings.max(axis=1)

    def best(self, q_id: int, q: np.ndarray, k: int, beat: float = -np.inf) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the query's k best vectors that reach ``beat``, best first."""
        ends = np.stack([q * self.low, q * self.high])
        least, bound = ends.min(axis=0), np.abs(ends[1] - ends[0])
        place = np.argsort(-bound, kind="stable")
        open_bound = np.append(np.cumsum(bound[place][::-1])[::-1], 0)  # of the places from j on
        open_least = np.append(np.cumsum(least[place][::-1])[::-1], 0)
        # Essential: all places up to where the bounds still open, above what every vector has, can't reach ``beat``.
        j = max(1, int(np.count_nonzero(open_bound[:-1] + open_least[0] >= beat))) if np.isfinite(beat) else min(STEP, len(place))
        rows = np.flatnonzero(self.ids != q_id)
        total = (q[place[:j]] @ self.postings[place[:j]])[rows]
        while True:
            if len(rows) >= k:
                beat = max(beat, float(np.partition(total, len(rows) - k)[len(rows) - k] + open_least[j]))
            can = total + (open_bound[j] + open_least[j]) >= beat
            rows, total = rows[can], total[can]
            if j == len(place) or not len(rows):
                break
            following = place[j : j + STEP]
            total = total + q[following] @ self.postings[following[:, None], rows]
            j += len(following)
        order = np.lexsort((self.ids[rows], -total))[:k]
        return self.ids[rows[order]], total[order].astype(np.int64)


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Scalar, Shard, np.ndarray, np.ndarray, np.ndarray]]:
    """Of rows (dim, shard, queries, beat): length, block as it is, shard, ids, vectors and scores to beat of the queries."""
    for batch in batches:
        for dim, shard, queries, beat in zip(*(batch.column(c) for c in range(4)), strict=True):
            ids, postings = _unpack(shard.as_buffer(), dim.as_py())
            q_ids, q = _unpack(queries.as_buffer(), dim.as_py())
            postings, q = _exact(postings, q)
            known = np.frombuffer(beat.as_buffer(), "<f8") if beat.is_valid else np.full(len(q_ids), -np.inf)
            yield dim.as_py(), queries, Shard(ids, postings), q_ids, q.T, known


def _first_scores(k: int) -> Callable:
    """The blocks with the k-th best scores in the shard they meet (-inf where it has fewer)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, block, shard, q_ids, q, _ in _meetings(batches):
            scores = [shard.best(one, row, k)[1] for one, row in zip(q_ids.tolist(), q, strict=True)]
            beat = np.array([s[k - 1] if len(s) == k else -np.inf for s in scores], "<f8")
            yield pa.record_batch([pa.array([dim], pa.int32()), pa.array([block.as_py()], pa.binary()), pa.array([beat.tobytes()], pa.binary())], ["dim", "data", "beat"])

    return run


def _search(k: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, shard, q_ids, q, known in _meetings(batches):
            found = [(np.full(len(ids), one), ids, score) for one, row, beat in zip(q_ids.tolist(), q, known.tolist(), strict=True) for ids, score in [shard.best(one, row, k, beat)]]
            yield pa.record_batch([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*found, strict=True)], ["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, is_query: str, *, k: int = 5, scale: float = 256.0, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` best other vectors of each row that meets ``is_query``, an
    expression on the id, which is called ``_id`` in it."""
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    rows = vectors.select(F.col(vec_id).cast("long").alias("_id"), F.col(embedding).cast("array<double>").alias("vector"))
    rows = rows.filter(F.col("_id").isNotNull() & F.coalesce((F.size("vector") > 0) & finite, F.lit(False)))
    asking = rows.filter(is_query).groupBy("_id").agg(F.min("vector").alias("vector"))
    shards = materialise(rows.mapInArrow(_pack(SHARD, scale), _BLOCK), "maxscore-shards")
    asking = asking.repartition(-(-max(rows.filter(is_query).count(), 1) // QUERIES))
    blocks = materialise(asking.mapInArrow(_pack(QUERIES, scale), _BLOCK), "maxscore-queries")
    # Every query block is told the numbers of the shards and meets each of them where it lies; blocks are the smaller side.
    numbers = shards.groupBy("dim").agg(F.min("id").alias("first"), F.collect_list("id").alias("shard_ids"))
    meet = lambda sent: sent.join(shards.select("id", "dim", F.col("data").alias("shard")), ["id", "dim"]).select("dim", "shard", "queries", "beat")
    first = blocks.join(numbers, "dim").select("dim", F.col("data").alias("queries"), F.lit(None).cast("binary").alias("beat"), F.col("first").alias("id"))
    told = materialise(meet(first).mapInArrow(_first_scores(k), "dim int, data binary, beat binary"), "maxscore-beat")
    drop(blocks)
    sent = told.join(numbers, "dim").select("dim", F.col("data").alias("queries"), "beat", F.explode("shard_ids").alias("id"))
    found = meet(sent).mapInArrow(_search(k), "query_id long, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


ORACLE_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
