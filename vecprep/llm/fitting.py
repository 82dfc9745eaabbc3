"""What the two text classifiers share: a bounded labelled sample, a logistic fit and scoring in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Scorer = Callable[[pa.Array], np.ndarray]


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text modulo ``modulus``; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, per_class: int, max_chars: int, doc_id: str = "doc_id", text: str = "text") -> tuple[list[str], np.ndarray]:
    """Texts and 0/1 labels to fit on: in hash order the first ``per_class`` usable labelled ids of each class.

    The ids (2 * per_class at most, so they may be broadcast) come from ``labels`` alone; then their texts of at most
    ``max_chars`` characters, whole. Both bounds are parameters of the fit only; scoring never uses them. Of several
    labels of an id the larger counts; of several rows with an id the least text.
    """
    known = labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("_label")).filter(F.col("_label").isin(0, 1) & F.col("_id").isNotNull())
    known = known.groupBy("_id").agg(F.max("_label").alias("_label")).filter(usable)
    order = F.xxhash64(F.col("_id"), F.lit("sample"))
    chosen = [known.filter(F.col("_label") == k).orderBy(order, "_id").limit(per_class) for k in (0, 1)]
    chosen = F.broadcast(chosen[0].unionByName(chosen[1]))
    rows = docs.select(F.col(doc_id).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text")).filter(F.length("_text") <= max_chars)
    got = rows.join(chosen, "_id").groupBy("_id", "_label").agg(F.min("_text").alias("_text")).toArrow().sort_by("_id")
    return got["_text"].to_pylist(), np.array(got["_label"].to_pylist(), np.int64)


def halves(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Two disjoint halves of a sample: for building and for calibrating; a tiny sample serves both."""
    if n < 8:
        return np.arange(n), np.arange(n)
    order = np.random.Generator(np.random.PCG64(n)).permutation(n)
    return order[: n // 2], order[n // 2 :]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Coefficients (last: constant) by Newton's method; one class alone or no rows give the smoothed prior."""
    if len(y) == 0 or len(np.unique(y)) < 2:
        rate = (y.sum() + 0.5) / (len(y) + 1)
        return np.append(np.zeros(x.shape[1] if x.ndim == 2 else 1), np.log(rate / (1 - rate)))
    a = np.column_stack([x, np.ones(len(y))]).astype(float)
    scale = np.append(np.maximum(a[:, :-1].std(axis=0), 1e-12), 1.0)
    a /= scale
    w = np.zeros(a.shape[1])
    penalty = np.diag(np.append(np.full(a.shape[1] - 1, ridge), 1e-9))
    for _ in range(60):
        p = sigmoid(a @ w)
        hessian = (a * (p * (1 - p))[:, None]).T @ a + penalty
        step = np.linalg.solve(hessian, a.T @ (y - p) - penalty @ w)
        size = np.abs(step).max()
        w += step * min(1.0, 4.0 / max(size, 1e-12))
        if size < 1e-9:
            break
    return w / scale


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def scores(docs: DataFrame, scorer: Scorer, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score and predicted for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = scorer(b.column(1))
            yield pa.record_batch([b.column(0), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double, predicted int")


def keep_rows(docs: DataFrame, scorer: Scorer, wanted: int, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose prediction is ``wanted``."""
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array((scorer(b.column(place)) >= 0.5) == bool(wanted)))

    return docs.mapInArrow(run, docs.schema)
