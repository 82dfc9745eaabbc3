"""Toxic passages as maximal-scoring segments of token log-odds.

Model. Each token is one unit: its word without outer punctuation if that is significant, else the word's first
``PREFIX`` bytes if they are, else the common unit "rest". A unit's score is the difference of its log-odds in toxic
and in clean text under a Dirichlet prior; it is significant if that exceeds ``Z``
standard errors. To learn the odds a unit counts once per text, so that a repeated line says no more than one.
"Rest" scores a little below zero, so random text drifts down.

Scan. A linear-time pass finds all maximal segments of each text (disjoint, each with the largest possible sum).
Unit scores are log-odds, so the scores' extreme-value parameter lambda solves sum p exp(lambda s) = 1 over clean
text; K is fitted to the largest segments of clean texts. A segment of score S in n tokens has the normalised score
lambda S - ln(K n), and is significant at ``SIGNIFICANT`` or more. The statistic of a text adds up its significant
segments' normalised scores (logarithmically); a logistic line through it gives the score.

Null and empty texts have no segments and get the score of a text without any. Very long texts are scanned whole. Without labels
of both classes nothing is significant and every text gets the smoothed share of label 1. Repeated rows are scored
each; other columns are ignored (or carried along by ``filter_toxicity``).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fitting import fit_logistic, halves, keep_rows, labelled_sample, remainder, scores, sigmoid
from .text import byte_runs, mix, segment_hashes, string_buffers, word_ranges

PER_CLASS = 3000
MAX_CHARS = 20_000
PREFIX = 6
#: Pseudo-tokens of the Dirichlet prior that lie on the units by their rate, and the least on any unit.
PRIOR = 200.0
LEAST_PRIOR = 0.5
Z = 3.0
LEAST_TEXTS = 3
SIGNIFICANT = 0.0
#: Bytes of text that are scanned at a time.
BLOCK_BYTES = 3 << 20

_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[c for c in range(33, 127) if not chr(c).isalnum()]] = True


def units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hash, prefix hash, start and end of each token, and where each text's tokens begin."""
    starts, ends, at = word_ranges(data, offsets)
    left, right = starts.copy(), ends.copy()
    for side, step, last in ((right, -1, lambda i: right[i] - 1), (left, 1, lambda i: left[i])):
        todo = np.arange(len(starts))
        while len(todo):
            todo = todo[(right[todo] - left[todo] > 1) & _PUNCTUATION[data[last(todo)]]]
            side[todo] += step
    word = segment_hashes(data, left, right)
    prefix = mix(segment_hashes(data, left, np.minimum(right, left + PREFIX)) ^ np.uint64(0x5DEECE66D))
    return word, prefix, starts, ends, at


def maximal_segments(place: np.ndarray, score: np.ndarray, drift: float) -> list[tuple[int, int, float]]:
    """All maximal segments (first, last, sum) where only ``place`` scores and every other token scores ``drift`` <= 0.

    Ruzzo and Tompa's scan: keep a list of candidate segments with their running sums at both ends; a new positive run
    joins candidates as long as the nearest one that starts lower also ends lower. Each candidate remembers which that
    is for itself, so the search jumps from one to the next and what it jumps over is never looked at again: the scan
    is linear. Other tokens are skipped over, as a maximal segment begins and ends at a positive one.
    """
    kept: list[list[float]] = []  # running sum before and after, first, last
    lower: list[int] = []  # the nearest candidate before that starts lower, -1 if none
    total, previous = 0.0, -1
    for i, s in zip(place.tolist(), score.tolist(), strict=True):
        total += drift * (i - previous - 1)
        before, total, previous = total, total + s, i
        if s <= 0:
            continue
        first, j = i, len(kept) - 1
        while j >= 0 and kept[j][0] >= before:
            j = lower[j]
        while j >= 0 and kept[j][1] < total:
            before, _, first, _ = kept[j]
            following = lower[j]
            del kept[j:], lower[j:]
            j = following
        kept.append([before, total, first, i])
        lower.append(j)
    return [(int(a), int(b), hi - lo) for lo, hi, a, b in kept]


@dataclass
class ToxicityModel:
    """Significant units (the sample bounds their number), the drift of all other tokens and the calibration."""

    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    score: np.ndarray = field(default_factory=lambda: np.zeros(0))
    drift: float = -0.01
    scale: float = 1.0
    log_k: float = 0.0
    weight: np.ndarray = field(default_factory=lambda: np.zeros(2))

    def _look_up(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(keys), np.nan)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.score[at], np.nan)

    def segments(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[tuple[int, int, float]]]]:
        """Per text: number of tokens, their byte starts and ends within the text, and its maximal segments."""
        for i, j in byte_runs(texts, BLOCK_BYTES):
            data, offsets = string_buffers(texts.slice(i, j - i))
            word, prefix, starts, ends, at = units(data, offsets)
            own, short = self._look_up(word), self._look_up(prefix)
            value = np.where(np.isnan(own), short, own)
            hits = np.flatnonzero(~np.isnan(value))
            value = value[hits]
            cut = np.searchsorted(hits, at)
            for k in range(j - i):
                a, b = cut[k], cut[k + 1]
                found = maximal_segments(hits[a:b] - at[k], value[a:b], self.drift) if b > a else []
                yield int(at[k + 1] - at[k]), starts[at[k] : at[k + 1]] - offsets[k], ends[at[k] : at[k + 1]] - offsets[k], found

    def normalised(self, score: float, n: int) -> float:
        return self.scale * score - self.log_k - np.log(max(n, 1))

    def statistic(self, n: int, found: list[tuple[int, int, float]]) -> float:
        return float(np.log1p(sum(max(0.0, self.normalised(s, n) - SIGNIFICANT) for _, _, s in found)))

    def __call__(self, texts: pa.Array) -> np.ndarray:
        x = np.fromiter((self.statistic(n, found) for n, _, _, found in self.segments(texts)), float, len(texts))
        return sigmoid(x * self.weight[0] + self.weight[1])


def _significant(texts: pa.Array, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, np.ndarray]:
    """Keys, scores, drift, and the share of each key (then of the rest) among clean tokens."""
    data, offsets = string_buffers(texts)
    word, prefix, _, _, at = units(data, offsets)
    text_of = np.repeat(np.arange(len(y)), np.diff(at))
    toxic = y[text_of] == 1
    if not toxic.any() or toxic.all():
        return np.zeros(0, np.uint64), np.zeros(0), -0.01, np.ones(1)
    found = []
    for keys in (word, prefix):
        unique, inverse = np.unique(keys, return_inverse=True)
        pairs = np.unique(inverse * np.int64(len(y)) + text_of)
        of, marked = pairs // len(y), y[pairs % len(y)] == 1
        count = np.stack([np.bincount(of, ~marked, len(unique)), np.bincount(of, marked, len(unique))])
        n = count.sum(1, keepdims=True)
        prior = LEAST_PRIOR + PRIOR * count.sum(0) / n.sum()
        odds = np.log((count + prior) / (n + prior.sum() - count - prior))
        delta = odds[1] - odds[0]
        z = delta / np.sqrt((1 / (count + prior)).sum(0))
        good = np.flatnonzero((z >= Z) & (count[1] >= LEAST_TEXTS))
        found.append((unique[good], delta[good]))
    keys, score = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(keys)
    keys, score = keys[order], score[order]
    model = ToxicityModel(keys, score)
    own = model._look_up(word)
    rest = np.isnan(own) & np.isnan(model._look_up(prefix))
    n = np.array([np.count_nonzero(~toxic), np.count_nonzero(toxic)])
    share = [(np.count_nonzero(rest & (toxic == k)) + PRIOR * rest.mean()) / (n[int(k)] + PRIOR) for k in (False, True)]
    drift = min(float(np.log(share[1] / share[0])), -1e-3)
    used = np.where(np.isnan(own), prefix, word)[~toxic & ~rest]
    clean = np.bincount(np.searchsorted(keys, used), minlength=len(keys)) / n[0] if len(keys) else np.zeros(0)
    return keys, score, drift, np.append(clean, 1 - clean.sum())


def _scale(score: np.ndarray, share: np.ndarray) -> float:
    """The positive lambda with sum share * exp(lambda * score) = 1, by bisection."""
    total = lambda x: float(share @ np.exp(np.minimum(x * score, 700.0)))
    low, high = 1e-6, 1.0
    if not (score > 0).any() or not share[score > 0].any():
        return 1.0
    while total(high) < 1 and high < 64:
        high *= 2
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if total(middle) < 1 else (low, middle)
    return max(low, 0.05)


def fit_toxicity(texts: list[str], y: np.ndarray) -> ToxicityModel:
    build, check = halves(len(texts))
    column = pa.array(texts, pa.large_string())
    keys, score, drift, share = _significant(column.take(pa.array(build, pa.int64())), y[build])
    model = ToxicityModel(keys, score, drift, _scale(np.append(score, drift), share))
    held = [(n, found) for n, _, _, found in model.segments(column.take(pa.array(check, pa.int64())))]
    clean = [(n, max((s for _, _, s in found), default=0.0)) for (n, found), k in zip(held, y[check], strict=True) if k == 0 and n]
    if clean:  # E-values of the best clean segments should average 1 where lambda holds: K from the mean of exp(-lambda S) / n
        model.log_k = float(np.log(len(clean)) - np.log(sum(n * np.exp(-model.scale * s) for n, s in clean)))
    model.weight = fit_logistic(np.array([model.statistic(n, found) for n, found in held]).reshape(-1, 1), y[check])
    return model


def train_toxicity(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """Fit on labelled rows whose crc32 modulo 5 is not 0."""
    return fit_toxicity(*labelled_sample(docs, labels, "toxic", remainder(F.col("_id"), 5) != 0, PER_CLASS, MAX_CHARS))


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs``."""
    held_out = F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(False))
    return scores(docs, train_toxicity(docs, labels)).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def toxic_passages(docs: DataFrame, model: ToxicityModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every significant passage: doc_id, first and last byte offset, its score, E-value and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for key, t, (n, starts, ends, found) in zip(b.column(0), b.column(1), model.segments(b.column(1)), strict=True):
                for first, last, s in found:
                    if (z := model.normalised(s, n)) >= SIGNIFICANT:
                        a, e = int(starts[first]), int(ends[last])
                        rows.append((key.as_py(), a, e, s, float(np.exp(-z)), t.as_buffer().to_pybytes()[a:e].decode(errors="replace")))
            columns = zip(*rows, strict=True) if rows else [[]] * 6
            yield pa.record_batch([pa.array(list(c), k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.string()), strict=True)], ["doc_id", "first_byte", "end_byte", "score", "e_value", "passage"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, first_byte long, end_byte long, score double, e_value double, passage string")


def filter_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier doesn't take for toxic."""
    return keep_rows(docs, train_toxicity(docs, labels), 0)
