"""Quality by compression: which of two Zstandard dictionaries, built from good and from bad text, shortens a text more.

``fit_quality`` trains one dictionary on good and one on bad labelled texts and calibrates, on the other half of the
sample, the difference of the two compressed sizes divided by the text's bytes. Texts are compressed block by block,
all of them, so that the difference per byte doesn't shrink as a long text comes to serve as its own dictionary. The
difference says nothing of a text that compresses to next to nothing under either dictionary (one word repeated), so the
calibration also knows how far the good one compresses it (the logarithm of the ratio), and how short a text is: a few
words say little either way.

Null and empty texts have difference 0 and are as short as can be; they get that score. Very long texts are compressed whole. Without labels of
both classes every text gets the smoothed share of label 1. Repeated rows are scored each; other columns are ignored
(or carried along by ``filter_quality``).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fitting import fit_logistic, halves, keep_rows, labelled_sample, remainder, scores, sigmoid

PER_CLASS = 3000
MAX_CHARS = 20_000
DICTIONARY_BYTES = 110 << 10
LEVEL = 3
#: Bytes of the blocks that are compressed on their own, and of the samples to train a dictionary.
BLOCK_BYTES = 4096
#: A text of this many bytes counts as half short.
SHORT_BYTES = 64
#: Added to both sizes of the ratio, which so stays finite.
FEW_BYTES = 8
FEATURES = 3


@dataclass
class QualityModel:
    """Two dictionaries (``DICTIONARY_BYTES`` at most each) and the weights of the features, the last the constant."""

    good: bytes
    bad: bytes
    weight: np.ndarray

    def __getstate__(self) -> dict:
        return {"good": self.good, "bad": self.bad, "weight": self.weight}

    def compressors(self) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor]:
        if not hasattr(self, "_made"):
            kind = zstandard.DICT_TYPE_AUTO
            made = []
            for d in (self.good, self.bad):
                held = zstandard.ZstdCompressionDict(d, dict_type=kind)
                held.precompute_compress(level=LEVEL)
                made.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=False, write_dict_id=False))
            self._made = tuple(made)
        return self._made

    def features(self, text: bytes) -> tuple[float, float, float]:
        """How much smaller the good dictionary makes the text than the bad one, per byte; the logarithm of the share of its
        bytes that are left; how short it is."""
        by_good, by_bad = (sum(len(c.compress(text[i : i + BLOCK_BYTES])) for i in range(0, len(text), BLOCK_BYTES)) for c in self.compressors())
        n = len(text)
        return (by_bad - by_good) / max(n, 1), math.log((by_good + FEW_BYTES) / (n + FEW_BYTES)), SHORT_BYTES / (SHORT_BYTES + n)

    def __call__(self, texts: pa.Array) -> np.ndarray:
        x = np.array([self.features(memoryview(t.as_buffer()) if t.is_valid else b"") for t in texts]).reshape(-1, FEATURES)
        return sigmoid(x @ self.weight[:-1] + self.weight[-1])


def _dictionary(texts: list[bytes]) -> bytes:
    samples = [t[i : i + BLOCK_BYTES] for t in texts for i in range(0, len(t), BLOCK_BYTES)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=64, d=8).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on: the text itself serves
        return b"\n".join(samples)[:DICTIONARY_BYTES] or b"\n" * 8


def fit_quality(texts: list[str], labels: np.ndarray) -> QualityModel:
    raw = [t.encode() for t in texts]
    build, check = halves(len(raw))
    model = QualityModel(*(_dictionary([raw[i] for i in build if labels[i] == k]) for k in (1, 0)), np.zeros(FEATURES + 1))
    model.weight = fit_logistic(np.array([model.features(raw[i]) for i in check]).reshape(-1, FEATURES), labels[check])
    return model


def train_quality(docs: DataFrame, labels: DataFrame) -> QualityModel:
    """Fit on labelled rows whose crc32 modulo 3 is not 1."""
    return fit_quality(*labelled_sample(docs, labels, "quality", remainder(F.col("_id"), 3) != 1, PER_CLASS, MAX_CHARS))


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs``."""
    held_out = F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False))
    return scores(docs, train_quality(docs, labels)).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def filter_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier takes for good."""
    return keep_rows(docs, train_quality(docs, labels), 1)
