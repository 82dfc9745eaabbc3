import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vecprep.llm import fitting, quality, toxicity


@pytest.fixture
def corpus(documents, spark, prose):
    """Good prose and junk, some of it toxic, half labelled."""
    rows, labels = [], []
    for i in range(400):
        rng = random.Random(i)
        text = prose(60 + rng.randrange(100), i)
        good, toxic = i % 5 != 0, i % 7 == 0
        if not good:
            text = [text.upper().replace(" ", "!! "), "spam " * 80, text.replace(" ", " | ")][i % 3]
        if toxic:
            w = text.split(" ")
            for _ in range(6):
                w.insert(rng.randrange(len(w)), rng.choice(["scumbag", "moron", "idiot!", "Loser"]))
            text = " ".join(w)
        rows.append((i, text))
        if i % 2 == 0 or i % 3 == 0:
            labels.append((i, int(good), int(toxic)))
    return documents(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {i: (int(i % 5 != 0), int(i % 7 == 0)) for i in range(400)}


@pytest.mark.parametrize(("module", "which", "modulus", "left", "least"), [(quality, 0, 3, 1, 0.9), (toxicity, 1, 5, 0, 0.95)])
def test_held_out_accuracy(corpus, module, which, modulus, left, least):
    docs, labels, truth = corpus
    run = quality.score_quality if which == 0 else toxicity.score_toxicity
    rows = run(docs, labels).collect()
    assert len(rows) == 400
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % modulus == left)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["predicted"] == truth[r["doc_id"]][which] for r in held) / len(held) >= least


def test_held_out_labels_are_never_learnt(corpus):
    docs, labels, _ = corpus
    wrong = fitting.remainder(F.col("doc_id"), 3) == 1
    flipped = labels.withColumn("quality", F.when(wrong, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (sorted(map(tuple, quality.score_quality(docs, x).collect())) for x in (labels, flipped))
    assert a == b


def test_filters_keep_rows_as_they_are(corpus):
    docs, labels, truth = corpus
    docs = docs.withColumnsRenamed({"lang": "score", "source": "predicted"})
    kept = quality.filter_quality(docs, labels)
    assert kept.schema == docs.schema and {tuple(r) for r in kept.collect()} <= {tuple(r) for r in docs.collect()}
    gone = {r["doc_id"] for r in docs.collect()} - {r["doc_id"] for r in toxicity.filter_toxicity(docs, labels).collect()}
    assert len(gone & {i for i in truth if truth[i][1]}) >= 0.9 * sum(t for _, t in truth.values())
    assert len(gone - {i for i in truth if truth[i][1]}) <= 4


@pytest.mark.parametrize("run", [quality.score_quality, toxicity.score_toxicity])
def test_corners(documents, spark, corpus, run):
    _, labels, _ = corpus
    no_labels = labels.limit(0)
    assert run(documents([]), labels).collect() == []
    rows = [(1, None), (2, ""), (None, "x"), (3, "word " * 60_000), (3, "word " * 60_000), (4, "\x00é\U0001f600")]
    found = run(documents(rows), no_labels).collect()
    assert len(found) == 6 and all(0 < r["score"] < 1 for r in found) and len({r["score"] for r in found}) == 1
    assert not next(r for r in found if r["doc_id"] is None)["held_out"]
    one_class = labels.withColumns({"quality": F.lit(1), "toxic": F.lit(1)})
    assert all(0 <= r["score"] <= 1 for r in run(documents(rows), one_class).collect())
    odd = spark.createDataFrame([(1, None, None), (2, 5, 5), (None, 1, 1)], labels.schema)
    assert run(documents(rows), odd).count() == 6


def test_sample_is_bounded(corpus):
    docs, labels, _ = corpus
    texts, y = fitting.labelled_sample(docs, labels, "toxic", F.lit(True), 10, 10**6)
    assert len(texts) == 20 and y.sum() == 10
    assert max(map(len, fitting.labelled_sample(docs, labels, "toxic", F.lit(True), 100, 500)[0])) <= 500


def test_logistic():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 1))
    y = (rng.random(4000) < fitting.sigmoid(2 * x[:, 0] - 1)).astype(int)
    w = fitting.fit_logistic(x, y)
    assert abs(w[0] - 2) < 0.2 and abs(w[1] + 1) < 0.2
    assert fitting.sigmoid(fitting.fit_logistic(np.zeros((0, 1)), np.zeros(0, int))[-1]) == 0.5


def brute_segments(scores):
    """Maximal segments by their definition: positive, no better proper sub-segment, inside no larger such one."""
    n, good = len(scores), []
    total = np.concatenate([[0.0], np.cumsum(scores)])
    for i in range(n):
        for j in range(i, n):
            if total[j + 1] - total[i] > 0 and all(total[i] < total[k] < total[j + 1] for k in range(i + 1, j + 1)):
                good.append((i, j))
    return sorted(s for s in good if not any(t != s and t[0] <= s[0] and s[1] <= t[1] for t in good))


def test_maximal_segments():
    rng = random.Random(4)
    for _ in range(300):
        n = rng.randrange(1, 25)
        hits = sorted(rng.sample(range(n), rng.randrange(0, n + 1)))
        value, drift = [rng.choice([-2.5, 0.7, 1.3, 3.1]) + rng.random() / 100 for _ in hits], -0.41
        scores = np.full(n, drift)
        scores[hits] = value
        found = toxicity.maximal_segments(np.array(hits, int), np.array(value, float), drift)
        assert sorted((a, b) for a, b, _ in found) == brute_segments(scores)
        assert all(abs(s - scores[a : b + 1].sum()) < 1e-9 for a, b, s in found)


def test_the_scan_is_linear():
    """Runs that start lower than all before them: 30 times as many take far less than 30 * 30 times as long."""
    import time

    took = []
    for n in (10_000, 300_000):
        began = time.perf_counter()
        found = toxicity.maximal_segments(np.arange(n) * 3, np.full(n, 0.4), -0.5)
        took.append(time.perf_counter() - began)
        assert len(found) == n
    assert took[1] < 150 * took[0] + 0.5


def test_toxicity_scores_equal_a_plain_version(corpus):
    from vecprep.llm.text import mix, segment_hashes

    docs, labels, _ = corpus
    model = toxicity.train_toxicity(docs, labels)
    known = dict(zip(model.keys.tolist(), model.score.tolist(), strict=True))
    strip = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())

    def hashed(word):
        raw = np.frombuffer(word, np.uint8)
        return segment_hashes(raw, np.array([0]), np.array([len(raw)]))

    def value(token):
        core = token.rstrip(strip.encode())
        core = core if core else token[:1]  # what is punctuation throughout keeps one character
        core = core.lstrip(strip.encode()) or core[-1:]
        for key in (hashed(core), mix(hashed(core[: toxicity.PREFIX]) ^ np.uint64(0x5DEECE66D))):
            if int(key[0]) in known:
                return known[int(key[0])]
        return model.drift

    texts = {r["doc_id"]: r["text"] for r in docs.limit(40).collect()} | {1000: "", 1001: None, 1002: "!!! moron ... 'idiot'"}
    for i, t in texts.items():
        scores = np.array([value(w) for w in (t or "").encode().split()])
        z = [model.scale * scores[a : b + 1].sum() - model.log_k - np.log(max(len(scores), 1)) for a, b in brute_segments(scores)] if len(scores) <= 60 else None
        if z is None:  # the definition in cubic time suits short texts; longer ones by a scan without links
            z = [model.scale * s - model.log_k - np.log(len(scores)) for s in plain_segments(scores)]
        x = np.log1p(sum(max(0.0, v - toxicity.SIGNIFICANT) for v in z))
        want = 1 / (1 + np.exp(-(x * model.weight[0] + model.weight[1])))
        assert abs(model(pa.array([t], pa.string()))[0] - want) < 1e-9, i


def plain_segments(scores):
    """Sums of the maximal segments by recursion: the best segment, then what lies left and right of it."""
    out, todo = [], [(0, len(scores))]
    while todo:
        a, b = todo.pop()
        best, low, low_at, total, found = 0.0, 0.0, a, 0.0, None
        for i in range(a, b):
            total += scores[i]
            if total - low > best + 1e-12:
                best, found = total - low, (low_at, i + 1)
            if total < low:
                low, low_at = total, i + 1
        if found:
            out.append(best)
            todo += [(a, found[0]), (found[1], b)]
    return out


def test_quality_scores_equal_a_plain_version(corpus):
    import math

    import zstandard

    docs, labels, _ = corpus
    model = quality.train_quality(docs, labels)

    def size(raw, dictionary):
        d = zstandard.ZstdCompressionDict(dictionary)
        d.precompute_compress(level=quality.LEVEL)
        c = zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=d, write_content_size=False, write_dict_id=False)
        return sum(len(c.compress(raw[i : i + quality.BLOCK_BYTES])) for i in range(0, len(raw), quality.BLOCK_BYTES))

    texts = [r["text"] for r in docs.limit(30).collect()] + ["", None, "é" * 5000]
    for t in texts:
        raw = (t or "").encode()
        good, bad, n = size(raw, model.good), size(raw, model.bad), len(raw)
        features = ((bad - good) / max(n, 1), math.log((good + quality.FEW_BYTES) / (n + quality.FEW_BYTES)), quality.SHORT_BYTES / (quality.SHORT_BYTES + n), 1.0)
        want = 1 / (1 + math.exp(-sum(f * w for f, w in zip(features, model.weight, strict=True))))
        assert abs(model(pa.array([t], pa.string()))[0] - want) < 1e-12


@pytest.mark.parametrize("run", [quality.score_quality, toxicity.score_toxicity])
def test_other_columns_are_ignored(corpus, run):
    docs, labels, _ = corpus
    odd = docs.withColumnsRenamed({"lang": "score", "source": "_id", "n_chars": "held_out"}).withColumn("_label", F.lit(3))
    assert sorted(map(tuple, run(odd, labels.withColumn("text", F.lit("x"))).collect())) == sorted(map(tuple, run(docs, labels).collect()))


def test_scale_solves_its_equation():
    score, share = np.array([4.0, -1.0]), np.array([0.05, 0.95])
    x = toxicity._scale(score, share)
    assert abs(share @ np.exp(x * score) - 1) < 1e-9 and x > 0


def test_passages(corpus, documents):
    docs, labels, _ = corpus
    model = toxicity.train_toxicity(docs, labels)
    text = "plain words here " * 20 + "you moron idiot loser scumbag moron" + " more plain words" * 20
    rows = toxicity.toxic_passages(documents([(1, text), (2, "nothing here"), (3, None)]), model).collect()
    assert {r["doc_id"] for r in rows} == {1} and "moron idiot loser" in rows[0]["passage"]
    assert text.encode()[rows[0]["first_byte"] : rows[0]["end_byte"]].decode() == rows[0]["passage"] and rows[0]["e_value"] <= 1


def test_model_travels():
    import pickle

    m = quality.fit_quality(["good text here and there"] * 20 + ["JUNK!! JUNK!!"] * 20, np.array([1] * 20 + [0] * 20))
    texts = pa.array(["good text", "JUNK!!", None])
    assert (pickle.loads(pickle.dumps(m))(texts) == m(texts)).all()
