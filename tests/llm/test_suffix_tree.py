import math
import zlib
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from vecprep.llm import suffix_tree as S

END = object()


def tokens(text):
    return [*(text or "").encode().lower().split(), END]


def held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 1


def brute_force(rows):
    """The model, sequence by sequence."""
    train = [tokens(t) for d, t in rows if not held_out(d)]
    n = sum(map(len, train))
    after = defaultdict(Counter)
    for seq in train:
        for i, s in enumerate(seq):
            for d in range(min(i, S.DEPTH) + 1):
                after[tuple(seq[i - d : i])][s] += 1
    root = after[()]
    v = len(root)
    total = {u: sum(c.values()) for u, c in after.items()}
    least = min(S.P_MIN * n, S.LEAST)

    def p_root(s):
        return (root[s] + 0.5) / (n + 0.5 * (v + 1))

    def smooth(u, s, parent):
        return (after[u][s] + len(after[u]) * parent) / (total[u] + len(after[u]))

    def chain(u, s):
        """By the states among the suffixes of u, from the shortest."""
        p = p_root(s)
        for d in range(1, len(u) + 1):
            if u[-d:] in states:
                p = smooth(u[-d:], s, p)
        return p

    states = set()
    for u in sorted((u for u in after if u), key=len):
        gain = 0.0
        for s, c in after[u].items():
            parent = chain(u[1:], s)
            left = len(after[u]) - (c == 1)
            rest = total[u] - 1 + left
            gain += c * math.log(((c - 1 + left * parent) / rest if rest else parent) / parent)
        if gain > S.GAIN * total[u] and total[u] >= least:
            states.add(u)
    out = {}
    for k, (_, t) in enumerate(rows):
        seq = tokens(t)
        score = base = 0.0
        for i, s in enumerate(seq):
            base += math.log10(p_root(s))
            score += math.log10(chain(tuple(seq[max(i - S.DEPTH, 0) : i]), s))
        out[k] = (len(seq), sum(root[s] > 0 for s in seq), n, base, score)
    return out


def test_equals_brute_force(documents, prose):
    rows = [(i, prose(20 + i % 40, i % 37)) for i in range(120)] + [(200, None), (201, ""), (202, "  \n"), (203, "THE the The"), (204, "neverseen " * 30)]
    found = {r["doc_id"]: r for r in S.score_texts(documents(rows)).collect()}
    expected = brute_force(rows)
    assert len(found) == len(rows)
    better = 0
    for k, (d, _) in enumerate(rows):
        r, (size, known, n, base, score) = found[d], expected[k]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (size, known, n, held_out(d))
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and math.isclose(r["score"], score, rel_tol=1e-9)
        better += score > base
    assert better > 100


def test_contexts_are_bounded_by_frequency(documents, monkeypatch):
    monkeypatch.setattr(S, "P_MIN", 0.2)
    rows = [(i, "a b a b c") for i in range(30)]
    found = {r["doc_id"]: r["score"] for r in S.score_texts(documents(rows)).collect()}
    expected = brute_force(rows)
    assert all(math.isclose(found[d], expected[d][4], rel_tol=1e-9) for d in range(30))


def test_repeated_rows_null_ids_and_other_columns(documents):
    df = documents([(1, "x y z"), (1, "x y z"), (None, "x y"), (7, "x")]).withColumnsRenamed({"lang": "score", "source": "bucket"})
    rows = S.score_texts(df).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == ["1", "1", "7", "None"]
    a, b = (r for r in rows if r["doc_id"] == 1)
    assert a == b and not next(r for r in rows if r["doc_id"] is None)["held_out"]


def test_empty_table(documents):
    assert S.score_texts(documents([])).collect() == []


def test_only_held_out_rows(documents):
    d = next(i for i in range(100) if held_out(i))
    r = S.score_texts(documents([(d, "a b")])).collect()[0]
    assert (r["train_tokens"], r["n_known"], r["n_tokens"], r["base_score"], r["score"]) == (0, 0, 3, 0.0, 0.0)


def test_a_very_long_text(documents, prose):
    rows = [(0, prose(60_000, 1)), (1, prose(50, 2))]
    r = {x["doc_id"]: x for x in S.score_texts(documents(rows)).collect()}
    assert r[0]["n_tokens"] == 60_001 and r[0]["score"] > r[0]["base_score"]


@pytest.mark.parametrize("size", [1, 3])
def test_blocks_dont_change_the_result(documents, prose, monkeypatch, size):
    rows = [(i, prose(30, i)) for i in range(20)]
    one = {r["doc_id"]: r for r in S.score_texts(documents(rows).coalesce(1)).collect()}
    many = {r["doc_id"]: r for r in S.score_texts(documents(rows).repartition(size + 4)).collect()}
    assert all(math.isclose(one[d]["base_score"], many[d]["base_score"], rel_tol=1e-9) for d, _ in rows)


def test_occurrences_a_state_needs_dont_rise_with_the_corpus(documents, prose, monkeypatch):
    rows = [(i, prose(40, i % 37)) for i in range(120)]
    monkeypatch.setattr(S, "P_MIN", 0.02)
    monkeypatch.setattr(S, "LEAST", 10, raising=False)
    found = {r["doc_id"]: r["score"] for r in S.score_texts(documents(rows)).collect()}
    expected = brute_force(rows)
    monkeypatch.setattr(S, "LEAST", 10**9)
    few = brute_force(rows)
    assert all(math.isclose(found[d], expected[d][4], rel_tol=1e-9) for d, _ in rows)
    assert sum(expected[d][4] - few[d][4] for d, _ in rows) > 10  # the states that a share of all positions would cut


@pytest.mark.parametrize("buckets", [1, 7, 60])
def test_any_number_of_buckets_scores_alike(documents, prose, monkeypatch, buckets):
    """With many buckets nearly all contexts are split, frequent symbols too; with one none is."""
    rows = [(i, prose(20 + i % 40, i % 29)) for i in range(100)] + [(200, None), (201, "a")]
    monkeypatch.setattr(S, "partitions_for", lambda *_: buckets)
    monkeypatch.setattr(S, "size_in_bytes", lambda _: buckets * S.BUCKET_BYTES)
    monkeypatch.setattr(S, "PAIRS", 200)
    monkeypatch.setattr(S, "P_MIN", 1e-3)
    found, expected = {r["doc_id"]: r for r in S.score_texts(documents(rows).repartition(3)).collect()}, brute_force(rows)
    for k, (d, _) in enumerate(rows):
        size, known, n, base, score = expected[k]
        assert (found[d]["n_tokens"], found[d]["n_known"], found[d]["train_tokens"]) == (size, known, n)
        assert math.isclose(found[d]["base_score"], base, rel_tol=1e-9) and math.isclose(found[d]["score"], score, rel_tol=1e-9)


@pytest.mark.parametrize("depth", [1, 2, 4])
def test_depth_is_an_argument(documents, prose, monkeypatch, depth):
    rows = [(i, prose(40, i % 11)) for i in range(60)]
    found = {r["doc_id"]: r["score"] for r in S.score_texts(documents(rows), depth=depth).collect()}
    monkeypatch.setattr(S, "DEPTH", depth)
    expected = brute_force(rows)
    assert all(math.isclose(found[d], expected[d][4], rel_tol=1e-9) for d, _ in rows)


@pytest.mark.parametrize("vocabulary", [0, 5, 60])
def test_words_beyond_the_vocabulary_count_alike(documents, prose, monkeypatch, vocabulary):
    rows = [(i, prose(20 + i % 40, i % 29)) for i in range(100)] + [(200, None), (201, "never seen before"), (202, "the")]
    monkeypatch.setattr(S, "VOCABULARY", vocabulary)
    monkeypatch.setattr(S, "P_MIN", 1e-3)
    found, expected = {r["doc_id"]: r for r in S.score_texts(documents(rows).repartition(3)).collect()}, brute_force(rows)
    for k, (d, _) in enumerate(rows):
        size, known, n, base, score = expected[k]
        assert (found[d]["n_tokens"], found[d]["n_known"], found[d]["train_tokens"]) == (size, known, n)
        assert math.isclose(found[d]["base_score"], base, rel_tol=1e-9) and math.isclose(found[d]["score"], score, rel_tol=1e-9)


def test_what_levels_exchange_is_packed_tightly(prose):
    """A block and one bucket, in this process: bytes for each pair of a context and a symbol, asked and answered."""
    text = prose(120_000, 1, 3000).split()
    texts = [" ".join(text[i : i + 100]) for i in range(0, len(text), 100)]
    ids = np.arange(len(texts))
    batch = pa.record_batch([pa.array(ids), pa.array(ids % 5 == 1), pa.array(texts)], ["doc_id", "held_out", "text"])
    plain = S.Block.of(batch)
    count = np.bincount(plain.symbol, ~plain.held[plain.document], len(plain.words)).astype(np.int64)
    order = np.lexsort((plain.words, -count))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    block = S.Block.of(batch, S.Vocabulary(plain.words, place, count[order]))
    model = S.Model(3, 1, int(count.sum()), int(np.count_nonzero(count)), 8, S.GAIN)
    rows, sizes = [], {}
    for level in (1, 2, 3):
        replay = S.Replay(S.Block.unpack(block.pack()), model, S._answers(rows))
        replay.through(level - 1)
        asked = [(b, 0, d) for b, d in replay.asks()]
        pairs = len(replay.ask().at)
        found = S._answer(SimpleNamespace(value=model), level)(pa.table([pa.array(c) for c in zip(*asked, strict=True)], ["bucket", "block", "data"]))
        rows += [tuple(r.values()) for r in found.to_pylist()]
        sizes[level] = (pairs, sum(len(d) for *_, d in asked) / pairs, sum(len(d) for d in found["data"].to_pylist()) / pairs)
    assert all(pairs > 2000 for pairs, *_ in sizes.values())
    assert all(sizes[level][1] < most for level, most in ((1, 1.15), (2, 1.4), (3, 1.9)))  # 1.31, 1.84 and 2.80 in the order of pairs
    assert all(answered < 0.1 for *_, answered in sizes.values())  # few contexts of random words are states; 0.3 if all counts are told
