import random

import numpy as np
import pyarrow as pa
import pytest

from vecprep.llm import minhash as N
from vecprep.llm.components import connected_components


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_force(rows):
    sets = {d: shingles(t) for d, t in rows}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 85 * len(x | y):
                u, v = sorted((find(a), find(b)))
                parent[v] = u
    return {d: (len(sets[d]), find(d), find(d) == d) for d in ids}


def words(n, seed):
    return [f"w{random.Random(seed * 1000 + i).randrange(10**6)}" for i in range(n)]


def edited(base, seed, edits):
    rng, out = random.Random(seed), list(base)
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"e{rng.randrange(10**6)}"
    return out


def test_equals_brute_force(documents):
    rows, k = [], 0
    for family in range(12):
        base = words(60 + 20 * family, family)
        for copy in range(8):
            rows.append((k, " ".join(edited(base, k, copy % 4))))
            k += 1
    rows += [(1000, None), (1001, ""), (1002, " \t"), (1003, "One two"), (1004, "one  TWO"), (1005, "two one"), (1006, "a a a a a a a"), (1007, "a a a a a")]
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in N.near_duplicates(documents(rows)).collect()}
    assert found == brute_force(rows)
    assert found[1004] == (1, 1003, False) and found[1006] == (1, 1006, True) and found[1007] == (1, 1006, False)


def test_a_large_group_of_copies_and_near_copies(documents):
    base = words(120, 5)
    rows = [(i, " ".join(base)) for i in range(300)] + [(300 + i, " ".join(edited(base, i, 1 + i % 2))) for i in range(200)]
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in N.near_duplicates(documents(rows)).collect()}
    assert found == brute_force(rows)


def test_chain_of_links_is_one_component(documents):
    """Neighbours of a chain are linked, its ends far apart: links that only the second round confirms count too."""
    text, rows = words(200, 9), []
    for i in range(30):
        rows.append((i, " ".join(text)))
        at = i * 6
        text = text[:at] + [f"c{i}"] + text[at + 1 :]
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in N.near_duplicates(documents(rows)).collect()}
    assert found == brute_force(rows) and found[29][1] == 0


def test_chunks_of_a_large_bucket_meet(documents, monkeypatch):
    monkeypatch.setattr(N, "BUCKET_ROWS", 3)
    text, rows = words(150, 9), []
    for i in range(24):
        rows.append((i, " ".join(text)))
        text = text[: i * 6] + [f"c{i}"] + text[i * 6 + 1 :]
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in N.near_duplicates(documents(rows)).collect()}
    assert found == brute_force(rows)


def test_estimate_is_close_to_the_similarity():
    base, errors = words(400, 1), []
    for edits in range(0, 40, 4):
        x, y = " ".join(base), " ".join(edited(base, edits, edits))
        sets, at = N.shingle_sets(pa.array([x, y]))
        _, packed = N.signatures(sets, at)
        a, b = packed.view(np.uint64)
        true = len(shingles(x) & shingles(y)) / len(shingles(x) | shingles(y))
        equal = 0.25 + 0.75 * true
        errors.append(abs(float(N.similarity(a, b)) - true) / max((equal * (1 - equal) / N.PERMUTATIONS) ** 0.5 / 0.75, 1e-9))
    assert max(errors) < 5 and errors[0] == 0  # standard errors


def test_second_round_pairs_cross_components_only():
    sig, bands = np.zeros((5, N.SIGNATURE_BYTES // 8), np.uint64), np.arange(5 * N.BANDS).reshape(5, -1)
    bands[:4, 3] = 7
    bands[:4, 9] = 8
    for key, first in ((7, True), (8, False)):  # the first band that two documents share tells of them
        columns = [pa.array([1, 1, 1, 1, 2]), pa.array([10, 11, 12, 13, 14]), pa.array([s.tobytes() for s in sig], pa.binary()), pa.array([10, 10, 12, 13, 14]), pa.array([100] * 5), pa.array([100, 95, 92, 91, 100]), pa.array([key] * 5), pa.array(bands.tolist()), pa.array([bytes(N.FINE * N.BITS // 8)] * 5, pa.binary())]
        batch = pa.record_batch(columns, ["meeting", "rep", "signature", "component", "size", "shared", "key", "bands", "fine"])
        pairs = [tuple(p) for b in N._across(iter([batch.slice(0, 2), batch.slice(2)])) for p in zip(b["a"].to_pylist(), b["b"].to_pylist(), strict=True)]
        assert sorted(pairs) == ([(10, 12), (11, 12)] if first else [])  # 91 shared of 100 can't make 85 %


def test_second_signatures_estimate_closer():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 900, dtype=np.uint64)
    rows = [np.unique(np.concatenate([base[: 900 - 50 * k], rng.integers(0, 2**63, 50 * k, dtype=np.uint64)])) for k in range(6)]
    batch = pa.record_batch([pa.array(range(6)), pa.array([r.view(np.int64).tolist() for r in rows])], ["doc_id", "members"])
    fine = np.concatenate([N._words64(b["fine"], N.FINE * N.BITS // 8) for b in N._fine(iter([batch]))])
    for k in range(6):
        both = len(np.intersect1d(rows[0], rows[k]))
        true = both / (len(rows[0]) + len(rows[k]) - both)
        assert abs(N.similarity(fine[0], fine[k], N.FINE) - true) < 0.06
    assert N.least_estimate(80, N.FINE) > N.least_estimate(80) + 0.08


def test_estimates_with_centres():
    sig = np.zeros((3, N.SIGNATURE_BYTES), np.uint8)
    sig[2] = 255
    raw = [x.tobytes() for x in sig]
    batch = pa.record_batch([pa.array([1, 2]), pa.array([9, 9]), pa.array([raw[0], raw[0]], pa.binary()), pa.array([raw[1], raw[2]], pa.binary())], ["rep", "centre", "x", "y"])
    assert [r for b in N._estimated(iter([batch]), 0.5) for r in b.to_pylist()] == [{"rep": 1, "centre": 9, "estimate": 1.0}]


def test_null_ids_repeats_and_other_columns(documents):
    df = documents([(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (2, "a b c d e f")]).withColumnsRenamed({"lang": "component", "source": "key"})
    rows = sorted((str(r["doc_id"]), r["component_id"], r["kept"]) for r in N.near_duplicates(df).collect())
    assert rows == [("2", 2, True), ("3", 2, False), ("3", 2, False), ("None", None, False)]
    kept = N.drop_near_duplicates(df)
    assert kept.columns == df.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["2", "None"]


def test_empty_table(documents):
    assert N.near_duplicates(documents([])).collect() == [] and N.drop_near_duplicates(documents([])).collect() == []


def test_bloom(spark, documents):
    from vecprep.llm.bloom import bloom_of, without

    ids = spark.range(0, 3000, 3)
    bloom = bloom_of(ids)
    assert bloom.may_hold(np.arange(0, 3000, 3)).all() and bloom.may_hold(np.arange(1, 3000, 3)).mean() < 0.2
    df = documents([(i, "x") for i in range(30)] + [(None, "y")])
    assert sorted(str(r["doc_id"]) for r in without(df, "doc_id", ids).collect()) == sorted(["None", *(str(i) for i in range(30) if i % 3)])
    assert without(df, "doc_id", ids.limit(0)).count() == 31


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 90), (90, 95), (7, 7), (200, 201), (201, 200)]
    found = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**dict.fromkeys(range(41), 0), 100: 90, 90: 90, 95: 90, 200: 200, 201: 200}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_classes_with_a_common_id_are_one_component(documents):
    rows = [(3, "a b c d e f"), (5, "a b c d e f"), (5, "u v w x y z"), (7, "u v w x y z"), (8, "k l m n o p"), (9, "k l m n o p"), (9, "u v w x y z")]
    found = sorted((r["doc_id"], r["component_id"], r["kept"]) for r in N.near_duplicates(documents(rows)).collect())
    assert found == [(d, 3, d == 3) for d in (3, 5, 5, 7, 8, 9, 9)]
