import math
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from vecprep.llm import max_score, projection_forest

SCHEMA = "vec_id long, embedding array<float>, label int"


@pytest.fixture
def embeddings(spark):
    return lambda rows: spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0) for i, v in rows], SCHEMA)


def brute_components(rows):
    good = {i: np.array(v, np.float32).astype(float) for i, v in rows if v is not None and None not in v and np.isfinite(v).all() and np.any(v)}
    links, parent = defaultdict(int), {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(good)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = good[a], good[b]
            if len(x) == len(y) and x @ y / math.sqrt((x @ x) * (y @ y)) >= 0.9:
                links[a] += 1
                links[b] += 1
                u, v = sorted((find(a), find(b)))
                parent[v] = u
    return {i: (links[i], find(i), find(i) == i) for i, _ in rows}


def clustered(n, families, dim, seed, noise=0.05):
    rng = np.random.default_rng(seed)
    centre = rng.standard_normal((families, dim))
    return [(i, (centre[i % families] + noise * rng.standard_normal(dim) * (i % 3)).round(4).tolist()) for i in range(n)]


def as_dict(df):
    return {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in df.collect()}


def test_forest_equals_brute_force(embeddings):
    rows = clustered(300, 60, 16, 1) + [(900, None), (901, [0.0] * 16), (902, [math.nan] * 16), (903, [1.0] * 15 + [math.inf]), (904, [None] + [1.0] * 15), (905, [1.0, 0.0]), (906, [2.0, 0.0]), (907, [])]
    assert as_dict(projection_forest.vector_components(embeddings(rows))) == brute_components(rows)


def test_forest_splits_with_little_loss(embeddings, monkeypatch):
    monkeypatch.setattr(projection_forest, "LEAF", 40)
    rows = clustered(1500, 500, 32, 2, 0.1)
    found, want = as_dict(projection_forest.vector_components(embeddings(rows))), brute_components(rows)
    assert sum(r[0] for r in found.values()) >= 0.98 * sum(r[0] for r in want.values())
    assert all(found[i][0] <= want[i][0] and found[i][1] >= want[i][1] for i in want)


def test_dense_cluster_and_equal_vectors(embeddings, monkeypatch):
    monkeypatch.setattr(projection_forest, "LEAF", 20)
    rng = np.random.default_rng(3)
    rows = [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(100)] + [(100 + i, (np.array([1, 2, 3, 4]) + 0.01 * rng.standard_normal(4)).tolist()) for i in range(150)]
    found = as_dict(projection_forest.vector_components(embeddings(rows)))
    assert all(r[1] == 0 for r in found.values()) and all(found[i][0] == found[0][0] for i in range(100))
    assert sum(r[0] for r in found.values()) >= 0.99 * 250 * 249


def test_chunks_of_a_large_leaf_meet(embeddings, monkeypatch):
    monkeypatch.setattr(projection_forest, "TASK_ROWS", 30)
    rows = clustered(200, 40, 16, 8)
    assert as_dict(projection_forest.vector_components(embeddings(rows))) == brute_components(rows)


def test_forest_corners(embeddings):
    assert projection_forest.vector_components(embeddings([])).collect() == []
    rows = projection_forest.vector_components(embeddings([(None, [1.0, 0.0]), (4, [1.0, 0.0]), (4, [1.0, 0.0])])).collect()
    assert sorted(map(str, rows)) == sorted(map(str, projection_forest.vector_components(embeddings([(4, [1.0, 0.0]), (None, [1.0, 0.0]), (4, [1.0, 0.0])])).collect()))
    by = [(r["vec_id"], r["n_links"], r["kept"]) for r in rows]
    assert by.count((4, 1, True)) == 2 and (None, 0, False) in by


def brute_top(rows, step, k):
    good = {i: [math.floor(256 * float(np.float32(x))) for x in v] for i, v in rows if v is not None and None not in v and np.isfinite(v).all() and len(v)}
    out = {}
    for q in good:
        if q % step == 0:
            s = sorted((-sum(a * b for a, b in zip(good[q], v, strict=True)), i) for i, v in good.items() if i != q and len(v) == len(good[q]))
            for r, (score, i) in enumerate(s[:k], 1):
                out[q, r] = (i, -score)
    return out


@pytest.mark.parametrize("shard", [7, 10_000])
def test_max_score_equals_brute_force(embeddings, monkeypatch, shard):
    monkeypatch.setattr(max_score, "SHARD", shard)
    monkeypatch.setattr(max_score, "QUERIES", 3)
    rng = np.random.default_rng(5)
    rows = [(i, rng.standard_normal(24).round(2).tolist()) for i in range(200)] + [(300 + i, [0.5] * 24) for i in range(8)]
    rows += [(1000, None), (1001, [None] * 24), (1002, [math.nan] * 24), (1050, [1.0, -1.0]), (1051, [1.0, 1.0]), (1100, [])]
    found = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in max_score.top_k(embeddings(rows).repartition(4), "_id % 50 = 0").collect()}
    assert found == brute_top(rows, 50, 5) and found[1050, 1] == (1051, 0)


def test_max_score_prunes_exactly():
    rng = np.random.default_rng(6)
    v = np.floor(256 * rng.standard_normal((500, 40)) * np.exp(-np.arange(40) / 6))
    v[100:110] = v[90]
    for q in np.floor(256 * rng.standard_normal((20, 40))):
        s = v @ q
        want = np.lexsort((np.arange(500), -s))[:5]
        shard = max_score.Shard(np.arange(500), np.ascontiguousarray(v.T))
        for beat in (-np.inf, float(np.median(s)), float(s[want[4]])):  # any score that k vectors reach
            ids, scores = shard.best(-1, q, 5, beat)
            assert ids.tolist() == want.tolist() and scores.tolist() == s[want].tolist()
        assert shard.best(-1, q, 5, float(s[want[0]]) + 1)[0].tolist() == []


def test_max_score_leaves_non_essential_places_unread():
    """Places whose bounds can't reach the score to beat are probed for the vectors that still compete, no others."""
    rng = np.random.default_rng(8)
    v = np.floor(256 * rng.standard_normal((2000, 40)) * np.exp(-np.arange(40) / 4))

    class Counted(np.ndarray):
        read = 0

        def __getitem__(self, key):
            out = np.asarray(self)[key]
            Counted.read += out.size
            return out

    q = np.floor(256 * rng.standard_normal(40))
    shard = max_score.Shard(np.arange(2000), np.ascontiguousarray(v.T))
    shard.postings = shard.postings.view(Counted)
    best = float(np.sort(v @ q)[-5])
    assert shard.best(-1, q, 5, best)[1][-1] == best and Counted.read < 0.6 * v.size


def test_max_score_ignores_other_columns(spark):
    rows = [(i, [float(i % 7), 1.0], 1.0, 2, 3, 4) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, vector double, _id int, score int, rank int")
    plain = df.select("vec_id", "embedding")
    assert sorted(map(tuple, max_score.top_k(df, "_id % 50 = 0").collect())) == sorted(map(tuple, max_score.top_k(plain, "_id % 50 = 0").collect()))


def test_forest_ignores_other_columns(spark):
    rows = [(i, [float(i % 5 + 1), 1.0], 1.0, 2, 3, 4) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, vector double, key int, rep int, n_links int")
    found = projection_forest.vector_components(df)
    assert found.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert as_dict(found) == as_dict(projection_forest.vector_components(df.select("vec_id", "embedding")))


def test_large_values_stay_exact(embeddings):
    rows = [(0, [3e6, 1.0]), (1, [2.9e6, 7.0]), (2, [2.9e6, 6.0])]
    found = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in max_score.top_k(embeddings(rows), "_id = 0").collect()}
    assert found == {k: v for k, v in brute_top(rows, 50, 5).items() if k[0] == 0}


def test_max_score_sql_and_corners(embeddings):
    rng = np.random.default_rng(7)
    df = embeddings([(i, rng.standard_normal(8).tolist()) for i in range(120)] + [(200, None), (None, [1.0] * 8)])
    con = duckdb.connect()
    con.register("embeddings", df.toArrow())
    columns = "query_id, rank, vec_id, score"
    theirs = sorted(con.sql(f"SELECT {columns} FROM ({max_score.ORACLE_SQL})").fetchall())
    assert sorted(map(tuple, max_score.top_k(df, "_id % 50 = 0").collect())) == theirs
    assert max_score.top_k(embeddings([]), "_id % 50 = 0").collect() == []
    assert max_score.top_k(embeddings([(50, [1.0])]), "_id % 50 = 0").collect() == []
    assert max_score.top_k(embeddings([(50, [1.0]), (50, [1.0]), (51, [1.0])]), "_id % 50 = 0").count() == 1


def test_lengths_without_trees_have_single_leaves():
    import pyarrow as pa

    batch = pa.record_batch([pa.array([1, 2, 3]), pa.array([1, 1, 1]), pa.array([[1.0, 2.0], [1.0, 2.0, 3.0], [2.0, 4.0]])], ["rep", "size", "vector"])
    tree = projection_forest.Tree.fitted(np.zeros((0, 3)), 0, 1, 10)
    found = [(dim, part["rep"].to_pylist(), row.tolist(), len(set(code.tolist()))) for dim, part, row, code in projection_forest._leaves(iter([batch]), {3: [tree]})]
    assert found == [(2, [1, 3], [0, 1], 1), (3, [2], [0], 1)]


def test_a_small_sample_splits_a_large_table(embeddings, monkeypatch):
    """Levels below the sample's leaves divide the table too, and every link is counted once over many leaves and trees."""
    monkeypatch.setattr(projection_forest, "LEAF", 60)
    monkeypatch.setattr(projection_forest, "SAMPLE", 150)
    rows = clustered(3000, 1000, 32, 4, 0.1)
    found, want = as_dict(projection_forest.vector_components(embeddings(rows))), brute_components(rows)
    assert sum(r[0] for r in found.values()) >= 0.98 * sum(r[0] for r in want.values())
    assert all(found[i][0] <= want[i][0] and found[i][1] >= want[i][1] for i in want)


def test_deep_trees_from_few_points():
    rng = np.random.default_rng(9)
    x = projection_forest.unit(rng.standard_normal((20_000, 16)))
    tree = projection_forest.Tree.fitted(x[:400], 20_000, 5, 100)
    sizes = [len(rows) for _, rows in tree.leaves(x)]
    assert tree.further and max(sizes) < 1000 and sum(sizes) < 4 * len(x)
    assert set(np.concatenate([rows for _, rows in tree.leaves(x)]).tolist()) == set(range(len(x)))
    assert 0.07 < projection_forest.loss(0.1) < 0.085 and 0.05 < projection_forest.loss(0.15) < 0.06


@pytest.mark.parametrize("noise", [0.05, 0.2])
def test_dense_clusters_in_chunks_and_leaves(embeddings, monkeypatch, noise):
    monkeypatch.setattr(projection_forest, "LEAF", 30)
    monkeypatch.setattr(projection_forest, "TASK_ROWS", 25)
    rng = np.random.default_rng(10)
    centre = rng.standard_normal((4, 12))
    rows = [(i, (centre[i % 4] + noise * rng.standard_normal(12)).round(4).tolist()) for i in range(400)]
    found, want = as_dict(projection_forest.vector_components(embeddings(rows))), brute_components(rows)
    assert sum(r[0] for r in found.values()) >= 0.98 * sum(r[0] for r in want.values()) and all(found[i][0] <= want[i][0] for i in want)
    assert sum(found[i][1:] == want[i][1:] for i in want) >= 0.98 * len(rows)

