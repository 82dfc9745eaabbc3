import math
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecprep.functions import names
from vecprep.functions import vector as V
from vecprep.operators import assemble, clean, dedup, knn, order, profile
from vecprep.streaming import clean_stream


def column(df, name="vec", key="ord"):
    return [list(r[name]) if isinstance(r[name], list) else r[name] for r in df.orderBy(key).collect()]


def test_normalize_leaves_zero_alone(vectors):
    out = column(clean.normalize(vectors([[3, 4], [0, 0]])))
    assert np.allclose(out, [[0.6, 0.8], [0, 0]])


def test_normalize_is_skipped_for_unit_vectors(vectors):
    assert clean.normalize_if_needed(vectors([[1, 0], [0, 1]]))[1] is False
    done, changed = clean.normalize_if_needed(vectors([[3, 4]]))
    assert changed and clean.all_unit(done) and clean.all_unit(vectors([]))


def test_products(vectors):
    r = vectors([[1, 2]]).select(V.dot(F.col("vec"), F.array(F.lit(3.0), F.lit(4.0))).alias("d"), V.squared_distance(F.col("vec"), F.array(F.lit(3.0), F.lit(4.0))).alias("l"), V.cosine(F.col("vec"), F.col("vec")).alias("c"), V.prefix(F.col("vec"), 1).alias("p")).collect()[0]
    assert r["d"] == 11 and r["l"] == 8 and math.isclose(r["c"], 1, rel_tol=1e-6) and r["p"] == [1.0]


def test_zero_removal_is_inclusive_and_counting_may_be_strict(vectors):
    rows = vectors([[0], [0.25], [0.5], [1]])
    kept = clean.remove_zeros(rows, 0.5)
    assert column(kept) == [[1.0]] and column(kept, "ord") == [0]
    n = F.col("norm")
    assert profile.norms(rows).agg(profile.zero_count(n, 0.5), profile.zero_count(n, 0.5, inclusive=False)).collect()[0][:] == (3, 2)
    with pytest.raises(ValueError):
        clean.remove_zeros(vectors([[0.0]]))
    with pytest.raises(ValueError):
        clean.remove_zeros(rows, -1)


def test_histogram(vectors):
    rows = sorted(tuple(r) for r in profile.norm_histogram(vectors([[0], [2], [2]])).collect())
    assert [(r[0], r[3]) for r in rows] == [(-1, 1), (0, 2)] and rows[1][1:3] == (2.0, 2.02)
    spread = profile.norm_histogram(vectors([[1], [10], [100]])).collect()
    assert sorted(r["bin"] for r in spread) == [0, 50, 99]
    assert profile.norm_histogram(vectors([[0], [0]])).count() == 1


def test_summary_and_errors(vectors):
    s = profile.summary(vectors([[0, 0], [3, 4]])).collect()[0]
    assert (s["total"], s["dim"], s["normalized"], s["zero_count"], list(s["first_vector"])) == (2, 2, False, 1, [0.0, 0.0])
    assert profile.norm_errors(vectors([])).collect()[0][:] == (0.0, 0.0)
    assert profile.norm_stats(vectors([[3, 4], [0, 2]])).collect()[0][:] == (2.0, 5.0, 3.5, 4.0)


def test_sort_and_sortedness(vectors):
    rows = vectors([[2, 1], [1, 9], [1, 2], [1, 2]])
    ordered = order.sorted_ordinals(rows)
    assert column(ordered, key="sorted_ord") == [[1, 2], [1, 2], [1, 9], [2, 1]]
    assert [r["ord"] for r in order.sort(rows).collect()] == [2, 3, 1, 0]
    assert order.first_unsorted(rows).collect()[0][0] == 2
    assert order.first_unsorted(ordered.selectExpr("sorted_ord AS ord", "vec")).collect()[0][0] is None


@pytest.mark.parametrize("width", [1, 2, 3, 100])
def test_previous_row_crosses_bins(vectors, width):
    rows = order.with_previous(vectors([[1], [2], [3], [4], [5]]), "vec", "before", width=width)
    assert column(rows, "before") == [None, [1], [2], [3], [4]]


def test_shuffle_is_a_reproducible_permutation(vectors):
    rows = vectors([[i] for i in range(50)])
    once, again = column(order.shuffle(rows, 7)), column(order.shuffle(rows.repartition(3), 7))
    assert once == again and sorted(once) == [[float(i)] for i in range(50)] and once != sorted(once)
    assert column(order.shuffle(rows, 8)) != once


def test_sample_truncate_at(vectors):
    rows = vectors([[i] for i in range(10)])
    assert order.sample(rows, 4).count() == 4
    assert column(order.truncate(rows, 2)) == [[0], [1]] and order.truncate(rows, 50).count() == 10
    assert order.at(rows, 3).collect()[0]["vec"] == [3.0]
    with pytest.raises(IndexError):
        order.at(rows, 10)


def test_reordinal_is_dense(spark, monkeypatch):
    monkeypatch.setattr(order, "BIN_WIDTH", 4)
    rows = spark.createDataFrame([(i * 3,) for i in range(9)], "ord long").withColumn("old", F.col("ord"))
    assert column(order.reordinal(rows), "old") == [i * 3 for i in range(9)]
    assert column(order.reordinal(rows), "ord") == list(range(9))


A, B, C = [1.0, 1.0], [1.0, 2.0], [2.0, 0.0]


def test_dedup_and_reports(vectors):
    rows = vectors([A, B, A, C, A])
    out = [(list(r["vec"]), r["first_ord"], r["cnt"]) for r in dedup.dedup(rows).collect()]
    assert out == [(A, 0, 3), (B, 1, 1), (C, 3, 1)]
    assert dedup.totals(rows).collect()[0][:] == (5, 3, 2)
    r = dedup.report(rows).collect()
    assert len(r) == 1 and r[0]["cnt"] == 3 and r[0]["first_line"] == 1 and r[0]["head"] == A
    assert sorted(x["line"] for x in dedup.lines(rows).collect()) == [3, 5]
    assert sorted(x["line"] for x in dedup.lines(rows, include_first=True).collect()) == [1, 3, 5]
    assert sorted(tuple(x) for x in dedup.histogram(rows).collect()) == [(1, 2), (3, 1)]
    assert dedup.top(rows, threshold=0).count() == 3
    assert dedup.dedup(vectors([])).count() == 0


def test_dedup_lines_are_the_ten_first(vectors):
    assert [r["line"] for r in dedup.lines(vectors([A] * 30)).orderBy("nth").collect()] == list(range(2, 12))
    assert [r["line"] for r in dedup.lines(vectors([A] * 30), include_first=True).orderBy("nth").collect()] == list(range(1, 11))


def test_dedup_adjacent(vectors):
    assert column(dedup.dedup_adjacent(vectors([A, A, B, A]))) == [A, B, A]
    assert column(dedup.dedup_sorted(vectors([A, A, B]))) == [A, B]
    with pytest.raises(ValueError, match="line 2"):
        dedup.dedup_sorted(vectors([B, A]))


def test_signed_zero_and_nan(vectors):
    rows = vectors([[0.0], [-0.0], [float("nan")], [float("nan")]])
    assert dedup.groups(rows).count() == 2 and dedup.groups(rows, nan_distinct=True).count() == 3


def test_concat(vectors):
    out = assemble.concat(vectors([[1, 2], [3, 4]]), vectors([[5, 6], [7, 8], [9, 10]]))
    assert column(out) == [[1, 2], [3, 4], [5, 6], [7, 8], [9, 10]] and column(out, "ord") == list(range(5))
    with pytest.raises(ValueError, match="dimensions differ"):
        assemble.concat(vectors([[1, 2]]), vectors([[1, 2, 3]]))
    with pytest.raises(ValueError, match="inconsistent"):
        assemble.dimension(vectors([[1, 2], [3, 4, 5]]))


def test_larger_first(vectors):
    out = assemble.larger_first(("alpha", vectors([[1, 2], [3, 4]])), ("beta", vectors([[5, 6], [7, 8], [9, 10]])))
    assert column(out)[0] == [5, 6] and column(out)[-1] == [3, 4]


def test_pairing():
    pairs, alone = assemble.pair_files(["demo_128_alpha_100000.fvec", "demo_128_beta_10000.fvecs", "orphan_256_only.fvec"])
    assert pairs == {"demo_128": ("demo_128_alpha_100000.fvec", "demo_128_beta_10000.fvecs")} and alone == ["orphan_256_only.fvec"]
    assert names.dataset_name(["ada", "002", "1000000"]) == "ada_002_1000000"
    assert names.match_rank("a_1", "b_1") is None


def test_bin_edges():
    assert names.bin_edge(0.5, 0.01, 1.0) == "0.5000" and names.bin_edge(5, 10, 10) == "5.000000e+00" and names.key_as_file_name("a/b") == "a__b"


def test_shards(vectors):
    rows = [tuple(r) for r in assemble.shards(vectors([[i] for i in range(7)]), 3).orderBy("shard_id").collect()]
    assert rows == [(0, 3, "x_3_0"), (1, 3, "x_3_1"), (2, 1, "x_1_2")]


def test_split(vectors):
    rows = vectors([[i] for i in range(10)])
    query, base = assemble.split(rows, 3, 5)
    q, b = [v[0] for v in column(query)], [v[0] for v in column(base)]
    assert q == sorted(q) and len(q) == 3 and b == [x for x in map(float, range(10)) if x not in q][:5]
    with pytest.raises(ValueError):
        assemble.split(rows, 11)


def brute(base, query, k, metric):
    s = query @ base.T if metric == "ip" else -((query[:, None] - base[None]) ** 2).sum(-1)
    return [[int(i) for i in np.lexsort((np.arange(len(base)), -row))[:k]] for row in s]


@pytest.mark.parametrize("metric", ["l2", "ip"])
@pytest.mark.parametrize("how", [{}, {"broadcast_bytes": 0}, {"strategy": "expr"}])
def test_knn(vectors, metric, how):
    rng = np.random.default_rng(12345)
    base, query = (rng.random((n, 16)) * 10).astype(np.float32) if (n := 300) else None, (rng.random((10, 16)) * 10).astype(np.float32)
    found = knn.wide(knn.knn(vectors(base.tolist()).repartition(3), vectors(query.tolist()), 4, metric, **how))
    assert column(found, "ids", "query_ord") == brute(base.astype(float), query.astype(float), 4, metric)


def test_knn_high_dimension_cosine(vectors):
    rng = np.random.default_rng(12345)
    base, query = vectors((rng.random((200, 300)) * 10).tolist()), vectors((rng.random((5, 300)) * 10).tolist())
    unit = [clean.normalize(x) for x in (base, query)]
    b, q = (np.array(column(x), float) for x in unit)
    assert column(knn.wide(knn.knn(*unit, 4, "ip")), "ids", "query_ord") == brute(b, q, 4, "ip")


def test_knn_ties_and_small_base(vectors):
    found = knn.knn(vectors([[1], [1]]), vectors([[1]]), 3).orderBy("rank").collect()
    assert [(r["rank"], r["base_ord"]) for r in found] == [(1, 0), (2, 1)]
    with pytest.raises(ValueError, match="metric"):
        knn.knn(vectors([[1]]), vectors([[1]]), 1, "cosine")
    assert knn.knn(vectors([]), vectors([[1]]), 2).count() == 0


ODD = [None, [1.0, None, 2.0, 0.5], [float("nan"), 1.0, 1.0, 1.0], [float("inf"), 1.0, 0.0, 1.0], [-float("inf"), 1.0, 0.0, 1.0], [1.0, 2.0], []]


@pytest.mark.parametrize("metric", ["l2", "ip"])
@pytest.mark.parametrize("broadcast_bytes", [0, knn.BROADCAST_BYTES])
def test_expressions_rank_odd_vectors(spark, metric, broadcast_bytes):
    rng = np.random.default_rng(5)
    rows = [(i, x) for i, x in enumerate([*ODD[:3], *rng.integers(-3, 4, (40, 4)).astype(float).tolist(), *ODD[3:]])]
    v = spark.createDataFrame(rows, "ord long, vec array<float>")
    query = v.filter(F.col("ord").isin([*range(0, 47, 5), 1, 2, 43, 47, 49]))
    pairs = knn._crossed(v, query, metric).collect()
    want = {}
    for q in {r["query_ord"] for r in pairs}:
        # Spark's order: NaN is the greatest, nulls are the smallest.
        size = lambda s: (0, 0.0) if s is None else (2, 0.0) if np.isnan(s) else (1, s)
        sign = -1 if metric == "ip" else 1
        mine = sorted((tuple(sign * x for x in size(r["score"])), r["base_ord"]) for r in pairs if r["query_ord"] == q)
        want[q] = [i for _, i in mine[:6]]
    found = knn.wide(knn.knn(v, query, 6, metric, "expr", broadcast_bytes)).collect()
    assert {r["query_ord"]: r["ids"] for r in found} == want
    assert knn.wide(knn.knn(v, query.filter("ord = 1"), 6, metric, "expr", broadcast_bytes)).collect()[0]["ids"] == want[1]
    assert knn.knn(v, query.filter("ord < 0"), 6, metric, "expr", broadcast_bytes).count() == 0


def test_expressions_cross_no_whole_vectors(vectors):
    base = vectors(np.random.default_rng(1).random((50, 8)).tolist())
    plan = knn.knn(base, base, 3, "ip", "expr")._jdf.queryExecution().optimizedPlan().toString()
    assert "zip_with" not in plan.lower() and "Join" not in plan


def searched(base, ids, query, k, metric, rows):
    """The broadcast kernel's rows over batches of ``rows`` base rows, ranked: ids of each query."""
    import pyarrow as pa

    batches = [pa.record_batch([pa.array(ids[i : i + rows]), pa.array(list(base[i : i + rows]))], ["ord", "vec"]) for i in range(0, len(base), rows)]
    sent = SimpleNamespace(value=(np.arange(len(query)), query.astype(float)))
    found = pa.Table.from_batches(knn._broadcast_kernel(sent, k, metric)(iter(batches))).to_pylist()
    sign = -1 if metric == "ip" else 1
    ranked = sorted((r["query_ord"], sign * r["score"], r["base_ord"]) for r in found)
    return [[i for at, _, i in ranked if at == q][:k] for q in range(len(query))]


@pytest.mark.parametrize("metric", ["l2", "ip"])
def test_search_holds_little_where_many_rows_tie(metric):
    import tracemalloc

    base, query = np.ones((8192, 32), np.float32), np.random.default_rng(3).random((512, 32)).astype(np.float32)
    tracemalloc.start()
    found = searched(base, np.arange(8192)[::-1].copy(), query, 5, metric, 8192)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == [[0, 1, 2, 3, 4]] * 512
    assert peak < 300e6  # the tied pairs' vectors at once would be 2 GB


@pytest.mark.parametrize("metric", ["l2", "ip"])
@pytest.mark.parametrize("tiles", [{}, {"QUERY_TILE": 3, "BASE_TILE": 7, "SCORED_BYTES": 200, "MANY": 1}])
def test_search_in_tiles(metric, tiles, monkeypatch):
    rng = np.random.default_rng(8)
    base = rng.integers(-2, 3, (200, 4)).astype(np.float32)  # many ties
    query = rng.integers(-2, 3, (11, 4)).astype(np.float32)
    base = base[np.argsort(((base[:, None] - query[None]) ** 2).sum((1, 2)))[::-1]]  # better ones last
    for name, value in tiles.items():
        monkeypatch.setattr(knn, name, value)
    for k, rows in ((1, 200), (6, 50), (6, 3), (300, 60)):
        assert searched(base, np.arange(200), query, k, metric, rows) == brute(base.astype(float), query.astype(float), k, metric)


def test_streaming(spark, tmp_path, vectors):
    vectors([[3, 4], [0, 0]]).write.parquet(str(tmp_path / "in"))
    stream = clean_stream(spark.readStream.schema(vectors([[1]]).schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("cleaned").trigger(availableNow=True).start()
    query.awaitTermination(60)
    rows = spark.table("cleaned").collect()
    assert len(rows) == 1 and np.allclose(rows[0]["vec"], [0.6, 0.8]) and rows[0]["norm"] == 5


def test_normalize_takes_time_in_proportion_to_components(spark):
    import time

    from pyspark.sql import functions as F

    from vecprep.functions import vector as V

    took = {}
    for dim in (64, 512):  # as many components either way
        rows = spark.range(0, 2_000_000 // dim, 1, 1).select(F.transform(F.sequence(F.lit(1), F.lit(dim)), lambda i: (i + F.col("id")).cast("float")).alias("vec"))
        runs = []
        for _ in range(3):
            began = time.perf_counter()
            rows.select(F.aggregate(V.normalize(F.col("vec")), F.lit(0.0), lambda a, x: a + x).alias("x")).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        took[dim] = min(runs)
    assert took[512] < 3 * took[64] + 0.3


def test_sortedness_by_bytes(vectors):
    from vecprep.operators import order

    assert order.first_unsorted_bytes(vectors([[0.0], [1.0], [2.0]])).collect()[0][0] == 3  # 00 00 80 3f, then 00 00 00 40
    assert order.first_unsorted_bytes(vectors([[2.0], [1.0], [1.0, 0.0]])).collect()[0][0] is None
