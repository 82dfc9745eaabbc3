import math

import pytest
from pyspark.sql import functions as F

from vecprep.llm import mixing as M


def targets(sizes, weights=(1, 2, 3), limit=3):
    """Share by weight, cut what exceeds the limit, share the excess again among the rest."""
    total, names = sum(sizes.values()), sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    got, open_, left = dict.fromkeys(names, 0.0), set(names), float(total)
    while left > 1e-9 and open_:
        share = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if share * weight[s] > limit * sizes[s] - got[s] + 1e-12}
        if not full:
            for s in open_:
                got[s] += share * weight[s]
            break
        for s in full:
            left -= limit * sizes[s] - got[s]
            got[s] = limit * sizes[s]
        open_ -= full
    return got


@pytest.mark.parametrize("sizes", [{"a": 50}, {"a": 600, "b": 10, "c": 10, "d": 10}, {"b": 100, "a": 100, None: 30, "Z": 5}, {"a": 0, "b": 40}, {"é": 30, "z": 30, "A": 500, "B": 1}])
def test_targets_and_taken_words(documents, sizes):
    rows, k = [], 0
    for s, n in sizes.items():
        parts = [n // 3, n - n // 3] if n > 5 else [n]
        for p in parts:
            rows.append((k, " ".join(["w"] * p), s))
            k += 1
    found = M.mix(documents(rows), carry=("source",)).collect()
    want = targets(sizes)
    assert len(found) == len(rows)
    for s, n in sizes.items():
        own = [r for r in found if r["source"] == s]
        assert all(math.isclose(r["target"], want[s], rel_tol=1e-9, abs_tol=1e-9) and r["source_size"] == n for r in own)
        assert sum(r["taken"] for r in own) == math.floor(want[s] + 0.5)
        assert all(r["taken"] <= 3 * r["size"] for r in own)


def test_positions_follow_the_schedule(documents):
    rows = [(i, "w " * 10, s) for s in ("a", "b", "c") for i in range({"a": 0, "b": 1000, "c": 2000}[s], {"a": 0, "b": 1000, "c": 2000}[s] + 400)]
    found = M.mix(documents(rows), weights=(1, 1, 1), carry=("source",)).collect()
    early = {s: sum(r["position"] < 0.5 for r in found if r["source"] == s) / 400 for s in "abc"}
    # The halves of the schedules hold 5/8, 1/2 and 3/8 of their demand.
    assert abs(early["a"] - 0.625) < 0.01 and abs(early["b"] - 0.5) < 0.01 and abs(early["c"] - 0.375) < 0.01
    assert all(0 <= r["position"] <= 1 for r in found)


def test_inverse_of_the_schedule(spark):
    for which, rates in enumerate(M.SCHEDULES):
        step = 1 / (len(rates) - 1)
        times = [i / 20 for i in range(21)]

        def demand(t):
            total = 0.0
            for k, (a, b) in enumerate(zip(rates, rates[1:], strict=False)):
                x = min(max(t - k * step, 0), step)
                total += a * x + (b - a) / step * x * x / 2
            return total

        df = spark.createDataFrame([(t, demand(t) / demand(1)) for t in times], "t double, y double")
        for r in df.select("t", M.invert_schedule(F.col("y"), F.lit(which), M.SCHEDULES).alias("x")).collect():
            assert abs(r["t"] - r["x"]) < 1e-9


def test_reruns_and_partitions_agree(documents):
    rows = [(i, "w " * (i % 7), f"s{i % 4}") for i in range(200)]
    one, other = (sorted(map(tuple, M.mix(documents(rows).repartition(n)).drop("_from", "_demand", "_place").collect())) for n in (1, 5))
    assert one == other


def test_corpus_is_sorted_and_keeps_columns(documents):
    df = documents([(i, "w " * 5, "s" if i else "t") for i in range(50)]).withColumn("size", F.lit("x")).withColumn("position", F.lit(1))
    out = M.mixed_corpus(df)
    assert out.columns == df.columns and out.filter("size <> 'x'").count() == 0
    per_doc = {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert max(per_doc.values()) <= 3
    copies = {r["doc_id"]: r["copies"] for r in M.mix(df).collect()}
    assert per_doc == {d: c for d, c in copies.items() if c}


def test_corners(documents):
    assert M.mix(documents([])).collect() == [] and M.mixed_corpus(documents([])).collect() == []
    r = M.mix(documents([(None, None, None), (1, "", "a")])).collect()
    assert all(x["size"] == 0 and x["taken"] == 0 and x["target"] == 0 for x in r)
    twice = M.mix(documents([(1, "a b", "s"), (1, "a b", "s"), (None, "c", "s")])).collect()
    assert sum(x["taken"] for x in twice) == 5
    assert M.mix(documents([(1, "w " * 100_000, "s")])).collect()[0]["taken"] == 100_000


def test_rows_that_differ_in_text_alone_keep_their_copies(documents):
    """Two documents of one id and size, of which only one is taken: the same in every run."""
    rows = [(1, "a b", "s"), (1, "c d", "s")] + [(i, "w " * 50, "t") for i in range(10, 14)]
    taken = {tuple(sorted(r["text"] for r in M.mixed_corpus(documents(order).repartition(n), weights=(1, 99)).collect() if r["source"] == "s")) for order, n in ((rows, 1), (rows[::-1], 4), (rows, 7))}
    assert len(taken) == 1
