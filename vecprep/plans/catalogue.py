"""The library's operators as queries over ``embeddings``, each with the same thing in SQL.

The table is of unit norm and without zeros and duplicates, so most queries work on inputs derived in both engines:
``scaled`` (norms 1 to 37), ``dirty`` (scaled, every 50th vector zero), ``dups`` (vectors two and three times over) and
``gt`` (neighbour lists with injected faults). Results are scalar rows; doubles are rounded to 6 places.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names
from ..functions import vector as V
from ..operators import assemble, clean, dedup, groundtruth, knn, order, profile
from ..sources import codec
from ..sources.files import first_row
from ..sources.fvecs import read_fvecs, swap_endianness, vector_at, write_fvecs, write_shards
from ..sources.ivecs import read_ivecs, row_at, write_ivecs
from ..tables import materialise, shared_dir
from .prep import PrepConfig, ground_truth

Query = Callable[[SparkSession, str], DataFrame]
K = 10
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

FILES = ("demo_128_alpha_100000", "demo_128_beta_10000", "demo_128_gamma_500", "glove_200_base_1000", "glove_200_query_10", "orphan_256_only", "sift_128_base", "sift_128_learn")

_VIEWS = {
    "emb": "SELECT vec_id AS ord, embedding AS vec FROM embeddings",
    "scaled": "SELECT ord, list_transform(vec, lambda x: CAST(CAST(x AS DOUBLE) * (1 + ord % 37) AS FLOAT)) AS vec FROM emb",
    "dirty": "SELECT ord, list_transform(vec, lambda x: CASE WHEN ord % 50 = 0 THEN CAST(0 AS FLOAT) ELSE x END) AS vec FROM scaled",
    "dups": "SELECT ord, vec FROM emb UNION ALL SELECT ord + 100000, vec FROM emb WHERE ord % 5 = 0 UNION ALL SELECT ord + 200000, vec FROM emb WHERE ord % 10 = 0",
    "normed": "SELECT ord, vec, sqrt(list_sum(list_transform(vec, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS norm FROM {0}",
    "unit": "SELECT ord, list_transform(vec, lambda x: CAST(CAST(x AS DOUBLE) / CASE WHEN norm <= 1e-6 THEN 1.0 ELSE norm END AS FLOAT)) AS vec FROM normed",
}


def _embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("ord"), F.col("embedding").alias("vec"))


def _scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    factor = F.lit(1) + F.col("ord") % 37
    return _embeddings(spark, sf_dir).withColumn("vec", F.transform("vec", lambda x: (x.cast("double") * factor).cast("float")))


def _dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scaled(spark, sf_dir).withColumn("vec", F.transform("vec", lambda x: F.when(F.col("ord") % 50 == 0, F.lit(0.0)).otherwise(x).cast("float")))


def _dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _embeddings(spark, sf_dir)
    again = lambda step, shift: e.filter(F.col("ord") % step == 0).withColumn("ord", F.col("ord") + shift)
    return e.unionByName(again(5, 100_000)).unionByName(again(10, 200_000))


def _asking(df: DataFrame) -> DataFrame:
    return df.filter(F.col("ord") % 20 == 0)


def _with(*views: str, normed: str | None = None) -> str:
    return "WITH " + ", ".join(f"{v} AS ({_VIEWS[v].format(normed)})" for v in ("emb", *views)) + " "


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name, with its SQL."""

    def register(f: Query) -> Query:
        name = f.__name__
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return register


def _rounded(c: Column) -> Column:
    return F.round(c, 6)


# Nearest neighbours

_DOT = "list_inner_product(CAST(q.vec AS DOUBLE[]), CAST(b.vec AS DOUBLE[]))"
_L2 = "list_sum(list_transform(list_zip(q.vec, b.vec), lambda p: (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)) * (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE))))"


def _knn_sql(score: str, direction: str, columns: str, views: str, side: str = "emb", base_filter: str = "TRUE", k: int = K) -> str:
    return f"""{views}, s AS (SELECT q.ord AS query_id, b.ord AS base_id, {score} AS score FROM {side} q, {side} b WHERE q.ord % 20 = 0 AND {base_filter}),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score {direction}, base_id) AS rank FROM s)
SELECT {columns} FROM r WHERE rank <= {k}"""


_PLACES = "query_id, CAST(rank AS INTEGER) AS rank, base_id"


def _neighbors(base: DataFrame, query: DataFrame, metric: str, scored: bool = False) -> DataFrame:
    found = knn.knn(base, query, K, metric).select(F.col("query_ord").alias("query_id"), "rank", F.col("base_ord").alias("base_id"), _rounded(F.col("score")).alias("score"))
    return found if scored else found.drop("score")


@_query(_knn_sql(_DOT, "DESC", _PLACES, _with()))
def knn_ip(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _embeddings(spark, sf_dir)
    return _neighbors(e, _asking(e), "ip")


@_query(_knn_sql(_L2, "ASC", _PLACES, _with()))
def knn_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _embeddings(spark, sf_dir)
    return _neighbors(e, _asking(e), "l2")


@_query(_knn_sql(_DOT, "DESC", _PLACES, _with("scaled", "normed", "unit", normed="scaled"), "unit"))
def knn_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = clean.normalize(_scaled(spark, sf_dir))
    return _neighbors(unit, _asking(unit), "ip")


@_query(_knn_sql(_DOT, "DESC", _PLACES + ", round(score, 6) AS score", _with()))
def knn_ip_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _embeddings(spark, sf_dir)
    return _neighbors(e, _asking(e), "ip", scored=True)


@_query(_knn_sql(_L2, "ASC", _PLACES + ", round(score, 6) AS score", _with()))
def knn_l2_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _embeddings(spark, sf_dir)
    return _neighbors(e, _asking(e), "l2", scored=True)


@_query(_knn_sql(_DOT, "DESC", _PLACES, _with()))
def knn_ip_expr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, ranked as column expressions rank any vector (nulls, NaN, other lengths)."""
    e = _embeddings(spark, sf_dir)
    return knn.knn(e, _asking(e), K, "ip", strategy="expr").select(F.col("query_ord").alias("query_id"), "rank", F.col("base_ord").alias("base_id"))


@_query(_knn_sql(_L2, "ASC", _PLACES, _with()))
def knn_l2_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same where the queries are too many to broadcast."""
    e = _embeddings(spark, sf_dir)
    return knn.knn(e, _asking(e), K, "l2", broadcast_bytes=0).select(F.col("query_ord").alias("query_id"), "rank", F.col("base_ord").alias("base_id"))


@_query(_knn_sql(_DOT, "DESC", _PLACES, _with(), base_filter="b.ord % 20 <> 0"))
def knn_disjoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _embeddings(spark, sf_dir)
    return _neighbors(e.filter(F.col("ord") % 20 != 0), _asking(e), "ip")


@_query(
    _knn_sql(_DOT, "DESC", "query_id, base_id", _with()).replace("WITH emb", "WITH found AS (WITH emb")
    + ") SELECT query_id, label, count(*) AS votes FROM found JOIN embeddings ON vec_id = base_id GROUP BY query_id, label"
)
def knn_label_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("base_id"), "label")
    return knn_ip(spark, sf_dir).join(labels, "base_id").groupBy("query_id", "label").agg(F.count("*").alias("votes"))


# Norms and cleaning

_NORMED = _with("scaled", "dirty", "normed", normed="dirty")


@_query(_NORMED + "SELECT ord AS vec_id, round(norm, 6) AS value FROM normed")
def vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.norms(_dirty(spark, sf_dir)).select(F.col("ord").alias("vec_id"), _rounded(F.col("norm")).alias("value"))


@_query(_NORMED + "SELECT ord AS vec_id, round(abs(norm - 1), 6) AS value FROM normed")
def norm_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.norms(_dirty(spark, sf_dir)).select(F.col("ord").alias("vec_id"), _rounded(V.norm_deviation(F.col("norm"))).alias("value"))


@_query(_with("scaled", "dirty", "normed", "unit", normed="dirty") + "SELECT ord AS vec_id, CAST(unnest(generate_series(1, len(vec))) AS INTEGER) AS pos, round(CAST(unnest(vec) AS DOUBLE), 6) AS value FROM unit")
def normalize_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = clean.normalize(_dirty(spark, sf_dir)).select(F.col("ord").alias("vec_id"), F.posexplode("vec").alias("at", "x"))
    return rows.select("vec_id", (F.col("at") + 1).alias("pos"), _rounded(F.col("x").cast("double")).alias("value"))


@_query(_NORMED + "SELECT count(*) FILTER (norm <= 1e-6) AS inclusive, count(*) FILTER (norm < 1e-6) AS strict, count(*) FILTER (norm = 0) AS exact FROM normed")
def zero_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("norm")
    return profile.norms(_dirty(spark, sf_dir)).agg(profile.zero_count(n).alias("inclusive"), profile.zero_count(n, inclusive=False).alias("strict"), profile.zero_count(n, 0.0).alias("exact"))


@_query(_NORMED + "SELECT ord AS vec_id, row_number() OVER (ORDER BY ord) - 1 AS new_ord FROM normed WHERE norm > 1e-6")
def remove_zeros(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _dirty(spark, sf_dir).withColumn("vec_id", F.col("ord"))
    return clean.remove_zeros(rows).select("vec_id", F.col("ord").alias("new_ord"))


@_query(
    _with("scaled", "normed", "unit", normed="scaled")
    + "SELECT (SELECT bool_and(abs(norm - 1) < 1e-5) FROM normed) AS before, (SELECT bool_and(abs(sqrt(list_sum(list_transform(vec, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) - 1) < 1e-5) FROM unit) AS after"
)
def is_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scaled(spark, sf_dir)
    after = V.norm(V.normalize(F.col("vec")))
    return profile.norms(rows).agg(profile.all_normalized(F.col("norm")).alias("before"), profile.all_normalized(after).alias("after"))


@_query(_NORMED + "SELECT round(min(norm), 6) AS min, round(max(norm), 6) AS max, round(avg(norm), 6) AS mean, round(max(abs(norm - 1)), 6) AS max_abs_deviation_from_1 FROM normed")
def norm_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = profile.norm_stats(_dirty(spark, sf_dir))
    return found.select([_rounded(F.col(c)).alias(c) for c in found.columns])


@_query(_NORMED + "SELECT round(max(abs(norm - 1)), 6) AS max_error, round(avg(abs(norm - 1)), 6) AS mean_error FROM normed")
def norm_error_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = profile.norm_errors(_dirty(spark, sf_dir))
    return found.select([_rounded(F.col(c)).alias(c) for c in found.columns])


@_query(_NORMED + "SELECT count(*) FILTER (abs(norm - 1) > 1e-5) AS cnt FROM normed")
def unnormalized_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.norms(_dirty(spark, sf_dir)).agg(profile.unnormalized_count(F.col("norm")).alias("cnt"))


@_query(
    _NORMED
    + """, e AS (SELECT min(norm) AS lo, max(norm) AS hi FROM normed WHERE norm > 0),
b AS (SELECT CASE WHEN norm = 0 THEN -1 WHEN lo = hi THEN 0 ELSE greatest(least(floor((log10(norm) - log10(lo)) / (log10(hi) - log10(lo)) * 100), 99), 0) END AS bin FROM normed, e)
SELECT CAST(bin AS INTEGER) AS bin, count(*) AS cnt FROM b GROUP BY bin"""
)
def norm_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.norm_histogram(_dirty(spark, sf_dir)).select("bin", "cnt")


@_query(
    _NORMED
    + """SELECT count(*) AS total, CAST(max(len(vec)) AS INTEGER) AS dim, bool_and(abs(norm - 1) <= 1e-5) AS normalized, count(*) FILTER (norm < 1e-6) AS zero_count,
round(CAST(min_by(vec, ord)[1] AS DOUBLE), 6) AS first_component FROM normed"""
)
def dataset_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = profile.summary(_dirty(spark, sf_dir))
    return s.select("total", "dim", "normalized", "zero_count", _rounded(F.col("first_vector")[0].cast("double")).alias("first_component"))


# Order

@_query(_with("dups") + "SELECT ord AS vec_id, row_number() OVER (ORDER BY vec, ord) - 1 AS sorted_ord FROM dups")
def lexi_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.sorted_ordinals(_dups(spark, sf_dir)).select(F.col("ord").alias("vec_id"), "sorted_ord")


@_query(_with() + "SELECT min(CASE WHEN vec < before THEN ord + 1 END) AS first_violation FROM (SELECT ord, vec, lag(vec) OVER (ORDER BY ord) AS before FROM emb)")
def sortedness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.first_unsorted(_embeddings(spark, sf_dir))


_HASH = "md5('42:' || CAST(ord AS VARCHAR))"


@_query(_with() + f"SELECT ord AS vec_id, row_number() OVER (ORDER BY {_HASH}, ord) - 1 AS new_ord FROM emb")
def shuffle_seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _embeddings(spark, sf_dir).select(F.col("ord").alias("vec_id"), "ord")
    return order.shuffle(rows).select("vec_id", F.col("ord").alias("new_ord"))


_SAMPLED = _with() + f", h AS (SELECT ord, row_number() OVER (ORDER BY {_HASH}, ord) <= 50 AS chosen FROM emb) "


@_query(_SAMPLED + "SELECT ord AS vec_id FROM h WHERE chosen")
def sample_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.sample(_embeddings(spark, sf_dir), 50).select(F.col("ord").alias("vec_id"))


def _split(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return assemble.split(_embeddings(spark, sf_dir).select(F.col("ord").alias("vec_id"), "ord"), 50, 300)


@_query(_SAMPLED + "SELECT ord AS vec_id, row_number() OVER (ORDER BY ord) - 1 AS new_ord FROM h WHERE chosen")
def split_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split(spark, sf_dir)[0].select("vec_id", F.col("ord").alias("new_ord"))


@_query(_SAMPLED + "SELECT * FROM (SELECT ord AS vec_id, row_number() OVER (ORDER BY ord) - 1 AS new_ord FROM h WHERE NOT chosen) WHERE new_ord < 300")
def split_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split(spark, sf_dir)[1].select("vec_id", F.col("ord").alias("new_ord"))


@_query(_with() + "SELECT ord AS vec_id FROM emb WHERE ord < 100")
def truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.truncate(_embeddings(spark, sf_dir), 100).select(F.col("ord").alias("vec_id"))


@_query(_with() + "SELECT ord // 150 AS shard_id, count(*) AS n, 'x_' || count(*) || '_' || (ord // 150) AS name FROM emb GROUP BY ord // 150")
def shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assemble.shards(_embeddings(spark, sf_dir), 150)


@_query(_with() + "SELECT ord - 100 AS ord, 'b' AS src FROM emb WHERE ord >= 100 UNION ALL SELECT ord + (SELECT count(*) - 100 FROM emb), 'a' FROM emb WHERE ord < 100")
def merge_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _embeddings(spark, sf_dir)
    a = e.filter("ord < 100").withColumn("src", F.lit("a"))
    b = order.reordinal(e.filter("ord >= 100")).withColumn("src", F.lit("b"))
    return assemble.larger_first(("a", a), ("b", b)).select("ord", "src")


@_query(_with() + "SELECT CAST(unnest(generate_series(1, len(vec))) AS INTEGER) AS pos, round(CAST(unnest(vec) AS DOUBLE), 6) AS value FROM emb WHERE ord = 7")
def get_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.at(_embeddings(spark, sf_dir), 7).select(F.posexplode("vec").alias("at", "x")).select((F.col("at") + 1).alias("pos"), _rounded(F.col("x").cast("double")).alias("value"))


_FILES_SQL = ", ".join(f"('{f}')" for f in FILES)


@_query(
    f"""WITH f(name) AS (VALUES {_FILES_SQL}),
p AS (SELECT a.name AS a, b.name AS b, string_split(a.name, '_') AS x, string_split(b.name, '_') AS y FROM f a, f b WHERE a.name <> b.name),
s AS (SELECT a, b, x, list_filter(generate_series(1, least(len(x), len(y))), lambda i: x[1:i] = y[1:i]) AS n FROM p),
t AS (SELECT a, b, len(n) AS tokens, array_to_string(x[1:len(n)], '_') AS prefix FROM s WHERE len(n) > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY tokens DESC, length(prefix) DESC, prefix DESC, b) AS place FROM t),
best AS (SELECT * FROM r WHERE place = 1)
SELECT u.prefix, u.a AS first, u.b AS second FROM best u JOIN best v ON u.a = v.b AND u.b = v.a WHERE u.a < u.b"""
)
def pair_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs, _ = assemble.pair_files(FILES)
    return spark.createDataFrame([(prefix, a, b) for prefix, (a, b) in pairs.items()], "prefix string, first string, second string")


@_query(
    f"""WITH f(name) AS (VALUES {_FILES_SQL}),
p AS (SELECT a.name AS a, b.name AS b, string_split(a.name, '_') AS x, string_split(b.name, '_') AS y FROM f a, f b WHERE a.name < b.name)
SELECT a, b, array_to_string(x[1:len(list_filter(generate_series(1, least(len(x), len(y))), lambda i: x[1:i] = y[1:i]))], '_') AS prefix FROM p"""
)
def shared_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = spark.createDataFrame([(x,) for x in FILES], "a string")
    return f.join(f.withColumnRenamed("a", "b"), F.col("a") < F.col("b")).select("a", "b", names.shared_prefix_column(F.col("a"), F.col("b")).alias("prefix"))


# Duplicates

_GROUPS = _with("dups") + ", g AS (SELECT vec, min(ord) AS first_ord, count(*) AS cnt FROM dups GROUP BY vec) "


@_query(_GROUPS + "SELECT first_ord, cnt, row_number() OVER (ORDER BY vec) - 1 AS sorted_ord FROM g")
def dedup_sorted_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dedup.groups(_dups(spark, sf_dir))
    return order.sorted_ordinals(rows, ord="first_ord").select("first_ord", "cnt", "sorted_ord")


@_query(_GROUPS + "SELECT cnt, first_ord + 1 AS first_line, round(CAST(vec[1] AS DOUBLE), 6) AS c1, round(CAST(vec[4] AS DOUBLE), 6) AS c4 FROM g WHERE cnt > 1")
def dup_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dedup.report(_dups(spark, sf_dir))
    return rows.select("cnt", "first_line", _rounded(F.col("head")[0].cast("double")).alias("c1"), _rounded(F.col("head")[3].cast("double")).alias("c4"))


@_query(_GROUPS + "SELECT cnt, count(*) AS vectors FROM g GROUP BY cnt")
def dup_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.histogram(_dups(spark, sf_dir))


@_query(_GROUPS + "SELECT cnt, first_ord + 1 AS first_line FROM g WHERE cnt > 1 ORDER BY cnt DESC, vec LIMIT 100")
def dup_top100(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.top(_dups(spark, sf_dir)).select("cnt", "first_line")


@_query(_GROUPS + "SELECT CAST(sum(cnt) AS BIGINT) AS processed, count(*) AS unique, CAST(sum(cnt) - count(*) AS BIGINT) AS removed FROM g".replace("AS unique", 'AS "unique"'))
def dup_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.totals(_dups(spark, sf_dir))


@_query(
    _GROUPS
    + """, n AS (SELECT vec, ord, row_number() OVER (PARTITION BY vec ORDER BY ord) AS nth FROM dups)
SELECT first_ord + 1 AS first_line, CAST(nth AS INTEGER) AS nth, ord + 1 AS line FROM n JOIN g USING (vec) WHERE cnt > 1 AND nth BETWEEN 2 AND 11"""
)
def dup_other_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.lines(_dups(spark, sf_dir))


@_query(_with() + ", r AS (SELECT ord, [CAST(vec[1] > 0 AS INTEGER)] AS vec FROM emb), l AS (SELECT ord, vec, lag(vec) OVER (ORDER BY ord) AS before FROM r) SELECT ord AS first_ord, row_number() OVER (ORDER BY ord) - 1 AS ord FROM l WHERE before IS NULL OR before <> vec")
def dedup_adjacent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of equal neighbours, of the sign of the first component."""
    rows = _embeddings(spark, sf_dir).withColumn("vec", F.array((F.col("vec")[0] > 0).cast("int")))
    return dedup.dedup_adjacent(rows).select("first_ord", "ord")


# Ground truth

_GT = (
    _knn_sql(_DOT, "DESC", "query_id, list(base_id ORDER BY rank) AS ids", _with()).replace("WITH emb", "WITH clean AS (WITH emb")
    + """ GROUP BY query_id),
gt AS (SELECT query_id AS query_ord, CASE WHEN query_id % 60 = 0 THEN list_concat([-1], ids[2:]) WHEN query_id % 60 = 20 THEN list_concat(ids[1:9], [ids[1]]) WHEN query_id % 100 = 0 THEN ids[1:7] ELSE ids END AS ids FROM clean)
"""
)


def _faulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbour lists: every third query's first id is -1, every third repeats its first, some are cut short."""
    gt = knn.wide(knn.knn(e := _embeddings(spark, sf_dir), _asking(e), K, "ip"))
    q, ids = F.col("query_ord"), F.col("ids")
    faulty = F.when(q % 60 == 0, F.concat(F.array(F.lit(-1).cast("long")), F.slice(ids, 2, K))).when(q % 60 == 20, F.concat(F.slice(ids, 1, 9), F.slice(ids, 1, 1))).when(q % 100 == 0, F.slice(ids, 1, 7)).otherwise(ids)
    return gt.select("query_ord", faulty.alias("ids"))


@_query(_GT + "SELECT query_ord, id, count(*) AS cnt FROM (SELECT query_ord, unnest(ids) AS id FROM gt) GROUP BY query_ord, id HAVING count(*) > 1")
def gt_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groundtruth.duplicate_ids(_faulty(spark, sf_dir))


@_query(_GT + "SELECT query_ord, CAST(len(list_filter(ids, lambda x: x < 0)) AS BIGINT) AS cnt FROM gt WHERE len(list_filter(ids, lambda x: x < 0)) > 0")
def gt_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groundtruth.negative_ids(_faulty(spark, sf_dir))


@_query(_GT + "SELECT query_ord, CAST(len(ids) AS BIGINT) AS length, CASE WHEN len(ids) < 10 THEN 'short' ELSE 'overlong' END AS kind FROM gt WHERE len(ids) <> 10")
def gt_bad_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groundtruth.wrong_lengths(_faulty(spark, sf_dir), K)


@_query(
    _GT
    + """SELECT count(*) AS num_rows, CAST(max(len(ids)) AS BIGINT) AS max_row_length, max(list_max(ids)) AS max_ordinal, count(*) FILTER (len(list_distinct(ids)) < len(ids)) AS duplicate_rows,
count(*) FILTER (len(list_filter(ids, lambda x: x < 0)) > 0) AS negative_rows, count(*) FILTER (len(ids) < 10) AS short_rows, count(*) FILTER (len(ids) > 10) AS overlong_rows, FALSE AS passed FROM gt"""
)
def gt_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groundtruth.validate(_faulty(spark, sf_dir), K).drop("fatal_error")


_SLICED = _GT + ", cut AS (SELECT query_ord, list_filter(ids, lambda x: x < 250)[1:3] AS ids FROM gt) "


@_query(_SLICED + "SELECT query_ord AS query_id, CAST(unnest(generate_series(1, len(ids))) AS INTEGER) AS rank, unnest(ids) AS base_id FROM cut")
def gt_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = groundtruth.slice_ids(_faulty(spark, sf_dir), 250, 3)
    return knn.long(cut).select(F.col("query_ord").alias("query_id"), "rank", F.col("base_ord").alias("base_id"))


@_query(_SLICED + "SELECT count(*) FILTER (len(ids) < 3) AS short_count FROM cut")
def gt_slice_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groundtruth.short_count(groundtruth.slice_ids(_faulty(spark, sf_dir), 250, 3), 3)


# The whole preparation, and files

@_query(
    _with("scaled", "dirty", "normed", "unit", normed="dirty")
    + f""", kept AS (SELECT u.ord AS vec_id, u.vec, row_number() OVER (ORDER BY u.ord) - 1 AS ord FROM unit u JOIN normed n ON u.ord = n.ord WHERE n.norm > 1e-6),
shuffled AS (SELECT vec_id, vec, row_number() OVER (ORDER BY {_HASH}, ord) - 1 AS ord FROM kept),
b AS (SELECT ord, vec FROM shuffled WHERE ord < 400), q AS (SELECT ord, vec FROM shuffled WHERE ord < 20),
s AS (SELECT q.ord AS query_id, b.ord AS base_id, {_DOT} AS score FROM q, b),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, base_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, base_id FROM r WHERE rank <= 5"""
)
def prep_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = PrepConfig(base="-", query="-", k=5, num_base=400, num_query=20, remove_zeros=True, shuffle=True, normalize=True, metric="ip")
    rows = _dirty(spark, sf_dir)
    return ground_truth(rows, rows, config)[2].select(F.col("query_ord").alias("query_id"), "rank", F.col("base_ord").alias("base_id"))


def _folder(spark: SparkSession) -> str | None:
    """A local folder that driver and executors share, for single files; None where the shared folder is remote."""
    import os

    folder = shared_dir(spark)
    if "://" in folder and not folder.startswith("file://"):
        return None
    path = folder.removeprefix("file://").removeprefix("file:")
    os.makedirs(path, exist_ok=True)
    return path


_LONG = "SELECT ord, CAST(unnest(generate_series(1, len(vec))) AS INTEGER) AS pos, CAST(unnest(vec) AS DOUBLE) AS value FROM "


def _long_form(df: DataFrame) -> DataFrame:
    return df.select("ord", F.posexplode("vec").alias("at", "x")).select("ord", (F.col("at") + 1).alias("pos"), F.col("x").cast("double").alias("value"))


def _file(spark: SparkSession, name: str) -> str:
    from uuid import uuid4

    folder = _folder(spark)
    if folder is None:
        raise ValueError("single-file formats need a shared folder that is mounted as a path")
    return f"{folder}/{uuid4().hex}-{name}"


@_query(_with("scaled") + _LONG + "scaled")
def fvecs_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _file(spark, "round.fvecs")
    write_fvecs(_scaled(spark, sf_dir), path)
    return materialise(_long_form(read_fvecs(spark, path)), "fvecs")


@_query(_with("scaled") + _LONG + "scaled")
def endian_swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    little, big = _file(spark, "little.fvecs"), _file(spark, "big.fvecs")
    write_fvecs(_scaled(spark, sf_dir), little)
    swap_endianness(spark, little, big)
    return materialise(_long_form(read_fvecs(spark, big, endian="big")), "fvecs")


@_query(_knn_sql(_DOT, "DESC", "query_id // 20 AS query_ord, CAST(rank AS INTEGER) AS rank, base_id", _with()))
def ivecs_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _file(spark, "gt.ivecs")
    e = _embeddings(spark, sf_dir)
    write_ivecs(knn.wide(knn.knn(e, _asking(e), K, "ip")), path, k=K)
    rows = materialise(knn.long(read_ivecs(spark, path)), "ivecs")
    return rows.select("query_ord", "rank", F.col("base_ord").alias("base_id"))


@_query(_with("scaled") + "SELECT CAST(max(len(vec)) AS INTEGER) AS dim, count(*) AS cnt FROM scaled")
def file_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From a file's first record and its size alone."""
    path = _file(spark, "layout.fvecs")
    write_fvecs(_scaled(spark, sf_dir), path)
    shape = codec.layout(path)
    return spark.createDataFrame([(shape.dim, shape.count)], "dim int, cnt long")


@_query(_with("scaled") + "SELECT CAST(unnest(generate_series(1, len(vec))) AS INTEGER) AS pos, CAST(unnest(vec) AS DOUBLE) AS value FROM scaled WHERE ord = 123")
def seek_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _file(spark, "seek.fvecs")
    write_fvecs(_scaled(spark, sf_dir), path)
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(vector_at(spark, path, 123), 1)], "pos int, value double")


@_query(_with("scaled") + _LONG + "scaled WHERE ord >= 100 AND ord < 130")
def seek_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _file(spark, "range.fvecs")
    write_fvecs(_scaled(spark, sf_dir), path)
    return materialise(_long_form(read_fvecs(spark, path, ord_start=100, ord_end=130)), "fvecs")


@_query(_with("scaled") + "SELECT ord // 150 AS shard, 'x_' || count(*) || '_' || (ord // 150) || '.fvecs' AS name, count(*) AS n, CAST(min_by(vec, ord)[1] AS DOUBLE) AS first FROM scaled GROUP BY ord // 150")
def shard_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards that tasks write, read back."""
    folder = _file(spark, "shards")
    names = write_shards(_scaled(spark, sf_dir), folder, 150, "x")
    rows = [(i, name, codec.layout(f"{folder}/{name}").count, float(vector_at(spark, f"{folder}/{name}", 0)[0])) for i, (name, _) in enumerate(names)]
    return spark.createDataFrame(rows, "shard long, name string, n long, first double")


@_query(_GT + "SELECT row_number() OVER (ORDER BY query_ord) - 1 AS query_ord, ids FROM gt".join(["SELECT query_ord, CAST(unnest(generate_series(1, len(ids))) AS INTEGER) AS rank, unnest(ids) AS base_id FROM (", ")"]))
def ivecs_ragged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of several lengths, written and read back."""
    path = _file(spark, "ragged.ivecs")
    write_ivecs(_faulty(spark, sf_dir), path, ragged=True)
    return materialise(knn.long(read_ivecs(spark, path)), "ivecs").select("query_ord", "rank", F.col("base_ord").alias("base_id"))


@_query(_GT + "SELECT count(*) AS num_rows, CAST(sum(len(ids)) AS BIGINT) AS ids, 'Error reading vector data at row ' || count(*) || ': expected 12 bytes, got 4. Unexpected end of file.' AS error FROM gt")
def ivecs_permissive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file that ends inside a row: all rows before it, and what is wrong."""
    path = _file(spark, "cut.ivecs")
    write_ivecs(_faulty(spark, sf_dir), path, ragged=True)
    with open(path, "ab") as f:
        f.write((3).to_bytes(4, "little") + (7).to_bytes(4, "little"))
    rows = materialise(read_ivecs(spark, path, permissive=True), "ivecs")
    return rows.agg(F.count_if(F.col("error").isNull()).alias("num_rows"), F.sum(F.when(F.col("error").isNull(), F.size("ids"))).alias("ids"), F.max("error").alias("error"))


@_query(_knn_sql(_DOT, "DESC", "CAST(rank AS INTEGER) AS rank, base_id", _with()) + " AND query_id = 140")
def ivecs_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _file(spark, "row.ivecs")
    e = _embeddings(spark, sf_dir)
    write_ivecs(knn.wide(knn.knn(e, _asking(e), K, "ip")), path, k=K)
    return spark.createDataFrame(list(enumerate(row_at(spark, path, 7), 1)), "rank int, base_id long")


@_query(_GROUPS + "SELECT first_ord AS vec_id, row_number() OVER (ORDER BY vec) - 1 AS ord FROM g")
def dedup_sorted_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sorted set without its repeats; an error if it weren't sorted."""
    rows = order.sorted_ordinals(_dups(spark, sf_dir)).select(F.col("sorted_ord").alias("ord"), "vec", F.col("ord").alias("vec_id"))
    rows = materialise(rows, "sorted")
    kept = dedup.dedup_sorted(rows.select("ord", "vec"))
    return kept.join(rows.select(F.col("ord").alias("o"), "vec_id"), F.col("first_ord") == F.col("o")).select("vec_id", "ord")


@_query(_with() + ", a AS (SELECT count(*) AS n FROM emb WHERE ord % 3 = 0) SELECT vec_id, row_number() OVER (ORDER BY small, vec_id) - 1 AS ord FROM (SELECT ord AS vec_id, ord % 3 = 0 AS small FROM emb)")
def merge_larger_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _embeddings(spark, sf_dir).withColumn("vec_id", F.col("ord"))
    small, large = (order.reordinal(e.filter(kind)) for kind in ("ord % 3 = 0", "ord % 3 <> 0"))
    return assemble.larger_first(("small", small), ("large", large)).select("vec_id", "ord")


@_query("SELECT vec_id, 'vec_id, embedding, label' AS columns FROM embeddings LIMIT 1")
def parquet_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns, row = first_row(spark, f"{sf_dir}/embeddings.parquet")
    return spark.createDataFrame([(row["vec_id"], ", ".join(columns))] if row else [], "vec_id long, columns string")


@_query(
    _NORMED
    + """, e AS (SELECT min(norm) AS lo, max(norm) AS hi FROM normed WHERE norm > 0),
b AS (SELECT DISTINCT greatest(least(floor((log10(norm) - log10(lo)) / (log10(hi) - log10(lo)) * 100), 99), 0) AS bin, lo, hi FROM normed, e WHERE norm > 0)
SELECT CAST(bin AS INTEGER) AS bin, printf('%.3e', pow(10, log10(lo) + bin * (log10(hi) - log10(lo)) / 100)) AS low FROM b"""
)
def bin_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lower edges of the histogram as text (four digits of them, which no rounding of logarithms reaches)."""
    rows = [r for r in profile.norm_histogram(_dirty(spark, sf_dir)).collect() if r["bin"] >= 0]  # 100 at most
    span, largest = max(r["low"] for r in rows) - min(r["low"] for r in rows), max(r["high"] for r in rows)
    return spark.createDataFrame([(r["bin"], f"{float(names.bin_edge(r['low'], span, largest)):.3e}") for r in rows], "bin int, low string")


@_query("SELECT key, replace(key, '/', '__') AS name FROM (VALUES ('train'), ('a/b'), ('/x//y/')) AS k(key)")
def key_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(k, names.key_as_file_name(k)) for k in ("train", "a/b", "/x//y/")], "key string, name string")


@_query(_with() + "SELECT min(CASE WHEN b < before THEN ord + 1 END) AS first_violation FROM (SELECT ord, b, lag(b) OVER (ORDER BY ord) AS before FROM (SELECT ord, ((ord * 7) % 200 + 27) % 2 * 1000 + ((ord * 7) % 200 + 27) // 2 AS b FROM emb))")
def sortedness_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the bytes of little-endian records of a power of two: the last bit of its exponent counts before the others."""
    rows = _embeddings(spark, sf_dir).withColumn("vec", F.array(F.pow(F.lit(2.0), (F.col("ord") * 7) % 200 - 100).cast("float")))
    return order.first_unsorted_bytes(rows)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
