"""Mixing sources to target weights along a time-varying curriculum, with DataFrame functions only.

Targets. Sources in code-point order (null last) take the weights in turn and share all words; no source may exceed
``limit`` times its own words, and what it leaves goes to the others by weight until none is above. That fixed point is
``min(limit * size, level * weight)`` for one level, found from running sums over the sources sorted by the level at
which each would be full: no iteration.

Documents. Within a source, documents lie one after the other in the order of a hash of their id. ``target / size``
whole passes are taken, then a last pass as far as the target reaches, so a source's taken words equal its rounded
target. A source's running sum is taken over groups of hash-prefix bins, the bins of a group and then inside the bins, so no
task ever holds a source, however large its share.

Positions. Each source's rate over the run is piecewise linear (``SCHEDULES``, normalised to area 1) times its target;
the demand up to time t is its integral. A copy that begins at word w of its source is trained at the t where demand
reaches w. Inversion is the closed form of a quadratic on the segment that contains w. ``mixed_corpus`` range-sorts the
copies by that position.

Null or empty text has size 0 and takes nothing beyond the passes its place implies; a null source is a source like any
other, placed last; null ids hash like the empty string; repeated rows are documents of their own; an empty table gives
an empty table. Other columns, whatever their names, are ignored, or kept as they are by ``mixed_corpus``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialise, partitions_for

WORD = r"[^\x20\x09-\x0D]+"
#: Relative rates at equally spaced times, taken in turn by the sources: early, even and late emphasis.
SCHEDULES = ((1.5, 1.0, 0.5), (1.0, 1.0, 1.0), (0.5, 1.0, 1.5))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def order_key(doc_id: Column, seed: int) -> Column:
    """Hexadecimal digits that scatter the documents of a source; the same in every engine that has md5."""
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f":{seed}")).cast("binary"))


def source_targets(sizes: DataFrame, weights: Sequence[int], limit: int) -> DataFrame:
    """Per source: words, target and place. ``sizes``: one row (source, size) per source, which is all a task holds."""
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    fills = Window.orderBy("full_at", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    ranked = sizes.withColumn("place", F.row_number().over(by_name) - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")).cast("long"))
    ranked = ranked.withColumn("full_at", (F.lit(limit) * F.col("size")).cast("double") / F.col("weight"))
    ranked = ranked.withColumn("total", F.sum("size").over(everything)).withColumn("all_weight", F.sum("weight").over(everything))
    gone = F.coalesce(F.sum(F.lit(limit) * F.col("size")).over(fills), F.lit(0))
    gone_weight = F.coalesce(F.sum("weight").over(fills), F.lit(0))
    ranked = ranked.withColumn("level", (F.col("total") - gone).cast("double") / (F.col("all_weight") - gone_weight))
    level = F.max(F.when(F.col("level") <= F.col("full_at"), F.col("level"))).over(everything)
    return ranked.withColumn("level", level).select(
        "source", F.col("size").alias("source_size"), "place", F.least((F.lit(limit) * F.col("size")).cast("double"), F.col("level") * F.col("weight")).alias("target")
    )


def invert_schedule(share: Column, place: Column, schedules: Sequence[Sequence[float]]) -> Column:
    """The time in [0, 1] at which a source has met ``share`` of its demand."""
    out = F.lit(None).cast("double")
    for which, rates in enumerate(schedules):
        step = 1.0 / (len(rates) - 1)
        area = sum((a + b) * step / 2 for a, b in zip(rates, rates[1:], strict=False))
        done, time = 0.0, F.lit(None).cast("double")
        for k, (a, b) in reversed(list(enumerate(zip(rates, rates[1:], strict=False)))):
            a, b = a / area, b / area
            done = sum((x + y) * step / 2 / area for x, y in zip(rates[:k], rates[1 : k + 1], strict=True))
            rest = F.greatest(share - F.lit(done), F.lit(0.0))
            root = F.sqrt(F.greatest(F.lit(a * a) + F.lit(2 * (b - a) / step) * rest, F.lit(0.0)))
            here = F.lit(k * step) + F.when(rest > 0, F.lit(2.0) * rest / (F.lit(a) + root)).otherwise(0.0)
            time = here if k == len(rates) - 2 else F.when(share < F.lit(done + (a + b) * step / 2), here).otherwise(time)
        out = F.when(place % len(schedules) == which, F.least(time, F.lit(1.0))).otherwise(out)
    return out


def mix(docs: DataFrame, *, weights: Sequence[int] = (1, 2, 3), limit: int = 3, seed: int = 17, schedules: Sequence[Sequence[float]] = SCHEDULES, doc_id: str = "doc_id", text: str = "text", source: str = "source", carry: Sequence[str] = ()) -> DataFrame:
    """For all rows of ``docs``: doc_id and the columns in ``carry``, size, source_size, target, taken, copies, position.

    taken: words the mix takes of the document, repeats counted, exact to the word. copies: whole documents to train
    on, the last pass rounded at a document's middle. position: time of the first copy; the k-th lies at
    ``position_of(k)`` (see ``mixed_corpus``); null where nothing is taken.
    """
    digits = max(2, min(7, math.ceil(math.log(8 * partitions_for(docs), 16))))
    rows = docs.select(F.col(doc_id).alias("doc_id"), *carry, F.col(source).alias("_source"), word_count(F.col(text)).alias("size"), order_key(F.col(doc_id), seed).alias("_key"), F.xxhash64(text).alias("_tie"))
    rows = rows.withColumn("_bin", F.substring("_key", 1, digits))
    bins = materialise(rows.groupBy("_source", "_bin").agg(F.sum("size").alias("bin_size")), "mix-bins")
    # Running sums over groups of bins, then over the bins of a group: no task sees all bins of a source.
    earlier = lambda *keys: Window.partitionBy("_source", *keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("_group", F.substring("_bin", 1, digits // 2))
    groups = bins.groupBy("_source", "_group").agg(F.sum("bin_size").alias("group_size"))
    groups = groups.select(F.col("_source").alias("of"), F.col("_group").alias("g"), F.coalesce(F.sum("group_size").over(earlier("_group")), F.lit(0)).alias("group_start"))
    targets = source_targets(bins.groupBy(F.col("_source").alias("source")).agg(F.sum("bin_size").alias("size")), weights, limit)
    starts = bins.withColumn("_inside", F.coalesce(F.sum("bin_size").over(earlier("_group", "_bin")), F.lit(0)))
    starts = starts.join(groups, F.col("_source").eqNullSafe(F.col("of")) & (F.col("_group") == F.col("g"))).withColumn("bin_start", F.col("group_start") + F.col("_inside"))
    starts = starts.join(targets, F.col("_source").eqNullSafe(F.col("source"))).select(F.col("_source").alias("s"), F.col("_bin").alias("b"), "bin_start", "source_size", "target", F.col("place").alias("_place"))
    inside = Window.partitionBy("_source", "_bin").orderBy("_key", "doc_id", "size", "_tie").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("_from", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(starts, F.col("_source").eqNullSafe(F.col("s")) & (F.col("_bin") == F.col("b")))
    begin = F.col("bin_start") + F.col("_from")
    demand = F.floor(F.col("target") + F.lit(0.5)).cast("long")
    passes = F.when(F.col("source_size") > 0, F.floor(demand / F.col("source_size"))).otherwise(0).cast("long")
    rest = demand - passes * F.col("source_size") - begin
    taken = passes * F.col("size") + F.greatest(F.least(rest, F.col("size")), F.lit(0))
    share = begin.cast("double") / F.greatest(demand, F.lit(1))
    copies = passes + F.when((rest > 0) & (2 * rest >= F.col("size")), 1).otherwise(0)
    position = F.when((taken > 0) | (copies > 0), invert_schedule(share, F.col("_place"), schedules))
    return placed.select(
        "doc_id", *carry, "size", "source_size", "target", taken.alias("taken"), copies.cast("int").alias("copies"), position.alias("position"), begin.alias("_from"), demand.alias("_demand"), "_place"
    )


def mixed_corpus(docs: DataFrame, *, schedules: Sequence[Sequence[float]] = SCHEDULES, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The corpus to train on: each document as often as the mix takes it, range-sorted by training position.

    Columns are those of ``docs``. A document beyond its source's demand is absent.
    """
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("_row"), *(docs[c].alias(f"_{c}_") for c in {doc_id, text, source}))
    rows = mix(rows, schedules=schedules, carry=("_row",), doc_id=f"_{doc_id}_", text=f"_{text}_", source=f"_{source}_", **options).filter(F.col("copies") > 0)
    rows = rows.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    share = (F.col("_from") + F.col("_copy") * F.col("source_size")).cast("double") / F.greatest(F.col("_demand"), F.lit(1))
    rows = rows.select("_row", "doc_id", invert_schedule(share, F.col("_place"), schedules).alias("position"))
    return by_position(rows, partitions_for(docs)).select("_row.*")


def by_position(rows: DataFrame, partitions: int) -> DataFrame:
    """Range-sorted by position; documents at one position, or without one, are dealt by a hash of their id."""
    order = [F.col("position"), F.xxhash64("doc_id"), F.col("doc_id")]
    return rows.repartitionByRange(partitions, *order).sortWithinPartitions(*order)


def _position_sql(share: str, place: str) -> str:
    """``invert_schedule`` as SQL, operation by operation."""
    number = lambda x: f"CAST({x!r} AS DOUBLE)"
    whens = []
    for which, rates in enumerate(SCHEDULES):
        step = 1.0 / (len(rates) - 1)
        area = sum((a + b) * step / 2 for a, b in zip(rates, rates[1:], strict=False))
        time = ""
        for k in reversed(range(len(rates) - 1)):
            a, b = rates[k] / area, rates[k + 1] / area
            done = sum((x + y) * step / 2 / area for x, y in zip(rates[:k], rates[1 : k + 1], strict=True))
            rest = f"greatest({share} - {number(float(done))}, {number(0.0)})"
            root = f"sqrt(greatest({number(a * a)} + {number(2 * (b - a) / step)} * {rest}, {number(0.0)}))"
            here = f"({number(k * step)} + CASE WHEN {rest} > 0 THEN {number(2.0)} * {rest} / ({number(a)} + {root}) ELSE {number(0.0)} END)"
            time = here if not time else f"CASE WHEN {share} < {number(done + (a + b) * step / 2)} THEN {here} ELSE {time} END"
        whens.append(f"WHEN {which} THEN least({time}, {number(1.0)})")
    return f"CASE {place} % {len(SCHEDULES)} {' '.join(whens)} END"


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
                  md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':17') AS k FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM s),
v AS (SELECT *, CAST(place % 3 + 1 AS BIGINT) AS w FROM r),
f AS (SELECT *, CAST(3 * source_size AS DOUBLE) / w AS full_at, sum(source_size) OVER () AS total, sum(w) OVER () AS tw FROM v),
g AS (SELECT *, coalesce(sum(3 * source_size) OVER o, 0) AS gone, coalesce(sum(w) OVER o, 0) AS gw FROM f
      WINDOW o AS (ORDER BY full_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
h AS (SELECT *, CAST(total - gone AS DOUBLE) / CAST(tw - gw AS DOUBLE) AS lv FROM g),
i AS (SELECT *, max(CASE WHEN lv <= full_at THEN lv END) OVER () AS level FROM h),
t AS (SELECT source, source_size, place, least(CAST(3 * source_size AS DOUBLE), level * w) AS target FROM i),
c AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.place, CAST(floor(t.target + 0.5) AS BIGINT) AS demand,
             CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN source_size > 0 THEN demand // source_size ELSE 0 END * size
            + greatest(0, least(size, demand - CASE WHEN source_size > 0 THEN demand // source_size ELSE 0 END * source_size - start)) AS BIGINT) AS taken,
       place, CAST(start AS DOUBLE) / CAST(greatest(demand, 1) AS DOUBLE) AS share,
       (CASE WHEN source_size > 0 THEN demand // source_size ELSE 0 END) > 0
       OR (demand - start > 0 AND size > 0) OR (demand - start > 0 AND 2 * (demand - start) >= size) AS copied
FROM c)
SELECT doc_id, size, source_size, target, taken, CASE WHEN copied THEN @POSITION@ END AS position FROM e
""".replace("@POSITION@", _position_sql("share", "place"))
