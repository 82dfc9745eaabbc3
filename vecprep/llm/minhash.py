"""Near-duplicate documents by b-bit MinHash, confirmed on full shingle sets.

Sets. A document's set are its distinct 5-word shingles (fewer words: the whole sequence), as 64-bit hashes. Documents
with equal sets form a class, known by a 128-bit digest; its least doc_id stands for it, so copies are never paired.

Signatures. ``PERMUTATIONS`` minima of the set; the first ``BANDS`` times ``ROWS`` of them make the band keys; of all
minima only the low ``BITS`` bits are kept, packed. Two documents that share a band key are candidates; the share E of equal b-bit
values estimates the similarity as (E - C) / (1 - C), C = 2**-BITS, from counts of differing bits. A pair goes on if the
estimate isn't more than ``SLACK`` standard errors below the threshold, ``percent`` of the union in common.

A pair at the threshold 0.85 fails to share any of the 25 bands with probability 1e-8 (at 0.80: 2e-6), and to pass an
estimate with 1e-7.

Verification in two rounds, so that a group of thousands of near copies costs a link a document, not all pairs:
1. in each band bucket every document is compared with one centre, the member with the least share of shingles that no
   other candidate has (of differently edited copies the least edited one); the most similar centre of each document is
   confirmed on full sets, and confirmed links give first components;
2. in buckets that still hold several components every pair across components that passes the estimate, a bound and an
   estimate from ``FINE`` further minima (made for these documents only) is confirmed, once, by the first band that both
   share. The bound: two sets have at most as much in common as either
   shares with any other candidate, so a pair is refuted if (100 + percent) * min(shared) < percent * (both sizes). That spares most
   pairs of differently edited copies, whose number would grow with the square of a group.
Every candidate pair is thereby confirmed, refuted or already in one component; none is dropped.

Full sets are made again for candidates only, found in the texts by a Bloom filter of fixed size; texts are not shuffled.

Null and empty texts have an empty set and are linked with nothing. A null document id is linked with nothing (null
component, not kept). Rows with one doc_id count as one document, which has the links of all its texts. An empty table
gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bloom import bloom_of, without
from .components import connected_components
from .storage import drop, materialise, partitions_for
from .text import byte_runs, mix, words

SHINGLE = 5
BANDS, ROWS, BITS = 25, 4, 2
PERMUTATIONS = 2 * BANDS * ROWS
#: 100 * intersection >= percent * union links two documents; this is the percent unless another is given.
PERCENT = 85
SLACK = 5.2
BLOCK_BYTES = 4 << 20
#: Shingles whose second signatures are made together.
FINE_MEMBERS = 1 << 18
#: Rows of a band bucket that one task compares at most.
BUCKET_ROWS = 50_000
_RNG = np.random.Generator(np.random.PCG64(8128))
_XOR = _RNG.integers(0, 2**32, PERMUTATIONS, dtype=np.uint32)
_MUL = _RNG.integers(0, 2**31, PERMUTATIONS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_BAND = _RNG.integers(1, 2**63, BANDS, dtype=np.uint64)
SIGNATURE_BYTES = -(-PERMUTATIONS * BITS // 64) * 8
#: Minima of the second estimate.
FINE = 1024
_FINE_XOR = _RNG.integers(0, 2**32, FINE, dtype=np.uint32)
_FINE_MUL = _RNG.integers(0, 2**31, FINE, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, and where each text's begin (n + 1)."""
    hashes, at = words(texts)
    n = len(hashes)
    rolled = np.zeros(n, np.uint64)
    step = np.uint64(0xC2B2AE3D27D4EB4F)
    for k in range(SHINGLE):
        rolled[: n - k] = rolled[: n - k] * step + hashes[k:] if n > k else 0
    sets, sizes = [], np.zeros(len(at) - 1, np.int64)
    for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
        if b - a >= SHINGLE:
            own = np.unique(mix(rolled[a : b - SHINGLE + 1]))
        elif b > a:
            whole = b - a
            for h in hashes[a:b].tolist():
                whole = (whole * 0x9FB21C651E98DF25 + h) % 2**64
            own = mix(np.array([whole], np.uint64))
        else:
            continue
        sets.append(own)
        sizes[i] = len(own)
    return np.concatenate(sets) if sets else np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum(sizes)])


def digests(sets: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two sums of mixed members: equal sets have equal digests."""
    if not len(sets):
        return np.zeros(len(at) - 1, np.int64), np.zeros(len(at) - 1, np.int64)
    out = []
    for salt in (0x243F6A8885A308D3, 0x13198A2E03707344):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(sets ^ np.uint64(salt)))])
        out.append((sums[at[1:]] - sums[at[:-1]]).view(np.int64))
    return out[0], out[1]


def signatures(sets: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band keys (documents x BANDS) and packed low bits (documents x SIGNATURE_BYTES); zeros for an empty set."""
    n = len(at) - 1
    minima = _minima(sets, at, _XOR, _MUL)
    keys = np.empty((n, BANDS), np.int64)
    for j in range(BANDS):
        key = np.full(n, _BAND[j], np.uint64)
        for row in minima[j * ROWS : (j + 1) * ROWS]:
            key = mix(key + row)
        keys[:, j] = key.view(np.int64)
    return keys, _packed(minima, SIGNATURE_BYTES)


def _minima(sets: np.ndarray, at: np.ndarray, xor: np.ndarray, mul: np.ndarray) -> np.ndarray:
    """Permutations x documents; zeros for an empty set."""
    full = np.flatnonzero(at[1:] > at[:-1])
    minima = np.zeros((len(xor), len(at) - 1), np.uint32)
    if len(full):
        x = (sets >> np.uint64(32)).astype(np.uint32)
        starts = at[:-1][full]
        for k in range(len(xor)):
            minima[k, full] = np.minimum.reduceat((x ^ xor[k]) * mul[k], starts)
    return minima


def _packed(minima: np.ndarray, size: int) -> np.ndarray:
    """The low bits of minima, ``size`` bytes a document."""
    # The multiplier is odd, so the low bits of a product depend on the low bits of x alone: take the high ones mixed down.
    low = (minima * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
    n = minima.shape[1]
    bits = ((low.T[:, :, None] >> np.arange(BITS, dtype=np.uint32)) & np.uint32(1)).astype(np.uint8).reshape(n, -1)
    packed = np.zeros((n, size), np.uint8)
    packed[:, : -(-bits.shape[1] // 8)] = np.packbits(bits, axis=1, bitorder="little")
    return packed


_EVEN = np.uint64(int("01" * 32, 2))


def similarity(a: np.ndarray, b: np.ndarray, minima: int = PERMUTATIONS) -> np.ndarray:
    """Collision-corrected estimate from packed signatures (last axis: 64-bit words)."""
    differ = a ^ b
    differ = (differ | (differ >> np.uint64(1))) & _EVEN
    equal = 1 - np.bitwise_count(differ).sum(axis=-1) / minima
    chance = 2.0**-BITS
    return (equal - chance) / (1 - chance)


def least_estimate(percent: int, minima: int = PERMUTATIONS) -> float:
    chance = 2.0**-BITS
    equal = chance + (1 - chance) * percent / 100
    return percent / 100 - SLACK * (equal * (1 - equal) / minima) ** 0.5 / (1 - chance)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j in byte_runs(batch.column(1), BLOCK_BYTES):
            sets, at = shingle_sets(batch.column(1).slice(i, j - i))
            d1, d2 = digests(sets, at)
            keys, packed = signatures(sets, at)
            yield pa.record_batch(
                [batch.column(0).slice(i, j - i), pa.array(np.diff(at)), pa.array(d1), pa.array(d2), pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel()), BANDS).cast(pa.list_(pa.int64())), pa.array([r.tobytes() for r in packed], pa.binary())],
                ["doc_id", "n_shingles", "d1", "d2", "bands", "signature"],
            )


def _fine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Second signatures from rows (doc_id, members)."""
    for batch in batches:
        sizes = np.asarray(batch.column(1).value_lengths())
        edges = np.flatnonzero(np.diff(np.cumsum(sizes) // FINE_MEMBERS, prepend=-1))
        for i, j in zip(edges, np.append(edges[1:], len(batch)), strict=True):
            part = batch.slice(i, j - i)
            packed = _packed(_minima(part.column(1).flatten().to_numpy().view(np.uint64), np.concatenate([[0], np.cumsum(sizes[i:j])]), _FINE_XOR, _FINE_MUL), FINE * BITS // 8)
            yield pa.record_batch([part.column(0), pa.array([r.tobytes() for r in packed], pa.binary())], ["doc_id", "fine"])


def _words64(column: pa.Array, size: int = SIGNATURE_BYTES) -> np.ndarray:
    if not len(column):
        return np.zeros((0, size // 8), np.uint64)
    return np.frombuffer(b"".join(x.as_buffer().to_pybytes() for x in column), np.uint64).reshape(len(column), -1)


def _estimated(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Rows (rep, centre, signature, centre's signature): those whose estimate reaches ``least``, with it."""
    for b in batches:
        estimate = similarity(_words64(b.column(2)), _words64(b.column(3)))
        near = pa.array(estimate >= least)
        yield pa.record_batch([b.column(0).filter(near), b.column(1).filter(near), pa.array(estimate).filter(near)], ["rep", "centre", "estimate"])


def _across(batches: Iterator[pa.RecordBatch], percent: int = PERCENT) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key: candidate pairs of different components, bucket by bucket, in blocks of rows."""
    least, least_fine = least_estimate(percent), least_estimate(percent, FINE)

    def pairs(rep: np.ndarray, sig: np.ndarray, component: np.ndarray, size: np.ndarray, shared: np.ndarray, own: np.ndarray, bands: np.ndarray, fine: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.argsort(component, kind="stable")
        rep, sig, component, size, shared, own, bands, fine = (x[order] for x in (rep, sig, component, size, shared, own, bands, fine))
        after = np.searchsorted(component, component, "right")
        for i in range(0, len(rep), 64):
            for j in range(int(after[i]), len(rep), 4096):
                rows, columns = slice(i, i + 64), slice(j, j + 4096)
                both = size[rows, None] + size[None, columns]
                bound = (100 + percent) * np.minimum(shared[rows, None], shared[None, columns]) >= percent * both
                x, y = np.nonzero(bound & (component[rows, None] < component[None, columns]))
                x, y = i + x, j + y
                near = similarity(sig[x], sig[y]) >= least
                x, y = x[near], y[near]
                near = similarity(fine[x], fine[y], FINE) >= least_fine
                x, y = x[near], y[near]
                meet = np.argmax(bands[x] == bands[y], axis=1)
                here = bands[x, meet] == own[x]
                a, c = rep[x[here]], rep[y[here]]
                if len(a):
                    yield pa.record_batch([pa.array(np.minimum(a, c)), pa.array(np.maximum(a, c))], ["a", "b"])

    held: list[tuple[np.ndarray, ...]] = []
    for b in batches:
        if not len(b):
            continue
        key, rep, component, size, shared, own = (b.column(k).to_numpy() for k in ("meeting", "rep", "component", "size", "shared", "key"))
        bands = b.column("bands").flatten().to_numpy().reshape(-1, BANDS)
        sig, fine = _words64(b.column("signature")), _words64(b.column("fine"), FINE * BITS // 8)
        cuts = np.flatnonzero(np.concatenate([[not held or held[-1][0][-1] != key[0]], key[1:] != key[:-1]]))
        for a, c in zip(np.append([0], cuts), np.append(cuts, len(key)), strict=True):
            if a in cuts and held:
                yield from pairs(*(np.concatenate(x) for x in list(zip(*held, strict=True))[1:]))
                held = []
            if c > a:
                held.append(tuple(x[a:c] for x in (key, rep, sig, component, size, shared, own, bands, fine)))
    if held:
        yield from pairs(*(np.concatenate(x) for x in list(zip(*held, strict=True))[1:]))


def _sets(batches: Iterator[pa.RecordBatch], wanted) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        batch = batch.filter(wanted.value.mask(batch.column(0)))
        for i, j in byte_runs(batch.column(1), BLOCK_BYTES):
            sets, at = shingle_sets(batch.column(1).slice(i, j - i))
            yield pa.record_batch([batch.column(0).slice(i, j - i), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(sets.view(np.int64)))], ["doc_id", "members"])


def _confirm(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        good = np.zeros(len(b), bool)
        for k, (x, y) in enumerate(zip(b.column(2), b.column(3), strict=True)):
            x, y = x.values.to_numpy().view(np.uint64), y.values.to_numpy().view(np.uint64)
            if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                both = int(np.count_nonzero(y[at] == x))
                good[k] = 100 * both >= percent * (len(x) + len(y) - both)
        yield pa.record_batch([b.column(0).filter(pa.array(good)), b.column(1).filter(pa.array(good))], ["a", "b"])


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    first = sets.select(F.col("doc_id").alias("a"), F.col("members").alias("x"))
    second = sets.select(F.col("doc_id").alias("b"), F.col("members").alias("y"))
    return pairs.join(first, "a").join(second, "b").select("a", "b", "x", "y").mapInArrow(partial(_confirm, percent=percent), "a long, b long")


def near_duplicates(docs: DataFrame, *, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable by links) and kept (doc_id = component_id) per row.

    Documents with at least ``percent`` of the union of their sets in common are linked.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    buckets = partitions_for(docs)
    signed = materialise(rows.mapInArrow(_sign, "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>, signature binary"), "minhash")
    linkable = signed.filter((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    classes = linkable.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("signature").alias("signature"))
    classes = materialise(classes, "minhash-classes")

    # Counts and centres of band keys are summed up before they are shuffled and written before they are joined, so that a
    # key of very many documents can be split over tasks.
    keyed = classes.select(F.explode("bands").alias("key"), "rep")
    met = materialise(keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("key").alias("k")), "minhash-keys")
    members = materialise(keyed.join(met, F.col("key") == F.col("k")).select("key", "rep"), "minhash-members")
    drop(met)
    wanted = members.select(F.col("rep").alias("doc_id")).distinct()
    bloom = docs.sparkSession.sparkContext.broadcast(bloom_of(wanted))
    sets = rows.mapInArrow(partial(_sets, wanted=bloom), "doc_id long, members array<long>")
    sets = materialise(sets.filter(F.size("members") > 0).distinct(), "minhash-sets")
    # How many of its shingles a document shares with any other candidate: all but those that occur in it alone.
    alone = sets.select("doc_id", F.explode("members").alias("shingle")).groupBy("shingle").agg(F.count("*").alias("n"), F.min("doc_id").alias("doc_id"))
    alone = alone.filter("n = 1").groupBy("doc_id").agg(F.count("*").alias("alone"))
    sizes = sets.groupBy("doc_id").agg(F.max(F.size("members")).cast("long").alias("most"), F.min(F.size("members")).cast("long").alias("size"), F.count("*").alias("texts"))
    sizes = sizes.join(alone, "doc_id", "left").select(F.col("doc_id").alias("sized"), "size", (F.col("most") - F.when(F.col("texts") == 1, F.coalesce("alone", F.lit(0))).otherwise(0)).alias("shared"))
    sizes = materialise(sizes.filter(100 * F.col("shared") >= percent * F.col("size")), "minhash-sizes")

    able = materialise(members.join(sizes, F.col("rep") == F.col("sized")).select("key", "rep", "size", "shared"), "minhash-able")
    drop(members)
    first_of = F.min(F.struct((1 - F.col("shared") / F.col("size")).alias("private"), "rep"))
    centres = able.groupBy("key").agg(first_of.alias("first"), F.count("*").alias("n")).filter("n > 1").select(F.col("key").alias("k"), F.col("first.rep").alias("centre"))
    centres = materialise(centres, "minhash-centres")
    meets = able.join(centres, F.col("key") == F.col("k")).filter(F.col("rep") != F.col("centre")).select("rep", "centre").distinct()
    signature = lambda of, name: classes.select(F.col("rep").alias(of), F.col("signature").alias(name))
    meets = meets.join(signature("one", "x"), F.col("rep") == F.col("one")).join(signature("other", "y"), F.col("centre") == F.col("other"))
    near = meets.select("rep", "centre", "x", "y").mapInArrow(partial(_estimated, least=least_estimate(percent)), "rep long, centre long, estimate double")
    best = near.groupBy("rep").agg(F.max(F.struct("estimate", "centre")).alias("best"))
    best = best.select(F.least("rep", "best.centre").alias("a"), F.greatest("rep", "best.centre").alias("b")).distinct()
    best = materialise(best, "minhash-best")
    links = materialise(_confirmed(best, sets, percent), "minhash-links")
    drop(centres)
    first = connected_components(links)

    placed = able.join(first, F.col("rep") == F.col("node"), "left")
    placed = placed.select("key", "rep", F.coalesce("component", "rep").alias("component"), "size", "shared")
    placed = materialise(placed, "minhash-placed")
    several = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n")).filter("lo < hi")
    several = materialise(several.select(F.col("key").alias("k"), "n"), "minhash-several")  # a join of two tables can split a key
    open_ = materialise(placed.join(several, F.col("key") == F.col("k")), "minhash-open")
    drop(placed)
    asked = open_.select(F.col("rep").alias("asked")).distinct()
    fine = sets.join(asked, F.col("doc_id") == F.col("asked"), "left_semi").mapInArrow(_fine, "doc_id long, fine binary")
    # Of a document with several texts every fine signature counts, with every one of its other columns.
    detail = classes.select(F.col("rep").alias("r"), "bands", "signature").join(fine, F.col("r") == F.col("doc_id")).drop("doc_id")
    detail = materialise(detail, "minhash-fine")
    # A bucket of more than BUCKET_ROWS is cut into chunks, and every two of them meet in a task.
    chunks = F.ceil(F.col("n") / BUCKET_ROWS)
    chunk = F.pmod(F.xxhash64("rep"), chunks)
    meeting = F.explode(F.transform(F.sequence(F.lit(0).cast("long"), chunks - 1), lambda j: F.xxhash64("key", F.least(chunk, j), F.greatest(chunk, j))))
    open_ = open_.select(meeting.alias("meeting"), "rep", "component", "size", "shared", "key")
    open_ = open_.join(detail, F.col("rep") == F.col("r")).drop("r").repartition(buckets, "meeting").sortWithinPartitions("meeting")
    pairs = open_.mapInArrow(partial(_across, percent=percent), "a long, b long").distinct().join(best, ["a", "b"], "left_anti")
    more = materialise(_confirmed(pairs, sets, percent), "minhash-links")
    for done in (able, best, sets, sizes, several, open_, detail):
        drop(done)
    # Classes that share a document id are tied by it: the id is a node.
    texts = linkable.groupBy(F.col("doc_id").alias("id")).agg(F.min(F.struct("d1", "d2")).alias("lo"), F.max(F.struct("d1", "d2")).alias("hi")).filter("lo != hi")
    ties = linkable.join(texts, F.col("doc_id") == F.col("id")).select("doc_id", "d1", "d2").join(classes.select("d1", "d2", "rep"), ["d1", "d2"])
    ties = ties.select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    final = connected_components(links.unionByName(more).unionByName(ties))
    drop(links)
    drop(more)

    named = classes.join(final, classes["rep"] == final["node"], "left").select("d1", "d2", F.coalesce("component", "rep").alias("component"))
    per_row = linkable.select("doc_id", "n_shingles", "d1", "d2").join(named, ["d1", "d2"]).select("doc_id", "n_shingles", "component")
    alone = signed.filter((F.col("n_shingles") == 0) | F.col("doc_id").isNull()).select("doc_id", "n_shingles", F.col("doc_id").alias("component"))
    out = per_row.unionByName(alone)
    return out.select("doc_id", "n_shingles", F.col("component").alias("component_id"), F.coalesce(F.col("doc_id") == F.col("component"), F.lit(False)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, *, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the rows whose document isn't the least of its component; copies of a row stay one row."""
    found = near_duplicates(docs, percent=percent, doc_id=doc_id, text=text)
    gone = found.filter(~F.col("kept") & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("_gone")).distinct()
    return without(docs, doc_id, gone)
