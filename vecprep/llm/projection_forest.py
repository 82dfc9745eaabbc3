"""Near-duplicate vectors by a forest of random-projection trees with spill.

Trees. A tree splits the unit vectors level by level by random directions with standard normal components, at the median
of the projections in each node; vectors within ``MARGIN`` of it go to both sides. The margin is a distance, not a
share: the projections of two vectors of cosine 0.9 differ by a normal variable of deviation 0.45 in any dimension. A
direction in which over half of a node lies within ``DENSE`` of the median would cut through a cluster whose members are
linked for the most part; it is passed over for the next, and a node that ``TRIES`` directions don't divide is left whole.
Splitting goes on until a leaf holds about ``LEAF`` vectors of the table. Medians are taken from a bounded sample (``SAMPLE``
vectors and ``SAMPLE_BYTES`` at most, by a hash of the id). Where fewer than ``LEAST_POINTS`` of it are left in a node,
the levels below use that node's points, so what is broadcast stays bounded however deep a table's size makes the trees.

A level parts two vectors at the threshold with a probability that follows from ``MARGIN``. There are as many trees as it
takes for such a pair to share a leaf with probability ``RECALL`` if vectors lie evenly in all directions (``TREES`` at
least); nearer pairs and clustered vectors are safer.

Links. Every vector knows its leaves in all trees. Within a leaf all pairs are compared, in blocks: by single precision,
and by cosine in double precision wherever that could matter; pairs of at least ``COSINE`` are links. A pair that meets
in several leaves counts in the first of them only, so a leaf returns a row per vector (how many it is linked with, and
one vector it is connected with there) and never a row per link. A leaf of more than ``TASK_ROWS`` vectors or
``TASK_BYTES`` (a dense cluster) is cut into chunks, every two of which meet in a task. Equal vectors are one class
first, told by two 64-bit hashes, whatever their number. Components are taken over classes; n_links adds up class sizes.

Null vectors, zero vectors and those with null or non-finite components are linked with nothing, and so are vectors of
different lengths with each other. A null vec_id is linked with nothing, has a null component and isn't kept. Rows that
repeat a vec_id count as further vectors of its class. An empty table gives an empty result. Other columns, whatever
their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .storage import drop, materialise
from .text import give_memory_back, mix

COSINE = 0.9
TREES = 8
LEAF = 768
MARGIN = 0.15
DENSE = 0.25
RECALL = 0.999
TRIES = 4
SAMPLE = 50_000
SAMPLE_BYTES = 64 << 20
LEAST_POINTS = 16
TASK_ROWS = 40_000
TASK_BYTES = 32 << 20
SEED = 77
FOUND = "rep long, linked long, with long"


def usable(v: Column) -> Column:
    """Whether every component is a finite number and one isn't zero."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & F.forall(v, finite) & F.exists(v, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows, in double precision."""
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def unit(x: np.ndarray) -> np.ndarray:
    scale = np.abs(x).max(axis=1, keepdims=True) if x.size else 1.0
    x = x / scale
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def loss(margin: float, cosine: float = COSINE) -> float:
    """The probability that a level of a tree parts two vectors of this cosine."""
    a = np.linspace(-8, -margin, 4001)
    from math import erf

    beyond = np.array([0.5 - 0.5 * erf((margin - cosine * x) / np.sqrt(2 * (1 - cosine**2))) for x in a])
    return float(2 * np.trapezoid(np.exp(-a * a / 2) / np.sqrt(2 * np.pi) * beyond, a))


@dataclass
class Tree:
    """Nodes k with the children 2k + 1 and 2k + 2: which direction divides them, and where. ``further``: the levels
    below a leaf of the sample, alike for all nodes there."""

    directions: np.ndarray
    nodes: dict[int, tuple[int, float]] = field(default_factory=dict)
    further: dict[int, list[tuple[int, float]]] = field(default_factory=dict)
    depth: float = 0.0

    @classmethod
    def fitted(cls, sample: np.ndarray, total: float, seed: int, leaf: int) -> Tree:
        """``total``: how many vectors the sample stands for."""
        rng, most = np.random.Generator(np.random.PCG64(seed)), 64
        directions = rng.standard_normal((most, sample.shape[1]))
        tree, each, place, levels, used = cls(directions), total / max(len(sample), 1), np.zeros((len(sample), 0)), 0.0, 0

        def divided(rows: np.ndarray, first: int) -> tuple[int, float, np.ndarray, np.ndarray] | None:
            nonlocal place
            for j in range(first, min(first + TRIES, most)):
                if j >= place.shape[1]:
                    place = np.column_stack([place, sample @ directions[j]])
                p = place[rows, j]
                middle = float(np.median(p))
                if 2 * np.count_nonzero(np.abs(p - middle) <= DENSE) <= len(rows):
                    return j, middle, rows[p <= middle + MARGIN], rows[p >= middle - MARGIN]
            return None

        todo = [(0, np.arange(len(sample)), 0, 0)]
        while todo:
            k, rows, first, level = todo.pop()
            estimate = len(rows) * each
            if len(rows) >= LEAST_POINTS and estimate > leaf and (parts := divided(rows, first)) is not None and (each == 1 or min(len(parts[2]), len(parts[3])) >= LEAST_POINTS):
                j, middle, left, right = parts
                tree.nodes[k] = (j, middle)
                used = max(used, j + 1)
                todo += [(2 * k + 1, left, j + 1, level + 1), (2 * k + 2, right, j + 1, level + 1)]
                continue
            steps: list[tuple[int, float]] = []
            while estimate > leaf and each > 1 and len(rows) and level + len(steps) < 60 and (parts := divided(rows, first)) is not None:
                j, middle, left, right = parts
                steps.append((j, middle))
                used, first = max(used, j + 1), j + 1
                estimate *= max(len(left), len(right)) / len(rows)
            if steps:
                tree.further[k] = steps
            levels += (level + len(steps)) * len(rows)
            tree.depth += len(rows)
        tree.depth = levels / max(tree.depth, 1)
        tree.directions = directions[:used]
        return tree

    def leaves(self, x: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        place = x @ self.directions.T if len(self.directions) else np.zeros((len(x), 0))
        todo: list[tuple[int, np.ndarray, list[tuple[int, float]] | None]] = [(0, np.arange(len(x)), None)]
        while todo:
            k, rows, steps = todo.pop()
            if not len(rows):
                continue
            if steps is None and k in self.nodes:
                (j, middle), rest = self.nodes[k], None
            else:
                steps = self.further.get(k, []) if steps is None else steps
                if not steps:
                    yield k, rows
                    continue
                (j, middle), rest = steps[0], steps[1:]
            p = place[rows, j]
            todo += [(2 * k + 1, rows[p <= middle + MARGIN], rest), (2 * k + 2, rows[p >= middle - MARGIN], rest)]


def _code(tree: int, leaf: int) -> int:
    """What a leaf is known by: 64 bits of its tree and number."""
    return int(mix(mix(np.array([leaf], np.uint64)) + np.uint64(tree)).view(np.int64)[0])


def _memberships(x: np.ndarray, trees: list[Tree]) -> tuple[np.ndarray, np.ndarray]:
    """Rows and the codes of the leaves they reach, sorted by row and code."""
    rows, codes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for t, tree in enumerate(trees):
        for leaf, reached in tree.leaves(x):
            rows.append(reached)
            codes.append(np.full(len(reached), _code(t, leaf)))
    row, code = np.concatenate(rows), np.concatenate(codes)
    order = np.lexsort((code, row))
    return row[order], code[order]


def _leaves(batches: Iterator[pa.RecordBatch], forest: dict[int, list[Tree]]) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Length, the rows (rep, size, vector) of it, and their memberships; a length without trees has one leaf."""
    for batch in batches:
        length = np.asarray(batch.column(2).value_lengths())
        for dim in np.unique(length):
            part = batch.filter(pa.array(length == dim))
            trees = forest.get(int(dim))
            if trees is None:
                yield int(dim), part, np.arange(len(part)), np.zeros(len(part), np.int64)
            else:
                yield int(dim), part, *_memberships(unit(matrix(part.column(2))), trees)


def task_rows(dim: int) -> int:
    return max(1, min(TASK_ROWS, TASK_BYTES // (8 * max(dim, 1))))


def _count(forest) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, _, _, code in _leaves(batches, forest.value):
            unique, n = np.unique(code, return_counts=True)
            yield pa.record_batch([pa.array(np.full(len(unique), dim), pa.int32()), pa.array(unique), pa.array(n)], ["dim", "leaf", "n"])

    return run


def _route(forest, kind: str) -> Callable:
    """A row (dim, leaf, before, rep, size, vector) for each leaf that a vector reaches; before: its leaves of lesser code."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, part, row, code in _leaves(batches, forest.value):
            first = np.flatnonzero(np.diff(row, prepend=-1))
            earlier = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row))))
            for a in range(0, len(row), 4096):
                at = slice(a, a + 4096)
                n = earlier[at]
                ends = np.concatenate([[0], np.cumsum(n)])
                before = code[np.arange(ends[-1]) - np.repeat(ends[:-1], n) + np.repeat(np.arange(len(row))[at] - n, n)]
                taken = part.take(pa.array(row[at]))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(before, pa.int64()))
                yield pa.record_batch([pa.array(np.full(len(n), dim), pa.int32()), pa.array(code[at]), lists, *taken.columns], ["dim", "leaf", "before", "rep", "size", "vector"])

    return run


class Leaf:
    """Vectors that meet: all of them with each other, or the first ``split`` with the others."""

    def __init__(self, rep: np.ndarray, size: np.ndarray, x: np.ndarray, before: pa.ListArray, split: int | None):
        self.rep, self.size, self.x, self.split = rep, size, x, split
        self.single = x.astype(np.float32)
        self.linked, self.label = np.zeros(len(rep), np.int64), np.arange(len(rep))
        self.bits = self._shared(before)

    @staticmethod
    def _shared(before: pa.ListArray) -> np.ndarray:
        """A bit for each earlier leaf that several of the vectors reach."""
        row = np.repeat(np.arange(len(before)), np.asarray(before.value_lengths()))
        unique, inverse, n = np.unique(before.flatten().to_numpy(), return_inverse=True, return_counts=True)
        number = np.cumsum(n > 1) - 1
        kept = (n > 1)[inverse]
        row, bit = row[kept], number[inverse[kept]]
        out = np.zeros((len(before), -(-int((n > 1).sum()) // 64)), np.uint64)
        np.bitwise_or.at(out, (row, bit >> 6), np.uint64(1) << (bit & 63).astype(np.uint64))
        return out

    def _join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.label[a], self.label[b]
            apart = x != y
            if not apart.any():
                return
            np.minimum.at(self.label, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
            while (jumped := self.label[self.label]).tobytes() != self.label.tobytes():
                self.label = jumped

    def compare(self) -> None:
        n, tolerance = len(self.rep), (self.x.shape[1] + 8) * 2.0**-22
        rows, columns = (n, 0) if self.split is None else (self.split, self.split)
        for i in range(0, rows, 256):
            for j in range(max(columns, i if self.split is None else 0), n, 2048):
                p = self.single[i : min(i + 256, rows)] @ self.single[j : j + 2048].T
                a, b = np.nonzero(p >= COSINE - tolerance)
                near = p[a, b]
                a, b = a + i, b + j
                if self.split is None:
                    a, b, near = a[a < b], b[a < b], near[a < b]
                unsure = np.flatnonzero(near < COSINE + tolerance)
                if len(unsure):
                    wrong = unsure[np.einsum("ij,ij->i", self.x[a[unsure]], self.x[b[unsure]]) < COSINE]
                    a, b = np.delete(a, wrong), np.delete(b, wrong)
                if not len(a):
                    continue
                self._join(a, b)
                for k in range(self.bits.shape[1]):  # pairs that met in an earlier leaf are counted there
                    new = (self.bits[a, k] & self.bits[b, k]) == 0
                    a, b = a[new], b[new]
                self.linked += np.bincount(a, self.size[b], n).astype(np.int64) + np.bincount(b, self.size[a], n).astype(np.int64)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    group = pa.Table.from_batches(batches).combine_chunks()
    rep = group["rep"].to_numpy()
    low, high = divmod(group["meeting"][0].as_py(), chunks := group["chunks"][0].as_py())
    own = _chunk(rep, chunks)
    order = np.lexsort((rep, own != low))
    one = lambda c: group[c].combine_chunks() if isinstance(group[c].combine_chunks(), pa.Array) else group[c].chunk(0)
    vectors, before = (one(c).take(pa.array(order)) for c in ("vector", "before"))
    leaf = Leaf(rep[order], group["size"].to_numpy()[order], unit(matrix(vectors)), before, None if low == high else int((own == low).sum()))
    leaf.compare()
    told = np.flatnonzero((leaf.linked > 0) | (leaf.label != np.arange(len(rep))))
    yield pa.record_batch([pa.array(leaf.rep[told]), pa.array(leaf.linked[told]), pa.array(leaf.rep[leaf.label[told]])], ["rep", "linked", "with"])
    give_memory_back()


def _chunk(rep: np.ndarray, chunks: int) -> np.ndarray:
    return (mix(rep.astype(np.int64).view(np.uint64)) % np.uint64(chunks)).astype(np.int64)


def _forest(classes: DataFrame) -> dict[int, list[Tree]]:
    """Trees by vector length, fitted on a bounded sample; a length that the sample lacks has none."""
    total, longest = classes.agg(F.count("*"), F.max(F.size("vector"))).collect()[0]
    share = min(1.0, min(SAMPLE, SAMPLE_BYTES // (8 * (longest or 1))) / max(total, 1))
    chosen = F.pmod(F.xxhash64("rep", F.lit(SEED)), F.lit(1 << 40)) < F.lit(int(share * (1 << 40)))
    sample = classes.filter(chosen).select("rep", "vector").toArrow().sort_by("rep")["vector"].combine_chunks()
    sample = sample if isinstance(sample, pa.Array) else sample.chunk(0) if sample.num_chunks else pa.array([], sample.type)
    length, out, parted = np.asarray(sample.value_lengths()), {}, loss(MARGIN)
    for dim in np.unique(length).tolist():
        x = unit(matrix(sample.filter(pa.array(length == dim))))
        trees = [Tree.fitted(x, len(x) / share, SEED * 1000, LEAF)]
        met = (1 - parted) ** trees[0].depth
        needed = 1 if met > RECALL else int(np.ceil(np.log(1 - RECALL) / np.log(1 - met)))
        out[dim] = trees + [Tree.fitted(x, len(x) / share, SEED * 1000 + t, LEAF) for t in range(1, max(needed, TREES if trees[0].nodes or trees[0].further else 1))]
    return out


def near_vectors(vectors: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (vec_id, key_1, key_2; null if linked with nothing), classes (key_1, key_2, rep, size), and what the leaves
    found (rep, linked, with): numbers of links to other classes, to be added up, and connections between classes."""
    kind = vectors.schema[embedding].dataType.simpleString()
    kind = kind if kind == "array<float>" else "array<double>"  # compared in double precision either way
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast(kind).alias("vector"))
    good = usable(F.col("vector")) & F.col("vec_id").isNotNull()
    rows = rows.select("*", F.when(good, F.xxhash64("vector")).alias("key_1"), F.when(good, F.xxhash64(F.lit(SEED), "vector")).alias("key_2"))
    classes = rows.filter("key_1 IS NOT NULL").groupBy("key_1", "key_2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("size"), F.first("vector").alias("vector"))
    classes = materialise(classes, "forest-classes")
    forest, each = vectors.sparkSession.sparkContext.broadcast(_forest(classes)), classes.select("rep", "size", "vector")
    counted = each.mapInArrow(_count(forest), "dim int, leaf long, n long").groupBy("dim", "leaf").agg(F.sum("n").alias("n"))
    limit = F.least(F.lit(TASK_ROWS), F.greatest(F.floor(F.lit(TASK_BYTES) / (8 * F.col("dim"))), F.lit(1)))
    large = materialise(counted.filter(F.col("n") > limit).select(F.col("dim").alias("d"), F.col("leaf").alias("l"), F.ceil(F.col("n") / limit).alias("c")), "forest-large")
    routed = each.mapInArrow(_route(forest, kind), f"dim int, leaf long, before array<long>, rep long, size long, vector {kind}")
    if (n := large.count()) == 0:
        met = routed.select("*", F.lit(1).cast("long").alias("chunks"), F.lit(0).cast("long").alias("meeting"))
    else:  # chunk numbers are a function of the id, so that a task knows them again
        cut = routed.join(F.broadcast(large) if n <= 100_000 else large, (F.col("dim") == F.col("d")) & (F.col("leaf") == F.col("l")), "left")
        cut = cut.select(*routed.columns, F.coalesce("c", F.lit(1)).cast("long").alias("chunks"))
        met = cut.mapInArrow(_meet, f"{routed._jdf.schema().toDDL()}, chunks long, meeting long")
    found = met.groupBy("dim", "leaf", "meeting").applyInArrow(_compare, FOUND)
    found = materialise(found, "forest-found")
    drop(large)
    return rows.select("vec_id", "key_1", "key_2"), classes.select("key_1", "key_2", "rep", "size"), found


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row once for every chunk of its leaf that its own chunk meets."""
    for batch in batches:
        chunks = batch["chunks"].to_numpy()
        for n in np.unique(chunks).tolist():
            part = batch.filter(pa.array(chunks == n))
            own = _chunk(part["rep"].to_numpy(), n)
            for j in range(n):
                yield pa.record_batch([*part.columns, pa.array(np.minimum(own, j) * n + np.maximum(own, j))], [*part.schema.names, "meeting"])


def vector_components(vectors: DataFrame, **columns: str) -> DataFrame:
    """vec_id, n_links (other vectors linked directly), component_id (least reachable id) and kept, per row."""
    rows, classes, found = near_vectors(vectors, **columns)
    linked = found.groupBy(F.col("rep").alias("linked_rep")).agg(F.sum("linked").alias("linked"))
    nodes = connected_components(found.select(F.col("rep").alias("a"), F.col("with").alias("b")))
    named = classes.join(linked, F.col("rep") == F.col("linked_rep"), "left").join(nodes, F.col("rep") == F.col("node"), "left")
    named = named.select(F.col("key_1").alias("k1"), F.col("key_2").alias("k2"), (F.coalesce("linked", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    out = rows.join(named, (F.col("key_1") == F.col("k1")) & (F.col("key_2") == F.col("k2")), "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
