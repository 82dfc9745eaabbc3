"""Sampled SentencePiece segmentation by forward filtering and backward sampling, and lossless decoding.

Lattice. A text is its UTF-8 bytes with each space written as U+2581, after one such sign in front. Edges are the
vocabulary's pieces where they occur; a character that no single-character piece covers, and U+2581 itself where it
occurs in the text, is spelt by byte pieces. An edge's probability is in
proportion to exp(``ALPHA`` * score) with the model's scores (for this model: minus the rank of a merge), summing to 1
over the vocabulary, so few pieces and early merges are preferred and every segmentation of the lattice may be drawn.

No piece but runs of spaces has a space after its first character, so the lattice falls apart at every step from a
non-space to a space, and also around line feeds: those chunks are filtered once per distinct chunk of a block of texts
(a Python worker remembers those that recur) and sampled for every occurrence. Forward filtering sums the weight of all segmentations up to each byte; backward
sampling starts at the chunk's end and draws, step by step, the edge that ended there with probability proportional to
(weight up to its start) * (its weight). All occurrences take their steps together.

The random numbers are hashes of (seed, row key, chunk's place in the text, byte in the chunk), and shares are summed node
by node: a row's segmentation depends on its key and text alone, bit by bit, not on its neighbours, partitions or retries.

Decoding joins the pieces, byte pieces as bytes, turns U+2581 into spaces and drops the one in front. Null and empty
texts have no pieces and decode to the empty text. A null key counts as 0. Repeated rows get equal segmentations. Very
long texts are handled whole. Other columns are ignored. An empty table gives an empty table.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import byte_runs, look_up, mix, segment_hashes, string_buffers

ALPHA = 0.002
#: Scores below this mark pieces outside the ranking (runs of spaces); they weigh as little as the last rank.
UNRANKED = -1e8
SEED = 20240229
BLOCK_BYTES = 1 << 20
#: Lattice bytes of distinct chunks that are filtered together.
FILTER_BYTES = 1 << 16
#: Lattice nodes that a Python worker keeps for chunks that recur (about 40 bytes each).
KEPT_NODES = 1 << 19
#: Occurrences whose pieces are drawn together.
DRAWN = 1 << 15
FILTER_BITS = 18


class Pieces:
    """Vocabulary of a SentencePiece model as byte strings, with their weights."""

    def __init__(self, path: str, alpha: float = ALPHA):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.bytes: list[bytes] = []
        normal = []
        byte_of: dict[int, int] = {}
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                byte_of[int(piece[3:5], 16)] = i
                self.bytes.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.bytes.append(b"")
            else:
                # Spaces are single bytes inside the lattice; U+2581 in the text is spelt by bytes.
                self.bytes.append(piece.replace("▁", " ").encode())
                normal.append((self.bytes[-1], i, model.get_score(i)))
        self.byte_id = np.array([byte_of[b] for b in range(256)], np.int32)
        lowest = min((s for _, _, s in normal if s > UNRANKED), default=0.0)
        total = sum(float(np.exp(alpha * max(s, lowest))) for _, _, s in normal) or 1.0
        self.byte_log_weight = alpha * (lowest - 1) - float(np.log(total))
        single = {p.decode() for p, _, _ in normal if len(p.decode()) == 1}
        lengths: dict[int, list[tuple[bytes, int, float]]] = {}
        for p, i, s in normal:
            lengths.setdefault(len(p), []).append((p, i, alpha * max(s, lowest) - float(np.log(total))))
        self.longest = max(lengths, default=0)
        self.by_length, self.opening = {}, {}
        for size in range(1, self.longest + 1):
            heads = sorted({p[:size] for p, _, _ in normal if len(p) >= size})
            self.opening[size] = self._filter(_hashes(heads, size))
            if items := lengths.get(size):
                keys = _hashes([p for p, _, _ in items], size)
                order = np.argsort(keys)
                self.by_length[size] = (keys[order], np.array([items[k][1] for k in order], np.int32), np.array([items[k][2] for k in order]))
        self.lone = {size: np.sort(_hashes(x, size)) for size in (1, 2, 3, 4) if (x := [c.encode() for c in single if len(c.encode()) == size])}
        # Bytes that occur in no piece of several bytes end a chunk on both sides.
        inside = np.zeros(256, bool)
        for p, _, _ in normal:
            if len(p) > 1:
                inside[np.frombuffer(p, np.uint8)] = True
        self.apart = ~inside
        self.apart[0x80:] = False
        self.length = np.array(list(map(len, self.bytes)), np.int64)
        self.offset = np.cumsum(self.length) - self.length
        self.joined = np.frombuffer(b"".join(self.bytes), np.uint8)

    @staticmethod
    def _filter(keys: np.ndarray) -> np.ndarray:
        """Whether a hash's leading bits are those of some opening of a piece: few substrings go on beyond it."""
        seen = np.zeros(1 << FILTER_BITS, bool)
        seen[(keys >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
        return seen


def _hashes(items: list[bytes], size: int) -> np.ndarray:
    at = np.arange(len(items)) * size
    return segment_hashes(np.frombuffer(b"".join(items), np.uint8), at, at + size, fold=False)


def _salt(size: int) -> np.uint64:
    """What ``segment_hashes`` adds for a length."""
    return np.uint64(size * 0xD6E8FEB86659FD93 % 2**64)


def prefix_sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    from .text import _VALUE, _powers

    power, inverse = _powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUE[data] * power[: len(data)], out=sums[1:])
    return sums, inverse


def _edges(pieces: Pieces, data: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, size, piece and log weight of every edge; an edge at byte i ends before ``stop[i]`` or there."""
    n = len(data)
    sums, inverse = prefix_sums(data)
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    width = np.diff(np.append(lead, n))
    start, size_of, piece, weight = [], [], [], []
    open_, bare = np.arange(len(lead)), np.ones(len(lead), bool)  # characters that may open a piece of this size
    for size in range(1, pieces.longest + 1):
        open_ = open_[lead[open_] + size <= stop[lead[open_]]]
        at = lead[open_]
        h = mix((sums[at + size] - sums[at]) * inverse[at] + _salt(size))
        going = pieces.opening[size][(h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)]
        open_, at, h = open_[going], at[going], h[going]
        if size in pieces.lone:
            whole = width[open_] == size
            bare[open_[whole]] = look_up(pieces.lone[size], h[whole]) < 0
        if size in pieces.by_length and len(at):
            keys, ids, weights = pieces.by_length[size]
            k = look_up(keys, h)
            hit = k >= 0
            start.append(at[hit])
            size_of.append(np.full(int(hit.sum()), size, np.int64))
            piece.append(ids[k[hit]])
            weight.append(weights[k[hit]])
    # Characters without a piece of their own: each byte is an edge.
    at = np.flatnonzero(np.repeat(bare, width)) if len(lead) else np.zeros(0, np.int64)
    start.append(at)
    size_of.append(np.ones(len(at), np.int64))
    piece.append(pieces.byte_id[data[at]])
    weight.append(np.full(len(at), pieces.byte_log_weight))
    return tuple(np.concatenate(x) for x in (start, size_of, piece, weight))  # type: ignore[return-value]


class Lattice:
    """Forward-filtered lattices of chunks, one after the other.

    A chunk of n bytes has n + 1 nodes, one before each byte and one at its end. ``edge[v]:edge[v + 1]`` are the edges that
    end in node v, with their pieces and running shares: shares are summed node by node, so they depend on the chunk alone.
    """

    def __init__(self) -> None:
        self.edge = np.zeros(1, np.int64)
        self.piece, self.running = np.zeros(0, np.int32), np.zeros(0)

    @property
    def nodes(self) -> int:
        return len(self.edge) - 1

    def add(self, pieces: Pieces, data: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Filter further chunks (chunk k is ``data[begin[k]:begin[k + 1]]``); the last node of each."""
        size = np.diff(begin)
        chunk = np.repeat(np.arange(len(size)), size)
        start, length, piece, weight = _edges(pieces, data, begin[1:][chunk])
        end = start + length + chunk[start]  # nodes: a place in the data, plus one for each chunk before
        nodes = len(data) + len(size)
        order = np.argsort(end * 256 + length, kind="stable")
        end, length, piece, weight = end[order], length[order], piece[order], weight[order]
        edge = np.searchsorted(end, np.arange(nodes + 1))
        first = begin[:-1] + np.arange(len(size))
        step = end - np.repeat(first, size + 1)[end]
        by_step = np.argsort(step.astype(np.uint16) if size.max(initial=0) < 1 << 16 else step, kind="stable")
        log_total = np.full(nodes, -np.inf)
        log_total[first] = 0.0
        share = np.zeros(len(end))
        cuts = np.append(np.flatnonzero(np.diff(step[by_step], prepend=-1)), len(step))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            here = by_step[a:b]
            into = end[here]
            value = log_total[into - length[here]] + weight[here]
            node = np.flatnonzero(np.diff(into, prepend=-1))
            spread = np.diff(np.append(node, b - a))
            top = np.maximum.reduceat(value, node)
            part = np.exp(value - np.repeat(top, spread))
            total, running = _running(part, node, spread)
            log_total[into[node]] = np.log(total) + top
            share[here] = running / np.repeat(total, spread)
        self.edge = np.concatenate([self.edge, edge[1:] + self.edge[-1]])
        self.piece, self.running = np.concatenate([self.piece, piece]), np.concatenate([self.running, share])
        return self.nodes - nodes + first + size

    def sample(self, pieces: Pieces, last: np.ndarray, size: np.ndarray, random: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """For each occurrence of a chunk (its last node, its size) the pieces in order, and where each occurrence's begin."""
        left = size.copy()
        open_ = np.arange(len(last))
        found, turns = [], np.zeros(len(last), np.int64)
        while len(open_):
            at = last[open_] - size[open_] + left[open_]
            u = random(open_, left[open_])
            lo, hi = self.edge[at], self.edge[at + 1] - 1
            u = u * self.running[hi]
            while True:  # bisect all at once: the first edge whose running share exceeds u
                todo = lo < hi
                if not todo.any():
                    break
                middle = (lo + hi) >> 1
                right = todo & (self.running[middle] <= u)
                lo = np.where(right, middle + 1, lo)
                hi = np.where(todo & ~right, middle, hi)
            piece = self.piece[lo]
            found.append((open_, piece))
            turns[open_] += 1
            left[open_] -= pieces.length[piece]
            open_ = open_[left[open_] > 0]
        at = np.concatenate([[0], np.cumsum(turns)])
        out = np.zeros(int(at[-1]), np.int32)
        for turn, (which, piece) in enumerate(found):  # drawn from the end
            out[at[which + 1] - 1 - turn] = piece
        return out, at


def _running(part: np.ndarray, node: np.ndarray, spread: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Total and running sum of each run ``part[node[k]:node[k] + spread[k]]``, added in order."""
    running = part.copy()
    going, rank = np.flatnonzero(spread > 1), 1
    while len(going):
        running[node[going] + rank] += running[node[going] + rank - 1]
        rank += 1
        going = going[spread[going] > rank]
    return running[node + spread - 1], running


def lattice_bytes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every non-empty text with one space in front; U+2581 stays as its three bytes, which no piece covers."""
    front = offsets[:-1][np.diff(offsets) > 0]
    shift = np.concatenate([[0], np.cumsum(np.diff(offsets) > 0)])
    return np.insert(data, front, 32), offsets + shift


def chunks(pieces: Pieces, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where chunks begin, and the end of the data."""
    cut = np.zeros(len(data) + 1, bool)
    space = data == 32
    apart = pieces.apart[data]
    cut[1:-1] = (space[1:] & ~space[:-1]) | apart[1:] | apart[:-1]
    cut[offsets] = True
    return np.flatnonzero(cut)


def _gather(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indices begin[k] .. begin[k] + size[k] - 1 for all k."""
    total = int(size.sum())
    return np.arange(total) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begin, size)


class Sampler:
    """Draws the segmentations of texts; remembers the lattices of chunks that recur, up to ``KEPT_NODES`` nodes."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.forget()

    def forget(self) -> None:
        self.kept = Lattice()
        self.keys, self.last = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def _filter(self, lattice: Lattice, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Add the chunks of ``data`` to a lattice, ``FILTER_BYTES`` at a time; their last nodes."""
        out, cut = [np.zeros(0, np.int64)], np.cumsum(size) // FILTER_BYTES
        edges = np.append(np.flatnonzero(np.diff(cut, prepend=-1)), len(size))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            out.append(lattice.add(self.pieces, data[_gather(begin[a:b], size[a:b])], np.concatenate([[0], np.cumsum(size[a:b])])))
        return np.concatenate(out)

    def ids(self, keys: np.ndarray, texts: pa.Array, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of all texts and where each text's begin (n + 1)."""
        data, offsets = lattice_bytes(*string_buffers(texts))
        edge = chunks(self.pieces, data, offsets)
        begin, end = edge[:-1], edge[1:]
        if not len(begin):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        doc = np.searchsorted(offsets, begin, "right") - 1
        place = np.arange(len(begin)) - np.searchsorted(begin, offsets[:-1])[doc]
        unique, index, inverse, often = np.unique(segment_hashes(data, begin, end, fold=False), return_index=True, return_inverse=True, return_counts=True)
        row = mix(mix(keys.astype(np.int64).view(np.uint64) ^ np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64))[doc] + place.astype(np.uint64))
        first, size = begin[index], (end - begin)[index]
        if self.kept.nodes >= KEPT_NODES and 2 * often[look_up(self.keys, unique) >= 0].sum() < len(begin):
            self.forget()
        again = np.flatnonzero((often > 1) & (look_up(self.keys, unique) < 0))
        again = again[np.cumsum(size[again] + 1) <= KEPT_NODES - self.kept.nodes]
        if len(again):
            last = self._filter(self.kept, data, first[again], size[again])
            order = np.argsort(joined := np.concatenate([self.keys, unique[again]]))
            self.keys, self.last = joined[order], np.concatenate([self.last, last])[order]
        known = look_up(self.keys, unique)
        out, counts = [], np.zeros(len(begin), np.int64)
        passes = [(self.kept, np.where(known >= 0, self.last[known] if len(self.last) else 0, -1))]
        rest = np.flatnonzero(known < 0)
        cut = np.cumsum(size[rest]) // FILTER_BYTES
        for g in np.unique(cut):
            mine, lattice, last = rest[cut == g], Lattice(), np.full(len(unique), -1)
            last[mine] = self._filter(lattice, data, first[mine], size[mine])
            passes.append((lattice, last))
        for lattice, last in passes:
            own = np.flatnonzero(last[inverse] >= 0)
            for a in range(0, len(own), DRAWN):
                part = own[a : a + DRAWN]
                seeds = row[part]
                draw = lambda open_, at, s=seeds: (mix(s[open_] + at.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)) >> np.uint64(11)).astype(np.float64) * 2.0**-53
                piece, at = lattice.sample(self.pieces, last[inverse[part]], size[inverse[part]], draw)
                counts[part] = np.diff(at)
                out.append((part, piece, at[:-1]))
        ends = np.cumsum(counts)
        ids = np.zeros(int(ends[-1]), np.int32)
        for part, piece, at in out:
            ids[_gather(ends[part] - counts[part], counts[part])] = piece
        return ids, np.concatenate([[0], ends])[np.searchsorted(begin, offsets)]


def sample_ids(pieces: Pieces, keys: np.ndarray, texts: pa.Array, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """``Sampler.ids`` without memory of other texts."""
    return Sampler(pieces).ids(keys, texts, seed)


def decode_ids(pieces: Pieces, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and where each begins (n + 1)."""
    size = pieces.length[ids]
    data = pieces.joined[_gather(pieces.offset[ids], size)]
    ends = np.concatenate([[0], np.cumsum(size)])[at]
    front = ends[:-1][np.diff(ends) > 0]
    return np.delete(data, front), ends - np.concatenate([[0], np.cumsum(np.diff(ends) > 0)])


_SAMPLERS: dict[str, Sampler] = {}


def sampler_of(path: str) -> Sampler:
    """One per Python worker and model."""
    if path not in _SAMPLERS:
        _SAMPLERS[path] = Sampler(Pieces(path))
    return _SAMPLERS[path]


def pieces_of(path: str) -> Pieces:
    return sampler_of(path).pieces


def sampled_pieces(docs: DataFrame, model: str, *, seed: int = SEED, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and ids (the sampled segmentation) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = sampler_of(model)
        for batch in batches:
            for i, j in byte_runs(batch.column(1), BLOCK_BYTES):
                keys = batch.column(0).slice(i, j - i)
                ids, at = sampler.ids(keys.fill_null(0).to_numpy(zero_copy_only=False), batch.column(1).slice(i, j - i), seed)
                yield pa.record_batch([keys, pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decoded_texts(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id and text from doc_id and ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(model)
        for batch in batches:
            lists = batch.column(1).fill_null([])
            data, at = decode_ids(pieces, lists.flatten().to_numpy().astype(np.int64), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())]).astype(np.int64))
            yield pa.record_batch([batch.column(0), pa.array([data[a:b].tobytes().decode() for a, b in zip(at[:-1], at[1:], strict=True)], pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def sample_digests(docs: DataFrame, model: str, *, seed: int = SEED, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_pieces, ids_crc32 (ids as little-endian uint32), text_crc32 of the decoded text, lossless."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = sampler_of(model)
        pieces = sampler.pieces
        for batch in batches:
            for i, j in byte_runs(batch.column(1), BLOCK_BYTES):
                keys, texts = batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i)
                ids, at = sampler.ids(keys.fill_null(0).to_numpy(zero_copy_only=False), texts, seed)
                data, where = decode_ids(pieces, ids, at)
                source, source_at = string_buffers(texts)
                raw, out, want = (memoryview(np.ascontiguousarray(x)).cast("B") for x in (ids.astype("<u4"), data, source))
                same = [out[a:b] == want[c:d] for a, b, c, d in zip(where[:-1], where[1:], source_at[:-1], source_at[1:], strict=True)]
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1], at[1:], strict=True)]
                text_crc = [zlib.crc32(out[a:b]) for a, b in zip(where[:-1], where[1:], strict=True)]
                yield pa.record_batch([keys, pa.array(np.diff(at)), pa.array(crc, pa.int64()), pa.array(text_crc, pa.int64()), pa.array(same, pa.bool_())], ["doc_id", "n_pieces", "ids_crc32", "text_crc32", "lossless"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_pieces long, ids_crc32 long, text_crc32 long, lossless boolean")
