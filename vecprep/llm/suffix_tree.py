"""Language-model scoring by a probabilistic suffix tree over words.

Symbols are the words of the lower-cased text, then one end symbol. A context is up to ``depth`` words; it may become a
state if it occurs ``least`` times (in a small corpus: makes up ``P_MIN`` of all positions, if that is less), so their
number grows with the corpus. A state u predicts

    P(s | u) = (c(us) + T(u) P(s | parent)) / (c(u) + T(u)),   T(u): distinct symbols seen after u,

where the parent is the longest shorter suffix of u that is a state, down to the root, (c(s) + 0.5) / (N + 0.5 (V + 1))
(one unseen symbol included). Divergence test, from short contexts to long ones: a context is retained if its own
predictions, each with the occurrence itself taken out, beat its parent's by more than ``gain`` nats per occurrence. A
position is scored by the longest suffix of what precedes it that is a retained state.

How it runs. Words are counted; the most frequent ones (``VOCABULARY`` at most, which bounds what is broadcast) are numbered
by rank. Blocks of documents become a table of word numbers, bucketed by block so that answers find their block without
moving it. Then blocks ask and buckets answer, level by level; positions and documents stay.
0. For words beyond the vocabulary, which keep their hashes, blocks ask how often they occur.
1. For contexts of one word that occur ``least`` times, each block tells once per context and symbol how often the
   symbol follows. A bucket has all that follows its contexts, so it counts, tests and answers with the pair's count, and
   with T(u) and the test's result. What is summed for a word after a context is how often the two occur together, that
   is the count of the longer context: so
2. and on: only contexts that are known to occur ``least`` times are asked for at the next level.
Asks name contexts in the order of their words. Of contexts that aren't states, only counts that make contexts of the next
level are told, and no count is asked with; a pair's counts in shorter contexts are sent by blocks that have it in training.
A context that makes up 1 / (4 buckets) of all positions is divided among buckets by symbol; its totals and its test are
put together from parts (at most 4 such contexts a bucket and level; only these reach the driver). No other set of
contexts is broadcast. After the last level the blocks score their documents.

Null and empty texts have the end symbol alone. A null document id counts as training text (its remainder is unknown).
Repeated rows are documents of their own. Without training tokens every symbol has base probability 1. An empty table
gives an empty result. Other columns are ignored. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fitting import remainder
from .storage import Bucketed, drop, free_shuffles, materialise, partitions_for, size_in_bytes
from .text import byte_runs, give_memory_back, look_up, mix, pack_many, unpack_many, words

DEPTH = 3
P_MIN = 1e-5
#: Occurrences that a state needs at most, however large the corpus.
LEAST = 32
GAIN = 0.01
BLOCK_BYTES = 10 << 20
#: Words that are numbered by rank at most; 16 bytes each are broadcast.
VOCABULARY = 1 << 21
#: From here on numbers of words are hashes.
RARE = np.uint64(1 << 63)
#: Bytes of stored input for which there is a bucket, and for which blocks are stored together.
BUCKET_BYTES = 32 << 20
STORED_BYTES = 6 << 20
#: Pairs of a bucket that are counted at a time.
PAIRS = 500_000
END = np.uint64(0x1F0E3DCD97531ECA)
_STEP = np.uint64(0xC2B2AE3D27D4EB4F)
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
ASKS = "bucket int, block long, data binary"
ANSWERS = "target long, level int, bucket int, data binary"
#: Targets of answers that aren't blocks.
TOTALS, PARTS = -1, -2
COUNTED = "kind string, bucket int, n long, distinct long, data binary"


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values ascending, a place where each appears, and for each entry the number of its value."""
    order = np.argsort(x)
    ordered = x[order]
    new = np.ones(len(x), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    number = np.cumsum(new)
    number -= 1
    inverse = np.empty(len(x), np.int64)
    inverse[order] = number
    return ordered[new], order[new], inverse


def _narrow(x: np.ndarray) -> np.ndarray:
    most = int(x.max(initial=0))
    return x.astype(np.uint8 if most < 2**8 else np.uint16 if most < 2**16 else np.uint32 if most < 2**32 else np.uint64)


def _hashed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a.astype(np.uint64) * _STEP + b.astype(np.uint64))


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal entries begin and how long they are."""
    first = np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.zeros(0, np.int64)
    return first, np.diff(np.append(first, len(x)))


def _steps(x: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of runs that ascend: their first entries, and how much each other one exceeds the one before."""
    rest = np.ones(len(x), bool)
    rest[first] = False
    return x[first], np.diff(x, prepend=0)[rest]


def _from_steps(first: np.ndarray, step: np.ndarray, length: np.ndarray) -> np.ndarray:
    length = length.astype(np.int64)
    at, out, rest = np.cumsum(length) - length, np.zeros(len(first) + len(step), np.int64), np.ones(len(first) + len(step), bool)
    rest[at] = False
    out[rest] = step
    out = np.cumsum(out)
    return out + np.repeat(first.astype(np.int64) - out[at], length)


def _segments(bucket: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Bucket, begin and end of each run."""
    for a, n in zip(*_runs(bucket), strict=True):
        yield int(bucket[a]), int(a), int(a + n)


def _table(rows: list[tuple], *columns: tuple[str, pa.DataType]) -> pa.Table:
    return pa.table([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(columns)], [n for n, _ in columns])


def _answers(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    return _table(rows, ("target", pa.int64()), ("level", pa.int32()), ("bucket", pa.int32()), ("data", pa.binary()))


@dataclass
class Vocabulary:
    """Frequent words: sorted hashes, and their places by rank; counts by place."""

    hashes: np.ndarray
    place: np.ndarray
    count: np.ndarray

    def numbers(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A number for each word and how often it occurs, -1 where that isn't known."""
        at = look_up(self.hashes, hashes)
        place = self.place[at] if len(self.place) else at
        known = at >= 0
        return np.where(known, place.astype(np.uint64) + np.uint64(1), hashes | RARE), np.where(known, self.count[place] if len(self.count) else 0, -1)


@dataclass
class Block:
    """Some documents: sorted numbers of their words, how often these occur in training (-1: not known), and the documents
    as places in that list, each ended by END."""

    ids: np.ndarray
    null: np.ndarray
    held: np.ndarray
    size: np.ndarray
    words: np.ndarray
    count: np.ndarray
    symbol: np.ndarray

    @classmethod
    def of(cls, batch: pa.RecordBatch, vocabulary: Vocabulary | None = None) -> Block:
        """Of rows (doc_id, held_out, text); with no vocabulary the numbers are the words' hashes."""
        ids, (hashes, at) = batch.column(0), words(batch.column(2))
        coded = pa.array(np.insert(hashes, at[1:], END)).dictionary_encode()  # few words, often: faster than a sort
        found, symbol = coded.dictionary.to_numpy(), coded.indices.to_numpy()
        number, count = (found, np.zeros(len(found), np.int64)) if vocabulary is None else vocabulary.numbers(found)
        order = np.argsort(number)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        return cls(ids.fill_null(0).to_numpy(zero_copy_only=False), np.asarray(ids.is_null()), np.asarray(batch.column(1)), np.diff(at) + 1, number[order], count[order], rank[symbol])

    def pack(self) -> bytes:
        known = self.words < RARE  # rare words come last
        return pack_many(self.ids, self.null.astype(np.uint8), self.held.astype(np.uint8), _narrow(self.size), _narrow(self.words[known]), self.words[~known], _narrow(self.count[known]), _narrow(self.symbol), delta=(4, 5))

    @classmethod
    def unpack(cls, data: bytes) -> Block:
        ids, null, held, size, known, rare, count, symbol = unpack_many(data)
        return cls(ids, null.astype(bool), held.astype(bool), size.astype(np.int64), np.concatenate([known.astype(np.uint64), rare]), np.concatenate([count.astype(np.int64), np.full(len(rare), -1)]), symbol.astype(np.int64))

    @property
    def document(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.size)), self.size)

    def rare(self, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of the words whose counts aren't known, by the bucket that has them, and these buckets."""
        place = np.flatnonzero(self.count < 0)
        bucket = _word_bucket(self.words[place], buckets)
        order = np.argsort(bucket, kind="stable")
        return place[order], bucket[order]


def _word_bucket(words_: np.ndarray, buckets: int) -> np.ndarray:
    """Of a word's hash, of which the uppermost bit doesn't count."""
    return (mix(words_ | RARE) % np.uint64(buckets)).astype(np.int64)


def _tell_words(buckets: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in byte_runs(batch.column(2), BLOCK_BYTES):
                block = Block.of(batch.slice(i, j - i))
                count = np.bincount(block.symbol, ~block.held[block.document], len(block.words)).astype(np.int64)
                bucket = _word_bucket(block.words, buckets)
                order = np.argsort(bucket, kind="stable")
                rows = [(b, pack_many(block.words[order[x:y]], _narrow(count[order[x:y]]), delta=(0,))) for b, x, y in _segments(bucket[order])]
                yield from _table(rows, ("bucket", pa.int32()), ("data", pa.binary())).to_batches()

    return run


def _count_words(group: pa.Table) -> pa.Table:
    """A bucket's words, sorted, with their counts; how many words there are by the (rounded) logarithm of the count."""
    told = [unpack_many(d.as_buffer()) for d in group["data"]]
    word, inverse = np.unique(np.concatenate([t[0] for t in told]), return_inverse=True)
    total = np.bincount(inverse, np.concatenate([t[1] for t in told]), len(word)).astype(np.int64)
    bucket = group["bucket"][0].as_py()
    rows = [("words", bucket, int(total.sum()), int(np.count_nonzero(total)), pack_many(word, _narrow(total), delta=(0,)))]
    rows += [("step", int(step), int(n), 0, b"") for step, n in zip(*np.unique(_step_of(total[total > 0]), return_counts=True), strict=True)]
    return _table(rows, ("kind", pa.string()), ("bucket", pa.int32()), ("n", pa.int64()), ("distinct", pa.int64()), ("data", pa.binary()))


def _step_of(count: np.ndarray) -> np.ndarray:
    """Steps of count, 16 for each doubling."""
    return np.floor(16 * np.log2(np.maximum(count, 1))).astype(np.int64)


def _frequent(least: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(4):
                word, count = unpack_many(data.as_buffer())
                good = (count > 0) & (_step_of(count.astype(np.int64)) >= least)
                yield pa.record_batch([pa.array([pack_many(word[good], count[good], delta=(0,))], pa.binary())], ["data"])

    return run


def frequent_words(counted: DataFrame) -> Vocabulary:
    """As many whole steps of count as ``VOCABULARY`` words go into, from the top."""
    steps = counted.filter("kind = 'step'").groupBy("bucket").agg(F.sum("n").alias("n")).orderBy(F.desc("bucket")).collect()  # 16 for each bit
    least, room = 1 << 30, VOCABULARY
    for step, n in steps:
        if (room := room - n) < 0:
            break
        least = step
    rows = counted.filter("kind = 'words'").mapInArrow(_frequent(least), "data binary").toArrow()["data"]
    found = [unpack_many(d.as_buffer()) for d in rows]
    word = np.concatenate([np.zeros(0, np.uint64), *(w for w, _ in found)])
    count = np.concatenate([np.zeros(0, np.int64), *(c.astype(np.int64) for _, c in found)])
    order = np.lexsort((word, -count))
    place = np.empty(len(order), np.uint32)
    place[order] = np.arange(len(order), dtype=np.uint32)
    by = np.argsort(word)
    count = count[order]
    return Vocabulary(word[by], place[by], count.astype(np.uint32) if count.max(initial=0) < 2**32 else count)


def _encode(vocabulary) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        for batch in batches:
            for i, j in byte_runs(batch.column(2), BLOCK_BYTES):
                block = Block.of(batch.slice(i, j - i), vocabulary.value)
                yield pa.record_batch([pa.array([number], pa.int64()), pa.array([block.pack()], pa.binary())], ["block", "data"])
                number += 1

    return run


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Block]]:
    for batch in batches:
        for number, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            yield number, Block.unpack(data.as_buffer())
            give_memory_back()


def _ask_words(buckets: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, block in _read(batches):
            place, bucket = block.rare(buckets)
            rows = [(b, number, pack_many(block.words[place[i:j]], delta=(0,))) for b, i, j in _segments(bucket)]
            yield from _table(rows, ("bucket", pa.int32()), ("block", pa.int64()), ("data", pa.binary())).to_batches()

    return run


def _answer_words(asks: pa.Table, counted: pa.Table) -> pa.Table:
    rows = []
    if len(asks) and len(counted):
        word, count = unpack_many(counted["data"][0].as_buffer())
        by = np.argsort(word | RARE)
        word, count = (word | RARE)[by], count[by]
        for target, data in zip(asks["block"].to_pylist(), asks["data"], strict=True):
            (own,) = unpack_many(data.as_buffer())
            rows.append((target, 0, asks["bucket"][0].as_py(), pack_many(count[look_up(word, own)])))
    return _answers(rows)


@dataclass
class Model:
    """What all tasks know: sizes, settings, and by level the divided contexts (sorted keys, T(u) and whether a state)."""

    depth: int
    buckets: int
    tokens: int
    distinct: int
    least: float
    gain: float
    keys: dict[int, np.ndarray] = field(default_factory=dict)
    after: dict[int, np.ndarray] = field(default_factory=dict)
    state: dict[int, np.ndarray] = field(default_factory=dict)

    def root(self, count: np.ndarray) -> np.ndarray:
        return (count + 0.5) / (self.tokens + 0.5 * (self.distinct + 1))

    def divided(self, count: np.ndarray) -> np.ndarray:
        return count * 4 * self.buckets >= self.tokens

    def states(self, worth: np.ndarray, count: np.ndarray) -> np.ndarray:
        return (worth > self.gain * count) & (count >= self.least)


def _below(p: np.ndarray, n: np.ndarray, c: np.ndarray, t: np.ndarray, state: np.ndarray) -> np.ndarray:
    """The probability after ``n`` of ``c`` occurrences in a context with ``t`` symbols, if a state, from its parent's."""
    return np.where(state, (n + t * p) / np.maximum(c + t, 1), p)


def _worth(n: np.ndarray, c: np.ndarray, t: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """What symbols seen ``n`` times in contexts of ``c`` occurrences and ``t`` symbols gain over their parent."""
    left = t - (n == 1)
    rest = c - 1 + left
    out = np.where(rest > 0, (n - 1 + left * parent) / np.maximum(rest, 1), parent)
    return np.where(n > 0, n * np.log(np.maximum(out, 1e-300) / parent), 0.0)


class Level:
    """What a block asks of one level, and what it knows once that is answered.

    ``here``: the positions whose context of this depth occurs often enough; ``pair``: for each of them the place of its
    (context, symbol) among those asked for, which lie by bucket and symbol. ``words``: of each context its words' numbers,
    the newest first; ``total``: how often it occurs.
    """

    def __init__(self, here: np.ndarray, of: np.ndarray, words_: np.ndarray, total: np.ndarray, block: Block, model: Model):
        symbol = block.symbol[here]
        self.words, self.total, self.divided = words_, total, model.divided(total)
        self.key = context_keys(words_)
        bucket = (mix(self.key) % np.uint64(model.buckets)).astype(np.int64)
        spread = np.flatnonzero(self.divided[of]) if self.divided.any() else np.zeros(0, np.int64)
        apart = (mix(self.key[of[spread]] ^ mix(block.words[symbol[spread]])) % np.uint64(model.buckets)).astype(np.int64)
        each = len(block.words) * max(len(total), 1)
        code = symbol * len(total)
        if model.buckets * each < 1 << 62:
            code += (bucket * each + np.arange(len(total)))[of]
            code[spread] += (apart - bucket[of[spread]]) * each
            code, index, self.pair = _distinct(code)
            self.bucket = code // each
        else:  # pairs first, then by bucket
            code += of
            _, index, pair = _distinct(code)
            bucket = bucket[of]
            bucket[spread] = apart
            order = np.argsort(bucket[index], kind="stable")
            back = np.empty(len(order), np.int64)
            back[order] = np.arange(len(order))
            index, self.pair = index[order], back[pair]
            self.bucket = bucket[index]
        self.here, self.at = here, here[index]
        self.of, self.symbol = of[index], symbol[index]
        self.n = np.zeros(len(index), np.int64)
        self.after, self.state = np.zeros(len(total), np.int64), np.zeros(len(total), bool)

    def contexts(self, i: int, j: int) -> np.ndarray:
        """The contexts of some pairs, ascending."""
        found = np.zeros(len(self.total), bool)
        found[self.of[i:j]] = True
        return np.flatnonzero(found)

    def answered(self, told: dict[int, pa.Scalar], model: Model, depth: int) -> None:
        for bucket, i, j in _segments(self.bucket):
            self.n[i:j], about = unpack_many(told[bucket].as_buffer())
            own = self.contexts(i, j)
            self.after[own], self.state[own] = about.astype(np.int64) >> 1, (about & 1) > 0
        if self.divided.any():
            at = look_up(model.keys[depth], self.key[self.divided])
            self.after[self.divided], self.state[self.divided] = model.after[depth][at], model.state[depth][at]


def context_keys(words_: np.ndarray) -> np.ndarray:
    """64 bits for each context, a column of its words' numbers."""
    key = np.zeros(words_.shape[1], np.uint64)
    for w in words_:
        key = _hashed(key + np.uint64(1), w)
    return key


class Replay:
    """A block and its levels so far, and of each position the probability.

    A context of the next level is a pair of this one, that of the position before: its words are the pair's context and
    symbol, and it occurs as often as the pair.
    """

    def __init__(self, block: Block, model: Model, answers: pa.Table):
        self.block, self.model = block, model
        self.told: dict[int, dict[int, pa.Scalar]] = {}
        for level, bucket, data in zip(answers["level"].to_pylist(), answers["bucket"].to_pylist(), answers["data"], strict=True):
            self.told.setdefault(level, {})[bucket] = data
        place, bucket = block.rare(model.buckets)
        for b, i, j in _segments(bucket):
            (block.count[place[i:j]],) = unpack_many(self.told[0][b].as_buffer())
        self.begins = np.zeros(len(block.symbol) + 1, bool)
        self.begins[np.cumsum(block.size) - block.size] = self.begins[-1] = True
        self.p = model.root(block.count)[block.symbol]
        self.levels: list[Level] = []

    def ask(self) -> Level:
        block = self.block
        if self.levels:
            last = self.levels[-1]
            here, pair, n = last.here + 1, last.pair, last.n
            follows = np.flatnonzero((n >= max(self.model.least, 1))[pair] & ~self.begins[here])
            here, pair = here[follows], pair[follows]
        else:  # the pairs of level 0 are the words
            n = block.count
            follows = np.flatnonzero((n >= max(self.model.least, 1))[block.symbol] & ~self.begins[1:])
            here, pair = follows + 1, block.symbol[follows]
        asked = np.zeros(len(n), bool)
        asked[pair] = True
        chosen = np.flatnonzero(asked)
        if self.levels:  # by their words, the newest first: like contexts lie together, so that what is told of them packs well
            chosen = chosen[np.argsort(last.symbol[chosen] * len(last.total) + last.of[chosen])]
            words_ = np.vstack([block.words[last.symbol[chosen]], last.words[:, last.of[chosen]]])
        else:
            words_ = block.words[chosen][None, :]
        number = np.zeros(len(asked), np.int64)
        number[chosen] = np.arange(len(chosen))
        return Level(here, number[pair], words_, n[chosen], block, self.model)

    def take(self, level: Level, told: dict[int, pa.Scalar]) -> None:
        level.answered(told, self.model, len(self.levels) + 1)
        own = _below(self.p[level.at], level.n, level.total[level.of], level.after[level.of], level.state[level.of])
        self.p[level.here] = own[level.pair]
        self.levels.append(level)

    def through(self, levels: int) -> None:
        for depth in range(1, levels + 1):
            self.take(self.ask(), self.told.get(depth, {}))

    def asks(self) -> Iterator[tuple[int, bytes]]:
        """By bucket: contexts, whether divided and what their suffixes are; symbols with their runs and counts; of pairs the
        context and what was counted so far."""
        level, positions = self.ask(), len(self.block.symbol)
        trained = np.repeat(~self.block.held, self.block.size)[level.here]
        train = np.bincount(level.pair[trained], minlength=len(level.at))
        counts, about = [], []
        for earlier in self.levels:  # the suffixes of a pair's context are those of its position
            at = np.full(positions, -1)
            at[earlier.here] = earlier.pair
            pair = at[level.at]
            of = earlier.of[pair]
            state = earlier.state[of]  # nothing is computed from those that aren't
            counts.append(np.where(state, earlier.n[pair], 0))
            for x in (earlier.total[of] * state, (earlier.after[of] * 2 + 1) * state):
                about.append(np.zeros(len(level.total), np.int64))
                about[-1][level.of] = x
        number = np.zeros(len(level.total), np.int64)
        for bucket, i, j in _segments(level.bucket):
            own = level.contexts(i, j)
            number[own] = np.arange(len(own))
            first, length = _runs(level.symbol[i:j])
            symbol = level.symbol[i + first]
            known = int(np.count_nonzero(self.block.words[symbol] < RARE))  # these come first and have ever fewer occurrences
            word, count = self.block.words[symbol], self.block.count[symbol]
            seen = [n[i:j][train[i:j] > 0] for n in counts]  # a pair's worth is found from what is told with its training occurrences
            columns = (level.divided[own].astype(np.uint8), *level.words[:, own], *(x[own] for x in about), length, word[:known], word[known:], count[:known][::-1], count[known:], *_steps(number[level.of[i:j]], first), train[i:j], *seen)
            at = 3 * level.words.shape[0]  # of the known symbols
            yield bucket, pack_many(*map(_narrow, columns), delta=(1, at, at + 1, at + 2))


def _ask(model, depth: int) -> Callable:
    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        rows = []
        if len(blocks):
            replay = Replay(Block.unpack(blocks["data"][0].as_buffer()), model.value, answers)
            replay.through(depth - 1)
            rows = [(bucket, blocks["block"][0].as_py(), data) for bucket, data in replay.asks()]
        give_memory_back()
        return _table(rows, ("bucket", pa.int32()), ("block", pa.int64()), ("data", pa.binary()))

    return run


class Asked:
    """What one block asks of a bucket, and room for the answers."""

    def __init__(self, data: bytes, depth: int, most: int):
        cut, *rest = unpack_many(data)
        length, number, rare, often, seldom, first, step, train, *seen = rest[3 * depth - 2 :]
        self.keys, self.cut = context_keys(np.stack(rest[:depth]).astype(np.uint64)), cut > 0
        self.about = [x.astype(np.int64) for x in rest[depth : 3 * depth - 2]]
        self.symbol = np.repeat(np.concatenate([number.astype(np.uint64), rare.astype(np.uint64)]), length)
        count = np.concatenate([often[::-1], seldom])
        self.context, self.train, self.seen = _narrow(_from_steps(first, step, length)), train, [np.repeat(count, length)]
        for n in seen:
            self.seen.append(np.zeros(len(train), n.dtype))
            self.seen[-1][train > 0] = n
        self.n, self.told = np.zeros(len(train), np.uint32 if most < 2**32 else np.int64), np.zeros(len(cut), np.int64)

    def within(self, part: int, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the contexts that fall to one part: their places, those of their pairs, and the pairs' contexts among them."""
        own = mix(self.keys ^ _STEP) % np.uint64(parts) == part
        pairs = np.flatnonzero(own[self.context])
        return np.flatnonzero(own), pairs, (np.cumsum(own) - 1)[self.context[pairs]]


def _answer(model, depth: int) -> Callable:
    """Counts and tests the contexts of a bucket, some of them at a time; of divided ones tells TOTALS and PARTS what it has."""

    def run(group: pa.Table) -> pa.Table:
        known: Model = model.value
        bucket, asked = group["bucket"][0].as_py(), [Asked(d.as_buffer(), depth, known.tokens) for d in group["data"]]
        parts, rows = 1 + sum(len(a.n) for a in asked) // PAIRS, []
        for part in range(parts):
            chosen = [a.within(part, parts) for a in asked]
            join = lambda f, ours: np.concatenate([f(a)[c] for a, c in zip(asked, ours, strict=True)])
            contexts, pairs = [c[0] for c in chosen], [c[1] for c in chosen]
            begin = np.cumsum([0] + [len(c) for c in contexts])
            told_of = np.concatenate([c[2] + at for c, at in zip(chosen, begin, strict=False)])
            if not len(told_of):
                continue
            keys, first, number = _distinct(join(lambda a: a.keys, contexts))
            of = number[told_of]
            _, index, inverse = _distinct(_hashed(keys[of], join(lambda a: a.symbol, pairs)))
            train = join(lambda a: a.train, pairs)
            n = np.bincount(inverse, train, len(index)).astype(np.int64)
            trained = np.flatnonzero(train)
            index[inverse[trained]] = trained  # who has the pair in training tells of it
            seen = [join(lambda a, k=k: a.seen[k], pairs)[index].astype(np.int64) for k in range(depth)]
            p = known.root(seen[0])
            for k in range(1, depth):
                c, packed = (join(lambda a, x=x: a.about[x], contexts)[told_of[index]] for x in (2 * k - 2, 2 * k - 1))
                p = _below(p, seen[k], c, packed >> 1, (packed & 1) > 0)
            of, cut = of[index], join(lambda a: a.cut, contexts)[first]
            count, after = np.bincount(of, n, len(keys)).astype(np.int64), np.bincount(of, n > 0, len(keys)).astype(np.int64)
            state = known.states(np.bincount(of, _worth(n, count[of], after[of], p), len(keys)), count)
            if cut.any():
                own = np.flatnonzero(cut[of] & (n > 0))
                rows += [(TOTALS, depth, bucket, pack_many(keys[cut], count[cut], after[cut])), (PARTS, depth, bucket, pack_many(keys[of[own]], _narrow(n[own]), p[own]))]
            told = np.where(cut | ~state, 0, after * 2 + 1)[number]
            # A count is of use in a state, and, if large, for the context that it makes at the next level.
            n[~(state | cut)[of] & ((n < known.least) | (depth == known.depth))] = 0
            at = np.cumsum([0] + [len(q) for q in pairs])
            for a, c, q, i, j in zip(asked, contexts, pairs, begin, at, strict=False):
                a.told[c], a.n[q] = told[i : i + len(c)], n[inverse[j : j + len(q)]]
        rows += [(target, depth, bucket, pack_many(_narrow(a.n), _narrow(a.told))) for target, a in zip(group["block"].to_pylist(), asked, strict=True)]
        give_memory_back()
        return _answers(rows)

    return run


def _listed(names: list[str]) -> Callable:
    """Rows of packed columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(3):
                yield pa.record_batch([pa.array(c.view(np.int64) if c.dtype == np.uint64 else c.astype(np.int64)) for c in unpack_many(data.as_buffer())], names)

    return run


def _test_parts(totals) -> Callable:
    """What the parts of divided contexts are worth, by context."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, count, after = totals.value
        for batch in batches:
            for data in batch.column(3):
                key, n, p = unpack_many(data.as_buffer())
                at = look_up(keys, key)
                worth = np.bincount(at, _worth(n.astype(np.int64), count[at], after[at], p), len(keys))
                yield pa.record_batch([pa.array(keys.view(np.int64)), pa.array(worth.astype(float))], ["key", "worth"])

    return run


def _finish(model) -> Callable:
    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        rows = []
        if len(blocks):
            block = Block.unpack(blocks["data"][0].as_buffer())
            replay, n, document = Replay(block, model.value, answers), len(block.ids), block.document
            base = np.bincount(document, np.log10(replay.p), n)
            replay.through(model.value.depth)
            score, known = np.bincount(document, np.log10(replay.p), n), np.bincount(document, (block.count > 0)[block.symbol], n).astype(np.int64)
            rows = [pa.array(block.ids, pa.int64(), mask=block.null), pa.array(block.held), pa.array(block.size), pa.array(known), pa.array(np.full(n, model.value.tokens, np.int64)), pa.array(base), pa.array(score)]
        give_memory_back()
        names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        return pa.table(rows or [pa.array([], t) for t in (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())], names)

    return run


def _divided(answers: DataFrame, model: Model, depth: int) -> None:
    """Put the divided contexts of a level together; there are at most 4 a bucket."""
    spark = answers.sparkSession
    parts = answers.filter(F.col("target") == TOTALS).mapInArrow(_listed(["key", "n", "after"]), "key long, n long, after long")
    found = parts.groupBy("key").agg(F.sum("n").alias("n"), F.sum("after").alias("after")).toArrow()
    key = found["key"].to_numpy().view(np.uint64)
    order = np.argsort(key)
    key, count, after = key[order], found["n"].to_numpy()[order], found["after"].to_numpy()[order]
    state = np.zeros(len(key), bool)
    if len(key):
        tested = answers.filter(F.col("target") == PARTS).mapInArrow(_test_parts(spark.sparkContext.broadcast((key, count, after))), "key long, worth double")
        worth = tested.groupBy("key").agg(F.sum("worth").alias("worth")).toArrow()
        total = np.zeros(len(key))
        total[look_up(key, worth["key"].to_numpy().view(np.uint64))] = worth["worth"].to_numpy()
        state = model.states(total, count)
    model.keys[depth], model.after[depth], model.state[depth] = key, after, state


def score_texts(docs: DataFrame, *, modulus: int = 5, held_out: int = 1, depth: int | None = None, least: int | None = None, gain: float | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Learn from the rows whose crc32(doc_id) % ``modulus`` is not ``held_out`` and score all rows.

    Returns doc_id, held_out, n_tokens, n_known (tokens seen in training), train_tokens, base_score (log10 probability
    of the text's tokens under the root alone) and score (under the tree).
    """
    spark = docs.sparkSession
    send = spark.sparkContext.broadcast
    out_of = F.coalesce(remainder(F.col(doc_id), modulus) == held_out, F.lit(False))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), out_of.alias("held_out"), F.col(text).alias("text"))
    # Few buckets: what a block asks of one is packed, and the more there are the less there is to pack.
    size, stored = size_in_bytes(docs), partitions_for(docs, STORED_BYTES)
    buckets = stored if size is None else max(1, -(-size // BUCKET_BYTES))
    told = rows.mapInArrow(_tell_words(buckets), "bucket int, data binary")
    counted = materialise(told.groupBy("bucket").applyInArrow(_count_words, COUNTED), "pst-words")
    tokens, distinct = counted.filter("kind = 'words'").agg(F.sum("n"), F.sum("distinct")).collect()[0]
    if tokens is None:
        return spark.createDataFrame([], SCORES)
    free_shuffles(spark)
    vocabulary = send(frequent_words(counted))
    texts, replies = Bucketed(spark, "block", stored, "pst-blocks"), Bucketed(spark, "target", stored, "pst-answers")
    try:
        blocks = texts.append(rows.mapInArrow(_encode(vocabulary), "block long, data binary"), gather=False)
        vocabulary.destroy()
        asks = blocks.mapInArrow(_ask_words(buckets), ASKS).groupBy("bucket").cogroup(counted.filter("kind = 'words'").groupBy("bucket"))
        answers = replies.append(asks.applyInArrow(_answer_words, ANSWERS))
        drop(counted)
        model = Model(DEPTH if depth is None else depth, buckets, tokens, distinct, min(P_MIN * tokens, LEAST if least is None else least), GAIN if gain is None else gain)
        for level in range(1, model.depth + 1):
            asks = blocks.groupBy("block").cogroup(answers.groupBy("target")).applyInArrow(_ask(send(model), level), ASKS)
            found = materialise(asks.groupBy("bucket").applyInArrow(_answer(send(model), level), ANSWERS), "pst-found")
            _divided(found, model, level)
            del asks
            free_shuffles(spark)
            answers = replies.append(found.filter("target >= 0"))
            drop(found)
            free_shuffles(spark)
        return blocks.groupBy("block").cogroup(answers.groupBy("target")).applyInArrow(_finish(send(model)), SCORES)
    finally:
        texts.close()
        replies.close()
