"""Token-id output: documents in ascending id order as Simple-8b blocks, and reading them back.

``write_token_files`` range-partitions the documents by id, encodes them and writes one row per block
(part, block, n_ids, data) through Spark, so the files lie wherever Spark can write. ``read_token_digests`` reads them
back and gives per document its place among all ids, its number of ids and their CRC-32. A tokenizer whose rules are those
of ``word_bpe_49k.json`` encodes distinct fragments of text once; any other encodes text by text.

Null or empty text: the end id alone. Null document ids sort first and stay null. Repeated rows each keep a row; ties
on the id are ordered by text. An empty table gives no blocks and no rows. Other columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import simple8b
from .storage import materialise, new_path, partitions_for
from .text import byte_runs, mix, segment_hashes, string_buffers

END_ID = 1
# The rules of the tokenizer file under which fragments may be encoded one by one.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [SPLIT, BYTE_LEVEL]}
SUFFIX = "</w>"
#: Bytes of text in a block at most (a longer document makes a block of its own).
BLOCK_BYTES = 6 << 20
#: Fragments that a Python worker remembers between blocks.
CACHE = 1_500_000
BLOCKS = "part int, block int, n_ids long, data binary"

# Byte classes: 0 white space, 1 letter, 2 digit, 3 punctuation, 4 anything else.
_CLASS = np.full(256, 4, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[65:91] = _CLASS[97:123] = 1
_CLASS[48:58] = 2
_CLASS[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'"]] = 3
#: Whether a fragment ends between two bytes, by 5 * class of the first + class of the second.
_CUT = np.array([0 in (a, b) or a == b == 2 or a != b and 4 not in (a, b) for a in range(5) for b in range(5)])


def byte_classes(data: np.ndarray) -> np.ndarray:
    """Class of each byte; both bytes of U+00C0-U+00FF other than the two signs there count as letters."""
    kind = _CLASS[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    tail = data[lead + 1]
    lead = lead[(tail >= 0x80) & (tail <= 0xBF) & (tail != 0x97) & (tail != 0xB7)]
    kind[lead] = kind[lead + 1] = 1
    return kind


def by_fragments(path: str) -> bool:
    """Whether a tokenizer file has the rules that ``FragmentEncoder`` relies on."""
    with open(path, encoding="utf-8") as f:
        rules = json.load(f)
    model = rules["model"]
    return (
        rules.get("normalizer") == NORMALIZER
        and rules.get("pre_tokenizer") == PRE_TOKENIZER
        and (model.get("type"), model.get("end_of_word_suffix"), model.get("dropout"), model.get("continuing_subword_prefix")) == ("BPE", SUFFIX, None, None)
        and not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or t.get("normalized") for t in rules.get("added_tokens", []))
    )


class TextEncoder:
    """Encodes text by text with the library, whatever its rules."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        texts = [data[a:b].tobytes().decode(errors="replace") for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        ids = [np.array([*x.ids, END_ID], np.uint32) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate(ids) if ids else np.zeros(0, np.uint32), np.cumsum([len(x) for x in ids], dtype=np.int64)


class FragmentEncoder:
    """Encodes distinct fragments with the library once and gathers their ids for every occurrence.

    The tokenizer drops white space, splits letters from digits and punctuation and merges inside those pieces only,
    so a text's ids are its fragments' ids in order. Bytes whose class doesn't settle a split (apostrophes, most
    non-ASCII characters) stay joined to their neighbours; a word that holds a special token is left whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.final = np.zeros(max(vocab.values()) + 1, bool)
        self.final[[i for t, i in vocab.items() if t.endswith(SUFFIX)]] = True
        self.forget()

    def forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.begin, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def fragments(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends, whether each has one class only, whether it must not be folded."""
        kind = byte_classes(data)
        cut = np.ones(len(data) + 1, bool)
        cut[1:-1] = _CUT[kind[:-1] * np.uint8(5) + kind[1:]]
        cut[offsets] = True
        raw, spans = data.tobytes(), []
        for token in self.special:
            at = raw.find(token)
            while at >= 0:
                spans.append((at, at + len(token)))
                at = raw.find(token, at + 1)
        space = np.flatnonzero(kind == 0) if spans else None
        whole = np.zeros(len(data), bool)
        for a, b in spans:  # the word around a special token
            i = np.searchsorted(space, a)
            j = np.searchsorted(offsets, a, "right")
            lo = max(int(space[i - 1]) + 1 if i else 0, int(offsets[j - 1]))
            hi = min(int(space[i]) if i < len(space) else len(data), int(offsets[j]) if j < len(offsets) else len(data))
            if b <= hi:
                cut[lo + 1 : hi] = False
                whole[lo:hi] = True
        edge = np.flatnonzero(cut)
        starts, ends = edge[:-1], edge[1:]
        solid = kind[starts] != 0 if len(starts) else np.zeros(0, bool)
        starts, ends = starts[solid], ends[solid]
        mixed = np.zeros(len(data) + 1, np.uint32)
        np.cumsum((kind == 4) | whole, out=mixed[1:], dtype=np.uint32)
        return starts, ends, mixed[ends] == mixed[starts], whole[starts]

    def encode_new(self, texts: list[bytes], plain: np.ndarray) -> list[np.ndarray]:
        out: list[np.ndarray] = [None] * len(texts)  # type: ignore[list-item]
        fast = np.flatnonzero(plain)
        slow = list(np.flatnonzero(~plain))
        for i in range(0, len(fast), 2000):
            part = fast[i : i + 2000]
            ids = np.array(self.tokenizer.encode(b" ".join(texts[k] for k in part).decode(), add_special_tokens=False).ids, np.uint32)
            last = np.flatnonzero(self.final[np.minimum(ids, len(self.final) - 1)]) + 1
            if len(last) == len(part) and (not len(ids) or last[-1] == len(ids)):
                for k, x in zip(part, np.split(ids, last[:-1]), strict=True):
                    out[k] = x
            else:
                slow.extend(part)
        for i in range(0, len(slow), 2000):
            part = slow[i : i + 2000]
            for k, x in zip(part, self.tokenizer.encode_batch_fast([texts[k].decode(errors="replace") for k in part], add_special_tokens=False), strict=True):
                out[k] = np.array(x.ids, np.uint32)
        return out

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts with their end ids, and where each text's ids end."""
        starts, ends, plain, raw = self.fragments(data, offsets)
        keys = segment_hashes(data, starts, ends)
        if raw.any():
            keys[raw] = mix(segment_hashes(data, starts[raw], ends[raw], fold=False))
        unique, index, inverse = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.keys) > CACHE:
            self.forget()
        at = np.searchsorted(self.keys, unique)
        known = np.zeros(len(unique), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == unique[inside]
        new = index[~known]
        texts = [data[a:b].tobytes() if r else data[a:b].tobytes().lower() for a, b, r in zip(starts[new], ends[new], raw[new], strict=True)]
        got = self.encode_new(texts, plain[new])
        size = np.fromiter(map(len, got), np.int64, len(got))
        begin = len(self.ids) + np.cumsum(size) - size
        self.ids = np.concatenate([self.ids, *got]) if got else self.ids
        spots = at[~known]
        self.keys, self.begin, self.size = np.insert(self.keys, spots, unique[~known]), np.insert(self.begin, spots, begin), np.insert(self.size, spots, size)
        at = np.searchsorted(self.keys, unique)
        size, begin = self.size[at][inverse], self.begin[at][inverse]
        doc = np.searchsorted(offsets, starts, "right") - 1
        n_docs = len(offsets) - 1
        per_doc = np.bincount(doc, size, minlength=n_docs).astype(np.int64) + 1 if len(doc) else np.ones(n_docs, np.int64)
        doc_ends = np.cumsum(per_doc)
        out = np.full(int(doc_ends[-1]) if n_docs else 0, END_ID, np.uint32)
        target = np.cumsum(size) - size + doc
        step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        out[np.repeat(target, size) + step] = self.ids[np.repeat(begin, size) + step]
        return out, doc_ends


_ENCODERS: dict[str, FragmentEncoder | TextEncoder] = {}


def encoder(path: str) -> FragmentEncoder | TextEncoder:
    """One per Python worker and vocabulary."""
    if path not in _ENCODERS:
        _ENCODERS[path] = (FragmentEncoder if by_fragments(path) else TextEncoder)(path)
    return _ENCODERS[path]


def _block_writer(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, encode = TaskContext.get().partitionId(), 0, encoder(path)
        for batch in batches:
            key, text = batch.column(0), batch.column(1)
            for i, j in byte_runs(text, BLOCK_BYTES):
                data, offsets = string_buffers(text.slice(i, j - i))
                ids, ends = encode(data, offsets)
                keys = key.slice(i, j - i)
                raw = simple8b.write_block(keys.fill_null(0).to_numpy(zero_copy_only=False), ends, ids, keys.is_null().to_numpy(zero_copy_only=False))
                yield pa.record_batch([pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([raw], pa.binary())], ["part", "block", "n_ids", "data"])
                block += 1

    return run


def write_token_files(docs: DataFrame, vocabulary: str, target: str, *, doc_id: str = "doc_id", text: str = "text") -> None:
    """Write the ids of ``docs`` below ``target``; ``vocabulary`` is the tokenizer's file, present on every machine."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    order = F.col("doc_id").asc_nulls_first()
    rows = rows.repartitionByRange(partitions_for(docs), order).sortWithinPartitions(order, F.col("text").asc_nulls_first())
    rows.mapInArrow(_block_writer(vocabulary), BLOCKS).write.parquet(target)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, block, _, data in zip(*(batch.column(k) for k in range(4)), strict=True):
            doc_ids, null, ends, ids = simple8b.read_block(data.as_buffer())
            ends = ends.astype(np.int64)
            starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
            raw = memoryview(ids.astype("<u4")).cast("B")
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts, ends, strict=True)]
            n = len(doc_ids)
            yield pa.record_batch(
                [pa.array([part.as_py()] * n, pa.int32()), pa.array([block.as_py()] * n, pa.int32()), pa.array(doc_ids, pa.int64(), mask=null.astype(bool)), pa.array(starts), pa.array(ends - starts), pa.array(crc, pa.int64())],
                ["part", "block", "doc_id", "inner", "n_tokens", "ids_crc32"],
            )


def read_token_digests(spark: SparkSession, source: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document in the files below ``source``.

    Running totals are taken part by part over one small row a block, and over one row a part; documents then meet their
    block's total.
    """
    blocks = spark.read.schema(BLOCKS).parquet(source)
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = parts.select(F.col("part").alias("of"), F.coalesce(F.sum("n").over(earlier(Window.orderBy("part"))), F.lit(0)).alias("before_part"))
    inside = F.coalesce(F.sum("n_ids").over(earlier(Window.partitionBy("part").orderBy("block"))), F.lit(0))
    before = blocks.select("part", "block", inside.alias("inside")).join(parts, F.col("part") == F.col("of")).select("part", "block", (F.col("before_part") + F.col("inside")).alias("base"))
    docs = blocks.mapInArrow(_digests, "part int, block int, doc_id long, inner long, n_tokens long, ids_crc32 long")
    return docs.join(before, ["part", "block"]).select("doc_id", _long(F.col("base") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")


def _long(c: Column) -> Column:
    return c.cast("long")


def token_files(spark: SparkSession, docs: DataFrame, vocabulary: str) -> DataFrame:
    """Write ``docs`` into the shared folder, read the files back and give a digest per document."""
    target = new_path(spark, "tokens")
    write_token_files(docs, vocabulary, target)
    return materialise(read_token_digests(spark, target), "token-digests")
