"""Simple-8b: 64-bit words that hold a selector and as many ids as fit, laid out for vectorised decoding.

A word is ``selector << 60 | payload``. Selectors 2-15 hold ``COUNT[s]`` values of ``WIDTH[s]`` bits, lowest first.
Selector 0 is the escape: its payload is an index into the block's list of raw 64-bit values, so that every word can
be read on its own. A block is cut into runs of ``RUN`` ids; each run starts a new word and the block stores at which,
so runs decode independently and a reader can start in the middle.

Layout of a block, little-endian: magic ``S8B1``, uint32 number of documents, uint64 numbers of ids, words and
escapes; int64 document ids, uint8 flags of null document ids, uint64 ends of the documents counted in ids, uint32
first word of each run, uint64 escapes, uint64 words.
"""

from __future__ import annotations

import struct

import numpy as np

MAGIC = b"S8B1"
RUN = 4096
COUNT = np.array([1, 0, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTH = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
_HEAD = struct.Struct("<4sIQQQ")


def _bits(ids: np.ndarray) -> np.ndarray:
    """Bits of each value; above 2**53 perhaps one too many, which costs space at most."""
    return np.frexp(ids.astype(np.float64))[1].astype(np.uint8)


def _selectors(bits: np.ndarray) -> np.ndarray:
    """For each place the selector that packs the most values from there on."""
    best, widest, have = np.zeros(len(bits), np.uint8), bits, 1
    for s in range(15, 1, -1):
        while have < COUNT[s]:
            step = min(have, int(COUNT[s]) - have)
            grown = widest.copy()
            np.maximum(grown[:-step], widest[step:], out=grown[:-step])
            widest, have = grown, have + step
        best[widest <= WIDTH[s]] = s
    return best


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, first word of each run, escapes."""
    ids = np.ascontiguousarray(ids, np.uint64)
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.uint64)
    best = _selectors(_bits(ids))
    place = np.arange(0, n, RUN)
    end = np.minimum(place + RUN, n)
    found = []
    while len(place):  # all runs in step
        found.append(place)
        place = place + COUNT[best[place]]
        go = place < end
        place, end = place[go], end[go]
    place = np.sort(np.concatenate(found))
    kind = best[place]
    words = kind.astype(np.uint64) << np.uint64(60)
    last = np.minimum((place // RUN + 1) * RUN, n)
    for s in range(2, 16):
        here = np.flatnonzero(kind == s)
        for j in range(int(COUNT[s]) if len(here) else 0):
            at = place[here] + j
            inside = at < last[here]
            words[here[inside]] |= ids[at[inside]] << np.uint64(j * WIDTH[s])
    raw = np.flatnonzero(kind == 0)
    words[raw] |= np.arange(len(raw), dtype=np.uint64)
    first = np.searchsorted(place, np.arange(0, n, RUN)).astype(np.uint32)
    return words, first, ids[place[raw]]


def decode(words: np.ndarray, first: np.ndarray, escapes: np.ndarray, n: int) -> np.ndarray:
    """The ids; runs need not be decoded together (cut ``words`` at ``first``)."""
    if not n:
        return np.zeros(0, np.uint64)
    kind = (words >> np.uint64(60)).astype(np.int64)
    count = COUNT[kind]
    total = np.cumsum(count) - count
    run = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(words)).astype(np.int64)))
    place = total - total[first.astype(np.int64)][run] + run * RUN
    out = np.zeros(n, np.uint64)
    last = np.minimum((run + 1) * RUN, n)
    for s in range(2, 16):
        here = np.flatnonzero(kind == s)
        mask = np.uint64((1 << int(WIDTH[s])) - 1)
        for j in range(int(COUNT[s]) if len(here) else 0):
            at = place[here] + j
            inside = at < last[here]
            out[at[inside]] = (words[here[inside]] >> np.uint64(j * WIDTH[s])) & mask
    raw = np.flatnonzero(kind == 0)
    out[place[raw]] = escapes[(words[raw] & np.uint64((1 << 60) - 1)).astype(np.int64)]
    return out


def write_block(doc_ids: list[int | None] | np.ndarray, ends: np.ndarray, ids: np.ndarray, null: np.ndarray | None = None) -> bytes:
    """One block; ``ends``: number of ids up to the end of each document."""
    doc_ids = np.asarray(doc_ids, np.int64)
    null = np.zeros(len(doc_ids), np.uint8) if null is None else np.asarray(null, np.uint8)
    words, first, escapes = encode(ids)
    head = _HEAD.pack(MAGIC, len(doc_ids), len(ids), len(words), len(escapes))
    parts = (doc_ids.astype("<i8"), null, np.asarray(ends).astype("<u8"), first.astype("<u4"), escapes.astype("<u8"), words.astype("<u8"))
    return head + b"".join(x.tobytes() for x in parts)


def read_block(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document ids, flags of null ids, ends, token ids."""
    magic, docs, n, n_words, n_escapes = _HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a Simple-8b block")
    at, got = _HEAD.size, []
    for kind, count in (("<i8", docs), ("u1", docs), ("<u8", docs), ("<u4", -(-n // RUN)), ("<u8", n_escapes), ("<u8", n_words)):
        got.append(np.frombuffer(data, kind, count, at))
        at += got[-1].nbytes
    doc_ids, null, ends, first, escapes, words = got
    return doc_ids, null, ends, decode(words, first, escapes, n)
