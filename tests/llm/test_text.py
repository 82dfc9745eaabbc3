import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vecprep.llm import simple8b
from vecprep.llm import text as T


def plain(s):
    return (s or "").encode().lower().split()


@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB \t\né\x0b\x1cß​ı", max_size=20)), max_size=8))
@settings(max_examples=200, deadline=None)
def test_words_are_those_of_split(texts):
    hashes, at = T.words(pa.array(texts, pa.string()))
    assert np.diff(at).tolist() == [len(plain(t)) for t in texts]
    seen = {}
    for i, t in enumerate(texts):
        for h, w in zip(hashes[at[i] : at[i + 1]].tolist(), plain(t), strict=True):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_words_longer_than_a_piece(monkeypatch):
    long = "a" * (T._PIECE * 2 + 5)
    h, at = T.words(pa.array([f"{long} b {long}", "b", long + "c"]))
    assert at.tolist() == [0, 3, 4, 5] and h[0] == h[2] and h[1] == h[3] and len(set(h.tolist())) == 3


@given(st.lists(st.integers(0, 2**64 - 1)), st.booleans())
@settings(max_examples=100, deadline=None)
def test_pack(values, delta):
    a = np.array(sorted(values) if delta else values, np.uint64)
    assert (T.unpack(T.pack(a, delta)) == a).all()
    b, c = T.unpack_many(T.pack_many(a, np.array([1.5, -2.0]), delta=(0,) if delta else ()))
    assert (b == a).all() and c.tolist() == [1.5, -2.0]


@pytest.mark.parametrize("bits", [1, 4, 15, 16, 31, 60, 64])
@pytest.mark.parametrize("n", [0, 1, 59, 4095, 4096, 4097, 9000])
def test_simple8b(n, bits):
    rng = np.random.default_rng(n + bits)
    ids = rng.integers(0, 2**bits, n, dtype=np.uint64) >> rng.integers(0, bits, n).astype(np.uint64) if bits < 64 else rng.integers(0, 2**64, n, dtype=np.uint64)
    words, first, escapes = simple8b.encode(ids)
    assert (simple8b.decode(words, first, escapes, n) == ids).all()
    if n > simple8b.RUN:  # a run decodes on its own
        a, b = int(first[1]), int(first[2]) if len(first) > 2 else len(words)
        size = min(simple8b.RUN, n - simple8b.RUN)
        assert (simple8b.decode(words[a:b], np.zeros(1, np.uint32), escapes, size) == ids[simple8b.RUN : simple8b.RUN + size]).all()


def test_simple8b_is_dense_and_its_block_round_trips():
    words, _, escapes = simple8b.encode(np.ones(6000, np.uint64))
    assert len(words) <= 103 and not len(escapes)
    docs, null, ends, ids = simple8b.read_block(simple8b.write_block([5, 0], [2, 3], [7, 2**63, 1], [0, 1]))
    assert docs.tolist() == [5, 0] and null.tolist() == [0, 1] and ends.tolist() == [2, 3] and ids.tolist() == [7, 2**63, 1]
    with pytest.raises(ValueError):
        simple8b.read_block(b"x" * 40)
