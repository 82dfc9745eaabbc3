import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

public_tokenizers = pytest.importorskip("public_tokenizers")
from vecprep.llm import piece_sampling as P  # noqa: E402

MODEL = public_tokenizers.path("piece_bpe_32k.model")
AWKWARD = ["", None, " ", "a", "  two  spaces ", "line\nfeed\n\n\ttab\r\n", "▁literal ▁▁ sign", "漢字 と かな", "\U0001f600!\U0001f468‍\U0001f469", "é é", "\x00\x7f", "<s> </s> <0x41> <unk>", "x" * 5000, " " * 3000, "0123 45 6"]


@pytest.fixture(scope="module")
def pieces():
    return P.pieces_of(MODEL)


def round_trip(pieces, texts, keys=None):
    ids, at = P.sample_ids(pieces, np.arange(len(texts)) if keys is None else np.array(keys), pa.array(texts, pa.string()))
    data, where = P.decode_ids(pieces, ids, at)
    return ids, at, [data[a:b].tobytes().decode() for a, b in zip(where[:-1], where[1:], strict=True)]


def test_lossless(pieces):
    ids, at, texts = round_trip(pieces, AWKWARD)
    assert texts == [t or "" for t in AWKWARD]
    assert at[1] == at[2] == 0 and (ids >= 3).all()


@given(st.lists(st.text(max_size=30), max_size=5))
@settings(max_examples=150, deadline=None)
def test_any_text_is_lossless(texts):
    assert round_trip(P.pieces_of(MODEL), texts)[2] == texts


def test_a_chunk_longer_than_a_piece_of_hashing(pieces):
    text = "ab" * 300_000
    assert round_trip(pieces, [text, "x"])[2] == [text, "x"]


def test_the_library_decodes_ordinary_text_alike(pieces):
    processor = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    text = "The quick brown fox jumps over the lazy dog, twice."
    ids, at, _ = round_trip(pieces, [text] * 20)
    assert all(processor.decode(ids[a:b].tolist()) == text for a, b in zip(at[:-1], at[1:], strict=True))
    assert len({tuple(ids[a:b].tolist()) for a, b in zip(at[:-1], at[1:], strict=True)}) > 1


def test_segmentation_depends_on_key_and_text_only(pieces):
    texts = ["some words to cut up", "other words", "some words to cut up"]
    a, at, _ = round_trip(pieces, texts, [5, 6, 5])
    assert a[: at[1]].tolist() == a[at[2] :].tolist()
    b, bt, _ = round_trip(pieces, ["filler text", *texts[::-1]], [9, 5, 6, 5])
    assert b[bt[3] :].tolist() == a[: at[1]].tolist()


def brute_distribution(pieces, text):
    """Probability of every segmentation of a short text, from the model's scores."""
    processor = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    normal = {processor.id_to_piece(i).replace("▁", " "): i for i in range(processor.get_piece_size()) if not (processor.is_byte(i) or processor.is_control(i) or processor.is_unknown(i))}
    s, out = " " + text, {}

    def walk(at, ids, log):
        if at == len(s):
            out[tuple(ids)] = log
            return
        for end in range(at + 1, len(s) + 1):
            if (i := normal.get(s[at:end])) is not None:
                walk(end, [*ids, i], log + P.ALPHA * processor.get_score(i) - total)

    scores = [processor.get_score(i) for i in normal.values()]
    lowest = min(x for x in scores if x > P.UNRANKED)
    total = math.log(sum(math.exp(P.ALPHA * max(x, lowest)) for x in scores))
    walk(0, [], 0.0)
    z = sum(map(math.exp, out.values()))
    return {k: math.exp(v) / z for k, v in out.items()}


@pytest.mark.parametrize("text", ["the", "banana", "hello"])
def test_samples_follow_the_lattice(pieces, text):
    n = 20_000
    ids, at, _ = round_trip(pieces, [text] * n)
    seen = Counter(tuple(ids[a:b].tolist()) for a, b in zip(at[:-1], at[1:], strict=True))
    want = brute_distribution(pieces, text)
    assert set(seen) <= set(want)
    for k, p in want.items():
        assert abs(seen[k] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-4


def test_queries(documents, prose):
    rows = [(i, prose(30, i)) for i in range(30)] + [(100 + i, t) for i, t in enumerate(AWKWARD)] + [(None, "null id"), (7, prose(30, 7))]
    random.Random(1).shuffle(rows)
    df = documents(rows).withColumnsRenamed({"lang": "ids", "source": "lossless"}).repartition(3)
    found = P.sample_digests(df, MODEL).collect()
    assert len(found) == len(rows) and all(r["lossless"] for r in found)
    encoded = P.sampled_pieces(df, MODEL)
    back = P.decoded_texts(encoded, MODEL).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in back) == sorted((str(d), t or "") for d, t in rows)
    again = {(r["doc_id"], r["ids_crc32"]) for r in P.sample_digests(df.repartition(1), MODEL).collect()}
    assert again == {(r["doc_id"], r["ids_crc32"]) for r in found}
    assert P.sample_digests(documents([]), MODEL).collect() == []


def test_draws_are_equal_bit_by_bit_in_any_company(pieces, prose):
    """One chunk's shares, alone, after thousands of others and from a worker's memory."""
    text = "uncharacteristically"
    data = np.frombuffer(b" " + text.encode(), np.uint8)
    alone = P.Lattice()
    alone.add(pieces, data, np.array([0, len(data)]))
    others = [f" {w}" for w in set(prose(3000, 1, 2000).split())]
    joined = np.frombuffer("".join(others).encode() + data.tobytes(), np.uint8)
    begin = np.concatenate([[0], np.cumsum([len(w.encode()) for w in others]), [len(joined)]])
    many = P.Lattice()
    last = many.add(pieces, joined, begin)[-1]
    first = many.edge[last - len(data)]
    assert many.running[first:].tobytes() == alone.running.tobytes() and (many.piece[first:] == alone.piece).all()
    sampler, texts = P.Sampler(pieces), pa.array([prose(50, i) for i in range(40)] * 3)
    keys = np.arange(len(texts))
    once = [sampler.ids(keys, texts) for _ in range(3)]
    assert sampler.kept.nodes and all((a == once[0][0]).all() and (b == once[0][1]).all() for a, b in once[1:])
    small = [P.sample_ids(pieces, keys[i : i + 1], texts.slice(i, 1))[0] for i in range(len(texts))]
    assert (np.concatenate(small) == once[0][0]).all()


def test_memory_of_chunks_is_bounded(pieces, prose, monkeypatch):
    monkeypatch.setattr(P, "KEPT_NODES", 50)
    sampler = P.Sampler(pieces)
    for i in range(5):
        texts = pa.array([prose(80, 10 * i + k) for k in range(10)])
        ids, at = sampler.ids(np.arange(10), texts)
        assert sampler.kept.nodes <= 50 and (ids == P.sample_ids(pieces, np.arange(10), texts)[0]).all()
