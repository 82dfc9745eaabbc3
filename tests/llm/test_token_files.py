import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from vecprep.llm import token_files as T  # noqa: E402
from vecprep.llm.text import string_buffers  # noqa: E402

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
AWKWARD = [
    "It's DON'T i'm 'tis o'neil's 12345 a1b2 x²½ é! É. ¿Qué?…! …!a",
    " nb　x İstanbul ΣΑΣ ẞ ﬁ K Å Å!! \x1c\x85z ÄÖÜ ×÷ ×a!b÷ ‍👍🏽!! \x00a",
    "<|endoftext|> a<|startoftext|>B. <|ENDOFTEXT|> x <|endoftext|><|endoftext|>y",
    "don''t '' 'S 'Re you'LL",
    "",
    None,
    " \n",
    "a" * 3000,
]


@pytest.fixture(scope="module")
def reference():
    tokenizer = Tokenizer.from_file(VOCABULARY)
    return lambda t: [*tokenizer.encode(t or "", add_special_tokens=False).ids, T.END_ID]


def encoded(texts):
    ids, ends = T.encoder(VOCABULARY)(*string_buffers(pa.array(texts, pa.string())))
    return [x.tolist() for x in np.split(ids, ends[:-1])]


def test_equals_the_library(reference):
    rng = random.Random(3)
    noise = ["".join(rng.choices("aB'’!.,1 é×ß́  …Σ¿<|>\t\nſẞ㍿ﬃ²", k=60)) for _ in range(400)]
    texts = AWKWARD + noise
    assert encoded(texts) == [reference(t) for t in texts]


def test_cache_is_bounded_and_harmless(reference, monkeypatch):
    monkeypatch.setattr(T, "CACHE", 5)
    for k in range(4):
        texts = [f"word{k} other{k} same, same. {j}" for j in range(5)]
        assert encoded(texts) == [reference(t) for t in texts]


def test_files(documents, prose, reference):
    rows = [(i, prose(40, i)) for i in range(0, 120, 3)] + [(1000 + i, t) for i, t in enumerate(AWKWARD)] + [(9, "again one"), (None, "null id"), (2**40, "far")]
    random.Random(2).shuffle(rows)
    df = documents(rows).withColumnsRenamed({"lang": "data", "source": "part"}).repartition(3)
    found = T.token_files(df.sparkSession, df, VOCABULARY).orderBy("start").collect()
    assert len(found) == len(rows)
    at, texts = 0, {}
    for d, t in rows:
        texts.setdefault(d, []).append(t)
    for r in found:
        ids = next(x for x in map(reference, texts[r["doc_id"]]) if len(x) == r["n_tokens"] and zlib.crc32(np.array(x, "<u4").tobytes()) == r["ids_crc32"])
        assert r["start"] == at
        at += len(ids)
    order = [r["doc_id"] for r in found]
    assert order[0] is None and order[1:] == sorted(order[1:])


def test_repeated_rows_long_texts_and_no_rows(documents, prose, reference, monkeypatch):
    monkeypatch.setattr(T, "BLOCK_BYTES", 1000)
    rows = [(1, prose(20_000, 1)), (1, "x"), (1, "x"), (0, "y")]
    found = T.token_files((df := documents(rows)).sparkSession, df, VOCABULARY).orderBy("start").collect()
    assert [r["doc_id"] for r in found] == [0, 1, 1, 1] and sum(r["n_tokens"] for r in found) == sum(len(reference(t)) for _, t in rows)
    assert T.token_files(df.sparkSession, documents([]), VOCABULARY).collect() == []


def test_other_tokenizers_are_encoded_text_by_text(tmp_path, documents):
    """One that keeps case: its rules aren't those that fragments rely on."""
    import json

    assert T.by_fragments(VOCABULARY)
    with open(VOCABULARY, encoding="utf-8") as f:
        rules = json.load(f)
    rules["normalizer"] = {"type": "NFC"}
    path = tmp_path / "cased.json"
    path.write_text(json.dumps(rules), encoding="utf-8")
    assert not T.by_fragments(str(path))
    own = Tokenizer.from_file(str(path))
    rows = [(i, t) for i, t in enumerate(AWKWARD)]
    df = documents(rows)
    found = T.token_files(df.sparkSession, df, str(path)).orderBy("doc_id").collect()
    want = [[*own.encode(t or "", add_special_tokens=False).ids, T.END_ID] for _, t in rows]
    assert [r["ids_crc32"] for r in found] == [zlib.crc32(np.array(x, "<u4").tobytes()) for x in want]
    assert [r["start"] for r in found] == [sum(map(len, want[:i])) for i in range(len(want))]


def test_ties_on_the_id_go_by_text(documents, reference):
    texts = ["b", "a", None, "c", ""]
    df = documents([(5, t) for t in texts]).repartition(3)
    found = T.token_files(df.sparkSession, df, VOCABULARY).orderBy("start").collect()
    want = [reference(t) for t in sorted(texts, key=lambda t: (t is not None, t or ""))]
    assert [r["ids_crc32"] for r in found] == [zlib.crc32(np.array(x, "<u4").tobytes()) for x in want]
