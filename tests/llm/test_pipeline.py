"""The stages against brute-force versions of what each must keep."""

import hashlib
import itertools
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

corpus_pipeline, public_tokenizers = (pytest.importorskip(m) for m in ("corpus_pipeline", "public_tokenizers"))
from vecprep.llm import minhash, piece_sampling, quality, toxicity  # noqa: E402

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_kept(texts, percent):
    """Least id of each component of documents that share ``percent`` of the union of their five-word shingles."""
    sets, parent = {}, {i: i for i in texts}
    for i, t in texts.items():
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set()

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(texts), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return [i for i in texts if find(i) == i]


def brute_copies(rows):
    """Ids of (id, source, words), each as often as the mix takes the document."""
    by = defaultdict(list)
    for i, source, size in rows:
        by[source].append((hashlib.md5(f"{i}:17".encode()).hexdigest(), i, size))
    names = sorted(by, key=lambda s: (s is None, s))
    total, weight = {s: sum(x[2] for x in by[s]) for s in names}, {s: (1, 2, 3)[k % 3] for k, s in enumerate(names)}
    target, open_, left = {}, set(names), sum(total.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 3 * total[s]}
        target |= {s: 3.0 * total[s] if s in full else level * weight[s] for s in (full or open_)}
        left -= sum(3 * total[s] for s in full)
        open_ = open_ - full if full else set()
    out = []
    for s in names:
        demand, start = int(target[s] + 0.5), 0
        passes = demand // total[s] if total[s] else 0
        for _, i, size in sorted(by[s]):
            rest = demand - passes * total[s] - start
            out += [i] * (passes + (rest > 0 and 2 * rest >= size))
            start += size
    return out


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    import pathlib

    if not pathlib.Path(DATA).exists():
        pytest.skip("no test tables")
    return DATA


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "near_duplicates", "mixing", "pieces"] and corpus_pipeline.ORACLE_SQL is None


def test_stages(spark, tables, tmp_path):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    labels, columns = spark.read.parquet(f"{tables}/labels.parquet"), docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, tables)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        ids = sorted(r["doc_id"] for r in out.select("doc_id").collect())
        if name == "quality":
            model = quality.train_quality(docs, labels)
            want = [r["doc_id"] for r in docs.collect() if model(_column(r["text"]))[0] >= 0.5]
        elif name == "toxicity":
            model = toxicity.train_toxicity(docs, labels)
            want = [r["doc_id"] for r in docs.collect() if model(_column(r["text"]))[0] < 0.5]
        elif name == "near_duplicates":
            want = brute_kept({r["doc_id"]: r["text"] for r in docs.collect()}, corpus_pipeline.SIMILAR_PERCENT)
        elif name == "mixing":
            want = brute_copies([(r["doc_id"], r["source"], len(WORD.findall(r["text"] or ""))) for r in docs.collect()])
        else:
            texts = {r["doc_id"]: r["text"] for r in docs.collect()}
            back = piece_sampling.decoded_texts(out, public_tokenizers.path(corpus_pipeline.PIECES)).collect()
            assert all(texts[r["doc_id"]] == r["text"] for r in back)
            want = [r["doc_id"] for r in docs.collect()]
        assert ids == sorted(want) and ids
        if name != "pieces":
            assert out.columns == columns
            docs = out
    rows = corpus_pipeline.run(spark, tables)
    assert sorted(r["doc_id"] for r in rows.select("doc_id").collect()) == ids


def _column(text):
    import pyarrow as pa

    return pa.array([text], pa.string())


def test_empty_tables_and_other_columns(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").limit(0).withColumn("size", F.lit("x"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, tables)
        assert out.count() == 0 and (name == "pieces" or out.columns == docs.columns)


def test_near_duplicates_from_four_fifths(spark):
    """Texts at Jaccard 0.80 and 0.83 are near-duplicates of the stage; those at 0.79 are not; op3's threshold is higher."""
    docs, shared = [], {0: 80, 1: 83, 2: 79}
    for family, both in shared.items():  # 104 words have 100 shingles; the texts share ``both`` of ``both`` + 2 * alone
        alone = {80: 10, 83: 8, 79: 11}[both]
        base = [f"f{family}w{i}" for i in range(both + 4)]
        docs += [(10 * family + k, " ".join(base + [f"f{family}t{k}x{i}" for i in range(alone)])) for k in (0, 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    kept = lambda rows: sorted(r["doc_id"] for r in rows.select("doc_id").collect())
    assert kept(corpus_pipeline.near_duplicates(spark, df, "")) == [0, 10, 20, 21]
    assert kept(minhash.near_duplicates(df).filter("kept")) == [0, 1, 10, 11, 20, 21]
