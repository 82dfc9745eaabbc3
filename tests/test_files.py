import struct
import sys
from pathlib import Path
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from vecprep import cli, report
from vecprep.operators import groundtruth, knn
from vecprep.plans import prep
from vecprep.sources import codec, files
from vecprep.sources.fvecs import read_fvecs, swap_endianness, vector_at, write_fvecs
from vecprep.sources.ivecs import read_ivecs, row_at, write_ivecs


def records(path, rows, kind="f", endian="<"):
    path.write_bytes(b"".join(struct.pack(f"{endian}i{len(r)}{kind}", len(r), *r) for r in rows))
    return str(path)


def content(df, key="ord", value="vec"):
    return [list(r[value]) for r in df.orderBy(key).collect()]


def test_fvecs_reads(spark, tmp_path):
    path = records(tmp_path / "a.fvecs", [[1, 2], [3, 4], [5, 6]])
    assert content(read_fvecs(spark, path)) == [[1, 2], [3, 4], [5, 6]]
    assert codec.layout(path) == codec.Layout(2, 3)
    assert content(read_fvecs(spark, path, ord_start=1, ord_end=2)) == [[3, 4]]
    assert vector_at(spark, path, 2) == [5, 6]
    for index in (3, -1):
        with pytest.raises(IndexError):
            vector_at(spark, path, index)
    assert content(files.read_vectors(spark, path)) == [[1, 2], [3, 4], [5, 6]]


def test_fvecs_splits_keep_order(spark, tmp_path):
    rows = [[i, i + 0.5] for i in range(1000)]
    path = records(tmp_path / "a.fvecs", rows)
    df = spark.read.format("fvecs").option("partition_bytes", "1200").load(path)
    assert df.rdd.getNumPartitions() == 10 and content(df) == rows


def test_fvecs_through_sparks_reader(spark, tmp_path):
    path = records(tmp_path / "a.fvecs", [[1, 2], [3, 4], [5, 6]], endian=">")
    from vecprep.sources import fvecs

    df = fvecs._read_remote(spark, f"file://{path}", "big", 1, None)
    assert content(df) == [[3, 4], [5, 6]]


@pytest.mark.parametrize(
    ("data", "message"),
    [
        (struct.pack("<i2fi3f", 2, 1, 2, 3, 3, 4, 5), "inconsistent dimension"),
        (struct.pack("<i1f", 2, 1), "truncated payload"),
        (struct.pack("<i", 0), "non-positive"),
        (b"\1\2", "truncated header"),
    ],
)
def test_malformed_fvecs(spark, tmp_path, data, message):
    (tmp_path / "a.fvecs").write_bytes(data)
    with pytest.raises(ValueError, match=message):
        read_fvecs(spark, str(tmp_path / "a.fvecs")).collect()


def test_inconsistent_dimension_of_a_whole_number_of_records(spark, tmp_path):
    (tmp_path / "a.fvecs").write_bytes(struct.pack("<i2fi2f", 2, 1, 2, 1, 3, 4))
    with pytest.raises(Exception, match="inconsistent dimension"):
        read_fvecs(spark, str(tmp_path / "a.fvecs")).collect()


def test_empty_file(spark, tmp_path):
    (tmp_path / "a.fvecs").write_bytes(b"")
    assert read_fvecs(spark, str(tmp_path / "a.fvecs")).count() == 0
    assert swap_endianness(spark, str(tmp_path / "a.fvecs"), str(tmp_path / "b.fvecs")) == 0


@pytest.mark.parametrize("endian", ["little", "big"])
def test_round_trip(spark, tmp_path, vectors, endian):
    rows = np.random.default_rng(1).standard_normal((200, 5)).astype(np.float32).tolist()
    path = str(tmp_path / "a.fvecs")
    write_fvecs(vectors(rows).repartition(7), path, endian)
    assert content(read_fvecs(spark, path, endian)) == rows
    assert [p.name for p in tmp_path.iterdir()] == ["a.fvecs"]


def test_swap_twice_is_the_identity(spark, tmp_path):
    a, b, c = (tmp_path / n for n in ("a.fvecs", "b.fvecs", "c.fvecs"))
    records(a, [[1.5, -2], [3, 4]])
    assert swap_endianness(spark, str(a), str(b)) == 2
    assert b.read_bytes() == struct.pack(">i2fi2f", 2, 1.5, -2, 2, 3, 4)
    swap_endianness(spark, str(b), str(c), "big")
    assert c.read_bytes() == a.read_bytes()
    with pytest.raises(ValueError, match="same file"):
        swap_endianness(spark, str(a), str(a))
    (tmp_path / "bad.fvecs").write_bytes(struct.pack("<i1f", 2, 1))
    with pytest.raises(ValueError):
        swap_endianness(spark, str(tmp_path / "bad.fvecs"), str(tmp_path / "out.fvecs"))
    assert not (tmp_path / "out.fvecs").exists()


def test_ivecs(spark, tmp_path):
    equal, ragged = records(tmp_path / "a.ivecs", [[0, 1, 2], [3, 4, 5]], "i"), records(tmp_path / "b.ivecs", [[0, 1], [2, 3, 4]], "i")
    assert content(read_ivecs(spark, equal), "query_ord", "ids") == [[0, 1, 2], [3, 4, 5]]
    assert content(read_ivecs(spark, ragged), "query_ord", "ids") == [[0, 1], [2, 3, 4]]
    assert row_at(spark, equal, 1) == [3, 4, 5]
    with pytest.raises(IndexError):
        row_at(spark, equal, 2)
    with pytest.raises(FileNotFoundError):
        read_ivecs(spark, str(tmp_path / "none.ivecs"))


def test_write_ivecs(spark, tmp_path):
    gt = spark.createDataFrame([(0, [5, 6]), (1, [7])], "query_ord long, ids array<long>")
    path = str(tmp_path / "a.ivecs")
    with pytest.raises(ValueError, match="pad"):
        write_ivecs(gt, path)
    write_ivecs(gt, path, k=3, pad=-1)
    assert content(read_ivecs(spark, path), "query_ord", "ids") == [[5, 6, -1], [7, -1, -1]]
    write_ivecs(gt, path, ragged=True)
    assert content(read_ivecs(spark, path), "query_ord", "ids") == [[5, 6], [7]]
    with pytest.raises(OverflowError):
        write_ivecs(spark.createDataFrame([(0, [2**31])], "query_ord long, ids array<long>"), path)


def scan(spark, tmp_path, data):
    (tmp_path / "gt.ivecs").write_bytes(data)
    return read_ivecs(spark, str(tmp_path / "gt.ivecs"), permissive=True)


def ivecs(*rows):
    return b"".join(struct.pack(f"<i{len(r)}i", len(r), *r) for r in rows)


def test_validation(spark, tmp_path):
    v = groundtruth.validate(scan(spark, tmp_path, ivecs([0, 1, 2], [3, 4, 5])), 3).collect()[0]
    assert v[:] == (2, 3, 5, 0, 0, 0, 0, None, True)
    s = scan(spark, tmp_path, ivecs([0, 1, 1, 2, 2, 2], [3, 4, 5, 6, 7, 8]))
    assert sorted(r[:] for r in groundtruth.duplicate_ids(s).collect()) == [(0, 1, 2), (0, 2, 3)]
    s = scan(spark, tmp_path, ivecs([0, -1, 2], [3, 4, -5]))
    assert sorted(r[:] for r in groundtruth.negative_ids(s).collect()) == [(0, 1), (1, 1)]
    s = scan(spark, tmp_path, ivecs([0, 1], [2, 3, 4], [5, 6, 7, 8]))
    assert sorted(r[:] for r in groundtruth.wrong_lengths(s, 3).collect()) == [(0, 2, "short"), (2, 4, "overlong")]
    assert groundtruth.validate(s, 3).collect()[0]["max_row_length"] == 4


@pytest.mark.parametrize(
    ("data", "rows", "error"),
    [
        (ivecs([0, 1, 2]) + struct.pack("<3i", 3, 7, 8), 1, "row 1"),
        (b"\1\2", 0, "reading dimension at row 0"),
        (struct.pack("<i", 0), 0, "non-positive vector dimension 0"),
    ],
)
def test_malformed_ground_truth(spark, tmp_path, data, rows, error):
    v = groundtruth.validate(scan(spark, tmp_path, data), 3).collect()[0]
    assert v["num_rows"] == rows and error in v["fatal_error"] and not v["passed"]
    assert v["max_ordinal"] == (2 if rows else None)


def test_missing_ground_truth(spark, tmp_path):
    v = groundtruth.validate(read_ivecs(spark, str(tmp_path / "no.ivecs"), permissive=True), 3).collect()[0]
    assert v["num_rows"] == 0 and "File not found" in v["fatal_error"]


def test_slice(spark):
    gt = spark.createDataFrame([(0, [5, 9, 1, 7]), (1, [9, 8]), (2, [-1, 3])], "query_ord long, ids array<int>")
    cut = groundtruth.slice_ids(gt, 8, 2)
    assert content(cut, "query_ord", "ids") == [[5, 1], [], [-1, 3]]
    assert groundtruth.short_count(cut, 2).collect()[0][0] == 1
    assert content(groundtruth.slice_ids(gt, 8, 2, drop_negative=True), "query_ord", "ids")[2] == [3]
    assert knn.long(cut).count() == 4


def test_finding_files(spark, tmp_path):
    for n in ("b.fvecs", "a.FVECS", "c.txt"):
        (tmp_path / n).write_bytes(b"")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "d.fvec").write_bytes(b"")
    assert len(files.find_files(str(tmp_path), (".fvecs", ".fvec"))) == 2
    assert len(files.find_files(str(tmp_path), (".fvecs", ".fvec"), recursive=True)) == 3
    spark.range(3).write.parquet(str(tmp_path / "p"))
    assert files.first_row(spark, str(tmp_path / "p"))[0] == ["id"]
    with pytest.raises(ValueError, match="key"):
        files.read_vectors(spark, "x.h5")
    with pytest.raises(ValueError, match="not an HDF5"):
        files.read_vectors(spark, "x.txt:data")


def test_first_row_is_of_the_first_file_by_name(spark, tmp_path):
    folder = tmp_path / "a table"
    folder.mkdir()
    for name, first, n in (("p0", 0, 0), ("p1", 7, 2), ("p2", 100, 5000), ("p3", 50, 900)):
        pq.write_table(pa.table({"id": pa.array(range(first, first + n), pa.int64())}), folder / f"{name}.parquet")
    assert files.first_row(spark, str(folder)) == (["id"], (7,))
    assert files.first_row(spark, str(folder / "p2.parquet"))[1]["id"] == 100
    assert files.first_row(spark, str(folder / "p0.parquet")) == (["id"], None)


def test_hdf5_without_the_package(spark, monkeypatch):
    monkeypatch.setitem(sys.modules, "h5py", None)
    with pytest.raises(ImportError, match="h5py"):
        files.read_vectors(spark, "x.h5:data")


def test_hdf5_keys():
    from vecprep.sources import hdf5

    good = SimpleNamespace(ndim=2, dtype=np.dtype("f4"))
    assert hdf5.is_candidate(good) and not hdf5.is_candidate(SimpleNamespace(ndim=1, dtype=np.dtype("f4"))) and not hdf5.is_candidate(SimpleNamespace())
    file = {"a": good, "t": SimpleNamespace(ndim=3, dtype=np.dtype("i4")), "s": SimpleNamespace(ndim=2, dtype=np.dtype("S3")), "g": SimpleNamespace()}
    assert hdf5.check_dataset(file, "f", "a") is good and hdf5.check_dataset(file, "f", "t", flatten=True)
    for key, message in (("x", "no 'x'"), ("t", "3 dimensions"), ("s", "numeric"), ("g", "data set")):
        with pytest.raises(ValueError, match=message):
            hdf5.check_dataset(file, "f", key)
    assert hdf5.split_uri("/a/b.hdf5:train") == ("/a/b.hdf5", "train")


def test_config(tmp_path, monkeypatch):
    (tmp_path / "yaml-configs").mkdir()
    (tmp_path / "yaml-configs" / "c.yaml").write_text("base: b\nquery: q\nk: 3\nground_truth_out: g\nzero_tolerance: 1e-6\nmetric: ip\n")
    monkeypatch.chdir(tmp_path)
    c = prep.parse(["--config", "c.yaml", "--k", "5"])
    assert (c.k, c.metric, c.zero_tolerance, c.shuffle_seed) == (5, "ip", 1e-6, 42)
    with pytest.raises(ValueError, match="processed"):
        prep.parse(["--config", "c.yaml", "--shuffle"])
    for bad in ({"zero_tolerance": -1}, {"metric": "cosine"}):
        with pytest.raises(ValueError):
            prep.PrepConfig(**bad)
    with pytest.raises(FileNotFoundError):
        prep.load_yaml("none.yaml")
    (tmp_path / "l.yaml").write_text("- 1\n")
    with pytest.raises(ValueError, match="mapping"):
        prep.load_yaml("l.yaml")


def test_preparation_of_files(spark, tmp_path):
    rng = np.random.default_rng(3)
    base, query = rng.random((40, 8)).astype("f4"), rng.random((4, 8)).astype("f4")
    base[5] = 0
    paths = {n: records(tmp_path / f"{n}.fvecs", x.tolist()) for n, x in (("base", base), ("query", query))}
    c = prep.PrepConfig(**paths, ground_truth_out=str(tmp_path / "gt.ivecs"), k=50, remove_zeros=True, normalize=True, metric="ip", processed_base_out=str(tmp_path / "pb.fvecs"), processed_query_out=str(tmp_path / "pq.fvecs"))
    prep.run(spark, c)
    x = np.delete(base, 5, 0).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert np.allclose(content(read_fvecs(spark, c.processed_base_out)), x, atol=1e-6)
    ids = content(read_ivecs(spark, c.ground_truth_out), "query_ord", "ids")
    assert all(len(r) == 50 and r[39:] == [-1] * 11 for r in ids)
    assert [r[0] for r in ids] == list(np.argmax(query.astype(float) @ x.T, axis=1))
    with pytest.raises(ValueError, match="were asked"):
        prep.prepare(read_fvecs(spark, paths["base"]), prep.PrepConfig(remove_zeros=True), 40)
    assert prep.prepare(read_fvecs(spark, paths["query"]), prep.PrepConfig(remove_zeros=True), 0)[1] is False


def test_command_line(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.chdir(tmp_path)
    a = records(tmp_path / "demo_128_alpha_2.fvecs", [[3, 4], [1, 0]])
    records(tmp_path / "demo_128_beta_3.fvecs", [[5, 6], [5, 6], [0, 0]])
    b = str(tmp_path / "demo_128_beta_3.fvecs")
    assert cli.main(["check", a]) == 0 and "Vectors: 2" in (tmp_path / "demo_128_alpha_2.fvecs_fvecs_check_report.txt").read_text()
    assert cli.main(["merge-directory", str(tmp_path), str(tmp_path / "out")]) == 0
    assert content(read_fvecs(spark, str(tmp_path / "out" / "demo_128_5.fvecs"))) == [[5, 6], [5, 6], [0, 0], [3, 4], [1, 0]]
    for arguments, expected in (
        (["dedup", b, "-o", "o.fvecs"], [[0, 0], [5, 6]]),
        (["dedup", b, "--presorted", "-o", "o.fvecs"], [[5, 6], [0, 0]]),
        (["sort", b, "-o", "o.fvecs"], [[0, 0], [5, 6], [5, 6]]),
        (["truncate", b, "1", "--output", "o.fvecs"], [[5, 6]]),
        (["remove-zeros", "--input", b, "--output", "o.fvecs"], [[5, 6], [5, 6]]),
        (["merge", a, b, "o.fvecs"], [[3, 4], [1, 0], [5, 6], [5, 6], [0, 0]]),
    ):
        assert cli.main(arguments) == 0
        assert content(read_fvecs(spark, str(tmp_path / "o.fvecs"))) == expected
    cli.main(["normalize", "--input", a, "--output", "n.fvecs"])
    assert np.allclose(content(read_fvecs(spark, str(tmp_path / "n.fvecs"))), [[0.6, 0.8], [1, 0]])
    cli.main(["shard", b, "2", "-o", str(tmp_path / "shards")])
    assert sorted(p.name for p in (tmp_path / "shards").iterdir()) == ["demo_128_beta_3_1_1.fvecs", "demo_128_beta_3_2_0.fvecs"]
    cli.main(["split", b, "--num_query", "1"])
    assert (tmp_path / "demo_128_beta_3_query_1.fvecs").exists() and (tmp_path / "demo_128_beta_3_base_2.fvecs").exists()
    with pytest.raises(FileExistsError):
        cli.main(["shuffle", b, "o.fvecs"])
    capsys.readouterr()
    cli.main(["get-vector", a, "0"])
    assert "[3.0, 4.0]" in capsys.readouterr().out
    cli.main(["duplicates", b])
    assert "Not sorted: line 3" in capsys.readouterr().out


def test_ground_truth_command(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.chdir(tmp_path)
    good = records(tmp_path / "sample.ivecs", [[0, 1, 2], [3, 4, 5]], "i")
    assert cli.main(["ivecs-check", good, "3"]) == 0 and "OVERALL: PASS" in (tmp_path / "sample_report.txt").read_text()
    (tmp_path / "bad.ivecs").write_bytes(struct.pack("<3i", 3, 7, 8))
    assert cli.main(["ivecs-check", str(tmp_path / "bad.ivecs"), "3"]) == 1 and "OVERALL: FAIL" in (tmp_path / "bad_report.txt").read_text()
    assert cli.main(["ivecs-check", good, "0"]) == 1
    with pytest.raises(SystemExit) as e:
        cli.main(["ivecs-check"])
    assert e.value.code == 2
    cli.main(["slice-ground-truth", good, "cut.ivecs", "4", "2"])
    assert content(read_ivecs(spark, str(tmp_path / "cut.ivecs")), "query_ord", "ids") == [[0, 1], [3]]
    noisy = read_ivecs(spark, records(tmp_path / "n.ivecs", [[1, 1, -2], [1, 2]], "i"), permissive=True)
    passed, lines = report.ground_truth_report(noisy, "n", 3)
    assert not passed and any("1 x2" in x for x in lines) and any("length 2" in x for x in lines)


def test_no_pairs(spark, tmp_path):
    records(tmp_path / "lonely.fvecs", [[1]])
    with pytest.raises(ValueError, match="no complete pairs"):
        cli.main(["merge-directory", str(tmp_path), str(tmp_path / "out")])


@pytest.fixture
def hdf5_file(spark, tmp_path, monkeypatch):
    """A file with two sets, one below a group, one of three dimensions and one of text, read through a stand-in package."""
    stand_in = str(Path(__file__).parent / "standins" / "h5py.py")
    spark.sparkContext.addPyFile(stand_in)
    monkeypatch.syspath_prepend(str(Path(stand_in).parent))
    monkeypatch.delitem(sys.modules, "h5py", raising=False)
    rng = np.random.default_rng(1)
    data = {"train": rng.random((300, 4), np.float32), "test": rng.random((20, 4)), "more/deep": rng.integers(0, 9, (7, 3)), "cube": rng.random((5, 2, 3)), "words": np.array(["a", "b"])}
    path = tmp_path / "sets_4.hdf5"
    with open(path, "wb") as f:
        np.savez(f, **data)
    yield str(path), data
    sys.modules.pop("h5py", None)


def test_hdf5_sets_are_read_in_parts(spark, hdf5_file, monkeypatch):
    from vecprep.sources import hdf5

    path, data = hdf5_file
    assert hdf5.dataset_keys(path) == ["more/deep", "test", "train"] and hdf5.dataset_keys(path, ["test"]) == ["test"]
    for key in ("train", "test", "more/deep"):
        assert np.array_equal(np.array(content(files.read_vectors(spark, f"{path}:{key}"))), data[key].astype(np.float32))
    assert np.array_equal(np.array(content(hdf5.read_hdf5(spark, path, "cube", flatten=True))), data["cube"].reshape(-1, 3).astype(np.float32))
    monkeypatch.setattr(hdf5, "PARTITION_BYTES", 16 * 40)
    monkeypatch.setattr(hdf5, "BATCH_BYTES", 16 * 7)
    reader = hdf5.Hdf5Reader({"path": path, "key": "train"})
    parts = reader.partitions()
    batches = [b for p in parts for b in reader.read(p)]
    assert len(parts) == 8 and [x for b in batches for x in b["ord"].to_pylist()] == list(range(300))
    assert np.array_equal(np.array([x for b in batches for x in b["vec"].to_pylist()], np.float32), data["train"])
    for key, message in (("none", "there is no"), ("more", "isn't a data set"), ("words", "isn't numeric"), ("cube", "3 dimensions")):
        with pytest.raises(Exception, match=message):
            hdf5.read_hdf5(spark, path, key).count()


def test_hdf5_commands(spark, hdf5_file, tmp_path, monkeypatch, capsys):
    path, data = hdf5_file
    monkeypatch.chdir(tmp_path)
    cli.main(["hdf5-to-fvecs", path, "--output-dir", str(tmp_path / "out" if (tmp_path / "out").mkdir() is None else "")])
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["sets_4_base_300.fvecs", "sets_4_query_20.fvecs"]
    assert np.array_equal(np.array(content(read_fvecs(spark, str(tmp_path / "out" / "sets_4_base_300.fvecs")))), data["train"])
    cli.main(["hdf5-check", path, "--key", "test", "--plot"])
    assert "Vectors: 20" in capsys.readouterr().out
    assert (tmp_path / "sets_4.hdf5_test_histogram.png").read_bytes().startswith(b"\x89PNG") and (tmp_path / "sets_4.hdf5_test_hdf5_check_report.txt").exists()
    assert cli.main(["check-all", str(tmp_path), "--kind", "hdf5"]) == 0
    assert (tmp_path / "sets_4.hdf5_more__deep_hdf5_check_report.txt").exists()


def test_remote_files_are_split_and_checked(spark, tmp_path):
    from vecprep.sources import fvecs, ivecs

    rows = [[i, i + 0.5] for i in range(500)]
    path = records(tmp_path / "a.fvecs", rows)
    spark.sparkContext._jsc.hadoopConfiguration().set("mapreduce.input.fileinputformat.split.maxsize", "1200")
    df = fvecs._read_remote(spark, f"file://{path}", "little", None, None)
    spark.sparkContext._jsc.hadoopConfiguration().unset("mapreduce.input.fileinputformat.split.maxsize")
    assert content(df) == rows
    lists = records(tmp_path / "g.ivecs", [[3, 1], [2, 9]], "i")
    assert content(ivecs._read_remote(spark, f"file://{lists}", "little", False), "query_ord", "ids") == [[3, 1], [2, 9]]
    assert ivecs._read_remote(spark, f"file://{lists}", "little", True).filter("error IS NULL AND declared = 2").count() == 2
    bad = records(tmp_path / "b.fvecs", [[1, 2], [3, 4, 5], [1, 2, 3, 4]])
    with pytest.raises(Exception, match="inconsistent dimension|[Pp]artial record"):
        fvecs._read_remote(spark, f"file://{bad}", "little", None, None).count()
    assert fvecs._read_remote(spark, f"file://{records(tmp_path / 'e.fvecs', [])}", "little", None, None).count() == 0


def test_shards_are_written_by_tasks(spark, tmp_path, vectors):
    from vecprep.sources.fvecs import write_shards

    rows = [[i, -i] for i in range(25)]
    names = write_shards(vectors(rows).repartition(5), str(tmp_path / "out"), 10, "x", endian="big")
    assert names == [("x_10_0.fvecs", 10), ("x_10_1.fvecs", 10), ("x_5_2.fvecs", 5)]
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == [n for n, _ in names]
    assert [v for n, _ in names for v in content(read_fvecs(spark, str(tmp_path / "out" / n), "big"))] == rows
    assert write_shards(vectors([]), str(tmp_path / "none"), 10, "x") == []
    with pytest.raises(ValueError, match="absolute"):
        write_shards(vectors(rows), "out", 10, "x")


def test_shuffle_without_a_seed(spark, tmp_path, capsys):
    path = records(tmp_path / "a.fvecs", [[i, i] for i in range(50)])
    for name in ("b", "c"):
        cli.main(["shuffle", path, str(tmp_path / f"{name}.fvecs")])
    a, b, c = (content(read_fvecs(spark, str(tmp_path / f"{n}.fvecs"))) for n in "abc")
    assert sorted(b) == sorted(c) == a and b != c and b != a


def test_shared_folder_is_required_off_local_mode(spark):
    from vecprep import tables

    conf = SimpleNamespace(get=lambda *_: None)
    context = SimpleNamespace(getCheckpointDir=lambda: None, master="yarn", applicationId="x")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        tables.shared_dir(SimpleNamespace(conf=conf, sparkContext=context))
