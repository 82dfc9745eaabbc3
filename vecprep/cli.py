"""Command line: ``python -m vecprep <command>``."""

from __future__ import annotations

import argparse
import random
import sys
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from . import report
from .functions import vector as V
from .operators import assemble, clean, dedup, groundtruth, order, profile
from .plans import prep
from .sources import codec
from .sources.files import find_files, first_row, read_vectors
from .sources.fvecs import read_fvecs, swap_endianness, vector_at, write_fvecs, write_shards
from .sources.hdf5 import dataset_keys, read_hdf5
from .sources.ivecs import read_ivecs, row_at, write_ivecs

FVECS = (".fvecs", ".fvec")
HDF5 = (".h5", ".hdf5")


def session() -> SparkSession:
    return SparkSession.builder.appName("vecprep").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def _beside(path: str, suffix: str) -> str:
    p = Path(path)
    return str(p.with_name(f"{p.stem}{suffix}{p.suffix}"))


def check(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = read_fvecs(spark, a.file, a.endian)
    lines = report.vector_report(rows, a.file, a.tol_norm, a.tol_zero, a.first_vector_dims)
    print("\n".join(lines))
    report.write(f"{a.file}_fvecs_check_report.txt", lines)
    if a.plot:
        report.write_histogram_png(f"{a.file}_histogram.png", profile.norm_histogram(rows).collect())


def hdf5_check(spark: SparkSession, a: argparse.Namespace) -> None:
    for key in dataset_keys(a.file, a.key):
        rows = read_hdf5(spark, a.file, key)
        lines = report.vector_report(rows, f"{a.file}:{key}", a.tol_norm, a.tol_zero)
        print("\n".join(lines))
        report.write(f"{a.file}_{report_key(key)}_hdf5_check_report.txt", lines)
        if a.plot:
            report.write_histogram_png(f"{a.file}_{report_key(key)}_histogram.png", profile.norm_histogram(rows).collect())


def report_key(key: str) -> str:
    from .functions.names import key_as_file_name

    return key_as_file_name(key)


def check_all(spark: SparkSession, a: argparse.Namespace) -> int:
    """Every file of a folder; the number of files that failed decides the exit code."""
    failed = 0
    for path in find_files(a.folder, HDF5 if a.kind == "hdf5" else FVECS, a.recursive):
        try:
            a.file = path
            (hdf5_check if a.kind == "hdf5" else check)(spark, a)
        except Exception as e:  # one bad file mustn't hide the others
            print(f"{path}: {e}", file=sys.stderr)
            failed += 1
    print(f"{failed} file(s) failed")
    return int(failed > 0)


def deduplicate(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = read_fvecs(spark, a.file, a.endian)
    kept = dedup.dedup_adjacent(rows) if a.presorted else order.sorted_ordinals(dedup.groups(rows), name="ord", ord="first_ord")
    write_fvecs(kept.select("ord", "vec"), a.output or _beside(a.file, "_dedup"), a.endian)
    lines = report.duplicate_report(rows, a.threshold)
    print("\n".join(lines))
    if a.report:
        report.write(a.report, lines)


def duplicates(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = read_fvecs(spark, a.file, a.endian)
    line = order.first_unsorted_bytes(rows).collect()[0][0]
    print("Sorted by bytes" if line is None else f"Not sorted by bytes: line {line}")
    line = order.first_unsorted(rows).collect()[0][0]
    print("Sorted" if line is None else f"Not sorted: line {line}")
    print("\n".join(report.duplicate_report(rows, a.threshold)))


def dedup_sorted(spark: SparkSession, a: argparse.Namespace) -> None:
    write_fvecs(dedup.dedup_sorted(read_fvecs(spark, a.file, a.endian)).select("ord", "vec"), a.output, a.endian)


def sort(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = order.sorted_ordinals(read_fvecs(spark, a.file, a.endian))
    write_fvecs(rows.selectExpr("sorted_ord AS ord", "vec"), a.output or _beside(a.file, "_sorted"), a.endian)


def split(spark: SparkSession, a: argparse.Namespace) -> None:
    query, base = assemble.split(read_fvecs(spark, a.file), a.num_query, a.num_base, a.seed)
    for name, part in (("query", query), ("base", base)):
        write_fvecs(part, _beside(a.file, f"_{name}_{part.count()}"))


def shard(spark: SparkSession, a: argparse.Namespace) -> None:
    for name, _ in write_shards(read_fvecs(spark, a.file), a.output, a.size, Path(a.file).stem):
        print(name)


def shuffle(spark: SparkSession, a: argparse.Namespace) -> None:
    if Path(a.output).exists():
        raise FileExistsError(a.output)
    seed = random.SystemRandom().randrange(2**31) if a.seed is None else a.seed
    print(f"seed {seed}")
    write_fvecs(order.shuffle(read_fvecs(spark, a.file), seed), a.output)


def truncate(spark: SparkSession, a: argparse.Namespace) -> None:
    count = codec.layout(a.file).count
    if count < a.num_base:
        print(f"warning: {a.file} has {count} vectors only", file=sys.stderr)
    write_fvecs(read_fvecs(spark, a.file, ord_end=a.num_base), a.output or _beside(a.file, f"_{min(count, a.num_base)}"))


def normalize(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = read_fvecs(spark, a.input)
    before = profile.norm_errors(rows).collect()[0]
    done, changed = clean.normalize_if_needed(rows, 0.0, a.tolerance)
    after = profile.norm_errors(done).collect()[0]
    print(f"{'Normalized' if changed else 'Of unit norm already'}: greatest and mean error {before[0]:g}, {before[1]:g} before, {after[0]:g}, {after[1]:g} after")
    write_fvecs(done, a.output)


def remove_zeros(spark: SparkSession, a: argparse.Namespace) -> None:
    write_fvecs(clean.remove_zeros(read_fvecs(spark, a.input), a.tolerance), a.output)


def swap(spark: SparkSession, a: argparse.Namespace) -> None:
    print(f"{swap_endianness(spark, a.input, a.output, a.input_endian)} vectors")


def merge(spark: SparkSession, a: argparse.Namespace) -> None:
    write_fvecs(assemble.concat(read_fvecs(spark, a.a), read_fvecs(spark, a.b)), a.output)


def merge_directory(spark: SparkSession, a: argparse.Namespace) -> None:
    files = {Path(p).name: p for p in find_files(a.input, FVECS)}
    pairs, alone = assemble.pair_files(list(files))
    for name in alone:
        print(f"unmatched: {name}")
    if not pairs:
        raise ValueError("no complete pairs found")
    Path(a.output).mkdir(parents=True, exist_ok=True)
    for prefix, names in pairs.items():
        shapes = {n: codec.layout(files[n]) for n in names}
        if len({s.dim for s in shapes.values() if s.count}) > 1:
            raise ValueError(f"dimension mismatch for prefix '{prefix}'")
        first, second = sorted(names, key=lambda n: (-shapes[n].count, n))
        total = sum(s.count for s in shapes.values())
        target = str(Path(a.output) / f"{prefix}_{total}.fvecs")
        write_fvecs(assemble.concat(read_fvecs(spark, files[first]), read_fvecs(spark, files[second])), target)
        if codec.layout(target).count != total:
            raise ValueError(f"{target} is incomplete")
        print(target)


def get_vector(spark: SparkSession, a: argparse.Namespace) -> None:
    print(vector_at(spark, a.file, a.line, a.endian))


def get_row(spark: SparkSession, a: argparse.Namespace) -> None:
    print(row_at(spark, a.file, a.row))


def hdf5_to_fvecs(spark: SparkSession, a: argparse.Namespace) -> None:
    for name, key in (("query", a.query_key), ("base", a.base_key)):
        rows: DataFrame = read_hdf5(spark, a.file, key)
        write_fvecs(rows, str(Path(a.output_dir) / f"{Path(a.file).stem}_{name}_{rows.count()}.fvecs"))


def ivecs_check(spark: SparkSession, a: argparse.Namespace) -> int:
    """Report in the working folder; exit code 1 on any finding."""
    try:
        k = int(a.k)
        if k <= 0:
            raise ValueError("k must be positive")
        passed, lines = report.ground_truth_report(read_ivecs(spark, a.file, permissive=True), a.file, k)
    except ValueError as e:
        passed, lines = False, [f"Ground truth: {a.file}", f"FAIL: invalid k: {e}", "", "OVERALL: FAIL"]
    print("\n".join(lines))
    report.write(f"{Path(a.file).stem}_report.txt", lines)
    return int(not passed)


def slice_ground_truth(spark: SparkSession, a: argparse.Namespace) -> None:
    cut = groundtruth.slice_ids(read_ivecs(spark, a.input), a.max_base, a.k, a.drop_negative)
    print(f"{groundtruth.short_count(cut, a.k).collect()[0][0]} queries have fewer than {a.k} neighbours")
    write_ivecs(cut, a.output, ragged=True)


def head(spark: SparkSession, a: argparse.Namespace) -> None:
    columns, row = first_row(spark, a.file)
    print(", ".join(columns))
    print(row)


def count(spark: SparkSession, a: argparse.Namespace) -> None:
    print(read_vectors(spark, a.uri).count())


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="vecprep")
    commands = top.add_subparsers(dest="command", required=True)

    def add(name: str, run, *arguments: tuple) -> argparse.ArgumentParser:
        p = commands.add_parser(name)
        p.set_defaults(run=run)
        for names, options in arguments:
            p.add_argument(*names.split(), **options)
        return p

    text = lambda n, **o: (n, o)
    endian = text("--endian -e", choices=("little", "big"), default="little")
    norm, zero = text("--tol-norm", type=float, default=V.NORM_TOLERANCE), text("--tol-zero", type=float, default=V.ZERO_TOLERANCE)
    dims, key = text("--first-vector-dims", type=int, default=100), text("--key", action="append", default=[])
    limit, seed = text("--threshold -n", type=int, default=1), text("--seed", type=int, default=42)
    plot = text("--plot", action="store_true")
    add("check", check, text("file"), endian, norm, zero, dims, plot)
    add("hdf5-check", hdf5_check, text("file"), key, text("--tol-norm", type=float, default=V.CHECK_NORM_TOLERANCE), zero, plot)
    add("check-all", check_all, text("folder"), text("--kind", choices=("fvecs", "hdf5"), default="fvecs"), text("--recursive", action="store_true"), endian, norm, zero, dims, key, plot)
    add("dedup", deduplicate, text("file"), limit, endian, text("--output -o"), text("--report -r"), text("--presorted", action="store_true"))
    add("duplicates", duplicates, text("file"), limit, endian)
    add("dedup-sorted", dedup_sorted, text("file"), text("--output -o", required=True), endian)
    add("sort", sort, text("file"), endian, text("--output -o"))
    add("split", split, text("file"), text("--num_query", type=int, default=10_000), text("--num_base", type=int), seed)
    add("shard", shard, text("file"), text("size", type=int), text("--output -o", required=True))
    add("shuffle", shuffle, text("file"), text("output"), text("--seed", type=int))
    add("truncate", truncate, text("file"), text("num_base", type=int), text("--output"))
    add("normalize", normalize, text("--input", required=True), text("--output", required=True), text("--tolerance", type=float, default=V.CHECK_NORM_TOLERANCE))
    add("remove-zeros", remove_zeros, text("--input", required=True), text("--output", required=True), text("--tolerance", type=float, default=0.0))
    add("swap-endianness", swap, text("input"), text("output"), text("--input-endian", choices=("little", "big"), default="little"))
    add("merge", merge, text("a"), text("b"), text("output"))
    add("merge-directory", merge_directory, text("input"), text("output"))
    add("get-vector", get_vector, text("file"), text("line", type=int), endian)
    add("get-row", get_row, text("file"), text("row", type=int))
    add("hdf5-to-fvecs", hdf5_to_fvecs, text("file"), text("--query-key", default="test"), text("--base-key", default="train"), text("--output-dir", default="."))
    add("ivecs-check", ivecs_check, text("file"), text("k"))
    add("slice-ground-truth", slice_ground_truth, text("input"), text("output"), text("max_base", type=int), text("k", type=int), text("--drop-negative", action="store_true"))
    add("head", head, text("file"))
    add("count", count, text("uri"))
    return top


def main(arguments: Sequence[str] | None = None) -> int:
    arguments = list(sys.argv[1:] if arguments is None else arguments)
    if arguments[:1] == ["knn"]:
        prep.run(session(), prep.parse(arguments[1:]))
        return 0
    a = parser().parse_args(arguments)
    return a.run(session(), a) or 0
