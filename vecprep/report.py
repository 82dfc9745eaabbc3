"""Text reports from collected report rows."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Sequence
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.names import bin_edge
from .operators import dedup, groundtruth, profile

ROWS = 20
IDS = 10


def write(path: str | Path, lines: Sequence[str]) -> None:
    Path(path).write_text("\n".join(lines) + "\n", encoding="utf-8")


def histogram_lines(rows: Sequence) -> list[str]:
    """``norm_histogram`` rows as a table."""
    out = ["Histogram:", f"{'from':>18} {'to':>18} {'count':>10}"]
    bins = sorted(rows, key=lambda r: r["bin"])
    real = [r for r in bins if r["bin"] >= 0]
    span = real[-1]["high"] - real[0]["low"] if real else 0.0
    largest = max((r["high"] for r in real), default=0.0)
    for r in bins:
        low, high = ("0 (exact)", "0 (exact)") if r["bin"] < 0 else (bin_edge(x, span, largest) for x in (r["low"], r["high"]))
        out.append(f"{low:>18} {high:>18} {r['cnt']:>10}")
    return out if real else [*out, "All vectors are zero."]


def write_histogram_png(path: str | Path, rows: Sequence, width: int = 800, height: int = 300) -> None:
    """``norm_histogram`` rows as bars over the logarithm of the norm, exact zeros as a red bar on the left."""
    canvas = np.full((height, width, 3), 255, np.uint8)
    canvas[-2:, :] = 0
    most, bins = max((r["cnt"] for r in rows), default=1), 1 + max((r["bin"] for r in rows), default=0)
    step = width / (bins + 1)
    for r in rows:
        left, top = int((r["bin"] + 1) * step), height - 2 - max(1, round(r["cnt"] / most * (height - 10)))
        canvas[top:-2, left : max(left + 1, int((r["bin"] + 2) * step) - 1)] = (200, 40, 40) if r["bin"] < 0 else (50, 90, 160)
    lines = b"".join(b"\0" + line.tobytes() for line in canvas)

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    Path(path).write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b""))


def vector_report(df: DataFrame, name: str, norm_tolerance: float, zero_tolerance: float, dims: int = 100) -> list[str]:
    """Summary, norm statistics and histogram of a vector set."""
    s = profile.summary(df, norm_tolerance, zero_tolerance).collect()[0]
    out = [f"File: {name}", f"Vectors: {s['total']}", f"Dimension: {s['dim'] if s['dim'] is not None else 0}"]
    if not s["total"]:
        return out
    first = s["first_vector"]
    out += [
        f"Normalized: {'Yes' if s['normalized'] else 'No'} (tolerance {norm_tolerance:g})",
        f"Zero vectors: {s['zero_count']} (tolerance {zero_tolerance:g})",
        f"Not of unit norm: {s['unnormalized']}",
        f"First vector: {first[:dims]}" + (f" ... ({dims} of {len(first)} components)" if len(first) > dims else ""),
        f"Norms: least {s['norm_min']:.6g}, greatest {s['norm_max']:.6g}, mean {s['norm_mean']:.6g}, greatest deviation from 1 {s['norm_max_deviation']:.6g}",
    ]
    return out + histogram_lines(profile.norm_histogram(df).collect())


def _some(rows: DataFrame, order: str, show) -> list[str]:
    """At most ``ROWS`` rows of a finding."""
    return [f"  Row {r[order]}: {show(r)}" for r in rows.orderBy(order).limit(ROWS).collect()]


def ground_truth_report(scan: DataFrame, name: str, k: int) -> tuple[bool, list[str]]:
    """Verdict and text of a validation; ``scan`` from a permissive read."""
    s = groundtruth.validate(scan, k).collect()[0]
    first = scan.filter("error IS NULL").orderBy("query_ord").limit(1).collect()
    out = [f"Ground truth: {name}", f"Rows read: {s['num_rows']}", f"Greatest row length: {s['max_row_length']}", f"Greatest id: {s['max_ordinal'] if s['max_ordinal'] is not None else 'N/A'}"]
    out.append(f"First row: {list(first[0]['ids'])[:ROWS]}" if first else "No complete row was read.")
    out.append("")
    verdict = lambda good, text: f"{'PASS' if good else 'FAIL'}: {text}"
    out.append(verdict(s["fatal_error"] is None, s["fatal_error"] or "the file was read to its end."))
    out.append(verdict(not s["duplicate_rows"], f"{s['duplicate_rows']} row(s) with repeated ids."))
    if s["duplicate_rows"]:
        listed = F.array_sort(F.collect_list(F.struct("id", "cnt")))
        rows = groundtruth.duplicate_ids(scan).groupBy("query_ord").agg(listed.alias("found"))
        out += _some(rows, "query_ord", lambda r: ", ".join(f"{x['id']} x{x['cnt']}" for x in r["found"][:IDS]) + (", ..." if len(r["found"]) > IDS else ""))
    out.append(verdict(not s["negative_rows"], f"{s['negative_rows']} row(s) with negative ids."))
    if s["negative_rows"]:
        out += _some(groundtruth.negative_ids(scan), "query_ord", lambda r: f"{r['cnt']} negative")
    for kind in ("short", "overlong"):
        n = s[f"{kind}_rows"]
        out.append(verdict(not n, f"{n} {kind} row(s) for k = {k}."))
        if n:
            out += _some(groundtruth.wrong_lengths(scan, k).filter(F.col("kind") == kind), "query_ord", lambda r: f"length {r['length']}")
    out += ["", f"OVERALL: {'PASS' if s['passed'] else 'FAIL'}"]
    return s["passed"], out


def duplicate_report(df: DataFrame, threshold: int = 1) -> list[str]:
    """Totals, how often vectors repeat, and the most frequent ones with their lines."""
    t = dedup.totals(df).collect()[0]
    out = [f"Vectors: {t['processed']}", f"Distinct: {t['unique']}", f"Removed: {t['removed']}", "", "Occurrences: distinct vectors"]
    # As many lines as there are different counts: below the square root of twice the number of vectors.
    out += [f"{r['cnt']}: {r['vectors']}" for r in dedup.histogram(df).orderBy(F.desc("cnt")).toLocalIterator()]
    best = dedup.top(df, threshold=threshold).collect()
    lines: dict[int, list[int]] = {}
    if best:
        wanted = [r["first_line"] for r in best]  # 100 at most
        for r in dedup.lines(df).filter(F.col("first_line").isin(wanted)).orderBy("first_line", "nth").collect():
            lines.setdefault(r["first_line"], []).append(r["line"])
    out += ["", f"Most frequent ({dedup.TOP} at most):"]
    return out + [f"{r['cnt']} x line {r['first_line']} {list(r['head'])}, also lines {lines.get(r['first_line'], [])}" for r in best]
