"""From raw base and query vectors to ground truth: clean, shuffle, truncate, normalize, search."""

from __future__ import annotations

import argparse
import dataclasses
from collections.abc import Sequence
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vector as V
from ..operators import assemble, clean, knn, order
from ..sources.files import read_vectors
from ..sources.fvecs import write_fvecs
from ..sources.ivecs import write_ivecs
from ..tables import materialise

CONFIG_FOLDER = "yaml-configs"
TRUE = ("true", "yes", "on", "1")


@dataclass
class PrepConfig:
    """Settings of a run; a value 0 of ``num_base`` or ``num_query`` keeps all."""

    base: str = ""
    query: str = ""
    ground_truth_out: str = ""
    k: int = 0
    num_base: int = 0
    num_query: int = 0
    remove_zeros: bool = False
    shuffle: bool = False
    shuffle_seed: int = 42
    normalize: bool = False
    zero_tolerance: float = V.ZERO_TOLERANCE
    normalization_tolerance: float = V.NORM_TOLERANCE
    processed_base_out: str = ""
    processed_query_out: str = ""
    metric: str = "l2"
    #: Devices of other engines; accepted and without effect.
    gpus: str = "-1"

    def __post_init__(self) -> None:
        for f in dataclasses.fields(self):
            value, kind = getattr(self, f.name), {"int": int, "float": float, "bool": bool, "str": str}[str(f.type)]
            if kind is bool and isinstance(value, str):
                value = value.lower() in TRUE
            setattr(self, f.name, kind(value))  # YAML reads 1e-6 as text
        if self.zero_tolerance < 0 or self.normalization_tolerance < 0:
            raise ValueError("tolerances must not be negative")
        if self.metric not in knn.METRICS:
            raise ValueError(f"unknown metric '{self.metric}'; there are {', '.join(knn.METRICS)}")

    @property
    def changes(self) -> bool:
        return self.remove_zeros or self.normalize or self.shuffle or self.num_base > 0 or self.num_query > 0

    def check(self) -> PrepConfig:
        for name in ("base", "query", "ground_truth_out", "k"):
            if not getattr(self, name):
                raise ValueError(f"{name} is required")
        if self.changes and not (self.processed_base_out and self.processed_query_out):
            raise ValueError("processed_base_out and processed_query_out are required when vectors are changed")
        return self


def load_yaml(name: str) -> dict:
    """A flat mapping from a path, or from a file of that name in ``yaml-configs``."""
    import yaml

    path = next((p for p in (Path(name), Path(CONFIG_FOLDER) / name) if p.is_file()), None)
    if path is None:
        raise FileNotFoundError(name)
    content = yaml.safe_load(path.read_text()) or {}
    if not isinstance(content, dict):
        raise ValueError(f"{path}: the top level must be a mapping")
    return content


def parse(arguments: Sequence[str]) -> PrepConfig:
    """Command line over YAML over defaults."""
    parser = argparse.ArgumentParser(prog="vecprep knn")
    parser.add_argument("--config", default="")
    for f in dataclasses.fields(PrepConfig):
        kind = {"action": "store_true", "default": argparse.SUPPRESS} if str(f.type) == "bool" else {"default": argparse.SUPPRESS}
        if f.name == "metric":
            kind["choices"] = knn.METRICS
        parser.add_argument(f"--{f.name}", **kind)
    given = vars(parser.parse_args(arguments))
    config = given.pop("config")
    settings = load_yaml(config) if config else {}
    unknown = set(settings) - {f.name for f in dataclasses.fields(PrepConfig)}
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    return PrepConfig(**(settings | given)).check()


def prepare(df: DataFrame, config: PrepConfig, limit: int) -> tuple[DataFrame, bool]:
    """One side: zero removal, norm check on all rows, shuffle, truncation, normalization if the check failed.

    Returns the rows and whether they differ from the input.
    """
    norm = V.norm(F.col("vec"))
    kept = ~V.is_zero(norm, config.zero_tolerance) if config.remove_zeros else F.lit(True)
    unit_norm = V.is_unit(norm, config.normalization_tolerance) | ~kept if config.normalize else F.lit(True)
    total, left, unit = df.agg(F.count("*"), F.count_if(kept), F.coalesce(F.every(unit_norm), F.lit(True))).collect()[0]
    changed = left != total
    if config.remove_zeros:
        if left == 0:
            raise ValueError("no vector remains after zero removal")
        if changed:
            df = clean.remove_zeros(df, config.zero_tolerance, check=False)
    if config.shuffle:
        df, changed = order.shuffle(df, config.shuffle_seed), True
    if limit > left:
        raise ValueError(f"{limit} vectors were asked of {left}")
    if 0 < limit < left:
        df, changed = order.truncate(df, limit), True
    if not unit:
        df, changed = clean.normalize(df, config.zero_tolerance), True
    return df, changed


def ground_truth(base: DataFrame, query: DataFrame, config: PrepConfig) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Processed base and query and the long neighbours of each query."""
    x, y = assemble.dimension(base), assemble.dimension(query)
    if x != y:
        raise ValueError(f"dimensions differ: base {x}, query {y}")
    base, query = (materialise(prepare(df, config, n)[0], "prepared") for df, n in ((base, config.num_base), (query, config.num_query)))
    return base, query, knn.knn(base, query, config.k, config.metric)


def run(spark: SparkSession, config: PrepConfig) -> None:
    """Read, prepare, write the processed sides if anything was asked for, search, write the ground truth."""
    config.check()
    base, query, found = ground_truth(read_vectors(spark, config.base), read_vectors(spark, config.query), config)
    if config.changes:
        write_fvecs(base, config.processed_base_out)
        write_fvecs(query, config.processed_query_out)
    write_ivecs(knn.wide(found), config.ground_truth_out, k=config.k, pad=-1)
