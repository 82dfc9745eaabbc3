"""Intermediate tables in the shared folder, and numbers of partitions that follow the input's size."""

from __future__ import annotations

import gc
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from ..tables import materialise, new_path, shared_dir, shuffle_partitions

__all__ = ["Bucketed", "drop", "free_shuffles", "materialise", "new_path", "partitions_for", "shared_dir", "size_in_bytes"]


def drop(df: DataFrame) -> None:
    """Delete a table of ``materialise`` that nothing will read again."""
    spark = df.sparkSession
    root = shared_dir(spark).removeprefix("file://")
    jvm = spark.sparkContext._jvm
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if root in folder:
            target = jvm.org.apache.hadoop.fs.Path(folder)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Bucketed:
    """A table in the shared folder whose rows of equal ``column`` lie in one of ``parts`` buckets, so that what is grouped by
    that column finds them without a shuffle. The catalog knows it until it is closed; its files stay."""

    def __init__(self, spark: SparkSession, column: str, parts: int, name: str):
        self.spark, self.column, self.path = spark, column, new_path(spark, name)
        self.parts = min(parts, int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets", "100000")))
        self.table = f"{name}_{uuid4().hex}".replace("-", "_")

    def append(self, df: DataFrame, gather: bool = True) -> DataFrame:
        """All rows so far. ``gather``: shuffle the rows first, so that they make one file a bucket, where any task may have
        rows of any bucket."""
        df = df.repartition(self.parts, self.column) if gather else df
        df.write.bucketBy(self.parts, self.column).option("path", self.path).mode("append").saveAsTable(self.table)
        return self.spark.table(self.table)

    def close(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")  # an external table


def free_shuffles(spark: SparkSession) -> None:
    """Have executors delete the shuffle files of finished stages whose results lie in tables by now. They stay until the
    driver's JVM finds that no plan refers to them, which it looks for when it is short of memory only."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def size_in_bytes(df: DataFrame) -> int | None:
    """Bytes of all that ``df`` reads, as Catalyst knows them; None if a source has no known size."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return None if any(s >= 1 << 60 for s in sizes) else sum(sizes)


def partitions_for(df: DataFrame, bytes_each: int = 16 << 20) -> int:
    """Buckets that hold about ``bytes_each`` of input, never fewer than the session's shuffle partitions."""
    return max(shuffle_partitions(df.sparkSession), min(-(-(size_in_bytes(df) or 0) // bytes_each), 1_000_000))
