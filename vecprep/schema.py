"""Table shapes of the library.

A vector set is ``(ord BIGINT, vec ARRAY<FLOAT>)``: ``ord`` is the 0-based place in the data set and the identity of a
vector (DataFrames have no order of their own). Ground truth is wide ``(query_ord, ids)`` or long ``(query_ord, rank,
base_ord, score)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

VECTORS = T.StructType([T.StructField("ord", T.LongType(), False), T.StructField("vec", T.ArrayType(T.FloatType(), False), False)])
GROUND_TRUTH = T.StructType([T.StructField("query_ord", T.LongType(), False), T.StructField("ids", T.ArrayType(T.IntegerType(), False), False)])
NEIGHBORS = T.StructType([T.StructField("query_ord", T.LongType()), T.StructField("rank", T.IntegerType()), T.StructField("base_ord", T.LongType()), T.StructField("score", T.DoubleType())])
#: A permissive scan of ground truth: what was declared, what could be read, and the error that ended the file.
GROUND_TRUTH_SCAN = T.StructType([*GROUND_TRUTH.fields, T.StructField("declared", T.LongType()), T.StructField("error", T.StringType())])


def require(df: DataFrame, *columns: str) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing column(s) {', '.join(missing)}; there are {', '.join(df.columns)}")
    return df
