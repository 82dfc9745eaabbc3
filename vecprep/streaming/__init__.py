"""The row-wise operators on streams.

Norms, zero filters, normalization and slicing of neighbour lists hold no state, so the same column expressions run on
a streaming DataFrame as they are. Operators that number, sort, group or compare rows need the whole set and are batch
only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vector as V


def clean_stream(stream: DataFrame, zero_tolerance: float = V.ZERO_TOLERANCE, vec: str = "vec") -> DataFrame:
    """Vectors of a stream without zero-like ones, of unit norm, with the norm that they had."""
    rows = stream.withColumn("norm", V.norm(F.col(vec))).filter(~V.is_zero(F.col("norm"), zero_tolerance))
    return rows.withColumn(vec, V.normalize(F.col(vec), zero_tolerance))
