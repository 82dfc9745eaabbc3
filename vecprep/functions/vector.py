"""Column builders: norms, products, normalization and tests on vectors.

Sums run over components in order, in double precision, so that they equal a SQL engine's sequential sums bit by bit.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZERO_TOLERANCE = 1e-6
NORM_TOLERANCE = 1e-5
CHECK_NORM_TOLERANCE = 1e-3


def _sum(values: Column, term) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, x: total + term(x))


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def floats(v: Column) -> Column:
    """Any numeric array as 32-bit components."""
    return v.cast("array<float>")


def norm(v: Column) -> Column:
    """Euclidean norm."""
    return F.sqrt(_sum(v, lambda x: x.cast("double") * x.cast("double")))


def dot(a: Column, b: Column) -> Column:
    """Inner product."""
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), lambda x: x)


def squared_distance(a: Column, b: Column) -> Column:
    """Squared Euclidean distance: orders like the distance."""
    return _sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), lambda x: x)


def normalize(v: Column, zero_tolerance: float = ZERO_TOLERANCE) -> Column:
    """Unit length in 32-bit components; a vector whose norm is at most the tolerance stays as it is."""
    n = norm(v)
    divisor = F.when(n <= zero_tolerance, F.lit(1.0)).otherwise(n)
    # The divisor goes in as an array: inside the lambda it would be computed anew for every component.
    return F.zip_with(v, F.array_repeat(divisor, F.size(v)), lambda x, m: (x.cast("double") / m).cast("float"))


def cosine(a: Column, b: Column) -> Column:
    """Inner product of the normalized vectors."""
    return dot(normalize(a), normalize(b))


def is_zero(n: Column, tolerance: float = ZERO_TOLERANCE, inclusive: bool = True) -> Column:
    """Whether a norm counts as zero: at most the tolerance, or strictly below it."""
    return n <= tolerance if inclusive else n < tolerance


def norm_deviation(n: Column) -> Column:
    return F.abs(n - F.lit(1.0))


def is_unit(n: Column, tolerance: float = NORM_TOLERANCE, inclusive: bool = False) -> Column:
    """Whether a norm counts as 1: within the tolerance, strictly or not."""
    return norm_deviation(n) <= tolerance if inclusive else norm_deviation(n) < tolerance


def prefix(v: Column, n: int) -> Column:
    """The first ``n`` components."""
    return F.slice(v, 1, n)


def has_nan(v: Column) -> Column:
    return F.exists(v, F.isnan)


def flatten_rows(tensor: Column) -> Column:
    """Rows of a nested array whose leading dimensions are flattened by one."""
    return F.explode(tensor)


def ids_below(ids: Column, limit: int, drop_negative: bool = False) -> Column:
    """Neighbour ids below ``limit`` in their order; negative ones (padding) pass unless asked otherwise."""
    return F.filter(ids, lambda x: (x < limit) & (x >= 0) if drop_negative else x < limit)
