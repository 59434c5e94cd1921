"""Vector columns (arrays of float): repair, normalising and scores.

These are the exact per-row definitions. Jobs over whole stores use the
block-wise form in ``operators.vector_blocks``, which gives the same values.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the vector model.
NORM_FLOOR = 1e-12
WORST_SCORE = -1.0
SCORE_DECIMALS = 9


def is_bad(x: Column) -> Column:
    """NaN or infinite."""
    return F.isnan(x) | (F.abs(x) == float("inf"))


def bad_values(vec: Column) -> Column:
    """How many elements are NaN or infinite."""
    return F.size(F.filter(vec, is_bad))


def sanitize_rows(vec: Column) -> Column:
    """Zero the whole vector when any element is NaN or infinite."""
    zeros = F.transform(vec, lambda x: F.lit(0.0).cast("float"))
    return F.when(F.exists(vec, is_bad), zeros).otherwise(vec)


def sanitize_values(vec: Column) -> Column:
    """Zero only the elements that are NaN or infinite."""
    return F.transform(vec, lambda x: F.when(is_bad(x), F.lit(0.0).cast("float")).otherwise(x))


def l2_norm(vec: Column) -> Column:
    """Length of the vector, summed in double precision."""
    return F.sqrt(F.aggregate(vec, F.lit(0.0),
                              lambda acc, x: acc + x.cast("double") * x.cast("double")))


def l2_normalize(vec: Column) -> Column:
    """Scale to unit length; the zero vector stays zero."""
    norm = F.transform(F.array(l2_norm(vec)), lambda n: F.greatest(n, F.lit(NORM_FLOOR)))
    return F.transform(norm, lambda n: F.transform(
        vec, lambda x: (x.cast("double") / n).cast("float")))[0]


def sanitize_and_normalize(vec: Column) -> Column:
    return F.transform(F.array(sanitize_values(vec)), l2_normalize)[0]


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda acc, x: acc + x)


def clamp_score(score: Column) -> Column:
    """A score that is not finite becomes the worst one, so that it sorts last."""
    return F.when(is_bad(score), F.lit(WORST_SCORE)).otherwise(score)


def cosine_score(a: Column, b: Column) -> Column:
    """Dot product of unit vectors, to nine places.

    Stored vectors have float precision; rounding far below that keeps equal
    vectors at equal scores whatever order a sum is taken in.
    """
    return F.round(clamp_score(dot(a, b)), SCORE_DECIMALS)


def yes_no_probability(yes: Column, no: Column) -> Column:
    """P(yes) of a two-way softmax."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(no - yes))
