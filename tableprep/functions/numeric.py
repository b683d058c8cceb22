"""Numeric scalar functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed pattern of what counts as a number written as text: optional sign, digits with an
# optional fraction or a bare fraction, optional exponent, or inf/infinity; spaces around.
NUMERIC_TEXT = r"(?i)^\s*[+-]?((\d+(\.\d*)?|\.\d+)(e[+-]?\d+)?|inf|infinity)\s*$"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def to_numeric(col) -> Column:
    """Coerce text to DOUBLE; anything that is not a plain number becomes null.

    The regex guard keeps Java-only forms such as '1d' or '1f' out, and NaN reads as null.
    """
    c = _c(col).cast("string")
    parsed = F.when(c.rlike(NUMERIC_TEXT), F.trim(c).try_cast("double"))
    return nan_to_null(parsed)


def nan_to_null(col) -> Column:
    c = _c(col)
    return F.when(~F.isnan(c), c)


def clip(col, lower: float | None, upper: float | None) -> Column:
    """Clip to [lower, upper]; nulls stay null."""
    c = _c(col)
    out = c
    if upper is not None:
        out = F.least(out, F.lit(float(upper)))
    if lower is not None:
        out = F.greatest(out, F.lit(float(lower)))
    return F.when(c.isNotNull(), out)


def round_half_even(col, scale: int = 0) -> Column:
    return F.bround(_c(col), scale)


def safe_divide(a, b) -> Column:
    return F.try_divide(_c(a), _c(b))
