"""Number expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def to_number(c: Column, numeric: bool = False) -> Column:
    """Double value of a column, null where the text is not a plain number.

    The pattern keeps out texts that the JVM would accept, such as ``12d``.
    """
    if numeric:
        return c.cast("double")
    text = c.cast("string")
    return F.when(text.rlike(NUMBER), F.trim(text).try_cast("double"))


def strip_to_number(c: Column, drop: str = r"[$,\s]") -> Column:
    return to_number(F.regexp_replace(c.cast("string"), drop, ""))


def clamp(c: Column, lower, upper) -> Column:
    """Limit to [lower, upper]; nulls stay null (least/greatest skip nulls)."""
    limited = c
    if lower is not None:
        limited = F.greatest(limited, F.lit(lower))
    if upper is not None:
        limited = F.least(limited, F.lit(upper))
    return F.when(c.isNotNull(), limited)
