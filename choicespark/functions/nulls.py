"""Null, NaN and ANSI-safe column helpers.

The survey semantics come from pandas, where NaN is the missing marker, a
comparison with a missing value is False, ``clip`` keeps missing values and
row means skip them.  Spark's three-valued logic differs in each case, so
every operator goes through these helpers instead of raw expressions.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_pred(pred: Column) -> Column:
    """A predicate where unknown (null) counts as False (pandas mask rule)."""
    return F.coalesce(pred, F.lit(False))


def nan_to_null(c: str | Column) -> Column:
    """NaN is a missing value, not a number larger than everything."""
    x = col(c)
    return F.when(F.isnan(x), F.lit(None)).otherwise(x)


def nz(c: str | Column, replacement: float = 1) -> Column:
    """Replace an exact zero by ``replacement`` (guards a divisor); null stays null."""
    x = col(c)
    return F.when(x == 0, F.lit(replacement)).otherwise(x)


def guarded_ratio(num: str | Column, den: str | Column) -> Column:
    """``num / den`` with a zero divisor replaced by 1 (no ANSI divide-by-zero)."""
    return col(num).cast("double") / nz(den).cast("double")


def clip_keep_null(c: str | Column, lo: float, hi: float) -> Column:
    """``clip(lo, hi)`` that keeps null as null."""
    x = col(c)
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(lo)), F.lit(hi)))


def row_mean(cols: Iterable[str | Column]) -> Column:
    """Mean of the non-null values in a row; null when all are null."""
    cs = [col(c) for c in cols]
    total = sum((F.coalesce(c.cast("double"), F.lit(0.0)) for c in cs), F.lit(0.0))
    count = sum((F.when(c.isNotNull(), 1).otherwise(0) for c in cs), F.lit(0))
    return F.when(count > 0, total / count)


def zfill(c: str | Column, width: int = 4) -> Column:
    """Left-pad with zeros but never truncate (``str.zfill`` semantics for non-negatives)."""
    s = col(c).cast("string")
    return F.lpad(s, F.greatest(F.lit(width), F.length(s)), "0")


def try_int(c: str | Column) -> Column:
    """Integer cast that yields null instead of failing (ANSI on)."""
    return col(c).try_cast("int")


def default_int(c: str | Column, default: int) -> Column:
    return F.coalesce(try_int(c), F.lit(default))


def scaled(c: str | Column, scale: float = 1e6) -> Column:
    """Double → bigint at fixed precision, used where two engines must agree."""
    return F.round(col(c) * F.lit(scale)).cast("bigint")
