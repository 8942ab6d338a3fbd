"""Scalar column helpers: missing-value policy, rounding and row-wise statistics."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def col(name: str) -> Column:
    """Reference a column whose name may hold hyphens or dots."""
    return F.col("`" + name.replace("`", "``") + "`")


def number(value: Column | str) -> Column:
    """Read a numeric expression as a double, with NaN as NULL."""
    value = col(value) if isinstance(value, str) else value
    return F.nanvl(value.cast("double"), F.lit(None).cast("double"))


def finite(value: Column | str) -> Column:
    """Read a numeric expression as a finite double; NaN and infinities are NULL."""
    value = number(value)
    return F.when(F.abs(value) != float("inf"), value)


def coerce_number(value: Column | str) -> Column:
    """Parse text or numbers to a double; whatever does not parse is NULL."""
    value = col(value) if isinstance(value, str) else value
    return number(value.try_cast("double"))


def nan_to_null(df: DataFrame) -> DataFrame:
    """Replace NaN by NULL in every floating column."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    if not floats:
        return df
    return df.select(*[number(c).alias(c) if c in floats else col(c) for c in df.columns])


def round_half_even(value: Column, digits: int = 4) -> Column:
    """Round by scaling and rounding half to even, as array libraries do."""
    scale = float(10**digits)
    return F.rint(value * F.lit(scale)) / F.lit(scale)


def round_floats(df: DataFrame, digits: int = 4) -> DataFrame:
    """Round every floating column of a table."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(*[round_half_even(col(c), digits).alias(c) if c in floats else col(c) for c in df.columns])


def _total(parts: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)


def _present(parts: Sequence[Column]) -> Column:
    return _total([F.when(p.isNotNull(), F.lit(1)).otherwise(F.lit(0)) for p in parts])


def row_mean(parts: Sequence[Column]) -> Column:
    """Mean over the non-null columns of a row; NULL when all are."""
    return F.try_divide(_total([F.coalesce(p, F.lit(0.0)) for p in parts]), _present(parts))


def row_sample_std(parts: Sequence[Column], mean: Column | None = None) -> Column:
    """Sample standard deviation over the non-null columns of a row; NULL below two values.

    Passing a computed ``mean`` column keeps the generated code small.
    """
    mean = row_mean(parts) if mean is None else mean
    squares = _total([F.coalesce((p - mean) * (p - mean), F.lit(0.0)) for p in parts])
    present = _present(parts)
    return F.when(present > 1, F.sqrt(F.try_divide(squares, present - 1)))


def row_range(parts: Sequence[Column]) -> Column:
    """Largest minus smallest non-null column of a row."""
    if len(parts) == 1:
        return parts[0] - parts[0]
    return F.greatest(*parts) - F.least(*parts)


def array_mean(values: Column) -> Column:
    """Mean of an array of doubles."""
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / F.size(values)


def array_sample_std(values: Column, mean: Column) -> Column:
    """Sample standard deviation of an array; 0 for a single member."""
    squares = F.aggregate(values, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean))
    return F.when(F.size(values) > 1, F.sqrt(F.try_divide(squares, F.size(values) - 1))).otherwise(F.lit(0.0))
