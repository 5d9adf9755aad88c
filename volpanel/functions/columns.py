"""Column helpers. Missing is NULL everywhere: NaN and infinities become NULL at every stage's edge."""

from __future__ import annotations

import math
from collections.abc import Iterable
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INFINITY = float("inf")


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: str | Column) -> Column:
    """True for a number that is neither NULL, NaN nor infinite; never NULL."""
    c = col(c)
    return c.isNotNull() & ~F.coalesce(F.isnan(c), F.lit(True)) & (F.abs(c) != INFINITY)


def clean(c: str | Column) -> Column:
    """The number, or NULL if it is not finite."""
    return F.when(finite(c), col(c))


def all_finite(names: Iterable[str]) -> Column:
    return reduce(and_, map(finite, names))


def blank(c: str | Column) -> Column:
    """True for NULL and for a string of white space; never NULL."""
    return col(c).isNull() | (F.trim(col(c)) == "")


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(or_, conditions)


def n_if(condition: Column) -> Column:
    return F.count_if(condition)


def share(condition: Column) -> Column:
    """100 times the mean of a condition."""
    return 100 * F.avg(condition.cast("double"))


def require(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """df, or ValueError naming the columns it lacks."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """df with doubles rounded; a negative zero becomes zero."""
    return df.select(*((F.round(c, digits) + F.lit(0.0)).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes))


def erfc(x: Column) -> Column:
    """Complementary error function of a column of numbers that are not negative.

    Below 2 the series of positive terms 2^n x^(2n+1) / (1 3 5 ... (2n+1)), above it the continued fraction from its 60th level up.
    """
    steps = lambda a, b: F.sequence(F.lit(a), F.lit(b))
    start = F.struct(x.alias("term"), x.alias("sum"))

    def add(acc: Column, n: Column) -> Column:
        term = acc["term"] * (2 * x * x / (2 * n + 1))
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

    density = F.exp(-x * x) / math.sqrt(math.pi)
    near = 1 - 2 * density * F.aggregate(steps(1, 60), start, add)["sum"]
    far = density / F.aggregate(steps(60, 1), x, lambda acc, n: x + (n / 2.0) / acc)
    return F.when(x < 2, near).otherwise(far)


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution function by built-in functions; NULL for NULL and NaN."""
    half = erfc(F.abs(z) / math.sqrt(2)) / 2
    return F.when(z.isNotNull() & ~F.isnan(z), F.when(z < 0, half).otherwise(1 - half))
