"""Functions of generated variables: whatever isn't a finite number is missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import StatError


def number(value: Column | str | float) -> Column:
    return (F.col(value) if isinstance(value, str) else value if isinstance(value, Column) else F.lit(float(value))).cast("double")


def finite(c: Column) -> Column:
    return F.when(F.abs(c) < float("inf"), c)


def add(a, b) -> Column:
    return finite(number(a) + number(b))


def subtract(a, b) -> Column:
    return finite(number(a) - number(b))


def multiply(a, b) -> Column:
    return finite(number(a) * number(b))


def divide(a, b) -> Column:
    """Missing where b is zero."""
    return finite(F.try_divide(number(a), number(b)))


def power(a, b) -> Column:
    return finite(F.pow(number(a), number(b)))


def negate(a) -> Column:
    return -number(a)


def ln(a) -> Column:
    return finite(F.ln(number(a)))


def log(a) -> Column:
    """Base 10."""
    return finite(F.log10(number(a)))


def exp(a) -> Column:
    return finite(F.exp(number(a)))


def sqrt(a) -> Column:
    return finite(F.when(number(a) >= 0, F.sqrt(number(a))))


def absolute(a) -> Column:
    return F.abs(number(a))


def rounded(a) -> Column:
    """To the nearest integer, halves away from zero."""
    return F.signum(number(a)) * F.floor(F.abs(number(a)) + 0.5).cast("double")


#: Distinct values whose ranks may be broadcast.
BROADCAST_VALUES = 200_000
COMPARE = {"==": "eqNullSafe", "!=": "__ne__", ">": "__gt__", ">=": "__ge__", "<": "__lt__", "<=": "__le__"}


def condition(name: str, op: str, value: float) -> Column:
    """One comparison of a variable with a number; null where the variable is missing (NaN counts as missing)."""
    if op == "=":
        op = "=="
    if op not in COMPARE:
        raise StatError("syntax", f"'{op}' is no comparison.", f"Comparisons are {' '.join(COMPARE)}.", "Use one of them.")
    v = number(name)
    v = F.when(~F.isnan(v), v)
    return v == value if op == "==" else getattr(v, COMPARE[op])(F.lit(float(value)))


def standardized(df: DataFrame, value: Column) -> Column:
    """(x - mean) / sd over the non-missing rows of ``df``; missing if sd is zero or there are under two."""
    mean, sd = df.agg(F.avg(value), F.stddev_samp(value)).first()
    return finite((value - mean) / sd) if sd else F.lit(None).cast("double")


def with_rank(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with the average rank of ``value`` (1: smallest; ties share theirs; missing stays missing).

    Distinct values are counted and dealt by range; each range's running sum
    begins at the sum of the ranges before it, so no task sees all values. Few
    distinct values (by count) are broadcast to the rows, others joined.
    """
    from .order import running_total

    columns = [f"c{i}" for i in range(len(df.columns))]
    valued = df.withColumn("__value", value).toDF(*columns, "value")
    counts = valued.where(F.col("value").isNotNull() & ~F.isnan("value")).groupBy("value").agg(F.count("*").alias("n"))
    ranked = running_total(counts, ["value"], "n", "to").select(F.col("value").alias("key"), (F.col("to") - (F.col("n") - 1) / 2).cast("double").alias("rank"))
    ranked = F.broadcast(ranked) if ranked.count() <= BROADCAST_VALUES else ranked
    return valued.join(ranked, F.col("value") == F.col("key"), "left").select(*columns, "rank").toDF(*df.columns, name)
