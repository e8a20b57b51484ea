"""Summaries, frequency tables, histograms and correlations."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import StatError, too_few
from ..functions.dist import t_p
from ..functions.order import ranked, running_total
from ..plans.moments import moments
from ..plans.select import distincts, quantiles
from ..plans.staging import stage
from .frame import check_names, check_numeric, complete_cases, fresh, has_value, numeric_names

#: Rows from which columns are dealt to all cores if few tasks would read them again and again.
SPREAD_ROWS = 200_000
#: Distinct values that one task may order.
FEW_VALUES = 100_000
QUARTILES = (0.25, 0.5, 0.75)
SUMMARY = "variable string, n long, missing long, mean double, sd double, variance double, min double, max double, sum double, q1 double, median double, q3 double, skewness double, kurtosis double, distinct long"


def summarize(df: DataFrame, names: list[str] | None = None, compat: bool = False) -> DataFrame:
    """A row for each variable; each variable loses its own missing rows only.

    One aggregation gives all figures but exact quartiles and distinct counts.
    Quartiles (of type 7) come from brackets that sketches of ranks give and
    counts prove; distinct values from partial sets, of whole numbers as bits.
    Skewness and kurtosis are the adjusted G1 and G2;
    compat: skewness as n m3 / ((n-1)(n-2) m2^1.5) with sums' means, once published so.
    """
    names = names or numeric_names(df)
    check_numeric(df, names)
    xs, facts = [valued(df, name) for name in names], []
    for x in xs:
        facts += [F.count(x), F.var_samp(x), F.min(x), F.max(x), F.sum(x), F.skewness(x), F.kurtosis(x), F.bool_and(x == F.rint(x))]
    (task,) = fresh(df.columns, "task")
    tasks = F.bit_count(F.bit_or(F.col(task))).alias("tasks")
    row = df.withColumn(task, F.expr("shiftleft(1L, spark_partition_id() % 63)")).agg(F.count("*"), *(f.alias(f"f{i}") for i, f in enumerate(facts)), tasks).first()
    cores = df.sparkSession.sparkContext.defaultParallelism
    if row[0] >= SPREAD_ROWS and row["tasks"] < min(cores, 63) // 2:  # few tasks have all rows, as of a file in one piece: several passes follow
        df = stage(df.select(*(x.alias(f"x{i}") for i, x in enumerate(xs))).repartition(cores), "columns")
        xs = [F.col(f"x{i}") for i in range(len(xs))]
    figures = [row[1 + i * 8 : 9 + i * 8] for i in range(len(names))]
    quartiles = quantiles(df, xs, [f[0] for f in figures], QUARTILES)
    unique = distincts(df, xs, [(f[0], f[2], f[3], f[7]) for f in figures])
    out = []
    for name, (n, var, low, high, total, g, k, _), q, distinct in zip(names, figures, quartiles, unique):
        skew = None if n < 3 or g is None or not var else (g * n / ((n - 1) * (n - 2)) if compat else g * math.sqrt(n * (n - 1)) / (n - 2))
        kurt = None if n < 4 or k is None or not var else (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * k + 6)
        out.append((name, n, row[0] - n, total / n if n else None, math.sqrt(var) if n > 1 else None, var if n > 1 else None, low, high, total, *q, skew, kurt, distinct))
    return df.sparkSession.createDataFrame(out, SUMMARY)


def valued(df: DataFrame, name: str):
    return F.when(has_value(df, name), F.col(f"`{name}`").cast("double"))


def frequency(df: DataFrame, name: str) -> DataFrame:
    """value, count, percent and cumulative percent; most frequent first, then by value; missing is a value."""
    check_names(df, [name])
    value = F.coalesce(F.when(has_value(df, name), F.col(name).cast("string")), F.lit("(missing)"))
    counts = df.groupBy(value.alias("value")).agg(F.count("*").alias("count"))
    total, distinct = counts.agg(F.coalesce(F.sum("count"), F.lit(0)), F.count("*")).first()
    if distinct <= FEW_VALUES:
        before = Window.orderBy(F.desc("count"), "value").rowsBetween(Window.unboundedPreceding, 0)
        upto = counts.withColumn("upto", F.sum("count").over(before))
    else:
        upto = running_total(counts.withColumn("less", -F.col("count")), ["less", "value"], "count", "upto")
    return upto.select("value", "count", (100.0 * F.col("count") / total).alias("percent"), (100.0 * F.col("upto") / total).alias("cumulative"))


def scatter(df: DataFrame, x: str, y: str) -> DataFrame:
    """Pairs in which both numbers are finite."""
    check_numeric(df, [x, y])
    pairs = df.select(F.col(x).cast("double").alias(x), F.col(y).cast("double").alias(y))
    return pairs.where((F.abs(x) < float("inf")) & (F.abs(y) < float("inf")))


def histogram(df: DataFrame, name: str, bins: int = 24) -> DataFrame:
    """bin, start and count of equal-width bins over the finite values; the last one is closed, empty ones are kept."""
    check_numeric(df, [name])
    x = F.col(name).cast("double")
    valued = df.select(F.when(F.abs(x) < float("inf"), x).alias("x")).where("x is not null")
    low, high = valued.agg(F.min("x"), F.max("x")).first()
    if low is None:
        return df.sparkSession.createDataFrame([], "bin int, start double, count long")
    width = (high - low) / bins or 1.0
    counts = valued.groupBy(F.least(F.floor((F.col("x") - low) / width), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("count"))
    every = df.sparkSession.createDataFrame([(i, low + i * width) for i in range(bins)], "bin int, start double")
    return every.join(counts, "bin", "left").select("bin", "start", F.coalesce("count", F.lit(0)).alias("count"))


def correlate(df: DataFrame, names: list[str] | None = None, spearman: bool = False) -> DataFrame:
    """var1, var2, r, p and n of all pairs, over rows complete in all variables; ranks are taken after that."""
    names = names or numeric_names(df)
    if len(names) < 2:
        raise StatError("invalid_request", "A correlation needs two variables.", f"{len(names)} given.", "Name at least two numeric variables.")
    check_numeric(df, names)
    rows = complete_cases(df, names)
    m = moments(ranked(rows, names), names, shift=np.zeros(len(names))) if spearman else moments(rows, names)
    if m.n < 2:
        raise too_few("A correlation", 2, m.n)
    out = []
    for i, a in enumerate(names):
        for j, b in enumerate(names):
            scale = math.sqrt(m.cross[i, i] * m.cross[j, j]) if m.cross[i, i] > 0 and m.cross[j, j] > 0 else 0.0
            r = 1.0 if i == j else float(np.clip(m.cross[i, j] / scale, -1, 1)) if scale else None
            p = None if i == j or r is None or m.n <= 2 else 0.0 if abs(r) == 1 else t_p(r * math.sqrt((m.n - 2) / (1 - r * r)), m.n - 2)
            out.append((a, b, r, p, m.n))
    return df.sparkSession.createDataFrame(out, "var1 string, var2 string, r double, p double, n long")
