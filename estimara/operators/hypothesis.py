"""t-tests and one-way analysis of variance, from counts, means and variances."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import StatError, too_few
from ..functions.dist import f_upper, t_p, t_quantile
from .frame import check_names, check_numeric, complete_cases, is_text

TTEST = "kind string, label1 string, n1 long, mean1 double, sd1 double, label2 string, n2 long, mean2 double, sd2 double, diff double, se double, t double, df double, p double, ci_low double, ci_high double"


def group_label(df: DataFrame, group: str):
    """Groups are told apart, and ordered, as text; whole numbers have no decimals."""
    c = F.col(group)
    return c if is_text(df, group) else F.when(c.cast("double") == F.rint(c.cast("double")), c.cast("long").cast("string")).otherwise(c.cast("string"))


def _result(df: DataFrame, kind: str, one: tuple, two: tuple, diff: float, se: float, df_t: float, against: float = 0.0) -> DataFrame:
    if not se:
        raise StatError("not_identified", "The test isn't defined.", "The data don't vary.", "Check the variables.")
    t, half = (diff - against) / se, t_quantile(0.975, df_t) * se
    return df.sparkSession.createDataFrame([(kind, *one, *two, float(diff), float(se), float(t), float(df_t), t_p(t, df_t), diff - half, diff + half)], TTEST)


def _moments(df: DataFrame, value) -> tuple[int, float, float]:
    return tuple(df.agg(F.count(value), F.avg(value), F.stddev_samp(value)).first())


def ttest_one(df: DataFrame, x: str, mean: float) -> DataFrame:
    check_numeric(df, [x])
    n, m, sd = _moments(complete_cases(df, [x]), F.col(x).cast("double"))
    if n < 2:
        raise too_few("A t-test", 2, n)
    return _result(df, "one_sample", (x, n, m, sd), (None, None, float(mean), None), m, sd / math.sqrt(n), n - 1, mean)


def ttest_paired(df: DataFrame, a: str, b: str) -> DataFrame:
    """A test of a - b against zero."""
    check_numeric(df, [a, b])
    rows = complete_cases(df, [a, b])
    n, m, sd, mean_b, sd_b = rows.agg(F.count("*"), F.avg(F.col(a).cast("double") - F.col(b)), F.stddev_samp(F.col(a).cast("double") - F.col(b)), F.avg(F.col(b).cast("double")), F.stddev_samp(F.col(b).cast("double"))).first()
    if n < 2:
        raise too_few("A paired t-test", 2, n)
    return _result(df, "paired", (f"{a} - {b}", n, m, sd), (b, n, mean_b, sd_b), m, sd / math.sqrt(n), n - 1)


def _two(df: DataFrame, one: tuple, two: tuple, welch: bool) -> DataFrame:
    (_, n1, m1, s1), (_, n2, m2, s2) = one, two
    if min(n1, n2) < 2:
        raise too_few("Each group of a t-test", 2, min(n1, n2))
    if welch:
        a, b = s1 * s1 / n1, s2 * s2 / n2
        se, dof = math.sqrt(a + b), (a + b) ** 2 / (a * a / (n1 - 1) + b * b / (n2 - 1)) if a + b else 0.0
    else:
        dof = n1 + n2 - 2
        se = math.sqrt(((n1 - 1) * s1 * s1 + (n2 - 1) * s2 * s2) / dof * (1 / n1 + 1 / n2))
    return _result(df, "welch" if welch else "two_sample", one, two, m1 - m2, se, dof)


def ttest_two(df: DataFrame, a: str, b: str) -> DataFrame:
    """Two variables as independent samples with one variance, over rows that have both."""
    check_numeric(df, [a, b])
    rows = complete_cases(df, [a, b])
    return _two(df, (a, *_moments(rows, F.col(a).cast("double"))), (b, *_moments(rows, F.col(b).cast("double"))), False)


def ttest_by(df: DataFrame, x: str, group: str, welch: bool = False) -> DataFrame:
    """Two groups; the first is that with the larger label."""
    check_numeric(df, [x])
    check_names(df, [group])
    rows = complete_cases(df, [x, group])
    value = F.col(x).cast("double")
    found = rows.groupBy(group_label(df, group).alias("label")).agg(F.count("*"), F.avg(value), F.stddev_samp(value)).orderBy("label").limit(3).collect()
    if len(found) != 2:
        raise StatError("invalid_request", f"'{group}' must have two groups.", f"It has {'three or more' if len(found) > 2 else len(found)}.", "Use anova, or keep two groups.")
    return _two(df, tuple(found[1]), tuple(found[0]), welch)


def anova(df: DataFrame, y: str, group: str) -> tuple[DataFrame, DataFrame]:
    """The table (one row) and the groups. Groups are summed before and after the shuffle; only totals reach the driver."""
    check_numeric(df, [y])
    check_names(df, [group])
    rows, value = complete_cases(df, [y, group]), F.col(y).cast("double")
    groups = rows.groupBy(group_label(df, group).alias("label")).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.coalesce(F.var_samp(value), F.lit(0.0)).alias("var"))
    k, n, grand, within = groups.agg(F.count("*"), F.sum("n"), F.sum(F.col("n") * F.col("mean")) / F.sum("n"), F.sum((F.col("n") - 1) * F.col("var"))).first()
    if (k or 0) < 2:
        raise StatError("invalid_request", f"'{group}' must have two groups or more.", f"It has {k or 0}.", "Choose another group variable.")
    between = groups.agg(F.sum(F.col("n") * F.pow(F.col("mean") - float(grand), 2))).first()[0]
    if n <= k or not within:
        raise StatError("not_identified", "The F test isn't defined.", "Nothing varies within the groups.", "Check the variables.")
    f = between / (k - 1) / (within / (n - k))
    row = (n, k, between, within, k - 1, n - k, f, f_upper(f, k - 1, n - k), between / (between + within))
    table = df.sparkSession.createDataFrame([row], "n long, groups long, ss_between double, ss_within double, df_between long, df_within long, f double, p double, eta2 double")
    return table, groups.select("label", "n", "mean", F.when(F.col("n") > 1, F.sqrt("var")).alias("sd")).orderBy("label")
