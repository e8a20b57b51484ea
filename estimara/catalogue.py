"""Queries over the driver's tables, one or more for each operator, and the SQL that they are held against.

Figures are rounded to 8 significant digits on both sides: sums depend on the
order of their terms in the last few.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import StatError
from .functions import expr
from .operators import describe, frame, glm, hypothesis, linear, panel
from .plans.moments import moments
from .session import Session

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
DIGITS = 8


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        _QUERIES[name or f.__name__] = f
        if sql:
            _SQL[name or f.__name__] = sql
        return f

    return keep


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sig(c: Column | str) -> Column:
    """To 8 significant digits."""
    x = (F.col(c) if isinstance(c, str) else c).cast("double")
    scale = F.pow(F.lit(10.0), DIGITS - 1 - F.floor(F.log10(F.abs(x))))
    return F.when((x == 0) | x.isNull(), x).otherwise(F.round(x * scale) / scale)


def rounded(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(*(sig(n).alias(n) if t == "double" and n not in keep else F.col(n) for n, t in df.dtypes))


def s(x: str) -> str:
    """sig() in SQL."""
    scale = f"pow(10.0::double, {DIGITS - 1} - floor(log10(abs(({x})::double))))"
    return f"(case when ({x})::double = 0 or ({x}) is null then ({x})::double else round(({x})::double * {scale}) / {scale} end)"


def figures(spark: SparkSession, values: dict[str, float | None]) -> DataFrame:
    """(name, value) rows."""
    rows = [(k, None if v is None or math.isnan(v) else float(v)) for k, v in values.items()]
    return rounded(spark.createDataFrame(rows, "name string, value double"))


def figures_sql(source: str, values: dict[str, str]) -> str:
    return " union all ".join(f"select '{k}' as name, {s(v)} as value from {source}" for k, v in values.items())


def tidy(spark: SparkSession, fit: linear.Fit) -> DataFrame:
    """term, coef, se, stat, n; p-values have no SQL and are tested elsewhere."""
    return rounded(fit.to_df(spark).select("term", "coef", "se", "stat", F.lit(fit.n).cast("long").alias("n")))


# Summaries

LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _summary_sql(t: str, names: list[str]) -> str:
    one = lambda c: f"""select '{c}' as variable, count({c})::bigint as n, (count(*) - count({c}))::bigint as missing, {s(f"avg({c})")} as mean, {s(f"stddev_samp({c})")} as sd, {s(f"var_samp({c})")} as variance,
        {s(f"min({c})")} as min, {s(f"max({c})")} as max, {s(f"sum({c})")} as sum, {s(f"quantile_cont({c}::double, 0.25)")} as q1, {s(f"quantile_cont({c}::double, 0.5)")} as median, {s(f"quantile_cont({c}::double, 0.75)")} as q3,
        round(skewness({c}), 6) as skewness, round(kurtosis({c}), 6) as kurtosis, count(distinct {c})::bigint as distinct_values from {t}"""  # noqa: E731
    return " union all ".join(one(c) for c in names)


def _summary(df: DataFrame, names: list[str]) -> DataFrame:
    out = describe.summarize(df, names).withColumn("skewness", F.round("skewness", 6)).withColumn("kurtosis", F.round("kurtosis", 6))
    return rounded(out.withColumnRenamed("distinct", "distinct_values"), "skewness", "kurtosis")


@query(_summary_sql("lineitem", LINE))
def summarize_lineitem(spark, d):
    return _summary(table(spark, d, "lineitem"), LINE)


_GAPS = "(select nullif(greatest(o_totalprice - 150000, 0), 0) as price, o_totalprice from orders)"


def _gaps(spark, d):
    """orders with prices up to 150,000 missing."""
    price = F.greatest(F.col("o_totalprice") - 150000, F.lit(0.0))
    return table(spark, d, "orders").withColumn("price", F.nullif(price, F.lit(0.0)))


@query(_summary_sql(_GAPS, ["price", "o_totalprice"]))
def summarize_missing(spark, d):
    return _summary(_gaps(spark, d), ["price", "o_totalprice"])


@query("select * from (values (0, 'o_orderkey', 'numeric'), (1, 'o_custkey', 'numeric'), (2, 'o_orderstatus', 'text'), (3, 'o_totalprice', 'numeric'), (4, 'o_orderdate', 'numeric'), (5, 'o_orderpriority', 'text')) t(position, name, storage)")
def describe_orders(spark, d):
    return frame.describe(table(spark, d, "orders")).select("position", "name", "storage")


def _frequency_sql(t: str, c: str) -> str:
    return f"""select value, count, {s("100.0 * count / sum(count) over ()")} as percent, {s("100.0 * sum(count) over (order by count desc, value rows unbounded preceding) / sum(count) over ()")} as cumulative
        from (select coalesce(nullif({c}, ''), '(missing)') as value, count(*)::bigint as count from {t} group by 1)"""


@query(_frequency_sql("lineitem", "l_returnflag"))
def frequency_returnflag(spark, d):
    return rounded(describe.frequency(table(spark, d, "lineitem"), "l_returnflag"))


@query(_frequency_sql("customer", "nullif(c_mktsegment, 'BUILDING')"))
def frequency_segment(spark, d):
    df = table(spark, d, "customer").withColumn("segment", F.nullif("c_mktsegment", F.lit("BUILDING")))
    return rounded(describe.frequency(df, "segment"))


@query("""with r as (select min(l_extendedprice) as lo, max(l_extendedprice) as hi from lineitem), c as (select least(floor((l_extendedprice - lo) / ((hi - lo) / 24)), 23)::int as bin, count(*)::bigint as n from lineitem, r group by 1)
    select b::int as bin, """ + s("lo + b * ((hi - lo) / 24)") + """ as start, coalesce(n, 0)::bigint as count from (select unnest(generate_series(0, 23)) as b) g cross join r left join c on c.bin = b""")  # fmt: skip
def histogram_price(spark, d):
    return rounded(describe.histogram(table(spark, d, "lineitem"), "l_extendedprice"))


def _correlate_sql(source: str, names: list[str]) -> str:
    cells = [(a, b) for a in names for b in names]
    r = lambda a, b: "1.0::double" if a == b else f"round(corr({a}, {b}), 8)"
    return " union all ".join(f"select '{a}' as var1, '{b}' as var2, {r(a, b)} as r, count(*)::bigint as n from {source}" for a, b in cells)


def _correlations(df: DataFrame) -> DataFrame:
    return df.select("var1", "var2", F.round("r", 8).alias("r"), "n")


@query(_correlate_sql("lineitem", LINE))
def correlate_pearson(spark, d):
    return _correlations(describe.correlate(table(spark, d, "lineitem"), LINE))


_RANKS = "(select " + ", ".join(f"rank() over (order by {c}) + (count(*) over (partition by {c}) - 1) / 2.0 as {c}" for c in ("p_size", "p_retailprice")) + " from part)"


@query(_correlate_sql(_RANKS, ["p_size", "p_retailprice"]))
def correlate_spearman(spark, d):
    return _correlations(describe.correlate(table(spark, d, "part"), ["p_size", "p_retailprice"], spearman=True))


# Tests

_T = ["n1", "mean1", "n2", "mean2", "diff", "se", "t", "df"]


def _ttest(df: DataFrame) -> DataFrame:
    return rounded(df.select(*(F.col(c).cast("double").alias(c) for c in _T)))


def _t_sql(source: str, n1: str, m1: str, n2: str, m2: str, diff: str, se: str, dof: str, against: str = "0") -> str:
    values = {"n1": n1, "mean1": m1, "n2": n2, "mean2": m2, "diff": diff, "se": se, "t": f"(({diff}) - {against}) / ({se})", "df": dof}
    return "select " + ", ".join(f"{s(v)} as {k}" for k, v in values.items()) + f" from {source}"


@query(_t_sql("(select count(*) n, avg(l_quantity) m, stddev_samp(l_quantity) sd from lineitem)", "n", "m", "null::double", "25.0", "m", "sd / sqrt(n)", "n - 1", "25"))
def ttest_one(spark, d):
    return _ttest(hypothesis.ttest_one(table(spark, d, "lineitem"), "l_quantity", 25))


_BY = "(select count(*) filter (g = 'O') n1, avg(x) filter (g = 'O') m1, var_samp(x) filter (g = 'O') v1, count(*) filter (g = 'F') n2, avg(x) filter (g = 'F') m2, var_samp(x) filter (g = 'F') v2 from (select l_linestatus g, l_extendedprice x from lineitem))"


@query(_t_sql(_BY, "n1", "m1", "n2", "m2", "m1 - m2", "sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1.0 / n1 + 1.0 / n2))", "n1 + n2 - 2"))
def ttest_by(spark, d):
    return _ttest(hypothesis.ttest_by(table(spark, d, "lineitem"), "l_extendedprice", "l_linestatus"))


@query(_t_sql(_BY, "n1", "m1", "n2", "m2", "m1 - m2", "sqrt(v1 / n1 + v2 / n2)", "pow(v1 / n1 + v2 / n2, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v2 / n2, 2) / (n2 - 1))"))
def ttest_by_welch(spark, d):
    return _ttest(hypothesis.ttest_by(table(spark, d, "lineitem"), "l_extendedprice", "l_linestatus", welch=True))


_AB = "(select count(*) n, avg(l_discount - l_tax) md, stddev_samp(l_discount - l_tax) sd, avg(l_discount) m1, avg(l_tax) m2, var_samp(l_discount) v1, var_samp(l_tax) v2 from lineitem)"


@query(_t_sql(_AB, "n", "md", "n", "m2", "md", "sd / sqrt(n)", "n - 1"))
def ttest_paired(spark, d):
    return _ttest(hypothesis.ttest_paired(table(spark, d, "lineitem"), "l_discount", "l_tax"))


@query(_t_sql(_AB, "n", "m1", "n", "m2", "m1 - m2", "sqrt((v1 + v2) / n)", "2 * n - 2"))
def ttest_two_vars(spark, d):
    return _ttest(hypothesis.ttest_two(table(spark, d, "lineitem"), "l_discount", "l_tax"))


def _anova_sql(t: str, y: str, g: str, p: str = "") -> str:
    return f"""with q as (select {g} as g, count(*) as n, avg({y}) as m, coalesce(var_samp({y}), 0) as v from {t} group by 1), a as (select sum(n) as n, count(*) as k, sum((n - 1) * v) as w, sum(n * m) / sum(n) as gm from q),
        b as (select any_value(a.n) as n, any_value(k) as k, any_value(w) as w, sum(q.n * pow(m - gm, 2)) as b from q, a)
        select n::bigint as n, k::bigint as groups, {s("b")} as ss_between, {s("w")} as ss_within, (k - 1)::bigint as df_between, (n - k)::bigint as df_within, {s("(b / (k - 1)) / (w / (n - k))")} as f, {s("b / (b + w)")} as eta2{p} from b"""


@query(_anova_sql("events", "value", "event_type"))
def anova_event_value(spark, d):
    return rounded(hypothesis.anova(table(spark, d, "events"), "value", "event_type")[0].drop("p"))


#: F with two degrees of freedom above has its probability in closed form.
_F2_P = "round(pow(1 + 2 * ({f}) / ({df}), -({df}) / 2.0), 7)"


@query(_anova_sql("lineitem", "l_extendedprice", "l_returnflag", ", " + _F2_P.format(f="(b / (k - 1)) / (w / (n - k))", df="n - k") + " as p"))
def anova_price_flag(spark, d):
    """Three groups."""
    return rounded(hypothesis.anova(table(spark, d, "lineitem"), "l_extendedprice", "l_returnflag")[0].withColumn("p", F.round("p", 7)), "p")


@query(f"select l_returnflag as label, count(*)::bigint as n, {s('avg(l_extendedprice)')} as mean, {s('stddev_samp(l_extendedprice)')} as sd from lineitem group by 1")
def anova_groups(spark, d):
    return rounded(hypothesis.anova(table(spark, d, "lineitem"), "l_extendedprice", "l_returnflag")[1])


# Variables

@query(f"""select c_custkey, {s("case when c_acctbal > 0 then ln(c_acctbal) end")} as v_ln, {s("case when c_acctbal > 0 then log10(c_acctbal) end")} as v_log, {s("case when c_acctbal < 700 then exp(c_acctbal) end")} as v_exp,
    {s("case when c_acctbal >= 0 then sqrt(c_acctbal) end")} as v_sqrt, abs(c_acctbal) as v_abs, sign(c_acctbal) * floor(abs(c_acctbal) + 0.5) as v_round, {s("c_acctbal / nullif(c_nationkey, 0)")} as v_div, {s("pow(-c_acctbal, 2)")} as v_pow from customer""")
def generate_functions(spark, d):
    x = F.col("c_acctbal")
    new = {"v_ln": sig(expr.ln(x)), "v_log": sig(expr.log(x)), "v_exp": sig(F.when(x < 700, expr.exp(x))), "v_sqrt": sig(expr.sqrt(x)), "v_abs": expr.absolute(x), "v_round": expr.rounded(x), "v_div": sig(expr.divide(x, "c_nationkey")), "v_pow": sig(expr.power(expr.negate(x), 2))}
    df = table(spark, d, "customer")
    for name, value in new.items():
        df = frame.generate(df, name, value)
    return df.select("c_custkey", *new)


@query("select p_partkey, (rank() over (order by p_size) + (count(*) over (partition by p_size) - 1) / 2.0)::double as size_rank from part")
def rank_avg(spark, d):
    return expr.with_rank(table(spark, d, "part"), "size_rank", F.col("p_size").cast("double")).select("p_partkey", "size_rank")


@query(f"select p_partkey, {s('(p_retailprice - avg(p_retailprice) over ()) / stddev_samp(p_retailprice) over ()')} as z from part")
def standardize(spark, d):
    df = table(spark, d, "part")
    return df.select("p_partkey", sig(expr.standardized(df, F.col("p_retailprice"))).alias("z"))


_PRICED = "(select o_orderkey, nullif(greatest(o_totalprice - 150000, 0), 0) as price from orders)"


def _priced(spark, d):
    return _gaps(spark, d).select("o_orderkey", "price")


@query(f"select o_orderkey, case when price > 200000 then 0 else price end as price from {_PRICED}")
def replace_if(spark, d):
    return frame.replace(_priced(spark, d), "price", F.lit(0.0), expr.condition("price", ">", 200000))


@query(f"select o_orderkey, price from {_PRICED} where not coalesce(price > 200000, false)")
def drop_if(spark, d):
    return frame.drop_if(_priced(spark, d), expr.condition("price", ">", 200000))


@query(f"select o_orderkey, price from {_PRICED} where price > 200000")
def keep_if(spark, d):
    return frame.keep_if(_priced(spark, d), expr.condition("price", ">", 200000))


@query("select o_orderkey, o_custkey, o_orderstatus, o_totalprice from orders")
def drop_vars(spark, d):
    return frame.drop_vars(table(spark, d, "orders"), ["o_orderdate", "o_orderpriority"])


@query("select o_orderkey, o_totalprice from orders")
def keep_vars(spark, d):
    return frame.keep_vars(table(spark, d, "orders"), ["o_totalprice", "o_orderkey"])


@query("select o_orderkey as id, o_totalprice as price from orders")
def rename_vars(spark, d):
    return frame.rename(frame.rename(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", "id"), "o_totalprice", "price")


@query(f"select o_orderkey, price from {_PRICED} order by price desc nulls last, o_orderkey")
def sort_desc(spark, d):
    return frame.sort(_priced(spark, d), "price", descending=True, ties=["o_orderkey"])


@query(f"select price, o_orderkey from {_PRICED} where price is not null")
def complete_case(spark, d):
    return frame.complete_cases(_priced(spark, d), ["price", "o_orderkey"])


# Regressions. SQL has them for one regressor, in closed form.

def _line_sql(t: str, y: str, x: str) -> str:
    """r: each row's x, y and residual; a: n, mean x, Sxx, slope b, constant c."""
    return f"""a as (select count(*)::double as n, avg({x}) as mx, avg({y}) as my, var_pop({x}) * count(*) as sxx, regr_slope({y}, {x}) as b, regr_intercept({y}, {x}) as c from {t}),
        r as (select q.*, {x} - mx as z, {y} - my - b * ({x} - mx) as u, 1 / n + pow({x} - mx, 2) / sxx as h, n, mx, my, sxx, b, c from {t} q, a)"""


def _two_rows(slope_var: str, cons_var: str, source: str) -> str:
    row = lambda t, b, v: f"select '{t}' as term, {s(b)} as coef, {s(f'sqrt({v})')} as se, {s(f'({b}) / sqrt({v})')} as stat, n::bigint as n from {source}"
    return f"{row('l_quantity', 'b', slope_var)} union all {row('_cons', 'c', cons_var)}"


def _sandwich_sql(weight: str, factor: str = "1") -> str:
    """V = A M A in the columns 1 and x - mean x, then the constant at x = 0."""
    line = _line_sql("lineitem", "l_extendedprice", "l_quantity")
    m = f"m as (select any_value(n) n, any_value(mx) mx, any_value(sxx) sxx, any_value(b) b, any_value(c) c, sum({weight}) m00, sum(({weight}) * z) m01, sum(({weight}) * z * z) m11 from r)"
    v = f"v as (select *, {factor} * m11 / (sxx * sxx) v11, {factor} * m00 / (n * n) v00, {factor} * m01 / (n * sxx) v01 from m)"
    return f"with {line}, {m}, {v} " + _two_rows("v11", "v00 - 2 * mx * v01 + mx * mx * v11", "v")


def _ols(spark, d, **options):
    return tidy(spark, linear.regress(table(spark, d, "lineitem"), "l_extendedprice", ["l_quantity"], **options))


@query(f"with {_line_sql('lineitem', 'l_extendedprice', 'l_quantity')}, v as (select any_value(n) n, any_value(b) b, any_value(c) c, any_value(mx) mx, any_value(sxx) sxx, sum(u * u) / (any_value(n) - 2) s2 from r) " + _two_rows("s2 / sxx", "s2 * (1 / n + mx * mx / sxx)", "v"))
def ols_simple(spark, d):
    return _ols(spark, d)


for _kind, _weight, _factor in (("hc0", "u * u", "1"), ("hc1", "u * u", "n / (n - 2)"), ("hc2", "u * u / (1 - h)", "1"), ("hc3", "u * u / pow(1 - h, 2)", "1")):
    query(_sandwich_sql(_weight, _factor), f"ols_{_kind}")(lambda spark, d, kind=_kind: _ols(spark, d, vce=kind))


@query(f"""with {_line_sql('lineitem', 'l_extendedprice', 'l_quantity')}, k as (select l_suppkey, sum(u) s0, sum(u * z) s1 from r group by 1),
    m as (select any_value(n) n, any_value(mx) mx, any_value(sxx) sxx, any_value(b) b, any_value(c) c from r), g as (select count(*)::double g, sum(s0 * s0) m00, sum(s0 * s1) m01, sum(s1 * s1) m11 from k),
    f as (select *, g / (g - 1) * (n - 1) / (n - 2) as adj from m, g), v as (select *, adj * m11 / (sxx * sxx) v11, adj * m00 / (n * n) v00, adj * m01 / (n * sxx) v01 from f) """ + _two_rows("v11", "v00 - 2 * mx * v01 + mx * mx * v11", "v"))
def ols_cluster(spark, d):
    return _ols(spark, d, vce="cluster", cluster="l_suppkey")


_EVENTS = "(select event_id, value, user_id::double as user_id from events)"


@query(f"""with {_line_sql(_EVENTS, 'value', 'user_id')}, l as (select *, lag(u) over (order by event_id) u1, lag(z * u) over (order by event_id) w1, lag(u, 2) over (order by event_id) u2, lag(z * u, 2) over (order by event_id) w2 from r),
    m as (select any_value(n) n, any_value(sxx) sxx, any_value(b) b, sum(pow(u * z, 2)) + 2 * (2.0 / 3 * sum(u * z * w1) + 1.0 / 3 * sum(u * z * w2)) m11 from l)
    select 'user_id' as term, {s("b")} as coef, {s("sqrt(n / (n - 2) * m11 / (sxx * sxx))")} as se, {s("b / sqrt(n / (n - 2) * m11 / (sxx * sxx))")} as stat, n::bigint as n from m""")
def ols_hac(spark, d):
    fit = linear.regress(table(spark, d, "events"), "value", ["user_id"], vce="hac", lags=2, order=["event_id"])
    return tidy(spark, fit).where("term = 'user_id'")


_TWO = "(select count(*)::double n, avg(l_extendedprice) my, avg(l_quantity) m1, avg(l_discount) m2, covar_pop(l_quantity, l_quantity) s11, covar_pop(l_quantity, l_discount) s12, covar_pop(l_discount, l_discount) s22, covar_pop(l_quantity, l_extendedprice) s1y, covar_pop(l_discount, l_extendedprice) s2y, var_pop(l_extendedprice) syy from lineitem)"
_TWO_FIT = f"(select *, (s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12) b1, (s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12) b2 from {_TWO})"


@query(f"""with f as (select *, my - b1 * m1 - b2 * m2 as b0, n * (syy - b1 * s1y - b2 * s2y) / (n - 3) as s2 from {_TWO_FIT}), d as (select *, s11 * s22 - s12 * s12 as det from f)
    select 'l_quantity' as term, {s('b1')} as coef, {s('sqrt(s2 * s22 / (n * det))')} as se, {s('b1 / sqrt(s2 * s22 / (n * det))')} as stat, n::bigint as n from d
    union all select 'l_discount', {s('b2')}, {s('sqrt(s2 * s11 / (n * det))')}, {s('b2 / sqrt(s2 * s11 / (n * det))')}, n::bigint from d
    union all select '_cons', {s('b0')}, {s('sqrt(s2 * (1 / n + (m1 * m1 * s22 - 2 * m1 * m2 * s12 + m2 * m2 * s11) / (n * det)))')}, {s('b0 / sqrt(s2 * (1 / n + (m1 * m1 * s22 - 2 * m1 * m2 * s12 + m2 * m2 * s11) / (n * det)))')}, n::bigint from d""")
def ols_two(spark, d):
    return tidy(spark, linear.regress(table(spark, d, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount"]))


@query(figures_sql(f"(select *, b1 * s1y + b2 * s2y as ess, n * (syy - b1 * s1y - b2 * s2y) as rss from {_TWO_FIT})", {
    "r2": "ess / syy", "adj_r2": "1 - (1 - ess / syy) * (n - 1) / (n - 3)", "rmse": "sqrt(rss / (n - 3))", "f": "(ess / syy / 2) / ((1 - ess / syy) / (n - 3))",
    "loglik": "-n / 2 * (ln(2 * pi() * rss / n) + 1)", "aic": "n * (ln(2 * pi() * rss / n) + 1) + 6", "bic": "n * (ln(2 * pi() * rss / n) + 1) + 3 * ln(n)"}))
def ols_fit_figures(spark, d):
    f = linear.regress(table(spark, d, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount"]).figures
    return figures(spark, {k: f[k] for k in ("r2", "adj_r2", "rmse", "f", "loglik", "aic", "bic")})


@query(f"""with a as (select count(*)::double n, sum(l_quantity) w, sum(l_quantity * l_discount) / sum(l_quantity) mx, sum(l_quantity * l_extendedprice) / sum(l_quantity) my from lineitem),
    q as (select any_value(n) n, any_value(w) w, any_value(mx) mx, any_value(my) my, sum(l_quantity * pow(l_discount - mx, 2)) sxx, sum(l_quantity * (l_discount - mx) * (l_extendedprice - my)) sxy, sum(l_quantity * pow(l_extendedprice - my, 2)) syy from lineitem, a),
    v as (select *, sxy / sxx b, my - sxy / sxx * mx c, (syy - sxy * sxy / sxx) / (n - 2) s2 from q)
    select 'l_discount' as term, {s('b')} as coef, {s('sqrt(s2 / sxx)')} as se, {s('b / sqrt(s2 / sxx)')} as stat, n::bigint as n from v
    union all select '_cons', {s('c')}, {s('sqrt(s2 * (1 / w + mx * mx / sxx))')}, {s('c / sqrt(s2 * (1 / w + mx * mx / sxx))')}, n::bigint from v""")
def wls(spark, d):
    return tidy(spark, linear.regress(table(spark, d, "lineitem"), "l_extendedprice", ["l_discount"], weight="l_quantity"))


@query(f"""with q as (select count(*)::double n, sum(l_quantity * l_extendedprice) xy, sum(l_quantity * l_quantity) xx, sum(l_extendedprice * l_extendedprice) yy from lineitem), v as (select n, xy / xx b, sqrt((yy - xy * xy / xx) / (n - 1) / xx) e from q)
    select 'l_quantity' as term, {s('b')} as coef, {s('e')} as se, {s('b / e')} as stat, n::bigint as n from v""")
def ols_no_constant(spark, d):
    return tidy(spark, linear.regress(table(spark, d, "lineitem"), "l_extendedprice", ["l_quantity"], constant=False))


@query(f"""with q as (select count(*)::double n, sum(l_quantity * l_discount * l_extendedprice) xy, sum(l_quantity * l_discount * l_discount) xx, sum(l_quantity * l_extendedprice * l_extendedprice) yy from lineitem), v as (select n, xy / xx b, sqrt((yy - xy * xy / xx) / (n - 1) / xx) e from q)
    select 'l_discount' as term, {s('b')} as coef, {s('e')} as se, {s('b / e')} as stat, n::bigint as n from v""")
def wls_no_constant(spark, d):
    return tidy(spark, linear.regress(table(spark, d, "lineitem"), "l_extendedprice", ["l_discount"], weight="l_quantity", constant=False))


@query(f"""with q as (select count(*)::double n, sum(l_quantity * l_discount * l_extendedprice) / sum(l_quantity * l_discount * l_discount) b, sum(l_quantity * l_discount * l_discount) xx from lineitem),
    m as (select any_value(n) n, any_value(b) b, any_value(xx) xx, sum(pow(l_quantity * l_discount * (l_extendedprice - b * l_discount), 2)) meat from lineitem, q), v as (select n, b, sqrt(n / (n - 1) * meat) / xx e from m)
    select 'l_discount' as term, {s('b')} as coef, {s('e')} as se, {s('b / e')} as stat, n::bigint as n from v""")
def wls_no_constant_robust(spark, d):
    return tidy(spark, linear.regress(table(spark, d, "lineitem"), "l_extendedprice", ["l_discount"], weight="l_quantity", constant=False, vce="robust"))


def _two(spark, d):
    return linear.fitted(table(spark, d, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount"])[1]


@query("select variable, round(1 / (1 - pow(r, 2)), 8) as vif from (select corr(l_quantity, l_discount) as r from lineitem), (values ('l_quantity'), ('l_discount')) t(variable)")
def vif(spark, d):
    return spark.createDataFrame(list(linear.vif(_two(spark, d)).items()), "variable string, vif double").withColumn("vif", F.round("vif", 8))


@query(f"with {_line_sql('lineitem', 'l_extendedprice', 'l_quantity')}, q as (select count(*) * pow(corr(u * u, l_quantity), 2) as lm from r) select 'lm' as name, {s('lm')} as value from q")
def breusch_pagan(spark, d):
    return figures(spark, {"lm": linear.breusch_pagan(linear.fitted(table(spark, d, "lineitem"), "l_extendedprice", ["l_quantity"])[1])[0]})


def _reset_sql() -> str:
    """With one regressor, fitted squares and cubes are those of z, so three columns of powers are enough; Gram-Schmidt on them."""
    return f"""with {_line_sql('lineitem', 'l_extendedprice', 'l_quantity')}, p as (select u, z / sqrt(sxx / n) as a, n from r),
        q as (select *, a * a - avg(a * a) over () - a * (avg(a * a * a) over ()) as e2 from p),
        t as (select *, pow(a, 3) - avg(pow(a, 3)) over () - a * (avg(pow(a, 4)) over ()) as f3 from q),
        w as (select *, f3 - e2 * (sum(f3 * e2) over ()) / (sum(e2 * e2) over ()) as e3 from t),
        g as (select any_value(n) n, sum(u * u) ssr, pow(sum(u * e2), 2) / sum(e2 * e2) + pow(sum(u * e3), 2) / sum(e3 * e3) as gain from w)
        select 'f' as name, {s('gain / 2 / ((ssr - gain) / (n - 4))')} as value from g union all select 'p', {_F2_P.format(f='gain / 2 / ((ssr - gain) / (n - 4))', df='n - 4')} from g"""


@query(_reset_sql())
def reset(spark, d):
    f, _, _, p = linear.reset(linear.fitted(table(spark, d, "lineitem"), "l_extendedprice", ["l_quantity"])[1])
    return figures(spark, {"f": f}).unionByName(spark.createDataFrame([("p", round(p, 7))], "name string, value double"))


@query(f"with {_line_sql(_EVENTS, 'value', 'user_id')} select 'durbin_watson' as name, {s('sum(pow(u - p, 2)) / sum(u * u)')} as value from (select u, lag(u) over (order by event_id) as p from r)")
def durbin_watson(spark, d):
    df = table(spark, d, "events")
    design = linear.fitted(df, "value", ["user_id"], "hac", lags=0, order=["event_id"])[1]
    return figures(spark, {"durbin_watson": linear.durbin_watson(design, ["event_id"])})


@query(f"with {_line_sql('lineitem', 'l_extendedprice', 'l_quantity')}, v as (select *, sum(u * u) over () / (n - 2) as s2 from r) select count(*) filter (u * u * h / (2 * s2 * pow(1 - h, 2)) > 4 / n)::bigint as influential, {s('max(u * u * h / (2 * s2 * pow(1 - h, 2)))')} as largest, {s('max(abs(u / sqrt(s2 * (1 - h))))')} as residual from v")
def cooks_count(spark, d):
    design = linear.fitted(table(spark, d, "lineitem"), "l_extendedprice", ["l_quantity"])[1]
    top = design.rows.agg(F.max(linear.cooks_distance(design)).alias("largest"), F.max(F.abs(linear.standardized_residual(design))).alias("residual"))
    return rounded(top.select(F.lit(linear.influential(design)).cast("long").alias("influential"), "largest", "residual"))


@query(f"""with q as (select sum(l_quantity * l_quantity) a, sum(l_quantity * l_discount) b, sum(l_discount * l_discount) c from lineitem) select 'condition_number' as name, {s("sqrt((a + c + sqrt(pow(a - c, 2) + 4 * b * b)) / 2 / ((a * c - b * b) / ((a + c + sqrt(pow(a - c, 2) + 4 * b * b)) / 2)))")} as value from q""")
def condition_number(spark, d):
    return figures(spark, {"condition_number": linear.condition_number(_two(spark, d))})


def _diagnostics_sql() -> str:
    """Two regressors: the condition number and VIF in closed form, Breusch-Pagan's p of two degrees of freedom is exp(-lm / 2), Cook's distances by row. RESET's two terms by Gram-Schmidt, its p of two degrees of freedom in closed form."""
    return f"""with m as (select *, s11 * s22 - s12 * s12 as det, my - b1 * m1 - b2 * m2 as b0 from {_TWO_FIT}),
        r as (select l_quantity x1, l_discount x2, l_extendedprice - b0 - b1 * l_quantity - b2 * l_discount u, 1 / n + (s22 * pow(l_quantity - m1, 2) - 2 * s12 * (l_quantity - m1) * (l_discount - m2) + s11 * pow(l_discount - m2, 2)) / (n * det) h, n from lineitem, m),
        w as (select *, sum(u * u) over () / (n - 3) s2 from r),
        k as (select any_value(n) n, count(*) filter (u * u * h / (3 * s2 * pow(1 - h, 2)) > 4 / n) / any_value(n) share, any_value(s2) s2,
            covar_pop(x1, x1) a, covar_pop(x1, x2) b, covar_pop(x2, x2) c, covar_pop(x1, u * u) d, covar_pop(x2, u * u) e, var_pop(u * u) f, sum(x1 * x1) q1, sum(x1 * x2) q2, sum(x2 * x2) q3 from w),
        t as (select r.u, r.x1 - m1 as x1, r.x2 - m2 as x2, b1 * (r.x1 - m1) + b2 * (r.x2 - m2) as y, s11, s12, s22, det, m.n from r, m),
        p as (select *, y * y - avg(y * y) over () as f2, pow(y, 3) - avg(pow(y, 3)) over () as f3 from t),
        g as (select *, sum(x1 * f2) over () / n as a2, sum(x2 * f2) over () / n as b2, sum(x1 * f3) over () / n as a3, sum(x2 * f3) over () / n as b3 from p),
        h as (select u, n, f2 - ((s22 * a2 - s12 * b2) * x1 + (s11 * b2 - s12 * a2) * x2) / det as e2, f3 - ((s22 * a3 - s12 * b3) * x1 + (s11 * b3 - s12 * a3) * x2) / det as g3 from g),
        i as (select *, g3 - e2 * (sum(g3 * e2) over ()) / (sum(e2 * e2) over ()) as e3 from h),
        j as (select any_value(n) n, sum(u * u) ssr, pow(sum(u * e2), 2) / sum(e2 * e2) + pow(sum(u * e3), 2) / sum(e3 * e3) as gain from i),
        l as (select {_F2_P.format(f='gain / 2 / ((ssr - gain) / (n - 5))', df='n - 5')} as reset_p from j),
        z as (select *, n * (c * d * d - 2 * b * d * e + a * e * e) / (a * c - b * b) / f as lm, 1 / (1 - b * b / (a * c)) as vif, (q1 + q3 + sqrt(pow(q1 - q3, 2) + 4 * q2 * q2)) / 2 as top from k),
        v as (select 'condition_number' as check_name, sqrt(top / ((q1 * q3 - q2 * q2) / top)) as value, case when sqrt(top / ((q1 * q3 - q2 * q2) / top)) < 1e7 then 'ok' when sqrt(top / ((q1 * q3 - q2 * q2) / top)) < 1e10 then 'warning' else 'attention' end as verdict from z
            union all select 'max_vif', vif, case when vif < 5 then 'ok' when vif < 10 then 'warning' else 'attention' end from z
            union all select 'breusch_pagan_p', exp(-lm / 2), case when exp(-lm / 2) < 0.05 then 'attention' else 'ok' end from z
            union all select 'reset_p', reset_p, case when reset_p < 0.05 then 'warning' else 'ok' end from l
            union all select 'sample_size', n, 'ok' from z union all select 'parameters', 3, 'ok' from z union all select 'residual_df', n - 3, 'ok' from z
            union all select 'influential_share', share, case when share > 0.05 then 'warning' else 'ok' end from z)
        select check_name, round(value, 7) as value, verdict from v"""


@query(_diagnostics_sql())
def regression_diagnostics(spark, d):
    return spark.createDataFrame(linear.diagnostics(_two(spark, d)), "check_name string, value double, verdict string").withColumn("value", F.round("value", 7))


# Panels, instruments, differences

_WITHIN = "(select l_suppkey, l_quantity - avg(l_quantity) over (partition by l_suppkey) x, l_extendedprice - avg(l_extendedprice) over (partition by l_suppkey) y, count(*) over (partition by l_suppkey) k from lineitem)"


def _xt(spark, d, how, **options):
    return tidy(spark, how(table(spark, d, "lineitem"), "l_extendedprice", ["l_quantity"], "l_suppkey", **options))


_FE = f"f as (select count(*)::double n, count(distinct l_suppkey) g, sum(x * x) sxx, sum(x * y) / sum(x * x) b from {_WITHIN} where k > 1), r as (select l_suppkey, x, y - b * x u, n, g, sxx, b from {_WITHIN}, f where k > 1)"


@query(f"with {_FE}, v as (select any_value(n) n, any_value(b) b, sqrt(sum(u * u) / (any_value(n) - any_value(g) - 1) / any_value(sxx)) e from r) select 'l_quantity' as term, {s('b')} as coef, {s('e')} as se, {s('b / e')} as stat, n::bigint as n from v")
def xtreg_fe(spark, d):
    return _xt(spark, d, panel.fixed_effects)


@query(f"with {_FE}, v as (select any_value(n) n, any_value(b) b, sqrt(any_value(n) / (any_value(n) - 1) * sum(pow(u * x, 2))) / any_value(sxx) e from r) select 'l_quantity' as term, {s('b')} as coef, {s('e')} as se, {s('b / e')} as stat, n::bigint as n from v")
def xtreg_fe_robust(spark, d):
    return _xt(spark, d, panel.fixed_effects, vce="robust")


@query(f"with {_FE}, k as (select l_suppkey, sum(u * x) sc, any_value(n) n, any_value(b) b, any_value(sxx) sxx from r group by 1), v as (select any_value(n) n, any_value(b) b, sqrt(count(*)::double / (count(*) - 1) * sum(sc * sc)) / any_value(sxx) e from k) select 'l_quantity' as term, {s('b')} as coef, {s('e')} as se, {s('b / e')} as stat, n::bigint as n from v")
def xtreg_fe_cluster(spark, d):
    return _xt(spark, d, panel.fixed_effects, vce="cluster", cluster="l_suppkey")


def _slope_sql(source: str) -> str:
    return f"""with q as (select count(*)::double n, regr_slope(y, x) b, regr_sxx(y, x) sxx, regr_syy(y, x) syy, regr_sxy(y, x) sxy from {source}), v as (select n, b, sqrt((syy - sxy * sxy / sxx) / (n - 2) / sxx) e from q)
        select 'l_quantity' as term, {s('b')} as coef, {s('e')} as se, {s('b / e')} as stat, n::bigint as n from v"""


@query(_slope_sql("(select avg(l_quantity) x, avg(l_extendedprice) y from lineitem group by l_suppkey)"))
def xtreg_be(spark, d):
    return _xt(spark, d, panel.between)


@query(_slope_sql("(select l_quantity x, l_extendedprice y from lineitem)"))
def xtreg_pooled(spark, d):
    return _xt(spark, d, panel.pooled)


def _did_data(spark, d):
    customers = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), (F.col("c_mktsegment") == "BUILDING").cast("double").alias("treated"))
    return table(spark, d, "orders").join(customers, "o_custkey").withColumn("after", (F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz")).cast("double"))


_CELLS = "(select avg(o_totalprice) filter (t = 1 and p = 1) m11, avg(o_totalprice) filter (t = 1 and p = 0) m10, avg(o_totalprice) filter (t = 0 and p = 1) m01, avg(o_totalprice) filter (t = 0 and p = 0) m00, count(*)::double n from (select o_totalprice, (c_mktsegment = 'BUILDING')::int t, (o_orderdate >= timestamp '1998-01-01')::int p from orders join customer on o_custkey = c_custkey))"


@query(figures_sql(_CELLS, {"att": "m11 - m10 - m01 + m00", "mean_00": "m00", "mean_01": "m01", "mean_10": "m10", "mean_11": "m11", "n": "n"}))
def did_2x2(spark, d):
    fit = panel.did(_did_data(spark, d), "o_totalprice", "treated", "after")
    return figures(spark, {k: fit.figures[k] for k in ("att", "mean_00", "mean_01", "mean_10", "mean_11")} | {"n": fit.n})


_DID_ROWS = "(select o_custkey, o_totalprice y, (c_mktsegment = 'BUILDING')::double t, (o_orderdate >= timestamp '1998-01-01')::double p from orders join customer on o_custkey = c_custkey)"


@query(f"""with c as (select *, avg(y) over (partition by t, p) m, count(*) over (partition by t, p) k, count(*) over ()::double n from {_DID_ROWS}),
    a as (select avg(y) filter (t = 1 and p = 1) - avg(y) filter (t = 1 and p = 0) - avg(y) filter (t = 0 and p = 1) + avg(y) filter (t = 0 and p = 0) b from c),
    z as (select o_custkey, any_value(n) n, sum((case when t = p then 1 else -1 end) * (y - m) / k) s from c group by 1), g as (select count(*)::double g, any_value(n) n, sum(s * s) q from z)
    select 'treat#post' as term, {s('b')} as coef, {s('sqrt(q * g / (g - 1) * (n - 1) / (n - 4))')} as se, {s('b / sqrt(q * g / (g - 1) * (n - 1) / (n - 4))')} as stat, n::bigint as n from g, a""")
def did_cluster(spark, d):
    return tidy(spark, panel.did(_did_data(spark, d), "o_totalprice", "treated", "after", vce="cluster", cluster="o_custkey")).where("term = 'treat#post'")


@query(f"""with m as (select count(*)::double n, avg(l_extendedprice) my, avg(l_quantity) mx, covar_pop(l_tax, l_extendedprice) zy, covar_pop(l_tax, l_quantity) zx, var_pop(l_tax) zz, var_pop(l_quantity) xx, covar_pop(l_quantity, l_extendedprice) xy, var_pop(l_extendedprice) yy from lineitem),
    f as (select *, zy / zx b, my - zy / zx * mx c from m), v as (select *, (yy - 2 * b * xy + b * b * xx) * n / (n - 2) s2, zx * zx / zz * n h from f)
    select 'l_quantity' as term, {s('b')} as coef, {s('sqrt(s2 / h)')} as se, {s('b / sqrt(s2 / h)')} as stat, n::bigint as n from v union all select '_cons', {s('c')}, {s('sqrt(s2 * (1 / n + mx * mx / h))')}, {s('c / sqrt(s2 * (1 / n + mx * mx / h))')}, n::bigint from v""")
def iv_just_identified(spark, d):
    return tidy(spark, panel.ivregress(table(spark, d, "lineitem"), "l_extendedprice", ["l_quantity"], ["l_tax"]))


def _iv_over_sql(robust: bool) -> str:
    """Two instruments, one endogenous variable: slopes from 2 x 2 systems in centred sums."""
    meat = "n / (n - 2) * sum(pow(f * u, 2)) / pow(any_value(hh), 2)" if robust else "any_value(rss) / (n - 3) / any_value(hh)"
    return f"""with m as (select count(*)::double n, avg(l_extendedprice) my, avg(l_quantity) mx, avg(l_tax) m1, avg(l_discount) m2, regr_sxx(l_tax, l_tax) a, regr_sxy(l_tax, l_discount) b, regr_sxx(l_discount, l_discount) c,
            regr_sxy(l_tax, l_quantity) d, regr_sxy(l_discount, l_quantity) e from lineitem),
        g as (select *, (c * d - b * e) / (a * c - b * b) p1, (a * e - b * d) / (a * c - b * b) p2 from m),
        h as (select l_extendedprice - my y, l_quantity - mx x, p1 * (l_tax - m1) + p2 * (l_discount - m2) f, n, p1 * d + p2 * e hh from lineitem, g),
        k as (select *, sum(f * y) over () / hh as beta from h), r as (select *, y - beta * x u, sum(pow(y - beta * x, 2)) over () rss from k),
        v as (select n, any_value(beta) beta, sqrt({meat}) se from r group by n)
        select 'l_quantity' as term, {s('beta')} as coef, {s('se')} as se, {s('beta / se')} as stat, n::bigint as n from v"""


for _vce in ("classical", "robust"):
    query(_iv_over_sql(_vce == "robust"), f"iv_over_identified_{_vce}")(lambda spark, d, vce=_vce: tidy(spark, panel.ivregress(table(spark, d, "lineitem"), "l_extendedprice", ["l_quantity"], ["l_tax", "l_discount"], vce=vce)).where("term = 'l_quantity'"))


@query(f"with q as (select count(*)::double n, pow(corr(l_quantity, l_tax), 2) r2 from lineitem) select 'f' as name, {s('r2 / ((1 - r2) / (n - 2))')} as value from q union all select 'partial_r2', {s('r2')} from q")
def iv_first_stage(spark, d):
    f = panel.ivregress(table(spark, d, "lineitem"), "l_extendedprice", ["l_quantity"], ["l_tax"]).figures
    return figures(spark, {"f": f["first_stage_f_l_quantity"], "partial_r2": f["partial_r2_l_quantity"]})


# Likelihood models. With one 0/1 regressor they are saturated, so SQL has them in closed form.

def _binary(spark, d):
    return table(spark, d, "lineitem").select((F.col("l_returnflag") == "R").cast("double").alias("y"), (F.col("l_quantity") > 25).cast("double").alias("x"))


_P = "(select avg(y) filter (x = 1) p1, avg(y) filter (x = 0) p0, count(*) filter (x = 1) n1, count(*) filter (x = 0) n0 from (select (l_returnflag = 'R')::int y, (l_quantity > 25)::int x from lineitem))"


@query(f"""with q as (select *, n0 * p0 * (1 - p0) w0, n1 * p1 * (1 - p1) w1, ln(p0 / (1 - p0)) a, ln(p1 / (1 - p1)) b from {_P})
    select '_cons' as term, round(a, 7) as coef, {s('sqrt(1 / w0)')} as se, (n0 + n1)::bigint as n from q union all select 'x', round(b - a, 7), {s('sqrt(1 / w0 + 1 / w1)')}, (n0 + n1)::bigint from q""")
def logit(spark, d):
    return tidy(spark, glm.glm(_binary(spark, d), "logit", "y", ["x"])).select("term", F.round("coef", 7).alias("coef"), "se", "n")


@query(f"select 'fit_0' as name, round(p0, 8) as value from {_P} union all select 'fit_1', round(p1, 8) from {_P} union all select 'loglik', {s('n0 * (p0 * ln(p0) + (1 - p0) * ln(1 - p0)) + n1 * (p1 * ln(p1) + (1 - p1) * ln(1 - p1))')} from {_P}")
def probit(spark, d):
    """Fitted probabilities are the groups' shares."""
    fit = glm.glm(_binary(spark, d), "probit", "y", ["x"])
    a, b = fit.coef
    values = [("fit_0", round(glm.fitted_mean("probit", a), 8)), ("fit_1", round(glm.fitted_mean("probit", a + b), 8))]
    return spark.createDataFrame(values, "name string, value double").unionByName(figures(spark, {"loglik": fit.figures["loglik"]}))


_COUNTS = "(select o_orderkey, (any_value(o_orderstatus) = 'F')::int as x, count(l_orderkey)::double as y from orders left join lineitem on o_orderkey = l_orderkey group by 1)"


def _counts(spark, d):
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").cast("double").alias("y"))
    return table(spark, d, "orders").join(lines, "o_orderkey", "left").select(F.coalesce("y", F.lit(0.0)).alias("y"), (F.col("o_orderstatus") == "F").cast("double").alias("x"))


@query(f"""with q as (select avg(y) filter (x = 1) m1, avg(y) filter (x = 0) m0, sum(y) filter (x = 1) s1, sum(y) filter (x = 0) s0, count(*) n from {_COUNTS})
    select '_cons' as term, round(ln(m0), 7) as coef, {s('sqrt(1 / s0)')} as se, n::bigint as n from q union all select 'x', round(ln(m1) - ln(m0), 7), {s('sqrt(1 / s0 + 1 / s1)')}, n::bigint from q""")
def poisson(spark, d):
    return tidy(spark, glm.glm(_counts(spark, d), "poisson", "y", ["x"])).select("term", F.round("coef", 7).alias("coef"), "se", "n")


@query(f"""with q as (select avg(y) filter (x = 1) m1, avg(y) filter (x = 0) m0, var_pop(y) filter (x = 1) v1, var_pop(y) filter (x = 0) v0, count(*) filter (x = 1) n1, count(*) filter (x = 0) n0 from {_COUNTS})
    select '_cons' as term, {s('sqrt(v0 / (n0 * m0 * m0))')} as se from q union all select 'x', {s('sqrt(v0 / (n0 * m0 * m0) + v1 / (n1 * m1 * m1))')} from q""")
def poisson_robust(spark, d):
    return tidy(spark, glm.glm(_counts(spark, d), "poisson", "y", ["x"], robust=True)).select("term", "se")


# Sessions

def _session(spark, d) -> Session:
    session = Session(spark, table(spark, d, "lineitem"))
    session.regress("l_extendedprice", ["l_quantity"])
    session.regress("l_extendedprice", ["l_quantity", "l_discount"])
    return session


@query(f"""with f as (select *, my - b1 * m1 - b2 * m2 as b0, s1y / s11 as one, my - s1y / s11 * m1 as zero from {_TWO_FIT})
    select 'M1' as model, '_cons' as term, {s('zero')} as coef from f union all select 'M1', 'l_quantity', {s('one')} from f
    union all select 'M2', '_cons', {s('b0')} from f union all select 'M2', 'l_quantity', {s('b1')} from f union all select 'M2', 'l_discount', {s('b2')} from f""")
def estimate_compare(spark, d):
    return rounded(_session(spark, d).compare().to_df(spark).select("model", "term", "coef"))


@query("select * from (select 'M1' as id, 'ols' as kind, count(*)::bigint as n from lineitem) union all select 'M2', 'ols', count(*)::bigint from lineitem")
def estimate_list(spark, d):
    return _session(spark, d).estimates_list().select("id", "kind", "n")


_CSV = ["l_orderkey", "l_linenumber", *LINE, "l_returnflag", "note"]
_CSV_SQL = """select l_orderkey::double as l_orderkey, l_linenumber::double as l_linenumber, l_quantity, nullif(l_extendedprice, 1000) as l_extendedprice, l_discount, l_tax, l_returnflag, l_returnflag || ', "' || l_linestatus || '"; ' || l_partkey::varchar as note from lineitem"""


@query(_CSV_SQL)
def csv_round_trip(spark, d):
    """lineitem's numbers and texts, with separators, quotes and missing cells, written as CSV to the shared folder and read again by the import rules: every cell."""
    from .plans.staging import folder
    from .sources import csvio

    at = folder(spark, "csv") + ".csv"
    text = F.concat(F.col("l_returnflag"), F.lit(', "'), F.col("l_linestatus"), F.lit('"; '), F.col("l_partkey").cast("string"))
    rows = table(spark, d, "lineitem").withColumn("note", text).withColumn("l_extendedprice", F.nullif("l_extendedprice", F.lit(1000.0)))
    csvio.write_csv(rows.select(*(F.col(c).cast("double").alias(c) if c not in ("l_returnflag", "note") else F.col(c) for c in _CSV)), at)
    return csvio.read_csv(spark, at)[0]


@query("select l_quantity, l_extendedprice from lineitem where isfinite(l_quantity) and isfinite(l_extendedprice)")
def scatter_data(spark, d):
    return describe.scatter(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice")


@query("select * from (values (1, 'regress', true), (2, 'xtreg', true), (3, 'summarize', true), (4, 'ttest_by', true), (5, 'glm', true)) t(step, command, reproduced)")
def replay_ok(spark, d):
    """Analyses of lineitem are recorded and run again on the project's own copy; the project is in the shared folder."""
    from .plans.staging import folder, stage
    from .session import Project

    data = stage(table(spark, d, "lineitem").withColumn("large", (F.col("l_quantity") > 25).cast("double")), "replay")
    session = Session(spark, data)
    session.project = Project.create(folder(spark, "project"), "lines")
    session.project.add_dataset(data, "lineitem")
    session.regress("l_extendedprice", ["l_quantity"], vce="cluster", cluster="l_suppkey", diagnostics=False)
    session.xtreg("l_extendedprice", ["l_quantity"], "l_suppkey", model="fe")
    session.summarize(["l_quantity", "l_tax"])
    session.ttest_by("l_tax", "l_linestatus")
    session.glm("logit", "large", ["l_discount"])
    return session.project.replay(spark).select("step", "command", "reproduced")


@query(f"""with d as (select l_extendedprice, ln(l_quantity) as lq from lineitem where l_discount >= 0.03), m as (select count(*)::double n, avg(l_extendedprice) my, avg(lq) mx, regr_slope(l_extendedprice, lq) b from d)
    select '_cons' as term, {s('my - b * mx')} as coef, n::bigint as n from m union all select 'lq', {s('b')}, n::bigint from m""")
def replay_changes(spark, d):
    """generate, keep if, rename and regress are replayed from the raw dataset; the coefficients are those of the replayed session's record."""
    from .plans.staging import folder
    from .session import Project

    data = table(spark, d, "lineitem").select("l_quantity", "l_extendedprice", "l_discount")
    session = Session(spark, data)
    session.project = Project.create(folder(spark, "project"), "changes")
    session.project.add_dataset(data, "raw")
    session.generate("log_quantity", expr.ln("l_quantity"))
    session.keep_if(expr.condition("l_discount", ">=", 0.03))
    session.rename("log_quantity", "lq")
    session.regress("l_extendedprice", ["lq"], diagnostics=False)
    ran = session.project.replay(spark).where("reproduced").count() == 4
    fit = [r["result"] for r in session.project.records() if r.get("command") == "regress"][0]
    rows = [(t, float(c), int(fit["n"])) for t, c in zip(fit["terms"], fit["coef"])] if ran else []
    return rounded(spark.createDataFrame(rows, "term string, coef double, n long"))


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 40 offset 700")
def preview_page(spark, d):
    """A page in the middle of a sorted table, by its index."""
    session = Session(spark, table(spark, d, "orders").select("o_orderkey", "o_totalprice"))
    session.sort("o_totalprice", descending=True, ties=["o_orderkey"])
    return session.preview(700, 40)


@query(f"select 'n' as name, {s('count(*)')} as value from lineitem" + "".join(f" union all select '{k}', {s(v)} from lineitem" for k, v in {"mean": "avg(l_tax)", "mean_2": "avg(l_quantity)", "squares": "var_pop(l_tax) * count(*)", "products": "round(covar_pop(l_tax, l_quantity) * count(*), 3)", "squares_2": "var_pop(l_quantity) * count(*)"}.items()))
def moments_one_pass(spark, d):
    m = moments(table(spark, d, "lineitem"), ["l_tax", "l_quantity"])
    return figures(spark, {"n": float(m.n), "mean": float(m.means[0]), "mean_2": float(m.means[1]), "squares": float(m.cross[0, 0]), "products": round(float(m.cross[0, 1]), 3), "squares_2": float(m.cross[1, 1])})


# Many columns, many lags, names

#: Forty derived columns: remainders of whole numbers.
WIDE_COLUMNS = [(c, m) for c in ("l_partkey", "l_suppkey", "l_orderkey", "l_quantity") for m in range(3, 13)]
_WIDE_SOURCE = "(select " + ", ".join(f"({c}::bigint % {m})::double as r_{c}_{m}" for c, m in WIDE_COLUMNS) + " from lineitem)"


def _wide_rows(spark, d):
    return table(spark, d, "lineitem").select(*((F.col(c).cast("long") % m).cast("double").alias(f"r_{c}_{m}") for c, m in WIDE_COLUMNS))


def _wide_sql() -> str:
    names = [f"r_{c}_{m}" for c, m in WIDE_COLUMNS]
    cells = ", ".join(f"corr({a}, {b}) as c{i}_{j}" for i, a in enumerate(names) for j, b in enumerate(names) if i < j)
    rows = ", ".join(f"{{'var1': '{a}', 'var2': '{b}', 'r': {'1.0::double' if i == j else f'round(c{min(i, j)}_{max(i, j)}, 8)'}, 'n': n}}" for i, a in enumerate(names) for j, b in enumerate(names))
    return f"select unnest([{rows}], recursive := true) from (select count(*)::bigint as n, {cells} from {_WIDE_SOURCE})"


@query(_wide_sql())
def correlate_wide(spark, d):
    """Forty columns: their products are sums of matrix blocks."""
    return _correlations(describe.correlate(_wide_rows(spark, d)))


_LAGS = 60
_MANY_LAGS = " + ".join(f"2 * {1 - lag / (_LAGS + 1)!r} * sum(w * w{lag})" for lag in range(1, _LAGS + 1))


@query(f"""with {_line_sql(_EVENTS, 'value', 'user_id')}, s as (select *, z * u as w from r), l as (select *, {", ".join(f"lag(w, {lag}) over (order by event_id) w{lag}" for lag in range(1, _LAGS + 1))} from s),
    m as (select any_value(n) n, any_value(sxx) sxx, any_value(b) b, sum(w * w) + {_MANY_LAGS} as m11 from l)
    select 'user_id' as term, {s("b")} as coef, {s("sqrt(n / (n - 2) * m11 / (sxx * sxx))")} as se, {s("b / sqrt(n / (n - 2) * m11 / (sxx * sxx))")} as stat, n::bigint as n from m""")
def ols_hac_many_lags(spark, d):
    fit = linear.regress(table(spark, d, "events"), "value", ["user_id"], vce="hac", lags=_LAGS, order=["event_id"])
    return tidy(spark, fit).where("term = 'user_id'")


_THREE = ["l_quantity", "l_extendedprice", "l_discount"]
_RANKS3 = "(select " + ", ".join(f"rank() over (order by {c}) + (count(*) over (partition by {c}) - 1) / 2.0 as {c}" for c in _THREE) + " from lineitem)"


@query(_correlate_sql(_RANKS3, _THREE))
def correlate_spearman_lineitem(spark, d):
    """One column with hardly any ties, two with a few values."""
    return _correlations(describe.correlate(table(spark, d, "lineitem"), _THREE, spearman=True))


def _origin_sql() -> str:
    """Through the origin: VIF about the mean, condition number of the raw columns, Breusch-Pagan without a constant."""
    return f"""with m as (select sum(l_quantity * l_quantity) a, sum(l_quantity * l_discount) b, sum(l_discount * l_discount) c, sum(l_quantity * l_extendedprice) d, sum(l_discount * l_extendedprice) e, count(*)::double n, corr(l_quantity, l_discount) r from lineitem),
        f as (select *, (c * d - b * e) / (a * c - b * b) b1, (a * e - b * d) / (a * c - b * b) b2 from m),
        u as (select l_quantity x1, l_discount x2, l_extendedprice - b1 * l_quantity - b2 * l_discount as u, f.* from lineitem, f),
        h as (select *, (c * x1 * x1 - 2 * b * x1 * x2 + a * x2 * x2) / (a * c - b * b) as h, sum(u * u) over () / (n - 2) as s2 from u),
        g as (select any_value(a) a, any_value(b) b, any_value(c) c, any_value(n) n, any_value(r) r, sum(x1 * u * u) p, sum(x2 * u * u) q, sum(pow(u, 4)) t, var_pop(u * u) * count(*) as sst, count(*) filter (u * u * h / (2 * s2 * pow(1 - h, 2)) > 4 / n) as far from h),
        v as (select *, (a + c + sqrt(pow(a - c, 2) + 4 * b * b)) / 2 as top, t - (c * p * p - 2 * b * p * q + a * q * q) / (a * c - b * b) as ssr from g)
        select 'vif' as name, {s('1 / (1 - r * r)')} as value from v union all select 'condition_number', {s('sqrt(top / ((a * c - b * b) / top))')} from v
        union all select 'breusch_pagan', {s('n * (1 - ssr / sst)')} from v union all select 'influential', far::double from v"""


@query(_origin_sql())
def diagnostics_no_constant(spark, d):
    design = linear.fitted(table(spark, d, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount"], constant=False)[1]
    return figures(spark, {"vif": linear.vif(design)["l_quantity"], "condition_number": linear.condition_number(design), "breusch_pagan": linear.breusch_pagan(design)[0], "influential": float(linear.influential(design))})


@query("select o_orderkey, o_totalprice, o_totalprice / 2 as half, 'refused' as same_name from orders")
def generate_case(spark, d):
    """A new variable whose name differs from another's in case only is refused, and the other one stays."""
    df = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    try:
        verdict, df = "accepted", frame.generate(df, "O_TOTALPRICE", F.lit(0.0))
    except StatError:
        verdict = "refused"
    return frame.generate(df, "half", expr.divide("o_totalprice", 2)).withColumn("same_name", F.lit(verdict))
