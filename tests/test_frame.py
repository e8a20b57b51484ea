"""Variables, rows, descriptives and tests of hypotheses."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from estimara.errors import StatError
from estimara.functions import expr
from estimara.functions.order import dense_index, with_lags
from estimara.operators import describe, frame, hypothesis
from estimara.sources import csvio


@pytest.fixture(scope="module")
def df(spark):
    rows = [(1, 1.0, "a", 2.0), (2, None, "b", 0.0), (3, -2.5, "", 1.0), (4, 2.5, None, -3.0), (5, float("nan"), "a", 4.0), (6, 1000.0, "a", None)]
    return spark.createDataFrame(rows, "id long, x double, g string, z double")


def column(df, c):
    return [r[0] for r in df.select(c).collect()]


def test_functions_give_missing_for_what_is_not_finite(df):
    get = lambda c: column(df.orderBy("id"), c.alias("v"))
    assert get(expr.ln("x")) == [0.0, None, None, pytest.approx(math.log(2.5)), None, pytest.approx(math.log(1000))]
    assert get(expr.log("x"))[5] == pytest.approx(3)
    assert get(expr.exp("x"))[5] is None and get(expr.sqrt("x"))[2] is None
    assert get(expr.rounded("x"))[2:4] == [-3.0, 3.0]
    assert get(expr.divide("x", "z"))[:3] == [0.5, None, -2.5]
    assert get(expr.power("x", 200))[5] is None
    assert get(expr.power(expr.negate("z"), 2))[0] == 4.0


def test_rank_and_standardize(spark, df):
    data = spark.createDataFrame([(i, float(v)) for i, v in enumerate([5, 1, 3, 3, 9, 3, 1])] + [(99, None)], "id long, v double")
    ranks = {r.id: r.r for r in expr.with_rank(data, "r", F.col("v")).collect()}
    assert [ranks[i] for i in range(7)] == [6.0, 1.5, 4.0, 4.0, 7.0, 4.0, 1.5] and ranks[99] is None
    z = [v for v in column(data, expr.standardized(data, F.col("v"))) if v is not None]
    assert np.mean(z) == pytest.approx(0, abs=1e-12) and np.std(z, ddof=1) == pytest.approx(1)
    assert set(column(data, expr.standardized(data.withColumn("v", F.lit(2.0)), F.lit(2.0)))) == {None}


def test_order(spark):
    data = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(6)
    rows = with_lags(dense_index(data, ["k"]), "__index", ["k"], 2, bucket=16).collect()
    assert len(rows) == 1000
    assert all(r["__index"] == r.k + 1 and r.k__1 == (r.k - 1 if r.k else None) and r.k__2 == (r.k - 2 if r.k > 1 else None) for r in rows)


def test_an_order_with_ties_is_refused(spark):
    for parts in (1, 6):
        data = spark.createDataFrame([(i // 2 if i > 90 else i, None if i in (3, 4) else "x") for i in range(100)], "k long, g string").repartition(parts)
        for order in (["k"], ["k", "g"]):
            with pytest.raises(StatError):
                dense_index(data, order)
    data = spark.createDataFrame([(1, None), (1, "a"), (None, None), (None, "a")], "k long, g string")
    assert sorted(r["__index"] for r in dense_index(data, ["k", "g"]).collect()) == [1, 2, 3, 4]
    with pytest.raises(StatError):
        dense_index(data.unionByName(data.limit(1)), ["g", "k"])


def test_rows_and_columns(df):
    assert column(frame.drop_if(df, expr.condition("x", ">", 0)).orderBy("id"), "id") == [2, 3, 5]
    assert column(frame.keep_if(df, expr.condition("x", ">", 0)).orderBy("id"), "id") == [1, 4, 6]
    assert column(frame.complete_cases(df, ["x", "g", "id"]).orderBy("id"), "id") == [1, 6]
    assert column(frame.sort(df, "x", descending=True, ties=["id"]), "id") == [6, 4, 1, 3, 2, 5]
    assert column(frame.sort(df, "x", ties=["id"]), "id") == [3, 1, 4, 6, 2, 5]
    changed = frame.replace(df, "z", F.lit(None), expr.condition("x", "==", 1)).orderBy("id")
    assert column(changed, "z") == [None, 0.0, 1.0, -3.0, 4.0, None]
    assert frame.keep_vars(df, ["z", "id"]).columns == ["id", "z"]
    assert frame.describe(frame.label_variable(df, "x", "size")).collect()[1].label == "size"
    for wrong in (lambda: frame.generate(df, "x", F.lit(1)), lambda: frame.rename(df, "id", "x"), lambda: frame.drop_vars(df, ["nope"]), lambda: frame.keep_vars(df, []), lambda: frame.replace(df, "g", F.lit(1)), lambda: expr.condition("x", "~", 1)):
        with pytest.raises(StatError) as e:
            wrong()
        assert e.value.what and e.value.why and e.value.action


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_quartiles_and_distinct_values_of_all_columns(spark, parts):
    v = [float(i * 37 % 101) for i in range(230)]
    w = [float(i % 3) if i % 5 else None for i in range(230)]
    data = spark.createDataFrame([(a, b, None, 7) for a, b in zip(v, w)], "v double, w double, empty double, one int").repartition(5)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = describe.summarize(data).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    for row, values in zip(got, (v, [x for x in w if x is not None], [], [7.0] * 230)):
        assert (row.q1, row["median"], row.q3) == (tuple(np.quantile(values, [0.25, 0.5, 0.75])) if values else (None, None, None))
        assert row.distinct == len(set(values)) and row.n == len(values)


def test_summary(spark):
    data = spark.createDataFrame([(float(v), None) for v in (1, 2, 3, 4, 5, 30)] + [(None, None)], "v double, w double")
    v, w = describe.summarize(data).collect()
    assert (v.n, v.missing, v.sum, v.distinct) == (6, 1, 45.0, 6)
    assert (v.q1, v["median"], v.q3) == (2.25, 3.5, 4.75)
    assert v.skewness == pytest.approx(2.361, abs=1e-3)
    assert describe.summarize(data, compat=True).first().skewness == pytest.approx(0.517, abs=1e-3)
    assert w.n == 0 and w["mean"] is None and w.skewness is None
    same = describe.summarize(spark.createDataFrame([(1.0,)] * 5, "v double")).first()
    assert same.variance == 0 and same.skewness is None and same.kurtosis is None
    with pytest.raises(StatError):
        describe.summarize(spark.createDataFrame([("a",)], "t string"), ["t"])


def test_frequency_and_histogram(df, monkeypatch):
    rows = [tuple(r) for r in describe.frequency(df, "g").orderBy("cumulative").collect()]
    assert [r[:2] for r in rows] == [("a", 3), ("(missing)", 2), ("b", 1)] and rows[-1][3] == pytest.approx(100)
    many = df.sparkSession.range(50).select((F.col("id") % 7).cast("string").alias("v"))
    want = sorted(map(tuple, describe.frequency(many, "v").collect()))
    monkeypatch.setattr(describe, "FEW_VALUES", 1)
    assert sorted(map(tuple, describe.frequency(many, "v").collect())) == want
    assert describe.scatter(df, "x", "z").count() == 3
    bins = describe.histogram(df, "x", 4).orderBy("bin").collect()
    assert [b["count"] for b in bins] == [3, 0, 0, 1]


def test_correlation(spark):
    draw = np.random.default_rng(0)
    a = draw.normal(size=80)
    data = np.column_stack([a, a**3 + draw.normal(size=80), np.ones(80)])
    rows = [tuple(map(float, r)) for r in data] + [(1.0, None, 1.0)]
    got = {(r.var1, r.var2): r for r in describe.correlate(spark.createDataFrame(rows, "a double, b double, c double")).collect()}
    assert got["a", "b"].r == pytest.approx(np.corrcoef(data[:, 0], data[:, 1])[0, 1]) and got["a", "b"].n == 80
    assert got["a", "c"].r is None and got["a", "a"].p is None
    ranks = data[:, :2].argsort(0).argsort(0)
    rho = describe.correlate(spark.createDataFrame(rows, "a double, b double, c double"), ["a", "b"], spearman=True).where("var1 < var2").first().r
    assert rho == pytest.approx(np.corrcoef(ranks[:, 0], ranks[:, 1])[0, 1])


def test_ttests_and_anova(spark):
    x, y, z = [1.0, 2.0, 3.0, 4.0, 5.0], [2.0, 1.0, 4.0, 4.0, 9.0], [7.0, 8.0, 6.0, 9.0, 7.5]
    data = spark.createDataFrame([(float(v), g) for g, vs in ((1, x), (10, y), (9, z)) for v in vs] + [(None, 1)], "v double, g int")
    one = hypothesis.ttest_one(data.where("g = 1"), "v", 2.5).first()
    assert (one.diff, one.t, one.df) == (3.0, pytest.approx(0.5 / (np.std(x, ddof=1) / 5**0.5)), 4.0)
    two = hypothesis.ttest_by(data.where("g > 5"), "v", "g").first()
    assert (two.label1, two.label2) == ("9", "10") and two.diff == pytest.approx(np.mean(z) - np.mean(y))
    welch = hypothesis.ttest_by(data.where("g > 5"), "v", "g", welch=True).first()
    a, b = np.var(z, ddof=1) / 5, np.var(y, ddof=1) / 5
    assert welch.df == pytest.approx((a + b) ** 2 / (a * a / 4 + b * b / 4))
    pairs = spark.createDataFrame(list(zip(x, y)), "a double, b double")
    d = np.array(x) - np.array(y)
    assert hypothesis.ttest_paired(pairs, "a", "b").first().t == pytest.approx(d.mean() / (d.std(ddof=1) / 5**0.5))
    assert hypothesis.ttest_two(pairs, "a", "b").first().df == 8
    f, groups = hypothesis.anova(data, "v", "g")
    grand = np.mean(x + y + z)
    ssb, ssw = sum(5 * (np.mean(v) - grand) ** 2 for v in (x, y, z)), sum(4 * np.var(v, ddof=1) for v in (x, y, z))
    assert f.first()["f"] == pytest.approx((ssb / 2) / (ssw / 12)) and [r.label for r in groups.collect()] == ["1", "10", "9"]
    for wrong in (lambda: hypothesis.ttest_by(data, "v", "g"), lambda: hypothesis.ttest_one(data.withColumn("v", F.lit(1.0)), "v", 0), lambda: hypothesis.anova(data.where("g = 1"), "v", "g"), lambda: hypothesis.ttest_one(data.limit(0), "v", 0)):
        with pytest.raises(StatError):
            wrong()


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿Wage (EUR);Name;2nd;name;Code\n1,5;"Ann ""A""";1;x;1\n2;"multi\nline";NA;y;b7\n3e2;;+.5;z;7\n.;Bob;4;w;1d\n', encoding="utf-8")
    df, report = csvio.read_csv(spark, f"file://{tmp_path}/a.csv")
    assert df.columns == ["wage_eur", "name", "v2nd", "name_2", "code"] and report.delimiter == ";" and report.rows == 4 and len(report.issues) == 1
    rows = df.collect()
    assert [r.v2nd for r in rows] == [1.0, None, 0.5, 4.0] and [r.code for r in rows] == ["1", "b7", "7", "1d"]
    assert [r.wage_eur for r in rows] == ["1,5", "2", "3e2", None] and rows[0]["name"] == 'Ann "A"' and rows[2]["name"] is None
    assert df.schema["v2nd"].metadata["semantic"] == "continuous"
    assert csvio.guess_delimiter('"a,b,c"\tx\ty') == "\t"
    table = spark.createDataFrame([(1.0, "a,b", None), (2.5, 'q"q', "x")], "n double, t string, u string")
    csvio.export(table, f"file://{tmp_path}/out.csv")
    back, _ = csvio.read_csv(spark, f"file://{tmp_path}/out.csv")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, table.collect()))
    for wrong in (lambda: csvio.read_csv(spark, "x.xlsx"), lambda: csvio.export(table, "x.dta")):
        with pytest.raises(StatError):
            wrong()
