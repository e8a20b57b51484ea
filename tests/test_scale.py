"""Blocked products, brackets, ranges and edges against NumPy, on layouts with few, many, short and hot parts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from estimara.errors import StatError
from estimara.functions import order
from estimara.operators import describe, frame, linear, panel
from estimara.plans import moments as plan
from estimara.plans import select


def frame_of(spark, x, names, **more):
    columns = {**{n: x[:, i] for i, n in enumerate(names)}, **more}
    rows = [tuple(v.item() if hasattr(v, "item") else v for v in r) for r in zip(*columns.values())]
    kinds = {np.dtype("int64"): "long"}
    return spark.createDataFrame(rows, ", ".join(f"`{n}` {kinds.get(getattr(v, 'dtype', None), 'double')}" for n, v in columns.items()))


@pytest.mark.parametrize("weighted", [False, True])
def test_wide_moments_and_regression(spark, weighted):
    draw = np.random.default_rng(5)
    n, k = 500, 40
    x = draw.standard_normal((n, k)) + 1e4 * np.arange(k)
    x[:, 1] += x[:, 0] - x[:, 0].mean()
    w = draw.random(n) + 0.5
    y = x @ np.linspace(-1, 1, k) + draw.standard_normal(n) * np.abs(x[:, 3] - x[:, 3].mean())
    names = [f"v{i}" for i in range(k)]
    df = frame_of(spark, np.column_stack([x, y, w]), [*names, "y", "w"]).repartition(6)
    own = w if weighted else np.ones(n)
    mean = (own[:, None] * x).sum(axis=0) / own.sum()
    m = plan.moments(df, names, "w" if weighted else None)
    assert m.n == n and m.weight == pytest.approx(own.sum()) and m.means == pytest.approx(mean, rel=1e-12)
    assert m.cross == pytest.approx(((x - mean) * own[:, None]).T @ (x - mean), rel=1e-8, abs=1e-6)
    root = np.sqrt(own)[:, None]
    z = np.column_stack([np.ones(n), x - x.mean(axis=0)]) * root
    beta, *_ = np.linalg.lstsq(z, y * root[:, 0], rcond=None)
    u, inv = y * root[:, 0] - z @ beta, np.linalg.inv(z.T @ z)
    h = ((z @ inv) * z).sum(axis=1)
    for kind, power in (("hc1", 0), ("hc3", 2)):
        fit, d = linear.fitted(df, "y", names, kind, weight="w" if weighted else None)
        v = inv @ ((z * (u**2 / (1 - h) ** power)[:, None]).T @ z) @ inv * (n / (n - k - 1) if kind == "hc1" else 1)
        assert fit.coef[1:] == pytest.approx(beta[1:], rel=1e-7, abs=1e-7) and fit.se[1:] == pytest.approx(np.sqrt(np.diag(v))[1:], rel=1e-6)
    s2 = u @ u / (n - k - 1)
    assert linear.influential(d) == int((u**2 * h / ((k + 1) * s2 * (1 - h) ** 2) > 4 / n).sum())
    clusters = df.withColumn("g", F.floor(F.col("w") * 20))
    fit = linear.regress(clusters, "y", names, "cluster", "g")
    assert np.isfinite(fit.se).all()


def test_wide_within(spark):
    draw = np.random.default_rng(6)
    n, k = 300, 20
    g = draw.integers(0, 60, n)
    g[:5] = [100, 101, 102, 103, 104]  # entities seen once
    x = draw.standard_normal((n, k)) + g[:, None]
    names = [f"v{i}" for i in range(k)]
    got = plan.within_moments(frame_of(spark, x, names, g=g), names, "g")
    some = np.array([(g == v).sum() > 1 for v in g])
    centred = np.array([x[i] - x[g == g[i]].mean(axis=0) for i in range(n)])[some]
    assert (got.n, got.groups) == (some.sum(), len(set(g[some]))) and got.within.cross == pytest.approx(centred.T @ centred, abs=1e-8)


@pytest.mark.parametrize("keep, accuracy", [(50_000, 10_000), (20, 100), (1, 40)])
def test_quantiles_and_distincts(spark, monkeypatch, keep, accuracy):
    monkeypatch.setattr(select, "KEEP", keep)
    monkeypatch.setattr(select, "ACCURACY", accuracy)
    draw = np.random.default_rng(7)
    n = 3000
    columns = {
        "normal": draw.standard_normal(n), "ties": draw.integers(0, 4, n).astype(float), "hot": np.where(draw.random(n) < 0.4, 7.5, draw.random(n)), "whole": draw.integers(-5000, 5000, n).astype(float),
        "wide": draw.integers(-(1 << 60), 1 << 60, n).astype(float), "same": np.full(n, -2.0), "holes": np.where(draw.random(n) < 0.9, np.nan, draw.random(n)), "none": np.full(n, np.nan),
        "zeros": np.where(draw.random(n) < 0.5, 0.0, -0.0), "one": np.where(np.arange(n) == 5, 3.25, np.nan),
    }
    df = frame_of(spark, np.column_stack(list(columns.values())), list(columns)).repartition(7)
    got = {r["variable"]: r for r in describe.summarize(df).collect()}
    for name, x in columns.items():
        x, r = x[~np.isnan(x)], got[name]
        assert (r["n"], r["distinct"]) == (len(x), len(set((x + 0.0).tolist())))
        want = [None] * 3 if not len(x) else [pytest.approx(float(v), rel=1e-12, abs=1e-12) for v in np.quantile(x, [0.25, 0.5, 0.75])]
        assert [r["q1"], r["median"], r["q3"]] == want


@pytest.mark.parametrize("parts", [1, 5, 40])
@pytest.mark.parametrize("lags", [1, 7, 60])
def test_autocovariances(spark, monkeypatch, parts, lags):
    """Ranges of fewer rows than lags, too."""
    monkeypatch.setattr(order, "BLOCK_ROWS", 16)
    draw = np.random.default_rng(8)
    n = 200
    x, t = draw.standard_normal((n, 3)).cumsum(axis=0), draw.permutation(n)
    got = order.autocovariances(frame_of(spark, x, ["a", "b", "c"], t=t).repartition(3), ["t"], ["a", "b", "c"], lags, parts)
    s = x[np.argsort(t)]
    want = np.array([s[lag:].T @ s[: n - lag] for lag in range(lags + 1)])
    assert got.n == n and got.products == pytest.approx(want, rel=1e-9, abs=1e-8)
    assert got.first == pytest.approx(s[0]) and got.last == pytest.approx(s[-1])


def test_newey_west_at_many_lags(spark):
    draw = np.random.default_rng(9)
    n, lags = 1500, 500
    x = draw.standard_normal((n, 3)).cumsum(axis=0) * 0.1
    y = x.sum(axis=1) + draw.standard_normal(n).cumsum() * 0.2
    fit = linear.regress(frame_of(spark, np.column_stack([x, y]), ["a", "b", "c", "y"], t=np.arange(n)), "y", ["a", "b", "c"], "hac", lags=lags, order=["t"])
    z = np.column_stack([np.ones(n), x])
    inv = np.linalg.inv(z.T @ z)
    s = z * (y - z @ inv @ z.T @ y)[:, None]
    meat = s.T @ s + sum((1 - lag / (lags + 1)) * ((g := s[lag:].T @ s[:-lag]) + g.T) for lag in range(1, lags + 1))
    assert fit.se == pytest.approx(np.sqrt(np.diag(inv @ meat @ inv * n / (n - 4))), rel=1e-7)


def test_orders_with_equal_nans_are_refused(spark):
    df = spark.createDataFrame([(float("nan"), 1.0), (float("nan"), 2.0), (1.0, 3.0)], "t double, x double")
    for f in (lambda: order.dense_index(df, ["t"]), lambda: order.autocovariances(df, ["t"], ["x"], 1)):
        with pytest.raises(StatError):
            f()
    assert order.autocovariances(df.limit(0), ["t"], ["x"], 1).n == 0


def test_ranks_take_parts_by_rows(spark, monkeypatch):
    """Ranks are put together in as many parts as the rows need, however many the session names."""
    monkeypatch.setattr(order, "PART_ROWS", 50, raising=False)
    x = np.random.default_rng(3).integers(0, 40, (600, 2)).astype(float)
    got = order.ranked(frame_of(spark, x, ["a", "b"]), ["a", "b"])
    assert got.rdd.getNumPartitions() == 12
    own = lambda v: (v[:, None] > v).sum(1) + ((v[:, None] == v).sum(1) + 1) / 2
    assert sorted(tuple(r) for r in got.collect()) == sorted(zip(own(x[:, 0]), own(x[:, 1])))


@pytest.mark.parametrize("parts", [1, 3, 30])
def test_ranks_of_several_columns(spark, parts):
    """Values that many rows share span ranges."""
    draw = np.random.default_rng(10)
    n = 400
    x = np.column_stack([draw.standard_normal(n), np.where(draw.random(n) < 0.6, 1.0, draw.integers(0, 3, n)), draw.integers(-3, 3, n) * 1.0, np.full(n, 5.0)])
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = np.array(sorted(tuple(r) for r in order.ranked(frame_of(spark, x, ["a", "b", "c", "d"]).repartition(4), ["a", "b", "c", "d"]).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    want = np.array([[(v < r[i]).sum() + ((v == r[i]).sum() + 1) / 2 for i, v in enumerate(x.T)] for r in x])
    assert got == pytest.approx(np.array(sorted(map(tuple, want))))
    one = sorted(r[0] for r in order.ranked(frame_of(spark, x[:, 1:2], ["b"]), ["b"]).collect())
    assert one == pytest.approx(sorted(want[:, 1]))


@pytest.mark.parametrize("parts", [1, 3, 25])
def test_demeaned_rows(spark, parts):
    draw = np.random.default_rng(12)
    n = 300
    g = np.where(draw.random(n) < 0.4, 7, draw.integers(10, 90, n))
    x = draw.standard_normal((n, 2)) + g[:, None]
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        rows = panel.demeaned(frame_of(spark, x, ["a", "n"], g=g).repartition(4), ["a", "n"], "g", "g", n).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    want = sorted((int(g[i]), *(x[i] - x[g == g[i]].mean(axis=0))) for i in range(n) if (g == g[i]).sum() > 1)
    assert np.array(sorted(tuple(r) for r in rows)) == pytest.approx(np.array(want), abs=1e-9)


def test_names_that_differ_in_case(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "a double, b double")
    for change in (lambda: frame.generate(df, "A", F.lit(9)), lambda: frame.rename(df, "b", "A"), lambda: frame.rename(df, "b", "b")):
        with pytest.raises(StatError):
            change()
    assert frame.rename(df, "a", "A").columns == ["A", "b"] and frame.rename(df, "a", "A").first().asDict() == {"A": 1.0, "b": 2.0}
    assert frame.generate(df, "c", F.col("a")).first()["a"] == 1.0


@pytest.mark.parametrize("constant", [True, False])
@pytest.mark.parametrize("weighted", [True, False])
def test_diagnostics_are_those_of_the_scaled_rows(spark, constant, weighted):
    draw = np.random.default_rng(13)
    n = 400
    x = draw.standard_normal((n, 2)) + [3.0, -1.0]
    w = draw.random(n) * 3 + 0.1 if weighted else np.ones(n)
    y = x @ [1.0, 2.0] + 0.3 * x[:, 0] ** 2 + draw.standard_normal(n) / np.sqrt(w)
    df = frame_of(spark, np.column_stack([x, y, w]), ["fit2", "u2", "y", "w"]).repartition(3)
    d = linear.fitted(df, "y", ["fit2", "u2"], weight="w" if weighted else None, constant=constant)[1]
    root = np.sqrt(w)
    ones = [np.ones(n)] * constant
    raw = np.column_stack([*ones, x])
    z, ys = raw * root[:, None], y * root
    solve = lambda a, b: np.linalg.lstsq(a, b, rcond=None)[0]
    beta = solve(z, ys)
    u, h, k = ys - z @ beta, ((z @ np.linalg.inv(z.T @ z)) * z).sum(axis=1), z.shape[1]
    s2 = u @ u / (n - k)
    cook = u**2 * h / (k * s2 * (1 - h) ** 2)
    got = d.rows.select(linear.cooks_distance(d).alias("c"), linear.standardized_residual(d).alias("r")).collect()
    assert sorted(r["c"] for r in got) == pytest.approx(sorted(cook), rel=1e-7)
    assert sorted(r["r"] for r in got) == pytest.approx(sorted(u / np.sqrt(s2 * (1 - h))), rel=1e-7)
    assert linear.influential(d) == (cook > 4 / n).sum()
    values = np.linalg.svd(x * root[:, None])[1]
    assert linear.condition_number(d) == pytest.approx(values[0] / values[-1], rel=1e-7)
    mean = (w[:, None] * x).sum(axis=0) / w.sum()
    c = (x - mean) * root[:, None]
    r2 = (c[:, 0] @ c[:, 1]) ** 2 / (c[:, 0] @ c[:, 0]) / (c[:, 1] @ c[:, 1])
    assert list(linear.vif(d).values()) == pytest.approx([1 / (1 - r2)] * 2, rel=1e-7)
    e = u**2 - raw @ solve(raw, u**2)
    assert linear.breusch_pagan(d)[0] == pytest.approx(n * (1 - e @ e / ((u**2 - (u**2).mean()) ** 2).sum()), rel=1e-6, abs=1e-8)
    fit = raw @ beta
    more = np.column_stack([raw, (fit - fit.mean() * constant) ** 2, (fit - fit.mean() * constant) ** 3]) * root[:, None]
    e = ys - more @ solve(more, ys)
    f = (u @ u - e @ e) / 2 / (e @ e / (n - k - 2))
    assert linear.reset(d)[:3] == (pytest.approx(f, rel=1e-6), 2, n - k - 2)
    checks = {name: value for name, value, _ in linear.diagnostics(d)}
    assert checks["sample_size"] == n and checks["residual_df"] == n - k and checks["influential_share"] == pytest.approx((cook > 4 / n).mean())


def test_panel_errors_and_names(spark):
    draw = np.random.default_rng(14)
    n = 200
    x = draw.standard_normal((n, 3))
    df = frame_of(spark, x, ["y", "treat_", "out"], treat=(np.arange(n) % 2), time=(np.arange(n) // 2 % 2))
    with pytest.raises(StatError):
        panel.fixed_effects(df, "y", ["out"], "time", vce="hac")
    plain = panel.did(df, "out", "treat", "time", ["y", "treat_"])
    named = panel.did(df.withColumnsRenamed({"y": "post", "treat_": "__both"}), "out", "treat", "time", ["post", "__both"])
    assert plain.coef == pytest.approx(named.coef) and plain.terms == ["_cons", "treat", "post", "treat#post", "y", "treat_"] and named.terms[-2:] == ["post", "__both"]


def test_complete_cases_of_many_variables(spark):
    """The one expression for many variables keeps the rows that a condition for each keeps: no null, NaN or empty text, but infinite numbers."""
    kinds = ["double", "float", "long", "string", "date"] * 4
    names, good = [f"v{i}" for i in range(len(kinds))], {"double": "1.5D", "float": "2.5F", "long": "7L", "string": "'a'", "date": "date'2020-01-01'"}
    holes = [{}, {0: "double('NaN')"}, {6: "float('NaN')"}, {2: "cast(null as long)"}, {8: "''"}, {13: "cast(null as string)"}, {19: "cast(null as date)"}, {5: "double('inf')", 1: "float('-inf')"}, {10: "cast(null as double)", 3: "''"}]
    rows = " union all ".join(f"select {row} id, " + ", ".join(f"{own.get(i, good[kind])} v{i}" for i, kind in enumerate(kinds)) for row, own in enumerate(holes))
    df = spark.sql(rows)
    assert len(names) > frame.MANY
    assert sorted(r["id"] for r in frame.complete_cases(df, ["id", *names, "v0"]).select("id").collect()) == [0, 7]
    one_each = df
    for name in names:
        one_each = one_each.where(frame.has_value(df, name))
    assert frame.complete_cases(df, ["id", *names]).exceptAll(one_each).count() == 0 and one_each.count() == 2
