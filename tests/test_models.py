"""Estimators against certified values, algebraic identities and NumPy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from estimara.errors import StatError
from estimara.operators import glm, linear, panel

# The Longley data and their certified regression (NIST StRD).
LONGLEY = """60323 83.0 234289 2356 1590 107608 1947;61122 88.5 259426 2325 1456 108632 1948;60171 88.2 258054 3682 1616 109773 1949;61187 89.5 284599 3351 1650 110929 1950
63221 96.2 328975 2099 3099 112075 1951;63639 98.1 346999 1932 3594 113270 1952;64989 99.0 365385 1870 3547 115094 1953;63761 100.0 363112 3578 3350 116219 1954
66019 101.2 397469 2904 3048 117388 1955;67857 104.6 419180 2822 2857 118734 1956;68169 108.4 442769 2936 2798 120445 1957;66513 110.8 444546 4681 2637 121950 1958
68655 112.6 482704 3813 2552 123366 1959;69564 114.2 502601 3931 2514 125368 1960;69331 115.7 518173 4806 2572 127852 1961;70551 116.9 554894 4007 2827 130081 1962"""
COEF = [-3482258.63459582, 15.0618722713733, -0.0358191792925910, -2.02022980381683, -1.03322686717359, -0.0511041056535807, 1829.15146461355]
ERRORS = [890420.383607373, 84.9149257747669, 0.033491007722432, 0.488399681651699, 0.214274163161675, 0.226073200069370, 455.478499142212]
X = ["defl", "gnp", "unemp", "armed", "pop", "year"]


@pytest.fixture(scope="module")
def longley(spark):
    rows = [tuple(map(float, r.split())) for r in LONGLEY.replace("\n", ";").split(";")]
    return spark.createDataFrame(rows, "total double, " + ", ".join(f"{x} double" for x in X))


@pytest.mark.parametrize("parts", [1, 7])
def test_longley(longley, parts):
    fit = linear.regress(longley.repartition(parts), "total", X)
    assert fit.terms == ["_cons", *X]
    assert fit.coef == pytest.approx(COEF, rel=1e-9) and fit.se == pytest.approx(ERRORS, rel=1e-8)
    assert fit.figures["r2"] == pytest.approx(0.995479004577296, abs=1e-12) and fit.figures["rmse"] == pytest.approx(304.854073561965, rel=1e-9)


@pytest.fixture(scope="module")
def data(spark):
    draw = np.random.default_rng(11)
    n = 240
    entity = np.arange(n) % 30
    a, b = draw.normal(size=n) + entity / 10 + 50, draw.exponential(size=n)
    z = a + draw.normal(size=n)
    u = draw.normal(size=n) * (1 + b)
    y = 3 + 2 * a - b + entity / 5 + u
    w = draw.uniform(0.5, 2, size=n)
    table = {"i": np.arange(n), "entity": entity, "a": a, "b": b, "z": z, "z2": a * 0.5 + draw.normal(size=n), "y": y, "w": w, "d": (draw.random(n) < 1 / (1 + np.exp(-(a - 51.5)))).astype(float), "c": draw.poisson(np.exp(0.3 + 0.4 * b / 2)).astype(float), "t": (entity > 14).astype(float), "p": (np.arange(n) >= 120).astype(float)}
    frame = spark.createDataFrame([tuple(float(v[k]) for v in table.values()) for k in range(n)], ", ".join(f"{k} double" for k in table)).repartition(5)
    return table, frame


def design(t, *names, constant=True):
    return np.column_stack([np.ones(len(t["y"]))] * constant + [t[x] for x in names])


def ols(x, y):
    inv = np.linalg.inv(x.T @ x)
    b = inv @ x.T @ y
    return b, y - x @ b, inv


def sandwich(x, u, inv, kind):
    n, k = x.shape
    h = np.einsum("ij,jk,ik->i", x, inv, x)
    w = {"hc0": u**2, "hc1": u**2 * n / (n - k), "robust": u**2 * n / (n - k), "hc2": u**2 / (1 - h), "hc3": u**2 / (1 - h) ** 2}[kind]
    return inv @ (x.T * w) @ x @ inv


@pytest.mark.parametrize("kind", ["hc0", "hc1", "robust", "hc2", "hc3"])
def test_robust(data, kind):
    t, df = data
    x = design(t, "a", "b")
    b, u, inv = ols(x, t["y"])
    fit = linear.regress(df, "y", ["a", "b"], vce=kind)
    assert fit.coef == pytest.approx(b, rel=1e-9) and fit.vcov == pytest.approx(sandwich(x, u, inv, kind), rel=1e-8)


def test_cluster_and_hac(data):
    t, df = data
    x = design(t, "a", "b")
    b, u, inv = ols(x, t["y"])
    n, k = x.shape
    s = np.stack([(x * u[:, None])[t["entity"] == g].sum(0) for g in range(30)])
    want = inv @ (s.T @ s) @ inv * 30 / 29 * (n - 1) / (n - k)
    assert linear.regress(df, "y", ["a", "b"], vce="cluster", cluster="entity").vcov == pytest.approx(want, rel=1e-8)
    hc1 = linear.regress(df, "y", ["a", "b"], vce="hc1").vcov
    assert linear.regress(df, "y", ["a", "b"], vce="cluster", cluster="i").vcov == pytest.approx(hc1, rel=1e-9)
    s, meat = x * u[:, None], 0
    for lag in range(4):
        g = s[lag:].T @ s[: n - lag] * (1 - lag / 4)
        meat = meat + (g if not lag else g + g.T)
    fit = linear.regress(df, "y", ["a", "b"], vce="hac", lags=3, order=["i"])
    assert fit.vcov == pytest.approx(inv @ meat @ inv * n / (n - k), rel=1e-8)
    assert linear.regress(df, "y", ["a", "b"], vce="hac", lags=0, order=["i"]).vcov == pytest.approx(hc1, rel=1e-9)


def test_weights_and_no_constant(data):
    t, df = data
    r = np.sqrt(t["w"])[:, None]
    b, u, inv = ols(design(t, "a", "b") * r, t["y"] * r[:, 0])
    fit = linear.regress(df, "y", ["a", "b"], weight="w")
    assert fit.coef == pytest.approx(b, rel=1e-9) and fit.vcov == pytest.approx(inv * (u @ u) / 237, rel=1e-8)
    assert linear.regress(df, "y", ["a", "b"], weight="w", vce="hc1").vcov == pytest.approx(sandwich(design(t, "a", "b") * r, u, inv, "hc1"), rel=1e-8)
    ones = linear.regress(df.withColumn("w", F.lit(1.0)), "y", ["a"], weight="w")
    assert ones.coef == pytest.approx(linear.regress(df, "y", ["a"]).coef, rel=1e-10)
    x = design(t, "a", "b", constant=False)
    b, u, inv = ols(x, t["y"])
    fit = linear.regress(df, "y", ["a", "b"], constant=False)
    assert fit.terms == ["a", "b"] and fit.coef == pytest.approx(b, rel=1e-9) and fit.vcov == pytest.approx(inv * (u @ u) / 238, rel=1e-8)
    b, u, inv = ols(x * r, t["y"] * r[:, 0])
    both = lambda **options: linear.regress(df, "y", ["a", "b"], weight="w", constant=False, **options)
    fit = both()
    assert fit.kind == "wls" and fit.coef == pytest.approx(b, rel=1e-9) and fit.vcov == pytest.approx(inv * (u @ u) / 238, rel=1e-8) and fit.n == 240
    for kind in ("hc0", "hc1", "hc2", "hc3"):
        assert both(vce=kind).vcov == pytest.approx(sandwich(x * r, u, inv, kind), rel=1e-8)
    score = (x * r) * u[:, None]
    sums = np.array([score[t["entity"] == g].sum(axis=0) for g in np.unique(t["entity"])])
    g = len(sums)
    assert both(vce="cluster", cluster="entity").vcov == pytest.approx(inv @ (sums.T @ sums) @ inv * g / (g - 1) * 239 / 238, rel=1e-8)


def test_diagnostics(data):
    t, df = data
    x = design(t, "a", "b")
    b, u, inv = ols(x, t["y"])
    n = len(u)
    d = linear.fitted(df, "y", ["a", "b"], "hac", lags=0, order=["i"])[1]
    r2 = lambda m, v: 1 - (ols(m, v)[1] ** 2).sum() / ((v - v.mean()) ** 2).sum()
    assert linear.vif(d)["a"] == pytest.approx(1 / (1 - r2(design(t, "b"), t["a"])), rel=1e-8)
    assert linear.breusch_pagan(d)[0] == pytest.approx(n * r2(x, u**2), rel=1e-7)
    fit = x @ b
    aux = (ols(np.column_stack([x, (fit - fit.mean()) ** 2, (fit - fit.mean()) ** 3]), t["y"])[1] ** 2).sum()
    assert linear.reset(d)[0] == pytest.approx(((u @ u) - aux) / 2 / (aux / (n - 5)), rel=1e-6)
    assert linear.durbin_watson(d, ["i"]) == pytest.approx((np.diff(u) ** 2).sum() / (u @ u), rel=1e-9)
    h = np.einsum("ij,jk,ik->i", x, inv, x)
    cook = u**2 * h / (3 * (u @ u) / (n - 3) * (1 - h) ** 2)
    assert linear.influential(d) == (cook > 4 / n).sum()
    assert linear.condition_number(d) == pytest.approx(np.linalg.cond(x[:, 1:]), rel=1e-8)
    assert {name for name, *_ in linear.diagnostics(d)} >= {"max_vif", "reset_p"}


def test_refusals(spark, data):
    _, df = data
    wrong = [
        ("not_identified", lambda: linear.regress(df.withColumn("e", F.col("a") * 2 + 1), "y", ["a", "e"])), ("not_identified", lambda: linear.regress(df.withColumn("e", F.lit(3.0)), "y", ["a", "e"])),
        ("insufficient_data", lambda: linear.regress(df.limit(2), "y", ["a"])), ("insufficient_data", lambda: linear.regress(df.limit(0), "y", ["a"])), ("invalid_request", lambda: linear.regress(df, "y", ["nope"])), ("syntax", lambda: linear.regress(df, "y", [])),
        ("invalid_request", lambda: linear.regress(df.withColumn("g", F.when(F.col("i") > 5, F.col("i"))), "y", ["a"], vce="cluster", cluster="g")), ("insufficient_data", lambda: linear.regress(df.withColumn("g", F.lit(1)), "y", ["a"], vce="cluster", cluster="g")),
        ("invalid_request", lambda: linear.regress(df, "y", ["a"], vce="hac", lags=500, order=["i"])), ("invalid_request", lambda: linear.regress(df, "y", ["a"], vce="odd")), ("invalid_request", lambda: linear.regress(df.withColumn("w", F.col("w") - 1), "y", ["a"], weight="w")),
        ("not_identified", lambda: panel.ivregress(df, "y", ["a", "b"], ["z"])), ("invalid_request", lambda: panel.did(df, "y", "i", "p")), ("not_identified", lambda: panel.did(df.where("t = 1"), "y", "t", "p")), ("not_identified", lambda: panel.fixed_effects(df, "y", ["entity"], "entity")),
        ("invalid_request", lambda: glm.glm(df, "logit", "y", ["a"])), ("invalid_request", lambda: glm.glm(df.withColumn("c", F.col("c") + 0.5), "poisson", "c", ["b"])), ("not_identified", lambda: glm.glm(df.withColumn("d", F.lit(1.0)), "logit", "d", ["b"])),
    ]
    for kind, call in wrong:
        with pytest.raises(StatError) as e:
            call()
        assert e.value.kind == kind


def test_panel(data, spark):
    t, df = data
    x, g = design(t, "a", "b", constant=False), t["entity"]
    dummies = (g[:, None] == np.arange(30)[None, :]).astype(float)
    b, u, inv = ols(np.column_stack([x, dummies]), t["y"])
    fe = panel.fixed_effects(df, "y", ["a", "b"], "entity")
    assert fe.coef == pytest.approx(b[:2], rel=1e-8) and fe.vcov == pytest.approx((inv * (u @ u) / (240 - 32))[:2, :2], rel=1e-7) and fe.df == 208
    xd = x - np.stack([x[g == k].mean(0) for k in range(30)])[g]
    ud, iv = u, np.linalg.inv(xd.T @ xd)
    s = np.stack([(xd * ud[:, None])[g == k].sum(0) for k in range(30)])
    want = iv @ (s.T @ s) @ iv * 30 / 29 * 239 / 238
    assert panel.fixed_effects(df, "y", ["a", "b"], "entity", vce="cluster").vcov == pytest.approx(want, rel=1e-7)
    assert panel.fixed_effects(df, "y", ["a", "b"], "entity", vce="robust").vcov == pytest.approx(iv @ (xd.T * ud**2) @ xd @ iv * 240 / 238, rel=1e-7)
    alone = df.unionByName(df.limit(1).withColumn("entity", F.lit(1000.0)))
    assert panel.fixed_effects(alone, "y", ["a", "b"], "entity").coef == pytest.approx(b[:2], rel=1e-8)
    means = lambda v: np.array([v[g == k].mean() for k in range(30)])
    bb = ols(np.column_stack([np.ones(30), means(t["a"]), means(t["b"])]), means(t["y"]))[0]
    assert panel.between(df, "y", ["a", "b"], "entity").coef == pytest.approx(bb[1:], rel=1e-7)
    assert panel.pooled(df, "y", ["a", "b"], "entity").coef == pytest.approx(ols(design(t, "a", "b"), t["y"])[0][1:], rel=1e-9)


def test_did(data):
    t, df = data
    cell = lambda a, b: t["y"][(t["t"] == a) & (t["p"] == b)].mean()
    fit = panel.did(df, "y", "t", "p")
    assert fit.terms == ["_cons", "treat", "post", "treat#post"]
    assert fit.figures["att"] == pytest.approx(cell(1, 1) - cell(1, 0) - cell(0, 1) + cell(0, 0), rel=1e-9)
    assert panel.did(df, "y", "t", "p", ["b"], vce="cluster", cluster="entity").terms[-1] == "b"


@pytest.mark.parametrize("vce", ["classical", "robust", "hac"])
def test_two_stage_least_squares(data, vce):
    t, df = data
    x, z = np.column_stack([t["a"], t["b"], np.ones(240)]), np.column_stack([t["z"], t["z2"], t["b"], np.ones(240)])
    hat = z @ np.linalg.solve(z.T @ z, z.T @ x)
    inv = np.linalg.inv(hat.T @ hat)
    b = inv @ hat.T @ t["y"]
    u = t["y"] - x @ b
    s = hat * u[:, None]
    meat = s.T @ s
    if vce == "hac":
        for lag in (1, 2):
            g = s[lag:].T @ s[:-lag] * (1 - lag / 3)
            meat = meat + g + g.T
    want = inv * (u @ u) / 236 if vce == "classical" else inv @ meat @ inv * 240 / 237
    fit = panel.ivregress(df, "y", ["a"], ["z", "z2"], ["b"], vce=vce, lags=2, order=["i"])
    assert fit.terms == ["a", "b", "_cons"] and fit.df == 236
    assert fit.coef == pytest.approx(b, rel=1e-7) and fit.vcov == pytest.approx(want, rel=1e-6)
    full, part = ols(z, t["a"])[1], ols(np.column_stack([t["b"], np.ones(240)]), t["a"])[1]
    assert fit.figures["first_stage_f_a"] == pytest.approx((part @ part - full @ full) / 2 / (full @ full / 236), rel=1e-7)


def newton(x, y, family):
    phi = lambda e: np.exp(-e * e / 2) / math.sqrt(2 * math.pi)
    cdf = np.vectorize(lambda v: math.erfc(-v / math.sqrt(2)) / 2)
    b = np.zeros(x.shape[1])
    for _ in range(200):
        e = x @ b
        mu = {"logit": lambda: 1 / (1 + np.exp(-e)), "probit": lambda: cdf(e), "poisson": lambda: np.exp(e)}[family]()
        score = (y - mu) * phi(e) / (mu * (1 - mu)) if family == "probit" else y - mu
        w = phi(e) ** 2 / (mu * (1 - mu)) if family == "probit" else mu * (1 - mu) if family == "logit" else mu
        step = np.linalg.solve((x.T * w) @ x, x.T @ score)
        b = b + step
        if abs(step).max() < 1e-13:
            break
    inv = np.linalg.inv((x.T * w) @ x)
    return b, inv, inv @ (x.T * score**2) @ x @ inv, mu


@pytest.mark.parametrize("family, y, names", [("logit", "d", ["a", "b"]), ("probit", "d", ["a", "b"]), ("poisson", "c", ["b"])])
def test_glm(data, family, y, names):
    t, df = data
    x = design(t, *names)
    b, v, robust, mu = newton(np.column_stack([x[:, :1], x[:, 1:] - x[:, 1:].mean(0)]), t[y], family)
    fit = glm.glm(df, family, y, names)
    assert fit.coef[1:] == pytest.approx(b[1:], rel=1e-6) and fit.vcov[1:, 1:] == pytest.approx(v[1:, 1:], rel=1e-5) and fit.figures["converged"] == 1 and not fit.notes
    assert fit.coef[0] == pytest.approx(b[0] - b[1:] @ x[:, 1:].mean(0), rel=1e-6)
    assert glm.glm(df, family, y, names, robust=True).vcov[1:, 1:] == pytest.approx(robust[1:, 1:], rel=1e-5)
    ll = (t[y] * np.log(mu) - mu - np.array([math.lgamma(v + 1) for v in t[y]])).sum() if family == "poisson" else (t[y] * np.log(mu) + (1 - t[y]) * np.log(1 - mu)).sum()
    assert fit.figures["loglik"] == pytest.approx(ll, rel=1e-8)


def test_separation_and_legacy_probit(spark, data):
    apart = spark.createDataFrame([(float(i), float(i >= 20)) for i in range(40)], "x double, y double")
    assert any("separated" in note for note in glm.glm(apart, "logit", "y", ["x"]).notes)
    t, df = data
    fit = glm.glm(df, "probit", "d", ["a"], compat=True)
    e = fit.coef[0] + fit.coef[1] * t["a"]
    gap = np.exp(-e * e / 2) * (t["d"] - np.vectorize(lambda v: math.erfc(-v / math.sqrt(2)) / 2)(e))
    assert abs(gap.sum()) < 1e-3 and abs((gap * (t["a"] - 50)).sum()) < 1e-2
    assert fit.figures["loglik"] < glm.glm(df, "probit", "d", ["a"]).figures["loglik"]
