"""Linear regression from cross-moments, with classical, robust, clustered and Newey-West covariances."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce
from operator import add

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import StatError, too_few
from ..functions.dist import chi2_upper, f_upper, normal_p, t_p, t_quantile, Z95
from ..functions.order import autocovariances
from ..plans.blocks import summed
from ..plans.moments import WIDE, Moments, collinear, cross_sums, moments, qr_factor
from .frame import check_names, check_numeric, fresh, has_value

CONSTANT = "_cons"
TIDY = "term string, coef double, se double, stat double, p double, ci_low double, ci_high double"
#: Largest leverage that HC2 and HC3 reckon with.
MAX_LEVERAGE = 0.999999


@dataclass
class Fit:
    """A fitted model: coefficients with inference, and named figures of the fit."""

    kind: str
    outcome: str
    terms: list[str]
    coef: np.ndarray
    vcov: np.ndarray
    df: float | None  # None: normal
    n: int
    figures: dict[str, float] = field(default_factory=dict)
    notes: list[str] = field(default_factory=list)
    #: (check, value, verdict) of a regression's diagnostics, where they were asked for.
    checks: list[tuple[str, float, str]] = field(default_factory=list)

    @property
    def se(self) -> np.ndarray:
        return np.sqrt(np.maximum(np.diag(self.vcov), 0))

    @property
    def stat(self) -> np.ndarray:
        return np.divide(self.coef, self.se, out=np.full(len(self.coef), np.nan), where=self.se > 0)

    @property
    def p(self) -> list[float]:
        return [normal_p(x) if self.df is None else t_p(x, self.df) for x in self.stat]

    def interval(self) -> tuple[np.ndarray, np.ndarray]:
        half = (Z95 if self.df is None else t_quantile(0.975, self.df)) * self.se
        return self.coef - half, self.coef + half

    def rows(self) -> list[tuple]:
        low, high = self.interval()
        return [(t, *(float(x) for x in r)) for t, *r in zip(self.terms, self.coef, self.se, self.stat, self.p, low, high)]

    def to_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows(), TIDY)


@dataclass
class Design:
    """Rows of a regression, its moments, and the solution in centred columns.

    With z = [1, x - means], Z'Z is the number of rows beside the centred
    cross-products, so nothing is lost to large means; ``back`` takes
    coefficients of z to those of [1, x].
    """

    rows: DataFrame
    y: str
    x: list[str]
    m: Moments
    constant: bool
    inverse: np.ndarray
    back: np.ndarray
    beta: np.ndarray
    rss: float
    weight: str | None = None

    @property
    def k(self) -> int:
        return len(self.x) + self.constant

    @property
    def terms(self) -> list[str]:
        return [CONSTANT] * self.constant + self.x

    def z(self) -> list[Column]:
        centred = [F.col(c).cast("double") - (float(v) if self.constant else 0.0) for c, v in zip(self.x, self.m.mean(self.x))]
        return [F.lit(1.0)] * self.constant + centred

    def residual(self) -> Column:
        slopes = self.beta[self.constant :]
        start = F.col(self.y).cast("double") - (float(self.m.mean([self.y])[0]) if self.constant else 0.0)
        return start - reduce(add, (float(b) * c for b, c in zip(slopes, self.z()[self.constant :])), F.lit(0.0))

    def leverage(self) -> Column:
        z, a = self.z(), self.inverse
        return reduce(add, (float(a[i, j]) * z[i] * z[j] for i in range(len(z)) for j in range(len(z))))

    # Diagnostics look at the rows scaled by the weights' roots: that is the regression that was solved.

    def root(self) -> Column:
        return F.sqrt(F.col(self.weight).cast("double")) if self.weight else F.lit(1.0)

    def scaled_residual(self) -> Column:
        return self.residual() * self.root() if self.weight else self.residual()

    def scaled_leverage(self) -> Column:
        return self.leverage() * F.col(self.weight).cast("double") if self.weight else self.leverage()


def design(rows: DataFrame, y: str, x: list[str], constant: bool = True, weight: str | None = None) -> Design:
    """Moments in one pass, a small solve, and a check that every column adds something.

    Without a constant, columns aren't centred; the factor R of one distributed
    QR (of rows times the weights' roots) stands for the moments then, which
    keeps the digits that products would lose.
    """
    k = len(x) + constant
    if constant:
        m = moments(rows, [*x, y], weight)
        if m.n <= k:
            raise too_few("The regression", k + 1, m.n)
        sxx, sxy = m.block(x, x), m.block(x, [y])[:, 0]
    else:
        r, n = qr_factor(rows, [*x, y], weight)
        if n <= k:
            raise too_few("The regression", k + 1, n)
        cross = r.T @ r
        m = Moments([*x, y], n, float(n), np.zeros(k + 1), cross)
        sxx, sxy = cross[:k, :k], cross[:k, k]
    if bad := collinear(sxx, x):
        raise StatError("not_identified", f"{', '.join(bad)}: the model isn't identified.", "These columns are linear combinations of those before them.", "Leave them out.")
    if not constant:
        back = np.linalg.inv(r[:k, :k])
        return Design(rows, y, x, m, False, back @ back.T, np.eye(k), back @ r[:k, k], float(r[k, k] ** 2) if len(r) > k else 0.0, weight)
    size = np.sqrt(np.diag(sxx))
    scaled = np.linalg.inv(sxx / np.outer(size, size))
    inv = scaled / np.outer(size, size)
    slopes = (scaled @ (sxy / size)) / size
    syy = m.block([y], [y])[0, 0]
    rss = max(0.0, float(syy - slopes @ sxy))
    whole = np.zeros((k, k))
    whole[0, 0], whole[1:, 1:] = 1 / m.weight, inv
    back = np.eye(k)
    back[0, 1:] = -m.mean(x)
    return Design(rows, y, x, m, True, whole, back, np.append(m.mean([y])[0], slopes), rss, weight)


def robust_meat(d: Design, kind: str) -> np.ndarray:
    """Of rows scaled by the weights' roots. With many columns, residuals and leverages are taken in blocks of numbers, too."""
    if d.k > WIDE:
        return _robust_blocks(d, kind)
    u, w = d.residual(), F.col(d.weight).cast("double") if d.weight else F.lit(1.0)
    h = F.least(d.scaled_leverage(), F.lit(MAX_LEVERAGE))
    weight = {"hc0": u * u, "hc1": u * u, "hc2": u * u / (1 - h), "hc3": u * u / ((1 - h) * (1 - h))}[kind]
    n, meat = cross_sums(d.rows, d.z(), weight * w * w if d.weight else weight)
    return meat * (n / (n - d.k) if kind == "hc1" else 1.0)


def _robust_blocks(d: Design, kind: str) -> np.ndarray:
    power, k, slopes = {"hc0": 0, "hc1": 0, "hc2": 1, "hc3": 2}[kind], len(d.x), d.beta[d.constant :]
    means, mean, inverse, constant = (d.m.mean(d.x), d.m.mean([d.y])[0], d.inverse, d.constant) if d.constant else (np.zeros(k), 0.0, d.inverse, False)

    def part(x: np.ndarray) -> np.ndarray:
        centred = x[:, :k] - means
        z, w = np.column_stack([np.ones(len(x)), centred]) if constant else centred, x[:, k + 1]
        u = x[:, k] - mean - centred @ slopes
        h = np.minimum(((z @ inverse) * z).sum(axis=1) * w, MAX_LEVERAGE)
        return (z * (u * u * w * w / (1 - h) ** power)[:, None]).T @ z

    w = F.col(d.weight) if d.weight else F.lit(1.0)
    meat = summed(d.rows, [*(F.col(c) for c in d.x), F.col(d.y), w], part, (d.k, d.k))
    return meat * (d.m.n / (d.m.n - d.k) if kind == "hc1" else 1.0)


def cluster_meat(d: Design, cluster: str) -> tuple[np.ndarray, int]:
    """Scores are summed by cluster, partly before the shuffle; then their products over clusters."""
    if d.rows.where(~has_value(d.rows, cluster)).limit(1).count():
        raise StatError("invalid_request", f"'{cluster}' has missing values.", "Every row of the regression needs a cluster.", "Drop these rows first.")
    u = d.residual() * (F.col(d.weight).cast("double") if d.weight else 1.0)
    sums = d.rows.groupBy(cluster).agg(*(F.sum(u * z).alias(f"s{i}") for i, z in enumerate(d.z())))
    groups, meat = cross_sums(sums, [F.col(f"s{i}") for i in range(d.k)])
    if groups < 2:
        raise StatError("insufficient_data", "Clustered errors need two clusters.", f"'{cluster}' has {groups}.", "Choose another cluster variable.")
    n = d.m.n
    return meat * groups / (groups - 1) * (n - 1) / (n - d.k), groups


def hac_meat(d: Design, lags: int, order: list[str]) -> np.ndarray:
    """Newey-West with Bartlett weights; ``order`` gives the rows' order in time."""
    return newey_west(d.rows, [d.residual() * z for z in d.z()], d.m.n, lags, order)


def newey_west(rows: DataFrame, scores: list[Column], n: int, lags: int, order: list[str]) -> np.ndarray:
    """Of the scores of n rows, with n / (n - k)."""
    k = len(scores)
    if lags < 0 or lags + 1 >= n:
        raise StatError("invalid_request", f"{lags} lags can't be used.", f"There are {n} rows.", "Use fewer lags.")
    names = [f"s{i}" for i in range(k)]
    keys = [f"o{i}" for i in range(len(order))]
    rows = rows.select(*(F.col(c).alias(o) for o, c in zip(keys, order)), *(x.alias(c) for x, c in zip(scores, names)))
    if not lags:
        return cross_sums(rows, [F.col(c) for c in names])[1] * n / (n - k)
    own, *lagged = autocovariances(rows, keys, names, lags).products
    meat = own + sum((1 - lag / (lags + 1)) * (p + p.T) for lag, p in enumerate(lagged, 1))
    return meat * n / (n - k)


def covariance(d: Design, vce: str, cluster: str | None, lags: int, order: list[str] | None, figures: dict) -> np.ndarray:
    if vce == "classical":
        return d.inverse * d.rss / (d.m.n - d.k)
    if vce in ("robust", "hc0", "hc1", "hc2", "hc3"):
        meat = robust_meat(d, "hc1" if vce == "robust" else vce)
    elif vce == "cluster" and cluster:
        meat, figures["clusters"] = cluster_meat(d, cluster)
    elif vce == "hac" and order:
        meat = hac_meat(d, lags, order)
    else:
        raise StatError("invalid_request", f"'{vce}' can't be estimated.", "It is unknown, or lacks its cluster or order variable.", "Use classical, robust, hc0 to hc3, cluster (with one) or hac (with lags and order).")
    return d.inverse @ meat @ d.inverse


def regress(df: DataFrame, y: str, x: list[str], vce: str = "classical", cluster: str | None = None, lags: int = 0, order: list[str] | None = None, weight: str | None = None, constant: bool = True) -> Fit:
    """Ordinary or weighted least squares over rows complete in y and x (and the weight, which must be positive)."""
    return fitted(df, y, x, vce, cluster, lags, order, weight, constant)[0]


def fitted(df: DataFrame, y: str, x: list[str], vce: str = "classical", cluster: str | None = None, lags: int = 0, order: list[str] | None = None, weight: str | None = None, constant: bool = True) -> tuple[Fit, Design]:
    if not x:
        raise StatError("syntax", "A regression needs a predictor.", "None was given.", "Name one.")
    check_numeric(df, [y, *x, *([weight] if weight else [])])
    extra = [c for c in [cluster, *(order or [])] if c]
    check_names(df, extra)
    rows = df.select(*dict.fromkeys([y, *x, *extra, *([weight] if weight else [])]))
    for name in dict.fromkeys([y, *x, *([weight] if weight else [])]):
        rows = rows.where(has_value(df, name))
    if weight and rows.where(~((F.col(weight) > 0) & (F.col(weight) < float("inf")))).limit(1).count():
        raise StatError("invalid_request", f"'{weight}' has weights that aren't positive.", "Weights must be finite and above zero.", "Drop these rows first.")
    d = design(rows, y, x, constant, weight)
    n, k = d.m.n, d.k
    syy = d.m.block([y], [y])[0, 0]
    r2 = float(np.clip(1 - d.rss / syy, -1e-12, 1)) if syy > 0 else math.nan
    sigma2 = d.rss / n
    loglik = -n / 2 * (math.log(2 * math.pi * sigma2) + 1) if sigma2 > 0 else math.inf
    f = (r2 / len(x)) / ((1 - r2) / (n - k)) if constant and r2 < 1 else math.inf if r2 == 1 else math.nan
    figures = {"r2": r2, "adj_r2": 1 - (1 - r2) * (n - 1) / (n - k), "rmse": math.sqrt(d.rss / (n - k)), "f": f, "f_p": f_upper(f, len(x), n - k) if f < math.inf else 0.0, "loglik": loglik, "aic": -2 * loglik + 2 * k, "bic": -2 * loglik + k * math.log(n), "rss": d.rss, "df": n - k}
    v = d.back @ covariance(d, vce, cluster, lags, order, figures) @ d.back.T
    return Fit("ols" if not weight else "wls", y, d.terms, d.back @ d.beta, v, n - k, n, figures), d


def vif(d: Design) -> dict[str, float]:
    """Of regressions of each regressor on the others and a constant (whether the model has one or not), weighted like it; constant regressors have none."""
    m = d.m if d.constant else moments(d.rows, d.x, d.weight)
    s = m.block(d.x, d.x)
    some = np.flatnonzero(np.diag(s) > 1e-12 * (np.diag(s) + m.weight * m.mean(d.x) ** 2))
    s = s[np.ix_(some, some)]
    inv = np.linalg.pinv(s / np.sqrt(np.outer(np.diag(s), np.diag(s))), hermitian=True)
    return dict(zip((d.x[i] for i in some), (float(min(v, 1e12)) for v in np.diag(inv))))


def breusch_pagan(d: Design) -> tuple[float, int, float]:
    """Koenker's LM = n R2 (about the mean) of the squared scaled residuals on the regressors, with a constant if the model has one; df and p."""
    (u2,) = fresh(d.rows.columns, "u2")
    rows = d.rows.withColumn(u2, d.scaled_residual() * d.scaled_residual())
    aux = design(rows, u2, d.x, d.constant)
    total = aux.m.block([u2], [u2])[0, 0] if d.constant else float(rows.agg(F.var_pop(u2)).first()[0] or 0.0) * d.m.n
    lm = d.m.n * (1 - aux.rss / total) if total > 0 else 0.0
    lm = max(0.0, lm) if d.constant else lm
    return lm, len(d.x), chi2_upper(max(lm, 0.0), len(d.x))


def reset(d: Design) -> tuple[float, int, int, float]:
    """Ramsey's F for squares and cubes of the fitted values in the model as it is, with its weights and with or without a constant.

    Fitted values are scaled, and centred where there is a constant: that spans the same space.
    """
    spread = math.sqrt(max(d.m.block([d.y], [d.y])[0, 0], 1e-300) / d.m.weight)
    fit = (F.col(d.y).cast("double") - d.residual() - (float(d.m.mean([d.y])[0]) if d.constant else 0.0)) / spread
    squares, cubes = fresh(d.rows.columns, "fit2", "fit3")
    rows = d.rows.withColumn(squares, fit * fit).withColumn(cubes, fit * fit * fit)
    df2 = d.m.n - d.k - 2
    if df2 <= 0:
        raise too_few("RESET", d.k + 3, d.m.n)
    try:
        aux = design(rows, d.y, [*d.x, squares, cubes], d.constant, d.weight)
    except StatError:
        return math.nan, 2, df2, math.nan
    f = max(0.0, d.rss - aux.rss) / 2 / (aux.rss / df2) if aux.rss > 0 else math.inf
    return f, 2, df2, f_upper(f, 2, df2) if f < math.inf else 0.0


def durbin_watson(d: Design, order: list[str]) -> float:
    """Squared first differences from products of residuals with themselves and their neighbours, and the two at the ends."""
    keys = [f"o{i}" for i in range(len(order))]
    got = autocovariances(d.rows.select(*(F.col(c).alias(o) for o, c in zip(keys, order)), d.residual().alias("u")), keys, ["u"], 1)
    own, lagged = got.products[:, 0, 0]
    return float(2 * own - got.first[0] ** 2 - got.last[0] ** 2 - 2 * lagged) / own if own else math.nan


def cooks_distance(d: Design) -> Column:
    h, u = F.least(d.scaled_leverage(), F.lit(MAX_LEVERAGE)), d.scaled_residual()
    return u * u * h / (d.k * (d.rss / (d.m.n - d.k)) * (1 - h) * (1 - h))


def standardized_residual(d: Design) -> Column:
    return d.scaled_residual() / F.sqrt((d.rss / (d.m.n - d.k)) * (1 - F.least(d.scaled_leverage(), F.lit(MAX_LEVERAGE))))


def influential(d: Design) -> int:
    """Rows whose distance is above 4 / n."""
    if d.k <= WIDE:
        return d.rows.agg(F.sum((cooks_distance(d) > 4 / d.m.n).cast("long"))).first()[0] or 0
    k, slopes, s2, means, n = len(d.x), d.beta[d.constant :], d.rss / (d.m.n - d.k), d.m.mean(d.x) if d.constant else np.zeros(len(d.x)), d.m.n
    mean, inverse, constant, every = d.m.mean([d.y])[0] if d.constant else 0.0, d.inverse, d.constant, d.k

    def part(x: np.ndarray) -> np.ndarray:
        centred = x[:, :k] - means
        z, w = np.column_stack([np.ones(len(x)), centred]) if constant else centred, x[:, k + 1]
        u2 = (x[:, k] - mean - centred @ slopes) ** 2 * w
        h = np.minimum(((z @ inverse) * z).sum(axis=1) * w, MAX_LEVERAGE)
        return np.array([(u2 * h / (every * s2 * (1 - h) ** 2) > 4 / n).sum()], float)

    w = F.col(d.weight) if d.weight else F.lit(1.0)
    return int(summed(d.rows, [*(F.col(c) for c in d.x), F.col(d.y), w], part, (1,))[0])


def condition_number(d: Design) -> float:
    """Of the regressors as they are (scaled by the weights' roots), without the constant."""
    cross = d.m.block(d.x, d.x) + d.m.weight * np.outer(d.m.mean(d.x), d.m.mean(d.x)) * d.constant
    values = np.linalg.eigvalsh(cross)
    return math.sqrt(values[-1] / values[0]) if values[0] > 0 else math.inf


def diagnostics(d: Design) -> list[tuple[str, float, str]]:
    """(check, value, verdict) of a regression, with or without weights and a constant."""
    cond, worst = condition_number(d), max(vif(d).values(), default=math.nan)
    lm, _, bp = breusch_pagan(d)
    f, _, _, p = reset(d)
    share = influential(d) / d.m.n
    figures = [
        ("sample_size", d.m.n, "ok"),
        ("parameters", d.k, "ok"),
        ("residual_df", d.m.n - d.k, "ok"),
        ("condition_number", cond, "ok" if cond < 1e7 else "warning" if cond < 1e10 else "attention"),
        ("max_vif", worst, "ok" if not worst >= 5 else "warning" if worst < 10 else "attention"),
        ("breusch_pagan_p", bp, "attention" if bp < 0.05 else "ok"),
        ("reset_p", p, "warning" if p < 0.05 else "ok"),
        ("influential_share", share, "warning" if share > 0.05 else "ok"),
    ]
    return [(name, float(value), verdict) for name, value, verdict in figures]


