"""Logit, probit and Poisson regression: Fisher scoring with one aggregation a step."""

from __future__ import annotations

import math
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import StatError, too_few
from ..functions.dist import normal_cdf, normal_quantile
from ..plans.moments import collinear, cross_sums, moments, pairs, symmetric
from ..plans.staging import stage
from .frame import check_numeric, complete_cases
from .linear import CONSTANT, Fit

MAX_STEPS, TOLERANCE = 200, 1e-10
#: Bounds of the linear predictor (logit; Poisson above only) and of probabilities.
ETA, MU = 30.0, 1e-10


# Cody's rational approximations of the error function (1969), numerators and denominators from the highest power;
# of erf(x) / x in x^2 below 0.46875, of exp(x^2) erfc(x) in x up to 4, and of its remainder in 1 / x^2 beyond.
ERF_TOP = [1.85777706184603153e-1, 3.16112374387056560e00, 1.13864154151050156e02, 3.77485237685302021e02, 3.20937758913846947e03]
ERF_LOW = [1.0, 2.36012909523441209e01, 2.44024637934444173e02, 1.28261652607737228e03, 2.84423683343917062e03]
MID_TOP = [2.15311535474403846e-8, 5.64188496988670089e-1, 8.88314979438837594e00, 6.61191906371416295e01, 2.98635138197400131e02, 8.81952221241769090e02, 1.71204761263407058e03, 2.05107837782607147e03, 1.23033935479799725e03]
MID_LOW = [1.0, 1.57449261107098347e01, 1.17693950891312499e02, 5.37181101862009858e02, 1.62138957456669019e03, 3.29079923573345963e03, 4.36261909014324716e03, 3.43936767414372164e03, 1.23033935480374942e03]
FAR_TOP = [1.63153871373020978e-2, 3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4]
FAR_LOW = [1.0, 2.56852019228982242e00, 1.87295284992346725e00, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3]


def _polynomial(x: Column, factors: list[float]) -> Column:
    return reduce(lambda sum_, f: sum_ * x + f, factors[1:], F.lit(factors[0]))


def _normal_cdf(z: Column) -> Column:
    """Spark has no error function; this one is made of column expressions."""
    x = F.abs(z) / math.sqrt(2)
    square, over = x * x, 1 / (x * x)
    near = 1 - x * _polynomial(square, ERF_TOP) / _polynomial(square, ERF_LOW)
    middle = F.exp(-square) * _polynomial(x, MID_TOP) / _polynomial(x, MID_LOW)
    far = F.exp(-square) / x * (1 / math.sqrt(math.pi) - over * _polynomial(over, FAR_TOP) / _polynomial(over, FAR_LOW))
    upper = F.when(x < 0.46875, near).when(x <= 4, middle).otherwise(far) / 2
    return F.when(z < 0, upper).otherwise(1 - upper)


def _log_factorial(v: Column) -> Column:
    def logs(x: pd.Series) -> pd.Series:
        return pd.Series([math.lgamma(v + 1) for v in x])

    return F.pandas_udf(logs, "double")(v)


def _parts(family: str, eta: Column, y: Column) -> tuple[Column, Column, Column]:
    """Mean, score and expected weight of each row, per unit of the linear predictor."""
    if family == "poisson":
        mu = F.exp(F.least(eta, F.lit(ETA)))
        return mu, y - mu, mu
    if family == "logit":
        e = F.greatest(F.least(eta, F.lit(ETA)), F.lit(-ETA))
        mu = 1 / (1 + F.exp(-e))
        return mu, y - mu, mu * (1 - mu)
    mu = F.greatest(F.least(F.col("__cdf"), F.lit(1 - MU)), F.lit(MU))
    density = F.exp(-eta * eta / 2) / math.sqrt(2 * math.pi)
    return mu, (y - mu) * density / (mu * (1 - mu)), density * density / (mu * (1 - mu))


def _loglik(family: str, mu: Column, eta: Column, y: Column) -> Column:
    if family == "poisson":
        return y * F.least(eta, F.lit(ETA)) - mu
    p = F.greatest(F.least(mu, F.lit(1 - MU)), F.lit(MU))
    return F.when(y == 1, F.ln(p)).otherwise(F.ln(1 - p))


def glm(df: DataFrame, family: str, y: str, x: list[str], robust: bool = False, compat: bool = False) -> Fit:
    """Maximum likelihood with a constant, first. robust: a sandwich of the scores, without a small-sample factor.

    compat (probit): solves sum of density * (y - mu) * x = 0, an estimating equation once published in place
    of the likelihood's. No convergence and separation give notes, not errors.
    """
    if family not in ("logit", "probit", "poisson"):
        raise StatError("invalid_request", f"'{family}' is unknown.", "Families are logit, probit and poisson.", "Choose one.")
    check_numeric(df, [y, *x])
    value = F.col(y).cast("double")
    rows = stage(complete_cases(df, [y, *x]).select(value.alias("__y"), *(F.col(c).cast("double").alias(f"__x{i}") for i, c in enumerate(x))), "glm")
    k = len(x) + 1
    n, mean, ok = rows.agg(F.count("*"), F.avg("__y"), F.bool_and(F.col("__y").isin(0.0, 1.0) if family != "poisson" else (F.col("__y") >= 0) & (F.col("__y") == F.rint("__y")))).first()
    if n < k + 1:
        raise too_few("The model", k + 1, n)
    if not ok:
        raise StatError("invalid_request", f"'{y}' doesn't suit the model.", "It must be 0 or 1." if family != "poisson" else "It must be whole numbers from zero.", "Choose another outcome.")
    if not 0 < mean < (1 if family != "poisson" else math.inf):
        raise StatError("not_identified", f"'{y}' doesn't vary.", "All outcomes are alike.", "Check the data.")
    names = [f"__x{i}" for i in range(len(x))]
    m = moments(rows, names)
    if bad := [x[names.index(b)] for b in collinear(m.cross, names)]:
        raise StatError("not_identified", f"{', '.join(bad)}: the model isn't identified.", "These columns are linear combinations of those before them.", "Leave them out.")
    centre, size = m.means, np.sqrt(np.diag(m.cross) / n)
    z = [F.lit(1.0)] + [(F.col(c) - float(a)) / float(s) for c, a, s in zip(names, centre, size)]
    outcome = F.col("__y")

    def at(beta: np.ndarray) -> tuple[DataFrame, Column]:
        eta = reduce(add, (float(b) * c for b, c in zip(beta, z)))
        held = rows.withColumn("__eta", eta)
        return (held.withColumn("__cdf", _normal_cdf(F.col("__eta"))) if family == "probit" else held), F.col("__eta")

    beta = np.zeros(k)
    beta[0] = {"logit": math.log(mean / (1 - mean)) if mean < 1 else 0.0, "poisson": math.log(mean), "probit": normal_quantile(mean) if mean < 1 else 0.0}[family]
    constant = 0.0
    if family == "poisson":  # ln y!, once for each outcome that occurs
        constant = -rows.groupBy("__y").agg(F.count("*").alias("c")).agg(F.sum(F.col("c") * _log_factorial(F.col("__y")))).first()[0]

    def step_at(beta: np.ndarray) -> tuple[float, float, np.ndarray, np.ndarray]:
        held, eta = at(beta)
        mu, score, weight = _parts(family, eta, outcome)
        if compat and family == "probit":
            density = F.exp(-eta * eta / 2) / math.sqrt(2 * math.pi)
            score, weight = (outcome - mu) * density, density * density
        row = held.agg(F.sum(_loglik(family, mu, eta, outcome)), F.max(F.abs(eta)), *(F.sum(score * c) for c in z), *(F.sum(weight * z[i] * z[j]) for i, j in pairs(k))).first()
        return row[0] + constant, row[1], np.array(row[2 : 2 + k], float), symmetric(list(row[2 + k :]), k)

    notes, converged, before = [], False, -math.inf
    loglik, most, gradient, information = step_at(beta)
    steps = 0
    for steps in range(1, MAX_STEPS + 1):
        try:
            change = np.linalg.solve(information, gradient)
        except np.linalg.LinAlgError:
            break
        before, beta = loglik, beta + change
        loglik, most, gradient, information = step_at(beta)
        if np.abs(change).max() < TOLERANCE or abs(loglik - before) < TOLERANCE * 1e-4 * (1 + abs(loglik)):
            converged = True
            break
    if not converged:
        notes.append("The iterations did not converge.")
    if most > 20:
        notes.append("Some fitted values are extreme; the outcome may be separated.")
    bread = np.linalg.pinv(information)
    v = bread
    if robust:
        held, eta = at(beta)
        _, score, _ = _parts(family, eta, outcome)
        v = bread @ cross_sums(held, z, score * score)[1] @ bread
    back = np.zeros((k, k))
    back[0, 0], back[1:, 1:], back[0, 1:] = 1.0, np.diag(1 / size), -centre / size
    if family == "poisson":
        null = n * (mean * math.log(mean) - mean) + constant
    else:
        null = n * (mean * math.log(mean) + (1 - mean) * math.log(1 - mean))
    figures = {"loglik": loglik, "null_loglik": null, "pseudo_r2": 1 - loglik / null if null else math.nan, "aic": -2 * loglik + 2 * k, "bic": -2 * loglik + k * math.log(n), "iterations": steps, "converged": float(converged)}
    return Fit(family, y, [CONSTANT, *x], back @ beta, back @ v @ back.T, None, n, figures, notes)


def fitted_mean(family: str, eta: float) -> float:
    return {"logit": lambda e: 1 / (1 + math.exp(-e)), "probit": normal_cdf, "poisson": math.exp}[family](eta)


