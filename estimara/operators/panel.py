"""Panel estimators (within, between, pooled), difference in differences, and two-stage least squares."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import StatError, too_few
from ..functions.order import equal_neighbours
from ..plans.moments import collinear, cross_sums, moments, within_moments
from ..plans.staging import stage
from .frame import check_names, check_numeric, complete_cases, has_value
from .linear import CONSTANT, Fit, MAX_LEVERAGE, fitted, newey_west, regress


#: Rows of a range of entities, and of the batches that it gives back.
RANGE_ROWS, BATCH_ROWS = 2_000_000, 100_000
#: Errors of the within estimator.
FE_ERRORS = ("classical", "robust", "hc0", "hc1", "hc2", "hc3", "cluster")


def fixed_effects(df: DataFrame, y: str, x: list[str], entity: str, vce: str = "classical", cluster: str | None = None) -> Fit:
    """Within estimator; entities seen once drop out. Degrees of freedom n - g - k.

    Moments come from sums by entity, without joining means back; only robust
    and clustered errors need the demeaned rows, which one range deal by entity
    gives. Clusters go by their values.
    Their small-sample factors use n/(n-k) and (n-1)/(n-k).
    """
    check_numeric(df, [y, *x])
    check_names(df, [entity, *([cluster] if cluster else [])])
    if vce not in FE_ERRORS:
        raise StatError("invalid_request", f"'{vce}' isn't available here.", f"Fixed effects have {', '.join(FE_ERRORS)} errors.", "Choose one of them.")
    names = [*x, y]
    rows = complete_cases(df, [entity, *names, *([cluster] if cluster else [])])
    got = within_moments(rows, names, entity)
    n, g, k, m = got.n, got.groups, len(x), got.within
    if g < 2 or n - g - k <= 0:
        raise StatError("insufficient_data", "The within estimator needs more data.", f"{g} entities with {n} rows are usable.", "Use entities with two rows or more.")
    sxx, sxy = m.block(x, x), m.block(x, [y])[:, 0]
    total = moments(rows, x).cross
    absorbed = [c for i, c in enumerate(x) if sxx[i, i] <= 1e-12 * max(total[i, i], 1e-300)]
    if bad := absorbed or collinear(sxx, x):
        raise StatError("not_identified", f"{', '.join(bad)}: the model isn't identified.", "They don't vary within entities, or repeat columns before them.", "Leave them out.")
    inv = np.linalg.inv(sxx)
    beta = inv @ sxy
    rss, syy = max(0.0, m.block([y], [y])[0, 0] - beta @ sxy), m.block([y], [y])[0, 0]
    df_t, figures = n - g - k, {}
    if vce == "classical":
        v = inv * rss / df_t
    else:
        centred = demeaned(rows, names, entity, cluster or entity, n)
        z = [F.col(f"x{i}") for i in range(len(names))]
        u = z[-1] - reduce(add, (float(b) * c for b, c in zip(beta, z)))
        if vce == "cluster":
            sums = centred.groupBy("cluster").agg(*(F.sum(u * c).alias(f"s{i}") for i, c in enumerate(z[:-1])))
            clusters, meat = cross_sums(sums, [F.col(f"s{i}") for i in range(k)])
            if clusters < 2:
                raise too_few("Clustered errors", 2, clusters)
            meat, figures["clusters"] = meat * clusters / (clusters - 1) * (n - 1) / (n - k), clusters
        else:
            h = F.least(reduce(add, (float(inv[i, j]) * z[i] * z[j] for i in range(k) for j in range(k))), F.lit(MAX_LEVERAGE))
            by = {"robust": u * u, "hc1": u * u, "hc0": u * u, "hc2": u * u / (1 - h), "hc3": u * u / ((1 - h) * (1 - h))}
            meat = cross_sums(centred, z[:-1], by[vce])[1] * (n / (n - k) if vce in ("robust", "hc1") else 1.0)
        v = inv @ meat @ inv
    figures |= {"groups": g, "r2_within": 1 - rss / syy if syy > 0 else math.nan, "sigma": math.sqrt(rss / df_t), "df": df_t}
    return Fit("fe", y, list(x), beta, v, df_t, n, figures)


def demeaned(df: DataFrame, names: list[str], entity: str, cluster: str, n: int) -> DataFrame:
    """x0, x1, ... (the columns minus their entities' means) and cluster, of entities with two rows or more.

    Rows are dealt by ranges of entities and rows, so an entity with very many
    rows spans several ranges. A range knows the means of the entities that lie
    in it whole; of the first and last one of each range, the sums over all
    ranges are sent round.
    """
    k, spark = len(names), df.sparkSession
    rows = df.select(F.col(entity).alias("entity"), F.col(cluster).alias("cluster"), *(F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(names)))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // RANGE_ROWS))
    dealt = rows.repartitionByRange(parts, F.col("entity"), F.xxhash64(*rows.columns)).sortWithinPartitions("entity")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        x = np.column_stack([table.column(2 + i).to_numpy() for i in range(k)])
        begins = np.append(0, np.flatnonzero(~equal_neighbours([table.column(0).chunk(0)])) + 1)
        size = np.diff(np.append(begins, len(x)))
        means = np.add.reduceat(x, begins, axis=0) / size[:, None]
        edge = np.zeros(len(begins), bool)
        edge[[0, -1]] = True
        group = np.repeat(np.arange(len(begins)), size)
        x = np.where(edge[group][:, None], x, x - means[group])  # of the others, all rows are here
        keep = edge[group] | (size[group] > 1)
        out = [table.column(0).chunk(0), table.column(1).chunk(0), *(pa.array(np.ascontiguousarray(x[:, i])) for i in range(k)), pa.array(edge[group])]
        yield from pa.Table.from_arrays([c.filter(pa.array(keep)) for c in out], [*table.column_names, "edge"]).to_batches(BATCH_ROWS)

    schema = T.StructType([*rows.schema.fields, T.StructField("edge", T.BooleanType())])
    staged = stage(dealt.mapInArrow(run, schema), "entities")
    edges = staged.where("edge").groupBy("entity").agg(F.count("*").alias("n"), *(F.avg(f"x{i}").alias(f"m{i}") for i in range(k)))  # two for each range at most
    joined = staged.join(F.broadcast(edges), "entity", "left").where("not edge or n > 1")
    return joined.select("cluster", *(F.when(F.col("edge"), F.col(f"x{i}") - F.col(f"m{i}")).otherwise(F.col(f"x{i}")).alias(f"x{i}") for i in range(k)))


def between(df: DataFrame, y: str, x: list[str], entity: str, vce: str = "classical") -> Fit:
    """Least squares of the entities' means; the constant isn't reported."""
    check_numeric(df, [y, *x])
    rows = complete_cases(df, [entity, y, *x])
    means = rows.groupBy(entity).agg(*(F.avg(F.col(c).cast("double")).alias(c) for c in dict.fromkeys([y, *x])))
    fit = regress(means, y, x, vce, cluster=entity if vce == "cluster" else None)
    if fit.n < len(x) + 2:
        raise too_few("The between estimator", len(x) + 2, fit.n)
    return Fit("be", y, list(x), fit.coef[1:], fit.vcov[1:, 1:], fit.df, fit.n, {"groups": fit.n, "r2_between": fit.figures["r2"], "df": fit.df})


def pooled(df: DataFrame, y: str, x: list[str], entity: str, vce: str = "classical", cluster: str | None = None) -> Fit:
    """Least squares of all rows that have an entity; the constant isn't reported."""
    check_names(df, [entity])
    fit = regress(df.where(has_value(df, entity)), y, x, vce, cluster)
    return Fit("pooled", y, list(x), fit.coef[1:], fit.vcov[1:, 1:], fit.df, fit.n, {"r2": fit.figures["r2"], "df": fit.df})


def did(df: DataFrame, y: str, treat: str, post: str, controls: list[str] | None = None, vce: str = "classical", cluster: str | None = None) -> Fit:
    """Two groups, two periods: y on treat, post, treat#post and controls. figures has the four cells' means and sizes."""
    controls = controls or []
    check_numeric(df, [y, treat, post, *controls])
    rows = complete_cases(df, [y, treat, post, *controls, *([cluster] if cluster else [])])
    value = F.col(y).cast("double")
    cells = {(r[0], r[1]): (r[2], r[3]) for r in rows.groupBy(F.col(treat).cast("double"), F.col(post).cast("double")).agg(F.avg(value), F.count("*")).limit(10).collect()}
    if not {a for cell in cells for a in cell} <= {0.0, 1.0}:
        raise StatError("invalid_request", "Treatment and period must be 0 or 1.", "Other values were found.", "Recode them.")
    if len(cells) < 4:
        raise StatError("not_identified", "The effect isn't identified.", "One of the four cells of group and period is empty.", "Check both variables.")
    t, p = F.col(treat).cast("double"), F.col(post).cast("double")
    own = {"treat": t, "post": p, "treat#post": t * p}
    names = {f"x{i}": term for i, term in enumerate([*own, *controls])}  # a control may have any name
    columns = [*own.values(), *(F.col(c).cast("double") for c in controls)]
    named = rows.select(value.alias("outcome"), *(c.alias(x) for x, c in zip(names, columns)), *([F.col(cluster).alias("cluster")] if cluster else []))
    fit, _ = fitted(named, "outcome", list(names), vce, "cluster" if cluster else None)
    terms = [names.get(t, t) for t in fit.terms]
    figures = {f"mean_{int(a)}{int(b)}": m for (a, b), (m, _) in cells.items()} | {f"n_{int(a)}{int(b)}": n for (a, b), (_, n) in cells.items()}
    return Fit("did", y, terms, fit.coef, fit.vcov, fit.df, fit.n, {"att": float(fit.coef[terms.index("treat#post")]), "r2": fit.figures["r2"], "df": fit.df} | figures)


def ivregress(df: DataFrame, y: str, endogenous: list[str], instruments: list[str], exogenous: list[str] | None = None, vce: str = "classical", lags: int = 0, order: list[str] | None = None) -> Fit:
    """Two-stage least squares from one set of cross-moments; the constant comes last.

    Classical errors use SSR/(n - z) with z the columns of the instrument
    matrix, and inference n - z degrees of freedom. figures has each first
    stage's F and partial R2: of the excluded instruments, beside the exogenous ones.
    """
    exogenous = exogenous or []
    if len(instruments) < len(endogenous):
        raise StatError("not_identified", "There are too few instruments.", f"{len(endogenous)} endogenous variables need as many.", "Add instruments.")
    check_numeric(df, [y, *endogenous, *instruments, *exogenous])
    rows = complete_cases(df, [y, *endogenous, *instruments, *exogenous, *(order or [])])
    x, z = [*endogenous, *exogenous], [*instruments, *exogenous]
    m = moments(rows, list(dict.fromkeys([y, *x, *z])))
    n, zk, k = m.n, len(z) + 1, len(x) + 1
    if n <= zk:
        raise too_few("Two-stage least squares", zk + 1, n)
    szz, szx = m.block(z, z), m.block(z, x)
    if bad := collinear(szz, z):
        raise StatError("not_identified", f"{', '.join(bad)}: the instruments aren't independent.", "They repeat others.", "Leave them out.")
    first = np.linalg.solve(szz, szx)  # coefficients of the first stages
    hat = szx.T @ first
    if bad := collinear(hat, x):
        raise StatError("not_identified", f"{', '.join(bad)}: the model isn't identified.", "The instruments don't tell these variables apart.", "Use other instruments.")
    inv = np.linalg.inv(hat)
    slopes = inv @ (first.T @ m.block(z, [y])[:, 0])
    means, mean_y = m.mean(x), m.mean([y])[0]
    sxx, sxy, syy = m.block(x, x), m.block(x, [y])[:, 0], m.block([y], [y])[0, 0]
    rss = max(0.0, float(syy - 2 * slopes @ sxy + slopes @ sxx @ slopes))
    bread = np.zeros((k, k))  # of the fitted regressors, centred, and the constant
    bread[:-1, :-1], bread[-1, -1] = inv, 1 / n
    back = np.eye(k)
    back[-1, :-1] = -means
    if vce == "classical":
        v = bread * rss / (n - zk)
    else:
        u = F.col(y).cast("double") - float(mean_y) - reduce(add, (float(b) * (F.col(c).cast("double") - float(s)) for b, c, s in zip(slopes, x, means)))
        zc = [F.col(c).cast("double") - float(s) for c, s in zip(z, m.mean(z))]
        fits = [reduce(add, (float(first[i, j]) * zc[i] for i in range(len(z)))) for j in range(len(x))] + [F.lit(1.0)]
        if vce == "hac" and order:
            meat = newey_west(rows, [u * c for c in fits], n, lags, order)
        elif vce in ("robust", "hc0", "hc1", "hc2", "hc3"):
            h = F.least(reduce(add, (float(bread[i, j]) * fits[i] * fits[j] for i in range(k) for j in range(k))), F.lit(MAX_LEVERAGE))
            by = {"robust": u * u, "hc1": u * u, "hc0": u * u, "hc2": u * u / (1 - h), "hc3": u * u / ((1 - h) * (1 - h))}
            meat = cross_sums(rows, fits, by[vce])[1] * (n / (n - k) if vce in ("robust", "hc1") else 1.0)
        else:
            raise StatError("invalid_request", f"'{vce}' isn't available here.", "Two-stage least squares has classical, robust, hc2, hc3 and hac errors.", "Choose one of them.")
        v = bread @ meat @ bread
    figures = {"rmse": math.sqrt(rss / n), "df": n - zk}
    for name in endogenous:
        whole = float(m.block([name], [name])[0, 0] - m.block([name], z)[0] @ np.linalg.solve(szz, m.block(z, [name])[:, 0]))
        part = float(m.block([name], [name])[0, 0] - (m.block([name], exogenous)[0] @ np.linalg.solve(m.block(exogenous, exogenous), m.block(exogenous, [name])[:, 0]) if exogenous else 0.0))
        figures[f"first_stage_f_{name}"] = (part - whole) / len(instruments) / (whole / (n - zk)) if whole > 0 else math.inf
        figures[f"partial_r2_{name}"] = 1 - whole / part if part > 0 else math.nan
    return Fit("iv", y, [*x, CONSTANT], back @ np.append(slopes, mean_y), back @ v @ back.T, n - zk, n, figures)
