"""Difference-in-differences over a (unit, time) panel.

The two-way fixed-effects estimator is computed by double demeaning: unit means,
time means and the grand mean are three ``groupBy`` aggregates of the panel
(which is units x periods rows, small), joined back.  On a balanced panel one
pass is exact; on any other the demeaning is repeated (alternating projections)
until the means vanish, with the lineage cut into the shared folder, and an error
if they do not.  Covariates enter by Frisch-Waugh-Lovell: their demeaned
cross-products form a k x k Gram matrix (k = number of covariates, bounded by the
specification, not the data).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.student import critical_value
from ..session import cut_lineage

#: a regressor is absorbed if the effects leave less than this share of its variation
ABSORBED = 1e-10


def _demean_once(df: DataFrame, unit: str, time: str, cols: Sequence[str]) -> DataFrame:
    um = df.groupBy(unit).agg(*[F.avg(c).alias(f"_u_{c}") for c in cols])
    tm = df.groupBy(time).agg(*[F.avg(c).alias(f"_t_{c}") for c in cols])
    gm = df.agg(*[F.avg(c).alias(f"_g_{c}") for c in cols]).first()     # one row of scalars
    j = df.join(um, unit).join(tm, time).withColumns(
        {f"_g_{c}": F.lit(float(gm[f"_g_{c}"])) for c in cols})
    return j.select(*[c for c in df.columns if c not in cols],
                    *[(F.col(c) - F.col(f"_u_{c}") - F.col(f"_t_{c}") + F.col(f"_g_{c}")).alias(c)
                      for c in cols])


def two_way_demean(df: DataFrame, unit: str, time: str, cols: Sequence[str],
                   max_iter: int = 600, tol: float = 1e-11, every: int = 4) -> DataFrame:
    """Residualise ``cols`` on unit and time fixed effects.

    ``tol`` is the largest unit mean left, relative to the column's spread.  Raises if
    ``max_iter`` rounds do not reach it.
    """
    base = df.select(unit, time, *[F.col(c).cast("double").alias(c) for c in cols])
    r = base.agg(F.count(F.lit(1)).alias("n"), F.countDistinct(unit).alias("u"),
                 F.countDistinct(time).alias("t"), F.countDistinct(unit, time).alias("cells"),
                 *[F.stddev_pop(c).alias(f"sd_{c}") for c in cols]).first()
    if r["n"] == 0:
        return base
    if r["n"] == r["cells"] == r["u"] * r["t"]:
        return _demean_once(base, unit, time, cols)
    scale = {c: r[f"sd_{c}"] or 1.0 for c in cols}
    cur, left = base, math.inf
    for it in range(1, max_iter + 1):
        for key in (unit, time):
            means = cur.groupBy(key).agg(*[F.avg(c).alias(f"_m_{c}") for c in cols])
            cur = cur.join(means, key).select(unit, time, *[(F.col(c) - F.col(f"_m_{c}")).alias(c) for c in cols])
        if it % every == 0:
            cur = cut_lineage(cur)
            worst = cur.groupBy(unit).agg(*[(F.abs(F.avg(c)) / scale[c]).alias(c) for c in cols]).agg(
                *[F.max(c).alias(c) for c in cols]).first()
            left = max(worst[c] or 0.0 for c in cols)
            if left < tol:
                return cur
    raise ValueError(f"demeaning did not converge in {max_iter} rounds (largest unit mean left: {left:.2e})")


def gram_of(dm: DataFrame, xs: Sequence[str], y: str) -> tuple[np.ndarray, np.ndarray]:
    """Cross-products of demeaned regressors and with the outcome: one aggregate."""
    k = len(xs)
    names = [(i, j) for i in range(k) for j in range(i, k)]
    g = dm.agg(*[F.sum(F.col(xs[i]) * F.col(xs[j])).alias(f"g_{i}_{j}") for i, j in names],
               *[F.sum(F.col(x) * F.col(y)).alias(f"y_{i}") for i, x in enumerate(xs)]).first()
    xtx = np.zeros((k, k))
    for i, j in names:
        xtx[i, j] = xtx[j, i] = g[f"g_{i}_{j}"] or 0.0
    return xtx, np.array([g[f"y_{i}"] or 0.0 for i in range(k)])


def absorbed(data: DataFrame, xs: Sequence[str], xtx: np.ndarray) -> list[int]:
    """Regressors to keep: those with variation left after demeaning, relative to their own
    variation before it (so the unit of measure does not matter), and not a combination of
    the ones before."""
    raw = data.agg(*[(F.var_pop(F.col(x).cast("double")) * F.count(x)).alias(f"v_{i}") for i, x in enumerate(xs)]).first()
    keep: list[int] = []
    for i in range(len(xs)):
        own = raw[f"v_{i}"] or 0.0
        if own <= 0 or xtx[i, i] <= ABSORBED * own:
            continue
        if keep:
            d = np.sqrt(np.diag(xtx)[[*keep, i]])
            c = xtx[np.ix_([*keep, i], [*keep, i])] / np.outer(d, d)
            left = 1.0 - c[-1, :-1] @ np.linalg.solve(c[:-1, :-1], c[:-1, -1])
            if left <= ABSORBED:
                continue
        keep.append(i)
    return keep


def varying_covariates(panel: DataFrame, time: str, covariates: Sequence[str]) -> list[str]:
    """Covariates that vary within some period; the others (month or quarter
    dummies, any time-only series) are absorbed by the time effects.  One aggregate."""
    if not covariates:
        return []
    spread = panel.groupBy(time).agg(*[(F.max(c) - F.min(c)).alias(c) for c in covariates]).agg(
        *[F.max(F.abs(c)).alias(c) for c in covariates]).first()
    return [c for c in covariates if (spread[c] or 0) > 0]


def twfe_did(panel: DataFrame, unit: str, time: str, outcome: str, treat: str,
             covariates: Sequence[str] = (), cluster: str | None = None,
             ssc: bool = True, label: str = "twfe") -> DataFrame:
    """ATT of ``y ~ D + unit FE + time FE (+ covariates)``.

    Standard error clustered by ``cluster`` (default: the unit), with the
    ``G/(G-1)`` small-sample factor when ``ssc``; the interval uses Student's t with G - 1
    degrees of freedom (none with a single cluster).  Time-only covariates (month or
    quarter dummies) are absorbed by the time effects and drop out.
    """
    cluster = cluster or unit
    panel = cut_lineage(panel.select(*dict.fromkeys([unit, time, cluster, outcome, treat, *covariates])))  # small; facts are read once
    covariates = varying_covariates(panel, time, covariates)
    cols = [outcome, treat, *covariates]
    dm = cut_lineage(two_way_demean(panel.select(unit, time, *cols), unit, time, cols))
    xs = [treat, *covariates]
    xtx, xty = gram_of(dm, xs, outcome)
    keep = absorbed(panel, xs, xtx)
    if 0 not in keep:
        raise ValueError("treatment has no variation after removing unit and time effects")
    sub = np.ix_(keep, keep)
    scale = 1 / np.sqrt(np.diag(xtx)[keep])
    inv = np.linalg.inv(xtx[sub] * np.outer(scale, scale)) * np.outer(scale, scale)
    beta = dict(zip([xs[i] for i in keep], inv @ xty[keep]))
    resid = F.col(outcome)
    for name, b in beta.items():
        resid = resid - F.lit(float(b)) * F.col(name)
    # Cluster score for the treatment coefficient: row of (X'X)^-1 applied to X'e per cluster.
    inv_row = inv[keep.index(0)]
    score = None
    for coef, i in zip(inv_row, keep):
        term = F.lit(float(coef)) * F.col(xs[i])
        score = term if score is None else score + term
    sc = dm.withColumn("_s", score * resid)
    if cluster != unit:
        sc = sc.join(panel.select(unit, time, cluster), [unit, time])
    per_cluster = sc.groupBy(cluster).agg(F.sum("_s").alias("_g"))
    agg = per_cluster.agg(F.sum(F.col("_g") * F.col("_g")).alias("v"),
                          F.count(F.lit(1)).alias("G")).first()
    G = agg["G"]
    factor = G / (G - 1) if (ssc and G > 1) else 1.0
    att = float(beta[treat])
    se = math.sqrt(factor * agg["v"]) if agg["v"] is not None else float("nan")
    counts = panel.agg(F.count(F.lit(1)).alias("n_obs"), F.countDistinct(unit).alias("n_units"),
                       F.countDistinct(time).alias("n_periods")).first()
    margin = critical_value(0.95, G - 1) * se if G > 1 else None
    row = (label, att, se, att / se if se > 0 else None, att - margin if G > 1 else None, att + margin if G > 1 else None,
           math.expm1(att) * 100.0, int(counts["n_obs"]), int(counts["n_units"]),
           int(counts["n_periods"]), int(G))
    return panel.sparkSession.createDataFrame(
        [row], "spec string, att double, se double, t_stat double, ci_lower double, "
               "ci_upper double, pct_effect double, n_obs long, n_units long, n_periods long, "
               "n_clusters long")


def cluster_scores(panel: DataFrame, unit: str, time: str, outcome: str, treat: str) -> DataFrame:
    """C5 without covariates: per-unit score ``sum_t D~ e / sum D~^2``."""
    panel = cut_lineage(panel.select(unit, time, outcome, treat))
    dm = cut_lineage(two_way_demean(panel, unit, time, [outcome, treat]))
    b = dm.agg(F.try_divide(F.sum(F.col(treat) * F.col(outcome)), F.sum(F.col(treat) * F.col(treat))).alias("_b"),
               F.sum(F.col(treat) * F.col(treat)).alias("_sxx")).first()     # one row
    if not b["_sxx"]:
        raise ValueError("treatment has no variation after removing unit and time effects")
    j = dm.withColumns({"_b": F.lit(float(b["_b"])), "_sxx": F.lit(float(b["_sxx"]))})
    return j.groupBy(unit).agg(F.sum(F.col(treat) / F.col("_sxx")
                                     * (F.col(outcome) - F.col("_b") * F.col(treat))).alias("score"))


def did_2x2(df: DataFrame, treated: str, post: str, outcome: str) -> DataFrame:
    """Saturated 2x2 OLS ``y ~ T + P + T:P``: effect, homoskedastic SE, t.

    One aggregate over the rows gives the four cell counts, means and sums of
    squared deviations; nothing else is needed.
    """
    y = F.col(outcome).cast("double")
    cells = df.groupBy(F.col(treated).cast("int").alias("_T"), F.col(post).cast("int").alias("_P")).agg(
        F.count(y).alias("n"), F.avg(y).alias("m"), F.var_pop(y).alias("v"))
    w = cells.agg(
        *[F.max(F.when((F.col("_T") == t) & (F.col("_P") == p), F.col(c))).alias(f"{c}{t}{p}")
          for t in (0, 1) for p in (0, 1) for c in ("n", "m", "v")])
    rss = sum(F.col(f"n{t}{p}") * F.col(f"v{t}{p}") for t in (0, 1) for p in (0, 1))
    n = sum(F.col(f"n{t}{p}") for t in (0, 1) for p in (0, 1))
    inv = sum(F.try_divide(F.lit(1.0), F.col(f"n{t}{p}")) for t in (0, 1) for p in (0, 1))
    effect = (F.col("m11") - F.col("m10")) - (F.col("m01") - F.col("m00"))
    se = F.sqrt(F.try_divide(rss, n - F.lit(4)) * inv)
    return w.select(effect.alias("effect"), se.alias("se"), F.try_divide(effect, se).alias("t_stat"),
                    n.cast("long").alias("n_obs"))
