"""Synthetic DiD, synthetic control, replicate standard errors and event studies
(C7-C21) as Spark aggregations.

The weight problems are solved by Frank-Wolfe without a matrix of products between units or
between periods.  A step needs the candidate with the least gradient and three sums along
the way to it.  Panels of at most ``LOCAL_CELLS`` cells (a checked size) take all their steps in
one task.  Beyond that each step is one pass over the units' paths: unit weights are the
uniform start, scaled, plus a few candidates, so the state is one path and a short list for
each assignment; time weights are one number per period.  All assignments step together.

Everything after the weights is a join of weights with the panel and an aggregate:
gaps, effects, ATT, event study, bands and paths.  Weights that do not converge are an error.

An *assignment* says which units are treated and how often a unit counts: 0 is the
estimate; replicates are placebo (treated drawn from the controls) or bootstrap (units
drawn with replacement).  Draws are md5 hashes of (seed, replicate, unit), so SQL can make
the same; equal assignments are solved once and shared by their replicates.  ``experiment``
is a key: many panels are estimated in one pass.  Treatment must start in one period for
all treated units of an experiment (checked).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.weights import Fit, first_least, fw_paths, fw_step, pg_paths
from ..session import cut_lineage

Z95 = 1.959963984540054
TWO52 = float(2 ** 52)
# Week bands of the published event-study table.
EVENT_BANDS = ((1, 4), (5, 12), (13, 24), (25, 36), (37, 48), (49, 60), (61, 65))
KEY = ["experiment", "aid"]
#: a covariate with less residual than this share of the outcome's has no say
ABSORBED_SHARE = 1e-9
WEIGHTS = "experiment string, aid string, kind string, unit string, t int, value double"


@dataclass(frozen=True)
class SdidRuns:
    """``weights`` (experiment, aid, kind, unit, t, value), ``effects`` (experiment, aid, t,
    rel_time, period, effect, treated, synthetic, control), ``reps`` (experiment, rep, aid)."""

    weights: DataFrame
    effects: DataFrame
    reps: DataFrame


def uniform(seed: int, *parts):
    """U(0, 1) from the first 52 bits of an md5 (the same in SQL)."""
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]))
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("double") / F.lit(TWO52)


def check_panel(base: DataFrame) -> None:
    """Balanced, one treatment start per experiment, both arms present: else an error."""
    per = (base.groupBy("experiment").agg(
        F.count("*").alias("n"), F.countDistinct("unit").alias("u"), F.countDistinct("time").alias("t"),
        F.countDistinct("unit", "time").alias("cells"), F.min(F.when(F.col("d") > 0, F.col("time"))).alias("start"),
        F.sum("y").isNull().alias("empty")))
    starts = (base.where("d > 0").groupBy("experiment", "unit").agg(F.min("time").alias("s"), F.count("*").alias("c"))
              .groupBy("experiment").agg(F.countDistinct("s").alias("starts"), F.countDistinct("c").alias("lengths"),
                                         F.count("*").alias("treated")))
    bad = (per.join(starts, "experiment", "left").withColumn("why", F.expr(
        "CASE WHEN start IS NULL THEN 'has no treated cell' WHEN n <> cells OR n <> u * t THEN 'is not balanced' "
        "WHEN starts > 1 OR lengths > 1 THEN 'has treated units that start or end at different times' "
        "WHEN treated = u THEN 'has no control unit' END")).where("why IS NOT NULL").orderBy("experiment").limit(3).collect())
    if bad:
        raise ValueError("; ".join(f"panel {r['experiment']!r} {r['why']}" for r in bad))


def _indexed(base: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Adds ``t`` (period number from 0), ``t0`` (number of pre-periods) and ``treated``.
    Periods are ranked within their experiment on the distinct (experiment, period) table."""
    w = Window.partitionBy("experiment").orderBy("time")
    times = base.select("experiment", "time").distinct().withColumn("t", F.row_number().over(w) - 1)
    start = base.where("d > 0").groupBy("experiment").agg(F.min("time").alias("time")).join(times, ["experiment", "time"])
    arms = base.groupBy("experiment", "unit").agg(F.max(F.when(F.col("d") > 0, 1).otherwise(0)).alias("treated"))
    return (base.join(times, ["experiment", "time"]).join(start.select("experiment", F.col("t").alias("t0")), "experiment")
            .join(arms, ["experiment", "unit"]).select("experiment", "unit", "time", "t", "t0", "treated", "y", *extra))


def assignments(units: DataFrame, vce: str, reps: int, seed: int) -> DataFrame:
    """``(experiment, rep, unit, copies, treated)`` from units ``(experiment, unit, treated)``."""
    out = units.select("experiment", F.lit(0).alias("rep"), "unit", F.lit(1).alias("copies"), "treated")
    if vce == "none" or reps == 0:
        return out
    rep = F.explode(F.sequence(F.lit(1), F.lit(reps)))
    if vce == "placebo":
        arms = units.groupBy("experiment").agg(F.sum("treated").alias("n1"), F.count("*").alias("n"))
        short = arms.where("n - n1 <= n1").limit(1).collect()
        if short:
            raise ValueError(f"placebo needs more controls than treated units (panel {short[0]['experiment']!r}): use bootstrap")
        order = Window.partitionBy("experiment", "rep").orderBy("u", "unit")
        drawn = (units.where("treated = 0").withColumn("rep", rep).withColumn("u", uniform(seed, F.col("rep"), F.col("unit")))
                 .join(arms, "experiment").withColumn("r", F.row_number().over(order)))
        return out.unionByName(drawn.select("experiment", "rep", "unit", F.lit(1).alias("copies"),
                                            F.when(F.col("r") <= F.col("n1"), 1).otherwise(0).alias("treated")))
    if vce != "bootstrap":
        raise ValueError("vce must be 'placebo', 'bootstrap' or 'none'")
    # n draws with replacement; of several tries the first that holds both arms
    order = Window.partitionBy("experiment").orderBy("unit")
    numbered = units.withColumn("i", F.row_number().over(order) - 1)
    n = units.groupBy("experiment").agg(F.count("*").alias("n"))
    tries = F.explode(F.sequence(F.lit(0), F.lit(BOOTSTRAP_TRIES - 1)))
    draws = (n.withColumn("rep", rep).withColumn("try", tries)
             .withColumn("j", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
             .withColumn("i", F.floor(uniform(seed, F.col("rep"), F.col("try"), F.col("j")) * F.col("n")).cast("int"))
             .groupBy("experiment", "rep", "try", "i").agg(F.count("*").cast("int").alias("copies"))
             .join(numbered, ["experiment", "i"]))
    first = (draws.groupBy("experiment", "rep", "try").agg(F.min("treated").alias("a"), F.max("treated").alias("b"))
             .where("a <> b").groupBy("experiment", "rep").agg(F.min("try").alias("try")))
    lost = n.count() * reps - first.count()
    if lost:
        raise ValueError(f"{lost} bootstrap replicates never drew both arms in {BOOTSTRAP_TRIES} tries")
    return out.unionByName(draws.join(first, ["experiment", "rep", "try"]).select("experiment", "rep", "unit", "copies", "treated"))


#: tries of a bootstrap replicate to draw both arms; more are an error, not a silent loss
BOOTSTRAP_TRIES = 64


#: weights whose objective is certainly this close to the best (in squares of the noise) will do after the last step
GOOD_GAP = 0.02
#: cells of a panel, and rows of its assignments, up to which one task takes all steps
LOCAL_CELLS = 1_000_000
#: passes over a larger panel; what has not converged by then must have a good gap
SPREAD_STEPS = 300


def _noise(e1: float, e2: float, m: float) -> float:
    """Standard deviation of first differences from their sum, sum of squares and number."""
    return float(np.sqrt(max(0.0, e2 - e1 * e1 / m) / (m - 1))) if m > 1 else 0.0


def _rows_of(names, omega, zeta, fit: Fit, lam: Fit | None):
    rows = [("omega", u, None, w) for u, w in zip(names, omega)]
    rows += [("zeta", None, None, zeta), ("omega_converged", None, None, float(fit.converged)), ("omega_iterations", None, None, float(fit.iterations))]
    if lam is not None:
        rows += [("lambda", None, t, w) for t, w in enumerate(lam.weights)]
        rows += [("lambda_converged", None, None, float(lam.converged)), ("lambda_iterations", None, None, float(lam.iterations))]
    return rows


def _solve_here(method: str, max_iter: int, tol: float | None, calm: int):
    """A panel's cells and assignments -> weights, ridge and convergence of each assignment."""
    def run(cells: pd.DataFrame, assigned: pd.DataFrame) -> pd.DataFrame:
        if not len(cells) or not len(assigned):
            return pd.DataFrame(columns=["experiment", "aid", "kind", "unit", "t", "value"]).astype({"t": "Int32"})
        exp, t0 = cells["experiment"].iloc[0], int(cells["t0"].iloc[0])
        wide = cells.pivot(index="unit", columns="t", values="y").sort_index()
        Y = wide.to_numpy(dtype=float)
        place = {u: i for i, u in enumerate(wide.index)}
        after = Y[:, t0:].mean(axis=1)
        out = []
        for aid, a in assigned.groupby("aid", sort=True):
            a = a.sort_values("unit")
            at, copies, treated = a["unit"].map(place).to_numpy(), a["copies"].to_numpy(dtype=int), a["treated"].to_numpy() == 1
            b = np.average(Y[at[treated], :t0], axis=0, weights=copies[treated])
            co, n = at[~treated], copies[~treated]
            e = np.diff(Y[co, :t0], axis=1)
            noise = _noise(float(n @ e.sum(axis=1)), float(n @ (e * e).sum(axis=1)), float(n.sum() * e.shape[1]))
            zeta = (copies[treated].sum() * (Y.shape[1] - t0)) ** 0.25 * noise
            least = tol if tol is not None else 1e-5 * max(noise, 1e-12)
            each = np.repeat(np.arange(len(co)), n)
            if method == "sc":
                fit, zeta = pg_paths(Y[co, :t0][each], b, t0, max(max_iter, 20_000)), 0.0
            else:
                A = Y[co, :t0] - Y[co, :t0].mean(axis=1, keepdims=True)
                fit = fw_paths(A[each], b - b.mean(), t0, zeta ** 2, max_iter, least, calm, GOOD_GAP * noise ** 2)
            lam = None
            if method == "sdid":
                share = n / n.sum()
                P, p = Y[co, :t0] - share @ Y[co, :t0], after[co] - share @ after[co]
                root = np.sqrt(share)
                lam = fw_paths((P * root[:, None]).T, p * root, 1.0, (1e-6 * noise) ** 2, max_iter, least, calm, GOOD_GAP * noise ** 2)
            out += [(exp, aid, *r) for r in _rows_of(wide.index[co], np.bincount(each, fit.weights, len(co)), zeta, fit, lam)]
        return pd.DataFrame(out, columns=["experiment", "aid", "kind", "unit", "t", "value"]).astype({"t": "Int32"})
    return run


class _UnitSteps:
    """Frank-Wolfe over units for one assignment; the weights are ``scale`` times uniform plus ``extra``.
    ``sc``: the best weights of all vertices so far after each step (fully corrective)."""

    def __init__(self, n0, target, mean, ridge, least, calm, sc):
        self.n0, self.b, self.ridge, self.least, self.calm, self.sc = n0, target, ridge, least, calm, sc
        self.scale, self.extra, self.x, self.still, self.iterations = 1.0, {}, mean, 0, 0
        self.square, self.done, self.converged, self.paths, self.gap = 1.0 / n0, n0 == 1, n0 == 1, {}, np.inf

    def step(self, g: float, vertex: tuple, path: np.ndarray) -> None:
        self.iterations += 1
        n = len(self.b)
        if self.sc:
            gap = float(self.x @ (self.x - self.b)) / n - g
            if vertex in self.paths or (self.paths and gap <= 1e-12 * (1.0 + float(self.b @ self.b) / n)):  # no better one
                self.done = self.converged = True
                return
            self.paths[vertex], self.scale = path, 0.0
            fit = pg_paths(np.array(list(self.paths.values())), self.b, n)
            self.extra = dict(zip(self.paths, fit.weights))
            self.x = fit.weights @ np.array(list(self.paths.values()))
            return
        own = self.scale / self.n0 + self.extra.get(vertex, 0.0)
        slope = float(self.x @ (self.x - self.b)) / n + self.ridge * self.square - g
        curve = float((path - self.x) @ (path - self.x)) / n + self.ridge * (1 - 2 * own + self.square)
        step, fell = fw_step(slope, curve)
        self.gap = slope
        self.square = (1 - step) ** 2 * self.square + 2 * step * (1 - step) * own + step ** 2
        self.scale *= 1 - step
        self.extra = {k: v * (1 - step) for k, v in self.extra.items()}
        self.extra[vertex] = self.extra.get(vertex, 0.0) + step
        self.x = self.x + step * (path - self.x)
        self.still = self.still + 1 if fell < self.least ** 2 else 0
        self.done = self.converged = self.still >= self.calm


class _TimeSteps:
    """Frank-Wolfe over pre-periods for one assignment, from sums over its controls."""

    def __init__(self, periods, ridge, least, calm):
        self.w, self.ridge, self.least, self.calm = np.full(periods, 1.0 / periods), ridge, least, calm
        self.still, self.iterations, self.gap = 0, 0, np.inf
        self.done = self.converged = periods == 1

    def step(self, n, y, yy, yp, p, uy, u, f, ff) -> None:
        """Means over the controls: y, y^2, y * post, post; with u = y'w - post and f = y'w also u * y, u, f, f^2."""
        self.iterations += 1
        g = (uy - y * u) + self.ridge * self.w
        i = first_least(g)
        d = -self.w
        d[i] += 1.0
        with_fit = (uy[i] - y[i] * u) + (yp[i] - y[i] * p)  # covariance of y_i and the fit
        curve = (yy[i] - y[i] ** 2) + (ff - f ** 2) - 2 * with_fit + self.ridge * float(d @ d)
        self.gap = -float(g @ d)
        step, fell = fw_step(self.gap, curve)
        self.w = self.w + step * d
        self.still = self.still + 1 if fell < self.least ** 2 else 0
        self.done = self.converged = self.still >= self.calm


def _solve_spread(cells: DataFrame, assigned: DataFrame, method: str, max_iter: int, tol: float | None, calm: int) -> DataFrame:
    """The same weights for panels of any number of units: each step is one pass over the units'
    paths, all assignments together.  The driver holds a path and a short list for each."""
    spark = cells.sparkSession
    sc = method == "sc"
    paths = cells.groupBy("experiment", "unit").agg(
        F.transform(F.sort_array(F.collect_list(F.when(F.col("t") < F.col("t0"), F.struct("t", "y")))), lambda x: x.y).alias("y"),
        F.avg(F.when(F.col("t") >= F.col("t0"), F.col("y"))).alias("post"), F.count(F.when(F.col("t") >= F.col("t0"), 1)).alias("T1"))
    # a path has as many values as the panel has pre-periods; the unit's own level is taken out unless weights match levels
    paths = paths.withColumn("level", F.aggregate("y", F.lit(0.0), lambda s, x: s + x) / F.size("y"))
    paths = paths.withColumn("a", F.col("y") if sc else F.transform("y", lambda x: x - F.col("level")))
    rows = cut_lineage(paths.join(assigned, ["experiment", "unit"]))

    def vectors(df, value):
        """Sums over rows, by assignment, of an array and of its length-less companions."""
        return (df.select(*KEY, F.posexplode(value)).groupBy(*KEY, "pos").agg(F.sum("col").alias("s"))
                .groupBy(*KEY).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "s"))), lambda x: x.s).alias("v")))

    def read(df):
        return {(r["experiment"], r["aid"]): np.array(r["v"], float) for r in df.collect()}

    copies, treated = F.col("copies").cast("double"), F.col("treated") == 1
    b = read(vectors(rows.where(treated), F.transform("a", lambda x: x * copies)))
    mean = read(vectors(rows.where(~treated), F.transform("a", lambda x: x * copies)))
    step_ = F.zip_with(F.slice("y", F.lit(2), F.greatest(F.size("y") - 1, F.lit(0))), F.slice("y", F.lit(1), F.greatest(F.size("y") - 1, F.lit(0))), lambda x, z: x - z)
    sums = {}
    for r in rows.groupBy(*KEY).agg(F.sum(F.when(treated, copies)).alias("n1"), F.sum(F.when(~treated, copies)).alias("n0"), F.max("T1").alias("T1"),
                                    *[F.sum(F.when(~treated, copies * v)).alias(k) for k, v in (
                                        ("e1", F.aggregate(step_, F.lit(0.0), lambda s, x: s + x)), ("e2", F.aggregate(step_, F.lit(0.0), lambda s, x: s + x * x)),
                                        ("m", F.size(step_).cast("double")))]).collect():
        sums[r["experiment"], r["aid"]] = r
    units, times, out, noise = {}, {}, [], {}
    for k, r in sums.items():
        noise[k] = _noise(r["e1"], r["e2"], r["m"])
        zeta = 0.0 if sc else (r["n1"] * r["T1"]) ** 0.25 * noise[k]
        least = tol if tol is not None else 1e-5 * max(noise[k], 1e-12)
        units[k] = _UnitSteps(r["n0"], b[k] / r["n1"], mean[k] / r["n0"], zeta ** 2, least, calm, sc)
        if method == "sdid":
            times[k] = _TimeSteps(len(b[k]), (1e-6 * noise[k]) ** 2, least, calm)

    control = rows.where(~treated)

    def table(states, cells_of, kind):
        return spark.createDataFrame([(*k, *cells_of(s)) for k, s in states.items() if not s.done], f"experiment string, aid string, {kind}")

    dot = lambda x, z: F.aggregate(F.zip_with(x, z, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    for _ in range(min(max_iter, SPREAD_STEPS)):
        if all(s.done for s in units.values()):
            break
        now = table(units, lambda s: ([float(v) for v in (s.x - s.b) / len(s.b)], float(s.ridge), float(s.scale / s.n0),
                                      {f"{u}|{c}": float(v) for (u, c), v in s.extra.items()}), "r array<double>, ridge double, base double, extra map<string,double>")
        # copies of a unit are candidates of their own; the one with the least weight has the least gradient
        one = (control.join(F.broadcast(now), KEY)  # one row for each assignment
               .withColumn("c", F.explode(F.sequence(F.lit(1), F.col("copies"))))
               .withColumn("g", dot(F.col("a"), F.col("r")) + F.col("ridge") * (F.col("base") + F.coalesce(F.try_element_at("extra", F.concat_ws("|", "unit", F.col("c").cast("string"))), F.lit(0.0)))))
        for r in one.groupBy(*KEY).agg(F.min(F.struct("g", "unit", "c", "a")).alias("x")).collect():
            units[r["experiment"], r["aid"]].step(r["x"]["g"], (r["x"]["unit"], r["x"]["c"]), np.array(r["x"]["a"], float))
    if times:
        weigh = lambda v: F.transform(v, lambda x: x * copies)
        once = {n: read(vectors(control, F.transform("y", f))) for n, f in (
            ("y", lambda x: x * copies), ("yy", lambda x: x * x * copies), ("yp", lambda x: x * F.col("post") * copies))}
        p = {(r["experiment"], r["aid"]): r["p"] for r in control.groupBy(*KEY).agg(F.sum(copies * F.col("post")).alias("p")).collect()}
        for _ in range(min(max_iter, SPREAD_STEPS)):
            if all(s.done for s in times.values()):
                break
            now = table(times, lambda s: ([float(v) for v in s.w],), "w array<double>")
            own = control.join(F.broadcast(now), KEY).withColumn("f", dot(F.col("y"), F.col("w"))).withColumn("u", F.col("f") - F.col("post"))
            # the sums of u * y, u, f and f * f as one array
            uy = read(vectors(own, weigh(F.concat(F.transform("y", lambda x: x * F.col("u")), F.array("u", "f", F.col("f") * F.col("f"))))))
            for k, v in uy.items():
                n = sums[k]["n0"]
                times[k].step(n, once["y"][k] / n, once["yy"][k] / n, once["yp"][k] / n, p[k] / n, v[:-3] / n, v[-3] / n, v[-2] / n, v[-1] / n)
    for states in (units, times):
        for k, s in states.items():
            s.converged = s.converged or s.gap <= GOOD_GAP * noise[k] ** 2
    single = []
    for k, s in units.items():
        single += [(*k, "zeta", None, None, 0.0 if sc else float(np.sqrt(s.ridge))), (*k, "omega_converged", None, None, float(s.converged)),
                   (*k, "omega_iterations", None, None, float(s.iterations))]
        if k in times:
            single += [(*k, "lambda", None, t, float(w)) for t, w in enumerate(times[k].w)]
            single += [(*k, "lambda_converged", None, None, float(times[k].converged)), (*k, "lambda_iterations", None, None, float(times[k].iterations))]
    extra = [(*k, u, float(v)) for k, s in units.items() for (u, c), v in s.extra.items()]
    base = spark.createDataFrame([(*k, float(s.scale / s.n0)) for k, s in units.items()], "experiment string, aid string, base double")
    extra = spark.createDataFrame(extra, "experiment string, aid string, unit string, extra double").groupBy(*KEY, "unit").agg(F.sum("extra").alias("extra"))
    omega = (control.select(*KEY, "unit", "copies").join(F.broadcast(base), KEY).join(extra, [*KEY, "unit"], "left")
             .select(*KEY, F.lit("omega").alias("kind"), "unit", F.lit(None).cast("int").alias("t"), (F.col("base") * F.col("copies") + F.coalesce("extra", F.lit(0.0))).alias("value")))
    return omega.unionByName(spark.createDataFrame(single, WEIGHTS))


def solve_weights(cells: DataFrame, assigned: DataFrame, method: str, max_iter: int = 10_000, tol: float | None = None, calm: int = 1) -> DataFrame:
    """Weights of every assignment, as one table; an error if some do not converge."""
    large = (cells.groupBy("experiment").agg(F.count("*").alias("n")).join(assigned.groupBy("experiment").agg(F.count("*").alias("m")), "experiment")
             .where((F.col("n") > LOCAL_CELLS) | (F.col("m") > LOCAL_CELLS)).select("experiment").collect())  # few: each is large
    large = [r["experiment"] for r in large]
    is_large = F.col("experiment").isin(large)
    here, there = (cells.where(~is_large), assigned.where(~is_large)) if large else (cells, assigned)
    # columns of their own: both tables may come from one
    there_ = there.select(*[F.col(c).alias(f"a_{c}") for c in there.columns]).toDF(*there.columns)
    weights = (here.select("experiment", "unit", "t", "t0", "y").groupBy("experiment").cogroup(there_.groupBy("experiment"))
               .applyInPandas(_solve_here(method, max_iter, tol, calm), WEIGHTS))
    if large:
        weights = weights.unionByName(_solve_spread(cells.where(is_large), assigned.where(is_large), method, max_iter, tol, calm))
    weights = cut_lineage(weights)
    lost = weights.where("kind IN ('omega_converged', 'lambda_converged') AND value = 0").limit(3).collect()
    if lost:
        raise ValueError("weights did not converge: " + ", ".join(f"{r['kind']} of panel {r['experiment']!r}" for r in lost))
    return weights


def sdid_runs(panel: DataFrame, unit: str, time: str, outcome: str, treat: str, method: str = "sdid",
              vce: str = "none", reps: int = 100, seed: int = 123, covariates: Sequence[str] = (),
              experiment: str | None = None, max_iter: int = 10_000, tol: float | None = None,
              num_iter_no_change: int = 1, covariate_form: str = "projected") -> SdidRuns:
    """Weights and per-period effects of the estimate (``rep`` 0) and its replicates.

    ``method``: ``sdid`` (unit and time weights, ridge), ``sc`` (unit weights, no intercept,
    no ridge, no time weights) or ``did`` (uniform weights).  ``covariates`` (C13) adjust the
    outcome first: ``projected`` residualises it on them within untreated cells,
    ``optimized`` finds coefficients jointly with the estimate's weights.  Replicates use the
    adjusted outcome and are made only if ``vce`` asks for them.
    """
    if covariate_form not in ("projected", "optimized"):
        raise ValueError("covariate_form must be 'projected' or 'optimized'")
    if method not in ("sdid", "sc", "did"):
        raise ValueError("method must be 'sdid', 'sc' or 'did'")
    base = panel.select((F.col(experiment).cast("string") if experiment else F.lit("all")).alias("experiment"),
                        F.col(unit).cast("string").alias("unit"), F.col(time).alias("time"),
                        F.col(outcome).cast("double").alias("y"), F.col(treat).cast("double").alias("d"),
                        *[F.col(c).cast("double").alias(c) for c in covariates])
    base = cut_lineage(base)  # the panel is small; the facts are read once
    check_panel(base)
    if covariates and covariate_form == "projected":
        base = project_covariates(base, covariates)
    solve = lambda c, a: solve_weights(c, a, method, max_iter, tol, num_iter_no_change)
    cells = cut_lineage(_indexed(base, covariates if covariate_form == "optimized" else ()))
    if covariates and covariate_form == "optimized":
        cells = optimise_covariates(cells, covariates, method, solve)
    units = cells.select("experiment", "unit", "treated").distinct()
    drawn = assignments(units, vce, reps, seed)
    # equal assignments share an id
    signature = F.md5(F.concat_ws(";", F.sort_array(F.collect_list(F.concat_ws(":", "unit", "copies", "treated")))))
    reps_ = cut_lineage(drawn.groupBy("experiment", "rep").agg(signature.alias("aid")))
    once = reps_.groupBy("experiment", "aid").agg(F.min("rep").alias("rep"))
    assigned = cut_lineage(drawn.join(once, ["experiment", "rep"]).select("experiment", "aid", "unit", "copies", "treated"))
    if method == "did":
        n0 = Window.partitionBy(*KEY)
        omega = assigned.where("treated = 0").select(*KEY, F.lit("omega").alias("kind"), "unit", F.lit(None).cast("int").alias("t"),
                                                     (F.col("copies") / F.sum("copies").over(n0)).cast("double").alias("value"))
        pre = cells.where("t < t0").select("experiment", "t", "t0").distinct()
        lam = once.join(pre, "experiment").select(*KEY, F.lit("lambda").alias("kind"), F.lit(None).cast("string").alias("unit"),
                                                  F.col("t").cast("int").alias("t"), (F.lit(1.0) / F.col("t0")).alias("value"))
        weights = cut_lineage(omega.unionByName(lam))
    else:
        weights = solve(cells, assigned)
    return SdidRuns(weights, cut_lineage(_effects(cells, assigned, weights, method)), reps_)


def _effects(cells: DataFrame, assigned: DataFrame, weights: DataFrame, method: str) -> DataFrame:
    """Per-period gap of the treated mean to the synthetic control, less its weighted
    pre-period level: joins of weights with the panel and aggregates."""
    omega = weights.where("kind = 'omega'").select(*KEY, "unit", F.col("value").alias("omega"))
    coef = (assigned.join(omega, [*KEY, "unit"], "left").join(
        assigned.groupBy(*KEY).agg(F.sum(F.col("copies") * F.col("treated")).alias("n1"),
                                   F.sum(F.col("copies") * (1 - F.col("treated"))).alias("n0")), KEY)
        .select(*KEY, "unit", F.when(F.col("treated") == 1, F.col("copies") / F.col("n1")).otherwise(0.0).alias("w1"),
                F.coalesce("omega", F.lit(0.0)).alias("w0"),
                F.when(F.col("treated") == 0, F.col("copies") / F.col("n0")).otherwise(0.0).alias("wc")))
    paths = (cells.join(coef, ["experiment", "unit"]).groupBy(*KEY, "t", "t0", "time").agg(
        F.sum(F.col("w1") * F.col("y")).alias("treated"), F.sum(F.col("w0") * F.col("y")).alias("synthetic"),
        F.sum(F.col("wc") * F.col("y")).alias("control")))
    paths = paths.withColumn("gap", F.col("treated") - F.col("synthetic"))
    if method == "sc":
        paths = paths.withColumn("effect", F.col("gap"))
    else:
        lam = weights.where("kind = 'lambda'").select(*KEY, "t", F.col("value").alias("lam"))
        level = paths.join(lam, [*KEY, "t"]).groupBy(*KEY).agg(F.sum(F.col("lam") * F.col("gap")).alias("level"))
        paths = paths.join(level, KEY).withColumn("effect", F.col("gap") - F.col("level"))
    return paths.select(*KEY, "t", (F.col("t") + 1 - F.col("t0")).cast("int").alias("rel_time"), F.col("time").cast("string").alias("period"),
                        "effect", "treated", "synthetic", "control")


def project_covariates(base: DataFrame, covariates: Sequence[str]) -> DataFrame:
    """Regress y on covariates + unit and time effects among untreated cells and subtract
    the covariate part (k x k Gram, k = number of covariates).  Covariates that the effects
    absorb (no variation left, relative to their own) drop out."""
    from .did import absorbed, gram_of, two_way_demean, varying_covariates
    covariates = varying_covariates(base, "time", covariates)
    if not covariates:
        return base
    cols = ["y", *covariates]
    # units and periods of different experiments have effects of their own
    untreated = base.where("d = 0").select(F.concat_ws("|", "experiment", "unit").alias("u"),
                                           F.concat_ws("|", "experiment", F.col("time").cast("string")).alias("p"), *cols)
    dm = two_way_demean(untreated, "u", "p", cols)
    xtx, xty = gram_of(dm, covariates, "y")
    keep = absorbed(untreated, covariates, xtx)
    if not keep:
        return base
    scale = 1 / np.sqrt(np.diag(xtx)[keep])
    beta = np.linalg.lstsq(xtx[np.ix_(keep, keep)] * np.outer(scale, scale), xty[keep] * scale, rcond=None)[0] * scale
    adj = F.col("y")
    for b, i in zip(beta, keep):
        adj = adj - F.lit(float(b)) * F.col(covariates[i])
    return base.withColumn("y", adj)


def optimise_covariates(cells: DataFrame, covariates: Sequence[str], method: str, solve, rounds: int = 40,
                        tol: float = 1e-7) -> DataFrame:
    """Adjust y by coefficients that minimise the weight problems' residuals jointly with the
    weights of the estimate, by alternation: given coefficients the weights are solved as
    usual; given weights the coefficients are a k x k least-squares problem per experiment
    whose products are Spark sums.  Raises if the coefficients do not settle."""
    if method == "did":
        raise ValueError("uniform weights leave nothing to optimise: use the projected form")
    names = ["y", *covariates]
    units = cells.select("experiment", "unit", "treated").distinct()
    assigned = cut_lineage(units.select("experiment", F.lit("estimate").alias("aid"), "unit", F.lit(1).alias("copies"), "treated"))
    long = cut_lineage(cells.select("experiment", "unit", "t", "t0", "treated", F.explode(F.array(*[
        F.struct(F.lit(c).alias("name"), F.col(c).alias("x")) for c in names])).alias("v")).select("experiment", "unit", "t", "t0", "treated", "v.*"))
    n1 = units.groupBy("experiment").agg(F.sum("treated").alias("n1"))
    beta, previous = None, None

    def adjusted(b):
        if b is None:
            return cells
        by = b.groupBy("experiment").pivot("name", list(covariates)).agg(F.first("beta")).withColumnsRenamed({c: f"_b_{c}" for c in covariates})
        out = cells.join(by, "experiment", "left")
        y = F.col("y")
        for c in covariates:
            y = y - F.coalesce(F.col(f"_b_{c}"), F.lit(0.0)) * F.col(c)
        return out.withColumn("y", y).select(cells.columns)

    def normal_equations(pdf: pd.DataFrame) -> pd.DataFrame:
        exp = pdf["experiment"].iloc[0]
        A = pdf.pivot(index="a", columns="b", values="v").reindex(index=names, columns=names).to_numpy(dtype=float)
        d = np.sqrt(np.maximum(np.diag(A)[1:], 0.0))
        ok = d > ABSORBED_SHARE * np.sqrt(max(A[0, 0], 1e-300))
        b = np.zeros(len(covariates))
        if ok.any():
            s = 1 / d[ok]
            b[ok] = np.linalg.lstsq(A[1:, 1:][np.ix_(ok, ok)] * np.outer(s, s), A[1:, 0][ok] * s, rcond=None)[0] * s
        return pd.DataFrame({"experiment": exp, "name": list(covariates), "beta": b})

    for _ in range(rounds):
        weights = solve(adjusted(beta), assigned)
        omega = weights.where("kind = 'omega'").select("experiment", "unit", F.col("value").alias("w"))
        # unit problem: treated mean less synthetic control, per pre-period, about its mean
        coef = units.join(omega, ["experiment", "unit"], "left").join(n1, "experiment").select(
            "experiment", "unit", F.when(F.col("treated") == 1, 1.0 / F.col("n1")).otherwise(-F.coalesce("w", F.lit(0.0))).alias("w"))
        over_t = (long.where("t < t0").join(coef, ["experiment", "unit"]).groupBy("experiment", "name", "t")
                  .agg(F.sum(F.col("w") * F.col("x")).alias("r")).select("experiment", "name", F.concat(F.lit("t"), "t").alias("i"), F.lit("t").alias("part"), "r"))
        parts = over_t
        if method == "sdid":
            lam = weights.where("kind = 'lambda'").select("experiment", "t", F.col("value").alias("w"))
            post = long.where("treated = 0 and t >= t0").groupBy("experiment", "unit", "name").agg(F.avg("x").alias("m"))
            pre = (long.where("treated = 0").join(lam, ["experiment", "t"]).groupBy("experiment", "unit", "name").agg(F.sum(F.col("w") * F.col("x")).alias("l")))
            parts = parts.unionByName(pre.join(post, ["experiment", "unit", "name"]).select(
                "experiment", "name", F.concat(F.lit("u"), "unit").alias("i"), F.lit("u").alias("part"), (F.col("l") - F.col("m")).alias("r")))
        about = Window.partitionBy("experiment", "name", "part")
        centre = F.avg("r").over(about) if method == "sdid" else F.lit(0.0)
        parts = cut_lineage(parts.withColumn("r", (F.col("r") - centre) / F.sqrt(F.count("*").over(about))))
        a = parts.select("experiment", "part", "i", F.col("name").alias("a"), F.col("r").alias("ra"))
        b = parts.select("experiment", "part", "i", F.col("name").alias("b"), F.col("r").alias("rb"))
        products = a.join(b, ["experiment", "part", "i"]).groupBy("experiment", "a", "b").agg(F.sum(F.col("ra") * F.col("rb")).alias("v"))
        previous, beta = beta, cut_lineage(products.groupBy("experiment").applyInPandas(normal_equations, "experiment string, name string, beta double"))
        if previous is not None:
            moved = beta.join(previous.withColumnRenamed("beta", "was"), ["experiment", "name"]).agg(
                F.max(F.abs(F.col("beta") - F.col("was")) / (1 + F.abs("beta")))).first()[0]
            if (moved or 0.0) < tol:
                return cut_lineage(adjusted(beta))
    raise ValueError(f"covariate coefficients did not settle in {rounds} rounds")


# ---- summaries ------------------------------------------------------------------------

def _by_rep(runs: SdidRuns) -> DataFrame:
    return runs.reps.join(runs.effects, KEY)


def _estimate(runs: SdidRuns) -> DataFrame:
    return runs.reps.where("rep = 0").select(*KEY).join(runs.effects, KEY)


def summarize_att(runs: SdidRuns, label: str, vce: str = "none") -> DataFrame:
    """ATT (mean post-period effect), SE = population sd of replicate ATTs, t, CI, percent."""
    att = _by_rep(runs).where("rel_time >= 1").groupBy("experiment", "rep").agg(F.avg("effect").alias("value"))
    agg = att.groupBy("experiment").agg(F.max(F.when(F.col("rep") == 0, F.col("value"))).alias("att"),
                                        F.stddev_pop(F.when(F.col("rep") > 0, F.col("value"))).alias("se"),
                                        F.count(F.when(F.col("rep") > 0, 1)).alias("n_reps"))
    return agg.select("experiment", F.lit(label).alias("spec"), F.lit(vce).alias("vce"), "att", "se",
                      F.try_divide("att", "se").alias("t_stat"),
                      (F.col("att") - F.lit(Z95) * F.col("se")).alias("ci_lower"), (F.col("att") + F.lit(Z95) * F.col("se")).alias("ci_upper"),
                      (F.expm1("att") * 100.0).alias("pct_effect"), F.col("n_reps").cast("long").alias("n_reps"))


def event_study(runs: SdidRuns) -> DataFrame:
    """Per relative period effect (leads <= 0, lags >= 1), replicate SE and CI."""
    each = _by_rep(runs)
    est = each.where("rep = 0").select("experiment", "rel_time", "period", F.col("effect").alias("estimate"))
    se = each.where("rep > 0").groupBy("experiment", "rel_time").agg(F.stddev_pop("effect").alias("se"))
    return est.join(se, ["experiment", "rel_time"], "left").withColumns({
        "ci_lower": F.col("estimate") - F.lit(Z95) * F.col("se"), "ci_upper": F.col("estimate") + F.lit(Z95) * F.col("se")})


def effect_bands(es: DataFrame, bands=EVENT_BANDS) -> DataFrame:
    """Plain mean of the post-period effects within week bands, and overall."""
    band = None
    for lo, hi in bands:
        cond = F.col("rel_time").between(lo, hi)
        band = F.when(cond, F.lit(f"{lo}-{hi}")) if band is None else band.when(cond, F.lit(f"{lo}-{hi}"))
    post = es.where("rel_time >= 1").withColumn("band", F.explode(F.array(F.lit("overall"), band))).where("band IS NOT NULL")
    return post.groupBy("experiment", "band").agg(F.avg("estimate").alias("estimate"), F.count(F.lit(1)).alias("n_periods"))


def _weights(runs: SdidRuns, kind: str) -> DataFrame:
    return runs.reps.where("rep = 0").select(*KEY).join(runs.weights.where(F.col("kind") == kind), KEY)


def unit_weights(runs: SdidRuns) -> DataFrame:
    """Control-unit weights of the estimate."""
    return _weights(runs, "omega").select("experiment", "unit", F.col("value").alias("omega"))


def time_weights(runs: SdidRuns) -> DataFrame:
    """Pre-period weights of the estimate."""
    periods = runs.effects.select(*KEY, "t", "period")
    return (_weights(runs, "lambda").select(*KEY, "t", F.col("value").alias("lambda")).join(periods, [*KEY, "t"])
            .select("experiment", "period", (F.col("t") + 1).cast("int").alias("period_index"), "lambda"))


def convergence(runs: SdidRuns) -> DataFrame:
    """Ridge, convergence and iterations of every assignment's solvers."""
    kinds = ["zeta", "omega_converged", "omega_iterations", "lambda_converged", "lambda_iterations"]
    return runs.weights.where(F.col("kind").isin(kinds)).groupBy(*KEY).pivot("kind", kinds).agg(F.first("value"))


def synthetic_path(runs: SdidRuns) -> DataFrame:
    """Treated mean, synthetic control and plain control mean per period."""
    return _estimate(runs).select("experiment", "period", "rel_time", "treated", "synthetic", "control")
