"""Properties of the estimators (SURVEY §5 (b)) on inline panels."""

import numpy as np
import pytest
from gram_weights import fw_gram
from pyspark.sql import functions as F

from forumshift.functions.weights import fw_paths, pg_paths
from forumshift.operators import sdid as SD


def _additive_panel(n_units=6, n_times=30, t0=20, effect=-0.5, seed=3):
    rng = np.random.default_rng(seed)
    a = rng.normal(size=n_units)
    b = rng.normal(size=n_times)
    Y = a[:, None] + b[None, :]
    treated = np.zeros(n_units, dtype=bool)
    treated[0] = True
    Y[0, t0:] += effect
    return Y, treated, t0


def _panel(spark, Y, tr, t0, experiment="all"):
    rows = [(experiment, f"u{i}", t, float(Y[i, t]), 1.0 if (tr[i] and t >= t0) else 0.0)
            for i in range(Y.shape[0]) for t in range(Y.shape[1])]
    return spark.createDataFrame(rows, "e string, unit string, t int, y double, d double")


def _simplex_optimum(Q, c, w):
    """First-order conditions over the simplex: no vertex has a smaller gradient."""
    g = 2 * (Q @ w - c)
    return g.min() >= g @ w - 1e-5


def test_solvers_reach_the_optimum_and_say_so():
    rng = np.random.default_rng(0)
    A = rng.normal(size=(40, 7))
    b = rng.normal(size=40)
    Q, c = A.T @ A / 40 + 0.1 * np.eye(7), A.T @ b / 40
    ridged = np.vstack([A, np.sqrt(4) * np.eye(7)])  # 0.1 * 40 = 4: the ridge as rows of their own
    for fit in (fw_gram(Q, c), fw_paths(A.T, b, 40, 0.1), pg_paths(ridged.T, np.append(b, np.zeros(7)), 40)):
        assert fit.converged and np.all(fit.weights >= -1e-12) and abs(fit.weights.sum() - 1) < 1e-9
        assert _simplex_optimum(Q, c, fit.weights)
    assert np.abs(fw_gram(Q, c).weights - fw_paths(A.T, b, 40, 0.1).weights).max() < 1e-6
    assert not fw_paths(A.T, b, 40, 0.1, max_iter=1, min_decrease=0.0).converged


@pytest.mark.parametrize("level", [4.0, 9.0, 50.0])
def test_synthetic_control_weights_converge_at_any_level(level):
    """Paths that differ little beside their common level, as log counts of many posts do."""
    rng = np.random.default_rng(3)
    paths = level + 0.1 * rng.normal(size=(5, 183)) + 0.1 * rng.normal(size=183)
    planted = pg_paths(paths[1:], (paths[1] + paths[4]) / 2, 183)
    assert planted.converged and np.abs(planted.weights - [0.5, 0, 0, 0.5]).max() < 1e-9
    free = pg_paths(paths[1:], paths[0], 183)
    assert free.converged and np.abs(free.weights - pg_paths(paths[1:] - level, paths[0] - level, 183).weights).max() < 1e-9


def test_additive_panels_recover_their_effects_in_one_pass(spark):
    panels, want = None, {}
    for k, effect in enumerate((-0.5, 0.25)):
        Y, tr, t0 = _additive_panel(effect=effect, seed=3 + k, n_units=6 + k)
        p = _panel(spark, Y, tr, t0, f"e{k}")
        panels = p if panels is None else panels.unionByName(p)
        want[f"e{k}"] = effect
    for method in ("sdid", "did"):
        runs = SD.sdid_runs(panels, "unit", "t", "y", "d", method=method, reps=10, vce="placebo", experiment="e")
        att = {r.experiment: r for r in SD.summarize_att(runs, method, "placebo").collect()}
        assert set(att) == set(want)
        assert all(abs(att[e].att - want[e]) < 1e-9 and att[e].n_reps == 10 for e in want)
        w = SD.unit_weights(runs).groupBy("experiment").agg(F.sum("omega").alias("s"), F.min("omega").alias("m")).collect()
        assert all(abs(r.s - 1) < 1e-9 and r.m >= 0 for r in w)
        lam = SD.time_weights(runs).groupBy("experiment").agg(F.sum("lambda").alias("s")).collect()
        assert all(abs(r.s - 1) < 1e-9 for r in lam)
        bands = {(r.experiment, r.band): r.estimate for r in SD.effect_bands(SD.event_study(runs)).collect()}
        assert all(abs(bands[e, "overall"] - want[e]) < 1e-9 for e in want)


def test_synthetic_control_recovers_mixture(spark):
    rng = np.random.default_rng(5)
    T, t0 = 40, 30
    controls = rng.normal(size=(4, T)).cumsum(axis=1)
    treated = 0.5 * controls[0] + 0.5 * controls[1]
    treated[t0:] -= 0.5
    runs = SD.sdid_runs(_panel(spark, np.vstack([treated, controls]), [True] + [False] * 4, t0), "unit", "t", "y", "d", method="sc")
    assert abs(SD.summarize_att(runs, "sc").first().att + 0.5) < 1e-3
    w = {r.unit: r.omega for r in SD.unit_weights(runs).collect()}
    assert abs(w["u1"] - 0.5) < 1e-2 and abs(w["u2"] - 0.5) < 1e-2


def test_sdid_matches_dense_matrices(spark):
    """Weights against the textbook problem solved on whole matrices; bootstrap copies too."""
    rng = np.random.default_rng(9)
    Y = rng.normal(size=(7, 24)).cumsum(axis=1)
    tr, t0 = np.array([True, True] + [False] * 5), 16
    runs = SD.sdid_runs(_panel(spark, Y, tr, t0), "unit", "t", "y", "d", vce="bootstrap", reps=8)
    drawn = {}
    for r in SD.assignments(spark.createDataFrame([("all", f"u{i}", int(tr[i])) for i in range(7)], "experiment string, unit string, treated int"),
                            "bootstrap", 8, 123).collect():
        drawn.setdefault(r.rep, []).extend([int(r.unit[1:])] * r.copies)
    weights = {}
    for r in runs.reps.join(runs.weights, ["experiment", "aid"]).collect():
        weights.setdefault((r.rep, r.kind), {})[r.unit or r.t] = r.value
    effects = {}
    for r in runs.reps.join(runs.effects, ["experiment", "aid"]).collect():
        effects.setdefault(r.rep, {})[r.t] = r.effect
    assert len(drawn) == 9
    for rep, idx in drawn.items():
        co, ta = [i for i in idx if not tr[i]], [i for i in idx if tr[i]]
        A, b = Y[co][:, :t0].T, Y[ta].mean(axis=0)
        noise = np.diff(Y[co][:, :t0], axis=1).std(ddof=1)
        zeta = (len(ta) * 8) ** 0.25 * noise
        assert abs(weights[rep, "zeta"][None] - zeta) < 1e-9
        Ac, bc = A - A.mean(0), b[:t0] - b[:t0].mean()
        w = fw_gram(Ac.T @ Ac / t0 + zeta ** 2 * np.eye(len(co)), Ac.T @ bc / t0, min_decrease=1e-5 * noise).weights
        for u in set(co):
            assert abs(sum(x for x, i in zip(w, co) if i == u) - weights[rep, "omega"][f"u{u}"]) < 1e-4
        om = np.array([weights[rep, "omega"][f"u{i}"] / co.count(i) for i in co])
        lam = np.array([weights[rep, "lambda"][t] for t in range(t0)])
        gap = b - om @ Y[co]
        want = gap - lam @ gap[:t0]
        assert np.allclose([effects[rep][t] for t in range(24)], want, atol=1e-9)


def test_optimized_covariates_come_back(spark):
    Y, tr, t0 = _additive_panel(n_units=7)
    rng = np.random.default_rng(8)
    X = rng.normal(size=Y.shape)
    rows = [(f"u{i}", t, float(Y[i, t] + 2 * X[i, t]), 1.0 if (tr[i] and t >= t0) else 0.0, float(X[i, t]), float(t % 3))
            for i in range(Y.shape[0]) for t in range(Y.shape[1])]
    df = spark.createDataFrame(rows, "unit string, t int, y double, d double, x double, season double")
    runs = SD.sdid_runs(df, "unit", "t", "y", "d", covariates=["x", "season"], covariate_form="optimized")
    assert abs(SD.summarize_att(runs, "optimized").first().att + 0.5) < 1e-4


def test_bad_designs_are_errors(spark):
    Y, _, t0 = _additive_panel()
    three = _panel(spark, Y, [True] * 3 + [False] * 3, t0)
    with pytest.raises(ValueError, match="bootstrap"):
        SD.sdid_runs(three, "unit", "t", "y", "d", vce="placebo", reps=5)
    staggered = three.withColumn("d", F.when((F.col("unit") == "u1") & (F.col("t") < t0 + 2), 0.0).otherwise(F.col("d")))
    with pytest.raises(ValueError, match="different times"):
        SD.sdid_runs(staggered, "unit", "t", "y", "d")
    with pytest.raises(ValueError, match="balanced"):
        SD.sdid_runs(three.where("not (unit = 'u4' and t = 3)"), "unit", "t", "y", "d")


def test_covariate_unit_of_measure_does_not_matter(spark):
    from forumshift.operators import did as D
    rng = np.random.default_rng(2)
    rows = []
    for u in range(8):
        for t in range(20):
            d, x = float(u < 3 and t >= 12), rng.normal()
            rows.append((u, t, 0.4 * d + 3 * x + 0.1 * u + rng.normal(scale=0.01), d, x, 1e-7 * x, float(t)))
    df = spark.createDataFrame(rows, "u int, t int, y double, d double, x double, small double, trend double")
    a, b, c = (D.twfe_did(df, "u", "t", "y", "d", covariates=v).first().att for v in (["x"], ["small"], ["x", "small", "trend"]))
    assert abs(a - 0.4) < 0.02 and abs(a - b) < 1e-6 and abs(a - c) < 1e-6


def test_unlisted_values_and_gaps(spark):
    from forumshift.operators import panel as P
    df = spark.createDataFrame([("a", 1, 2), ("zz", 2, 3)], "forum string, wk int, n int")
    got = {(r.forum, r.wk): r.n for r in P.complete_counts(df, "forum", "wk", "n").collect()}
    assert got == {("a", 1): 2, ("a", 2): 0, ("zz", 1): 0, ("zz", 2): 3}
    with pytest.raises(ValueError, match="zz"):
        P.pivot_wide(df, "wk", "forum", ["n"], ["a"])


def test_demeaning_that_does_not_converge_is_an_error(spark):
    from forumshift.operators import did as D
    rows = [(i, t, float(i * t % 7)) for i in range(6) for t in (i, i + 1)]
    df = spark.createDataFrame(rows, "u int, t int, y double")
    with pytest.raises(ValueError, match="converge"):
        D.two_way_demean(df, "u", "t", ["y"], max_iter=4)


def test_normal_and_t_tails(spark):
    """Against the error function and numerical integration of the t density."""
    import math

    from forumshift.functions.normal import two_sided_sql, upper_tail_sql
    from forumshift.operators.significance import t_two_sided
    rows = [(float(z),) for z in (-6.0, -1.0, 0.0, 0.3, 1.96, 5.0, 9.0)]
    for r in spark.createDataFrame(rows, "z double").selectExpr("z", f"{two_sided_sql('z')} AS p", f"{upper_tail_sql('z')} AS u").collect():
        assert abs(r.p / math.erfc(abs(r.z) / math.sqrt(2)) - 1) < 1e-6
        assert abs(r.u / (0.5 * math.erfc(r.z / math.sqrt(2))) - 1) < 1e-6

    def tail(t, n):
        x = np.linspace(0, t, 200_001)
        d = np.exp(math.lgamma((n + 1) / 2) - math.lgamma(n / 2)) / math.sqrt(n * math.pi) * (1 + x * x / n) ** (-(n + 1) / 2)
        return 1 - 2 * np.trapezoid(d, x)

    rows = [(t, n) for t in (0.0, 0.5, 2.0, 3.3) for n in (5, 10, 30, 400)]
    for r in spark.createDataFrame(rows, "t double, n long").withColumn("p", t_two_sided("t", "cast(n as double)")).collect():
        assert abs(r.p - tail(r.t, r.n)) < 1e-5


def test_twfe_unbalanced_matches_dummy_regression(spark):
    from forumshift.operators import did as D
    rng = np.random.default_rng(11)
    rows = []
    for u in range(6):
        for t in range(25):
            if (u * 7 + t * 3) % 11 == 0:
                continue                                   # holes: unbalanced
            d = 1.0 if (u < 2 and t >= 15) else 0.0
            rows.append((u, t, 0.2 * u - 0.03 * t + 0.4 * d + rng.normal(scale=0.1), d))
    df = spark.createDataFrame(rows, "u int, t int, y double, d double")
    att = D.twfe_did(df, "u", "t", "y", "d").first().att
    # brute force: OLS with unit and time dummies
    U = np.array([r[0] for r in rows]); Tt = np.array([r[1] for r in rows])
    X = np.column_stack([np.array([r[3] for r in rows]), np.eye(6)[U], np.eye(25)[Tt][:, 1:]])
    beta = np.linalg.lstsq(X, np.array([r[2] for r in rows]), rcond=None)[0]
    assert abs(att - beta[0]) < 1e-8


def test_mann_whitney_matches_pair_counting(spark):
    from forumshift.operators import significance as S
    from forumshift.operators.terms import TfidfResult
    rng = np.random.default_rng(7)
    docs, long = [], []
    for d in range(300):
        pre = int(d % 3 != 0)
        docs.append((d, pre))
        for term in ("a", "b"):
            if rng.random() < 0.6:
                # values spread over several orders of magnitude, with ties
                v = float(np.round(10 ** rng.uniform(-4, 0), 3 if term == "a" else 6)) or 0.001
                long.append((d, pre, term, 1, v))
    res = TfidfResult(vocab=None,
                      long=spark.createDataFrame(long, "doc_id long, pre int, term string, tf long, tfidf double"),
                      docs=spark.createDataFrame(docs, "doc_id long, pre int"))
    got = {r.term: r.mw_u for r in S.mann_whitney(res, ["a", "b"]).collect()}
    vals = {}
    for t in ("a", "b"):
        x = {d: 0.0 for d, _ in docs}
        for d, _, term, _, v in long:
            if term == t:
                x[d] = v
        post = np.array([x[d] for d, p in docs if p == 0])
        pre = np.array([x[d] for d, p in docs if p == 1])
        u = (post[:, None] > pre[None, :]).sum() + 0.5 * (post[:, None] == pre[None, :]).sum()
        vals[t] = u
    for t in ("a", "b"):
        assert abs(got[t] - vals[t]) < 1e-6, (t, got[t], vals[t])


def _by_kind(runs):
    return {(r.rep, r.kind, r.unit, r.t): r.value for r in runs.reps.join(runs.weights, ["experiment", "aid"]).collect()}


@pytest.mark.parametrize("method,vce", [("sdid", "bootstrap"), ("sc", "none")])
def test_steps_over_the_cluster_equal_steps_in_one_task(spark, monkeypatch, method, vce):
    """The same weights whether a panel is small enough for one task or not."""
    rng = np.random.default_rng(12)
    Y = rng.normal(size=(6, 1)) + np.sin(np.arange(20) / 5) * rng.uniform(0.5, 1.5, size=(6, 1)) + 0.2 * rng.normal(size=(6, 20))
    panel = _panel(spark, Y, [True] + [False] * 5, 14)
    here = _by_kind(SD.sdid_runs(panel, "unit", "t", "y", "d", method=method, vce=vce, reps=2, tol=0.02))
    monkeypatch.setattr(SD, "LOCAL_CELLS", 0)
    there = _by_kind(SD.sdid_runs(panel, "unit", "t", "y", "d", method=method, vce=vce, reps=2, tol=0.02))
    assert here.keys() == there.keys()
    for k, v in here.items():
        if method != "sc" or "iterations" not in k[1]:
            assert abs(v - there[k]) < 1e-6, k


def test_many_controls_and_weights_that_do_not_converge(spark):
    """20,000 controls over 24 periods: no matrix of pairs; the effect that was planted comes back."""
    units = spark.range(20_001).select("id", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("t"))
    u = lambda n: (F.xxhash64("id", F.lit(n)) % 1000) / 1000.0
    panel = units.select(F.concat(F.lit("u"), "id").alias("unit"), "t", ((F.col("id") == 0) & (F.col("t") >= 18)).cast("double").alias("d"),
                         (u(1) + u(2) * F.sin(F.col("t") / 3.0) + u(3) * F.col("t") / 10 + 0.02 * (F.xxhash64("id", "t") % 100) / 100.0
                          + F.when((F.col("id") == 0) & (F.col("t") >= 18), 0.75).otherwise(0.0)).alias("y"))
    runs = SD.sdid_runs(panel, "unit", "t", "y", "d", max_iter=3000)
    w = SD.unit_weights(runs).agg(F.count("*").alias("n"), F.sum("omega").alias("s"), F.min("omega").alias("m")).first()
    assert w.n == 20_000 and abs(w.s - 1) < 1e-9 and w.m >= 0
    assert abs(SD.summarize_att(runs, "x").first().att - 0.75) < 0.05
    with pytest.raises(ValueError, match="did not converge"):
        SD.sdid_runs(panel.where("length(unit) = 2"), "unit", "t", "y", "d", max_iter=1, tol=0.0)
