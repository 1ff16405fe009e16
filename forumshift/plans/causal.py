"""Causal estimates on the orders analogue panel.

Estimation panel: unit = forum (5 priorities), time = Monday of the week
(calendar weeks align units on sparse data, G2), outcome = log(1 + count),
treatment = treated forum after the event.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.dates import week_monday, year_month, year_quarter
from ..functions.student import central_duck
from ..operators import did as D
from ..operators import panel as P
from ..session import cut_lineage
from .fixtures import ORDERS_EVENT_DATE, ORDERS_TREATED_FORUM, ORDERS_TRIM, with_views
from .registry import register, rounded
from .volume import orders_posts


def estimation_panel(spark, sf):
    posts = orders_posts(spark, sf).select("forum", week_monday(F.to_date("CreationDate")).alias("wk"))
    posts = posts.where(P.trim_predicate("wk", ORDERS_TRIM))
    panel = posts.groupBy("forum", "wk").agg(F.count(F.lit(1)).alias("question_count"))
    # weeks without posts of a forum are zero counts, not missing cells
    panel = P.complete_counts(panel, "forum", "wk", "question_count")
    treated = F.col("forum") == ORDERS_TREATED_FORUM
    post = F.col("wk") > F.lit(ORDERS_EVENT_DATE).cast("date")
    return panel.withColumns({
        "y": F.log1p(F.col("question_count").cast("double")),
        "treated": treated.cast("int"),
        "post": post.cast("int"),
        "d": (treated & post).cast("double"),
    })


_PANEL_CTES = f"""
, c0 AS (SELECT forum, CAST(date_trunc('week', CreationDate) AS DATE) AS wk, count(*) AS question_count
         FROM posts_orders GROUP BY 1, 2),
p0 AS (SELECT f.forum, w.wk, coalesce(c0.question_count, 0) AS question_count
       FROM (SELECT DISTINCT forum FROM c0) f CROSS JOIN (SELECT DISTINCT wk FROM c0
             WHERE wk > DATE '{ORDERS_TRIM[0]}' AND wk <= DATE '{ORDERS_TRIM[1]}') w
       LEFT JOIN c0 ON c0.forum = f.forum AND c0.wk = w.wk),
p AS (SELECT forum, wk, question_count, ln(1 + CAST(question_count AS DOUBLE)) AS y,
             CAST(forum = '{ORDERS_TREATED_FORUM}' AS INTEGER) AS treated,
             CAST(wk > DATE '{ORDERS_EVENT_DATE}' AS INTEGER) AS post,
             CAST(forum = '{ORDERS_TREATED_FORUM}' AND wk > DATE '{ORDERS_EVENT_DATE}' AS DOUBLE) AS d
      FROM p0 WHERE wk > DATE '{ORDERS_TRIM[0]}' AND wk <= DATE '{ORDERS_TRIM[1]}')"""

_DID_CTES = """
, um AS (SELECT forum, avg(y) AS uy, avg(d) AS ud FROM p GROUP BY forum),
tm AS (SELECT wk, avg(y) AS ty, avg(d) AS td FROM p GROUP BY wk),
gm AS (SELECT avg(y) AS gy, avg(d) AS gd FROM p),
dm AS (SELECT forum, wk, y - uy - ty + gy AS yt, d - ud - td + gd AS dt
       FROM p JOIN um USING (forum) JOIN tm USING (wk) CROSS JOIN gm),
b AS (SELECT sum(dt * yt) / sum(dt * dt) AS att, sum(dt * dt) AS sxx FROM dm),
cl AS (SELECT forum, sum(dt / sxx * (yt - att * dt)) AS score FROM dm CROSS JOIN b GROUP BY forum),
v AS (SELECT sum(score * score) AS v, count(*) AS g FROM cl),
est AS (SELECT att, sqrt(g / (g - 1.0) * v) AS se, g FROM b CROSS JOIN v),
cnt AS (SELECT count(*) AS n_obs, count(DISTINCT forum) AS n_units, count(DISTINCT wk) AS n_periods FROM p)"""


def causal_sql(select: str, did: bool = True) -> str:
    return (with_views("", "posts_orders").replace("WITH", "WITH RECURSIVE", 1) + "," + _PANEL_CTES.lstrip().lstrip(",")
            + (_DID_CTES if did else "") + "\n" + select)


def _did_select(spec: str) -> str:
    return f"""
, tq AS (SELECT 0 AS it, 0e0 AS lo, 1e4 AS hi, g - 1 AS df FROM est
         UNION ALL SELECT it + 1, CASE WHEN {central_duck('m', 'df')} < 0.95 THEN m ELSE lo END,
                          CASE WHEN {central_duck('m', 'df')} < 0.95 THEN hi ELSE m END, df
         FROM (SELECT *, (lo + hi) / 2 AS m FROM tq WHERE it < 80)),
tc AS (SELECT hi AS q FROM tq WHERE it = 80)
SELECT '{spec}' AS spec, round(att, 6) AS att, round(se, 6) AS se, round(att / se, 6) AS t_stat,
       round(att - q * se, 6) AS ci_lower, round(att + q * se, 6) AS ci_upper,
       round((exp(att) - 1) * 100.0, 6) AS pct_effect, n_obs, n_units, n_periods, g AS n_clusters
FROM est CROSS JOIN cnt CROSS JOIN tc"""


@register("estimation_panel", causal_sql(
    "SELECT forum, wk, question_count, round(y, 6) AS y, treated, post, d FROM p", did=False))
def q_estimation_panel(spark, sf):
    """The balanced (forum, calendar week) panel the estimators use."""
    return rounded(estimation_panel(spark, sf))


@register("did_att", causal_sql(_did_select("twfe")))
def q_did_att(spark, sf):
    """Two-way fixed-effects DiD, SE clustered by forum, percent effect."""
    return rounded(D.twfe_did(estimation_panel(spark, sf), "forum", "wk", "y", "d", label="twfe"))


@register("did_cluster_se", causal_sql("SELECT forum, round(score, 6) AS score FROM cl"))
def q_did_cluster_se(spark, sf):
    """Per-cluster scores whose sum of squares gives the clustered variance."""
    return rounded(D.cluster_scores(estimation_panel(spark, sf), "forum", "wk", "y", "d"))


@register("did_week_fe", causal_sql(_did_select("twfe_week")))
def q_did_week_fe(spark, sf):
    """+ explicit week dummies (collinear with the week effects: same ATT)."""
    panel = P.dummies(estimation_panel(spark, sf), F.date_format("wk", "yyyyMMdd"), "week")
    covs = [c for c in panel.columns if c.startswith("week_")]
    return rounded(D.twfe_did(panel, "forum", "wk", "y", "d", covariates=covs, label="twfe_week"))


@register("did_month_fe", causal_sql(_did_select("twfe_month")))
def q_did_month_fe(spark, sf):
    """+ year-month dummies (time-only, absorbed by the week effects: same ATT)."""
    panel = P.dummies(estimation_panel(spark, sf), year_month("wk"), "year_month")
    covs = [c for c in panel.columns if c.startswith("year_month_")]
    return rounded(D.twfe_did(panel, "forum", "wk", "y", "d", covariates=covs, label="twfe_month"))


@register("did_quarter_fe", causal_sql(_did_select("twfe_quarter")))
def q_did_quarter_fe(spark, sf):
    """C4: + year-quarter dummies (absorbed by the week effects: same ATT)."""
    panel = P.dummies(estimation_panel(spark, sf), year_quarter("wk"), "year_quarter")
    covs = [c for c in panel.columns if c.startswith("year_quarter_")]
    return rounded(D.twfe_did(panel, "forum", "wk", "y", "d", covariates=covs, label="twfe_quarter"))


@register("did_2x2", causal_sql("""
, c AS (SELECT treated AS t, post AS q, count(y) AS n, avg(y) AS m, var_pop(y) AS v FROM p GROUP BY 1, 2),
w AS (SELECT max(CASE WHEN t = 1 AND q = 1 THEN m END) AS m11, max(CASE WHEN t = 1 AND q = 0 THEN m END) AS m10,
             max(CASE WHEN t = 0 AND q = 1 THEN m END) AS m01, max(CASE WHEN t = 0 AND q = 0 THEN m END) AS m00,
             sum(n * v) AS rss, sum(n) AS n, sum(1.0 / n) AS inv FROM c)
SELECT round((m11 - m10) - (m01 - m00), 6) AS effect, round(sqrt(rss / (n - 4) * inv), 6) AS se,
       round(((m11 - m10) - (m01 - m00)) / sqrt(rss / (n - 4) * inv), 6) AS t_stat, CAST(n AS BIGINT) AS n_obs
FROM w""", did=False))
def q_did_2x2(spark, sf):
    """2x2 DiD (treated x post) by OLS with interaction: effect, SE, t."""
    return rounded(D.did_2x2(estimation_panel(spark, sf), "treated", "post", "y"))


# ------------------------------------------- several treated units, covariates, gaps

def group_panel(spark, sf):
    """As the estimation panel, with the seven groups as units (three are treated)."""
    posts = orders_posts(spark, sf).select("forum", "group", week_monday(F.to_date("CreationDate")).alias("wk"), "Score")
    return posts.where(P.trim_predicate("wk", ORDERS_TRIM))


def _flags(panel, treated):
    post = F.col("wk") > F.lit(ORDERS_EVENT_DATE).cast("date")
    return panel.withColumns({"treated": treated.cast("int"), "post": post.cast("int"), "d": (treated & post).cast("double")})


def group_treated():
    return F.col("group").startswith(ORDERS_TREATED_FORUM)

_GROUP_CTES = f"""
, c0 AS (SELECT grp AS unit, CAST(date_trunc('week', CreationDate) AS DATE) AS wk, count(*) AS n, avg(Score) AS score
         FROM posts_orders GROUP BY 1, 2 HAVING wk > DATE '{ORDERS_TRIM[0]}' AND wk <= DATE '{ORDERS_TRIM[1]}'),
p AS (SELECT u.unit AS forum, w.wk, ln(1 + CAST(coalesce(n, 0) AS DOUBLE)) AS y, coalesce(score, 0) / 1000.0 AS x,
             CAST(starts_with(u.unit, '{ORDERS_TREATED_FORUM}') AND w.wk > DATE '{ORDERS_EVENT_DATE}' AS DOUBLE) AS d
      FROM (SELECT DISTINCT unit FROM c0) u CROSS JOIN (SELECT DISTINCT wk FROM c0) w LEFT JOIN c0 ON c0.unit = u.unit AND c0.wk = w.wk)"""


def group_sql(select: str, did: str = _DID_CTES) -> str:
    return with_views("", "posts_orders").replace("WITH", "WITH RECURSIVE", 1) + "," + _GROUP_CTES.lstrip().lstrip(",") + did + "\n" + select


def filled_groups(spark, sf):
    posts = group_panel(spark, sf)
    cells = cut_lineage(posts.groupBy("group", "wk").agg(F.count("*").alias("n"), F.avg("Score").alias("score")))
    full = P.complete_counts(cells, "group", "wk", "n").join(cells.select("group", "wk", "score"), ["group", "wk"], "left")
    full = full.withColumns({"y": F.log1p(F.col("n").cast("double")), "x": F.coalesce("score", F.lit(0.0)) / 1000.0})
    return _flags(full, group_treated())


@register("did_groups", group_sql(_did_select("groups")))
def q_did_groups(spark, sf):
    """DiD over seven groups of which three are treated, clustered by group."""
    return rounded(D.twfe_did(filled_groups(spark, sf), "group", "wk", "y", "d", label="groups"))


_COV_CTES = """
, um AS (SELECT forum, avg(y) AS uy, avg(d) AS ud, avg(x) AS ux FROM p GROUP BY forum),
tm AS (SELECT wk, avg(y) AS ty, avg(d) AS td, avg(x) AS tx FROM p GROUP BY wk),
gm AS (SELECT avg(y) AS gy, avg(d) AS gd, avg(x) AS gx FROM p),
dm AS (SELECT forum, y - uy - ty + gy AS y, d - ud - td + gd AS d, x - ux - tx + gx AS x
       FROM p JOIN um USING (forum) JOIN tm USING (wk) CROSS JOIN gm),
s AS (SELECT sum(d * d) AS dd, sum(d * x) AS dx, sum(x * x) AS xx, sum(d * y) AS dy, sum(x * y) AS xy FROM dm),
b AS (SELECT (dy * xx - xy * dx) / (dd * xx - dx * dx) AS att, (xy * dd - dy * dx) / (dd * xx - dx * dx) AS bx,
             xx / (dd * xx - dx * dx) AS i1, -dx / (dd * xx - dx * dx) AS i2 FROM s),
cl AS (SELECT forum, sum((i1 * d + i2 * x) * (y - att * d - bx * x)) AS score FROM dm CROSS JOIN b GROUP BY forum),
v AS (SELECT sum(score * score) AS v, count(*) AS g FROM cl),
est AS (SELECT att, sqrt(g / (g - 1.0) * v) AS se, g FROM b CROSS JOIN v),
cnt AS (SELECT count(*) AS n_obs, count(DISTINCT forum) AS n_units, count(DISTINCT wk) AS n_periods FROM p)"""


@register("did_covariates", group_sql(_did_select("covariate"), _COV_CTES))
def q_did_covariates(spark, sf):
    """DiD with a covariate that varies within periods (mean score of the cell)."""
    return rounded(D.twfe_did(filled_groups(spark, sf), "group", "wk", "y", "d", covariates=["x"], label="covariate"))


@register("did_unbalanced", with_views(f"""
, c AS (SELECT grp, CAST(date_trunc('week', CreationDate) AS DATE) AS wk, count(*) AS n FROM posts_orders GROUP BY 1, 2
        HAVING wk > DATE '{ORDERS_TRIM[0]}' AND wk <= DATE '{ORDERS_TRIM[1]}')
SELECT 'unit' AS condition, count(DISTINCT grp) AS n, 0.0::DOUBLE AS worst FROM c
UNION ALL SELECT 'period', count(DISTINCT wk), 0.0::DOUBLE FROM c
UNION ALL SELECT 'treatment', count(*), 0.0::DOUBLE FROM c""".lstrip().lstrip(","), "posts_orders").replace("\n c AS", ",\n c AS", 1))
def q_did_unbalanced(spark, sf):
    """The panel with its gaps.  Least squares is known by its normal equations: the
    residuals sum to zero for every unit, for every period and with the treatment."""
    cells = group_panel(spark, sf).groupBy("group", "wk").agg(F.count("*").alias("n"))
    panel = cut_lineage(_flags(cells.withColumn("y", F.log1p(F.col("n").cast("double"))), group_treated()))
    att = D.twfe_did(panel, "group", "wk", "y", "d").first()["att"]
    dm = D.two_way_demean(panel, "group", "wk", ["y", "d"])
    e = cut_lineage(dm.select("group", "wk", "d", (F.col("y") - F.lit(att) * F.col("d")).alias("e")))

    def worst(kind, key):
        return (e.groupBy(key).agg(F.abs(F.sum("e")).alias("s")).agg(F.count("*").alias("n"), F.max("s").alias("worst"))
                .select(F.lit(kind).alias("condition"), "n", "worst"))
    treat = e.agg(F.count("*").alias("n"), F.abs(F.sum(F.col("d") * F.col("e"))).alias("worst")).select(
        F.lit("treatment").alias("condition"), "n", "worst")
    return rounded(worst("unit", "group").unionByName(worst("period", "wk")).unionByName(treat))


# ------------------------------------------------------------ synthetic DiD
from ..operators import sdid as SD  # noqa: E402

SDID_SEED = 123
SDID_REPS = 100


def sdid_runs(spark, sf, method="sdid", vce="none", covariates=False):
    panel = estimation_panel(spark, sf)
    covs = ()
    if covariates:
        panel = P.dummies(cut_lineage(panel), year_month("wk"), "year_month")
        covs = tuple(c for c in panel.columns if c.startswith("year_month_"))
    return SD.sdid_runs(panel, "forum", "wk", "y", "d", method=method, vce=vce,
                        reps=SDID_REPS, seed=SDID_SEED, covariates=covs)


@register("sdid_att")
def q_sdid_att(spark, sf):
    """SDID ATT with placebo SE (100 replicates, seed 123)."""
    return SD.summarize_att(sdid_runs(spark, sf, vce="placebo"), "sdid", "placebo")


@register("sdid_bootstrap")
def q_sdid_bootstrap(spark, sf):
    """SDID ATT with bootstrap SE (units resampled; draws lacking an arm redrawn)."""
    return SD.summarize_att(sdid_runs(spark, sf, vce="bootstrap"), "sdid", "bootstrap")


@register("sdid_covariates")
def q_sdid_covariates(spark, sf):
    """SDID with year-month covariates (projected; time-only dummies leave it unchanged)."""
    return SD.summarize_att(sdid_runs(spark, sf, vce="placebo", covariates=True), "sdid_month", "placebo")


@register("synthetic_control")
def q_synthetic_control(spark, sf):
    """Synthetic control (no intercept, no ridge, no time weights), placebo SE."""
    return SD.summarize_att(sdid_runs(spark, sf, method="sc", vce="placebo"), "sc", "placebo")


@register("sdid_weights")
def q_sdid_weights(spark, sf):
    """SDID control-unit weights (non-negative, sum to one)."""
    return SD.unit_weights(sdid_runs(spark, sf))


@register("sdid_time_weights")
def q_sdid_time_weights(spark, sf):
    """SDID pre-period weights (non-negative, sum to one)."""
    return SD.time_weights(sdid_runs(spark, sf))


@register("event_study")
def q_event_study(spark, sf):
    """SDID effect per relative week (leads and lags) with replicate SE and CI."""
    return SD.event_study(sdid_runs(spark, sf, vce="placebo"))


@register("event_bands")
def q_event_bands(spark, sf):
    """Mean event-study effect by week band (1-4, 5-12, ... 61-65) and overall."""
    return SD.effect_bands(SD.event_study(sdid_runs(spark, sf)))


@register("synthetic_path")
def q_synthetic_path(spark, sf):
    """Treated mean, SDID synthetic control and plain control mean per week."""
    return SD.synthetic_path(sdid_runs(spark, sf))


@register("sdid_convergence")
def q_sdid_convergence(spark, sf):
    """Ridge, convergence flag and iterations of the estimate and each placebo."""
    return SD.convergence(sdid_runs(spark, sf, vce="placebo"))


@register("sdid_optimized")
def q_sdid_optimized(spark, sf):
    """SDID over the seven groups with a covariate optimized jointly with the weights."""
    runs = SD.sdid_runs(filled_groups(spark, sf), "group", "wk", "y", "d", covariates=["x"], covariate_form="optimized")
    return SD.summarize_att(runs, "sdid_optimized")


# With uniform weights everything after the weights has a closed form in SQL.
_UNIFORM = (f"CAST(('0x' || substr(md5('{SDID_SEED}:' || rep || ':' || forum), 1, 13)) AS BIGINT) / {2 ** 52}.0::DOUBLE")
_UNIFORM_CTES = f"""
, units AS (SELECT DISTINCT forum, treated FROM p),
drawn AS (SELECT rep, forum, row_number() OVER (PARTITION BY rep ORDER BY {_UNIFORM}, forum) AS r
          FROM (SELECT unnest(range(1, {SDID_REPS + 1})) AS rep) CROSS JOIN (SELECT forum FROM units WHERE treated = 0)),
asg AS (SELECT 0 AS rep, forum, treated AS tr FROM units
        UNION ALL SELECT rep, forum, CAST(r <= (SELECT sum(treated) FROM units) AS INTEGER) FROM drawn),
paths AS (SELECT rep, wk, post, avg(CASE WHEN tr = 1 THEN y END) AS a, avg(CASE WHEN tr = 0 THEN y END) AS b
          FROM p JOIN asg USING (forum) GROUP BY ALL),
eff AS (SELECT rep, wk, post, a, b, a - b - avg(CASE WHEN post = 0 THEN a - b END) OVER (PARTITION BY rep) AS e,
               CAST(row_number() OVER (PARTITION BY rep ORDER BY wk) - count(CASE WHEN post = 0 THEN 1 END) OVER (PARTITION BY rep) AS INTEGER) AS rel_time
        FROM paths),
se AS (SELECT rel_time, stddev_pop(e) AS se FROM eff WHERE rep > 0 GROUP BY 1),
atts AS (SELECT rep, avg(e) AS v FROM eff WHERE post = 1 GROUP BY 1),
att AS (SELECT max(CASE WHEN rep = 0 THEN v END) AS att, stddev_pop(CASE WHEN rep > 0 THEN v END) AS se, count(CASE WHEN rep > 0 THEN 1 END) AS n FROM atts)"""


def uniform_sql(select: str) -> str:
    return causal_sql(select, did=False).replace(select, "") + _UNIFORM_CTES + "\n" + select


@register("sdid_uniform_att", uniform_sql(f"""
SELECT 'all' AS experiment, 'uniform' AS spec, 'placebo' AS vce, round(att, 6) AS att, round(se, 6) AS se, round(att / se, 6) AS t_stat,
       round(att - {SD.Z95} * se, 6) AS ci_lower, round(att + {SD.Z95} * se, 6) AS ci_upper,
       round((exp(att) - 1) * 100.0, 6) AS pct_effect, n AS n_reps FROM att"""))
def q_sdid_uniform_att(spark, sf):
    """The ATT and its placebo SE with uniform weights."""
    return rounded(SD.summarize_att(sdid_runs(spark, sf, method="did", vce="placebo"), "uniform", "placebo"))


@register("sdid_uniform_events", uniform_sql(f"""
SELECT 'all' AS experiment, rel_time, CAST(wk AS VARCHAR) AS period, round(e, 6) AS estimate, round(se, 6) AS se,
       round(e - {SD.Z95} * se, 6) AS ci_lower, round(e + {SD.Z95} * se, 6) AS ci_upper
FROM eff JOIN se USING (rel_time) WHERE rep = 0"""))
def q_sdid_uniform_events(spark, sf):
    """Event study with uniform weights and placebo SEs."""
    return rounded(SD.event_study(sdid_runs(spark, sf, method="did", vce="placebo")))


_BANDS = " ".join(f"WHEN rel_time BETWEEN {lo} AND {hi} THEN '{lo}-{hi}'" for lo, hi in SD.EVENT_BANDS)


@register("sdid_uniform_bands", uniform_sql(f"""
SELECT 'all' AS experiment, band, round(avg(e), 6) AS estimate, count(*) AS n_periods
FROM (SELECT e, unnest(['overall', CASE {_BANDS} END]) AS band FROM eff WHERE rep = 0 AND rel_time >= 1)
WHERE band IS NOT NULL GROUP BY band"""))
def q_sdid_uniform_bands(spark, sf):
    """Effects by week band with uniform weights."""
    return rounded(SD.effect_bands(SD.event_study(sdid_runs(spark, sf, method="did"))))


@register("sdid_uniform_path", uniform_sql("""
SELECT 'all' AS experiment, CAST(wk AS VARCHAR) AS period, rel_time, round(a, 6) AS treated, round(b, 6) AS synthetic, round(b, 6) AS control
FROM eff WHERE rep = 0"""))
def q_sdid_uniform_path(spark, sf):
    """Paths with uniform weights."""
    return rounded(SD.synthetic_path(sdid_runs(spark, sf, method="did")))


@register("sdid_weight_sums", causal_sql("""
SELECT 'omega' AS kind, count(DISTINCT forum) AS n, 1.0::DOUBLE AS total, 0::BIGINT AS negative FROM p WHERE treated = 0
UNION ALL SELECT 'lambda', count(DISTINCT wk), 1.0::DOUBLE, 0::BIGINT FROM p WHERE post = 0""", did=False))
def q_sdid_weight_sums(spark, sf):
    """The weights lie on the simplex: number, sum and sign of both kinds."""
    w = SD._weights
    runs = sdid_runs(spark, sf)
    return rounded(w(runs, "omega").unionByName(w(runs, "lambda")).groupBy("kind").agg(
        F.count("*").alias("n"), F.sum("value").alias("total"), F.sum((F.col("value") < 0).cast("long")).alias("negative")))


PLANTED = -0.5


@register("sdid_planted", f"""
SELECT experiment, {PLANTED}::DOUBLE AS effect FROM (VALUES ('did'), ('sdid'), ('sc')) t(experiment)""")
def q_sdid_planted(spark, sf):
    """A planted effect comes back exactly.  The treated forum's path is made the mean
    of two controls plus the effect after the event, which every method can match."""
    panel = cut_lineage(estimation_panel(spark, sf))
    mean = panel.where(F.col("forum").isin("2-HIGH", "5-LOW")).groupBy("wk").agg(F.avg("y").alias("m"))
    planted = panel.join(mean, "wk").withColumn("y", F.when(F.col("treated") == 1, F.col("m") + F.lit(PLANTED) * F.col("d")).otherwise(F.col("y")))
    out = None
    for method in ("did", "sdid", "sc"):
        only = planted if method != "did" else planted.where(F.col("forum").isin(ORDERS_TREATED_FORUM, "2-HIGH", "5-LOW"))
        runs = SD.sdid_runs(only, "forum", "wk", "y", "d", method=method)
        one = SD.summarize_att(runs, method).select(F.lit(method).alias("experiment"), F.round("att", 1 if method != "did" else 6).alias("effect"))
        out = one if out is None else out.unionByName(one)
    return out
