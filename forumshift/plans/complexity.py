"""Question complexity over the document analogue.

Frames: the treated forum's rows (tech expression = code length) and the rows of all
control forums together (tech expression = equation length), z-scored separately (G3).
The fixture's control rows are two forums (``CONTROL_SQL``).
"""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.dates import lenient_timestamp
from ..operators import complexity as C
from ..operators import posts as O
from ..session import cut_lineage
from . import sqltext as Q
from ..functions.dates import year_quarter
from ..operators import did as D
from .causal import _DID_CTES, _did_select
from .fixtures import DOCS_EVENT_DATE, STUDY_TRIM
from .posts import docs_posts, processed_sql
from .registry import register, rounded

TREATED_FORUM = "Stack Overflow"
NORM_COLS = tuple(d for _, d in C.METRICS)


# The control rows of the fixture belong to two forums, by their source.
CONTROL_SQL = "CASE WHEN forum <> 'Stack Overflow' AND CAST(Id AS BIGINT) % 2 = 0 THEN 'Physics' ELSE forum END"


def question_metrics(spark, sf, arm: str | None = None):
    """Per-question metrics, z-scored per arm, with the composite score.

    ``arm`` ('treated' or 'control') keeps one arm before any text work: the statistics are
    per arm, so the other arm's posts need not be parsed.
    """
    p = O.filter_questions(docs_posts(spark, sf)).withColumn("forum", F.expr(CONTROL_SQL))
    treated = F.col("forum") == TREATED_FORUM
    if arm is not None:
        p = p.where(treated if arm == "treated" else ~treated)
    p = O.process_posts(p, extra=("forum",))
    p = O.language_group(p, out="Lang")
    p = p.withColumns({
        "arm": F.when(treated, F.lit("treated")).otherwise(F.lit("control")),
        "CreationDate": lenient_timestamp("CreationDate"),
        "tech_expr_length": F.when(treated, F.col("code_length")).otherwise(X.math_length("clean_text")),
    })
    # The text work is done once: the narrow per-question metrics go to the shared folder,
    # since the z-score statistics and the scores both read them.
    p = cut_lineage(p.select("Id", "forum", "arm", "Lang", "CreationDate", *[m for m, _ in C.METRICS]))
    return C.complexity_score(C.zscore(p, dict(C.METRICS), partition="arm"), NORM_COLS)


def _z_sql() -> str:
    mets = [m for m, _ in C.METRICS]
    stats = ", ".join(f"avg(CAST({m} AS DOUBLE)) AS mu_{m}, stddev_samp(CAST({m} AS DOUBLE)) AS sd_{m}"
                      for m in mets)
    zs = ", ".join(f"CASE WHEN sd_{m} > 0 THEN (CAST({m} AS DOUBLE) - mu_{m}) / sd_{m} END AS {d}"
                   for m, d in C.METRICS)
    math_len = f"length(array_to_string(regexp_extract_all(clean_text, {Q.lit(X.MATH_RE)}, 1), ''))"
    return f"""
, base AS (
  SELECT Id, {CONTROL_SQL} AS forum, CASE WHEN forum = '{TREATED_FORUM}' THEN 'treated' ELSE 'control' END AS arm,
         {Q.lenient_timestamp('CreationDate')} AS CreationDate, tag_count, body_length, title_length,
         CASE WHEN forum = '{TREATED_FORUM}' THEN code_length ELSE {math_len} END AS tech_expr_length,
         CASE WHEN list_contains(tag_list, 'python') THEN 'Python' WHEN list_contains(tag_list, 'r') THEN 'R'
              WHEN list_contains(tag_list, 'php') THEN 'PHP' ELSE 'JavaScript' END AS Lang
  FROM p),
stats AS (SELECT arm, {stats} FROM base GROUP BY arm),
z0 AS (SELECT base.*, {zs} FROM base JOIN stats USING (arm)),
z AS (SELECT *, 0.25 * ({' + '.join(NORM_COLS)}) AS score FROM z0)"""


def _weekly_sql(keys: str, where: str) -> str:
    lo, hi = STUDY_TRIM
    kk = f", {keys}" if keys else ""
    means = ", ".join(f"round(avg({d}), 6) AS mean_{d[5:]}" for d in NORM_COLS)
    return _z_sql() + f"""
SELECT CAST(year(CreationDate) * 100 + week(CreationDate) AS INTEGER) AS yearweek,
       CAST(year(CreationDate) AS INTEGER) AS year, CAST(week(CreationDate) AS INTEGER) AS week{kk},
       count(*) AS question_count, min(CAST(CreationDate AS DATE)) AS week_start, {means},
       round(avg(score), 6) AS mean_score
FROM z {where}
GROUP BY ALL
HAVING min(CAST(CreationDate AS DATE)) > DATE '{lo}' AND min(CAST(CreationDate AS DATE)) <= DATE '{hi}'"""


@register("complexity_score", processed_sql(_z_sql() + f"""
SELECT Id, forum, {', '.join(f'round({d}, 6) AS {d}' for d in NORM_COLS)}, round(score, 6) AS score
FROM z"""))
def q_complexity_score(spark, sf):
    """Per-frame z-scores of four lengths and their mean."""
    return rounded(question_metrics(spark, sf).select("Id", "forum", *NORM_COLS, "score"))


@register("weekly_complexity", processed_sql(_weekly_sql("", f"WHERE forum = '{TREATED_FORUM}'")))
def q_weekly_complexity(spark, sf):
    """A4: weekly complexity means over all languages of the treated forum."""
    m = question_metrics(spark, sf, "treated")
    return rounded(C.weekly_complexity(m, (), trim=STUDY_TRIM))


@register("weekly_complexity_lang", processed_sql(_weekly_sql("Lang", f"WHERE forum = '{TREATED_FORUM}'")))
def q_weekly_complexity_lang(spark, sf):
    """A5: weekly complexity means by language."""
    m = question_metrics(spark, sf, "treated")
    return rounded(C.weekly_complexity(m, ("Lang",), trim=STUDY_TRIM))


@register("weekly_complexity_forum", processed_sql(_weekly_sql("forum", "")))
def q_weekly_complexity_forum(spark, sf):
    """Weekly complexity means by forum (treated and control frames)."""
    return rounded(C.weekly_complexity(question_metrics(spark, sf), ("forum",), trim=STUDY_TRIM))


@register("arm_means", processed_sql(_z_sql() + f"""
, wk AS (SELECT forum, CAST(year(CreationDate) * 100 + week(CreationDate) AS INTEGER) AS yearweek,
                min(CAST(CreationDate AS DATE)) AS week_start, avg(score) AS mean_score
         FROM z GROUP BY forum, year(CreationDate), week(CreationDate)
         HAVING min(CAST(CreationDate AS DATE)) > DATE '{STUDY_TRIM[0]}'
            AND min(CAST(CreationDate AS DATE)) <= DATE '{STUDY_TRIM[1]}')
SELECT forum,
       round(avg(CASE WHEN week_start < DATE '{DOCS_EVENT_DATE}' THEN mean_score END), 6) AS pre_mean,
       round(avg(CASE WHEN week_start > DATE '{DOCS_EVENT_DATE}' THEN mean_score END), 6) AS post_mean,
       count(CASE WHEN week_start < DATE '{DOCS_EVENT_DATE}' THEN mean_score END) AS pre_weeks,
       count(CASE WHEN week_start > DATE '{DOCS_EVENT_DATE}' THEN mean_score END) AS post_weeks,
       min(week_start) AS first_week, max(week_start) AS last_week,
       round(avg(CASE WHEN week_start > DATE '{DOCS_EVENT_DATE}' THEN mean_score END)
           - avg(CASE WHEN week_start < DATE '{DOCS_EVENT_DATE}' THEN mean_score END), 6) AS diff
FROM wk GROUP BY forum"""))
def q_arm_means(spark, sf):
    """Unweighted pre/post means of weekly mean scores per arm."""
    wk = C.weekly_complexity(question_metrics(spark, sf), ("forum",), trim=STUDY_TRIM)
    return rounded(C.arm_means(wk, DOCS_EVENT_DATE, arm="forum"))


@register("complexity_union", processed_sql(_z_sql() + f"""
, so AS (SELECT Lang, CAST(year(CreationDate) * 100 + week(CreationDate) AS INTEGER) AS yearweek,
                min(CAST(CreationDate AS DATE)) AS week_start, avg(score) AS mean_score
         FROM z WHERE forum = '{TREATED_FORUM}' GROUP BY Lang, year(CreationDate), week(CreationDate)),
ctl AS (SELECT forum, CAST(year(CreationDate) * 100 + week(CreationDate) AS INTEGER) AS yearweek,
               min(CAST(CreationDate AS DATE)) AS week_start, avg(score) AS mean_score
        FROM z WHERE forum <> '{TREATED_FORUM}' GROUP BY forum, year(CreationDate), week(CreationDate)),
u AS (SELECT *, '{TREATED_FORUM}' AS forum FROM so UNION ALL BY NAME SELECT * FROM ctl)
SELECT coalesce(Lang, forum) AS "group", forum, yearweek, week_start, round(mean_score, 6) AS mean_score,
       CAST(forum = '{TREATED_FORUM}' AS INTEGER) AS treated
FROM u WHERE week_start > DATE '{STUDY_TRIM[0]}' AND week_start <= DATE '{STUDY_TRIM[1]}'"""))
def q_complexity_union(spark, sf):
    """Treated-forum language panel and control-forum panel stacked; the
    unit is the language when present, else the forum."""
    from ..operators import panel as P
    m = question_metrics(spark, sf)
    so = C.weekly_complexity(m.where(F.col("forum") == TREATED_FORUM), ("Lang",), trim=STUDY_TRIM) \
        .withColumn("forum", F.lit(TREATED_FORUM))
    ctl = C.weekly_complexity(m.where(F.col("forum") != TREATED_FORUM), ("forum",), trim=STUDY_TRIM)
    u = P.union_relaxed([so.select("Lang", "forum", "yearweek", "week_start", "mean_score"),
                         ctl.select("forum", "yearweek", "week_start", "mean_score")])
    u = P.mark_treated(P.coalesce_group(u), TREATED_FORUM)
    return rounded(u.select("group", "forum", "yearweek", "week_start", "mean_score", "treated"))


def _arm_sql(select: str, cells: str, group: str) -> str:
    lo, hi = STUDY_TRIM
    pre, post = (f"CASE WHEN week_start {op} DATE '{DOCS_EVENT_DATE}' THEN mean_score END" for op in ("<", ">"))
    return processed_sql(_z_sql() + f"""
, wk AS (SELECT {cells} min(CAST(CreationDate AS DATE)) AS week_start, avg(score) AS mean_score
         FROM z GROUP BY {cells} year(CreationDate), week(CreationDate)
         HAVING min(CAST(CreationDate AS DATE)) > DATE '{lo}' AND min(CAST(CreationDate AS DATE)) <= DATE '{hi}')
SELECT {select} round(avg({pre}), 6) AS pre_mean, round(avg({post}), 6) AS post_mean,
       count({pre}) AS pre_weeks, count({post}) AS post_weeks,
       min(week_start) AS first_week, max(week_start) AS last_week, round(avg({post}) - avg({pre}), 6) AS diff
FROM wk {group}""")


@register("arm_means_pooled", _arm_sql("arm,", "arm,", "GROUP BY arm"))
def q_arm_means_pooled(spark, sf):
    """pre/post means of the treated forum and of all control forums pooled."""
    wk = C.weekly_complexity(question_metrics(spark, sf), ("arm",), trim=STUDY_TRIM)
    return rounded(C.arm_means(wk, DOCS_EVENT_DATE, arm="arm"))


@register("arm_means_overall", _arm_sql("", "", ""))
def q_arm_means_overall(spark, sf):
    """pre/post means over all questions."""
    wk = C.weekly_complexity(question_metrics(spark, sf), (), trim=STUDY_TRIM)
    return rounded(C.arm_means(wk, DOCS_EVENT_DATE))


_QUARTER_PANEL = f"""
, cp AS (SELECT coalesce(CASE WHEN arm = 'treated' THEN Lang END, forum) AS forum,
               CAST(year(CreationDate) * 10 + quarter(CreationDate) AS INTEGER) AS wk, avg(norm_body_length) AS y,
               max(CAST(arm = 'treated' AND CAST(year(CreationDate) * 10 + quarter(CreationDate) AS INTEGER) > 20224 AS DOUBLE)) AS d
        FROM z WHERE CreationDate IS NOT NULL AND norm_body_length IS NOT NULL GROUP BY 1, 2)"""


def complexity_panel(spark, sf):
    """Mean complexity (z-score of the body length: the fixture's control posts all have as
    many tags, so their composite score is undefined) by unit (language of the treated forum,
    or control forum) and quarter, with its regression columns: flags, coded group."""
    from ..operators import panel as P
    m = question_metrics(spark, sf).where(F.col("CreationDate").isNotNull() & F.col("norm_body_length").isNotNull())
    m = m.withColumn("unit", F.when(F.col("arm") == "treated", F.col("Lang")).otherwise(F.col("forum")))
    q = m.groupBy("unit", "arm", year_quarter("CreationDate").alias("quarter")).agg(
        F.avg("norm_body_length").alias("y"), F.count("*").alias("n"), F.min(F.to_date("CreationDate")).alias("week_start"))
    q = q.withColumns({"treated": (F.col("arm") == "treated").cast("int"), "post": (F.col("quarter") > 20224).cast("int")})
    q = q.withColumn("d", (F.col("treated") * F.col("post")).cast("double"))
    return cut_lineage(P.encode_labels(cut_lineage(q), "unit", "unit_id"))


@register("complexity_panel", processed_sql(_z_sql() + _QUARTER_PANEL + """
SELECT forum AS unit, wk AS quarter, round(y, 6) AS y, d, CAST(dense_rank() OVER (ORDER BY forum) AS INTEGER) AS unit_id FROM cp"""))
def q_complexity_panel(spark, sf):
    """The regression table of the complexity study."""
    return rounded(complexity_panel(spark, sf).select("unit", "quarter", "y", "d", "unit_id"))


@register("did_complexity", processed_sql(_z_sql() + _QUARTER_PANEL + re.sub(r"\bp\b", "cp", _DID_CTES) + _did_select("complexity")).replace("WITH", "WITH RECURSIVE", 1))
def q_did_complexity(spark, sf):
    """C1/C5 on complexity: DiD over languages and control forums by quarter."""
    return rounded(D.twfe_did(complexity_panel(spark, sf), "unit", "quarter", "y", "d", label="complexity"))
