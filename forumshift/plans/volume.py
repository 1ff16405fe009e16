"""Question-volume panels over the orders analogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import panel as P
from ..session import cut_lineage
from .fixtures import (ORDERS_EVENT_DATE, ORDERS_TREATED_FORUM, ORDERS_TRIM, fixture,
                       with_views)
from .registry import register, rounded

# The five forums of the orders analogue (o_orderpriority), in key order.
ORDERS_FORUMS = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


def orders_posts(spark: SparkSession, sf: str) -> DataFrame:
    return fixture(spark, sf, "posts_orders").withColumnRenamed("grp", "group")


def orders_panel(spark: SparkSession, sf: str, week_key: str = "mixed",
                 means: dict | None = None) -> DataFrame:
    """Posts -> weekly cells -> treated flag -> log / index transforms."""
    panel = P.weekly_panel(orders_posts(spark, sf), keys=("forum", "group"),
                           week_key=week_key, trim=ORDERS_TRIM, means=means)
    panel = P.mark_treated(panel, ORDERS_TREATED_FORUM)
    return P.transform_panel(panel)


def stored_panel(spark: SparkSession, sf: str, **kw) -> DataFrame:
    """The panel (units x weeks rows) in the shared folder, for queries that read it more
    than once: the facts are scanned once."""
    return cut_lineage(orders_panel(spark, sf, **kw))


# ---------------------------------------------------------------- oracle SQL
def _panel_sql(week_key: str = "mixed", extra_select: str = "") -> str:
    year = "year(CreationDate)" if week_key == "mixed" else "isoyear(CreationDate)"
    lo, hi = ORDERS_TRIM
    return f"""
cells AS (
  SELECT CAST({year} * 100 + week(CreationDate) AS INTEGER) AS yearweek,
         CAST({year} AS INTEGER) AS year, CAST(week(CreationDate) AS INTEGER) AS week,
         forum, grp AS "group", count(*) AS question_count,
         min(CAST(CreationDate AS DATE)) AS week_start{extra_select}
  FROM posts_orders GROUP BY 1, 2, 3, 4, 5),
panel AS (
  SELECT *, CAST(forum = '{ORDERS_TREATED_FORUM}' AS INTEGER) AS treated,
         ln(1 + CAST(question_count AS DOUBLE)) AS log_question_count,
         100.0::DOUBLE * question_count / first_value(question_count) OVER (
             PARTITION BY "group" ORDER BY week_start, yearweek) AS indexed_count
  FROM cells WHERE week_start > DATE '{lo}' AND week_start <= DATE '{hi}')"""


def _panel_cols(prefix: str = "") -> str:
    return (f'{prefix}yearweek, {prefix}year, {prefix}week, {prefix}forum, {prefix}"group", '
            f'{prefix}question_count, {prefix}week_start, {prefix}treated, '
            f'round({prefix}log_question_count, 6) AS log_question_count, '
            f'round({prefix}indexed_count, 6) AS indexed_count')


def panel_sql(select: str, week_key: str = "mixed", extra_select: str = "") -> str:
    return with_views("", "posts_orders") + "," + _panel_sql(week_key, extra_select) + "\n" + select


# ------------------------------------------------------------------ queries
@register("weekly_panel", panel_sql(f"SELECT {_panel_cols()} FROM panel"))
def q_weekly_panel(spark, sf):
    """Weekly question counts per (forum, group), mixed week key."""
    return rounded(orders_panel(spark, sf))


@register("weekly_panel_iso", panel_sql(f"SELECT {_panel_cols()} FROM panel", week_key="iso"))
def q_weekly_panel_iso(spark, sf):
    """Same panel with the true ISO week-year key."""
    return rounded(orders_panel(spark, sf, week_key="iso"))


@register("weekly_panel_means", panel_sql(
    f"SELECT {_panel_cols()}, round(avg_score, 6) AS avg_score FROM panel",
    extra_select=", avg(Score) AS avg_score"))
def q_weekly_panel_means(spark, sf):
    """A3: optional cell means (mean Score) next to the counts."""
    return rounded(orders_panel(spark, sf, means={"avg_score": "Score"}))


@register("treatment_flags", panel_sql(f"""
SELECT {_panel_cols()},
       CAST(week_start > DATE '{ORDERS_EVENT_DATE}' AS INTEGER) AS treatment,
       CAST(week_start > DATE '{ORDERS_EVENT_DATE}' AND forum = '{ORDERS_TREATED_FORUM}' AS INTEGER)
           AS treatment_synthdid,
       CAST(dense_rank() OVER (ORDER BY week_start) - 1 AS INTEGER) AS week_index
FROM panel"""))
def q_treatment_flags(spark, sf):
    """P9 + W2: treatment flags and the dense week index of the regression panel."""
    p = P.treatment_flags(stored_panel(spark, sf), ORDERS_EVENT_DATE, ORDERS_TREATED_FORUM)
    return rounded(P.week_index(p))


@register("week_index_calendar", panel_sql("""
SELECT forum, "group", yearweek, week_start,
       CAST(dense_rank() OVER (ORDER BY date_trunc('week', week_start)) - 1 AS INTEGER) AS week_index
FROM panel"""))
def q_week_index_calendar(spark, sf):
    """W2, calendar mode: rank of the Monday of week_start (aligns sparse panels)."""
    p = stored_panel(spark, sf).select("forum", "group", "yearweek", "week_start")
    return P.week_index(p, by="calendar")


def _month_keys():
    lo, hi = ORDERS_TRIM
    y0, m0 = int(lo[:4]), int(lo[5:7])
    y1, m1 = int(hi[:4]), int(hi[5:7])
    keys = []
    y, m = y0, m0
    while (y, m) <= (y1, m1):
        keys.append(y * 100 + m)
        y, m = (y + 1, 1) if m == 12 else (y, m + 1)
    return keys


def _quarter_keys():
    return sorted({(k // 100) * 10 + ((k % 100) - 1) // 3 + 1 for k in _month_keys()})


_MONTH_COLS = ", ".join(
    f"CAST(year(week_start) * 100 + month(week_start) = {k} AS INTEGER) AS year_month_{k}"
    for k in _month_keys()[1:])
_QUARTER_COLS = ", ".join(
    f"CAST(year(week_start) * 10 + quarter(week_start) = {k} AS INTEGER) AS year_quarter_{k}"
    for k in _quarter_keys()[1:])


@register("month_dummies", panel_sql(
    f'SELECT forum, "group", yearweek, week_start, {_MONTH_COLS} FROM panel'))
def q_month_dummies(spark, sf):
    """year_month dummies of the panel, first month dropped."""
    p = stored_panel(spark, sf).select("forum", "group", "yearweek", "week_start")
    return P.month_dummies(p)


@register("quarter_dummies", panel_sql(
    f'SELECT forum, "group", yearweek, week_start, {_QUARTER_COLS} FROM panel'))
def q_quarter_dummies(spark, sf):
    """year_quarter dummies of the panel, first quarter dropped."""
    p = stored_panel(spark, sf).select("forum", "group", "yearweek", "week_start")
    return P.quarter_dummies(p)


_PIVOT_VALUES = ("question_count", "log_question_count", "indexed_count")
_PIVOT_COLS = ", ".join(
    (f'CAST(sum(CASE WHEN forum = \'{f}\' THEN {v} END) AS BIGINT) AS "{v}_{f}"' if v == "question_count" else
     f'round(sum(CASE WHEN forum = \'{f}\' THEN {v} END), 6) AS "{v}_{f}"')
    for f in ORDERS_FORUMS for v in _PIVOT_VALUES)


@register("pivot_log_counts", panel_sql(
    f"SELECT week_start, {_PIVOT_COLS} FROM panel GROUP BY week_start"))
def q_pivot_log_counts(spark, sf):
    """A11 + R5: sums by (week_start, forum) spread into one column per forum and value."""
    p = stored_panel(spark, sf)
    return rounded(P.pivot_wide(p, "week_start", "forum", _PIVOT_VALUES, ORDERS_FORUMS))


@register("encode_group", panel_sql(
    'SELECT forum, "group", yearweek, CAST(dense_rank() OVER (ORDER BY "group") AS INTEGER) '
    'AS group_id FROM panel'))
def q_encode_group(spark, sf):
    """1-based label encoding of the panel unit."""
    p = stored_panel(spark, sf).select("forum", "group", "yearweek")
    return P.encode_labels(p, "group", "group_id")


@register("panel_check", panel_sql("""
SELECT "group", n_rows, n_times, n_periods, n_rows - n_times AS n_duplicates,
       n_periods - n_times AS n_missing, (n_rows = n_times AND n_periods = n_times) AS balanced
FROM (SELECT "group", count(*) AS n_rows, count(DISTINCT yearweek) AS n_times
      FROM panel GROUP BY "group") u
CROSS JOIN (SELECT count(DISTINCT yearweek) AS n_periods FROM panel) t"""))
def q_panel_check(spark, sf):
    """Panel declaration check (duplicates and gaps per unit)."""
    return P.panel_check(stored_panel(spark, sf), "group", "yearweek")


@register("diagonal_union", panel_sql(f"""
SELECT yearweek, forum, "group", question_count, week_start, round(avg_score, 6) AS avg_score
FROM panel WHERE forum = '{ORDERS_TREATED_FORUM}'
UNION ALL BY NAME
SELECT yearweek, forum, "group", CAST(question_count AS INTEGER) AS question_count, week_start,
       CAST(treated AS INTEGER) AS treated
FROM panel WHERE forum <> '{ORDERS_TREATED_FORUM}'""", extra_select=", avg(Score) AS avg_score"))
def q_diagonal_union(spark, sf):
    """Union by name of frames with different columns; int count widened to bigint."""
    p = stored_panel(spark, sf, means={"avg_score": "Score"})
    a = p.where(F.col("forum") == ORDERS_TREATED_FORUM).select(
        "yearweek", "forum", "group", "question_count", "week_start", "avg_score")
    b = p.where(F.col("forum") != ORDERS_TREATED_FORUM).select(
        "yearweek", "forum", "group", F.col("question_count").cast("int").alias("question_count"),
        "week_start", "treated")
    return rounded(P.union_relaxed([a, b]))


_ORDER_CASE = " ".join(f"WHEN '{f}' THEN {i}" for i, f in enumerate(ORDERS_FORUMS))


@register("forum_order", panel_sql(
    f'SELECT forum, "group", yearweek, CASE forum {_ORDER_CASE} END AS forum_order FROM panel'))
def q_forum_order(spark, sf):
    """Value remap by a small dictionary (display order of the forums)."""
    p = orders_panel(spark, sf).select("forum", "group", "yearweek")
    return P.remap(p, "forum", {f: i for i, f in enumerate(ORDERS_FORUMS)}, "forum_order")


@register("week_map", panel_sql(
    "SELECT DISTINCT CAST(dense_rank() OVER (ORDER BY week_start) - 1 AS INTEGER) AS week_index, "
    "week_start FROM panel"))
def q_week_map(spark, sf):
    """Distinct mapping week index <-> week start."""
    p = P.week_index(stored_panel(spark, sf))
    return p.select("week_index", "week_start").dropDuplicates()


@register("first_week_count", panel_sql(
    'SELECT "group", arg_min(question_count, (week_start, yearweek)) AS question_count, '
    'min(week_start) AS week_start FROM panel GROUP BY "group"'))
def q_first_week_count(spark, sf):
    """O3: first row per group by week start (the index base of W1)."""
    p = orders_panel(spark, sf)
    return p.groupBy("group").agg(
        F.min_by("question_count", F.struct("week_start", "yearweek")).alias("question_count"),
        F.min("week_start").alias("week_start"))
