"""Weekly panels and the transforms applied to them.

The heavy step is the first one: posts -> (week, unit) cells.  It is a single
``groupBy`` with map-side partial aggregation, so the shuffle carries one row
per (task, cell) however many posts there are.  Everything after it works on
the panel (units x weeks rows), which is small by construction.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import week_columns, week_monday, year_month, year_quarter
from ..session import cut_lineage

BOUNDARIES = ("le_gt", "lt_gt", "lt_ge")


def weekly_panel(df: DataFrame, date_col: str = "CreationDate",
                 keys: Sequence[str] = ("forum", "group"),
                 week_key: str = "mixed",
                 trim: tuple[str, str] | None = None,
                 means: dict[str, str] | None = None,
                 count_name: str = "question_count") -> DataFrame:
    """A1/A2/A3/A4-A6 + P10: one row per (yearweek, year, week, *keys).

    ``week_start`` is the earliest observed date of the cell, as in the study
    (not the Monday).  ``means`` maps output name -> input column for optional
    cell means (e.g. ``{"avg_score": "Score"}``); inputs are cast to double.
    ``trim=(lo, hi)`` keeps ``lo < week_start <= hi``.
    """
    means = means or {}
    d = F.to_date(F.col(date_col))
    wk = week_columns(F.col("_date"), week_key)
    base = df.select(*[F.col(k) for k in keys], d.alias("_date"),
                     *[F.col(src).cast("double").alias(f"_m_{name}") for name, src in means.items()])
    base = base.withColumns(wk)
    if trim is not None:
        # Rows that cannot belong to a kept cell are dropped before the aggregation
        # (pushed towards the scan).  Only the upper side is safe: a cell's
        # week_start is its earliest date, so removing early rows would move it.
        # A mixed-key cell can hold 1-2 January and late December of the same
        # year, hence the end of hi's year as bound; an ISO cell ends <= hi + 6 days.
        hi = F.lit(trim[1]).cast("date")
        bound = (F.make_date(F.year(hi), F.lit(12), F.lit(31)) if week_key == "mixed"
                 else F.date_add(hi, 6))
        base = base.where(F.col("_date") <= bound)
    out = base.groupBy("yearweek", "year", "week", *keys).agg(
        F.count(F.lit(1)).alias(count_name),
        F.min("_date").alias("week_start"),
        *[F.avg(f"_m_{name}").alias(name) for name in means],
    )
    if trim is not None:
        out = out.filter(trim_predicate("week_start", trim))
    return out


def trim_predicate(col: str, trim: tuple[str, str]):
    lo, hi = trim
    return (F.col(col) > F.lit(lo).cast("date")) & (F.col(col) <= F.lit(hi).cast("date"))


def mark_treated(df: DataFrame, treated_forum: str, forum_col: str = "forum",
                 name: str = "treated") -> DataFrame:
    """1 for the treated forum, else 0."""
    return df.withColumn(name, (F.col(forum_col) == F.lit(treated_forum)).cast("int"))


def transform_panel(df: DataFrame, group_col: str = "group", value: str = "question_count",
                    order: str = "week_start") -> DataFrame:
    """W1 + W4: ``log_<value>`` = log(1+x); ``indexed_count`` = 100 * x / first x of the group.

    The first value comes from one window partitioned by group over the small panel,
    not from a driver loop per group.
    """
    w = Window.partitionBy(group_col).orderBy(F.col(order), F.col("yearweek"))
    first = F.first(F.col(value)).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return df.withColumns({
        f"log_{value}": F.log1p(F.col(value).cast("double")),
        "indexed_count": F.lit(100.0) * F.col(value).cast("double") / first.cast("double"),
    })


def week_index(df: DataFrame, by: str = "week_start", name: str = "week_index") -> DataFrame:
    """Dense rank of the week over the whole panel, minus one.

    Only the distinct week table is ranked (one row per week, bounded by the calendar
    span), then joined back, so the facts are never sorted in a single partition.
    ``by="calendar"`` ranks the Monday of ``week_start`` (aligns sparse panels).
    """
    if by == "week_start":
        key = F.col("week_start")
    elif by == "calendar":
        key = week_monday("week_start")
    else:
        raise ValueError("by must be 'week_start' or 'calendar'")
    keyed = df.withColumn("_wk", key)
    weeks = keyed.select("_wk").distinct()
    ranked = weeks.withColumn(name, (F.dense_rank().over(Window.orderBy("_wk")) - 1).cast("int"))
    return keyed.join(ranked, "_wk").drop("_wk")


def treatment_flags(df: DataFrame, event_date: str, treated_forum: str,
                    date_col: str = "week_start", forum_col: str = "forum") -> DataFrame:
    """``treatment`` (after the event), ``treatment_synthdid`` (after and treated)."""
    after = F.col(date_col) > F.lit(event_date).cast("date")
    treated = F.col(forum_col) == F.lit(treated_forum)
    return df.withColumns({
        "treatment": after.cast("int"),
        "treatment_synthdid": (after & treated).cast("int"),
    })


def period_split(df: DataFrame, date_col: str, event_date: str, boundary: str = "le_gt",
                 name: str = "period") -> DataFrame:
    """P11: 'pre' / 'post' / null with the three boundary rules of the study.

    ``le_gt``: pre <= event < post.  ``lt_gt``: the event day is in neither.
    ``lt_ge``: pre < event <= post.  Null dates are in neither period.
    """
    if boundary not in BOUNDARIES:
        raise ValueError(f"boundary must be one of {BOUNDARIES}")
    d = F.col(date_col)
    e = F.lit(event_date).cast("date") if len(event_date) <= 10 else F.lit(event_date).cast("timestamp_ntz")
    pre = {"le_gt": d <= e, "lt_gt": d < e, "lt_ge": d < e}[boundary]
    post = {"le_gt": d > e, "lt_gt": d > e, "lt_ge": d >= e}[boundary]
    return df.withColumn(name, F.when(pre, F.lit("pre")).when(post, F.lit("post")))


def dummies(df: DataFrame, key, prefix: str, drop_first: bool = True) -> DataFrame:
    """One 0/1 column per key value, named ``<prefix>_<value>``; smallest key dropped.

    The key list is the distinct months/quarters of the panel (bounded by the calendar),
    collected once to build the column expressions.
    """
    key_col = F.col(key) if isinstance(key, str) else key
    keyed = df.withColumn(f"_{prefix}", key_col)
    values = _labels(keyed, f"_{prefix}")
    if drop_first:
        values = values[1:]
    return keyed.withColumns({
        f"{prefix}_{v}": (F.col(f"_{prefix}") == F.lit(v)).cast("int") for v in values
    }).drop(f"_{prefix}")


def month_dummies(df: DataFrame, date_col: str = "week_start") -> DataFrame:
    return dummies(df, year_month(date_col), "year_month")


def quarter_dummies(df: DataFrame, date_col: str = "week_start") -> DataFrame:
    return dummies(df, year_quarter(date_col), "year_quarter")


def pivot_wide(df: DataFrame, index: str, on: str, values: Sequence[str],
               on_values: Iterable[str] | None = None, agg: str = "sum") -> DataFrame:
    """R5 (+A11): sum the value columns by (index, on) and spread ``on`` into
    ``<value>_<on value>`` columns.  Explicit ``on_values`` fix the columns; a value that is
    not among them is an error, never left out."""
    seen = _labels(df, on)
    on_values = list(on_values) if on_values is not None else seen
    lost = sorted(set(seen) - set(on_values))
    if lost:
        raise ValueError(f"{on} has values without a column: {lost[:5]}")
    aggf = getattr(F, agg)
    wide = df.groupBy(index).pivot(on, on_values).agg(*[aggf(v).alias(v) for v in values])
    renames = {}
    for ov in on_values:
        for v in values:
            src = f"{ov}_{v}" if len(values) > 1 else str(ov)
            renames[src] = f"{v}_{ov}"
    return wide.withColumnsRenamed(renames)


def encode_labels(df: DataFrame, col: str, name: str | None = None) -> DataFrame:
    """1-based code of the sorted distinct labels, joined back.

    Labels are dealt in ranges; a label's code is its place in its range plus the labels in
    the ranges before it (one row per range), so no task sorts them all.
    """
    name = name or f"{col}_id"
    labels = df.select(col).where(F.col(col).isNotNull()).distinct()
    ranged = cut_lineage(labels.repartitionByRange(F.col(col)).withColumn("_range", F.spark_partition_id()))
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(col))
    coded = ranged.join(starts, "_range").select(col, (F.col("_start") + inside).cast("int").alias(name))
    return df.join(coded, col, "left")


def panel_check(df: DataFrame, unit: str, time: str) -> DataFrame:
    """Per unit, cells, distinct periods, duplicate keys and missing periods."""
    df = cut_lineage(df.select(unit, time))
    n_periods = df.agg(F.countDistinct(time)).first()[0]    # one scalar
    per_unit = df.groupBy(unit).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.countDistinct(time).alias("n_times"),
    )
    return (per_unit.withColumn("n_periods", F.lit(n_periods).cast("long"))
            .withColumns({
                "n_duplicates": F.col("n_rows") - F.col("n_times"),
                "n_missing": F.col("n_periods") - F.col("n_times"),
            })
            .withColumn("balanced", (F.col("n_duplicates") == 0) & (F.col("n_missing") == 0)))


def union_relaxed(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by name, missing columns as null, numeric types widened first."""
    from pyspark.sql import types as T

    order = [T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType]
    widest: dict[str, object] = {}
    for f in frames:
        for fld in f.schema.fields:
            prev = widest.get(fld.name)
            if prev is None:
                widest[fld.name] = fld.dataType
            elif type(prev) in order and type(fld.dataType) in order:
                if order.index(type(fld.dataType)) > order.index(type(prev)):
                    widest[fld.name] = fld.dataType
            elif type(prev) is not type(fld.dataType):
                widest[fld.name] = T.StringType()
    cast = [f.select(*[F.col(c).cast(widest[c]).alias(c) for c in f.columns]) for f in frames]
    out = cast[0]
    for f in cast[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def coalesce_group(df: DataFrame, primary: str = "Lang", fallback: str = "forum",
                   out: str = "group") -> DataFrame:
    """The sub-group when present (languages of the treated forum), else the forum."""
    return df.withColumn(out, F.coalesce(F.col(primary), F.col(fallback)))


def remap(df: DataFrame, col: str, mapping: dict, out: str | None = None) -> DataFrame:
    """Replace values found in a small driver dictionary; others are kept."""
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    vtype = type(next(iter(mapping.values())))
    looked = F.try_element_at(m, F.col(col))
    if vtype is str:
        return df.withColumn(out or col, F.coalesce(looked, F.col(col)))
    return df.withColumn(out or col, looked)


def complete_counts(df: DataFrame, unit: str, time: str, count: str) -> DataFrame:
    """R7 ``balance="zero"``: every (unit, time) cell of a count panel, absent cells counted
    0 (no posts that week).  Units and times are those observed; the times (bounded by the
    calendar) are exploded per unit and the counts joined on, no cross join."""
    df = cut_lineage(df.groupBy(unit, time).agg(F.sum(count).cast("long").alias(count)))
    times = df.agg(F.sort_array(F.collect_set(time))).first()[0]     # one row
    if not times:
        return df
    cells = df.select(unit).distinct().withColumn(time, F.explode(F.array(*[F.lit(t) for t in times])))
    return cells.join(df, [unit, time], "left").withColumn(count, F.coalesce(F.col(count), F.lit(0).cast("long")))


def _labels(df: DataFrame, col: str) -> list:
    """Distinct values of a column that becomes columns; more than Spark's own limit for
    pivots (``spark.sql.pivotMaxValues``) is an error."""
    most = int(df.sparkSession.conf.get("spark.sql.pivotMaxValues"))
    values = [r[0] for r in df.select(col).distinct().limit(most + 1).collect()]
    if len(values) > most:
        raise ValueError(f"{col} has more than {most} values: it cannot become columns")
    return sorted(v for v in values if v is not None)
