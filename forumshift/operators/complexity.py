"""Question complexity: z-scores, composite score, weekly means, arm means (A4-A10).

Z-scores need global (or per-frame) statistics.  They come from one aggregate
(one row per frame) joined back to the rows: no unpartitioned window ever sorts the
facts into one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .panel import period_split, weekly_panel

# The four length metrics of the composite score and their output names.
METRICS = (("tag_count", "norm_tag_count"), ("tech_expr_length", "norm_tech_expr_length"),
           ("body_length", "norm_body_length"), ("title_length", "norm_title_length"))


def zscore(df: DataFrame, cols: dict[str, str] | Sequence[tuple[str, str]],
           partition: str | Sequence[str] | None = None) -> DataFrame:
    """``(x - mean) / stddev_samp`` per frame (``partition``) or over the whole frame.

    Zero or undefined variance gives null (no division error under ANSI mode).
    """
    pairs = list(cols.items()) if isinstance(cols, dict) else list(cols)
    keys = [] if partition is None else ([partition] if isinstance(partition, str) else list(partition))
    aggs = []
    for src, _ in pairs:
        x = F.col(src).cast("double")
        aggs += [F.avg(x).alias(f"_mu_{src}"), F.stddev_samp(x).alias(f"_sd_{src}")]
    if keys:
        joined = df.join(df.groupBy(*keys).agg(*aggs), keys, "left")  # AQE decides by measured bytes
    else:
        row = df.agg(*aggs).first()                # exactly one row of scalars
        joined = df.withColumns({k: F.lit(row[k]).cast("double") for k in row.asDict()})
    out = joined.withColumns({
        dst: F.when(F.col(f"_sd_{src}") > 0,
                    (F.col(src).cast("double") - F.col(f"_mu_{src}")) / F.col(f"_sd_{src}"))
        for src, dst in pairs
    })
    return out.drop(*[c for c in out.columns if c.startswith("_mu_") or c.startswith("_sd_")])


def complexity_score(df: DataFrame, cols: Sequence[str] = tuple(d for _, d in METRICS),
                     out: str = "score") -> DataFrame:
    """Equal-weight mean of the z-scored metrics (null if any is null)."""
    total = None
    for c in cols:
        total = F.col(c) if total is None else total + F.col(c)
    return df.withColumn(out, F.lit(1.0 / len(cols)) * total)


def weekly_complexity(df: DataFrame, keys: Sequence[str] = (), date_col: str = "CreationDate",
                      trim: tuple[str, str] | None = None, week_key: str = "mixed") -> DataFrame:
    """Weekly counts and mean z-scores / score by optional keys."""
    means = {f"mean_{d[len('norm_'):]}": d for _, d in METRICS}
    means["mean_score"] = "score"
    return weekly_panel(df, date_col, keys, week_key=week_key, trim=trim, means=means)


def arm_means(panel: DataFrame, event_date: str, value: str = "mean_score",
              arm: str | None = None, date_col: str = "week_start",
              boundary: str = "lt_gt") -> DataFrame:
    """A9/A10 (G15): unweighted pre/post means of the weekly means, one row per arm.

    With the default ``lt_gt`` rule a week starting on the event day is in neither.
    """
    split = period_split(panel, date_col, event_date, boundary, "_period")
    keys = [arm] if arm else []
    v = F.col(value)
    return split.groupBy(*keys).agg(
        F.avg(F.when(F.col("_period") == "pre", v)).alias("pre_mean"),
        F.avg(F.when(F.col("_period") == "post", v)).alias("post_mean"),
        F.count(F.when(F.col("_period") == "pre", v)).alias("pre_weeks"),
        F.count(F.when(F.col("_period") == "post", v)).alias("post_weeks"),
        F.min(date_col).alias("first_week"),
        F.max(date_col).alias("last_week"),
    ).withColumn("diff", F.col("post_mean") - F.col("pre_mean"))
