"""Statistical tests as data jobs (H1-H9).

Term tests work on the long TF-IDF table restricted to the tested terms; zeros
are never materialised (they enter through the period document counts).
Uniforms of resampling replicates come from an md5 of ``seed:rep:doc`` so every engine
draws the same numbers.  The tested values are written once with all terms of a document in
one row; a task draws once for a document and replicate, whatever the number of terms, and
hands on sums for each replicate.  No row is copied for a replicate, and nothing but the
replicate table (``n_perm`` / ``n_boot`` rows, a parameter) goes from the driver to the tasks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.digests import md5_heads
from ..functions.normal import two_sided_sql
from ..functions.student import two_sided_spark
from ..session import cut_lineage
from .terms import TfidfResult, doc_values, term_values

TWO52 = float(2 ** 52)
TIE_DIGITS = 10
RANK_GRID = 64                 # buckets per doubling of the value
ZERO_BUCKET = -(10 ** 9)


def uniform(seed: int, rep, doc) -> Column:
    """U(0,1) from the first 52 bits of md5('seed:rep:doc') (bit-identical in DuckDB)."""
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), rep.cast("string"), doc.cast("string")))
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("double") / F.lit(TWO52)


def poisson1_cdf() -> list[float]:
    """Cumulative Poisson(1) probabilities up to the first that is 1.0 in double precision,
    beyond which no uniform below 1 lies (built by rule, not typed in)."""
    out, acc, k = [], 0.0, 0
    while acc < 1.0 and (not out or 1.0 / math.factorial(k) > 0):
        acc = math.fsum(math.exp(-1.0) / math.factorial(i) for i in range(k + 1))
        out.append(acc)
        k += 1
    return out


def poisson1_weight(u: Column) -> Column:
    """Inverse-CDF Poisson(1) draw: the bootstrap multiplicity of a document."""
    expr = None
    cdf = poisson1_cdf()
    for k, c in enumerate(cdf):
        expr = F.when(u < F.lit(c), F.lit(k)) if expr is None else expr.when(u < F.lit(c), F.lit(k))
    return expr.otherwise(F.lit(len(cdf)))


def period_counts(res: TfidfResult, period: str = "pre") -> DataFrame:
    """One row: documents per period (n_pre, n_post)."""
    return res.docs.agg(F.sum(F.when(F.col(period) == 1, 1).otherwise(0)).alias("n_pre"),
                        F.sum(F.when(F.col(period) == 0, 1).otherwise(0)).alias("n_post"))


def observed(res: TfidfResult, terms: Sequence[str], period: str = "pre") -> DataFrame:
    """H1: pre/post means (zeros included), difference and percent change per term."""
    vals = term_values(res, terms)
    spark = res.docs.sparkSession
    tdf = spark.createDataFrame([(t,) for t in dict.fromkeys(terms)], "term string")
    sums = vals.groupBy("term").agg(
        F.sum(F.when(F.col(period) == 1, F.col("tfidf")).otherwise(0.0)).alias("s_pre"),
        F.sum(F.when(F.col(period) == 0, F.col("tfidf")).otherwise(0.0)).alias("s_post"),
        F.count(F.when(F.col(period) == 1, 1)).alias("nnz_pre"),
        F.count(F.when(F.col(period) == 0, 1)).alias("nnz_post"))
    c = period_counts(res, period).first()                               # one row
    t = (tdf.join(sums, "term", "left").na.fill(0, ["s_pre", "s_post", "nnz_pre", "nnz_post"])
         .withColumns({"n_pre": F.lit(c["n_pre"] or 0).cast("long"),
                       "n_post": F.lit(c["n_post"] or 0).cast("long")}))
    pre = F.try_divide("s_pre", "n_pre")
    post = F.try_divide("s_post", "n_post")
    return t.withColumns({"pre_mean": pre, "post_mean": post, "difference": post - pre,
                          "percent_change": F.when(pre > 0, (post - pre) / pre * 100.0)})


def mann_whitney(res: TfidfResult, terms: Sequence[str], period: str = "pre") -> DataFrame:
    """H2: two-sided Mann-Whitney U (post vs pre), tie- and continuity-corrected normal p.

    Ties collapse into (term, value) blocks; all zeros of a term form one block.
    Ranks are cumulative block sizes over a window partitioned by term, running
    over the block table (distinct values), not over documents.
    """
    vals = term_values(res, terms)
    obs = observed(res, terms, period)
    # Ties are decided at TIE_DIGITS significant digits, so summation-order noise cannot split
    # a tie block and a small value never becomes a zero.
    digits = F.lit(TIE_DIGITS) - F.ceil(F.log10("tfidf"))
    tied = F.when(F.col("tfidf") > 0, F.round(F.col("tfidf") * F.pow(F.lit(10.0), digits)) / F.pow(F.lit(10.0), digits)).otherwise(F.col("tfidf"))
    blocks = vals.groupBy("term", tied.alias("value")).agg(
        F.count(F.when(F.col(period) == 0, 1)).alias("c_post"),
        F.count(F.when(F.col(period) == 1, 1)).alias("c_pre"))
    zeros = obs.select("term", F.lit(0.0).alias("value"),
                       (F.col("n_post") - F.col("nnz_post")).alias("c_post"),
                       (F.col("n_pre") - F.col("nnz_pre")).alias("c_pre"))
    allb = blocks.unionByName(zeros).where((F.col("c_post") + F.col("c_pre")) > 0) \
        .withColumn("t", (F.col("c_post") + F.col("c_pre")).cast("double"))
    # Exact ranks without one task per term: values fall into log-scale buckets
    # (monotone in the value, ~1 % wide); bucket offsets are a prefix sum over the
    # small (term, bucket) table, and each (term, bucket) runs its own window.
    allb = allb.withColumn("bucket", F.when(F.col("value") > 0, F.floor(F.log2("value") * RANK_GRID))
                           .otherwise(F.lit(ZERO_BUCKET)).cast("long"))
    before_bucket = Window.partitionBy("term").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (allb.groupBy("term", "bucket").agg(F.sum("t").alias("bt"))
               .withColumn("offset", F.coalesce(F.sum("bt").over(before_bucket), F.lit(0.0)))
               .drop("bt"))
    within = Window.partitionBy("term", "bucket").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    ranked = allb.join(offsets, ["term", "bucket"]).withColumn(
        "rank", F.col("offset") + F.coalesce(F.sum("t").over(within), F.lit(0.0)) + (F.col("t") + 1) / 2)
    per = ranked.groupBy("term").agg(F.sum(F.col("c_post") * F.col("rank")).alias("r1"),
                                     F.sum(F.col("t") ** 3 - F.col("t")).alias("ties"))
    j = per.join(obs.select("term", "n_pre", "n_post"), "term")
    n1 = F.col("n_post").cast("double")
    n2 = F.col("n_pre").cast("double")
    n = n1 + n2
    u = F.col("r1") - n1 * (n1 + 1) / 2
    var = n1 * n2 / 12 * ((n + 1) - F.col("ties") / (n * (n - 1)))
    z = F.when(var > 0, (F.abs(u - n1 * n2 / 2) - 0.5) / F.sqrt(var))
    out = j.select("term", u.alias("mw_u"), z.alias("mw_z"))
    return out.withColumn("mw_pvalue", F.least(F.lit(1.0), F.expr(two_sided_sql("mw_z"))))


def with_replicates(df: DataFrame, n: int) -> DataFrame:
    """Every row once per replicate id 0..n-1 (a generator, not a join)."""
    return df.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


#: documents that a task draws for at a time, and that a task of the replicates takes
CHUNK_DOCS = 256
TASK_DOCS = 50_000


@dataclass
class TestedValues(TfidfResult):
    """A result narrowed to the tested terms and written once: ``rows`` (doc, period, n, at, value)."""

    rows: DataFrame | None = None
    terms: tuple[str, ...] = ()


def tested_values(res: TfidfResult, terms: Sequence[str], doc: str, period: str) -> TestedValues:
    """Only the values of ``terms``, dealt evenly; later passes read no other term."""
    terms = tuple(dict.fromkeys(terms))
    if isinstance(res, TestedValues) and res.terms == terms:
        return res
    spark = res.docs.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, math.ceil(res.docs.count() / TASK_DOCS))
    rows = cut_lineage(doc_values(res, list(terms), doc, period).repartition(parts))
    name = F.element_at(F.array(*[F.lit(t) for t in terms]), F.col("x.at") + 1) if terms else F.lit(None).cast("string")
    long = (rows.select(doc, period, F.explode(F.arrays_zip("at", "value")).alias("x"))
            .select(doc, period, name.alias("term"), F.col("x.value").alias("tfidf")))
    return TestedValues(vocab=res.vocab, long=long, docs=rows.where("n > 0").select(doc, period), rows=rows, terms=terms)


def draws(keys: Sequence[str | None], seed: int, n: int) -> np.ndarray:
    """``uniform`` times 2^52 as integers: a row for each key, a column for each replicate."""
    tails = [b"" if key is None else f":{key}".encode() for key in keys]
    return (md5_heads([f"{seed}:{r}".encode() for r in range(n)], tails) >> np.uint64(12)).astype(np.int64)


def _drawn(batches: Iterator[pa.RecordBatch], seed: int, n: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Chunks of rows with the draws of their documents."""
    for batch in batches:
        for at in range(0, batch.num_rows, CHUNK_DOCS):
            part = batch.slice(at, CHUNK_DOCS)
            yield part, draws(part.column("key").to_pylist(), seed, n)


def _dense(part: pa.RecordBatch, width: int) -> np.ndarray:
    """A row for each document: its values by term, then the documents that it counts as."""
    out = np.zeros((part.num_rows, width + 1))
    at, value = part.column("at"), part.column("value")
    row = np.repeat(np.arange(part.num_rows), np.nan_to_num(np.array(at.value_lengths().to_pylist(), float)).astype(int))
    out[row, at.flatten().to_numpy(zero_copy_only=False)] = value.flatten().to_numpy(zero_copy_only=False)
    out[:, width] = part.column("n").to_numpy(zero_copy_only=False)
    return out


def replicate_sums(res: TestedValues, n: int, seed: int, weigh: Callable[[np.ndarray, pa.Array], np.ndarray],
                   doc: str, period: str, by_period: bool = False) -> tuple[DataFrame, DataFrame]:
    """Weighted sums for each replicate: of the values, ``(rep, arm, term, s)``, and of the
    documents, ``(rep, arm, s)``.  ``weigh`` gives a weight for each document and replicate from
    the draws.  ``arm`` is 1 and 0 for the periods if asked for, else 1 for all documents."""
    width = len(res.terms)
    arm = F.when(F.col(period) == 1, 1).when(F.col(period) == 0, 0) if by_period else F.lit(1)
    rows = res.rows.select(F.col(doc).alias("doc"), F.col(doc).cast("string").alias("key"), arm.alias("arm"), "n", "at", "value").where("arm IS NOT NULL")

    def run(batches):
        total = {}
        for part, u in _drawn(batches, seed, n):
            w, values = weigh(u, part.column("doc")), _dense(part, width)
            arms = part.column("arm").to_numpy(zero_copy_only=False)
            for a in np.unique(arms):
                mine = arms == a
                s = w[mine].astype(float).T @ values[mine]
                total[int(a)] = s if int(a) not in total else total[int(a)] + s
        for a, s in total.items():
            yield pa.RecordBatch.from_pydict({"rep": pa.array(range(n), pa.int32()), "arm": pa.array([a] * n, pa.int32()),
                                              "sums": pa.array(list(s), pa.list_(pa.float64()))})

    sums = (rows.mapInArrow(run, "rep int, arm int, sums array<double>").select("rep", "arm", F.posexplode("sums").alias("at", "s"))
            .groupBy("rep", "arm", "at").agg(F.sum("s").alias("s")))
    sums = cut_lineage(sums)  # replicates x terms
    names = res.docs.sparkSession.createDataFrame([(i, t) for i, t in enumerate(res.terms)], "at int, term string")
    return sums.join(F.broadcast(names), "at").select("rep", "arm", "term", "s"), sums.where(F.col("at") == width).select("rep", "arm", "s")


# Tolerance for "at least as extreme" (a permuted statistic equal to the
# observed one must count whatever the summation order), relative and absolute.
PERM_RTOL = 1e-9
PERM_ATOL = 1e-15


def _at_least_as_extreme(perm, obs):
    return F.abs(perm) >= F.abs(obs) - (F.lit(PERM_RTOL) * F.abs(obs) + F.lit(PERM_ATOL))


def permutation_test(res: TfidfResult, terms: Sequence[str], n_perm: int = 1000, seed: int = 0,
                     doc: str = "doc_id", period: str = "pre") -> DataFrame:
    """H3 (Bernoulli labels): p = share of replicates with |perm diff| >= |observed|.

    Each document is labelled 'pre' in replicate r when its uniform is below
    n_pre / N; the label is shared by all terms.  Denominators are per replicate.
    Work: a draw for each document and replicate, and sums of its values.
    """
    res = tested_values(res, terms, doc, period)
    obs = observed(res, terms, period)
    c = period_counts(res, period).first()
    n_all = (c["n_pre"] or 0) + (c["n_post"] or 0)
    frac = (c["n_pre"] or 0) / n_all if n_all else 0.0
    num, den = replicate_sums(res, n_perm, seed, lambda u, _: u / TWO52 < frac, doc, period)
    den = den.select("rep", F.col("s").alias("m_pre"), F.lit(float(res.docs.count())).alias("m_all"))
    # terms without a value have no statistic
    num = num.join(F.broadcast(res.long.select("term").distinct()), "term", "left_semi").select("term", "rep", F.col("s").alias("sp"))
    j = (num.join(den, "rep")
         .join(obs.select("term", "s_pre", "s_post", "difference"), "term"))
    total = F.col("s_pre") + F.col("s_post")
    diff = F.try_divide(total - F.col("sp"), F.col("m_all") - F.col("m_pre")) - F.try_divide("sp", "m_pre")
    return j.groupBy("term").agg(
        F.avg(F.when(_at_least_as_extreme(diff, F.col("difference")), 1.0).otherwise(0.0))
        .alias("perm_pvalue"))


def exact_thresholds(res: TfidfResult, n_perm: int, seed: int, doc: str = "doc_id",
                     period: str = "pre") -> DataFrame:
    """Per replicate, the n_pre-th smallest (uniform, doc) pair - the cut that
    labels exactly n_pre documents 'pre' (an exact permutation of the labels).

    Distributed selection in one pass over documents x replicates: the cut lies close to
    n_pre / N, so tasks count the uniforms below a band around it and hand on only the
    (uniform, doc) pairs inside; the cut is a rank in the band.  If a replicate's cut is
    outside, the band is widened and the pass repeated - nothing is cut off.
    """
    res = tested_values(res, (), doc, period) if not isinstance(res, TestedValues) else res
    spark, kind = res.docs.sparkSession, res.docs.schema[doc].dataType
    schema = T.StructType([T.StructField("rep", T.IntegerType()), T.StructField("u_cut", T.DoubleType()), T.StructField("doc_cut", kind)])
    c = period_counts(res, period).first()
    k, n = int(c["n_pre"] or 0), int((c["n_pre"] or 0) + (c["n_post"] or 0))
    if k == 0:
        return spark.createDataFrame([], schema)
    docs = res.docs.select(F.col(doc).alias("doc"), F.col(doc).cast("string").alias("key"))
    share = k / n
    half = 6.0 * math.sqrt(share * (1 - share) / n) + 2.0 / n
    while True:
        lo, hi = int(max(0.0, share - half) * TWO52), int(min(1.0, share + half) * TWO52)
        pairs = docs.mapInArrow(_banded(lo, hi, seed, n_perm), T.StructType([*schema[:1], T.StructField("h", T.LongType()), T.StructField("d", kind), T.StructField("n", T.LongType())]))
        upto = F.sum("n").over(Window.partitionBy("rep").orderBy("h", "d").rowsBetween(Window.unboundedPreceding, 0))
        cuts = (pairs.withColumn("upto", upto).where((F.col("upto") >= k) & (F.col("upto") - F.col("n") < k) & (F.col("h") >= 0))
                .select("rep", "h", "d").collect())  # one row for each replicate
        if len(cuts) == n_perm or (lo == 0 and hi == int(TWO52)):
            return spark.createDataFrame([(r["rep"], r["h"] / TWO52, r["d"]) for r in cuts], schema)
        half *= 4


def _banded(lo: int, hi: int, seed: int, n: int):
    """Pairs with a draw from ``lo`` to ``hi`` for each replicate, and as one row (h -1) the number of those below."""
    def run(batches):
        below = np.zeros(n, np.int64)
        for part, u in _drawn(batches, seed, n):
            below += (u < lo).sum(axis=0)
            row, rep = np.nonzero((u >= lo) & (u < hi))
            yield pa.RecordBatch.from_pydict({"rep": pa.array(rep, pa.int32()), "h": pa.array(u[row, rep]),
                                              "d": part.column("doc").take(pa.array(row)), "n": pa.array(np.ones(len(row), np.int64))})
        if below.any():
            yield pa.RecordBatch.from_pydict({"rep": pa.array(range(n), pa.int32()), "h": pa.array([-1] * n, pa.int64()),
                                              "d": pa.nulls(n, part.column("doc").type), "n": pa.array(below)})
    return run


def permutation_test_exact(res: TfidfResult, terms: Sequence[str], n_perm: int = 1000,
                           seed: int = 0, doc: str = "doc_id", period: str = "pre") -> DataFrame:
    """H3 exact: each replicate labels exactly n_pre documents 'pre' (the smallest
    md5 uniforms), as a shuffle of the labels does; denominators are fixed."""
    res = tested_values(res, terms, doc, period)
    obs = observed(res, terms, period)
    c = period_counts(res, period).first()
    n_pre, n_post = float(c["n_pre"] or 0), float(c["n_post"] or 0)
    at, last = np.full(n_perm, -1, np.int64), {}
    for r in exact_thresholds(res, n_perm, seed, doc, period).collect():  # one row for each replicate
        at[r["rep"]], last[r["rep"]] = int(r["u_cut"] * TWO52), r["doc_cut"]

    def label(u, docs):
        out = u < at
        for i, rep in zip(*np.nonzero(u == at)):  # the document of the cut, and those with its draw
            d = docs[int(i)].as_py()
            out[i, rep] = d is not None and last[rep] is not None and d <= last[rep]
        return out

    num, _ = replicate_sums(res, n_perm, seed, label, doc, period)
    num = num.select("term", "rep", F.col("s").alias("sp"))
    full = with_replicates(obs.select("term", "s_pre", "s_post", "difference"), n_perm)
    j = full.join(num, ["term", "rep"], "left").na.fill(0.0, ["sp"])
    diff = (F.try_divide(F.col("s_pre") + F.col("s_post") - F.col("sp"), F.lit(n_post))
            - F.try_divide(F.col("sp"), F.lit(n_pre)))
    return j.groupBy("term").agg(
        F.avg(F.when(_at_least_as_extreme(diff, F.col("difference")), 1.0).otherwise(0.0))
        .alias("perm_pvalue"))


def bootstrap_ci(res: TfidfResult, terms: Sequence[str], n_boot: int = 100, seed: int = 1,
                 doc: str = "doc_id", period: str = "pre", level: float = 0.95) -> DataFrame:
    """H4/H5: percentile CI of post-minus-pre means under Poisson(1) resampling weights.

    Weights are drawn per (replicate, document), separately per period because the
    period is fixed per document.  Zeros only enter the weight sums.
    """
    res = tested_values(res, terms, doc, period)
    cdf = np.array(poisson1_cdf())
    num, den = replicate_sums(res, n_boot, seed, lambda u, _: np.searchsorted(cdf, u / TWO52, side="right"), doc, period, by_period=True)
    arm = lambda a: F.sum(F.when(F.col("arm") == a, F.col("s")))
    den = den.groupBy("rep").agg(arm(1).alias("w_pre"), arm(0).alias("w_post"))
    j = (num.groupBy("term", "rep").agg(arm(1).alias("x_pre"), arm(0).alias("x_post"))
         .na.fill(0.0, ["x_pre", "x_post"]).join(den, "rep"))
    d = F.try_divide("x_post", "w_post") - F.try_divide("x_pre", "w_pre")
    lo, hi = (1 - level) / 2, 1 - (1 - level) / 2
    out = j.groupBy("term").agg(F.percentile(d, lo).alias("ci_lower"), F.percentile(d, hi).alias("ci_upper"))
    return out.withColumn("ci_excludes_zero", ((F.col("ci_lower") > 0) & (F.col("ci_upper") > 0))
                          | ((F.col("ci_lower") < 0) & (F.col("ci_upper") < 0)))


def term_significance(res: TfidfResult, terms: Sequence[str], n_perm: int = 1000,
                      n_boot: int = 100, alpha: float = 0.05, seed: int = 0,
                      period: str = "pre", perm_method: str = "exact") -> DataFrame:
    """H6: the reference's joint table; significant = MW p, permutation p < alpha and CI excludes 0.

    ``perm_method``: ``exact`` (fixed-size label shuffles, as the reference) or
    ``bernoulli`` (independent labels; one pass fewer)."""
    res = tested_values(res, terms, "doc_id", period)
    obs = observed(res, terms, period).select("term", "pre_mean", "post_mean", "difference", "percent_change")
    mw = mann_whitney(res, terms, period).select("term", "mw_pvalue")
    if perm_method == "exact":
        perm = permutation_test_exact(res, terms, n_perm, seed, period=period)
    else:
        perm = permutation_test(res, terms, n_perm, seed, period=period)
    boot = bootstrap_ci(res, terms, n_boot, seed + 1, period=period)
    j = obs.join(mw, "term", "left").join(perm, "term", "left").join(boot, "term", "left")
    return j.withColumn("significant_05", (F.col("mw_pvalue") < alpha) & (F.col("perm_pvalue") < alpha)
                        & F.col("ci_excludes_zero")).drop("ci_excludes_zero")


# ------------------------------------------------------------- panel tests
def average_rank(df: DataFrame, partition: str, order: str, name: str = "time_trend") -> DataFrame:
    """Average rank (ties share the mean of their positions) within a partition."""
    w = Window.partitionBy(partition).orderBy(order)
    ties = Window.partitionBy(partition, order)
    return df.withColumn(name, F.rank().over(w) + (F.count(F.lit(1)).over(ties) - 1) / 2.0)


def t_two_sided(t: str, df: str) -> Column:
    """Two-sided p-value of Student's t, exact for whole degrees of freedom (null without any)."""
    return F.expr(two_sided_spark(t, df))


def pretrend_slopes(panel: DataFrame, outcomes: Sequence[str], forum: str = "forum",
                    reference: str | None = None, date_col: str = "week_start",
                    event_date: str | None = None) -> DataFrame:
    """H7/H8: ``y ~ t + forum + t:forum`` on pre-event rows, per outcome.

    Full interaction = one line per forum with pooled residual variance; the
    interaction is ``b_f - b_ref`` with ``se = sqrt(s2 (1/sxx_f + 1/sxx_ref))``.
    Without a ``reference`` it is the first forum by name.
    """
    if reference is None:
        reference = panel.agg(F.min(forum)).first()[0]
    pre = panel if event_date is None else panel.where(F.col(date_col) <= F.lit(event_date).cast("date"))
    pre = average_rank(pre, forum, date_col)
    long = pre.select(forum, "time_trend", F.explode(F.array(*[
        F.struct(F.lit(o).alias("outcome"), F.col(o).cast("double").alias("y")) for o in outcomes])).alias("o"))
    long = long.select(forum, "time_trend", "o.outcome", "o.y")
    per = long.groupBy("outcome", forum).agg(
        F.regr_slope("y", "time_trend").alias("slope"), F.regr_sxx("y", "time_trend").alias("sxx"),
        F.regr_syy("y", "time_trend").alias("syy"), F.regr_sxy("y", "time_trend").alias("sxy"),
        F.regr_count("y", "time_trend").alias("n"))
    ref = reference
    pooled = per.groupBy("outcome").agg(
        F.try_divide(F.sum(F.col("syy") - F.try_divide(F.col("sxy") * F.col("sxy"), F.col("sxx"))),
                     F.sum("n") - 2 * F.count(F.lit(1))).alias("s2"),
        (F.sum("n") - 2 * F.count(F.lit(1))).alias("df_resid"),
        F.max(F.when(F.col(forum) == F.lit(ref), F.col("slope"))).alias("ref_slope"),
        F.max(F.when(F.col(forum) == F.lit(ref), F.col("sxx"))).alias("ref_sxx"))
    j = per.join(pooled, "outcome")
    inter = F.col("slope") - F.col("ref_slope")
    se = F.sqrt(F.col("s2") * (F.try_divide(F.lit(1.0), F.col("sxx")) + F.try_divide(F.lit(1.0), F.col("ref_sxx"))))
    out = j.where(F.col(forum) != F.lit(ref)).select(
        "outcome", forum, "slope", inter.alias("interaction"), se.alias("se"),
        F.try_divide(inter, se).alias("t_stat"), F.col("df_resid").cast("long").alias("df_resid"))
    return out


def pretrend_test(panel: DataFrame, outcomes: Sequence[str], forum: str = "forum",
                  reference: str | None = None, date_col: str = "week_start",
                  event_date: str | None = None, alpha: float = 0.05) -> DataFrame:
    """H7/H8: slopes plus the two-sided t p-value and the parallel-trend label."""
    s = pretrend_slopes(panel, outcomes, forum, reference, date_col, event_date)
    s = s.withColumn("p_value", t_two_sided("t_stat", "cast(df_resid as double)"))
    return s.withColumn("verdict", F.when(F.col("p_value") < alpha, F.lit("non-parallel"))
                        .otherwise(F.lit("parallel")))


def _pair_corr(a, b):
    """Pearson r over rows where both are present; null (not an ANSI error) when a
    series is constant or has fewer than two points."""
    sa = F.stddev_samp(F.when(b.isNotNull(), a))
    sb = F.stddev_samp(F.when(a.isNotNull(), b))
    return F.when((sa > 0) & (sb > 0), F.try_divide(F.covar_samp(a, b), sa * sb))


def corr_prepost(wide: DataFrame, cols: Sequence[str], labels: Sequence[str], date_col: str,
                 event_date: str) -> DataFrame:
    """H9: Pearson correlations between forum series, before (<=) and after (>) the event.

    One aggregate pass per period with one ``corr`` per column pair over the wide
    (week x forum) table; rows where either series is null are skipped pairwise.
    NaN rows are dropped first (``drop_nans``).
    """
    ev = F.lit(event_date).cast("date")
    base = wide
    for c in cols:
        base = base.where(~F.isnan(F.col(f"`{c}`")) | F.col(f"`{c}`").isNull())
    pairs = [(i, j) for i in range(len(cols)) for j in range(i + 1, len(cols))]
    out = None
    for period, cond in (("pre", F.col(date_col) <= ev), ("post", F.col(date_col) > ev)):
        aggs = [_pair_corr(F.col(f"`{cols[i]}`"), F.col(f"`{cols[j]}`")).alias(f"c{i}_{j}")
                for i, j in pairs]
        row = base.where(cond).agg(*aggs)
        long = row.select(F.explode(F.array(*[
            F.struct(F.lit(labels[i]).alias("forum_a"), F.lit(labels[j]).alias("forum_b"),
                     F.col(f"c{i}_{j}").alias("corr")) for i, j in pairs])).alias("p")).select(
            F.lit(period).alias("period"), "p.forum_a", "p.forum_b", "p.corr")
        out = long if out is None else out.unionByName(long)
    return out
