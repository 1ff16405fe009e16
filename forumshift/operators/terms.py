"""TF-IDF over a corpus and the before/after term shift.

Plan shape (no densified matrix, no driver-side corpus):

1. per document, tokens -> uni/bigrams -> (term, tf) pairs by sorting the
   array and reading run lengths (narrow, no shuffle);
2. vocabulary: word totals bound what a bigram can reach, so only terms of frequent
   words are counted; explode terms -> ``groupBy(term)`` with map-side partial
   aggregation -> min/max document-frequency filter -> top ``max_features`` by
   total count.  The result is bounded by ``max_features`` and collected once;
3. per document, keep vocabulary terms, weight by idf and L2-normalise inside
   the row (a literal map holds the idf table), then explode to the long
   ``(doc, period, term, tfidf)`` table — again narrow;
4. period statistics: ``groupBy(term)`` with partial aggregation.

Only steps 2 and 4 shuffle, and both shuffle pre-aggregated rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.lookup import in_list_sql, literal_lookup
from ..session import cut_lineage

# Vectoriser settings of the study.
MIN_DF = 10
MAX_DF = 0.7
MAX_FEATURES = 2000


@dataclass
class TfidfResult:
    vocab: DataFrame        # term, df, total_count, idf
    long: DataFrame         # doc, period columns, term, tf, tfidf (non-zero entries only)
    docs: DataFrame         # doc, period columns (all documents, incl. those without terms)
    weighted: DataFrame | None = None   # doc, period columns, _w (term, tf, w), _norm: ``long`` before its explode


def doc_tokens(docs: DataFrame, doc: str, text: str, keep: tuple[str, ...] = ()) -> DataFrame:
    return docs.select(F.col(doc), *[F.col(k) for k in keep], X.tfidf_tokens(text).alias("_t"))


def frequent_words(tokens: DataFrame, n_docs: int, min_df: int, max_df: float, max_features: int) -> list[str] | None:
    """The words that a kept term can consist of (None: no limit known).

    A bigram occurs no more often than either of its words, in text and in documents.  With
    theta the ``max_features``-th largest total among words that are kept by document
    frequency, only words with a total of theta or more and at least ``min_df`` documents can
    be in a kept term: an exact prune that takes most bigrams out of the vocabulary's
    exchange.  The list holds about ``max_features`` words (and those above ``max_df``).
    """
    # one pass: a row for each occurrence (c) and one for each word of a document (d)
    each = F.concat(F.transform("_t", lambda w: F.struct(w.alias("term"), F.lit(1).alias("c"), F.lit(0).alias("d"))),
                    F.transform(F.array_distinct("_t"), lambda w: F.struct(w.alias("term"), F.lit(0).alias("c"), F.lit(1).alias("d"))))
    stats = cut_lineage(tokens.select(F.explode(each).alias("x")).select("x.*").groupBy("term")
                        .agg(F.sum("c").alias("total"), F.sum("d").alias("df")).where(F.col("df") >= min_df))
    hi = max_df * n_docs if isinstance(max_df, float) else max_df
    top = stats.where(F.col("df") <= hi).orderBy(F.desc("total")).limit(max_features).agg(
        F.min("total").alias("theta"), F.count("*").alias("n")).first()
    if top["n"] < max_features:
        return None
    return [r["term"] for r in stats.where(F.col("total") >= top["theta"]).select("term").collect()]


def doc_terms(tokens: DataFrame, doc: str, keep: tuple[str, ...] = (), bigrams: bool = True,
              words: list[str] | None = None) -> DataFrame:
    """Per-document ``terms`` array of struct(term, tf); with ``words`` only terms of them."""
    if words is None:
        grams = X.with_bigrams("_t") if bigrams else F.col("_t")
        return X.with_term_counts(tokens.select(doc, *keep, grams.alias("_g")), "_g", "terms", keep=(doc, *keep))
    known = F.expr(f"transform(_t, w -> IF(w IN ({in_list_sql(words)}), w, NULL))")
    marked = tokens.select(doc, *keep, known.alias("_t"))
    single = F.filter("_t", lambda w: w.isNotNull())
    if bigrams:
        n = F.greatest(F.size("_t") - 1, F.lit(0))
        pair = F.zip_with(F.slice("_t", 1, n), F.slice("_t", 2, n), lambda a, b: F.concat(a, F.lit(" "), b))  # null if either is
        grams = F.concat(single, F.filter(pair, lambda g: g.isNotNull()))
    else:
        grams = single
    return X.with_term_counts(marked.select(doc, *keep, grams.alias("_g")), "_g", "terms", keep=(doc, *keep))


def fit_vocabulary(per_doc: DataFrame, n_docs: int, min_df: int = MIN_DF,
                   max_df: float = MAX_DF, max_features: int | None = MAX_FEATURES) -> DataFrame:
    """kept terms with document frequency, total count and smoothed idf."""
    pairs = (per_doc.select(F.explode_outer("terms").alias("t")).where(F.col("t").isNotNull())
             .select("t.term", "t.tf"))
    stats = pairs.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total_count"))
    hi = max_df * n_docs if isinstance(max_df, float) else max_df
    kept = stats.where((F.col("df") >= F.lit(min_df)) & (F.col("df") <= F.lit(hi)))
    if max_features is not None:
        kept = kept.orderBy(F.desc("total_count"), F.asc("term")).limit(max_features)
    return kept.withColumn(
        "idf", F.log((F.lit(1.0) + F.lit(float(n_docs))) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0))


def tfidf(docs: DataFrame, doc: str = "doc_id", text: str = "processed_text",
          keep: tuple[str, ...] = ("pre",), min_df: int = MIN_DF, max_df: float = MAX_DF,
          max_features: int | None = MAX_FEATURES, bigrams: bool = True,
          materialize: str = "checkpoint") -> TfidfResult:
    """Fit on all documents with non-null text, transform them, long result.

    The per-document term counts are read twice (fit, then transform); they are written to
    the shared folder, so a lost executor costs no second tokenisation
    (``materialize="persist"`` caches them on the executors instead, until the caller
    releases the cache).  With
    ``max_features`` the vocabulary is bounded by it and weighting happens inside the row;
    with ``None`` it is joined on the term.
    """
    tokens = doc_tokens(docs.where(F.col(text).isNotNull()), doc, text, keep)
    n_docs = tokens.count()
    words = frequent_words(tokens, n_docs, min_df, max_df, max_features) if max_features is not None else None
    per_doc = doc_terms(tokens, doc, keep, bigrams, words)
    per_doc = cut_lineage(per_doc) if materialize == "checkpoint" else per_doc.persist()
    vocab = cut_lineage(fit_vocabulary(per_doc, n_docs, min_df, max_df, max_features))
    all_docs = per_doc.select(doc, *keep)
    if max_features is None:
        terms = (per_doc.select(doc, *keep, F.explode("terms").alias("t")).select(doc, *keep, "t.term", "t.tf")
                 .join(vocab.select("term", "idf"), "term").withColumn("_w", F.col("tf") * F.col("idf")))
        norms = terms.groupBy(doc).agg(F.sqrt(F.sum(F.col("_w") * F.col("_w"))).alias("_norm"))
        long = terms.join(norms, doc).select(doc, *keep, "term", "tf", (F.col("_w") / F.col("_norm")).alias("tfidf"))
        return TfidfResult(vocab=vocab, long=long, docs=all_docs)
    # The fitted vocabulary is bounded by max_features: it becomes a hashed literal table in
    # the plan, so weighting and normalising a document happen inside its row, no shuffle.
    probe, rows = literal_lookup(vocab, "term", "idf", max_rows=max_features)
    # Membership first (an IN list over the vocabulary compiles to a hash set), then
    # the idf probe only for the kept terms; tf * idf is the weight.
    member = f"filter(terms, t -> t.term IN ({in_list_sql([r['k'] for r in rows]) or 'NULL'}))"
    weighted = F.expr(f"transform({member}, t -> named_struct('term', t.term, 'tf', t.tf, "
                      f"'w', t.tf * {probe('t.term')}))")
    # Two projections: the weighted array is materialised once, then read twice.
    weighted_df = per_doc.select(doc, *keep, weighted.alias("_w"))
    norm = F.sqrt(F.aggregate("_w", F.lit(0.0), lambda acc, t: acc + t["w"] * t["w"]))
    scored = weighted_df.select(doc, *keep, "_w", norm.alias("_norm"))
    long = (scored.select(doc, *keep, "_norm", F.explode_outer("_w").alias("t")).where(F.col("t").isNotNull())
                  .select(doc, *keep, F.col("t.term").alias("term"), F.col("t.tf").alias("tf"),
                          (F.col("t.w") / F.col("_norm")).alias("tfidf")))
    return TfidfResult(vocab=vocab, long=long, docs=all_docs, weighted=scored)


def term_shift(res: TfidfResult, period: str = "pre") -> DataFrame:
    """Per-term mean TF-IDF and document frequency in each period.

    ``period`` is 1 for pre, 0 for post.  Means are over *all* documents of the
    period (zeros included), so the denominators come from a one-row count.
    """
    c = res.docs.agg(
        F.sum(F.when(F.col(period) == 1, 1).otherwise(0)).alias("n_pre"),
        F.sum(F.when(F.col(period) == 0, 1).otherwise(0)).alias("n_post")).first()  # one row
    is_pre = F.col(period) == 1
    is_post = F.col(period) == 0
    sums = res.long.groupBy("term").agg(
        F.sum(F.when(is_pre, F.col("tfidf")).otherwise(0.0)).alias("_s_pre"),
        F.sum(F.when(is_post, F.col("tfidf")).otherwise(0.0)).alias("_s_post"),
        F.count(F.when(is_pre & (F.col("tfidf") > 0), 1)).alias("_c_pre"),
        F.count(F.when(is_post & (F.col("tfidf") > 0), 1)).alias("_c_post"))
    t = (res.vocab.select("term").join(sums, "term", "left")
         .na.fill(0, ["_s_pre", "_s_post", "_c_pre", "_c_post"])
         .withColumns({"n_pre": F.lit(c["n_pre"] or 0).cast("long"),
                       "n_post": F.lit(c["n_post"] or 0).cast("long")}))
    pre = F.try_divide(F.col("_s_pre"), F.col("n_pre").cast("double"))
    post = F.try_divide(F.col("_s_post"), F.col("n_post").cast("double"))
    out = t.select(
        "term",
        pre.alias("pre_mean_tfidf"), post.alias("post_mean_tfidf"),
        F.try_divide(F.col("_c_pre").cast("double"), F.col("n_pre")).alias("pre_doc_freq"),
        F.try_divide(F.col("_c_post").cast("double"), F.col("n_post")).alias("post_doc_freq"))
    return out.withColumns({
        "tfidf_diff": F.col("post_mean_tfidf") - F.col("pre_mean_tfidf"),
        "tfidf_ratio": F.when(F.col("pre_mean_tfidf") > 0, F.col("post_mean_tfidf") / F.col("pre_mean_tfidf"))
                        .when(F.col("post_mean_tfidf") > 0, F.lit(1000.0)),
        "doc_freq_diff": F.col("post_doc_freq") - F.col("pre_doc_freq"),
        "tfidf_percent_change": F.when(F.col("pre_mean_tfidf") > 0.0001,
                                       (F.col("post_mean_tfidf") - F.col("pre_mean_tfidf"))
                                       / F.col("pre_mean_tfidf") * 100.0),
    })


def changed_terms(shift: DataFrame, kind: str) -> DataFrame:
    """``up`` / ``down`` (sign of the mean change), ``new`` / ``gone``
    (document frequency below 1 % in one period and above 5 % in the other)."""
    if kind == "up":
        return shift.where(F.col("tfidf_diff") > 0)
    if kind == "down":
        return shift.where(F.col("tfidf_diff") < 0)
    if kind == "new":
        return shift.where((F.col("pre_doc_freq") < 0.01) & (F.col("post_doc_freq") > 0.05))
    if kind == "gone":
        return shift.where((F.col("pre_doc_freq") > 0.05) & (F.col("post_doc_freq") < 0.01))
    raise ValueError("kind must be up, down, new or gone")


def top_changed(shift: DataFrame, k: int = 15, by: str = "tfidf_diff",
                presence: float = 0.01) -> DataFrame:
    """among terms present in > 1 % of documents in either period, the ``k``
    largest increases and ``k`` largest decreases (by difference or by percent)."""
    present = shift.where((F.col("pre_doc_freq") > presence) | (F.col("post_doc_freq") > presence))
    if by == "tfidf_diff":
        up = present.orderBy(F.desc(by), F.asc("term")).limit(k)
        down = present.orderBy(F.asc(by), F.asc("term")).limit(k)
    else:
        up = present.where(F.col("tfidf_diff") > 0).orderBy(F.desc_nulls_last(by), F.asc("term")).limit(k)
        down = present.where(F.col("tfidf_diff") < 0).orderBy(F.asc_nulls_last(by), F.asc("term")).limit(k)
    return (up.withColumn("direction", F.lit("up"))
              .unionByName(down.withColumn("direction", F.lit("down"))))


def term_values(res: TfidfResult, terms: list[str]) -> DataFrame:
    """Non-zero values of chosen terms per document (zeros implied by the
    period counts).  ``terms`` is a short driver list (the tested terms), applied
    as an IN filter on the long table; unknown terms are simply absent."""
    return res.long.where(F.col("term").isin(list(terms)))


def doc_values(res: TfidfResult, terms: list[str], doc: str = "doc_id", period: str = "pre") -> DataFrame:
    """The values of chosen terms with all terms of a document in one row: doc, period,
    ``n`` (1, or 0 if the document is counted in another row), ``at`` (places in ``terms``)
    and ``value``.  Narrow for a fitted result; else the long table is grouped by document."""
    known = F.array(*[F.lit(t) for t in terms]) if terms else F.array().cast("array<string>")
    place = lambda term: (F.array_position(known, term) - 1).cast("int")
    if res.weighted is not None:
        kept = F.filter("_w", lambda t: t["term"].isin(list(terms)))
        rows = res.weighted.select(doc, period, "_norm", kept.alias("_k"))
        return rows.select(doc, period, F.lit(1).alias("n"), F.transform("_k", lambda t: place(t["term"])).alias("at"),
                           F.transform("_k", lambda t: t["w"] / F.col("_norm")).alias("value"))
    found = (term_values(res, terms).groupBy(doc, period, place(F.col("term")).alias("at")).agg(F.sum("tfidf").alias("value"))
             .groupBy(doc, period).agg(F.collect_list(F.struct("at", "value")).alias("v"))
             .select(doc, period, F.lit(0).alias("n"), F.col("v.at").alias("at"), F.col("v.value").alias("value")))
    none = [F.array().cast("array<int>").alias("at"), F.array().cast("array<double>").alias("value")]
    return res.docs.select(doc, period, F.lit(1).alias("n"), *none).unionByName(found)
