"""TF-IDF term shift over the corpus analogue."""

from __future__ import annotations

from ..operators import terms as T
from . import sqltext as Q
from .fixtures import fixture, with_views
from .registry import register, rounded


def corpus_tfidf(spark, sf) -> T.TfidfResult:
    return T.tfidf(fixture(spark, sf, "corpus_docs"), "doc_id", "processed_text", ("pre",))


def corpus_shift(spark, sf):
    return T.term_shift(corpus_tfidf(spark, sf))


_TFIDF_CTES = f"""
, docs AS (SELECT doc_id, pre, processed_text FROM corpus_docs WHERE processed_text IS NOT NULL),
tok AS (SELECT doc_id, pre, {Q.tfidf_tokens('processed_text')} AS t FROM docs),
grams AS (SELECT doc_id, pre,
                 list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS g
          FROM tok),
tf AS (SELECT doc_id, pre, term, count(*) AS tf
       FROM (SELECT doc_id, pre, unnest(g) AS term FROM grams) GROUP BY doc_id, pre, term),
n AS (SELECT count(*) AS n_docs, sum(CASE WHEN pre = 1 THEN 1 ELSE 0 END) AS n_pre,
             sum(CASE WHEN pre = 0 THEN 1 ELSE 0 END) AS n_post FROM docs),
dfs AS (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS total_count FROM tf GROUP BY term),
vocab AS (SELECT term, df, total_count, ln((1.0 + n_docs) / (1.0 + df)) + 1.0 AS idf
          FROM dfs, n WHERE df >= {T.MIN_DF} AND df <= {T.MAX_DF} * n_docs
          ORDER BY total_count DESC, term LIMIT {T.MAX_FEATURES}),
w AS (SELECT doc_id, pre, term, tf, tf * idf AS w FROM tf JOIN vocab USING (term)),
nrm AS (SELECT doc_id, sqrt(sum(w * w)) AS nrm FROM w GROUP BY doc_id),
tfidf AS (SELECT doc_id, pre, term, tf, w / nrm AS tfidf FROM w JOIN nrm USING (doc_id)),
sums AS (SELECT term, sum(CASE WHEN pre = 1 THEN tfidf ELSE 0 END) AS s_pre,
                sum(CASE WHEN pre = 0 THEN tfidf ELSE 0 END) AS s_post,
                count(CASE WHEN pre = 1 AND tfidf > 0 THEN 1 END) AS c_pre,
                count(CASE WHEN pre = 0 AND tfidf > 0 THEN 1 END) AS c_post
         FROM tfidf GROUP BY term),
shift0 AS (SELECT term, coalesce(s_pre, 0) / n_pre AS pre_mean_tfidf,
                  coalesce(s_post, 0) / n_post AS post_mean_tfidf,
                  coalesce(c_pre, 0) / n_pre AS pre_doc_freq, coalesce(c_post, 0) / n_post AS post_doc_freq
           FROM vocab LEFT JOIN sums USING (term), n),
shift AS (SELECT *, post_mean_tfidf - pre_mean_tfidf AS tfidf_diff,
                 CASE WHEN pre_mean_tfidf > 0 THEN post_mean_tfidf / pre_mean_tfidf
                      WHEN post_mean_tfidf > 0 THEN 1000.0 END AS tfidf_ratio,
                 post_doc_freq - pre_doc_freq AS doc_freq_diff,
                 CASE WHEN pre_mean_tfidf > 0.0001
                      THEN (post_mean_tfidf - pre_mean_tfidf) / pre_mean_tfidf * 100.0 END
                     AS tfidf_percent_change
          FROM shift0)"""

SHIFT_COLS = ("term", "pre_mean_tfidf", "post_mean_tfidf", "pre_doc_freq", "post_doc_freq",
              "tfidf_diff", "tfidf_ratio", "doc_freq_diff", "tfidf_percent_change")


def _r(cols):
    return ", ".join(c if c == "term" else f"round({c}, 6) AS {c}" for c in cols)


def tfidf_sql(select: str) -> str:
    return with_views("", "corpus_docs") + "," + _TFIDF_CTES.lstrip().lstrip(",") + "\n" + select


@register("tfidf_vocab", tfidf_sql("SELECT term, df, total_count, round(idf, 6) AS idf FROM vocab"))
def q_tfidf_vocab(spark, sf):
    """Fitted vocabulary (min_df 10, max_df 0.7, 2000 features) with smoothed idf."""
    return rounded(corpus_tfidf(spark, sf).vocab)


@register("tfidf_long", tfidf_sql(
    "SELECT doc_id, pre, term, tf, round(tfidf, 6) AS tfidf FROM tfidf"))
def q_tfidf_long(spark, sf):
    """the long (doc, term) TF-IDF table, L2-normalised per document."""
    return rounded(corpus_tfidf(spark, sf).long)


@register("tfidf_mean_shift", tfidf_sql(f"SELECT {_r(SHIFT_COLS)} FROM shift"))
def q_tfidf_mean_shift(spark, sf):
    """The vocabulary table with before/after statistics."""
    return rounded(corpus_shift(spark, sf).select(*SHIFT_COLS))


@register("doc_freq_shift", tfidf_sql(
    f"SELECT {_r(('term', 'pre_doc_freq', 'post_doc_freq', 'doc_freq_diff'))} FROM shift"))
def q_doc_freq_shift(spark, sf):
    """Share of documents containing each term, per period, and its change."""
    return rounded(corpus_shift(spark, sf).select("term", "pre_doc_freq", "post_doc_freq",
                                                  "doc_freq_diff"))


_KINDS = {
    "up": "tfidf_diff > 0",
    "down": "tfidf_diff < 0",
    "new": "pre_doc_freq < 0.01 AND post_doc_freq > 0.05",
    "gone": "pre_doc_freq > 0.05 AND post_doc_freq < 0.01",
}


def _kind_query(kind):
    @register(f"terms_{kind}", tfidf_sql(f"SELECT {_r(SHIFT_COLS)} FROM shift WHERE {_KINDS[kind]}"))
    def q(spark, sf):
        return rounded(T.changed_terms(corpus_shift(spark, sf), kind).select(*SHIFT_COLS))
    q.__doc__ = f"F9/F10: terms '{kind}' after the event."
    return q


for _k in _KINDS:
    _kind_query(_k)


@register("terms_pct_change", tfidf_sql(
    "SELECT term, round(tfidf_percent_change, 6) AS tfidf_percent_change FROM shift"))
def q_terms_pct_change(spark, sf):
    """percent change of mean TF-IDF, null when the base is <= 0.0001."""
    return rounded(corpus_shift(spark, sf).select("term", "tfidf_percent_change"))


_PRESENT = "(pre_doc_freq > 0.01 OR post_doc_freq > 0.01)"


@register("top_changed", tfidf_sql(f"""
SELECT * FROM (SELECT {_r(SHIFT_COLS)}, 'up' AS direction FROM shift WHERE {_PRESENT}
               ORDER BY tfidf_diff DESC, term LIMIT 15)
UNION ALL
SELECT * FROM (SELECT {_r(SHIFT_COLS)}, 'down' AS direction FROM shift WHERE {_PRESENT}
               ORDER BY tfidf_diff ASC, term LIMIT 15)"""))
def q_top_changed(spark, sf):
    """15 largest increases and 15 largest decreases among present terms."""
    return rounded(T.top_changed(corpus_shift(spark, sf)).select(*SHIFT_COLS, "direction"))


@register("top_changed_pct", tfidf_sql(f"""
SELECT * FROM (SELECT {_r(SHIFT_COLS)}, 'up' AS direction FROM shift
               WHERE {_PRESENT} AND tfidf_diff > 0
               ORDER BY tfidf_percent_change DESC NULLS LAST, term LIMIT 15)
UNION ALL
SELECT * FROM (SELECT {_r(SHIFT_COLS)}, 'down' AS direction FROM shift
               WHERE {_PRESENT} AND tfidf_diff < 0
               ORDER BY tfidf_percent_change ASC NULLS LAST, term LIMIT 15)"""))
def q_top_changed_pct(spark, sf):
    """F12 by percent: 15 largest relative increases and decreases."""
    return rounded(T.top_changed(corpus_shift(spark, sf), by="tfidf_percent_change")
                   .select(*SHIFT_COLS, "direction"))
