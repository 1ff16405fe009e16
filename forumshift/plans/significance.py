"""Term significance and panel tests."""

from __future__ import annotations

from ..functions.normal import two_sided_sql
from ..functions.student import central_duck
from ..operators import significance as S
from ..operators import terms as T
from .fixtures import ORDERS_EVENT_DATE
from .registry import register, rounded
from .terms import _PRESENT, corpus_tfidf, tfidf_sql
from .volume import ORDERS_FORUMS, orders_panel, panel_sql, stored_panel

PRETREND_REFERENCE = "2-HIGH"
PRETREND_OUTCOMES = ("question_count", "log_question_count", "indexed_count")


def tested_terms(res: T.TfidfResult) -> list[str]:
    """The 15 up + 15 down terms of the term-shift report (bounded by k)."""
    top = T.top_changed(T.term_shift(res))
    return [r["term"] for r in top.select("term").collect()]


_TESTED_CTES = f"""
, tested AS (SELECT term FROM (SELECT term FROM shift WHERE {_PRESENT} ORDER BY tfidf_diff DESC, term LIMIT 15)
             UNION ALL
             SELECT term FROM (SELECT term FROM shift WHERE {_PRESENT} ORDER BY tfidf_diff ASC, term LIMIT 15)),
vals AS (SELECT doc_id, pre, term, tfidf FROM tfidf WHERE term IN (SELECT term FROM tested)),
obs AS (SELECT t.term, coalesce(sum(CASE WHEN pre = 1 THEN tfidf END), 0) AS s_pre,
               coalesce(sum(CASE WHEN pre = 0 THEN tfidf END), 0) AS s_post,
               count(CASE WHEN pre = 1 THEN 1 END) AS nnz_pre, count(CASE WHEN pre = 0 THEN 1 END) AS nnz_post
        FROM tested t LEFT JOIN vals USING (term) GROUP BY t.term),
blocks AS (SELECT term, CASE WHEN tfidf > 0 THEN round(tfidf * pow(10.0, {S.TIE_DIGITS} - ceil(log10(tfidf)))) / pow(10.0, {S.TIE_DIGITS} - ceil(log10(tfidf))) ELSE tfidf END AS value, count(CASE WHEN pre = 0 THEN 1 END) AS c_post,
                  count(CASE WHEN pre = 1 THEN 1 END) AS c_pre FROM vals GROUP BY 1, 2
           UNION ALL
           SELECT term, 0.0, n_post - nnz_post, n_pre - nnz_pre FROM obs, n),
allb AS (SELECT *, CAST(c_post + c_pre AS DOUBLE) AS t FROM blocks WHERE c_post + c_pre > 0),
ranked AS (SELECT *, coalesce(sum(t) OVER (PARTITION BY term ORDER BY value
                                          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
                     + (t + 1) / 2 AS rnk FROM allb),
per AS (SELECT term, sum(c_post * rnk) AS r1, sum(t * t * t - t) AS ties FROM ranked GROUP BY term),
mw AS (SELECT term, r1 - n_post * (n_post + 1) / 2.0 AS u,
              CAST(n_post AS DOUBLE) * n_pre / 12.0
                * ((n_post + n_pre + 1) - ties / (CAST(n_post + n_pre AS DOUBLE) * (n_post + n_pre - 1))) AS var,
              CAST(n_post AS DOUBLE) * n_pre / 2.0 AS mu
       FROM per, n)"""


@register("mannwhitney", tfidf_sql(_TESTED_CTES + """
SELECT term, round(u, 6) AS mw_u,
       round(CASE WHEN var > 0 THEN (abs(u - mu) - 0.5) / sqrt(var) END, 6) AS mw_z
FROM mw"""))
def q_mannwhitney(spark, sf):
    """H2: Mann-Whitney U and tie/continuity-corrected z of the tested terms."""
    res = corpus_tfidf(spark, sf)
    return rounded(S.mann_whitney(res, tested_terms(res)).select("term", "mw_u", "mw_z"))


_MW_P = f"least(1.0, {two_sided_sql('mw_z')})"
_MWZ = "mwz AS (SELECT term, CASE WHEN var > 0 THEN (abs(u - mu) - 0.5) / sqrt(var) END AS mw_z FROM mw)"


@register("mw_pvalue", tfidf_sql(_TESTED_CTES + f"""
, {_MWZ} SELECT term, round({_MW_P}, 6) AS mw_pvalue FROM mwz"""))
def q_mw_pvalue(spark, sf):
    """H2: two-sided p-values of the Mann-Whitney test."""
    res = corpus_tfidf(spark, sf)
    return rounded(S.mann_whitney(res, tested_terms(res)).select("term", "mw_pvalue"))


@register("term_observed", tfidf_sql(_TESTED_CTES + """
SELECT term, round(s_pre / n_pre, 6) AS pre_mean, round(s_post / n_post, 6) AS post_mean,
       round(s_post / n_post - s_pre / n_pre, 6) AS difference,
       round(CASE WHEN s_pre > 0 THEN (s_post / n_post - s_pre / n_pre) / (s_pre / n_pre) * 100.0 END, 6)
           AS percent_change
FROM obs, n"""))
def q_term_observed(spark, sf):
    """Observed pre/post means (zeros implied) of the tested terms."""
    res = corpus_tfidf(spark, sf)
    return rounded(S.observed(res, tested_terms(res)).select(
        "term", "pre_mean", "post_mean", "difference", "percent_change"))


def _uniform_sql(seed, rep, doc):
    return (f"CAST(('0x' || substr(md5(concat_ws(':', '{seed}', CAST({rep} AS VARCHAR), "
            f"CAST({doc} AS VARCHAR))), 1, 13)) AS BIGINT) / pow(2, 52)")


_PERM_SQL = f"""
, frac AS (SELECT CAST(n_pre AS DOUBLE) / (n_pre + n_post) AS f FROM n),
reps AS (SELECT range AS rep FROM range(0, 1000)),
den AS (SELECT rep, sum(CASE WHEN {_uniform_sql(0, 'rep', 'doc_id')} < f THEN 1 ELSE 0 END) AS m_pre,
               count(*) AS m_all FROM docs, reps, frac GROUP BY rep),
num AS (SELECT term, rep, sum(CASE WHEN {_uniform_sql(0, 'rep', 'doc_id')} < f THEN tfidf ELSE 0 END) AS sp
        FROM vals, reps, frac GROUP BY term, rep),
perm AS (SELECT num.term, avg(CASE WHEN abs((s_pre + s_post - sp) / (m_all - m_pre) - sp / m_pre)
                                   >= abs(s_post / n_post - s_pre / n_pre) * (1 - {S.PERM_RTOL}) - {S.PERM_ATOL}
                                   THEN 1.0 ELSE 0.0 END) AS perm_pvalue
         FROM num JOIN den USING (rep) JOIN obs USING (term), n GROUP BY num.term)"""


@register("permutation", tfidf_sql(_TESTED_CTES + _PERM_SQL + """
SELECT term, round(perm_pvalue, 6) AS perm_pvalue FROM perm"""))
def q_permutation(spark, sf):
    """H3: permutation p-values (1000 replicates, Bernoulli labels from md5 uniforms)."""
    res = corpus_tfidf(spark, sf)
    return rounded(S.permutation_test(res, tested_terms(res), n_perm=1000, seed=0))


def _poisson_sql(u):
    cdf = S.poisson1_cdf()
    parts = " ".join(f"WHEN {u} < {c!r} THEN {k}" for k, c in enumerate(cdf))
    return f"CASE {parts} ELSE {len(cdf)} END"


_BOOT_SQL = f"""
, breps AS (SELECT range AS rep FROM range(0, 100)),
wts AS (SELECT doc_id, pre, rep, {_poisson_sql(_uniform_sql(1, 'rep', 'doc_id'))} AS w FROM docs, breps),
bden AS (SELECT rep, sum(CASE WHEN pre = 1 THEN w END) AS w_pre, sum(CASE WHEN pre = 0 THEN w END) AS w_post
         FROM wts GROUP BY rep),
bnum AS (SELECT term, rep, sum(CASE WHEN v.pre = 1 THEN w * tfidf ELSE 0 END) AS x_pre,
                sum(CASE WHEN v.pre = 0 THEN w * tfidf ELSE 0 END) AS x_post
         FROM vals v JOIN wts USING (doc_id) GROUP BY term, rep),
bfull AS (SELECT t.term, r.rep, coalesce(x_pre, 0) AS x_pre, coalesce(x_post, 0) AS x_post
          FROM tested t CROSS JOIN breps r LEFT JOIN bnum b ON b.term = t.term AND b.rep = r.rep),
boot AS (SELECT term, quantile_cont(x_post / w_post - x_pre / w_pre, 0.025) AS ci_lower,
                quantile_cont(x_post / w_post - x_pre / w_pre, 0.975) AS ci_upper
         FROM bfull JOIN bden USING (rep) GROUP BY term)"""


@register("bootstrap_ci", tfidf_sql(_TESTED_CTES + _BOOT_SQL + """
SELECT term, round(ci_lower, 6) AS ci_lower, round(ci_upper, 6) AS ci_upper,
       (ci_lower > 0 AND ci_upper > 0) OR (ci_lower < 0 AND ci_upper < 0) AS ci_excludes_zero
FROM boot"""))
def q_bootstrap_ci(spark, sf):
    """H4/H5: 95 % bootstrap CI (100 Poisson-weight replicates) and whether it excludes 0."""
    res = corpus_tfidf(spark, sf)
    return rounded(S.bootstrap_ci(res, tested_terms(res), n_boot=100, seed=1))


_PERM_EXACT_SQL = f"""
, xranked AS (SELECT rep, doc_id,
                    row_number() OVER (PARTITION BY rep ORDER BY {_uniform_sql(0, 'rep', 'doc_id')}, doc_id) AS rn
             FROM docs, reps),
labels AS (SELECT rep, doc_id FROM xranked, n WHERE rn <= n_pre),
xnum AS (SELECT v.term, l.rep, sum(v.tfidf) AS sp FROM vals v JOIN labels l USING (doc_id) GROUP BY 1, 2),
xfull AS (SELECT t.term, r.rep, coalesce(x.sp, 0) AS sp FROM tested t CROSS JOIN reps r
          LEFT JOIN xnum x ON x.term = t.term AND x.rep = r.rep),
xperm AS (SELECT f.term, avg(CASE WHEN abs((s_pre + s_post - sp) / n_post - sp / n_pre)
                                    >= abs(s_post / n_post - s_pre / n_pre) * (1 - {S.PERM_RTOL}) - {S.PERM_ATOL}
                                   THEN 1.0 ELSE 0.0 END) AS perm_pvalue
          FROM xfull f JOIN obs USING (term), n GROUP BY f.term)"""


@register("permutation_exact", tfidf_sql(_TESTED_CTES + _PERM_SQL + _PERM_EXACT_SQL + """
SELECT term, round(perm_pvalue, 6) AS perm_pvalue FROM xperm"""))
def q_permutation_exact(spark, sf):
    """H3 exact: fixed-size label permutations (1000 replicates) via distributed selection."""
    res = corpus_tfidf(spark, sf)
    return rounded(S.permutation_test_exact(res, tested_terms(res), n_perm=1000, seed=0))


@register("term_significance", tfidf_sql(_TESTED_CTES + _PERM_SQL + _PERM_EXACT_SQL + _BOOT_SQL + f"""
, {_MWZ}
SELECT o.term, round(s_pre / n_pre, 6) AS pre_mean, round(s_post / n_post, 6) AS post_mean,
       round(s_post / n_post - s_pre / n_pre, 6) AS difference,
       round(CASE WHEN s_pre > 0 THEN (s_post / n_post - s_pre / n_pre) / (s_pre / n_pre) * 100.0 END, 6) AS percent_change,
       round({_MW_P}, 6) AS mw_pvalue, round(perm_pvalue, 6) AS perm_pvalue, round(ci_lower, 6) AS ci_lower, round(ci_upper, 6) AS ci_upper,
       ({_MW_P}) < 0.05 AND perm_pvalue < 0.05 AND ((ci_lower > 0 AND ci_upper > 0) OR (ci_lower < 0 AND ci_upper < 0)) AS significant_05
FROM obs o JOIN mwz USING (term) JOIN xperm USING (term) JOIN boot USING (term), n"""))
def q_term_significance(spark, sf):
    """H6: joint significance table (MW p from erfc, permutation p, bootstrap CI)."""
    res = corpus_tfidf(spark, sf)
    return rounded(S.term_significance(res, tested_terms(res), n_perm=1000, n_boot=100, seed=0))


_OUT_UNION = " UNION ALL ".join(
    f"SELECT forum, tt, '{o}' AS outcome, CAST({o} AS DOUBLE) AS y FROM r" for o in PRETREND_OUTCOMES)


_PRETREND = f"""
, pre AS (SELECT * FROM panel WHERE week_start <= DATE '{ORDERS_EVENT_DATE}'),
r AS (SELECT *, rank() OVER (PARTITION BY forum ORDER BY week_start)
                + (count(*) OVER (PARTITION BY forum, week_start) - 1) / 2.0 AS tt FROM pre),
long AS ({_OUT_UNION}),
per AS (SELECT outcome, forum, regr_slope(y, tt) AS slope, regr_sxx(y, tt) AS sxx, regr_syy(y, tt) AS syy,
               regr_sxy(y, tt) AS sxy, regr_count(y, tt) AS n FROM long GROUP BY 1, 2),
pooled AS (SELECT outcome, sum(syy - sxy * sxy / sxx) / (sum(n) - 2 * count(*)) AS s2,
                  sum(n) - 2 * count(*) AS df_resid,
                  max(CASE WHEN forum = '{PRETREND_REFERENCE}' THEN slope END) AS ref_slope,
                  max(CASE WHEN forum = '{PRETREND_REFERENCE}' THEN sxx END) AS ref_sxx
           FROM per GROUP BY outcome)"""


@register("pretrend_slopes", panel_sql(_PRETREND + f"""
SELECT outcome, forum, round(slope, 6) AS slope, round(slope - ref_slope, 6) AS interaction,
       round(sqrt(s2 * (1 / sxx + 1 / ref_sxx)), 6) AS se,
       round((slope - ref_slope) / sqrt(s2 * (1 / sxx + 1 / ref_sxx)), 6) AS t_stat,
       CAST(df_resid AS BIGINT) AS df_resid
FROM per JOIN pooled USING (outcome) WHERE forum <> '{PRETREND_REFERENCE}'"""))
def q_pretrend_slopes(spark, sf):
    """Pre-trend interaction slopes vs the reference forum, three outcomes."""
    return rounded(S.pretrend_slopes(orders_panel(spark, sf), PRETREND_OUTCOMES, "forum",
                                     PRETREND_REFERENCE, "week_start", ORDERS_EVENT_DATE))


_PT = "(slope - ref_slope) / sqrt(s2 * (1 / sxx + 1 / ref_sxx))"


@register("pretrend_test", panel_sql(_PRETREND + f"""
, s AS (SELECT outcome, forum, slope, slope - ref_slope AS interaction, sqrt(s2 * (1 / sxx + 1 / ref_sxx)) AS se, {_PT} AS t_stat,
               CAST(df_resid AS BIGINT) AS df_resid FROM per JOIN pooled USING (outcome) WHERE forum <> '{PRETREND_REFERENCE}'),
p AS (SELECT *, 1 - {central_duck('t_stat', 'df_resid')} AS p_value FROM s)
SELECT outcome, forum, round(slope, 6) AS slope, round(interaction, 6) AS interaction, round(se, 6) AS se, round(t_stat, 6) AS t_stat,
       df_resid, round(p_value, 6) AS p_value, CASE WHEN p_value < 0.05 THEN 'non-parallel' ELSE 'parallel' END AS verdict FROM p"""))
def q_pretrend_test(spark, sf):
    """H7/H8: pre-trend interactions with Student-t p-values and parallel/non-parallel labels."""
    return rounded(S.pretrend_test(orders_panel(spark, sf), PRETREND_OUTCOMES, "forum",
                                   PRETREND_REFERENCE, "week_start", ORDERS_EVENT_DATE))


_WIDE_COLS = ", ".join(f"sum(CASE WHEN forum = '{f}' THEN log_question_count END) AS c{i}"
                       for i, f in enumerate(ORDERS_FORUMS))
_CORR_PARTS = " UNION ALL ".join(
    f"SELECT '{per}' AS period, '{ORDERS_FORUMS[i]}' AS forum_a, '{ORDERS_FORUMS[j]}' AS forum_b, "
    f"round(CASE WHEN stddev_samp(CASE WHEN c{j} IS NOT NULL THEN c{i} END) > 0 "
    f"AND stddev_samp(CASE WHEN c{i} IS NOT NULL THEN c{j} END) > 0 THEN covar_samp(c{i}, c{j}) / "
    f"(stddev_samp(CASE WHEN c{j} IS NOT NULL THEN c{i} END) * stddev_samp(CASE WHEN c{i} IS NOT NULL "
    f"THEN c{j} END)) END, 6) AS corr FROM wide WHERE week_start {op} DATE '{ORDERS_EVENT_DATE}'"
    for per, op in (("pre", "<="), ("post", ">"))
    for i in range(len(ORDERS_FORUMS)) for j in range(i + 1, len(ORDERS_FORUMS)))


@register("corr_prepost", panel_sql(f"""
, wide AS (SELECT week_start, {_WIDE_COLS} FROM panel GROUP BY week_start)
{_CORR_PARTS}"""))
def q_corr_prepost(spark, sf):
    """Pairwise forum correlations of weekly log counts, pre (<=) and post (>)."""
    from ..operators.panel import pivot_wide
    wide = pivot_wide(stored_panel(spark, sf), "week_start", "forum", ["log_question_count"],
                      ORDERS_FORUMS)
    cols = [f"log_question_count_{f}" for f in ORDERS_FORUMS]
    return rounded(S.corr_prepost(wide, cols, ORDERS_FORUMS, "week_start", ORDERS_EVENT_DATE))
