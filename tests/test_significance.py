import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from forumshift.functions.digests import md5_heads
from forumshift.operators import significance as S
from forumshift.operators.terms import TfidfResult

TERMS = ["a", "b", "rare"]


@pytest.fixture(scope="module")
def tested(spark):
    """Documents of two periods and of none, one id twice and one null; a term that never occurs is asked for too."""
    rng = np.random.default_rng(11)
    docs = [(int(d * 37), int(d % 3 != 0)) for d in range(120)] + [(37, 1), (None, 0), (999999, None)]
    long = [(d, p, t, 1, float(rng.uniform(0.01, 1))) for d, p in docs for t, share in (("a", 0.9), ("b", 0.4), ("rare", 0.03)) if rng.random() < share]
    res = TfidfResult(vocab=None, long=spark.createDataFrame(long, "doc_id long, pre int, term string, tf long, tfidf double"),
                      docs=spark.createDataFrame(docs, "doc_id long, pre int"))
    return docs, long, res


def _u(seed, rep, doc):
    return int(hashlib.md5(":".join([str(seed), str(rep), *([] if doc is None else [str(doc)])]).encode()).hexdigest()[:13], 16) / 2 ** 52


def test_digests_of_many_messages():
    heads, tails = [f"7:{r}".encode() for r in range(103)], [b"", b":0", b":-12", ":ä".encode() * 10, b":" + b"x" * 51, b":" + b"y" * 52, b"z" * 200]
    got = md5_heads(heads, tails)
    assert got.tolist() == [[int(hashlib.md5(h + t).hexdigest()[:16], 16) for h in heads] for t in tails]


def test_draws_are_the_uniform_column(spark):
    keys = [None, "0", "-5", "123456789012", "a:b", "x" * 80]
    got = S.draws(keys, 3, 12) / 2.0 ** 52
    df = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "i int, k string").withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(11))))
    want = {(r.i, r.rep): (r.u, r.w) for r in df.select("i", "rep", S.uniform(3, F.col("rep"), F.col("k")).alias("u"), S.poisson1_weight(S.uniform(3, F.col("rep"), F.col("k"))).alias("w")).collect()}
    cdf = np.array(S.poisson1_cdf())
    assert all((got[i, r], np.searchsorted(cdf, got[i, r], side="right")) == v for (i, r), v in want.items())


def _observed(docs, long):
    n = {p: sum(q == p for _, q in docs) for p in (0, 1)}
    s = {(t, p): sum(v for _, q, x, _, v in long if x == t and q == p) for t in (*TERMS, "never") for p in (0, 1)}
    return n, s


def _extreme(diff, obs):
    return abs(diff) >= abs(obs) * (1 - S.PERM_RTOL) - S.PERM_ATOL


def test_permutations_against_a_loop(tested):
    docs, long, res = tested
    n, s = _observed(docs, long)
    reps = 60
    frac = n[1] / (n[0] + n[1])
    loose = {r.term: r.perm_pvalue for r in S.permutation_test(res, [*TERMS, "never"], reps, 5).collect()}
    exact = {r.term: r.perm_pvalue for r in S.permutation_test_exact(res, [*TERMS, "never"], reps, 5).collect()}
    assert set(loose) == set(TERMS) and set(exact) == {*TERMS, "never"}
    for t in TERMS:
        obs = s[t, 0] / n[0] - s[t, 1] / n[1]
        hit = {"loose": 0, "exact": 0}
        for r in range(reps):
            u = {d: _u(5, r, d) for d, _ in docs}
            m = sum(u[d] < frac for d, _ in docs)
            sp = sum(v for d, _, x, _, v in long if x == t and u[d] < frac)
            hit["loose"] += _extreme((s[t, 0] + s[t, 1] - sp) / (len(docs) - m) - sp / m, obs)
            cut = sorted((u[d], -1 if d is None else d) for d, _ in docs)[n[1] - 1]
            sp = sum(v for d, _, x, _, v in long if x == t and (u[d], -1 if d is None else d) <= cut and (d is not None or u[d] < cut[0]))
            hit["exact"] += _extreme((s[t, 0] + s[t, 1] - sp) / n[0] - sp / n[1], obs)
        assert (loose[t], exact[t]) == pytest.approx((hit["loose"] / reps, hit["exact"] / reps)), t


def test_bootstrap_against_a_loop(tested):
    docs, long, res = tested
    reps, cdf = 40, np.array(S.poisson1_cdf())
    got = {r.term: (r.ci_lower, r.ci_upper) for r in S.bootstrap_ci(res, [*TERMS, "never"], reps, 2).collect()}
    assert set(got) == {*TERMS, "never"} and got["never"] == (0.0, 0.0)
    for t in TERMS:
        d_ = []
        for r in range(reps):
            w = {d: int(np.searchsorted(cdf, _u(2, r, d), side="right")) for d, _ in docs}
            mean = [sum(w[d] * v for d, q, x, _, v in long if x == t and q == p) / sum(w[d] for d, q in docs if q == p) for p in (0, 1)]
            d_.append(mean[0] - mean[1])
        assert got[t] == pytest.approx(tuple(np.percentile(d_, [2.5, 97.5])), abs=1e-12), t


def test_no_document_is_copied_for_a_replicate(tested, monkeypatch):
    """Rows that are repeated for each replicate are terms at most, never documents or values."""
    _, _, res = tested
    seen, real = [], S.with_replicates
    monkeypatch.setattr(S, "with_replicates", lambda df, n: (seen.append(df.count()), real(df, n))[1])
    for run in (lambda: S.permutation_test(res, TERMS, 5, 0), lambda: S.permutation_test_exact(res, TERMS, 5, 0), lambda: S.bootstrap_ci(res, TERMS, 5, 0)):
        assert run().count() == len(TERMS)
    assert max(seen, default=0) <= len(TERMS)
