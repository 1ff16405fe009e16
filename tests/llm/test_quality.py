import itertools
import random
from collections import Counter

import numpy as np
import pyarrow as pa
from helpers import WORD, docs_frame, edge_texts, empty_docs, sentence

from forumshift.llm import quality as Q


def rules(t):
    t = t or ""
    w, seen, dup = WORD.findall(t), set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    c = Counter(zip(w, w[1:], w[2:]))
    cover = {j for i, g in enumerate(zip(w, w[1:], w[2:])) if c[g] > 1 for j in (i, i + 1, i + 2)}
    return (len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), dup, len(cover), len(w) < 50 or 100 * len(cover) > 50 * len(w))


def odd_texts():
    rng = random.Random(1)
    texts = edge_texts(seed=14)
    lines = [sentence(rng, 6) for _ in range(8)]
    texts += [(500 + i, "\n".join(rng.choice(lines) + rng.choice(["", "", " "]) for _ in range(rng.randrange(1, 20)))) for i in range(15)]
    texts += [(600, "\n\n a\n\n a\na\n\r\na"), (601, "a b c a b c a b"), (602, "é|# ü|&\né|# ü|&\n" * 30), (603, "\n"), (604, "x\n" * 200)]
    return texts


def test_rules_equal_brute_force(spark):
    texts = odd_texts()
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
                  for r in Q.rate_texts(docs_frame(spark, texts), Q.empty_model()).collect())
    assert got == Counter((d, *rules(t)) for d, t in texts)


def random_model(rng):
    m = Q.empty_model()
    return {k: rng.normal(size=v.shape) for k, v in m.items()}


def test_viterbi_is_the_best_of_all_sequences():
    rng = np.random.default_rng(3)
    m = random_model(rng)
    lengths = [1, 5, 3, 7, 2]
    doc = np.repeat(np.arange(5), lengths)
    f = rng.integers(0, 2, (len(doc), len(Q.LIMITS)))
    got = Q.viterbi(m, f, doc, 6)
    for d, n in enumerate(lengths):
        x = Q._emissions(m, f[doc == d])

        def score(y):
            return m["start"][y[0]] + sum(x[i, v] for i, v in enumerate(y)) + sum(m["step"][a, b] for a, b in zip(y, y[1:]))
        best = max(itertools.product((0, 1), repeat=n), key=score)
        assert tuple(got[doc == d]) == best


def likelihood(m, f, doc, label, texts):
    total = 0.0
    for d in range(texts):
        x, y = Q._emissions(m, f[doc == d]), label[doc == d]

        def score(z):
            return m["start"][z[0]] + sum(x[i, v] for i, v in enumerate(z)) + sum(m["step"][a, b] for a, b in zip(z, z[1:]))
        every = [score(z) for z in itertools.product((0, 1), repeat=len(y))]
        total += score(tuple(y)) - np.logaddexp.reduce(every)
    return total


def test_training_raises_the_likelihood():
    rng = np.random.default_rng(4)
    doc = np.repeat(np.arange(12), 6)
    label = (rng.random(72) < 0.5).astype(np.int64)
    f = rng.integers(0, 2, (72, len(Q.LIMITS)))
    f[:, 0] = np.where(rng.random(72) < 0.85, label, 1 - label)
    m = Q.fit(f, doc, label, 12)
    start = likelihood({k: np.zeros_like(v) for k, v in m.items()}, f, doc, label, 12)
    assert likelihood(m, f, doc, label, 12) > start + 10
    assert (Q.viterbi(m, f, doc, 12) == label).mean() > 0.8


def test_held_out_accuracy(spark):
    """Fitted on labels of even ids, judged on odd ones of the given table."""
    sf = "/root/testdata/sf0.01"
    docs, labels = Q.table(spark, sf, "documents"), Q.table(spark, sf, "labels")
    model = Q.fit_line_model(docs, labels.filter("doc_id % 2 = 0"))
    got = {r.doc_id: r for r in Q.rate_texts(docs, model).collect()}
    held = [(got[r.doc_id], r.quality) for r in labels.filter("doc_id % 2 = 1").collect() if r.doc_id in got]
    judged = [(r.kept, q) for r, q in held if not r.base_failed]
    assert np.mean([k == (q > 0) for k, q in judged]) > 0.95
    assert np.mean([k for k, q in judged if q > 0]) > 0.97


def test_rows_columns_and_odd_tables(spark):
    texts = odd_texts()
    docs = docs_frame(spark, texts)
    kept = Q.keep_good_texts(docs, Q.empty_model())
    assert kept.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter((d, t) for d, t in texts if not rules(t)[-1])
    labels = spark.createDataFrame([(None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    model = Q.fit_line_model(docs, labels)
    assert all((model[k] == v).all() for k, v in Q.empty_model().items())
    assert Q.rate_texts(empty_docs(spark), model).collect() == []
    assert Q.judge(model, pa.array([], pa.string()))["kept"].tolist() == []


def test_blocks_of_long_texts_decode_like_one_chain(monkeypatch):
    rng = np.random.default_rng(8)
    m = random_model(rng)
    lengths = [1, 40, 9, 0, 27, 3, 8, 16]
    doc = np.repeat(np.arange(8), lengths)
    f = rng.integers(0, 3, (len(doc), len(Q.LIMITS)))
    whole = Q.viterbi(m, f, doc, 8)
    for block in (1, 2, 3, 8, 39):
        monkeypatch.setattr(Q, "BLOCK_LINES", block)
        assert Q.viterbi(m, f, doc, 8).tolist() == whole.tolist()


def test_memory_follows_lines_not_the_longest_text():
    """A child process judges 499 short texts and one of 600,000 lines in bounded memory."""
    import subprocess
    import sys
    code = ("import resource, sys; sys.path.insert(0, sys.argv[1]); import pyarrow as pa\n"
            "from forumshift.llm import quality as Q\n"
            "texts = ['a b c\\nd'] * 499 + [''.join(f'{i % 7919:04d}\\n' for i in range(600_000))]\n"
            "before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss\n"
            "Q.judge(Q.empty_model(), pa.array(texts))\n"
            "print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)")
    import os
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    assert int(subprocess.run([sys.executable, "-c", code, root], capture_output=True, text=True, check=True).stdout) < 300
