from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from helpers import docs_frame, edge_texts, empty_docs, words

from forumshift.llm import mixing


def brute_targets(size):
    """Water filling step by step: the excess over three times a source's size is shared
    again by weight among the others until none is above."""
    order = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + ([None] if None in size else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    full, rest, free = {}, Fraction(sum(size.values())), set(order)
    while free:
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        above = {s for s in free if share[s] > 3 * size[s]}
        if not above:
            return full | share
        for s in above:
            full[s] = Fraction(3 * size[s])
            rest -= full[s]
        free -= above
    return full


def run(spark, docs):
    c = mixing.mix_copies(docs).collect()
    taken = defaultdict(int)
    for r in c:
        taken[r.source] += r.size * r.copies
        assert 0 <= r.copies <= 3 * r.rows
    return c, taken


@pytest.mark.parametrize("source", [lambda i: f"s{i % 5}", lambda i: None if i % 7 == 0 else ("hot" if i % 3 else f"é{i % 4}")])
def test_targets_and_words(spark, source):
    texts = edge_texts(seed=3) + [(50_000 + i, "a b c " * (1 + i % 40)) for i in range(400)]
    docs = docs_frame(spark, texts, source)
    c, taken = run(spark, docs)
    size = Counter()
    for i, (_, t) in enumerate(texts):
        size[source(i)] += len(words(t))
    want = brute_targets(dict(size))
    for r in c:
        assert r.source_size == size[r.source]
        assert abs(r.target - float(want[r.source])) < 1e-6 * max(1.0, r.target)
    for s, n in taken.items():
        largest = max(len(words(t)) for i, (_, t) in enumerate(texts) if source(i) == s)
        assert abs(n - float(want[s])) <= max(largest, 0.02 * float(want[s]))
    again, _ = run(spark, docs)
    assert Counter(again) == Counter(c)


def test_documents_repeat_as_often_as_taken(spark):
    texts = edge_texts(seed=4)
    docs = docs_frame(spark, texts)
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns
    rows = Counter((r.doc_id, r.source, len(words(r.text))) for r in mixed.collect())
    for r in mixing.mix_copies(docs).collect():
        assert rows[(r.id, r.source, r.size)] == r.copies


def test_expected_copies(spark):
    """Over seeds a document's mean number of copies is what it is due."""
    docs = docs_frame(spark, [(i, "x " * (5 + 3 * i)) for i in range(40)], lambda i: "a" if i < 30 else "b").cache()
    total, due = Counter(), {}
    for seed in range(12):
        for r in mixing.mix_copies(docs, seed=seed * 7).collect():
            total[r.id] += r.copies
            due[r.id] = r.target / r.source_size
    mean = sum(total.values()) / 12
    assert abs(mean - sum(due.values())) < 0.1 * sum(due.values())
    assert all(abs(total[i] / 12 - due[i]) < 0.75 for i in due)


def test_empty_table(spark):
    assert mixing.mix_copies(empty_docs(spark)).collect() == []
    assert mixing.mix_documents(empty_docs(spark)).collect() == []
    only = docs_frame(spark, [(1, None), (2, "")])
    assert {(r.id, r.target, r.size) for r in mixing.mix_copies(only).collect()} == {(1, 0.0, 0), (2, 0.0, 0)}


def test_many_equal_units_share_their_copies(spark):
    """Rows of one id, source and size are numbered in parts; together they get exactly what the mix takes."""
    texts = [(None, f"{i % 3} same size") for i in range(300)] + [(7, "same words here")] * 200 + [(i, "x " * 9) for i in range(100, 140)]
    docs = docs_frame(spark, texts, lambda i: "a" if i < 500 else "b")
    got = Counter((r.doc_id, r.source) for r in mixing.mix_documents(docs).collect())
    want = Counter()
    for r in mixing.mix_copies(docs).collect():
        want[r.id, r.source] += r.copies
    assert got == +want and got[None, "a"] > 100 and got[7, "a"] > 60
    assert Counter(r.text for r in mixing.mix_documents(docs).collect()) == Counter(r.text for r in mixing.mix_documents(docs).collect())
