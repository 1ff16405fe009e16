from collections import Counter

from helpers import ascii_lower, docs_frame, edge_texts, empty_docs, words

from forumshift.llm import ngram_join


def brute(texts):
    sets = []
    for _, t in texts:
        w = words(ascii_lower(t or ""))
        sets.append(frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    group = list(range(len(texts)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                group[top(i)] = top(j)
    names = {}
    for i, (d, _) in enumerate(texts):
        if d is not None:
            g = top(i)
            names[g] = min(names.get(g, d), d)
    return sets, [top(i) for i in range(len(texts))], [names.get(top(i)) for i in range(len(texts))]


def test_components_equal_brute_force(spark):
    texts = edge_texts()
    got = Counter(map(tuple, ngram_join.ngram_components(docs_frame(spark, texts)).collect()))
    sets, _, names = brute(texts)
    assert got == Counter((d, len(s), n) for (d, _), s, n in zip(texts, sets, names))


def test_large_near_copy_group_is_cut_into_bins(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BIN_ROWS", 4)
    monkeypatch.setattr(ngram_join, "COLUMNS_AT_ONCE", 16)
    texts = [(d, t) for d, t in edge_texts(seed=8) if d is not None]
    got = Counter(map(tuple, ngram_join.ngram_components(docs_frame(spark, texts)).collect()))
    sets, _, names = brute(texts)
    assert got == Counter((d, len(s), n) for (d, _), s, n in zip(texts, sets, names))


def test_one_row_of_each_group_stays(spark):
    texts = edge_texts()
    docs = docs_frame(spark, texts)
    kept = ngram_join.drop_near_copies(docs)
    assert kept.columns == docs.columns
    _, group, _ = brute(texts)
    owner = {}
    for (d, t), g in zip(texts, group):
        owner.setdefault((d, t), set()).add(g)
    got = Counter((r.doc_id, r.text) for r in kept.collect())
    filled = {k: n for k, n in got.items() if words(k[1])}
    assert all(n == 1 for n in filled.values())
    groups = [next(iter(owner[k])) for k in filled]
    want = {g for (d, t), g in zip(texts, group) if words(t)}
    assert sorted(groups) == sorted(want)
    best = {}
    for (d, t), g in zip(texts, group):
        if d is not None and words(t):
            best[g] = min(best.get(g, d), d)
    assert all(k[0] == best.get(g) for k, g in zip(filled, groups))
    assert sum(n for k, n in got.items() if not words(k[1])) == sum(not words(t) for _, t in texts)


def test_empty_table(spark):
    assert ngram_join.ngram_components(empty_docs(spark)).collect() == []
    assert ngram_join.drop_near_copies(empty_docs(spark)).collect() == []


def test_common_columns_are_collapsed(spark, monkeypatch):
    """Tiny limits: most columns are common, ranks stop at two, rows are dealt a few at a time."""
    monkeypatch.setattr(ngram_join, "COMMON", 2)
    monkeypatch.setattr(ngram_join, "DEAL_ROWS", 5)
    monkeypatch.setattr(ngram_join, "BIN_ROWS", 6)
    texts = edge_texts(seed=21)
    extra = [(9000 + i, " ".join(texts[0][1].split()[:20]) + f" t{i} " + (texts[4][1] or "")) for i in range(30)]
    got = Counter(map(tuple, ngram_join.ngram_components(docs_frame(spark, texts + extra)).collect()))
    sets, _, names = brute(texts + extra)
    assert got == Counter((d, len(s), n) for (d, _), s, n in zip(texts + extra, sets, names))
