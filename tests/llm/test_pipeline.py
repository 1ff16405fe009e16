from collections import Counter

import corpus_pipeline as P
import pytest
from helpers import words

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def frames(spark):
    out = [P.table(spark, SF, "documents")]
    for name, stage in P.STAGES:
        out.append(P.written(stage(spark, out[-1], SF), name))
    return out


def test_stages_take_effect_and_chain(spark, frames):
    columns = frames[0].columns
    before, good, single, clean, mixed, tokens = ([r.asDict() for r in f.collect()] for f in frames)
    assert all(f.columns == columns for f in frames[:-1])
    ids = [[r["doc_id"] for r in rows] for rows in (before, good, single, clean, mixed, tokens)]
    for a, b in zip(ids, ids[1:4]):
        assert set(b) < set(a) and len(b) == len(set(b))
    # rules: short texts went; near copies: no two kept texts are linked
    assert all(len(words(r["text"])) >= 50 for r in good)
    sets = {r["doc_id"]: {tuple(w[i:i + 5]) for i in range(len(w) - 4)} for r in single for w in [words(r["text"].lower())]}
    names = sorted(sets)
    for i, a in enumerate(names):
        for b in names[:i]:
            both = len(sets[a] & sets[b])
            assert 100 * both < 75 * (len(sets[a]) + len(sets[b]) - both)
    # leaks: no kept text holds a whole benchmark item
    items = [" ".join(words(r.text.lower())) for r in P.table(spark, SF, "benchmark").collect()]
    assert not any(i in " ".join(words(r["text"].lower())) for r in clean for i in items)
    # the mix: every source comes near its target
    size = Counter()
    taken = Counter()
    for r in clean:
        size[r["source"]] += len(words(r["text"]))
    for r in mixed:
        taken[r["source"]] += len(words(r["text"]))
    assert max(Counter(ids[4]).values()) <= 3
    assert abs(sum(taken.values()) - sum(size.values())) < 0.1 * sum(size.values())
    # token files hold every row of the mix in order
    assert Counter(ids[5]) == Counter(ids[4])
    rows = sorted(tokens, key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == sorted(ids[4])
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(rows, rows[1:]))


def test_run_equals_the_stages(spark, frames):
    rows = P.run(spark, SF).collect()
    assert rows and set(rows[0].asDict()) == {"doc_id", "start", "n_tokens", "ids_crc32"}
    assert Counter(rows) == Counter(frames[-1].collect())
