import hashlib
from collections import Counter

import pytest
from helpers import docs_frame, edge_texts, empty_docs, words
from pyspark.sql import functions as F

from forumshift.llm import substrings


def brute(texts, k):
    """Texts that share id and text are one text; null ids are last."""
    order = sorted({(d is None, d or 0, t or "") for d, t in texts})
    # texts with equal ids are ordered by a hash: tests use unequal passages there
    first, gone = {}, {}
    for key in order:
        w = words(key[2])
        gone[key] = set()
        for i in range(len(w) - k + 1):
            g = tuple(w[i:i + k])
            if g in first:
                gone[key].update(range(i, i + k))
            else:
                first[g] = key
    out = []
    for d, t in texts:
        key = (d is None, d or 0, t or "")
        w = words(key[2])
        out.append((d, len(w), len(gone[key]), " ".join(x for i, x in enumerate(w) if i not in gone[key])))
    return out


@pytest.mark.parametrize("k", [20, 5])
def test_equal_to_brute_force(spark, k):
    texts = edge_texts(seed=11)
    got = Counter(map(tuple, substrings.drop_repeated_windows(docs_frame(spark, texts), words=k).collect()))
    assert got == Counter(brute(texts, k))


def test_levels_and_many_texts(spark):
    assert substrings.level_lengths(20) == [10, 20]
    assert substrings.level_lengths(50) == [13, 25, 50]
    texts = [(d, t) for d, t in edge_texts(seed=12) if d is not None]
    extra = [(20_000 + i, (texts[0][1] or "x") + f" tail{i} " + (texts[5][1] or "y")) for i in range(60)]
    got = Counter(map(tuple, substrings.drop_repeated_windows(docs_frame(spark, texts + extra), words=50).collect()))
    assert got == Counter(brute(texts + extra, 50))


def test_smallest_in_is_leftmost():
    import numpy as np
    rng = np.random.default_rng(1)
    for width in (1, 2, 3, 7, 11):
        x = rng.integers(0, 5, 60).astype(np.uint64)
        want = [i + int(np.argmin(x[i:i + width])) for i in range(60 - width + 1)]
        assert substrings.smallest_in(x, width).tolist() == want


def test_empty_table_and_digest(spark):
    assert substrings.drop_repeated_windows(empty_docs(spark)).collect() == []
    r = substrings.drop_repeated_windows(docs_frame(spark, [(1, None)])).select(F.sha2("kept", 256).alias("s")).collect()
    assert r[0].s == hashlib.sha256(b"").hexdigest()
