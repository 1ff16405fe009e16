import hashlib
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from forumshift.llm import prefix_trie as P

SCHEMA = "conv_id long, turn long, role string, text string, depth string, a1 string, p1 string, part string, salt string, o string"
COLUMNS = P.NODE


def frame(spark, rows):
    return spark.createDataFrame([(*r, *"xxxxxx") for r in rows], SCHEMA).repartition(3)


def in_order(rows):
    out = {}
    for c, turn, role, text in rows:
        if c is not None:
            out.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in out.items()}


def rebuilt(own):
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    return out


def trie(convs):
    """Every node by its path, walked level by level and back."""
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    leaves, saved, rows = {}, {}, set()
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) if p in kids else 1
        saved[p] = sum(saved[k] for k in kids.get(p, [])) + ((len(members[p]) - 1) * len(p[-1][1]) if p else 0)
    for p, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(convs[c]) == len(p))))
        rows.add((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids.get(p, [])), leaves[p], saved[p],
                  hashlib.sha256(ends.encode()).hexdigest()))
    return rows


def found(df):
    got = [tuple(r[c] for c in COLUMNS) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


def whole(spark, rows):
    return found(P.prefix_trie(*P.rebuilt(frame(spark, rows)), "o"))


def plain(spark, rows):
    t = P.turn_digests(frame(spark, rows))
    return found(P.prefix_trie(t, t.select("conv_id").distinct(), F.col("turn").asc_nulls_first(), "role", "text", "salt"))


def odd_rows(seed=3):
    rng = random.Random(seed)
    rows = []
    for c in [*range(0, 12), *range(100, 130), 250, 399, 1_000_000_007]:
        for t in range(rng.randrange(1, 9)):
            rows.append((c, t, rng.choice(["user", "assistant"]), rng.choice(["a", "é𝄞", "", "long " * 50, f"u{c}"])))
    rows += [(200, t, "user", f"t{t % 3}") for t in range(900)]  # cut by the range sort
    rows += [(c, t, "user", f"t{t % 3}") for c in (201, 202, 203) for t in range(0 if c < 203 else 880)]
    rows += [(204, None, None, None), (204, None, "user", "z"), (204, None, "user", "b"), (204, 1, None, "b"), (204, 1, None, "a")]
    rows += [(205, 7, "user", "same")] * 60 + [(206, 7, "user", "same")] * 40  # equal in everything
    rows += [(None, 0, "user", "nobody"), (7, 3, "user", None), (-5, 0, "user", "minus")]
    rng.shuffle(rows)
    return rows


def test_rebuilt_conversations_against_brute_force(spark):
    rows = [r for r in odd_rows() if r[0] != -5]
    assert whole(spark, rows) == trie(rebuilt(in_order(rows)))


def test_trie_of_given_conversations(spark):
    rows = odd_rows(4)
    assert plain(spark, rows) == trie(in_order(rows))


def test_crowded_sketch_changes_nothing(spark, monkeypatch):
    """Cells that many prefixes share send singletons to the exact grouping."""
    rows = odd_rows(5)
    monkeypatch.setattr(P, "LEAST_CELLS", 64)
    monkeypatch.setattr(P, "MOST_CELLS", 64)
    assert plain(spark, rows) == trie(in_order(rows))


def test_sketch_never_underestimates(spark):
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 300, 3000)
    d = spark.createDataFrame([(int(k) % 5, int(k) * 7919, -int(k)) for k in keys], "depth long, p1 long, p2 long").repartition(5)
    s = P.count_min(d, 256)
    u, n = np.unique(keys, return_counts=True)
    est = np.minimum.reduce([s[r, at] for r, at in enumerate(P.sketch_cells(u % 5, u * 7919, -u, 256))])
    assert (est >= np.minimum(n, 2)).all()


def test_long_id_lists_are_hashed_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(P, "CHUNK", 200)
    ids = list(range(-20, 3000, 7))
    d = spark.createDataFrame([(1, i) for i in ids] + [(2, 5)], "k long, conv_id long").repartition(4)
    got = {r.k: r.ends_sha256 for r in P.id_digests(d, ["k"]).collect()}
    assert got == {1: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), 2: hashlib.sha256(b"5").hexdigest()}


def test_empty_and_turnless(spark):
    assert whole(spark, []) == set() and plain(spark, [(None, 1, "user", "x")]) == set()
    c = next(c for c in range(501, 600) if zlib.crc32(str(c).encode()) % 6 > 0)
    rows = [(c, 0, "user", "gone")]  # its base is absent and its own turn goes
    assert whole(spark, rows) == trie({c: []}) and len(whole(spark, rows)) == 1
