import math
import random

import numpy as np
import pytest

from forumshift.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<float>, label int, id string, v string, code string, qid string, score string, pos string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, *"xxxxxx") for r in rows], SCHEMA).repartition(5)


def brute(rows, every=10, positives=5, negatives=10):
    good = []
    for i, x, y in rows:
        if i is None or x is None or y is None or not x or any(c is None or not math.isfinite(c) for c in x):
            continue
        v = [math.floor(256 * float(np.float32(c))) for c in x]
        if max(map(abs, v)) ** 2 < 2**62 / len(v):
            good.append((i, y, tuple(v)))
    out = []
    for i, y, v in {g for g in good if g[0] % every == 0}:
        s = sorted((-sum(a * b for a, b in zip(v, w)), j, z) for j, z, w in good if j != i and len(w) == len(v))
        for ps, p, _ in [x for x in s if x[2] == y][:positives]:
            range_ = [x for x in s if x[2] != y and 30 * -ps <= 100 * -x[0] <= 90 * -ps][:negatives]
            out += [(i, p, r, n, -ps, -ns) for r, (ns, n, _) in enumerate(range_, 1)]
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.collect())


def vectors(n, dim=64, seed=1, clusters=6):
    rng = np.random.default_rng(seed)
    centre = rng.standard_normal((clusters, dim))
    rows = []
    for i in range(n):
        y = int(rng.integers(clusters))
        x = centre[y] * rng.uniform(0, 1.5) + rng.standard_normal(dim)
        rows.append((i, [float(c) for c in x / np.linalg.norm(x)], y % 4))
    return rows


def odd(rows, dim=64):
    rng = random.Random(3)
    flat = lambda c: [c] * dim
    rows = rows + [(1000, None, 1), (1010, flat(0.5), None), (None, flat(0.5), 1), (1020, flat(float("nan")), 1), (1030, flat(float("inf")), 1),
                   (1040, [None] + flat(0.1)[1:], 1), (1050, [], 1), (1060, flat(0.0), 1), (1070, flat(0.25), 2), (1071, flat(0.25), 2),
                   (1072, flat(0.25), 3), (1080, flat(1e9), 2), (1090, [0.5, 0.25], 1), (1091, [0.5, 0.5], 1), (1092, [0.25, 0.5], 2),
                   (1100, flat(-0.1), 1), (1100, flat(-0.1), 1), (1100, flat(0.2), 2), (7, rows[7][1], 2), (8, rows[8][1], rows[8][2])]
    rng.shuffle(rows)
    return rows


def test_rows_against_brute_force(spark):
    rows = odd(vectors(400))
    got = found(H.hard_negatives(frame(spark, rows), "id % 10 = 0"))
    assert got == brute(rows) and len(got) > 300


@pytest.mark.parametrize("dim", [3, 65, 130])
def test_other_dimensions(spark, dim):
    rows = vectors(150, dim, dim)
    assert found(H.hard_negatives(frame(spark, rows), "id % 10 = 0")) == brute(rows)


def test_blocks_of_anchors_and_rows(spark, monkeypatch):
    monkeypatch.setattr(H, "BLOCK", 7)
    monkeypatch.setattr(H, "ROWS_AT_ONCE", 20)
    rows = odd(vectors(200, seed=5))
    assert found(H.hard_negatives(frame(spark, rows), "id % 10 = 0")) == brute(rows)


def test_few_rows_and_empty_table(spark):
    assert found(H.hard_negatives(frame(spark, []), "id % 10 = 0")) == []
    rows = [(0, [1.0, 0.0], 1), (1, [0.9, 0.1], 1), (2, [0.5, 0.5], 2)]
    assert found(H.hard_negatives(frame(spark, rows), "id % 10 = 0")) == brute(rows) == [(0, 1, 1, 2, 58880, 32768)]


@pytest.mark.parametrize("scale", [1, 1e6])
def test_intervals_hold_every_product(scale):
    rng = np.random.default_rng(2)
    v = np.floor(rng.standard_normal((500, 64)) * 256 * scale).astype(np.int64)
    v[0], v[1] = 0, v[2]
    v[3:60] = v[3] + rng.integers(-3, 3, (57, 64))
    code, length, align = H.codes(v)
    share = []
    for q in v[:80]:
        low, high = H.Anchor(q).interval(code, length, align)
        s = H.scores(v, q)
        assert (low <= s).all() and (s <= high).all()
        share.append(((high - low) / np.maximum(2 * length * np.linalg.norm(q.astype(float)), 1)).mean())
    assert np.mean(share) < 0.75  # far inside what Cauchy-Schwarz alone gives
