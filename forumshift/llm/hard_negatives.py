"""Operator 13: hard negatives by rotated one-bit codes with exact bounds.

Every vector is turned by a random rotation and kept as the signs of its coordinates (one bit
each), its length and its alignment, the cosine between the vector and its code vector.  The
code vector's product with an anchor comes from population counts between the code and the
bit planes of the anchor's rounded coordinates.  Along the code vector the alignment turns it
into the vector's share of the product; what lies across it is bounded by Cauchy-Schwarz, as
is the anchor's rounding.  So each pair has an interval that holds its product for certain,
and only pairs whose interval can matter are scored, in integers.

Anchors are a stated query set: they go block by block (a bounded number of rows each) through
a scan of all rows, and each task keeps only its best rows for each anchor, or anchor and
positive.  No row is left out of the scan, and nothing depends on the bounds but time.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import LlmQuery
from .common import bounded_batches, process_cache, table, written

#: anchors that go through one scan of the rows
BLOCK = 20_000
#: bits of an anchor's rounded coordinates
PLANES = 8
#: rows of one task that are compared at once with one anchor
ROWS_AT_ONCE = 8192
#: share of an interval's scale that covers rounding in floating point
SLACK = 1e-9


def rotation(dim: int) -> np.ndarray:
    """A fixed random rotation of ``dim`` dimensions."""
    kept = process_cache()
    if ("rotation", dim) not in kept:
        q, r = np.linalg.qr(np.random.default_rng(dim).standard_normal((dim, dim)))
        kept["rotation", dim] = q * np.sign(np.diag(r))
    return kept["rotation", dim]


def codes(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed sign bits of the rotated rows of an integer matrix, their lengths and their
    alignments (0 for a zero vector)."""
    n, dim = v.shape
    r = v.astype(np.float64) @ rotation(dim).T
    length = np.sqrt((v.astype(np.float64) ** 2).sum(axis=1))
    align = np.abs(r).sum(axis=1) / math.sqrt(dim) / np.where(length > 0, length, 1)
    bits = np.zeros((n, -(-dim // 64) * 64), np.uint8)
    bits[:, :dim] = r > 0
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64), length, np.minimum(align, 1.0)


class Anchor:
    """An anchor's rotated coordinates, rounded to PLANES bits, as bit planes."""

    def __init__(self, v: np.ndarray):
        dim = len(v)
        self.v = v
        q = v.astype(np.float64) @ rotation(dim).T
        self.length = math.sqrt(float((v.astype(np.float64) ** 2).sum()))
        self.low = float(q.min())
        self.step = (float(q.max()) - self.low) / (2**PLANES - 1) or 1.0
        u = np.clip(np.rint((q - self.low) / self.step), 0, 2**PLANES - 1).astype(np.int64)
        self.error = float(np.sqrt(((q - self.low - self.step * u) ** 2).sum())) * (1 + SLACK)  # |q - rounded|
        self.sum = float(self.low * dim + self.step * u.sum())
        planes = np.zeros((PLANES, -(-dim // 64) * 64), np.uint8)
        planes[:, :dim] = u >> np.arange(PLANES)[:, None] & 1
        self.planes = np.packbits(planes, axis=1, bitorder="little").view(np.uint64)
        self.root = math.sqrt(dim)

    def interval(self, code: np.ndarray, length: np.ndarray, align: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds that hold the product with every coded row for certain."""
        ones = np.bitwise_count(code).sum(axis=1, dtype=np.int64)
        u = np.zeros(len(code), np.int64)
        for b, plane in enumerate(self.planes):
            u += np.bitwise_count(code & plane).sum(axis=1, dtype=np.int64) << b
        along = (2 * (self.low * ones + self.step * u) - self.sum) / self.root  # product of code vector and rounded anchor
        # the anchor along the code vector lies within its rounding error of that, its rest is across
        least = np.maximum(np.abs(along) - self.error, 0.0)
        across = np.sqrt(np.maximum(self.length**2 - least**2, 0.0) * np.maximum(1 - align**2, 0.0))
        width = length * (align * self.error + across + SLACK * self.length) + 1e-6
        middle = length * align * along
        return middle - width, middle + width


def scores(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Integer products: in floating point while those are exact, else in 64 bits."""
    top = float(np.abs(v).max(initial=0)) * float(np.abs(q).max(initial=0)) * len(q)
    if top < 2**53:
        return (v.astype(np.float64) @ q.astype(np.float64)).astype(np.int64)
    return v @ q


def best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: higher scores first, then smaller ids."""
    if len(score) > 4 * k:
        least = np.partition(score, len(score) - k)[len(score) - k]
        at = np.flatnonzero(score >= least)
    else:
        at = np.arange(len(score))
    return at[np.lexsort((ids[at], -score[at]))][:k]


class Top:
    """The k best (score, id) seen so far."""

    def __init__(self, k: int):
        self.k, self.score, self.ids = k, np.empty(0, np.int64), np.empty(0, np.int64)

    def bar(self) -> float:
        """A row must score this much to enter."""
        return float(self.score[-1]) if len(self.score) == self.k else -math.inf

    def add(self, score: np.ndarray, ids: np.ndarray) -> None:
        score, ids = np.concatenate([self.score, score]), np.concatenate([self.ids, ids])
        at = best(score, ids, self.k)
        self.score, self.ids = score[at], ids[at]


def coded(rows: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int) -> DataFrame:
    """``(id, label, v, code, length, align)`` of every row that takes part, written once."""
    bounded_batches(rows.sparkSession)
    def whole(x):  # null where there is no such number of 64 bits
        y = F.lit(scale) * x.cast("double")
        return F.when(~F.isnan(y) & (F.abs(y) < 2.0**62), F.floor(y).cast("double"))

    base = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"),
                       F.transform(F.col(vector_col), whole).alias("x"))
    most = F.lit(2.0**62) / F.size("x")
    base = base.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("x") > 0)
                       & F.forall("x", lambda x: F.coalesce(x * x < most, F.lit(False))))
    kind = base.schema["label"].dataType.simpleString()

    def run(batches):
        for b in batches:
            size = b.column("x").value_lengths().to_numpy()
            flat = pa.ListArray.flatten(b.column("x")).to_numpy(zero_copy_only=False)
            start = np.cumsum(size) - size
            for dim in np.unique(size):
                at = np.flatnonzero(size == dim)
                v = flat[start[at][:, None] + np.arange(dim)].astype(np.int64).reshape(len(at), dim)
                code, length, align = codes(v)
                own = b.take(pa.array(at))
                yield pa.RecordBatch.from_arrays(
                    [own.column("id"), own.column("label"), pa.array(np.full(len(at), dim, np.int32)),
                     pa.array([x.tobytes() for x in v], pa.binary()), pa.array([x.tobytes() for x in code], pa.binary()),
                     pa.array(length), pa.array(align)], names=["id", "label", "dim", "v", "code", "length", "align"])

    return written(base.mapInArrow(run, f"id long, label {kind}, dim int, v binary, code binary, length double, align double"), "codes")


def _groups(batches):
    """Batches of ROWS_AT_ONCE rows or so of one dimension: dim, ids, labels, v, code, length, align."""
    held: dict[int, list] = {}

    def joined(dim):
        own = held.pop(dim)
        col = lambda c: [b.column(c) for b in own]
        raw = lambda c, t, w: np.frombuffer(b"".join(x for a in col(c) for x in a.to_pylist()), t).reshape(-1, w)
        v, code = raw("v", np.int64, dim), raw("code", np.uint64, -(-dim // 64))
        num = lambda c: np.concatenate([a.to_numpy() for a in col(c)])
        return dim, num("id"), pa.chunked_array(col("label")), v, code, num("length"), num("align")

    for b in batches:
        dims = b.column("dim").to_numpy()
        for dim in np.unique(dims):
            held.setdefault(int(dim), []).append(b.filter(pa.array(dims == dim)))
            if sum(len(x) for x in held[int(dim)]) >= ROWS_AT_ONCE:
                yield joined(int(dim))
    for dim in list(held):
        yield joined(dim)


def _label_numbers(labels: pa.ChunkedArray, known: dict) -> np.ndarray:
    return np.array([known.get(x, -1) for x in labels.to_pylist()], np.int64)


def scan_positives(anchors: list[tuple], k: int):
    """Arrow task: its k best rows of each anchor's label, ``(qid, id, score)``; anchors are
    ``(qid, id, label, vector)``."""
    def run(batches):
        known = {x: i for i, x in enumerate(dict.fromkeys(a[2] for a in anchors))}
        asked = [(q, i, known[x], Anchor(v)) for q, i, x, v in anchors]
        tops = {q: Top(k) for q, *_ in asked}
        for dim, ids, labels, v, code, length, align in _groups(batches):
            label = _label_numbers(labels, known)
            own = {x: np.flatnonzero(label == x) for x in np.unique(label)}
            for q, i, x, a in asked:
                if len(a.v) != dim or x not in own:
                    continue
                at, top = own[x], tops[q]
                low, high = a.interval(code[at], length[at], align[at])
                mine = ids[at] != i
                bar = top.bar()
                if mine.sum() > k:  # k rows reach the k-th largest lower bound for certain
                    bar = max(bar, np.partition(low[mine], mine.sum() - k)[mine.sum() - k])
                at = at[mine & (high >= bar)]
                if len(at):
                    top.add(scores(v[at], a.v), ids[at])
        yield from emitted((q, None, t) for q, t in tops.items())
    return run


def scan_negatives(anchors: list[tuple], k: int):
    """Arrow task: for each anchor and positive its k best rows of other labels with a score
    in the positive's range, ``(qid, pos, id, score)``; anchors are ``(qid, id, label, vector,
    ranges)`` with ``(pos, least, most)`` for each positive."""
    def run(batches):
        known = {x: i for i, x in enumerate(dict.fromkeys(a[2] for a in anchors))}
        asked = [(q, i, known[x], Anchor(v), [(p, lo, hi, Top(k)) for p, lo, hi in ranges if lo <= hi]) for q, i, x, v, ranges in anchors]
        asked = [x for x in asked if x[4]]
        for dim, ids, labels, v, code, length, align in _groups(batches):
            label = _label_numbers(labels, known)
            for _, i, x, a, ranges in asked:
                if len(a.v) != dim:
                    continue
                low, high = a.interval(code, length, align)
                # what can enter any of the ranges: not above its end, not below its start or its k-th best
                least = min(max(lo, t.bar()) for _, lo, _, t in ranges)
                at = np.flatnonzero((label != x) & (high >= least) & (low <= max(r[2] for r in ranges)) & (ids != i))
                if not len(at):
                    continue
                s = scores(v[at], a.v)
                for _, lo, hi, t in ranges:
                    m = (s >= max(lo, t.bar())) & (s <= hi)
                    if m.any():
                        t.add(s[m], ids[at[m]])
        yield from emitted((q, p, t) for q, _, _, _, ranges in asked for p, _, _, t in ranges)
    return run


def emitted(tops):
    rows = [(q, p, t) for q, p, t in tops if len(t.ids)]
    for i in range(0, len(rows), 2000):
        part = rows[i:i + 2000]
        n = [len(t.ids) for *_, t in part]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat([q for q, _, _ in part], n), pa.int64()),
             pa.array(np.repeat([-1 if p is None else p for _, p, _ in part], n), pa.int32()),
             pa.array(np.concatenate([t.ids for *_, t in part])), pa.array(np.concatenate([t.score for *_, t in part]))],
            names=["qid", "pos", "id", "score"])


FOUND = "qid long, pos int, id long, score long"


def hard_negatives(rows: DataFrame, is_anchor, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                   scale: int = 256, positives: int = 5, negatives: int = 10, least_pct: int = 30, most_pct: int = 90) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    Components count as floor(scale * x); a score is an integer inner product.  Anchors are the
    rows where ``is_anchor`` (a condition on column ``id``) holds.  Each anchor's positives are its
    best other rows of the same label; for each, the best rows of other labels that score
    least_pct to most_pct percent of the positive.  Higher scores first, ties by smaller id.

    Rows without id, label, vector or any component, with a null or non-finite component, or
    with one so large that products leave 64 bits take no part.  Vectors of another number of components
    have no score with the anchor.  Rows that share an id are rows of their own; an anchor's
    id is never its own positive or negative; equal anchor rows ask once.
    """
    spark = rows.sparkSession
    all_ = coded(rows, id_col, vector_col, label_col, scale)
    asked = all_.filter(is_anchor).select("id", "label", "dim", "v").distinct()
    asked = written(asked.withColumn("qid", F.monotonically_increasing_id()).withColumn("part", F.rand(3)), "anchors")
    blocks = max(1, math.ceil(asked.count() / BLOCK))
    bounded_batches(spark)
    out = None
    for b in range(blocks):
        own = asked.filter((F.col("part") >= b / blocks) & (F.col("part") < (b + 1) / blocks)).toArrow()
        anchors = [(q, i, x, np.frombuffer(v, np.int64)) for q, i, x, v in zip(*(own.column(c).to_pylist() for c in ("qid", "id", "label", "v")))]
        if not anchors:
            continue
        order = lambda *c: Window.partitionBy(*c).orderBy(F.desc("score"), "id")
        near = all_.mapInArrow(scan_positives(anchors, positives), FOUND)
        near = written(near.withColumn("pos", F.row_number().over(order("qid"))).filter(F.col("pos") <= positives), "positives")
        ranges: dict[int, list] = {}
        for r in near.select("qid", "pos", "score").collect():  # at most BLOCK * positives rows
            ranges.setdefault(r.qid, []).append((r.pos, -(-least_pct * r.score // 100), most_pct * r.score // 100))
        far = all_.mapInArrow(scan_negatives([(*a, ranges[a[0]]) for a in anchors if a[0] in ranges], negatives), FOUND)
        far = far.withColumn("rank", F.row_number().over(order("qid", "pos"))).filter(F.col("rank") <= negatives)
        names = near.select("qid", "pos", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
        part = (far.join(names, ["qid", "pos"]).join(asked.select("qid", F.col("id").alias("anchor_id")), "qid")
                .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
                        "positive_score", F.col("score").alias("negative_score")))
        part = part if blocks == 1 else written(part, "negatives")
        out = part if out is None else out.unionByName(part)
    empty = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    return spark.createDataFrame([], empty) if out is None else out


SQL = r"""
WITH row_ AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                     list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
              FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
                AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pair AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same,
                CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) AS BIGINT) AS s
         FROM row_ a JOIN row_ b ON b.vec_id <> a.vec_id AND len(a.v) = len(b.v) WHERE a.vec_id % 100 = 0),
pos AS (SELECT a, b, s FROM pair WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5)
SELECT p.a AS anchor_id, p.b AS positive_id,
       CAST(row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.s DESC, n.b) AS INTEGER) AS rank,
       n.b AS negative_id, p.s AS positive_score, n.s AS negative_score
FROM pos p JOIN pair n ON n.a = p.a AND NOT n.same AND 30 * p.s <= 100 * n.s AND 100 * n.s <= 90 * p.s
QUALIFY row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.s DESC, n.b) <= 10
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every row whose id is divisible by 100, against all rows."""
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", label), F.expr("id % 100 = 0"))


QUERY = LlmQuery("op13_hard_negatives", query, SQL)
