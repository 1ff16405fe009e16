"""Operator 1: n-gram Jaccard join as a blocked sparse matrix product.

The incidence matrix has a row for each *distinct* n-gram set (copies collapse into one
row by a signature) and a column for each n-gram.  Columns are dealt in blocks (ranges
of the n-gram's hash); a block's task sees, for each of its columns, the rows that hold
it.  Three size-derived bounds keep the product small, all of them exact:

* a linked pair with sizes a <= b overlaps in at least ``ceil(t * b)`` n-grams, so a row
  can only be linked if at least ``ceil(t * size)`` of its n-grams occur in other rows;
* the same bound on the part of the row with the smallest hashes (40 %) already removes
  most rows before their whole sets are exchanged;
* among a row's n-grams ordered by rarity (counts up to ``COMMON``, then by hash), only the ``shared - ceil(t * size) + 1``
  rarest shared columns have to be multiplied: a linked pair meets in one of them.

Rows that meet are multiplied by their whole sets.  Rows of one group of near copies all
meet each other, so no pair of rows is ever a row of a table: first each row is tested
against one or two leaders of its cluster, which joins most of a group, then clusters are
cut into bins of bounded size and pairs of bins are multiplied where they hold different
components (or meet in a column).  A bin pair returns a spanning forest of the links it
found; no link between different components is lost.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import LlmQuery
from .common import (LOWER, U64, as_binary, bit_table, block_count, block_of, bounded_batches, hits, in_bit_table,
                     mix, table, text_buffer, windows, word_hashes, word_spans, written)
from .components import connected_components

#: share (per cent) of a row's n-grams, beyond those that a link may miss, in the first part
EXTRA_PCT = 15
#: a column is common from so many rows on; ranks of rarity stop there
COMMON = 50
#: rows, or set entries, that are dealt together
DEAL_ROWS, DEAL_ENTRIES = 5000, 4_000_000
#: rows and set entries of a bin, about; columns of one dense product
BIN_ROWS, BIN_ENTRIES, COLUMNS_AT_ONCE = 256, 200_000, 4096


def shingle_sets(arr: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of each text, ascending, and the offsets of the texts."""
    a, offsets = text_buffer(arr)
    a = LOWER[a]
    s, e, doc = word_spans(a, offsets)
    h = word_hashes(a, s, e)
    x, at = windows(h, doc, n)
    owner = doc[at]
    count = np.bincount(doc, minlength=len(arr))
    for k in range(1, n):  # shorter texts: the whole sequence is the only n-gram
        few = count[doc] == k
        y, first = windows(h[few], doc[few], k)
        x, owner = np.concatenate([x, y]), np.concatenate([owner, doc[few][first]])
    order = np.lexsort((x, owner))
    x, owner = x[order], owner[order]
    keep = np.ones(len(x), bool)
    keep[1:] = (x[1:] != x[:-1]) | (owner[1:] != owner[:-1])
    x, owner = x[keep], owner[keep]
    return x, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(arr)))]).astype(np.int64)


def signatures(x: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A 63-bit signature of each set (0: empty set)."""
    n = np.diff(off)
    g = np.concatenate([[U64(0)], np.cumsum(mix(x + U64(0x9E3779B97F4A7C15)), dtype=U64)])
    g2 = np.concatenate([[U64(0)], np.cumsum(mix(x ^ U64(0xC2B2AE3D27D4EB4F)), dtype=U64)])
    sig = mix((g[off[1:]] - g[off[:-1]]) ^ mix(g2[off[1:]] - g2[off[:-1]] + n.astype(U64)))
    return np.where(n > 0, np.maximum(sig >> U64(1), U64(1)), U64(0)).astype(np.int64)


def need(n, pct: int):
    """Smallest overlap of a row of n n-grams with a linked row: ceil(pct * n / 100)."""
    return -(-n * pct // 100)


def extra(n):
    return np.maximum(1, n * EXTRA_PCT // 100)


def _blocks(x, owner, sig, block, weight):
    """Rows (block, sigs, hashes, local rows, weights) of a part of the incidence matrix."""
    order = np.argsort(block, kind="stable")
    x, owner, block, weight = x[order], owner[order], block[order], weight[order]
    cuts = np.flatnonzero(np.diff(block, prepend=-2))
    ends = np.append(cuts[1:], len(block)).astype(np.int64)
    out = {"block": [], "sigs": [], "hashes": [], "rows": [], "weights": []}
    for i, j in zip(cuts, ends):
        used, local = np.unique(owner[i:j], return_inverse=True)
        out["block"].append(int(block[i]))
        out["sigs"].append(sig[used].astype(np.int64))
        out["hashes"].append(x[i:j])
        out["rows"].append(local.astype(np.uint16 if len(used) < 65536 else np.uint32))
        out["weights"].append(weight[i:j].astype(np.uint8))
    return pa.RecordBatch.from_arrays(
        [pa.array(out["block"], pa.int32())] + [as_binary(out[c]) for c in ("sigs", "hashes", "rows", "weights")],
        names=["block", "sigs", "hashes", "rows", "weights"])


BLOCK_SCHEMA = "block int, sigs binary, hashes binary, rows binary, weights binary"


def _deal(x, owner, sig, blocks, most):
    """A batch's entries by column block.  A column that more than ``most`` of the batch's
    rows hold is known to be common: one entry with weight ``COMMON`` stands for them in the
    column's block, and the rows themselves are answered on the spot (block -1).  So a block
    gets few entries of a column however many rows hold it."""
    u, first, back, n = np.unique(x, return_index=True, return_inverse=True, return_counts=True)
    common = (n > most)[back]
    if common.any():
        at = first[n > most]
        yield _blocks(x[common], owner[common], sig, np.full(int(common.sum()), -1), np.full(int(common.sum()), COMMON))
        yield _blocks(np.concatenate([x[~common], x[at]]), np.concatenate([owner[~common], owner[at]]), sig,
                      np.concatenate([block_of(x[~common], blocks), block_of(x[at], blocks)]),
                      np.concatenate([np.ones(int((~common).sum())), np.full(len(at), COMMON)]))
    else:
        yield _blocks(x, owner, sig, block_of(x, blocks), np.ones(len(x)))


def _by_block(df: DataFrame):
    """Groups of one column block; answers on the spot are dealt by their rows."""
    return df.groupBy("block", F.when(F.col("block") < 0, F.crc32("sigs")).otherwise(0))


def describe(n: int):
    def run(batches):
        for b in batches:
            x, off = shingle_sets(b.column("t"), n)
            yield pa.RecordBatch.from_arrays(
                [b.column("k"), b.column("v"), pa.array(np.diff(off)), pa.array(signatures(x, off))],
                names=["k", "v", "n", "sig"])
    return run


def first_parts(n: int, pct: int, blocks: int):
    """The part with the smallest hashes of every distinct set, dealt in column blocks."""
    def run(batches):
        for b in batches:
            x, off = shingle_sets(b.column(1), n)
            sig = signatures(x, off)
            _, once = np.unique(sig, return_index=True)
            take = np.zeros(len(sig), bool)
            take[once] = True
            size = np.diff(off)
            part = size - need(size, pct) + extra(size)
            owner = np.repeat(np.arange(len(size)), size)
            keep = take[owner] & (np.arange(len(x)) - off[owner] < part[owner])
            if keep.any():
                yield from _deal(x[keep], owner[keep], sig, blocks, 1)
    return run


def whole_sets(n: int, filled: np.ndarray):
    """(sig, n, grams) of every distinct set of a batch that passes the bit table."""
    def run(batches):
        for b in batches:
            x, off = shingle_sets(b.column(1), n)
            sig = signatures(x, off)
            once = np.unique(sig, return_index=True)[1]
            once = once[(off[once + 1] > off[once]) & in_bit_table(filled, sig[once])]
            if len(once):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(sig[once]), pa.array(np.diff(off)[once]),
                     as_binary([x[off[i]:off[i + 1]] for i in once])], names=["sig", "n", "grams"])
    return run


def deal_sets(blocks: int):
    """Whole sets dealt in column blocks, some thousand rows at a time."""
    def run(batches):
        sigs, grams, size = [], [], 0
        for b in chain(batches, [None]):
            if b is not None:
                sigs.append(b.column(0).to_numpy(zero_copy_only=False))
                grams += [np.frombuffer(v.as_buffer(), U64) for v in b.column(2)]
                size += sum(len(g) for g in grams[-b.num_rows:]) if b.num_rows else 0
            if grams and (b is None or len(grams) >= DEAL_ROWS or size >= DEAL_ENTRIES):
                owner = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
                yield from _deal(np.concatenate(grams), owner, np.concatenate(sigs), blocks, COMMON)
                sigs, grams, size = [], [], 0
    return run


def _columns(t: pa.Table):
    """Sorted distinct (column, row) entries of a block that need an answer, and the number of
    rows that hold their column (at most ``COMMON``)."""
    h, s, w = [], [], []
    for sigs, hashes, rows, weights in zip(*(t.column(c) for c in ("sigs", "hashes", "rows", "weights"))):
        sig, x = np.frombuffer(sigs.as_buffer(), np.int64), np.frombuffer(hashes.as_buffer(), U64)
        local = np.frombuffer(rows.as_buffer(), np.uint16 if len(sig) < 65536 else np.uint32)
        h.append(x)
        s.append(sig[local])
        w.append(np.frombuffer(weights.as_buffer(), np.uint8).astype(np.int64))
    h, s, w = np.concatenate(h), np.concatenate(s), np.concatenate(w)
    if t.column("block")[0].as_py() < 0:
        return h, s, w
    order = np.lexsort((-w, s, h))
    h, s, w = h[order], s[order], w[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (s[1:] != s[:-1])
    h, s, w = h[keep], s[keep], w[keep]
    start = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
    count = np.minimum(np.add.reduceat(w, start), COMMON)
    count = np.repeat(count, np.diff(np.append(start, len(h))))
    ask = w == 1
    return h[ask], s[ask], count[ask]


def count_shared(t: pa.Table) -> pa.Table:
    h, s, count = _columns(t)
    sig, shared = np.unique(s[count > 1], return_counts=True)
    return pa.table({"sig": pa.array(sig, pa.int64()), "shared": pa.array(shared, pa.int64())})


def shared_columns(t: pa.Table) -> pa.Table:
    """For each row of the block: its shared columns and their counts."""
    h, s, count = _columns(t)
    m = count > 1
    h, s, count = h[m], s[m], count[m].astype(np.uint8)
    order = np.argsort(s, kind="stable")
    h, s, count = h[order], s[order], count[order]
    cut = np.flatnonzero(np.append(True, s[1:] != s[:-1])) if len(s) else np.empty(0, np.int64)
    end = np.append(cut[1:], len(s)).astype(np.int64)
    return pa.table({"sig": pa.array(s[cut], pa.int64()),
                     "grams": as_binary([h[i:j] for i, j in zip(cut, end)]),
                     "counts": as_binary([count[i:j] for i, j in zip(cut, end)])})


def candidates(pct: int):
    """Rows that may have a link: their shared columns (``grams``; what others do not hold
    adds nothing to an overlap) and the rarest of them, in which a linked row must meet."""
    def run(batches):
        for b in batches:
            out = []
            for sig, size, grams, counts in zip(*(b.column(i) for i in range(4))):
                x = np.frombuffer(b"".join(grams.as_py()), U64)
                k = len(x) - need(size.as_py(), pct) + 1
                if k > 0:
                    c = np.frombuffer(b"".join(counts.as_py()), np.uint8)
                    out.append((sig.as_py(), size.as_py(), x[np.lexsort((x, c))[:k]].view(np.int64), np.sort(x)))
            if out:
                sig, size, rare, grams = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(sig, pa.int64()), pa.array(size, pa.int64()), pa.array(rare, pa.list_(pa.int64())), as_binary(grams)],
                    names=["sig", "n", "rare", "grams"])
    return run


def overlaps(pct: int):
    """Pairs with both rows' shared columns and sizes -> those that are linked."""
    def run(batches):
        for batch in batches:
            a, b, ga, gb = (batch.column(i) for i in range(4))
            na, nb = (batch.column(i).to_numpy(zero_copy_only=False) for i in (4, 5))
            both = np.array([len(np.intersect1d(np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64), assume_unique=True))
                             for x, y in zip(ga, gb)], np.int64)
            m = pa.array(100 * both >= pct * (na + nb - both))
            yield pa.RecordBatch.from_arrays([a.filter(m), b.filter(m)], names=["a", "b"])
    return run


def product(pct: int):
    """Task of one pair of bins: overlap counts of all their rows, as a dense product over
    blocks of the columns that both bins hold.  Returns a spanning forest of the links
    between different labels (all that components need)."""
    def run(t: pa.Table) -> pa.Table:
        side = t.column("side").to_numpy() if "side" in t.column_names else np.ones(t.num_rows, np.int64)
        sig, label = t.column("sig").to_numpy(), t.column("label").to_numpy()
        grams = [np.frombuffer(g.as_buffer(), U64) for g in t.column("grams")]
        size, held = t.column("n").to_numpy(), np.array([len(g) for g in grams])
        one = np.flatnonzero(side == 1)
        two = np.flatnonzero(side == 2) if (side == 2).any() else one
        x1, r1 = np.concatenate([grams[i] for i in one]), np.repeat(np.arange(len(one)), held[one])
        x2, r2 = np.concatenate([grams[i] for i in two]), np.repeat(np.arange(len(two)), held[two])
        both = np.intersect1d(x1, x2)
        if two is one:
            both, n = np.unique(x1, return_counts=True)
            both = both[n > 1]
        count = np.zeros((len(one), len(two)), np.float32)
        at1, at2 = (np.searchsorted(both, x) for x in (x1, x2))
        ok1 = both[np.minimum(at1, len(both) - 1)] == x1 if len(both) else np.zeros(len(x1), bool)
        ok2 = both[np.minimum(at2, len(both) - 1)] == x2 if len(both) else np.zeros(len(x2), bool)
        for c in range(0, len(both), COLUMNS_AT_ONCE):
            m1, m2 = (ok & (at >= c) & (at < c + COLUMNS_AT_ONCE) for ok, at in ((ok1, at1), (ok2, at2)))
            a = np.zeros((len(one), COLUMNS_AT_ONCE), np.float32)
            b = np.zeros((len(two), COLUMNS_AT_ONCE), np.float32)
            a[r1[m1], at1[m1] - c] = 1
            b[r2[m2], at2[m2] - c] = 1
            count += a @ b.T
        count = count.astype(np.int64)
        union = size[one][:, None] + size[two][None, :] - count
        i, j = np.nonzero((100 * count >= pct * union) & (label[one][:, None] != label[two][None, :]))
        name = {}

        def top(v):
            while name.setdefault(v, v) != v:
                name[v] = v = name[name[v]]
            return v

        out = []
        for v, w, lv, lw in zip(sig[one[i]], sig[two[j]], label[one[i]], label[two[j]]):
            p, q = top(lv), top(lw)
            if p != q:
                name[p] = q
                out.append((min(v, w), max(v, w)))
        return pa.table({"a": pa.array([v for v, _ in out], pa.int64()), "b": pa.array([w for _, w in out], pa.int64())})
    return run


def _bins(rows: DataFrame) -> DataFrame:
    """Adds ``bin`` and ``only`` (the label, where a bin has one alone) to rows
    ``(sig, n, cluster, label)``.  Rows of a large label share bins with no other label."""
    per = rows.groupBy("cluster", "label").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    per = per.withColumn("only", F.when((F.col("c") >= BIN_ROWS / 2) | (F.col("s") >= BIN_ENTRIES / 2), F.col("label")))
    parts = per.groupBy("cluster", "only").agg(F.greatest(
        F.ceil(F.sum("c") / BIN_ROWS), F.ceil(F.sum("s") / BIN_ENTRIES)).alias("parts"))
    parts = parts.withColumn("key", F.coalesce("only", F.lit(-1)))
    per = (per.select("cluster", "label", F.coalesce("only", F.lit(-1)).alias("key"))
           .join(parts, ["cluster", "key"]).select("cluster", "label", "only", "key", "parts"))
    return (rows.join(per, ["cluster", "label"])
            .withColumn("bin", F.xxhash64("cluster", "key", F.pmod(F.xxhash64("sig"), F.col("parts"))))
            .select("sig", "cluster", "label", "only", "bin"))


def _clusters(columns: DataFrame) -> DataFrame:
    """``(sig, n, cluster)``: rows that lead most of each other's columns share a cluster.
    No test yet; clusters only decide which rows are multiplied together first."""
    lead = columns.groupBy("gram").agg(F.min("sig").alias("cluster"))
    rows = written(columns.join(lead, "gram").groupBy("sig", "cluster").agg(F.count("*").alias("c"), F.first("n").alias("n"))
                   .groupBy("sig").agg(F.max_by("cluster", F.struct("c", "cluster")).alias("cluster"), F.first("n").alias("n")),
                   "clusters")
    for _ in range(2):  # then the cluster that most of a row's columns mostly belong to
        mode = (columns.join(rows.select("sig", "cluster"), "sig").groupBy("gram", "cluster").agg(F.count("*").alias("c"))
                .groupBy("gram").agg(F.max_by("cluster", F.struct("c", "cluster")).alias("cluster")))
        rows = written(columns.join(mode, "gram").groupBy("sig", "cluster").agg(F.count("*").alias("c"), F.first("n").alias("n"))
                       .groupBy("sig").agg(F.max_by("cluster", F.struct("c", "cluster")).alias("cluster"), F.first("n").alias("n")),
                       "clusters")
    return rows


def _row_links(full: DataFrame, pct: int, rounds: int) -> DataFrame | None:
    """Component label of every row that has a link (None: there is none)."""
    def labelled(rows, labels):
        if labels is None:
            return rows.withColumn("label", F.col("sig"))
        return (rows.join(labels.withColumnRenamed("v", "sig"), "sig", "left")
                .withColumn("label", F.coalesce("label", "sig")))

    links, labels = None, None

    def add(found):
        nonlocal links, labels
        found = written(found, "links")
        if not found.isEmpty():
            links = found if links is None else links.union(found)
            labels = connected_components(links)

    columns = full.select(F.explode("rare").alias("gram"), "sig", "n")
    rows = _clusters(columns)
    large = (rows.groupBy("cluster").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
             .filter((F.col("c") > BIN_ROWS) | (F.col("s") > BIN_ENTRIES)).select("cluster"))
    large = rows.join(large, "cluster", "left_semi")
    big = hits(full.select("sig", "grams"), "sig", bit_table(large, "sig")).join(large, "sig")
    for r in range(rounds):  # clusters of several bins: each row with one row of the largest label
        now = labelled(big, labels)
        lead = (now.groupBy("cluster", "label").agg(F.count("*").alias("c"), F.min_by(F.struct("sig", "n", "grams"), F.xxhash64(F.lit(r), "sig")).alias("x"))
                .groupBy("cluster").agg(F.max_by(F.struct("label", "x"), F.struct("c", "label")).alias("y"))
                .select("cluster", F.col("y.label").alias("ll"), F.col("y.x.sig").alias("lead"), F.col("y.x.n").alias("ln"), F.col("y.x.grams").alias("lg")))
        near = 100 * F.least("n", "ln") >= pct * F.greatest("n", "ln")
        add(now.join(lead, "cluster").filter((F.col("label") != F.col("ll")) & near)
            .select(F.col("sig").alias("a"), F.col("lead").alias("b"), F.col("grams").alias("ga"), F.col("lg").alias("gb"), "n", "ln")
            .mapInArrow(overlaps(pct), "a long, b long"))
    # what is left: bins of rows, each with itself, and pairs of bins that may hold a link between labels
    rows = written(_bins(labelled(rows, labels)), "bins")
    dealt = full.select("sig", "n", "grams").join(rows.select("sig", "label", "bin"), "sig")
    bins = rows.groupBy("cluster", "bin", "only").agg(F.min("label").alias("l0"), F.max("label").alias("l1"))

    alone = (dealt.join(bins.filter("l0 < l1").select("bin"), "bin", "left_semi").select("bin", "sig", "n", "label", "grams")
             .groupBy("bin").applyInArrow(product(pct), "a long, b long"))
    # pairs of bins of one cluster
    one, two = (bins.select("cluster", F.col("bin").alias(f"bin{i}"), F.col("only").alias(f"only{i}")) for i in (1, 2))
    differ = F.col("only1").isNull() | F.col("only2").isNull() | (F.col("only1") != F.col("only2"))
    inside = one.join(two, "cluster").filter("bin1 < bin2").filter(differ).select("bin1", "bin2")
    # a row that meets a larger cluster in a column is a guest there, in bins of that cluster's guests
    sizes = rows.groupBy("cluster").agg(F.count("*").alias("c"))
    held = columns.select("gram", "sig").join(rows.select("sig", "cluster"), "sig").join(sizes, "cluster")
    mixed = held.groupBy("gram").agg(F.min("cluster").alias("c1"), F.max("cluster").alias("c2")).filter("c1 < c2").select("gram")
    held = held.join(mixed, "gram", "left_semi")
    hosts = held.select("gram", F.col("cluster").alias("host"), F.col("c").alias("hc")).distinct()
    guests = (held.join(hosts, "gram").filter("hc > c or (hc = c and host > cluster)").select("sig", "host").distinct())
    guests = written(guests, "guests")
    parts = guests.groupBy("host").agg(F.ceil(F.count("*") / BIN_ROWS).alias("parts"))
    guests = (guests.join(parts, "host").withColumn("bin1", F.xxhash64("host", F.lit("guests"), F.pmod(F.xxhash64("sig"), F.col("parts"))))
              .join(bins.select(F.col("cluster").alias("host"), F.col("bin").alias("bin2")), "host").select("sig", "bin1", "bin2"))
    by_bin = (inside.select("bin1", "bin2", F.col("bin1").alias("bin"), F.lit(1).alias("side"))
              .union(inside.select("bin1", "bin2", F.col("bin2").alias("bin"), F.lit(2).alias("side")))
              .union(guests.select("bin1", "bin2", F.col("bin2").alias("bin"), F.lit(2).alias("side")).distinct()))
    sided = written(by_bin.join(rows, "bin").select("bin1", "bin2", "side", "sig").union(guests.select("bin1", "bin2", F.lit(1).alias("side"), "sig")),
                    "bin-pairs")
    crossed = (sided.join(dealt.join(sided.select("sig").distinct(), "sig", "left_semi"), "sig")
               .select("bin1", "bin2", "side", "sig", "n", "label", "grams")
               .groupBy("bin1", "bin2").applyInArrow(product(pct), "a long, b long"))
    add(alone.union(crossed))
    return labels


def ngram_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5,
                 pct: int = 75, rounds: int = 2) -> DataFrame:
    """``(k, v, n, group, component_id)`` for each row of ``docs``: its id, a hash of its
    text, its set's size, its group (null: no words) and the group's smallest id."""
    spark = docs.sparkSession
    bounded_batches(spark)
    t = F.col(text_col).cast("string")
    base = docs.select(F.col(id_col).cast("long").alias("k"), t.alias("t"), F.xxhash64(t).alias("v"))
    rows = written(base.mapInArrow(describe(n), "k long, v long, n long, sig long"), "rows")
    base = base.select("k", "t")
    total = rows.agg(F.sum("n")).first()[0] or 0
    sizes = (rows.filter("sig <> 0").groupBy("sig")
             .agg(F.first("n").alias("n"), F.min("k").alias("rep")))
    blocks = block_count(total * 10 * (100 - pct + EXTRA_PCT) / 100)
    shared = (_by_block(base.mapInArrow(first_parts(n, pct, blocks), BLOCK_SCHEMA))
              .applyInArrow(count_shared, "sig long, shared long")
              .groupBy("sig").agg(F.sum("shared").alias("shared")))
    least = F.greatest(F.lit(1), F.floor(F.ceil(F.col("n") * pct / 100) * EXTRA_PCT / 100))
    maybe = written(sizes.join(shared, "sig").filter(F.col("shared") >= least).select("sig"), "maybe")
    sets = written(base.mapInArrow(whole_sets(n, bit_table(maybe, "sig")), "sig long, n long, grams binary")
                   .join(maybe, "sig", "left_semi").dropDuplicates(["sig"]), "sets")
    grams = sets.agg(F.sum("n")).first()[0] or 0
    full = written(
        _by_block(sets.mapInArrow(deal_sets(block_count(grams * 10)), BLOCK_SCHEMA))
        .applyInArrow(shared_columns, "sig long, grams binary, counts binary")
        .groupBy("sig").agg(F.collect_list("grams").alias("grams"), F.collect_list("counts").alias("counts"))
        .join(sets.select("sig", "n"), "sig").select("sig", "n", "grams", "counts")
        .mapInArrow(candidates(pct), "sig long, n long, rare array<long>, grams binary"), "candidates")
    labels = _row_links(full, pct, rounds)
    named = sizes.withColumn("group", F.col("sig"))
    if labels is not None:
        named = (sizes.join(labels.withColumnRenamed("v", "sig"), "sig", "left")
                 .withColumn("group", F.coalesce("label", "sig")))
    least_id = named.groupBy("group").agg(F.min("rep").alias("component_id"))
    names = named.select("sig", "group").join(least_id, "group")
    return rows.join(names, "sig", "left").select("k", "v", "n", "group", "component_id")


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5,
                     pct: int = 75) -> DataFrame:
    """``(id, n_shingles, component_id)`` for each row of ``docs``.

    Two rows are linked when the Jaccard similarity of their n-gram sets is at least
    ``pct`` per cent; ``component_id`` is the smallest id reachable by links.  A null,
    empty or white-space text has ``n_shingles`` 0 and is linked with nothing.  Repeated
    rows are rows of their own with the same result.  A null id never becomes a
    component's name unless all ids of the component are null.  Other columns are ignored.
    """
    return ngram_groups(docs, id_col, text_col, n, pct).select(
        F.col("k").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "k").alias("component_id"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5,
                     pct: int = 75) -> DataFrame:
    """One row of each group of near copies, all columns unchanged: the one with the smallest
    id (null ids last; then by a hash of the text; of repeated rows any).  Texts without
    words are in no group and stay."""
    key = F.xxhash64(F.coalesce(F.col("k"), F.lit(-1 << 63)), F.coalesce(F.col("v"), F.lit(0)))
    rows = written(ngram_groups(docs, id_col, text_col, n, pct).filter("group IS NOT NULL")
                   .groupBy("k", "v", "group").agg(F.count("*").alias("rows")).withColumn("key", key), "groups")
    one = F.struct(F.col("k").isNull(), "k", "v")
    best = rows.groupBy("group").agg(F.min(one).alias("x")).select("group", F.col("x.v").alias("bv"), F.col("x.k").alias("bk"))
    ranked = rows.join(best, "group").withColumn("best", F.col("k").eqNullSafe(F.col("bk")) & (F.col("v") == F.col("bv")))
    # most rows stay and are passed on where they are read; only rows that go, repeated rows
    # and what a bit table takes for them meet the exact decision in a join
    other = written(ranked.filter("not best or rows > 1").select("key", "best").distinct(), "other")
    filled = bit_table(other, "key")
    t = F.col(text_col).cast("string")
    d = docs.withColumn("__key", F.xxhash64(F.coalesce(F.col(id_col).cast("long"), F.lit(-1 << 63)), F.coalesce(F.xxhash64(t), F.lit(0))))
    met = hits(d, "__key", filled).join(other.select(F.col("key").alias("__key"), F.col("best").alias("__best")), "__key", "left")
    found = (hits(d, "__key", filled, inside=False).drop("__key")
             .unionByName(met.filter("__best IS NULL").drop("__key", "__best"))
             .unionByName(met.filter("__best").dropDuplicates(["__key"]).drop("__key", "__best")))
    return found.select(*[F.col(f"`{c}`") for c in docs.columns])


SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS g FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY 1),
many AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM grams a JOIN grams b USING (g)
         WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM many JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id
          WHERE 100 * o >= 75 * (x.n + y.n - o)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT DISTINCT a AS v, a AS r FROM edges UNION SELECT e.b, reach.r FROM reach JOIN edges e ON e.a = reach.v)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, coalesce(c.c, d.doc_id) AS component_id
FROM documents d LEFT JOIN sizes s USING (doc_id)
LEFT JOIN (SELECT v, min(r) AS c FROM reach GROUP BY 1) c ON c.v = d.doc_id
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of near copies (5-word shingles, Jaccard >= 0.75) of every document."""
    return ngram_components(table(spark, sf_dir, "documents"))


QUERY = LlmQuery("op1_ngram_jaccard_join", query, SQL)
