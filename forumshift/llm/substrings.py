"""Operator 3: substring deduplication by level-wise doubling.

A window of ``words`` words is removed wherever it also starts earlier.  Looking at every
window of full length would exchange the whole corpus, so lengths are doubled level by
level (10, 20 words for the contract).  At a level of length l every full window is
represented by its *anchor*, the l-gram with the smallest hash inside it: equal windows
have equal anchors, so a window whose anchor occurs once cannot repeat.  Only windows
whose anchors repeat are extended to twice that length, until the full length is reached
or no candidate survives.  The result is exact; anchors are about one word in six.

Anchors and windows are exchanged as column blocks (ranges of the hash).  Before the
exchange each batch of texts keeps one entry for each hash; a window met again in its
batch, or after a very common one in the same task, is settled on the spot.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import LlmQuery
from .common import (U64, as_binary, block_count, block_of, bounded_batches, table, text_buffer,
                     text_bytes, windows, word_hashes, word_spans, written)

#: first anchors are at least so long
LEAST = 10
#: very common windows a task remembers (bounds memory; only saves exchange)
REMEMBER = 200_000
TOP = (1 << 63) - 1
KEY = ["k", "v"]
BLOCKS = "block int, ks binary, vs binary, hashes binary, rows binary, starts binary"


def level_lengths(words: int) -> list[int]:
    out = [words]
    while out[0] >= 2 * LEAST:
        out.insert(0, -(-out[0] // 2))
    return out


def smallest_in(x: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost minimum of x[i : i + width] for each i that has all of them."""
    pos, w = np.arange(len(x)), 1
    while w < width:
        step = min(w, width - w)
        a, b = pos[:len(pos) - step], pos[step:]
        pos = np.where(x[b] < x[a], b, a)
        w += step
    return pos


def _texts(batch: pa.RecordBatch):
    a, off = text_buffer(batch.column("t"))
    s, e, doc = word_spans(a, off)
    return a, off, s, e, doc, word_hashes(a, s, e)


def _anchors(h, doc, length, words):
    """Full windows' starts, their anchors' positions at a level, and the l-gram hashes."""
    _, full = windows(h, doc, words)
    x = np.full(len(h), U64(0xFFFFFFFFFFFFFFFF))
    g, at = windows(h, doc, length)
    x[at] = g
    if length == words or not len(full):
        return full, full, x
    return full, smallest_in(x, words - length + 1)[full], x


def _alive(batch, doc, full, anchor, x):
    """Full windows whose anchor of the level before repeats (``grams``: sorted, per text)."""
    keep = np.zeros(len(full), bool)
    owner = doc[full]
    cut = np.searchsorted(owner, np.arange(batch.num_rows + 1))
    for i, grams in enumerate(batch.column("grams")):
        if grams.is_valid:
            r = np.unique(np.frombuffer(b"".join(grams.as_py()), U64))
            mine = x[anchor[cut[i]:cut[i + 1]]]
            if len(r) and len(mine):
                keep[cut[i]:cut[i + 1]] = r[np.minimum(np.searchsorted(r, mine), len(r) - 1)] == mine
    return keep


def _pack(block, key, rows, hashes, starts, ks, vs):
    order = np.argsort(block, kind="stable")
    block, rows, hashes, starts = block[order], rows[order], hashes[order], starts[order]
    cut = np.flatnonzero(np.diff(block, prepend=-2))
    end = np.append(cut[1:], len(block)).astype(np.int64)
    out = [[] for _ in range(6)]
    for i, j in zip(cut, end):
        used, local = np.unique(rows[i:j], return_inverse=True)
        for o, v in zip(out, (int(block[i]), ks[used], vs[used], hashes[i:j], local.astype(np.uint16 if len(used) < 65536 else np.uint32),
                              starts[i:j].astype(np.uint32))):
            o.append(v)
    return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32())] + [as_binary(o) for o in out[1:]],
                                      names=["block", "ks", "vs", "hashes", "rows", "starts"])


def _unpack(t: pa.Table):
    ks, vs, hs, ss = [], [], [], []
    for k, v, h, r, s in zip(*(t.column(c) for c in ("ks", "vs", "hashes", "rows", "starts"))):
        k, v = np.frombuffer(k.as_buffer(), np.int64), np.frombuffer(v.as_buffer(), np.int64)
        r = np.frombuffer(r.as_buffer(), np.uint16 if len(k) < 65536 else np.uint32)
        ks.append(k[r])
        vs.append(v[r])
        hs.append(np.frombuffer(h.as_buffer(), U64))
        ss.append(np.frombuffer(s.as_buffer(), np.uint32))
    return tuple(np.concatenate(c) for c in (ks, vs, hs, ss))


def _keys(batch):
    return (batch.column("k").to_numpy(zero_copy_only=False), batch.column("v").to_numpy(zero_copy_only=False))


def deal_anchors(length: int, before: int | None, words: int, blocks: int):
    """Occurrences of this level's anchors: one entry for each hash of a batch.  The entry's
    ``starts`` is 1 where the batch itself holds the anchor twice; those texts are answered
    at once (block -1)."""
    def run(batches):
        for b in batches:
            a, off, s, e, doc, h = _texts(b)
            full, anchor, x = _anchors(h, doc, length, words)
            if before is not None and len(full):
                _, old, y = _anchors(h, doc, before, words)
                anchor = anchor[_alive(b, doc, full, old, y)]
            pos = np.unique(anchor)
            if not len(pos):
                continue
            g, owner = x[pos], doc[pos]
            u, first, back, n = np.unique(g, return_index=True, return_inverse=True, return_counts=True)
            ks, vs = _keys(b)
            twice = n[back] > 1
            if twice.any():
                yield _pack(np.full(int(twice.sum()), -1), None, owner[twice], g[twice], np.zeros(int(twice.sum())), ks, vs)
            yield _pack(block_of(u, blocks), None, owner[first], u, n > 1, ks, vs)
    return run


def answer_anchors(t: pa.Table) -> pa.Table:
    """(k, v, grams): for each text its repeated anchors of the block."""
    k, v, h, many = _unpack(t)
    if t.column("block")[0].as_py() >= 0:
        order = np.argsort(h, kind="stable")
        k, v, h, many = k[order], v[order], h[order], many[order]
        start = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        n = np.diff(np.append(start, len(h)))
        keep = (np.repeat(n, n) > 1) & (many == 0)
        k, v, h = k[keep], v[keep], h[keep]
    order = np.lexsort((v, k))
    k, v, h = k[order], v[order], h[order]
    cut = np.flatnonzero(np.append(True, (k[1:] != k[:-1]) | (v[1:] != v[:-1]))) if len(k) else np.empty(0, np.int64)
    end = np.append(cut[1:], len(k)).astype(np.int64)
    return pa.table({"k": pa.array(k[cut], pa.int64()), "v": pa.array(v[cut], pa.int64()),
                     "grams": as_binary([h[i:j] for i, j in zip(cut, end)])})


def _earliest(h, k, v, s):
    """Order by (hash, key, start); True where an earlier entry has the same hash."""
    order = np.lexsort((s, v, k, h))
    h = h[order]
    return order, np.append(False, h[1:] == h[:-1])


def deal_windows(before: int | None, words: int, blocks: int):
    """Candidate windows of full length, one entry for each hash of a batch (its earliest).
    Later ones of the batch, and windows after a remembered one, are repeats (block -1)."""
    def run(batches):
        known, known_at = np.empty(0, U64), np.empty((0, 3), np.int64)
        for b in batches:
            a, off, s, e, doc, h = _texts(b)
            full, _, x = _anchors(h, doc, words, words)
            anchor_hash = x[full]
            if before is not None and len(full):
                _, old, y = _anchors(h, doc, before, words)
                keep = _alive(b, doc, full, old, y)
                full, anchor_hash = full[keep], y[old[keep]]
            if not len(full):
                continue
            ks, vs = _keys(b)
            first_word = np.searchsorted(doc, np.arange(b.num_rows))
            g, owner, start = x[full], doc[full], full - first_word[doc[full]]
            order, again = _earliest(g, ks[owner], vs[owner], start)
            g, owner, start, anchor_hash = g[order], owner[order], start[order], anchor_hash[order]
            new = np.flatnonzero(~again)
            same = np.append(np.diff(new), len(g) - new[-1])
            late = again.copy()
            # an entry equal to the first of its hash in key and start is the same occurrence
            lead = np.repeat(new, same)
            late &= ~((ks[owner] == ks[owner[lead]]) & (vs[owner] == vs[owner[lead]]) & (start == start[lead]))
            if len(known):
                at = np.minimum(np.searchsorted(known, g[new]), len(known) - 1)
                hit = known[at] == g[new]
                kk, vv, st = ks[owner[new]], vs[owner[new]], start[new]
                q = known_at[at]
                after = hit & ((q[:, 0] < kk) | (q[:, 0] == kk) & ((q[:, 1] < vv) | (q[:, 1] == vv) & (q[:, 2] < st)))
                late[new[after]] = True
                new = new[~after]
            common = new[np.isin(new, np.flatnonzero(~again)[same >= 8])]
            if len(common) and len(known) < REMEMBER:
                known = np.concatenate([known, g[common]])
                known_at = np.concatenate([known_at, np.stack([ks[owner[common]], vs[owner[common]], start[common]], 1)])
                o = np.argsort(known, kind="stable")
                known, known_at = known[o], known_at[o]
                once = np.append(True, known[1:] != known[:-1])
                known, known_at = known[once], known_at[once]
            if late.any():
                yield _pack(np.full(int(late.sum()), -1), None, owner[late], g[late], start[late], ks, vs)
            if len(new):
                yield _pack(block_of(anchor_hash[new], blocks), None, owner[new], g[new], start[new], ks, vs)
    return run


def answer_windows(t: pa.Table) -> pa.Table:
    """(k, v, starts, ends): runs of repeated windows of each text, from this block."""
    k, v, h, s = _unpack(t)
    if t.column("block")[0].as_py() >= 0:
        order, again = _earliest(h, k, v, s)
        k, v, s = k[order], v[order], s[order]
        same = np.append(False, (k[1:] == k[:-1]) & (v[1:] == v[:-1]) & (s[1:] == s[:-1]))
        lead = np.flatnonzero(~again)
        lead = np.repeat(lead, np.append(np.diff(lead), len(k) - lead[-1]))
        again &= ~((k == k[lead]) & (v == v[lead]) & (s == s[lead]))
        again &= ~same
        k, v, s = k[again], v[again], s[again]
    order = np.lexsort((s, v, k))
    k, v, s = k[order], v[order], s[order].astype(np.int64)
    other = np.append(True, (k[1:] != k[:-1]) | (v[1:] != v[:-1])) if len(k) else np.empty(0, bool)
    run = np.flatnonzero(other | np.append(True, s[1:] > s[:-1] + 1)) if len(k) else np.empty(0, np.int64)
    last = np.append(run[1:], len(k)).astype(np.int64) - 1
    text = np.flatnonzero(other[run])
    end = np.append(text[1:], len(run)).astype(np.int64)
    first, until = s[run].astype(np.uint32), (s[last] + 1 if len(k) else s).astype(np.uint32)
    return pa.table({"k": pa.array(k[run][text], pa.int64()), "v": pa.array(v[run][text], pa.int64()),
                     "starts": as_binary([first[i:j] for i, j in zip(text, end)]),
                     "ends": as_binary([until[i:j] for i, j in zip(text, end)])})


def cut_words(words: int):
    """Texts with their repeated windows -> (id, n_words, n_removed, kept)."""
    def run(batches):
        for b in batches:
            a, off = text_buffer(b.column("t"))
            s, e, doc = word_spans(a, off)
            n = b.num_rows
            first = np.searchsorted(doc, np.arange(n + 1))
            change = np.zeros(len(s) + 1, np.int64)
            for i, (x, y) in enumerate(zip(b.column("starts"), b.column("ends"))):
                if x.is_valid:
                    lo = np.frombuffer(b"".join(x.as_py()), np.uint32).astype(np.int64) + first[i]
                    hi = np.frombuffer(b"".join(y.as_py()), np.uint32).astype(np.int64) + first[i] + words - 1
                    np.add.at(change, lo, 1)
                    np.add.at(change, hi, -1)
            kept = np.cumsum(change[:-1]) == 0
            ks, ke, kd = s[kept], e[kept], doc[kept]
            inner = np.flatnonzero(np.append(kd[1:] == kd[:-1], False)) if len(kd) else np.empty(0, np.int64)
            out = a.copy()
            out[ke[inner]] = 32
            mark = np.zeros(len(a) + 1, np.int8)
            mark[ks] += 1
            mark[ke] -= 1
            mask = np.cumsum(mark[:-1], dtype=np.int8) > 0
            mask[ke[inner]] = True
            size = np.concatenate([[0], np.cumsum(mask)])[off]
            body = out[mask]
            text = pa.LargeStringArray.from_buffers(n, pa.py_buffer(np.ascontiguousarray(size, np.int64)), pa.py_buffer(body)).cast(pa.string())
            all_, left = np.diff(first), np.bincount(kd, minlength=n)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(all_), pa.array(all_ - left), text],
                                             names=["id", "n_words", "n_removed", "kept"])
    return run


def drop_repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 20) -> DataFrame:
    """``(id, n_words, n_removed, kept)``: texts without the words of every window of
    ``words`` words whose sequence also starts earlier (smaller id, or same text, earlier).

    Windows are judged on the input.  Kept words are joined by one space.  Null texts have
    no words and an empty kept text.  A null id counts as larger than any other; rows that
    share an id but not the text are separate texts, ordered by a hash of the text; rows
    equal in both are one text, and each gets its result.  Other columns are ignored.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    t = F.col(text_col).cast("string")
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(id_col).cast("long"), F.lit(TOP)).alias("k"),
                       F.xxhash64(t).alias("v"), t.alias("t"))
    total, before, hits = text_bytes(docs, text_col), None, None
    blocks = block_count(total * 0.4)
    source = base.select("k", "v", "t")
    for length in level_lengths(words)[:-1]:
        hits = (source.mapInArrow(deal_anchors(length, before, words, blocks), BLOCKS)
                .groupBy("block", F.when(F.col("block") < 0, F.crc32("ks")).otherwise(0))
                .applyInArrow(answer_anchors, "k long, v long, grams binary"))
        hits = written(hits.groupBy(*KEY).agg(F.collect_list("grams").alias("grams")), "anchors")
        source, before = base.select("k", "v", "t").join(hits, KEY), length
    runs = (source.mapInArrow(deal_windows(before, words, blocks), BLOCKS)
            .groupBy("block", F.when(F.col("block") < 0, F.crc32("ks")).otherwise(0))
            .applyInArrow(answer_windows, "k long, v long, starts binary, ends binary")
            .groupBy(*KEY).agg(F.collect_list("starts").alias("starts"), F.collect_list("ends").alias("ends")))
    return (base.join(runs, KEY, "left").select("id", "t", "starts", "ends")
            .mapInArrow(cut_words(words), "id long, n_words long, n_removed long, kept string")
            .withColumnRenamed("id", id_col))


SQL = r"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
wins AS (SELECT doc_id, len(w) AS n, unnest(range(1, len(w) - 18)) AS i, w FROM words),
seqs AS (SELECT doc_id, i, md5(array_to_string(w[i:i+19], ' ')) AS g FROM wins),
firsts AS (SELECT g, min((doc_id, i)) AS f FROM seqs GROUP BY 1 HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM seqs JOIN firsts USING (g) WHERE (doc_id, i) <> f),
each AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS x FROM words),
kept AS (SELECT e.doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM each e ANTI JOIN gone USING (doc_id, p) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(k.n, 0))::BIGINT AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM words LEFT JOIN kept k USING (doc_id)
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its repeated 20-word windows."""
    r = drop_repeated_windows(table(spark, sf_dir, "documents"))
    return r.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


QUERY = LlmQuery("op3_substring_dedup", query, SQL)
