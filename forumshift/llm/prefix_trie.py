"""Operator 11: the trie of conversation prefixes, screened by a count-min sketch.

A node is a distinct sequence of the first d turns; its members are the conversations that
start with it.  Turns travel as 128-bit digests, never as texts, and a prefix is the
polynomial sum of its turns' digests, so a scan over the sorted turns gives every prefix
its digest.  The scan is distributed: a range sort cuts a long conversation anywhere, each
task sums its own run, and the few sums at task borders are carried over (two rows for each
task reach the driver).

A count-min sketch of all prefix digests never underestimates: an estimate of one proves
that one conversation alone has the prefix, and so has everything below it.  Those tails
are emitted where they are read.  Only prefixes that may be shared are shuffled and grouped
exactly; what the sketch mistakes for shared is found alone there.

Sums over subtrees need no walk over levels.  Each node belongs to its smallest member, and
once a conversation owns a node it owns all of its own deeper ones.  So one number for each
conversation, the depth from which it owns, gives every node's sums by one aggregate over its
members.
"""

from __future__ import annotations

import hashlib
import math
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import LlmQuery
from .common import U64, arrow_rows, bounded_batches, mix, process_cache, table, written

#: odd bases of the two polynomial sums
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: rows of the count-min sketch, and the bounds of its cells in each row (a byte a cell)
SKETCH_ROWS, LEAST_CELLS, MOST_CELLS = 3, 1 << 12, 1 << 23
#: cells of the sketch that travel together
SKETCH_BLOCK = 1 << 16
#: sorted rows in one task, about
TASK_ROWS = 1_000_000
#: characters of joined ids that travel together
CHUNK = 1 << 20
NOTHING = hashlib.sha256(b"").hexdigest()

SCANNED = ("conv_id long, part int, j long, a1 long, a2 long, u1 long, u2 long, s long, chars long, "
           "stop boolean, edge int")
PREFIXES = ("conv_id long, depth long, chars long, upto long, p1 long, p2 long, q1 long, q2 long, last boolean, "
            "a1 long, a2 long")


def arrow_schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in ddl.split(", ")])


def base_powers(n: int) -> list[np.ndarray]:
    """Powers 0 .. n - 1 (at least) of both bases modulo 2**64."""
    kept = process_cache()
    if len(kept.get("trie_powers", ((),))[0]) < n:
        out = []
        for b in BASES:
            p = np.full(max(n, 4096) * 2, U64(b))
            p[0] = 1
            out.append(np.cumprod(p, dtype=U64))
        kept["trie_powers"] = out
    return kept["trie_powers"]


def turn_digests(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text") -> DataFrame:
    """``(conv_id, turn, a1, a2, chars, role, text, salt)``: every turn with its digest; null
    role or text counts as empty, rows without an id belong to no conversation.  ``role`` and
    ``text`` stay only where several turns of a conversation have the same number and differ,
    to order those; ``salt`` lets a range sort split rows that are equal in everything."""
    ids = F.col(id_col).cast("long").alias("conv_id")
    at = F.col(turn_col).cast("long").alias("turn")
    role = F.coalesce(F.col(role_col).cast("string"), F.lit(""))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = turns.filter(F.col(id_col).isNotNull())
    flat = written(base.select(ids, at, F.xxhash64(role, text).alias("a1"), F.xxhash64(F.lit("turn"), text, role).alias("a2"),
                               F.length(text).cast("long").alias("chars"), F.rand(7).alias("salt")), "trie-turns")
    same = flat.groupBy("conv_id", "turn").agg(F.min("a1").alias("x"), F.max("a1").alias("y")).filter("x <> y").select("conv_id", "turn")
    tied = written(same, "trie-ties")
    if tied.isEmpty():
        return flat.select("*", F.lit("").alias("role"), F.lit("").alias("text"))
    on = lambda d: (d.conv_id == F.col("k.conv_id")) & d.turn.eqNullSafe(F.col("k.turn"))
    alone = flat.join(tied.alias("k"), on(flat), "left_anti").select("*", F.lit("").alias("role"), F.lit("").alias("text"))
    texts = base.select(ids, at, F.xxhash64(role, text).alias("a1"), F.xxhash64(F.lit("turn"), text, role).alias("a2"),
                        F.length(text).cast("long").alias("chars"), F.rand(8).alias("salt"), role.alias("role"), text.alias("text"))
    return alone.unionByName(texts.join(tied.alias("k"), on(texts), "left_semi"))


def _runs(rows) -> object:
    """Arrow task over sorted rows: place and sums of each row inside its conversation's run
    in this task."""
    schema = arrow_schema(SCANNED)
    state = {"id": None, "first": None, "j": 0, "u": [U64(0), U64(0)], "s": 0}
    part = TaskContext.get().partitionId()

    def one(b):
        ids = b.column("conv_id").to_numpy()
        n = len(ids)
        new = np.ones(n, bool)
        new[1:] = ids[1:] != ids[:-1]
        new[0] = state["id"] is None or ids[0] != state["id"]
        if state["first"] is None:
            state["first"] = int(ids[0])
        at = np.arange(n)
        start = np.maximum.accumulate(np.where(new, at, -1))
        carried = start < 0
        j = np.where(carried, at + 1 + state["j"], at - start + 1)
        ups = base_powers(int(j.max()) + 1)
        out = {"conv_id": ids, "part": np.full(n, part, np.int32), "j": j}
        before = np.maximum(start, 0)
        for i, up in enumerate(ups):
            a = b.column(f"a{i + 1}").to_numpy()
            c = np.concatenate([np.zeros(1, U64), np.cumsum(a.view(U64) * up[j], dtype=U64)])
            u = c[1:] - c[before] + np.where(carried, state["u"][i], U64(0))
            out[f"a{i + 1}"], out[f"u{i + 1}"] = a, u.view(np.int64)
            state["u"][i] = u[-1]
        chars = b.column("chars").to_numpy()
        c = np.concatenate([np.zeros(1, np.int64), np.cumsum(chars)])
        out["s"] = c[1:] - c[before] + np.where(carried, state["s"], 0)
        out["chars"] = chars
        state.update(id=int(ids[-1]), j=int(j[-1]), s=int(out["s"][-1]))
        out["stop"] = np.append(ids[1:] != ids[:-1], False)
        return out

    def done(out, following):
        out["stop"][-1] = following is None or following != out["conv_id"][-1]
        edge = (out["stop"] & (out["conv_id"] == state["first"])).astype(np.int32)
        if following is None:
            edge[-1] |= 2
        return arrow_rows({c: out[c] for c in schema.names[:-1]} | {"edge": edge}, schema)

    held = None
    for b in rows:
        if not len(b):
            continue
        if held is not None:
            yield done(held, b.column("conv_id")[0].as_py())
        held = one(b)
    if held is not None:
        yield done(held, None)


def _carries(runs: DataFrame) -> dict:
    """For each task: what its first conversation brings from earlier tasks, and whether its
    last one goes on.  At most two rows for each task."""
    edges = sorted((r.part, r.edge & 2, r) for r in runs.filter("edge > 0").collect())
    out, open_, last_part = {}, None, None
    for part, own in groupby(edges, key=lambda x: x[0]):
        own = [x[2] for x in own]
        first, final = own[0], own[-1]
        goes_on = open_ is not None and open_[0] == first.conv_id
        if goes_on:
            out[last_part] = (*out[last_part][:-1], True)
        n, u1, u2, s = open_[1:] if goes_on else (0, 0, 0, 0)
        out[part] = (first.conv_id, n, u1, u2, s, False)
        if first is final:
            open_ = (final.conv_id, n + final.j, (u1 + pow(BASES[0], n, 2**64) * final.u1) % 2**64,
                     (u2 + pow(BASES[1], n, 2**64) * final.u2) % 2**64, s + final.s)
        else:
            open_ = (final.conv_id, final.j, final.u1 % 2**64, final.u2 % 2**64, final.s)
        last_part = part
    return out


def prefixes(turns: DataFrame, *order) -> DataFrame:
    """``(conv_id, depth, chars, upto, p1, p2, q1, q2, last, a1, a2)`` of every turn of ``turns(conv_id,
    a1, a2, chars, ...)`` in the order given: its place, its prefix's digest p and characters
    ``upto``, the digest q of the prefix before it, and whether it is the last."""
    spark = turns.sparkSession
    bounded_batches(spark)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(turns.count() / TASK_ROWS))
    ranged = turns.repartitionByRange(parts, "conv_id", *order).sortWithinPartitions("conv_id", *order)
    runs = written(ranged.select("conv_id", "a1", "a2", "chars").mapInArrow(_runs, SCANNED), "trie-runs")
    carries = _carries(runs)
    schema = arrow_schema(PREFIXES)

    def finish(batches):
        for b in batches:
            if not len(b):
                continue
            col = lambda c: b.column(c).to_numpy(zero_copy_only=False)
            ids, part, j, last = col("conv_id"), col("part"), col("j"), col("stop").copy()
            before, upto = np.zeros(len(b), np.int64), col("s").copy()
            p = [col("u1").view(U64).copy(), col("u2").view(U64).copy()]
            shift = [np.ones(len(b), U64), np.ones(len(b), U64)]
            for x in np.unique(part):
                first, n, u1, u2, s, on = carries[int(x)]
                here = part == x
                if on:  # the run that ends this task goes on in the next
                    last &= ~(here & ((col("edge") & 2) > 0))
                if n:
                    m = here & (ids == first)
                    before[m] = n
                    upto[m] += s
                    for i, u in enumerate((u1, u2)):
                        up = U64(pow(BASES[i], n, 2**64))
                        shift[i][m] = up
                        p[i][m] = p[i][m] * up + U64(u)
            ups = base_powers(int(j.max()) + 1)
            q = [p[i] - col(f"a{i + 1}").view(U64) * ups[i][j] * shift[i] for i in (0, 1)]
            yield arrow_rows({"conv_id": ids, "depth": j + before, "chars": col("chars"), "upto": upto,
                              "p1": p[0].view(np.int64), "p2": p[1].view(np.int64),
                              "q1": q[0].view(np.int64), "q2": q[1].view(np.int64), "last": last,
                              "a1": col("a1"), "a2": col("a2")}, schema)

    return runs.mapInArrow(finish, PREFIXES)


# ---- the count-min sketch --------------------------------------------------------------

def sketch_cells(depth: np.ndarray, p1: np.ndarray, p2: np.ndarray, cells: int) -> list[np.ndarray]:
    """The cell of each prefix in every row of the sketch."""
    x = mix(p1.view(U64) + depth.astype(U64) * U64(BASES[1]))
    y = mix(p2.view(U64) ^ U64(BASES[0])) | U64(1)
    return [(mix(x + U64(r) * y) & U64(cells - 1)).astype(np.int64) for r in range(SKETCH_ROWS)]


def count_min(rows: DataFrame, cells: int) -> np.ndarray:
    """Counts, up to two, of the prefixes in each cell: one sketch for each task, then sums by
    block of cells.  At most 24 MB whatever the input."""
    block = min(SKETCH_BLOCK, cells)
    schema = arrow_schema("row int, block int, counts binary")

    def emit(kept):
        for (r, k), c in kept.items():
            yield arrow_rows({"row": [r], "block": [k], "counts": [c.tobytes()]}, schema)

    def count(batches):
        kept = {}
        for b in batches:
            col = lambda c: b.column(c).to_numpy()
            for r, at in enumerate(sketch_cells(col("depth"), col("p1"), col("p2"), cells)):
                at, n = np.unique(at, return_counts=True)
                n = np.minimum(n, 2)
                cut = np.flatnonzero(np.diff(at // block)) + 1
                for a, m in zip(np.split(at, cut), np.split(n, cut)):
                    if len(a):
                        c = kept.setdefault((r, int(a[0] // block)), np.zeros(block, np.uint8))
                        c[a % block] = np.minimum(c[a % block] + m, 2)
        yield from emit(kept)

    def add(batches):
        kept = {}
        for b in batches:
            for r, k, data in zip(b.column("row").to_pylist(), b.column("block").to_pylist(), b.column("counts")):
                c = kept.setdefault((r, k), np.zeros(block, np.uint8))
                np.minimum(c + np.frombuffer(data.as_buffer(), np.uint8), 2, out=c)
        yield from emit(kept)

    ddl = "row int, block int, counts binary"
    parts = rows.select("depth", "p1", "p2").mapInArrow(count, ddl).repartition("row", "block").mapInArrow(add, ddl)
    out = np.zeros((SKETCH_ROWS, cells), np.uint8)
    for b in parts.toArrow().to_batches():
        for r, k, data in zip(b.column("row").to_pylist(), b.column("block").to_pylist(), b.column("counts")):
            out[r, k * block:(k + 1) * block] = np.frombuffer(data.as_buffer(), np.uint8)
    return out


def screened(rows: DataFrame, sketch: np.ndarray) -> DataFrame:
    """``rows`` with ``shared`` (several conversations may have this prefix) and ``under`` (may
    have the one before it)."""
    cells = sketch.shape[1]
    kinds = {"bigint": "long", "boolean": "boolean"}
    ddl = ", ".join(f"{c} {kinds[t]}" for c, t in rows.dtypes) + ", shared boolean, under boolean"
    schema = arrow_schema(ddl)

    def run(batches):
        for b in batches:
            col = lambda c: b.column(c).to_numpy()
            depth = col("depth")
            estimate = lambda d, x, y: np.minimum.reduce([sketch[r, at] for r, at in enumerate(sketch_cells(d, x, y, cells))])
            shared = estimate(depth, col("p1"), col("p2")) > 1
            under = (estimate(depth - 1, col("q1"), col("q2")) > 1) & (depth > 1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shared), pa.array(under)], schema=schema)

    return rows.mapInArrow(run, ddl)


# ---- hashes of unbounded lists of ids ----------------------------------------------------

def id_digests(ends: DataFrame, key: list[str]) -> DataFrame:
    """SHA-256 of each key's ids, ascending, joined by commas: ``(key..., ends_sha256)``.

    Ids are range-sorted and joined piece by piece wherever the sort put them; one task then
    only feeds a key's pieces to the hash, which is sequential, and keeps none of them."""
    spark = ends.sparkSession
    names = ", ".join(f"{c} long" for c in key)
    cut = arrow_schema(names + ", part long, piece long, ids string")
    end = arrow_schema(names + ", ends_sha256 string")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def pieces(batches):
        part, piece = TaskContext.get().partitionId(), 0
        for b in batches:
            keys = zip(*(b.column(c).to_pylist() for c in key))
            rows = zip(keys, b.column("conv_id").to_pylist())
            for k, own in groupby(rows, key=lambda x: x[0]):
                own = [str(x) for _, x in own]
                for i in range(0, len(own), CHUNK // 20):
                    yield arrow_rows(dict(zip(key, ([x] for x in k))) | {"part": [part], "piece": [piece], "ids": [",".join(own[i:i + CHUNK // 20])]}, cut)
                    piece += 1

    def hashed(batches):
        last, h = None, None
        for b in batches:
            out = []
            keys = zip(*(b.column(c).to_pylist() for c in key))
            for k, ids in zip(keys, b.column("ids")):
                if k != last:
                    if h is not None:
                        out.append((last, h.hexdigest()))
                    last, h = k, hashlib.sha256()
                else:
                    h.update(b",")
                h.update(ids.as_py().encode())
            if out:
                yield arrow_rows({c: [k[i] for k, _ in out] for i, c in enumerate(key)} | {"ends_sha256": [x for _, x in out]}, end)
        if h is not None:
            yield arrow_rows({c: [last[i]] for i, c in enumerate(key)} | {"ends_sha256": [h.hexdigest()]}, end)

    sorted_ids = (ends.select(*key, "conv_id").repartitionByRange(tasks, *key, "conv_id").sortWithinPartitions(*key, "conv_id")
                  .mapInArrow(pieces, names + ", part long, piece long, ids string"))
    return (sorted_ids.repartition(tasks, *key).sortWithinPartitions(*key, "part", "piece")
            .mapInArrow(hashed, names + ", ends_sha256 string"))


# ---- the trie --------------------------------------------------------------------------

NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def prefix_trie(turns: DataFrame, conversations: DataFrame, *order) -> DataFrame:
    """Nodes of the trie of ``conversations(conv_id)`` with turns ``turns(conv_id, a1, a2, chars, order...)``.

    Per node: conv_id (smallest member), depth, parent_conv_id (the parent's conv_id; root:
    null), n_convs, n_children, n_leaves, saved_tokens, ends_sha256.  Ids are integers;
    conversations without turns are members of the root and end there.  No conversation, no
    node.  Equal turns repeat as levels of their own.
    """
    rows = prefixes(turns, *order)
    n = turns.count()
    cells = 1 << min(MOST_CELLS.bit_length() - 1, max(LEAST_CELLS.bit_length() - 1, (4 * max(n, 1)).bit_length()))
    all_ = written(screened(rows.drop("a1", "a2"), count_min(rows, cells)), "trie-prefixes")
    maybe, tails = all_.filter("shared"), all_.filter("not shared")
    key = ["depth", "p1", "p2"]

    nodes = written(maybe.groupBy(*key).agg(
        F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.first("q1").alias("q1"), F.first("q2").alias("q2"),
        F.first("chars").alias("chars"), F.first("upto").alias("upto"), F.count_if("last").alias("n_ends")), "trie-nodes")

    # from which depth a conversation owns its nodes, the characters before it, and whether it owns a leaf
    begin = lambda d, s: F.struct(d.alias("depth"), s.alias("before"))
    owned = (nodes.select("conv_id", begin(F.col("depth"), F.col("upto") - F.col("chars")).alias("from"),
                          F.expr("n_convs = 1 OR n_ends = n_convs").alias("leaf"))
             .unionByName(tails.filter("under").select("conv_id", begin(F.col("depth"), F.col("upto") - F.col("chars")).alias("from"), F.lit(True).alias("leaf")))
             .unionByName(maybe.filter("last").select("conv_id", begin(F.col("depth") + 1, F.col("upto")).alias("from"), F.lit(False).alias("leaf")))
             .groupBy("conv_id").agg(F.min("from").alias("from"), F.max("leaf").alias("leaf")))
    sums = (maybe.join(owned, "conv_id")
            .select(*key, F.when(F.col("depth") < F.col("from.depth"), F.col("from.before") - F.col("upto") + F.col("chars")).otherwise(0).alias("saved"),
                    F.col("leaf").cast("long").alias("leaf"))
            .groupBy(*key).agg(F.sum("saved").alias("saved_tokens"), F.sum("leaf").alias("n_leaves")))

    below = (nodes.select("depth", "q1", "q2", F.lit(1).alias("c")).unionByName(tails.filter("under").select("depth", "q1", "q2", F.lit(1).alias("c")))
             .filter("depth > 1").groupBy((F.col("depth") - 1).alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2"))
             .agg(F.sum("c").alias("n_children")))
    up = nodes.select((F.col("depth") + 1).alias("depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("above"))
    ended = maybe.filter("last").select(*key, "conv_id")

    whole = conversations.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n")).first()
    if not whole.n:
        return all_.select("conv_id", "depth", F.col("conv_id").alias("parent_conv_id"), F.col("depth").alias("n_convs"),
                           F.col("depth").alias("n_children"), F.col("depth").alias("n_leaves"), F.col("depth").alias("saved_tokens"),
                           F.lit("").alias("ends_sha256")).limit(0)
    root = F.lit(whole.conv_id).cast("long")
    parent = lambda above: F.when(F.col("depth") == 1, root).otherwise(F.coalesce(above, F.col("conv_id")))

    shared = (nodes.join(sums, key).join(below, key, "left").join(id_digests(ended, key), key, "left").join(up, ["depth", "q1", "q2"], "left")
              .select("conv_id", "depth", parent(F.col("above")).alias("parent_conv_id"), "n_convs",
                      F.when(F.col("n_convs") == 1, 1 - F.col("n_ends")).otherwise(F.coalesce("n_children", F.lit(0))).alias("n_children"),
                      F.when(F.col("n_convs") == 1, 1).otherwise(F.col("n_leaves")).alias("n_leaves"),
                      F.when(F.col("n_convs") == 1, 0).otherwise(F.col("saved_tokens")).alias("saved_tokens"),
                      F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256")))

    def tail(df, above):
        return df.select("conv_id", "depth", parent(above).alias("parent_conv_id"), F.lit(1).alias("n_convs"),
                         F.when(F.col("last"), 0).otherwise(1).alias("n_children"), F.lit(1).alias("n_leaves"),
                         F.lit(0).alias("saved_tokens"),
                         F.when(F.col("last"), F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(F.lit(NOTHING)).alias("ends_sha256"))

    local = tail(tails.filter("not under"), F.lit(None).cast("long"))
    heads = tail(tails.filter("under").join(up, ["depth", "q1", "q2"], "left"), F.col("above"))

    first = nodes.filter("depth = 1").count() + tails.filter("depth = 1").count()
    totals = nodes.agg(F.coalesce(F.sum((F.col("n_convs") - 1) * F.col("chars")), F.lit(0)).alias("saved"), F.count_if(F.expr("n_ends = n_convs")).alias("leaves")).first()
    leaves = totals.leaves + tails.filter("last").count()
    silent = conversations.join(all_.filter("depth = 1").select("conv_id"), "conv_id", "left_anti").select(F.lit(0).cast("long").alias("depth"), "conv_id")
    top = (turns.sparkSession.range(1).select(F.lit(0).cast("long").alias("depth")).join(id_digests(silent, ["depth"]), "depth", "left")
           .select(root.alias("conv_id"), "depth", F.lit(None).cast("long").alias("parent_conv_id"), F.lit(whole.n).alias("n_convs"),
                   F.lit(first).alias("n_children"), F.lit(leaves or 1).alias("n_leaves"), F.lit(totals.saved).alias("saved_tokens"),
                   F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256")))
    out = shared.unionByName(local).unionByName(heads).unionByName(top)
    return out.select(*(F.col(c).cast("string" if c == "ends_sha256" else "long").alias(c) for c in NODE))


# ---- the registered query ----------------------------------------------------------------

def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The contract's conversations: ``(turns(conv_id, o, a1, a2, chars), conversations(conv_id))``.
    Conversation c opens with the first h turns of conversation c - c % 100 and goes on with its own
    turns after its first h; h = crc32(c) % 6."""
    own = written(prefixes(turn_digests(turns), F.col("turn").asc_nulls_first(), "role", "text", "salt")
                  .select("conv_id", F.col("depth").alias("o"), "a1", "a2", "chars"), "trie-own")
    h = F.crc32(F.col("conv_id").cast("string")) % 6
    convs = own.filter("o = 1").select("conv_id")
    heads = own.filter("conv_id % 100 = 0 AND o <= 5").withColumnRenamed("conv_id", "base")
    opened = (convs.withColumn("base", F.expr("conv_id - conv_id % 100")).join(heads, "base")
              .filter(F.col("o") <= h).select("conv_id", "o", "a1", "a2", "chars"))
    return written(own.filter(F.col("o") > h).unionByName(opened), "trie-rebuilt"), convs


SQL = r"""
WITH RECURSIVE ranked AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT DISTINCT c FROM ranked),
crc AS (SELECT c, 0 AS k, CAST(4294967295 AS BIGINT) AS v FROM ids
        UNION ALL
        SELECT c, k + 1, CASE WHEN k % 9 = 0 THEN xor(v, CAST(ascii(substr(CAST(c AS VARCHAR), k // 9 + 1, 1)) AS BIGINT))
                              WHEN v % 2 = 1 THEN xor(v // 2, CAST(3988292384 AS BIGINT)) ELSE v // 2 END
        FROM crc WHERE k < 9 * length(CAST(c AS VARCHAR))),
h AS (SELECT c, xor(v, CAST(4294967295 AS BIGINT)) % 6 AS h FROM crc WHERE k = 9 * length(CAST(c AS VARCHAR))),
built AS (SELECT h.c, i, role, text FROM h JOIN ranked r ON r.c = h.c AND i > h
          UNION ALL
          SELECT h.c, i, role, text FROM h JOIN ranked r ON r.c = h.c - h.c % 100 AND i <= h),
paths AS (SELECT h.c, coalesce(list([role, text] ORDER BY i) FILTER (i IS NOT NULL), []) AS p FROM h LEFT JOIN built b ON b.c = h.c GROUP BY 1),
member AS (SELECT c, unnest(range(0, len(p) + 1)) AS depth, p FROM paths),
node AS (SELECT depth, p[1:depth] AS p, min(c) AS conv_id, count(*) AS n,
                coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (len(p) = depth), '') AS ends FROM member GROUP BY 1, 2),
kids AS (SELECT depth - 1 AS depth, p[1:depth - 1] AS p, count(*) AS n_children FROM node WHERE depth > 0 GROUP BY 1, 2),
full_node AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM node n LEFT JOIN kids k ON k.depth = n.depth AND k.p = n.p),
up AS (SELECT unnest(range(0, depth + 1)) AS d, depth, p, n, n_children FROM full_node),
under AS (SELECT d AS depth, p[1:d] AS p, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves,
                 sum(CASE WHEN depth = 0 THEN 0 ELSE (n - 1) * length(p[depth][2]) END) AS saved FROM up GROUP BY 1, 2)
SELECT v.conv_id, v.depth, a.conv_id AS parent_conv_id, v.n AS n_convs, CAST(v.n_children AS BIGINT) AS n_children,
       CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(v.ends) AS ends_sha256
FROM full_node v JOIN under u ON u.depth = v.depth AND u.p = v.p
LEFT JOIN node a ON a.depth = v.depth - 1 AND a.p = v.p[1:v.depth - 1]
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of the rebuilt conversations."""
    turns, convs = rebuilt(table(spark, sf_dir, "conversations"))
    return prefix_trie(turns, convs, "o")


QUERY = LlmQuery("op11_prefix_trie", query, SQL)
