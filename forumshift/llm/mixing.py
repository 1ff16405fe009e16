"""Operator 2 (native): mixing sources to target weights by pivotal rounding.

Each source gets a target number of words; a document of a source is due
``target / source_size`` copies.  Whole copies are certain, the fractions are rounded
by the pivotal method: two fractions are paired, words are moved at random from one to
the other until one of them becomes 0 or 1, and the other goes on with what is left.
Because *words* are moved (a fraction of a long document is worth more of a short one),
a source's words are kept at every step, and each document keeps its expected copies.

Pairing runs as a reduction tree: documents are dealt by the bits of a hash into groups
of about ``GROUP``, each group folds its fractions into one residual, residuals fold
again with fewer bits, and a source ends with one residual, rounded at random.  Every
level is one small shuffle of (id, size, fraction) rows, a thirty-second of the level
before; a source with a third of all rows is just more groups.  Randomness is a hash of
the ids, so reruns agree.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import LlmQuery
from .common import WORD, table, written

#: fractions folded together in one group, on average
GROUP_BITS = 5
CAP = 3
#: hash parts by text, and by place, in which equal units are numbered
PARTS = 32


def n_words(col):
    return F.coalesce(F.regexp_count(col, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, cap: int = CAP) -> DataFrame:
    """``(source, source_size)`` -> with ``weight`` and ``target``, one row per source.

    Sources in code point order (null last) weigh 1, 2, 3, 1, ...; targets share all words
    by weight, at most ``cap`` times the source's words; the excess goes to the others by
    weight until none is above (water filling: sources by the ratio at which they fill up).
    The table has one row per source; no document row enters these windows.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    s = sizes.withColumn("weight", ((F.row_number().over(order) - 1) % 3 + 1).cast("long"))
    fill = Window.orderBy((F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    after = fill.rowsBetween(0, Window.unboundedFollowing)
    s = (s.withColumn("left", F.sum("source_size").over(Window.partitionBy())
                      - F.coalesce(F.sum("source_size").over(before) * cap, F.lit(0)))
         .withColumn("w", F.sum("weight").over(after))
         .withColumn("at", F.row_number().over(fill))
         .withColumn("open", F.col("source_size") * cap * F.col("w") > F.col("left") * F.col("weight")))
    level = s.agg(F.min_by(F.struct("left", "w"), F.when(F.col("open"), F.col("at"))).alias("l"),
                  F.max("open").alias("any"))
    return (s.join(F.broadcast(level))  # one row
            .withColumn("target", F.when(F.col("any"), F.least(
                (F.col("source_size") * cap).cast("double"),
                F.col("l.left").cast("double") * F.col("weight") / F.col("l.w")))
                .otherwise((F.col("source_size") * cap).cast("double")))
            .select("source", "source_size", "weight", "target"))


# state: what a group has settled so far and the one fraction that is still open
_FOLD = """
aggregate(slice(units, 2, greatest(size(units) - 1, 0)),
  named_struct('open', units[0], 'done', slice(units, 1, 0)),
  (acc, b) -> transform(array(named_struct('a', acc.open, 'done', acc.done,
      'up', least((1 - acc.open.p) * acc.open.size, b.p * b.size),
      'down', least(acc.open.p * acc.open.size, (1 - b.p) * b.size),
      'u', (pmod(xxhash64(acc.open.h, b.h, {seed}), 9007199254740992L) + 0.5D) / 9007199254740992D)),
    t -> transform(array(if(t.u * (t.up + t.down) < t.down,
           named_struct('pa', t.a.p + t.up / t.a.size, 'pb', b.p - t.up / b.size,
                        'a_done', (1 - t.a.p) * t.a.size <= b.p * b.size, 'a_to', 1D, 'b_to', 0D),
           named_struct('pa', t.a.p - t.down / t.a.size, 'pb', b.p + t.down / b.size,
                        'a_done', t.a.p * t.a.size <= (1 - b.p) * b.size, 'a_to', 0D, 'b_to', 1D))),
      r -> named_struct(
        'open', if(r.a_done, named_struct('h', b.h, 'size', b.size, 'p', least(greatest(r.pb, 0D), 1D), 'unit', b.unit),
                             named_struct('h', t.a.h, 'size', t.a.size, 'p', least(greatest(r.pa, 0D), 1D), 'unit', t.a.unit)),
        'done', concat(t.done, array(if(r.a_done,
             named_struct('h', t.a.h, 'size', t.a.size, 'p', r.a_to, 'unit', t.a.unit),
             named_struct('h', b.h, 'size', b.size, 'p', r.b_to, 'unit', b.unit))))))[0])[0])
"""


def _round_fractions(units: DataFrame, seed: int) -> DataFrame:
    """``(source, h, size, p, unit)`` with sizes > 0 -> the same rows with p 0 or 1."""
    n = units.count()
    bits = max(0, math.ceil(math.log2(max(n, 1) / 2 ** GROUP_BITS)))
    settled, level = [], units
    while True:
        path = F.lit(0).cast("long") if bits == 0 else F.shiftrightunsigned("h", 64 - bits)
        group = (level.withColumn("g", path).groupBy("source", "g")
                 .agg(F.sort_array(F.collect_list(F.struct("h", "size", "p", "unit"))).alias("units")))
        folded = written(group.select("source", F.expr(_FOLD.format(seed=seed)).alias("r")), "mix")
        done = folded.select("source", F.explode("r.done").alias("x")).select("source", "x.*")
        settled.append(done)
        level = folded.select("source", "r.open.*")
        if bits == 0:
            break
        bits = max(0, bits - GROUP_BITS)
    u = (F.pmod(F.xxhash64("h", F.lit(seed + 1)), F.lit(1 << 53)) + 0.5) / float(1 << 53)
    last = written(level.withColumn("to", F.when(u < F.col("p"), 1.0).otherwise(0.0))
                   .withColumn("over", (F.col("to") - F.col("p")) * F.col("size")), "mix")
    done = settled[0]
    for s in settled[1:]:
        done = done.unionByName(s)
    # The last fraction of a source has no partner left; what its rounding adds or lacks is
    # moved once more, to or from the settled document that takes it up best.
    src, over = last.select(F.col("source").alias("src"), "over"), F.abs("over")
    gap = F.abs(F.col("size") - over)
    swap = (done.join(src, F.col("source").eqNullSafe(F.col("src")))
            .filter(((F.col("p") == 1.0) & (F.col("over") > 0) | (F.col("p") == 0.0) & (F.col("over") < 0)) & (gap < over))
            .groupBy("source").agg(F.min_by("h", F.struct(gap.alias("gap"), F.col("h"))).alias("swap"))
            .select("swap"))
    done = (done.join(swap, F.col("h") == F.col("swap"), "left")
            .withColumn("p", F.when(F.col("swap").isNotNull(), 1.0 - F.col("p")).otherwise(F.col("p"))).drop("swap"))
    return done.unionByName(last.withColumn("p", F.col("to")).select(done.columns))


def mix_copies(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source",
               text_col: str = "text", cap: int = CAP, seed: int = 17) -> DataFrame:
    """Copies of each distinct (id, source, size): ``(id, source, size, rows, source_size,
    target, copies)`` where ``rows`` equal keys share ``copies``.

    Size is the number of words of the text (null: 0).  A document is due at most ``cap``
    copies, never more.  Texts without words count 0 words whatever their copies.  Null ids
    and null sources are ids and a source of their own; other columns are ignored; an empty
    table gives an empty result.
    """
    rows = written(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"),
                               n_words(F.col(text_col).cast("string")).alias("size"))
                   .groupBy("id", "source", "size").agg(F.count("*").alias("rows")), "sizes")
    goal = targets(rows.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size")), cap)
    s, g = rows.alias("s"), goal.alias("g")
    due = (s.join(g, F.col("s.source").eqNullSafe(F.col("g.source")))
           .select("s.*", "source_size", "target",
                   F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("rate"))
           .withColumn("due", F.least(F.col("rows") * F.col("rate"), F.col("rows").cast("double") * cap))
           .withColumn("whole", F.floor(F.col("due") + 1e-9))
           .withColumn("p", F.greatest(F.col("due") - F.col("whole"), F.lit(0.0)))
           .withColumn("p", F.when(F.col("p") < 1e-9, 0.0).otherwise(F.col("p")))
           .withColumn("h", F.xxhash64("id", "source", "size", F.lit(seed))))
    due = written(due, "due")
    whole = ["id", "size", "rows", "source_size", "target", "whole"]
    unit = F.struct(*whole)
    open_ = due.filter("p > 0 and size > 0").select("source", "h", F.col("size").cast("double").alias("size"), "p", unit.alias("unit"))
    rounded = _round_fractions(written(open_, "fractions"), seed).select(
        "source", "unit.*", F.round("p").cast("long").alias("more"))
    u = (F.pmod(F.xxhash64("h", F.lit(seed + 2)), F.lit(1 << 53)) + 0.5) / float(1 << 53)
    rest = due.filter("p <= 0 or size <= 0").select(
        "source", *whole, F.when(u < F.col("p"), 1).otherwise(0).cast("long").alias("more"))
    return (rounded.unionByName(rest)
            .select("id", "source", "size", "rows", "source_size", "target",
                    (F.col("whole") + F.col("more")).alias("copies")))


def share_of(rank, copies, rows):
    """Copies of the rank-th (1-based) of ``rows`` equal rows that share ``copies``."""
    return (F.floor(rank * copies / rows) - F.floor((rank - 1) * copies / rows)).cast("long")


def mix_documents(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source",
                  text_col: str = "text", cap: int = CAP, seed: int = 17) -> DataFrame:
    """The rows of ``docs``, each repeated as often as the mix takes it (0 to ``cap``).

    Rows of equal id, source and size share their copies in an order by a hash of the text;
    they are numbered in PARTS * PARTS parts, so that no task gets all of them."""
    c = written(mix_copies(docs, id_col, source_col, text_col, cap, seed).select(
        F.struct("id", "source", "size").alias("__unit"), F.col("copies").alias("__copies"), F.col("rows").alias("__rows")), "copies")
    unit = F.struct(F.col(id_col).alias("id"), F.col(source_col).alias("source"),
                    n_words(F.col(text_col).cast("string")).alias("size"))
    d = docs.withColumn("__unit", unit)
    # the table of copies grows with the documents: never a broadcast
    both = d.join(c.filter("__rows = 1").hint("merge"), "__unit").withColumn("__n", F.col("__copies"))
    shared = c.filter("__rows > 1")
    if not shared.isEmpty():
        # equal texts are alike, so any of them may come first: their parts follow the place in the input
        part = F.pmod(F.xxhash64(F.col(text_col)), F.lit(PARTS)) * PARTS + F.pmod(F.xxhash64("__row"), F.lit(PARTS))
        # read twice: places must not change
        many = written(d.withColumn("__row", F.monotonically_increasing_id()).join(shared.hint("merge"), "__unit").withColumn("__part", part.cast("int")), "equal-units")
        before = (many.groupBy("__unit", "__part").agg(F.count("*").alias("__m"))
                  .withColumn("__before", F.coalesce(F.sum("__m").over(Window.partitionBy("__unit").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
                  .select(F.struct("__unit", "__part").alias("__key"), "__before"))
        many = (many.withColumn("__at", F.row_number().over(Window.partitionBy("__unit", "__part").orderBy(F.col(text_col), "__row")))
                .withColumn("__key", F.struct("__unit", "__part")).join(before, "__key")
                .withColumn("__n", share_of(F.col("__before") + F.col("__at"), F.col("__copies"), F.col("__rows"))))
        both = both.unionByName(many.select(both.columns))
    both = both.filter("__n > 0")
    return both.withColumn("__i", F.explode(F.sequence(F.lit(1).cast("long"), "__n"))).select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document, sources weighing 1, 2, 3 in turn."""
    c = mix_copies(table(spark, sf_dir, "documents"))
    c = c.withColumn("rank", F.explode(F.sequence(F.lit(1).cast("long"), "rows")))
    return c.select(F.col("id").alias("doc_id"), "size", "source_size", "target",
                    (F.col("size") * share_of(F.col("rank"), F.col("copies"), F.col("rows"))).alias("taken"))


QUERY = LlmQuery("op2_mix_sources", query, None)
