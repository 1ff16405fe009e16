"""Operator 7: benchmark decontamination by template canonicalisation.

Benchmark items and texts become sequences of canonical words: case and edge punctuation
go, numbers, units and names become typed placeholders (runs of one type are one slot).
Windows of ``WINDOW`` canonical words are hashed and joined; windows that are mostly
placeholders are not used.  Each window also has a plain form without placeholders, so a
verbatim passage is found whatever the types.  Windows of a text and an item on one
diagonal are one alignment: its slots must be consistent, the same item value always
against the same text value and the other way round.  An item leaks into a text if
consistent windows cover at least ``COVERED_PCT`` per cent of its words: a re-parameterised question
(other numbers, names, units in every place) is caught like a copy.  So does one that has
``VERBATIM_RUN`` words in a row word for word in the text, whatever their share of a long item.

Items of fewer than ``LEAST_WORDS`` canonical words say too little as templates.  They leak by their
whole literal sequence of words, signs included: anywhere in a text if that has ``SHORT_WORDS``
words or more, else only as the whole text.

Texts are scanned once; of their windows only those go to the join that pass a bit table
of the benchmark's windows (a Bloom filter whose size is bounded; it only saves exchange).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import LlmQuery
from .common import (LOWER, U64, bit_table, bounded_batches, in_bit_table, mix, table, text_buffer, windows, word_hashes, word_spans, written)

WINDOW, COVERED_PCT, LEAST_WORDS, LITERAL_PCT = 8, 50, 5, 60
#: slot pairs of an alignment that may contradict the others
MOST_CLASHES_PCT = 20
VERBATIM_RUN, SHORT_WORDS = 30, 4  # the fixed words of a question template make shorter runs
BROADCAST_ROWS = 500_000

# fixed values: words that stand for numbers, and units of measure
NUMBER_WORDS = ("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen "
                "seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million "
                "billion dozen half third quarter twice double triple").split()
UNIT_WORDS = ("mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ton tons pound pounds "
              "ounce ounces ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours "
              "day days week weeks month months year years meter meters metre metres kilometer kilometers kilometre kilometres "
              "mph kmh km/h m/s hz khz mhz ghz w kw v kv n j kj cal kcal pa kpa bar c f k usd eur gbp dollar dollars euro euros "
              "cent cents percent degree degrees byte bytes kb mb gb tb").split()
NUMBER, UNIT, NAME = 1, 2, 3


def _words_hash(words) -> np.ndarray:
    a, off = text_buffer(pa.array([w for w in words]))
    s, e, _ = word_spans(a, off)
    return np.sort(word_hashes(a, s, e))


def canonical(arr: pa.Array):
    """Canonical words of texts: owner, literal hash, typed hash, type, and the byte span of
    the words (of a run, for a placeholder); also the bytes."""
    raw, off = text_buffer(arr)
    s, e, doc = word_spans(raw, off)
    a = LOWER[raw]
    after = np.append(False, raw[:-1] == 0xC3)  # capital letters of Latin-1 in UTF-8
    latin = after & (raw >= 0x80) & (raw <= 0x9E) & (raw != 0x97)
    a = np.where(latin, raw + np.uint8(32), a)
    stops = np.isin(raw[e - 1], np.frombuffer(b".!?:", np.uint8)) if len(e) else np.empty(0, bool)
    low = np.arange(256)
    edge = ~(((low >= 48) & (low < 58)) | ((low >= 65) & (low < 91)) | ((low >= 97) & (low < 123)) | (low >= 128))
    while True:  # cut punctuation from both ends
        cut = (s < e) & edge[a[np.minimum(s, len(a) - 1)]] if len(a) else np.empty(0, bool)
        if not cut.any():
            break
        s = s + cut
    while True:
        cut = (s < e) & edge[a[e - 1]]
        if not cut.any():
            break
        e = e - cut
    some = s < e
    begins = np.append(True, stops[:-1] | (doc[1:] != doc[:-1])) if len(doc) else np.empty(0, bool)
    # a line feed before the word also begins a sentence
    nl = np.concatenate([[0], np.cumsum(raw == 10)])
    prev = np.append(0, e[:-1]) if len(e) else e
    begins |= nl[s] > nl[np.minimum(prev, s)] if len(s) else begins
    s, e, doc, begins = s[some], e[some], doc[some], begins[some]
    if not len(s):
        z = np.empty(0, np.int64)
        return z, z.astype(U64), z.astype(U64), z, z, z, raw
    h = word_hashes(a, s, e)
    count = {k: np.concatenate([[0], np.cumsum(v)]) for k, v in (
        ("digit", (raw >= 48) & (raw < 58)), ("upper", ((raw >= 65) & (raw < 91)) | latin),
        ("letter", ((a >= 97) & (a < 123)) | (a >= 128)))}
    n = {k: c[e] - c[s] for k, c in count.items()}
    title = (count["upper"][np.minimum(s + 2, e)] > count["upper"][s]) & (n["upper"] == 1)
    first = ((raw[s] >= 65) & (raw[s] < 91)) | (raw[s] == 0xC3)
    kind = np.zeros(len(s), np.int64)
    kind[title & first & ~begins] = NAME
    kind[np.isin(h, _words_hash(UNIT_WORDS)) & np.append(False, (n["digit"] > 0)[:-1] & (doc[1:] == doc[:-1]))] = UNIT
    kind[((n["digit"] > 0) & (n["letter"] == 0)) | np.isin(h, _words_hash(NUMBER_WORDS))] = NUMBER
    run = (kind > 0) & np.append(False, (kind[1:] == kind[:-1]) & (doc[1:] == doc[:-1]))
    keep = np.flatnonzero(~run)
    last = np.append(keep[1:], len(s)) - 1
    marks = mix(np.arange(1, 5, dtype=U64) * U64(0x8CB92BA72F3D8DD7))
    typed = np.where(kind > 0, marks[kind], h)
    # the literal form of a run: its words' hashes combined
    g = np.concatenate([[U64(0)], np.cumsum(mix(h + U64(1)), dtype=U64)])
    literal = np.where(last > keep, mix(g[last + 1] - g[keep]), h[keep])
    return doc[keep], literal, typed[keep], kind[keep], s[keep], e[last], raw


def template_windows(arr: pa.Array, sizes):
    """All windows: owner, first canonical word, length, hash (bit 0: typed form), and the
    canonical words themselves."""
    doc, literal, typed, kind, s, e, raw = canonical(arr)
    out = []
    lit = np.concatenate([[0], np.cumsum(kind == 0)])
    for k in sizes:
        for form, h in ((0, literal), (1, typed)):
            x, at = windows(h, doc, k)
            if form:
                slots = k - (lit[at + k] - lit[at])
                ok = (slots > 0) & (100 * (k - slots) >= LITERAL_PCT * k)
                x, at = x[ok], at[ok]
            out.append((doc[at], at, np.full(len(at), k), (x & ~U64(1)) | U64(form)))
    cols = [np.concatenate(c) for c in zip(*out)] if out else [np.empty(0, np.int64)] * 3 + [np.empty(0, U64)]
    return cols, (doc, kind, s, e, raw)


def _rows(owners, cols, pick, words, ids):
    """Arrow rows of picked windows with their slot values (empty for plain forms)."""
    own, at, k, x = (c[pick] for c in cols)
    doc, kind, s, e, raw = words
    first = np.searchsorted(doc, np.arange(owners))
    slots = []
    for p, n, h in zip(at, k, x):
        slots.append([bytes(LOWER[raw[s[i]:e[i]]]).decode("utf-8", "replace") for i in range(p, p + n) if kind[i]] if int(h) & 1 else [])
    out = [c.take(pa.array(own)) for c in ids]
    return out + [pa.array(at - first[own], pa.int32()), pa.array(k, pa.int32()), pa.array(x.view(np.int64)), pa.array(slots, pa.list_(pa.string()))]


def _item_windows(batches):
    for b in batches:
        doc = canonical(b.column("t"))[0]
        n = np.bincount(doc, minlength=b.num_rows)
        sizes = sorted({int(min(WINDOW, x)) for x in n if x >= LEAST_WORDS})
        cols, words = template_windows(b.column("t"), sizes)
        pick = np.flatnonzero(cols[2] == np.minimum(WINDOW, n[cols[0]]))
        total = pa.array(n[cols[0][pick]], pa.int32())
        yield pa.RecordBatch.from_arrays(_rows(b.num_rows, cols, pick, words, [b.column("item")]) + [total],
                                         names=["item", "item_at", "k", "h", "item_slots", "item_words"])


def _text_windows(sizes, filled):
    def run(batches):
        for b in batches:
            cols, words = template_windows(b.column("t"), sizes)
            pick = np.flatnonzero(in_bit_table(filled, cols[3]))
            if len(pick):
                yield pa.RecordBatch.from_arrays(_rows(b.num_rows, cols, pick, words, [b.column("id"), b.column("v")]),
                                                 names=["id", "v", "at", "k", "h", "slots"])
    return run


def _consistent(batches):
    """Alignments -> covered places of the item, if the slots agree."""
    for b in batches:
        keep, places, verbatim, runs = [], [], [], []
        for w in b.column("w").to_pylist():
            there: dict = {}
            back: dict = {}
            ok, seen, clashes = set(), set(), set()
            for x in sorted(w, key=lambda x: (x["item_at"], x["k"], len(x["slots"]))):
                pairs = [(x["item_at"], i, p) for i, p in enumerate(zip(x["item_slots"], x["slots"]))]
                bad = [p for p in pairs if there.setdefault(p[2][0], p[2][1]) != p[2][1] or back.setdefault(p[2][1], p[2][0]) != p[2][0]]
                seen.update(pairs)
                clashes.update(bad)
                if not bad:
                    ok.add((x["item_at"], x["k"], bool(pairs)))
            # one slot value that stands for several others is no substitution: then only plain windows count
            agree = 100 * len(clashes) <= MOST_CLASHES_PCT * len(seen)
            plain, longest = {}, 0  # last place of a run of plain windows that begin one word after the other
            for at, k, typed in sorted(ok):
                if not typed:
                    begin = plain.pop((at - 1, k), at)
                    plain[at, k] = begin
                    longest = max(longest, at + k - begin)
            ok = {i for at, k, typed in ok if agree or not typed for i in range(at, at + k)}
            keep.append(bool(ok))
            runs.append(longest)
            places.append(sorted(ok))
            verbatim.append(all(i == t for i, t in there.items()))
        m = pa.array(keep)
        yield pa.RecordBatch.from_arrays(
            [b.column(c).filter(m) for c in ("id", "v", "item", "item_words")]
            + [pa.array(places, pa.list_(pa.int32())).filter(m), pa.array(verbatim).filter(m), pa.array(runs, pa.int32()).filter(m)],
            names=["id", "v", "item", "item_words", "places", "verbatim", "run"])


# ---- items too short for templates -------------------------------------------------------

def literal_words(arr: pa.Array):
    """Owner and hash of each word in lower case, without punctuation at its ends unless it is
    nothing else."""
    raw, off = text_buffer(arr)
    s, e, doc = word_spans(raw, off)
    a = LOWER[raw]
    low = np.arange(256)
    inside = np.concatenate([[0], np.cumsum(((low >= 48) & (low < 58) | (low >= 97) & (low < 123) | (low >= 128))[a])])
    if not len(s):
        return doc, np.empty(0, U64)
    at = np.flatnonzero(np.diff(inside))
    some = inside[e] > inside[s]
    s, e = s.copy(), e.copy()
    s[some], e[some] = at[inside[s[some]]], at[inside[e[some]] - 1] + 1
    return doc, word_hashes(a, s, e)


def _sequences(doc, h, texts, sizes, whole):
    """Windows of the given sizes, and for texts of ``whole`` words or fewer the text itself (size 0)."""
    n = np.bincount(doc, minlength=texts)
    first = np.searchsorted(doc, np.arange(texts))
    for k in sizes:
        x, at = windows(h, doc, k)
        yield doc[at], at - first[doc[at]], np.full(len(at), k), x
    for k in range(1, whole + 1):
        x, at = windows(h, doc, k)
        own = n[doc[at]] == k
        yield doc[at][own], np.zeros(own.sum(), np.int64), np.zeros(own.sum(), np.int64), x[own]


def _short_items(batches):
    for b in batches:
        short = np.bincount(canonical(b.column("t"))[0], minlength=b.num_rows) < LEAST_WORDS
        doc, h = literal_words(b.column("t"))
        n = np.bincount(doc, minlength=b.num_rows)
        sizes = sorted({int(min(WINDOW, x)) for x in n[short] if x >= SHORT_WORDS})
        for own, at, k, x in _sequences(doc, h, b.num_rows, sizes, SHORT_WORDS - 1):
            pick = short[own] & ((k == 0) | (k == np.minimum(WINDOW, n[own])))
            yield pa.RecordBatch.from_arrays(
                [b.column("item").take(pa.array(own[pick])), pa.array(at[pick], pa.int32()), pa.array(k[pick], pa.int32()),
                 pa.array(x[pick].view(np.int64)), pa.array(n[own][pick], pa.int32())], names=["item", "item_at", "k", "h", "item_words"])


def _short_windows(sizes, filled):
    def run(batches):
        for b in batches:
            doc, h = literal_words(b.column("t"))
            for own, at, k, x in _sequences(doc, h, b.num_rows, [k for k in sizes if k], SHORT_WORDS - 1 if 0 in sizes else 0):
                pick = in_bit_table(filled, x)
                if pick.any():
                    yield pa.RecordBatch.from_arrays(
                        [b.column("id").take(pa.array(own[pick])), b.column("v").take(pa.array(own[pick])), pa.array(at[pick], pa.int32()),
                         pa.array(k[pick], pa.int32()), pa.array(x[pick].view(np.int64))], names=["id", "v", "at", "k", "h"])
    return run


def _short_leaks(base: DataFrame, benchmark_texts: DataFrame) -> DataFrame | None:
    """Leaks of items too short for templates: all of their words in a row."""
    items = written(benchmark_texts.mapInArrow(_short_items, "item long, item_at int, k int, h long, item_words int"), "short-items")
    sizes = sorted(r["k"] for r in items.select("k").distinct().collect())  # at most WINDOW values
    if not sizes:
        return None
    found = base.mapInArrow(_short_windows(sizes, bit_table(items.select("h"), "h")), "id long, v long, at int, k int, h long")
    # a word sequence repeats inside an item at most as often as the item has windows
    return (found.join(items, ["h", "k"]).groupBy("id", "v", "item", "item_words", "k", (F.col("at") - F.col("item_at")).alias("diagonal"))
            .agg(F.countDistinct("item_at").alias("met"))
            .filter("k = 0 OR met = item_words - k + 1")
            .select("id", "v", "item", "item_words").distinct()
            .select("id", "v", "item", "item_words", F.col("item_words").cast("long").alias("covered"), F.lit(True).alias("verbatim"), F.col("item_words").alias("run")))


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``(id, text_hash, item, covered, item_words, covered_pct, verbatim)`` of every text and
    benchmark item that leaks into it.

    Items shorter than ``WINDOW`` canonical words are one window, those with fewer than
    ``LEAST_WORDS`` leak by their literal words only; null and empty items never leak.  Null and
    empty texts have no windows.  Ids are integers.  Rows sharing an id but not the text are texts of their own (``text_hash``);
    repeated rows are one text here.  Null ids stay null.  Other columns are ignored.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    asked = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).cast("string").alias("t"))
    items = written(asked.mapInArrow(_item_windows, "item long, item_at int, k int, h long, item_slots array<string>, item_words int"), "items")
    sizes = sorted(r["k"] for r in items.select("k").distinct().collect())  # at most WINDOW values
    filled = bit_table(items.select("h"), "h")
    t = F.col(text_col).cast("string")
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.xxhash64(t), F.lit(0)).alias("v"), t.alias("t"))
    found = base.mapInArrow(_text_windows(sizes, filled), "id long, v long, at int, k int, h long, slots array<string>")
    met = found.join(items, ["h", "k"]).select("id", "v", "item", "item_words", (F.col("at") - F.col("item_at")).alias("diagonal"),
                                               F.struct("item_at", "k", "slots", "item_slots").alias("x"))
    aligned = (met.groupBy("id", "v", "item", "item_words", "diagonal").agg(F.collect_set("x").alias("w")).drop("diagonal")
               .mapInArrow(_consistent, "id long, v long, item long, item_words int, places array<int>, verbatim boolean, run int"))
    leaks = (aligned.withColumn("place", F.explode("places"))
             .groupBy("id", "v", "item", "item_words").agg(F.countDistinct("place").alias("covered"), F.min("verbatim").alias("verbatim"), F.max("run").alias("run"))
             .filter((F.col("covered") * 100 >= F.col("item_words") * COVERED_PCT) | (F.col("run") >= VERBATIM_RUN)))
    short = _short_leaks(base, asked)
    leaks = leaks if short is None else leaks.unionByName(short)
    return (leaks.withColumn("covered_pct", F.col("covered") * 100.0 / F.col("item_words"))
            .select(F.col("id").alias(id_col), F.col("v").alias("text_hash"), F.col("item").alias(item_col),
                    "covered", "item_words", "covered_pct", "verbatim"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` into which no benchmark item leaks, all columns unchanged."""
    leaks = written(find_leaks(docs, benchmark, id_col, text_col)
                    .select(F.col(id_col).alias("__id"), F.col("text_hash").alias("__v")).distinct(), "leaks")
    if leaks.count() <= BROADCAST_ROWS:  # 16 bytes a row
        leaks = F.broadcast(leaks)
    v = F.coalesce(F.xxhash64(F.col(text_col).cast("string")), F.lit(0))
    return docs.join(leaks, F.col(id_col).cast("long").eqNullSafe(F.col("__id")) & (v == F.col("__v")), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents into which benchmark items leak."""
    r = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return r.groupBy("doc_id", "item_id").agg(F.max("covered").cast("long").alias("covered"), F.max("item_words").cast("long").alias("item_words"),
                                              F.max("verbatim").alias("verbatim"))


QUERY = LlmQuery("op7_decontaminate", query, None)
