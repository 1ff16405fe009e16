"""Operator 9: quality rules with line sequence labelling.

Plain rules first (too few words, too many words in repeated 3-word windows).  Then a
linear-chain conditional random field marks each line of a text as content or
boilerplate: line features (length, symbols, capitals, separators, repetition, ...) are
categories with one weight per label, neighbouring labels have transition weights, and
Viterbi decoding takes the best sequence.  A text is kept if at least ``KEEP_SHARE`` of
its words lie in content lines.

The field is trained here, by gradient ascent on the likelihood (forward-backward), from
weakly labelled lines of at most ``TRAIN_ROWS`` labelled texts of each quality (texts of at
most ``TRAIN_TEXT_LINES`` lines, ``TRAIN_LINES`` in all): lines of good texts are content,
lines of bad ones are not.

Decoding keeps a few bytes for each line and is vectorised over blocks of ``BLOCK_LINES``
lines: each block is decoded once for either label of the line before it, and the blocks of
a text are chained.  So one very long text takes neither a wide grid nor a step per line.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import LlmQuery
from .common import bounded_batches, table, text_buffer, windows, word_hashes, word_spans

LEAST_WORDS, MOST_REPEATED_PCT = 50, 50
#: labelled texts of each quality that the field is fitted on (chosen by a hash of the id)
TRAIN_ROWS = 1500
#: lines of a text that is used for fitting, and of all such texts together
TRAIN_TEXT_LINES, TRAIN_LINES = 2000, 400_000
#: lines decoded step by step; longer texts are chains of such blocks
BLOCK_LINES = 512
KEEP_SHARE = 0.5
ROUNDS, STEP, L2 = 120, 0.3, 1e-3
SYMBOLS = b"#*$%&|<>"
# upper limits (exclusive) of each line feature's categories
LIMITS = {
    "words": (2, 4, 8, 16, 32),
    "symbols_per_word": (1e-9, 0.1, 0.5),
    "upper_share": (0.1, 0.3, 0.6),
    "stop_at_end": (0.5,),
    "seen_before": (0.5,),
    "pipes_per_word": (1e-9, 0.3),
    "digit_share": (0.02, 0.2),
    "exclaims_per_word": (1e-9, 0.3),
    "repeated_share": (0.2, 0.5),
    "bytes_per_word": (3, 9, 14),
}
N_VALUES = max(len(v) for v in LIMITS.values()) + 1


def _byte_counts(a: np.ndarray, which: bytes | np.ndarray) -> np.ndarray:
    t = np.zeros(256, np.int32)
    t[np.frombuffer(which, np.uint8) if isinstance(which, bytes) else which] = 1
    out = np.zeros(len(a) + 1, np.int32 if len(a) < 2**31 else np.int64)
    np.cumsum(t[a], out=out[1:])
    return out


def measure(arr: pa.Array) -> dict:
    """Rule counts of each text, and its lines with a word: owner, words, feature categories."""
    a, off = text_buffer(arr)
    texts = len(arr)
    s, e, doc = word_spans(a, off)
    h = word_hashes(a, s, e)
    count = np.bincount(doc, minlength=texts)
    chars = _byte_counts(a, np.setdiff1d(np.arange(256), np.arange(0x80, 0xC0)))
    word_chars = np.bincount(doc, weights=chars[e] - chars[s], minlength=texts).astype(np.int64)
    symbols = _byte_counts(a, SYMBOLS)
    # words inside 3-word windows that occur twice or more in their text
    x, at = windows(h, doc, 3)
    owner = doc[at]
    order = np.lexsort((x, owner))
    new = np.append(True, (x[order][1:] != x[order][:-1]) | (owner[order][1:] != owner[order][:-1])) if len(x) else np.empty(0, bool)
    n = np.diff(np.append(np.flatnonzero(new), len(x)))
    again = np.empty(len(x), bool)
    again[order] = np.repeat(n > 1, n)
    cover = np.zeros(len(s) + 3, np.int32)
    np.add.at(cover, at[again], 1)
    np.add.at(cover, at[again] + 3, -1)
    repeated = np.cumsum(cover, dtype=np.int32)[:len(s)] > 0
    rep = np.zeros(len(s) + 1, np.int32)
    np.cumsum(repeated, out=rep[1:])
    n_repeat_words = np.bincount(doc[repeated], minlength=texts)
    del cover, again, order, new, owner, x, at, repeated, h
    # lines: cut at \n and at text ends
    ends = np.union1d(np.flatnonzero(a == 10), off[1:]) if len(a) else np.empty(0, np.int64)
    starts = ends.copy()
    if len(ends):
        starts[0] = 0
        starts[1:] = ends[:-1] + (a[np.minimum(ends[:-1], len(a) - 1)] == 10)
    first = np.searchsorted(s, starts)
    words = np.searchsorted(s, ends) - first
    some = words > 0
    starts, ends, first, words = starts[some], ends[some], first[some], words[some]
    line_doc = doc[first]
    tail = a[e[first + words - 1] - 1] if len(words) else np.empty(0, np.uint8)
    repeated_words = rep[first + words] - rep[first]
    del s, e, doc, first, rep, some
    line_hash = word_hashes(a, starts, ends)
    order = np.lexsort((np.arange(len(starts)), line_hash, line_doc))
    seen = np.zeros(len(starts), bool)
    if len(order):
        lh = line_hash[order]
        again = lh[1:] == lh[:-1]
        ld = line_doc[order]
        seen[order[1:]] = again & (ld[1:] == ld[:-1])
        del lh, ld, again
    del line_hash, order

    def per(which):
        c = _byte_counts(a, which)
        return c[ends] - c[starts]

    features = np.empty((len(starts), len(LIMITS)), np.int8)
    for i, (name, limits) in enumerate(LIMITS.items()):
        match name:
            case "words":
                raw = words
            case "symbols_per_word":
                raw = per(SYMBOLS) / words
            case "upper_share":
                upper = per(np.arange(65, 91))
                raw = upper / np.maximum(upper + per(np.append(np.arange(97, 123), np.arange(0xC0, 256))), 1)
            case "stop_at_end":
                raw = np.isin(tail, np.frombuffer(b".!?", np.uint8))
            case "seen_before":
                raw = seen
            case "pipes_per_word":
                raw = per(b"|") / words
            case "digit_share":
                raw = per(np.arange(48, 58)) / np.maximum(ends - starts, 1)
            case "exclaims_per_word":
                raw = per(b"!") / words
            case "repeated_share":
                raw = repeated_words / words
            case "bytes_per_word":
                raw = (ends - starts) / words
        features[:, i] = np.searchsorted(np.array(limits, float), raw.astype(float), side="right")
    return {
        "n_words": count, "word_chars": word_chars, "n_symbols": (symbols[off[1:]] - symbols[off[:-1]]).astype(np.int64),
        "n_dup_lines": np.bincount(line_doc[seen], minlength=texts), "n_repeat_words": n_repeat_words,
        "line_doc": line_doc, "line_words": words, "features": features,
    }


# ---- the field ----------------------------------------------------------------------

def empty_model() -> dict:
    """Without labelled texts of both qualities every line is content."""
    return {"emit": np.zeros((len(LIMITS), N_VALUES, 2)), "step": np.zeros((2, 2)), "start": np.array([0.0, 1.0])}


def _by_length(n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For consecutive runs of ``n`` lines: their order (longest first), each one's first line in
    that order, and how many runs have a line at each place."""
    order = np.argsort(-n, kind="stable")
    active = len(n) - np.searchsorted(np.sort(n), np.arange(n.max(initial=0)), side="right")
    return order, (np.cumsum(n) - n)[order], active


def _emissions(model, features):
    out = np.zeros((len(features), 2))
    for i in range(features.shape[1]):
        out += model["emit"][i][features[:, i]]
    return out


def viterbi(model: dict, features: np.ndarray, doc: np.ndarray, texts: int) -> np.ndarray:
    """Best label of each line (lines of a text are consecutive)."""
    if not len(doc):
        return np.empty(0, np.int8)
    emit = _emissions(model, features)
    lines = np.bincount(doc, minlength=texts)
    lines = lines[lines > 0]
    blocks = -(-lines // BLOCK_LINES)
    text = np.repeat(np.arange(len(lines)), blocks)
    number = np.arange(len(text)) - (np.cumsum(blocks) - blocks)[text]  # of a block in its text
    n = np.minimum(lines[text] - number * BLOCK_LINES, BLOCK_LINES)
    order, begin, active = _by_length(n)
    # score[b, i, j]: best way through block b to label j, from label i of the line before
    back = np.zeros((len(doc), 2, 2), np.int8)
    opening = (number == 0)[order, None, None]
    score = np.where(opening, model["start"][None, None, :], model["step"][None, :, :]) + emit[begin][:, None, :]
    for p in range(1, len(active)):
        k = active[p]
        move = score[:k, :, :, None] + model["step"]
        back[begin[:k] + p] = move.argmax(2)
        score[:k] = move.max(2) + emit[begin[:k] + p][:, None, :]
    del emit
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    score = score[place]
    # chain the blocks of each text, then read the labels back
    entry, first = np.zeros((len(text), 2), np.int8), np.cumsum(blocks) - blocks
    total = score[first, 0]
    long, where, more = _by_length(blocks)
    total = total[long]
    for b in range(1, len(more)):
        k = more[b]
        move = total[:k, :, None] + score[where[:k] + b]
        entry[where[:k] + b] = move.argmax(1)
        total[:k] = move.max(1)
    now = total.argmax(1)
    end, before = np.zeros(len(text), np.int64), np.zeros(len(text), np.int64)
    for b in range(len(more) - 1, -1, -1):
        k = more[b]
        at = where[:k] + b
        end[at] = now[:k]
        before[at] = now[:k] = entry[at, now[:k]]
    label = np.empty(len(doc), np.int8)
    now, before = end[order], before[order]
    for p in range(len(active) - 1, -1, -1):
        k = active[p]
        label[begin[:k] + p] = now[:k]
        if p:
            now[:k] = back[begin[:k] + p, before[:k], now[:k]]
    return label


def fit(features: np.ndarray, doc: np.ndarray, label: np.ndarray, texts: int) -> dict:
    """Weights by gradient ascent (Adagrad) on the conditional likelihood of the labels."""
    model = empty_model()
    lines = np.bincount(doc, minlength=texts)
    order, begin, active = _by_length(lines)
    total_of = np.empty(texts, np.int64)
    total_of[order] = np.arange(texts)
    truth = np.eye(2)[label]
    prev = np.flatnonzero(np.append(doc[1:] == doc[:-1], False))
    is_first = np.append(True, doc[1:] != doc[:-1])

    def by_feature(weights):
        out = np.zeros_like(model["emit"])
        for i in range(features.shape[1]):
            for y in (0, 1):
                out[i, :, y] = np.bincount(features[:, i], weights=weights[:, y], minlength=N_VALUES)
        return out

    seen = {"emit": by_feature(truth), "step": np.zeros((2, 2)), "start": truth[is_first].sum(0)}
    np.add.at(seen["step"], (label[prev], label[prev + 1]), 1)
    square = {k: np.full_like(v, 1e-8) for k, v in seen.items()}

    def lse(x, axis):
        m = x.max(axis, keepdims=True)
        return (m + np.log(np.exp(x - m).sum(axis, keepdims=True))).squeeze(axis)

    for _ in range(ROUNDS):
        emit = _emissions(model, features)
        fwd, bwd = np.zeros_like(emit), np.zeros_like(emit)
        here = begin[:active[0]]
        fwd[here] = model["start"] + emit[here]
        for p in range(1, len(active)):
            at = begin[:active[p]] + p
            fwd[at] = lse(fwd[at - 1][:, :, None] + model["step"], 1) + emit[at]
        pair = np.zeros((2, 2))
        total = np.zeros(texts)
        for p in range(len(active) - 1, -1, -1):
            k, nxt = active[p], active[p + 1] if p + 1 < len(active) else 0
            if nxt:
                at = begin[:nxt] + p
                bwd[at] = lse(model["step"] + (emit[at + 1] + bwd[at + 1])[:, None, :], 2)
            total[nxt:k] = lse(fwd[begin[nxt:k] + p], 1)
        for p in range(len(active) - 1):
            k = active[p + 1]
            at = begin[:k] + p
            pair += np.exp(fwd[at][:, :, None] + model["step"] + (emit[at + 1] + bwd[at + 1])[:, None, :] - total[:k, None, None]).sum(0)
        post = np.exp(fwd + bwd - total[total_of[doc]][:, None])
        want = {"emit": by_feature(post), "step": pair, "start": post[is_first].sum(0)}
        for name in model:
            g = (seen[name] - want[name]) / texts - L2 * model[name]
            square[name] += g * g
            model[name] = model[name] + STEP * g / np.sqrt(square[name])
    return model


def _training_lines(batches):
    for b in batches:
        m = measure(b.column("t"))
        good = b.column("good").to_numpy(zero_copy_only=False).astype(bool)
        cut = np.searchsorted(m["line_doc"], np.arange(b.num_rows + 1))
        label = good[m["line_doc"]].astype(np.int8)
        yield pa.RecordBatch.from_arrays(
            [pa.array([m["features"][i:j].tobytes() for i, j in zip(cut, cut[1:])], pa.binary()),
             pa.array([label[i:j].tobytes() for i, j in zip(cut, cut[1:])], pa.binary())], names=["features", "labels"])


def fit_line_model(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   quality_col: str = "quality", rows: int = TRAIN_ROWS) -> dict:
    """The field fitted on at most ``rows`` labelled texts of each quality (a bounded sample
    chosen by a hash of the id, joined in as a small side), without those of more than
    TRAIN_TEXT_LINES lines and up to TRAIN_LINES lines in all; null ids or labels are not used."""
    bounded_batches(docs.sparkSession)
    lab = (labels.select(F.col(id_col).cast("long").alias("id"), (F.col(quality_col) > 0).alias("good"))
           .filter("id IS NOT NULL AND good IS NOT NULL").distinct())
    order = F.xxhash64("id", F.lit(9))
    sample = lab.filter("good").orderBy(order, "id").limit(rows).union(lab.filter("not good").orderBy(order, "id").limit(rows))
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    got = (base.join(F.broadcast(sample), "id").select("id", "t", "good")  # at most 2 * rows rows
           .mapInArrow(_training_lines, "features binary, labels binary").filter(F.octet_length("labels") <= TRAIN_TEXT_LINES)
           .orderBy(F.sha2("features", 256)).collect())
    got = [(np.frombuffer(r["features"], np.int8).reshape(-1, len(LIMITS)), np.frombuffer(r["labels"], np.int8))
           for r in got if len(r["labels"])]
    got = [x for x, n in zip(got, np.cumsum([len(y) for _, y in got])) if n <= TRAIN_LINES]
    if len({int(y) for _, y in got for y in np.unique(y)}) < 2:
        return empty_model()
    doc = np.repeat(np.arange(len(got)), [len(y) for _, y in got])
    return fit(np.concatenate([x for x, _ in got]), doc, np.concatenate([y for _, y in got]), len(got))


# ---- the operator -------------------------------------------------------------------

def judge(model: dict, arr: pa.Array) -> dict:
    m = measure(arr)
    label = viterbi(model, m["features"], m["line_doc"], len(arr))
    m["content_words"] = np.bincount(m["line_doc"], weights=m["line_words"] * label, minlength=len(arr)).astype(np.int64)
    m["base_failed"] = (m["n_words"] < LEAST_WORDS) | (100 * m["n_repeat_words"] > MOST_REPEATED_PCT * m["n_words"])
    m["kept"] = ~m["base_failed"] & (m["content_words"] >= KEEP_SHARE * m["n_words"])
    return m


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "content_words", "base_failed", "kept")


def rate_texts(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, content_words,
    base_failed, kept)`` of each row.  A null or empty text has no words and fails; null ids
    and repeated rows keep their own rows; other columns are ignored."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            m = judge(model, b.column("t"))
            yield pa.RecordBatch.from_arrays(
                [b.column("id")] + [pa.array(m[c], pa.bool_() if m[c].dtype == bool else pa.int64()) for c in COLUMNS],
                names=["id", *COLUMNS])

    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    kind = ", ".join(f"{c} {'boolean' if c in ('base_failed', 'kept') else 'long'}" for c in COLUMNS)
    return base.mapInArrow(run, f"id long, {kind}").withColumnRenamed("id", id_col)


def keep_good_texts(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose texts are kept, all columns unchanged (no shuffle)."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(judge(model, b.column(text_col))["kept"]))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule counts and the field's verdict for every document."""
    docs = table(spark, sf_dir, "documents")
    return rate_texts(docs, fit_line_model(docs, table(spark, sf_dir, "labels"))).drop("content_words")


QUERY = LlmQuery("op9_quality_rules", query, None)
