"""Operator 6: token ids in fixed-width bit-packed files.

Format: ``blocks``, a folder of Parquet part files, and ``ranges``, their index.  A row of
``blocks`` is one block of one document range (``part``): the place of its first id in the
range (``at``), how many ids it holds, the bits of an id (``width``, the fewest that hold
the vocabulary), its documents (``doc_ids``, ``doc_starts`` within the block) and the ids
packed with ``width`` bits each, least significant bit first.  A row of ``ranges`` is a
range's place in the whole stream (``base``) and length.  All ids have the same width, so
id ``i`` of a block begins at bit ``i * width``: a block, or any slice of it, unpacks by
vectorised numpy, and position ``p`` is found from ``ranges`` and ``at`` (Parquet's
statistics skip the other blocks).

Writing: documents are dealt in ranges of their id and sorted; each range is encoded and
packed by its own task into blocks of about ``BLOCK_IDS`` ids (whole documents); the global starts are a prefix sum over the ranges' totals.  Encoding looks each
distinct word of a batch up once: the tokenizer's normaliser and splitter never look
across white space, so the ids of a text are those of its words (tested against whole-text
encoding).  Words are matched by a 64-bit hash and the tokenizer sees each new one.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from forumshift.session import scratch_path

from . import LlmQuery
from .common import U64, bounded_batches, process_cache, table, text_buffer, text_bytes, word_hashes, word_spans

END_ID = 2
BLOCK_IDS = 1 << 18
RANGE_MB = 16
#: distinct words a worker keeps (bounds its memory)
KEEP_WORDS = 1_500_000
#: ranges (12 bytes each) whose places are broadcast; more are joined
BROADCAST_RANGES = 500_000
#: ids packed or unpacked at once
AT_ONCE = 1 << 16
BLOCK_SCHEMA = ("part int, at long, count long, width int, doc_ids array<long>, row_keys array<long>, "
                "doc_starts array<long>, ids binary")


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


#: widths at which the packed bits are plain little-endian integers
WHOLE = {8: "<u1", 16: "<u2", 32: "<u4"}


def pack(ids: np.ndarray, width: int) -> bytes:
    """``width`` bits for each id, least significant bit first."""
    if width in WHOLE:
        return ids.astype(WHOLE[width]).tobytes()
    out = []
    for i in range(0, len(ids), AT_ONCE):  # a multiple of 8 ids ends on a whole byte
        part = ids[i:i + AT_ONCE].astype(np.uint32)
        bits = (part[:, None] >> np.arange(width, dtype=np.uint32)) & np.uint32(1)
        out.append(np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes())
    return b"".join(out)


def unpack(data, width: int, start: int, stop: int) -> np.ndarray:
    """Ids ``start`` to ``stop`` (exclusive) of a packed block, reading only their bytes."""
    if width in WHOLE:
        return np.frombuffer(data, WHOLE[width])[start:stop].astype(np.uint32)
    out = [np.empty(0, np.uint32)]
    weights = np.left_shift(np.uint32(1), np.arange(width, dtype=np.uint32))
    for i in range(start, stop, AT_ONCE):
        j = min(i + AT_ONCE, stop)
        first = i * width // 8
        bits = np.unpackbits(np.frombuffer(data, np.uint8)[first:-(-j * width // 8)], bitorder="little")
        bits = bits[i * width - first * 8:][:(j - i) * width]
        out.append((bits.reshape(-1, width) * weights).sum(axis=1, dtype=np.uint32))
    return np.concatenate(out)


class WordEncoder:
    """Ids of texts from a tokenizer file, by their distinct words."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.clear()

    def clear(self):
        self.hash = np.empty(0, U64)
        self.first = np.empty(0, np.int64)
        self.n = np.empty(0, np.int64)
        self.ids = np.empty(0, np.uint32)

    def _learn(self, a, s, e, h):
        words = [a[i:j].tobytes().decode("utf-8") for i, j in zip(s, e)]
        out = [x.ids for x in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        n = np.array([len(x) for x in out], np.int64)
        first = np.concatenate([[0], np.cumsum(n)])[:-1].astype(np.int64) + len(self.ids)
        self.ids = np.concatenate([self.ids, np.array([v for x in out for v in x], np.uint32)])
        at = np.searchsorted(self.hash, h)
        self.hash, self.first, self.n = (np.insert(x, at, y) for x, y in ((self.hash, h), (self.first, first), (self.n, n)))

    def __call__(self, arr) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (each followed by the end id) and the n + 1 offsets."""
        a, off = text_buffer(arr)
        s, e, doc = word_spans(a, off)
        h = word_hashes(a, s, e)
        u, at, back = np.unique(h, return_index=True, return_inverse=True)
        if len(self.hash) + len(u) > KEEP_WORDS:
            self.clear()
        row = np.searchsorted(self.hash, u)
        new = np.append(self.hash, U64(0))[row] != u
        new |= row == len(self.hash)
        if new.any():
            self._learn(a, s[at[new]], e[at[new]], u[new])
        row = np.searchsorted(self.hash, u)[back]
        first, n = self.first[row], self.n[row]
        texts = len(arr)
        per_text = np.bincount(doc, weights=n, minlength=texts).astype(np.int64) + 1
        offsets = np.concatenate([[0], np.cumsum(per_text)])
        out = np.full(offsets[-1], END_ID, np.uint32)
        total = int(n.sum())
        if total:
            begin = np.concatenate([[0], np.cumsum(n)])[:-1]
            inner = np.arange(total) - np.repeat(begin, n)
            # a word's place in the output: its place among all words' ids, plus one end id for each text before
            out[np.arange(total) + np.repeat(doc, n)] = self.ids[np.repeat(first, n) + inner]
        return out, offsets


def encode_ranges(path: str, width: int):
    """Sorted rows (id, v, t) of one range -> its blocks."""
    def run(batches):
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        kept = process_cache()  # one loaded file for each worker process
        if path not in kept:
            kept[path] = WordEncoder(path)
        for b in batches:
            ids, off = kept[path](b.column("t"))
            docs, keys = b.column("id").to_pylist(), b.column("v").to_pylist()
            group = off[:-1] // BLOCK_IDS  # whole documents; a long one makes a long block
            cut = np.flatnonzero(np.diff(group, prepend=-1))
            for i, j in zip(cut, np.append(cut[1:], len(docs))):
                lo, hi = off[i], off[j]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part], pa.int32()), pa.array([at], pa.int64()), pa.array([hi - lo], pa.int64()),
                     pa.array([width], pa.int32()), pa.array([docs[i:j]], pa.list_(pa.int64())),
                     pa.array([keys[i:j]], pa.list_(pa.int64())), pa.array([(off[i:j] - lo).tolist()], pa.list_(pa.int64())),
                     pa.array([pack(ids[lo:hi], width)], pa.binary())],
                    names=["part", "at", "count", "width", "doc_ids", "row_keys", "doc_starts", "ids"])
                at += hi - lo
    return run


def write_token_files(docs: DataFrame, tokenizer_path: str, out_path: str | None = None, id_col: str = "doc_id",
                      text_col: str = "text") -> str:
    """Encode ``docs`` in ascending id order into the format above; returns the folder.

    Null texts are empty (only the end id).  Null ids come last; rows that share an id are
    ordered by a hash of their texts.  Other columns are ignored; an empty table writes an
    empty folder.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    bounded_batches(spark)
    vocabulary = max(Tokenizer.from_file(tokenizer_path).get_vocab_size(with_added_tokens=True), END_ID + 1)
    out_path = out_path or scratch_path(spark, "token-files")
    t = F.col(text_col).cast("string")
    ranges = max(8, -(-text_bytes(docs, text_col) // (RANGE_MB << 20)))
    sorted_ = (docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.xxhash64(t), F.lit(0)).alias("v"), t.alias("t"))
               .repartitionByRange(ranges, F.col("id").asc_nulls_last(), F.col("v"))
               .sortWithinPartitions(F.col("id").asc_nulls_last(), "v"))
    (sorted_.mapInArrow(encode_ranges(tokenizer_path, bits_for(vocabulary)), BLOCK_SCHEMA)
     .write.option("compression", "zstd").parquet(f"{out_path}/blocks"))
    # prefix sum over the ranges' totals (one row a range)
    totals = spark.read.parquet(f"{out_path}/blocks").groupBy("part").agg(F.sum("count").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    (totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"), "total")
     .write.parquet(f"{out_path}/ranges"))
    return out_path


def _placed(spark: SparkSession, path: str) -> DataFrame:
    """Blocks with their place in the whole stream (``start``)."""
    ranges = spark.read.parquet(f"{path}/ranges").select("part", "base")
    if ranges.count() <= BROADCAST_RANGES:
        ranges = F.broadcast(ranges)
    blocks = spark.read.parquet(f"{path}/blocks")
    return blocks.join(ranges, "part").withColumn("start", F.col("base") + F.col("at"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """``(id, row_key, start, n_tokens, ids_crc32)`` of every document in the files.

    Each block's task unpacks its ids and cuts them at the documents' starts.
    """
    files = _placed(spark, path).select("start", "count", "width", "doc_ids", "row_keys", "doc_starts", "ids")
    return files.mapInArrow(_documents, "id long, row_key long, start long, n_tokens long, ids_crc32 long")


def read_slice(spark: SparkSession, path: str, start: int, stop: int) -> np.ndarray:
    """Ids ``start`` to ``stop`` (exclusive) of the whole stream: random access by position."""
    rows = (_placed(spark, path).filter((F.col("start") < stop) & (F.col("start") + F.col("count") > start))
            .select("start", "count", "width", "ids").orderBy("start").collect())
    return np.concatenate([np.empty(0, np.uint32)] + [
        unpack(r["ids"], r["width"], max(0, start - r["start"]), min(r["count"], stop - r["start"])) for r in rows])


def _documents(batches):
    for b in batches:
        for start, count, width, ids, keys, firsts, data in zip(*(c.to_pylist() for c in b.columns)):
            raw = np.asarray(unpack(data, width, 0, count), "<u4")
            edges = firsts + [count]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array([start + x for x in firsts], pa.int64()),
                 pa.array(np.diff(edges), pa.int64()),
                 pa.array([zlib.crc32(raw[i:j].tobytes()) for i, j in zip(edges, edges[1:])], pa.int64())],
                names=["id", "row_key", "start", "n_tokens", "ids_crc32"])


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Start, length and checksum of every document's ids, read back from the files."""
    files = write_token_files(table(spark, sf_dir, "documents"), default_tokenizer())
    return read_documents(spark, files).select(F.col("id").alias("doc_id"), "start", "n_tokens", "ids_crc32")


QUERY = LlmQuery("op6_token_files", query, None)
