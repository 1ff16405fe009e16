"""Shared helpers: reading tables, tables written to the shared folder, and the
vectorised word and window hashing used inside Arrow tasks.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D.  In UTF-8 these six
bytes never occur inside another character, so the byte rule and the character rule
``[^\\x20\\x09-\\x0D]+`` agree.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forumshift.session import scratch_path

WORD = r"[^\x20\x09-\x0D]+"
U64 = np.uint64
#: bytes hashed at once; bounds the working arrays whatever the length of a text
PIECE = 1 << 20
#: documents in one Arrow batch (a batch is also cut by bytes, see ``bounded_batches``)
BATCH_ROWS = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Few rows for each Arrow batch: texts may be long and Python workers small."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def written(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder (``spark.checkpoint.dir``) and read back: cuts the
    lineage and survives the loss of executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_bytes(df: DataFrame, col: str = "text") -> int:
    """Bytes of all texts (one narrow aggregate); sizes the number of blocks."""
    return df.agg(F.sum(F.octet_length(F.col(col).cast("string")))).first()[0] or 0


def block_count(data_bytes: float, block_mb: float = 8.0, least: int = 16) -> int:
    """Number of column blocks so that one block holds about ``block_mb``."""
    return max(least, math.ceil(data_bytes / (block_mb * 2**20)))


# ---- vectorised hashing -----------------------------------------------------------

def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective): xor-shifts and odd multiplications."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BASE = 0x9E3779B97F4A7C15


def process_cache() -> dict:
    """A dictionary that lives as long as the worker process.  Functions of this package
    reach workers by value, with globals of their own for each task."""
    import sys
    import types

    m = sys.modules.setdefault("_forumshift_process_cache", types.ModuleType("_forumshift_process_cache"))
    return m.__dict__.setdefault("kept", {})


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, at least n of each."""
    kept = process_cache()
    if len(kept.get("up", ())) < n:
        size = max(n, PIECE + 1)
        for name, b in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
            p = np.full(size, U64(b))
            p[0] = 1
            kept[name] = np.cumprod(p, dtype=U64)
    return kept["up"][:n], kept["down"][:n]


def text_buffer(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string array and the n + 1 offsets of its values (null: empty)."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    arr = arr.cast(pa.large_string()).fill_null("")
    if len(arr) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = arr.buffers()
    offsets = np.frombuffer(off, np.int64)[arr.offset:arr.offset + len(arr) + 1]
    if data is None or offsets[-1] == offsets[0]:
        return np.empty(0, np.uint8), np.zeros(len(arr) + 1, np.int64)
    return (np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]], offsets - offsets[0])


def word_spans(a: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte start, byte end and text index of every word, in order."""
    if not len(a):
        z = np.empty(0, np.int64)
        return z, z, z
    inside = (a != 32) & ((a < 9) | (a > 13))
    first = np.zeros(len(a) + 1, bool)
    first[offsets] = True
    before = np.empty(len(a), bool)
    before[0] = False
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | first[:-1]))
    after = np.empty(len(a), bool)
    after[-1] = False
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | first[1:])) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def _lower_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


LOWER = _lower_table()
_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0xD6E8FEB86659FD93))


def word_hashes(a: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of every word, by prefix sums of a polynomial, piece by piece."""
    out = np.empty(len(start), U64)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + PIECE, side="right")))
        s0 = start[i]
        seg = a[s0:end[j - 1]]
        up, down = powers(len(seg) + 1)
        h = np.empty(len(seg) + 1, U64)
        h[0] = 0
        np.cumsum(_BYTE[seg] * up[:-1], out=h[1:])
        s, e = start[i:j] - s0, end[i:j] - s0
        out[i:j] = mix((h[e] - h[s]) * down[s] + (e - s).astype(U64) * U64(0xA0761D6478BD642F))
        i = j
    return out


def windows(h: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each window of k consecutive words of one text, and its first word's index."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, U64), np.empty(0, np.int64)
    up, down = powers(len(h) + 1)
    g = np.empty(len(h) + 1, U64)
    g[0] = 0
    np.cumsum(h * up[:-1], out=g[1:])
    at = np.flatnonzero(doc[:n] == doc[k - 1:])
    return mix((g[at + k] - g[at]) * down[at] + U64(k * 0xE7037ED1A0B428DB % 2**64)), at


def block_of(h: np.ndarray, blocks: int) -> np.ndarray:
    """Column block of a hash: equal ranges of its high 32 bits."""
    return ((h >> U64(32)) * U64(blocks) >> U64(32)).astype(np.int32)


def as_binary(parts: list) -> pa.Array:
    return pa.array([p.tobytes() for p in parts], pa.binary())


def arrow_rows(cols: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, schema.field(n).type) for n, c in cols.items()],
        schema=schema)


# ---- bit tables (Bloom filters with one hash) ----------------------------------------

#: 16 bits for each key, at most this many (16 MB)
MOST_BITS = 1 << 27


def bit_table(keys: DataFrame, col: str) -> np.ndarray:
    """Bits set by a column of 64-bit hashes, for tasks to test keys before an exchange.

    Its size is bounded whatever the number of keys (a full table only saves nothing), and
    what passes is always joined exactly afterwards.  Built by a distributed OR.
    """
    bits = 1 << max(10, min(MOST_BITS.bit_length() - 1, (16 * max(keys.count(), 1)).bit_length()))
    at = f"({col} & {bits - 1}L)"
    words = (keys.select(F.expr(f"shiftright({at}, 6)").alias("w"), F.expr(f"shiftleft(1L, cast({at} & 63 as int))").alias("b"))
             .groupBy("w").agg(F.bit_or("b").alias("b")).toArrow())
    out = np.zeros(bits // 64, U64)
    out[words.column("w").to_numpy()] = words.column("b").to_numpy().view(U64)
    return out


def in_bit_table(filled: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h.astype(U64) & U64(len(filled) * 64 - 1)
    return (filled[(at >> U64(6)).astype(np.int64)] >> (at & U64(63))) & U64(1) == 1


def hits(df: DataFrame, col: str, filled: np.ndarray, inside: bool = True) -> DataFrame:
    """Rows of ``df`` whose hash column passes the bit table (or certainly is not in it)."""
    def run(batches):
        for b in batches:
            m = in_bit_table(filled, b.column(col).to_numpy(zero_copy_only=False))
            yield b.filter(pa.array(m if inside else ~m))

    return df.mapInArrow(run, df.schema)
