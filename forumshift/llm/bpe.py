"""Operator 12: byte-level BPE encoding by a trie of distinct words, and decoding.

The encoding of a word's prefix ends in one token, and what stands before that token is the
encoding of a shorter prefix.  So each prefix needs one state only, its last token: the one
token that ends the prefix and whose seam with the state before it no merge would close.
Distinct words form a trie; in byte order they come as a depth-first walk of it, and the
states of the path that a word shares with the one before are still on the stack.  Each
node's state is computed once, and a word's ids are read off its path backwards.

Texts are cut into words by array operations over whole Arrow batches, long texts piece by
piece; a word seen before in this worker process is looked up.  Nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import LlmQuery
from .common import PIECE, bounded_batches, process_cache, table, text_buffer, word_hashes

#: words and seams that a worker process remembers; beyond that it starts anew
KEEP_WORDS, KEEP_SEAMS = 400_000, 1_000_000
#: classes of code points: letters, numbers, white space, all others, and an added token
LETTER, NUMBER, SPACE, OTHER, ADDED, UNKNOWN = 1, 2, 0, 3, 4, 255
#: fixed values: what splits off after an apostrophe
ONE_LETTER, TWO_LETTERS = b"stmd", (b"re", b"ve", b"ll")
NEVER = 1 << 62


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes stand
    for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Merges of a tokenizer file, and the seams that they leave open."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, split = spec["model"], spec["pre_tokenizer"] or {}
        plain = (model["type"] == "BPE" and not model.get("dropout") and not model.get("ignore_merges")
                 and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix")
                 and split.get("type") == "ByteLevel" and not split["add_prefix_space"] and split.get("use_regex", True)
                 and not spec["normalizer"] and not any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]))
        if not plain:
            raise ValueError("only plain byte-level BPE files are supported")
        letters = byte_letters()
        spell = lambda t: bytes(letters[c] for c in t)
        vocab = model["vocab"]
        self.added = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        self.spelling = {i: spell(t) for t, i in vocab.items()} | {i: t for t, i in self.added.items()}
        # how each token is put together; a byte is there from the start
        self.parts, self.rank, self.merge = {}, {}, {}
        for c in letters:
            self.rank[vocab[c]] = -1
        for rank, m in enumerate(model["merges"]):
            left, right = (vocab[x] for x in (m.split(" ") if isinstance(m, str) else m))
            whole = vocab["".join(m.split(" ") if isinstance(m, str) else m)]
            if whole in self.rank or self.rank.get(left, rank) >= rank or self.rank.get(right, rank) >= rank:
                raise ValueError("a token must be made by one merge, after its parts")
            self.parts[whole], self.rank[whole], self.merge[left << 32 | right] = (left, right), rank, rank
        self.edges: dict[tuple, list] = {}
        self.seams: dict[int, bool] = {}
        # tokens that come out when their own bytes are encoded
        self.sound = set()
        for t in sorted(self.rank, key=self.rank.get):
            if t not in self.parts or (all(x in self.sound for x in self.parts[t]) and self.first_merge(*self.parts[t]) == self.parts[t]):
                self.sound.add(t)
        self.token = {self.spelling[t]: t for t in self.sound}
        self.starts = {b[:i] for b in self.token for i in range(1, len(b) + 1)}
        self.size = {t: len(self.spelling[t]) for t in self.sound}

    def edge(self, t: int, side: int) -> list:
        """The tokens that form one edge of ``t`` while it is put together, from its byte on."""
        got = self.edges.get((t, side))
        if got is None:
            got = self.edges[t, side] = ([] if t not in self.parts else self.edge(self.parts[t][side], side)) + [t]
        return got

    def first_merge(self, left: int, right: int) -> tuple | None:
        """The first merge across the seam of two tokens while both are put together, if any.

        Merges go by rank, equal ones from left to right.  The two edges grow in that order; a
        merge across the seam happens if it comes before either edge's next one."""
        a, b = self.edge(left, 1), self.edge(right, 0)
        i = j = 0
        while True:
            next_a = self.rank[a[i + 1]] if i + 1 < len(a) else NEVER
            next_b = self.rank[b[j + 1]] if j + 1 < len(b) else NEVER
            r = self.merge.get(a[i] << 32 | b[j], NEVER)
            if r < next_a and r <= next_b:
                return a[i], b[j]
            if next_a == next_b == NEVER:
                return None
            if next_a <= next_b:
                i += 1
            else:
                j += 1

    def open_seam(self, left: int, right: int) -> bool:
        key = left << 32 | right
        got = self.seams.get(key)
        if got is None:
            if len(self.seams) >= KEEP_SEAMS:
                self.seams.clear()
            got = self.seams[key] = self.first_merge(left, right) is None
        return got

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word of a sorted list: a depth-first walk of the words' trie."""
        token, starts, size, seams = self.token.get, self.starts, self.size, self.seams
        last, reach = array("i", [-1]), array("i", [0])  # per depth: last token, longest start of a token that ends here
        out, before = [], b""
        for w in words:
            n, most = 0, min(len(w), len(before))
            while n < most and w[n] == before[n]:
                n += 1
            del last[n + 1:], reach[n + 1:]
            k = reach[n]
            for end in range(n + 1, len(w) + 1):
                k += 1
                part = w[end - k:end]
                while part not in starts:
                    k -= 1
                    part = w[end - k:end]
                reach.append(k)
                m = k
                while True:
                    t = token(part)
                    if t is not None:
                        p = last[end - m]
                        if p < 0:
                            break
                        seam = seams.get(p << 32 | t)
                        if seam if seam is not None else self.open_seam(p, t):
                            break
                    m -= 1
                    part = w[end - m:end]
                last.append(t)
            ids, at = [], len(w)
            while at:
                ids.append(last[at])
                at -= size[ids[-1]]
            out.append(ids[::-1])
            before = w
        return out


class Encoder:
    """Ids of the texts of Arrow arrays, with the words seen so far."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.vocabulary = Vocabulary(path)
        self.split = Tokenizer.from_file(path).pre_tokenizer
        self.kind = np.full(0x110000, UNKNOWN, np.uint8)
        added = sorted(self.vocabulary.added, key=len, reverse=True)
        self.added = re.compile(b"|".join(map(re.escape, added))) if added else None
        self.clear()

    def clear(self):
        words = list(self.vocabulary.added.items())
        a = np.frombuffer(b"".join(w for w, _ in words), np.uint8)
        end = np.cumsum([len(w) for w, _ in words]).astype(np.int64)
        h = word_hashes(a, end - [len(w) for w, _ in words], end) if words else []
        self.row = {int(x): i for i, x in enumerate(h)}  # word hash -> number of the word
        self.ids, self.ends = array("i", [i for _, i in words]), array("q", range(1, len(words) + 1))

    def ask(self, points: np.ndarray) -> None:
        """Classes of code points not met before, from the tokenizer's own splitting."""
        for c in points.tolist():
            x = chr(c)
            together = lambda y: len(self.split.pre_tokenize_str(y + x)) == 1
            self.kind[c] = (OTHER if 0xD800 <= c <= 0xDFFF else LETTER if together("a") else NUMBER if together("1")
                            else OTHER if together("!") else SPACE)

    def words(self, a: np.ndarray, first: np.ndarray, added: list[tuple[int, int]]) -> np.ndarray:
        """Byte places where words begin in a piece that begins and ends between words;
        ``first``: places where a text begins."""
        lead = np.flatnonzero((a & 0xC0) != 0x80)
        if len(lead) == 0 or lead[0] != 0:  # bytes that are no UTF-8
            lead = np.union1d(lead, [0])
        b = np.concatenate([a, np.zeros(3, np.uint8)]).astype(np.uint32)
        x = b[lead]
        y, z, w = (b[lead + i] & 0x3F for i in (1, 2, 3))
        p = np.select([x < 0x80, x < 0xE0, x < 0xF0], [x, (x & 0x1F) << 6 | y, (x & 0x0F) << 12 | y << 6 | z],
                      (x & 7) << 18 | y << 12 | z << 6 | w)
        p = np.minimum(p, 0x10FFFF)
        kind = self.kind[p]
        if (kind == UNKNOWN).any():
            self.ask(np.unique(p[kind == UNKNOWN]))
            kind = self.kind[p]
        begin = np.zeros(len(p) + 1, bool)
        begin[0] = begin[-1] = True
        begin[np.searchsorted(lead, first)] = True
        for s, e in added:
            s, e = np.searchsorted(lead, [s, e])
            kind[s:e] = ADDED
            begin[s] = begin[e] = True
        begin = begin[:-1]
        new = begin.copy()
        new[1:] |= kind[1:] != kind[:-1]
        cut = new.copy()
        # the last white space before anything else stands alone, and a blank joins what follows
        after = np.flatnonzero(new[1:] & ~begin[1:] & (kind[1:] != SPACE) & (kind[:-1] == SPACE)) + 1
        cut[after - 1] = True
        cut[after[p[after - 1] == 32]] = False
        # an apostrophe that begins a word takes its suffix along
        quote = np.flatnonzero((p[:-1] == 39) & cut[:-1] & new[:-1] & new[1:] & ~begin[1:] & (kind[:-1] == OTHER) & (kind[1:] == LETTER))
        if len(quote):
            one = np.isin(p[quote + 1], list(ONE_LETTER))
            far = np.minimum(quote + 2, len(p) - 1)
            pair = (p[quote + 1] << 8 | p[far]) * ((quote + 2 < len(p)) & ~begin[far] & (p[far] < 128) & (p[quote + 1] < 128))
            two = np.isin(pair, [t[0] << 8 | t[1] for t in TWO_LETTERS])
            cut[quote[one | two] + 1] = False
            end = np.concatenate([quote[one] + 2, quote[two & ~one] + 3])
            cut[end[end < len(p)]] = True
        return lead[cut]

    def pieces(self, a: np.ndarray, offsets: np.ndarray):
        """Ends of pieces of about PIECE bytes, between texts or before a blank that follows a
        letter or digit, where a word ends whatever comes next."""
        lo, n = 0, len(a)
        while lo < n:
            hi = lo + PIECE
            if hi >= n:
                yield n
                return
            at = int(offsets[np.searchsorted(offsets, hi, side="right") - 1])
            step, good = hi, []
            while at <= lo and step < n and not len(good):
                x = a[step - 1:step + PIECE]
                alnum = ((x >= 48) & (x <= 57)) | ((x | 32) >= 97) & ((x | 32) <= 122)
                good = np.flatnonzero((x[1:] == 32) & alnum[:-1]) + step
                later = offsets[np.searchsorted(offsets, step, side="left"):]
                good = np.append(good, later[:1]) if len(later) and later[0] <= step + PIECE else good
                step += PIECE
            at = at if at > lo else int(min(good)) if len(good) else n
            yield at
            lo = at

    def __call__(self, arr) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts and the n + 1 offsets."""
        a, off = text_buffer(arr)
        counts, out, lo = np.zeros(len(off), np.int64), [], 0
        specials = []
        if self.added is not None and len(a):
            specials = [m.span() for m in self.added.finditer(memoryview(a))]
            specials = [(s, e) for s, e in specials if np.searchsorted(off, s, side="right") == np.searchsorted(off, e - 1, side="right")]
        for hi in self.pieces(a, off):
            first = off[np.searchsorted(off, lo):np.searchsorted(off, hi)]
            begin = self.words(a[lo:hi], first - lo, [(s - lo, e - lo) for s, e in specials if lo <= s < hi]) + lo
            end = np.append(begin[1:], hi)
            h = word_hashes(a, begin, end)
            u, at, back = np.unique(h, return_index=True, return_inverse=True)
            if len(self.row) + len(u) > KEEP_WORDS:
                self.clear()
            new = [i for i, x in zip(at.tolist(), u.tolist()) if x not in self.row]
            if new:
                words = sorted((a[begin[i]:end[i]].tobytes(), i) for i in new)
                for (_, i), ids in zip(words, self.vocabulary.encode_words([w for w, _ in words])):
                    self.row[int(h[i])] = len(self.ends)
                    self.ids.extend(ids)
                    self.ends.append(len(self.ids))
            row = np.fromiter(map(self.row.__getitem__, u.tolist()), np.int64, len(u))
            ends = np.concatenate([[0], np.array(self.ends)])
            each, start = (ends[row + 1] - ends[row])[back], ends[row][back]
            total = int(each.sum())
            out.append(np.array(self.ids)[np.repeat(start - (np.cumsum(each) - each), each) + np.arange(total)])
            np.add.at(counts, np.searchsorted(off, begin, side="right"), each)
            lo = hi
        return np.concatenate(out) if out else np.empty(0, np.int32), np.cumsum(counts)


def spelled(ids: np.ndarray, table_: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the ids' entries of a table (bytes, offsets), one after the other, and their lengths."""
    data, off = table_
    n = off[ids + 1] - off[ids]
    total = int(n.sum())
    return data[np.repeat(off[ids] - (np.cumsum(n) - n), n) + np.arange(total)], n


def byte_table(entries: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(entries), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in entries])]).astype(np.int64)


def known(path: str, what: str):
    """The encoder, or the spelling table, of a tokenizer file: one for each worker process."""
    kept = process_cache()
    if (path, what) not in kept:
        if what == "encoder":
            kept[path, what] = Encoder(path)
        else:
            spelling = Vocabulary(path).spelling if (path, "encoder") not in kept else kept[path, "encoder"].vocabulary.spelling
            kept[path, what] = byte_table([spelling.get(i, b"") for i in range(max(spelling) + 1)])
    return kept[path, what]


def encode_texts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, ids)``: the ids of every text as the tokenizer file gives them, added tokens
    recognised, none added.

    A null or empty text has no ids; repeated rows and null ids keep their rows, ids may have
    any type; other columns are ignored.  A text is cut into pieces for the work, its ids are
    one array.
    """
    bounded_batches(docs.sparkSession)

    def run(batches):
        encoder = known(path, "encoder")
        for b in batches:
            ids, off = encoder(b.column("t"))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(ids, pa.int32()))],
                                             names=["id", "ids"])

    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    return (base.mapInArrow(run, f"id {base.schema['id'].dataType.simpleString()}, ids array<int>").withColumnRenamed("id", id_col))


def decode_ids(rows: DataFrame, path: str, ids_col: str = "ids", to: str = "decoded") -> DataFrame:
    """``rows`` with the text of their ids: the bytes of all tokens, added ones too, as UTF-8
    (what is none becomes U+FFFD).  Null arrays and ids that the file does not know give no
    bytes."""
    bounded_batches(rows.sparkSession)
    kept = [c for c in rows.columns if c != to]

    def run(batches):
        spelling = known(path, "spelling")
        for b in batches:
            lists = b.column(ids_col)
            ids = pa.ListArray.flatten(lists).fill_null(-1).to_numpy().astype(np.int64)
            size = lists.value_lengths().fill_null(0).to_numpy().astype(np.int64)
            ids = np.where((ids < 0) | (ids >= len(spelling[1]) - 1), len(spelling[1]) - 1, ids)
            none = (spelling[0], np.append(spelling[1], spelling[1][-1]))  # one more entry, empty
            out, at = [], 0
            for n in size.tolist():
                parts = [spelled(ids[i:min(i + PIECE, at + n)], none)[0].tobytes() for i in range(at, at + n, PIECE)]
                out.append(b"".join(parts).decode("utf-8", "replace"))
                at += n
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(out, pa.string())], names=[*kept, to])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*kept).schema)
    return rows.select(*kept).mapInArrow(run, f"{fields}, {to} string")


def id_list_digests(rows: DataFrame, ids_col: str = "ids", to: str = "ids_sha256") -> DataFrame:
    """``rows`` with the SHA-256 of their ids as decimals joined by commas, in place of the ids."""
    kept = [c for c in rows.columns if c not in (ids_col, to)]

    def run(batches):
        digits = byte_table([b"%d," % i for i in range(100_000)])
        for b in batches:
            lists = b.column(ids_col)
            ids, size, at, out = pa.ListArray.flatten(lists).to_numpy(), lists.value_lengths().to_numpy(), 0, []
            for n in size.tolist():
                h = hashlib.sha256()
                for i in range(at, at + n, PIECE):
                    part = ids[i:min(i + PIECE, at + n)]
                    text = spelled(part, digits)[0].tobytes() if part.max() < 100_000 else "".join(f"{x}," for x in part.tolist()).encode()
                    h.update(text if i + PIECE < at + n else text[:-1])
                out.append(h.hexdigest())
                at += n
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(out, pa.string())], names=[*kept, to])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*kept).schema)
    return rows.mapInArrow(run, f"{fields}, {to} string")


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, and the text that they decode to, as digests."""
    path = default_tokenizer()
    ids = encode_texts(table(spark, sf_dir, "documents"), path).withColumn("n_tokens", F.size("ids").cast("long"))
    both = id_list_digests(decode_ids(ids, path))
    return both.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


QUERY = LlmQuery("op12_trie_bpe", query, None)
