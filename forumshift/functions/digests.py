"""MD5 of many short messages at once (RFC 1321), for uniforms that every engine draws alike."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

import numpy as np

SHIFTS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
SINES = [int(abs(math.sin(i + 1)) * 2 ** 32) for i in range(64)]
START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: bytes of a message that fit one block beside its end mark and length
ONE_BLOCK = 55


def _first_words(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first two words of the digests of one-block messages (16 rows of words)."""
    a, b, c, d = (np.full(words.shape[1], x, np.uint32) for x in START)
    for i in range(64):
        if i < 16:
            f, g = d ^ (b & (c ^ d)), i
        elif i < 32:
            f, g = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif i < 48:
            f, g = b ^ c ^ d, (3 * i + 5) % 16
        else:
            f, g = c ^ (b | ~d), 7 * i % 16
        f += a
        f += words[g]
        f += np.uint32(SINES[i])
        s = SHIFTS[i // 16][i % 4]
        a, d, c = d, c, b
        b = b + ((f << np.uint32(s)) | (f >> np.uint32(32 - s)))
    return a + np.uint32(START[0]), b + np.uint32(START[1])


def md5_heads(heads: Sequence[bytes], tails: Sequence[bytes]) -> np.ndarray:
    """The first 8 digest bytes, as an integer, of every tail (row) after every head (column)."""
    out = np.empty((len(tails), len(heads)), np.uint64)
    for size in {len(h) for h in heads}:
        at = [i for i, h in enumerate(heads) if len(h) == size]
        short = [i for i, t in enumerate(tails) if size + len(t) <= ONE_BLOCK]
        for i in set(range(len(tails))) - set(short):
            out[i, at] = [int.from_bytes(hashlib.md5(heads[j] + tails[i]).digest()[:8]) for j in at]
        if not short:
            continue
        block = np.zeros((len(short), len(at), 64), np.uint8)
        block[:, :, :size] = np.array([list(heads[j]) for j in at], np.uint8).reshape(len(at), size)
        ends = b"".join((tails[i] + b"\x80").ljust(56 - size, b"\0") + (8 * (size + len(tails[i]))).to_bytes(8, "little") for i in short)
        block[:, :, size:] = np.frombuffer(ends, np.uint8).reshape(len(short), 1, 64 - size)
        words = np.ascontiguousarray(block.view("<u4").reshape(-1, 16).T)
        step = 1 << 13  # what a core's cache holds
        for lo in range(0, words.shape[1], step):
            a, b = _first_words(words[:, lo:lo + step])
            words[0, lo:lo + step], words[1, lo:lo + step] = a.byteswap(), b.byteswap()
        value = (words[0].astype(np.uint64) << np.uint64(32)) | words[1].astype(np.uint64)
        out[np.ix_(short, at)] = value.reshape(len(short), len(at))
    return out
