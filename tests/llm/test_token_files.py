import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import docs_frame, edge_texts, empty_docs
from hypothesis import given, settings
from hypothesis import strategies as st

from forumshift.llm import token_files as T


@given(st.integers(1, 32), st.lists(st.integers(0, 2**32 - 1), max_size=300), st.data())
@settings(max_examples=60, deadline=None)
def test_pack_round_trip_and_random_access(width, ids, data):
    x = np.array(ids, np.uint32) & np.uint32((1 << width) - 1)
    packed = T.pack(x, width)
    assert len(packed) == -(-len(x) * width // 8)
    i = data.draw(st.integers(0, len(x)))
    j = data.draw(st.integers(i, len(x)))
    assert T.unpack(packed, width, i, j).tolist() == x[i:j].tolist()


def test_pack_in_pieces(monkeypatch):
    x = np.arange(1000, dtype=np.uint32) * 31 % 49408
    plain = T.pack(x, 16)
    monkeypatch.setattr(T, "AT_ONCE", 64)
    monkeypatch.setattr(T, "WHOLE", {})
    assert T.pack(x, 16) == plain  # the short cut for whole bytes packs the same bits
    assert T.unpack(T.pack(x, 16), 16, 3, 999).tolist() == x[3:999].tolist()
    assert T.unpack(T.pack(x, 17), 17, 63, 131).tolist() == x[63:131].tolist()


ODD = ["It's <|endoftext|>don't", "é café ́x", "a b c\x85d\x1ce", "ΣΑΣ İstanbul ß",
       "12345 $%&*", "<|startoftext|>", "日本語 テキスト", "'s 't 'LL", "﻿x y​z"]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(T.default_tokenizer())


def test_word_encoder_equals_whole_texts(tokenizer):
    import pyarrow as pa
    texts = [t for _, t in edge_texts(seed=9)] + ODD
    ids, off = T.WordEncoder(T.default_tokenizer())(pa.array(texts, pa.string()))
    for t, i, j in zip(texts, off, off[1:]):
        assert ids[i:j].tolist() == tokenizer.encode(t or "", add_special_tokens=False).ids + [T.END_ID]


@pytest.mark.parametrize("block", [64, T.BLOCK_IDS])
def test_files_round_trip(spark, tokenizer, monkeypatch, block):
    monkeypatch.setattr(T, "BLOCK_IDS", block)
    texts = edge_texts(seed=10) + [(70_000 + i, t) for i, t in enumerate(ODD)]
    docs = docs_frame(spark, texts)
    path = T.write_token_files(docs, T.default_tokenizer())
    rows = T.read_documents(spark, path).orderBy("start").collect()
    ids = {t: tokenizer.encode(t or "", add_special_tokens=False).ids + [T.END_ID] for _, t in texts}
    crc = {t: zlib.crc32(np.array(v, "<u4").tobytes()) for t, v in ids.items()}
    assert Counter((r.id, r.n_tokens, r.ids_crc32) for r in rows) == Counter((d, len(ids[t]), crc[t]) for d, t in texts)
    assert [r.start for r in rows] == np.cumsum([0] + [r.n_tokens for r in rows])[:-1].tolist()
    order = [(r.id is None, r.id or 0) for r in rows]
    assert order == sorted(order)
    whole = T.read_slice(spark, path, 0, sum(r.n_tokens for r in rows))
    a = rows[5].start + 1
    assert T.read_slice(spark, path, a, a + 500).tolist() == whole[a:a + 500].tolist()
    assert zlib.crc32(whole[rows[7].start:rows[8].start].astype("<u4").tobytes()) == rows[7].ids_crc32


def test_empty_table(spark):
    path = T.write_token_files(empty_docs(spark), T.default_tokenizer())
    assert T.read_documents(spark, path).collect() == []
