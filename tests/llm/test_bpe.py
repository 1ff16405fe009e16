import hashlib
import random

import pyarrow as pa
import pytest
from helpers import docs_frame, edge_texts, empty_docs
from tokenizers import Tokenizer

from forumshift.llm import bpe as B

PATH = B.default_tokenizer()
POOL = ["a", "b", "'s", "'", "'ll", "'re", "'v", " ", "  ", "\n", "\t", "é", "ß", "中", "文", "1", "22", "²", "<|endoftext|>", "<|endof", "!", "...",
        " ", "​", "𝄞", "word", " the", "ing", "'S", "'t", "\r\n", "　", "\U0001e5d0", "Ᲊ", "==", "#", "l", "r", "e", "\x1c", "\x85", "́", "\0"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def encoder():
    return B.Encoder(PATH)


def random_texts(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(POOL) for _ in range(rng.randrange(0, 30))) for _ in range(n)]


ODD = [None, "", "a" * 5000, " " * 3000, "ab" * 3000, "=" * 777 + " x", "'" * 50 + "s", "x" * 40 + " \n ", "<|endoftext|>" * 3, "<|endoftext|"]


def same(encoder, library, texts):
    ids, off = encoder(pa.array(texts))
    for i, t in enumerate(texts):
        assert ids[off[i]:off[i + 1]].tolist() == library.encode(t or "", add_special_tokens=False).ids, repr(t)[:200]


def test_ids_equal_the_library(encoder, library):
    same(encoder, library, random_texts(4000) + ODD)


def test_pieces_of_long_texts_change_nothing(encoder, library, monkeypatch):
    monkeypatch.setattr(B, "PIECE", 100)
    same(encoder, library, [" ".join(random_texts(200, 2)), *random_texts(300, 3), *ODD])


def test_forgetting_words_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(B, "KEEP_WORDS", 50)
    monkeypatch.setattr(B, "KEEP_SEAMS", 20)
    encoder = B.Encoder(PATH)
    for seed in range(4):
        same(encoder, library, random_texts(100, seed))


def merged(v, word):
    """Merges applied one by one: the lowest rank first, the leftmost of equals."""
    ids = [v.token[bytes([c])] for c in word]
    while len(ids) > 1:
        r, i = min((v.merge.get(a << 32 | b, B.NEVER), i) for i, (a, b) in enumerate(zip(ids, ids[1:])))
        if r == B.NEVER:
            break
        ids[i:i + 2] = [next(t for t, p in v.parts.items() if p == (ids[i], ids[i + 1]))] if (ids[i], ids[i + 1]) not in WHOLE else [WHOLE[ids[i], ids[i + 1]]]
    return ids


WHOLE = {}


def test_trie_states_equal_merging_word_by_word(encoder):
    v = encoder.vocabulary
    WHOLE.update({p: t for t, p in v.parts.items()})
    rng = random.Random(7)
    words = sorted({bytes(rng.choice(b"aehinrst \xc3\xa9") for _ in range(rng.randrange(1, 14))) for _ in range(3000)} | {b"a" * n for n in range(1, 30)})
    assert v.encode_words(words) == [merged(v, w) for w in words]


def test_rows_round_trip_and_digests(spark, library):
    texts = edge_texts() + [(900 + i, t) for i, t in enumerate(ODD + random_texts(200, 5))]
    rows = B.encode_texts(docs_frame(spark, texts), PATH)
    both = B.id_list_digests(B.decode_ids(rows, PATH))
    got = sorted((r.doc_id is None, r.doc_id or 0, r.ids_sha256, r.decoded) for r in both.collect())
    want = []
    for d, t in texts:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((d is None, d or 0, hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), library.decode(ids, skip_special_tokens=False)))
    assert got == sorted(want)


def test_decoding_odd_ids(spark, library):
    lists = [[], [262, 999999, 1212], [220, 50256, 0], [162], [101, 162, 250], None]
    d = spark.createDataFrame([(str(i), x) for i, x in enumerate(lists)], "id string, ids array<int>")
    got = {r.id: r.decoded for r in B.decode_ids(d, PATH).collect()}
    assert got == {str(i): library.decode(x or [], skip_special_tokens=False) for i, x in enumerate(lists)}


def test_empty_table_and_text_ids(spark):
    assert B.encode_texts(empty_docs(spark), PATH).collect() == []
    d = spark.createDataFrame([("k1", "the")], "doc_id string, text string")
    assert [tuple(r) for r in B.encode_texts(d, PATH).collect()] == [("k1", [1169])]


def test_other_files_are_refused(tmp_path):
    import public_tokenizers
    with pytest.raises(ValueError):
        B.Vocabulary(public_tokenizers.path("word_bpe_49k.json"))
