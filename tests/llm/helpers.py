"""Small fixtures for the corpus operators: nulls, empty and long texts, repeated rows,
an empty table and extra columns whose names the operators use inside."""

import random
import re

from pyspark.sql import Row

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
          "id string, k string, v string, t string, size string, bin string, `group` string, __k string")
EXTRA = ("x",) * 8


def sentence(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def edge_texts(seed=5):
    """(doc_id, text) pairs: random texts, near copies, chains, exact copies and odd cases."""
    rng = random.Random(seed)
    out, number = [], iter(range(10, 10_000))
    for _ in range(12):
        out.append((next(number), sentence(rng, rng.randrange(30, 90))))
    base = sentence(rng, 80).split()
    for _ in range(12):  # near copies of one text, some linked and some not
        w = list(base)
        for _ in range(rng.randrange(0, 6)):
            w[rng.randrange(len(w))] = f"new{rng.randrange(50)}"
        out.append((next(number), " ".join(w)))
    chain = sentence(rng, 60).split()
    for step in range(6):  # a chain: each links with the next only
        out.append((next(number), " ".join(chain[step * 4:] + [f"c{step}x{i}" for i in range(step * 2)])))
    out += [(next(number), out[0][1]), (next(number), out[0][1].upper()), (next(number), out[1][1].replace(" ", " \n\t"))]
    passage = sentence(rng, 30)
    out += [(next(number), sentence(rng, 10) + " " + passage + " " + sentence(rng, 7)) for _ in range(4)]
    out += [(next(number), passage + " " + passage), (next(number), "tick tock " * 40)]
    long = sentence(rng, 20_000, 10_000)
    out += [(next(number), long), (next(number), long + " end")]
    out += [(next(number), t) for t in (None, "", " \n\t ", "one", "two words", "One", "a b c d", "\x1c\x1f odd space é x")]
    out += [(3, out[2][1]), (3, out[2][1]), (3, sentence(rng, 40)), (None, out[3][1]), (None, None), (None, sentence(rng, 50))]
    rng.shuffle(out)
    return out


def docs_frame(spark, texts, source=lambda i: f"s{i % 3}"):
    rows = [(d, t, "en", source(i), len(t or ""), *EXTRA) for i, (d, t) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return WORD.findall(t or "")


def ascii_lower(t):
    return re.sub("[A-Z]", lambda m: m.group().lower(), t)


__all__ = ["Row", "words", "docs_frame", "empty_docs", "edge_texts", "sentence", "ascii_lower"]
