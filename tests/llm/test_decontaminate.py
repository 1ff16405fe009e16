import random
import re
from collections import defaultdict

from helpers import docs_frame, edge_texts, empty_docs, words

from forumshift.llm import decontaminate as D

ITEM = ("Tom has 12 apples and gives 5 of them to Anna while Peter buys 7 kg of pears , how many apples "
        "does he then still have left when Anna returns 2 of them on Monday evening")
OTHER = ("Lucy has 31 apples and gives 9 of them to Karen while Robert buys 4 km of pears , how many apples "
         "does he then still have left when Karen returns 6 of them on Friday evening")
# the slots disagree everywhere: Anna is Karen here and Julia there, and so on for each number
CLASH = ("Lucy has 31 apples and gives 31 of them to Karen while Karen buys 31 kg of pears , how many apples "
         "does he then still have left when Julia returns 31 of them on Karen evening")


def bench(spark, items):
    return spark.createDataFrame(items, "item_id long, text string, h string, k string")


def canon(t):
    """Canonical words (literal, type) word by word; ASCII texts."""
    out, before, stop = [], 0, True
    t = t or ""
    for m in re.finditer(r"[^\x20\x09-\x0D]+", t):
        w = re.sub(r"^[^0-9A-Za-z]+|[^0-9A-Za-z]+$", "", m.group())
        at = m.start() + m.group().find(w)
        opens = stop or "\n" in t[before:at]
        before, stop = at + len(w), m.group()[-1] in ".!?:"
        if not w:
            before = m.end()
            continue
        low, prev = w.lower(), out[-1][2] if out else ""
        if (re.search(r"\d", w) and not re.search(r"[A-Za-z]", w)) or low in D.NUMBER_WORDS:
            kind = D.NUMBER
        elif low in D.UNIT_WORDS and re.search(r"\d", prev):
            kind = D.UNIT
        elif re.match(r"[A-Z][^A-Z]*$", w) and not opens:
            kind = D.NAME
        else:
            kind = 0
        if kind and out and out[-1][1] == kind:
            out[-1] = (out[-1][0] + (low,), kind, w)
        else:
            out.append(((low,), kind, w))
    return [(x, k) for x, k, _ in out]


def literal(t):
    return [re.sub(r"^[^0-9a-z]+|[^0-9a-z]+$", "", w) or w for w in words((t or "").lower())]


def brute(texts, items):
    """Every pair by its definition: windows one by one, slots of an alignment, runs, short items."""
    out = set()
    parsed = [(d, canon(t), literal(t)) for d, t in texts]
    for item, x in items:
        c, raw = canon(x), literal(x)
        if len(c) < D.LEAST_WORDS:
            for d, _, w in parsed:
                if raw and (w == raw if len(raw) < D.SHORT_WORDS else any(w[i:i + len(raw)] == raw for i in range(len(w)))):
                    out.add((d, item))
            continue
        k = min(D.WINDOW, len(c))
        for d, t, _ in parsed:
            by = defaultdict(list)
            for i in range(len(c) - k + 1):
                for j in range(len(t) - k + 1):
                    a, b = c[i:i + k], t[j:j + k]
                    if [y[0] for y in a] == [y[0] for y in b]:
                        by[j - i].append((i, []))
                    slots = [(y, z) for y, z in zip(a, b) if y[1]]
                    if slots and 100 * (k - len(slots)) >= D.LITERAL_PCT * k and all(y[1] == z[1] and (y[1] or y[0] == z[0]) for y, z in zip(a, b)):
                        by[j - i].append((i, [(y[0], z[0]) for y, z in slots]))
            cover, run = set(), 0
            for found in by.values():
                there, back, seen, bad, ok = {}, {}, set(), set(), set()
                for i, slots in sorted(found, key=lambda f: (f[0], len(f[1]))):
                    pairs = [(i, n, p) for n, p in enumerate(slots)]
                    clash = [p for p in pairs if there.setdefault(p[2][0], p[2][1]) != p[2][1] or back.setdefault(p[2][1], p[2][0]) != p[2][0]]
                    seen.update(pairs)
                    bad.update(clash)
                    if not clash:
                        ok.add((i, bool(pairs)))
                agree = 100 * len(bad) <= D.MOST_CLASHES_PCT * len(seen)
                cover.update(p for i, typed in ok if agree or not typed for p in range(i, i + k))
                plain = {i for i, typed in ok if not typed}
                for i in plain:
                    n = 0
                    while i + n in plain:
                        n += 1
                    run = max(run, n + k - 1)
            if len(cover) * 100 >= D.COVERED_PCT * len(c) or run >= D.VERBATIM_RUN:
                out.add((d, item))
    return out


def changed(rng, t):
    """The text with other numbers and names, or some words changed."""
    swap = {}
    out = []
    for w in t.split():
        if re.fullmatch(r"\d+", w):
            w = swap.setdefault(w, str(rng.randrange(100)))
        elif re.fullmatch(r"[A-Z][a-z]+", w):
            w = swap.setdefault(w, rng.choice(["Julia", "Karen", "Robert", "Sam"]))
        out.append(w if rng.random() < 0.97 else "other")
    return " ".join(out)


def test_leaks_equal_brute_force(spark):
    rng = random.Random(4)
    texts = [(d, t) for d, t in edge_texts(seed=13) if not t or len(t) < 20_000 and t.isascii()]
    plain = [(i, " ".join(rng.choice(["ab", "cd", "ef", "gh", "ij", "kl", "mn"]) + rng.choice("xyzuvw") * 3 for _ in range(rng.randrange(3, 40))))
             for i in range(30)] + [(77, None), (78, ""), (79, "one two three"), (80, "just six words in this one"), (81, "What is 12 + 15?"),
                                    (82, "5 km"), (83, "1 2 3 4 5 6 7 8 9 10 11 12"), (84, "so ?"), (85, ITEM)]
    plain.append((86, " ".join(f"long{i}" for i in range(300))))
    for i, t in plain[:12]:
        w = t.split()
        texts.append((3000 + i, "start here " + " ".join(w[:max(1, len(w) * (i % 4) // 3)]) + " and then on"))
    texts += [(4000, plain[5][1]), (4001, "JUST six, words in (this) one!"), (None, "x " + plain[6][1] + " y"), (4002, plain[7][1] + " " + plain[7][1]),
              (4003, "well what is 12 + 15, then"), (4004, "what is 15 + 12"), (4005, "What is 12 - 15?"), (4006, "5 KM!"), (4007, "about 5 km"),
              (4008, "0 1 2 3 4 5 6 7 8 9 10 11 12 13"), (4009, "1 2 3 4 5 6 7 8 9 10 11"), (4010, "So?"), (4011, "so ?"), (4012, "one two three"),
              (4013, "x " + " ".join(f"long{i}" for i in range(40, 70)) + " y"), (4014, "x " + " ".join(f"long{i}" for i in range(40, 69)) + " y")]
    texts += [(5000 + i, "So . " + changed(rng, rng.choice([ITEM, OTHER])) + " .") for i in range(40)] + [(5100, CLASH), (5101, OTHER)]
    got = {(r.doc_id, r.item_id) for r in D.find_leaks(docs_frame(spark, texts), bench(spark, [(i, t, "x", "y") for i, t in plain])).collect()}
    want = brute(texts, plain)
    assert got == want and len(want) >= 30
    assert {(4003, 81), (4006, 82), (4008, 83), (4013, 86)} <= want and not {4004, 4005, 4007, 4009, 4014} & {d for d, _ in want}


def test_reparameterised_question_is_caught_and_clashing_slots_are_not(spark):
    docs = docs_frame(spark, [(1, "So . " + ITEM + " ."), (2, "And here: " + OTHER + " ."), (3, "And here: " + CLASH + " ."),
                              (4, "apples and pears are fruit that Anna and Tom like on Monday evening , 5 kg of them")])
    rows = {r.doc_id: r for r in D.find_leaks(docs, bench(spark, [(9, ITEM, "x", "y")])).collect()}
    assert set(rows) == {1, 2}
    assert rows[1].verbatim and not rows[2].verbatim


def test_clean_rows_stay_with_all_columns(spark):
    docs = docs_frame(spark, [(1, ITEM), (1, "clean text of the same id"), (2, None), (None, ITEM), (None, "clean"), (3, "clean"), (3, "clean")])
    kept = D.drop_leaks(docs, bench(spark, [(9, ITEM, "x", "y")]))
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == sorted(
        [(1, "clean text of the same id"), (2, ""), (0, "clean"), (3, "clean"), (3, "clean")])


def test_empty_tables(spark):
    none = bench(spark, [])
    assert D.find_leaks(empty_docs(spark), none).collect() == []
    assert D.find_leaks(docs_frame(spark, [(1, ITEM)]), none).collect() == []
    assert D.drop_leaks(empty_docs(spark), bench(spark, [(9, ITEM, "x", "y")])).collect() == []
