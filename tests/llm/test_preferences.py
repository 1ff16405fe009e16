from forumshift.llm import preferences as P

SCHEMA = "conv_id long, turn long, role string, text string, id string, turns string, key string, pair_id string"


def turns(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], SCHEMA)


def say(role, text):
    return f"<|im_start|>{role}\n{text}<|im_end|>\n"


ROWS = [
    (1, 0, "user", "q"), (1, 1, "assistant", "short"),
    (2, 1, "assistant", "a longer answer"), (2, 0, "user", "q"),
    (3, 0, "user", "q"), (3, 1, "assistant", "short"),
    (4, 0, "system", "s"), (4, 1, "user", "é"), (4, 2, "assistant", "one"), (4, 3, "user", "more"), (4, 4, "assistant", "two"), (4, 5, "user", "bye"),
    (5, 0, "user", None), (6, None, None, ""), (6, 0, "user", "q"),
    (7, 0, "user", "same"), (7, 1, "assistant", "x"), (7, 2, "assistant", "x"),
    (None, 0, "user", "q"),
]


def test_pairs_prompts_and_masks(spark):
    got = {tuple(r.pair_id): r for r in P.preference_pairs(P.derived_pairs(P.conversations(turns(spark, ROWS)))).collect()}
    assert set(got) == {("opening", 2, 1), ("opening", 2, 3), ("opening", 2, 6), ("stale", 4, 4)}  # 7's twin is equal
    r = got["opening", 2, 1]
    assert (r.n_common, r.prompt) == (1, say("user", "q"))
    assert r.chosen == say("assistant", "a longer answer") and r.rejected == say("assistant", "short")
    r = got["stale", 4, 4]
    assert r.n_common == 4 and r.prompt == say("system", "s") + say("user", "é") + say("assistant", "one") + say("user", "more")
    assert (r.chosen, r.rejected) == (say("assistant", "two"), say("assistant", "one"))
    for r in got.values():
        for text, mask in ((r.chosen, r.chosen_mask), (r.rejected, r.rejected_mask)):
            assert "".join(s.text for s in mask) == text
            assert "".join(s.text for s in mask if s.loss) == "".join(
                t.split("\n", 1)[1] for t in text.split("<|im_start|>")[1:] if t.startswith("assistant\n"))


def test_prefixes_empty_and_repeated(spark):
    t = "array<struct<role:string,text:string>>"
    a, b, c = ("user", "q"), ("assistant", "x"), ("assistant", "y")
    d = spark.createDataFrame([(1, [a, b], [a]), (2, [a], [b]), (3, [a, b], [a, b]), (4, None, [a]), (5, [], []), (6, [a, b, a, c], [a, c, a, c]),
                               (6, [a, b, a, c], [a, c, a, c])], f"pair_id long, chosen {t}, rejected {t}")
    rows = sorted((r.pair_id, r.n_common, r.chosen, r.rejected) for r in P.preference_pairs(d).collect())
    assert rows == [(1, 1, say(*b), ""), (2, 0, say(*a), say(*b)), (4, 0, "", say(*a)),
                    *[(6, 1, say(*b) + say(*a) + say(*c), say(*c) + say(*a) + say(*c))] * 2]


def test_large_group_gives_one_pair_for_each_other(spark):
    rows = [(i, j, r, "q" if j == 0 else f"a{i}" * (1 + i % 9)) for i in range(500) for j, r in enumerate(("user", "assistant"))]
    got = P.derived_pairs(P.conversations(turns(spark, rows))).select("pair_id.*").collect()
    assert len(got) == 499 and len({r.chosen_id for r in got}) == 1 and len({r.rejected_id for r in got}) == 499


def test_empty_table(spark):
    assert P.preference_pairs(P.derived_pairs(P.conversations(turns(spark, [])))).collect() == []


def test_text_ids(spark):
    rows = [(str(c) if c is not None else None, *r) for c, *r in ROWS]
    d = spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")
    got = {tuple(r.pair_id) for r in P.preference_pairs(P.derived_pairs(P.conversations(d))).collect()}
    assert got == {("opening", "2", "1"), ("opening", "2", "3"), ("opening", "2", "6"), ("stale", "4", "4")}
