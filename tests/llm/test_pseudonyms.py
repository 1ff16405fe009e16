import re
from collections import Counter

from helpers import docs_frame, edge_texts, empty_docs

from forumshift.llm import pseudonyms as P

KEY = b"test"
VALUES = {
    "email": ["jo.doe@mail1.example.com", "A-b_c+9@x-y.co.uk", "josé.maría@example.com", "иван@example.org", "a@b.de", "7@b.de"],
    "ip": ["10.0.0.1", "255.254.1.77"],
    "date": ["1999-12-31", "5/3/2020", "05/03/2020", "12/25/2001", "31.12.1987", "12 March 2021", "Mar 3, 2021", "May 7, 1999", "2 May 2001",
             "12. März 1987", "3 mars 2001", "1 de enero de 1999", "MAY 7, 1999", "3 AOÛT 1950", "7. Mai 2010"],
    "iban": ["GB82 WEST 1234 5698 7654 32", "DE89370400440532013000"],
    "ssn": ["123-45-6789"],
    "phone": ["+1 (743) 555-3824", "(743) 555-3824", "+44 20 7946 0958", "743-555-3824"],
    "card": ["4111111111111111", "4111 1111 1111 1111", "5500-0000-0000-0004"],
    "account": ["9807915762804491"],
}


def test_values_keep_their_format_and_can_be_inverted():
    c = P.Cipher(KEY)
    for kind, values in VALUES.items():
        for v in values:
            text = f"x, {v} y"
            out, spans = P.rewrite(c, text)
            assert [(k, text[i:j]) for k, i, j in spans] == [(kind, v)], (kind, v, spans)
            new = out[3:-2]
            assert new != v
            if kind not in ("date", "ip") and v.isascii():
                assert re.sub(r"[a-z]", "a", re.sub(r"[A-Z]", "A", re.sub(r"\d", "9", new[:len(v)]))) == re.sub(
                    r"[a-z]", "a", re.sub(r"[A-Z]", "A", re.sub(r"\d", "9", v)))
            assert P.rewrite(c, out, inverse=True)[0] == text
            assert P.rewrite(P.Cipher(b"other"), text)[0] != out
    assert P.luhn(P.pseudonym(c, "card", "4111111111111111")[1]) == 0
    assert P.mod97(P.pseudonym(c, "iban", "DE89370400440532013000")[1]) == 1


def test_permutation_is_one_to_one():
    c = P.Cipher(KEY)
    every = [tuple(c.permute("k", [a, b, d], [10, 26, 10])) for a in range(10) for b in range(26) for d in range(10)]
    assert len(set(every)) == 2600
    days = [c.below("d", x, 1000, lambda v: v % 3 != 0) for x in range(1000) if x % 3]
    assert sorted(days) == [x for x in range(1000) if x % 3]


def test_invalid_values_stay():
    c = P.Cipher(KEY)
    for t in ("999.1.1.1", "2021-13-45", "1.2.3.4.5", "GB00 WEST AAAA BBBB CCCC 32", "deadbeef4111111111111111aa",
              "version 3.14.15", "12345", "item-123-45-6789-x", "w17 w4 w399 c3x1", "000-00-0000", "666-12-3456", "912-34-5678", "123-00-4567",
              "123-45-0000", "31. Februar 1999", "30 de febrero de 2001"):
        assert P.rewrite(c, t) == (t, [])


def test_equal_values_link_across_documents(spark):
    texts = edge_texts(seed=7) + [(900, "card 4111111111111111."), (901, "again 4111 1111 1111 1111, +1 (826) 555-4081 190.137.223.204"),
                                  (902, "é 190.137.223.204!"), (902, "é 190.137.223.204!")]
    docs = docs_frame(spark, texts)
    done = P.pseudonymise(docs, KEY)
    rows = done.collect()
    assert len(rows) == len(texts)
    digits = [re.sub(r"\D", "", r.text)[:16] for r in rows if r.doc_id in (900, 901)]
    assert digits[0] == digits[1] != "4111111111111111"
    ips = {re.search(r"\d+\.\d+\.\d+\.\d+", r.text).group() for r in rows if r.doc_id in (901, 902)}
    assert len(ips) == 1 and "190.137.223.204" not in ips
    assert [r.spans[0].start for r in rows if r.doc_id == 902] == [2, 2]
    back = P.pseudonymise(done, KEY, inverse=True)
    assert Counter((r.doc_id, r.text) for r in back.collect()) == Counter(texts)


def test_empty_table(spark):
    assert P.pseudonymise(empty_docs(spark), KEY).collect() == []


def test_parts_that_follow_a_value_stay_outside():
    """Timestamps, a card with its security code, values side by side."""
    c = P.Cipher(KEY)
    spans = lambda t: [(k, t[i:j]) for k, i, j in P.rewrite(c, t)[1]]
    assert spans("at 1987-04-12T00:00:00Z.") == [("date", "1987-04-12")]
    for card in ("4111 1111 1111 1111", "5500-0000-0000-0004", "4111111111111111"):
        alone = P.rewrite(c, card)[0]
        for t in (f"{card} 123", f"{card} 12", f"{card}-123", f"x {card} 7 y"):
            out, found = P.rewrite(c, t)
            assert [(k, t[i:j]) for k, i, j in found] == [("card", card)], t
            assert out == t.replace(card, alone) and P.rewrite(c, out, inverse=True)[0] == t
    for n in range(300):  # numbers whose parts may be valid by chance
        t = f"{9807915762804400 + n} {n % 100:02d}"
        assert P.rewrite(c, P.rewrite(c, t)[0], inverse=True)[0] == t


def test_single_characters_are_no_shift():
    c = P.Cipher(KEY)
    names = [P.rewrite(c, f"{x}@b.de")[0][0] for x in "abcdefghijklmnopqrstuvwxyz"]
    assert sorted(names) == list("abcdefghijklmnopqrstuvwxyz")
    assert len({(ord(y) - ord(x)) % 26 for x, y in zip("abcdefghijklmnopqrstuvwxyz", names)}) > 5


def planted(rng):
    """A value of a kind by its own rules, or a near miss (kind None)."""
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    kind = rng.choice([*P.KINDS, None])
    if kind == "email":
        return kind, rng.choice(["ann", "b.c-d", "x_y9", "zoé", "q"]) + f"@{rng.choice(['mail', 'a-b.example'])}.{rng.choice(['com', 'org'])}"
    if kind == "ip":
        return kind, ".".join(str(rng.randrange(256)) for _ in range(4))
    if kind == "date":
        y, m, n = rng.randrange(1900, 2100), rng.randrange(1, 13), rng.randrange(1, 29)
        lang = rng.choice(list(P.MONTHS))
        return kind, rng.choice([f"{y}-{m:02d}-{n:02d}", f"{n}/{m}/{y}", f"{n:02d}.{m:02d}.{y}", f"{n} {P.MONTHS[lang][m - 1]} {y}"])
    if kind == "iban":
        body = "DE" + "00" + d(18)
        check = 98 - int("".join(str(int(x, 36)) for x in body[4:] + body[:4])) % 97
        return kind, body[:2] + f"{check:02d}" + body[4:]
    if kind == "ssn":
        return kind, f"{rng.randrange(1, 666):03d}-{rng.randrange(1, 100):02d}-{rng.randrange(1, 10000):04d}"
    if kind == "phone":
        return kind, rng.choice([f"+1 ({d(3)}) {d(3)}-{d(4)}", f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}"])
    if kind in ("card", "account"):
        while True:
            x = "4" + d(15)
            total = sum(sum(divmod(2 * int(c), 10)) if i % 2 == 0 else int(c) for i, c in enumerate(x))
            if (total % 10 == 0) == (kind == "card"):
                return kind, rng.choice([x, " ".join(x[i:i + 4] for i in range(0, 16, 4))]) if kind == "card" else x
    return None, rng.choice([f"{rng.randrange(256, 999)}.1.1.1", f"{d(4)}-1{rng.randrange(3, 9)}-12", "000-12-3456", "user at mail.com", f"v{d(16)}", d(5), "2 x 4"])


def test_planted_values_are_found_and_nothing_else():
    import random

    rng, c = random.Random(11), P.Cipher(KEY)
    for _ in range(400):
        text, want = "", []
        for _ in range(rng.randrange(1, 8)):
            text += rng.choice(["and ", "é; ", "see: ", "\n", "(", "then "])
            kind, value = planted(rng)
            if kind:
                want.append((kind, len(text), len(text) + len(value)))
            text += value + rng.choice([", so ", "; x ", ")\n", "! "])
        out, spans = P.rewrite(c, text)
        assert spans == want, (text, spans, want)
        assert P.rewrite(c, out, inverse=True)[0] == text
