"""Operator 5: format-preserving pseudonyms for personal data.

Mail addresses, IPv4 addresses, phone, card, account, IBAN and social security numbers and
dates are found in whole texts, validated (octets, check digits, calendar), and replaced by
a keyed permutation of their own format: a Feistel network over the mixed radix of the
characters that may change.  Separators, lengths, letter case, month names' language, a card's first
digit, a phone's country code and a mail's domain stay; check digits are computed anew, so a valid
number stays valid.  The same value gets the same pseudonym in every document, different
values different ones, and the holder of the key can invert it.  No state, no shuffle: each
text is rewritten where it is read.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import LlmQuery
from .common import bounded_batches, table

ROUNDS = 8
#: only for the registered query; a real run passes its own secret
QUERY_KEY = b"query key, not a secret"
KINDS = ("email", "ip", "date", "iban", "ssn", "phone", "card", "account")
FIRST_DAY, DAYS = dt.date(1900, 1, 1).toordinal(), (dt.date(2100, 1, 1) - dt.date(1900, 1, 1)).days
# fixed values: month names, and letters of other scripts in order of their code points
ENGLISH = "January February March April May June July August September October November December".split()
MONTHS = {
    "en": ENGLISH,
    "en3": [m[:3] for m in ENGLISH],
    "de": "Januar Februar März April Mai Juni Juli August September Oktober November Dezember".split(),
    "fr": "janvier février mars avril mai juin juillet août septembre octobre novembre décembre".split(),
    "es": "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre".split(),
}
LETTERS = ((0xC0, 0xD6), (0xD8, 0xDE), (0xDF, 0xF6), (0xF8, 0xFF), (0x100, 0x17F), (0x3B1, 0x3C9), (0x410, 0x42F), (0x430, 0x44F), (0x5D0, 0x5EA),
           (0x621, 0x63A), (0x904, 0x939), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3))
_MONTH = "(?i:" + "|".join(sorted({m for names in MONTHS.values() for m in names}, key=lambda m: (-len(m), m))) + ")"
_DAY_FIRST = rf"(\d{{1,2}})(\.?\ |\ de\ )({_MONTH})(\ |\ de\ )(\d{{4}})"
_MONTH_FIRST = rf"({_MONTH})(\ )(\d{{1,2}})(,\ )(\d{{4}})"
_NAMED = re.compile(f"{_DAY_FIRST}|{_MONTH_FIRST}")

FOUND = re.compile(rf"""
  (?P<email>(?<![\w.+%-])\w[\w.%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{{2,}})
 |(?P<ip>(?<![\w.])\d{{1,3}}(?:\.\d{{1,3}}){{3}}(?!\w|\.\d))
 |(?P<date>(?<![\w.])(?:\d{{4}}(?P<s1>[-/.])\d{{1,2}}(?P=s1)\d{{1,2}}|\d{{1,2}}(?P<s2>[-/.])\d{{1,2}}(?P=s2)\d{{4}}
    |\d{{1,2}}(?:\.?\ |\ de\ ){_MONTH}(?:\ |\ de\ )\d{{4}}|{_MONTH}\ \d{{1,2}},\ \d{{4}})(?:(?=T\d\d)|(?!\w|\.\d)))
 |(?P<iban>(?<!\w)[A-Z]{{2}}\d{{2}}(?:\ ?[A-Z0-9]{{4}}){{2,7}}(?:\ ?[A-Z0-9]{{1,3}})?(?!\w))
 |(?P<ssn>(?<![\w-])\d{{3}}-\d{{2}}-\d{{4}}(?![\w-]))
 |(?P<phone>(?<![\w+])\+1[ .-]?(?:\(\d{{3}}\)|\d{{3}})[ .-]?\d{{3}}[ .-]?\d{{4}}(?!\d)
    |(?<![\w+])\+\d{{1,3}}(?:[ .-]?\(\d{{1,4}}\))?(?:[ .-]?\d{{2,4}}){{2,4}}(?!\w|[.-]\d)
    |(?<!\w)\(\d{{3}}\)[ .-]?\d{{3}}[ .-]\d{{4}}(?!\w)|(?<![\w.-])\d{{3}}[.-]\d{{3}}[.-]\d{{4}}(?![\w-]))
 |(?P<card>(?<![\w.-])\d(?:[ -]?\d){{12,18}}(?![\w-]))
""".replace(r"\d", "[0-9]"), re.X)
#: texts without any of these hold nothing to find
HINT = r"@|[0-9]{2}|[0-9][ /.-][A-Z0-9]"


class Cipher:
    """Keyed permutation of a tuple of digits with given radices; invertible."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _f(self, kind: str, i: int, value: int, shape: bytes) -> int:
        data = b"|".join((kind.encode(), bytes([i]), shape, str(value).encode()))
        return int.from_bytes(hashlib.blake2b(data, key=self.key, digest_size=32).digest(), "big")

    def permute(self, kind: str, digits: list[int], radices: list[int], inverse: bool = False) -> list[int]:
        if len(digits) == 1:  # too short for halves
            return [self.below(kind, digits[0], radices[0], lambda x: True, inverse)]
        half = len(digits) // 2
        left, right, a, b = 0, 0, 1, 1
        for d, r in zip(digits[:half], radices[:half]):
            left, a = left * r + d, a * r
        for d, r in zip(digits[half:], radices[half:]):
            right, b = right * r + d, b * r
        shape = ",".join(map(str, radices)).encode()
        sign = -1 if inverse else 1
        for i in reversed(range(ROUNDS)) if inverse else range(ROUNDS):
            if i % 2:
                left = (left + sign * self._f(kind, i, right, shape)) % a
            else:
                right = (right + sign * self._f(kind, i, left, shape)) % b
        out = []
        for value, rs in ((right, radices[half:]), (left, radices[:half])):
            for r in reversed(rs):
                value, d = divmod(value, r)
                out.append(d)
        return out[::-1]

    def below(self, kind: str, value: int, limit: int, fits, inverse: bool = False) -> int:
        """Permutation of the numbers under a limit that fit, by cycle walking."""
        root = 1
        while root * root < limit:
            root += 1
        while True:
            x, y = self.permute(kind, list(divmod(value, root)), [root, root], inverse)
            value = x * root + y
            if value < limit and fits(value):
                return value

    def characters(self, kind: str, text: str, change, inverse: bool = False) -> str:
        """Permutes the letters and digits at the places ``change`` within their alphabets; case
        stays.  Letters of scripts that LETTERS does not list stay."""
        at, digits, alphabets = [], [], []
        for i in change:
            c = text[i]
            low = (48 if c.isdigit() else 97 if c.islower() else 65, 10 if c.isdigit() else 26) if c.isascii() and c.isalnum() else next(
                ((x, y - x + 1) for x, y in LETTERS if x <= ord(c) <= y), None)
            if low:
                at.append(i)
                digits.append(ord(c) - low[0])
                alphabets.append(low)
        out = list(text)
        for i, d, (first, _) in zip(at, self.permute(kind, digits, [n for _, n in alphabets], inverse), alphabets):
            out[i] = chr(first + d)
        return "".join(out)


def luhn(digits: str) -> int:
    """Luhn sum modulo 10 (0: valid)."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (2 if i % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10


def mod97(iban: str) -> int:
    t = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in t[4:] + t[:4])) % 97


def _digits_at(s: str) -> list[int]:
    return [i for i, c in enumerate(s) if c.isdigit()]


def _is_ssn(s: str) -> bool:
    """Area, group and serial number that can be given out."""
    area, group, serial = s.split("-")
    return area not in ("000", "666") and area[0] != "9" and group != "00" and serial != "0000"


def _card_end(s: str) -> int:
    """End of the shortest part of 13 digits or more that ends before a separator, or with the
    number, and has a valid check digit (a card's own number may be followed by others); else 0."""
    digits = ""
    for i, c in enumerate(s):
        if c.isdigit():
            digits += c
            if len(digits) >= 13 and not s[i + 1:i + 2].isdigit() and not luhn(digits):
                return i + 1
    return 0


def _date_parts(s: str):
    """(day number, how to write another day in the same format, which days fit it), or None."""
    named = _NAMED.fullmatch(s)
    if named:
        g = [x for x in named.groups() if x is not None]
        day, name, year = (g[0], g[2], g[4]) if g[0].isdigit() else (g[2], g[0], g[4])
        own, m = next((k, i + 1) for k, names in MONTHS.items() for i, x in enumerate(names) if x.lower() == name.lower())
        style = str.lower if name.islower() else str.upper if name.isupper() and len(name) > 1 else str.capitalize
        y, n = int(year), int(day)

        def write(d):
            new = {name: style(MONTHS[own][d.month - 1]), day: f"{d.day:0{len(day)}d}", year: f"{d.year}"}
            return "".join(new[x] if x in (name, day, year) else x for x in g)

        def fits(d):  # same width, and read in the same language again
            new = style(MONTHS[own][d.month - 1])
            return len(f"{d.day:0{len(day)}d}") == len(day) and own == next(k for k, names in MONTHS.items() if new.lower() in [x.lower() for x in names])
    else:
        sep = next(c for c in s if not c.isdigit())
        p = s.split(sep)
        if len(p[0]) == 4:
            order = (0, 1, 2)
        else:  # day first, unless only the other order is a date
            order = (2, 1, 0) if int(p[1]) <= 12 else (2, 0, 1)
        y, m, n = (int(p[i]) for i in order)

        def write(d):
            out = [""] * 3
            for i, v in zip(order, (d.year, d.month, d.day)):
                out[i] = f"{v:0{len(p[i])}d}"
            return sep.join(out)

        def fits(d):  # same widths, and read in the same order again
            return len(write(d)) == len(s) and (order != (2, 0, 1) or d.day > 12)
    try:
        number = dt.date(y, m, n).toordinal() - FIRST_DAY
    except ValueError:
        return None
    return (number, write, fits) if 0 <= number < DAYS else None


def pseudonym(cipher: Cipher, kind: str, s: str, inverse: bool = False) -> tuple[str, str] | None:
    """(kind, pseudonym) of a found value, or None if it isn't valid."""
    if kind == "email":
        return kind, cipher.characters(kind, s, range(s.index("@")), inverse)
    if kind == "ip":
        octets = [int(x) for x in s.split(".")]
        if max(octets) > 255:
            return None
        return kind, ".".join(map(str, cipher.permute(kind, octets, [256] * 4, inverse)))
    if kind == "date":
        parts = _date_parts(s)
        if parts is None:
            return None
        day = cipher.below(kind, parts[0], DAYS, lambda x: parts[2](dt.date.fromordinal(FIRST_DAY + x)), inverse)
        return kind, parts[1](dt.date.fromordinal(FIRST_DAY + day))
    if kind == "iban":
        if mod97(s) != 1:
            return None
        body = cipher.characters(kind, s, range(4, len(s)), inverse)
        return kind, body[:2] + f"{98 - mod97(body[:2] + '00' + body[4:]):02d}" + body[4:]
    at = _digits_at(s)
    if kind == "ssn":
        if not _is_ssn(s):
            return None
        while True:
            s = cipher.characters(kind, s, at, inverse)
            if _is_ssn(s):
                return kind, s
    if kind == "phone":
        if not 7 <= len(at) <= 15:
            return None
        code = len(re.match(r"\+\d{1,3}(?=[ .(-])|\+\d|", s).group().lstrip("+"))
        return kind, cipher.characters(kind, s, at[code:], inverse)
    end = _card_end(s)
    if not end:  # no check digit: an account number, all its digits are free
        # the pseudonym must not hold a valid card number, or it could not be inverted
        while True:
            s = cipher.characters("account", s, at, inverse)
            if not _card_end(s):
                return "account", s
    at, rest = [i for i in at if i < end], s[end:]
    s = s[:end]
    while True:
        out = list(cipher.characters("card", s, at[1:-1], inverse))
        out[at[-1]] = "0"
        out[at[-1]] = str(-luhn("".join(out[i] for i in at)) % 10)
        s = "".join(out)
        if _card_end(s + rest) == end:
            return "card", s


def rewrite(cipher: Cipher, text: str, inverse: bool = False) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with pseudonyms, and (kind, start, end) of each value in the given text."""
    out, spans, at, look = [], [], 0, 0
    while m := FOUND.search(text, look):
        got = pseudonym(cipher, m.lastgroup if m.lastgroup in KINDS else "date", m.group(), inverse)
        if got:
            out += [text[at:m.start()], got[1]]
            at = look = m.start() + len(got[1]) if got[0] == "card" else m.end()  # a card may end before the digits do
            spans.append((got[0], m.start(), at))
        else:
            look = m.start() + 1  # not valid: another value may begin inside
    return ("".join(out) + text[at:] if spans else text), spans


def pseudonymise(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text", inverse: bool = False) -> DataFrame:
    """``(id, text, spans)``: texts with pseudonyms; spans ``(kind, start, end)`` in the input.

    Null texts stay null without spans; empty texts stay empty; repeated rows and null ids
    keep their rows; other columns are ignored.  ``inverse`` restores texts made with the
    same key.
    """
    bounded_batches(docs.sparkSession)

    def run(batches):
        cipher = Cipher(key)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for b in batches:
            texts = b.column("t")
            maybe = pc.fill_null(pc.match_substring_regex(texts, HINT), False).to_pylist()
            out, spans = [], []
            for x, look in zip(texts, maybe):
                if look:
                    t, s = rewrite(cipher, x.as_py(), inverse)
                else:
                    t, s = x.as_py(), []
                out.append(t)
                spans.append([{"kind": k, "start": i, "end": j} for k, i, j in s])
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(out, pa.string()), pa.array(spans, kind)], names=["id", "t", "spans"])

    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    id_type = base.schema["id"].dataType.simpleString()
    return (base.mapInArrow(run, f"id {id_type}, t string, spans array<struct<kind:string,start:int,end:int>>")
            .withColumnsRenamed({"id": id_col, "t": text_col}))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data replaced by linked pseudonyms."""
    r = pseudonymise(table(spark, sf_dir, "documents"), QUERY_KEY)
    counts = [F.expr(f"cast(size(filter(spans, x -> x.kind = '{k}')) as long) AS n_{k}") for k in KINDS]
    return r.select("doc_id", *counts, "text")


QUERY = LlmQuery("op5_pii_pseudonyms", query, None)
