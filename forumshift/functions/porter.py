"""Porter (1980) suffix stripping as column expressions.

A word's shape spells its letters as vowels (V) and consonants (K); the algorithm's
conditions are counts and patterns over shapes.  Each step is one expression over the
result of the step before, bound by a one-element array so that it is computed once.
Words are expected in lower case.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffix rules of the published algorithm (M. F. Porter, 1980), in order.
STEP2 = (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"),
         ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"),
         ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"),
         ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"),
         ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"))
STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"),
         ("ful", ""), ("ness", ""))
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent",
         "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _shape(x: str) -> str:
    # y is a consonant at the start and after a vowel (another y included)
    y = f"regexp_replace(regexp_replace({x}, '(^|[aeiou])y', '$1Y'), 'yy', 'yY')"
    return f"regexp_replace(regexp_replace({y}, '[aeiouy]', 'V'), '[^V]', 'K')"


def _measure(x: str) -> str:
    return f"regexp_count({_shape(x)}, 'VK')"


def _has_vowel(x: str) -> str:
    return f"contains({_shape(x)}, 'V')"


def _cvc(x: str) -> str:
    return f"(endswith({_shape(x)}, 'KVK') AND right({x}, 1) NOT IN ('w', 'x', 'y'))"


def _cut(x: str, n: int) -> str:
    return f"left({x}, length({x}) - {n})"


def _rules(rules) -> str:
    """The first rule whose suffix fits, as (stem, replacement)."""
    return "CASE " + " ".join(f"WHEN endswith(w, '{s}') THEN struct({_cut('w', len(s))} AS stem, '{r}' AS rep)" for s, r in rules) + " END"


def _apply(rules, condition: str) -> str:
    return f"transform(array({_rules(rules)}), r -> IF(r IS NOT NULL AND {condition}, concat(r.stem, r.rep), w))[0]"


_AFTER_1B = (f"CASE WHEN endswith(s, 'at') OR endswith(s, 'bl') OR endswith(s, 'iz') THEN concat(s, 'e') "
             f"WHEN length(s) >= 2 AND right(s, 1) = left(right(s, 2), 1) AND endswith({_shape('s')}, 'K') THEN "
             f"IF(right(s, 1) NOT IN ('l', 's', 'z'), {_cut('s', 1)}, IF({_measure('s')} = 1 AND {_cvc('s')}, concat(s, 'e'), s)) "
             f"WHEN {_measure('s')} = 1 AND {_cvc('s')} THEN concat(s, 'e') ELSE s END")


def _stripped(n: int) -> str:
    return f"transform(array({_cut('w', n)}), s -> {_AFTER_1B})[0]"


_ION = "(r.rep <> 'ion' OR right(r.stem, 1) IN ('s', 't'))"
STEPS = (
    # 1a
    f"CASE WHEN endswith(w, 'sses') OR endswith(w, 'ies') THEN {_cut('w', 2)} WHEN endswith(w, 'ss') THEN w "
    f"WHEN endswith(w, 's') THEN {_cut('w', 1)} ELSE w END",
    # 1b
    f"CASE WHEN endswith(w, 'eed') THEN IF({_measure(_cut('w', 3))} > 0, {_cut('w', 1)}, w) "
    f"WHEN endswith(w, 'ed') AND {_has_vowel(_cut('w', 2))} THEN {_stripped(2)} "
    f"WHEN endswith(w, 'ing') AND {_has_vowel(_cut('w', 3))} THEN {_stripped(3)} ELSE w END",
    # 1c
    f"IF(endswith(w, 'y') AND {_has_vowel(_cut('w', 1))}, concat({_cut('w', 1)}, 'i'), w)",
    # 2, 3
    _apply(STEP2, f"{_measure('r.stem')} > 0"),
    _apply(STEP3, f"{_measure('r.stem')} > 0"),
    # 4: the suffix goes; 'ion' only after s or t
    f"transform(array({_rules([(s, s) for s in STEP4])}), r -> IF(r IS NOT NULL AND {_measure('r.stem')} > 1 AND {_ION}, r.stem, w))[0]",
    # 5a, 5b
    f"IF(endswith(w, 'e') AND ({_measure(_cut('w', 1))} > 1 OR ({_measure(_cut('w', 1))} = 1 AND NOT {_cvc(_cut('w', 1))})), {_cut('w', 1)}, w)",
    f"IF(endswith(w, 'll') AND {_measure('w')} > 1, {_cut('w', 1)}, w)",
)


def porter_sql(word: str) -> str:
    out = word
    for step in STEPS:
        out = f"transform(array({out}), w -> {step})[0]"
    return f"IF(length({word}) <= 2, {word}, {out})"


def porter_stem(word: str) -> Column:
    """Stem of a column of lower-case words; words of two letters or fewer stay."""
    return F.expr(porter_sql(word))
