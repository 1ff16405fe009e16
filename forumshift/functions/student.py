"""Student's t for whole degrees of freedom, as Python numbers, Spark SQL and DuckDB SQL.

``P(|T| <= t)`` has a closed form in ``theta = atan(t / sqrt(df))`` (Abramowitz and Stegun 26.7.3
and 26.7.4): a finite sum of ``df / 2`` terms, exact from one degree of freedom on.
"""

from __future__ import annotations

import math


def central_probability(t: float, df: int) -> float:
    """P(|T| <= t)."""
    t = abs(t)
    c2, sine = df / (df + t * t), t / math.sqrt(df + t * t)
    term = total = 1.0 if df % 2 == 0 else (0.0 if df == 1 else math.sqrt(c2))
    for k in range(1, (df - 2) // 2 + 1 if df % 2 == 0 else (df - 3) // 2 + 1):
        term *= c2 * ((2 * k - 1) / (2 * k) if df % 2 == 0 else 2 * k / (2 * k + 1))
        total += term
    return sine * total if df % 2 == 0 else 2 / math.pi * (math.atan(t / math.sqrt(df)) + sine * total)


def critical_value(level: float, df: int) -> float:
    """The t with P(|T| <= t) = level, by bisection."""
    low, high = 0.0, 1e6
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if central_probability(mid, df) < level else (low, mid)
    return high


def two_sided_spark(t: str, df: str) -> str:
    """P(|T| >= |t|) as Spark SQL; null without degrees of freedom."""
    c2 = f"({df} / ({df} + {t} * {t}))"
    even = f"({df} % 2 = 0)"
    terms = f"cast(({df} - if({even}, 2, 3)) / 2 as int)"
    first = f"if({even}, 1D, if({df} = 1, 0D, sqrt({c2})))"
    total = (f"if({terms} >= 1, aggregate(sequence(1, {terms}), named_struct('m', {first}, 's', {first}), (a, k) -> named_struct("
             f"'m', a.m * {c2} * if({even}, (2 * k - 1) / (2D * k), 2D * k / (2 * k + 1)), "
             f"'s', a.s + a.m * {c2} * if({even}, (2 * k - 1) / (2D * k), 2D * k / (2 * k + 1))), a -> a.s), {first})")
    sine = f"(abs({t}) / sqrt({df} + {t} * {t}))"
    return (f"CASE WHEN {df} >= 1 THEN greatest(0D, 1D - if({even}, {sine} * {total}, "
            f"2D / pi() * (atan(abs({t}) / sqrt({df})) + {sine} * {total}))) END")


def central_duck(t: str, df: str) -> str:
    """P(|T| <= |t|) as DuckDB SQL, every coefficient a product of its own."""
    c2 = f"({df} / ({df} + {t} * {t}))"
    sine = f"(abs({t}) / sqrt({df} + {t} * {t}))"

    def total(most, ratio, power):
        each = f"pow({c2}, {power}) * coalesce(list_product(list_transform(range(1, k + 1), lambda j: {ratio})), 1)"
        return f"coalesce(list_sum(list_transform(range(0, CAST({most} AS BIGINT) + 1), lambda k: {each})), 0)"

    even = total(f"({df} - 2) / 2", "(2 * j - 1) / (2e0 * j)", "k")
    odd = total(f"({df} - 3) / 2", "2 * j / (2e0 * j + 1)", "k + 0.5e0")
    return (f"(CASE WHEN {df} % 2 = 0 THEN {sine} * {even} ELSE 2 / pi() * (atan(abs({t}) / sqrt({df})) + "
            f"CASE WHEN {df} = 1 THEN 0 ELSE {sine} * {odd} END) END)")
