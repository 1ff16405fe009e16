"""Normal tail probabilities as column expressions (no Python worker).

``erfc`` is the Chebyshev-fitted approximation of Press et al., *Numerical Recipes*
(section 6.2): relative error below 1.2e-7 everywhere, so small tails stay right.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values of the published approximation, constant term first
ERFC_COEFFICIENTS = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806,
                     0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def erfc_sql(x: str) -> str:
    """``erfc(x)`` as SQL text that Spark and DuckDB both read; ``x`` is a SQL expression."""
    t = f"(1e0 / (1e0 + 0.5e0 * abs({x})))"
    poly = f"({ERFC_COEFFICIENTS[-1]:.8f}e0)"
    for c in reversed(ERFC_COEFFICIENTS[:-1]):
        poly = f"({c:.8f}e0 + {t} * {poly})"
    up = f"({t} * exp(-({x}) * ({x}) + {poly}))"
    return f"(CASE WHEN ({x}) >= 0 THEN {up} ELSE 2e0 - {up} END)"


def two_sided_sql(z: str) -> str:
    """P(|Z| >= |z|) for a standard normal Z."""
    return erfc_sql(f"(abs({z}) / sqrt(2e0))")


def upper_tail_sql(z: str) -> str:
    """P(Z >= z)."""
    return f"(0.5e0 * {erfc_sql(f'(({z}) / sqrt(2e0))')})"


def two_sided(z: str) -> Column:
    return F.expr(two_sided_sql(z))
