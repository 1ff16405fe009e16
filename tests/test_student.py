"""Student's t in Python, Spark and DuckDB."""

import duckdb
import pytest
from pyspark.sql import functions as F

from forumshift.functions import student as S

# fixed values: the published table of two-sided 5 per cent points
TABLE = {1: 12.706, 2: 4.303, 3: 3.182, 4: 2.776, 6: 2.447, 10: 2.228, 30: 2.042, 120: 1.980}


@pytest.mark.parametrize("df,t", TABLE.items())
def test_critical_values_equal_the_table(df, t):
    assert round(S.critical_value(0.95, df), 3) == t


def test_closed_form_equals_the_integral():
    """Simpson's rule over the density."""
    import math
    for df in (1, 2, 3, 4, 5, 8, 13, 40):
        c = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
        for t in (0.1, 1.0, 2.776, 6.0):
            n = 4000
            f = [c * (1 + (t * i / n) ** 2 / df) ** (-(df + 1) / 2) for i in range(n + 1)]
            integral = t / n / 3 * (f[0] + f[-1] + 4 * sum(f[1:-1:2]) + 2 * sum(f[2:-1:2]))
            assert abs(2 * integral - S.central_probability(t, df)) < 1e-9


def test_engines_agree(spark):
    rows = [(t, d) for t in (0.0, 0.3, -1.5, 2.0, 12.706, -40.0) for d in (1, 2, 3, 4, 5, 9, 30, 201)]
    got = spark.createDataFrame(rows, "t double, d long").select("t", "d", F.expr(S.two_sided_spark("t", "cast(d as double)")).alias("p")).collect()
    for r in got:
        want = 1 - S.central_probability(r.t, r.d)
        duck = duckdb.sql(f"SELECT 1 - {S.central_duck('t', 'd')} FROM (SELECT {r.t}::DOUBLE AS t, {r.d}::BIGINT AS d)").fetchall()[0][0]
        assert abs(r.p - want) < 1e-12 and abs(duck - want) < 1e-12
    none = spark.createDataFrame([(1.0, 0)], "t double, d long").select(F.expr(S.two_sided_spark("t", "cast(d as double)")).alias("p")).first()
    assert none.p is None
