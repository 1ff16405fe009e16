"""Hashed literal lookup tables for small, size-checked dimension tables.

A literal ``map`` is scanned linearly on every lookup, which is fine for a
handful of keys but not for a 2,000-term vocabulary probed by every token.  We
split the table into buckets by ``xxhash64(key)`` (computed by Spark itself, so
the probe side uses exactly the same function) and probe one small map per key.
The table is part of the plan, so every task has it without a shuffle.  It is
emitted as SQL text (one parser call) rather than thousands of literal Column
objects built one by one through the Python-JVM bridge.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_ROWS = 200_000


def sql_literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, str):
        return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if isinstance(v, float):
        return f"CAST({v!r} AS DOUBLE)"
    return repr(v)


def literal_lookup(table: DataFrame, key: str, value: str, per_bucket: int = 8,
                   max_rows: int = MAX_ROWS) -> tuple[Callable[[str], str], list]:
    """Return ``probe(key_sql) -> value-or-null SQL`` and the collected rows.

    For tables with a proven bound; raises if there are more than ``max_rows`` rows.
    """
    n = table.limit(max_rows + 1).count()
    if n > max_rows:
        raise ValueError(f"lookup table has more than {max_rows} rows")
    nb = max(1, n // per_bucket)
    rows = table.select(F.col(key).alias("k"), F.col(value).alias("v"),
                        F.pmod(F.xxhash64(F.col(key)), F.lit(nb)).alias("b")).collect()
    buckets: list[list] = [[] for _ in range(nb)]
    for r in rows:
        buckets[r["b"]].append((r["k"], r["v"]))
    ktype = table.schema[key].dataType.simpleString()
    vtype = table.schema[value].dataType.simpleString()
    maps = []
    for b in buckets:
        body = ", ".join(f"{sql_literal(k)}, {sql_literal(v)}" for k, v in b)
        maps.append(f"CAST(map({body}) AS MAP<{ktype}, {vtype}>)")
    table_sql = f"array({', '.join(maps)})"

    def probe(k: str) -> str:
        return f"try_element_at(get({table_sql}, CAST(pmod(xxhash64({k}), {nb}) AS INT)), {k})"

    return probe, rows


def in_list_sql(values) -> str:
    """``IN (...)`` body for a bounded list (compiled by Spark into a hash set)."""
    return ", ".join(sql_literal(v) for v in values)
