"""Operator 4 (native): secrets by patterns and by a battery of randomness tests.

Patterns find assigned values, access ids and long hex strings.  Other long tokens are
keys if they look drawn at random: the encoding is inferred from the characters, and the
token must pass three tests of randomness over that alphabet (chi-squared uniformity,
runs about the middle of the alphabet, lag-1 serial correlation; the smallest p-value
times three).  Passing is not enough, since short text passes too: against the null
"ordinary text, where the class of a character (lower, upper, digit, sign) changes with
probability ``TEXT_SWITCH``", the number of changes has a Chernoff tail as p-value.  Letters
of one case never change class: their null is "letters as frequent as in a language", and
the p-value is the likelihood ratio of that against equal letters (Markov's inequality),
the largest over the languages.  Benjamini-Hochberg keeps the false discovery rate at ``FDR`` within each length band over
the whole corpus.  The step-up threshold comes from counts on a fixed logarithmic grid (a
partial aggregate); the table of bands is bounded and joins in as one row.

Positions are running sums of the lengths of the gaps and matches of a split, one row for each
match; which tokens touch a pattern's span is a running maximum over both in order.  So time
follows the number of matches, in column expressions throughout.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from forumshift.functions.normal import two_sided_sql, upper_tail_sql

from . import LlmQuery
from .common import table, written

# fixed values of the contract: kind, pattern, group whose length counts, least length
KINDS = (
    ("assign", r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
)
KEY_KIND = "key"
#: tokens that are tested ('=' only as padding, so the value of NAME=value is a token), and their least length
TOKEN, TOKEN_LEAST = r"[A-Za-z0-9+/_-]{16,}={0,2}", 16
TEXT_SWITCH, ALPHA, FDR = 0.1, 0.001, 0.01
#: p-values are counted on a grid of this many steps a decade, down to 1e-60
GRID, DECADES = 4, 60

_SPAN = "struct<s:int,k:int,e:int>"
_MATCH = "struct<k:int,i:int,gap:int,len:int,grp:int,token:string>"


def _lit(s: str) -> str:
    return "r'" + s.replace("'", "\\x27") + "'"


def _matches(pattern: str, group: int, kind: int, text: str = "t") -> str:
    """SQL: the matches of a pattern in order, each with the length of the gap before it, its own
    and its group's; the text of tokens."""
    p = _lit(pattern)
    token = "x['1']" if kind == len(KINDS) else "cast(null as string)"
    return f"""if({text} rlike {p}, filter(transform(
      arrays_zip(split({text}, {p}, -1), regexp_extract_all({text}, {p}, 0), regexp_extract_all({text}, {p}, {group})),
      (x, i) -> named_struct('k', {kind}, 'i', i, 'gap', length(x['0']), 'len', length(x['1']), 'grp', length(x['2']), 'token', {token})),
      x -> x.len is not null), cast(array() as array<{_MATCH}>))"""


# fixed values: alphabets of the inferred encodings, in order of the test
ENCODINGS = (
    ("decimal", "0123456789"),
    ("hex", "0123456789abcdef"),
    ("HEX", "0123456789ABCDEF"),
    ("lower", "abcdefghijklmnopqrstuvwxyz"),
    ("upper", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("lower36", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("upper36", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("letters", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("alnum", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
    ("mixed", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+-/_"),
)
# fixed values: percentages of the letters a to z in text (English, German, French, Spanish)
LETTERS = (
    (8.17, 1.49, 2.78, 4.25, 12.70, 2.23, 2.02, 6.09, 6.97, 0.15, 0.77, 4.03, 2.41, 6.75, 7.51, 1.93, 0.10, 5.99, 6.33, 9.06, 2.76, 0.98, 2.36, 0.15, 1.97, 0.07),
    (6.52, 1.89, 2.73, 5.08, 16.40, 1.66, 3.01, 4.58, 6.55, 0.27, 1.42, 3.44, 2.53, 9.78, 2.59, 0.67, 0.02, 7.00, 7.27, 6.15, 4.17, 0.85, 1.92, 0.03, 0.04, 1.13),
    (7.64, 0.90, 3.26, 3.67, 14.72, 1.07, 0.87, 0.74, 7.53, 0.61, 0.07, 5.46, 2.97, 7.10, 5.80, 2.52, 1.36, 6.69, 7.95, 7.24, 6.31, 1.84, 0.05, 0.43, 0.13, 0.33),
    (11.53, 2.22, 4.02, 5.01, 12.18, 0.69, 1.77, 0.70, 6.25, 0.49, 0.01, 4.97, 3.16, 6.71, 8.68, 2.51, 0.88, 6.87, 7.98, 4.63, 2.93, 1.14, 0.02, 0.22, 1.01, 0.47),
)


def _letters_sql(body: str) -> str:
    """SQL: largest likelihood of a language's letters over that of equal letters, at most 1."""
    def logs(shares):
        return ", ".join(f"{math.log(x / sum(shares) * 26)!r}D" for x in shares)

    sums = (f"aggregate(split(lower({body}), ''), 0D, (s, c) -> s + element_at(array({logs(x)}), ascii(c) - 96))" for x in LETTERS)
    return f"exp(least(0D, greatest({', '.join(sums)})))"


def token_tests(tokens: DataFrame) -> DataFrame:
    """Adds ``encoding, n, p_random, p_text`` to rows with a ``token`` (padding ``=`` cut)."""
    body = r"regexp_replace(token, r'=+$', '')"
    d = tokens.withColumn("body", F.expr(body)).withColumn("n", F.length("body"))
    enc = "CASE " + " ".join(f"WHEN translate(body, '{a}', '') = '' THEN '{e}'" for e, a in ENCODINGS) + " ELSE 'none' END"
    alpha = "CASE encoding " + " ".join(f"WHEN '{e}' THEN '{a}'" for e, a in ENCODINGS) + " ELSE '' END"
    d = d.withColumn("encoding", F.expr(enc)).withColumn("alphabet", F.expr(alpha)).withColumn("size", F.length("alphabet"))
    d = d.withColumn("code", F.expr("transform(split(body, ''), c -> cast(instr(alphabet, c) - 1 as double))"))
    d = d.withColumn("squares", F.expr(
        "aggregate(split(alphabet, ''), 0D, (s, c) -> s + power(n - length(replace(body, c, '')), 2))"))
    d = d.withColumn("chi2", F.expr("squares * size / n - n"))
    d = d.withColumn("df", F.expr("cast(size - 1 as double)"))
    # Wilson-Hilferty: the cube root of chi2 / df is nearly normal
    d = d.withColumn("z_chi", F.expr("(power(chi2 / df, 1D / 3) - (1 - 2 / (9 * df))) / sqrt(2 / (9 * df))"))
    d = d.withColumn("high", F.expr("transform(code, x -> if(x >= size / 2, 1, 0))"))
    d = d.withColumn("n1", F.expr("cast(aggregate(high, 0, (s, x) -> s + x) as double)")).withColumn("n0", F.expr("n - n1"))
    d = d.withColumn("runs", F.expr("1 + aggregate(zip_with(slice(high, 1, n - 1), slice(high, 2, n - 1), (x, y) -> if(x = y, 0, 1)), 0, (s, x) -> s + x)"))
    d = d.withColumn("runs_mean", F.expr("2 * n1 * n0 / n + 1"))
    d = d.withColumn("runs_var", F.expr("try_divide((runs_mean - 1) * (runs_mean - 2), n - 1)"))
    d = d.withColumn("mean", F.expr("aggregate(code, 0D, (s, x) -> s + x) / n"))
    d = d.withColumn("spread", F.expr("aggregate(code, 0D, (s, x) -> s + (x - mean) * (x - mean))"))
    d = d.withColumn("lag", F.expr("aggregate(zip_with(slice(code, 1, n - 1), slice(code, 2, n - 1), (x, y) -> (x - mean) * (y - mean)), 0D, (s, x) -> s + x)"))
    d = d.withColumn("p_chi", F.expr(upper_tail_sql("z_chi")))
    d = d.withColumn("p_runs", F.expr(f"if(runs_var > 0, {two_sided_sql('((runs - runs_mean) / sqrt(runs_var))')}, power(2D, 1 - n))"))
    d = d.withColumn("p_serial", F.expr(f"if(spread > 0, {two_sided_sql('(lag / spread * sqrt(n))')}, 0D)"))
    d = d.withColumn("p_random", F.expr("least(1D, 3 * least(p_chi, p_runs, p_serial))"))
    kind = "(CASE WHEN c rlike '[a-z]' THEN 1 WHEN c rlike '[A-Z]' THEN 2 WHEN c rlike '[0-9]' THEN 3 ELSE 4 END)"
    d = d.withColumn("class", F.expr(f"transform(split(body, ''), c -> {kind})"))
    d = d.withColumn("rate", F.expr("aggregate(zip_with(slice(class, 1, n - 1), slice(class, 2, n - 1), (x, y) -> if(x = y, 0, 1)), 0D, (s, x) -> s + x) / (n - 1)"))
    q = TEXT_SWITCH
    kl = f"(if(rate > 0, rate * ln(rate / {q}), 0D) + if(rate < 1, (1 - rate) * ln((1 - rate) / {1 - q}), 0D))"
    d = d.withColumn("p_text", F.expr(f"if(body rlike '^([a-z]+|[A-Z]+)$', {_letters_sql('body')}, if(rate > {q}, exp(-(n - 1) * {kl}), 1D))"))
    return d.select(*tokens.columns, "encoding", "n", "p_random", "p_text")


def band_thresholds(tested: DataFrame) -> DataFrame:
    """One row with a map: length band -> largest p_text that Benjamini-Hochberg accepts.
    At most 31 bands of ``GRID * DECADES`` counts each, whatever the corpus."""
    cell = F.least(F.floor(-F.log10(F.greatest("p_text", F.lit(1e-300))) * GRID), F.lit(GRID * DECADES)).cast("int")
    counts = tested.groupBy("band", cell.alias("cell")).agg(F.count("*").alias("c"))
    down = Window.partitionBy("band").orderBy(F.col("cell").desc())
    # every p of a cell is at most 10 ** (-cell / GRID)
    top = F.pow(F.lit(10.0), -F.col("cell") / GRID)
    ok = (counts.withColumn("rank", F.sum("c").over(down)).withColumn("m", F.sum("c").over(Window.partitionBy("band")))
          .filter(top * F.col("m") <= FDR * F.col("rank"))
          .groupBy("band").agg(F.max(top).alias("limit")))
    return ok.agg(F.map_from_entries(F.collect_list(F.struct("band", "limit"))).alias("limits"))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, spans)``: spans ``(kind, start, end)`` of every text, in code points.

    ``spans`` are ordered by start, then by kind as listed in ``KINDS``, keys last; ids may
    have any type.  Null texts are empty and have no spans; repeated rows are rows of their own; a null id is
    kept; other columns are ignored.  A key never overlaps a pattern's span.
    """
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    patterns = [*((p, g) for _, p, g, _ in KINDS), (TOKEN, 0)]
    found = written(base.select("id", F.concat(*[F.expr(_matches(p, g, i)) for i, (p, g) in enumerate(patterns)]).alias("m"),
                                F.expr("uuid()").alias("row")), "matches")
    least = F.array(*[F.lit(n) for *_, n in KINDS], F.lit(TOKEN_LEAST))
    order = Window.partitionBy("row", "k").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    spans = (found.select("row", F.explode("m").alias("m")).select("row", "m.*").repartition("row")
             .withColumn("e", F.sum(F.col("gap") + F.col("len")).over(order).cast("int"))
             .filter(F.col("grp") >= F.element_at(least, F.col("k") + 1))
             .select("row", (F.col("e") - F.col("len")).alias("s"), "k", "e", "token"))
    spans = written(spans, "spans")
    # a token is free if no pattern's span that begins before its end reaches beyond its start
    is_token = F.col("k") == len(KINDS)
    until = Window.partitionBy("row").orderBy(F.when(is_token, F.col("e")).otherwise(F.col("s")), F.when(is_token, 0).otherwise(1)).rowsBetween(Window.unboundedPreceding, 0)
    free = (spans.withColumn("reach", F.max(F.when(~is_token, F.col("e"))).over(until))
            .filter(is_token & (F.coalesce("reach", F.lit(0)) <= F.col("s"))).select("row", "s", "e", "token"))
    # tokens under 20 characters are a band of their own
    tested = written(token_tests(free).withColumn("band", F.when(F.col("n") < 20, 3).otherwise(F.floor(F.log2("n"))).cast("int"))
                     .select("row", "s", "e", "encoding", "n", "band", "p_random", "p_text"), "tokens")
    limits = band_thresholds(tested)
    keys = (tested.join(F.broadcast(limits))  # one row
            .filter((F.col("encoding") != "decimal") & (F.col("encoding") != "none") & (F.col("p_random") >= ALPHA)
                    & (F.col("p_text") <= F.coalesce(F.col("limits")[F.col("band")], F.lit(-1.0)))))
    per = (spans.filter(~is_token).select("row", "s", "k", "e").unionByName(keys.select("row", "s", F.lit(len(KINDS)).alias("k"), "e"))
           .groupBy("row").agg(F.sort_array(F.collect_list(F.struct("s", "k", "e"))).alias("every")))
    names = F.array(*[F.lit(k) for k, *_ in KINDS], F.lit(KEY_KIND))
    return (found.select("id", "row").join(per, "row", "left")
            .select("id", F.transform(F.coalesce("every", F.expr(f"cast(array() as array<{_SPAN}>)")), lambda x: F.struct(
                F.element_at(names, x.k + 1).alias("kind"), x.s.alias("start"), x.e.alias("end"))).alias("spans"))
            .withColumnRenamed("id", id_col))


def joined(spans):
    """``kind:start:end`` of each span, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x.kind, x.start.cast("string"), x.end.cast("string"))))


def _sql() -> str:
    """The same spans in DuckDB: patterns, tests, threshold."""
    from forumshift.functions.normal import two_sided_sql as two, upper_tail_sql as upper

    def lit(x):
        return "'" + x.replace("'", "''") + "'"

    def matches(name, k, pattern, group, least):
        return f"""
{name} AS (SELECT rid, {k} AS k, x, s, s + length(x) AS e FROM (
  SELECT rid, m[i] AS x, g[i] AS grp, list_sum(list_transform(gaps[1:i], lambda z: length(z)))
         + coalesce(list_sum(list_transform(m[1:i - 1], lambda z: length(z))), 0) AS s
  FROM (SELECT rid, m, g, gaps, unnest(range(1, len(m) + 1)) AS i FROM (
    SELECT rid, regexp_extract_all(t, {lit(pattern)}) AS m, regexp_extract_all(t, {lit(pattern)}, {group}) AS g,
           regexp_split_to_array(t, {lit(pattern)}) AS gaps FROM d WHERE regexp_matches(t, {lit(pattern)}))))
  WHERE length(grp) >= {least})"""

    parts = [matches(f"k{i}", i, p.replace('\\"', '"'), g, least) for i, (_, p, g, least) in enumerate(KINDS)]
    enc = "CASE " + " ".join(f"WHEN translate(body, {lit(a)}, '') = '' THEN {lit(e)}" for e, a in ENCODINGS) + " ELSE 'none' END"
    alpha = "CASE encoding " + " ".join(f"WHEN {lit(e)} THEN {lit(a)}" for e, a in ENCODINGS) + " ELSE '' END"
    kind = "CASE WHEN regexp_matches(c, '[a-z]') THEN 1 WHEN regexp_matches(c, '[A-Z]') THEN 2 WHEN regexp_matches(c, '[0-9]') THEN 3 ELSE 4 END"
    q = TEXT_SWITCH
    names = "CASE k " + " ".join(f"WHEN {i} THEN {lit(n)}" for i, (n, *_) in enumerate(KINDS)) + f" ELSE {lit(KEY_KIND)} END"
    n_kind = ", ".join(f"count(CASE WHEN k = {i} THEN 1 END) AS n_{n}" for i, (n, *_) in enumerate(KINDS))
    logs = [", ".join(f"{math.log(x / sum(r) * 26)!r}e0" if "e" not in repr(math.log(x / sum(r) * 26)) else repr(math.log(x / sum(r) * 26)) for x in r) for r in LETTERS]
    each = ", ".join(f"list_sum(list_transform(string_split(lower(body), ''), lambda c: [{x}][ascii(c) - 96]))" for x in logs)
    letters = f"exp(least(0, greatest({each})))"
    changes = "list_sum(list_transform(range(1, n), lambda i: CASE WHEN {0}[i] = {0}[i + 1] THEN 0 ELSE 1 END))"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),{','.join(parts)},
{matches('tk', 9, TOKEN, 0, TOKEN_LEAST).strip()},
base AS (SELECT rid, k, s, e FROM k0 UNION ALL SELECT rid, k, s, e FROM k1 UNION ALL SELECT rid, k, s, e FROM k2),
free AS (SELECT rid, s, e, regexp_replace(x, '=+$', '') AS body FROM tk
         WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.rid = tk.rid AND b.s < tk.e AND tk.s < b.e)),
f1 AS (SELECT *, CAST(length(body) AS BIGINT) AS n, {enc} AS encoding FROM free),
f2 AS (SELECT *, {alpha} AS alphabet FROM f1),
f3 AS (SELECT *, length(alphabet) AS size, list_transform(string_split(body, ''), lambda c: CAST(instr(alphabet, c) - 1 AS DOUBLE)) AS code,
              list_transform(string_split(body, ''), lambda c: {kind}) AS class,
              coalesce(list_sum(list_transform(string_split(alphabet, ''), lambda c: pow(n - length(replace(body, c, '')), 2))), 0) AS squares FROM f2),
f4 AS (SELECT *, squares * size / n - n AS chi2, CAST(size - 1 AS DOUBLE) AS df, list_transform(code, lambda x: CASE WHEN x >= size / 2.0 THEN 1 ELSE 0 END) AS high,
              list_sum(code) / n AS mean, {changes.format('class')} / (n - 1.0) AS rate FROM f3),
f5 AS (SELECT *, (pow(greatest(chi2 / df, 0), 1 / 3.0) - (1 - 2 / (9 * df))) / sqrt(abs(2 / (9 * df))) AS z_chi, CAST(list_sum(high) AS DOUBLE) AS n1,
              1 + {changes.format('high')} AS runs, list_sum(list_transform(code, lambda x: (x - mean) * (x - mean))) AS spread,
              list_sum(list_transform(range(1, n), lambda i: (code[i] - mean) * (code[i + 1] - mean))) AS lag FROM f4),
f6 AS (SELECT *, 2 * n1 * (n - n1) / n + 1 AS runs_mean FROM f5),
f7 AS (SELECT *, (runs_mean - 1) * (runs_mean - 2) / (n - 1.0) AS runs_var FROM f6),
f8 AS (SELECT *, CASE WHEN runs_var > 0 THEN (runs - runs_mean) / sqrt(runs_var) END AS z_runs, CASE WHEN spread > 0 THEN lag / spread * sqrt(n) END AS z_lag FROM f7),
f9 AS (SELECT rid, s, e, encoding, n, CASE WHEN n < 20 THEN 3 ELSE CAST(floor(log2(n)) AS INTEGER) END AS band,
              least(1, 3 * least({upper('z_chi')}, CASE WHEN z_runs IS NULL THEN pow(2e0, 1 - n) ELSE {two('z_runs')} END, CASE WHEN z_lag IS NULL THEN 0 ELSE {two('z_lag')} END)) AS p_random,
              CASE WHEN regexp_full_match(body, '[a-z]+|[A-Z]+') THEN {letters}
                   WHEN rate > {q} THEN exp(-(n - 1) * (rate * ln(rate / {q}) + CASE WHEN rate < 1 THEN (1 - rate) * ln((1 - rate) / {1 - q}) ELSE 0 END)) ELSE 1 END AS p_text
       FROM f8),
cells AS (SELECT band, least(floor(-log10(greatest(p_text, 1e-300)) * {GRID}), {GRID * DECADES}) AS cell, count(*) AS c FROM f9 GROUP BY 1, 2),
ranked AS (SELECT band, pow(10.0, -cell / {GRID}) AS top, sum(c) OVER (PARTITION BY band ORDER BY cell DESC) AS r, sum(c) OVER (PARTITION BY band) AS m FROM cells),
limits AS (SELECT band, max(top) AS lim FROM ranked WHERE top * m <= {FDR} * r GROUP BY 1),
keys AS (SELECT rid, {len(KINDS)} AS k, s, e FROM f9 JOIN limits USING (band) WHERE encoding NOT IN ('decimal', 'none') AND p_random >= {ALPHA} AND p_text <= lim),
every AS (SELECT rid, k, s, e, {names} || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT) AS x FROM (SELECT * FROM base UNION ALL SELECT * FROM keys)),
per AS (SELECT rid, {n_kind}, string_agg(x, ',' ORDER BY s, k) FILTER (k < {len(KINDS)}) AS base, string_agg(x, ',' ORDER BY s, k) AS spans FROM every GROUP BY 1)
SELECT doc_id, {', '.join(f'coalesce(n_{n}, 0) AS n_{n}' for n, *_ in KINDS)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN per USING (rid)
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document."""
    return digest(find_secrets(table(spark, sf_dir, "documents")))


def digest(r: DataFrame) -> DataFrame:
    """Counts, base checksum and joined spans of ``find_secrets``' rows."""
    count = {k: F.expr(f"cast(size(filter(spans, x -> x.kind = '{k}')) as long) AS n_{k}") for k, *_ in KINDS}
    return r.select("doc_id", *count.values(), F.sha2(joined(F.filter("spans", lambda x: x.kind != KEY_KIND)), 256).alias("base_sha256"),
                    joined(F.col("spans")).alias("spans"))


QUERY = LlmQuery("op4_secret_scan", query, _sql())
