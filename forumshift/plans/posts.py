"""Raw posts -> processed posts over the document analogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.dates import as_timestamp, lenient_timestamp
from ..operators import posts as O
from ..operators.panel import BOUNDARIES, period_split
from . import sqltext as Q
from .fixtures import DOCS_EVENT_DATE, fixture, register_tables, with_views
from .registry import register, rounded

INGEST_RANGE = ("2021-01-01", "2022-12-31")


def docs_posts(spark, sf):
    return fixture(spark, sf, "posts_docs")


def processed(spark, sf, extra=()):
    return O.process_posts(O.filter_questions(docs_posts(spark, sf)), extra=extra)


def _sql(body: str) -> str:
    return with_views(body, "posts_docs")


@register("question_filter", _sql("SELECT Id, PostTypeId FROM posts_docs WHERE PostTypeId = '1'"))
def q_question_filter(spark, sf):
    """Questions only."""
    return O.filter_questions(docs_posts(spark, sf)).select("Id", "PostTypeId")


@register("date_range_keep_bad", _sql(f"""
SELECT Id, CreationDate FROM posts_docs
WHERE NOT coalesce({Q.lenient_date('CreationDate')} < DATE '{INGEST_RANGE[0]}'
               OR {Q.lenient_date('CreationDate')} > DATE '{INGEST_RANGE[1]}', false)"""))
def q_date_range_keep_bad(spark, sf):
    """Inclusive date range; missing and unparsable dates are kept."""
    return O.filter_dates(docs_posts(spark, sf), *INGEST_RANGE).select("Id", "CreationDate")


@register("tag_any_filter", _sql("""
SELECT Id, Tags FROM posts_docs
WHERE contains(Tags, '|python|') OR contains(Tags, '|r|') OR contains(Tags, '|javascript|')
   OR contains(Tags, '|php|')"""))
def q_tag_any_filter(spark, sf):
    """Any-of-literals tag filter on the raw tag string."""
    return O.filter_tags(docs_posts(spark, sf)).select("Id", "Tags")


@register("language_group", _sql(f"""
SELECT Id, CAST(len(tl) AS INTEGER) AS tag_count,
       CASE WHEN list_contains(tl, 'python') THEN 'Python' WHEN list_contains(tl, 'r') THEN 'R'
            WHEN list_contains(tl, 'php') THEN 'PHP' ELSE 'JavaScript' END AS "group"
FROM (SELECT Id, {Q.split_tags('Tags')} AS tl FROM posts_docs)"""))
def q_language_group(spark, sf):
    """Tag list, tag count and language group with precedence."""
    df = O.language_group(O.parse_tags(docs_posts(spark, sf)))
    return df.select("Id", "tag_count", "group")


@register("html_split", _sql(f"""
SELECT Id, clean_text, CAST(len(code) AS INTEGER) AS n_code_blocks,
       array_to_string(code, '\n') AS code_text
FROM (SELECT Id, {Q.prose_text('Body')} AS clean_text, {Q.code_blocks('Body')} AS code
      FROM posts_docs)"""))
def q_html_split(spark, sf):
    """Prose text and code blocks of the post bodies (regex mode)."""
    df = O.split_html(docs_posts(spark, sf))
    return df.select("Id", "clean_text", F.array_size("code_blocks").alias("n_code_blocks"),
                     F.array_join("code_blocks", "\n").alias("code_text"))


@register("html_split_pages", f"""
SELECT page_id, clean_text, CAST(len(code) AS INTEGER) AS n_code_blocks
FROM (SELECT page_id, {Q.prose_text('html')} AS clean_text, {Q.code_blocks('html')} AS code
      FROM pages)""")
def q_html_split_pages(spark, sf):
    """X1 on raw web pages: scripts, styles, comments and entities handled."""
    register_tables(spark, sf, ("pages",))
    df = O.split_html(spark.table("pages"), "html")
    return df.select("page_id", "clean_text", F.array_size("code_blocks").alias("n_code_blocks"))


_PROCESSED_SQL = f"""
q AS (SELECT * FROM posts_docs WHERE PostTypeId = '1'),
s AS (SELECT Id, CreationDate, Title, Body, forum, {Q.prose_text('Body')} AS clean_text,
             {Q.code_blocks('Body')} AS code_blocks, {Q.split_tags('Tags')} AS tag_list FROM q),
p AS (SELECT Id, CreationDate, forum, tag_list, clean_text, CAST(len(tag_list) AS INTEGER) AS tag_count,
             CAST(length(array_to_string(code_blocks, '')) AS INTEGER) AS code_length,
             CAST(length(Body) AS INTEGER) AS body_length,
             CAST(length(Title) AS INTEGER) AS title_length,
             {Q.filter_tokens(Q.clean_lower('clean_text'))} AS processed_text FROM s)"""


def processed_sql(select: str) -> str:
    return with_views("", "posts_docs") + "," + _PROCESSED_SQL + "\n" + select


@register("post_lengths", processed_sql(
    "SELECT Id, tag_count, code_length, body_length, title_length FROM p"))
def q_post_lengths(spark, sf):
    """Tag count, code length, body length, title length of questions."""
    return processed(spark, sf).select("Id", "tag_count", "code_length", "body_length",
                                       "title_length")


@register("normalise_text", processed_sql("SELECT Id, processed_text FROM p"))
def q_normalise_text(spark, sf):
    """lower/strip/empty->null and stop-word/punctuation token filter."""
    return processed(spark, sf).select("Id", "processed_text")


def _with_stops(e: str) -> str:
    return f"array_to_string(regexp_extract_all({e}, {Q.lit(X.WORD_RE)}, 0), ' ')"


@register("normalise_text_all", processed_sql(f"SELECT Id, {_with_stops(Q.clean_lower('clean_text'))} AS processed_text FROM p"))
def q_normalise_text_all(spark, sf):
    """X8 with stop words kept: all word tokens."""
    p = O.normalise_text(processed(spark, sf), remove_stops=False)
    return p.select("Id", "processed_text")


@register("lemma_join", processed_sql("""
, toks AS (SELECT Id, unnest(range(1, len(string_split_regex(processed_text, '\\s+')) + 1)) AS pos,
                  unnest(string_split_regex(processed_text, '\\s+')) AS token
           FROM p WHERE processed_text IS NOT NULL),
vocab AS (SELECT DISTINCT token FROM toks WHERE token <> ''),
lem AS (SELECT v.token, substr(v.token, 1, length(v.token) - 1) AS lemma FROM vocab v
        WHERE suffix(v.token, 's') AND length(v.token) > 3
          AND substr(v.token, 1, length(v.token) - 1) IN (SELECT token FROM vocab)),
rejoined AS (SELECT Id, string_agg(coalesce(lem.lemma, toks.token), ' ' ORDER BY pos) AS lemmatized_text
             FROM toks LEFT JOIN lem USING (token) WHERE toks.token <> '' GROUP BY Id)
SELECT p.Id, CASE WHEN p.processed_text IS NOT NULL THEN coalesce(r.lemmatized_text, '') END
       AS lemmatized_text
FROM p LEFT JOIN rejoined r USING (Id)"""))
def q_lemma_join(spark, sf):
    """Dictionary lemmatisation by exploded join and ordered regroup."""
    # the processed text is read three times (dictionary, tokens, documents): cache
    # the two narrow columns instead of re-running the text pipeline
    p = processed(spark, sf).select("Id", "processed_text").persist()
    lemmas = O.plural_lemmas(p, "processed_text")
    return O.apply_lemmas(p, "Id", "processed_text", lemmas).select("Id", "lemmatized_text")


_WORDS_SQL = """
SELECT {keep}word, count(*) AS n
FROM (SELECT {expr}unnest(string_split_regex(processed_text, '\\s+')) AS word FROM p
      WHERE processed_text IS NOT NULL)
WHERE word <> ''{where} GROUP BY ALL"""


@register("word_freq", processed_sql(_WORDS_SQL.format(keep="", expr="", where="")))
def q_word_freq(spark, sf):
    """Frequencies of all words of the processed corpus."""
    return O.word_freq(processed(spark, sf))


@register("word_freq_top", processed_sql(_WORDS_SQL.format(keep="", expr="", where="") + " ORDER BY n DESC, word LIMIT 200"))
def q_word_freq_top(spark, sf):
    """The 200 most frequent words (a word cloud's input, a top-k report)."""
    return O.word_freq(processed(spark, sf), k=200)


_PERIOD_SQL = (f"CASE WHEN {Q.lenient_timestamp('CreationDate')} <= TIMESTAMP '{DOCS_EVENT_DATE}' THEN 'pre' "
               f"WHEN {Q.lenient_timestamp('CreationDate')} > TIMESTAMP '{DOCS_EVENT_DATE}' THEN 'post' END AS period, ")


@register("word_freq_prepost", processed_sql(_WORDS_SQL.format(
    keep="period, ", expr=_PERIOD_SQL, where=" AND period IS NOT NULL")))
def q_word_freq_prepost(spark, sf):
    """Frequencies before (<=) and after (>) the event, all words, one pass."""
    p = processed(spark, sf).withColumn("ts", lenient_timestamp("CreationDate"))
    p = period_split(p, "ts", DOCS_EVENT_DATE + "T00:00:00", "le_gt")
    return O.word_freq_by(p, "period")


def _boundary_sql(rule: str) -> str:
    pre, post = {"le_gt": ("<=", ">"), "lt_gt": ("<", ">"), "lt_ge": ("<", ">=")}[rule]
    return f"""
SELECT '{rule}' AS rule, CASE WHEN d {pre} DATE '{DOCS_EVENT_DATE}' THEN 'pre' WHEN d {post} DATE '{DOCS_EVENT_DATE}' THEN 'post' END AS period,
       count(*) AS n FROM (SELECT CAST({Q.lenient_timestamp('CreationDate')} AS DATE) AS d FROM posts_docs) GROUP BY 1, 2"""


@register("period_boundaries", _sql(" UNION ALL ".join(_boundary_sql(r) for r in BOUNDARIES)))
def q_period_boundaries(spark, sf):
    """Posts per period under the three boundary rules; the time column is parsed
    only where it is not a timestamp yet."""
    p = as_timestamp(as_timestamp(docs_posts(spark, sf).select("CreationDate"))).select(F.to_date("CreationDate").alias("d"))
    out = None
    for rule in BOUNDARIES:
        c = period_split(p, "d", DOCS_EVENT_DATE, rule).groupBy("period").agg(F.count("*").alias("n")).select(
            F.lit(rule).alias("rule"), "period", "n")
        out = c if out is None else out.unionByName(c)
    return out


@register("mean_text_length", processed_sql("""
SELECT forum, count(*) AS n, round(avg(length(processed_text)), 6) AS mean_text_length FROM p GROUP BY forum"""))
def q_mean_text_length(spark, sf):
    """Mean length of the processed text by forum."""
    return rounded(processed(spark, sf, extra=("forum",)).groupBy("forum").agg(
        F.count("*").alias("n"), F.avg(F.char_length("processed_text")).alias("mean_text_length")))


@register("html_split_parser")
def q_html_split_parser(spark, sf):
    """X1 parser mode on raw web pages (nested and unclosed code followed piece by piece)."""
    register_tables(spark, sf, ("pages",))
    df = O.split_html(spark.table("pages"), "html", mode="parser")
    return df.select("page_id", "clean_text", F.array_size("code_blocks").alias("n_code_blocks"))


@register("post_sample", _sql("SELECT Id, PostTypeId, Tags FROM posts_docs ORDER BY Id LIMIT 50 OFFSET 100"))
def q_post_sample(spark, sf):
    """Ordered row slice (offset 100, 50 rows) - a sampling operator."""
    return O.row_slice(docs_posts(spark, sf), 100, 50, "Id").select("Id", "PostTypeId", "Tags")


@register("calendar_parts", _sql(f"""
SELECT Id, d AS post_date, CAST(year(d) AS INTEGER) AS year, CAST(month(d) AS INTEGER) AS month,
       CAST(isodow(d) AS INTEGER) AS day_of_week, CAST(week(d) AS INTEGER) AS week,
       CAST(quarter(d) AS INTEGER) AS quarter, CAST(year(d) * 100 + month(d) AS INTEGER) AS year_month,
       CAST(year(d) * 10 + quarter(d) AS INTEGER) AS year_quarter,
       CAST(date_diff('day', DATE '{DOCS_EVENT_DATE}', d) AS INTEGER) AS days_from_event
FROM (SELECT Id, CAST({Q.lenient_timestamp('CreationDate')} AS DATE) AS d FROM posts_docs)"""))
def q_calendar_parts(spark, sf):
    """Date parts (ISO weekday 1=Mon, ISO week, quarter, composite keys, day difference)."""
    from ..functions import dates as Dt
    d = F.to_date(lenient_timestamp("CreationDate"))
    df = docs_posts(spark, sf).select("Id", d.alias("post_date"))
    return df.select("Id", "post_date", F.year("post_date").alias("year"), F.month("post_date").alias("month"),
                     Dt.iso_weekday("post_date").alias("day_of_week"), F.weekofyear("post_date").alias("week"),
                     F.quarter("post_date").alias("quarter"), Dt.year_month("post_date").alias("year_month"),
                     Dt.year_quarter("post_date").alias("year_quarter"),
                     F.datediff("post_date", F.lit(DOCS_EVENT_DATE).cast("date")).alias("days_from_event"))


@register("stemmed_text")
def q_stemmed_text(spark, sf):
    """Stop-word-filtered tokens stemmed through a distinct-vocabulary
    Porter dictionary joined back in token order."""
    p = processed(spark, sf).select("Id", "processed_text").persist()
    return O.apply_lemmas(p, "Id", "processed_text", O.stem_dictionary(p, "processed_text"),
                          out="stemmed_text").select("Id", "stemmed_text")
