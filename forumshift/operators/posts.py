"""Post-level operators: ingest filters, tags, language groups, HTML split,
lengths and token normalisation (P1-P3, P8, X1-X16).

All are narrow transformations (no shuffle) except ``word_freq`` and
``apply_lemmas``, which aggregate/join by word.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.dates import lenient_date
from ..functions.porter import porter_stem

# Language precedence of the study (first hit wins) and its default group.
LANGUAGE_RULES = (("python", "Python"), ("r", "R"), ("php", "PHP"))
LANGUAGE_DEFAULT = "JavaScript"
SCRIPT_TAGS = ("python", "r", "javascript", "php")


def filter_questions(df: DataFrame, col: str = "PostTypeId") -> DataFrame:
    """Keep questions (``PostTypeId == "1"``; null is dropped)."""
    return df.where(F.col(col) == F.lit("1"))


def filter_dates(df: DataFrame, start: str, end: str, col: str = "CreationDate") -> DataFrame:
    """Inclusive date range that keeps rows whose date is missing or unparsable."""
    d = lenient_date(col)
    out = (d < F.lit(start).cast("date")) | (d > F.lit(end).cast("date"))
    return df.where(~F.coalesce(out, F.lit(False)))


def filter_tags(df: DataFrame, tags: Iterable[str] = SCRIPT_TAGS, col: str = "Tags") -> DataFrame:
    """The raw tag string contains ``|tag|`` for any of the tags."""
    cond = None
    for t in tags:
        c = F.col(col).contains(f"|{t}|")
        cond = c if cond is None else (cond | c)
    return df.where(cond)


def parse_tags(df: DataFrame, col: str = "Tags", out: str = "tag_list") -> DataFrame:
    """Tag list and its length."""
    return df.withColumn(out, X.split_tags(col)).withColumn("tag_count", F.array_size(out))


def language_group(df: DataFrame, tag_col: str = "tag_list", out: str = "group",
                   rules: Sequence[tuple[str, str]] = LANGUAGE_RULES,
                   default: str = LANGUAGE_DEFAULT) -> DataFrame:
    """First matching language tag in rule order, else the default."""
    expr = None
    for tag, label in rules:
        cond = F.array_contains(F.col(tag_col), F.lit(tag))
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return df.withColumn(out, expr.otherwise(F.lit(default)))


def split_html(df: DataFrame, col: str = "Body", mode: str = "regex") -> DataFrame:
    """``content`` struct {text, code[]} plus ``clean_text`` / ``code_blocks``.

    ``regex`` mode takes code blocks by one pattern; ``parser`` mode reads the markup piece
    by piece and follows nested or unclosed code elements.  Both are column expressions.
    """
    if mode == "regex":
        content = F.struct(X.prose_text(col).alias("text"), X.code_blocks(col).alias("code"))
        content = F.when(F.col(col).isNotNull(), content)
    elif mode == "parser":
        content = X.split_nested(col)
    else:
        raise ValueError("mode must be 'regex' or 'parser'")
    return (df.withColumn("content", content)
              .withColumns({"clean_text": F.col("content.text"),
                            "code_blocks": F.col("content.code")}))


def post_lengths(df: DataFrame, body: str = "Body", title: str = "Title") -> DataFrame:
    """Code length (joined blocks), body length (raw HTML), title length."""
    return df.withColumns({
        "code_length": F.char_length(F.array_join("code_blocks", "")),
        "body_length": F.char_length(F.col(body)),
        "title_length": F.char_length(F.col(title)),
    })


def normalise_text(df: DataFrame, col: str = "clean_text", out: str = "processed_text",
                   stop_words: Iterable[str] = X.ENGLISH_STOP_WORDS,
                   remove_stops: bool = True) -> DataFrame:
    """lower/strip/empty->null, then filtered word tokens joined by a space."""
    return df.withColumn(out, X.filter_tokens(X.clean_lower(col), stop_words, remove_stops))


def process_posts(df: DataFrame, html_mode: str = "regex", extra: Sequence[str] = ()) -> DataFrame:
    """The processed-post table: select -> HTML split -> tags -> lengths -> drop -> normalise.

    ``extra`` names further input columns to carry along (e.g. ``forum``).
    """
    keep = [c for c in ("Id", "CreationDate", "Score", "ViewCount", "Title", "Body", "Tags",
                        "AnswerCount", "CommentCount", *extra) if c in df.columns]
    out = split_html(df.select(*keep), "Body", html_mode)
    out = parse_tags(out)
    out = post_lengths(out)
    out = out.drop("Body", "Tags", "content")
    return normalise_text(out)


def tech_expr_length(df: DataFrame, code_forums: Iterable[str], forum_col: str = "forum",
                     text_col: str = "clean_text", out: str = "expr_length") -> DataFrame:
    """Code length for code forums, equation length for the others."""
    return df.withColumn(out, F.when(F.col(forum_col).isin(list(code_forums)), F.col("code_length"))
                         .otherwise(X.math_length(text_col)))


def tokens_long(df: DataFrame, key: str, col: str) -> DataFrame:
    """(key, pos, token) rows of a space-separated text (python ``str.split`` semantics)."""
    # *_outer: a plain explode makes Catalyst infer a not-null/size filter on the
    # generator input and push it below the projection, evaluating an expensive
    # text column twice.  Nulls are dropped after the explode instead.
    return (df.select(F.col(key), F.posexplode_outer(F.split(F.col(col), r"\s+")).alias("pos", "token"))
              .where(F.col("token").isNotNull() & (F.col("token") != "")))


def _words(df: DataFrame, col: str, *keep) -> DataFrame:
    # explode_outer + filter on the word: no predicate on the (expensive) text column
    # is pushed below its projection, so the text is computed once.
    return df.select(*keep, F.explode_outer(F.split(F.col(col), r"\s+")).alias("word")).where(
        F.col("word").isNotNull() & (F.col("word") != ""))


def word_freq(df: DataFrame, col: str = "processed_text", k: int | None = None) -> DataFrame:
    """Word -> count, all words; ``k`` keeps the most frequent (ties by word).

    The aggregate is partial per task before the shuffle; a top-k is a distributed
    TakeOrderedAndProject, never a single-task sort of all words.
    """
    freq = _words(df, col).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return freq if k is None else freq.orderBy(F.desc("n"), F.asc("word")).limit(k)


def word_freq_by(df: DataFrame, period: str, col: str = "processed_text") -> DataFrame:
    """(period, word) -> count in one pass; rows without a period are left out."""
    return (_words(df, col, F.col(period)).where(F.col(period).isNotNull())
            .groupBy(period, "word").agg(F.count(F.lit(1)).alias("n")))


def apply_lemmas(df: DataFrame, key: str, col: str, lemmas: DataFrame,
                 out: str = "lemmatized_text") -> DataFrame:
    """Replace every token by its dictionary entry (``token -> lemma``).

    Tokens are exploded with their position, joined with the dictionary, and
    regrouped per document in position order.  The dictionary's part of each exchange is
    hashed, so the many token rows are not sorted by word; AQE splits skewed tokens.
    Documents without tokens keep an empty string.
    """
    toks = tokens_long(df, key, col)
    joined = toks.join(lemmas.hint("shuffle_hash"), "token", "left").select(
        key, "pos", F.coalesce(F.col("lemma"), F.col("token")).alias("lemma"))
    regrouped = joined.groupBy(key).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "lemma"))),
                                 lambda s: s["lemma"]), " ").alias(out))
    return (df.join(regrouped, key, "left")
              .withColumn(out, F.when(F.col(col).isNotNull(), F.coalesce(F.col(out), F.lit("")))))


def plural_lemmas(df: DataFrame, col: str) -> DataFrame:
    """A lemma dictionary derived from the corpus by one rule: a token ending in
    ``s`` maps to its stem when the stem is itself a corpus token."""
    vocab = df.select(F.explode_outer(F.split(F.col(col), r"\s+")).alias("token")).where(
        F.col("token").isNotNull() & (F.col("token") != "")).distinct()
    plural = vocab.where(F.col("token").endswith("s") & (F.char_length("token") > 3)).withColumn(
        "lemma", F.expr("substr(token, 1, char_length(token) - 1)"))
    return plural.join(vocab.withColumnRenamed("token", "lemma"), "lemma", "left_semi").select(
        "token", "lemma")


def first_per_group(df: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """O3: value of the first row per group by ``order`` (ties broken by value)."""
    return df.groupBy(group).agg(F.min_by(F.col(value), F.struct(order, value)).alias(value))


def row_slice(df: DataFrame, offset: int, length: int, order: str = "Id") -> DataFrame:
    """Ordered slice (for samples only; bulk work is partitioned by Spark)."""
    return df.orderBy(order).offset(offset).limit(length)


def stem_dictionary(df: DataFrame, col: str) -> DataFrame:
    """``(token, lemma)`` pairs of the Porter stemmer, computed once per distinct
    token (a distinct job, then column expressions), only where the stem differs."""
    vocab = df.select(F.explode_outer(F.split(F.col(col), r"\s+")).alias("token")).where(
        F.col("token").isNotNull() & (F.col("token") != "")).distinct()
    return vocab.withColumn("lemma", porter_stem("token")).where(F.col("lemma") != F.col("token"))
