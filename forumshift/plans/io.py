"""Sources, sinks and restartable ingest on data derived from the driver tables
(SURVEY §7.2 step 9).  Scratch output goes under the shared checkpoint folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import posts as O
from ..session import scratch_path
from ..sources import posts_io as IO
from ..streaming.resumable import resumable_ingest
from . import sqltext as Q
from .fixtures import with_views
from .posts import INGEST_RANGE, docs_posts, processed_sql
from .fixtures import ORDERS_EVENT_DATE, ORDERS_TREATED_FORUM
from .registry import register, rounded
from .volume import orders_panel, panel_sql

# All columns of the dump, with the text (markup and line breaks are escaped in attributes).
XML_COLS = ("Id", "PostTypeId", "CreationDate", "Score", "ViewCount", "Title", "Body", "Tags", "AnswerCount", "CommentCount")


def _dump(spark, sf):
    """Write the post analogue as an XML dump (Posts.xml + a decoy Users.xml)."""
    base = scratch_path(spark, "xml-dump")
    posts = docs_posts(spark, sf).select(*XML_COLS)
    IO.write_posts_xml(posts, f"{base}/Posts.xml")
    IO.write_posts_xml(posts.select("Id").limit(3), f"{base}/Users.xml", root_tag="users")
    return base


@register("xml_roundtrip", with_views(f"""
SELECT {', '.join(XML_COLS)} FROM posts_docs
WHERE PostTypeId = '1'
  AND NOT coalesce({Q.lenient_date('CreationDate')} < DATE '{INGEST_RANGE[0]}'
               OR {Q.lenient_date('CreationDate')} > DATE '{INGEST_RANGE[1]}', false)""", "posts_docs"))
def q_xml_roundtrip(spark, sf):
    """S1/S2/S3 + P1/P2: read a post dump (picked by name) as string columns, keep
    questions in the date range (bad dates kept)."""
    base = _dump(spark, sf)
    path = IO.pick_posts_file(spark, f"{base}/*")
    df = IO.read_posts_xml(spark, path)
    df = O.filter_dates(O.filter_questions(df), *INGEST_RANGE)
    return df.select(*XML_COLS)


@register("xml_inferred", with_views(f"""
SELECT {', '.join(XML_COLS)} FROM posts_docs""", "posts_docs"))
def q_xml_inferred(spark, sf):
    """S3: schema inferred from the dump (union of attributes, all strings)."""
    base = _dump(spark, sf)
    df = IO.read_posts_xml(spark, f"{base}/Posts.xml", schema=None)
    return df.select(*XML_COLS)


@register("panel_export", panel_sql(f"""
SELECT yearweek, forum, "group", question_count, week_start, round(log_question_count, 6) AS log_question_count,
       CAST(week_start > DATE '{ORDERS_EVENT_DATE}' AS INTEGER) AS treatment,
       CAST(week_start > DATE '{ORDERS_EVENT_DATE}' AND forum = '{ORDERS_TREATED_FORUM}' AS INTEGER)
           AS treatment_synthdid
FROM panel"""))
def q_panel_export(spark, sf):
    """The regression panel written with the panel sink and read back."""
    from ..operators import panel as P
    path = scratch_path(spark, "panel-export")
    p = P.treatment_flags(orders_panel(spark, sf), ORDERS_EVENT_DATE, ORDERS_TREATED_FORUM)
    IO.write_panel(rounded(p.select("yearweek", "forum", "group", "question_count", "week_start",
                                    "log_question_count", "treatment", "treatment_synthdid")), path)
    return spark.read.parquet(path)


@register("split_write", processed_sql(
    "SELECT Id, tag_count, code_length, body_length, title_length, processed_text FROM p"))
def q_split_write(spark, sf):
    """Processed posts written as zstd Parquet split every 100 rows, read back."""
    path = scratch_path(spark, "split-write")
    from .posts import processed
    IO.write_parquet(processed(spark, sf).select("Id", "tag_count", "code_length", "body_length",
                                                 "title_length", "processed_text"),
                     path, codec="zstd", max_rows=100)
    return spark.read.parquet(path)


@register("merge_schema", with_views("""
SELECT Id, Score, NULL::VARCHAR AS ViewCount FROM posts_docs WHERE forum = 'Mathematics'
UNION ALL
SELECT Id, Score, ViewCount FROM posts_docs WHERE forum <> 'Mathematics'""", "posts_docs"))
def q_merge_schema(spark, sf):
    """Part files with differing columns read as one table (missing -> null)."""
    path = scratch_path(spark, "merge-schema")
    posts = docs_posts(spark, sf)
    IO.write_parquet(posts.where(F.col("forum") == "Mathematics").select("Id", "Score"),
                     f"{path}/part=a", codec="zstd")
    IO.write_parquet(posts.where(F.col("forum") != "Mathematics").select("Id", "Score", "ViewCount"),
                     f"{path}/part=b", codec="zstd")
    return IO.read_parquet_merged(spark, path).select("Id", "Score", "ViewCount")


@register("resumable_ingest", processed_sql(
    "SELECT Id, tag_count, code_length, body_length, title_length, processed_text FROM p"))
def q_resumable_ingest(spark, sf):
    """Stream post files through the processing plan with a checkpoint; the
    second run finds nothing new, so every post is processed exactly once."""
    src = scratch_path(spark, "ingest-src")
    dst = scratch_path(spark, "ingest-dst")
    ckpt = scratch_path(spark, "ingest-ckpt")
    posts = O.filter_questions(docs_posts(spark, sf))
    # a file for each split of the input, so no task's share grows with it; half of them at a time
    files = max(4, posts.rdd.getNumPartitions())
    IO.write_parquet(posts.repartition(files), src)
    schema = spark.read.parquet(src).schema

    def plan(df):
        return O.process_posts(df).select("Id", "tag_count", "code_length", "body_length",
                                          "title_length", "processed_text")

    resumable_ingest(spark, src, dst, ckpt, schema, plan, max_files_per_trigger=files // 2)
    resumable_ingest(spark, src, dst, ckpt, schema, plan, max_files_per_trigger=files // 2)
    return spark.read.parquet(dst)


@register("forum_ingest", with_views("SELECT Id, Score, Body, forum FROM posts_docs", "posts_docs"))
def q_forum_ingest(spark, sf):
    """One dump per forum, read into one table with a forum column, written
    partitioned by forum and read back."""
    base = scratch_path(spark, "forums")
    posts = docs_posts(spark, sf).select(*XML_COLS, "forum")
    paths = {}
    for i, name in enumerate(("Stack Overflow", "Mathematics")):
        paths[name] = f"{base}/{i}/Posts.xml"
        IO.write_posts_xml(posts.where(F.col("forum") == name).drop("forum"), paths[name])
    IO.write_parquet(IO.read_forums(spark, paths, "xml").select("Id", "Score", "Body", "forum"), f"{base}/table", partition_by=("forum",))
    return spark.read.parquet(f"{base}/table").select("Id", "Score", "Body", "forum")


@register("merge_skip_corrupt", with_views("SELECT Id, Score FROM posts_docs WHERE forum = 'Mathematics'", "posts_docs"))
def q_merge_skip_corrupt(spark, sf):
    """A part that is no Parquet file is skipped on request, the others are read."""
    path = scratch_path(spark, "corrupt")
    posts = docs_posts(spark, sf)
    IO.write_parquet(posts.where(F.col("forum") == "Mathematics").select("Id", "Score"), f"{path}/part=a")
    # the other forum's rows as text under a Parquet name: unreadable parts
    (posts.where(F.col("forum") != "Mathematics").select(F.concat_ws(",", "Id", "Score").alias("value"))
     .write.format("text").save(f"{path}/part=b"))
    return IO.read_parquet_merged(spark, path, ignore_corrupt=True, schema=posts.select("Id", "Score").schema).select("Id", "Score")


@register("merge_rejects", with_views("SELECT DISTINCT forum FROM posts_docs WHERE forum <> 'Mathematics'", "posts_docs"))
def q_merge_rejects(spark, sf):
    """Which parts a read that skips unreadable ones has left out."""
    path = scratch_path(spark, "rejects")
    posts = docs_posts(spark, sf)
    IO.write_parquet(posts.where(F.col("forum") == "Mathematics").select("Id", "Score", F.hex("forum").alias("part")), path, partition_by=("part",))
    (posts.where(F.col("forum") != "Mathematics").select(F.concat_ws(",", "Id", "Score").alias("value"), F.hex("forum").alias("part"))
     .write.mode("append").partitionBy("part").format("text").save(path))
    read = IO.read_parquet_merged(spark, path, ignore_corrupt=True, schema=posts.select("Id", "Score").schema)
    lost = IO.unreadable_parts(spark, path, read)
    return lost.select(F.decode(F.unhex(F.regexp_extract("path", "part=([0-9A-F]+)/", 1)), "UTF-8").alias("forum")).distinct()


def _damaged_dump(spark, sf):
    """A dump in which every fifth record has an attribute without quotes."""
    path = scratch_path(spark, "damaged") + "/Posts.xml"
    posts = docs_posts(spark, sf).select("Id", "Score", "Title")
    IO.write_posts_xml(posts, path + ".whole")
    lines = spark.read.text(path + ".whole")
    hurt = F.col("value").rlike(' Id="[0-9]*[05]"')
    lines.select(F.when(hurt, F.regexp_replace("value", ' Id="([0-9]+)"', " Id=$1")).otherwise(F.col("value")).alias("value")).write.text(path)
    return path


_DAMAGED = with_views("SELECT Id, Score, Title, Id LIKE '%0' OR Id LIKE '%5' AS hurt FROM posts_docs", "posts_docs")


@register("xml_damaged_kept", f"SELECT Id, Score, Title FROM ({_DAMAGED}) WHERE NOT hurt")
def q_xml_damaged_kept(spark, sf):
    """The good rows of a dump with damaged records."""
    good, _ = IO.read_posts_xml_checked(spark, _damaged_dump(spark, sf))
    return good.select("Id", "Score", "Title")


@register("xml_damaged_rejects", f"SELECT Id FROM ({_DAMAGED}) WHERE hurt")
def q_xml_damaged_rejects(spark, sf):
    """The damaged records of the same dump, by the id in their text."""
    _, rejects = IO.read_posts_xml_checked(spark, _damaged_dump(spark, sf))
    return rejects.select(F.regexp_extract("record", "Id=([0-9]+)", 1).alias("Id"))
