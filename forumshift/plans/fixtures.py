"""Views that give the driver tables the shapes the analysis expects.

The SQL text is shared verbatim by the Spark queries and the DuckDB oracle,
so both engines start from identical inputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")

# Fixed values of the orders analogue (see FIXTURES.md): treated forum, event date, trim bounds.
ORDERS_TREATED_FORUM = "1-URGENT"
ORDERS_EVENT_DATE = "1998-06-30"
ORDERS_TRIM = ("1995-01-01", "2001-07-23")

# Fixed values of the document analogue: event date of the study.
DOCS_EVENT_DATE = "2022-11-30"
STUDY_TRIM = ("2021-01-01", "2024-03-04")

POSTS_ORDERS_SQL = (
    "select cast(o_orderkey as string) as Id, o_orderdate as CreationDate, "
    "cast(o_orderdate as date) as post_date, o_totalprice as Score, "
    "o_orderpriority as forum, case when o_orderpriority = '1-URGENT' "
    "then concat(o_orderpriority, '/', o_orderstatus) else o_orderpriority end as grp "
    "from orders"
)

POSTS_DOCS_SQL = (
    "select cast(doc_id as string) as Id, "
    "case when doc_id % 11 = 0 then '2' else '1' end as PostTypeId, "
    "case when doc_id % 97 = 5 then 'not a date' when doc_id % 101 = 7 then null "
    "else concat(cast(date '2021-01-01' + cast(doc_id * 7919 % 1160 as int) as string), 'T', "
    "lpad(cast(doc_id % 24 as string), 2, '0'), ':15:30.250') end as CreationDate, "
    "cast(doc_id * 13 % 50 as string) as Score, cast(n_chars as string) as ViewCount, "
    "case when doc_id % 89 = 3 then null else substr(text, 1, 20 + cast(doc_id % 60 as int)) end as Title, "
    "case when doc_id % 83 = 2 then '' else concat('<p>', text, '</p><pre><code class=\"x\">', "
    "substr(text, 1, cast(doc_id * 37 % 300 as int)), '</code></pre><p>$', "
    "substr(text, 1, cast(doc_id * 17 % 40 as int)), '$</p>') end as Body, "
    "concat('|', lang, '|', source, case doc_id % 5 when 0 then '|python|' when 1 then '|r|php|' "
    "when 2 then '|javascript|' when 3 then '|php|python|' else '|' end) as Tags, "
    "cast(doc_id % 4 as string) as AnswerCount, cast(doc_id % 7 as string) as CommentCount, "
    "case doc_id % 5 when 4 then 'Mathematics' else 'Stack Overflow' end as forum, text "
    "from documents"
)

CORPUS_DOCS_SQL = (
    "select doc_id, date '2021-01-01' + cast(doc_id * 7919 % 1160 as int) as post_date, "
    "case when date '2021-01-01' + cast(doc_id * 7919 % 1160 as int) < date '2022-11-30' "
    "then 1 else 0 end as pre, text as processed_text from documents"
)

VIEWS = {
    "posts_orders": POSTS_ORDERS_SQL,
    "posts_docs": POSTS_DOCS_SQL,
    "corpus_docs": CORPUS_DOCS_SQL,
}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def register_tables(spark: SparkSession, sf_dir: str, names=TABLES) -> None:
    """Register driver tables as temp views (lazy scans, nothing is read)."""
    for name in names:
        read_table(spark, sf_dir, name).createOrReplaceTempView(name)


def fixture(spark: SparkSession, sf_dir: str, view: str) -> DataFrame:
    """One of the analogue views over the driver tables."""
    register_tables(spark, sf_dir, ("orders", "documents"))
    return spark.sql(VIEWS[view])


def with_views(sql: str, *views: str) -> str:
    """Prefix an oracle query with the fixture views it reads."""
    ctes = ",\n".join(f"{v} AS ({VIEWS[v]})" for v in views)
    return f"WITH {ctes}\n{sql}"
