"""Sources and sinks (S1-S13): XML post dumps, Parquet with codecs, split files,
schema-merging reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Attributes of a post row in the dumps (all read as strings).
POST_COLUMNS = ("Id", "PostTypeId", "AcceptedAnswerId", "ParentId", "CreationDate", "Score",
                "ViewCount", "Body", "OwnerUserId", "LastActivityDate", "Title", "Tags",
                "AnswerCount", "CommentCount", "ContentLicense")
POSTS_SCHEMA = T.StructType([T.StructField(c, T.StringType(), True) for c in POST_COLUMNS])


def pick_posts_file(spark: SparkSession, path: str, suffix: str = "Posts.xml") -> str:
    """The file whose name ends in ``Posts.xml``, else the first file; error if there is
    none or more than one dump (read several with ``read_forums``).

    Only the directory listing is read (``binaryFile`` with a path filter returns
    paths lazily; no content column is selected)."""
    listing = spark.read.format("binaryFile").load(path).select("path")
    # the member may be a file or a folder of part files (as Spark writes it)
    pattern = "^(.*?/[^/]*" + suffix.replace(".", "[.]") + ")(/|$)"
    member = F.regexp_extract(F.col("path"), pattern, 1)
    hit = listing.select(member.alias("m")).where(F.col("m") != "").distinct().orderBy("m").limit(2).collect()
    if len(hit) > 1:
        raise ValueError(f"several dumps under {path} ({hit[0][0]}, {hit[1][0]}, ...): name one, or use read_forums")
    if hit:
        return hit[0][0]
    first = listing.orderBy("path").limit(1).collect()
    if not first:
        raise FileNotFoundError(f"no files under {path}")
    return first[0][0]


def read_posts_xml(spark: SparkSession, path: str, record_tag: str = "row",
                   schema: T.StructType | None = POSTS_SCHEMA) -> DataFrame:
    """``<row a="…"/>`` records, every attribute a string column.

    ``schema=None`` infers the union of attributes (strings only).  Damaged
    records become nulls (PERMISSIVE), as the tolerant parser did;
    ``read_posts_xml_checked`` tells them apart.  Plain and ``.bz2`` input is split across tasks
    by the XML source, a ``.gz`` file is one task.
    """
    r = (spark.read.format("xml").option("rowTag", record_tag).option("attributePrefix", "")
         .option("mode", "PERMISSIVE").option("inferSchema", "false").option("ignoreSurroundingSpaces", "false"))
    if schema is not None:
        r = r.schema(schema)
    return r.load(path)


def read_posts_xml_checked(spark: SparkSession, path: str, record_tag: str = "row",
                           schema: T.StructType = POSTS_SCHEMA) -> tuple[DataFrame, DataFrame]:
    """The readable records, and the rejects ``(path, record)``: the text of each damaged one
    with the file that holds it.  The dumps hold one record a line, so damage ends with its line
    (the XML source gives up on the rest of a file).  Both are narrow reads of the dump."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.trim("value").alias("record")).where(
        F.col("record").startswith(f"<{record_tag}"))
    fields = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType(), True)])
    options = {"rowTag": record_tag, "attributePrefix": "", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record",
               "ignoreSurroundingSpaces": "false"}
    parsed = lines.select("path", "record", F.from_xml("record", fields.simpleString(), options).alias("r"))
    bad = F.col("r").isNull() | F.col("r._corrupt_record").isNotNull()
    return parsed.where(~bad).select(*[F.col(f"r.`{c}`") for c in schema.names]), parsed.where(bad).select("path", "record")


def unreadable_parts(spark: SparkSession, path: str, read: DataFrame) -> DataFrame:
    """``(path, size)`` of the files under ``path`` that gave no row to ``read``, a read of the same
    folder that skips corrupt files: the listing less the files that rows come from."""
    name = F.regexp_extract("path", "([^/]*)$", 1)
    listing = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
               .select("path", F.col("length").alias("size")).where(~name.rlike("^[._]")).withColumn("name", name))
    used = read.select(F.col("_metadata.file_name").alias("name")).distinct()
    return listing.join(used, "name", "left_anti").select("path", "size")


def write_posts_xml(df: DataFrame, path: str, record_tag: str = "row", root_tag: str = "posts") -> None:
    """Write rows as ``<row a="..."/>`` lines (used to build test dumps): attribute values
    with markup, quotes and line breaks as character references, nulls left out, each part a
    document of its own."""
    def attribute(c):
        v = F.col(c).cast("string")
        for char, ref in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\t", "&#9;"), ("\n", "&#10;"), ("\r", "&#13;")):
            v = F.replace(v, F.lit(char), F.lit(ref))
        return F.concat(F.lit(f' {c}="'), v, F.lit('"'))

    row = F.concat(F.lit(f"  <{record_tag}"), F.concat_ws("", *[attribute(c) for c in df.columns]), F.lit(" />"))

    def framed(batches):
        import pyarrow as pa

        yield pa.RecordBatch.from_pydict({"value": [f"<{root_tag}>"]})
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0)], names=["value"])
        yield pa.RecordBatch.from_pydict({"value": [f"</{root_tag}>"]})

    df.select(row.alias("value")).mapInArrow(framed, "value string").write.mode("overwrite").text(path)


def write_parquet(df: DataFrame, path: str, codec: str = "zstd", max_rows: int | None = None,
                  partition_by: tuple[str, ...] = (), mode: str = "overwrite") -> None:
    """Parquet with a codec, optionally split every ``max_rows`` rows
    and partitioned by columns (one folder per forum)."""
    w = df.write.mode(mode).option("compression", codec)
    if max_rows:
        w = w.option("maxRecordsPerFile", int(max_rows))
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def read_parquet_merged(spark: SparkSession, path: str, ignore_corrupt: bool = False,
                        schema: T.StructType | None = None) -> DataFrame:
    """Read part files of differing schema (union of columns).  ``ignore_corrupt`` skips
    unreadable parts; with a given ``schema`` no footer is read before the scan."""
    r = spark.read.option("ignoreCorruptFiles", "true" if ignore_corrupt else "false").option("pathGlobFilter", "*")
    r = r.schema(schema) if schema is not None else r.option("mergeSchema", "true")
    return r.parquet(path)


def write_panel(df: DataFrame, path: str, csv: bool = False) -> None:
    """The regression-ready panel as Parquet (and optionally CSV with header)."""
    write_parquet(df, path, codec="snappy")
    if csv:
        df.write.mode("overwrite").option("header", "true").csv(path + "_csv")


def read_forums(spark: SparkSession, paths: dict[str, str], fmt: str = "parquet") -> DataFrame:
    """One dataset per forum, read as one table with a ``forum`` column (union by name,
    missing columns null).  ``fmt="xml"`` reads post dumps."""
    frames = [(read_posts_xml(spark, p) if fmt == "xml" else spark.read.format(fmt).load(p)).withColumn("forum", F.lit(name))
              for name, p in paths.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
