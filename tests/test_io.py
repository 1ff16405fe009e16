"""Sources, sinks and restartable ingest (SURVEY §5 (e))."""

import tempfile

from pyspark.sql import functions as F

from forumshift.sources import posts_io as IO
from forumshift.streaming.resumable import resumable_ingest


def _posts(spark, ids):
    return spark.createDataFrame([(str(i), "1", f"2022-01-0{1 + i % 9}T10:00:00.000", "|python|")
                                  for i in ids], "Id string, PostTypeId string, CreationDate string, Tags string")


def test_resumable_ingest_processes_each_file_once(spark):
    base = tempfile.mkdtemp(prefix="fs-test-")
    src, dst, ckpt = f"{base}/src", f"{base}/dst", f"{base}/ckpt"
    _posts(spark, range(0, 30)).repartition(3).write.parquet(src)
    schema = spark.read.parquet(src).schema

    def plan(df):
        return df.withColumn("n_tags", F.size(F.split("Tags", "[|]")))

    resumable_ingest(spark, src, dst, ckpt, schema, plan, max_files_per_trigger=1)
    assert spark.read.parquet(dst).count() == 30
    resumable_ingest(spark, src, dst, ckpt, schema, plan)          # nothing new
    assert spark.read.parquet(dst).count() == 30
    _posts(spark, range(30, 35)).coalesce(1).write.mode("append").parquet(src)
    resumable_ingest(spark, src, dst, ckpt, schema, plan)          # only the new file
    out = spark.read.parquet(dst)
    assert out.count() == 35 and out.select("Id").distinct().count() == 35


def test_xml_pick_and_read(spark):
    base = tempfile.mkdtemp(prefix="fs-xml-")
    IO.write_posts_xml(_posts(spark, range(5)), f"{base}/Posts.xml")
    IO.write_posts_xml(_posts(spark, range(2)).select("Id"), f"{base}/Users.xml", root_tag="users")
    path = IO.pick_posts_file(spark, f"{base}/*")
    assert "Posts.xml" in path
    df = IO.read_posts_xml(spark, path)
    assert df.count() == 5
    assert df.where(F.col("Tags") == "|python|").count() == 5
    assert dict(df.dtypes)["Id"] == "string"


def test_split_write_max_rows(spark):
    base = tempfile.mkdtemp(prefix="fs-split-")
    IO.write_parquet(_posts(spark, range(250)).coalesce(1), f"{base}/out", codec="zstd", max_rows=100)
    files = [r[0] for r in spark.read.format("binaryFile").load(f"{base}/out/*.parquet").select("path").collect()]
    assert len(files) == 3
    assert spark.read.parquet(f"{base}/out").count() == 250


def test_ingest_source_has_a_file_for_each_split_of_the_input(spark, tmp_path, monkeypatch):
    """No task reads a fixed share of an input that grows; every post comes out once."""
    from forumshift.plans import io as plan
    rows = [(i, f"word{i % 7} text of post {i}", "en", "web", 20) for i in range(300)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(9).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1,)], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    written, real = [], plan.IO.write_parquet
    monkeypatch.setattr(plan.IO, "write_parquet", lambda df, *a, **k: (written.append(df.rdd.getNumPartitions()), real(df, *a, **k))[1])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1024")
    try:
        out = plan.q_resumable_ingest(spark, str(tmp_path))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert written[0] >= 9
    assert sorted(int(r.Id) for r in out.select("Id").collect()) == [i for i in range(300) if i % 11]


def test_lemma_join_does_not_sort_the_tokens(spark):
    from forumshift.operators import posts as O
    df = spark.createDataFrame([("1", "cats and dogs"), ("2", None), ("3", "dogs dogs x")], "Id string, t string")
    lemmas = spark.createDataFrame([("cats", "cat"), ("dogs", "dog")], "token string, lemma string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = O.apply_lemmas(df, "Id", "t", lemmas)
        got = {r.Id: r.lemmatized_text for r in out.collect()}
        plan = out._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == {"1": "cat and dog", "2": None, "3": "dog dog x"}
    assert "SortMergeJoin [token" not in plan and "ShuffledHashJoin [token" in plan
