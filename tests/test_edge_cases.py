"""Hand-made edge cases (FIXTURES.md §4) on inline rows."""

import math
from datetime import date, timedelta

from pyspark.sql import functions as F

from forumshift.functions import text as X
from forumshift.operators import complexity as C
from forumshift.operators import did as D
from forumshift.operators import panel as P
from forumshift.operators import posts as O
from forumshift.operators import terms as T


def test_tag_parsing(spark):
    df = spark.createDataFrame([("1", "||a||"), ("2", ""), ("3", None), ("4", "|php|python|"),
                                ("5", "|rust|")], "Id string, Tags string")
    out = {r.Id: r for r in O.language_group(O.parse_tags(df)).collect()}
    assert out["1"].tag_list == ["", "a", ""]
    assert out["2"].tag_list == [""] and out["2"].tag_count == 1
    assert out["3"].tag_list is None and out["3"].tag_count is None
    assert out["4"].group == "Python"
    assert out["5"].group == "JavaScript"


def test_tag_filter_literal_inside_word(spark):
    df = spark.createDataFrame([("1", "|rust|"), ("2", "|r|")], "Id string, Tags string")
    assert [r.Id for r in O.filter_tags(df).collect()] == ["2"]


def test_code_blocks_and_text(spark):
    df = spark.createDataFrame([("<p>x &amp; y</p><code>a</code>x<code>b<b>c</b></code>",)], "Body string")
    r = O.post_lengths(O.split_html(df).withColumn("Title", F.lit("t"))).first()
    assert r.code_blocks == ["a", "bc"]
    assert r.code_length == 3
    assert r.clean_text == "x & y x"


def test_normalise_edge_cases(spark):
    df = spark.createDataFrame([("the of and",), ("   ",), ("r x 7",), (None,), ("Hello, World!",)],
                               "clean_text string")
    got = [r.processed_text for r in O.normalise_text(df).collect()]
    assert got == ["", None, "r x", None, "hello world"]


def test_date_filter_keeps_bad_dates(spark):
    df = spark.createDataFrame([("2021-01-01T00:00:00.000",), ("2024-12-31",), ("not a date",),
                                (None,), ("2020-12-31T23:59:59.999",), ("2025-01-01Z",)],
                               "CreationDate string")
    kept = [r.CreationDate for r in O.filter_dates(df, "2021-01-01", "2024-12-31").collect()]
    assert kept == ["2021-01-01T00:00:00.000", "2024-12-31", "not a date", None]


def _calendar_posts(spark, groups):
    days = []
    d = date(2021, 1, 1)
    while d <= date(2024, 3, 31):
        days.append(d)
        d += timedelta(days=1)
    rows = [(g, str(day) + "T12:00:00.000") for g in groups for day in days]
    return spark.createDataFrame(rows, "group string, CreationDate string").withColumns({
        "forum": F.col("group"), "CreationDate": F.col("CreationDate").cast("timestamp_ntz")})


def test_calendar_invariant_mixed_and_iso(spark):
    posts = _calendar_posts(spark, ["a", "b", "c", "d", "e"])
    trim = ("2021-01-01", "2024-03-04")
    mixed = P.weekly_panel(posts, keys=("forum", "group"), trim=trim)
    assert mixed.count() == 830
    one = mixed.where(F.col("group") == "a")
    assert one.count() == 166
    assert one.where(F.col("week_start") <= F.lit("2022-11-30").cast("date")).count() == 101
    # 1-2 Jan 2022 carry key 202252 and start the cell on 2022-01-01
    jan = one.where(F.col("yearweek") == 202252).first()
    assert jan.week_start == date(2022, 1, 1)
    iso = P.weekly_panel(posts, keys=("forum", "group"), week_key="iso", trim=trim).where(
        F.col("group") == "a")
    assert iso.count() == 166
    assert iso.where(F.col("week_start") <= F.lit("2022-11-30").cast("date")).count() == 100


def test_zscore_constant_metric_is_null(spark):
    df = spark.createDataFrame([(1, 5), (2, 5), (3, 5)], "id int, x int")
    z = C.zscore(df, {"x": "zx"}).collect()
    assert all(r.zx is None for r in z)


def test_zscore_mean_zero_std_one(spark):
    df = spark.range(1, 101).withColumn("x", F.col("id") * F.col("id"))
    r = C.zscore(df, {"x": "zx"}).agg(F.avg("zx").alias("m"), F.stddev_samp("zx").alias("s")).first()
    assert abs(r.m) < 1e-12 and abs(r.s - 1) < 1e-12


def test_tfidf_term_absent_before_and_one_token(spark):
    rows = [(i, 1, "alpha beta") for i in range(12)] + [(100 + i, 0, "alpha gamma") for i in range(12)]
    rows += [(200, 1, "alpha")]
    df = spark.createDataFrame(rows, "doc_id long, pre int, processed_text string")
    res = T.tfidf(df, min_df=10, max_df=1.0)
    shift = {r.term: r for r in T.term_shift(res).collect()}
    assert shift["gamma"].pre_mean_tfidf == 0 and shift["gamma"].tfidf_ratio == 1000.0
    assert shift["gamma"].tfidf_percent_change is None
    # L2 norm of every document is 1
    norms = res.long.groupBy("doc_id").agg(F.sum(F.col("tfidf") ** 2).alias("n2")).collect()
    assert all(abs(r.n2 - 1) < 1e-12 for r in norms)
    one = res.long.where(F.col("doc_id") == 200).collect()
    assert [r.term for r in one] == ["alpha"]


def test_did_planted_additive_effect(spark):
    rows = []
    for u in range(5):
        for t in range(40):
            y = 0.3 * u + 0.05 * t + (-0.5 if (u == 0 and t >= 25) else 0.0)
            rows.append((u, t, y, 1.0 if (u == 0 and t >= 25) else 0.0))
    df = spark.createDataFrame(rows, "u int, t int, y double, d double")
    r = D.twfe_did(df, "u", "t", "y", "d").first()
    assert abs(r.att + 0.5) < 1e-9
    assert math.isclose(r.pct_effect, math.expm1(-0.5) * 100)


def test_parser_mode_matches_regex_on_clean_markup(spark):
    df = spark.createDataFrame([("<p>x &amp; y</p><code>a</code>x<code>b<b>c</b></code>",),
                                ("<div><script>var a='<p>';</script><!-- c --><p> hi </p></div>",)],
                               "Body string")
    rx = [(r.clean_text, r.code_blocks) for r in O.split_html(df).collect()]
    ps = [(r.clean_text, r.code_blocks) for r in O.split_html(df, mode="parser").collect()]
    assert rx == ps


def test_porter_published_examples():
    from porter_reference import porter_stem
    cases = {"caresses": "caress", "ponies": "poni", "ties": "ti", "caress": "caress", "cats": "cat",
             "feed": "feed", "agreed": "agre", "plastered": "plaster", "bled": "bled",
             "motoring": "motor", "sing": "sing", "conflated": "conflat", "troubled": "troubl",
             "sized": "size", "hopping": "hop", "tanned": "tan", "falling": "fall",
             "hissing": "hiss", "fizzed": "fizz", "failing": "fail", "filing": "file",
             "happy": "happi", "sky": "sky", "relational": "relat", "generalization": "gener",
             "adjustment": "adjust", "replacement": "replac", "adoption": "adopt",
             "effective": "effect", "controll": "control", "roll": "roll", "hopeful": "hope",
             "goodness": "good", "electrical": "electr"}
    bad = {w: (porter_stem(w), s) for w, s in cases.items() if porter_stem(w) != s}
    assert not bad, bad


def test_tfidf_checkpoint_equals_persist(spark):
    rows = [(i, i % 2, f"alpha beta gamma w{i % 3} delta") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, pre int, processed_text string")
    a = T.tfidf(df, min_df=2, max_df=1.0).long.orderBy("doc_id", "term").collect()
    b = T.tfidf(df, min_df=2, max_df=1.0, materialize="checkpoint").long.orderBy("doc_id", "term").collect()
    assert [(r.doc_id, r.term, round(r.tfidf, 12)) for r in a] == [(r.doc_id, r.term, round(r.tfidf, 12)) for r in b]


def test_character_references(spark):
    """Expected texts written out, not taken from the table the code uses."""
    from forumshift.functions import text as X
    cases = {
        "caf&eacute; &#8217;x&#8217; a&ndash;b": "caf\u00e9 \u2019x\u2019 a\u2013b",
        "&amp;lt; &lt;b&gt; &quot;q&quot; &#39;": "&lt; <b> \"q\" '",
        "&copy;&middot;&euro;&hellip;&#x1F600;": "\u00a9\u00b7\u20ac\u2026\U0001f600",
        "&nosuch; &#0; &#xD800; &#9999999; & &amp": "&nosuch; &#0; &#xD800; &#9999999; & &amp",
        "plain": "plain", "&amp;&amp;": "&&", "": "",
    }
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "t string")
    got = {r.t: r.u for r in df.select("t", X.unescape_entities("t").alias("u")).collect()}
    assert got == cases | {None: None}


def test_both_split_modes_agree_on_pages(spark):
    from forumshift.operators import posts as O
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "html")
    a = {r.page_id: r.clean_text for r in O.split_html(pages, "html").collect()}
    b = {r.page_id: r.clean_text for r in O.split_html(pages, "html", mode="parser").collect()}
    same = sum(" ".join(a[k].split()) == " ".join(b[k].split()) for k in a)
    assert same >= 0.95 * len(a)


def test_cluster_value_of_shuffle_partitions_stays(spark):
    from forumshift.session import get_spark, is_local
    assert is_local("local") and is_local("local[8]")
    assert not is_local("local-cluster[2,1,1024]") and not is_local("yarn") and not is_local(None)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    assert get_spark().conf.get("spark.sql.shuffle.partitions") == before


def test_several_dumps_are_an_error(spark):
    import pytest

    from forumshift.session import scratch_path
    from forumshift.sources import posts_io as IO
    base = scratch_path(spark, "dumps")
    for name in ("a", "b"):
        IO.write_posts_xml(spark.createDataFrame([("1", "x\n<y>")], "Id string, Body string"), f"{base}/{name}/Posts.xml")
    with pytest.raises(ValueError, match="several dumps"):
        IO.pick_posts_file(spark, f"{base}/*/*")
    rows = IO.read_forums(spark, {n: f"{base}/{n}/Posts.xml" for n in ("a", "b")}, "xml").select("forum", "Id", "Body").collect()
    assert sorted(map(tuple, rows)) == [("a", "1", "x\n<y>"), ("b", "1", "x\n<y>")]


def test_committed_batches_are_counted(spark):
    from forumshift.session import scratch_path
    from forumshift.streaming.resumable import resumable_ingest
    src, dst, ckpt = (scratch_path(spark, n) for n in ("src", "dst", "ckpt"))
    spark.range(40).repartition(5).write.parquet(src)
    schema = spark.read.parquet(src).schema
    assert resumable_ingest(spark, src, dst, ckpt, schema, lambda d: d, max_files_per_trigger=2) == 3
    assert resumable_ingest(spark, src, dst, ckpt, schema, lambda d: d, max_files_per_trigger=2) in (0, 3)
    assert spark.read.parquet(dst).count() == 40


def test_stems_equal_the_word_by_word_algorithm(spark):
    import random

    from porter_reference import porter_stem as reference

    from forumshift.functions.porter import porter_stem
    rng = random.Random(7)
    ends = ["", "s", "ies", "sses", "ed", "eed", "ing", "ational", "izer", "iveness", "ement", "ion", "tion", "e", "ll", "y", "yed", "ying", "ate", "icate"]
    words = {"".join(rng.choice("abcdeilnorstuvyz") for _ in range(rng.randrange(1, 7))) + rng.choice(ends) for _ in range(3000)}
    words |= {"caresses", "ponies", "ties", "agreed", "plastered", "motoring", "hopping", "falling", "hissing", "filing", "happy", "sky",
              "relational", "digitizer", "h1n1s", "r2", "caf\u00e9s", "yyy", "cyyed", "a", "oed"}
    got = {r.w: r.s for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", porter_stem("w").alias("s")).collect()}
    assert {w: s for w, s in got.items() if s != reference(w)} == {}


def test_nested_split_equals_a_page_by_page_parser(spark):
    from html_reference import split_one

    from forumshift.functions import text as X
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("html").collect()]
    pages += ["<p>a<code>x <b>y</b> <code>in</code> z</code>b</p>", "t <code>open &lt;c&gt;", "</code>x<code></code>", "a < b &amp; c <i>d</i>",
              "<script>var a='<p>no</p>';</script>yes<style>p{}</style><!-- <b>no</b> -->end", "", "plain", "<CODE class='x'>U</CODE>v", None]
    got = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, h string").select("i", X.split_nested("h").alias("s")).collect()
    for r in got:
        want = split_one(pages[r.i])
        assert (None if r.s is None else {"text": r.s.text, "code": list(r.s.code)}) == want, pages[r.i]


def test_correlations_drop_rows_with_nan(spark):
    from forumshift.operators import significance as S
    rows = [(f"2022-01-{d:02d}", float(d), float(2 * d)) for d in range(1, 10)] + [("2022-01-10", float("nan"), 1.0), ("2022-01-11", None, 5.0)]
    df = spark.createDataFrame(rows, "d string, a double, b double").selectExpr("cast(d as date) as d", "a", "b")
    got = {r.period: r["corr"] for r in S.corr_prepost(df, ["a", "b"], ["a", "b"], "d", "2022-12-31").collect()}
    assert abs(got["pre"] - 1.0) < 1e-12 and got["post"] is None


def test_pretrend_reference_defaults_to_the_first_forum(spark):
    from forumshift.operators import significance as S
    rows = [(f, f"2022-01-{d:02d}", float(d * k + d % 3)) for k, f in enumerate(("x", "y", "z")) for d in range(1, 15)]
    df = spark.createDataFrame(rows, "forum string, week_start string, y double").selectExpr("forum", "cast(week_start as date) as week_start", "y")
    got = {r.forum: r.interaction for r in S.pretrend_slopes(df, ["y"]).collect()}
    assert set(got) == {"y", "z"} and abs(got["y"] - 1) < 0.05 and abs(got["z"] - 2) < 0.05
