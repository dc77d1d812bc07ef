import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from pagegraph.operators import changes, members, ranking
from pagegraph.operators.changes import activity_floor, edited_window_ok, use_precheck
from pagegraph.streaming import feed


def test_top_k_with_a_hot_key_matches_brute_force(spark):
    rng = random.Random(7)
    data = [("hot" if rng.random() < 0.5 else "k{}".format(rng.randrange(20)), rng.randrange(300), i) for i in range(3000)]
    df = spark.createDataFrame(data, "k string, t int, i int")
    for k in (0, 1, 5, 400):
        got = ranking.top_k_per_key(df, ["k"], [F.desc("t"), F.asc("i")], k, spread=8)
        expected = []
        for key in {d[0] for d in data}:
            expected += sorted((d for d in data if d[0] == key), key=lambda d: (-d[1], d[2]))[:k]
        assert sorted(map(tuple, got.collect())) == sorted(expected)


def test_first_per_key(spark):
    df = spark.createDataFrame([("a", 2, None), ("a", 1, "x"), ("b", 5, "y")], "k string, n int, v string")
    assert sorted(map(tuple, ranking.first_per_key(df, ["k"], [F.col("n")]).collect())) == [("a", 1, "x"), ("b", 5, "y")]
    newest = ranking.first_per_key(df, ["k"], [F.col("n")], newest=True)
    assert sorted(map(str, newest.collect())) == ["Row(k='a', n=2, v=None)", "Row(k='b', n=5, v='y')"]


def test_windows():
    now = datetime(2026, 4, 1)
    assert activity_floor(None, now) == "20260131000000"
    assert activity_floor("20260301000000", now) == "20260301000000"
    assert activity_floor("20250101000000", now) == "20260131000000"
    assert edited_window_ok("20260200000000", now) and not edited_window_ok("20260100000000", now)
    assert use_precheck(False, None, now)
    assert use_precheck(True, "20260315000000", now) and not use_precheck(True, "20260201000000", now)
    assert not use_precheck(True, None, now)


def test_prefixes():
    assert members.clean_prefixes(["Wp/sms..., Wp/a b", ":Wp/sms"]) == ["Wp/a_b", "Wp/sms"]
    with pytest.raises(ValueError):
        members.clean_prefixes(["x" * 11])
    with pytest.raises(ValueError):
        members.clean_prefixes([",".join("p{}".format(i) for i in range(11))])


def test_two_wikis_merged(spark):
    rows = spark.createDataFrame(
        [("fiwiki", 123, "Turku", 0, "Q1757", "20260403010203"), ("svwiki", 124, "Esimerkki", 14, "q42", "20260404020304"), ("fiwiki", 5, "NoItem", 0, "none", "20260404020304")],
        "wiki string, page_id int, page_title string, page_namespace int, qid_text string, timestamp string",
    )
    dims = spark.createDataFrame(
        [(l + ".wikipedia.org", l + "wiki", l, "wikipedia", "https://" + l + ".wikipedia.org/", "wiki") for l in ("fi", "sv")],
        "domain string, dbname string, lang_code string, wiki_group string, site_url string, site_code string",
    )
    info = dims.select("domain", F.lit("/wiki/$1").alias("article_path"), F.lit("").alias("lang"))
    names = spark.createDataFrame([("sv.wikipedia.org", 14, "Kategori")], "domain string, ns_id int, name string")
    got = changes.newest_records(changes.page_records(rows, dims, info, names)).collect()
    assert [(r.page_title, r.page_url, r.created_timestamp, r.wikidata_id, r.lang_code) for r in got] == [
        ("Kategori:Esimerkki", "https://sv.wikipedia.org/wiki/Kategori:Esimerkki", "2026-04-04T02:03:04Z", "Q42", "sv"),
        ("Turku", "https://fi.wikipedia.org/wiki/Turku", "2026-04-03T01:02:03Z", "Q1757", "fi"),
    ]
    kept = changes.page_records(rows, dims, info, names, require_item=False)
    assert kept.count() == 3


def test_item_id_from_sort_key(spark):
    props = spark.createDataFrame([("w", 1, "wikibase_item", "Q1"), ("w", 2, "other", "Q9")], "wiki string, pp_page int, pp_propname string, pp_value string")
    target = spark.createDataFrame([("w", 7, 14, "Maintenance:Wikidata_interwiki_links"), ("w", 8, 14, "Else")], "wiki string, lt_id int, lt_namespace int, lt_title string")
    cats = spark.createDataFrame([("w", 1, 7, "Q5"), ("w", 2, 7, "Q6"), ("w", 3, 8, "Q7")], "wiki string, cl_from int, cl_target_id int, cl_sortkey_prefix string")
    got = changes.item_ids(props, cats, target).collect()
    assert sorted((r.page_id, r.qid_text) for r in got) == [(1, "Q1"), (2, "Q6")]


def _events(spark):
    rows = []
    for i in range(60):
        rows.append(("w", i, i % 7, "mw.new" if i % 2 == 0 else "mw.edit", 6 if i % 11 == 0 else 0, "202604010{:05d}".format(i)))
    return spark.createDataFrame(
        rows, "wiki string, rc_id long, rc_cur_id long, rc_source string, rc_namespace int, rc_timestamp string"
    ).withColumn("event_time", F.to_timestamp(F.lit("2026-04-01 00:00:00")) + F.make_dt_interval(secs=F.col("rc_id").cast("decimal(18,6)")))


def _stream(spark, tmp_path, events):
    source = str(tmp_path / "in")
    for part in range(3):
        events.where(F.col("rc_id") % 3 == part).coalesce(1).write.mode("append").parquet(source)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source)


def test_stream_of_new_pages_keeps_one_row_per_page(spark, tmp_path):
    events = _events(spark)
    page = spark.createDataFrame([("w", i, "P{}".format(i), 0) for i in range(6)], "wiki string, page_id long, page_title string, page_namespace int")
    items = spark.createDataFrame([("w", i, "Q{}".format(i)) for i in range(1, 7)], "wiki string, page_id long, qid_text string")
    stream = feed.new_pages(_stream(spark, tmp_path, events), page, items, commons="w")
    out = str(tmp_path / "out")
    feed.start_merge(stream, out, str(tmp_path / "cp"), ["rc_timestamp", "rc_id"], feed.newest_event).awaitTermination(120)
    batch = feed.new_pages(events, page, items, commons="w")
    flat = lambda df: sorted(tuple(r) for r in df.select(*batch.columns).collect())
    assert len(flat(batch)) == 5 and flat(feed.read_merged(spark, out, feed.KEYS)) == flat(batch)
    assert spark.read.parquet(out).select("batch").distinct().count() == 3
    feed.compact(spark, out, 2, feed.newest_rows(feed.KEYS))
    assert spark.read.parquet(out).count() == 5 and flat(feed.read_merged(spark, out, feed.KEYS)) == flat(batch)


def test_stream_of_latest_edits_equals_batch(spark, tmp_path):
    events = _events(spark)
    out = str(tmp_path / "out")
    stream = _stream(spark, tmp_path, events)
    feed.start_merge(stream, out, str(tmp_path / "cp"), ["rc_timestamp", "rc_id"], feed.latest_edits).awaitTermination(120)
    flat = lambda df: sorted((r.rc_cur_id, r.rc_timestamp, r.rc_id, r.edits) for r in df.collect())
    assert flat(feed.read_edits(spark, out)) == flat(feed.latest_edits(events))
    feed.compact(spark, out, 2, feed.summed_edits)
    assert spark.read.parquet(out).select("batch").distinct().count() == 1
    assert flat(feed.read_edits(spark, out)) == flat(feed.latest_edits(events))


def test_no_row_is_cut_without_a_cap(spark):
    rows = spark.range(60_000)
    wiki = F.lit("w").alias("wiki")
    revision = rows.select(wiki, F.col("id").alias("rev_page"), F.lit(1).alias("rev_actor"), F.lit("20260401000000").alias("rev_timestamp"))
    page = rows.select(wiki, F.col("id").alias("page_id"), F.concat(F.lit("P"), "id").alias("page_title"), F.lit(0).alias("page_namespace"))
    items = rows.select(wiki, F.col("id").alias("page_id"), F.concat(F.lit("Q"), "id").alias("qid_text"))
    actors = spark.createDataFrame([("w", 1)], "wiki string, actor_id int")
    edited = changes.edited_page_rows(revision, page, items, actors, "20260101000000")
    assert edited.count() == 60_000
    created = rows.select(
        wiki, F.lit("mw.new").alias("rc_source"), F.lit(3).alias("rc_namespace"), F.lit("20260401000000").alias("rc_timestamp"), F.col("id").alias("rc_cur_id"), F.lit("T").alias("rc_title")
    )
    props = items.select("wiki", F.col("page_id").alias("pp_page"), F.lit("wikibase_item").alias("pp_propname"), F.col("qid_text").alias("pp_value"))
    assert changes.namespace_sample(created, props, "20260101000000").count() == 60_000
    assert changes.namespace_sample(created, props, "20260101000000", 7).count() == 7


def test_redirects_are_followed_to_their_end(spark):
    page = spark.createDataFrame([("w", 0, "P{}".format(i), i) for i in range(20)], "wiki string, page_namespace int, page_title string, page_id int")
    moves = [(i, i + 1) for i in range(12)] + [(14, 15), (15, 16), (16, 14), (17, 17), (18, 99)]
    redirect = spark.createDataFrame([("w", a, 0, "P{}".format(b)) for a, b in moves], "wiki string, rd_from int, rd_namespace int, rd_title string")
    starts = spark.createDataFrame([("w", 0, "P{}".format(i)) for i in (0, 5, 13, 14, 17, 18, 50)], "wiki string, ns_id int, db_title string")
    got = {r.db_title: r.page_id for r in changes.chase_redirects(starts, page, redirect).collect()}
    assert got == {"P0": 12, "P5": 12, "P13": 13, "P14": 16, "P17": 17, "P18": 18, "P50": None}
