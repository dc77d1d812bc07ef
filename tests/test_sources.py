import gzip
import json

from pyspark.sql import functions as F

from pagegraph.sources import feeds, piles, records, results, tables, wikis


def payloads(spark, docs):
    rows = [(i, d if isinstance(d, str) else json.dumps(d)) for i, d in enumerate(docs)]
    return spark.createDataFrame(rows, "pid int, json string")


def ids(df):
    got = df.select("pid", "position", F.try_variant_get("record", "$.id", "string").alias("id")).collect()
    out = {}
    for row in sorted(got):
        out.setdefault(row.pid, []).append(row.id)
    return out


def test_record_extraction(spark):
    row = lambda n: {"id": n, "title": "T{}".format(n)}
    docs = [
        {"*": [{"a": {"*": [row(1), row(2)]}}]},
        {"pages": [row(1), "x", row(2), row(3)], "*": [row(9)]},
        {"outer": {"inner": {"rows": [row(5), row(6)]}, "few": [{"z": 1}]}},
        {"pages": [{"other": 1}], "a": {"*": [row(4)]}},
        {"numbers": [1, 2]},
        "not json",
        {"pages": [row(1)], "*": [row(2)]},
        {"b": [{"x": 1}], "a": [{"x": 2}]},
    ]
    df = payloads(spark, docs)
    got = ids(records.extract_records(df, ["pid"], "json"))
    assert got == {0: ["1", "2"], 1: ["1", "2", "3"], 2: ["5", "6"], 3: ["4"], 6: ["1"], 7: [None]}
    chosen = records.extract_records(df.where("pid = 7"), ["pid"], "json").select(F.try_variant_get("record", "$.x", "int")).collect()
    assert chosen[0][0] == 1  # document order, not key order
    assert [r.pid for r in records.rejected_payloads(df, ["pid"], "json").collect()] == [5]


def test_deep_equals_direct_choice(spark):
    docs = [{"*": [{"a": {"*": [{"id": i, "title": "x", "len": i} for i in range(n)]}}]} for n in (1, 3, 25)]
    df = payloads(spark, docs)
    deep = records.deep_records(df, ["pid"], "json").select("pid", F.posexplode("records").alias("position", "record"))
    assert ids(deep) == ids(records.extract_records(df, ["pid"], "json"))


def test_headers(evaluate):
    call = lambda *c: results.unique_headers(F.array(*c))
    schema = ", ".join("c{} string".format(i) for i in range(5))
    rows = [
        ("title", "title", "", "a", "b"),
        ("Title (fi) / 2024", "äää", "a---b", "a___b", "title!"),
        ("a", "a_2", "a", "a", "x_"),
        ("x!", "x?", "x", "x_2", " "),
    ]
    assert evaluate(call, rows, schema) == [
        ["title", "title_2", "column_3", "a", "b"],
        ["Title_fi_2024", "_", "a_b", "a_b_2", "title_"],
        ["a", "a_2", "a_3", "a_4", "x_"],
        ["x_", "x_2", "x", "x_2_2", "column_5"],
    ]


def test_result_rows(spark):
    doc = {"headers": ["title", "n"], "rows": [["A"], ["B", 1, "extra"], {"Name (fi)": "C", "a---b": 2, "a___b": 3}, "scalar"]}
    df = results.result_rows(payloads(spark, [doc, {"rows": []}, {"headers": [], "rows": [[1]]}]), ["pid"], "json")
    got = df.orderBy("position").select(
        "row_error", F.transform("fields", lambda f: F.concat_ws("=", f["key"], f["value"].cast("string"))).alias("f")
    )
    assert [tuple(r) for r in got.collect()] == [
        (False, ["title=A", "n"]),
        (False, ["title=B", "n=1", "column_3=extra"]),
        (False, ["Name_fi_=C", "a_b=2", "a_b_2=3"]),
        (True, None),
    ]
    limited = results.result_rows(payloads(spark, [doc]), ["pid"], "json", limit=2)
    assert limited.count() == 2


def test_piles(spark):
    docs = [{"wiki": " EnWiki", "pages": [" :A b", "", "A_b", "C", "D"]}, {"pages": ["x"]}, {"wiki": "x"}]
    df = payloads(spark, docs)
    assert [tuple(r) for r in piles.read_piles(df, ["pid"], "json", 2).orderBy("position").collect()] == [
        (0, "enwiki", 0, "A_b"),
        (0, "enwiki", 1, "C"),
    ]
    assert sorted(r.pid for r in piles.broken_piles(df, ["pid"], "json").collect()) == [1, 2]


def test_scrape(evaluate):
    pages = [
        '<script>var vars = {"a": 1, "qrun_id": 12};</script> "qrun_id": 99',
        'x "qrun_id": 7 <input id="other" value="no"><input value=" fi&amp;wiki_p " id=\'query-db\'>',
        'var vars={"a":1}; "qrun_id": 5',
        '"qrun_id": 0 <input id="query-db">',
    ]
    assert evaluate(results.run_id, pages) == [12, 7, None, None]
    assert evaluate(results.input_value, pages) == [None, "fi&wiki_p", None, None]


def test_gzip_feed(spark, tmp_path):
    response = {
        "query": {
            "logevents": [
                {"pageid": 5, "ns": 0, "title": "A b", "user": "U_x", "timestamp": "2026-04-01T00:00:00Z"},
                {"ns": 0, "title": "gone", "timestamp": "2026-04-01T00:00:00Z"},
            ],
            "pages": [{"title": "A b", "length": 7, "pageprops": {"wikibase_item": "q5"}, "revisions": [{"timestamp": "20260401000000"}]}],
            "normalized": [{"from": "a b", "to": "A b"}],
            "redirects": [{"from": "a b", "to": "C"}],
        }
    }
    with gzip.open(tmp_path / "part.json.gz", "wt") as out:
        out.write(json.dumps({"wiki": "fi", "seq": 3, "response": json.dumps(response)}) + "\n")
    landed = feeds.read_responses(spark, str(tmp_path))
    row = feeds.creation_rows(landed).collect()
    assert [(r.wiki, r.seq, r.page_id, r.title, r.user_name, r.time_key) for r in row] == [
        ("fi", 3, 5, "A_b", "U x", 20260401000000)
    ]
    assert [tuple(r) for r in feeds.page_lookup_rows(landed).collect()] == [("fi", "A_b", "Q5", 7, "2026-04-01T00:00:00Z")]
    assert [tuple(r) for r in feeds.alias_rows(landed).collect()] == [("fi", "a_b", "C")]


def test_wiki_dimension_last_entry_wins(spark):
    doc = {
        "count": 3,
        "0": {"code": "FI", "site": [{"url": "https://fi.wikipedia.org", "dbname": "fiwiki", "code": "wiki"}]},
        "1": {"code": "xx", "site": [{"url": "https://fi.wikipedia.org", "dbname": "later", "code": "wikibooks"}, {"url": "bad", "dbname": "b"}]},
        "specials": [{"url": "https://meta.wikimedia.org", "dbname": "metawiki", "code": "meta"}],
    }
    df = spark.createDataFrame([(0, json.dumps(doc))], "n int, json string")
    got = {r.domain: tuple(r)[1:] for r in wikis.wiki_dimension(df, "json", "n").collect()}
    assert got == {
        "fi.wikipedia.org": ("later", "xx", "wikibooks", "https://fi.wikipedia.org/", "wikibooks"),
        "meta.wikimedia.org": ("metawiki", "", "wikimedia", "https://meta.wikimedia.org/", "meta"),
    }


def test_read_table(spark, tmp_path):
    spark.range(3).selectExpr("'fi' wiki", "id page_id", "0 page_namespace", "'x' extra", "'T' page_title").write.partitionBy("wiki").parquet(
        str(tmp_path / "page")
    )
    got = tables.read_table(spark, str(tmp_path), "page")
    assert got.columns == ["wiki", "page_id", "page_namespace", "page_title"] and got.count() == 3


def test_rows_are_found_at_any_depth_and_after_many_rows(spark):
    rows = '[{"x":1},{"title":"T","x":"a\\"[[[["}]'
    deep = rows
    for _ in range(14):
        deep = '{"n":' + deep + "}"
    late = '{"pages":[' + ",".join(['{"x":1}'] * 30) + ',{"title":"last"}]}'
    df = spark.createDataFrame([("deep", deep), ("late", late)], "k string, json string")
    got = records.extract_records(df, ["k"], "json").groupBy("k").count().collect()
    assert sorted(map(tuple, got)) == [("deep", 2), ("late", 31)]
    assert [r[0] for r in df.select(records.nesting(F.col("json"))).collect()] == [16, 3]


def test_days_and_wikis_prune_folders(spark, tmp_path):
    rows = spark.range(400).select(
        F.format_string("w%d", F.col("id") % 4).alias("wiki"), F.col("id").alias("rc_id"), F.lit("mw.new").alias("rc_source"),
        F.concat(F.lit("202604"), F.lpad((1 + F.col("id") % 10).cast("string"), 2, "0"), F.lpad((F.col("id") % 24).cast("string"), 2, "0"), F.lit("0000")).alias("rc_timestamp"),
    )
    tables.write_by_day(rows, str(tmp_path), "recentchanges")
    dims = spark.createDataFrame([("w%d" % i, "a" if i < 2 else "b") for i in range(4)], "wiki string, kind string")
    floor = "20260408120000"
    got = tables.read_since(spark, str(tmp_path), "recentchanges", floor, dims.where("kind = 'a'"))
    expected = rows.where((F.col("rc_timestamp") >= floor) & F.col("wiki").isin("w0", "w1"))
    flat = lambda df: sorted((r.wiki, r.rc_id, r.rc_timestamp) for r in df.collect())
    assert flat(got) == flat(expected) and flat(got)
    plan = got._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan" in line or "PartitionFilters" in line)
    assert "dynamicpruning" in scan and "20260408" in scan.split("PartitionFilters")[1].split("PushedFilters")[0]
    assert flat(tables.read_since(spark, str(tmp_path), "recentchanges", floor)) == flat(rows.where(F.col("rc_timestamp") >= floor))
