import json

from pyspark.sql import functions as F

from pagegraph.functions.text import signed_zeros
from pagegraph.operators import triples
from pagegraph.operators.links import link_targets
from pagegraph.operators.triples import TypedRecord, VariantRecord, Vocabulary
from pagegraph.sources import results

VOC = Vocabulary()


def variant_records(spark, docs):
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "position long, json string")
    return df.select(F.lit("7").alias("dataset_id"), "position", F.parse_json("json").alias("record"))


def fields_of(rows):
    shown = rows.select("position", F.explode("fields").alias("f")).where("f.value is not null")
    out = {}
    for r in shown.select("position", "f.key", "f.kind", "f.value").collect():
        out.setdefault(r.position, []).append((r.key, r.kind, r.value))
    return {k: sorted(v) for k, v in out.items()}


def test_subjects(spark):
    docs = [
        {"id": 574781, "namespace": 6, "img_width": 3},
        {"pageid": "98765", "wiki": "commons.wikimedia.org", "namespace": "6"},
        {"id": 42, "namespace": 0},
        {"id": 574781, "namespace": 6, "img_width": 3, "wikidata_id": "Q378619"},
        {"id": 123, "wikidata_id": "Q378619"},
        {"title": "A b/ä"},
        {"id": " "},
        {"id": 5, "namespace": 6, "wiki": "fiwiki", "img_width": 1},
        {"id": 5, "nstext": "File", "metadata": {"wikidata": "http://x/q9"}},
    ]
    rows = triples.list_rows(variant_records(spark, docs), VariantRecord("record"), VOC)
    base = VOC.item_base + "/7/item/"
    assert [r.s for r in rows.orderBy("position").collect()] == [
        "https://commons.wikimedia.org/entity/M574781",
        "https://commons.wikimedia.org/entity/M98765",
        base + "42",
        "https://commons.wikimedia.org/entity/M574781",
        "http://www.wikidata.org/entity/Q378619",
        base + "A%20b%2F%C3%A4",
        base + "6",
        base + "5",
        "http://www.wikidata.org/entity/Q9",
    ]


def test_fields(spark):
    docs = [
        {"title": "Example", "tags": ["  first  ", "", None, "second", {"x": 1}, 3, True, 2.5], "none": ["", None], "metadata": "text", "o": {"n": 1}},
        {"gil": "enwiki:0:A|dewiki:0:B|bad", "metadata": ["a", "b"]},
        {"metadata": {"image": " Turku postcard 2013.png", "coordinates": "60.45138889 / 22.26666667"}},
        {"metadata": {"coordinates": "91, 5"}, "big": 123456789012345678901234567890, "one": 1.0, "exp": 1.5e-7, "flag": False},
        {"img_timestamp": "20260219191017", "touched": "never", "qid": "q5", "a b!": None},
    ]
    got = fields_of(triples.list_rows(variant_records(spark, docs), VariantRecord("record"), VOC))
    assert got[0] == [("tags", "xsd:string", "first; second; 3; True; 2.5"), ("title", "xsd:string", "Example")]
    assert got[1] == [
        ("gil", "xsd:string", "enwiki:0:A|dewiki:0:B|bad"),
        ("gil_link_count", "xsd:integer", "2"),
        ("metadata", "xsd:string", "a; b"),
    ]
    assert got[2] == [
        ("coordinate_lat", "xsd:double", "60.45138889"),
        ("coordinate_lon", "xsd:double", "22.26666667"),
        ("coordinates", "xsd:string", "60.45138889 / 22.26666667"),
        ("thumbnail_image", "xsd:string", "https://commons.wikimedia.org/wiki/Special:FilePath/Turku_postcard_2013.png?width=320"),
        ("thumbnail_image_file", "xsd:string", "Turku postcard 2013.png"),
    ]
    assert got[3] == [
        ("big", "xsd:integer", "123456789012345678901234567890"),
        ("exp", "xsd:double", "1.5e-07"),
        ("flag", "xsd:boolean", "false"),
        ("one", "xsd:double", "1.0"),
    ]
    assert got[4] == [
        ("img_timestamp", "xsd:dateTime", "2026-02-19T19:10:17Z"),
        ("qid", "xsd:string", "Q5"),
        ("qid", "xsd:string", "q5"),
        ("touched", "xsd:string", "never"),
        ("wikidata_entity", "xsd:string", "http://www.wikidata.org/entity/Q5"),
    ]


def test_inferred_typing(spark):
    values = ["20260219191017", "Q1258081", "M215253", "https://x.org/a", "19991231235959", "gopher://x", "http:///x", "https://a b", "q0", "20269999999999"]
    docs = [{"v": v} for v in values] + [{"touched": 20240101000000}, {"touched": 20240101000000, "qid": "x"}, {"v": 5}]
    got = fields_of(triples.result_rows(variant_records(spark, docs), VariantRecord("record"), VOC))
    assert [got[i][0][1:] for i in range(10)] == [
        ("xsd:dateTime", "2026-02-19T19:10:17Z"),
        ("iri", "http://www.wikidata.org/entity/Q1258081"),
        ("iri", "https://commons.wikimedia.org/entity/M215253"),
        ("iri", "https://x.org/a"),
        ("xsd:string", "19991231235959"),
        ("xsd:string", "gopher://x"),
        ("xsd:string", "http:///x"),
        ("xsd:string", "https://a b"),
        ("iri", "http://www.wikidata.org/entity/Q0"),
        ("xsd:string", "20269999999999"),
    ]
    assert got[10] == [("touched", "xsd:dateTime", "2024-01-01T00:00:00Z")]
    assert ("touched", "xsd:integer", "20240101000000") in got[11]
    assert got[12] == [("v", "xsd:integer", "5")]


def test_field_names(evaluate):
    cases = {"id": "page_id", "a b!": "a_b", "__x__": "x", "äö": "field", "2nd": "field_2nd", "": "field"}
    assert evaluate(triples.field_name, list(cases)) == list(cases.values())


def test_typed_and_variant_agree(spark):
    df = spark.createDataFrame(
        [(0, 1, "A", "Q5", 2.5, ["x", " "], True), (1, 2, "B", None, None, None, False)],
        "position long, id long, title string, qid string, n double, tags array<string>, ok boolean",
    ).withColumn("dataset_id", F.lit("7"))
    keys = ["id", "title", "qid", "n", "tags", "ok"]
    typed = triples.list_rows(df, TypedRecord(df.schema, keys), VOC)
    as_json = df.select("dataset_id", "position", F.parse_json(F.to_json(F.struct(*keys))).alias("record"))
    dynamic = triples.list_rows(as_json, VariantRecord("record"), VOC)
    flat = lambda rows: sorted(map(str, triples.graph_set(triples.row_triples(rows, VOC, "t")).collect()))
    assert flat(typed) == flat(dynamic)


def test_sitelinks(spark):
    df = spark.createDataFrame(
        [("1", "https://u/A", 5, " A ", "A b", "sms-x", "https://s/", "wikipedia"), ("1", " ", 6, "B", "B", "bad tag!", None, "x"), ("1", "https://u/C", 7, "C", "C", "bad tag!", None, "x")],
        "dataset_id string, page_url string, page_id int, page_title string, page_label string, lang_code string, site_url string, wiki_group string",
    )
    got = {(r.s, r.p.rsplit("/", 1)[-1].rsplit("#", 1)[-1], r.o, r.o_lang) for r in triples.sitelink_triples(df, VOC).collect()}
    assert ("https://u/A", "name", "A b", "sms-x") in got and ("https://u/C", "name", "C", None) in got
    assert ("https://s/", "wikiGroup", "wikipedia", None) in got
    assert len(got) == 7 + 5
    assert triples.missing_subject(df).count() == 1


def test_links(evaluate):
    cell = "enwiki:0:Federalist_No._42|x|enwiki:0: Federalist No. 42|localhost/wiki:0:A|a:b|enwiki:x:A|FIWIKI: 1 :Keskustelu:Ä b|enwiki:0::"
    got = evaluate(link_targets, [cell, "", None])
    assert [tuple(t) for t in got[0]] == [
        ("https://en.wikipedia.org/wiki/Federalist_No._42", "enwiki", 0, "Federalist_No._42", "Federalist_No._42"),
        ("https://fi.wikipedia.org/wiki/Keskustelu:%C3%84_b", "fiwiki", 1, "Keskustelu:Ä_b", "Ä_b"),
    ]
    assert got[1] == []


def test_negative_zero_keeps_its_sign_in_variants(spark):
    docs = ['{"n":-0.0,"t":"a, -0.0, \\"-0.0"}', '{"n": -0.00 }', '{"n":-0.05}', '{"n":0.0}', '{"n":10.5}', '{"n":[-0.0,1.0]}', '"-0.0']
    df = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "position long, json string")
    records = df.select(F.lit("7").alias("dataset_id"), "position", F.try_parse_json(signed_zeros(F.col("json"))).alias("record"))
    got = fields_of(triples.list_rows(records.where("record is not null"), VariantRecord("record"), VOC))
    assert got[0] == [("n", "xsd:double", "-0.0"), ("t", "xsd:string", 'a, -0.0, "-0.0')]
    assert [got[i][0][2] for i in range(1, 6)] == ["-0.0", "-0.05", "0.0", "10.5", "-0.0; 1.0"]
    assert records.where("record is null").count() == 1


def test_rows_without_special_keys_pay_for_no_derived_fields(spark):
    df = variant_records(spark, [{"title": "a", "n": 1}, {"title": "b", "qid": "Q5"}])
    rows = triples.result_rows(df, VariantRecord("record"), VOC)
    assert [r.n for r in rows.orderBy("position").select(F.size("fields").alias("n")).collect()] == [2, 2 + len(triples.DERIVED_KEYS)]


def test_result_records_build_fields_once(spark):
    rows = results.result_rows(spark.createDataFrame([("1", '{"headers":["a"],"rows":[["x"],7]}')], "pid string, json string"), ["pid"], "json")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    found = results.result_records(rows, ["pid", "position"])
    assert plan(found).count("zip_with") == plan(rows).count("zip_with") > 0
    assert [(r.position, r.record.toPython()) for r in found.collect()] == [(0, {"a": "x"})]
