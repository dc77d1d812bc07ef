"""Payload documents built from the driver tables, read back by the sources.

A payload holds the rows of one key range of fixed width, so no document grows with the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagegraph.operators.triples import joined_list
from pagegraph.plans.registry import query
from pagegraph.plans.views import PAYLOAD_ROWS, K_SQL, Views, digits, iso, stripped, text
from pagegraph.sources import feeds, piles, records, results


def _documents(rows: DataFrame, key: str, order: str, item: Column, size: int = PAYLOAD_ROWS) -> DataFrame:
    """(payload_id, items) with the items of ``size`` consecutive keys, in order.

    The number of partitions is stated, because reading a document costs far more than its size
    suggests; the grouping reuses that partitioning.
    """
    number = F.floor(F.col(key) / size).cast("bigint").alias("payload_id")
    listed = rows.select(number, F.struct(F.col(order).alias("_o"), item.alias("item")).alias("_i"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return listed.repartition(parts, "payload_id").groupBy("payload_id").agg(F.sort_array(F.collect_list("_i")).alias("_l")).select(
        "payload_id", F.transform("_l", lambda x: x["item"]).alias("items")
    )


def result_documents(rows: DataFrame, key: str, row: Column) -> DataFrame:
    """(payload_id, items): the rows of SQL results, one document per range of keys."""
    return _documents(rows, key, key, row)


def _event_item() -> Column:
    return F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("title"), F.col("value").alias("len"))


def _listed_records(rows: DataFrame) -> DataFrame:
    get = lambda path, kind: F.try_variant_get("record", path, kind)
    return rows.select(
        "payload_id", F.col("position").cast("bigint").alias("position"), get("$.id", "bigint").alias("id"), get("$.title", "string").alias("title")
    )


#: rows of a payload that is cut
LONG_ROWS = 2000

_DIRECT_SQL = """SELECT event_id // {n} AS payload_id, event_id % {n} AS position, event_id AS id, event_type AS title
    FROM events""".format(n=PAYLOAD_ROWS)


@query("payload_direct", _DIRECT_SQL)
def payload_direct(v: Views) -> DataFrame:
    docs = _documents(v.table("events"), "event_id", "event_id", _event_item())
    spread = F.struct(F.struct(F.col("items").alias("*")).alias("a"))
    star = F.when(F.col("payload_id") % 3 == 1, F.col("items"))
    payload = F.to_json(
        F.when(
            F.col("payload_id") % 3 == 0,
            F.struct(F.col("items").alias("pages"), star.alias("*"), F.lit(None).cast(_ITEMS).alias("a")),
        )
        .when(F.col("payload_id") % 3 == 1, F.struct(F.lit(None).cast(_ITEMS_LIST).alias("pages"), star.alias("*"), F.lit(None).cast(_ITEMS).alias("a")))
        .otherwise(F.struct(F.lit(None).cast(_ITEMS_LIST).alias("pages"), star.alias("*"), spread["a"].alias("a")))
    )
    payloads = docs.select("payload_id", payload.alias("json"))
    listed = payloads.select("payload_id", records.direct_records(F.try_parse_json("json")).alias("records"))
    return _listed_records(records.exploded_records(listed, ["payload_id"]))


_ITEMS_LIST = "array<struct<id:bigint,title:string,len:double>>"
_ITEMS = "struct<`*`:{}>".format(_ITEMS_LIST)


@query(
    "payload_scored",
    """SELECT event_id // {n} AS payload_id, row_number() OVER (PARTITION BY event_id // {n} ORDER BY event_id) - 1 AS position,
       event_id AS id, event_type AS title FROM events WHERE event_id % 4 <> 0""".format(n=PAYLOAD_ROWS),
)
def payload_scored(v: Views) -> DataFrame:
    """Two candidate lists per payload: a quarter of the rows in ``pages``, the rest below ``*``."""
    docs = _documents(v.table("events"), "event_id", "event_id", _event_item())
    few = F.filter("items", lambda x: x["id"] % 4 == 0)
    many = F.filter("items", lambda x: x["id"] % 4 != 0)
    nested = F.array(F.struct(F.struct(many.alias("*")).alias("a")))
    payload = F.to_json(F.struct(few.alias("pages"), nested.alias("*")))
    listed = docs.select("payload_id", records.direct_records(F.try_parse_json(payload)).alias("records"))
    return _listed_records(records.exploded_records(listed, ["payload_id"]))


@query("payload_deep", _DIRECT_SQL)
def payload_deep(v: Views) -> DataFrame:
    """Rows three levels down, next to a shorter list and a number list."""
    docs = _documents(v.table("events"), "event_id", "event_id", _event_item())
    payload = F.to_json(
        F.struct(
            F.struct(F.slice("items", 1, 3).alias("short"), F.struct(F.col("items").alias("rows")).alias("inner")).alias("outer"),
            F.array(F.lit(1), F.lit(2)).alias("numbers"),
        )
    )
    payloads = docs.select("payload_id", payload.alias("json"))
    return _listed_records(records.extract_records(payloads, ["payload_id"], "json"))


@query("payload_cut", _DIRECT_SQL.replace(str(PAYLOAD_ROWS), str(LONG_ROWS)))
def payload_cut(v: Views) -> DataFrame:
    """Long payloads, cut in ranges by many tasks: rows at a usual place, and rows that only a deep search finds."""
    docs = _documents(v.table("events"), "event_id", "event_id", _event_item(), LONG_ROWS)
    few = F.slice("items", 1, 3).alias("short")
    usual = F.to_json(F.struct(few, F.struct(F.col("items").alias("*")).alias("a")))
    deep = F.to_json(F.struct(few, F.struct(F.struct(F.col("items").alias("rows")).alias("inner")).alias("outer")))
    payloads = docs.select("payload_id", F.when(F.col("payload_id") % 2 == 0, usual).otherwise(deep).alias("json"))
    return _listed_records(records.extract_records(payloads, ["payload_id"], "json", whole=1 << 14, size=1 << 15))


@query(
    "header_cut",
    """SELECT o_orderkey // {n} AS payload_id, o_orderkey % {n} AS position, 'id' AS key, CAST(o_orderkey AS VARCHAR) AS value FROM orders
       UNION ALL SELECT o_orderkey // {n}, o_orderkey % {n}, 'id_2', o_orderpriority FROM orders""".format(n=LONG_ROWS),
)
def header_cut(v: Views) -> DataFrame:
    """Long result payloads: headers in one piece, rows cut out by many tasks."""
    cells = text("[", F.col("o_orderkey"), ',"', F.col("o_orderpriority"), '"]')
    docs = _documents(v.table("orders"), "o_orderkey", "o_orderkey", cells, LONG_ROWS)
    payload = text('{"rows":[', F.array_join("items", ", "), '], "headers":["id","id"]}')
    fields = results.result_rows(docs.select("payload_id", payload.alias("json")), ["payload_id"], "json", whole=1 << 14, size=1 << 15)
    return fields.select("payload_id", F.col("position").cast("bigint").alias("position"), F.explode("fields").alias("f")).select(
        "payload_id", "position", "f.key", F.col("f.value").cast("string").alias("value")
    )


@query(
    "header_rows",
    """SELECT payload_id, position, key, value FROM (
         SELECT o_orderkey // {n} AS payload_id, o_orderkey % {n} AS position, 'id' AS key, CAST(o_orderkey AS VARCHAR) AS value FROM orders
         UNION ALL SELECT o_orderkey // {n}, o_orderkey % {n}, 'Total_price', CASE WHEN o_orderkey % 3 <> 1 THEN o_orderpriority END FROM orders
         UNION ALL SELECT o_orderkey // {n}, o_orderkey % {n}, 'Total_price_2', CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus WHEN o_orderkey % 3 = 2 THEN o_orderstatus END FROM orders
         UNION ALL SELECT o_orderkey // {n}, o_orderkey % {n}, 'column_4', CAST(o_custkey AS VARCHAR) FROM orders WHERE o_orderkey % 3 = 0)
       WHERE position < 40""".format(n=PAYLOAD_ROWS),
)
def header_rows(v: Views) -> DataFrame:
    """Full rows with an extra cell, short rows, and object rows, limited before conversion."""
    key = F.col("o_orderkey")
    cell = lambda c: F.concat(F.lit('"'), c.cast("string"), F.lit('"'))
    full = text("[", key, ",", cell(F.col("o_orderpriority")), ",", cell(F.col("o_orderstatus")), ",", F.col("o_custkey"), "]")
    short = text("[", key, "]")
    named = text('{"id":', key, ',"Total price":', cell(F.col("o_orderpriority")), ',"Total-price":', cell(F.col("o_orderstatus")), "}")
    row = F.when(key % 3 == 0, full).when(key % 3 == 1, short).otherwise(named)
    docs = _documents(v.table("orders"), "o_orderkey", "o_orderkey", row)
    payload = text('{"headers":["id","Total (price","Total  price"],"rows":[', F.array_join("items", ","), "]}")
    payload = F.replace(payload, F.lit("Total (price"), F.lit("Total price"))
    fields = results.result_rows(docs.select("payload_id", payload.alias("json")), ["payload_id"], "json", limit=40, whole=None)
    return fields.select("payload_id", "position", F.explode_outer("fields").alias("f")).where(F.col("f").isNotNull()).select(
        "payload_id", "position", "f.key", F.col("f.value").cast("string").alias("value")
    )


@query(
    "header_names",
    """SELECT p_partkey, p_name2 || '|' || p_name2 || CASE WHEN last THEN '2' ELSE '_2' END || '|column_3|' || p_name2
       || CASE WHEN last THEN '3' ELSE '_3' END || '|' || p_name2 || CASE WHEN last THEN '4' ELSE '_4' END || '|_' AS names
       FROM (SELECT p_partkey, replace(p_name, ' ', '_') || CASE WHEN p_partkey % 2 = 0 THEN '_' ELSE '' END AS p_name2, p_partkey % 2 = 0 AS last FROM part)""",
)
def header_names(v: Views) -> DataFrame:
    """Repeats, an empty header and a header that takes the name of a later repeat."""
    name = text(F.col("p_name"), F.when(F.col("p_partkey") % 2 == 0, "!").otherwise(""))
    taken = text(F.col("p_name"), F.when(F.col("p_partkey") % 2 == 0, " 3").otherwise("_3"))
    names = results.unique_headers(F.array(text(" ", name), name, F.lit(""), taken, name, F.lit("ää")))
    return v.table("part").select("p_partkey", F.array_join(names, "|").alias("names"))


@query(
    "pile_titles",
    """WITH t AS (SELECT p_partkey // {n} AS pile_id, p_partkey % {n} AS pos, replace(p_name, ' ', '_') AS title FROM part WHERE p_partkey % 7 <> 0),
       firsts AS (SELECT pile_id, title, min(pos) AS pos FROM t GROUP BY pile_id, title)
       SELECT pile_id, title, position FROM (SELECT pile_id, title, row_number() OVER (PARTITION BY pile_id ORDER BY pos) - 1 AS position FROM firsts)
       WHERE position < 20""".format(n=PAYLOAD_ROWS),
)
def pile_titles(v: Views) -> DataFrame:
    title = F.when(F.col("p_partkey") % 7 == 0, "  ").otherwise(text(" :", F.col("p_name")))
    docs = _documents(v.table("part"), "p_partkey", "p_partkey", title)
    payload = F.to_json(F.struct(F.lit(" EnWiki ").alias("wiki"), F.col("items").alias("pages")))
    rows = piles.read_piles(docs.select(F.col("payload_id").alias("pile_id"), payload.alias("json")), ["pile_id"], "json", limit=20, whole=None)
    return rows.select("pile_id", "title", F.col("position").cast("bigint").alias("position"))


@query(
    "html_scrape",
    """SELECT page_id, nullif(regexp_extract(html, '<html[^>]*lang="([^"]*)"', 1), '') AS lang,
       nullif(regexp_extract(html, '<a href="([^"]*)"', 1), '') AS link,
       CASE WHEN page_id % 2 = 0 AND page_id > 0 THEN page_id END AS run_id, 'wiki&"' || page_id AS database FROM pages""",
)
def html_scrape(v: Views) -> DataFrame:
    """Whole pages, with the run block and the input tag of a saved query page put in front."""
    block = F.when(F.col("page_id") % 2 == 0, text('<script>VAR vars = {"x": 1, "qrun_id": ', F.col("page_id"), "};</script>")).otherwise("")
    tag = text('<input id="other" value="no"><INPUT class="a" id="query-db" value=" wiki&amp;&quot;', F.col("page_id"), ' ">')
    pages = v.wide_table("pages").select("page_id", "html", text(block, tag, F.col("html")).alias("page"))
    return pages.select(
        "page_id",
        results.first_match(F.col("html"), r'<html[^>]*lang="([^"]*)"').alias("lang"),
        results.first_match(F.col("html"), r'<a href="([^"]*)"').alias("link"),
        results.run_id(F.col("page")).cast("string").alias("run_id"),
        results.input_value(F.col("page")).alias("database"),
    )


@query(
    "feed_rows",
    """SELECT 'w' || (event_id // {n} % 3) AS wiki, event_id // {n} AS seq, event_id % {n} AS position, {k} AS page_id, {k} % 16 AS namespace,
       'Page_' || {k} AS title, 'user ' || user_id AS user_name, {t} AS timestamp, CAST({d} AS BIGINT) AS time_key
       FROM events WHERE event_id % 5 <> 0""".format(n=PAYLOAD_ROWS, k=K_SQL, t=iso("ts"), d=digits("ts")),
)
def feed_rows(v: Views) -> DataFrame:
    """Creation-log responses: entries without a page id drop out, namespaces come as text or number."""
    k = F.get_json_object("props", "$.k")
    stamp = text(F.replace(F.substring(F.col("ts").cast("string"), 1, 19), F.lit(" "), F.lit("T")), "Z")
    entry = F.struct(
        F.when(F.col("event_id") % 5 != 0, k).alias("pageid"),
        (k.cast("bigint") % 16).cast("string").alias("ns"),
        text("Page ", k).alias("title"),
        text("user_", F.col("user_id")).alias("user"),
        stamp.alias("timestamp"),
    )
    docs = _documents(v.table("events"), "event_id", "event_id", entry)
    response = F.to_json(F.struct(F.struct(F.col("items").alias("logevents")).alias("query")))
    landed = docs.select(text("w", F.col("payload_id") % 3).alias("wiki"), F.col("payload_id").alias("seq"), response.alias("response"))
    return feeds.creation_rows(landed).drop("sort_key")


@query(
    "feed_contributions",
    """SELECT 'w' || (event_id // {n} % 3) AS wiki, event_id // {n} AS seq, event_id % {n} AS position, {k} AS page_id, {k} % 16 AS namespace,
       'Page_' || {k} AS title, 'user ' || user_id AS user_name, CAST({d} AS BIGINT) AS time_key
       FROM events WHERE event_id % 5 <> 0 AND event_id % 7 <> 0""".format(n=PAYLOAD_ROWS, k=K_SQL, d=digits("ts")),
)
def feed_contributions(v: Views) -> DataFrame:
    """Contribution responses: entries without a page id or a readable time drop out."""
    k = F.get_json_object("props", "$.k")
    stamp = text(F.replace(F.substring(F.col("ts").cast("string"), 1, 19), F.lit(" "), F.lit("T")), "Z")
    entry = F.struct(
        F.when(F.col("event_id") % 5 != 0, k.cast("bigint")).alias("pageid"),
        (k.cast("bigint") % 16).alias("ns"),
        text("Page ", k).alias("title"),
        text(" user_", F.col("user_id")).alias("user"),
        F.when(F.col("event_id") % 7 != 0, stamp).otherwise("soon").alias("timestamp"),
    )
    docs = _documents(v.table("events"), "event_id", "event_id", entry)
    response = F.to_json(F.struct(F.struct(F.col("items").alias("usercontribs")).alias("query")))
    landed = docs.select(text("w", F.col("payload_id") % 3).alias("wiki"), F.col("payload_id").alias("seq"), response.alias("response"))
    return feeds.contribution_rows(landed).drop("sort_key", "timestamp")


@query(
    "feed_members",
    """SELECT 'w' AS wiki, p_partkey // {n} AS seq, p_partkey % {n} AS position, p_partkey AS page_id, CAST(p_size % 16 AS BIGINT) AS namespace,
       replace(p_name, ' ', '_') AS title, 'Q' || p_partkey AS sort_key FROM part WHERE p_partkey % 4 <> 0""".format(n=PAYLOAD_ROWS),
)
def feed_members(v: Views) -> DataFrame:
    """Category member responses: entries with a blank title drop out."""
    key = F.col("p_partkey")
    entry = F.struct(
        key.cast("string").alias("pageid"),
        (F.col("p_size") % 16).alias("ns"),
        F.when(key % 4 != 0, F.col("p_name")).otherwise(" : ").alias("title"),
        text("Q", key).alias("sortkeyprefix"),
    )
    docs = _documents(v.table("part"), "p_partkey", "p_partkey", entry)
    response = F.to_json(F.struct(F.struct(F.col("items").alias("categorymembers")).alias("query")))
    landed = docs.select(F.lit("w").alias("wiki"), F.col("payload_id").alias("seq"), response.alias("response"))
    return feeds.member_rows(landed).select("wiki", "seq", "position", "page_id", "namespace", "title", "sort_key")


@query(
    "page_lookup",
    """SELECT 'w' AS wiki, replace(p_name || ' ' || p_partkey, ' ', '_') AS title, CASE WHEN p_partkey % 3 <> 0 THEN 'Q' || p_partkey END AS qid,
       CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS VARCHAR) END AS page_len, '2024-01-02T03:04:05Z' AS rev_timestamp
       FROM part WHERE p_partkey > 0""",
)
def page_lookup(v: Views) -> DataFrame:
    item = F.struct(
        F.when(F.col("p_partkey") > 0, text(F.col("p_name"), " ", F.col("p_partkey"))).alias("title"),
        F.struct(F.when(F.col("p_partkey") % 3 != 0, text("q", F.col("p_partkey"))).alias("wikibase_item")).alias("pageprops"),
        F.when(F.col("p_size") % 2 == 0, F.col("p_size")).otherwise(-1).alias("length"),
        F.array(F.struct(F.lit("2024-01-02T03:04:05Z").alias("timestamp"))).alias("revisions"),
    )
    docs = _documents(v.table("part"), "p_partkey", "p_partkey", item)
    response = F.to_json(F.struct(F.struct(F.col("items").alias("pages")).alias("query")))
    landed = docs.select(F.lit("w").alias("wiki"), F.col("payload_id").alias("seq"), response.alias("response"))
    return feeds.page_lookup_rows(landed).withColumn("page_len", F.col("page_len").cast("string"))


@query(
    "scalar_unpivot_lists",
    """SELECT doc_id, md5(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: {s}), lambda x: x <> ''), '; ')) AS joined_md5
       FROM documents""".format(s=stripped("x")),
)
def scalar_unpivot_lists(v: Views) -> DataFrame:
    """Every document as the list of its lines, flattened to one cell."""
    return v.wide_table("documents").select("doc_id", F.md5(F.coalesce(joined_list(F.split("text", "\n")), F.lit(""))).alias("joined_md5"))
