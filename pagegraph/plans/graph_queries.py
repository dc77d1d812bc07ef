"""Graphs built from the driver tables: triples, profiles, patterns, writers and the catalog."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagegraph.functions import fixed, terms
from pagegraph.functions.text import signed_zeros
from pagegraph.functions.times import digits14, ntz_text
from pagegraph.operators import catalog, links, profile, sinks, triples
from pagegraph.operators import pattern as g
from pagegraph.operators.changes import page_records
from pagegraph.operators.members import member_records
from pagegraph.operators.pattern import Graph, Lit
from pagegraph.plans.payload_queries import result_documents
from pagegraph.plans.registry import query
from pagegraph.plans.views import PAYLOAD_ROWS, Views, iso, quoted, text, wiki_of, wiki_sql, with_ctes
from pagegraph.session import ensure_checkpoint_dir, row_tasks
from pagegraph.sources import results

VOC = triples.Vocabulary()
ONT = VOC.ontology
LOADED = "2026-04-01T00:00:00+00:00"
X = fixed.XSD


def flat(graph: DataFrame) -> DataFrame:
    """Graph columns without nulls, for comparison."""
    return graph.select(
        *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in triples.GRAPH_COLUMNS]
    )


def triple_sql(source: str, dataset: str, subject: str, rows: list[tuple[str, str, str, str]]) -> str:
    """UNION ALL of (predicate, kind, datatype, value expression) over one source."""
    return "\nUNION ALL ".join(
        "SELECT {d} AS dataset_id, {s} AS s, '{p}' AS p, '{k}' AS o_kind, {v} AS o, '{t}' AS o_dt, '' AS o_lang FROM {f}".format(
            d=dataset, s=subject, p=p, k=kind, t=dt, v=value, f=source
        )
        for p, kind, dt, value in rows
    )


# --- rows to triples -----------------------------------------------------------------------------


def customer_records(v: Views) -> DataFrame:
    key = F.col("c_custkey")
    day = F.lpad((key % 28 + 1).cast("string"), 2, "0")
    return v.wide_table("customer").select(
        F.lit("7").alias("dataset_id"),
        key.alias("position"),
        key.alias("id"),
        F.col("c_name").alias("title"),
        F.when(key % 3 == 0, text("Q", key)).alias("qid"),
        F.col("c_acctbal").alias("balance"),
        F.col("c_mktsegment").alias("2nd segment!"),
        (key % 2 == 0).alias("active"),
        F.when(key % 5 == 0, "never").otherwise(text("202401", day, "000000")).alias("touched"),
    )


CUSTOMER_KEYS = ["id", "title", "qid", "balance", "2nd segment!", "active", "touched"]


def customer_rows(v: Views) -> DataFrame:
    records = customer_records(v)
    return triples.list_rows(records, triples.TypedRecord(records.schema, CUSTOMER_KEYS), VOC)


def customer_graph(v: Views) -> DataFrame:
    return triples.graph_set(triples.row_triples(customer_rows(v), VOC, LOADED))


_C_SUBJECT = """CASE WHEN c_custkey % 3 = 0 AND c_custkey > 0 THEN 'http://www.wikidata.org/entity/Q' || c_custkey
    ELSE 'https://pagegraph.example/list/7/item/' || c_custkey END"""
_C_ROWS = [
    (fixed.RDF_TYPE, "iri", "", "'{}Page'".format(ONT)),
    (ONT + "dataset", "literal", X + "integer", "'7'"),
    (ONT + "position", "literal", X + "integer", "CAST(c_custkey AS VARCHAR)"),
    (ONT + "loadedAt", "literal", X + "dateTime", "'{}'".format(LOADED)),
    (ONT + "page_id", "literal", X + "integer", "CAST(c_custkey AS VARCHAR)"),
    (ONT + "title", "literal", "", "c_name"),
    (ONT + "qid", "literal", "", "CASE WHEN c_custkey % 3 = 0 THEN 'Q' || c_custkey END"),
    (ONT + "wikidata_entity", "literal", "", "CASE WHEN c_custkey % 3 = 0 AND c_custkey > 0 THEN 'http://www.wikidata.org/entity/Q' || c_custkey END"),
    (ONT + "balance", "literal", X + "double", "CAST(c_acctbal AS VARCHAR)"),
    (ONT + "field_2nd_segment", "literal", "", "c_mktsegment"),
    (ONT + "active", "literal", X + "boolean", "CASE WHEN c_custkey % 2 = 0 THEN 'true' ELSE 'false' END"),
    (ONT + "touched", "literal", X + "dateTime", "CASE WHEN c_custkey % 5 <> 0 THEN '2024-01-' || lpad(CAST(c_custkey % 28 + 1 AS VARCHAR), 2, '0') || 'T00:00:00Z' END"),
    (ONT + "touched", "literal", "", "CASE WHEN c_custkey % 5 = 0 THEN 'never' END"),
]
C_TRIPLES = "SELECT DISTINCT * FROM ({}) WHERE o IS NOT NULL".format(triple_sql("customer", "'7'", _C_SUBJECT, _C_ROWS))


@query("triples_from_rows", C_TRIPLES)
def triples_from_rows(v: Views) -> DataFrame:
    return flat(customer_graph(v))


@query("triples_from_variant", C_TRIPLES)
def triples_from_variant(v: Views) -> DataFrame:
    """The same rows as JSON objects: keys and types are found in each row."""
    body = F.to_json(F.struct(*[F.col("`{}`".format(k)) for k in CUSTOMER_KEYS]))
    records = customer_records(v).select("dataset_id", "position", F.parse_json(signed_zeros(body)).alias("record"))
    rows = triples.list_rows(records, triples.VariantRecord("record"), VOC)
    return flat(triples.graph_set(triples.row_triples(rows, VOC, LOADED)))


_E_LINK = """CASE event_id % 4 WHEN 0 THEN 'https://x.org/e' || event_id WHEN 1 THEN 'http://www.wikidata.org/entity/Q' || user_id
    WHEN 2 THEN 'https://commons.wikimedia.org/entity/M' || user_id END"""
_E_ROWS = [
    (fixed.RDF_TYPE, "iri", "", "'{}Page'".format(ONT)),
    (ONT + "dataset", "literal", X + "integer", "'9'"),
    (ONT + "position", "literal", X + "integer", "CAST(event_id AS VARCHAR)"),
    (ONT + "loadedAt", "literal", X + "dateTime", "'{}'".format(LOADED)),
    (ONT + "event_id", "literal", X + "integer", "CAST(event_id AS VARCHAR)"),
    (ONT + "value", "literal", X + "double", "CAST(value AS VARCHAR)"),
    (ONT + "link", "iri", "", _E_LINK),
    (ONT + "link", "literal", X + "dateTime", "CASE WHEN event_id % 4 = 3 THEN {} END".format(iso("ts"))),
    (ONT + "img_timestamp", "literal", X + "dateTime", iso("ts")),
    (ONT + "note", "literal", "", "'http://a b ' || event_type"),
]


@query(
    "triples_typed_inferred",
    "SELECT * FROM ({}) WHERE o IS NOT NULL".format(
        triple_sql("events", "'9'", "'https://pagegraph.example/result/9#' || (event_id + 1)", _E_ROWS)
    ),
)
def triples_typed_inferred(v: Views) -> DataFrame:
    key = F.col("event_id")
    link = (
        F.when(key % 4 == 0, text(" https://x.org/e", key))
        .when(key % 4 == 1, text("q", F.col("user_id"), " "))
        .when(key % 4 == 2, text("M", F.col("user_id")))
        .otherwise(digits14(F.col("ts")))
    )
    records = v.wide_table("events").select(
        F.lit("9").alias("dataset_id"),
        key.alias("position"),
        key,
        "value",
        link.alias("link"),
        digits14(F.col("ts")).cast("bigint").alias("img_timestamp"),
        text("http://a b ", F.col("event_type")).alias("note"),
    )
    fields = triples.TypedRecord(records.schema, ["event_id", "value", "link", "img_timestamp", "note"])
    rows = triples.result_rows(records, fields, VOC)
    return flat(triples.graph_set(triples.row_triples(rows, VOC, LOADED)))


_LAT, _LON = "(p_partkey % 200 - 100)", "(p_partkey % 360 - 180)"
_PLACED = "p_partkey % 200 BETWEEN 11 AND 189"


@query(
    "derived_fields",
    """SELECT p_partkey, key, kind, value, s FROM (
         SELECT p_partkey, {media} AS file, unnest(['id', 'namespace', 'qid', 'wikidata_entity', 'thumbnail_image', 'thumbnail_image_file', 'coordinates', 'coordinate_lat', 'coordinate_lon']) AS key,
         unnest(['xsd:integer', 'xsd:integer', 'xsd:string', 'xsd:string', 'xsd:string', 'xsd:string', 'xsd:string', 'xsd:double', 'xsd:double']) AS kind,
         unnest([CAST(p_partkey AS VARCHAR), CAST(p_size AS VARCHAR), {qid}, 'http://www.wikidata.org/entity/' || {qid},
           'https://commons.wikimedia.org/wiki/Special:FilePath/' || {image} || '?width=320', p_name || ' é.png',
           CASE WHEN {ok} THEN {lat} || '.5 / ' || {lon} END,
           CASE WHEN {ok} THEN {lat} || '.5' END, CASE WHEN {ok} THEN {lon} || '.0' END]) AS value,
         CASE WHEN {media} THEN 'https://commons.wikimedia.org/entity/M' || p_partkey WHEN {qid} IS NOT NULL THEN 'http://www.wikidata.org/entity/' || {qid}
           ELSE 'https://pagegraph.example/list/5/item/' || p_partkey END AS s
         FROM part) WHERE value IS NOT NULL
       UNION ALL SELECT p_partkey, 'img_width', 'xsd:integer', CAST(p_size AS VARCHAR),
         CASE WHEN {media} THEN 'https://commons.wikimedia.org/entity/M' || p_partkey WHEN {qid} IS NOT NULL THEN 'http://www.wikidata.org/entity/' || {qid}
           ELSE 'https://pagegraph.example/list/5/item/' || p_partkey END FROM part WHERE p_partkey % 2 = 0""".format(
        qid="CASE WHEN p_partkey % 4 = 1 THEN 'Q' || p_partkey END",
        image=quoted("replace(p_name || ' é.png', ' ', '_')", fixed.SAFE_FILE),
        ok=_PLACED,
        lat=_LAT,
        lon=_LON,
        media="(p_size = 6 AND p_partkey % 2 = 0 AND p_partkey > 0)",
    ),
)
def derived_fields(v: Views) -> DataFrame:
    """Records with a metadata object: item, thumbnail and coordinate fields, and subject choice."""
    key = F.col("p_partkey")
    meta = F.struct(
        text(" ", F.col("p_name"), " é.png").alias("image"),
        text(" ", key % 200 - 100, ".5 / ", key % 360 - 180).alias("coordinates"),
        F.when(key % 4 == 1, text("http://x/q", key)).alias("wikidata"),
    )
    body = F.struct(
        key.alias("id"),
        F.col("p_size").alias("namespace"),
        F.when(key % 2 == 0, F.col("p_size")).alias("img_width"),
        meta.alias("metadata"),
    )
    records = v.wide_table("part").select(
        F.lit("5").alias("dataset_id"), key.alias("position"), F.parse_json(signed_zeros(F.to_json(body))).alias("record")
    )
    rows = triples.list_rows(records, triples.VariantRecord("record"), VOC)
    return rows.select(F.col("position").alias("p_partkey"), "s", F.explode_outer("fields").alias("f")).where(
        F.col("f.value").isNotNull()
    ).select("p_partkey", "s", "f.key", "f.kind", "f.value")


# --- sitelink graphs and fixed profiles ------------------------------------------------------------


def all_page_records(v: Views) -> DataFrame:
    """Records of every page that has an item id, of all wikis."""
    props = v.page_props().where(F.col("pp_propname") == fixed.ITEM_PROPERTY)
    items = props.select("wiki", F.col("pp_page").alias("page_id"), F.col("pp_value").alias("qid_text"))
    stamp = F.when(F.col("page_id") % 2 == 0, text("2024-01-01 0", F.col("page_id") % 10, ":00:00")).alias("timestamp")
    rows = v.page().join(items, ["wiki", "page_id"]).select("wiki", "page_id", "page_title", "page_namespace", "qid_text", stamp)
    # the join leaves few partitions, whatever its size: its rows are small
    rows = rows.repartition(row_tasks(v.table("part")))
    return page_records(rows, v.wikis(), v.siteinfo(), v.namespaces()).withColumn("dataset_id", F.lit("11"))


PAGE_RECORDS = (
    with_ctes("page", "items", "dims", "ns")
    + """, rec AS (
  SELECT p.page_id, p.page_namespace AS namespace, full_title AS page_title, 'https://' || domain || path || {q} AS page_url,
    'https://' || domain || '/' AS site_url, domain AS wiki_domain, wiki AS wiki_dbname,
    CASE WHEN k = 3 THEN lower(page_title) ELSE wiki_group END AS wiki_group,
    CASE WHEN lang <> '' THEN lang WHEN lang_code <> '' THEN lang_code END AS lang_code,
    qid_text AS wikidata_id, 'http://www.wikidata.org/entity/' || qid_text AS wikidata_entity,
    CASE WHEN page_id % 2 = 0 THEN '2024-01-01T0' || (page_id % 10) || ':00:00Z' END AS created_timestamp
  FROM (SELECT page.*, items.qid_text, d.domain, d.path, d.lang, d.lang_code, d.wiki_group, d.k,
          CASE WHEN page_namespace > 0 AND coalesce(ns.name, '') <> '' THEN ns.name || ':' ELSE '' END || page_title AS full_title
        FROM page JOIN items USING (wiki, page_id) JOIN dims d ON d.dbname = page.wiki
        LEFT JOIN ns ON ns.domain = d.domain AND ns.ns_id = page_namespace) p)
""".format(q=quoted("full_title"))
)
_SITE_ROWS = [
    (fixed.RDF_TYPE, "iri", "", "'{}'".format(fixed.SCHEMA_ARTICLE)),
    (ONT + "page_id", "literal", X + "integer", "CAST(page_id AS VARCHAR)"),
    (ONT + "namespace", "literal", X + "integer", "CAST(namespace AS VARCHAR)"),
    (ONT + "page_title", "literal", "", "page_title"),
    (ONT + "wiki_domain", "literal", "", "wiki_domain"),
    (ONT + "wiki_dbname", "literal", "", "wiki_dbname"),
    (ONT + "wikidata_id", "literal", "", "wikidata_id"),
    (ONT + "created_timestamp", "literal", X + "dateTime", "created_timestamp"),
    (fixed.SCHEMA_ABOUT, "iri", "", "wikidata_entity"),
    (fixed.SCHEMA_IN_LANGUAGE, "literal", "", "lang_code"),
    (fixed.SCHEMA_IS_PART_OF, "iri", "", "site_url"),
]


@query(
    "sitelink_triples",
    PAGE_RECORDS
    + "SELECT DISTINCT * FROM ("
    + triple_sql("rec", "'11'", "page_url", _SITE_ROWS)
    + """ UNION ALL SELECT '11', page_url, '{name}', 'literal', replace(page_title, '_', ' '), '', coalesce(lang_code, '') FROM rec
       UNION ALL SELECT '11', site_url, '{grp}', 'literal', wiki_group, '', '' FROM rec) WHERE o IS NOT NULL""".format(
        name=fixed.SCHEMA_NAME, grp=fixed.WIKI_GROUP
    ),
)
def sitelink_triples(v: Views) -> DataFrame:
    return flat(triples.graph_set(triples.sitelink_triples(all_page_records(v), VOC)))


def _profile_flat(lines: DataFrame) -> DataFrame:
    return lines.withColumn("observed_types", F.array_join("observed_types", ",")).drop("field_order")


def _fixed_sql(source: str, rows: list[tuple[str, str, str, str]]) -> str:
    return "SELECT * FROM (" + " UNION ALL ".join(
        """SELECT '{d}' AS dataset_id, '{c}' AS source_key, '{p}' AS predicate, {n} AS present_in_rows, '{k}' AS primary_type,
        '{k}' AS observed_types, '1' AS row_side_cardinality FROM {f}""".format(d=source[1], c=c, p=p, n=n, k=k, f=source[0])
        for c, p, k, n in rows
    ) + ") WHERE present_in_rows > 0"


_PAGE_PROFILE = [
    (c, profile._STANDARD.get(c, ONT + c), profile._TYPES[c], "count({})".format("page_title" if c == "page_label" else c))
    for c in profile.PAGE_FIELDS
    if c != "current_timestamp"
]


@query("profile_fixed", PAGE_RECORDS + _fixed_sql(("rec", "11"), _PAGE_PROFILE))
def profile_fixed(v: Views) -> DataFrame:
    return _profile_flat(profile.fixed_profile(all_page_records(v), VOC))


def part_members(v: Views) -> DataFrame:
    """Category members with ``project/lang/name`` titles; a fifth lacks the language part."""
    key = F.col("p_partkey")
    name = text("Wp/", F.lower("p_type"), "/", F.col("p_name"), " ", key)
    return v.table("part").select(
        F.lit("12").alias("dataset_id"),
        key.alias("page_id"),
        F.when(key % 5 == 0, F.col("p_name")).otherwise(name).alias("title"),
        F.when(key % 3 == 0, 10).otherwise(0).alias("namespace"),
        F.when(key % 4 == 0, "none").otherwise(text("q", key)).alias("sort_key"),
    )


BASE = "https://incubator.wikimedia.org/wiki/"
_M_TITLE = "CASE WHEN p_partkey % 5 = 0 THEN replace(p_name, ' ', '_') ELSE 'Wp/' || lower(p_type) || '/' || replace(p_name || ' ' || p_partkey, ' ', '_') END"


@query(
    "member_records",
    """SELECT p_partkey AS page_id, CAST(CASE WHEN p_partkey % 3 = 0 THEN 10 ELSE 0 END AS BIGINT) AS namespace, {t} AS page_title,
       CASE WHEN p_partkey % 5 = 0 THEN replace(p_name, ' ', '_') ELSE 'Wp' END AS wiki_project,
       CASE WHEN p_partkey % 5 = 0 THEN lower(replace(p_name, ' ', '_')) ELSE 'wikipedia' END AS wiki_group,
       CASE WHEN p_partkey % 5 = 0 THEN '' ELSE lower(p_type) END AS lang_code,
       CASE WHEN p_partkey % 5 = 0 THEN p_name ELSE p_name || ' ' || p_partkey END AS page_label,
       '{b}' || CASE WHEN p_partkey % 3 = 0 THEN 'template:' ELSE '' END || {q} AS page_url,
       CASE WHEN p_partkey % 5 <> 0 THEN '{b}Wp/' || {l} || '/' END AS site_url,
       CASE WHEN p_partkey % 4 <> 0 THEN 'Q' || p_partkey END AS wikidata_id FROM part""".format(
        t=_M_TITLE, b=BASE, q=quoted(_M_TITLE), l=quoted("lower(p_type)")
    ),
)
def member_records_query(v: Views) -> DataFrame:
    records = member_records(part_members(v), BASE, {10: "Template"})
    return records.drop("dataset_id", "page_name", "wikidata_entity")


_MEMBER_COUNTS = {"site_url": "count(CASE WHEN p_partkey % 5 <> 0 THEN 1 END)", "wikidata_entity": "count(CASE WHEN p_partkey % 4 <> 0 THEN 1 END)"}
_MEMBER_COUNTS["wikidata_id"] = _MEMBER_COUNTS["wikidata_entity"]


@query(
    "profile_optional",
    _fixed_sql(
        ("part", "12"),
        [(c, profile._STANDARD.get(c, ONT + c), profile._TYPES[c], _MEMBER_COUNTS.get(c, "count(*)")) for c in profile.MEMBER_FIELDS],
    ),
)
def profile_optional(v: Views) -> DataFrame:
    records = member_records(part_members(v), BASE, {10: "Template"})
    return _profile_flat(profile.fixed_profile(records, VOC, tuple(profile.MEMBER_FIELDS), tuple(profile.MEMBER_OPTIONAL)))


def _profile_sql(dataset: str, rows: list[tuple[str, str, str, str, str]]) -> str:
    return " UNION ALL ".join(
        """SELECT '{d}' AS dataset_id, '{key}' AS source_key, '{o}{name}' AS predicate, {n} AS present_in_rows, {t} AS primary_type,
        {seen} AS observed_types, '{card}' AS row_side_cardinality FROM {f}""".format(
            d=dataset, o=ONT, key=key, name=name, n=n, t=kind.split("|")[0], seen=kind.split("|")[1], card=card, f="{source}"
        )
        for key, name, n, kind, card in rows
    )


_ONE = lambda k: "'{0}'|'{0}'".format(k)


@query(
    "profile_dynamic",
    _profile_sql(
        "7",
        [
            ("id", "page_id", "count(*)", _ONE("xsd:integer"), "1"),
            ("title", "title", "count(*)", _ONE("xsd:string"), "1"),
            ("qid", "qid", "count(CASE WHEN c_custkey % 3 = 0 THEN 1 END)", _ONE("xsd:string"), "M"),
            ("wikidata_entity", "wikidata_entity", "count(CASE WHEN c_custkey % 3 = 0 AND c_custkey > 0 THEN 1 END)", _ONE("xsd:string"), "1"),
            ("balance", "balance", "count(*)", _ONE("xsd:double"), "1"),
            ("2nd segment!", "field_2nd_segment", "count(*)", _ONE("xsd:string"), "1"),
            ("active", "active", "count(*)", _ONE("xsd:boolean"), "1"),
            ("touched", "touched", "count(*)", "'xsd:dateTime'|'xsd:dateTime,xsd:string'", "1"),
        ],
    ).replace("{source}", "customer"),
)
def profile_dynamic(v: Views) -> DataFrame:
    return _profile_flat(profile.profile(customer_rows(v), VOC))


# --- links -----------------------------------------------------------------------------------------


def link_records(v: Views) -> DataFrame:
    """Parts as records with a link cell: own page, a page that is not there, an item page, rubbish."""
    key = F.col("p_partkey")
    wiki = wiki_of(key)
    space = F.col("p_size") % 16
    title = text(F.when(space != 0, "X:").otherwise(""), F.col("p_name"), " ", key)
    cell = text(
        " ", wiki, ":", space, ":", title, " |enwiki: 0 :Missing ", key, "|bad||wikidatawiki:0:q", key + 1, "|", wiki, ":0x:foo|", F.upper(wiki), ":", space, ":", title
    )
    return v.wide_table("part").select(F.lit("3").alias("dataset_id"), key.alias("position"), key.alias("id"), cell.alias("gil"))


_L_TITLE = "CASE WHEN p_size % 16 <> 0 THEN 'X:' ELSE '' END || replace(p_name || ' ' || p_partkey, ' ', '_')"
LINKS = """SELECT p_partkey AS position, unnest([0, 1, 2]) AS link_pos,
  unnest(['https://nation-' || (p_partkey % 5) || '.wikipedia.org/wiki/' || {q}, 'https://en.wikipedia.org/wiki/Missing_' || p_partkey,
    'https://www.wikidata.org/wiki/q' || (p_partkey + 1)]) AS uri,
  unnest([{w}, 'enwiki', 'wikidatawiki']) AS site, unnest([p_size % 16, 0, 0]) AS namespace,
  unnest([{t}, 'Missing_' || p_partkey, 'q' || (p_partkey + 1)]) AS api_title,
  unnest([replace(p_name || ' ' || p_partkey, ' ', '_'), 'Missing_' || p_partkey, 'q' || (p_partkey + 1)]) AS db_title
  FROM part""".format(q=quoted(_L_TITLE), t=_L_TITLE, w=wiki_sql("p_partkey"))


@query("link_targets", LINKS)
def link_targets(v: Views) -> DataFrame:
    return links.explode_links(link_records(v), ["position"], "gil").select(
        "position", "link_pos", "uri", "site", "namespace", "api_title", "db_title"
    )


def enriched_links(v: Views) -> DataFrame:
    records = link_records(v)
    subject = triples.item_subject(triples.TypedRecord(records.schema, ["id", "gil"]), VOC, F.col("dataset_id"), F.col("position"))
    exploded = links.explode_links(records.withColumn("s", subject), ["dataset_id", "position", "s"], "gil")
    found = links.table_lookup(links.lookup_targets(exploded), v.page(), v.page_props(), v.latest_revision())
    return links.attach_enrichment(exploded, found)


ENRICHED = """SELECT l.position, l.link_pos, l.uri, CASE WHEN link_pos = 0 AND p_size % 5 <> 0 OR link_pos = 2 THEN 'Q' || (p_partkey + 1) END AS qid,
  CASE WHEN link_pos = 0 THEN CAST(floor(p_retailprice) AS BIGINT) END AS page_len, CASE WHEN link_pos = 0 THEN {t} END AS rev_timestamp
  FROM ({l}) l JOIN part ON p_partkey = l.position LEFT JOIN events ON event_id = p_partkey""".format(t=iso("ts"), l=LINKS)


@query(
    "link_enrichment",
    """SELECT position, link_pos, uri, qid, CAST(page_len AS VARCHAR) AS page_len, rev_timestamp,
       CASE WHEN qid IS NULL AND page_len IS NULL AND rev_timestamp IS NULL THEN 0 ELSE 1 END AS enriched FROM ({})""".format(ENRICHED),
)
def link_enrichment(v: Views) -> DataFrame:
    return enriched_links(v).select(
        "position", "link_pos", "uri", "qid", F.col("page_len").cast("string").alias("page_len"), "rev_timestamp",
        F.col("enriched").cast("int").alias("enriched"),
    )


_LT = "SELECT '3' AS dataset_id, {s} AS s, '" + ONT + "{p}' AS p, '{k}' AS o_kind, {v} AS o, '{d}' AS o_dt, '' AS o_lang FROM e"
LINK_TRIPLES = "WITH e AS ({}) SELECT DISTINCT * FROM (".format(ENRICHED) + " UNION ALL ".join(
    _LT.format(s=s, p=p, k=k, v=value, d=d)
    for s, p, k, value, d in [
        ("'https://pagegraph.example/list/3/item/' || position", "gil_link", "iri", "uri", ""),
        ("uri", "gil_link_page_len", "literal", "CAST(page_len AS VARCHAR)", X + "integer"),
        ("uri", "gil_link_rev_timestamp", "literal", "rev_timestamp", X + "dateTime"),
        ("uri", "gil_link_wikidata_id", "literal", "qid", ""),
        ("uri", "gil_link_wikidata_entity", "iri", "'http://www.wikidata.org/entity/' || qid", ""),
    ]
) + ") WHERE o IS NOT NULL"


@query("link_triples", LINK_TRIPLES)
def link_triples(v: Views) -> DataFrame:
    return flat(triples.graph_set(triples.field_triples(links.link_fields(enriched_links(v)), VOC)))


@query(
    "profile_links",
    "WITH e AS ({}) ".format(ENRICHED)
    + _profile_sql(
        "3",
        [
            ("id", "page_id", "count(DISTINCT position)", _ONE("xsd:integer"), "1"),
            ("gil", "gil", "count(DISTINCT position)", _ONE("xsd:string"), "1"),
            ("gil_link_count", "gil_link_count", "count(DISTINCT position)", _ONE("xsd:integer"), "1"),
            ("gil_link", "gil_link", "count(DISTINCT position)", _ONE("iri"), "M"),
            ("gil_link_page_len", "gil_link_page_len", "count(DISTINCT CASE WHEN page_len IS NOT NULL THEN position END)", _ONE("xsd:integer"), "1"),
            ("gil_link_rev_timestamp", "gil_link_rev_timestamp", "count(DISTINCT CASE WHEN rev_timestamp IS NOT NULL THEN position END)", _ONE("xsd:dateTime"), "1"),
            ("gil_link_wikidata_id", "gil_link_wikidata_id", "count(DISTINCT CASE WHEN qid IS NOT NULL THEN position END)", _ONE("xsd:string"), "M"),
            ("gil_link_wikidata_entity", "gil_link_wikidata_entity", "count(DISTINCT CASE WHEN qid IS NOT NULL THEN position END)", _ONE("iri"), "M"),
        ],
    ).replace("{source}", "e"),
)
def profile_links(v: Views) -> DataFrame:
    """Rows with their own fields and everything their links emit."""
    records = link_records(v)
    rows = triples.list_rows(records, triples.TypedRecord(records.schema, ["id", "gil"]), VOC)
    return _profile_flat(profile.profile(rows, VOC, links.link_fields(enriched_links(v))))


@query(
    "alias_resolve",
    """WITH RECURSIVE a AS (SELECT 'T' || p_partkey AS source, CASE WHEN p_partkey % 3 = 0 THEN 'T' || (p_partkey // 3)
         WHEN p_partkey % 9 = 1 THEN 'T' || (p_partkey + 1) ELSE 'T' || (p_partkey - 1) END AS target
         FROM part WHERE p_partkey % 3 = 0 OR p_partkey % 9 IN (1, 2)),
       w(title, cur, seen) AS (SELECT 'T' || p_partkey, 'T' || p_partkey, CAST([] AS VARCHAR[]) FROM part
         UNION ALL SELECT w.title, a.target, list_append(w.seen, w.cur) FROM w JOIN a ON a.source = w.cur
         WHERE NOT list_contains(w.seen, w.cur) AND a.target <> w.cur)
       SELECT title, arg_max(cur, len(seen)) AS final_title FROM w GROUP BY title""",
)
def alias_resolve(v: Views) -> DataFrame:
    """Chains that end, a title that points to itself, and pairs that point to each other."""
    key = F.col("p_partkey")
    target = (
        F.when(key % 3 == 0, text("T", F.floor(key / 3).cast("bigint"))).when(key % 9 == 1, text("T", key + 1)).when(key % 9 == 2, text("T", key - 1))
    )
    part = v.table("part").select(F.lit("w").alias("wiki"), text("T", key).alias("title"), target.alias("target"))
    aliases = part.where(F.col("target").isNotNull()).select("wiki", F.col("title").alias("source"), "target")
    return links.resolve_aliases(part.select("wiki", "title"), aliases).select("title", "final_title")


@query(
    "alias_lookup",
    """WITH RECURSIVE a AS (SELECT 'T' || p_partkey AS source, 'T' || (p_partkey // 3) AS target FROM part WHERE p_partkey % 3 = 0 AND p_partkey > 0),
       w(title, cur) AS (SELECT 'T' || p_partkey, 'T' || p_partkey FROM part UNION ALL SELECT w.title, a.target FROM w JOIN a ON a.source = w.cur),
       f AS (SELECT title, cur AS final_title FROM w WHERE cur NOT IN (SELECT source FROM a)),
       pages AS (SELECT 'T' || p_partkey AS title, 'Q' || p_partkey AS qid FROM part WHERE p_partkey % 4 <> 1)
       SELECT f.title, coalesce(x.qid, y.qid) AS qid FROM f LEFT JOIN pages x ON x.title = f.final_title LEFT JOIN pages y ON y.title = f.title
       WHERE coalesce(x.qid, y.qid) IS NOT NULL""",
)
def alias_lookup(v: Views) -> DataFrame:
    """Pages by the title at the end of the aliases, else by the title asked for."""
    key = F.col("p_partkey")
    part = v.table("part").select(F.lit("w").alias("wiki"), text("T", key).alias("title"), key.alias("k"))
    aliases = part.where("k % 3 = 0 and k > 0").select("wiki", F.col("title").alias("source"), text("T", F.floor(F.col("k") / 3)).alias("target"))
    pages = part.where("k % 4 <> 1").select(
        "wiki", "title", text("Q", F.col("k")).alias("qid"), F.lit(None).cast("bigint").alias("page_len"), F.lit(None).cast("string").alias("rev_timestamp")
    )
    return links.alias_lookup(part.select("wiki", "title"), aliases, pages).select("title", "qid")


_RESULT = "SELECT CAST(o_orderkey // {n} AS VARCHAR) AS dataset_id, 'https://pagegraph.example/result/' || (o_orderkey // {n}) || '#' || (o_orderkey % {n} + 1) AS s,".format(n=PAYLOAD_ROWS)
_RESULT_ROWS = [
    (fixed.RDF_TYPE, "iri", "", "'{}'".format(VOC.iri("Page"))),
    (ONT + "dataset", "literal", X + "integer", "CAST(o_orderkey // {} AS VARCHAR)".format(PAYLOAD_ROWS)),
    (ONT + "position", "literal", X + "integer", "CAST(o_orderkey % {} AS VARCHAR)".format(PAYLOAD_ROWS)),
    (ONT + "loadedAt", "literal", X + "dateTime", "'{}'".format(LOADED)),
    (ONT + "page_id", "literal", X + "integer", "CAST(o_orderkey AS VARCHAR)"),
    (ONT + "page_title", "literal", "", "'Page ' || o_orderkey"),
    (ONT + "page_namespace", "literal", X + "integer", "CAST(o_orderkey % 3 AS VARCHAR)"),
    (ONT + "seen", "literal", X + "dateTime", "'20' || substr({}, 3)".format(iso("o_orderdate"))),
    (ONT + "page_uri", "iri", "", "'https://' || d.domain || d.path || CASE WHEN coalesce(ns.name, '') <> '' THEN ns.name || ':' ELSE '' END || 'Page_' || o_orderkey"),
]


@query(
    "result_graph",
    with_ctes("dims", "ns")
    + " UNION ALL ".join(
        "{} '{}' AS p, '{}' AS o_kind, {} AS o, '{}' AS o_dt, '' AS o_lang FROM orders JOIN dims d ON d.k = 1 LEFT JOIN ns ON ns.domain = d.domain AND ns.ns_id = o_orderkey % 3".format(
            _RESULT, p, kind, value, dt
        )
        for p, kind, dt, value in _RESULT_ROWS
    ),
)
def result_graph(v: Views) -> DataFrame:
    """From SQL-result payloads to their graph: headers, derived page addresses, inferred types."""
    key = F.col("o_orderkey")
    seen = F.concat(F.lit("20"), F.substring(digits14(F.col("o_orderdate")), 3, 12))
    row = text("[", key, ',"Page ', key, '",', key % 3, ',"', seen, '"]')
    docs = result_documents(v.table("orders"), "o_orderkey", row)
    payload = text('{"headers":["id","page title","page-namespace","seen"],"rows":[', F.array_join("items", ","), "]}")
    rows = results.result_rows(docs.select("payload_id", payload.alias("json")), ["payload_id"], "json")
    rows = rows.select(F.col("payload_id").cast("string").alias("dataset_id"), "position", F.lit("nation-1.wikipedia.org").alias("domain"), "fields")
    rows = results.with_page_uris(rows, v.siteinfo(), v.namespaces())
    records = results.result_records(rows, ["dataset_id", "position"])
    graph = triples.row_triples(triples.result_rows(records, triples.VariantRecord("record"), VOC), VOC, LOADED)
    return flat(triples.graph_set(graph))


_ITEM = "'https://pagegraph.example/list/3/item/' || position"


@query(
    "page_list_graph",
    LINK_TRIPLES
    + " UNION "
    + " UNION ".join(
        _LT.format(s=_ITEM, p="{p}", k=k, v=value, d=d).replace("'" + ONT + "{p}'", "'" + p + "'")
        for p, k, value, d in [
            (fixed.RDF_TYPE, "iri", "'{}'".format(VOC.iri("Page")), ""),
            (ONT + "dataset", "literal", "'3'", X + "integer"),
            (ONT + "position", "literal", "CAST(position AS VARCHAR)", X + "integer"),
            (ONT + "loadedAt", "literal", "'{}'".format(LOADED), X + "dateTime"),
            (ONT + "page_id", "literal", "CAST(position AS VARCHAR)", X + "integer"),
            (ONT + "gil_link_count", "literal", "'3'", X + "integer"),
        ]
    ),
)
def page_list_graph(v: Views) -> DataFrame:
    """The whole graph of a page list in one set, without the raw link cell: rows, links, and what is known of them."""
    records = link_records(v)
    rows = triples.list_rows(records, triples.TypedRecord(records.schema, ["id", "gil"]), VOC)
    graph = triples.row_triples(rows, VOC, LOADED).where(F.col("p") != VOC.iri("gil"))
    return flat(triples.graph_set(graph.unionByName(triples.field_triples(links.link_fields(enriched_links(v)), VOC))))


# --- the flagship ------------------------------------------------------------------------------------


def order_link_graph(v: Views) -> Graph:
    """Orders as items with a date, line items as their links with an entity and a date."""
    orders = v.table("orders").withColumn("dataset_id", F.lit("1"))
    item = text("https://pagegraph.example/list/1/item/", F.col("o_orderkey"))
    rows = triples.virtual_triples(
        orders,
        {
            "namespace": ("xsd:integer", F.col("o_custkey") % 16),
            "title": ("xsd:string", F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderpriority"))),
            "img_timestamp": ("xsd:dateTime", ntz_text(F.col("o_orderdate"))),
        },
        VOC,
        item,
    )
    lines = v.table("lineitem").withColumn("dataset_id", F.lit("1"))
    host = F.when(F.col("l_suppkey") % 2 == 0, "https://en.wikipedia.org/wiki/").otherwise("https://de.wikipedia.org/wiki/")
    link = text(host, "L", F.col("l_orderkey"), "_", F.col("l_linenumber"))
    owner = text("https://pagegraph.example/list/1/item/", F.col("l_orderkey"))
    on_item = triples.virtual_triples(lines, {"gil_link": ("iri", link)}, VOC, owner, page_class=False)
    on_link = triples.virtual_triples(
        lines,
        {
            "gil_link_wikidata_entity": ("iri", text(fixed.ITEM_ENTITY, "Q", F.col("l_partkey") + 1)),
            "gil_link_rev_timestamp": ("xsd:dateTime", F.when(F.col("l_linenumber") % 3 != 0, ntz_text(F.col("l_shipdate")))),
        },
        VOC,
        link,
        page_class=False,
    )
    # an order is one row, so its triples are distinct already; line items may repeat
    return Graph(rows.unionByName(triples.graph_set(on_item.unionByName(on_link))))


FLAGSHIP_SQL = """WITH links AS (SELECT DISTINCT l_orderkey, CASE WHEN l_suppkey % 2 = 0 THEN 'https://en.wikipedia.org/wiki/' ELSE 'https://de.wikipedia.org/wiki/' END
    || 'L' || l_orderkey || '_' || l_linenumber AS link FROM lineitem),
  facts AS (SELECT CASE WHEN l_suppkey % 2 = 0 THEN 'https://en.wikipedia.org/wiki/' ELSE 'https://de.wikipedia.org/wiki/' END
    || 'L' || l_orderkey || '_' || l_linenumber AS link, l_partkey, l_linenumber, l_shipdate FROM lineitem),
  entity AS (SELECT DISTINCT link, 'http://www.wikidata.org/entity/Q' || (l_partkey + 1) AS entity FROM facts),
  stamp AS (SELECT DISTINCT link, l_shipdate AS d FROM facts WHERE l_linenumber % 3 <> 0)
  SELECT 'https://pagegraph.example/list/1/item/' || o_orderkey AS item, CAST(o_custkey % 16 AS VARCHAR) AS namespace,
    CASE WHEN o_orderkey % 4 <> 0 THEN o_orderpriority END AS title, links.link AS gil_link, entity AS gil_link_wikidata_entity,
    {rev} AS gil_link_rev_timestamp, {img} AS img_timestamp,
    CAST(abs((year(o_orderdate) - year(d)) * 365 + (month(o_orderdate) - month(d)) * 30 + (day(o_orderdate) - day(d))) AS VARCHAR) AS days_diff
  FROM orders JOIN links ON l_orderkey = o_orderkey AND links.link LIKE 'https://en.wikipedia.org/wiki/%'
  JOIN entity ON entity.link = links.link LEFT JOIN stamp ON stamp.link = links.link""".format(
    rev=iso("d"), img=iso("o_orderdate")
)


@query("flagship_days_diff", FLAGSHIP_SQL)
def flagship_days_diff(v: Views) -> DataFrame:
    """Items whose date differs most from the date of their English link."""
    graph = order_link_graph(v)
    p = VOC.iri
    link = graph.match("?item", p("gil_link"), "?gil_link", address=True).filter(
        lambda s: F.startswith(s.value("gil_link"), F.lit("https://en.wikipedia.org/wiki/"))
    )
    entity = graph.match("?gil_link", p("gil_link_wikidata_entity"), "?gil_link_wikidata_entity", address=True)
    stamp = graph.match("?gil_link", p("gil_link_rev_timestamp"), "?gil_link_rev_timestamp")
    found = (
        graph.match("?item", fixed.RDF_TYPE, p("Page"))
        .optional(graph.match("?item", p("namespace"), "?namespace"))
        .optional(graph.match("?item", p("title"), "?title"))
        .optional(graph.match("?item", p("img_timestamp"), "?img_timestamp"))
        .join(link.join(entity).optional(stamp))
    )

    def days(s: g.Solutions) -> Column:
        a, b = s.term("img_timestamp"), s.term("gil_link_rev_timestamp")
        return F.abs(
            (terms.year(a) - terms.year(b)) * 365 + (terms.month(a) - terms.month(b)) * 30 + (terms.day(a) - terms.day(b))
        )

    rows = found.df.select(*[found.value(n).alias(n) for n in found.variables], days(found).alias("_days"))
    # items and links tell equal differences apart, else all rows without one would be sorted by one task
    return rows.orderBy(F.desc("_days"), "item", "gil_link").select(
        "item", "namespace", "title", "gil_link", "gil_link_wikidata_entity", "gil_link_rev_timestamp", "img_timestamp",
        F.col("_days").cast("string").alias("days_diff"),
    )


# --- pattern operators -------------------------------------------------------------------------------


def trade_graph(v: Views, build=triples.virtual_triples) -> Graph:
    """Nations, customers and orders as one graph of three datasets."""
    customers = v.table("customer").withColumn("dataset_id", F.lit("customers"))
    orders = v.table("orders").withColumn("dataset_id", F.lit("orders"))
    nations = v.table("nation").withColumn("dataset_id", F.lit("nations"))
    c = build(
        customers,
        {
            "title": ("xsd:string", F.col("c_name")),
            "segment": ("xsd:string", F.col("c_mktsegment")),
            "nation": ("iri", text("urn:n:", F.col("c_nationkey"))),
            "balance": ("xsd:integer", F.floor("c_acctbal").cast("bigint")),
        },
        VOC,
        text("urn:c:", F.col("c_custkey")),
    )
    o = build(
        orders,
        {
            "status": ("xsd:string", F.col("o_orderstatus")),
            "customer": ("iri", text("urn:c:", F.col("o_custkey"))),
            "total": ("xsd:integer", F.floor("o_totalprice").cast("bigint")),
            "date": ("xsd:dateTime", ntz_text(F.col("o_orderdate"))),
        },
        VOC,
        text("urn:o:", F.col("o_orderkey")),
    )
    n = build(
        nations, {"name": ("xsd:string", F.col("n_name")), "region": ("iri", text("urn:r:", F.col("n_regionkey")))}, VOC, text("urn:n:", F.col("n_nationkey"))
    )
    return Graph(c.unionByName(o).unionByName(n))


P = VOC.iri
_TITLE = "'urn:c:' || c_custkey"


@query("g_optional", """SELECT 'urn:o:' || o_orderkey AS o, 'urn:c:' || o_custkey AS c, c_name AS title, c_mktsegment AS segment
    FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_mktsegment = 'BUILDING'""")
def g_optional(v: Views) -> DataFrame:
    """A nested optional block with a filter inside."""
    gr = trade_graph(v)
    block = gr.match("?c", P("title"), "?title").join(gr.match("?c", P("segment"), "?segment"))
    return gr.match("?o", P("customer"), "?c", address=True).optional(
        block, lambda s: terms.str_(s.term("segment")) == "BUILDING"
    ).values("o", "c", "title", "segment")


@query("g_union", """SELECT DISTINCT x, title, d FROM (SELECT {} AS x, c_name AS title, CAST(NULL AS VARCHAR) AS d FROM customer WHERE c_mktsegment = 'BUILDING'
    UNION ALL SELECT 'urn:o:' || o_orderkey, NULL, {} FROM orders WHERE o_orderstatus = 'F')""".format(_TITLE, iso("o_orderdate")))
def g_union(v: Views) -> DataFrame:
    gr = trade_graph(v)
    left = gr.match("?x", P("segment"), Lit("BUILDING")).join(gr.match("?x", P("title"), "?title"))
    right = gr.match("?x", P("status"), Lit("F")).join(gr.match("?x", P("date"), "?d"))
    return left.union(right).distinct().values("x", "title", "d")


@query("g_minus", """SELECT {t} AS c, c_name AS title FROM customer
    WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""".format(t=_TITLE))
def g_minus(v: Views) -> DataFrame:
    """Customers without a pending order."""
    gr = trade_graph(v)
    pending = gr.match("?o", P("status"), Lit("P")).join(gr.match("?o", P("customer"), "?c", address=True)).project("c")
    return gr.match("?c", P("title"), "?title").minus(pending).values("c", "title")


@query("g_minus_disjoint", "SELECT {t} AS c, c_name AS title FROM customer".format(t=_TITLE))
def g_minus_disjoint(v: Views) -> DataFrame:
    """A subtraction whose sides share no variable removes nothing."""
    gr = trade_graph(v)
    return gr.match("?c", P("title"), "?title").minus(gr.match("?other", P("status"), Lit("P"))).values("c", "title")


@query("g_minus_intended", """SELECT 'urn:o:' || o_orderkey AS o, 'urn:c:' || o_custkey AS c FROM orders
    WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')""")
def g_minus_intended(v: Views) -> DataFrame:
    """Exclusion on equal values of differently named variables: rename, then subtract."""
    gr = trade_graph(v)
    excluded = gr.match("?page", P("segment"), Lit("MACHINERY")).project("page").rename(page="c")
    return gr.match("?o", P("customer"), "?c", address=True).minus(excluded).values("o", "c")


@query("g_exists", """SELECT {t} AS c, c_name AS title FROM customer
    WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND floor(o_totalprice) > 400000)
      AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')""".format(t=_TITLE))
def g_exists(v: Views) -> DataFrame:
    gr = trade_graph(v)
    orders = gr.match("?o", P("customer"), "?c", address=True)
    large = orders.join(gr.match("?o", P("total"), "?total")).project("c", "total")
    final = orders.join(gr.match("?o", P("status"), Lit("F"))).project("c")
    return (
        gr.match("?c", P("title"), "?title")
        .exists(large, condition=lambda s: terms.number(s.term("total")) > 400000)
        .exists(final, negate=True)
        .values("c", "title")
    )


@query("g_values", """SELECT {t} AS c, c_mktsegment AS segment, CASE c_mktsegment WHEN 'BUILDING' THEN 'urn:x:1' ELSE 'urn:x:2' END AS mark
    FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')""".format(t=_TITLE))
def g_values(v: Views) -> DataFrame:
    rows = [(Lit("BUILDING"), "urn:x:1"), (Lit("MACHINERY"), "urn:x:2")]
    return trade_graph(v).match("?c", P("segment"), "?segment").values_join(["segment", "mark"], rows).values("c", "segment", "mark")


@query("g_subselect", """SELECT {t} AS c, c_name AS title, CAST(n AS VARCHAR) AS n FROM customer JOIN (SELECT o_custkey, count(*) AS n FROM orders
    GROUP BY o_custkey ORDER BY n DESC, 'urn:c:' || o_custkey LIMIT 20) ON o_custkey = c_custkey""".format(t=_TITLE))
def g_subselect(v: Views) -> DataFrame:
    """The twenty customers with most orders, then their titles."""
    gr = trade_graph(v)
    counted = gr.match("?o", P("customer"), "?c", address=True).group(["c"], n=g.count())
    top = g.Solutions(counted, certain={"c", "n"}, addresses={"c"}).order_by(F.desc("n"), F.asc("c")).limit(20)
    joined = top.join(gr.match("?c", P("title"), "?title"))
    return joined.df.select("c", joined.value("title").alias("title"), F.col("n").cast("string").alias("n"))


@query("g_exist_node", "SELECT DISTINCT 'urn:c:' || o_custkey AS c FROM orders WHERE o_orderstatus <> ''")
def g_exist_node(v: Views) -> DataFrame:
    gr = trade_graph(v)
    return gr.match("?o", P("customer"), "?c", address=True).exists(gr.match("?o", P("status"), None)).project("c").distinct().values("c")


@query("g_group", """SELECT o_orderstatus AS status, count(*) AS orders, count(DISTINCT o_custkey) AS customers,
    CAST(sum(floor(o_totalprice)) AS BIGINT) AS total, CAST(min(floor(o_totalprice)) AS BIGINT) AS low, CAST(max(floor(o_totalprice)) AS BIGINT) AS high,
    CAST(floor(avg(floor(o_totalprice))) AS BIGINT) AS mean, CAST(0 AS BIGINT) AS nothing, string_agg(DISTINCT o_orderstatus, ' ') AS names
    FROM orders GROUP BY o_orderstatus HAVING count(*) > 10""")
def g_group(v: Views) -> DataFrame:
    gr = trade_graph(v)
    s = gr.match("?o", P("status"), "?status").join(gr.match("?o", P("customer"), "?c", address=True)).join(gr.match("?o", P("total"), "?total"))
    number = terms.whole(s.term("total"))
    return s.group(
        ["status"],
        having=F.col("orders") > 10,
        orders=g.count(),
        customers=g.count_distinct(s.value("c")),
        total=g.total(number).cast("bigint"),
        low=F.min(number).cast("bigint"),
        high=F.max(number).cast("bigint"),
        mean=F.floor(g.mean(number)).cast("bigint"),
        nothing=g.total(F.when(F.lit(False), number)).cast("bigint"),
        names=g.group_concat(s.value("status"), distinct=True),
    )


@query("g_order", """SELECT c, title, balance FROM (SELECT {t} AS c, c_name AS title, CAST(CASE WHEN c_mktsegment = 'BUILDING' THEN CAST(floor(c_acctbal) AS BIGINT) END AS VARCHAR) AS balance,
    CASE WHEN c_mktsegment = 'BUILDING' THEN CAST(floor(c_acctbal) AS BIGINT) END AS b FROM customer) ORDER BY b ASC NULLS FIRST, c LIMIT 50 OFFSET 100""".format(t=_TITLE))
def g_order(v: Views) -> DataFrame:
    """Unbound values come first; limit and offset follow a total order."""
    gr = trade_graph(v)
    block = gr.match("?c", P("balance"), "?balance").join(gr.match("?c", P("segment"), Lit("BUILDING")))
    s = gr.match("?c", P("title"), "?title").optional(block)
    return s.order_by(terms.whole(s.term("balance")).asc(), s.value("c").asc()).offset(100).limit(50).values("c", "title", "balance")


@query("g_bind_filter", """SELECT {t} AS c, CAST(CAST(floor(c_acctbal) AS BIGINT) * 2 AS VARCHAR) AS twice, upper(c_mktsegment) AS big FROM customer
    WHERE floor(c_acctbal) > 5000""".format(t=_TITLE))
def g_bind_filter(v: Views) -> DataFrame:
    gr = trade_graph(v)
    s = gr.match("?c", P("balance"), "?balance").join(gr.match("?c", P("segment"), "?segment"))
    s = s.filter(lambda q: terms.number(q.term("balance")) > 5000)
    s = s.bind("twice", lambda q: terms.literal((terms.whole(q.term("balance")) * 2).cast("string"), fixed.XSD_INTEGER))
    s = s.bind("big", lambda q: terms.literal(terms.ucase(q.term("segment"))))
    return s.values("c", "twice", "big")


def code_graph(v: Views) -> Graph:
    """One spelling per nation under two datatypes, a language, and as an address; some have none."""
    code, turn = F.col("c_nationkey").cast("string"), F.col("c_custkey") % 5
    rows = v.table("customer").where(turn < 4).select(
        F.lit("codes").alias("dataset_id"),
        text("urn:c:", F.col("c_custkey")).alias("s"),
        F.lit(P("code")).alias("p"),
        F.when(turn == 3, "iri").otherwise("literal").alias("o_kind"),
        code.alias("o"),
        F.when(turn == 0, fixed.XSD_INTEGER).alias("o_dt"),
        F.when(turn == 2, "en").alias("o_lang"),
    )
    return Graph(rows)


_CODES = """codes AS (SELECT 'urn:c:' || c_custkey AS c, CASE WHEN c_custkey % 5 = 3 THEN 'iri' ELSE 'literal' END AS kind, CAST(c_nationkey AS VARCHAR) AS value,
    CASE WHEN c_custkey % 5 = 0 THEN '{}' END AS datatype, CASE WHEN c_custkey % 5 = 2 THEN 'en' END AS lang FROM customer WHERE c_custkey % 5 < 4)""".format(fixed.XSD_INTEGER)


@query("g_group_terms", "WITH {} SELECT kind, value, datatype, lang, count(*) AS n FROM codes GROUP BY kind, value, datatype, lang".format(_CODES))
def g_group_terms(v: Views) -> DataFrame:
    """Groups are terms: one spelling under several datatypes, languages and kinds stays apart."""
    s = code_graph(v).match("?c", P("code"), "?code")
    return s.group(["code"], as_terms=True, n=g.count()).select("code.*", "n")


@query("g_optional_chain", """SELECT 'urn:o:' || o_orderkey AS o, 'urn:c:' || c_custkey AS c, c_name AS title FROM orders
    LEFT JOIN customer ON c_custkey = o_custkey AND c_mktsegment = 'BUILDING' WHERE o_orderstatus = 'F'""")
def g_optional_chain(v: Views) -> DataFrame:
    """An optional part on a variable that an earlier optional part may leave unbound."""
    gr = trade_graph(v)
    buyer = gr.match("?o", P("customer"), "?c", address=True).join(gr.match("?c", P("segment"), Lit("BUILDING")))
    s = gr.match("?o", P("status"), Lit("F")).optional(buyer).optional(gr.match("?c", P("title"), "?title"))
    return s.values("o", "c", "title")


@query("g_order_terms", """WITH {}, every AS (SELECT 'urn:c:' || c_custkey AS c FROM customer)
    SELECT c, kind, value FROM every LEFT JOIN codes USING (c) ORDER BY CASE WHEN kind IS NULL THEN 0 WHEN kind = 'iri' THEN 2 ELSE 3 END,
    CASE WHEN kind = 'literal' AND datatype IS NULL THEN 2 ELSE 0 END, CASE WHEN datatype IS NOT NULL THEN CAST(value AS INTEGER) END, value, lang NULLS FIRST, c
    LIMIT 40 OFFSET (SELECT count(*) * 7 // 10 FROM customer)""".format(_CODES))
def g_order_terms(v: Views) -> DataFrame:
    """Term order: unbound, addresses, numbers by value, then texts."""
    gr = code_graph(v)
    everyone = v.table("customer").select(text("urn:c:", F.col("c_custkey")).alias("c"))
    s = g.Solutions(everyone, certain={"c"}, addresses={"c"}).optional(gr.match("?c", P("code"), "?code"))
    skip = v.table("customer").count() * 7 // 10
    found = s.order_terms("code", "c").offset(skip).limit(40)
    return found.df.select("c", F.col("code.kind").alias("kind"), F.col("code.value").alias("value"))


@query("graph_rewrite", """SELECT CAST(c_custkey % 3 AS VARCHAR) AS dataset_id, 'urn:c:' || c_custkey AS s, p, CASE WHEN p LIKE '%title' THEN c_name ELSE c_mktsegment END AS o
    FROM customer, (SELECT unnest(['{0}', '{1}']) AS p) WHERE c_custkey % 3 = 2 OR (c_custkey % 3 = 0 AND p = '{0}')""".format(P("title"), P("segment")))
def graph_rewrite(v: Views) -> DataFrame:
    """A graph written twice: dataset 0 with fewer predicates, dataset 1 without triples, dataset 2 untouched."""
    customer = v.table("customer").withColumn("dataset_id", (F.col("c_custkey") % 3).cast("string"))
    fields = {"title": ("xsd:string", F.col("c_name")), "segment": ("xsd:string", F.col("c_mktsegment"))}
    graph = triples.virtual_triples(customer, fields, VOC, text("urn:c:", F.col("c_custkey")), page_class=False)
    path = "{}/graph-{}".format(ensure_checkpoint_dir(v.spark), uuid.uuid4().hex)
    sinks.write_graph(graph, path)
    sinks.write_graph(graph.where((F.col("dataset_id") == "0") & (F.col("p") == P("title"))), path, datasets=["0", "1"])
    return sinks.read_graph(v.spark, path).select("dataset_id", "s", "p", "o")


def redirect_graph(v: Views) -> Graph:
    """Every third part points to the part with a third of its number."""
    key = F.col("p_partkey")
    part = v.table("part").where(key % 3 == 0).withColumn("dataset_id", F.lit("parts"))
    to = text("urn:p:", F.floor(key / 3).cast("bigint"))
    return Graph(triples.virtual_triples(part, {"redirectsTo": ("iri", to)}, VOC, text("urn:p:", key), page_class=False))


_EDGE = "e AS (SELECT 'urn:p:' || p_partkey AS a, 'urn:p:' || (p_partkey // 3) AS b FROM part WHERE p_partkey % 3 = 0)"


@query("g_path", """WITH RECURSIVE {e}, r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
    n AS (SELECT a AS x FROM e UNION SELECT b FROM e)
    SELECT 'plus' AS path, a, b FROM r UNION ALL SELECT * FROM (SELECT 'star', a, b FROM r UNION SELECT 'star', x, x FROM n)
    UNION ALL SELECT 'seq', e1.a, e2.b FROM e e1 JOIN e e2 ON e2.a = e1.b
    UNION ALL SELECT 'inv', b, a FROM e
    UNION ALL SELECT 'alt', a, b FROM e UNION ALL SELECT 'alt', b, a FROM e
    UNION ALL SELECT * FROM (SELECT 'opt', a, b FROM e UNION SELECT 'opt', x, x FROM n)
    UNION ALL SELECT * FROM (SELECT 'from', a, b FROM r WHERE a = 'urn:p:81' UNION SELECT 'from', 'urn:p:81', 'urn:p:81')
    UNION ALL SELECT * FROM (SELECT 'into', a, b FROM r WHERE b = 'urn:p:1' UNION SELECT 'into', 'urn:p:1', 'urn:p:1')
    UNION ALL SELECT DISTINCT 'then', 'urn:p:9', r.b FROM e JOIN r ON r.a = e.b WHERE e.a = 'urn:p:9'""".format(e=_EDGE))
def g_path(v: Views) -> DataFrame:
    gr = redirect_graph(v)
    to = P("redirectsTo")
    paths = {
        "plus": g.plus(to), "star": g.star(to), "seq": g.seq(to, to), "inv": g.inv(to), "alt": g.alt(to, g.inv(to)), "opt": g.opt(to),
    }
    out = None
    for name, path in paths.items():
        rows = gr.path("?a", path, "?b").values("a", "b").select(F.lit(name).alias("path"), "a", "b")
        out = rows if out is None else out.unionByName(rows)
    one = gr.path("urn:p:81", g.star(to), "?b").values("b").select(F.lit("from").alias("path"), F.lit("urn:p:81").alias("a"), "b")
    into = gr.path("?a", g.star(to), "urn:p:1").values("a").select(F.lit("into").alias("path"), "a", F.lit("urn:p:1").alias("b"))
    then = gr.path("urn:p:9", g.seq(to, g.plus(to)), "?b").values("b").select(F.lit("then").alias("path"), F.lit("urn:p:9").alias("a"), "b")
    return out.unionByName(one).unionByName(into).unionByName(then)


@query("g_construct", """SELECT DISTINCT * FROM (
    SELECT 'made' AS dataset_id, 'urn:c:' || c_custkey AS s, 'urn:livesIn' AS p, 'literal' AS o_kind, n_name AS o, '' AS o_dt, '' AS o_lang FROM customer JOIN nation ON n_nationkey = c_nationkey
    UNION ALL SELECT 'made', 'urn:n:' || n_nationkey, 'urn:has', 'iri', 'urn:c:' || c_custkey, '', '' FROM customer JOIN nation ON n_nationkey = c_nationkey
    UNION ALL SELECT 'made', 'urn:n:' || n_nationkey, 'urn:label', 'literal', 'nation', '', 'en' FROM customer JOIN nation ON n_nationkey = c_nationkey
    UNION ALL SELECT 'made', 'urn:c:' || c_custkey, 'urn:rich', 'literal', CAST(CAST(floor(c_acctbal) AS BIGINT) AS VARCHAR), '{x}', '' FROM customer WHERE c_mktsegment = 'BUILDING')""".format(x=fixed.XSD_INTEGER))
def g_construct(v: Views) -> DataFrame:
    gr = trade_graph(v)
    rich = gr.match("?c", P("balance"), "?rich").join(gr.match("?c", P("segment"), Lit("BUILDING")))
    s = gr.match("?c", P("nation"), "?n", address=True).join(gr.match("?n", P("name"), "?name")).optional(rich)
    made = s.construct(
        "made",
        [("?c", "urn:livesIn", "?name"), ("?n", "urn:has", "?c"), ("?n", "urn:label", Lit("nation", lang="en")), ("?c", "urn:rich", "?rich")],
    )
    return flat(made)


@query("g_describe", """SELECT 'customers' AS dataset_id, 'urn:c:' || c_custkey AS s, p, o_kind, o, o_dt, '' AS o_lang FROM (
    SELECT c_custkey, unnest(['{t}', '{o}title', '{o}segment', '{o}nation', '{o}balance']) AS p, unnest(['iri', 'literal', 'literal', 'iri', 'literal']) AS o_kind,
    unnest(['{o}Page', c_name, c_mktsegment, 'urn:n:' || c_nationkey, CAST(CAST(floor(c_acctbal) AS BIGINT) AS VARCHAR)]) AS o,
    unnest(['', '', '', '', '{x}']) AS o_dt FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'))""".format(t=fixed.RDF_TYPE, o=ONT, x=fixed.XSD_INTEGER))
def g_describe(v: Views) -> DataFrame:
    gr = trade_graph(v)
    s = gr.match("?o", P("status"), Lit("P")).join(gr.match("?o", P("customer"), "?c", address=True))
    return flat(s.describe(trade_graph(v, triples.scanned_triples), "c"))


@query("federated_join", """SELECT 'urn:o:' || o_orderkey AS o, c_name AS title, n_name AS name FROM orders JOIN customer ON c_custkey = o_custkey
    JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 1""")
def federated_join(v: Views) -> DataFrame:
    """Patterns over three datasets joined on shared variables."""
    gr = trade_graph(v)
    nations, customers, orders = gr.dataset("nations"), gr.dataset("customers"), gr.dataset("orders")
    return (
        nations.match("?n", P("region"), "urn:r:1")
        .join(nations.match("?n", P("name"), "?name"))
        .join(customers.match("?c", P("nation"), "?n", address=True))
        .join(customers.match("?c", P("title"), "?title"))
        .join(orders.match("?o", P("customer"), "?c", address=True))
        .values("o", "title", "name")
    )


@query("g_compatible_join", """SELECT 'urn:o:' || o_orderkey AS o, c_mktsegment AS segment, m.mark FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_custkey % 2 = 0
    JOIN (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 2 = 0 THEN 'BUILDING' ELSE 'MACHINERY' END AS seg, o_orderstatus AS mark FROM orders) m
    ON m.k = o_orderkey AND (c_mktsegment IS NULL OR c_mktsegment = m.seg)""".replace("c_mktsegment AS segment", "coalesce(c_mktsegment, m.seg) AS segment"))
def g_compatible_join(v: Views) -> DataFrame:
    """Join after an optional part: an unbound variable is compatible with every value."""
    customers = v.table("customer").where(F.col("c_custkey") % 2 == 0).select("c_custkey", "c_mktsegment")
    seg = terms.literal(F.col("c_mktsegment"))
    orders = v.table("orders")
    named = g.Solutions(
        orders.join(customers, F.col("o_custkey") == F.col("c_custkey"), "left").select(
            text("urn:o:", F.col("o_orderkey")).alias("o"), F.when(F.col("c_mktsegment").isNotNull(), seg).alias("segment")
        ),
        certain={"o"}, maybe={"segment"}, addresses={"o"},
    )
    want = F.when(F.col("o_orderkey") % 2 == 0, "BUILDING").otherwise("MACHINERY")
    marks = g.Solutions(
        orders.select(text("urn:o:", F.col("o_orderkey")).alias("o"), terms.literal(want).alias("segment"), terms.literal(F.col("o_orderstatus")).alias("mark")),
        certain={"o", "segment", "mark"}, addresses={"o"},
    )
    return named.join(marks).values("o", "segment", "mark")


@query("wide_view", """SELECT {t} AS item, c_name AS title, c_mktsegment AS segment, 'urn:n:' || c_nationkey AS nation, n_name AS name
    FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey
    UNION ALL SELECT 'urn:o:' || o_orderkey, NULL, NULL, NULL, NULL FROM orders
    UNION ALL SELECT 'urn:n:' || n_nationkey, NULL, NULL, NULL, NULL FROM nation""".format(t=_TITLE))
def wide_view(v: Views) -> DataFrame:
    view = g.wide_view(
        trade_graph(v), P("Page"), {"title": P("title"), "segment": P("segment"), "nation": P("nation")}, nested={"nation": {"name": P("name")}}
    )
    return view.values("item", "title", "segment", "nation", "name")


@query("term_functions", """SELECT s, p, o AS str, CASE WHEN o_kind = 'iri' THEN 1 ELSE 0 END AS is_iri,
    CASE WHEN o_dt IN ('{x}integer', '{x}double') THEN 1 ELSE 0 END AS is_number,
    CASE WHEN o_kind = 'literal' THEN CASE WHEN o_dt = '' THEN '{x}string' ELSE o_dt END END AS datatype,
    upper(o) AS upper, CAST(length(o) AS BIGINT) AS size, md5(o) AS digest, CASE WHEN o LIKE '%#%' THEN split_part(o, '#', 2) ELSE '' END AS after,
    CASE WHEN o_dt = '{x}dateTime' THEN CAST(CAST(substr(o, 9, 2) AS BIGINT) AS VARCHAR) END AS day,
    CASE WHEN regexp_matches(o, '^C.*9$') THEN 1 ELSE 0 END AS matched FROM ({c})""".format(x=X, c=C_TRIPLES))
def term_functions(v: Views) -> DataFrame:
    """Scalar functions on every object of the customer graph."""
    o = F.col("o_term")
    graph = customer_graph(v).select("s", "p", g.object_term().alias("o_term"))
    return graph.select(
        "s",
        "p",
        terms.str_(o).alias("str"),
        terms.is_iri(o).cast("int").alias("is_iri"),
        terms.is_numeric(o).cast("int").alias("is_number"),
        terms.datatype(o).alias("datatype"),
        terms.ucase(o).alias("upper"),
        terms.strlen(o).cast("bigint").alias("size"),
        terms.md5(o).alias("digest"),
        terms.strafter(o, "#").alias("after"),
        terms.day(o).cast("string").alias("day"),
        terms.regex(o, "^C.*9$").cast("int").alias("matched"),
    )


# --- writers and summaries ---------------------------------------------------------------------------

_LINE = """'<' || s || '> <' || p || '> ' || CASE WHEN o_kind = 'iri' THEN '<' || o || '>' WHEN o_dt <> '' THEN '"' || o || '"^^<' || o_dt || '>'
    ELSE '"' || o || '"' END || ' .'"""


@query("ntriples", "SELECT {} AS line FROM ({})".format(_LINE, C_TRIPLES))
def ntriples(v: Views) -> DataFrame:
    return sinks.ntriples(customer_graph(v))


@query("ntriples_escapes", """SELECT doc_id, md5('"' || replace(replace(replace(replace(text || chr(13) || '\\"', '\\', '\\\\'), chr(10), '\\n'), chr(13), '\\r'), '"', '\\"') || '"@' || lang) AS line_md5
    FROM documents""")
def ntriples_escapes(v: Views) -> DataFrame:
    """Whole documents as language-tagged literals."""
    cell = terms.term("literal", text(F.col("text"), "\r\\\""), None, F.col("lang"))
    return v.wide_table("documents").select("doc_id", F.md5(terms.ntriples_term(cell)).alias("line_md5"))


@query("json_bindings", """SELECT '{"c":{"type":"uri","value":"urn:c:' || c_custkey || '"},"title":{"type":"literal","value":"' || c_name || '"}'
    || CASE WHEN c_mktsegment = 'BUILDING' THEN ',"balance":{"type":"literal","value":"' || CAST(floor(c_acctbal) AS BIGINT) || '","datatype":"%s"}' ELSE '' END || '}' AS binding
    FROM customer""" % fixed.XSD_INTEGER)
def json_bindings(v: Views) -> DataFrame:
    gr = trade_graph(v)
    block = gr.match("?c", P("balance"), "?balance").join(gr.match("?c", P("segment"), Lit("BUILDING")))
    return sinks.json_bindings(gr.match("?c", P("title"), "?title").optional(block))


@query("ask", "SELECT CASE WHEN count(*) > 0 THEN 1 ELSE 0 END AS answer, 'some' AS kind FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 0, 'none'")
def ask(v: Views) -> DataFrame:
    gr = trade_graph(v)
    some = gr.match("?o", P("status"), Lit("F")).ask().select(F.col("answer").cast("int").alias("answer"), F.lit("some").alias("kind"))
    none = gr.match("?o", P("status"), Lit("no such")).ask().select(F.col("answer").cast("int").alias("answer"), F.lit("none").alias("kind"))
    return some.unionByName(none)


@query("snapshot_stats", "SELECT count(*) AS triple_count, CAST(sum(octet_length(encode({l})) + 1) AS BIGINT) AS byte_count FROM ({c})".format(l=_LINE, c=C_TRIPLES))
def snapshot_stats(v: Views) -> DataFrame:
    return sinks.snapshot_stats(sinks.ntriples(customer_graph(v)).select(text(F.col("line"), " \t").alias("line")))


@query("snapshot_lines", "SELECT {} AS line FROM ({})".format(_LINE, C_TRIPLES))
def snapshot_lines(v: Views) -> DataFrame:
    return sinks.snapshot_lines(sinks.ntriples(customer_graph(v)))


_DIGEST = "CAST('0x' || substr(md5('{}' || line), 1, 15) AS BIGINT)"


@query("graph_signature", """SELECT '7' AS dataset_id, count(*) AS triple_count, bit_xor({a}) AS xor_digest,
    CAST(sum(CAST({a} AS HUGEINT)) % 1152921504606846976 AS BIGINT) AS sum_a, CAST(sum(CAST({b} AS HUGEINT)) % 1152921504606846976 AS BIGINT) AS sum_b
    FROM (SELECT {l} AS line FROM ({c}))""".format(a=_DIGEST.format("a"), b=_DIGEST.format("b"), l=_LINE, c=C_TRIPLES))
def graph_signature(v: Views) -> DataFrame:
    return sinks.graph_signature(customer_graph(v))


@query("predicate_counts", "SELECT dataset_id, p, count(*) AS triples FROM ({}) GROUP BY dataset_id, p".format(C_TRIPLES))
def predicate_counts(v: Views) -> DataFrame:
    return sinks.predicate_counts(customer_graph(v))


# --- catalog -----------------------------------------------------------------------------------------

AS_OF = "1998-10-03T00:30:00Z"


def order_catalog(v: Views) -> DataFrame:
    key = F.col("o_orderkey")
    fi = F.array(F.lit("fi"), F.lit("sv"))
    params = (
        F.when(key % 4 == 0, F.create_map(F.lit("limit"), F.array(F.lit("5")), F.lit("wiki"), fi))
        .when(key % 4 == 2, F.create_map(F.lit("wiki"), fi, F.lit("limit"), F.array(F.lit("5"))))
        .otherwise(F.create_map(F.lit("wiki"), fi))
    )
    return v.table("orders").select(
        key.cast("string").alias("dataset_id"),
        F.floor("o_totalprice").cast("bigint").alias("records"),
        F.when(key % 7 == 0, " ").otherwise("https://x.org/").alias("source_url"),
        params.alias("source_params"),
        F.replace(F.substring(F.col("o_orderdate").cast("string"), 1, 19), F.lit(" "), F.lit("T")).alias("loaded_at"),
        "o_orderstatus",
    )


@query("catalog_fresh", """SELECT CAST(o_orderkey AS VARCHAR) AS dataset_id, CAST(floor(o_totalprice) AS BIGINT) AS records FROM orders
    WHERE o_orderkey % 2 = 0 AND o_orderkey % 7 <> 0 AND o_orderdate >= TIMESTAMP '1998-10-03 00:00:00'""")
def catalog_fresh(v: Views) -> DataFrame:
    wanted = F.create_map(F.lit("wiki"), F.array(F.lit("fi"), F.lit("sv")), F.lit("limit"), F.array(F.lit("5")))
    return catalog.fresh(order_catalog(v), AS_OF, wanted).select("dataset_id", "records")


@query("catalog_expired", """SELECT CAST(o_orderkey AS VARCHAR) AS dataset_id FROM orders
    WHERE o_orderdate < TIMESTAMP '1998-10-02 00:30:00' AND o_orderstatus <> 'F'""")
def catalog_expired(v: Views) -> DataFrame:
    lines = order_catalog(v)
    return catalog.expired(lines, AS_OF, keep=lines.where(F.col("o_orderstatus") == "F")).select("dataset_id")


@query("catalog_rows", "SELECT '7' AS dataset_id, count(*) AS records, CAST(8 AS BIGINT) AS field_count, '{}' AS loaded_at FROM customer".format(LOADED))
def catalog_rows(v: Views) -> DataFrame:
    rows = customer_rows(v)
    params = F.create_map(F.lit("wiki"), F.array(F.lit("fi")))
    lines = catalog.catalog_rows(rows, profile.profile(rows, VOC), F.lit("https://x.org/"), params, LOADED)
    return lines.select("dataset_id", "records", F.size("fields").cast("bigint").alias("field_count"), "loaded_at")


def mixed_graph(v: Views) -> Graph:
    """Customers in seven groups: whole numbers; with doubles; with decimals; with texts; texts of a language; with addresses; doubles."""
    key, turn = F.col("c_custkey"), F.col("c_custkey") % 7
    odd = F.floor(key / 7) % 2 == 1
    half, quarter = (key * 0.5).cast("double").cast("string"), (key * 0.25).cast("double").cast("string")
    plain = (turn == 0) | (turn.isin(1, 2, 3, 5) & ~odd)
    value = F.when(plain, key.cast("string")).when(turn == 1, half).when(turn == 2, text(key, ".25")).when(turn == 6, quarter)
    value = value.when(turn == 5, text("urn:c:", key)).otherwise(text("w", key))
    kind = F.when(plain, X + "integer").when(turn.isin(1, 6), X + "double").when(turn == 2, X + "decimal")
    row = lambda p, o_kind, o, dt, lang: F.struct(F.lit(P(p)).alias("p"), o_kind.alias("o_kind"), o.alias("o"), dt.alias("o_dt"), lang.alias("o_lang"))
    none = F.lit(None).cast("string")
    both = F.array(
        row("group", F.lit("literal"), text("g", turn), none, none),
        row("value", F.when((turn == 5) & odd, "iri").otherwise("literal"), value, kind, F.when(turn == 4, "en")),
    )
    rows = v.table("customer").select(F.lit("mixed").alias("dataset_id"), text("urn:c:", key).alias("s"), F.explode(both).alias("t"))
    return Graph(rows.select("dataset_id", "s", "t.*"))


_DECIMAL = "rtrim(rtrim(CAST({0} // 1000000000000000000 AS VARCHAR) || '.' || lpad(CAST({0} % 1000000000000000000 AS VARCHAR), 18, '0'), '0'), '.')"

_TERM_AGGREGATES = """WITH r AS (SELECT c_custkey AS k, c_custkey % 7 AS g, (c_custkey // 7) % 2 = 1 AS odd FROM customer),
    t AS (SELECT k, g, CASE WHEN g = 0 OR (g IN (1, 2, 3, 5) AND NOT odd) THEN 0 WHEN g = 2 THEN 1 WHEN g IN (1, 6) THEN 2 END AS width,
      CASE WHEN g = 5 AND odd THEN 'urn:c:' || k WHEN g IN (3, 4) AND (g = 4 OR odd) THEN 'w' || k END AS word FROM r),
    n AS (SELECT *, CASE WHEN width = 0 THEN CAST(k AS HUGEINT) * 100 WHEN width = 1 THEN CAST(k AS HUGEINT) * 100 + 25 END AS cents,
      CASE WHEN width = 0 THEN CAST(k AS DOUBLE) WHEN width = 1 THEN k + 0.25 WHEN g = 1 THEN k * 0.5 ELSE k * 0.25 END AS num,
      CASE WHEN width = 0 THEN CAST(k AS VARCHAR) WHEN width = 1 THEN k || '.25' WHEN g = 1 THEN CAST(CAST(k * 0.5 AS DOUBLE) AS VARCHAR)
      WHEN g = 6 THEN CAST(CAST(k * 0.25 AS DOUBLE) AS VARCHAR) ELSE word END AS txt FROM t),
    a AS (SELECT g, bool_or(width IS NULL) AS bad, max(width) AS width, sum(cents) AS cents, sum(CASE WHEN width IS NOT NULL THEN num END) AS num, count(*) AS c,
      arg_min(txt, CASE WHEN width IS NULL THEN NULL ELSE num END) AS low_n, arg_max(txt, CASE WHEN width IS NULL THEN NULL ELSE num END) AS high_n,
      min(word) AS low_w, max(word) AS high_w FROM n GROUP BY g),
    b AS (SELECT *, CAST(cents AS HUGEINT) * 10000000000000000 AS s, (2 * CAST(cents AS HUGEINT) * 10000000000000000 + c) // (2 * c) AS q FROM a)
    SELECT 'g' || g AS grp,
      CASE WHEN NOT bad THEN CASE width WHEN 2 THEN CAST(CAST(num AS DOUBLE) AS VARCHAR) ELSE {s} END END AS total,
      CASE WHEN NOT bad THEN CASE width WHEN 0 THEN 'integer' WHEN 1 THEN 'decimal' ELSE 'double' END END AS total_type,
      CASE WHEN NOT bad THEN CASE width WHEN 2 THEN CAST(CAST(num AS DOUBLE) / c AS VARCHAR) ELSE {q} END END AS mean,
      CASE WHEN NOT bad THEN CASE WHEN width < 2 THEN 'decimal' ELSE 'double' END END AS mean_type,
      CASE WHEN g = 5 THEN low_w ELSE coalesce(low_n, low_w) END AS least, CASE WHEN g = 5 THEN high_n ELSE coalesce(high_w, high_n) END AS greatest
    FROM b""".format(s=_DECIMAL.format("s"), q=_DECIMAL.format("q"))


@query("g_term_aggregates", _TERM_AGGREGATES)
def g_term_aggregates(v: Views) -> DataFrame:
    """SUM, AVG, MIN and MAX over terms: the widest numeric type counts, other terms make a sum unbound."""
    gr = mixed_graph(v)
    s = gr.match("?c", P("group"), "?grp").join(gr.match("?c", P("value"), "?v"))
    t = s.term("v")
    found = s.group(["grp"], total=g.total_term(t), mean=g.mean_term(t), least=g.least_term(t), greatest=g.greatest_term(t))
    kind = lambda c: F.substring_index(F.col(c + ".datatype"), "#", -1).alias(c + "_type")
    plain = [F.col(c + ".value").alias(c) for c in ("total", "mean", "least", "greatest")]
    return found.select("grp", *plain, kind("total"), kind("mean"))


@query("g_optional_loose", """WITH l AS (SELECT o_orderkey AS o, c_custkey AS c FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_mktsegment = 'BUILDING' WHERE o_orderstatus = 'F'),
    r AS (SELECT o_orderkey AS o, c_custkey AS c, CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) AS total FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND floor(c_acctbal) > 0)
    SELECT 'urn:o:' || l.o AS o, 'urn:c:' || coalesce(l.c, r.c) AS c, total FROM l JOIN r ON r.o = l.o""")
def g_optional_loose(v: Views) -> DataFrame:
    """An optional part whose shared variable may be unbound on either side: bound values must agree, others fill in."""
    gr = trade_graph(v)
    rich = gr.match("?c", P("balance"), "?b").filter(lambda s: terms.number(s.term("b")) > 0)
    buyer = lambda side: gr.match("?o", P("customer"), "?c", address=True).join(side)
    left = gr.match("?o", P("status"), Lit("F")).optional(buyer(gr.match("?c", P("segment"), Lit("BUILDING"))))
    right = gr.match("?o", P("total"), "?total").optional(buyer(rich))
    return left.optional(right).values("o", "c", "total")
