"""Whole-table jobs that apply the column expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagegraph.functions import fixed, times, wiki
from pagegraph.functions import text as t
from pagegraph.operators.changes import split_full_title
from pagegraph.operators.selection import select_wikis
from pagegraph.operators.triples import page_uri_columns
from pagegraph.plans.registry import query
from pagegraph.plans.views import CTE, Views, iso, quoted, stripped, text, wiki_sql, with_ctes


@query(
    "title_norm",
    """SELECT doc_id, md5(title) AS title_md5, length(title) AS title_length,
       CASE WHEN title <> raw THEN 1 ELSE 0 END AS changed
       FROM (SELECT doc_id, ' :' || text || ' ' AS raw,
             replace(ltrim({s}, ':'), ' ', '_') AS title FROM documents)""".format(s=stripped("' :' || text || ' '")),
)
def title_norm(v: Views) -> DataFrame:
    raw = text(" :", F.col("text"), " ")
    title = t.page_title(raw)
    return v.wide_table("documents").select(
        "doc_id",
        F.md5(title).alias("title_md5"),
        F.length(title).cast("bigint").alias("title_length"),
        (title != raw).cast("int").alias("changed"),
    )


_QID_CELL = """CASE p_partkey % 4 WHEN 0 THEN 'Q' || p_partkey WHEN 1 THEN 'http://x.org/entity/q' || p_partkey
    WHEN 2 THEN p_name ELSE 'item Q0 q' || p_partkey END"""


@query(
    "qid_norm",
    """SELECT p_partkey, CASE WHEN p_partkey % 4 = 2 OR p_partkey = 0 THEN NULL ELSE 'Q' || p_partkey END AS qid
       FROM part""",
)
def qid_norm(v: Views) -> DataFrame:
    return v.wide_table("part").select("p_partkey", t.qid(F.expr(_QID_CELL)).alias("qid"))


@query(
    "time_norm",
    """SELECT event_id, CASE event_id % 6 WHEN 2 THEN {shift} WHEN 3 THEN {day} WHEN 4 THEN NULL ELSE {now} END AS normalized,
       CASE event_id % 6 WHEN 2 THEN strftime(ts - INTERVAL 2 HOUR, '%Y%m%d%H%M%S') WHEN 3 THEN strftime(ts, '%Y%m%d') || '000000'
       WHEN 4 THEN NULL ELSE strftime(ts, '%Y%m%d%H%M%S') END AS time_key FROM events""".format(
        shift=iso("ts - INTERVAL 2 HOUR"), day="strftime(ts, '%Y-%m-%dT00:00:00Z')", now=iso("ts")
    ),
)
def time_norm(v: Views) -> DataFrame:
    plain = F.rpad(F.col("ts").cast("string"), 26, "0")
    second = F.substring(plain, 1, 19)
    cell = (
        F.when(F.col("event_id") % 6 == 0, F.regexp_replace(second, "[^0-9]", ""))
        .when(F.col("event_id") % 6 == 1, text(F.replace(second, F.lit(" "), F.lit("T")), "Z"))
        .when(F.col("event_id") % 6 == 2, text(" ", F.replace(second, F.lit(" "), F.lit("T")), ".5+02:00"))
        .when(F.col("event_id") % 6 == 3, F.substring(plain, 1, 10))
        .when(F.col("event_id") % 6 == 4, text("bad ", second))
        .otherwise(second)
    )
    return v.wide_table("events").select(
        "event_id", times.xsd_datetime(cell).alias("normalized"), times.numeric_time(cell).cast("string").alias("time_key")
    )


@query(
    "partial_times",
    """SELECT event_id, d || repeat('0', CAST(14 - length(d) AS BIGINT)) AS padded,
       CASE WHEN length(d) = 4 THEN strftime(ts, '%Y-01-01T00:00:00Z') WHEN length(d) = 6 THEN strftime(ts, '%Y-%m-01T00:00:00Z')
       WHEN length(d) = 8 THEN strftime(ts, '%Y-%m-%dT00:00:00Z') WHEN length(d) = 10 THEN strftime(ts, '%Y-%m-%dT%H:00:00Z')
       WHEN length(d) = 12 THEN strftime(ts, '%Y-%m-%dT%H:%M:00Z') ELSE strftime(ts, '%Y-%m-%dT%H:%M:%SZ') END AS lower_bound
       FROM (SELECT event_id, ts, substr(strftime(ts, '%Y%m%d%H%M%S'), 1, CAST(4 + 2 * (event_id % 6) AS BIGINT)) AS d FROM events)""",
)
def partial_times(v: Views) -> DataFrame:
    cut = F.substring(times.digits14(F.col("ts")), F.lit(1), (4 + 2 * (F.col("event_id") % 6)).cast("int"))
    padded = times.padded_timestamp(cut)
    return v.wide_table("events").select("event_id", padded.alias("padded"), times.lower_bound_time(padded).alias("lower_bound"))


_CELL_SQL = "p_name || ' é/(' || p_brand || '):, 50%*~+?&'"


@query(
    "quote_path",
    "SELECT p_partkey, {} AS path, {} AS file, {} AS whole FROM part".format(
        quoted(_CELL_SQL), quoted(_CELL_SQL, fixed.SAFE_FILE), quoted(_CELL_SQL, "")
    ),
)
def quote_path(v: Views) -> DataFrame:
    cell = text(F.col("p_name"), " é/(", F.col("p_brand"), "):, 50%*~+?&")
    return v.wide_table("part").select(
        "p_partkey",
        t.quote(cell).alias("path"),
        t.quote(cell, fixed.SAFE_FILE).alias("file"),
        t.quote(cell, fixed.SAFE_NONE).alias("whole"),
    )


_HOST = "regexp_extract(url, '^https?://([^/?#]+)', 1)"


@query(
    "url_parts",
    """SELECT page_id, CASE WHEN page_id % 3 < 2 THEN {h} END AS domain,
       CASE page_id % 3 WHEN 0 THEN 'Title_' || page_id || '_é' WHEN 1 THEN 'C_' || page_id END AS title
       FROM pages""".format(h=_HOST),
)
def url_parts(v: Views) -> DataFrame:
    host = F.regexp_extract("url", r"^https?://([^/?#]+)", 1)
    cell = (
        F.when(F.col("page_id") % 3 == 0, text("https://", host, "/wiki/Title%20", F.col("page_id"), "%20%C3%A9?x=1#y"))
        .when(F.col("page_id") % 3 == 1, text("http://", host, "/w/index.php?title=A+b&title=C%20", F.col("page_id")))
        .otherwise(F.col("url"))
    )
    pages = v.wide_table("pages").select("page_id", wiki.page_from_url(cell).alias("page"))
    return pages.select("page_id", "page.domain", "page.title")


@query(
    "host_valid",
    """SELECT page_id, CASE WHEN page_id % 4 IN (0, 3) THEN 1 ELSE 0 END AS valid, {h} AS host FROM pages""".format(h=_HOST),
)
def host_valid(v: Views) -> DataFrame:
    host = wiki.url_host(F.col("url"))
    cell = (
        F.when(F.col("page_id") % 4 == 0, F.upper(host))
        .when(F.col("page_id") % 4 == 1, F.lit("localhost"))
        .when(F.col("page_id") % 4 == 2, text("-", host))
        .otherwise(text(" ", host, "."))
    )
    return v.wide_table("pages").select("page_id", wiki.host_valid(cell).cast("int").alias("valid"), host.alias("host"))


@query(
    "site_domains",
    """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'ab-' || p_partkey || '.wikipedia.org' WHEN 1 THEN 'x' || p_partkey || '.wikisource.org'
       WHEN 2 THEN 'commons.wikimedia.org' WHEN 3 THEN NULL WHEN 4 THEN NULL ELSE 'y' || p_partkey || '.wiktionary.org' END AS domain,
       CASE p_partkey % 6 WHEN 0 THEN 'wikipedia' WHEN 1 THEN 'wikisource' WHEN 2 THEN 'commons' WHEN 3 THEN 'no.such' || p_partkey
       WHEN 4 THEN 'wikipedia' ELSE 'wiktionary' END AS wiki_group FROM part""",
)
def site_domains(v: Views) -> DataFrame:
    key = F.col("p_partkey")
    site = (
        F.when(key % 6 == 0, text(" AB_", key, "wiki "))
        .when(key % 6 == 1, text("x", key, "wikisource"))
        .when(key % 6 == 2, "commonswiki")
        .when(key % 6 == 3, text("no.such", key))
        .when(key % 6 == 4, text("foo..", key, "wiki"))
        .otherwise(text("y", key, "wiktionary"))
    )
    return v.wide_table("part").select("p_partkey", wiki.site_domain(site).alias("domain"), wiki.site_group(site).alias("wiki_group"))


_PROJECT = "CASE p_partkey % 3 WHEN 0 THEN 'Wp' WHEN 1 THEN 'Wt' ELSE 'Zz' END"
_NAME = "replace(p_name, ' ', '_') || '/' || p_partkey"


@query(
    "title_split",
    """SELECT p_partkey, {p} AS project, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE lower(p_type) END AS lang,
       CASE p_partkey % 4 WHEN 0 THEN {p} WHEN 1 THEN lower(p_type) ELSE {n} END AS name,
       CASE p_partkey % 3 WHEN 0 THEN 'wikipedia' WHEN 1 THEN 'wiktionary' ELSE 'zz' END AS wiki_group,
       CASE WHEN p_partkey % 4 <> 0 THEN 'https://incubator.wikimedia.org/wiki/' || {p} || '/' || {ql} || '/' END AS site_url
       FROM part""".format(p=_PROJECT, n=_NAME, ql=quoted("lower(p_type)")),
)
def title_split(v: Views) -> DataFrame:
    project = F.expr(_PROJECT)
    lang = F.lower("p_type")
    name = text(F.replace("p_name", F.lit(" "), F.lit("_")), "/", F.col("p_partkey"))
    title = (
        F.when(F.col("p_partkey") % 4 == 0, project)
        .when(F.col("p_partkey") % 4 == 1, text(project, "/", lang))
        .otherwise(text(project, "/", lang, "/", name))
    )
    parts = wiki.project_parts(title)
    return v.wide_table("part").select(
        "p_partkey",
        parts["project"].alias("project"),
        parts["lang"].alias("lang"),
        parts["name"].alias("name"),
        wiki.project_title_group(title).alias("wiki_group"),
        wiki.project_site_url(F.lit("https://incubator.wikimedia.org/wiki/"), parts["project"], parts["lang"]).alias("site_url"),
    )


@query(
    "namespace_split",
    """SELECT p_partkey, CAST(CASE p_partkey % 4 WHEN 0 THEN 2 WHEN 1 THEN 14 ELSE 0 END AS BIGINT) AS ns_id,
       CASE WHEN p_partkey % 4 = 2 THEN 'Unknown:' ELSE '' END || replace(p_name || ' ' || p_partkey, ' ', '_') AS db_title
       FROM part""",
)
def namespace_split(v: Views) -> DataFrame:
    prefix = F.expr("CASE p_partkey % 4 WHEN 0 THEN 'uSER 1:' WHEN 1 THEN 'cat: ' WHEN 2 THEN 'Unknown:' ELSE '' END")
    titles = v.wide_table("part").select(
        "p_partkey", F.lit("nation-1.wikipedia.org").alias("domain"), text(prefix, F.col("p_name"), " ", F.col("p_partkey")).alias("title")
    )
    titles = titles.withColumn("title", F.regexp_replace("title", "^cat: ", "cat:"))
    return split_full_title(titles, "title", v.aliases()).select("p_partkey", "ns_id", "db_title")


@query(
    "user_norm",
    """SELECT c_custkey, CASE WHEN c_custkey % 5 = 4 THEN NULL ELSE replace(c_name, '#', ' ') END AS user_name,
       CASE WHEN c_custkey % 5 = 4 THEN NULL ELSE lower(replace(c_name, '#', ' ')) END AS user_key,
       CASE WHEN c_custkey % 5 = 4 THEN NULL ELSE 'user_1' END AS prefix FROM customer""",
)
def user_norm(v: Views) -> DataFrame:
    raw = F.when(F.col("c_custkey") % 5 == 4, "  ").otherwise(text(" ", F.replace("c_name", F.lit("#"), F.lit("_")), "/sub/page "))
    user = wiki.local_user(raw)
    named = wiki.namespaced_user(text("User 1:", raw))
    return v.wide_table("customer").select(
        "c_custkey", user.alias("user_name"), t.casefold(user).alias("user_key"), named["prefix"].alias("prefix")
    )


@query(
    "user_page_refs",
    """SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'meta.wikimedia.org' WHEN 1 THEN 'fi.wikipedia.org' WHEN 2 THEN 'sv.wikibooks.org'
       WHEN 3 THEN 'www.wikidata.org' END AS domain,
       CASE WHEN c_custkey % 5 < 4 THEN 'User:' || c_name END AS title,
       CASE c_custkey % 5 WHEN 0 THEN ':meta:User:' WHEN 1 THEN ':w:fi:User:' WHEN 2 THEN ':b:sv:User:' WHEN 3 THEN ':d:User:' END
         || CASE WHEN c_custkey % 5 < 4 THEN c_name END AS reference FROM customer""",
)
def user_page_refs(v: Views) -> DataFrame:
    name = F.col("c_name")
    quoted_name = F.replace(name, F.lit("#"), F.lit("%23"))
    raw = (
        F.when(F.col("c_custkey") % 5 == 0, text(":Meta: User:", name))
        .when(F.col("c_custkey") % 5 == 1, text("w:FI:User:", name))
        .when(F.col("c_custkey") % 5 == 2, text("https://sv.wikibooks.org/wiki/User:", quoted_name))
        .when(F.col("c_custkey") % 5 == 3, text("https://www.wikidata.org/w/index.php?title=User:", quoted_name))
        .otherwise(text("User ", name))
    )
    nothing = F.lit(None).cast("string")
    pages = v.wide_table("customer").select("c_custkey", wiki.title_from_reference(raw, nothing).alias("page"))
    reference = wiki.user_page_reference(F.col("page.domain"), F.col("page.title"), nothing)
    return pages.select("c_custkey", "page.domain", "page.title", reference.alias("reference"))


_TITLE = "replace(p_name || ' ' || p_partkey, ' ', '_')"


@query(
    "page_uri_columns",
    with_ctes("dims", "ns")
    + """SELECT p_partkey, 'https://' || d.domain || d.path || {full} AS page_uri,
       'https://' || d.domain || d.path || 'File:' || {brand} AS img_uri, 'kept' AS cl_uri
       FROM part JOIN dims d ON d.k = p_partkey % 5
       LEFT JOIN ns ON ns.domain = d.domain AND ns.ns_id = p_size % 16""".format(
        full=quoted("CASE WHEN coalesce(ns.name, '') <> '' THEN ns.name || ':' ELSE '' END || " + _TITLE), brand=quoted("p_brand")
    ),
)
def page_uri_columns_query(v: Views) -> DataFrame:
    wikis = v.wikis().select(F.col("dbname").alias("wiki"), "domain")
    rows = v.wide_table("part").select(
        "p_partkey",
        text("nation_", F.col("p_partkey") % 5, "wiki").alias("wiki"),
        text(" :", F.col("p_name"), " ", F.col("p_partkey")).alias("page_title"),
        text(F.col("p_size") % 16).alias("page_namespace"),
        F.col("p_brand").alias("img_name"),
        F.col("p_name").alias("cl_to"),
        F.lit("kept").alias("cl_uri"),
    )
    out = page_uri_columns(rows.join(wikis, "wiki"), v.siteinfo(), v.namespaces(), v.interwiki())
    return out.select("p_partkey", "page_uri", "img_uri", "cl_uri")


@query(
    "interwiki_uri",
    """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'https://en.wikipedia.org/wiki/' || {t} WHEN 1 THEN 'https://n1.example.org/' END AS iwl_uri
       FROM part""".format(t=quoted(_TITLE)),
)
def interwiki_uri(v: Views) -> DataFrame:
    rows = v.wide_table("part").select(
        "p_partkey",
        F.lit("nation-1.wikipedia.org").alias("domain"),
        F.expr("CASE p_partkey % 3 WHEN 0 THEN ' w' WHEN 1 THEN 'n' ELSE 'zz' END").alias("iwl_prefix"),
        text(F.col("p_name"), " ", F.col("p_partkey")).alias("iwl_title"),
    )
    return page_uri_columns(rows, v.siteinfo(), v.namespaces(), v.interwiki()).select("p_partkey", "iwl_uri")


@query(
    "interwiki_targets",
    with_ctes("dims")
    + """SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN 'fi.wikipedia.org' WHEN 1 THEN 'commons.wikimedia.org'
       WHEN 2 THEN 'incubator.wikimedia.org' WHEN 3 THEN 'xx.' || 'wikipedia.org' ELSE NULL END AS domain,
       CASE s_suppkey % 5 WHEN 0 THEN 'User:' || s_name WHEN 4 THEN NULL ELSE 'User:' || s_name || '/x' END AS title FROM supplier""",
)
def interwiki_targets(v: Views) -> DataFrame:
    key = F.col("s_suppkey")
    prefix = F.element_at(F.array(*[F.lit(p) for p in ("W", "c", "incubator", "xx", "b")]), (key % 5 + 1).cast("int"))
    title = F.when(key % 5 == 0, text("FI:User:", F.col("s_name"))).when(key % 5 == 4, F.lit("NoLanguage")).otherwise(
        text("User:", F.col("s_name"), "/x")
    )
    target = wiki.interwiki_target(prefix, title, F.lit("wikipedia"), F.lit(None).cast("string"))
    return v.table("supplier").select("s_suppkey", target["domain"].alias("domain"), target["title"].alias("title"))


@query(
    "wiki_dim",
    with_ctes("dims")
    + "SELECT domain, dbname, lang_code, wiki_group, 'https://' || domain || '/' AS site_url, site_code FROM dims",
)
def wiki_dim(v: Views) -> DataFrame:
    return v.wikis()


@query(
    "namespace_dim",
    with_ctes("dims", "ns")
    + """SELECT domain, CAST(ns_id AS BIGINT) AS ns_id, name, 'name' AS kind FROM ns
       UNION ALL SELECT domain, CAST(ns_id AS BIGINT), a, 'alias' FROM (
         SELECT domain, ns_id, name AS a FROM ns WHERE name <> ''
         UNION SELECT domain, 2, 'User' FROM dims UNION SELECT domain, 2, 'U' FROM dims UNION SELECT domain, 14, 'Cat' FROM dims)""",
)
def namespace_dim(v: Views) -> DataFrame:
    names = v.namespaces().select("domain", "ns_id", "name", F.lit("name").alias("kind"))
    return names.unionByName(v.aliases().select("domain", "ns_id", F.col("alias").alias("name"), F.lit("alias").alias("kind")))


@query(
    "siteinfo_dim",
    with_ctes("dims")
    + """SELECT domain, CASE WHEN k % 2 = 0 THEN '/wiki/$1' ELSE 'w' END AS article_path, lang FROM dims""",
)
def siteinfo_dim(v: Views) -> DataFrame:
    return v.siteinfo()


@query(
    "wiki_selection",
    with_ctes("dims")
    + """, asked AS (SELECT DISTINCT CASE c_custkey % 5 WHEN 0 THEN 'w:nation-' || n WHEN 1 THEN '*.wiktionary.org' WHEN 2 THEN 'commons'
         WHEN 3 THEN 'b:nation-' || n ELSE 'bad token' END AS request, n, c_custkey % 5 AS kind
         FROM (SELECT c_custkey, c_nationkey AS n FROM customer)),
       found AS (SELECT request, 'nation-' || n || '.wikipedia.org' AS domain,
           CASE WHEN n IN (3, 4) OR n >= 20 THEN 'unknown' ELSE 'selected' END AS status FROM asked WHERE kind = 0
         UNION ALL SELECT DISTINCT request, domain, 'selected' FROM asked, dims WHERE kind = 1 AND wiki_group = 'wiktionary'
         UNION ALL SELECT DISTINCT request, 'commons.wikimedia.org', 'selected' FROM asked WHERE kind = 2
         UNION ALL SELECT request, 'nation-' || n || '.wikibooks.org', 'unknown' FROM asked WHERE kind = 3
         UNION ALL SELECT DISTINCT request, CAST(NULL AS VARCHAR), 'invalid' FROM asked WHERE kind = 4)
       SELECT request, domain, status FROM found""",
)
def wiki_selection(v: Views) -> DataFrame:
    n = F.col("c_nationkey")
    requests = v.wide_table("customer").select(
        F.when(F.col("c_custkey") % 5 == 0, text(" W:nation-", n))
        .when(F.col("c_custkey") % 5 == 1, "*.wiktionary.org,")
        .when(F.col("c_custkey") % 5 == 2, "commons.")
        .when(F.col("c_custkey") % 5 == 3, text("b:NATION-", n))
        .otherwise("bad token")
        .alias("token")
    )
    return select_wikis(requests, v.wikis())
