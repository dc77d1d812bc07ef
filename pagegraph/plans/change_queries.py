"""New and edited pages, users, members, audits and the change stream over the driver tables."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagegraph.functions import fixed
from pagegraph.functions.text import casefold, user_name
from pagegraph.functions.times import digits14
from pagegraph.operators import audit, changes, members
from pagegraph.plans.graph_queries import ENRICHED, enriched_links
from pagegraph.plans.registry import query
from pagegraph.plans.views import COMMONS, K_SQL, Views, digits, iso_of_digits, quoted, text, wiki_of, wiki_sql, with_ctes
from pagegraph.session import ensure_checkpoint_dir
from pagegraph.sources import tables
from pagegraph.streaming import feed

FLOOR = "20240105000000"
AS_OF = datetime(2001, 12, 1)


def listed_actors(v: Views) -> DataFrame:
    return changes.user_actors(v.actor(), v.listed_users())


# --- new pages -----------------------------------------------------------------------------------

_NEW = (
    with_ctes("page", "items", "recentchanges", "dims", "ns")
    + """, ranked AS (SELECT p.wiki, p.page_id, p.page_title, p.page_namespace, i.qid_text, rc.rc_timestamp AS timestamp,
    row_number() OVER (PARTITION BY p.wiki ORDER BY rc.rc_timestamp DESC, p.page_title, p.page_id, i.qid_text) AS rn
    FROM recentchanges rc JOIN page p ON p.wiki = rc.wiki AND p.page_id = rc.rc_cur_id JOIN items i ON i.wiki = rc.wiki AND i.page_id = rc.rc_cur_id
    WHERE rc_source = 'mw.new' AND NOT (rc.wiki = 'nation_4wiki' AND rc.rc_namespace = 6) AND rc.rc_timestamp >= '{f}')
""".format(f=FLOOR)
)


@query("new_pages", _NEW + """SELECT page_id, full_title AS page_title, replace(full_title, '_', ' ') AS page_label, CAST(page_namespace AS BIGINT) AS namespace,
    'https://' || domain || path || {q} AS page_url, domain AS wiki_domain, qid_text AS wikidata_id, {t} AS created_timestamp
    FROM (SELECT r.*, d.domain, d.path, CASE WHEN page_namespace > 0 AND coalesce(ns.name, '') <> '' THEN ns.name || ':' ELSE '' END || page_title AS full_title
      FROM ranked r JOIN dims d ON d.dbname = r.wiki LEFT JOIN ns ON ns.domain = d.domain AND ns.ns_id = r.page_namespace)
    ORDER BY timestamp DESC, domain, full_title, page_id LIMIT 500""".format(q=quoted("full_title"), t=iso_of_digits("timestamp")))
def new_pages(v: Views) -> DataFrame:
    """Creations with an item id as records: cap per wiki, then global order and limit."""
    rows = changes.new_page_rows(v.recentchanges(), v.page(), changes.item_ids(v.page_props()), FLOOR, commons=COMMONS)
    records = changes.page_records(rows, v.wikis(), v.siteinfo(), v.namespaces())
    newest = changes.newest_records(records, 500)
    return newest.select(
        "page_id", "page_title", "page_label", "namespace", "page_url", "wiki_domain", "wikidata_id", "created_timestamp"
    )


@query("new_pages_capped", _NEW + "SELECT wiki, page_id, page_title, timestamp FROM ranked WHERE rn <= 10")
def new_pages_capped(v: Views) -> DataFrame:
    rows = changes.new_page_rows(v.recentchanges(), v.page(), changes.item_ids(v.page_props()), FLOOR, per_wiki=10, commons=COMMONS)
    return rows.select("wiki", "page_id", "page_title", "timestamp")


_TWO = (
    with_ctes("page", "items", "recentchanges", "item_keys", "actor", "listed")
    + """, rc AS (SELECT * FROM recentchanges r WHERE rc_source = 'mw.new' AND EXISTS (SELECT 1 FROM actor a JOIN listed l ON l.user_name = a.actor_name
      WHERE a.wiki = r.wiki AND a.actor_id = r.rc_actor)),
    branches AS (SELECT p.wiki, p.page_id, p.page_title, i.qid_text, rc.rc_timestamp AS timestamp FROM rc JOIN page p ON p.wiki = rc.wiki AND p.page_id = rc.rc_cur_id
        JOIN items i ON i.wiki = rc.wiki AND i.page_id = rc.rc_cur_id
      UNION ALL SELECT p.wiki, p.page_id, p.page_title, k.sort_key, rc.rc_timestamp FROM rc JOIN page p ON p.wiki = rc.wiki AND p.page_id = rc.rc_cur_id
        JOIN item_keys k ON k.wiki = rc.wiki AND k.page_id = rc.rc_cur_id
        WHERE NOT EXISTS (SELECT 1 FROM items i WHERE i.wiki = rc.wiki AND i.page_id = rc.rc_cur_id)),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY wiki ORDER BY timestamp DESC, page_title, page_id, qid_text) AS rn FROM branches)
    SELECT wiki, page_id, page_title, qid_text, timestamp FROM ranked WHERE rn <= 200"""
)


@query("new_pages_fallback", _TWO)
def new_pages_fallback(v: Views) -> DataFrame:
    """Rows without an item property take it from the category sort key; only listed users."""
    rows = changes.new_page_rows_two_branches(
        v.recentchanges(), v.page(), v.page_props(), v.categorylinks(), v.category_targets(), actors=listed_actors(v), per_wiki=200
    )
    return rows.select("wiki", "page_id", "page_title", "qid_text", "timestamp")


@query("namespace_sample", with_ctes("recentchanges", "items") + """, ranked AS (SELECT wiki, page_id, rc_title AS page_title, rc_namespace AS page_namespace, rc_timestamp AS timestamp,
    row_number() OVER (PARTITION BY wiki ORDER BY rc_timestamp DESC, rc_title, page_id, qid_text) AS rn FROM (SELECT rc.*, i.page_id, i.qid_text FROM recentchanges rc
    JOIN items i ON i.wiki = rc.wiki AND i.page_id = rc.rc_cur_id WHERE rc_source = 'mw.new' AND rc_timestamp >= '{f}' AND rc_namespace <> 0))
    SELECT wiki, page_id, page_title, page_namespace, timestamp FROM ranked WHERE rn <= 25""".format(f=FLOOR))
def namespace_sample(v: Views) -> DataFrame:
    return changes.namespace_sample(v.recentchanges(), v.page_props(), FLOOR, 25).drop("qid_text").withColumn(
        "page_namespace", F.col("page_namespace").cast("bigint")
    )


# --- edited pages ----------------------------------------------------------------------------------

_EDIT_FLOOR = "19980101000000"


@query("edited_pages", with_ctes("page", "items", "revision", "actor", "listed") + """, m AS (SELECT r.wiki, r.rev_page AS page_id, max(r.rev_timestamp) AS timestamp
    FROM revision r JOIN actor a ON a.wiki = r.wiki AND a.actor_id = r.rev_actor JOIN listed l ON l.user_name = a.actor_name
    WHERE r.rev_timestamp >= '{f}' GROUP BY r.wiki, r.rev_page)
    SELECT m.wiki, m.page_id, p.page_title, p.page_namespace, i.qid_text, m.timestamp FROM m JOIN page p USING (wiki, page_id) JOIN items i USING (wiki, page_id)
    WHERE NOT (wiki = 'nation_4wiki' AND p.page_namespace = 6)""".format(f=_EDIT_FLOOR))
def edited_pages(v: Views) -> DataFrame:
    return changes.edited_page_rows(
        v.revision(), v.page(), changes.item_ids(v.page_props()), listed_actors(v), _EDIT_FLOOR, commons=COMMONS
    )


@query("latest_per_page", with_ctes("recentchanges") + """SELECT wiki, rc_cur_id, max(rc_id) AS rc_id, arg_max(rc_title, rc_id) AS rc_title,
    arg_max(rc_namespace, rc_id) AS rc_namespace, arg_max(rc_timestamp, rc_id) AS rc_timestamp FROM recentchanges
    WHERE (rc_source = 'mw.edit' OR rc_source = 'mw.log' AND rc_log_type = 'move') AND rc_cur_id > 0 GROUP BY wiki, rc_cur_id""")
def latest_per_page(v: Views) -> DataFrame:
    return changes.latest_change_per_page(v.recentchanges()).drop("rc_this_oldid")


@query("latest_contrib", """SELECT wiki, page_id, title, time_key, user_order, seq FROM (SELECT *, row_number() OVER (PARTITION BY wiki, page_id
    ORDER BY time_key DESC, user_order, seq) AS rn FROM (SELECT {w} AS wiki, l_partkey AS page_id, 'Page_' || l_partkey AS title,
    CAST({d} AS BIGINT) AS time_key, l_suppkey AS user_order, l_orderkey * 10 + l_linenumber AS seq FROM lineitem)) WHERE rn = 1""".format(
    w=wiki_sql("l_partkey"), d=digits("l_shipdate")))
def latest_contrib(v: Views) -> DataFrame:
    """Newest contribution per page over all users; equal times keep the first user read."""
    rows = v.revision().select(
        "wiki",
        F.col("rev_page").alias("page_id"),
        text("Page_", F.col("rev_page")).alias("title"),
        F.col("rev_timestamp").cast("bigint").alias("time_key"),
        F.col("rev_actor").alias("user_order"),
        F.col("rev_id").alias("seq"),
        F.lit(0).alias("position"),
    )
    return changes.latest_contribution_per_page(rows).drop("position")


# --- users and wikis ---------------------------------------------------------------------------------


@query("user_list", with_ctes("linktarget", "pagelinks", "dims") + """SELECT DISTINCT wiki, page_id, user_name FROM (
    SELECT p.wiki, pl_from AS page_id, lt_user AS user_name FROM pagelinks p JOIN linktarget t ON t.wiki = p.wiki AND t.lt_id = p.pl_target_id WHERE lt_namespace = 2
    UNION ALL SELECT wiki, s_suppkey, s_name FROM (SELECT {w} AS wiki, s_suppkey, s_name, s_suppkey % 4 AS kind FROM supplier)
      WHERE kind IN (0, 3) OR kind = 1 AND wiki NOT IN ('nation_3wiki', 'nation_4wiki'))
    WHERE page_id IN (SELECT o_orderkey % 200 FROM orders)""".format(w=wiki_sql("s_suppkey")))
def user_list(v: Views) -> DataFrame:
    """Users linked from pages, locally and through interwiki links."""
    starts = v.pagelinks().select("wiki", F.col("pl_from").alias("page_id"))
    return changes.listed_users(starts, v.pagelinks(), v.linktarget(), v.iwlinks(), v.wikis(), v.aliases())


@query("redirect_chase", """WITH RECURSIVE walk(start, cur) AS (SELECT p_partkey, p_partkey FROM part
    UNION SELECT start, cur // 3 FROM walk WHERE cur % 3 = 0)
    SELECT start AS title_key, min(cur) AS page_id FROM walk GROUP BY start""")
def redirect_chase(v: Views) -> DataFrame:
    """Redirects to their end, with a page that redirects to itself."""
    wiki = "nation_0wiki"
    starts = v.page(wiki).select(
        "wiki", F.col("page_id").alias("title_key"), F.col("page_namespace").alias("ns_id"), F.col("page_title").alias("db_title")
    )
    return changes.chase_redirects(starts, v.page(wiki), v.redirect(wiki)).select("title_key", "page_id")


@query("registered_users", "SELECT DISTINCT c_name AS user_name, 'nation_' || (o_orderkey % 25) || 'wiki' AS wiki FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_custkey % 3 = 0")
def registered_users(v: Views) -> DataFrame:
    return changes.registered_users(v.listed_users(), v.localuser())


@query("active_users", with_ctes("revision", "actor", "listed") + """SELECT DISTINCT a.wiki, a.actor_name AS user_name FROM actor a JOIN listed l ON l.user_name = a.actor_name
    WHERE EXISTS (SELECT 1 FROM revision r WHERE r.wiki = a.wiki AND r.rev_actor = a.actor_id AND r.rev_timestamp >= '20011002000000')""")
def active_users(v: Views) -> DataFrame:
    """Activity within 60 days of a fixed day, or since a later floor."""
    floor = changes.activity_floor("20010101000000", AS_OF)
    return changes.recently_active_users(v.listed_users(), v.user(), v.actor(), v.revision(), floor)


@query("wiki_precheck", with_ctes("recentchanges", "actor", "listed", "dims") + """SELECT dbname, domain FROM dims d WHERE EXISTS (SELECT 1 FROM recentchanges rc
    JOIN actor a ON a.wiki = rc.wiki AND a.actor_id = rc.rc_actor JOIN listed l ON l.user_name = a.actor_name WHERE rc.wiki = d.dbname
    AND rc_source IN ('mw.new', 'mw.edit') AND rc_timestamp >= '20240125000000' AND NOT (rc.wiki = 'nation_4wiki' AND rc_namespace = 6))""")
def wiki_precheck(v: Views) -> DataFrame:
    kept = changes.wikis_with_changes(
        v.wikis(), v.recentchanges(), listed_actors(v), ["mw.new", "mw.edit"], "20240125000000", commons=COMMONS
    )
    return kept.select("dbname", "domain")


@query("active_wikis", with_ctes("dims") + """SELECT dbname, domain FROM dims WHERE dbname IN (SELECT 'nation_' || (o_orderkey % 25) || 'wiki' FROM orders
    WHERE o_orderkey % 3 = 2 OR floor(o_totalprice) - 100000 > 0)""")
def active_wikis(v: Views) -> DataFrame:
    """Wikis with a merged account that has edits; a count that cannot be read counts."""
    count = F.when(F.col("o_orderkey") % 3 == 2, "many").otherwise((F.floor("o_totalprice").cast("bigint") - 100000).cast("string"))
    accounts = v.table("orders").select(
        text("Nation_", F.col("o_orderkey") % 25, "wiki").alias("wiki"), count.alias("editcount")
    )
    return changes.wikis_of_active_accounts(v.wikis(), accounts).select("dbname", "domain")


@query("listed_changes", with_ctes("recentchanges") + """SELECT rc_id, c_name AS actor_name FROM recentchanges JOIN customer ON c_custkey = rc_actor WHERE c_custkey % 3 = 0""")
def listed_changes(v: Views) -> DataFrame:
    """Changes by listed users, names compared without case."""
    names = v.table("customer").select(F.col("c_custkey").alias("rc_actor"), F.col("c_name").alias("actor_name"))
    rows = v.recentchanges().select("rc_id", "rc_actor").join(names, "rc_actor").withColumn("shout", F.upper("actor_name"))
    return changes.only_users(rows, "shout", v.listed_users()).select("rc_id", "actor_name")


@query("unique_users", """SELECT user_key, arg_min(spelling, pos) AS spelling FROM (SELECT lower(c_name) AS user_key, c_name AS spelling, c_custkey * 2 AS pos FROM customer
    UNION ALL SELECT lower(c_name), upper(c_name), c_custkey * 2 + CASE WHEN c_custkey % 2 = 0 THEN -1 ELSE 1 END FROM customer) GROUP BY user_key""")
def unique_users(v: Views) -> DataFrame:
    """First spelling of each name in reading order."""
    from pagegraph.operators.ranking import first_per_key

    key = F.col("c_custkey")
    spellings = F.array(
        F.struct(F.col("c_name").alias("spelling"), (key * 2).alias("pos")),
        F.struct(F.upper("c_name").alias("spelling"), (key * 2 + F.when(key % 2 == 0, -1).otherwise(1)).alias("pos")),
    )
    rows = v.table("customer").select(F.explode(spellings).alias("x")).select(
        casefold(user_name(F.col("x.spelling"))).alias("user_key"), "x.spelling", "x.pos"
    )
    return first_per_key(rows, ["user_key"], [F.col("pos")]).select("user_key", "spelling")


# --- members and piles ---------------------------------------------------------------------------------

_PREFIXES = ["small", "red", "Bl"]


@query("category_members", with_ctes("page", "item_keys") + """SELECT p.wiki, p.page_id, p.page_title AS title, k.sort_key FROM page p JOIN item_keys k ON k.wiki = p.wiki AND k.page_id = p.page_id
    WHERE p.page_namespace IN (0, 1, 2, 3, 4, 5, 6, 7) AND p.page_latest >= 5 AND (starts_with(page_title, 'small') OR starts_with(page_title, 'red') OR starts_with(page_title, 'Bl'))""")
def category_members(v: Views) -> DataFrame:
    prefixes = members.clean_prefixes(["small...,red", "Bl "])
    rows = members.category_members(
        v.page(), v.categorylinks(), v.category_targets(), namespaces=list(range(8)), min_revision=5, prefixes=prefixes
    )
    return rows.select("wiki", "page_id", "title", "sort_key")


@query("members_changed", with_ctes("recentchanges", "item_keys") + """, latest AS (SELECT wiki, rc_cur_id, max(rc_id) AS rc_id, arg_max(rc_title, rc_id) AS title,
    arg_max(rc_namespace, rc_id) AS ns, arg_max(rc_this_oldid, rc_id) AS rev FROM recentchanges
    WHERE (rc_source = 'mw.edit' OR rc_source = 'mw.log' AND rc_log_type = 'move') AND rc_cur_id > 0 GROUP BY wiki, rc_cur_id)
    SELECT l.wiki, l.rc_cur_id AS page_id, l.title, l.rc_id, k.sort_key FROM latest l JOIN item_keys k ON k.wiki = l.wiki AND k.page_id = l.rc_cur_id
    WHERE ns IN (1, 2, 3, 4, 5, 6) AND rev >= 50 AND (starts_with(title, 'Page_1') OR starts_with(title, 'Page_2') OR starts_with(title, 'Page_3'))""")
def members_changed(v: Views) -> DataFrame:
    rows = members.changed_members(
        v.recentchanges(), v.categorylinks(), v.category_targets(), namespaces=[1, 2, 3, 4, 5, 6], min_revision=50, prefixes=["Page_1", "Page_2", "Page_3"]
    )
    return rows.select("wiki", "page_id", "title", "rc_id", "sort_key")


@query("members_recent", """SELECT wiki, page_id, time_key FROM (SELECT {w} AS wiki, {k} AS page_id, CAST({d} AS BIGINT) AS time_key, event_id FROM events)
    WHERE time_key >= 20240120000000 ORDER BY time_key DESC, wiki, event_id LIMIT 300""".format(w=wiki_sql("event_id"), k=K_SQL, d=digits("ts")))
def members_recent(v: Views) -> DataFrame:
    """Feed members not older than the cut-off, newest first, limited."""
    rows = v.table("events").select(
        wiki_of(F.col("event_id")).alias("wiki"),
        F.get_json_object("props", "$.k").cast("bigint").alias("page_id"),
        digits14(F.col("ts")).cast("bigint").alias("time_key"),
        F.col("event_id").alias("seq"),
        F.lit(0).alias("position"),
    )
    return members.newest_members(rows, 20240120000000, 300).select("wiki", "page_id", "time_key")


@query("pile_pages", with_ctes("items", "item_keys") + """, keys AS (SELECT wiki, page_id, max(sort_key) AS sort_key FROM item_keys WHERE wiki = 'nation_1wiki' GROUP BY wiki, page_id)
    SELECT p_partkey AS position, p_partkey AS page_id, CAST(CASE WHEN p_partkey % 2 = 0 THEN 14 ELSE 0 END AS BIGINT) AS ns_id, replace(p_name || ' ' || p_partkey, ' ', '_') AS db_title,
    coalesce(i.qid_text, k.sort_key) AS wikidata_id FROM part LEFT JOIN items i ON i.page_id = p_partkey AND i.wiki = 'nation_1wiki' LEFT JOIN keys k ON k.page_id = p_partkey
    WHERE p_size % 16 = CASE WHEN p_partkey % 2 = 0 THEN 14 ELSE 0 END AND p_partkey % 5 = 1""")
def pile_pages(v: Views) -> DataFrame:
    """Half of the titles carry a category prefix; titles that name no page of the wiki drop out."""
    title = text(F.when(F.col("p_partkey") % 2 == 0, "CAT:").otherwise(""), F.col("p_name"), " ", F.col("p_partkey"))
    titles = v.table("part").select(
        F.lit("nation_1wiki").alias("wiki"), F.lit("nation-1.wikipedia.org").alias("domain"), F.col("p_partkey").alias("position"), title.alias("title")
    )
    found = members.pile_pages(titles, v.page(), v.page_props(), v.aliases(), v.categorylinks(), v.category_targets())
    return found.select("position", "page_id", "ns_id", "db_title", "wikidata_id")


# --- audits -------------------------------------------------------------------------------------------


@query("dataset_diff", """SELECT coalesce(a.k, b.k) AS title, CASE WHEN b.k IS NULL THEN 'only_left' WHEN a.k IS NULL THEN 'only_right'
    WHEN a.qid = b.qid AND a.len = b.len THEN 'equal' WHEN b.len < 250 THEN 'tolerated' ELSE 'mismatch' END AS status
    FROM (SELECT p_partkey AS k, 'Q' || p_partkey AS qid, CAST(floor(p_retailprice) AS BIGINT) AS len FROM part WHERE p_partkey % 10 <> 0) a
    FULL JOIN (SELECT p_partkey AS k, 'Q' || CASE WHEN p_partkey % 7 = 0 THEN p_partkey + 1 ELSE p_partkey END AS qid,
      CASE WHEN p_partkey % 6 = 0 THEN p_size ELSE CAST(floor(p_retailprice) AS BIGINT) END AS len FROM part WHERE p_partkey % 11 <> 0) b ON a.k = b.k
    WHERE coalesce(a.k, b.k) IS NOT NULL""")
def dataset_diff(v: Views) -> DataFrame:
    key, price = F.col("p_partkey"), F.floor("p_retailprice").cast("bigint")
    part = v.table("part")
    left = part.where(key % 10 != 0).select(key.alias("title"), text("Q", key).alias("qid"), price.alias("page_len"))
    right = part.where(key % 11 != 0).select(
        key.alias("title"),
        text("Q", F.when(key % 7 == 0, key + 1).otherwise(key)).alias("qid"),
        F.when(key % 6 == 0, F.col("p_size").cast("bigint")).otherwise(price).alias("page_len"),
    )
    return audit.dataset_diff(left, right, "title", ["qid", "page_len"])


@query("uri_parity", """SELECT p_partkey AS page_id, CASE p_partkey % 3 WHEN 0 THEN 'u' || p_partkey WHEN 1 THEN 'a' || p_partkey ELSE '(missing)' END AS reference_uri,
    CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END AS matched FROM part""")
def uri_parity(v: Views) -> DataFrame:
    key = F.col("p_partkey")
    part = v.table("part")
    records = part.select(
        key.alias("page_id"), text("Q", key).alias("wikidata_id"), F.lit("s").alias("site_url"), text("u", key).alias("page_url")
    )
    uris = F.when(key % 3 == 0, F.array(text("a", key), text("u", key), text("z", key))).when(key % 3 == 1, F.array(text("z", key), text("a", key)))
    articles = part.select(text("Q", key).alias("qid"), F.lit("s").alias("site_url"), F.explode(uris).alias("article"))
    out = audit.uri_parity(records, articles)
    return out.select("page_id", "reference_uri", F.col("matched").cast("int").alias("matched"))


@query("user_match_audit", with_ctes("recentchanges", "actor", "listed") + """, hit AS (SELECT a.wiki, a.actor_name, count(rc_id) AS hits, max(rc_timestamp) AS latest FROM actor a
    LEFT JOIN recentchanges rc ON rc.wiki = a.wiki AND rc.rc_actor = a.actor_id AND rc.rc_timestamp >= '{f}' GROUP BY a.wiki, a.actor_name)
    SELECT w.wiki, l.user_name, h.actor_name AS actor_values, CASE WHEN h.hits > 0 THEN h.actor_name WHEN h.hits = 0 THEN '' END AS change_values, coalesce(h.hits, 0) AS hits, h.latest,
    CASE WHEN h.actor_name IS NULL THEN 'not_found' ELSE 'match' END AS status
    FROM listed l CROSS JOIN (VALUES ('nation_0wiki'), ('nation_1wiki')) AS w(wiki) LEFT JOIN hit h ON h.wiki = w.wiki AND h.actor_name = l.user_name""".format(f=FLOOR))
def user_match_audit(v: Views) -> DataFrame:
    report = audit.user_name_matches(v.listed_users(), ["nation_0wiki", "nation_1wiki"], v.actor(), v.recentchanges(), FLOOR)
    return report.withColumn("actor_values", F.array_join("actor_values", ",")).withColumn(
        "change_values", F.array_join("change_values", ",")
    )


@query("coverage_audit", """SELECT count(*) AS links_total, count(qid) AS links_with_qid, count(page_len) AS links_with_page_len, count(rev_timestamp) AS links_with_rev_timestamp,
    count(CASE WHEN page_len IS NOT NULL AND rev_timestamp IS NOT NULL THEN 1 END) AS links_with_both, CAST(1 AS BIGINT) AS allowed_missing FROM ({})""".format(ENRICHED))
def coverage_audit(v: Views) -> DataFrame:
    return audit.enrichment_coverage(enriched_links(v), ["https://en.wikipedia.org/wiki/Missing_7"])


@query("coverage_hosts", """SELECT regexp_extract(uri, '^https://([^/]*)', 1) AS host, count(*) AS missing FROM ({})
    WHERE page_len IS NULL OR rev_timestamp IS NULL GROUP BY host""".format(ENRICHED))
def coverage_hosts(v: Views) -> DataFrame:
    return audit.missing_by_host(enriched_links(v))


@query("sample_counts", with_ctes("recentchanges", "items", "dims") + """SELECT d.domain AS wiki_domain, CAST(rc_namespace AS BIGINT) AS namespace, count(*) AS records
    FROM recentchanges rc JOIN items i ON i.wiki = rc.wiki AND i.page_id = rc.rc_cur_id JOIN dims d ON d.dbname = rc.wiki
    WHERE rc_source = 'mw.new' AND rc_timestamp >= '{f}' AND rc_namespace > 0 GROUP BY d.domain, rc_namespace""".format(f=FLOOR))
def sample_counts(v: Views) -> DataFrame:
    rows = changes.namespace_sample(v.recentchanges(), v.page_props(), FLOOR, keep_negative=False)
    records = changes.page_records(rows, v.wikis(), v.siteinfo(), v.namespaces())
    return audit.sample_counts(records)


# --- streams -----------------------------------------------------------------------------------------

_STREAM_NEW = with_ctes("page", "items", "recentchanges") + """SELECT c.wiki, c.rc_cur_id, c.rc_id, p.page_title, i.qid_text FROM (SELECT wiki, rc_cur_id, arg_max(rc_id, rc_timestamp || lpad(CAST(rc_id AS VARCHAR), 12, '0')) AS rc_id
    FROM recentchanges WHERE rc_source = 'mw.new' AND NOT (wiki = 'nation_4wiki' AND rc_namespace = 6) AND rc_timestamp >= '{f}' GROUP BY wiki, rc_cur_id) c
    JOIN page p ON p.wiki = c.wiki AND p.page_id = c.rc_cur_id JOIN items i ON i.wiki = c.wiki AND i.page_id = c.rc_cur_id""".format(f=FLOOR)


@query("stream_new_pages", _STREAM_NEW)
def stream_new_pages(v: Views) -> DataFrame:
    """Batch run of the new-page stream: one row per page, newest event."""
    out = feed.new_pages(v.recentchanges(), v.page(), changes.item_ids(v.page_props()), floor=FLOOR, commons=COMMONS)
    return out.select("wiki", "rc_cur_id", "rc_id", "page_title", "qid_text")


@query("stream_latest_edit", with_ctes("recentchanges") + """SELECT wiki, rc_cur_id, max(rc_timestamp) AS rc_timestamp,
    arg_max(rc_id, rc_timestamp || lpad(CAST(rc_id AS VARCHAR), 12, '0')) AS rc_id, count(*) AS edits FROM recentchanges WHERE rc_source = 'mw.edit' GROUP BY wiki, rc_cur_id""")
def stream_latest_edit(v: Views) -> DataFrame:
    """Batch run of the newest edit per page."""
    return feed.latest_edits(v.recentchanges())


@query("table_since", with_ctes("recentchanges", "dims") + """SELECT wiki, rc_source, count(*) AS changes, max(rc_timestamp) AS newest FROM recentchanges
    WHERE rc_timestamp >= '{f}' AND wiki IN (SELECT dbname FROM dims WHERE wiki_group = 'wikipedia') GROUP BY wiki, rc_source""".format(f=FLOOR))
def table_since(v: Views) -> DataFrame:
    """Changes of the selected wikis from a table laid out by wiki and day."""
    root = "{}/replica-{}".format(ensure_checkpoint_dir(v.spark), uuid.uuid4().hex)
    tables.write_by_day(v.recentchanges(), root, "recentchanges")
    wikis = v.wikis().where(F.col("wiki_group") == "wikipedia").select(F.col("dbname").alias("wiki"))
    rows = tables.read_since(v.spark, root, "recentchanges", FLOOR, wikis)
    return rows.groupBy("wiki", "rc_source").agg(F.count(F.lit(1)).alias("changes"), F.max("rc_timestamp").alias("newest"))
