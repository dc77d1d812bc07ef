"""Replica-shaped views over the driver tables, in Spark and as SQL for the comparisons.

Five wikis: three Wikipedias, one wiki with ``project/lang/name`` titles and one file wiki. Keys
are spread over them by their last digits, so every table of a wiki shares its ``wiki`` name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagegraph.functions import fixed
from pagegraph.functions.times import digits14
from pagegraph.session import spread
from pagegraph.sources import wikis as wiki_sources

COMMONS = "nation_4wiki"
PAYLOAD_ROWS = 50


def wiki_of(key: Column) -> Column:
    return F.concat(F.lit("nation_"), (key % 5).cast("string"), F.lit("wiki"))


def text(*parts) -> Column:
    """Concatenate columns and constants as text."""
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.dir = sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet("{}/{}.parquet".format(self.dir, name))

    def wide_table(self, name: str) -> DataFrame:
        """Table for costly work per row, spread over the cores when it has few splits."""
        return spread(self.table(name))

    # --- pages and what hangs on them ---------------------------------------------------------

    def page(self, wiki: str | None = None) -> DataFrame:
        part = self.table("part")
        return part.select(
            (F.lit(wiki) if wiki else wiki_of(F.col("p_partkey"))).alias("wiki"),
            F.col("p_partkey").alias("page_id"),
            F.replace(text(F.col("p_name"), " ", F.col("p_partkey")), F.lit(" "), F.lit("_")).alias("page_title"),
            (F.col("p_size") % 16).alias("page_namespace"),
            F.floor("p_retailprice").cast("bigint").alias("page_len"),
            F.col("p_partkey").alias("page_latest"),
        )

    def page_props(self, wiki: str | None = None) -> DataFrame:
        part = self.table("part")
        name = F.lit(wiki) if wiki else wiki_of(F.col("p_partkey"))
        rows = F.array(
            F.struct(
                F.lit(fixed.ITEM_PROPERTY).alias("n"),
                F.when(F.col("p_size") % 5 != 0, text("Q", F.col("p_partkey") + 1)).alias("v"),
            ),
            F.struct(F.lit("page_image").alias("n"), F.col("p_brand").alias("v")),
        )
        return (
            part.select(name.alias("wiki"), F.col("p_partkey").alias("pp_page"), F.explode(rows).alias("_r"))
            .select("wiki", "pp_page", F.col("_r.n").alias("pp_propname"), F.col("_r.v").alias("pp_value"))
            .where(F.col("pp_value").isNotNull())
        )

    def revision(self) -> DataFrame:
        """Edits of pages from line items; the id is only unique together with the page."""
        return self.table("lineitem").select(
            wiki_of(F.col("l_partkey")).alias("wiki"),
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("rev_id"),
            F.col("l_partkey").alias("rev_page"),
            F.col("l_suppkey").alias("rev_actor"),
            digits14(F.col("l_shipdate")).alias("rev_timestamp"),
        )

    def latest_revision(self) -> DataFrame:
        """One revision per id, from events; page p has the event with its number as latest."""
        return self.table("events").select(
            wiki_of(F.col("event_id")).alias("wiki"),
            F.col("event_id").alias("rev_id"),
            digits14(F.col("ts")).alias("rev_timestamp"),
        )

    def recentchanges(self) -> DataFrame:
        k = F.get_json_object("props", "$.k").cast("bigint")
        kind = F.col("event_type")
        return self.table("events").select(
            wiki_of(k).alias("wiki"),
            F.col("event_id").alias("rc_id"),
            k.alias("rc_cur_id"),
            F.col("event_id").alias("rc_this_oldid"),
            F.col("user_id").alias("rc_actor"),
            F.when(kind == "signup", "mw.new").when(kind == "click", "mw.edit").when(kind == "purchase", "mw.log").otherwise("mw.external").alias("rc_source"),
            F.when(kind == "purchase", F.when(F.col("event_id") % 2 == 0, "move").otherwise("delete")).alias("rc_log_type"),
            (k % 16 - 1).cast("int").alias("rc_namespace"),
            text("Page_", k).alias("rc_title"),
            digits14(F.col("ts")).alias("rc_timestamp"),
            F.col("ts").alias("event_time"),
        )

    # --- users --------------------------------------------------------------------------------

    def actor(self) -> DataFrame:
        return self.table("customer").select(
            wiki_of(F.col("c_custkey")).alias("wiki"),
            F.col("c_custkey").alias("actor_id"),
            F.col("c_custkey").alias("actor_user"),
            F.col("c_name").alias("actor_name"),
        )

    def user(self) -> DataFrame:
        return self.actor().select("wiki", F.col("actor_user").alias("user_id"), F.col("actor_name").alias("user_name"))

    def listed_users(self) -> DataFrame:
        """Every third customer, spelled with surrounding blanks."""
        return self.table("customer").where(F.col("c_custkey") % 3 == 0).select(text("  ", F.col("c_name"), " ").alias("user_name"))

    def localuser(self) -> DataFrame:
        orders = self.table("orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
        return orders.join(self.table("customer").select("c_custkey", "c_name"), "c_custkey").select(
            F.col("c_name").alias("lu_name"), text("Nation_", F.col("o_orderkey") % 25, "wiki").alias("lu_wiki")
        )

    def linktarget(self) -> DataFrame:
        name = F.when(F.col("c_custkey") % 4 == 0, text(F.col("c_name"), "/sub")).otherwise(F.col("c_name"))
        return self.table("customer").select(
            wiki_of(F.col("c_custkey")).alias("wiki"),
            F.col("c_custkey").alias("lt_id"),
            F.when(F.col("c_custkey") % 2 == 0, 2).otherwise(0).alias("lt_namespace"),
            name.alias("lt_title"),
        )

    def pagelinks(self) -> DataFrame:
        source = F.col("o_orderkey") % 200
        return self.table("orders").select(
            wiki_of(source).alias("wiki"), source.alias("pl_from"), F.col("o_custkey").alias("pl_target_id")
        )

    def iwlinks(self) -> DataFrame:
        key = F.col("s_suppkey")
        prefix = F.element_at(F.array(F.lit("w"), F.lit("nation-1"), F.lit("zz"), F.lit("commons")), (key % 4 + 1).cast("int"))
        title = F.when(key % 4 == 0, text("nation-2:User:", F.col("s_name"))).otherwise(text("u:", F.col("s_name"), "/x"))
        return self.table("supplier").select(
            wiki_of(key).alias("wiki"), key.alias("iwl_from"), prefix.alias("iwl_prefix"), title.alias("iwl_title")
        )

    # --- categories and redirects ---------------------------------------------------------------

    def category_targets(self) -> DataFrame:
        key = F.col("n_nationkey")
        return self.table("nation").select(
            wiki_of(key).alias("wiki"),
            (key + 1000000).cast("bigint").alias("lt_id"),
            F.lit(14).alias("lt_namespace"),
            F.when(key < 5, F.lit(fixed.ITEM_CATEGORY)).otherwise(text("Other_", key)).alias("lt_title"),
        )

    def categorylinks(self) -> DataFrame:
        return self.table("orders").select(
            wiki_of(F.col("o_custkey")).alias("wiki"),
            F.col("o_custkey").alias("cl_from"),
            (F.col("o_custkey") % 5 + 5 * (F.col("o_orderkey") % 5) + 1000000).alias("cl_target_id"),
            text("Q", F.col("o_orderkey") + 1).alias("cl_sortkey_prefix"),
        )

    def redirect(self, wiki: str) -> DataFrame:
        """Every third page redirects to the page with a third of its number (0 to itself)."""
        page = self.page(wiki)
        target = page.select(F.col("page_id").alias("_to"), F.col("page_namespace").alias("rd_namespace"), F.col("page_title").alias("rd_title"))
        return (
            page.where(F.col("page_id") % 3 == 0)
            .select("wiki", F.col("page_id").alias("rd_from"), F.floor(F.col("page_id") / 3).cast("bigint").alias("_to"))
            .join(target, "_to")
            .drop("_to")
        )

    # --- wiki dimensions, read back from the documents they come in -----------------------------

    def _nation(self) -> DataFrame:
        key = F.col("n_nationkey")
        host = (
            F.when(key == 3, fixed.INCUBATOR_DOMAIN)
            .when(key == 4, fixed.COMMONS_DOMAIN)
            .when(key >= 20, text("nation-", key, ".wiktionary.org"))
            .otherwise(text("nation-", key, ".wikipedia.org"))
        )
        return self.table("nation").withColumn("domain", host)

    def site_matrix(self) -> DataFrame:
        """One site-matrix document per nation."""
        key = F.col("n_nationkey")
        code = F.when(key == 3, "incubator").when(key == 4, "commons").when(key >= 20, "wiktionary").otherwise("wiki")
        suffix = F.when(key >= 20, "wiktionary").otherwise("wiki")
        site = F.array(
            F.struct(
                text("HTTPS://", F.col("domain"), "/").alias("url"),
                text("Nation_", key, suffix).alias("dbname"),
                code.alias("code"),
            ),
            F.struct(F.lit("nowhere").alias("url"), F.lit("x").alias("dbname"), F.lit("wiki").alias("code")),
        )
        special = F.to_json(F.create_map(F.lit("specials"), site))
        lang = text("Nation-", key)
        group = F.to_json(F.create_map(key.cast("string"), F.struct(lang.alias("code"), site.alias("site"))))
        return self._nation().select(key.alias("doc_order"), F.when(key.isin(3, 4), special).otherwise(group).alias("json"))

    def siteinfo_documents(self) -> DataFrame:
        """One siteinfo document per nation."""
        key = F.col("n_nationkey")

        def space(number: int, name, canonical: str) -> list[Column]:
            local = name if isinstance(name, Column) else F.lit(name)
            return [F.lit(str(number)), F.struct(local.alias("*"), F.lit(canonical).alias("canonical"))]

        spaces = F.create_map(
            *space(0, "", ""), *space(1, "Talk", "Talk"), *space(2, text("User ", key), "User"), *space(6, "File", "File"), *space(14, "Category", "Category")
        )
        alias = F.array(
            F.struct(F.lit(2).alias("id"), F.lit("U").alias("*")), F.struct(F.lit(14).alias("id"), F.lit("Cat").alias("*"))
        )
        interwiki = F.array(
            F.struct(F.lit("w").alias("prefix"), F.lit("https://en.wikipedia.org/wiki/$1").alias("url")),
            F.struct(F.lit("n").alias("prefix"), text("https://n", key, ".example.org/").alias("url")),
        )
        general = F.struct(
            F.when(key % 2 == 0, "/wiki/$1").otherwise("w").alias("articlepath"),
            F.when(key == 2, "").otherwise(text("Nation-", key)).alias("lang"),
        )
        query = F.struct(
            general.alias("general"), spaces.alias("namespaces"), alias.alias("namespacealiases"), interwiki.alias("interwikimap")
        )
        return self._nation().select("domain", F.to_json(F.struct(query.alias("query"))).alias("json"))

    def wikis(self) -> DataFrame:
        return wiki_sources.wiki_dimension(self.site_matrix(), "json", "doc_order")

    def siteinfo(self) -> DataFrame:
        return wiki_sources.siteinfo_dimension(self.siteinfo_documents(), "json")

    def namespaces(self) -> DataFrame:
        return wiki_sources.namespace_dimension(self.siteinfo_documents(), "json")

    def aliases(self) -> DataFrame:
        return wiki_sources.namespace_aliases(self.siteinfo_documents(), "json")

    def interwiki(self) -> DataFrame:
        return wiki_sources.interwiki_dimension(self.siteinfo_documents(), "json")


# --- the same views as SQL -----------------------------------------------------------------------


def digits(ts: str) -> str:
    return "strftime({}, '%Y%m%d%H%M%S')".format(ts)


def iso(ts: str) -> str:
    return "strftime({}, '%Y-%m-%dT%H:%M:%SZ')".format(ts)


def iso_of_digits(d: str) -> str:
    return iso("strptime({}, '%Y%m%d%H%M%S')".format(d))


def wiki_sql(key: str) -> str:
    return "('nation_' || ({} % 5) || 'wiki')".format(key)


def quoted(expr: str, safe: str = fixed.SAFE_PATH) -> str:
    out = "url_encode({})".format(expr)
    for char in safe:
        if char not in "_-.":
            out = "replace({}, '%{:02X}', '{}')".format(out, ord(char), char)
    return out


WS_SQL = " || ".join("chr({})".format(ord(c)) for c in fixed.WHITESPACE)


def stripped(expr: str) -> str:
    return "trim({}, {})".format(expr, WS_SQL)


K_SQL = "CAST(regexp_extract(props, '(\\d+)', 1) AS BIGINT)"

CTE = {
    "page": """SELECT {w} AS wiki, p_partkey AS page_id, replace(p_name || ' ' || p_partkey, ' ', '_') AS page_title,
        p_size % 16 AS page_namespace, CAST(floor(p_retailprice) AS BIGINT) AS page_len, p_partkey AS page_latest
        FROM part""".format(w=wiki_sql("p_partkey")),
    "items": """SELECT {w} AS wiki, p_partkey AS page_id, 'Q' || (p_partkey + 1) AS qid_text
        FROM part WHERE p_size % 5 <> 0""".format(w=wiki_sql("p_partkey")),
    "revision": """SELECT {w} AS wiki, l_partkey AS rev_page, l_suppkey AS rev_actor, {t} AS rev_timestamp
        FROM lineitem""".format(w=wiki_sql("l_partkey"), t=digits("l_shipdate")),
    "recentchanges": """SELECT {w} AS wiki, event_id AS rc_id, k AS rc_cur_id, event_id AS rc_this_oldid, user_id AS rc_actor,
        CASE event_type WHEN 'signup' THEN 'mw.new' WHEN 'click' THEN 'mw.edit' WHEN 'purchase' THEN 'mw.log' ELSE 'mw.external' END AS rc_source,
        CASE WHEN event_type = 'purchase' THEN CASE WHEN event_id % 2 = 0 THEN 'move' ELSE 'delete' END END AS rc_log_type,
        k % 16 - 1 AS rc_namespace, 'Page_' || k AS rc_title, {t} AS rc_timestamp
        FROM (SELECT *, {k} AS k FROM events)""".format(w=wiki_sql("k"), t=digits("ts"), k=K_SQL),
    "actor": """SELECT {w} AS wiki, c_custkey AS actor_id, c_custkey AS actor_user, c_name AS actor_name
        FROM customer""".format(w=wiki_sql("c_custkey")),
    "listed": "SELECT c_name AS user_name FROM customer WHERE c_custkey % 3 = 0",
    "linktarget": """SELECT {w} AS wiki, c_custkey AS lt_id, CASE WHEN c_custkey % 2 = 0 THEN 2 ELSE 0 END AS lt_namespace,
        c_name AS lt_user FROM customer""".format(w=wiki_sql("c_custkey")),
    "pagelinks": """SELECT {w} AS wiki, o_orderkey % 200 AS pl_from, o_custkey AS pl_target_id
        FROM orders""".format(w=wiki_sql("(o_orderkey % 200)")),
    "item_keys": """SELECT {w} AS wiki, o_custkey AS page_id, 'Q' || (o_orderkey + 1) AS sort_key
        FROM orders WHERE o_orderkey % 5 = 0""".format(w=wiki_sql("o_custkey")),
    "dims": """SELECT n_nationkey AS k, 'nation_' || n_nationkey || CASE WHEN n_nationkey >= 20 THEN 'wiktionary' ELSE 'wiki' END AS dbname,
        CASE WHEN n_nationkey = 3 THEN 'incubator.wikimedia.org' WHEN n_nationkey = 4 THEN 'commons.wikimedia.org'
             WHEN n_nationkey >= 20 THEN 'nation-' || n_nationkey || '.wiktionary.org'
             ELSE 'nation-' || n_nationkey || '.wikipedia.org' END AS domain,
        CASE WHEN n_nationkey IN (3, 4) THEN '' ELSE 'nation-' || n_nationkey END AS lang_code,
        CASE WHEN n_nationkey = 3 THEN 'wikimedia' WHEN n_nationkey = 4 THEN 'commons' WHEN n_nationkey >= 20 THEN 'wiktionary'
             ELSE 'wikipedia' END AS wiki_group,
        CASE WHEN n_nationkey = 3 THEN 'incubator' WHEN n_nationkey = 4 THEN 'commons' WHEN n_nationkey >= 20 THEN 'wiktionary'
             ELSE 'wiki' END AS site_code,
        CASE WHEN n_nationkey % 2 = 0 THEN '/wiki/' ELSE '/w/' END AS path,
        CASE WHEN n_nationkey = 2 THEN '' ELSE 'nation-' || n_nationkey END AS lang
        FROM nation""",
    "ns": """SELECT k, domain, ns_id, CASE WHEN ns_id = 2 THEN 'User_' || k ELSE name END AS name
        FROM dims, (VALUES (0, ''), (1, 'Talk'), (2, 'User'), (6, 'File'), (14, 'Category')) AS v(ns_id, name)""",
}
NEEDS = {"ns": ["dims"]}


def with_ctes(*names: str) -> str:
    """WITH clause of the named views."""
    order: list[str] = []
    for name in names:
        for needed in [*NEEDS.get(name, []), name]:
            if needed not in order:
                order.append(needed)
    return "WITH " + ",\n".join("{} AS ({})".format(n, CTE[n]) for n in order) + "\n"
