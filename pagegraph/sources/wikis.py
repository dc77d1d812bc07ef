"""Wiki dimensions from site-matrix and siteinfo documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagegraph.functions.text import integer, page_title, strip
from pagegraph.functions.wiki import code_group, site_root

_SITE = "array<struct<url:string,dbname:string,code:string>>"


def wiki_dimension(documents: DataFrame, json_column: str, order_column: str) -> DataFrame:
    """One row per domain from site-matrix documents; the last entry of a domain wins.

    Entries follow document order: ``specials`` entries carry no language, the entries below a
    numbered group carry the group's code.
    """
    text = F.col(json_column)
    keys = F.json_object_keys(text)
    raw = F.from_json(text, "map<string,string>")
    groups = documents.select(order_column, F.posexplode(keys).alias("_g", "_key"), raw.alias("_raw")).select(
        order_column, "_g", "_key", F.element_at("_raw", F.col("_key")).alias("_text")
    )
    group = F.from_json(F.col("_text"), "struct<code:string,site:{}>".format(_SITE))
    special = F.col("_key") == "specials"
    sites = F.when(special, F.from_json(F.col("_text"), _SITE)).otherwise(group["site"])
    lang = F.when(special, F.lit("")).otherwise(F.lower(strip(F.coalesce(group["code"], F.lit("")))))
    entries = groups.select(order_column, "_g", lang.alias("lang_code"), F.posexplode(sites).alias("_s", "site"))
    code = F.lower(strip(F.coalesce(F.col("site.code"), F.lit(""))))
    rows = entries.select(
        F.struct(order_column, "_g", "_s").alias("_place"),
        site_root(F.col("site.url")).alias("root"),
        F.lower(strip(F.coalesce(F.col("site.dbname"), F.lit("")))).alias("dbname"),
        "lang_code",
        code_group(code).alias("wiki_group"),
        code.alias("site_code"),
    ).where(F.col("root").isNotNull() & (F.col("dbname") != ""))
    value = F.struct("dbname", "lang_code", "wiki_group", F.col("root.site_url").alias("site_url"), "site_code")
    return (
        rows.groupBy(F.col("root.domain").alias("domain"))
        .agg(F.max_by(value, F.col("_place")).alias("_v"))
        .select("domain", "_v.*")
    )


_INFO = (
    "struct<general:struct<articlepath:string,lang:string>,"
    "namespaces:map<string,struct<`*`:string,canonical:string>>,"
    "namespacealiases:array<struct<id:string,`*`:string,alias:string>>,"
    "interwikimap:array<struct<prefix:string,url:string>>>"
)


def _query(json_column: str):
    return F.from_json(F.col(json_column), "struct<query:{}>".format(_INFO))["query"]


def siteinfo_dimension(documents: DataFrame, json_column: str) -> DataFrame:
    """(domain, article_path, lang)."""
    general = _query(json_column)["general"]
    path = F.coalesce(F.nullif(strip(general["articlepath"]), F.lit("")), F.lit("/wiki/$1"))
    lang = F.lower(strip(F.coalesce(general["lang"], F.lit(""))))
    return documents.select("domain", path.alias("article_path"), lang.alias("lang"))


def namespace_dimension(documents: DataFrame, json_column: str) -> DataFrame:
    """(domain, ns_id, name) from the namespace maps."""
    spaces = documents.select("domain", F.explode(_query(json_column)["namespaces"]).alias("_id", "_ns"))
    return spaces.select(
        "domain", integer(F.col("_id")).alias("ns_id"), page_title(F.col("_ns.`*`")).alias("name")
    ).where(F.col("ns_id").isNotNull())


def namespace_aliases(documents: DataFrame, json_column: str) -> DataFrame:
    """Distinct (domain, ns_id, alias): local names, canonical names and extra aliases."""
    query = _query(json_column)
    spaces = documents.select("domain", F.explode(query["namespaces"]).alias("_id", "_ns")).select(
        "domain", integer(F.col("_id")).alias("ns_id"), F.explode(F.array("_ns.`*`", "_ns.canonical")).alias("_name")
    )
    extra = documents.select("domain", F.explode(query["namespacealiases"]).alias("_a")).select(
        "domain",
        integer(F.col("_a.id")).alias("ns_id"),
        F.coalesce(F.nullif(F.col("_a.`*`"), F.lit("")), F.col("_a.alias")).alias("_name"),
    )
    named = spaces.unionByName(extra).select("domain", "ns_id", page_title(F.col("_name")).alias("alias"))
    return named.where(F.col("ns_id").isNotNull() & (F.col("alias") != "")).distinct()


def interwiki_dimension(documents: DataFrame, json_column: str) -> DataFrame:
    """(domain, prefix, url); the last entry of a prefix wins."""
    rows = documents.select("domain", F.posexplode(_query(json_column)["interwikimap"]).alias("_i", "_e")).select(
        "domain", strip(F.col("_e.prefix")).alias("prefix"), strip(F.col("_e.url")).alias("url"), "_i"
    )
    rows = rows.where((F.col("prefix") != "") & (F.col("url") != ""))
    return rows.groupBy("domain", "prefix").agg(F.max_by("url", "_i").alias("url"))
