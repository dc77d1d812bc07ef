"""Cross-wiki links: parse, look up, follow aliases, attach what was found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagegraph.functions import fixed
from pagegraph.functions.text import bytes_title, db_title, integer, let, page_title, qid, quote, strip
from pagegraph.functions.times import xsd_datetime
from pagegraph.functions.wiki import token_site_domain
from pagegraph.operators.chains import chain_ends, single_steps
from pagegraph.sources.feeds import page_length


def link_targets(text: Column) -> Column:
    """array<struct<uri, site, namespace, api_title, db_title>> of a ``site:ns:title|…`` cell.

    Unreadable parts are dropped, the first of equal addresses is kept, order is kept.
    """

    split = F.transform(F.split(text, r"\|"), lambda part: F.split(strip(part), ":", 3))
    whole = F.filter(split, lambda bits: F.size(bits) == 3)
    read = F.transform(
        whole,
        lambda bits: F.struct(
            F.lower(strip(F.get(bits, 0))).alias("site"),
            integer(F.get(bits, 1)).alias("namespace"),
            page_title(F.get(bits, 2)).alias("api_title"),
        ),
    )
    addressed = F.transform(
        F.filter(read, lambda t: t["namespace"].isNotNull() & (t["api_title"] != "")),
        lambda t: F.struct(
            F.concat(F.lit("https://"), token_site_domain(t["site"]), F.lit("/wiki/"), quote(t["api_title"])).alias("uri"),
            t["site"].alias("site"),
            t["namespace"].alias("namespace"),
            t["api_title"].alias("api_title"),
            db_title(t["api_title"], t["namespace"]).alias("db_title"),
        ),
    )
    found = F.filter(addressed, lambda t: t["uri"].isNotNull())
    # first of equal addresses by sorting (address, place) in the cell, then back to the places
    placed = F.transform(found, lambda t, i: F.struct(t["uri"].alias("uri"), i.alias("i"), t.alias("t")))
    first = let(F.array_sort(placed), lambda s: F.filter(s, lambda x, i: (i == 0) | (F.get(s, i - 1)["uri"] != x["uri"])))
    back = F.array_sort(F.transform(first, lambda x: F.struct(x["i"].alias("i"), x["t"].alias("t"))))
    return F.transform(back, lambda x: x["t"])


def explode_links(rows: DataFrame, keys: list[str], column: str) -> DataFrame:
    """(keys, link_pos, uri, site, namespace, api_title, db_title): no shuffle, order kept by number."""
    found = rows.select(*keys, F.posexplode_outer(link_targets(F.col(column))).alias("link_pos", "_t"))
    return found.where(F.col("link_pos").isNotNull()).select(*keys, F.col("link_pos").cast("bigint").alias("link_pos"), "_t.*")


def lookup_targets(links: DataFrame) -> DataFrame:
    """Distinct lookup keys; duplicates go away before any join."""
    return links.select("site", "namespace", "api_title", "db_title").distinct()


def direct_qid(site: Column, namespace: Column, api_title: Column, stored_title: Column) -> Column:
    """Item pages in namespace 0 name their own id; no lookup is needed."""
    pattern = r"^[Qq][1-9][0-9]*$"
    pick = F.when(api_title.rlike(pattern), api_title).when(stored_title.rlike(pattern), stored_title)
    here = site.isin("wikidatawiki", fixed.WIKIDATA_DOMAIN) & (namespace == 0)
    return F.when(here, F.concat(F.lit("Q"), F.substring(pick, F.lit(2), F.length(pick))))


def table_lookup(targets: DataFrame, page: DataFrame, page_props: DataFrame, revision: DataFrame) -> DataFrame:
    """(site, api_title, qid, page_len, rev_timestamp) of the targets found in the page tables.

    The page table is cut down to the wanted titles first. If a title exists twice the greatest
    page id wins.
    """
    wanted = targets.select("site", "namespace", "db_title").distinct()
    pages = page.select(
        F.col("wiki").alias("site"),
        F.col("page_namespace").cast("bigint").alias("namespace"),
        bytes_title(F.col("page_title")).alias("db_title"),
        "page_id",
        "page_len",
        "page_latest",
    )
    hits = pages.join(wanted, ["site", "namespace", "db_title"])
    props = page_props.where(F.col("pp_propname") == fixed.ITEM_PROPERTY).select(
        F.col("wiki").alias("site"), F.col("pp_page").alias("page_id"), "pp_value"
    )
    latest = revision.select(
        F.col("wiki").alias("site"), F.col("rev_id").alias("page_latest"), F.col("rev_timestamp").alias("_rev")
    )
    full = hits.join(props, ["site", "page_id"], "left").join(latest, ["site", "page_latest"], "left")
    found = F.struct(
        qid(F.col("pp_value")).alias("qid"),
        page_length(F.col("page_len").cast("string")).alias("page_len"),
        xsd_datetime(F.col("_rev")).alias("rev_timestamp"),
    )
    best = full.groupBy("site", "namespace", "db_title").agg(F.max_by(found, F.struct("page_id", "pp_value")).alias("_f"))
    return (
        targets.select("site", "namespace", "db_title", "api_title")
        .distinct()
        .join(best, ["site", "namespace", "db_title"])
        .groupBy("site", "api_title")
        .agg(F.max_by("_f", F.struct("namespace", "db_title")).alias("_f"))
        .select("site", "api_title", "_f.*")
    )


def resolve_aliases(titles: DataFrame, aliases: DataFrame, key: str = "title") -> DataFrame:
    """(wiki, title, final_title): follow aliases to the end, stop where a title repeats.

    Of several targets of a title the greatest counts. The rounds double what they follow, see
    :func:`chain_ends`, so long chains and rings take few of them.
    """
    ends = chain_ends(single_steps(aliases, "wiki", "source", "target"))
    known = ends.select(F.col("key").alias("wiki"), F.col("node").alias(key), "end")
    found = titles.select("wiki", key).distinct().join(known, ["wiki", key], "left")
    return found.select("wiki", key, F.coalesce("end", key).alias("final_title"))


def alias_lookup(titles: DataFrame, aliases: DataFrame, pages: DataFrame) -> DataFrame:
    """Page row of each title's final title, else of the title itself; unknown titles drop out."""
    final = resolve_aliases(titles, aliases)
    row = F.struct("qid", "page_len", "rev_timestamp")
    by_final = pages.select("wiki", F.col("title").alias("final_title"), row.alias("_a"))
    by_title = pages.select("wiki", "title", row.alias("_b"))
    joined = final.join(by_final, ["wiki", "final_title"], "left").join(by_title, ["wiki", "title"], "left")
    return joined.select("wiki", "title", F.coalesce("_a", "_b").alias("_r")).where(F.col("_r").isNotNull()).select(
        "wiki", "title", "_r.*"
    )


def attach_enrichment(links: DataFrame, found: DataFrame) -> DataFrame:
    """Links with qid, page_len, rev_timestamp; a link without any of them keeps nulls.

    ``enriched`` tells whether the link has a payload at all.
    """
    own = direct_qid(F.col("site"), F.col("namespace"), F.col("api_title"), F.col("db_title"))
    joined = links.withColumn("_own", own).join(found, ["site", "api_title"], "left")
    item = F.coalesce(F.col("qid"), F.col("_own"))
    some = item.isNotNull() | F.col("page_len").isNotNull() | F.col("rev_timestamp").isNotNull()
    return joined.select(*links.columns, item.alias("qid"), "page_len", "rev_timestamp", some.alias("enriched"))


def link_fields(linked: DataFrame) -> DataFrame:
    """Long fields (dataset_id, position, s, key, kind, value) of enriched links.

    The link itself hangs on the row's subject, everything known about it on the link.
    """
    uri = F.col("uri")

    def entry(subject: Column, key: str, kind: str, value: Column) -> Column:
        return F.struct(
            subject.alias("s"), F.lit(key).alias("key"), F.lit(kind).alias("kind"), value.cast("string").alias("value")
        )

    parts = F.array(
        entry(F.col("s"), "gil_link", "iri", uri),
        entry(uri, "gil_link_page_len", "xsd:integer", F.col("page_len")),
        entry(uri, "gil_link_rev_timestamp", "xsd:dateTime", F.col("rev_timestamp")),
        entry(uri, "gil_link_wikidata_id", "xsd:string", F.col("qid")),
        entry(uri, "gil_link_wikidata_entity", "iri", F.concat(F.lit(fixed.ITEM_ENTITY), F.col("qid"))),
    )
    some = F.filter(parts, lambda f: f["value"].isNotNull())
    return linked.select("dataset_id", "position", F.explode_outer(some).alias("_f")).select("dataset_id", "position", "_f.*")
