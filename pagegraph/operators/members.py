"""Category members and pile pages, from tables or landed feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagegraph.functions import fixed
from pagegraph.functions.text import bytes_title, page_title, qid, quote, strip, without_prefix
from pagegraph.functions.wiki import project_group, project_parts, project_site_url
from pagegraph.operators.changes import item_ids, latest_change_per_page, split_full_title
from pagegraph.operators.ranking import newest_first


def clean_prefixes(values: list[str]) -> list[str]:
    """Argument check of title prefixes: at most 10 of at most 10 characters, ``...`` cut."""
    out: list[str] = []
    for part in (p for value in values for p in value.split(",")):
        text = part.strip().removesuffix("...").rstrip().lstrip(":").replace(" ", "_").removesuffix("...").rstrip()
        if not text or text in out:
            continue
        if len(text) > fixed.MAX_PREFIX_LENGTH:
            raise ValueError("a title prefix has at most {} characters".format(fixed.MAX_PREFIX_LENGTH))
        out.append(text)
        if len(out) > fixed.MAX_PREFIXES:
            raise ValueError("at most {} title prefixes".format(fixed.MAX_PREFIXES))
    return sorted(out)


def any_prefix(title: Column, prefixes: list[str]) -> Column:
    """Literal prefixes joined by OR; no prefixes keep everything."""
    out = F.lit(not prefixes)
    for prefix in prefixes:
        out = out | F.startswith(title, F.lit(prefix))
    return out


def in_namespaces(namespace: Column, namespaces: list[int]) -> Column:
    return namespace.isin(*namespaces) if namespaces else F.lit(True)


def at_least_revision(revision: Column, minimum: int | None) -> Column:
    return F.lit(True) if minimum is None else revision >= minimum


def _category_keys(categorylinks: DataFrame, linktarget: DataFrame, category: str) -> DataFrame:
    target = linktarget.where((F.col("lt_namespace") == fixed.CATEGORY_NAMESPACE) & (F.col("lt_title") == category))
    return categorylinks.join(
        target.select("wiki", F.col("lt_id").alias("cl_target_id")), ["wiki", "cl_target_id"], "left_semi"
    ).select("wiki", F.col("cl_from").alias("page_id"), F.col("cl_sortkey_prefix").alias("sort_key"))


def category_members(
    page: DataFrame,
    categorylinks: DataFrame,
    linktarget: DataFrame,
    category: str = fixed.ITEM_CATEGORY,
    namespaces: list[int] | None = None,
    min_revision: int | None = None,
    prefixes: list[str] | None = None,
) -> DataFrame:
    """(wiki, page_id, title, namespace, sort_key) of pages in a category."""
    pages = page.where(
        in_namespaces(F.col("page_namespace"), namespaces or [])
        & at_least_revision(F.col("page_latest"), min_revision)
        & any_prefix(F.col("page_title"), prefixes or [])
    ).select("wiki", "page_id", F.col("page_title").alias("title"), F.col("page_namespace").alias("namespace"))
    return pages.join(_category_keys(categorylinks, linktarget, category), ["wiki", "page_id"])


def changed_members(
    recentchanges: DataFrame,
    categorylinks: DataFrame,
    linktarget: DataFrame,
    category: str = fixed.ITEM_CATEGORY,
    namespaces: list[int] | None = None,
    min_revision: int | None = None,
    prefixes: list[str] | None = None,
) -> DataFrame:
    """Members with a recent edit or move, with the newest change id; the filters look at that change."""
    latest = latest_change_per_page(recentchanges).where(
        in_namespaces(F.col("rc_namespace"), namespaces or [])
        & at_least_revision(F.col("rc_this_oldid"), min_revision)
        & any_prefix(F.col("rc_title"), prefixes or [])
    )
    rows = latest.select(
        "wiki",
        F.col("rc_cur_id").alias("page_id"),
        F.col("rc_title").alias("title"),
        F.col("rc_namespace").alias("namespace"),
        "rc_id",
    )
    return rows.join(_category_keys(categorylinks, linktarget, category), ["wiki", "page_id"])


def newest_members(members: DataFrame, cutoff_key: int | None, limit: int | None = None) -> DataFrame:
    """Feed members not older than the cut-off, newest first; feed order settles equal times."""
    rows = members.where(F.col("time_key").isNotNull())
    if cutoff_key is not None:
        rows = rows.where(F.col("time_key") >= cutoff_key)
    order = [F.desc("time_key"), F.asc("wiki"), F.asc("seq"), F.asc("position")]
    return newest_first(rows, order, limit)


def member_records(members: DataFrame, page_base: str, namespace_names: dict[int, str] | None = None) -> DataFrame:
    """Records of ``project/lang/name`` members: address, site, group, language, item id."""
    names = namespace_names or {}
    name = F.lit("")
    for number, text in names.items():
        name = F.when(F.col("namespace") == number, F.lit(text)).otherwise(name)
    space = F.greatest(F.col("namespace"), F.lit(0))
    lower = F.when(space > 0, F.lower(name)).otherwise(F.lit(""))
    raw = bytes_title(F.col("title"))
    for prefix in sorted(set(names.values())):
        match = (lower == prefix.lower()) & F.startswith(F.lower(raw), F.lit(prefix.lower() + ":"))
        raw = F.when(match, without_prefix(raw, F.substring(raw, F.lit(1), F.lit(len(prefix))))).otherwise(raw)
    title = page_title(raw)
    parts = project_parts(title)
    item = qid(F.col("sort_key"))
    address = F.when(lower != "", F.concat(lower, F.lit(":"), title)).otherwise(title)
    base = F.lit(page_base)
    carried = [c for c in members.columns if c not in ("title", "namespace", "sort_key")]
    return members.select(
        *carried,
        F.col("namespace").cast("bigint").alias("namespace"),
        title.alias("page_title"),
        parts["project"].alias("wiki_project"),
        project_group(parts["project"]).alias("wiki_group"),
        parts["lang"].alias("lang_code"),
        parts["name"].alias("page_name"),
        F.replace(parts["name"], F.lit("_"), F.lit(" ")).alias("page_label"),
        F.concat(base, quote(address)).alias("page_url"),
        project_site_url(base, parts["project"], parts["lang"]).alias("site_url"),
        item.alias("wikidata_id"),
        F.concat(F.lit(fixed.ITEM_ENTITY), item).alias("wikidata_entity"),
    ).where(F.col("page_title") != "")


def pile_pages(
    titles: DataFrame,
    page: DataFrame,
    page_props: DataFrame,
    aliases: DataFrame,
    categorylinks: DataFrame | None = None,
    linktarget: DataFrame | None = None,
) -> DataFrame:
    """Pages of pile titles, in pile order; titles without a page drop out.

    ``titles`` has pile keys, wiki, domain, position and title. A title found twice in the page
    table means the page with the greatest id.
    """
    split = split_full_title(titles, "title", aliases)
    wanted = split.select("wiki", "ns_id", "db_title").distinct()
    pages = page.select(
        "wiki",
        F.col("page_namespace").cast("bigint").alias("ns_id"),
        bytes_title(F.col("page_title")).alias("db_title"),
        "page_id",
    ).join(wanted, ["wiki", "ns_id", "db_title"], "left_semi")
    one = pages.groupBy("wiki", "ns_id", "db_title").agg(F.max("page_id").alias("page_id"))
    items = item_ids(page_props, categorylinks, linktarget)
    found = one.join(items, ["wiki", "page_id"], "left")
    return split.join(found, ["wiki", "ns_id", "db_title"]).select(
        *titles.columns, "ns_id", "db_title", "page_id", qid(F.col("qid_text")).alias("wikidata_id")
    )


def blank(text: Column) -> Column:
    return F.coalesce(strip(text), F.lit("")) == ""
