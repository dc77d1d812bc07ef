"""Newest and most recently edited pages of many wikis, from replica-shaped tables.

Every table carries a ``wiki`` column, so many wikis are one job. Times are 14-digit texts, floors
compare digits. Aggregations run before joins wherever the result allows it.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagegraph.functions import fixed
from pagegraph.functions.text import (
    after_first,
    before_first,
    bytes_title,
    casefold,
    page_title,
    present,
    qid,
    strip,
    user_name,
)
from pagegraph.functions.times import numeric_time, xsd_datetime
from pagegraph.functions.wiki import (
    full_title,
    interwiki_target,
    local_user,
    namespaced_user,
    page_url,
    project_parts,
    project_title_group,
)
from pagegraph.operators.chains import chain_ends, single_steps
from pagegraph.operators.ranking import first_per_key, newest_first, top_k_per_key
from pagegraph.session import checkpointed

ROW = ["wiki", "page_id", "page_title", "page_namespace", "qid_text", "timestamp"]


# --- row filters ---------------------------------------------------------------------------------


def at_or_after(stamp: Column, floor: str | None) -> Column:
    """Inclusive floor on 14-digit text; no floor keeps everything."""
    return F.lit(True) if floor is None else stamp >= F.lit(floor)


def not_commons_file(wiki: Column, namespace: Column, commons: str = "commonswiki") -> Column:
    return ~((wiki == commons) & (namespace == fixed.FILE_NAMESPACE))


def only_users(df: DataFrame, name_column: str, users: DataFrame) -> DataFrame:
    """Rows whose user is on the list (``user_name``), compared caselessly."""
    allowed = users.select(casefold(user_name(F.col("user_name"))).alias("_user")).distinct()
    key = casefold(user_name(F.col(name_column)))
    return df.withColumn("_user", key).join(allowed, "_user", "left_semi").drop("_user")


def user_actors(actor: DataFrame, users: DataFrame) -> DataFrame:
    """(wiki, actor_id) of the listed user names, spelled exactly as normalized."""
    names = users.select(user_name(F.col("user_name")).alias("actor_name")).where(F.col("actor_name").isNotNull())
    return actor.join(names.distinct(), "actor_name", "left_semi").select("wiki", "actor_id")


# --- new pages -----------------------------------------------------------------------------------


def item_ids(page_props: DataFrame, categorylinks: DataFrame | None = None, linktarget: DataFrame | None = None) -> DataFrame:
    """(wiki, page_id, qid_text): page property, else the sort key in the item category.

    If a page has several values the greatest text wins.
    """
    props = page_props.where((F.col("pp_propname") == fixed.ITEM_PROPERTY) & F.col("pp_value").isNotNull()).select(
        "wiki", F.col("pp_page").alias("page_id"), F.col("pp_value").alias("qid_text"), F.lit(0).alias("_source")
    )
    if categorylinks is None or linktarget is None:
        return props.drop("_source")
    target = linktarget.where(
        (F.col("lt_namespace") == fixed.CATEGORY_NAMESPACE) & (F.col("lt_title") == fixed.ITEM_CATEGORY)
    ).select("wiki", F.col("lt_id").alias("cl_target_id"))
    keys = categorylinks.where(F.col("cl_sortkey_prefix").isNotNull()).join(target, ["wiki", "cl_target_id"], "left_semi")
    fallback = keys.select(
        "wiki", F.col("cl_from").alias("page_id"), F.col("cl_sortkey_prefix").alias("qid_text"), F.lit(1).alias("_source")
    )
    return (
        props.unionByName(fallback)
        .groupBy("wiki", "page_id")
        .agg(F.max_by("qid_text", F.struct((-F.col("_source")).alias("s"), "qid_text")).alias("qid_text"))
    )


def new_page_rows(
    recentchanges: DataFrame,
    page: DataFrame,
    items: DataFrame,
    floor: str | None = None,
    actors: DataFrame | None = None,
    per_wiki: int | None = None,
    commons: str = "commonswiki",
) -> DataFrame:
    """Creations ⋈ page ⋈ item id, filtered before the joins; only the newest ``per_wiki`` per wiki if given."""
    changes = recentchanges.where(
        (F.col("rc_source") == "mw.new")
        & not_commons_file(F.col("wiki"), F.col("rc_namespace"), commons)
        & at_or_after(F.col("rc_timestamp"), floor)
    )
    if actors is not None:
        changes = changes.join(actors.withColumnRenamed("actor_id", "rc_actor"), ["wiki", "rc_actor"], "left_semi")
    slim = changes.select("wiki", F.col("rc_cur_id").alias("page_id"), F.col("rc_timestamp").alias("timestamp"))
    rows = slim.join(page.select("wiki", "page_id", "page_title", "page_namespace"), ["wiki", "page_id"]).join(
        items.select("wiki", "page_id", "qid_text"), ["wiki", "page_id"]
    )
    return capped(rows.select(*ROW), per_wiki)


def capped(rows: DataFrame, per_wiki: int | None) -> DataFrame:
    """Newest rows per wiki, all rows without a number; equal times order by title, then page id and item text."""
    if per_wiki is None:
        return rows
    order = [F.desc("timestamp"), F.asc("page_title"), F.asc("page_id"), F.asc("qid_text")]
    return top_k_per_key(rows, ["wiki"], order, per_wiki)


def new_page_rows_two_branches(
    recentchanges: DataFrame,
    page: DataFrame,
    page_props: DataFrame,
    categorylinks: DataFrame,
    linktarget: DataFrame,
    floor: str | None = None,
    actors: DataFrame | None = None,
    per_wiki: int | None = None,
) -> DataFrame:
    """Branch with item property united with the sort-key branch, capped once over both.

    A page with several sort keys keeps one row per key, as the joins give it.
    """
    props = item_ids(page_props)
    primary = new_page_rows(recentchanges, page, props, floor, actors, per_wiki)
    target = linktarget.where(
        (F.col("lt_namespace") == fixed.CATEGORY_NAMESPACE) & (F.col("lt_title") == fixed.ITEM_CATEGORY)
    ).select("wiki", F.col("lt_id").alias("cl_target_id"))
    keys = (
        categorylinks.where(F.col("cl_sortkey_prefix").isNotNull())
        .join(target, ["wiki", "cl_target_id"], "left_semi")
        .select("wiki", F.col("cl_from").alias("page_id"), F.col("cl_sortkey_prefix").alias("qid_text"))
        .join(props.select("wiki", "page_id"), ["wiki", "page_id"], "left_anti")
    )
    fallback = new_page_rows(recentchanges, page, keys, floor, actors, per_wiki)
    return capped(primary.unionByName(fallback), per_wiki)


# --- edited pages --------------------------------------------------------------------------------


def latest_revisions(revision: DataFrame, actors: DataFrame | None, floor: str | None) -> DataFrame:
    """(wiki, page_id, timestamp): newest matching revision per page.

    Aggregated before any page join, so a page with a third of all revisions is one row per task.
    """
    rows = revision.where(at_or_after(F.col("rev_timestamp"), floor))
    if actors is not None:
        rows = rows.join(actors.withColumnRenamed("actor_id", "rev_actor"), ["wiki", "rev_actor"], "left_semi")
    return rows.groupBy("wiki", F.col("rev_page").alias("page_id")).agg(F.max("rev_timestamp").alias("timestamp"))


def edited_page_rows(
    revision: DataFrame,
    page: DataFrame,
    items: DataFrame,
    actors: DataFrame,
    floor: str,
    per_wiki: int | None = None,
    commons: str = "commonswiki",
) -> DataFrame:
    latest = latest_revisions(revision, actors, floor)
    pages = page.where(not_commons_file(F.col("wiki"), F.col("page_namespace"), commons))
    rows = latest.join(pages.select("wiki", "page_id", "page_title", "page_namespace"), ["wiki", "page_id"]).join(
        items.select("wiki", "page_id", "qid_text"), ["wiki", "page_id"]
    )
    return capped(rows.select(*ROW), per_wiki)


def latest_change_per_page(recentchanges: DataFrame) -> DataFrame:
    """Newest edit or move of each page (greatest change id), without a self-join."""
    wanted = (F.col("rc_source") == "mw.edit") | ((F.col("rc_source") == "mw.log") & (F.col("rc_log_type") == "move"))
    rows = recentchanges.where(wanted & (F.col("rc_cur_id") > 0))
    value = F.struct("rc_title", "rc_namespace", "rc_this_oldid", "rc_timestamp")
    return (
        rows.groupBy("wiki", "rc_cur_id")
        .agg(F.max("rc_id").alias("rc_id"), F.max_by(value, "rc_id").alias("_v"))
        .select("wiki", "rc_cur_id", "rc_id", "_v.*")
    )


def latest_contribution_per_page(contributions: DataFrame) -> DataFrame:
    """Newest contribution per page over all users; equal times keep the first one read."""
    order = [-F.col("time_key"), F.col("user_order"), F.col("seq"), F.col("position")]
    return first_per_key(contributions, ["wiki", "page_id"], order)


# --- records -------------------------------------------------------------------------------------


def page_records(
    rows: DataFrame,
    wikis: DataFrame,
    siteinfo: DataFrame,
    namespaces: DataFrame,
    time_column: str = "created_timestamp",
    require_item: bool = True,
) -> DataFrame:
    """Canonical page records of (wiki, page_id, page_title, page_namespace, qid_text, timestamp).

    ``wikis`` is keyed by dbname, the other dimensions by domain. Rows without a usable item id
    drop out when ``require_item`` is set; a Commons file then still gets its item entity.
    """
    dims = wikis.join(siteinfo.select("domain", "article_path", "lang"), "domain", "left").select(
        F.col("dbname").alias("wiki"), "domain", "lang_code", "wiki_group", "site_url", "article_path", "lang"
    )
    names = namespaces.select("domain", F.col("ns_id").alias("page_namespace"), F.col("name").alias("_ns_name"))
    core = bytes_title(F.col("page_title"))
    usable = core != ""
    if require_item:
        usable = usable & F.col("qid_text").rlike(fixed.QID_PATTERN)
    joined = rows.where(usable).join(dims, "wiki").join(names, ["domain", "page_namespace"], "left")
    title = full_title(F.col("page_title"), F.col("page_namespace"), F.col("_ns_name"))
    parts = project_parts(core)
    nested = F.col("domain") == fixed.INCUBATOR_DOMAIN
    lang = F.coalesce(F.nullif(F.col("lang"), F.lit("")), F.nullif(F.col("lang_code"), F.lit("")))
    lang = F.when(nested & (parts["lang"] != ""), parts["lang"]).otherwise(lang)
    group = F.when(nested & (parts["project"] != ""), project_title_group(core)).otherwise(F.col("wiki_group"))
    item = qid(F.col("qid_text"))
    entity = F.concat(F.lit(fixed.ITEM_ENTITY), item)
    if not require_item:
        media = F.concat(F.lit(fixed.MEDIA_ENTITY + "M"), F.col("page_id").cast("string"))
        is_media = (F.col("domain") == fixed.COMMONS_DOMAIN) & (F.col("page_namespace") == fixed.FILE_NAMESPACE)
        entity = F.when(is_media, media).otherwise(entity)
    carried = [c for c in rows.columns if c not in ROW]
    return joined.select(
        *carried,
        F.col("page_id").cast("bigint").alias("page_id"),
        title.alias("page_title"),
        F.replace(title, F.lit("_"), F.lit(" ")).alias("page_label"),
        F.col("page_namespace").cast("bigint").alias("namespace"),
        page_url(
            F.col("domain"), F.col("article_path"), F.col("page_namespace"), F.col("_ns_name"), F.col("page_title")
        ).alias("page_url"),
        "site_url",
        F.col("domain").alias("wiki_domain"),
        F.col("wiki").alias("wiki_dbname"),
        group.alias("wiki_group"),
        lang.alias("lang_code"),
        item.alias("wikidata_id"),
        entity.alias("wikidata_entity"),
        xsd_datetime(F.col("timestamp")).alias(time_column),
        F.coalesce(numeric_time(F.col("timestamp")), F.lit(0)).alias("time_key"),
    )


def newest_records(records: DataFrame, limit: int | None = None) -> DataFrame:
    """Global order: newest first, then domain and title; page id settles what is still equal."""
    return newest_first(records, [F.desc("time_key"), F.asc("wiki_domain"), F.asc("page_title"), F.asc("page_id")], limit)


def namespace_sample(
    recentchanges: DataFrame, page_props: DataFrame, floor: str, per_wiki: int | None = None, keep_negative: bool = True
) -> DataFrame:
    """Creations outside the main namespace that have an item id; the newest per wiki if a number is given."""
    space = F.col("rc_namespace")
    rows = recentchanges.where(
        (F.col("rc_source") == "mw.new")
        & at_or_after(F.col("rc_timestamp"), floor)
        & ((space != 0) if keep_negative else (space > 0))
    ).select(
        "wiki",
        F.col("rc_cur_id").alias("page_id"),
        F.col("rc_title").alias("page_title"),
        space.alias("page_namespace"),
        F.col("rc_timestamp").alias("timestamp"),
    )
    return capped(rows.join(item_ids(page_props), ["wiki", "page_id"]).select(*ROW), per_wiki)


def sample_order(records: DataFrame) -> DataFrame:
    return records.orderBy(F.desc("time_key"), F.asc("wiki_domain"), F.asc("namespace"), F.asc("page_id"))


# --- user lists ----------------------------------------------------------------------------------


def split_full_title(df: DataFrame, title: str, aliases: DataFrame) -> DataFrame:
    """Add ns_id and db_title: a known namespace alias in front is cut, any other stays.

    ``aliases(domain, ns_id, alias)``; an alias of several namespaces means the lowest one.
    """
    clean = page_title(F.col(title))
    rest = page_title(after_first(clean, ":"))
    key = F.when(rest != "", F.nullif(F.lower(strip(before_first(clean, ":"))), F.lit("")))
    dim = aliases.groupBy("domain", F.lower(strip(F.col("alias"))).alias("_key")).agg(F.min("ns_id").alias("ns_id"))
    return (
        df.withColumn("_key", key)
        .join(dim, ["domain", "_key"], "left")
        .withColumn("db_title", F.when(F.col("ns_id").isNotNull(), rest).otherwise(clean))
        .withColumn("ns_id", F.coalesce(F.col("ns_id"), F.lit(0)).cast("bigint"))
        .select(*df.columns, "ns_id", "db_title")
    )


def chase_redirects(starts: DataFrame, page: DataFrame, redirect: DataFrame) -> DataFrame:
    """Add page_id: the page reached at the end of the redirects.

    ``starts`` has wiki, ns_id and db_title. A start that meets no page keeps null; a redirect to a
    missing page ends at the redirect. A chain that comes back ends at the last page before the
    repeat. Redirects are resolved once to pairs of page ids; their ends come from pointer doubling, see
    :func:`chain_ends`.
    """
    pages = page.select(
        "wiki",
        F.col("page_namespace").cast("bigint").alias("_ns"),
        F.col("page_title").alias("_title"),
        F.col("page_id").cast("bigint").alias("_id"),
    )
    moves = redirect.where(F.coalesce(F.col("rd_title"), F.lit("")) != "").select(
        "wiki",
        F.col("rd_from").cast("bigint").alias("_id"),
        F.col("rd_namespace").cast("bigint").alias("_rns"),
        F.col("rd_title").alias("_rtitle"),
    )
    titles = pages.groupBy("wiki", "_ns", "_title").agg(F.max("_id").alias("_to"))
    aimed = moves.select("wiki", "_id", F.col("_rns").alias("_ns"), F.nullif(bytes_title(F.col("_rtitle")), F.lit("")).alias("_title"))
    nexts = checkpointed(aimed.join(titles, ["wiki", "_ns", "_title"]).where("_to <> _id").groupBy("wiki", "_id").agg(F.max("_to").alias("_to")))
    first = titles.select("wiki", F.col("_ns").alias("ns_id"), F.col("_title").alias("db_title"), F.col("_to").alias("_start"))
    found = starts.withColumn("ns_id", F.col("ns_id").cast("bigint")).join(first, ["wiki", "ns_id", "db_title"], "left")
    last = chain_ends(single_steps(nexts, "wiki", "_id", "_to"))
    ends = last.select(F.col("key").alias("wiki"), F.col("node").alias("_start"), F.col("last").alias("_end"))
    out = found.join(ends, ["wiki", "_start"], "left")
    return out.select(*starts.columns, F.coalesce("_end", "_start").cast("bigint").alias("page_id"))


def listed_users(
    start_pages: DataFrame,
    pagelinks: DataFrame,
    linktarget: DataFrame,
    iwlinks: DataFrame | None = None,
    wikis: DataFrame | None = None,
    aliases: DataFrame | None = None,
) -> DataFrame:
    """Distinct users (wiki, page_id, user_name) linked from user-list pages.

    Local user-namespace links come first, interwiki links after them; of names that differ only
    in case the first in (source, spelling) order is kept.
    """
    targets = linktarget.where(F.col("lt_namespace") == 2).select("wiki", F.col("lt_id").alias("pl_target_id"), "lt_title")
    local = (
        start_pages.select("wiki", "page_id")
        .distinct()
        .join(pagelinks.select("wiki", F.col("pl_from").alias("page_id"), "pl_target_id"), ["wiki", "page_id"])
        .join(targets, ["wiki", "pl_target_id"])
        .select("wiki", "page_id", local_user(F.col("lt_title")).alias("user_name"), F.lit(0).alias("_source"))
    )
    names = local
    if iwlinks is not None:
        names = names.unionByName(_interwiki_users(start_pages, iwlinks, wikis, aliases))
    keyed = names.where(F.col("user_name").isNotNull()).withColumn("_key", casefold(F.col("user_name")))
    kept = keyed.groupBy("wiki", "page_id", "_key").agg(
        F.min_by("user_name", F.struct("_source", "user_name")).alias("user_name")
    )
    return kept.select("wiki", "page_id", "user_name")


def _interwiki_users(start_pages: DataFrame, iwlinks: DataFrame, wikis: DataFrame, aliases: DataFrame) -> DataFrame:
    source = wikis.select(F.col("dbname").alias("wiki"), F.col("wiki_group").alias("_group"))
    by_code = wikis.where(F.coalesce(F.col("lang_code"), F.lit("")) == "").groupBy(
        F.col("site_code").alias("_prefix")
    ).agg(F.min("domain").alias("_dynamic"))
    links = (
        start_pages.select("wiki", "page_id")
        .distinct()
        .join(iwlinks.withColumnRenamed("iwl_from", "page_id"), ["wiki", "page_id"])
        .join(source, "wiki")
        .withColumn("_prefix", F.lower(strip(F.col("iwl_prefix"))))
        .join(by_code, "_prefix", "left")
    )
    target = interwiki_target(F.col("iwl_prefix"), F.col("iwl_title"), F.col("_group"), F.col("_dynamic"))
    reached = links.select("wiki", "page_id", present(target).alias("_t"))
    named = reached.select(
        "wiki", "page_id", F.col("_t.domain").alias("domain"), present(namespaced_user(F.col("_t.title"))).alias("_u")
    )
    spaces = aliases.where(F.col("ns_id") == 2).select("domain", F.lower(strip(F.col("alias"))).alias("_p")).distinct()
    known = wikis.select("domain").distinct()
    return (
        named.withColumn("_p", F.col("_u.prefix"))
        .join(known, "domain", "left_semi")
        .join(spaces, ["domain", "_p"], "left_semi")
        .select("wiki", "page_id", F.col("_u.user").alias("user_name"), F.lit(1).alias("_source"))
    )


def registered_users(users: DataFrame, localuser: DataFrame) -> DataFrame:
    """(user_name, wiki): wikis where each listed user has an account."""
    names = users.select(user_name(F.col("user_name")).alias("user_name")).where(F.col("user_name").isNotNull()).distinct()
    accounts = localuser.select(
        user_name(F.col("lu_name")).alias("user_name"), F.lower(strip(F.col("lu_wiki"))).alias("wiki")
    ).where(F.coalesce(F.col("wiki"), F.lit("")) != "")
    return accounts.join(names, "user_name", "left_semi").distinct()


def recently_active_users(users: DataFrame, user: DataFrame, actor: DataFrame, revision: DataFrame, floor: str) -> DataFrame:
    """Listed users of a wiki with at least one revision since ``floor``."""
    actors = actor.select("wiki", F.col("actor_id").alias("rev_actor"), F.col("actor_user").alias("user_id"))
    active = (
        revision.where(at_or_after(F.col("rev_timestamp"), floor))
        .select("wiki", "rev_actor")
        .distinct()
        .join(actors, ["wiki", "rev_actor"])
        .select("wiki", "user_id")
    )
    names = users.select(user_name(F.col("user_name")).alias("user_name")).distinct()
    return (
        user.join(names, "user_name", "left_semi").join(active, ["wiki", "user_id"], "left_semi").select("wiki", "user_name").distinct()
    )


def wikis_with_changes(
    wikis: DataFrame,
    recentchanges: DataFrame,
    actors: DataFrame,
    sources: list[str],
    floor: str | None,
    key: str = "dbname",
    commons: str = "commonswiki",
) -> DataFrame:
    """Wikis that have at least one matching change by the actors."""
    matching = (
        recentchanges.where(
            F.col("rc_source").isin(*sources)
            & at_or_after(F.col("rc_timestamp"), floor)
            & not_commons_file(F.col("wiki"), F.col("rc_namespace"), commons)
        )
        .join(actors.withColumnRenamed("actor_id", "rc_actor"), ["wiki", "rc_actor"], "left_semi")
        .select(F.col("wiki").alias(key))
        .distinct()
    )
    return wikis.join(matching, key, "left_semi")


def wikis_of_active_accounts(wikis: DataFrame, accounts: DataFrame) -> DataFrame:
    """Wikis where a merged account has edits; an unreadable count counts as active.

    ``accounts(wiki, editcount)``. Whether the filter is worth a look-up is for the caller to decide;
    it never depends on the number of wikis.
    """
    count = strip(F.col("editcount").cast("string")).try_cast("bigint")
    active = accounts.where(count.isNull() | (count > 0)).select(F.lower(strip(F.col("wiki"))).alias("dbname")).distinct()
    return wikis.join(active, "dbname", "left_semi")


# --- windows in time (computed once from an explicit ``as_of``) ----------------------------------


def _digits(moment: datetime) -> str:
    return moment.strftime("%Y%m%d%H%M%S")


def activity_floor(timestamp: str | None, as_of: datetime) -> str:
    """The later of the wanted time and 60 days before ``as_of``."""
    floor = _digits(as_of - timedelta(days=fixed.EDITED_WINDOW_DAYS))
    return floor if timestamp is None else max(timestamp, floor)


def _earliest(timestamp: str) -> datetime:
    month, day = int(timestamp[4:6]) or 1, int(timestamp[6:8]) or 1
    return datetime(int(timestamp[:4]), month, day, *(int(timestamp[i : i + 2]) for i in (8, 10, 12)))


def edited_window_ok(timestamp: str, as_of: datetime) -> bool:
    return _earliest(timestamp) >= as_of - timedelta(days=fixed.EDITED_WINDOW_DAYS)


def use_precheck(edited: bool, timestamp: str | None, as_of: datetime) -> bool:
    """Whether the change tables reach back far enough to check wikis for matching changes first."""
    if not edited:
        return True
    return timestamp is not None and _earliest(timestamp) >= as_of - timedelta(days=fixed.PRECHECK_WINDOW_DAYS)
