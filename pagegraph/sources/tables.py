"""Replica-shaped tables: one scan over many wikis instead of one connection per wiki."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values: columns read from each table ---
COLUMNS = {
    "page": ["page_id", "page_namespace", "page_title", "page_len", "page_latest"],
    "page_props": ["pp_page", "pp_propname", "pp_value"],
    "revision": ["rev_id", "rev_page", "rev_actor", "rev_timestamp"],
    "recentchanges": [
        "rc_id",
        "rc_cur_id",
        "rc_this_oldid",
        "rc_actor",
        "rc_source",
        "rc_log_type",
        "rc_namespace",
        "rc_title",
        "rc_timestamp",
    ],
    "actor": ["actor_id", "actor_user", "actor_name"],
    "user": ["user_id", "user_name"],
    "categorylinks": ["cl_from", "cl_target_id", "cl_sortkey_prefix"],
    "linktarget": ["lt_id", "lt_namespace", "lt_title"],
    "pagelinks": ["pl_from", "pl_target_id"],
    "iwlinks": ["iwl_from", "iwl_prefix", "iwl_title"],
    "redirect": ["rd_from", "rd_namespace", "rd_title"],
    "localuser": ["lu_name", "lu_wiki"],
}


#: names up to which a list of wikis is broadcast
MOST_LISTED = 10_000
#: column with the 14 digits of a row's time, for tables laid out by day
TIMES = {"recentchanges": "rc_timestamp", "revision": "rev_timestamp"}


def write_by_day(rows: DataFrame, root: str, table: str) -> None:
    """Write a table in folders of ``wiki`` and ``day``.

    Rows are dealt by ranges of wiki and time, so a day of a busy wiki is spread over tasks and the
    number of files stays near the number of tasks plus the number of folders.
    """
    time = TIMES[table]
    laid = rows.withColumn("day", F.substring(time, 1, 8)).repartitionByRange("wiki", "day", time).sortWithinPartitions("wiki", "day", time)
    laid.write.mode("overwrite").partitionBy("wiki", "day").parquet("{}/{}".format(root.rstrip("/"), table))


def read_since(spark: SparkSession, root: str, table: str, floor: str, wikis: DataFrame | None = None) -> DataFrame:
    """Rows at or after ``floor`` of the wikis in ``wikis(wiki)``, of a table laid out by wiki and day.

    Folders of earlier days are left out when the query is planned, those of other wikis when it runs:
    the list of wikis is joined, and what it holds prunes the folders before they are read.
    """
    path = "{}/{}".format(root.rstrip("/"), table)
    frame = spark.read.parquet(path).withColumn("day", F.col("day").cast("string"))
    rows = frame.where((F.col("day") >= floor[:8]) & (F.col(TIMES[table]) >= floor))
    if wikis is not None:
        listed = wikis.select("wiki").distinct()
        # only a list that is broadcast prunes in every case; a longer one is joined
        few = listed.limit(MOST_LISTED + 1).count() <= MOST_LISTED
        rows = rows.join(F.broadcast(listed) if few else listed, "wiki", "left_semi")
    return rows.select("wiki", *[c for c in COLUMNS[table] if c in rows.columns])


def read_table(spark: SparkSession, root: str, table: str, fmt: str = "parquet") -> DataFrame:
    """Table below ``root``, partitioned by ``wiki`` where it belongs to one wiki."""
    frame = spark.read.format(fmt).load("{}/{}".format(root.rstrip("/"), table))
    wanted = (["wiki"] if "wiki" in frame.columns else []) + COLUMNS[table]
    return frame.select(*[name for name in wanted if name in frame.columns])


def read_jdbc_table(
    spark: SparkSession,
    url: str,
    table: str,
    partition_column: str,
    bounds: tuple[int, int],
    partitions: int,
    **options: str,
) -> DataFrame:
    """Same table over JDBC, split into ranges of a numeric key so that executors pull in parallel."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    ranged = reader.options(
        partitionColumn=partition_column,
        lowerBound=str(bounds[0]),
        upperBound=str(bounds[1]),
        numPartitions=str(partitions),
    )
    return ranged.load().select(*COLUMNS[table])
