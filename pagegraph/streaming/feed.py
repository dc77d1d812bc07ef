"""Change events as a stream: new pages once each, and the newest edit of every page.

The transforms are the same for a stream and a batch. There are two ways to run them. With state,
Spark's state store decides: :func:`first_seen` and :func:`settled` give a page once, :func:`running_edits`
keeps one row per page. Without state every micro-batch is reduced to one row per key. Either way a
micro-batch is a folder of its own that a manifest names when it is whole, so a repeated batch changes
nothing; readers merge the folders by key, and ``compact`` bounds their number.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pagegraph.functions.text import casefold, user_name
from pagegraph.operators.changes import not_commons_file
from pagegraph.streaming import versions

KEYS = ["wiki", "rc_cur_id"]


def creation_events(
    events: DataFrame, floor: str | None = None, users: list[str] | None = None, commons: str = "commonswiki"
) -> DataFrame:
    """Creations at or after the floor, without Commons files, by the listed users if given.

    ``events`` has wiki, rc_cur_id, rc_namespace, rc_source, rc_timestamp, event_time and, for a
    user list, actor_name.
    """
    rows = events.where((F.col("rc_source") == "mw.new") & not_commons_file(F.col("wiki"), F.col("rc_namespace"), commons))
    if floor is not None:
        rows = rows.where(F.col("rc_timestamp") >= floor)
    if users is not None:
        wanted = [casefold(user_name(F.lit(name))) for name in users]
        rows = rows.where(casefold(user_name(F.col("actor_name"))).isin(*wanted))
    return rows


def with_dimensions(rows: DataFrame, page: DataFrame, items: DataFrame) -> DataFrame:
    """Join with the page and item tables (stream-static when ``rows`` is a stream)."""
    pages = page.select("wiki", F.col("page_id").alias("rc_cur_id"), "page_title", "page_namespace")
    ids = items.select("wiki", F.col("page_id").alias("rc_cur_id"), "qid_text")
    return rows.join(pages, KEYS).join(ids, KEYS)


def newest_event(rows: DataFrame) -> DataFrame:
    """Newest event per page by time, then change id."""
    rest = [c for c in rows.columns if c not in KEYS]
    newest = F.max_by(F.struct(*rest), F.struct("rc_timestamp", "rc_id")).alias("_v")
    return rows.groupBy(*KEYS).agg(newest).select(*KEYS, "_v.*")


def new_pages(events: DataFrame, page: DataFrame, items: DataFrame, **filters) -> DataFrame:
    """Created pages with their dimensions, the newest event of each.

    On a stream every event passes; its micro-batches go through :func:`newest_event` at the sink, and
    :func:`read_merged` gives one row per page.
    """
    rows = creation_events(events, **filters)
    return with_dimensions(rows if events.isStreaming else newest_event(rows), page, items)


def latest_edits(events: DataFrame) -> DataFrame:
    """Newest edit per page, with the number of edits; for a batch or one micro-batch of a stream."""
    edits = events.where(F.col("rc_source") == "mw.edit")
    return edits.groupBy(*KEYS).agg(
        F.max("rc_timestamp").alias("rc_timestamp"),
        F.max_by("rc_id", F.struct("rc_timestamp", "rc_id")).alias("rc_id"),
        F.count(F.lit(1)).alias("edits"),
    )


def first_seen(events: DataFrame, delay: str, **filters) -> DataFrame:
    """Creations of a stream, one per page, given out as they arrive.

    The state store remembers a page for ``delay`` after its event: the same event delivered again and
    another creation of the page within that time are dropped, in whatever order and micro-batch they
    come. Events older than the watermark (newest event time less ``delay``) are dropped as late.
    """
    rows = creation_events(events, **filters).withWatermark("event_time", delay)
    return rows.dropDuplicatesWithinWatermark(KEYS)


def settled(events: DataFrame, delay: str, **filters) -> DataFrame:
    """Creations of a stream, the newest event of each page, given out when no other can come.

    Events of a page that follow each other within ``delay`` are one creation. It is given out, once,
    when the watermark has passed it; until then the state holds one row for it. Events older than the
    watermark are dropped as late.
    """
    rows = creation_events(events, **filters).withWatermark("event_time", delay)
    rest = [c for c in rows.columns if c not in KEYS]
    newest = F.max_by(F.struct(*rest), F.struct("rc_timestamp", "rc_id")).alias("_v")
    return rows.groupBy(*KEYS, F.session_window("event_time", delay).alias("_session")).agg(newest).select(*KEYS, "_v.*")


def running_edits(events: DataFrame) -> DataFrame:
    """Newest edit and number of edits per page so far, as :func:`latest_edits`, for update mode.

    The state holds one row per page. A micro-batch gives the whole new rows of the pages it touched,
    not differences, so writing one twice or reading an old folder beside a new one changes nothing.
    """
    return latest_edits(events)


def start_running(stream: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Keep the table below ``path`` at what :func:`running_edits` says; read it with :func:`read_merged`."""

    def write(batch: DataFrame, batch_id: int) -> None:
        # the count only grows, so the newest row of a page is the one with the greatest
        merge_batch(batch, batch_id, path, ["edits"])

    writer = stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if once else writer).start()


def merge_batch(batch: DataFrame, batch_id: int, path: str, order: list[str]) -> None:
    """Write one batch of the keyed table below ``path``.

    Each batch owns one folder, so a retry overwrites itself; a batch that the manifest has already is
    left alone, even if :func:`compact` has merged it since. Readers take the newest row per key.
    """
    spark = batch.sparkSession
    known = versions.manifest(spark, path)
    if batch_id <= known.get("upto", -1):
        # nothing to write, but a stateful stream has to go through its rows to commit its state
        batch.write.format("noop").mode("overwrite").save()
        return
    if not known["number"]:
        versions.commit(spark, path, lambda now: now)
    folder = "batch={}".format(batch_id)
    batch.withColumn("_order", F.struct(*order)).write.mode("overwrite").parquet("{}/{}".format(path, folder))
    versions.commit(spark, path, lambda now: now | {"folders": [*(f for f in now["folders"] if f != folder), folder], "upto": batch_id})


def read_merged(spark, path: str, keys: list[str]) -> DataFrame:
    """Newest row per key over all written batches."""
    rows = versions.read(spark, path)
    rest = [c for c in rows.columns if c not in keys and c not in ("_order", "batch")]
    newest = F.max_by(F.struct(*rest), F.struct("_order", "batch")).alias("_v")
    return rows.groupBy(*keys).agg(newest).select(*keys, "_v.*")


def read_edits(spark, path: str) -> DataFrame:
    """What :func:`latest_edits` gives for all events of the written batches."""
    return versions.read(spark, path).groupBy(*KEYS).agg(
        F.max("rc_timestamp").alias("rc_timestamp"),
        F.max_by("rc_id", F.struct("rc_timestamp", "rc_id")).alias("rc_id"),
        F.sum("edits").alias("edits"),
    )


def compact(spark, path: str, upto: int, merged: Callable[[DataFrame], DataFrame]) -> None:
    """Replace the folders of batches up to ``upto`` by one, holding what ``merged`` makes of their rows.

    ``merged`` reduces rows to one per key and keeps ``_order``. The new folder is written, then the
    manifest names it instead of the old ones, then these go: a stop in between leaves no row double and
    none out, only folders that no reader looks at (``versions.clean``). The stream may go on meanwhile.
    """
    number = lambda folder: float(folder.split("=")[1])
    old = [f for f in versions.manifest(spark, path)["folders"] if number(f) < upto + 1]
    if not old:
        return
    again = 1 + max((int(f.split(".")[1]) for f in old if f.startswith("batch={}.".format(upto))), default=0)
    folder = "batch={}.{}".format(upto, again)
    rows = merged(versions.read(spark, path, folders=old)).drop("batch")
    rows.write.mode("overwrite").parquet("{}/{}".format(path, folder))
    versions.commit(spark, path, lambda now: now | {"folders": [folder, *(f for f in now["folders"] if f not in old)]})
    for name in old:
        versions.delete(spark, path, name)


def newest_rows(keys: list[str]) -> Callable[[DataFrame], DataFrame]:
    """Merge of :func:`compact` for keyed tables: the newest row per key."""

    def merged(rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in keys]
        newest = F.max_by(F.struct(*rest), F.struct("_order", "batch")).alias("_v")
        return rows.groupBy(*keys).agg(newest).select(*keys, "_v.*")

    return merged


def summed_edits(rows: DataFrame) -> DataFrame:
    """Merge of :func:`compact` for edit counts."""
    return rows.groupBy(*KEYS).agg(
        F.max("rc_timestamp").alias("rc_timestamp"),
        F.max_by("rc_id", F.struct("rc_timestamp", "rc_id")).alias("rc_id"),
        F.sum("edits").alias("edits"),
        F.max("_order").alias("_order"),
    )


def start_merge(
    stream: DataFrame, path: str, checkpoint: str, order: list[str], reduce: Callable[[DataFrame], DataFrame], once: bool = True
) -> StreamingQuery:
    """Start the stream into the keyed table; ``once`` handles what is there and stops.

    ``reduce`` makes one row per key of a micro-batch (:func:`newest_event`, :func:`latest_edits`).
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        merge_batch(reduce(batch), batch_id, path, order)

    writer = stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if once else writer).start()
