"""Streams with state against their batch twins; replacements that stop between any two steps."""

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from pagegraph.operators import catalog, sinks
from pagegraph.operators.triples import GRAPH_COLUMNS
from pagegraph.streaming import feed, versions

EVENT = "wiki string, rc_id long, rc_cur_id long, rc_source string, rc_namespace int, rc_timestamp string"


def events(spark, rows):
    """rows: (page, rc_id, minute); the time of an event follows from its minute."""
    data = [("w", i, page, "mw.new", 0, "20260401{:02d}{:02d}00".format(m // 60, m % 60)) for page, i, m in rows]
    stamp = F.to_timestamp("rc_timestamp", "yyyyMMddHHmmss")
    return spark.createDataFrame(data, EVENT).withColumn("event_time", stamp)


def streamed(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def run(spark, tmp_path, frame, batches, name):
    """Feed the batches one file each through a stream that is started anew for every batch."""
    source, out = tmp_path / "in", tmp_path / name
    out.mkdir(exist_ok=True)
    for batch in batches:
        batch.coalesce(1).write.mode("append").parquet(str(source))
        stream = frame(streamed(spark, source, batch.schema))
        query = stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", str(tmp_path / (name + "-cp")))
        query.trigger(availableNow=True).start(str(out)).awaitTermination(120)
    return spark.read.parquet(str(out))


# page 1 repeats and comes out of order, page 2 has two creations within the delay, page 3 comes late
# but in time, page 4 too late; page 9 moves the clock on
BATCHES = [
    [(1, 10, 100), (2, 20, 101), (2, 21, 103), (1, 10, 100)],
    [(1, 10, 100), (5, 50, 110), (3, 30, 104)],
    [(2, 20, 101), (5, 50, 110), (6, 60, 125)],
    [(4, 40, 90), (1, 10, 100), (6, 60, 125)],
    [(9, 90, 600)],
    [(9, 91, 1200)],
]


def test_first_seen_gives_every_page_once(spark, tmp_path):
    batches = [events(spark, b) for b in BATCHES]
    got = run(spark, tmp_path, lambda s: feed.first_seen(s, "10 minutes"), batches, "first").collect()
    pages = [r.rc_cur_id for r in got if r.rc_cur_id != 9]
    assert sorted(pages) == [1, 2, 3, 5, 6]
    # what arrived first, since that is given out at once
    assert {r.rc_cur_id: r.rc_id for r in got if r.rc_cur_id != 9} == {1: 10, 2: 20, 3: 30, 5: 50, 6: 60}


def test_settled_equals_the_batch_twin(spark, tmp_path):
    batches = [events(spark, b) for b in BATCHES]
    got = run(spark, tmp_path, lambda s: feed.settled(s, "10 minutes"), batches, "settled")
    in_time = events(spark, [e for b in BATCHES for e in b if e[0] != 4])
    twin = feed.newest_event(feed.creation_events(in_time))
    flat = lambda df: sorted((r.rc_cur_id, r.rc_id, r.rc_timestamp) for r in df.where("rc_cur_id <> 9").collect())
    assert flat(got) == flat(twin) and (2, 21) in [f[:2] for f in flat(got)]


def edit_batches(spark):
    data = [[("w", 10 * b + i, (b + i) % 4, "mw.edit", 0, "2026040100{:02d}00".format((7 * b + i) % 60)) for i in range(6)] for b in range(5)]
    return [spark.createDataFrame(d, EVENT) for d in data]


def edits(df):
    return sorted((r.rc_cur_id, r.rc_timestamp, r.rc_id, r.edits) for r in df.collect())


def test_running_edits_after_stops_at_any_step(spark, tmp_path, monkeypatch):
    """Every batch fails once before it is written, once before and once after it is named."""
    source, out, checkpoint = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")
    batches, seen = edit_batches(spark), None
    real = versions.commit
    for n, batch in enumerate(batches):
        batch.coalesce(1).write.mode("append").parquet(source)
        seen = batch if seen is None else seen.union(batch)
        for step in ("write", "name", "after", None):
            def commit(spark, path, change, step=step):
                names = change(versions.manifest(spark, path))["folders"]
                if step == "name" and "batch=%d" % n in names:
                    raise RuntimeError("stopped")
                done = real(spark, path, change)
                if step == "after" and "batch=%d" % n in names:
                    raise RuntimeError("stopped")
                return done

            def write(batch, batch_id, path, order, step=step):
                if step == "write":
                    raise RuntimeError("stopped")
                merge(batch, batch_id, path, order)

            merge = feed.merge_batch
            with monkeypatch.context() as patch:
                patch.setattr(versions, "commit", commit)
                patch.setattr(feed, "merge_batch", write)
                query = feed.start_running(feed.running_edits(streamed(spark, source, batch.schema)), out, checkpoint)
                if step is None:
                    query.awaitTermination(120)
                else:
                    with pytest.raises(StreamingQueryException):
                        query.awaitTermination(120)
        assert edits(feed.read_merged(spark, out, feed.KEYS)) == edits(feed.latest_edits(seen))
    feed.compact(spark, out, 4, feed.newest_rows(feed.KEYS))
    assert edits(feed.read_merged(spark, out, feed.KEYS)) == edits(feed.latest_edits(seen))


@pytest.mark.parametrize("step", ["write", "commit", "delete"])
def test_compaction_that_stops_counts_nothing_twice(spark, tmp_path, monkeypatch, step):
    out, batches = str(tmp_path / "out"), edit_batches(spark)
    for n, batch in enumerate(batches):
        feed.merge_batch(feed.latest_edits(batch), n, out, ["rc_timestamp", "rc_id"])
    whole = batches[0]
    for batch in batches[1:]:
        whole = whole.union(batch)
    expected = edits(feed.latest_edits(whole))
    with monkeypatch.context() as patch:
        def stop(*_):
            raise RuntimeError("stopped")

        patch.setattr(versions, "delete" if step == "delete" else "commit", stop)
        if step == "write":
            patch.setattr(feed, "summed_edits", lambda rows: stop())
        with pytest.raises(RuntimeError):
            feed.compact(spark, out, 3, feed.summed_edits)
    assert edits(feed.read_edits(spark, out)) == expected
    feed.compact(spark, out, 3, feed.summed_edits)
    assert edits(feed.read_edits(spark, out)) == expected
    # a batch that was merged already comes again
    feed.merge_batch(feed.latest_edits(batches[2]), 2, out, ["rc_timestamp", "rc_id"])
    versions.clean(spark, out)
    assert edits(feed.read_edits(spark, out)) == expected
    assert len(versions.manifest(spark, out)["folders"]) == 2 == spark.read.parquet(out).select("batch").distinct().count()


def test_a_half_written_manifest_is_not_read(spark, tmp_path):
    out = str(tmp_path / "out")
    feed.merge_batch(feed.latest_edits(edit_batches(spark)[0]), 0, out, ["rc_id"])
    now = versions.manifest(spark, out)
    (tmp_path / "out" / "_manifest" / str(now["number"] + 1)).write_text('{"folders": ["batch=')
    assert versions.manifest(spark, out) == now
    feed.merge_batch(feed.latest_edits(edit_batches(spark)[1]), 1, out, ["rc_id"])
    assert versions.manifest(spark, out)["folders"] == ["batch=0", "batch=1"]


@pytest.mark.parametrize("step", ["write", "name", "drop", "note"])
def test_expiry_that_stops_is_finished_by_the_next(spark, tmp_path, monkeypatch, step):
    graph, place = str(tmp_path / "graph"), str(tmp_path / "catalog")
    schema = ", ".join(c + " string" for c in GRAPH_COLUMNS)
    cells = {"o_kind": "iri", "p": "p"}
    write = lambda *ids: sinks.write_graph(spark.createDataFrame([tuple(d if c == "dataset_id" else cells.get(c, "x") for c in GRAPH_COLUMNS) for d in ids], schema), graph)
    line = lambda d, t: (d, 1, "https://x/", None, t, [])
    write("old", "new")
    lines = [line("old", "2026-03-01T00:00:00Z"), line("new", "2026-04-01T00:00:00Z")]
    for one in lines:
        catalog.append_catalog(spark.createDataFrame([one], catalog.CATALOG_SCHEMA), place)
    real, calls = versions.commit, []

    def commit(spark, path, change):
        calls.append(change(versions.manifest(spark, path)))
        if (step == "name" and calls[-1].get("dropping")) or (step == "note" and calls[-1].get("dropping") == []):
            raise RuntimeError("stopped")
        return real(spark, path, change)

    def stop(*_, **__):
        raise RuntimeError("stopped")

    with monkeypatch.context() as patch:
        patch.setattr(versions, "commit", commit)
        if step == "drop":
            patch.setattr(sinks, "drop_datasets", stop)
        if step == "write":
            patch.setattr(versions, "replace", stop)
        with pytest.raises(RuntimeError):
            sinks.drop_expired(graph, place, "2026-04-01T12:00:00Z", spark)
    left = {r.dataset_id for r in catalog.read_catalog(spark, place).collect()}
    assert "new" in left and ("old" in left) == (step in ("write", "name"))
    assert sinks.drop_expired(graph, place, "2026-04-01T12:00:00Z", spark) == ["old"]
    assert {r.dataset_id for r in catalog.read_catalog(spark, place).collect()} == {"new"}
    assert {r.dataset_id for r in sinks.read_graph(spark, graph).collect()} == {"new"}
    assert sinks.drop_expired(graph, place, "2026-04-01T12:00:00Z", spark) == []
