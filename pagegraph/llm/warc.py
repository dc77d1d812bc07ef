"""WARC archives as chunked record tables: payloads travel as (record, chunk number, bytes) rows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagegraph.session import checkpointed

#: payload bytes of a chunk, and the smallest payload that others may revisit
CHUNK, REVISIT_FROM = 1 << 18, 100
#: fixed texts of the format: version line, end of a record, end of a header block
VERSION, END, BLANK = "WARC/1.1\r\n", "\r\n\r\n", b"\r\n\r\n"
#: a payload is cut inside this text, so that no record block holds the border between two records
BORDER = (END + VERSION).encode()


def chunk_rows(df: DataFrame, payload: str = "payload", size: int = CHUNK) -> DataFrame:
    """One row per chunk of a binary column: ``chunk_no`` from 0, ``chunk_count``, ``chunk``.

    Null and empty payloads are one empty chunk. Chunks have ``size`` bytes, but a chunk that would hold
    the border between two records is cut inside it.
    """
    schema = df.drop(payload).schema.add("chunk_no", "long").add("chunk_count", "long").add("chunk", "binary")
    names = schema.names

    def cuts(data: memoryview) -> list[tuple[int, int]]:
        raw, spans, start = data.obj, [], 0
        while True:
            end = min(len(raw), start + size)
            at = raw.find(BORDER, start, end)
            end = at + 6 if at >= 0 else end
            spans.append((start, end))
            if end >= len(raw):
                return spans
            start = end

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(payload)
            rest = {n: batch.column(batch.schema.get_field_index(n)) for n in batch.schema.names if n != payload}
            rows, numbers, counts, parts, held = [], [], [], [], 0

            def table(rows, numbers, counts, parts, rest=rest):
                cols = {n: c.take(pa.array(rows, pa.int64())) for n, c in rest.items()}
                cols |= {"chunk_no": pa.array(numbers, pa.int64()), "chunk_count": pa.array(counts, pa.int64()), "chunk": pa.array(parts, pa.binary())}
                return pa.RecordBatch.from_arrays([cols[n] for n in names], names=names)

            for i in range(batch.num_rows):
                view = memoryview(batch.column(at)[i].as_py() or b"")
                spans = cuts(view)
                for k, (start, end) in enumerate(spans):
                    rows.append(i)
                    numbers.append(k)
                    counts.append(len(spans))
                    parts.append(bytes(view[start:end]))
                    held += end - start
                    if held > 8 * size:
                        yield table(rows, numbers, counts, parts)
                        rows, numbers, counts, parts, held = [], [], [], [], 0
            yield table(rows, numbers, counts, parts)

    return df.mapInArrow(split, schema)


def digests(chunks: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Length and SHA-256 of payloads given as ``record_id, chunk_no, chunk`` rows.

    Gives ``record_id``, the string columns ``carry`` of its first chunk, ``payload_bytes`` and
    ``payload_digest``. Chunks are sorted by record and number (Spark spills this sort) and fed to a
    running digest one by one; that of an unfinished record is carried from batch to batch, so no
    payload is ever whole in memory.
    """
    parted = chunks.select("record_id", *carry, "chunk_no", "chunk").repartition("record_id").sortWithinPartitions("record_id", "chunk_no")
    texts = ("record_id", *carry)
    kinds = [pa.string()] * len(texts) + [pa.int64(), pa.string()]
    names = [*texts, "payload_bytes", "payload_digest"]

    def table(done):
        cols = list(zip(*done, strict=True)) if done else [()] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, length, digest = None, 0, None
        for batch in batches:
            done = []
            heads = zip(*(batch.column(i).to_pylist() for i in range(len(texts))), strict=True)
            for new, part in zip(heads, batch.column(len(texts) + 1), strict=True):
                if head is None or new[0] != head[0]:
                    if head is not None:
                        done.append((*head, length, digest.hexdigest()))
                    head, length, digest = new, 0, hashlib.sha256()
                data = part.as_buffer() or b""
                length += len(data)
                digest.update(data)
            yield table(done)
        if head is not None:
            yield table([(*head, length, digest.hexdigest())])

    return parted.mapInArrow(run, ", ".join(t + " string" for t in texts) + ", payload_bytes long, payload_digest string")


def record_kinds(records: DataFrame, least: int = REVISIT_FROM) -> DataFrame:
    """Add ``record_type`` and ``refers_to`` to rows of ``page_id, payload_bytes, payload_digest``.

    Of equal payloads of at least ``least`` bytes the row with the smallest page id is a response and
    the others revisit it; rows that share the smallest id are all responses, a null id is never the
    smallest. Equality is that of length and SHA-256. The smallest id is a partial minimum per payload.
    """
    firsts = records.where((F.col("payload_bytes") >= least) & F.col("page_id").isNotNull())
    firsts = firsts.groupBy("payload_digest", "payload_bytes").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    out = records.join(firsts, ["payload_digest", "payload_bytes"], "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    out = out.withColumn("record_type", F.when(again, "revisit").otherwise("response"))
    return out.withColumn("refers_to", F.when(again, F.col("first"))).drop("first")


def _line(name: str, value: Column) -> Column:
    """One header line; line breaks inside a value become spaces; no line for null."""
    clean = F.regexp_replace(value.cast("string"), "[\\r\\n]+", " ")
    return F.coalesce(F.concat(F.lit(name + ": "), clean, F.lit("\r\n")), F.lit(""))


def write_archive(pages: DataFrame, folder: str, ident: str = "page_id", url: str = "url", payload: str = "html", least: int = REVISIT_FROM, size: int = CHUNK) -> None:
    """Write one WARC record per row below ``folder`` (gzip files, one per task).

    The payload is the text in UTF-8, null as empty. Payloads beyond ``size`` bytes are WARC segments: a
    response record and numbered continuation records, each with a block of its own. A revisit has an
    empty block and names the response it refers to. Record ids carry the page id and a number that
    keeps rows of one id apart; null ids and urls leave their header out. Rows are written by one
    Spark job per call; a lost task is written again by the output committer.
    """
    rows = pages.select(F.col(ident).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(payload), F.lit("")).alias("text"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("text").cast("long"), "payload_digest": F.sha2(F.col("text").cast("binary"), 256)})
    kinds = record_kinds(rows.select("page_id", "payload_bytes", "payload_digest").distinct(), least)
    kinds = kinds.where("record_type = 'revisit'").select("page_id", "payload_bytes", "payload_digest", "refers_to")
    keys = [F.col("r." + c).eqNullSafe(F.col("k." + c)) for c in ("page_id", "payload_bytes", "payload_digest")]
    rows = rows.alias("r").join(kinds.alias("k"), keys, "left").select("r.*", "k.refers_to")
    rows = rows.withColumn("record_id", record_name(F.col("page_id"), F.monotonically_increasing_id()))
    held = F.when(F.col("refers_to").isNull(), F.col("text").cast("binary"))
    chunks = chunk_rows(rows.select("record_id", "page_id", "url", "payload_bytes", "payload_digest", "refers_to", held.alias("payload")), size=size)
    more, many, revisit = F.col("chunk_no") > 0, F.col("chunk_count") > 1, F.col("refers_to").isNotNull()
    kind = F.when(revisit, "revisit").when(more, "continuation").otherwise("response")
    own = F.when(more, F.concat(F.col("record_id"), F.lit(":"), F.col("chunk_no"))).otherwise(F.col("record_id"))
    head = F.concat(
        F.lit(VERSION),
        _line("WARC-Type", kind),
        _line("WARC-Record-ID", F.concat(F.lit("<"), own, F.lit(">"))),
        _line("WARC-Date", F.lit("1970-01-01T00:00:00Z")),
        _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Payload-Digest", F.when(~more, F.concat(F.lit("sha256:"), F.col("payload_digest")))),
        _line("WARC-Refers-To", F.concat(F.lit("<"), record_name(F.col("refers_to")), F.lit(">"))),
        _line("WARC-Profile", F.when(revisit, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        _line("WARC-Segment-Number", F.when(many, F.col("chunk_no") + 1)),
        _line("WARC-Segment-Origin-ID", F.when(more, F.concat(F.lit("<"), F.col("record_id"), F.lit(">")))),
        _line("WARC-Segment-Total-Length", F.when(many & (F.col("chunk_no") + 1 == F.col("chunk_count")), F.col("payload_bytes"))),
        _line("Content-Type", F.lit("text/html; charset=utf-8")),
        _line("Content-Length", F.octet_length("chunk")),
        F.lit("\r\n"),
    )
    record = F.concat(head.cast("binary"), F.col("chunk")).cast("string")
    chunks.select(record.alias("value")).write.option("lineSep", END).option("compression", "gzip").mode("overwrite").text(folder)


def record_name(page: Column, number: Column | None = None) -> Column:
    """Record id of a page, with the number of its row if given; null for a null reference."""
    if number is None:
        return F.concat(F.lit("urn:page:"), page.cast("string"))
    return F.concat(F.lit("urn:page:"), F.coalesce(page.cast("string"), F.lit("")), F.lit(":"), number.cast("string"))


HEADERS = "record_id string, record_type string, url string, digest string, refers_to string, segment long, origin string, total long, chunk binary"


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """Records of all archives below ``folder``, one row per record block.

    Files are read as text rows cut at the border between two records, so a task holds one block at a
    time. A block shorter than its Content-Length (a foreign archive with the border inside a payload,
    or a cut file) is an error.
    """
    rows = spark.read.option("lineSep", BORDER.decode()).text(folder).select(F.col("value").cast("binary").alias("value"))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value in batch.column(0):
                raw = value.as_buffer()
                start = bytes(raw[: 1 << 16])
                head = start if BLANK in start else bytes(raw)
                at = head.index(BLANK)
                lines = head[:at].decode().removeprefix(VERSION).split("\r\n")
                fields = dict(line.split(": ", 1) for line in lines)
                size = int(fields["Content-Length"])
                block = raw[at + 4 : at + 4 + size]
                if len(block) < size:
                    raise ValueError("record {} is cut short".format(fields.get("WARC-Record-ID")))
                number, total = fields.get("WARC-Segment-Number"), fields.get("WARC-Segment-Total-Length")
                out.append(
                    (
                        fields["WARC-Record-ID"].strip("<>"),
                        fields["WARC-Type"],
                        fields.get("WARC-Target-URI"),
                        fields.get("WARC-Payload-Digest", "").removeprefix("sha256:") or None,
                        fields.get("WARC-Refers-To", "").strip("<>") or None,
                        int(number) if number else None,
                        fields.get("WARC-Segment-Origin-ID", "").strip("<>") or None,
                        int(total) if total else None,
                        block.to_pybytes(),
                    )
                )
            kinds = [pa.string()] * 5 + [pa.int64(), pa.string(), pa.int64(), pa.binary()]
            cols = list(zip(*out, strict=True)) if out else [[]] * 9
            names = [c.split()[0] for c in HEADERS.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names=names)

    return rows.mapInArrow(parse, HEADERS)


def archived_payloads(blocks: DataFrame) -> DataFrame:
    """One row per archived record: ``page_id, payload_bytes, payload_digest, record_type, refers_to``.

    Lengths and digests are measured on the blocks read; a revisit takes those of the response it
    refers to. The digest of a record must be the one its header names, else this is an error.
    """
    fields = ("record_type", "digest", "refers_to")
    measures = F.octet_length("chunk").cast("long").alias("payload_bytes"), F.sha2("chunk", 256).alias("payload_digest")
    single = blocks.where("segment is null").select("record_id", *fields, *measures)
    parts = blocks.where("segment is not null").withColumns({"record_id": F.coalesce("origin", "record_id"), "chunk_no": F.col("segment") - 1})
    records = checkpointed(single.union(digests(parts, fields)))
    records = records.withColumn("page_id", F.expr("try_cast(split(record_id, ':')[2] as bigint)"))
    agrees = F.when(F.col("digest").eqNullSafe(F.col("payload_digest")), F.col("payload_digest"))
    checked = F.coalesce(agrees, F.raise_error(F.concat(F.lit("digest of "), "record_id", F.lit(" differs"))).cast("string"))
    whole = records.where("record_type <> 'revisit'")
    whole = whole.select("page_id", "payload_bytes", checked.alias("payload_digest"), "record_type")
    again = records.where("record_type = 'revisit'").select("page_id", "digest", "record_type", F.expr("cast(split(refers_to, ':')[2] as bigint)").alias("refers_to"))
    targets = whole.select(F.col("page_id").alias("to"), "payload_bytes", "payload_digest").distinct()
    again = again.join(targets, (F.col("refers_to") == F.col("to")) & (F.col("digest") == F.col("payload_digest")))
    again = again.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return whole.withColumn("refers_to", F.lit(None).cast("long")).unionByName(again)
