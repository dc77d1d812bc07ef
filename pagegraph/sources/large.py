"""JSON documents larger than a task should parse: cut at their structure by many tasks.

A document is dealt in byte ranges. Each range tells what it does to the two facts that matter, whether
a string is open and how deep brackets nest; a prefix scan over the ranges gives the true state at every
range's start. Containers larger than a range are then known by their brackets, and every range cuts
their elements out of its bytes. What is left are elements of at most about a range, one row each, that
are parsed on their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagegraph.functions.text import signed_zeros
from pagegraph.session import checkpointed

#: bytes of a range; a container of more bytes is cut into its elements
RANGE = 4 << 20
#: bytes up to which a document is read in one row; longer ones are cut
WHOLE = 16 << 20
#: rows of small frames up to which they are broadcast; copies of a row that many others join
BROADCAST_ROWS, SALTS = 100_000, 64
#: ranges that get a task each, whatever their size
SINGLE_RANGES = 200
#: rows of a list that are numbered together
BLOCK = 1 << 16
#: the container of what stands outside the document's root
OUTSIDE = -1

_QUOTE, _SLASH, _COMMA = 34, 92, 44
_OPEN, _CLOSE = b"[{", b"]}"


# --- one range of bytes ---------------------------------------------------------------------------


def quotes(raw: np.ndarray, escaped: bool) -> np.ndarray:
    """Places of the quotation marks that no backslash escapes; ``escaped``: a backslash stands before."""
    found = np.flatnonzero(raw == _QUOTE)
    others = np.flatnonzero(raw != _SLASH)
    if len(others) == len(raw) and not escaped:
        return found
    at = np.searchsorted(others, found) - 1
    last = np.where(at >= 0, others[at], -1) if len(others) else np.full(len(found), -1)
    slashes = found - last - 1 + np.where(at < 0, int(escaped), 0)
    return found[slashes % 2 == 0]


def structure(raw: np.ndarray, escaped: bool, inside: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places of brackets and commas outside strings, and what each does to the depth."""
    step = np.zeros(256, np.int8)
    wanted = np.zeros(256, bool)
    step[list(_OPEN)], step[list(_CLOSE)] = 1, -1
    wanted[[*_OPEN, *_CLOSE, _COMMA]] = True
    at = np.flatnonzero(wanted[raw])
    at = at[(np.searchsorted(quotes(raw, escaped), at) + inside) % 2 == 0]
    return at, step[raw[at]].astype(np.int64)


def effect(raw: np.ndarray) -> dict[str, int]:
    """What a range does, for each state it may start in: flips of the string state, change of depth."""
    others = np.flatnonzero(raw != _SLASH)
    out = {"size": len(raw), "trailing": len(raw) - 1 - int(others[-1]) if len(others) else len(raw)}
    for escaped in (0, 1):
        out["flips%d" % escaped] = len(quotes(raw, bool(escaped))) % 2
        for inside in (0, 1):
            out["delta%d%d" % (escaped, inside)] = int(structure(raw, bool(escaped), bool(inside))[1].sum())
    return out


def unmatched(raw: np.ndarray, escaped: bool, inside: bool, depth: int) -> list[tuple[int, int, bool, str]]:
    """Brackets of a range whose partner lies in another: place, level of the container, opens, bracket."""
    at, step = structure(raw, escaped, inside)
    at, step = at[step != 0], step[step != 0]
    if not len(at):
        return []
    level = np.cumsum(step)
    lowest = np.minimum.accumulate(np.concatenate([[0], level]))[:-1]
    later = np.minimum.accumulate(level[::-1])[::-1]
    after = np.append(later[1:], np.iinfo(np.int64).max)
    lone = np.where(step > 0, after >= level, level < lowest)
    return [
        (int(p), int(depth + d - (s > 0)), bool(s > 0), chr(raw[p])) for p, d, s in zip(at[lone], level[lone], step[lone], strict=True)
    ]


def cut(raw: np.ndarray, offset: int, escaped: bool, inside: bool, depth: int, large: list[tuple[int, int, int]]):
    """Elements of the large containers ``(open, close, level)`` as far as they lie in a range.

    Gives (container, number, text, goes on from before, goes on after) and (container, number, child):
    a child's own bytes are not part of its parent's element.
    """
    at, step = structure(raw, escaped, inside)
    after = depth + np.cumsum(step)
    commas, comma_depth = at[step == 0], after[step == 0]
    end = offset + len(raw)
    around = sorted((c for c in large if c[0] < offset <= c[1]), key=lambda c: c[2])
    stack = [(OUTSIDE, -1), *((c[0], c[2]) for c in around)]
    first = {c for c, _ in stack}
    number = {c: 0 for c in first}
    texts: dict[tuple[int, int], list[bytes]] = {(c, 0): [] for c in first}
    children = []
    held = raw.tobytes()

    def segment(start: int, stop: int) -> None:
        container, level = stack[-1]
        a, b = np.searchsorted(commas, (start, stop))
        for comma in commas[a:b][comma_depth[a:b] == level + 1].tolist():
            texts[container, number[container]].append(held[start:comma])
            start = comma + 1
            number[container] += 1
            texts[container, number[container]] = []
        texts[container, number[container]].append(held[start:stop])

    events = sorted([(c[0] - offset, 1, c) for c in large if offset <= c[0] < end] + [(c[1] - offset, 0, c) for c in large if offset <= c[1] < end])
    start = 0
    for place, opens, (container, _, level) in events:
        segment(start, place)
        start = place + 1
        if opens:
            parent = stack[-1][0]
            children.append((parent, number[parent], container))
            stack.append((container, level))
            number[container] = 0
            texts[container, 0] = []
        else:
            stack.pop()
    segment(start, len(raw))
    last = {c for c, _ in stack}
    elements = [(c, k, b"".join(t), k == 0 and c in first, k == number[c] and c in last) for (c, k), t in texts.items()]
    return elements, children


# --- whole documents ------------------------------------------------------------------------------


@dataclass
class Shredded:
    """Large documents in pieces; ``doc`` stands for the caller's keys.

    ``docs``: doc, keys. ``broken``: doc of texts that are no JSON. ``containers``: doc, container,
    close, kind (``[`` or ``{``), level, ``names`` and ``path`` from the root (names of members, ``#``
    for elements of lists; order numbers). ``ranges``: the bytes, ``size`` of them each. ``elements``: doc, container, ``at`` (order in the container),
    ``name`` (null in lists), ``text`` and ``v`` of the element, for members as an object of that one
    member; ``child`` is the container that is the element's value, its text is null then.
    """

    keys: list[str]
    docs: DataFrame
    broken: DataFrame
    containers: DataFrame
    elements: DataFrame
    ranges: DataFrame
    size: int


def _beside(large: DataFrame, small: DataFrame, rows: int, on: list[str]) -> DataFrame:
    """Join with a frame of known size: broadcast while it is small."""
    return large.join(F.broadcast(small) if rows <= BROADCAST_ROWS else small, on)


def spread_join(rows: DataFrame, few: DataFrame, on: list[str], by: str, how: str = "inner") -> DataFrame:
    """Join many rows of few keys, so that no task gets all rows of a key.

    The few rows are counted: while they are few indeed they are broadcast, and the many rows stay where
    they are; else the few are copied.
    """
    few = checkpointed(few)
    if few.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(few), on, how)
    copies = few.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALTS))).join(copies, [*on, "_salt"], how).drop("_salt")


def _ranges(payloads: DataFrame, keys: list[str], json_column: str, size: int) -> tuple[DataFrame, int]:
    """``doc, keys, part, raw``: the bytes of all documents and the number of ranges; a task gets about ``RANGE`` bytes."""
    count = F.greatest(F.ceil(F.octet_length(json_column) / size), F.lit(1)).cast("int")
    total = payloads.agg(F.coalesce(F.sum(count), F.lit(0))).first()[0]
    docs = payloads.select(F.monotonically_increasing_id().alias("doc"), F.struct(*keys).alias("keys"), F.col(json_column).cast("binary").alias("raw"))
    parts = docs.select("*", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.octet_length("raw") / size), F.lit(1)).cast("int") - 1)).alias("part"))
    rows = parts.select("doc", "keys", "part", F.substring("raw", F.col("part") * size + 1, F.lit(size)).alias("raw"))
    wide = int(payloads.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return checkpointed(rows.repartition(range_tasks(total, size, wide))), total


def range_tasks(total: int, size: int, wide: int) -> int:
    """Tasks for ``total`` ranges: one each while they are few or of full size.

    Many small ranges share tasks of ``RANGE`` bytes, since starting a task costs more than cutting such a
    range; ranges of full size share tasks only beyond what any cluster runs at once.
    """
    full = -(-total * min(size, RANGE) // RANGE)
    return max(1, min(total, max(wide, SINGLE_RANGES, min(full, 10_000))))


def _states(ranges: DataFrame) -> DataFrame:
    """``doc, part, escaped, inside, depth`` at the start of every range, and ``left`` open at its end."""
    names = ["size", "trailing", "flips0", "flips1", "delta00", "delta01", "delta10", "delta11"]
    schema = "doc long, part int, " + ", ".join(n + " long" for n in names)

    def effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [effect(np.frombuffer(cell.as_buffer(), np.uint8)) for cell in batch.column(2)]
            cols = [batch.column(0), batch.column(1), *(pa.array([f[n] for f in found], pa.int64()) for n in names)]
            yield pa.RecordBatch.from_arrays(cols, names=["doc", "part", *names])

    along = Window.partitionBy("doc").orderBy("part")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    found = ranges.select("doc", "part", "raw").mapInArrow(effects, schema)
    # a run of backslashes may fill ranges: it is counted from the last range that ends in something else
    found = found.withColumn("run", F.sum((F.col("trailing") < F.col("size")).cast("int")).over(along))
    slashes = F.sum("trailing").over(Window.partitionBy("doc", "run").orderBy("part"))
    found = found.withColumn("slashes", slashes).withColumn("escaped", F.coalesce(F.lag("slashes").over(along), F.lit(0)) % 2 == 1)
    flips = F.when(F.col("escaped"), F.col("flips1")).otherwise(F.col("flips0"))
    found = found.withColumn("flips", flips).withColumn("inside", F.coalesce(F.sum("flips").over(before), F.lit(0)) % 2 == 1)
    pick = lambda i: F.when(F.col("escaped"), F.col("delta1%d" % i)).otherwise(F.col("delta0%d" % i))
    found = found.withColumn("delta", F.when(F.col("inside"), pick(1)).otherwise(pick(0)))
    found = found.withColumn("depth", F.coalesce(F.sum("delta").over(before), F.lit(0)))
    left = (F.col("inside") != (F.col("flips") == 1)) | (F.col("depth") + F.col("delta") != 0)
    return checkpointed(found.select("doc", "part", "escaped", "inside", "depth", left.alias("left")))


def _containers(ranges: DataFrame, states: DataFrame, count: int, size: int) -> tuple[DataFrame, DataFrame]:
    """Containers that span ranges, ``doc, container, close, level, kind``, and documents whose brackets do not match."""
    schema = "doc long, place long, level long, opens boolean, bracket string"

    def lone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, part, cell, escaped, inside, depth in zip(*(batch.column(i) for i in range(6)), strict=True):
                raw = np.frombuffer(cell.as_buffer(), np.uint8)
                offset = part.as_py() * size
                rows += [(doc.as_py(), offset + p, *rest) for p, *rest in unmatched(raw, escaped.as_py(), inside.as_py(), depth.as_py())]
            cols = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string())
            names = ["doc", "place", "level", "opens", "bracket"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    known = _beside(ranges.select("doc", "part", "raw"), states.drop("left"), count, ["doc", "part"])
    found = checkpointed(known.select("doc", "part", "raw", "escaped", "inside", "depth").mapInArrow(lone, schema))
    side = Window.partitionBy("doc", "level").orderBy("place")
    ahead = F.lead(F.struct("place", "opens", "bracket")).over(side)
    behind = F.lag("opens").over(side)
    paired = found.select("*", ahead.alias("ahead"), behind.alias("behind"))
    closes = F.when(F.col("bracket") == "[", "]").otherwise("}")
    sound = F.when(F.col("opens"), ~F.col("ahead.opens") & (F.col("ahead.bracket") == closes)).otherwise(F.col("behind"))
    sound = F.coalesce(sound, F.lit(False)) & (F.col("level") >= 0)
    broken = paired.where(~sound).select("doc").distinct()
    whole = paired.where(F.col("opens") & F.col("ahead").isNotNull())
    return whole.select("doc", F.col("place").alias("container"), F.col("ahead.place").alias("close"), "level", F.col("bracket").alias("kind")), broken


def _cut_ranges(ranges: DataFrame, states: DataFrame, large: DataFrame, count: int, size: int) -> DataFrame:
    """``doc, part, container, number, text, before, after, child`` of all ranges."""
    parts = F.sequence(F.floor(F.col("container") / size).cast("int"), F.floor(F.col("close") / size).cast("int"))
    within = large.select("doc", F.explode(parts).alias("part"), F.struct("container", "close", "level").alias("c"))
    within = within.groupBy("doc", "part").agg(F.collect_list("c").alias("large"))
    known = checkpointed(states.drop("left").join(within, ["doc", "part"], "left"))
    schema = "doc long, part int, container long, number long, text binary, before boolean, after boolean, child long"
    names = [f.split()[0] for f in schema.split(", ")]
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.bool_(), pa.bool_(), pa.int64())

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, part, cell, escaped, inside, depth, held in zip(*(batch.column(i) for i in range(7)), strict=True):
                raw = np.frombuffer(cell.as_buffer(), np.uint8)
                containers = [(c["container"], c["close"], c["level"]) for c in held.as_py() or ()]
                elements, children = cut(raw, part.as_py() * size, escaped.as_py(), inside.as_py(), depth.as_py(), containers)
                rows = [(doc.as_py(), part.as_py(), *e, None) for e in elements]
                rows += [(doc.as_py(), part.as_py(), c, k, None, False, False, child) for c, k, child in children]
                cols = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    cols = ["doc", "part", "raw", "escaped", "inside", "depth", "large"]
    return _beside(ranges.select("doc", "part", "raw"), known, count, ["doc", "part"]).select(*cols).mapInArrow(pieces, schema)


def shred(payloads: DataFrame, keys: list[str], json_column: str, size: int = RANGE) -> Shredded:
    """Cut documents into their large containers' elements; see ``Shredded``.

    Any JSON text may be given, small and broken ones too. Null texts are no documents. No task holds
    more than a few ranges and the elements in them; a string longer than a range is put together again
    in one row. A document of less than a range is one element of no container (``OUTSIDE``).
    """
    given = payloads.where(F.col(json_column).isNotNull())
    ranges, count = _ranges(given, keys, json_column, size)
    states = _states(ranges)
    spanning, mismatched = _containers(ranges, states, count, size)
    large = checkpointed(spanning.where(F.col("close") - F.col("container") >= size))
    cuts = checkpointed(_cut_ranges(ranges, states, large, count, size))

    # elements that lie in several ranges: their fragments follow each other
    order = F.shiftleft(F.col("part").cast("long"), 32) + F.col("number")
    fragments = cuts.where("text is not null").withColumn("at", order)
    inner = fragments.where("not before and not after").select("doc", "container", "at", "text")
    edge = fragments.where("before or after")
    start = F.last(F.when(~F.col("before"), F.col("at")), True).over(Window.partitionBy("doc", "container").orderBy("at"))
    # what stands outside the root starts before the first range
    edge = edge.withColumn("start", F.coalesce(start, F.lit(0).cast("long")))
    starts = checkpointed(edge.select("doc", "container", "at", "start"))
    joined = edge.groupBy("doc", "container", F.col("start").alias("at")).agg(F.sort_array(F.collect_list(F.struct("part", "number", "text"))).alias("t"))
    joined = joined.select("doc", "container", "at", F.aggregate("t", F.lit(b""), lambda s, x: F.concat(s, x["text"])).alias("text"))
    children = cuts.where("child is not null").select("doc", "container", order.alias("at"), "child")
    children = children.join(starts, ["doc", "container", "at"], "left").select("doc", "container", F.coalesce("start", "at").alias("at"), "child")
    children = checkpointed(children)

    texts = inner.union(joined).select("doc", "container", "at", F.decode("text", "UTF-8").alias("text"))
    kinds = large.select("doc", "container", "kind")
    texts = spread_join(texts, kinds, ["doc", "container"], "at", "left")
    held = F.broadcast(children) if children.count() <= BROADCAST_ROWS else children
    texts = texts.join(held, ["doc", "container", "at"], "left")
    blank = ~F.col("text").rlike(r"[^ \t\r\n]")
    member = F.concat(F.lit("{"), "text", F.when(F.col("child").isNotNull(), "null").otherwise(""), F.lit("}"))
    # in brackets, since a parser may not look at what follows a value
    single = F.try_variant_get(F.try_parse_json(signed_zeros(F.concat(F.lit("["), "text", F.lit("]")))), "$[0]", "variant")
    texts = texts.withColumn("blank", blank).withColumn("json", F.when(F.col("kind") == "{", member).otherwise(F.col("text")))
    parsed = checkpointed(texts.withColumn("v", F.when(F.col("kind") == "{", F.try_parse_json(signed_zeros(F.col("json")))).otherwise(single)))

    outside, within = parsed.where(F.col("container") == OUTSIDE), parsed.where(F.col("container") != OUTSIDE)
    is_child = F.col("child").isNotNull()
    # a container may be empty; no other element may
    lone = within.groupBy("doc", "container").agg(F.count("*").alias("n"), F.count(F.when(F.col("blank") & ~is_child, 1)).alias("blanks"))
    name = F.when(F.col("kind") == "{", F.get(F.map_keys(F.col("v").try_cast("map<string,variant>")), 0))
    named = within.where("not blank or child is not null").withColumn("name", name)
    bad = F.when(F.col("kind") == "{", F.col("name").isNull()).otherwise(F.when(is_child, ~F.col("blank")).otherwise(F.col("v").isNull()))
    twice = named.where("name is not null").groupBy("doc", "container", "name").count().where("count > 1")
    root = large.where("level = 0").groupBy("doc").count()
    # outside the root is nothing but white space; without a large root the whole text is one value
    alone = outside.groupBy("doc").agg(F.count("*").alias("n"), F.max("blank").alias("blank"), F.max(F.col("v").isNotNull()).alias("whole"))
    alone = alone.join(root, "doc", "left")
    stray = F.when(F.col("count").isNull(), ~F.col("whole") | (F.col("n") > 1)).otherwise(~F.col("blank") | (F.col("n") > 1) | (F.col("count") > 1))
    broken = [
        states.groupBy("doc").agg(F.max_by("left", "part").alias("left")).where("left"),
        mismatched,
        lone.where("blanks > 0 and n > 1"),
        named.where(F.coalesce(bad, F.lit(True))),
        twice,
        alone.where(stray),
    ]
    all_broken = broken[0].select("doc")
    for more in broken[1:]:
        all_broken = all_broken.union(more.select("doc"))
    all_broken = checkpointed(all_broken.distinct())

    docs = ranges.where("part = 0").select("doc", "keys")
    members = named.select("doc", "container", "at", "name", F.when(~is_child, F.col("json")).alias("text"), F.when(~is_child, F.col("v")).alias("v"), "child")
    whole = outside.where("not blank").select("doc", "container", "at", F.lit(None).cast("string").alias("name"), F.col("json").alias("text"), "v", F.lit(None).cast("long").alias("child"))
    containers = _paths(large, members.where("child is not null"))
    return Shredded(keys, docs, all_broken, containers, members.union(whole), ranges, size)


def _paths(large: DataFrame, children: DataFrame) -> DataFrame:
    """Names and order numbers from the root to every large container, one join per level."""
    deepest = large.agg(F.max("level")).first()[0]
    links = children.select("doc", F.col("container").alias("parent"), "at", F.coalesce("name", F.lit("#")).alias("step"), F.col("child").alias("container"))
    level = large.where("level = 0").select("doc", "container", "close", "kind", "level", F.array().cast("array<string>").alias("names"), F.array().cast("array<long>").alias("path"))
    out = level
    for depth in range(1, (deepest or 0) + 1):
        above = level.select("doc", F.col("container").alias("parent"), F.col("names").alias("up"), F.col("path").alias("above"))
        own = large.where(F.col("level") == depth).select("doc", "container", "close", "kind", "level")
        level = own.join(links, ["doc", "container"]).join(above, ["doc", "parent"])
        level = level.select("doc", "container", "close", "kind", "level", F.concat("up", F.array("step")).alias("names"), F.concat("above", F.array("at")).alias("path"))
        level = checkpointed(level) if depth % 8 == 0 else level
        out = out.union(level)
    return checkpointed(out)


def numbered_rows(rows: DataFrame, on: str, order: str, name: str = "position") -> DataFrame:
    """Dense numbers from 0 within each ``on`` by ``order`` (a whole number); no task numbers more than a block."""
    blocks = rows.withColumn("_block", F.floor(F.col(order) / BLOCK))
    counts = blocks.groupBy(on, "_block").count()
    earlier = Window.partitionBy(on).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(on, "_block", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy(on, "_block").orderBy(order)) - 1
    return blocks.withColumn("_place", place).join(starts, [on, "_block"]).withColumn(name, F.col("_start") + F.col("_place")).drop("_block", "_start", "_place")


def longest(payloads: DataFrame, json_column: str) -> int:
    """Bytes of the longest document."""
    return payloads.agg(F.coalesce(F.max(F.octet_length(json_column)), F.lit(0))).first()[0]


def halves(payloads: DataFrame, json_column: str, whole: int | None) -> tuple[DataFrame, DataFrame | None]:
    """Documents to read in one row each, and those to cut; null where there are none of these.

    ``whole`` null says that the caller's documents are known to be short, so that no pass looks.
    """
    if whole is None or longest(payloads, json_column) <= whole:
        return payloads, None
    large = F.coalesce(F.octet_length(json_column) > whole, F.lit(False))
    return payloads.where(~large), payloads.where(large)


def object_docs(cut: Shredded) -> DataFrame:
    """``doc, keys`` of the documents that are JSON objects."""
    roots = cut.containers.where("level = 0 and kind = '{'").select("doc")
    # an object of less than a range is one element outside of all containers
    small = cut.elements.where((F.col("container") == OUTSIDE) & F.startswith(F.schema_of_variant("v"), F.lit("OBJECT"))).select("doc")
    return cut.docs.join(roots.union(small), "doc", "left_semi").join(cut.broken, "doc", "left_anti")


def located(cut: Shredded) -> DataFrame:
    """Elements with the ``names``, ``path`` and ``kind`` of their container."""
    return spread_join(cut.elements, cut.containers.select("doc", "container", "kind", "names", "path"), ["doc", "container"], "at")


def root_members(cut: Shredded) -> DataFrame:
    """``doc, text, v, child`` of the members of root objects; a document that was not cut is one such row."""
    shown = ["doc", "text", "v", "child"]
    roots = cut.containers.where((F.size("names") == 0) & (F.col("kind") == "{")).select("doc", "container")
    own = spread_join(cut.elements.where("name is not null"), roots, ["doc", "container"], "at").select(*shown)
    return own.union(cut.elements.where(F.col("container") == OUTSIDE).select(*shown))


def container_texts(cut: Shredded, wanted: DataFrame) -> DataFrame:
    """``doc, container, text`` of containers put together again, for single values that are large."""
    rows = wanted.join(cut.containers.select("doc", "container", "close"), ["doc", "container"])
    at = lambda c: F.floor(F.col(c) / cut.size).cast("int")
    parts = rows.select("*", F.explode(F.sequence(at("container"), at("close"))).alias("part"))
    start = F.greatest(F.col("container") - F.col("part") * cut.size, F.lit(0)).cast("int")
    end = F.least(F.col("close") - F.col("part") * cut.size, F.lit(cut.size - 1)).cast("int")
    bytes_ = parts.join(cut.ranges.select("doc", "part", "raw"), ["doc", "part"]).withColumn("raw", F.substring("raw", start + 1, end - start + 1))
    found = bytes_.groupBy("doc", "container").agg(F.sort_array(F.collect_list(F.struct("part", "raw"))).alias("t"))
    whole = F.aggregate("t", F.lit(b""), lambda s, x: F.concat(s, x["raw"]))
    return found.select("doc", "container", F.decode(whole, "UTF-8").alias("text"))


def whole_elements(cut: Shredded, lists: DataFrame) -> DataFrame:
    """``doc, container, at, text, v`` of every element of the lists, those put together that are cut themselves."""
    own = spread_join(cut.elements, lists.select("doc", "container"), ["doc", "container"], "at")
    inner = own.where("child is null").select("doc", "container", "at", "text", "v")
    outer = own.where("child is not null").select("doc", "container", "at", "child")
    texts = container_texts(cut, outer.select("doc", F.col("child").alias("container"))).withColumnRenamed("container", "child")
    outer = outer.join(texts, ["doc", "child"]).select("doc", "container", "at", "text", F.try_parse_json(signed_zeros(F.col("text"))).alias("v"))
    return inner.union(outer)


def restore_keys(rows: DataFrame, cut: Shredded, order: str, *columns: str) -> DataFrame:
    """The caller's keys beside rows of documents that are JSON."""
    known = spread_join(rows, cut.docs.join(cut.broken, "doc", "left_anti"), ["doc"], order)
    return known.select(*(F.col("keys")[k].alias(k) for k in cut.keys), *columns)
