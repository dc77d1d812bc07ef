"""Language-model scores: prediction by partial matching on bytes, and a word unigram base."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagegraph.llm.common import WordKeys, in_small_batches, words_of
from pagegraph.session import checkpointed, ensure_checkpoint_dir

#: bytes of the longest context
ORDER = 5
#: text a task counts or packs together, grams a task holds before it passes them on, pairs of a bucket
BATCH_BYTES, HELD_GRAMS, BUCKET_PAIRS = 4 << 20, 2_000_000, 1_000_000
#: text whose grams a bucket gets on average
GRAM_BYTES = 16 << 20
#: a prime that spreads grams over buckets, alike in numpy and in Spark
SPREAD = 1_000_003
#: the byte that ends a text; it is white space, so no word holds it
END = 10
#: key of the end as a token of the base
END_KEY = np.uint64(0x5BD1E9955BD1E995)


def held_out(ident: Column, folds: int = 10) -> Column:
    """True for ids whose crc32, as text, leaves no remainder; a null id counts as the empty text."""
    return F.crc32(F.coalesce(ident.cast("string"), F.lit("")).cast("binary")) % folds == 0


def streams(texts: list[list[bytes]], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of the texts (words joined by one space, then the end), each after ``order`` end bytes.

    Gives the bytes, the places of predicted bytes and the number of them per text.
    """
    data, starts, sizes = _joined(texts, order)
    return data, np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes), sizes


def _joined(texts: list[list[bytes]] | list[bytes], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of ``streams``, and start and number of the predicted ones per text; texts may be joined already."""
    joined = [words if isinstance(words, bytes) else b" ".join(words) for words in texts]
    pad, end = bytes([END]) * order, bytes([END])
    data = np.frombuffer(b"".join(pad + t + end for t in joined), np.uint8)
    sizes = np.fromiter(map(len, joined), np.int64, len(joined)) + 1
    return data, np.cumsum(sizes + order) - sizes, sizes


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _distinct(keys: np.ndarray) -> np.ndarray:
    """Keys without repeats, sorted; sorting is many times faster here than ``np.unique`` of values alone."""
    keys = np.sort(keys)
    return keys[np.concatenate([np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]])]


def values_at(grams: np.ndarray, names: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The value of every gram, from the sorted distinct ones.

    Six bytes of a gram leave two for a place: runs of 65,536 grams are sorted with their places, and the
    different ones of a run looked up in order.
    """
    out, places = np.empty(len(grams)), np.arange(1 << 16, dtype=np.uint64)
    for start in range(0, len(grams), len(places)):
        run = grams[start : start + len(places)].astype(np.uint64) << np.uint64(16)
        run |= places[: len(run)]
        run.sort()
        place = (run & np.uint64(0xFFFF)).astype(np.int64) + start
        run = (run >> np.uint64(16)).astype(np.int64)
        first = np.concatenate([[True], run[1:] != run[:-1]])
        out[place] = value[np.searchsorted(names, run[first])][np.cumsum(first) - 1]
    return out


def grams_of(texts: list[list[bytes]] | list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """The string of ``order`` + 1 bytes that ends at each predicted byte, and the number of them per text."""
    data, starts, sizes = _joined(texts, order)
    gram = np.zeros(len(data), np.int64)
    for back in range(order, -1, -1):
        gram <<= 8
        gram[order:] |= data[order - back : len(data) - back]
    # a mask of the bytes before each text takes an eighth of the memory of the places of all others
    own = np.ones(len(data), bool)
    own[(starts[:, None] - np.arange(1, order + 1)).ravel()] = False
    return gram[own], sizes


def gram_counts(docs: DataFrame, text: str = "text", order: int = ORDER) -> DataFrame:
    """How often each string of ``order`` + 1 bytes ends at a predicted byte: ``gram, n``, over all rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        held, size = [], 0

        def add(keys, counts):
            new, n = np.unique(grams_of(held, order)[0], return_counts=True)
            return _summed(np.concatenate([keys, new]), np.concatenate([counts, n]))

        for batch in batches:
            for cell in batch.column(0):
                raw = cell.as_py() or ""
                held.append(words_of(raw, lower=True))
                size += len(raw)
                if size >= BATCH_BYTES:
                    keys, counts = add(keys, counts)
                    held, size = [], 0
            if len(keys) > HELD_GRAMS:
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["gram", "n"])
                keys, counts = keys[:0], counts[:0]
        if held:
            keys, counts = add(keys, counts)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["gram", "n"])

    return docs.select(text).mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, text: str = "text", order: int = ORDER, contexts: int | None = None) -> dict:
    """Model of all rows: the bytes that followed each kept context, and how often, as plain arrays.

    For small frames only, since its rows reach the driver; ``score_texts`` does not use it. Counts cover
    every byte of every row. With ``contexts`` the contexts seen most often are kept, in all orders
    together at most so many: the least count is the smallest one that so many contexts reach. A
    context's shorter suffixes are seen at least as often, so the kept ones form a tree.
    """
    grams = checkpointed(gram_counts(docs, text, order))
    # (order, context, next byte) of every context length; one gram gives order + 1 of them
    level = F.explode(F.sequence(F.lit(0), F.lit(order)))
    low = F.col("gram").bitwiseAND(F.shiftleft(F.lit(1).cast("long"), 8) - 1)
    rows = grams.select("gram", "n", low.alias("byte"), level.alias("k"))
    mask = F.expr("shiftleft(1L, 8 * k) - 1L")
    rows = rows.select("k", F.shiftright("gram", 8).bitwiseAND(mask).alias("context"), "byte", "n")
    rows = checkpointed(rows.groupBy("k", "context", "byte").agg(F.sum("n").alias("n")))
    totals = checkpointed(rows.groupBy("k", "context").agg(F.sum("n").alias("seen")))
    few = rows
    if contexts is not None:
        # contexts per count, in steps of a 64th of a doubling: a few thousand rows whatever the input
        steps = totals.groupBy(F.floor(F.log2("seen") * 64).alias("step")).count().collect()
        reached, least = 0, None
        for step, count in sorted(((r[0], r[1]) for r in steps), reverse=True):
            if reached + count > contexts:
                break
            reached, least = reached + count, step
        kept = totals.where(F.floor(F.log2("seen") * 64) >= F.lit(least if least is not None else 1 << 30)).drop("seen")
        few = rows.join(kept, ["k", "context"])
    few = few.select(F.col("k").cast("tinyint").alias("k"), "context", F.col("byte").cast("smallint").alias("byte"), "n")
    found = few.toArrow()
    return {"order": order} | {c: found.column(c).to_numpy() for c in found.column_names}


def expanded(model: dict) -> dict:
    """The tables of a model; a task's worker builds them once and keeps them with the broadcast value."""
    if "tables" not in model:
        wide = (model[c].astype(np.int64) for c in ("k", "context", "byte", "n"))
        model["tables"] = tables(*wide, model["order"])
    return model["tables"]


def tables(k: np.ndarray, context: np.ndarray, byte: np.ndarray, n: np.ndarray, order: int = ORDER) -> dict:
    """Escape estimation (method D) with symbol exclusion, worked out for every kept context and byte.

    In a context that was followed n times by d different bytes, a byte seen c times has (2c - 1) / 2n
    and the escape d / 2n. After an escape the bytes of the longer contexts are left out of the counts
    of the shorter one; below the empty context all bytes left are equally likely.
    """
    names, node = np.unique((k << 48) | context, return_inverse=True)
    if not len(names):
        names = np.zeros(1, np.int64)
    depth, text = names >> 48, names & ((1 << 48) - 1)
    parent = np.searchsorted(names, np.where(depth > 0, ((depth - 1) << 48) | (text & ((1 << (8 * np.maximum(depth - 1, 0))) - 1)), 0))
    # a column for every byte that follows some context, and one for all others, which no context tells apart
    used = np.unique(byte)
    column = np.full(256, len(used), np.int64)
    column[used] = np.arange(len(used))
    shape, others = (len(names), len(used) + 1), 256 - len(used)
    counts = np.zeros(shape, np.int32 if n.max(initial=0) < 1 << 30 else np.int64)
    counts[node, column[byte]] = n
    child = np.full(shape, -1, np.int32)
    deep = np.flatnonzero(depth > 0)
    child[parent[deep], column[text[deep] >> (8 * (depth[deep] - 1))]] = deep
    log10 = np.zeros(shape, np.float32)
    for start in range(0, len(names), 2048):
        at = np.arange(start, min(start + 2048, len(names)))
        free = np.ones((len(at), shape[1]), bool)
        escaped = np.zeros(len(at))
        value = np.zeros((len(at), shape[1]))
        here, todo = at.copy(), np.ones(len(at), bool)
        for _ in range(order + 1):
            seen = np.where(free, counts[here], 0).astype(np.int64)
            seen[~todo] = 0
            total, kinds = seen.sum(axis=1), (seen > 0).sum(axis=1)
            some = kinds > 0
            bottom = np.where(some, 2 * total, 1)
            hit = seen > 0
            value = np.where(hit, escaped[:, None] + np.log10(np.maximum(2 * seen - 1, 1) / bottom[:, None]), value)
            free &= ~hit
            escaped = np.where(some, escaped + np.log10(np.where(some, kinds, 1) / bottom), escaped)
            todo &= depth[here] > 0
            here = np.where(todo, parent[here], here)
        left = free[:, :-1].sum(axis=1) + others
        log10[at] = np.where(free, (escaped - np.log10(np.maximum(left, 1)))[:, None], value)
    return {"order": order, "column": column, "child": child, "log10": log10}


def code_lengths(model: dict, texts: list[list[bytes]]) -> np.ndarray:
    """log10 probability of every text, its end included: each byte in the longest kept context before it."""
    model = expanded(model)
    data, places, sizes = streams(texts, model["order"])
    data = model["column"][data]
    node = np.zeros(len(places), np.int32)
    going = np.arange(len(places))
    for back in range(1, model["order"] + 1):
        step = model["child"][node[going], data[places[going] - back]]
        going, step = going[step >= 0], step[step >= 0]
        node[going] = step
    each = model["log10"][node, data[places]].astype(np.float64)
    return np.add.reduceat(each, np.cumsum(sizes) - sizes) if len(sizes) else each


def gram_values(grams: DataFrame, order: int = ORDER) -> DataFrame:
    """log10 probability of each gram's last byte after the bytes before it: ``gram, value``.

    ``grams`` has every gram asked for once, with ``n`` times it was learned, which may be 0. Estimates
    are those of ``tables``, over all contexts. A gram that was learned needs its own context only. For
    the others all suffixes are looked up, from the shortest to the longest: every byte that follows a
    context also follows its suffix, so what is left out after an escape is what followed the context
    just left, and its counts in the suffix add up per context. A key of any join or group has at most
    256 rows: the bytes after one context, or the contexts one byte longer than it.
    """

    def suffix(k):
        return F.col("pair").bitwiseAND(F.lit((1 << (8 * (k + 1))) - 1).cast("long"))

    context = F.shiftright("pair", 8)
    seen = grams.where("n > 0")
    rows = {order: seen.select(F.col("gram").alias("pair"), "n")}
    asked = {order: grams.where("n = 0").select(F.col("gram").alias("pair"))}
    for k in range(order - 1, -1, -1):
        rows[k] = checkpointed(rows[k + 1].groupBy(suffix(k).alias("pair")).agg(F.sum("n").alias("n")))
        asked[k] = checkpointed(asked[k + 1].select(suffix(k).alias("pair")).distinct())

    def nodes(k):
        # per context: times seen, kinds of bytes, and the counts that these bytes have in the suffix
        own = rows[k].select("pair", "n", F.lit(None).cast("long").alias("m"))
        if k:
            shorter = rows[k - 1].select(F.col("pair").alias("short"), F.col("n").alias("m"))
            own = rows[k].withColumn("short", suffix(k - 1)).join(shorter, "short").select("pair", "n", "m")
        return own.groupBy(context.alias("context")).agg(F.sum("n").alias("seen"), F.count("*").alias("kinds"), F.sum("m").alias("gone"))

    level = None
    for k in range(order + 1):
        now = asked[k].join(rows[k], "pair", "left").withColumn("context", context).join(nodes(k), "context", "left").drop("context")
        if k:
            lower = level.select(F.col("pair").alias("short"), *(F.col(c).alias("low_" + c) for c in ("n", "seen", "kinds", "escaped", "value")))
            now = now.withColumn("short", suffix(k - 1)).join(lower, "short").drop("short")
            bottom, left = 2 * (F.col("low_seen") - F.col("gone")), F.col("low_kinds") - F.col("kinds")
            hit = F.log10((2 * F.col("low_n") - 1) / bottom)
            on = F.when(left > 0, F.log10(left / bottom)).otherwise(0.0) + F.col("low_escaped")
            escaped, unseen = F.when(F.col("low_n").isNotNull(), hit).otherwise(on), F.col("low_value")
        else:
            escaped, unseen = -F.log10(F.greatest(256 - F.col("kinds"), F.lit(1)).cast("double")), F.lit(-math.log10(256))
        now = now.withColumn("escaped", F.when(F.col("seen").isNotNull() & F.col("n").isNull(), escaped))
        fresh = F.when(F.col("n").isNotNull(), F.log10((2 * F.col("n") - 1) / (2 * F.col("seen"))))
        fresh = fresh.otherwise(F.log10(F.col("kinds") / (2 * F.col("seen"))) + F.col("escaped"))
        level = now.withColumn("value", F.when(F.col("seen").isNull(), unseen).otherwise(fresh))
        level = level.select("pair", "n", "seen", "kinds", "escaped", "value")
    total = F.sum("n").over(Window.partitionBy(F.shiftright("gram", 8)))
    learned = seen.select("gram", F.log10((2 * F.col("n") - 1) / (2 * total)).alias("value"))
    return learned.union(level.select(F.col("pair").alias("gram"), "value"))


_BATCHES = "batch long, ids array<long>, held array<boolean>, tokens array<long>, text binary"
_WORDS = "bucket long, batch long, keys binary, pairs binary, train binary, place binary, times binary"
_BACK = "batch long, place binary, sums binary, known binary, total long, kinds long"
_GRAMS = "bucket long, batch long, keys binary"
_FOUND = "batch long, bucket long, scores binary"
SCORES = "id long, held_out boolean, n_tokens long, n_known long, known_log10 double, score double"


def _arrow(schema: str) -> pa.Schema:
    kinds = {
        "long": pa.int64(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()),
        "array<boolean>": pa.list_(pa.bool_()),
    }
    return pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in schema.split(", ")])


def _dealt(grams: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of sorted grams by bucket, and the buckets in that order."""
    home = grams % SPREAD % buckets
    order = np.argsort(home, kind="stable")
    return order, home[order]


def _squeezed(values: np.ndarray | bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(values if isinstance(values, bytes) else values.tobytes())


def _unpacked(cell: pa.Scalar, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(cell.as_py()), kind)


def _packed(docs: list, batch: int) -> dict:
    """One batch of (id, held out, words); the end byte is in no word, so it parts the texts."""
    about = {"batch": batch, "ids": [d[0] for d in docs], "held": [d[1] for d in docs], "tokens": [len(d[2]) + 1 for d in docs]}
    return about | {"text": _squeezed(bytes([END]).join(b" ".join(d[2]) for d in docs))}


def _lines(cell: pa.Scalar) -> list[bytes]:
    """A packed batch's texts, their words joined."""
    return zstandard.ZstdDecompressor().decompress(cell.as_py()).split(bytes([END]))


def _texts(cell: pa.Scalar) -> list[list[bytes]]:
    """Words of a packed batch's texts."""
    return [t.split() for t in _lines(cell)]


def _counted(text: pa.Scalar, held: list[bool]) -> tuple[np.ndarray, np.ndarray]:
    """Grams of a packed batch and how often its training texts hold them."""
    gram, sizes = grams_of(_lines(text))
    train = np.repeat(~np.array(held, bool), sizes)
    learned, n = np.unique(gram[train], return_counts=True)
    other = _distinct(gram[~train])
    return np.concatenate([learned, other]), np.concatenate([n, np.zeros(len(other), np.int64)])


def batch_counts(batches: DataFrame) -> DataFrame:
    """How often training texts hold each gram of any text: ``gram, n``."""

    def count(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in found:
            for held, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                learned, n = _counted(text, held)
                keys, counts = _summed(np.concatenate([keys, learned]), np.concatenate([counts, n]))
                if len(keys) > HELD_GRAMS:
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["gram", "n"])
                    keys, counts = keys[:0], counts[:0]
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["gram", "n"])

    return batches.select("held", "text").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _send_grams(texts: list[bytes], batch: int, buckets: int) -> Iterator[dict]:
    """Distinct grams of one batch per bucket."""
    keys = _distinct(grams_of(texts)[0])
    order, home = _dealt(keys, buckets)
    keys = keys[order]
    cuts = np.append(np.flatnonzero(np.concatenate([[True], home[1:] != home[:-1]])), len(home))
    for a, b in zip(cuts.tolist(), cuts[1:].tolist(), strict=False):
        yield {"bucket": int(home[a]), "batch": batch, "keys": _squeezed(np.diff(keys[a:b], prepend=0))}


def _look_up(asked: pa.Table, values: pa.Table) -> Iterator[dict]:
    """Values of the grams that each batch sent to a bucket, in the order sent."""
    grams, value = values["gram"].to_numpy(), values["value"].to_numpy()
    order = np.argsort(grams)
    grams, value = grams[order], value[order].astype(np.float32)
    for batch, bucket, keys in zip(asked["batch"].to_pylist(), asked["bucket"].to_pylist(), asked["keys"], strict=True):
        at = np.searchsorted(grams, np.cumsum(_unpacked(keys, np.int64)))
        yield {"batch": batch, "bucket": bucket, "scores": value[at].tobytes()}


def _send_words(texts: list[list[bytes]], held: list[bool], batch: int, buckets: int, words: WordKeys) -> Iterator[dict]:
    """Distinct words of one batch per bucket with their places and counts."""
    kinds = [np.unique(np.append(words.of(own), END_KEY), return_counts=True) for own in texts]
    keys = np.concatenate([k for k, _ in kinds])
    times = np.concatenate([n for _, n in kinds]).astype(np.uint32)
    place = np.repeat(np.arange(len(texts), dtype=np.uint16), [len(k) for k, _ in kinds])
    train = np.repeat(~np.array(held, bool), [len(k) for k, _ in kinds])
    order = np.argsort(keys, kind="stable")
    keys, times, place, train = keys[order], times[order], place[order], train[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    pairs = np.diff(np.append(first, len(keys))).astype(np.uint32)
    learned = np.add.reduceat(np.where(train, times, 0).astype(np.uint64), first)
    home = (keys[first] // np.uint64(-(-(1 << 64) // buckets))).astype(np.int64) if buckets > 1 else np.zeros(len(first), np.int64)
    cuts = np.append(np.flatnonzero(np.concatenate([[True], home[1:] != home[:-1]])), len(first))
    ends = np.append(first, len(keys))
    for a, b in zip(cuts, cuts[1:], strict=False):
        x, y = ends[a], ends[b]
        yield {
            "bucket": int(home[a]), "batch": batch, "keys": keys[first[a:b]].tobytes(), "pairs": _squeezed(pairs[a:b]),
            "train": _squeezed(learned[a:b]), "place": _squeezed(place[x:y]), "times": _squeezed(times[x:y]),
        }


def _meet(table: pa.Table) -> Iterator[dict]:
    """Counts of a bucket's words over all training rows, and each document's sum over them."""

    each = [np.frombuffer(c.as_buffer(), np.uint64) for c in table["keys"]]
    keys = np.concatenate(each)
    train = np.concatenate([_unpacked(c, np.uint64) for c in table["train"]])
    names, at = np.unique(keys, return_inverse=True)
    seen = np.bincount(at, weights=train, minlength=len(names))[at]
    count = np.zeros(len(names))
    count[at] = seen
    yield {"batch": -1, "place": b"", "sums": b"", "known": b"", "total": int(count.sum()), "kinds": int((count > 0).sum())}
    start = 0
    for k, own in enumerate(each):
        c = np.repeat(seen[start : start + len(own)], _unpacked(table["pairs"][k], np.uint32))
        start += len(own)
        place, times = _unpacked(table["place"][k], np.uint16), _unpacked(table["times"][k], np.uint32)
        here, spot = np.unique(place, return_inverse=True)
        sums = np.bincount(spot, weights=times * np.log10(c + 0.1), minlength=len(here))
        known = np.bincount(spot, weights=times * (c > 0), minlength=len(here)).astype(np.uint32)
        yield {"batch": table["batch"][k].as_py(), "place": here.tobytes(), "sums": sums.tobytes(), "known": known.tobytes()}


def _gather(table: pa.Table, buckets: int) -> Iterator[dict]:
    """Sums of a batch's documents over all buckets, and their texts' scores from the values of its grams."""

    def cells(name, kind):
        return np.concatenate([np.zeros(0, kind), *(np.frombuffer(c.as_buffer(), kind) for c in table[name] if c.is_valid)])

    about = next(k for k in range(table.num_rows) if table["ids"][k].is_valid)
    ids, held, tokens = (table[n][about].as_py() for n in ("ids", "held", "tokens"))
    place = cells("place", np.uint16)
    sums = np.bincount(place, cells("sums", np.float64), len(ids))
    known = np.bincount(place, cells("known", np.uint32), len(ids))
    gram, sizes = grams_of(_lines(table["text"][about]))
    names = _distinct(gram)
    back = sorted((table["bucket"][k].as_py(), k) for k in range(table.num_rows) if table["scores"][k].is_valid)
    value = np.zeros(len(names))
    value[_dealt(names, buckets)[0]] = np.concatenate([np.frombuffer(table["scores"][k].as_buffer(), np.float32) for _, k in back])
    scores = np.add.reduceat(values_at(gram, names, value), np.cumsum(sizes) - sizes).tolist()
    for i, h, n, k, s, score in zip(ids, held, tokens, known.tolist(), sums.tolist(), scores, strict=True):
        yield {"id": i, "held_out": h, "n_tokens": n, "n_known": int(k), "known_log10": s, "score": score}


def _tables(rows: Iterator[dict], schema: str) -> pa.Table:
    return pa.Table.from_pylist(list(rows), schema=_arrow(schema))


def score_texts(docs: DataFrame, ident: str = "doc_id", text: str = "text", folds: int = 10) -> DataFrame:
    """Scores of every row, learned from the rows that are not held out.

    ``id, held_out, n_tokens, n_known, train_tokens, base_score, score``. Words are lower-cased in A-Z;
    tokens are the words, then one end. ``base_score`` adds ``log10((c + 0.1) / (N + 0.1 * (V + 1)))``;
    ``score`` is the log10 probability of the words joined by one space, and their end, under the
    byte model of ``gram_values``, with every context of the training rows. Null and blank texts are the end alone. Repeated rows count as often as they
    stand; an empty frame gives no rows. Without training rows all bytes are equally likely.

    A task packs the distinct words of a batch per bucket; the bucket adds their counts over all batches
    and returns each batch's sums. Words are told apart by 64 bits of a hash. The distinct grams of the
    batch are packed likewise; they are counted into a table, which meets them again in buckets, and the
    values come back to the batch's texts. No model is collected or broadcast.
    """
    spark = docs.sparkSession
    held = held_out(F.col(ident), folds)
    rows = in_small_batches(docs).select(F.col(ident).cast("long").alias("id"), held.alias("held"), F.col(text).alias("text"))
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    buckets, gram_buckets = max(1, -(-size // (10 * BUCKET_PAIRS))), max(1, -(-size // GRAM_BYTES))

    def pack(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, size, batch_id = [], 0, TaskContext.get().partitionId() << 32
        for batch in found:
            for i, h, cell in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                raw = cell.as_py() or ""
                own.append((i, h, words_of(raw, lower=True)))
                size += len(raw)
                if size >= BATCH_BYTES or len(own) >= 1 << 16:
                    yield from _tables(iter([_packed(own, batch_id)]), _BATCHES).to_batches()
                    batch_id, own, size = batch_id + 1, [], 0
        if own:
            yield from _tables(iter([_packed(own, batch_id)]), _BATCHES).to_batches()

    def send_words(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordKeys()
        for batch in found:
            for i, held, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                yield from _tables(_send_words(_texts(text), held, i, buckets, words), _WORDS).to_batches(max_chunksize=256)

    def send_grams(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                yield from _tables(_send_grams(_lines(text), i, gram_buckets), _GRAMS).to_batches(max_chunksize=256)

    def meet(table: pa.Table) -> pa.Table:
        return _tables(_meet(table), _BACK)

    def look_up(asked: pa.Table, values: pa.Table) -> pa.Table:
        return _tables(_look_up(asked, values), _FOUND)

    def gather(table: pa.Table) -> pa.Table:
        return _tables(_gather(table, gram_buckets), SCORES)

    place = "{}/counts-{}".format(ensure_checkpoint_dir(spark), uuid.uuid4().hex)
    rows.mapInArrow(pack, _BATCHES).write.parquet(place + "/batches")
    batches = spark.read.parquet(place + "/batches")
    sent = batches.select("batch", "held", "text").mapInArrow(send_words, _WORDS)
    sent.groupBy("bucket").applyInArrow(meet, _BACK).write.parquet(place + "/words")
    back = spark.read.parquet(place + "/words")
    total, kinds = back.where("batch = -1").agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("kinds"), F.lit(0))).first()
    values = gram_values(checkpointed(batch_counts(batches)))
    values = values.withColumn("home", F.expr("gram % {} % {}".format(SPREAD, gram_buckets)))
    asked = batches.select("batch", "text").mapInArrow(send_grams, _GRAMS).groupBy("bucket")
    found = asked.cogroup(values.groupBy("home")).applyInArrow(look_up, _FOUND)
    parts = back.where("batch >= 0").select("batch", "place", "sums", "known")
    parts = parts.unionByName(found, allowMissingColumns=True).unionByName(batches, allowMissingColumns=True)
    sums = parts.groupBy("batch").applyInArrow(gather, SCORES)
    share = math.log10(total + 0.1 * (kinds + 1))
    base = F.col("known_log10") - F.col("n_tokens") * share
    return sums.select("id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
