"""Repeated word passages: windows travel as packed super-k-mers to the bucket of their minimiser."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagegraph.llm.common import WordKeys, gram_keys, in_small_batches, mixed, order_id, text_key, words_of

#: words of a minimiser
MINIMISER = 3
#: text packed together by a task, and text that a bucket gets on average
BATCH_BYTES, BUCKET_BYTES = 4 << 20, 8 << 20
#: windows of a minimiser above which they are dealt one by one, and windows a bucket of such ones gets on average
HEAVY = 100_000
#: minimisers a counting task holds before it passes them on
HELD_MINIMISERS = 1_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15)

_PACKED = (
    "bucket long, runs binary, text binary, "
    "done_ids array<long>, done_keys array<long>, done_from array<long>, done_to array<long>"
)
SPANS = "id long, text_key long, span_from long, span_to long"


def sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values."""
    out, have = x, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def super_kmers(keys: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows of ``width`` words that share a minimiser: first window, windows, minimiser."""
    grams = gram_keys(keys, min(MINIMISER, width))
    least = sliding_minimum(grams, width - min(MINIMISER, width) + 1)
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    return first, np.diff(np.append(first, len(least))), least[first]


def window_keys(data: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> np.ndarray:
    """Key of every byte range: a sum of bytes times powers of an odd base, modulo 2**64."""
    n = len(data)
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    down = np.cumprod(np.full(n, inverse))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * down)])
    return (sums[highs] - sums[lows]) * np.cumprod(np.full(n, _BASE))[lows]


def _run_counts(docs: list, width: int, words: WordKeys) -> tuple[np.ndarray, np.ndarray]:
    """Windows per minimiser of one batch of texts; runs that are equal by a hash count once."""
    names, least, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for own in docs:
        if len(own) >= width:
            keys = words.of(own)
            first, n, mark = super_kmers(keys, width)
            windows = gram_keys(keys, width)
            names.append(mixed(windows[first]) + windows[first + n - 1] + n.astype(np.uint64))
            least.append(mark)
            counts.append(n)
    _, once = np.unique(np.concatenate(names), return_index=True)
    return _totals(np.concatenate(least)[once], np.concatenate(counts)[once])


def _totals(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    names, at = np.unique(keys, return_inverse=True)
    return names, np.bincount(at, counts, len(names)).astype(np.int64)


def heavy_minimisers(texts: DataFrame, width: int) -> tuple[np.ndarray, int]:
    """Minimisers of more than ``HEAVY`` windows, sorted, and the buckets that their windows need.

    There is at most one per ``HEAVY`` windows of the input.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, held, size = WordKeys(), [], 0
        keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

        def add():
            new, n = _run_counts(held, width, words)
            return _totals(np.concatenate([keys, new]), np.concatenate([counts, n]))

        def row():
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], ["minimiser", "n"])

        for batch in batches:
            for text in batch.column(0):
                raw = text.as_py()
                held.append(words_of(raw))
                size += len(raw)
                if size >= BATCH_BYTES:
                    keys, counts = add()
                    held, size = [], 0
            if len(keys) > HELD_MINIMISERS:
                yield row()
                keys, counts = keys[:0], counts[:0]
        if held:
            keys, counts = add()
        yield row()

    found = texts.mapInArrow(count, "minimiser long, n long").groupBy("minimiser").agg(F.sum("n").alias("n")).where(F.col("n") > HEAVY).toArrow()
    total = int(found["n"].to_numpy().sum()) if found.num_rows else 0
    return np.sort(found["minimiser"].to_numpy().astype(np.int64).view(np.uint64)), -(-total // HEAVY)


def _pack(docs: list, width: int, buckets: int, words: WordKeys, heavy: np.ndarray | None = None, more: int = 1) -> Iterator[dict]:
    """Packed rows per bucket of one batch of (id, text key, words), ids rising.

    Windows of a ``heavy`` minimiser go one by one to ``more`` further buckets, by minimiser and window.

    Of equal super-k-mers of a batch only the first travels; the words of later ones are known to be
    repeats and leave as finished spans.
    """
    parts: dict[int, list] = {}
    first: dict[bytes, tuple[int, int]] = {}
    done: list[tuple[int, int, int, int]] = []
    for ident, key, own in docs:
        if len(own) < width:
            continue
        ends = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) + 1)
        text = b" ".join(own)
        keys = words.of(own)
        starts, counts, least = super_kmers(keys, width)
        homes = (least % np.uint64(buckets)).astype(np.int64)
        if heavy is not None and (split := np.isin(least, heavy)).any():
            each = np.where(split, counts, 1)
            shift = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
            starts, least, homes, split = (np.repeat(x, each) for x in (starts, least, homes, split))
            starts, counts = starts + shift, np.where(split, 1, np.repeat(counts, each))
            homes[split] = buckets + (mixed(least[split] + gram_keys(keys, width)[starts[split]]) % np.uint64(more)).astype(np.int64)
        low = np.where(starts > 0, ends[starts - 1], 0)
        high = ends[starts + counts + width - 2] - 1
        for s, n, a, b, home in zip(starts.tolist(), counts.tolist(), low.tolist(), high.tolist(), homes.tolist(), strict=True):
            piece = text[a:b]
            known = first.setdefault(piece, (ident, s))
            if known is not None and known != (ident, s):
                done.append((ident, key, s, s + n + width - 1))
                continue
            parts.setdefault(home, []).append((ident, key, s, n, piece))
    squeeze = zstandard.ZstdCompressor(level=3)
    if done and not parts:
        parts[0] = []
    for home, runs in parts.items():
        cols = list(zip(*runs, strict=True)) or [()] * 5
        late = list(zip(*done, strict=True)) or [()] * 4
        done = []
        yield {
            "bucket": home, "runs": squeeze.compress(np.array(cols[:4], np.int64).tobytes()), "text": squeeze.compress(b" ".join(cols[4])),
            "done_ids": late[0], "done_keys": late[1], "done_from": late[2], "done_to": late[3],
        }


def _arrow(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in schema.split(", ")])


def _merged(ids, keys, starts, ends) -> pa.Table:
    """Spans of a document that touch or overlap become one."""
    order = np.lexsort((starts, keys, ids))
    ids, keys, starts, ends = ids[order], keys[order], starts[order], ends[order]
    new = np.ones(len(ids), bool)
    if len(ids) > 1:
        same = (ids[1:] == ids[:-1]) & (keys[1:] == keys[:-1])
        new[1:] = ~same | (starts[1:] > ends[:-1])
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(ids)) - 1
    cols = [ids[at], keys[at], starts[at], ends[last] if len(at) else ends]
    return pa.table([pa.array(c, pa.int64()) for c in cols], schema=_arrow(SPANS))


def _repeats(table: pa.Table, width: int) -> pa.Table:
    """Spans of a bucket's windows that also start earlier, and the batches' finished spans.

    Windows are sorted by key; in a run of equal keys the smallest (id, start) stays. Each window of
    such a run is compared as text with the one that stays; should texts differ under one key, the run is
    counted by its texts.
    """
    unpack = zstandard.ZstdDecompressor()
    texts, parts = [], []
    for k in range(table.num_rows):
        runs = np.frombuffer(unpack.decompress(table["runs"][k].as_py()), np.int64).reshape(4, -1)
        ids, hashes, starts, counts = runs
        texts.append(unpack.decompress(table["text"][k].as_py()))
        if not runs.shape[1]:
            continue
        data = np.frombuffer(texts[-1], np.uint8)
        gaps = np.flatnonzero(data == 32)
        low, high = np.append(0, gaps + 1), np.append(gaps, len(data))
        shift = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        at = np.repeat(np.cumsum(counts + width - 1) - (counts + width - 1), counts) + shift
        lows, highs = low[at], high[at + width - 1]
        keys = window_keys(data, lows, highs)
        parts.append((keys, np.repeat(ids, counts), np.repeat(hashes, counts), np.repeat(starts, counts) + shift, lows, highs, np.full(len(at), k)))
    done = [np.concatenate([np.zeros(0, np.int64), *(np.asarray(v.values) for v in table[c] if len(v.values))]) for c in ("done_ids", "done_keys", "done_from", "done_to")]
    if not parts:
        return _merged(*done)
    keys, ids, hashes, starts, lows, highs, owner = map(np.concatenate, zip(*parts, strict=True))
    order = np.argsort(keys)
    same = keys[order[1:]] == keys[order[:-1]]
    many = order[np.concatenate([[False], same]) | np.concatenate([same, [False]])]
    many = many[np.lexsort((starts[many], ids[many], keys[many]))]
    first = np.concatenate([[True], keys[many[1:]] != keys[many[:-1]]]) if len(many) else np.zeros(0, bool)
    head = many[np.maximum.accumulate(np.where(first, np.arange(len(many)), 0))] if len(many) else many
    gone = (ids[many] != ids[head]) | (starts[many] != starts[head])

    def pieces(at):
        return [texts[k][a:b] for k, a, b in zip(owner[at].tolist(), lows[at].tolist(), highs[at].tolist(), strict=True)]

    check = np.flatnonzero(~first)
    for start in range(0, len(check), 100_000):
        some = check[start : start + 100_000]
        differ = [n for n, x, y in zip(some.tolist(), pieces(many[some]), pieces(head[some]), strict=True) if x != y]
        for n in {int(np.searchsorted(np.flatnonzero(first), n, side="right")) for n in differ}:
            begin, end = np.append(np.flatnonzero(first), len(many))[n - 1 : n + 1]
            seen: dict[bytes, tuple[int, int]] = {}
            for m, piece in zip(range(begin, end), pieces(many[begin:end]), strict=True):
                spot = (int(ids[many[m]]), int(starts[many[m]]))
                gone[m] = seen.setdefault(piece, spot) != spot
    many = many[gone]
    late = [ids[many], hashes[many], starts[many], starts[many] + width]
    return _merged(*(np.concatenate(pair) for pair in zip(done, late, strict=True)))


def repeated_spans(docs: DataFrame, ident: str = "doc_id", text: str = "text", width: int = 20) -> DataFrame:
    """Word spans covered by windows of ``width`` words that also start earlier: ``id, text_key, span_from, span_to``.

    Earlier is a smaller id, or the same id and an earlier word; null ids come last. Rows that share an
    id are one document in this order, so rows repeated whole keep their words. Texts that are null or
    shorter than a window have no spans; an empty frame gives none.

    A task cuts its documents into super-k-mers and sends each, packed with others, to the bucket of its
    minimiser; equal windows share it, so they meet there. The number of buckets follows the bytes of
    text. Minimisers of many windows, counted beforehand, are dealt by minimiser and window instead: equal
    windows still meet.
    """
    rows = docs.select(order_id(F.col(ident)).alias("id"), text_key(F.col(text)).alias("text_key"), F.col(text).alias("text")).where("text is not null")
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    buckets = max(1, -(-3 * size // BUCKET_BYTES))
    packed = _arrow(_PACKED)
    heavy, more = heavy_minimisers(in_small_batches(rows).select("text"), width)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, held, size = WordKeys(), [], 0

        def flush():
            held.sort(key=lambda d: (d[0], d[1]))
            out = []
            for row in _pack(held, width, buckets, words, heavy, more):
                out.append(row)
                if len(out) == 64:
                    yield pa.RecordBatch.from_pylist(out, schema=packed)
                    out = []
            yield pa.RecordBatch.from_pylist(out, schema=packed)

        for batch in batches:
            for ident, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                raw = text.as_py()
                held.append((ident, key, words_of(raw)))
                size += len(raw)
                if size >= BATCH_BYTES:
                    yield from flush()
                    held, size = [], 0
        yield from flush()

    def meet(table: pa.Table) -> pa.Table:
        return _repeats(table, width)

    return in_small_batches(rows).mapInArrow(send, _PACKED).groupBy("bucket").applyInArrow(meet, SPANS)


def remove_repeats(docs: DataFrame, ident: str = "doc_id", text: str = "text", width: int = 20) -> DataFrame:
    """Input rows with ``n_words``, ``n_removed`` and ``kept`` (the words that stay, joined by one space).

    Columns of these names are replaced. Every input row comes back; null texts have no words.
    """
    spans = repeated_spans(docs, ident, text, width).groupBy("id", "text_key").agg(F.collect_list(F.struct("span_from", "span_to")).alias("_spans"))
    spans = spans.withColumnsRenamed({"id": "_id", "text_key": "_text_key"})
    rows = docs.drop("n_words", "n_removed", "kept")
    keyed = rows.withColumns({"_own_id": order_id(F.col(ident)), "_own_key": text_key(F.col(text))})
    joined = keyed.join(spans, (F.col("_own_id") == F.col("_id")) & (F.col("_own_key") == F.col("_text_key")), "left")
    out = rows.schema.add("n_words", "long").add("n_removed", "long").add("kept", "string")
    names = out.names

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, removed, kept = [], [], []
            spots = batch.column(batch.schema.get_field_index("_spans"))
            for raw, cells in zip(batch.column(batch.schema.get_field_index(text)), spots, strict=True):
                own = words_of(raw.as_py())
                n = len(own)
                counts.append(n)
                if cells.is_valid:
                    stay = np.ones(n, bool)
                    for span in cells.as_py():
                        stay[span["span_from"] : span["span_to"]] = False
                    own = [own[i] for i in np.flatnonzero(stay).tolist()]
                removed.append(n - len(own))
                kept.append(b" ".join(own))
            cols = {n: batch.column(batch.schema.get_field_index(n)) for n in names if n in batch.schema.names}
            cols |= {"n_words": pa.array(counts, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept": pa.array(kept, pa.binary()).cast(pa.string())}
            yield pa.RecordBatch.from_arrays([cols[n] for n in names], names=names)

    return joined.mapInArrow(cut, out)
