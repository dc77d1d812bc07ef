"""Toxicity from the nearest labelled examples: exact TF-IDF cosine over an inverted index searched by block maxima."""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagegraph.llm.common import in_small_batches, mixed
from pagegraph.session import checkpointed

#: labelled rows of a class the index holds at most, examples of a block, blocks searched first, neighbours
EXAMPLES, BLOCK, VISIT, NEAREST = 4096, 64, 16, 16
#: a term that more than one of this many examples hold is written out in full; texts searched together
FREQUENT, TOGETHER = 16, 64
#: postings added up at once, characters of a text read at once
POSTINGS, PIECE = 1 << 17, 1 << 16
#: what a term weighs at least when terms are weighed by how they go with the label
FLOOR = 1e-4
_WORD = re.compile(r"\w+")
_GAP = re.compile(r"\W")
_BASE = 0x9E3779B97F4A7C15
#: how far a product of the frequent terms' lists in single precision can be off
_ROUNDING = 5e-5


@cache
def _word_characters() -> np.ndarray:
    """For every code point whether it may stand in a word."""
    held = np.zeros(0x110000, bool)
    for found in _WORD.finditer("".join(map(chr, range(len(held))))):
        held[found.start() : found.end()] = True
    return held


@cache
def _powers(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2**64."""
    steps = np.full((2, count), [[_BASE], [pow(_BASE, -1, 1 << 64)]], np.uint64)
    steps[:, 0] = 1
    return tuple(np.multiply.accumulate(steps, axis=1))


def _pieces(text: str) -> Iterator[str]:
    """A text cut after ``PIECE`` characters or more, where no word stands."""
    start = 0
    while start < len(text):
        gap = _GAP.search(text, start + PIECE)
        stop = gap.start() if gap else len(text)
        yield text[start:stop]
        start = stop


def keys_in(text: str | None) -> np.ndarray:
    """64-bit keys of all words (``\\w+``) of the lower-case text, in their order.

    A key is a polynomial of the word's code points, from sums that run over the text, well mixed.
    """
    keys = [np.zeros(0, np.uint64)]
    for piece in _pieces((text or "").lower()):
        points = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32)
        inside = np.zeros(len(points) + 2, bool)
        inside[1:-1] = _word_characters()[points]
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        powers, inverse = _powers(1 << (max(len(points), PIECE) - 1).bit_length())
        sums = np.zeros(len(points) + 1, np.uint64)
        np.cumsum((points + np.uint64(1)) * powers[: len(points)], out=sums[1:])
        start, stop = edges[::2], edges[1::2]
        keys.append(mixed((sums[stop] - sums[start]) * inverse[start]))
    return np.concatenate(keys)


def terms_of(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys of the words of a text, and how often each occurs."""
    keys = np.sort(keys_in(text))
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(np.append(first, len(keys)))


def trained(ident: Column, folds: int = 5) -> Column:
    """True for rows labels may be learned from."""
    return F.crc32(F.coalesce(ident.cast("string"), F.lit("")).cast("binary")) % folds != 0


class BlockMaxIndex:
    """Posting lists over all terms of the examples, which stand in blocks.

    ``terms``: sorted term keys; ``factor``: what a term weighs besides its count. The postings of a rare
    term are ``start[t]`` to ``start[t + 1]`` of ``place`` and ``weight``. The list of a term that many
    examples hold is written out, as column ``column[t]`` of ``full`` (a row per example).
    """

    def __init__(self, model: dict):
        self.terms, self.labels, self.count = model["terms"], model["labels"].astype(float), len(model["labels"])
        self.blocks, self.visited = max(1, -(-self.count // BLOCK)), 0
        self.weights = np.where(self.labels == 1, *model["stands_for"])
        place, tf = (_unpacked(model[n]).astype(np.int64) for n in ("place", "tf"))
        held = _unpacked(model["held"]).astype(np.int64)
        term = np.repeat(np.arange(len(self.terms)), held)
        self.factor = np.log((1 + model["documents"]) / (1 + _unpacked(model["held_by"]).astype(float))) + 1
        self.other = float(np.log(1 + model["documents"]) + 1)
        if model["by_label"]:
            ones = int(self.labels.sum())
            a = np.bincount(term, self.labels[place], len(self.terms)) if len(term) else np.zeros(len(self.terms))
            self.factor *= np.maximum(FLOOR, agreement(a, held - a, ones, self.count - ones))
            self.other *= FLOOR
        weight = (1 + np.log(tf)) * self.factor[term]
        length = np.sqrt(np.bincount(place, weight**2, self.count))
        weight = weight / length[place]
        often = np.flatnonzero(held * FREQUENT > self.count)
        self.column = np.full(len(self.terms), -1, np.int32)
        self.column[often] = np.arange(len(often))
        rare = self.column[term] < 0
        self.full = np.zeros((self.count, len(often)))
        self.full[place[~rare], self.column[term[~rare]]] = weight[~rare]
        self.rough = np.zeros((len(often), self.blocks * BLOCK), np.float32)
        self.rough[:, : self.count] = self.full.T
        term, place, weight = term[rare], place[rare], weight[rare]
        self.start = np.searchsorted(term, np.arange(len(self.terms) + 1))
        self.place, self.weight = place.astype(np.int32), weight

    def vector(self, keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Terms of the index among the keys, and their weights in the text's unit vector.

        Words that no example holds have the factor of a term of no document; they add to the length alone.
        """
        at = np.searchsorted(self.terms, keys)
        known = at < len(self.terms)
        known[known] = self.terms[at[known]] == keys[known]
        terms, weights = at[known], 1 + np.log(counts)
        own = weights[known] * self.factor[terms]
        length = np.sqrt((own**2).sum() + ((weights[~known] * self.other) ** 2).sum())
        return terms, own / length if len(terms) else own

    def nearest(self, vectors: list[tuple[np.ndarray, np.ndarray]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each text the k most similar examples, equal ones by place, and their cosines.

        Examples without a common term are never among them. The frequent terms' part of all cosines is
        one product for the texts together, in single precision; to it the postings of the rare terms are
        added. The ``VISIT`` blocks of greatest maximum are searched first, then those whose maximum is
        not below the k-th cosine found. What may be among the k is worked out once more in double
        precision. Texts are taken together up to ``POSTINGS`` postings, which bounds memory; one text
        may have more.
        """
        text = np.repeat(np.arange(len(vectors)), [len(terms) for terms, _ in vectors])
        terms, weights = (np.concatenate([v[i] for v in vectors]) for i in (0, 1))
        column = self.column[terms]
        often = column >= 0
        frequent = np.zeros((len(vectors), self.full.shape[1]))
        frequent[text[often], column[often]] = weights[often]
        score = frequent.astype(np.float32) @ self.rough
        text, terms, weights = text[~often], terms[~often], weights[~often]
        ends = np.searchsorted(text, np.arange(len(vectors) + 1))
        sums = np.append(0, np.cumsum(self.start[terms + 1] - self.start[terms]))[ends]
        out, start = [], 0
        while start < len(vectors):
            stop = max(start + 1, int(np.searchsorted(sums, sums[start] + POSTINGS, "right")) - 1)
            some = slice(ends[start], ends[stop])
            out += self._best(score[start:stop], frequent[start:stop], text[some] - start, terms[some], weights[some], k)
            start = stop
        return out

    def _best(self, score: np.ndarray, frequent: np.ndarray, text: np.ndarray, terms: np.ndarray, weights: np.ndarray, k: int) -> list:
        """``nearest`` of some texts: cosines over frequent terms, their weights, and the rare terms of text ``text[i]``."""
        shape = len(score), self.blocks, BLOCK
        begin = self.start[terms]
        length = self.start[terms + 1] - begin
        ends = np.cumsum(length)
        post = np.arange(int(length.sum())) + np.repeat(begin - (ends - length), length)
        spot = self.place[post] + np.repeat(text * score.shape[1], length)
        rare = np.bincount(spot, self.weight[post] * np.repeat(weights, length), score.size).reshape(score.shape)
        score = score + rare
        cells = score.reshape(shape)
        most = cells.max(axis=2)
        seen, least = most > 0, np.zeros(len(score))
        if self.blocks > VISIT:
            first = np.argpartition(-most, VISIT, axis=1)[:, :VISIT]
            if VISIT * BLOCK >= k:
                some = np.take_along_axis(cells, first[:, :, None], axis=1).reshape(len(score), -1)
                least = np.partition(some, some.shape[1] - k, axis=1)[:, some.shape[1] - k]
            # the k-th cosine of all is not below that of the blocks searched first
            seen &= most >= least[:, None] - 2 * _ROUNDING
        self.visited += int(seen.sum())
        row, block = np.nonzero(seen)
        held, inside = np.nonzero((cells[row, block] > 0) & (cells[row, block] >= least[row, None] - 2 * _ROUNDING))
        row, place = row[held], block[held] * BLOCK + inside
        cuts = np.searchsorted(row, np.arange(len(score) + 1))
        out = []
        for i in range(len(score)):
            found = place[cuts[i] : cuts[i + 1]]
            if len(found) > k:
                cut = score[i, found]
                found = found[cut >= np.partition(cut, len(cut) - k)[len(cut) - k] - 2 * _ROUNDING]
            exact = rare[i, found] + self.full[found] @ frequent[i]
            order = np.lexsort((found, -exact))[:k]
            out.append((found[order], exact[order]))
        return out

    def vote(self, place: np.ndarray, cosine: np.ndarray) -> float:
        """Share of label 1 among neighbours, by closeness and by how many labelled rows each stands for."""
        weight = self.weights[place] / (1.05 - np.minimum(cosine, 1.0))
        return float((weight * self.labels[place]).sum() / weight.sum())


def agreement(a: np.ndarray, b: np.ndarray, ones: int, zeros: int) -> np.ndarray:
    """How a term goes with the label: size of their correlation over the examples, 0 to 1.

    ``a`` of the ``ones`` examples of label 1 and ``b`` of the ``zeros`` of label 0 hold the term.
    """
    c, d = ones - a, zeros - b
    bottom = (a + b) * (c + d) * float(ones) * float(zeros)
    return np.where(bottom > 0, np.abs(a * d - b * c) / np.sqrt(np.maximum(bottom, 1)), 0.0)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, turns: int = 50) -> tuple[float, float]:
    """Slope (not negative) and offset of a weighted logistic curve, by damped Newton steps."""
    points, theta = np.stack([x, np.ones_like(x)], axis=1), np.zeros(2)
    for _ in range(turns):
        p = 1 / (1 + np.exp(-np.clip(points @ theta, -30, 30)))
        gradient = points.T @ (weight * (y - p)) - 1e-3 * theta
        curve = (points * (weight * p * (1 - p))[:, None]).T @ points + 1e-3 * np.eye(2)
        step = np.linalg.solve(curve, gradient)
        theta = theta + step * min(1.0, 4 / max(np.abs(step).max(), 1e-12))
    return max(0.0, float(theta[0])), float(theta[1])


def fit(
    docs: DataFrame,
    labels: DataFrame,
    ident: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    examples: int = EXAMPLES,
    by_label: bool = True,
) -> dict:
    """Index (broadcast, compressed) and calibration.

    Examples are at most ``examples`` training rows of each label, by a hash of the id: that bounds the
    index. An id that stands on two rows of ``docs`` gives two examples, one on several rows of
    ``labels`` has label 1 if one of them says so. Every word of every example is a term. Its factor is
    log((1 + documents) / (1 + documents that hold it)) + 1, over all documents, and with ``by_label``
    also its correlation with the label among the examples, ``FLOOR`` at least: no term is left out. An
    example stands for as many labelled rows as the sample takes for one, so votes keep the labels'
    share. The curve from votes to scores is fitted on the examples, each judged by the others.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(ident).isNotNull() & trained(F.col(ident)))
    known = known.groupBy(F.col(ident).cast("long").alias("_id")).agg(F.max(label).cast("int").alias("_label"))
    sizes = {r[0]: r[1] for r in known.groupBy("_label").count().collect()}
    chosen = [known.where(F.col("_label") == y).orderBy(F.xxhash64("_id"), "_id").limit(examples) for y in (0, 1)]
    picked = F.broadcast(chosen[0].union(chosen[1]))
    texts = docs.select(F.col(ident).cast("long").alias("_doc"), F.col(text).alias("_text")).join(picked, F.col("_doc") == F.col("_id"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [terms_of(cell.as_py()) for cell in batch.column(2)]
            cols = [batch.column(0), batch.column(1), *(pa.array([f[i].tobytes() for f in found], pa.binary()) for i in (0, 1))]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "label", "keys", "counts"])

    counted = in_small_batches(texts.select("_doc", "_label", "_text")).mapInArrow(count, "id long, label int, keys binary, counts binary")
    counted = checkpointed(counted)
    terms = _terms(counted)
    rows = PackedRows(_numbered(counted, terms), terms)
    total, held_by = document_counts(docs, text, terms)
    return _calibrated(counted, _indexed(rows, terms, held_by, total, sizes, by_label))


def _terms(counted: DataFrame) -> np.ndarray:
    """Sorted keys of all words of the examples; Spark makes them distinct."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.unique(np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(k.as_py(), np.uint64) for k in batch.column(0))]))
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64))], names=["term"])

    found = counted.select("keys").mapInArrow(own, "term long").distinct().toArrow()
    return np.sort(found["term"].to_numpy().view(np.uint64))


def _numbered(counted: DataFrame, terms: np.ndarray) -> pa.Table:
    """The examples with numbers of terms in place of keys, as compressed steps from one to the next."""
    shared = counted.sparkSession.sparkContext.broadcast(terms)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = [np.searchsorted(shared.value, np.frombuffer(k.as_py(), np.uint64)) for k in batch.column(2)]
            steps = [_squeezed(np.diff(p, prepend=0)) for p in places]
            counts = [_squeezed(np.frombuffer(n.as_py(), np.int64)) for n in batch.column(3)]
            cols = [batch.column(0), batch.column(1), pa.array(steps, pa.binary()), pa.array(counts, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "label", "steps", "counts"])

    return counted.mapInArrow(number, "id long, label int, steps binary, counts binary").toArrow()


def _squeezed(numbers: np.ndarray) -> bytes:
    return zlib.compress(numbers.astype(np.uint32).tobytes(), 1)


class PackedRows:
    """Rows (id, label, keys, counts) in a fixed order, each unpacked only when it is asked for."""

    def __init__(self, numbered: pa.Table, terms: np.ndarray):
        self.rows, self.terms = sorted(zip(*(c.to_pylist() for c in numbered.columns), strict=True)), terms

    def __len__(self) -> int:
        return len(self.rows)

    def __getitem__(self, i: int) -> tuple[int, int, np.ndarray, np.ndarray]:
        ident, label, *packed = self.rows[i]
        steps, counts = (np.frombuffer(zlib.decompress(b), np.uint32) for b in packed)
        return ident, label, self.terms[np.cumsum(steps, dtype=np.int64)], counts


def document_counts(docs: DataFrame, text: str, terms: np.ndarray) -> tuple[int, np.ndarray]:
    """Number of all documents, and how many hold each term; whole texts, summed by Spark."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def holders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = shared.value
        found = np.zeros(len(terms) + 1, np.int64)
        for batch in batches:
            found[-1] += batch.num_rows
            for cell in batch.column(0):
                keys, _ = terms_of(cell.as_py())
                at = np.searchsorted(terms, keys)
                inside = at < len(terms)
                at, keys = at[inside], keys[inside]
                found[at[terms[at] == keys]] += 1
        some = np.flatnonzero(found)
        for start in range(0, len(some), 1 << 16):
            part = some[start : start + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(found[part])], names=["term", "n"])

    found = in_small_batches(docs.select(text)).mapInArrow(holders, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(len(terms) + 1, np.int64)
    counts[found["term"].to_numpy()] = found["n"].to_numpy()
    return int(counts[-1]), counts[:-1]


def _packed(numbers: np.ndarray) -> tuple[str, bytes]:
    """Numbers in the smallest type that holds them, compressed: the model travels to every executor."""
    kind = np.min_scalar_type(int(numbers.max(initial=0)))
    return kind.str, zlib.compress(numbers.astype(kind).tobytes(), 1)


def _unpacked(packed: tuple[str, bytes]) -> np.ndarray:
    return np.frombuffer(zlib.decompress(packed[1]), packed[0])


def _indexed(
    rows: list | PackedRows, terms: np.ndarray, held_by: np.ndarray, documents: int, sizes: dict[int, int], by_label: bool
) -> dict:
    """What an index is built from: postings of (id, label, keys, counts) rows by term, like examples side by side.

    Rows are gone through one by one, so the driver holds the postings once, in small types.
    """
    ids, labels, held = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int8), np.zeros(len(terms), np.int64)
    for i, (ident, label, keys, _) in enumerate(rows):
        ids[i], labels[i] = ident, label
        held[np.searchsorted(terms, keys)] += 1
    # examples of one label that share their rarest common term stand together
    likest = np.full(len(rows), len(terms))
    for i, (_, _, keys, _) in enumerate(rows):
        if len(keys):
            own = np.searchsorted(terms, keys)
            likest[i] = own[np.argmin(np.where(held[own] > 1, held[own], len(rows) + 1))]
    order = np.lexsort((np.arange(len(rows)), likest, labels))
    # an example holds a term once: its postings go to the next free spots of their lists
    free = np.cumsum(held) - held
    place, tf = np.zeros(int(held.sum()), np.min_scalar_type(len(rows))), np.zeros(int(held.sum()), np.uint32)
    for spot, i in enumerate(order.tolist()):
        _, _, keys, counts = rows[i]
        own = np.searchsorted(terms, keys)
        place[free[own]], tf[free[own]] = spot, counts
        free[own] += 1
    seen = {y: max(1, int((labels == y).sum())) for y in (0, 1)}
    return {
        "name": uuid.uuid4().hex, "terms": terms, "documents": documents, "held_by": _packed(held_by), "held": _packed(held),
        "place": _packed(place), "tf": _packed(tf), "by_label": by_label, "labels": labels[order],
        "ids": ids[order], "stands_for": (sizes.get(1, 1) / seen[1], sizes.get(0, 1) / seen[0]),
    }


_loaded: dict[str, BlockMaxIndex] = {}


def loaded(model: dict) -> BlockMaxIndex:
    """Index of a model, kept for the next task of the worker."""
    if model["name"] not in _loaded:
        _loaded.clear()
        _loaded[model["name"]] = BlockMaxIndex(model)
    return _loaded[model["name"]]


def _calibrated(counted: DataFrame, model: dict) -> dict:
    """The model with its curve: every example is scored by the others, in Spark tasks."""
    shared = counted.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, spots = loaded(shared.value), {}
        for spot, ident in enumerate(shared.value["ids"].tolist()):
            spots.setdefault((ident, int(search.labels[spot])), []).append(spot)
        for batch in batches:
            votes = []
            rows = list(zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True))
            for at in range(0, len(rows), TOGETHER):
                some = rows[at : at + TOGETHER]
                vectors = [search.vector(np.frombuffer(k, np.uint64), np.frombuffer(n, np.int64)) for _, _, k, n in some]
                most = max(len(spots[i, y]) for i, y, _, _ in some)
                for (ident, label, _, _), (near, cosine) in zip(some, search.nearest(vectors, NEAREST + most), strict=True):
                    other = ~np.isin(near, spots[ident, label])
                    near, cosine = near[other][:NEAREST], cosine[other][:NEAREST]
                    votes.append(search.vote(near, cosine) if len(near) else None)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(votes, pa.float64())], names=["label", "vote"])

    found = counted.mapInArrow(judge, "label int, vote double").toArrow()
    labels = found["label"].to_numpy().astype(float)
    votes = found["vote"].to_numpy().astype(float) if found.num_rows else np.zeros(0)
    # sums do not depend on the order in which tasks end
    order = np.lexsort((votes, labels))
    labels, votes = labels[order], votes[order]
    weights, lone = np.where(labels == 1, *model["stands_for"]), np.isnan(votes)
    # half a row of either label is added, so that no text is certain
    own = lone if lone.any() else np.ones(len(labels), bool)
    alone = float(((weights * labels)[own].sum() + 0.5) / (weights[own].sum() + 1)) if len(labels) else 0.0
    curve = logistic(votes[~lone], labels[~lone], weights[~lone]) if (~lone).any() else (0.0, 0.0)
    return {"index": shared, "alone": alone, "curve": curve}


ADDED = "score double, predicted int, evidence array<struct<doc_id: bigint, label: int, cosine: double>>"


def score_texts(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """Add ``score`` (0 to 1), ``predicted`` (score of 0.5 or more) and ``evidence`` (the neighbours).

    Whole texts are scored, nothing else of a row is read. Texts without a word of any example, null and
    empty ones among them, get the share of label 1 among examples without neighbours (among all, where
    each has some). Without examples all scores are 0. Columns of these names are replaced; rows come
    back one for one. A text takes memory by its words: about 40 bytes for each.
    """
    shared, alone, (slope, offset) = model["index"], model["alone"], model["curve"]
    rows = docs.drop("score", "predicted", "evidence")
    schema = T.StructType([*rows.schema.fields, *T.StructType.fromDDL(ADDED).fields])
    kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("label", pa.int32()), ("cosine", pa.float64())]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, ids = loaded(shared.value), shared.value["ids"]
        for batch in batches:
            scores, places, cosines = [], [], []
            texts = batch.column(batch.schema.get_field_index(text))
            for at in range(0, len(texts), TOGETHER):
                vectors = [search.vector(*terms_of(cell.as_py())) for cell in texts[at : at + TOGETHER]]
                for near, cosine in search.nearest(vectors, NEAREST):
                    if len(near):
                        scores.append(float(1 / (1 + np.exp(-np.clip(slope * search.vote(near, cosine) + offset, -30, 30)))))
                    else:
                        scores.append(alone)
                    places.append(near)
                    cosines.append(cosine)
            near, ends = np.concatenate([np.zeros(0, np.int64), *places]), np.cumsum([0, *map(len, places)])
            told = [ids[near], search.labels[near].astype(np.int32), np.concatenate([np.zeros(0), *cosines])]
            evidence = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(map(pa.array, told), fields=list(kind.value_type)))
            predicted = pa.array([int(s >= 0.5) for s in scores], pa.int32())
            cols = [*batch.columns, pa.array(scores, pa.float64()), predicted, evidence]
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return in_small_batches(rows).mapInArrow(score, schema)
