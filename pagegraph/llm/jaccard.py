"""N-gram Jaccard join: sets in a global order, stored in prefix trees and joined by bounded traversal."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagegraph.llm.common import Forest, WordKeys, components, gram_keys, in_small_batches, mixed, words_of
from pagegraph.session import checkpointed, ensure_checkpoint_dir

#: words of a gram; the similarity as a fraction
GRAM, NEAR, OF = 5, 4, 5
#: copies of a class's row, over which its documents look it up
SALTS = 32
#: text a task packs together; grams a bucket gets on average; grams of one join task
BATCH_BYTES, BUCKET_GRAMS, JOIN_GRAMS = 4 << 20, 2_000_000, 1_000_000
#: grams of a tree node
PIECE = 32

_SENT = "bucket long, batch long, low binary, high binary, place binary, ids array<long>, sizes array<long>"
_BACK = "batch long, grams binary, place binary, ids array<long>, sizes array<long>"
SETS = "id long, n long, single long, grams array<long>, node long, copied boolean"


def gram_set(words: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """Distinct keys of the runs of ``gram`` words; of all words together when there are fewer."""
    return np.unique(gram_keys(words, min(gram, len(words)))) if len(words) else np.zeros(0, np.uint64)


class Similarity:
    """Jaccard of at least ``near / of``, in whole numbers."""

    def __init__(self, near: int = NEAR, of: int = OF):
        self.near, self.of = near, of

    def least_shared(self, n: int) -> int:
        """Grams a set of ``n`` must share with any partner: intersection >= near/of * union >= near/of * n."""
        return -(-self.near * n // self.of)

    def linked(self, shared, n, m):
        return (self.near + self.of) * shared >= self.near * (n + m)

    def sizes_fit(self, n, m):
        return self.of * np.minimum(n, m) >= self.near * np.maximum(n, m)


def _send_batch(docs: list, batch: int, buckets: int, words: WordKeys, gram: int) -> Iterator[dict]:
    """Grams of one batch packed per bucket: 40 bits of the key and the document's place in the batch."""
    sets = [gram_set(words.of(own), gram) for _, own in docs]
    sizes = [len(s) for s in sets]
    keys = np.concatenate([np.zeros(0, np.uint64), *sets])
    place = np.repeat(np.arange(len(docs), dtype=np.uint16), sizes)
    home = (keys % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(home, kind="stable")
    keys, place, home = keys[order] >> np.uint64(24), place[order], home[order]
    low, high = keys.astype(np.uint32), (keys >> np.uint64(32)).astype(np.uint8)
    cuts = np.flatnonzero(np.diff(home)) + 1
    about = {"ids": [i for i, _ in docs], "sizes": sizes}
    yield {"bucket": batch % buckets, "batch": batch, "low": b"", "high": b"", "place": b""} | about
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)], strict=True):
        if a < b:
            yield {
                "bucket": int(home[a]), "batch": batch, "low": low[a:b].tobytes(), "high": high[a:b].tobytes(),
                "place": place[a:b].tobytes(), "ids": None, "sizes": None,
            }


def _shared_grams(table: pa.Table) -> Iterator[dict]:
    """Of a bucket's grams those of two documents or more, sent back to their batches.

    A gram travels as one number whose order is the global order of grams: first by how many documents
    hold it (in steps of an eighth of a doubling), then by key.
    """
    bucket = table["bucket"][0].as_py()
    lows, highs, places = ([table[c][k].as_buffer() for k in range(table.num_rows)] for c in ("low", "high", "place"))
    counts = [len(b) for b in highs]
    key = np.frombuffer(b"".join(lows), np.uint32).astype(np.uint64) | np.frombuffer(b"".join(highs), np.uint8).astype(np.uint64) << np.uint64(32)
    place = np.frombuffer(b"".join(places), np.uint16)
    row = np.repeat(np.arange(table.num_rows), counts)
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    starts = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(ranked) else np.zeros(0, np.int64)
    held = np.diff(np.append(starts, len(ranked)))
    step = np.minimum(127, np.floor(8 * np.log2(np.maximum(held, 1)))).astype(np.uint64)
    name = mixed(ranked[starts] | (np.uint64(bucket) << np.uint64(40))) & np.uint64((1 << 55) - 1)
    grams = np.repeat((step << np.uint64(55)) | name, held)
    many = np.repeat(held > 1, held)
    order, grams = order[many], grams[many]
    back = np.argsort(row[order], kind="stable")
    order, grams = order[back], grams[back]
    edges = np.searchsorted(row[order], np.arange(table.num_rows + 1))
    for k in range(table.num_rows):
        a, b = int(edges[k]), int(edges[k + 1])
        ids = table["ids"][k].as_py()
        if a < b or ids is not None:
            yield {
                "batch": table["batch"][k].as_py(), "grams": grams[a:b].tobytes(), "place": place[order[a:b]].tobytes(),
                "ids": ids, "sizes": table["sizes"][k].as_py(),
            }


def _assembled(table: pa.Table, like: Similarity) -> Iterator[dict]:
    """Sets of a batch: id, size, grams no other document holds, and the others in global order.

    A document that does not share enough grams to reach any partner comes back without grams. ``node``
    is the set's own: a digest of it where all its grams are shared, so that it may have copies, and else
    the row's place.
    """
    ids, sizes = next((i, s) for i, s in zip(table["ids"].to_pylist(), table["sizes"].to_pylist(), strict=True) if i is not None)
    grams = np.concatenate([np.frombuffer(b.as_buffer(), np.uint64) for b in table["grams"]])
    place = np.concatenate([np.frombuffer(b.as_buffer(), np.uint16) for b in table["place"]])
    order = np.lexsort((grams, place))
    grams, place = grams[order].astype(np.int64), place[order]
    edges = np.searchsorted(place, np.arange(len(ids) + 1))
    batch = np.array([table["batch"][0].as_py()], np.int64).view(np.uint64)
    places = mixed(mixed(batch) + np.arange(len(ids), dtype=np.uint64)).view(np.int64).tolist()
    for k, (ident, n) in enumerate(zip(ids, sizes, strict=True)):
        own = grams[edges[k] : edges[k + 1]]
        row = {"id": ident, "n": n, "single": max(0, n - len(own)), "grams": None, "node": None, "copied": None}
        if n and ident is not None and len(own) >= like.least_shared(n):
            row["grams"] = own
            # a set with grams of its own equals none
            row["copied"] = len(own) >= n
            row["node"] = int.from_bytes(hashlib.blake2b(own.tobytes(), digest_size=8).digest(), "little", signed=True) if row["copied"] else places[k]
        yield row


def _tables(rows: Iterator[dict], schema: str) -> pa.Table:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "boolean": pa.bool_()}
    return pa.Table.from_pylist(list(rows), schema=pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in schema.split(", ")]))


def gram_sets(docs: DataFrame, ident: str = "doc_id", text: str = "text", gram: int = GRAM, like: Similarity | None = None) -> DataFrame:
    """Every document's set size and, where it may have a partner, its shared grams in global order.

    ``id, n, single, grams, node, copied``: ``single`` counts grams that no other document holds; they come
    first in the global order and never match. Grams are grouped by key in buckets whose number follows
    the bytes of text; only packed keys travel, never the text.
    """
    like = like or Similarity()
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    buckets = max(1, -(-size // (6 * BUCKET_GRAMS)))
    rows = docs.select(F.col(ident).cast("long").alias("id"), F.col(text).alias("text"))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, held, size = WordKeys(), [], 0
        batch_id = TaskContext.get().partitionId() << 32

        def flush(batch_id):
            table = _tables(_send_batch(held, batch_id, buckets, words, gram), _SENT)
            return table.to_batches(max_chunksize=256)

        for batch in batches:
            for ident, cell in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = cell.as_py() or ""
                held.append((ident, words_of(raw, lower=True)))
                size += len(raw)
                if size >= BATCH_BYTES or len(held) >= 1 << 16:
                    yield from flush(batch_id)
                    batch_id, held, size = batch_id + 1, [], 0
        if held:
            yield from flush(batch_id)

    def meet(table: pa.Table) -> pa.Table:
        return _tables(_shared_grams(table), _BACK)

    def gather(table: pa.Table) -> pa.Table:
        return _tables(_assembled(table, like), SETS)

    sent = in_small_batches(rows).mapInArrow(send, _SENT)
    back = sent.groupBy("bucket").applyInArrow(meet, _BACK)
    return back.groupBy("batch").applyInArrow(gather, SETS)


class PrefixTree:
    """Sorted gram sequences as a tree; common beginnings are stored once, long runs in pieces.

    Nodes are numbered so that the children of a node follow each other. ``low`` and ``high`` are the
    range of sets below a node, ``stop`` the end of those that end at it.
    """

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray, like: Similarity):
        count = len(sets)
        self.like = like
        flat = np.concatenate([np.zeros(0, np.int64), *sets])
        self.names, local = np.unique(flat, return_inverse=True)
        lengths = np.fromiter(map(len, sets), np.int64, count)
        begin = np.cumsum(lengths) - lengths
        self.sets = [local[b : b + n] for b, n in zip(begin, lengths, strict=True)]
        self.order = sorted(range(count), key=lambda k: self.sets[k].astype(">u4").tobytes())
        ranked = [self.sets[k] for k in self.order]
        self.sizes, self.lengths = sizes[self.order], lengths[self.order]
        common = np.array([_common(a, b) for a, b in zip(ranked, ranked[1:], strict=False)], np.int64)
        starts, ends, low, high, stop, child, depth, pieces = [0], [0], [0], [count], [0], [], [0], [(0, 0, 0)]
        queue = [(0, count, 0, 0)]
        for a, b, at, goal in queue:
            child.append(len(pieces))
            groups = []
            if at < goal:
                groups.append((a, b, at, goal))
                stop[len(child) - 1] = a
            else:
                first = a
                while first < b and len(ranked[first]) == at:
                    first += 1
                stop[len(child) - 1] = first
                breaks = (np.flatnonzero(common[first : b - 1] == at) + first + 1).tolist() if first < b else []
                for x, y in zip([first, *breaks], [*breaks, b], strict=True):
                    if x < y:
                        groups.append((x, y, at, int(common[x : y - 1].min()) if y - x > 1 else len(ranked[x])))
            for x, y, start, goal_of in groups:
                end = min(start + PIECE, goal_of)
                pieces.append((x, start, end))
                low.append(x)
                high.append(y)
                stop.append(x)
                depth.append(end)
                queue.append((x, y, end, goal_of))
        child.append(len(pieces))
        self.child = np.array(child)
        self.low, self.high, self.stop, self.depth = map(np.array, (low, high, stop, depth))
        self.cells = np.full((len(pieces), PIECE), len(self.names), np.int64)
        for k, (x, start, end) in enumerate(pieces):
            self.cells[k, : end - start] = ranked[x][start:end]
        self.longest = np.array([self.lengths[x:y].max(initial=0) for x, y in zip(low, high, strict=True)])
        self.smallest = np.array([self.sizes[x:y].min(initial=1 << 60) for x, y in zip(low, high, strict=True)])
        self.has = np.zeros(len(self.names) + 1, bool)

    def partners(self, own: np.ndarray, n: int, shared: int, wanted: np.ndarray) -> np.ndarray:
        """Sorted places of the ``wanted`` sets linked with a set of ``n`` grams, ``own`` those of the tree.

        Overlap is summed down the tree, once for all sets below a node. A subtree is left when not even
        all grams that remain (of its longest set, and of the probe) could make its smallest set a partner.
        """
        before = np.concatenate([[0], np.cumsum(wanted)])
        self.has[own] = True
        found = []
        nodes, overlap = np.zeros(1, np.int64), np.zeros(1, np.int64)
        while len(nodes):
            counts = self.child[nodes + 1] - self.child[nodes]
            first = np.repeat(self.child[nodes] - (np.cumsum(counts) - counts), counts)
            nodes, overlap = first + np.arange(len(first)), np.repeat(overlap, counts)
            keep = before[self.high[nodes]] > before[self.low[nodes]]
            nodes, overlap = nodes[keep], overlap[keep]
            overlap = overlap + self.has[self.cells[nodes]].sum(axis=1)
            rest = np.minimum(self.longest[nodes] - self.depth[nodes], shared - overlap)
            keep = self.like.linked(overlap + rest, n, self.smallest[nodes])
            nodes, overlap = nodes[keep], overlap[keep]
            for node in np.flatnonzero(self.stop[nodes] > self.low[nodes]).tolist():
                ends = np.arange(self.low[nodes[node]], self.stop[nodes[node]])
                found.append(ends[wanted[ends] & self.like.linked(overlap[node], n, self.sizes[ends])])
        self.has[own] = False
        return np.concatenate([np.zeros(0, np.int64), *found])


def _common(a: np.ndarray, b: np.ndarray) -> int:
    m = min(len(a), len(b))
    differ = a[:m] != b[:m]
    at = int(differ.argmax()) if m else 0
    return at if m and differ[at] else m


def join_sets(sets: list[np.ndarray], sizes: np.ndarray, weights: np.ndarray, like: Similarity) -> tuple[list[tuple[int, int]], np.ndarray]:
    """A forest over all linked pairs of the sets, and per set the weights of all sets linked with it.

    Every set meets all sets before it in the tree's order, so every pair is looked at once, together
    with those it shares a beginning with.
    """
    tree, count = PrefixTree(sets, sizes, like), len(sets)
    forest, edges = Forest(count), []
    links, own_weight = np.zeros(count, np.int64), weights[tree.order]
    place = np.arange(count)
    for x in range(count):
        n = int(tree.sizes[x])
        wanted = like.sizes_fit(tree.sizes, n) & (place < x)
        if wanted.any():
            found = tree.partners(tree.sets[tree.order[x]], n, len(sets[tree.order[x]]), wanted)
            links[x] += own_weight[found].sum()
            links[found] += own_weight[x]
            edges += [(tree.order[x], tree.order[y]) for y in found.tolist() if forest.join(x, y)]
    out = np.zeros(count, np.int64)
    out[tree.order] = links
    return edges, out


def meet_sets(visitors: list, visitor_sizes: np.ndarray, visitor_weights: np.ndarray, sets: list, sizes: np.ndarray, weights: np.ndarray, like: Similarity):
    """The same for all (visitor, set) pairs: a forest, and the links of visitors and of sets."""
    tree = PrefixTree(sets, sizes, like)
    forest, edges, count = Forest(len(visitors) + len(sets)), [], len(sets)
    to_visitors, to_sets = np.zeros(len(visitors), np.int64), np.zeros(count, np.int64)
    own_weight, order = weights[tree.order], np.array(tree.order)
    for v, (grams, n) in enumerate(zip(visitors, visitor_sizes.tolist(), strict=True)):
        at = np.searchsorted(tree.names, grams)
        known = at < len(tree.names)
        known[known] = tree.names[at[known]] == grams[known]
        found = tree.partners(at[known], n, int(known.sum()), like.sizes_fit(tree.sizes, n))
        to_visitors[v] += own_weight[found].sum()
        to_sets[order[found]] += visitor_weights[v]
        edges += [(v, tree.order[y]) for y in found.tolist() if forest.join(count + v, y)]
    return edges, to_visitors, to_sets


#: a pair of the forest (a, b), or how many rows a node is linked with (a, links)
FOUND = "a long, b long, links long"
_FOUND = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64())])


def _arrays(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    return table["node"].to_numpy(), table["n"].to_numpy(), table["weight"].to_numpy(), [np.asarray(c.values) for c in table["grams"]]


def _found(edges: list[tuple[int, int]], nodes: np.ndarray, links: np.ndarray) -> pa.Table:
    hit = np.flatnonzero(links)
    a = [x for x, _ in edges] + nodes[hit].tolist()
    b = [y for _, y in edges] + [None] * len(hit)
    return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array([0] * len(edges) + links[hit].tolist(), pa.int64())], schema=_FOUND)


def _join_blocks(table: pa.Table, like: Similarity) -> pa.Table:
    """Links inside every block of one task."""
    nodes, sizes, weights, sets = _arrays(table)
    block = table["block"].to_numpy()
    order = np.argsort(block, kind="stable")
    edges, links = [], np.zeros(len(nodes), np.int64)
    for rows in np.split(order, np.flatnonzero(np.diff(block[order])) + 1):
        if len(rows) > 1:
            pairs, links[rows] = join_sets([sets[r] for r in rows], sizes[rows], weights[rows], like)
            edges += [(int(nodes[rows[x]]), int(nodes[rows[y]])) for x, y in pairs]
    return _found(edges, nodes, links)


def _join_visit(left: pa.Table, right: pa.Table, like: Similarity) -> pa.Table:
    """Links between the visitors and the residents of one part of a large block."""
    if not left.num_rows or not right.num_rows:
        return _FOUND.empty_table()
    nodes, sizes, weights, sets = _arrays(left)
    own, own_sizes, own_weights, own_sets = _arrays(right)
    pairs, a, b = meet_sets(sets, sizes, weights, own_sets, own_sizes, own_weights, like)
    return _found([(int(nodes[v]), int(own[y])) for v, y in pairs], np.concatenate([nodes, own]), np.concatenate([a, b]))


def similar_groups(docs: DataFrame, ident: str = "doc_id", text: str = "text", gram: int = GRAM, near: int = NEAR, of: int = OF) -> DataFrame:
    """Documents linked by a gram Jaccard of ``near / of`` or more: ``id, n_shingles, component_id, n_links, class_id``.

    One row per input row. Words are lower-cased in A-Z; a text of fewer than ``gram`` words is one gram,
    a null or blank text has none and is linked with nothing. ``n_links`` counts all other rows linked
    directly, copies among them. Rows of equal sets are one class, named by its smallest id: the members
    of a class need not be paired with each other. Rows that share an id are one node of the components;
    rows with a null id are linked with nothing and have a null component. A text takes memory by its
    words, about 100 bytes for each, in the task that reads it.

    1. Sets are put in a global order, rare grams first, by one pass over packed keys. A document whose
       grams are mostly its own cannot have a partner and leaves here, whatever passages it shares.
    2. Equal sets become one class by their digest, with a count; a class's documents are not gathered.
    3. Partners share a gram among the first ``n - least_shared(n) + 1``; classes connected by such
       grams form blocks, found as connected components.
    4. Blocks are joined in prefix trees. A block of more than ``JOIN_GRAMS`` grams is cut into parts:
       each part is joined, and the classes that share an early gram with another part visit it. So no
       task holds more than a part and a slice of its visitors, and every pair meets once.
    """
    spark, like = docs.sparkSession, Similarity(near, of)
    place = "{}/sets-{}".format(ensure_checkpoint_dir(spark), uuid.uuid4().hex)
    gram_sets(docs, ident, text, gram, like).write.parquet(place)
    sets = spark.read.parquet(place)
    repeated = sets.where("id is not null").groupBy("id").count().where("count > 1").select("id")
    classes, groups = linked_classes(sets.where("grams is not null"), repeated, like)
    # a class is looked up by all its documents: its row is there once per salt
    classes = classes.join(groups.withColumnRenamed("id", "head"), "head", "left")
    copies = classes.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    members = sets.where("node is not null").withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS))).join(copies, ["node", "salt"])
    shown = ["id", F.col("n").alias("n_shingles")]
    links = (F.col("weight") - 1 + F.col("links")).cast("long").alias("n_links")
    members = members.select(*shown, F.coalesce("component", "head").alias("component_id"), links, F.col("head").alias("class_id"))
    none = F.lit(0).cast("long").alias("n_links")
    lone = sets.where("node is null and id is not null").join(groups, "id", "left")
    lone = lone.select(*shown, F.coalesce("component", "id").alias("component_id"), none, F.col("id").alias("class_id"))
    nameless = sets.where("id is null").select(*shown, F.col("id").alias("component_id"), none, F.col("id").alias("class_id"))
    return members.union(lone).union(nameless)


def linked_pairs(docs: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """Class representatives that are linked through a chain of others or directly, and who belongs to a class.

    ``a, b``: a forest over the representatives (smallest ids) of linked classes; ``id, class_id``: membership.
    """
    rows = checkpointed(similar_groups(docs, **options))
    heads = rows.where("id is not null and id = class_id and component_id <> id").select(F.col("id").alias("a"), F.col("component_id").alias("b")).distinct()
    return heads, rows.select("id", "class_id")


def linked_classes(some: DataFrame, repeated: DataFrame, like: Similarity) -> tuple[DataFrame, DataFrame]:
    """``node, head, weight, links`` of every class, and the component of every id that is not alone.

    ``some``: rows of ``SETS`` that have grams; ``repeated``: ids that stand on several rows.
    """
    about = some.groupBy("node").agg(F.min("id").alias("head"), F.count("*").alias("weight"))
    # one row per class goes on
    kept = some.where("not copied").select("node", "id", "n", "single", "grams")
    first = some.where("copied").groupBy("node").agg(*(F.first(c).alias(c) for c in ("id", "n", "single", "grams")))
    alone = kept.unionByName(first).drop("id").join(about, "node")
    alone = checkpointed(alone)
    early = F.expr("slice(grams, 1, cast(n - ceil({0} * n / {1}) + 1 - single as int))".format(like.near, like.of))
    early = checkpointed(alone.select("node", F.explode(early).alias("gram")))
    low = early.groupBy("gram").agg(F.min("node").alias("b"), F.count("*").alias("held")).where("held > 1").drop("held")
    blocks = components(early.join(low, "gram").where("node <> b").select(F.col("node").alias("a"), "b"))
    blocks = checkpointed(blocks.withColumnRenamed("component", "block").withColumnRenamed("id", "node"))
    held = alone.select("node", "n", "weight", "grams", F.size("grams").alias("length")).join(blocks, "node")
    sizes = held.groupBy("block").agg(F.sum("length").alias("length"))
    total = sizes.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    tasks = max(1, -(-total // JOIN_GRAMS))
    parts = sizes.select("block", F.ceil(F.col("length") / JOIN_GRAMS).alias("parts"))
    placed = held.join(parts, "block").withColumn("part", F.expr("pmod(xxhash64(node), parts)"))
    small = F.col("parts") == 1
    key = F.when(small, F.expr("pmod(xxhash64(block), {})".format(tasks))).otherwise(F.col("block"))
    dealt = placed.select(small.alias("small"), key.alias("task"), "part", "block", "node", "n", "weight", "grams")
    found = checkpointed(dealt.groupBy("small", "task", "part").applyInArrow(lambda table: _join_blocks(table, like), FOUND))
    large = parts.where("parts > 1")
    if not large.isEmpty():
        found = found.union(_visits(placed.where("parts > 1"), early, like))
    links = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    classes = checkpointed(about.join(links, "node", "left").fillna(0, ["links"]))
    heads = classes.select("node", "head")
    forest = found.where("b is not null").join(heads.select(F.col("node").alias("a"), F.col("head").alias("x")), "a")
    forest = forest.join(heads.select(F.col("node").alias("b"), F.col("head").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    # an id on several rows joins their classes
    own = some.join(repeated, "id", "left_semi").select("id", "node").distinct().join(heads, "node").select(F.col("id").alias("a"), F.col("head").alias("b"))
    return classes, components(forest.union(own))


def _visits(large: DataFrame, early: DataFrame, like: Similarity) -> DataFrame:
    """Links between different parts of large blocks."""
    known = large.select("node", "block", "part")
    grams = checkpointed(early.join(known, "node").select("gram", "node", "block", "part"))
    there = grams.select("gram", F.col("part").alias("to_part")).distinct()
    visits = checkpointed(grams.join(there, "gram").where("to_part > part").select("block", "to_part", "node").distinct())
    slices = visits.groupBy("block", "to_part").agg(F.ceil(F.count("*") / 1000).alias("slices"))
    visitors = visits.join(slices, ["block", "to_part"]).withColumn("slice", F.expr("pmod(xxhash64(node), slices)"))
    visitors = visitors.join(large.select("node", "n", "weight", "grams"), "node").select("block", "to_part", "slice", "node", "n", "weight", "grams")
    homes = large.select("block", F.col("part").alias("to_part"), "node", "n", "weight", "grams").join(slices, ["block", "to_part"])
    homes = homes.withColumn("slice", F.explode(F.expr("sequence(0L, slices - 1)")))
    # new column instances: both sides come from the same frame
    homes = homes.select(*(F.col(c).alias("home_" + c) for c in ("block", "to_part", "slice")), *(F.col(c).alias(c) for c in ("node", "n", "weight", "grams")))
    left = visitors.groupBy("block", "to_part", "slice")
    meet = lambda a, b: _join_visit(a, b, like)
    return checkpointed(left.cogroup(homes.groupBy("home_block", "home_to_part", "home_slice")).applyInArrow(meet, FOUND))
