"""Near-duplicate vectors by tiles in principal-axis order with bounds on what is not yet summed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagegraph.llm.common import Forest, components
from pagegraph.session import checkpointed

#: rows of one side of a tile; leading axes summed after each step
TILE, STEPS = 1024, (8, 16, 32)
_ROUNDING = 1e-9


def principal_axes(vectors: DataFrame, column: str = "v") -> dict[int, np.ndarray]:
    """Per vector length, an orthogonal matrix whose columns are the axes by falling second moment.

    The moments cover all rows: each task adds up its unit vectors, tasks' sums meet per matrix cell.
    """

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for unit in by_length(batch.column(0)):
                sums[unit.shape[1]] = sums.get(unit.shape[1], 0) + unit.T @ unit
        for d, cells in sums.items():
            flat = np.arange(d * d)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(d * d, d)), pa.array(flat), pa.array(cells.ravel())], ["dim", "cell", "s"])

    cells = vectors.select(column).mapInArrow(moments, "dim long, cell long, s double").groupBy("dim", "cell").agg(F.sum("s"))
    found: dict[int, np.ndarray] = {}
    for d, cell, s in cells.collect():
        found.setdefault(d, np.zeros(d * d))[cell] = s
    return {d: np.linalg.eigh(m.reshape(d, d))[1][:, ::-1].copy() for d, m in found.items()}


def unit_rows(flat: np.ndarray, d: int) -> np.ndarray:
    rows = flat.reshape(-1, d)
    return rows / np.sqrt((rows * rows).sum(axis=1))[:, None]


def by_length(column: pa.Array) -> Iterator[np.ndarray]:
    lengths = np.asarray(column.value_lengths())
    if len(lengths) and (lengths == lengths[0]).all():
        yield unit_rows(column.flatten().to_numpy(), int(lengths[0]))
    else:
        rows = column.to_pylist()
        for d in np.unique(lengths):
            yield unit_rows(np.concatenate([r for r in rows if len(r) == d]), int(d))


def close_pairs(left: np.ndarray, right: np.ndarray, least: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places of rows whose product may reach ``least``: leading axes first, the rest bounded by norms."""
    width = left.shape[1]
    steps = [s for s in STEPS if s < width] + [width]

    def rest(rows, start):
        return np.sqrt((rows[:, start:] ** 2).sum(axis=1))

    first = steps[0]
    part = left[:, :first] @ right[:, :first].T
    able = part + np.outer(rest(left, first), rest(right, first)) >= least - _ROUNDING
    if same:
        able &= np.tri(len(left), len(right), -1, dtype=bool)
    i, j = np.nonzero(able)
    part = part[i, j]
    for start, end in zip(steps, steps[1:], strict=False):
        part = part + np.einsum("nd,nd->n", left[i, start:end], right[j, start:end])
        keep = part + rest(left, end)[i] * rest(right, end)[j] >= least - _ROUNDING
        i, j, part = i[keep], j[keep], part[keep]
    return i, j


def link_vectors(df: DataFrame, least: float = 0.93, ident: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """Links of equal label and cosine of at least ``least``: ``vec_id, n_links, component_id, kept``.

    One row per distinct (id, label, vector). Vectors that are null, empty, zero or hold null or
    non-finite components, and rows with null label or id, have no links and are their own component;
    vectors of different lengths are not compared. ``n_links`` counts the other vectors linked directly;
    the component is the smallest id reachable. Rows sharing an id are one node of the components.

    Equal vectors of a label are one class with a count. Two unit vectors of that cosine are at most
    ``sqrt(2 - 2 * least)`` apart, so along the first axis they lie in the same or in adjacent cells of
    that width; cells are cut into tiles by hash, and each pair of tiles that can meet is one task.
    """
    value = F.transform(F.col(vector), lambda x: x.cast("double"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = df.select(F.col(ident).cast("long").alias("vec_id"), F.col(label).alias("label"), value.alias("v")).distinct()
    squares = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    fit = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()
    rows = rows.withColumn("fit", F.coalesce(fit & ~bad & (squares > 0) & (squares < float("inf")), F.lit(False)))
    rows = checkpointed(rows)
    classes = rows.where("fit").groupBy("label", "v").agg(F.min("vec_id").alias("head"), F.count("*").alias("n"))
    classes = checkpointed(classes.withColumn("dim", F.size("v")).withColumn("key", F.xxhash64("label", "v")))
    axes = classes.sparkSession.sparkContext.broadcast(principal_axes(classes))
    width = float(np.sqrt(max(0.0, 2 - 2 * least))) * (1 + _ROUNDING) + _ROUNDING

    @F.pandas_udf("long")
    def cell(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out = []
            for v in batch:
                v = np.asarray(v, float)
                out.append(int(np.floor(v @ axes.value[len(v)][:, 0] / np.sqrt(v @ v) / width)))
            yield pd.Series(out, dtype="int64")

    celled = classes.withColumn("cell", cell("v"))
    counts = celled.groupBy("label", "dim", "cell").agg(F.ceil(F.count("*") / TILE).alias("tiles"))
    near = counts.select("label", "dim", (F.col("cell") - 1).alias("cell"), F.col("tiles").alias("above"))
    near = counts.join(near, ["label", "dim", "cell"], "left")
    below = counts.select("label", "dim", (F.col("cell") + 1).alias("cell"), F.col("tiles").alias("below"))
    near = near.join(below, ["label", "dim", "cell"], "left").na.fill(0, ["above", "below"])
    placed = celled.join(near, ["label", "dim", "cell"]).withColumn("tile", F.expr("pmod(xxhash64(head), tiles)"))
    meets = F.expr(
        """concat(
        transform(sequence(0L, tiles - 1), t -> struct(cell as c, least(tile, t) as x, cell as d, greatest(tile, t) as y, tile > t as right)),
        if(above > 0, transform(sequence(0L, greatest(above, 1L) - 1), t -> struct(cell as c, tile as x, cell + 1 as d, t as y, false as right)), array()),
        if(below > 0, transform(sequence(0L, greatest(below, 1L) - 1), t -> struct(cell - 1 as c, t as x, cell as d, tile as y, true as right)), array()))"""
    )
    dealt = placed.select("label", "dim", "head", "key", "n", "v", F.explode(meets).alias("m")).select("label", "dim", "head", "key", "n", "v", "m.*")
    schema = pa.schema([("id", pa.int64()), ("to", pa.int64()), ("links", pa.int64())])

    def tile_links(table: pa.Table) -> pa.Table:
        """Links of a tile pair: how many each class has (``links`` by key), and a forest of heads (``to``)."""
        d = table.column("dim")[0].as_py()
        right = table.column("right").to_numpy()
        same = table.column("c")[0] == table.column("d")[0] and table.column("x")[0] == table.column("y")[0]
        heads, n = table.column("head").to_numpy(), table.column("n").to_numpy()
        given = table.column("v").combine_chunks().flatten().to_numpy().reshape(-1, d)
        turned = unit_rows(given, d) @ axes.value[d]
        a = np.arange(len(heads)) if same else np.flatnonzero(~right)
        b = a if same else np.flatnonzero(right)
        i, j = close_pairs(turned[a], turned[b], least, same)
        i, j = a[i], b[j]
        dots = np.einsum("nd,nd->n", given[i], given[j])
        norms = np.sqrt((given * given).sum(axis=1))
        keep = dots / (norms[i] * norms[j]) >= least
        i, j = i[keep], j[keep]
        links = np.zeros(len(heads), np.int64)
        np.add.at(links, i, n[j])
        np.add.at(links, j, n[i])
        forest = Forest(len(heads))
        tree = [(x, y) for x, y in zip(i.tolist(), j.tolist(), strict=True) if forest.join(x, y)]
        hit = np.flatnonzero(links)
        ids = np.concatenate([table.column("key").to_numpy()[hit], heads[[x for x, _ in tree]] if tree else np.zeros(0, np.int64)])
        to = [None] * len(hit) + [int(heads[y]) for _, y in tree]
        return pa.table([pa.array(ids), pa.array(to, pa.int64()), pa.array(links[hit].tolist() + [0] * len(tree), pa.int64())], schema=schema)

    found = checkpointed(dealt.groupBy("label", "dim", "c", "x", "d", "y").applyInArrow(tile_links, "id long, to long, links long"))
    links = found.where("to is null").groupBy(F.col("id").alias("node")).agg(F.sum("links").alias("others"))
    member = rows.where("fit").join(classes.select("label", "v", "head", "key", "n"), ["label", "v"])
    edges = found.where("to is not null").select(F.col("id").alias("a"), F.col("to").alias("b"))
    edges = edges.union(member.where("vec_id <> head").select(F.col("vec_id").alias("a"), F.col("head").alias("b")))
    roots = components(edges)
    linked = member.join(links, member["key"] == links["node"], "left").join(roots, member["vec_id"] == roots["id"], "left")
    linked = linked.select(
        "vec_id",
        (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"),
        F.coalesce("component", "vec_id").alias("component_id"),
    )
    alone = rows.where("not fit").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = linked.union(alone)
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
