"""Locate the row list inside semi-structured page-list payloads.

A payload table has one JSON document per row. Everything that looks at a single document is a
column expression over that document; only the exhaustive search walks documents level by level.
Documents of more than ``large.WHOLE`` bytes are cut by many tasks first; the same rules then choose
among lists whose elements are rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagegraph.functions import fixed
from pagegraph.functions.text import let, named, signed_zeros
from pagegraph.session import checkpointed
from pagegraph.sources import large


def is_object(v: Column) -> Column:
    return F.startswith(F.schema_of_variant(v), F.lit("OBJECT"))


def object_rows(node: Column) -> Column:
    """Object elements of a list; null when the node is no list or has no object."""
    rows = F.filter(node.try_cast("array<variant>"), is_object)
    return F.when(F.size(rows) > 0, rows)


def hint_keys(rows: Column, sample: int | None = None) -> Column:
    """Distinct record-hint keys of the rows; of the first ``sample`` rows only where a caller asks for that."""
    looked = rows if sample is None else F.slice(rows, 1, sample)
    seen = F.flatten(F.transform(looked, lambda r: F.map_keys(r.try_cast("map<string,variant>"))))
    return F.array_intersect(F.array(*[F.lit(key) for key in fixed.ROW_HINT_KEYS]), seen)


def score(rows: Column, sample: int | None = None) -> Column:
    """Ten points per row plus one per distinct hint key."""
    return F.size(rows) * 10 + F.size(hint_keys(rows, sample))


def nesting(text: Column) -> Column:
    """How deep the brackets of a JSON text nest."""
    plain = F.regexp_replace(F.regexp_replace(text, r"\\.", ""), r'"[^"]*"', "")
    marks = F.split(F.regexp_replace(plain, r"[^\[\]{}]", ""), "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(s: Column, c: Column) -> Column:
        now = s["now"] + F.when(c.isin("[", "{"), 1).when(c.isin("]", "}"), -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(s["most"], now).alias("most"))

    return F.aggregate(marks, start, step, lambda s: s["most"])


def direct_candidates(payload: Column) -> Column:
    """Row lists at the usual places, in order, that look like page records: some row has a hint key."""
    at = lambda v, path: F.try_variant_get(v, path, "variant")
    root = at(payload, '$["*"]')
    places = F.concat(
        F.array(at(payload, "$.pages"), root, at(payload, '$.a["*"]')),
        F.coalesce(
            F.transform(root.try_cast("array<variant>"), lambda e: at(e, '$.a["*"]')),
            F.array().cast("array<variant>"),
        ),
    )
    lists = F.transform(places, object_rows)
    return F.filter(lists, lambda rows: rows.isNotNull() & (F.size(hint_keys(rows)) > 0))


def best_candidate(candidates: Column) -> Column:
    """Candidate with the highest score; the first one wins a tie. Null without candidates."""
    ranked = F.transform(candidates, lambda rows, i: F.struct(score(rows).alias("score"), (-i).alias("rank")))
    return F.try_element_at(candidates, 1 - F.array_max(ranked)["rank"])


def direct_records(payload: Column) -> Column:
    """array<variant> of the records of one payload, or null when only a deep search can tell."""
    return best_candidate(direct_candidates(payload))


def _members(node: str) -> Column:
    """Children of a JSON text, in document order, as array<struct<text, v>>."""
    text, v = F.col(node + ".text"), F.col(node + ".v")
    keys = F.json_object_keys(text)
    maps = named(raw=F.from_json(text, "map<string,string>"), v=v.try_cast("map<string,variant>"))
    of_object = let(
        maps,
        lambda m: F.transform(keys, lambda k: named(text=F.try_element_at(m["raw"], k), v=F.try_element_at(m["v"], k))),
    )
    of_list = F.zip_with(
        F.from_json(text, "array<string>"),
        v.try_cast("array<variant>"),
        lambda t, e: named(text=t, v=e),
    )
    shape = F.schema_of_variant(v)
    return F.when(F.startswith(shape, F.lit("OBJECT")), of_object).when(F.startswith(shape, F.lit("ARRAY")), of_list)


def deep_records(payloads: DataFrame, keys: list[str], json_column: str) -> DataFrame:
    """Best row list found at any depth, one row (keys, records) per payload.

    As many explode steps in one pipeline as the deepest payload nests (one aggregation tells): every
    step keeps the nodes seen so far and adds the children of the newest ones. The choice per payload
    is one aggregation with map-side combine, keyed by payload. The first list in document order wins
    a tie.
    """
    doc = F.try_parse_json(signed_zeros(F.col(json_column)))
    no_path = F.array().cast("array<long>")
    start = F.array(
        named(path=_path(-2), text=F.lit(None).cast("string"), v=F.try_variant_get(doc, '$["*"]', "variant"), new=F.lit(False)),
        named(path=_path(-1), text=F.lit(None).cast("string"), v=F.try_variant_get(doc, "$.pages", "variant"), new=F.lit(False)),
        named(path=no_path, text=F.col(json_column), v=doc, new=F.lit(True)),
    )
    depth = payloads.agg(F.coalesce(F.max(nesting(F.col(json_column))), F.lit(0))).first()[0]
    found = _lists_below(payloads.select(*keys, F.explode_outer(start).alias("node")), keys, depth)
    order = F.struct((-score(F.col("rows"))).alias("s"), F.col("path").alias("path"))
    return found.groupBy(*keys).agg(F.min_by("rows", order).alias("records"))


def _path(step: int) -> Column:
    return F.array(F.lit(step).cast("long"))


def _lists_below(nodes: DataFrame, keys: list[str], depth: int) -> DataFrame:
    """``keys, path, rows`` of all lists with object rows in nodes that nest at most ``depth`` levels."""
    for _ in range(depth):
        done = F.array(named(path=F.col("node.path"), text=F.col("node.text"), v=F.col("node.v"), new=F.lit(False)))
        below = F.transform(
            F.when(F.col("node.new"), _members("node")),
            lambda child, i: named(path=F.concat("node.path", F.array(i.cast("long"))), text=child["text"], v=child["v"], new=F.lit(True)),
        )
        nodes = nodes.select(*keys, F.explode_outer(F.concat(done, F.coalesce(below, F.slice(done, 1, 0)))).alias("node"))
    found = nodes.select(*keys, F.col("node.path").alias("path"), object_rows(F.col("node.v")).alias("rows"))
    return found.where(F.col("rows").isNotNull())


def extract_records(payloads: DataFrame, keys: list[str], json_column: str, whole: int | None = large.WHOLE, size: int = large.RANGE) -> DataFrame:
    """(keys, position, record VARIANT): direct places first, deep search for the others.

    Payloads of more than ``whole`` bytes are cut in ranges of ``size`` bytes by as many tasks; the rules
    and the result are the same.
    """
    small, cut = large.halves(payloads, json_column, whole)
    parsed = small.select(*keys, json_column, F.try_parse_json(signed_zeros(F.col(json_column))).alias("_doc"))
    direct = parsed.select(*keys, json_column, direct_records(F.col("_doc")).alias("records"))
    deep = deep_records(direct.where(F.col("records").isNull()).select(*keys, json_column), keys, json_column)
    both = direct.where(F.col("records").isNotNull()).select(*keys, "records").unionByName(deep)
    found = exploded_records(both, keys)
    return found if cut is None else found.unionByName(large_records(cut, keys, json_column, size))


def large_records(payloads: DataFrame, keys: list[str], json_column: str, size: int = large.RANGE) -> DataFrame:
    """``extract_records`` for payloads that are cut in ranges: no task holds a whole one.

    A list is either cut itself, its rows are elements then, or lies within one element. Both kinds are
    scored by the same rule, and the better one of a payload is taken, its rows numbered in blocks.
    """
    cut = large.shred(payloads, keys, json_column, size)
    located = checkpointed(large.located(cut))
    elements = located.where("child is null")
    own = F.map_keys(F.col("v").try_cast("map<string,variant>"))
    mask = lambda has: reduce(Column.bitwiseOR, [F.when(has(key), 1 << i).otherwise(0) for i, key in enumerate(fixed.ROW_HINT_KEYS)])
    rows = elements.where((F.col("kind") == "[") & is_object(F.col("v")))
    rows = rows.select("doc", "container", mask(lambda key: F.array_contains(own, key)).alias("mask"))
    # rows that are cut themselves: their members are elements
    inner = located.where("kind = '{'").groupBy("doc", F.col("container").alias("child"))
    inner = inner.agg(F.bit_or(mask(lambda key: F.col("name") == key)).alias("mask"))
    outer = located.where("kind = '[' and child is not null").join(inner, ["doc", "child"]).select("doc", "container", "mask")
    lists = rows.union(outer).groupBy("doc", "container").agg(F.count("*").alias("n"), F.bit_count(F.bit_or("mask")).alias("hints"))
    lists = lists.join(cut.containers.select("doc", "container", "names", "path"), ["doc", "container"])
    lists = checkpointed(lists.withColumn("score", F.col("n") * 10 + F.col("hints")))
    small = cut.elements.where(F.col("container") == large.OUTSIDE)
    nowhere = F.array().cast("array<string>"), F.array().cast("array<long>")
    # an element whose text has no bracket holds no list
    pieces = elements.where(_may_list()).select("doc", "at", "kind", "names", "path", "name", "text", "v")
    whole = small.select("doc", "at", F.lit("").alias("kind"), nowhere[0].alias("names"), nowhere[1].alias("path"), F.lit("").alias("name"), "text", "v")
    whole = whole.where(_may_list())

    direct = _best(
        lists.where("hints > 0").select("doc", "container", "score", _direct_rank(F.col("names"), F.col("path")).alias("rank")).where("rank is not null"),
        pieces.select("doc", F.explode(_direct_lists()).alias("c")).select("doc", F.col("c.rank").alias("rank"), object_rows(F.col("c.list")).alias("rows"))
        .where(F.size(hint_keys(F.col("rows"))) > 0),
    )
    direct = checkpointed(direct.union(_best(None, whole.select("doc", _path(0).alias("rank"), direct_records(F.col("v")).alias("rows")).where("rows is not null"))))

    left = checkpointed(pieces.union(whole).join(direct, "doc", "left_anti"))
    depth = left.agg(F.coalesce(F.max(nesting(F.col("text"))), F.lit(0))).first()[0]
    node = named(path=F.when(F.col("kind") == "", F.col("path")).otherwise(F.concat("path", F.array("at"))), text=F.col("text"), v=F.col("v"), new=F.lit(True))
    top = F.array(*[named(path=_path(i), list=F.try_variant_get("v", p, "variant")) for i, p in ((-2, '$["*"]'), (-1, "$.pages"))])
    again = left.where((F.size("names") == 0) & (F.col("kind") != "[")).select("doc", F.explode(top).alias("c"))
    again = again.select("doc", F.col("c.path").alias("path"), object_rows(F.col("c.list")).alias("rows")).where("rows is not null")
    within = _lists_below(left.select("doc", node.alias("node")), ["doc"], depth).union(again)
    order = F.when(F.col("names") == F.array(F.lit("*")), _path(-2)).when(F.col("names") == F.array(F.lit("pages")), _path(-1)).otherwise(F.col("path"))
    deep = _best(lists.join(direct, "doc", "left_anti").select("doc", "container", "score", order.alias("rank")), within.withColumnRenamed("path", "rank"))
    best = checkpointed(direct.union(deep))

    from_lists = large.whole_elements(cut, best.where("rows is null")).where(is_object(F.col("v")))
    from_lists = large.numbered_rows(from_lists.select("doc", "at", F.col("v").alias("record")), "doc", "at")
    from_pieces = best.where("rows is not null").select("doc", F.posexplode("rows").alias("position", "record"))
    found = from_lists.select("doc", "position", "record").union(from_pieces.select("doc", F.col("position").cast("long"), "record"))
    return large.restore_keys(found, cut, "position", F.col("position").cast("int").alias("position"), "record")


def _may_list() -> Column:
    return F.contains(F.col("text"), F.lit("["))


def _direct_rank(names: Column, path: Column) -> Column:
    """Place among the direct candidates of a list that is cut itself; null for other lists."""
    at = lambda *steps: names == F.array(*[F.lit(s) for s in steps])
    later = F.concat(_path(3), F.slice(path, 2, 1))
    return F.when(at("pages"), _path(0)).when(at("*"), _path(1)).when(at("a", "*"), _path(2)).when(at("*", "#", "a", "*"), later)


def _direct_lists() -> Column:
    """Direct candidates inside an element, by the place of its container: array<struct<rank, list>>."""
    get = lambda v, path: F.try_variant_get(v, path, "variant")
    names, name, v = F.col("names"), F.col("name"), F.col("v")
    at = lambda *steps: names == (F.array(*[F.lit(s) for s in steps]) if steps else F.array().cast("array<string>"))
    one = lambda rank, path: F.array(named(rank=rank, list=get(v, path)))
    later = F.concat(_path(3), F.slice("path", 2, 1))
    inner = F.transform(
        get(v, '$["*"]').try_cast("array<variant>"),
        lambda e, i: named(rank=F.concat(_path(3), F.array(i.cast("long"))), list=get(e, '$.a["*"]')),
    )
    none = F.array().cast("array<struct<rank:array<bigint>,list:variant>>")
    return (
        F.when(at() & (name == "pages"), one(_path(0), "$.pages"))
        .when(at() & (name == "*"), F.concat(one(_path(1), '$["*"]'), F.coalesce(inner, none)))
        .when(at() & (name == "a"), one(_path(2), '$.a["*"]'))
        .when(at("a") & (name == "*"), one(_path(2), '$["*"]'))
        .when(at("*") & (F.col("kind") == "["), one(F.concat(_path(3), F.array("at")), '$.a["*"]'))
        .when(at("*", "#") & (name == "a"), one(later, '$.a["*"]'))
        .when(at("*", "#", "a") & (name == "*"), one(later, '$["*"]'))
        .otherwise(none)
    )


def _best(lists: DataFrame | None, within: DataFrame) -> DataFrame:
    """``doc, container, rows`` of the best list per document; the first one wins a tie.

    ``lists``: doc, container, score, rank. ``within``: doc, rank, rows, lists that lie in one element.
    """
    inner = within.select("doc", F.lit(None).cast("long").alias("container"), score(F.col("rows")).cast("long").alias("score"), "rank", "rows")
    if lists is not None:
        kind = inner.schema["rows"].dataType
        inner = inner.union(lists.select("doc", "container", F.col("score").cast("long"), "rank", F.lit(None).cast(kind).alias("rows")))
    order = F.struct((-F.col("score")).alias("s"), "rank")
    found = inner.groupBy("doc").agg(F.min_by(F.struct("container", "rows"), order).alias("best"))
    return found.select("doc", "best.container", "best.rows")


def exploded_records(payloads: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, position, record) of payloads with a ``records`` list.

    The outer form keeps the optimizer from testing the list's size first, which would build the
    list twice.
    """
    rows = payloads.select(*keys, F.posexplode_outer("records").alias("position", "record"))
    return rows.where(F.col("position").isNotNull())


def rejected_payloads(payloads: DataFrame, keys: list[str], json_column: str, whole: int | None = large.WHOLE, size: int = large.RANGE) -> DataFrame:
    """Payloads that are no JSON object (broken text, duplicate keys, other JSON values).

    Payloads of more than ``whole`` bytes are cut to be judged, not taken for broken.
    """
    small, long = large.halves(payloads, json_column, whole)
    shape = F.schema_of_variant(F.try_parse_json(signed_zeros(F.col(json_column))))
    bad = ~F.coalesce(F.startswith(shape, F.lit("OBJECT")), F.lit(False))
    found = small.where(bad).select(*keys, json_column)
    if long is None:
        return found
    cut = large.shred(long, keys, json_column, size)
    sound = large.object_docs(cut).select(F.explode(F.array("keys")).alias("_k")).select(*(F.col("_k")[k].alias("_" + k) for k in keys))
    same = [F.col(k).eqNullSafe(F.col("_" + k)) for k in keys]
    every = same[0]
    for one in same[1:]:
        every = every & one
    return found.union(long.join(sound, every, "left_anti").select(*keys, json_column))
