"""Large documents cut by many tasks: the scan of a range, whole documents, and the readers on top."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagegraph.sources import large, piles, records, results


def random_value(rng, depth=0):
    kind = rng.randint(0, 7 if depth < 5 else 4)
    if kind < 2:
        return "".join(rng.choice('ab"\\[]{},:é漢🙂\n') for _ in range(rng.randint(0, 12)))
    if kind < 5:
        return rng.choice([None, True, 1.5, 17, ""])
    size = rng.randint(0, 6)
    if kind == 5:
        return [random_value(rng, depth + 1) for _ in range(size)]
    return {"k%d%s" % (i, rng.choice('"\\,')): random_value(rng, depth + 1) for i in range(size)}


def states(text):
    """(inside, escaped, depth) before every byte, by reading from the start."""
    out, inside, escaped, depth = [], False, False, 0
    for c in text:
        out.append((inside, escaped, depth))
        if inside:
            inside, escaped = (inside, False) if escaped else (c != 34, c == 92)
        elif c == 34:
            inside = True
        elif c in b"[{":
            depth += 1
        elif c in b"]}":
            depth -= 1
    return out


@pytest.mark.parametrize("seed", range(6))
def test_effects_of_ranges_compose(seed):
    rng = random.Random(seed)
    text = json.dumps({"x": [random_value(rng) for _ in range(20)], "s": "\\" * 9}, ensure_ascii=seed % 2 == 0).encode()
    true = states(text)
    for size in (1, 2, 3, 7, 40):
        inside, escaped, depth = False, False, 0
        for at in range(0, len(text), size):
            raw = np.frombuffer(text[at : at + size], np.uint8)
            assert (inside, escaped, depth) == true[at]
            found = large.effect(raw)
            depth += found["delta%d%d" % (escaped, inside)]
            inside ^= bool(found["flips%d" % escaped])
            escaped = bool((found["trailing"] + (escaped if found["trailing"] == found["size"] else 0)) % 2)


def payload_frame(spark, docs):
    rows = [(i, d if d is None or isinstance(d, str) else json.dumps(d, ensure_ascii=False)) for i, d in enumerate(docs)]
    return spark.createDataFrame(rows, "pid int, json string")


def broken(shredded):
    return sorted(r.keys.pid for r in shredded.docs.join(shredded.broken, "doc").collect())


def put_together(shredded):
    """The documents again, from their pieces."""
    containers = {}
    for r in shredded.containers.collect():
        containers[r.doc, r.container] = [] if r.kind == "[" else {}
    bad, out = {r.doc for r in shredded.broken.collect()}, {}
    names = {r.doc: r.keys.pid for r in shredded.docs.collect()}
    for r in sorted(shredded.elements.drop("v").collect(), key=lambda r: (r.doc, r.container, r["at"])):
        if r.doc in bad:
            continue
        value = containers[r.doc, r.child] if r.child is not None else json.loads(r.text)
        if r.container == large.OUTSIDE:
            out[names[r.doc]] = value
        elif isinstance(containers[r.doc, r.container], list):
            containers[r.doc, r.container].append(value)
        elif r.child is not None:
            containers[r.doc, r.container][r.name] = value
        else:
            containers[r.doc, r.container].update(value)
    for r in shredded.containers.where("level = 0").collect():
        if r.doc not in bad:
            out[names[r.doc]] = containers[r.doc, r.container]
    return out


@pytest.mark.parametrize("size", [40, 1000])
def test_shredding_keeps_documents(spark, size):
    rng = random.Random(size)
    docs = [{"m": [random_value(rng) for _ in range(12)], "long": "x,[\\" * 40, "e": [], "o": {}} for _ in range(4)]
    docs += [[1, [2, [3, [4] * 60]]], {"a": {"b": {"c": [{"d": list(range(50))}] * 3}}}, "  [ ]  ", "7", {}, '{"pad":  ' + " " * 200 + "[]}"]
    found = large.shred(payload_frame(spark, docs), ["pid"], "json", size)
    assert broken(found) == []
    assert put_together(found) == {i: json.loads(d) if isinstance(d, str) else d for i, d in enumerate(docs)}


def test_paths_follow_document_order(spark):
    doc = {"b": [[1] * 30, {"z": [2] * 30}], "a": [3] * 30}
    found = large.shred(payload_frame(spark, [doc]), ["pid"], "json", 16)
    paths = [(r.names, r.path) for r in found.containers.orderBy("container").collect() if r.kind == "["]
    assert [n for n, _ in paths] == [["b"], ["b", "#"], ["b", "#", "z"], ["a"]]
    assert sorted(paths, key=lambda p: p[1]) == paths


def test_broken_documents_are_told(spark):
    pad = "x" * 60
    bad = ['{"a": [1, 2', '{"a": [1, 2}]', '{"a": [1,, 2]}', '{"a": [1 2]}', '{"a": 1, "a": "%s"}', '{"a": "%s"} {}', '{"a": "%s"}, 1']
    bad += ['{"a": [1, "%s"], }', '["%s" []]', '{"k": [3, "%s"] 4}', '{[1, "%s"]: 2}', "[1, 2]]", '{"a": "%s', "}{", '{"a":: ["%s"]}', "", " "]
    docs = [b % pad if "%s" in b else b + " " * 40 for b in bad]
    good = ['{"a": ["%s", [], {}]}' % pad, "[[], [[]], %s]" % ", ".join(["[]"] * 30), '"%s"' % pad]
    found = large.shred(payload_frame(spark, docs + good + [None]), ["pid"], "json", 16)
    assert broken(found) == list(range(len(docs)))


def test_numbers_without_a_task_per_list(spark, monkeypatch):
    monkeypatch.setattr(large, "BLOCK", 10)
    rows = spark.range(100).selectExpr("id % 3 AS doc", "id * id AS at")
    got = large.numbered_rows(rows, "doc", "at").collect()
    for doc in range(3):
        assert [r.position for r in sorted((r for r in got if r.doc == doc), key=lambda r: r["at"])] == list(range(len([r for r in got if r.doc == doc])))


def test_as_many_tasks_as_ranges(spark):
    text = json.dumps({"pages": [{"id": i, "title": "t" * 50} for i in range(2000)]})
    ranges, count = large._ranges(payload_frame(spark, [text]), ["pid"], "json", 4096)
    used = ranges.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert count == -(-len(text) // 4096) == len(used) and max(r["count"] for r in used) == 1


def test_small_ranges_share_tasks():
    assert large.range_tasks(35, 4096, 4) == 35
    assert large.range_tasks(9_000, 1 << 15, 200) == 200
    assert large.range_tasks(54_000, 1 << 15, 200) == 422
    assert large.range_tasks(500, large.RANGE, 200) == 500


@pytest.mark.parametrize("few, join", [(100_000, "BroadcastHashJoin"), (1, "SortMergeJoin")])
def test_rows_stay_where_they_are_beside_few_keys(spark, monkeypatch, few, join):
    monkeypatch.setattr(large, "BROADCAST_ROWS", few)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(60).selectExpr("id % 3 AS doc", "id AS at")
        found = large.spread_join(rows, spark.range(2).selectExpr("id AS doc", "id * 10 AS x"), ["doc"], "at", "left")
        assert {tuple(r) for r in found.collect()} == {(i % 3, i, i % 3 * 10 if i % 3 < 2 else None) for i in range(60)}
        assert join in found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def row(n):
    return {"id": n, "title": "T%d %s" % (n, "é" * (n % 9))}


def listed(df):
    out = {}
    for r in df.select("pid", "position", F.to_json("record").alias("j")).collect():
        out.setdefault(r.pid, []).append((r.position, json.loads(r.j)))
    return {k: sorted(v, key=lambda x: x[0]) for k, v in out.items()}


RECORDS = [
    {"*": [{"a": {"*": [row(i) for i in range(40)]}}]},
    {"*": [{"a": {"*": [row(1)]}}, {"a": {"*": [row(i) for i in range(30)]}}, {"a": {"*": [row(i) for i in range(100, 130)]}}]},
    {"pages": [row(1), "x", *[row(i) for i in range(20)], 7], "*": [row(9)]},
    {"pages": [row(1)], "*": [row(i) for i in range(50)], "z": "y" * 300},
    {"outer": {"inner": {"rows": [row(5), 3, row(6)] * 9}, "few": [{"z": 1}] * 8}},
    {"pages": [{"other": 1}] * 40, "a": {"*": [row(4)]}, "pad": " " * 200},
    {"a": {"x": "p" * 300, "*": [row(i) for i in range(9)]}},
    {"*": [{"a": {"pad": "p" * 200, "*": [row(i) for i in range(2)]}}, {"pad": "p" * 200, "a": {"*": [row(3), row(4)]}}]},
    {"numbers": [1, 2] * 90},
    {"b": [{"x": 1}] * 30, "a": [{"x": 2}] * 30},
    {"b": [[{"x": 1}] * 3, [{"x": 2}] * 4, [{"y": 3}] * 4], "pad": "p" * 200},
    {"*": [{"x": 1}] * 20, "c": [{"x": 3}] * 20, "pages": [{"x": 2}] * 20},
    {"c": [{"x": 3}] * 2, "pages": [{"x": 2}] * 2, "pad": "p" * 300},
    "[1, 2" + " " * 300,
    [row(i) for i in range(30)],
    {"pages": [row(1), {"id": 2, "title": "long " * 90, "qid": "Q1", "in": [1] * 90}, row(3)], "*": [row(4), row(5), {"x": 6}]},
]


@pytest.mark.parametrize("size", [64])
def test_large_payloads_follow_the_rules_of_small_ones(spark, size):
    df = payload_frame(spark, RECORDS)
    whole = listed(records.extract_records(df, ["pid"], "json"))
    assert listed(records.extract_records(df, ["pid"], "json", whole=10, size=size)) == whole
    assert sorted(whole) == [0, 1, 2, 3, 4, 5, 6, 7, 9, 10, 11, 12, 14, 15]
    bad = [r.pid for r in records.rejected_payloads(df, ["pid"], "json", whole=10, size=size).collect()]
    assert sorted(bad) == [13, 14] == sorted(r.pid for r in records.rejected_payloads(df, ["pid"], "json").collect())


def test_large_results_and_piles(spark):
    rows = [["A%d" % i, i, None] if i % 3 else {"x y": i, "x_y": "é"} for i in range(40)] + ["scalar", [], ["w" * 300, 1], [1, 2, 3, 4]]
    docs = [{"headers": ["t", "t", "z"], "rows": rows}, {"rows": rows, "headers": ["h%d" % i for i in range(60)]}, {"headers": [], "rows": rows}]
    docs += [{"headers": ["a"], "rows": [[1], [2]], "pad": "p" * 300}, {"headers": ["a"], "pad": "p" * 300}, '{"headers": ["a"], "rows": [[1], ' + " " * 200]
    docs += ['{"headers": ["a", "b"], "rows": [[1, 2]]}' + " " * 900, '{"rows": [[1]]}' + " " * 900]
    df = payload_frame(spark, docs)
    for limit in (7,):
        flat = lambda d: sorted(map(str, d.select("pid", "position", F.to_json(F.to_variant_object("fields")), "row_error").collect()))
        assert flat(results.result_rows(df, ["pid"], "json", limit, whole=10, size=64)) == flat(results.result_rows(df, ["pid"], "json", limit))
    titles = [" :A b", "", "A_b", None, 7, "é"] * 20 + ["T%d" % i for i in range(30)]
    lists = [{"wiki": " EnWiki ", "pages": titles}, {"pages": titles}, {"wiki": "x", "pages": ["a", "b", "a"], "pad": "p" * 300}, {"wiki": " ", "pages": titles}]
    lists += ['{"wiki": "w", "pages": ["a", "b"]}' + " " * 900]
    df = payload_frame(spark, lists)
    for limit in (None,):
        flat = lambda d: sorted(map(tuple, d.collect()))
        assert flat(piles.read_piles(df, ["pid"], "json", limit, whole=10, size=64)) == flat(piles.read_piles(df, ["pid"], "json", limit))
