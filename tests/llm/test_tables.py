"""Sharding, BPE, mixing and WARC against brute force or the library they must agree with."""

import hashlib
import random
import struct
import zlib
from collections import defaultdict

import brute
import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from pagegraph.llm import bpe, mixing, sharding, warc
from pagegraph.llm.queries import QUERIES, vocabulary_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def odd(spark):
    """Null and empty texts, repeated rows and ids, null ids and sources, clashing extra columns."""
    data = [(1, "a b c", "en", "s1", 5), (1, "a b c", "en", "s1", 5), (2, None, None, None, None), (3, "", "en", "s2", 0)]
    data += [(None, "x y", "en", "s2", 3), (4, " \t\n ", "en", "s2", 4), (5, "w " * 3000, "en", "s1", 6000), (1, "other text", "en", "s3", 10)]
    df = spark.createDataFrame(data, DOCS)
    return df.withColumns({"shard": F.lit("x"), "size": F.lit("y"), "token_ids": F.lit(1), "n_tokens": F.lit("z"), "target": F.lit(0)})


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000, 4097])
def test_feistel_is_a_permutation(n):
    f = sharding.Feistel(n, seed=9)
    at = f.position(np.arange(n))
    assert sorted(at) == list(range(n))
    assert (f.row(at) == np.arange(n)).all()


def test_sharding_query(spark, tables):
    texts = dict(tables("documents", "doc_id", "text"))
    found = QUERIES["op2_sharding"](spark, SF).collect()
    n, slots = len(texts), defaultdict(list)
    assert len(found) == n
    order = {i: k for k, i in enumerate(sorted(texts))}
    for r in found:
        raw = (texts[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
        assert (r.shard, r.slot) == sharding.place(order[r.doc_id], n, 16)
        assert sharding.row_at(r.shard, r.slot, n, 16) == order[r.doc_id]
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_sharding_edges(spark, odd):
    found = sharding.shard_rows(odd, 3, "doc_id", "text").collect()
    assert sorted((r.shard, r.slot) for r in found) == [(s, k) for s, c in ((0, 3), (1, 3), (2, 2)) for k in range(c)]
    assert sharding.shard_rows(odd.where("false"), 3, "doc_id").count() == 0


def test_bpe_query(spark, tables, rows):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary_path())
    expected = []
    for i, text in tables("documents", "doc_id", "text"):
        ids = library.encode(text or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        expected.append((i, len(ids), hashlib.sha256(struct.pack("<%dI" % len(ids), *ids)).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    assert sorted(rows(QUERIES["op3_bpe"](spark, SF))) == sorted(expected)


def test_bpe_agrees_on_odd_texts():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary_path())
    own = bpe.ByteBpe(open(vocabulary_path(), encoding="utf-8").read())
    rng = random.Random(1)
    chars = "ab '’stre\t\n\r\x0b\x0c\x1c\x1f\x85\xa0  ​　é漢字🙂١Ⅷ½_-<|>́\x00"
    texts = ["", "a" * 20000, "<|endoftext|>", "x<|endoftext|><|endoftext|> y", "it's  we'll'", "᠎﻿", " " * 300 + "z"]
    texts += ["".join(rng.choice(chars) for _ in range(rng.randint(1, 60))) for _ in range(1500)]
    for text in texts:
        ids = library.encode(text, add_special_tokens=False).ids
        packed = own.encode(text)
        assert list(struct.unpack("<%dI" % (len(packed) // 4), packed)) == ids, repr(text)
        assert own.decode(packed) == library.decode(ids, skip_special_tokens=False)
    cut = struct.pack("<3I", *[own.byte_ids[b] for b in "漢".encode()[:2]], own.byte_ids[65])
    assert own.decode(cut) == library.decode(list(struct.unpack("<3I", cut)), skip_special_tokens=False)


def test_bpe_edges(spark, odd):
    coded = bpe.encode_texts(odd, vocabulary_path())
    back = bpe.decode_texts(coded, vocabulary_path())
    got = {(r.doc_id, r.decoded): r.n_tokens for r in back.collect()}
    assert got[2, ""] == 0 and got[3, ""] == 0 and got[1, "a b c"] == 3
    assert bpe.encode_texts(odd.where("false"), vocabulary_path()).count() == 0


def test_mixing_query(spark, tables):
    docs = tables("documents", "doc_id", "text", "source")
    size = {i: len(brute.word_list(t)) for i, t, _ in docs}
    sources = defaultdict(int)
    for i, _, s in docs:
        sources[s] += size[i]
    target, taken = brute.targets(sources), defaultdict(int)
    source = {i: s for i, _, s in docs}
    found = QUERIES["op5_mixing"](spark, SF).collect()
    assert len(found) == len(docs)
    for r in found:
        s = source[r.doc_id]
        assert (r["size"], r.source_size) == (size[r.doc_id], sources[s])
        assert r.target == pytest.approx(target[s])
        assert r.taken <= 3 * r["size"]
        taken[s] += r.taken
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in sources)
    again = {r.doc_id: r.taken for r in QUERIES["op5_mixing"](spark, SF).collect()}
    assert again == {r.doc_id: r.taken for r in found}


def test_mixing_stops_at_most(spark):
    data = [(i, "w " * (1 if s == "b" else 400), "en", s, 0) for i, s in enumerate("aaaabcccccccc")]
    found = mixing.taken_words(spark.createDataFrame(data, DOCS)).collect()
    expected = brute.targets({"a": 1600, "b": 1, "c": 3200})
    assert {r.doc_id: r.taken for r in found}[4] == 3
    assert sum(r.taken for r in found) == pytest.approx(4801, abs=1)
    assert {round(r.target, 6) for r in found} == {round(t, 6) for t in expected.values()}


def test_mix_slots_are_gapless_and_spread(spark, tables):
    df = spark.read.parquet(SF + "/documents.parquet")
    pieces = mixing.mix_blocks(df, block=64).collect()
    words = defaultdict(int)
    for p in pieces:
        words[p.slot] += p.words
        assert 0 <= p.first_word and p.first_word + p.words <= p["size"]
    assert max(words.values()) <= 64
    first = sorted({(p.slot, p.source) for p in pieces})[: len(words) // 2]
    share = defaultdict(int)
    for _, s in first:
        share[s] += 1
    targets = {p.source: p.target for p in pieces}
    total = sum(targets.values())
    assert all(abs(share[s] / len(first) - t / total) < 0.02 for s, t in targets.items())


def test_mixing_edges(spark, odd):
    found = mixing.taken_words(odd).collect()
    assert len(found) == odd.count()
    assert all(r.taken <= 3 * r["size"] for r in found)
    same = sorted(r.taken for r in found if r.doc_id == 1 and r["size"] == 3)
    assert len(same) == 2 and same[1] - same[0] <= 3
    assert mixing.taken_words(odd.where("false")).count() == 0
    out = mixing.mixed_documents(odd)
    assert out.columns == odd.columns
    words = {r.doc_id: 0 for r in found}
    for r in out.collect():
        words[r.doc_id] += len(brute.word_list(r.text))
    taken = {i: sum(r.taken for r in found if r.doc_id == i) for i in words}
    assert words == taken


def test_warc_query(spark, tables, rows):
    assert rows(QUERIES["op8_warc"](spark, SF)) == brute.warc(tables("pages", "page_id", "html"))


def test_warc_segments_and_edges(spark, rows, tmp_path):
    border = warc.BORDER.decode()
    data = [(1, "u", "é" * 500), (2, None, "é" * 500), (3, "u\r\nX: y", None), (4, "u", ""), (5, "u", "short"), (6, "u", "short")]
    data += [(7, "u", "a" + border * 3 + "b\r\n\r\n"), (8, "u", "z" * 1999), (9, "u", "z" * 1999), (9, "u", "z" * 1999), (10, "", border)]
    df = spark.createDataFrame(data, "page_id long, url string, html string").withColumn("refers_to", F.lit(3)).withColumn("chunk_no", F.lit("c"))
    warc.write_archive(df, str(tmp_path / "w"), size=64)
    blocks = warc.read_archive(spark, str(tmp_path / "w"))
    assert max(len(r.chunk) for r in blocks.collect()) <= 64
    assert rows(warc.archived_payloads(blocks)) == brute.warc([(i, h) for i, _, h in data])
    warc.write_archive(df.where("false"), str(tmp_path / "e"))
    assert warc.archived_payloads(warc.read_archive(spark, str(tmp_path / "e"))).count() == 0


def test_warc_null_ids(spark, rows, tmp_path):
    df = spark.createDataFrame([(None, "u", "q" * 200), (5, "u", "q" * 200), (7, "u", "q" * 200)], "page_id long, url string, html string")
    warc.write_archive(df, str(tmp_path / "n"))
    got = rows(warc.archived_payloads(warc.read_archive(spark, str(tmp_path / "n"))), "page_id", "record_type", "refers_to")
    assert got == sorted([(5, "response", None), (7, "revisit", 5), (None, "revisit", 5)], key=str)
