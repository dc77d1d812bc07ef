"""Byte-level BPE: merges by rank over a linked symbol list, and decoding from vocabulary strings."""

from __future__ import annotations

import heapq
import json
from array import array
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagegraph.llm.common import in_small_batches

# Fixed values of the byte-level format: the split pattern, and the code points that stand for bytes
# (printable Latin-1 for itself, the other bytes from 256 on in order).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]

#: pieces whose ids a task remembers
REMEMBERED = 100_000


def byte_characters() -> dict[str, int]:
    """Byte of each stand-in character."""
    table = {chr(b): b for b in PRINTABLE}
    others = [b for b in range(256) if chr(b) not in table]
    return table | {chr(256 + i): b for i, b in enumerate(others)}


class ByteBpe:
    """Encoder and decoder for one tokenizer description (JSON text of the tokenizers format)."""

    def __init__(self, description: str):
        spec = json.loads(description)
        model, self.added = spec["model"], {t["content"]: t["id"] for t in spec["added_tokens"]}
        if spec["normalizer"] or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("only byte-level vocabularies without normalizer and prefix space are supported")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that strip or match whole words are not supported")
        to_byte = byte_characters()
        vocab = model["vocab"]
        self.byte_ids = [0] * 256
        for char, byte in to_byte.items():
            self.byte_ids[byte] = vocab[char]
        self.merges = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[vocab[left], vocab[right]] = (rank, vocab[left + right])
        self.strings = [b""] * (1 + max([*vocab.values(), *self.added.values()]))
        for token, i in [*vocab.items(), *self.added.items()]:
            known = all(c in to_byte for c in token)
            self.strings[i] = bytes(to_byte[c] for c in token) if known else token.encode()
        self.pattern = regex.compile(PATTERN)
        specials = sorted(self.added, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, specials)) + ")") if specials else None
        self.known: dict[str, bytes] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece.

        The queue holds (rank, place, merged id, left id, right id) of neighbouring symbols, leftmost
        first among equal ranks. A popped entry is stale, and skipped, if its symbols have changed since.
        """
        ids = [self.byte_ids[b] for b in piece]
        n = len(ids)
        if n < 2:
            return ids
        merges = self.merges
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        queue = []
        for i in range(n - 1):
            if found := merges.get((ids[i], ids[i + 1])):
                queue.append((found[0], i, found[1], ids[i], ids[i + 1]))
        heapq.heapify(queue)
        while queue:
            _, i, merged, left, right = heapq.heappop(queue)
            j = after[i]
            if ids[i] != left or j >= n or ids[j] != right:
                continue
            ids[i], ids[j] = merged, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if found := merges.get((merged, ids[k])):
                    heapq.heappush(queue, (found[0], i, found[1], merged, ids[k]))
            h = before[i]
            if h >= 0 and (found := merges.get((ids[h], merged))):
                heapq.heappush(queue, (found[0], h, found[1], ids[h], merged))
        return [i for i in ids if i >= 0]

    def _piece(self, piece: str) -> bytes:
        found = self.known.get(piece)
        if found is None:
            found = array("I", self.merge(piece.encode("utf-8", "replace"))).tobytes()
            if len(piece) < 40:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                self.known[piece] = found
        return found

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; strings of added tokens become their ids."""
        parts = self.special.split(text) if self.special else [text]
        out = []
        for i, part in enumerate(parts):
            if i % 2:
                out.append(array("I", [self.added[part]]).tobytes())
            else:
                out.extend(map(self._piece, self.pattern.findall(part)))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """Vocabulary strings one after another; bytes that are not UTF-8 become U+FFFD."""
        numbers = array("I")
        numbers.frombytes(ids)
        return b"".join(map(self.strings.__getitem__, numbers)).decode("utf-8", "replace")


def _shared(df: DataFrame, path: str):
    """The vocabulary file, read once on the driver; its size is that of one vocabulary, not of the data."""
    with open(path, encoding="utf-8") as file:
        return df.sparkSession.sparkContext.broadcast({"description": file.read()})


def _built(shared) -> ByteBpe:
    """The tokenizer of this worker; it stays with the broadcast value from task to task."""
    state = shared.value
    if "bpe" not in state:
        state["bpe"] = ByteBpe(state["description"])
    return state["bpe"]


def encoder(df: DataFrame, path: str):
    """Column function text -> packed ids (binary). Null and empty texts give no ids."""
    shared = _shared(in_small_batches(df), path)

    @F.pandas_udf("binary")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = _built(shared)
        for batch in batches:
            yield pd.Series([bpe.encode(t or "") for t in batch], dtype=object)

    return encode


def decoder(df: DataFrame, path: str):
    """Column function packed ids -> text. Null ids give an empty text."""
    shared = _shared(in_small_batches(df), path)

    @F.pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = _built(shared)
        for batch in batches:
            yield pd.Series([bpe.decode(t or b"") for t in batch], dtype=object)

    return decode


def coder(df: DataFrame, path: str):
    """Column function text -> struct of packed ids and the text they decode to, in one pass over the rows."""
    shared = _shared(in_small_batches(df), path)

    @F.pandas_udf("token_ids binary, decoded string")
    def code(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        bpe = _built(shared)
        for batch in batches:
            ids = [bpe.encode(t or "") for t in batch]
            yield pd.DataFrame({"token_ids": pd.Series(ids, dtype=object), "decoded": pd.Series([bpe.decode(i) for i in ids], dtype=object)})

    return code


def encode_texts(df: DataFrame, path: str, text: str = "text", ids: str = "token_ids", count: str = "n_tokens") -> DataFrame:
    """Add packed ids (little-endian unsigned 32 bit) and their number for every whole text.

    Null and empty texts have no tokens. Each row is encoded on its own, so repeated rows repeat their
    ids and an empty frame stays empty; columns already named ``ids`` or ``count`` are replaced.
    """
    out = df.withColumn(ids, encoder(df, path)(F.col(text)))
    return out.withColumn(count, F.floor(F.octet_length(ids) / 4))


def decode_texts(df: DataFrame, path: str, ids: str = "token_ids", text: str = "decoded") -> DataFrame:
    """Add the text of packed ids; a column already named ``text`` is replaced."""
    return df.withColumn(text, decoder(df, path)(F.col(ids)))


def round_trip(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Add ``token_ids``, ``n_tokens`` and ``decoded`` in one pass; columns of these names are replaced."""
    out = df.withColumn("_coded", coder(df, path)(F.col(text)))
    out = out.withColumns({"token_ids": F.col("_coded.token_ids"), "decoded": F.col("_coded.decoded")}).drop("_coded")
    return out.withColumn("n_tokens", F.floor(F.octet_length("token_ids") / 4))
