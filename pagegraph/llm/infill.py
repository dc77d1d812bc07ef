"""Fill-in-middle: a text cut at two unit borders and put together again with its middle last.

The borders are found through a Fenwick tree over fixed blocks of the text, not by a list of its units.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagegraph.llm.common import in_small_batches

#: bytes of a block
BLOCK = 4096
#: marks of the prefix, suffix and middle
MARKS = ("<P>", "<S>", "<M>")
OUT = "id {}, n long, form string, prefix_chars long, middle_chars long, output string"


def unit_ends(raw: np.ndarray, unit: str) -> np.ndarray:
    """Per byte: does a unit surely end with it? The end of the text ends the last one."""
    if unit == "line":
        return raw == 10
    if unit == "char":
        ends = np.ones(len(raw), bool)
        ends[:-1] = (raw[1:] & 0xC0) != 0x80
        return ends
    raise ValueError("unit must be 'line' or 'char', not {!r}".format(unit))


class Fenwick:
    """Prefix sums over blocks of two counts at once: ends of units and code points.

    ``tree[i]`` holds the sums of the ``i & -i`` blocks up to block ``i`` (from 1).
    """

    def __init__(self, counts: np.ndarray):
        size = len(counts)
        self.size = size
        self.tree = np.zeros((size + 1, 2), np.int64)
        self.tree[1:] = counts
        step = 1
        while step <= size:
            at = np.arange(2 * step, size + 1, 2 * step)
            self.tree[at] += self.tree[at - step]
            step *= 2

    def total(self) -> tuple[int, int]:
        at, units, chars = self.size, 0, 0
        while at:
            units, chars, at = units + int(self.tree[at, 0]), chars + int(self.tree[at, 1]), at & (at - 1)
        return units, chars

    def descend(self, k: int) -> tuple[int, int, int]:
        """Block that holds the k-th end of a unit (k from 1), and the ends and code points before it.

        Binary lifting: from the greatest power of two down, a step is taken while fewer than k ends
        lie before it.
        """
        at, units, chars = 0, 0, 0
        step = 1 << self.size.bit_length()
        while step:
            ahead = at + step
            if ahead <= self.size and units + int(self.tree[ahead, 0]) < k:
                units, chars, at = units + int(self.tree[ahead, 0]), chars + int(self.tree[ahead, 1]), ahead
            step >>= 1
        return at, units, chars


class UnitIndex:
    """Unit borders of one text (UTF-8), by blocks of ``block`` bytes."""

    def __init__(self, raw: bytes | pa.Buffer, unit: str, block: int = BLOCK):
        self.raw, self.unit, self.block = np.frombuffer(raw, np.uint8), unit, block
        blocks = -(-len(self.raw) // block)
        counts = np.zeros((blocks, 2), np.int64)
        for b in range(blocks):
            own = self._block(b)
            counts[b] = np.count_nonzero(self._ends(b)), np.count_nonzero((own & 0xC0) != 0x80)
        self.tree = Fenwick(counts)
        self.ends, self.chars = self.tree.total()
        open_end = bool(len(self.raw)) and unit == "line" and self.raw[-1] != 10
        self.units = self.ends + open_end

    def _block(self, b: int) -> np.ndarray:
        return self.raw[b * self.block : (b + 1) * self.block]

    def _ends(self, b: int) -> np.ndarray:
        """Ends inside block ``b``; one byte of the next block tells about the last."""
        start = b * self.block
        return unit_ends(self.raw[start : start + self.block + 1], self.unit)[: self.block]

    def border(self, k: int) -> tuple[int, int]:
        """Byte and code point at which the first ``k`` units end."""
        if k <= 0:
            return 0, 0
        if k > self.ends:
            return len(self.raw), self.chars
        b, units, chars = self.tree.descend(k)
        place = int(np.flatnonzero(self._ends(b))[k - units - 1]) + 1
        own = self._block(b)[:place]
        return b * self.block + place, chars + int(np.count_nonzero((own & 0xC0) != 0x80))


def draws(ident: Column, seed: str) -> list[Column]:
    """Four unsigned 32-bit numbers of an id: the first groups of eight digits of sha256 of ``seed`` and the id."""
    digest = F.sha2(F.concat(F.lit(seed), F.coalesce(ident.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(
    docs: DataFrame,
    ident: str = "doc_id",
    text: str = "text",
    unit: str = "line",
    rate: int = 100,
    suffix_first: int = 50,
    seed: str = "7:",
    marks: tuple[str, str, str] = MARKS,
) -> DataFrame:
    """Texts rearranged for infilling: ``id, n, form, prefix_chars, middle_chars, output``, a row per row.

    A text of ``n`` units (lines with their newline, or code points) is cut after two numbers of units
    that its id decides. Form ``psm`` is prefix, suffix, middle; ``spm`` (``suffix_first`` of 100) is
    suffix, prefix, middle, each behind its mark. A text that is empty or holds a mark, and those that
    ``rate`` of 100 leaves out, stay ``plain`` with null lengths. Null texts are empty, a null id counts
    as the empty id, so rows that repeat an id are cut at the same draws; other columns are not read.

    A text is never split into a list of units: blocks are counted, two descents find the blocks of the
    borders. Memory is a few copies of the text of one row, whatever its number of units; texts are
    bounded by Spark's own 2 GiB of a cell.
    """
    p, s, m = marks
    h = draws(F.col(ident), seed)
    whole = F.coalesce(F.col(text), F.lit(""))
    held = [F.contains(whole, F.lit(x)) for x in marks]
    plain = (whole == "") | held[0] | held[1] | held[2] | (h[2] % 100 >= rate)
    form = F.when(plain, "plain").when(h[3] % 100 < suffix_first, "spm").otherwise("psm")
    kind = docs.schema[ident].dataType.simpleString()
    rows = docs.select(F.col(ident).alias("id"), whole.alias("text"), form.alias("form"), h[0].alias("h1"), h[1].alias("h2"))
    schema = OUT.format(kind)
    p, s, m = (x.encode() for x in marks)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {"n": [], "prefix": [], "middle": [], "output": []}
            for cell, how, h1, h2 in zip(batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                raw = cell.as_buffer()
                index = UnitIndex(raw, unit)
                n = index.units
                out["n"].append(n)
                if how == "plain":
                    out["prefix"].append(None)
                    out["middle"].append(None)
                    out["output"].append(raw.to_pybytes())
                    continue
                first, last = sorted((h1 % (n + 1), h2 % (n + 1)))
                (a, before), (b, until) = index.border(first), index.border(last)
                pieces = memoryview(raw)
                prefix, middle, suffix = pieces[:a], pieces[a:b], pieces[b:]
                out["prefix"].append(before)
                out["middle"].append(until - before)
                out["output"].append(b"".join((p, prefix, s, suffix, m, middle) if how == "psm" else (s, suffix, p, prefix, m, middle)))
            cols = [batch.column(0), pa.array(out["n"], pa.int64()), batch.column(2), pa.array(out["prefix"], pa.int64())]
            cols += [pa.array(out["middle"], pa.int64()), pa.array(out["output"], pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return in_small_batches(rows).mapInArrow(cut, schema)


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text again, from the rearranged one and its form: every mark stands in it once."""
    p, s, m = (F.lit(x) for x in marks)
    middle = F.substring_index(output, marks[2], -1)
    front = F.substring_index(output, marks[2], 1)
    behind = lambda part, mark: F.replace(part, mark, F.lit(""))
    psm = F.concat(behind(F.substring_index(front, marks[1], 1), p), middle, F.substring_index(front, marks[1], -1))
    spm = F.concat(F.substring_index(front, marks[0], -1), middle, behind(F.substring_index(front, marks[0], 1), s))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
