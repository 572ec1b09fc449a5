"""Fill-in-the-middle: whole texts cut into prefix, middle and suffix between lines, and put in another order.

A text's bytes are dealt into blocks of BLOCK bytes.  A Fenwick tree over the blocks holds how many units
(lines) end in each, and how many code points begin there.  A cut after unit k is found by binary lifting:
the descent adds whole subtrees while fewer than k units end in them, so it stops before the block in which
the k-th unit ends, and it has counted the code points up to there on the way.  Only that block is searched.
Trees are built in one pass over a text, and every cut costs the logarithm of its blocks.

Units are ``[^\\n]*\\n|[^\\n]+``.  Which cuts and which order a document gets depends on the digest of a seed
and its id alone, so a retried task gives the same rows.

Null texts count as empty; empty texts and texts with one of the marks are left as they are (`plain`).  A
null doc_id draws as an empty one.  Repeated rows give repeated results.  Extra columns are ignored, and an
empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import LongType, StringType, StructField, StructType

BLOCK = 1024
#: marks before the prefix, the suffix and the middle
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"


@dataclass
class Cuts:
    """Fenwick trees over the blocks of one text; place i covers the blocks (i - lowest bit of i, i]."""

    data: np.ndarray
    units: np.ndarray
    chars: np.ndarray
    n: int

    @classmethod
    def of(cls, data: np.ndarray) -> Cuts:
        starts = np.arange(0, len(data), BLOCK)
        ends = np.add.reduceat(data == 10, starts, dtype=np.int64)
        begins = np.add.reduceat((data & 0xC0) != 0x80, starts, dtype=np.int64)
        trees = np.zeros((2, len(starts) + 1), np.int64)
        trees[:, 1:] = ends, begins
        step = 1
        while 2 * step <= len(starts):
            at = np.arange(2 * step, len(starts) + 1, 2 * step)
            trees[:, at] += trees[:, at - step]
            step *= 2
        return cls(data, trees[0], trees[1], int(ends.sum()) + int(data[-1] != 10))

    def after(self, k: int) -> tuple[int, int]:
        """Bytes and code points before the end of unit ``k`` (1 to n); none for 0."""
        block = units = chars = 0
        step = 1 << (len(self.units) - 1).bit_length()
        while step:
            to = block + step
            if to < len(self.units) and units + self.units[to] < k:
                block, units, chars = to, units + int(self.units[to]), chars + int(self.chars[to])
            step >>= 1
        if k == 0 or block == len(self.units) - 1:  # the last unit of a text without a final line feed ends past every block
            return (len(self.data), chars) if k else (0, 0)
        local = self.data[block * BLOCK:(block + 1) * BLOCK]
        to = int(np.flatnonzero(local == 10)[k - units - 1]) + 1
        return block * BLOCK + to, chars + int(np.count_nonzero((local[:to] & 0xC0) != 0x80))


def rearranged(text: bytes, form: str, a: int, b: int) -> tuple[int, str, int | None, int | None, bytes]:
    """Units, form, code points of prefix and middle, and the output; ``a`` and ``b`` choose the cuts."""
    if not text:
        return 0, "plain", None, None, text
    cuts = Cuts.of(np.frombuffer(text, np.uint8))
    if form == "plain" or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return cuts.n, "plain", None, None, text
    first, second = sorted((a % (cuts.n + 1), b % (cuts.n + 1)))
    (x, x_chars), (y, y_chars) = cuts.after(first), cuts.after(second)
    prefix, middle, suffix = text[:x], text[x:y], text[y:]
    if form == "psm":
        out = b"".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))
    else:
        out = b"".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))
    return cuts.n, form, x_chars, y_chars - x_chars, out


_ROW = StructType([StructField("n", LongType()), StructField("form", StringType()), StructField("prefix_chars", LongType()),
                   StructField("middle_chars", LongType()), StructField("output", StringType())])


def _rows(texts: pa.Array, forms: pa.Array, a: pa.Array, b: pa.Array) -> pa.Array:
    raw = texts.cast(pa.binary()).to_pylist() if len(texts) else []
    rows = [rearranged(t or b"", *x) for t, *x in zip(raw, forms.to_pylist(), a.to_pylist(), b.to_pylist(), strict=True)]
    cols = list(zip(*rows, strict=True)) if rows else [()] * 5
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64()]
    out = pa.array(cols[4], pa.binary()).cast(pa.string())
    return pa.StructArray.from_arrays([*(pa.array(c, t) for c, t in zip(cols, types, strict=False)), out], _ROW.names)


def transformed(docs: DataFrame, rate: int = 100, spm: int = 50, seed: int = 7) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` per row of ``docs`` (``doc_id, text``).

    ``rate`` percent of the documents are rearranged, ``spm`` percent of these with the suffix first.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)

    def draw(i: int) -> Column:
        return F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long")

    form = F.when(draw(2) % 100 >= rate, "plain").when(draw(3) % 100 < spm, "spm").otherwise("psm")
    row = arrow_udf(_rows, _ROW)(F.col("text"), form, draw(0), draw(1))
    return docs.select("doc_id", row.alias("row")).select("doc_id", "row.*")


def restored(output: Column, form: Column) -> Column:
    """The text that an output of `transformed` was made of.

    The text holds no mark, and a mark cannot begin inside another, so splitting at the marks gives the parts.
    """
    parts = F.split(output, "<[PSM]>", -1)
    return (F.when(form == "psm", F.concat(parts[1], parts[3], parts[2]))
            .when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(output))
