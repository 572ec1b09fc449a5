"""Variable-capacity best-fit packing of whole texts into training sequences.

Several sequence lengths are permitted at once.  Pieces are placed longest first, each into the open bin
that it leaves least room in.  Where none has room, the piece opens a bin of the size with the least
cost, ``size + OVERHEAD * expected idle share``: sizes are compared by the idle tokens that the shorter
pieces still to come are expected to leave in them, which the length counts of the shard tell exactly
(all sizes are weighed against the same remaining pieces).  At the end every bin is downsized to the
smallest permitted length that holds its contents.

A text longer than the largest size is cut into pieces of that size and a rest, in order; nothing is
dropped.  Lengths are counts of words.  Packing works on (length, row) alone.  Rows are dealt into shards of
about SHARD pieces by a digest, each shard is packed by itself, so one task holds a bounded number of
pieces whatever the size of the table; bins do not cross shards, which costs at most the last bins of
each.

A null text, an empty one and one without words has no tokens and is placed nowhere: its row has piece 0,
length 0 and null bin and capacity.  Repeated rows are packed one by one.  Extra columns are ignored.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from tagloom.llm.staging import staged

SIZES = (512, 1024, 2048, 4096)
SHARD = 50_000
#: how much of a bin's expected idle room counts against a larger size
OVERHEAD = 1.0


class OpenBins:
    """Open bins by free room: the least room that is enough is found by a bit search."""

    def __init__(self, largest: int) -> None:
        self.bins: list[list[int]] = [[] for _ in range(largest + 1)]
        self.bits = 0

    def put(self, room: int, bin_: int) -> None:
        if room:
            self.bins[room].append(bin_)
            self.bits |= 1 << room

    def take(self, need: int) -> tuple[int, int] | None:
        """The fullest bin with room for ``need``, the latest opened of equals."""
        above = self.bits >> need
        if not above:
            return None
        room = need + (above & -above).bit_length() - 1
        found = self.bins[room].pop()
        if not self.bins[room]:
            self.bits &= ~(1 << room)
        return room, found


def idle_after(size: int, first: int, left: np.ndarray) -> int:
    """Tokens left idle when a bin of ``size`` opened by ``first`` is filled greedily from the lengths left."""
    room, limit = size - first, first
    taken: dict[int, int] = {}
    while room > 0:
        fit = np.flatnonzero(left[1:min(room, limit) + 1]) + 1
        while len(fit) and left[fit[-1]] <= taken.get(int(fit[-1]), 0):
            fit = fit[:-1]
        if not len(fit):
            break
        length = int(fit[-1])
        taken[length] = taken.get(length, 0) + 1
        room -= length
        limit = length
    return room


def best_size(first: int, left: np.ndarray, sizes: tuple[int, ...]) -> int:
    """The size with the least cost for each token it would hold; ties go to the larger one."""
    costs = []
    for size in sizes:
        if size >= first:
            idle = idle_after(size, first, left)
            costs.append(((size + OVERHEAD * idle) / (size - idle), -size))
    return -min(costs)[1]


def pack(lengths: np.ndarray, sizes: tuple[int, ...] = SIZES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin, offset in the bin and final capacity of each piece (lengths from 1 to the largest size)."""
    largest = max(sizes)
    order = np.argsort(-lengths, kind="stable")
    left = np.bincount(lengths, minlength=largest + 1)
    open_ = OpenBins(largest)
    bin_of, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    used: list[int] = []
    chosen: dict[tuple[int, int], int] = {}
    for i in order.tolist():
        n = int(lengths[i])
        left[n] -= 1
        found = open_.take(n)
        if found is None:
            # the choice depends on the lengths left; it is worked out anew for every 64 pieces of one length
            key = (n, int(left[n]) // 64)
            if key not in chosen:
                chosen[key] = best_size(n, left, sizes)
            room, bin_ = chosen[key], len(used)
            used.append(0)
        else:
            room, bin_ = found
        bin_of[i], offset[i] = bin_, used[bin_]
        used[bin_] += n
        open_.put(room - n, bin_)
    ranked = np.array(sorted(sizes))
    capacity = ranked[np.searchsorted(ranked, np.array(used, np.int64))] if used else np.zeros(0, np.int64)
    return bin_of, offset, capacity[bin_of]


_PLACED = StructType([StructField("doc_id", LongType()), StructField("piece", LongType()), StructField("length", LongType()),
                      StructField("bin_id", LongType()), StructField("offset", LongType()), StructField("capacity", LongType())])


def packed(docs: DataFrame, sizes: tuple[int, ...] = SIZES) -> DataFrame:
    """Per piece of ``docs`` (``doc_id, text``): ``doc_id, piece, length, bin_id, offset, capacity``."""
    largest = max(sizes)
    words = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    rows = staged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), words.alias("words"))
                  .withColumn("row", F.monotonically_increasing_id()))
    many = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("words") / largest).cast("long"))
    pieces = (rows.select("doc_id", "row", "words", F.explode(F.sequence(F.lit(0).cast("long"), many - 1)).alias("piece"))
              .withColumn("length", F.least(F.lit(largest).cast("long"), F.col("words") - F.col("piece") * largest)))
    full = pieces.where("length > 0")
    shards = max(1, ceil(full.count() / SHARD))
    dealt = full.withColumn("shard", F.pmod(F.xxhash64("row", "piece"), F.lit(shards)).cast(IntegerType()))

    def run(table: pa.Table) -> pa.Table:
        length = table["length"].to_numpy()
        bin_, offset, capacity = pack(length, sizes)
        # a bin's number: its shard, then its place there
        number = table["shard"].to_numpy().astype(np.int64) * (SHARD * 4) + bin_
        return pa.table({"doc_id": table["doc_id"], "piece": table["piece"], "length": table["length"],
                         "bin_id": pa.array(number), "offset": pa.array(offset), "capacity": pa.array(capacity.astype(np.int64))})

    def ordered(key: tuple, table: pa.Table) -> pa.Table:
        return run(table.sort_by([("row", "ascending"), ("piece", "ascending")]))

    placed = dealt.groupBy("shard").applyInArrow(ordered, _PLACED)
    none = F.lit(None).cast("long")
    empty = pieces.where("length = 0").select("doc_id", "piece", "length", none.alias("bin_id"), none.alias("offset"), none.alias("capacity"))
    return placed.union(empty)
