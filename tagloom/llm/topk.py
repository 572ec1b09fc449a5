"""Exact top-k by inner product: products of matrices, leaf by leaf of a ball tree.

Vectors are put into shards of about SHARD rows by a digest of the id, queries into blocks of about
BLOCK rows; both are packed into one matrix per row, of the narrowest integers that hold it.  A unit of work is
a shard and GROUP blocks, so that a shard travels once for all of them.  In a shard every leaf of the ball tree
has a centre and a radius; the inner product of a query with any member is at most  q . centre + |q| * radius.  A leaf
is multiplied with the queries whose bound is not below their current kth score, all at once.

Shards are searched in waves.  The first wave takes one shard per block; its kth scores travel with
the blocks into the second wave, where all other shards start from them, so that few products have to be looked at.
Each (shard, query) returns at most k rows, and the best k of them are taken by a window.

Components are integers, floor(64 * x), held at +-2^62; scores are exact: in float32 while they stay below 2^24, in
float64 below 2^53, else in Python integers, held at the bounds of a long.  Ties go to the smaller id.

Vectors that are null, empty or hold a null or non-finite component take no part, rows with a null id
neither.  Vectors are compared with those of the same length.  Equal vectors and rows with equal ids
are candidates one by one; a query never meets rows of its own id.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

from tagloom.llm.staging import staged

#: rows of a shard; of long vectors fewer, so that a shard has not more than CELLS components
SHARD, CELLS = 32768, 1 << 21
BLOCK = 2048
#: blocks that meet a shard in one unit
GROUP = 8
LEAF = 1024
#: queries that are multiplied with a leaf at a time
STEP = 512


class BallTree:
    """Nodes in arrays; leaves are stretches of the reordered rows."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, kind: type = float) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.rows = ids[order], rows[order].astype(kind)
        self.low, self.high, self.centre, self.radius = [], [], [], []
        if len(ids):
            self._split(np.arange(len(ids)))
        self.centre = np.array(self.centre, float).reshape(-1, rows.shape[1])
        self.radius = np.array(self.radius)

    def _split(self, members: np.ndarray) -> None:
        """Build without recursion; members are halved along the widest spread, and stay in order of their ids in a leaf."""
        todo, leaves = [members], []
        while todo:
            some = todo.pop()
            part = self.rows[some]
            centre = part.mean(axis=0, dtype=float)
            gap = np.sqrt(((part - centre) ** 2).sum(axis=1))
            if len(some) <= LEAF or gap.max() == 0:
                leaves.append(np.sort(some))
                self.centre.append(centre), self.radius.append(float(gap.max()))
                continue
            far = part[int(gap.argmax())]
            other = part[int(((part - far) ** 2).sum(axis=1).argmax())]
            along = part @ (far - other)
            middle = len(some) // 2
            order = np.argpartition(along, middle)
            todo += [some[order[:middle]], some[order[middle:]]]
        ends = np.cumsum([len(some) for some in leaves])
        self.low, self.high = [0, *ends[:-1].tolist()], ends.tolist()
        order = np.concatenate(leaves)
        self.ids, self.rows = self.ids[order], self.rows[order]

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query (its place), score and id of up to k best rows of each query, of score >= ``least``, without rows of the id ``own``."""
        if not len(self.ids) or not len(queries):
            return np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        whole = queries.astype(float)
        bounds = whole @ self.centre.T + np.sqrt((whole ** 2).sum(axis=1))[:, None] * self.radius
        bounds += 1e-9 * (1 + np.abs(bounds))
        queries = queries.astype(self.rows.dtype)
        floor, best = least.astype(float), np.full((len(queries), k), -np.inf)
        found = [(np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))]
        for leaf in np.argsort(-bounds.max(axis=0), kind="stable").tolist():
            rows, ids = self.rows[self.low[leaf]:self.high[leaf]], self.ids[self.low[leaf]:self.high[leaf]]
            able = np.flatnonzero(bounds[:, leaf] >= floor)
            for at in range(0, len(able), STEP):
                some = able[at:at + STEP]
                score = queries[some] @ rows.T
                first, last = np.searchsorted(ids, own[some]), np.searchsorted(ids, own[some], "right")
                for i in np.flatnonzero(last > first).tolist():
                    score[i, first[i]:last[i]] = -np.inf
                good = score >= np.maximum(floor[some], np.finfo(score.dtype).min)[:, None].astype(score.dtype)
                many = np.flatnonzero(np.count_nonzero(good, axis=1) > k)
                if len(many):  # only the k best of the leaf matter; the kth of all so far is a limit from now on
                    top = np.partition(score[many], -k, axis=1)[:, -k:]
                    good[many] = score[many] >= top.min(axis=1)[:, None]
                    best[some[many]] = np.partition(np.concatenate((best[some[many]], top), axis=1), -k, axis=1)[:, -k:]
                    floor[some[many]] = np.maximum(floor[some[many]], best[some[many]].min(axis=1))
                i, j = np.nonzero(good)
                found.append(_first(some[i], score[i, j].astype(float), ids[j], k))
        return _first(*(np.concatenate(c) for c in zip(*found, strict=True)), k)


def _first(query: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query, ties to the smaller id."""
    order = np.lexsort((ids, -score, query))
    query = query[order]
    start = np.flatnonzero(np.concatenate(([True], query[1:] != query[:-1]))) if len(query) else np.zeros(0, np.int64)
    rank = np.arange(len(query)) - np.repeat(start, np.diff(np.append(start, len(query))))
    order = order[rank < k]
    return query[rank < k], score[order], ids[order]


def integral(vector: Column) -> Column:
    """floor(64 * x) of each component; null where a component is null, not finite or the vector is empty."""
    def whole(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != F.lit(float("inf")))

    def part(x: Column) -> Column:
        scaled = F.greatest(F.least(x.cast("double"), F.lit(2.0 ** 56)), F.lit(-(2.0 ** 56))) * 64
        return F.floor(scaled).cast("long")

    ok = F.forall(vector, whole) & (F.size(vector) > 0)
    return F.when(ok, F.transform(vector, part))


def _packed(rows: DataFrame, group: Column, name: str) -> DataFrame:
    """``dims, <name>, ids, kind, cells`` per group: its vectors side by side, as integers of the type ``kind``."""
    dealt = rows.select("dims", group.cast("int").alias(name), "id", "v").repartition("dims", name).sortWithinPartitions("dims", name)
    schema = StructType([StructField("dims", IntegerType()), StructField(name, IntegerType()), StructField("ids", ArrayType(LongType())),
                         StructField("kind", StringType()), StructField("cells", BinaryType())])

    def one(key: tuple[int, int], parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        ids, cells = (np.concatenate(c) for c in zip(*parts, strict=True))
        low, high = int(cells.min()), int(cells.max())
        kind = next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max)
        values = ([key[0]], [key[1]], [ids], [np.dtype(kind).str], [cells.astype(kind).tobytes()])
        types = (pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.string(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types, strict=True)], schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, parts = None, []
        for batch in batches:
            dims, of, ids = (batch.column(c).to_numpy() for c in range(3))
            cells = batch.column(3).flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(dims, dtype=np.int64)
            starts = np.flatnonzero(np.concatenate(([True], (dims[1:] != dims[:-1]) | (of[1:] != of[:-1])))) if len(dims) else []
            for low, high in zip(starts, [*starts[1:], len(dims)], strict=True):
                key = (int(dims[low]), int(of[low]))
                if key != held and parts:
                    yield one(held, parts)
                    parts = []
                held = key
                parts.append((ids[low:high], cells[ends[low] - dims[low]:ends[high - 1]]))
        if parts:
            yield one(held, parts)

    return dealt.mapInArrow(run, schema)


_FOUND = StructType([StructField("query_id", LongType()), StructField("vec_id", LongType()), StructField("score", LongType())])


def _kind(rows: np.ndarray, queries: np.ndarray) -> type | None:
    """The floats in which the products are exact; None if there are none."""
    high = max(1.0, float(np.abs(rows.astype(float)).max(initial=0))) * max(1.0, float(np.abs(queries.astype(float)).max(initial=0))) * rows.shape[1]
    return np.float32 if high < 2 ** 24 else np.float64 if high < 2 ** 52 else None


def _plain(ids: np.ndarray, rows: np.ndarray, query: np.ndarray, own: int, k: int, least: float) -> list[tuple[int, int]]:
    """For components too large for exact floats."""
    q = [int(x) for x in query]
    held = (max(-(1 << 63), min((1 << 63) - 1, sum(a * int(b) for a, b in zip(q, r, strict=True)))) for r in rows)
    scores = sorted((-s, int(i)) for i, s in zip(ids, held, strict=True) if i != own)
    return [(-s, i) for s, i in scores[:k] if -s >= least]


def _searched(asked: DataFrame, packed: DataFrame, units: int, k: int) -> DataFrame:
    """What the blocks of ``asked`` (with the ``shard`` they are to meet and their ``floors``) find in the shards."""
    blocks = asked.withColumn("unit", F.floor(F.col("block") / GROUP).cast("int"))
    # a shard goes to a unit once, and comes before its blocks there
    shards = packed.join(blocks.select("dims", "shard", "unit").distinct(), ["dims", "shard"])
    columns = ["dims", "shard", "unit", "at", "ids", "kind", "cells", "floors"]
    both = shards.withColumns({"at": F.lit(-1), "floors": F.lit(None).cast(ArrayType(LongType()))}).select(columns).union(
        blocks.withColumn("at", F.col("block")).select(columns))
    dealt = both.repartition(max(1, min(2 * units, 100_000)), "dims", "shard", "unit").sortWithinPartitions("dims", "shard", "unit", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_ids, rows, trees = None, None, {}
        for batch in batches:
            col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            for i in range(batch.num_rows):
                ids = col["ids"][i].values.to_numpy()
                cells = np.frombuffer(col["cells"][i].as_buffer(), col["kind"][i].as_py()).reshape(len(ids), -1)
                if col["at"][i].as_py() < 0:
                    own_ids, rows, trees = ids, cells, {}
                    continue
                kind = _kind(rows, cells)
                floors = col["floors"][i].as_py() or [None] * len(ids)
                least = [-np.inf if x is None else x for x in floors]
                if kind is None:
                    out = [(int(ids[j]), v, s) for j in range(len(ids)) for s, v in _plain(own_ids, rows, cells[j], int(ids[j]), k, least[j])]
                    cols = list(zip(*out, strict=True)) or [(), (), ()]
                else:
                    tree = trees.get(kind) or trees.setdefault(kind, BallTree(own_ids, rows, kind))
                    query, score, vec = tree.search(cells, ids, k, np.array(least, float))
                    cols = [ids[query], vec, score.astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], _FOUND.names)

    return dealt.mapInArrow(run, _FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """``query_id, rank, vec_id, score`` for the rows of ``vectors`` (``id, vector``) that ``is_query`` picks."""
    rows = staged(vectors.where(F.col("id").isNotNull()).select(F.col("id").cast("long").alias("id"), is_query.alias("asks"),
                                                               integral(F.col("vector")).alias("v"))
                  .where("v is not null").withColumn("dims", F.size("v")))
    sizes = {r["dims"]: (r["n"], r["q"]) for r in
             rows.groupBy("dims").agg(F.count("*").alias("n"), F.count_if("asks").alias("q")).collect()}
    shards = {d: max(1, ceil(n / max(1, min(SHARD, CELLS // d)))) for d, (n, _) in sizes.items()}
    blocks = {d: max(1, ceil(q / BLOCK)) for d, (_, q) in sizes.items()}

    def per_dims(numbers: dict[int, int]) -> Column:
        out = F.lit(1)
        for d, n in numbers.items():
            out = F.when(F.col("dims") == d, F.lit(n)).otherwise(out)
        return out

    deal = F.xxhash64("id", F.monotonically_increasing_id())
    packed = staged(_packed(rows.withColumn("deal", deal), F.pmod("deal", per_dims(shards)), "shard"))
    asked = staged(_packed(rows.where("asks").withColumn("deal", F.xxhash64(F.lit(3), "id")), F.pmod("deal", per_dims(blocks)), "block"))
    home = F.pmod(F.col("block"), per_dims(shards)).cast("int")
    no_floor = F.lit(None).cast(ArrayType(LongType()))
    opening = staged(_best(_searched(asked.withColumn("shard", home).withColumn("floors", no_floor), packed, sum(blocks.values()), k), k).drop("rank"))
    # the kth score of each query so far, laid beside the block's ids
    kth = opening.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("kth"))
    flat = asked.select("dims", "block", F.posexplode("ids").alias("pos", "query_id")).join(kth, "query_id", "left")
    floors = (flat.groupBy("dims", "block").agg(F.array_sort(F.collect_list(F.struct("pos", "kth"))).alias("f"))
              .select("dims", "block", F.col("f.kth").alias("floors")))
    others = F.explode(F.filter(F.sequence(F.lit(0), per_dims(shards) - 1), lambda s: s != home)).alias("shard")
    second = asked.join(floors, ["dims", "block"]).select("*", others).withColumn("shard", F.col("shard").cast("int"))
    units = sum(shards[d] * ceil(blocks[d] / GROUP) for d in shards)
    found = opening.union(_searched(second, packed, units, k))
    return _best(found, k).select("query_id", F.col("rank").cast(IntegerType()).alias("rank"), "vec_id", "score")
