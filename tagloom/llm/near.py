"""Near-duplicate texts by an LSH forest over MinHash signatures, confirmed on whole shingle sets.

1. Every text becomes the set of its distinct word shingles and TREES * DEPTH minimum hashes.  Texts
   with equal sets form one class, and go on as one node.
2. Forest: in each of TREES orders the nodes are sorted by DEPTH of their hashes.  A node's nearest
   neighbours in an order are those with the longest common prefix, so the depth of comparison follows
   the density of the region by itself.  The NEIGHBOURS next nodes of each order become candidates where
   at least one hash is shared and the signatures agree well enough (four standard errors below the
   threshold are allowed).  Sorting splits a hot region over tasks; candidates per node are bounded by
   the method, not cut from a longer list.
3. Links are confirmed exactly, first the two most alike candidates of each node, then those whose ends
   these have not yet brought into one component.
4. Dense regions, where the windows hold a small part of the neighbours: in every region of equal
   PIVOT_DEPTH hashes the node with most confirmed links is compared with all members outside its
   component.  This is repeated while it finds links.  So a text that many copies resemble, while the
   copies do not resemble each other, still joins them.
5. Exact step: steps 2 to 4 only find links early.  In a common order of all shingles, frequent ones last,
   two sets that are alike enough share a shingle at places i and j with at least as many shingles left in
   both as they must have in common.  So each set is put down under its first shingles, and all pairs with
   such a shingle in different components are confirmed, if their first shingles alone do not rule it out.
   The order comes from counters over the shingles of all texts, so first shingles are rare ones at every size.
   Shingles that only one component holds are left out; the others are split into blocks of BLOCK sets, and
   each pair of blocks is a group of its own.
6. Components of the confirmed links; all steps are joins and aggregates.

The windows of step 2 hold few of the neighbours where many texts share a template; step 5 has no such
limit, so no link is missed.  The order comes from a sample of texts: it decides how many pairs are looked
at, not which are found.

A null text, an empty one and one without words have an empty set and are linked with nothing.  Texts
of fewer words than a shingle have their whole sequence as the only shingle.  Rows that repeat a text,
a doc_id or both are members of one class.  A null doc_id takes part; the smallest doc_id of a
component ignores nulls.  Extra columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import BinaryType, FloatType, LongType, StructField, StructType

from tagloom.llm import counters
from tagloom.llm import words as W
from tagloom.llm.graph import components
from tagloom.llm.staging import discard, staged

TREES = 16
DEPTH = 8
NEIGHBOURS = 4
PIVOT_DEPTH = 5
#: bytes of the signature that travel with a node for estimates
SKETCH = 64
#: sets of one block of a shingle in the exact step
BLOCK = 512
#: counters of each of the two tables that give the order of shingles (a power of two)
TABLE = 1 << 21
_rng = np.random.Generator(np.random.PCG64(11))
_FACTORS = _rng.integers(1, 1 << 62, TREES * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _rng.integers(0, 1 << 63, TREES * DEPTH, dtype=np.uint64)


def signatures(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Minimum of TREES * DEPTH hashes over each set; zeros for an empty set."""
    sizes = np.diff(bounds)
    full = np.flatnonzero(sizes)
    out = np.zeros((len(sizes), len(_FACTORS)), np.uint32)
    step = 1 << 16
    at = 0
    while at < len(full):  # sets side by side, a bounded number of values at a time
        to = max(at + 1, int(np.searchsorted(bounds[full], bounds[full[at]] + step)))
        some = full[at:to]
        low, high = bounds[some[0]], bounds[some[-1] + 1]
        part, edges = values[low:high], bounds[some] - low
        for k, (factor, shift) in enumerate(zip(_FACTORS, _SHIFTS, strict=True)):
            hashed = ((part * factor + shift) >> np.uint64(32)).astype(np.uint32)
            out[some, k] = np.minimum.reduceat(hashed, edges)
        at = to
    return out


def set_digest(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that tell sets apart."""
    def total(x: np.ndarray) -> np.ndarray:
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)))
        return W.mix(sums[bounds[1:]] - sums[bounds[:-1]] + np.diff(bounds).astype(np.uint64)).view(np.int64)
    return total(values), total(W.mix(values ^ np.uint64(0x5851F42D4C957F2D)))


def _counter(values: np.ndarray, row: int) -> np.ndarray:
    return ((values >> np.uint64(21 * row)) & np.uint64(TABLE - 1)).astype(np.int64) + row * TABLE


def frequencies(docs: DataFrame, width: int) -> np.ndarray:
    """Two tables of counters over the shingles of all texts, equal sets of one task once (a count-min sketch).

    The driver and every task hold them whole, so a counter is one byte: the order needs no more.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen, some = np.zeros(2 * TABLE, np.uint32), set(), False
        for batch in batches:
            for block in W.blocks(batch.column(0)):
                values, bounds = W.shingle_sets(W.words(block, lower=True), width)
                node = set_digest(values, bounds)[0].tolist()
                keep = np.array([not (x in seen or seen.add(x)) for x in node], bool)
                fresh = values[np.repeat(keep, np.diff(bounds))]
                for row in (0, 1):
                    np.add.at(table, _counter(fresh, row), np.uint32(1))
                some = True
        if some:
            yield pa.RecordBatch.from_arrays(counters.pieces(table), counters.PIECE.names)

    return counters.summed(docs.select("text").mapInArrow(run, counters.PIECE), 2 * TABLE, counters.coarse, np.uint8)


def prefixes(values: np.ndarray, bounds: np.ndarray, percent: int, table: np.ndarray) -> list[bytes]:
    """The first shingles of each set in the common order, as many as a similar set must meet."""
    rank = np.minimum(table[_counter(values, 0)], table[_counter(values, 1)])
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        size = b - a
        # values are sorted, so equal ranks stay in the order of their values
        first = a + np.argsort(rank[a:b], kind="stable")[:size - -(-percent * size // 100) + 1]
        out.append(values[first].tobytes())
    return out


_SIGNED = StructType([StructField("n_shingles", LongType()), StructField("d1", LongType()), StructField("d2", LongType()),
                      StructField("keys", BinaryType()), StructField("sketch", BinaryType()), StructField("prefix", BinaryType())])


def signed(text: Column, width: int, percent: int, order) -> Column:
    """Set size, digest, keys of all trees (two bytes a hash), sketch and first shingles of a text."""
    def run(texts: pa.Array) -> pa.Array:
        cols: list[list] = [[], [], [], [], [], []]
        for block in W.blocks(texts):
            values, bounds = W.shingle_sets(W.words(block, lower=True), width)
            d1, d2 = set_digest(values, bounds)
            minima = signatures(values, bounds)
            keys = np.ascontiguousarray(minima.astype(">u2")).tobytes()
            spread = (minima * np.uint32(2654435761)) >> np.uint32(24)
            sketch = np.ascontiguousarray(spread[:, ::TREES * DEPTH // SKETCH].astype(np.uint8)).tobytes()
            k = 2 * TREES * DEPTH
            cols[0].append(np.diff(bounds)), cols[1].append(d1), cols[2].append(d2)
            cols[3] += [keys[i * k:(i + 1) * k] for i in range(block.texts)]
            cols[4] += [sketch[i * SKETCH:(i + 1) * SKETCH] for i in range(block.texts)]
            cols[5] += prefixes(values, bounds, percent, order.value)
        flat = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in cols[:3]]
        return pa.StructArray.from_arrays([*(pa.array(c, pa.int64()) for c in flat), pa.array(cols[3], pa.binary()),
                                           pa.array(cols[4], pa.binary()), pa.array(cols[5], pa.binary())], _SIGNED.names)
    return arrow_udf(run, _SIGNED)(text)


def whole_set(text: Column, width: int) -> Column:
    """Sorted values (eight bytes each) of a text's set."""
    def run(texts: pa.Array) -> pa.Array:
        sets = []
        for block in W.blocks(texts):
            values, bounds = W.shingle_sets(W.words(block, lower=True), width)
            sets += [values[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        return pa.array(sets, pa.binary())
    return arrow_udf(run, BinaryType())(text)


def least_agreement(percent: int) -> float:
    """Share of equal sketch bytes that a true pair misses with chance below 1 in 10 000."""
    s = percent / 100
    return s - 4 * float(np.sqrt(s * (1 - s) / SKETCH))


_PAIR = StructType([StructField("a", LongType()), StructField("b", LongType()), StructField("likeness", FloatType())])


def neighbours(nodes: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs ``a < b`` from the sorted orders of ``node, n_shingles, keys, sketch``."""
    least = least_agreement(percent)
    trees = F.explode(F.array(*[
        F.struct(F.lit(t).cast("short").alias("tree"), F.substring("keys", 2 * DEPTH * t + 1, 2 * DEPTH).alias("key"))
        for t in range(TREES)]))
    ordered = (nodes.select(trees.alias("t"), "node", "n_shingles", "sketch").select("t.tree", "t.key", "node", "n_shingles", "sketch")
               .repartitionByRange("tree", "key", "node").sortWithinPartitions("tree", "key", "node"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            first = np.frombuffer(b"".join(k[:2] for k in batch.column(1).to_pylist()), ">u2").astype(np.int64)
            now = [batch.column(0).to_numpy().astype(np.int64) * 65536 + first, batch.column(2).to_numpy(), batch.column(3).to_numpy(),
                   np.frombuffer(b"".join(batch.column(4).to_pylist()), np.uint8).reshape(-1, SKETCH)]
            new_from = 0
            if held is not None:
                new_from = len(held[0])
                now = [np.concatenate((h, x)) for h, x in zip(held, now, strict=True)]
            region, node, size, sketch = now
            out = [[], [], []]
            for step in range(1, NEIGHBOURS + 1):
                right = np.arange(max(step, new_from), len(node))
                left = right - step
                big, little = np.maximum(size[left], size[right]), np.minimum(size[left], size[right])
                ok = (region[left] == region[right]) & (100 * little >= percent * big)
                left, right = left[ok], right[ok]
                alike = (sketch[left] == sketch[right]).mean(axis=1) if len(left) else np.zeros(0)
                good = alike >= least
                out[0].append(np.minimum(node[left], node[right])[good])
                out[1].append(np.maximum(node[left], node[right])[good])
                out[2].append(alike[good])
            held = [x[-NEIGHBOURS:] for x in now]
            a, b, c = (np.concatenate(x) for x in out)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.float32())],
                                             ["a", "b", "likeness"])

    return ordered.mapInArrow(run, _PAIR).groupBy("a", "b").agg(F.max("likeness").alias("likeness"))


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose whole sets (``node, values``) are alike enough."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = np.concatenate((x, y))
                both.sort()
                same = int((both[1:] == both[:-1]).sum())
                keep.append(100 * same >= percent * (len(both) - same))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    schema = StructType([StructField("a", LongType()), StructField("b", LongType())])
    left = sets.select(F.col("node").alias("a"), F.col("values").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("values").alias("y"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, schema)


def contracted(links: DataFrame, roots: DataFrame) -> DataFrame:
    """Links between the roots of their ends, and each node's link to its root: the same components, fewer links."""
    ra = roots.select(F.col("node").alias("a"), F.col("root").alias("ra"))
    rb = roots.select(F.col("node").alias("b"), F.col("root").alias("rb"))
    ends = links.join(ra, "a", "left").join(rb, "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    stars = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
    return ends.where("a != b").distinct().union(stars)


def across(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs whose ends are in different components; nodes without a root are their own."""
    ra = roots.select(F.col("node").alias("a"), F.col("root").alias("ra"))
    rb = roots.select(F.col("node").alias("b"), F.col("root").alias("rb"))
    with_roots = pairs.join(ra, "a", "left").join(rb, "b", "left")
    return with_roots.where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).drop("ra", "rb")


def pivots(nodes: DataFrame, links: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """Pairs of the best linked node of each dense region with the members outside its component."""
    # each end is counted by itself first, so that links are not doubled
    sides = [links.groupBy(F.col(c).alias("node")).agg(F.count("*").alias("n")) for c in "ab"]
    degree = sides[0].union(sides[1]).groupBy("node").agg(F.sum("n").alias("degree"))
    regions = F.explode(F.array(*[
        F.struct(F.lit(t).cast("short").alias("tree"), F.substring("keys", 2 * DEPTH * t + 1, 2 * PIVOT_DEPTH).alias("key"))
        for t in range(TREES)]))
    members = (nodes.join(degree, "node", "left").join(roots, "node", "left")
               .select("node", "n_shingles", "sketch", F.coalesce("degree", F.lit(0)).alias("degree"),
                       F.coalesce("root", "node").alias("root"), regions.alias("r")))
    best = members.groupBy("r").agg(F.max_by(F.struct("node", "n_shingles", "sketch", "root"), F.struct("degree", -F.col("node"))).alias("p"),
                                    F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select("r", "p")
    p, size = F.col("p"), F.col("n_shingles")
    found = members.join(best, "r").where(
        (F.col("root") != p["root"]) & (100 * F.least(size, p["n_shingles"]) >= percent * F.greatest(size, p["n_shingles"])))
    least = least_agreement(percent)

    def alike(x: pa.Array, y: pa.Array) -> pa.Array:
        if not len(x):
            return pa.array([], pa.float32())
        m, n = (np.frombuffer(b"".join(v.to_pylist()), np.uint8).reshape(-1, SKETCH) for v in (x, y))
        return pa.array((m == n).mean(axis=1), pa.float32())

    likeness = arrow_udf(alike, FloatType())(F.col("sketch"), p["sketch"])
    pairs = found.select(F.least("node", p["node"]).alias("a"), F.greatest("node", p["node"]).alias("b"), likeness.alias("likeness"))
    return pairs.where(F.col("likeness") >= least).select("a", "b").distinct()


def postings(nodes: DataFrame) -> DataFrame:
    """``h, node, span, root``: every set under its first shingles; ``span`` is set size * 2^32 + place."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                first = [np.frombuffer(v.as_buffer(), np.int64) for v in part.column(3)]
                n = np.array([len(v) for v in first], np.int64)
                node, size, root = (np.repeat(part.column(k).to_numpy(), n) for k in range(3))
                place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (np.concatenate(first), node, (size << 32) + place, root)],
                                                 ["h", "node", "span", "root"])

    schema = StructType([StructField(c, LongType()) for c in ("h", "node", "span", "root")])
    return nodes.select("node", F.col("n_shingles").alias("size"), "root", "prefix").mapInArrow(run, schema)


def meetings(nodes: DataFrame, percent: int) -> DataFrame:
    """All pairs ``a < b`` of different components that meet, from ``node, n_shingles, root, prefix``.

    A pair is here if its sets share a shingle at places after which both still hold as many as they must share;
    the first shared shingle of a pair that is alike enough is at such places.
    """
    # sets of fewer than four shingles are alike only if they are equal
    placed = postings(nodes.where("n_shingles >= 4")).repartition("h")
    shared = (placed.groupBy("h").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high"))
              .where("low != high").select("h", F.ceil(F.col("n") / BLOCK).alias("blocks")))
    block = F.pmod(F.xxhash64("node"), F.col("blocks"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    units = (placed.join(shared, "h").withColumn("block", block).withColumn("other", other)
             .select("h", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "node", "span", "root"))
    dealt = units.repartition("h", "low", "high").sortWithinPartitions("h", "low", "high")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((7, 0), np.int64)
        for batch in itertools.chain(batches, [None]):
            now = held
            if batch is not None:
                now = np.concatenate((held, np.stack([c.to_numpy() for c in batch.columns])), axis=1)
            if not now.shape[1]:
                continue
            starts = np.flatnonzero(np.concatenate(([True], (now[:3, 1:] != now[:3, :-1]).any(axis=0))))
            whole = now.shape[1] if batch is None else starts[-1]  # the last group may go on in the next batch
            held, now = now[:, whole:], now[:, :whole]
            starts = starts[starts < whole]
            at = np.arange(whole) - np.repeat(starts, np.diff(np.append(starts, whole)))
            _, low, high, block, node, span, root = now
            size, place = span >> 32, span & 0xFFFFFFFF
            right, step = np.arange(whole), 0
            out, waiting = [], 0
            while len(right):
                step += 1
                right = right[at[right] >= step]
                left = right - step
                least = -(-percent * (size[left] + size[right]) // (100 + percent))
                ok = ((root[left] != root[right]) & (least <= np.minimum(size[left] - place[left], size[right] - place[right]))
                      & ((low[right] == high[right]) | (block[left] != block[right])))
                x, y = node[left[ok]], node[right[ok]]
                out.append((np.minimum(x, y), np.maximum(x, y)))
                waiting += len(x)
                if waiting > 1 << 18 or not len(right):
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[k] for o in out]), pa.int64()) for k in (0, 1)], ["a", "b"])
                    out, waiting = [], 0

    schema = StructType([StructField("a", LongType()), StructField("b", LongType())])
    return dealt.mapInArrow(run, schema).distinct()


def likely(met: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs of ``met`` whose first shingles do not rule out that they are alike enough."""
    schema = StructType([StructField("a", LongType()), StructField("b", LongType())])
    marked = nodes.select("node", "n_shingles", marks(F.col("prefix")).alias("marks"))
    left, right = (marked.select(F.col("node").alias(c), F.col("n_shingles").alias(f"n_{c}"), F.col("marks").alias(f"marks_{c}")) for c in "ab")
    pairs = met.join(left, "a").join(right, "b").select("a", "b", "n_a", "n_b", "marks_a", "marks_b")
    return pairs.mapInArrow(lambda batches: _enough_marks(batches, percent), schema)


def marks(prefix: Column) -> Column:
    """Two bytes of each of a set's first shingles."""
    def run(values: pa.Array) -> pa.Array:
        return pa.array([np.frombuffer(v.as_buffer(), np.uint64).astype(np.uint16).tobytes() for v in values], pa.binary())
    return arrow_udf(run, BinaryType())(prefix)


def _enough_marks(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs that can share enough: what their first shingles share, by marks at most, and all of the rest of one."""
    for whole in batches:
        for at in range(0, whole.num_rows, 2048):
            batch = whole.slice(at, 2048)
            m, n = (batch.column(k).to_numpy() for k in (2, 3))
            held, keyed = [], []
            for k in (4, 5):  # a batch's marks side by side, each with the number of its pair
                marks = batch.column(k).to_pylist()
                held.append(np.array([len(v) // 2 for v in marks], np.int64))
                keyed.append((np.repeat(np.arange(len(marks)), held[-1]) << 16) + np.frombuffer(b"".join(marks), np.uint16))
            both = [np.bincount(x[np.isin(x, y)] >> 16, minlength=len(m)) for x, y in (keyed, keyed[::-1])]
            enough = np.maximum(*both) + np.maximum(m - held[0], n - held[1]) >= -(-percent * (m + n) // (100 + percent))
            yield batch.select(["a", "b"]).filter(pa.array(enough))


def key_of(doc_id: Column, digest: Column) -> Column:
    """One value for a document's id and text; never null."""
    return F.concat_ws("/", F.coalesce(doc_id.cast("string"), F.lit("")), digest)


def keyed(docs: DataFrame) -> DataFrame:
    """``key, row``: each row whole, so that no column of the caller's can clash."""
    return docs.select(key_of(F.col("doc_id"), F.md5("text")).alias("key"), F.struct("*").alias("row"))


def classes(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Rows (``row, doc_id, n_shingles, d1, d2, keys, sketch, prefix``) and classes of equal sets (``d1, d2, node, low``).

    ``low`` is the class's first document: smallest doc_id (nulls last), then smallest digest of the text.
    """
    order = docs.sparkSession.sparkContext.broadcast(frequencies(docs, width))
    rows = staged(docs.select("doc_id", F.md5("text").alias("digest"), signed(F.col("text"), width, percent, order).alias("s"))
                  .select("doc_id", "digest", "s.*").withColumn("row", F.monotonically_increasing_id()))
    low = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "digest")
    return rows, staged(rows.where("n_shingles > 0").groupBy("d1", "d2").agg(F.min("row").alias("node"), F.min(low).alias("low")))


def sets_of(docs: DataFrame, groups: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """``node, values``: the whole sets of ``nodes`` (``node``)."""
    wanted = groups.join(nodes.select("node"), "node", "left_semi").select("node", "low")
    # texts are joined, not sets: they are smaller on the way
    texts = keyed(docs.select("doc_id", "text")).join(wanted.select("node", key_of(F.col("low.doc_id"), F.col("low.digest")).alias("key")), "key")
    return staged(texts.dropDuplicates(["key"]).select("node", whole_set(F.col("row.text"), width).alias("values")))


def ends_of(pairs: DataFrame) -> DataFrame:
    """``node``: all nodes of the pairs ``a, b``, once.  Each side is made distinct first, so that pairs are not doubled."""
    return pairs.select(F.col("a").alias("node")).distinct().union(pairs.select(F.col("b").alias("node")).distinct()).distinct()


def linked(docs: DataFrame, rows: DataFrame, groups: DataFrame, width: int, percent: int) -> DataFrame:
    """``node, root`` of all nodes that have a link to another class."""
    reps = rows.join(groups.select(F.col("node").alias("row")), "row", "left_semi")
    nodes = reps.select(F.col("row").alias("node"), "n_shingles", "keys", "sketch")
    pairs = staged(neighbours(nodes, percent))
    near = staged(nodes.join(ends_of(pairs), "node", "left_semi"))
    sets = sets_of(docs, groups, near, width)
    # the two most alike candidates of each node first
    ends = pairs.select("a", "b", "likeness", F.explode(F.array("a", "b")).alias("end"))
    rank = F.row_number().over(Window.partitionBy("end").orderBy(F.desc("likeness"), "a", "b"))
    first = staged(ends.withColumn("rank", rank).where("rank <= 2").select("a", "b").distinct())
    links = staged(confirmed(first, sets, percent))
    # what these links join already needs no more links, however many pairs a group of copies has
    partly = staged(components(links))
    rest = across(pairs.join(first, ["a", "b"], "left_anti").select("a", "b"), partly)
    links = links.union(staged(confirmed(rest.union(pivots(near, links, partly, percent)), sets, percent)))
    discard(pairs, first)
    roots = staged(components(contracted(links, partly)))
    while not (more := staged(confirmed(pivots(near, links, roots, percent), sets, percent))).isEmpty():
        links = links.union(more)
        roots = staged(components(contracted(more, roots)))
    discard(sets, near)
    placed = reps.select(F.col("row").alias("node"), "n_shingles", "prefix").join(roots, "node", "left")
    placed = placed.withColumn("root", F.coalesce("root", "node"))
    met = staged(meetings(placed, percent))
    pairs = staged(likely(met, placed, percent))
    discard(met)
    sets = sets_of(docs, groups, ends_of(pairs), width)
    more = staged(confirmed(pairs, sets, percent))
    discard(sets, pairs)
    return roots if more.isEmpty() else staged(components(contracted(more, roots)))


def grouped(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """``doc_id, n_shingles, d1, d2`` per row, and per class its component: ``d1, d2, low`` (the component's first document)."""
    rows, groups = classes(docs, width, percent)
    rooted = groups.join(linked(docs, rows, groups, width, percent), "node", "left").withColumn("root", F.coalesce("root", "node"))
    low = rooted.groupBy("root").agg(F.min("low").alias("low"))
    named = staged(rooted.select("d1", "d2", "root").join(low, "root").select("d1", "d2", "low"))
    few = staged(rows.select("doc_id", "n_shingles", "d1", "d2"))
    discard(rows, groups)
    return few, named


def groups_of(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Per row of ``docs`` (``doc_id, text``): ``doc_id, n_shingles, component_id, kept``.

    ``component_id`` is the smallest doc_id reachable by links of ``percent`` or more similarity,
    ``kept`` whether it is the row's own.
    """
    rows, named = grouped(docs, width, percent)
    own = F.when(F.col("n_shingles") > 0, F.col("low.doc_id")).otherwise(F.col("doc_id"))
    return (rows.select("doc_id", "n_shingles", "d1", "d2").join(named, ["d1", "d2"], "left").withColumn("component_id", own)
            .select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")))


def first_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: its first document.  Rows without words stay."""
    _, named = grouped(docs, width, percent)
    firsts = named.select(key_of(F.col("low.doc_id"), F.col("low.digest")).alias("key")).distinct()
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    kept = keyed(docs.where(worded)).join(firsts, "key", "left_semi").dropDuplicates(["key"]).select("row.*")
    return kept.union(docs.where(~worded))
