"""Exact order statistics and running sums without a single-task sort.

A global ``row_number`` would send every row through one task.  Here the order comes from a
digest, a histogram over digest prefixes finds where a position falls, and only one small
bucket is ever sorted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SMALL_BUCKET = 10_000


def shuffle_digest(row_id: str, seed: int | str) -> Column:
    """The seeded order of the rows: a hexadecimal digest of seed and id."""
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(row_id).cast("string")))


def digest_cuts(df: DataFrame, row_id: str, seed: int | str, positions: Sequence[int]) -> list[tuple[str, object] | None]:
    """``(digest, id)`` of the rows at 1-based ``positions`` in seeded order (None for position 0).

    Driver side: at most 4096 histogram rows per level and one row per position.
    """
    keyed = df.select(F.col(row_id).alias("_id"), shuffle_digest(row_id, seed).alias("_h"))

    def find(prefix: str, position: int) -> tuple[str, object]:
        inside = keyed.where(F.startswith(F.col("_h"), F.lit(prefix))) if prefix else keyed
        width = len(prefix) + 3
        for bucket, n in histogram(prefix, inside, width):
            if position <= n:
                if n <= SMALL_BUCKET or width >= 30:
                    row = (keyed.where(F.startswith(F.col("_h"), F.lit(bucket)))
                           .orderBy("_h", "_id").offset(position - 1).limit(1).first())
                    return row["_h"], row["_id"]
                return find(bucket, position)
            position -= n
        raise ValueError("position lies beyond the last row")

    seen: dict[str, list[tuple[str, int]]] = {}

    def histogram(prefix: str, inside: DataFrame, width: int) -> list[tuple[str, int]]:
        if prefix not in seen:
            counts = inside.groupBy(F.left("_h", F.lit(width)).alias("b")).count().collect()
            seen[prefix] = sorted((r["b"], r["count"]) for r in counts)
        return seen[prefix]

    return [None if p <= 0 else find("", p) for p in positions]


def at_or_before(row_id: str, seed: int | str, cut: tuple[str, object] | None) -> Column:
    """Rows up to and including ``cut`` in seeded order -- a map-side predicate."""
    if cut is None:
        return F.lit(False)
    digest = shuffle_digest(row_id, seed)
    return (digest < cut[0]) | ((digest == cut[0]) & (F.col(row_id) <= F.lit(cut[1])))


def position_in_group(df: DataFrame, group: str, tie: str, digest: str, out: str) -> DataFrame:
    """1-based position inside ``group`` in the order (md5(``tie``), ``digest``).

    A group may hold a third of the table: positions are counted per (group, prefix of the tie
    digest), then per (tie, prefix of the row digest), and only the last, small bucket is sorted.
    """
    keyed = (df.withColumn("_t", F.md5(F.coalesce(F.col(tie), F.lit(""))))
             .withColumn("_b1", F.left("_t", F.lit(3))).withColumn("_b2", F.left(digest, F.lit(3))))
    fine = keyed.groupBy(group, "_b1", "_t", "_b2").agg(F.count("*").alias("_n"))
    coarse = fine.groupBy(group, "_b1").agg(F.sum("_n").alias("_n1"))
    before = Window.partitionBy(group).orderBy("_b1").rowsBetween(Window.unboundedPreceding, -1)
    coarse = coarse.select(group, "_b1", F.coalesce(F.sum("_n1").over(before), F.lit(0)).alias("_o1"))
    inner = Window.partitionBy(group, "_b1").orderBy("_t", "_b2").rowsBetween(Window.unboundedPreceding, -1)
    fine = fine.select(group, "_b1", "_t", "_b2", F.coalesce(F.sum("_n").over(inner), F.lit(0)).alias("_o2"))
    offsets = fine.join(coarse, [group, "_b1"]).select(group, "_t", "_b2", (F.col("_o1") + F.col("_o2")).alias("_o"))
    last = Window.partitionBy(group, "_t", "_b2").orderBy(digest)
    return (keyed.withColumn("_r", F.row_number().over(last)).join(offsets, [group, "_t", "_b2"])
            .withColumn(out, F.col("_r") + F.col("_o")).drop("_t", "_b1", "_b2", "_r", "_o"))


def running_sums(df: DataFrame, groups: Sequence[str], key: str, values: Sequence[str],
                 fan: int = 1000, levels: int = 3) -> DataFrame:
    """Inclusive running sums of ``values`` per group from the highest integer ``key`` down.

    Keys are grouped by thousands, millions, ...; every window sees at most ``fan`` parents or
    children of one parent, so a group's length never decides how much one task sorts.
    """
    groups, values = list(groups), list(values)
    base = df.groupBy(*groups, key).agg(*[F.sum(v).alias(v) for v in values])
    return _running(base, groups, key, values, fan, levels)


def _running(base: DataFrame, groups: list[str], key: str, values: list[str], fan: int, levels: int) -> DataFrame:
    if levels <= 1:
        down = Window.partitionBy(*groups).orderBy(F.col(key).desc()).rowsBetween(Window.unboundedPreceding, 0)
        return base.select(*groups, key, *[F.sum(v).over(down).alias(v) for v in values])
    up = f"_p{levels}"
    parent = base.withColumn(up, F.floor(F.col(key) / fan))
    totals = parent.groupBy(*groups, up).agg(*[F.sum(v).alias(v) for v in values])
    above = _running(totals, groups, up, values, fan, levels - 1)
    own = totals.select(*groups, up, *[F.col(v).alias(f"_own_{v}") for v in values])
    offset = above.join(own, [*groups, up]).select(
        *groups, up, *[(F.col(v) - F.col(f"_own_{v}")).alias(f"_off_{v}") for v in values])
    down = Window.partitionBy(*groups, up).orderBy(F.col(key).desc()).rowsBetween(Window.unboundedPreceding, 0)
    inside = parent.select(*groups, key, up, *[F.sum(v).over(down).alias(v) for v in values])
    return inside.join(offset, [*groups, up]).select(
        *groups, key, *[(F.col(v) + F.col(f"_off_{v}")).alias(v) for v in values])
