"""Seeded splits, folds and samples; every assignment is a function of seed and row id."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import ROUND_HALF_EVEN, Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import InputError, cut_lineage
from . import ranking
from .labels import rarest_label, support


def half_even(x: float) -> int:
    return int(Decimal(repr(x)).quantize(Decimal(1), rounding=ROUND_HALF_EVEN))


def three_way(df: DataFrame, row_id: str, seed: int, val_size: float = 0.15, test_size: float = 0.15) -> DataFrame:
    """``part`` = train / val / test with exact sizes ``round(n * share)``.

    Driver side: a count and two order statistics; the assignment itself is map-side.
    """
    if val_size + test_size >= 1:
        raise InputError(f"shares {val_size} and {test_size} are held out; no row is left to learn from")
    n = df.count()
    n_val, n_test = half_even(n * val_size), half_even(n * test_size)
    train, val = ranking.digest_cuts(df, row_id, seed, [n - n_val - n_test, n - n_test])
    return df.withColumn("part", F.when(ranking.at_or_before(row_id, seed, train), "train")
                         .when(ranking.at_or_before(row_id, seed, val), "val").otherwise("test"))


def folds(df: DataFrame, row_id: str, seed: int, k: int) -> DataFrame:
    """``fold`` 0..k-1 of (nearly) equal size, random."""
    n = df.count()
    if k > n:
        raise InputError(f"{k} folds exceed the {n} usable rows")
    ends, at = [], 0
    for fold in range(k - 1):
        at += n // k + (1 if fold < n % k else 0)
        ends.append(at)
    chain = F.lit(k - 1)
    for fold, cut in reversed(list(enumerate(ranking.digest_cuts(df, row_id, seed, ends)))):
        chain = F.when(ranking.at_or_before(row_id, seed, cut), fold).otherwise(chain)
    return df.withColumn("fold", chain)


def dealing_pattern(shares: Sequence[float], slots: int = 100) -> list[int]:
    """Which part each of ``slots`` successive rows goes to: always the one furthest behind.

    Every stretch of the pattern is close to the shares, so a stratum of any length is dealt
    out evenly.
    """
    if not shares or min(shares) < 0 or sum(shares) <= 0:
        raise InputError(f"shares must be non-negative with a positive sum, got {list(shares)}")
    total = sum(shares)
    if len(set(shares)) == 1:
        return list(range(len(shares)))
    given, pattern = [0] * len(shares), []
    for step in range(1, slots + 1):
        debts = [step * s / total - g for s, g in zip(shares, given, strict=True)]
        part = max(range(len(shares)), key=lambda p: (debts[p], -p))
        given[part] += 1
        pattern.append(part)
    return pattern


def stratified(df: DataFrame, shares: Sequence[float], seed: int, labels: str = "labels",
               row_id: str = "row_id", out: str = "part_no") -> DataFrame:
    """Partition rows so that rare labels keep their share in every part.

    A row's stratum is its rarest label; inside it rows with the same label set follow each
    other, and the dealing pattern (started at a stratum-specific slot) hands them out.  Rows
    without a label form a stratum of their own.
    """
    rows = df.select(F.col(row_id).alias("row_id"), F.col(labels).alias("labels"))
    strata = rarest_label(rows, support(rows))
    placed = (rows.join(strata, "row_id", "left")
              .select("row_id", F.coalesce("stratum", F.lit("")).alias("stratum"),
                      F.array_join(F.array_sort("labels"), ",").alias("_sig"))
              .withColumn("_digest", ranking.shuffle_digest("row_id", seed)))
    at = ranking.position_in_group(placed, "stratum", "_sig", "_digest", "_pos")
    pattern = dealing_pattern(shares)
    start = F.conv(F.left(F.md5("stratum"), F.lit(6)), 16, 10).cast("long")
    slot = ((F.col("_pos") - 1 + start) % len(pattern)).cast("int")
    part = F.get(F.lit(pattern), slot)
    return df.join(at.select(F.col("row_id").alias(row_id), part.alias(out)), row_id)


def real_rows_only(df: DataFrame, row_id: str, seed: int, val_size: float = 0.15,
                   test_size: float = 0.15) -> tuple[DataFrame, str | None]:
    """Marked rows always train; validation and test come from the real ones.

    Falls back to all rows, with the reason, when a part would be empty (counts on the driver).
    """
    real, marked = df.where("mark = 0"), df.where("mark <> 0")
    n_real = real.count()
    if min(half_even(n_real * val_size), half_even(n_real * test_size)) == 0:
        return (three_way(df, row_id, seed, val_size, test_size),
                f"{n_real} real rows cannot fill both a validation and a test part")
    return three_way(real, row_id, seed, val_size, test_size).unionByName(
        marked.withColumn("part", F.lit("train"))), None


def uniform(row_id: str, seed: int | str) -> Column:
    """Seeded uniform number in [0, 1) with 2**28 steps, from the row id alone."""
    digest = ranking.shuffle_digest(row_id, seed)
    return F.conv(F.left(digest, F.lit(7)), 16, 10).cast("long") / F.lit(float(1 << 28))


def weak_holdout(df: DataFrame, weak: DataFrame, row_id: str, seed: int, labels: str = "labels",
                 p_weak: float = 0.4, p_rest: float = 0.15) -> DataFrame:
    """``held`` flag: rows with a weak label are held out more often."""
    carrying = (df.select(row_id, F.explode(labels).alias("label")).join(weak.select("label"), "label", "left_semi")
                .select(row_id).distinct().withColumn("_weak", F.lit(True)))
    return df.join(carrying, row_id, "left").withColumn(
        "held", uniform(row_id, seed) < F.when(F.col("_weak"), p_weak).otherwise(p_rest)).drop("_weak")


#: ranges of row ids whose rows are counted per label
RANGES = 4096


def quota_mine(raw: DataFrame, needed: DataFrame, row_id: str, labels: str = "labels") -> DataFrame:
    """Rows that a pass in id order takes while any of their labels ``(label, need)`` is short of rows.

    A row with a label that is still open is always taken, so a label is filled by the first ``need`` rows that
    carry it, whatever other labels do; the rows taken are all of these.  Rows are counted per label and range of
    ids, running sums show the range in which each quota fills, and only the rows of those ranges are numbered.
    ``selected_for`` is the label with the largest need (ties: the last by name) that the row counted for.  Ids are
    whole numbers.
    """
    wanted = needed.where("need > 0").groupBy("label").agg(F.max("need").alias("need"))
    bounds = raw.agg(F.min(row_id).alias("low"), F.max(row_id).alias("high")).first()
    low, high = bounds["low"] or 0, bounds["high"] or 0
    block = F.floor((F.col(row_id) - F.lit(low)) / ((high - low) // RANGES + 1)).alias("block")
    carried = raw.select(row_id, block, F.explode(F.array_distinct(labels)).alias("label")).join(wanted.select("label"), "label", "left_semi")
    before = Window.partitionBy("label").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counted = cut_lineage(carried.groupBy("label", "block").agg(F.count("*").alias("n"))
                          .withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).join(wanted, "label").where("before < need"))
    whole = carried.join(counted.where("before + n <= need").select("label", "block"), ["label", "block"], "left_semi")
    filling = carried.join(counted.where("before + n > need").select("label", "block", (F.col("need") - F.col("before")).alias("room")), ["label", "block"])
    place = F.row_number().over(Window.partitionBy("label").orderBy(row_id))
    first = filling.withColumn("_k", place).where(F.col("_k") <= F.col("room"))
    taken = whole.select(row_id, "label").union(first.select(row_id, "label"))
    largest = taken.join(wanted, "label").groupBy(row_id).agg(F.max(F.struct("need", "label"))["label"].alias("selected_for"))
    return raw.join(largest, row_id)


def per_label_sample(rows: DataFrame, k: int, seed: int, row_id: str = "row_id", labels: str = "labels") -> DataFrame:
    """``k`` seeded rows of every label; each task keeps at most ``k`` per label before the shuffle."""
    long = rows.select(F.col(row_id), F.explode(labels).alias("label")) \
        .withColumn("_h", ranking.shuffle_digest(row_id, seed))
    ordered = Window.partitionBy("label").orderBy("_h", row_id)
    return long.withColumn("pick", F.row_number().over(ordered)).where(F.col("pick") <= k).drop("_h")


#: words at most that are sent to every task
SENT_WORDS = 1 << 19


def unknown_words(rows: DataFrame, known: DataFrame, row_id: str, words: str) -> DataFrame:
    """``(row_id, all, miss)``: how many words the rows of an id have, and how many of these are not among ``known(w, df)``.

    ``known`` is stored once.  The most frequent known words are sent to every task, so only words that are not among
    them are shuffled; if all known words can be sent, none is.
    """
    known = cut_lineage(known)
    power = F.floor(F.log2("df")).cast("int")
    sizes = {r["power"]: r["n"] for r in known.groupBy(power.alias("power")).agg(F.count("*").alias("n")).collect()}
    low, n = 64, 0
    for at in sorted(sizes, reverse=True):
        n += sizes[at]
        if n > SENT_WORDS:
            break
        low = at
    common = known.where(power >= low).select("w")
    every = rows.where(F.col(words).isNotNull()).groupBy(row_id).agg(F.sum(F.size(words)).alias("all"))
    left = rows.select(row_id, F.explode(words).alias("w")).join(F.broadcast(common), "w", "left_anti")
    if n <= SENT_WORDS:
        missed = left.groupBy(row_id).agg(F.count("*").alias("miss"))
    else:
        rare = known.where(power < low).select("w")
        missed = left.groupBy(row_id, "w").agg(F.count("*").alias("n")).join(rare, "w", "left_anti").groupBy(row_id).agg(F.sum("n").alias("miss"))
    both = every.join(missed.withColumnRenamed(row_id, "_id"), F.col(row_id).eqNullSafe(F.col("_id")), "left")
    return both.select(row_id, "all", F.coalesce("miss", F.lit(0)).alias("miss"))


def lowest_share(df: DataFrame, value: str, row_id: str, seed: int, share: float, descending: bool = False) -> DataFrame:
    """The ``floor(n * share)`` rows with the smallest (largest) whole-number ``value``; ties by digest.

    Driver side: the histogram of ``value`` as one cut value and one order statistic.
    """
    score = -F.col(value) if descending else F.col(value)
    keyed = df.withColumn("_v", score.cast("long"))
    want = int(df.count() * share)
    hist = keyed.groupBy("_v").agg(F.count("*").alias("n"))
    upto = ranking.running_sums(hist.select(F.lit(1).alias("_g"), (-F.col("_v")).alias("_k"), "n"), ["_g"], "_k", ["n"])
    edge = upto.where(F.col("n") >= want).orderBy("n").first()
    if want == 0 or edge is None:
        return df.limit(0)
    cut_value = -edge["_k"]
    below = keyed.where(F.col("_v") < cut_value).count()
    ties = keyed.where(F.col("_v") == cut_value)
    (cut,) = ranking.digest_cuts(ties, row_id, seed, [want - below])
    return keyed.where((F.col("_v") < cut_value) | ((F.col("_v") == cut_value) & ranking.at_or_before(row_id, seed, cut))) \
        .drop("_v")


def nested_subsets(df: DataFrame, row_id: str, seed: int, sizes: Sequence[int]) -> DataFrame:
    """``smallest``: the least of ``sizes`` whose subset holds the row (null beyond the largest)."""
    ordered = sorted(sizes)
    n = df.count()
    chain = F.lit(None).cast("int")
    cuts = ranking.digest_cuts(df, row_id, seed, [min(s, n) for s in ordered])
    for size, cut in reversed(list(zip(ordered, cuts, strict=True))):
        chain = F.when(ranking.at_or_before(row_id, seed, cut), size).otherwise(chain)
    return df.withColumn("smallest", chain)
