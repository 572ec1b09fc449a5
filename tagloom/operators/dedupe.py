"""First-wins deduplication, merges of sources, and set operations on rows.

A group of copies may hold a third of all rows, so no group is ever sorted or collected: keys
are reduced by a hash aggregate on small fixed-width values, and whole rows are then picked by
their unique id.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import marks as mk
from ..functions.labels import label_set_text
from ..functions.text import normalise_title, normalise_url
from ..session import cut_lineage


def first_ids(df: DataFrame, key: str, row_id: str) -> DataFrame:
    """``(key, kept_id)``: the first row of every key."""
    return df.groupBy(key).agg(F.min(row_id).alias("kept_id"))


def first_wins(df: DataFrame, key: str, row_id: str) -> DataFrame:
    """The first row of every key, whole."""
    kept = first_ids(df, key, row_id).select(F.col("kept_id").alias(row_id))
    return df.join(kept, row_id, "left_semi")


def first_by_rank(df: DataFrame, key: str, rank: str, row_id: str) -> DataFrame:
    """``(key, rank, row_id)`` of the row with the lowest rank, then the lowest id."""
    per_rank = df.groupBy(key, rank).agg(F.min(row_id).alias(row_id))
    return per_rank.groupBy(key).agg(F.min(rank).alias(rank), F.min_by(row_id, rank).alias(row_id))


def conflicting_copies(df: DataFrame, key: str, row_id: str, labels: str = "labels") -> DataFrame:
    """``(key, conflicts)``: copies whose label set differs from the kept row's."""
    # stored: both sides of the join read them
    sets = cut_lineage(df.select(key, row_id, label_set_text(F.col(labels)).alias("_set"))
                       .groupBy(key, "_set").agg(F.count("*").alias("_n"), F.min(row_id).alias("_first")))
    kept = sets.groupBy(key).agg(F.sum("_n").alias("_all"), F.min("_first").alias("_kept"))
    own = sets.select(F.col("_first").alias("_kept"), F.col("_n").alias("_own"))
    return kept.join(own, "_kept").select(key, (F.col("_all") - F.col("_own")).alias("conflicts")) \
        .where("conflicts > 0")


def key_summary(rows: DataFrame, key: str, row_id: str, mark: str, mode: str = "train") -> DataFrame:
    """Per key: the kept row, whether any eligible copy is marked, and what exclusion left out.

    In ``exclude`` mode generated rows go before the dedupe; a text counts once as left out,
    and only if no kept row had shown it before.
    """
    gone = mk.has_bit(F.col(mark), mk.GENERATED) if mode == "exclude" else F.lit(False)
    return rows.select(key, row_id, F.col(mark).alias("_m"), gone.alias("_gone")).groupBy(key).agg(
        F.min(F.when(~F.col("_gone"), F.col(row_id))).alias("kept_id"),
        F.min(F.when(F.col("_gone"), F.col(row_id))).alias("left_id"),
        F.max(F.when(~F.col("_gone"), F.col("_m")).otherwise(0)).alias("any_mark"),
        F.sum(F.col("_gone").cast("int")).alias("left_rows"))


def keep_marked(rows: DataFrame, summary: DataFrame, row_id: str, mark: str) -> DataFrame:
    """Kept rows with their final mark: own bits, else SAME_TEXT where a copy was marked."""
    kept = summary.where("kept_id is not null").select(F.col("kept_id").alias(row_id), "any_mark")
    final = F.when(F.col(mark) > 0, F.col(mark)).when(F.col("any_mark") > 0, mk.SAME_TEXT).otherwise(0)
    return rows.join(kept, row_id).withColumn(mark, final.cast("int")).drop("any_mark")


def left_out_counts(summary: DataFrame) -> DataFrame:
    """One row: generated rows excluded, and texts counted once as excluded."""
    counted = F.col("left_id").isNotNull() & (F.col("kept_id").isNull() | (F.col("left_id") < F.col("kept_id")))
    return summary.agg(F.coalesce(F.sum("left_rows"), F.lit(0)).alias("excluded_rows"),
                       F.coalesce(F.sum(counted.cast("int")), F.lit(0)).alias("excluded_generated"))


# --- merging sources ---------------------------------------------------------------------

def merge_key(url: Column, title: Column) -> Column:
    """Identity in a merge: the address when there is one, else the title, else nothing."""
    u, t = normalise_url(url), normalise_title(title)
    return F.when(u != "", F.concat(F.lit("u:"), u)).when(t != "", F.concat(F.lit("t:"), t))


def merge_sources(sources: Sequence[DataFrame], row_id: str, url: str = "url", title: str = "title") -> DataFrame:
    """All rows by source priority with ``src_rank``, ``merge_key`` and ``kept``."""
    stacked = None
    for rank, df in enumerate(sources):
        one = df.withColumn("src_rank", F.lit(rank))
        stacked = one if stacked is None else stacked.unionByName(one, allowMissingColumns=True)
    keyed = stacked.withColumn("merge_key", merge_key(F.col(url), F.col(title)))
    winners = first_by_rank(keyed.where("merge_key is not null"), "merge_key", "src_rank", row_id) \
        .select("src_rank", row_id, F.lit(True).alias("_won"))
    # joined on the row, never on the key: a key shared by many rows stays spread out
    return keyed.join(winners, ["src_rank", row_id], "left").withColumn(
        "kept", F.col("merge_key").isNull() | F.coalesce(F.col("_won"), F.lit(False))).drop("_won")


def merge_accounting(merged: DataFrame, origin: str = "origin") -> DataFrame:
    """``(origin, outcome, n)``: kept, duplicate by address, duplicate by title."""
    outcome = (F.when(F.col("kept"), "kept").when(F.startswith("merge_key", F.lit("u:")), "duplicate by url")
               .otherwise("duplicate by title"))
    return merged.groupBy(origin, outcome.alias("outcome")).agg(F.count("*").alias("n"))


def drop_reason(context: Column, wanted: str, is_public: Column, labels: Column) -> Column:
    """Why a source row is not taken; null when it is."""
    return (F.when(~F.coalesce(F.array_contains(context, wanted), F.lit(False)), "context")
            .when(F.coalesce(~is_public, F.lit(False)), "not public")
            .when(F.size(labels) == 0, "no label"))


def unseen_texts(raw: DataFrame, known: DataFrame, key: str, row_id: str) -> DataFrame:
    """First copies of texts that are not known yet."""
    candidates = first_ids(raw, key, row_id).join(known.select(key).distinct(), key, "left_anti")
    return raw.join(candidates.select(F.col("kept_id").alias(row_id)), row_id, "left_semi")


def stack_sources(named: dict[str, DataFrame]) -> DataFrame:
    """Rows of several tables under one set of columns, with where they came from."""
    out = None
    for name, df in named.items():
        one = df.withColumn("source", F.lit(name))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out
