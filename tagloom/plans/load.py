"""The loader: a raw table becomes cleaned, labelled, deduplicated, marked rows."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import labels as lb
from ..functions import marks as mk
from ..functions import text as tx
from ..operators import dedupe, labels
from ..session import InputError, cut_lineage


@dataclass(frozen=True)
class LoadSpec:
    """Which columns mean what, and how rows are cleaned and dropped."""

    text_columns: tuple[str, ...]
    label_column: str
    row_id: str = "row_id"
    label_separator: str = ","
    names_column: str | None = None
    weights: dict[str, int] = field(default_factory=dict)
    min_text_length: int = 5
    drop_duplicates: bool = True
    label_filter: str | None = None
    synthetic_rows: str = "train"
    text_cleaning: int = tx.CLEANING_VERSION


@dataclass
class Loaded:
    """``rows(row_id, text, labels, mark)``, ``names(uri, name)`` and one-row ``counters``."""

    rows: DataFrame
    names: DataFrame | None
    counters: DataFrame
    has_marks: bool


def check_columns(df: DataFrame, spec: LoadSpec) -> None:
    missing = [c for c in (*spec.text_columns, spec.label_column, spec.row_id) if c not in df.columns]
    if missing:
        raise InputError(f"columns {missing} not found; the table has {sorted(df.columns)}")


def prepared_rows(df: DataFrame, spec: LoadSpec) -> DataFrame:
    """Every row as ``(row_id, text, labels, mark)``, nothing dropped yet."""
    check_columns(df, spec)
    text = tx.clean_text(tx.assemble(spec.text_columns, spec.weights, df.columns), spec.text_cleaning)
    labels_ = lb.matching(lb.distinct_labels(F.col(f"`{spec.label_column}`"), spec.label_separator), spec.label_filter)
    return df.select(F.col(spec.row_id).alias("row_id"), text.alias("text"), labels_.alias("labels"),
                     mk.mark_bits(df.columns, spec.synthetic_rows).alias("mark")
                     # counts the rows read, and keeps later filters from cleaning each text twice
                     ).observe("rows_read", F.count("*").alias("rows"))


def load(df: DataFrame, spec: LoadSpec, authoritative: DataFrame | None = None, stage: bool = False) -> Loaded:
    """Run the loader; lazy unless ``stage``.

    Keys and texts are read by different branches.  ``stage`` writes the cleaned rows to the
    shared folder first, so that each text is cleaned once and later passes survive lost
    executors; without it the cleaning runs once per branch.
    """
    has_marks = any(c in df.columns for c in mk.MARK_COLUMNS)
    ready = prepared_rows(df, spec)
    rows = (cut_lineage(ready) if stage else ready).where((F.length("text") >= spec.min_text_length) & (F.size("labels") > 0))
    excluding = spec.synthetic_rows == "exclude"
    if spec.drop_duplicates or has_marks:
        rows = rows.withColumn("key", tx.duplicate_key(F.col("text")))
    if spec.drop_duplicates:
        # only ids, keys and marks go through the aggregate; texts move once, by their own id
        summary = dedupe.key_summary(rows, "key", "row_id", "mark", spec.synthetic_rows)
        counters = dedupe.left_out_counts(summary)
        kept = dedupe.keep_marked(rows, summary, "row_id", "mark")
    else:
        gone = mk.has_bit(F.col("mark"), mk.GENERATED) if excluding else F.lit(False)
        counters = rows.agg(F.coalesce(F.sum(gone.cast("int")), F.lit(0)).alias("excluded_rows"),
                            F.coalesce(F.sum(gone.cast("int")), F.lit(0)).alias("excluded_generated"))
        kept = rows.where(~gone)
        if has_marks:
            marked = kept.where("mark > 0").select("key").distinct().withColumn("_same", F.lit(True))
            kept = kept.join(marked, "key", "left").withColumn(
                "mark", F.when(F.col("mark") > 0, F.col("mark"))
                .when(F.col("_same"), mk.SAME_TEXT).otherwise(0).cast("int")).drop("_same")
    names = None
    if spec.names_column and spec.names_column in df.columns:
        pairs = labels.name_pairs(df, spec.row_id, spec.label_column, spec.names_column, spec.label_separator)
        names = labels.first_names(pairs, spec.row_id)
        if authoritative is not None:
            used = df.select(F.explode(lb.distinct_labels(F.col(f"`{spec.label_column}`"), spec.label_separator))
                             .alias("uri")).distinct()
            names = labels.overlay_names(used, names, authoritative)
    return Loaded(kept.drop("key"), names, counters, has_marks)
