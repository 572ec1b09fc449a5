"""Dataset statistics and validation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import beside
from .labels import auto_min_samples, support

THRESHOLDS = (5, 10, 20, 35, 50, 100)  # fixed values


def analyse(rows: DataFrame) -> DataFrame:
    """One row: size, text lengths, labels per row, distinct labels, recommended minimum."""
    base = rows.agg(
        F.count("*").alias("total_samples"),
        F.avg(F.length("text")).alias("mean_length"),
        F.percentile(F.length("text"), F.lit(0.5)).alias("median_length"),
        F.avg(F.size("labels")).alias("mean_labels"), F.max(F.size("labels")).alias("max_labels"))
    both = beside(base, support(rows).agg(F.count("*").alias("unique_labels")))
    return both.withColumn("recommended_min", auto_min_samples(F.col("total_samples")))


def threshold_table(rows: DataFrame, thresholds: Sequence[int] = THRESHOLDS) -> DataFrame:
    """``(threshold, n_labels)``: labels with at least so many rows, and the recommended minimum."""
    total = rows.agg(F.count("*").alias("total"))
    counts = support(rows).agg(*[F.count_if(F.col("n") >= t).alias(f"t{t}") for t in sorted({*thresholds, 2})])
    listed = sorted({*thresholds, 2})
    cells = F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"t{t}").alias("n_labels")) for t in listed])
    both = beside(counts, total)
    return (both.select("total", F.explode(cells).alias("c")).select("total", "c.*")
            .where(F.col("threshold").isin(*thresholds) | (F.col("threshold") == auto_min_samples(F.col("total"))))
            .select("threshold", "n_labels"))


def most_frequent(rows: DataFrame, n: int = 20) -> DataFrame:
    return support(rows).orderBy(F.col("n").desc(), "label").limit(n)


def rare(rows: DataFrame, below: int = 10) -> DataFrame:
    return support(rows).where(F.col("n") < below)


def validate(df: DataFrame, rows: DataFrame | None, text_columns: Sequence[str], label_column: str) -> DataFrame:
    """One row: is the table usable, what is missing, what deserves a warning.

    ``rows`` is the loaded form of ``df`` without length filter and dedupe; not read when
    columns are missing.
    """
    lost = [c for c in text_columns if c not in df.columns]
    errors = ([f"missing text columns: {', '.join(lost)}"] if lost else []) + (
        [f"missing label column: {label_column}"] if label_column not in df.columns else [])
    if errors:
        one = df.sparkSession.range(1)
        return one.select(F.lit(False).alias("valid"), F.lit("; ".join(errors)).alias("errors"),
                          F.lit(0).cast("long").alias("rows_with_labels"), F.lit(0).cast("long").alias("unique_labels"),
                          F.lit(0).cast("long").alias("rare_labels"), F.lit(0).cast("long").alias("rows_without_labels"))
    labelled = rows.agg(F.count_if(F.size("labels") > 0).alias("rows_with_labels"),
                        F.count_if(F.size("labels") == 0).alias("rows_without_labels"))
    labels = support(rows).agg(F.count("*").alias("unique_labels"), F.count_if(F.col("n") < 10).alias("rare_labels"))
    return beside(labelled, labels).select(
        F.lit(True).alias("valid"), F.lit("").alias("errors"), "rows_with_labels", "unique_labels", "rare_labels",
        "rows_without_labels")
