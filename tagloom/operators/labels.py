"""Label tables: support, learnable labels, names, task type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import pair_names, parent_namespace, split_labels
from ..session import InputError, beside, broadcast_counted, cut_lineage


def support(rows: DataFrame, labels: str = "labels") -> DataFrame:
    """``(label, n)``: rows per label."""
    return rows.select(F.explode(labels).alias("label")).groupBy("label").agg(F.count("*").alias("n"))


def auto_min_samples(n_rows: Column | int, override: int | None = None) -> Column:
    """Rows a label needs, by table size, unless the caller says."""
    if override is not None:
        return F.lit(max(1, int(override)))
    n = F.lit(n_rows) if isinstance(n_rows, int) else n_rows
    return F.when(n < 1_000, 2).when(n < 10_000, 5).when(n < 50_000, 20).otherwise(35)


def learnable_bounds(rows: DataFrame, labels: str, minimum: int) -> tuple[int, int]:
    """Closed bounds ``(low, high)`` on support that the kept labels satisfy at the fix point.

    A row only drops out when it carries no kept label, so a kept label's support never
    changes; only the number of rows left shrinks.  One aggregate -- rows per smallest eligible
    support -- therefore answers every round, and the loop runs over its few rows on the driver
    (one per distinct support value).
    """
    counts = support(rows, labels)
    # one row per label: sent whole while its counted size is small, so a label of a third of all rows is no hot key
    eligible = broadcast_counted(cut_lineage(counts.where(F.col("n") >= minimum)), "label")
    per_row = (rows.select("row_id", F.explode(labels).alias("label")).join(eligible, "label")
               .groupBy("row_id").agg(F.min("n").alias("least")))
    histogram = sorted((r["least"], r["k"]) for r in
                       per_row.groupBy("least").agg(F.count("*").alias("k")).collect())
    left = rows.count()
    while True:
        high = left - minimum
        now = sum(k for least, k in histogram if least <= high)
        if now == left:
            return minimum, high
        left = now


def learnable_labels(rows: DataFrame, labels: str = "labels", minimum: int = 20) -> DataFrame:
    """Labels with at least ``minimum`` rows with and ``minimum`` rows without them, at the fix point."""
    low, high = learnable_bounds(rows, labels, minimum)
    return support(rows, labels).where(F.col("n").between(low, high))


def targets(rows: DataFrame, kept: DataFrame, labels: str = "labels") -> DataFrame:
    """Long ``(row_id, label)`` of the kept labels; rows without any are gone."""
    return rows.select("row_id", F.explode(labels).alias("label")).join(kept.select("label"), "label", "left_semi")


def ubiquitous_labels(rows: DataFrame, kept: DataFrame, minimum: int, labels: str = "labels") -> DataFrame:
    """Labels with enough rows that were dropped for having too few rows without them."""
    return support(rows, labels).where(F.col("n") >= minimum).join(kept.select("label"), "label", "left_anti")


def teachable_labels(parts: DataFrame, labels: str = "labels") -> DataFrame:
    """Labels the train part shows both with and without; rows they orphan are gone from the count."""
    train = parts.where("part = 'train'")
    low, high = learnable_bounds(train, labels, 1)
    return support(train, labels).where(F.col("n").between(low, high))


def task_type(rows: DataFrame, labels: str = "labels", forced: str | None = None) -> DataFrame:
    """One row: multilabel, multiclass or binary."""
    allowed = ("multilabel", "multiclass", "binary")
    most = rows.agg(F.max(F.size(labels)).alias("most"))
    classes = support(rows, labels).agg(F.count("*").alias("classes"))
    both = beside(most, classes)
    kind = (F.lit(forced) if forced in allowed else
            F.when(F.col("most") > 1, "multilabel").when(F.col("classes") <= 2, "binary").otherwise("multiclass"))
    return both.select(kind.alias("task_type"))


def cardinality(rows: DataFrame, labels: str = "labels") -> DataFrame:
    """Average number of labels per row and the number of rows."""
    return rows.agg(F.avg(F.size(labels)).alias("avg_labels"), F.count("*").alias("n_rows"))


def top_labels(rows: DataFrame, n: int, labels: str = "labels") -> DataFrame:
    """The ``n`` most frequent labels, ties by name."""
    return support(rows, labels).orderBy(F.col("n").desc(), "label").limit(n)


def name_pairs(df: DataFrame, row_id: str, uris: str, names: str, separator: str = ",") -> DataFrame:
    """``(row_id, pos, uri, name)`` of every pairing that lines up."""
    cells = df.select(row_id, split_labels(F.col(uris), separator).alias("_u"),
                      split_labels(F.col(names), separator).alias("_n"))
    return cells.select(row_id, F.posexplode(pair_names(F.col("_u"), F.col("_n"))).alias("pos", "pair")) \
        .select(row_id, "pos", "pair.uri", "pair.name")


def first_names(pairs: DataFrame, row_id: str) -> DataFrame:
    """``(uri, name)``: the pairing of the first row (then position) that names a label."""
    # counted per spelling first, so a frequent label is a handful of rows before the choice
    spelled = pairs.groupBy("uri", "name").agg(F.min(F.struct(row_id, "pos")).alias("at"))
    return spelled.groupBy("uri").agg(F.min_by("name", "at").alias("name"))


def overlay_names(used: DataFrame, derived: DataFrame, authoritative: DataFrame) -> DataFrame:
    """``(uri, name)`` for the labels in use: authoritative names first, blanks ignored."""
    auth = authoritative.where(F.col("name").isNotNull() & (F.col("name") != "")) \
        .select("uri", F.col("name").alias("auth"))
    return (used.join(derived, "uri", "left").join(auth, "uri", "left")
            .select("uri", F.coalesce("auth", "name").alias("name")).where("name is not null"))


def common_namespace(labels: DataFrame, label: str = "label") -> DataFrame:
    """One row: the namespace all labels sit in directly, else null."""
    spaces = labels.select(parent_namespace(F.col(label)).alias("ns"))
    return spaces.agg(F.when((F.count_distinct("ns") == 1) & (F.min("ns") != ""), F.min("ns")).alias("namespace"))


def require_learnable(n_rows: int, n_labels: int, minimum: int) -> None:
    """Refuse what cannot be learned from, with the reason."""
    if n_rows < 10:
        raise InputError(f"too few usable rows ({n_rows}); at least 10 are needed")
    if n_labels < 2:
        raise InputError(f"fewer than 2 labels have {minimum} rows with and without them")


def rarest_label(rows: DataFrame, counts: DataFrame, labels: str = "labels") -> DataFrame:
    """``(row_id, stratum)``: each row's rarest label, ties by name."""
    order = Window.orderBy("n", "label")  # one row per label: bounded by the label set
    ranked = counts.withColumn("_k", F.row_number().over(order))
    least = (rows.select("row_id", F.explode(labels).alias("label")).join(ranked.select("label", "_k"), "label")
             .groupBy("row_id").agg(F.min("_k").alias("_k")))
    return least.join(ranked.select("_k", F.col("label").alias("stratum")), "_k").select("row_id", "stratum")
