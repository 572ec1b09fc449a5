"""The corrections log: export, backup, import, review pages; and the run history."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import preview, spreadsheet_safe
from ..session import beside, cut_lineage
from ..sources.commits import AppendTable
from .dedupe import first_ids
from .paging import page


@dataclass(frozen=True)
class Bounds:
    """What a correction may hold; callers may set other bounds."""

    # --- fixed values: bounds of one correction ------------------------------------------
    text_chars: int = 100_000
    labels: int = 100
    label_chars: int = 500
    source_chars: int = 50
    # -------------------------------------------------------------------------------------


IDENTITY = ("recorded_at", "model_name", "text", "predicted", "corrected")


def training_rows(log: DataFrame) -> DataFrame:
    """``(pos, text, labels)`` of corrections that carry a label, spreadsheet-safe."""
    trainable = log.where(F.col("text").isNotNull() & (F.size("corrected") > 0))
    return trainable.select("pos", spreadsheet_safe(F.col("text")).alias("text"),
                            spreadsheet_safe(F.array_join("corrected", ",")).alias("labels"))


def export_page(log: DataFrame, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Training rows oldest first, paged over the rows that are exported."""
    return page(training_rows(log), "pos", limit, offset)


def backup_lines(log: DataFrame) -> DataFrame:
    """``value``: every record as one JSON line, all fields."""
    return log.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def identity(prefix: str = "") -> Column:
    """Digest of what makes two records the same correction."""
    return F.sha2(F.to_json(F.struct(*[F.col(prefix + c) for c in IDENTITY]), {"ignoreNullFields": "false"}), 256)


def problems(bounds: Bounds = Bounds()) -> Column:
    """What is wrong with a correction on its way in; empty for a valid one."""
    def too_much(col: str) -> Column:
        return ~((F.size(col) <= bounds.labels) & F.forall(col, lambda x: F.length(x) <= bounds.label_chars))

    rules = {
        "text": ~F.length("text").between(1, bounds.text_chars),
        "recorded_at": F.col("recorded_at").isNull(),
        "model_name": ~F.col("model_name").rlike(r"^[^/\\\x{00}-\x{1F}]+$"),
        "predicted": too_much("predicted"),
        "corrected": too_much("corrected"),
        "source": F.length(F.coalesce("source", F.lit("ui"))) > bounds.source_chars,
    }
    # a rule that cannot be decided because of a null is broken
    return F.array_compact(F.array(*[F.when(F.coalesce(broken, F.lit(True)), name) for name, broken in rules.items()]))


def classify_import(incoming: DataFrame, log: DataFrame | None, bounds: Bounds = Bounds()) -> DataFrame:
    """Each incoming record with ``problems`` and ``outcome``: imported, duplicate or invalid (order column ``pos``)."""
    checked = incoming.withColumn("problems", problems(bounds)).withColumn("_valid", F.size("problems") == 0).withColumn("_id", identity())
    fresh = first_ids(checked.where("_valid"), "_id", "pos")
    if log is not None:
        fresh = fresh.join(log.select(identity().alias("_id")).distinct(), "_id", "left_anti")
    picked = fresh.select(F.col("kept_id").alias("pos"), F.lit(True).alias("_new"))
    return checked.join(picked, "pos", "left").withColumn(
        "outcome", F.when(~F.col("_valid"), "invalid").when(F.col("_new"), "imported").otherwise("duplicate")
    ).drop("_valid", "_id", "_new")


def import_into(table: AppendTable, incoming: DataFrame, batch: str, bounds: Bounds = Bounds()) -> dict[str, int]:
    """Add the new records among ``incoming`` to the log, all of them or none; how many were new, known and invalid.

    A batch that was added before is not added again, and its counts are those of the first time.
    """
    def new_records(log: DataFrame | None) -> tuple[DataFrame, dict[str, int]]:
        outcomes = cut_lineage(classify_import(incoming, log, bounds))
        counts = import_counts(outcomes).first().asDict()
        return outcomes.where("outcome = 'imported'").select(incoming.columns), counts

    return table.append(new_records, batch).facts


def import_counts(classified: DataFrame) -> DataFrame:
    return classified.agg(*[F.count_if(F.col("outcome") == o).alias(a) for o, a in
                            (("imported", "imported"), ("duplicate", "duplicates"), ("invalid", "invalid"))])


def review_page(log: DataFrame, model: str | None, limit: int, offset: int = 0) -> DataFrame:
    """Newest first, texts shortened for the screen."""
    shown, cut = preview(F.col("text"))
    chosen = log if model is None else log.where(F.col("model_name") == model)
    return (page(chosen, "pos", limit, offset, newest_first=True)
            .withColumn("text_truncated", cut).withColumn("text", shown))


def per_model(log: DataFrame) -> DataFrame:
    return log.groupBy("model_name").agg(F.count("*").alias("n"))


def recent_runs(history: DataFrame, limit: int = 50) -> DataFrame:
    """The newest ``limit`` runs."""
    return history.orderBy(F.col("pos").desc()).limit(limit)


def name_repair(model_labels: DataFrame, names: DataFrame) -> DataFrame:
    """Model labels with the authoritative name where there is one, and what that changed."""
    auth = names.where(F.coalesce(F.col("name"), F.lit("")) != "").select("label", F.col("name").alias("auth"))
    joined = model_labels.join(auth, "label", "left")
    status = (F.when(F.col("auth").isNull() & (F.coalesce("name", F.lit("")) == ""), "nameless")
              .when(F.col("auth").isNull() | (F.col("auth") == F.col("name")), "unchanged")
              .when(F.col("name").isNull(), "added").otherwise("corrected"))
    return joined.withColumn("status", status).withColumn("name", F.coalesce("auth", "name")).drop("auth")


def repair_counts(repaired: DataFrame) -> DataFrame:
    return repaired.groupBy("status").agg(F.count("*").alias("n"))


def page_totals(log: DataFrame, model: str) -> DataFrame:
    """One row: records of the model, and of all models."""
    return beside(log.where(F.col("model_name") == model).agg(F.count("*").alias("total")),
                  log.agg(F.count("*").alias("all_records")))
