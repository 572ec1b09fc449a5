"""A trained model as four tables: meta, labels, vocabulary, coefficients."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import is_container
from ..session import InputError

#: A model's labels are read by the driver; a label set beyond this is refused, not cut.
MAX_LABELS = 20_000
DEFAULT_THRESHOLD = 0.5
LABEL_SCHEMA = ("position int, label string, name string, intercept double, threshold double, f1 double, support long")


@dataclass(frozen=True)
class LabelInfo:
    label: str
    intercept: float
    threshold: float | None = None
    name: str | None = None
    f1: float | None = None
    support: int | None = None


@dataclass
class Model:
    """Tables plus the small facts every task needs (labels in class order, meta)."""

    labels: list[LabelInfo]
    vocab: DataFrame  # block, term, df, idf, column
    coef: DataFrame  # block, term, label, coef
    meta: dict = field(default_factory=dict)

    @property
    def classes(self) -> list[str]:
        return [x.label for x in self.labels]

    @property
    def single_label(self) -> bool:
        return self.meta.get("task_type", "multilabel") in ("binary", "multiclass")

    @property
    def global_threshold(self) -> float:
        return float(self.meta.get("global_threshold", DEFAULT_THRESHOLD))

    def threshold_of(self, info: LabelInfo, override: float | None = None) -> float:
        if override is not None:
            return override
        return self.global_threshold if info.threshold is None else info.threshold

    def label_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(
            [(i, x.label, x.name, float(x.intercept), x.threshold, x.f1, x.support) for i, x in enumerate(self.labels)],
            LABEL_SCHEMA)


def collect_labels(frame: DataFrame) -> list[LabelInfo]:
    """The label table on the driver, refused beyond ``MAX_LABELS``."""
    rows = frame.orderBy("position").limit(MAX_LABELS + 1).collect()
    if len(rows) > MAX_LABELS:
        raise InputError(f"more than {MAX_LABELS} labels")
    return [LabelInfo(r["label"], r["intercept"], r["threshold"], r["name"], r["f1"], r["support"]) for r in rows]


def inconsistencies(vocab: DataFrame, coef: DataFrame, labels: DataFrame) -> DataFrame:
    """``(problem, n)`` of parts that do not fit each other; empty for a sound model."""
    keys = coef.select("block", "term").distinct()
    checks = {
        "coefficient without vocabulary": keys.join(vocab, ["block", "term"], "left_anti"),
        "coefficient without label": coef.select("label").distinct().join(labels, "label", "left_anti"),
        "label without coefficient": labels.join(coef.select("label").distinct(), "label", "left_anti"),
        "duplicate term": vocab.groupBy("block", "term").count().where("count > 1"),
    }
    out = None
    for problem, bad in checks.items():
        one = bad.agg(F.lit(problem).alias("problem"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out.where("n > 0")


def save(model: Model, path: str, spark: SparkSession) -> None:
    """Write the tables; an existing model is never overwritten, an inconsistent one not written."""
    frame = model.label_frame(spark)
    bad = inconsistencies(model.vocab, model.coef, frame).collect()
    if bad:
        raise InputError("; ".join(f"{r['problem']}: {r['n']}" for r in bad))
    model.vocab.write.mode("errorifexists").parquet(f"{path}/model_vocab")
    model.coef.write.mode("errorifexists").partitionBy("block").parquet(f"{path}/model_coef")
    frame.write.mode("errorifexists").parquet(f"{path}/model_label")
    spark.createDataFrame([(json.dumps(model.meta),)], "meta string").write.mode("errorifexists").parquet(f"{path}/model_meta")


def load(spark: SparkSession, path: str) -> Model:
    """Read a stored model back; refused when its parts do not fit."""
    vocab, coef = spark.read.parquet(f"{path}/model_vocab"), spark.read.parquet(f"{path}/model_coef")
    frame = spark.read.parquet(f"{path}/model_label")
    bad = inconsistencies(vocab, coef, frame).collect()
    if bad:
        raise InputError("; ".join(f"{r['problem']}: {r['n']}" for r in bad))
    meta = json.loads(spark.read.parquet(f"{path}/model_meta").first()["meta"])
    return Model(collect_labels(frame), vocab, coef, meta)


def prune(model: Model, doomed: Sequence[str] | None = None) -> Model:
    """Without the given labels (default: containers); kept labels' scores cannot change.

    Macro F1 becomes the mean of the kept labels; what cannot be recomputed is moved aside.
    """
    gone = {x for x in model.classes if x.endswith("/")} if doomed is None else set(doomed)
    kept = [x for x in model.labels if x.label not in gone]
    metrics = dict(model.meta.get("metrics", {}))
    scores = [x.f1 for x in kept if x.f1 is not None]
    stale = {k: metrics.pop(k) for k in ("f1_micro", "precision_macro", "recall_macro") if k in metrics}
    if scores:
        metrics["f1_macro"] = sum(scores) / len(scores)
    if stale:
        metrics["metrics_before_pruning"] = stale
    coef = model.coef.where(~is_container(F.col("label"))) if doomed is None else model.coef.where(~F.col("label").isin(*gone))
    meta = {**model.meta, "metrics": metrics, "n_labels": len(kept), "pruned_labels": sorted(gone)}
    return replace(model, labels=kept, coef=coef, meta=meta)


def with_names(model: Model, names: dict[str, str]) -> Model:
    """Display names replaced where an authoritative one is known; nothing else changes."""
    return replace(model, labels=[replace(x, name=names.get(x.label) or x.name) for x in model.labels])
