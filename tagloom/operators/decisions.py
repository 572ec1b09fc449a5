"""From scores to answers: array expressions on one row's scores, no shuffle.

``scores`` is an array of structs with ``label`` and ``proba`` (and whatever else they carry).
"""

from __future__ import annotations

from decimal import ROUND_HALF_EVEN, Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.model_tables import Model
from .scoring import baseline


def _named(**fields: Column) -> Column:
    """A struct whose names survive inside lambdas."""
    return F.named_struct(*[x for name, value in fields.items() for x in (F.lit(name), value)])


def ranked(scores: Column) -> Column:
    """Best first, ties in label order."""
    keyed = F.array_sort(F.transform(scores, lambda s: _named(k=-s["proba"], label=s["label"], s=s)))
    return F.transform(keyed, lambda x: x["s"])


def passing(scores: Column) -> Column:
    """Multilabel answer: scores at or above their threshold."""
    return F.filter(scores, lambda s: s["proba"] >= s["threshold"])


def flagged(scores: Column, flag: Column | None = None) -> Column:
    """Entries with ``above_threshold`` (null: not stated)."""
    def one(s: Column) -> Column:
        value = F.lit(None).cast("boolean") if flag is None else flag
        return _named(label=s["label"], proba=s["proba"], above_threshold=value)
    return F.transform(scores, one)


def top_k(scores: Column, k: int, single: bool = False) -> Column:
    """The ``k`` best; in a multilabel model each says whether it would have passed."""
    best = F.slice(ranked(scores), 1, k)
    if single:
        return flagged(best)
    return F.transform(best, lambda s: _named(label=s["label"], proba=s["proba"], above_threshold=s["proba"] >= s["threshold"]))


def argmax(scores: Column) -> Column:
    """Single-label answer."""
    return flagged(F.slice(ranked(scores), 1, 1))


def at_least_one(scores: Column) -> Column:
    """The passing labels; where none passes, the best one, flagged as below."""
    passed = passing(ranked(scores))
    return F.when(F.size(passed) > 0, flagged(passed)).otherwise(flagged(F.slice(ranked(scores), 1, 1), F.lit(False)))


def only_matching(scores: Column, needle: str | None) -> Column:
    return scores if not needle else F.filter(scores, lambda s: F.contains(s["label"], F.lit(needle)))


def resolved_k(k: int | None, avg_labels: float, single: bool) -> int | None:
    """0 means: as many as a row has on average (one for single-label models)."""
    if k is None or k > 0:
        return k
    rounded = int(Decimal(repr(avg_labels)).quantize(Decimal(1), rounding=ROUND_HALF_EVEN))
    return 1 if single else max(1, rounded)


def with_thresholds(scored: DataFrame, model: Model, override: float | None = None) -> DataFrame:
    """Scores in class order get their label's threshold, name, F1 and empty-text score."""
    base = baseline(model)
    facts = F.lit([model.threshold_of(x, override) for x in model.labels])
    names = F.lit([x.name or x.label for x in model.labels])
    f1s = F.array(*[F.lit(x.f1).cast("double") for x in model.labels])
    bases = F.lit([base[x.label] for x in model.labels])
    full = F.transform("scores", lambda s, i: _named(
        label=s["label"], proba=s["proba"], threshold=F.get(facts, i), name=F.get(names, i), f1=F.get(f1s, i),
        baseline_diff=s["proba"] - F.get(bases, i)))
    return scored.withColumn("scores", full)


def decide(scored: DataFrame, model: Model, *, top: int | None = None, threshold: float | None = None,
           label_filter: str | None = None, least_one: bool = False) -> DataFrame:
    """``predictions`` of every row under the model's serving rule."""
    rows = with_thresholds(scored, model, threshold)
    scores = only_matching(F.col("scores"), label_filter)
    k = resolved_k(top, float(model.meta.get("avg_labels", 1.0)), model.single_label)
    if k is not None:
        answer = top_k(scores, k, model.single_label)
    elif model.single_label:
        answer = argmax(scores)
    elif least_one:
        answer = at_least_one(scores)
    else:
        answer = flagged(passing(ranked(scores)))
    return rows.withColumn("predictions", answer)


def answer_lines(answered: DataFrame, names: dict[str, str], row_id: str = "row_id") -> DataFrame:
    """The prediction file: one line per answer, and one empty line for a row without any."""
    long = answered.select(row_id, F.explode_outer("predictions").alias("p"))
    shown = F.col("p.label")
    if names:
        table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
        shown = F.coalesce(F.element_at(table, F.col("p.label")), F.col("p.label"))
    return long.select(
        F.col(row_id).alias("row"), F.coalesce("p.label", F.lit("")).alias("uri"), F.coalesce(shown, F.lit("")).alias("label"),
        F.when(F.col("p.proba").isNull(), "").otherwise(F.format_number("p.proba", 2)).alias("confidence"),
        F.coalesce(F.col("p.above_threshold").cast("string"), F.lit("")).alias("above_threshold"))
