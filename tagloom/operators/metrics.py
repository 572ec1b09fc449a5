"""Truth against predictions: alignment, scores per label, macro and micro, comparisons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import beside


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    return F.when(2 * tp + fp + fn > 0, 2 * tp / (2 * tp + fp + fn)).otherwise(0.0)


def align(truth: DataFrame, predicted: DataFrame, space: Sequence[str]) -> DataFrame:
    """``(row_id, label, truth, predicted)`` in the model's label space.

    ``truth(row_id, labels)`` rows without any label of the space take no part.
    """
    space = list(space)
    known = truth.select("row_id", F.filter("labels", lambda x: x.isin(*space)).alias("labels")).where(F.size("labels") > 0)
    is_true = known.select("row_id", F.explode("labels").alias("label")).withColumn("_t", F.lit(True))
    asserted = (predicted.where(F.col("label").isin(*space)).join(known.select("row_id"), "row_id", "left_semi")
                .withColumn("_p", F.lit(True)))
    return is_true.join(asserted, ["row_id", "label"], "full_outer").select(
        "row_id", "label", F.coalesce("_t", F.lit(False)).alias("truth"), F.coalesce("_p", F.lit(False)).alias("predicted"))


def coverage(truth: DataFrame, space: Sequence[str]) -> DataFrame:
    """One row: rows scored and not, labels covered, unknown labels counted and listed."""
    space = list(space)
    has = F.exists("labels", lambda x: x.isin(*space))
    rows = truth.agg(F.count_if(has).alias("n_rows"), F.count_if(~has).alias("rows_without_a_known_label"))
    used = truth.select(F.explode("labels").alias("label")).distinct()
    unknown = used.where(~F.col("label").isin(*space))
    listed = unknown.agg(
        F.array_join(F.array_sort(F.collect_list("label")), ",").alias("unknown_labels"))
    counts = used.agg(F.count_if(~F.col("label").isin(*space)).alias("n_unknown_labels"),
                      F.count_if(F.col("label").isin(*space)).alias("labels_covered"))
    return beside(beside(rows, counts), listed)


def shared_space(models: Sequence[DataFrame], holdout: DataFrame) -> DataFrame:
    """Labels every model knows and the holdout carries."""
    out = holdout.select("label").distinct()
    for one in models:
        out = out.join(one.select("label").distinct(), "label", "left_semi")
    return out


def label_counts(decided: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Per label (and group): positives, true and false positives, false negatives, F1.

    ``decided`` has ``label``, ``y`` (0/1) and ``p`` (0/1); one map-side-combined aggregate.
    """
    y, p = F.col("y"), F.col("p")
    sums = decided.groupBy(*groups, "label").agg(
        F.sum(y).cast("long").alias("positives"), F.sum(y * p).cast("long").alias("tp"),
        F.sum((1 - y) * p).cast("long").alias("fp"), F.sum(y * (1 - p)).cast("long").alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return sums.select("*", f1(tp, fp, fn).alias("f1"),
                       F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0).alias("precision"),
                       F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0).alias("recall"))


def summarise(counts: DataFrame, n_rows: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Macro over labels with positives (and ``scorable``, if that column is there), micro over all.

    When no label qualifies, all of them count.  ``n_rows`` has the groups and ``n_rows``.
    """
    groups = list(groups)
    ok = F.col("positives") > 0
    if "scorable" in counts.columns:
        ok = ok & F.col("scorable")
    c = counts.withColumn("_ok", ok)

    def macro(col: str) -> Column:
        return F.coalesce(F.avg(F.when(F.col("_ok"), F.col(col))), F.avg(col))

    tp, fp, fn = F.sum("tp"), F.sum("fp"), F.sum("fn")
    agg = c.groupBy(*groups).agg(
        macro("f1").alias("f1_macro"), f1(tp, fp, fn).alias("f1_micro"), macro("precision").alias("precision_macro"),
        macro("recall").alias("recall_macro"), F.count("*").alias("n_labels"),
        F.when(F.count_if("_ok") > 0, F.count_if(~F.col("_ok"))).otherwise(0).alias("labels_not_scored"),
        (tp + fp).alias("_asserted"), (tp + fn).alias("_true"))
    joined = agg.join(n_rows, groups) if groups else beside(agg, n_rows)
    return joined.select(*groups, "f1_macro", "f1_micro", "precision_macro", "recall_macro", "n_labels", "labels_not_scored",
                         F.round(F.col("_asserted") / F.col("n_rows"), 3).alias("predicted_labels_per_row"),
                         F.round(F.col("_true") / F.col("n_rows"), 3).alias("true_labels_per_row"))


def weakest_first(model_labels: DataFrame, n: int | None = 10) -> DataFrame:
    """Labels by F1, unscored last; the ``n`` weakest."""
    ordered = model_labels.orderBy(F.col("f1").asc_nulls_last(), "label")
    return ordered if n is None else ordered.limit(n)


def weak_labels(model_labels: DataFrame, below: float) -> DataFrame:
    return model_labels.where(F.col("f1") < below).orderBy("f1", "label")


def compare_models(counts: DataFrame, weak: Sequence[str]) -> DataFrame:
    """Per model: micro and macro F1 over the shared space, and macro over the weak labels."""
    weak = list(weak)
    return counts.groupBy("model").agg(
        f1(F.sum("tp"), F.sum("fp"), F.sum("fn")).alias("micro"), F.avg("f1").alias("macro"),
        F.avg(F.when(F.col("label").isin(*weak), F.col("f1"))).alias("macro_weak"))


def per_label_by_model(counts: DataFrame, models: Sequence[str]) -> DataFrame:
    """Labels as rows, one F1 column per model."""
    return counts.groupBy("label").pivot("model", list(models)).agg(F.first("f1"))


def spread(per_label: DataFrame, arm: str = "arm", draw: str = "draw") -> DataFrame:
    """Spread over repeated draws per arm: macro mean and sd, per-label sd mean and worst."""
    macro = per_label.groupBy(arm, draw).agg(F.avg("f1").alias("m")).groupBy(arm).agg(
        F.avg("m").alias("macro_mean"), F.stddev_pop("m").alias("macro_sd"))
    labels = per_label.groupBy(arm, "label").agg(F.stddev_pop("f1").alias("s")).groupBy(arm).agg(
        F.avg("s").alias("label_sd_mean"), F.max("s").alias("label_sd_worst"))
    return macro.join(labels, arm)


def search_report(curve: DataFrame, grids: dict[str, Sequence[float]]) -> DataFrame:
    """For every grid: the C it picks (first best wins), its score, and whether it sits on the edge."""
    cells = F.array(*[F.struct(F.lit(name).alias("grid"), F.lit(float(c)).alias("c"), F.lit(i).alias("at"))
                      for name, grid in grids.items() for i, c in enumerate(grid)])
    listed = curve.withColumn("_g", F.explode(F.filter(cells, lambda g: g["c"] == F.col("c"))))
    best = listed.groupBy(F.col("_g.grid").alias("grid")).agg(
        F.max(F.struct(F.col("f1"), (-F.col("_g.at")).alias("at"), F.col("c"))).alias("b"),
        F.min("c").alias("lo"), F.max("c").alias("hi"))
    return best.select("grid", F.col("b.c").alias("picked_c"), F.col("b.f1").alias("f1"),
                       F.col("b.c").isin(F.col("lo"), F.col("hi")).alias("on_edge"))


def scaling_exponent(costs: DataFrame, rows: str, cost: str, target_rows: float, groups: Sequence[str] = ()) -> DataFrame:
    """Log-log slope of cost against rows, and the cost extrapolated to ``target_rows``."""
    ln = costs.withColumn("_x", F.ln(rows)).withColumn("_y", F.ln(cost))
    fit = ln.groupBy(*groups).agg(F.regr_slope("_y", "_x").alias("exponent"), F.regr_intercept("_y", "_x").alias("_i"))
    return fit.withColumn("projected", F.exp("_i") * F.pow(F.lit(float(target_rows)), F.col("exponent"))).drop("_i")


def adoption_gate(runs: DataFrame, base: str, min_gain: float = 0.002, max_more_labels: float = 0.10) -> DataFrame:
    """Each run against the ``base`` run: enough macro gain without asserting too many more labels."""
    ref = runs.where(F.col("run") == base).select(
        "dataset", F.col("f1_macro").alias("_f"), F.col("labels_per_row").alias("_l"))
    gain = F.col("f1_macro") - F.col("_f")
    more = F.col("labels_per_row") / F.col("_l") - 1
    return runs.where(F.col("run") != base).join(ref, "dataset").select(
        "dataset", "run", gain.alias("gain"), more.alias("more_labels"),
        ((gain >= min_gain) & (more <= max_more_labels)).alias("adopt"))


def against_base(metrics: DataFrame, base: str, columns: Sequence[str] = ("f1_macro", "f1_micro")) -> DataFrame:
    """Deltas of every variant to the base variant."""
    one = metrics.where(F.col("variant") == base).select(
        F.lit(1).alias("_k"), *[F.col(c).alias(f"_{c}") for c in columns])
    return metrics.withColumn("_k", F.lit(1)).join(one, "_k").select(
        "variant", *columns, *[(F.col(c) - F.col(f"_{c}")).alias(f"d_{c}") for c in columns])


def same_rows(rows: DataFrame) -> DataFrame:
    """One row: did all variants keep the same row set (order-free digest per variant)."""
    per = rows.groupBy("variant").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("row_id")).alias("x"),
                                      F.sum(F.xxhash64("row_id").cast("decimal(38,0)")).alias("s"))
    return per.agg((F.count_distinct("n", "x", "s") == 1).alias("same_rows"))
