"""Thresholds, metrics and studies (H and E rows of the inventory, and the candidate choice M3)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import metrics as me
from ..operators import thresholds as op
from ..operators.provenance import real_support
from .labels import SPEC, labelled, loaded
from .registry import Catalog
from .views import LABEL_SET, items, scored_long, table, with_views

CATALOG = Catalog()
add = CATALOG.add


def scores(spark, sf):
    return scored_long(spark, sf).select(F.col("item_id").alias("row_id"), "label", "y", (F.col("pm") / 1000.0).alias("proba"), "pm")


_CUTS = """cells AS (SELECT label, c / 100.0::DOUBLE AS cut, sum(y) AS positives, sum(CASE WHEN pm >= c * 10 THEN y ELSE 0 END) AS hits, count(*) FILTER (WHERE pm >= c * 10) AS asserted
 FROM scored CROSS JOIN (SELECT unnest(range(5, 100, 5)) AS c) GROUP BY label, c),
cut_f1 AS (SELECT label, cut, CAST(positives AS BIGINT) AS positives, CASE WHEN asserted + positives > 0 THEN 2.0::DOUBLE * hits / (asserted + positives) ELSE 0 END AS f1 FROM cells),
best AS (SELECT cut AS g FROM (SELECT cut, avg(f1) AS m FROM cut_f1 GROUP BY cut) ORDER BY round(m, 12) DESC, cut LIMIT 1),
own AS (SELECT label, positives, f1, cut, row_number() OVER (PARTITION BY label ORDER BY f1 DESC, cut) AS rn FROM cut_f1)"""


@add("h1_cut_scores", with_views("scored", "SELECT label, round(cut, 2) AS cut, positives, round(f1, 9) AS f1 FROM cut_f1", _CUTS))
def h1(spark, sf):
    return op.cut_scores(scores(spark, sf)).select("label", "cut", "positives", F.round("f1", 9).alias("f1"))


@add("h2_global_cut", with_views("scored", "SELECT round(g, 2) AS global_cut FROM best", _CUTS))
def h2(spark, sf):
    return op.global_cut(op.cut_scores(scores(spark, sf))).select("global_cut")


@add("h3_label_cuts", with_views("scored", """
SELECT label, round(CASE WHEN positives > 0 AND f1 > 0 THEN cut ELSE g END, 2) AS threshold, round(g, 2) AS global_cut FROM own, best WHERE rn = 1""", _CUTS))
def h3(spark, sf):
    return op.label_cuts(op.cut_scores(scores(spark, sf)))


@add("h4_shrinkage", with_views("scored", """
SELECT label, round(CASE WHEN positives > 0 AND f1 > 0 THEN positives * 1.0::DOUBLE / (positives + 50) * cut + (1 - positives * 1.0::DOUBLE / (positives + 50)) * g ELSE g END, 5) AS threshold FROM own, best WHERE rn = 1""", _CUTS))
def h4(spark, sf):
    return op.label_cuts(op.cut_scores(scores(spark, sf)), shrink_k=50.0).select("label", F.round("threshold", 5).alias("threshold"))


@add("h5_pinned_labels", with_views("scored", """
SELECT label, round(CASE WHEN positives > 0 AND f1 > 0 AND label NOT LIKE '%/flag/%' THEN cut ELSE g END, 2) AS threshold FROM own, best WHERE rn = 1""", _CUTS))
def h5(spark, sf):
    # thin labels: those few real rows carry
    classes = scores(spark, sf).select("label").distinct()
    pinned = classes.where(F.contains("label", F.lit("/flag/")))
    return op.label_cuts(op.cut_scores(scores(spark, sf)), pinned=pinned).select("label", "threshold")


@add("h7_exhaustive_cuts", with_views("scored", """
SELECT label, pm / 1000.0::DOUBLE AS threshold, round(f1, 9) AS f1 FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(f1, 12) DESC, pm DESC) AS rn FROM (
 SELECT label, pm, 2.0::DOUBLE * sum(h) OVER w / (sum(n) OVER w + sum(h) OVER (PARTITION BY label)) AS f1, sum(h) OVER (PARTITION BY label) AS pos
 FROM (SELECT label, pm, sum(y) AS h, count(*) AS n FROM scored GROUP BY ALL) WINDOW w AS (PARTITION BY label ORDER BY pm DESC)) WHERE pos > 0) WHERE rn = 1"""))
def h7(spark, sf):
    return op.exhaustive_cuts(scores(spark, sf)).select("label", "threshold", F.round("f1", 9).alias("f1"))


def candidates(spark, sf):
    """Scripted out-of-fold scores of three candidates."""
    shift = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.lit(k).alias("k")) for c, k in ((2.0, 0), (8.0, 1), (32.0, 2))])).alias("s")
    moved = F.col("pm") + F.when(F.col("s.k") > 0, ((F.col("row_id") * 31 + F.length("label") * 17) % (60 * F.col("s.k"))).cast("int")).otherwise(0)
    return scores(spark, sf).select("row_id", "label", "y", "pm", shift).select(
        F.col("s.c").alias("c"), "row_id", "label", "y", (F.least(moved, F.lit(999)) / 1000.0).alias("proba"))


_CAND = """cand AS (SELECT k.c, s.item_id, s.label, s.y, least(s.pm + CASE WHEN k.k > 0 THEN (s.item_id * 31 + length(s.label) * 17) % (60 * k.k) ELSE 0 END, 999) AS pm
 FROM scored s CROSS JOIN (VALUES (2.0::DOUBLE, 0), (8.0, 1), (32.0, 2)) k(c, k)),
cc AS (SELECT c, label, g, CASE WHEN a + p > 0 THEN 2.0::DOUBLE * h / (a + p) ELSE 0 END AS f1, p FROM (SELECT c, label, g, sum(y) AS p, sum(CASE WHEN pm >= g * 10 THEN y ELSE 0 END) AS h, count(*) FILTER (WHERE pm >= g * 10) AS a
  FROM cand CROSS JOIN (SELECT unnest(range(5, 100, 5)) AS g) GROUP BY ALL)),
gb AS (SELECT c, g FROM (SELECT c, g, row_number() OVER (PARTITION BY c ORDER BY round(avg(f1), 12) DESC, g) AS rn FROM cc GROUP BY c, g) WHERE rn = 1),
ob AS (SELECT c, label, p, f1, g FROM (SELECT *, row_number() OVER (PARTITION BY c, label ORDER BY f1 DESC, g) AS rn FROM cc) WHERE rn = 1),
th AS (SELECT o.c, o.label, CASE WHEN o.p > 0 AND o.f1 > 0 THEN o.g ELSE b.g END AS t FROM ob o JOIN gb b ON b.c = o.c),
lf AS (SELECT c, label, 2.0::DOUBLE * sum(CASE WHEN pm >= t * 10 THEN y ELSE 0 END) / nullif(count(*) FILTER (WHERE pm >= t * 10) + sum(y), 0) AS f1 FROM cand JOIN th USING (c, label) GROUP BY c, label),
mf AS (SELECT c, avg(coalesce(f1, 0)) AS m FROM lf GROUP BY c)"""


@add("m3_c_under_own_thresholds", with_views("scored", """
SELECT c, round(m, 9) AS f1_macro, row_number() OVER (ORDER BY round(m, 12) DESC, c) = 1 AS chosen FROM mf""", _CAND))
def m3(spark, sf):
    return op.choose_c(candidates(spark, sf), [2.0, 8.0, 32.0]).select("c", F.round("f1_macro", 9).alias("f1_macro"), "chosen")


_COUNTS = """lc AS (SELECT label, sum(y) AS pos, sum(CASE WHEN pm >= 500 THEN y ELSE 0 END) AS tp, sum(CASE WHEN pm >= 500 THEN 1 - y ELSE 0 END) AS fp, sum(CASE WHEN pm < 500 THEN y ELSE 0 END) AS fn FROM scored GROUP BY label),
lf AS (SELECT *, CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0::DOUBLE * tp / (2 * tp + fp + fn) ELSE 0 END AS f1, CASE WHEN tp + fp > 0 THEN tp * 1.0::DOUBLE / (tp + fp) ELSE 0 END AS pr, CASE WHEN tp + fn > 0 THEN tp * 1.0::DOUBLE / (tp + fn) ELSE 0 END AS re FROM lc)"""


def decided(spark, sf, cut=500):
    return scores(spark, sf).select("row_id", "label", "y", (F.col("pm") >= cut).cast("int").alias("p"))


@add("e1_metrics", with_views("scored", """
SELECT round(avg(f1) FILTER (WHERE pos > 0), 9) AS f1_macro, round(2.0::DOUBLE * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 9) AS f1_micro, round(avg(pr) FILTER (WHERE pos > 0), 9) AS precision_macro,
 round(avg(re) FILTER (WHERE pos > 0), 9) AS recall_macro, count(*) AS n_labels, count(*) FILTER (WHERE pos = 0) AS labels_not_scored,
 round(sum(tp + fp) * 1.0::DOUBLE / (SELECT count(*) FROM items), 3) AS predicted_labels_per_row, round(sum(tp + fn) * 1.0::DOUBLE / (SELECT count(*) FROM items), 3) AS true_labels_per_row FROM lf""", _COUNTS))
def e1(spark, sf):
    out = me.summarise(me.label_counts(decided(spark, sf)), items(spark, sf).agg(F.count("*").alias("n_rows")))
    nine = ("f1_macro", "f1_micro", "precision_macro", "recall_macro")
    return out.select(*[F.round(c, 9).alias(c) for c in nine], "n_labels", "labels_not_scored", "predicted_labels_per_row", "true_labels_per_row")


@add("e1_per_label", with_views("scored", "SELECT label, CAST(pos AS BIGINT) AS positives, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, round(f1, 9) AS f1 FROM lf", _COUNTS))
def e1_labels(spark, sf):
    return me.label_counts(decided(spark, sf)).select("label", "positives", "tp", "fp", "fn", F.round("f1", 9).alias("f1"))


@add("e2_evaluate_other_table", with_views("scored", """
SELECT count(DISTINCT item_id) AS n_rows, count(DISTINCT label) FILTER (WHERE y = 1) AS labels_covered,
 round((SELECT avg(f) FROM (SELECT 2.0::DOUBLE * sum(CASE WHEN pm >= 500 THEN y ELSE 0 END) / (count(*) FILTER (WHERE pm >= 500) + sum(y)) AS f FROM ev GROUP BY label HAVING sum(y) > 0)), 9) AS f1_macro FROM ev""",
     """ev AS (SELECT s.* FROM scored s JOIN items i USING (item_id) WHERE trim(generated_for) = '' AND trim(example_for) = '' AND trim(enriched_fields) = ''
  AND item_id IN (SELECT item_id FROM scored WHERE y = 1))"""))
def e2(spark, sf):
    from ..functions.marks import mark_bits
    df = items(spark, sf)
    real = df.select(F.col("item_id").alias("row_id"), mark_bits(df.columns).alias("mark")).where("mark = 0")
    rows = decided(spark, sf).join(real, "row_id", "left_semi")
    known = rows.where("y = 1").select("row_id").distinct()
    rows = rows.join(known, "row_id", "left_semi")
    counts = me.label_counts(rows)
    n = rows.agg(F.count_distinct("row_id").alias("n_rows"))
    covered = counts.agg(F.count_if(F.col("positives") > 0).alias("labels_covered"))
    from ..session import beside
    return beside(beside(n, covered), me.summarise(counts, n)).select("n_rows", "labels_covered", F.round("f1_macro", 9).alias("f1_macro"))


@add("e3_weakest_labels", with_views("scored", "SELECT label, f1, positives FROM (SELECT label, CASE WHEN pos > 0 THEN round(f1, 9) END AS f1, CAST(pos AS BIGINT) AS positives FROM lf) ORDER BY f1 NULLS LAST, label LIMIT 5", _COUNTS))
def e3(spark, sf):
    diag = me.label_counts(decided(spark, sf)).select(
        "label", F.when(F.col("positives") > 0, F.round("f1", 9)).alias("f1"), "positives")
    return me.weakest_first(diag, 5)


_MODELS = """mc AS (SELECT m AS model, label, sum(CASE WHEN pm >= t THEN y ELSE 0 END) AS tp, sum(CASE WHEN pm >= t THEN 1 - y ELSE 0 END) AS fp, sum(CASE WHEN pm < t THEN y ELSE 0 END) AS fn
 FROM scored CROSS JOIN (VALUES ('a', 400), ('b', 600)) v(m, t) WHERE label IN (SELECT label FROM scored WHERE y = 1) GROUP BY ALL),
mf AS (SELECT *, CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0::DOUBLE * tp / (2 * tp + fp + fn) ELSE 0 END AS f1 FROM mc)"""
_WEAK = ["http://v/flag/quality", "http://v/flag/toxic"]


def by_model(spark, sf):
    two = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.lit(t).alias("t")) for m, t in (("a", 400), ("b", 600))])).alias("m")
    rows = scores(spark, sf).select("row_id", "label", "y", "pm", two).select(
        "m.model", "row_id", "label", "y", (F.col("pm") >= F.col("m.t")).cast("int").alias("p"))
    carried = scores(spark, sf).where("y = 1").select("label").distinct()
    return me.label_counts(rows.join(carried, "label", "left_semi"), ["model"])


@add("e4_compare_models", with_views("scored", """
SELECT model, round(2.0::DOUBLE * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 9) AS micro, round(avg(f1), 9) AS macro, round(avg(f1) FILTER (WHERE label LIKE '%/flag/%'), 9) AS macro_weak FROM mf GROUP BY model""", _MODELS))
def e4(spark, sf):
    out = me.compare_models(by_model(spark, sf), _WEAK)
    return out.select("model", *[F.round(c, 9).alias(c) for c in ("micro", "macro", "macro_weak")])


@add("e4_labels_by_model", with_views("scored", "SELECT label, round(max(f1) FILTER (WHERE model = 'a'), 9) AS a, round(max(f1) FILTER (WHERE model = 'b'), 9) AS b FROM mf GROUP BY label", _MODELS))
def e4_labels(spark, sf):
    return me.per_label_by_model(by_model(spark, sf), ["a", "b"]).select("label", F.round("a", 9).alias("a"), F.round("b", 9).alias("b"))


@add("e5_weak_labels", with_views("scored", "SELECT label, round(f1, 9) AS f1 FROM lf WHERE f1 < 0.6 ORDER BY f1, label", _COUNTS))
def e5(spark, sf):
    return me.weak_labels(me.label_counts(decided(spark, sf)), 0.6).select("label", F.round("f1", 9).alias("f1"))


_DRAWS = """dr AS (SELECT arm, draw, label, 2.0::DOUBLE * sum(CASE WHEN pm >= 500 THEN y ELSE 0 END) / nullif(count(*) FILTER (WHERE pm >= 500) + sum(y), 0) AS f1
 FROM (SELECT 'random' AS arm, item_id % 4 AS draw, label, pm, y FROM scored UNION ALL SELECT 'blocked', item_id // 8 % 4, label, pm, y FROM scored) GROUP BY ALL)"""


@add("e6_spread_over_draws", with_views("scored", """
SELECT arm, round(macro_mean, 5) AS macro_mean, round(macro_sd, 5) AS macro_sd, round(label_sd_mean, 5) AS label_sd_mean, round(label_sd_worst, 5) AS label_sd_worst FROM
 (SELECT arm, avg(m) AS macro_mean, stddev_pop(m) AS macro_sd FROM (SELECT arm, draw, avg(coalesce(f1, 0)) AS m FROM dr GROUP BY ALL) GROUP BY arm) JOIN
 (SELECT arm, avg(s) AS label_sd_mean, max(s) AS label_sd_worst FROM (SELECT arm, label, stddev_pop(coalesce(f1, 0)) AS s FROM dr GROUP BY ALL) GROUP BY arm) USING (arm)""", _DRAWS))
def e6(spark, sf):
    base = decided(spark, sf)
    arms = base.select(F.lit("random").alias("arm"), (F.col("row_id") % 4).alias("draw"), "label", "y", "p").unionByName(
        base.select(F.lit("blocked").alias("arm"), F.floor(F.col("row_id") / 8) % 4, "label", "y", "p").toDF("arm", "draw", "label", "y", "p"))
    out = me.spread(me.label_counts(arms, ["arm", "draw"]))
    return out.select("arm", *[F.round(c, 5).alias(c) for c in ("macro_mean", "macro_sd", "label_sd_mean", "label_sd_worst")])


_GRIDS = {"short": [2.0, 32.0], "full": [2.0, 8.0, 32.0], "middle": [8.0]}


@add("e7_search_report", with_views("scored", """
SELECT grid, c AS picked_c, round(m, 9) AS f1, c = lo OR c = hi AS on_edge FROM (
 SELECT g.grid, mf.c, mf.m, min(mf.c) OVER (PARTITION BY grid) AS lo, max(mf.c) OVER (PARTITION BY grid) AS hi, row_number() OVER (PARTITION BY grid ORDER BY m DESC, ord) AS rn
 FROM mf JOIN (VALUES ('short', 2.0::DOUBLE, 0), ('short', 32.0, 1), ('full', 2.0, 0), ('full', 8.0, 1), ('full', 32.0, 2), ('middle', 8.0, 0)) g(grid, c, ord) ON g.c = mf.c) WHERE rn = 1""", _CAND))
def e7(spark, sf):
    curve = op.choose_c(candidates(spark, sf), [2.0, 8.0, 32.0]).select("c", F.col("f1_macro").alias("f1"))
    return me.search_report(curve, _GRIDS).select("grid", "picked_c", F.round("f1", 9).alias("f1"), "on_edge")


@add("e8_variant_comparison", with_views("scored", """
SELECT variant, round(m, 9) AS f1_macro, round(m - first_value(m) OVER (ORDER BY variant), 9) AS d_f1_macro FROM (SELECT variant, avg(f1) AS m FROM (
 SELECT variant, label, 2.0::DOUBLE * sum(CASE WHEN pm >= t THEN y ELSE 0 END) / nullif(count(*) FILTER (WHERE pm >= t) + sum(y), 0) AS f1
 FROM scored CROSS JOIN (VALUES ('a base', 500), ('b low', 400), ('c high', 600)) v(variant, t) WHERE label <> 'http://v/flag/never' GROUP BY ALL) GROUP BY variant)"""))
def e8(spark, sf):
    # the variant axis of a study: here the cut; any text or vocabulary variant takes the same path
    variants = (("a base", 500), ("b low", 400), ("c high", 600))
    rows = reduce(DataFrame.unionByName, [decided(spark, sf, t).withColumn("variant", F.lit(v)) for v, t in variants])
    n = rows.groupBy("variant").agg(F.count_distinct("row_id").alias("n_rows"))
    out = me.against_base(me.summarise(me.label_counts(rows, ["variant"]), n, ["variant"]), "a base", ("f1_macro",))
    return out.select("variant", F.round("f1_macro", 9).alias("f1_macro"), F.round("d_f1_macro", 9).alias("d_f1_macro"))


@add("e8_same_rows", "SELECT true AS same_rows")
def e8_rows(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("row_id"))
    other = table(spark, sf, "documents").repartition(3).select(F.col("doc_id").alias("row_id"))
    return me.same_rows(docs.withColumn("variant", F.lit("a")).unionByName(other.withColumn("variant", F.lit("b"))))


@add("e8_same_rows_filtered", "SELECT bool_and(length(text) >= 400) AS same_rows FROM documents")
def e8_filtered(spark, sf):
    # a variant that loses rows is no fair comparison, and the check says so
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("row_id"), "text")
    kept = docs.where(F.length("text") >= 400)
    return me.same_rows(docs.withColumn("variant", F.lit("a")).unionByName(kept.withColumn("variant", F.lit("b"))).drop("text"))


@add("e9_scaling_exponent", """
WITH c AS (SELECT o_orderpriority AS shape, k, count(*) AS n, sum(o_totalprice) AS cost FROM (SELECT *, unnest(range(o_custkey % 5, 5)) AS k FROM orders) GROUP BY ALL)
SELECT shape, round(regr_slope(ln(cost), ln(n)), 5) AS exponent, round(exp(regr_intercept(ln(cost), ln(n))) * pow(600000, regr_slope(ln(cost), ln(n))), 0) AS projected FROM c GROUP BY shape""")
def e9(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderpriority", "o_totalprice", F.explode(F.sequence((F.col("o_custkey") % 5).cast("int"), F.lit(4))).alias("k"))
    costs = orders.groupBy(F.col("o_orderpriority").alias("shape"), "k").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("cost"))
    out = me.scaling_exponent(costs, "n", "cost", 600_000, ["shape"])
    return out.select("shape", F.round("exponent", 5).alias("exponent"), F.round("projected", 0).alias("projected"))


_RUNS = """runs AS (SELECT dataset, run, avg(f) AS f1_macro, sum(a) * 1.0::DOUBLE / max(n) AS labels_per_row FROM (
 SELECT item_id % 3 AS dataset, run, label, 2.0::DOUBLE * sum(CASE WHEN pm >= t THEN y ELSE 0 END) / nullif(count(*) FILTER (WHERE pm >= t) + sum(y), 0) AS f, count(*) FILTER (WHERE pm >= t) AS a, count(DISTINCT item_id) AS n
 FROM scored CROSS JOIN (VALUES ('base', 500), ('low', 480), ('high', 580)) v(run, t) WHERE label <> 'http://v/flag/never' GROUP BY ALL) GROUP BY ALL)"""


@add("e10_adoption_gate", with_views("scored", """
SELECT r.dataset, r.run, round(r.f1_macro - b.f1_macro, 9) AS gain, round(r.labels_per_row / b.labels_per_row - 1, 9) AS more_labels,
 r.f1_macro - b.f1_macro >= 0.002 AND r.labels_per_row / b.labels_per_row - 1 <= 0.10 AS adopt FROM runs r JOIN runs b ON b.dataset = r.dataset AND b.run = 'base' WHERE r.run <> 'base'""", _RUNS))
def e10(spark, sf):
    kept = scores(spark, sf).where("label <> 'http://v/flag/never'").withColumn("dataset", F.col("row_id") % 3)
    rows = reduce(DataFrame.unionByName, [
        kept.select("dataset", F.lit(run).alias("run"), "row_id", "label", "y", (F.col("pm") >= t).cast("int").alias("p"))
        for run, t in (("base", 500), ("low", 480), ("high", 580))])
    n = rows.groupBy("dataset", "run").agg(F.count_distinct("row_id").alias("n"))
    counts = me.label_counts(rows, ["dataset", "run"]).groupBy("dataset", "run").agg(
        F.avg("f1").alias("f1_macro"), F.sum(F.col("tp") + F.col("fp")).alias("a"))
    runs = counts.join(n, ["dataset", "run"]).select("dataset", "run", "f1_macro", (F.col("a") / F.col("n")).alias("labels_per_row"))
    out = me.adoption_gate(runs, "base")
    return out.select("dataset", "run", F.round("gain", 9).alias("gain"), F.round("more_labels", 9).alias("more_labels"), "adopt")
