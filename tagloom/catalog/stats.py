"""Dataset statistics, reviews and reports (A rows of the inventory)."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..operators import corrections as co
from ..operators import splits
from ..operators import stats as op
from ..plans.load import load, prepared_rows
from .dedupe import _MERGED, merged
from .labels import SPEC, loaded
from .registry import Catalog
from .sources import log
from .views import items, table, with_views

CATALOG = Catalog()
add = CATALOG.add
_ANY = replace(SPEC, min_text_length=0, drop_duplicates=False)


def analysed(spark, sf):
    """Loaded without length filter and dedupe, as statistics want it."""
    return prepared_rows(items(spark, sf), _ANY).where(F.size("labels") > 0)


_ROWS = "rows_ AS (SELECT * FROM prepared WHERE len(labels) > 0)"
_COUNTS = _ROWS + ", counts AS (SELECT label, count(*) AS n FROM (SELECT unnest(labels) AS label FROM rows_) GROUP BY label)"
_REC = "CASE WHEN count(*) < 1000 THEN 2 WHEN count(*) < 10000 THEN 5 WHEN count(*) < 50000 THEN 20 ELSE 35 END"


@add("a1_dataset_analysis", with_views("prepared", f"""
SELECT count(*) AS total_samples, round(avg(length(text)), 5) AS mean_length, round(median(length(text)), 5) AS median_length, round(avg(len(labels)), 5) AS mean_labels,
 CAST(max(len(labels)) AS INT) AS max_labels, (SELECT count(*) FROM counts) AS unique_labels, {_REC} AS recommended_min FROM rows_""", _COUNTS))
def a1(spark, sf):
    out = op.analyse(analysed(spark, sf))
    return out.select("total_samples", F.round("mean_length", 5).alias("mean_length"), F.round("median_length", 5).alias("median_length"),
                      F.round("mean_labels", 5).alias("mean_labels"), "max_labels", "unique_labels", "recommended_min")


@add("a2_threshold_table", with_views("loaded", f"""
SELECT t AS threshold, (SELECT count(*) FROM counts WHERE n >= t) AS n_labels FROM (
 SELECT unnest([5, 10, 20, 35, 50, 100]) AS t UNION SELECT {_REC} FROM loaded)""",
     "counts AS (SELECT label, count(*) AS n FROM (SELECT unnest(labels) AS label FROM loaded) GROUP BY label)"))
def a2(spark, sf):
    return op.threshold_table(loaded(spark, sf))


@add("a3_top_labels", with_views("prepared", "SELECT label, n FROM counts ORDER BY n DESC, label LIMIT 20", _COUNTS))
def a3(spark, sf):
    return op.most_frequent(analysed(spark, sf))


@add("a3_rare_labels", with_views("prepared", "SELECT label, n FROM counts WHERE n < 60", _COUNTS))
def a3_rare(spark, sf):
    return op.rare(analysed(spark, sf), below=60)


@add("a4_validation", with_views("prepared", """
SELECT true AS valid, '' AS errors, (SELECT count(*) FROM rows_) AS rows_with_labels, count(*) AS unique_labels,
 count(*) FILTER (WHERE n < 10) AS rare_labels, (SELECT count(*) FROM prepared WHERE len(labels) = 0) AS rows_without_labels FROM counts
UNION ALL SELECT false, 'missing text columns: summary; missing label column: topic', 0, 0, 0, 0""", _COUNTS))
def a4(spark, sf):
    df = items(spark, sf)
    good = op.validate(df, prepared_rows(df, _ANY), SPEC.text_columns, SPEC.label_column)
    return good.unionByName(op.validate(df, None, ("title", "summary"), "topic"))


@add("a5_corrections_page", with_views("corrections", """
SELECT pos, model_name, left(text, 500) AS text, length(text) > 500 AS text_truncated, predicted, corrected, source FROM corrections
WHERE model_name = 'm1' ORDER BY pos DESC LIMIT 25 OFFSET 10"""))
def a5(spark, sf):
    page = co.review_page(log(spark, sf), "m1", 25, 10)
    return page.select("pos", "model_name", "text", "text_truncated", F.array_join("predicted", ",").alias("predicted"),
                       F.array_join("corrected", ",").alias("corrected"), "source")


@add("a5_corrections_totals", with_views("corrections", """
SELECT model_name, count(*) AS n, (SELECT count(*) FROM corrections WHERE model_name = 'm1') AS total_m1 FROM corrections GROUP BY model_name"""))
def a5_totals(spark, sf):
    total = co.page_totals(log(spark, sf), "m1").first()["total"]  # one number
    return co.per_model(log(spark, sf)).withColumn("total_m1", F.lit(total))


@add("a6_run_history", """
SELECT event_id AS pos, event_type AS status, value AS f1_macro FROM events ORDER BY event_id DESC LIMIT 50""")
def a6(spark, sf):
    runs = table(spark, sf, "events").select(F.col("event_id").alias("pos"), F.col("event_type").alias("status"),
                                             F.col("value").alias("f1_macro"))
    return co.recent_runs(runs, 50)


@add("a7_merge_report", f"""WITH {_MERGED}
SELECT 'origin' AS kind, origin AS name, count(*) AS n FROM merged WHERE kept GROUP BY origin
UNION ALL SELECT * FROM (SELECT 'first word', string_split(title, ' ')[1], count(*) AS n FROM merged WHERE kept GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 6)""")
def a7(spark, sf):
    kept = merged(spark, sf).where("kept")
    origins = kept.groupBy("origin").agg(F.count("*").alias("n")).select(F.lit("origin").alias("kind"), F.col("origin").alias("name"), "n")
    top = kept.groupBy(F.get(F.split("title", " "), 0).alias("name")).agg(F.count("*").alias("n")) \
        .orderBy(F.col("n").desc(), "name").limit(6).select(F.lit("first word").alias("kind"), "name", "n")
    return origins.unionByName(top)


@add("a8_support_before_after", with_views("loaded", """
SELECT label, count(*) FILTER (WHERE item_id % 3 <> 0) AS train, count(*) FILTER (WHERE item_id % 3 = 0 AND key NOT IN (SELECT key FROM loaded WHERE item_id % 3 <> 0)) AS mined
FROM (SELECT item_id, key, unnest(labels) AS label FROM loaded) WHERE label LIKE '%/lang/%' GROUP BY label"""))
def a8(spark, sf):
    from ..operators.dedupe import stack_sources
    rows = loaded(spark, sf).select("row_id", F.explode("labels").alias("label")).where("label like '%/lang/%'")
    both = stack_sources({"train": rows.where("row_id % 3 <> 0"), "mined": rows.where("row_id % 3 = 0")})
    return both.groupBy("label").pivot("source", ["train", "mined"]).count().na.fill(0)
