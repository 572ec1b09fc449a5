"""Marked rows (P rows of the inventory)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import marks as mk
from ..operators import labels as lab
from ..operators import provenance as op
from ..operators import splits
from ..session import cut_lineage
from .labels import loaded
from .registry import Catalog
from .views import items, with_views

CATALOG = Catalog()
add = CATALOG.add

_BITS = """(CASE WHEN trim(generated_for) <> '' THEN 1 ELSE 0 END) + {example} + (CASE WHEN trim(enriched_fields) <> '' THEN 4 ELSE 0 END)"""
_ALL = _BITS.format(example="(CASE WHEN trim(example_for) <> '' THEN 2 ELSE 0 END)")


@add("p1_mark_bits", with_views("items", f"SELECT item_id, {_ALL} AS mark, {_BITS.format(example='0')} AS mark_exclude FROM items"))
def p1(spark, sf):
    df = items(spark, sf)
    return df.select("item_id", mk.mark_bits(df.columns).alias("mark"), mk.mark_bits(df.columns, "exclude").alias("mark_exclude"))


@add("p2_ai_row_counts", with_views("items", f"""
SELECT count(*) FILTER (WHERE m & 1 > 0) AS generated, count(*) FILTER (WHERE m & 2 > 0) AS example,
 count(*) FILTER (WHERE m & 4 > 0) AS enriched, count(*) FILTER (WHERE m > 0) AS marked FROM (SELECT {_ALL} AS m FROM items)"""))
def p2(spark, sf):
    df = items(spark, sf)
    return op.mark_counts(df.select(mk.mark_bits(df.columns).alias("mark")))


_SPLIT = """real AS (SELECT *, row_number() OVER (ORDER BY md5(concat('42|', item_id)), item_id) AS rn, count(*) OVER () AS n,
  CAST(round_even(count(*) OVER () * 0.15, 0) AS BIGINT) AS nv FROM loaded WHERE mark = 0),
parts AS (SELECT item_id AS row_id, mark, CASE WHEN rn <= n - 2 * nv THEN 'train' WHEN rn <= n - nv THEN 'val' ELSE 'test' END AS part FROM real
  UNION ALL SELECT item_id, mark, 'train' FROM loaded WHERE mark <> 0)"""


@add("p3_real_rows_split", with_views("loaded", "SELECT row_id, mark, part FROM parts", _SPLIT))
def p3(spark, sf):
    rows = cut_lineage(loaded(spark, sf).select("row_id", "mark"))  # a split reads its rows several times
    return splits.real_rows_only(rows, "row_id", 42)[0]


_CLASSES = "classes AS (SELECT DISTINCT unnest(labels) AS label FROM loaded)"
_FLAGS = _CLASSES + """, flags AS (SELECT c.label, count(l.item_id) FILTER (WHERE l.mark = 0) AS real_rows FROM classes c
  LEFT JOIN (SELECT item_id, mark, unnest(labels) AS label FROM loaded) l ON l.label = c.label GROUP BY c.label)"""


@add("p4_scorable_and_thin", with_views("loaded", "SELECT label, real_rows, real_rows > 0 AS scorable, real_rows < 20 AS thin FROM flags", _FLAGS))
def p4(spark, sf):
    rows = cut_lineage(loaded(spark, sf).select("row_id", "labels", "mark"))  # support and summary read them again
    return op.real_support(rows, lab.support(rows), 20)


@add("p5_provenance_summary", with_views("loaded", """
SELECT 'train' AS mode, count(*) FILTER (WHERE mark & 1 > 0) AS generated_rows, count(*) FILTER (WHERE mark & 2 > 0) AS example_rows,
 count(*) FILTER (WHERE mark & 4 > 0) AS enriched_rows, CAST(0 AS BIGINT) AS excluded_generated_rows, count(*) FILTER (WHERE mark <> 0) AS train_only_rows,
 'real_rows' AS validated_on, count(*) FILTER (WHERE mark = 0) AS scored_rows, count(*) FILTER (WHERE mark = 0) < 10 AS too_few_rows,
 coalesce((SELECT string_agg(label, ',' ORDER BY label) FROM flags WHERE real_rows = 0), '') AS labels_not_validated,
 coalesce((SELECT string_agg(label, ',' ORDER BY label) FROM flags WHERE real_rows < 20), '') AS thin_labels FROM loaded""", _FLAGS))
def p5(spark, sf):
    rows = cut_lineage(loaded(spark, sf).select("row_id", "labels", "mark"))  # support and summary read them again
    return op.summary(rows, lab.support(rows), 0, 20)


@add("p6_skip_marked", with_views("loaded", "SELECT count(*) FILTER (WHERE mark = 0) AS n_rows, count(*) FILTER (WHERE mark <> 0) AS skipped FROM loaded"))
def p6(spark, sf):
    return loaded(spark, sf).agg(F.count_if(F.col("mark") == 0).alias("n_rows"), F.count_if(F.col("mark") != 0).alias("skipped"))
