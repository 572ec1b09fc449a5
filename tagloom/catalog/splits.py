"""Splits and samples (X rows of the inventory)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels as lb
from ..operators import splits as op
from ..session import cut_lineage
from .labels import labelled
from .registry import Catalog
from .views import items, sql_labels, table, with_views

CATALOG = Catalog()
add = CATALOG.add
_LABELLED = f"labelled AS (SELECT item_id AS row_id, {sql_labels('labels')} AS labels FROM items)"


@add("x1_three_way_split", """
SELECT doc_id, CASE WHEN rn <= n - nv - nt THEN 'train' WHEN rn <= n - nt THEN 'val' ELSE 'test' END AS part FROM (
 SELECT doc_id, row_number() OVER (ORDER BY md5(concat('42|', doc_id)), doc_id) AS rn, count(*) OVER () AS n,
  CAST(round_even(count(*) OVER () * 0.15, 0) AS BIGINT) AS nv, CAST(round_even(count(*) OVER () * 0.2, 0) AS BIGINT) AS nt FROM documents)""")
def x1(spark, sf):
    return op.three_way(table(spark, sf, "documents").select("doc_id"), "doc_id", 42, 0.15, 0.2)


def _stratified_sql(pattern: list[int], seed: int) -> str:
    return f"""
SELECT l.row_id, [{', '.join(map(str, pattern))}][CAST((row_number() OVER (PARTITION BY coalesce(s.stratum, '')
   ORDER BY md5(array_to_string(list_sort(l.labels), ',')), md5(concat('{seed}|', l.row_id)), l.row_id) - 1
  + CAST(concat('0x', substr(md5(coalesce(s.stratum, '')), 1, 6)) AS BIGINT)) % {len(pattern)} AS INT) + 1] AS part_no
FROM labelled l LEFT JOIN (SELECT row_id, arg_min(label, k) AS stratum FROM long JOIN ranked USING (label) GROUP BY row_id) s ON s.row_id = l.row_id"""


_STRATA = _LABELLED + """, long AS (SELECT row_id, unnest(labels) AS label FROM labelled),
ranked AS (SELECT label, row_number() OVER (ORDER BY n, label) AS k FROM (SELECT label, count(*) AS n FROM long GROUP BY label))"""


@add("x2_stratified_partition", with_views("items", _stratified_sql(op.dealing_pattern([0.7, 0.15, 0.15]), 42), _STRATA))
def x2(spark, sf):
    return op.stratified(labelled(spark, sf), [0.7, 0.15, 0.15], 42).select("row_id", "part_no")


@add("x3_random_folds", """
SELECT doc_id, CASE WHEN rn <= b + (n % 5 > 0)::INT THEN 0 WHEN rn <= 2 * b + least(n % 5, 2) THEN 1 WHEN rn <= 3 * b + least(n % 5, 3) THEN 2
 WHEN rn <= 4 * b + least(n % 5, 4) THEN 3 ELSE 4 END AS fold FROM (
 SELECT doc_id, row_number() OVER (ORDER BY md5(concat('42|', doc_id)), doc_id) AS rn, count(*) OVER () AS n, count(*) OVER () // 5 AS b FROM documents)""")
def x3(spark, sf):
    return op.folds(table(spark, sf, "documents").select("doc_id"), "doc_id", 42, 5)


@add("x3_stratified_folds", with_views("items", _stratified_sql([0, 1, 2], 42), _STRATA))
def x3_stratified(spark, sf):
    return op.stratified(labelled(spark, sf), [1, 1, 1], 42).select("row_id", "part_no")


@add("x4_weak_label_holdout", with_views("items", f"""
SELECT row_id, CAST(concat('0x', substr(md5(concat('42|', row_id)), 1, 7)) AS BIGINT) / 268435456.0 < CASE WHEN
 list_has_any(labels, ['http://v/lang/de', 'http://v/flag/toxic']) THEN 0.4 ELSE 0.15 END AS held FROM labelled""", _LABELLED))
def x4(spark, sf):
    rows = labelled(spark, sf)
    weak = rows.select(F.explode("labels").alias("label")).distinct().where(
        F.col("label").isin("http://v/lang/de", "http://v/flag/toxic"))
    return op.weak_holdout(rows, weak, "row_id", 42).select("row_id", "held")


@add("x5_quota_mining", with_views("items", """
SELECT row_id, arg_max(label, (n // 4, label)) AS selected_for FROM (SELECT row_id, label, row_number() OVER (PARTITION BY label ORDER BY row_id) AS k, count(*) OVER (PARTITION BY label) AS n
 FROM (SELECT DISTINCT row_id, unnest(labels) AS label FROM labelled)) WHERE (contains(label, '/lang/') OR contains(label, '/flag/')) AND k <= n // 4 GROUP BY row_id""", _LABELLED))
def x5(spark, sf):
    rows = labelled(spark, sf)
    needed = rows.select(F.explode("labels").alias("label")).where("label like '%/lang/%' or label like '%/flag/%'") \
        .groupBy("label").agg((F.count("*") / 4).cast("int").alias("need"))
    return op.quota_mine(rows, needed, "row_id").select("row_id", "selected_for")


@add("x6_sample_per_label", with_views("items", """
SELECT row_id, label, CAST(rn AS INT) AS pick FROM (SELECT row_id, label, row_number() OVER (PARTITION BY label ORDER BY md5(concat('42|', row_id)), row_id) AS rn
 FROM (SELECT row_id, unnest(labels) AS label FROM labelled)) WHERE rn <= 4""", _LABELLED))
def x6(spark, sf):
    return op.per_label_sample(labelled(spark, sf), 4, 42).select("row_id", "label", "pick")


@add("x7_shortest_quarter", """
SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY length(text), md5(concat('42|', doc_id)), doc_id) AS rn, count(*) OVER () AS n FROM documents)
WHERE rn <= n // 4""")
def x7(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.length("text").alias("chars"))
    return op.lowest_share(docs, "chars", "doc_id", 42, 0.25).select("doc_id")


_VOCAB = """known AS (SELECT w FROM (SELECT DISTINCT doc_id, unnest(string_split(lower(text), ' ')) AS w FROM documents WHERE doc_id % 2 = 0) GROUP BY w HAVING count(*) >= 2),
miss AS (SELECT doc_id, CAST(floor(1000.0 * count(*) FILTER (WHERE k.w IS NULL) / count(*)) AS BIGINT) AS oov FROM (SELECT doc_id, unnest(string_split(lower(text), ' ')) AS w FROM documents) d
 LEFT JOIN known k ON k.w = d.w GROUP BY doc_id)"""


@add("x7_most_unknown_quarter", f"""WITH {_VOCAB} SELECT doc_id, oov FROM (
SELECT doc_id, oov, row_number() OVER (ORDER BY oov DESC, md5(concat('42|', doc_id)), doc_id) AS rn, count(*) OVER () AS n FROM miss) WHERE rn <= n // 4""")
def x7_oov(spark, sf):
    docs = table(spark, sf, "documents")
    texts = docs.select("doc_id", F.split(F.lower("text"), " ").alias("words"))
    known = (texts.where("doc_id % 2 = 0").select(F.explode(F.array_distinct("words")).alias("w"))
             .groupBy("w").agg(F.count("*").alias("df")).where("df >= 2"))
    per = op.unknown_words(texts, known, "doc_id", "words")
    # stored once: the share is read for its histogram, its cut and its ties
    share = cut_lineage(per.select("doc_id", F.floor(F.lit(1000.0) * F.col("miss") / F.col("all")).alias("oov")))
    return op.lowest_share(share, "oov", "doc_id", 42, 0.25, descending=True).select("doc_id", "oov")


@add("x8_nested_subsets", """
SELECT doc_id, CASE WHEN rn <= 50 THEN 50 WHEN rn <= 120 THEN 120 WHEN rn <= 400 THEN 400 END AS smallest FROM (
 SELECT doc_id, row_number() OVER (ORDER BY md5(concat('42|', doc_id)), doc_id) AS rn FROM documents)""")
def x8(spark, sf):
    return op.nested_subsets(table(spark, sf, "documents").select("doc_id"), "doc_id", 42, [50, 120, 400])
