"""Joins, set operations and deduplication (J rows of the inventory)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels as lb
from ..functions import text as tx
from ..operators import corrections as co
from ..operators import dedupe as op
from ..operators import metrics
from ..plans.load import load
from ..session import cut_lineage
from ..sources.commits import AppendTable
from .labels import SPEC, labelled, loaded, prepared
from .registry import Catalog
from .sources import scratch
from .views import corrections, items, scored_long, sql_labels, table, with_views

CATALOG = Catalog()
add = CATALOG.add


def keyed(spark, sf):
    return prepared(spark, sf).where((F.length("text") >= 5) & (F.size("labels") > 0)) \
        .withColumn("key", tx.duplicate_key(F.col("text")))


@add("j1_first_wins_dedupe", with_views("loaded", "SELECT item_id AS row_id, key FROM loaded"))
def j1(spark, sf):
    return op.first_wins(keyed(spark, sf), "key", "row_id").select("row_id", "key")


@add("j2_conflicting_duplicates", with_views("loaded", """
SELECT key, count(*) AS conflicts FROM (SELECT key, list_sort(labels) AS s, first_value(list_sort(labels)) OVER (PARTITION BY key ORDER BY item_id) AS f FROM keyed)
WHERE s <> f GROUP BY key"""))
def j2(spark, sf):
    return op.conflicting_copies(keyed(spark, sf), "key", "row_id")


@add("j3_same_text_mark", with_views("loaded", "SELECT item_id AS row_id, mark FROM loaded"))
def j3(spark, sf):
    return loaded(spark, sf).select("row_id", "mark")


_EXCL = """k AS (SELECT *, CASE WHEN trim(generated_for) <> '' THEN 1 ELSE 0 END AS gen FROM keyed JOIN (SELECT item_id, generated_for FROM items) g USING (item_id)),
per AS (SELECT key, min(item_id) FILTER (WHERE gen = 0) AS kept, min(item_id) FILTER (WHERE gen = 1) AS gone, count(*) FILTER (WHERE gen = 1) AS n FROM k GROUP BY key)"""


@add("j4_exclude_generated", with_views("loaded", """
SELECT (SELECT count(*) FROM per WHERE kept IS NOT NULL) AS kept_rows, CAST(sum(n) AS BIGINT) AS excluded_rows,
 count(*) FILTER (WHERE gone IS NOT NULL AND (kept IS NULL OR gone < kept)) AS excluded_generated FROM per""", _EXCL))
def j4(spark, sf):
    from dataclasses import replace

    from ..session import beside
    done = load(items(spark, sf), replace(SPEC, synthetic_rows="exclude"), stage=True)  # rows and counters read the cleaned texts
    return beside(done.rows.agg(F.count("*").alias("kept_rows")), done.counters)


def merged(spark, sf):
    """Two exports with shared addresses and titles: documents first, then pages."""
    docs = table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), F.lit("export").alias("origin"), F.substring("text", 1, 12).alias("title"),
        F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("https://www.Example.org/"), (F.col("doc_id") % 200).cast("string"), F.lit("/")))
        .otherwise("").alias("url"))
    pages = table(spark, sf, "pages").select(
        F.col("page_id").alias("id"), F.lit("staging").alias("origin"), F.lit("").alias("title"),
        F.when(F.col("page_id") % 4 == 0, "").otherwise(
            F.concat(F.lit("http://example.org/"), F.col("page_id").cast("string"))).alias("url"))
    return op.merge_sources([docs, pages], "id")


_MERGED = r"""stacked AS (
SELECT 0 AS src_rank, doc_id AS id, 'export' AS origin, substr(text, 1, 12) AS title,
  CASE WHEN doc_id % 3 = 0 THEN concat('https://www.Example.org/', doc_id % 200, '/') ELSE '' END AS url FROM documents
UNION ALL SELECT 1, page_id, 'staging', '', CASE WHEN page_id % 4 = 0 THEN '' ELSE concat('http://example.org/', page_id) END FROM pages),
k AS (SELECT *, rtrim(regexp_replace(regexp_replace(lower(trim(url)), '^https?://', ''), '^www\.', ''), '/') AS u,
  trim(regexp_replace(lower(title), '[\s\x{A0}]+', ' ', 'g')) AS t FROM stacked),
m AS (SELECT *, CASE WHEN u <> '' THEN concat('u:', u) WHEN t <> '' THEN concat('t:', t) END AS merge_key FROM k),
merged AS (SELECT *, merge_key IS NULL OR row_number() OVER (PARTITION BY merge_key ORDER BY src_rank, id) = 1 AS kept FROM m)"""


@add("j5_merge_two_sources", f"WITH {_MERGED} SELECT origin, id, merge_key FROM merged WHERE kept")
def j5(spark, sf):
    return merged(spark, sf).where("kept").select("origin", "id", "merge_key")


@add("j6_merge_accounting", f"""WITH {_MERGED} SELECT origin, CASE WHEN kept THEN 'kept' WHEN merge_key LIKE 'u:%' THEN 'duplicate by url'
 ELSE 'duplicate by title' END AS outcome, count(*) AS n FROM merged GROUP BY ALL""")
def j6(spark, sf):
    return op.merge_accounting(merged(spark, sf))


@add("j6_source_filters", with_views("items", f"""
SELECT reason, count(*) AS n FROM (SELECT CASE WHEN NOT list_contains(string_split(keywords, ' '), 'en') THEN 'context'
 WHEN item_id % 7 = 0 THEN 'not public' WHEN len({sql_labels('labels')}) = 0 THEN 'no label' ELSE 'kept' END AS reason FROM items) GROUP BY reason"""))
def j6_filters(spark, sf):
    reason = op.drop_reason(F.split("keywords", " "), "en", F.when(F.col("item_id") % 7 == 0, False),
                            lb.distinct_labels(F.col("labels")))
    return items(spark, sf).select(F.coalesce(reason, F.lit("kept")).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@add("j7_unseen_texts", """
SELECT min(doc_id) AS doc_id, md5(strip_accents(lower(text))) AS key FROM documents WHERE doc_id % 4 <> 0 AND
 md5(strip_accents(lower(text))) NOT IN (SELECT md5(strip_accents(lower(text))) FROM documents WHERE doc_id % 4 = 0) GROUP BY 2""")
def j7(spark, sf):
    # ids and keys are stored: three branches read them, and each text is folded once
    docs = cut_lineage(table(spark, sf, "documents").select("doc_id", tx.duplicate_key(F.col("text")).alias("key")))
    return op.unseen_texts(docs.where("doc_id % 4 <> 0"), docs.where("doc_id % 4 = 0"), "key", "doc_id")


_SPACE = "model(label) AS (VALUES ('http://v/lang/de'), ('http://v/lang/en'), ('http://v/flag/quality'), ('http://v/flag/toxic'), ('http://v/flag/never'))"
_SPACE_LABELS = ["http://v/lang/de", "http://v/lang/en", "http://v/flag/quality", "http://v/flag/toxic", "http://v/flag/never"]


@add("j8_align_truth_prediction", with_views("scored", f"""
SELECT coalesce(t.row_id, p.item_id) AS row_id, coalesce(t.label, p.label) AS label, t.row_id IS NOT NULL AS truth, p.item_id IS NOT NULL AS predicted
FROM (SELECT * FROM truth WHERE label IN (SELECT label FROM model)) t
FULL OUTER JOIN (SELECT item_id, label FROM scored WHERE pm >= 500 AND label IN (SELECT label FROM model)
  AND item_id IN (SELECT row_id FROM truth WHERE label IN (SELECT label FROM model))) p ON p.item_id = t.row_id AND p.label = t.label""",
     f"{_SPACE}, truth AS (SELECT item_id AS row_id, unnest({sql_labels('labels')}) AS label FROM items)"))
def j8(spark, sf):
    truth = labelled(spark, sf)
    predicted = scored_long(spark, sf).where("pm >= 500").select(F.col("item_id").alias("row_id"), "label")
    return metrics.align(truth, predicted, _SPACE_LABELS)


@add("j8_unknown_labels", with_views("items", """
SELECT (SELECT count(DISTINCT row_id) FROM truth WHERE label IN (SELECT label FROM model)) AS n_rows,
 (SELECT count(*) FROM items) - (SELECT count(DISTINCT row_id) FROM truth WHERE label IN (SELECT label FROM model)) AS rows_without_a_known_label,
 (SELECT count(DISTINCT label) FROM truth WHERE label NOT IN (SELECT label FROM model)) AS n_unknown_labels,
 (SELECT string_agg(label, ',' ORDER BY label) FROM (SELECT DISTINCT label FROM truth WHERE label NOT IN (SELECT label FROM model) ORDER BY label)) AS unknown_labels,
 (SELECT count(DISTINCT label) FROM truth WHERE label IN (SELECT label FROM model)) AS labels_covered""",
     f"{_SPACE}, truth AS (SELECT item_id AS row_id, unnest({sql_labels('labels')}) AS label FROM items)"))
def j8_unknown(spark, sf):
    return metrics.coverage(labelled(spark, sf), _SPACE_LABELS)


@add("j9_shared_label_space", with_views("scored", """
SELECT label FROM (SELECT label FROM scored WHERE pm >= 600 INTERSECT SELECT label FROM scored WHERE item_id % 2 = 0 AND pm >= 500
INTERSECT SELECT label FROM scored WHERE y = 1)"""))
def j9(spark, sf):
    s = scored_long(spark, sf)
    return metrics.shared_space([s.where("pm >= 600").select("label"), s.where("item_id % 2 = 0 and pm >= 500").select("label")],
                                s.where("y = 1").select("label"))


@add("j10_union_by_name", """
SELECT doc_id AS id, lang, NULL AS url, 'documents' AS source FROM documents UNION ALL SELECT page_id, NULL, url, 'pages' FROM pages""")
def j10(spark, sf):
    return op.stack_sources({
        "documents": table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "lang"),
        "pages": table(spark, sf, "pages").select(F.col("page_id").alias("id"), "url")})


def import_records(spark, sf):
    """A backup on its way in: the log twice, with some records out of bounds."""
    log = corrections(spark, sf)
    arr = F.filter(F.split("corrected", ","), lambda x: x != "")
    base = log.select(
        (F.col("pos") * 2).alias("pos"), F.when(F.col("pos") % 9 == 0, "a/b").otherwise(F.col("model_name")).alias("model_name"),
        "text", F.array("predicted").alias("predicted"), arr.alias("corrected"), "source",
        F.when(F.col("pos") % 17 != 0, F.concat(F.lit("2026-01-01T"), F.col("pos").cast("string"))).alias("recorded_at"))
    return base, base.unionByName(base.withColumn("pos", F.col("pos") + 1).where("pos % 5 <> 0"))


_IMPORT = """base AS (SELECT pos * 2 AS pos, pos AS p, CASE WHEN pos % 9 = 0 THEN 'a/b' ELSE model_name END AS model_name, text, predicted, corrected, pos % 17 <> 0 AS dated FROM corrections),
incoming AS (SELECT pos, p, model_name, text, predicted, corrected, dated FROM base UNION ALL SELECT pos + 1, p, model_name, text, predicted, corrected, dated FROM base WHERE (pos + 1) % 5 <> 0),
logged AS (SELECT p FROM base WHERE pos % 3 = 0),
judged AS (SELECT *, length(text) BETWEEN 1 AND 100000 AND dated AND NOT contains(model_name, '/') AS valid FROM incoming),
done AS (SELECT *, CASE WHEN NOT valid THEN 'invalid' WHEN p IN (SELECT p FROM logged) THEN 'duplicate'
  WHEN row_number() OVER (PARTITION BY valid, p ORDER BY pos) = 1 THEN 'imported' ELSE 'duplicate' END AS outcome FROM judged)"""


@add("j11_import_corrections", with_views("corrections", "SELECT pos, outcome FROM done", _IMPORT))
def j11(spark, sf):
    base, incoming = import_records(spark, sf)
    return co.classify_import(incoming, base.where("pos % 3 = 0")).select("pos", "outcome")


@add("j11_import_counts", with_views("corrections", """SELECT count(*) FILTER (WHERE outcome = 'imported') AS imported,
 count(*) FILTER (WHERE outcome = 'duplicate') AS duplicates, count(*) FILTER (WHERE outcome = 'invalid') AS invalid FROM done""", _IMPORT))
def j11_counts(spark, sf):
    base, incoming = import_records(spark, sf)
    return co.import_counts(co.classify_import(incoming, base.where("pos % 3 = 0")))


@add("j11_appended_log", with_views("corrections", """
SELECT row_number() OVER (ORDER BY turn, pos) - 1 AS pos, model_name, text, predicted, corrected FROM (
 SELECT 1 AS turn, pos, model_name, text, predicted, corrected FROM base WHERE pos % 3 = 0 AND length(text) BETWEEN 1 AND 100000 AND dated AND NOT contains(model_name, '/')
 UNION ALL SELECT 2, pos, model_name, text, predicted, corrected FROM done WHERE outcome = 'imported')""", _IMPORT))
def j11_log(spark, sf):
    base, incoming = import_records(spark, sf)
    book = AppendTable(spark, scratch(spark, "corrections_log"))
    co.import_into(book, base.where("pos % 3 = 0"), "first backup")
    for _ in range(2):  # a job that is run again adds nothing
        co.import_into(book, incoming, "second backup")
    return book.read().select("pos", "model_name", "text", F.array_join("predicted", ",").alias("predicted"),
                              F.array_join("corrected", ",").alias("corrected"))


_MODEL_NAMES = """ml AS (SELECT DISTINCT concat('http://v/source/', source) AS label,
  CASE WHEN source IN ('src1', 'src2') THEN NULL WHEN source = 'src3' THEN '' ELSE concat('Quelle ', source) END AS name FROM documents),
nm AS (SELECT DISTINCT concat('http://v/source/', source) AS label, CASE WHEN source IN ('src2', 'src3') THEN '' WHEN source = 'src4' THEN 'Vier' ELSE concat('Quelle ', source) END AS name FROM documents),
fixed AS (SELECT m.label, coalesce(nullif(n.name, ''), m.name) AS name, CASE WHEN nullif(n.name, '') IS NULL AND coalesce(m.name, '') = '' THEN 'nameless'
  WHEN nullif(n.name, '') IS NULL OR n.name = m.name THEN 'unchanged' WHEN m.name IS NULL THEN 'added' ELSE 'corrected' END AS status FROM ml m LEFT JOIN nm n ON n.label = m.label)"""


def _name_tables(spark, sf):
    src = F.col("source")
    labels = table(spark, sf, "documents").select("source").distinct()
    uri = F.concat(F.lit("http://v/source/"), src).alias("label")
    plain = F.concat(F.lit("Quelle "), src)
    model = labels.select(uri, F.when(src.isin("src1", "src2"), None).when(src == "src3", "").otherwise(plain).alias("name"))
    names = labels.select(uri, F.when(src.isin("src2", "src3"), "").when(src == "src4", "Vier").otherwise(plain).alias("name"))
    return model, names


@add("j12_name_repair", f"WITH {_MODEL_NAMES} SELECT label, name, status FROM fixed")
def j12(spark, sf):
    return co.name_repair(*_name_tables(spark, sf))


@add("j12_name_repair_counts", f"WITH {_MODEL_NAMES} SELECT status, count(*) AS n FROM fixed GROUP BY status")
def j12_counts(spark, sf):
    return co.repair_counts(co.name_repair(*_name_tables(spark, sf)))
