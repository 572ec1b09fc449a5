"""Scans, sources and sinks (S rows of the inventory); files are written from the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.text import spreadsheet_safe
from ..operators import corrections as co
from ..session import shared_dir
from ..sources import concepts, delimited, encoding, jsonl
from .registry import Catalog
from .views import corrections, items, table, with_views

CATALOG = Catalog()
add = CATALOG.add
_ALL = ["title", "description", "keywords"]


def scratch(spark, name: str) -> str:
    """A fresh folder in the shared place."""
    return f"{shared_dir(spark)}/tagloom-{uuid.uuid4().hex}/{name}"


def log(spark, sf):
    """The corrections view with label arrays."""
    split = lambda c: F.filter(F.split(c, ","), lambda x: x != "")
    return corrections(spark, sf).withColumn("predicted", split("predicted")).withColumn("corrected", split("corrected"))


@add("s1_read_delimited", with_views("items", "SELECT title, description, keywords, labels, example_for FROM items"))
def s1(spark, sf):
    path = scratch(spark, "items.csv")
    delimited.write_delimited(items(spark, sf), path)
    return delimited.read_delimited(spark, path, _ALL, "labels", verbatim=["example_for"]).drop("_file", "_at")


@add("s2_read_gzip", with_views("items", "SELECT keywords, labels FROM items"))
def s2(spark, sf):
    path = scratch(spark, "items.csv")
    delimited.write_delimited(items(spark, sf).select("keywords", "labels", "title"), path, compression="gzip")
    return delimited.read_delimited(spark, path, ["keywords"], "labels", partitions=4).drop("_file", "_at")


_CODED = r"""l AS (SELECT source AS file, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS place FROM documents),
c AS (SELECT *, file IN ('src1', 'src2', 'src3') AS recoded, regexp_replace(line, '[^\x{00}-\x{FF}]', 'é', 'g') AS shown, len(regexp_extract_all(line, '[^\x{00}-\x{7F}]')) AS n FROM l)"""


@add("s4_encoding_audit", rf"""
WITH {_CODED}
SELECT file, CAST(sum(CASE WHEN recoded THEN 0 ELSE n END) AS BIGINT) AS valid, CAST(sum(CASE WHEN recoded THEN n ELSE 0 END) AS BIGINT) AS invalid,
 arg_min(shown, (doc_id, place)) FILTER (WHERE recoded AND n > 0) AS bad_line,
 CASE WHEN sum(CASE WHEN recoded THEN n ELSE 0 END) = 0 THEN 'utf-8' WHEN recoded THEN 'cp1252' ELSE 'other' END AS encoding FROM c GROUP BY file, recoded""")
def s4(spark, sf):
    # one file per source; three sources' lines are written as Latin-1, so their accented letters are stray bytes
    folder = scratch(spark, "exports")
    lines = table(spark, sf, "documents").select("source", "doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    latin = F.encode(F.regexp_replace("line", r"[^\x{00}-\x{FF}]", "é"), "ISO-8859-1")
    value = F.when(F.col("source").isin("src1", "src2", "src3"), latin).otherwise(F.encode("line", "UTF-8")).cast("string")
    (lines.repartition("source").sortWithinPartitions("source", "doc_id", "at").select("source", value.alias("value"))
     .write.partitionBy("source").text(folder))
    shown = F.decode(F.col("bad_line").cast("binary"), "ISO-8859-1").alias("bad_line")
    return encoding.audit_files(spark, folder).select(F.regexp_extract("file", "source=([^/]+)", 1).alias("file"), "valid", "invalid", shown, "encoding")


@add("s5_separator_detection", """
WITH h AS (SELECT doc_id, concat(lang, CASE doc_id % 4 WHEN 0 THEN ';' WHEN 1 THEN ',' WHEN 2 THEN '|' ELSE chr(9) END, source, CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN ',"a;b;c"' ELSE ';x' END) AS header FROM documents),
p AS (SELECT *, regexp_replace(header, '"[^"]*"', '', 'g') AS q FROM h),
n AS (SELECT *, [length(q) - length(replace(q, ';', '')), length(q) - length(replace(q, ',', '')), length(q) - length(replace(q, chr(9), '')), length(q) - length(replace(q, '|', ''))] AS c FROM p)
SELECT doc_id, [';', ',', chr(9), '|'][list_position(c, list_max(c))] AS separator FROM n""")
def s5(spark, sf):
    did = F.col("doc_id")
    mark = F.when(did % 4 == 0, ";").when(did % 4 == 1, ",").when(did % 4 == 2, "|").otherwise("\t")
    tail = F.when(did % 3 == 0, "").when(did % 3 == 1, ',"a;b;c"').otherwise(";x")
    return table(spark, sf, "documents").select(
        "doc_id", delimited.header_separator(F.concat("lang", mark, "source", tail)).alias("separator"))


@add("s6_row_counts_per_file", "SELECT lang, count(*) AS rows FROM documents GROUP BY lang ORDER BY lang LIMIT 3 OFFSET 1")
def s6(spark, sf):
    folder = scratch(spark, "exports")
    docs = table(spark, sf, "documents").select("lang", F.col("lang").alias("language"), "text", "source")
    # every task writes its part of each language's export, so no task writes or reads a whole one
    (docs.write.partitionBy("lang").option("sep", ";").option("header", True)
     .option("quote", '"').option("escape", '"').csv(folder))
    counted = delimited.row_counts(spark, folder, limit=3, offset=1, parts=True)
    return counted.select(F.regexp_extract("path", "lang=([a-z]+)", 1).alias("lang"), "rows")


@add("s7_preview", with_views("items", """
SELECT item_id, title, coalesce(nullif(labels, ''), '') AS labels, example_for FROM items ORDER BY item_id LIMIT 5"""))
def s7(spark, sf):
    df = items(spark, sf).select("item_id", "title", F.nullif("labels", F.lit("")).alias("labels"), "example_for")
    return delimited.preview(df, "item_id")


@add("s9_tolerant_jsonl", with_views("corrections", """
SELECT pos, model_name, text, predicted, corrected, source FROM corrections WHERE pos % 7 <> 0"""))
def s9(spark, sf):
    from pyspark.sql import types as T
    path = scratch(spark, "log")
    torn = log(spark, sf).select("pos", F.to_json(F.struct("*")).alias("value")).select(
        F.when(F.col("pos") % 7 == 0, F.expr("left(value, length(value) - 9)")).otherwise(F.col("value")).alias("value"))
    torn.write.text(path)
    schema = T.StructType([T.StructField("pos", T.LongType()), *jsonl.CORRECTION.fields])
    records, _ = jsonl.read_jsonl(spark, path, schema)
    return records.select("pos", "model_name", "text", F.array_join("predicted", ",").alias("predicted"),
                          F.array_join("corrected", ",").alias("corrected"), "source")


@add("s11_spreadsheet_safe", """
SELECT doc_id, CASE WHEN regexp_matches(c, '^[=+\\-@\\t\\r]') THEN concat(chr(9), c) ELSE c END AS cell FROM (
 SELECT doc_id, concat(CASE doc_id % 8 WHEN 0 THEN '=' WHEN 1 THEN '+' WHEN 2 THEN '-' WHEN 3 THEN '@' WHEN 4 THEN chr(9) WHEN 5 THEN chr(13) ELSE '' END, left(text, 20)) AS c FROM documents)""")
def s11(spark, sf):
    lead = F.col("doc_id") % 8
    sign = (F.when(lead == 0, "=").when(lead == 1, "+").when(lead == 2, "-").when(lead == 3, "@")
            .when(lead == 4, "\t").when(lead == 5, "\r").otherwise(""))
    return table(spark, sf, "documents").select(
        "doc_id", spreadsheet_safe(F.concat(sign, F.left("text", F.lit(20)))).alias("cell"))


@add("s12_corrections_export", with_views("corrections", """
SELECT pos, text, corrected AS labels FROM corrections WHERE corrected <> '' ORDER BY pos LIMIT 150 OFFSET 20"""))
def s12(spark, sf):
    return co.export_page(log(spark, sf), limit=150, offset=20)


@add("s12_corrections_dataset", with_views("corrections", "SELECT text, corrected AS labels FROM corrections WHERE corrected <> ''"))
def s12_dataset(spark, sf):
    path = scratch(spark, "corrections.csv")
    delimited.write_delimited(co.export_page(log(spark, sf)).select("text", "labels"), path)
    return delimited.read_delimited(spark, path, ["text"], "labels").drop("_file", "_at")


@add("s13_corrections_backup", with_views("corrections", """
SELECT CAST(to_json({'pos': pos, 'model_name': model_name, 'text': text, 'predicted': ['http://v/lang/en'],
  'corrected': CASE WHEN corrected = '' THEN [] ELSE string_split(corrected, ',') END, 'source': source}) AS VARCHAR) AS value FROM corrections"""))
def s13(spark, sf):
    return co.backup_lines(log(spark, sf))


def concept_schemes(spark, sf):
    """A three-level concept tree per document: language, source, document."""
    def concept(uri, names, narrower=None):
        fields = [uri.alias("id"), names.alias("prefLabel")]
        return F.struct(*fields, *([F.array(narrower).alias("narrower")] if narrower is not None else []))
    docs = table(spark, sf, "documents")
    lang, src = F.col("lang"), F.col("source")
    leaf = concept(F.concat(F.lit("v/doc/"), F.col("doc_id").cast("string")),
                   F.create_map(F.lit("en"), F.concat(F.lit("Doc "), F.col("doc_id").cast("string"))))
    mid = concept(F.concat(F.lit("v/source/"), src), F.create_map(F.lit("de"), F.concat(F.lit("Quelle "), src, F.lit(" "), lang)), leaf)
    top = concept(F.concat(F.lit("v/lang/"), lang), F.create_map(F.lit("de"), F.lit(""), F.lit("en"), F.concat(F.lit("Language "), lang)), mid)
    return docs.select(F.col("doc_id").alias("rank"), F.to_json(F.struct(F.array(top).alias("hasTopConcept"))).alias("json"))


@add("s16_concept_names", """
SELECT concat('v/doc/', doc_id) AS uri, concat('Doc ', doc_id) AS name FROM documents
UNION ALL SELECT concat('v/source/', source), arg_min(concat('Quelle ', source, ' ', lang), doc_id) FROM documents GROUP BY source
UNION ALL SELECT DISTINCT concat('v/lang/', lang), concat('Language ', lang) FROM documents""")
def s16(spark, sf):
    return concepts.flatten_concepts(concept_schemes(spark, sf), "rank")
