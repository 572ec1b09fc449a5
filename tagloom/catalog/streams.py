"""Structured Streaming flows (U rows of the inventory), fed from files written from the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import duplicate_key
from ..session import shared_dir
from ..sources.jsonl import CORRECTION
from ..streaming import flows
from .registry import Catalog
from .scoring import WORDS_ONLY, _WORD, log_odds_model, model_sql, score_sql
from .sources import log
from .views import table, with_views

CATALOG = Catalog()
add = CATALOG.add
_SCHEMA = T.StructType([T.StructField("pos", T.LongType()), *CORRECTION.fields])


def _folder(spark) -> str:
    return f"{shared_dir(spark)}/tagloom-{uuid.uuid4().hex}"


def correction_lines(spark, sf, folder: str, repeat: bool) -> None:
    """The log as JSON lines: a seventh of the lines torn, some records sent twice."""
    records = log(spark, sf).withColumn("recorded_at", F.concat(F.lit("2026-01-01T"), F.col("pos").cast("string")))
    line = F.to_json(F.struct("pos", *[f.name for f in CORRECTION.fields]))
    value = F.when(F.col("pos") % 7 == 0, F.left(line, F.length(line) - 9)).otherwise(line)
    out = records.select("pos", value.alias("value"))
    if repeat:
        out = out.unionAll(out.where("pos % 3 = 0"))
    out.repartition(4, "pos").select("value").write.text(folder)


def documents_in_blocks(spark, sf, folder: str, blocks: int = 3, files: int | None = None):
    """``documents`` in blocks that arrive in id order; a block is written by several tasks and read by one trigger."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("row_id"), "text")
    if files is None:  # a block has as many files as its share of the table has splits, so that a file stays small
        files = max(4, -(-docs.rdd.getNumPartitions() // blocks))
    last = docs.agg(F.max("row_id")).first()[0]  # one number
    for i in range(blocks):
        lo, hi = (last + 1) * i // blocks, (last + 1) * (i + 1) // blocks
        docs.where((F.col("row_id") >= lo) & (F.col("row_id") < hi)).repartition(files).write.mode("append").parquet(folder)
    return spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", files).parquet(folder)


@add("u1_continuous_scoring", f"""WITH {model_sql(WORDS_ONLY, _WORD)}, {score_sql('probas', 'SELECT doc_id FROM documents', 'counts')}
SELECT d.doc_id AS row, coalesce(p.label, '') AS uri FROM documents d
LEFT JOIN (SELECT p.doc_id, p.label FROM probas p JOIN model m USING (label) WHERE p.proba >= threshold) p ON p.doc_id = d.doc_id""")
def u1(spark, sf):
    base = _folder(spark)
    model = log_odds_model(spark, sf, WORDS_ONLY)
    model.meta["text_columns"] = ["text"]
    stream = documents_in_blocks(spark, sf, f"{base}/in")
    flows.score_stream(stream, model, f"{base}/out", f"{base}/cp", clean=False).awaitTermination()
    return spark.read.parquet(f"{base}/out").select("row", "uri")


@add("u2_corrections_log", with_views("corrections", "SELECT pos, model_name, text, corrected FROM corrections WHERE pos % 7 <> 0"))
def u2(spark, sf):
    base = _folder(spark)
    correction_lines(spark, sf, f"{base}/in", repeat=False)
    records = flows.stamped_corrections(flows.read_lines(spark, f"{base}/in", 2), _SCHEMA)
    flows.append_log(records, f"{base}/out", f"{base}/cp").awaitTermination()
    return spark.read.parquet(f"{base}/out").select("pos", "model_name", "text", F.array_join("corrected", ",").alias("corrected"))


@add("u3_unrepeated_corrections", with_views("corrections", "SELECT pos, model_name FROM corrections WHERE pos % 7 <> 0"))
def u3(spark, sf):
    base = _folder(spark)
    correction_lines(spark, sf, f"{base}/in", repeat=True)
    records = flows.stamped_corrections(flows.read_lines(spark, f"{base}/in", 2), _SCHEMA)
    flows.append_log(flows.unrepeated(records), f"{base}/out", f"{base}/cp").awaitTermination()
    return spark.read.parquet(f"{base}/out").select("pos", "model_name")


@add("u3_unrepeated_within_watermark", with_views("corrections", "SELECT pos, model_name FROM corrections WHERE pos % 7 <> 0"))
def u3_watermark(spark, sf):
    base = _folder(spark)
    correction_lines(spark, sf, f"{base}/in", repeat=True)
    records = flows.stamped_corrections(flows.read_lines(spark, f"{base}/in", 2), _SCHEMA) \
        .withColumn("arrived", F.current_timestamp())
    flows.append_log(flows.unrepeated_within(records, "arrived", "1 hour"), f"{base}/out", f"{base}/cp").awaitTermination()
    return spark.read.parquet(f"{base}/out").select("pos", "model_name")


@add("u4_first_wins_over_blocks", "SELECT min(doc_id) AS row_id, md5(strip_accents(lower(text))) AS key FROM documents GROUP BY 2")
def u4(spark, sf):
    base = _folder(spark)
    stream = documents_in_blocks(spark, sf, f"{base}/in").withColumn("key", duplicate_key(F.col("text")))
    flows.first_wins_stream(stream, "key", "row_id", f"{base}/out", f"{base}/cp").awaitTermination()
    return spark.read.parquet(f"{base}/out").select("row_id", "key")


@add("u5_running_counts", with_views("corrections", "SELECT model_name, count(*) AS n FROM corrections WHERE pos % 7 <> 0 GROUP BY model_name"))
def u5(spark, sf):
    base = _folder(spark)
    correction_lines(spark, sf, f"{base}/in", repeat=False)
    records = flows.stamped_corrections(flows.read_lines(spark, f"{base}/in", 1), _SCHEMA)
    flows.running_counts(records, "model_name", f"{base}/out", f"{base}/cp").awaitTermination()
    return spark.read.parquet(f"{base}/out").select("model_name", "n")
