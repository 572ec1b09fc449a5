"""The registered queries of this subpackage: one per operator, over its whole table, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm import bpe, chat, fim, jaccard, langid, licenses, lm, near, packing, quality, topk, toxic, whiten
from tagloom.llm.staging import staged

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op4_quality_rules")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts per document, whether it fails the base rules, and whether the learnt fences keep it."""
    measured = staged(quality.measure(table(spark, sf_dir, "documents")))
    rows = quality.judged(measured, quality.fences(quality.sketches(measured)))
    counts = [F.col("m")[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return rows.select("doc_id", *counts, "base_failed", "kept")


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file, installed alike on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op10_bpe_round_trip")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of tokens, and digests of the ids and of the text decoded from them."""
    return bpe.digests(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def left_over(parts: int):
    """Remainder of the digest of the id's text; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(parts))


@query("op9_language_id")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of each document by models learnt from four fifths of the documents."""
    docs = table(spark, sf_dir, "documents")
    model = langid.learn(docs.where(left_over(5) != 0), vocabulary("piece_bpe_32k.model"))
    return langid.predict(docs, model).select("doc_id", (left_over(5) == 0).alias("held_out"), "lang_pred", "score")


@query("op6_lm_scores")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probability of each document under the model and under add-one unigrams."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (left_over(7) == 2).alias("held_out"))
    counts, voc, model = lm.learn(docs.where(~F.col("held_out")))
    scored = lm.score(docs, counts, voc, model)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(voc.total).cast("long").alias("train_tokens"),
                         "base_score", "score")


@query("op2_minhash_near_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of each document, on sets of two-word shingles."""
    return near.groups_of(table(spark, sf_dir, "documents"), width=2, percent=80)


@query("op5_toxicity")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of each document by a machine that four fifths of the labelled documents train."""
    docs = table(spark, sf_dir, "documents")
    model = toxic.learn(docs.where(left_over(5) != 0), table(spark, sf_dir, "labels"))
    score = F.col("_toxic_score")
    return toxic.scored(docs.select("doc_id", "text"), model).select(
        "doc_id", (left_over(5) == 0).alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))


@query("op8_license_scan")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of the base phrases, and all license labels, of each document."""
    return licenses.scan(table(spark, sf_dir, "documents"))


@query("op3_exact_top_k")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 highest inner products of every twentieth vector with all others."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return topk.top_k(rows, F.pmod("id", F.lit(20)) == 0, k=20)


SQL["op3_exact_top_k"] = """
WITH v AS (SELECT vec_id, [CAST(floor(CAST(x AS DOUBLE) * 64) AS BIGINT) FOR x IN embedding] AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0
             AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
             CAST(list_sum([p[1] * p[2] FOR p IN list_zip(q.e, c.e)]) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s)
SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM r WHERE k <= 20
"""


@query("op7_best_fit_packing")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each piece of each document stands: bin, offset and the bin's final length."""
    return packing.packed(table(spark, sf_dir, "documents"))


#: what the calls of the query below may carry
ASK_SCHEMAS = """
SELECT * FROM VALUES
  ('ask', 'query', 'string', true, 1D, 400D), ('ask', 'words', 'integer', true, 1D, 60D),
  ('follow_up', 'query', 'string', true, 1D, 400D), ('follow_up', 'words', 'integer', true, 1D, 60D),
  ('follow_up', 'previous', 'string', true, 1D, null), ('follow_up', 'turn', 'integer', false, 2D, 6D)
  AS t(tool, field, type, required, low, high)
"""


@query("op1_tool_calls", sql=r"""
WITH c AS (SELECT conv_id, turn, role, text, conv_id || ':' || turn AS id FROM conversations),
calls AS (SELECT *, CASE WHEN turn < 2 THEN 'ask' ELSE 'follow_up' END AS tool, conv_id || ':' || (turn - 2) AS previous,
                 len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM c WHERE role = 'user'),
results AS (SELECT conv_id || ':' || (turn - 1) AS id, conv_id, turn, text FROM c WHERE role = 'assistant'),
checked AS (SELECT *, concat_ws(',', CASE WHEN length(text) < 1 OR length(text) > 400 THEN 'range:query' END,
                 CASE WHEN tool = 'follow_up' AND turn > 6 THEN 'range:turn' END,
                 CASE WHEN words < 1 OR words > 60 THEN 'range:words' END) AS errors FROM calls),
chain AS (SELECT a.id, count(b.id) AS level FROM calls a LEFT JOIN calls b
   ON b.conv_id = a.conv_id AND b.turn < a.turn AND (a.turn - b.turn) % 2 = 0
   AND (SELECT count(*) FROM calls d WHERE d.conv_id = a.conv_id AND d.turn >= b.turn AND d.turn < a.turn AND (a.turn - d.turn) % 2 = 0)
       = (a.turn - b.turn) / 2 GROUP BY a.id)
SELECT k.conv_id AS chat_id, k.id AS call_id, CAST(l.level AS INTEGER) AS level, k.turn AS position, tool,
       CASE WHEN errors <> '' THEN 'invalid' WHEN r.id IS NULL THEN 'no_result' ELSE 'ok' END AS status, errors,
       '{"arguments":' || CASE WHEN tool = 'ask' THEN CAST(json_object('query', k.text, 'words', words) AS VARCHAR)
            ELSE CAST(json_object('previous', previous, 'query', k.text, 'turn', k.turn, 'words', words) AS VARCHAR) END || ',"id":"' || k.id
       || '","name":"' || tool || '"' || CASE WHEN r.id IS NULL THEN '}' ELSE ',"result":' || CAST(to_json(r.text) AS VARCHAR) || '}' END AS message
FROM checked k LEFT JOIN results r ON r.id = k.id JOIN chain l ON l.id = k.id
UNION ALL
SELECT r.conv_id, r.id, NULL, r.turn, NULL, 'orphan', '', CAST(json_object('id', r.id, 'result', r.text) AS VARCHAR)
FROM results r WHERE r.id NOT IN (SELECT id FROM calls)
""")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns as calls, the assistant turns after them as their results, each call after the one before it."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")

    def at(turn):
        return F.concat_ws(":", "conv_id", turn)

    later = F.col("turn") >= 2
    arguments = F.to_json(F.struct(
        F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).alias("words"), F.col("text").alias("query"),
        F.when(later, F.col("turn")).alias("turn"), F.when(later, at(F.col("turn") - 2)).alias("previous")))
    asked = turns.where("role = 'user'")
    calls = asked.select(F.col("conv_id").alias("chat_id"), at("turn").alias("call_id"), F.col("turn").alias("position"),
                         F.when(later, "follow_up").otherwise("ask").alias("tool"), arguments.alias("arguments"))
    links = asked.where(later).select(at("turn").alias("call_id"), at(F.col("turn") - 2).alias("after"))
    results = turns.where("role = 'assistant'").select(
        F.col("conv_id").alias("chat_id"), at(F.col("turn") - 1).alias("call_id"), F.col("turn").alias("position"), F.col("text").alias("content"))
    return chat.linked(calls, results, links, spark.sql(ASK_SCHEMAS))


@query("op11_fill_in_middle", sql=r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS lines, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
             CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d),
n AS (SELECT *, len(lines) AS n, least(h1 % (len(lines) + 1), h2 % (len(lines) + 1)) AS x, greatest(h1 % (len(lines) + 1), h2 % (len(lines) + 1)) AS y,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain'
                  WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, coalesce(array_to_string(lines[1:x], ''), '') AS p, coalesce(array_to_string(lines[x + 1:y], ''), '') AS m,
             coalesce(array_to_string(lines[y + 1:], ''), '') AS s FROM n)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256 FROM p
""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents cut between lines and rearranged, as digests, with the digest of the text rebuilt from each."""
    out = fim.transformed(table(spark, sf_dir, "documents"), rate=100, spm=50, seed=7)
    rebuilt = fim.restored(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                      F.sha2(rebuilt, 256).alias("restored_sha256"))


@query("op12_embedding_whitening")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened leading components of each vector, and how far their covariance is from the identity."""
    return whiten.whitened_rows(table(spark, sf_dir, "embeddings"), k=8)


@query("op13_ngram_jaccard_join")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of each document under links of 85 percent, on sets of four-word shingles."""
    return jaccard.groups_of(table(spark, sf_dir, "documents"), width=4, percent=85)
