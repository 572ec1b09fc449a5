"""Text features (F rows of the inventory)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions import ngrams as ng
from ..operators import features as op
from ..session import cut_lineage
from .registry import Catalog
from .views import table

CATALOG = Catalog()
add = CATALOG.add
SPEC = op.FeatureSpec(max_word_features=2000, max_char_features=3000)
SMALL = op.FeatureSpec(max_word_features=60, max_char_features=90)

_NORM = "strip_accents(lower(text))"
_TOKENS = rf"regexp_extract_all({_NORM}, '[\p{{L}}\p{{N}}_]{{2,}}')"
WORDS = f"""toks AS (SELECT doc_id, {_TOKENS} AS t FROM documents),
words AS (SELECT doc_id, 'word' AS block, unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: concat(t[i], ' ', t[i + 1])))) AS term FROM toks)"""
CHARS = rf"""pieces AS (SELECT doc_id, concat(' ', w, ' ') AS p FROM (SELECT doc_id, unnest(regexp_split_to_array({_NORM}, '\s+')) AS w FROM documents) WHERE w <> ''),
chars AS (SELECT doc_id, 'char' AS block, unnest(list_transform(range(1, greatest(length(p) - 4, 1) + 1), lambda i: substr(p, i, 5))) AS term FROM pieces)"""


def counts_sql(keep: str = "TRUE") -> str:
    return f"{WORDS}, {CHARS}, counts AS (SELECT doc_id, block, term, count(*) AS tf FROM (SELECT * FROM words UNION ALL SELECT * FROM chars) WHERE {keep} GROUP BY ALL)"


COUNTS = counts_sql()


def vocab_sql(spec: op.FeatureSpec) -> str:
    return f"""freq AS (SELECT block, term, count(*) AS df, sum(tf) AS cf FROM counts GROUP BY block, term),
n AS (SELECT count(*) AS n FROM documents),
vocab AS (SELECT block, term, df, ln((1.0 + n) / (1 + df)) + 1 AS idf, row_number() OVER (PARTITION BY block ORDER BY term) - 1 AS col FROM (
  SELECT *, row_number() OVER (PARTITION BY block ORDER BY cf DESC, term) AS rn FROM freq, n WHERE df >= 2 AND df <= 0.95 * n)
  WHERE rn <= CASE block WHEN 'word' THEN {spec.max_word_features} ELSE {spec.max_char_features} END)"""


WEIGHTED = """weighted AS (SELECT doc_id, block, term, (1 + ln(tf)) * idf AS w FROM counts JOIN vocab USING (block, term)),
tfidf AS (SELECT doc_id, block, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id, block)) AS v FROM weighted)"""


def docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "text")


def counts(spark, sf, spec=SPEC, known=None):
    return op.term_counts(docs(spark, sf), spec, "doc_id", known=known)


def vocab(spark, sf, spec=SPEC):
    rows = docs(spark, sf)
    # stored once: it says which terms are counted, and is joined with them
    return cut_lineage(op.corpus_vocabulary(rows, rows.count(), spec, row_id="doc_id"))


@add("f1_word_ngrams", f"WITH {WORDS} SELECT doc_id, count(*) AS n, string_agg(term, '|' ORDER BY term) AS terms FROM words GROUP BY doc_id")
def f1(spark, sf):
    only = op.FeatureSpec(use_char=False)
    listed = op.terms(op.place(docs(spark, sf), "doc_id"), only, "doc_id").where("term is not null")
    return listed.groupBy("doc_id").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("term")), "|").alias("terms"))


@add("f2_char_ngrams", f"WITH {CHARS} SELECT doc_id, term, count(*) AS n FROM chars GROUP BY doc_id, term")
def f2(spark, sf):
    grams = op.place(docs(spark, sf), "doc_id").select("doc_id", F.explode(ng.padded_char_runs(ng.normalised(F.col("text")))).alias("term"))
    return grams.groupBy("doc_id", "term").agg(F.count("*").alias("n"))


@add("f3_document_term_counts", f"WITH {COUNTS} SELECT doc_id, block, count(*) AS terms, CAST(sum(tf) AS BIGINT) AS occurrences, max(tf) AS most FROM counts GROUP BY doc_id, block")
def f3(spark, sf):
    return counts(spark, sf).where("term is not null").groupBy("doc_id", "block").agg(
        F.count("*").alias("terms"), F.sum("tf").alias("occurrences"), F.max("tf").alias("most"))


@add("f4_frequencies", f"WITH {COUNTS} SELECT block, term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM counts GROUP BY block, term")
def f4(spark, sf):
    return op.frequencies(counts(spark, sf))


@add("f5_vocabulary", f"WITH {COUNTS}, {vocab_sql(SPEC)} SELECT block, term, df, CAST(col AS INT) AS \"column\", round(idf, 5) AS idf FROM vocab")
def f5(spark, sf):
    rows = docs(spark, sf)
    return op.corpus_vocabulary(rows, rows.count(), SPEC).select("block", "term", "df", "column", F.round("idf", 5).alias("idf"))


@add("f6_tfidf", f"""WITH {COUNTS}, {vocab_sql(SMALL)}, {WEIGHTED} SELECT doc_id, block, term, round(v, 5) AS tfidf FROM tfidf""")
def f6(spark, sf):
    v = vocab(spark, sf, SMALL)
    return op.tfidf(counts(spark, sf, SMALL, v), v, SMALL, "doc_id").select("doc_id", "block", "term", F.round("tfidf", 5).alias("tfidf"))


@add("f7_concatenated_blocks", f"""WITH {COUNTS}, {vocab_sql(SMALL)} SELECT block, term, CAST(CASE block WHEN 'word' THEN col ELSE col + (SELECT count(*) FROM vocab WHERE block = 'word') END AS INT) AS feature FROM vocab""")
def f7(spark, sf):
    v = vocab(spark, sf, SMALL)
    return op.feature_ids(v, v).select("block", "term", F.col("feature").cast("int").alias("feature"))


@add("f8_transform_new_texts", f"""
WITH {COUNTS}, {vocab_sql(SPEC)}, fresh AS (SELECT conv_id * 1000 + turn AS row_id, text FROM conversations),
ft AS (SELECT row_id, {_TOKENS} AS t FROM fresh),
fc AS (SELECT row_id, term, count(*) AS tf FROM (SELECT row_id, unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: concat(t[i], ' ', t[i + 1])))) AS term FROM ft) GROUP BY ALL)
SELECT f.row_id, count(v.term) AS terms, round(coalesce(sum(((1 + ln(tf)) * idf) ** 2), 0), 5) AS squared
FROM fresh f LEFT JOIN fc ON fc.row_id = f.row_id LEFT JOIN vocab v ON v.term = fc.term AND v.block = 'word' GROUP BY f.row_id""")
def f8(spark, sf):
    fresh = table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("row_id"), "text")
    stored = vocab(spark, sf).where("block = 'word'")
    words_only = op.FeatureSpec(use_char=False, max_word_features=2000)
    out = op.row_norms(op.term_counts(fresh, words_only, known=stored), stored, words_only)
    return out.select("row_id", "terms", F.round("squared", 5).alias("squared"))


@add("f9_feature_statistics", f"""WITH {COUNTS}, {vocab_sql(SPEC)}
SELECT block, count(*) AS nnz, count(DISTINCT term) AS features, round(count(*) * 1.0 / (SELECT n FROM n), 5) AS per_row,
 count(DISTINCT term) >= CASE block WHEN 'word' THEN 2000 ELSE 3000 END AS saturated FROM counts JOIN vocab USING (block, term) GROUP BY block""")
def f9(spark, sf):
    v = vocab(spark, sf)
    return op.statistics(counts(spark, sf, SPEC, v), v, SPEC, "doc_id").select(
        "block", "nnz", "features", F.round("per_row", 5).alias("per_row"), "saturated")


@add("f10_stopword_variant", rf"""
WITH t AS (SELECT doc_id, list_filter({_TOKENS}, lambda w: NOT list_contains([{', '.join("'" + w + "'" for w in lx.STOPWORDS)}], w)) AS t FROM documents)
SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: concat(t[i], ' ', t[i + 1])))) AS term FROM t) GROUP BY ALL""")
def f10(spark, sf):
    spec = op.FeatureSpec(use_char=False, drop_words=lx.STOPWORDS)
    return op.term_counts(docs(spark, sf), spec, "doc_id").where("term is not null").select("doc_id", "term", "tf")


@add("f10_stem_variant", rf"""
WITH t AS (SELECT doc_id, list_transform({_TOKENS}, lambda w: regexp_replace(replace(translate(lower(w), 'äöü', 'aou'), 'ß', 'ss'), '^(.{{4,}}?)(?:ern|em|en|er|es|e|s|n)$', '\1')) AS t FROM documents)
SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM t) GROUP BY ALL""")
def f10_stem(spark, sf):
    spec = op.FeatureSpec(use_char=False, stem=True, word_ngrams=(1, 1))
    return op.term_counts(docs(spark, sf), spec, "doc_id").where("term is not null").select("doc_id", "term", "tf")
