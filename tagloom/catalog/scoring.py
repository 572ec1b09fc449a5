"""Scoring and decisions (K rows of the inventory, and the prediction sink).

Scripted scores check the decision rules exactly; a count log-odds model -- computable in SQL as
well -- checks the scoring path itself.
"""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import labels as lb
from ..operators import decisions as de
from ..operators import features as fo
from ..operators import metrics as me
from ..operators import scoring as op
from ..operators.noise import with_spelling_noise
from ..plans import predict
from ..session import cut_lineage
from ..sources import delimited, model_tables
from ..sources.model_tables import LabelInfo, Model
from .features import COUNTS, counts_sql, vocab_sql
from .labels import labelled
from .registry import Catalog
from .sources import scratch
from .views import ITEMS, LABEL_SET, items, scored, sql_labels, table, with_views

CATALOG = Catalog()
add = CATALOG.add

CLASSES = ["http://v/flag/quality", "http://v/lang/de", "http://v/lang/en", "http://v/lang/es", "http://v/lang/fr"]
SPEC = fo.FeatureSpec(max_word_features=300, max_char_features=300)
WORDS_ONLY = fo.FeatureSpec(max_word_features=300, use_char=False)


# --- the scripted fixture --------------------------------------------------------------------

def scripted(spark, sf):
    """(item_id, scores): scripted probabilities with a threshold per label (the last label: global)."""
    cuts = F.lit([450, 500, 550, 600, 650, 700, 500])
    return scored(spark, sf).select("item_id", F.transform("scores", lambda s, i: F.struct(
        s["label"].alias("label"), (s["pm"] / F.lit(1000.0)).alias("proba"),
        (F.get(cuts, i) / F.lit(1000.0)).alias("threshold"), s["y"].alias("y"))).alias("scores"))


_THR = "thr AS (SELECT label, CASE WHEN label_no = 7 THEN 500 ELSE 400 + 50 * label_no END AS t FROM label_set)"
_RANKED = _THR + """, ranked AS (SELECT item_id, label, pm, t, row_number() OVER (PARTITION BY item_id ORDER BY pm DESC, label) AS rk,
 count(*) FILTER (WHERE pm >= t) OVER (PARTITION BY item_id) AS passing FROM scored JOIN thr USING (label))"""


def _answers(df, answer):
    return df.select("item_id", F.explode(answer).alias("p")).select(
        "item_id", "p.label", F.round("p.proba", 3).alias("proba"), "p.above_threshold")


@add("k2_threshold_decision", with_views("scored", "SELECT item_id, label, round(pm / 1000.0, 3) AS proba FROM ranked WHERE pm >= t", _RANKED))
def k2(spark, sf):
    return _answers(scripted(spark, sf), de.flagged(de.passing(F.col("scores")))).drop("above_threshold")


@add("k2_request_threshold", with_views("scored", "SELECT item_id, label, round(pm / 1000.0, 3) AS proba FROM ranked WHERE pm >= 700", _RANKED))
def k2_override(spark, sf):
    at = F.transform("scores", lambda s: F.struct(s["label"].alias("label"), s["proba"].alias("proba"), F.lit(0.7).alias("threshold")))
    return _answers(scripted(spark, sf), de.flagged(de.passing(at))).drop("above_threshold")


@add("k3_argmax", with_views("scored", "SELECT item_id, label, round(pm / 1000.0, 3) AS proba FROM ranked WHERE rk = 1", _RANKED))
def k3(spark, sf):
    return _answers(scripted(spark, sf), de.argmax(F.col("scores"))).drop("above_threshold")


@add("k4_top_k", with_views("scored", "SELECT item_id, label, round(pm / 1000.0, 3) AS proba, pm >= t AS above_threshold FROM ranked WHERE rk <= 3", _RANKED))
def k4(spark, sf):
    return _answers(scripted(spark, sf), de.top_k(F.col("scores"), 3))


@add("k4_average_k", with_views("scored", """
SELECT item_id, label, round(pm / 1000.0, 3) AS proba, pm >= t AS above_threshold FROM ranked
WHERE rk <= (SELECT greatest(1, round_even(sum(y) * 1.0 / count(DISTINCT item_id), 0)) FROM scored)""", _RANKED))
def k4_average(spark, sf):
    df = scripted(spark, sf)
    avg = df.agg(F.avg(F.aggregate("scores", F.lit(0), lambda a, s: a + s["y"]))).first()[0]  # one number
    return _answers(df, de.top_k(F.col("scores"), de.resolved_k(0, avg, False)))


@add("k5_at_least_one", with_views("scored", """
SELECT item_id, label, round(pm / 1000.0, 3) AS proba, CASE WHEN passing = 0 THEN false END AS above_threshold FROM ranked
WHERE pm >= t OR (passing = 0 AND rk = 1)""", _RANKED))
def k5(spark, sf):
    return _answers(scripted(spark, sf), de.at_least_one(F.col("scores")))


@add("k6_label_filter", with_views("scored", """
SELECT item_id, label, round(pm / 1000.0, 3) AS proba, above_threshold FROM (SELECT *, pm >= t AS above_threshold, row_number() OVER (PARTITION BY item_id ORDER BY pm DESC, label) AS r2
 FROM ranked WHERE contains(label, '/flag/')) WHERE r2 <= 2""", _RANKED))
def k6(spark, sf):
    return _answers(scripted(spark, sf), de.top_k(de.only_matching(F.col("scores"), "/flag/"), 2))


@add("s10_prediction_rows", with_views("scored", """
SELECT i.item_id AS row, coalesce(r.label, '') AS uri, coalesce(CASE r.label WHEN 'http://v/lang/en' THEN 'English' ELSE r.label END, '') AS label,
 CASE WHEN r.label IS NULL THEN '' ELSE printf('%.2f', r.pm / 1000.0) END AS confidence, '' AS above_threshold
FROM items i LEFT JOIN (SELECT * FROM ranked WHERE pm >= t) r ON r.item_id = i.item_id""", _RANKED))
def s10(spark, sf):
    # confidences are printed to hundredths of their exact binary value, exact halves to the even digit
    answers = scripted(spark, sf).withColumn("predictions", de.flagged(de.passing(F.col("scores"))))
    return de.answer_lines(answers, {"http://v/lang/en": "English"}, "item_id")


# --- the count log-odds model ----------------------------------------------------------------

def log_odds_model(spark, sf, spec=SPEC) -> Model:
    """Labels' term log-odds over the vocabulary of ``documents``; stored once per call."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    truth = labelled(spark, sf).select(F.col("row_id").alias("doc_id"), F.filter("labels", lambda x: x.isin(*CLASSES)).alias("labels"))
    n = docs.count()
    vocab = cut_lineage(fo.corpus_vocabulary(docs, n, spec, row_id="doc_id"))
    positives = {r["label"]: r["n"] for r in truth.select(F.explode("labels").alias("label")).groupBy("label").agg(F.count("*").alias("n")).collect()}
    # presence with the labels a row carries: a join by row id of whole lists of terms, then one sum per label
    kept = fo.known_lists(docs, vocab, spec, "doc_id")
    carried = [F.array_contains("labels", c).cast("long").alias(f"p{i}") for i, c in enumerate(CLASSES)]
    per_term = kept.join(truth, "doc_id").select("block", "terms", *carried).select(
        "block", F.explode("terms").alias("term"), *[f"p{i}" for i in range(len(CLASSES))]).groupBy("block", "term").agg(
        *[F.sum(f"p{i}").alias(f"p{i}") for i in range(len(CLASSES))])
    rows = vocab.join(per_term, ["block", "term"])

    def odds(i: int, label: str):
        pos, npos = F.col(f"p{i}"), positives.get(label, 0)
        value = F.ln((pos + 1.0) / (npos + 2)) - F.ln((F.col("df") - pos + 1.0) / (n - npos + 2))
        return F.struct(F.lit(label).alias("label"), F.round(value, 5).alias("coef"))

    coef = cut_lineage(rows.select("block", "term", F.explode(F.array(*[odds(i, c) for i, c in enumerate(CLASSES)])).alias("c"))
                       .select("block", "term", "c.*"))
    infos = []
    for i, c in enumerate(CLASSES):
        npos = positives.get(c, 0)
        infos.append(LabelInfo(c, round(math.log((npos + 1) / (n - npos + 1)), 5), threshold=0.3 + 0.1 * i if i < 4 else None,
                               name=c.rsplit("/", 1)[-1].upper() if i % 2 == 0 else None, f1=0.5 + 0.05 * i if i < 3 else None, support=npos))
    features = {"max_word_features": spec.max_word_features, "max_char_features": spec.max_char_features, "use_char": spec.use_char}
    return Model(infos, vocab, coef, {"task_type": "multilabel", "text_cleaning": 2, "features": features, "avg_labels": 1.4, "global_threshold": 0.5})


def model_sql(spec, keep: str = "TRUE") -> str:
    listed = ", ".join(f"('{c}', {i})" for i, c in enumerate(CLASSES))
    return f"""{ITEMS}, {counts_sql(keep)}, {vocab_sql(spec)},
classes(label, pos) AS (VALUES {listed}),
truth AS (SELECT item_id AS doc_id, unnest({sql_labels('labels')}) AS label FROM items),
npos AS (SELECT c.label, c.pos, count(t.doc_id) AS n_pos FROM classes c LEFT JOIN truth t USING (label) GROUP BY ALL),
dfpos AS (SELECT block, term, label, count(*) AS c FROM counts JOIN vocab USING (block, term) JOIN truth USING (doc_id) GROUP BY ALL),
coef AS (SELECT v.block, v.term, v.idf, p.label, round(ln((coalesce(c, 0) + 1.0) / (n_pos + 2)) - ln((v.df - coalesce(c, 0) + 1.0) / (n - n_pos + 2)), 5) AS coef
  FROM vocab v CROSS JOIN npos p CROSS JOIN n LEFT JOIN dfpos d ON d.block = v.block AND d.term = v.term AND d.label = p.label),
model AS (SELECT label, pos, round(ln((n_pos + 1.0) / (n - n_pos + 1)), 5) AS intercept, CASE WHEN pos < 4 THEN 0.3e0 + 0.1e0 * pos ELSE 0.5e0 END AS threshold,
  CASE WHEN pos % 2 = 0 THEN upper(regexp_extract(label, '[^/]*$')) ELSE label END AS name, CASE WHEN pos < 3 THEN 0.5e0 + 0.05e0 * pos END AS f1 FROM npos, n)"""


def score_sql(name: str, ids: str, counted: str) -> str:
    """``<name>(doc_id, label, proba)`` of texts counted in ``counted(doc_id, block, term, tf)``."""
    return f"""{name} AS (SELECT i.doc_id, m.label, 1 / (1 + exp(-(m.intercept + coalesce(z, 0)))) AS proba FROM ({ids}) i CROSS JOIN model m LEFT JOIN (
  SELECT doc_id, label, sum(s / sqrt(q)) AS z FROM (SELECT k.doc_id, k.block, c.label, sum((1 + ln(k.tf)) * c.idf * c.coef) AS s, sum(((1 + ln(k.tf)) * c.idf) ** 2) AS q
    FROM {counted} k JOIN coef c ON c.block = k.block AND c.term = k.term GROUP BY ALL) GROUP BY ALL) s ON s.doc_id = i.doc_id AND s.label = m.label)"""


_SCORED = score_sql("probas", "SELECT doc_id FROM documents", "counts")


def doc_scores(spark, sf, model=None):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return op.score_texts(docs, model or log_odds_model(spark, sf), "doc_id", clean=False)


def wide_model(spark, sf, n: int) -> Model:
    """A model of the default feature caps and ``n`` labels whose coefficients are digests: for timing, not for sense."""
    spec, rows = fo.FeatureSpec(), table(spark, sf, "documents").select("doc_id", "text")
    vocab = cut_lineage(fo.corpus_vocabulary(rows, rows.count(), spec))
    labels = [LabelInfo(f"http://v/wide/{i:03d}", 0.0) for i in range(n)]
    coef = vocab.select("block", "term", F.explode(F.array(*[F.lit(x.label) for x in labels])).alias("label")).withColumn(
        "coef", (F.pmod(F.xxhash64("term", "label"), F.lit(2000)) - 1000) / 1000.0)
    return Model(labels, vocab, cut_lineage(coef), {"text_cleaning": 2})


@add("k1_probabilities", f"WITH {model_sql(SPEC)}, {_SCORED} SELECT doc_id, label, round(proba, 5) AS proba FROM probas")
def k1(spark, sf):
    return op.long_scores(doc_scores(spark, sf), "doc_id").select("doc_id", "label", F.round("proba", 5).alias("proba"))


def _full(spark, sf):
    model = log_odds_model(spark, sf)
    return de.with_thresholds(doc_scores(spark, sf, model), model).select("doc_id", F.explode("scores").alias("s")).select("doc_id", "s.*")


@add("k7_baseline_difference", f"WITH {model_sql(SPEC)}, {_SCORED} SELECT doc_id, label, round(proba - 1 / (1 + exp(-intercept)), 5) AS baseline_diff FROM probas JOIN model USING (label)")
def k7(spark, sf):
    return _full(spark, sf).select("doc_id", "label", F.round("baseline_diff", 5).alias("baseline_diff"))


@add("k8_reliability_and_names", f"WITH {model_sql(WORDS_ONLY, 'block = ' + chr(39) + 'word' + chr(39))} SELECT d.doc_id, m.label, m.name, round(m.f1, 3) AS f1, round(m.threshold, 3) AS threshold FROM documents d CROSS JOIN model m")
def k8(spark, sf):
    model = log_odds_model(spark, sf, WORDS_ONLY)
    rows = de.with_thresholds(doc_scores(spark, sf, model), model).select("doc_id", F.explode("scores").alias("s"))
    return rows.select("doc_id", "s.label", "s.name", F.round("s.f1", 3).alias("f1"), F.round("s.threshold", 3).alias("threshold"))


_WORD = "block = 'word'"
_TWO = rf"""tw AS (SELECT doc_id, regexp_extract_all(strip_accents(lower(concat(substr(text, 1, 60), ' ', substr(text, 1, 60)))), '[\p{{L}}\p{{N}}_]{{2,}}') AS t FROM documents),
tcounts AS (SELECT doc_id, 'word' AS block, term, count(*) AS tf FROM (SELECT doc_id, unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: concat(t[i], ' ', t[i + 1])))) AS term FROM tw) GROUP BY ALL)"""


@add("k9_several_models", f"""WITH {model_sql(WORDS_ONLY, _WORD)}, {_TWO}, {score_sql('full_', 'SELECT doc_id FROM documents', 'counts')}, {score_sql('title_', 'SELECT doc_id FROM documents', 'tcounts')}
SELECT f.doc_id, f.label AS from_text, t.label AS from_title FROM
 (SELECT doc_id, arg_min(label, (round(-proba, 9), label)) AS label FROM full_ GROUP BY doc_id) f JOIN
 (SELECT doc_id, arg_min(label, (round(-proba, 9), label)) AS label FROM title_ GROUP BY doc_id) t USING (doc_id)""")
def k9(spark, sf):
    model = log_odds_model(spark, sf, WORDS_ONLY)
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("row_id"), "text", F.substring("text", 1, 60).alias("title"))
    raw = {**model.meta, "text_cleaning": 2}
    both = predict.predict_many(docs, {
        "text": (Model(model.labels, model.vocab, model.coef, {**raw, "text_columns": ["text"]}), {"top": 1}),
        "title": (Model(model.labels, model.vocab, model.coef, {**raw, "text_columns": ["title"], "text_column_weights": {"title": 2}}), {"top": 1})},
        clean=False)
    best = lambda m: F.get(F.element_at("by_model", F.lit(m)), 0)["label"]
    return both.select(F.col("row_id").alias("doc_id"), best("text").alias("from_text"), best("title").alias("from_title"))


@add("k11_bulk_scoring", f"""WITH {model_sql(SPEC)}, {_SCORED}
SELECT d.doc_id AS row, coalesce(p.label, '') AS uri, coalesce(p.name, '') AS label, '' AS above_threshold FROM documents d
LEFT JOIN (SELECT p.doc_id, p.label, m.name FROM probas p JOIN model m USING (label) WHERE round(proba, 9) >= threshold) p ON p.doc_id = d.doc_id""")
def k11(spark, sf):
    model = log_odds_model(spark, sf)
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("row_id"), "text")
    model.meta["text_columns"] = ["text"]
    answers, _ = predict.predict_table(docs, model, clean=False)
    return answers.drop("confidence")


@add("k11_row_accounting", "SELECT count(*) AS input_rows, max(doc_id) + 1 AS answered_rows FROM documents")
def k11_accounting(spark, sf):
    path = scratch(spark, "bulk.csv")
    docs = table(spark, sf, "documents").select("doc_id", "text")
    delimited.write_delimited(docs, path)
    read = delimited.read_delimited(spark, path, ["doc_id", "text"])
    return predict.row_accounting(read, read.select(F.col("doc_id").cast("long").alias("row")))


_VARIANTS = r"""wl AS (SELECT conv_id * 1000 + turn AS doc_id, regexp_extract_all(text, '[\p{L}\p{N}_]+') AS w FROM conversations WHERE role = 'user'),
wv AS (SELECT doc_id, v, CASE WHEN v > 0 THEN w[v] END AS word, array_to_string(list_filter(w, lambda x, i: i <> v), ' ') AS text FROM (SELECT doc_id, w, unnest(range(0, len(w) + 1)) AS v FROM wl WHERE len(w) > 1)),
wt AS (SELECT concat(doc_id, '|', v) AS doc_id, regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}_]{2,}') AS t FROM wv),
vcounts AS (SELECT doc_id, 'word' AS block, term, count(*) AS tf FROM (SELECT doc_id, unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: concat(t[i], ' ', t[i + 1])))) AS term FROM wt) GROUP BY ALL)"""


@add("k12_word_importance", f"""WITH {model_sql(WORDS_ONLY, _WORD)}, {_VARIANTS}, {score_sql('vp', "SELECT concat(doc_id, '|', v) AS doc_id FROM wv", 'vcounts')},
best AS (SELECT doc_id, label FROM (SELECT w.doc_id, p.label, row_number() OVER (PARTITION BY w.doc_id ORDER BY round(p.proba, 9) DESC, p.label) AS rk FROM wv w JOIN vp p ON p.doc_id = concat(w.doc_id, '|0') WHERE w.v = 0) WHERE rk <= 2),
imp AS (SELECT w.doc_id, b.label, w.v, w.word, round(base.proba - p.proba, 9) AS impact FROM best b JOIN wv w ON w.doc_id = b.doc_id AND w.v > 0
  JOIN vp p ON p.doc_id = concat(w.doc_id, '|', w.v) AND p.label = b.label JOIN vp base ON base.doc_id = concat(w.doc_id, '|0') AND base.label = b.label)
SELECT doc_id AS row_id, label, round(sum(impact), 5) AS total, count(*) AS words FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, label ORDER BY impact DESC, v) AS rn FROM imp) WHERE rn <= 5 GROUP BY ALL""")
def k12(spark, sf):
    model = log_odds_model(spark, sf, WORDS_ONLY)
    rows = table(spark, sf, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("row_id"), "text")
    whole = op.listed_words(rows, model).select("row_id", F.array_join("w", " ").alias("text"))
    base = op.score_texts(whole, model, clean=False)
    chosen = base.select("row_id", F.posexplode(F.slice(de.ranked(F.transform("scores", lambda s: F.struct(
        s["label"].alias("label"), F.round(s["proba"], 9).alias("proba")))), 1, 2)).alias("at", "s")) \
        .select("row_id", "s.label", (F.col("at") + 1).alias("rank"))
    words = op.word_importance(rows, chosen, model, digits=9)
    return words.groupBy("row_id", "label").agg(F.round(F.sum("impact"), 5).alias("total"), F.count("*").alias("words"))


@add("k13_full_score_table", f"""WITH {model_sql(SPEC)}, {_SCORED} SELECT doc_id, label, name, round(proba, 5) AS confidence,
 round(proba - 1 / (1 + exp(-intercept)), 4) AS baseline_diff, round(f1, 3) AS f1 FROM probas JOIN model USING (label)""")
def k13(spark, sf):
    return _full(spark, sf).select("doc_id", "label", "name", F.round("proba", 5).alias("confidence"),
                                   F.round("baseline_diff", 4).alias("baseline_diff"), F.round("f1", 3).alias("f1"))


@add("k14_noise_robustness")
def k14(spark, sf):
    model = log_odds_model(spark, sf, WORDS_ONLY)
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("row_id"), "text")
    truth = labelled(spark, sf)
    conditions = {"clean": docs, "typos 3%": with_spelling_noise(docs, "text", "row_id", 0.03, 42, "text"),
                  "typos 8%": with_spelling_noise(docs, "text", "row_id", 0.08, 43, "text")}
    return predict.robustness(conditions, truth, model)


# --- model tables ----------------------------------------------------------------------------

@add("s15_model_save_load", f"WITH {model_sql(WORDS_ONLY, _WORD)} SELECT block, term, label, coef FROM coef")
def s15(spark, sf):
    path = scratch(spark, "model")
    model_tables.save(log_odds_model(spark, sf, WORDS_ONLY), path, spark)
    return model_tables.load(spark, path).coef.select("block", "term", "label", "coef")


@add("m9_label_pruning", f"""WITH {model_sql(WORDS_ONLY, _WORD)}, {score_sql('probas', 'SELECT doc_id FROM documents', 'counts')}
SELECT doc_id, label, round(proba, 5) AS proba FROM probas WHERE label NOT IN ('http://v/lang/es', 'http://v/lang/fr')""")
def m9(spark, sf):
    model = model_tables.prune(log_odds_model(spark, sf, WORDS_ONLY), ["http://v/lang/es", "http://v/lang/fr"])
    return op.long_scores(doc_scores(spark, sf, model), "doc_id").select("doc_id", "label", F.round("proba", 5).alias("proba"))
