"""Word importance by differences equals scoring every variant anew."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tagloom.functions import text as tx
from tagloom.operators import scoring
from tagloom.operators.features import FeatureSpec, frequencies, select_vocabulary, term_counts
from tagloom.sources.model_tables import LabelInfo, Model

WORDS = ["Säure", "Base", "und", "Wiener", "Kongress", "a", "x1", "Haus", "haus", "ﬁx", "ﷺ", "Γεια", "der", "die", "é", "Σοφός"]


def model_of(spark, spec):
    rng = random.Random(1)
    train = spark.createDataFrame([(i, " ".join(rng.choice(WORDS) for _ in range(rng.randint(3, 12)))) for i in range(60)], "row_id long, text string")
    vocab = select_vocabulary(frequencies(term_counts(train, spec)), 60, spec)
    labels = [LabelInfo("u:a", -0.5), LabelInfo("u:b", 0.25), LabelInfo("u:c", 0.0)]
    coef = vocab.select("block", "term", F.explode(F.array(*[
        F.struct(F.lit(x.label).alias("label"), ((F.pmod(F.xxhash64("term", F.lit(x.label)), F.lit(2000)) - 1000) / 500.0).alias("coef")) for x in labels])).alias("c"))
    features = {"word_ngrams": list(spec.word_ngrams), "use_char": spec.use_char, "char_ngram": spec.char_ngram, "drop_words": list(spec.drop_words), "stem": spec.stem,
                "max_word_features": spec.max_word_features, "max_char_features": spec.max_char_features, "min_df": spec.min_df, "max_df": spec.max_df}
    return Model(labels, vocab, coef.select("block", "term", "c.label", "c.coef"), {"features": features, "text_cleaning": 2})


def brute(spark, rows, chosen, model, top_words):
    """Scores of every variant's text."""
    variants = []
    cleaned = rows.select("row_id", tx.plain_words(tx.clean_text(F.col("text"), 2)).alias("w")).collect()
    for r in cleaned:
        if r["w"] and len(r["w"]) > 1:
            variants += [(f"{r['row_id']}|{i}", " ".join(w for k, w in enumerate(r["w"], 1) if k != i)) for i in range(len(r["w"]) + 1)]
    scored = scoring.score_texts(spark.createDataFrame(variants, "vid string, text string"), model, "vid", clean=False).collect()
    score = {(r["vid"], s["label"]): s["proba"] for r in scored for s in r["scores"]}
    out = []
    for r in cleaned:
        for row_id, label, _ in chosen:
            if row_id == r["row_id"] and r["w"] and len(r["w"]) > 1:
                drops = [(-round(score[f"{row_id}|0", label] - score[f"{row_id}|{i}", label], 6), i, w) for i, w in enumerate(r["w"], 1)]
                out += [(row_id, label, i, w, -d) for d, i, w in sorted(drops)[:top_words]]
    return out


@pytest.mark.parametrize("spec", [
    FeatureSpec(min_df=1, max_df=1.0), FeatureSpec(word_ngrams=(1, 3), use_char=False, min_df=2, max_df=1.0),
    FeatureSpec(drop_words=("und", "der"), stem=True, min_df=1, max_df=1.0)])
def test_equals_scoring_every_variant(spark, spec):
    model = model_of(spark, spec)
    rng = random.Random(7)
    texts = [" ".join(rng.choice(WORDS) for _ in range(n)) for n in (1, 2, 3, 5, 9, 25)] + [None, "", "zz qq unknown words", "haus haus haus haus", "<p>Haus</p> und a Base!"]
    rows = spark.createDataFrame(list(enumerate(texts)), "row_id long, text string")
    chosen = [(i, label, rank) for i in range(len(texts)) for rank, label in enumerate(rng.sample(["u:a", "u:b", "u:c"], rng.randint(1, 3)), 1)]
    frame = spark.createDataFrame(chosen, "row_id long, label string, rank int")
    got = scoring.word_importance(rows, frame, model, digits=6, top_words=200).collect()
    want = brute(spark, rows, chosen, model, 200)
    mine = {(r["row_id"], r["label"], r["at"]): (r["word"], r["impact"]) for r in got}
    assert mine.keys() == {w[:3] for w in want}
    for row_id, label, at, word, impact in want:
        assert mine[row_id, label, at][0] == word and abs(mine[row_id, label, at][1] - impact) < 3e-6
    first = scoring.word_importance(rows, frame, model, top_labels=1, top_words=2, max_words=3)
    assert {r["label"] for r in first.where("row_id = 5").collect()} == {c[1] for c in chosen if c[0] == 5 and c[2] == 1}
    assert first.groupBy("row_id").count().agg(F.max("count")).first()[0] == 2 and first.agg(F.max("at")).first()[0] <= 3


def test_long_texts_take_linear_time(spark):
    model = model_of(spark, FeatureSpec(min_df=1, max_df=1.0))
    rng = random.Random(3)
    rows = spark.createDataFrame([(1, " ".join(rng.choice(WORDS) for _ in range(20_000)))], "row_id long, text string")
    chosen = spark.createDataFrame([(1, "u:b", 1)], "row_id long, label string, rank int")
    listed = scoring.changes(scoring.listed_words(rows, model), FeatureSpec(min_df=1, max_df=1.0))
    assert listed.count() < 20_000 * 20
    assert scoring.word_importance(rows, chosen, model).count() == 5
