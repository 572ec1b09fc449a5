"""The vocabulary that counts only what can reach the cap equals the one from all counts."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tagloom.operators import features as fe
from tagloom.operators.features import FeatureSpec

WORDS = [f"w{i}" for i in range(60)] + ["und", "der", "a", "Säure", "ﬁx", "x" * 30]


def rows_of(spark, n=120):
    rng = random.Random(2)
    weights = [1 / (k + 1) for k in range(len(WORDS))]
    texts = ["the " + " ".join(rng.choices(WORDS, weights, k=rng.randint(0, 30))) for _ in range(n)] + [None, "", "the the the"]
    return spark.createDataFrame(list(enumerate(texts)), "row_id long, text string")


@pytest.mark.parametrize("spec", [
    FeatureSpec(max_word_features=40, max_char_features=50), FeatureSpec(max_word_features=5, max_char_features=3, max_df=0.2, min_df=4),
    FeatureSpec(max_word_features=10_000, max_char_features=10_000), FeatureSpec(use_char=False, drop_words=("und",), stem=True, max_word_features=20),
    FeatureSpec(word_ngrams=(2, 3), char_ngram=3, max_word_features=30, max_char_features=30)])
def test_same_as_from_all_counts(spark, spec):
    rows = rows_of(spark)
    n = rows.count()
    counts = fe.term_counts(rows, spec)
    whole = fe.select_vocabulary(fe.frequencies(counts), n, spec)
    mine = fe.corpus_vocabulary(rows, n, spec)
    assert sorted(map(tuple, mine.collect())) == sorted(map(tuple, whole.select(*mine.columns).collect()))
    known = fe.known_counts(rows, mine, spec)
    want = counts.join(whole.select("block", "term"), ["block", "term"]).select("row_id", "block", "term", "tf")
    assert sorted(map(tuple, known.collect())) == sorted(map(tuple, want.collect()))


def test_occurrences_equal_counted_terms(spark):
    rows = rows_of(spark)
    spec = FeatureSpec()
    want = fe.frequencies(fe.term_counts(rows, spec)).select("block", "term", "cf")
    assert sorted(map(tuple, fe.occurrences(rows, spec).collect())) == sorted(map(tuple, want.collect()))


def test_no_text_is_shuffled_for_a_vocabulary(spark):
    rows = rows_of(spark)
    plan = fe.occurrences(rows.select("text"))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(text" not in plan and "RoundRobin" not in plan and "REPARTITION" not in plan


def test_nothing_left(spark):
    rows = spark.createDataFrame([(1, ""), (2, None)], "row_id long, text string")
    assert fe.corpus_vocabulary(rows, 2).count() == 0
    assert fe.known_counts(rows, fe.corpus_vocabulary(rows, 2)).agg(F.count("*")).first()[0] == 0
