"""Known runs of words, fits in few tasks, nothing fitted or counted twice, few links of copies, training in small parts."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from tagloom.llm import near, toxic
from tagloom.operators import counting
from tagloom.operators import features as fe
from tagloom.operators import fit as ft
from tagloom.plans import train as tr

from .test_fit import LOAD, corpus


@pytest.mark.parametrize("ngrams", [(1, 2), (1, 1), (2, 3)])
def test_word_runs_equal_filtered_ngrams(ngrams):
    rng = random.Random(1)
    known = {"a", "b", "a b", "b a", "c c", "a b c", "b b b", "d", None}
    for n in (0, 1, 2, 3, 40):
        words = rng.choices("abcd", k=n)
        every = [" ".join(words[i:i + k]) for k in range(ngrams[0], ngrams[1] + 1) for i in range(len(words) - k + 1)]
        assert Counter(counting.word_runs(" ".join(words), ngrams)) == Counter(every)
        assert Counter(counting.word_runs(" ".join(words), ngrams, counting.by_length(known))) == Counter(x for x in every if x in known)


def test_small_matrix_is_fitted_in_one_task_and_coefficients_keep_their_place(spark, monkeypatch):
    df = corpus(spark).select(F.col("id").alias("row_id"), F.col("title").alias("text"), F.split("labels", ",").alias("labels"))
    spec = fe.FeatureSpec(use_char=False, word_ngrams=(1, 1))
    vocab = fe.corpus_vocabulary(df, df.count(), spec).cache()
    matrix = ft.staged_matrix(df, fe.known_counts(df, vocab, spec), vocab, spec)
    tasks, whole = [], LogisticRegression.fit

    def fit(self, data, *rest):
        tasks.append(data.rdd.getNumPartitions())
        return whole(self, data, *rest)

    monkeypatch.setattr(LogisticRegression, "fit", fit)
    monkeypatch.setattr(ft, "SENT_HEADS", 2)
    labels = ["u/a", "u/b", "u/c"]
    positives = {x: matrix.where(F.array_contains("labels", x)).count() for x in labels}
    heads = ft.fit_heads(matrix.repartition(4), labels, 4.0, matrix.count(), positives, max_iter=10)
    assert tasks == [1, 1, 1]
    column = {r["term"]: r["column"] for r in vocab.collect()}
    want = {(t, h.label): h.model.coefficients[at] for t, at in column.items() for h in heads}
    assert {(r["term"], r["label"]): r["coef"] for r in ft.coefficients(heads, vocab).collect()} == want


def test_nothing_is_fitted_or_counted_twice(spark, monkeypatch):
    calls = Counter()
    for module, name in ((tr, "_matrix"), (ft, "fit_heads")):
        def counted(*args, _name=name, _whole=getattr(module, name), **more):
            calls[_name] += 1
            return _whole(*args, **more)
        monkeypatch.setattr(module, name, counted)
    profile = dict(c_grid=(2.0, 8.0), use_char=False)
    tr.train(corpus(spark), tr.TrainSpec(LOAD, tr.Profile("h", **profile), min_samples=5, max_iter=5))
    assert calls == {"_matrix": 2, "fit_heads": 3}  # two to choose from and the deployed one
    calls.clear()
    folds = tr.Profile("k", **profile, cv_folds=2, stratified=True, refit_vocabulary_per_fold=False)
    tr.train(corpus(spark), tr.TrainSpec(LOAD, folds, min_samples=5, max_iter=5))
    assert calls == {"_matrix": 1, "fit_heads": 5}


def test_copies_that_are_joined_are_not_confirmed_again(spark, monkeypatch):
    rng = random.Random(7)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for k in range(400):
        w = list(base)
        for at in rng.sample(range(200), 3):
            w[at] = f"x{k}_{at}"
        rows.append((k, " ".join(w)))
    looked, whole = [], near.confirmed

    def confirmed(pairs, sets, percent):
        looked.append(pairs.count())
        return whole(pairs, sets, percent)

    monkeypatch.setattr(near, "confirmed", confirmed)
    got = near.groups_of(spark.createDataFrame(rows, "doc_id long, text string"), width=2).collect()
    assert {r["component_id"] for r in got} == {0}
    assert sum(looked) <= 3 * len(rows), looked


def test_ends_of_pairs_are_not_multiplied(spark):
    pairs = spark.createDataFrame([(1, 2), (1, 3), (2, 3), (3, 9)], "a long, b long")
    ends = near.ends_of(pairs)
    assert sorted(r["node"] for r in ends.collect()) == [1, 2, 3, 9]
    assert "Generate" not in ends._jdf.queryExecution().executedPlan().toString()


def test_training_holds_few_features_at_a_time(monkeypatch):
    rng = random.Random(4)
    plain = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(1500)]
    clean = [" ".join(rng.choices(plain, k=40)) for _ in range(80)]
    bad = [" ".join(rng.choices(plain, k=15) + [rng.choice(["idiot", "moron"])]) for _ in range(40)]
    sizes, whole = [], toxic.Features.__init__

    def init(self, stretches):
        sizes.append(len(stretches))
        whole(self, stretches)

    monkeypatch.setattr(toxic.Features, "__init__", init)
    monkeypatch.setattr(toxic, "HELD_IN_TRAINING", 300)
    small = toxic.fit(bad, clean)
    assert max(sizes) <= 300
    monkeypatch.setattr(toxic, "HELD_IN_TRAINING", 1_000_000)
    assert np.allclose(toxic.fit(bad, clean).table, small.table, atol=1e-6)
