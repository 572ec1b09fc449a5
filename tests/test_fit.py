"""Thresholds against a plain scan, heads against a Newton fit, and the whole training path."""

from __future__ import annotations

import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagloom.operators import features as fe
from tagloom.operators import fit as ft
from tagloom.operators import labels as lab
from tagloom.operators import scoring
from tagloom.operators import thresholds as th
from tagloom.plans import evaluate as ev
from tagloom.plans import predict as pr
from tagloom.plans import train as tr
from tagloom.plans.load import LoadSpec
from tagloom.session import InputError
from tagloom.sources import model_tables as mt


def naive(y, p, grid):
    scores = np.zeros((p.shape[1], len(grid)))
    for label in range(p.shape[1]):
        for g, cut in enumerate(grid):
            hit = p[:, label] >= cut
            total = hit.sum() + y[:, label].sum()
            scores[label, g] = 2 * (hit & (y[:, label] > 0)).sum() / total if total else 0
    return scores


@pytest.mark.parametrize("seed", [0, 1])
def test_sweep_equals_naive_search(spark, seed):
    rng = np.random.default_rng(seed)
    y = (rng.random((400, 6)) < 0.15).astype(int)
    y[:, 5] = 0
    p = np.round(np.clip(rng.random((400, 6)) * 0.7 + y * 0.25, 0, 1), 2)
    long = spark.createDataFrame([(f"l{j}", int(y[i, j]), float(p[i, j])) for i in range(400) for j in range(6)], "label string, y int, proba double")
    cut_f1 = th.cut_scores(long)
    want = naive(y, p, th.GRID)
    for r in cut_f1.collect():
        assert r["f1"] == pytest.approx(want[int(r["label"][1]), th.GRID.index(r["cut"])])
    overall = th.GRID[int(np.argmax(np.round(want.mean(axis=0), 12)))]
    got = {r["label"]: r["threshold"] for r in th.label_cuts(cut_f1).collect()}
    assert got["l5"] == overall
    assert all(got[f"l{j}"] == th.GRID[int(np.argmax(want[j]))] for j in range(5))


def test_a_score_equal_to_the_cut_passes(spark):
    one = spark.createDataFrame([("a", 1, 0.5), ("a", 0, 0.45)], "label string, y int, proba double")
    assert {r["cut"]: r["f1"] for r in th.cut_scores(one, grid=[0.5]).collect()} == {0.5: 1.0}


def corpus(spark, n=120):
    words = {"a": ["algebra", "zahl", "summe"], "b": ["zelle", "blatt", "wurzel"], "c": ["krieg", "kaiser", "reich"]}
    rng = np.random.default_rng(3)
    rows = []
    for i in range(n):
        labels = ["abc"[i % 3]] + (["abc"[(i + 1) % 3]] if i % 5 == 0 else [])
        text = " ".join(rng.choice(sum((words[x] for x in labels), []) + ["und", "das", f"wort{i % 17}"], 9))
        rows.append((i, text + f" nr{i}", ",".join(f"u/{x}" for x in labels), "x" if i % 10 == 9 else ""))
    return spark.createDataFrame(rows, "id long, title string, labels string, generated_for string")


LOAD = LoadSpec(("title",), "labels", "id")


def test_heads_equal_a_newton_fit(spark):
    df = corpus(spark).select(F.col("id").alias("row_id"), F.col("title").alias("text"), F.split("labels", ",").alias("labels"))
    spec = fe.FeatureSpec(use_char=False, word_ngrams=(1, 1))
    counts = fe.term_counts(df, spec)
    vocab = fe.select_vocabulary(fe.frequencies(counts), df.count(), spec)
    matrix = ft.staged_matrix(df, counts, vocab, spec)
    rows = matrix.orderBy("row_id").collect()
    x = np.array([r["features"].toArray() for r in rows])
    assert np.allclose((x ** 2).sum(axis=1), 1)
    y = np.array([float("u/a" in r["labels"]) for r in rows])
    n, pos = len(y), y.sum()
    w = np.where(y > 0, n / (2 * pos), n / (2 * (n - pos)))
    beta, x1, c = np.zeros(x.shape[1] + 1), np.c_[x, np.ones(n)], 4.0
    penalty = np.r_[np.ones(x.shape[1]), 0]
    for _ in range(30):
        p = 1 / (1 + np.exp(-x1 @ beta))
        grad = c * x1.T @ (w * (p - y)) + penalty * beta
        beta -= np.linalg.solve(c * (x1.T * (w * p * (1 - p))) @ x1 + np.diag(penalty), grad)
    positives = {r["label"]: r["n"] for r in lab.support(df).collect()}
    head = ft.fit_heads(matrix, ["u/a"], c, n, positives, max_iter=200, tol=1e-10)[0]
    assert np.allclose(head.model.coefficients.toArray(), beta[:-1], atol=1e-3) and head.intercept == pytest.approx(beta[-1], abs=1e-3)


@pytest.mark.parametrize("profile", [tr.Profile("h", c_grid=(8.0,), use_char=False), tr.Profile("k", c_grid=(2.0, 8.0), use_char=False, cv_folds=2, stratified=True, refit_vocabulary_per_fold=False)])
def test_training_job_learns_saves_and_scores(spark, profile):
    model = tr.train(corpus(spark), tr.TrainSpec(LOAD, profile, min_samples=5, max_iter=25))
    assert model.classes == ["u/a", "u/b", "u/c"] and model.meta["task_type"] == "multilabel"
    assert model.meta["metrics"]["f1_macro"] > 0.8
    path = tempfile.mkdtemp(prefix="tagloom-test-") + "/m"
    mt.save(model, path, spark)
    back = mt.load(spark, path)
    texts = spark.createDataFrame([(1, "algebra zahl summe"), (2, "kaiser reich krieg"), (3, "")], "row_id long, text string")
    first = {r["row_id"]: r["scores"] for r in scoring.score_texts(texts, model).collect()}
    again = {r["row_id"]: r["scores"] for r in scoring.score_texts(texts.repartition(5), back).collect()}
    for key, scores in first.items():
        assert [s["proba"] for s in scores] == pytest.approx([s["proba"] for s in again[key]])
    assert max(first[1], key=lambda s: s["proba"])["label"] == "u/a" and max(first[2], key=lambda s: s["proba"])["label"] == "u/c"
    assert [s["proba"] for s in first[3]] == pytest.approx(list(scoring.baseline(model).values()))
    with pytest.raises(Exception, match="(?i)exist"):
        mt.save(model, path, spark)
    pruned = mt.prune(back, ["u/b"])
    kept = {r["row_id"]: [s["proba"] for s in r["scores"]] for r in scoring.score_texts(texts, pruned).collect()}
    assert kept[1] == pytest.approx([first[1][0]["proba"], first[1][2]["proba"]])
    record = ev.evaluate(corpus(spark), model, LOAD).first()
    assert record["ai_marked_rows_skipped"] == 12 and record["n_rows"] == 108
    lines, seen = pr.predict_table(texts.withColumnRenamed("text", "title"), model, top=1)
    assert sorted(r["row"] for r in lines.collect()) == [1, 2, 3] and seen.get["input_rows"] == 3


def test_more_labels_than_one_panel(spark):
    labels = [mt.LabelInfo(f"l{i:03d}", 0.01 * i) for i in range(150)]
    vocab = spark.createDataFrame([("word", "eins", 1, 1.0, 0), ("word", "zwei", 1, 2.0, 1)], "block string, term string, df long, idf double, column int")
    coef = spark.createDataFrame([("word", t, x.label, 0.1 * (i % 7)) for t in ("eins", "zwei") for i, x in enumerate(labels)], "block string, term string, label string, coef double")
    model = mt.Model(labels, vocab, coef, {"features": {"use_char": False}})
    got = scoring.score_texts(spark.createDataFrame([(1, "eins zwei"), (2, "drei")], "row_id long, text string"), model).collect()
    scores = {r["row_id"]: [s["proba"] for s in r["scores"]] for r in got}
    z = [(0.1 * (i % 7)) * 3 / np.sqrt(5) + 0.01 * i for i in range(150)]
    assert scores[1] == pytest.approx([1 / (1 + np.exp(-v)) for v in z]) and scores[2] == pytest.approx([1 / (1 + np.exp(-0.01 * i)) for i in range(150)])


def test_inconsistent_models_are_refused(spark):
    vocab = spark.createDataFrame([("word", "eins", 1, 1.0, 0)], "block string, term string, df long, idf double, column int")
    coef = spark.createDataFrame([("word", "zwei", "l", 0.1)], "block string, term string, label string, coef double")
    with pytest.raises(InputError, match="without vocabulary"):
        mt.save(mt.Model([mt.LabelInfo("l", 0.0)], vocab, coef, {}), "/tmp/never-written", spark)


def test_too_little_to_learn_from(spark):
    with pytest.raises(InputError, match="at least 10"):
        tr.prepare(corpus(spark, 6), tr.TrainSpec(LOAD))
    with pytest.raises(InputError, match="no label has"):
        tr.prepare(corpus(spark, 30), tr.TrainSpec(LOAD, min_samples=25))
