"""Terms counted by digest in numpy are those that are counted as strings, text by text."""

from __future__ import annotations

import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tagloom.operators import counting, digests, scoring
from tagloom.operators import features as fe
from tagloom.sources.model_tables import LabelInfo, Model

WORDS = ["und", "der", "a" * 30, "säure", "x1", "𝔘𝔫", "日本語", "ab", "cd_e"]


def some_texts(n=300):
    rng = random.Random(4)
    texts = [" ".join(rng.choices(WORDS, k=rng.randint(0, 40))) for _ in range(n)]
    return texts, [t.replace(" ", rng.choice([" ", "\t", " \n ", "\x0b"])) + rng.choice(["", " ", " ?"]) for t in texts]


@pytest.mark.parametrize("spec", [fe.FeatureSpec(), fe.FeatureSpec(word_ngrams=(2, 3), char_ngram=3), fe.FeatureSpec(word_ngrams=(1, 1), use_char=False)])
def test_cells_equal_counted_strings(spec, monkeypatch):
    """over slices and batches, rows of one id are one text."""
    monkeypatch.setattr(digests, "SLICE", 700)
    tokens, chars = some_texts()
    ids = [i // 3 for i in range(len(tokens))]
    columns = [pa.array(ids), pa.array(tokens), pa.array(chars)][:3 if spec.use_char else 2]
    batches = [pa.RecordBatch.from_arrays([c[a:a + 80] for c in columns], [*"abc"][:len(columns)]) for a in range(0, 300, 80)]
    want = [r for b in counting.per_row(iter(batches), spec, 1) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    terms = {block: sorted({r[2] for r in want if r[1] == block and r[2]}) for block in digests.BLOCKS}
    half = {block: some[::2] for block, some in terms.items()}
    got = [r for b in digests.per_row(iter(batches), digests.Known.of(spec, half), 1, [*"abcd"]) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    assert sorted(r for r in got if r[2]) == sorted(r for r in want if r[2] in half[r[1]])
    assert {r[:2] for r in got} == {r[:2] for r in want}
    # the sketch bounds every term, and what passes is counted exactly
    bare = [b.select(b.schema.names[1:]) for b in batches]
    pieces = [r for b in digests.added(digests.sketch(iter(bare), spec)) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    known = digests.Sketch.of(spec, pieces).candidates(spec, dict.fromkeys(digests.BLOCKS, 1))
    counted = {(r[0], r[2]): r[3:] for b in digests.documents(iter(batches), known, 1) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)}
    df, cf = Counter(r[1:3] for r in want if r[2]), Counter()
    for _, block, term, tf in want:
        cf[block, term] += tf
    assert counted == {k: (df[k], cf[k]) for k in df}


def test_sums_in_the_task_equal_joined_weights(spark, monkeypatch):
    """scores of texts whose terms never leave the task."""
    spec = fe.FeatureSpec(max_word_features=20, max_char_features=20)
    texts, _ = some_texts(60)
    rows = spark.createDataFrame([(i // 2 if i else None, t) for i, t in enumerate(texts)] + [(99, None), (98, "zz")], "row_id long, text string")
    vocab = fe.corpus_vocabulary(rows, rows.count(), spec).cache()
    coef = vocab.where("`column` % 7 <> 0").select("block", "term", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("label")).withColumn(
        "coef", (F.pmod(F.xxhash64("term", "label"), F.lit(200)) - 100) / 50.0)
    model = Model([LabelInfo("a", 0.25), LabelInfo("b", -1.0)], vocab, coef, {"features": {"max_word_features": 20, "max_char_features": 20}, "text_cleaning": 2})
    got = scoring.score_texts(rows, model)
    assert "BroadcastHashJoin" not in got._jdf.queryExecution().executedPlan().toString()
    mine = {r["row_id"]: [round(s["proba"], 9) for s in r["scores"]] for r in got.collect()}
    monkeypatch.setattr(scoring, "SENT_WEIGHTS", 0)
    assert mine == {r["row_id"]: [round(s["proba"], 9) for s in r["scores"]] for r in scoring.score_texts(rows, model).collect()} and len(mine) == 33


@pytest.mark.parametrize("sketched", [0, 1 << 14])
def test_vocabulary_with_and_without_a_sketch(spark, monkeypatch, sketched):
    monkeypatch.setattr(fe, "SKETCHED", sketched)
    texts, _ = some_texts()
    rows = spark.createDataFrame(list(enumerate(texts)), "row_id long, text string")
    spec = fe.FeatureSpec(max_word_features=12, max_char_features=15, max_df=0.8)
    want = fe.select_vocabulary(fe.frequencies(fe.term_counts(rows, spec)), 300, spec)
    assert sorted(map(str, fe.corpus_vocabulary(rows, 300, spec).collect())) == sorted(map(str, want.collect())) != []


def test_tokens_cut_once_count_as_texts_do(spark):
    """F16: what training stores of its texts gives the vocabulary and counts of the texts."""
    texts, _ = some_texts(80)
    rows = spark.createDataFrame([(i // 2, t, "x") for i, t in enumerate([*texts, None, ""])], "row_id long, text string, fold string")
    for spec in (fe.FeatureSpec(max_word_features=9, max_char_features=9), fe.FeatureSpec(max_word_features=9, use_char=False)):
        cut = fe.tokenised(rows, spec)
        assert set(cut.columns) == {"row_id", "fold", "_t", *(["_c"] if spec.use_char else [])}
        vocab = fe.corpus_vocabulary(rows, 80, spec).cache()
        assert sorted(map(str, fe.corpus_vocabulary(cut, 80, spec).collect())) == sorted(map(str, vocab.collect())) != []
        assert sorted(map(str, fe.known_counts(cut, vocab, spec).collect())) == sorted(map(str, fe.known_counts(rows, vocab, spec).collect()))
        assert sorted(map(str, fe.term_counts(cut, spec).collect())) == sorted(map(str, fe.term_counts(rows, spec).collect()))
