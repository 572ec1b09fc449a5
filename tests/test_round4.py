"""Terms counted inside tasks, exports of several parts, keys and cleaned rows stored once, whole training counts."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagloom.catalog import dedupe as jq
from tagloom.llm import lm
from tagloom.operators import features as fe
from tagloom.sources import delimited

TEXTS = [(1, "Äpfel und äpfel, ﬁx 😀x ab"), (1, "und \t ab\n"), (2, None), (2, ""), (None, "a b"), (None, "ab ab"), (3, " "), (4, "x" * 9)]


@pytest.mark.parametrize("spec", [fe.FeatureSpec(), fe.FeatureSpec(use_char=False, drop_words=("und",), stem=True),
                                  fe.FeatureSpec(word_ngrams=(2, 3), char_ngram=3), fe.FeatureSpec(char_ngram=2, drop_words=("ab",))])
def test_counted_as_exploded(spark, spec):
    rows = spark.createDataFrame(TEXTS, "row_id long, text string")
    want = fe.terms(rows, spec).groupBy("row_id", "block", "term").agg(F.count("*").alias("tf"))
    got = fe.term_counts(rows, spec)
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert "Generate" not in got._jdf.queryExecution().executedPlan().toString()


def test_export_of_several_parts_is_one(spark, tmp_path):
    rows = spark.createDataFrame([(x, f'a "b";\nc{i}') for x in "pqr" for i in range(7)], "lang string, text string")
    rows.repartition(5).write.partitionBy("lang").option("sep", ";").option("header", True).option("escape", '"').csv(str(tmp_path / "e"))
    got = delimited.row_counts(spark, str(tmp_path / "e"), limit=2, offset=1, parts=True).collect()
    assert [(r["path"].rsplit("/", 1)[-1], r["rows"]) for r in got] == [("lang=q", 7), ("lang=r", 7)]
    whole = delimited.row_counts(spark, str(tmp_path / "e"), parts=True).collect()
    assert [r["path"].rsplit("/", 1)[-1] for r in whole] == ["lang=p", "lang=q", "lang=r"]
    assert delimited.row_counts(spark, str(tmp_path / "e"), offset=9, parts=True).count() == 0


def test_unseen_texts_read_stored_keys(spark, tmp_path):
    spark.createDataFrame([(i, f"text {i % 5}") for i in range(12)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    out = jq.j7(spark, str(tmp_path))
    assert sorted(r["doc_id"] for r in out.collect()) == [1, 2]
    assert "md5" not in out._jdf.queryExecution().executedPlan().toString()


def test_every_triple_is_trained(monkeypatch):
    monkeypatch.setattr(lm, "MAX_STEPS", 1)
    n = 440
    voc = lm.Vocabulary(10_000, n, 10, np.arange(n, dtype=np.uint64), np.full(n, 20), np.ones(lm.SHAPES), np.ones(lm.SHAPES))
    model, base = lm.Model(voc), voc.outputs + 1
    two, one, token = (a.ravel() for a in np.meshgrid(np.arange(n), np.arange(10), np.array([3]), indexing="ij"))
    counts = np.ones(len(two))
    counts[0] = 10_000_000.0  # all draws by count would be of this one
    before = model.r.copy()
    lm.train_shard(model, (two * base + one) * base + token, counts, np.ones(base), 0.08, 1)
    assert (model.r[:n] != before[:n]).any(axis=1).all()
