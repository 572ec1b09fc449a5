"""Only known terms leave a counting task, lines rewritten step by step, small counters, shuffle files gone with their query."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagloom.functions import lines as ln
from tagloom.functions import text as tx
from tagloom.llm import counters, near
from tagloom.llm.staging import CLEANUP, discard, staged
from tagloom.operators import features as fe
from tagloom.operators import metadata as op

TEXTS = [(1, "Äpfel und äpfel ab"), (1, "und \t ab\n"), (2, "und ab"), (2, ""), (None, "a b"), (None, "ab ab und"), (3, None), (4, "xyz"), (5, "äpfel ab")]
SPEC = fe.FeatureSpec(max_word_features=3, max_char_features=4, max_df=1.0)


def test_only_known_terms_leave_the_task(spark):
    rows = spark.createDataFrame(TEXTS, "row_id long, text string")
    vocab = fe.select_vocabulary(fe.frequencies(fe.term_counts(rows, SPEC)), rows.count(), SPEC).cache()
    got = fe.term_counts(rows, SPEC, known=vocab)
    want = fe.term_counts(rows, SPEC).join(vocab.select("block", "term"), ["block", "term"], "left_semi").select(got.columns)
    assert sorted(map(str, got.where("term IS NOT NULL").collect())) == sorted(map(str, want.collect()))
    assert got.select("row_id", "block").distinct().count() == 2 * 6  # rows without known terms stay
    for old, new in ((fe.term_counts(rows, SPEC), got),):
        assert sorted(map(str, fe.row_norms(new, vocab, SPEC).collect())) == sorted(map(str, fe.row_norms(old, vocab, SPEC).collect()))


@pytest.mark.parametrize("sent", [1 << 20, 1])
def test_vocabulary_counts_rows_of_one_id_as_one(spark, monkeypatch, sent):
    monkeypatch.setattr(fe, "SENT_TERMS", sent)
    rows = spark.createDataFrame(TEXTS, "row_id long, text string")
    want = fe.select_vocabulary(fe.frequencies(fe.term_counts(rows, SPEC)), rows.count(), SPEC)
    got = fe.corpus_vocabulary(rows, rows.count(), SPEC, row_id="row_id")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) != []


PAGES = [
    None, "", "plain  text\tof   one line \r\n\x0b  next  last ", "a<!-- x\ny -->b<!-- open <script>if (a<b) {}</script>c<nav>d", "x <script> y",
    "<p class='a'>e&amp;f</P>g<br/>h &lt;i&#x81;&#1;&nbsp;j", "## head ##\n> > quoted *bold* a_b __ ----\n[link](http://x) ![i](y) ****", "oﬃce über zu­letzt​", "a\x01b]\x02(c)",
]


def test_lines_step_by_step(spark):
    pages = spark.createDataFrame(list(enumerate(PAGES)), "id long, html string")
    body = ln.normalise_unicode(ln.strip_markup(ln.normalise_unicode(F.col("html"))))
    want = pages.select("id", F.posexplode(F.transform(F.split(body, op.LINE_BREAK), lambda x: tx.squeeze(x))).alias("pos", "line"))
    got = op.raw_lines(pages, "id", "html")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    plain = pages.select("id", F.posexplode(F.transform(F.split("html", op.LINE_BREAK), lambda x: tx.squeeze(x))).alias("pos", "line"))
    assert sorted(map(str, op.raw_lines(pages, "id", "html", markup=False).collect())) == sorted(map(str, plain.collect()))
    steps = [s for s in ln.MARKUP_STEPS if s[0] is not None]
    assert len(steps) >= len(ln.MARKUP_STEPS) - 1  # a text without marks is searched for control characters only


def test_counters_of_one_byte_keep_the_order(spark):
    table = counters.coarse(np.arange(1 << 20))
    assert (np.diff(table.astype(int)) >= 0).all() and table[:16].tolist() == list(range(16))
    assert counters.coarse(np.array([1 << 40]))[0] > counters.coarse(np.array([1 << 20]))[0]
    rows = spark.createDataFrame([("a b c",), ("a b d",)], "text string")
    found = near.frequencies(rows, 2)
    assert found.dtype == np.uint8 and found.max() == 2 and found.sum() == 2 * 4


def test_shuffle_files_go_with_their_query(spark):
    before = spark.conf.get(CLEANUP)
    made = staged(spark.range(100).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n")))
    assert made.count() == 7 and spark.conf.get(CLEANUP) == before
    discard(made)
