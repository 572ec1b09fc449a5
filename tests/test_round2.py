"""Linear markup removal, unbounded inputs, and rules that were wrong before."""

from __future__ import annotations

import time
import unicodedata

import pytest
from pyspark.sql import functions as F

from tagloom.functions import lines, unicode
from tagloom.plans import train
from tagloom.session import InputError
from tagloom.sources import concepts, delimited, encoding


def stripped(spark, text: str) -> str:
    return spark.createDataFrame([(text,)], "t string").select(lines.strip_markup(F.col("t"))).first()[0]


@pytest.mark.parametrize("text", ["# a" + " " * 100_000 + "x", "# a" + " #" * 50_000 + "x", "#" * 100_000, "<script>" * 15_000, "<nav " * 20_000,
                                  "<!--" * 25_000, "<script>a</nav>" * 8_000, "</script " * 12_000 + "<script>"])
def test_markup_removal_is_linear(spark, text):
    stripped(spark, "# warm <nav>x</nav>")
    began = time.time()
    stripped(spark, text)
    assert time.time() - began < 5


@pytest.mark.parametrize(("text", "want"), [
    ("# Title ##  ", "Title"), ("## a # b #", "a # b"), ("#no", "#no"), ("#  ", ""), ("a\n### T\t##\nb", "a\nT\nb"), ("# a # #", "a #"),
    ("x<script>a<b</script>y", "x\ny"), ("x<script>a", "xa"), ("<nav>a<nav>b</nav>c</nav>d", "\nc\nd"), ("a<!-- b -->c<!-- d", "ac<!-- d"),
    ("<style>a</STYLE >b<script>c", "\nbc"), ("####### seven", "####### seven"),
])
def test_markup_results(spark, text, want):
    assert stripped(spark, text) == want


def test_three_marks_compose(spark):
    text = unicodedata.normalize("NFD", "ᾌ ᾳ é a") + "x"
    assert spark.createDataFrame([(text,)], "t string").select(unicode.compose(F.col("t"))).first()[0] == unicodedata.normalize("NFC", text)


@pytest.mark.parametrize(("ref", "want"), [("&#0000000000065;", "A"), ("&#x000000000000041;", "A"), ("&#99999999999;", "�"), ("&#65;", "A")])
def test_numeric_references_of_any_length(spark, ref, want):
    assert spark.createDataFrame([(ref,)], "t string").select(unicode.unescape_entities(F.col("t"))).first()[0] == want


def test_deep_concept_trees(spark):
    node = '{"id":"u79","prefLabel":{"de":"n79"}}'
    for k in range(78, -1, -1):
        node = f'{{"id":"u{k}","prefLabel":{{"de":"n{k}"}},"narrower":[{node}]}}'
    frame = spark.createDataFrame([(1, f'{{"hasTopConcept":[{node}]}}')], "rank int, json string")
    assert concepts.flatten_concepts(frame, "rank").count() == 80


def test_first_bad_line(spark):
    rows = [("f", 2, b"zz \xe9"), ("f", 1, b"ok"), ("f", 3, b"aa \xe9")]
    frame = spark.createDataFrame(rows, "file string, at int, value binary")
    assert bytes(encoding.audit(frame, at="at").first()["bad_line"]) == b"zz \xe9"


def test_files_in_another_column_order_are_refused(spark, tmp_path):
    (tmp_path / "a.csv").write_text("title;labels\nt1;l1\n")
    (tmp_path / "b.csv").write_text("labels;title\nl2;t2\n")
    with pytest.raises(Exception, match="header"):
        delimited.read_delimited(spark, str(tmp_path), ["title"], "labels").collect()


def test_row_counts_of_a_folder(spark, tmp_path):
    (tmp_path / "a.csv").write_text('x;y\n1;"a\nb"\n2;c\n')
    (tmp_path / "b.txt").write_text("x;y\n1;2\n")
    assert [r["rows"] for r in delimited.row_counts(spark, str(tmp_path)).collect()] == [2]


def test_ties_go_to_the_first_label(spark):
    scores = spark.createDataFrame([(1, "b", 0, 0.5), (1, "a", 1, 0.5), (2, "a", 0, 0.2), (2, "b", 1, 0.8)], "row_id long, label string, y int, proba double")
    metrics, _ = train.report(scores, {}, 0.5, single=True)
    assert metrics["f1_macro"] == 1.0


def test_shares_are_checked_before_any_row_is_read(spark):
    from dataclasses import replace

    from tagloom.catalog.fitting import _spec
    with pytest.raises(InputError, match="training gets none"):
        train.prepare(spark.range(1).select(F.raise_error("read").alias("title")), replace(_spec(), validation_size=0.5, test_size=0.5))


def test_title_does_not_depend_on_the_number_of_keywords(spark):
    from dataclasses import replace

    from tagloom.operators import metadata as md
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(40)
    few = md.propose(docs, "doc_id", "text", replace(md.MetadataSpec(), n_keywords=2))
    many = md.propose(docs, "doc_id", "text")
    a = {r["doc_id"]: r for r in few.collect()}
    for r in many.collect():
        assert a[r["doc_id"]]["title"] == r["title"] and a[r["doc_id"]]["keywords"] == r["keywords"][:2]
