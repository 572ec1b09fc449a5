from __future__ import annotations

import html
import unicodedata

import pytest
from pyspark.sql import functions as F

from tagloom.functions import lines, ngrams, text, unicode
from tagloom.operators import metadata as md


def column(spark, values, expression):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[1] for r in sorted(rows.select("i", expression(F.col("t"))).collect())]


ENTITIES = ["a&amp;b", "&amp;lt;", "&copy 2020", "&notit;", "&#8364;&#x20AC;&#128;", "&unknown; & x", "&", "&&amp;;", "&#0;|&#xD800;|&#1;|",
            "&ampx", "a&lt;b&gt", "&nbsp;x", "&NotEqualTilde;", "&#13;&#9;", "&#99999999;", "&#65 x", "plain", ""]


def test_entities_as_the_standard_library(spark):
    assert column(spark, ENTITIES, unicode.unescape_entities) == [html.unescape(x) for x in ENTITIES]


def test_accents_and_composition(spark):
    values = ["Café Ångström", "é ấ", "ﬁx", "straße"]
    folded = ["".join(c for c in unicodedata.normalize("NFKD", v) if not "̀" <= c <= "ͯ") for v in values]
    assert column(spark, values, unicode.strip_accents) == folded
    assert column(spark, values, unicode.compose) == [unicodedata.normalize("NFC", v) for v in values]


@pytest.mark.parametrize(("raw", "clean"), [
    ("<p>a</p><b>b</b>", "a b"), ("x < 3 and y > 2", "x < 3 and y 2"), ("[text](http://u) **bold** `c`", "text bold c"),
    ("a\x00b  c\n\nd", "ab c d"), ("&lt;b&gt;x", "x"), (None, ""), ("  ", "")])
def test_clean_text(spark, raw, clean):
    assert column(spark, [raw], text.clean_text) == [clean]


def test_cleaning_versions_differ_on_loose_tags(spark):
    assert column(spark, ["a <3 b> c"], lambda c: text.clean_text(c, 1)) == ["a c"]
    assert column(spark, ["a <3 b> c"], text.clean_text) == ["a <3 b c"]


def test_assembly_keeps_empty_slots(spark):
    df = spark.createDataFrame([("t", None, "k")], "title string, d string, k string")
    got = df.select(text.assemble(["title", "d", "k"], {"title": 2, "k": 1, "other": 5})).first()[0]
    assert got == "t t  k"
    with pytest.raises(ValueError, match="not found"):
        text.assemble(["nope"], None, df.columns)


def test_effective_weights():
    assert text.effective_weights(None, {"a": 2, "b": 3}, ["a"]) == {"a": 2}
    assert text.effective_weights({}, {"a": 2}, ["a"]) == {}
    with pytest.raises(ValueError):
        text.effective_weights({"a": 11}, {}, ["a"])


def test_char_ngrams_stay_in_words(spark):
    got = column(spark, ["ab planet"], lambda c: ngrams.padded_char_runs(c))[0]
    assert got == [" ab ", " plan", "plane", "lanet", "anet "]


def test_markup_keeps_lines(spark):
    page = "<h1>T</h1><nav>menu</nav><p>one <b>two</b></p><!-- c --><script>x</script>## Head ##\n**b** a_b_c ----\n> quoted"
    got = column(spark, [page], lines.strip_markup)[0]
    assert [x for x in got.split("\n") if x.strip()] == ["T", "one two", "Head", "b a_b_c ----", "quoted"]


def test_line_tests(spark):
    assert column(spark, ["Alle Rechte vorbehalten", "Impressum Kontakt", "Der Satz ist lang."], lines.is_boilerplate) == [True, True, False]
    assert column(spark, ["Berechne die Summe", "Aufgabe 1", "Die Summe"], lines.is_task_instruction) == [True, True, False]
    assert column(spark, ["aber", "Aber", "3 x", "- ja"], lines.opens_lower) == [True, False, False, True]


def test_budget(spark):
    assert column(spark, ["short"], lambda c: md.shorten(c, 20)) == ["short"]
    assert column(spark, ["eine lange Zeile, mit Komma und Rest"], lambda c: md.shorten(c, 20)) == ["eine lange Zeile…"]
    rows = spark.createDataFrame([(["Ein Satz.", "x" * 50, "Er geht.", "Noch einer."],)], "s array<string>")
    assert rows.select(md.lead(F.col("s"), 30)).first()[0] == "Ein Satz. Noch einer."


def test_sentences_rejoin_abbreviations(spark):
    got = column(spark, ["Das ist z. B. gut. Dr. Meier kam am 3. Mai. Ende?"], md.sentence_split)[0]
    assert got == ["Das ist z. B. gut.", "Dr. Meier kam am 3. Mai.", "Ende?"]


def test_full_record(spark):
    page = ("Photosynthese im Blatt\n\nDie Photosynthese ist ein Prozess, bei dem Pflanzen Energie gewinnen. "
            "Sie braucht Licht und Wasser in den Blättern der Pflanzen.\nAlle Rechte vorbehalten")
    df = spark.createDataFrame([(1, page), (2, "")], "d long, t string")
    got = {r["d"]: r for r in md.propose(df, "d", "t").collect()}
    assert got[1]["title"] == "Photosynthese im Blatt"
    assert got[1]["description"].startswith("Die Photosynthese ist ein Prozess")
    assert "Photosynthese" in got[1]["keywords"]
    assert (got[2]["title"], got[2]["description"], got[2]["keywords"]) == ("", "", [])
