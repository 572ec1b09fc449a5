"""n-grams found by one search equal those cut word by word."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tagloom.functions import ngrams

PARTS = ["a", "ab", "abc", "abcd", "planet", "säure", "😀", "😀x", "a😀b😀c😀", "x́y", "-", " ", "\n", "\t ", "\x0b", "\r\n", " ", " "]


def texts() -> list[str | None]:
    rng = random.Random(4)
    return [None, "", " ", "a", " a ", "ab cd", *("".join(rng.choices(PARTS, k=rng.randint(1, 25))) for _ in range(400))]


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 7])
def test_character_runs(spark, n):
    frame = spark.createDataFrame([(t,) for t in texts()], "t string")
    by_word = F.flatten(F.transform(ngrams.spaced_words(F.col("t")), lambda w: ngrams.word_char_runs(w, n)))
    for r in frame.select("t", ngrams.padded_char_runs(F.col("t"), n).alias("got"), by_word.alias("want")).collect():
        assert r["got"] == r["want"], r["t"]


@pytest.mark.parametrize("n", [1, 2, 3])
def test_word_runs(spark, n):
    frame = spark.createDataFrame([(t,) for t in texts()], "t string").select("t", ngrams.word_tokens(F.col("t")).alias("w"))
    for r in frame.select("t", "w", ngrams.joined_runs(F.col("w"), n).alias("got")).collect():
        w = r["w"]
        assert r["got"] == (w if w is None else [" ".join(w[i:i + n]) for i in range(len(w) - n + 1)]), r["t"]


def test_no_lambda_builds_a_run(spark):
    frame = spark.createDataFrame([("x",)], "t string").select(F.split("t", " ").alias("w"), "t")
    plan = frame.select(ngrams.padded_char_runs(F.col("t")), ngrams.joined_runs(F.col("w"), 2))._jdf.queryExecution().analyzed().toString()
    assert "lambda" not in plan
