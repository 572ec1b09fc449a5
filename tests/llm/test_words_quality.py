from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tagloom.llm import quality, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def random_texts(seed: int, n: int = 120) -> list[str | None]:
    rng = random.Random(seed)
    parts = ["a", "B", "ß", "été", " ", "\n", "\t", " ", "***", "|", "w1", "w2", "w3", "!", "\x0b", "\r\n", "😀"]
    out: list[str | None] = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 80))) for _ in range(n)]
    return out + [None, "", " ", "\n\n", "one", "x " * 300, "l1 a\nl1 a\n \nl1 a"]


def lowered(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m.group().lower(), text)


def brute_measures(text: str | None) -> dict[str, int]:
    text = text or ""
    w = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows: dict[tuple, list[int]] = {}
    for i in range(len(w) - 7):
        windows.setdefault(tuple(w[i:i + 8]), []).append(i)
    covered = {j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in text),
            "n_dup_lines": dup, "n_repeat_words": len(covered)}


@pytest.mark.parametrize("size", [1, 64, words.BLOCK_BYTES])
def test_shingles_and_measures_equal_brute_force(size):
    texts = random_texts(3)
    got: list[dict] = []
    sets: list[int] = []
    column = pa.array(["skipped", *texts])[1:]
    for b in words.blocks(column, size):
        m = quality.measure_block(b)
        got += [{k: int(m[k][i]) for k in brute_measures("")} for i in range(b.texts)]
        values, bounds = words.shingle_sets(words.words(b, lower=True), 2)
        sets += np.diff(bounds).tolist()
    assert got == [brute_measures(t) for t in texts]
    for t, n in zip(texts, sets, strict=True):
        w = WORD.findall(lowered(t or ""))
        assert n == len({tuple(w[i:i + 2]) for i in range(max(1, len(w) - 1))} if w else ())


def test_equal_words_have_equal_hashes_anywhere():
    a = words.words(next(words.blocks(pa.array(["Foo bar", "xx foo", None, "BAR foo"]))), lower=True)
    assert a.hashes[0] == a.hashes[3] == a.hashes[5] == np.uint64(words.hash_text("foo")) and a.hashes[1] == a.hashes[4]
    assert a.bounds.tolist() == [0, 2, 4, 4, 6]


def test_bucket_error_is_bounded(spark):
    rows = (spark.range(0, 60_000, 7).select("id", quality.bucket_top(quality.bucket(F.col("id"))).alias("top"))
            .agg(F.min(F.col("top") - F.col("id")).alias("least"), F.max(F.col("top") / F.greatest(F.col("id"), F.lit(1))).alias("most")).first())
    assert rows["least"] >= 0 and rows["most"] <= 1 + 1 / 16


def test_fences_reject_junk_and_keep_clean(spark):
    rng = random.Random(1)
    clean = [" ".join(rng.choice("alpha beta gamma delta eps zeta".split()) + str(rng.randint(0, 999)) for _ in range(60)) for _ in range(200)]
    junk = [" ".join(f"w{rng.randint(0, 999)}$$$" for _ in range(60)) for _ in range(60)]
    rows = [(i, t, "en", "hot" if i % 2 else None, "x") for i, t in enumerate(clean + junk + ["short", None, ""])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, m string")
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(200))
    assert quality.keep_good(docs.limit(0)).count() == 0
