"""Normal forms equal the standard library's, on every assigned code point and on random runs of marks."""

from __future__ import annotations

import random
import unicodedata

from pyspark.sql import functions as F

from tagloom.functions import unicode


def assigned() -> list[str]:
    return [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) != "Cn"]


def folded(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not "̀" <= c <= "ͯ")


def both(spark, texts: list[str | None]) -> tuple[list[str | None], list[str | None]]:
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(8)
    got = {r["i"]: r for r in frame.select("i", unicode.strip_accents(F.col("t")).alias("plain"), unicode.compose(F.col("t")).alias("composed")).collect()}
    return [got[i]["plain"] for i in range(len(texts))], [got[i]["composed"] for i in range(len(texts))]


def test_every_assigned_code_point(spark):
    chars = assigned()
    plain, composed = both(spark, chars)
    assert [c for c, got in zip(chars, plain, strict=True) if got != folded(c)] == []
    assert [c for c, got in zip(chars, composed, strict=True) if got != unicodedata.normalize("NFC", c)] == []


def test_random_runs_of_marks_and_jamo(spark):
    rng = random.Random(6)
    chars, known = assigned(), unicode.tables()
    pools = [list(known.weights), [p[1] for p in known.pairs], [p[0] for p in known.pairs], chars, list("aeo \n"),
             [chr(c) for c in (*range(0x1100, 0x1113), *range(0x1161, 0x1176), *range(0x11A7, 0x11C3), 0xAC00, 0xAC01, 0xD7A3)]]
    texts: list[str | None] = ["".join(rng.choice(rng.choice(pools)) for _ in range(rng.randint(1, 14))) for _ in range(4000)]
    plain, composed = both(spark, texts)
    assert [t for t, got in zip(texts, plain, strict=True) if got != folded(t)] == []
    assert [t for t, got in zip(texts, composed, strict=True) if got != unicodedata.normalize("NFC", t)] == []


def test_long_empty_and_null_texts(spark):
    texts = [None, "", "한국어 " * 30_000, "ẹ́" * 30_000, "́", "̣́", "x" * 100_000]
    plain, composed = both(spark, texts)
    assert plain == [t if t is None else folded(t) for t in texts]
    assert composed == [t if t is None else unicodedata.normalize("NFC", t) for t in texts]


def test_long_common_text_does_not_go_through_the_tables(spark):
    import time

    text = "Größe und Maß, señor, «déjà vu» … 'plain words and no marks' – " * 60_000
    both(spark, ["warm ü"])
    start = time.time()
    plain, composed = both(spark, [text])
    took = time.time() - start
    assert plain == [folded(text)] and composed == [text]
    assert took < 12  # four million characters: 0.5 s each; range by range it was more than 20 s
