"""What the seventh round changed: the same rows as before, from less work."""

from __future__ import annotations


import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tagloom.llm import topk
from tagloom.operators import noise, splits


def test_blocks_of_queries_meet_a_shard_in_one_unit(spark, monkeypatch):
    """F1: a shard travels once per unit, its vectors as the narrowest integers; scores equal brute force across leaves."""
    monkeypatch.setattr(topk, "SHARD", 700)
    monkeypatch.setattr(topk, "BLOCK", 16)
    monkeypatch.setattr(topk, "LEAF", 50)
    monkeypatch.setattr(topk, "STEP", 5)
    rng = np.random.default_rng(5)
    rows = rng.integers(-64, 65, (3000, 8))
    rows[100:400] = rows[99]  # ties across leaves and shards
    frame = spark.createDataFrame(pa.table({"id": pa.array(np.arange(3000)), "vector": pa.array((rows / 64.0).tolist())}))
    got = topk.top_k(frame, F.col("id") % 20 == 0, k=6).toArrow()
    want = set()
    for q in range(0, 3000, 20):
        score = rows @ rows[q]
        best = [i for i in np.lexsort((np.arange(3000), -score)).tolist() if i != q][:6]
        want |= {(q, r, i, int(score[i])) for r, i in enumerate(best, 1)}
    assert set(zip(*(got[c].to_pylist() for c in ("query_id", "rank", "vec_id", "score")), strict=True)) == want
    packed = topk._packed(spark.createDataFrame([(i, [i, -i], 2) for i in range(5)], "id long, v array<long>, dims int"), F.lit(0), "shard").collect()
    assert [(r["kind"], len(r["cells"])) for r in packed] == [("|i1", 10)]


def as_before(text, tag, cut):
    """The noise position by position, with hashlib."""
    ops = [d % 3 if (d := int(hashlib.md5(f"{tag}{i}".encode()).hexdigest()[:3], 16)) < cut else 3 for i in range(len(text))] if tag else [3] * len(text)
    out = []
    for i, c in enumerate(text):
        after, before = ops[i + 1] if i + 1 < len(text) else None, ops[i - 1] if i else None
        out.append(text[i + 1] if ops[i] == 0 and after == 3 else text[i - 1] if ops[i] == 3 and before == 0 else "" if ops[i] == 1 else c * 2 if ops[i] == 2 else c)
    return "".join(out)


def test_noise_of_all_positions_at_once(spark, monkeypatch):
    """digests of many positions side by side draw what they drew one by one; long tags and rate 1 too."""
    monkeypatch.setattr(noise, "SIDE", 64)
    noise._digits.cache_clear()
    texts = ["", "a", "äöü😀 " * 50, "word " * 300, "xy", "no id", "q" * 1001]
    tags = [b"42|1|", b"42|-7|", b"42|123456789|", b"43|" + b"k" * 60 + b"|", b"43|7|", None, b"7|" + b"k" * 49 + b"|"]
    for cut in (123, 2000, 4096):
        assert noise.changed(texts, tags, cut) == [as_before(t, g and g.decode(), cut) for t, g in zip(texts, tags, strict=True)]
    noise._digits.cache_clear()
    monkeypatch.undo()
    rows = spark.createDataFrame([(None, "ab cd"), (1, None), (2, "ein Text " * 40)], "id long, t string")
    got = {r["id"]: r["o"] for r in noise.with_spelling_noise(rows, "t", "id", 0.1, 42, "o").collect()}
    assert got == {None: "ab cd", 1: "", 2: as_before("ein Text " * 40, "42|2|", 410)} and got[2] != "ein Text " * 40


def test_unknown_words_with_all_or_some_known_words_sent(spark, monkeypatch):
    """only words that are not sent to every task are shuffled; ids that repeat or are null are one group."""
    rows = spark.createDataFrame([(1, ["a", "b", "b", "z"]), (2, ["z", "y"]), (2, ["a"]), (None, ["a", "q"]), (None, ["q"]), (3, None), (4, ["a"])], "id long, ws array<string>")
    known = spark.createDataFrame([("a", 9), ("b", 2), ("c", 5)], "w string, df long")
    want = {(1, 4, 1), (2, 3, 2), (None, 3, 2), (4, 1, 0)}
    for sent, words in ((10, 0), (2, 1), (0, 1)):
        monkeypatch.setattr(splits, "SENT_WORDS", sent)
        got = splits.unknown_words(rows, known, "id", "ws")
        assert {tuple(r) for r in got.collect()} == want
        assert ("hashpartitioning(w" in got._jdf.queryExecution().executedPlan().toString()) == bool(words)
