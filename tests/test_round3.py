"""Exact quotas, first-wins state, common words, first bad lines."""

from __future__ import annotations

import os
import random

from pyspark.sql import functions as F

from tagloom.operators import metadata, splits
from tagloom.sources import encoding
from tagloom.streaming import flows


def sequential(rows, need):
    need, taken = dict(need), []
    for row_id, labels in sorted(rows):
        hits = [x for x in set(labels or ()) if need.get(x, 0) > 0]
        if hits:
            taken.append(row_id)
            for x in hits:
                need[x] -= 1
    return taken


def test_quotas_equal_the_sequential_rule(spark, monkeypatch):
    monkeypatch.setattr(splits, "RANGES", 7)
    rng = random.Random(5)
    for trial in range(6):
        rows = [(i * rng.randint(1, 3) + 1000 * i, rng.sample("abcdef", rng.randint(0, 4))) for i in range(rng.randint(1, 90))]
        rows[0] = (rows[0][0], None)
        need = [(x, rng.choice((0, 1, 3, 10, 500))) for x in "abcdxy"]
        got = splits.quota_mine(spark.createDataFrame(rows, "row_id long, labels array<string>"), spark.createDataFrame(need, "label string, need int"), "row_id")
        out = got.collect()
        assert sorted(r["row_id"] for r in out) == sequential(rows, need), trial
        assert all(r["selected_for"] in r["labels"] for r in out)
    empty = spark.createDataFrame([], "row_id long, labels array<string>")
    assert splits.quota_mine(empty, spark.createDataFrame(need, "label string, need int"), "row_id").count() == 0


def test_first_wins_state_over_many_blocks(spark, tmp_path):
    rng = random.Random(4)
    source, first = str(tmp_path / "in"), {}
    blocks = 50
    for block in range(blocks):
        rows = [(block * 100 + i, f"k{rng.randint(0, 150)}") for i in rng.sample(range(100), 8)]
        for row_id, key in sorted(rows):
            first.setdefault(key, row_id)
        spark.createDataFrame(rows, "row_id long, key string").coalesce(1).write.mode("append").json(source)
        for name in os.listdir(source):  # files arrive in the order of their times
            if name.startswith("part-"):
                os.utime(os.path.join(source, name), (1e9 + 10 * block, 1e9 + 10 * block)) if name not in seen_files else None
                seen_files.add(name)
    shuffle = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    stream = spark.readStream.schema("row_id long, key string").option("maxFilesPerTrigger", 1).json(source)
    query = flows.first_wins_stream(stream, "key", "row_id", str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination()
    spark.conf.set("spark.sql.shuffle.partitions", shuffle)
    got = {r["key"]: r["row_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == first
    # a late block touches as many keys of the state as an early one
    updated = [sum(op.numRowsUpdated for op in p.stateOperators) for p in query.recentProgress if p.numInputRows]
    assert len(updated) == blocks and max(updated) <= 8


seen_files: set[str] = set()


def test_common_words_do_not_meet_in_one_task(spark):
    idf = spark.createDataFrame([("the", 0.5), ("of", 4.9), ("rare", 7.0), ("own", 9.0)], "word string, idf double")
    rows = spark.createDataFrame([(i, w) for i in range(40) for w in ("the", "of", "unknown", "own" if i == 3 else "rare")], "doc long, word string")
    got = metadata.with_idf(rows, idf)
    want = rows.join(idf, "word", "left")
    assert sorted(map(str, got.select("doc", "word", "idf").collect())) == sorted(map(str, want.select("doc", "word", "idf").collect()))


def test_first_bad_line_of_real_files(spark, tmp_path):
    lines = [b"plain"] * 3000 + ["zwei é".encode()] * 60 + [b"caf\xe9 one", b"caf\xe9 two"] + [b"plain"] * 3000
    (tmp_path / "a.csv").write_bytes(b"\n".join(lines) + b"\n")
    (tmp_path / "b.csv").write_bytes("nur gültig\n".encode())
    (tmp_path / "c.csv").write_bytes(b"z \xfc\na \xe4\n")
    parts = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    got = {os.path.basename(r["file"]): r for r in encoding.audit_files(spark, str(tmp_path)).withColumn(
        "bad_line", F.decode(F.col("bad_line").cast("binary"), "ISO-8859-1")).collect()}
    spark.conf.set("spark.sql.files.maxPartitionBytes", parts)
    assert got["a.csv"]["bad_line"] == "café one" and got["a.csv"]["encoding"] == "utf-8 replace"
    assert got["b.csv"]["bad_line"] is None and got["b.csv"]["encoding"] == "utf-8"
    assert got["c.csv"]["bad_line"] == "z ü" and got["c.csv"]["encoding"] == "cp1252"
