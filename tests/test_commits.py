"""Additions are seen whole or not at all, once, and in order; pages equal an offset over all rows."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

from tagloom.operators import corrections as co
from tagloom.operators.paging import page
from tagloom.plans.evaluate import append_record
from tagloom.session import InputError
from tagloom.sources import commits
from tagloom.sources.commits import AppendTable

SCHEMA = "pos long, model_name string, text string, predicted array<string>, corrected array<string>, source string, recorded_at string"


def record(pos, text, name="subjects", labels=("u:hist",), at="2026-10-01T08:00:00+00:00", source=None):
    return (pos, name, text, ["u:a"], list(labels), source, at)


def frame(spark, *records):
    return spark.createDataFrame(list(records), SCHEMA)


def texts(table):
    return [r["text"] for r in table.read().orderBy("pos").collect()]


def test_an_import_appends_once_and_counts(spark, tmp_path):
    book = AppendTable(spark, str(tmp_path / "log"))
    first = frame(spark, record(5, "one"), record(9, "two"), record(12, "one"))
    assert co.import_into(book, first, "a") == {"imported": 2, "duplicates": 1, "invalid": 0}
    assert co.import_into(book, first, "a") == {"imported": 2, "duplicates": 1, "invalid": 0}  # the same job again
    assert co.import_into(book, first, "b") == {"imported": 0, "duplicates": 3, "invalid": 0}
    more = frame(spark, record(1, "three"), record(2, "../x", name="../etc"), record(3, "four", at=None), record(4, "two"))
    assert co.import_into(book, more, "c") == {"imported": 1, "duplicates": 1, "invalid": 2}
    assert texts(book) == ["one", "two", "three"] and book.versions() == [0, 1, 2]
    assert [r["pos"] for r in book.read().orderBy("pos").collect()] == [0, 1, 2]


def test_problems_are_named_and_bounds_are_parameters(spark):
    rows = frame(spark, record(1, ""), record(2, "ok", labels=["x" * 501]), record(3, None, name=None, at=None), record(4, "fine", source="s" * 51), record(5, "good"))
    got = {r["pos"]: (r["outcome"], r["problems"]) for r in co.classify_import(rows, None).collect()}
    assert got == {1: ("invalid", ["text"]), 2: ("invalid", ["corrected"]), 3: ("invalid", ["text", "recorded_at", "model_name"]),
                   4: ("invalid", ["source"]), 5: ("imported", [])}
    wide = co.Bounds(label_chars=600, source_chars=60)
    got = {r["pos"]: r["outcome"] for r in co.classify_import(rows, None, wide).collect()}
    assert got == {1: "invalid", 2: "imported", 3: "invalid", 4: "imported", 5: "imported"}


def test_a_crash_between_data_and_manifest_leaves_nothing(spark, tmp_path, monkeypatch):
    book = AppendTable(spark, str(tmp_path / "log"))
    co.import_into(book, frame(spark, record(1, "one")), "a")

    def crash(self, manifest):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(AppendTable, "_put", crash)
        with pytest.raises(RuntimeError):
            co.import_into(book, frame(spark, record(2, "two")), "b")
    assert texts(book) == ["one"] and book.committed("b") is None and len(book.leftovers()) == 1
    assert book.clean(3600) == [] and len(book.clean(0)) == 1 and book.leftovers() == []
    assert co.import_into(book, frame(spark, record(2, "two")), "b")["imported"] == 1
    assert texts(book) == ["one", "two"]


def test_of_two_writers_the_slower_decides_anew(spark, tmp_path):
    book, other = (AppendTable(spark, str(tmp_path / "log")) for _ in range(2))
    calls = []

    def slow(log):
        calls.append(log)
        if len(calls) == 1:  # somebody else adds the same record meanwhile
            co.import_into(other, frame(spark, record(1, "one"), record(2, "theirs")), "other")
        out = co.classify_import(frame(spark, record(1, "one"), record(3, "mine")), log)
        return out.where("outcome = 'imported'").drop("problems", "outcome"), {}

    assert book.append(slow, "mine").version == 1
    assert len(calls) == 2 and texts(book) == ["one", "theirs", "mine"] and book.leftovers() == []


def test_many_versions_and_other_columns(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(commits, "KEEP", 4)
    book = AppendTable(spark, str(tmp_path / "log"))
    with pytest.raises(InputError):
        book.read()
    for k in range(10):
        book.append(lambda _, k=k: (spark.createDataFrame([(7, f"x{k}"), (3, f"w{k}")], "pos long, text string"), {"k": k}), f"batch {k}")
    assert texts(book) == [f"{c}{k}" for k in range(10) for c in "wx"]
    assert [m.version for m in book.history()] == [8, 9] and book.committed("batch 2").facts == {"k": 2}
    assert book.append(lambda _: (_ for _ in ()).throw(AssertionError), "batch 5").version == 5
    with pytest.raises(InputError):
        book.append(lambda _: (spark.createDataFrame([(1, 2)], "pos long, text long"), {}), "other columns")
    assert sorted(os.listdir(tmp_path / "log" / "_log")) == sorted(n for v in range(10) for n in (f"{v:012d}.json", f".{v:012d}.json.crc")
                                                                   if os.path.exists(tmp_path / "log" / "_log" / n))


def test_evaluations_are_added_once(spark, tmp_path):
    book = AppendTable(spark, str(tmp_path / "evaluations"))
    result = spark.createDataFrame([(0.5, 10)], "f1_micro double, n_rows long")
    for batch in ("run 1", "run 1", "run 2"):
        append_record(result, book, batch, model_name="subjects")
    rows = book.read().orderBy("pos").collect()
    assert [(r["pos"], r["f1_micro"], r["model_name"]) for r in rows] == [(0, 0.5, "subjects"), (1, 0.5, "subjects")]


def test_pages_equal_offsets(spark, monkeypatch):
    from tagloom.operators import paging
    monkeypatch.setattr(paging, "RANGES", 5)
    monkeypatch.setattr(paging, "FEW", 3)
    rng = random.Random(3)
    keys = sorted(rng.sample(range(-50, 4000), 180)) + [10**15, 10**15 + 1]
    rows = spark.createDataFrame([(k, f"t{k}") for k in keys] + [(None, "none")], "pos long, text string").repartition(4)
    for falling in (False, True):
        ordered = keys[::-1] if falling else keys
        for limit, offset in ((1, 0), (7, 0), (7, 33), (500, 100), (3, 181), (3, 182), (5, 900), (None, 0), (None, 50), (None, 181)):
            got = page(rows, "pos", limit, offset, newest_first=falling)
            assert [r["pos"] for r in got.collect()] == ordered[offset:None if limit is None else offset + limit], (falling, limit, offset)
    assert page(rows.limit(0), "pos", 3, 2).count() == 0
    plan = page(rows, "pos", 4, 100)._jdf.queryExecution().optimizedPlan().toString()
    assert "Offset 100" not in plan
