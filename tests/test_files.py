from __future__ import annotations

import gzip
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from tagloom.session import InputError
from tagloom.sources import delimited, encoding, jsonl


def folder():
    return tempfile.mkdtemp(prefix="tagloom-test-")


def write(path, data):
    with (gzip.open if path.endswith(".gz") else open)(path, "wb") as handle:
        handle.write(data)
    return path


def test_reads_quoted_lines_and_keeps_labels_verbatim(spark):
    path = write(folder() + "/a.csv", 'title;labels;other\n"zwei\nZeilen; mit ""Zitat""";NA;x\nNA;null;\n;;\n'.encode())
    rows = delimited.read_delimited(spark, path, ["title"], "labels").select("title", "labels").collect()
    assert [tuple(r) for r in rows] == [('zwei\nZeilen; mit "Zitat"', "NA"), ("", "null"), ("", "")]
    with pytest.raises(InputError, match="nope"):
        delimited.read_delimited(spark, path, ["nope"], "labels")


def test_row_ids_follow_files_and_positions(spark):
    base = folder()
    for name in ("b.csv", "a.csv.gz"):
        write(f"{base}/{name}", ("t\n" + "\n".join(f"{name}{i}" for i in range(50)) + "\n").encode())
    rows = delimited.with_row_id(delimited.read_delimited(spark, base, ["t"])).orderBy("row_id").collect()
    assert [r["t"] for r in rows] == [f"{n}{i}" for n in ("a.csv.gz", "b.csv") for i in range(50)]


def test_row_counts_page_the_folder(spark):
    base = folder()
    write(f"{base}/a.csv", b'x;y\n"1\n2";3\n4;5\n')
    write(f"{base}/b.CSV", b"x\n1\n")
    write(f"{base}/c.csv.gz", b"x\n1\n2\n3\n")
    write(f"{base}/readme.txt", b"no")
    got = {os.path.basename(r["path"]): r["rows"] for r in delimited.row_counts(spark, base).collect()}
    assert got == {"a.csv": 2, "b.CSV": 1, "c.csv.gz": 3}
    assert [os.path.basename(r["path"]) for r in delimited.row_counts(spark, base, limit=1, offset=1).collect()] == ["b.CSV"]


CASES = {
    "utf8.csv": ("grün ä ö €\n".encode(), "utf-8"), "cp1252.csv": ("grün ä ö €\n".encode("cp1252"), "cp1252"),
    "cut.csv": ("grün ä ö ü ß\n".encode() * 3 + b"\xc3\n", "utf-8 replace"),
    "undefined.csv": (b"gr\xfcn \x81\n", "refused: neither UTF-8 nor Windows-1252"),
    "mixed.csv": ("ä\n".encode() * 20 + b"\xe4\n" * 15, "refused: mixed encodings"), "zip.csv.gz": ("ä\n".encode(), "utf-8"),
}


def test_encoding_audit(spark):
    base = folder()
    for name, (data, _) in CASES.items():
        write(f"{base}/{name}", data)
    got = {os.path.basename(r["file"]): r["encoding"] for r in encoding.audit_files(spark, base).collect()}
    assert got == {name: want for name, (_, want) in CASES.items()}


def test_torn_lines_cost_only_themselves(spark):
    path = write(folder() + "/log.jsonl", b'{"text":"a","model_name":"m","predicted":[],"corrected":["x"]}\n{"text":"b","mod\n\n{"text":"c"}\n')
    records, dropped = jsonl.read_jsonl(spark, path)
    assert sorted(r["text"] for r in records.collect()) == ["a", "c"] and dropped.first()["dropped"] == 1


def test_export_is_never_overwritten(spark):
    df = spark.range(3).select(F.col("id").cast("string").alias("t"))
    path = folder() + "/x.csv"
    delimited.write_delimited(df, path)
    with pytest.raises(Exception, match="(?i)exist"):
        delimited.write_delimited(df, path)
