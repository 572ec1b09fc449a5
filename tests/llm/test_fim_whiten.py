from __future__ import annotations

import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagloom.llm import fim, queries, whiten

SF = "/root/testdata/sf0.001"


def brute_fim(doc_id: int | None, text: str | None, rate: int, spm: int, seed: int) -> tuple:
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i:8 * i + 8], 16) for i in range(4))
    x, y = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = ("".join(u) for u in (units[:x], units[x:y], units[y:]))
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= rate:
        return doc_id, len(units), "plain", None, None, text
    form = "spm" if h4 % 100 < spm else "psm"
    return doc_id, len(units), form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


def texts() -> list[tuple[int | None, str | None]]:
    rng = random.Random(4)
    letters = "ab é漢😀\n\n\r<>PSM "
    rows: list[tuple[int | None, str | None]] = [(i, "".join(rng.choice(letters) for _ in range(rng.choice((1, 5, 60, 3000, 9000))))) for i in range(120)]
    rows += [(200, None), (201, ""), (202, "\n"), (203, "\n\n\n"), (204, "no line feed"), (205, "a<M>b"), (206, "<S"), (207, "x\n<"), (None, "one\ntwo\nthree"),
             (208, "é" * 5000), (209, ("line\n" * 400) + "end"), (209, ("line\n" * 400) + "end"), (210, "x" * 1023 + "\n" + "y" * 1023 + "\n"), (211, "z\n" * 200_000)]
    return rows


@pytest.mark.parametrize("rate, spm, block", [(100, 50, 1024), (60, 20, 7), (0, 50, 1024)])
def test_rearranged_equals_brute_force(spark, monkeypatch, rate, spm, block):
    monkeypatch.setattr(fim, "BLOCK", block)
    rows = texts()
    docs = spark.createDataFrame([(i, t, 1, "f") for i, t in rows], "doc_id long, text string, n int, form string")
    out = fim.transformed(docs, rate=rate, spm=spm, seed=11).withColumn("back", fim.restored(F.col("output"), F.col("form")))
    got = [tuple(r) for r in out.collect()]
    assert sorted((g[:6] for g in got), key=repr) == sorted((brute_fim(i, t, rate, spm, 11) for i, t in rows), key=repr)
    assert sorted((g[0], g[6]) for g in got if g[0] is not None) == sorted((i, t or "") for i, t in rows if i is not None)
    assert fim.transformed(docs.limit(0)).count() == 0


def test_cuts_after_every_unit():
    rng = random.Random(1)
    for blocks in (1, 2, 3, 8, 13):
        text = "".join(rng.choice("aé\n") for _ in range(blocks * fim.BLOCK // 2)).encode()
        cuts, at = fim.Cuts.of(np.frombuffer(text, np.uint8)), 0
        units = re.findall(rb"[^\n]*\n|[^\n]+", text)
        assert cuts.n == len(units)
        for k in range(len(units) + 1):
            assert cuts.after(k) == (at, len(text[:at].decode()))
            at += len(units[k]) if k < len(units) else 0


def brute_white(vectors: list[list[float]], k: int):
    x = np.array([[math.floor(1024 * c) + 100000 for c in v] for v in vectors])
    n, sums = len(x), x.sum(axis=0)
    y = x - sums / n
    values, turn = np.linalg.eigh(y.T @ y / n)
    values, turn = values[::-1][:k], turn[:, ::-1][:, :k]
    return ((n * x - sums) ** 2).sum(axis=1), y @ turn / np.sqrt(values), values / (y * y).sum() * n


def test_whitened_equals_dense_eigenvectors(spark):
    rng = np.random.default_rng(3)
    vectors = (rng.standard_normal((500, 12)) * np.linspace(0.05, 1, 12) + 3).tolist()
    rows = [(i, v, 1) for i, v in enumerate(vectors)]
    odd = [(900, None, 1), (901, [], 1), (902, [None] + [1.0] * 11, 1), (903, [float("nan")] * 12, 1), (904, [float("-inf")] + [1.0] * 11, 1), (905, [1.0, 2.0], 1)]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, component int")
    got = whiten.whitened_rows(frame, k=5).collect()
    deviation, white, explained = brute_white(vectors, 5)
    assert len(got) == 2500 and {r["n"] for r in got} == {500} and {r["vec_id"] for r in got} == set(range(500))
    mine = np.zeros((500, 5))
    for r in got:
        mine[r["vec_id"], r["component"] - 1] = r["whitened"]
        assert r["deviation"] == deviation[r["vec_id"]] and abs(r["explained"] / explained[r["component"] - 1] - 1) < 1e-10
    assert np.abs(mine * np.sign((mine * white).sum(axis=0)) - white).max() < 1e-9
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-10


def test_whitening_of_degenerate_tables(spark):
    schema = "vec_id long, embedding array<double>"
    assert whiten.whitened_rows(spark.createDataFrame([], schema)).count() == 0
    assert whiten.whitened_rows(spark.createDataFrame([(1, None), (2, [])], schema)).count() == 0
    assert whiten.whitened_rows(spark.createDataFrame([(1, [1.0, 2.0]), (1, [1.0, 2.0])], schema)).count() == 0
    # three points in five dimensions: two components; repeated and null ids stay
    flat = spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.0, 0.0]), (1, [0.0, 2.0, 0.0, 0.0, 0.0]), (None, [0.0, 0.0, 3.0, 0.0, 0.0])], schema)
    got = whiten.whitened_rows(flat).collect()
    assert len(got) == 6 and got[0]["identity_error"] < 1e-9 and {r["component"] for r in got} == {1, 2}
    # equal eigenvalues, more of them than asked for
    cross = [(i, [float(s if j == i else 0) for j in range(6)]) for i in range(6) for s in (-1, 1)]
    got = whiten.whitened_rows(spark.createDataFrame(cross, schema), k=3).collect()
    assert len(got) == 36 and got[0]["identity_error"] < 1e-9
    # entries so large that squares leave a long: the exact deviation is null, and nothing fails
    huge = spark.createDataFrame([(i, [1e15 * i, float(i % 3), -1e300]) for i in range(9)], schema)
    got = whiten.whitened_rows(huge, k=1).collect()
    assert len(got) == 9 and {r["deviation"] for r in got} == {None} and got[0]["identity_error"] < 1e-6


def test_inertia_and_contours():
    rng = np.random.default_rng(8)
    for d in (1, 2, 5, 24, 60):
        turn = np.linalg.qr(rng.standard_normal((d, d)))[0]
        values = np.sort(rng.choice([0.0, 1.0, 1.0 + 1e-6, 2.0, 5.0], d) + rng.choice([0, 1e-3], d))[::-1]
        a = (turn * values) @ turn.T
        a = (a + a.T) / 2
        for cut in (-1.0, 0.5, 1.5, 3.3, 7.0):
            assert whiten.above(a, cut) == (values > cut).sum()
        k = min(8, int((values > 1e-9).sum()))
        got, vectors = whiten.components(a, 8)
        assert np.allclose(got, values[:len(got)], atol=1e-12) and len(got) == k
        assert np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-12
        assert np.abs(a @ vectors - vectors * got).max() < 1e-12


def test_whole_table_against_dense_eigenvectors(spark):
    got = queries.QUERIES["op12_embedding_whitening"](spark, SF).collect()
    rows = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    ids = sorted(rows)
    deviation, white, explained = brute_white([rows[i] for i in ids], 8)
    mine = np.zeros((len(ids), 8))
    for r in got:
        mine[ids.index(r["vec_id"]), r["component"] - 1] = r["whitened"]
        assert r["deviation"] == deviation[ids.index(r["vec_id"])]
        assert abs(r["explained"] / explained[r["component"] - 1] - 1) < 1e-9
    assert np.abs(mine * np.sign((mine * white).sum(axis=0)) - white).max() < 1e-8 and got[0]["identity_error"] < 1e-9
