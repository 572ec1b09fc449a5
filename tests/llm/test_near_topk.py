from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from tagloom.llm import graph, near, topk

SF = "/root/testdata/sf0.001"


def brute_components(rows: list[tuple[int | None, str | None]], width: int, percent: int = 80) -> list[int | None]:
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets.append({tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and 100 * both >= percent * len(a | sets[j]):
                root[find(i)] = find(j)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((min(ids) if ids else None) if sets[i] else doc_id)
    return out


def near_copies() -> list[tuple[int | None, str | None]]:
    rng = random.Random(5)
    rows: list[tuple[int | None, str | None]] = []
    for g in range(12):
        base = [f"w{rng.randint(0, 3000)}" for _ in range(rng.randint(30, 300))]
        for _ in range(rng.randint(1, 12)):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 24))):
                w[rng.randrange(len(w))] = f"x{rng.randint(0, 9999)}"
            rows.append((len(rows) * 3, " ".join(w)))
    rows += [(900, rows[0][1].upper()), (None, rows[1][1]), (rows[2][0], rows[2][1]), (901, None), (902, ""), (903, " \n"), (904, "one"), (905, "ONE"), (906, "two")]
    return rows


@pytest.mark.parametrize("width", [2, 5])
def test_components_equal_brute_force(spark, width):
    rows = near_copies()
    docs = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, node string")
    got = near.groups_of(docs, width).collect()
    want = sorted(zip([i for i, _ in rows], brute_components(rows, width), strict=True), key=str)
    assert sorted(((r["doc_id"], r["component_id"]) for r in got), key=str) == want
    firsts = near.first_of_each(docs, width)
    assert firsts.columns == docs.columns
    alive = [r["doc_id"] for r in firsts.collect() if r["text"] and r["text"].strip()]
    assert sorted(alive) == sorted({c for (_, t), (_, c) in zip(rows, zip(rows, brute_components(rows, width), strict=True), strict=True) if t and t.strip()})
    assert near.groups_of(docs.limit(0), width).count() == 0


def test_columns_of_the_caller_stay_as_they_are(spark):
    names = ("key", "row", "_key", "_digest", "node", "h")
    rows = [(i, t, *[f"{c}{i}" for c in names]) for i, t in enumerate(["one two three four five six", "one two three four five six", "", None, "seven eight"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{c} string" for c in names))
    got = near.first_of_each(docs)
    assert got.columns == docs.columns and sorted(map(tuple, got.collect())) == [rows[i] for i in (0, 2, 3, 4)]


def test_hub_joins_copies_that_are_not_alike(spark):
    rng = random.Random(9)
    base = [f"w{i}" for i in range(200)]
    rows = [(0, " ".join(base))]
    for k in range(1, 120):
        w = list(base)
        for at in rng.sample(range(200), 18):
            w[at] = f"x{k}_{at}"
        rows.append((k, " ".join(w)))
    got = near.groups_of(spark.createDataFrame(rows, "doc_id long, text string"), width=2)
    assert {r["component_id"] for r in got.collect()} == set(brute_components(rows, 2))


def test_linked_pairs_among_texts_of_one_template(spark, monkeypatch):
    monkeypatch.setattr(near, "BLOCK", 50)
    rng = random.Random(3)
    template = [f"t{i}" for i in range(170)]
    rows: list[tuple[int, str]] = []
    for k in range(300):  # 170 of 203 words are shared by all: 0.71 alike; each with its pair 0.8 or more
        own = [f"k{k}_{i}" for i in range(33)]
        rows.append((2 * k, " ".join(template + own)))
        rows.append((2 * k + 1, " ".join(template + own[:-rng.randint(16, 21)] + [f"z{k}_{i}" for i in range(18)])))
    rng.shuffle(rows)
    got = {r["doc_id"]: r["component_id"] for r in near.groups_of(spark.createDataFrame(rows, "doc_id long, text string"), width=2).collect()}
    want = dict(zip([i for i, _ in rows], brute_components(rows, 2), strict=True))
    assert got == want and len(set(want.values())) == 300


def test_components_of_long_chains(spark):
    links = spark.range(1, 300).select(F.col("id").alias("a"), (F.col("id") - 1).alias("b")).union(spark.createDataFrame([(901, 905), (905, 900)], "a long, b long"))
    got = {r["node"]: r["root"] for r in graph.components(links).collect()}
    assert got == {i: 0 for i in range(300)} | {900: 900, 901: 900, 905: 900}


def brute_top(rows, k):
    import math
    def held(x, bits):
        return max(-(1 << bits), min((1 << bits) - (bits == 63), x))

    good = [(i, [held(math.floor(64 * x), 62) for x in v]) for i, v in rows
            if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in good:
        if q % 20 == 0:
            best = sorted((-held(sum(x * y for x, y in zip(a, b, strict=True)), 63), i) for i, b in good if i != q and len(a) == len(b))[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    return sorted(out)


def test_top_k_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD", 60)
    monkeypatch.setattr(topk, "BLOCK", 7)
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(400)]
    rows += [(i, [0.5, -0.25, 1.0, 0.0, 2.0, -1.0]) for i in range(400, 520)]  # equal vectors: ties go to smaller ids
    rows += [(520, None), (540, []), (560, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (580, [float("nan")] * 6), (600, [float("inf")] + [0.0] * 5),
             (None, [1.0] * 6), (620, [1.0, 2.0]), (621, [3.0, -1.0]), (640, [1e13] * 6), (641, [1e13] * 6), (660, [1e17, -1e300, 0.0, 0.0, 0.0, 1.0]), (661, [-1e17] * 6)]
    frame = spark.createDataFrame([(i, v, 0) for i, v in rows], "id long, vector array<double>, score int")
    got = topk.top_k(frame, F.col("id") % 20 == 0, k=5)
    assert sorted(tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()) == brute_top(rows, 5)
    assert topk.top_k(frame.limit(0), F.col("id") % 20 == 0).count() == 0
