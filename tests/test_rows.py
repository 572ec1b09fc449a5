"""Loader, dedupe, splits: golden rows, brute force, and independence from partitioning."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tagloom.functions import labels as lb
from tagloom.operators import labels as lab
from tagloom.operators import ranking, splits
from tagloom.plans.load import LoadSpec, load
from tagloom.session import InputError

SPEC = LoadSpec(("title", "description"), "labels", "id", names_column="names")
ROWS = [
    (0, "Algebra", "Gleichungen lösen", "u/a", "Mathe", "", "", ""),
    (1, "ALGEBRA", "gleichungen losen", "u/b", "Bio", "", "", ""),          # same text, other label
    (2, "Zellen", "Aufbau <b>der</b> Zelle", "u/b,u/b, u/c", "Bio,Bio,Rechts-, Links", "u/b", "", ""),
    (3, "Zellen", "aufbau der zelle", "u/b,u/c", "Bio,Chemie", "", "", ""),
    (4, "ab", None, "u/a", "Mathe", "", "", ""),                            # too short
    (5, "Ohne Labels", "Text", "u/", "", "", "", ""),                       # container only
    (6, "Optik", "Licht", "u/a", "NA", "", "", "  "),
]
SCHEMA = "id long, title string, description string, labels string, names string, generated_for string, example_for string, enriched_fields string"


def test_loader_golden_rows(spark):
    for parts in (1, 4, 16):
        done = load(spark.createDataFrame(ROWS, SCHEMA).repartition(parts), SPEC)
        got = {r["row_id"]: (r["text"], r["labels"], r["mark"]) for r in done.rows.collect()}
        assert got == {0: ("Algebra Gleichungen lösen", ["u/a"], 0), 2: ("Zellen Aufbau der Zelle", ["u/b", "u/c"], 1),
                       6: ("Optik Licht", ["u/a"], 0)}
        names = {r["uri"]: r["name"] for r in done.names.collect()}
        assert names == {"u/a": "Mathe", "u/b": "Bio", "u/c": "Rechts-, Links"}


def test_exclude_mode_counts_texts_once(spark):
    rows = [(0, "gleich text", "l", "x"), (1, "gleich text", "l", ""), (2, "gleich text", "l", "x"), (3, "anderer text", "l", ""), (4, "anderer text", "l", "x")]
    df = spark.createDataFrame(rows, "id long, t string, labels string, generated_for string")
    done = load(df, LoadSpec(("t",), "labels", "id", synthetic_rows="exclude"))
    assert sorted(r["row_id"] for r in done.rows.collect()) == [1, 3]
    assert done.counters.first().asDict() == {"excluded_rows": 3, "excluded_generated": 1}


def test_missing_columns_are_refused(spark):
    with pytest.raises(InputError, match="not found"):
        load(spark.createDataFrame(ROWS, SCHEMA), LoadSpec(("nope",), "labels", "id"))


def test_hot_key_gives_one_row(spark):
    df = spark.range(20_000).select(F.col("id"), F.when(F.col("id") % 3 == 0, "hot text").otherwise(F.concat(F.lit("text "), F.col("id").cast("string"))).alias("t"),
                                    F.lit("l").alias("labels"))
    done = load(df, LoadSpec(("t",), "labels", "id"))
    assert done.rows.where("text = 'hot text'").count() == 1 and done.rows.count() == 20_000 - 20_000 // 3


def brute_targets(lists, minimum):
    rows = {i: set(x) for i, x in enumerate(lists) if x}
    while True:
        counts = Counter(label for x in rows.values() for label in x)
        keep = {label for label, n in counts.items() if n >= minimum and len(rows) - n >= minimum}
        new = {i: x & keep for i, x in rows.items() if x & keep}
        if new == rows:
            return {(i, label) for i, x in rows.items() for label in x}
        rows = new


@pytest.mark.parametrize("seed", range(3))
def test_learnable_targets_reach_the_fix_point(spark, seed):
    rng = random.Random(seed)
    lists = [sorted({f"l{min(int(rng.expovariate(0.5)), 9)}" for _ in range(rng.randint(1, 3))} | ({"all"} if rng.random() < 0.93 else set())) for _ in range(60)]
    rows = spark.createDataFrame(list(enumerate(lists)), "row_id long, labels array<string>")
    got = {(r["row_id"], r["label"]) for r in lab.targets(rows, lab.learnable_labels(rows, minimum=5)).collect()}
    assert got == brute_targets(lists, 5)


def test_digest_cuts_are_order_statistics(spark):
    df = spark.range(3000).select(F.col("id").alias("row_id"))
    ordered = [(r["h"], r["row_id"]) for r in df.select("row_id", ranking.shuffle_digest("row_id", 5).alias("h")).orderBy("h", "row_id").collect()]
    assert ranking.digest_cuts(df, "row_id", 5, [0, 1, 1777, 3000]) == [None, ordered[0], ordered[1776], ordered[-1]]


def test_running_sums_match_a_plain_scan(spark):
    rng = random.Random(1)
    data = [("g" + str(rng.randint(0, 1)), rng.randint(-50, 5_000_000), 1) for _ in range(400)]
    got = {(r["g"], r["k"]): r["v"] for r in ranking.running_sums(spark.createDataFrame(data, "g string, k long, v long"), ["g"], "k", ["v"]).collect()}
    for (g, k), v in got.items():
        assert v == sum(1 for a, b, _ in data if a == g and b >= k)


def test_three_way_sizes_and_cover(spark):
    df = spark.range(997).select(F.col("id").alias("row_id"))
    for parts in (1, 7):
        sizes = {r["part"]: r["count"] for r in splits.three_way(df.repartition(parts), "row_id", 3).groupBy("part").count().collect()}
        assert sizes == {"train": 997 - 300, "val": 150, "test": 150}
    with pytest.raises(InputError):
        splits.three_way(df, "row_id", 3, 0.5, 0.5)
    with pytest.raises(InputError):
        splits.folds(df.limit(2), "row_id", 3, 5)


def test_stratified_folds_spread_rare_labels(spark):
    rng = random.Random(2)
    lists = [[f"c{rng.randint(0, 2)}"] + (["rare"] if i % 100 == 0 else []) for i in range(600)] + [[]] * 9
    rows = spark.createDataFrame(list(enumerate(lists)), "row_id long, labels array<string>")
    dealt = splits.stratified(rows, [1, 1, 1], 42)
    assert dealt.count() == 609
    spread = {r["part_no"]: r["n"] for r in dealt.where(F.array_contains("labels", "rare")).groupBy("part_no").agg(F.count("*").alias("n")).collect()}
    assert spread == {0: 2, 1: 2, 2: 2}
    counts = [r["n"] for r in dealt.select("part_no", F.explode("labels").alias("l")).where("l = 'c1'").groupBy("part_no").agg(F.count("*").alias("n")).collect()]
    assert max(counts) - min(counts) <= 4


def test_quota_mining_never_overfills(spark):
    rows = spark.createDataFrame([(i, [f"w{i % 3}"] + (["w0"] if i % 2 else [])) for i in range(200)], "row_id long, labels array<string>")
    needed = spark.createDataFrame([("w0", 10), ("w1", 20), ("w2", 500)], "label string, need int")
    picked = splits.quota_mine(rows, needed, "row_id").groupBy("selected_for").count().collect()
    got = {r["selected_for"]: r["count"] for r in picked}
    assert got.get("w0", 0) <= 10 and got["w1"] <= 20
    assert got["w2"] == 66  # every row that carries it, though fewer than wanted


def test_lowest_share_with_ties(spark):
    df = spark.createDataFrame([(i, i % 5) for i in range(100)], "row_id long, v int")
    got = splits.lowest_share(df, "v", "row_id", 1, 0.25).collect()
    assert len(got) == 25 and sum(r["v"] == 0 for r in got) == 20 and all(r["v"] <= 1 for r in got)


def test_name_pairs_that_cannot_be_paired(spark):
    df = spark.createDataFrame([(["a", "b"], ["X", "Y", "Z"]), (["a"], ["Rechts-", "Links"]), (["a", "b"], ["X (u", "v)", "W"])], "u array<string>, n array<string>")
    got = [[tuple(p) for p in r[0]] for r in df.select(lb.pair_names(F.col("u"), F.col("n"))).collect()]
    assert got == [[], [("a", "Rechts-, Links")], [("a", "X (u, v)"), ("b", "W")]]
