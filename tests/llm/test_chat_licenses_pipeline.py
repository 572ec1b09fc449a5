from __future__ import annotations

import random
import re

import pyarrow as pa
import pytest

from tagloom.llm import chat, licenses, queries, toxic, words
from tests.oracle_check import compare

SF = "/root/testdata/sf0.001"
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equals_sql(spark, duck, name):
    assert compare(queries.QUERIES[name](spark, SF), duck, queries.SQL[name]) == ""


def test_chat_statuses(spark):
    calls = spark.createDataFrame([
        ("c", "1", 0, "add", '{"b": 2, "a":1}', "x"), ("c", "2", 1, "add", '{"a":"one","z":[1]}', "x"), ("c", "3", 2, "nope", "{}", "x"),
        ("c", "4", 3, "add", "[1]", "x"), ("c", "5", 4, "add", None, "x"), ("c", None, 5, "add", "{}", "x"), ("c", "1", 6, "add", '{"a":1,"b":2}', "x"),
        ("c", "7", 7, "add", '{"a":1,"b":2}', "x"), ("c", "8", 8, "add", '{"a":1,"b":2.5}', "x"), ("c", "9", 9, "add", '{"a":1,"b":200}', "x"),
        ("c", "10", 10, "add", '{"a":1,"b":3}', "x"),
    ], "chat_id string, call_id string, position int, tool string, arguments string, level string")
    results = spark.createDataFrame([("c", "1", 1, "two"), ("c", "1", 9, "late"), ("c", "zz", 3, "lost"), ("c", None, 3, "none"), ("c", "10", 4, None)],
                                    "chat_id string, call_id string, position int, content string")
    links = spark.createDataFrame([("2", "1"), ("3", "2"), ("3", "1"), ("7", "8"), ("8", "7"), ("9", "8"), ("4", "missing"), ("3", "1")], "call_id string, after string")
    schemas = spark.createDataFrame([("add", "a", "integer", True, None, None), ("add", "b", "number", True, 0.0, 100.0), ("add", "c", "string", False, None, None)], chat.SCHEMA)
    rows = {(r["call_id"], r["position"]): r for r in chat.linked(calls, results, links, schemas).collect()}
    assert {k: r["status"] for k, r in rows.items()} == {
        ("1", 0): "ok", ("2", 1): "invalid", ("3", 2): "unknown_tool", ("4", 3): "bad_json", ("5", 4): "bad_json", (None, 5): "no_id",
        ("1", 6): "repeated", ("7", 7): "cycle", ("8", 8): "cycle", ("9", 9): "invalid", ("10", 10): "ok", ("zz", 3): "orphan"}
    assert rows["1", 0]["message"] == '{"arguments":{"a":1,"b":2},"id":"1","name":"add","result":"two"}'
    assert rows["2", 1]["errors"] == "missing:b,type:a,unknown:z" and rows["9", 9]["errors"] == "range:b"
    assert [rows[k]["level"] for k in (("1", 0), ("2", 1), ("3", 2), ("9", 9))] == [0, 1, 2, None]
    none = chat.linked(calls.limit(0), results.limit(0), links.limit(0), schemas.limit(0))
    assert none.count() == 0


def test_levels_of_random_graphs(spark):
    rng = random.Random(6)
    links = [(i, rng.randrange(i)) for i in range(1, 60) for _ in range(rng.choice([0, 1, 1, 1, 2, 3]))]
    links += [(100 + i, 99 + i) for i in range(1, 150)] + [(300, 301), (301, 302), (302, 300), (303, 302), (304, 304), (305, 304), (305, 5)]
    nodes = sorted({x for pair in links for x in pair} | {400})
    want: dict[int, int] = {}
    for n in (x for x in nodes if not 300 <= x <= 305):
        want[n] = max((want[b] + 1 for a, b in links if a == n), default=0)
    text = [(str(a), str(b)) for a, b in links] + [("7", "gone"), ("gone", "7")]
    got = chat.levels(spark.createDataFrame([(str(n),) for n in nodes], "call_id string"),
                      spark.createDataFrame(text, "call_id string, after string"))
    assert {int(r["call_id"]): r["level"] for r in got.collect()} == want


def brute_licenses(text: str | None) -> tuple:
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    places = [(i, label) for p, label in PHRASES.items() for i in range(len(w)) if w[i:i + len(p.split())] == p.split()]
    at = [i for i, _ in places]
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def test_license_places_equal_brute_force(spark):
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    texts += [None, "", "under the\nMIT-License; CC BY-NC, CC-BY-NC-SA", "é under the mit license é", "under the mit licenses", "Apache License, Version 2.0 " * 3000]
    rows = [r for b in words.blocks(pa.array(texts)) for r in licenses.scan_block(b)]
    assert [r[:5] for r in rows] == [brute_licenses(t) for t in texts]


def test_rules_and_containment():
    def labels(text):
        return licenses.scan_block(next(words.blocks(pa.array([text]))))[0][5]
    assert len(licenses.rules()) >= 300
    assert labels("This work is licensed under the GNU General Public License, version 3.") == "gpl-3"
    assert labels("GNU General Public License") == "gpl"
    assert labels("SPDX-License-Identifier: Apache-2.0 and BSD 3-Clause License") == "apache-2,bsd-3"
    assert labels("der mann mit dem hund") == ""
    assert licenses.resolved([(2, 3, 8, "a"), (4, 0, 9, "b"), (4, 2, 9, "c"), (1, 8, 12, "d")]) == [(4, 0, 9, "b"), (1, 8, 12, "d")]


def written(parsed, rng) -> str:
    """A text that the parsed expression matches, by random choices."""
    out = ""
    for op, arg in parsed:
        kind = str(op)
        if kind == "LITERAL":
            out += chr(arg)
        elif kind == "IN":
            out += chr(rng.choice([c for k, v in arg for c in ([v] if str(k) == "LITERAL" else range(v[0], v[1] + 1))]))
        elif kind == "BRANCH":
            out += written(rng.choice(arg[1]), rng)
        elif kind == "SUBPATTERN":
            out += written(arg[3], rng)
        elif kind in ("MAX_REPEAT", "MIN_REPEAT"):
            out += "".join(written(arg[2], rng) for _ in range(rng.randint(arg[0], min(arg[1], arg[0] + 3))))
        else:
            assert kind in ("ASSERT", "ASSERT_NOT"), kind
    return out


def test_gate_lets_every_way_of_writing_through():
    rng, tried = random.Random(2), 0
    for _, label, ways, pattern in licenses.rules():
        for _ in range(60):
            text = written(re._parser.parse(pattern.pattern), rng)
            if pattern.search(text):
                tried += 1
                assert any(words_ <= set(text.split()) for words_ in ways), (label, text)
    assert tried > 50 * len(licenses.rules())
    for text, label in (("SPDX-License-Identifier: 0BSD", "bsd-0"), ("FreeBSD License", "bsd-2"), ("Apache2", "apache-2"), ("GPL2", "gpl-2"), ("LGPL2.1", "lgpl-2.1"),
                        ("MPL2", "mpl-2"), ("PNG Reference Library License version 2", "libpng"), ("for noncommercial use", "no-commercial-use"),
                        ("You just do what the fsck you want to.", "wtfpl"), ("version 2 of the License, or (at your option) any later version", "gpl-later")):
        assert label in licenses.scan_block(next(words.blocks(pa.array([text]))))[0][5].split(","), text


def test_pipeline_stages(spark):
    import corpus_pipeline
    from tagloom.llm import near, quality
    from tests.llm.test_near_topk import brute_components

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = corpus_pipeline.quality_rules(spark, docs, SF).persist()
    assert good.columns == docs.columns
    judged = {r["doc_id"] for r in queries.op4(spark, SF).where("kept").collect()}
    assert {r["doc_id"] for r in good.collect()} == judged
    firsts = corpus_pipeline.near_dedup(spark, good, SF)
    rows = [(r["doc_id"], r["text"]) for r in good.collect()]
    assert {r["doc_id"] for r in firsts.collect()} == set(brute_components(rows, 5)) and near and quality
    # the whole pipeline, its second stage text by text and its third by all pairs
    machine = toxic.Scorer(toxic.learn(good, spark.read.parquet(f"{SF}/labels.parquet")))
    clean = [(i, t) for i, t in rows if machine.scores([t])[0] < 0.5]
    assert len(clean) < len(rows)
    placed = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in placed} == set(brute_components(clean, 5))


def test_pipeline_of_odd_rows(spark):
    import corpus_pipeline

    rng = random.Random(4)
    plain = [" ".join(f"word{rng.randint(0, 5000)}" for _ in range(60)) for _ in range(3)]
    texts = [(1, plain[0]), (2, plain[0]), (2, plain[0]), (None, plain[0]), (3, plain[1] + " " + plain[2]), (None, plain[2]), (4, None), (5, ""), (6, " \n"), (7, "two words")]
    names = ("row", "key", "m", "fences", "_toxic_score", "node", "digest")
    rows = [(i, t, None if i == 3 else "en", None if i == 2 else "s", 0 if t is None else len(t), *[f"{n}{i}" for n in names]) for i, t in texts]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names))
    for some, kept in ((docs, [(None, plain[2]), (1, plain[0]), (3, plain[1] + " " + plain[2])]), (docs.limit(0), [])):
        now = some
        for name, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, SF)
            assert now.columns == docs.columns, name
        out = now.collect()
        assert sorted(((r["doc_id"], r["text"]) for r in out), key=str) == sorted(kept, key=str)
        assert all(r["key"] == f"key{r['doc_id']}" and r["_toxic_score"] == f"_toxic_score{r['doc_id']}" for r in out)
        placed = corpus_pipeline.best_fit_packing(spark, now, SF).collect()
        assert sorted((r["length"] for r in placed), reverse=True) == sorted((len(t.split()) for _, t in kept), reverse=True)
