from __future__ import annotations

import itertools
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from tagloom.llm import bpe, langid, lm, packing, queries, toxic, words

SF = "/root/testdata/sf0.001"
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").toPandas()


def odd_texts(n: int) -> list[str]:
    rng = random.Random(1)
    odd = ["<|endoftext|>", "<|startoftext|>", "'LL", "'s ", "aaaa", " ", "\x85", " ", "İ", "Σ", "ẞ", "é", "ﬁ", "😀", "\x1c", "​", "12", "_"]
    return ["".join(rng.choice([chr(rng.randint(32, 591)), rng.choice(odd)]) for _ in range(rng.randint(0, 30))) for _ in range(n)]


def test_codec_equals_the_library(documents):
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(WORD_BPE), bpe.Codec(WORD_BPE)
    texts = documents["text"].tolist() + odd_texts(3000) + ["", "a" * 5000, "ab" * 3000]
    got = own.encode_all(texts)
    for text, ids, want in zip(texts, got, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == want.ids, text
        assert own.decode(ids) == library.decode(want.ids, skip_special_tokens=False)


def test_codec_table_generations(documents, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_WORDS", 50)
    small, large = bpe.Codec(WORD_BPE), bpe.Codec(WORD_BPE)
    texts = documents["text"].tolist()[:40]
    assert [small.encode_all([t])[0] for t in texts] == large.encode_all(texts)


def test_forward_sums_all_segmentations():
    pieces = sorted({bytes([b]) for b in range(256)} | {b"ab", b"bc", b"abc", b"\x01a", b"ca"})
    table = langid.Pieces(pieces)
    rng = np.random.default_rng(3)
    prob = np.concatenate((np.zeros((1, 2)), rng.random((len(pieces), 2))))
    for word in (b"abcab", b"a", b"cabc"):
        full = b"\x01" + word
        got = langid.forward(table.find(np.frombuffer(full, np.uint8)[None, :]), prob)[-1][0]
        want = np.zeros(2)
        for cuts in itertools.product([0, 1], repeat=len(full) - 1):
            at = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(full)]
            parts = [full[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
            if all(p in pieces for p in parts):
                want += np.prod([prob[pieces.index(p) + 1] for p in parts], axis=0)
        assert np.allclose(got, want)


def test_language_of_held_out_texts(spark):
    rows = queries.op9(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.95 * len(rows)


def test_language_edges(spark):
    docs = spark.createDataFrame([(1, "the cat " * 20, "en", 0.0), (2, "der hund " * 20, "de", 0.0), (3, None, "en", 0.0), (4, "12 !!", None, 0.0), (5, "", "de", 0.0),
                                  (6, "thecat" * 4000, None, 0.0), (None, "the the cat", None, 0.0)], "doc_id long, text string, lang string, score double")
    model = langid.learn(docs, public_tokenizers.path("piece_bpe_32k.model"))
    got = {r["doc_id"]: r["lang_pred"] for r in langid.predict(docs, model).collect()}
    assert got == {1: "en", 2: "de", 3: "und", 4: "und", 5: "und", 6: "en", None: "en"}
    none = langid.learn(docs.limit(0), public_tokenizers.path("piece_bpe_32k.model"))
    assert {r["lang_pred"] for r in langid.predict(docs, none).collect()} == {"und"}


def test_unigram_scores_equal_brute_force(spark, documents):
    got = {r["doc_id"]: r for r in queries.op6(spark, SF).collect()}
    counts: dict[str, int] = {}
    tokens = {d: [*words_of(t), None] for d, t in zip(documents["doc_id"], documents["text"], strict=True)}
    train = [d for d in tokens if zlib.crc32(str(d).encode()) % 7 != 2]
    for d in train:
        for w in tokens[d]:
            counts[w] = counts.get(w, 0) + 1
    total = sum(counts.values())
    gain = 0.0
    for d, ws in tokens.items():
        r = got[d]
        base = sum(math.log10((counts.get(w, 0) + 1) / (total + len(counts) + 1)) for w in ws)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ws), sum(w in counts for w in ws), total)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and r["held_out"] == (d not in set(train))
        gain += (r["score"] - base) * r["held_out"]
    assert gain > 0


def words_of(text: str) -> list[str]:
    import re
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def test_model_is_normalised(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["a b c. a b", "b a, c", "ä b a a a", None])], "doc_id long, text string")
    counts, voc, model = lm.learn(docs)
    inside = np.arange(voc.outputs)
    for u, v in ((0, 1), (voc.begin, voc.begin), (voc.end, 2)):
        p = np.exp(model.log_probs(np.full(voc.outputs, u), np.full(voc.outputs, v), inside))
        assert abs(p.sum() - 1) < 1e-5
    rows = {r["doc_id"]: r for r in lm.score(docs, counts, voc, model).collect()}
    assert rows[3]["n_tokens"] == 1 and all(math.isfinite(r["score"]) for r in rows.values())
    counts, voc, model = lm.learn(docs.limit(0))
    rows = lm.score(docs, counts, voc, model).collect()
    assert all(r["n_known"] == 0 and math.isfinite(r["score"]) and math.isfinite(r["base_score"]) for r in rows)


def test_contexts_stay_inside_a_text():
    voc = lm.Vocabulary(3, 3, 1, np.array([words.hash_text("a")], np.uint64), np.array([2]), np.ones(8), np.ones(8))
    block = next(words.blocks(pa.array(["a a", "", "a"])))
    ids, bounds, _ = voc.ids(block, words.words(block, True))
    two, one = voc.contexts(ids, bounds)
    b, e = voc.begin, voc.end
    assert ids.tolist() == [0, 0, e, e, 0, e] and one.tolist() == [b, 0, 0, b, b, 0] and two.tolist() == [b, b, 0, b, b, b]


def test_toxic_words_survive_gaps():
    rng = random.Random(4)
    plain = "house garden river stone cloud apple window letter table music silver winter".split()
    insult = "idiot moron pathetic scum".split()
    clean = [" ".join(rng.choices(plain, k=30)) for _ in range(80)]
    bad = [" ".join(rng.choices(plain, k=15) + [rng.choice(insult)] + rng.choices(plain, k=15)) for _ in range(60)]
    scorer = toxic.Scorer(toxic.fit(bad, clean))
    high = scorer.scores(["you i.d.i.o.t", "such a mor-on", "p a t h e t i c house", "scumm"])
    low = scorer.scores([*clean[:20], "", "   ", "!!!", "river " * 5000])
    assert high.min() > 0.5 > low.max()
    assert toxic.fit([], clean) is None and toxic.fit([""], clean) is None


def test_table_equals_landmark_expansion():
    units = ["idiot", "i.d.i.o.t", "clown", "stone", "river", "x" * 100]
    stretches = [toxic._stretches(toxic._codes(u))[0] for u in units]
    f = toxic.Features(stretches)
    kernel = f.against(f)
    assert np.allclose(np.diag(kernel), 1, atol=1e-5) and np.allclose(kernel, kernel.T, atol=1e-5)
    assert kernel[0, 1] > 0.3 > 0.1 > kernel[0, 3]


def test_toxicity_of_held_out_documents(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = queries.op5(spark, "/root/testdata/sf0.01").join(labels, "doc_id").where("held_out").collect()
    assert sum((r["predicted"] == r["toxic"]) for r in rows) >= 0.95 * len(rows)


def test_packing_places_everything_once(spark):
    rng = random.Random(8)
    lengths = [rng.choice([0, 1, 3, 50, 300, 511, 512, 513, 900, 5000, 9000]) for _ in range(300)]
    docs = spark.createDataFrame([(i, "w " * n if n else rng.choice([None, "", " "]), 1) for i, n in enumerate(lengths)],
                                 "doc_id long, text string, shard int")
    rows = packing.packed(docs).collect()
    by_doc, bins = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        if r["length"]:
            bins.setdefault(r["bin_id"], []).append(r)
    for i, n in enumerate(lengths):
        assert sum(r["length"] for r in by_doc[i]) == n and len(by_doc[i]) == max(1, -(-n // 4096))
    for members in bins.values():
        members.sort(key=lambda r: r["offset"])
        used = sum(r["length"] for r in members)
        assert [r["offset"] for r in members] == [sum(x["length"] for x in members[:k]) for k in range(len(members))]
        assert {r["capacity"] for r in members} == {min(s for s in packing.SIZES if s >= used)}
    assert packing.packed(docs.limit(0)).count() == 0


def test_best_fit_choice_equals_brute_force():
    rng = random.Random(3)
    open_, plain, used = packing.OpenBins(64), {}, 0
    for _ in range(2000):
        if rng.random() < 0.5:
            room = rng.randint(1, 64)
            open_.put(room, used)
            plain[used] = room
            used += 1
        else:
            need = rng.randint(1, 64)
            got, fits = open_.take(need), [r for r in plain.values() if r >= need]
            assert (got is None) == (not fits)
            if got:
                assert got[0] == min(fits) == plain.pop(got[1])


def test_packing_is_dense():
    lengths = np.random.default_rng(1).integers(1, 700, 5000)
    _, _, capacity = packing.pack(lengths)
    bin_, _, _ = packing.pack(lengths)
    total = sum({b: c for b, c in zip(bin_.tolist(), capacity.tolist(), strict=True)}.values())
    assert lengths.sum() / total > 0.98
