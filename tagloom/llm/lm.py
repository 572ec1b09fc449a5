"""Log-bilinear language model: counts over all training text, noise-contrastive training, normalised scores.

Vocabulary.  Training words are counted by a 64-bit hash (two words in 10^7 share one with chance
3e-6).  The SHORT most frequent words and the text end are predicted one by one, all others as one of
SHAPES classes (last character, non-ASCII letters) times the word's add-one share of its class.
Predictions are proper: known words and one unseen word per class sum to 1 in every context.

Model.  ``score(w | u, v) = (c1 * r_u + c2 * r_v) . q_w + b_w`` for the two words before w.  All training
text is reduced to counts of (u, v, w); their number is bounded by the classes, and grows with the
text up to that.  Every shard of that table takes steps of noise-contrastive estimation in numpy and
the parameters are averaged, ROUNDS times.  Training needs no normalisation; scoring does it by batched
matrix products over the distinct contexts of a block.

Counts.  The HEAD most frequent words travel to every task (a fixed size); rarer ones are joined by
hash, so the vocabulary itself is never sent anywhere whole.

A null text is empty: only the text end is scored.  Repeated rows are scored one by one.  Without any
training text all words are unseen and the model is uniform over its classes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import (ArrayType, BinaryType, ByteType, DoubleType, LongType, StructField, StructType)

from tagloom.llm import words as W
from tagloom.llm.staging import staged

SHORT = 448
HEAD = 1 << 17
SHAPES = 8
WIDTH = 32
SHARDS = 8
ROUNDS = 4
BATCH = 2048
NOISE = 128
#: steps that the tokens of one shard are dealt to in one round, four visits at most; every triple adds one more place
MAX_STEPS = 500
RATE = 0.08


def shapes(block: W.Block, found: W.Words) -> np.ndarray:
    """Class of a word when it is not predicted by itself: its last byte, and whether it has non-ASCII bytes."""
    sums = np.concatenate(([0], np.cumsum(block.data >= 0x80)))
    foreign = sums[found.ends] > sums[found.starts]
    last = block.data[found.ends - 1] if len(found.ends) else np.zeros(0, np.uint8)
    kind = np.full(len(last), 3)
    kind[(last >= 0x80) | ((last >= 97) & (last <= 122)) | ((last >= 65) & (last <= 90))] = 0
    kind[last == ord(".")] = 1
    kind[last == ord(",")] = 2
    return kind * 2 + foreign


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in W.blocks(batch.column(0)):
            found = W.words(block, lower=True)
            value, first, n = np.unique(found.hashes, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(value.view(np.int64)), pa.array(shapes(block, found)[first], pa.int8()), pa.array(n, pa.int64())],
                ["h", "shape", "n"])


_COUNTS = StructType([StructField("h", LongType()), StructField("shape", ByteType()), StructField("n", LongType())])


@dataclass
class Vocabulary:
    """What every task needs of the counts: sizes, and the most frequent words."""

    total: int
    distinct: int
    texts: int
    head: np.ndarray  # hashes, the most frequent first
    head_counts: np.ndarray
    class_tokens: np.ndarray  # of the words without an own prediction, per shape
    class_words: np.ndarray
    order: np.ndarray = field(init=False)
    sorted_head: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.order = np.argsort(self.head)
        self.sorted_head = self.head[self.order]

    @property
    def short(self) -> int:
        return min(SHORT, len(self.head))

    @property
    def end(self) -> int:
        return self.short

    @property
    def outputs(self) -> int:
        return self.short + 1 + SHAPES

    @property
    def begin(self) -> int:
        return self.outputs

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """Rank of each word in the head, or -1."""
        if not len(self.head):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.sorted_head, hashes), len(self.head) - 1)
        return np.where(self.sorted_head[at] == hashes, self.order[at], -1)

    def ids(self, block: W.Block, found: W.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Class ids of all tokens, text ends included; bounds per text; distinct words' ranks by token."""
        value, inverse = np.unique(found.hashes, return_inverse=True)
        place = self.places(value)[inverse]
        word_ids = np.where((place >= 0) & (place < self.short), place, self.short + 1 + shapes(block, found))
        n = np.diff(found.bounds)
        bounds = np.concatenate(([0], np.cumsum(n + 1)))
        out = np.full(bounds[-1], self.end)
        at_word = np.ones(len(out), bool)
        at_word[bounds[1:] - 1] = False
        out[at_word] = word_ids
        return out, bounds, place

    def contexts(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids one and two places before each token, within its text."""
        one, two = np.full(len(ids), self.begin), np.full(len(ids), self.begin)
        one[1:], two[2:] = ids[:-1], ids[:-2]
        one[bounds[:-1]] = self.begin
        two[bounds[:-1]] = self.begin
        second = bounds[:-1] + 1
        two[second[second < bounds[1:]]] = self.begin
        return two, one

    def class_share(self) -> np.ndarray:
        """Add-one sizes of the classes: what the share of a word in its class is divided by."""
        return self.class_tokens + self.class_words + 1.0

    def start_counts(self, short_counts: np.ndarray) -> np.ndarray:
        """Tokens of each output, those of a class with room for its unseen words."""
        return np.concatenate((short_counts + 1.0, [self.texts + 1.0], self.class_share()))


def word_counts(train: DataFrame) -> DataFrame:
    """``h, shape, n`` for every distinct word of ``train`` (``text``)."""
    each = train.select("text").mapInArrow(count_words, _COUNTS)
    return each.groupBy("h").agg(F.min("shape").cast("byte").alias("shape"), F.sum("n").alias("n"))


def vocabulary(counts: DataFrame, texts: int) -> Vocabulary:
    """Sizes and the head of stored counts.  Ties in the head go to the smaller hash."""
    per_shape = counts.groupBy("shape").agg(F.sum("n").alias("tokens"), F.count("*").alias("words")).collect()
    top = counts.orderBy(F.desc("n"), "h").limit(HEAD).toArrow()
    tokens, distinct = np.zeros(SHAPES), np.zeros(SHAPES)
    for r in per_shape:
        tokens[r["shape"]], distinct[r["shape"]] = r["tokens"], r["words"]
    head = top["h"].to_numpy().astype(np.int64).view(np.uint64)
    n, shape = top["n"].to_numpy().astype(np.int64), top["shape"].to_numpy().astype(np.int64)
    total, words_ = int(tokens.sum()), int(distinct.sum())
    for s, c in zip(shape[:SHORT], n[:SHORT], strict=True):
        tokens[s] -= c
        distinct[s] -= 1
    return Vocabulary(total + texts, words_ + (texts > 0), texts, head, n, tokens, distinct)


def count_triples(train: DataFrame, voc: Vocabulary) -> DataFrame:
    """``key, n``: how often each (two before, one before, token) occurs, packed into one number."""
    spread = train.sparkSession.sparkContext.broadcast(voc)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, base = spread.value, spread.value.outputs + 1
        for batch in batches:
            for block in W.blocks(batch.column(0)):
                ids, bounds, _ = v.ids(block, W.words(block, lower=True))
                two, one = v.contexts(ids, bounds)
                key, n = np.unique((two * base + one) * base + ids, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(n, pa.int64())], ["key", "n"])

    schema = StructType([StructField("key", LongType()), StructField("n", LongType())])
    return train.select("text").mapInArrow(run, schema).groupBy("key").agg(F.sum("n").alias("n"))


class Model:
    """Parameters of the log-bilinear model."""

    def __init__(self, voc: Vocabulary, seed: int = 1) -> None:
        rng = np.random.Generator(np.random.PCG64(seed))
        start = voc.start_counts(voc.head_counts[:voc.short].astype(float))
        self.noise = (start / start.sum()).astype(np.float32)
        self.b = np.log(self.noise).astype(np.float32)
        self.c = np.ones((2, WIDTH), np.float32)
        self.r = (0.1 * rng.standard_normal((voc.outputs + 1, WIDTH))).astype(np.float32)
        self.q = (0.01 * rng.standard_normal((voc.outputs, WIDTH))).astype(np.float32)

    def arrays(self) -> list[np.ndarray]:
        return [self.b, self.c, self.r, self.q]

    def pack(self) -> bytes:
        return b"".join(a.tobytes() for a in self.arrays())

    def unpack(self, values: np.ndarray) -> None:
        at = 0
        for a in self.arrays():
            a[...] = values[at:at + a.size].reshape(a.shape)
            at += a.size

    def hidden(self, two: np.ndarray, one: np.ndarray) -> np.ndarray:
        return self.c[0] * self.r[two] + self.c[1] * self.r[one]

    def log_probs(self, two: np.ndarray, one: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Normalised log-probabilities, by matrix products over the distinct contexts."""
        out = np.zeros(len(token))
        base = len(self.r)
        context, inverse = np.unique(two * base + one, return_inverse=True)
        order = np.argsort(inverse, kind="stable")
        edge = np.searchsorted(inverse[order], np.arange(0, len(context) + 4096, 4096))
        for k, at in enumerate(range(0, len(context), 4096)):
            some = context[at:at + 4096]
            logits = self.hidden(some // base, some % base) @ self.q.T + self.b
            high = logits.max(axis=1, keepdims=True)
            norm = high[:, 0] + np.log(np.exp(logits - high).sum(axis=1))
            pick = order[edge[k]:edge[k + 1]]
            row = inverse[pick] - at
            out[pick] = logits[row, token[pick]] - norm[row]
        return out


def _add_rows(out: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    order = np.argsort(rows, kind="stable")
    at = np.flatnonzero(np.concatenate(([True], np.diff(rows[order]) > 0)))
    out[rows[order][at]] += np.add.reduceat(values[order], at)


def train_shard(model: Model, keys: np.ndarray, n: np.ndarray, stretch: np.ndarray, rate: float, seed: int) -> None:
    """Steps of noise-contrastive estimation on one shard's triples, every one with its whole count.

    Each triple takes places in proportion to its count, one at least, and its count is spread evenly over them.
    """
    base = len(model.r)
    token, one, two = keys % base, keys // base % base, keys // (base * base)
    weight = n * stretch[token]
    rng = np.random.Generator(np.random.PCG64(seed))
    places = int(min(MAX_STEPS, 4 * weight.sum() // BATCH + 1)) * BATCH
    copies = np.ceil(weight * (places / weight.sum())).astype(np.int64)
    dealt = np.repeat(np.arange(len(keys), dtype=np.int32), copies)
    rng.shuffle(dealt)
    share = (weight / copies * (len(dealt) / weight.sum())).astype(np.float32)
    noise_upto = np.cumsum(model.noise.astype(float))
    log_noise = np.log(NOISE * model.noise)
    squares = [np.full(a.shape, 1e-8, np.float32) for a in model.arrays()]
    for at in range(0, len(dealt), BATCH):
        pick = dealt[at:at + BATCH]
        w, u, v = token[pick], two[pick], one[pick]
        fake = np.minimum(np.searchsorted(noise_upto, rng.random(NOISE) * noise_upto[-1], "right"), base - 2)
        h = model.hidden(u, v)
        real_gap = np.einsum("ij,ij->i", h, model.q[w]) + model.b[w] - log_noise[w]
        fake_gap = h @ model.q[fake].T + model.b[fake] - log_noise[fake]
        up = (1 / (1 + np.exp(np.clip(real_gap, -30, 30)))).astype(np.float32) * share[pick]
        down = (1 / (1 + np.exp(np.clip(-fake_gap, -30, 30)))).astype(np.float32) * share[pick, None]
        gh = up[:, None] * model.q[w] - down @ model.q[fake]
        gb, gc, gr, gq = (np.zeros_like(a) for a in model.arrays())
        _add_rows(gq, w, up[:, None] * h)
        _add_rows(gq, np.sort(fake), (down.T @ h)[np.argsort(fake, kind="stable")])
        gb += np.bincount(w, up, len(gb)).astype(np.float32) - np.bincount(fake, down.sum(axis=0), len(gb)).astype(np.float32)
        gc[0], gc[1] = (gh * model.r[u]).sum(axis=0), (gh * model.r[v]).sum(axis=0)
        _add_rows(gr, u, gh * model.c[0])
        _add_rows(gr, v, gh * model.c[1])
        for a, g, s in zip(model.arrays(), (gb, gc, gr, gq), squares, strict=True):
            g /= len(pick)
            s += g * g
            a += rate * g / np.sqrt(s)


def fit(triples: DataFrame, voc: Vocabulary) -> Model:
    """Average of the shards' parameters after each round; a shard counts by its tokens."""
    model, context = Model(voc), triples.sparkSession.sparkContext
    short = voc.head_counts[:voc.short].astype(float)
    seen = np.concatenate((short, [max(voc.texts, 1)], np.maximum(voc.class_tokens, 1)))
    stretch = np.maximum(1.0, voc.start_counts(short) / np.maximum(seen, 1))
    shards = triples.repartition(SHARDS, "key")
    schema = StructType([StructField("weight", DoubleType()), StructField("params", BinaryType())])
    for turn in range(ROUNDS):
        spread = context.broadcast((model, stretch, RATE / (1 + turn)))

        def run(batches: Iterator[pa.RecordBatch], spread=spread, turn=turn) -> Iterator[pa.RecordBatch]:
            shared, scale, rate = spread.value
            parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
            if not parts:
                return
            keys, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            order = np.argsort(keys)
            own = Model.__new__(Model)
            own.noise, own.b, own.c, own.r, own.q = shared.noise, *(a.copy() for a in shared.arrays())
            train_shard(own, keys[order], n[order].astype(float), scale, rate, seed=turn * 1009 + int(keys.min()) % 1009)
            yield pa.RecordBatch.from_arrays([pa.array([float(n.sum())]), pa.array([own.pack()], pa.binary())],
                                             ["weight", "params"])

        rows = shards.mapInArrow(run, schema).collect()  # SHARDS rows of one parameter set each
        if not rows:
            return model
        rows.sort(key=lambda r: (r["weight"], r["params"][:64]))
        mean = sum(r["weight"] * np.frombuffer(r["params"], np.float32).astype(float) for r in rows)
        model.unpack((mean / sum(r["weight"] for r in rows)).astype(np.float32))
    return model


_PARTS = StructType([
    StructField("n_tokens", LongType()), StructField("n_known", LongType()), StructField("count_logs", DoubleType()),
    StructField("class_logs", DoubleType()), StructField("lm_logs", DoubleType()),
    StructField("rare", ArrayType(StructType([StructField("h", LongType()), StructField("n", LongType())])))])


def _score_block(block: W.Block, voc: Vocabulary, model: Model) -> list[np.ndarray]:
    found = W.words(block, lower=True)
    ids, bounds, place = voc.ids(block, found)
    text = np.repeat(np.arange(block.texts), np.diff(bounds))
    two, one = voc.contexts(ids, bounds)
    lm = model.log_probs(two, one, ids) / np.log(10)
    shared = ids > voc.end
    lm[shared] -= np.log10(voc.class_share())[ids[shared] - voc.end - 1]
    word_text, known = found.text_of(), place >= 0
    logs = np.log10(voc.head_counts[place[known]] + 1.0) if known.any() else np.zeros(0)
    in_class = place[known] >= voc.short
    ends = np.log10(voc.texts + 1.0)
    rare_text, rare_hash = word_text[~known], found.hashes[~known]
    order = np.lexsort((rare_hash, rare_text))
    rare_text, rare_hash = rare_text[order], rare_hash[order]
    fresh = np.ones(len(order), bool)
    fresh[1:] = (rare_text[1:] != rare_text[:-1]) | (rare_hash[1:] != rare_hash[:-1])
    at = np.flatnonzero(fresh)
    return [np.diff(bounds), np.bincount(word_text[known], minlength=block.texts) + (voc.texts > 0),
            np.bincount(word_text[known], logs, block.texts) + ends,
            np.bincount(word_text[known][in_class], logs[in_class], block.texts), np.bincount(text, lm, block.texts),
            np.concatenate(([0], np.cumsum(np.bincount(rare_text[at], minlength=block.texts)))), rare_hash[at],
            np.diff(np.append(at, len(order)))]


def score(docs: DataFrame, counts: DataFrame, voc: Vocabulary, model: Model) -> DataFrame:
    """Per row of ``docs``: its other columns but ``text``, ``n_tokens, n_known, base_score, score``."""
    spread = docs.sparkSession.sparkContext.broadcast((voc, model))

    def run(texts: pa.Array) -> pa.Array:
        parts = [_score_block(b, *spread.value) for b in W.blocks(texts)]
        if not parts:
            return pa.array([], pa.struct([(f.name, pa.int64()) for f in _PARTS])).cast(_arrow_parts())
        join = [np.concatenate([p[k] for p in parts]) for k in (0, 1, 2, 3, 4, 6, 7)]
        sizes = np.concatenate([np.diff(p[5]) for p in parts])
        offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32())
        pairs = pa.StructArray.from_arrays([pa.array(join[5].view(np.int64)), pa.array(join[6], pa.int64())], ["h", "n"])
        return pa.StructArray.from_arrays(
            [pa.array(join[0], pa.int64()), pa.array(join[1], pa.int64()), *(pa.array(join[k], pa.float64()) for k in (2, 3, 4)),
             pa.ListArray.from_arrays(offsets, pairs)], _PARTS.names)

    kept = [c for c in docs.columns if c != "text"]
    parts = docs.select(*kept, arrow_udf(run, _PARTS)(F.col("text")).alias("p"))
    rows = staged(parts.withColumn("row", F.monotonically_increasing_id()))
    rare = (rows.select("row", F.explode("p.rare").alias("w")).select("row", F.col("w.h").alias("h"), F.col("w.n").alias("times"))
            .join(counts.select("h", "n"), "h")
            .groupBy("row").agg(F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("rare_logs"),
                                F.sum("times").alias("rare_known")))
    none = F.lit(0.0)
    p, logs = F.col("p"), F.coalesce("rare_logs", none)
    size = float(np.log10(voc.total + 1.0 * (voc.distinct + 1)))
    return rows.join(rare, "row", "left").select(
        *kept, p["n_tokens"].alias("n_tokens"), (p["n_known"] + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        (p["count_logs"] + logs - size * p["n_tokens"]).alias("base_score"),
        (p["lm_logs"] + p["class_logs"] + logs).alias("score"))


def _arrow_parts() -> pa.DataType:
    pair = pa.struct([("h", pa.int64()), ("n", pa.int64())])
    return pa.struct([("n_tokens", pa.int64()), ("n_known", pa.int64()), ("count_logs", pa.float64()),
                      ("class_logs", pa.float64()), ("lm_logs", pa.float64()), ("rare", pa.list_(pair))])


def learn(train: DataFrame) -> tuple[DataFrame, Vocabulary, Model]:
    """Stored counts, vocabulary and model of all texts of ``train`` (``text``)."""
    texts = train.count()
    counts = staged(word_counts(train))
    voc = vocabulary(counts, texts)
    return counts, voc, fit(staged(count_triples(train, voc)), voc)
