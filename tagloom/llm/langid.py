"""Language of a text from unigram models of word pieces, summed over all segmentations.

The pieces are those of a fixed public vocabulary; per language each piece has a probability.  A word's
probability is the sum over all ways to cut it into pieces (forward algorithm), a text's the product
over its words, and the posterior over languages with equal priors is the score.  The probabilities
are fitted by expectation maximisation (forward-backward over all segmentations) on word counts of a
bounded sample: about ``docs_per_lang`` texts of each language, chosen by a digest of the id.

Words are runs of letters (a-z in either case, and bytes outside ASCII).  Runs of more than MAX_RUN
bytes are scored in stretches of that size, one after the other; nothing is dropped.  A text that is
null, empty or has no letter is ``und`` with score 0.  Texts without a known piece take the language
with the best single-byte probabilities.  Without any labelled text everything is ``und``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from tagloom.llm import words as W

#: texts per language used for fitting
DOCS_PER_LANG = 1000
#: pieces longer than this (bytes, the mark of a word's start included) are not used
MAX_PIECE = 9
MAX_RUN = 48
ROUNDS = 4
#: probability that smoothing gives any single byte, so that no word has probability 0
BYTE_FLOOR = 1e-5
_START = 1  # stands for the mark of a word's start
_NO_LETTER = np.ones(256, bool)
_NO_LETTER[[*range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1), *range(0x80, 0x100)]] = False
_CODE = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 62, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_NONE = 0


def read_pieces(path: str) -> list[bytes]:
    """Pieces of a vocabulary file, the start mark as one byte; all single bytes come with them."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {bytes([b]) for b in range(256)}
    for i in range(sp.get_piece_size()):
        if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)):
            piece = sp.id_to_piece(i).replace("▁", chr(_START)).encode()
            if 0 < len(piece) <= MAX_PIECE and chr(_START).encode() not in piece[1:]:
                found.add(piece)
    return sorted(found)


class Pieces:
    """Looks up all pieces in many words at once; piece ids start at 1, 0 is none."""

    def __init__(self, pieces: list[bytes]) -> None:
        self.pieces = pieces
        self.longest = max(map(len, pieces))
        keys = np.array([self._key(p) for p in pieces], np.uint64)
        if len(np.unique(keys)) < len(keys):
            raise ValueError("two pieces have one key")
        self.bits = 22
        self.ids = np.zeros(1 << self.bits, np.int32)
        self.keys = np.concatenate((np.zeros(1, np.uint64), keys))
        slots = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        self.more: dict[int, int] = {}  # pieces whose slot was taken: by key
        for i, s in enumerate(slots.tolist(), 1):
            if self.ids[s]:
                self.more[int(keys[i - 1])] = i
            else:
                self.ids[s] = i
        self.more_keys = np.array(sorted(self.more), np.uint64)
        self.more_ids = np.array([self.more[int(k)] for k in self.more_keys], np.int32)

    @staticmethod
    def _key(piece: bytes) -> int:
        key = 0
        for b in piece:
            key = (key * int(_STEP) + int(_CODE[b])) & 0xFFFFFFFFFFFFFFFF
        return int(W.mix(np.array([key], np.uint64))[0])

    def find(self, letters: np.ndarray) -> list[np.ndarray]:
        """For words of one length (rows of bytes): per piece length, ids by word and start."""
        n, width = letters.shape
        codes = _CODE[letters]
        key = np.zeros((n, width), np.uint64)
        out = []
        for length in range(1, min(self.longest, width) + 1):
            key = key[:, :width - length + 1] * _STEP + codes[:, length - 1:]
            mixed = W.mix(key)
            ids = self.ids[(mixed >> np.uint64(64 - self.bits)).astype(np.int64)]
            miss = self.keys[ids] != mixed
            if len(self.more_keys):
                there = np.minimum(np.searchsorted(self.more_keys, mixed[miss]), len(self.more_keys) - 1)
                ids[miss] = np.where(self.more_keys[there] == mixed[miss], self.more_ids[there], _NONE)
            else:
                ids[miss] = _NONE
            out.append(ids)
        return out


def forward(found: list[np.ndarray], prob: np.ndarray) -> np.ndarray:
    """``a[i]``: per word and language the probability of the first i bytes, over all segmentations."""
    n, width = found[0].shape
    a = np.zeros((width + 1, n, prob.shape[1]))
    a[0] = 1
    for i in range(1, width + 1):
        for length in range(1, min(len(found), i) + 1):
            ids = found[length - 1][:, i - length]
            some = np.flatnonzero(ids)
            if len(some) > n // 2:
                a[i] += a[i - length] * prob[ids]
            elif len(some):
                a[i, some] += a[i - length, some] * prob[ids[some]]
    return a


def backward(found: list[np.ndarray], prob: np.ndarray) -> np.ndarray:
    """``b[i]``: the same for the bytes from i on."""
    n, width = found[0].shape
    b = np.zeros((width + 1, n, prob.shape[1]))
    b[width] = 1
    for i in range(width - 1, -1, -1):
        for length in range(1, min(len(found), width - i) + 1):
            b[i] += b[i + length] * prob[found[length - 1][:, i]]
    return b


def _by_length(lengths: np.ndarray, most: int = 40_000):
    """Indexes of words of one length, a bounded number at a time."""
    order = np.argsort(lengths, kind="stable")
    edges = np.flatnonzero(np.diff(lengths[order])) + 1
    for group in np.split(order, edges):
        for at in range(0, len(group), most):
            yield group[at:at + most]


def _letters(data: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    out = np.empty((len(starts), width + 1), np.uint8)
    out[:, 0] = _START
    out[:, 1:] = data[starts[:, None] + np.arange(width)]
    return out


def fit(vocabulary: Pieces, counted: list[tuple[bytes, np.ndarray]], langs: int) -> np.ndarray:
    """Piece probabilities (ids by languages) from words with their counts per language."""
    size = len(vocabulary.keys)
    single = np.array([False] + [len(p) == 1 for p in vocabulary.pieces])
    prob = np.full((size, langs), 1.0 / size)
    prob[single] = np.maximum(prob[single], BYTE_FLOOR)
    prob[_NONE] = 0
    if not counted:
        return prob
    data = np.frombuffer(b"".join(w for w, _ in counted), np.uint8)
    lengths = np.array([len(w) for w, _ in counted])
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    counts = np.array([c for _, c in counted], float)
    groups = []
    for pick in _by_length(lengths, 20_000):
        groups.append((vocabulary.find(_letters(data, starts[pick], int(lengths[pick[0]]))), counts[pick]))
    for _ in range(ROUNDS):
        expected = np.zeros((size, langs))
        for found, weight in groups:
            a, b = forward(found, prob), backward(found, prob)
            scale = weight / a[-1]
            for length, ids in enumerate(found, 1):
                for i in range(ids.shape[1]):
                    some = np.flatnonzero(ids[:, i])
                    if len(some):
                        at = ids[some, i]
                        share = a[i, some] * prob[at] * b[i + length, some] * scale[some]
                        for lang in range(langs):
                            expected[:, lang] += np.bincount(at, share[:, lang], size)
        whole = expected.sum(axis=1, keepdims=True)
        prob = expected + 0.05 * whole / max(1, langs) + 0.01
        prob /= prob.sum(axis=0)
        prob[single] = np.maximum(prob[single], BYTE_FLOOR)
        prob[_NONE] = 0
    return prob


@dataclass
class Model:
    langs: list[str]
    pieces: list[bytes]
    prob: np.ndarray


_ready: dict[int, Pieces] = {}


def _lookup(pieces: list[bytes]) -> Pieces:
    key = hash(tuple(pieces))
    if key not in _ready:
        _ready.clear()
        _ready[key] = Pieces(pieces)
    return _ready[key]


def score_block(block: W.Block, model: Model) -> np.ndarray:
    """Log-probability of each text under each language."""
    vocabulary = _lookup(model.pieces)
    data = np.where((block.data >= 65) & (block.data <= 90), block.data + 32, block.data).astype(np.uint8)
    lowered = W.Block(block.first, data, block.offsets)
    starts, ends, bounds = W.runs(lowered, _NO_LETTER)
    text = np.repeat(np.arange(block.texts), np.diff(bounds))
    long = ends - starts > MAX_RUN
    if long.any():
        parts = np.where(long, -(-(ends - starts) // MAX_RUN), 1)
        which = np.repeat(np.arange(len(starts)), parts)
        step = np.arange(len(which)) - np.repeat(np.cumsum(parts) - parts, parts)
        text, last = text[which], ends[which]
        starts = starts[which] + step * MAX_RUN
        ends = np.minimum(last, starts + MAX_RUN)
    hashes = W.stretch_hashes(lowered, starts, ends, lower=False)
    _, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    lengths = (ends - starts)[first]
    value = np.zeros((len(first), len(model.langs)))
    for pick in _by_length(lengths):
        found = vocabulary.find(_letters(data, starts[first[pick]], int(lengths[pick[0]])))
        value[pick] = np.log(forward(found, model.prob)[-1])
    out = np.zeros((block.texts, len(model.langs)))
    for lang in range(len(model.langs)):
        out[:, lang] = np.bincount(text, value[inverse, lang], block.texts)
    return out


def learn(docs: DataFrame, vocabulary_path: str, docs_per_lang: int = DOCS_PER_LANG) -> Model:
    """Fit on about ``docs_per_lang`` rows of each language of ``docs`` (``doc_id, text, lang``)."""
    rows = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs, pieces = sorted(sizes), read_pieces(vocabulary_path)
    share = F.lit(0.0)
    for lang in langs:
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, docs_per_lang / sizes[lang]))).otherwise(share)
    draw = F.pmod(F.xxhash64(F.lit("langid"), "doc_id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    letters = F.explode(F.split(F.lower("text"), r"[\x00-\x60\x7B-\x7F]+"))
    counted = (rows.where(draw < share).select("lang", letters.alias("word")).where("word != ''")
               .groupBy("word", "lang").agg(F.count("*").alias("n")).toArrow())
    table: dict[bytes, np.ndarray] = {}
    for word, lang, n in zip(counted["word"].to_pylist(), counted["lang"].to_pylist(), counted["n"].to_pylist(), strict=True):
        raw = word.encode()
        for at in range(0, len(raw), MAX_RUN):
            table.setdefault(raw[at:at + MAX_RUN], np.zeros(len(langs)))[langs.index(lang)] += n
    return Model(langs, pieces, fit(Pieces(pieces), sorted(table.items()), len(langs)))


def _result(model: Model, texts: pa.Array) -> pa.Array:
    letter = pc.fill_null(pc.match_substring_regex(texts, r"\pL"), False).to_numpy(zero_copy_only=False)
    n = len(texts)
    if not model.langs or not n:
        return pa.StructArray.from_arrays([pa.array(["und"] * n), pa.array([0.0] * n)], ["lang_pred", "score"])
    logs = np.concatenate([score_block(b, model) for b in W.blocks(texts)])
    best = logs.argmax(axis=1)
    score = 1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
    names = [model.langs[i] if ok else "und" for i, ok in zip(best.tolist(), letter.tolist(), strict=True)]
    return pa.StructArray.from_arrays([pa.array(names), pa.array(np.where(letter, score, 0.0))], ["lang_pred", "score"])


_RESULT = StructType([StructField("lang_pred", StringType()), StructField("score", DoubleType())])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, lang_pred, score`` per row."""
    # the model holds languages x pieces of the fixed vocabulary: a bounded size
    spread = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: pa.Array) -> pa.Array:
        return _result(spread.value, texts)

    return docs.select("doc_id", arrow_udf(run, _RESULT)(F.col("text")).alias("r")).select("doc_id", "r.*")
