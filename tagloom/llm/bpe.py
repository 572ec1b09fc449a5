"""Byte-pair encoding and decoding of whole texts by a walk through the trie of their distinct words.

The encoding of a word is determined by one value per prefix: the last token of the prefix's own
encoding.  A token t that ends a prefix is that last token exactly when it may follow the last token
of what stands before it (`Codec.may_follow`).  Distinct words are visited in the depth-first order of
their trie (which is their sorted order) with the states of the current path on a stack, so a prefix
that many words share is worked out once.  A bounded table keeps the words met lately.

Rules of the vocabulary file are read from it: merges, word-end mark, special tokens.  A null text is
an empty one and has no tokens; repeated rows are encoded alike; other columns are not touched.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

#: words kept in each of the two generations of a worker's table
KEPT_WORDS = 250_000
#: characters of text worked on at once
CHUNK_CHARS = 2_000_000
#: pre-tokens of the vocabulary file (fixed by its format)
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"


def byte_letters() -> list[str]:
    """The visible letter that stands for each byte in byte-level vocabularies."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in visible else chr(next(hidden)) for b in range(256)]


def _lengths(tokens: dict[str, int]) -> dict[str, list[int]]:
    """By the last two letters: how long tokens with that ending are, the longest first, and 1."""
    out: dict[str, set[int]] = {}
    for t in tokens:
        if len(t) > 1:
            out.setdefault(t[-2:], {1}).add(len(t))
    return {ending: sorted(found, reverse=True) for ending, found in out.items()}


class Codec:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"] if t["content"] not in ids}
        self.names = {i: t for t, i in ids.items()} | {i: t for t, i in self.special.items()}
        self.names_list = [self.names.get(i, "") for i in range(max(self.names) + 1)]
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for r, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            a, b, whole = ids[left], ids[right], ids[left + right]
            self.rank[a, b] = r
            self.parts.setdefault(whole, (a, b, r))
        end = self.end
        self.inner = {t: i for t, i in ids.items() if not (end and t.endswith(end))}
        self.final = {t[:len(t) - len(end)]: i for t, i in ids.items() if end and t.endswith(end)} if end else self.inner
        self.inner_lengths, self.final_lengths = _lengths(self.inner), _lengths(self.final)
        self.letters = {b: c for b, c in enumerate(byte_letters())}
        self.pretoken = regex.compile(PRETOKEN)
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.follows: dict[tuple[int, int], bool] = {}
        self.right_edges: dict[int, list[tuple[int, float]]] = {}
        self.left_edges: dict[int, list[tuple[int, float]]] = {}
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """Pieces that stand at one side of a token while it is built, with the rank that ends each."""
        out, until = [(token, float("inf"))], None
        while token in self.parts:
            *pair, until = self.parts[token]
            token = pair[side]
            out.append((token, until))
        return out

    def may_follow(self, left: int, right: int) -> bool:
        """Whether no merge joins pieces across the border while both tokens are built.

        Merges are applied by rank, the leftmost first: a merge across the border comes in time if its
        rank is below the one that ends the left piece and not above the one that ends the right piece.
        """
        known = self.follows.get((left, right))
        if known is None:
            a = self.right_edges.get(left) or self.right_edges.setdefault(left, self._edge(left, 1))
            b = self.left_edges.get(right) or self.left_edges.setdefault(right, self._edge(right, 0))
            rank = self.rank.get
            known = not any(
                (r := rank((x, y))) is not None and r < ends_x and r <= ends_y for x, ends_x in a for y, ends_y in b)
            if len(self.follows) >= 1_000_000:
                self.follows.clear()
            self.follows[left, right] = known
        return known

    def _last(self, word: str, upto: int, states: list[tuple[int, int]], table: dict[str, int],
              lengths: dict[str, list[int]]) -> tuple[int, int]:
        """Last token of ``word[:upto]`` and where it starts, given the states of shorter prefixes."""
        follows = self.follows
        for length in lengths.get(word[upto - 2:upto], (1,)) if upto > 1 else (1,):
            start = upto - length
            if start < 0:
                continue
            token = table.get(word[start:upto])
            if token is not None:
                if not start:
                    return token, 0
                left = states[start][0]
                known = follows.get((left, token))
                if known or known is None and self.may_follow(left, token):
                    return token, start
        raise ValueError(f"no encoding for {word[:upto]!r}")

    def walk(self, words: list[str]) -> list[list[int]]:
        """Token ids of words (in byte letters, sorted), sharing the work on common prefixes."""
        out, before = [], ""
        states: list[tuple[int, int]] = [(-1, 0)]  # of the prefix of each length
        for word in words:
            common, limit = 0, min(len(before), len(word) - 1, len(states) - 1)
            while common < limit and word[common] == before[common]:
                common += 1
            del states[common + 1:]
            for upto in range(len(states), len(word)):
                states.append(self._last(word, upto, states, self.inner, self.inner_lengths))
            token, start = self._last(word, len(word), states, self.final, self.final_lengths)
            ids = [token]
            while start:
                token, start = states[start]
                ids.append(token)
            out.append(ids[::-1])
            before = word
        return out

    def learn(self, words: set[str]) -> None:
        """Put the encodings of these words into the table."""
        table = self.letters
        fresh = {}
        for w in words:
            if w in self.young:
                continue
            known = self.old.get(w)
            if known is not None:
                self.young[w] = known
            else:
                fresh[w.encode().decode("latin-1").translate(table)] = w
        spelt = sorted(fresh)
        for s, ids in zip(spelt, self.walk(spelt), strict=True):
            self.young[fresh[s]] = np.array(ids, "<u4").tobytes()

    def trim(self) -> None:
        if len(self.young) > KEPT_WORDS:
            self.old, self.young = self.young, {}

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens of a text without special tokens."""
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        return self.pretoken.findall(text.replace("Σ", "σ").lower())

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        parts: list[list] = []
        for text in texts:
            if self.split_special and "<|" in text:
                parts.append([self.special[p] if p in self.special else self.pieces(p) for p in self.split_special.split(text)])
            else:
                parts.append([self.pieces(text)])
        self.learn({w for one in parts for p in one if isinstance(p, list) for w in p})
        get = self.young.__getitem__
        out = [b"".join(int(p).to_bytes(4, "little") if isinstance(p, int) else b"".join(map(get, p)) for p in one)
               for one in parts]
        self.trim()
        return out

    def decode(self, ids: bytes) -> str:
        """The tokens' names with spaces between, as the file names no decoder of its own."""
        return " ".join(map(self.names_list.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One per worker process and file."""
    return Codec(path)


def _chunks(column: pa.Array):
    held, size = [], 0
    for text in column:
        text = text.as_py() or ""
        held.append(text)
        size += len(text)
        if size >= CHUNK_CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


def encoded(text: Column, path: str) -> Column:
    """Ids of a text, packed as little-endian unsigned 32-bit integers."""
    def run(column: pa.Array) -> pa.Array:
        return pa.array([ids for texts in _chunks(column) for ids in codec(path).encode_all(texts)], pa.binary())
    return arrow_udf(run, BinaryType())(text)


def decoded(ids: Column, path: str) -> Column:
    """The text of packed ids."""
    def run(column: pa.Array) -> pa.Array:
        return pa.array([None if x is None else codec(path).decode(x) for x in column.to_pylist()], pa.string())
    return arrow_udf(run, StringType())(ids)


_DIGEST = StructType([StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()),
                      StructField("decoded_sha256", StringType())])


def digests(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: the round trip of each text in one visit."""
    def run(column: pa.Array) -> pa.Array:
        of, rows = codec(path), []
        for texts in _chunks(column):
            for ids in of.encode_all(texts):
                rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(of.decode(ids).encode()).hexdigest()))
        cols = list(zip(*rows, strict=True)) or [(), (), ()]
        return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.string()), strict=True)],
                                          _DIGEST.names)
    out = docs.select("doc_id", arrow_udf(run, _DIGEST)(F.col("text")).alias("d"))
    return out.select("doc_id", "d.*")
