"""Terms of texts counted inside Spark's tasks, text by text or over a batch of texts.

A text comes as its tokens joined by spaces and, for character n-grams, as the normalised text.  A hash aggregate over
exploded terms costs several times as much: nearly every character opens a term, and a text repeats its words.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql.types import LongType, StringType, StructField, StructType

#: white space as the normalised text's split has it
WORD = re.compile("[^ \t\n\x0b\f\r]+")
#: words whose n-grams a task remembers
REMEMBERED = 1 << 17
#: rows of one batch that is handed on
ROWS = 1 << 16

BATCH = StructType([StructField("block", StringType()), StructField("term", StringType()), StructField("n", LongType())])


class CharRuns(dict):
    """The character n-grams of a word padded with spaces, as `ngrams.word_char_runs` has them, kept for the next time.

    With ``known`` only those among it.
    """

    def __init__(self, n: int, known: set[str] | None = None) -> None:
        super().__init__()
        self.n, self.known = n, known

    def __missing__(self, word: str) -> list[str]:
        if len(self) >= REMEMBERED:
            self.clear()
        padded = f" {word} "
        found = [padded[i:i + self.n] for i in range(max(len(padded) - self.n, 0) + 1)]
        found = self[word] = found if self.known is None else list(filter(self.known.__contains__, found))
        return found


def by_length(known: set[str] | None) -> dict[int, set] | None:
    """Known word n-grams by their number of words: words as they are, longer ones as tuples of words."""
    if known is None:
        return None
    found: dict[int, set] = {}
    for term in known:
        parts = () if term is None else tuple(term.split(" "))
        found.setdefault(len(parts), set()).add(term if len(parts) == 1 else parts)
    return found


def word_runs(tokens: str, ngrams: tuple[int, int], known: dict[int, set] | None = None) -> Iterator[str]:
    """The word n-grams of a text, each as often as it stands there; with ``known`` (`by_length`) only those in it.

    Runs that are not known are never joined to a string.
    """
    listed, found = tokens.split(" ") if tokens else [], []
    for n in range(ngrams[0], ngrams[1] + 1):
        runs = listed if n == 1 else zip(*(listed[k:] for k in range(n)), strict=False)
        if known is not None:
            runs = filter(known.get(n, set()).__contains__, runs)
        found.append(runs if n == 1 else map(" ".join, runs))
    return chain.from_iterable(found)


def chars_of(text: str, runs: CharRuns) -> Counter:
    return Counter(chain.from_iterable(map(runs.__getitem__, WORD.findall(text))))


def per_row(batches: Iterator[pa.RecordBatch], spec, keys: int, known: dict[str, set[str]] | None = None) -> Iterator[pa.RecordBatch]:
    """``(*keys, block, term, tf)`` from ``(*keys, tokens[, text])`` sorted by keys; a null term for texts without any.

    With ``known`` (the terms of each block) no other terms are counted.
    """
    wanted = known or {"word": None, "char": None}
    grams = by_length(wanted["word"])
    runs, blocks = CharRuns(spec.char_ngram, wanted["char"]), ("word", "char") if spec.use_char else ("word",)
    names, types = None, None
    out: list[list] = []
    held, counts, bare = None, (), ()

    def flush() -> None:
        for block, found, empty in zip(blocks, counts, bare, strict=True):
            n = len(found) + (empty > 0)
            for column, value in zip(out, (*held, block), strict=False):
                column += [value] * n
            out[-2] += found
            out[-1] += found.values()
            if empty:
                out[-2].append(None)
                out[-1].append(empty)

    def handed() -> pa.RecordBatch:
        done = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names)
        for column in out:
            column.clear()
        return done

    for batch in batches:
        if names is None:
            names = [*batch.schema.names[:keys], "block", "term", "tf"]
            types = [*batch.schema.types[:keys], pa.string(), pa.string(), pa.int64()]
            out = [[] for _ in names]
        for at in range(0, batch.num_rows, 256):  # a bounded number of texts at a time
            some = batch.slice(at, 256)
            for *key, tokens, text in zip(*(c.to_pylist() for c in some.columns), *([] if spec.use_char else [[None] * some.num_rows]), strict=True):
                if key != held:
                    if held is not None:
                        flush()
                        if len(out[-1]) >= ROWS:
                            yield handed()
                    held, counts, bare = key, [Counter() for _ in blocks], [0 for _ in blocks]
                found = [Counter(word_runs(tokens, spec.word_ngrams, grams))]
                if spec.use_char:
                    found.append(chars_of(text, runs))
                for i, one in enumerate(found):
                    if not one:
                        bare[i] += 1
                    elif counts[i]:
                        counts[i].update(one)
                    else:
                        counts[i] = one
    if held is not None:
        flush()
        yield handed()


def _handed(grams: Counter, chars: Counter) -> Iterator[pa.RecordBatch]:
    for block, found in (("word", grams), ("char", chars)):
        terms, n = list(found), list(found.values())
        for at in range(0, len(terms), ROWS):
            part = terms[at:at + ROWS]
            yield pa.RecordBatch.from_arrays([pa.array([block] * len(part), pa.string()), pa.array(part, pa.string()),
                                              pa.array(n[at:at + ROWS], pa.int64())], BATCH.names)


def occurrences(batches: Iterator[pa.RecordBatch], spec) -> Iterator[pa.RecordBatch]:
    """``(block, term, n)`` of a batch of ``(tokens[, text])``: how often each term stands in it.

    Character n-grams never leave their word, so a word's are counted once, as often as the batch has the word.
    """
    runs = CharRuns(spec.char_ngram)
    for batch in batches:
        grams, whole, chars = Counter(), Counter(), Counter()
        for at in range(0, batch.num_rows, 256):  # a bounded number of texts at a time
            some = batch.slice(at, 256)
            for tokens in some.column(0).to_pylist():
                grams.update(word_runs(tokens, spec.word_ngrams))
            for text in some.column(1).to_pylist() if spec.use_char else ():
                whole.update(WORD.findall(text))
        for word, n in whole.items():
            for run in runs[word]:
                chars[run] += n
        yield from _handed(grams, chars)


def documents(batches: Iterator[pa.RecordBatch], spec, keys: int, known: dict[str, set[str]] | None = None) -> Iterator[pa.RecordBatch]:
    """``(block, term, n)`` of batches of ``(*keys, tokens[, text])``: how many texts have the term.

    With keys the rows are sorted by them, and those of the same are one text.  With ``known`` no other terms are counted.
    """
    wanted = known or {"word": None, "char": None}
    listed = by_length(wanted["word"])
    runs = CharRuns(spec.char_ngram, wanted["char"])
    held, own = None, (set(), set())
    for batch in batches:
        grams, chars = Counter(), Counter()
        for at in range(0, batch.num_rows, 256):
            some = batch.slice(at, 256)
            for row in zip(*(c.to_pylist() for c in some.columns), strict=True):
                if not keys or row[:keys] != held:
                    grams.update(own[0])
                    chars.update(own[1])
                    held, own = row[:keys], (set(), set())
                own[0].update(word_runs(row[keys], spec.word_ngrams, listed))
                if spec.use_char:
                    own[1].update(chain.from_iterable(map(runs.__getitem__, set(WORD.findall(row[keys + 1])))))
        yield from _handed(grams, chars)
    yield from _handed(Counter(own[0]), Counter(own[1]))
