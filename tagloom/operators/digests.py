"""Terms of many texts at once, as 64-bit digests in numpy.

A batch's words are numbered once, so what is done per word is done for different words only; runs of words and
character n-grams are combined from numbers, and a string is only made of a term that is asked for.  Terms are told
apart by their digests, as sets are elsewhere.  Texts come as in `counting`: tokens joined by spaces and, for
character n-grams, the normalised text; rows of one text are neighbours.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from copy import copy
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: bytes of text that are worked on at a time
SLICE = 16 << 20
#: different terms that a task holds before it hands them on
HELD = 1 << 21
#: bits of a digest that tell most unknown terms from known ones
GATE = 18
#: bits of a counter's place in a table of a sketch, and pieces in which a table travels
TABLE, PIECES = 20, 16

_rng = np.random.Generator(np.random.PCG64(20250311))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE, _STEP, _LENGTH = (np.uint64(int(x) | 1) for x in _rng.integers(1 << 60, 1 << 63, 3))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def of_strings(column: pa.Array) -> np.ndarray:
    """The digest of each string."""
    n = len(column)
    if not n:
        return np.zeros(0, np.uint64)
    _, where, bytes_ = column.buffers()
    offsets = np.frombuffer(where, np.int64 if pa.types.is_large_string(column.type) else np.int32)[column.offset:column.offset + n + 1].astype(np.int64)
    lengths, sums = np.diff(offsets), np.zeros(n, np.uint64)
    if offsets[-1] > offsets[0]:
        data, start = np.frombuffer(bytes_, np.uint8)[offsets[0]:offsets[-1]], offsets[:-1] - offsets[0]
        powers = np.full(int(lengths.max()), _BASE, np.uint64)
        powers[0] = 1
        powers = np.multiply.accumulate(powers)
        sums[lengths > 0] = np.add.reduceat(_BYTE[data] * powers[np.arange(len(data)) - np.repeat(start, lengths)], start[lengths > 0])
    return mix(sums + lengths.astype(np.uint64) * _LENGTH)


@dataclass
class Words:
    """The words of some texts in order: the text of each, its place in ``names``, and these."""

    row: np.ndarray
    word: np.ndarray
    names: pa.Array


def _words(column: pa.Array, tokens: bool) -> Words:
    """Tokens that a single space parts, or what stands between any white space."""
    parts = pc.split_pattern(column, " ") if tokens else pc.ascii_split_whitespace(column)
    coded = parts.flatten().dictionary_encode()
    word = coded.indices.to_numpy().astype(np.int64)
    row = np.repeat(np.arange(len(column)), pc.list_value_length(parts).to_numpy())
    # an empty text has no token; white space at an end leaves an empty piece
    keep = (pc.binary_length(column).to_numpy() > 0)[row] if tokens else (pc.binary_length(coded.dictionary).to_numpy() > 0)[word]
    return Words(row, word, coded.dictionary) if keep.all() else Words(row[keep], word[keep], coded.dictionary)


def _runs(words: Words, ngrams: tuple[int, int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per length of runs: the place of each run's first word, and its digest."""
    single = of_strings(words.names)[words.word]
    code, first = single, np.arange(len(single))
    for n in range(1, ngrams[1] + 1):
        if n > 1:
            code = mix(code[:max(len(single) - n + 1, 0)] * _STEP + single[n - 1:])
            first = np.flatnonzero(words.row[:max(len(single) - n + 1, 0)] == words.row[n - 1:])
        if n >= ngrams[0]:
            yield n, first, code[first]


def _points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64), lengths


def _windows(points: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    code = np.zeros(len(start), np.uint64)
    for j in range(int(size.max(initial=0))):
        inside = j < size
        code = np.where(inside, code * _STEP + points[np.where(inside, start + j, 0)] + np.uint64(1), code)
    return mix(code + size.astype(np.uint64) * _LENGTH)


def _grams(names: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The character n-grams of each word padded with spaces: the word, where the gram begins, and its digest."""
    padded = pc.binary_join_element_wise(" ", names, " ", "")
    text = padded.buffers()[2].to_pybytes() if len(names) else b""
    points = np.frombuffer(text.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    points, lengths = points.astype(np.uint64), pc.utf8_length(padded).to_numpy().astype(np.int64)
    start, count = np.cumsum(lengths) - lengths, np.maximum(lengths - n, 0) + 1
    of = np.repeat(np.arange(len(lengths)), count)
    at = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    return of, at, _windows(points, start[of] + at, np.minimum(lengths, n)[of])


def of_terms(block: str, terms: list[str]) -> np.ndarray:
    """The digests of terms of a block, as they are found in texts."""
    out = np.zeros(len(terms), np.uint64)
    if block != "word":
        points, lengths = _points(terms)
        return _windows(points, np.cumsum(lengths) - lengths, lengths)
    parts = [t.split(" ") for t in terms]
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    for n in np.unique(sizes).tolist():
        mine = np.flatnonzero(sizes == n)
        columns = zip(*(parts[i] for i in mine.tolist()), strict=True)
        code = None
        for column in columns:
            single = of_strings(pa.array(column, pa.string()))
            code = single if code is None else mix(code * _STEP + single)
        out[mine] = code
    return out


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order, and the sum of ``n`` of each."""
    if not len(keys):
        return keys, n
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    start = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[start], np.add.reduceat(n, start)


def _slices(batch: pa.RecordBatch, keys: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with some SLICE bytes of text each; a longer text is a part of its own."""
    size = sum((pc.binary_length(c).fill_null(0).to_numpy().astype(np.int64) for c in batch.columns[keys:]), np.zeros(batch.num_rows, np.int64))
    ends, at = np.cumsum(size), 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE, "right")))
        yield batch.slice(at, to - at)
        at = to


BLOCKS = ("word", "char")


def _counted(part: pa.RecordBatch, spec) -> Iterator[tuple[int, np.ndarray, np.ndarray | None]]:
    """Block and digests of the terms of ``(tokens[, text])``, with how often each stands there (None: once)."""
    for _, _, code in _runs(_words(part.column(0), True), spec.word_ngrams):
        yield 0, code, None
    if spec.use_char:
        words = _words(part.column(1), False)
        of, _, code = _grams(words.names, spec.char_ngram)
        yield 1, code, np.bincount(words.word, minlength=len(words.names))[of]


def _places(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A term's counters in the two tables of its block."""
    low = code & np.uint64((1 << TABLE) - 1)
    return low.astype(np.int64), (code >> np.uint64(64 - TABLE)).astype(np.int64)


def sketch(batches: Iterator[pa.RecordBatch], spec) -> Iterator[pa.RecordBatch]:
    """``(piece, counts)`` of batches of ``(tokens[, text])``: two tables of counters per block, in compressed pieces."""
    tables = np.zeros((2 if spec.use_char else 1, 2, 1 << TABLE), np.int64)
    for batch in batches:
        for part in _slices(batch, 0):
            for kind, code, n in _counted(part, spec):
                for table, place in zip(tables[kind], _places(code), strict=True):
                    table += np.bincount(place, n, 1 << TABLE).astype(np.int64, copy=False)
    pieces = tables.reshape(-1, (1 << TABLE) // PIECES)
    for at, piece in enumerate(pieces):
        if piece.any():
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([zlib.compress(piece.tobytes(), 1)])], ["piece", "counts"])


def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of pieces ``(piece, counts)`` of sketches."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for piece, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            sums[piece] = sums.get(piece, np.int64(0)) + np.frombuffer(zlib.decompress(counts), np.int64)
    for piece, counts in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([zlib.compress(counts.tobytes(), 1)])], ["piece", "counts"])


@dataclass
class Sketch:
    """Upper bounds of how often each term stands in all texts: the smaller one of its two counters."""

    tables: dict[str, np.ndarray]

    @classmethod
    def of(cls, spec, pieces: list[tuple[int, bytes]]) -> Sketch:
        blocks = BLOCKS if spec.use_char else BLOCKS[:1]
        whole = np.zeros((2 * len(blocks) * PIECES, (1 << TABLE) // PIECES), np.int64)
        for at, counts in pieces:
            whole[at] = np.frombuffer(zlib.decompress(counts), np.int64)
        return cls(dict(zip(blocks, whole.reshape(len(blocks), 2, 1 << TABLE), strict=True)))

    def cuts(self, reach: dict[str, int], least: int) -> dict[str, int]:
        """Per block: a frequency that some ``reach`` terms may have, ``least`` if all may be among them."""
        out = {}
        for block, tables in self.tables.items():
            top = min(int(np.partition(t, -n)[-n]) if (n := reach[block]) <= len(t) else 0 for t in tables)
            out[block] = max(top, least, 1)
        return out

    def candidates(self, spec, cuts: dict[str, int]) -> Candidates:
        return Candidates(spec, {b: tuple(t >= cuts[b] for t in tables) for b, tables in self.tables.items()})


def occurrences(batches: Iterator[pa.RecordBatch], spec) -> Iterator[pa.RecordBatch]:
    """``(kind, code, n)`` of batches of ``(tokens[, text])``: how often the task has each term, by block and digest."""
    held: list[list] = [[], []]

    def merged(kind: int) -> tuple[np.ndarray, np.ndarray]:
        return _summed(*(np.concatenate(c) for c in zip(*held[kind], strict=True)))

    def handed(kind: int, codes: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(codes), 1 << 17):
            part = codes[at:at + (1 << 17)].view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), kind, np.int32)), pa.array(part), pa.array(n[at:at + (1 << 17)])], ["kind", "code", "n"])

    for batch in batches:
        for part in _slices(batch, 0):
            for kind, code, n in _counted(part, spec):
                held[kind].append(np.unique(code, return_counts=True) if n is None else _summed(code, n))
            for kind, some in enumerate(held):
                if sum(len(codes) for codes, _ in some) > HELD:
                    one = merged(kind)
                    if 2 * len(one[0]) > HELD:
                        yield from handed(kind, *one)
                        one = (one[0][:0], one[1][:0])
                    some[:] = [one]
    for kind, some in enumerate(held):
        if some:
            yield from handed(kind, *merged(kind))


class Known:
    """Terms that are looked for, by block: their digests, and their strings, which may be found out on the way."""

    def __init__(self, spec, codes: dict[str, np.ndarray], terms: dict[str, list[str]] | None = None) -> None:
        self.spec, self.blocks = spec, BLOCKS if spec.use_char else BLOCKS[:1]
        self.size = {b: len(codes[b]) for b in self.blocks}
        self.order = {b: np.argsort(codes[b], kind="stable") for b in self.blocks}
        self.codes = {b: codes[b][self.order[b]] for b in self.blocks}
        self.gate = {}
        for b in self.blocks:
            self.gate[b] = np.zeros(1 << GATE, bool)
            self.gate[b][self.codes[b] >> np.uint64(64 - GATE)] = True
        self.learn = terms is None
        self.terms = {b: [None] * self.size[b] for b in self.blocks} if terms is None else terms

    @classmethod
    def of(cls, spec, sets: dict[str, list[str]]) -> Known:
        return cls(spec, {b: of_terms(b, sets[b]) for b in BLOCKS}, sets)

    def fresh(self) -> Known:
        """For a task of its own: what is found out on the way is not shared."""
        other = copy(self)
        if self.learn:
            other.terms = {b: [None] * n for b, n in self.size.items()}
        return other

    def _found(self, block: str, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the digests are known, and what their terms' numbers are."""
        may = np.flatnonzero(self.gate[block][code >> np.uint64(64 - GATE)])
        codes = self.codes[block]
        at = np.minimum(np.searchsorted(codes, code[may]), len(codes) - 1)
        hit = codes[at] == code[may] if len(codes) else np.zeros(0, bool)
        return may[hit], self.order[block][at[hit]]

    def digests(self, block: str) -> np.ndarray:
        """The digest of each term by its number."""
        out = np.empty(self.size[block], np.uint64)
        out[self.order[block]] = self.codes[block]
        return out

    def _learnt(self, block: str, number: np.ndarray, string) -> None:
        if self.learn:
            names = self.terms[block]
            for x, i in zip(*(c.tolist() for c in np.unique(number, return_index=True)), strict=True):
                if names[x] is None:
                    names[x] = string(i)

    def cells(self, part: pa.RecordBatch, keys: int) -> dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Per block: row, known term and how often it stands there, in order of row and term."""
        words, found = _words(part.column(keys), True), []
        for n, first, code in _runs(words, self.spec.word_ngrams):
            at, number = self._found("word", code)
            at = first[at]
            self._learnt("word", number, lambda i, at=at, n=n: " ".join(words.names[int(w)].as_py() for w in words.word[at[i]:at[i] + n]))
            found.append(words.row[at] * self.size["word"] + number)
        out = {"word": self._apart("word", *np.unique(np.concatenate(found), return_counts=True))}
        if "char" in self.blocks:
            out["char"] = self._chars(_words(part.column(keys + 1), False))
        return out

    def _chars(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = self.spec.char_ngram
        of, begin, code = _grams(words.names, n)
        at, number = self._found("char", code)
        of = of[at]
        self._learnt("char", number, lambda i: f" {words.names[int(of[i])].as_py()} "[begin[at[i]]:begin[at[i]] + n])
        has = np.bincount(of, minlength=len(words.names))
        seen = has[words.word] > 0
        pairs, times = np.unique(words.row[seen] * len(words.names) + words.word[seen], return_counts=True)
        row, word = np.divmod(pairs, max(len(words.names), 1))
        count = has[word]
        inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        numbers = number[np.repeat((np.cumsum(has) - has)[word], count) + inside]
        return self._apart("char", *_summed(np.repeat(row, count) * self.size["char"] + numbers, np.repeat(times, count)))

    def _apart(self, block: str, keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return (*np.divmod(keys, max(self.size[block], 1)), n.astype(np.int64))


class Candidates(Known):
    """The terms whose counters pass, as they turn up; numbered in the order in which a task meets them."""

    def __init__(self, spec, open_: dict[str, tuple[np.ndarray, np.ndarray]]) -> None:
        self.spec, self.blocks, self.open, self.learn = spec, BLOCKS if spec.use_char else BLOCKS[:1], open_, True
        self.size = dict.fromkeys(self.blocks, 1 << 31)  # more than any task meets
        self.number: dict[str, dict[int, int]] = {b: {} for b in self.blocks}
        self.terms = {b: [] for b in self.blocks}

    def _found(self, block: str, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first, second = _places(code)
        may = np.flatnonzero(self.open[block][0][first])
        may = may[self.open[block][1][second[may]]]
        codes, place = np.unique(code[may], return_inverse=True)
        number = self.number[block]
        numbers = np.fromiter((number.setdefault(c, len(number)) for c in codes.tolist()), np.int64, len(codes))
        self.terms[block] += [None] * (len(number) - len(self.terms[block]))
        return may, numbers[place]

    def fresh(self) -> Candidates:
        return Candidates(self.spec, self.open)

    def digests(self, block: str) -> np.ndarray:
        return np.fromiter(self.number[block], np.uint64, len(self.number[block]))


@dataclass
class Texts:
    """Some texts: their key columns, and per block the cells (text, term, tf) and the rows of each text without any."""

    keys: list[pa.Array]
    cells: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]
    bare: dict[str, np.ndarray]

    @property
    def n(self) -> int:
        return len(next(iter(self.bare.values())))

    def cut(self, low: int, high: int) -> Texts:
        cells = {}
        for block, (text, term, tf) in self.cells.items():
            a, b = np.searchsorted(text, (low, high))
            cells[block] = (text[a:b] - low, term[a:b], tf[a:b])
        return Texts([c[low:high] for c in self.keys], cells, {k: v[low:high] for k, v in self.bare.items()})


def texts(batches: Iterator[pa.RecordBatch], known: Known, keys: int) -> Iterator[Texts]:
    """The texts of batches of ``(*keys, tokens[, text])``: rows of the same keys, which are neighbours, are one; without keys every row."""
    held: Texts | None = None
    for batch in batches:
        for part in _slices(batch, keys):
            listed = list(zip(*(c.to_pylist() for c in part.columns[:keys]), strict=True))
            start = [i == 0 or listed[i] != listed[i - 1] for i in range(part.num_rows)] if keys else [True] * part.num_rows
            begun = keys and held is not None
            if begun and listed:
                start[0] = listed[0] != tuple(c[0].as_py() for c in held.keys)
            start = np.array(start, bool)
            text = np.cumsum(start) - (0 if begun else 1)
            firsts = np.flatnonzero(start)
            n = len(firsts) + (1 if begun else 0)
            columns = [c.take(pa.array(firsts)) for c in part.columns[:keys]]
            if begun:
                columns = [pa.concat_arrays([a, b]) for a, b in zip(held.keys, columns, strict=True)]
            cells, bare = {}, {}
            for block, (row, term, tf) in known.cells(part, keys).items():
                none = np.ones(part.num_rows, bool)
                none[row] = False
                bare[block] = np.bincount(text[none], minlength=n)
                of = text[row]
                if begun:
                    of, term, tf = (np.concatenate(c) for c in zip(held.cells[block], (of, term, tf), strict=True))
                    bare[block][:1] += held.bare[block]
                size = max(known.size[block], 1)
                key, tf = _summed(of * size + term, tf)
                cells[block] = (*np.divmod(key, size), tf)
            now = Texts(columns, cells, bare)
            if not keys:
                yield now
                continue
            # the last text may go on
            if n > 1:
                yield now.cut(0, n - 1)
            held = now.cut(n - 1, n)
    if held is not None:
        yield held


def documents(batches: Iterator[pa.RecordBatch], known: Known, keys: int) -> Iterator[pa.RecordBatch]:
    """``(block, code, term, df, cf)`` of the known terms that the task's texts have."""
    df, cf = ({b: np.zeros(0, np.int64) for b in known.blocks} for _ in range(2))
    for some in texts(batches, known, keys):
        for block, (_, term, tf) in some.cells.items():
            n = len(known.terms[block])
            for sums in (df, cf):
                sums[block] = np.concatenate((sums[block], np.zeros(n - len(sums[block]), np.int64)))
            df[block] += np.bincount(term, minlength=n)
            cf[block] += np.bincount(term, tf, n).astype(np.int64)
    for block in known.blocks:
        at = np.flatnonzero(df[block])
        codes = known.digests(block)
        for low in range(0, len(at), 1 << 16):
            some = at[low:low + (1 << 16)]
            yield pa.RecordBatch.from_arrays([
                pa.array([block] * len(some), pa.string()), pa.array(codes[some].view(np.int64)), pa.array([known.terms[block][i] for i in some.tolist()], pa.string()),
                pa.array(df[block][some]), pa.array(cf[block][some])], ["block", "code", "term", "df", "cf"])


def per_row(batches: Iterator[pa.RecordBatch], known: Known, keys: int, columns: list[str]) -> Iterator[pa.RecordBatch]:
    """``(*keys, block, term, tf)`` of the known terms, and with a null term how many of the text's rows have none, if any."""
    names = {b: pa.array(known.terms[b], pa.string()) for b in known.blocks}
    for some in texts(batches, known, keys):
        for block, (text, term, tf) in some.cells.items():
            bare = np.flatnonzero(some.bare[block])
            at, n = np.concatenate((text, bare)), np.concatenate((tf, some.bare[block][bare]))
            found = pa.concat_arrays([names[block].take(pa.array(term)), pa.nulls(len(bare), pa.string())])
            for low in range(0, len(at), 1 << 16):
                part = slice(low, low + (1 << 16))
                one = at[part]
                yield pa.RecordBatch.from_arrays(
                    [*(c.take(pa.array(one)) for c in some.keys), pa.array([block] * len(one), pa.string()), found[part], pa.array(n[part])],
                    columns)


def lists(batches: Iterator[pa.RecordBatch], known: Known, columns: list[str]) -> Iterator[pa.RecordBatch]:
    """``(key, block, terms)``: the known terms of each text that has any."""
    names = {b: pa.array(known.terms[b], pa.string()) for b in known.blocks}
    for some in texts(batches, known, 1):
        for block, (text, term, _) in some.cells.items():
            at, count = np.unique(text, return_counts=True)
            ends = pa.array(np.concatenate(([0], np.cumsum(count))), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*(c.take(pa.array(at)) for c in some.keys), pa.array([block] * len(at), pa.string()), pa.ListArray.from_arrays(ends, names[block].take(pa.array(term)))],
                columns)


def sums(batches: Iterator[pa.RecordBatch], known: Known, weights: dict[str, tuple[np.ndarray, np.ndarray]],
         columns: list[str]) -> Iterator[pa.RecordBatch]:
    """``(key, z)``: a text's weighted sums over its normalised features, one per label; ``weights`` has idf and coefficients by term."""
    width = next(iter(weights.values()))[1].shape[1]
    for some in texts(batches, known, 1):
        z = np.zeros((some.n, width))
        for block, (text, term, tf) in some.cells.items():
            if not len(text):
                continue
            idf, coefs = weights[block]
            w = (1 + np.log(tf)) * idf[term]
            start = np.flatnonzero(np.concatenate(([True], text[1:] != text[:-1])))
            norm = np.sqrt(np.add.reduceat(w * w, start))
            for low in range(0, width, 16):  # a bounded number of products at a time
                part = np.add.reduceat(w[:, None] * coefs[term, low:low + 16], start, axis=0)
                z[text[start], low:low + 16] += part / norm[:, None]
        ends = pa.array(np.arange(some.n + 1) * width, pa.int32())
        yield pa.RecordBatch.from_arrays([some.keys[0], pa.ListArray.from_arrays(ends, pa.array(z.ravel()))], columns)
