"""Words of many texts at once: numpy arrays over the UTF-8 bytes of an Arrow column.

The functions run inside Arrow UDFs.  A *block* is a run of whole texts of a few MB; a text longer
than that is a block of its own, so nothing is ever cut.  Words are hashed by a polynomial over the
bytes of the block: prefix sums give the hash of any stretch by one subtraction.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 512 << 10
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_rng = np.random.Generator(np.random.PCG64(20240607))
#: a random 64-bit value for every byte, upper-case ASCII like lower-case
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE_LOWER[97:123]
#: separators of words: space, tab, line feed, vertical tab, form feed, carriage return
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
_powers: dict[str, np.ndarray] = {}


def _power(kind: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        steps = np.full(max(n, BLOCK_BYTES + 1), base, np.uint64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if len(have) > 64 * BLOCK_BYTES:  # of one huge text: not kept
            return have
        _powers[kind] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Block:
    """Whole texts side by side: ``data[offsets[i]:offsets[i + 1]]`` are the bytes of text i."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def texts(self) -> int:
        return len(self.offsets) - 1


def blocks(column: pa.Array, size: int = BLOCK_BYTES) -> Iterator[Block]:
    """The texts of a string column; a null counts as an empty text."""
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type)
    _, where, bytes_ = column.buffers()
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset:column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(bytes_, np.uint8) if bytes_ is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield Block(at, data[offsets[at]:offsets[to]], offsets[at:to + 1] - offsets[at])
        at = to


@dataclass
class Words:
    """Words in order: byte range, 64-bit hash, and ``bounds[i]:bounds[i + 1]`` for text i."""

    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    bounds: np.ndarray

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def runs(block: Block, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and per-text bounds of the longest stretches without separators."""
    inside = np.zeros(len(block.data) + 1, bool)
    np.logical_not(separators[block.data], out=inside[:-1])
    before = np.zeros(len(inside), bool)
    before[1:] = inside[:-1]
    before[block.offsets] = False  # a text ends every word
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(len(inside), bool)
    after[:-1] = inside[1:]
    after[block.offsets[1:] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, block.offsets)


def stretch_hashes(block: Block, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    """64-bit hashes of byte ranges; equal bytes give equal hashes wherever they stand."""
    n = len(block.data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((_BYTE_LOWER if lower else _BYTE)[block.data] * _power("up", _BASE, n)[:n], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _power("down", _INVERSE, n + 1)[starts])


def words(block: Block, lower: bool, separators: np.ndarray = SPACES) -> Words:
    starts, ends, bounds = runs(block, separators)
    return Words(starts, ends, stretch_hashes(block, starts, ends, lower), bounds)


def hash_text(text: str | bytes) -> int:
    """The hash that ``words(lower=True)`` gives this word."""
    raw = text.encode() if isinstance(text, str) else text
    block = Block(0, np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    return int(stretch_hashes(block, np.array([0]), np.array([len(raw)]), True)[0])


def windows(found: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``width`` consecutive words inside one text, and the index of their first word."""
    n = len(found.hashes)
    if n < width:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    value = np.zeros(n - width + 1, np.uint64)
    for k in range(width):
        value = value * _BASE + found.hashes[k:n - width + 1 + k]
    text = found.text_of()
    whole = text[:n - width + 1] == text[width - 1:]
    return mix(value[whole]), np.flatnonzero(whole)


def shingle_sets(found: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles per text, sorted: values and bounds.

    A text of fewer words than ``width`` has its whole sequence as the only shingle; a text without
    words has none.
    """
    value, at = windows(found, width)
    counts = np.diff(found.bounds)
    sizes = np.maximum(counts - width + 1, (counts > 0).astype(np.int64))
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    out = np.zeros(bounds[-1], np.uint64)
    short = (counts > 0) & (counts < width)
    long_rows = np.repeat(~short, sizes)
    out[long_rows] = value
    for i in np.flatnonzero(short):
        folded = np.uint64(counts[i])
        for h in found.hashes[found.bounds[i]:found.bounds[i + 1]]:
            folded = np.uint64((int(folded) * int(_BASE) + int(h)) & 0xFFFFFFFFFFFFFFFF)
        out[bounds[i]] = mix(np.array([folded], np.uint64))[0]
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        out[a:b].sort()
    fresh = np.ones(len(out), bool)
    fresh[1:] = out[1:] != out[:-1]
    fresh[bounds[:-1][sizes > 0]] = True
    kept = np.concatenate(([0], np.cumsum(fresh)))
    return out[fresh], kept[bounds]
