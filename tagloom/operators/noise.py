"""Seeded spelling noise for robustness studies."""

from __future__ import annotations

import hashlib
from functools import lru_cache
from math import floor, sin

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: positions whose digests are computed side by side, so that their arrays stay in the cache
SIDE = 1 << 14
#: characters of texts that are changed at a time
CHARS = 1 << 18

_K = [np.uint32(floor(abs(sin(i + 1)) * 2 ** 32)) for i in range(64)]
_TURN = [x for row in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for x in row * 4]
_WORD = [*range(16), *((5 * i + 1) % 16 for i in range(16)), *((3 * i + 5) % 16 for i in range(16)), *((7 * i) % 16 for i in range(16))]
_START = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]


def md5_starts(words: list[np.ndarray | None]) -> np.ndarray:
    """The first four bytes of the MD5 of messages of one block, as little-endian numbers.

    ``words`` are the block's 16 words of all messages, None for zeros.  The last three steps do not change these bytes.
    """
    n = len(words[14])
    a, b, c, d = (np.full(n, x, np.uint32) for x in _START)
    t, u = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i in range(61):
        if i < 16:
            np.bitwise_xor(c, d, out=t)
            np.bitwise_and(t, b, out=t)
            np.bitwise_xor(t, d, out=t)
        elif i < 32:
            np.bitwise_xor(b, c, out=t)
            np.bitwise_and(t, d, out=t)
            np.bitwise_xor(t, c, out=t)
        elif i < 48:
            np.bitwise_xor(b, c, out=t)
            np.bitwise_xor(t, d, out=t)
        else:
            np.bitwise_not(d, out=t)
            np.bitwise_or(t, b, out=t)
            np.bitwise_xor(t, c, out=t)
        np.add(t, a, out=t)
        np.add(t, _K[i], out=t)
        if (word := words[_WORD[i]]) is not None:
            np.add(t, word, out=t)
        np.left_shift(t, np.uint32(_TURN[i]), out=u)
        np.right_shift(t, np.uint32(32 - _TURN[i]), out=t)
        np.bitwise_or(t, u, out=u)
        np.add(u, b, out=u)
        a, b, c, d, u = d, u, b, c, a
    return b + _START[0]


@lru_cache(maxsize=32)
def _digits(block: int, width: int) -> np.ndarray:
    """The ``width`` decimal digits of the numbers of a block of SIDE, as bytes."""
    numbers = np.arange(block * SIDE, (block + 1) * SIDE)
    return np.stack([numbers // 10 ** (width - 1 - k) % 10 + 48 for k in range(width)], axis=1).astype(np.uint8)


def draws(tags: list[bytes | None], sizes: list[int]) -> np.ndarray:
    """For each tag and each position below its size: the first three hexadecimal digits of the MD5 of the tag and
    the position in decimals, as a number; 4096 without a tag."""
    out = np.full(sum(sizes), 4096, np.int64)
    message, size = np.zeros((SIDE, 64), np.uint8), np.empty(SIDE, np.uint32)
    held: list[tuple[int, int]] = []  # where the messages belong, and how many there are
    filled = used = start = 0

    def flush() -> None:
        words = [np.ascontiguousarray(message[:filled, 4 * k:4 * k + 4]).view("<u4")[:, 0] if k < used else None for k in range(14)]
        found = md5_starts([*words, size[:filled], None])
        found, at = ((found & 255) << 4) | ((found >> 12) & 15), 0
        for to, n in held:
            out[to:to + n] = found[at:at + n]
            at += n

    for tag, n in zip(tags, sizes, strict=True):
        if tag is not None and len(tag) + len(str(n)) > 55:  # more than one block
            out[start:start + n] = [int(hashlib.md5(tag + b"%d" % i).hexdigest()[:3], 16) for i in range(n)]
        elif tag is not None:
            t = len(tag)
            for first in range(0, n, SIDE):
                last = min(n, first + SIDE)
                if filled + last - first > SIDE:
                    flush()
                    held, filled, used = [], 0, 0
                mine = message[filled:filled + last - first]
                mine[:, :t] = np.frombuffer(tag, np.uint8)
                mine[:, t:] = 0
                for width in range(len(str(first)), len(str(last - 1)) + 1):
                    low, high = max(first, 10 ** (width - 1) if width > 1 else 0) - first, min(last, 10 ** width) - first
                    mine[low:high, t:t + width] = _digits(first // SIDE, width)[low:high]
                    mine[low:high, t + width] = 0x80
                    size[filled + low:filled + high] = 8 * (t + width)
                held.append((start + first, last - first))
                filled, used = filled + last - first, max(used, (t + len(str(last - 1))) // 4 + 1)
        start += n
    if held:
        flush()
    return out


def changed(texts: list[str], tags: list[bytes | None], cut: int) -> list[str]:
    """The texts with characters swapped, deleted or doubled where a draw is below ``cut``; as they are without a tag."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum(sizes)
    drawn = draws(tags, sizes.tolist())
    ops = np.where(drawn < cut, drawn % 3, 3)  # 0 swap, 1 delete, 2 duplicate, 3 none
    free = np.append(ops[1:] == 3, False)
    free[ends[sizes > 0] - 1] = False
    swap = np.flatnonzero((ops == 0) & free)
    source, times = np.arange(len(points)), np.ones(len(points), np.int64)
    source[swap], source[swap + 1] = swap + 1, swap
    times[ops == 1], times[ops == 2] = 0, 2
    whole = np.repeat(points[source], times).tobytes().decode("utf-32-le", "surrogatepass")
    stops = np.concatenate(([0], np.cumsum(times)))[np.concatenate(([0], ends))].tolist()
    return [whole[a:b] for a, b in zip(stops[:-1], stops[1:], strict=True)]


def with_spelling_noise(df: DataFrame, text: str, row_id: str, rate: float, seed: int, out: str) -> DataFrame:
    """Swap / delete / duplicate characters, each position drawing for itself.

    The draw is a digest of (seed, row, position), so it does not depend on partitioning.  A
    swap is carried out only where the next position drew nothing, so two never meet.
    """
    cut = int(round(rate * 4096))

    @F.arrow_udf("string")
    def noisy(texts: pa.Array, tags: pa.Array) -> pa.Array:
        listed, found, at = texts.to_pylist(), [], 0
        marks = [None if t is None else t.encode() for t in tags.to_pylist()]
        while at < len(listed):  # a bounded number of characters at a time
            to, n = at, 0
            while to < len(listed) and (to == at or n + len(listed[to]) <= CHARS):
                n += len(listed[to])
                to += 1
            found += changed(listed[at:to], marks[at:to], cut)
            at = to
        return pa.array(found, pa.string())

    tag = F.concat(F.lit(f"{seed}|"), F.col(row_id).cast("string"), F.lit("|"))
    return df.withColumn(out, noisy(F.coalesce(F.col(text), F.lit("")), tag))
