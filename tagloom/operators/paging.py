"""Pages of a long table by its key, without an offset over all rows.

Rows are counted per range of the key.  The counts turn an offset and a limit into key bounds, so that only the
ranges a page touches are read in order; a range that holds far more rows than the page is split further.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: ranges of one level; their counts are all that the driver sees
RANGES = 4096
#: rows that may be sorted for the ends of a page
FEW = 100_000


def page(rows: DataFrame, key: str, limit: int | None = None, offset: int = 0, newest_first: bool = False) -> DataFrame:
    """``limit`` rows after ``offset`` in the order of the integer ``key`` (falling: ``newest_first``).

    Keys are unique; rows without a key are on no page.
    """
    order = F.col(key).desc() if newest_first else F.col(key).asc()
    listed = rows.where(F.col(key).isNotNull())
    if limit is None and offset == 0:
        return listed.orderBy(order)
    bounds = listed.agg(F.min(key).alias("low"), F.max(key).alias("high")).first()
    if bounds["low"] is None:
        return listed.orderBy(order)
    first, skipped = _position(listed, key, bounds["low"], bounds["high"], offset, newest_first)
    if first is None:
        return listed.where(F.lit(False))
    if limit is None:
        inside = listed.where(F.col(key) <= first[1] if newest_first else F.col(key) >= first[0])
        if offset == skipped:
            return inside.orderBy(order)
        # rows that stand before the page are in its first range; the page begins behind their last key
        last = listed.where(F.col(key).between(*first)).orderBy(order).offset(offset - skipped).limit(1).first()[key]
        return inside.where(F.col(key) <= last if newest_first else F.col(key) >= last).orderBy(order)
    last, _ = _position(listed, key, bounds["low"], bounds["high"], offset + limit - 1, newest_first)
    low, high = (last[0] if last else bounds["low"], first[1]) if newest_first else (first[0], last[1] if last else bounds["high"])
    return listed.where(F.col(key).between(low, high)).orderBy(order).offset(offset - skipped).limit(limit)


def _position(rows: DataFrame, key: str, low: int, high: int, at: int, falling: bool) -> tuple[tuple[int, int] | None, int]:
    """The range of keys that holds the row at ``at`` (from 0), and how many rows come before the range."""
    skipped = 0
    while True:
        width = (high - low) // RANGES + 1
        counts = {r["i"]: r["n"] for r in rows.where(F.col(key).between(low, high))
                  .groupBy(F.floor((F.col(key) - low) / width).alias("i")).agg(F.count("*").alias("n")).collect()}
        for i in sorted(counts, reverse=falling):
            if at < skipped + counts[i]:
                break
            skipped += counts[i]
        else:
            return None, skipped
        low, high = low + i * width, min(high, low + (i + 1) * width - 1)
        if counts[i] <= FEW or low == high:
            return (low, high), skipped
