"""Tables of counters over hashed values: filled by tasks in numpy, summed piece by piece on Spark.

A table has a fixed number of counters, so it never grows with the input; what shares a counter is counted
together, and a counter is an upper bound for each of its values.  Tasks hand on compressed pieces, and the
tasks that sum them hold one table at most.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, IntegerType, StructField, StructType

from tagloom.llm.staging import discard, staged

PIECES = 64
PIECE = StructType([StructField("piece", IntegerType()), StructField("counts", BinaryType())])


def pieces(table: np.ndarray) -> list[pa.Array]:
    """A task's table (32-bit counters) as the columns of PIECE."""
    parts = [zlib.compress(p.tobytes(), 1) for p in np.split(table, PIECES)]
    return [pa.array(range(PIECES), pa.int32()), pa.array(parts, pa.binary())]


def coarse(counts: np.ndarray) -> np.ndarray:
    """Counts up to 15 as they are, larger ones in eighths of a doubling: one byte each, in the same order."""
    big = 16 + np.floor(8 * np.log2(np.clip(counts, 16, (1 << 32) - 1) / 16))
    return np.where(counts < 16, counts, big).astype(np.uint8)


def summed(rows: DataFrame, size: int, code: Callable[[np.ndarray], np.ndarray] = np.asarray, kind: type = np.int64) -> np.ndarray:
    """All tasks' tables (``piece, counts``) added up; ``code`` makes ``kind`` of the sums before they come to the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[piece] = sums.get(piece, np.int64(0)) + np.frombuffer(zlib.decompress(counts), np.uint32)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([code(x.astype(np.int64)).tobytes() for x in sums.values()], pa.binary())],
                                         PIECE.names)

    table = np.zeros(size, kind)
    whole = staged(rows.select("piece", "counts").repartition("piece").mapInArrow(run, PIECE))
    for r in whole.collect():
        table[r["piece"] * (size // PIECES):(r["piece"] + 1) * (size // PIECES)] = np.frombuffer(r["counts"], kind)
    discard(whole)
    return table
