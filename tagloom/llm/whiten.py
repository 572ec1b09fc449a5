"""Whitening of embeddings: principal components by contour integration (FEAST), scaled to unit variance.

1. Every component c of a vector becomes the integer x = floor(SCALE * c) + OFFSET.  Two passes over the
   table give the exact sums per dimension, then the products of entries centred at the integer next to the
   mean.  Tasks add up in numpy and hand on one number per entry of the matrix, and a grouped sum merges
   them: these numbers are integers below 2^53, so the covariance does not depend on the order of tasks.
2. The covariance is as large as the dimension squared, whatever the table's length; the driver finds its
   leading eigenvectors.  Inertia counts (signs of the pivots of a symmetric factorisation) give the number
   of eigenvalues above any value, and by bisection intervals with few eigenvalues each.  Per interval the
   spectral projector is a sum over nodes of a circle: solves with complex shifts of the covariance, applied
   to a block of vectors.  Rayleigh-Ritz on the projected block gives the pairs; this is repeated until they
   hold to rounding, and the interval's inertia count must equal the pairs found.  Where it does not, the
   block is doubled, at last to the whole space.
3. A third pass projects every row.  Its covariance, by Spark's own merged and centred aggregates, is compared
   with the identity.

Rows whose vector is null, or holds null or non-finite entries, are dropped; so are empty vectors and vectors
whose length is not the table's most frequent one (ties: the smaller).  x is held at +-2^53 at most.  A
deviation that no long can hold is null.  Null and repeated ids are rows like others; repeated vectors count
each time.  Components whose eigenvalue is zero to rounding are not returned, so a table of one vector, or
of none, gives no rows.  Equal eigenvalues have no unique vectors; any orthonormal ones are taken, the same for
all rows.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from tagloom.llm.staging import staged

SCALE, OFFSET = 1024, 100000
LARGEST = float(1 << 53)
#: eigenvalues of one contour, and nodes on its upper half
PER_CONTOUR = 4
NODES = 12
ROUNDS = 12
#: rows multiplied at a time
STEP = 4096


def integers(vectors: pa.Array, dim: int) -> np.ndarray:
    """The x-vectors of whole, finite vectors of ``dim`` entries."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    with np.errstate(over="ignore"):  # beyond a double is beyond LARGEST
        return np.clip(np.floor(SCALE * flat), -LARGEST, LARGEST).astype(np.int64) + OFFSET


def usable(vector: Column) -> Column:
    whole = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))))
    return F.coalesce((F.size(vector) > 0) & whole, F.lit(False))


def fit_rows(rows: DataFrame, vector: str) -> tuple[DataFrame, int]:
    """The rows that take part, and their dimension (0: none)."""
    good = rows.where(usable(F.col(vector)))
    most = good.groupBy(F.size(vector).alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    dim = most["dim"] if most else 0
    return good.where(F.size(vector) == dim), dim


_ENTRY = StructType([StructField("i", LongType()), StructField("value", LongType())])


def _summed(vectors: DataFrame, entries: Callable[[pa.Array], np.ndarray]) -> dict[int, int]:
    """Sums over all rows of the integers that ``entries`` gives for a batch, by place."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                part = entries(batch.column(0).slice(at, STEP))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total, pa.int64())], ["i", "value"])

    rows = vectors.mapInArrow(run, _ENTRY).groupBy("i").agg(F.sum("value").alias("value")).collect()
    return {r["i"]: r["value"] for r in rows}


@dataclass
class Moments:
    """Rows, exact sums, and the covariance of the x-vectors of a table."""

    n: int
    sums: list[int]
    covariance: np.ndarray

    @property
    def centre(self) -> np.ndarray:
        """The integers next to the means."""
        return np.array([(2 * s + self.n) // (2 * self.n) for s in self.sums], np.int64)

    @property
    def rest(self) -> np.ndarray:
        """Centre less mean, from exact integers."""
        return np.array([(int(m) * self.n - s) / self.n for m, s in zip(self.centre, self.sums, strict=True)])


def moments(rows: DataFrame, vector: str, dim: int) -> Moments:
    vectors = rows.select(vector)

    def sums(batch: pa.Array) -> np.ndarray:
        x = integers(batch, dim)
        return np.concatenate(((x >> 26).sum(axis=0), (x & ((1 << 26) - 1)).sum(axis=0), [len(x)]))

    found = _summed(vectors, sums)
    totals = [(found[i] << 26) + found[dim + i] for i in range(dim)]
    out = Moments(found[2 * dim], totals, np.zeros((dim, dim)))
    centre, rest = out.centre, out.rest
    widest = vectors.select(F.max(F.array_max(F.transform(vector, lambda c: F.abs(c)))).alias("w")).first()["w"]
    # products are held in units of a power of two that keeps their sum in a long: 1, unless entries are enormous
    span = 2 * (min(SCALE * float(widest), LARGEST) + OFFSET)
    shift = max(0, int(np.ceil(2 * np.log2(span) + np.log2(out.n))) - 62)

    def products(batch: pa.Array) -> np.ndarray:
        y = (integers(batch, dim) - centre).astype(np.float64)
        return np.rint(np.ldexp(y.T @ y, -shift)).astype(np.int64).ravel()

    found = _summed(vectors, products)
    raw = np.array([float(found[i]) for i in range(dim * dim)]).reshape(dim, dim)
    out.covariance = np.ldexp(raw, shift) / out.n - np.outer(rest, rest)
    return out


def above(matrix: np.ndarray, value: float) -> int:
    """How many eigenvalues of a symmetric matrix are above ``value``: positive pivots of its shifted factorisation.

    Pivots are the largest diagonal entry, or a block of two where an entry beside the diagonal outweighs it; such
    a block has one eigenvalue of either sign.
    """
    a = matrix - value * np.eye(len(matrix))
    positive = 0
    while len(a):
        one = int(np.argmax(np.abs(np.diag(a))))
        off = np.abs(a - np.diag(np.diag(a)))
        i, j = divmod(int(np.argmax(off)), len(a))
        if abs(a[one, one]) >= 0.6404 * off[i, j]:
            pivot, chosen = a[one:one + 1, one:one + 1], [one]
            positive += int(pivot[0, 0] > 0)
            if pivot[0, 0] == 0:  # nothing but zeros is left
                return positive
        else:
            pivot, chosen = a[np.ix_([i, j], [i, j])], [i, j]
            positive += 1
        left = np.delete(np.arange(len(a)), chosen)
        side = a[np.ix_(left, chosen)]
        a = a[np.ix_(left, left)] - side @ np.linalg.solve(pivot, side.T)
        a = (a + a.T) / 2
    return positive


def contours(matrix: np.ndarray, k: int, top: float, least: float) -> list[tuple[float, float, int]]:
    """Intervals (low, high, eigenvalues inside) that hold the ``k`` largest eigenvalues above ``least``."""
    low, high, inside = least, top, above(matrix, least)
    wanted = min(k, inside)
    while inside > wanted and high - low > 1e-12 * top:
        middle = (low + high) / 2
        count = above(matrix, middle)
        if count >= wanted:
            low, inside = middle, count
        else:
            high = middle
    out, waiting = [], [(low, top, inside, 0)]
    while waiting:
        a, b, over_a, over_b = waiting.pop()
        if over_a - over_b <= PER_CONTOUR or b - a <= 1e-9 * top:
            if over_a > over_b:
                out.append((a, b, over_a - over_b))
            continue
        middle = (a + b) / 2
        over = above(matrix, middle)
        waiting += [(a, middle, over_a, over), (middle, b, over, over_b)]
    return out


def projected(matrix: np.ndarray, block: np.ndarray, low: float, high: float) -> np.ndarray:
    """The block's part in the eigenvectors of (low, high): quadrature of complex shifted solves on a circle."""
    radius, eye = (high - low) / 2, np.eye(len(matrix))
    turns = np.exp(1j * np.pi * (np.arange(NODES) + 0.5) / NODES)
    return sum((turn * np.linalg.solve(((low + high) / 2 + radius * turn) * eye - matrix, block)).real for turn in turns) * radius / NODES


def in_contour(matrix: np.ndarray, low: float, high: float, count: int, top: float) -> np.ndarray:
    """Orthonormal eigenvectors of the eigenvalues in (low, high]; as many as the inertia count says."""
    d = len(matrix)
    width = min(d, 2 * count + 8)
    while True:
        block = np.random.Generator(np.random.PCG64(17)).standard_normal((d, width))
        for _ in range(ROUNDS):
            if width == d:  # the whole space: nothing to project
                basis = np.linalg.qr(block)[0]
            else:
                basis = np.linalg.qr(projected(matrix, block, low, high))[0]
            values, turn = np.linalg.eigh(basis.T @ matrix @ basis)
            block = basis @ turn
            found = np.flatnonzero((values > low) & (values <= high))
            pairs = block[:, found]
            worst = np.linalg.norm(matrix @ pairs - pairs * values[found], axis=0).max(initial=0.0)
            if len(found) == count and worst <= 64 * np.finfo(float).eps * top:
                return pairs
            if width == d:  # eigenvalues on the border to rounding: take the nearest
                near = np.argsort(np.abs(values - (low + high) / 2), kind="stable")[:count]
                return block[:, near]
        width = min(d, 2 * width)


def components(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues, falling, and their unit vectors (columns); zero eigenvalues are left out."""
    scale = float(np.trace(matrix))
    if not len(matrix) or scale <= 0:
        return np.zeros(0), np.zeros((len(matrix), 0))
    a = matrix / scale  # no eigenvalue is above 1
    least = 16 * len(matrix) * np.finfo(float).eps
    found = [in_contour(a, low, high, count, 1.0) for low, high, count in contours(a, k, 1 + 1e-9, least)]
    # all intervals together once more, so that the vectors are orthogonal across intervals too
    basis = np.linalg.qr(np.concatenate(found, axis=1))[0]
    values, turn = np.linalg.eigh(basis.T @ a @ basis)
    first = np.argsort(-values, kind="stable")[:k]
    vectors = basis @ turn[:, first]
    heavy = vectors[np.argmax(np.abs(vectors), axis=0), np.arange(len(first))]
    return values[first] * scale, vectors * np.where(heavy < 0, -1.0, 1.0)


@dataclass
class Whitening:
    """What turns a vector into whitened components."""

    dim: int
    moments: Moments
    values: np.ndarray
    vectors: np.ndarray

    @property
    def explained(self) -> np.ndarray:
        return self.values / np.trace(self.moments.covariance)


def fit(rows: DataFrame, vector: str = "embedding", k: int = 8) -> tuple[DataFrame, Whitening | None]:
    """The rows that take part, and the whitening of their first ``k`` components (None: no rows)."""
    good, dim = fit_rows(rows, vector)
    if not dim:
        return good, None
    found = moments(good, vector, dim)
    return good, Whitening(dim, found, *components(found.covariance, k))


def deviations(y: np.ndarray, n: int, rest: list[int]) -> list[int | None]:
    """Per row the sum of (n * y + rest)^2 over dimensions, exact; None beyond a long."""
    widest = max(abs(int(y.min(initial=0))), abs(int(y.max(initial=0)))) * n + max(map(abs, rest), default=0)
    if widest < 1 << 62 and y.shape[1] * widest * widest < 1 << 63:
        return ((n * y + np.array(rest, np.int64)) ** 2).sum(axis=1).tolist()
    exact = [sum((n * v + r) ** 2 for v, r in zip(row, rest, strict=True)) for row in y.tolist()]
    return [v if v < 1 << 63 else None for v in exact]


_WHITE = StructType([StructField("deviation", LongType()), StructField("whitened", ArrayType(DoubleType()))])


def whitened(vector: Column, model: Whitening) -> Column:
    """``deviation`` and ``whitened`` (one double per component) of a vector that takes part."""
    m, centre = model.moments, model.moments.centre
    rest = [int(c) * m.n - s for c, s in zip(centre, m.sums, strict=True)]
    means, scaled, dim = m.rest, model.vectors / np.sqrt(model.values), model.dim
    k = len(model.values)

    def run(vectors: pa.Array) -> pa.Array:
        y = integers(vectors, dim) - centre if len(vectors) else np.zeros((0, dim), np.int64)
        white = (y + means) @ scaled
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1) * k, pa.int32()), pa.array(white.ravel()))
        return pa.StructArray.from_arrays([pa.array(deviations(y, m.n, rest), pa.int64()), lists], _WHITE.names)

    return arrow_udf(run, _WHITE)(vector)


def identity_error(rows: DataFrame, k: int) -> float:
    """Largest absolute entry of the covariance of the array column ``whitened`` less the identity."""
    w = F.col("whitened")
    pairs = [(i, j) for i in range(k) for j in range(i + 1)]
    got = rows.agg(*[F.covar_pop(w[i], w[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(got[f"c{i}_{j}"] - (i == j)) for i, j in pairs)


def whitened_rows(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", k: int = 8) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` per remaining row and component."""
    good, model = fit(rows.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("vector")), "vector", k)
    if model is None or not len(model.values):
        return good.select("vec_id", F.lit(1).alias("component"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("deviation"),
                           *[F.lit(0.0).alias(c) for c in ("whitened", "explained", "identity_error")]).where(F.lit(False))
    white = staged(good.select("vec_id", whitened(F.col("vector"), model).alias("w")).select("vec_id", "w.*"))
    error = identity_error(white, len(model.values))
    parts = F.explode(F.array(*[F.struct(F.lit(i + 1).alias("component"), F.col("whitened")[i].alias("whitened"), F.lit(float(e)).alias("explained"))
                                for i, e in enumerate(model.explained)]))
    return white.select("vec_id", "deviation", parts.alias("part")).select(
        "vec_id", "part.component", F.lit(model.moments.n).cast("long").alias("n"), "deviation", "part.whitened", "part.explained",
        F.lit(error).alias("identity_error"))
