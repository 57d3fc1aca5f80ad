"""Whitened embeddings: pivoted Cholesky of the centred scatter, then one-sided Jacobi on the triangular factor.

Entries become integers (``floor(64 * c) + 1000000``), so sums and products are exact: tasks add up rows less the rounded mean,
Spark adds the few sums of the tasks by place, and the scatter is divided only once, on the driver, where it is one matrix of
dimension x dimension. Its factor's columns are rotated in disjoint pairs until they are at right angles; their squared norms
are the eigenvalues, the columns over their norms the components. A component's largest entry is positive.

Vectors that are null, or hold null or non-finite entries, are dropped, as are those whose length is not the most frequent one
(of equally frequent ones the longest). Repeated rows and ids count as often as they occur. An empty table, or vectors that are
all equal, give no rows; there are only as many components as the scatter has rank. Entries beyond 2**52 in size are held at
it. Where a vector's deviation does not fit a long it is null. Other columns do not enter and may have any names.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import kind_of

#: Fixed values of the integer entries.
SCALE, SHIFT = 64, 1_000_000
#: Components that are returned; entries beyond are held at this size; products within it are exact as 64-bit integers.
MOST, HELD, EXACT = 32, 2.0**52, 2.0**62
#: Rows that are multiplied at once.
BLOCK = 8_192


@dataclass
class Whitening:
    """What the rows of a table are whitened by; all of it has the size of the dimension."""

    n: int
    sums: list[int]
    components: np.ndarray  # one a row
    values: np.ndarray
    trace: float
    identity_error: float = float("nan")

    @property
    def centre(self) -> np.ndarray:
        return np.array([(2 * s + self.n) // (2 * self.n) for s in self.sums], np.int64)

    @property
    def rest(self) -> np.ndarray:
        """The mean less the centre."""
        return np.array([(s - c * self.n) / self.n for s, c in zip(self.sums, self.centre.tolist())])

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return (x - self.centre - self.rest) @ self.components.T / np.sqrt(self.values)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n * x - sum)^2."""
        near, rest = x - self.centre, np.array([s - c * self.n for s, c in zip(self.sums, self.centre.tolist())], object)
        if len(x) and (float(np.abs(near).max()) * self.n + self.n) ** 2 * x.shape[1] < EXACT:
            return ((self.n * near - rest.astype(np.int64)) ** 2).sum(1).tolist()
        exact = ((self.n * near.astype(object) - rest) ** 2).sum(1).tolist()
        return [v if v < 2**63 else None for v in exact]


def entries(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of an array of vectors: places of those of one length without null and non-finite entries, and their integers."""
    sizes = np.where(np.array(column.is_valid()), np.diff(column.offsets.to_numpy(zero_copy_only=False)), -1)
    flat = column.values
    values, known = flat.to_numpy(zero_copy_only=False).astype(np.float64), np.array(flat.is_valid())
    good = known & np.isfinite(values)
    begin = column.offsets.to_numpy(zero_copy_only=False)[:-1]
    for size in np.unique(sizes[sizes > 0]).tolist():
        rows = np.flatnonzero(sizes == size)
        at = begin[rows][:, None] + np.arange(size)
        rows, at = rows[good[at].all(1)], at[good[at].all(1)]
        if len(rows):
            yield rows, np.floor(np.clip(SCALE * values[at], -HELD, HELD)).astype(np.int64) + SHIFT


def _added(parts: DataFrame, keys: list[str], array: str) -> DataFrame:
    """Sums of arrays by place."""
    each = parts.select(*keys, F.posexplode(array).alias("place", "value"))
    return each.groupBy(*keys, "place").agg(F.sum("value").alias("value"))


def _sums(rows: DataFrame) -> tuple[int, list[int], int]:
    """Number, sums and largest distance from ``SHIFT`` of the vectors of the most frequent length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for _, x in entries(batch.column(0)):
                size, y = x.shape[1], x - SHIFT
                n, sums, far = held.get(size, [0, [0] * size, 0])
                block = y.sum(0) if len(y) < 2**9 else y.astype(object).sum(0) if np.abs(y).max() > 2**40 else y.sum(0)
                held[size] = [n + len(y), [a + int(b) for a, b in zip(sums, block)], max(far, int(np.abs(y).max()))]
        columns = [list(held), [v[0] for v in held.values()], [v[2] for v in held.values()], [[str(s) for s in v[1]] for v in held.values()]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.string())))], names=["size", "n", "far", "sums"])

    parts = rows.mapInArrow(run, "size int, n long, far long, sums array<string>").withColumn("sums", F.col("sums").cast("array<decimal(38,0)>"))
    each = parts.select("size", "n", "far", F.posexplode("sums").alias("place", "value"))
    added = each.groupBy("size", "place").agg(F.sum("n").alias("n"), F.max("far").alias("far"), F.sum("value").alias("value"))
    best = added.where("place = 0").orderBy(F.desc("n"), F.desc("size")).limit(1).select("size").collect()
    if not best:
        return 0, [], 0
    got = sorted(added.where(F.col("size") == best[0].size).collect(), key=lambda r: r.place)  # as many rows as dimensions
    return got[0].n, [int(r.value) + SHIFT * r.n for r in got], max(r.far for r in got)


def _scatter(rows: DataFrame, white: Whitening, far: int) -> np.ndarray:
    """Sums of products of the centred entries; exact before the last division unless entries are so large that 64 bits do not hold them."""
    size, centre = len(white.sums), white.centre
    exact = (2.0 * far) ** 2 * white.n < EXACT
    low = np.tril_indices(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size), np.int64 if exact else np.float64)
        for batch in batches:
            for _, x in entries(batch.column(0)):
                for y in np.array_split(x, max(1, len(x) // BLOCK)) if x.shape[1] == size else []:
                    y = y - centre
                    if not exact:
                        total += (y - white.rest).T @ (y - white.rest)
                    elif (y.astype(np.float64) ** 2).sum() < 2.0**53:  # products are whole numbers that doubles hold, whatever their order
                        total += (y.astype(np.float64).T @ y.astype(np.float64)).astype(np.int64)
                    else:
                        total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array([total[low].tolist()])], names=["products"])

    kind = "long" if exact else "double"
    parts = rows.mapInArrow(run, f"products array<{kind}>")
    got = np.zeros(len(low[0]), object if exact else np.float64)
    for r in _added(parts.withColumn("products", F.col("products").cast("array<decimal(38,0)>")) if exact else parts, [], "products").collect():  # dimension squared, by half
        got[r.place] = int(r.value) if exact else r.value
    if exact:
        off = [s - c * white.n for s, c in zip(white.sums, centre.tolist())]
        got = np.array([(white.n * int(v) - off[i] * off[j]) / white.n for v, i, j in zip(got, *(x.tolist() for x in low))])
    out = np.zeros((size, size))
    out[low] = got
    return out + np.tril(out, -1).T


def pivoted_cholesky(a: np.ndarray) -> np.ndarray:
    """The lower factor of a positive semidefinite matrix with its rows in the matrix's order, one column a pivot; it stops where only rounding is left."""
    size, left = len(a), np.diag(a).astype(float).copy()
    floor = size * np.finfo(float).eps * max(left.max(initial=0.0), 0.0)
    out, used = np.zeros((size, size)), 0
    while used < size and left.max() > floor:
        k = int(left.argmax())
        out[:, used] = (a[:, k] - out[:, :used] @ out[k, :used]) / np.sqrt(left[k])
        out[left == -np.inf, used] = 0  # rows of earlier pivots
        left = np.where(left == -np.inf, left, left - out[:, used] ** 2)
        left[k] = -np.inf
        used += 1
    return out[:, :used]


def one_sided_jacobi(factor: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(Values, components a row) of factor x factor': columns are rotated in disjoint pairs until all are at right angles."""
    columns = factor.T.copy()
    n = len(columns)
    ring = np.arange(n + n % 2)
    for _ in range(sweeps):
        turned = False
        for _ in range(len(ring) - 1):
            i, j = ring[: len(ring) // 2], ring[len(ring) // 2 :][::-1]
            real = (i < n) & (j < n)
            i, j = i[real], j[real]
            a, b = columns[i], columns[j]
            aa, bb, ab = (a * a).sum(1), (b * b).sum(1), (a * b).sum(1)
            on = np.abs(ab) > 1e-15 * np.sqrt(aa * bb)
            if on.any():
                turned, i, j, a, b, aa, bb, ab = True, i[on], j[on], a[on], b[on], aa[on], bb[on], ab[on]
                way = (bb - aa) / (2 * ab)
                tan = np.where(way >= 0, 1.0, -1.0) / (np.abs(way) + np.hypot(1, way))
                cos = 1 / np.hypot(1, tan)
                sin = (cos * tan)[:, None]
                columns[i], columns[j] = cos[:, None] * a - sin * b, sin * a + cos[:, None] * b
            ring = np.concatenate([ring[:1], ring[-1:], ring[1:-1]])
        if not turned:
            break
    norms = np.sqrt((columns**2).sum(1))
    order = np.argsort(-norms, kind="stable")
    made = columns[order] / norms[order, None]
    return norms[order] ** 2, made * np.sign(made[np.arange(n), np.abs(made).argmax(1)])[:, None]


def fit(rows: DataFrame, vec_col: str, most: int = MOST) -> Whitening | None:
    """The whitening of a table's vectors; None without vectors. Three passes over the vectors: sums, products, and the covariance of what comes out."""
    vectors = rows.select(vec_col)
    n, sums, far = _sums(vectors)
    if not n:
        return None
    white = Whitening(n, sums, np.empty((0, len(sums))), np.empty(0), 0.0)
    scatter = _scatter(vectors, white, far)
    values, components = one_sided_jacobi(pivoted_cholesky(scatter))
    white.components, white.values, white.trace = components[:most], values[:most] / n, float(np.trace(scatter)) / n
    white.identity_error = _identity_error(vectors, white)
    return white


def _identity_error(rows: DataFrame, white: Whitening) -> float:
    """Largest entry, in size, of the covariance of the whitened rows less the identity."""
    k, size = len(white.values), len(white.sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, sums = np.zeros((k, k)), np.zeros(k)
        for batch in batches:
            for _, x in entries(batch.column(0)):
                for y in np.array_split(x, max(1, len(x) // BLOCK)) if x.shape[1] == size else []:
                    z = white.whiten(y)
                    total += z.T @ z
                    sums += z.sum(0)
        yield pa.RecordBatch.from_arrays([pa.array([[*total.ravel().tolist(), *sums.tolist()]])], names=["sums"])

    if not k:
        return 0.0
    got = np.zeros(k * k + k)
    for r in _added(rows.mapInArrow(run, "sums array<double>"), [], "sums").collect():  # components squared
        got[r.place] = r.value
    mean = got[k * k :] / white.n
    return float(np.abs(got[: k * k].reshape(k, k) / white.n - np.outer(mean, mean) - np.eye(k)).max())


def transform(rows: DataFrame, id_col: str, vec_col: str, white: Whitening | None) -> DataFrame:
    """A row for each vector that is kept and each component, numbered from 1 by falling eigenvalue."""
    kept = rows.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"))
    schema = f"`{id_col}` {kind_of(rows, id_col)}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if white is None:
        return rows.sparkSession.createDataFrame([], schema)
    k, size = len(white.values), len(white.sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in entries(batch.column(1)):
                for place, y in zip(np.array_split(at, max(1, len(at) // BLOCK)), np.array_split(x, max(1, len(x) // BLOCK))) if x.shape[1] == size else []:
                    own, m = np.repeat(place, k), len(place)
                    spread = white.deviation(y)
                    columns = [batch.column(0).take(pa.array(own)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, white.n))]
                    columns += [pa.array(spread, pa.int64()).take(pa.array(np.repeat(np.arange(m), k))), pa.array(white.whiten(y).ravel())]
                    columns += [pa.array(np.tile(white.values / white.trace if white.trace else white.values, m)), pa.array(np.full(m * k, white.identity_error))]
                    yield pa.RecordBatch.from_arrays(columns, names=[id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return kept.mapInArrow(run, schema)
