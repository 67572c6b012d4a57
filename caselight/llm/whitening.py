"""Operator 13: embeddings projected on their principal components, each scaled to variance one.

Method: QDWH spectral divide-and-conquer. The covariance is summed over all vectors in the tasks. Its
eigenvectors are found from polar decompositions: the polar factor of the covariance shifted by s has
eigenvalue 1 where the covariance has more than s and -1 where it has less, so half of its sum with
the identity projects on the subspace of the larger eigenvalues. Bases of that subspace and of the
rest split the matrix into two smaller ones, which are split likewise, until every one is a number.
Polar factors come from the dynamically weighted Halley iteration (QDWH) in its QR form. The
components are then sent to all tasks, which whiten their vectors.

Vectors are fitted as whole numbers x = floor(64 c) + 1,000,000, so their sums are exact and do not
depend on order; squares are summed after the mean is taken off. What passes through the driver is
one matrix of dimensions by dimensions, whatever the number of vectors; partial matrices of the tasks
are first added up in two rounds of grouped sums, so no task adds more than a small share of them.

Defined cases: vectors that are null, empty or hold null or non-finite numbers take no part, neither
do those of another length than the commonest (of equally common ones, the longest); numbers beyond
2^40 count as 2^40; rows without id stay, with a null id; repeated rows and ids count as often as
they stand; components whose variance is at most 1e-12 of the largest are left out, so
equal vectors alone, like an empty table, give no rows; a ``deviation`` beyond 64 bits is null; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COMPONENTS = 32
UNIT, OFFSET, LARGEST = 64.0, 1_000_000, 2.0**40
#: Partial sums are added in this many groups a row of the matrix, then those of a row.
LOTS = 64
#: Rows multiplied at once.
BLOCK = 8192
_LEAST = 1e-12
_EPS = float(np.finfo(np.float64).eps)


# --- eigenvectors -------------------------------------------------------------------------------


def polar(a: np.ndarray, steps: int = 30) -> np.ndarray:
    """The orthogonal polar factor of a square matrix by the weighted Halley iteration, in QR form."""
    n = len(a)
    x = a / np.linalg.norm(a)
    # A lower bound of the smallest singular value; too small a bound costs an iteration.
    low = _EPS / n
    for _ in range(steps):
        square = low * low
        cube = np.cbrt(4 * (1 - square) / (square * square)) if low < 1 else 0.0
        root = np.sqrt(1 + cube)
        p = root + 0.5 * np.sqrt(max(8 - 4 * cube + 8 * (2 - square) / (square * root), 0.0))
        q = (p - 1) ** 2 / 4
        r = p + q - 1
        both, _ = np.linalg.qr(np.vstack([np.sqrt(r) * x, np.eye(n)]))
        new = q / r * x + (p - q / r) / np.sqrt(r) * both[:n] @ both[n:].T
        low = min(1.0, low * (p + q * square) / (1 + r * square))
        moved = np.linalg.norm(new - x)
        x = new
        if moved <= np.sqrt(n) * np.cbrt(_EPS) and low > 1 - 10 * _EPS:
            break
    return x


def _basis(projector: np.ndarray, rank: int, rng: np.random.Generator) -> np.ndarray:
    """Orthonormal columns that span the range of a projector."""
    basis = projector @ rng.standard_normal((len(projector), rank))
    for _ in range(3):
        basis, _ = np.linalg.qr(projector @ basis)
    return basis


def _shifts(diagonal: np.ndarray) -> Iterator[float]:
    """Shifts between the least and largest eigenvalue of a matrix with this diagonal."""
    mean, low, high = float(diagonal.mean()), float(diagonal.min()), float(diagonal.max())
    middle = float(np.median(diagonal))
    if low < middle < high:
        yield middle
    yield mean
    for share in (0.31, 0.62, 0.13, 0.87):
        yield low + share * (high - low)


def spectral_split(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (as columns) of a symmetric matrix."""
    rng = np.random.default_rng(13)
    scale = np.linalg.norm(matrix)
    done: list[tuple[float, np.ndarray]] = []
    open_parts = [(matrix, np.eye(len(matrix)))]
    while open_parts:
        a, space = open_parts.pop()
        n = len(a)
        flat = n == 1 or np.linalg.norm(a - np.eye(n) * np.trace(a) / n) <= 4 * _EPS * scale
        parts = None if flat else _halves(a, scale, rng)
        if parts is None:  # equal eigenvalues to double precision: any basis will do
            done += [(float(v @ matrix @ v), v) for v in space.T]
            continue
        for part in parts:
            inner = part.T @ a @ part
            open_parts.append(((inner + inner.T) / 2, space @ part))
    done.sort(key=lambda found: -found[0])
    return np.array([e for e, _ in done]), np.array([v for _, v in done]).T


def _halves(a: np.ndarray, scale: float, rng: np.random.Generator):
    """Bases of two invariant subspaces, of larger and smaller eigenvalues; None if there are none."""
    n, best = len(a), None
    for shift in _shifts(np.diag(a)):
        sign = polar(a - shift * np.eye(n))
        upper = (np.eye(n) + (sign + sign.T) / 2) / 2
        rank = int(round(np.trace(upper)))
        if not 0 < rank < n:
            continue
        parts = _basis(upper, rank, rng), _basis(np.eye(n) - upper, n - rank, rng)
        # Zero but for rounding if the shift was no eigenvalue.
        mixed = np.linalg.norm(parts[0].T @ a @ parts[1]) + scale * np.linalg.norm(parts[0].T @ parts[1])
        if best is None or mixed < best[0]:
            best = mixed, parts
        if mixed <= 50 * n * _EPS * scale:
            break
    return best and best[1]


# --- sums over all vectors ----------------------------------------------------------------------


@dataclass(frozen=True)
class Fit:
    n: int
    sums: tuple[int, ...]
    #: Falling eigenvalues above the least share, and the trace of the covariance.
    variances: np.ndarray
    trace: float
    #: Unit eigenvectors as columns.
    directions: np.ndarray


def whole_numbers(vectors: list) -> np.ndarray:
    values = np.clip(np.array(vectors, np.float64) * UNIT, -LARGEST, LARGEST)
    return np.floor(values).astype(np.int64) + OFFSET


def _matrices(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            some = batch.slice(at, BLOCK)
            flat = some.column("vector").flatten().to_numpy(zero_copy_only=False)
            yield some, whole_numbers(flat.reshape(-1, dims))


def fitted(vectors: DataFrame) -> DataFrame:
    """vec_id and vector of the rows that take part."""
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector")
    )
    unusable = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | F.abs(x).isin(float("inf")))
    rows = rows.filter((F.size("vector") > 0) & ~unusable)
    length = rows.groupBy(F.size("vector").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    return rows.filter(F.size("vector") == (length.dims if length else 0))


def _grouped(parts: DataFrame) -> DataFrame:
    """Partial rows (row, lot, n, sums) added up by row, in two rounds."""

    def added(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        matrix = np.stack([s.values.to_numpy() for s in table.column("sums")])
        n = sum(table.column("n").to_pylist())
        total = pa.array([matrix.sum(axis=0)], table.schema.field("sums").type)
        return pa.table([table.column("row")[:1], table.column("lot")[:1], pa.array([n]), total], schema=table.schema)

    by_lot = parts.groupBy("row", "lot").applyInArrow(added, parts.schema)
    return by_lot.groupBy("row").applyInArrow(added, parts.schema)


def _summed(rows: DataFrame, dims: int, kind: str, partial) -> tuple[int, np.ndarray]:
    """n and the summed matrix of what ``partial`` yields from the vectors of a task."""
    arrow = pa.int64() if kind == "long" else pa.float64()
    layout = pa.schema([("row", pa.int32()), ("lot", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(arrow))])

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        count, total = 0, None
        for _, x in _matrices(batches, dims):
            count, total = count + len(x), partial(x) + (0 if total is None else total)
        if total is not None:
            lot = TaskContext.get().partitionId() % LOTS
            n = len(total)
            yield pa.RecordBatch.from_pydict(
                {"row": range(n), "lot": [lot] * n, "n": [count] * n, "sums": list(total)}, layout
            )

    parts = rows.mapInArrow(of_task, f"row int, lot int, n long, sums array<{kind}>")
    found = sorted(_grouped(parts).collect(), key=lambda r: r["row"])
    return (found[0]["n"] if found else 0), np.array([r["sums"] for r in found])


def fit(rows: DataFrame) -> Fit | None:
    """Sums, variances and directions over all of ``fitted``'s rows; None without rows."""
    first = rows.first()
    if first is None:
        return None
    dims = len(first["vector"])
    n, sums = _summed(rows, dims, "long", lambda x: x.sum(axis=0)[None])
    totals = tuple(int(s) for s in sums[0])
    mean = _mean(totals, n)

    def squares(x: np.ndarray) -> np.ndarray:
        centred = x - mean
        return centred.T @ centred

    covariance = _summed(rows, dims, "double", squares)[1] / n
    covariance = (covariance + covariance.T) / 2
    trace = float(np.trace(covariance))
    variances, directions = spectral_split(covariance) if trace > 0 else (np.zeros(0), np.zeros((dims, 0)))
    kept = variances > _LEAST * variances.max(initial=0.0)
    return Fit(n, totals, variances[kept], trace, directions[:, kept])


def _mean(totals: tuple[int, ...], n: int) -> np.ndarray:
    # The whole part is taken off first, so that no digits are lost in large sums.
    return np.array([s // n + (s % n) / n for s in totals])


def _projector(model: Fit, components: int):
    mean, k = _mean(model.sums, model.n), min(components, len(model.variances))
    scaled = model.directions[:, :k] / np.sqrt(model.variances[:k])
    return lambda x: (x - mean) @ scaled


def identity_error(rows: DataFrame, model: Fit, components: int = COMPONENTS) -> float | None:
    """Largest entry, in absolute value, of the whitened vectors' covariance minus the identity."""
    whiten, dims = _projector(model, components), len(model.sums)
    k = min(components, len(model.variances))
    if k == 0:
        return None
    means = _summed(rows, dims, "double", lambda x: whiten(x).sum(axis=0)[None])[1][0] / model.n

    def squares(x: np.ndarray) -> np.ndarray:
        y = whiten(x) - means
        return y.T @ y

    covariance = _summed(rows, dims, "double", squares)[1] / model.n
    return float(np.abs(covariance - np.eye(k)).max())


def deviations(x: np.ndarray, model: Fit) -> list[int | None]:
    """Exact sums over the dimensions of (n x - sum)^2; None beyond 64 bits."""
    sums = np.array(model.sums, np.float64)
    rough = model.n * np.abs(x).max(axis=1, initial=0).astype(np.float64) + np.abs(sums).max()
    if len(x) and rough.max() ** 2 * x.shape[1] < 2.0**62:
        return ((model.n * x - np.array(model.sums, np.int64)) ** 2).sum(axis=1).tolist()
    exact = [sum((model.n * v - s) ** 2 for v, s in zip(row, model.sums)) for row in x.tolist()]
    return [e if e < 1 << 63 else None for e in exact]


def whiten(rows: DataFrame, model: Fit, components: int = COMPONENTS) -> DataFrame:
    """vec_id, deviation and whitened (an array, falling variance) of ``fitted``'s rows."""
    project, dims = _projector(model, components), len(model.sums)

    def whitened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, x in _matrices(batches, dims):
            yield pa.RecordBatch.from_arrays(
                [
                    some.column("vec_id"),
                    pa.array(deviations(x, model), pa.int64()),
                    pa.array(list(project(x)), pa.list_(pa.float64())),
                ],
                ["vec_id", "deviation", "whitened"],
            )

    return rows.mapInArrow(whitened, "vec_id long, deviation long, whitened array<double>")


_LAYOUT = (
    "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
)


def report(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """One row per vector and component: its whitened value, and what the component explains."""
    rows = fitted(vectors)
    model = fit(rows)
    if model is None or not len(model.variances):
        return vectors.sparkSession.createDataFrame([], _LAYOUT)
    error = identity_error(rows, model, components)
    shares = F.array(*[F.lit(float(e / model.trace)) for e in model.variances[:components]])
    return (
        whiten(rows, model, components)
        .select("vec_id", "deviation", F.posexplode("whitened").alias("i", "whitened"))
        .select(
            "vec_id",
            (F.col("i") + 1).alias("component"),
            F.lit(model.n).cast("long").alias("n"),
            "deviation",
            "whitened",
            F.get(shares, F.col("i")).alias("explained"),
            F.lit(error).alias("identity_error"),
        )
    )
