"""Embedding whitening: float32 eigenvectors of the distributed covariance, refined in float64.

Vectors become whole numbers, so sums and deviations are exact. The covariance is summed in tasks from
centred vectors; only matrices of the vector's length, which no number of rows enlarges, meet in the
driver. There the eigenvectors are found in float32 and corrected by Ogita and Aishima's
matrix-multiplication steps in float64; eigenvalues too close to be told apart by a step are parted by a
small problem of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructType

SCALE, OFFSET = 1024.0, 100_000
COMPONENTS = 8
WIDEST = 2.0**61  # larger entries count as this
LOW = 31  # bits of the lower half of an exact sum
STEPS = 30
MERGED = 32  # rows of partial moments that reach the driver


class Fit(NamedTuple):
    """What whitening needs: rows, exact sums, leading unit eigenvectors, their eigenvalues, the trace."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float


def whole_numbers(column: pa.Array, width: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows that count, their vectors as whole numbers, and the length of each.

    Vectors shorter than ``width`` (or the longest here) are filled up as if with zeros.
    """
    lengths = np.where(column.is_valid().to_numpy(zero_copy_only=False), column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), -1)
    entries = column.flatten()
    values = entries.fill_null(np.nan).to_numpy(zero_copy_only=False).astype(np.float64)
    of_row = np.repeat(np.arange(len(lengths)), np.maximum(lengths, 0))
    bad = np.bincount(of_row[~np.isfinite(values)], minlength=len(lengths)) > 0
    keep = np.flatnonzero((lengths >= 0) & ~bad)
    sizes = lengths[keep]
    width = int(sizes.max(initial=0)) if width is None else width
    with np.errstate(over="ignore"):
        x = np.clip(np.floor(SCALE * values[~bad[of_row]]), -WIDEST, WIDEST).astype(np.int64) + OFFSET
    if (sizes == width).all():
        return keep, x.reshape(len(keep), width), sizes
    out = np.full((len(keep), width), OFFSET, np.int64)
    out[np.arange(width) < sizes[:, None]] = x
    return keep, out, sizes


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per dimension of a task: vectors that reach it, upper and lower halves of their sum. Dimension -1 counts vectors."""
    n, present, high, low = 0, *(np.zeros(0, np.int64) for _ in range(3))
    for batch in batches:
        _, x, sizes = whole_numbers(batch.column(0))
        grow = max(0, x.shape[1] - len(high))
        present, high, low = (np.pad(a, (0, grow)) for a in (present, high, low))
        inside = np.arange(x.shape[1]) < sizes[:, None]
        n += len(x)
        present[: x.shape[1]] += inside.sum(axis=0)
        high[: x.shape[1]] += np.where(inside, x >> LOW, 0).sum(axis=0)
        low[: x.shape[1]] += np.where(inside, x & ((1 << LOW) - 1), 0).sum(axis=0)
    rows = [np.arange(-1, len(high)), *(np.concatenate([[first], a]) for first, a in ((n, present), (0, high), (0, low)))]
    yield pa.RecordBatch.from_arrays([pa.array(r.astype(np.int64)) for r in rows], names=["dim", "present", "high", "low"])


def exact_sums(vectors: DataFrame) -> tuple[int, list[int]]:
    """Number of vectors that count and their sum in every dimension, without rounding."""
    rows = (
        vectors.mapInArrow(_sums, "dim long, present long, high long, low long")
        .groupBy("dim")
        .agg(*(F.sum(c).alias(c) for c in ("present", "high", "low")))
        .collect()
    )
    of = {r.dim: r for r in rows}
    n = of[-1].present if -1 in of else 0
    return n, [(of[i].high << LOW) + of[i].low + (n - of[i].present) * OFFSET for i in range(len(of) - 1)]


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S / n, rounded once: the whole part is taken off before the rest."""
    base = np.array([s // n for s in sums], np.int64)
    rest = np.array([(s % n) / n for s in sums])
    return (x - base).astype(np.float64) - rest


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """Sum over dimensions of (n * x - S)^2 of each vector, exact at any size."""
    base, rest = [s // n for s in sums], [s % n for s in sums]
    x = x - np.array(base, np.int64)
    most = n * (int(np.abs(x).max(initial=0)) + 1)
    if most * most * max(1, x.shape[1]) < 2**62:
        d = n * x - np.array(rest, np.int64)
        return (d * d).sum(axis=1).tolist()
    return [sum((n * v - r) ** 2 for v, r in zip(row, rest)) for row in x.tolist()]


def covariance(vectors: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """Covariance with divisor n. Tasks sum products of centred vectors, then rows of the matrix are summed apart."""
    width = len(sums)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            y = centred(whole_numbers(batch.column(0), width)[1], n, sums)
            total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(list(total), pa.list_(pa.float64()))], names=["dim", "row"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {}
        for batch in batches:
            for i, row in zip(batch.column(0).to_pylist(), batch.column(1)):
                row = row.values.to_numpy()
                total[i] = total[i] + row if i in total else row
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.list_(pa.float64()))], names=["dim", "row"])

    shape = "dim long, row array<double>"
    rows = vectors.mapInArrow(products, shape).repartition("dim").mapInArrow(added, shape).collect()
    v = np.array([r.row for r in sorted(rows, key=lambda r: r.dim)]) / n
    return (v + v.T) / 2


def _clusters(values: np.ndarray, gap: float) -> list[slice]:
    """Runs of falling eigenvalues with no gap wider than ``gap`` between neighbours, of two values at least."""
    limits = np.concatenate([[0], np.flatnonzero(-np.diff(values) > gap) + 1, [len(values)]])
    return [slice(a, b) for a, b in zip(limits[:-1], limits[1:]) if b - a > 1]


def refine(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """One step of the refinement: better eigenvectors, eigenvalues, and the gap below which it told none apart."""
    r = np.eye(len(a)) - x.T @ x
    s = x.T @ a @ x
    r, s = (r + r.T) / 2, (s + s.T) / 2  # else rounding that differs across the diagonal bends the angles
    values = np.diag(s) / (1 - np.diag(r))
    gap = 2 * (np.linalg.norm(s - np.diag(values)) + np.linalg.norm(a) * np.linalg.norm(r))
    apart = values[None, :] - values[:, None]
    rest = s + values[None, :] * r
    noise = 8 * np.finfo(float).eps * np.linalg.norm(a)  # a residual like this says nothing of the angle
    far = (np.abs(apart) > gap) & (np.maximum(np.abs(rest), np.abs(rest.T)) > noise)
    e = np.where(far, rest / np.where(far, apart, 1), r / 2)
    return x + x @ e, values, gap


def eigen(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a symmetric matrix, falling, and unit eigenvectors in columns, to double precision.

    Starts from float32 eigenvectors. After each step, vectors whose eigenvalues the step could not part
    are turned within their own space by the eigenvectors of the shifted small matrix there.
    """
    size = np.abs(v).max(initial=0.0)
    if size == 0:
        return np.zeros(len(v)), np.eye(len(v))
    a = v / size
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(np.float64)[:, ::-1]
    best = np.inf
    for _ in range(STEPS):
        before = x
        x, values, gap = refine(a, x)
        order = np.argsort(-values, kind="stable")
        x, values = x[:, order], values[order]
        moved = np.abs(x - before[:, order]).max()
        for c in _clusters(values, gap):
            part = x[:, c]
            small = part.T @ (a @ part - values[c].mean() * part)
            small = (small + small.T) / 2
            if np.abs(small).max() > 4 * np.finfo(float).eps:  # else the space has no directions of its own
                x[:, c] = part @ np.linalg.eigh(small)[1][:, ::-1]
        # a last step after which nothing moves any nearer
        if moved < 1e-15 or (moved < 1e-12 and moved >= best):
            break
        best = min(best, moved)
    values = np.einsum("ij,ij->j", x, a @ x) / np.einsum("ij,ij->j", x, x)
    order = np.argsort(-values, kind="stable")
    return values[order] * size, x[:, order] / np.linalg.norm(x[:, order], axis=0)


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Fit:
    """Sums, covariance and leading eigenvectors of a one-column frame of vectors (array of double).

    Components whose eigenvalue is nought within rounding are left out; no vectors give no components.
    """
    n, sums = exact_sums(vectors)
    if not n or not sums:
        return Fit(n, sums, np.zeros((len(sums), 0)), np.zeros(0), 0.0)
    v = covariance(vectors, n, sums)
    values, x = eigen(v)
    rank = int((values > len(sums) * np.finfo(float).eps * max(values[0], 0.0)).sum()) if values[0] > 0 else 0
    k = min(components, rank)
    return Fit(n, sums, np.ascontiguousarray(x[:, :k]), values[:k], float(np.trace(v)))


def whitened(x: np.ndarray, model: Fit) -> np.ndarray:
    return centred(x, model.n, model.sums) @ model.vectors / np.sqrt(model.values)


def identity_error(vectors: DataFrame, model: Fit) -> float:
    """Largest entry of the covariance of all whitened vectors less the identity, measured on the rows.

    Tasks keep count, mean and centred products, and join them by the pairwise update, which never
    multiplies anything that is not centred.
    """
    k, width = len(model.values), len(model.sums)

    def joined(a, b):
        n = a[0] + b[0]
        if not n:
            return a
        step = b[1] - a[1]
        return n, a[1] + step * (b[0] / n), a[2] + b[2] + np.outer(step, step) * (a[0] * b[0] / n)

    def row(state, part: int) -> pa.RecordBatch:
        values = np.concatenate([[state[0]], state[1], state[2].ravel()])
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([values], pa.list_(pa.float64()))], names=["part", "state"])

    start = (0, np.zeros(k), np.zeros((k, k)))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        state = start
        for batch in batches:
            w = whitened(whole_numbers(batch.column(0), width)[1], model)
            if len(w):
                mean = w.mean(axis=0)
                state = joined(state, (len(w), mean, (w - mean).T @ (w - mean)))
        yield row(state, TaskContext.get().partitionId() % MERGED)

    def states(values) -> tuple:
        values = np.asarray(values)
        return values[0], values[1 : k + 1], values[k + 1 :].reshape(k, k)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = start
        for batch in batches:
            for r in batch.column(1):
                state = joined(state, states(r.values.to_numpy()))
        yield row(state, 0)

    shape = "part int, state array<double>"
    state = start
    for r in vectors.mapInArrow(measured, shape).repartition(MERGED, "part").mapInArrow(merged, shape).collect():
        state = joined(state, states(r.state))
    return float(np.abs(state[2] / state[0] - np.eye(k)).max()) if k and state[0] else 0.0


def whiten(embeddings: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Per vector and component: id, ``component`` (from 1, by falling eigenvalue), ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``, ``deviation_text``.

    Rows whose vector is null or holds a null, a NaN or an infinity are dropped; all others are both
    fitted and whitened, repeated rows and null ids included. Shorter vectors count as filled up with
    zeros; entries beyond 2^51 in size count as that. ``deviation`` is null where it exceeds a long,
    ``deviation_text`` has its digits at any size. Components of no variance (one row, equal rows, fewer
    rows than dimensions) give no rows; an empty table gives none. No other column is read.
    """
    vectors = embeddings.select(F.col(vector).cast("array<double>").alias("vector"))
    model = fit(vectors, components)
    error, k, width = identity_error(vectors, model), len(model.values), len(model.sums)
    explained = model.values / model.trace if model.trace > 0 else model.values
    schema = StructType([embeddings.schema[vec_id]]).add("component", IntegerType()).add("n", LongType()).add("deviation", LongType())
    schema = schema.add("whitened", DoubleType()).add("explained", DoubleType()).add("identity_error", DoubleType()).add("deviation_text", StringType())

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, x, _ = whole_numbers(batch.column(1), width)
            rows = len(keep)
            deviation = deviations(x, model.n, model.sums)
            fits = [d if d < 2**63 else None for d in deviation]
            each = np.repeat(np.arange(rows), k)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(keep[each])),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                    pa.array(np.full(rows * k, model.n, np.int64)),
                    pa.array(fits, pa.int64()).take(pa.array(each)),
                    pa.array(whitened(x, model).ravel()),
                    pa.array(np.tile(explained, rows)),
                    pa.array(np.full(rows * k, error)),
                    pa.array(list(map(str, deviation)), pa.string()).take(pa.array(each)),
                ],
                names=schema.names,
            )

    chosen = embeddings.select(vec_id, F.col(vector).cast("array<double>").alias("vector"))
    return (chosen if k else chosen.limit(0)).mapInArrow(projected, schema)
