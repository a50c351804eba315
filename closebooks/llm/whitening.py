"""Embedding whitening by QDWH spectral divide-and-conquer.

Two passes over the rows give the sums and then, centred, the covariance V: a matrix of the
width of the vectors, whatever their number. On the driver, a polar decomposition of
V - shift * I by the QDWH iteration gives the matrix sign, and with it the projector on the
eigenvalues above the shift; a basis of its range and one of the rest split V in two, and each
part is split again until single components are left. The components are broadcast and every
row is projected on them.

Entries are floor(scale * c) + offset as long. Defined cases: a null vector and one with a null
or non-finite entry are dropped; a null id stays; shorter vectors count as ended by zeros, an
empty one as zeros alone; repeated rows count each; components whose eigenvalue is not above
RANK times the greatest have no unit variance and are left out, so equal rows, one row and an
empty table give an empty result; an entry beyond long is an error; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from closebooks.llm.common import stored

ROWS = 4096  # that a task multiplies at a time
RANK = 1e-12
EPS = float(np.finfo(float).eps)
LONG = 2**63

SCHEMA = ("vec_id long, component int, n long, deviation decimal(38,0), whitened double, "
          "explained double, identity_error double")


def prepared(vectors: DataFrame, scale: float = 1024.0, offset: int = 100_000) -> DataFrame:
    """The rows that take part: vec_id and whole entries x."""
    def whole(c: Column) -> Column:
        return F.floor(F.lit(scale) * c.cast("double")) + F.lit(offset).cast("long")

    good = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c)
                    & (F.abs(c) < F.lit(float("inf"))))
    return vectors.where(good).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", whole).alias("x"))


def _matrix(column: pa.Array, width: int, fill: int) -> np.ndarray:
    """Vectors as rows of whole numbers, filled up to the width."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if (lengths == width).all():
        return flat.reshape(-1, width)
    out = np.full((len(lengths), width), fill, np.int64)
    out[np.arange(width)[None, :] < lengths[:, None]] = flat
    return out


def _chunks(batches: Iterator[pa.RecordBatch], at: int, width: int, fill: int):
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            part = batch.slice(start, ROWS)
            yield part, _matrix(part.column(at), width, fill)


def _sums(rows: DataFrame, width: int, fill: int) -> list[int]:
    """Exact sum of every entry."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * width
        for _, x in _chunks(batches, 0, width, fill):
            part = x.sum(axis=0) if len(x) * np.abs(x).max(initial=0) < LONG else [
                sum(map(int, column)) for column in x.T]
            total = [a + int(b) for a, b in zip(total, part, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(width), pa.int32()),
             pa.array(map(Decimal, total), pa.decimal128(38, 0))], names=["i", "s"])

    found = rows.select("x").mapInArrow(run, "i int, s decimal(38,0)").groupBy("i").agg(
        F.sum("s").cast("decimal(38,0)").alias("s")).collect()
    sums = [0] * width
    for r in found:
        sums[r["i"]] = int(r["s"])
    return sums


def _second_moments(rows: DataFrame, width: int, fill: int, mean: np.ndarray,
                    project: np.ndarray | None = None) -> np.ndarray:
    """Sum over the rows of the outer products of centred (and projected) vectors.

    What is collected has one row per pair of dimensions.
    """
    size = width if project is None else project.shape[1]
    left, right = np.triu_indices(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for _, x in _chunks(batches, 0, width, fill):
            y = x - mean
            if project is not None:
                y = y @ project
            total += y.T @ y
        yield pa.RecordBatch.from_arrays(
            [pa.array(left, pa.int32()), pa.array(right, pa.int32()), pa.array(total[left, right])],
            names=["i", "j", "m"])

    found = rows.select("x").mapInArrow(run, "i int, j int, m double").groupBy("i", "j").agg(
        F.sum("m").alias("m")).collect()
    out = np.zeros((size, size))
    for r in found:
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["m"]
    return out


def polar_factor(a: np.ndarray) -> np.ndarray:
    """The orthogonal factor of a symmetric matrix, by QR-based dynamically weighted Halley steps.

    `low` bounds the smallest singular value from below; it starts at the rounding level, from
    which the weights bring every singular value to 1 in six or seven steps.
    """
    n = len(a)
    x = a / np.linalg.norm(a)
    low = EPS
    for _ in range(12):
        square = low * low
        d = (4 * (1 - square) / (square * square)) ** (1 / 3) if square < 1 else 0.0
        root = np.sqrt(1 + d)
        wa = root + np.sqrt(max(8 - 4 * d + 8 * (2 - square) / (square * root), 0.0)) / 2
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        q, _ = np.linalg.qr(np.vstack([np.sqrt(wc) * x, np.eye(n)]))
        new = (wb / wc) * x + ((wa - wb / wc) / np.sqrt(wc)) * (q[:n] @ q[n:].T)
        new = (new + new.T) / 2
        moved, x = np.linalg.norm(new - x), new
        low = min(low * (wa + wb * square) / (1 + wc * square), 1.0)
        if moved <= (4 * EPS) ** (1 / 3) and 1 - low <= 10 * EPS:
            break
    return x


def _split(a: np.ndarray, shift: float) -> tuple[float, np.ndarray, int] | None:
    """(what couples the parts, orthogonal basis, size of the upper part), if both have some."""
    n = len(a)
    projector = (polar_factor(a - shift * np.eye(n)) + np.eye(n)) / 2
    k = round(float(np.trace(projector)))
    if not 0 < k < n:
        return None
    basis = np.linalg.qr(projector @ np.random.default_rng(n).standard_normal((n, k)))[0]
    basis = np.linalg.qr(projector @ basis, mode="complete")[0]
    return float(np.linalg.norm(basis[:, k:].T @ a @ basis[:, :k])), basis, k


def eigen_components(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns, of a symmetric matrix."""
    v = (v + v.T) / 2
    scale = float(np.linalg.norm(v))
    done: list[np.ndarray] = []
    open_parts = [np.eye(len(v))] if len(v) else []
    while open_parts:
        basis = open_parts.pop()
        a = basis.T @ v @ basis
        a = (a + a.T) / 2
        diagonal = np.diag(a)
        middle = float(diagonal.mean())
        spread = float(np.linalg.norm(a - middle * np.eye(len(a))))
        if len(a) == 1 or spread <= 4 * EPS * scale:
            done.append(basis)  # one eigenvalue, as far as doubles tell: any basis will do
            continue
        # The mean lies between two eigenvalues; the median halves the work; the rest are for
        # shifts that fall on an eigenvalue.
        steps = spread / len(a) * np.array([0.1, -0.1, 0.37, -0.37, 0.05, -0.05])
        best = None
        for shift in (float(np.median(diagonal)), middle, *(middle + steps)):
            found = _split(a, shift)
            if found and (best is None or found[0] < best[0]):
                best = found
                if best[0] <= 16 * EPS * scale:
                    break
        if best is None:
            done.append(basis)
            continue
        _, turn, k = best
        open_parts += [basis @ turn[:, :k], basis @ turn[:, k:]]
    vectors = np.hstack(done) if done else np.zeros((0, 0))
    vectors /= np.linalg.norm(vectors, axis=0)
    values = np.einsum("ij,ij->j", vectors, v @ vectors)
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> pa.Array:
    """Exact sum over the entries of (n * x - sum)^2."""
    far = max((abs(n * int(value) - s) for column, s in zip(x.T, sums, strict=True)
               for value in (column.min(), column.max())), default=0)
    if len(sums) * far * far < LONG and n * int(np.abs(x).max(initial=0)) < LONG:
        gap = n * x - np.array(sums, np.int64)
        return pa.array((gap * gap).sum(axis=1)).cast(pa.decimal128(38, 0))
    gap = n * x.astype(object) - np.array(sums, object)
    return pa.array(map(Decimal, (gap * gap).sum(axis=1)), pa.decimal128(38, 0))


def _project(batches: Iterator[pa.RecordBatch], width: int, fill: int, n: int, sums: list[int],
             mean: np.ndarray, project: np.ndarray, explained: np.ndarray,
             error: float) -> Iterator[pa.RecordBatch]:
    kept = project.shape[1]
    for part, x in _chunks(batches, 1, width, fill):
        rows = len(x)
        row = np.repeat(np.arange(rows), kept)
        yield pa.RecordBatch.from_arrays(
            [part.column(0).take(pa.array(row)),
             pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), rows)),
             pa.array(np.full(len(row), n, np.int64)),
             _deviations(x, n, sums).take(pa.array(row)),
             pa.array(((x - mean) @ project).ravel()), pa.array(np.tile(explained, rows)),
             pa.array(np.full(len(row), error))],
            names=[c.split(" ")[0] for c in SCHEMA.split(", ")])


def whitened(vectors: DataFrame, keep: int = 8, scale: float = 1024.0,
             offset: int = 100_000) -> DataFrame:
    """Every row's whitened value on each of the first `keep` components.

    `explained` is the component's share of the trace, `identity_error` the largest absolute
    entry of the whitened values' covariance minus the identity, from a pass over the rows.
    """
    spark = vectors.sparkSession
    rows = stored(prepared(vectors, scale, offset), "whitening-rows")
    n, width = rows.agg(F.count(F.lit(1)), F.max(F.size("x"))).head()
    if not n or not width:
        return spark.createDataFrame([], SCHEMA)
    sums = _sums(rows, width, offset)
    mean = np.array([s / n for s in sums])
    covariance = _second_moments(rows, width, offset, mean) / n
    values, components = eigen_components(covariance)
    kept = [i for i in range(min(keep, width)) if values[i] > RANK * values[0]]
    if not kept:
        return spark.createDataFrame([], SCHEMA)
    project = components[:, kept] / np.sqrt(values[kept])
    explained = values[kept] / np.trace(covariance)
    check = _second_moments(rows, width, offset, mean, project) / n - np.eye(len(kept))
    error = float(np.abs(check).max())
    # Sent to every task: width by `keep` numbers, whatever the number of rows.
    sent = spark.sparkContext.broadcast((mean, project, explained))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _project(batches, width, offset, n, sums, *sent.value, error)

    return rows.mapInArrow(run, SCHEMA)
