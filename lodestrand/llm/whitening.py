"""Embedding whitening: an exact covariance by polarisation, its leading eigenvectors, and every vector projected on them."""

from __future__ import annotations

import math
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import one, require, tidy, written

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 16
#: Scaled entries are held within this, so that all integers here stay exact.
MOST = 1 << 40
#: Directions whose variance is below this share of the largest hold rounding alone.
LEAST_SHARE = 1e-12
#: Rows that one block of numpy works on.
BLOCK = 2048


def scaled(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, y): floor(64 c) of every entry of usable vectors; the shift of all entries by one number changes nothing below."""
    entry = F.col(vec_col)
    usable = entry.isNotNull() & F.forall(entry, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf"))) & (F.size(entry) > 0)
    whole = lambda c: F.floor(F.least(F.greatest(F.lit(float(SCALE)) * c.cast("double"), F.lit(-float(MOST))), F.lit(float(MOST)))).cast("long")
    return vectors.where(usable).select(F.col(id_col).alias("id"), F.transform(entry, whole).alias("y"))


def _blocks(batches, column: int, size: int):
    """Matrices of the vectors of ``batches``, ``BLOCK`` rows each, with their batch and first row."""
    for batch in batches:
        lists = one(batch.column(column))
        flat = lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
        for i in range(0, len(flat), BLOCK):
            yield batch, i, flat[i : i + BLOCK]


def _as_rows(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
    i, j, q = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array([Decimal(x) for x in q], pa.decimal128(38, 0))], names=["i", "j", "q"])


def _sums(batches, size: int):
    """For every dimension its sum, and at (-1, -1) the number of rows; at (-2, d) the largest size of an entry."""
    total, n, top = [0] * size, 0, 0
    for _, _, y in _blocks(batches, 0, size):
        total = [a + b for a, b in zip(total, y.sum(axis=0).tolist(), strict=True)]
        n, top = n + len(y), max(top, int(np.abs(y).max()))
    if n:
        yield _as_rows([(-1, -1, n), (-2, -2, top), *((k, k, s) for k, s in enumerate(total))])


def square_sums(w: np.ndarray, top: int) -> list[int]:
    """Exact sums of the squares of each column of ``w``, whose entries are ``top`` at most.

    One pass where no sum can leave 63 bits, else two halves of 24 bits and the rest; beyond 2^47 Python's integers.
    """
    if top * top * max(1, len(w)) < 1 << 62:
        return np.einsum("rc,rc->c", w, w).tolist()
    if top < 1 << 47:
        high, low = w >> 24, w & ((1 << 24) - 1)
        parts = (np.einsum("rc,rc->c", a, b).tolist() for a, b in ((high, high), (high, low), (low, low)))
        return [(a << 48) + (b << 25) + c for a, b, c in zip(*parts, strict=True)]
    return [sum(x * x for x in column) for column in w.T.astype(object).tolist()]


def centred(y: np.ndarray, n: int, sums: list[int], wide: bool) -> np.ndarray:
    """n y - S, exact."""
    if wide:
        return y.astype(object) * n - np.array(sums, dtype=object)
    return y * np.int64(n) - np.array(sums, np.int64)


def _squares(batches, n: int, sums: list[int], top: int):
    """Sums of squares of every centred dimension (i, i) and of every sum of two (i, j), i < j."""
    size, most = len(sums), 4 * n * top
    wide, found = most >= 1 << 62, {}
    for _, _, y in _blocks(batches, 0, size):
        z = centred(y, n, sums, wide)
        for i in range(size):
            w = z[:, i:] + z[:, i : i + 1]
            w[:, 0] = z[:, i]
            for j, q in enumerate(square_sums(w, most), i):
                found[i, j] = found.get((i, j), 0) + int(q)
    yield _as_rows([(i, j, q) for (i, j), q in found.items()])


def covariance(squares: dict[tuple[int, int], int], n: int, size: int) -> np.ndarray:
    """Covariances from sums of squares: half of what the square of a sum has more than the two squares, over n cubed."""
    out = np.zeros((size, size))
    for (i, j), q in squares.items():
        out[i, j] = out[j, i] = q / n**3 if i == j else (q - squares[i, i] - squares[j, j]) / (2 * n**3)
    return out


def axes(cov: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues that fall, and unit eigenvectors as columns, the largest entry of each positive."""
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values, kind="stable")[:most]
    values, vectors = values[order], vectors[:, order]
    keep = values > LEAST_SHARE * max(values[:1].tolist() + [0.0])
    values, vectors = values[keep], vectors[:, keep]
    sign = np.sign(vectors[np.argmax(np.abs(vectors), axis=0), np.arange(len(values))])
    return values, vectors * sign


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): every usable vector on the leading axes of variance.

    The axes are fitted on each distinct scaled vector once, so copies weigh nothing, however many there are. Four passes
    over the vectors: distinct ones; their number and sums; sums of squares of all centred dimensions and of all sums of
    two of them; the covariance of what comes out. What reaches the driver are such sums, one for each pair of dimensions.
    Partial sums of tasks are exact decimals and meet in a shuffle.

    Left out: null vectors, empty ones, those with a null or non-finite entry, and those of another length than most
    (of lengths equally frequent the greater counts). Entries beyond 2^40 / 64 count as that. Repeated ids are rows of
    their own; a deviation beyond 63 bits is null. Axes without variance are left out: an empty table, or one with a
    single distinct vector, gives no rows. Other columns are ignored. A vector is one value of a row: work on very long
    ones grows with the square of their length.
    """
    require(vectors, id_col, vec_col)
    spark, kind = vectors.sparkSession, vectors.schema[id_col].dataType
    out = T.StructType([T.StructField("id", kind), T.StructField("component", T.IntegerType()), *(T.StructField(c, T.LongType()) for c in ("n", "deviation")), *(T.StructField(c, T.DoubleType()) for c in ("whitened", "explained", "identity_error"))])
    rows = scaled(vectors, id_col, vec_col)
    sizes = rows.groupBy(F.size("y").alias("size")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), F.desc("size")).first()
    if sizes is None:
        return spark.createDataFrame([], out)
    size = sizes["size"]
    rows = rows.where(F.size("y") == size)
    fit = written(rows.select("y").distinct(), "fit")

    def gather(run) -> dict[tuple[int, int], int]:
        parts = fit.mapInArrow(tidy(run), "i int, j int, q decimal(38,0)")
        found = parts.groupBy("i", "j").agg(F.sum("q").alias("q"), F.max("q").alias("top")).collect()
        return {(r["i"], r["j"]): int(r["top"] if r["i"] == -2 else r["q"]) for r in found}

    first = gather(lambda batches: _sums(batches, size))
    n, top, sums = first[-1, -1], first[-2, -2], [first[k, k] for k in range(size)]
    values, vecs = axes(cov := covariance(gather(lambda batches: _squares(batches, n, sums, top)), n, size), components)
    if not len(values):
        return spark.createDataFrame([], out)
    wide, project = 4 * n * top >= 1 << 62, vecs / np.sqrt(values)
    k, trace = len(values), math.fsum(np.diag(cov).tolist())

    def coordinates(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z = centred(y, n, sums, wide)
        return z, (z / n).astype(float) @ project

    def moments(batches):
        total, mean, seen = np.zeros((k, k)), np.zeros(k), 0
        for _, _, y in _blocks(batches, 0, size):
            w = coordinates(y)[1]
            total, mean, seen = total + w.T @ w, mean + w.sum(axis=0), seen + len(w)
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(range(k * k + k), pa.int32()), pa.array(np.concatenate([total.ravel(), mean]))], names=["at", "v"])

    got = {r["at"]: r["v"] for r in fit.mapInArrow(tidy(moments), "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()}
    mean = np.array([got[k * k + a] for a in range(k)]) / n
    error = float(np.abs(np.array([got[a] for a in range(k * k)]).reshape(k, k) / n - np.outer(mean, mean) - np.eye(k)).max())
    shares = values / trace

    def run(batches):
        for batch, i, y in _blocks(batches, 1, size):
            z, w = coordinates(y)
            if wide or (4 * n * top) ** 2 * size >= 1 << 62:
                deviation = pa.array([d if (d := sum(x * x for x in row)) < 1 << 63 else None for row in z.astype(object).tolist()], pa.int64())
            else:
                deviation = pa.array(np.einsum("rc,rc->r", z, z))
            own = one(batch.column(0)).slice(i, len(y)).take(pa.array(np.repeat(np.arange(len(y)), k)))
            tiled = lambda v: pa.array(np.tile(v, len(y)))  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays(
                [own, tiled(np.arange(1, k + 1, dtype=np.int32)), pa.array(np.full(len(own), n, np.int64)), deviation.take(pa.array(np.repeat(np.arange(len(y)), k))), pa.array(w.ravel()), tiled(shares), pa.array(np.full(len(own), error))],
                names=out.names,
            )

    return rows.mapInArrow(tidy(run), out)
