"""Whitening of embeddings by a tall-skinny QR decomposition; no covariance matrix of the data is formed.

Rows are centred with exact integer sums. Each task brings its rows down to one triangle R, triangles are
merged eight by eight, and the singular values and right vectors of the last one are those of all
centred rows: the covariance's eigenvalues are the squares over n, its eigenvectors the right vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut
from .vectors import is_sound, matrix, of_common_length, slices

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: Triangles that are merged at once.
FAN_IN = 8
#: An entry of this magnitude or more has no sound long form and counts as non-finite.
TOO_LARGE = float(1 << 50)
#: Directions whose singular value is a smaller share of the largest one are rounding, not data.
LEAST_SHARE = 1e-12


def as_integers(vector: Column) -> Column:
    """x = floor(64 * c) + 1,000,000 of each entry."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE).cast("long") + SHIFT)


def numerators(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exact: as 64-bit integers where they're large enough, else as Python's."""
    floors = [s // n for s in sums]
    rests = [s - n * f for s, f in zip(sums, floors)]
    apart = x.astype(object) - np.array(floors, object) if max(map(abs, floors), default=0) >= 1 << 62 else x - np.array(floors, np.int64)
    if len(x) and (int(np.abs(apart).max()) + 1) * n >= 1 << 62:
        return n * apart.astype(object) - np.array(rests, object)
    return n * apart - np.array(rests, np.int64)


def deviations(exact: np.ndarray) -> list[int | None]:
    """The sum of squares of each row, exact; null where it's no 64-bit number."""
    if exact.dtype == object or len(exact) and int(np.abs(exact).max()) ** 2 * exact.shape[1] >= 1 << 63:
        found = (exact.astype(object) ** 2).sum(axis=1)
        return [int(v) if v < 1 << 63 else None for v in found]
    return (exact * exact).sum(axis=1).tolist()


def column_sums(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """Number of rows and exact sum of each column of `x`: a task adds up its own, so its length is all that a task hands on."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0] * d
        for batch in slices(batches, d):
            x = matrix(batch["x"], d, np.int64)
            wide = len(x) and int(np.abs(x).max()) * len(x) >= 1 << 62
            n, sums = n + len(x), [a + int(b) for a, b in zip(sums, (x.astype(object) if wide else x).sum(axis=0))]
        if n:
            columns = [pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array(map(Decimal, sums), pa.decimal128(38, 0))]
            yield pa.RecordBatch.from_arrays(columns, ["i", "n", "total"])

    parts = fit.mapInArrow(add, "i int, n long, total decimal(38,0)")
    rows = sorted(parts.groupBy("i").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect())
    return (rows[0]["n"] if rows else 0), [int(r["total"]) for r in rows]


def triangle(fit: DataFrame, d: int, n: int, sums: list[int]) -> np.ndarray:
    """R of the QR decomposition of all centred rows (up to the signs of its rows): a triangle a task, merged FAN_IN by FAN_IN."""
    schema = "part long, r binary"

    def put(part: int, r: np.ndarray) -> dict:
        return {"part": pa.array([part], pa.int64()), "r": pa.array([np.ascontiguousarray(r).tobytes()], pa.binary())}

    def reduce_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, d))
        for batch in slices(batches, d):
            centred = (numerators(matrix(batch["x"], d, np.int64), n, sums) / n).astype(float)
            r = np.linalg.qr(np.vstack([r, centred]), mode="r")
        if len(r):
            yield pa.RecordBatch.from_pydict(put(TaskContext.get().partitionId(), r))

    def merge(key: tuple, group: pa.Table) -> pa.Table:
        stacked = [np.frombuffer(r.as_buffer()).reshape(-1, d) for r in group.sort_by("part")["r"]]
        return pa.table(put(key[0].as_py(), np.linalg.qr(np.vstack(stacked), mode="r")))

    parts = fit.mapInArrow(reduce_rows, schema)
    tasks = fit.rdd.getNumPartitions()
    for _ in range(math.ceil(math.log(max(tasks, 2), FAN_IN)) + 1):
        parts = parts.withColumn("to", F.floor(F.col("part") / FAN_IN)).groupBy("to").applyInArrow(merge, schema)
    return np.frombuffer(bytes(parts.first()["r"])).reshape(-1, d)


def whiten(embeddings: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of each sound row and component.

    The fit list has each integer vector once, so repeated rows weigh as one, and get equal results each. Rows whose vector is null,
    empty, holds a null, a non-finite entry or one of 2^50 or more, or isn't as long as most are, have no result; nor have components that
    the fit list doesn't spread in (fewer different vectors than components, or columns that depend on each other), so one vector alone and an
    empty table give no rows. Equal eigenvalues share a plane, of which some basis is taken. A null vec_id stays null;
    columns of other names aren't read. A deviation beyond 64 bits is null.
    """
    v = F.col(vector)
    small = ~F.exists(v, lambda c: F.abs(c) >= TOO_LARGE)
    rows, d = of_common_length(embeddings.where(is_sound(v)).where(small).select("vec_id", as_integers(v).alias("x")), "x")
    schema = rows.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {schema}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    fit = cut(rows.select("x").distinct())
    n, sums = column_sums(fit, d)
    if n < 2:
        return embeddings.sparkSession.createDataFrame([], schema)
    _, singular, right = np.linalg.svd(triangle(fit, d, n, sums), full_matrices=False)
    k = min(components, int((singular > singular[:1] * LEAST_SHARE).sum()))
    eigenvalues = singular**2 / n
    explained = eigenvalues[:k] / max(eigenvalues.sum(), np.finfo(float).tiny)
    project = right[:k].T / np.sqrt(eigenvalues[:k])

    def whitened(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        exact = numerators(matrix(batch["x"], d, np.int64), n, sums)
        return exact, (exact / n).astype(float) @ project

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for batch in slices(batches, d):
            w = whitened(batch)[1]
            total += w.T @ w
        i, j = np.indices((k, k))
        yield pa.RecordBatch.from_pydict({"i": pa.array(i.ravel(), pa.int32()), "j": pa.array(j.ravel(), pa.int32()), "total": pa.array(total.ravel())})

    seen = fit.mapInArrow(moments, "i int, j int, total double").groupBy("i", "j").agg(F.sum("total").alias("total")).collect()
    identity_error = max((abs(r["total"] / n - (r["i"] == r["j"])) for r in seen), default=0.0)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, d):
            exact, w = whitened(batch)
            here, deviation = len(w), pa.array(deviations(exact), pa.int64())
            each = pa.array(np.repeat(np.arange(here), k))
            columns = [
                batch["vec_id"].take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), here)), pa.array(np.full(here * k, n)), deviation.take(each),
                pa.array(w.ravel()), pa.array(np.tile(explained, here)), pa.array(np.full(here * k, identity_error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(put, schema)
