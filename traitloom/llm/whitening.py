"""Whitening of embeddings: leading components of the covariance by spectrum slicing.

Inertia counts of LDLᵀ factors of the shifted covariance say how many eigenvalues lie above a shift. Bisection
on the counts isolates each leading eigenvalue, Rayleigh quotient iteration converges to its pair, and counts
on both sides of the result certify its number. Spark sums counts, vectors and products over the fit list;
the driver holds one matrix of dimensions squared.

Edge cases: vectors that are null or hold a null or non-finite entry are left out; shorter vectors are padded
with zeros to the longest; an empty table, or one without a usable vector, gives no rows. Repeated vectors
count once in the fit, repeated rows are all returned. Components without variance (an eigenvalue of at most
``d`` roundings of the trace) cannot be whitened and have no rows. Entries beyond a long are held at its
bounds; a deviation beyond a long is null. Columns of the input with other names play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traitloom.llm.common import shared
from traitloom.session import cut

SCALE = 256
COMPONENTS = 4
_EPS = float(np.finfo(float).eps)
_ALPHA = (1 + 17**0.5) / 8


def above(matrix: np.ndarray, shift: float) -> int:
    """How many eigenvalues of a symmetric matrix exceed ``shift``: positive pivots of an LDLᵀ factorisation.

    Pivots of one or two rows are chosen as Bunch and Kaufman do; one of two rows has one positive and one
    negative eigenvalue.
    """
    a = matrix - shift * np.eye(len(matrix))
    k, n, positive = 0, len(a), 0
    while k < n:
        two = False
        if k + 1 < n:
            below = np.abs(a[k + 1 :, k])
            r = k + 1 + int(below.argmax())
            most = below[r - k - 1]
            if most > 0 and abs(a[k, k]) < _ALPHA * most:
                across = np.abs(a[r, k:])
                across[r - k] = 0
                widest = across.max()
                if abs(a[k, k]) * widest < _ALPHA * most * most:
                    two = abs(a[r, r]) < _ALPHA * widest
                    to = k + 1 if two else k
                    a[[to, r]] = a[[r, to]]
                    a[:, [to, r]] = a[:, [r, to]]
        if two:
            pivot, side = a[k : k + 2, k : k + 2], a[k + 2 :, k : k + 2]
            a[k + 2 :, k + 2 :] -= side @ np.linalg.solve(pivot, side.T)
            positive, k = positive + 1, k + 2
        else:
            d = a[k, k]
            if d != 0:
                side = a[k + 1 :, k]
                a[k + 1 :, k + 1 :] -= np.outer(side / d, side)
            positive, k = positive + bool(d > 0), k + 1
    return positive


def _rayleigh(matrix: np.ndarray, low: float, high: float, found: list[np.ndarray], scale: float) -> tuple[float, np.ndarray]:
    """A pair from iterations that start with the middle of (low, high], orthogonal to the vectors found."""

    def clean(v: np.ndarray) -> np.ndarray:
        for u in (*found, *found):
            v = v - (u @ v) * u
        size = np.linalg.norm(v)
        return v / size if size > 0 else clean(rng.standard_normal(len(matrix)))

    def step(shift: float, v: np.ndarray) -> np.ndarray:
        try:
            return clean(np.linalg.solve(matrix - shift * np.eye(len(matrix)), v))
        except np.linalg.LinAlgError:
            return clean(np.linalg.solve(matrix - (shift + 4 * _EPS * scale) * np.eye(len(matrix)), v))

    rng = np.random.default_rng(len(found))
    v, middle = clean(rng.standard_normal(len(matrix))), (low + high) / 2
    for _ in range(3):
        v = step(middle, v)
    best, pair = np.inf, (middle, v)
    for _ in range(12):
        value = float(v @ matrix @ v)
        residual = float(np.linalg.norm(matrix @ v - value * v))
        if residual >= best:
            break
        best, pair = residual, (value, v)
        if residual <= _EPS * scale:
            break
        v = step(value, v)
    return pair


def leading(matrix: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues (at most ``count``, above rounding) and their unit vectors as rows."""
    d, scale = len(matrix), float(np.trace(matrix))
    least = max(d, 1) * _EPS * scale
    values: list[float] = []
    vectors: list[np.ndarray] = []
    if not d or not scale > 0:
        return np.zeros(0), np.zeros((0, d))
    counts: dict[float, int] = {}

    def over(shift: float) -> int:
        if shift not in counts:
            counts[shift] = above(matrix, shift)
        return counts[shift]

    floor, ceiling = least, scale * (1 + d * _EPS)
    counts[ceiling] = 0
    for number in range(1, count + 1):
        if over(floor) < number:
            break
        low = max(s for s in counts if counts[s] >= number)
        high = min(s for s in counts if counts[s] < number)
        while True:
            # One eigenvalue in (low, high], or several within rounding of each other.
            while (over(low) > number or over(high) < number - 1) and high - low > least:
                middle = (low + high) / 2
                low, high = (middle, high) if over(middle) >= number else (low, middle)
            value, vector = _rayleigh(matrix, low, high, vectors, scale)
            slack = max(least, 2 * float(np.linalg.norm(matrix @ vector - value * vector)))
            certain = over(value + slack) < number <= over(value - slack)
            if certain or high - low <= least:
                break
            middle = (low + high) / 2
            low, high = (middle, high) if over(middle) >= number else (low, middle)
        values.append(value)
        vectors.append(vector)
    return np.array(values), np.array(vectors).reshape(len(values), d)


def _matrix(batch: pa.RecordBatch, name: str, dims: int) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index(name))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dims)


def _rounded(vectors: DataFrame, vec_col: str) -> DataFrame:
    finite = F.forall(vec_col, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    rows = vectors.where(F.col(vec_col).isNotNull() & finite)
    return rows.withColumn("__x", F.transform(vec_col, lambda c: F.floor(F.lit(float(SCALE)) * c.cast("double"))))


def _added(partial: DataFrame) -> dict[tuple[int, int], float]:
    return {(r["i"], r["j"]): r["v"] for r in partial.groupBy("i", "j").agg(F.sum("v").alias("v")).collect()}


def fit(rows: DataFrame, dims: int, count: int = COMPONENTS) -> tuple[dict, DataFrame]:
    """The model of rows with a padded ``__x``, and the fit list (each distinct vector once, as a table)."""
    listed = cut(rows.select("__x").distinct())

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Two halves, so that sums of longs stay exact.
        n, high, low = 0, np.zeros(dims, np.int64), np.zeros(dims, np.int64)
        for batch in batches:
            x = _matrix(batch, "__x", dims)
            n, high, low = n + len(x), high + (x >> 24).sum(0), low + (x & 0xFFFFFF).sum(0)
        yield pa.RecordBatch.from_pydict({"i": [*range(dims), -1], "high": [*high.tolist(), 0], "low": [*low.tolist(), n]}, part)

    part = pa.schema([("i", pa.int32()), ("high", pa.int64()), ("low", pa.int64())])
    sums = listed.mapInArrow(totals, "i int, high bigint, low bigint").groupBy("i")
    sums = {r["i"]: (int(r["h"]) << 24) + int(r["l"]) for r in sums.agg(*[F.sum(F.col(c).cast("decimal(38,0)")).alias(c[0]) for c in ("high", "low")]).collect()}
    n = sums.pop(-1, 0)
    total = [sums.get(i, 0) for i in range(dims)]
    mean = np.array([s / n for s in total]) if n else np.zeros(dims)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram = np.zeros((dims, dims))
        for batch in batches:
            centred = _matrix(batch, "__x", dims) - mean
            gram += centred.T @ centred
        i, j = np.triu_indices(dims)
        yield pa.RecordBatch.from_pydict({"i": i, "j": j, "v": gram[i, j]}, cell)

    cell = pa.schema([("i", pa.int32()), ("j", pa.int32()), ("v", pa.float64())])
    covariance = np.zeros((dims, dims))
    for (i, j), v in _added(listed.mapInArrow(products, "i int, j int, v double")).items():
        covariance[i, j] = covariance[j, i] = v / n
    values, directions = leading(covariance, count)
    trace = float(np.trace(covariance))
    model = {"n": n, "total": total, "mean": mean, "values": values, "directions": directions, "explained": values / trace if trace else values}
    model["identity_error"] = _identity_error(listed, model)
    return model, listed


def project(x: np.ndarray, model: dict) -> np.ndarray:
    """Whitened rows of whole vectors ``x``, one column per component."""
    return ((x - model["mean"]) @ model["directions"].T) / np.sqrt(model["values"])


def _identity_error(listed: DataFrame, model: dict) -> float:
    """Largest entry of the covariance of the whitened fit list, less the identity."""
    k, dims, n = len(model["values"]), len(model["mean"]), model["n"]
    if not k:
        return 0.0
    held = shared(listed.sparkSession, model)
    white = project  # by value

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Products about the mean of the partition, its mean on row k, the spread of means in the second block.
        m, mean, gram = 0, np.zeros(k), np.zeros((k, k))
        for batch in batches:
            w = white(_matrix(batch, "__x", dims), held.value)
            if len(w):
                own, delta = w.mean(0), w.mean(0) - mean
                gram += (w - own).T @ (w - own) + np.outer(delta, delta) * (m * len(w) / (m + len(w)))
                mean, m = mean + delta * (len(w) / (m + len(w))), m + len(w)
        full = gram + m * np.outer(mean, mean)
        i, j = np.indices((k, k)).reshape(2, -1)
        cells = {"i": [*i, *[k] * k], "j": [*j, *range(k)], "v": [*full[i, j], *(m * mean)]}
        yield pa.RecordBatch.from_pydict(cells, pa.schema([("i", pa.int32()), ("j", pa.int32()), ("v", pa.float64())]))

    cells = _added(listed.mapInArrow(moments, "i int, j int, v double"))
    mean = np.array([cells[k, j] / n for j in range(k)])
    spread = np.array([[cells[i, j] / n - mean[i] * mean[j] for j in range(k)] for i in range(k)])
    return float(np.abs(spread - np.eye(k)).max())


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", count: int = COMPONENTS) -> DataFrame:
    """One row per usable vector and component: its whitened coordinate and the figures of the fit."""
    spark = vectors.sparkSession
    rows = _rounded(vectors.select(F.col(id_col).alias("vec_id"), F.col(vec_col).alias("__v")), "__v").select("vec_id", "__x")
    dims = rows.agg(F.max(F.size("__x"))).first()[0] or 0
    zeros = F.array_repeat(F.lit(0).cast("bigint"), F.lit(dims) - F.size("__x"))
    rows = rows.withColumn("__x", F.concat("__x", zeros))
    model, _ = fit(rows, dims, count)
    held, k, white = shared(spark, model), len(model["values"]), project
    out = pa.schema([
        ("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()),
        ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64()),
    ])

    def deviations(x: np.ndarray, m: dict) -> list[int | None]:
        most = m["n"] * max(1.0, float(np.abs(x.astype(float)).max())) + max(1.0, *map(abs, map(float, m["total"])))
        if most * most * dims < 2.0**62:
            return ((m["n"] * x - np.array(m["total"], np.int64)) ** 2).sum(1).tolist()
        exact = [sum((m["n"] * int(c) - s) ** 2 for c, s in zip(row, m["total"])) for row in x]
        return [v if v < 1 << 63 else None for v in exact]

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            if not k or not batch.num_rows:
                continue
            x = _matrix(batch, "__x", dims)
            picks = np.repeat(np.arange(len(x)), k)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).cast(pa.int64()).take(pa.array(picks)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                pa.array(np.full(len(x) * k, m["n"], np.int64)), pa.array(deviations(x, m), pa.int64()).take(pa.array(picks)),
                pa.array(white(x, m).ravel()), pa.array(np.tile(m["explained"], len(x))),
                pa.array(np.full(len(x) * k, m["identity_error"])),
            ], schema=out)

    kinds = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    return rows.mapInArrow(rows_of, kinds)
