"""Whitening of embeddings by the leading eigenvectors of their covariance, found without forming it.

Entries become integers, floor(64 c) + 1000000; the offset cancels in everything below, so the floors alone are kept: one
pass writes them in packed blocks of a few thousand vectors, in the narrowest integers that hold them. Sums are exact. An
entry is centred as (n x - S) / n, an exact integer divided once, before anything is multiplied.

``block_lanczos`` finds the leading eigenpairs of the covariance V, given only the product V Q for a thin block Q. Each product
is one distributed pass, in which a task multiplies its blocks by Q and then by their transpose, and sends one matrix of the
size of Q to be added up. Each new block is orthogonalised against all earlier ones, twice; directions that vanish (an
invariant space has been found) are replaced by fresh random ones; the search ends when the residuals of all wanted pairs are
at rounding level, or the whole space is spanned. The block is wider than the number of components, so that equal eigenvalues
are found as often as they occur. The trace, for the explained shares, is the mean of the deviations over n^2. A last pass
measures the covariance of the whitened vectors.

A row is dropped where the vector is null or empty, holds a null, NaN or infinite entry, or has another number of entries than
most vectors have (the larger number on a tie): the covariance is not defined across lengths. Entries that do not fit 62 bits
after scaling raise an error. Null and repeated ids are carried along, each row by itself; repeated vectors count as often as
they occur. Components whose eigenvalue is zero (below 1e-12 of the largest) cannot be whitened and give no rows: one vector, or
equal vectors, give none; nor does an empty table. Columns other than the id and the vector are not read.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specmark.llm.common import materialize

SCALE = 64
BLOCK_ROWS = 4096
NULL_SPACE = 1e-12
KINDS = (np.int8, np.int16, np.int32, np.int64)


def _blocks_of(ids: pa.Array, vectors: pa.Array):
    """(ids, dimension, floors) of the vectors of a batch that are whole, by dimension."""
    vectors = vectors.cast(pa.large_list(pa.float64()))
    lengths = np.asarray(vectors.value_lengths().fill_null(0))
    flat = vectors.flatten()
    values = np.asarray(flat.fill_null(np.nan))
    ends = np.cumsum(lengths)
    bad = np.concatenate(([0], np.cumsum(~np.isfinite(values))))
    whole = (lengths > 0) & (bad[ends] == bad[ends - lengths])
    for d in np.unique(lengths[whole]):
        rows = np.nonzero(whole & (lengths == d))[0]
        x = np.floor(values[(ends - lengths)[rows][:, None] + np.arange(d)] * SCALE)
        if len(x) and np.abs(x).max() >= 2.0**62:
            raise OverflowError("an entry is too large to be held as an integer of 62 bits")
        yield ids.take(pa.array(rows)), int(d), x.astype(np.int64)


def pack(vectors: DataFrame, id: str, vector: str) -> DataFrame:
    """Blocks: dim, n, most (the largest absolute floor), kind (place in KINDS), floors (bytes) and ids."""
    columns = vectors.select(F.col(id).alias("id"), F.col(vector).cast("array<double>").alias("vector"))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                for ids, d, x in _blocks_of(part.column(0), part.column(1)):
                    most = int(np.abs(x).max())
                    kind = next(k for k, t in enumerate(KINDS) if most <= np.iinfo(t).max)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([d], pa.int32()), pa.array([len(x)], pa.int64()), pa.array([most], pa.int64()), pa.array([kind], pa.int32()),
                         pa.array([x.astype(KINDS[kind]).tobytes()], pa.binary()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)],
                        names=["dim", "n", "most", "kind", "floors", "ids"],
                    )

    kind = columns.schema["id"].dataType.simpleString()
    return columns.mapInArrow(run, f"dim int, n long, most long, kind int, floors binary, ids array<{kind}>")


def _floors(batches, d: int):
    for batch in batches:
        kinds, floors = batch.column("kind").to_pylist(), batch.column("floors")
        for k in range(batch.num_rows):
            yield np.frombuffer(floors[k].as_buffer(), KINDS[kinds[k]]).astype(np.int64).reshape(-1, d)


def _added(blocks: DataFrame, size: int, partial: Callable, kind: str = "double") -> np.ndarray:
    """The sum over tasks of partial(batches), an array of ``size`` values; added up by Spark, position by position."""

    def run(batches):
        values = partial(batches)
        places = pa.array(np.arange(size, dtype=np.int32))
        yield pa.RecordBatch.from_arrays([places, pa.array(values, pa.int64() if kind == "long" else pa.float64())], names=["at", "value"])

    out = np.zeros(size, np.int64 if kind == "long" else np.float64)
    table = blocks.mapInArrow(run, f"at int, value {kind}").groupBy("at").agg(F.sum("value").alias("value")).toArrow()
    out[table["at"].to_numpy()] = table["value"].to_numpy()
    return out


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    return (n * x - sums) / n


def _orthonormal(w: np.ndarray, basis: np.ndarray, scale: float, rng: np.random.Generator) -> np.ndarray:
    """Orthonormal columns that span w, orthogonal to the basis; fresh random directions stand in for those that vanish."""
    room = len(w) - basis.shape[1]
    out = np.zeros((len(w), 0))
    for column in w.T[: min(room, w.shape[1])]:
        v, least = column.copy(), 1e-12 * scale
        while True:
            for _ in range(2):
                v -= basis @ (basis.T @ v)
                v -= out @ (out.T @ v)
            size = np.linalg.norm(v)
            if size > least:
                break
            v, least = rng.normal(size=len(w)), 1e-6
        v /= size
        for q in (basis, out):
            v -= q @ (q.T @ v)
        out = np.column_stack([out, v / np.linalg.norm(v)])
    return out


def block_lanczos(product: Callable[[np.ndarray], np.ndarray], d: int, k: int, block: int = 0, tolerance: float = 1e-14, seed: int = 1):
    """The k largest eigenvalues of a symmetric d x d matrix, falling, and their unit eigenvectors, from its products."""
    rng = np.random.default_rng(seed)
    k = min(k, d)
    block = min(d, max(block, k + 8))
    basis = np.zeros((d, 0))
    projected = np.zeros((0, 0))
    q = _orthonormal(rng.normal(size=(d, block)), basis, 1.0, rng)
    while True:
        basis = np.column_stack([basis, q])
        w = product(q)
        h = basis.T @ w
        m = len(h)
        grown = np.zeros((m, m))
        grown[: m - q.shape[1], : m - q.shape[1]] = projected
        grown[:, m - q.shape[1] :] = h
        grown[m - q.shape[1] :, :] = h.T
        own = grown[m - q.shape[1] :, m - q.shape[1] :]
        own[:] = (own + own.T) / 2
        projected = grown
        for _ in range(2):
            w = w - basis @ (basis.T @ w)
        values, vectors = np.linalg.eigh(projected)
        values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
        scale = max(abs(values[0]), np.finfo(float).tiny)
        residuals = np.linalg.norm(w @ vectors[m - q.shape[1] :], axis=0)
        if m >= d or (m > block and residuals.max() <= tolerance * scale):
            return values, np.linalg.qr(basis @ vectors)[0]
        q = _orthonormal(w, basis, scale, rng)


def whiten(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", components: int = 32) -> DataFrame:
    """A row per vector and component: id, component, n, deviation (decimal, exact), whitened, explained, identity_error."""
    spark = vectors.sparkSession
    id_kind = vectors.schema[id].dataType.simpleString()
    schema = f"`{id}` {id_kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    blocks = materialize(pack(vectors, id, vector), "whitening-blocks")
    found = blocks.groupBy("dim").agg(F.sum("n").alias("n"), F.max("most").alias("most")).orderBy(F.desc("n"), F.desc("dim")).first()
    if found is None:
        return spark.createDataFrame([], schema)
    d, n, most = found
    blocks = blocks.filter(F.col("dim") == d)
    if 2 * n * most >= 1 << 62:
        raise OverflowError("the entries are too large for exact sums")
    numbers = blocks.select("kind", "floors")
    sums = _added(numbers, d, lambda batches: sum((x.sum(0) for x in _floors(batches, d)), np.zeros(d, np.int64)), "long")

    def product(q: np.ndarray) -> np.ndarray:
        def partial(batches):
            total = np.zeros((d, q.shape[1]))
            for x in _floors(batches, d):
                c = _centred(x, n, sums)
                total += c.T @ (c @ q)
            return total.ravel()

        return _added(numbers, q.size, partial).reshape(q.shape) / n

    trace = _added(numbers, 1, lambda batches: np.array([sum(float((_centred(x, n, sums) ** 2).sum()) for x in _floors(batches, d))]))[0] / n
    if not trace:
        return spark.createDataFrame([], schema)
    values, axes = block_lanczos(product, d, components)
    some = values > NULL_SPACE * values[0]
    values, axes = values[some], axes[:, some]
    k = len(values)
    axes = axes / np.sqrt(values)

    def moments(batches):
        first, second = np.zeros(k), np.zeros((k, k))
        for x in _floors(batches, d):
            w = _centred(x, n, sums) @ axes
            first += w.sum(0)
            second += w.T @ w
        return np.concatenate([first, second.ravel()])

    measured = _added(numbers, k + k * k, moments) / n
    covariance = measured[k:].reshape(k, k) - np.outer(measured[:k], measured[:k])  # the means are zero but for rounding
    error = float(np.abs(covariance - np.eye(k)).max())
    explained = values / trace
    narrow = d * (2 * n * most) ** 2 < 1 << 63  # deviations fit 64 bits
    total = [int(s) for s in sums]
    square = sum(s * s for s in total)

    def deviations(x: np.ndarray) -> pa.Array:
        if narrow:
            return pa.array(((n * x - sums) ** 2).sum(1)).cast(pa.decimal128(38, 0))
        exact = x.astype(object)
        return pa.array([int(n * n * a - 2 * n * b + square) for a, b in zip((exact * exact).sum(1), exact @ np.array(total, object))], pa.decimal128(38, 0))

    def rows(batches):
        for batch in batches:
            for b in range(batch.num_rows):
                one = batch.slice(b, 1)
                ids = one.column("ids").flatten()
                x = next(_floors([one], d))
                w = _centred(x, n, sums) @ axes
                row, component = pa.array(np.repeat(np.arange(len(x)), k)), np.tile(np.arange(k), len(x))
                same = lambda v, kind: pa.array(np.full(len(component), v, kind))
                yield pa.RecordBatch.from_arrays(
                    [ids.take(row), pa.array((component + 1).astype(np.int32)), same(n, np.int64), deviations(x).take(row),
                     pa.array(w.ravel()), pa.array(explained[component]), same(error, np.float64)],
                    names=[id, "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return blocks.select("kind", "floors", "ids").mapInArrow(rows, schema)
