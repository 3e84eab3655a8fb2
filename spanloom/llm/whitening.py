"""Whitening of integer embeddings by a pivoted Cholesky factor and one-sided Jacobi.

A vector counts if it is there and all its entries are finite; entry c becomes the integer
x = floor(256 c) (beyond 64 bits: the nearest 64-bit integer). The model is fitted on each distinct x
vector once, so copies have no weight. With n such vectors and sums S the scatter of the
centred x - S/n is summed in Spark, one d x d matrix per task and then row by row; only the
d rows of the total reach the driver, whatever the number of vectors.

There the scatter A is factored with pivoting, A = L L' (columns stop where the rest is
rounding), and one-sided Jacobi rotates the columns of L until they are orthogonal. As
rotations on the right leave L L' as it is, the rotated columns' squared norms are the
eigenvalues of A and the normalised columns are its components, without squaring L again.

Defined cases: a null vector, or one with a null, NaN or infinite entry, has no rows. All
vectors should have one length; if not, those of the commonest length among the distinct
ones count (ties: the longest), others have no rows. Empty vectors, a table without rows and a
fit list without variance have no components, so no rows come back; there are fewer than
``components`` of them where the scatter's rank is lower. Null and repeated ids are rows as
any others. A deviation beyond 64 bits is null. Columns other than the two named are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.shared import store

SCALE = 256.0
COMPONENTS = 4
SWEEPS = 60
_WIDTHS = (np.dtype("<i1"), np.dtype("<i2"), np.dtype("<i4"), np.dtype("<i8"))
_TOP = float(2**63)


@dataclass(frozen=True)
class Model:
    """``sums`` are exact; ``axes`` holds one component per row, ``values`` their eigenvalues."""

    n: int
    sums: tuple[int, ...]
    axes: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float


# -- vectors ----------------------------------------------------------------------------


def _whole(batch: pa.RecordBatch, name: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, int64 vectors) of a batch's countable vectors, one pair for each length."""
    column = batch.column(name)
    offsets = column.offsets.to_numpy()
    # Nulls inside a list become NaN; a null list may still span entries and is left out by its mask.
    entries = column.values.cast(pa.float64()).to_numpy(zero_copy_only=False)
    lengths = np.diff(offsets)
    there = ~column.is_null().to_numpy(zero_copy_only=False)
    for length in np.unique(lengths[there]):
        rows = np.flatnonzero(there & (lengths == length))
        c = entries[offsets[rows][:, None] + np.arange(length)]
        fine = np.isfinite(c).all(axis=1)
        with np.errstate(over="ignore"):
            x = np.floor(c[fine] * SCALE)
        top = np.where(x >= _TOP, np.iinfo(np.int64).max, 0)
        yield rows[fine], np.where(top > 0, top, np.clip(x, -_TOP, np.nextafter(_TOP, 0)).astype(np.int64))


def _packed(x: np.ndarray) -> list[bytes]:
    """Each vector in the fewest bytes an entry that hold it, after its width; equal vectors get equal bytes."""
    if not x.shape[1]:
        return [b"\0"] * len(x)
    low, high = x.min(axis=1), x.max(axis=1)
    kind = np.full(len(x), len(_WIDTHS) - 1)
    for k in range(len(_WIDTHS) - 2, -1, -1):
        limits = np.iinfo(_WIDTHS[k])
        kind[(low >= limits.min) & (high <= limits.max)] = k
    out = np.empty(len(x), dtype=object)
    for k in np.unique(kind):
        rows = np.flatnonzero(kind == k)
        lead, body = bytes([k]), x[rows].astype(_WIDTHS[k])
        out[rows] = [lead + row.tobytes() for row in body]
    return list(out)


def _unpacked(column: Iterable[bytes], d: int) -> np.ndarray:
    out = np.empty((len(column), d), dtype=np.int64)
    for k, data in enumerate(column):
        out[k] = np.frombuffer(data, dtype=_WIDTHS[data[0]], offset=1)
    return out


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - S/n as doubles, from the exact integers n x - S where these fit."""
    top = int(np.abs(x.astype(np.float64)).max(initial=0)) + 1
    if n * top < 1 << 61 and max(map(abs, sums.tolist()), default=0) < 1 << 61:
        return (n * x - sums.astype(np.int64)) / float(n)
    return x.astype(np.float64) - np.array([float(s) / n for s in sums.tolist()])


# -- scatter ----------------------------------------------------------------------------


def _fit_list(vectors: DataFrame, name: str) -> tuple[DataFrame, int]:
    """The distinct countable vectors (packed, of one length) and that length."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, x in _whole(batch, name):
                length = pa.array(np.full(len(x), x.shape[1], dtype=np.int32))
                yield pa.RecordBatch.from_arrays([length, pa.array(_packed(x), pa.binary())], ["d", "packed"])

    found = vectors.select(name).mapInArrow(pack, "d int, packed binary").distinct()
    found = store(found, "vectors")
    lengths = found.groupBy("d").count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    d = lengths[0]["d"] if lengths else 0
    return found.where(F.col("d") == d).select("packed"), d


def _sums(fit: DataFrame, d: int) -> tuple[int, np.ndarray]:
    """Number of vectors and the exact sum of each dimension (Python integers)."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(d, dtype=object)
        for batch in batches:
            x = _unpacked(batch.column(0).to_pylist(), d)
            wide = len(x) * (float(np.abs(x.astype(np.float64)).max(initial=0)) + 1) >= 2.0**62
            total += (x.astype(object) if wide else x).sum(axis=0).astype(object)
            n += len(x)
        if n:
            at = pa.array(np.arange(d, dtype=np.int32))
            parts = [pa.array([str(s) for s in total.tolist()]), pa.array(np.full(d, n, dtype=np.int64))]
            yield pa.RecordBatch.from_arrays([at, *parts], ["i", "s", "n"])

    parts = fit.mapInArrow(add, "i int, s string, n bigint")
    whole = parts.groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n")).collect()
    sums = np.zeros(d, dtype=object)
    for row in whole:
        sums[row["i"]] = int(row["s"])
    return (whole[0]["n"] if whole else 0), sums


def _scatter(fit: DataFrame, d: int, project) -> np.ndarray:
    """Sum over the fit list of the outer products of ``project(x)``, which has ``d`` columns."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for batch in batches:
            y = project(batch.column(0).to_pylist())
            total += y.T @ y
        at = pa.array(np.arange(d, dtype=np.int32))
        yield pa.RecordBatch.from_arrays([at, pa.array(list(total), pa.list_(pa.float64()))], ["i", "row"])

    def merge(part: pd.DataFrame) -> pd.DataFrame:
        row = np.stack(part["row"].to_list()).sum(axis=0)
        return pd.DataFrame({"i": [part["i"].iloc[0]], "slot": [0], "row": [row]})

    # Rows of the tasks' matrices are added up in two steps, so no group grows with the tasks.
    kind = "i int, slot int, row array<double>"
    parts = fit.mapInArrow(add, "i int, row array<double>")
    parts = parts.withColumn("slot", (F.spark_partition_id() % 64).cast("int"))
    some = parts.groupBy("i", "slot").applyInPandas(lambda key, part: merge(part).assign(slot=key[1]), kind)
    out = np.zeros((d, d))
    for row in some.groupBy("i").applyInPandas(merge, kind).collect():
        out[row["i"]] = row["row"]
    return (out + out.T) / 2


# -- eigenvalues ------------------------------------------------------------------------


def pivoted_cholesky(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, L) with a[order][:, order] = L L'; L has as many columns as ``a`` has rank."""
    a = a.copy()
    d = len(a)
    order, factor = np.arange(d), np.zeros((d, d))
    least = np.abs(np.diag(a)).max(initial=0.0) * d * np.finfo(float).eps
    for k in range(d):
        p = k + int(np.argmax(np.diag(a)[k:]))
        if a[p, p] <= least:
            return order, factor[:, :k]
        swap = [p, k]
        a[[k, p]], factor[[k, p]], order[[k, p]] = a[swap], factor[swap], order[swap]
        a[:, [k, p]] = a[:, swap]
        pivot = np.sqrt(a[k, k])
        factor[k, k] = pivot
        factor[k + 1 :, k] = a[k + 1 :, k] / pivot
        a[k + 1 :, k + 1 :] -= np.outer(factor[k + 1 :, k], factor[k + 1 :, k])
    return order, factor


def one_sided_jacobi(factor: np.ndarray) -> np.ndarray:
    """The columns of ``factor`` rotated in pairs until all are orthogonal.

    A sweep meets every pair once, in rounds of disjoint pairs (a round-robin draw), so a
    round is a few array operations.
    """
    u = factor.copy()
    d, r = u.shape
    least = np.finfo(float).eps * max(d, 8)
    ring = np.arange(r + r % 2)
    for _ in range(SWEEPS):
        turned = False
        for _ in range(len(ring) - 1):
            half = len(ring) // 2
            p, q = ring[:half], ring[half:][::-1]
            both = (p < r) & (q < r)
            p, q = p[both], q[both]
            x, y = u[:, p], u[:, q]
            xx, yy, xy = (x * x).sum(axis=0), (y * y).sum(axis=0), (x * y).sum(axis=0)
            far = np.abs(xy) > least * np.sqrt(xx * yy)
            if far.any():
                turned = True
                p, q, x, y = p[far], q[far], x[:, far], y[:, far]
                zeta = (yy[far] - xx[far]) / (2 * xy[far])
                t = np.copysign(1.0, zeta) / (np.abs(zeta) + np.hypot(1.0, zeta))
                c = 1 / np.hypot(1.0, t)
                u[:, p], u[:, q] = c * (x - t * y), c * (t * x + y)
            ring[1:] = np.roll(ring[1:], 1)
        if not turned:
            return u
    raise RuntimeError("the rotations did not settle")


def eigen(scatter: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, axes as rows) by falling value; fewer where the rank is lower."""
    order, factor = pivoted_cholesky(scatter)
    turned = one_sided_jacobi(factor)
    norms = np.sqrt((turned**2).sum(axis=0))
    first = np.argsort(-norms, kind="stable")[:wanted]
    axes = np.zeros((len(first), len(scatter)))
    axes[:, order] = (turned[:, first] / norms[first]).T
    # The sign is free; the largest entry is made positive so that runs agree.
    signs = np.sign(axes[np.arange(len(first)), np.abs(axes).argmax(axis=1)])
    return norms[first] ** 2, axes * signs[:, None]


# -- the operator -----------------------------------------------------------------------


def fit(vectors: DataFrame, name: str = "embedding", components: int = COMPONENTS) -> Model:
    """The whitening model of the distinct vectors of column ``name``."""
    listed, d = _fit_list(vectors, name)
    n, sums = _sums(listed, d)
    if not n:
        return Model(0, (), np.zeros((0, 0)), np.zeros(0), 0.0, 0.0)
    covariance = _scatter(listed, d, lambda packed: _centred(_unpacked(packed, d), n, sums)) / n
    values, axes = eigen(covariance, components)
    whiten = (axes / np.sqrt(values)[:, None]).T
    k = len(values)
    if not k:
        return Model(n, tuple(sums.tolist()), axes, values, float(np.trace(covariance)), 0.0)
    white = _scatter(listed, k, lambda packed: _centred(_unpacked(packed, d), n, sums) @ whiten) / n
    error = float(np.abs(white - np.eye(k)).max())
    return Model(n, tuple(sums.tolist()), axes, values, float(np.trace(covariance)), error)


def _deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """Sum over dimensions of (n x - S)^2, exactly; None beyond 64 bits."""
    top = float(np.abs(x.astype(np.float64)).max(initial=0)) + 1
    most = max((abs(float(s)) for s in sums.tolist()), default=0.0) + 1
    if x.shape[1] * (n * top + most) ** 2 < 2.0**62:
        apart = n * x - sums.astype(np.int64)
        return (apart * apart).sum(axis=1).tolist()
    if x.shape[1] * top * max(top, most) >= 2.0**62:
        x = x.astype(object)
    else:
        sums = sums.astype(np.int64)
    squares, mixed = (x * x).sum(axis=1).tolist(), (x * sums).sum(axis=1).tolist()
    own = sum(s * s for s in map(int, sums.tolist()))
    exact = [n * n * a - 2 * n * b + own for a, b in zip(squares, mixed, strict=True)]
    return [v if v < 1 << 63 else None for v in exact]


def whiten(vectors: DataFrame, model: Model, key: str = "vec_id", name: str = "embedding") -> DataFrame:
    """One row per countable vector and component: key, component, n, deviation, whitened, explained, identity_error."""
    kind = dict(vectors.dtypes)[key]
    schema = (
        f"{key} {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    )
    n, sums, k = model.n, np.array(model.sums, dtype=object), len(model.values)
    scaled = (model.axes / np.sqrt(model.values)[:, None]).T if k else None
    explained = model.values / model.trace if k else None

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches if k else ():
            for rows, x in _whole(batch, name):
                if x.shape[1] != len(sums) or not len(x):
                    continue
                white = _centred(x, n, sums) @ scaled
                each = np.repeat(np.arange(len(x)), k)
                m = len(each)
                columns = [
                    batch.column(key).take(pa.array(rows[each])),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(m, n, dtype=np.int64)),
                    pa.array(_deviations(x, n, sums), pa.int64()).take(pa.array(each)),
                    pa.array(white.ravel()),
                    pa.array(np.tile(explained, len(x))),
                    pa.array(np.full(m, model.identity_error)),
                ]
                names = [key, "component", "n", "deviation", "whitened", "explained", "identity_error"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return vectors.select(key, name).mapInArrow(project, schema)
