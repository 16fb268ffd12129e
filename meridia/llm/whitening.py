"""Whitening of embeddings by matrix-free block subspace iteration.

Each entry c becomes the whole number x = floor(scale * c) + offset. Rows are centred exactly: n * x - S is whole, and only its
quotient by n is a double, so that a large offset costs no digits. The covariance V is never formed from rows on one machine: a
pass over the rows computes Xᵀ(XQ) for a block Q, each task summing its part, and Spark adds the parts by row of the result. The
driver holds Q (dimensions times block): it takes the QR of VQ and solves the small Rayleigh-Ritz problem, until the residuals
|Vq - eq| of all ``k`` components are within ``tol`` of the largest eigenvalue. The block is twice as wide as what is asked
for, which is what makes close eigenvalues settle; where it spans all dimensions the first pass is certain.

Left out: null vectors, and vectors that are empty or hold null or non-finite entries, or entries that are too large for whole
doubles (2^53 / scale). Vectors of each length are fitted apart. Repeated rows count as often as they stand there; null ids stay.
Components whose eigenvalue is zero against the largest (a constant dimension, fewer rows than components) have no whitened values
and are not returned; an empty table gives an empty result. ``deviation`` is null where no long holds it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import materialise, summed

WHITENED = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
LONGEST = float(2**53)


def whole_vectors(vectors: DataFrame, scale: int, offset: int) -> DataFrame:
    """(vec_id, dim, x) of the vectors that take part."""
    inside = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LONGEST / scale)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.where(F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", inside))
    x = F.transform("v", lambda c: F.floor(c * scale).cast("long") + F.lit(offset))
    return rows.select("vec_id", F.size("v").alias("dim"), x.alias("x"))


def _matrix(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """n * x - S as whole numbers (of Python's where 64 bits don't hold them), and x - S / n."""
    most = n * float(np.abs(x).max(initial=0)) + float(np.abs(sums).max(initial=0))
    far = n * x - sums if most < 2.0**62 else n * x.astype(object) - sums.astype(object)
    return far, (far / n).astype(np.float64)


def _sums(rows: DataFrame, dim: int) -> np.ndarray:
    """The sum of each dimension."""

    def part(batches):
        total = np.zeros(dim, dtype=np.int64)
        for batch in batches:
            total += _matrix(batch, dim).sum(axis=0)
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(dim), pa.int32()), "s": pa.array(total)})

    found = rows.select("x").mapInArrow(part, "i int, s long").groupBy("i").agg(F.sum("s").alias("s")).toArrow()
    out = np.zeros(dim, dtype=np.int64)
    out[found.column("i").to_numpy()] = found.column("s").to_numpy()
    return out


class Centred:
    """The rows of one length, centred: each method is a pass over them."""

    def __init__(self, rows: DataFrame, n: int, dim: int):
        self.rows, self.n, self.dim, self.sums = rows, n, dim, _sums(rows, dim)

    def _added(self, one, height: int, width: int, *shared: np.ndarray) -> np.ndarray:
        """The sum over all batches of ``one(z, *shared)``, a (height, width) matrix for the centred rows z."""
        n, dim, sums = self.n, self.dim, self.sums
        sent = self.rows.sparkSession.sparkContext.broadcast(shared)

        def start():
            return lambda batch: one(_centred(_matrix(batch, dim), n, sums)[1], *sent.value)

        out = summed(self.rows.select("x"), start, height, width)
        sent.unpersist()
        return out

    def times(self, q: np.ndarray) -> tuple[np.ndarray, float]:
        """VQ and the trace of V."""
        width = q.shape[1]

        def one(z, q):
            return np.vstack([z.T @ (z @ q), np.full((1, width), (z * z).sum())])

        y = self._added(one, self.dim + 1, width, q) / self.n
        return y[:-1], float(y[-1, 0])

    def covariance(self, p: np.ndarray) -> np.ndarray:
        """Covariance of the rows projected on the columns of ``p``, from their own mean."""
        k = p.shape[1]
        mean = self._added(lambda z, p: (z @ p).sum(axis=0, keepdims=True), 1, k, p) / self.n

        def one(z, p, mean):
            w = z @ p - mean
            return w.T @ w

        return self._added(one, k, k, p, mean) / self.n


def principal(rows: Centred, k: int, tol: float = 1e-12, max_passes: int = 300, seed: int = 11) -> tuple[np.ndarray, np.ndarray, float, int]:
    """The ``k`` largest eigenvalues of V, falling, with their unit vectors as columns, V's trace and the passes made.

    Raises where the residuals don't certify all components after ``max_passes``.
    """
    width = min(rows.dim, 2 * k)
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((rows.dim, width)))[0]
    for made in range(1, max_passes + 1):
        y, trace = rows.times(q)
        small = q.T @ y
        e, u = np.linalg.eigh((small + small.T) / 2)
        e, u = e[::-1], u[:, ::-1]
        residuals = np.linalg.norm(y @ u - (q @ u) * e, axis=0)[:k]
        if (residuals <= tol * max(e[0], 0.0)).all():
            vectors = (q @ u)[:, :k]
            return e[:k], vectors / np.linalg.norm(vectors, axis=0), trace, made
        q = np.linalg.qr(y)[0]
    raise RuntimeError(f"residuals of {residuals.max() / e[0]:.1e} of the largest eigenvalue after {max_passes} passes")


def _whitened(rows: Centred, k: int) -> DataFrame:
    e, vectors, trace, _ = principal(rows, min(k, rows.dim))
    sure = e > max(e[0], 0.0) * 1e-12
    e, vectors = e[sure], vectors[:, sure]
    if not len(e):
        return rows.rows.sparkSession.createDataFrame([], WHITENED)
    n, dim, sums, k = rows.n, rows.dim, rows.sums, len(e)
    p = vectors / np.sqrt(e)
    error = float(np.abs(rows.covariance(p) - np.eye(k)).max(initial=0.0))
    sent = rows.rows.sparkSession.sparkContext.broadcast((p, e / trace if trace else e))

    def part(batches):
        p, share = sent.value
        for whole in batches:
            step = max(1, 65536 // max(1, k))
            for batch in (whole.slice(at, step) for at in range(0, len(whole), step)):
                far, z = _centred(_matrix(batch, dim), n, sums)
                if float((z * z).sum(axis=1).max(initial=0.0)) * n * n < 2.0**62:
                    deviation = pa.array((far * far).sum(axis=1).astype(np.int64))
                else:
                    exact = [sum(int(d) ** 2 for d in row) for row in far]
                    deviation = pa.array([d if d < 2**63 else None for d in exact], pa.int64())
                rows_of = pa.array(np.repeat(np.arange(len(batch)), k))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("vec_id").take(rows_of),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(batch))),
                        pa.array(np.full(len(batch) * k, n, dtype=np.int64)),
                        deviation.take(rows_of),
                        pa.array((z @ p).ravel()),
                        pa.array(np.tile(share, len(batch))),
                        pa.array(np.full(len(batch) * k, error)),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.rows.select("vec_id", "x").mapInArrow(part, WHITENED)


def whitened(vectors: DataFrame, k: int = 32, scale: int = 64, offset: int = 1_000_000) -> DataFrame:
    """Rows of ``WHITENED`` for each row of ``vectors(vec_id, embedding)`` and each of the first ``k`` components."""
    rows = materialise(whole_vectors(vectors, scale, offset), "whole-vectors")
    out = None
    # a row for each length of vectors
    for dim, n in sorted(map(tuple, rows.groupBy("dim").count().collect())):
        one = _whitened(Centred(rows.where(F.col("dim") == dim), n, dim), k)
        out = one if out is None else out.unionByName(one)
    return rows.sparkSession.createDataFrame([], WHITENED) if out is None else out


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
