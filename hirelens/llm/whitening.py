"""Whitening of embeddings from an exact bit-sliced scatter matrix.

Entries become whole numbers x = floor(64 c) + 1000000. The fit list holds each distinct x vector once. Every task
subtracts its block's smallest value of each dimension, splits the rest into bit planes and packs each plane across
rows into 64-bit words; the cross-product of two dimensions is the sum of 2^(a+b) times the bits that plane a of the one and
plane b of the other share (AND, popcount). Sums and cross-products are whole numbers of any size from there to the
covariance, centred before they become floating point: n² V = n Σ x xᵀ - S Sᵀ. Only d(d+1)/2 of them reach the driver, whatever the number of rows.

* Vectors that are null, empty or hold null or non-finite entries are dropped. So are those of another length than most of the
  remaining distinct ones (of equally usual lengths the larger counts).
* 64 c beyond ±2^50 counts as that bound. A deviation beyond 38 digits is null.
* A component whose variance is under 1e-12 of the largest has no whitened coordinate and isn't returned; so a fit list of one vector,
  or an empty table, gives no rows.
* Repeated rows and null ids stay rows of their own. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_batches

SCALE, SHIFT, BOUND = 64, 1_000_000, float(1 << 50)
COMPONENTS = 16
#: Rows whose bit planes are held at once.
BLOCK = 16_384
#: Cross-products travel as two limbs, so that sums of them cannot overflow a decimal.
LIMB = 40
#: Variances under this share of the largest are none.
LEAST = 1e-12


def quantized(embeddings: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, x array<long>) of the rows that take part."""
    c = F.col("v")
    whole = F.transform(c, lambda e: F.floor(F.greatest(F.least(e * SCALE, F.lit(BOUND)), F.lit(-BOUND))).cast("long") + SHIFT)
    rows = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    finite = F.forall(c, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return rows.where(c.isNotNull() & (F.size(c) > 0) & finite).select("vec_id", whole.alias("x"))


def planes(u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Non-negative u (rows x d) -> (words, dimension, weight) of each bit plane that has a bit: plane k's rows packed 64 to a word."""
    words, dims, bits = [], [], []
    for j in range(u.shape[1]):
        for b in range(int(u[:, j].max()).bit_length()):
            packed = np.packbits(((u[:, j] >> b) & 1).astype(np.uint8))
            words.append(np.pad(packed, (0, -len(packed) % 8)).view(np.uint64))
            dims.append(j)
            bits.append(b)
    return np.array(words, np.uint64).reshape(len(dims), -(-len(u) // 64)), np.array(dims, np.int64), np.array(bits, np.int64)


def scatter(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact sums (d) and cross-products (d x d, upper triangle) of the rows of x, as Python integers."""
    n, d = x.shape
    low = x.min(axis=0)
    words, dims, bits = planes(x - low)
    total, cross = np.zeros(d, object), np.zeros((d, d), object)
    if len(dims):
        ones = np.bitwise_count(words).sum(axis=1, dtype=np.int64)
        for k in range(len(dims)):
            total[dims[k]] += int(ones[k]) << int(bits[k])
            shared = np.bitwise_count(words[k:] & words[k]).sum(axis=1, dtype=np.int64)
            # planes of one dimension are neighbours: fold them by their weights, exactly while 62 bits hold them
            if int(bits[k]) + int(bits.max()) + n.bit_length() + 7 < 62:
                sums = np.bincount(dims[k:], minlength=d) * 0
                np.add.at(sums, dims[k:], shared << (bits[k:] + bits[k]))
                own = int(shared[0]) << int(2 * bits[k])
                sums[dims[k]] = 2 * sums[dims[k]] - own  # (a, b) and (b, a) of one dimension
                cross[dims[k]] += sums
            else:
                for m in range(k, len(dims)):
                    times = 2 if dims[m] == dims[k] and m > k else 1
                    cross[dims[k], dims[m]] += times * int(shared[m - k]) << int(bits[k] + bits[m])
    low = low.astype(object)
    # sum (u + low)(u + low)^T from the sums of u
    cross = cross + np.outer(total, low) + np.outer(low, total) + n * np.outer(low, low)
    return total + n * low, cross


def moments(fit: DataFrame) -> DataFrame:
    """fit(x) -> (i, j, hi, lo) in decimals: cross-products of i <= j as hi * 2^40 + lo; j = -1: the sum of i; i = j = -1: the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, cross, held, rows = 0, 0, 0, [], 0
        for batch in batches:
            x = matrix(batch.column(0))
            held.append(x)
            rows += len(x)
            if rows >= BLOCK:
                s, c = scatter(np.concatenate(held))
                n, total, cross, held, rows = n + rows, total + s, cross + c, [], 0
        if rows:
            s, c = scatter(np.concatenate(held))
            n, total, cross = n + rows, total + s, cross + c
        if n:
            d = len(total)
            i, j = np.triu_indices(d)
            values = [n, *total, *cross[i, j]]
            cols = [pa.array([-1, *range(d), *i.tolist()], pa.int32()), pa.array([-1] * (d + 1) + j.tolist(), pa.int32()),
                    pa.array([Decimal(int(v) >> LIMB) for v in values], pa.decimal128(38, 0)),
                    pa.array([Decimal(int(v) & ((1 << LIMB) - 1)) for v in values], pa.decimal128(38, 0))]
            yield pa.RecordBatch.from_arrays(cols, names=["i", "j", "hi", "lo"])

    parts = fit.select("x").mapInArrow(run, "i int, j int, hi decimal(38,0), lo decimal(38,0)")
    return parts.groupBy("i", "j").agg(F.sum("hi").alias("hi"), F.sum("lo").alias("lo"))


def matrix(column: pa.Array) -> np.ndarray:
    """An Arrow column of lists of one length as rows x d."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


class Model:
    """n, S (whole numbers) and the components of the covariance."""

    def __init__(self, n: int, total: list[int], cross: dict[tuple[int, int], int], components: int):
        d = len(total)
        self.n, self.total = n, total
        v = np.empty((d, d))
        for (i, j), p in cross.items():
            v[i, j] = v[j, i] = (n * p - total[i] * total[j]) / (n * n)  # one rounding
        e, u = np.linalg.eigh(v)
        order = np.argsort(-e, kind="stable")[:components]
        order = order[e[order] > LEAST * max(float(e[-1]), 0.0)]
        u = u[:, order]
        self.e, self.u = e[order], u * np.where(u[np.abs(u).argmax(axis=0), np.arange(len(order))] < 0, -1.0, 1.0)
        self.explained = self.e / np.trace(v) if len(order) else self.e

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exactly."""
        top = max([abs(t) for t in self.total], default=0) + self.n * int(np.abs(x).max(initial=0))
        if top < 1 << 62:
            return x * self.n - np.array(self.total, np.int64)
        return x.astype(object) * self.n - np.array(self.total, object)

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        return (centred.astype(np.float64) / self.n) @ self.u / np.sqrt(self.e)

    @staticmethod
    def deviations(centred: np.ndarray) -> list[int]:
        top = int(np.abs(centred).max(initial=0))
        exact = centred if top * top * max(centred.shape[1], 1) < 1 << 62 else centred.astype(object)
        return [int(t) for t in (exact * exact).sum(axis=1)]


def fit_model(fit: DataFrame, components: int = COMPONENTS) -> Model | None:
    """The model of a fit list of distinct x vectors of one length; None for an empty one."""
    n, total, cross = 0, {}, {}
    for r in moments(fit).collect():  # d (d + 3) / 2 + 1 rows
        value = (int(r.hi) << LIMB) + int(r.lo)
        if r.i < 0:
            n = value
        elif r.j < 0:
            total[r.i] = value
        else:
            cross[r.i, r.j] = value
    return Model(n, [total[i] for i in range(len(total))], cross, components) if n else None


def identity_error(fit: DataFrame, model: Model) -> float:
    """The largest entry of the whitened fit list's covariance minus the identity."""
    k = len(model.e)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, cross = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            z = model.whitened(model.centred(matrix(batch.column(0))))
            sums += z.sum(axis=0)
            cross += z.T @ z
        i, j = np.indices((k, k)).reshape(2, -1)
        yield pa.RecordBatch.from_arrays(
            [pa.array([*[-1] * k, *i.tolist()], pa.int32()), pa.array([*range(k), *j.tolist()], pa.int32()), pa.array([*sums, *cross.ravel()], pa.float64())],
            names=["i", "j", "v"])

    held = {(r.i, r.j): r.v for r in fit.select("x").mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()}
    mean = np.array([held[-1, j] for j in range(k)]) / model.n
    cov = np.array([[held[i, j] for j in range(k)] for i in range(k)]).reshape(k, k) / model.n - np.outer(mean, mean)
    return float(np.abs(cov - np.eye(k)).max(initial=0.0))


SCHEMA = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def whiten(embeddings: DataFrame, id_col: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Whitened coordinates of every remaining row: vec_id, component (from 1 by falling variance), n (vectors fitted), deviation (sum
    over dimensions of (n x - S)^2), whitened, explained (share of the trace), identity_error."""
    spark = embeddings.sparkSession
    small_batches(spark)
    rows = quantized(embeddings, id_col, vector)
    fit = materialize(rows.select("x").distinct(), "fit")
    lengths = fit.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if lengths is None:
        return spark.createDataFrame([], SCHEMA)
    fit = fit.where(F.size("x") == lengths.d)
    model = fit_model(fit, components)
    if not len(model.e):
        return spark.createDataFrame([], SCHEMA)
    error, k = identity_error(fit, model), len(model.e)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = model.centred(matrix(batch.column(1)))
            z, m = model.whitened(c), len(c)
            sums = [Decimal(t) if t < 10 ** 38 else None for t in model.deviations(c)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n)),
                 pa.array(sums, pa.decimal128(38, 0)).take(pa.array(np.repeat(np.arange(m), k))), pa.array(z.ravel()), pa.array(np.tile(model.explained, m)), pa.array(np.full(m * k, error))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.where(F.size("x") == lengths.d).mapInArrow(run, SCHEMA)
