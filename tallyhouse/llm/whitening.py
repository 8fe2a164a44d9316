"""Embedding whitening from exact integer cross-products.

Vectors become whole numbers x. Each dimension is shifted to start at 0, and its bits are packed across rows: one word holds one
bit of 64 rows. The cross-product of two dimensions is then a sum over pairs of their bit planes, each the count of ones in the
AND of two planes, times a power of two. These counts are exact, so are their sums over tasks, and the matrix is centred as
integers (n * sum of products - product of sums) before it becomes doubles: no digit is lost, however far the mean lies from 0.
Its eigenvectors (dim x dim numbers reach the driver, whatever the rows) are the components.

Every distinct x vector counts once in the fit, so copies don't weigh.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyhouse.llm.common import Scratch, table

#: Rows whose bits are packed at once; bits of a sum's limb. A limb's sums stay in a long for 2**46 rows.
PACKED, LIMB = 8192, 16
LONG = (1 << 63) - 1


def whole_vectors(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, x (array of long: floor(scale * c), a long's end beyond its range) for rows that take part: neither vector nor component null, all finite."""
    odd = F.exists("embedding", lambda e: e.isNull() | F.isnan(e) | (F.abs(e.cast("double")) == float("inf")))
    rows = vectors.where(F.coalesce(F.col("embedding").isNotNull() & ~odd, F.lit(False)))
    return rows.select("vec_id", F.transform("embedding", lambda e: F.floor(e.cast("double") * scale)).alias("x"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of one length, shorter vectors padded with zeros."""
    lengths = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(lengths), dim), np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def planes(x: np.ndarray, least: list[int], bits: list[int]) -> np.ndarray:
    """A row of words for each bit of each dimension: bit b of x - least, over all rows of x."""
    shifted = x.astype(np.uint64) - np.array([v % (1 << 64) for v in least], np.uint64)  # differences below 2**64 survive the wrap
    out = np.zeros((sum(bits), -(-len(x) // 64) * 64), np.uint8)
    at = 0
    for i, n in enumerate(bits):
        for b in range(n):
            out[at, : len(x)] = (shifted[:, i] >> np.uint64(b)) & np.uint64(1)
            at += 1
    return np.packbits(out, axis=1, bitorder="little").view(np.uint64)


def scatter(x: np.ndarray, least: list[int], bits: list[int], sums: np.ndarray, products: np.ndarray) -> None:
    """Adds to ``sums`` (dim, limbs) and ``products`` (dim, limbs, dim) what the rows of x - least give, by weighted popcounts."""
    packed = planes(x, least, bits)
    of = np.repeat(np.arange(len(bits)), bits)
    bit = np.concatenate([np.arange(n) for n in bits]) if len(of) else np.zeros(0, int)
    ones = np.bitwise_count(packed).sum(axis=1, dtype=np.int64)
    np.add.at(sums, (of, bit // LIMB), ones << (bit % LIMB))
    for p in range(len(of)):
        both = np.bitwise_count(packed[p:] & packed[p]).sum(axis=1, dtype=np.int64)
        if bit[p]:  # the other planes of the same dimension, left of p
            first = p - bit[p]
            both = np.concatenate([np.bitwise_count(packed[first:p] & packed[p]).sum(axis=1, dtype=np.int64), both])
        else:
            first = p
        weight = bit[p] + bit[first:]
        np.add.at(products[of[p]], (weight // LIMB, of[first:]), both << (weight % LIMB))


class Whitening:
    """n, the sums S of the fit list, the components (columns, strongest first) and their eigenvalues, the trace."""

    def __init__(self, n: int, sums: list[int], components: np.ndarray, values: np.ndarray, trace: float):
        self.n, self.sums, self.components, self.values, self.trace = n, sums, components, values, trace
        #: A component whose variance is rounding error alone has no scale.
        self.has_scale = values > max(trace, 0.0) * len(sums) * 2.0**-50

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, as whole numbers."""
        most = max([abs(v) for v in self.sums], default=0) + self.n * max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))
        if most < LONG:
            return self.n * x - np.array(self.sums, np.int64)
        return x.astype(object) * self.n - np.array(self.sums, object)

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        """Rows by components; not-a-number where a component has no scale."""
        scale = np.where(self.has_scale, np.sqrt(np.maximum(self.values, 1e-300)), np.nan)
        return (centred / self.n).astype(float) @ self.components / scale

    def deviations(self, centred: np.ndarray) -> list[int]:
        most = int(np.abs(centred).max(initial=0))
        if most * most * max(1, centred.shape[1]) < LONG:
            return (centred.astype(np.int64) ** 2).sum(axis=1).tolist()
        return [sum(int(v) ** 2 for v in row) for row in centred]


def components_of(n: int, sums: list[int], products: list[list[int]], k: int) -> tuple[np.ndarray, np.ndarray, float]:
    """The k strongest unit eigenvectors of the covariance, their eigenvalues and the trace; ``products`` and ``sums`` are whole numbers, of any common shift."""
    d = len(sums)
    v = np.array([[(n * products[i][j] - sums[i] * sums[j]) / (n * n) for j in range(d)] for i in range(d)])
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    return vectors * np.where(signs == 0, 1, signs), np.maximum(values, 0.0), float(np.trace(v))


def fit(distinct: DataFrame, dim: int, k: int) -> Whitening:
    """The whitening of ``distinct`` (column x), each row counted once. dim**2 numbers of a few limbs reach the driver."""

    def ends(batches):
        low, high = None, None
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("x"), dim)
                low = x.min(axis=0) if low is None else np.minimum(low, x.min(axis=0))
                high = x.max(axis=0) if high is None else np.maximum(high, x.max(axis=0))
        if low is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim, dtype=np.int32)), pa.array(low), pa.array(high)], names=["i", "low", "high"])

    found = distinct.mapInArrow(ends, "i int, low long, high long").groupBy("i").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    found = {r["i"]: (r["low"], r["high"]) for r in found.collect()}
    least = [found[i][0] for i in range(dim)]
    bits = [(found[i][1] - found[i][0]).bit_length() for i in range(dim)]
    limbs = 2 * max(1, max(bits)) // LIMB + 1

    def run(batches):
        n, sums, products = 0, np.zeros((dim, limbs), np.int64), np.zeros((dim, limbs, dim), np.int64)
        for batch in batches:
            x = _matrix(batch.column("x"), dim)
            n += len(x)
            for start in range(0, len(x), PACKED):
                scatter(x[start : start + PACKED], least, bits, sums, products)
        if n:
            rows = [(-1, -1, 0, n)]
            rows += [(i, -1, l, int(sums[i, l])) for i in range(dim) for l in range(limbs)]
            i, l, j = np.nonzero(products)
            columns = [np.concatenate([np.array([r[c] for r in rows], np.int64), x]) for c, x in enumerate((i, j, l, products[i, l, j]))]
            arrays = [pa.array(x.astype(t)) for x, t in zip(columns, (np.int32, np.int32, np.int32, np.int64))]
            yield pa.RecordBatch.from_arrays(arrays, names=["i", "j", "limb", "total"])

    totals = distinct.mapInArrow(run, "i int, j int, limb int, total long").groupBy("i", "j", "limb").agg(F.sum("total").alias("total"))
    n, shifted, products = 0, [0] * dim, [[0] * dim for _ in range(dim)]
    for i, j, limb, total in totals.collect():
        if i < 0:
            n = total
        elif j < 0:
            shifted[i] += total << (LIMB * limb)
        else:
            products[i][j] += total << (LIMB * limb)
    for i in range(dim):
        for j in range(i):
            products[i][j] = products[j][i]
    components, values, trace = components_of(n, shifted, products, k)
    return Whitening(n, [s + n * low for s, low in zip(shifted, least)], components, values, trace)


def identity_error(distinct: DataFrame, dim: int, model: Whitening) -> float | None:
    """The largest absolute entry of the whitened fit list's covariance minus the identity, over components with a scale; means first, then centred products."""
    k = len(model.values)

    def sums_of(part):
        def run(batches):
            total = np.zeros(k * k + k)
            for batch in batches:
                if batch.num_rows:
                    total += part(model.whitened(model.centred(_matrix(batch.column("x"), dim))))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["i", "total"])

        got = distinct.mapInArrow(run, "i int, total double").groupBy("i").agg(F.sum("total").alias("total")).collect()
        out = np.zeros(k * k + k)
        for r in got:
            out[r["i"]] = r["total"]
        return out / model.n

    mean = sums_of(lambda w: np.concatenate([w.sum(axis=0), np.zeros(k * k)]))[:k]
    cov = sums_of(lambda w: np.concatenate([np.zeros(k), ((w - mean).T @ (w - mean)).ravel()]))[k:].reshape(k, k)
    held = model.has_scale
    return float(np.abs(cov - np.eye(k))[np.ix_(held, held)].max()) if held.any() else None


def whiten(vectors: DataFrame, k: int = 4, scale: int = 256) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error, deviation_digits: k rows, or as many as there are dimensions, for each row that takes part.

    Rows whose vector is null or has a null or non-finite entry take no part; null ids and repeated rows are kept; shorter
    vectors count as padded with zeros; further columns are left aside; an empty table, and one of empty vectors alone, give
    no rows. ``deviation`` is exact; where a long can't hold it, it is null and ``deviation_digits`` has it as text (null
    otherwise). A component without variance (all vectors alike, or fewer distinct ones than components) has a null
    ``whitened`` and stays out of the identity error; ``explained`` is null where no dimension varies.
    """
    scratch = Scratch(vectors.sparkSession)
    rows = whole_vectors(vectors, scale)
    dim = rows.agg(F.coalesce(F.max(F.size("x")), F.lit(0)).alias("d")).first()["d"]
    kind = vectors.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_digits string"
    if not dim:
        return scratch.spark.createDataFrame([], schema)
    padded = F.when(F.size("x") == dim, F.col("x")).otherwise(F.concat("x", F.array_repeat(F.lit(0).cast("long"), dim - F.size("x"))))
    distinct = scratch.write(rows.select(padded.alias("x")).distinct(), "distinct")
    model = fit(distinct, dim, min(k, dim))
    error = identity_error(distinct, dim, model)
    scratch.drop(distinct)
    parts = len(model.values)
    explained = [float(e) / model.trace if model.trace > 0 else None for e in model.values]

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            centred = model.centred(_matrix(batch.column("x"), dim))
            w, exact = model.whitened(centred), model.deviations(centred)
            m = batch.num_rows
            ids = batch.column("vec_id").take(pa.array(np.repeat(np.arange(m), parts)))
            long = pa.array([v if v <= LONG else None for v in exact for _ in range(parts)], pa.int64())
            digits = pa.array([None if v <= LONG else str(v) for v in exact for _ in range(parts)], pa.string())
            columns = [ids, pa.array(np.tile(np.arange(1, parts + 1, dtype=np.int32), m)), pa.array(np.full(m * parts, model.n)), long]
            columns += [pa.array(w.ravel(), from_pandas=True), pa.array(explained * m, pa.float64()), pa.array([error] * (m * parts), pa.float64()), digits]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_digits"])

    return rows.mapInArrow(run, schema)


def op11(spark, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
