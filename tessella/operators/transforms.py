"""Trainable vector transforms. Each is fitted from d×d sums and applied as a Column expression."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions import vectors as V


@dataclass
class Linear:
    """y = A x + b. Sums are in element order, not a library's, whose order depends on how many rows are multiplied together:
    copies of a vector have one image wherever they are stored, and ties between them stay ties."""

    matrix: np.ndarray
    bias: np.ndarray | None = None

    def images(self, x: np.ndarray) -> np.ndarray:
        """Images of the rows of ``x``."""
        out = np.zeros((len(x), len(self.matrix)))
        columns = np.ascontiguousarray(self.matrix.T, np.float64)
        for a in range(0, len(x), 512):
            total, own = out[a : a + 512], x[a : a + 512]
            room = np.empty_like(total)
            for u, column in zip(own.T, columns):
                total += np.multiply(u[:, None], column, out=room)
        return out if self.bias is None else out + self.bias

    def apply(self, df: DataFrame, vec: str = "vec") -> DataFrame:
        images, d = self.images, self.matrix.shape[1]

        @F.pandas_udf("array<double>")
        def multiply(v):
            import pandas as pd

            there = v.notna().to_numpy()
            rows = v[there].tolist()
            if any(len(r) != d for r in rows):
                raise ValueError(f"vectors must have {d} dimensions")
            found = iter(images(np.concatenate(rows).astype(np.float64).reshape(-1, d)) if rows else ())
            return pd.Series([next(found) if t else None for t in there], dtype=object)

        return df.withColumn(vec, multiply(V.doubles(vec)))

    def reverse(self, df: DataFrame, vec: str = "vec") -> DataFrame:
        """x = Aᵀ(y - b): exact for orthonormal rows."""
        back = Linear(self.matrix.T, None if self.bias is None else -self.matrix.T @ self.bias)
        return back.apply(df, vec)


def moments(docs: DataFrame, vec: str = "vec") -> tuple[int, np.ndarray, np.ndarray]:
    """Count, mean and covariance; each task adds up its own d×d sums, which alone are sent."""

    def add(batches):
        n, first, second = 0, 0.0, 0.0
        for batch in batches:
            if batch.num_rows:
                x = np.asarray(batch.column("v").flatten()).reshape(batch.num_rows, -1)
                n, first, second = n + len(x), first + x.sum(0), second + x.T @ x
        if n:
            cells = np.concatenate([[n], first, second.ravel()])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells))), pa.array(cells)], names=["i", "x"])

    rows = docs.select(V.doubles(vec).alias("v")).mapInArrow(add, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).orderBy("i").collect()
    if not rows:
        raise ValueError("no vectors")
    cells = np.array([r.x for r in rows])
    d = int(round((-1 + np.sqrt(1 + 4 * (len(cells) - 1))) / 2))
    n, mean = cells[0], cells[1 : d + 1] / cells[0]
    return int(n), mean, cells[d + 1 :].reshape(d, d) / n - np.outer(mean, mean)


def random_rotation(d_in: int, d_out: int | None = None, seed: int = 1234) -> Linear:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(max(d_in, d_out or d_in),) * 2))
    return Linear((q * np.sign(np.diag(r)))[: d_out or d_in, :d_in])


def pca(docs: DataFrame, d_out: int, power: float = 0.0, rotate: bool = False, bins: int = 0) -> Linear:
    """Principal axes of the centred vectors; ``power`` -0.5 whitens; ``bins`` deals the axes so that each block of them
    has a like product of variances; ``rotate`` turns the result at random."""
    _, mean, cov = moments(docs)
    value, vector = np.linalg.eigh(cov)
    order = np.argsort(-value)
    value, axes = value[order], vector[:, order].T
    axes *= np.where(axes[np.arange(len(axes)), np.abs(axes).argmax(1)] < 0, -1, 1)[:, None]
    axes, value = axes[:d_out], np.maximum(value[:d_out], 1e-12)
    if bins:
        own: list[list[int]] = [[] for _ in range(bins)]
        load = np.zeros(bins)
        for i in range(d_out):
            b = min((b for b in range(bins) if len(own[b]) < d_out // bins), key=lambda b: load[b])
            own[b].append(i)
            load[b] += np.log(value[i])
        pick = [i for b in own for i in b]
        axes, value = axes[pick], value[pick]
    matrix = axes * (value**power)[:, None]
    if rotate:
        matrix = random_rotation(d_out).matrix @ matrix
    return Linear(matrix, -matrix @ mean)


def itq(docs: DataFrame, rounds: int = 20, seed: int = 0, most: int = 20_000) -> Linear:
    """The rotation that brings a bounded sample of centred vectors nearest to ±1 corners, by turns signs and rotation."""
    x = _sample(docs, most)
    mean = x.mean(0)
    x = x - mean
    r = np.linalg.qr(np.random.default_rng(seed).normal(size=(x.shape[1],) * 2))[0]
    for _ in range(rounds):
        u, _, w = np.linalg.svd(np.where(x @ r >= 0, 1.0, -1.0).T @ x)
        r = (u @ w).T
    return Linear(r.T, -r.T @ mean)


def opq(docs: DataFrame, parts: int, words: int = 16, rounds: int = 10, seed: int = 0, most: int = 20_000) -> Linear:
    """The rotation under which product quantisation loses least, by turns codes and rotation, on a bounded sample."""
    from tessella.operators.codecs import ProductQuantizer

    x = _sample(docs, most)
    r = random_rotation(x.shape[1], seed=seed).matrix
    for _ in range(rounds):
        y = x @ r.T
        q = ProductQuantizer.fit(y, parts, words, rounds=4, seed=seed)
        u, _, w = np.linalg.svd(x.T @ q.decode(q.encode(y)))
        r = (u @ w).T
    return Linear(r)


def _sample(docs: DataFrame, most: int, vec: str = "vec") -> np.ndarray:
    rows = docs.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select(V.doubles(vec).alias("v")).toArrow().column("v").combine_chunks()
    lengths = rows.value_lengths().fill_null(-1).to_numpy()
    if len(lengths) and (lengths != lengths[0]).any():
        raise ValueError("vectors must be of one dimension")
    return np.asarray(rows.flatten()).astype(float).reshape(len(rows), -1)


def remap(dims: list[int]):
    """Dimension ``i`` of the result is dimension ``dims[i]`` of the input, or 0 for -1."""
    return lambda df, vec="vec": df.withColumn(vec, F.array(*[F.lit(0.0) if i < 0 else F.get(vec, F.lit(i)).cast("double") for i in dims]))


def pad(d: int):
    return lambda df, vec="vec": df.withColumn(vec, F.concat(V.doubles(vec), F.array_repeat(F.lit(0.0), F.lit(d) - F.size(vec))))


def normalization(df: DataFrame, vec: str = "vec") -> DataFrame:
    return df.withColumn(vec, V.normalize(vec))


def centering(docs: DataFrame) -> Linear:
    _, mean, _ = moments(docs)
    return Linear(np.eye(len(mean)), -mean)


@dataclass
class Chain:
    """Transforms one after another; undone from the last to the first where they can be."""

    steps: list = field(default_factory=list)

    def apply(self, df: DataFrame, vec: str = "vec") -> DataFrame:
        for s in self.steps:
            df = s.apply(df, vec) if isinstance(s, Linear) else s(df, vec)
        return df

    def reverse(self, df: DataFrame, vec: str = "vec") -> DataFrame:
        for s in reversed(self.steps):
            if isinstance(s, Linear):
                df = s.reverse(df, vec)
        return df
