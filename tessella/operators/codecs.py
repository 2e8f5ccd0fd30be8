"""Vector codecs: fitted on a bounded sample, encoding to small integers in Arrow batches, decoding back."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import vectors as V
from tessella.operators.search import meet
from tessella.operators.topk import top_k
from tessella.operators.transforms import _sample, random_rotation


def _kmeans(x: np.ndarray, n: int, rounds: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    words = x[rng.choice(len(x), n, replace=len(x) < n)].copy()
    for _ in range(rounds):
        near = nearest(x, words)
        count = np.bincount(near, minlength=n)
        sums = np.zeros_like(words)
        np.add.at(sums, near, x)
        words = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], words)
    return words


def nearest(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    return ((words * words).sum(1)[None] - 2 * x @ words.T).argmin(1)


class Codec:
    """``encode``/``decode`` on matrices; the methods below lift them to tables."""

    def encode(self, x: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def decode(self, code: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def encoded(self, df: DataFrame, vec: str = "vec", code: str = "code") -> DataFrame:
        @F.pandas_udf("array<int>")
        def run(v):
            import pandas as pd

            return pd.Series(list(self.encode(np.array(v.tolist(), float).reshape(len(v), -1)).astype(np.int32)))

        return df.withColumn(code, run(V.doubles(vec)))

    def decoded(self, df: DataFrame, code: str = "code", vec: str = "vec") -> DataFrame:
        @F.pandas_udf("array<double>")
        def run(c):
            import pandas as pd

            return pd.Series(list(self.decode(np.array(c.tolist()).reshape(len(c), -1))))

        return df.withColumn(vec, run(code))

    def search(self, coded: DataFrame, queries: DataFrame, k: int, metric: str = "l2") -> DataFrame:
        """Search of decoded vectors."""
        rows = meet(self.decoded(coded), queries).select("qid", "doc_id", V.distance(metric, "qvec", "vec").alias("score"))
        return top_k(rows, k, V.is_similarity(metric))


@dataclass
class ScalarQuantizer(Codec):
    """Each number as an integer of ``bits`` bits between its dimension's (or, uniform, all dimensions') bounds."""

    low: np.ndarray
    high: np.ndarray
    bits: int = 8

    @classmethod
    def fit(cls, docs: DataFrame, bits: int = 8, bounds: str = "minmax", arg: float = 0.0, uniform: bool = False, most: int = 20_000) -> ScalarQuantizer:
        """Bounds from a sample: ``minmax`` (widened by ``arg`` of the span), ``meanstd`` (mean ± arg·deviation),
        ``quantiles`` (arg and 1-arg), or ``optim`` (the grid that loses least)."""
        x = _sample(docs, most)
        x = x.reshape(-1, 1) if uniform else x
        if bounds == "minmax":
            low, high = x.min(0), x.max(0)
            low, high = low - arg * (high - low), high + arg * (high - low)
        elif bounds == "meanstd":
            low, high = x.mean(0) - (arg or 3) * x.std(0), x.mean(0) + (arg or 3) * x.std(0)
        elif bounds == "quantiles":
            low, high = np.quantile(x, arg, axis=0), np.quantile(x, 1 - arg, axis=0)
        elif bounds == "optim":
            low, high = x.min(0), x.max(0)
            top = 2**bits - 1
            for _ in range(10):
                code = np.clip(np.floor((x - low) / np.maximum(high - low, 1e-12) * top + 0.5), 0, top)
                m, v = code.mean(0), np.maximum(code.var(0), 1e-12)
                step = ((code - m) * (x - x.mean(0))).mean(0) / v
                low = x.mean(0) - step * m
                high = low + step * top
        else:
            raise ValueError(bounds)
        return cls(low, high, bits)

    def encode(self, x: np.ndarray) -> np.ndarray:
        top = 2**self.bits - 1
        return np.clip(np.floor((x - self.low) / np.maximum(self.high - self.low, 1e-12) * top + 0.5), 0, top)

    def decode(self, code: np.ndarray) -> np.ndarray:
        return self.low + code * (self.high - self.low) / (2**self.bits - 1)

    def expression(self, vec: str = "vec") -> Column:
        """Encoding as a Column expression, without Python."""
        top = 2**self.bits - 1
        bounds = F.array(*[F.struct(F.lit(float(a)).alias("low"), F.lit(float(max(b - a, 1e-12))).alias("span")) for a, b in zip(self.low, self.high)])
        return F.zip_with(vec, bounds, lambda x, b: F.greatest(F.lit(0), F.least(F.lit(top), F.floor((x.cast("double") - b["low"]) / b["span"] * top + 0.5).cast("int"))))


class HalfFloat(Codec):
    """Half-precision numbers, as their 16 bits; ``brain`` keeps float's exponent instead."""

    def __init__(self, brain: bool = False):
        self.brain = brain

    def encode(self, x: np.ndarray) -> np.ndarray:
        if not self.brain:
            return x.astype(np.float16).view(np.uint16).astype(np.int64)
        bits = x.astype(np.float32).view(np.uint32).astype(np.int64)
        return (bits + 0x7FFF + (bits >> 16 & 1)) >> 16

    def decode(self, code: np.ndarray) -> np.ndarray:
        if not self.brain:
            return code.astype(np.uint16).view(np.float16).astype(float)
        return (code.astype(np.uint32) << 16).view(np.float32).astype(float)


class Direct(Codec):
    """Whole numbers as they are: 0..255, or -128..127 signed."""

    def __init__(self, signed: bool = False):
        self.low, self.high = (-128, 127) if signed else (0, 255)

    def encode(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.trunc(x), self.low, self.high)

    def decode(self, code: np.ndarray) -> np.ndarray:
        return code.astype(float)


@dataclass
class ProductQuantizer(Codec):
    """Each of ``parts`` equal stretches of the vector as its nearest codeword."""

    books: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray | DataFrame, parts: int, words: int = 256, rounds: int = 10, seed: int = 0, most: int = 20_000) -> ProductQuantizer:
        x = _sample(x, most) if isinstance(x, DataFrame) else x
        if x.shape[1] % parts:
            raise ValueError("the dimension must be a multiple of the parts")
        return cls(np.stack([_kmeans(p, words, rounds, seed) for p in np.split(x, parts, axis=1)]))

    def encode(self, x: np.ndarray) -> np.ndarray:
        return np.stack([nearest(p, b) for p, b in zip(np.split(x, len(self.books), axis=1), self.books)], axis=1)

    def decode(self, code: np.ndarray) -> np.ndarray:
        return np.concatenate([b[c] for b, c in zip(self.books, code.T)], axis=1)

    def tables(self, q: np.ndarray, metric: str = "l2") -> np.ndarray:
        """Distances of one query's stretches to all codewords."""
        parts = q.reshape(len(self.books), 1, -1)
        return ((parts - self.books) ** 2).sum(2) if metric == "l2" else (parts * self.books).sum(2)

    def symmetric(self) -> np.ndarray:
        """Squared distances between codewords of each part."""
        return ((self.books[:, :, None] - self.books[:, None]) ** 2).sum(3)

    def search(self, coded: DataFrame, queries: DataFrame, k: int, metric: str = "l2", probes: DataFrame | None = None, on: Column | None = None) -> DataFrame:
        """Asymmetric search: every code's distance is a sum of entries of the query's tables. With ``probes`` (qid, list_no)
        only codes in the probed lists are met; ``on`` is a condition on query and document."""
        n, m = self.books.shape[1], len(self.books)

        @F.pandas_udf("array<double>")
        def table(v):
            import pandas as pd

            return pd.Series([self.tables(np.asarray(q, float), metric).ravel() for q in v])

        asked = queries.withColumn("__table", table(V.doubles("qvec")))
        terms = F.transform("code", lambda c, i: F.get("__table", i * n + c))
        assert m
        if probes is None:
            pairs = meet(coded, asked, on)
        else:
            pairs = coded.join(probes.filter("list_no >= 0").select("qid", "list_no").join(asked, "qid"), "list_no")
            pairs = pairs if on is None else pairs.filter(on)
        return top_k(pairs.select("qid", "doc_id", F.aggregate(terms, F.lit(0.0), lambda s, x: s + x).alias("score")), k, V.is_similarity(metric))


    def permuted(self, orders: list[np.ndarray]) -> ProductQuantizer:
        """The same words under other numbers: word ``orders[m][i]`` of part m becomes word i."""
        return ProductQuantizer(np.stack([b[o] for b, o in zip(self.books, orders)]))

    def polysemous(self, rounds: int = 2_000, seed: int = 0) -> ProductQuantizer:
        """The same words numbered so that numbers of near words differ in few bits: swaps that lower the squared error
        between Hamming distances and scaled distances of words, each part by itself."""
        rng, orders = np.random.default_rng(seed), []
        for own in self.symmetric():
            n = len(own)
            bits = np.bitwise_count(np.arange(n)[:, None] ^ np.arange(n)[None]).astype(float)
            goal = own * (bits.mean() / max(own.mean(), 1e-12))
            weight = np.exp(-goal)
            order = np.arange(n)
            loss = (weight * (goal - bits) ** 2).sum()
            for _ in range(rounds):
                i, j = rng.integers(0, n, 2)
                order[[i, j]] = order[[j, i]]
                new = (weight[np.ix_(order, order)] * (goal[np.ix_(order, order)] - bits) ** 2).sum()
                if new < loss:
                    loss = new
                else:
                    order[[i, j]] = order[[j, i]]
            orders.append(order)
        return self.permuted(orders)


def quantise_tables(tables: np.ndarray, bits: int = 8) -> tuple[np.ndarray, float, float]:
    """Distance tables (parts, words) as small whole numbers: with the result q, scale a and sum b of the parts' least
    entries, a row's distance is about b + (sum of its q) / a."""
    low = tables.min(1, keepdims=True)
    a = (2**bits - 1) / max(float((tables - low).max()), 1e-12)
    return np.floor((tables - low) * a + 0.5).astype(np.uint8 if bits <= 8 else np.uint16), a, float(low.sum())


def fast_scan(codec: ProductQuantizer, coded: DataFrame, queries: DataFrame, k: int, keep: int = 4) -> DataFrame:
    """Search (L2) by tables of bytes over codes of at most 16 words a part, two parts to a look-up, in Arrow batches; the best
    ``keep`` times ``k`` by bytes are scored again by the exact tables. At most 4,096 queries go along."""
    if codec.books.shape[1] > 16:
        raise ValueError("fast scan needs codes of four bits")
    asked = queries.select("qid", V.doubles("qvec").alias("q")).limit(4097).collect()
    if len(asked) > 4096:
        raise ValueError("more than 4,096 queries; search them in parts")
    known = [(r.qid, codec.tables(np.array(r.q, float))) for r in asked]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("doc_id").to_numpy()
            code = np.asarray(batch.column("code").flatten()).reshape(len(ids), -1)
            parts = np.arange(code.shape[1])
            pairs = code[:, ::2] * 16 + np.pad(code[:, 1::2], ((0, 0), (0, code.shape[1] % 2)))
            for qid, table in known:
                table = np.pad(table, ((0, len(table) % 2), (0, 16 - table.shape[1])))
                small, _, _ = quantise_tables(table)
                joined = (small[::2, :, None].astype(np.int32) + small[1::2, None]).reshape(len(small) // 2, 256)
                rough = joined[np.arange(len(joined)), pairs].sum(1)
                some = np.lexsort((ids, rough))[: keep * k]
                exact = table[parts, code[some]].sum(1)
                best = np.lexsort((ids[some], exact))[:k]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(best), qid)), pa.array(ids[some][best]), pa.array(exact[best])], names=["qid", "doc_id", "score"])

    return top_k(coded.select("doc_id", "code").mapInArrow(run, "qid long, doc_id long, score double"), k, False)


@dataclass
class RefinedProduct(Codec):
    """A product code and a second one of what the first leaves."""

    first: ProductQuantizer
    second: ProductQuantizer

    @classmethod
    def fit(cls, docs: np.ndarray | DataFrame, parts: int, more: int, most: int = 20_000) -> RefinedProduct:
        x = _sample(docs, most) if isinstance(docs, DataFrame) else docs
        first = ProductQuantizer.fit(x, parts)
        return cls(first, ProductQuantizer.fit(x - first.decode(first.encode(x)), more))

    def encode(self, x: np.ndarray) -> np.ndarray:
        code = self.first.encode(x)
        return np.concatenate([code, self.second.encode(x - self.first.decode(code))], axis=1)

    def decode(self, code: np.ndarray) -> np.ndarray:
        n = len(self.first.books)
        return self.first.decode(code[:, :n]) + self.second.decode(code[:, n:])


@dataclass
class ResidualQuantizer(Codec):
    """Sums of codewords, stage after stage on what is left; ``beam`` best partial codes are carried along."""

    books: list[np.ndarray]
    beam: int = 4

    @classmethod
    def fit(cls, x: np.ndarray | DataFrame, stages: int, words: int = 16, beam: int = 4, rounds: int = 10, seed: int = 0, most: int = 20_000) -> ResidualQuantizer:
        x = _sample(x, most) if isinstance(x, DataFrame) else x
        rest, books = x.copy(), []
        for s in range(stages):
            books.append(_kmeans(rest, words, rounds, seed + s))
            rest = rest - books[-1][nearest(rest, books[-1])]
        return cls(books, beam)

    def encode(self, x: np.ndarray) -> np.ndarray:
        codes, rest = np.zeros((len(x), 1, 0), int), x[:, None]
        for book in self.books:
            after = rest[:, :, None] - book[None, None]
            loss = (after**2).sum(3).reshape(len(x), -1)
            keep = np.argsort(loss, axis=1, kind="stable")[:, : self.beam]
            old, new = keep // len(book), keep % len(book)
            codes = np.concatenate([np.take_along_axis(codes, old[:, :, None], 1), new[:, :, None]], axis=2)
            rest = np.take_along_axis(rest, old[:, :, None], 1) - book[new]
        return codes[:, 0]

    def decode(self, code: np.ndarray) -> np.ndarray:
        return sum(book[c] for book, c in zip(self.books, code.T))


@dataclass
class LocalSearchQuantizer(ResidualQuantizer):
    """The same codebooks' sums, codes improved one stage at a time while the others stay, codebooks refitted at once."""

    sweeps: int = 4

    @classmethod
    def fit(cls, x, stages: int, words: int = 16, rounds: int = 5, seed: int = 0, most: int = 20_000, **_) -> LocalSearchQuantizer:
        x = _sample(x, most) if isinstance(x, DataFrame) else x
        out = cls(ResidualQuantizer.fit(x, stages, words, 1, seed=seed).books, 1)
        for _ in range(rounds):
            code = out.encode(x)
            one = np.zeros((len(x), stages * words))
            np.put_along_axis(one, code + np.arange(stages) * words, 1, axis=1)
            fitted = np.linalg.solve(one.T @ one + 1e-3 * np.eye(stages * words), one.T @ x + 1e-3 * np.concatenate(out.books))
            out.books = list(fitted.reshape(stages, words, -1))
        return out

    def encode(self, x: np.ndarray) -> np.ndarray:
        code = ResidualQuantizer.encode(self, x)
        for _ in range(self.sweeps):
            for s, book in enumerate(self.books):
                rest = x - (self.decode(code) - book[code[:, s]])
                code[:, s] = nearest(rest, book)
        return code


@dataclass
class ProductOf(Codec):
    """A codec for each of several equal stretches of the vector, codes one behind the other."""

    parts: list[Codec]
    widths: list[int]

    @classmethod
    def fit(cls, kind: type, docs: np.ndarray | DataFrame, parts: int, **args) -> ProductOf:
        x = _sample(docs, 20_000) if isinstance(docs, DataFrame) else docs
        own = [kind.fit(p, **args) for p in np.split(x, parts, axis=1)]
        return cls(own, [len(c.books) for c in own])

    def encode(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([c.encode(p) for c, p in zip(self.parts, np.split(x, len(self.parts), axis=1))], axis=1)

    def decode(self, code: np.ndarray) -> np.ndarray:
        return np.concatenate([c.decode(p) for c, p in zip(self.parts, np.split(code, np.cumsum(self.widths)[:-1], axis=1))], axis=1)


@dataclass
class RowwiseMinMax(Codec):
    """Each row scaled to 0..1 by its own bounds, kept beside the inner codec's code in thousandths of float bits."""

    inner: Codec

    def encode(self, x: np.ndarray) -> np.ndarray:
        low, high = x.min(1, keepdims=True), x.max(1, keepdims=True)
        scaled = (x - low) / np.maximum(high - low, 1e-12)
        ends = np.concatenate([low, high], axis=1).astype(np.float32).view(np.int32)
        return np.concatenate([ends, self.inner.encode(scaled)], axis=1)

    def decode(self, code: np.ndarray) -> np.ndarray:
        ends = np.ascontiguousarray(code[:, :2]).astype(np.int32).view(np.float32).astype(float)
        return ends[:, :1] + self.inner.decode(code[:, 2:]) * (ends[:, 1:] - ends[:, :1])


@dataclass
class RaBit:
    """One bit a dimension of the centred, rotated vector, with its length and the bits' share of it for unbiased estimates."""

    center: np.ndarray
    rotation: np.ndarray

    @classmethod
    def fit(cls, docs: DataFrame, seed: int = 0, most: int = 20_000) -> RaBit:
        x = _sample(docs, most)
        return cls(x.mean(0), random_rotation(x.shape[1], seed=seed).matrix)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        y = (x - self.center) @ self.rotation.T
        length = np.linalg.norm(y, axis=1)
        bits = y >= 0
        sign = np.where(bits, 1, -1) / np.sqrt(y.shape[1])
        return bits, length, (sign * y).sum(1) / np.maximum(length, 1e-12)

    def estimate(self, q: np.ndarray, bits: np.ndarray, length: np.ndarray, share: np.ndarray) -> np.ndarray:
        """Estimated squared distances of one query to all codes."""
        y = self.rotation @ (q - self.center)
        sign = np.where(bits, 1, -1) / np.sqrt(len(y))
        return length**2 + y @ y - 2 * length * (sign @ y) / np.maximum(share, 1e-12)


@dataclass
class OneBit(Codec):
    """:class:`RaBit` as stored codes: the bits, and the length and share as float bits. Searched by estimate."""

    center: np.ndarray
    rotation: np.ndarray

    @classmethod
    def fit(cls, docs: DataFrame, seed: int = 0, most: int = 20_000) -> OneBit:
        own = RaBit.fit(docs, seed, most)
        return cls(own.center, own.rotation)

    def encode(self, x: np.ndarray) -> np.ndarray:
        bits, length, share = RaBit(self.center, self.rotation).encode(x)
        floats = np.stack([length, share], axis=1).astype(np.float32).view(np.int32)
        return np.concatenate([floats, bits.astype(np.int32)], axis=1)

    def decode(self, code: np.ndarray) -> np.ndarray:
        """Of the vectors that have these bits and this length the middle one."""
        ends = np.ascontiguousarray(code[:, :2]).astype(np.int32).view(np.float32).astype(float)
        sign = np.where(code[:, 2:] > 0, 1, -1) / np.sqrt(len(self.center))
        return (sign * ends[:, :1] * ends[:, 1:]) @ self.rotation + self.center

    def search(self, coded: DataFrame, queries: DataFrame, k: int, metric: str = "l2") -> DataFrame:
        @F.pandas_udf("double")
        def estimate(qvec, code):
            import pandas as pd

            c = np.array(code.tolist())
            ends = np.ascontiguousarray(c[:, :2]).astype(np.int32).view(np.float32).astype(float)
            y = (np.array(qvec.tolist(), float) - self.center) @ self.rotation.T
            sign = np.where(c[:, 2:] > 0, 1, -1) / np.sqrt(len(self.center))
            return pd.Series(ends[:, 0] ** 2 + (y * y).sum(1) - 2 * ends[:, 0] * (sign * y).sum(1) / np.maximum(ends[:, 1], 1e-12))

        rows = meet(coded.select("doc_id", "code"), queries).select("qid", "doc_id", estimate(V.doubles("qvec"), "code").alias("score"))
        return top_k(rows, k, False)


@dataclass
class SignBits(Codec):
    """Sign bits of (rotated) dimensions, cut at 0 or at medians, searched by the number of differing bits."""

    matrix: np.ndarray
    cut: np.ndarray

    @classmethod
    def fit(cls, docs: DataFrame, bits: int | None = None, rotate: bool = False, thresholds: bool = False, seed: int = 0, most: int = 20_000) -> SignBits:
        x = _sample(docs, most)
        n = bits or x.shape[1]
        matrix = random_rotation(x.shape[1], n, seed).matrix if rotate or n > x.shape[1] else np.eye(x.shape[1])[:n]
        return cls(matrix, np.median(x @ matrix.T, axis=0) if thresholds else np.zeros(n))

    def encode(self, x: np.ndarray) -> np.ndarray:
        return (x @ self.matrix.T >= self.cut).astype(int)

    def decode(self, code: np.ndarray) -> np.ndarray:
        return np.where(code > 0, 1.0, -1.0) @ self.matrix

    def search(self, coded: DataFrame, queries: DataFrame, k: int, metric: str = "l2") -> DataFrame:
        asked = self.encoded(queries, "qvec", "qcode").select("qid", "qcode")
        rows = meet(coded.select("doc_id", "code"), asked).select("qid", "doc_id", V.generalized_hamming("qcode", "code").alias("score"))
        return top_k(rows, k, False)


def lattice_encode(x: np.ndarray, radius_squared: int) -> np.ndarray:
    """Nearest point (by angle) among whole-number vectors of squared length ``radius_squared``.

    Greedy for one row: ones go where they raise the inner product with the row's sorted magnitudes most.
    """
    out = np.zeros(x.shape, int)
    for row, own in zip(out, np.abs(x)):
        left = radius_squared
        while left > 0:
            gain = np.where(2 * row + 1 <= left, own / np.sqrt(2 * row + 1), -np.inf)
            i = int(gain.argmax())
            left -= 2 * row[i] + 1
            row[i] += 1
    return np.where(x < 0, -out, out)


def lsh(docs: DataFrame, bits: int, rotate: bool = True, thresholds: bool = False, seed: int = 0, most: int = 20_000):
    """Sign bits of (rotated) dimensions, cut at 0 or at each dimension's median: a function that adds ``code``."""
    x = _sample(docs, most)
    turn = random_rotation(x.shape[1], max(bits, 1), seed) if rotate else None
    y = (x @ turn.matrix.T if turn else x)[:, :bits]
    cut = F.array(*[F.lit(float(m)) for m in np.median(y, axis=0)]) if thresholds else None

    def run(df: DataFrame, vec: str = "vec", code: str = "code") -> DataFrame:
        out = df.withColumn("__turned", V.doubles(vec))
        out = turn.apply(out, "__turned") if turn else out
        return out.withColumn(code, V.sign_words(F.slice("__turned", 1, bits), cut)).drop("__turned")

    return run


def spectral_bits(vec: str, period: float) -> Column:
    """Bits that alternate along each dimension: 1 where floor(x / (period/2)) is even."""
    return F.transform(V.doubles(vec), lambda x: (F.pmod(F.floor(x / (period / 2)), F.lit(2)) == 0).cast("int"))


#: Codecs that a saved index may hold.
KINDS = (ScalarQuantizer, HalfFloat, Direct, ProductQuantizer, RefinedProduct, ResidualQuantizer, LocalSearchQuantizer, ProductOf, RowwiseMinMax, OneBit, SignBits)
