"""Clustering: Lloyd's iteration as joins and averages, its variants, and predicate signatures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import vectors as V
from tessella.operators.search import assign, build_lists


def sample(docs: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """``n`` documents by smallest hash: the same whatever the order or partitioning."""
    return docs.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(n)


def _vector_mean(rows: DataFrame, key: str, weight: str | None = None) -> DataFrame:
    """(Weighted) mean vector of each key: each task adds up its own, one row a key, and those rows alone are exchanged."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    own = rows.select(F.col(key).cast("long").alias("key"), w.alias("w"), V.doubles("vec").alias("vec")).filter("key is not null")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, at = np.unique(batch.column("key").to_numpy(), return_inverse=True)
            w = batch.column("w").to_numpy()
            x = np.asarray(batch.column("vec").flatten()).reshape(batch.num_rows, -1) * w[:, None]
            order = np.argsort(at, kind="stable")
            parts = np.add.reduceat(x[order], np.searchsorted(at[order], np.arange(len(keys))), axis=0)
            for k, part, weight in zip(keys.tolist(), parts, np.bincount(at, weights=w)):
                held = sums.setdefault(k, [0.0, 0.0])
                held[0], held[1] = held[0] + part, held[1] + weight
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([v[1] for v in sums.values()]), pa.array([v[0] for v in sums.values()], pa.list_(pa.float64()))], names=["key", "w", "vec"])

    def mean(table: pa.Table) -> pa.Table:
        x = np.asarray(table.column("vec").combine_chunks().flatten()).reshape(table.num_rows, -1)
        total = x.sum(0) / table.column("w").to_numpy().sum()
        return pa.table({"key": table.column("key").slice(0, 1), "cvec": pa.array([total], pa.list_(pa.float64()))})

    found = own.mapInArrow(add, "key long, w double, vec array<double>").groupBy("key").applyInArrow(mean, "key long, cvec array<double>")
    return found.select(F.col("key").cast(rows.schema[key].dataType).alias(key), "cvec")


def first_centroids(docs: DataFrame, n: int, seed: int | None = None) -> DataFrame:
    """``n`` documents as centroids: those of the lowest ids, or of the smallest hash with ``seed``."""
    some = (docs.orderBy("doc_id").limit(n) if seed is None else sample(docs, n, seed)).select("doc_id", "vec")
    order = Window.orderBy("doc_id" if seed is None else F.xxhash64("doc_id", F.lit(seed)))
    return some.select((F.row_number().over(order) - 1).alias("list_no"), V.doubles("vec").alias("cvec"))


def lloyd_step(docs: DataFrame, centroids: DataFrame, metric: str = "l2", spherical: bool = False, rounded: bool = False, frozen: int = 0, weight: str | None = None) -> DataFrame:
    """Centroids after one assignment and averaging. Lists numbered under ``frozen`` stay as they are; an empty list keeps
    its centroid; ``spherical`` normalises, ``rounded`` rounds the components."""
    means = _vector_mean(build_lists(docs, centroids, metric), "list_no", weight)
    if spherical:
        means = means.withColumn("cvec", V.normalize("cvec"))
    if rounded:
        means = means.withColumn("cvec", F.transform("cvec", lambda x: F.round(x)))
    rows = centroids.join(means.withColumnRenamed("cvec", "moved"), "list_no", "left")
    return rows.select("list_no", F.when(F.col("list_no") < frozen, F.col("cvec")).otherwise(F.coalesce("moved", "cvec")).alias("cvec"))


def split_empty(docs: DataFrame, centroids: DataFrame, metric: str = "l2") -> DataFrame:
    """Empty lists take the centroids of the largest ones, both moved a little apart (1/1024, by turns up and down)."""
    sizes = assign(docs, centroids, metric).groupBy("list_no").agg(F.count("*").alias("n"))
    rows = {r.list_no: (list(r.cvec), r.n or 0) for r in centroids.join(sizes, "list_no", "left").collect()}
    empty = sorted(i for i, (_, n) in rows.items() if not n)
    size = {i: n for i, (_, n) in rows.items()}
    for i in empty:
        big = max(size, key=lambda j: (size[j], -j))
        if size[big] < 2:
            break
        old = np.array(rows[big][0])
        sway = np.where(np.arange(len(old)) % 2 == 0, 1 + 1 / 1024, 1 - 1 / 1024)
        rows[i], rows[big] = ((old * sway).tolist(), 0), ((old * (2 - sway)).tolist(), 0)
        size[i], size[big] = size[big] // 2, size[big] - size[big] // 2
    return docs.sparkSession.createDataFrame([(i, c) for i, (c, _) in sorted(rows.items())], "list_no int, cvec array<double>")


def _settle(df: DataFrame) -> DataFrame:
    """Centroids as constants: a table of fixed size goes through the driver, so a loop's plan does not grow."""
    rows = [(r.list_no, list(r.cvec)) for r in df.collect()]
    return df.sparkSession.createDataFrame(rows, "list_no int, cvec array<double>")


def kmeans(docs: DataFrame, n: int, rounds: int = 10, metric: str = "l2", spherical: bool = False, seed: int | None = None, most_per_list: int = 256, init: DataFrame | None = None, split: bool = True, **step) -> DataFrame:
    """``n`` centroids (list_no, cvec) after ``rounds`` steps over at most ``most_per_list`` documents a list."""
    rows = sample(docs, n * most_per_list).persist()
    centroids = _settle(init if init is not None else first_centroids(rows, n, seed))
    for _ in range(rounds):
        centroids = _settle(lloyd_step(rows, centroids, metric, spherical, **step))
        if split:
            centroids = split_empty(rows, centroids, metric)
    rows.unpersist()
    return centroids


def objective(docs: DataFrame, centroids: DataFrame, metric: str = "l2") -> DataFrame:
    return assign(docs, centroids, metric).agg(F.sum("score").alias("objective"))


def two_level(docs: DataFrame, coarse: int, fine: int, rounds: int = 5, metric: str = "l2") -> DataFrame:
    """``coarse`` lists, each split into ``fine``: centroids numbered coarse·fine + inner."""
    top = kmeans(docs, coarse, rounds, metric)
    lists = build_lists(docs, top, metric).persist()
    out = None
    for i in range(coarse):
        own = kmeans(lists.filter(F.col("list_no") == i).select("doc_id", "vec"), fine, rounds, metric).withColumn("list_no", F.col("list_no") + i * fine)
        out = own if out is None else out.unionByName(own)
    out = _settle(out)
    lists.unpersist()
    return out


def kmeans_1d(values: DataFrame, n: int, column: str = "x") -> list[float]:
    """Exact one-dimensional k-means on the distinct values and their counts (at most 20,000 of them), by dynamic
    programming over the sorted values; split points only move up, so each layer is solved by halving."""
    rows = values.groupBy(column).agg(F.count("*").alias("w")).orderBy(column).limit(20_001).collect()
    if len(rows) > 20_000:
        raise ValueError("more than 20,000 distinct values; round or sample them first")
    x, w = np.array([r[column] for r in rows], float), np.array([r.w for r in rows], float)
    m, n = len(x), min(n, len(x))
    sw, sx, sxx = (np.concatenate([[0], np.cumsum(v)]) for v in (w, w * x, w * x * x))

    def cost(a: np.ndarray, b: int) -> np.ndarray:
        weight = sw[b] - sw[a]
        return sxx[b] - sxx[a] - (sx[b] - sx[a]) ** 2 / np.where(weight > 0, weight, 1)

    best = np.array([cost(np.array([0]), b)[0] if b else 0.0 for b in range(m + 1)])
    cuts = []
    for _ in range(1, n):
        new, cut = np.full(m + 1, np.inf), np.zeros(m + 1, int)
        todo = [(1, m, 0, m)]
        while todo:
            low, high, first, last = todo.pop()
            if low > high:
                continue
            mid = (low + high) // 2
            a = np.arange(first, min(last, mid) + 1)
            total = best[a] + cost(a, mid)
            k = int(total.argmin())
            new[mid], cut[mid] = total[k], a[k]
            todo += [(low, mid - 1, first, a[k]), (mid + 1, high, a[k], last)]
        new[0] = 0
        best = new
        cuts.append(cut)
    ends = [m]
    for cut in reversed(cuts):
        ends.append(int(cut[ends[-1]]))
    ends = sorted({0, *ends})
    return [float((sx[b] - sx[a]) / (sw[b] - sw[a])) for a, b in zip(ends, ends[1:])]


def progressive(docs: DataFrame, n: int, dims: list[int], rounds: int = 3, metric: str = "l2") -> DataFrame:
    """k-means on the leading dimensions first, each step starting from the lists of the one before."""
    lists = None
    for d in dims:
        cut = docs.select("doc_id", F.slice("vec", 1, d).alias("vec"))
        start = None if lists is None else _vector_mean(cut.join(lists, "doc_id"), "list_no")
        centroids = kmeans(cut, n, rounds, metric, init=start, split=False)
        if lists is not None:
            lists.unpersist()
        lists = assign(cut, centroids, metric).select("doc_id", "list_no").persist()
    if lists is not None:
        lists.unpersist()
    return centroids


def residuals(lists: DataFrame, centroids: DataFrame) -> DataFrame:
    """Documents with what their centroid leaves of them."""
    return lists.join(F.broadcast(centroids), "list_no").withColumn("vec", V.subtract("vec", "cvec")).drop("cvec")


def signatures(fit_legal: DataFrame, n_queries: int, docs: DataFrame, dims: int, alpha: float) -> DataFrame:
    """``docs`` with ``sig``: a short vector that says which fit queries may see a document, of length ``alpha``.

    The queries' Gram matrix (how many documents each two share, at most 512×512) is decomposed on the driver; a
    document's signature is the sum of its queries' rows of U/√s, normalised. Zeros if ``dims`` or ``alpha`` is 0 or no
    query sees it.
    """
    zeros = F.array_repeat(F.lit(0.0), dims)
    if not dims or not alpha:
        return docs.withColumn("sig", zeros)
    if n_queries > 512:
        raise ValueError("at most 512 fit queries")
    other = fit_legal.select(F.col("qid").alias("other"), "doc_id")
    gram = np.zeros((n_queries, n_queries))
    for r in fit_legal.select("qid", "doc_id").join(other, "doc_id").groupBy("qid", "other").count().collect():
        gram[r.qid, r.other] = r["count"]
    value, vector = np.linalg.eigh(gram)
    top = np.argsort(-value)[:dims]
    root = np.sqrt(np.maximum(value[top], 0)) ** 0.5  # square root of the mask's singular values
    rows = vector[:, top] / np.where(root > 1e-9, root, np.inf)
    rows = np.pad(rows, ((0, 0), (0, dims - rows.shape[1])))
    table = docs.sparkSession.createDataFrame([(q, [float(x) for x in r]) for q, r in enumerate(rows)], "qid long, vec array<double>")
    summed = fit_legal.join(F.broadcast(table), "qid").select("doc_id", F.posexplode("vec").alias("pos", "x")).groupBy("doc_id", "pos").agg(F.sum("x").alias("x"))
    sums = summed.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("__s"))
    scaled = F.transform("__s", lambda x: F.lit(alpha) * x / (V.norm("__s") + 1e-9))
    return docs.join(sums, "doc_id", "left").withColumn("sig", F.coalesce(F.when(F.col("__s").isNotNull(), scaled), zeros)).drop("__s")


def with_signature(docs: DataFrame) -> DataFrame:
    """Vectors with their signature behind them: what predicate-aware clustering sees."""
    return docs.withColumn("vec", F.concat(V.normalize("vec"), "sig")).drop("sig")
