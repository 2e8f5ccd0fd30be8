"""Approximate maximum inner product search: score-aware anisotropic product quantisation, four-bit scans, exact reranking."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import stage

#: Words of a codebook: what four bits can name.
WORDS = 16


@dataclass
class Codebooks:
    """``words[m, c]`` is codeword c of subspace m; vectors are padded with zeros to ``m * width`` numbers."""

    words: np.ndarray
    parallel: float

    @property
    def padded(self) -> int:
        return self.words.shape[0] * self.words.shape[2]


def usable(table: DataFrame, id_column: str, vector: str) -> DataFrame:
    """``vec_id`` and ``vector`` (doubles) of rows with an id and a vector that is not null, empty or zero and whose
    numbers are all finite. Vectors of another length than the most common one take no part either."""
    v = F.col(vector).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = table.select(F.col(id_column).cast("long").alias("vec_id"), v.alias("vector")).filter(F.col("vec_id").isNotNull() & F.col("vector").isNotNull())
    return rows.filter(fine)


def _blocks(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    out = np.zeros((len(x), words.shape[0] * words.shape[2]))
    out[:, : x.shape[1]] = x
    return out.reshape(len(x), words.shape[0], words.shape[2])


def encode(x: np.ndarray, books: Codebooks, sweeps: int = 3) -> np.ndarray:
    """Codes of each row: by coordinate descent, the codewords that make |residual|² + (parallel-1)·(residual·x/|x|)² least.

    ``parallel`` over 1 makes residual error along the vector, which shifts its large inner products, cost more.
    """
    words, own = books.words, _blocks(x, books.words)
    unit = own / np.maximum(np.linalg.norm(x, axis=1), 1e-300)[:, None, None]
    square = ((own[:, :, None, :] - words[None]) ** 2).sum(-1)  # rows, subspaces, codewords
    along = (own * unit).sum(-1)[:, :, None] - np.einsum("nmd,mcd->nmc", unit, words)
    code = square.argmin(-1)
    at = np.arange(len(x))
    for _ in range(sweeps):
        total = np.take_along_axis(along, code[:, :, None], 2)[:, :, 0].sum(1)
        for m in range(words.shape[0]):
            rest = total - along[at, m, code[:, m]]
            code[:, m] = (square[:, m] + (books.parallel - 1) * (rest[:, None] + along[:, m]) ** 2).argmin(-1)
            total = rest + along[at, m, code[:, m]]
    return code.astype(np.uint8)


def train(x: np.ndarray, width: int = 2, parallel: float = 4.0, rounds: int = 8, seed: int = 0) -> Codebooks:
    """Codebooks of a bounded sample: k-means in each subspace, then rounds of :func:`encode` and the weighted least
    squares that gives all codewords at once for these codes under the same loss."""
    rng = np.random.default_rng(seed)
    m = -(-x.shape[1] // width)
    books = Codebooks(np.zeros((m, WORDS, width)), parallel)
    own = _blocks(x, books.words)
    for k in range(m):
        part = own[:, k]
        words = part[rng.choice(len(part), WORDS, replace=len(part) < WORDS)].copy()
        for _ in range(12):
            near = ((part[:, None] - words[None]) ** 2).sum(-1).argmin(1)
            n = np.bincount(near, minlength=WORDS)
            for d in range(width):
                words[:, d] = np.where(n > 0, np.bincount(near, weights=part[:, d], minlength=WORDS) / np.maximum(n, 1), words[:, d])
        books.words[k] = words
    unit = own / np.linalg.norm(x, axis=1)[:, None, None]
    size = m * WORDS * width
    for _ in range(rounds if parallel != 1 else 0):
        code = encode(x, books)
        column = ((np.arange(m) * WORDS)[None, :, None] + code[:, :, None]) * width + np.arange(width)
        gram, right = np.zeros((size, size)), np.zeros(size)
        for a in range(0, len(x), 2048):
            u = np.zeros((len(column[a : a + 2048]), size))
            np.put_along_axis(u, column[a : a + 2048].reshape(len(u), -1), unit[a : a + 2048].reshape(len(u), -1), 1)
            gram += (parallel - 1) * (u.T @ u)
        gram[np.arange(size), np.arange(size)] += np.bincount(column.ravel(), minlength=size) + 1e-6
        right = parallel * np.bincount(column.ravel(), weights=own.ravel(), minlength=size) + 1e-6 * books.words.ravel()
        books.words = np.linalg.solve(gram, right).reshape(m, WORDS, width)
    return books


def packed(code: np.ndarray) -> np.ndarray:
    """Codes of two neighbouring subspaces in each byte."""
    code = np.pad(code, ((0, 0), (0, code.shape[1] % 2)))
    return code[:, ::2] * np.uint8(WORDS) + code[:, 1::2]


def scan(queries: np.ndarray, code: np.ndarray, books: Codebooks) -> Iterator[np.ndarray]:
    """For each query, approximate inner products with all rows of :func:`packed` codes: sums of table entries by four-bit
    code. The two 16-entry tables of a byte's codes become one of 256.
    """
    m = books.words.shape[0]
    pairs = [np.ascontiguousarray(code[:, k]).astype(np.intp) for k in range(code.shape[1])]
    own = _blocks(queries, books.words)
    tables = np.einsum("qmd,mcd->qmc", own, books.words).astype(np.float32)
    for table in tables:
        total = np.zeros(len(code), np.float32)
        for k, pair in enumerate(pairs):
            high, low = table[2 * k], table[2 * k + 1] if 2 * k + 1 < m else np.zeros(WORDS, np.float32)
            total += (high[:, None] + low[None]).ravel()[pair]
        yield total


def _best(score: np.ndarray, n: int) -> np.ndarray:
    """Places of the n largest, ties to the first place."""
    if len(score) <= n:
        return np.arange(len(score))
    least = np.partition(score, len(score) - n)[len(score) - n]
    over = np.flatnonzero(score > least)
    return np.concatenate([over, np.flatnonzero(score == least)[: n - len(over)]])


def _exact(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products in double precision, summed in the order of the components."""
    total = np.zeros(len(rows))
    for d in range(rows.shape[1]):
        total += query[d] * rows[:, d]
    return total


RESULT = "query_id long, vec_id long, score double"


def search(table: DataFrame, is_query, k: int = 20, id_column: str = "vec_id", vector: str = "embedding", rerank: int = 400, sample: int = 8192, block: int = 16_384, query_block: int = 16_384) -> DataFrame:
    """Each query's ``k`` nearest other rows by inner product: query_id, rank, vec_id, score.

    ``is_query`` is a condition on ``vec_id``. The codebooks are fitted on at most ``sample`` vectors, those of smallest
    hash; every vector is coded, once, and staged with its codes (two to a byte). Blocks of vectors meet blocks of queries
    in separate tasks; each task scans codes, scores the ``rerank`` best exactly on the original vectors, and hands on its
    best ``k``, so no task holds more than two blocks. A vector travels once for each block of queries. Ties go to the smaller vec_id. Fewer candidates than ``k`` give fewer rows, no usable vector gives none. A
    repeated vec_id is one candidate per row; a query's own rows are those with its vec_id.
    """
    rows = stage(usable(table, id_column, vector))
    n = rows.count()
    spark = rows.sparkSession
    some = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("vector").toArrow().column("vector").to_pylist()
    if not some:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width = max(map(len, some), key=[len(v) for v in some].count)
    books = spark.sparkContext.broadcast(train(np.array([v for v in some if len(v) == width])))
    rows = rows.filter(F.size("vector") == width)


    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                some = batch.slice(a, 4096)
                code = packed(encode(_matrix(some), books.value))
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array([c.tobytes() for c in code], pa.binary())], names=["vec_id", "vector", "code"])

    asked = rows.filter(is_query)
    rows = stage(rows.mapInArrow(coded, "vec_id long, vector array<double>, code binary"))
    blocks = max(1, -(-n // block))
    query_blocks = max(1, -(-asked.count() // query_block))
    own = rows.withColumn("block", F.pmod(F.xxhash64("vec_id", "vector"), F.lit(blocks))).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    asked = asked.withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(query_blocks)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by("vec_id")
        ids, x = left.column("vec_id").to_numpy(), _matrix(left)
        asked_ids, q = right.column("vec_id").to_numpy(), _matrix(right)
        found_q, found_v, found_s = [], [], []
        if len(ids) and len(asked_ids):
            code = np.frombuffer(b"".join(left.column("code").to_pylist()), np.uint8).reshape(len(ids), -1)
            for query, vec, approx in zip(asked_ids, q, scan(q, code, books.value)):
                approx[np.searchsorted(ids, query) : np.searchsorted(ids, query, side="right")] = -np.inf
                at = _best(approx, rerank)
                at = np.sort(at[ids[at] != query])
                exact = _exact(vec, x[at])
                top = np.lexsort((ids[at], -exact))[:k]
                found_q.append(np.full(len(top), query)), found_v.append(ids[at][top]), found_s.append(exact[top])
        return pa.table({"query_id": np.concatenate(found_q) if found_q else np.empty(0, np.int64), "vec_id": np.concatenate(found_v) if found_v else np.empty(0, np.int64), "score": np.concatenate(found_s) if found_s else np.empty(0)})

    keys = ["block", "part"]
    found = own.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(meet, RESULT)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _matrix(table: pa.Table | pa.RecordBatch) -> np.ndarray:
    n = table.num_rows
    if not n:
        return np.empty((0, 0))
    column = table.column("vector")
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten()).reshape(n, -1)
