import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import ann


def brute(rows, k, every):
    out = {}
    for q, v in rows:
        if q % every == 0:
            scored = sorted(((-float(np.dot(v, w)), i) for i, w in rows if i != q))[:k]
            out[q] = [(i, -s) for s, i in scored]
    return out


def test_encode_finds_the_least_loss():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(6, 4))
    books = ann.train(rng.normal(size=(200, 4)), width=2, parallel=3.0)
    code = ann.encode(x, books, sweeps=30)
    for row, c in zip(x, code):
        def loss(a, b):
            r = row - np.concatenate([books.words[0, a], books.words[1, b]])
            return (r**2).sum() + 2 * (r @ row / np.linalg.norm(row)) ** 2
        got = loss(*c)
        assert all(got <= loss(a, c[1]) + 1e-12 and got <= loss(c[0], a) + 1e-12 for a in range(16))


def test_penalty_lowers_parallel_error():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    error = []
    for parallel in (1.0, 6.0):
        books = ann.train(x, parallel=parallel)
        code = ann.encode(x, books)
        decoded = books.words[np.arange(8)[None], code].reshape(len(x), -1)
        error.append((((x - decoded) * x).sum(1) ** 2).mean())
    assert error[1] < error[0]


def test_scan_sums_the_tables():
    rng = np.random.default_rng(2)
    x, q = rng.normal(size=(50, 7)), rng.normal(size=(3, 7))
    books = ann.train(x, width=2)
    code = ann.encode(x, books)
    decoded = books.words[np.arange(4)[None], code].reshape(len(x), -1)[:, :7]
    assert np.allclose(np.array(list(ann.scan(q, ann.packed(code), books))), q @ decoded.T, atol=1e-4)


@pytest.mark.parametrize("block", [16_384, 300])
def test_recall(spark, block):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, np.array(r.embedding, np.float64)) for r in table.collect()]
    want = brute(rows, 20, 20)
    got = {}
    for r in ann.search(table, F.col("vec_id") % 20 == 0, block=block, query_block=40, rerank=200).collect():
        got.setdefault(r.query_id, []).append(r)
    assert set(got) == set(want)
    hits = 0
    for q, own in got.items():
        own.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, 21))
        assert [(-r.score, r.vec_id) for r in own] == sorted((-r.score, r.vec_id) for r in own)
        hits += len({r.vec_id for r in own} & {i for i, _ in want[q]})
    assert hits >= 0.97 * 20 * len(want)


def test_edge_rows(spark):
    rows = [(0, [1.0, 0.0], 1), (20, [1.0, 0.0], 1), (3, [1.0, 0.0], 1), (2, [0.5, 0.5], 1), (5, None, 1), (6, [0.0, 0.0], 1), (7, [float("nan"), 1.0], 1), (8, [float("inf"), 1.0], 1), (9, [None, 1.0], 1), (None, [1.0, 1.0], 1), (10, [], 1), (3, [1.0, 0.0], 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    got = ann.search(table, F.col("vec_id") % 20 == 0).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in got) == [(0, 1, 3), (0, 2, 3), (0, 3, 20), (0, 4, 2), (20, 1, 0), (20, 2, 3), (20, 3, 3), (20, 4, 2)]
    assert ann.search(table.limit(0), F.col("vec_id") % 20 == 0).count() == 0
