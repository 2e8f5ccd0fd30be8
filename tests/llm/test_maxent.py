import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tessella.llm import maxent as M
from tessella.llm.common import fold


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0d]+", low)


def test_scores_match_the_contract_and_beat_the_counts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    extra = spark.createDataFrame([(10**6, None, "en", "s", 0), (10**6 + 1, "", "en", "s", 0), (10**6 + 2, "THE unseenword", "en", "s", 0), (10**6 + 2, "THE unseenword", "en", "s", 0)], docs.schema)
    docs = docs.unionByName(extra)
    rows = docs.collect()
    held = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 5 == 1 for r in rows}
    count, ends = Counter(), 0
    for r in rows:
        if not held[r.doc_id]:
            count.update(words(r.text))
            ends += 1
    n, v = sum(count.values()) + ends, len(count) + 1
    lp = lambda c: np.log10((c + 0.5) / (n + 0.5 * (v + 1)))
    got = M.score_documents(docs, fold() != 1).collect()
    assert len(got) == len(rows)
    text = {r.doc_id: r.text for r in rows}
    base = score = 0
    for r in got:
        own = words(text[r.doc_id])
        assert r.held_out == held[r.doc_id] and r.train_tokens == n
        assert r.n_tokens == len(own) + 1 and r.n_known == sum(count[w] > 0 for w in own) + 1
        assert r.base_score == pytest.approx(sum(lp(count[w]) for w in own) + lp(ends), rel=1e-9)
        assert r.score < 0
        if r.held_out:
            base, score = base + r.base_score, score + r.score
    assert score > base * 0.95


def _random_tables(rng):
    tables = [rng.normal(size=(p + (1 << b), M.DIGIT)).astype(np.float32) * 0.3 for p, b in zip(M.PREFIXES, M.BITS)]
    for t, f in zip(tables, M.start(rng.integers(0, 50, M.UNITS) + 0.5)):
        t[: len(f)] = f
    return tables


def test_probabilities_of_all_units_sum_to_one():
    """After some words, the probabilities of all 4,096 units; a bucket's known words and its unknown one share its own."""
    rng = np.random.default_rng(0)
    tables = _random_tables(rng)
    h = M.hashes(pa.array(["a", "xx", "c"]))
    total = 0.0
    for last in range(M.UNITS):
        total += 10 ** M.log_probability(np.array([1, 2700, last]), h, np.array([2]), tables)[2]
    assert total == pytest.approx(1, abs=1e-4)


def test_updates_follow_the_gradient():
    rng = np.random.default_rng(1)
    table = rng.normal(size=(20, 6)).astype(np.float32)
    rows, target = list(rng.integers(0, 20, (3, 40))), rng.integers(0, 6, 40)

    def loss(t):
        z = sum(t[r] for r in rows)
        return (np.log(np.exp(z).sum(1)) - z[np.arange(40), target]).sum()

    after, square = table.copy(), np.zeros(20, np.float32)
    M._descend(after, square, np.zeros(20, np.int32), rows, target)
    slope = (table - after) / M.STEP * np.sqrt(square + 1e-8)[:, None]
    for i, j in ((int(rows[0][0]), 2), (int(rows[1][5]), 4)):
        up = table.astype(np.float64)
        up[i, j] += 1e-4
        assert slope[i, j] == pytest.approx((loss(up) - loss(table.astype(np.float64))) / 1e-4, rel=2e-2, abs=1e-3)


def test_contexts_are_the_words_before():
    """Equal contexts have equal hashes, none crosses from text to text, and spark hashes words alike."""
    h = M.hashes(pa.array(["a", "b", "a", "b", "x"]))
    ctx = M.contexts(M.sequence(h, np.array([4, 1]), M._END), np.array([4, 1]))
    for own in ctx:
        assert own[0] == own[5]  # each text starts from nothing
    assert ctx[0][1] == ctx[0][3] and ctx[1][2] == ctx[1][4] and ctx[0][1] != ctx[0][2]
    assert len({int(x[4]) for x in ctx}) == 3


def test_words_are_hashed_as_in_spark(spark):
    words = ["a", "é中", "word"]
    got = [r.h for r in spark.createDataFrame([(w,) for w in words], "w string").select(F.xxhash64("w").alias("h")).collect()]
    assert M.hashes(pa.array(words)).view(np.int64).tolist() == got


def test_held_out_texts_score_far_better_than_by_counts_and_averaging_costs_nothing(spark, monkeypatch):
    """0.35 a token over the unigram; and in four rounds as well as in one."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text").cache()
    monkeypatch.setattr(M, "SHARD", 4 << 20)
    mean = []
    for rounds in (1, 4):
        got = M.score_documents(docs, fold() != 1, rounds).filter("held_out").agg(F.sum("score") / F.sum("n_tokens"), F.sum("base_score") / F.sum("n_tokens")).first()
        mean.append(got[0])
    docs.unpersist()
    assert mean[0] > got[1] + 0.35
    assert mean[1] >= mean[0] - 0.005


def test_a_very_long_text_and_clashing_columns(spark):
    docs = spark.createDataFrame([(i, "the cat sat " * n, 1, 2.0) for i, n in enumerate((1, 30_000, 5))], "doc_id long, text string, block int, score double")
    rows = {r.doc_id: r for r in M.score_documents(docs, F.lit(True)).collect()}
    assert rows[1].n_tokens == 90_001 and rows[1].score > rows[1].base_score


def test_edge_tables(spark):
    docs = spark.createDataFrame([(None, "a b a", 1.0), (1, None, 2.0)], "doc_id long, text string, score double")
    rows = M.score_documents(docs, F.lit(False)).collect()
    assert len(rows) == 2 and all(r.held_out and r.n_known == 0 and r.train_tokens == 0 and r.base_score == 0 for r in rows)
    assert M.score_documents(docs.limit(0), fold() != 1).count() == 0
    rows = M.score_documents(docs, fold() != 1).collect()
    assert sorted(r.n_tokens for r in rows) == [1, 4] and all(not r.held_out for r in rows)


def test_updates_do_not_sort_by_an_index(monkeypatch):
    """Rows and tokens are sorted as one number: an argsort of four rows a token was a fifth of learning."""

    def refuse(*args, **kwargs):
        raise AssertionError("argsort")

    monkeypatch.setattr(M.np, "argsort", refuse)
    rng = np.random.default_rng(1)
    table, square, seen = np.zeros((40, 16), np.float32), np.full(40, 0.1, np.float32), np.zeros(40, np.int32)
    rows, target = [rng.integers(0, 20, 300), rng.integers(20, 40, 300)], rng.integers(0, 16, 300)
    M._descend(table, square, seen, rows, target)
    slope = np.zeros((40, 16))
    for own in rows:
        np.add.at(slope, own, 1 / 16 - (np.arange(16) == target[:, None]))
    assert (seen == np.bincount(np.concatenate(rows), minlength=40)).all()
    total = 0.1 + (slope**2).mean(1)
    assert np.allclose(square, total, rtol=1e-4) and np.allclose(table, -M.STEP * slope / np.sqrt(total)[:, None], rtol=1e-3, atol=1e-5)


def test_all_lengths_are_hashed_as_by_the_library():
    """In arrays, so that words under 32 bytes take no call each; slices and missing bytes too."""
    words = pa.array(["x" * n for n in range(70)] + ["aé中🙂"[n % 4] * (n % 11) + "z" * (n % 7) for n in range(80)])
    for own in (words, words[3:90], words[:0], pa.array([""])):
        assert M.hashes(own).tolist() == [xxhash.xxh64_intdigest(w, 42) for w in own.to_pylist()]


def test_short_words_take_no_call_each(monkeypatch):
    def refuse(*args):
        raise AssertionError("a call a word")

    monkeypatch.setattr(xxhash, "xxh64_intdigest", refuse)
    assert len(set(M.hashes(pa.array(["a", "word", "longer than eight"])).tolist())) == 3


def test_slopes_of_rows_with_few_and_many_tokens():
    rng = np.random.default_rng(4)
    size = rng.permutation(np.array([1, 2, 3, M.FEW, M.FEW + 1, 500, 1, 7]))
    e, token = rng.normal(size=(600, 16)).astype(np.float32), rng.integers(0, 600, size.sum())
    cuts = np.cumsum(size) - size
    want = np.array([e[token[a : a + n]].astype(np.float64).sum(0) for a, n in zip(cuts, size)])
    assert np.allclose(M._slopes(e, token, cuts, size), want, atol=1e-4)


def test_scoring_reads_texts_once(spark):
    """Words and texts of a block go one way together; they were split from the texts once for each."""
    docs = spark.createDataFrame([(i, f"a b word{i}") for i in range(5)], "doc_id long, text string").withColumn("learn", F.lit(True))
    counts = M._word_counts(docs)
    plan = M.score(docs, counts, M.fit(docs, counts))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("blocks(") == 1 and "FlatMapCoGroups" not in plan
