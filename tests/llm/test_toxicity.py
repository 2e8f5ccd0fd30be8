import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessella.llm import toxicity
from tessella.llm.common import fold


def test_presence_matches_plain_sets():
    texts = ["Abcdé fghij", None, "", "abc", "xyz" * 10]
    owner, gram = toxicity._presence(pa.array(texts))
    got = {(int(a), int(b)) for a, b in zip(owner, gram)}
    want = set()
    for i, t in enumerate(texts):
        low = (t or "").lower()
        for n in toxicity.ORDERS:
            for j in range(len(low) - n + 1):
                key = 0
                for k, c in enumerate(low[j : j + n]):
                    key = (key * 1_000_003 + ord(c)) % 2**64 if k else ord(c)
                want.add((i, ((key ^ n) * 0x9E3779B97F4A7C15 % 2**64) >> (64 - toxicity.BITS)))
    assert got == want


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = toxicity.fit(toxicity.training_rows(docs, labels.filter(fold() != 0)))
    rows = toxicity.score(docs.join(labels.select("doc_id"), "doc_id", "left_semi"), model).join(labels, "doc_id").filter(fold() == 0).collect()
    toxic = [r.score for r in rows if r.toxic == 1]
    clean = [r.score for r in rows if r.toxic == 0]
    assert np.mean(np.array(toxic) >= 0.5) >= 0.85
    assert np.mean(np.array(clean) < 0.5) >= 0.985


def test_edge_rows(spark):
    docs = spark.createDataFrame([(i, "vile rotten words" if i % 2 else "kind and gentle words", 0.5) for i in range(60)] + [(None, None, 1.0), (99, "", 2.0), (99, "", 2.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (3, None), (5, 0)], "doc_id long, toxic int")
    model = toxicity.fit(toxicity.training_rows(docs, labels))
    got = toxicity.score(docs, model).collect()
    assert len(got) == 63 and all(0 <= r.score <= 1 for r in got)
    assert all((r.score >= 0.5) == bool(r.doc_id % 2) for r in got if r.doc_id is not None and r.doc_id < 60)
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns and kept.filter("doc_id < 60").count() == 30
    assert toxicity.score(docs.limit(0), model).count() == 0


@pytest.mark.parametrize("rows", [[], [(1, 0)], [(1, 1)]])
def test_without_both_classes_nothing_is_toxic(spark, rows):
    docs = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    labels = spark.createDataFrame(rows, "doc_id long, toxic int")
    model = toxicity.fit(toxicity.training_rows(docs, labels))
    assert toxicity.score(docs, model).first().score < 0.5


def test_fit_and_score_match_a_plain_reading(spark):
    """Counts, ratios, ranking, regression and score of dense matrices, from sets of n-grams."""
    rng = np.random.default_rng(3)
    bad, good = [f"vile{c}" for c in "abcdef"], [f"calm{c}" for c in "abcdef"]
    texts = [" ".join(rng.choice(bad if i % 2 else good, 3)) + " " + " ".join(rng.choice(bad + good, 2)) for i in range(80)]
    label = np.arange(80) % 2
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = spark.createDataFrame([(t, int(c)) for t, c in zip(texts, label)], "text string, toxic int")
    got = {r.doc_id: r.score for r in toxicity.score(frame, toxicity.fit(rows, features=50)).collect()}
    owner, gram = toxicity._presence(pa.array(texts))
    x = np.zeros((80, 1 << toxicity.BITS), np.int8)
    x[owner, gram] = 1
    pos, neg = x[label == 1].sum(0, dtype=float), x[label == 0].sum(0, dtype=float)
    r = np.log((pos + 1) / 42) - np.log((neg + 1) / 42)
    z = np.round(np.abs(r) / np.sqrt(1 / (pos + 1) + 1 / (neg + 1)), 9) * (x.any(0))
    best = np.lexsort((np.arange(len(z)), -z))[:50]
    a = x[:, best] * r[best]
    w, b = np.zeros(50), 0.0
    m1, m2 = np.zeros(51), np.zeros(51)
    for t in range(1, 251):
        error = (1 / (1 + np.exp(-(a @ w + b))) - label) / 80
        slope = np.append(a.T @ error + 1e-3 * w, error.sum())
        m1, m2 = 0.9 * m1 + 0.1 * slope, 0.999 * m2 + 0.001 * slope**2
        step = 0.05 * m1 / (1 - 0.9**t) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-10)
        w, b = w - step[:50], b - step[50]
    want = 1 / (1 + np.exp(-(a @ w + b)))
    assert np.allclose([got[i] for i in range(80)], want, atol=1e-6)


def test_few_labels_give_a_model_that_tells_apart(spark):
    """The least labelled table: sf0.001 has some ten toxic documents."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    model = toxicity.fit(toxicity.training_rows(docs, labels.filter(fold() != 0)))
    rows = toxicity.score(docs.join(labels.select("doc_id"), "doc_id", "left_semi"), model).join(labels, "doc_id").collect()
    assert np.mean([(r.score >= 0.5) == (r.toxic == 1) for r in rows]) >= 0.95


def test_long_and_repeated_texts(spark):
    docs = spark.createDataFrame([(1, "vile words " * 20_000), (1, "vile words " * 20_000), (2, None)], "doc_id long, text string")
    rows = spark.createDataFrame([("vile words", 1), ("kind talk", 0)] * 20, "text string, toxic int")
    got = toxicity.score(docs, toxicity.fit(rows)).collect()
    assert len(got) == 3 and got[0].score == got[1].score >= 0.5
