from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tessella.llm import quality


def brute(texts, order):
    """Interpolated modified Kneser-Ney straight from its definition, with the discounts held to the same range."""
    pad = [["^"] * (order - 1) + list(t) + ["$"] for t in texts]
    top = Counter(tuple(s[i - order + 1 : i + 1]) for s in pad for i in range(order - 1, len(s)))
    counts = {order: top}
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    discounts = {}
    for n, c in counts.items():
        of = Counter(c.values())
        n1, n2, n3, n4 = (max(of[i], 1) for i in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2)
        raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
        discounts[n] = [min(max(x, 0.05), k - 0.05) for k, x in zip((1, 2, 3), raw)]

    def p(gram):
        n = len(gram)
        if not n:
            return 1 / (len(counts[1]) + 1)
        own = {g: c for g, c in counts[n].items() if g[:-1] == gram[:-1]}
        if not own:
            return p(gram[1:])
        total = sum(own.values())
        taken = sum(discounts[n][min(c, 3) - 1] for c in own.values())
        c = own.get(gram, 0)
        return (c - discounts[n][min(c, 3) - 1] if c else 0) / total + taken / total * p(gram[1:])

    return p


def test_probabilities_match_the_definition(spark):
    texts = ["abracadabra", "abba cab", "a bad cab", "dab a crab", "abra ä"]
    rows = spark.createDataFrame([(i, t, "en", True) for i, t in enumerate(texts)], "doc_id long, text string, lang string, fitting boolean")
    model = quality.fit(rows, order=3)
    p = brute(texts, 3)
    for text in ["abra", "", "zebra cab", "ääb"]:
        s = ["^", "^", *text, "$"]
        want = -sum(np.log10(p(tuple(s[i - 2 : i + 1]))) for i in range(2, len(s)))
        loss, n = quality._losses(pa.array([text]), model)
        assert n[0] == len(text) + 1
        assert loss[0] == pytest.approx(want, rel=1e-9)


def test_probabilities_sum_to_one(spark):
    texts = ["abracadabra", "abba cab"] * 3
    rows = spark.createDataFrame([(i, t, "en", True) for i, t in enumerate(texts)], "doc_id long, text string, lang string, fitting boolean")
    model = quality.fit(rows, order=3)
    symbols = sorted({int(k) & ((1 << quality.WIDTH) - 1) for k in model.keys[0]})
    for context in (0, 3 << quality.WIDTH | 4, 4000 << quality.WIDTH | 4001):
        keys = np.array([context << quality.WIDTH | s for s in [*symbols, 4095]])
        assert quality.probabilities(keys, model).sum() == pytest.approx(1)


def test_rejects_junk_and_keeps_clean(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = quality.fit(quality.trusted_rows(docs, labels, 3000))
    rows = quality.score(docs.join(labels.select("doc_id"), "doc_id", "left_semi"), model).join(labels, "doc_id").collect()
    good = [r.keep for r in rows if r.quality == 1]
    bad = [r.keep for r in rows if r.quality == 0]
    assert np.mean(good) >= 0.985
    assert np.mean(bad) <= 0.15


def test_edge_rows(spark):
    docs = spark.createDataFrame([(1, None, None, 0.1), (2, "", "en", 0.2), (None, "text", "xx", 0.3), (4, "t" * 9000, "en", 0.4)], "doc_id long, text string, lang string, loss double")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.fit(quality.trusted_rows(docs, labels))
    assert quality.score(docs, model).filter("keep").count() == 4
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns and kept.count() == 4
    assert quality.keep_good(docs.limit(0), model).count() == 0


def test_all_trusted_documents_count(spark):
    """More than 12,000 of them, of which a rare language has few: it keeps a threshold of its own, over all it has."""
    rows = spark.range(15_000).selectExpr("id as doc_id", "if(id % 250 = 0, concat('zq xj ', hex(id * 7919)), concat('the and ', id * 31)) as text", "if(id % 250 = 0, 'xx', 'en') as lang")
    trusted = quality.trusted_rows(rows, rows.selectExpr("doc_id", "1 as quality"))
    assert trusted.count() == 15_000
    model = quality.fit(trusted, order=2)
    assert {None, "en", "xx"} == set(model.threshold)
    kept_out = quality.score(trusted.filter("not fitting"), model).toPandas()
    assert (kept_out.lang == "xx").sum() >= 20
    for lang, own in kept_out.groupby("lang"):
        mean = -own.log10_prob.sum() / own.n_tokens.sum()
        assert model.mean[lang] == pytest.approx(mean)
        assert model.threshold[lang] == pytest.approx(np.quantile((-own.log10_prob + quality.PRIOR * mean) / (own.n_tokens + quality.PRIOR), 0.995))


def test_a_model_in_shards_scores_alike(spark, sf):
    """Sharded joins give what look-ups in the whole table give, and keep the same rows."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = spark.createDataFrame([(None, None, None, None, None), (10**6, "", "en", "s", 0), (10**6, "", "en", "s", 0), (10**6 + 1, "zq" * 6_000, "xx", "s", 1)], docs.schema)
    docs = docs.unionByName(extra)
    rows = quality.trusted_rows(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    whole, shards = quality.fit(rows), quality.fit(rows, most=10)
    assert whole.keys and shards.shards and not shards.keys
    plain = lambda m: sorted((r.doc_id or 0, r.lang or "", r.n_tokens, round(r.log10_prob, 6), round(r.threshold, 6), r.keep) for r in quality.score(docs, m).collect())
    assert plain(whole) == plain(shards)
    kept = [sorted(r.doc_id or 0 for r in quality.keep_good(docs, m).collect()) for m in (whole, shards)]
    assert kept[0] == kept[1] and quality.keep_good(docs, shards).columns == docs.columns
