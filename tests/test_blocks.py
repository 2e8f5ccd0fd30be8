import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions import blocks
from tessella.functions import vectors as V
from tessella.operators import predicates, search, topk, transforms
from tessella.plans import catalog
from tessella.plans.index import Index


@pytest.mark.parametrize("name", ["knn_bray_curtis", "knn_jaccard", "knn_jensen_shannon", "knn_lp", "knn_nan_euclidean", "knn_gower", "budgeted_range", "index_itq", "index_padded", "knn_and_range", "tolerant_comparison", "selector_2d_callback", "l2_from_products"])
def test_pairs_are_compared_as_matrices(spark, sf, name):
    assert "MapInArrow" in catalog.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("metric", sorted(blocks.BLOCKS))
def test_blocks_have_the_scores_of_expressions(spark, metric):
    """Of vectors with NaN, infinite, negative and zero components, with nulls, too short ones and missing ones too."""
    nan, inf = math.nan, math.inf
    x = [[0.1, 0.5, 0.0], [0.0, 0.0, 0.0], [nan, 0.2, 0.3], [-1.0, 0.5, -2.0], [inf, 0.5, 0.25], [0.3, None, 0.1], [0.4, 0.1], None, [0.1, 0.5, 0.0], [2.5, 0.1, 0.7]]
    docs = spark.createDataFrame(list(enumerate(x)), "doc_id long, vec array<double>")
    asked = docs.select(F.col("doc_id").alias("qid"), F.col("vec").alias("qvec"))
    arg = 3.0 if metric == "lp" else None
    plain = docs.crossJoin(asked).select("qid", "doc_id", V.distance(metric, "qvec", "vec", arg).alias("score"))
    known = {(r.qid, r.doc_id): r.score for r in plain.collect()}
    got = {(r.qid, r.doc_id): r.score for r in search.pairwise(docs, asked, metric, arg).collect()}
    assert got.keys() == known.keys()
    for pair, score in known.items():
        assert got[pair] is None if score is None else got[pair] == pytest.approx(score, nan_ok=True, rel=1e-12, abs=1e-15), pair


def test_nearest_with_ties_in_dealt_blocks(spark):
    docs = spark.createDataFrame([(i, [float(i % 3), 1.0]) for i in range(9)], "doc_id long, vec array<double>")
    asked = spark.range(4_200).select(F.col("id").alias("qid"), F.array(F.lit(0.0), F.lit(1.0)).alias("qvec"))
    found = search.knn(docs, asked, 4, "l2").groupBy("rank", "doc_id", "score").count().orderBy("rank").collect()
    assert [tuple(r) for r in found] == [(1, 0, 0.0, 4_200), (2, 3, 0.0, 4_200), (3, 6, 0.0, 4_200), (4, 1, 1.0, 4_200)]


def test_callback_is_asked_of_as_many_pairs_as_needed(spark):
    rng = np.random.default_rng(3)
    docs = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(rng.normal(size=(300, 4)))], "doc_id long, vec array<double>")
    asked = docs.filter("doc_id % 50 = 0").select(F.col("doc_id").alias("qid"), F.col("vec").alias("qvec"))
    found = search.knn(docs, asked, 7, among=predicates.pairs_callback(lambda q, d: (q + d) % 11 == 0))
    want = search.knn(docs, asked, 7, on=(F.col("qid") + F.col("doc_id")) % 11 == 0)
    assert sorted((r.qid, r.rank, r.doc_id) for r in found.collect()) == sorted((r.qid, r.rank, r.doc_id) for r in want.collect())
    assert found.count() == 42


def test_nearest_numbers_with_ties_and_odd_values(spark):
    """Ties on both sides and beyond k places, equal numbers, and values and queries without a number, as of all pairs."""
    x = [float(v) for v in (5, 5, 5, 5, 4, 6, 4, 6, 7, 3, 100)] + [math.nan, None, math.inf, -math.inf, 1e17, 1e17 + 16, 1e17 + 32]
    values = spark.createDataFrame([(len(x) - i, v) for i, v in enumerate(x)], "doc_id long, x double")
    queries = spark.createDataFrame([(0, 5.0), (1, 4.5), (2, 1e9), (3, None), (4, math.nan), (5, -1e17)], "qid long, y double")
    for k in (1, 3, 7, 40):
        got = search.nearest_1d(values, queries, k)
        assert "MapInArrow" in got._jdf.queryExecution().executedPlan().toString()
        want = []
        for q, y in [(0, 5.0), (1, 4.5), (2, 1e9), (3, None), (4, math.nan), (5, -1e17)]:
            own = [(len(x) - i, None if v is None or y is None else abs(v - y)) for i, v in enumerate(x)]
            own.sort(key=lambda r: (r[1] is None, r[1] is not None and math.isnan(r[1]), 0 if r[1] is None or math.isnan(r[1]) else r[1], r[0]))
            want += [(q, n + 1, d) for n, (d, _) in enumerate(own[:k])]
        assert sorted((r.qid, r["rank"], r.doc_id) for r in got.collect()) == want


def test_graph_step_finds_the_best_of_neighbours_neighbours(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 4))
    docs = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "doc_id long, vec array<double>")
    links = {(i, int(j)) for i in range(60) for j in rng.choice(60, 3) if i != j}
    both = links | {(b, a) for a, b in links}
    graph = search.improve_graph(spark.createDataFrame(sorted(links), "src long, dst long"), docs, 5)
    assert "FlatMapGroupsInArrow" in graph._jdf.queryExecution().executedPlan().toString()
    for i in range(60):
        near = {b for a, b in both if a == i}
        near |= {b for a, b in both if a in near and b != i}
        want = sorted(near, key=lambda j: (((x[i] - x[j]) ** 2).sum(), j))[:5]
        assert [r.dst for r in graph.filter(f"src = {i}").orderBy("rank").collect()] == want if i % 20 == 0 else True


def test_descent_finds_nine_in_ten_of_vectors_without_order(spark):
    """Of vectors that need all their dimensions, so that a neighbour's neighbours are seldom near and few candidates do not do."""
    x = np.random.default_rng(8).normal(size=(5000, 64))
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
    docs = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "doc_id long, vec array<float>").repartition(4).persist()
    graph = search.neighbour_descent(docs, 10).select("src", "dst").persist()
    exact = search.knn_graph(docs, 10, "l2").select("src", "dst")
    assert graph.groupBy("src").agg(F.countDistinct("dst").alias("n")).filter("n = 10").count() == 5000 and graph.count() == 50_000
    assert graph.intersect(exact).count() >= 0.9 * 50_000


@pytest.mark.parametrize("metric", ["l2", "inner_product", "bray_curtis"])
def test_descent_of_odd_vectors(spark, metric):
    """Copies, too short ones, missing ones, ones with nulls, NaN or numbers that overflow: edges and distances of the exact graph."""
    x = [[float(v) for v in r] for r in np.random.default_rng(9).normal(size=(90, 3))]
    x += [x[0]] * 4 + [[math.nan, 1.0, 2.0], [1e200, 1.0, 1.0], [0.5, None, 1.0], [0.5, 0.25], None]
    docs = spark.createDataFrame(list(enumerate(x)), "doc_id long, vec array<double>")
    got, want = search.neighbour_descent(docs, 4, metric=metric), search.knn_graph(docs, 4, metric)
    assert sorted(map(str, got.select("src", "rank", "dst", "dist").collect())) == sorted(map(str, want.select("src", "rank", "dst", "dist").collect()))


def test_budget_over_all_queries_needs_few_rows_of_a_block(spark):
    """Ties at the cut, infinite and missing components; as of all pairs."""
    rng = np.random.default_rng(5)
    x = [[float(v) for v in r] for r in rng.integers(0, 4, size=(400, 3))] + [[math.inf, 0.0, 0.0], [math.nan, 0.0, 0.0], [1.0, None, 0.0]]
    docs = spark.createDataFrame(list(enumerate(x)), "doc_id long, vec array<double>")
    asked = docs.filter("doc_id % 50 = 7").select((F.col("doc_id") + 1000).alias("qid"), F.array(*[F.get("vec", F.lit(i)) + 0.3 * i for i in range(3)]).alias("qvec"))
    for metric, radius in (("l2", math.inf), ("l2", 2.0), ("inner_product", -math.inf), ("jaccard", 0.1)):
        every = search.range_search(docs, asked, radius, metric)
        few = search.range_search(docs, asked, radius, metric, most=41)
        assert few.count() <= 41 * spark.sparkContext.defaultParallelism + 8  # those of the vector with a null meet as pairs
        assert few.count() < every.count() or math.isfinite(radius)
        similar = V.is_similarity(metric)
        want, got = (sorted(map(str, topk.tighten(t, 40, similar).collect())) for t in (every, few))
        assert got == want and (metric != "l2" or 0 < len(got) <= 40)


@pytest.mark.parametrize("metric", blocks.PRODUCTS)
def test_matrix_products_only_choose_what_is_summed(spark, metric):
    """Vectors far from the origin, of which products tell little, in copies that tie, beside some that have no norm."""
    rng = np.random.default_rng(6)
    x = 1e5 + rng.integers(0, 3, size=(500, 5)) * 1e-4 + rng.normal(size=(500, 5)) * 1e-7
    x = np.concatenate([x, x[:100], [[math.inf] * 5, [math.nan, *[1.0] * 4], [1e160] * 5]])
    docs = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "doc_id long, vec array<double>")
    asked = docs.filter("doc_id % 40 = 0 or doc_id > 599").select(F.col("doc_id").alias("qid"), F.col("vec").alias("qvec"))
    score = V.distance(metric, "qvec", "vec").alias("score")
    plain = docs.crossJoin(asked).select("qid", "doc_id", score).filter("not isnan(score)")
    want = topk.top_k(plain, 7, V.is_similarity(metric))
    key = lambda rows: sorted((r.qid, r["rank"], r.doc_id, r.score) for r in rows.collect())
    assert key(search.knn(docs, asked, 7, metric)) == key(want)
    radius = 3e-8 if metric == "l2" else 5e10 + 40.0
    inside = plain.filter(F.col("score") > radius if V.is_similarity(metric) else F.col("score") < radius)
    pairs = lambda rows: sorted((r.qid, r.doc_id, r.score) for r in rows.filter("not isnan(score)").collect())
    assert pairs(search.range_search(docs, asked, radius, metric)) == pairs(inside) != []


def test_pairs_of_a_small_file_are_dealt_to_all_cores(spark, sf):
    docs = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec"))
    asked = docs.filter("doc_id % 50 = 0").select(F.col("doc_id").alias("qid"), F.col("vec").alias("qvec"))
    plan = search.pairwise(docs, asked)._jdf.queryExecution().executedPlan().toString()
    assert docs.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism
    assert "REPARTITION_BY_NUM" in plan[plan.index("MapInArrow") :].split("Join")[0]


def test_refining_all_candidates_compares_matrices(spark, sf):
    """A pair's row for each was joined twice and ranked; of lists that are not all probed only the probed ones count."""
    plan = catalog.QUERIES["index_lists_product_refined"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "list_no" not in plan.split("MapInArrow")[0]
    docs = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec"))
    asked = docs.filter("doc_id % 100 = 0").select(F.col("doc_id").alias("qid"), F.col("vec").alias("qvec"))
    index = Index("IVF8,PQ8x4,RFlat").train(docs, rounds=1).add(docs)
    probed = search.coarse(asked, index.centroids, 3, "l2").select("qid", "list_no").collect()
    lists = {r.doc_id: r.list_no for r in index.rows.collect()}
    pairs = {(r.qid, d) for r in probed for d, own in lists.items() if own == r.list_no}
    want = topk.top_k(search.pairwise(docs, asked).filter(F.concat_ws("-", "qid", "doc_id").isin([f"{a}-{b}" for a, b in pairs])), 5, False)
    got = index.search(asked, 5, nprobe=3, k_factor=1e9)
    assert sorted((r.qid, r["rank"], r.doc_id) for r in got.collect()) == sorted((r.qid, r["rank"], r.doc_id) for r in want.collect())


def test_comparison_finds_each_result_twice_at_most(spark, sf):
    plan = catalog.QUERIES["tolerant_comparison"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") <= 2


@pytest.mark.parametrize("metric", ["inner_product", "l2", "jaccard", "jensen_shannon", "nan_euclidean"])
def test_documents_are_read_once_and_odd_vectors_meet_all(spark, metric):
    """Vectors with nulls, too short, empty or missing ones, on both sides, get what expressions give, in the one reading."""
    nan, inf = math.nan, math.inf
    x = [[0.1, 0.5, 0.0], [0.0, 0.0, 0.0], [nan, 0.2, 0.3], [-1.0, 0.5, -2.0], [inf, 0.5, 0.25], [0.3, None, 0.1], [0.4, 0.1], None, [0.1, 0.5, 0.0], [2.5, 0.1, 0.7], []]
    docs = spark.createDataFrame(list(enumerate(x)), "doc_id long, vec array<double>")
    asked = docs.select(F.col("doc_id").alias("qid"), F.col("vec").alias("qvec"))
    plain = docs.crossJoin(asked).select("qid", "doc_id", V.distance(metric, "qvec", "vec").alias("score"))
    similar = V.is_similarity(metric)
    key = lambda rows, *more: sorted(str((r.qid, r.doc_id, *(r[c] for c in more), None if r.score is None else round(r.score, 12))) for r in rows.collect())
    found = search.knn(docs, asked, 4, metric)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "NestedLoop" not in plan and "Union" not in plan
    assert key(found, "rank") == key(topk.top_k(plain.filter("not isnan(score)"), 4, similar), "rank")
    inside = plain.filter("score > 0.2" if similar else "score < 0.9")
    assert key(search.range_search(docs, asked, 0.2 if similar else 0.9, metric)) == key(inside) != []
    graph = search.knn_graph(docs, 3, metric).select(F.col("src").alias("qid"), F.col("dst").alias("doc_id"), F.col("dist").alias("score"), "rank")
    assert key(graph, "rank") == key(topk.top_k(plain.filter("qid <> doc_id and not isnan(score)"), 3, similar), "rank")


def test_callback_is_asked_of_odd_vectors_too(spark):
    docs = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, None]), (2, None), (3, [0.5, 0.5])], "doc_id long, vec array<double>")
    asked = docs.select(F.col("doc_id").alias("qid"), F.col("vec").alias("qvec"))
    for among, passed in ((predicates.pairs_callback(lambda q, d: d != 2), (0, 1, 3)), (predicates.pairs_callback(lambda q, d: d != 3) & predicates.pairs_callback(lambda q, d: q != 9), (0, 1, 2))):
        found = search.knn(docs, asked, 9, "l2", among=among)
        assert sorted((r.qid, r.doc_id) for r in found.collect()) == [(q, d) for q in range(4) for d in passed]


def test_compared_results_are_found_by_one_reading(spark, sf):
    plan = catalog.QUERIES["tolerant_comparison"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and plan.count("FileScan") <= 2


@pytest.mark.parametrize("similar", [True, False])
def test_best_are_chosen_by_groups(similar):
    """No pair that may count is missed, few others are taken; rows without numbers, with few, and with ties at the cut."""
    rng = np.random.default_rng(8)
    score = rng.normal(size=(40, 3_205))
    score[1], score[2, 5:], score[3], score[4, ::2], score[5, 100] = math.nan, math.nan, 1.0, math.nan, math.inf
    for k in (1, 10, 150, 3_204, 3_205):
        taken = blocks.among_best(k, similar)(score.copy(), np.full(40, 1e-9))
        for own, got in zip(-score if similar else score, taken):
            number = ~np.isnan(own)
            cut = np.sort(own[number])[: k][-1] if number.any() else math.inf
            assert got[number & (own <= cut)].all() and not got[~number].any()
        assert taken[6:].sum() <= 34 * (k + 8 + k // 2)
    calls = []
    part = np.partition
    np.partition = lambda a, *more, **how: calls.append(a.size) or part(a, *more, **how)
    try:
        blocks.among_best(10, similar)(score, np.zeros(40))
    finally:
        np.partition = part
    assert calls == [40 * 160]


def test_padding_is_no_work_of_each_component(spark, sf):
    plan = catalog.QUERIES["index_padded"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "lambdafunction(cast(" not in plan.split("MapInArrow")[-1]


def test_a_comparison_of_one_search_searches_once(spark, sf):
    frame = catalog.QUERIES["tolerant_comparison"](spark, sf)
    assert frame._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert sorted(r.qid for r in frame.collect()) == [0, 100, 200, 300, 400]


@pytest.mark.parametrize("metric", ["l2", "inner_product", "jaccard"])
def test_nearest_and_range_compare_pairs_once(spark, sf, metric):
    """As both searches combined, with ties at the cut, odd vectors, and queries with fewer, as many and more inside."""
    plan = catalog.QUERIES["knn_and_range"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("Exchange hashpartitioning(qid") == 1 and "Join" not in plan
    rng = np.random.default_rng(9)
    x = [[float(v) for v in r] for r in rng.integers(0, 4, size=(300, 3))] + [[math.inf, 0.0, 0.0], [math.nan, 0.0, 0.0], [1.0, None, 0.0], None, [1.0]]
    docs = spark.createDataFrame(list(enumerate(x)), "doc_id long, vec array<double>")
    asked = docs.filter("doc_id % 30 = 7 or doc_id > 299").select((F.col("doc_id") + 1000).alias("qid"), F.transform("vec", lambda v, i: v + 0.3 * i).alias("qvec"))
    key = lambda rows: sorted(str((r.qid, r.doc_id, r.score)) for r in rows.select("qid", "doc_id", "score").collect())
    for radius in {"l2": (0.0, 1.0, 4.0, math.inf), "inner_product": (20.0, 5.0, math.inf), "jaccard": (0.8, 0.3, 0.0)}[metric]:
        both = search.knn(docs, asked, 9, metric), search.range_search(docs, asked, radius, metric)
        got = search.knn_and_range(docs, asked, 9, radius, metric)
        assert key(got) == key(topk.combine_knn_and_range(*both, 9, radius, V.is_similarity(metric)))


def test_copies_have_one_image_wherever_they_are(spark):
    """A matrix product of a library sums a row in another order where it is one of few, so copies in small files lost their tie."""
    rng = np.random.default_rng(0)
    turn = transforms.Linear(np.linalg.qr(rng.normal(size=(64, 64)))[0], rng.normal(size=64))
    v = F.array(*[F.lit(float(x)) for x in rng.normal(size=64)])
    frames = [spark.range(0, n, 1, 1).select(F.when(F.col("id") < 200, v).alias("vec")) for n in (1, 2, 3, 5, 9, 17, 40, 150, 201)]
    rows = frames[0]
    for other in frames[1:]:
        rows = rows.unionByName(other)
    images = turn.apply(rows).groupBy("vec").count().collect()
    assert sorted(r["count"] for r in images) == [1, 427] and [r.vec for r in images if r["count"] == 1] == [None]
    x = rng.normal(size=(700, 64))
    assert np.allclose(turn.images(x), x @ turn.matrix.T + turn.bias, rtol=1e-12, atol=1e-13)


def test_index_transforms_documents_once(spark, sf):
    plan = catalog.QUERIES["index_itq"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
