import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions import vectors as V
from tessella.operators import binary, calibrate, cluster, codecs, evaluate, maintain, predicates, routing, search, topk, transforms


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(c, 0.3, (60, 8)) for c in ((0,) * 8, (3,) * 8, (-3, 3) * 4)])
    docs = spark.createDataFrame([(i, [float(v) for v in r], i % 5) for i, r in enumerate(x)], "doc_id long, vec array<double>, attr long").persist()
    queries = spark.createDataFrame([(i, [float(v) for v in x[i] + 0.05], i % 5) for i in range(0, 180, 20)], "qid long, qvec array<double>, eq long").persist()
    return x, docs, queries


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def vec(*xs):
    return F.array(*[F.lit(float(x)) for x in xs])


@pytest.mark.parametrize(
    "metric, a, b, want",
    [("l2", (1, 2), (3, 5), 13), ("l1", (1, 2), (3, 5), 5), ("linf", (1, 2), (3, 5), 3), ("inner_product", (1, 2), (3, 5), 13), ("canberra", (1, 0), (3, 0), math.nan), ("canberra", (1, 1), (3, 1), 0.5), ("bray_curtis", (1, 2), (3, 5), 5 / 11),
     ("jaccard", (1, 5), (3, 2), 3 / 8), ("nan_euclidean", (1, math.nan, 2), (2, 5, 4), 3 / 2 * 5), ("nan_euclidean", (math.nan,), (1,), math.nan), ("gower", (0.5, -1, -2), (0.25, -1, -3), 1.25 / 3), ("gower", (0.5,), (-1,), math.nan), ("gower", (5,), (1,), math.nan)],
)
def test_metrics(spark, metric, a, b, want):
    got = value(spark, V.distance(metric, vec(*a), vec(*b)))
    assert math.isnan(got) if math.isnan(want) else got == pytest.approx(want)


def test_vector_arithmetic(spark):
    assert value(spark, V.lp(vec(1, 2), vec(3, 5), 3)) == 35
    assert value(spark, V.normalize(vec(0, 0))) == [0, 0]
    assert value(spark, V.normalize(vec(3, 4))) == [0.6, 0.8]
    with pytest.raises(Exception, match="zero vector"):
        value(spark, V.normalize_strict(vec(0, 0)))
    assert value(spark, V.multiply_add(vec(1, 1), 2, vec(1, 2))) == [3, 5]
    assert value(spark, V.matrix_multiply([[1, 0], [1, 1]], vec(2, 3), [1, 1])) == [3, 6]
    assert value(spark, V.sign_words(vec(1, -1, 0))) == [5]
    assert value(spark, V.words_to_signs(V.sign_words(vec(1, -1, 0)), 3)) == [1, -1, 1]
    packed = V.pack_bits(F.array(F.lit(3), F.lit(1), F.lit(2)), 4)
    assert value(spark, packed) == 3 + 16 + 512 and value(spark, V.unpack_bits(packed, 4, 3)) == [3, 1, 2]
    assert value(spark, V.generalized_hamming(vec(1, 2, 3), vec(1, 5, 6))) == 2
    long = V.sign_words(F.array(*[F.lit(1.0 if i in (0, 64, 69) else -1.0) for i in range(70)]))
    assert value(spark, long) == [1, 1 + 32]


def test_literal_categorical_predicates(spark):
    values = [7, 7, 2, 7, *range(10, 46)]
    docs = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "doc_id long, attr long")
    preds = spark.createDataFrame([(0, 7), (1, 2), (2, 1000)], "qid long, eq long")
    got = {}
    for r in predicates.equality(docs, preds).collect():
        got.setdefault(r.qid, set()).add(r.doc_id)
    assert got == {0: {0, 1, 3}, 1: {2}}
    stats = {r.term: r.dense for r in predicates.posting_stats(docs.select("doc_id", F.col("attr").alias("term")), len(values)).collect()}
    assert stats[7] and not stats[2]


def test_literal_conjunctions(spark):
    terms = [[4, 1, 4], [2], [1, 3, 4][:0] + [3], [], [2, 4]]
    terms = [[4, 1, 4], [2], [1, 3, 4], [], [2, 4]]
    docs = spark.createDataFrame(list(enumerate(terms)), "doc_id long, terms array<long>")
    post = predicates.doc_terms(docs)
    preds = spark.createDataFrame([(0, [1, 4]), (1, [2, 4, 4]), (2, [1, 99]), (3, [2]), (4, [])], "qid long, terms array<long>")
    got = {}
    for r in predicates.conjunction(post, preds).collect():
        got.setdefault(r.qid, set()).add(r.doc_id)
    assert got == {0: {0, 2}, 1: {4}, 3: {1, 4}}


def test_literal_ranges(spark):
    docs = spark.createDataFrame(list(enumerate([5, 1, 3, 1, 4, 2])), "doc_id long, attr long")
    preds = spark.createDataFrame([(0, 2.0, 5.0), (1, 4.0, 6.0), (2, 9.0, 9.0)], "qid long, lo double, hi double")
    got = {}
    for r in predicates.ranges(docs, preds).collect():
        got.setdefault(r.qid, set()).add(r.doc_id)
    assert got == {0: {2, 4, 5}, 1: {0, 4}}
    with pytest.raises(Exception, match="lo must be below hi"):
        predicates.check_ranges(preds).collect()


def test_bitmaps_round_trip_and_combine(spark):
    rows = [(0, i) for i in (0, 1, 7, 8, 32767, 32768, 70000)] + [(1, 5)]
    legal = spark.createDataFrame(rows, "qid long, doc_id long")
    bits = predicates.to_bitmaps(legal)
    assert sorted(map(tuple, predicates.from_bitmaps(bits).collect())) == sorted(rows)
    other = predicates.to_bitmaps(spark.createDataFrame([(0, 8), (0, 9), (1, 6)], "qid long, doc_id long"))
    assert sorted(map(tuple, predicates.from_bitmaps(predicates.intersect_bitmaps(bits, other)).collect())) == [(0, 8)]
    assert {r.qid: r.n for r in predicates.bitmap_sizes(predicates.union_bitmaps(bits, other)).collect()} == {0: 8, 1: 2}


def test_selectors(spark):
    ids = spark.range(40).withColumnRenamed("id", "doc_id")
    pick = lambda s: [r.doc_id for r in ids.filter(s.on()).orderBy("doc_id").collect()]
    assert pick(predicates.id_range(3, 6)) == [3, 4, 5]
    assert pick(predicates.id_bitmap(bytes([0b101, 0, 0b1]))) == [0, 2, 16]
    assert pick(predicates.callback(lambda i: i % 13 == 0)) == [0, 13, 26, 39]
    assert pick((predicates.id_range(0, 4) | predicates.id_list([9])) & ~predicates.id_list([1])) == [0, 2, 3, 9]
    assert pick(predicates.id_range(0, 4) ^ predicates.id_range(2, 6)) == [0, 1, 4, 5]
    assert len(pick(predicates.everything())) == 40
    outside = spark.createDataFrame([(i, 100 + i) for i in range(40)], "doc_id long, external long")
    assert predicates.translated(ids, outside, predicates.id_range(100, 103)).count() == 3


def test_keyword_workload(spark):
    docs = spark.createDataFrame([(0, list(range(30))), (1, list(range(10, 30)) + list(range(10)))], "doc_id long, ranking array<int>")
    words = predicates.keyword_terms(docs)
    asked = spark.createDataFrame([(0, 0), (1, 9)], "qid long, term int")
    assert {(r.qid, r.doc_id) for r in predicates.keyword_workload(asked, words, "alternating").collect()} == {(0, 0), (1, 1)}


def test_slices_and_differences(spark):
    table = spark.range(10).withColumnRenamed("id", "qid")
    assert predicates.slice_queries(table, 2, 3, 10).count() == 3
    with pytest.raises(ValueError):
        predicates.slice_queries(table, 8, 3, 10)
    a = spark.createDataFrame([(0, 1), (3, 2), (5, 1)], "qid long, doc_id long")
    b = spark.createDataFrame([(0, 1), (3, 9), (5, 1)], "qid long, doc_id long")
    assert predicates.first_difference(a, b).first().qid == 3 and predicates.first_difference(a, a).first().qid is None


def test_search_forms_agree(spark, cloud):
    x, docs, queries = cloud
    exact = {(r.qid, r["rank"]): (r.doc_id, round(r.score, 6)) for r in search.knn(docs, queries, 5, "l2").collect()}
    scan = {(r.qid, r["rank"]): (r.doc_id, round(r.score, 6)) for r in search.scan(docs, queries, 5, "l2").collect()}
    assert exact == scan
    dealt = search.meet(docs, queries, block=2).count()
    assert dealt == docs.count() * queries.count()
    legal = predicates.equality(docs, queries)
    on = search.knn(docs, queries, 5, on=F.col("attr") == F.col("eq")).select("qid", "doc_id")
    assert on.exceptAll(search.filtered_knn(docs, queries, legal, 5).select("qid", "doc_id")).count() == 0
    kept = search.refine(search.knn(docs, queries, 20, "l1"), docs, queries, 3, "l2")
    assert kept.groupBy("qid").count().filter("count <> 3").count() == 0
    padded = topk.pad_missing(search.knn(docs.limit(2), queries, 4), queries, 4)
    assert padded.count() == 4 * queries.count() and padded.filter("doc_id = -1").count() == 2 * queries.count()


def test_ivf_with_all_lists_is_exact(spark, cloud):
    x, docs, queries = cloud
    centroids = cluster.kmeans(docs, 3, 4)
    lists = search.build_lists(docs, centroids, "l2")
    full = search.ivf_search(lists, queries, centroids, 5, 3, "l2").select("qid", "doc_id", "rank")
    assert full.exceptAll(search.knn(docs, queries, 5, "l2").select("qid", "doc_id", "rank")).count() == 0
    assert evaluate.recall(search.ivf_search(lists, queries, centroids, 5, 1, "l2"), search.knn(docs, queries, 5, "l2"), 5).first().recall > 0.9
    probes = spark.createDataFrame([(0, -1), (0, 0)], "qid long, list_no int")
    assert search.scan_lists(lists, queries, probes).select("list_no").distinct().count() <= 1


def test_neighbour_descent_finds_most_neighbours(spark, cloud):
    x, docs, _ = cloud
    graph = search.neighbour_descent(docs.limit(60), 5, rounds=3).select("src", "dst")
    exact = search.knn_graph(docs.limit(60), 5, "l2").select("src", "dst")
    assert graph.intersect(exact).count() >= 0.8 * exact.count()


def test_literal_cluster_major_and_selectivity(spark):
    lists = spark.createDataFrame(list(enumerate([2, 0, 1, 2, 0, 2])), "doc_id long, list_no int")
    rows = maintain.cluster_major(lists).orderBy("position").collect()
    assert [r.doc_id for r in rows] == [1, 4, 2, 0, 3, 5]
    legal = spark.createDataFrame([(0, i) for i in (0, 2, 5)] + [(1, i) for i in (1, 3, 4)], "qid long, doc_id long")
    p = {(r.qid, r.list_no): r.p for r in routing.selectivity(legal, lists, legal.select("qid").distinct()).collect()}
    assert p == {(0, 0): 0, (0, 1): 1, (0, 2): pytest.approx(2 / 3), (1, 0): 1, (1, 1): 0, (1, 2): pytest.approx(1 / 3)}


def test_log_selectivity_and_sweep(spark):
    assert value(spark, routing.log_selectivity(F.lit(0.0), 0)) == -math.inf
    assert value(spark, routing.log_selectivity(F.lit(0.5), 0)) == 0
    assert value(spark, routing.log_selectivity(F.lit(0.5), 2)) == pytest.approx(2 * math.log(0.5))
    assert routing.sweep(0, 4, 5) == [1, 2, 4, 8, 16] and routing.sweep(0, 4, 5, cap=8) == [1, 2, 4, 8]


def test_empty_lists_are_left_out_after_the_cut(spark):
    scores = spark.createDataFrame([(0, 0, 0.9), (0, 1, 0.8), (0, 2, 0.7)], "qid long, list_no int, coarse double")
    shares = spark.createDataFrame([(0, 1, 0.5)], "qid long, list_no int, p double")
    assert [r.list_no for r in routing.probes(scores, shares, 2, 0.1).collect()] == [1]
    assert [r.list_no for r in routing.probes(scores, shares, 2, 0.1, aware=False).orderBy("rank").collect()] == [0, 1]


def test_literal_recall_and_timing(spark):
    found = spark.createDataFrame([(0, 1, 1), (0, 2, 2), (1, 8, 1), (1, 9, 2)], "qid long, doc_id long, rank int")
    truth = spark.createDataFrame([(0, 2, 1), (0, 3, 2), (1, 8, 1), (1, 7, 2)], "qid long, doc_id long, rank int")
    assert evaluate.recall(found, truth, 2).first().recall == 0.5
    times = spark.createDataFrame([("a", 0.001), ("a", 0.003), ("b", 0.004), ("b", 0.008)], "stage string, seconds double")
    got = {r.stage: (r.median_ms, r.p95_ms) for r in evaluate.timing_summary(times).collect()}
    assert got["a"] == pytest.approx((2, 2.9)) and got["b"][0] == pytest.approx(6)


def test_range_precision_recall_conventions(spark):
    queries = spark.createDataFrame([(0,), (1,)], "qid long")
    found = spark.createDataFrame([(0, 1, 0.1), (0, 2, 0.2)], "qid long, doc_id long, score double")
    truth = spark.createDataFrame([(0, 1, 0.1), (0, 3, 0.3)], "qid long, doc_id long, score double")
    assert tuple(evaluate.range_precision_recall(found, truth, queries).first()) == (0.5, 0.5)
    assert tuple(evaluate.range_precision_recall(found, truth, queries, "average").first()) == (0.75, 0.75)
    at = {r.radius: (r.precision, r.recall) for r in evaluate.precision_recall_at(found, truth, [0.05, 0.15, 0.5]).collect()}
    assert at == {0.05: (1, 1), 0.15: (1, 1), 0.5: (0.5, 0.5)}


def test_same_results_ignores_ties(spark):
    a = spark.createDataFrame([(0, 1, 1, 0.5), (0, 2, 2, 0.5), (0, 3, 3, 0.9)], "qid long, doc_id long, rank int, score double")
    b = spark.createDataFrame([(0, 2, 1, 0.5), (0, 1, 2, 0.5), (0, 4, 3, 0.9)], "qid long, doc_id long, rank int, score double")
    c = spark.createDataFrame([(0, 2, 1, 0.5), (0, 7, 2, 0.5), (0, 4, 3, 0.9)], "qid long, doc_id long, rank int, score double")
    assert evaluate.same_results(a, b).count() == 0 and evaluate.same_results(a, c).count() == 1


def test_top_k_helpers(spark):
    rows = spark.createDataFrame([(0, 3, 0.5), (0, 1, 0.5), (0, 2, 0.9)], "qid long, doc_id long, score double")
    assert [r.doc_id for r in topk.top_k(rows, 2, True).orderBy("rank").collect()] == [2, 1]
    with pytest.raises(ValueError):
        topk.top_k(rows, 0, True)
    assert topk.merge_results(rows, rows, k=5, similar=True).count() == 3
    low = topk.extrema(rows).first()
    assert (low.least_id, low.largest_id) == (1, 2)
    places = {r.doc_id: r.place for r in topk.argsort(rows, "score", "doc_id").collect()}
    assert places == {1: 0, 3: 1, 2: 2}
    curve = spark.createDataFrame([(1, 0.5), (2, 0.96), (3, 1.0)], "depth int, recall double")
    assert topk.first_depth(curve).first().depth == 2
    with pytest.raises(Exception, match="never reached"):
        topk.first_depth(curve, 1.1).collect()
    assert value(spark, topk.k_largest(vec(1, 3, 2), 2)) == [3, 2] and value(spark, topk.k_smallest(vec(1, 3, 2), 2)) == [1, 2]


def test_kmeans_lowers_the_objective_and_fills_lists(spark, cloud):
    x, docs, _ = cloud
    start = cluster.first_centroids(docs, 3)
    after = cluster.kmeans(docs, 3, 5)
    loss = lambda c: cluster.objective(docs, c).first().objective
    assert loss(after) < loss(start)
    assert search.build_lists(docs, after, "l2").select("list_no").distinct().count() == 3
    frozen = cluster.lloyd_step(docs, start, frozen=1).filter("list_no = 0").first().cvec
    assert frozen == start.filter("list_no = 0").first().cvec
    sphere = cluster.lloyd_step(docs, start, "inner_product", spherical=True).collect()
    assert all(abs(np.linalg.norm(r.cvec) - 1) < 1e-9 or r.cvec == start.collect()[r.list_no].cvec for r in sphere)
    assert cluster.two_level(docs, 2, 2, 2).count() == 4
    assert cluster.progressive(docs, 3, [2, 8], 2).count() <= 3


def test_kmeans_1d_is_optimal(spark):
    rng = random.Random(2)
    xs = sorted(rng.sample(range(100), 9))
    got = cluster.kmeans_1d(spark.createDataFrame([(float(v),) for v in xs], "x double"), 3)
    loss = lambda cs: sum(min((v - c) ** 2 for c in cs) for v in xs)
    best = min(loss([np.mean(xs[:i]), np.mean(xs[i:j]), np.mean(xs[j:])]) for i in range(1, 8) for j in range(i + 1, 9))
    assert loss(got) == pytest.approx(best)


def test_signatures_bring_like_documents_together(spark, cloud):
    _, docs, queries = cloud
    fit = predicates.equality(docs, queries).join(queries.withColumn("n", F.row_number().over(topk.Window.orderBy("qid")) - 1).select("qid", "n"), "qid").select(F.col("n").alias("qid"), "doc_id")
    rows = cluster.signatures(fit, 9, docs, 3, 0.5).collect()
    sig = {r.doc_id: np.array(r.sig) for r in rows}
    seen = {r.doc_id for r in fit.collect()}
    assert all(np.linalg.norm(sig[i]) == pytest.approx(0.5 if i in seen else 0, abs=1e-6) for i in sig)
    same = [i for i in sig if i in seen and i % 5 == 0]
    assert np.allclose(sig[same[0]], sig[same[1]])
    assert cluster.signatures(fit, 9, docs, 3, 0.0).first().sig == [0, 0, 0]
    assert len(cluster.with_signature(cluster.signatures(fit, 9, docs, 3, 0.5)).first().vec) == 11


def test_transforms(spark, cloud):
    x, docs, _ = cloud
    n, mean, cov = transforms.moments(docs)
    assert n == len(x) and np.allclose(mean, x.mean(0)) and np.allclose(cov, np.cov(x.T, bias=True))
    white = np.array([r.vec for r in transforms.pca(docs, 2, -0.5).apply(docs).orderBy("doc_id").collect()])
    assert np.allclose(np.cov(white.T, bias=True), np.eye(2), atol=1e-6)
    turn = transforms.random_rotation(8)
    back = turn.reverse(turn.apply(docs)).orderBy("doc_id").collect()
    assert np.allclose([r.vec for r in back], x)
    centred = x - x.mean(0)
    itq = transforms.itq(docs)
    loss = lambda r: np.mean((np.abs(centred @ r.T) - 1) ** 2)
    assert np.allclose(itq.matrix @ itq.matrix.T, np.eye(8), atol=1e-9) and loss(itq.matrix) <= loss(np.eye(8)) + 1e-9
    assert np.allclose((o := transforms.opq(docs, 2, 4, 2)).matrix @ o.matrix.T, np.eye(8), atol=1e-9)
    assert transforms.remap([1, -1, 0])(docs.limit(1)).first().vec[1] == 0
    assert len(transforms.pad(10)(docs.limit(1)).first().vec) == 10
    chain = transforms.Chain([transforms.centering(docs), turn])
    assert np.allclose([r.vec for r in chain.reverse(chain.apply(docs)).orderBy("doc_id").collect()], x)
    assert transforms.pca(docs, 4, bins=2).matrix.shape == (4, 8)


def test_codecs_lose_little(spark, cloud):
    x, docs, queries = cloud
    spread = np.mean((x - x.mean(0)) ** 2)

    def loss(codec):
        return np.mean((codec.decode(codec.encode(x)) - x) ** 2) / spread

    assert loss(codecs.ScalarQuantizer.fit(docs)) < 1e-4
    for bounds, arg in (("meanstd", 3.0), ("quantiles", 0.01), ("optim", 0.0)):
        assert loss(codecs.ScalarQuantizer.fit(docs, 6, bounds, arg)) < 0.02
    assert loss(codecs.ScalarQuantizer.fit(docs, 4, uniform=True)) < 0.02
    assert loss(codecs.HalfFloat()) < 1e-5 and loss(codecs.HalfFloat(brain=True)) < 1e-3
    assert np.array_equal(codecs.Direct().decode(codecs.Direct().encode(np.array([[3.0, 300.0]]))), [[3, 255]])
    pq = codecs.ProductQuantizer.fit(docs, 4, 16)
    assert loss(pq) < 0.05
    beam1, beam4 = codecs.ResidualQuantizer.fit(docs, 3, 8, beam=1), codecs.ResidualQuantizer.fit(docs, 3, 8, beam=4)
    assert loss(beam4) <= loss(beam1) + 1e-9
    assert loss(codecs.LocalSearchQuantizer.fit(docs, 3, 8)) <= loss(beam1) + 1e-9
    assert loss(codecs.ProductOf.fit(codecs.ResidualQuantizer, docs, 2, stages=2, words=8)) < 0.05
    assert loss(codecs.RowwiseMinMax(codecs.ScalarQuantizer(np.zeros(8), np.ones(8)))) < 1e-4
    adc = pq.search(pq.encoded(docs), queries, 5)
    plain = codecs.Codec.search(pq, pq.encoded(docs), queries, 5)
    assert [round(r.score, 6) for r in adc.orderBy("qid", "rank").collect()] == [round(r.score, 6) for r in plain.orderBy("qid", "rank").collect()]
    assert np.allclose(np.diagonal(pq.symmetric(), axis1=1, axis2=2), 0)


def test_one_bit_codes_estimate_distances(spark, cloud):
    x, docs, _ = cloud
    codec = codecs.RaBit.fit(docs)
    got = codec.estimate(x[0], *codec.encode(x))
    want = ((x - x[0]) ** 2).sum(1)
    assert np.corrcoef(got, want)[0, 1] > 0.9
    point = codecs.lattice_encode(x, 14)
    assert ((point**2).sum(1) == 14).all()
    coded = codecs.lsh(docs, 8, thresholds=True)(docs)
    ones = [sum(bin(r.code[0]).count("1") for r in coded.collect())]
    assert 0.4 < ones[0] / (8 * len(x)) < 0.6
    assert value(spark, codecs.spectral_bits(vec(0.1, 0.6, 1.1), 1.0)) == [1, 0, 1]


def test_binary_search_forms(spark, cloud):
    _, docs, _ = cloud
    codes = binary.from_float(docs).select("doc_id", "code")
    asked = codes.limit(5).select(F.col("doc_id").alias("qid"), F.col("code").alias("qcode"))
    exact = binary.knn(codes, asked, 3)
    assert exact.filter("rank = 1 and score <> 0").count() == 0
    wide = binary.hash_search(codes, asked, 3, 4, 4)
    assert wide.select("qid", "doc_id", "score").exceptAll(exact.select("qid", "doc_id", "score")).count() == 0
    centroids = codes.limit(3).select(F.col("doc_id").cast("int").alias("list_no"), F.col("code").alias("ccode"))
    assert binary.ivf_search(codes, asked, centroids, 3, 3).select("qid", "doc_id").exceptAll(exact.select("qid", "doc_id")).count() == 0
    assert len(binary.flips(4, 2)) == 11


def test_maintenance(spark, cloud):
    _, docs, _ = cloud
    centroids = cluster.first_centroids(docs, 3)
    lists = search.build_lists(docs, centroids, "l2")
    assert maintain.add(lists, docs.limit(3).withColumn("doc_id", F.col("doc_id") + 1000), centroids, "l2").count() == 183
    assert maintain.concatenate(docs.limit(3), docs.limit(3)).select("doc_id").distinct().count() > 3
    assert maintain.block(docs, 4, 1).count() == 45
    assert {r.shard for r in maintain.shard(centroids, 2).collect()} == {0, 1}
    stacked = maintain.stack_lists(lists, lists, per_table=3)
    assert stacked.agg(F.max("list_no")).first()[0] <= 5 and maintain.list_range(stacked, 3, 6).count() == 180
    assert maintain.subset_by_range(docs, 10, 20).count() == 10


def test_calibration(spark, cloud):
    _, docs, queries = cloud
    legal = predicates.equality(docs, queries)
    truth = evaluate.ground_truth(docs, queries, 3, on=F.col("attr") == F.col("eq"))
    centroids = cluster.kmeans(docs, 3, 3, "inner_product", spherical=True, split=False)
    lists = search.build_lists(docs, centroids)
    cost = calibrate.cost_at_recall(lists, centroids, queries, legal, truth, 3, 0.1)
    assert 0 < cost <= 180
    alpha, beta, least, known = calibrate.coordinate_search(lambda a, b: (math.log(a) - 1) ** 2 + (math.log(b) + 1) ** 2, 1.0, 1.0)
    assert least < 0.3 and len(known) > 9
    points = calibrate.explore({"a": [1, 2, 3]}, lambda p: (p["a"] / 3, p["a"]))
    assert len(points) == 3 and len(calibrate.pareto(points)) == 3
    assert calibrate.scramble([1, 2, 3, 4, 5])[:2] == [1, 5] and calibrate.axis(1, 4, 3, zero=True) == pytest.approx([0, 1, 2, 4])
    assert calibrate.half_width([1.0]) == math.inf and calibrate.half_width([1, 1, 1]) == 0
    assert list(calibrate.batches(6)) == [(0, 1), (1, 3), (3, 6)]
    m = calibrate.measure(lambda: docs.limit(5), 5, warmup=0, least=2, target=None)
    assert len(m.seconds) == 2 and m.qps > 0
    with pytest.raises(RuntimeError):
        calibrate.require_agreement(1, 2, 0.1)


@pytest.mark.parametrize("metric", ["inner_product", "l2"])
def test_scan_deals_many_queries_into_blocks(spark, metric):
    rng = np.random.default_rng(3)
    x, q = rng.normal(size=(300, 4)), rng.normal(size=(search.BLOCK + 104, 4))
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "doc_id long, vec array<double>")
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "qid long, qvec array<double>")
    score = q @ x.T if metric == "inner_product" else -((q[:, None] - x[None]) ** 2).sum(2)
    want = np.argsort(-score, axis=1, kind="stable")[:, :3]
    got = search.scan(docs, queries, 3, metric).toPandas()
    assert len(got) == 3 * len(q)
    got = got.sort_values(["qid", "rank"]).doc_id.to_numpy().reshape(-1, 3)
    assert (got == want).all()
    few = search.scan(docs, queries.filter("qid < 40"), 3, metric, block=7).toPandas().sort_values(["qid", "rank"])
    assert (few.doc_id.to_numpy().reshape(-1, 3) == want[:40]).all()


def test_packed_bits_are_computed_once_a_row(spark):
    """Words that are all zeros or all ones by chance stay so: they would mix if each bit asked for its word anew."""
    words = F.array(F.when(F.rand(3) < 0.5, F.lit(0)).otherwise(F.lit(-1)).cast("long"))
    for column in (V.words_to_signs(words, 64), V.words_to_signs(V.shuffle_bits(words, list(range(63, -1, -1))), 64)):
        rows = [set(r.v) for r in spark.range(40).select(column.alias("v")).collect()]
        assert all(len(r) == 1 for r in rows) and len(set.union(*rows)) == 2
