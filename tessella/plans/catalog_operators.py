"""Queries, with SQL oracles, of the operators that no query of :mod:`catalog` exercises: sources and sinks, predicates and
selectors, joins and top-k, clustering, transforms, codecs, indexes by description, maintenance and evaluation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tessella.functions import vectors as V
from tessella.operators import binary, calibrate, cluster, codecs, evaluate, maintain, predicates, routing, search, topk, transforms
from tessella.plans import config
from tessella.plans.catalog import _HAMMING, _CODES_SQL, _PR, _FOUND, _TERMS, _TRUTH, EVERY, IVF, K, LABELS, LISTS, NPROBE, PROBES, RADIUS, TABLES, _asked, _centroids, _codes, _docs, _ip, _l2, _lists, _out, _pair, _postings, _ranged, _table, _top, _top_bits, _bits_out, _zip, query
from tessella.plans.factory import code_size, parse
from tessella.plans.index import Index
from tessella.sources import files


def _long(name):
    return F.col(name).cast("long").alias(name)


def _cells(df, vec="vec", digits=6, ident="doc_id"):
    """A row per component."""
    return df.select(ident, F.posexplode(vec).alias("dim", "x")).select(ident, _long("dim"), F.round(F.col("x").cast("double"), digits).alias("x"))


def _cells_sql(vec, digits=6, source="docs", ident="doc_id", tables=TABLES, dims=64):
    return f"with {tables} select {ident}, unnest(range({dims})) dim, round(unnest({vec})::DOUBLE, {digits}) x from {source}"


_ALL = _top(TABLES, f"select qid, doc_id, {_ip('qvec', 'vec')} score from q, docs")
_ALL_L2 = _top(TABLES, f"select qid, doc_id, {_l2('qvec', 'vec')} score from q, docs", better="asc")
_SCALE = "list_transform(vec, lambda x: x::DOUBLE)"


# Sources and sinks


@query(f"with {TABLES} select qid, eq from q where qid >= 100 and qid < 300")
def scan_query_slice(spark, sf):
    return predicates.slice_queries(_asked(spark, sf), 100, 200, _docs(spark, sf).count()).select("qid", "eq")


@query(f"with r as ({_ALL}) select qid, doc_id, rank from r where qid >= 100 and qid < 300 and rank <= 5")
def scan_truth_slice(spark, sf):
    truth = evaluate.ground_truth(_docs(spark, sf), _asked(spark, sf), K)
    return files.read_truth(truth, 100, 200, 5).select("qid", "doc_id", _long("rank"))


@query(f"with {TABLES} select doc_id, string_agg(qid::VARCHAR, ',' order by qid) qids from q join docs on attr = eq group by 1")
def scan_masks_transposed(spark, sf):
    rows = predicates.transpose(predicates.equality(_docs(spark, sf), _asked(spark, sf)))
    return rows.select("doc_id", F.array_join(F.col("qids").cast("array<string>"), ",").alias("qids"))


@query(f"with {TABLES} select qid, doc_id from q join docs on attr = eq where qid < {config.FIT.stop}")
def scan_fit_masks(spark, sf):
    legal = predicates.equality(_docs(spark, sf), _asked(spark, sf))
    return predicates.slice_queries(legal, config.FIT.start, len(config.FIT))


@query("select vec_id doc_id, unnest(range(64)) dim, round(unnest(embedding)::DOUBLE, 6) x from embeddings")
def scan_vectors_only(spark, sf):
    return _cells(_docs(spark, sf).select("doc_id", "vec"))


@query("select vec_id doc_id, unnest(range(64)) dim, round(unnest(embedding)::DOUBLE, 6) x from embeddings")
def file_fvecs(spark, sf):
    path = files.scratch(spark)
    docs = _docs(spark, sf)
    files.write_vecs(docs, path, "fvecs")
    order = topk.argsort(docs.select("doc_id"), "doc_id", "doc_id").select(F.col("place").cast("long").alias("place"), F.col("doc_id").alias("own"))
    return _cells(files.read_vecs(spark, path, "fvecs").withColumnRenamed("doc_id", "place").join(order, "place").withColumnRenamed("own", "doc_id"))


@query("select row_number() over (order by vec_id) - 1 doc_id, unnest(range(3)) dim, unnest([vec_id, label, vec_id * 7 % 1000])::DOUBLE x from embeddings")
def file_ivecs(spark, sf):
    path = files.scratch(spark)
    rows = _docs(spark, sf).select("doc_id", F.array("doc_id", "attr", F.col("doc_id") * 7 % 1000).cast("array<int>").alias("vec"))
    files.write_vecs(rows, path, "ivecs")
    return _cells(files.read_vecs(spark, path, "ivecs"))


@query("select row_number() over (order by vec_id) - 1 doc_id, unnest(range(2)) dim, unnest([label, vec_id % 256])::DOUBLE x from embeddings")
def file_bvecs(spark, sf):
    path = files.scratch(spark)
    rows = _docs(spark, sf).select("doc_id", F.array("attr", F.col("doc_id") % 256).cast("array<int>").alias("vec"))
    files.write_vecs(rows, path, "bvecs")
    return _cells(files.read_vecs(spark, path, "bvecs"))


@query("select p_partkey % 97 doc_id, count(*) n from part group by 1")
def file_sparse(spark, sf):
    """The parts with each remainder as a sparse row, written and read again."""
    path = files.scratch(spark)
    own = _table(spark, sf, "part").groupBy((F.col("p_partkey") % 97).alias("r")).agg(F.array_sort(F.collect_list("p_partkey")).alias("keys")).collect()  # 97 rows
    rows = {r.r: r["keys"] for r in own}
    files.write_bytes(spark, f"{path}/m.spmat", files.sparse_bytes([rows.get(i, []) for i in range(97)], max(max(k) for k in rows.values()) + 1))
    return files.read_sparse(spark, path).groupBy("doc_id").agg(F.count("*").alias("n"))


_KEYWORDS = "select row_number() over (order by vec_id) - 1 d, unnest(range(30)) place from embeddings"


@query(f"select d doc_id, place, ((d * 7 + place * 11) % 30) * 11 % 30 term from ({_KEYWORDS})")
def file_keywords(spark, sf):
    """Ranked keywords: document d has at place i the word (7d + 11i) mod 30; a word's number is its place in the first record."""
    path = files.scratch(spark)
    order = topk.argsort(_docs(spark, sf).select("doc_id"), "doc_id", "doc_id").select("place")
    words = F.transform(F.sequence(F.lit(0), F.lit(29)), lambda i: F.concat(F.lit("k"), ((F.col("place") * 7 + i * 11) % 30).cast("string")))
    order.repartition(1).sortWithinPartitions("place").select(words.alias("top_30_keywords")).write.json(path)
    return files.read_keywords(spark, path).select("doc_id", F.posexplode("ranking").alias("place", "term")).select("doc_id", _long("place"), "term")


@query("select row_number() over (order by l_orderkey, l_partkey) - 1 qid, l_partkey term from lineitem where l_linenumber = 1")
def file_term_ids(spark, sf):
    path = files.scratch(spark)
    rows = _table(spark, sf, "lineitem").filter("l_linenumber = 1").repartition(1).sortWithinPartitions("l_orderkey", "l_partkey")
    rows.select(F.col("l_partkey").cast("string")).write.text(path)
    return files.read_term_ids(spark, path)


@query("select l_partkey term, count(distinct l_orderkey) n from lineitem group by 1")
def file_saved_predicates(spark, sf):
    path = files.scratch(spark)
    files.save_tables({"postings": _postings(spark, sf)}, path, kind="predicates")
    return files.load_tables(spark, path)[0]["postings"].groupBy("term").agg(F.count("*").alias("n"))


@query(f"with {IVF} select doc_id, list_no::BIGINT list_no from lists")
def file_saved_index(spark, sf):
    path = files.scratch(spark)
    files.save_tables({"lists": _lists(spark, sf), "centroids": _centroids(spark, sf)}, path, lists_of=LISTS)
    tables, _ = files.load_tables(spark, path)
    return tables["lists"].select("doc_id", _long("list_no"))


@query("select label::BIGINT attr, count(*) n from embeddings group by 1")
def file_cached(spark, sf):
    path, docs = files.scratch(spark), _docs(spark, sf)
    n, made = docs.count(), []

    def build():
        made.append(1)
        return {"docs": docs}

    files.load_or_build(spark, path, build, n)
    tables = files.load_or_build(spark, path, build, n)
    assert len(made) == 1
    return tables["docs"].groupBy("attr").agg(F.count("*").alias("n"))


@query("select n_name name, n_regionkey::BIGINT region from nation")
def file_csv(spark, sf):
    path = files.scratch(spark)
    files.write_csv(_table(spark, sf, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")), path)
    return spark.read.option("header", True).schema("name string, region long").csv(path)


@query("with s as (select 0.1::DOUBLE * pow(100::DOUBLE, i / 4.0) alpha from range(5) t(i)) select round(alpha, 6) alpha, round(beta, 6) beta, round(pow(ln(alpha), 2) + pow(ln(beta) - 1, 2), 6) cost from s, (select alpha beta from s)")
def file_calibration_csv(spark, sf):
    """A grid of settings and costs as the CSV file that tuning leaves."""
    path = files.scratch(spark)
    values = calibrate.axis(0.1, 10.0, 5)
    rows = spark.createDataFrame([(a, b, float(np.log(a) ** 2 + (np.log(b) - 1) ** 2)) for a in values for b in values], "alpha double, beta double, cost double")
    files.write_csv(rows.select(*[F.round(c, 6).alias(c) for c in rows.columns]), path)
    return spark.read.option("header", True).schema("alpha double, beta double, cost double").csv(path)


@query("select vec_id % 4 part, count(*) n, sum(vec_id)::BIGINT total from embeddings group by 1")
def dataset_blocks(spark, sf):
    """A registered dataset's database in four blocks."""
    catalogue = files.Catalogue(spark)
    catalogue.register("own", database=_docs(spark, sf), queries=_asked(spark, sf))
    out = None
    for i, part in enumerate(catalogue.parts("own", 4)):
        row = part.agg(F.lit(i).cast("long").alias("part"), F.count("*").alias("n"), F.sum("doc_id").alias("total"))
        out = row if out is None else out.unionByName(row)
    return out


@query(f"with {IVF} select doc_id, list_no::BIGINT list_no from lists")
def disk_lists(spark, sf):
    path = files.scratch(spark)
    files.write_lists(_lists(spark, sf), path)
    return files.read_lists(spark, path).select("doc_id", _long("list_no"))


@query(f"with {IVF} select doc_id, list_no::BIGINT list_no from lists")
def disk_lists_merged(spark, sf):
    """Four shards on disk merged into one."""
    path = files.scratch(spark)
    lists = _lists(spark, sf)
    for i in range(4):
        files.write_lists(maintain.block(lists, 4, i), f"{path}/{i}")
    files.merge_lists(spark, [f"{path}/{i}" for i in range(4)], f"{path}/all")
    return files.read_lists(spark, f"{path}/all").select("doc_id", _long("list_no"))


@query("select i doc_id, true inside from range(1000) t(i)")
def smooth_vectors(spark, sf):
    """Generated vectors stay between 0 and 1."""
    return files.smooth(spark, 1000, 16).select("doc_id", F.forall("vec", lambda x: (x >= 0) & (x <= 1)).alias("inside"))


@query("select i doc_id, 16::BIGINT dims, true inside from range(1000) t(i)")
def synthetic_vectors(spark, sf):
    rows = files.synthetic(spark, 1000, 16)
    return rows.select("doc_id", F.size("vec").cast("long").alias("dims"), F.forall("vec", lambda x: F.abs(x) <= 1).alias("inside"))


@query("select i doc_id, true inside from range(2000) t(i)")
def random_uniform(spark, sf):
    return files.random_vectors(spark, 2000, 8, normal=False).select("doc_id", F.forall("vec", lambda x: (x > 0) & (x <= 1)).alias("inside"))


@query("select vec_id doc_id from embeddings")
def random_permutation(spark, sf):
    """Every row once, in another order."""
    return files.permutation(_docs(spark, sf)).select("doc_id")


# Predicates and selectors


@query("select l_orderkey doc_id, l_partkey term from lineitem group by 1, 2")
def categorical_index(spark, sf):
    rows = _table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.collect_list("l_partkey").alias("terms"))
    return predicates.doc_terms(rows)


@query("with post as (select distinct l_orderkey doc_id, l_partkey term from lineitem) select term, count(*) n, count(*) >= 2 dense from post group by 1")
def posting_stats_threshold(spark, sf):
    return predicates.posting_stats(_postings(spark, sf), 0, threshold=2)


@query(f"with {TABLES} select qid, eq term, doc_id from q join docs on attr = eq where doc_id % 3 = 0")
def postings_by_mask(spark, sf):
    docs, asked = _docs(spark, sf), _asked(spark, sf)
    third = search.meet(docs.filter(F.col("doc_id") % 3 == 0), asked).select("qid", "doc_id")
    postings = predicates.equality(docs, asked).join(asked.select("qid", F.col("eq").alias("term")), "qid")
    return predicates.filter_postings(postings, predicates.to_bitmaps(third)).select("qid", "term", "doc_id")


@query("select o_orderkey doc_id, o_totalprice attr, row_number() over (order by o_totalprice, o_orderkey) - 1 place from orders")
def range_index(spark, sf):
    docs = _table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_totalprice").alias("attr"))
    return predicates.range_index(docs).select("doc_id", "attr", _long("place"))


@query("with q as (select i qid, pow(2, i) lo, pow(2, i + 1 + i % 3) hi from range(20) t(i)) select qid, o_orderkey doc_id from q join orders on o_totalprice >= lo and o_totalprice < hi")
def range_mixed_widths(spark, sf):
    docs = _table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_totalprice").alias("attr"))
    i = F.col("id")
    preds = spark.range(20).select(i.alias("qid"), F.pow(F.lit(2.0), i).alias("lo"), F.pow(F.lit(2.0), i + 1 + i % 3).alias("hi"))
    return predicates.ranges(docs, preds)


_MASK = f"with {TABLES}, l as (select qid, doc_id from q join docs on attr = eq), b as (select distinct qid, doc_id // 1024 bucket from l)"


@query(f"{_MASK} select qid, bucket, string_agg(case when exists (select 1 from l where l.qid = b.qid and l.doc_id = b.bucket * 1024 + i) then '01' else '00' end, '' order by i) mask from b, range(1024) t(i) group by 1, 2")
def byte_masks(spark, sf):
    rows = predicates.to_masks(predicates.equality(_docs(spark, sf), _asked(spark, sf)), "bytes")
    return rows.select("qid", "bucket", F.hex("mask").alias("mask"))


@query(f"with {TABLES} select qid, doc_id from q join docs on attr = eq")
def mask_forms(spark, sf):
    """The relation through a byte mask and then a packed one."""
    legal = predicates.equality(_docs(spark, sf), _asked(spark, sf))
    again = predicates.from_byte_masks(predicates.to_masks(legal, "bytes"))
    return predicates.from_bitmaps(predicates.to_masks(again, "bits"))


@query(f"with {IVF}, o as (select doc_id, row_number() over (order by list_no, doc_id) - 1 p from lists) select qid, p doc_id from q join docs on attr = eq join o using (doc_id)")
def mask_reordered(spark, sf):
    order = maintain.cluster_major(_lists(spark, sf)).select("doc_id", _long("position"))
    return predicates.reorder(predicates.equality(_docs(spark, sf), _asked(spark, sf)), order)


@query(f"with {TABLES} select min(qid) qid from q where qid >= 150")
def mask_first_difference(spark, sf):
    """The first query of which a relation has lost a document: those from 150 on."""
    legal = predicates.equality(_docs(spark, sf), _asked(spark, sf))
    return predicates.first_difference(legal, legal.filter((F.col("qid") < 150) | (F.col("doc_id") % 10 != F.col("qid") % 10) | (F.col("doc_id") > 400)).unionByName(legal.filter("qid >= 150").groupBy("qid").agg((F.max("doc_id") + 1_000_000).alias("doc_id"))))


@query(f"with {TABLES}, u as (select qid, doc_id from q join docs on attr = eq union select qid, doc_id from q, docs where doc_id % 5 = 0) select qid, count(*) n from u group by 1")
def bitmap_union(spark, sf):
    docs, asked = _docs(spark, sf), _asked(spark, sf)
    fifth = search.meet(docs.filter(F.col("doc_id") % 5 == 0), asked).select("qid", "doc_id")
    return predicates.bitmap_sizes(predicates.union_bitmaps(*[predicates.to_bitmaps(x) for x in (predicates.equality(docs, asked), fifth)]))


@query("select vec_id doc_id from embeddings where vec_id in (select o_orderkey from orders where o_orderkey % 3 = 0)")
def selector_batch(spark, sf):
    ids = _table(spark, sf, "orders").filter(F.col("o_orderkey") % 3 == 0).select(F.col("o_orderkey").alias("doc_id"))
    return predicates.only(_docs(spark, sf), ids).select("doc_id")


@query("select vec_id doc_id from embeddings where vec_id not in (select o_orderkey from orders where o_orderkey % 3 = 0)")
def selector_anti(spark, sf):
    ids = _table(spark, sf, "orders").filter(F.col("o_orderkey") % 3 == 0).select(F.col("o_orderkey").alias("doc_id"))
    return predicates.without(_docs(spark, sf), ids).select("doc_id")


@query("select vec_id doc_id from embeddings where vec_id < 400 and vec_id % 8 in (0, 2, 7)")
def selector_bitmap(spark, sf):
    return _docs(spark, sf).filter(predicates.id_bitmap(bytes([0b10000101]) * 50).on()).select("doc_id")


@query("select vec_id doc_id from embeddings")
def selector_all(spark, sf):
    return _docs(spark, sf).filter(predicates.everything().on()).select("doc_id")


@query("select vec_id doc_id from embeddings where vec_id * 3 + 1 >= 100 and vec_id * 3 + 1 < 500")
def selector_translated(spark, sf):
    docs = _docs(spark, sf)
    id_map = docs.select("doc_id", (F.col("doc_id") * 3 + 1).alias("external"))
    return predicates.translated(docs, id_map, predicates.id_range(100, 500)).select("doc_id")


@query("select vec_id doc_id from embeddings where vec_id % 7 = 3")
def selector_callback(spark, sf):
    return _docs(spark, sf).filter(predicates.callback(lambda i: i % 7 == 3).on()).select("doc_id")


@query(_top(TABLES, f"select qid, doc_id, {_ip('qvec', 'vec')} score from q, docs where (qid + doc_id) % 3 = 0"))
def selector_2d(spark, sf):
    chosen = predicates.pairs_where(lambda q, d: (q + d) % 3 == 0)
    return _out(search.knn(_docs(spark, sf), _asked(spark, sf), K, on=chosen.on()))


@query(_top(TABLES, f"select qid, doc_id, {_ip('qvec', 'vec')} score from q, docs where (qid + doc_id) % 3 = 0 and doc_id >= 50"))
def selector_2d_and_1d(spark, sf):
    chosen = predicates.pairs_where(lambda q, d: (q + d) % 3 == 0) & ~predicates.id_range(0, 50)
    return _out(search.knn(_docs(spark, sf), _asked(spark, sf), K, on=chosen.on()))


@query("select vec_id doc_id from embeddings where (100 + vec_id) % 3 = 0")
def selector_2d_for_query(spark, sf):
    return _docs(spark, sf).filter(predicates.pairs_where(lambda q, d: (q + d) % 3 == 0).for_query(100).on()).select("doc_id")


@query(_top(TABLES, f"select qid, doc_id, {_ip('qvec', 'vec')} score from q, docs where qid * doc_id % 5 = 0"))
def selector_2d_callback(spark, sf):
    return _out(search.knn(_docs(spark, sf), _asked(spark, sf), K, among=predicates.pairs_callback(lambda q, d: q * d % 5 == 0)))


@query(f"with {TABLES} select qid, doc_id from q join docs on attr = eq where doc_id < 300")
def selector_2d_hashed(spark, sf):
    docs, asked = _docs(spark, sf), _asked(spark, sf)
    rows = search.meet(docs.filter("doc_id < 300"), asked).select("qid", "doc_id")
    return predicates.only_pairs(rows, predicates.equality(docs, asked))


@query(f"with {TABLES} select qid, doc_id from q join docs on attr = eq where doc_id < 300")
def selector_2d_bitmap(spark, sf):
    docs, asked = _docs(spark, sf), _asked(spark, sf)
    rows = search.meet(docs.filter("doc_id < 300"), asked).select("qid", "doc_id")
    return predicates.only_in_bitmaps(rows, predicates.to_bitmaps(predicates.equality(docs, asked)))


_RANKED = "ranked as (select vec_id doc_id, list_transform(range(30), lambda i: (vec_id * 7 + i * 11) % 30) ranking from embeddings), kw as (select distinct doc_id, unnest(list_slice(ranking, 1, 3)) term, 'top' side from ranked union select distinct doc_id, unnest(list_slice(ranking, 28, 30)), 'bottom' from ranked)"


def _keyword_side(spark, sf):
    ranking = F.transform(F.sequence(F.lit(0), F.lit(29)), lambda i: (F.col("doc_id") * 7 + i * 11) % 30)
    return predicates.keyword_terms(_docs(spark, sf).withColumn("ranking", ranking))


@query(f"with {_RANKED} select doc_id, term, side from kw")
def keyword_terms(spark, sf):
    return _keyword_side(spark, sf)


@query(f"with {_RANKED}, q as (select vec_id qid, vec_id % 30 term from embeddings where vec_id % 25 = 0) select qid, doc_id from q join kw using (term) where side = case when qid % 2 = 0 then 'top' else 'bottom' end")
def keyword_workload(spark, sf):
    asked = _docs(spark, sf).filter("doc_id % 25 = 0").select(F.col("doc_id").alias("qid"), (F.col("doc_id") % 30).alias("term"))
    return predicates.keyword_workload(asked, _keyword_side(spark, sf), "alternating")


@query(f"with {TABLES} select qid, true inside from q")
def workload_range(spark, sf):
    """Generated ranges are as wide as asked, inside the domain."""
    rows = predicates.range_workload(_asked(spark, sf).select("qid"), 10)
    return rows.select("qid", ((F.col("hi") - F.col("lo") == 10) & (F.col("lo") >= 0) & (F.col("hi") <= 1001)).alias("inside"))


@query(f"with {TABLES} select qid, true inside from q")
def workload_equality(spark, sf):
    return predicates.equality_workload(_asked(spark, sf).select("qid"), 12).select("qid", ((F.col("eq") >= 0) & (F.col("eq") < 12)).alias("inside"))


# Distances and vector arithmetic


@query(f"with {TABLES} select qid, doc_id, round({_l2('qvec', 'vec')}, 6) score from q, docs")
def pairwise(spark, sf):
    return _ranged(search.pairwise(_docs(spark, sf), _asked(spark, sf), "l2"))


@query(f"with {TABLES} select qid, doc_id, round({_l2('qvec', 'vec')}, 6) score from q, docs")
def l2_from_products(spark, sf):
    """Squared distances from norms and inner products."""
    rows = search.products(_docs(spark, sf), _asked(spark, sf)).select("qid", "doc_id", V.l2_from_inner_product("qnorm", "norm", "ip").alias("score"))
    return _ranged(rows.withColumn("score", F.abs("score"))).withColumn("score", F.round(F.when(F.col("score") < 1e-9, 0.0).otherwise(F.col("score")), 6))


@query(f"with {TABLES} select qid, doc_id, round({_l2('qvec', 'vec')}, 6) score from q join docs on doc_id = qid + 1 or doc_id = qid + 7")
def distances_by_index(spark, sf):
    asked = _asked(spark, sf)
    pairs = asked.select("qid", F.explode(F.array(F.col("qid") + 1, F.col("qid") + 7)).alias("doc_id"))
    return _ranged(search.by_index(pairs, _docs(spark, sf), asked))


@query(_cells_sql(f"list_transform(list_zip({_SCALE}, list_reverse({_SCALE})), lambda z: z[1] + 0.5 * z[2])"))
def vector_multiply_add(spark, sf):
    return _cells(_docs(spark, sf).select("doc_id", V.multiply_add("vec", 0.5, F.reverse("vec")).alias("vec")))


@query(_cells_sql(f"list_transform(list_zip({_SCALE}, list_reverse({_SCALE})), lambda z: z[1] + z[2])"))
def vector_add(spark, sf):
    return _cells(_docs(spark, sf).select("doc_id", V.add("vec", F.reverse("vec")).alias("vec")))


@query(_cells_sql(f"list_transform(list_zip({_SCALE}, list_reverse({_SCALE})), lambda z: z[1] - z[2])"))
def vector_subtract(spark, sf):
    return _cells(_docs(spark, sf).select("doc_id", V.subtract("vec", F.reverse("vec")).alias("vec")))


@query(f"with {TABLES}, c as (select doc_id, unnest(range(64)) dim, unnest(list_transform(list_zip({_SCALE}, list_reverse({_SCALE})), lambda z: z[1] + 0.5 * z[2])) x from docs) select doc_id, dim argmin, round(x, 6) least from (select *, row_number() over (partition by doc_id order by x, dim) r from c) where r = 1")
def vector_multiply_add_argmin(spark, sf):
    rows = _docs(spark, sf).select("doc_id", V.multiply_add_argmin("vec", 0.5, F.reverse("vec")).alias("m"))
    return rows.select("doc_id", F.col("m.argmin").cast("long").alias("argmin"), F.round(F.array_min("m.vec"), 6).alias("least"))


@query(f"with {TABLES} select qid, doc_id, list_sum(list_transform(list_zip(qvec, vec), lambda z: case when floor(z[1] * 10) <> floor(z[2] * 10) then 1 else 0 end))::BIGINT score from q, docs")
def generalized_hamming(spark, sf):
    coarse = lambda c: F.transform(c, lambda x: F.floor(x * 10))
    rows = search.meet(_docs(spark, sf), _asked(spark, sf))
    return rows.select("qid", "doc_id", V.generalized_hamming(coarse("qvec"), coarse("vec")).cast("long").alias("score"))


@query(f"with {TABLES}, s as (select doc_id, unnest(range(64)) dim, unnest({_SCALE}) x from docs), m as (select doc_id, sum(case when dim % 4 = 0 then x else 0 end) a, sum(case when dim % 4 = 1 then x * 2 else 0 end) + 1 b from s group by 1) select doc_id, 0::BIGINT dim, round(a, 6) x from m union all select doc_id, 1, round(b, 6) from m")
def matrix_multiply(spark, sf):
    rows = [[1.0 if d % 4 == 0 else 0.0 for d in range(64)], [2.0 if d % 4 == 1 else 0.0 for d in range(64)]]
    return _cells(_docs(spark, sf).select("doc_id", V.matrix_multiply(rows, "vec", [0.0, 1.0]).alias("vec")))


@query(_ALL_L2)
def scan_arrow_l2(spark, sf):
    return _out(search.scan(_docs(spark, sf), _asked(spark, sf), K, "l2")).withColumn("score", F.round(F.abs("score"), 6))


@query(f"with {TABLES} select doc_id, round(sqrt({_ip('vec', 'vec')}), 6) norm from docs")
def normalize_strict(spark, sf):
    """Vectors given lengths again after a strict normalisation."""
    docs = _docs(spark, sf)
    rows = docs.select("doc_id", V.norm("vec").alias("n"), V.normalize_strict("vec").alias("unit"))
    return rows.select("doc_id", F.round(F.col("n") * V.norm("unit"), 6).alias("norm"))


# Joins


@query(_ALL)
def sharded_search(spark, sf):
    """Three shards searched apart and merged."""
    docs, asked = _docs(spark, sf), _asked(spark, sf)
    return _out(topk.merge_results(*[search.knn(maintain.block(docs, 3, i), asked, K) for i in range(3)], k=K, similar=True))


@query(f"with r as ({_ALL}) select qid, case when doc_id % 2 = 0 then doc_id * 10 else -1 end doc_id, rank from r")
def id_map(spark, sf):
    docs, asked = _docs(spark, sf), _asked(spark, sf)
    even = docs.filter("doc_id % 2 = 0").select(F.col("doc_id").alias("internal"), (F.col("doc_id") * 10).alias("external"))
    return search.map_ids(search.knn(docs, asked, K), even).select("qid", "doc_id", _long("rank"))


@query(_top(PROBES, f"select qid, doc_id, {_ip('qvec', 'vec')} score from probes join q using (qid) join lists using (list_no)"))
def list_major_search(spark, sf):
    asked = _asked(spark, sf)
    return _out(search.list_major(_lists(spark, sf), asked, search.coarse(asked, _centroids(spark, sf), NPROBE), K, piece=100))


@query(f"with {PROBES} select (select count(distinct qid) from probes) queries, (select count(*) from probes) lists, count(*) documents, count(*) filter (attr = eq) scored from probes join q using (qid) join lists using (list_no)")
def search_stats(spark, sf):
    asked = _asked(spark, sf)
    return search.search_stats(search.coarse(asked, _centroids(spark, sf), NPROBE), _lists(spark, sf), F.col("attr") == F.col("eq"), asked)


@query(f"with r as ({_ALL}) select qid, doc_id, unnest(range(64)) dim, round(unnest(embedding)::DOUBLE, 6) x from r join embeddings on vec_id = doc_id where rank = 1")
def reconstruct(spark, sf):
    docs, asked = _docs(spark, sf), _asked(spark, sf)
    rows = search.reconstruct(search.knn(docs, asked, 1), docs)
    return rows.select("qid", "doc_id", F.posexplode("vec").alias("dim", "x")).select("qid", "doc_id", _long("dim"), F.round(F.col("x").cast("double"), 6).alias("x"))


@query("select count(*) edges, true near from embeddings, range(10)")
def neighbour_descent(spark, sf):
    """An approximate graph: ten edges a document, of which at least nine in ten are those of the exact graph."""
    docs = _docs(spark, sf)
    graph = search.neighbour_descent(docs, K, rounds=4, metric="l2")
    exact = search.knn_graph(docs, K, "l2").select("src", "dst", F.lit(1).alias("hit"))
    return graph.join(exact, ["src", "dst"], "left").agg(F.count("*").alias("edges"), (F.count("hit") >= 0.9 * F.count("*")).alias("near"))


# Aggregation and ranking


@query(f"with {TABLES}, s as (select qid, doc_id, {_ip('qvec', 'vec')} score from q, docs) select qid, round(min(score), 6) least, (select doc_id from s t where t.qid = s.qid order by score, doc_id limit 1) least_id, round(max(score), 6) largest, (select doc_id from s t where t.qid = s.qid order by score desc, doc_id limit 1) largest_id from s group by 1")
def heap_extrema(spark, sf):
    rows = topk.extrema(search.pairwise(_docs(spark, sf), _asked(spark, sf), "inner_product"))
    return rows.select("qid", F.round("least", 6).alias("least"), "least_id", F.round("largest", 6).alias("largest"), "largest_id")


@query(_cells_sql(f"list_slice(list_sort({_SCALE}), 1, 5)", dims=5))
def k_smallest(spark, sf):
    return _cells(_docs(spark, sf).select("doc_id", topk.k_smallest("vec", 5).alias("vec")))


@query(_cells_sql(f"list_slice(list_reverse_sort({_SCALE}), 1, 5)", dims=5))
def k_largest(spark, sf):
    return _cells(_docs(spark, sf).select("doc_id", topk.k_largest("vec", 5).alias("vec")))


@query("select o_orderkey doc_id, row_number() over (order by o_totalprice, o_orderkey) - 1 place from orders")
def argsort(spark, sf):
    rows = _table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), "o_totalprice")
    return topk.argsort(rows, "o_totalprice", "doc_id").select("doc_id", _long("place"))


@query("select min(c_custkey) depth from customer where c_custkey / 1000.0 >= 0.05")
def first_depth(spark, sf):
    curve = _table(spark, sf, "customer").select(F.col("c_custkey").alias("depth"), (F.col("c_custkey") / 1000).alias("recall"))
    return topk.first_depth(curve, 0.05).select(_long("depth"))


@query(f"with {TABLES}, f as (select qid, doc_id, rank from (select qid, doc_id, row_number() over (partition by qid order by {_ip('qvec', 'vec')} desc, doc_id) rank from q join docs on attr = eq and doc_id % 40 = qid % 40) where rank <= {K}), slots as (select qid, unnest(range(1, {K} + 1)) rank from q) select qid, rank, coalesce(doc_id, -1) doc_id from slots left join f using (qid, rank)")
def pad_missing(spark, sf):
    asked = _asked(spark, sf)
    found = search.knn(_docs(spark, sf), asked, K, on=(F.col("attr") == F.col("eq")) & (F.col("doc_id") % 40 == F.col("qid") % 40))
    return topk.pad_missing(found, asked, K).select("qid", _long("rank"), "doc_id")


@query(_top(TABLES, f"select qid, doc_id, score from (select qid, doc_id, {_ip('qvec', 'vec')} score, row_number() over (partition by qid, doc_id % 16 order by {_ip('qvec', 'vec')} desc, doc_id) r from q, docs) where r = 1"))
def approximate_top_k(spark, sf):
    return _out(topk.approximate_top_k(search.pairwise(_docs(spark, sf), _asked(spark, sf), "inner_product"), K, True, 16))


@query(f"with r as ({_ALL_L2}) select qid, doc_id, score, max(score) over (partition by qid) threshold from r")
def partition(spark, sf):
    rows = topk.partition(search.pairwise(_docs(spark, sf), _asked(spark, sf)), K, False)
    return rows.select("qid", "doc_id", F.round("score", 6).alias("score"), F.round("threshold", 6).alias("threshold"))


@query(f"with {TABLES}, r as (select qid, doc_id, row_number() over (partition by qid order by attr desc, doc_id) n, attr from q, docs), c as (select qid, min(attr) cut from r where n <= 5 group by 1) select qid, doc_id from r join c using (qid) where n <= 20 and attr >= cut")
def fuzzy_partition(spark, sf):
    rows = search.meet(_docs(spark, sf), _asked(spark, sf)).select("qid", "doc_id", F.col("attr").cast("double").alias("score"))
    return topk.fuzzy_partition(rows, 5, 20, True).select("qid", "doc_id")


@query(f"with {TABLES}, r as (select qid, doc_id, row_number() over (partition by qid order by attr desc, doc_id) rank from q, docs) select qid, doc_id, rank from r where rank <= {K}")
def rank_list_ties(spark, sf):
    """A result whose runs of equal scores are in descending order of id, put right."""
    rows = search.meet(_docs(spark, sf), _asked(spark, sf)).select("qid", "doc_id", F.col("attr").cast("double").alias("score"))
    best = topk.top_k(rows, K, True)
    turned = best.withColumn("rank", F.row_number().over(topk.Window.partitionBy("qid").orderBy(F.desc("score"), F.desc("doc_id"))))
    return topk.handle_ties(turned).select("qid", "doc_id", _long("rank"))


@query(f"with r as ({_ALL}) select qid, rank, round(sum(score) over (partition by qid order by rank), 5) total from r")
def cumulate(spark, sf):
    found = search.knn(_docs(spark, sf), _asked(spark, sf), K).withColumn("score", F.round("score", 6))
    return topk.cumulate(found, "score", "total").select("qid", _long("rank"), F.round("total", 5).alias("total"))


@query(f"with {TABLES}, r as (select qid, doc_id, {_l2('qvec', 'vec')} score from q, docs), k as (select * from (select *, row_number() over (partition by qid order by score, doc_id) n from r) where n <= {K}), full_ as (select qid from k where score < {RADIUS} group by 1 having count(*) >= {K}) select qid, doc_id, round(score, 6) score from r where score < {RADIUS} and (qid in (select qid from full_) or (qid, doc_id) in (select (qid, doc_id) from k))")
def knn_and_range(spark, sf):
    return _ranged(search.knn_and_range(_docs(spark, sf), _asked(spark, sf), K, RADIUS, "l2"))


@query("with c as (select l_orderkey % 20 g, count(*)::DOUBLE n from lineitem group by 1), s as (select count(*) k, avg(n) m, stddev_samp(n) d from c) select round(2.093 * d / sqrt(k) / m, 6) half_width from s")
def mean_interval(spark, sf):
    """Half the 95 % interval of a mean of twenty counts, as a share of it."""
    rows = _table(spark, sf, "lineitem").groupBy(F.col("l_orderkey") % 20).count().collect()
    return spark.createDataFrame([(round(calibrate.half_width([float(r["count"]) for r in rows]), 6),)], "half_width double")


@query("select count(*) n, true same from lineitem")
def table_checksum(spark, sf):
    """A table's checksum does not depend on its order."""
    rows = _table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    a, b = evaluate.checksum(rows, *rows.columns), evaluate.checksum(rows.orderBy(F.desc("l_quantity")), *rows.columns)
    return a.join(b.select("checksum"), "checksum", "left_semi").select("n", F.lit(True).alias("same"))


@query("select bin, count(*) n from (select floor(least(x, 0.999999) * 4)::BIGINT bin from (select (vec_id % 100) / 99.0 x from embeddings)) group by 1")
def histogram_unit(spark, sf):
    rows = _docs(spark, sf).select(F.least(F.col("doc_id") % 100 / 99.0, F.lit(0.999999)).alias("x"))
    return evaluate.histogram(rows, "x", 0.0, 1.0, 4).select((F.col("bin") - 1).alias("bin"), "n")


# Set operations and lists


@query("with a as (select vec_id from embeddings where vec_id % 2 = 0), n as (select max(vec_id) + 1 n from a) select vec_id doc_id from a union all select vec_id + (select n from n) from embeddings where vec_id % 2 = 1")
def concatenate_shards(spark, sf):
    docs = _docs(spark, sf).select("doc_id")
    return maintain.concatenate(docs.filter("doc_id % 2 = 0"), docs.filter("doc_id % 2 = 1"))


@query(f"with {IVF} select doc_id, list_no::BIGINT list_no from lists where doc_id % 2 = 0 union all select doc_id, list_no::BIGINT + {LISTS} from lists where doc_id % 2 = 1")
def stack_lists(spark, sf):
    lists = _lists(spark, sf).select("doc_id", _long("list_no"))
    return maintain.stack_lists(lists.filter("doc_id % 2 = 0"), lists.filter("doc_id % 2 = 1"), per_table=LISTS)


@query(f"with {IVF} select doc_id, list_no::BIGINT list_no from lists where list_no >= 2 and list_no < 5")
def list_range(spark, sf):
    return maintain.list_range(_lists(spark, sf), 2, 5).select("doc_id", _long("list_no"))


@query(f"with {IVF} select doc_id from lists where list_no = 3")
def get_list(spark, sf):
    return maintain.get_list(_lists(spark, sf), 3).select("doc_id")


@query(f"with {IVF} select doc_id, {LISTS - 1} - list_no::BIGINT list_no from lists")
def renumber_lists(spark, sf):
    order = spark.range(LISTS).select(_long("id").alias("list_no"), (LISTS - 1 - F.col("id")).alias("new_no"))
    return maintain.renumber(_lists(spark, sf), order).select("doc_id", _long("list_no"))


@query(f"with {IVF} select list_no::BIGINT list_no, list_no::BIGINT % 3 shard from cent")
def shard_centroids(spark, sf):
    return maintain.shard(_centroids(spark, sf), 3).select(_long("list_no"), _long("shard"))


@query(f"with {IVF} select doc_id, list_no::BIGINT list_no from lists where doc_id >= 100 and doc_id < 200")
def subset_by_range(spark, sf):
    return maintain.subset_by_range(_lists(spark, sf), 100, 200).select("doc_id", _long("list_no"))


@query(f"with {IVF} select doc_id, list_no::BIGINT list_no, row_number() over (partition by list_no order by doc_id) - 1 place from lists")
def direct_map(spark, sf):
    return maintain.direct_map(_lists(spark, sf)).select("doc_id", _long("list_no"), _long("place"))


@query(f"with {IVF}, s as (select list_no, count(*) n from lists group by 1) select sum(n)::BIGINT documents, count(*) lists, min(n) least, max(n) most from s")
def inspect_lists(spark, sf):
    return maintain.inspect(_lists(spark, sf))


@query(f"with {TABLES}, c2 as (select row_number() over (order by vec_id desc) - 1 list_no, embedding cvec from (select * from embeddings order by vec_id desc limit 5)) select doc_id, list_no::BIGINT list_no from (select doc_id, list_no, row_number() over (partition by doc_id order by {_ip('vec', 'cvec')} desc, list_no) r from docs, c2) where r = 1")
def replace_quantiser(spark, sf):
    docs = _docs(spark, sf)
    last = docs.orderBy(F.desc("doc_id")).limit(5)
    other = last.select((F.row_number().over(topk.Window.orderBy(F.desc("doc_id"))) - 1).alias("list_no"), V.doubles("vec").alias("cvec"))
    return maintain.replace_quantiser(_lists(spark, sf), other).select("doc_id", _long("list_no"))


@query(f"with {IVF} select doc_id, list_no::BIGINT list_no from lists")
def add_in_parts(spark, sf):
    docs, centroids = _docs(spark, sf), _centroids(spark, sf)
    lists = search.build_lists(docs.filter("doc_id % 3 = 0"), centroids)
    return maintain.add(lists, docs.filter("doc_id % 3 <> 0"), centroids).select("doc_id", _long("list_no"))


# Routing


@query("with v as (select distinct least(round(pow(2, 10.0 * i / 19))::BIGINT, 500) depth from range(20) t(i)) select depth from v")
def probe_sweep(spark, sf):
    return spark.createDataFrame([(d,) for d in routing.sweep(0, 10, 20, 500)], "depth long")


_SIGNED = f"{IVF}, s as (select doc_id, list_no, case when attr < 5 then 1.0 else 0.0 end a, case when attr % 2 = 0 then 1.0 else 0.0 end b from lists), m as (select list_no, avg(a) a, avg(b) b, count(*) n from s group by 1)"


@query(f"with {_SIGNED} select qid, list_no::BIGINT list_no, round(least(1.0, greatest(1.0 / (select max(n) from m), (qid % 3) * 0.3 * a + 0.2 * b)), 6) p from q, m")
def predicted_selectivity(spark, sf):
    lists = _lists(spark, sf)
    signed = lists.select("doc_id", F.array((F.col("attr") < 5).cast("double"), (F.col("attr") % 2 == 0).cast("double")).alias("sig"))
    asked = _asked(spark, sf).select("qid", F.array(F.col("qid") % 3 * 0.3, F.lit(0.2)).alias("sig"))
    return routing.predicted_selectivity(asked, signed, lists).select("qid", _long("list_no"), F.round("p", 6).alias("p"))


@query(f"with {TABLES} select doc_id, unnest(range(66)) dim, round(unnest(list_concat(list_transform(vec, lambda x: x::DOUBLE / sqrt({_ip('vec', 'vec')})), [attr::DOUBLE, 1.0])), 6) x from docs")
def signature_input(spark, sf):
    """Vectors with a signature behind them."""
    docs = _docs(spark, sf).withColumn("sig", F.array(F.col("attr").cast("double"), F.lit(1.0)))
    return _cells(cluster.with_signature(docs))


@query("select vec_id doc_id, case when label < 3 then true else false end seen, true sized from embeddings")
def document_signatures(spark, sf):
    """Documents of three equality predicates have signatures of the length asked; all others' are zero."""
    docs = _docs(spark, sf)
    legal = docs.filter("attr < 3").select(F.col("attr").alias("qid"), "doc_id")
    rows = cluster.signatures(legal, 3, docs, 4, 0.5)
    size = V.norm("sig")
    return rows.select("doc_id", (size > 0.1).alias("seen"), (F.size("sig") == 4).alias("sized"))


@query("select vec_id doc_id, 0.0::DOUBLE norm from embeddings")
def degenerate_signatures(spark, sf):
    docs = _docs(spark, sf)
    rows = cluster.signatures(docs.select(F.lit(0).cast("long").alias("qid"), "doc_id"), 1, docs, 4, 0.0)
    return rows.select("doc_id", V.norm("sig").alias("norm"))


@query(_top(PROBES, f"select qid, doc_id, {_ip('qvec', 'vec')} score from probes join q using (qid) join lists using (list_no) where attr = eq"))
def plain_routing(spark, sf):
    """Routing that does not look at the predicate."""
    lists, asked = _lists(spark, sf), _asked(spark, sf)
    near = routing.probes(routing.centroid_scores(asked, _centroids(spark, sf)), None, NPROBE, 0.0, aware=False)
    return _out(search.preassigned(lists, asked, near, K, on=F.col("attr") == F.col("eq")))


# Clustering


def _means_sql(rows, extra=""):
    return f"select list_no::BIGINT list_no, dim, round(avg(x), 6) x from (select list_no, unnest(range(64)) dim, unnest(vec)::DOUBLE x from {rows}) group by 1, 2 {extra}"


_NEAR_L2 = f"{IVF}, l2 as (select * from (select d.*, c.list_no, row_number() over (partition by doc_id order by {_l2('vec', 'cvec')}, c.list_no) r from docs d, cent c) where r = 1)"


def _moved(rows, lists):
    own = lists.select("list_no").distinct()
    return rows.join(own, "list_no").select("list_no", F.posexplode("cvec").alias("dim", "x")).select(_long("list_no"), _long("dim"), F.round("x", 6).alias("x"))


@query(f"with {_NEAR_L2} {_means_sql('l2')}")
def kmeans_step_l2(spark, sf):
    docs, centroids = _docs(spark, sf), _centroids(spark, sf)
    return _moved(cluster.lloyd_step(docs, centroids, "l2"), search.build_lists(docs, centroids, "l2"))


@query(f"with {_NEAR_L2}, m as (select list_no::BIGINT list_no, dim, avg(x) x from (select list_no, unnest(range(64)) dim, unnest(vec)::DOUBLE x from l2) group by 1, 2) select list_no, dim, round(x / sqrt(sum(x * x) over (partition by list_no)), 6) x from m")
def kmeans_step_spherical(spark, sf):
    docs, centroids = _docs(spark, sf), _centroids(spark, sf)
    return _moved(cluster.lloyd_step(docs, centroids, "l2", spherical=True), search.build_lists(docs, centroids, "l2"))


@query(f"with {_NEAR_L2}, m as ({_means_sql('l2')}), f as (select list_no::BIGINT list_no, unnest(range(64)) dim, round(unnest(cvec)::DOUBLE, 6) x from cent) select * from m where list_no >= 3 union all select * from f where list_no < 3 and list_no in (select list_no from l2)")
def kmeans_step_frozen(spark, sf):
    docs, centroids = _docs(spark, sf), _centroids(spark, sf)
    return _moved(cluster.lloyd_step(docs, centroids, "l2", frozen=3), search.build_lists(docs, centroids, "l2"))


@query(f"with {_NEAR_L2} select list_no::BIGINT list_no, dim, round(sum(x * w) / sum(w), 6) x from (select list_no, attr + 1 w, unnest(range(64)) dim, unnest(vec)::DOUBLE x from l2) group by 1, 2")
def kmeans_step_weighted(spark, sf):
    docs, centroids = _docs(spark, sf).withColumn("w", (F.col("attr") + 1).cast("double")), _centroids(spark, sf)
    return _moved(cluster.lloyd_step(docs, centroids, "l2", weight="w"), search.build_lists(docs, centroids, "l2"))


@query(f"with {_NEAR_L2} select round(sum({_l2('vec', 'cvec')}), 4) objective from l2 join cent using (list_no)")
def kmeans_objective(spark, sf):
    return cluster.objective(_docs(spark, sf), _centroids(spark, sf), "l2").select(F.round("objective", 4).alias("objective"))


@query(f"with {_NEAR_L2}, m as (select list_no, list(x order by dim) cvec from (select list_no, dim, avg(x) x from (select list_no, unnest(range(64)) dim, unnest(vec)::DOUBLE x from l2) group by 1, 2) group by 1), c1 as (select c.list_no, coalesce(m.cvec, list_transform(c.cvec, lambda x: x::DOUBLE)) cvec from cent c left join m using (list_no)), n2 as (select * from (select d.*, c.list_no, row_number() over (partition by doc_id order by {_l2('vec', 'cvec')}, c.list_no) r from docs d, c1 c) where r = 1) {_means_sql('n2')}")
def kmeans_two_steps(spark, sf):
    docs, centroids = _docs(spark, sf), _centroids(spark, sf)
    after = cluster.lloyd_step(docs, centroids, "l2")
    return _moved(cluster.lloyd_step(docs, after, "l2"), search.build_lists(docs, after, "l2"))


@query("select true better, true whole")
def kmeans_trained(spark, sf):
    """Ten rounds of k-means lower the objective of the first documents as centroids, and every list is numbered."""
    docs = _docs(spark, sf)
    trained = cluster.kmeans(docs, LISTS, 5, "l2")
    a, b = (cluster.objective(docs, c, "l2").first()[0] for c in (_centroids(spark, sf), trained))
    return spark.createDataFrame([(b < a, trained.count() == LISTS)], "better boolean, whole boolean")


@query("select i list_no, true occupied from range(4) t(i)")
def empty_list_split(spark, sf):
    """Centroids of which two are far from every document: after a split all four lists have documents."""
    docs = _docs(spark, sf)
    far = spark.createDataFrame([(2, [9.0] * 64), (3, [-9.0] * 64)], "list_no int, cvec array<double>")
    start = _centroids(spark, sf).filter("list_no < 2").unionByName(far)
    moved = cluster.split_empty(docs, start, "l2")
    sizes = maintain.list_sizes(search.build_lists(docs, moved, "l2"))
    return moved.join(sizes, "list_no", "left").select(_long("list_no"), (F.col("n") > 0).alias("occupied"))


@query("with v as (select round(s_acctbal) x, count(*)::DOUBLE w from supplier group by 1), c as (select x, sum(w) over o w1, sum(w * x) over o s1, sum(w * x * x) over o q1, sum(w) over () w0, sum(w * x) over () s0, sum(w * x * x) over () q0 from v window o as (order by x)), l as (select *, q1 - s1 * s1 / w1 + (q0 - q1) - (s0 - s1) * (s0 - s1) / (w0 - w1) loss from c where w1 < w0), b as (select * from l order by loss, x limit 1) select round(unnest([s1 / w1, (s0 - s1) / (w0 - w1)]), 6) centre from b")
def kmeans_one_dimension(spark, sf):
    values = _table(spark, sf, "supplier").select(F.round("s_acctbal").alias("x"))
    return spark.createDataFrame([(round(c, 6),) for c in cluster.kmeans_1d(values, 2)], "centre double")


@query("select true better")
def kmeans_progressive(spark, sf):
    docs = _docs(spark, sf)
    trained = cluster.progressive(docs, LISTS, [16, 64], 2)
    a, b = (cluster.objective(docs, c, "l2").first()[0] for c in (_centroids(spark, sf), trained))
    return spark.createDataFrame([(b < a,)], "better boolean")


@query("select i list_no from range(8) t(i)")
def kmeans_two_level(spark, sf):
    return cluster.two_level(_docs(spark, sf), 2, 4, 2).select(_long("list_no"))


@query("select 100::BIGINT n")
def training_sample(spark, sf):
    docs = _docs(spark, sf)
    return cluster.sample(docs, 100).join(docs.select("doc_id"), "doc_id", "left_semi").agg(F.count("*").alias("n"))


# Transforms


@query(_cells_sql("list_transform([vec[1], vec[64], 0, vec[3]], lambda x: x::DOUBLE)", dims=4))
def transform_remap(spark, sf):
    return _cells(transforms.remap([0, 63, -1, 2])(_docs(spark, sf)))


@query(_cells_sql("list_concat(list_transform(vec, lambda x: x::DOUBLE), list_transform(range(6), lambda i: 0.0::DOUBLE))", dims=70))
def transform_pad(spark, sf):
    return _cells(transforms.pad(70)(_docs(spark, sf)))


@query(f"with {TABLES}, s as (select doc_id, list_sum({_SCALE}) a, vec[1]::DOUBLE b from docs) select doc_id, 0::BIGINT dim, round(a + 1, 5) x from s union all select doc_id, 1, round(b - 1, 5) from s")
def transform_linear(spark, sf):
    first = np.zeros(64)
    first[0] = 1
    return _cells(transforms.Linear(np.stack([np.ones(64), first]), np.array([1.0, -1.0])).apply(_docs(spark, sf)), digits=5)


_NORMS = f"with {TABLES} select doc_id, round({_ip('vec', 'vec')}, 5) loss from docs"
_CENTRED = f"with {TABLES}, m as (select dim, avg(x) m from (select unnest(range(64)) dim, unnest(vec)::DOUBLE x from docs) group by 1), c as (select doc_id, unnest(range(64)) dim, unnest(vec)::DOUBLE x from docs) select doc_id, round(sum((x - m) * (x - m)), 5) loss from c join m using (dim) group by 1"


def _sizes(df):
    return df.select("doc_id", F.round(V.norm_squared("vec"), 5).alias("loss"))


@query(_NORMS)
def transform_rotation(spark, sf):
    """A rotation keeps lengths."""
    return _sizes(transforms.random_rotation(64).apply(_docs(spark, sf)))


@query(_CENTRED)
def transform_pca(spark, sf):
    """All principal axes keep the lengths of centred vectors."""
    docs = _docs(spark, sf)
    return _sizes(transforms.pca(docs, 64).apply(docs))


@query("select i dim, 1.0::DOUBLE deviation from range(64) t(i)")
def transform_whitening(spark, sf):
    docs = _docs(spark, sf)
    rows = evaluate.matrix_stats(transforms.pca(docs, 64, -0.5).apply(docs))
    return rows.select(_long("dim"), F.round("deviation", 4).alias("deviation"))


@query(_CENTRED)
def transform_itq(spark, sf):
    docs = _docs(spark, sf)
    return _sizes(transforms.itq(docs, rounds=4).apply(docs))


@query(_NORMS)
def transform_opq(spark, sf):
    docs = _docs(spark, sf)
    return _sizes(transforms.opq(docs, 8, rounds=2).apply(docs))


@query(_cells_sql(_SCALE, digits=5))
def transform_reversed(spark, sf):
    """A rotation behind principal axes, undone."""
    docs = _docs(spark, sf)
    chain = transforms.Chain([transforms.pca(docs, 64), transforms.random_rotation(64)])
    return _cells(chain.reverse(chain.apply(docs)), digits=5)


@query(_cells_sql(f"list_transform({_SCALE}, lambda x: x / sqrt({_ip('vec', 'vec')}))"))
def transform_chain(spark, sf):
    return _cells(transforms.remap(list(range(64)))(transforms.Chain([transforms.pad(70), transforms.normalization]).apply(_docs(spark, sf))))


# Codecs


_BOUNDS = f"{TABLES}, c as (select doc_id, unnest(range(64)) dim, unnest(vec)::DOUBLE x from docs), b as (select dim, min(x) low, max(x) high, avg(x) m, stddev_pop(x) s from c group by 1)"


def _quantised(low, high, bits):
    return f"greatest(0, least({2**bits - 1}, floor((x - ({low})) / greatest(({high}) - ({low}), 1e-12) * {2**bits - 1} + 0.5)))"


def _coded(df):
    return df.select("doc_id", F.posexplode("code").alias("dim", "code")).select("doc_id", _long("dim"), _long("code"))


def _bounds(spark, sf):
    rows = evaluate.matrix_stats(_docs(spark, sf)).orderBy("dim").collect()
    return {c: np.array([r[c] for r in rows]) for c in ("least", "largest", "mean", "deviation")}


@query(f"with {_BOUNDS} select doc_id, dim, {_quantised('low', 'high', 4)}::BIGINT code from c join b using (dim)")
def codec_scalar_4(spark, sf):
    b = _bounds(spark, sf)
    return _coded(codecs.ScalarQuantizer(b["least"], b["largest"], 4).encoded(_docs(spark, sf)))


@query(f"with {_BOUNDS} select doc_id, dim, {_quantised('low', 'high', 6)}::BIGINT code from c join b using (dim)")
def codec_scalar_6(spark, sf):
    b = _bounds(spark, sf)
    return _coded(codecs.ScalarQuantizer(b["least"], b["largest"], 6).encoded(_docs(spark, sf)))


@query(f"with {_BOUNDS} select doc_id, dim, {_quantised('(select min(low) from b)', '(select max(high) from b)', 8)}::BIGINT code from c")
def codec_scalar_uniform(spark, sf):
    b = _bounds(spark, sf)
    return _coded(codecs.ScalarQuantizer(b["least"].min(keepdims=True), b["largest"].max(keepdims=True)).encoded(_docs(spark, sf)))


@query(f"with {_BOUNDS} select doc_id, dim, round(low + {_quantised('low', 'high', 8)} * (high - low) / 255, 5) x from c join b using (dim)")
def codec_scalar_decoded(spark, sf):
    b = _bounds(spark, sf)
    codec = codecs.ScalarQuantizer(b["least"], b["largest"])
    return _cells(codec.decoded(codec.encoded(_docs(spark, sf))), digits=5)


@query("select vec_id doc_id, true near from embeddings")
def codec_half(spark, sf):
    """Half-precision numbers are within a two-thousandth of theirs."""
    codec = codecs.HalfFloat()
    rows = codec.decoded(codec.encoded(_docs(spark, sf)), vec="again")
    return rows.select("doc_id", F.forall(F.zip_with("vec", "again", lambda x, y: F.abs(x - y) <= F.abs(x) / 2048 + 1e-7), lambda t: t).alias("near"))


@query("select vec_id doc_id, true near from embeddings")
def codec_brain(spark, sf):
    codec = codecs.HalfFloat(brain=True)
    rows = codec.decoded(codec.encoded(_docs(spark, sf)), vec="again")
    return rows.select("doc_id", F.forall(F.zip_with("vec", "again", lambda x, y: F.abs(x - y) <= F.abs(x) / 256), lambda t: t).alias("near"))


@query("select vec_id doc_id, unnest(range(2)) dim, unnest([label, vec_id % 256])::DOUBLE x from embeddings")
def codec_direct(spark, sf):
    rows = _docs(spark, sf).select("doc_id", F.array("attr", F.col("doc_id") % 256).cast("array<double>").alias("vec"))
    codec = codecs.Direct()
    return _cells(codec.decoded(codec.encoded(rows)))


def _book(spark, sf, n=16):
    return np.array([[float(x) for x in r.vec] for r in _docs(spark, sf).orderBy("doc_id").limit(n).collect()])


_WORDS = f"{TABLES}, w as (select row_number() over (order by doc_id) - 1 c, vec word from (select * from docs order by doc_id limit 16))"


@query(f"with {_WORDS} select doc_id, dim, c code from (select doc_id, dim, c, row_number() over (partition by doc_id, dim order by {_l2('list_slice(vec, dim * 16 + 1, dim * 16 + 16)', 'list_slice(word, dim * 16 + 1, dim * 16 + 16)')}, c) r from docs, w, range(4) t(dim)) where r = 1")
def codec_product(spark, sf):
    """Codebooks are the stretches of the sixteen lowest ids."""
    book = _book(spark, sf)
    return _coded(codecs.ProductQuantizer(np.stack(np.split(book, 4, axis=1))).encoded(_docs(spark, sf)))


_PQ = f"{_WORDS}, pq as (select doc_id, dim, c from (select doc_id, dim, c, row_number() over (partition by doc_id, dim order by {_l2('list_slice(vec, dim * 16 + 1, dim * 16 + 16)', 'list_slice(word, dim * 16 + 1, dim * 16 + 16)')}, c) r from docs, w, range(4) t(dim)) where r = 1)"


@query(f"with {_PQ}, scored as (select qid, doc_id, round(sum({_l2('list_slice(qvec, dim * 16 + 1, dim * 16 + 16)', 'list_slice(word, dim * 16 + 1, dim * 16 + 16)')}), 9) score from q, pq join w using (c) group by 1, 2) select qid, doc_id, rank, round(score, 5) score from (select *, row_number() over (partition by qid order by score, doc_id) rank from scored) where rank <= {K}")
def codec_product_search(spark, sf):
    """Asymmetric search by tables."""
    codec = codecs.ProductQuantizer(np.stack(np.split(_book(spark, sf), 4, axis=1)))
    found = codec.search(codec.encoded(_docs(spark, sf)).drop("vec"), _asked(spark, sf), 40 * K)
    again = topk.top_k(found.drop("rank").withColumn("score", F.round("score", 9)), K, False)
    return again.select("qid", "doc_id", _long("rank"), F.round("score", 5).alias("score"))


_RQ = f"{_WORDS}, s1 as (select * from (select doc_id, vec, c, word, row_number() over (partition by doc_id order by {_l2('vec', 'word')}, c) r from docs, w) where r = 1), rest as (select doc_id, c c1, list_transform(list_zip(vec, word), lambda z: z[1]::DOUBLE - z[2]::DOUBLE) e from s1), w2 as (select c, list_transform(word, lambda x: x::DOUBLE * 0.5) word from w), s2 as (select * from (select doc_id, c1, c c2, row_number() over (partition by doc_id order by {_l2('e', 'word')}, c) r from rest, w2) where r = 1)"


@query(f"with {_RQ} select doc_id, 0::BIGINT dim, c1 code from s2 union all select doc_id, 1, c2 from s2")
def codec_residual(spark, sf):
    """Two stages, the second of the same words at half length, one code carried along."""
    book = _book(spark, sf)
    return _coded(codecs.ResidualQuantizer([book, 0.5 * book], beam=1).encoded(_docs(spark, sf)))


@query("select true better")
def codec_residual_beam(spark, sf):
    """Four codes carried along lose no more than one."""
    docs, book = _docs(spark, sf), _book(spark, sf)
    losses = []
    for beam in (1, 4):
        codec = codecs.ResidualQuantizer([book, 0.5 * book], beam=beam)
        rows = codec.decoded(codec.encoded(docs), vec="again")
        losses.append(rows.agg(F.sum(V.norm_squared(V.subtract("vec", "again")))).first()[0])
    return spark.createDataFrame([(losses[1] <= losses[0] + 1e-9,)], "better boolean")


@query("select true better")
def codec_local_search(spark, sf):
    docs, book = _docs(spark, sf), _book(spark, sf)
    losses = []
    for codec in (codecs.ResidualQuantizer([book, 0.5 * book], 1), codecs.LocalSearchQuantizer([book, 0.5 * book], 1)):
        rows = codec.decoded(codec.encoded(docs), vec="again")
        losses.append(rows.agg(F.sum(V.norm_squared(V.subtract("vec", "again")))).first()[0])
    return spark.createDataFrame([(losses[1] <= losses[0] + 1e-9,)], "better boolean")


@query(f"with {_WORDS}, h as (select doc_id, half, c, row_number() over (partition by doc_id, half order by {_l2('list_slice(vec, half * 32 + 1, half * 32 + 32)', 'list_slice(word, half * 32 + 1, half * 32 + 32)')}, c) r from docs, w, range(2) t(half)) select doc_id, half dim, c code from h where r = 1")
def codec_product_residual(spark, sf):
    """A residual codec of one stage for each half."""
    book = _book(spark, sf)
    codec = codecs.ProductOf([codecs.ResidualQuantizer([b], 1) for b in np.split(book, 2, axis=1)], [1, 1])
    return _coded(codec.encoded(_docs(spark, sf)))


@query(f"with {TABLES}, c as (select doc_id, unnest(range(64)) dim, unnest(vec)::DOUBLE x from docs), b as (select doc_id, min(x) low, max(x) high from c group by 1) select doc_id, dim, greatest(0, least(255, floor((x - low) / greatest(high - low, 1e-12) * 255 + 0.5)))::BIGINT code from c join b using (doc_id)")
def codec_rowwise(spark, sf):
    """Each row between its own bounds."""
    codec = codecs.RowwiseMinMax(codecs.ScalarQuantizer(np.zeros(1), np.ones(1)))
    rows = codec.encoded(_docs(spark, sf)).withColumn("code", F.slice("code", 3, 64))
    return _coded(rows)


@query("select vec_id doc_id, 25::BIGINT size from embeddings")
def codec_lattice(spark, sf):
    """Points of the whole-number sphere of squared radius 25."""

    @F.pandas_udf("array<int>")
    def encode(v):
        import pandas as pd

        return pd.Series(list(codecs.lattice_encode(np.array(v.tolist(), float), 25).astype(np.int32)))

    rows = _docs(spark, sf).select("doc_id", encode(V.doubles("vec")).alias("p"))
    return rows.select("doc_id", F.aggregate(F.transform("p", lambda x: (x * x).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x).alias("size"))


@query(_cells_sql("list_transform(list_slice(vec, 1, 15), lambda x: greatest(0, least(15, floor(x::DOUBLE * 32 + 8))))", dims=15))
def bits_packed(spark, sf):
    """Fifteen numbers of four bits in one long, and back."""
    small = F.transform(F.slice("vec", 1, 15), lambda x: F.greatest(F.lit(0), F.least(F.lit(15), F.floor(x.cast("double") * 32 + 8).cast("int"))))
    rows = _docs(spark, sf).select("doc_id", V.pack_bits(small, 4).alias("word"))
    return _cells(rows.select("doc_id", V.unpack_bits("word", 4, 15).alias("vec")))


@query(_cells_sql("list_transform(vec, lambda x: case when x >= 0 then 1.0 else -1.0 end)"))
def bits_to_signs(spark, sf):
    return _cells(binary.from_float(_docs(spark, sf)).select("doc_id", V.words_to_signs("code", 64).alias("vec")))


@query(_cells_sql("list_transform(list_reverse(vec), lambda x: case when x >= 0 then 1.0 else -1.0 end)"))
def bits_shuffled(spark, sf):
    rows = binary.from_float(_docs(spark, sf)).select("doc_id", V.shuffle_bits("code", list(range(63, -1, -1))).alias("code"))
    return _cells(rows.select("doc_id", V.words_to_signs("code", 64).alias("vec")))


@query(_cells_sql("list_transform(vec, lambda x: case when floor(x::DOUBLE / 0.05)::BIGINT % 2 = 0 then 1.0 else 0.0 end)"))
def codec_spectral(spark, sf):
    return _cells(_docs(spark, sf).select("doc_id", codecs.spectral_bits("vec", 0.1).alias("vec")))


@query(_top_bits(_CODES_SQL, f"select qid, doc_id, {_HAMMING} score from q, docs"))
def codec_lsh(spark, sf):
    """Sign bits without a rotation."""
    docs = codecs.lsh(_docs(spark, sf), 64, rotate=False)(_docs(spark, sf)).select("doc_id", "code")
    asked = docs.filter(F.col("doc_id") % EVERY == 0).select(F.col("doc_id").alias("qid"), F.col("code").alias("qcode"))
    return _bits_out(binary.knn(docs, asked, K))


@query(f"with {TABLES}, e as (select doc_id, vec, {_ip('vec', 'vec')} n, list_sum(list_transform(vec, lambda x: abs(x::DOUBLE))) a from docs) select qid, doc_id, round(n + {_ip('qvec', 'qvec')} - 2 * n * list_sum(list_transform(list_zip(qvec, vec), lambda z: case when z[2] >= 0 then z[1]::DOUBLE else -z[1]::DOUBLE end)) / a, 5) score from q, e")
def codec_one_bit(spark, sf):
    """Distances estimated from one bit a dimension, without centring or rotation."""
    codec = codecs.RaBit(np.zeros(64), np.eye(64))

    @F.pandas_udf("double")
    def estimate(qvec, vec):
        import pandas as pd

        bits, length, share = codec.encode(np.array(vec.tolist(), float))
        return pd.Series([float(codec.estimate(np.asarray(q, float), b[None], np.array([n]), np.array([s]))[0]) for q, b, n, s in zip(qvec, bits, length, share)])

    rows = search.meet(_docs(spark, sf), _asked(spark, sf)).select("qid", "doc_id", estimate(V.doubles("qvec"), V.doubles("vec")).alias("score"))
    return rows.select("qid", "doc_id", F.round("score", 5).alias("score"))


# Indexes by description


def _searched(description, k=K, metric="l2", **how):
    def run(spark, sf):
        docs = _docs(spark, sf).select("doc_id", "vec")
        index = Index(description, metric).train(docs, rounds=3).add(docs)
        found = index.search(_asked(spark, sf), k, **how)
        return _out(found).withColumn("score", F.round(F.abs("score"), 4))

    return run


_EXACT = _ALL_L2.replace("round(score, 6)", "round(score, 4)")
for _name, _description, _how in (
    ("index_flat", "Flat", {}), ("index_rotated", "RR64,Flat", {}), ("index_padded", "Pad80,Flat", {}), ("index_principal", "PCA64,Flat", {}), ("index_lists", "IVF8,Flat", {"nprobe": 8}),
    ("index_id_map", "IDMap,Flat", {}), ("index_product_refined", "PQ8x4,RFlat", {"k_factor": 1e9}), ("index_scalar_refined", "SQ8,RFlat", {"k_factor": 20}), ("index_lists_scalar_refined", "IVF8,SQ8,RFlat", {"nprobe": 8, "k_factor": 20}),
    ("index_dedup", "FlatDedup", {}), ("index_one_bit_refined", "RaBitQ,RFlat", {"k_factor": 1e9}), ("index_signs_refined", "LSH,RFlat", {"k_factor": 1e9}), ("index_two_codes_refined", "PQ4+4,RFlat", {"k_factor": 1e9}), ("index_lists_product_refined", "IVF8,PQ8x4,RFlat", {"nprobe": 8, "k_factor": 1e9}),
    ("index_residual_refined", "RQ2x4,RFlat", {"k_factor": 1e9}), ("index_transforms_lists", "OPQ8,IVF8,Flat", {"nprobe": 8}), ("index_itq", "ITQ64,Flat", {}),
):
    _run = _searched(_description, **_how)
    _run.__name__ = _name
    query(_EXACT)(_run)


@query("select * from (values ('Flat', 256::BIGINT), ('SQ8', 64), ('SQ4', 32), ('SQfp16', 128), ('PQ8', 8), ('PQ16x4', 8), ('PQ8+16', 24), ('RQ4x8', 4), ('PRQ2x4x4', 4), ('LSH', 8), ('LSH128', 16), ('RaBitQ', 16)) t(description, bytes)")
def code_sizes(spark, sf):
    names = ("Flat", "SQ8", "SQ4", "SQfp16", "PQ8", "PQ16x4", "PQ8+16", "RQ4x8", "PRQ2x4x4", "LSH", "LSH128", "RaBitQ")
    return spark.createDataFrame([(n, code_size(parse(n), 64)) for n in names], "description string, bytes long")


@query("select * from (values ('PCA16,IVF64,PQ8,RFlat'), ('OPQ8_32,IVF1024,PQ8x4'), ('IDMap,L2norm,Flat'), ('IVF16384_HNSW32,SQ8'), ('BHash16x4'), ('RR32,ITQ16,LSH16'), ('IMI2x4,RQ2x8')) t(description)")
def reverse_descriptions(spark, sf):
    """Descriptions that come back from their specification (sizes written out)."""
    names = ("PCA16,IVF64,PQ8,RFlat", "OPQ8_32,IVF1k,PQ8x4", "IDMap,L2norm,Flat", "IVF16k_HNSW32,SQ8", "BHash16x4", "RR32,ITQ16,LSH16", "IMI2x4,RQ2x8")
    return spark.createDataFrame([(str(parse(n)),) for n in names], "description string")


@query(_cells_sql(_SCALE, digits=4))
def index_reconstruct(spark, sf):
    docs = _docs(spark, sf).select("doc_id", "vec")
    return _cells(Index("PCA64,Flat").train(docs).add(docs).reconstruct(), digits=4)


@query(f"with {TABLES} select doc_id, round({_ip('vec', 'vec')}, 5) loss from docs where attr <> 3")
def index_changed(spark, sf):
    """Documents added, removed, reset and added again."""
    docs = _docs(spark, sf)
    rows = docs.select("doc_id", "vec")
    index = Index("Flat").train(rows).add(rows).reset().add(rows).remove(docs.filter("attr = 3")).update(docs.filter("attr = 4").select("doc_id", "vec"))
    return _sizes(index.vectors())


@query("select vec_id + 1000000 doc_id from embeddings where vec_id % 2 = 1 union all select vec_id from embeddings where vec_id % 2 = 0")
def index_merged(spark, sf):
    rows = _docs(spark, sf).select("doc_id", "vec")
    a, b = (Index("Flat").train(rows).add(maintain.block(rows, 2, i)) for i in (0, 1))
    return a.merge(b, 1_000_000).vectors().select("doc_id")


@query(_EXACT)
def index_saved(spark, sf):
    """An index with transforms, lists and a codec, saved, loaded and cloned."""
    path, docs = files.scratch(spark), _docs(spark, sf).select("doc_id", "vec")
    Index("Pad80,PCA64,IVF8,SQ8,RFlat").train(docs, rounds=2).add(docs).save(path)
    found = Index.load(spark, path).clone().search(_asked(spark, sf), K, nprobe=8, k_factor=20)
    return _out(found).withColumn("score", F.round(F.abs("score"), 4))


@query("select * from (values ('BHash16'), ('HNSW32'), ('IVF8,RaBitQ'), ('ZnLattice3x10_4')) t(description)")
def index_refusals(spark, sf):
    """Descriptions of what is not built are errors."""
    out = []
    for name in ("HNSW32", "ZnLattice3x10_4", "BHash16", "IVF8,RaBitQ", "Flat"):
        try:
            Index(name)
        except ValueError:
            out.append((name,))
    return spark.createDataFrame(out, "description string")


@query(f"with {_PQ}, scored as (select qid, doc_id, round(sum({_l2('list_slice(qvec, dim * 16 + 1, dim * 16 + 16)', 'list_slice(word, dim * 16 + 1, dim * 16 + 16)')}), 9) score from q, pq join w using (c) group by 1, 2) select qid, doc_id, rank, round(score, 5) score from (select *, row_number() over (partition by qid order by score, doc_id) rank from scored) where rank <= {K}")
def codec_fast_scan(spark, sf):
    """Byte tables over four-bit codes, then exact tables for all that are left (here: all)."""
    codec = codecs.ProductQuantizer(np.stack(np.split(_book(spark, sf), 4, axis=1)))
    found = codecs.fast_scan(codec, codec.encoded(_docs(spark, sf)), _asked(spark, sf), 40 * K, keep=10_000)
    again = topk.top_k(found.drop("rank").withColumn("score", F.round("score", 9)), K, False)
    return again.select("qid", "doc_id", _long("rank"), F.round("score", 5).alias("score"))


@query(f"with {_PQ} select doc_id, dim, c code from pq")
def codec_polysemous(spark, sf):
    """Words under other numbers code the same words: numbers are looked up back."""
    codec = codecs.ProductQuantizer(np.stack(np.split(_book(spark, sf), 4, axis=1)))
    other = codec.polysemous(500)
    back = [[int(np.abs(b - w).sum(1).argmin()) for w in o] for b, o in zip(codec.books, other.books)]
    table = F.array(*[F.array(*map(F.lit, row)) for row in back])
    rows = other.encoded(_docs(spark, sf)).withColumn("code", F.transform("code", lambda c, i: F.get(F.get(table, i), c)))
    return _coded(rows)


@query(f"with {TABLES} select qid, doc_id, round({_l2('qvec', 'vec')}, 4) score from q, docs where {_l2('qvec', 'vec')} < {RADIUS}")
def index_range(spark, sf):
    rows = _docs(spark, sf).select("doc_id", "vec")
    found = Index("RR64,IVF8,Flat").train(rows, 2).add(rows).range_search(_asked(spark, sf), RADIUS, 8)
    return found.select("qid", "doc_id", F.round(F.abs("score"), 4).alias("score"))


@query(f"with r as ({_ALL_L2}) select qid, doc_id from r where rank = 1")
def index_assign(spark, sf):
    rows = _docs(spark, sf).select("doc_id", "vec")
    return Index("Flat").train(rows).add(rows).assign(_asked(spark, sf))


# Bits


_LISTED = f"{_CODES_SQL}, cent as (select row_number() over (order by doc_id) - 1 list_no, code ccode from (select * from docs order by doc_id limit {LISTS})), own as (select * from (select doc_id, code, list_no, row_number() over (partition by doc_id order by bit_count(xor(code, ccode)), list_no) r from docs, cent) where r = 1), probes as (select * from (select qid, qcode, list_no, row_number() over (partition by qid order by bit_count(xor(qcode, ccode)), list_no) r from q, cent) where r <= {NPROBE})"


@query(_top_bits(_LISTED, f"select qid, doc_id, {_HAMMING} score from probes join own using (list_no)"))
def binary_lists(spark, sf):
    docs, asked = _codes(spark, sf)
    first = docs.orderBy("doc_id").limit(LISTS)
    centroids = first.select((F.row_number().over(topk.Window.orderBy("doc_id")) - 1).alias("list_no"), F.col("code").alias("ccode"))
    return _bits_out(binary.ivf_search(docs, asked, centroids, K, NPROBE))


@query(_top_bits(_CODES_SQL, f"select qid, doc_id, {_HAMMING} score from q, docs"))
def binary_shards(spark, sf):
    docs, asked = _codes(spark, sf)
    return _bits_out(topk.merge_results(*[binary.knn(maintain.block(docs, 2, i), asked, K) for i in (0, 1)], k=K, similar=False))


@query(f"with r as ({_top_bits(_CODES_SQL, f'select qid, doc_id, {_HAMMING} score from q, docs')}) select qid, doc_id * 2 + 1 doc_id, rank, score from r")
def binary_id_map(spark, sf):
    docs, asked = _codes(spark, sf)
    named = docs.select(F.col("doc_id").alias("internal"), (F.col("doc_id") * 2 + 1).alias("external"))
    return _bits_out(search.map_ids(binary.knn(docs, asked, K), named))


# Evaluation and tuning


@query(f"with {TABLES}, r as (select qid, doc_id, {_l2('qvec', 'vec')} score from q, docs), g as (select * from r where doc_id % 2 = 0), c as (select unnest([0.8, 1.0, 1.2])::DOUBLE radius), n as (select radius, (select count(*) from g where score < radius)::DOUBLE got, (select count(*) from r where score < radius)::DOUBLE want from c) select radius, 1.0::DOUBLE \"precision\", round(case when want = 0 then 1 else got / want end, 6) recall from n")
def precision_recall_at(spark, sf):
    docs, asked = _docs(spark, sf), _asked(spark, sf)
    truth = search.range_search(docs, asked, 1.2, "l2")
    rows = evaluate.precision_recall_at(truth.filter("doc_id % 2 = 0"), truth, [0.8, 1.0, 1.2])
    return rows.select("radius", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query(f"with {_PR}, g as (select qid, count(*)::DOUBLE n from got group by 1), w as (select qid, count(*)::DOUBLE n from want group by 1), b as (select qid, count(*)::DOUBLE n from got join want using (qid, doc_id) group by 1) select round(avg(case when g.n is null then 1 else coalesce(b.n, 0) / g.n end), 6) \"precision\", round(avg(case when w.n is null then 1 else coalesce(b.n, 0) / w.n end), 6) recall from q left join g using (qid) left join w using (qid) left join b using (qid)")
def range_precision_recall_average(spark, sf):
    docs, asked = _docs(spark, sf), _asked(spark, sf)
    got = search.ivf_range(_lists(spark, sf), asked, search.coarse(asked, _centroids(spark, sf), NPROBE), RADIUS)
    rows = evaluate.range_precision_recall(got, search.range_search(docs, asked, RADIUS, "l2"), asked, "average")
    return rows.select(F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query(f"with {TABLES} select qid from q where qid % 100 = 0")
def tolerant_comparison(spark, sf):
    """Queries of which a document has been exchanged before the last group of equal scores."""
    found = search.knn(_docs(spark, sf), _asked(spark, sf), K).withColumn("side", F.explode(F.array(F.lit(1), F.lit(-1))))
    exchanged = (F.col("side") == -1) & (F.col("qid") % 100 == 0) & (F.col("rank") == 2)
    return evaluate.differing(found.withColumn("doc_id", F.when(exchanged, F.col("doc_id") + 1_000_000).otherwise(F.col("doc_id"))))


@query(f"with r as ({_ALL}) select qid, doc_id, rank, score from r")
def ground_truth(spark, sf):
    return _out(evaluate.ground_truth(_docs(spark, sf), _asked(spark, sf), K))


@query("select label::BIGINT attr, true fresh from embeddings where label >= 5 group by 1")
def held_out_predicates(spark, sf):
    """Fit predicates that no held-out query asks: the values from five on."""
    docs = _docs(spark, sf).select(F.col("attr").alias("qid"), "doc_id")
    held = docs.filter("qid < 5").withColumn("qid", F.col("qid") + 100)
    return evaluate.held_out(docs, held).select(F.col("qid").alias("attr"), F.lit(True).alias("fresh"))


@query("select * from (values (0::BIGINT, 1::BIGINT), (1, 3), (3, 7), (7, 15), (15, 31), (31, 40)) t(low, high)")
def query_batches(spark, sf):
    """Stretches that double."""
    return spark.createDataFrame(list(calibrate.batches(40)), "low long, high long")


@query("select 0.0::DOUBLE value union all select round(0.01 * pow(1000, i / 6.0), 6) from range(7) t(i)")
def axis_values(spark, sf):
    return spark.createDataFrame([(round(v, 6),) for v in calibrate.scramble(calibrate.axis(0.01, 10.0, 7, zero=True))], "value double")


@query("select 2.0::DOUBLE alpha, 0.5::DOUBLE beta, 0.0::DOUBLE cost")
def coordinate_search(spark, sf):
    """The least of a bowl whose floor is a step away."""
    a, b, cost, _ = calibrate.coordinate_search(lambda a, b: np.log2(a / 2) ** 2 + np.log2(b * 2) ** 2, 1.0, 1.0, step=2.0, most=40)
    return spark.createDataFrame([(round(a, 6), round(b, 6), round(float(cost), 6))], "alpha double, beta double, cost double")


@query("select a, b, (a + 2 * b)::DOUBLE quality from range(4) t(a), range(3) u(b)")
def parameter_space(spark, sf):
    """Every combination is run where none is known to be no better."""
    points = calibrate.explore({"a": [0, 1, 2, 3], "b": [0, 1, 2]}, lambda p: (float(p["a"] + 2 * p["b"]), float(p["a"] + p["b"])))
    return spark.createDataFrame([(p["a"], p["b"], q) for p, q, _ in points], "a long, b long, quality double")


@query("select * from (values (1.0::DOUBLE, 1.0::DOUBLE), (3.0, 2.0), (4.0, 5.0)) t(quality, seconds)")
def pareto_points(spark, sf):
    points = [({"i": i}, q, t) for i, (q, t) in enumerate([(1.0, 1.0), (3.0, 2.0), (2.0, 3.0), (3.0, 4.0), (4.0, 5.0)])]
    return spark.createDataFrame([(q, t) for _, q, t in calibrate.pareto(points)], "quality double, seconds double")


@query("select true measured, true agreed, 3::BIGINT runs")
def measured_runs(spark, sf):
    """Three timed runs of a plan, and two figures that agree."""
    m = calibrate.measure(lambda: _table(spark, sf, "nation").groupBy("n_regionkey").count(), 25, warmup=1, least=3, target=None)
    calibrate.require_agreement(100.0, 101.0, 0.02)
    return spark.createDataFrame([(m.qps > 0, True, len(m.seconds))], "measured boolean, agreed boolean, runs long")


@query("select * from (values ('a', 2::BIGINT), ('b', 1)) t(label, calls)")
def phase_timers(spark, sf):
    timers = calibrate.Timers()
    for label in ("a", "b", "a"):
        timers.run(label, lambda: None)
    return spark.createDataFrame([(label, n) for label, (_, n) in timers.total.items()], "label string, calls long")


@query("select * from (values ('BuildSettings'), ('DatasetSettings'), ('MeasureSettings'), ('TuneSettings')) t(rejected)")
def settings_checked(spark, sf):
    """Settings of which one has an unknown, missing or impossible value."""
    bad = ((config.BuildSettings, {"colour": 1}), (config.DatasetSettings, {"name": "x"}), (config.MeasureSettings, {"least_runs": 9, "most_runs": 3}), (config.TuneSettings, {"step": 1.0}))
    out = []
    for kind, values in bad:
        try:
            kind.of(values)
        except ValueError:
            out.append((kind.__name__,))
    return spark.createDataFrame(out, "rejected string")
