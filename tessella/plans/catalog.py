"""Registered queries over the test tables and their SQL oracles.

Vectors: ``embeddings``, whole. Queries are the rows whose id is divisible by 50, against all rows; a query's equality
predicate is ``label = id modulo 10``. Lists have the vectors of the eight lowest ids as centroids. Scores are rounded to
six decimals; ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import vectors as V
from tessella.operators import binary, cluster, codecs, evaluate, maintain, predicates, routing, search, topk, transforms
from tessella.sources import files

K, NPROBE, LISTS, BETA, EVERY, LABELS = 10, 3, 8, 0.1, 50, 10
RADIUS, RADIUS_IP = 1.2, 0.2

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


# Tables


def _table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _docs(spark, sf):
    return _table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec"), F.col("label").cast("long").alias("attr"))


def _asked(spark, sf):
    rows = _table(spark, sf, "embeddings").filter(F.col("vec_id") % EVERY == 0)
    return rows.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"), (F.col("vec_id") % LABELS).alias("eq"))


_BUILT: dict[tuple[str, str, str], dict[str, DataFrame]] = {}


def _saved(spark, sf, name, build):
    """Tables that ``build`` makes of the input: built and saved once in an application, then read."""
    at = (spark.sparkContext.applicationId, sf, name)
    if at not in _BUILT:
        path = files.scratch(spark)
        files.save_tables(build(), path)
        _BUILT[at] = files.load_tables(spark, path)[0]
    return _BUILT[at]


def _index(spark, sf):
    def build():
        docs = _docs(spark, sf)
        centroids = cluster.first_centroids(docs, LISTS)
        return {"centroids": centroids, "lists": search.build_lists(docs, centroids)}

    return _saved(spark, sf, "index", build)


def _centroids(spark, sf):
    return _index(spark, sf)["centroids"]


def _lists(spark, sf):
    return _index(spark, sf)["lists"]


def _positive(df, column):
    return df.withColumn(column, F.transform(column, lambda x: F.abs(x.cast("double"))))


def _out(df, *extra):
    return df.select("qid", "doc_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"), *extra)


def _ranged(df):
    return df.select("qid", "doc_id", F.round("score", 6).alias("score"))


def _zip(a, b, body):
    return f"list_transform(list_zip({a}, {b}), lambda z: {body})"


def _ip(a, b):
    return f"list_sum({_zip(a, b, 'z[1]::DOUBLE * z[2]::DOUBLE')})"


def _l2(a, b):
    return f"list_sum({_zip(a, b, '(z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE)')})"


TABLES = f"""docs as (select vec_id doc_id, embedding vec, label::BIGINT attr from embeddings),
q as (select vec_id qid, embedding qvec, vec_id % {LABELS} eq from embeddings where vec_id % {EVERY} = 0)"""
IVF = f"""{TABLES},
cent as (select row_number() over (order by vec_id) - 1 list_no, embedding cvec from (select * from embeddings order by vec_id limit {LISTS})),
lists as (select doc_id, vec, attr, list_no from (select d.*, c.list_no, row_number() over (partition by doc_id order by {_ip("d.vec", "c.cvec")} desc, c.list_no) rn from docs d, cent c) where rn = 1)"""
PROBES = f"""{IVF},
probes as (select qid, list_no, coarse, rank from (select qid, c.list_no, {_ip("qvec", "c.cvec")} coarse, row_number() over (partition by qid order by {_ip("qvec", "c.cvec")} desc, c.list_no) rank from q, cent c) where rank <= {NPROBE})"""


def _top(tables, rows, k=K, better="desc"):
    return f"with {tables}, scored as ({rows}) select qid, doc_id, rank, round(score, 6) score from (select qid, doc_id, score, row_number() over (partition by qid order by score {better}, doc_id) rank from scored) where rank <= {k}"


# Distances


def _metric_sql(expression, better):
    tables = f"docs as (select vec_id doc_id, list_transform(embedding, lambda x: abs(x::DOUBLE)) vec from embeddings), q as (select vec_id qid, list_transform(embedding, lambda x: abs(x::DOUBLE)) qvec from embeddings where vec_id % {EVERY} = 0)"
    return _top(tables, f"select qid, doc_id, {expression} score from q, docs", better=better)


def _sum(body):
    return f"list_sum({_zip('qvec', 'vec', body)})"


_METRIC_SQL = {
    "inner_product": _sum("z[1] * z[2]"), "l2": _sum("(z[1] - z[2]) * (z[1] - z[2])"), "l1": _sum("abs(z[1] - z[2])"), "linf": f"list_max({_zip('qvec', 'vec', 'abs(z[1] - z[2])')})", "lp": _sum("pow(abs(z[1] - z[2]), 3)"),
    "canberra": _sum("abs(z[1] - z[2]) / (abs(z[1]) + abs(z[2]))"), "bray_curtis": f"{_sum('abs(z[1] - z[2])')} / {_sum('abs(z[1] + z[2])')}",
    "jensen_shannon": "0.5 * " + _sum("(case when z[1] > 0 then -z[1] * ln((z[1] + z[2]) / 2 / z[1]) else 0 end) + (case when z[2] > 0 then -z[2] * ln((z[1] + z[2]) / 2 / z[2]) else 0 end)"),
    "jaccard": f"{_sum('least(z[1], z[2])')} / {_sum('greatest(z[1], z[2])')}", "nan_euclidean": _sum("(z[1] - z[2]) * (z[1] - z[2])"), "gower": f"{_sum('abs(z[1] - z[2])')} / 64",
}


def _metric_query(metric):
    def run(spark, sf):
        docs, asked = _positive(_docs(spark, sf), "vec"), _positive(_asked(spark, sf), "qvec")
        return _out(search.knn(docs, asked, K, metric, arg=3.0 if metric == "lp" else None))

    run.__name__ = f"knn_{metric}"
    return run


for _name, _expression in _METRIC_SQL.items():
    query(_metric_sql(_expression, "desc" if V.is_similarity(_name) else "asc"))(_metric_query(_name))


@query("select vec_id doc_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) norm from embeddings")
def norms(spark, sf):
    return _docs(spark, sf).select("doc_id", F.round(V.norm("vec"), 6).alias("norm"))


@query("select vec_id doc_id, unnest(range(64)) dim, round(unnest(list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))))), 6) x from embeddings")
def normalize(spark, sf):
    return transforms.normalization(_docs(spark, sf)).select("doc_id", F.posexplode("vec").alias("dim", "x")).select("doc_id", F.col("dim").cast("long").alias("dim"), F.round("x", 6).alias("x"))


# Exact and clustered search


@query(_top(TABLES, f"select qid, doc_id, {_ip('qvec', 'vec')} score from q join docs on attr = eq"))
def filtered_knn(spark, sf):
    return _out(search.knn(_docs(spark, sf), _asked(spark, sf), K, on=F.col("attr") == F.col("eq")))


@query(_top(TABLES, f"select qid, doc_id, {_ip('qvec', 'vec')} score from q, docs"))
def scan_arrow(spark, sf):
    return _out(search.scan(_docs(spark, sf), _asked(spark, sf), K))


@query(f"with {TABLES} select qid, doc_id, round({_l2('qvec', 'vec')}, 6) score from q, docs where {_l2('qvec', 'vec')} < {RADIUS}")
def range_search_l2(spark, sf):
    return _ranged(search.range_search(_docs(spark, sf), _asked(spark, sf), RADIUS, "l2"))


@query(f"with {TABLES} select qid, doc_id, round({_ip('qvec', 'vec')}, 6) score from q join docs on attr = eq where {_ip('qvec', 'vec')} > {RADIUS_IP}")
def filtered_range_search(spark, sf):
    return _ranged(search.range_search(_docs(spark, sf), _asked(spark, sf), RADIUS_IP, "inner_product", F.col("attr") == F.col("eq")))


@query(f"with {IVF} select doc_id, list_no::BIGINT list_no from lists")
def assign(spark, sf):
    return _lists(spark, sf).select("doc_id", F.col("list_no").cast("long").alias("list_no"))


@query(_top(PROBES, f"select qid, doc_id, {_ip('qvec', 'vec')} score from probes join q using (qid) join lists using (list_no)"))
def ivf_search(spark, sf):
    return _out(search.ivf_search(_lists(spark, sf), _asked(spark, sf), _centroids(spark, sf), K, NPROBE))


@query(_top(PROBES, f"select qid, doc_id, {_ip('qvec', 'vec')} score from probes join q using (qid) join lists using (list_no) where attr = eq"))
def filtered_ivf_plain(spark, sf):
    return _out(search.ivf_search(_lists(spark, sf), _asked(spark, sf), _centroids(spark, sf), K, NPROBE, on=F.col("attr") == F.col("eq")))


@query(f"with {PROBES} select qid, doc_id, round({_l2('qvec', 'vec')}, 6) score from probes join q using (qid) join lists using (list_no) where {_l2('qvec', 'vec')} < {RADIUS}")
def ivf_range_search(spark, sf):
    return _ranged(search.ivf_range(_lists(spark, sf), _asked(spark, sf), search.coarse(_asked(spark, sf), _centroids(spark, sf), NPROBE), RADIUS))


_CODES = f"""{PROBES}, sizes as (select list_no, count(*) n from lists group by 1),
kept as (select * from (select p.*, coalesce(sum(coalesce(n, 0)) over (partition by qid order by rank rows between unbounded preceding and 1 preceding), 0) before from probes p left join sizes using (list_no)) where before < 100)"""


@query(_top(_CODES, f"select qid, doc_id, {_ip('qvec', 'vec')} score from kept join q using (qid) join lists using (list_no)"))
def ivf_search_max_codes(spark, sf):
    return _out(search.ivf_search(_lists(spark, sf), _asked(spark, sf), _centroids(spark, sf), K, NPROBE, max_codes=100))


@query(f"with {PROBES}, scored as (select qid, doc_id, list_no, {_ip('qvec', 'vec')} score from probes join q using (qid) join lists using (list_no)) select qid, doc_id, rank, round(score, 6) score, list_no::BIGINT list_no from (select *, row_number() over (partition by qid order by score desc, doc_id) rank from scored) where rank <= {K}")
def search_and_return_lists(spark, sf):
    lists, asked = _lists(spark, sf), _asked(spark, sf)
    found = search.preassigned(lists, asked, search.coarse(asked, _centroids(spark, sf), NPROBE), K)
    return _out(found, F.col("list_no").cast("long").alias("list_no"))


_HALF = f"{TABLES}, near as (select qid, doc_id from (select qid, doc_id, row_number() over (partition by qid order by {_ip('list_slice(qvec, 1, 32)', 'list_slice(vec, 1, 32)')} desc, doc_id) r from q, docs) where r <= {4 * K})"


@query(_top(_HALF, f"select qid, doc_id, {_ip('qvec', 'vec')} score from near join q using (qid) join docs using (doc_id)"))
def refine(spark, sf):
    docs, asked = _docs(spark, sf), _asked(spark, sf)
    rough = search.knn(docs.withColumn("vec", F.slice("vec", 1, 32)), asked.withColumn("qvec", F.slice("qvec", 1, 32)), 4 * K)
    return _out(search.refine(rough, docs, asked, K))


@query(_top(TABLES, f"select qid, doc_id, {_l2('list_slice(qvec, 1, 32)', 'list_slice(vec, 1, 32)')} + {_l2('list_slice(qvec, 33, 64)', 'list_slice(vec, 33, 64)')} score from q, docs", better="asc"))
def split_vectors(spark, sf):
    return _out(search.split_search(_docs(spark, sf), _asked(spark, sf), K, [32, 32]))


@query(f"with {TABLES}, scored as (select qid src, doc_id dst, {_ip('qvec', 'vec')} dist from q join docs on qid <> doc_id) select src, dst, round(dist, 6) dist, rank from (select *, row_number() over (partition by src order by dist desc, dst) rank from scored) where rank <= {K}")
def knn_graph(spark, sf):
    found = search.knn_graph(_docs(spark, sf), K, of=F.col("doc_id") % EVERY == 0)
    return found.select("src", "dst", F.round("dist", 6).alias("dist"), F.col("rank").cast("long").alias("rank"))


@query(_top(TABLES, f"select qid, doc_id, {_ip('qvec', 'vec')} score from q, docs"))
def dedup_search(spark, sf):
    return _out(search.dedup_search(_docs(spark, sf), _asked(spark, sf), K))


@query(_top("o as (select o_orderkey doc_id, o_totalprice x from orders), q as (select s_suppkey qid, s_acctbal * 10 y from supplier where s_suppkey % 50 = 0)", "select qid, doc_id, abs(x - y) score from q, o", better="asc"))
def nearest_1d(spark, sf):
    values = _table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_totalprice").alias("x"))
    asked = _table(spark, sf, "supplier").filter(F.col("s_suppkey") % EVERY == 0).select(F.col("s_suppkey").alias("qid"), (F.col("s_acctbal") * 10).alias("y"))
    return _out(search.nearest_1d(values, asked, K))


# Routing


_ROUTED = f"""{IVF},
sel as (select qid, list_no, avg(case when attr = eq then 1::DOUBLE else 0::DOUBLE end) p from q, lists group by 1, 2),
routed as (select qid, c.list_no, qvec, eq, p, row_number() over (partition by qid order by {_ip("qvec", "c.cvec")} + case when coalesce(p, 0) <= 0 then '-inf'::DOUBLE else {BETA} * ln(p) end desc, c.list_no) rank from q cross join cent c left join sel using (qid, list_no))"""


@query(_top(_ROUTED, f"select qid, doc_id, {_ip('qvec', 'vec')} score from routed r join lists l on l.list_no = r.list_no and attr = eq where rank <= {NPROBE} and p > 0"))
def filtered_ivf_search(spark, sf):
    lists, asked = _lists(spark, sf), _asked(spark, sf)
    shares = routing.attribute_selectivity(lists, asked)
    return _out(routing.routed_search(lists, asked, _centroids(spark, sf), K, NPROBE, BETA, F.col("attr") == F.col("eq"), shares))


@query(f"with {IVF} select qid, list_no::BIGINT list_no, round(avg(case when attr = eq then 1::DOUBLE else 0::DOUBLE end), 6) p from q, lists group by 1, 2")
def cluster_selectivity(spark, sf):
    asked, lists = _asked(spark, sf), _lists(spark, sf)
    legal = predicates.equality(_docs(spark, sf), asked)
    return routing.selectivity(legal, lists, asked).select("qid", F.col("list_no").cast("long").alias("list_no"), F.round("p", 6).alias("p"))


@query(f"with {_ROUTED} select qid, list_no::BIGINT list_no, rank, round(p, 6) p from routed where rank <= {NPROBE} and p > 0")
def routed_probes(spark, sf):
    lists, asked = _lists(spark, sf), _asked(spark, sf)
    rows = routing.probes(routing.centroid_scores(asked, _centroids(spark, sf)), routing.attribute_selectivity(lists, asked), NPROBE, BETA)
    return rows.select("qid", F.col("list_no").cast("long").alias("list_no"), F.col("rank").cast("long").alias("rank"), F.round("p", 6).alias("p"))


_TRUTH = f"truth as (select qid, doc_id, rank from (select qid, doc_id, row_number() over (partition by qid order by {_ip('qvec', 'vec')} desc, doc_id) rank from q join docs on attr = eq) where rank <= {K})"


@query(f"""with {_ROUTED}, {_TRUTH}, sizes as (select list_no, count(*) n from lists group by 1), held as (select qid, list_no, count(*)::DOUBLE / {K} share from truth join lists using (doc_id) group by 1, 2),
steps as (select qid, rank depth, sum(case when coalesce(p, 0) > 0 then coalesce(n, 0) else 0 end) over w scanned, sum(coalesce(share, 0)) over w recall from routed left join sizes using (list_no) left join held using (qid, list_no) window w as (partition by qid order by rank))
select depth, round(avg(scanned), 4) scanned, round(avg(recall), 6) recall from steps group by 1""")
def cost_curve(spark, sf):
    lists, asked, docs = _lists(spark, sf), _asked(spark, sf), _docs(spark, sf)
    truth = evaluate.ground_truth(docs, asked, K, on=F.col("attr") == F.col("eq"))
    scores, shares = routing.centroid_scores(asked, _centroids(spark, sf)), routing.attribute_selectivity(lists, asked)
    rows = scores.join(shares, ["qid", "list_no"], "left").withColumn("score", F.col("coarse") + routing.log_selectivity(F.col("p"), BETA))
    ranked = topk.top_k(rows, LISTS, True, ident="list_no").select("qid", "list_no", "rank", "p")
    curve = routing.cost_curve(ranked, maintain.list_sizes(lists), routing.contribution(truth, lists, K))
    return curve.select(F.col("depth").cast("long").alias("depth"), F.round("scanned", 4).alias("scanned"), F.round("recall", 6).alias("recall"))


@query(f"with {IVF}, {_TRUTH} select qid, list_no::BIGINT list_no, count(*)::DOUBLE / {K} share from truth join lists using (doc_id) group by 1, 2")
def truth_contribution(spark, sf):
    truth = evaluate.ground_truth(_docs(spark, sf), _asked(spark, sf), K, on=F.col("attr") == F.col("eq"))
    return routing.contribution(truth, _lists(spark, sf), K).select("qid", F.col("list_no").cast("long").alias("list_no"), "share")


# Predicates


@query(f"with {TABLES} select qid, doc_id from q join docs on attr = eq")
def predicate_equality(spark, sf):
    return predicates.equality(_docs(spark, sf), _asked(spark, sf))


_RANGES = "o as (select o_orderkey doc_id, o_totalprice attr from orders), q as (select s_suppkey qid, s_acctbal * 10 lo, s_acctbal * 10 + 2000 hi from supplier where s_suppkey % 50 = 0)"


def _range_side(spark, sf):
    docs = _table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_totalprice").alias("attr"))
    low = F.col("s_acctbal") * 10
    return docs, _table(spark, sf, "supplier").filter(F.col("s_suppkey") % EVERY == 0).select(F.col("s_suppkey").alias("qid"), low.alias("lo"), (low + 2000).alias("hi"))


@query(f"with {_RANGES} select qid, doc_id from q join o on attr >= lo and attr < hi")
def predicate_range(spark, sf):
    return predicates.ranges(*_range_side(spark, sf))


_TERMS = "post as (select distinct l_orderkey doc_id, l_partkey term from lineitem), q as (select o_orderkey qid from orders where o_orderkey % 50 = 0), want as (select qid, term from (select qid, term, row_number() over (partition by qid order by term) r from q join post on doc_id = qid) where r <= 2)"


def _postings(spark, sf):
    rows = _table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_partkey").alias("term"))
    return _saved(spark, sf, "postings", lambda: {"postings": rows.distinct()})["postings"]


def _conjunctions(spark, sf):
    own = _postings(spark, sf).filter(F.col("doc_id") % EVERY == 0).groupBy(F.col("doc_id").alias("qid")).agg(F.array_sort(F.collect_set("term")).alias("terms"))
    return own.join(_table(spark, sf, "orders").select(F.col("o_orderkey").alias("qid")), "qid", "left_semi").withColumn("terms", F.slice("terms", 1, 2))


_DIVISION = "select qid, doc_id from want join post using (term) group by 1, 2 having count(*) = (select count(*) from want w where w.qid = want.qid)"


@query(f"with {_TERMS} {_DIVISION}")
def predicate_conjunction(spark, sf):
    return predicates.conjunction(_postings(spark, sf), _conjunctions(spark, sf))


@query(f"""with {TABLES}, {_TERMS.replace("q as", "oq as").replace("from q join post", "from oq join post")}, rp as (select o_orderkey doc_id, o_totalprice attr from orders)
select 0::BIGINT * 3 + qid * 3 qid, doc_id from q join docs on attr = eq
union all select qid * 3 + 1, doc_id from (select vec_id qid, vec_id * 0.001 lo, vec_id * 0.001 + 5 hi from embeddings where vec_id % {EVERY} = 0) r join docs on attr >= lo and attr < hi
union all select qid * 3 + 2, doc_id from ({_DIVISION})""")
def predicate_workload(spark, sf):
    asked = _asked(spark, sf)
    none = F.lit(None)
    eq = asked.select((F.col("qid") * 3).alias("qid"), F.lit("equality").alias("op"), "eq", none.cast("double").alias("lo"), none.cast("double").alias("hi"), none.cast("array<long>").alias("terms"))
    low = F.col("qid") * 0.001
    rng = asked.select((F.col("qid") * 3 + 1).alias("qid"), F.lit("range").alias("op"), none.cast("long").alias("eq"), low.alias("lo"), (low + 5).alias("hi"), none.cast("array<long>").alias("terms"))
    con = _conjunctions(spark, sf).select((F.col("qid") * 3 + 2).alias("qid"), F.lit("conjunction").alias("op"), none.cast("long").alias("eq"), none.cast("double").alias("lo"), none.cast("double").alias("hi"), "terms")
    return predicates.evaluate(_docs(spark, sf), _postings(spark, sf), eq.unionByName(rng).unionByName(con))


@query("with post as (select distinct l_orderkey doc_id, l_partkey term from lineitem), d as (select count(*) n from orders) select term, count(*) n, count(*) >= greatest(1, ceil(ceil((select n from d) / 8.0) / 4.0)) dense from post group by 1")
def posting_stats(spark, sf):
    return predicates.posting_stats(_postings(spark, sf), _table(spark, sf, "orders").count())


@query(f"with {TABLES} select qid, count(*) n from q join docs on attr = eq group by 1")
def bitmap_sizes(spark, sf):
    return predicates.bitmap_sizes(predicates.to_bitmaps(predicates.equality(_docs(spark, sf), _asked(spark, sf))))


@query(f"with {TABLES} select qid, doc_id from q join docs on attr = eq where doc_id % 2 = 0")
def bitmap_intersection(spark, sf):
    docs, asked = _docs(spark, sf), _asked(spark, sf)
    even = search.meet(docs.filter(F.col("doc_id") % 2 == 0), asked).select("qid", "doc_id")
    both = predicates.intersect_bitmaps(predicates.to_bitmaps(predicates.equality(docs, asked)), predicates.to_bitmaps(even))
    return predicates.from_bitmaps(both)


@query("select vec_id doc_id from embeddings where ((vec_id >= 30 and vec_id < 300) and not (vec_id in (31, 33, 35))) <> (vec_id < 100)")
def selectors(spark, sf):
    chosen = (predicates.id_range(30, 300) & ~predicates.id_list([31, 33, 35])) ^ predicates.id_range(0, 100)
    return _docs(spark, sf).filter(chosen.on()).select("doc_id")


# Evaluation


_FOUND = f"found as (select qid, doc_id, rank from (select qid, doc_id, row_number() over (partition by qid order by {_ip('qvec', 'vec')} desc, doc_id) rank from probes join q using (qid) join lists using (list_no) where attr = eq) where rank <= {K})"


def _pair(spark, sf):
    docs, asked = _docs(spark, sf), _asked(spark, sf)
    on = F.col("attr") == F.col("eq")
    return search.ivf_search(_lists(spark, sf), asked, _centroids(spark, sf), K, NPROBE, on=on), evaluate.ground_truth(docs, asked, K, on=on)


@query(f"with {PROBES}, {_TRUTH}, {_FOUND} select round(avg(r), 6) recall from (select qid, count(f.doc_id)::DOUBLE / {K} r from truth t left join found f using (qid, doc_id) group by 1)")
def recall_at_k(spark, sf):
    found, truth = _pair(spark, sf)
    return evaluate.recall(found, truth, K).select(F.round("recall", 6).alias("recall"))


@query(f"with {PROBES}, {_TRUTH}, {_FOUND} select round(count(f.doc_id)::DOUBLE / count(*), 6) recall from truth t left join found f using (qid, doc_id) where t.rank = 1")
def one_recall(spark, sf):
    found, truth = _pair(spark, sf)
    return evaluate.one_recall(found, truth, K).select(F.round("recall", 6).alias("recall"))


@query(f"with {PROBES}, {_TRUTH}, {_FOUND} select round(count(f.doc_id)::DOUBLE / (count(distinct qid) * {K}), 6) shared from truth t left join found f using (qid, doc_id)")
def result_intersection(spark, sf):
    found, truth = _pair(spark, sf)
    return evaluate.intersection(truth, found, K).select(F.round("shared", 6).alias("shared"))


_PR = f"{PROBES}, want as (select qid, doc_id from q, docs where {_l2('qvec', 'vec')} < {RADIUS}), got as (select qid, doc_id from probes join q using (qid) join lists using (list_no) where {_l2('qvec', 'vec')} < {RADIUS})"


@query(f"with {_PR}, n as (select (select count(*) from got) g, (select count(*) from want) w, (select count(*) from got join want using (qid, doc_id)) b) select round(case when g = 0 then 1 else b::DOUBLE / g end, 6) \"precision\", round(case when w = 0 then 1 else b::DOUBLE / w end, 6) recall from n")
def range_precision_recall(spark, sf):
    docs, asked = _docs(spark, sf), _asked(spark, sf)
    got = search.ivf_range(_lists(spark, sf), asked, search.coarse(asked, _centroids(spark, sf), NPROBE), RADIUS)
    rows = evaluate.range_precision_recall(got, search.range_search(docs, asked, RADIUS, "l2"), asked)
    return rows.select(F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query("with s as (select list_no, count(*)::DOUBLE h from lists group by 1), lists as (select label list_no from embeddings) select round(10 * sum(h * h) / pow(sum(h), 2), 6) imbalance from s".replace("with s as (select list_no, count(*)::DOUBLE h from lists group by 1), lists as (select label list_no from embeddings)", "with s as (select label, count(*)::DOUBLE h from embeddings group by 1)"))
def imbalance_factor(spark, sf):
    lists = _docs(spark, sf).select("doc_id", F.col("attr").alias("list_no"))
    return evaluate.imbalance(lists, LABELS).select(F.round("imbalance", 6).alias("imbalance"))


@query("select dim, count(*) n, count(*) filter (isnan(x)) nan, count(*) filter (isinf(x)) inf, count(*) filter (x = 0) zero, round(min(x), 6) least, round(max(x), 6) largest, round(avg(x), 6) mean, round(stddev_pop(x), 6) deviation from (select unnest(range(64)) dim, unnest(embedding)::DOUBLE x from embeddings) group by 1")
def matrix_stats(spark, sf):
    rows = evaluate.matrix_stats(_docs(spark, sf))
    return rows.select(F.col("dim").cast("long").alias("dim"), "n", "nan", "inf", "zero", *[F.round(c, 6).alias(c) for c in ("least", "largest", "mean", "deviation")])


@query("select count(*) distinct_vectors, sum(n - 1)::BIGINT duplicates from (select embedding, count(*) n from embeddings group by 1)")
def duplicate_vectors(spark, sf):
    return evaluate.duplicate_vectors(_docs(spark, sf))


@query("select event_type stage, round(quantile_cont(value, 0.5) * 1000, 4) median_ms, round(quantile_cont(value, 0.95) * 1000, 4) p95_ms from events group by 1")
def timing_summary(spark, sf):
    rows = evaluate.timing_summary(_table(spark, sf, "events"), "event_type", "value")
    return rows.select(F.col("event_type").alias("stage"), F.round("median_ms", 4).alias("median_ms"), F.round("p95_ms", 4).alias("p95_ms"))


@query("select case when value < 0 then 0 when value >= 100 then 11 else floor(value / 10) + 1 end::BIGINT bin, count(*) n from events group by 1")
def histogram(spark, sf):
    return evaluate.histogram(_table(spark, sf, "events"), "value", 0.0, 100.0, 10)


@query("with p as (select p_brand \"key\", avg(p_size) perf, round(avg(p_retailprice), 4) t from part group by 1), b as (select *, max(perf) over (order by t, perf desc, \"key\" rows between unbounded preceding and 1 preceding) best from p) select \"key\", round(perf, 6) perf, t from b where best is null or perf > best")
def operating_points(spark, sf):
    points = _table(spark, sf, "part").groupBy(F.col("p_brand").alias("key")).agg(F.avg("p_size").alias("perf"), F.round(F.avg("p_retailprice"), 4).alias("t"))
    return evaluate.operating_points(points).select("key", F.round("perf", 6).alias("perf"), "t")


@query(f"with {TABLES}, r as (select qid, doc_id, {_l2('qvec', 'vec')} score from q, docs), c as (select max(score) cut from (select score from r order by score limit 101)) select qid, doc_id, round(score, 6) score from r where score < (select cut from c)")
def budgeted_range(spark, sf):
    return _ranged(topk.tighten(search.range_search(_docs(spark, sf), _asked(spark, sf), float("inf"), "l2", most=101), 100, False))


# Lists and their maintenance


@query(f"with {IVF}, s as (select list_no, count(*) n from lists group by 1) select list_no::BIGINT list_no, n, coalesce(sum(n) over (order by list_no rows between unbounded preceding and 1 preceding), 0)::BIGINT start from s")
def list_offsets(spark, sf):
    rows = topk.offsets(maintain.list_sizes(_lists(spark, sf)), "list_no")
    return rows.select(F.col("list_no").cast("long").alias("list_no"), "n", "start")


@query(f"with {IVF} select doc_id, list_no::BIGINT list_no, row_number() over (order by list_no, doc_id) - 1 \"position\" from lists")
def cluster_major(spark, sf):
    return maintain.cluster_major(_lists(spark, sf)).select("doc_id", F.col("list_no").cast("long").alias("list_no"), F.col("position").cast("long").alias("position"))


@query(f"with {IVF}, s as (select list_no, count(*) n from lists group by 1), r as (select list_no, row_number() over (order by n desc, list_no) - 1 new_no from s) select doc_id, new_no::BIGINT list_no from lists join r using (list_no)")
def lists_by_size(spark, sf):
    return maintain.by_size(_lists(spark, sf)).select("doc_id", F.col("list_no").cast("long").alias("list_no"))


@query(f"with {IVF} select doc_id, list_no::BIGINT list_no from lists where list_no in (select list_no from lists group by 1 having count(*) < (select count(*) / {LISTS} from lists))")
def stop_lists(spark, sf):
    lists = _lists(spark, sf)
    return maintain.stop_lists(lists, -(-lists.count() // LISTS)).select("doc_id", F.col("list_no").cast("long").alias("list_no"))


@query(f"with {IVF} select doc_id, list_no::BIGINT list_no from lists where doc_id % 3 = 0 union all select doc_id, list_no::BIGINT from lists where list_no not in (select list_no from lists where doc_id % 3 = 0)")
def masked_lists(spark, sf):
    lists = _lists(spark, sf).select("doc_id", "list_no")
    return maintain.masked_lists(maintain.subset_by_modulo(lists, 3, 0), lists).select("doc_id", F.col("list_no").cast("long").alias("list_no"))


@query(f"with {IVF}, moved as (select doc_id, list_no from (select d.doc_id, c.list_no, row_number() over (partition by doc_id order by {_ip('list_reverse(d.vec)', 'c.cvec')} desc, c.list_no) rn from docs d, cent c where d.attr = 3) where rn = 1) select doc_id, list_no::BIGINT list_no from lists where attr <> 3 and attr <> 7 union all select doc_id, list_no::BIGINT from moved")
def remove_and_update(spark, sf):
    lists, docs = _lists(spark, sf), _docs(spark, sf)
    kept = maintain.remove(lists, docs.filter("attr = 7"))
    moved = docs.filter("attr = 3").withColumn("vec", F.reverse("vec"))
    return maintain.update(kept, moved, _centroids(spark, sf)).select("doc_id", F.col("list_no").cast("long").alias("list_no"))


@query(f"with {IVF} select doc_id, list_no::BIGINT list_no from lists union all select doc_id + 1000000, list_no::BIGINT from lists where doc_id % 2 = 1")
def merge_shards(spark, sf):
    lists = _lists(spark, sf).select("doc_id", F.col("list_no").cast("long").alias("list_no"))
    return maintain.merge(lists, maintain.subset_by_modulo(lists, 2, 1), 1_000_000)


@query(f"with {IVF}, n as (select doc_id, list_no, row_number() over (partition by list_no order by doc_id) - 1 i, count(*) over (partition by list_no) n from lists) select doc_id, list_no::BIGINT list_no from n where i >= floor(n * 0.25) and i < floor(n * 0.75)")
def subset_by_fraction(spark, sf):
    return maintain.subset_by_fraction(_lists(spark, sf), 0.25, 0.75).select("doc_id", F.col("list_no").cast("long").alias("list_no"))


@query("select doc_id, text, doc_id = min(doc_id) over (partition by text) inserted from documents")
def first_seen(spark, sf):
    return maintain.first_seen(_table(spark, sf, "documents").select("doc_id", "text"), "text").select("doc_id", "text", "inserted")


def _set_query(how, sql):
    def run(spark, sf):
        labels = _table(spark, sf, "labels")
        return maintain.set_operation(labels.filter("quality = 1"), labels.filter("toxic = 1"), how)

    run.__name__ = f"set_{how}"
    query(sql)(run)


_A, _B = "select distinct doc_id from labels where quality = 1", "select distinct doc_id from labels where toxic = 1"
_set_query("intersect", f"({_A}) intersect ({_B})")
_set_query("union", f"({_A}) union ({_B})")
_set_query("except", f"({_A}) except ({_B})")
_set_query("symmetric", f"(({_A}) except ({_B})) union all (({_B}) except ({_A}))")


@query("select l_shipdate::DATE \"day\", count(*) n from (select *, dense_rank() over (order by l_shipdate::DATE desc) r from lineitem) where r <= 30 group by 1")
def sliding_window(spark, sf):
    rows = _table(spark, sf, "lineitem").select("l_orderkey", F.datediff(F.to_date("l_shipdate"), F.lit("1970-01-01")).alias("slice"))
    days = topk.offsets(rows.groupBy("slice").agg(F.count("*").alias("n")), "slice").select("slice", F.row_number().over(topk.Window.orderBy("slice")).alias("slice_id"))
    newest = days.agg(F.max("slice_id")).first()[0]
    kept = maintain.window(days, newest, 30)
    return rows.join(kept, "slice").groupBy(F.date_add(F.lit("1970-01-01").cast("date"), F.col("slice")).alias("day")).agg(F.count("*").alias("n"))


# Clustering, transforms, codecs


@query(f"with {IVF}, m as (select list_no, dim, avg(x) x from (select list_no, unnest(range(64)) dim, unnest(vec)::DOUBLE x from lists) group by 1, 2) select list_no::BIGINT list_no, dim, round(x, 6) x from m")
def kmeans_step(spark, sf):
    rows = cluster.lloyd_step(_docs(spark, sf), _centroids(spark, sf), "inner_product")
    occupied = _lists(spark, sf).select("list_no").distinct()
    return rows.join(occupied, "list_no").select("list_no", F.posexplode("cvec").alias("dim", "x")).select(F.col("list_no").cast("long").alias("list_no"), F.col("dim").cast("long").alias("dim"), F.round("x", 6).alias("x"))


@query(f"with {IVF} select doc_id, round(list_sum({_zip('vec', 'cvec', '(z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE)')}), 6) loss from lists join cent using (list_no)")
def residual_norms(spark, sf):
    rows = cluster.residuals(_lists(spark, sf), _centroids(spark, sf))
    return rows.select("doc_id", F.round(V.norm_squared("vec"), 6).alias("loss"))


@query("with m as (select dim, avg(x) mean from (select unnest(range(64)) dim, unnest(embedding)::DOUBLE x from embeddings) group by 1), c as (select vec_id doc_id, unnest(range(64)) dim, unnest(embedding)::DOUBLE x from embeddings) select doc_id, dim, round(x - mean, 5) x from c join m using (dim)")
def centering(spark, sf):
    docs = _docs(spark, sf)
    rows = transforms.centering(docs).apply(docs).select("doc_id", F.posexplode("vec").alias("dim", "x"))
    return rows.select("doc_id", F.col("dim").cast("long").alias("dim"), F.round("x", 5).alias("x"))


@query("with b as (select dim, min(x) low, max(x) high from (select unnest(range(64)) dim, unnest(embedding)::DOUBLE x from embeddings) group by 1), c as (select vec_id doc_id, unnest(range(64)) dim, unnest(embedding)::DOUBLE x from embeddings) select doc_id, dim, greatest(0, least(255, floor((x - low) / greatest(high - low, 1e-12) * 255 + 0.5)))::BIGINT code from c join b using (dim)")
def scalar_quantizer(spark, sf):
    import numpy as np

    docs = _docs(spark, sf)
    bounds = evaluate.matrix_stats(docs).orderBy("dim").collect()
    codec = codecs.ScalarQuantizer(np.array([b.least for b in bounds]), np.array([b.largest for b in bounds]))
    return docs.select("doc_id", F.posexplode(codec.expression()).alias("dim", "code")).select("doc_id", F.col("dim").cast("long").alias("dim"), F.col("code").cast("long").alias("code"))


# Bits

_BITS = "list_reduce(list_prepend(0::HUGEINT, list_transform(range(1, 65), lambda i: case when {v}[i] >= 0 then (1::HUGEINT << (i - 1)) else 0::HUGEINT end)), lambda x, y: x + y)"
_CODES_SQL = f"docs as (select vec_id doc_id, {_BITS.format(v='embedding')} code from embeddings), q as (select vec_id qid, {_BITS.format(v='embedding')} qcode from embeddings where vec_id % {EVERY} = 0)"
_HAMMING = "bit_count(xor(code, qcode))::BIGINT"


def _codes(spark, sf):
    docs = binary.from_float(_docs(spark, sf)).select("doc_id", "code")
    return docs, docs.filter(F.col("doc_id") % EVERY == 0).select(F.col("doc_id").alias("qid"), F.col("code").alias("qcode"))


def _bits_out(df, ranked=True):
    return df.select("qid", "doc_id", *([F.col("rank").cast("long").alias("rank")] if ranked else []), F.col("score").cast("long").alias("score"))


def _top_bits(tables, rows, k=K):
    return f"with {tables}, scored as ({rows}) select qid, doc_id, rank, score from (select qid, doc_id, score, row_number() over (partition by qid order by score, doc_id) rank from scored) where rank <= {k}"


@query(_top_bits(_CODES_SQL, f"select qid, doc_id, {_HAMMING} score from q, docs"))
def binary_knn(spark, sf):
    return _bits_out(binary.knn(*_codes(spark, sf), K))


@query(f"with {_CODES_SQL} select qid, doc_id, {_HAMMING} score from q, docs where {_HAMMING} < 20")
def binary_range(spark, sf):
    return _bits_out(binary.range_search(*_codes(spark, sf), 20), ranked=False)


@query(_top_bits(_CODES_SQL, f"select qid, doc_id, {_HAMMING} score from q join docs on bit_count(xor(code & 255, qcode & 255)) <= 1"))
def binary_hash(spark, sf):
    return _bits_out(binary.hash_search(*_codes(spark, sf), K, 8, 1))


@query(_top_bits(_CODES_SQL, f"select qid, doc_id, {_HAMMING} score from q join docs on bit_count(xor(code & 255, qcode & 255)) <= 1 or bit_count(xor((code >> 8) & 255, (qcode >> 8) & 255)) <= 1"))
def binary_multi_hash(spark, sf):
    return _bits_out(binary.multi_hash_search(*_codes(spark, sf), K, 2, 8, 1))


@query(f"with {_CODES_SQL} select qid, count(*) filter ({_HAMMING} <= 24) n from q, docs group by 1")
def binary_count(spark, sf):
    return binary.count_within(*_codes(spark, sf), 24)


from tessella.plans import catalog_operators  # noqa: E402, F401  registers the rest
