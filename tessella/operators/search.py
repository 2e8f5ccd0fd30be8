"""Exact, clustered and re-ranked search. Results are rows (qid, doc_id, score[, rank]); a missing result is a missing row."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import blocks
from tessella.functions import vectors as V
from tessella.operators.predicates import Selector2D
from tessella.operators.topk import combine_knn_and_range, ranking, top_k

#: Queries that are broadcast together; more are dealt in blocks, each of which meets all documents.
BLOCK = 4096
#: Centroids that are broadcast as one array.
MOST_LISTS = 65_536
#: Results a query that :func:`knn` takes from matrices; for more, every pair is a row.
MOST_K = 1024
#: Neighbour descent: candidates kept beside a document's k, documents of a list on average, lists that a document is in,
#: documents of a piece of a list or a block of centers, links from others that meet at a center, and those asked exactly.
POOL, LIST, IN_LISTS, PIECE, REVERSE, SAMPLE = 50, 1024, 3, 4096, 60, 512


def meet(docs: DataFrame, queries: DataFrame, on: Column | None = None, block: int = BLOCK) -> DataFrame:
    """Documents beside each query of the stated set.

    At most ``block`` queries (counted first) are broadcast. Beyond that, queries are dealt into blocks and every
    document goes once to each block, by an equi-join on the block, so no task holds all queries.
    """
    n = queries.count()
    if n <= block:
        side = F.broadcast(queries)
        return docs.crossJoin(side) if on is None else docs.join(side, on)
    parts = -(-n // block)
    dealt = queries.withColumn("__part", F.pmod(F.xxhash64("qid"), F.lit(parts)).cast("int"))
    copies = docs.withColumn("__copy", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    condition = F.col("__part") == F.col("__copy")
    return copies.join(dealt, condition if on is None else condition & on).drop("__part", "__copy")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).astype(np.float64).reshape(len(column), -1)


def _spread(docs: DataFrame) -> DataFrame:
    """Documents of fewer files than there are cores, dealt to all of them: a small file is one task, whose pairs are many."""
    slots = docs.sparkSession.sparkContext.defaultParallelism
    return docs if len(docs.inputFiles()) >= slots else docs.repartition(slots, "doc_id")


def _visited(docs: DataFrame, queries: DataFrame, visit: Callable, schema: str, n: int, block: int = BLOCK) -> DataFrame:
    """What ``visit`` (query ids, their matrix, document ids, theirs) yields for all pairs of ``n`` queries and the documents.

    At most ``block`` queries go to the workers as one table. Beyond that, queries are dealt into blocks of about as many, and
    each document goes once to each block (see :func:`meet`).
    """
    if n <= block:
        asked = queries.select("qid", "qvec").toPandas()
        qids = asked.qid.to_numpy(np.int64)
        q = np.array(asked.qvec.tolist(), np.float64).reshape(len(asked), -1)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows and len(q):
                    yield from visit(qids, q, batch.column("doc_id").to_numpy(), _matrix(batch.column("vec")))

        return _spread(docs.select("doc_id", "vec")).mapInArrow(run, schema)

    parts = -(-n // block)
    slots = max(1, docs.sparkSession.sparkContext.defaultParallelism)
    # a row of queries by block and of documents by block and slot; both kinds of a (block, slot) meet in one group
    dealt = queries.select(F.pmod(F.xxhash64("qid"), F.lit(parts)).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"), F.lit(0).alias("kind"), F.col("qid").cast("long").alias("id"), F.col("qvec").alias("vec"))
    copies = docs.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.pmod(F.xxhash64("doc_id"), F.lit(slots)).cast("int").alias("slot"), F.lit(1).alias("kind"), F.col("doc_id").cast("long").alias("id"), "vec")

    def meeting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, ids, vecs = None, [], []
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("part", "slot", "kind")], 1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1 if len(keys) else []
            for a, b in zip([0, *cuts], [*cuts, len(keys)]):
                if a == b:
                    continue
                if group != tuple(keys[a, :2]):
                    group, ids, vecs = tuple(keys[a, :2]), [], []
                piece, x = batch.column("id").slice(a, b - a).to_numpy(), _matrix(batch.column("vec").slice(a, b - a))
                if keys[a, 2] == 0:
                    ids.append(piece)
                    vecs.append(x)
                elif ids:
                    ids, vecs = [np.concatenate(ids)], [np.concatenate(vecs)]
                    yield from visit(ids[0], vecs[0], piece, x)

    both = dealt.unionByName(copies).repartition("part", "slot").sortWithinPartitions("part", "slot", "kind")
    return both.mapInArrow(meeting, schema)


def _compared(docs: DataFrame, queries: DataFrame, visit: Callable, exact: dict[str, Column], metric: str, among: Selector2D | None = None, every: bool = False) -> DataFrame:
    """(qid, doc_id, *exact) of all pairs: by ``visit`` where both vectors are whole (of one dimension, without nulls; for
    Jensen-Shannon not negative), by the expressions ``exact`` for the others, so that each metric's rules for those hold.

    Documents are read once, the others' pairs are handed on with both vectors. Where there are more queries than a block's, or
    with ``every`` (all pairs are handed on, so that empty columns would count), the others are found by a second reading.
    """
    n = queries.count()
    kinds = dict(queries.dtypes) | dict(docs.dtypes)

    def plain(rows: DataFrame) -> DataFrame:
        return (rows if among is None else rows.filter(among.on())).select("qid", "doc_id", *(c.alias(name) for name, c in exact.items()))

    if metric not in blocks.BLOCKS or any(kinds[c] not in ("bigint", "int") for c in ("qid", "doc_id")):
        return plain(meet(docs, queries))
    left = docs.select(F.col("doc_id").cast("long"), F.col("vec").cast("array<double>").alias("vec"))
    right = queries.select(F.col("qid").cast("long"), F.col("qvec").cast("array<double>").alias("qvec"))
    schema = ", ".join(["qid long", "doc_id long", *(f"{c} double" for c in exact)])
    if n <= BLOCK and not every:
        asked = right.toArrow().combine_chunks()
        lengths = asked.column("qvec").combine_chunks().value_lengths().fill_null(0).to_numpy()
        if not (lengths > 0).any():
            return plain(meet(docs, queries))
        run = _meeting(asked, int(lengths[lengths > 0][0]), visit, [*exact], metric, None if among is None else among.member)
        found = _spread(left).mapInArrow(run, f"{schema}, odd boolean, qvec array<double>, vec array<double>")
        scored = [F.when(F.col("odd"), c).otherwise(F.col(name)).alias(name) for name, c in exact.items()]
        return found.select(F.col("qid").cast(kinds["qid"]), F.col("doc_id").cast(kinds["doc_id"]), *scored)

    first = queries.filter(F.size("qvec") > 0).select(F.size("qvec").alias("d")).first()
    if first is None:
        return plain(meet(docs, queries))

    def fits(vec: str) -> Column:
        bad = (lambda x: x.isNull() | (x < 0)) if metric == "jensen_shannon" else (lambda x: x.isNull())
        return F.coalesce((F.size(vec) == first.d) & ~F.exists(vec, bad), F.lit(False))

    found = _visited(left.filter(fits("vec")), right.filter(fits("qvec")), visit, schema, n)
    found = found.select(F.col("qid").cast(kinds["qid"]), F.col("doc_id").cast(kinds["doc_id"]), *exact)
    odd = [plain(meet(docs.filter(~fits("vec")), queries))]
    if not (strange := queries.filter(~fits("qvec"))).isEmpty():
        odd.append(plain(meet(docs.filter(fits("vec")), strange)))
    for rows in odd:
        found = found.unionByName(rows)
    return found


def _fits(vec: pa.Array, d: int, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are whole vectors of ``d`` dimensions, and these as a matrix."""
    fits = vec.value_lengths().fill_null(-1).to_numpy() == d
    flat = (vec if fits.all() else vec.filter(pa.array(fits))).flatten()
    x = np.asarray(flat).astype(np.float64, copy=False).reshape(-1, d)
    bad = flat.is_null().to_numpy(zero_copy_only=False).reshape(x.shape).any(1) if flat.null_count else np.zeros(len(x), bool)
    if metric == "jensen_shannon":
        bad |= (x < 0).any(1)
    if bad.any():
        fits[np.flatnonzero(fits)[bad]] = False
        x = x[~bad]
    return fits, x


def _meeting(asked: pa.Table, d: int, visit: Callable, columns: list[str], metric: str, member: Callable[[int, int], bool] | None) -> Callable:
    """What ``visit`` yields for batches of documents and the table ``asked``; pairs of which one is no whole vector of ``d``
    dimensions follow with both vectors, without a score."""
    every, qvecs = asked.column("qid").combine_chunks(), asked.column("qvec").combine_chunks()
    whole, q = _fits(qvecs, d, metric)
    qids, strange = every.to_numpy()[whole], np.flatnonzero(~whole)

    def pairs(left: pa.Array, right: pa.Array, a: pa.Array, b: pa.Array) -> pa.RecordBatch:
        none = [pa.nulls(len(left), pa.float64()) for _ in columns]
        out = pa.RecordBatch.from_arrays([left, right, *none, pa.array(np.ones(len(left), bool)), a, b], names=["qid", "doc_id", *columns, "odd", "qvec", "vec"])
        return out if member is None else out.filter(pa.array([member(i, j) for i, j in zip(left.to_pylist(), right.to_pylist())], pa.bool_()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = pa.list_(pa.float64())
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, vecs = batch.column("doc_id"), batch.column("vec")
            fits, x = _fits(vecs, d, metric)
            if len(x) and len(q):
                for part in visit(qids, q, ids.to_numpy()[fits], x):
                    n = part.num_rows
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.nulls(n, pa.bool_()), pa.nulls(n, empty), pa.nulls(n, empty)], names=[*part.schema.names, "odd", "qvec", "vec"])
            for j in np.flatnonzero(~fits):
                own = pa.array(np.full(len(every), j))
                yield pairs(every, ids.take(own), qvecs, vecs.take(own))
            if len(strange) and len(x):
                there = pa.array(np.flatnonzero(fits))
                for i in strange:
                    own = pa.array(np.full(len(there), i))
                    yield pairs(every.take(own), ids.take(there), qvecs.take(own), vecs.take(there))

    return run


def _batch(qids: np.ndarray, ids: np.ndarray, **columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(qids), pa.array(ids), *map(pa.array, columns.values())], names=["qid", "doc_id", *columns])


def _pairs(metric: str, arg: float | None = None) -> Callable:
    """Visits of blocks that hand on the scores of all pairs."""

    def visit(qids, q, ids, x):
        for a, b, score in blocks.scores(metric, q, x, arg):
            i, j = np.nonzero(np.ones(score.shape, bool))
            yield _batch(qids[a + i], ids[b + j], score=score[i, j])

    return visit


def _within(metric: str, radius: float, most: int | None = None) -> Callable:
    """Visits of blocks that hand on the pairs inside the radius, or of these as few as hold the ``most`` best of a block. NaN is
    above all numbers, as in Spark."""
    similar = V.is_similarity(metric)

    def visit(qids, q, ids, x):
        cut, best = np.inf, np.array([])  # of losses: the ``most``-th of the block so far

        def pick(score, slack, rows, columns):
            slack = slack[:, None]
            inside = ~(score <= radius - slack) if similar else score < radius + slack
            if most is None:
                return inside
            loss = np.where(np.isnan(score), -np.inf, -score) if similar else score
            inside &= loss <= cut + slack
            if (own := loss[inside]).size > most:
                inside &= loss <= np.partition(own, most - 1)[most - 1] + 2 * slack.max()
            return inside

        kept = []
        for i, j, score in blocks.candidates(metric, q, x, pick):
            inside = ~(score <= radius) if similar else score < radius
            i, j, score = i[inside], j[inside], score[inside]
            if most is None:
                if len(i):
                    yield _batch(qids[i], ids[j], score=score)
                continue
            kept.append((i, j, score))
            best = np.concatenate([best, np.where(np.isnan(score), -np.inf, -score) if similar else score])
            if len(best) >= most:
                best = np.partition(best, most - 1)[:most]
                cut = best[-1]
        if kept:
            i, j, score = map(np.concatenate, zip(*kept))
            near = np.argsort(np.where(np.isnan(score), -np.inf, -score) if similar else score, kind="stable")[:most]
            yield _batch(qids[i[near]], ids[j[near]], score=score[near])

    return visit


def pairwise(docs: DataFrame, queries: DataFrame, metric: str = "l2", arg: float | None = None) -> DataFrame:
    return _compared(docs, queries, _pairs(metric, arg), {"score": V.distance(metric, "qvec", "vec", arg)}, metric, every=True)


def knn(docs: DataFrame, queries: DataFrame, k: int, metric: str = "inner_product", on: Column | None = None, arg: float | None = None, among: Selector2D | None = None) -> DataFrame:
    """Exact ``k`` nearest documents of each query; ``on`` (a condition on both sides) filters before any distance.

    Without ``on``, blocks of documents and queries are compared as matrices and each block's best go on. ``among`` (see
    :func:`predicates.pairs_callback`) is a Python test of pairs, asked there in order of nearness until ``k`` have passed.
    """
    similar = V.is_similarity(metric)
    score = V.distance(metric, "qvec", "vec", arg)
    if on is not None or k > MOST_K or among is not None and among.member is None:
        rows = meet(docs, queries, on)
        rows = (rows if among is None else rows.filter(among.on())).select("qid", "doc_id", score.alias("score"))
    else:
        rows = _compared(docs, queries, _nearest(k, metric, arg, None if among is None else among.member), {"score": score}, metric, among)
    return top_k(rows.filter(~F.isnan("score")), k, similar)


def _nearest(k: int, metric: str, arg: float | None = None, member: Callable[[int, int], bool] | None = None, others: bool = False) -> Callable:
    """Visits of blocks that hand on each query's ``k`` best documents of the block, ties to the smaller id; with ``others`` not
    the query's own id."""
    similar = V.is_similarity(metric)

    def tested(score: np.ndarray, qids: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows, columns = [], []
        for i, (qid, order) in enumerate(zip(qids.tolist(), np.argsort(-score if similar else score, axis=1, kind="stable").tolist())):
            passed = (j for j in order if member(qid, ids[j]))
            taken = list(itertools.islice(passed, k))
            rows += [i] * len(taken)
            columns += taken
        i, j = np.array(rows, int), np.array(columns, int)
        there = ~np.isnan(score[i, j])
        return i[there], j[there]

    def pick(qids: np.ndarray, ids: np.ndarray) -> Callable:
        best = blocks.among_best(k, similar)

        def run(score, slack, rows, columns):
            if others:
                score[qids[rows, None] == ids[None, columns]] = np.nan
            return best(score, slack)

        return run

    def visit(qids, q, ids, x):
        if member is not None:
            order = np.argsort(ids, kind="stable")
            ids, x = ids[order], x[order]
            found = []
            for a, b, score in blocks.scores(metric, q, x, arg):
                i, j = tested(score, qids[a : a + len(score)], ids[b : b + score.shape[1]].tolist())
                found.append((a + i, b + j, score[i, j]))
        else:
            found = list(blocks.candidates(metric, q, x, pick(qids, ids), arg)) or [(np.array([], int), np.array([], int), np.array([]))]
        i, j, own = map(np.concatenate, zip(*found))
        order = np.lexsort((ids[j], -own if similar else own, i))
        i, j, own = i[order], j[order], own[order]
        starts = np.flatnonzero(np.r_[True, i[1:] != i[:-1]]) if len(i) else np.array([], int)
        rank = np.arange(len(i)) - np.repeat(starts, np.diff(np.r_[starts, len(i)]))
        i, j, own = i[rank < k], j[rank < k], own[rank < k]
        yield _batch(qids[i], ids[j], score=own)

    return visit


def filtered_knn(docs: DataFrame, queries: DataFrame, legal: DataFrame, k: int, metric: str = "inner_product") -> DataFrame:
    """Exact search among the documents that ``legal`` (qid, doc_id) allows each query."""
    rows = legal.join(docs, "doc_id").join(queries, "qid").select("qid", "doc_id", V.distance(metric, "qvec", "vec").alias("score"))
    return top_k(rows, k, V.is_similarity(metric))


def _inside(metric: str, radius: float) -> Column:
    return F.col("score") > radius if V.is_similarity(metric) else F.col("score") < radius


def range_search(docs: DataFrame, queries: DataFrame, radius: float, metric: str = "l2", on: Column | None = None, most: int | None = None) -> DataFrame:
    """All documents strictly inside the radius; without ``on``, blocks are compared as in :func:`knn`.

    ``most`` is for a budget over all queries (:func:`topk.tighten`): blocks hand on no more than their ``most`` best, which hold
    the ``most`` best of all.
    """
    if on is None:
        return _compared(docs, queries, _within(metric, radius, most), {"score": V.distance(metric, "qvec", "vec")}, metric).filter(_inside(metric, radius))
    return meet(docs, queries, on).select("qid", "doc_id", V.distance(metric, "qvec", "vec").alias("score")).filter(_inside(metric, radius))


def knn_and_range(docs: DataFrame, queries: DataFrame, k: int, radius: float, metric: str = "l2") -> DataFrame:
    """:func:`topk.combine_knn_and_range` of both searches (qid, doc_id, score), for which pairs are compared once: blocks hand on
    what is inside the radius or among their ``k`` best, and a query's k-th neighbour tells which of its rows count."""
    similar = V.is_similarity(metric)
    if k < 1 or k > MOST_K:
        return combine_knn_and_range(knn(docs, queries, k, metric), range_search(docs, queries, radius, metric), k, radius, similar)
    best = blocks.among_best(k, similar)

    def pick(score, slack, rows, columns):
        far = slack[:, None]
        return best(score, slack) | (~(score <= radius - far) if similar else score < radius + far)

    def visit(qids, q, ids, x):
        for i, j, score in blocks.candidates(metric, q, x, pick):
            yield _batch(qids[i], ids[j], score=score)

    rows = _compared(docs, queries, visit, {"score": V.distance(metric, "qvec", "vec")}, metric)
    number, own = ~F.isnan("score"), Window.partitionBy("qid")
    rows = rows.withColumn("rank", F.row_number().over(own.orderBy(F.desc(number), *ranking(similar))))
    near = (F.col("rank") <= k) & number
    rows = rows.withColumn("full", F.count(F.when(near & _inside(metric, radius), 1)).over(own) >= k)
    return rows.filter(_inside(metric, radius) & (F.col("full") | near)).select("qid", "doc_id", "score")


def products(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """Inner products of all pairs beside both squared norms, which are taken once a vector: (qid, doc_id, qnorm, norm, ip)."""

    def visit(qids, q, ids, x):
        qn, xn = (blocks.norms(v) for v in (q, x))
        for a, b, ip in blocks.scores("inner_product", q, x):
            i, j = np.nonzero(np.ones(ip.shape, bool))
            yield _batch(qids[a + i], ids[b + j], qnorm=qn[a + i], norm=xn[b + j], ip=ip[i, j])

    exact = {"qnorm": V.norm_squared("qvec"), "norm": V.norm_squared("vec"), "ip": V.inner_product("qvec", "vec")}
    return _compared(docs, queries, visit, exact, "inner_product", every=True)


def scan(docs: DataFrame, queries: DataFrame, k: int, metric: str = "inner_product", block: int = BLOCK) -> DataFrame:
    """As :func:`knn` for inner product or L2, for many pairs: blocks of documents times blocks of queries in one matrix
    product, each block's best ``k`` handed on. Sums differ from element order in the last digits.

    At most ``block`` queries (counted first) go to the workers as one table. Beyond that, queries are dealt into blocks of
    about as many, and each document goes once to each block (see :func:`meet`).
    """
    similar = V.is_similarity(metric)

    def best(qids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray) -> Iterator[pa.RecordBatch]:
        score = q @ x.T
        if metric == "l2":
            score = (q * q).sum(1)[:, None] + (x * x).sum(1)[None] - 2 * score
        for qid, own in zip(qids, score):
            order = np.lexsort((ids, -own if similar else own))[:k]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(order), qid)), pa.array(ids[order]), pa.array(own[order])], names=["qid", "doc_id", "score"])

    return top_k(_visited(docs, queries, best, "qid long, doc_id long, score double", queries.count(), block), k, similar)


def _with_best_lists(rows: DataFrame, centroids: DataFrame, metric: str, n: int, vec: str) -> DataFrame:
    """``rows`` with ``__best``: their ``n`` best lists as (score, list_no). The centroids go along as a constant, so nothing is
    exchanged. From 256 centroids inner products and L2 are matrix products of Arrow batches; fewer, and other metrics,
    are compared inside each row."""
    if metric in ("inner_product", "l2") and (known := centroids.select("list_no", V.doubles("cvec").alias("cvec")).toArrow()).num_rows >= 256:
        return _with_best_products(rows, known, metric, n, vec)
    table = centroids.agg(F.collect_list(F.struct("list_no", "cvec")).alias("__lists"))
    sign = 1 if V.is_similarity(metric) else -1
    scored = F.transform("__lists", lambda c: F.struct((V.distance(metric, vec, c["cvec"]) * sign).alias("s"), (-c["list_no"]).alias("l")))
    best = F.array(F.array_max(scored)) if n == 1 else F.slice(F.sort_array(scored, asc=False), 1, n)
    named = F.transform(best, lambda b: F.struct((b["s"] * sign).alias("score"), (-b["l"]).alias("list_no")))
    return rows.crossJoin(F.broadcast(table)).withColumn("__best", named).drop("__lists")


def _with_best_products(rows: DataFrame, known: pa.Table, metric: str, n: int, vec: str) -> DataFrame:
    numbers = known.column("list_no").to_numpy().astype(np.int32)
    order = np.argsort(numbers)
    numbers, centres = numbers[order], np.array(known.column("cvec").to_pylist(), np.float64)[order]
    half = (centres * centres).sum(1)

    @F.pandas_udf("array<struct<score:double,list_no:int>>")
    def best(v):
        import pandas as pd

        out = []
        for a in range(0, len(v), 1024):
            x = np.array(v[a : a + 1024].tolist(), np.float64).reshape(len(v[a : a + 1024]), -1)
            score = x @ centres.T
            if metric == "l2":
                score = 2 * score - half - (x * x).sum(1)[:, None]
            top = np.argsort(-score, axis=1, kind="stable")[:, :n]
            sign = -1 if metric == "l2" else 1
            out += [[{"score": sign * s[i], "list_no": numbers[i]} for i in t] for s, t in zip(score, top)]
        return pd.Series(out)

    return rows.withColumn("__best", best(V.doubles(vec)))


def assign(docs: DataFrame, centroids: DataFrame, metric: str = "inner_product", n: int = 1) -> DataFrame:
    """``doc_id`` and the ``list_no`` of its ``n`` best centroids (ties: the smaller list), with their rank from 1.

    Up to MOST_LISTS centroids (counted first) are broadcast; more are dealt in blocks.
    """
    if centroids.count() <= MOST_LISTS:
        rows = _with_best_lists(docs.select("doc_id", "vec"), centroids, metric, n, "vec").select("doc_id", F.posexplode("__best").alias("at", "b"))
        return rows.select("doc_id", "b.list_no", (F.col("at") + 1).alias("rank"), "b.score")
    asked = centroids.select(F.col("list_no").alias("qid"), F.col("cvec").alias("qvec"))
    rows = meet(docs, asked).select("doc_id", F.col("qid").alias("list_no"), V.distance(metric, "vec", "qvec").alias("score"))
    order = Window.partitionBy("doc_id").orderBy(F.desc("score") if V.is_similarity(metric) else F.asc("score"), "list_no")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n).select("doc_id", "list_no", "rank", "score")


def build_lists(docs: DataFrame, centroids: DataFrame, metric: str = "inner_product") -> DataFrame:
    """Documents with the list they belong to: the inverted lists. They are not moved."""
    if centroids.count() <= MOST_LISTS:
        rows = _with_best_lists(docs, centroids, metric, 1, "vec")
        return rows.withColumn("list_no", F.get("__best", F.lit(0))["list_no"]).drop("__best")
    return docs.join(assign(docs, centroids, metric).select("doc_id", "list_no"), "doc_id")


def coarse(queries: DataFrame, centroids: DataFrame, nprobe: int, metric: str = "inner_product") -> DataFrame:
    """Probes (qid, list_no, coarse, rank): the ``nprobe`` best lists of each query."""
    rows = assign(queries.select(F.col("qid").alias("doc_id"), F.col("qvec").alias("vec")), centroids, metric, nprobe)
    return rows.select(F.col("doc_id").alias("qid"), "list_no", F.col("score").alias("coarse"), "rank")


def limit_codes(probes: DataFrame, lists: DataFrame, max_codes: int) -> DataFrame:
    """Probes until ``max_codes`` list entries have been scanned; the list that passes the mark is still read."""
    sizes = lists.groupBy("list_no").agg(F.count("*").alias("n"))
    before = F.sum(F.coalesce("n", F.lit(0))).over(Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1))
    return probes.join(sizes, "list_no", "left").withColumn("__before", F.coalesce(before, F.lit(0))).filter(F.col("__before") < max_codes).drop("n", "__before")


def scan_lists(lists: DataFrame, queries: DataFrame, probes: DataFrame, metric: str = "inner_product", on: Column | None = None) -> DataFrame:
    """Scores of all documents in each query's probed lists (list -1 is skipped), by an equi-join on the list."""
    asked = probes.filter("list_no >= 0").select("qid", "list_no").join(queries, "qid")
    rows = lists.join(asked, "list_no")
    return (rows if on is None else rows.filter(on)).select("qid", "doc_id", "list_no", V.distance(metric, "qvec", "vec").alias("score"))


def preassigned(lists: DataFrame, queries: DataFrame, probes: DataFrame, k: int, metric: str = "inner_product", on: Column | None = None) -> DataFrame:
    """Search of given lists; keeps ``list_no``, the list each result was found in."""
    return top_k(scan_lists(lists, queries, probes, metric, on), k, V.is_similarity(metric))


def list_major(lists: DataFrame, queries: DataFrame, probes: DataFrame, k: int, metric: str = "inner_product", piece: int = 16_384) -> DataFrame:
    """The same for many queries: all that probe a list meet it in one matrix product, list by list, for inner product or L2.

    A list over ``piece`` entries is dealt into pieces, so a task holds one piece and the queries that probe its list.
    """
    similar = V.is_similarity(metric)
    sizes = lists.groupBy("list_no").agg(F.ceil(F.count("*") / piece).cast("int").alias("__pieces"))
    asked = probes.filter("list_no >= 0").select("qid", "list_no").join(queries.select("qid", V.doubles("qvec").alias("vec")), "qid").join(F.broadcast(sizes), "list_no")
    asked = asked.select("list_no", F.explode(F.sequence(F.lit(0), F.col("__pieces") - 1)).alias("piece"), "qid", "vec")
    own = lists.join(F.broadcast(sizes), "list_no").select("list_no", F.pmod(F.xxhash64("doc_id"), F.col("__pieces")).cast("int").alias("piece"), "doc_id", V.doubles("vec").alias("vec"))

    def matrix(table: pa.Table) -> np.ndarray:
        return np.asarray(table.column("vec").combine_chunks().flatten()).reshape(table.num_rows, -1)

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"qid": pa.array([], pa.int64()), "doc_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        q, x = matrix(left), matrix(right)
        qids, ids = left.column("qid").to_numpy().astype(np.int64), right.column("doc_id").to_numpy().astype(np.int64)
        score = q @ x.T
        if not similar:
            score = (q * q).sum(1)[:, None] + (x * x).sum(1)[None] - 2 * score
        top = [np.lexsort((ids, -own if similar else own))[:k] for own in score]
        return pa.table({"qid": np.repeat(qids, [len(t) for t in top]), "doc_id": ids[np.concatenate(top)], "score": np.concatenate([own[t] for own, t in zip(score, top)])})

    found = asked.groupBy("list_no", "piece").cogroup(own.groupBy("list_no", "piece")).applyInArrow(best, "qid long, doc_id long, score double")
    return top_k(found, k, similar)


def search_stats(probes: DataFrame, lists: DataFrame, on: Column | None = None, queries: DataFrame | None = None) -> DataFrame:
    """What a probed search costs: queries, lists visited, documents read, and documents that the predicate ``on`` (a condition
    on ``queries`` and documents) then lets through."""
    read = probes.filter("list_no >= 0").join(lists, "list_no")
    passed = F.count("*")
    if on is not None:
        read, passed = read.join(queries, "qid"), F.count_if(on)
    counts = read.agg(F.count("*").alias("documents"), passed.alias("scored"))
    return probes.agg(F.countDistinct("qid").alias("queries"), F.count_if(F.col("list_no") >= 0).alias("lists")).crossJoin(F.broadcast(counts))


def ivf_search(lists: DataFrame, queries: DataFrame, centroids: DataFrame, k: int, nprobe: int, metric: str = "inner_product", on: Column | None = None, max_codes: int | None = None) -> DataFrame:
    probes = coarse(queries, centroids, nprobe, metric)
    if max_codes is not None:
        probes = limit_codes(probes, lists, max_codes)
    return preassigned(lists, queries, probes, k, metric, on)


def ivf_range(lists: DataFrame, queries: DataFrame, probes: DataFrame, radius: float, metric: str = "l2", on: Column | None = None) -> DataFrame:
    return scan_lists(lists, queries, probes, metric, on).filter(_inside(metric, radius))


def refine(candidates: DataFrame, docs: DataFrame, queries: DataFrame, k: int, metric: str = "inner_product") -> DataFrame:
    """Candidates (qid, doc_id) of a coarser search scored again on the original vectors, the best ``k`` kept."""
    rows = candidates.select("qid", "doc_id").distinct().join(docs, "doc_id").join(queries, "qid")
    return top_k(rows.select("qid", "doc_id", V.distance(metric, "qvec", "vec").alias("score")), k, V.is_similarity(metric))


def by_index(pairs: DataFrame, docs: DataFrame, queries: DataFrame, metric: str = "l2") -> DataFrame:
    """Distances of given (qid, doc_id) pairs."""
    return pairs.join(docs, "doc_id").join(queries, "qid").select("qid", "doc_id", V.distance(metric, "qvec", "vec").alias("score"))


def reconstruct(results: DataFrame, docs: DataFrame) -> DataFrame:
    """Results with their documents' vectors."""
    return results.join(docs.select("doc_id", "vec"), "doc_id")


def split_search(docs: DataFrame, queries: DataFrame, k: int, widths: list[int], metric: str = "l2") -> DataFrame:
    """Search with the dimensions dealt to parts whose distances add up."""
    total, at = F.lit(0.0), 1
    for w in widths:
        total = total + V.distance(metric, F.slice("qvec", at, w), F.slice("vec", at, w))
        at += w
    return top_k(meet(docs, queries).select("qid", "doc_id", total.alias("score")), k, V.is_similarity(metric))


def nearest_1d(values: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """k nearest numbers: ``values`` (doc_id, x), ``queries`` (qid, y), nulls last. Each block of values is sorted and hands on
    each query's best, which stand around its place; other numbers than doubles meet as pairs."""
    order = Window.partitionBy("qid").orderBy(F.asc_nulls_last("score"), "doc_id")

    def best(rows: DataFrame) -> DataFrame:
        return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    def plain(rows: DataFrame) -> DataFrame:
        return rows.select("qid", "doc_id", F.abs(F.col("x") - F.col("y")).alias("score"))

    kinds = dict(values.dtypes) | dict(queries.dtypes)
    if {kinds["x"], kinds["y"]} != {"double"} or any(kinds[c] not in ("bigint", "int") for c in ("qid", "doc_id")):
        return best(plain(meet(values, queries)))

    def visit(qids, q, ids, x):
        y, x = q[:, 0], x[:, 0]
        order = np.lexsort((ids, x))
        x, ids = x[order], ids[order]
        starts = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
        first = np.arange(len(x)) - np.repeat(starts, np.diff(np.r_[starts, len(x)])) < k  # of equal numbers the k smallest ids
        x, ids = x[first], ids[first]
        at = np.searchsorted(x, y)[:, None] + np.arange(-k, k)[None]
        inside = (at >= 0) & (at < len(x))
        far = np.where(inside, np.abs(x[np.clip(at, 0, len(x) - 1)] - y[:, None]), np.inf)
        cut = np.partition(far, k - 1, axis=1)[:, k - 1]
        i, j = np.nonzero((far <= cut[:, None]) & inside)
        yield _batch(qids[i], ids[at[i, j]], score=far[i, j])
        for own, step in ((at[:, 0] - 1, -1), (at[:, -1] + 1, 1)):  # ties with the k-th beyond what was looked at
            i = np.arange(len(y))
            while len(i := i[(own[i] >= 0) & (own[i] < len(x))]) and len(i := i[np.abs(x[own[i]] - y[i]) <= cut[i]]):
                yield _batch(qids[i], ids[own[i]], score=np.abs(x[own[i]] - y[i]))
                own[i] += step

    finite = lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False))
    known, asked = values.filter(finite("x")), queries.filter(finite("y"))
    rows = _visited(known.select(F.col("doc_id").cast("long"), F.array("x").alias("vec")), asked.select(F.col("qid").cast("long"), F.array("y").alias("qvec")), visit, "qid long, doc_id long, score double", asked.count())
    found = rows.select(F.col("qid").cast(kinds["qid"]), F.col("doc_id").cast(kinds["doc_id"]), "score")
    # of each kind of other value (null, NaN, infinite) the k smallest ids
    others = values.filter(~finite("x")).withColumn("__n", F.row_number().over(Window.partitionBy("x").orderBy("doc_id"))).filter(F.col("__n") <= k).drop("__n")
    found = found.unionByName(plain(meet(others, asked)))
    if not (strange := queries.filter(~finite("y"))).isEmpty():
        found = found.unionByName(plain(meet(values, strange)))
    return best(found)


def knn_graph(docs: DataFrame, k: int, metric: str = "inner_product", of: Column | None = None) -> DataFrame:
    """Edges (src, dst, dist) to the ``k`` nearest other documents of every document, or of those where ``of`` holds."""
    return _edges(docs, docs if of is None else docs.filter(of), k, metric)


def _edges(docs: DataFrame, sources: DataFrame, k: int, metric: str) -> DataFrame:
    queries = sources.select(F.col("doc_id").alias("qid"), F.col("vec").alias("qvec"))
    score = V.distance(metric, "qvec", "vec")
    near = meet(docs, queries).select("qid", "doc_id", score.alias("score")) if k > MOST_K else _compared(docs, queries, _nearest(k, metric, others=True), {"score": score}, metric)
    return _as_graph(near, k, metric)


def _as_graph(near: DataFrame, k: int, metric: str) -> DataFrame:
    found = top_k(near.filter((F.col("doc_id") != F.col("qid")) & ~F.isnan("score")), k, V.is_similarity(metric))
    return found.select(F.col("qid").alias("src"), F.col("doc_id").alias("dst"), F.col("score").alias("dist"), "rank")


def improve_graph(graph: DataFrame, docs: DataFrame, k: int, metric: str = "l2") -> DataFrame:
    """One step of neighbour descent: neighbours of neighbours (either way) become candidates; the best ``k`` stay."""
    links = graph.select("src", "dst").unionByName(graph.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    similar, whole = V.is_similarity(metric), metric in blocks.BLOCKS and k <= MOST_K and dict(docs.dtypes)["doc_id"] == "bigint"
    size = docs.filter(F.size("vec") > 0).select(F.size("vec").alias("d")).first() if whole else None
    whole = size is not None and docs.filter(~F.coalesce((F.size("vec") == size.d) & ~F.exists("vec", lambda x: x.isNull() | (x < 0 if metric == "jensen_shannon" else F.lit(False))), F.lit(False))).isEmpty()
    if whole:  # all that one document links meet in a group, which hands on each one's best of it
        visit = _nearest(k, metric, others=True)

        def meeting(t: pa.Table) -> pa.Table:
            ids, x = t.column("doc_id").to_numpy(), np.asarray(t.column("vec").combine_chunks().flatten()).astype(np.float64).reshape(t.num_rows, -1)
            return pa.Table.from_batches(list(visit(ids, x, ids, x)))

        members = links.select(F.col("dst").alias("center"), F.col("src").alias("doc_id")).unionByName(links.select(F.col("dst").alias("center"), F.col("dst").alias("doc_id")).distinct())
        near = members.join(docs.select("doc_id", "vec"), "doc_id").groupBy("center").applyInArrow(meeting, "qid long, doc_id long, score double")
        found = top_k(near.filter("qid <> doc_id").groupBy("qid", "doc_id").agg(F.first("score").alias("score")), k, similar)
    else:
        ahead = links.select(F.col("src").alias("dst"), F.col("dst").alias("far"))
        candidates = links.join(ahead, "dst").filter("src <> far").select(F.col("src").alias("qid"), F.col("far").alias("doc_id"))
        candidates = candidates.unionByName(links.select(F.col("src").alias("qid"), F.col("dst").alias("doc_id"))).distinct()
        queries = docs.select(F.col("doc_id").alias("qid"), F.col("vec").alias("qvec"))
        found = refine(candidates, docs, queries, k, metric)
    return found.select(F.col("qid").alias("src"), F.col("doc_id").alias("dst"), F.col("score").alias("dist"), "rank")


def _firsts(keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.array([], int)


def _ranks(keys: np.ndarray) -> np.ndarray:
    """Each one's place, from 0, in its run of equal keys."""
    starts = _firsts(keys)
    return np.arange(len(keys)) - np.repeat(starts, np.diff(np.r_[starts, len(keys)]))


def _graph_start(docs: DataFrame, n: int, d: int, k: int, metric: str, seed: int) -> DataFrame:
    """(src, dst, dist): each document's best of the lists that it is in. Lists are those of hashed documents as centroids, large
    ones cut into pieces."""
    drawn = docs.select("vec").orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(max(1, n // LIST)).collect()
    centers = np.array([r.vec for r in drawn], np.float64).reshape(-1, d)
    half, most = (centers * centers).sum(1) / 2, min(IN_LISTS, len(centers))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("vec"))
            with np.errstate(all="ignore"):
                own = [np.argpartition(half - x[a : a + 1024] @ centers.T, most - 1, axis=1)[:, :most] for a in range(0, len(x), 1024)]
            of = np.repeat(np.arange(len(x)), most)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, int), *map(np.ravel, own)])), *(batch.column(c).take(pa.array(of)) for c in ("doc_id", "vec"))], names=["list_no", "doc_id", "vec"])

    listed = _spread(docs).mapInArrow(assign, f"list_no long, doc_id long, vec {dict(docs.dtypes)['vec']}")
    pieces = F.ceil(F.count("*") / PIECE).cast("int").alias("__pieces")
    listed = listed.join(F.broadcast(listed.groupBy("list_no").agg(pieces)), "list_no").withColumn("piece", F.pmod(F.xxhash64("doc_id"), F.col("__pieces")))
    visit = _nearest(k, metric, others=True)

    def meeting(t: pa.Table) -> pa.Table:
        ids, x = t.column("doc_id").to_numpy(), _matrix(t.column("vec").combine_chunks())
        return pa.Table.from_batches(list(visit(ids, x, ids, x))).rename_columns(["src", "dst", "dist"])

    return listed.groupBy("list_no", "piece").applyInArrow(meeting, "src long, dst long, dist double")


def _merged(old: DataFrame | None, found: DataFrame, pool: int, parts: int, similar: bool) -> DataFrame:
    """The ``pool`` best different edges (src, dst, dist, fresh, rank) of each document; fresh are those that ``old`` has not."""
    rows = found.select("src", "dst", "dist", F.lit(True).alias("fresh"))
    if old is not None:
        rows = rows.unionByName(old.select("src", "dst", "dist", "fresh"))

    def best(t: pa.Table) -> pa.Table:
        src, dst, dist, fresh = (t.column(c).to_numpy() for c in ("src", "dst", "dist", "fresh"))
        order = np.lexsort((fresh, dst, src))
        first = np.r_[True, (src[order][1:] != src[order][:-1]) | (dst[order][1:] != dst[order][:-1])]
        order = order[first]
        order = order[np.lexsort((dst[order], -dist[order] if similar else dist[order], src[order]))]
        rank = _ranks(src[order])
        order, rank = order[rank < pool], rank[rank < pool]
        return pa.table({"src": src[order], "dst": dst[order], "dist": dist[order], "fresh": fresh[order], "rank": (rank + 1).astype(np.int32)})

    return rows.groupBy(F.pmod(F.xxhash64("src"), F.lit(parts)).alias("part")).applyInArrow(best, "src long, dst long, dist double, fresh boolean, rank int")


def _local_joins(metric: str, pool: int) -> Callable:
    """All pairs that centers' members make, one of them a fresh member, that come before the last of a member's pool.

    A group has rows of vectors (id, last, last_id, vec) and of centers' members (id, other, fresh) with an empty vector, in no
    order. Products choose which pairs are summed, in element order (see :mod:`blocks`).
    """
    similar = V.is_similarity(metric)

    def run(t: pa.Table) -> pa.Table:
        there = pa.array(t.column("vec").combine_chunks().value_lengths().to_numpy() > 0)
        own = t.filter(there)
        ids = own.column("id").to_numpy()
        order = np.argsort(ids)
        x, ids = _matrix(own.column("vec").combine_chunks())[order], ids[order]
        turned = np.ascontiguousarray(x.T)
        last, last_id = own.column("last").to_numpy()[order].copy(), own.column("last_id").to_numpy()[order].copy()
        links = t.filter(pc.invert(there))
        center, member, fresh = links.column("id").to_numpy(), np.searchsorted(ids, links.column("other").to_numpy()), links.column("fresh").to_numpy()
        order = np.lexsort((~fresh, member, center))
        order = order[np.r_[True, (center[order][1:] != center[order][:-1]) | (member[order][1:] != member[order][:-1])]]
        center, member, fresh = center[order], member[order], fresh[order]
        with np.errstate(all="ignore"):
            size = blocks.norms(x)
            product = metric in blocks.PRODUCTS and not (size >= 1e150).any()
            length = np.sqrt(size)
            far = np.nanmax(length) if len(length) and not np.isnan(length).all() else 0.0
            slack = 4 * (x.shape[1] + 4) * np.finfo(float).eps * ((length + far) ** 2 if metric == "l2" else length * far) + 1e-300 if product else np.zeros(len(x))
        kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        waiting: list[tuple[np.ndarray, np.ndarray]] = []
        n = len(ids)

        def settle() -> None:
            """Scores of the pairs that wait, of which each member's ``pool`` best stay."""
            keys, at = np.unique(np.concatenate([p for p, _ in waiting] or [np.zeros(0, int)]), return_index=True)
            a, b = np.divmod(keys, n)
            if metric in blocks.PRODUCTS:
                loss = blocks.of_pairs(metric, turned, turned, a, b)
                loss = -loss if similar else loss
            else:  # summed in element order before
                loss = np.concatenate([own for _, own in waiting] or [np.zeros(0)])[at]
            waiting.clear()
            good = (loss < last[a]) | (loss == last[a]) & (ids[b] <= last_id[a])
            a, b, loss = (np.concatenate(c) for c in zip(*kept, (a[good], b[good], loss[good])))
            order = np.lexsort((ids[b], loss, a))
            a, b, loss = a[order], b[order], loss[order]
            new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])] if len(a) else np.zeros(0, bool)
            a, b, loss = a[new], b[new], loss[new]
            rank = _ranks(a)
            a, b, loss, rank = (c[rank < pool] for c in (a, b, loss, rank))
            full = rank == pool - 1
            last[a[full]], last_id[a[full]] = loss[full], ids[b[full]]
            kept[:] = [(a, b, loss)]

        count = 0
        with np.errstate(all="ignore"):
            starts = _firsts(center)
            for start, end in zip(starts, np.r_[starts[1:], len(center)]):
                m = member[start:end]
                u = m[fresh[start:end]]
                if not len(u):
                    continue
                if product:
                    loss = x[u] @ x[m].T
                    if metric == "l2":
                        loss *= -2
                        loss += size[u][:, None]
                        loss += size[m]
                    elif similar:
                        np.negative(loss, out=loss)
                else:
                    loss = blocks.BLOCKS[metric](turned[:, u], turned[:, m])
                    if similar:
                        loss = -loss
                loss -= slack[u][:, None]
                i, j = np.divmod(np.flatnonzero(loss <= np.maximum(last[u][:, None], last[m])), len(m))
                loss, i, j = loss[i, j], u[i], m[j]
                for one, two in ((i, j), (j, i)):
                    good = (loss <= last[one]) & (one != two)
                    waiting.append((one[good] * n + two[good], loss[good]))
                    count += len(loss)
                if count > 1 << 20:
                    settle()
                    count = 0
            settle()
        a, b, loss = kept[0]
        return pa.table({"src": ids[a], "dst": ids[b], "dist": -loss if similar else loss})

    return run


def _descended(graph: DataFrame, docs: DataFrame, pool: int, parts: int, metric: str) -> DataFrame:
    """One step of neighbour descent: of all that a document links or that link it (of these the nearest), fresh ones meet all in
    blocks of such centers, which hand on what improves a member's pool."""
    similar = V.is_similarity(metric)
    window = Window.partitionBy("dst").orderBy(F.desc("dist") if similar else F.asc("dist"), "src")
    back = graph.withColumn("__n", F.row_number().over(window)).filter(F.col("__n") <= REVERSE)
    links = graph.select(F.col("src").alias("id"), F.col("dst").alias("other"), "fresh").unionByName(back.select(F.col("dst").alias("id"), F.col("src").alias("other"), "fresh"))
    links = links.unionByName(graph.filter("rank = 1").select(F.col("src").alias("id"), F.col("src").alias("other"), F.lit(False).alias("fresh")))
    links = links.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(parts)))
    edge = F.lit(float("inf"))
    lasts = graph.filter(F.col("rank") == pool).select(F.col("src").alias("id"), (-F.col("dist") if similar else F.col("dist")).alias("last"), F.col("dst").alias("last_id"))
    known = docs.select(F.col("doc_id").alias("id"), "vec").join(lasts, "id", "left").select("id", "vec", F.coalesce("last", edge).alias("last"), F.coalesce("last_id", F.lit(2**63 - 1)).alias("last_id"))
    vectors = links.select("block", F.col("other").alias("id")).distinct().join(known, "id")
    none = F.lit(None)
    rows = vectors.select("block", "id", none.cast("long").alias("other"), none.cast("boolean").alias("fresh"), "last", "last_id", "vec")
    rows = rows.unionByName(links.select("block", "id", "other", "fresh", none.cast("double").alias("last"), none.cast("long").alias("last_id"), F.array().cast(dict(docs.dtypes)["vec"]).alias("vec")))  # long runs of nulls are slow to hand on
    found = rows.groupBy("block").applyInArrow(_local_joins(metric, pool), "src long, dst long, dist double")
    return _merged(graph.withColumn("fresh", F.lit(False)), found, pool, parts, similar)


def neighbour_descent(docs: DataFrame, k: int, rounds: int = 4, metric: str = "l2", seed: int = 7, least: float = 0.93) -> DataFrame:
    """An approximate k-NN graph: each document's best of a few lists, improved ``rounds`` times and then until ``least`` of the
    edges of SAMPLE hashed documents are those of exact search.

    ``k`` + POOL candidates are kept of each document; where rounds no longer help, twice as many. Documents with fewer than
    ``k`` edges at the end and those whose vectors are not whole are searched exactly.
    """
    similar, ids_known = V.is_similarity(metric), dict(docs.dtypes)["doc_id"] == "bigint"
    size = docs.filter(F.size("vec") > 0).select(F.size("vec").alias("d")).first()
    if metric not in blocks.BLOCKS or not ids_known or k + POOL > MOST_K or size is None:
        return _plain_descent(docs, k, rounds, metric, seed)
    bad = (lambda x: x.isNull() | (x < 0)) if metric == "jensen_shannon" else (lambda x: x.isNull())
    fits = F.coalesce((F.size("vec") == size.d) & ~F.exists("vec", bad), F.lit(False))
    whole = docs.filter(fits).select("doc_id", "vec")
    n = whole.count()
    session = docs.sparkSession
    parts = max(2 * session.sparkContext.defaultParallelism, -(-n // PIECE))
    drawn = [r.doc_id for r in whole.select("doc_id").orderBy(F.xxhash64("doc_id", F.lit(seed + 1)), "doc_id").limit(SAMPLE).collect()]
    truth = {(r.src, r.dst) for r in knn_graph(whole, k, metric, of=F.col("doc_id").isin(drawn)).select("src", "dst").collect()}

    def kept(rows: DataFrame) -> DataFrame:
        return rows.checkpoint() if session.sparkContext.getCheckpointDir() else rows.localCheckpoint()

    def share(rows: DataFrame) -> float:
        asked = rows.filter(F.col("src").isin(drawn) & (F.col("rank") <= k))
        return sum((r.src, r.dst) in truth for r in asked.select("src", "dst").collect()) / max(1, len(truth))

    pool, done = min(k + POOL, max(1, n - 1)), 0
    graph = kept(_merged(None, _graph_start(whole, n, size.d, pool, metric, seed), pool, parts, similar))
    near = share(graph)
    while pool < n - 1 or done < rounds:
        graph, before, done = kept(_descended(graph, whole, pool, parts, metric)), near, done + 1
        near = share(graph)
        if near >= least and (done >= rounds or graph.filter("fresh").isEmpty()):
            break
        if done >= rounds and near < before + 0.01 and pool < n - 1:  # what was left out for a smaller pool counts again
            pool = min(2 * pool, n - 1)
            graph = graph.withColumn("fresh", F.lit(True))
    edges = graph.filter(F.col("rank") <= k).select("src", "dst", "dist", "rank")
    short = whole.join(edges.groupBy("src").count().filter(F.col("count") >= min(k, n - 1)), F.col("doc_id") == F.col("src"), "left_anti")
    if not short.isEmpty():
        edges = edges.join(short.select(F.col("doc_id").alias("src")), "src", "left_anti").unionByName(_edges(whole, short, k, metric))
    if not (odd := docs.filter(~fits).select("doc_id", "vec")).isEmpty():
        queries = whole.select(F.col("doc_id").alias("qid"), F.col("vec").alias("qvec"))
        near = meet(odd, queries).select("qid", "doc_id", V.distance(metric, "qvec", "vec").alias("score"))
        near = near.unionByName(edges.select(F.col("src").alias("qid"), F.col("dst").alias("doc_id"), F.col("dist").alias("score")))
        edges = _as_graph(near, k, metric).unionByName(_edges(docs, odd, k, metric))
    return edges


def _plain_descent(docs: DataFrame, k: int, rounds: int, metric: str, seed: int) -> DataFrame:
    """Neighbour descent by pairs as rows, from a random graph (hashed neighbours): of metrics and ids without blocks."""
    n = max(docs.count(), 1)
    numbered = docs.select("doc_id").withColumn("slot", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(n)))
    wanted = docs.select(F.col("doc_id").alias("src"), F.explode(F.sequence(F.lit(1), F.lit(4 * k))).alias("t")).withColumn("slot", F.pmod(F.xxhash64("src", "t"), F.lit(n)))
    graph = wanted.join(numbered, "slot").filter("src <> doc_id").select("src", F.col("doc_id").alias("dst")).distinct()
    for _ in range(rounds):
        graph = improve_graph(graph, docs, k, metric)
        graph = graph.checkpoint() if docs.sparkSession.sparkContext.getCheckpointDir() else graph
    return graph


def map_ids(results: DataFrame, id_map: DataFrame) -> DataFrame:
    """Internal to external ids by ``id_map`` (internal, external); -1 and unknown ids become -1."""
    named = id_map.select(F.col("internal").alias("doc_id"), "external")
    return results.join(named, "doc_id", "left").withColumn("doc_id", F.coalesce("external", F.lit(-1).cast("long"))).drop("external")


def dedup_search(docs: DataFrame, queries: DataFrame, k: int, metric: str = "inner_product") -> DataFrame:
    """Search over distinct vectors, each scored once; a found vector stands for all documents that have it."""
    classes = docs.groupBy("vec").agg(F.min("doc_id").alias("class_id"))
    found = knn(classes.select(F.col("class_id").alias("doc_id"), "vec"), queries, k, metric)
    members = docs.join(classes, "vec").select("class_id", F.col("doc_id").alias("member"))
    rows = found.select("qid", F.col("doc_id").alias("class_id"), "score").join(members, "class_id")
    return top_k(rows.select("qid", F.col("member").alias("doc_id"), "score"), k, V.is_similarity(metric))
