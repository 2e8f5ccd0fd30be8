"""Predicate-aware routing: which lists to probe, by centroid similarity and by how many allowed documents a list has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import vectors as V
from tessella.operators.search import meet, preassigned


def selectivity(legal: DataFrame, lists: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """Share of each list's documents that each query may see: (qid, list_no, p). With ``queries`` also the zeros."""
    sizes = lists.groupBy("list_no").agg(F.count("*").alias("size"))
    hits = legal.join(lists.select("doc_id", "list_no"), "doc_id").groupBy("qid", "list_no").agg(F.count("*").alias("hits"))
    if queries is None:
        return hits.join(sizes, "list_no").select("qid", "list_no", (F.col("hits") / F.col("size")).alias("p"))
    every = meet(sizes, queries.select("qid"))
    p = F.coalesce("hits", F.lit(0)) / F.col("size")
    return every.join(hits, ["qid", "list_no"], "left").select("qid", "list_no", p.alias("p"))


def attribute_selectivity(docs_in_lists: DataFrame, preds: DataFrame, attr: str = "attr") -> DataFrame:
    """The same for equality predicates, from counts of (list, value): documents are counted once, not once a query."""
    counts = docs_in_lists.groupBy("list_no", F.col(attr).alias("eq")).agg(F.count("*").alias("hits"))
    sizes = counts.groupBy("list_no").agg(F.sum("hits").alias("size"))
    return preds.select("qid", "eq").join(counts, "eq").join(sizes, "list_no").select("qid", "list_no", (F.col("hits") / F.col("size")).alias("p"))


def log_selectivity(p: Column, beta: float) -> Column:
    """beta·ln p; minus infinity without an allowed document, also for beta 0."""
    return F.when(F.coalesce(p, F.lit(0.0)) <= 0, F.lit(float("-inf"))).otherwise(F.lit(0.0) if beta == 0 else F.lit(beta) * F.ln(p))


def centroid_scores(queries: DataFrame, centroids: DataFrame) -> DataFrame:
    """q·c of every query and list, centroids cut to the query's dimensions (signature dimensions fall off) and normalised."""
    rows = meet(centroids, queries.select("qid", "qvec"))
    return rows.select("qid", "list_no", V.inner_product("qvec", V.normalize(F.slice("cvec", F.lit(1), F.size("qvec")))).alias("coarse"))


def probes(scores: DataFrame, shares: DataFrame, nprobe: int, beta: float, aware: bool = True) -> DataFrame:
    """The ``nprobe`` best lists by q·c + beta·ln p; of those, lists without an allowed document are then left out.

    ``aware`` off is plain routing by q·c.
    """
    if not aware:
        order = Window.partitionBy("qid").orderBy(F.desc("coarse"), "list_no")
        return scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= nprobe)
    rows = scores.join(shares, ["qid", "list_no"], "left").withColumn("routed", F.col("coarse") + log_selectivity(F.col("p"), beta))
    order = Window.partitionBy("qid").orderBy(F.desc("routed"), "list_no")
    return rows.withColumn("rank", F.row_number().over(order)).filter((F.col("rank") <= nprobe) & (F.col("p") > 0)).select("qid", "list_no", "coarse", "rank", "p")


def routed_search(lists: DataFrame, queries: DataFrame, centroids: DataFrame, k: int, nprobe: int, beta: float, on: Column, shares: DataFrame) -> DataFrame:
    """Filtered search of the routed lists; ``on`` is the predicate on both sides."""
    return preassigned(lists, queries, probes(centroid_scores(queries, centroids), shares, nprobe, beta), k, "inner_product", on)


def sweep(low: int, high: int, steps: int, cap: int | None = None) -> list[int]:
    """Distinct probe depths, evenly spaced in log2 between two powers."""
    span = [2 ** (low + (high - low) * i / max(steps - 1, 1)) for i in range(steps)]
    return sorted({min(round(x), cap) if cap else round(x) for x in span})


def predicted_selectivity(query_signatures: DataFrame, doc_signatures: DataFrame, lists: DataFrame) -> DataFrame:
    """Selectivity foretold by signatures: q·mean(list), held between 1/(largest list) and 1."""
    sized = doc_signatures.join(lists.select("doc_id", "list_no"), "doc_id")
    parts = sized.select("list_no", F.posexplode("sig").alias("pos", "x")).groupBy("list_no", "pos").agg(F.avg("x").alias("m"))
    means = parts.groupBy("list_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("cvec"))
    top = lists.groupBy("list_no").agg(F.count("*").alias("n")).agg(F.max("n").alias("most"))
    rows = meet(means, query_signatures.select("qid", F.col("sig").alias("qvec"))).crossJoin(F.broadcast(top))
    p = V.inner_product("qvec", "cvec")
    return rows.select("qid", "list_no", F.least(F.lit(1.0), F.greatest(1 / F.col("most"), p)).alias("p"))


def contribution(truth: DataFrame, lists: DataFrame, k: int) -> DataFrame:
    """Share of each query's true neighbours that each list holds."""
    return truth.join(lists.select("doc_id", "list_no"), "doc_id").groupBy("qid", "list_no").agg((F.count("*") / k).alias("share"))


def cost_curve(ranked: DataFrame, sizes: DataFrame, shares: DataFrame) -> DataFrame:
    """Mean documents scanned and mean recall when the first ``depth`` lists of each query's ranking (qid, list_no, rank[, p])
    are read. A list without an allowed document costs nothing."""
    rows = ranked.join(sizes, "list_no", "left").join(shares, ["qid", "list_no"], "left")
    cost = F.coalesce("n", F.lit(0))
    if "p" in ranked.columns:
        cost = F.when(F.coalesce("p", F.lit(0.0)) > 0, cost).otherwise(0)
    upto = Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.select("qid", F.col("rank").alias("depth"), F.sum(cost).over(upto).alias("scanned"), F.sum(F.coalesce("share", F.lit(0.0))).over(upto).alias("recall"))
    return rows.groupBy("depth").agg(F.avg("scanned").alias("scanned"), F.avg("recall").alias("recall"))
