"""A whole index run: statistics, duplicates, training, shards, merge, search, evaluation, consistency."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators import cluster, evaluate, maintain, search


@dataclass
class Report:
    stats: DataFrame
    duplicates: int
    lists: DataFrame
    results: DataFrame
    recall: float


def run(docs: DataFrame, queries: DataFrame, path: str, n_lists: int, k: int, nprobe: int, shards: int = 4, metric: str = "l2", rounds: int = 8) -> Report:
    """Documents (doc_id, vec) deduplicated, clustered, written shard by shard under ``path``, merged, searched and compared
    with exact search. A vector with a component that is no finite number stops the run; a vector that several documents
    share is stored once, under the smallest id."""
    from tessella.sources.files import load_tables, save_tables

    stats = evaluate.matrix_stats(docs)
    if not stats.filter("nan + inf > 0").isEmpty():
        raise ValueError("vectors hold numbers that are not finite")
    duplicates = evaluate.duplicate_vectors(docs).first().duplicates
    unique = maintain.first_seen(docs.select("doc_id", "vec"), "vec").filter("inserted").select("doc_id", "vec")
    centroids = cluster.kmeans(unique, n_lists, rounds, metric)
    spark = docs.sparkSession
    for s in range(shards):
        part = search.build_lists(maintain.block(unique, shards, s), centroids, metric)
        save_tables({"lists": part, "centroids": centroids}, f"{path}/shard-{s}", overwrite=True, shard=s, shards=shards)
    loaded = [load_tables(spark, f"{path}/shard-{s}") for s in range(shards)]
    lists = loaded[0][0]["lists"]
    for tables, _ in loaded[1:]:
        lists = maintain.merge(lists, tables["lists"])
    if lists.select("doc_id").exceptAll(unique.select("doc_id")).unionByName(unique.select("doc_id").exceptAll(lists.select("doc_id"))).limit(1).count():
        raise RuntimeError("the merged shards don't hold the documents")
    results = search.ivf_search(lists, queries, centroids, k, nprobe, metric)
    truth = evaluate.ground_truth(unique, queries, k, metric)
    again = search.by_index(results.select("qid", "doc_id"), unique, queries, metric).withColumnRenamed("score", "exact")
    if results.join(again, ["qid", "doc_id"]).filter(F.abs(F.col("score") - F.col("exact")) > 1e-6).limit(1).count():
        raise RuntimeError("scores differ from the vectors' own distances")
    return Report(stats, duplicates, lists, results, evaluate.recall(results, truth, k).first().recall)
