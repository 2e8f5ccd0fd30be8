"""Top-k, merging of results, thresholds and running totals along a ranking. Ties always go to the smaller id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranking(similar: bool, score: str = "score", ident: str = "doc_id") -> list[Column]:
    return [F.desc(score) if similar else F.asc(score), F.asc(ident)]


def top_k(df: DataFrame, k: int, similar: bool, by: str = "qid", score: str = "score", ident: str = "doc_id") -> DataFrame:
    """The best ``k`` rows of each ``by`` with their ``rank`` from 1. Spark keeps k rows a task before the exchange."""
    if k < 1:
        raise ValueError("k must be at least 1")
    window = Window.partitionBy(by).orderBy(*ranking(similar, score, ident))
    return df.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k)


def merge_results(*tables: DataFrame, k: int, similar: bool) -> DataFrame:
    """Shards' results (qid, doc_id, score) as one table; a document in several shards counts once, at its best."""
    rows = tables[0].select("qid", "doc_id", "score")
    for other in tables[1:]:
        rows = rows.unionByName(other.select("qid", "doc_id", "score"))
    best = F.max("score") if similar else F.min("score")
    return top_k(rows.groupBy("qid", "doc_id").agg(best.alias("score")), k, similar)


def k_smallest(values, k: int) -> Column:
    return F.slice(F.array_sort(values), 1, k)


def k_largest(values, k: int) -> Column:
    return F.slice(F.sort_array(values, asc=False), 1, k)


def extrema(df: DataFrame, by: str = "qid", score: str = "score", ident: str = "doc_id") -> DataFrame:
    """Least and largest score of each ``by`` and whose they are."""
    low, high = F.struct(score, ident), F.struct(score, (-F.col(ident)).alias("n"))
    return df.groupBy(by).agg(F.min(low)[score].alias("least"), F.min(low)[ident].alias("least_id"), F.max(high)[score].alias("largest"), (-F.max(high)["n"]).alias("largest_id"))


def approximate_top_k(df: DataFrame, k: int, similar: bool, buckets: int, by: str = "qid") -> DataFrame:
    """The best row of each of ``buckets`` buckets of ids, of which the best ``k`` stay: no more than that are compared, and a
    bucket's second best is lost."""
    best = top_k(df.withColumn("__b", F.struct(by, F.pmod("doc_id", F.lit(buckets)).alias("b"))), 1, similar, "__b").drop("__b", "rank")
    return top_k(best, k, similar, by)


def partition(df: DataFrame, n: int, similar: bool, by: str = "qid") -> DataFrame:
    """The ``n`` best rows of each ``by`` in no order, with the threshold (the n-th best score) beside them."""
    rows = top_k(df, n, similar, by)
    cut = rows.groupBy(by).agg((F.min("score") if similar else F.max("score")).alias("threshold"))
    return rows.drop("rank").join(cut, by)


def fuzzy_partition(df: DataFrame, least: int, most: int, similar: bool, by: str = "qid") -> DataFrame:
    """Between ``least`` and ``most`` best rows of each ``by``: all whose score ties with the ``least``-th, up to ``most``."""
    rows = top_k(df, most, similar, by)
    cut = rows.filter(F.col("rank") <= least).groupBy(by).agg((F.min("score") if similar else F.max("score")).alias("threshold"))
    inside = F.col("score") >= F.col("threshold") if similar else F.col("score") <= F.col("threshold")
    return rows.join(cut, by).filter(inside).drop("rank")


def handle_ties(results: DataFrame, by: str = "qid") -> DataFrame:
    """Results (rank, doc_id, score) with the ids of each run of equal scores in ascending order on the run's ranks."""
    order = Window.partitionBy(by).orderBy("rank")
    run = F.sum((F.coalesce(F.col("score") != F.lag("score").over(order), F.lit(False))).cast("int")).over(order)
    rows = results.withColumn("__run", run)
    again = F.row_number().over(Window.partitionBy(by).orderBy("__run", "doc_id"))
    return rows.withColumn("rank", again).drop("__run")


def argsort(df: DataFrame, value: str, ident: str, out: str = "place") -> DataFrame:
    """Place of each row by value from 0, without one task for all: ranges are sorted apart and offset by their counts."""
    dealt = df.repartitionByRange(F.col(value), F.col(ident)).withColumn("__range", F.spark_partition_id())
    from tessella.sources.files import scratch

    path = scratch(df.sparkSession)  # ranges are cut by a sample, so they are fixed before they are numbered
    dealt.write.parquet(path)
    dealt = df.sparkSession.read.schema(dealt.schema).parquet(path)
    counts = dealt.groupBy("__range").count()
    offsets = counts.withColumn("__before", F.coalesce(F.sum("count").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(value, ident))
    return dealt.withColumn("__n", inside).join(offsets, "__range").withColumn(out, F.col("__before") + F.col("__n") - 1).drop("__range", "__n", "__before")


def bucket_sort(df: DataFrame, bucket: str, ident: str) -> DataFrame:
    """Ids grouped by bucket, ascending inside; where each bucket starts is the running total of the sizes before."""
    return df.repartition(bucket).sortWithinPartitions(bucket, ident)


def offsets(sizes: DataFrame, bucket: str, size: str = "n") -> DataFrame:
    """``start`` of each bucket; a row per bucket is all that is ordered."""
    before = Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("start", F.coalesce(F.sum(size).over(before), F.lit(0)))


def cumulate(df: DataFrame, value: str, out: str, by: str = "qid", order: str = "rank") -> DataFrame:
    return df.withColumn(out, F.sum(value).over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def first_depth(curve: DataFrame, goal: float = 0.95, depth: str = "depth", recall: str = "recall") -> DataFrame:
    """The least depth whose recall reaches ``goal``; none is an error."""
    reached = F.min(F.when(F.col(recall) >= goal, F.col(depth)))
    return curve.agg(F.coalesce(reached, F.raise_error(F.lit(f"recall {goal} is never reached")).cast("int")).alias(depth))


def tighten(results: DataFrame, most: int, similar: bool) -> DataFrame:
    """Range results cut to a radius that leaves at most ``most``: strictly better than the (most+1)-th best of all."""
    order = [F.desc("score")] if similar else [F.asc("score")]
    cut = results.orderBy(*order).limit(most + 1).agg(F.count("*").alias("n"), (F.min("score") if similar else F.max("score")).alias("cut"))
    inside = F.col("score") > F.col("cut") if similar else F.col("score") < F.col("cut")
    return results.join(F.broadcast(cut), (F.col("n") <= most) | inside, "inner").drop("n", "cut")


def pad_missing(results: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Exactly ``k`` rows a query, absent ones with doc_id -1 and a null score, as dense result matrices have them."""
    slots = queries.select("qid").distinct().withColumn("rank", F.explode(F.sequence(F.lit(1), F.lit(k))))
    return slots.join(results, ["qid", "rank"], "left").withColumn("doc_id", F.coalesce("doc_id", F.lit(-1).cast("long")))


def combine_knn_and_range(knn: DataFrame, ranged: DataFrame, k: int, radius: float, similar: bool) -> DataFrame:
    """Range results, taken from the k-NN table for queries whose k-th neighbour is already outside the radius."""
    inside = F.col("score") > radius if similar else F.col("score") < radius
    full = knn.filter(inside).groupBy("qid").count().filter(F.col("count") >= k).select("qid")
    return knn.select("qid", "doc_id", "score").filter(inside).join(full, "qid", "left_anti").unionByName(ranged.select("qid", "doc_id", "score").join(full, "qid", "left_semi"))
