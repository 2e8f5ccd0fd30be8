"""Recall, precision, ground truth, Pareto points and run statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.search import knn


def ground_truth(docs: DataFrame, queries: DataFrame, k: int, metric: str = "inner_product", on: Column | None = None) -> DataFrame:
    return knn(docs, queries, k, metric, on)


def recall(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """Mean over the truth's queries of |found ∩ truth| / k at depth ``k``; a query without a hit counts as 0."""
    want = truth.filter(F.col("rank") <= k).select("qid", "doc_id").distinct()
    got = found.filter(F.col("rank") <= k).select("qid", "doc_id").distinct().withColumn("hit", F.lit(1))
    each = want.join(got, ["qid", "doc_id"], "left").groupBy("qid").agg((F.count("hit") / k).alias("r"))
    return each.agg(F.avg("r").alias("recall"))


def one_recall(found: DataFrame, truth: DataFrame, depth: int) -> DataFrame:
    """Share of queries whose single best document is among the first ``depth`` found."""
    best = truth.filter("rank = 1").select("qid", "doc_id")
    got = found.filter(F.col("rank") <= depth).select("qid", "doc_id", F.lit(1).alias("hit"))
    return best.join(got, ["qid", "doc_id"], "left").agg((F.count("hit") / F.count("*")).alias("recall"))


def intersection(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """Share of common documents in two results' first ``k``, over all queries of ``a``."""
    left, right = a.filter(F.col("rank") <= k).select("qid", "doc_id"), b.filter(F.col("rank") <= k).select("qid", "doc_id")
    return left.join(right.withColumn("hit", F.lit(1)), ["qid", "doc_id"], "left").agg((F.count("hit") / (F.countDistinct("qid") * k)).alias("shared"))


def range_precision_recall(found: DataFrame, truth: DataFrame, queries: DataFrame, mode: str = "overall") -> DataFrame:
    """Precision and recall of range results, over all rows (overall) or as the mean over queries (average).

    Without results the precision is 1, without true ones the recall is 1.
    """
    got = found.groupBy("qid").agg(F.count("*").alias("got"))
    want = truth.groupBy("qid").agg(F.count("*").alias("want"))
    both = found.select("qid", "doc_id").join(truth.select("qid", "doc_id"), ["qid", "doc_id"]).groupBy("qid").agg(F.count("*").alias("both"))
    each = queries.select("qid").join(got, "qid", "left").join(want, "qid", "left").join(both, "qid", "left").na.fill(0)
    ratio = lambda a, b: F.when(F.col(b) == 0, 1.0).otherwise(F.try_divide(F.col(a).cast("double"), F.col(b)))
    if mode == "average":
        return each.agg(F.avg(ratio("both", "got")).alias("precision"), F.avg(ratio("both", "want")).alias("recall"))
    return each.agg(*[F.sum(c).alias(c) for c in ("got", "want", "both")]).select(ratio("both", "got").alias("precision"), ratio("both", "want").alias("recall"))


def precision_recall_at(found: DataFrame, truth: DataFrame, radii: list[float], similar: bool = False) -> DataFrame:
    """Overall precision and recall of range results cut to each radius; the truth is cut alike."""
    cuts = found.sparkSession.createDataFrame([(float(r),) for r in radii], "radius double")
    inside = F.col("score") > F.col("radius") if similar else F.col("score") < F.col("radius")
    got, want = (t.select("qid", "doc_id", "score").join(F.broadcast(cuts), inside) for t in (found, truth))
    n = lambda t, name: t.groupBy("radius").agg(F.count("*").alias(name))
    both = got.select("radius", "qid", "doc_id").join(want.select("radius", "qid", "doc_id"), ["radius", "qid", "doc_id"])
    each = cuts.join(n(got, "got"), "radius", "left").join(n(want, "want"), "radius", "left").join(n(both, "both"), "radius", "left").na.fill(0)
    ratio = lambda a, b: F.when(F.col(b) == 0, 1.0).otherwise(F.try_divide(F.col(a).cast("double"), F.col(b)))
    return each.select("radius", ratio("both", "got").alias("precision"), ratio("both", "want").alias("recall"))


def operating_points(points: DataFrame, key: str = "key", perf: str = "perf", time: str = "t") -> DataFrame:
    """Points that no other beats in quality at no more time."""
    before = Window.orderBy(time, F.desc(perf), key).rowsBetween(Window.unboundedPreceding, -1)
    best = F.max(perf).over(before)
    return points.withColumn("__best", best).filter(F.col("__best").isNull() | (F.col(perf) > F.col("__best"))).drop("__best")


def same_results(a: DataFrame, b: DataFrame, tolerance: float = 1e-5) -> DataFrame:
    """Queries whose results differ once ids at equal scores (within a relative tolerance) count as a set; the last such
    group of a query, which a cut-off may split, is left out."""
    sides = [t.select("qid", "doc_id", "rank", "score", F.lit(side).alias("side")) for t, side in ((a, 1), (b, -1))]
    return differing(sides[0].unionByName(sides[1]), tolerance)


def differing(both: DataFrame, tolerance: float = 1e-5) -> DataFrame:
    """:func:`same_results` of two results in one table, whose ``side`` is 1 or -1: for what is made of one search, which is then
    done once."""
    order = Window.partitionBy("qid", "side").orderBy("rank")
    step = F.abs(F.col("score") - F.lag("score").over(order)) > tolerance * F.greatest(F.abs("score"), F.lit(1e-30))
    both = both.withColumn("g", F.sum(F.coalesce(step, F.lit(False)).cast("int")).over(order))
    both = both.withColumn("last", F.max("g").over(Window.partitionBy("qid", "side"))).filter("g < last")
    return both.groupBy("qid", "g", "doc_id").agg(F.sum("side").alias("more")).filter("more <> 0").select("qid").distinct()


def imbalance(lists: DataFrame, n_lists: int) -> DataFrame:
    """n·Σh²/(Σh)²: 1 for equal lists."""
    h = lists.groupBy("list_no").agg(F.count("*").cast("double").alias("h"))
    return h.agg((F.lit(n_lists) * F.sum(F.col("h") * F.col("h")) / F.pow(F.sum("h"), F.lit(2))).alias("imbalance"))


def matrix_stats(docs: DataFrame) -> DataFrame:
    """Per dimension: how many numbers, NaNs, infinities and zeros, and least, largest, mean and deviation of finite ones."""
    cells = docs.select(F.posexplode("vec").alias("dim", "x")).withColumn("x", F.col("x").cast("double"))
    finite = F.when(~F.isnan("x") & (F.abs("x") < float("inf")), F.col("x"))
    counts = F.count("*").alias("n"), F.count_if(F.isnan("x")).alias("nan"), F.count_if(F.abs("x") == float("inf")).alias("inf"), F.count_if(F.col("x") == 0).alias("zero")
    return cells.groupBy("dim").agg(*counts, F.min(finite).alias("least"), F.max(finite).alias("largest"), F.avg(finite).alias("mean"), F.stddev_pop(finite).alias("deviation"))


def duplicate_vectors(docs: DataFrame) -> DataFrame:
    return docs.groupBy("vec").agg(F.count("*").alias("n")).agg(F.count("*").alias("distinct_vectors"), F.sum(F.col("n") - 1).alias("duplicates"))


def checksum(df: DataFrame, *columns: str) -> DataFrame:
    """One number for a table, whatever its order."""
    return df.agg(F.bit_xor(F.xxhash64(*columns)).alias("checksum"), F.count("*").alias("n"))


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    return df.groupBy(F.expr(f"width_bucket({value}, {low}, {high}, {bins})").alias("bin")).agg(F.count("*").alias("n"))


def timing_summary(times: DataFrame, stage: str = "stage", seconds: str = "seconds") -> DataFrame:
    """Median and 95th percentile in milliseconds."""
    q = F.expr(f"percentile({seconds}, array(0.5, 0.95))")
    return times.groupBy(stage).agg((q[0] * 1000).alias("median_ms"), (q[1] * 1000).alias("p95_ms"))


def held_out(fit_masks: DataFrame, held: DataFrame) -> DataFrame:
    """Fit queries whose set of documents equals none of the held-out queries' sets."""
    digest = lambda t: t.groupBy("qid").agg(F.bit_xor(F.xxhash64("doc_id")).alias("a"), F.count("*").alias("n"))
    return digest(fit_masks).join(digest(held).select("a", "n").distinct(), ["a", "n"], "left_anti").select("qid")
