"""Hamming search over bit vectors, held as arrays of 64-bit words in ``code``."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions import vectors as V
from tessella.operators.search import meet
from tessella.operators.topk import top_k


def from_float(docs: DataFrame, vec: str = "vec", code: str = "code") -> DataFrame:
    return docs.withColumn(code, V.sign_words(vec))


def knn(docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    return top_k(meet(docs, queries).select("qid", "doc_id", V.hamming("qcode", "code").alias("score")), k, False)


def range_search(docs: DataFrame, queries: DataFrame, radius: int) -> DataFrame:
    return meet(docs, queries).select("qid", "doc_id", V.hamming("qcode", "code").alias("score")).filter(F.col("score") < radius)


def count_within(docs: DataFrame, queries: DataFrame, most: int) -> DataFrame:
    """How many documents are within ``most`` bits of each query."""
    return meet(docs, queries).groupBy("qid").agg(F.count_if(V.hamming("qcode", "code") <= most).alias("n"))


def flips(bits: int, most: int) -> list[int]:
    """All masks with at most ``most`` of ``bits`` bits set."""
    return [sum(1 << b for b in c) for n in range(most + 1) for c in combinations(range(bits), n)]


def hash_search(docs: DataFrame, queries: DataFrame, k: int, bits: int, flip: int, shift: int = 0) -> DataFrame:
    """Candidates whose ``bits`` bits from ``shift`` differ from the query's in at most ``flip``: an equi-join on the hash."""
    candidates = _hash_candidates(docs, queries, bits, flip, shift)
    return top_k(candidates.select("qid", "doc_id", V.hamming("qcode", "code").alias("score")), k, False)


def _hash_candidates(docs: DataFrame, queries: DataFrame, bits: int, flip: int, shift: int) -> DataFrame:
    def part(code: str):
        return F.call_function("shiftrightunsigned", F.get(code, F.lit(shift // 64)), F.lit(shift % 64)).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))

    masks = F.array(*[F.lit(m).cast("long") for m in flips(bits, flip)])
    asked = queries.withColumn("mask", F.explode(masks)).withColumn("h", part("qcode").bitwiseXOR(F.col("mask"))).drop("mask")
    return docs.withColumn("h", part("code")).join(asked, "h").drop("h")


def multi_hash_search(docs: DataFrame, queries: DataFrame, k: int, tables: int, bits: int, flip: int) -> DataFrame:
    """The same over several tables, each on its own bits; a candidate of several tables counts once."""
    if bits * tables > 64:
        raise ValueError("the tables' bits must lie in the first word")
    rows = None
    for t in range(tables):
        own = _hash_candidates(docs, queries, bits, flip, t * bits).select("qid", "doc_id", "qcode", "code")
        rows = own if rows is None else rows.unionByName(own)
    rows = rows.dropDuplicates(["qid", "doc_id"])
    return top_k(rows.select("qid", "doc_id", V.hamming("qcode", "code").alias("score")), k, False)


def ivf_search(docs: DataFrame, queries: DataFrame, centroids: DataFrame, k: int, nprobe: int) -> DataFrame:
    """Lists by nearest centroid (list_no, ccode) in bits; search of the ``nprobe`` nearest lists."""
    asked = centroids.select(F.col("list_no").alias("qid"), F.col("ccode").alias("qcode"))
    near = lambda rows, n: top_k(meet(rows, asked).select(F.col("doc_id"), F.col("qid").alias("list_no"), V.hamming("code", "qcode").alias("score")), n, False, "doc_id", "score", "list_no")
    lists = docs.join(near(docs, 1).select("doc_id", "list_no"), "doc_id")
    probes = near(queries.select(F.col("qid").alias("doc_id"), F.col("qcode").alias("code")), nprobe).select(F.col("doc_id").alias("qid"), "list_no")
    return top_k(lists.join(probes.join(queries, "qid"), "list_no").select("qid", "doc_id", V.hamming("qcode", "code").alias("score")), k, False)
