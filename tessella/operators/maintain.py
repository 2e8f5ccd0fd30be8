"""Changing an index: tables go in, tables come out; writing them back is the caller's."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.search import build_lists


def add(lists: DataFrame, new_docs: DataFrame, centroids: DataFrame, metric: str = "inner_product") -> DataFrame:
    return lists.unionByName(build_lists(new_docs, centroids, metric).select(lists.columns))


def remove(lists: DataFrame, ids: DataFrame) -> DataFrame:
    return lists.join(ids.select("doc_id"), "doc_id", "left_anti").select(lists.columns)


def update(lists: DataFrame, new_docs: DataFrame, centroids: DataFrame, metric: str = "inner_product") -> DataFrame:
    """Documents replaced by id and assigned anew; ids not there before are added."""
    return add(remove(lists, new_docs), new_docs, centroids, metric)


def merge(a: DataFrame, b: DataFrame, shift: int = 0) -> DataFrame:
    """Two indexes with the same centroids as one, ``b``'s ids moved up by ``shift``."""
    return a.unionByName(b.withColumn("doc_id", F.col("doc_id") + shift))


def concatenate(*shards: DataFrame) -> DataFrame:
    """Shards with successive ids: each one's start where the one before ends."""
    out, base = None, 0
    for s in shards:
        own = s.withColumn("doc_id", F.col("doc_id") + base)
        base += s.agg(F.coalesce(F.max("doc_id") + 1, F.lit(0))).first()[0]
        out = own if out is None else out.unionByName(own)
    return out


def subset_by_range(lists: DataFrame, low: int, high: int) -> DataFrame:
    return lists.filter((F.col("doc_id") >= low) & (F.col("doc_id") < high))


def subset_by_modulo(lists: DataFrame, divisor: int, remainder: int) -> DataFrame:
    return lists.filter(F.pmod("doc_id", F.lit(divisor)) == remainder)


def subset_by_fraction(lists: DataFrame, low: float, high: float) -> DataFrame:
    """Of each list the stretch between two fractions of its length."""
    each = Window.partitionBy("list_no")
    at, n = F.row_number().over(each.orderBy("doc_id")) - 1, F.count("*").over(each)
    return lists.withColumn("__at", at).withColumn("__n", n).filter((F.col("__at") >= F.floor(F.col("__n") * low)) & (F.col("__at") < F.floor(F.col("__n") * high))).drop("__at", "__n")


def list_range(lists: DataFrame, first: int, last: int) -> DataFrame:
    return lists.filter((F.col("list_no") >= first) & (F.col("list_no") < last))


def stack_lists(*tables: DataFrame, per_table: int) -> DataFrame:
    """Lists of several tables one behind the other: list i of table t becomes list t·per_table + i."""
    out = None
    for t, table in enumerate(tables):
        own = table.withColumn("list_no", F.col("list_no") + t * per_table)
        out = own if out is None else out.unionByName(own)
    return out


def masked_lists(first: DataFrame, second: DataFrame) -> DataFrame:
    """The first table's list where it has entries, else the second's."""
    return first.unionByName(second.join(first.select("list_no").distinct(), "list_no", "left_anti").select(first.columns))


def stop_lists(lists: DataFrame, most: int) -> DataFrame:
    """Only lists of fewer than ``most`` entries."""
    small = lists.groupBy("list_no").count().filter(F.col("count") < most).select("list_no")
    return lists.join(small, "list_no", "left_semi").select(lists.columns)


def by_size(lists: DataFrame) -> DataFrame:
    """Lists numbered anew from the largest (ties: the smaller number first)."""
    sizes = lists.groupBy("list_no").agg(F.count("*").alias("n"))
    numbers = sizes.withColumn("new_no", F.row_number().over(Window.orderBy(F.desc("n"), "list_no")) - 1).select("list_no", "new_no")
    return lists.join(numbers, "list_no").withColumn("list_no", F.col("new_no")).select(lists.columns)


def renumber(lists: DataFrame, order: DataFrame) -> DataFrame:
    """Lists under new numbers by (list_no, new_no)."""
    return lists.join(order, "list_no").withColumn("list_no", F.col("new_no")).select(lists.columns)


def shard(centroids: DataFrame, n: int, of=None) -> DataFrame:
    """Centroids with the shard each belongs to: list number modulo ``n``, or what ``of`` (a Column function) says."""
    number = F.col("list_no")
    return centroids.withColumn("shard", F.pmod(number, F.lit(n)) if of is None else of(number))


def block(docs: DataFrame, count: int, rank: int) -> DataFrame:
    """Part ``rank`` of ``count`` of a table."""
    return docs.filter(F.pmod("doc_id", F.lit(count)) == rank)


def window(slices: DataFrame, newest: int, kept: int) -> DataFrame:
    """The ``kept`` newest slices of a FIFO window, by ``slice_id``."""
    return slices.filter((F.col("slice_id") <= newest) & (F.col("slice_id") > newest - kept))


def first_seen(rows: DataFrame, code: str = "code", order: str = "doc_id") -> DataFrame:
    """Whether each row is the first with its code."""
    first = rows.groupBy(code).agg(F.min(order).alias("__first"))
    return rows.join(first, code).withColumn("inserted", F.col(order) == F.col("__first")).drop("__first")


def set_operation(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    """Distinct ids in both, either, only the first, or exactly one."""
    a, b = a.select("doc_id").distinct(), b.select("doc_id").distinct()
    if how == "symmetric":
        return a.exceptAll(b).unionByName(b.exceptAll(a))
    return {"intersect": a.intersect, "union": lambda o: a.union(o).distinct(), "except": a.exceptAll}[how](b)


def list_sizes(lists: DataFrame) -> DataFrame:
    return lists.groupBy("list_no").agg(F.count("*").alias("n"))


def get_list(lists: DataFrame, number: int) -> DataFrame:
    return lists.filter(F.col("list_no") == number)


def cluster_major(lists: DataFrame) -> DataFrame:
    """Each document's position when lists follow one another, ascending ids inside a list."""
    sizes = list_sizes(lists)
    before = F.coalesce(F.sum("n").over(Window.orderBy("list_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.withColumn("start", before).select("list_no", "start")
    inside = F.row_number().over(Window.partitionBy("list_no").orderBy("doc_id")) - 1
    return lists.select("doc_id", "list_no").withColumn("inside", inside).join(starts, "list_no").select("doc_id", "list_no", (F.col("start") + F.col("inside")).alias("position"))


def replace_quantiser(lists: DataFrame, centroids: DataFrame, metric: str = "inner_product") -> DataFrame:
    """The same documents in the lists of other centroids."""
    return build_lists(lists.drop("list_no"), centroids, metric).select(lists.columns)


def direct_map(lists: DataFrame) -> DataFrame:
    """Where each document is: its list and its place in it, by ascending id."""
    place = F.row_number().over(Window.partitionBy("list_no").orderBy("doc_id")) - 1
    return lists.select("doc_id", "list_no", place.alias("place"))


def inspect(lists: DataFrame) -> DataFrame:
    """Number of documents, of lists with any, and of the documents in the smallest and largest of these."""
    return list_sizes(lists).agg(F.sum("n").alias("documents"), F.count("*").alias("lists"), F.min("n").alias("least"), F.max("n").alias("most"))
