"""Predicates: which documents each query may see, as relations (qid, doc_id), as bitmaps and as selectors."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def doc_terms(docs: DataFrame, terms: str = "terms") -> DataFrame:
    """Distinct (doc_id, term): the postings of a categorical index. A document without terms has none."""
    return docs.select("doc_id", F.explode(terms).alias("term")).distinct()


def posting_stats(postings: DataFrame, n_docs: int, threshold: int | None = None) -> DataFrame:
    """Size of each term's posting list, and whether it is dense: by default from a quarter of a bitmap's bytes."""
    least = max(1, -(-(-(-n_docs // 8)) // 4)) if threshold is None else threshold
    return postings.groupBy("term").agg(F.count("*").alias("n")).withColumn("dense", F.col("n") >= least)


def equality(docs: DataFrame, preds: DataFrame, attr: str = "attr") -> DataFrame:
    """Documents whose attribute equals the predicate's ``eq``; an unknown value has none."""
    return preds.select("qid", F.col("eq").alias("__eq")).join(docs.select("doc_id", F.col(attr).alias("__eq")), "__eq").select("qid", "doc_id")


def conjunction(postings: DataFrame, preds: DataFrame) -> DataFrame:
    """Documents that have all of the predicate's ``terms`` (repeats count once; none given: no document).

    A query's rarest term comes first: only its documents are looked up for the other terms.
    """
    wanted = preds.select("qid", F.explode(F.array_distinct("terms")).alias("term"))
    sizes = postings.groupBy("term").agg(F.count("*").alias("n"))
    order = Window.partitionBy("qid").orderBy(F.coalesce("n", F.lit(0)), "term")
    wanted = wanted.join(sizes, "term", "left").withColumn("nth", F.row_number().over(order))
    rarest = wanted.filter("nth = 1").join(postings, "term").select("qid", "doc_id")
    others = wanted.filter("nth > 1").select("qid", "term")
    need = wanted.groupBy("qid").agg(F.count("*").alias("need"))
    met = rarest.join(others, "qid").join(postings, ["doc_id", "term"]).groupBy("qid", "doc_id").agg(F.count("*").alias("met"))
    return rarest.join(need, "qid").join(met, ["qid", "doc_id"], "left").filter(F.coalesce("met", F.lit(0)) + 1 == F.col("need")).select("qid", "doc_id")


def ranges(docs: DataFrame, preds: DataFrame, attr: str = "attr") -> DataFrame:
    """Documents with ``lo <= attr < hi``, by an equi-join on cells, not a loop.

    A predicate goes into two cells, or one, of the least power of two that is not narrower than it, so cells are as
    narrow as each predicate allows and a wide one makes no other's cell wide. Documents go into one cell of each width
    that some predicate has.
    """
    spans = preds.filter("lo < hi").withColumn("__level", F.ceil(F.log2((F.col("hi") - F.col("lo")).cast("double"))).cast("int"))
    levels = sorted(r["__level"] for r in spans.select("__level").distinct().collect())
    cell = lambda x: F.floor(F.col(x) / F.pow(F.lit(2.0), F.col("__level")))
    spread = spans.select("qid", "lo", "hi", "__level", F.explode(F.sequence(cell("lo"), cell("hi"))).alias("__cell"))
    placed = docs.select("doc_id", F.col(attr).alias("__x"), F.explode(F.array(*map(F.lit, levels)) if levels else F.array().cast("array<int>")).alias("__level"))
    placed = placed.withColumn("__cell", cell("__x"))
    return spread.join(placed, ["__level", "__cell"]).filter("__x >= lo and __x < hi").select("qid", "doc_id")


def check_ranges(preds: DataFrame) -> DataFrame:
    """``preds``, failing on a range that is empty or backwards."""
    return preds.withColumn("lo", F.when(F.col("lo") < F.col("hi"), F.col("lo")).otherwise(F.raise_error(F.lit("lo must be below hi")).cast("double")))


def evaluate(docs: DataFrame, postings: DataFrame, preds: DataFrame, attr: str = "attr") -> DataFrame:
    """A mixed workload: each predicate by its ``op`` (equality, range, conjunction), one relation for all.

    A conjunction of one term is a lookup in the postings.
    """
    single = preds.filter("op = 'conjunction' and size(array_distinct(terms)) = 1").select("qid", F.get("terms", F.lit(0)).alias("term"))
    several = preds.filter("op = 'conjunction' and size(array_distinct(terms)) > 1")
    parts = equality(docs, preds.filter("op = 'equality'"), attr), ranges(docs, preds.filter("op = 'range'"), attr), single.join(postings, "term").select("qid", "doc_id"), conjunction(postings, several)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def slice_queries(table: DataFrame, start: int, count: int, total: int | None = None) -> DataFrame:
    """Queries start..start+count-1; asking past the end is an error, not a shorter answer."""
    if total is not None and (start < 0 or count < 0 or start + count > total):
        raise ValueError(f"queries {start}..{start + count} asked of {total}")
    return table.filter((F.col("qid") >= start) & (F.col("qid") < start + count))


def first_difference(legal: DataFrame, oracle: DataFrame) -> DataFrame:
    """The first query whose allowed documents differ between two relations (null: none does)."""
    a, b = legal.select("qid", "doc_id").distinct(), oracle.select("qid", "doc_id").distinct()
    return a.exceptAll(b).unionByName(b.exceptAll(a)).agg(F.min("qid").alias("qid"))


# Bitmaps: (qid, bucket, bits), one row for each 32,768 ids that hold any.


def to_bitmaps(legal: DataFrame) -> DataFrame:
    return legal.groupBy("qid", F.expr("bitmap_bucket_number(doc_id)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(doc_id))").alias("bits"))


def union_bitmaps(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).groupBy("qid", "bucket").agg(F.expr("bitmap_or_agg(bits)").alias("bits"))


def intersect_bitmaps(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.withColumn("__n", F.lit(1)).unionByName(b.withColumn("__n", F.lit(2))).groupBy("qid", "bucket").agg(F.expr("bitmap_and_agg(bits)").alias("bits"), F.sum("__n").alias("n")).filter("n = 3").drop("n")


def bitmap_sizes(bitmaps: DataFrame) -> DataFrame:
    return bitmaps.groupBy("qid").agg(F.sum(F.expr("bitmap_count(bits)")).alias("n"))


def from_bitmaps(bitmaps: DataFrame) -> DataFrame:
    """The relation again: ids of the set bits."""
    places = F.sequence(F.lit(0), F.length("bits") * 8 - 1)
    octet = lambda i: F.conv(F.hex(F.substring("bits", (i / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    present = F.filter(places, lambda i: F.call_function("shiftright", octet(i), i % 8).bitwiseAND(F.lit(1)) == 1)
    ident = F.when(F.col("bucket") > 0, (F.col("bucket") - 1) * 32768 + F.col("i") + 1).otherwise(F.col("bucket") * 32768 - F.col("i"))
    return bitmaps.select("qid", "bucket", F.explode(present).alias("i")).select("qid", ident.cast("long").alias("doc_id"))


def transpose(legal: DataFrame) -> DataFrame:
    """The queries that may see each document: (doc_id, qids), ascending. As long as the relation, so for stated query sets."""
    return legal.groupBy("doc_id").agg(F.array_sort(F.collect_set("qid")).alias("qids"))


def filter_postings(postings: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """Each query's documents of a term list (qid, term, doc_id) that its bitmap holds."""
    return postings.join(from_bitmaps(bitmaps), ["qid", "doc_id"], "left_semi")


def to_byte_masks(legal: DataFrame, size: int = 1024) -> DataFrame:
    """(qid, bucket, mask): for each ``size`` ids in a row that hold any, a byte an id, 1 if the query may see it."""
    placed = legal.select("qid", F.floor(F.col("doc_id") / size).cast("long").alias("bucket"), F.pmod("doc_id", F.lit(size)).cast("int").alias("at")).distinct()
    held = placed.groupBy("qid", "bucket").agg(F.array_sort(F.collect_set("at")).alias("at"))
    # the zeros before each one, and those behind the last
    gaps = F.transform("at", lambda x, i: F.concat(F.repeat(F.lit("00"), x - 1 - F.when(i > 0, F.get("at", i - 1)).otherwise(-1)), F.lit("01")))
    text = F.concat(F.array_join(gaps, ""), F.repeat(F.lit("00"), size - 1 - F.element_at("at", -1)))
    return held.select("qid", "bucket", F.unhex(text).alias("mask"))


def from_byte_masks(masks: DataFrame, size: int = 1024) -> DataFrame:
    ones = F.filter(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.hex(F.substring("mask", i + 1, F.lit(1))) == "01")
    return masks.select("qid", "bucket", F.explode(ones).alias("i")).select("qid", (F.col("bucket") * size + F.col("i")).alias("doc_id"))


def to_masks(legal: DataFrame, form: str = "bits") -> DataFrame:
    """Masks in the form that a consumer reads: packed ``bits`` or ``bytes``."""
    if form not in ("bits", "bytes"):
        raise ValueError(f"unknown form {form!r}")
    return to_bitmaps(legal) if form == "bits" else to_byte_masks(legal)


def range_index(docs: DataFrame, attr: str = "attr") -> DataFrame:
    """(place, doc_id, attr) in order of the attribute, then id: what a range lookup needs."""
    from tessella.operators.topk import argsort

    return argsort(docs.select("doc_id", attr), attr, "doc_id")


def reorder(legal: DataFrame, order: DataFrame) -> DataFrame:
    """Masks under new numbers: ``order`` maps doc_id to position."""
    return legal.join(order.select("doc_id", "position"), "doc_id").select("qid", F.col("position").alias("doc_id"))


# Selectors


@dataclass(frozen=True)
class Selector:
    """A condition on an id column. Combine with ``&``, ``|``, ``^`` and ``~``."""

    test: object

    def on(self, ident: str | Column = "doc_id") -> Column:
        return self.test(F.col(ident) if isinstance(ident, str) else ident)

    def __and__(self, other: Selector) -> Selector:
        return Selector(lambda c: self.on(c) & other.on(c))

    def __or__(self, other: Selector) -> Selector:
        return Selector(lambda c: self.on(c) | other.on(c))

    def __xor__(self, other: Selector) -> Selector:
        return Selector(lambda c: self.on(c) != other.on(c))

    def __invert__(self) -> Selector:
        return Selector(lambda c: ~self.on(c))


@dataclass(frozen=True)
class Selector2D:
    """A condition on (query, document). ``&`` also takes a :class:`Selector`, which then holds for every query. ``member``:
    the Python test that it is, if it is one."""

    test: object
    member: object = None

    def on(self, qid: str | Column = "qid", ident: str | Column = "doc_id") -> Column:
        return self.test(*(F.col(c) if isinstance(c, str) else c for c in (qid, ident)))

    def __and__(self, other: Selector2D | Selector) -> Selector2D:
        if isinstance(other, Selector):
            return Selector2D(lambda q, c: self.on(q, c) & other.on(c))
        return Selector2D(lambda q, c: self.on(q, c) & other.on(q, c))

    def for_query(self, qid: int) -> Selector:
        """The selector on documents that one query has."""
        return Selector(lambda c: self.on(F.lit(qid), c))


def pairs_where(test) -> Selector2D:
    """From a function of two Columns."""
    return Selector2D(test)


def pairs_callback(member) -> Selector2D:
    """A Python test of (query, document), run on whole Arrow batches, or by :func:`search.knn` (``among``) on as many pairs as it needs."""

    @F.pandas_udf("boolean")
    def test(qids, ids):
        import pandas as pd

        return pd.Series([bool(member(int(q), int(i))) for q, i in zip(qids, ids)])

    return Selector2D(lambda q, c: test(q, c), member)


def only_pairs(rows: DataFrame, legal: DataFrame) -> DataFrame:
    """Rows (qid, doc_id, ...) that the hashed relation ``legal`` allows."""
    return rows.join(legal.select("qid", "doc_id").distinct(), ["qid", "doc_id"], "left_semi")


def only_in_bitmaps(rows: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """Rows (qid, doc_id, ...) whose bit is set in their query's bitmap."""
    at = rows.withColumn("bucket", F.expr("bitmap_bucket_number(doc_id)")).withColumn("__bit", F.expr("bitmap_bit_position(doc_id)"))
    octet = F.conv(F.hex(F.substring("bits", (F.col("__bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    held = F.call_function("getbit", octet, (F.col("__bit") % 8).cast("int")) == 1
    return at.join(bitmaps, ["qid", "bucket"]).filter(held).select(rows.columns)


def everything() -> Selector:
    return Selector(lambda c: F.lit(True))


def id_range(low: int, high: int) -> Selector:
    """low <= id < high."""
    return Selector(lambda c: (c >= low) & (c < high))


def id_list(ids: list[int]) -> Selector:
    """Membership in a short list; for long ones join with :func:`only`."""
    return Selector(lambda c: c.isin([int(i) for i in ids]))


def id_bitmap(bits: bytes) -> Selector:
    """Bit ``id`` of the bytes, lowest first; an id past the end is out."""
    words = [int.from_bytes(bits[a : a + 8].ljust(8, b"\0"), "little", signed=True) for a in range(0, len(bits), 8)]
    table = F.array(*[F.lit(w).cast("long") for w in words]) if words else F.array().cast("array<bigint>")
    inside = lambda c: (c >= 0) & (c < len(bits) * 8)
    return Selector(lambda c: F.when(inside(c), F.call_function("getbit", F.get(table, (c / 64).cast("int")), (c % 64).cast("int")) == 1).otherwise(False))


def callback(member) -> Selector:
    """A Python test of an id, run on whole Arrow batches."""

    @F.pandas_udf("boolean")
    def test(ids):
        return ids.map(lambda i: bool(member(int(i))))

    return Selector(lambda c: test(c))


def only(rows: DataFrame, ids: DataFrame, ident: str = "doc_id") -> DataFrame:
    return rows.join(ids.select(ident).distinct(), ident, "left_semi")


def without(rows: DataFrame, ids: DataFrame, ident: str = "doc_id") -> DataFrame:
    return rows.join(ids.select(ident).distinct(), ident, "left_anti")


def translated(rows: DataFrame, id_map: DataFrame, selector: Selector) -> DataFrame:
    """Rows whose external id (by ``id_map``: doc_id, external) the selector admits."""
    return rows.join(id_map, "doc_id").filter(selector.on("external")).drop("external")


# Workloads. The generators of other systems can't be repeated bit by bit in SQL; these have the same distribution.


def equality_workload(queries: DataFrame, values: int, seed: int = 42) -> DataFrame:
    return queries.select("qid", F.lit("equality").alias("op"), F.pmod(F.xxhash64("qid", F.lit(seed)), F.lit(values)).alias("eq"))


def range_workload(queries: DataFrame, width: int, top: int = 1000, seed: int = 42) -> DataFrame:
    low = F.pmod(F.xxhash64("qid", F.lit(seed)), F.lit(top - width + 1))
    return queries.select("qid", F.lit("range").alias("op"), low.alias("lo"), (low + width).alias("hi"))


def keyword_terms(docs: DataFrame, ranking: str = "ranking", first: int = 3) -> DataFrame:
    """Each document's first and last keywords of its ranked list as terms, the last ones with the side ``bottom``."""
    top = docs.select("doc_id", F.explode(F.slice(ranking, 1, first)).alias("term"), F.lit("top").alias("side"))
    return top.unionByName(docs.select("doc_id", F.explode(F.slice(ranking, -first, first)).alias("term"), F.lit("bottom").alias("side"))).distinct()


def keyword_workload(queries: DataFrame, keywords: DataFrame, mode: str = "positive") -> DataFrame:
    """Documents for each query's keyword (qid, term): in their top (positive), their bottom (negative) or, by turns, the
    top for even queries and the bottom for odd ones (alternating)."""
    side = {"positive": F.lit("top"), "negative": F.lit("bottom"), "alternating": F.when(F.col("qid") % 2 == 0, "top").otherwise("bottom")}[mode]
    return queries.withColumn("side", side).join(keywords, ["term", "side"]).select("qid", "doc_id").distinct()
