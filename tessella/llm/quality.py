"""Quality: an interpolated modified Kneser-Ney character n-gram model of trusted text, with a threshold per language."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tessella.llm.common import code_points, discard, slices, stage

#: Characters of an n-gram are packed as numbers of so many bits; the first numbers mean start, end, any other character.
WIDTH, START, END, OTHER, FIRST = 15, 0, 1, 2, 3
#: N-grams of all orders that are sent to every worker; a larger model's stay in shards and are joined.
MOST = 4_000_000
#: Characters of average text that every document is taken to have besides its own, so a few words don't decide.
PRIOR = 64


@dataclass
class Model:
    """Per order from 1: the n-grams known and their probability; their contexts and those contexts' back-off weight. A model of
    over MOST n-grams has them in ``shards`` only: staged tables (key, p) and (context, weight) of each order."""

    number: np.ndarray
    keys: list[np.ndarray]
    probability: list[np.ndarray]
    contexts: list[np.ndarray]
    weight: list[np.ndarray]
    unseen: float
    shards: list = field(default_factory=list)
    order: int = 0
    mean: dict = field(default_factory=dict)
    threshold: dict = field(default_factory=dict)


def _likely(docs: DataFrame, ids: DataFrame, probes: int = 3, most: int = 64 << 20) -> DataFrame:
    """Rows of ``docs`` whose doc_id is among ``ids``, and some 3 % of the others: a Bloom filter of one byte an id, so that a
    join that follows need not move every text. Over ``most`` ids (counted first) are not filtered."""
    words = ids.count() // 8 + 1
    if words * 8 > most:
        return docs.filter("doc_id is not null")
    bits = F.array(*[F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.lit(i)), F.lit(64 * words)) for i in range(probes)])
    word, bit = lambda b: F.shiftright(b, 6), lambda b: b.bitwiseAND(F.lit(63)).cast("int")
    one = F.lit(1).cast("long")
    set_bits = ids.select(F.explode(bits).alias("b")).groupBy(word(F.col("b")).alias("id")).agg(F.bit_or(F.call_function("shiftleft", one, bit(F.col("b")))).alias("v"))
    dense = ids.sparkSession.range(words).join(set_bits, "id", "left").select("id", F.coalesce("v", F.lit(0)).alias("v"))
    table = dense.agg(F.transform(F.sort_array(F.collect_list(F.struct("id", "v"))), lambda x: x["v"]).alias("__words"))
    held = F.forall(bits, lambda b: F.call_function("shiftright", F.get("__words", word(b).cast("int")), bit(b)).bitwiseAND(one) == 1)
    return docs.crossJoin(F.broadcast(table)).filter(F.col("doc_id").isNotNull() & held).drop("__words")


def trusted_rows(docs: DataFrame, labels: DataFrame, most: int | None = None) -> DataFrame:
    """Texts and languages of all documents labelled good, or of the ``most`` of smallest hash; ``fitting`` marks half."""
    good = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")).filter("quality = 1")
    good = good.select("doc_id", F.xxhash64("doc_id").alias("hash"))
    if most is not None:
        good = good.orderBy("hash", "doc_id").limit(most)
    good = stage(good.select("doc_id", (F.pmod(F.shiftright("hash", 7), F.lit(2)) == 0).alias("fitting")))
    picked = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    return _likely(picked.filter("text is not null"), good).join(good.hint("merge"), "doc_id")


def _numbers(texts: pa.Array, number: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """All texts as character numbers, each with its starts before and its end behind; and the length of each text."""
    points, size = code_points(pc.fill_null(texts, "").to_pylist())
    out = np.full(len(points) + order * len(size), START, np.int64)
    owner = np.repeat(np.arange(len(size)), size)
    out[np.arange(len(points)) + (owner + 1) * (order - 1) + owner] = number[points]
    out[np.cumsum(size + order) - 1] = END
    return out, size


def _grams(texts: pa.Array, number: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The packed n-gram that ends at each character of each text (its end too), and the text of each."""
    seq, size = _numbers(texts, number, order)
    key = seq.copy()
    for back in range(1, order):
        key[back:] |= seq[:-back] << (WIDTH * back)
    owner = np.repeat(np.arange(len(size)), size + 1)
    place = np.arange(len(owner)) + (owner + 1) * (order - 1)
    return key[place], owner


def _alphabet(rows: DataFrame, most: int = (1 << WIDTH) - FIRST) -> np.ndarray:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0x110000, np.int64)
        for batch in slices(batches):
            points, _ = code_points(pc.fill_null(batch.column("text"), "").to_pylist())
            seen += np.bincount(points, minlength=0x110000)
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(seen[some])], names=["point", "n"])

    top = rows.select("text").mapInArrow(count, "point long, n long").groupBy("point").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "point").limit(most).collect()
    number = np.full(0x110000, OTHER, np.int64)
    for k, r in enumerate(top):
        number[r.point] = FIRST + k
    digits = np.arange(ord("0"), ord("9") + 1)
    number[digits] = number[digits].max()  # one class
    return number


def fit(rows: DataFrame, order: int = 4, most: int = MOST) -> Model:
    """Fit on trusted (text, lang, fitting) rows: the model on those that ``fitting`` marks.

    Counts are summed in shards by n-gram. Of every order, discounts come from its counts of counts; each context's total
    and numbers of n-grams met once, twice and more are joined to its n-grams by context, and the next lower order's
    probability by suffix. Lower orders count the characters met before an n-gram, not its occurrences. The rows kept
    out of the model give each language's mean and are scored for its threshold: see :func:`calibrate`. Up to ``most``
    n-grams and contexts (counted first) are sent to every worker; more stay in shards. Rows that repeat count each.
    """
    rows = stage(rows)
    spark = rows.sparkSession
    own = rows.filter("fitting")
    number = _alphabet(own)
    shared = spark.sparkContext.broadcast(number)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            key, n = np.unique(_grams(batch.column("text"), shared.value, order)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], names=["key", "n"])

    tables = [stage(own.select("text").mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")))]
    for n in range(order - 1, 0, -1):
        tables.insert(0, tables[0].groupBy(F.col("key").bitwiseAND((1 << (WIDTH * n)) - 1).alias("key")).agg(F.count("*").alias("n")))
    model = Model(number, [], [], [], [], 1.0, order=order)
    below = None
    for n, table in enumerate(tables, 1):
        table = table.withColumn("context", F.shiftright("key", WIDTH))
        of = table.agg(*[F.count(F.when(F.col("n") == c, 1)).alias(f"n{c}") for c in (1, 2, 3, 4)], F.count("*").alias("types")).first()
        n1, n2, n3, n4 = (max(of[f"n{c}"], 1) for c in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2)
        d1, d2, d3 = (min(max(x, 0.05), c - 0.05) for c, x in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3)))
        discount = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
        contexts = table.groupBy("context").agg(F.sum("n").alias("total"), F.sum(discount).alias("taken")).select("context", "total", (F.col("taken") / F.col("total")).alias("weight"))
        table = table.join(contexts, "context").withColumn("own", (F.col("n") - discount) / F.col("total"))
        if below is None:
            model.unseen = 1 / (of["types"] + 1)
            table = table.withColumn("p", F.col("own") + F.col("weight") * model.unseen)
        else:
            low = below.select(F.col("key").alias("suffix"), F.col("p").alias("lower"))
            table = table.withColumn("suffix", F.col("key").bitwiseAND((1 << (WIDTH * (n - 1))) - 1)).join(low, "suffix")
            table = table.withColumn("p", F.col("own") + F.col("weight") * F.col("lower"))
        below = stage(table.select("key", "p"))
        model.shards.append((below, stage(contexts.select("context", "weight"))))
    if sum(table.count() for pair in model.shards for table in pair) <= most:
        for grams, contexts in model.shards:
            got, back = grams.toArrow(), contexts.toArrow()
            model.keys.append(got.column("key").to_numpy())
            model.probability.append(got.column("p").to_numpy())
            model.contexts.append(back.column("context").to_numpy())
            model.weight.append(back.column("weight").to_numpy())
        discard(*[table for pair in model.shards for table in pair])
        model.shards = []
    discard(*tables)
    out = calibrate(rows.filter("not fitting"), model)
    discard(rows)
    return out


def _find(keys: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Place of each key in ``table``, or -1: a hash join of a batch with one shard of the model."""
    return pc.fill_null(pc.index_in(pa.array(keys), value_set=pa.array(table)), -1).to_numpy().astype(np.int64)


def probabilities(keys: np.ndarray, model: Model, order: int | None = None) -> np.ndarray:
    """Interpolated probability of each n-gram's last character after the others."""
    n = order or len(model.keys)
    at = _find(keys, model.keys[n - 1])
    out = np.where(at >= 0, model.probability[n - 1][at] if len(model.keys[n - 1]) else 0, 0.0)
    miss = np.flatnonzero(at < 0)
    if len(miss):
        rest = keys[miss]
        known = _find(rest >> WIDTH, model.contexts[n - 1])
        weight = np.where(known >= 0, model.weight[n - 1][known] if len(model.contexts[n - 1]) else 1, 1.0)
        lower = probabilities(rest & ((1 << (WIDTH * (n - 1))) - 1), model, n - 1) if n > 1 else model.unseen
        out[miss] = weight * lower
    return out


def _losses(texts: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """-log10 probability of each text, and its length with its end."""
    keys, owner = _grams(texts, model.number, len(model.keys))
    distinct = pc.dictionary_encode(pa.array(keys))
    loss = -np.log10(probabilities(distinct.dictionary.to_numpy(), model))[distinct.indices.to_numpy()]
    return np.bincount(owner, weights=loss, minlength=len(texts)), np.bincount(owner, minlength=len(texts))


def calibrate(rows: DataFrame, model: Model, quantile: float = 0.995, least: int = 20) -> Model:
    """Set each language's mean loss a character, and as threshold this quantile of its trusted documents' own losses.

    A language with fewer than ``least`` such documents (null counts as one language) takes what all together give.
    """
    parts = stage(score(rows, model).select(F.coalesce("lang", F.lit("")).alias("lang"), (-F.col("log10_prob")).alias("loss"), "n_tokens"))

    def group(by: list[str]) -> None:
        means = parts.groupBy(by).agg(F.count("*").alias("rows"), (F.sum("loss") / F.sum("n_tokens")).alias("mean"))
        if by:
            means = means.filter(F.col("rows") >= least)
        own = parts.join(F.broadcast(means), by) if by else parts.crossJoin(F.broadcast(means))
        own = own.withColumn("own", (F.col("loss") + PRIOR * F.col("mean")) / (F.col("n_tokens") + PRIOR))
        for r in own.groupBy(by).agg(F.first("mean").alias("mean"), F.percentile("own", F.lit(quantile)).alias("threshold")).collect():
            if r["mean"] is not None:
                model.mean[r["lang"] if by else None] = r["mean"]
                model.threshold[r["lang"] if by else None] = r["threshold"]

    group([])
    group(["lang"])
    discard(parts)
    return model


SCORES = "doc_id long, lang string, n_tokens long, log10_prob double, perplexity double, loss double, threshold double, keep boolean"


def _judge(langs: list, loss: np.ndarray, n: np.ndarray, model: Model) -> dict:
    names = [(lang or "") if (lang or "") in model.mean else None for lang in langs]
    mean = np.array([model.mean.get(x, 0.0) for x in names])
    threshold = np.array([model.threshold.get(x, np.inf) for x in names])
    own = (loss + PRIOR * mean) / (n + PRIOR)
    return {"n_tokens": n, "log10_prob": -loss, "perplexity": 10 ** (loss / n), "loss": own, "threshold": threshold, "keep": own <= threshold}


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Per-character perplexity of every whole text and whether its language's threshold keeps it.

    ``loss`` is the mean -log10 probability of a character, with PRIOR characters of the language's average added. Null
    counts as empty text (a lone end, kept). Without trusted text there is no threshold and everything is kept.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    if model.shards:
        joined = joined_losses(rows.withColumn("row", F.monotonically_increasing_id()), model)
        return _judged(joined.select("doc_id", "lang", "loss", "n_tokens"), model, SCORES, lambda got, batch: [batch.column("doc_id"), batch.column("lang"), *map(pa.array, got.values())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in slices(batches):
            loss, n = _losses(batch.column("text"), m) if m.keys else (np.zeros(batch.num_rows), np.ones(batch.num_rows, np.int64))
            got = _judge(batch.column("lang").to_pylist(), loss, n, m)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), *map(pa.array, got.values())], names=["doc_id", "lang", *got])

    return rows.mapInArrow(run, SCORES)


def joined_losses(rows: DataFrame, model: Model) -> DataFrame:
    """``rows`` (``row``, ``text`` and others) with ``loss`` (-log10 probability) and ``n_tokens``, by joins with a model in shards.

    Each text's distinct n-grams, counted, meet the highest order; what is not known there goes on to the next order as
    its suffix, with its context's weight. Hot n-grams are salted by nothing more than their text: a known one is one row
    of the model, so its side of the join is split by Spark where it is skewed.
    """
    shared = rows.sparkSession.sparkContext.broadcast(model.number)
    order = model.order

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            key, owner = _grams(batch.column("text"), shared.value, order)
            for i in range(batch.num_rows):
                own, n = np.unique(key[owner == i] if batch.num_rows > 1 else key, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), batch.column("row")[i].as_py())), pa.array(own), pa.array(n)], names=["row", "key", "n"])

    left = rows.select("row", "text").mapInArrow(grams, "row long, key long, n long").withColumn("weight", F.lit(1.0))
    done = None
    for n in range(order, 0, -1):
        known, contexts = model.shards[n - 1]
        met = left.join(known, "key", "left")
        found = met.filter("p is not null").select("row", "n", (F.col("weight") * F.col("p")).alias("p"))
        done = found if done is None else done.unionByName(found)
        rest = met.filter("p is null").drop("p").withColumn("context", F.shiftright("key", WIDTH))
        rest = rest.join(contexts.withColumnRenamed("weight", "more"), "context", "left").withColumn("weight", F.col("weight") * F.coalesce("more", F.lit(1.0)))
        left = rest.select("row", F.col("key").bitwiseAND((1 << (WIDTH * (n - 1))) - 1).alias("key"), "n", "weight")
    done = done.unionByName(left.select("row", "n", (F.col("weight") * model.unseen).alias("p")))
    sums = done.groupBy("row").agg(F.sum(-F.log10("p") * F.col("n")).alias("loss"), F.sum("n").alias("n_tokens"))
    return rows.join(sums, "row").drop("row")


def _judged(rows: DataFrame, model: Model, schema, out) -> DataFrame:
    """Rows with ``lang``, ``loss`` and ``n_tokens`` held against the thresholds, in the form that ``out`` gives."""
    facts = Model(np.empty(0), [], [], [], [], 1.0, mean=model.mean, threshold=model.threshold)
    shared = rows.sparkSession.sparkContext.broadcast(facts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = _judge(batch.column("lang").to_pylist(), batch.column("loss").to_numpy(), batch.column("n_tokens").to_numpy(), shared.value)
            made = out(got, batch)
            yield made if isinstance(made, pa.RecordBatch) else pa.RecordBatch.from_arrays(made, names=["doc_id", "lang", *got])

    return rows.mapInArrow(run, schema)


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """Rows of ``docs`` (all columns) that the thresholds keep; the texts aren't moved unless the model is in shards. Nulls and
    repeated rows are as in :func:`score`."""
    if model.shards:
        whole = F.struct(*docs.columns).alias("whole")
        rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), whole)
        kept = StructType([StructField("whole", docs.schema)])
        joined = joined_losses(rows, model).select("whole", "lang", "loss", "n_tokens")
        return _judged(joined, model, kept, lambda got, batch: batch.select(["whole"]).filter(pa.array(got["keep"]))).select("whole.*")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in slices(batches):
            loss, n = _losses(batch.column("text"), m) if m.keys else (np.zeros(batch.num_rows), np.ones(batch.num_rows, np.int64))
            yield batch.filter(pa.array(_judge(batch.column("lang").to_pylist(), loss, n, m)["keep"]))

    return docs.mapInArrow(run, docs.schema)
