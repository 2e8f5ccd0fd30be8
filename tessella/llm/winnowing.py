"""Document fingerprints by winnowing, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import stage

#: A token: at most 16 characters without ASCII white space, so that text without any has tokens too.
TOKEN = "[^\\x20\\x09-\\x0D]{1,16}"
#: Modulus and base of the rolling hash; products of two residues fit a long.
MODULUS, BASE = 1_073_741_789, 48_271


def _rolling(tokens: Column, k: int) -> Column:
    """Karp-Rabin hash of every ``k`` tokens in a row (of all, if fewer), from an array of token hashes."""

    def at(x: Column, i: Column) -> Column:
        total = x
        for step in range(1, k):
            total = (total * BASE + F.get(tokens, i + step)) % MODULUS
        return total

    few = F.slice(F.array(F.aggregate(tokens, F.lit(0).cast("long"), lambda s, x: (s * BASE + x) % MODULUS)), 1, F.least(F.size(tokens), F.lit(1)))
    return F.when(F.size(tokens) >= k, F.transform(F.slice(tokens, 1, F.greatest(F.size(tokens) - (k - 1), F.lit(0))), at)).otherwise(few)


def _run(grams: Column, x: Column, i: Column, most: int, side: int) -> Column:
    """How many of the next ``most`` grams on one side are greater than ``x`` (on the left: at least ``x``) without a break."""
    out = F.lit(most)
    for step in range(most, 0, -1):
        other = F.get(grams, i + side * step)
        out = F.when(other > x if side > 0 else other >= x, out).otherwise(step - 1)
    return out


def _positions(grams: Column, window: int) -> Column:
    """Places of the grams that are the least of some window of ``window`` grams, the rightmost of equal ones.

    A gram is that iff the grams not under it to its left and those over it to its right, with itself, fill a window.
    """
    size = F.least(F.size(grams), F.lit(window))
    places = F.when(F.size(grams) > 0, F.sequence(F.lit(0), F.greatest(F.size(grams) - 1, F.lit(0)))).otherwise(F.array().cast("array<int>"))

    def chosen(i: Column) -> Column:
        x = F.get(grams, i)
        return _run(grams, x, i, window - 1, -1) + _run(grams, x, i, window - 1, 1) + 1 >= size

    return F.filter(places, chosen)


def fingerprint(df: DataFrame, text: str, out: str, k: int = 3, window: int = 5) -> DataFrame:
    """``df`` with ``{out}_positions`` (places of the chosen k-grams, counted in tokens) and ``{out}_hashes``.

    Texts are lower-cased. Any run of ``window + k - 1`` tokens that two texts share has a chosen k-gram in common; one
    shorter than ``k`` tokens is never relied on. A text of fewer than ``k`` tokens has one k-gram, all of it; null and
    blank texts have none. Each array gets a projection of its own, or every element would compute it anew.
    """
    names = df.columns
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text).cast("string"), F.lit(""))), F.lit(TOKEN), F.lit(0))
    df = df.withColumn("__tokens", F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(MODULUS).cast("long"))))
    df = df.withColumn("__grams", _rolling(F.col("__tokens"), k)).drop("__tokens")
    df = df.withColumn(f"{out}_positions", _positions(F.col("__grams"), window))
    hashes = F.transform(F.col(f"{out}_positions"), lambda i: F.get(F.col("__grams"), i).cast("int"))
    return df.withColumn(f"{out}_hashes", hashes).select(*names, f"{out}_positions", f"{out}_hashes")


def likeness(a: str, b: str) -> Column:
    """Jaccard similarity of two fingerprints' hashes; 1 if both are empty."""
    shared = F.size(F.array_intersect(a, b))
    distinct = F.size(F.array_distinct(a)) + F.size(F.array_distinct(b)) - shared
    return F.when(distinct == 0, 1.0).otherwise(shared / distinct)


def as_text(hashes: str) -> Column:
    return F.array_join(F.transform(F.col(hashes), lambda h: F.lower(F.hex(h))), " ")


def _range_of(ident: str, bounds: list[int]) -> Column:
    """Number of the range that an id is in; a range starts at each of the sorted bounds. Found by halving."""
    table = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")
    steps = F.lit([1 << k for k in reversed(range(max(len(bounds) - 1, 0).bit_length()))] or [0])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(table, at + step) <= F.col(ident), at + step).otherwise(at))


def _with_next(rows: DataFrame, carried: list[str], unique: bool) -> DataFrame:
    """Each row of a range with ``next_*``: what is ``carried`` of the row with the next larger id."""
    order = "wrapped", "doc_id", "text"
    if unique:
        window = Window.partitionBy("range").orderBy("wrapped", "doc_id")
        return rows.select("*", *[F.lead(c).over(window).alias(f"next_{c}") for c in carried])
    rows = rows.withColumn("__nth", F.row_number().over(Window.partitionBy("range", "wrapped", "doc_id").orderBy(*order)))
    heads = rows.withColumn("__head", F.col("__nth") == 1)
    window = Window.partitionBy("range", "__head").orderBy(*order)
    heads = heads.select("*", *[F.when(F.col("__head"), F.lead(c).over(window)).alias(f"__{c}") for c in carried])
    same = Window.partitionBy("range", "wrapped", "doc_id").orderBy("__nth")
    return heads.select(*rows.columns, *[F.first(f"__{c}").over(same).alias(f"next_{c}") for c in carried]).drop("__nth")


def compare_edited(docs: DataFrame, k: int = 3, window: int = 5, per_range: int = 2048, ranges: int = 65_536) -> DataFrame:
    """Each document's fingerprint beside that of its edited text and that of the next document.

    Edited text: the last floor(n/2) of the n code points replaced by the first as many of the next document's text, by
    ascending doc_id. Null text counts as empty. Of rows that repeat a doc_id the smallest text is the next document
    before it. A row without doc_id has no next document: its edited text is what is left, and it is like no next one.

    Ids are cut into ranges of about ``per_range`` (at most ``ranges`` of them; larger ranges spill). Texts move once, to
    their range; the document that starts a range is copied to the end of the range before (the first of all to the end
    of the last), so every document finds the next one in its own range.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    known = base.filter("doc_id is not null")
    ids = stage(known.groupBy("doc_id").agg(F.count("*").alias("n")))
    found = ids.agg(F.count("*").alias("ids"), F.max("n").alias("most"), F.min("doc_id").alias("least")).first()
    parts = max(1, min(ranges, -(-found.ids // per_range)))
    cuts = ids.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], max(10_000, 4 * parts))).first()[0] if parts > 1 else []
    bounds = sorted({found.least, *cuts}) if found.ids else [0]
    last = len(bounds) - 1
    own = known.withColumn("range", _range_of("doc_id", bounds))
    starts = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")
    plain, copied = F.struct("range", F.lit(0).alias("wrapped"), F.lit(False).alias("copy")), F.col("doc_id") == F.get(starts, F.col("range"))
    before = F.struct(F.when(F.col("range") == 0, last).otherwise(F.col("range") - 1).alias("range"), F.when(F.col("range") == 0, 1).otherwise(0).alias("wrapped"), F.lit(True).alias("copy"))
    rows = own.withColumn("__at", F.explode(F.when(copied, F.array(plain, before)).otherwise(F.array(plain)))).select("doc_id", "text", "__at.range", "__at.wrapped", "__at.copy")
    rows = fingerprint(rows.repartition("range"), "text", "own", k, window)
    rows = _with_next(rows, ["text", "own_hashes"], found.most in (None, 1)).filter("not copy").withColumnRenamed("next_own_hashes", "next_hashes")
    alone = fingerprint(base.filter("doc_id is null"), "text", "own", k, window).withColumn("next_text", F.lit("")).withColumn("next_hashes", F.lit(None).cast("array<int>"))
    names = ["doc_id", "text", "own_positions", "own_hashes", "next_text", "next_hashes"]
    pairs = rows.select(names).unionByName(alone.select(names)).withColumn("n_chars", F.char_length("text").cast("long"))
    pairs = pairs.withColumn("edited", F.expr("concat(left(text, cast(n_chars - n_chars div 2 as int)), left(next_text, cast(n_chars div 2 as int)))")).drop("text", "next_text")
    pairs = fingerprint(pairs, "edited", "edited", k, window)
    return pairs.withColumn("edited_sha256", F.sha2("edited", 256)).withColumn("near_edited", likeness("own_hashes", "edited_hashes")).withColumn("near_next", F.coalesce(likeness("own_hashes", "next_hashes"), F.lit(0.0))).drop("edited")
