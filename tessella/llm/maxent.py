"""Language-model scoring: a hashed maximum-entropy model with n-gram and skip features and a class-factored softmax."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import slices, stage, starts_of, tokens

#: A unit has three digits to this base: its class, its class within that, and its place. The softmax is factored so.
DIGIT = 16
#: Units. The first TOP are the text's end and the most frequent words; the others are buckets of all other words, by hash.
UNITS, TOP = DIGIT**3, DIGIT**3 // 2
#: Rows of the three digits' features: one without context for each prefix of digits, and hashed ones (bits).
PREFIXES, BITS = (1, DIGIT, DIGIT**2), (17, 18, 19)
#: Rows that travel together.
PIECE = 4096
SIZES = tuple(-(-(p + (1 << b)) // PIECE) * PIECE for p, b in zip(PREFIXES, BITS))
STARTS = (0, SIZES[0], SIZES[0] + SIZES[1])
#: Tokens of one gradient update, its step, and what each row's sum of squared slopes starts from.
BATCH, STEP, PRIOR = 8192, 0.15, 0.1
#: Tokens of a row in an update that are added one by one.
FEW = 8
#: Bytes of text whose words are looked up together, and that one worker learns from between two averages.
BLOCK, SHARD = 8 << 20, 96 << 20
#: Words whose counts every worker has; those of all others are joined.
COMMON = 1 << 16
#: What the context has before the text; hash of the end.
_NONE, _END = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
#: XXH64's.
_PRIMES = tuple(np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
_ODD = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))


@dataclass
class Model:
    """``tables`` hold a row of DIGIT weights for each feature of each digit; ``words`` are the common ones, ``counts`` how often
    each occurs; ``mass`` is the smoothed count of each bucket's words, one unknown word included."""

    words: pa.Array
    counts: np.ndarray
    tables: list[np.ndarray]
    mass: np.ndarray
    tokens: int
    distinct: int
    ends: int


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def hashes(words: pa.Array) -> np.ndarray:
    """XXH64 (seed 42) of each word: of those under 32 bytes all at once, in arrays; of longer ones one by one."""
    raw = pc.cast(words, pa.binary())
    offsets = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1].astype(np.int64) if len(raw) else np.zeros(1, np.int64)
    data = np.frombuffer((raw.buffers()[2] or b"") if len(raw) else b"", np.uint8)[offsets[0] : offsets[-1]]
    at, size = offsets[:-1] - offsets[0], np.diff(offsets)
    # bytes from each place on as one number
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    h = size.astype(np.uint64) + (np.uint64(42) + _PRIMES[4])
    for k in range(0, 24, 8):
        own = np.flatnonzero((size >= k + 8) & (size < 32))
        if len(own):
            lane = _turn(eight[at[own] + k] * _PRIMES[1], 31) * _PRIMES[0]
            h[own] = _turn(h[own] ^ lane, 27) * _PRIMES[0] + _PRIMES[3]
    done = size & ~7
    own = np.flatnonzero((size & 4 > 0) & (size < 32))
    h[own] = _turn(h[own] ^ ((eight[at[own] + done[own]] & np.uint64(0xFFFFFFFF)) * _PRIMES[0]), 23) * _PRIMES[1] + _PRIMES[2]
    done = size & ~3
    for k in range(3):
        own = np.flatnonzero((size & 3 > k) & (size < 32))
        h[own] = _turn(h[own] ^ (data[at[own] + done[own] + k].astype(np.uint64) * _PRIMES[4]), 11) * _PRIMES[0]
    for by, prime in ((33, _PRIMES[1]), (29, _PRIMES[2])):
        h = (h ^ (h >> np.uint64(by))) * prime
    h ^= h >> np.uint64(32)
    long = np.flatnonzero(size >= 32)
    if len(long):
        from xxhash import xxh64_intdigest

        h[long] = [xxh64_intdigest(w, 42) for w in raw.take(pa.array(long)).to_pylist()]
    return h


def buckets(h: np.ndarray) -> np.ndarray:
    """The unit that a word outside the most frequent ones is in."""
    return TOP + (h >> np.uint64(40)).astype(np.int64) % (UNITS - TOP)


def units_of(h: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Units of words by hash and place among the common ones (-1: not one of them)."""
    return np.where((place >= 0) & (place < TOP - 1), place + 1, buckets(h))


def sequence(values: np.ndarray, counts: np.ndarray, end) -> np.ndarray:
    """Values of all texts' words with ``end`` behind each text."""
    return np.insert(values, starts_of(counts)[1:], end)


def contexts(h: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    """Hashed contexts of each token: the word before, the one before that alone (a skip), both together."""
    place = np.arange(len(h)) - np.repeat(starts_of(counts + 1)[:-1], counts + 1)
    before = []
    for back in (1, 2):
        own = np.full(len(h), _NONE)
        own[back:] = h[:-back]
        own[place < back] = _NONE
        before.append(own)
    a, b = before
    out = []
    for k, x in enumerate((a, b, a * _ODD[0] + (b ^ (b >> np.uint64(31))))):
        x = (x ^ np.uint64(k + 1)) * _ODD[k]
        out.append(x ^ (x >> np.uint64(29)))
    return out


def digits_of(unit: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The three digits of each unit, and the prefix that each is chosen after."""
    return [unit // DIGIT**2, unit // DIGIT % DIGIT, unit % DIGIT], [np.zeros(len(unit), np.int64), unit // DIGIT**2, unit // DIGIT]


def feature_rows(ctx: list[np.ndarray], prefix: np.ndarray, digit: int) -> list[np.ndarray]:
    """Rows of a digit's active features: the prefix alone, and each context with it."""
    salt = (prefix.astype(np.uint64) + np.uint64(UNITS * (digit + 1))) * _ODD[1]
    out = [prefix]
    for x in ctx:
        out.append(PREFIXES[digit] + (((x ^ salt) * _ODD[2]) >> np.uint64(64 - BITS[digit])).astype(np.int64))
    return out


def _row_sums(x: np.ndarray) -> np.ndarray:
    """Sums of rows of a few numbers: as a product several times as fast."""
    return x @ np.ones(x.shape[1], x.dtype)


def _logits(table: np.ndarray, rows: list[np.ndarray] | np.ndarray) -> np.ndarray:
    total = table.take(rows[0], axis=0)  # several times as fast as an index
    for own in rows[1:]:
        total += table.take(own, axis=0)
    return np.minimum(total, 60, out=total)


def _put(table: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    """``table[rows] = values``, each row copied as one item."""
    whole = f"V{table.itemsize * table.shape[1]}"
    table.view(whole).ravel()[rows] = values.view(whole).ravel()


def _slopes(e: np.ndarray, token: np.ndarray, cuts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Sums of the tokens' ``e`` by row, whose ``size`` tokens are at ``cuts``: most rows have few, and all rows' first ones are
    added at once, then the second ones; only of rows with more than FEW are the tokens brought together."""
    out = e.take(token.take(cuts), axis=0)
    more = np.flatnonzero(size > 1)
    n = size.take(more)
    some, often = more[n <= FEW], more[n > FEW]
    if len(some):
        bits = len(size).bit_length()
        some = np.sort((size.take(some) << bits) + some)[::-1]  # rows with most tokens first
        many, some = some >> bits, some & ((1 << bits) - 1)
        start, total = cuts.take(some), out.take(some, axis=0)
        for k in range(1, int(many[0])):
            left = int(np.count_nonzero(many > k))
            total[:left] += e.take(token.take(start[:left] + k), axis=0)
        _put(out, some, total)
    if len(often):
        n = size.take(often)
        starts = starts_of(n)[:-1]
        within = np.arange(int(n.sum())) + np.repeat(cuts.take(often) - starts, n)
        out[often] = np.add.reduceat(e.take(token.take(within), axis=0), starts, axis=0)
    return out


def _descend(table: np.ndarray, square: np.ndarray, seen: np.ndarray, rows: list[np.ndarray], target: np.ndarray) -> None:
    """One update of the rows that are active, each with its own step length (AdaGrad), from these tokens' gradient."""
    n = len(target)
    # rows and their tokens as one number: several times as fast to sort as by an index
    bits = n.bit_length()
    wide = bits + len(rows).bit_length()
    keys = np.concatenate([(own << wide) + ((k << bits) + np.arange(n)) for k, own in enumerate(rows)])
    keys.sort()
    at, place = keys >> wide, keys & ((1 << wide) - 1)
    first = np.ones(len(at), bool)
    np.not_equal(at[1:], at[:-1], out=first[1:])
    cuts = np.flatnonzero(first)
    own, size = at.take(cuts), np.diff(cuts, append=len(at))
    # each row is fetched once, in order; tokens find theirs among those
    before, of = table.take(own, axis=0), np.empty(len(rows) << bits, np.int64)
    of[place] = np.repeat(np.arange(len(own)), size)
    e = _logits(before, of.reshape(len(rows), -1)[:, :n])
    np.exp(e, out=e)
    e *= (1 / _row_sums(e))[:, None]
    e.ravel()[np.arange(0, e.size, e.shape[1]) + target] -= 1
    token = place & ((1 << bits) - 1)
    slope = _slopes(e, token, cuts, size)
    seen[own] = seen.take(own) + size.astype(np.int32)
    total = square.take(own) + np.einsum("ij,ij->i", slope, slope) / np.float32(slope.shape[1])
    square[own] = total
    slope *= (-STEP / np.sqrt(total + np.float32(1e-8)))[:, None]
    slope += before
    _put(table, own, slope)


def learn(batches: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], tables: list[np.ndarray], squares: list[np.ndarray]) -> list[np.ndarray]:
    """Updates of the tables, in place, over (units, hashes, words per text) batches; how often each row was active."""
    seen = [np.zeros(len(t), np.int32) for t in tables]
    for unit, h, counts in batches:
        ctx, (digit, prefix) = contexts(h, counts), digits_of(unit)
        for a in range(0, len(unit), BATCH):
            own = slice(a, a + BATCH)
            near = [x[own] for x in ctx]
            for d in range(3):
                _descend(tables[d], squares[d], seen[d], feature_rows(near, prefix[d][own], d), digit[d][own])
    return seen


def log_probability(unit: np.ndarray, h: np.ndarray, counts: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
    """log10 P(unit | context) of every token: the sum over its three digits."""
    ctx, (digit, prefix) = contexts(h, counts), digits_of(unit)
    out = np.empty(len(unit))
    for a in range(0, len(unit), BATCH):
        own = slice(a, a + BATCH)
        near = [x[own] for x in ctx]
        total = np.zeros(len(near[0]))
        for d in range(3):
            logit = _logits(tables[d], feature_rows(near, prefix[d][own], d))
            total += logit.ravel().take(np.arange(0, logit.size, logit.shape[1]) + digit[d][own])
            total -= np.log(_row_sums(np.exp(logit, out=logit)))
        out[own] = total
    return out / np.log(10)


def start(weight: np.ndarray) -> list[np.ndarray]:
    """Rows without context that give the units' shares of ``weight``; a unit without any has next to none."""
    own = np.maximum(weight, 1e-3).reshape(DIGIT, DIGIT, DIGIT)
    sums = own.sum((1, 2))[None], own.sum(2), own.reshape(-1, DIGIT)
    return [np.log(s / s.sum(1, keepdims=True)).astype(np.float32) for s in sums]


def _word_counts(docs: DataFrame) -> DataFrame:
    """How often each word occurs in the rows marked for learning, counted by slice first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=4 << 20):
            _, flat = tokens(batch.column("text"))
            if len(flat):
                got = pc.value_counts(flat)
                yield pa.RecordBatch.from_arrays([got.field("values"), got.field("counts")], names=["word", "n"])

    return docs.filter("learn").select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _pieces(arrays: list[np.ndarray]) -> np.ndarray:
    """Tables (or numbers a row) of all digits as equal pieces."""
    return np.concatenate([np.pad(a, [(0, n - len(a)), *[(0, 0)] * (a.ndim - 1)]) for a, n in zip(arrays, SIZES)]).reshape(-1, PIECE, *arrays[0].shape[1:])


def _tables(pieces: np.ndarray) -> list[np.ndarray]:
    rows = pieces.reshape(-1, *pieces.shape[2:])
    return [rows[a : a + p + (1 << b)] for a, p, b in zip(STARTS, PREFIXES, BITS)]


def _round(texts: DataFrame, words: pa.Array, first: list[np.ndarray], known: tuple | None, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Tables (in pieces) after every shard of ``texts`` has learned from the same start, and their sums of squares.

    Changes are averaged row by row, a shard weighing as much as it used the row; they travel in pieces of PIECE rows, as
    half-precision numbers, and are added up where a piece's come together.
    """
    shared = texts.sparkSession.sparkContext.broadcast((words, first, known))

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, first, known = shared.value
        if known is None:
            tables = [np.zeros((p + (1 << b), DIGIT), np.float32) for p, b in zip(PREFIXES, BITS)]
            for t, f in zip(tables, first):
                t[: len(f)] = f
            squares = [np.full(len(t), PRIOR, np.float32) for t in tables]
        else:
            tables, squares = ([x.astype(np.float32) for x in _tables(k)] for k in known)
        old = _pieces(squares)

        def read() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            for batch in slices(batches, limit=2 << 20):
                counts, flat = tokens(batch.column("text"))
                code = pc.dictionary_encode(flat)
                h = hashes(code.dictionary)
                place = pc.fill_null(pc.index_in(code.dictionary, value_set=words), -1).to_numpy().astype(np.int64)
                at = code.indices.to_numpy()
                yield sequence(units_of(h, place)[at], counts, 0), sequence(h[at], counts, _END), counts

        seen = _pieces(learn(read(), tables, squares))
        now = _pieces(squares)
        for i in np.flatnonzero(seen.any(1)):
            d = int(np.searchsorted(STARTS, i * PIECE, side="right")) - 1
            a = i * PIECE - STARTS[d]
            after, change = tables[d][a : a + PIECE], np.zeros((PIECE, DIGIT), np.float32)
            change[: len(after)] = after
            if known is not None:
                change[: len(after)] -= known[0][i][: len(after)]
            elif a == 0:
                change[: len(first[d])] -= first[d]
            parts = seen[i].astype(np.float32), change.astype(np.float16), now[i] - old[i]
            yield pa.RecordBatch.from_arrays([pa.array([i]), *[pa.array([p.tobytes()], pa.binary()) for p in parts]], names=["piece", "seen", "change", "square"])

    def add(table: pa.Table) -> pa.Table:
        weight, change, square = np.zeros((PIECE, 1)), np.zeros((PIECE, DIGIT)), np.zeros(PIECE)
        for seen, raw, more in zip(*(table.column(c).to_pylist() for c in ("seen", "change", "square"))):
            own = np.frombuffer(seen, np.float32)[:, None]
            weight += own
            change += np.frombuffer(raw, np.float16).reshape(PIECE, DIGIT) * own
            square += np.frombuffer(more, np.float32)
        mean = (change / np.maximum(weight, 1)).astype(np.float16)
        return pa.table({"piece": table.column("piece").slice(0, 1), "change": pa.array([mean.tobytes()], pa.binary()), "square": pa.array([square.astype(np.float32).tobytes()], pa.binary())})

    shape = "piece long, seen binary, change binary, square binary"
    got = texts.coalesce(shards).mapInArrow(shard, shape).groupBy("piece").applyInArrow(add, "piece long, change binary, square binary").toArrow()
    shared.unpersist()
    if known is None:
        tables, squares = np.zeros((sum(SIZES) // PIECE, PIECE, DIGIT), np.float16), np.full((sum(SIZES) // PIECE, PIECE), PRIOR, np.float32)
        for a, f in zip(STARTS, first):
            tables.reshape(-1, DIGIT)[a : a + len(f)] = f
    else:
        tables, squares = known
    for i, change, square in zip(got.column("piece").to_pylist(), got.column("change"), got.column("square")):
        tables[i] = (tables[i].astype(np.float32) + np.frombuffer(change.as_py(), np.float16).reshape(PIECE, DIGIT)).astype(np.float16)
        squares[i] += np.frombuffer(square.as_py(), np.float32)
    return tables, squares


def fit(docs: DataFrame, counts: DataFrame, rounds: int = 1) -> Model:
    """Train on the rows of ``docs`` (doc_id, text, learn) that ``learn`` marks, all of them; ``counts`` are their (word, n).

    The most frequent words and the end are units of their own, all others are in hashed buckets; contexts are whole words,
    hashed, so rare ones count too. Every text is learned from once: a round is the part of the texts that is learned from
    between two averages, in shards of about SHARD bytes, each by one worker from the common weights. The sums of squares
    that set each row's step go on from round to round.
    """
    top = counts.orderBy(F.desc("n"), "word").limit(COMMON).select("word", "n").toArrow()
    words = pc.cast(top.column("word").combine_chunks(), pa.string())
    n = top.column("n").combine_chunks().to_numpy().astype(np.int64)
    units = words.slice(0, TOP - 1)
    learning = docs.filter("learn")
    facts = learning.agg(F.count("*").alias("ends"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()

    def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.filter(pc.invert(pc.is_in(batch.column("word"), value_set=units)))
            if own.num_rows:
                at = buckets(own.column("h").to_numpy().view(np.uint64)) - TOP
                size, sums = np.bincount(at, minlength=UNITS - TOP), np.bincount(at, weights=own.column("n").to_numpy(), minlength=UNITS - TOP)
                some = np.flatnonzero(size)
                yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(size[some]), pa.array(sums[some].astype(np.int64))], names=["bucket", "words", "n"])

    rest = counts.select("word", "n", F.xxhash64("word").alias("h")).mapInArrow(by_bucket, "bucket long, words long, n long")
    rest = rest.groupBy("bucket").agg(F.sum("words").alias("words"), F.sum("n").alias("n")).collect()  # one for each bucket
    mass = np.full(UNITS - TOP, 0.5)
    for r in rest:
        mass[r.bucket] += r.n + 0.5 * r.words
    weight = np.concatenate([[facts.ends + 0.5], n[: TOP - 1] + 0.5, np.zeros(max(0, TOP - 1 - len(n))), mass])
    first = start(weight)
    known, rounds = None, rounds if facts.ends else 0
    for r in range(rounds):
        part = learning if rounds == 1 else learning.filter(F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(rounds)) == r)
        known = _round(part.select("text"), units, first, known, max(1, -(-facts.bytes // (SHARD * rounds))))
    if known is None:
        tables = np.zeros((sum(SIZES) // PIECE, PIECE, DIGIT), np.float16)
        for a, f in zip(STARTS, first):
            tables.reshape(-1, DIGIT)[a : a + len(f)] = f
    else:
        tables = known[0]
    total = facts.ends + int(n[: TOP - 1].sum()) + sum(r.n for r in rest)
    distinct = len(units) + sum(r.words for r in rest) + (facts.ends > 0)
    return Model(words, n, [t.copy() for t in _tables(tables)], mass, total, distinct, facts.ends)


def _blocks(batches: Iterator[pa.RecordBatch], common: pa.Array) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray, np.ndarray, pa.Array]]:
    """Blocks of a task with a number each, their words per text, the words by number, and the words that aren't ``common``:
    numbers run through ``common`` first."""
    part = TaskContext.get().partitionId()
    for k, batch in enumerate(slices(batches, limit=BLOCK)):
        counts, flat = tokens(batch.column("text"))
        code = pc.dictionary_encode(flat)
        known = pc.fill_null(pc.index_in(code.dictionary, value_set=common), -1).to_numpy().astype(np.int64)
        other = np.flatnonzero(known < 0)
        known[other] = len(common) + np.arange(len(other))
        yield (part << 32) + k, batch, counts, known[code.indices.to_numpy()], code.dictionary.take(pa.array(other))


def _packed(batch: pa.RecordBatch) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema) as writer:
        writer.write_batch(batch)
    return out.getvalue().to_pybytes()


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame, counts: DataFrame, model: Model) -> DataFrame:
    """log10 probability of every whole text (``doc_id``, ``text``, ``learn``) under the model and under smoothed counts.

    A word outside the units has its bucket's probability times its share of the bucket's smoothed counts; a word that
    learning has not met counts as the bucket's unknown word, so probabilities of all words learned and of one unknown
    word a bucket sum to 1.

    Texts stay in blocks of some megabytes. A block's distinct words, each once, meet the counts in a join by word, but for
    the common ones, whose counts every task has; they come back to their block. Its texts go the same way as word numbers in
    compressed form, in a row without counts, so blocks are read once.
    """
    common_hash = hashes(model.words)
    shared = docs.sparkSession.sparkContext.broadcast((model, common_hash))
    texts = docs.select("doc_id", "learn", "text")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=1)
        for block, batch, n, code, own in _blocks(batches, shared.value[0].words):
            planes = code.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
            lists = [pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), x) for x in (batch.column("doc_id"), batch.column("learn"), pa.array(n))]
            row = pa.RecordBatch.from_arrays([*lists, pa.array([squeeze.compress(planes)], pa.binary()), pa.array([len(own)])], names=["doc_id", "learn", "n", "codes", "words"])
            names = ["block", "place", "word", "held"]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), block)), pa.array(np.arange(len(own), dtype=np.int32)), own, pa.nulls(len(own), pa.binary())], names=names)
            # no word has a blank, so this one has no counts
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([-1], pa.int32()), pa.array([f" {block}"]), pa.array([_packed(row)], pa.binary())], names=names)

    ready: dict = {}

    def join(table: pa.Table) -> pa.Table:
        import zstandard

        m, common_hash = shared.value
        if not ready:  # once a task: half-precision numbers are slow to add
            ready["tables"] = [t.astype(np.float32) for t in m.tables]
        base_all = m.tokens + 0.5 * (m.distinct + 1)
        held = pc.is_valid(table.column("held"))
        rows, right = table.filter(held).column("held").to_pylist(), table.select(["place", "n", "h"]).filter(pc.invert(held))
        row = pa.ipc.open_stream(rows[0]).read_all().to_pylist()[0] if len(rows) == 1 else None
        if row is None or right.num_rows != row["words"]:
            raise RuntimeError("a block's words are not all those that were sent")
        k, place = len(m.counts), right.column("place").to_numpy()
        c, h, at = np.zeros(k + len(place)), np.zeros(k + len(place), np.uint64), np.full(k + len(place), -1)
        c[:k], h[:k], at[:k] = m.counts, common_hash, np.arange(k)
        c[k + place], h[k + place] = right.column("n").to_numpy(), right.column("h").to_numpy().view(np.uint64)
        unit = units_of(h, at)
        planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["codes"]), np.uint8)
        code = np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel().astype(np.int64)
        n = np.array(row["n"], np.int64)
        owner = np.repeat(np.arange(len(n)), n)
        base = np.bincount(owner, weights=np.log10((c + 0.5) / base_all)[code], minlength=len(n)) + np.log10((m.ends + 0.5) / base_all)
        known = np.bincount(owner, weights=(c > 0)[code], minlength=len(n)).astype(np.int64) + (m.ends > 0)
        share = np.where(unit >= TOP, np.log10((c + 0.5) / m.mass[np.maximum(unit - TOP, 0)]), 0)
        own = log_probability(sequence(unit[code], n, 0), sequence(h[code], n, _END), n, ready["tables"])
        total = np.bincount(np.repeat(np.arange(len(n)), n + 1), weights=own, minlength=len(n)) + np.bincount(owner, weights=share[code], minlength=len(n))
        return pa.table({"doc_id": pa.array(row["doc_id"], pa.int64()), "held_out": pc.invert(pa.array(row["learn"], pa.bool_())), "n_tokens": n + 1, "n_known": known, "train_tokens": np.full(len(n), m.tokens), "base_score": base, "score": total})

    found = texts.mapInArrow(blocks, "block long, place int, word string, held binary").join(counts, "word", "left")
    found = found.select("block", "place", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.xxhash64("word").alias("h"), "held")
    return found.groupBy("block").applyInArrow(join, RESULT)


def score_documents(docs: DataFrame, learn: Column, rounds: int = 1) -> DataFrame:
    """Train on the rows for which ``learn`` holds (null: it holds) and score all; see :func:`fit` and :func:`score`.

    Null text counts as empty: its end is its only token. Repeated rows are learned from, and scored, each. Without any
    row to learn from, every token is unseen. Other columns aren't used.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(learn, F.lit(True)).alias("learn"))
    counts = stage(_word_counts(rows))
    return score(rows, counts, fit(rows, counts, rounds))
