"""SentencePiece encoding and decoding: a relational lattice of substrings and pieces, folded by Viterbi."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from tessella.llm.common import code_points, discard, release, slices, stage, starts_of

MARK = "▁"
#: Bytes of text whose units are numbered together, and that are split at a time; characters of a unit whose substrings are
#: cut from one window.
BLOCK, SPLIT, WINDOW = 32 << 20, 1 << 19, 64
#: Added to a piece's merge rank: a file of merges has no probabilities and tokenizers aren't trained, so a piece costs
#: ln(SMOOTH + rank), as if probabilities fell with the rank by Zipf's law.
SMOOTH = 1000
#: Cost of a character that no piece covers: it becomes its bytes' pieces.
UNCOVERED = 1000.0
#: An edge is its end, times LENGTHS, less its length, times PIECES, plus its piece's id; a character without a piece has its
#: code point over BARE. An id is less than that.
LENGTHS, PIECES, BARE = 64, 1 << 22, 1 << 21
#: Units times the last end that fit in one number beside an edge.
TOGETHER = 1 << 34


@dataclass
class Pieces:
    names: list[str]
    cost: list[float]
    ids: list[int]
    raw: list[bytes]
    bytes_from: int
    longest: int
    kind: np.ndarray
    crossed: np.ndarray


def load(path: str) -> Pieces:
    """The vocabulary at ``path``: pieces that text can have, what each costs, and every id's bytes."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    every = range(model.get_piece_size())
    plain = [i for i in every if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    named = [model.id_to_piece(i) for i in every]
    rank = {i: max(-model.get_score(i), 0.0) if model.get_score(i) > -1e8 else 0.0 for i in plain}
    raw = [bytes([int(n[3:5], 16)]) if model.is_byte(i) else n.replace(MARK, " ").encode() if i in rank else b"" for i, n in enumerate(named)]
    fallback = next(i for i in every if model.is_byte(i) and named[i] == "<0x00>")
    spelled = [named[i].replace(MARK, " ") for i in plain]
    kind, crossed = _crossed(spelled)
    return Pieces(spelled, [float(np.log(SMOOTH + rank[i])) for i in plain], plain, raw, fallback, max(map(len, spelled)), kind, crossed)


def _crossed(names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A number for each character that some longer piece holds (0 for others), and whether any piece has two such characters
    side by side: between two that none has, every segmentation has an end."""
    pairs = {pair for name in names for pair in zip(name, name[1:])}
    number = {c: k for k, c in enumerate(sorted({c for pair in pairs for c in pair}), 1)}
    kind, crossed = np.zeros(0x110000, np.int16), np.zeros((len(number) + 1,) * 2, bool)
    kind[[ord(c) for c in number]] = list(number.values())
    for a, b in pairs:
        crossed[number[a], number[b]] = True
    return kind, crossed


def piece_table(spark: SparkSession, pieces: Pieces) -> DataFrame:
    """(name, hash, id, cost), the mark as a blank; as long as the vocabulary file, whatever the input."""
    rows = spark.createDataFrame(pa.table({"name": pieces.names, "id": pa.array(pieces.ids, pa.int32()), "cost": pieces.cost}))
    return rows.withColumn("hash", F.xxhash64("name"))


def _spelled(code: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the byte pieces of code points' UTF-8 bytes, and how many each has; ``first`` is that of byte 0."""
    raw = code.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
    return np.frombuffer(raw, np.uint8).astype(np.int32) + first, 1 + sum((code >= least).astype(np.int64) for least in (0x80, 0x800, 0x10000))


def cheapest_paths(edges: np.ndarray, counts: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of the cheapest path of each unit, and how many it has, by Viterbi's algorithm over the ends of all units at once.

    ``edges`` are those of all units, one unit's (``counts``) behind the other's; each character has an edge of its own.
    ``cost`` is by id. At each end the edge of least cost is kept, of equal ones the longest, then that of the smallest id.
    """
    units, low = len(counts), LENGTHS * PIECES
    unit, end = np.repeat(np.arange(units), counts), edges // low
    if units > 1 and int(end.max(initial=0)) * units >= TOGETHER:
        cut, half = int(counts[: units // 2].sum()), units // 2
        parts = cheapest_paths(edges[:cut], counts[:half], cost), cheapest_paths(edges[cut:], counts[half:], cost)
        return np.concatenate([x for x, _ in parts]), np.concatenate([n for _, n in parts])
    keys = (end * units + unit) * low + edges % low
    keys.sort()
    piece, length, group = keys % PIECES, LENGTHS - keys // PIECES % LENGTHS, keys // low
    end, unit = np.divmod(group, max(units, 1))
    base = starts_of(np.bincount(unit[length == 1], minlength=units) + 1)
    at, step = base[unit] + end, np.where(piece < BARE, cost[np.minimum(piece, len(cost) - 1)], UNCOVERED)
    best, into, back = np.zeros(base[-1]), np.zeros(base[-1], np.int64), np.zeros(base[-1], np.int64)
    heads = np.flatnonzero(np.diff(group, prepend=-1))
    of_end = np.searchsorted(end[heads], np.arange(1, end[-1] + 2 if len(end) else 1))
    for a, b in zip(of_end[:-1].tolist(), of_end[1:].tolist()):
        first = heads[a:b]
        own = slice(int(first[0]), int(heads[b]) if b < len(heads) else len(keys))
        total = best[at[own] - length[own]] + step[own]
        least = np.minimum.reduceat(total, first - own.start)
        node = at[first]
        best[node] = least
        same = np.flatnonzero(total == best[at[own]])[::-1] + own.start
        into[at[same]] = same  # of repeated places the last one counts, which is the first edge
    back[1:] = length[into[1:]] if len(length) else 0
    on, now = np.zeros(len(best), bool), base[1:] - 1
    now = now[now > base[:-1]]
    floor = np.zeros(len(best), bool)
    floor[base[:-1]] = True
    while len(now):
        on[now] = True
        now = now - back[now]
        now = now[~floor[now]]
    return piece[into[on]], np.diff(starts_of(on.astype(np.int64))[base])


def encode_units(units: DataFrame, pieces: Pieces, keys: list[str]) -> DataFrame:
    """``ids``, the cheapest sequence of pieces that spells the ``unit`` (not empty), for the ``keys`` of each row of ``units``.

    Substrings of at most the longest piece's characters are exploded with their places and joined to the pieces (by
    their hash, which is a long; the strings are compared too); a character that is no piece becomes an edge too. An edge
    is one number: its end, its length (the longer first) and its piece. Edges are grouped by unit again and folded over the
    ends, those of an Arrow batch of units at once (see :func:`cheapest_paths`). The table of pieces is a constant, so it is
    broadcast. If ``units`` are partitioned by the keys, nothing is exchanged.
    """
    table = piece_table(units.sparkSession, pieces)
    longest = pieces.longest
    parts = units.select(*keys, "unit", F.explode(F.sequence(F.lit(0), F.char_length("unit") - 1, F.lit(WINDOW))).alias("o"))
    parts = parts.select(*keys, "o", F.substring("unit", F.col("o") + 1, F.lit(WINDOW + longest - 1)).alias("part"))
    parts = parts.select(*keys, "o", "part", F.explode(F.sequence(F.lit(0), F.least(F.lit(WINDOW), F.char_length("part")) - 1)).alias("i"))
    spans = parts.select(*keys, "o", "part", "i", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.char_length("part") - F.col("i")))).alias("n"))
    order = (F.col("o") + F.col("i") + F.col("n")).cast("long") * LENGTHS + (LENGTHS - F.col("n"))
    spans = spans.select(*keys, order.alias("k"), "n", F.substring("part", F.col("i") + 1, F.col("n")).alias("piece")).withColumn("hash", F.xxhash64("piece"))
    edges = spans.join(F.broadcast(table), "hash", "left").withColumn("known", F.coalesce(F.col("piece") == F.col("name"), F.lit(False))).filter("known or n = 1")
    piece = F.when(F.col("known"), F.col("id")).otherwise(F.ascii("piece") + BARE).cast("long")
    grouped = edges.groupBy(*keys).agg(F.collect_list(F.col("k") * PIECES + piece).alias("edges"))

    cost = np.full(max(pieces.ids, default=0) + 1, UNCOVERED)
    cost[pieces.ids] = pieces.cost
    bytes_from = pieces.bytes_from

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("edges")
            counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            ids, n = cheapest_paths(lists.flatten().to_numpy(), counts, cost)
            if (bare := ids >= BARE).any():
                spelled, wide = _spelled(ids[bare] - BARE, bytes_from)
                size = np.ones(len(ids), np.int64)
                size[bare] = wide
                n = np.diff(starts_of(size)[starts_of(n)])
                of_bare, ids = np.repeat(bare, size), np.repeat(ids, size)
                ids[of_bare] = spelled
            ends = pa.array(starts_of(n).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*map(batch.column, keys), pa.ListArray.from_arrays(ends, pa.array(ids.astype(np.int32)))], names=[*keys, "ids"])

    schema = StructType([*(grouped.schema[k] for k in keys), StructField("ids", ArrayType(IntegerType()))])
    return grouped.mapInArrow(fold, schema)


def split_units(texts: pa.Array, pieces: Pieces) -> tuple[np.ndarray, pa.StringArray]:
    """Units per text, and all units in order: the text, cut wherever no piece can cross. So the best path of a text is
    that of its units, one behind the other. A blank goes before each text that isn't empty. Null counts as empty."""
    points, size = code_points([" " + t if t else "" for t in texts.to_pylist()])
    if not len(points):
        return np.zeros(len(size), np.int64), pa.array([], pa.string())
    own = pieces.kind[points]
    first = np.ones(len(points), bool)
    first[1:] = ~pieces.crossed[own[:-1], own[1:]]
    edges = starts_of(size)
    first[edges[:-1][size > 0]] = True
    at = np.flatnonzero(first)
    data = points.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
    begin = at
    if len(data) > len(points):
        wide = np.ones(len(points), np.int8)
        for least in (0x80, 0x800, 0x10000):
            wide += points >= least
        begin = starts_of(wide)[at]
    return np.diff(np.searchsorted(at, edges)), pa.StringArray.from_buffers(len(at), pa.py_buffer(np.append(begin, len(data)).astype(np.int32)), pa.py_buffer(data))


def _blocks(batches: Iterator[pa.RecordBatch], pieces: Pieces, common: pa.Array) -> Iterator[tuple[int, Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]], pa.Array]]:
    """Blocks of a task with a number each, their parts, and the units that aren't ``common``: numbers run through ``common``
    first. A part has its rows, their units per text, and the units by number. Of a block only each part's distinct units and
    their places are held, not all units spelled out."""
    task = TaskContext.get().partitionId()
    for k, batch in enumerate(slices(batches, limit=BLOCK)):
        parts, counts, places, names = [], [], [], []
        for part in slices(iter([batch]), limit=SPLIT):
            n, flat = split_units(part.column("text"), pieces)
            code = flat.dictionary_encode()
            for kept, new in ((parts, part), (counts, n), (places, code.indices.to_numpy()), (names, code.dictionary)):
                kept.append(new)
            del flat, code
        code = pa.chunked_array(names, pa.string()).dictionary_encode().combine_chunks()
        known = pc.fill_null(pc.index_in(code.dictionary, value_set=common), -1).to_numpy().astype(np.int64)
        other = np.flatnonzero(known < 0)
        known[other] = len(common) + np.arange(len(other))
        numbers = np.split(known[code.indices.to_numpy()], np.cumsum([len(x) for x in names])[:-1])
        yield (task << 32) + k, ((p, n, own[at]) for p, n, own, at in zip(parts, counts, numbers, places)), code.dictionary.take(pa.array(other))


def _pick(values: np.ndarray, start: np.ndarray, size: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """The stretches ``chosen`` of ``values``, one behind the other."""
    n = size[chosen]
    return values[np.repeat(start[chosen] - starts_of(n)[:-1], n) + np.arange(n.sum())]


def decode_ids(ids: np.ndarray, pieces: Pieces) -> bytes:
    """Text of a sequence of ids, without the blank that encoding put first."""
    return b"".join(map(pieces.raw.__getitem__, ids.tolist()))[1:]


def common_units(texts: DataFrame, pieces: Pieces, docs: int = 32_000, most: int = 1 << 19) -> pa.Table:
    """``unit`` and ``ids`` of the ``most`` frequent units of at most ``docs`` documents, those of smallest hash. They are looked
    up in every block rather than encoded there; which ones they are changes no result."""
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast(pieces)
    ids = texts.select("doc_id").filter("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(docs)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            got = pc.value_counts(split_units(batch.column("text"), shared.value)[1])
            yield pa.RecordBatch.from_arrays([got.field("values"), got.field("counts")], names=["unit", "n"])

    counts = texts.join(F.broadcast(ids), "doc_id").select("text").mapInArrow(count, "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n"))
    top = stage(counts.orderBy(F.desc("n"), "unit").limit(most).select("unit"))
    out = encode_units(top.repartition(64, "unit"), pieces, ["unit"]).toArrow()
    discard(top)
    return out


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id``, ``ids`` and ``round_trip`` (the ids spell the text again) of every row's whole text.

    Texts stay in blocks. A block's distinct units, each once, are encoded, but for the most common, whose ids every task
    has; they come back to their block, whose texts travel as compressed unit numbers, a row a part. Null and empty texts have no ids.
    Repeated rows are encoded each. Other columns aren't used. Empty in, empty out.
    """
    pieces = load(path)
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    common = common_units(texts, pieces).combine_chunks()
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shared = spark.sparkContext.broadcast((pieces, common))

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, common = shared.value
        for block, _, own in _blocks(batches, pieces, pa.array(common.column("unit").combine_chunks())):
            for a in range(0, len(own), 100_000):
                some = own.slice(a, 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), block)), pa.array(np.arange(a, a + len(some), dtype=np.int32)), some], names=["block", "place", "unit"])

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pieces, common = shared.value
        squeeze = zstandard.ZstdCompressor(level=3)
        for block, parts, own in _blocks(batches, pieces, pa.array(common.column("unit").combine_chunks())):
            for part, n, code in parts:
                planes = code.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
                sums = [zlib.crc32((t or "").encode()) for t in part.column("text").to_pylist()]
                lists = [pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), x) for x in (part.column("doc_id"), pa.array(n), pa.array(sums, pa.int64()))]
                yield pa.RecordBatch.from_arrays([pa.array([block]), *lists, pa.array([squeeze.compress(planes)], pa.binary()), pa.array([len(own)])], names=["block", "doc_id", "n", "sums", "codes", "units"])

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        import zstandard

        pieces, common = shared.value
        if not left.num_rows or set(left.column("units").to_pylist()) != {right.num_rows}:
            raise RuntimeError("a block's units differ between two reads of the input")
        known, lists = (t.column("ids").combine_chunks() for t in (common, right))
        order = np.empty(len(known) + right.num_rows, np.int64)
        order[: len(known)] = np.arange(len(known))
        order[len(known) + right.column("place").to_numpy()] = len(known) + np.arange(right.num_rows)
        flat = np.concatenate([np.asarray(x.flatten()).astype(np.int32) for x in (known, lists)])
        size = np.concatenate([pc.list_value_length(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in (known, lists)])
        begin = starts_of(size)[:-1]
        out = []
        for k in range(left.num_rows):
            row = left.slice(k, 1).to_pylist()[0]
            planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["codes"]), np.uint8)
            chosen = order[np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel()]
            ids = _pick(flat, begin, size, chosen)
            ends = starts_of(size[chosen])[starts_of(np.array(row["n"], np.int64))]
            same = [zlib.crc32(decode_ids(ids[a:b], pieces)) == total for a, b, total in zip(ends[:-1].tolist(), ends[1:].tolist(), row["sums"])]
            out.append(pa.table({"doc_id": pa.array(row["doc_id"], pa.int64()), "ids": pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids)), "round_trip": pa.array(same, pa.bool_())}))
        release()
        return pa.concat_tables(out)

    own = texts.mapInArrow(units, "block long, place int, unit string").repartition(max(1, -(-size // (4 << 20))), "block", "place")
    found = encode_units(own, pieces, ["block", "place"])
    held = texts.mapInArrow(codes, "block long, doc_id array<long>, n array<long>, sums array<long>, codes binary, units long")
    return held.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(join, "doc_id long, ids array<int>, round_trip boolean")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` (any columns, ``ids`` among them) with ``text``: null ids give null, none give an empty text, an id
    that the vocabulary lacks stops the job, bytes that are no UTF-8 become replacement characters."""
    shared = encoded.sparkSession.sparkContext.broadcast(load(path))

    @F.pandas_udf("string")
    def spell(ids):
        return ids.map(lambda own: None if own is None else decode_ids(np.asarray(own), shared.value).decode("utf-8", "replace"))

    return encoded.withColumn("text", spell("ids"))
