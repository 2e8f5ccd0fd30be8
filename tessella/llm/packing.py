"""Packing of token sequences: bounded-space online best-fit with a short look ahead."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import slices, stage

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"


class _Ids(dict):
    """Token ids, as little-endian bytes, of a stretch of text that starts at a space or at the text's start."""

    def __init__(self, encode, most: int):
        super().__init__()
        self.encode, self.most = encode, most

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        out = np.array(self.encode(word), "<u4").tobytes()
        if len(word) <= 40:
            self[word] = out
        return out


def _encoder(path: str):
    """The byte-level BPE at ``path``, run by tiktoken from the file's own ranks (the same ids, several times faster)."""
    import json

    import tiktoken
    from public_tokenizers import PATTERN

    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    byte_of = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}
    special = {"<|endoftext|>"}
    ranks = {bytes(byte_of[c] for c in piece): i for piece, i in model["vocab"].items() if piece not in special}
    return tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def text_ids(text: str, ids: _Ids) -> bytes:
    """Ids of a whole text. No token crosses from a non-blank into a space, so a text without a double blank before a
    space can be put together from its words' ids; any other text is encoded in one go."""
    if "  " in text or text[:1] == " " or text[-1:] == " ":
        return np.array(ids.encode(text), "<u4").tobytes()
    first, *rest = text.split(" ")
    return ids[first] + b"".join(map(ids.__getitem__, [" " + w for w in rest])) if text else b""


def cut_documents(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, cache: int = 200_000) -> DataFrame:
    """A row per piece of each document: tokens of the whole text, then ``end_id``.

    A document over ``capacity`` tokens is cut from its end into pieces of ``capacity``, so only its first piece may be
    shorter. Null text counts as empty (the end token alone); repeated rows stay, each with its own pieces.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _Ids(_encoder(tokenizer), cache)
        tail = np.array([end_id], "<u4").tobytes()
        for batch in slices(batches):
            out: list[tuple] = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                raw = text_ids(text or "", ids) + tail
                n = len(raw) // 4
                first = n % capacity or capacity
                at = [0, *range(first, n, capacity), n] if n > capacity else [0, n]
                out += [(doc, k, a, b - a, zlib.crc32(raw[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(at, at[1:]))]
            columns = list(zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, PIECES)


def best_fit(lengths: list[int], capacity: int, open_bins: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each item in turn, online.

    Of the open bins that have room, the one with the least free space takes the item. Bit ``f`` of one integer says that
    some open bin has ``f`` free, so that bin is found by a shift and the lowest set bit. A new bin opens if none has
    room; if ``open_bins`` are open then, the fullest closes first. A full bin closes at once.
    """
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    bits = n_open = bins = 0
    of, at = [], []
    for size in lengths:
        above = bits >> size
        if above:
            room = size + (above & -above).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                bits &= ~(1 << room)
            n_open -= 1
        else:
            if n_open >= open_bins:
                fullest = (bits & -bits).bit_length() - 1
                free[fullest].pop()
                if not free[fullest]:
                    bits &= ~(1 << fullest)
                n_open -= 1
            b, room = bins, capacity
            bins += 1
        of.append(b)
        at.append(capacity - room)
        if room > size:
            free[room - size].append(b)
            bits |= 1 << (room - size)
            n_open += 1
    return of, at


def look_ahead(lengths: np.ndarray, window: int) -> np.ndarray:
    """The order in which items are packed: as they come, but of each ``window`` in a row the longest first."""
    at = np.arange(len(lengths))
    return np.lexsort((at, -lengths, at // max(window, 1)))


def pack(pieces: DataFrame, capacity: int = 1024, open_bins: int = 1024, group: int = 65_536, window: int = 1024) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: sequences of at most ``capacity`` tokens, filled without gaps.

    Pieces are dealt by the hash of their place in the staged table into groups of about ``group``, so rows that repeat
    spread like others. Each group is packed online in one task, in the order of the table, with ``open_bins`` bins open
    at a time and a look ahead of ``window`` pieces (1: none), of which the longest go first. An empty table gives an
    empty one.
    """
    pieces = stage(pieces)
    n = max(1, -(-pieces.count() // group))

    def fill(table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        length = table.column("length").to_numpy()
        order = look_ahead(length, window)
        of, at = best_fit(length[order].tolist(), capacity, open_bins)
        table = table.take(pa.array(order))
        own = table.append_column("sequence_id", pa.array(np.array(of, np.int64) * n + table.column("part")[0].as_py())).append_column("offset", pa.array(at, pa.int64()))
        return own.select(_SCHEMA.names).cast(_SCHEMA)

    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    dealt = pieces.withColumn("place", F.monotonically_increasing_id()).withColumn("part", F.pmod(F.xxhash64("place"), F.lit(n)))
    return dealt.select(*names, "place", "part").groupBy("part").applyInArrow(fill, PACKED)


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, open_bins: int = 1024) -> DataFrame:
    """Whole documents as packed pieces; see :func:`cut_documents` and :func:`pack`. Other columns are not used, and rows that
    repeat are packed each."""
    return pack(cut_documents(docs, tokenizer, capacity, end_id), capacity, open_bins)
