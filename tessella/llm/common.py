"""What the text operators share: shared storage, bounded Arrow slices, tokens and n-gram keys."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space of the token contracts: space, tab, line feed, vertical tab, form feed, carriage return.
BLANK = " \t\n\x0b\x0c\r"
#: Bytes of text that a worker treats at a time: numbers for every character's n-grams take some hundred times as much.
SLICE_BYTES = 3 << 18


def shared_dir(spark: SparkSession) -> str:
    """A new folder in ``spark.checkpoint.dir``; where that is unset, in a temporary one if Spark runs in one process (tests),
    else an error, since executors don't share such a folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = os.path.join(tempfile.gettempdir(), "tessella-shared")
    return f"{base.rstrip('/')}/tessella-{uuid.uuid4().hex}"


def stage(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``df`` to shared storage and read it back: lineage ends there, and lost executors lose nothing."""
    path = path or shared_dir(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove the folders of staged tables that nothing reads any more."""
    for df in tables:
        if path := getattr(df, "_staged_at", None):
            spark = df.sparkSession
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5 (null for a null id)."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of at most ``limit`` bytes of ``column``, or one row if that is longer. Behind the last one the
    worker's free memory goes back to the system, since the worker lives on for other tasks."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(size)
        at = 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to
    release()


def release() -> None:
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def tokens(texts: pa.Array) -> tuple[np.ndarray, pa.StringArray]:
    """Lower-case A-Z, split at ASCII white space: words per text, and all words in order. Null counts as empty.

    Works on the bytes of all texts at once: a word starts at a byte that is not blank after one that is, or at the first
    of its text.
    """
    texts = pc.fill_null(texts, "")
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    edges = offsets - offsets[0]
    # comparisons of bytes, which wrap, are many times as fast as a table of them
    solid = (data != 32) & (data - np.uint8(9) > 4)
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    heads = edges[:-1][edges[:-1] < len(data)]
    first[heads] = solid[heads]
    tails = heads[heads > 0] - 1
    last[tails] = solid[tails]
    at = np.flatnonzero(first)
    counts = np.diff(np.searchsorted(at, edges))
    ends = starts_of(np.flatnonzero(last) + 1 - at).astype(np.int32)
    words = data[solid]
    words += (words - np.uint8(65) < 26).view(np.uint8) << np.uint8(5)
    return counts, pa.StringArray.from_buffers(len(at), pa.py_buffer(ends), pa.py_buffer(words))


def starts_of(counts: np.ndarray) -> np.ndarray:
    """Where each group starts if groups of these sizes follow one another."""
    out = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=out[1:])
    return out


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in one array, and how many each text has."""
    joined = "".join(texts).encode("utf-32-le", "surrogatepass")
    return np.frombuffer(joined, np.uint32), np.fromiter(map(len, texts), np.int64, len(texts))


def sums(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(owner, weights=values, minlength=n)


def smallest(df: DataFrame, by: Column, n: int) -> DataFrame:
    """The ``n`` rows with the smallest hash: a bounded sample that no order of the input changes."""
    return df.orderBy(by).limit(n)
