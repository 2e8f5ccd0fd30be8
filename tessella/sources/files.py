"""Reading and writing vectors, terms, keywords and whole indexes."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_KINDS = {"fvecs": (np.dtype("<f4"), "float"), "ivecs": (np.dtype("<i4"), "int"), "bvecs": (np.dtype("u1"), "int")}


def _parts(spark: SparkSession, path: str) -> list[str]:
    """A file, or a folder's files that are not empty by name: a file system may list them in any order."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.getFileStatus(at).isDirectory():
        return [path]
    return sorted(s.getPath().toString() for s in fs.listStatus(at) if s.getLen() and not s.getPath().getName().startswith(("_", ".")))


def _dimension(spark: SparkSession, path: str) -> int:
    """The dimension that a file's first record states, read through Spark's own file system."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(at)
    try:
        return struct.unpack("<i", bytes(stream.read() & 0xFF for _ in range(4)))[0]
    finally:
        stream.close()


def read_vecs(spark: SparkSession, path: str, kind: str, first_id: int = 0) -> DataFrame:
    """(doc_id, vec) of a file of records: a 4-byte dimension, then that many numbers. Records are read in parallel as
    fixed-length pieces; their place in the file, or in a folder's files by name, gives the id."""
    number, out = _KINDS[kind]
    files = _parts(spark, path)
    d = _dimension(spark, files[0])
    record = 4 + d * number.itemsize
    pieces = [spark.sparkContext.binaryRecords(f, record) for f in files]
    rows = spark.sparkContext.union(pieces).zipWithIndex().map(lambda x: (bytes(x[0]), x[1] + first_id))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column("raw").to_pylist()
            x = np.frombuffer(b"".join(raw), np.uint8).reshape(-1, record)
            if (x[:, :4].copy().view("<i4") != d).any():
                raise ValueError("records of different dimensions")
            values = x[:, 4:].copy().view(number).astype(np.float32 if out == "float" else np.int32).ravel()
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(raw) + 1) * d, pa.int32()), pa.array(values))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], names=["doc_id", "vec"])

    return spark.createDataFrame(rows, "raw binary, doc_id long").mapInArrow(parse, f"doc_id long, vec array<{out}>")


def write_vecs(docs: DataFrame, path: str, kind: str) -> None:
    """One part file per task, in id order, under ``path`` (a folder on a file system that all tasks share)."""
    import os

    number, _ = _KINDS[kind]
    ordered = docs.select("doc_id", "vec").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    os.makedirs(path, exist_ok=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        n, name = 0, f"{path}/part-{part:05d}.{kind}"
        with open(f"{name}.{TaskContext.get().taskAttemptId()}", "wb") as f:
            for batch in batches:
                for v in batch.column("vec").to_pylist():
                    f.write(struct.pack("<i", len(v)) + np.array(v).astype(number).tobytes())
                    n += 1
            temporary = f.name
        os.replace(temporary, name)  # a repeated task leaves one file
        yield pa.RecordBatch.from_arrays([pa.array([n])], names=["n"])

    ordered.mapInArrow(write, "n long").agg(F.sum("n")).collect()


def read_sparse(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, term) of a sparse-matrix file: three int64 (rows, columns, entries), int64 row starts, int32 columns."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column("content").to_pylist():
                rows, columns, n = np.frombuffer(raw, "<i8", 3)
                start = np.frombuffer(raw, "<i8", rows + 1, 24)
                term = np.frombuffer(raw, "<i4", n, 24 + 8 * (rows + 1))
                if start[-1] != n or (len(term) and not (0 <= term.min() and term.max() < columns)):
                    raise ValueError("not a sparse matrix")
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(rows), np.diff(start))), pa.array(term.astype(np.int64))], names=["doc_id", "term"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(parse, "doc_id long, term long")


def sparse_bytes(rows: list[list[int]], columns: int) -> bytes:
    flat = [t for r in rows for t in r]
    return struct.pack("<3q", len(rows), columns, len(flat)) + np.cumsum([0, *map(len, rows)]).astype("<i8").tobytes() + np.array(flat, "<i4").tobytes()


def read_keywords(spark: SparkSession, path: str, column: str = "top_30_keywords", n: int = 30) -> DataFrame:
    """(doc_id, ranking) with keywords as numbers: a word's number is its place in the first record, which must have ``n``."""
    rows = spark.read.schema(f"{column} array<string>").json(path)
    numbered = rows.rdd.zipWithIndex().map(lambda x: (x[1], list(x[0][0] or []))).toDF("doc_id long, words array<string>")
    first = numbered.filter("doc_id = 0").first()
    if first is None or len(set(first.words)) != n:
        raise ValueError(f"the first record must have {n} keywords")
    vocabulary = spark.createDataFrame(list(zip(first.words, range(n))), "word string, term long")
    known = numbered.select("doc_id", F.posexplode("words").alias("place", "word")).join(F.broadcast(vocabulary), "word")
    return known.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "term"))), lambda s: s["term"]).alias("ranking"))


def read_term_ids(spark: SparkSession, path: str) -> DataFrame:
    """(qid, term) of a text of whole numbers, in the order they stand in."""
    lines = spark.sparkContext.textFile(path).flatMap(str.split).zipWithIndex().map(lambda x: (x[1], int(x[0])))
    return spark.createDataFrame(lines, "qid long, term long")


def random_vectors(spark: SparkSession, n: int, d: int, seed: int = 0, normal: bool = True) -> DataFrame:
    """(doc_id, vec) of independent numbers, the same for a seed however the table is partitioned."""
    unit = lambda i, salt: (F.pmod(F.xxhash64("doc_id", i, F.lit(seed), F.lit(salt)), F.lit(2**53)) + 1) / float(2**53 + 1)
    value = (lambda i: F.sqrt(-2 * F.ln(unit(i, 1))) * F.cos(2 * np.pi * unit(i, 2))) if normal else (lambda i: unit(i, 1))
    return spark.range(n).select(F.col("id").alias("doc_id"), F.transform(F.sequence(F.lit(0), F.lit(d - 1)), lambda i: value(i).cast("float")).alias("vec"))


def synthetic(spark: SparkSession, n: int, d: int, seed: int = 1338, latent: int = 10) -> DataFrame:
    """Vectors on a curved 10-dimensional surface: the sine of a linear image of normal numbers."""
    rng = np.random.default_rng(seed)
    image, scale = rng.normal(size=(d, latent)), rng.normal(size=d) * 4 + 0.1
    matrix = F.array(*[F.array(*map(F.lit, map(float, r))) for r in image * scale[:, None] / np.sqrt(latent)])
    from tessella.functions.vectors import inner_product

    return random_vectors(spark, n, latent, seed).select("doc_id", F.transform(matrix, lambda r: F.sin(inner_product(r, "vec")).cast("float")).alias("vec"))


def smooth(spark: SparkSession, n: int, d: int, seed: int = 1234, latent: int = 8) -> DataFrame:
    """(doc_id, vec) with components between 0 and 1 that vary smoothly with a few uniform numbers: a sine of a linear image
    of them, moved and halved."""
    rng = np.random.default_rng(seed)
    matrix = F.array(*[F.array(*map(F.lit, map(float, r))) for r in rng.normal(size=(d, latent)) * 2])
    from tessella.functions.vectors import inner_product

    return random_vectors(spark, n, latent, seed, normal=False).select("doc_id", F.transform(matrix, lambda r: ((F.sin(inner_product(r, "vec")) + 1) / 2).cast("float")).alias("vec"))


def read_truth(table: DataFrame, start: int, count: int, k: int) -> DataFrame:
    """Queries start..start+count-1 of a ground truth (qid, rank, doc_id), their first ``k``; a query with fewer is an error."""
    rows = table.filter((F.col("qid") >= start) & (F.col("qid") < start + count) & (F.col("rank") <= k))
    short = rows.groupBy("qid").agg(F.count("*").alias("n")).filter(F.col("n") < k)
    if not short.isEmpty():
        raise ValueError(f"a query has fewer than {k} true neighbours")
    return rows


def write_lists(lists: DataFrame, path: str) -> None:
    """Inverted lists on disk, a folder a list: a probe reads its lists' folders alone."""
    lists.repartition("list_no").sortWithinPartitions("list_no", "doc_id").write.partitionBy("list_no").mode("errorifexists").parquet(path)


def read_lists(spark: SparkSession, *paths: str) -> DataFrame:
    """Lists on disk; of several shards, merged list by list."""
    return spark.read.parquet(paths[0]) if len(paths) == 1 else read_lists(spark, paths[0]).unionByName(read_lists(spark, *paths[1:]))


def merge_lists(spark: SparkSession, paths: list[str], path: str) -> None:
    """Shards on disk as one set of lists."""
    write_lists(read_lists(spark, *paths), path)


def scratch(spark: SparkSession) -> str:
    """A new folder that the driver and all workers see, in ``spark.checkpoint.dir``; where that is unset, a temporary one if
    Spark runs in one process, else an error."""
    import tempfile
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{(base or tempfile.gettempdir() + '/tessella-shared').rstrip('/')}/{uuid.uuid4().hex}"


def write_bytes(spark: SparkSession, path: str, raw: bytes) -> None:
    """One file through Spark's own file system."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    try:
        stream.write(bytearray(raw))
    finally:
        stream.close()


def permutation(docs: DataFrame, seed: int = 0) -> DataFrame:
    return docs.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id")


# Whole indexes: one Parquet table per part and a manifest.


def save_tables(tables: dict[str, DataFrame], path: str, version: int = 1, overwrite: bool = False, **facts) -> None:
    """Each table under its name, a ``list_no`` table dealt and sorted by list; the manifest is written last, so a folder
    without one is incomplete."""
    mode = "overwrite" if overwrite else "errorifexists"
    for name, t in tables.items():
        if "list_no" in t.columns:
            t = t.repartition("list_no").sortWithinPartitions("list_no", *(["doc_id"] if "doc_id" in t.columns else []))
        t.write.mode(mode).parquet(f"{path}/{name}")
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(json.dumps({"version": version, "tables": sorted(tables), **facts}),)], "value string").coalesce(1).write.mode(mode).text(f"{path}/manifest")


def load_tables(spark: SparkSession, path: str, version: int = 1) -> tuple[dict[str, DataFrame], dict]:
    facts = json.loads(spark.read.text(f"{path}/manifest").first().value)
    if facts["version"] != version:
        raise ValueError(f"version {facts['version']} of an index, not {version}")
    return {n: spark.read.parquet(f"{path}/{n}") for n in facts["tables"]}, facts


def load_or_build(spark: SparkSession, path: str, build, n_docs: int) -> dict[str, DataFrame]:
    """Saved tables of the same number of documents, else those that ``build()`` makes, saved."""
    from pyspark.errors import AnalysisException

    try:
        tables, facts = load_tables(spark, path)
        if facts.get("n_docs") == n_docs:
            return tables
    except AnalysisException:
        pass
    save_tables(build(), path, overwrite=True, n_docs=n_docs)
    return load_tables(spark, path)[0]


def write_csv(df: DataFrame, path: str, append: bool = False) -> None:
    """A small table as one CSV file with a header, written only once all of it is there."""
    df.coalesce(1).write.mode("append" if append else "errorifexists").option("header", True).csv(path)


class Catalogue:
    """Datasets by name; each has queries, training vectors, a database (whole or in parts) and a ground truth."""

    def __init__(self, spark: SparkSession):
        self.spark, self.tables = spark, {}

    def register(self, name: str, **parts: DataFrame) -> None:
        self.tables[name] = parts
        for part, t in parts.items():
            t.createOrReplaceTempView(f"{name}_{part}")

    def get(self, name: str, part: str = "database") -> DataFrame:
        return self.tables[name][part]

    def parts(self, name: str, count: int) -> Iterator[DataFrame]:
        for rank in range(count):
            yield self.get(name).filter(F.pmod("doc_id", F.lit(count)) == rank)
