"""Indexes fed by streams, and queries that arrive as one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessella.functions import vectors as V
from tessella.operators import maintain
from tessella.operators.search import build_lists, meet
from tessella.operators.topk import top_k


def append_lists(stream: DataFrame, centroids: DataFrame, path: str, checkpoint: str, metric: str = "inner_product") -> StreamingQuery:
    """Documents of a stream assigned and appended to the lists at ``path``, a folder per batch: a repeated batch writes
    the same folder again, so nothing is there twice."""

    def write(batch: DataFrame, number: int) -> None:
        build_lists(batch, centroids, metric).write.mode("overwrite").parquet(f"{path}/slice_id={number}")

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()


def read_lists(spark: SparkSession, path: str, newest: int | None = None, kept: int | None = None) -> DataFrame:
    """All slices, or the ``kept`` newest up to ``newest``: a FIFO window over the stream."""
    lists = spark.read.parquet(path)
    return lists if newest is None or kept is None else maintain.window(lists, newest, kept)


def search_stream(queries: DataFrame, docs: DataFrame, k: int, sink: str, checkpoint: str, metric: str = "inner_product") -> StreamingQuery:
    """Each batch of queries against a static table, results appended as Parquet."""

    def run(batch: DataFrame, number: int) -> None:
        rows = meet(docs, batch.select("qid", "qvec")).select("qid", "doc_id", V.distance(metric, "qvec", "vec").alias("score"))
        top_k(rows, k, V.is_similarity(metric)).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return queries.writeStream.option("checkpointLocation", checkpoint).foreachBatch(run).trigger(availableNow=True).start()


def distinct_codes(stream: DataFrame, code: str = "code") -> DataFrame:
    """The first row of each code of a stream."""
    return stream.dropDuplicates([code])


def windowed_counts(stream: DataFrame, time: str, width: str, late: str, key: str) -> DataFrame:
    return stream.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count("*").alias("n"))
