import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.plans.factory import code_size, parse, reverse
from tessella.plans.index import Index
from tessella.sources import files
from tessella.streaming import lists as streams
from tessella.operators import cluster


@pytest.fixture(scope="module")
def docs(spark):
    return files.random_vectors(spark, 200, 8, seed=1).persist()


@pytest.mark.parametrize("kind", ["fvecs", "ivecs", "bvecs"])
def test_vecs_round_trip(spark, tmp_path, kind):
    vec = F.array(*[((F.col("id") + i) % 200).cast("float" if kind == "fvecs" else "int") for i in range(5)])
    table = spark.range(50).select(F.col("id").alias("doc_id"), vec.alias("vec"))
    files.write_vecs(table.repartition(3), str(tmp_path / "v"), kind)
    again = files.read_vecs(spark, str(tmp_path / "v"), kind)
    assert [list(r.vec) for r in again.orderBy("doc_id").collect()] == [list(r.vec) for r in table.orderBy("doc_id").collect()]


def test_sparse_matrix(spark, tmp_path):
    path = tmp_path / "m.spmat"
    path.write_bytes(files.sparse_bytes([[1], [1, 2], [], [2]], 3))
    assert sorted(map(tuple, files.read_sparse(spark, str(path)).collect())) == [(0, 1), (1, 1), (1, 2), (3, 2)]
    path.write_bytes(files.sparse_bytes([[7]], 3))
    with pytest.raises(Exception, match="not a sparse matrix"):
        files.read_sparse(spark, str(path)).collect()


def test_keywords_and_terms(spark, tmp_path):
    words = [f"w{i}" for i in range(30)]
    path = tmp_path / "k.jsonl"
    path.write_text("\n".join(json.dumps({"top_30_keywords": words[i:] + words[:i]}) for i in (0, 10, 20)))
    got = {r.doc_id: r.ranking for r in files.read_keywords(spark, str(path)).collect()}
    assert got[0] == list(range(30)) and got[1][:2] == [10, 11]
    text = tmp_path / "t.txt"
    text.write_text("0 4\n7")
    assert [tuple(r) for r in files.read_term_ids(spark, str(text)).orderBy("qid").collect()] == [(0, 0), (1, 4), (2, 7)]


def test_generated_vectors_do_not_depend_on_partitions(spark):
    a = files.random_vectors(spark, 100, 4, 3).orderBy("doc_id").collect()
    b = files.random_vectors(spark, 100, 4, 3).repartition(7).orderBy("doc_id").collect()
    assert a == b
    x = np.array([r.vec for r in files.random_vectors(spark, 4000, 4, 3).collect()])
    assert abs(x.mean()) < 0.05 and abs(x.std() - 1) < 0.05
    assert len(files.synthetic(spark, 10, 6).first().vec) == 6
    assert files.permutation(spark.range(9).withColumnRenamed("id", "doc_id")).count() == 9


def test_tables_and_manifest(spark, docs, tmp_path):
    path = str(tmp_path / "index")
    calls = []

    def build():
        calls.append(1)
        return {"docs": docs}

    assert files.load_or_build(spark, path, build, 200)["docs"].count() == 200
    files.load_or_build(spark, path, build, 200)
    assert len(calls) == 1
    files.load_or_build(spark, path, build, 201)
    assert len(calls) == 2
    with pytest.raises(ValueError):
        files.load_tables(spark, path, version=9)
    files.write_csv(docs.select("doc_id").limit(3), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 3


def test_catalogue(spark, docs):
    c = files.Catalogue(spark)
    c.register("toy", database=docs, queries=docs.limit(2))
    assert sum(p.count() for p in c.parts("toy", 3)) == 200 and spark.table("toy_queries").count() == 2


@pytest.mark.parametrize("text", ["Flat", "IVF64,Flat", "PCAR16,IVF4,SQ8", "OPQ4_8,IVF16,PQ4x4", "IDMap,Flat", "IVF8,PQ4,RFlat", "IVF8,Flat,Refine(SQ8)", "IMI2x2,PQ4", "LSH16r", "RQ3x4", "PRQ2x2x4", "HNSW32", "BHash8", "RaBitQ", "L2norm,Flat", "Pad16,Flat", "ZnLattice2x10_6", "IVF4,SQfp16"])
def test_descriptions_round_trip(text):
    spec = parse(text)
    assert parse(reverse(spec)) == spec
    assert spec.binary or code_size(spec, 16) > 0 or spec.codec[0] == "hash"


def test_descriptions_say_what_they_mean():
    assert parse("IVF2k,Flat").coarse[1][0] == 2048
    assert parse("IVF8_HNSW16,PQ4").coarse == ("ivf", (8, "HNSW", 16))
    with pytest.raises(ValueError):
        parse("IVF8,Nonsense")


@pytest.mark.parametrize("text, least", [("Flat", 1.0), ("IVF4,Flat", 1.0), ("SQ8", 0.9), ("PCA6,Flat", 0.5), ("IVF4,PQ4x4,RFlat", 0.8), ("RQ4x4", 0.3), ("IMI2x1,Flat", 1.0), ("HNSW16", 1.0), ("RR,SQfp16", 0.9)])
def test_indexes_find_neighbours(spark, docs, text, least):
    queries = docs.limit(6).select(F.col("doc_id").alias("qid"), F.col("vec").alias("qvec"))
    index = Index(text, exact_graphs=True).train(docs, rounds=3).add(docs)
    got = {(r.qid, r.doc_id) for r in index.search(queries, 5, nprobe=4).collect()}
    want = {(r.qid, r.doc_id) for r in Index("Flat").train(docs).add(docs).search(queries, 5).collect()}
    assert len(got & want) >= least * len(want)


def test_index_changes_and_saving(spark, docs, tmp_path):
    index = Index("IVF3,Flat").train(docs, rounds=2).add(docs)
    gone = docs.filter("doc_id < 10").select("doc_id")
    assert index.remove(gone).vectors().count() == 190
    assert index.update(docs.filter("doc_id < 20")).vectors().count() == 200
    index.save(str(tmp_path / "i"))
    again = Index.load(spark, str(tmp_path / "i"))
    queries = docs.limit(3).select(F.col("doc_id").alias("qid"), F.col("vec").alias("qvec"))
    assert again.search(queries, 4, 3).exceptAll(index.search(queries, 4, 3)).count() == 0
    assert index.range_search(queries, 1e9, 3).count() == 600
    assert index.assign(queries).filter("qid = doc_id").count() == 3
    assert np.allclose([r.vec for r in Index("RR,Flat").train(docs).add(docs).reconstruct().orderBy("doc_id").collect()], [r.vec for r in docs.orderBy("doc_id").collect()], atol=1e-5)


def test_streams(spark, docs, tmp_path):
    source = str(tmp_path / "in")
    docs.repartition(2).write.parquet(source)
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(source)
    centroids = cluster.first_centroids(docs, 3)
    streams.append_lists(stream, centroids, str(tmp_path / "lists"), str(tmp_path / "c1")).awaitTermination()
    every = streams.read_lists(spark, str(tmp_path / "lists"))
    assert every.count() == 200 and every.select("slice_id").distinct().count() == 2
    assert 0 < streams.read_lists(spark, str(tmp_path / "lists"), newest=1, kept=1).count() < 200
    docs.limit(4).select(F.col("doc_id").alias("qid"), F.col("vec").alias("qvec")).write.parquet(str(tmp_path / "asked"))
    asked = spark.readStream.schema("qid long, qvec array<float>").parquet(str(tmp_path / "asked"))
    streams.search_stream(asked, docs, 3, str(tmp_path / "found"), str(tmp_path / "c2")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "found")).count() == 12
    codes = streams.distinct_codes(stream.selectExpr("doc_id % 7 as code"))
    q = codes.writeStream.format("memory").queryName("codes").option("checkpointLocation", str(tmp_path / "c3")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("codes").count() == 7


@pytest.mark.parametrize("kind", ["fvecs", "ivecs"])
def test_vecs_of_many_files_are_read_by_name(spark, tmp_path, kind):
    number = np.dtype("<f4" if kind == "fvecs" else "<i4")
    for part in reversed(range(40)):
        rows = [np.array([part * 3 + i] * 2).astype(number).tobytes() for i in range(3)]
        (tmp_path / f"part-{part:05d}.{kind}").write_bytes(b"".join(np.array([2], "<i4").tobytes() + r for r in rows))
    assert [(r.doc_id, list(r.vec)) for r in files.read_vecs(spark, str(tmp_path), kind).orderBy("doc_id").collect()] == [(i, [i, i]) for i in range(120)]
