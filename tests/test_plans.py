import pytest
from pyspark.sql import functions as F

from tessella.plans import config, offline
from tessella.sources.files import random_vectors


def test_settings_are_checked(tmp_path):
    assert config.BuildSettings.of({"method": "aware", "alpha": 0.5, "beta": 0.1}).rounds == 10
    path = tmp_path / "m.json"
    path.write_text('{"k": 5}')
    assert config.MeasureSettings.read(str(path)).k == 5
    for kind, bad in (
        (config.BuildSettings, {"colour": 1}),
        (config.BuildSettings, {"method": "plain", "alpha": 1.0}),
        (config.BuildSettings, {"method": "exact", "beta": 1.0}),
        (config.DatasetSettings, {"name": "x"}),
        (config.MeasureSettings, {"least_runs": 9, "most_runs": 3}),
        (config.TuneSettings, {"step": 1.0}),
    ):
        with pytest.raises(ValueError):
            kind.of(bad)
    config.disjoint(config.FIT, config.VALIDATION, config.TEST)
    with pytest.raises(ValueError):
        config.disjoint(range(0, 5), range(4, 6))


def test_offline_run(spark, tmp_path):
    docs = random_vectors(spark, 120, 4, seed=2)
    docs = docs.unionByName(docs.limit(5).withColumn("doc_id", F.col("doc_id") + 1000)).persist()
    queries = docs.filter("doc_id < 5").select(F.col("doc_id").alias("qid"), F.col("vec").alias("qvec"))
    report = offline.run(docs, queries, str(tmp_path), 4, 5, 4, shards=2, rounds=2)
    assert report.duplicates == 5 and report.recall == 1 and report.lists.count() == 120
    bad = docs.limit(1).withColumn("vec", F.array(*[F.lit(float("nan")).cast("float")] * 4))
    with pytest.raises(ValueError):
        offline.run(bad, queries, str(tmp_path / "x"), 1, 1, 1)
