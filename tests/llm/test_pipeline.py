import re

import corpus_pipeline as pipe
from tessella.llm import toxicity


def test_stages_work_on_what_the_one_before_kept(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = [docs.persist()]
    for _, step in pipe.STAGES[:-1]:
        kept.append(step(spark, kept[-1], sf).persist())
        assert kept[-1].columns == docs.columns
    ids = [{r.doc_id for r in k.select("doc_id").collect()} for k in kept]
    assert all(b <= a for a, b in zip(ids, ids[1:]))
    toxic = [d for d in ids[0] if d in labels and labels[d].toxic]
    clean = [d for d in ids[0] if d in labels and not labels[d].toxic and labels[d].quality]
    assert sum(d in ids[1] for d in toxic) <= 0.3 * len(toxic)  # some 45 toxic labels to learn from
    assert sum(d in ids[1] for d in clean) >= 0.95 * len(clean)
    poor = [d for d in ids[1] if d in labels and not labels[d].quality]
    good = [d for d in ids[1] if d in labels and labels[d].quality]
    assert sum(d in ids[2] for d in poor) <= 0.35 * len(poor)
    assert sum(d in ids[2] for d in good) >= 0.97 * len(good)
    groups = {}
    for r in kept[2].collect():
        groups.setdefault(" ".join(r.text.split()).lower(), []).append(r.doc_id)
    assert all(len(set(g) & ids[3]) <= 1 for g in groups.values())
    secret = re.compile(r"AKIA[A-Z0-9]{16}|password=[0-9a-f]{18}")
    assert ids[4] == ids[3] and not any(secret.search(r.text) for r in kept[4].collect())
    packed = pipe.STAGES[-1][1](spark, kept[4], sf).collect()
    assert {r.doc_id for r in packed} == ids[4]


def test_without_labels_or_documents(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "a b c", "en", "s", 5), (2, None, None, None, None)], schema).write.parquet(f"{tmp_path}/documents.parquet")
    assert pipe.run(spark, str(tmp_path)).count() == 2
    for _, step in pipe.STAGES:
        assert step(spark, spark.createDataFrame([], schema), str(tmp_path)).count() == 0
    assert toxicity.BITS and pipe.ORACLE_SQL is None
