import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from tessella.llm import langid

PATH = public_tokenizers.path("piece_bpe_32k.model")


def brute(word, pieces, p, unknown):
    """Sum over all segmentations, one by one."""
    if not word:
        return 1.0
    total = 0.0
    for size in range(1, min(len(word), 3) + 1):
        head = word[:size]
        if head in pieces:
            total += p[pieces.index(head)] * brute(word[size:], pieces, p, unknown)
        elif size == 1:
            total += unknown * brute(word[1:], pieces, p, unknown)
    return total


def test_forward_sums_all_segmentations():
    pieces = ["▁", "▁a", "a", "b", "ab", "▁ab", "ba", "aba"]
    p = np.linspace(0.05, 0.2, len(pieces))
    table = np.concatenate([p, [0.01, 0.0]])[:, None]
    words = ["abaab", "b", "xab", "aaaaaaaaaaaa"]
    got = {}
    for at, lattice in langid._lattices(pa.array(words), langid._hashes(pieces), 3):
        for i, x in zip(at, np.exp(lattice.log_sum(table)[:, 0])):
            got[words[i]] = x
    for w in words:
        assert got[w] == pytest.approx(brute("▁" + w, pieces, p, 0.01))


def test_long_words_are_summed_whole():
    """One character more of a word that one piece spells costs that piece, however long the word is; sums don't vanish."""
    table = np.array([[0.1], [0.01], [0.0]])
    got = {}
    words = ["a" * n for n in (30, 31, 32, 33, 3000)]
    for at, lattice in langid._lattices(pa.array(words), langid._hashes(["a"]), 16):
        got |= {words[i]: x for i, x in zip(at, lattice.log_sum(table)[:, 0])}
    for w in words:
        assert got[w] == pytest.approx(np.log(0.01) + len(w) * np.log(0.1))


@pytest.mark.parametrize("word", ["abab", "abababa" * 12])
def test_expected_counts_match_forward_differences(word):
    pieces = ["▁", "a", "b", "ab", "▁a"]
    table = np.concatenate([np.linspace(0.1, 0.3, 5), [0.01, 0.0]])[:, None]
    (_, lattice), = langid._lattices(pa.array([word]), langid._hashes(pieces), 2)
    got = lattice.expected(table, np.ones((1, 1)))[:, 0]
    base = lattice.log_sum(table)[0, 0]
    for k in range(5):
        more = table.copy()
        more[k] *= 1 + 1e-6
        slope = (lattice.log_sum(more)[0, 0] - base) / 1e-6
        assert got[k] == pytest.approx(slope, abs=1e-3)


def test_words_are_runs_of_letters():
    counts, flat = langid.words_of(pa.array(["Ab c-d1é", None, "12 !", "ÉÀ"]))
    assert counts.tolist() == [4, 0, 0, 1] and flat.to_pylist() == ["ab", "c", "d", "é", "éà"]


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.identify(docs, PATH).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(rows) > 100
    assert np.mean([r.lang_pred == r.lang for r in rows]) >= 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_edge_rows(spark):
    rows = [(i, t, l, 0.5) for i, (t, l) in enumerate([("the house and the tree", "en"), ("das haus und der baum", "de")] * 20)]
    rows += [(100, None, "en", 1.0), (101, "12 34", "en", 1.0), (None, "the house", None, 1.0), (102, "", None, 1.0), (103, "the " * 5 + "x" * 3000, "en", 1.0), (103, "und der baum", "en", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    got = langid.identify(docs, PATH).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[100].lang_pred == by[101].lang_pred == by[102].lang_pred == "und"
    assert by[0].lang_pred == "en" and by[1].lang_pred == "de" and by[None].lang_pred == "en"
    assert {r.lang_pred for r in langid.identify(docs.withColumn("lang", docs.lang.substr(9, 0)).filter("doc_id < 0"), PATH).collect()} == set()


def test_a_repeated_row_cannot_fill_the_sample(spark):
    rows = [(7, "the house", "en")] * 300 + [(i, f"das haus {i}", "de") for i in range(300)] + [(i, f"the tree {i}", "en") for i in range(300, 600)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.learning_rows(frame, per_lang=100).groupBy("lang").count().collect()
    assert {r.lang for r in got} == {"de", "en"} and all(60 <= r["count"] <= 140 for r in got)
    assert langid.learning_rows(frame, per_lang=10_000).count() == 601


def test_ties_go_to_the_language_that_sorts_first(spark):
    rows = [(i, "la casa e la rosa", ("it", "es")[i % 2]) for i in range(40)] + [(50, "la casa " * 5000, None)]
    got = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), PATH).collect()
    learned = langid.fit(spark.createDataFrame([(1, "la casa", "it"), (2, "la casa", "es")], "doc_id long, text string, lang string"), PATH)
    assert learned.langs == ["es", "it"]
    tied = langid.predict(spark.createDataFrame([(1, "la casa"), (1, "la casa")], "doc_id long, text string"), learned).collect()
    assert [(r.lang_pred, round(r.score, 6)) for r in tied] == [("es", 0.5)] * 2 and len(got) == 41
