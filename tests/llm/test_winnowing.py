import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessella.llm import winnowing as W


def brute(text, k=3, w=5):
    import re

    tokens = [t for t in re.findall(r"[^\x20\x09-\x0d]{1,16}", (text or "").lower())]
    h = [np.int64(np.uint64(xxhash.xxh64_intdigest(t.encode(), 42))).item() % W.MODULUS for t in tokens]
    spans = [h[i : i + k] for i in range(len(h) - k + 1)] or ([h] if h else [])
    grams = []
    for span in spans:
        total = 0
        for x in span:
            total = (total * W.BASE + x) % W.MODULUS
        grams.append(total)
    w = min(w, len(grams))
    chosen = set()
    for a in range(len(grams) - w + 1 if grams else 0):
        least = min(grams[a : a + w])
        chosen.add(max(i for i in range(a, a + w) if grams[i] == least))
    return sorted(chosen), [grams[i] for i in sorted(chosen)]


def test_fingerprints_match_the_definition(spark, sf):
    rng = random.Random(3)
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").limit(40).collect()]
    texts += [None, "", "  \n", "one", "One two", "a b c", "a a a a a a a a a a a a", "x" * 100] + [" ".join(rng.choice("ab") for _ in range(rng.randint(1, 30))) for _ in range(60)]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    for r in W.fingerprint(frame, "text", "fp").collect():
        assert (r.fp_positions, r.fp_hashes) == brute(texts[r.id]), texts[r.id]


def test_shared_runs_share_a_fingerprint(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows = []
    for i in range(40):
        run = [word() for _ in range(7)]
        rows += [(i, " ".join([word() for _ in range(rng.randint(0, 9))] + run + [word() for _ in range(rng.randint(0, 9))])) for _ in range(2)]
    got = {}
    for r in W.fingerprint(spark.createDataFrame(rows, "id int, text string"), "text", "fp").collect():
        got.setdefault(r.id, []).append(set(r.fp_hashes))
    assert all(a & b for a, b in got.values())


def like(a, b):
    a, b = set(a), set(b)
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.mark.parametrize("per_range", [2048, 5])
def test_compare_edited_matches_brute_force(spark, sf, per_range):
    rows = [(r.doc_id * 7 % 1009, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()]
    rows += [(2000, None), (2001, ""), (2002, "é🙂 x y z w"), (2003, "q")]
    frame = spark.createDataFrame([(a, b, "z") for a, b in rows], "doc_id long, text string, lent string")
    got = {r.doc_id: r for r in W.compare_edited(frame, per_range=per_range).collect()}
    order = sorted(rows)
    assert len(got) == len(rows)
    for (doc, text), (_, following) in zip(order, order[1:] + order[:1]):
        text, following = text or "", following or ""
        m = len(text) // 2
        edited = text[: len(text) - m] + following[:m]
        r = got[doc]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.own_hashes == brute(text)[1] and r.edited_hashes == brute(edited)[1]
        assert r.near_edited == pytest.approx(like(brute(text)[1], brute(edited)[1]))
        assert r.near_next == pytest.approx(like(brute(text)[1], brute(following)[1]))


def test_edge_rows(spark):
    frame = spark.createDataFrame([(None, "a b c d"), (1, "b"), (1, "a a"), (2, "z z z z")], "doc_id long, text string")
    rows = W.compare_edited(frame).collect()
    assert len(rows) == 4
    alone = next(r for r in rows if r.doc_id is None)
    assert alone.near_next == 0 and alone.edited_sha256 == hashlib.sha256(b"a b ").hexdigest()
    assert next(r for r in rows if r.doc_id == 2).edited_sha256 == hashlib.sha256(b"z z a a").hexdigest()
    assert W.compare_edited(frame.limit(0)).count() == 0
    assert W.compare_edited(frame.filter("doc_id = 2")).first().near_next == 1


def test_the_query_gives_places_and_a_long_text_has_them(spark, tmp_path):
    """Each place's k-gram has the fingerprint's hash at the same position in the list; texts of 20,000 words, columns that clash."""
    from tessella.llm import registry

    long = " ".join(f"w{i % 977}" for i in range(20_000))
    rows = [(1, long, 5, "x"), (2, None, 0, "y"), (3, "one two three four", 18, "z"), (3, "one two three four", 18, "z")]
    spark.createDataFrame(rows, "doc_id long, text string, n_chars long, range string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in registry.op5_winnow(spark, str(tmp_path)).collect()}
    assert len(got[1].positions.split()) == len(got[1].fingerprint.split()) > 3000
    assert got[2].positions == "" and got[3].positions.split() and [int(p) for p in got[1].positions.split()] == sorted(int(p) for p in got[1].positions.split())
