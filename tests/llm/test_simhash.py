import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.llm.simhash import SKETCH, GrayIndex, _masks, fingerprint_hex, gray_rank, hamming_links, keep_one, may_reach, near_duplicates, similar_documents


def brute_print(text, k=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split(r"[\x20\x09-\x0d]+", low) if w]
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_gray_rank_orders_the_reflected_sequence():
    i = np.arange(1000, dtype=np.uint64)
    assert (gray_rank(i ^ (i >> np.uint64(1))) == i).all()


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.sets(st.integers(0, 63), max_size=6)), max_size=90))
def test_index_finds_the_components_of_all_pairs(rows):
    base = [x * 0x9E3779B97F4A7C15 % 2**64 for x in range(6)]
    fps = sorted({base[b] ^ sum(1 << i for i in flips) for b, flips in rows})
    got = GrayIndex(np.array(fps, np.uint64), fan=3).components(4, chunk=7)
    assert got.tolist() == brute_components(fps)


@given(st.integers(0, 2**64 - 1), st.sets(st.integers(0, 63), max_size=4))
def test_words_within_the_limit_share_a_group_at_every_depth(word, flips):
    other = word ^ sum(1 << i for i in flips)
    for depth in (1, 2, 3):
        assert any((word ^ other) & m % 2**64 == 0 for m in _masks(4, depth))


@pytest.mark.parametrize("group", [50_000, 3])
def test_near_duplicates_match_all_pairs(spark, sf, group):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(150)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rows += [(10**6 + i, t) for i, t in enumerate([None, "", " \t", "one", "One two", "one two", "É a b c d"])]
    rows += [(10**7 + i, (rows[7][1] + f" extra{i}")) for i in range(30)]
    rows += [rows[0], (None, rows[1][1])]
    frame = spark.createDataFrame([(a, b, 1, "x") for a, b in rows], "doc_id long, text string, fp int, component_id string")
    got = near_duplicates(frame, group=group).withColumn("hex", fingerprint_hex()).collect()
    prints = [brute_print(t) for _, t in rows]
    parts = brute_components(prints)
    least = {}
    for (doc, _), p in zip(rows, parts):
        if doc is not None:
            least[p] = min(least.get(p, doc), doc)
    want = sorted((doc if doc is not None else -1, f"{f:016x}", least[p]) for (doc, _), f, p in zip(rows, prints, parts))
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.hex, r.component_id) for r in got) == want


def test_chain_reaches_its_far_end(spark):
    fps = [sum(1 << b for b in range(3 * i)) for i in range(20)]
    frame = spark.createDataFrame([(f,) for f in fps], "fp long")
    from tessella.llm.simhash import components

    rows = components(hamming_links(frame)).collect()
    assert {r.root for r in rows} == {0} and len(rows) == 20


def test_empty(spark):
    frame = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(frame).count() == 0
    assert keep_one(frame).count() == 0


def test_keep_one(spark):
    frame = spark.createDataFrame([(2, "a b c d e f", 1), (1, "a b c d e f", 2), (1, "a b c d e f", 1), (5, "x y z", 3)], "doc_id long, text string, other int")
    assert sorted((r.doc_id, r.other) for r in keep_one(frame).collect()) == [(1, 1), (5, 3)]


def jaccard(a, b, k=5):
    sets = []
    for text in (a, b):
        words = text.lower().split()
        sets.append({tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))})
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_similar_documents_meet_and_others_do_not(spark):
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 5))
    rows, same = [], []
    for i in range(0, 600, 2):
        text = [word() for _ in range(300)]
        other = list(text)
        for at in rng.choice(300, 4, replace=False):
            other[at] = word()
        rows += [(i, " ".join(text)), (i + 1, " ".join(other))]
        same.append(jaccard(*[r[1] for r in rows[-2:]]))
    assert min(same) >= 0.8
    got = {r.doc_id: r.component_id for r in similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert np.mean([got[i + 1] == i for i in range(0, 600, 2)]) >= 0.97
    assert all(got[i] == i for i in range(0, 600, 2))


def test_a_large_group_of_near_copies_stays_small(spark):
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join([*base[:-1], f"x{i}"])) for i in range(3000)] + [(5000, "another text of its own with a few words")]
    kept = keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 5000]


def test_rows_without_id_stay(spark):
    frame = spark.createDataFrame([(None, "a b"), (None, "a b"), (1, "a b")], "doc_id long, text string")
    assert keep_one(frame).count() == 3


def test_links_below_the_similarity_are_not_made(spark):
    """At 0.7 half the pairs differ in at most 24 of 128 bits; none may be linked, alone or through a common neighbour."""
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 5))
    rows = []
    for i in range(0, 400, 2):
        text = [word() for _ in range(300)]
        other = list(text)
        for at in range(20, 300, 24):
            other[at] = word()
        rows += [(i, " ".join(text)), (i + 1, " ".join(other))]
        assert 0.6 < jaccard(*[r[1] for r in rows[-2:]]) < 0.8
    got = similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 400 and all(r.doc_id == r.component_id for r in got)


def test_components_are_those_of_all_similar_pairs(spark):
    """Chains of texts at 0.85 from step to step, far less from end to end, and a repeated line, which counts once."""
    rng = np.random.default_rng(6)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 5))
    rows = []
    for c in range(12):
        text = [word() for _ in range(300)]
        for step in range(6):
            rows.append((100 * c + step, " ".join(text)))
            for at in range(10 + step, 300, 60):
                text[at] = word()
    line = " ".join(word() for _ in range(12))
    for i, words in enumerate((3, 60)):
        rows.append((5000 + i, " ".join([line] * 200 + [word() for _ in range(words)])))
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if jaccard(rows[i][1], rows[j][1]) >= 0.8:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    got = {r.doc_id: r.component_id for r in similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {rows[i][0]: rows[r][0] for i, r in enumerate(root)}


def test_unlike_texts_under_one_id_both_stay(spark):
    one, two, three = (" ".join(f"{w}{i}" for i in range(40)) for w in "abc")
    rows = [(1, one, {"k": 1}, 7), (1, two, {"k": 2}, 7), (1, two, {"k": 2}, 7), (2, one, None, 8), (3, three, {}, 9), (None, one, {}, 0)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, label map<string,int>, __own int")
    got = keep_one(frame)
    assert got.columns == frame.columns
    assert sorted((r.doc_id or 0, r.text[0]) for r in got.collect()) == [(0, "a"), (1, "a"), (1, "b"), (3, "c")]


def test_groups_dealt_into_blocks_lose_no_link(spark):
    """The same components whether groups are whole or in blocks of 16, with null, blank and very long texts among them."""
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 5))
    base = [word() for _ in range(120)]
    rows = [(900, None), (901, " "), (902, ""), (903, " ".join(word() for _ in range(30_000)))]
    for i in range(120):
        text = list(base)
        for at in rng.choice(120, 1 + i % 4, replace=False):
            text[at] = word()
        rows.append((i, " ".join(text)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    whole, blocks = ({r.doc_id: r.component_id for r in similar_documents(frame, block=b).collect()} for b in (20_000, 16))
    assert whole == blocks and whole[901] == whole[902] == 900 and whole[903] == 903


def test_sketches_never_rule_out_a_similar_pair():
    rng = np.random.default_rng(9)
    for n in (3, 40, 60_000):
        counts = [np.bincount(rng.integers(0, SKETCH, n), minlength=SKETCH) for _ in range(2)]
        a, b = (np.minimum(c, 255).astype(np.uint8)[None] for c in counts)
        most = np.minimum(*counts).sum()
        assert may_reach(a, b, np.array([n]), np.array([n]), most / (2 * n - most))[0]


def test_near_duplicates_of_long_texts_beside_clashing_columns(spark):
    """A text of 20,000 words, its copy and a near copy; columns named as the result's and as those used inside."""
    rng = np.random.default_rng(11)
    long = [f"w{i}" for i in rng.integers(0, 5000, 20_000)]
    near = [*long[:-1], "other"]
    rows = [(5, " ".join(long), 1, "a", 2), (9, " ".join(long), 1, "b", 2), (7, " ".join(near), 1, "c", 2), (1, None, 1, "d", 2)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, fp int, component_id string, node int")
    got = {r.doc_id: r for r in near_duplicates(frame).collect()}
    assert got[5].fp == got[9].fp and got[5].component_id == got[7].component_id == got[9].component_id == 5
    assert got[1].component_id == 1 and got[1].fp == 0
    kept = keep_one(frame)
    assert kept.columns == frame.columns and sorted(r.doc_id for r in kept.collect()) == [1, 5]
