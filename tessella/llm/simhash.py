"""SimHash near-duplicates: fingerprints, an exact Hamming search by a Gray-order hierarchical index, components."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import discard, slices, stage, starts_of, tokens

#: Shingles hashed at a time.
CHUNK = 1 << 18


def _shingle_bounds(counts: np.ndarray, flat: pa.StringArray, k: int):
    """Joined words of all texts as bytes; start, end and text of each shingle."""
    length = pc.binary_length(flat).to_numpy(zero_copy_only=False).astype(np.int64)
    word_at = np.arange(len(length), dtype=np.int64)
    first = starts_of(counts)
    start = starts_of(length)[:-1] + word_at  # every word is followed by one space
    data = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat), " ")[0].as_buffer() if len(flat) else pa.py_buffer(b"")
    shingles = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    owner = np.repeat(np.arange(len(counts)), shingles)
    begin = np.arange(len(owner), dtype=np.int64) - starts_of(shingles)[owner] + first[owner]
    last = begin + np.minimum(counts[owner], k) - 1
    return data, start[begin], start[last] + length[last], owner


def _shingle_hashes(texts: pa.Array, k: int, seed: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """XXH64 of every shingle and the text it is of, CHUNK at a time."""
    from xxhash import xxh64_intdigest

    counts, flat = tokens(texts)
    data, start, end, owner = _shingle_bounds(counts, flat, k)
    view = memoryview(data)
    for a in range(0, len(owner), CHUNK):
        own = owner[a : a + CHUNK]
        yield np.fromiter((xxh64_intdigest(view[i:j], seed) for i, j in zip(start[a : a + CHUNK].tolist(), end[a : a + CHUNK].tolist())), np.uint64, len(own)), own


def _majority(hashes: Iterator[tuple[np.ndarray, np.ndarray]], n: int) -> np.ndarray:
    """For each of ``n`` texts, the bits that more than half its hashes set."""
    ones, total = np.zeros((n, 64), np.int64), np.zeros(n, np.int64)
    for h, own in hashes:
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        cuts = np.flatnonzero(np.diff(own, prepend=-1))
        ones[own[cuts]] += np.add.reduceat(bits, cuts, axis=0, dtype=np.int32)
        total += np.bincount(own, minlength=n)
    return np.packbits(2 * ones > total[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def fingerprints(texts: pa.Array, k: int = 4, seed: int = 42) -> np.ndarray:
    """SimHash of each text over word ``k``-shingles: a bit is 1 if more than half the shingles' XXH64 set it."""
    return _majority(_shingle_hashes(texts, k, seed), len(texts))


def shingle_sets(texts: pa.Array, k: int = 5, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """The set of each text's word ``k``-shingles: their distinct XXH64 in order, and where each text's begin and end."""
    found = list(_shingle_hashes(texts, k, seed))
    h = np.concatenate([np.empty(0, np.uint64), *[x for x, _ in found]])
    owner = np.concatenate([np.empty(0, np.int64), *[x for _, x in found]])
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return h[new], starts_of(np.bincount(owner[new], minlength=len(texts)))


def _named(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set."""
    from xxhash import xxh3_64_intdigest

    return np.fromiter((xxh3_64_intdigest(h[a:b].tobytes()) for a, b in zip(at[:-1].tolist(), at[1:].tolist())), np.uint64, len(at) - 1).view(np.int64)


def with_set_prints(docs: DataFrame, k: int = 5) -> DataFrame:
    """``doc_id``, ``text_hash``, ``node`` (the name of the text's shingle set), ``n`` (its size) and ``fp``, ``fp1`` (its
    SimHash in 128 bits) of every row. A shingle that a text repeats counts once, as it does in the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            h, at = shingle_sets(batch.column("text"), k)
            size = np.diff(at)
            owner = np.repeat(np.arange(len(size)), size)
            # a one-to-one mixing of the hashes gives the second word its bits
            mixed = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            mixed ^= mixed >> np.uint64(31)
            words = [_majority(((x[a : a + CHUNK], owner[a : a + CHUNK]) for a in range(0, len(x), CHUNK)), len(size)).view(np.int64) for x in (h, mixed)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), *map(pa.array, (_named(h, at), size, *words))], names=["doc_id", "text_hash", "node", "n", "fp", "fp1"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("text_hash"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, node long, n long, fp long, fp1 long")


def text_hash() -> Column:
    """With the doc_id it names a row by its id and text."""
    return F.xxhash64(F.col("text").cast("string"))


def _with_keys(docs: DataFrame, keys: DataFrame, how: str, most: int = 2_000_000) -> DataFrame:
    """Rows of ``docs`` that have (semi join) or lack (anti join) their (doc_id, text_hash) in ``keys``, a staged table. Up to
    ``most`` keys are broadcast, 16 bytes each, and the texts aren't moved; more are joined by a shuffle."""
    few = keys.count() <= most
    same = (F.col("doc_id").cast("long") == keys["doc_id_key"]) & (text_hash() == keys["text_key"])
    return docs.join(F.broadcast(keys) if few else keys.hint("merge"), same, how)


def _as_keys(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("doc_id").alias("doc_id_key"), F.col("text_hash").alias("text_key"))


def with_sets(docs: DataFrame, k: int = 5) -> DataFrame:
    """``node`` and ``set`` (the hashes of all its shingles) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            h, at = shingle_sets(batch.column("text"), k)
            yield pa.RecordBatch.from_arrays([pa.array(_named(h, at)), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(h.view(np.int64)))], names=["node", "set"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "node long, set array<long>")


def with_fingerprints(docs: DataFrame, k: int = 4, seeds: tuple[int, ...] = (42,)) -> DataFrame:
    """``doc_id`` and ``fp`` (the fingerprint's bits as a long; for further seeds ``fp1`` and so on) of every row. Null and
    blank texts have fingerprint 0."""
    names = ["doc_id", "fp", *[f"fp{i}" for i in range(1, len(seeds))]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(fingerprints(batch.column("text"), k, seed).view(np.int64)) for seed in seeds]], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, ", ".join(f"{n} long" for n in names))


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each 64-bit word in the reflected Gray sequence."""
    for s in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(s))
    return x


class GrayIndex:
    """Distinct fingerprints in Gray order under a tree of ``fan`` children per node.

    A node keeps the bits on which all fingerprints under it agree, as a mask and a value. Two nodes differ by at least
    the number of differing bits in both masks; going down, only bits that the parents' masks lacked are counted, and
    added to what the parents differ by. Where the sum passes the limit, the two whole groups are left.
    """

    def __init__(self, fps: np.ndarray, fan: int = 8):
        self.fan = fan
        self.order = np.argsort(gray_rank(fps), kind="stable")
        value = fps[self.order]
        self.value, self.mask = [value], [np.full(len(value), ~np.uint64(0))]
        low, high = value, value
        while len(low) > 1:
            cuts = np.arange(0, len(low), fan)
            low, high = np.bitwise_and.reduceat(low, cuts), np.bitwise_or.reduceat(high, cuts)
            self.value.append(low)
            self.mask.append(~(low ^ high))

    def near(self, limit: int, whole: list[np.ndarray], chunk: int = 8192) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Batches of places x < y in Gray order whose words differ in d <= ``limit`` bits, and d.

        ``whole`` holds each node's label, or -1 if those under it differ: nodes of one label are left. The caller may
        change it between batches.
        """
        stack = [(len(self.value) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, np.int64))] if len(self.order) > 1 else []
        while stack:
            level, a, b, d = stack.pop()
            known = (whole[level][a] >= 0) & (whole[level][a] == whole[level][b])
            a, b, d = a[~known], b[~known], d[~known]
            if not len(a):
                continue
            below = level - 1
            size = len(self.value[below])
            up = self.mask[level][a] & self.mask[level][b]
            step = np.arange(self.fan)
            x = (a[:, None, None] * self.fan + step[None, :, None] + 0 * step).reshape(len(a), -1)
            y = (b[:, None, None] * self.fan + 0 * step[None, :, None] + step).reshape(len(a), -1)
            row = np.broadcast_to(np.arange(len(a))[:, None], x.shape)
            keep = (x < size) & (y < size) & ((x <= y) if below else (x < y))
            x, y, row = x[keep], y[keep], row[keep]
            new = self.mask[below][x] & self.mask[below][y] & ~up[row]
            d = d[row] + np.bitwise_count((self.value[below][x] ^ self.value[below][y]) & new)
            near = d <= limit
            x, y, d = x[near], y[near], d[near]
            if below == 0:
                yield x, y, d
                continue
            far = np.argsort(-(y - x), kind="stable")  # neighbours in Gray order come last, so are taken first
            for at in range(0, len(far), chunk):
                part = far[at : at + chunk]
                stack.append((below, x[part], y[part], d[part]))

    def components(self, limit: int = 4, chunk: int = 8192, more: np.ndarray | None = None) -> np.ndarray:
        """For each fingerprint, the smallest position of its component under links of at most ``limit`` bits, the bits of
        ``more`` (a second word of each fingerprint) included.

        Pairs aren't kept: links are merged as they are found, and two nodes whose fingerprints are all in one component
        already are left, so a large cluster costs little more than its spanning links.
        """
        n = len(self.order)
        comp = np.arange(n)
        whole = self.whole(comp)
        for x, y, d in self.near(limit, whole, chunk):
            if more is not None:
                near = d + np.bitwise_count(more[self.order[x]] ^ more[self.order[y]]) <= limit
                x, y = x[near], y[near]
            if merge(comp, x, y):
                whole[:] = self.whole(comp)
        out = np.empty(n, np.int64)
        out[self.order] = self.order[comp]
        root = np.full(n, n)
        np.minimum.at(root, out, np.arange(n))
        return root[out]

    def whole(self, comp: np.ndarray) -> list[np.ndarray]:
        """Per level, the label of each node if all under it have one (labels in Gray order, not negative), or -1."""
        low = high = comp
        out = [comp]
        for _ in self.value[1:]:
            cuts = np.arange(0, len(low), self.fan)
            low, high = np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts)
            out.append(np.where(low == high, low, -1))
        return out


def merge(comp: np.ndarray, x: np.ndarray, y: np.ndarray) -> bool:
    """Join the components of each x and y in place; comp holds every member's root. True if any joined."""
    any_joined = False
    while True:
        a, b = comp[x], comp[y]
        apart = a != b
        if not apart.any():
            return any_joined
        any_joined = True
        x, y, a, b = x[apart], y[apart], a[apart], b[apart]
        np.minimum.at(comp, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := comp[comp], comp):
            comp[:] = up


def _in_runs(group: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of places inside runs of equal ``group`` of at most ``most`` rows, for all runs at once."""
    for step in range(1, min(most, len(group))):
        x = np.flatnonzero(group[:-step] == group[step:])
        if not len(x):
            break
        yield x, x + step


def _runs(group: np.ndarray, small: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Places of rows in runs of equal ``group`` of at most ``small`` rows; start and length of each longer run."""
    cuts = np.flatnonzero(np.diff(group, prepend=~group[0])) if len(group) else np.empty(0, np.int64)
    size = np.diff(np.append(cuts, len(group)))
    return np.flatnonzero(~np.repeat(size > small, size)), list(zip(cuts[size > small].tolist(), size[size > small].tolist()))


def _differing(words: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return sum(np.bitwise_count(w[x] ^ w[y]).astype(np.int64) for w in words)


def _group_components(group: np.ndarray, words: list[np.ndarray], limit: int, small: int) -> np.ndarray:
    """The component of each row: what is linked inside its run of equal ``group``."""
    few, large = _runs(group, small)
    comp = np.arange(len(group))
    xs, ys = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for x, y in _in_runs(group[few], small):
        x, y = few[x], few[y]
        near = _differing(words, x, y) <= limit
        xs.append(x[near])
        ys.append(y[near])
    merge(comp, np.concatenate(xs), np.concatenate(ys))
    for a, n in large:
        comp[a : a + n] = a + GrayIndex(words[0][a : a + n]).components(limit, more=words[1][a : a + n] if len(words) > 1 else None)
    return comp


def _values(batch: pa.RecordBatch, name: str) -> np.ndarray:
    column = batch.column(name)
    if pa.types.is_binary(column.type):  # of one length
        return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)
    return column.to_numpy()


def _by_group(rows: DataFrame, columns: list[str], find: Callable[[dict], list[np.ndarray]], schema: str) -> DataFrame:
    """What ``find`` gives for the ``columns`` of whole groups of equal ``key``, the first column, from rows streamed in its
    order and that of the second; a task holds one group, of a size that :func:`_split` bounds."""
    names = [part.split()[0] for part in schema.split(",")]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [_values(batch, c) for c in columns]
            at = int(np.searchsorted(now[0], now[0][-1]))
            if at or held and held[-1][0][-1] != now[0][0]:
                yield from out([*held, [x[:at] for x in now]])
                held = []
            held.append([x[at:] for x in now])
        yield from out(held)

    def out(held: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        whole = [np.concatenate(x) for x in zip(*held)]
        if whole and len(whole[0]) > 1:
            yield pa.RecordBatch.from_arrays([*map(pa.array, find(dict(zip(columns, whole))))], names=names)

    return rows.select(columns).repartition("key").sortWithinPartitions("key", columns[1]).mapInArrow(search, schema)


def _split(rows: DataFrame, block: int) -> DataFrame:
    """``rows`` (``key``, ``node`` and others) with every group of over ``block`` rows dealt into blocks, of which each two meet
    under a key of their own: no task holds more than two blocks, and no pair is lost."""
    hot = stage(rows.groupBy("key").count().filter(F.col("count") > block).select("key", F.ceil(F.col("count") / block).cast("int").alias("__blocks")))
    n = hot.count()
    if not n:
        return rows
    own = F.pmod(F.xxhash64("node", F.lit(7)), F.coalesce("__blocks", F.lit(1))).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.coalesce("__blocks", F.lit(1)) - 1))
    dealt = rows.join(F.broadcast(hot) if n <= 1_000_000 else hot, "key", "left").select(*rows.columns, "__blocks", own.alias("__own"), other.alias("__other"))
    key = F.when(F.col("__blocks").isNull(), F.col("key")).otherwise(F.xxhash64("key", F.least("__own", "__other"), F.greatest("__own", "__other")))
    return dealt.withColumn("key", key).select(rows.columns)


def _search_groups(rows: DataFrame, words: list[str], limit: int, small: int) -> DataFrame:
    """Links (a, b) between the ``node``s of each ``key``, whose fingerprints are ``words``.

    Each member of a component is linked to its smallest node. Groups that share most of their members then make the same
    links, of which one is kept.
    """

    def find(by: dict) -> list[np.ndarray]:
        comp = _group_components(by["key"], [by[w].view(np.uint64) for w in words], limit, small)
        least = np.full(len(comp), np.iinfo(np.int64).max)
        np.minimum.at(least, comp, by["node"])
        member = np.flatnonzero(least[comp] != by["node"])
        return [least[comp[member]], by["node"][member]]

    return _by_group(rows, ["key", "node", *[w for w in words if w != "node"]], find, "a long, b long").distinct()


class _Nearest:
    """The ``k`` least (d, node) that each row of a group has been paired with."""

    def __init__(self, node: np.ndarray, k: int):
        self.node, self.k, self.size = node, k, 0
        self.most = np.full(len(node), 1 << 30)  # what d of a further one may be
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, x: np.ndarray, y: np.ndarray, d: np.ndarray) -> None:
        for i, j in ((x, y), (y, x)):
            some = d <= self.most[i]
            self.held.append((i[some], d[some], j[some]))
            self.size += len(self.held[-1][0])
        if self.size > 2_000_000:
            self.held = [self.best()]
            self.size = len(self.held[0][0]) // 2  # grows by a half at least before it's cut again

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x, d, y = (np.concatenate([np.empty(0, np.int64), *c]) for c in zip(*self.held)) if self.held else [np.empty(0, np.int64)] * 3
        order = np.lexsort((self.node[y], d, x))
        x, d, y = x[order], d[order], y[order]
        first = np.flatnonzero(np.diff(x, prepend=-1))
        nth = np.arange(len(x)) - np.repeat(first, np.diff(np.append(first, len(x))))
        last = nth == self.k - 1
        self.most[x[last]] = d[last]
        keep = nth < self.k
        return x[keep], d[keep], y[keep]


#: Bytes of a sketch: how many of a text's shingles fall into each of so many classes.
SKETCH = 64


def may_reach(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets with sketches ``a`` and ``b`` and sizes ``n`` and ``m`` can be as similar as this: two sets share at most
    the smaller count of each class. A count of 255 means that or more."""
    low = np.minimum(a, b)
    most = low.sum(1, dtype=np.int64)
    return (low == 255).any(1) | (most >= similarity * (n + m - most))


def nearest(rows: DataFrame, limit: int, k: int, similarity: float = 0.0, block: int = 20_000, small: int = 256) -> DataFrame:
    """``node`` and ``top``: the ``k`` least (d, other) of each of ``rows`` (``key``, ``node``, ``label``, ``fp``, ``fp1``) over all
    groups of a key. d is the number of differing bits, at most ``limit``; the other has another ``label``.

    With columns ``seen_d`` and ``seen`` a pair that is not after either's (d, other) there is left; with ``n`` and
    ``sketch`` one that :func:`may_reach` rules out is. Small groups are compared at once, each larger one by a
    :class:`GrayIndex`, which leaves branches that have one label.
    """
    more = [c for c in ("seen_d", "seen", "n", "sketch") if c in rows.columns]

    def find(by: dict) -> list[np.ndarray]:
        node, words = by["node"], [by["fp"].view(np.uint64), by["fp1"].view(np.uint64)]
        label = np.unique(by["label"], return_inverse=True)[1]
        best = _Nearest(node, k)

        def add(x: np.ndarray, y: np.ndarray) -> None:
            for at in range(0, len(x), 1 << 16):
                i, j = x[at : at + (1 << 16)], y[at : at + (1 << 16)]
                d = _differing(words, i, j)
                ok = (d <= limit) & (label[i] != label[j])
                if "seen" in by:
                    ok &= (d > by["seen_d"][i]) | (d == by["seen_d"][i]) & (node[j] > by["seen"][i])
                    ok &= (d > by["seen_d"][j]) | (d == by["seen_d"][j]) & (node[i] > by["seen"][j])
                i, j, d = i[ok], j[ok], d[ok]
                if "sketch" in by and len(i):
                    ok = may_reach(by["sketch"][i], by["sketch"][j], by["n"][i], by["n"][j], similarity)
                    i, j, d = i[ok], j[ok], d[ok]
                best.add(i, j, d)

        few, large = _runs(by["key"], small)
        for x, y in _in_runs(by["key"][few], small):
            add(few[x], few[y])
        for a, size in large:
            index = GrayIndex(words[0][a : a + size])
            at = a + index.order
            for x, y, _ in index.near(limit, index.whole(label[at])):
                add(at[x], at[y])
        x, d, y = best.best()
        return [node[x], d, node[y]]

    found = _by_group(_split(rows, block), ["key", "node", "label", "fp", "fp1", *more], find, "node long, d long, other long")
    return found.groupBy("node").agg(F.slice(F.array_sort(F.collect_set(F.struct("d", "other"))), 1, k).alias("top"))


def _parts(bits: list[int], n: int) -> list[list[int]]:
    return [bits[k * len(bits) // n : (k + 1) * len(bits) // n] for k in range(n)]


def _masks(limit: int, depth: int) -> list[int]:
    """Cumulative masks of the blocking keys at ``depth``, by path: each step fixes one of limit+1 parts of the bits left."""
    out = [(0, list(range(64)))]
    for _ in range(depth):
        out = [(mask | sum(1 << b for b in part), [b for b in left if b not in part]) for mask, left in out for part in _parts(left, limit + 1)]
    return [mask - (1 << 64) if mask >> 63 else mask for mask, _ in out]


def hamming_links(fps: DataFrame, limit: int = 4, group: int = 50_000, depth: int = 3) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp`` that connect all pairs within ``limit`` bits, without all pairs.

    Of limit+1 parts of the 64 bits, two such fingerprints have one part in common: each fingerprint goes into limit+1
    groups by part and value. A group over ``group`` rows is split again in the same way on its other bits, up to
    ``depth`` times, and what is larger still is dealt into blocks, which loses nothing. Every group is searched by a
    :class:`GrayIndex`.
    """
    rows = fps.select("fp").distinct().withColumn("path", F.lit(0))
    done = None
    for level in range(1, depth + 1):
        masks = F.array(*map(F.lit, _masks(limit, level)))
        rows = rows.select("fp", F.explode(F.sequence(F.col("path") * (limit + 1), F.col("path") * (limit + 1) + limit)).alias("path"))
        rows = rows.select("fp", "path", F.xxhash64(F.lit(level), "path", F.col("fp").bitwiseAND(F.get(masks, F.col("path")))).alias("key"))
        if level == depth:
            done = _and(done, _split(rows.select("key", F.col("fp").alias("node")), group))
            break
        hot = stage(rows.groupBy("key").count().filter(F.col("count") > group).select("key"))
        cold = rows.select("key", F.col("fp").alias("node"))
        if hot.isEmpty():
            done = _and(done, cold)
            break
        done = _and(done, cold.join(hot, "key", "left_anti"))
        rows = rows.join(hot, "key", "left_semi").select("fp", "path")

    return _search_groups(done, ["node"], limit, 32)


def _and(*tables: DataFrame | None) -> DataFrame:
    out = None
    for t in tables:
        out = t if out is None else out if t is None else out.unionByName(t)
    return out


def _meeting(classes: DataFrame, parts: int = 10, agree: int = 2) -> DataFrame:
    """``classes`` (``fp``, ``fp1`` and others) once for each choice of ``agree`` of ``parts`` parts of either word, with that
    choice and its bits as ``key``.

    All that differ in at most ``parts - agree`` bits of a word meet, and most of those that differ in more: of two texts
    whose five-word shingles have a Jaccard similarity of 0.8, some 15 % of the bits differ.
    """
    cut = _parts(list(range(64)), parts)
    masks = [sum(1 << b for part in chosen for b in part) for chosen in combinations(cut, agree)]
    table = F.array(*[F.lit(m - (1 << 64) if m >> 63 else m).cast("long") for m in masks])
    rows = classes.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(2 * len(masks) - 1))))
    word = F.when(F.col("i") < len(masks), F.col("fp")).otherwise(F.col("fp1"))
    return rows.withColumn("key", F.xxhash64("i", word.bitwiseAND(F.get(table, F.col("i") % len(masks))))).drop("i")


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The ``pairs`` (a, b) whose ``sets`` (node, n, set) have a Jaccard similarity of ``similarity`` or more; ``n`` is the size
    of the whole set, of which ``set`` may lack what no other set holds."""
    rows = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("x"), F.col("n").alias("nx")), "a")
    rows = rows.join(sets.select(F.col("node").alias("b"), F.col("set").alias("y"), F.col("n").alias("ny")), "b")
    both = F.size(F.array_intersect("x", "y"))
    return rows.filter(both / (F.col("nx") + F.col("ny") - both) >= similarity).select("a", "b")


def _pairs(near: DataFrame) -> DataFrame:
    """The distinct pairs a < b of a node and one of its ``top``."""
    rows = near.select("node", F.explode("top").alias("t"))
    return rows.select(F.least("node", "t.other").alias("a"), F.greatest("node", "t.other").alias("b")).distinct()


def shared_sets(sets: DataFrame, similarity: float) -> DataFrame:
    """``node``, ``n``, ``set`` and ``sketch`` of those of ``sets`` (node, set) that can be as similar to another of them as this:
    ``n`` is the set's size, and ``set`` keeps the shingles that another set has too. Counts are summed before they move."""
    lone = sets.select("node", F.explode("set").alias("h")).groupBy("h").agg(F.count("*").alias("c"), F.min("node").alias("node")).filter("c = 1")
    lone = lone.groupBy("node").agg(F.collect_list("h").alias("lone"))  # at most one text's shingles
    rows = sets.join(lone, "node", "left").select("node", F.size("set").cast("long").alias("n"), F.when(F.col("lone").isNull(), F.col("set")).otherwise(F.array_except("set", "lone")).alias("set"))
    rows = rows.filter(F.size("set") >= similarity * F.col("n"))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = batch.column("set")
            h, size = sets.flatten().to_numpy().view(np.uint64), pc.list_value_length(sets).to_numpy()
            place = np.repeat(np.arange(len(size)), size) * SKETCH + ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % SKETCH
            counts = np.minimum(np.bincount(place, minlength=len(size) * SKETCH), 255).astype(np.uint8).reshape(len(size), SKETCH)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([c.tobytes() for c in counts], pa.binary())], names=["node", "n", "set", "sketch"])

    return rows.mapInArrow(sketch, "node long, n long, set array<long>, sketch binary")


def similar_classes(docs: DataFrame, classes: DataFrame, k: int = 5, similarity: float = 0.8, limit: int = 32, block: int = 20_000) -> DataFrame:
    """``node`` and ``root`` (a name of its component) of classes (``node``, ``doc_id``, ``text_hash``, ``fp``, ``fp1``) that links of
    at least this similarity join; a class that is not there is alone.

    Candidates are classes that meet (see :func:`_meeting`) and differ in at most ``limit`` of 128 bits: at a similarity of
    0.8 it is 19.4 on average with a deviation of 4.1. Every candidate is decided, either by whole shingle sets, by counts
    that rule it out, or because its two classes are connected already. That is done in rounds, so a large group of near
    copies never becomes pairs: first every class is checked against the least of its group, then against its 2 nearest of
    those that it is not connected with, then the 8 that follow, 32 and so on. A class with fewer left than that is through
    with all its candidates and takes no further part.
    """
    near = stage(_search_groups(_split(_meeting(classes.select("node", "fp", "fp1")), block), ["fp", "fp1"], limit, 256))
    nodes = near.select(F.col("a").alias("node")).unionByName(near.select(F.col("b").alias("node"))).distinct()
    some = stage(classes.join(nodes, "node"))
    keys = stage(_as_keys(some))
    found = stage(with_sets(_with_keys(docs, keys, "left_semi"), k).join(some.select("node"), "node").groupBy("node").agg(F.first("set").alias("set")))
    sets = stage(shared_sets(found, similarity))
    first = stage(verified(near.groupBy("b").agg(F.min("a").alias("a")), sets, similarity))
    state = stage(some.select("node", "fp", "fp1").join(sets.select("node", "n", "sketch"), "node"))
    labels = _relabelled(sets.select("node", F.col("node").alias("label")), first)
    discard(near, some, keys, found, first)
    most = 2
    while True:
        near = stage(nearest(_meeting(state.join(labels, "node")), limit, most, similarity, block))
        if near.isEmpty():
            discard(near, state, sets)
            return labels.withColumnRenamed("label", "root")
        links = stage(verified(_pairs(near), sets, similarity))
        last = F.get(F.col("top"), F.lit(most - 1))
        seen = near.filter(F.size("top") == most).select("node", last["d"].alias("seen_d"), last["other"].alias("seen"))
        before, state = (state, near, links, labels), stage(state.drop("seen_d", "seen").join(seen, "node"))
        labels = _relabelled(labels, links)
        discard(*before)
        most *= 4


def _relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (node, label) after ``links`` (a, b) between nodes: only links between two labels count, each two once."""
    of = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"label_{c}"))
    rows = links.join(of("a"), "a").join(of("b"), "b").filter("label_a <> label_b")
    met = stage(rows.select(F.least("label_a", "label_b").alias("a"), F.greatest("label_a", "label_b").alias("b")).distinct())
    roots = components(met)
    out = stage(labels.join(roots.withColumnRenamed("node", "label"), "label", "left").select("node", F.coalesce("root", "label").alias("label")))
    discard(met, roots)
    return out


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root`` (its component's smallest node) for every node of ``links`` (a, b): least labels spread along
    links and then jump to their own label's label, until nothing changes. Every round is written to shared storage, in
    as few files as its rows need, and the round before it removed."""
    both = links.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("other")))
    both = stage(both.filter("node <> other").distinct())
    files = max(1, both.count() // 50_000)
    state = stage(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("root")).coalesce(files))
    while True:
        heard = both.join(state.select(F.col("node").alias("other"), F.col("root").alias("said")), "other").groupBy("node").agg(F.min("said").alias("said"))
        spread = state.join(heard, "node").select("node", F.col("root").alias("was"), F.least("root", "said").alias("root"))
        jump = state.select(F.col("node").alias("root"), F.col("root").alias("further"))
        after = stage(spread.join(jump, "root", "left").select("node", "was", F.least("root", F.coalesce("further", "root")).alias("root")).coalesce(files))
        discard(state)
        state = after.select("node", "root")
        state._staged_at = after._staged_at
        if after.filter("root <> was").isEmpty():
            discard(both)
            return state


def near_duplicates(docs: DataFrame, k: int = 4, limit: int = 4, group: int = 50_000) -> DataFrame:
    """``doc_id``, ``fp`` and ``component_id`` of every row: the smallest doc_id reachable by links of at most ``limit`` bits.

    Exact copies meet as one fingerprint before any search. Null and blank texts share fingerprint 0; a null id stays,
    and is no component's smallest unless all ids there are null. Other columns aren't used. Empty in, empty out.
    """
    prints = stage(with_fingerprints(docs, k))
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(hamming_links(classes, limit, group)).withColumnRenamed("node", "fp")
    classes = classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    names = classes.join(least, "root").select("fp", "component_id")
    return prints.join(names, "fp").select("doc_id", "fp", "component_id")


def fingerprint_hex(fp: str = "fp") -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _classed(docs: DataFrame, k: int, similarity: float, limit: int, block: int) -> DataFrame:
    """``doc_id``, ``text_hash`` and ``root`` (a name of the component) of every row with an id."""
    docs = docs.filter("doc_id is not null")
    prints = stage(with_set_prints(docs, k))
    least = F.min(F.struct("doc_id", "text_hash")).alias("least")
    classes = stage(prints.groupBy("node").agg(least, *[F.first(c).alias(c) for c in ("fp", "fp1")]).select("node", "least.doc_id", "least.text_hash", "fp", "fp1"))
    roots = similar_classes(docs, classes, k, similarity, limit, block)
    out = stage(prints.select("doc_id", "text_hash", "node").join(roots, "node", "left").select("doc_id", "text_hash", F.coalesce("root", "node").alias("root")))
    discard(prints, classes)
    return out


def similar_documents(docs: DataFrame, k: int = 5, similarity: float = 0.8, limit: int = 32, block: int = 20_000) -> DataFrame:
    """``doc_id`` and ``component_id`` (its smallest doc_id) of every row with an id: components of texts whose sets of
    ``k``-word shingles have a Jaccard similarity of ``similarity`` or more. SimHash finds the candidates, see
    :func:`similar_classes`. Null and blank texts have the same (empty) set; empty in, empty out."""
    rows = _classed(docs, k, similarity, limit, block)
    least = rows.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return rows.join(least, "root").select("doc_id", "component_id")


def keep_one(docs: DataFrame, k: int = 5, similarity: float = 0.8, limit: int = 32, block: int = 20_000) -> DataFrame:
    """``docs`` with one row of each component of :func:`similar_documents`: that of the smallest doc_id.

    Two unlike texts under one doc_id are two documents, and both stay. Of rows that repeat both id and text the one whose
    JSON form sorts first stays. Rows without an id all stay; null and blank texts are copies of one another. Only ids and
    hashes move, unless more rows go than may be broadcast. Columns of any type and name are kept as they are.
    """
    rows = _classed(docs, k, similarity, limit, block)
    kept = stage(rows.groupBy("root").agg(F.min(F.struct("doc_id", "text_hash")).alias("least")).select("least.doc_id", "least.text_hash").distinct())
    each = stage(rows.groupBy("doc_id", "text_hash").agg(F.count("*").alias("rows")).join(kept.withColumn("kept", F.lit(True)), ["doc_id", "text_hash"], "left"))
    gone = stage(_as_keys(each.filter("kept is null or rows > 1")))
    repeated = stage(_as_keys(each.filter("kept and rows > 1")))
    discard(rows, kept, each)
    known = docs.filter("doc_id is not null")
    out = _with_keys(known, gone, "left_anti").unionByName(docs.filter("doc_id is null"))
    if not repeated.isEmpty():
        whole = F.struct(*docs.columns)
        one = _with_keys(known, repeated, "left_semi").groupBy(F.col("doc_id").alias("k1"), text_hash().alias("k2")).agg(F.min_by(whole, F.to_json(whole)).alias("row"))
        out = out.unionByName(one.select("row.*"))
    return out
