"""Language identification: piece unigrams per language over a fixed public vocabulary, summed over all segmentations."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import discard, fold, slices, stage

#: Bytes of text a worker treats at a time: the larger, the fewer times a word is segmented.
SLICE = 4 << 20
_BASE = np.uint64(6_364_136_223_846_793_005)
_MARK = "▁"


@dataclass
class Model:
    """``pieces`` are hashes of the vocabulary; ``probability[piece, language]`` has one more row, for any character that
    the vocabulary lacks, and a last one of zeros."""

    langs: list[str]
    pieces: np.ndarray
    longest: int
    probability: np.ndarray


def _hashes(words: list[str]) -> np.ndarray:
    """Polynomial hash of each string's code points."""
    out = np.zeros(len(words), np.uint64)
    for i, w in enumerate(words):
        h = 0
        for c in w:
            h = (h * int(_BASE) + ord(c)) & (2**64 - 1)
        out[i] = h
    return out.view(np.int64)


def vocabulary(path: str) -> tuple[np.ndarray, int]:
    """Hashes of the pieces at ``path`` that words can hold, which are letters in lower case behind a mark, and the most
    characters that one has."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i))]
    fit = sorted({p for p in pieces if p == p.lower() and (p == _MARK or p.removeprefix(_MARK).isalpha())})
    return _hashes(fit), max(map(len, fit), default=1)


def words_of(texts: pa.Array) -> tuple[np.ndarray, pa.StringArray]:
    """Words per text, and all words: runs of letters in lower case. Null and letterless texts have none."""
    plain = pc.utf8_trim(pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), pattern=r"[^\p{L}]+", replacement=" "), characters=" ")
    parts = pc.split_pattern(plain, " ")
    counts = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    counts[pc.equal(pc.binary_length(plain), 0).to_numpy(zero_copy_only=False)] = 0
    flat = parts.flatten()
    return counts, flat.filter(pc.greater(pc.binary_length(flat), 0))


class Lattice:
    """All segmentations of words of one length, the mark before them included: for each piece length and start, the piece.

    Sums over segmentations are kept as the ratio T[j] of what the first j characters and the first j-1 sum to, so words
    of any length neither vanish nor have to be cut; only the last ``longest`` sums are needed at a time.
    """

    def __init__(self, points: np.ndarray, pieces: np.ndarray, longest: int):
        n = points.shape[1]
        self.n, self.words, self.longest, self.unknown = n, len(points), min(longest, n), len(pieces)
        sums = np.zeros((n + 1, len(points)), np.uint64)
        for j in range(n):
            sums[j + 1] = sums[j] * _BASE + points[:, j]
        power = np.uint64(1)
        self.piece: list[np.ndarray] = [np.empty(0)]  # by length, then start
        table = pa.array(pieces)
        for size in range(1, self.longest + 1):
            power = np.uint64(int(power) * int(_BASE) & (2**64 - 1))
            key = (sums[size:] - sums[:-size] * power).view(np.int64)
            at = pc.fill_null(pc.index_in(pa.array(key.ravel()), value_set=table), self.unknown + (size > 1))
            self.piece.append(at.to_numpy().reshape(key.shape))

    def ratios(self, probability: np.ndarray) -> Iterator[np.ndarray]:
        """T[j] per word and language, for j from 1."""
        past = np.zeros((self.longest, self.words, probability.shape[1]))  # sums before j over that before j-1
        past[0] = 1
        for j in range(1, self.n + 1):
            total = past[(j - 1) % self.longest] * probability[self.piece[1][j - 1]]
            for size in range(2, min(j, self.longest) + 1):
                total += past[(j - size) % self.longest] * probability[self.piece[size][j - size]]
            yield total
            past /= total
            past[j % self.longest] = 1

    def log_sum(self, probability: np.ndarray) -> np.ndarray:
        """Log of the probability of each word, per language, over all its segmentations."""
        return sum(np.log(t) for t in self.ratios(probability))

    def expected(self, probability: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Expected count of every piece, words weighing ``weight`` per language.

        ``at[j]`` is the weight of the segmentations with an end after j characters. An edge from i to j has its share of
        at[j]: its probability over T[i+1] ... T[j].
        """
        ratio = list(self.ratios(probability))
        at = np.zeros((self.n + 1, *weight.shape))
        at[self.n] = weight
        out = np.zeros_like(probability)
        for i in range(self.n - 1, -1, -1):
            passed = np.ones_like(weight)
            for size in range(1, min(self.n - i, self.longest) + 1):
                passed *= ratio[i + size - 1]
                piece = self.piece[size][i]
                share = probability[piece] * at[i + size] / passed
                at[i] += share
                for lang in range(weight.shape[1]):
                    out[:, lang] += np.bincount(piece, weights=share[:, lang], minlength=len(out))
        return out


def _lattices(words: pa.StringArray, pieces: np.ndarray, longest: int) -> Iterator[tuple[np.ndarray, Lattice]]:
    """Words grouped by length, some 150,000 characters at a time: the places of the words of a group, and their lattice."""
    by_size: dict[int, list[tuple[int, str]]] = {}
    for i, w in enumerate(words.to_pylist()):
        by_size.setdefault(len(w), []).append((i, w))
    for size, own in by_size.items():
        step = max(1, 150_000 // size)
        for a in range(0, len(own), step):
            some = own[a : a + step]
            points = np.frombuffer("".join(_MARK + w for _, w in some).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(some), size + 1)
            yield np.fromiter((i for i, _ in some), np.int64, len(some)), Lattice(points.astype(np.uint64), pieces, longest)


def learning_rows(docs: DataFrame, per_lang: int = 1_500) -> DataFrame:
    """``lang`` and ``text`` of about ``per_lang`` documents of each language (all, if fewer): those of smallest hash, as many as
    the language's number of documents says. Rows without id, language or text are left; rows that repeat all three
    count once, so one of them can't fill the sample. Counts are summed before they move, and the sample's keys, bounded
    by ``per_lang`` and the number of languages, are broadcast."""
    known = docs.filter("lang is not null and text is not null and doc_id is not null")
    known = known.select(F.col("doc_id").cast("string").alias("id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    known = known.withColumn("hash", F.xxhash64("id", "text"))
    keys = known.select("lang", "hash").distinct()
    share = keys.groupBy("lang").agg((F.lit(float(per_lang)) / F.count("*")).alias("share"))
    sample = keys.join(F.broadcast(share), "lang").filter(F.col("hash") / 2.0**64 + 0.5 < F.col("share")).select("lang", "hash")
    return known.join(F.broadcast(sample), ["lang", "hash"]).groupBy("lang", "hash", "id").agg(F.first("text").alias("text")).select("lang", "text")


def fit(docs: DataFrame, path: str, per_lang: int = 1_500, rounds: int = 4, least: float = 0.02) -> Model:
    """Piece probabilities of each language by expectation maximisation over all words of :func:`learning_rows`.

    Every round workers add up the expected counts of their part of the distinct words; what comes back is as long as the
    vocabulary times the languages.
    """
    spark = docs.sparkSession

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=SLICE):
            counts, flat = words_of(batch.column("text"))
            if len(flat):
                lang = batch.column("lang").take(pa.array(np.repeat(np.arange(len(counts)), counts)))
                got = pa.table({"lang": lang, "word": flat}).group_by(["lang", "word"]).aggregate([([], "count_all")])
                yield from got.select(["lang", "word", "count_all"]).rename_columns(["lang", "word", "n"]).to_batches()

    words = learning_rows(docs, per_lang).mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    words = stage(words.groupBy("word").agg(F.collect_list(F.struct("lang", "n")).alias("of")))  # at most one for each language
    langs = [r.lang for r in words.select(F.explode("of.lang").alias("lang")).distinct().orderBy("lang").collect()]
    pieces, longest = vocabulary(path)
    probability = np.full((len(pieces) + 2, len(langs)), 1 / (len(pieces) + 1))
    probability[-1] = 0
    for _ in range(rounds if langs else 0):
        shared = spark.sparkContext.broadcast(probability)

        def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros_like(shared.value)
            for batch in batches:
                of = batch.column("of")
                owner = np.repeat(np.arange(batch.num_rows), pc.list_value_length(of).to_numpy())
                lang, n = (of.flatten().field(k) for k in ("lang", "n"))
                weight = np.zeros((batch.num_rows, len(langs)))
                weight[owner, pc.index_in(lang, value_set=pa.array(langs)).to_numpy()] = n.to_numpy()
                for at, lattice in _lattices(batch.column("word"), pieces, longest):
                    out += lattice.expected(shared.value, weight[at])
            piece, lang = np.nonzero(out)
            for a in range(0, len(piece), 100_000):
                own = slice(a, a + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(piece[own]), pa.array(lang[own]), pa.array(out[piece[own], lang[own]])], names=["piece", "lang", "n"])

        got = words.mapInArrow(expect, "piece long, lang long, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toArrow()
        expected = np.full((len(pieces) + 1, len(langs)), least)
        expected[got.column("piece").to_numpy(), got.column("lang").to_numpy()] += got.column("n").to_numpy()
        probability = np.vstack([expected / expected.sum(0), np.zeros(len(langs))])
        shared.unpersist()
    discard(words)
    return Model(langs, pieces, longest, probability)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``lang_pred`` and ``score`` (0 to 1: its share among the languages) for every row's whole text.

    A text's log-probability is the sum over its words of the log of the sum over all segmentations. Ties go to the
    language that sorts first; null and letterless texts, or a model without languages, give ``und`` with score 0.
    Repeated rows are predicted each. Other columns aren't used. Empty in, empty out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in slices(batches, limit=SLICE):
            counts, flat = words_of(batch.column("text"))
            n, owner = len(counts), np.repeat(np.arange(len(counts)), counts)
            if not m.langs or not len(flat):
                names, share = ["und"] * n, np.zeros(n)
            else:
                code = pc.dictionary_encode(flat)
                each = np.zeros((len(code.dictionary), len(m.langs)))
                for at, lattice in _lattices(code.dictionary, m.pieces, m.longest):
                    each[at] = lattice.log_sum(m.probability)
                word = code.indices.to_numpy()
                total = np.stack([np.bincount(owner, weights=each[word, k], minlength=n) for k in range(len(m.langs))], axis=1)
                best = total.argmax(1)
                share = 1 / np.exp(total - total.max(1)[:, None]).sum(1)
                share[counts == 0] = 0
                names = ["und" if c == 0 else m.langs[b] for c, b in zip(counts.tolist(), best.tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(share)], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame, path: str) -> DataFrame:
    """Predictions for all rows by a model that learned from the folds other than 0, and whether a row is held out."""
    found = predict(docs, fit(docs.filter(fold() != 0), path))
    return found.select("doc_id", (fold() == 0).alias("held_out"), "lang_pred", "score")
