"""An index built from a description: train, add, search, change, save. Vectors and codes live in tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import cluster, codecs, maintain, search, transforms
from tessella.operators.topk import top_k
from tessella.plans.factory import IndexSpec, parse


class Index:
    """``train`` fits transforms, lists and codec on documents (doc_id, vec); ``add`` puts documents in.

    Descriptions that parse but name something that is not built (graphs, lattice and spectral codecs) are errors; with
    ``exact_graphs`` a graph is answered by exact search, which finds at least what it would. Bit vectors are searched by
    :mod:`tessella.operators.binary`.
    """

    def __init__(self, description: str | IndexSpec, metric: str = "l2", exact_graphs: bool = False):
        self.spec = parse(description) if isinstance(description, str) else description
        kind = self.spec.codec[0]
        if self.spec.binary:
            raise ValueError("bit vectors have operators of their own")
        if kind in ("lattice", "spectral") or kind == "graph" and not exact_graphs:
            raise ValueError(f"an index of kind {kind!r} is not built")
        if kind in ("lsh", "rabit") and (metric != "l2" or self.spec.coarse):
            raise ValueError(f"{kind!r} is built for L2 without lists")
        self.metric = metric
        self.chain = transforms.Chain()
        self.centroids: DataFrame | None = None
        self.codec: codecs.Codec | None = None
        self.rows: DataFrame | None = None

    def train(self, docs: DataFrame, rounds: int = 8) -> Index:
        docs = docs.select("doc_id", "vec")
        for kind, a in self.spec.transforms:
            self.chain.steps.append(self._transform(kind, a, self.chain.apply(docs)))
        docs = self.chain.apply(docs)
        if self.spec.coarse:
            kind, a = self.spec.coarse
            if kind == "ivf":
                self.centroids = cluster.kmeans(docs, a[0], rounds, self.metric, spherical=self.metric == "inner_product")
            else:
                self.centroids = self._product_centroids(docs, kind, a)
        self.codec = self._codec(docs)
        return self

    def _transform(self, kind: str, a: tuple, docs: DataFrame):
        d = len(docs.first().vec)
        if kind == "pca":
            return transforms.pca(docs, a[2], -0.5 if a[0] else 0.0, bool(a[1]))
        if kind == "rotation":
            return transforms.random_rotation(d, a[0] or d)
        if kind == "itq":
            return transforms.itq(docs)
        if kind == "opq":
            return transforms.opq(docs, a[0])
        return transforms.pad(a[0]) if kind == "pad" else transforms.normalization

    def _product_centroids(self, docs: DataFrame, kind: str, a: tuple) -> DataFrame:
        """Lists that are all combinations of two (or more) small codebooks."""
        import itertools

        x = transforms._sample(docs, 20_000)
        if kind == "imi":
            books = codecs.ProductQuantizer.fit(x, 2, 1 << a[0]).books
            words = [[*u, *v] for u, v in itertools.product(*books)]
        else:
            books = codecs.ResidualQuantizer.fit(x, a[0], 1 << a[1]).books
            words = [sum(c) for c in itertools.product(*books)]
        return docs.sparkSession.createDataFrame([(i, [float(v) for v in w]) for i, w in enumerate(words)], "list_no int, cvec array<double>")

    def _codec(self, docs: DataFrame) -> codecs.Codec | None:
        kind, a = self.spec.codec
        if kind == "sq":
            return codecs.HalfFloat(a[0] == "bf16") if a[0] in ("fp16", "bf16") else codecs.Direct("signed" in a[0]) if "direct" in str(a[0]) else codecs.ScalarQuantizer.fit(docs, int(a[0]))
        if kind == "pq":
            return codecs.ProductQuantizer.fit(docs, a[0], 1 << (a[1] or 8))
        if kind == "pq_refined":
            return codecs.RefinedProduct.fit(docs, a[0], a[1])
        if kind == "rabit":
            return codecs.OneBit.fit(docs)
        if kind == "lsh":
            return codecs.SignBits.fit(docs, a[0], bool(a[1]), bool(a[2]))
        if kind == "additive":
            return (codecs.LocalSearchQuantizer if a[0].startswith("LS") else codecs.ResidualQuantizer).fit(docs, a[1], 1 << a[2])
        if kind == "product_additive":
            return codecs.ProductOf.fit(codecs.LocalSearchQuantizer if a[0] == "PLSQ" else codecs.ResidualQuantizer, docs, a[1], stages=a[2], words=1 << a[3])
        return None

    def _stored(self, docs: DataFrame) -> DataFrame:
        rows = self.chain.apply(docs.select("doc_id", F.col("vec").alias("raw"), "vec"))
        if self.centroids is not None:
            rows = search.build_lists(rows, self.centroids, self.metric)
        return self.codec.encoded(rows).drop("vec") if self.codec else rows

    def add(self, docs: DataFrame) -> Index:
        new = self._stored(docs)
        self.rows = new if self.rows is None else self.rows.unionByName(new)
        return self

    def remove(self, ids: DataFrame) -> Index:
        self.rows = maintain.remove(self.rows, ids)
        return self

    def update(self, docs: DataFrame) -> Index:
        return self.remove(docs).add(docs)

    def reset(self) -> Index:
        self.rows = None
        return self

    def merge(self, other: Index, shift: int = 0) -> Index:
        """Takes over another index's documents; both must have been trained as one."""
        self.rows = maintain.merge(self.rows, other.rows, shift)
        return self

    def vectors(self) -> DataFrame:
        """What is stored, decoded: (doc_id, vec) in the transformed space."""
        rows = self.codec.decoded(self.rows) if self.codec else self.rows
        return rows.select("doc_id", "vec", *(["list_no"] if self.centroids is not None else []))

    def reconstruct(self) -> DataFrame:
        return self.chain.reverse(self.vectors().select("doc_id", "vec"))

    def _queries(self, queries: DataFrame) -> DataFrame:
        return self.chain.apply(queries.select("qid", "qvec"), "qvec")

    def search(self, queries: DataFrame, k: int, nprobe: int = 1, on: Column | None = None, max_codes: int | None = None, k_factor: float = 4.0) -> DataFrame:
        """(qid, doc_id, score, rank); ``on`` is a condition on qid and doc_id."""
        asked, n = self._queries(queries), k if self.spec.refine is None else int(k * k_factor)
        if self.spec.refine is not None and on is None and max_codes is None and self._all_refined(queries, n):
            raw = self.rows.select("doc_id", F.col("raw").alias("vec"), *(["list_no"] if self.centroids is not None else []))
            if self.centroids is None:
                return search.knn(raw, queries, k, self.metric)
            if nprobe >= self.centroids.count():
                return search.knn(raw.filter("list_no is not null"), queries, k, self.metric)
            return search.preassigned(raw, queries, search.coarse(asked, self.centroids, nprobe, self.metric), k, self.metric).drop("list_no")
        if self.centroids is not None:
            probes = search.coarse(asked, self.centroids, nprobe, self.metric)
            if max_codes is not None:
                probes = search.limit_codes(probes, self.rows, max_codes)
            found = self._scan(asked, probes, n, on)
        elif self.spec.codec[0] == "flat_dedup" and on is None:
            found = search.dedup_search(self.vectors(), asked, n, self.metric)
        elif self.codec is not None and on is None:
            found = self.codec.search(self.rows, asked, n, self.metric)
        else:
            found = search.knn(self.vectors(), asked, n, self.metric, on)
        if self.spec.refine is None:
            return found
        raw = self.rows.select("doc_id", F.col("raw").alias("vec"))
        return search.refine(found, raw, queries, k, self.metric)

    def _all_refined(self, queries: DataFrame, n: int) -> bool:
        """Whether ``n`` candidates are all there are: codes then drop none, and the original vectors alone decide. Not where
        components are missing, no numbers or so large that a distance may be none, which refining ranks in its own way."""
        if n < self.rows.count():
            return False
        odd = lambda vec: ~F.coalesce(F.forall(vec, lambda x: F.abs(x) < 1e150), F.lit(False))
        return self.rows.filter(odd("raw")).isEmpty() and queries.filter(odd("qvec")).isEmpty()

    def _scan(self, asked: DataFrame, probes: DataFrame, n: int, on: Column | None) -> DataFrame:
        """Search of probed lists: product codes by each query's tables, other codes decoded once in the lists that any query
        probes."""
        if isinstance(self.codec, codecs.ProductQuantizer):
            return self.codec.search(self.rows, asked, n, self.metric, probes, on)
        rows = self.rows.join(probes.select("list_no").distinct(), "list_no", "left_semi")
        rows = (self.codec.decoded(rows) if self.codec else rows).select("doc_id", "vec", "list_no")
        return search.preassigned(rows, asked, probes, n, self.metric, on)

    def range_search(self, queries: DataFrame, radius: float, nprobe: int = 1) -> DataFrame:
        asked = self._queries(queries)
        if self.centroids is None:
            return search.range_search(self.vectors(), asked, radius, self.metric)
        return search.ivf_range(self.vectors(), asked, search.coarse(asked, self.centroids, nprobe, self.metric), radius, self.metric)

    def assign(self, queries: DataFrame) -> DataFrame:
        return top_k(self.search(queries, 1), 1, self.metric in ("inner_product", "jaccard")).select("qid", "doc_id")

    def clone(self) -> Index:
        """Another index of the same parts; what is added to one the other does not have."""
        other = Index(self.spec, self.metric, exact_graphs=True)
        other.chain.steps = list(self.chain.steps)
        other.centroids, other.codec, other.rows = self.centroids, self.codec, self.rows
        return other

    def save(self, path: str) -> None:
        """All of it: rows and centroids as tables, transforms and codec as numbers in the manifest."""
        from tessella.sources.files import save_tables

        tables = {"rows": self.rows} | ({"centroids": self.centroids} if self.centroids is not None else {})
        steps = [_plain(s) if isinstance(s, transforms.Linear) else None for s in self.chain.steps]
        save_tables(tables, path, description=str(self.spec), metric=self.metric, steps=steps, codec=None if self.codec is None else _plain(self.codec))

    @staticmethod
    def load(spark: SparkSession, path: str) -> Index:
        from tessella.sources.files import load_tables

        tables, facts = load_tables(spark, path)
        index = Index(facts["description"], facts["metric"], exact_graphs=True)
        for (kind, a), step in zip(index.spec.transforms, facts["steps"]):
            index.chain.steps.append(_object(step) if step is not None else transforms.pad(a[0]) if kind == "pad" else transforms.normalization)
        index.codec = None if facts["codec"] is None else _object(facts["codec"])
        index.rows, index.centroids = tables["rows"], tables.get("centroids")
        return index


def _plain(x):
    """Numbers, lists and mappings that stand for a transform or codec."""
    import numpy as np

    if isinstance(x, np.ndarray):
        return {"shape": list(x.shape), "numbers": x.ravel().tolist()}
    if isinstance(x, list):
        return [_plain(i) for i in x]
    if isinstance(x, (transforms.Linear, codecs.Codec)):
        return {"kind": type(x).__name__, "parts": {k: _plain(v) for k, v in vars(x).items()}}
    return x


def _object(x):
    import numpy as np

    if isinstance(x, list):
        return [_object(i) for i in x]
    if isinstance(x, dict) and "shape" in x:
        return np.array(x["numbers"]).reshape(x["shape"])
    if isinstance(x, dict):
        known = {c.__name__: c for c in (transforms.Linear, *codecs.KINDS)}
        out = object.__new__(known[x["kind"]])
        vars(out).update({k: _object(v) for k, v in x["parts"].items()})
        return out
    return x
