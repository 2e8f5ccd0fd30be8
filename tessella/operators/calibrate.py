"""Tuning and measuring: the (alpha, beta) grid, coordinate search, parameter exploration and repeated timing."""

from __future__ import annotations

import itertools
import math
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators import cluster, routing
from tessella.operators.search import build_lists
from tessella.operators.topk import first_depth


def axis(low: float, high: float, steps: int, zero: bool = False) -> list[float]:
    """Log-spaced values, with 0 in front if asked."""
    out = [low * (high / low) ** (i / max(steps - 1, 1)) for i in range(steps)]
    return [0.0, *out] if zero else out


def scramble(values: list[float]) -> list[float]:
    """The same values, each next one farthest (in place) from those before: a coarse picture comes first."""
    left, out = list(range(len(values))), []
    while left:
        i = left[0] if not out else max(left, key=lambda i: (min(abs(i - j) for j in out), -i))
        left.remove(i)
        out.append(i)
    return [values[i] for i in out]


def cost_at_recall(lists: DataFrame, centroids: DataFrame, queries: DataFrame, legal: DataFrame, truth: DataFrame, k: int, beta: float, goal: float = 0.95, aware: bool = True) -> float:
    """Mean documents scanned at the first probe depth whose mean recall reaches ``goal``; an error if none does."""
    sizes = lists.groupBy("list_no").agg(F.count("*").alias("n"))
    n = centroids.count()
    shares = routing.selectivity(legal, lists, queries)
    scores = routing.centroid_scores(queries, centroids)
    rows = scores.join(shares, ["qid", "list_no"], "left")
    key = F.col("coarse") + routing.log_selectivity(F.col("p"), beta) if aware else F.col("coarse")
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc(key), "list_no")))
    ranked = ranked.select("qid", "list_no", "rank", *(["p"] if aware else []))
    curve = routing.cost_curve(ranked, sizes, routing.contribution(truth, lists, k)).persist()
    depth = curve.select("depth", F.least(F.col("recall") + 1e-12, F.lit(1.0)).alias("recall"))
    found = first_depth(depth, goal).first()[0]
    cost = curve.filter(F.col("depth") == found).first()["scanned"]
    curve.unpersist()
    assert found <= n
    return float(cost)


def grid(docs: DataFrame, queries: DataFrame, legal: DataFrame, fit_legal: DataFrame, truth: DataFrame, k: int, n_lists: int, n_fit: int, alphas: list[float], betas: list[float], sig_dims: int = 4, rounds: int = 4, goal: float = 0.95) -> list[tuple[float, float, float]]:
    """(alpha, beta, cost) for every pair: one clustering an alpha, one ranking a beta."""
    out = []
    for alpha in alphas:
        seen = cluster.with_signature(cluster.signatures(fit_legal, n_fit, docs, sig_dims, alpha))
        centroids = cluster.kmeans(seen, n_lists, rounds, "inner_product", spherical=True, split=False)
        lists = build_lists(seen, centroids).select("doc_id", "list_no").persist()
        out += [(alpha, beta, cost_at_recall(lists, centroids, queries, legal, truth, k, beta, goal, aware=bool(alpha or beta))) for beta in betas]
        lists.unpersist()
    return out


def coordinate_search(cost: Callable[[float, float], float], alpha: float, beta: float, step: float = 2.0, decay: float = 0.5, least: float = 1.1, most: int = 20) -> tuple[float, float, float, dict]:
    """The cheapest of the 3×3 log-neighbourhood, again and again; a round that stays put, or comes back to a place it
    has been, shrinks the step. Alpha's steps are half of beta's in the exponent. Costs are asked once a place."""
    known: dict[tuple[float, float], float] = {}

    def at(a: float, b: float) -> float:
        key = (round(a, 12), round(b, 12))
        if key not in known:
            known[key] = cost(*key)
        return known[key]

    path = [(alpha, beta)]
    for _ in range(most):
        if step < least:
            break
        near = [(alpha * step ** (i / 2), beta * step**j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
        best = min(near, key=lambda p: (at(*p), abs(p[0] - alpha) + abs(p[1] - beta)))
        stuck = best == (alpha, beta) or any(math.isclose(best[0], p[0]) and math.isclose(best[1], p[1]) for p in path)
        alpha, beta = best
        path.append(best)
        if stuck:
            step = step**decay
    return alpha, beta, at(alpha, beta), known


def explore(space: dict[str, list], run: Callable[[dict], tuple[float, float]]) -> list[tuple[dict, float, float]]:
    """(parameters, quality, seconds) of combinations in growing order; one whose every smaller neighbour's time already
    exceeds that of an equally good point is not run."""
    names = list(space)
    done: list[tuple[tuple[int, ...], dict, float, float]] = []
    for at in sorted(itertools.product(*[range(len(v)) for v in space.values()]), key=sum):
        params = {n: space[n][i] for n, i in zip(names, at)}
        floor = max((t for c, _, _, t in done if all(x <= y for x, y in zip(c, at))), default=0.0)
        roof = min((q for c, _, q, _ in done if all(x >= y for x, y in zip(c, at))), default=math.inf)
        if any(q >= roof and t <= floor for _, _, q, t in done):
            continue
        done.append((at, params, *run(params)))
    return [(p, q, t) for _, p, q, t in done]


def pareto(points: list[tuple[dict, float, float]]) -> list[tuple[dict, float, float]]:
    best, out = -math.inf, []
    for p in sorted(points, key=lambda x: (x[2], -x[1])):
        if p[1] > best:
            best = p[1]
            out.append(p)
    return out


#: Two-sided 95 % points of Student's t by degrees of freedom (fixed values); beyond 30 the normal's.
T95 = (12.706, 4.303, 3.182, 2.776, 2.571, 2.447, 2.365, 2.306, 2.262, 2.228, 2.201, 2.179, 2.160, 2.145, 2.131, 2.120, 2.110, 2.101, 2.093, 2.086, 2.080, 2.074, 2.069, 2.064, 2.060, 2.056, 2.052, 2.048, 2.045, 2.042)


def half_width(values: list[float]) -> float:
    """Half of the mean's 95 % interval, as a share of the mean; infinite for one value."""
    n = len(values)
    if n < 2:
        return math.inf
    mean = sum(values) / n
    deviation = math.sqrt(sum((v - mean) ** 2 for v in values) / (n - 1))
    return (T95[n - 2] if n - 2 < len(T95) else 1.96) * deviation / math.sqrt(n) / mean


@dataclass
class Measurement:
    seconds: list[float] = field(default_factory=list)
    queries: int = 0

    @property
    def qps(self) -> float:
        return self.queries * len(self.seconds) / sum(self.seconds)

    @property
    def half_width(self) -> float:
        return half_width([self.queries / s for s in self.seconds])


def measure(run: Callable[[], DataFrame], queries: int, warmup: int = 1, least: int = 3, most: int = 100, target: float | None = 0.05) -> Measurement:
    """Time the whole plan again and again (nothing is collected) until the rate's interval is within ``target``, or
    ``most`` runs; without a target ``least`` runs. The first ``warmup`` runs don't count."""
    out = Measurement([], queries)
    for i in range(warmup + (least if target is None else most)):
        began = time.perf_counter()
        run().write.format("noop").mode("overwrite").save()
        if i >= warmup:
            out.seconds.append(time.perf_counter() - began)
            if target is not None and len(out.seconds) >= least and out.half_width <= target:
                break
    return out


def require_agreement(a: float, b: float, tolerance: float) -> None:
    """Fail unless two runs' figures agree."""
    if abs(a - b) > tolerance * max(abs(a), abs(b)):
        raise RuntimeError(f"runs disagree: {a} and {b}")


def batches(n: int, first: int = 1) -> Iterator[tuple[int, int]]:
    """Stretches of 0..n, each twice as long as the one before."""
    at, size = 0, first
    while at < n:
        yield at, min(n, at + size)
        at, size = at + size, size * 2


class Timers:
    """Seconds and calls by label."""

    def __init__(self) -> None:
        self.total: dict[str, tuple[float, int]] = {}

    def run(self, label: str, f: Callable):
        began = time.perf_counter()
        try:
            return f()
        finally:
            s, n = self.total.get(label, (0.0, 0))
            self.total[label] = (s + time.perf_counter() - began, n + 1)
