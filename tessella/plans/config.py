"""Settings of a run, checked when they are made: unknown names, wrong types and impossible values are errors."""

from __future__ import annotations

import json
from dataclasses import MISSING, dataclass, fields

#: Queries are split by place: the first fit signatures, the next choose settings, the rest are measured (fixed values).
FIT, VALIDATION, TEST = range(0, 512), range(512, 1024), range(1024, 11024)
#: What each method is: (predicate-aware clustering, predicate-aware routing, exact).
METHODS = {"aware": (True, True, False), "routed": (False, True, False), "plain": (False, False, False), "exact": (False, False, True)}


class Settings:
    @classmethod
    def of(cls, values: dict):
        """From a mapping, such as parsed JSON."""
        known = {f.name: f for f in fields(cls)}
        if unknown := sorted(set(values) - set(known)):
            raise ValueError(f"{cls.__name__}: unknown settings {unknown}")
        if missing := sorted(n for n, f in known.items() if f.default is MISSING and n not in values):
            raise ValueError(f"{cls.__name__}: missing settings {missing}")
        return cls(**values)

    @classmethod
    def read(cls, path: str):
        with open(path, encoding="utf-8") as f:
            return cls.of(json.load(f))

    def need(self, fine: bool, what: str) -> None:
        if not fine:
            raise ValueError(f"{type(self).__name__}: {what}")


@dataclass(frozen=True)
class DatasetSettings(Settings):
    name: str
    documents: str
    queries: str
    lists: int
    truth: str | None = None

    def __post_init__(self) -> None:
        self.need(self.lists >= 1, "lists must be at least 1")


@dataclass(frozen=True)
class BuildSettings(Settings):
    method: str = "aware"
    alpha: float = 0.0
    beta: float = 0.0
    signature_dims: int = 16
    rounds: int = 10
    per_list: int = 100

    def __post_init__(self) -> None:
        self.need(self.method in METHODS, f"method must be one of {sorted(METHODS)}")
        self.need(self.alpha >= 0 and self.signature_dims >= 0 and self.rounds >= 1, "alpha, signature_dims and rounds must not be negative")
        clustering, routing, _ = METHODS[self.method]
        self.need(bool(self.alpha) == clustering, "alpha is for predicate-aware clustering, which needs it")
        self.need(not self.beta or routing, "beta is for predicate-aware routing")


@dataclass(frozen=True)
class MeasureSettings(Settings):
    k: int = 10
    batch: int = 100
    warmup: int = 1
    least_runs: int = 3
    most_runs: int = 100
    half_width: float = 0.05
    low: int = 0
    high: int = 10
    steps: int = 40

    def __post_init__(self) -> None:
        self.need(self.k >= 1 and self.batch >= 1 and self.steps >= 1, "k, batch and steps must be at least 1")
        self.need(1 <= self.least_runs <= self.most_runs, "least_runs must not exceed most_runs")
        self.need(0 < self.half_width < 1, "half_width must lie between 0 and 1")
        self.need(self.low <= self.high, "low must not exceed high")


@dataclass(frozen=True)
class TuneSettings(Settings):
    alpha: float = 0.5
    beta: float = 0.1
    step: float = 2.0
    decay: float = 0.5
    goal: float = 0.95

    def __post_init__(self) -> None:
        self.need(self.alpha > 0 and self.beta > 0, "the search starts from positive values")
        self.need(self.step > 1 and 0 < self.decay < 1, "step must exceed 1 and decay lie between 0 and 1")
        self.need(0 < self.goal <= 1, "goal is a recall")


def disjoint(*parts: range) -> None:
    """Fail if two parts of the query split share a query."""
    for i, a in enumerate(parts):
        for b in parts[:i]:
            if max(a.start, b.start) < min(a.stop, b.stop):
                raise ValueError(f"{a} and {b} overlap")
