"""Distances and vector arithmetic as Column expressions over ``array`` columns, accumulated in double, in element order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def doubles(v) -> Column:
    return _col(v).cast("array<double>")


def _total(terms: Column) -> Column:
    return F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)


def _pairs(a, b, f: Callable[[Column, Column], Column]) -> Column:
    return F.zip_with(_col(a), _col(b), lambda x, y: f(x.cast("double"), y.cast("double")))


def inner_product(a, b) -> Column:
    return _total(_pairs(a, b, lambda x, y: x * y))


def l2(a, b) -> Column:
    """Squared Euclidean distance (no root)."""
    return _total(_pairs(a, b, lambda x, y: (x - y) * (x - y)))


def l1(a, b) -> Column:
    return _total(_pairs(a, b, lambda x, y: F.abs(x - y)))


def linf(a, b) -> Column:
    return F.array_max(_pairs(a, b, lambda x, y: F.abs(x - y)))


def lp(a, b, p: float) -> Column:
    """Sum of |x-y|^p (no p-th root)."""
    return _total(_pairs(a, b, lambda x, y: F.pow(F.abs(x - y), F.lit(float(p)))))


def canberra(a, b) -> Column:
    """Sum of |x-y| / (|x|+|y|); a pair of zeros makes the whole distance NaN."""

    def term(x: Column, y: Column) -> Column:
        below = F.abs(x) + F.abs(y)
        return F.when(below == 0, F.lit(float("nan"))).otherwise(F.try_divide(F.abs(x - y), below))

    return _total(_pairs(a, b, term))


def bray_curtis(a, b) -> Column:
    top, below = _total(_pairs(a, b, lambda x, y: F.abs(x - y))), _total(_pairs(a, b, lambda x, y: F.abs(x + y)))
    return F.when(below == 0, F.lit(float("nan"))).otherwise(F.try_divide(top, below))


def jensen_shannon(a, b) -> Column:
    def part(x: Column, m: Column) -> Column:
        return F.when(x > 0, -x * F.ln(F.try_divide(m, x))).otherwise(0.0)

    return _total(_pairs(a, b, lambda x, y: part(x, (x + y) / 2) + part(y, (x + y) / 2))) * 0.5


def jaccard(a, b) -> Column:
    """Sum of minima over sum of maxima: a similarity."""
    top, below = _total(_pairs(a, b, F.least)), _total(_pairs(a, b, F.greatest))
    return F.when(below == 0, F.lit(float("nan"))).otherwise(F.try_divide(top, below))


def nan_euclidean(a, b) -> Column:
    """Squared distance over the dimensions present in both, scaled up to all; NaN if there is none."""
    present = F.filter(_pairs(a, b, lambda x, y: (x - y) * (x - y)), lambda t: ~F.isnan(t))
    return F.when(F.size(present) == 0, F.lit(float("nan"))).otherwise(F.try_divide(F.size(_col(a)).cast("double"), F.size(present).cast("double")) * _total(present))


def gower(a, b) -> Column:
    """Mean over dimensions: |x-y| where both are in [0,1], 0/1 mismatch where both are negative (categories); NaN dims skip;
    mixed signs or a range over 1 give NaN."""
    bad = F.lit(float("nan"))

    def term(x: Column, y: Column) -> Column:
        numeric = F.when(F.abs(x - y) <= 1, F.abs(x - y)).otherwise(bad)
        return F.when((x >= 0) & (y >= 0), numeric).when((x < 0) & (y < 0), F.when(x == y, 0.0).otherwise(1.0)).otherwise(bad)

    valid = F.filter(F.arrays_zip(doubles(a).alias("x"), doubles(b).alias("y")), lambda p: ~F.isnan(p["x"]) & ~F.isnan(p["y"]))
    return F.when(F.size(valid) == 0, bad).otherwise(_total(F.transform(valid, lambda p: term(p["x"], p["y"]))) / F.greatest(F.size(valid), F.lit(1)))


#: Metric name -> (expression, larger is better).
METRICS: dict[str, tuple[Callable, bool]] = {
    "inner_product": (inner_product, True), "l2": (l2, False), "l1": (l1, False), "linf": (linf, False), "lp": (lp, False), "canberra": (canberra, False),
    "bray_curtis": (bray_curtis, False), "jensen_shannon": (jensen_shannon, False), "jaccard": (jaccard, True), "nan_euclidean": (nan_euclidean, False), "gower": (gower, False),
}


def is_similarity(metric: str) -> bool:
    return METRICS[metric][1]


def distance(metric: str, a, b, arg: float | None = None) -> Column:
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}")
    return lp(a, b, 2.0 if arg is None else arg) if metric == "lp" else METRICS[metric][0](a, b)


def norm_squared(v) -> Column:
    return inner_product(v, v)


def norm(v) -> Column:
    return F.sqrt(norm_squared(v))


def normalize(v) -> Column:
    """Unit vector; a zero vector stays as it is."""
    n = norm(v)
    return F.when(n == 0, doubles(v)).otherwise(F.transform(_col(v), lambda x: F.try_divide(x.cast("double"), n)))


def normalize_strict(v) -> Column:
    """Unit vector; a zero vector is an error."""
    return F.when(norm(v) == 0, F.raise_error(F.lit("zero vector cannot be normalised")).cast("array<double>")).otherwise(normalize(v))


def add(a, b) -> Column:
    return _pairs(a, b, lambda x, y: x + y)


def subtract(a, b) -> Column:
    return _pairs(a, b, lambda x, y: x - y)


def multiply_add(a, factor: float, b) -> Column:
    return _pairs(a, b, lambda x, y: x + y * factor)


def multiply_add_argmin(a, factor: float, b) -> Column:
    """``a + factor·b`` and the place of its least component, the first of equal ones."""
    total = multiply_add(a, factor, b)
    return F.struct(total.alias("vec"), (F.array_position(total, F.array_min(total)) - 1).alias("argmin"))


def l2_from_inner_product(a_norm, b_norm, ip) -> Column:
    return _col(a_norm) + _col(b_norm) - 2 * _col(ip)


def matrix_multiply(rows: list[list[float]], v, bias: list[float] | None = None) -> Column:
    """``A v + b`` with a constant matrix."""
    matrix = F.array(*[F.array(*[F.lit(float(x)) for x in r]) for r in rows])
    product = F.transform(matrix, lambda r: inner_product(r, v))
    return product if bias is None else add(product, F.array(*[F.lit(float(x)) for x in bias]))


def hamming(a, b) -> Column:
    """Differing bits of two arrays of 64-bit words."""
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def generalized_hamming(a, b) -> Column:
    """Differing elements (bytes) of two arrays."""
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: (x != y).cast("int")), F.lit(0), lambda s, x: s + x)


def sign_words(v, thresholds=None) -> Column:
    """Bits ``x >= threshold`` (0 by default) packed from the lowest up into 64-bit words; a last word may be part-filled."""
    bits = F.transform(_col(v), lambda x: (x.cast("double") >= 0).cast("long")) if thresholds is None else _pairs(v, thresholds, lambda x, y: (x >= y).cast("long"))
    size = F.size(_col(v))

    def word(w: Column) -> Column:
        own = F.slice(bits, w * 64 + 1, F.least(F.lit(64), size - w * 64))
        return F.aggregate(F.transform(own, lambda b, i: F.call_function("shiftleft", b, i)), F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(x))

    return F.transform(F.sequence(F.lit(0), F.ceil(size / 64).cast("int") - 1), word)


def words_to_signs(words, size: int) -> Column:
    """The ±1 vector of packed bits."""
    return _once(words, lambda own: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.when(F.call_function("getbit", F.get(own, (i / 64).cast("int")), i % 64) == 1, 1.0).otherwise(-1.0)))


def _once(value, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once a row, however often ``body`` names it: Spark else puts the value's own
    expression into each place."""
    return F.get(F.transform(F.array(_col(value)), body), F.lit(0))


def shuffle_bits(words, order: list[int]) -> Column:
    """Packed bits in another order: bit ``i`` of the result is bit ``order[i]``."""

    def word(words: Column, w: int) -> Column:
        own = [F.call_function("shiftleft", F.call_function("getbit", F.get(words, F.lit(b // 64)), F.lit(b % 64)).cast("long"), F.lit(i)) for i, b in enumerate(order[w : w + 64])]
        return F.aggregate(F.array(*own), F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(x))

    return _once(words, lambda own: F.array(*[word(own, w) for w in range(0, len(order), 64)]))


def pack_bits(values, bits: int) -> Column:
    """Small integers of ``bits`` bits each as one long, the first lowest (at most 64 bits in all)."""
    return F.aggregate(F.transform(_col(values), lambda x, i: F.call_function("shiftleft", x.cast("long"), i * bits)), F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(x))


def unpack_bits(word, bits: int, n: int) -> Column:
    mask = (1 << bits) - 1
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.call_function("shiftrightunsigned", _col(word), i * bits).bitwiseAND(F.lit(mask).cast("long")).cast("int"))
