"""Tail probabilities as Column expressions: complementary error function, chi-square with one
degree of freedom, binomial with even odds.

Spark SQL has no erfc and no lgamma, so these are sums and continued fractions of a fixed or
stated length, folded by ``aggregate`` inside the JVM.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

SERIES_BELOW = 2.5  # erfc: 1 - the series of erf below, a continued fraction from here on
TERMS = 80
#: ln(n!) minus its Stirling approximation for n = 0..15; larger n use the asymptotic series.
STIRLING_ERROR = [math.lgamma(n + 1) - ((n + 0.5) * math.log(n) - n + 0.5 * math.log(2 * math.pi)) if n else 0.0 for n in range(16)]


def _fold(n: Column | int, start: Column, step) -> Column:
    """``start`` folded over 1..n."""
    return F.aggregate(F.sequence(F.lit(1), n if isinstance(n, Column) else F.lit(n)), start, step)


def erfc(z: Column) -> Column:
    """Complementary error function for z >= 0, to about 1e-13 of its value."""
    acc = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def add(a, j):
        term = a["term"] * 2 * z * z / (2 * j + 1)
        return F.struct(term.alias("term"), (a["sum"] + term).alias("sum"))

    near = 1 - 2 / math.sqrt(math.pi) * z * F.exp(-z * z) * _fold(TERMS, acc, add)["sum"]
    # from the innermost quotient outwards
    tail = _fold(TERMS, F.lit(0.0), lambda f, j: (TERMS + 1 - j) / 2 / (z + f))
    far = F.exp(-z * z) / math.sqrt(math.pi) / (z + tail)
    return F.when(z < SERIES_BELOW, near).otherwise(far)


def chi2_1df_sf(x: Column) -> Column:
    """P[chi-square with one degree of freedom > x]."""
    return erfc(F.sqrt(x / 2))


def _stirling_error(n: Column) -> Column:
    x = n.cast("double")
    series = (1 / 12 - (1 / 360 - (1 / 1260 - (1 / 1680 - 1 / 1188 / (x * x)) / (x * x)) / (x * x)) / (x * x)) / x
    table = F.array(*[F.lit(v) for v in STIRLING_ERROR])
    return F.when(n < len(STIRLING_ERROR), F.element_at(table, (F.least(n, F.lit(len(STIRLING_ERROR) - 1)) + 1).cast("int"))).otherwise(series)


def _log_binomial_half(n: Column, k: Column) -> Column:
    """ln of P[Bin(n, 1/2) = k] for k <= n / 2, by its deviance from the centre, so that no large logarithms cancel."""
    rest = n - k
    d = (rest - k) / n
    deviance = n / 2 * ((1 - d) * F.log1p(-d) + (1 + d) * F.log1p(d))
    inside = _stirling_error(n) - _stirling_error(k) - _stirling_error(rest) - deviance + 0.5 * F.log(n / (2 * math.pi * k * rest))
    return F.when(k == 0, n * math.log(0.5)).otherwise(inside)


def binomial_half_log10_two_sided(b: Column, c: Column) -> Column:
    """log10 of min(1, 2 P[Bin(b + c, 1/2) <= min(b, c)]): the exact two-sided sign test.

    Terms are summed from the largest down, as far as they count: a term's ratio to the one above
    is at most 1 - 2 i / n after i steps, so ten square roots of n are enough.
    """
    n, k = (b + c).cast("long"), F.least(b, c).cast("long")
    steps = F.least(k, F.ceil(10 * F.sqrt(n.cast("double"))) + 50).cast("int")
    acc = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def add(a, j):
        term = a["term"] * (k - j + 1) / (n - k + j)
        return F.struct(term.alias("term"), (a["sum"] + term).alias("sum"))

    total = F.when(steps > 0, _fold(F.greatest(steps, F.lit(1)), acc, add)["sum"]).otherwise(F.lit(1.0))
    log_p = (_log_binomial_half(n, k) + F.log(total) + math.log(2)) / math.log(10)
    return F.when(n == 0, 0.0).otherwise(F.least(F.lit(0.0), log_p))
