"""Column expressions for pass rates, intervals and scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

PUBLISHED_K = (1, 2, 5, 10)
Z_95 = 1.959963984540054


def _draw_ratio(favourable: Column, n: Column, k: int) -> Column:
    """Probability that k draws without replacement all fall in ``favourable`` of ``n``."""
    factors = (
        F.try_divide(F.greatest(favourable - j, F.lit(0)).cast("double"), (n - j).cast("double"))
        for j in range(k)
    )
    return reduce(lambda left, right: left * right, factors)


def pass_at_k(n: Column, c: Column, k: int) -> Column:
    """Chance that at least one of k of the n repeats passed; null when k > n."""
    return F.when(n >= k, F.lit(1.0) - _draw_ratio(n - c, n, k))


def pass_all_at_k(n: Column, c: Column, k: int) -> Column:
    """Chance that all k of the n repeats passed; null when k > n."""
    return F.when(n >= k, _draw_ratio(c, n, k))


def k_map(values: dict[int, Column]) -> Column:
    """``{k: value}`` as a map with text keys, leaving out undefined entries."""
    pairs = F.array(*[F.struct(F.lit(str(k)).alias("key"), v.alias("value")) for k, v in values.items()])
    return F.map_from_entries(F.filter(pairs, lambda pair: pair["value"].isNotNull()))


def wilson_ci(successes: Column, total: Column, z: float = Z_95) -> Column:
    """Wilson score interval as ``struct(low, high)``; null when there is no trial."""
    n = total.cast("double")
    p = F.try_divide(successes.cast("double"), n)
    z2 = z * z
    scale = 1.0 + F.try_divide(F.lit(z2), n)
    middle = (p + F.try_divide(F.lit(z2), 2.0 * n)) / scale
    spread = F.try_divide(p * (1.0 - p) + F.try_divide(F.lit(z2), 4.0 * n), n)
    half = z * F.sqrt(spread) / scale
    bounds = F.struct(
        F.greatest(F.lit(0.0), middle - half).alias("low"),
        F.least(F.lit(1.0), middle + half).alias("high"),
    )
    return F.when(total > 0, bounds)


def clamp01(value: Column) -> Column:
    """Limits a score to [0, 1]; null stays null."""
    return F.when(value.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), value)))


def threshold_score(found: Column, threshold: Column) -> Column:
    """1 for no finding, then falling linearly to 0 at ``threshold`` findings."""
    lost = F.try_divide(found.cast("double"), threshold.cast("double"))
    return F.when(found == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), 1.0 - lost))
