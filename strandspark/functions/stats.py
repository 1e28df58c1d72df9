"""Columns for intervals and tests on counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The two normal quantiles in use.
Z_SHORT, Z_FULL = 1.96, 1.959963984540054


def wilson(successes: Column, trials: Column, z: float = Z_SHORT) -> tuple[Column, Column]:
    """The Wilson score interval, cut to [0, 1]; (0, 0) without trials."""
    p, n = successes / trials, trials
    centre = (p + z * z / (2 * n)) / (1 + z * z / n)
    margin = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    none = trials < 1
    return F.when(none, 0.0).otherwise(F.greatest(F.lit(0.0), centre - margin)), F.when(none, 0.0).otherwise(F.least(F.lit(1.0), centre + margin))


def mcnemar(only_left: Column, only_right: Column) -> Column:
    """Two-sided exact binomial p of discordant counts: 1 without any. The logs of the binomial terms follow from one another, so large counts neither overflow nor take more than one step each."""
    d = (only_left + only_right).cast("double")
    few = F.least(only_left, only_right).cast("int")
    start = F.struct((-d * F.log(F.lit(2.0))).alias("log"), F.lit(0.0).alias("sum"))
    step = lambda s, i: F.struct((s["log"] + F.log((d - i) / (i + 1))).alias("log"), (s["sum"] + F.exp(s["log"])).alias("sum"))
    total = F.aggregate(F.sequence(F.lit(0), few), start, step, lambda s: s["sum"])
    return F.when(d == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * total))
