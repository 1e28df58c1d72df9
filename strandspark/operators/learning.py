"""Policy learners as aggregates: inverse-distance votes, kernel regression, ridge moments. Only sums of fixed size reach the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RATES = ["substitution", "insertion", "deletion", "dropout"]
POLICY = ["chunk_size", "rs_nsym", "parity_group"]


def _distance(x: list[str], y: dict[str, float], power: int) -> Column:
    parts = [F.abs(F.col(c) - y[c]) if power == 1 else F.pow(F.col(c) - y[c], F.lit(2.0)) for c in x]
    return sum(parts[1:], parts[0])


def _maxima(observed: DataFrame) -> DataFrame:
    return observed.crossJoin(F.broadcast(observed.agg(F.max("nucleotides").alias("max_nt"), F.max("runtime").alias("max_rt"))))


def empirical(observed: DataFrame, channel: dict[str, float]) -> DataFrame:
    """(policy, score, support): sum of 1 / (.001 + L1 distance) * (+-1 - .15 nucleotides / max - .05 runtime / max)."""
    rows = _maxima(observed)
    worth = F.when(F.col("recovered"), 1.0).otherwise(-1.0) - 0.15 * F.col("nucleotides") / F.col("max_nt") - 0.05 * F.col("runtime") / F.col("max_rt")
    return rows.groupBy(*POLICY).agg(F.sum(worth / (0.001 + _distance(RATES, channel, 1))).alias("score"), F.count(F.lit(1)).alias("support"))


def _utility() -> Column:
    return F.col("recovered").cast("double") - 0.20 * F.col("nucleotides") / F.col("max_nt") - 0.05 * F.col("runtime") / F.col("max_rt")


def kernel(observed: DataFrame, channel: dict[str, float], width: float = 0.02) -> DataFrame:
    """(policy, utility): Gaussian-weighted mean utility; -1e6 where no weight is left."""
    w = F.exp(-_distance(RATES, channel, 2) / (2 * width * width))
    sums = _maxima(observed).groupBy(*POLICY).agg(F.sum(w * _utility()).alias("wu"), F.sum(w).alias("w"))
    return sums.select(*POLICY, F.when(F.col("w") <= 1e-15, -1e6).otherwise(F.col("wu") / F.col("w")).alias("utility"))


def features() -> list[Column]:
    """1, the rates, the policy in shares of its usual top values, masks left out, and the products of error or dropout with protection."""
    error = F.col("substitution") + F.col("insertion") + F.col("deletion")
    chunk, nsym, group = F.col("chunk_size") / 100, F.col("rs_nsym") / 32, F.col("parity_group") / 8
    return [F.lit(1.0), *(F.col(c) for c in RATES), chunk, nsym, group, error * nsym, error * chunk, F.col("dropout") / F.col("parity_group"), F.col("dropout") * nsym]


def moments(observed: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One row (for each key) of all sums of products of features, and of features with the utility: xx (upper triangle by rows), xy."""
    x = features()
    rows = _maxima(observed)
    pairs = [F.sum(x[i] * x[j]).alias(f"m_{i}_{j}") for i in range(len(x)) for j in range(i, len(x))]
    return rows.groupBy(*(by or [])).agg(*pairs, *(F.sum(c * _utility()).alias(f"v_{i}") for i, c in enumerate(x)))


def _system(row) -> tuple[np.ndarray, np.ndarray]:
    n = len(features())
    return np.array([[row[f"m_{min(i, j)}_{max(i, j)}"] for j in range(n)] for i in range(n)]), np.array([row[f"v_{i}"] for i in range(n)])


def _solution(a: np.ndarray, b: np.ndarray, penalty: float) -> np.ndarray:
    return np.linalg.solve(a + penalty * np.eye(len(b)), b)


def ridge(observed: DataFrame, penalty: float = 1e-3) -> np.ndarray:
    """Coefficients with every feature penalised, the intercept too. The system has a dozen unknowns."""
    return _solution(*_system(moments(observed).first()), penalty)


#: Folds whose moments may come to the driver; a row of them is some eighty doubles.
MOST_FOLDS = 10_000


def ridge_without(observed: DataFrame, fold: str, penalty: float = 1e-3) -> dict[object, np.ndarray]:
    """For each fold, the coefficients fitted on all other folds: its moments taken off the total, so that one pass over the rows serves all fits. At most MOST_FOLDS folds."""
    rows = moments(observed, [fold]).limit(MOST_FOLDS + 1).collect()
    if len(rows) > MOST_FOLDS:
        raise ValueError(f"more than {MOST_FOLDS} folds")
    systems = {r[fold]: _system(r) for r in rows}
    a, b = (np.sum([x[k] for x in systems.values()], axis=0) for k in (0, 1))
    return {f: _solution(a - x, b - y, penalty) for f, (x, y) in systems.items()}


def means_without(observed: DataFrame, fold: str) -> DataFrame:
    """(fold, policy, predicted): each policy's mean utility over all other folds; null where no other fold has it."""
    rows = _maxima(observed).groupBy(fold, *POLICY).agg(F.sum(_utility()).alias("u"), F.count(F.lit(1)).alias("n"))
    total = rows.groupBy(*POLICY).agg(F.sum("u").alias("tu"), F.sum("n").alias("tn"))
    left = F.col("tn") - F.col("n")
    return rows.join(total, POLICY).select(fold, *POLICY, F.when(left > 0, (F.col("tu") - F.col("u")) / left).alias("predicted"))


def fitted_without(observed: DataFrame, fold: str, penalty: float = 1e-3) -> DataFrame:
    """observed with predicted, the utility that the ridge model of all other folds gives."""
    fits = ridge_without(observed, fold, penalty)
    kind = observed.schema[fold].dataType.simpleString()
    table = observed.sparkSession.createDataFrame([(f, [float(x) for x in c]) for f, c in fits.items()], f"{fold} {kind}, _c array<double>")
    parts = [F.col("_c")[k] * x for k, x in enumerate(features())]
    return observed.join(F.broadcast(table), fold).withColumn("predicted", sum(parts[1:], parts[0])).drop("_c")


def evaluated(rows: DataFrame, fold: str, group: list[str], tie: list[str]) -> DataFrame:
    """(fold, groups, mean_regret, recovery_rate, accuracy) of choosing by `predicted` among the policies of each group of held-out rows that has two or more.

    A group's choice is the policy predicted best, the smallest of equal ones, and stands for that policy's best row: recovered, then least overhead, then least runtime, then the tie keys. Its regret is
    what the group's best row has more of recovered - .20 overhead / largest - .05 runtime / largest of the group. Policies without a prediction come last. Both aggregates combine on the map side."""
    keys = [fold, *group]
    most = rows.groupBy(*keys).agg(F.max("overhead").alias("_o"), F.max("runtime").alias("_r"), (F.min(F.struct(*POLICY)) != F.max(F.struct(*POLICY))).alias("_several")).filter("_several")
    worth = F.col("recovered").cast("int") - 0.20 * F.col("overhead") / F.col("_o") - 0.05 * F.col("runtime") / F.col("_r")
    order = F.struct(F.col("predicted").isNull().alias("none"), (-F.coalesce("predicted", F.lit(0.0))).alias("p"), *POLICY, (~F.col("recovered")).alias("lost"), "overhead", "runtime", *tie)
    each = rows.join(most, keys).withColumn("_u", worth).groupBy(*keys).agg(F.max("_u").alias("top"), F.min_by(F.struct("_u", "recovered"), order).alias("x"))
    each = each.select(fold, F.col("x._u").alias("u"), "top", F.col("x.recovered").alias("recovered"))
    return each.groupBy(fold).agg(
        F.count(F.lit(1)).alias("groups"), F.avg(F.greatest(F.lit(0.0), F.col("top") - F.col("u"))).alias("mean_regret"),
        F.avg(F.col("recovered").cast("int")).alias("recovery_rate"), F.avg((F.col("u") >= F.col("top")).cast("int")).alias("accuracy"),
    )


def predicted(rows: DataFrame, coefficients: np.ndarray) -> DataFrame:
    """rows with their predicted utility."""
    parts = [float(c) * x for c, x in zip(coefficients, features(), strict=True)]
    return rows.withColumn("utility", sum(parts[1:], parts[0]))


def recommended(scores: DataFrame, by: str) -> DataFrame:
    """The one policy with the best score, the smallest of equal ones."""
    policy = F.struct(*((-F.col(c)).alias(c) for c in POLICY))
    best = scores.agg(F.max(F.struct(F.col(by).alias("best"), policy.alias("policy"))).alias("x"))
    return best.filter("x is not null").select(*((-F.col(f"x.policy.{c}")).alias(c) for c in POLICY), F.col("x.best").alias(by))
