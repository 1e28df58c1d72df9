"""Scores and rules as columns: codec policy, storage tiers with lifecycle costs, codec grids, redundancy and objectives."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dna

# The tiers in the order that settles ties, and their traits latency, mutable, durability, idle_energy, long_term, redundancy.
TIERS = {
    "ssd": (1.0, 1.0, 0.45, 0.30, 0.20, 0.70),
    "object_archive": (0.55, 0.65, 0.80, 0.70, 0.65, 0.85),
    "tape": (0.25, 0.30, 0.78, 0.90, 0.80, 0.70),
    "dna_future": (0.05, 0.05, 0.95, 1.0, 1.0, 0.90),
}
# Weight, trait and workload need of each term of a tier's score.
TERMS = (
    (0.14, "long_term", "retention_need"),
    (0.05, "latency", "access_need"),
    (0.03, "latency", "probability_need"),
    (0.10, "mutable", "mutability"),
    (0.12, "latency", "retrieval_urgency"),
    (0.15, "durability", "durability_priority"),
    (0.07, "redundancy", "redundancy_priority"),
    (0.08, "idle_energy", "energy_priority"),
)
INDEX_WEIGHTS = (0.06, 0.04)  # normalised storage and retrieval cost
LIFECYCLE = ((0.04, "storage_cost", "cost_priority"), (0.03, "retrieval_cost", "cost_priority"), (0.04, "energy_kwh", "energy_priority"), (0.04, "latency_hours", "retrieval_urgency"))
DNA_PENALTY = (0.25, 0.20)  # urgency, mutability


def codec_policy(channels: DataFrame) -> DataFrame:
    """channels (substitution, insertion, deletion, dropout, durability, overhead_priority, ...) with chunk_size, rs_nsym, parity_group."""
    error = F.col("substitution") + F.col("insertion") + F.col("deletion")
    dropout, durable = F.col("dropout"), F.col("durability") >= 0.85
    chunk = F.when(error >= 0.02, 48).when(error >= 0.005, 64).otherwise(96)
    nsym = F.when(error >= 0.02, 24).when(error >= 0.005, 16).otherwise(8)
    group = F.when(dropout >= 0.10, 3).when(dropout >= 0.03, 5).otherwise(8)
    more = durable & (nsym < 24)
    nsym2 = F.when(more, nsym + 4).otherwise(nsym)
    thrifty = (F.col("overhead_priority") >= 0.70) & (error < 0.005)
    return (
        channels.withColumn("chunk_size", F.when(more, F.least(chunk, F.lit(80))).otherwise(chunk))
        .withColumn("rs_nsym", F.when(thrifty, F.greatest(F.lit(6), nsym2 - 2)).otherwise(nsym2))
        .withColumn("parity_group", F.when(durable, F.greatest(F.lit(3), group - 1)).otherwise(group))
    )


def _by_tier(tier: Column, values: dict[str, float]) -> Column:
    return reduce(lambda c, kv: c.when(tier == kv[0], kv[1]), list(values.items())[1:], F.when(tier == next(iter(values)), next(iter(values.values()))))


def lifecycle(workloads: DataFrame, assumptions: dict[str, tuple[float, float, float, float, float]]) -> DataFrame:
    """workloads (size_gb, retention_years, accesses_per_year, access_probability?) x tiers with storage_cost, retrieval_cost, energy_kwh, latency_hours.

    assumptions: tier -> storage cost per GB and year, retrieval cost per GB, idle kWh per TB and year, retrieval kWh per GB, latency in hours."""
    if set(assumptions) != set(TIERS):
        raise ValueError("every tier needs its assumptions")
    rows = workloads.withColumn("tier", F.explode(F.array(*map(F.lit, TIERS))))
    a = [_by_tier(F.col("tier"), {t: v[k] for t, v in assumptions.items()}) for k in range(5)]
    chance = F.coalesce("access_probability", F.least(F.lit(1.0), F.col("accesses_per_year")))
    read_gb = F.col("size_gb") * F.col("accesses_per_year") * F.col("retention_years")
    return (
        rows.withColumn("storage_cost", F.col("size_gb") * F.col("retention_years") * a[0])
        .withColumn("retrieval_cost", read_gb * a[1])
        .withColumn("energy_kwh", F.col("size_gb") / 1000 * F.col("retention_years") * a[2] + read_gb * a[3])
        .withColumn("latency_hours", chance * a[4])
    )


def tier_terms(workloads: DataFrame, key: str, assumptions: dict | None = None, storage_index: dict[str, float] | None = None, retrieval_index: dict[str, float] | None = None) -> DataFrame:
    """(key, tier, one column for each trait term, storage_index, retrieval_index, cost, energy, latency, penalty): all that a tier's score adds up from. The lifecycle terms are 0 without assumptions.

    Four rows a workload come of an explode, and the lifecycle's maxima of a window of four."""
    rows = lifecycle(workloads, assumptions) if assumptions else workloads.withColumn("tier", F.explode(F.array(*map(F.lit, TIERS))))
    tier = F.col("tier")
    needs = {"retention_need": F.least(F.lit(1.0), F.col("retention_years") / 100), "access_need": F.least(F.lit(1.0), F.col("accesses_per_year") / 365), "probability_need": F.coalesce("access_probability", F.lit(0.0))}
    names = ("latency", "mutable", "durability", "idle_energy", "long_term", "redundancy")
    trait = lambda t: _by_tier(tier, {x: v[names.index(t)] for x, v in TIERS.items()})
    terms = [(w * trait(t) * (needs[n] if n in needs else F.col(n))).alias(f"{t}_{n}") for w, t, n in TERMS]
    half = {t: 0.5 for t in TIERS}
    for name, weight, index in zip(("storage_index", "retrieval_index"), INDEX_WEIGHTS, (storage_index or half, retrieval_index or half), strict=True):
        terms.append((weight * (1 - _by_tier(tier, index)) * F.col("cost_priority")).alias(name))
    own = Window.partitionBy(key)
    for weight, value, priority in LIFECYCLE:
        top = F.max(value).over(own) if assumptions else F.lit(0.0)
        term = weight * F.when(top <= 0, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.col(value) / top)) * F.col(priority) if assumptions else F.lit(0.0)
        terms.append(term.alias(f"{value}_term"))
    penalty = F.when(tier == "dna_future", DNA_PENALTY[0] * F.col("retrieval_urgency") + DNA_PENALTY[1] * F.col("mutability")).otherwise(0.0)
    return rows.select(key, "tier", *terms, (F.lit(0.0) - penalty).alias("penalty"))


def tier_scores(workloads: DataFrame, key: str, assumptions: dict | None = None, storage_index: dict[str, float] | None = None, retrieval_index: dict[str, float] | None = None) -> DataFrame:
    """(key, tier, score, nth): each workload's tiers by score, the sum of tier_terms and at least 0; equal scores keep the order of TIERS."""
    terms = tier_terms(workloads, key, assumptions, storage_index, retrieval_index)
    scored = terms.select(key, "tier", F.greatest(F.lit(0.0), reduce(Column.__add__, [F.col(c) for c in terms.columns[2:]])).alias("score"))
    place = _by_tier(F.col("tier"), {t: k for k, t in enumerate(TIERS)})
    return scored.withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), place))).select(key, "tier", "score", "nth")


def stratified(rows: DataFrame, strata: list[str], keys: list[str], quota: int, seed: object) -> DataFrame:
    """The rows that turns over the strata give until the quota is reached: in each turn every stratum, in ascending order, gives its next row by hash rank. The same rows for any order of the input.

    How many rows each stratum gives follows from the strata's counts alone, so no stratum but by its own rows is ranked, and rows beyond its share are cut by the window's own limit."""
    counts = [(tuple(r[c] for c in strata), r["n"]) for r in rows.groupBy(*strata).agg(F.count(F.lit(1)).alias("n")).orderBy(*strata).collect()]
    full = max(n for _, n in counts) if counts else 0
    low, high = 0, full  # the most whole turns within the quota
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if sum(min(n, mid) for _, n in counts) <= quota else (low, mid - 1)
    left = quota - sum(min(n, low) for _, n in counts)
    shares = []
    for key, n in counts:
        extra = 1 if n > low and left > 0 else 0
        left -= extra
        shares.append((*key, min(n, low) + extra))
    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in strata)
    table = F.broadcast(rows.sparkSession.createDataFrame(shares, f"{schema}, _share long"))
    ranked = rows.join(table, strata).withColumn("turn", F.row_number().over(Window.partitionBy(*strata).orderBy(dna.hash_rank(seed, *(F.col(c) for c in keys)), *keys)))
    return ranked.filter(F.col("turn") <= F.col("_share")).drop("_share")


def objective_of(workloads: DataFrame) -> DataFrame:
    """Durability, overhead and speed priorities of workloads."""
    return workloads.withColumn("durability", F.col("durability_priority")).withColumn("overhead_priority", F.col("cost_priority")).withColumn("speed_priority", F.col("retrieval_urgency"))


def grid(spark, chunk_sizes, nsyms, schemes, groups, fountain, modes) -> DataFrame:
    """The valid codec candidates of a search space, without repeats: a scheme without a fountain has no fountain ratio, one without parity no group."""
    one = spark.range(1)
    for name, values in (("chunk_size", chunk_sizes), ("rs_nsym", nsyms), ("scheme", schemes), ("parity_group", groups), ("fountain_ratio", fountain), ("mode", modes)):
        one = one.withColumn(name, F.explode(F.array(*map(F.lit, sorted(set(values))))))
    one = one.filter(F.col("chunk_size") + F.col("rs_nsym") + 18 <= 255)
    one = one.withColumn("fountain_ratio", F.when(F.col("scheme").isin("fountain", "hybrid"), F.col("fountain_ratio")).otherwise(0.0))
    return one.drop("id").dropDuplicates()


def redundancy_ratio(chunk: Column, nsym: Column, scheme: Column, group: Column, fountain: Column) -> Column:
    return nsym / (chunk + 18) + F.when(scheme.isin("xor", "hybrid"), 1 / group).otherwise(0.0) + F.when(scheme.isin("fountain", "hybrid"), fountain).otherwise(0.0)


# The signed terms of a candidate's objective; each is divided by its maximum over the candidates.
OBJECTIVE = {"recovery": 1, "instability": -1, "overhead": -1, "redundancy": -1, "runtime": -1}


def objective_rank(candidates: DataFrame, keys: list[str], weights: dict[str, float], within: list[str] | None = None) -> DataFrame:
    """Candidates (keys, recovery, instability, overhead, redundancy, runtime) with score and nth. Weights are shares of their sum; maxima are aggregates joined back, so that
    no single task holds all candidates."""
    total = sum(weights.values())
    within = within or []
    tops = candidates.groupBy(*within).agg(*(F.max(x).alias(f"max_{x}") for x in ("overhead", "redundancy", "runtime")))
    rows = candidates.join(tops, within) if within else candidates.join(F.broadcast(tops))
    share = lambda x: F.when(F.col(f"max_{x}") > 0, F.col(x) / F.col(f"max_{x}")).otherwise(0.0) if x in ("overhead", "redundancy", "runtime") else F.col(x)
    score = reduce(Column.__add__, [F.lit(sign * weights.get(x, 0.0) / total) * share(x) for x, sign in OBJECTIVE.items()])
    rows = rows.withColumn("score", score)
    if not within:
        return rows.select(*keys, "score")
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(*within).orderBy(F.desc("score"), *keys))).select(*within, *keys, "score", "nth")
