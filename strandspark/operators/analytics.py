"""Experiment statistics over trial facts: summaries with intervals, paired effects, exact tests, regret, division, slopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats

KEYS = ["strategy", "scenario", "payload_size"]


def summary(trials: DataFrame, keys: list[str] = KEYS, z: float = stats.Z_SHORT) -> DataFrame:
    """Trials, successes, rate with its Wilson interval, mean overhead and runtime of each group. One shuffle, summed on the map side."""
    rows = trials.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("trials"), F.sum(F.col("recovered").cast("long")).alias("successes"), F.avg("overhead").alias("mean_overhead"), F.avg("runtime").alias("mean_runtime")
    )
    low, high = stats.wilson(F.col("successes"), F.col("trials"), z)
    return rows.withColumn("rate", F.col("successes") / F.col("trials")).withColumn("low", low).withColumn("high", high)


def _one_of(rows: DataFrame, keys: list[str], chosen: Column) -> DataFrame:
    """rows with one row for each key, chosen by an aggregate, which combines before the shuffle."""
    return rows.groupBy(*keys).agg(chosen.alias("_row")).select(*keys, "_row.*").select(*rows.columns)


def last_of(trials: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last trial of each key."""
    return _one_of(trials, keys, F.max_by(F.struct(*(c for c in trials.columns if c not in keys)), F.struct(*order)))


def paired_effects(trials: DataFrame, baseline: str, order: list[str]) -> DataFrame:
    """(strategy, scenario, payload_size, pairs, rate_difference, overhead_difference, runtime_difference) against the baseline's trial of the same scenario, size and seed, its last one if it has several."""
    key = ["scenario", "payload_size", "seed"]
    base = last_of(trials.filter(F.col("strategy") == baseline), key, order).select(*key, *(F.col(c).alias(f"b_{c}") for c in ("recovered", "overhead", "runtime")))
    joined = trials.filter(F.col("strategy") != baseline).join(base, key)
    return joined.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("pairs"),
        F.avg(F.col("recovered").cast("int") - F.col("b_recovered").cast("int")).alias("rate_difference"),
        F.avg(F.col("overhead") - F.col("b_overhead")).alias("overhead_difference"),
        F.avg(F.col("runtime") - F.col("b_runtime")).alias("runtime_difference"),
    )


def mcnemar(left: DataFrame, right: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """(by, only_left, only_right, p): discordant pairs of two methods' rows (keys, by, ok) and the exact test."""
    both = left.select(*keys, *by, F.col("ok").alias("l")).join(right.select(*keys, *by, F.col("ok").alias("r")), [*keys, *by])
    counts = both.groupBy(*by).agg(F.count_if(F.col("l") & ~F.col("r")).alias("only_left"), F.count_if(~F.col("l") & F.col("r")).alias("only_right"))
    return counts.withColumn("p", stats.mcnemar(F.col("only_left"), F.col("only_right")))


def regret(trials: DataFrame, candidates: list[str]) -> DataFrame:
    """(strategy, groups, mean_regret, best): against the best candidate of the same scenario, size and seed, where it has two or more. Utility = recovered - .20 overhead / max - .05 runtime / max."""
    keys = ["scenario", "payload_size", "seed"]
    rows = trials.filter(F.col("strategy").isin(candidates))
    most = rows.groupBy(*keys).agg(F.max("overhead").alias("_o"), F.max("runtime").alias("_r"), F.size(F.collect_set("strategy")).alias("_kinds")).filter("_kinds >= 2")
    u = F.col("recovered").cast("int") - 0.20 * F.col("overhead") / F.col("_o") - 0.05 * F.col("runtime") / F.col("_r")
    each = rows.join(most, keys).groupBy(*keys, "strategy").agg(F.max(u).alias("u"))
    each = each.withColumn("top", F.max("u").over(Window.partitionBy(*keys)))  # a row for each strategy
    return each.groupBy("strategy").agg(F.count(F.lit(1)).alias("groups"), F.avg(F.greatest(F.lit(0.0), F.col("top") - F.col("u"))).alias("mean_regret"), F.count_if(F.col("top") == F.col("u")).alias("best"))


def log_slope(rows: DataFrame, size: str, metric: str, by: list[str] | None = None) -> DataFrame:
    """(by, slope, memory_class, runtime_class): the least-squares slope of ln(metric) on ln(size)."""
    fit = rows.filter((F.col(size) > 0) & (F.col(metric) > 0)).groupBy(*(by or [])).agg(F.regr_slope(F.log(metric), F.log(size)).alias("slope"))
    slope = F.col("slope")
    memory = F.when(slope.isNull(), "unknown").when(slope < 0.25, "bounded").when(slope <= 1.25, "linear").otherwise("super-linear")
    return fit.withColumn("memory_class", memory).withColumn("runtime_class", F.when(slope.isNull(), "unknown").when(slope <= 1.25, "linear-or-better").otherwise("super-linear"))


def completed_by_all(rows: DataFrame, item: str, method: str) -> DataFrame:
    """The items that every method of rows (item, method, ok) has completed: relational division."""
    methods = rows.select(method).distinct().agg(F.count(F.lit(1)).alias("methods"))
    done = rows.filter("ok").groupBy(item).agg(F.count_distinct(method).alias("done"))
    return done.crossJoin(F.broadcast(methods)).filter("done = methods").select(item)


def first_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the given order."""
    return _one_of(rows, keys, F.min_by(F.struct(*(c for c in rows.columns if c not in keys)), F.struct(*order)))


def distances(rows: DataFrame, by: list[str]) -> DataFrame:
    """Mean, median and largest edit distance, and how many rows are 0, 1, 2 and 3 or more edits off."""
    d = F.col("distance")
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(d).alias("mean"), F.median(d).alias("median"), F.max(d).alias("worst"),
        *(F.count_if(d == k).alias(f"edits_{k}") for k in range(3)), F.count_if(d >= 3).alias("edits_3_up"),
    )


def conflicts(rows: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """(keys, copies, versions): how often each key occurs and in how many different contents; more than one is a conflict."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies"), F.count_distinct(F.sha2(F.to_json(F.struct(*fields)), 256)).alias("versions"))


def profile_comparison(left: DataFrame, right: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """(keys, left_/right_/change_ of each metric, side): two summaries side by side, keys that only one of them has included."""
    a = left.select(*keys, *(F.col(m).alias(f"left_{m}") for m in metrics), F.lit(True).alias("_l"))
    b = right.select(*keys, *(F.col(m).alias(f"right_{m}") for m in metrics), F.lit(True).alias("_r"))
    side = F.when(F.col("_r").isNull(), "left only").when(F.col("_l").isNull(), "right only").otherwise("both")
    return a.join(b, keys, "full").select(*keys, *(c for m in metrics for c in (f"left_{m}", f"right_{m}")), *((F.col(f"right_{m}") - F.col(f"left_{m}")).alias(f"change_{m}") for m in metrics), side.alias("side"))


def timeouts(trials: DataFrame, keys: list[str], limit: float) -> DataFrame:
    """(keys, trials, timeouts, completed, recovered, timeout_rate, median_runtime): trials above the limit count as timed out, and the median is that of the others."""
    late = F.col("runtime") > limit
    return trials.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("trials"), F.count_if(late).alias("timeouts"), F.count_if(~late).alias("completed"), F.count_if(~late & F.col("recovered")).alias("recovered"),
        F.avg(late.cast("int")).alias("timeout_rate"), F.median(F.when(~late, F.col("runtime"))).alias("median_runtime"),
    )


def hotspots(trials: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, kind, name, n) of trials (keys, verified, timed_out, stage, stack array of (file, line, function)), nothing left out: how many trials, successes and timeouts there are, in which stages
    trials timed out (null: unknown), and which innermost frame each was stopped in, as file:line:function with ? for what is null; a timeout without a stack has no location. Kinds without rows are absent,
    but for trials. Nulls in verified and timed_out count as false."""
    late = F.coalesce("timed_out", F.lit(False))
    frame = F.when(late & (F.size("stack") > 0), F.element_at("stack", -1))
    at = F.concat_ws(":", *(F.coalesce(frame[x].cast("string"), F.lit("?")) for x in ("file", "line", "function")))
    facts = [
        (F.lit(True), "trials", F.lit("all")), (F.coalesce("verified", F.lit(False)), "successes", F.lit("all")), (late, "timeouts", F.lit("all")),
        (late, "stage", F.coalesce("stage", F.lit("unknown"))), (late & (F.size("stack") > 0), "location", at),
    ]
    said = F.array(*(F.when(c, F.struct(F.lit(kind).alias("kind"), name.alias("name"))) for c, kind, name in facts))
    return trials.select(*keys, F.explode(said).alias("x")).filter("x is not null").groupBy(*keys, "x.kind", "x.name").agg(F.count(F.lit(1)).alias("n"))


def assignment_histograms(assigned: DataFrame, reads: DataFrame) -> DataFrame:
    """(measure, value, n): how many reads (id, seq) have each length, how many of assigned (id, ref, hits, distance) each number of anchor hits and each distance, and how many references each number of reads."""
    lengths = reads.groupBy(F.lit("read_length").alias("measure"), F.length("seq").cast("long").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    each = F.array(*(F.struct(F.lit(name).alias("measure"), F.col(c).cast("long").alias("value")) for name, c in (("anchor_hits", "hits"), ("distance", "distance"))))
    own = assigned.select(F.explode(each).alias("x")).groupBy("x.measure", "x.value").agg(F.count(F.lit(1)).alias("n"))
    sizes = assigned.groupBy("ref").agg(F.count(F.lit(1)).alias("value")).groupBy(F.lit("reads_of_reference").alias("measure"), "value").agg(F.count(F.lit(1)).alias("n"))
    return lengths.unionByName(own).unionByName(sizes)


def partials(trials: DataFrame, keys: list[str]) -> DataFrame:
    """Sums of one shard of trials that add up over shards."""
    return trials.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("recovered").cast("long")).alias("successes"), F.sum("overhead").alias("overhead"), F.sum("runtime").alias("runtime"))


def reaggregated(shards: list[DataFrame], keys: list[str], z: float = stats.Z_SHORT) -> DataFrame:
    """The summary of all shards' partials."""
    rows = shards[0]
    for x in shards[1:]:
        rows = rows.unionByName(x)
    rows = rows.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in ("n", "successes", "overhead", "runtime")))
    low, high = stats.wilson(F.col("successes"), F.col("n"), z)
    mean = {f"mean_{c}": F.col(c) / F.col("n") for c in ("overhead", "runtime")}
    return rows.select(*keys, F.col("n").alias("trials"), "successes", (F.col("successes") / F.col("n")).alias("rate"), low.alias("low"), high.alias("high"), *(v.alias(k) for k, v in mean.items()))


def assignment_summary(assigned: DataFrame, total: DataFrame) -> DataFrame:
    """(reads, mapped, mapping_rate, reversed, references, median_distance, exact) of assigned (id, ref, reverse, distance) among all reads of total."""
    all_ = total.agg(F.count(F.lit(1)).alias("reads"))
    own = assigned.agg(F.count(F.lit(1)).alias("mapped"), F.count_if("reverse").alias("reversed"), F.count_distinct("ref").alias("references"), F.median("distance").alias("median_distance"), F.count_if(F.col("distance") == 0).alias("exact"))
    return all_.join(own).select("reads", "mapped", (F.col("mapped") / F.col("reads")).alias("mapping_rate"), "reversed", "references", "median_distance", "exact")


def design(spark, axes: dict[str, list]) -> DataFrame:
    """One row for each combination of the axes' values: the keys that a complete experiment has. Values are stated, so the rows come of literals, not of data."""
    rows = spark.range(1)
    for name, values in axes.items():
        rows = rows.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    return rows.drop("id")


def gaps(rows: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, reason, n): keys of the design without a row (missing), of rows outside the design (surplus), and of several rows (repeated), with their number of rows. One aggregate and one full join;
    null keys are compared as values."""
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    have, want = counts.alias("have"), expected.select(*keys).distinct().withColumn("_want", F.lit(True)).alias("want")
    same = [F.col(f"have.{k}").eqNullSafe(F.col(f"want.{k}")) for k in keys]
    both = have.join(want, same, "full")
    n = F.coalesce("_n", F.lit(0).cast("long"))
    reason = F.when(F.col("_n").isNull(), "missing").when(F.col("_want").isNull(), "surplus").when(n > 1, "repeated")
    key = [F.when(F.col("_n").isNull(), F.col(f"want.{k}")).otherwise(F.col(f"have.{k}")).alias(k) for k in keys]
    return both.select(*key, reason.alias("reason"), n.alias("n")).filter("reason is not null")


def gates(found: DataFrame, limits: dict[str, int]) -> DataFrame:
    """(failures, passed) of gaps(): a text for each reason that more keys have than its limit allows."""
    counts = found.groupBy().agg(*(F.count_if(F.col("reason") == r).alias(r) for r in limits))
    said = F.array(*(F.when(F.col(r) > most, F.format_string(f"%d keys {r}, at most {most}", F.col(r))) for r, most in limits.items()))
    return counts.select(F.filter(said, lambda x: x.isNotNull()).alias("failures")).withColumn("passed", F.size("failures") == 0)
