"""Commands over files: python -m strandspark.cli VERB ...; each is one Spark job whose results are written as a table or shown."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import archive, channel, consensus, scoring
from .plans.store import kept
from .sources import sequences


def _payloads(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select(F.substring_index("path", "/", -1).alias("archive"), F.col("content").alias("payload"))


def _config(a: argparse.Namespace) -> archive.Config:
    c = archive.profile(a.profile)
    return c if a.scheme is None else archive.Config(c.chunk_size, a.scheme, c.group, c.layers, c.degree, c.rescue, c.layout)


def encode(spark: SparkSession, a: argparse.Namespace) -> None:
    """Files to strands; metadata beside them."""
    c, p = _config(a), _payloads(spark, a.input)
    archive.metadata(p, c).write.parquet(f"{a.output}/metadata")
    archive.encoded(p, c).withColumn("ordinal", F.monotonically_increasing_id()).write.parquet(f"{a.output}/strands")


def _reads(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    return spark.read.parquet(a.reads or f"{a.input}/strands").select("archive", "ordinal", "seq")


def recover(spark: SparkSession, a: argparse.Namespace) -> None:
    """Strands or reads to verified payloads; with --consensus the reads' clusters add consensus strands."""
    c, reads = _config(a), _reads(spark, a)
    if a.consensus:
        each = kept(reads.select(F.struct("archive", "ordinal").alias("key"), "seq").withColumn("id", F.monotonically_increasing_id()), "reads")
        built = consensus.graph_reconstruction(each.select("id", "seq"), a.threshold, a.consensus)
        owner = each.select(F.col("id").alias("cluster"), F.col("key.archive").alias("archive"))
        reads = reads.unionByName(built.join(owner, "cluster").select("archive", (F.col("cluster") + (1 << 40)).alias("ordinal"), F.col("consensus").alias("seq")))
    archive.recovered(reads, spark.read.parquet(f"{a.input}/metadata"), c).write.parquet(a.output)


def simulate(spark: SparkSession, a: argparse.Namespace) -> None:
    """Noisy reads of an archive's strands."""
    s = spark.read.parquet(f"{a.input}/strands")
    c = channel.Channel(a.substitution, a.insertion, a.deletion, a.dropout, a.duplicate, a.seed, a.copies)
    r = channel.reads(s.select(F.col("ordinal").alias("id"), "seq"), c).join(s.select(F.col("ordinal").alias("id"), "archive"), "id")
    r.select("archive", (F.col("id") * 64 + F.col("copy")).alias("ordinal"), "seq").write.parquet(a.output)


def inspect(spark: SparkSession, a: argparse.Namespace) -> None:
    archive.statistics(spark.read.parquet(f"{a.input}/strands")).show(truncate=False)


def evaluate(spark: SparkSession, a: argparse.Namespace) -> None:
    """Reads against references: assignment and consensus."""
    from .operators import similarity

    refs = sequences.sequences(spark, a.references).select(F.col("ordinal").alias("ref"), "seq")
    reads = sequences.sequences(spark, a.input, a.most).select(F.col("ordinal").alias("id"), "seq")
    near = similarity.nearest(reads, refs, a.threshold).filter("ref is not null").join(reads, "id").select(F.col("ref").alias("cluster"), "seq")
    consensus.evaluation(refs, near).show(truncate=False)


def recommend(spark: SparkSession, a: argparse.Namespace) -> None:
    """Tiers of the workloads in a JSON-lines file."""
    scoring.tier_scores(spark.read.json(a.input), "workload").filter("nth = 1").show(truncate=False)


def policy(spark: SparkSession, a: argparse.Namespace) -> None:
    """Codec policies of the channels in a JSON-lines file."""
    scoring.codec_policy(spark.read.json(a.input)).show(truncate=False)


def plan(spark: SparkSession, a: argparse.Namespace) -> None:
    """Tier and policy of rows that hold both a workload and a channel."""
    rows = spark.read.json(a.input)
    tiers = scoring.tier_scores(rows, "workload").filter("nth = 1").select("workload", "tier")
    scoring.codec_policy(scoring.objective_of(rows)).join(tiers, "workload").select("workload", "tier", "chunk_size", "rs_nsym", "parity_group").show(truncate=False)


VERBS = {f.__name__: f for f in (encode, recover, simulate, inspect, evaluate, recommend, policy, plan)}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="strandspark", description=__doc__)
    p.add_argument("verb", choices=VERBS)
    p.add_argument("input")
    p.add_argument("output", nargs="?")
    p.add_argument("--profile", choices=archive.PROFILES, default="200-compact")
    p.add_argument("--scheme", choices=["none", "xor", "fountain", "hybrid"])
    p.add_argument("--reads")
    p.add_argument("--references")
    p.add_argument("--consensus", choices=["medoid", "alignment", "trace", "multistart", "targeted", "fusion"])
    p.add_argument("--threshold", type=float, default=0.9)
    p.add_argument("--most", type=int)
    for name in ("substitution", "insertion", "deletion", "dropout", "duplicate"):
        p.add_argument(f"--{name}", type=float, default=0.0)
    p.add_argument("--seed", type=int, default=7)
    p.add_argument("--copies", type=int, default=1)
    p.add_argument("--conf", type=json.loads, default={}, help="Spark settings as JSON")
    return p


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    VERBS[a.verb](SparkSession.builder.config(map=a.conf).getOrCreate(), a)


if __name__ == "__main__":
    main()
