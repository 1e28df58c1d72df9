"""The given tables as the shapes that the operators read, each with its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where its scan has no more tasks than there are cores and few files, as tasks beyond a file's row groups find no rows. Such inputs have at most
    spark.sql.files.maxPartitionBytes a core; larger ones, whose scans have tasks enough, are not shuffled."""
    n = df.sparkSession.sparkContext.defaultParallelism
    few = df.rdd.getNumPartitions() <= n and 2 * len(df.inputFiles()) <= n
    return df.repartition(n) if few else df


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(archive, payload): every document's whole text in UTF-8."""
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select(F.col("doc_id").alias("archive"), F.encode("text", "UTF-8").alias("payload"))


PAYLOADS = "payloads AS (SELECT doc_id AS archive, lower(hex(encode(text))) AS hexed, strlen(text) AS size FROM documents)"


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, seq): every document's whole text as a strand with one base for each word, by its length. Near copies are noisy reads of one template."""
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select(F.col("doc_id").alias("id"), F.array_join(F.transform(words, lambda w: F.substring(F.lit("ACGT"), F.length(w) % 4 + 1, F.lit(1))), "").alias("seq"))


READS = rf"reads AS (SELECT doc_id AS id, array_to_string(list_transform(regexp_extract_all(text, '{WORD}'), lambda w: 'ACGT'[length(w) % 4 + 1]), '') AS seq FROM documents)"


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One trial for each line item."""
    return table(spark, sf_dir, "lineitem").select(
        F.when(F.col("l_returnflag") == "N", "fixed").when(F.col("l_returnflag") == "R", "adaptive").otherwise("combined").alias("strategy"),
        F.concat(F.lit("s"), F.col("l_suppkey") % 8).alias("scenario"), (1024 * F.col("l_linenumber")).cast("long").alias("payload_size"), (F.col("l_partkey") % 16).alias("seed"),
        (F.col("l_quantity") >= 12).alias("recovered"), (1 + F.col("l_discount")).alias("overhead"), (F.col("l_extendedprice") / 1000).alias("runtime"),
        F.col("l_orderkey").alias("trial"), F.col("l_linenumber").alias("line"),
        (F.col("l_discount") / 10).alias("substitution"), (F.col("l_tax") / 20).alias("insertion"), (F.col("l_tax") / 40).alias("deletion"), F.col("l_discount").alias("dropout"), (F.col("l_quantity") * 100).alias("nucleotides"),
    )


TRIALS = """trials AS (SELECT CASE l_returnflag WHEN 'N' THEN 'fixed' WHEN 'R' THEN 'adaptive' ELSE 'combined' END AS strategy, 's' || (l_suppkey % 8) AS scenario,
  CAST(1024 * l_linenumber AS BIGINT) AS payload_size, l_partkey % 16 AS seed, l_quantity >= 12 AS recovered, 1 + l_discount AS overhead, l_extendedprice / 1000 AS runtime, l_orderkey AS trial, l_linenumber AS line,
  l_discount / 10 AS substitution, l_tax / 20 AS insertion, l_tax / 40 AS deletion, l_discount AS dropout, l_quantity * 100 AS nucleotides FROM lineitem)"""


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trials with the codec policy that their channel calls for."""
    from ..operators.scoring import codec_policy

    return codec_policy(trials(spark, sf_dir).withColumn("durability", F.col("overhead") - 0.2).withColumn("overhead_priority", F.col("runtime") / 60))


def workloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One archive workload for each customer."""
    key, balance = F.col("c_custkey"), F.col("c_acctbal")
    return table(spark, sf_dir, "customer").select(
        key.alias("workload"), (key % 120 + 1).cast("double").alias("retention_years"), (key % 400).cast("double").alias("accesses_per_year"), (F.abs(balance) / 100 + 1).alias("size_gb"),
        F.when(key % 3 == 0, (key % 10) / 10.0).alias("access_probability"), (key % 11 / 10.0).alias("mutability"), (key % 7 / 6.0).alias("retrieval_urgency"), (key % 5 / 4.0).alias("durability_priority"),
        (key % 4 / 3.0).alias("redundancy_priority"), (key % 13 / 12.0).alias("energy_priority"), (key % 9 / 8.0).alias("cost_priority"),
    )


WORKLOADS = """workloads AS (SELECT c_custkey AS workload, CAST(c_custkey % 120 + 1 AS DOUBLE) AS retention_years, CAST(c_custkey % 400 AS DOUBLE) AS accesses_per_year, abs(c_acctbal) / 100 + 1 AS size_gb,
  CASE WHEN c_custkey % 3 = 0 THEN (c_custkey % 10) / 10.0::DOUBLE END AS access_probability, (c_custkey % 11) / 10.0::DOUBLE AS mutability, (c_custkey % 7) / 6.0::DOUBLE AS retrieval_urgency,
  (c_custkey % 5) / 4.0::DOUBLE AS durability_priority, (c_custkey % 4) / 3.0::DOUBLE AS redundancy_priority, (c_custkey % 13) / 12.0::DOUBLE AS energy_priority, (c_custkey % 9) / 8.0::DOUBLE AS cost_priority FROM customer)"""

ASSUMPTIONS = {"ssd": (0.9, 0.001, 60.0, 0.0001, 0.001), "object_archive": (0.012, 0.02, 8.0, 0.0005, 5.0), "tape": (0.004, 0.05, 1.0, 0.002, 12.0), "dna_future": (0.001, 2.0, 0.01, 0.5, 24.0)}
