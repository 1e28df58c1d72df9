"""The corpus pipeline: quality rules, line dedup, near dedup, decontamination, packing, each over all rows that the one before kept.

Counted as part of strandspark.llm. Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs; all but the last return the columns of documents.

Rows are judged one by one, not by their ids. Defined results for all stages: a row with a null id is judged as any other, and is a
group of its own in near dedup; rows of one id are each kept or dropped by their own text, and repeated rows share one fate; a null
or empty text has no words, so the quality rules drop it, and a stage called by itself passes it on (packing: its end id alone);
extra columns come through whatever they are called; very long texts are read whole; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandspark.llm import decontam, linededup, minhash, packing, quality
from strandspark.llm.runtime import free_name, kept_table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs less the rows that the current policy rejects, read off their ledger bits."""
    return quality.accepted(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs less their sources' boilerplate lines; n_chars follows the text."""
    lines, dropped = free_name(docs, "n_lines"), free_name(docs, "n_dropped")
    out = linededup.drop_lines(docs, n_lines=lines, n_dropped=dropped)
    out = out.withColumn("n_chars", F.when(F.col(dropped) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select([F.col(f"`{c}`") for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, that with the smallest id."""
    return minhash.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs less the rows in which an item of the benchmark stands."""
    return decontam.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all pieces in training sequences."""
    return packing.packed(docs)


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("near dedup", near_dedup), ("decontamination", decontamination), ("packing", pack)]

#: The tokenizer and the edit search can't be stated in SQL; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = kept_table(docs, name.replace(" ", "-"))
    return docs
