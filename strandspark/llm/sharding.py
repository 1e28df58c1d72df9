"""Sharding by extendible hashing: a directory over hash prefixes in which only a bucket above the byte limit splits on another bit.

Sizes are summed once in cells of a deep prefix, and every shallower prefix is a sum of cells; a row's shard is its
shallowest prefix that fits. Cells still above the limit split on, up to all 32 bits. Rows whose keys share all bits, such as repeated rows, cannot be parted by a hash: such a cell is
cut into parts by running sums over numbered rows, and a single row above the limit has a part of its own.

Defined results: a null text has zero bytes; a null key hashes as a key of its own; repeated rows are placed each; other columns
are left out, or written whatever they are called; empty input gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import free_name, kept_table, shared_path, small

LIMIT = 4 << 20
#: Cells are summed first at so many bits below the average depth; those above the limit then at all bits.
FIRST = 6
#: A cell that no bit parts is cut in runs of about so many limits.
RUN = 256


def hash_bits(key: Column) -> Column:
    """The first 32 bits of the key's MD5 as a long."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("\0"))), 1, 8), 16, 10).cast("long")


def directory(sized: DataFrame, limit: int, depth: int, least: int = 0) -> DataFrame:
    """(cell, depth, bucket, bucket_bytes) from (h, bytes): for each cell of `depth` bits its shallowest prefix of `least` bits or more that fits, or the whole cell."""
    cells = sized.groupBy(F.shiftright("h", 32 - depth).alias("cell")).agg(F.sum("bytes").alias("bytes"))
    levels = cells.select("cell", "bytes", F.explode(F.sequence(F.lit(least), F.lit(depth))).alias("depth")).withColumn("bucket", F.expr(f"shiftright(cell, {depth} - depth)"))
    sums = levels.groupBy("depth", "bucket").agg(F.sum("bytes").alias("bucket_bytes")).filter((F.col("bucket_bytes") <= limit) | (F.col("depth") == depth))
    fits = levels.join(sums, ["depth", "bucket"])
    best = fits.groupBy("cell").agg(F.min("depth").alias("depth"))
    return fits.join(best, ["cell", "depth"]).select("cell", "depth", "bucket", "bucket_bytes")


def _sized(docs: DataFrame, key_col: str, text_col: str, row: Column) -> DataFrame:
    """(row, key, bytes, h) of each row, kept, so that a row's number and with it its part stay the same in every attempt."""
    size = F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long")
    return kept_table(docs.select(row.alias("row"), F.col(key_col).alias("key"), size.alias("bytes"), hash_bits(F.col(key_col)).alias("h")), "sizes")


def shards(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """(key, bytes, depth, shard, part, shard_bytes): shard is the prefix as a bit string; part is 0 except in cells that no bit parts."""
    return _assigned(_sized(docs, key_col, text_col, F.monotonically_increasing_id()), limit).drop("row")


def _assigned(sized: DataFrame, limit: int) -> DataFrame:
    """Cells of FIRST bits below the average depth come first; those above the limit split on by the rest of all 32 bits."""
    total = sized.agg(F.sum("bytes")).first()[0] or 0
    depth = min(32, max(1, math.ceil(math.log2(max(1, total / limit)))) + FIRST)
    fitting, over = _placed(sized, limit, depth)
    deeper, over = _placed(over, limit, 32, depth)
    return fitting.unionByName(deeper).unionByName(_parted(over, limit))


def _placed(sized: DataFrame, limit: int, depth: int, least: int = 0) -> tuple[DataFrame, DataFrame]:
    """The rows in a bucket that fits, with their shard, and those of cells that are still too large."""
    table = kept_table(directory(sized, limit, depth, least), "directory")
    rows = sized.select("row", "key", "bytes", "h").withColumn("cell", F.shiftright("h", 32 - depth)).join(small(table), "cell")
    name = F.when(F.col("depth") == 0, F.lit("")).otherwise(F.expr("lpad(bin(bucket), depth, '0')"))
    rows = rows.withColumn("shard", name)
    fitting = rows.filter(F.col("bucket_bytes") <= limit).select("row", "key", "bytes", "depth", "shard", F.lit(0).alias("part"), F.col("bucket_bytes").alias("shard_bytes"))
    return fitting, rows.filter(F.col("bucket_bytes") > limit)


def _parted(over: DataFrame, limit: int) -> DataFrame:
    """Next-fit over each cell that no bit parts, in as many runs as its bytes ask for (RUN limits each): a run's parts begin where its running sum passes a multiple of half the limit, so that a part of
    several rows holds at most that and one row of at most as much."""
    salted = over.withColumn("salt", F.pmod(F.xxhash64("row"), F.ceil(F.col("bucket_bytes") / (RUN * limit))))
    run = Window.partitionBy("shard", "salt").orderBy("h", "bytes", "row")
    large = F.col("bytes") * 2 > limit
    salted = salted.withColumn("before", F.sum(F.when(large, 0).otherwise(F.col("bytes"))).over(run.rowsBetween(Window.unboundedPreceding, -1)))
    salted = salted.withColumn("nth", F.row_number().over(run))
    step = F.floor(F.coalesce("before", F.lit(0)) / max(1, limit // 2))
    mark = F.when(large, F.concat_ws("-", F.lit("x"), "salt", "nth")).otherwise(F.concat_ws("-", F.lit("s"), "salt", step))
    salted = kept_table(salted.withColumn("mark", mark).select("row", "key", "bytes", "depth", "shard", "mark"), "parts")
    sums = salted.groupBy("shard", "mark").agg(F.sum("bytes").alias("shard_bytes"))
    sums = sums.withColumn("part", F.row_number().over(Window.partitionBy("shard").orderBy("mark")))
    return salted.join(small(sums), ["shard", "mark"]).select("row", "key", "bytes", "depth", "shard", "part", "shard_bytes")


def write_shards(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, path: str | None = None) -> str:
    """The rows of docs as Parquet, in one folder for each shard and part; returns the path. Rows are numbered and kept first, so that each goes to its own part."""
    path = path or shared_path(docs.sparkSession, "shards")
    row, shard, part = (free_name(docs, x) for x in ("row", "shard", "part"))
    numbered = kept_table(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    where = _assigned(_sized(numbered, key_col, text_col, F.col(row)), limit).select(F.col("row").alias(row), F.col("shard").alias(shard), F.col("part").alias(part))
    numbered.join(where, row).drop(row).repartition(shard, part).write.partitionBy(shard, part).parquet(path)
    return path
