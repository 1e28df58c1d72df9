"""Line dedup by site-relative frequency: a line that stands on more than a given share of its host's pages is boilerplate.

A line is the text between two \\n; lines compare without white space at their ends, and lines without a word are neither
counted nor dropped. A page counts once for a line that it repeats. What stands on one page alone is not repeated, so it stays
however few pages the host has (min_pages, 2).

Defined results: a null text stays null; a null host is a host of its own; a text that loses all lines becomes empty; repeated
rows count as so many pages; n_lines and n_dropped replace columns of these names, all others stay whatever they are called;
very long texts are read whole; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import free_name, kept_table

_TRIM = r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$"
MAX_RATIO = 0.1
MIN_PAGES = 2
#: The boilerplate of all hosts is broadcast up to so many digests (16 bytes each).
BROADCAST_DIGESTS = 2_000_000


def _trimmed(line):
    return F.regexp_replace(line, _TRIM, "")


def boilerplate(docs: DataFrame, host_col: str = "source", text_col: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, line, n_pages, host_pages, ratio) of the lines to drop. Lines are counted under a 128-bit digest, so that no line's text is shuffled; pages, lines and hosts are summed before any shuffle."""
    rows = docs.select(F.col(host_col).alias("host"), F.col(text_col).alias("text"))
    totals = rows.groupBy("host").agg(F.count(F.lit(1)).alias("host_pages"))
    lines = F.array_distinct(F.transform(F.split("text", "\n", -1), _trimmed))
    each = rows.select("host", F.explode(lines).alias("line")).filter("line <> ''")
    counted = each.groupBy("host", *_digest(F.col("line"))).agg(F.count(F.lit(1)).alias("n_pages")).filter(F.col("n_pages") >= min_pages)
    ratio = F.col("n_pages") / F.col("host_pages")
    return counted.join(totals, counted["host"].eqNullSafe(totals["host"])).select(counted["host"], "h1", "h2", "n_pages", "host_pages", ratio.alias("ratio")).filter(F.col("ratio") > max_ratio)


def _digest(line) -> list:
    """128 bits of a line, as two longs h1 and h2 from different seeds."""
    return [F.xxhash64(line).alias("h1"), F.xxhash64(F.lit("line"), line).alias("h2")]


def drop_lines(
    docs: DataFrame, host_col: str = "source", text_col: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES, n_lines: str = "n_lines", n_dropped: str = "n_dropped"
) -> DataFrame:
    """docs with the text less its boilerplate lines, and the columns n_lines, n_dropped beside it.

    A host has at most average lines per page / max_ratio such lines, so one row per host holds them; hosts are joined to the
    pages by that row, broadcast where all digests together are within BROADCAST_DIGESTS, and no page's lines are shuffled.
    """
    docs = docs.drop(n_lines, n_dropped)
    host, own, left_col = (free_name(docs, x) for x in ("_host", "_boilerplate", "_left"))
    bad = boilerplate(docs, host_col, text_col, max_ratio, min_pages)
    per_host = kept_table(bad.groupBy(F.col("host").alias(host)).agg(F.collect_set(F.struct("h1", "h2")).alias(own)), "boilerplate")
    held = per_host.agg(F.coalesce(F.sum(F.size(own) + 4), F.lit(0))).first()[0]
    joined = docs.join(F.broadcast(per_host) if held <= BROADCAST_DIGESTS else per_host, docs[host_col].eqNullSafe(F.col(host)), "left")
    lines = F.split(F.col(text_col), "\n", -1)

    def stays(line):
        mark = _trimmed(line)
        return ~F.array_contains(own, F.struct(*_digest(mark))) | (mark == "")

    left = F.when(F.col(own).isNull(), lines).otherwise(F.filter(lines, stays))
    none = F.col(text_col).isNull()
    out = joined.withColumn(left_col, left).withColumn(n_lines, F.when(none, 0).otherwise(F.size(lines)).cast("long"))
    out = out.withColumn(n_dropped, F.when(none, 0).otherwise(F.size(lines) - F.size(left_col)).cast("long"))
    return out.withColumn(text_col, F.array_join(left_col, "\n")).drop(host, own, left_col)
