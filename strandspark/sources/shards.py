"""Shard files of results: written once for each shard, merged by key, compared by a signature that leaves out what differs between runs.

    shards.write(records, folder, "shard")                                       # folder/shard=3/part-*.json
    rows = shards.read(spark, folder, schema)                                     # schema's columns and file
    good, bad = shards.merged(rows, keys, ignored=["runtime"])
    shards.checked(rows, keys, ignored)                                           # raises on a conflict

A record's signature is the SHA-256 of its canonical JSON: fields sorted by name on every level, null fields kept, ignored fields left out on every level. Records of one key with one signature are
repeats, of which the first file's stays; with several signatures they are in conflict and none is merged. Null keys are compared as values. All of it is one aggregate by key, which combines before
the shuffle: a key that a third of all records share costs a task no more than its distinct signatures.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType


class ShardConflict(ValueError):
    """Shards that disagree."""


def write(records: DataFrame, path: str, shard: str) -> None:
    """records as JSON lines, in a folder for each value of the shard column."""
    records.write.partitionBy(shard).option("ignoreNullFields", "false").json(path)


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The records of all files below path, with their file; a record that breaks the schema fails the read."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST").option("recursiveFileLookup", "true").json(path)
    return rows.withColumn("file", F.input_file_name())


def _sorted(value: Column, kind: DataType, ignored: frozenset[str]) -> Column:
    if isinstance(kind, StructType):
        fields = sorted((f for f in kind.fields if f.name not in ignored), key=lambda f: f.name)
        return F.when(value.isNotNull(), F.struct(*(_sorted(value[f.name], f.dataType, ignored).alias(f.name) for f in fields))) if fields else F.lit(None).cast("string")
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: _sorted(x, kind.elementType, ignored))
    if isinstance(kind, MapType):
        entries = F.transform(F.map_entries(value), lambda e: F.struct(e["key"].alias("key"), _sorted(e["value"], kind.valueType, ignored).alias("value")))
        return F.array_sort(F.filter(entries, lambda e: ~e["key"].cast("string").isin(*ignored)) if ignored else entries)
    return value


def signature(rows: DataFrame, ignored: list[str]) -> Column:
    """The SHA-256 of each row's canonical JSON without the ignored fields."""
    left_out = frozenset(ignored)
    fields = sorted((f for f in rows.schema.fields if f.name not in left_out), key=lambda f: f.name)
    whole = F.struct(*(_sorted(F.col(f.name), f.dataType, left_out).alias(f.name) for f in fields))
    return F.sha2(F.to_json(whole, {"ignoreNullFields": "false"}), 256)


def merged(rows: DataFrame, keys: list[str], ignored: list[str], file: str = "file") -> tuple[DataFrame, DataFrame]:
    """(good, bad) of rows (keys, ..., file): good has one row of each key that no files disagree on, with the copies found; bad has the other keys with copies, versions and a file of two of the versions."""
    body = [c for c in rows.columns if c not in {*keys, file}]
    signed = rows.withColumn("_signature", signature(rows, [*ignored, file]))
    first = F.min_by(F.struct(*body) if body else F.lit(True), F.struct(F.col(file), F.col("_signature"), F.to_json(F.struct(*body)) if body else F.lit("")))
    versions = signed.groupBy(*keys, "_signature").agg(F.count(F.lit(1)).alias("copies"), F.min(file).alias("_file"), first.alias("_body"))
    one = versions.groupBy(*keys).agg(
        F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("versions"), F.min("_file").alias("first_file"),
        F.max_by("_file", "_signature").alias("_high"), F.min_by("_file", "_signature").alias("_low"), F.min_by("_body", "_signature").alias("_body"),
    )
    good = one.filter("versions = 1").select(*keys, *(F.col(f"_body.{c}").alias(c) for c in body), "copies")
    bad = one.filter("versions > 1").select(*keys, "copies", "versions", F.least("_low", "_high").alias("left_file"), F.greatest("_low", "_high").alias("right_file"))
    return good, bad


def checked(rows: DataFrame, keys: list[str], ignored: list[str], file: str = "file") -> DataFrame:
    """The merged rows; ShardConflict names the first keys that files disagree on."""
    good, bad = merged(rows, keys, ignored, file)
    first = bad.orderBy(*keys).limit(3).collect()
    if first:
        raise ShardConflict("; ".join(f"{', '.join(f'{k}={r[k]}' for k in keys)}: {r['versions']} versions in {r['left_file']} and {r['right_file']}" for r in first))
    return good


def agreed(metadata: DataFrame, same: list[str], united: list[str], largest: list[str]) -> DataFrame:
    """One row of shards' metadata rows: values of `same`, which must agree (conflicts names the others), the sorted union of the lists `united`, the largest of `largest`, and the number of shards."""
    signs = [F.count_distinct(F.to_json(F.struct(c), {"ignoreNullFields": "false"})) for c in same]
    out = metadata.groupBy().agg(
        F.count(F.lit(1)).alias("shards"), *(F.min(c).alias(c) for c in same), *(F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c) for c in united),
        *(F.max(c).alias(c) for c in largest), F.array_compact(F.array(*(F.when(n > 1, c) for c, n in zip(same, signs, strict=True)))).cast("array<string>").alias("conflicts"),
    )
    return out.filter("shards > 0")
