"""Nested result documents: JSON with a stated schema, broken ones as a side output, and their lists as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string


def _lacks(field: str):
    return lambda x: x[field].isNull()


def parsed(texts: DataFrame, schema: str, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(good, broken) of texts (..., text): good has the document as column doc in place of the text, broken keeps the text with a reason.

    A document is broken if it is null, isn't JSON of the schema, or lacks a field that the schema says is NOT NULL, on the top or in a list. Nothing is dropped without a word: the two together have
    all rows. Both read the same scan; store texts first if making it is dear."""
    wanted = _parse_datatype_string(schema)
    lenient = StructType([StructField(f.name, f.dataType) for f in wanted.fields] + [StructField("_broken", _parse_datatype_string("string"))])
    rows = texts.withColumn("doc", F.from_json(text, lenient, {"columnNameOfCorruptRecord": "_broken", "mode": "PERMISSIVE"}))
    lacks = [F.when(F.col(f"doc.{f.name}").isNull(), f.name) for f in wanted.fields if not f.nullable]
    for f in wanted.fields:
        item = getattr(f.dataType, "elementType", None)
        for g in getattr(item, "fields", []):
            if not g.nullable:
                lacks.append(F.when(F.exists(f"doc.{f.name}", _lacks(g.name)), f"{f.name}.{g.name}"))
    reason = F.when(F.col(text).isNull(), "no document").when(F.col("doc._broken").isNotNull(), "not of the schema")
    if lacks:
        lacking = F.concat_ws(", ", *lacks)
        reason = reason.when(lacking != "", F.concat(F.lit("lacks "), lacking))
    rows = rows.withColumn("reason", reason)
    good = F.struct(*(F.col(f"doc.{f.name}") for f in wanted.fields))
    return rows.filter("reason is null").withColumn("doc", good).drop(text, "reason"), rows.filter("reason is not null").drop("doc")


def unnested(docs: DataFrame, items: str, chosen: str | None = None, key: str | None = None) -> DataFrame:
    """A row for each element of doc.<items>, with its place and, if chosen and key are given, whether doc.<chosen> names its key. Documents with an empty list give one row without an element."""
    rows = docs.select("*", F.posexplode_outer(f"doc.{items}").alias("place", "item"))
    if chosen is not None:
        rows = rows.withColumn("selected", F.coalesce(F.col(f"item.{key}") == F.col(f"doc.{chosen}"), F.lit(False)))
    return rows
