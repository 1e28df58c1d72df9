"""Quality rules as a bitmask ledger: each rule is evaluated once, its failures are bits and its measurements are kept, and any
number of versioned policies, or ablations of them, are read off the ledger without touching the texts again.

Defined results: a null or wordless text measures zero and fails too_few_words; repeated rows give that row as often; rows with
a null id keep it; very long texts are measured whole; an empty table gives an empty table; other columns are left out or passed
through, whatever they are called.
"""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import words as W
from .runtime import free_name, text_pieces

U = np.uint64
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")

#: Rule -> the condition under which a text fails it. A rule's bit is its place here; new rules go to the end, so that old ledgers stay valid.
RULES: dict[str, str] = {
    "too_few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "100 * n_symbols > 10 * n_words",
    "duplicate_lines": "100 * n_dup_lines > 40 * n_lines",
    "short_words": "10 * word_chars < 30 * n_words",
    "long_words": "10 * word_chars > 120 * n_words",
}
BASE = ("too_few_words", "repeated_words")
#: Policy version -> the rules that reject a text.
POLICIES: dict[str, tuple[str, ...]] = {"base": BASE, "v1": (*BASE, "symbols", "duplicate_lines"), "v2": tuple(RULES)}
CURRENT = "v2"

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_BREAK = np.zeros(256, bool)
_BREAK[ord("\n")] = True


def _measure(raw: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    rows = len(offsets) - 1

    def counted(flags: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=sums[1:])
        return sums

    start, end = W.spans(raw, offsets)
    first = W.per_row(offsets, start)
    n = np.diff(first)
    points = counted((raw & 0xC0) != 0x80)
    spaces = counted(W.SPACE[raw])
    chars = (points - spaces)[offsets]
    symbols = counted(_SYMBOL[raw])[offsets]
    ls, le = W.spans(raw, offsets, _BREAK)
    full = (le - ls) > (spaces[le] - spaces[ls])  # lines with a word
    ls, le = ls[full], le[full]
    row = np.searchsorted(offsets, ls, "right") - 1
    lines = np.bincount(row, minlength=rows)
    distinct = np.unique(W.mix(row.astype(U) + U(1)) ^ W.hashes(raw, ls, le), return_index=True)[1]
    dup = lines - np.bincount(row[distinct], minlength=rows)
    words = W.hashes(raw, start, end)
    covered = np.zeros(len(words), bool)
    three = W.windows(words, 3)
    owner = np.repeat(np.arange(rows), n)
    inside = np.flatnonzero(owner[: len(three)] == owner[2:]) if len(three) else np.empty(0, np.int64)
    if len(inside):
        order = inside[np.argsort(key := W.mix(owner[inside].astype(U) + U(1)) ^ three[inside], kind="stable")]
        key = np.sort(key)
        same = key[1:] == key[:-1]
        again = np.zeros(len(key), bool)
        again[1:] |= same
        again[:-1] |= same
        for k in range(3):
            covered[order[again] + k] = True
    repeated = counted(covered)[first]
    return [n, np.diff(chars), np.diff(symbols), lines, dup, np.diff(repeated)]


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, MEASURES...) of every whole text, as longs."""

    def run(batches):
        for batch in batches:
            at = 0
            for _, _, raw, offsets in text_pieces(batch.column(1)):
                values = _measure(raw, offsets)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(offsets) - 1), *(pa.array(v.astype(np.int64)) for v in values)], names=["id", *MEASURES])
                at += len(offsets) - 1

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, " + ", ".join(f"{m} long" for m in MEASURES))
    return out.withColumnRenamed("id", id_col)


def with_ledger(docs: DataFrame, name: str, text_col: str = "text") -> DataFrame:
    """docs with one more column, a struct of MEASURES and failed, row by row: ids may be null or repeated, and columns may have any names."""
    place, kind = docs.columns.index(text_col), pa.struct([(m, pa.int64()) for m in MEASURES])

    def run(batches):
        for batch in batches:
            values = [np.concatenate(v) for v in zip(*(_measure(raw, offsets) for _, _, raw, offsets in text_pieces(batch.column(place))), strict=True)]
            if values:
                own = pa.StructArray.from_arrays([pa.array(v.astype(np.int64)) for v in values], fields=list(kind))
                yield pa.RecordBatch.from_arrays([*batch.columns, own], names=[*batch.schema.names, name])

    fields = StructType([*docs.schema.fields, StructField(name, StructType([StructField(m, LongType()) for m in MEASURES]))])
    out = docs.mapInArrow(run, fields)
    rules = [re.sub(r"\b(" + "|".join(MEASURES) + r")\b", rf"`{name}`.\1", rule) for rule in RULES.values()]
    failed = reduce(Column.bitwiseOR, [F.when(F.expr(rule), F.lit(1 << k)).otherwise(F.lit(0)) for k, rule in enumerate(rules)])
    return out.withColumn(name, F.col(name).withField("failed", failed.cast("long")))


def accepted(docs: DataFrame, policy: str = CURRENT, text_col: str = "text") -> DataFrame:
    """The rows of docs that the policy does not reject."""
    name = free_name(docs, "ledger")
    return with_ledger(docs, name, text_col).filter(~rejected(policy, F.col(name)["failed"])).drop(name)


def bits(names: tuple[str, ...]) -> int:
    """The mask of some rules."""
    order = list(RULES)
    return sum(1 << order.index(x) for x in names)


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The measurements with failed, one bit for each rule that the text fails."""
    failing = [F.when(F.expr(rule), F.lit(1 << k)).otherwise(F.lit(0)) for k, rule in enumerate(RULES.values())]
    return measured(docs, id_col, text_col).withColumn("failed", reduce(Column.bitwiseOR, failing).cast("long"))


def rejected(policy: str, failed: str | Column = "failed") -> Column:
    """Whether a ledger row fails a rule of the policy."""
    failed = F.col(failed) if isinstance(failed, str) else failed
    return failed.bitwiseAND(F.lit(bits(POLICIES[policy]))) != 0


def with_policies(rows: DataFrame, current: str = CURRENT) -> DataFrame:
    """base_failed and kept, read off the ledger."""
    return rows.withColumn("base_failed", rejected("base")).withColumn("kept", ~rejected(current))


def ablations(rows: DataFrame, policy: str = CURRENT) -> DataFrame:
    """(rule, n_failed, n_only): texts that fail each rule of the policy, and those that only this rule rejects, which its removal would bring back. One pass counts the distinct masks; the rest is arithmetic on these."""
    mask = bits(POLICIES[policy])
    masks = rows.groupBy(F.col("failed").bitwiseAND(F.lit(mask)).alias("m")).agg(F.count(F.lit(1)).alias("n"))
    each = masks.select("m", "n", F.explode(F.create_map(*(F.lit(x) for name in POLICIES[policy] for x in (name, bits((name,)))))).alias("rule", "bit"))
    hit = F.col("m").bitwiseAND(F.col("bit")) != 0
    return each.groupBy("rule").agg(F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_failed"), F.sum(F.when(F.col("m") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only"))
