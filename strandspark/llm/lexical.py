"""Ranked lexical search over a length-stratified index.

A document's score for an item adds up weight * impact over the item's terms, where the impact depends on the document only through a
term's count tf and the document's length normaliser m. So documents are grouped by equal m; in such a stratum the postings of a term
are grouped by tf, and an impact is computed once for each tf. The largest tf of every term bounds what any document of the stratum
can score: an item visits strata from the largest bound down and stops where the bound is less than its last kept score.

Documents are dealt by ranges of (m, row), so that a large stratum is spread over tasks, and cut into blocks of at most BLOCK documents.
Items are taken in blocks of at most ITEM_BYTES of text (or one item); a block's vocabulary goes to all tasks, and the documents are read
once for each block. A task keeps `top` documents for each item, and only those meet in one place.

Defined results: a null or empty text has no terms; a document without terms is not counted and never found, an item without terms finds
nothing. Rows with equal ids are documents or items of their own; null ids are kept and rank last among equal scores. Very long texts are
read whole. Empty tables give an empty table. Columns of other names are left out, whatever they are called.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import words as W
from .runtime import kept_table, text_pieces

ITEM_BYTES = 4 << 20
BLOCK = 4096
#: So many blocks of a task are held at once to be visited in the order of their bounds.
HELD = 64
#: A second, independent hash of terms; both must agree.
_OTHER = np.array([(b * 167 + 91) % 256 for b in range(256)], np.uint8)[W.LOWER]


@dataclass(frozen=True)
class Params:
    """impact = unit * tf div (saturation * tf + slope * m), m = 100 - share + share * n * N div L."""

    top: int = 20
    unit: int = 1_000_000_000
    saturation: int = 1000
    slope: int = 12
    share: int = 25


def terms_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of every term."""
    start, end = W.spans(raw, offsets, W.PARTS)
    return start, end, W.hashes(raw, start, end, W.LOWER)


@dataclass(frozen=True)
class Vocabulary:
    """The distinct terms of a block of items, by ascending hash, and each item's (term, count)."""

    hashes: np.ndarray
    others: np.ndarray
    items: tuple[tuple[np.ndarray, np.ndarray], ...]

    @classmethod
    def of(cls, texts: list[str | None]) -> Vocabulary:
        column = pa.array(texts, pa.string())
        hashes, others, item, at = [np.empty(0, W.U)], [np.empty(0, W.U)], [np.empty(0, np.int64)], 0
        for first, end_row, raw, offsets in text_pieces(column):
            start, end, h = terms_of(raw, offsets)
            hashes.append(h)
            others.append(W.hashes(raw, start, end, _OTHER))
            item.append(first + np.searchsorted(offsets, start, "right") - 1)
        h, o, k = np.concatenate(hashes), np.concatenate(others), np.concatenate(item)
        distinct, where, term = np.unique(h, return_index=True, return_inverse=True)
        each = []
        for at in range(len(texts)):
            t, c = np.unique(term[np.searchsorted(k, at) : np.searchsorted(k, at, "right")], return_counts=True)
            each.append((t.astype(np.int64), c.astype(np.int64)))
        return cls(distinct, o[where], tuple(each))


def counted(docs: DataFrame, id_col: str, text_col: str, vocabulary: Vocabulary) -> DataFrame:
    """(id, n, terms, tfs) of every document with terms: n counts all its terms, terms and tfs are those of the vocabulary."""
    known, others = vocabulary.hashes, vocabulary.others

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end_row, raw, offsets in text_pieces(batch.column(1)):
                rows = end_row - first
                start, end, h = terms_of(raw, offsets)
                bounds = np.searchsorted(start, offsets)
                n = np.diff(bounds)
                term = np.minimum(np.searchsorted(known, h), max(len(known) - 1, 0))
                hit = np.flatnonzero(known[term] == h) if len(known) else np.empty(0, np.int64)
                if len(hit):
                    hit = hit[W.hashes(raw, start[hit], end[hit], _OTHER) == others[term[hit]]]
                row = np.repeat(np.arange(rows), n)[hit]
                key, tf = np.unique(row * max(len(known), 1) + term[hit], return_counts=True)
                row, kind = np.divmod(key, max(len(known), 1))
                ends = pa.array(np.searchsorted(row, np.arange(rows + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (kind, tf)]
                out = pa.RecordBatch.from_arrays([batch.column(0).slice(first, rows), pa.array(n.astype(np.int64)), *lists], names=["id", "n", "terms", "tfs"])
                yield out.filter(pa.array(n > 0))

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n long, terms array<int>, tfs array<int>")


def stratified(counts: DataFrame, n_docs: int, n_terms: int, p: Params) -> DataFrame:
    """The index: a row for each block of a stratum with m, its documents' ids, and its postings as runs (term, tf) of places: run k holds places[starts[k]:starts[k + 1]]."""
    rows = counts.withColumn("m", F.expr(f"{100 - p.share}L + ({p.share}L * n * {n_docs}L) div {max(n_terms, 1)}L")).withColumn("row", F.monotonically_increasing_id())
    rows = rows.repartitionByRange("m", "row").sortWithinPartitions("m").select("m", "id", "terms", "tfs")
    kind = dict(counts.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.column(0).to_numpy()
            edges = np.flatnonzero(np.concatenate(([True], m[1:] != m[:-1]))).tolist() if len(m) else []
            for a, b in zip(edges, [*edges[1:], len(m)], strict=True):
                for lo in range(a, b, BLOCK):
                    part = batch.slice(lo, min(BLOCK, b - lo))
                    terms, tfs = (part.column(c).flatten().to_numpy().astype(np.int64) for c in (2, 3))
                    place = np.repeat(np.arange(part.num_rows), np.diff(part.column(2).offsets.to_numpy()))
                    order = np.lexsort((place, tfs, terms))
                    terms, tfs, place = terms[order], tfs[order], place[order]
                    new = np.flatnonzero(np.concatenate(([True], (terms[1:] != terms[:-1]) | (tfs[1:] != tfs[:-1])))) if len(terms) else np.empty(0, np.int64)
                    starts = np.concatenate((new, [len(terms)]))
                    lists = [part.column(1), *(pa.array(x.astype(np.int32)) for x in (terms[new], tfs[new], starts, place))]
                    lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists]
                    yield pa.RecordBatch.from_arrays([pa.array([int(m[lo])]), *lists], names=["m", "ids", "terms", "tfs", "starts", "places"])

    return rows.mapInArrow(run, f"m long, ids array<{kind}>, terms array<int>, tfs array<int>, starts array<int>, places array<int>")


class Block:
    """One block of a stratum in memory."""

    def __init__(self, m: int, ids: pa.Array, terms: np.ndarray, tfs: np.ndarray, starts: np.ndarray, places: np.ndarray, p: Params):
        self.ids, self.terms, self.starts, self.places = ids, terms.astype(np.int64), starts, places
        values, which = np.unique(tfs.astype(np.int64), return_inverse=True)
        self.impact = ((p.unit * values) // (p.saturation * values + p.slope * m))[which]  # once for each tf
        last = np.flatnonzero(np.concatenate((terms[1:] != terms[:-1], [True]))) if len(terms) else np.empty(0, np.int64)
        self.own, self.most = self.terms[last], self.impact[last]  # tfs ascend within a term, so a run's last has the largest impact

    def bound(self, terms: np.ndarray, weights: np.ndarray) -> int:
        if not len(self.own):
            return 0
        at = np.minimum(np.searchsorted(self.own, terms), len(self.own) - 1)
        return int((weights * np.where(self.own[at] == terms, self.most[at], 0)).sum())

    def scores(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """The score of every document of the block."""
        lo, hi = np.searchsorted(self.terms, terms), np.searchsorted(self.terms, terms, "right")
        runs = np.concatenate([np.arange(a, b) for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]) if len(terms) else np.empty(0, np.int64)
        value = np.repeat(weights, hi - lo) * self.impact[runs]
        size = self.starts[runs + 1] - self.starts[runs]
        at = np.repeat(self.starts[runs] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(int(size.sum())) if len(runs) else np.empty(0, np.int64)
        out = np.zeros(len(self.ids), np.int64)
        np.add.at(out, self.places[at], np.repeat(value, size))
        return out


class Best:
    """The highest scores of one item so far, equal ones by ascending id (null last)."""

    def __init__(self, top: int):
        self.top, self.score, self.ids = top, np.empty(0, np.int64), []

    @property
    def floor(self) -> int:
        """A document below it is not kept any more; one that equals it may be, by its id."""
        return int(self.score[-1]) if len(self.score) == self.top else 1

    def add(self, block: Block, scores: np.ndarray) -> None:
        at = np.flatnonzero(scores >= self.floor)
        if len(at) > self.top:
            at = at[scores[at] >= np.partition(scores[at], -self.top)[-self.top]]
        both = [*zip(self.score.tolist(), self.ids, strict=True), *zip(scores[at].tolist(), block.ids.take(pa.array(at)).to_pylist(), strict=True)]
        both = sorted(both, key=lambda x: (-x[0], x[1] is None, 0 if x[1] is None else x[1]))[: self.top]
        self.score, self.ids = np.array([x[0] for x in both], np.int64), [x[1] for x in both]


def visit(blocks: list[Block], items: list[tuple[np.ndarray, np.ndarray]], best: list[Best]) -> int:
    """Every item visits the blocks from its largest bound down; returns the number of visits."""
    visits = 0
    for (terms, weights), own in zip(items, best, strict=True):
        for bound, k in sorted(((b.bound(terms, weights), k) for k, b in enumerate(blocks)), reverse=True):
            if bound < own.floor:
                break
            own.add(blocks[k], blocks[k].scores(terms, weights))
            visits += 1
    return visits


def found(index: DataFrame, items: list[tuple[np.ndarray, np.ndarray]], p: Params) -> DataFrame:
    """(item, id, score): for each item, given by its terms and their weights, at least its p.top best documents."""
    kind = index.schema["ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, held, id_type = [Best(p.top) for _ in items], [], None
        for batch in batches:
            id_type = batch.column(1).type.value_type
            for k in range(batch.num_rows):
                lists = [batch.column(c)[k].values for c in range(1, 6)]
                held.append(Block(batch.column(0)[k].as_py(), lists[0], *(x.to_numpy(zero_copy_only=False).astype(np.int64) for x in lists[1:]), p))
                if len(held) == HELD:
                    visit(held, items, best)
                    held = []
        visit(held, items, best)
        out = [(k, i, s) for k, b in enumerate(best) for i, s in zip(b.ids, b.score.tolist(), strict=True)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], id_type), pa.array([x[2] for x in out], pa.int64())], names=["item", "id", "score"])

    return index.mapInArrow(run, f"item long, id {kind}, score long")


def item_blocks(items: DataFrame, id_col: str, text_col: str, most: int = ITEM_BYTES) -> DataFrame:
    """(part, block, id, text): the rows of each partition in blocks of at most `most` bytes of text or one row."""
    kind = dict(items.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size = 0, 0
        for batch in batches:
            out = []
            for n in batch.column(3).to_pylist():
                if size and size + n > most:
                    block, size = block + 1, 0
                size += n
                out.append(block)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.int64()), *batch.columns[1:3]], names=["part", "block", "id", "text"])

    rows = items.select(F.spark_partition_id().alias("part"), F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(F.octet_length(text_col), F.lit(0)).alias("n"))
    return rows.mapInArrow(run, f"part int, block long, id {kind}, text string")


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _of_block(spark: SparkSession, docs: DataFrame, own: list, id_col: str, text_col: str, item_type: str, p: Params) -> DataFrame:
    """(item_id, rank, id, score) for the rows (id, text) of one block of items."""
    vocabulary = Vocabulary.of([r.text for r in own])
    counts = kept_table(counted(docs, id_col, text_col, vocabulary), "terms")
    n_docs, n_terms = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = {r.t: r.c for r in counts.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("c")).collect()}
    index = kept_table(stratified(counts, n_docs, n_terms, p), "index")
    weights = np.array([weight(n_docs, df[t]) if t in df else 0 for t in range(len(vocabulary.hashes))], np.int64)
    best = found(index, [(t[weights[t] > 0], (weights[t] * c)[weights[t] > 0]) for t, c in vocabulary.items], p)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= p.top)
    names = spark.createDataFrame([(k, r.id) for k, r in enumerate(own)], f"item long, item_id {item_type}")
    return ranked.join(F.broadcast(names), "item").select("item_id", "rank", "id", "score")


def ranked(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", p: Params = Params()) -> DataFrame:
    """(item_id, rank, id, score): the p.top best documents of every item, ranks from 1."""
    spark, item_type, kind = docs.sparkSession, dict(items.dtypes)[item_col], dict(docs.dtypes)[id_col]
    blocks = kept_table(item_blocks(items, item_col, item_text), "items")
    names = sorted((r.part, r.block) for r in blocks.select("part", "block").distinct().collect())
    out = spark.createDataFrame([], f"item_id {item_type}, rank int, id {kind}, score long")
    for part, block in names:
        own = blocks.filter((F.col("part") == part) & (F.col("block") == block)).select("id", "text").collect()
        each = _of_block(spark, docs, own, id_col, text_col, item_type, p)
        out = each if len(names) == 1 else out.unionByName(kept_table(each, "found"))
    return out.select(F.col("item_id").alias(item_col), "rank", F.col("id").alias(id_col), "score")
