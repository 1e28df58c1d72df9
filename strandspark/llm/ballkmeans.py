"""Vector codes by ball k-means: every vector is cut into parts, and every part becomes the index of its codebook's nearest entry.

A round assigns all parts and then moves the entries to their parts' means. Between rounds a row keeps its codes. A ball is an entry
with the parts of a batch that it holds; its radius says which entries are its neighbours: only those within twice the radius can win
one of its parts. A part nearer to its entry than half the way to the nearest neighbour lies in the stable core and is not looked at;
the others lie in rings, each of which adds one neighbour to the candidates. A ball that did not move, with neighbours that did not
move, is passed over. All of it is 64-bit integer arithmetic, so codes are exact: distances that can't win are the only ones left out.

Only the codebooks (parts x entries) and their sums reach the driver; rows stay in tables of the shared folder, of which two exist at a time.

Defined results: rows whose vector is null or holds null or non-finite components are dropped, as are vectors that are not as long as
that of the smallest kept id; a length that is no multiple of the parts is cut at floor(part * length / parts). Components beyond
+-8192 are clipped to it. Repeated ids are rows of their own, and rows with a null id count as the largest ids; where fewer rows are
kept than a codebook has entries, it has as many entries as rows. Null labels are one group. An empty table gives an empty table.
Columns of other names are left out, whatever they are called.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import discard, kept_table, weighted_join

#: Components are clipped to +-CLIP, so that four times a squared distance fits 64 bits up to 1024 components a part.
CLIP = 1 << 25


@dataclass(frozen=True)
class Params:
    parts: int = 8
    entries: int = 16
    rounds: int = 6
    scale: int = 4096


def cuts(width: int, parts: int) -> list[int]:
    """Where the parts of a vector of so many components begin and end."""
    return [p * width // parts for p in range(parts + 1)]


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return (d * d).sum(axis=-1)


def nearest(part: np.ndarray, codes: np.ndarray, book: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(codes, squared distances, distances computed) of the rows of one part: codes are those of the round before, moved says which entries have moved since."""
    own = squared(part, book[codes])
    apart = squared(book[:, None], book[None])
    out, best, work = codes.copy(), own.copy(), len(part)
    for i in np.unique(codes).tolist():
        rows = np.flatnonzero(codes == i)
        reach = 4 * own[rows]
        near = np.flatnonzero(apart[i] <= reach.max())
        near = near[near != i]
        if not len(near) or not (moved[i] or moved[near].any()):
            continue
        near = near[np.argsort(apart[i, near], kind="stable")]
        ring = np.searchsorted(apart[i, near], reach, "right")  # so many neighbours may hold the part; none of them: stable core
        for k, j in enumerate(near.tolist()):
            at = rows[ring > k]
            if not len(at):
                break
            d = squared(part[at], book[j])
            work += len(at)
            wins = (d < best[at]) | ((d == best[at]) & (j < out[at]))
            out[at[wins]], best[at[wins]] = j, d[wins]
    return out, best, work


def _matrix(column: pa.Array, dtype: str) -> np.ndarray:
    """The rows of a binary column of equally long values."""
    column = column.cast(pa.binary())
    _, at, data = column.buffers()
    ends = np.frombuffer(at, np.int32, len(column) + 1, column.offset * 4)
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.empty(0, np.uint8)
    return raw.view(dtype).reshape(len(column), -1) if len(raw) else np.zeros((len(column), 0), dtype)


def _binary(rows: np.ndarray) -> pa.Array:
    rows = np.ascontiguousarray(rows)
    step = rows.dtype.itemsize * rows.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer((np.arange(len(rows) + 1) * step).astype(np.int32)), pa.py_buffer(rows.tobytes())])


def quantised(vectors: DataFrame, id_col: str, vec_col: str, label_col: str, p: Params) -> DataFrame:
    """(id, label, q, codes): q holds the components floor(scale * x) as 32-bit integers, codes a zero for each part."""
    finite = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    good = vectors.filter(F.col(vec_col).isNotNull() & finite)
    good = good.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vec_col).cast("array<double>").alias("v"))
    head = good.orderBy(F.col("id").asc_nulls_last(), F.col("v")).select(F.size("v")).first()
    width = head[0] if head else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)
            q = np.clip(np.floor(v * p.scale), -CLIP, CLIP).astype("<i4")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _binary(q), _binary(np.zeros((len(q), p.parts), np.uint8))], names=["id", "label", "q", "codes"])

    types = dict(good.dtypes)
    return good.filter(F.size("v") == width).mapInArrow(run, f"id {types['id']}, label {types['label']}, q binary, codes binary")


def assigned(table: DataFrame, books: np.ndarray, moved: np.ndarray, p: Params) -> DataFrame:
    """table with the codes of the nearest entries, and the sum of their squared distances as error. books: entries x components, moved: parts x entries."""
    at = cuts(books.shape[1], p.parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            q, codes = _matrix(batch.column(2), "<i4").astype(np.int64), _matrix(batch.column(3), "u1")
            out, error = np.empty_like(codes), np.zeros(len(q), np.int64)
            for k in range(p.parts):
                out[:, k], d, _ = nearest(q[:, at[k] : at[k + 1]], codes[:, k], books[:, at[k] : at[k + 1]], moved[k])
                error += d
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], _binary(out), pa.array(error)], names=["id", "label", "q", "codes", "error"])

    types = dict(table.dtypes)
    return table.select("id", "label", "q", "codes").mapInArrow(run, f"id {types['id']}, label {types['label']}, q binary, codes binary, error long")


def moved_to(table: DataFrame, books: np.ndarray, p: Params) -> np.ndarray:
    """The componentwise floor of the means of the entries' parts; an entry without parts stays. Every task adds up its rows, so that entries x components sums of it are shuffled."""
    entries, width = books.shape
    at = cuts(width, p.parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((entries, width), np.int64), np.zeros((entries, width), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            q, codes = _matrix(batch.column(0), "<i4"), _matrix(batch.column(1), "u1")
            for k in range(p.parts):
                counts[:, at[k] : at[k + 1]] += np.bincount(codes[:, k], minlength=entries)[:, None]
                for j in range(at[k], at[k + 1]):  # exact in doubles: a batch adds less than 2^53
                    sums[:, j] += np.bincount(codes[:, k], q[:, j], entries).astype(np.int64)
        entry, component = np.indices(sums.shape)
        yield pa.RecordBatch.from_arrays([pa.array(x.ravel()) for x in (entry, component, sums, counts)], names=["entry", "component", "s", "n"])

    parts = table.select("q", "codes").mapInArrow(run, "entry long, component long, s long, n long")
    out = books.copy()
    for r in parts.groupBy("entry", "component").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).filter("n > 0").collect():
        out[r.entry, r.component] = r.s // r.n
    return out


def compressed(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", p: Params = Params()) -> tuple[DataFrame, np.ndarray]:
    """(id, label, q, codes, error) for each kept row, and the final codebooks as entries x components."""
    table = kept_table(quantised(vectors, id_col, vec_col, label_col, p), "vectors")
    first = table.orderBy(F.col("id").asc_nulls_last(), "q").select("q").limit(p.entries).collect()
    books = np.array([np.frombuffer(r.q, "<i4") for r in first], np.int64) if first else np.zeros((0, 0), np.int64)
    moved = np.ones((p.parts, len(first)), bool)
    at = cuts(books.shape[1], p.parts)
    for last in [False] * p.rounds + [True]:
        following = kept_table(assigned(table, books, moved, p), "codes")
        discard(table)
        table = following
        if last or not moved.any():
            continue
        new = moved_to(table, books, p)
        moved = np.stack([(new != books)[:, at[k] : at[k + 1]].any(axis=1) for k in range(p.parts)])
        books = new
    return table, books


def fingerprint(books: np.ndarray, p: Params = Params()) -> str:
    """SHA-256 of all components in decimal, by part, entry and place, joined by commas."""
    at = cuts(books.shape[1], p.parts)
    parts = [books[:, at[k] : at[k + 1]].ravel() for k in range(p.parts)]
    return hashlib.sha256(",".join(map(str, np.concatenate(parts).tolist())).encode()).hexdigest()


def with_label_error(table: DataFrame) -> DataFrame:
    """table (label, error, ...) with label_error, the errors added up over equal labels; nulls are one label. A hot label is broadcast."""
    keyed = table.withColumn("_l", F.coalesce(F.col("label").cast("string"), F.lit(""))).withColumn("_none", F.col("label").isNull())
    totals = kept_table(keyed.groupBy("_l", "_none").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("_n")), "labels")
    return weighted_join(keyed, totals, ["_l", "_none"], "_n").drop("_l", "_none", "_n")
