"""Removal of repeated byte strings by suffix arrays, built by difference cover in buckets that Spark deals out.

A window is a string of `length` bytes of one text. The least hash of the GRAM-byte grams in it, its minimizer, depends on the window
alone, so equal windows have equal minimizers; neighbouring windows mostly share theirs, and such a run of windows travels as one piece
of text. Runs whose minimizer occurs once in the corpus hold no repeated window and are left behind. The others are shuffled by their
minimizer into buckets. A bucket's distinct pieces are put one behind the other and their suffixes sorted by the difference cover modulo
3: sampled triples are sorted and named, the names' suffixes are sorted by recursion, and the remaining suffixes are merged in by their
first byte and the next suffix's rank. Neighbours in that order with equal first `length` bytes are one class of windows, of which all
but the first by (document, start) are removed. A recursion over the bytes of the whole corpus would shuffle every byte's suffix several
times at each level, which no budget of a few times the input on disk allows; a class of windows never spans two buckets, so nothing is lost.

Equal pieces are reduced to the first before any shuffle, and again in their bucket. A minimizer of more than HOT pieces has its runs cut
into single windows, dealt by the windows' own hashes, so that a passage of many documents is spread over buckets.

Defined results: texts are compared as UTF-8 bytes; null counts as empty; texts shorter than a window stay whole. Rows of one id are one
document if their texts are equal, and get equal results; with different texts they are documents in the order of the texts' hashes.
Null ids come last. Very long texts are cut nowhere. An empty table gives an empty table. Columns of other names are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .runtime import BROADCAST_ROWS, kept_table, small, text_pieces

U = np.uint64
#: Bytes of text that a step in memory takes at a time, and bytes of pieces that are sorted together; one minimizer's pieces stay together.
RUN_BYTES, BUCKET_BYTES = 1 << 20, 1 << 20
_LAST = (1 << 63) - 1


@dataclass(frozen=True)
class Params:
    length: int = 100
    gram: int = 40
    hot: int = 100_000

    def __post_init__(self):
        if not 0 < self.grams < 64:
            raise ValueError("a window begins with 1 to 63 grams")

    @property
    def grams(self) -> int:
        """Grams that begin in a window."""
        return self.length - self.gram + 1


# ---- suffix arrays


def suffix_array(s: np.ndarray) -> np.ndarray:
    """The starts of all suffixes of s (integers above or equal 0) in ascending order; a suffix comes before what it begins."""
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    text = np.concatenate((s.astype(np.int64) + 1, np.zeros(3, np.int64)))
    # sampled positions are 1 and 2 modulo 3; where n is 1 modulo 3, n itself ends the first half of the names
    one, two = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sample = np.concatenate((one, two))
    base = int(text.max()) + 1
    if base < 1 << 21:
        key = (text[sample] * base + text[sample + 1]) * base + text[sample + 2]
    else:  # a name for the first two, so that three fit 64 bits
        pair = np.unique(text[sample] * base + text[sample + 1], return_inverse=True)[1]
        key = pair * base + text[sample + 2]
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    name = np.empty(len(sample), np.int64)
    name[order] = np.cumsum(np.concatenate(([0], ranked[1:] != ranked[:-1])))
    if int(name.max()) + 1 < len(sample):
        order = suffix_array(name)
    sampled = sample[order]
    rank = np.zeros(n + 3, np.int64)
    rank[sampled] = np.arange(1, len(sampled) + 1)
    sampled = sampled[sampled < n]
    # the rest begin with one symbol, then a sampled suffix
    top = len(order) + 2
    rest = np.arange(0, n, 3)
    rest = rest[np.argsort(text[rest] * top + rank[rest + 1], kind="stable")]
    first = sampled[sampled % 3 == 1]
    second = sampled[sampled % 3 == 2]
    before = np.searchsorted(text[first] * top + rank[first + 1], text[rest] * top + rank[rest + 1])
    if base < 1 << 21:
        before = before + np.searchsorted((text[second] * base + text[second + 1]) * top + rank[second + 2], (text[rest] * base + text[rest + 1]) * top + rank[rest + 2])
    else:
        pair = np.unique(np.concatenate((text[second] * base + text[second + 1], text[rest] * base + text[rest + 1])), return_inverse=True)[1]
        before = before + np.searchsorted(pair[: len(second)] * top + rank[second + 2], pair[len(second) :] * top + rank[rest + 2])
    out = np.empty(n, np.int64)
    at = np.arange(len(rest)) + before
    free = np.ones(n, bool)
    free[at] = False
    out[at], out[free] = rest, sampled
    return out


# ---- windows, minimizers, pieces


def gram_hashes(raw: np.ndarray, size: int) -> np.ndarray:
    """A hash of the `size` bytes from each position on."""
    n, step = len(raw) - size + 1, 1 << 18
    out = np.empty(max(n, 0), U)
    for a in range(0, n, step):
        part = raw[a : min(a + step, n) + size - 1]
        up, down = W._table(len(part) + 1)
        sums = np.zeros(len(part) + 1, U)
        np.cumsum((part.astype(U) + U(1)) * up[: len(part)], out=sums[1:])
        h = (sums[size:] - sums[:-size]) * down[: len(part) - size + 1]
        h ^= h >> U(32)
        h *= U(0xD6E8FEB86659FD93)
        h ^= h >> U(29)
        out[a : a + len(h)] = h
    return out


def sliding_least(h: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The least of each `size` neighbours, and the first place that has it."""

    def least(apart: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        right = h[apart : apart + n] < h[:n]
        return np.where(right, h[apart : apart + n], h[:n]), np.where(right, at[apart : apart + n], at[:n])

    at, width = np.arange(len(h), dtype=np.int32), 1
    while 2 * width <= size:
        h, at = least(width, len(h) - width)
        width *= 2
    return (h, at) if width == size else least(size - width, len(h) - (size - width))


def runs_of(raw: np.ndarray, offsets: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of windows of one row with their minimizer at one place: (first start, last start + 1, minimizer). Equal windows of one row always lie in different runs."""
    n = len(raw) - p.length + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, U)
    least, at = sliding_least(gram_hashes(raw, p.gram), p.grams)
    inside = np.zeros(n + 1, np.int32)
    lo, hi = offsets[:-1], offsets[1:] - p.length + 1
    full = hi > lo
    np.add.at(inside, lo[full], 1)
    np.add.at(inside, hi[full], -1)
    inside = np.cumsum(inside[:-1]) > 0
    first, last = inside.copy(), inside.copy()
    changes = at[1:] != at[:-1]
    row = np.zeros(n, bool)
    row[offsets[:-1][offsets[:-1] < n]] = True
    changes |= row[1:]
    first[1:] &= changes | ~inside[:-1]
    last[:-1] &= changes | ~inside[1:]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, least[start]


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... size[0] of them, then those of start[1], ..."""
    return np.repeat(start - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(int(size.sum())) if len(size) else np.empty(0, np.int64)


def _first_of(order: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """For rows sorted by keys through order: whether each is the first of its group."""
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
    return new


def _batch(names: str, *columns: np.ndarray | pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x.view(np.int64) if x.dtype == U else x) for x in columns], names=names.split())


def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, t, text): doc is the id, or the largest number for null; t tells texts of one id apart."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("doc"), F.xxhash64(text).alias("t"), text.alias("text"))


def _once(named: DataFrame) -> DataFrame:
    """named without repeated rows."""
    again = small(kept_table(named.groupBy("doc", "t").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("doc", "t"), "again"))
    if again.isEmpty():
        return named
    return named.join(again, ["doc", "t"], "left_anti").unionByName(named.join(again, ["doc", "t"], "left_semi").groupBy("doc", "t").agg(F.min("text").alias("text")))


def _place(lo: np.ndarray, size: np.ndarray, kind: np.ndarray | int = 0) -> np.ndarray:
    """First start, number of windows (a run has as many as a window has grams at most) and a kind of 0 to 3 in one number, for narrow shuffles."""
    return (lo * 64 + size) * 4 + kind


ALONE, AGAIN, KNOWN = 0, 1, 2


def minimizer_runs(named: DataFrame, p: Params) -> DataFrame:
    """(key, doc, t, place) for each run of windows. Within a step's texts, the first run of a minimizer is ALONE, or AGAIN if there are more, and those are KNOWN to be repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end_row, raw, offsets in text_pieces(batch.column(2), RUN_BYTES):
                lo, hi, key = runs_of(raw, offsets, p)
                row = np.searchsorted(offsets, lo, "right") - 1
                doc, t = (batch.column(c).slice(first, end_row - first).to_numpy()[row] for c in (0, 1))
                order = np.argsort(key, kind="stable")
                new = _first_of(order, key)
                kind = np.full(len(key), KNOWN)
                at = np.flatnonzero(new)
                kind[order[at]] = np.where(np.diff(np.concatenate((at, [len(key)]))) > 1, AGAIN, ALONE)
                yield _batch("key doc t place", key, doc, t, _place(lo - offsets[row], hi - lo, kind))

    return named.mapInArrow(run, "key long, doc long, t long, place long")


def repeated_runs(runs: DataFrame) -> DataFrame:
    """Those of minimizer_runs whose minimizer is that of another run, too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, before = None, None  # the last row waits for what follows; before: the key ahead of it
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            key, kind = batch.column(0).to_numpy(), batch.column(3).to_numpy() & 3
            same = key[1:] == key[:-1]
            again = kind != ALONE
            again[1:] |= same
            again[:-1] |= same
            again[0] |= before is not None and before == key[0]
            yield batch.slice(0, len(key) - 1).filter(pa.array(again[:-1]))
            before = key[-2] if len(key) > 1 else before
            held = batch.slice(len(key) - 1)
        if held is not None:
            last = held.column(0)[0].as_py()
            yield held.slice(0, 1 if held.column(3)[0].as_py() & 3 != ALONE or before == last else 0)

    known = F.col("place").bitwiseAND(3) == KNOWN
    dealt = runs.repartition(F.when(known, F.xxhash64("doc", "t", "place")).otherwise(F.col("key"))).sortWithinPartitions("key")
    return dealt.mapInArrow(run, "key long, doc long, t long, place long")


def _collapsed(key: np.ndarray, doc: np.ndarray, t: np.ndarray, lo: np.ndarray, raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which pieces raw[ends[k]:ends[k + 1]] are not the first, by (doc, t, lo), of equal pieces of their key."""
    size = np.diff(ends)
    h = W.hashes(raw, ends[:-1], ends[1:])
    order = np.lexsort((lo, t, doc, size, h, key))
    new = _first_of(order, key, h, size)
    head = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))] if len(order) else order
    copies, heads = order[~new], head[~new]
    # equal hashes are confirmed byte by byte
    differs = raw[_ranges(ends[copies], size[copies])] != raw[_ranges(ends[heads], size[copies])]
    bad = np.zeros(len(copies), bool)
    bad[np.repeat(np.arange(len(copies)), size[copies])[differs]] = True
    out = np.zeros(len(key), bool)
    out[copies[~bad]] = True
    return out


def pieces(texts: DataFrame, p: Params) -> DataFrame:
    """(key, doc, t, place, piece) of texts (doc, t, text, runs): the bytes of each run's windows, those of hot minimizers cut into single windows with keys of their own. Copies of a piece within a
    step's texts come without it: the bytes of their document from the first start up to `key` are repeated for certain."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(3).offsets.to_numpy()
            fields = [batch.column(3).values.field(k).to_numpy(zero_copy_only=False) for k in range(3)]
            for first, end_row, raw, offsets in text_pieces(batch.column(2), RUN_BYTES):
                a, b = int(at[first]), int(at[end_row])
                row = np.repeat(np.arange(end_row - first), np.diff(at[first : end_row + 1]))
                place, key, hot = (x[a:b] for x in fields)
                order = np.lexsort((place, row))
                place, key, hot, row = place[order], key[order], hot[order], row[order]
                lo, windows, hot = place >> 8, place >> 2 & 63, hot.astype(bool)
                each = np.where(hot, windows, 1)  # single windows of hot runs
                back = np.repeat(np.arange(len(lo)), each)
                start = _ranges(lo, each)
                windows = np.where(hot, 1, windows)[back]
                key, row = key[back].view(U).copy(), row[back]
                begin, size = start + offsets[row], windows + p.length - 1
                if hot.any():
                    own = np.flatnonzero(hot[back])
                    key[own] = W.mix(gram_hashes(raw, p.length)[begin[own]])
                doc, t = (batch.column(c).slice(first, end_row - first).to_numpy()[row] for c in (0, 1))
                data = raw[_ranges(begin, size)]
                ends = np.concatenate(([0], np.cumsum(size)))
                copy = _collapsed(key.view(np.int64), doc, t, start, data, ends)
                kept, own = data[_ranges(ends[:-1][~copy], size[~copy])], np.flatnonzero(~copy)
                places = np.concatenate(([0], np.cumsum(size[own]))).astype(np.int32)
                column = pa.Array.from_buffers(pa.binary(), len(own), [None, pa.py_buffer(places), pa.py_buffer(kept.tobytes())])
                yield _batch("key doc t place piece", key[own], doc[own], t[own], _place(start[own], windows[own]), column)
                # copies that overlap or touch are one interval
                own = np.flatnonzero(copy)
                fresh = np.ones(len(own), bool)
                fresh[1:] = (row[own][1:] != row[own][:-1]) | (start[own][1:] > (start + size)[own][:-1])
                last = np.flatnonzero(np.concatenate((fresh[1:], [True]))) if len(own) else own
                own, end = own[fresh], (start + size)[own[last]]
                yield _batch("key doc t place piece", end, doc[own], t[own], _place(start[own], 0), pa.nulls(len(own), pa.binary()))

    return texts.select("doc", "t", "text", "runs").mapInArrow(run, "key long, doc long, t long, place long, piece binary")


# ---- buckets


def repeated_bytes(key: np.ndarray, doc: np.ndarray, t: np.ndarray, lo: np.ndarray, raw: np.ndarray, ends: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, lo, hi): the bytes of each row's document that windows cover which occur earlier. Row k's piece is raw[ends[k]:ends[k + 1]], from byte lo[k] of its document on."""
    copy = _collapsed(key, doc, t, lo, raw, ends)
    whole = np.flatnonzero(copy)
    out = [(whole, lo[whole], lo[whole] + np.diff(ends)[whole])]
    own = np.flatnonzero(~copy)
    size = np.diff(ends)[own]
    # distinct pieces, a 0 behind each; 1 to 256 are bytes
    begin = np.concatenate(([0], np.cumsum(size + 1)))
    text = np.zeros(int(begin[-1]), np.int64)
    where = _ranges(begin[:-1], size)
    text[where] = raw[_ranges(ends[:-1][own], size)].astype(np.int64) + 1
    piece = np.repeat(np.arange(len(own)), size + 1)
    full = np.zeros(len(text), bool)
    full[_ranges(begin[:-1], size - p.length + 1)] = True
    order = suffix_array(text)
    order = order[full[order]]
    if len(order):
        views = np.lib.stride_tricks.sliding_window_view(text.astype(np.uint16), p.length)
        equal = np.zeros(len(order), bool)
        for a in range(1, len(order), 1 << 16):
            here = order[a - 1 : a + (1 << 16)]
            got = views[here]
            equal[a : a + len(here) - 1] = (got[1:] == got[:-1]).all(axis=1)
        start = lo[own[piece[order]]] + order - begin[piece[order]]
        classes = np.cumsum(~equal)
        rank = np.lexsort((start, t[own[piece[order]]], doc[own[piece[order]]], classes))
        later = rank[~_first_of(rank, classes)]
        at, begins = piece[order[later]], start[later]
        by = np.lexsort((begins, at))
        at, begins = at[by], begins[by]
        if len(at):
            apart = np.concatenate(([True], (at[1:] != at[:-1]) | (begins[1:] > begins[:-1] + p.length)))
            last = np.concatenate((apart[1:], [True]))
            out.append((own[at[apart]], begins[apart], begins[last] + p.length))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def repeated_intervals(dealt: DataFrame, p: Params) -> DataFrame:
    """(doc, t, lo, hi) from rows of pieces(); intervals may overlap."""

    def sorted_out(table: pa.Table) -> pa.RecordBatch:
        batch = table.combine_chunks().to_batches()[0]
        piece = batch.column(4)
        doc, t, lo = batch.column(1).to_numpy(), batch.column(2).to_numpy(), batch.column(3).to_numpy() >> 8
        raw, ends = np.frombuffer(piece.buffers()[2], np.uint8), np.frombuffer(piece.buffers()[1], np.int32, len(piece) + 1, piece.offset * 4).astype(np.int64)
        row, a, b = repeated_bytes(batch.column(0).to_numpy(), doc, t, lo, raw, ends, p)
        return _batch("doc t lo hi", doc[row], t[row], a, b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            null = batch.column(4).is_null()
            known = batch.filter(null)
            if known.num_rows:
                place = known.column(3).to_numpy()
                yield _batch("doc t lo hi", known.column(1), known.column(2), place >> 8, known.column(0))
            rest = batch.filter(pc.invert(null))
            if not rest.num_rows:
                continue
            held.append(rest)
            size += rest.column(4).nbytes
            if size < BUCKET_BYTES:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            key = table.column(0).to_numpy()
            cut = np.flatnonzero(key[1:] != key[:-1]) + 1
            width = table.column(4).nbytes / max(1, len(key))
            a = 0
            while len(cut) and (len(key) - a) * width >= BUCKET_BYTES:
                k = min(int(np.searchsorted(cut, a + max(1, int(BUCKET_BYTES / width)))), len(cut) - 1)
                b = int(cut[k])
                if b <= a:
                    break
                yield sorted_out(table.slice(a, b - a))
                a = b
            held = [x for x in table.slice(a).to_batches() if x.num_rows]
            size = sum(x.column(4).nbytes for x in held)
        if held:
            yield sorted_out(pa.Table.from_batches(held))

    by = F.when(F.col("piece").isNull(), F.xxhash64("doc", "t", "place")).otherwise(F.col("key"))
    return dealt.repartition(by).sortWithinPartitions("key").mapInArrow(run, "doc long, t long, lo long, hi long")


def merged(intervals: DataFrame) -> DataFrame:
    """(doc, t, spans): each document's intervals, those that overlap or touch made one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets = batch.column(2).offsets.to_numpy()
            lo, hi = (batch.column(2).values.field(k).to_numpy() for k in (0, 1))
            row = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
            lo, hi = lo[offsets[0] : offsets[-1]], hi[offsets[0] : offsets[-1]]
            order = np.lexsort((lo, row))
            row, lo, hi = row[order], lo[order], hi[order]
            lift = row * (int(hi.max()) + 2 if len(hi) else 0)  # rows side by side, so that one running maximum serves all
            reach = np.maximum.accumulate(hi + lift)
            new = np.concatenate(([True], (lo + lift)[1:] > reach[:-1])) if len(row) else np.empty(0, bool)
            ends = np.concatenate((np.flatnonzero(new)[1:] - 1, [len(row) - 1])) if len(row) else np.empty(0, np.int64)
            spans = pa.StructArray.from_arrays([pa.array(lo[new]), pa.array((reach - lift)[ends])], names=["lo", "hi"])
            counts = np.searchsorted(row[new], np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.ListArray.from_arrays(pa.array(counts), spans)], names=["doc", "t", "spans"])

    lists = intervals.groupBy("doc", "t").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    return lists.mapInArrow(run, "doc long, t long, spans array<struct<lo:long,hi:long>>")


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", p: Params = Params()) -> DataFrame:
    """(doc, t, spans): the bytes of each document that lie in a window which occurs earlier, as maximal runs; documents without any are left out."""
    once = _once(_named(docs, id_col, text_col))
    runs = kept_table(repeated_runs(minimizer_runs(once, p)), "runs")
    hot = small(kept_table(runs.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > p.hot).select("key", F.lit(True).alias("hot")), "hot"))
    lists = runs.join(hot, "key", "left").groupBy("doc", "t").agg(F.collect_list(F.struct("place", "key", F.coalesce("hot", F.lit(False)).alias("hot"))).alias("runs"))
    texts = once.join(lists, ["doc", "t"])
    return kept_table(merged(repeated_intervals(pieces(texts, p), p)), "spans")


def _with_spans(docs: DataFrame, spans: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, spans) of every row of docs. The spans are broadcast if they are few, else the texts are shuffled."""
    rows, many = spans.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("spans")), F.lit(0))).first()
    side = F.broadcast(spans) if 2 * (rows + many) <= BROADCAST_ROWS else spans
    named = _named(docs, id_col, text_col).select("doc", "t", "text")
    return named.join(side, ["doc", "t"], "left").select("doc", "text", "spans")


def kept_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", p: Params = Params()) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept) of every row of docs; kept: the bytes that remain."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                raw, out, at = text.encode(), [], 0
                for s in spans or ():
                    out.append(raw[at : s["lo"]])
                    at = s["hi"]
                out.append(raw[at:])
                rows.append((len(raw), len(raw) - sum(map(len, out)), len(spans or ()), b"".join(out)))
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc", "n_bytes", "n_removed", "n_spans", "kept"])

    both = _with_spans(docs, repeats(docs, id_col, text_col, p), id_col, text_col)
    out = both.mapInArrow(run, "doc long, n_bytes long, n_removed long, n_spans long, kept binary")
    return out.select(F.when(F.col("doc") < _LAST, F.col("doc")).alias(id_col), "n_bytes", "n_removed", "n_spans", "kept")


def digest(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """kept_bytes with the SHA-256 of the bytes that remain in their place."""
    return kept_bytes(docs, p=p).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
