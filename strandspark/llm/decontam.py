"""Benchmark decontamination: CGK embedding, bit-sampling LSH over windows at every word, exact edit verification.

The CGK walk reads a window of words w: at step t it writes w[i] and moves on by r_t(w[i]), a random bit; two windows of small
edit distance then write the same word at most steps. A repetition is a walk of its own bits, a place of the item-sized window at
which it starts, and sampled coordinates of what it writes from there: the first, and one drawn from each stratum of the next
SPAN, as neighbours often write one word twice. An
edit throws a walk off for a while, so samples that lie close together survive more often, and the starts, spread over the
window, see to it that no edit spoils all repetitions. There are as many repetitions as it takes for edited copies of the items
themselves, at the limit of edits, to be found with the target recall.

Windows start at every word of every text. The sampled words are compared one after the other, so nearly all windows leave the
walk after the first; this is the same test as one key of all samples. Words are runs of letters, digits and non-ASCII bytes,
ASCII letters folded. A candidate is confirmed when the item's edit distance in words to the best stretch of the text around it is
at most max_edits of its words. Items too short for samples (under exact_below words) are cut into one piece more than they may have
edits, and every window of the text is compared with these pieces, one of which stands there unspoilt: this is exact. Those under
verbatim_below words count only where they stand word for word, as chance would match more.

Defined results: null or wordless texts and items match nothing; items without an id match with a null one; each (document row,
item) gives one row, its best match, and on ties the first; repeated rows give theirs each; other columns are left out or passed
through, whatever they are called; very long texts are searched whole; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .runtime import filtered_rows, text_pieces

U = np.uint64
#: Samples of a repetition lie within so many steps of its first.
SPAN = 12
#: Edited copies of at most so many items, and so many of each, tell how many repetitions are needed, which are at most MOST.
TRIED_ITEMS, TRIED_COPIES, MOST = 60, 20, 64


@dataclass(frozen=True)
class Params:
    """recall: share of copies with max_edits of their words edited at random that must become candidates; it fixes the repetitions."""

    max_edits: float = 0.2
    recall: float = 0.99
    samples: int = 4
    exact_below: int = 16
    verbatim_below: int = 8
    block: int = 50_000

    def steps(self, repetition: int) -> list[int]:
        """The sampled coordinates, counted from the walk's start."""
        apart = SPAN // (self.samples - 1)
        return [0, *(apart * k + int(x) - 1 for k, x in enumerate(np.random.default_rng(repetition).integers(-(apart // 4), apart // 4 + 1, self.samples - 1), 1))]

    def edits(self, n_words: int) -> int:
        return int(self.max_edits * n_words) if n_words >= self.verbatim_below else 0


def _bit(words: np.ndarray, repetition: int, step: int) -> np.ndarray:
    seed = W.mix(np.array([repetition << 8 | step], U) + U(0x51ED270B))
    return (W.mix(words ^ seed) >> U(63)).astype(np.int64)


def _start(size: np.ndarray, repetition: int) -> np.ndarray:
    """Where in items of these sizes a repetition starts: places spread evenly, whatever the number of repetitions, by the golden ratio."""
    return ((repetition * 0.6180339887) % 1.0 * np.maximum(1, size - SPAN + 1)).astype(np.int64)


class Index:
    """The items of a block: their words, and for each repetition the chains of sampled words as ascending hashes by level."""

    def __init__(self, ids: list[int | None], texts: list[str], p: Params):
        self.p = p
        raw = [x.encode() for x in texts]
        data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
        start, end = W.spans(data, offsets, W.PARTS)
        words, first = W.hashes(data, start, end, W.LOWER), W.per_row(offsets, start)
        sizes = np.diff(first)
        keep = np.flatnonzero(sizes > 0)
        self.ids = pa.array([ids[k] for k in keep.tolist()], pa.int64())
        self.words = [words[first[k] : first[k + 1]] for k in keep.tolist()]
        self.sizes = sizes[keep]
        self.segments = self._segments()
        self.long = np.flatnonzero(self.sizes >= p.exact_below)
        self.flat = np.concatenate([self.words[k] for k in self.long.tolist()]) if len(self.long) else np.empty(0, U)
        self.first = np.concatenate(([0], np.cumsum(self.sizes[self.long])))
        self.chains: list[list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]] = []
        if len(self.long):
            self._repeat()
        self.seeds = np.unique(np.concatenate([c[0][0] for c in self.chains])) if self.chains else np.empty(0, U)

    def _segments(self) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Length -> (ascending hashes, items, places in the items) of the pieces of short items: an item with e edits allowed has e + 1 pieces, one of which no e edits spoil."""
        rows: dict[int, list[tuple[int, int, int]]] = {}
        for k in np.flatnonzero(self.sizes < self.p.exact_below).tolist():
            own, parts = self.words[k], self.p.edits(len(self.words[k])) + 1
            bounds = [len(own) * j // parts for j in range(parts + 1)]
            for a, b in zip(bounds, bounds[1:]):
                rows.setdefault(b - a, []).append((int(W.windows(own[a:b], b - a)[0]), k, a))
        return {n: (np.array([x[0] for x in sorted(v)], U), *(np.array([x[c] for x in sorted(v)], np.int64) for c in (1, 2))) for n, v in rows.items()}

    def _repeat(self) -> None:
        """Adds repetitions until the tried copies are found."""
        words, end, item, tried = self._copies()
        missed, own = np.ones(len(tried), bool), np.repeat(tried, np.bincount(item))
        for r in range(MOST):
            self.chains.append(self._chain(r))
            anchor, found, _ = self._hits(r, words, end, np.arange(len(words)))
            missed[item[anchor[found == own[anchor]]]] = False
            if missed.mean() <= 1 - self.p.recall:
                break

    def _copies(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Words of edited copies, for each word the end of its copy and the copy's number, and the item of each copy."""
        rng = np.random.default_rng(7)
        order = self.long[np.argsort(self.sizes[self.long], kind="stable")]
        tried = order[np.unique(np.linspace(0, len(order) - 1, min(TRIED_ITEMS, len(order))).astype(int))]
        tried = np.repeat(tried, TRIED_COPIES)
        copies = []
        for k in tried.tolist():
            own = self.words[k].tolist()
            for _ in range(self.p.edits(len(own))):
                at, kind = int(rng.integers(len(own))), int(rng.integers(3))
                fresh = int(rng.integers(1 << 63))
                own[at : at + (kind != 1)] = [] if kind == 2 else [fresh]
            copies.append(own)
        size = np.array([len(c) for c in copies])
        return np.array([w for c in copies for w in c], U), np.repeat(np.cumsum(size), size), np.repeat(np.arange(len(copies)), size), tried

    def _chain(self, r: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """By level: the hashes that go on, ascending; the hashes of chains that end here, the item's words being read or all samples taken, their items and starts. Level 0 has the first words themselves."""
        live = np.arange(len(self.long))
        begin = _start(self.sizes[self.long], r)
        at = self.first[:-1] + begin
        steps, total = self.p.steps(r), self.flat[at]
        out, t = [], 0
        for level, step in enumerate(steps):
            if level:
                total = W.mix(total * U(31) + self.flat[at])
            reached, held = live, total
            ahead = at
            if level + 1 < len(steps):
                inside = np.ones(len(live), bool)
                while t < steps[level + 1]:
                    ahead = np.where(inside, ahead + _bit(self.flat[np.minimum(ahead, len(self.flat) - 1)], r, t), ahead)
                    inside &= ahead < self.first[live + 1]
                    t += 1
            else:
                inside = np.zeros(len(live), bool)
            over = np.argsort(held[~inside], kind="stable")
            out.append((np.unique(held), held[~inside][over], self.long[reached[~inside]][over], begin[reached[~inside]][over]))
            live, at, total = live[inside], ahead[inside], total[inside]
        return out

    def _hits(self, r: int, words: np.ndarray, end: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word of the window, item, place in the item) of the windows from the words `live` on that agree with an item in a repetition's samples."""
        steps, found, t = self.p.steps(r), [], 0
        live = live[_in(words[live], self.chains[r][0][0])]
        at, total = live, words[live]
        for level, (wanted, over, items, begin) in enumerate(self.chains[r]):
            if level:
                while t < steps[level] and len(live):
                    at = at + _bit(words[at], r, t)
                    t += 1
                    ok = at < end[live]
                    live, at, total = live[ok], at[ok], total[ok]
                total = W.mix(total * U(31) + words[at])
                hit = _in(total, wanted)
                live, at, total = live[hit], at[hit], total[hit]
            if not len(live):
                break
            if len(over):
                low, high = np.searchsorted(over, total, "left"), np.searchsorted(over, total, "right")
                n = high - low
                own = np.repeat(low - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
                found.append((np.repeat(live, n), items[own], begin[own]))
        if not found:
            return (np.empty(0, np.int64),) * 3
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def candidates(self, words: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word of the window, word where the item would begin, item) for windows from every word; end: for each word the end of its text."""
        found = []
        seeds = _in(words, self.seeds)
        for r in range(len(self.chains)):
            anchor, item, begin = self._hits(r, words, end, seeds)
            found.append((anchor, anchor - begin, item))
        for n, (key, items, begin) in self.segments.items():
            all_ = W.windows(words, n)
            at = _in(all_, key)
            at = at[at + n <= end[at]]
            low, high = np.searchsorted(key, all_[at], "left"), np.searchsorted(key, all_[at], "right")
            many = high - low
            own = np.repeat(low - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
            anchor = np.repeat(at, many)
            found.append((anchor, anchor - begin[own], items[own]))
        if not found:
            return (np.empty(0, np.int64),) * 3
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _in(values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of values that are in a short ascending array: a table on 16 bits first."""
    if not len(wanted):
        return np.empty(0, np.int64)
    table = np.zeros(1 << 16, bool)
    table[(wanted >> U(48)).astype(np.int64)] = True
    near = np.flatnonzero(table[(values >> U(48)).astype(np.int64)])
    some = values[near]
    return near[wanted[np.minimum(np.searchsorted(wanted, some), len(wanted) - 1)] == some]


def best_stretch(item: list[int], text: list[int]) -> tuple[int, int, int]:
    """(edits, start, end) of the stretch of text with the smallest edit distance to item; the first among equals."""
    cost, begin = [0] * (len(text) + 1), list(range(len(text) + 1))
    for i, w in enumerate(item, 1):
        last_cost, last_begin = cost, begin
        cost, begin = [i], [0]
        for j, x in enumerate(text, 1):
            c, b = last_cost[j - 1] + (w != x), last_begin[j - 1]
            if last_cost[j] + 1 < c:
                c, b = last_cost[j] + 1, last_begin[j]
            if cost[j - 1] + 1 < c:
                c, b = cost[j - 1] + 1, begin[j - 1]
            cost.append(c)
            begin.append(b)
    end = min(range(len(cost)), key=cost.__getitem__)
    return cost[end], begin[end], end


def _verify(index: Index, words: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int, int, int, int]]:
    """(row, item, edits, item words, start word, end word): the best confirmed match of each row and item."""
    row_of = np.repeat(np.arange(len(first) - 1), np.diff(first))
    anchors, begins, items = index.candidates(words, first[1:][row_of])
    if not len(begins):
        return []
    both = np.unique(np.stack((row_of[anchors], items, begins)), axis=1)
    found: dict[tuple[int, int], tuple[int, int, int]] = {}
    done: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for row, item, begin in both.T.tolist():
        own, low, high = index.words[item], int(first[row]), int(first[row + 1])
        n = len(own)
        most = index.p.edits(n)
        if found.get((row, item), (1,))[0] == 0:
            continue
        if low <= begin and begin + n <= high and (words[begin : begin + n] == own).all():
            found[row, item] = (0, begin - low, begin - low + n)
            continue
        if not most:
            continue
        a, b = max(low, begin - most), min(high, begin + n + most)
        if b - a < n - most or any(x <= a and b <= y for x, y in done.get((row, item), ())):
            continue
        a, b = max(low, a - most), min(high, b + most)  # wider, so that near candidates of the same place need no second look
        done.setdefault((row, item), []).append((a, b))
        around = words[a:b].tolist()
        if sum(map(set(around).__contains__, own.tolist())) < n - most:  # every word that is nowhere costs an edit
            continue
        edits, s, e = best_stretch(own.tolist(), around)
        if edits <= most and edits < found.get((row, item), (most + 1,))[0]:
            found[row, item] = (edits, a + s - low, a + e - low)
    return [(row, item, edits, int(index.sizes[item]), s, e) for (row, item), (edits, s, e) in sorted(found.items())]


def _indexes(benchmark: DataFrame, item_col: str, item_text: str, p: Params) -> list[Index]:
    """The items, which are the stated query set, in hashed blocks of about p.block."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text")).filter("text is not null")
    blocks = max(1, math.ceil(items.count() / p.block))
    out = []
    for k in range(blocks):
        rows = sorted(((r["item_id"], r["text"]) for r in items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        out.append(Index([r[0] for r in rows], [r[1] for r in rows], p))
    return out


def _found(index: Index, raw: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int, int, int]]:
    start, end = W.spans(raw, offsets, W.PARTS)
    return _verify(index, W.hashes(raw, start, end, W.LOWER), W.per_row(offsets, start))


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", p: Params = Params()) -> DataFrame:
    """(id, item_id, n_edits, item_words, start_word, end_word) for every document and item whose text occurs in it. The texts are read once, for all blocks of items."""
    held = docs.sparkSession.sparkContext.broadcast(_indexes(benchmark, item_col, item_text, p))

    def run(batches):
        for batch in batches:
            at = 0
            for _, _, raw, offsets in text_pieces(batch.column(1)):
                for index in held.value:
                    got = _found(index, raw, offsets)
                    if got:
                        row, item, edits, n, s, e = (np.array(x) for x in zip(*got, strict=True))
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row + at)), index.ids.take(pa.array(item)), *(pa.array(x.astype(np.int32)) for x in (edits, n, s, e))], names=["id", "item_id", "n_edits", "item_words", "start_word", "end_word"])
                at += len(offsets) - 1

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, item_id long, n_edits int, item_words int, start_word int, end_word int")
    return out.withColumnRenamed("id", id_col)


def decontaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", p: Params = Params()) -> DataFrame:
    """docs less the rows that hold an item."""
    held = docs.sparkSession.sparkContext.broadcast(_indexes(benchmark, item_col, item_text, p))

    def clean(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        good = np.ones(len(offsets) - 1, bool)
        for index in held.value:
            good[[row for row, *_ in _found(index, raw, offsets)]] = False
        return good

    return filtered_rows(docs, text_col, clean)
