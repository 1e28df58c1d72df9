"""Best-fit packing by length patterns and non-negative least squares.

Only the histogram of lengths, at most LIMIT numbers, reaches the driver. Patterns of one to three length classes that fill a
sequence are enumerated; non-negative least squares fits how often each is repeated so that the patterns' members make up the
histogram; the counts are rounded, exact lengths are chosen so that sequences come out full, and the residual lengths are packed
by best fit decreasing, into the room that patterns leave and then into new sequences, again on counts alone. Pieces take their places by rank within their length: ranks are counted within
parts of a length and shifted by prefix sums, so that no task holds a whole length.

Defined results: other columns of docs are left out, so their names don't matter; a null text is its end id alone; longer documents are cut into pieces of LIMIT ids, whose last may be shorter; repeated rows
are packed as often; a null id is kept; empty input gives no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import kept_table, small
from .tokens import encoded, vocabulary

LIMIT = 2048
#: Length classes of the patterns; lengths within a class are filled up by the residual's best fit.
CLASSES = 64
#: Lengths up to this part of a sequence are left to the residual, which fills gaps with them.
SMALL = 16
#: About so many pieces of one length are ranked in one window.
RANKED = 50_000


def nnls(a: np.ndarray, b: np.ndarray, most: int = 400) -> np.ndarray:
    """min |a x - b|, x >= 0, by active sets."""
    target = a.T @ b
    x, on = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    edge = 1e-9 * max(1.0, float(np.abs(target).max(initial=0)))
    for _ in range(most):
        slope = np.where(on, -np.inf, target - a.T @ (a @ x))
        k = int(slope.argmax())
        if slope[k] <= edge:
            break
        on[k] = True
        while True:
            names = np.flatnonzero(on)
            trial = np.linalg.lstsq(a[:, names], b, rcond=None)[0]
            if (trial > 0).all():
                x[:] = 0
                x[names] = trial
                break
            old = x[names]
            down = trial <= 0
            reach = (old[down] / np.maximum(old[down] - trial[down], 1e-300)).min()
            x[names] = old + reach * (trial - old)
            gone = names[(x[names] <= 1e-12) & down]
            if not len(gone):
                gone = names[down][:1]
            x[gone] = 0
            on[gone] = False
    return x


def patterns(classes: int) -> list[tuple[int, ...]]:
    """Class tuples, descending, that fill a sequence: class k stands for lengths above (k - 1) and up to k shares of it. One member fills it alone or nearly."""
    out: list[tuple[int, ...]] = [(classes,), (classes - 1,)]
    out += [(a, classes - a) for a in range((classes + 1) // 2, classes)]
    out += [(a, b, classes - a - b) for a in range(1, classes - 1) for b in range(1, a + 1) if 1 <= classes - a - b <= b]
    return out


def plan(histogram: dict[int, int], limit: int = LIMIT, classes: int = CLASSES) -> list[tuple[tuple[int, ...], int]]:
    """[(lengths of a sequence, repeats)] that use every length of the histogram as often as it occurs: by patterns, or by best fit alone where that takes fewer sequences."""
    fitted, plain = _by_patterns(histogram, limit, classes), _best_fit(Counter(), {n: c for n, c in histogram.items() if c > 0}, limit)
    return min(fitted, plain, key=lambda p: sum(c for _, c in p))


def _by_patterns(histogram: dict[int, int], limit: int, classes: int) -> list[tuple[tuple[int, ...], int]]:
    left = {n: c for n, c in histogram.items() if c > 0}
    made: Counter[tuple[int, ...]] = Counter()
    if limit in left:
        made[(limit,)] = left.pop(limit)
    classes = min(classes, limit)
    of = lambda n: -(-n * classes // limit)
    counts = np.zeros(classes + 1)
    for n, c in left.items():
        if n > limit // SMALL:
            counts[of(n)] += c
    names = patterns(classes)
    matrix = np.zeros((classes, len(names)))
    for j, p in enumerate(names):
        for k in p:
            matrix[k - 1, j] += 1
    stock, kept_back = np.zeros(limit + 1, np.int64), {}
    for n, c in left.items():
        if n > limit // SMALL:
            stock[n] = c
        else:
            kept_back[n] = c
    scale = max(1.0, counts.max())
    fitted = nnls(matrix, counts[1:] / scale) * scale
    for j in np.argsort(-fitted, kind="stable"):
        repeats = round(float(fitted[j]))
        while repeats > 0:
            lengths = _members(names[j], stock, limit, classes)
            if lengths is None:
                break
            need = Counter(lengths)
            take = min(repeats, *(int(stock[n]) // m for n, m in need.items()))
            for n, m in need.items():
                stock[n] -= m * take
            made[lengths] += take
            repeats -= take
    return _best_fit(made, kept_back | {int(n): int(stock[n]) for n in np.flatnonzero(stock)}, limit)


def _members(pattern: tuple[int, ...], stock: np.ndarray, limit: int, classes: int) -> tuple[int, ...] | None:
    """Lengths in stock for one pattern, the fullest that there are: all but the last member from their classes, the last the longest that the others leave room
    for. Of equally full ones that which can be repeated most often."""

    def of(k: int) -> np.ndarray:
        low = (k - 1) * limit // classes
        return low + 1 + np.flatnonzero(stock[low + 1 : k * limit // classes + 1])

    if len(pattern) == 1:
        own = of(pattern[0])
        return (int(own[-1]),) if len(own) else None
    first = of(pattern[0])[:, None]
    second = of(pattern[1])[None, :] if len(pattern) == 3 else np.zeros((1, 1), np.int64)
    held = np.broadcast_to(np.where((first == second) & (stock[first] < 2), 0, np.minimum(stock[first], np.where(second > 0, stock[second], stock[first]))), (first.shape[0], second.shape[1]))
    room = limit - first - second
    longest = np.maximum.accumulate(np.where(stock > 0, np.arange(limit + 1), 0))
    last = longest[np.maximum(room, 0)]
    again = (last == first).astype(np.int64) + (last == second) + 1
    good = (held > 0) & (room > 0) & (last > 0) & (stock[last] >= again)
    if not good.any():
        return None
    waste = np.where(good, room - last, limit)
    best = np.where(waste == waste.min(), np.minimum(held, stock[last] // again), -1)
    i, j = np.unravel_index(int(best.argmax()), best.shape)
    return tuple(int(x) for x in (first[i, 0], second[0, j], last[i, j]) if x)


def _best_fit(made: Counter, rest: dict[int, int], limit: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit decreasing on counts: each length, longest first, goes to the sequences with the least room that holds it."""
    room: dict[int, Counter] = defaultdict(Counter)
    for p, c in made.items():
        room[limit - sum(p)][p] += c
    free = np.zeros(limit + 1, bool)
    for r, held in room.items():
        free[r] = bool(held)
    for n in sorted(rest, reverse=True):
        c = rest[n]
        while c:
            fits = np.flatnonzero(free[n:])
            if len(fits):
                r = n + int(fits[0])
                p, there = next(iter(room[r].items()))
                used = min(c, there)
                if used == there:
                    del room[r][p]
                    free[r] = bool(room[r])
                else:
                    room[r][p] -= used
                room[r - n][(*p, n)] += used
                free[r - n] = True
                c -= used
            else:
                per = limit // n
                if c >= per:
                    room[limit - per * n][(n,) * per] += c // per
                    free[limit - per * n] = True
                if c % per:
                    room[limit - c % per * n][(n,) * (c % per)] += 1
                    free[limit - c % per * n] = True
                c = 0
    return [(p, c) for held in room.values() for p, c in held.items() if c]


def pieces(docs: DataFrame, tokenizer: str | None = None, end_id: int = 0, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]): each document's ids with the end id, cut at the limit."""
    tokenizer = tokenizer or vocabulary()
    fields = "id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids

    def run(batches):
        for batch in batches:
            for first, end, ids, bounds in encoded(batch.column(1), tokenizer, end_id):
                n = -(-np.diff(bounds) // limit)
                row = np.repeat(np.arange(end - first), n)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * limit
                length = np.minimum(limit, np.diff(bounds)[row] - start)
                at = bounds[row] + start
                wide = ids.astype("<u4")
                columns = {"id": batch.column(0).slice(first, end - first).take(pa.array(row)), "piece": pa.array(piece.astype(np.int32)), "start": pa.array(start), "length": pa.array(length)}
                columns["ids_crc32"] = pa.array([zlib.crc32(wide[a : a + m]) for a, m in zip(at.tolist(), length.tolist(), strict=True)], pa.int64())
                if with_ids:
                    columns["ids"] = pa.array([wide[a : a + m].astype(np.int32) for a, m in zip(at.tolist(), length.tolist(), strict=True)], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(columns)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, fields)


def placed(table: DataFrame, limit: int = LIMIT) -> DataFrame:
    """A kept table of pieces, with a number of each row in `row`, with sequence_id and offset. A length is ranked in as many parts as its count asks for; the parts' counts are at most
    `limit` and one for every RANKED pieces."""
    lengths = kept_table(table.groupBy("length").agg(F.count(F.lit(1)).alias("c")), "histogram")
    histogram = {r["length"]: r["c"] for r in lengths.collect()}  # at most `limit` rows
    parts = F.broadcast(lengths.select("length", F.ceil(F.col("c") / RANKED).alias("parts")))
    salted = table.join(parts, "length").withColumn("salt", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int")).drop("parts")
    counts = kept_table(salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("c")), "lengths")
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.withColumn("base", F.coalesce(F.sum("c").over(before), F.lit(0))).select("length", "salt", "base")
    own = Window.partitionBy("length", "salt").orderBy("id", "piece", "ids_crc32", "row")
    ranked = salted.withColumn("nth", F.row_number().over(own) - 1).join(small(base), ["length", "salt"])
    ranked = ranked.withColumn("nth", F.col("nth") + F.col("base")).drop("base", "salt", "row")
    places = _places(plan(histogram, limit))
    order = {n: k for k, n in enumerate(places)}
    tables = list(places.values())

    def run(batches):
        for batch in batches:
            length, nth = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "nth"))
            sequence, offset = np.empty(len(nth), np.int64), np.empty(len(nth), np.int64)
            for n in np.unique(length).tolist():
                mine = length == n
                begin, first, at = tables[order[n]]
                k = np.searchsorted(begin, nth[mine], "right") - 1
                sequence[mine], offset[mine] = first[k] + nth[mine] - begin[k], at[k]
            rest = [c for c in batch.schema.names if c != "nth"]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in rest), pa.array(sequence), pa.array(offset)], names=[*rest, "sequence_id", "offset"])

    rest = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema if f.name != "nth")
    return ranked.mapInArrow(run, f"{rest}, sequence_id long, offset long")


def _places(rows: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: the first rank of each stretch of its pieces, that stretch's first sequence, and the offset in it."""
    out: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    used: Counter[int] = Counter()
    sequence = 0
    for lengths, repeats in sorted(rows, reverse=True):
        at = 0
        for n in lengths:
            out[n].append((used[n], sequence, at))
            used[n] += repeats
            at += n
        sequence += repeats
    return {n: tuple(np.array(x, np.int64) for x in zip(*v, strict=True)) for n, v in out.items()}


def packed(docs: DataFrame, tokenizer: str | None = None, end_id: int = 0, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset[, ids]) of every piece."""
    table = kept_table(pieces(docs, tokenizer, end_id, limit, id_col, text_col, with_ids).withColumn("row", F.monotonically_increasing_id()), "pieces")
    return placed(table, limit).withColumnRenamed("id", id_col)


def sequences(placed_rows: DataFrame) -> DataFrame:
    """(sequence_id, ids): the packed sequences themselves, from rows with ids; a sequence has at most the limit's ids."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return placed_rows.groupBy("sequence_id").agg(ordered.alias("x")).select("sequence_id", F.flatten(F.col("x.ids")).alias("ids"))
