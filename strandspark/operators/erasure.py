"""Redundancy over chunks: XOR groups, single repair, interleaved sparse XOR symbols, peeling and elimination, soliton weights.

Chunks are (archive, idx, payload binary); the XOR aggregate works on longs of seven bytes with bit_xor, so it combines on the
map side and no group is ever collected; only what peeling leaves of symbols that hang together is solved in one task.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .similarity import classes

# Fixed value: the multiplier of a layer's shift.
WEYL = 0x9E3779B1


def chunks(payloads: DataFrame, size: int, key: str = "archive", data: str = "payload") -> DataFrame:
    """(archive, idx, payload, total) of payloads (archive, payload binary). An empty payload is one empty chunk; a null one gives none."""
    n = F.greatest(F.lit(1), F.ceil(F.octet_length(data) / size)).cast("int")
    rows = payloads.filter(F.col(data).isNotNull()).select(F.col(key), F.col(data).alias("_all"), n.alias("total"))
    # all pieces are cut in one step: a row for each of them beside the whole would be handed on with the whole, to a Python step above all
    cut = F.transform(F.array("_all"), lambda whole: F.transform(F.sequence(F.lit(0), F.col("total") - 1), lambda i: F.substring(whole, i * size + 1, F.lit(size))))[0]
    return rows.select(key, "total", F.posexplode(cut).alias("idx", "payload")).select(key, "idx", "payload", "total")


def _words(data: Column, width: int) -> list[Column]:
    """A binary as longs of seven bytes each, padded with zeros at its end. `data`: its hex digits."""
    padded = F.rpad(data, 14 * -(-width // 7), "0")
    return [F.conv(F.substring(padded, 14 * k + 1, 14), 16, 10).cast("long") for k in range(-(-width // 7))]


def _joined(words: list[Column], width: int) -> Column:
    return F.unhex(F.substring(F.concat(*(F.lpad(F.hex(w), 14, "0") for w in words)), 1, 2 * width))


def xor_payloads(rows: DataFrame, keys: list[str], data: str = "payload", width: int = 255) -> DataFrame:
    """(keys, payload): the XOR of the payloads of each key, as one binary of the width, right-padded with zeros. A payload is a few longs, whose bit_xor combines on the map side."""
    hexed = rows.filter(F.octet_length(data) > 0).select(*keys, F.hex(F.substring(F.col(data), 1, width)).alias("_hex"))
    n = -(-width // 7)
    cells = hexed.select(*keys, *(w.alias(f"_w{k}") for k, w in enumerate(_words(F.col("_hex"), width))))
    sums = cells.groupBy(*keys).agg(*(F.bit_xor(f"_w{k}").alias(f"_w{k}") for k in range(n)))
    return sums.select(*keys, _joined([F.col(f"_w{k}") for k in range(n)], width).alias("payload"))


def parity(chunk_rows: DataFrame, group: int, width: int, key: str = "archive", also: tuple[str, ...] = ()) -> DataFrame:
    """(archive, grp, payload): one XOR block for each run of `group` chunks; none for groups of one. also: columns that an archive's chunks share, which its blocks have before the payload."""
    grouped = chunk_rows.withColumn("grp", F.floor(F.col("idx") / max(1, group)).cast("int"))
    return xor_payloads(grouped if group > 1 else grouped.limit(0), [key, "grp", *also], "payload", width)


def repaired(known: DataFrame, parities: DataFrame, totals: DataFrame, group: int, width: int, key: str = "archive", keep=None, found: DataFrame | None = None) -> DataFrame:
    """known (archive, idx, payload) and the chunks that parity restores: those that are alone missing in a group whose parity is known. totals: (archive, total). keep(df, name) stores these chunks, and
    not what is known already. found: known and parities in one table (archive, kind, idx, payload), in which they stand side by side and combine before they are shuffled.

    One aggregate gives each group's XOR with its parity, and the count and sum of its known indexes, from which a lone missing one follows."""
    n = -(-width // 7)
    data = known.select(key, F.floor(F.col("idx") / group).cast("int").alias("grp"), F.col("idx").cast("long").alias("_idx"), F.lit(0).alias("_parity"), F.col("payload"))
    block = parities.select(key, F.col("grp").cast("int").alias("grp"), F.lit(None).cast("long").alias("_idx"), F.lit(1).alias("_parity"), "payload")
    rows = data.unionByName(block)
    if found is not None:
        check = F.col("kind") == "parity"
        rows = found.select(key, F.when(check, F.col("idx")).otherwise(F.floor(F.col("idx") / group)).cast("int").alias("grp"), F.when(~check, F.col("idx")).cast("long").alias("_idx"), check.cast("int").alias("_parity"), "payload")
    hexed = rows.select(key, "grp", "_idx", "_parity", F.hex(F.substring(F.col("payload"), 1, width)).alias("_hex"))
    cells = hexed.select(key, "grp", "_idx", "_parity", *(w.alias(f"_w{k}") for k, w in enumerate(_words(F.col("_hex"), width))))
    sums = cells.groupBy(key, "grp").agg(F.count("_idx").alias("_n"), F.coalesce(F.sum("_idx"), F.lit(0)).alias("_sum"), F.max("_parity").alias("_parity"), *(F.bit_xor(f"_w{k}").alias(f"_w{k}") for k in range(n)))
    first = F.col("grp").cast("long") * group
    size = F.least(F.lit(group).cast("long"), F.col("total") - first)
    lone = sums.filter("_parity = 1").join(totals.select(key, F.col("total").cast("long").alias("total")), key).filter(size - F.col("_n") == 1)
    idx = size * first + (size * (size - 1) / 2).cast("long") - F.col("_sum")
    lone = lone.select(key, idx.cast("int").alias("idx"), _joined([F.col(f"_w{k}") for k in range(n)], width).alias("payload"))
    return known.select(key, "idx", "payload").unionByName(keep(lone, "restored") if keep else lone)


def coprime_multiplier(total: int, layer: int) -> int:
    """The smallest odd number from max(3, 2 layer + 1) on that shares no factor with total; 1 for a single chunk."""
    if total <= 1:
        return 1
    m = max(3, 2 * layer + 1) | 1
    while math.gcd(m, total) != 1:
        m += 2
    return m


def multiplier(total: Column, layer: Column, tries: int = 64) -> Column:
    """coprime_multiplier of columns: total has fewer than `tries` odd factors in a row for any total below 2^63."""
    start = F.greatest(F.lit(3), 2 * layer + 1)
    odd = F.transform(F.sequence(F.lit(0), F.lit(tries - 1)), lambda i: start + 2 * i)
    gcd = lambda a, b: F.aggregate(F.sequence(F.lit(1), F.lit(92)), F.struct(a.cast("long").alias("x"), b.cast("long").alias("y")), lambda s, _: F.struct(F.when(s["y"] == 0, s["x"]).otherwise(s["y"]).alias("x"), F.when(s["y"] == 0, F.lit(0).cast("long")).otherwise(s["x"] % s["y"]).alias("y")))["x"]
    first = lambda some: F.try_element_at(F.filter(some, lambda m: gcd(m, total) == 1), F.lit(1))
    # nearly always one of the first; the others are only tried where it is not
    return F.when(total <= 1, F.lit(1).cast("long")).otherwise(F.coalesce(first(F.slice(odd, 1, 4)), first(odd)).cast("long"))


def _scattered(rows: DataFrame, layers: int, degree: int, first_seed: int) -> DataFrame:
    """rows (total, ...) with a row for each chunk of each interleaved symbol: columns seed and idx in place of total."""
    own = [c for c in rows.columns if c != "total"]
    rows = rows.select(*own, F.col("total").cast("long").alias("total"), F.explode(F.sequence(F.lit(1), F.lit(layers))).alias("layer"))
    rows = rows.withColumn("mult", multiplier(F.col("total"), F.col("layer"))).withColumn("shift", (F.col("layer") * F.lit(WEYL).cast("long")) % F.col("total"))
    rows = rows.withColumn("groups", F.ceil(F.col("total") / degree)).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("total") - 1)).alias("p"))
    seed = first_seed + (F.col("layer") - 1) * F.col("groups") + F.floor(F.col("p") / degree)
    return rows.select(*own, seed.cast("long").alias("seed"), ((F.col("mult") * F.col("p") + F.col("shift")) % F.col("total")).cast("int").alias("idx"))


def interleaved(totals: DataFrame, layers: int, degree: int, first_seed: int = 1, key: str = "archive") -> DataFrame:
    """(archive, seed, idx): the chunks of each interleaved symbol. A layer's symbols cover every chunk once; the layer's affine map scatters its runs."""
    return _scattered(totals.select(key, "total"), layers, degree, first_seed)


def _hashed(*parts: Column) -> Column:
    """60 bits that depend on the parts alone."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 15), 16, 10).cast("long")


def _drawn(rows: DataFrame, count: Column, most: int, first_seed: int | Column, cdf: DataFrame | None) -> DataFrame:
    """rows (total, ...) with a row for each chunk of each of `count` random symbols: columns seed and idx in place of total.

    A symbol depends on (total, seed) alone, so a decoder needs no more. Its chunks are drawn by Floyd's method: for j from total - degree on, a hashed number up to j, or j where that is taken. So they
    differ without rejection, and every set of a size is as likely as any other. A row's draws are one array, smaller than what they draw from, so that a payload beside them is not copied for each."""
    own = [c for c in rows.columns if c != "total"]
    total = F.col("total")
    rows = rows.select(*own, total.cast("long").alias("total"), count.cast("long").alias("_count")).filter("_count > 0 and total > 0").withColumn("_bound", F.least(F.lit(most).cast("long"), total))
    if cdf is not None:
        steps = cdf.groupBy(F.col("k").cast("long").alias("_bound")).agg(F.transform(F.array_sort(F.collect_list(F.struct("degree", "cdf"))), lambda x: x["cdf"]).alias("_steps"))
        rows = rows.join(F.broadcast(steps), "_bound")

    def degree(seed: Column) -> Column:
        bits = _hashed(F.lit("degree"), total, seed)
        # hashed once for all steps: the inner function reads the outer one's variable
        return bits % F.col("_bound") + 1 if cdf is None else F.transform(F.array(bits / F.lit(float(1 << 60))), lambda x: F.size(F.filter("_steps", lambda c: c <= x)) + 1)[0]

    def draw(seed: Column) -> Column:
        def step(taken: Column, j: Column) -> Column:
            t = F.array(_hashed(total, seed, j) % (j + 1))
            return F.concat(taken, F.transform(t, lambda x: F.when(F.array_contains(taken, x), j).otherwise(x)))

        chosen = F.aggregate(F.sequence(total - degree(seed), total - 1), F.array().cast("array<bigint>"), step)
        return F.transform(chosen, lambda i: F.struct(seed.alias("seed"), i.cast("int").alias("idx")))

    start = (F.lit(first_seed) if isinstance(first_seed, int) else first_seed).cast("long")
    seeds = F.sequence(start, start + F.col("_count") - 1)
    # no list is empty; the outer form keeps the optimizer from drawing twice to find that out
    return rows.withColumn("_draws", F.flatten(F.transform(seeds, draw))).select(*own, F.explode_outer("_draws").alias("_draw")).select(*own, "_draw.seed", "_draw.idx")


#: Random symbols of an archive are drawn in ranges of so many seeds, which are dealt to all tasks.
SEEDS = 256


def random_layout(totals: DataFrame, count: Column, most: int = 4, first_seed: int = 1, cdf: DataFrame | None = None, key: str = "archive") -> DataFrame:
    """(archive, seed, idx): the chunks of each of `count` (a column over total) random symbols, of any degree up to `most` with the same chance, or by the weights of cdf, the rows of soliton() for
    every k up to `most` (at most most * most of them, which is what is broadcast). No archive is drawn in one task, nor as one array: there is nothing beside it to be copied."""
    rows = totals.select(key, "total", count.cast("long").alias("_seeds")).filter("_seeds > 0 and total > 0")
    rows = rows.select(key, "total", "_seeds", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("_seeds") - 1, F.lit(0).cast("long")), F.lit(SEEDS).cast("long"))).alias("_first"))
    rows = rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, key, "_first")
    return _drawn(rows.select(key, "total", "_first", "_seeds"), F.least(F.col("_seeds") - F.col("_first"), F.lit(SEEDS)), most, first_seed + F.col("_first"), cdf).select(key, "seed", "idx")


def _cut(payloads: DataFrame, width: int, key: str, data: str) -> DataFrame:
    total = F.greatest(F.lit(1), F.ceil(F.octet_length(data) / width)).cast("long")
    return payloads.filter(F.col(data).isNotNull()).select(key, F.col(data).alias("_all"), total.alias("total"))


def _within(rows: DataFrame, width: int, key: str) -> DataFrame:
    piece = F.substring(F.col("_all"), F.col("idx") * width + 1, F.lit(width))
    return xor_payloads(rows.select(key, "seed", piece.alias("payload")), [key, "seed"], "payload", width)


def interleaved_symbols(payloads: DataFrame, layers: int, degree: int, width: int, first_seed: int = 1, key: str = "archive", data: str = "payload", also: tuple[str, ...] = ()) -> DataFrame:
    """(archive, seed, payload): interleaved symbols of whole payloads (archive, payload). A payload's chunks are cut where it stands, so only symbols, already combined, are shuffled. also: columns of the
    payloads that their symbols have before the payload."""

    @F.pandas_udf("binary")
    def run(values: pd.Series) -> pd.Series:
        return pd.Series([folded(x, layers, degree, width) for x in values], dtype=object)

    made = payloads.filter(F.octet_length(data) > 0).select(F.struct(key, *also).alias("_own"), F.explode(F.array(run(F.col(data)))).alias("_made"))  # a generator, so that nothing above runs it again
    rows = chunks(made, width, "_own", "_made").select("_own.*", (F.col("idx") + F.lit(first_seed).cast("long")).alias("seed"), "payload")
    return xor_payloads(rows, [key, "seed", *also], "payload", width)  # of payloads with one key


def folded(data: bytes, layers: int, degree: int, width: int) -> bytes:
    """The XORs of a payload's interleaved symbols in the order of their seeds, one behind the other."""
    total = -(-len(data) // width)
    rows = np.frombuffer(data.ljust(total * width, b"\0"), np.uint8).reshape(total, width)
    place, starts = np.arange(total), np.arange(0, total, degree)
    made = [np.bitwise_xor.reduceat(rows[(coprime_multiplier(total, k) * place + k * WEYL) % total], starts, axis=0) for k in range(1, layers + 1)]
    return b"".join(x.tobytes() for x in made)


def random_symbols(payloads: DataFrame, redundancy: float, width: int, most: int = 4, first_seed: int = 1, cdf: DataFrame | None = None, key: str = "archive", data: str = "payload") -> DataFrame:
    """(archive, seed, payload): random symbols of whole payloads, as many as symbol_count says; their chunks are those of random_layout."""
    count = symbol_count(F.col("total"), redundancy, most, False)
    return _within(_drawn(_cut(payloads, width, key, data), count, most, first_seed, cdf), width, key)


def symbol_count(total: Column, redundancy: float, degree: int, interleaved_layout: bool) -> Column:
    """Symbols for a number of chunks: whole layers when interleaved, with halves rounded to even, else a share of the chunks."""
    if redundancy <= 0:
        return F.lit(0).cast("long")
    if interleaved_layout:
        return F.greatest(F.lit(1), F.bround(F.lit(redundancy * degree))) .cast("long") * F.ceil(total / degree)
    return F.greatest(F.lit(1).cast("long"), F.ceil(total * redundancy))


def symbols(chunk_rows: DataFrame, indexes: DataFrame, width: int, key: str = "archive") -> DataFrame:
    """(archive, seed, payload): the XOR of each symbol's chunks."""
    return xor_payloads(indexes.join(chunk_rows.select(key, "idx", "payload"), [key, "idx"]).select(key, "seed", "payload"), [key, "seed"], "payload", width)


def solved(rows: list[tuple[list[int], bytes]]) -> dict[int, bytes]:
    """The unknowns that XOR equations (unknowns, value) determine, by Gaussian elimination; those that stay free are left out."""
    names = sorted({i for members, _ in rows for i in members})
    bit = {i: k for k, i in enumerate(names)}
    pivots: dict[int, tuple[int, int]] = {}
    width = max((len(value) for _, value in rows), default=0)
    for members, value in rows:
        mask, v = sum(1 << bit[i] for i in members), int.from_bytes(value.ljust(width, b"\0"), "big")
        while mask and (lead := mask.bit_length() - 1) in pivots:
            mask, v = mask ^ pivots[lead][0], v ^ pivots[lead][1]
        if mask:
            pivots[mask.bit_length() - 1] = mask, v
    out = {}
    for lead in sorted(pivots):  # those below hold their own bit and free ones only
        mask, v = pivots[lead]
        left = mask ^ (1 << lead)
        while left:
            low = left.bit_length() - 1
            left ^= 1 << low
            if low in pivots:
                mask, v = mask ^ pivots[low][0], v ^ pivots[low][1]
        pivots[lead] = mask, v
        if mask == 1 << lead:
            out[names[lead]] = v.to_bytes(width, "big")
    return out


def blocks(unknown: DataFrame, key: str = "archive") -> DataFrame:
    """(archive, seed, block): symbols that lack a common chunk, straight or by others, have one block. Systems of different blocks share no unknown, so each can be solved by itself."""
    nodes = unknown.select(key, "seed", F.xxhash64(key, "idx").alias("id"))
    heads = nodes.groupBy(key, "seed").agg(F.min("id").alias("src"))
    labels = classes(nodes.select("id").distinct(), nodes.join(heads, [key, "seed"]).select("src", F.col("id").alias("dst")))
    return heads.join(labels, F.col("src") == F.col("id")).select(key, "seed", F.col("component").alias("block"))


def eliminated(unknown: DataFrame, values: DataFrame, key: str = "archive") -> DataFrame:
    """(archive, idx, payload) that elimination gives from unknown (archive, seed, idx), the chunks each symbol lacks, and values (archive, seed, payload), the symbols less
    their known chunks. A task solves one block of symbols that hang together; a block's cost is cubic in its own unknowns, not in its archive's."""
    rows = unknown.groupBy(key, "seed").agg(F.collect_list("idx").alias("members")).join(values, [key, "seed"]).join(blocks(unknown, key), [key, "seed"])

    def run(group: pd.DataFrame) -> pd.DataFrame:
        found = solved([([int(i) for i in m], bytes(v)) for m, v in zip(group["members"], group["payload"], strict=True)])
        own = pd.Series([group[key].iloc[0]] * len(found), dtype=object)  # also where nothing is found
        return pd.DataFrame({key: own, "idx": pd.Series(list(found), dtype="int32"), "payload": pd.Series(list(found.values()), dtype=object)})

    return rows.groupBy(key, "block").applyInPandas(run, f"{key} {unknown.schema[key].dataType.simpleString()}, idx int, payload binary")


def peeled(known: DataFrame, indexes: DataFrame, payloads: DataFrame, width: int, keep, key: str = "archive", rounds: int = 8, stored: bool = False) -> DataFrame:
    """known and all chunks that the symbols determine. The first rounds take what symbols with one unknown chunk give; where these go on or stall, elimination finds the
    rest, so no chain is too long. keep(df, name) stores a table durably, which cuts the lineage of each round; stored: known is read from such tables already."""
    known = known.select(key, "idx", "payload") if stored else keep(known.select(key, "idx", "payload"), "known")
    # what is known goes first, so that the symbols are looked up for the few lost chunks alone
    unknown = keep(indexes.join(known.select(key, "idx"), [key, "idx"], "left_anti").join(payloads.select(key, "seed"), [key, "seed"], "left_semi").select(key, "seed", "idx"), "unknown")
    seeds = unknown.select(key, "seed").distinct()
    rest = indexes.join(seeds, [key, "seed"], "left_semi").join(known, [key, "idx"]).select(key, "seed", "payload")
    own = payloads.join(seeds, [key, "seed"], "left_semi").select(key, "seed", "payload")
    values = keep(xor_payloads(rest.unionByName(own), [key, "seed"], "payload", width), "values")
    for _ in range(rounds):
        single = unknown.groupBy(key, "seed").agg(F.count(F.lit(1)).alias("n"), F.min("idx").alias("idx")).filter("n = 1")
        single = single.groupBy(key, "idx").agg(F.min("seed").alias("seed"))  # several symbols of one chunk: the first
        new = keep(values.join(single, [key, "seed"]).select(key, "idx", "payload"), "peeled")
        if new.isEmpty():
            break
        known = known.unionByName(new)  # of tables that stand already: no round writes what it knew before
        taken = unknown.join(new, [key, "idx"]).select(key, "seed", "payload")
        unknown = keep(unknown.join(new.select(key, "idx"), [key, "idx"], "left_anti").select(key, "seed", "idx"), "unknown")
        values = keep(xor_payloads(values.unionByName(taken).join(unknown.select(key, "seed").distinct(), [key, "seed"], "left_semi"), [key, "seed"], "payload", width), "values")
    if unknown.isEmpty():
        return known
    return known.unionByName(keep(eliminated(unknown, values, key), "eliminated"))


def soliton(sizes: DataFrame, c: float = 0.025, delta: float = 0.001, key: str = "k") -> DataFrame:
    """(k, degree, cdf) of the robust soliton distribution for each number of chunks in sizes."""
    k = F.col(key)
    s = F.greatest(c * F.log(k / delta) * F.sqrt(k), F.lit(1e-12))
    rows = sizes.select(key, s.alias("s")).withColumn("m", F.greatest(F.lit(1), F.least(F.floor(k / F.col("s")), k))).select("*", F.explode(F.sequence(F.lit(1).cast("long"), k.cast("long"))).alias("degree"))
    d = F.col("degree")
    rho = F.when(d == 1, 1 / k).otherwise(1 / (d * (d - 1)))
    tau = F.when(d < F.col("m"), F.col("s") / (k * d)).when(d == F.col("m"), F.col("s") / k * F.log(F.col("s") / delta)).otherwise(0.0)
    rows = rows.withColumn("w", F.greatest(F.lit(0.0), rho + tau))
    running = Window.partitionBy(key).orderBy("degree").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(key)
    return rows.select(key, "degree", F.when(d == k, 1.0).otherwise(F.sum("w").over(running) / F.sum("w").over(whole)).alias("cdf"))
