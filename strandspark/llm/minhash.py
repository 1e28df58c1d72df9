"""MinHash near-duplicates: fast similarity sketches, banding, exact verification, connected classes.

Sketch (fast similarity sketching): in round i < t every element falls in a hashed bin and in round t + j every element falls in
bin j, so that each of the t coordinates fills after at most 2t rounds. A coordinate keeps the smallest value of the first
round that reaches it; two sets agree in a coordinate with a probability equal to their Jaccard similarity.

Defined results: a null or wordless text has no shingles and no links; rows with a null id are never linked and are kept;
equal sets are one class without any pair being made; repeated rows of one id give that row as often, and rows of one id with
different texts are linked each by its own text; very long texts are read whole; an empty table gives an empty table; other columns
are left out or passed through, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .runtime import discard, free_name, kept_table, small, text_pieces, weighted_join

U = np.uint64


@dataclass(frozen=True)
class Params:
    """Links are sets with intersection * 100 >= percent * union. A pair at 0.75 shares no band with a probability of (1 - 0.75^rows)^bands, 5e-6 here."""

    shingle: int = 5
    percent: int = 75
    bands: int = 32
    rows: int = 4
    leaders: int = 5
    star_rounds: int = 2
    first_bands: int = 4


def sketch(value: np.ndarray, first: np.ndarray, t: int) -> np.ndarray:
    """Sketches (rows x t) of the sets value[first[r]:first[r+1]]. t: a power of two of at most 128. Empty sets keep the largest value."""
    rows, bits = len(first) - 1, t.bit_length() - 1
    low = U(56)
    out = np.full(rows * t, ~U(0))
    sizes = np.diff(first)
    active = np.flatnonzero(sizes > 0)
    for i in range(2 * t):
        if not len(active):
            break
        n = sizes[active]
        at = np.repeat(first[active] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(int(n.sum()))
        h = W.mix(value[at] ^ W.mix(np.array([i + 1], U) * U(0xD1342543DE82EF95)))
        bin_ = (h >> U(64 - bits)).astype(np.int64) if i < t else np.full(len(h), i - t)
        key = np.repeat(active, n) * t + bin_
        stamp = (U(i) << low) | (h & U((1 << 56) - 1))
        np.minimum.at(out, key, stamp)
        if i < t:
            active = active[(out.reshape(rows, t)[active] == ~U(0)).any(axis=1)]
    return out.reshape(rows, t)


def band_keys(sketches: np.ndarray, p: Params) -> np.ndarray:
    """One 64-bit key for each band of each sketch."""
    parts = sketches.reshape(len(sketches), p.bands, p.rows)
    total = np.broadcast_to(np.arange(1, p.bands + 1, dtype=U) * U(0xA24BAED4963EE407), parts.shape[:2]).copy()
    for k in range(p.rows):
        total = W.mix(total * U(3) + W.mix(parts[:, :, k] + U(k)))
    return total


def _sets(column: pa.Array, p: Params) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for _, _, raw, offsets in text_pieces(column):
        start, end = W.spans(raw, offsets)
        yield W.shingle_sets(W.hashes(raw, start, end, W.LOWER), W.per_row(offsets, start), p.shingle)


def _lists(value: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(value.view(np.int64)))


def sketches(docs: DataFrame, p: Params) -> DataFrame:
    """(id, t, n, d1, d2, bands) for each row of docs (id, t, text); d1, d2: 128 bits that name the set."""

    def run(batches):
        for batch in batches:
            at = 0
            for value, first in _sets(batch.column(2), p):
                rows = len(first) - 1
                n = np.diff(first)
                bands = band_keys(sketch(value, first, p.bands * p.rows), p)[n > 0]
                sums = [np.concatenate((np.zeros(1, U), np.cumsum(W.mix(value + U(c))))) for c in (0x1234567, 0x89ABCDE)]
                d1, d2 = ((s[first[1:]] - s[first[:-1]]).view(np.int64) for s in sums)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(at, rows) for c in (0, 1)), pa.array(n.astype(np.int64)), pa.array(d1), pa.array(d2), _lists(bands.ravel(), np.concatenate(([0], np.cumsum((n > 0) * p.bands))))],
                    names=["id", "t", "n", "d1", "d2", "bands"],
                )
                at += rows

    return docs.select("id", "t", "text").mapInArrow(run, "id long, t long, n long, d1 long, d2 long, bands array<bigint>")


def full_sets(docs: DataFrame, p: Params) -> DataFrame:
    """(id, n, shingles ascending) of docs (id, text)."""

    def run(batches):
        for batch in batches:
            at = 0
            for value, first in _sets(batch.column(1), p):
                rows = len(first) - 1
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, rows), pa.array(np.diff(first).astype(np.int64)), _lists(value, first)], names=["id", "n", "shingles"])
                at += rows

    return docs.select("id", "text").mapInArrow(run, "id long, n long, shingles array<bigint>")


def verified(pairs: DataFrame, sets: DataFrame, p: Params) -> DataFrame:
    """Those pairs (a, b) whose full sets reach the similarity."""

    def run(batches):
        for batch in batches:
            keep = []
            left, right = batch.column(2), batch.column(3)
            lo, ro = left.offsets.to_numpy(), right.offsets.to_numpy()
            lv, rv = left.values.to_numpy().view(U), right.values.to_numpy().view(U)
            for k in range(batch.num_rows):
                x, y = lv[lo[k] : lo[k + 1]], rv[ro[k] : ro[k + 1]]
                if len(x) > len(y):
                    x, y = y, x
                if 100 * len(x) < p.percent * len(y):
                    keep.append(False)
                    continue
                common = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                keep.append(100 * common >= p.percent * (len(x) + len(y) - common))
            out = batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))
            if out.num_rows:
                yield out

    near = (F.col("na") * 100 >= F.col("nb") * p.percent) & (F.col("nb") * 100 >= F.col("na") * p.percent)
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("shingles").alias("sa")), "a")
    both = both.join(sets.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("shingles").alias("sb")), "b").filter(near)
    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(id, label): the smallest id of the connected class of each id in edges (a, b). Each round contracts every id to the smallest of its neighbours' smallest."""
    edges = kept_table(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = edges.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("label", F.col("id"))
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("to"))
        step = kept_table(step, "step")
        jump = kept_table(step.join(step.select(F.col("v").alias("to"), F.col("to").alias("far")), "to", "left").select("v", F.coalesce("far", "to").alias("to")), "jump")
        labels = kept_table(labels.join(jump.select(F.col("v").alias("label"), "to"), "label", "left").select("id", F.coalesce("to", "label").alias("label")), "labels")
        smaller = edges.join(jump.select(F.col("v").alias("a"), F.col("to").alias("ta")), "a").join(jump.select(F.col("v").alias("b"), F.col("to").alias("tb")), "b")
        following = kept_table(smaller.filter("ta <> tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), "edges")
        for x in (step, edges):
            discard(x)
        edges = following
    return labels


def _star(members: DataFrame, p: Params, turn: int) -> DataFrame:
    """members (key, id, label, ...) with size, the number of their key's members, and heads, its leaders: in each of p.leaders hashed parts of a key, the smallest id under an exclusive-or with a
    constant, and its label."""
    flip = F.lit(int(W.mix(np.array([turn], U))[0] >> U(1)) if turn else 0)
    part = F.pmod(F.xxhash64("id", F.lit(turn)), F.lit(p.leaders))
    heads = members.groupBy("key", part.alias("part")).agg(F.min(F.struct(F.col("id").bitwiseXOR(flip).alias("x"), "label")).alias("head"), F.count(F.lit(1)).alias("size"))
    leader = F.struct(F.col("head.x").bitwiseXOR(flip).alias("id"), F.col("head.label").alias("label"))
    heads = heads.groupBy("key").agg(F.collect_list(leader).alias("heads"), F.sum("size").alias("size")).filter("size > 1")
    return weighted_join(members, kept_table(heads, "heads"), ["key"], "size")


def _pairs(starred: DataFrame) -> DataFrame:
    """Pairs of the members and their key's leaders of another label."""
    both = starred.select("id", "label", F.explode("heads").alias("head")).filter("label <> head.label").select("id", F.col("head.id").alias("head"))
    return both.select(F.least("id", "head").alias("a"), F.greatest("id", "head").alias("b")).distinct()


def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, t, text): t tells the texts of one id apart."""
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col)).alias("t"), F.col(text_col).alias("text"))


def _texts(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, text): the text of each of nodes (id, rep, t, m), once. Only the nodes whose row occurs m > 1 times need their copies removed."""
    own = docs.join(small(nodes.select("id", F.col("rep").alias("_rep"), F.col("t").alias("_t"), "m").withColumnRenamed("id", "_node")), (docs["id"] == F.col("_rep")) & (docs["t"] == F.col("_t")))
    own = own.select(F.col("_node").alias("id"), "text", "m")
    if nodes.filter("m > 1").isEmpty():
        return own.select("id", "text")
    return own.filter("m = 1").select("id", "text").unionByName(own.filter("m > 1").groupBy("id").agg(F.min("text").alias("text")))


def _labelled(docs: DataFrame, p: Params) -> DataFrame:
    """(id, t, n, component) for each row of docs (id, t, text).

    Equal sets are collapsed by a digest into nodes with numbers of their own. The members of the first bands' buckets are compared
    with a few leaders, a number linear in the members, which joins most of what is one class. Then, over all bands, only members
    outside a bucket's largest class are compared with leaders of other classes, and at last with all others that share one of
    their rarest shingles, as any two linked sets do; so no link that a band shows is lost, and the members of one class are never
    compared pair by pair.
    """
    table = kept_table(sketches(docs, p), "sketches")
    rows = table.filter("n > 0 and id is not null").groupBy("d1", "d2", "id", "t").agg(F.count(F.lit(1)).alias("m"))
    sets_ = rows.groupBy("d1", "d2").agg(F.min(F.struct("id", "t", "m")).alias("x"), F.sum("m").alias("c"))
    nodes = kept_table(sets_.select("d1", "d2", F.col("x.id").alias("rep"), F.col("x.t").alias("t"), F.col("x.m").alias("m"), "c").withColumn("id", F.monotonically_increasing_id()), "nodes")
    own = table.select(F.col("id").alias("rep"), "t", "d1", "d2", "n", "bands").join(nodes.select("id", "rep", "t", "d1", "d2", "m"), ["rep", "t", "d1", "d2"])
    once = own.filter("m = 1").select("id", "n", "bands")
    reps = kept_table(once if nodes.filter("m > 1").isEmpty() else once.unionByName(own.filter("m > 1").groupBy("id").agg(F.min("n").alias("n"), F.min("bands").alias("bands"))), "reps")
    keys = reps.select("id", F.posexplode("bands").alias("band", "key"))
    sizes = kept_table(keys.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "keys")
    members = kept_table(weighted_join(keys, sizes, ["key"], "size").select("key", "id", "band"), "members")
    wanted = members.select("id").distinct()
    sets = kept_table(full_sets(_texts(docs, kept_table(nodes.join(wanted, "id", "left_semi").select("id", "rep", "t", "m"), "wanted")), p), "sets")
    # a few bands join most of what is one class; all bands are then looked at for what is still apart
    pairs = kept_table(_pairs(_star(members.filter(F.col("band") < p.first_bands).withColumn("label", F.col("id")), p, 0)), "pairs")
    edges = kept_table(verified(pairs, sets, p), "links")
    labels = components(edges)
    for turn in range(1, p.star_rounds + 2):
        unsettled = _unsettled(members, labels)
        if unsettled is None:
            break
        # other leaders first, as a large class may still be in pieces; at last all pairs that a rare shingle shows
        more = _pairs(_star(unsettled, p, turn).filter("todo")) if turn <= p.star_rounds else _shared(_rare(unsettled, sets, p), p)
        more = kept_table(more.join(pairs, ["a", "b"], "left_anti"), "pairs")
        found = kept_table(verified(more, sets, p), "links")
        pairs, edges = pairs.unionByName(more), edges.unionByName(found)
        if not found.isEmpty():
            labels = components(edges)
    named = nodes.join(labels.withColumnRenamed("label", "head"), "id", "left").select("d1", "d2", "rep", "c", F.coalesce("head", "id").alias("head"))
    least = kept_table(named.groupBy("head").agg(F.min("rep").alias("component"), F.count(F.lit(1)).alias("size")), "least")
    classes = kept_table(weighted_join(named, least, ["head"], "size").filter("c > 1 or component <> rep").select("d1", "d2", "component", "c"), "classes")
    both = weighted_join(table.select("id", "t", "n", "d1", "d2"), classes, ["d1", "d2"], "c", "left", nodes.agg(F.sum("c")).first()[0] or 0)
    linked = (F.col("n") > 0) & F.col("id").isNotNull()
    return both.select("id", "t", "n", F.when(linked, F.coalesce("component", "id")).otherwise(F.col("id")).alias("component"))


def _stays(id_: Column, component: Column) -> Column:
    return F.coalesce(id_ == component, F.lit(True))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", p: Params = Params()) -> DataFrame:
    """(id, n_shingles, component_id, kept) for each row of docs."""
    out = _labelled(_named(docs, id_col, text_col), p)
    out = out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
    return out.withColumn("kept", _stays(F.col(id_col), F.col("component_id")))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", p: Params = Params()) -> DataFrame:
    """docs less the rows that near_duplicates does not keep. A row is known by its id and its text's hash, so rows of one id with different texts have each their own fate."""
    out = _labelled(_named(docs, id_col, text_col), p)
    id_, t = free_name(docs, "_id"), free_name(docs, "_t")
    gone = kept_table(out.filter(~_stays(F.col("id"), F.col("component"))).select(F.col("id").alias(id_), F.col("t").alias(t)).distinct(), "copies")
    return docs.join(small(gone), (docs[id_col].cast("long") == F.col(id_)) & (F.xxhash64(docs[text_col]) == F.col(t)), "left_anti")


def _unsettled(members: DataFrame, labels: DataFrame) -> DataFrame | None:
    """(key, id, label, todo) of the members of those keys that still hold several classes; todo: outside a key's largest class."""
    now = members.join(labels, "id", "left").select("key", "id", F.coalesce("label", "id").alias("label"))
    sizes = now.groupBy("key", "label").agg(F.count(F.lit(1)).alias("c"))
    largest = sizes.groupBy("key").agg(F.max_by("label", "c").alias("main"), F.count(F.lit(1)).alias("classes"), F.sum("c").alias("members")).filter("classes > 1")
    largest = kept_table(largest, "largest")
    now = kept_table(weighted_join(now, largest, ["key"], "members").select("key", "id", "label", (F.col("label") != F.col("main")).alias("todo")), "open")
    return None if now.isEmpty() else now


def _rare(unsettled: DataFrame, sets: DataFrame, p: Params) -> DataFrame:
    """Rows (h, id, label, n, todo, nth) of the unsettled members: h is one of the member's shingles, nth its place by rareness among these members. Two sets that reach
    the similarity share one of their rarest shingles, so only these rows are kept, and of them only shingles that two members have."""
    now = unsettled.groupBy("id", "label").agg(F.max("todo").alias("todo"))
    each = sets.join(now, "id").select("id", "label", "n", "todo", F.explode("shingles").alias("h"))
    common = each.groupBy("h").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    each = each.join(common, "h", "left").withColumn("nth", F.row_number().over(Window.partitionBy("id").orderBy(F.coalesce("c", F.lit(1)), "h")))
    return kept_table(each.filter(F.col("c").isNotNull() & (F.col("nth") <= F.col("n") - _ceil(p.percent * F.col("n"), 100) + 1)).select("h", "id", "label", "n", "todo", "nth"), "rare")


def _ceil(x: Column, by: int) -> Column:
    return F.ceil(x / by).cast("long")


def _shared(open_: DataFrame, p: Params) -> DataFrame:
    """Pairs (a, b) of different classes, one of them todo, with a common shingle among the rarest of both, as many of each as their sizes require."""
    other = open_.select("h", *(F.col(c).alias(f"{c}2") for c in ("id", "label", "n", "nth")))
    both = open_.filter("todo").join(other, "h")
    least = _ceil(p.percent * (F.col("n") + F.col("n2")), 100 + p.percent)
    rare = (F.col("nth") <= F.col("n") - least + 1) & (F.col("nth2") <= F.col("n2") - least + 1)
    both = both.filter((F.col("label") != F.col("label2")) & rare)
    return both.select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b")).distinct()
