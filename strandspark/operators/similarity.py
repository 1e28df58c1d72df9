"""Similarity joins over strands: q-gram postings, segment candidates, edges, connected classes, medoids, column votes, nearest references, anchors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from ..functions import align, dna, near
from ..plans.inputs import spread
from ..plans.store import kept


@F.pandas_udf(IntegerType())
def edit_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """Levenshtein distance of two columns without nulls. Unlike Spark's, its time grows with the distance, not with the product of the lengths."""
    return pd.Series([align.distance(x, y) for x, y in zip(a, b, strict=True)], dtype="int32")


def postings(reads: DataFrame, q: int) -> DataFrame:
    """(id, gram, n): how often each q-gram occurs in each strand of reads (id, seq)."""
    return reads.select("id", F.explode(dna.qgrams(F.col("seq"), q)).alias("gram")).groupBy("id", "gram").agg(F.count(F.lit(1)).cast("int").alias("n"))


def edits_allowed(length: Column, threshold: float) -> Column:
    return F.floor((1 - threshold) * length + 1e-12).cast("int")


#: Lengths within this ratio share blocks.
CLASS_RATIO = 1.1
#: A block of strands has about so many bases, or one longer strand; small sets are cut into some SHARES blocks.
BLOCK_BASES, SHARES = 3 << 20, 16


def blocks(heads: DataFrame, threshold: float) -> DataFrame:
    """(block, low, high, reach, strands), stored: heads (id, seq distinct) without empty ones in blocks of like lengths, dealt by hash within a class of lengths. low and high: the lengths in it; reach: the
    least length that is near the shortest; strands: an array of (id, seq). Only the classes' sizes (less than 250 up to 10^9 bases) reach the driver."""
    size = F.length("seq")
    rows = heads.select("id", "seq", size.alias("size"), F.floor(F.log(size) / F.log(F.lit(CLASS_RATIO)) + 1e-9).cast("int").alias("kind")).filter("size > 0")
    bases = {r["kind"]: r["n"] for r in rows.groupBy("kind").agg(F.sum("size").alias("n")).collect()} or {0: 1}
    block = min(BLOCK_BASES, max(1 << 16, sum(bases.values()) // SHARES))
    parts = {k: -(-n // block) for k, n in sorted(bases.items())}
    first, at = {}, 0
    for k, n in parts.items():
        first[k], at = at, at + n
    of = lambda counts: F.element_at(F.create_map(*(F.lit(v) for x in counts.items() for v in x)), F.col("kind"))
    tasks = min(10_000, max(heads.sparkSession.sparkContext.defaultParallelism, at))
    dealt = rows.select((of(first) + F.pmod(F.xxhash64("seq"), of(parts))).cast("int").alias("block"), "size", "id", "seq").repartition(tasks, "block")
    made = dealt.groupBy("block").agg(F.min("size").alias("low"), F.max("size").alias("high"), F.collect_list(F.struct("id", "seq")).alias("strands"))
    return kept(made.select("block", "low", "high", (F.col("low") - edits_allowed(F.col("low"), threshold)).alias("reach"), "strands"), "blocks")


def compared(heads: DataFrame, threshold: float) -> DataFrame:
    """(src, dst, size, distance) of the pairs of heads (id, seq distinct) that a segment and its counts of bases show, each once: size is the longer length, the distance -1 beyond the threshold. Every
    pair within the threshold is among them.

    With k edits or fewer, k + 1 segments of the longer strand and P(i) edits before segment i, take the first i with P(i + 1) <= i: segment i has no edit, i edits lie before it and at most k - i behind.
    So it stands in the shorter strand within i places of its own place, counted from the start, and within k - i places counted from the end.

    Strands are stored once, in blocks. Each block meets those of near enough lengths by a cartesian product, which reads the dealt and the stored blocks again, so segments, places and copies of strands
    are neither rows nor files: the disk holds each strand a few times, whatever the number of pairs of blocks."""
    rows = blocks(heads, threshold)
    x = rows.select(F.col("block").alias("x"), F.col("low").alias("x_low"), F.col("high").alias("x_high"), F.col("strands").alias("xs"))
    x = x.repartition(min(10_000, max(2 * heads.sparkSession.sparkContext.defaultParallelism, rows.count() // 8)), "x")  # files stand by their sizes, so that blocks of like lengths would meet in one task
    y = rows.select(F.col("high").alias("y_high"), "reach", F.col("strands").alias("ys"))
    both = x.hint("shuffle_replicate_nl").join(y, (F.col("x_low") <= F.col("y_high")) & (F.col("x_high") >= F.col("reach"))).select("x", "xs", "ys")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, left, own = None, None, None
        for batch in batches:
            for r in range(batch.num_rows):
                if (x := batch.column(0)[r].as_py()) != last:  # a block meets its others one after the other
                    last, own = x, batch.column(1)[r].values
                    left = near.Block(own.field(1).to_pylist())
                other = batch.column(2)[r].values
                right = near.Block(other.field(1).to_pylist())
                i, j, d = np.array(near.near(left, right, threshold), np.int64).reshape(-1, 3).T
                yield pa.RecordBatch.from_arrays([own.field(0).take(pa.array(i)), other.field(0).take(pa.array(j)), pa.array(right.size[j], pa.int32()), pa.array(d, pa.int32())], ["x", "y", "size", "distance"])

    kind = heads.schema["id"].dataType.simpleString()
    return both.mapInArrow(run, f"x {kind}, y {kind}, size int, distance int").select(F.least("x", "y").alias("src"), F.greatest("x", "y").alias("dst"), "size", "distance")


def near_pairs(reads: DataFrame, threshold: float = 0.9, observed: Observation | None = None, stored: bool = False) -> DataFrame:
    """(src, dst, weight, distance) of all pairs src < dst of reads (id, seq) whose similarity reaches the threshold (above 0): distinct strands as their first ids, and each further copy with its first.

    The filters lose nothing: a segment in its place, then counts of bases (which no edit changes by more than one, a substitution by one up and one down), then short pieces of which most stay unchanged,
    then the edit distance up to what the threshold allows. observed counts the pairs compared and the edges among distinct strands while they are made. stored: reads are a stored table, which is read as often as needed."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold is above 0 and at most 1")
    reads = reads.select("id", "seq") if stored else kept(reads.select("id", "seq"), "reads")  # read for the heads and for their copies
    heads = kept(reads.groupBy("seq").agg(F.min("id").alias("id")), "heads")
    pairs = compared(heads, threshold)
    weight = 1 - F.col("distance") / F.col("size")
    good = (F.col("distance") >= 0) & (weight >= threshold)
    if observed is not None:
        pairs = pairs.observe(observed, F.count(F.lit(1)).alias("compared"), F.count_if(good).alias("edges"))
    links = pairs.filter(good).select("src", "dst", weight.alias("weight"), "distance")
    sign = F.sha2("seq", 256).alias("sign")  # in place of the strand
    equal = reads.select("id", sign).join(heads.select(F.col("id").alias("head"), sign).hint("merge"), "sign").filter("id <> head").select(F.col("head").alias("src"), F.col("id").alias("dst"), F.lit(1.0).alias("weight"), F.lit(0).alias("distance"))
    return links.unionByName(equal)


def edges(reads: DataFrame, threshold: float = 0.9, observed: Observation | None = None, stored: bool = False) -> DataFrame:
    """(src, dst, weight) of near_pairs."""
    return near_pairs(reads, threshold, observed, stored).select("src", "dst", "weight")


def classes(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(id, component): the smallest id of each node's connected class. Every round points each label at the smallest label around it and then
    jumps over one step, so that long chains halve."""
    links = kept(links.filter("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct(), "links")
    labels = nodes.select("id", F.col("id").alias("component"))
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("to"))
        far = near.select(F.col("v").alias("to"), F.col("to").alias("far"))
        step = kept(near.join(far, "to", "left").select("v", F.coalesce("far", "to").alias("to")), "step")
        labels = kept(labels.join(step.withColumnRenamed("v", "component"), "component", "left").select("id", F.coalesce("to", "component").alias("component")), "labels")
        moved = links.join(step.select(F.col("v").alias("a"), F.col("to").alias("x")), "a").join(step.select(F.col("v").alias("b"), F.col("to").alias("y")), "b")
        links = kept(moved.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
    return labels


def graph_report(reads: DataFrame, links: DataFrame, labels: DataFrame) -> DataFrame:
    """(nodes, distinct_strands, edges, components, singletons, largest): figures of a similarity graph as one row, each from an aggregate."""
    sizes = labels.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    parts = [
        reads.agg(F.count(F.lit(1)).alias("nodes"), F.count_distinct("seq").alias("distinct_strands")),
        links.agg(F.count(F.lit(1)).alias("edges")),
        sizes.agg(F.count(F.lit(1)).alias("components"), F.count_if(F.col("n") == 1).alias("singletons"), F.max("n").alias("largest")),
    ]
    return parts[0].join(parts[1]).join(parts[2])


#: A task compares two blocks of so many bases of one cluster at most, or counts the votes of reads of so many bases.
CLUSTER_BASES, VOTE_BASES = 1 << 18, 4 << 20


def _tasks(rows: DataFrame) -> int:
    """Tasks for steps whose time is in their pairs, not in their bytes, by which Spark would join them into one or two."""
    return 4 * rows.sparkSession.sparkContext.defaultParallelism


def _dealt(counts: DataFrame, bases: int) -> DataFrame:
    """counts (cluster, seq, ...) of clusters with two or more rows, with n, the number of these, that of their cluster's blocks of some `bases` each, and that of a row's block, dealt by hash."""
    blocks = counts.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.ceil(F.sum(F.length("seq") + 1) / bases).cast("int").alias("blocks")).filter("n > 1")
    return counts.join(blocks, "cluster").withColumn("block", F.pmod(F.xxhash64("seq"), F.col("blocks")).cast("int"))


def distinct_reads(members: DataFrame) -> DataFrame:
    """(read, cluster, seq, freq), stored: each distinct read of a cluster (cluster, seq), numbered."""
    counts = members.groupBy("cluster", "seq").agg(F.count(F.lit(1)).alias("freq"))
    return kept(counts.select(F.monotonically_increasing_id().alias("read"), "cluster", "seq", "freq"), "distinct")


def costs(members: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """(cluster, seq, freq, cost): each distinct read of a cluster (cluster, seq) and its edit distance to all reads. Quadratic in a cluster's distinct reads, as the medoid is, but each pair is compared once.

    Clusters of up to align.LANES distinct reads are compared pair by pair. Larger ones are dealt into blocks, each pair of which meets in one task that gives a sum for each read, so that their pairs are
    never rows. counts: distinct_reads(members), where they stand already."""
    counts = distinct_reads(members) if counts is None else counts
    rows = kept(_dealt(counts.filter("cluster is not null and seq is not null"), CLUSTER_BASES), "dealt")
    few = rows.filter(F.col("n") <= align.LANES).select("cluster", "read", "seq", "freq").repartition(_tasks(members), "cluster")
    other = few.select("cluster", F.col("read").alias("other_read"), F.col("seq").alias("other"), F.col("freq").alias("other_freq"))
    pairs = few.join(other, "cluster").filter("seq < other").withColumn("d", edit_distance("seq", "other"))
    sides = F.array(F.struct("read", (F.col("d") * F.col("other_freq")).alias("part")), F.struct(F.col("other_read").alias("read"), (F.col("d") * F.col("freq")).alias("part")))
    parts = pairs.select(F.explode(sides).alias("x")).select("x.*")

    tiles = rows.filter(F.col("n") > align.LANES).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = tiles.select("cluster", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "read", "seq", "freq").repartition(_tasks(members), "cluster", "lo", "hi")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        side = None if group["lo"].iloc[0] == group["hi"].iloc[0] else (group["block"] == group["hi"]).to_numpy().astype(int)
        return pd.DataFrame({"read": group["read"], "part": align.costs(group["seq"].tolist(), group["freq"].to_numpy(), side)})

    parts = parts.unionByName(tiles.groupBy("cluster", "lo", "hi").applyInPandas(run, "read long, part long")).groupBy("read").agg(F.sum("part").alias("cost"))
    return counts.join(parts, "read", "left").select("cluster", "seq", "freq", F.coalesce("cost", F.lit(0).cast("long")).alias("cost"))


def anchors(members: DataFrame, target: int | None = None, most: int | None = None) -> DataFrame:
    """(cluster, seq, cost, nth): reads by cost, distance from the target length, length, text."""
    off = F.abs(F.length("seq") - target) if target is not None else F.lit(0)
    ranked = costs(members).withColumn("nth", F.row_number().over(Window.partitionBy("cluster").orderBy("cost", off, F.length("seq"), "seq")))
    return (ranked.filter(F.col("nth") <= most) if most else ranked).select("cluster", "seq", "cost", "nth")


def medoids(members: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """(cluster, medoid): the read with the smallest cost, then length, then text. counts: distinct_reads(members), where they stand already."""
    return costs(members, counts).groupBy("cluster").agg(F.min(F.struct("cost", F.length("seq").alias("n"), "seq")).alias("x")).select("cluster", F.col("x.seq").alias("medoid"))


def column_votes(members: DataFrame, counts: DataFrame | None = None, best: DataFrame | None = None) -> DataFrame:
    """(cluster, consensus): the majority base of each column over the reads as long as the medoid, its own base and then the smallest on ties; the medoid itself if it is alone in its length.

    counts and best: distinct_reads(members) and their medoids(), where they stand already. A task counts the votes of one cluster's reads; those of clusters beyond VOTE_BASES are rows, which combine
    before the shuffle."""
    counts = distinct_reads(members) if counts is None else counts
    best = kept(medoids(members, counts), "medoids") if best is None else best
    same = counts.join(best, "cluster").filter(F.length("seq") == F.length("medoid")).select("cluster", "seq", "freq", (F.col("seq") == F.col("medoid")).alias("own"))
    # a text alone in its length, however often it occurs, is the medoid
    rows = kept(_dealt(same, VOTE_BASES), "voters")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        voted = align.majority(group["seq"].tolist(), group["freq"].to_numpy(), int(group["own"].to_numpy().argmax()))
        return pd.DataFrame({"cluster": group["cluster"].iloc[:1].array, "voted": [voted]})

    kind = members.schema["cluster"].dataType.simpleString()
    few = rows.filter("blocks = 1").select("cluster", "seq", "freq", "own").repartition(_tasks(members), "cluster").groupBy("cluster").applyInPandas(run, f"cluster {kind}, voted string")
    each = rows.filter("blocks > 1").select("cluster", "freq", F.col("own").cast("int").alias("own"), F.posexplode(F.split("seq", "")).alias("pos", "base")).filter("base <> ''")
    votes = each.groupBy("cluster", "pos", "base").agg(F.sum("freq").alias("n"), F.max("own").alias("own"))
    won = votes.groupBy("cluster", "pos").agg(F.min(F.struct((-F.col("n")).alias("n"), (-F.col("own")).alias("other"), "base")).alias("x"))
    many = won.groupBy("cluster").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.col("x.base").alias("base")))), lambda x: x["base"]), "").alias("voted"))
    return best.join(few.unionByName(many), "cluster", "left").select("cluster", F.coalesce("voted", "medoid").alias("consensus"))


#: References that go to all tasks at once: so many bases, a byte each.
NEAREST_BASES = 32 << 20


def nearest(reads: DataFrame, references: DataFrame, threshold: float = 0.7, block: int = 200, most: int = NEAREST_BASES) -> DataFrame:
    """(id, ref, similarity) of each read (id, seq): the most similar reference (ref, seq), the smallest on ties; null below the threshold, or without references.

    The references are a stated query set. They meet each distinct read in blocks of about `block`, as arrays that are broadcast, so that a read has one row for each block and no pair is a row. Sets of
    more than `most` bases are dealt into slices by hash, each broadcast by itself against the reads. Lengths that differ too much are passed over, and distances end at what the threshold allows."""
    heads = spread(kept(reads.filter(F.trim("seq") != "").select("seq").distinct(), "heads"))
    refs = references.select(F.col("ref").cast("long").alias("ref"), "seq").filter("seq is not null")
    n, bases = refs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("seq") + 16), F.lit(0))).first()
    slices = -(-bases // most)
    where = F.xxhash64("ref", "seq")
    refs = kept(refs.groupBy(F.pmod(where, F.lit(max(1, slices))).alias("slice"), F.pmod(F.shiftright(where, 20), F.lit(-(-n // (block * max(1, slices))) or 1)).alias("block")).agg(F.collect_list(F.struct("seq", "ref")).alias("refs")), "references")
    parts = []
    for k in range(slices):
        both = heads.crossJoin(F.broadcast(refs.filter(F.col("slice") == k).select("refs")))
        parts.append(both.select("seq", F.array_max(F.transform("refs", lambda x: _likeness(F.col("seq"), x, threshold))).alias("x")).groupBy("seq").agg(F.max("x").alias("x")))
    best = heads.select("seq", F.lit(None).cast("struct<similarity: double, neg: bigint>").alias("x"))
    for part in parts:
        best = best.unionByName(part)
    best = best.groupBy("seq").agg(F.max("x").alias("x"))
    return reads.join(best, "seq").select("id", (-F.col("x.neg")).alias("ref"), F.col("x.similarity").alias("similarity"))


def _likeness(seq: Column, ref: Column, threshold: float) -> Column:
    """(similarity, neg) of a strand and a reference (seq, ref), neg being the reference's negative number; null below the threshold."""
    longer = F.greatest(F.length(seq), F.length(ref["seq"]), F.lit(1))
    allowed = edits_allowed(longer, threshold)
    distance = F.when(F.abs(F.length(seq) - F.length(ref["seq"])) <= allowed, F.call_function("levenshtein", seq, ref["seq"], allowed))
    likeness = 1 - distance / longer
    return F.when((distance >= 0) & (likeness >= threshold), F.struct(likeness.alias("similarity"), (-ref["ref"]).alias("neg")))


def anchor_index(references: DataFrame, k: int = 13, step: int = 8, edge: int = 20) -> DataFrame:
    """(gram, ref): k-mers at every step-th place, edges left out, that one reference alone owns."""
    ends = F.length("seq") - edge - k
    grams = references.filter(ends >= edge).select("ref", F.explode(dna.pieces(F.col("seq"), F.sequence(F.lit(edge), ends, F.lit(step)), k)).alias("gram"))
    return grams.groupBy("gram").agg(F.min("ref").alias("ref"), F.count_distinct("ref").alias("owners")).filter("owners = 1").select("gram", "ref")


def anchored(reads: DataFrame, references: DataFrame, k: int = 13, min_hits: int = 3, margin: int = 1, limit: int = 15) -> DataFrame:
    """(id, ref, reverse, hits, distance) of the reads (id, seq) that anchors assign: in each direction the reference with the most anchor hits, at least min_hits and
    margin more than the next; of these the smallest (distance, most hits, widest margin, reference, text)."""
    index = anchor_index(references, k)
    both = reads.select("id", F.lit(False).alias("reverse"), "seq").unionByName(reads.select("id", F.lit(True).alias("reverse"), dna.reverse_complement(F.col("seq")).alias("seq")))
    grams = both.filter(F.length("seq") >= k).select("id", "reverse", F.explode(dna.qgrams(F.col("seq"), k)).alias("gram"))
    # at most 4^k k-mers, so for short ones each task's share of the index fits its memory, and the many grams need not be sorted
    hits = grams.join(index.hint("shuffle_hash") if k <= 13 else index, "gram").groupBy("id", "reverse", "ref").agg(F.count(F.lit(1)).alias("hits"))
    order = Window.partitionBy("id", "reverse").orderBy(F.desc("hits"), "ref")
    top = hits.withColumn("nth", F.row_number().over(order)).withColumn("next", F.coalesce(F.lead("hits").over(order), F.lit(0))).filter("nth = 1")
    top = top.filter((F.col("hits") >= min_hits) & (F.col("hits") - F.col("next") >= margin))
    found = top.join(both, ["id", "reverse"]).join(references.select("ref", F.col("seq").alias("target")), "ref")
    found = found.withColumn("distance", dna.bounded_distance(F.col("seq"), F.col("target"), limit)).filter("distance is not null")
    best = found.groupBy("id").agg(F.min(F.struct("distance", (-F.col("hits")).alias("nh"), (F.col("next") - F.col("hits")).alias("nm"), "ref", "seq", "reverse")).alias("x"))
    return best.select("id", "x.ref", "x.reverse", (-F.col("x.nh")).alias("hits"), "x.distance")


def hash_sample(rows: DataFrame, seed: object, size: int, by: list[str], group: list[str] | None = None, excluded: DataFrame | None = None) -> DataFrame:
    """The `size` rows (of each group) first in the order of their SHA-256 ranks; excluded keys are left out."""
    rows = rows.join(excluded, by, "left_anti") if excluded is not None else rows
    ranked = rows.withColumn("rank", dna.hash_rank(seed, *(F.col(c) for c in by)))
    if not group:
        return ranked.orderBy("rank", *by).limit(size)
    return ranked.withColumn("nth", F.row_number().over(Window.partitionBy(*group).orderBy("rank", *by))).filter(F.col("nth") <= size)
