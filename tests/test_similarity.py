"""Similarity joins: no pair at the limit of edits is lost, and nothing many times a table's file is broadcast."""

import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandspark.functions import align, near
from strandspark.operators import similarity
from strandspark.plans.store import CLEANUP, kept


def _edited(rng, seq, edits, end):
    """seq with edits, spread or all near one end, so that segments elsewhere stand unchanged but moved."""
    s = list(seq)
    for _ in range(edits):
        at = rng.randrange(len(s)) if end is None else rng.randrange(min(len(s), 3 * edits)) if end == 0 else len(s) - 1 - rng.randrange(min(len(s), 3 * edits))
        kind = rng.randrange(3)
        if kind == 0:
            s[at] = rng.choice("ACGT".replace(s[at], ""))
        elif kind == 1:
            s.insert(at, rng.choice("ACGT"))
        elif len(s) > 1:
            del s[at]
    return "".join(s)


@pytest.mark.parametrize("threshold", [0.9, 0.75, 0.97])
def test_no_pair_is_lost_at_the_limit(spark, threshold):
    rng = random.Random(7)
    rows = []
    for n in (1, 4, 9, 11, 40, 99, 101, 300, 700):
        for bases in ("ACGT", "AAAC"):
            seq = "".join(rng.choices(bases, k=n))
            rows += [seq, *(_edited(rng, seq, max(1, int((1 - threshold) * n)) - less, end) for end in (None, 0, 1) for less in (0, 1) for _ in range(2))]
    reads = spark.createDataFrame(list(enumerate(dict.fromkeys(rows))), "id long, seq string")
    pair = reads.select(F.col("id").alias("src"), F.col("seq").alias("a")).crossJoin(reads.select(F.col("id").alias("dst"), F.col("seq").alias("b"))).filter("src < dst")
    size = F.greatest(F.length("a"), F.length("b"))
    want = {(r.src, r.dst) for r in pair.filter(1 - F.levenshtein("a", "b") / size >= threshold).collect()}
    assert len(want) > 50
    assert {(r.src, r.dst) for r in similarity.edges(reads, threshold).select("src", "dst").collect()} == want


def test_strands_and_their_pieces_are_not_broadcast(spark, tmp_path):
    rng = random.Random(3)
    rows = [(k, "".join(rng.choices("ACGT", k=60))) for k in range(200)]
    spark.createDataFrame(rows, "id long, seq string").write.parquet(f"{tmp_path}/heads")
    found = similarity.edges(spark.read.parquet(f"{tmp_path}/heads"), 0.9)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_distances_within_a_bound_are_those_of_the_whole_table():
    rng = random.Random(5)
    for bases in ("ACGT", "A", "AC"):
        for n in (0, 1, 2, 17, 40, 90):
            a = "".join(rng.choices(bases, k=n))
            for b in (*(_edited(rng, a, k, end) for k in (0, 1, 5, 20) for end in (None, 0, 1) if n), "", "".join(rng.choices(bases, k=30))):
                want = align.edit_distance(a, b)
                assert align.distance(a, b) == want
                for most in (0, 1, want - 1, want, want + 1, 200):
                    assert most < 0 or align.distance_within(a, b, most) == (want if want <= most else -1)


def test_long_strands_that_share_a_segment_end_soon():
    rng = random.Random(6)
    a, b = ("".join(rng.choices("ACGT", k=20000)) for _ in range(2))
    began = time.process_time()
    assert all(align.distance_within(a, b[:k] + b, 2000) == -1 for k in range(10)) and align.distance(a, _edited(rng, a, 150, None)) <= 150
    assert time.process_time() - began < 20  # 6 G cells of whole tables


@pytest.mark.parametrize("threshold", [0.5, 0.75, 0.9, 0.97])
def test_blocks_give_all_near_pairs(threshold, monkeypatch):
    monkeypatch.setattr(near, "PIECES", 50)  # strands and hits are cut anywhere
    monkeypatch.setattr(near, "HITS", 7)
    rng = random.Random(11)
    seqs = ["A", "C", "AC", "é" * 30, "é" * 29 + "x"]
    for n in (3, 9, 40, 130):
        for bases in ("ACGT", "AAAC", "A"):
            s = "".join(rng.choices(bases, k=n))
            seqs += [s, *(_edited(rng, s, max(1, int((1 - threshold) * n)), end) for end in (None, 0, 1))]
    seqs = sorted(set(seqs) - {""})
    rng.shuffle(seqs)
    x, y = seqs[: len(seqs) * 2 // 3], seqs[len(seqs) // 3 :]
    want = {(a, b, d) for a in x for b in y if (len(a), a) < (len(b), b) and 1 - (d := align.distance(a, b)) / len(b) >= threshold}
    found = near.near(x, y, threshold)
    assert len(found) == len(set(found)) and {(x[i], y[j], d) for i, j, d in found if d >= 0} == want and len(want) > 5
    assert near.near([], y, threshold) == near.near(x, [], threshold) == []


def test_segments_and_places_are_no_rows(spark, tmp_path):
    rng = random.Random(3)
    spark.createDataFrame([(k, "".join(rng.choices("ACGT", k=60))) for k in range(50)], "id long, seq string").write.parquet(f"{tmp_path}/heads")
    plan = similarity.edges(spark.read.parquet(f"{tmp_path}/heads"), 0.9)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") <= 1 and plan.count("Exchange") <= 6  # copies find their first; the strands' two sides are dealt once


def test_links_carry_their_distance_and_costs_compare_a_pair_once(spark):
    seqs = ["ACGTACGTACGT" * 3, "ACGTACGTACGT" * 2 + "ACGTACGAACGT", "ACGTACGTACGT" * 3, "ACGTACGTACGT" * 2 + "ACGTACGACGT", "TTTT"]
    reads = spark.createDataFrame(list(enumerate(seqs)), "id long, seq string")
    got = {(r.src, r.dst): r.distance for r in similarity.near_pairs(reads, 0.9).collect()}
    assert got == {(0, 1): 1, (0, 2): 0, **{(k, 3): align.edit_distance(seqs[k], seqs[3]) for k in (0, 1)}}
    found = similarity.costs(reads.select(F.lit(7).alias("cluster"), "seq"))
    assert {(r.seq, r.freq, r.cost) for r in found.collect()} == {(s, seqs.count(s), sum(align.edit_distance(s, t) for t in seqs)) for s in seqs}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"seq#\d+ < other#\d+", plan)  # one order of each pair


def test_cluster_work_is_dealt_in_blocks(spark, monkeypatch):
    """Sums of distances and votes are the same in small blocks, which meet in pairs on all tasks; near and far strands, copies, other signs."""
    rng = random.Random(17)
    rows = [("short", "".join(rng.choice("ACGT") for _ in range(rng.randrange(1, 9)))) for _ in range(60)]
    for cluster, size, reads in (("long", 120, 50), ("few", 60, 3), ("one", 30, 1)):
        first = "".join(rng.choice("ACGT") for _ in range(size))
        for _ in range(reads):
            x = list(first)
            for _ in range(rng.randrange(size // 3)):
                x[rng.randrange(size)] = rng.choice("ACGTN")
            rows += [(cluster, "".join(x))] * rng.randrange(1, 3)
    members = spark.createDataFrame(rows, "cluster string, seq string")
    by = {c: [s for k, s in rows if k == c] for c in {k for k, _ in rows}}
    want = {(c, s): sum(align.edit_distance(s, t) for t in own) for c, own in by.items() for s in own}
    medoid = {c: min(own, key=lambda s: (want[c, s], len(s), s)) for c, own in by.items()}
    voted = {}
    for c, m in medoid.items():
        same = [s for s in by[c] if len(s) == len(m)]
        voted[c] = "".join(max(sorted(set(column)), key=lambda x: (column.count(x), x == m[k])) for k, column in enumerate(zip(*same)))
    for bases in (1 << 18, 700):
        monkeypatch.setattr(similarity, "CLUSTER_BASES", bases)
        monkeypatch.setattr(similarity, "VOTE_BASES", bases)
        assert {(r.cluster, r.seq): r.cost for r in similarity.costs(members).collect()} == want
        assert {r.cluster: r.consensus for r in similarity.column_votes(members).collect()} == voted
    numbers = np.array([by["long"].count(s) for s in sorted(set(by["long"]))])
    texts, side = sorted(set(by["long"])), np.arange(len(numbers)) % 2
    assert align.costs(texts, numbers, side).tolist() == [sum(align.edit_distance(s, t) * numbers[j] for j, t in enumerate(texts) if side[j] != side[i]) for i, s in enumerate(texts)]


def test_strands_are_stored_once_for_all_pairs_of_blocks(spark, monkeypatch):
    """However many blocks meet, each strand stands in one of them, and one side alone is dealt."""
    rng = random.Random(23)
    seqs = ["".join(rng.choices("ACGT", k=rng.randrange(30, 60))) for _ in range(150)]
    seqs = sorted(set(seqs) | {_edited(rng, s, rng.randrange(1, 5), None) for s in seqs[::3]})
    heads = spark.createDataFrame(list(enumerate(seqs)), "id long, seq string")
    monkeypatch.setattr(similarity, "BLOCK_BASES", 400)
    rows = similarity.blocks(heads, 0.9).collect()
    assert len(rows) > 15 and sorted(x.id for r in rows for x in r.strands) == list(range(len(seqs)))
    found = similarity.compared(heads, 0.9)
    plan = found._jdf.queryExecution().optimizedPlan().toString(), found._jdf.queryExecution().sparkPlan().toString()
    assert "Generate" not in plan[0] and "CartesianProduct" in plan[1]
    want = {(i, j, d) for i, a in enumerate(seqs) for j, b in enumerate(seqs) if i < j and 1 - (d := align.edit_distance(a, b)) / max(len(a), len(b)) >= 0.9}
    got = [(r.src, r.dst, r.distance) for r in found.collect() if 0 <= r.distance <= 0.1 * r.size]
    assert set(got) == want and len(got) == len(want) > 10


def test_what_was_shuffled_for_a_stored_table_is_removed(spark):
    files = lambda: {f.getName() for f in spark.sparkContext._gateway.jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()) if f.getName().startswith("shuffle_")}
    before = files()
    table = kept(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    assert not files() - before
    assert table.count() == 7 and spark.conf.get(CLEANUP, None) is None
