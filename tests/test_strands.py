"""Strand columns, kernels and erasure operators against plain Python."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandspark.functions import align, dna, frames, galois, stats
from strandspark.operators import archive, channel, consensus, erasure, scoring, similarity
from strandspark.plans.store import kept


def rows(df, *keys):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_dna_round_trip_and_invalid(spark):
    data = [(k, bytes(range(k, k + 7))) for k in range(5)] + [(9, b""), (10, None)]
    df = spark.createDataFrame(data, "id long, x binary").withColumn("s", dna.to_dna(F.col("x")))
    got = {r.id: r for r in df.select("id", "x", "s", dna.to_bytes(F.concat(F.lit(" "), F.lower("s"))).alias("back")).collect()}
    assert all(r.back == r.x for r in got.values())
    assert got[0].s[:8] == "AAAAAAAC"
    bad = spark.createDataFrame([("ACG",), ("ACGX",), ("acgt",)], "s string").select(dna.to_bytes(F.col("s")).alias("b")).collect()
    assert [r.b for r in bad] == [None, None, bytes([0b00011011])]


def test_metrics_and_constraints(spark):
    df = spark.createDataFrame([("",), ("AAAA",), ("ACGTGG",), ("GGGGGC",)], "s string")
    got = df.select(dna.gc_fraction(F.col("s")), dna.longest_run(F.col("s")), dna.accepts(F.col("s")), F.size(dna.violations(F.col("s")))).collect()
    assert [tuple(r) for r in got] == [(0.0, 0, False, 1), (0.0, 4, False, 1), (4 / 6, 2, False, 1), (1.0, 5, False, 2)]


def test_selectors_are_a_bijection(spark):
    df = spark.range(256).select(F.col("id").cast("int").alias("m")).withColumn("s", dna.selector(F.col("m"))).withColumn("b", dna.mask_of(F.col("s")))
    got = df.collect()
    assert {r.s for r in got} == set(range(256)) and all(r.b == r.m for r in got)


@pytest.mark.parametrize("nsym", [2, 8, 9])
def test_reed_solomon_corrects_half_its_symbols(nsym):
    rng = np.random.default_rng(nsym)
    words = rng.integers(0, 256, (30, 40)).astype(np.uint8)
    sent = galois.encode(words, nsym)
    for wrong in range(nsym // 2 + 1):
        got = sent.copy()
        for r in range(30):
            for p in rng.choice(sent.shape[1], wrong, replace=False):
                got[r, p] ^= rng.integers(1, 256)
        back, ok = galois.decode(got, nsym)
        assert ok.all() and (back == words).all()


@pytest.mark.parametrize("kind", ["legacy", "compact", "inline"])
def test_frames_round_trip_and_indel(kind):
    layout = frames.Layout(kind, 8, 3, 256, dna.Constraints())
    payloads = [bytes(random.Random(k).randbytes(30)) for k in range(8)]
    packed = frames.encode_batch(layout, payloads, list(range(8)), [8] * 8, [0, 1, 2, 0, 0, 0, 0, 0])
    strands = ["".join("ACGT"[b >> s & 3] for b in x for s in (6, 4, 2, 0)) for x in packed]
    for k, s in enumerate(strands):
        assert frames.decode_strand(layout, s, 8)[:1] == (k,)
        assert frames.decode_strand(layout, s[:33] + s[34:], 8, rescue=True)[2] == payloads[k]
        assert frames.decode_strand(layout, s[:33] + s[34:], 8) is None


def test_alignment_matches_a_plain_table():
    rng = random.Random(3)
    for _ in range(30):
        a, b = ("".join(rng.choices("ACGT", k=rng.randint(0, 12))) for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a) + 1):
            for j in range(len(b) + 1):
                table[i][j] = max(i, j) if not i or not j else min(table[i - 1][j] + 1, table[i][j - 1] + 1, table[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
        assert align.edit_distance(a, b) == table[-1][-1]
        x, y = align.aligned(a, b)
        assert x.replace("-", "") == a and y.replace("-", "") == b and len(x) == len(y)


def test_xor_parity_and_repair(spark):
    data = [("a", b"hello world, this is one"), ("b", b""), ("c", b"x")]
    p = spark.createDataFrame(data, "archive string, payload binary")
    chunks = erasure.chunks(p, 5)
    par = erasure.parity(chunks, 3, 5)
    want = bytes(np.bitwise_xor.reduce([np.frombuffer(b"hello world, thi"[k : k + 5], np.uint8) for k in (0, 5, 10)]))
    assert [r.payload for r in par.filter("archive = 'a' and grp = 0").collect()] == [want]
    c = archive.Config(5, "xor", 3)
    meta = archive.metadata(p, c)
    full = erasure.repaired(chunks.filter("idx % 3 <> 1").select("archive", "idx", "payload"), par, meta.select("archive", "total"), 3, 5)
    assert all(r.verified for r in archive.joined(full, meta).collect())
    lost = erasure.repaired(chunks.filter("idx > 1").select("archive", "idx", "payload"), par, meta.select("archive", "total"), 3, 5)
    assert {r.archive: r.verified for r in archive.joined(lost, meta).collect()}["a"] is False


def test_interleaved_layers_cover_each_chunk_once(spark):
    totals = spark.createDataFrame([("a", 37), ("b", 1), ("c", 8)], "archive string, total int")
    got = erasure.interleaved(totals, 3, 8).groupBy("archive", "idx").count().collect()
    assert all(r["count"] == 3 for r in got) and len(got) == 46
    assert erasure.coprime_multiplier(15, 1) == 7 and erasure.coprime_multiplier(1, 4) == 1


def test_archive_recovers_from_losses_and_noise(spark):
    p = spark.createDataFrame([(k, random.Random(k).randbytes(50 + 31 * k)) for k in range(5)], "archive long, payload binary")
    c = archive.Config(24, "hybrid", 4, layers=1, degree=4, layout=frames.Layout("compact", 6))
    strands = kept(archive.encoded(p, c).filter("kind <> 'data' or idx % 4 <> 2").withColumn("id", F.monotonically_increasing_id()), "strands")
    reads = channel.reads(strands, channel.Channel(0.004, seed=3)).join(strands.select("id", "archive"), "id").select("archive", F.col("id").alias("ordinal"), "seq")
    got = archive.recovered(reads, archive.metadata(p, c), c).collect()
    assert sum(bool(r.verified) for r in got) >= 4


def test_segments_lose_no_pair(spark):
    """Long and short strands with edits bunched at either end, at the limit of the threshold, against all pairs; few of the others are compared."""
    from pyspark.sql import Observation

    rng = random.Random(21)
    seqs = []
    for n in (9, 10, 19, 20, 40, 101, 300):
        base = "".join(rng.choices("ACGT", k=n))
        seqs.append(base)
        for where in ("head", "tail", "even", "any"):
            s, most = list(base), n // 10
            for e in range(most):
                at = {"head": e, "tail": len(s) - 1 - e, "even": e * len(s) // most, "any": rng.randrange(len(s))}[where]
                kind = rng.choice("sid")
                s[at : at + (kind != "i")] = [] if kind == "d" else [rng.choice("ACGT")]
            seqs.append("".join(s))
    seqs = sorted(set(seqs)) + ["".join(rng.choices("ACGT", k=300)) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(seqs)), "id long, seq string")
    for t in (0.8, 0.9):
        seen = Observation()
        got = {(r.src, r.dst) for r in similarity.edges(df, t, seen).collect()}
        want = {(i, j) for i in range(len(seqs)) for j in range(i + 1, len(seqs)) if 1 - align.edit_distance(seqs[i], seqs[j]) / max(len(seqs[i]), len(seqs[j])) >= t}
        assert got == want and seen.get["edges"] == len(want)
        if t == 0.9:
            assert seen.get["compared"] < 300  # of 4465 pairs
    with pytest.raises(ValueError):
        similarity.edges(df, 0.0)


def test_edges_equal_all_pairs(spark):
    rng = random.Random(8)
    base = ["".join(rng.choices("ACGT", k=n)) for n in (4, 12, 24, 60, 60)]
    seqs = base + [s[:5] + rng.choice("ACGT") + s[6:] for s in base[2:]] + [base[3], base[0]]
    df = spark.createDataFrame(list(enumerate(seqs)), "id long, seq string")
    for t in (0.7, 0.9, 0.99):
        got = {(r.src, r.dst) for r in similarity.edges(df, t).collect()}
        labels = {r.id: r.component for r in similarity.classes(df, similarity.edges(df, t)).collect()}
        want = {(i, j) for i in range(len(seqs)) for j in range(i + 1, len(seqs)) if 1 - align.edit_distance(seqs[i], seqs[j]) / max(len(seqs[i]), len(seqs[j])) >= t}
        heads = {s: seqs.index(s) for s in seqs}
        assert {(min(heads[seqs[i]], heads[seqs[j]]), max(heads[seqs[i]], heads[seqs[j]])) for i, j in want if seqs[i] != seqs[j]} <= got
        parent = list(range(len(seqs)))
        for _ in seqs:
            for i, j in want:
                parent[i] = parent[j] = min(parent[i], parent[j])
        assert labels == dict(enumerate(parent))


def test_consensus_recovers_templates(spark):
    refs = spark.createDataFrame([(k, "".join(random.Random(k).choices("ACGT", k=80))) for k in range(4)], "ref long, seq string")
    reads = channel.reads(refs.withColumnRenamed("ref", "id"), channel.Channel(0.02, 0.01, 0.01, copies=8))
    got = {r.method: r for r in consensus.evaluation(refs, reads.select(F.col("id").alias("cluster"), "seq"), ("medoid", "alignment", "multistart"), 80).collect()}
    assert got["alignment"].exact >= got["medoid"].exact and got["multistart"].exact >= 3


def test_channel_does_not_depend_on_partitions(spark):
    s = spark.createDataFrame([(k, "ACGT" * 20) for k in range(20)], "id long, seq string")
    c = channel.Channel(0.05, 0.02, 0.02, 0.1, 0.2, copies=2)
    assert rows(channel.reads(s, c)) == rows(channel.reads(s.repartition(7), c))


def test_rotating_strands_repeat_no_base(spark):
    got = archive.rotating(spark.createDataFrame([(b"",), (b"\x00\xff",), (b"abc",)], "payload binary")).collect()
    assert [len(r.seq) for r in got] == [0, 11, 17]
    assert all(x != y for r in got for x, y in zip("A" + r.seq, r.seq))
    back = archive.unrotated(archive.rotating(spark.createDataFrame([(b"",), (b"\x00\xff",), (b"abc",)], "payload binary")).select("seq")).collect()
    assert [bytes(r.payload) for r in back] == [b"", b"\x00\xff", b"abc"]
    value = 0
    for t in got[1].trits:
        value = value * 3 + t
    assert value == 0x00FF


def test_wilson_and_mcnemar(spark):
    one = spark.range(1)
    low, high = one.select(*stats.wilson(F.lit(223), F.lit(240))).first()
    assert round(low, 3) == 0.890 and round(high, 3) == 0.955
    assert one.select(stats.mcnemar(F.lit(4), F.lit(0))).first()[0] == pytest.approx(0.125)
    assert one.select(stats.mcnemar(F.lit(0), F.lit(0))).first()[0] == 1.0
    assert one.select(stats.mcnemar(F.lit(50_000), F.lit(50_600))).first()[0] == pytest.approx(0.0589, abs=2e-3)


def test_ridge_equals_numpy(spark):
    from strandspark.operators import learning

    rng = np.random.default_rng(4)
    names = [*learning.RATES, *learning.POLICY, "nucleotides", "runtime"]
    data = [(bool(rng.random() < 0.5), *map(float, rng.random(9) + 0.5)) for _ in range(40)]
    df = spark.createDataFrame(data, "recovered boolean, " + ", ".join(f"{n} double" for n in names))
    x = np.array(df.select(*learning.features()).collect())
    v = {n: np.array([r[k + 1] for r in data]) for k, n in enumerate(names)}
    y = np.array([r[0] for r in data]) - 0.2 * v["nucleotides"] / v["nucleotides"].max() - 0.05 * v["runtime"] / v["runtime"].max()
    want = np.linalg.solve(x.T @ x + 1e-3 * np.eye(x.shape[1]), x.T @ y)
    got = learning.ridge(df)
    assert np.allclose(got, want, atol=1e-6)
    assert np.allclose([r.utility for r in learning.predicted(df, got).collect()], x @ want, atol=1e-6)


def test_repairs_are_all_strands_one_indel_away():
    for s in ("AACGT", "ACG", "AAA", "ACGTA"):
        want = {s[:k] + s[k + 1 :] for k in range(len(s))} if len(s) % 4 == 1 else {s[:k] + b + s[k:] for k in range(len(s) + 1) for b in "ACGT"}
        found = frames.repairs(s)
        assert set(found) == want and len(found) == len(want)
    assert frames.repairs("AN") == [] and frames.repairs("ACGT") == []


def test_profiles_have_the_known_archive_shape(spark):
    c = archive.profile("scale-1024")
    data, parity, nt = spark.range(1).select(*archive.counts(F.lit(104_857_600), c)).first()
    assert (data, parity, nt) == (442_438, 55_305, 509_688_008)
    assert [archive.profile(n).chunk_size for n in ("152", "200", "248", "152-compact", "152-compact-v3")] == [11, 23, 35, 29, 30]


def test_crc_of_legacy_frames():
    inner = frames.inner(frames.Layout(), b"abc", 1, 2, 0)
    assert inner[14:18] == zlib.crc32(b"abc").to_bytes(4, "big") and len(inner) == 21


def test_grid_has_no_repeats(spark):
    g = scoring.grid(spark, [32, 64, 250], [8], ["none", "xor", "fountain"], [4, 8], [0.2, 0.4], ["graph"])
    assert g.count() == g.distinct().count() and g.filter("chunk_size = 250").count() == 0


def test_registered_edges_reach_the_reference_threshold(spark, tmp_path):
    from strandspark.plans import queries

    rng = random.Random(11)
    base = [rng.randint(1, 4) for _ in range(100)]
    texts = [base, [x % 4 + 1 if k in (5, 20, 35, 50, 65, 80, 95) else x for k, x in enumerate(base)], [x % 4 + 1 if k % 8 == 3 else x for k, x in enumerate(base)], [rng.randint(1, 4) for _ in range(100)]]
    docs = [(k, " ".join("w" * n for n in t), "en") for k, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    seqs = ["".join("ACGT"[n % 4] for n in t) for t in texts]
    want = {(i, j): round(1 - d / 100, 9) for i in range(4) for j in range(i + 1, 4) if (d := align.edit_distance(seqs[i], seqs[j])) <= 10}
    assert want == {(0, 1): 0.93}  # between the reference's threshold and 0.95
    assert {(r.src, r.dst): r.weight for r in queries.QUERIES["similarity_edges"](spark, str(tmp_path)).collect()} == want


def test_long_chains_and_stalls_are_solved(spark):
    data = {k: random.Random(k).randbytes(4) for k in range(151)}
    triangle = [[0, 1, 2], [0, 1], [1, 2], [3, 4]]  # no symbol of a single chunk; 3 and 4 stay free
    symbols = [("chain", k, [k, k + 1]) for k in range(150)] + [("stall", k, m) for k, m in enumerate(triangle)]
    index = spark.createDataFrame([(a, k, i) for a, k, m in symbols for i in m], "archive string, seed long, idx int")
    made = spark.createDataFrame([(a, k, bytes(np.bitwise_xor.reduce([np.frombuffer(data[i], np.uint8) for i in m]))) for a, k, m in symbols], "archive string, seed long, payload binary")
    known = spark.createDataFrame([("chain", 0, data[0])], "archive string, idx int, payload binary")
    got = {(r.archive, r.idx): bytes(r.payload) for r in erasure.peeled(known, index, made, 4, kept, rounds=2).collect()}
    assert got == {("chain", k): data[k] for k in range(151)} | {("stall", k): data[k] for k in range(3)}


def test_proportional_losses_against_brute_force(spark, tmp_path):
    from strandspark.plans import queries

    totals = [1, 3, 8, 40, 64, 165]
    text = random.Random(5)
    spark.createDataFrame([(n, "".join(text.choices("abcdef", k=32 * n))) for n in totals], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {True: 0, False: 0}
    for n in totals:
        lost = [i for i in range(n) if i % 16 == 2]
        span = {0}  # all sums of the symbols' lost chunks, as bits
        for layer in (1, 2, 3):
            order = [(erasure.coprime_multiplier(n, layer) * p + layer * erasure.WEYL % n) % n for p in range(n)]
            for a in range(0, n, 8):
                mask = sum(1 << lost.index(i) for i in order[a : a + 8] if i in lost)
                span |= {x ^ mask for x in span}
        want[all(1 << k in span for k in range(len(lost)))] += 1
    assert want == {True: 5, False: 1}
    assert {r.verified: r.n for r in queries.QUERIES["peel_proportional"](spark, str(tmp_path)).collect()} == want


def test_blocks_part_systems_that_share_nothing(spark):
    rng = random.Random(11)
    rows, truth = [], {}
    for a in range(3):  # symbols over disjoint runs of four chunks
        for idx in range(24):
            truth[a, idx] = rng.randbytes(6)
        for seed in range(18):
            run = seed % 6
            rows += [(a, seed, 4 * run + k) for k in rng.sample(range(4), rng.choice([2, 3]))]
    unknown = spark.createDataFrame(rows, "archive long, seed long, idx int")
    xor = {}
    for a, seed, idx in rows:
        xor[a, seed] = bytes(x ^ y for x, y in zip(xor.get((a, seed), bytes(6)), truth[a, idx], strict=True))
    values = spark.createDataFrame([(a, s, v) for (a, s), v in xor.items()], "archive long, seed long, payload binary")
    got = {(r.archive, r.idx): bytes(r.payload) for r in erasure.eliminated(unknown, values).collect()}
    want = {}
    for a in range(3):
        own = [([i for x, s, i in rows if (x, s) == (a, seed)], xor[a, seed]) for seed in range(18)]
        want |= {(a, i): v for i, v in erasure.solved(own).items()}
    assert got == want and all(truth[k] == v for k, v in got.items()) and got
    parts = erasure.blocks(unknown).collect()
    assert len({(r.archive, r.block) for r in parts}) >= 18 and len({r.block for r in parts if r.archive == 0 and r.seed % 6 == 1}) <= 2


def test_rescue_flags(spark):
    refs = spark.createDataFrame([(1, "ACGTACGT"), (2, "AAAA"), (3, "CCCC"), (4, "GGGG")], "cluster long, seq string")
    reads = spark.createDataFrame([(1, "ACGTACGA"), (1, "ACGTACCT"), (1, "ACCTACGT"), (2, "AAAA"), (2, "AATA"), (3, "CCCG"), (3, "CCCG")], "cluster long, seq string")
    got = {r.cluster: tuple(r)[1:] for r in consensus.rescue(refs, reads).collect()}
    assert got == {1: (3, False, False, True, False, True), 2: (2, True, True, True, False, False), 3: (2, False, False, False, False, False), 4: (0, False, False, False, False, False)}
