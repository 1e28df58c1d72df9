"""Random fountain layouts: distinct chunks, degrees, symbols cut where a payload stands, recovery."""

import hashlib
import random
from functools import reduce

from pyspark.sql import functions as F

from strandspark.operators import archive, erasure
from strandspark.plans.store import kept


def _bits(*parts):
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:15], 16)


def _drawn(total, seed, degree):
    taken = []
    for j in range(total - degree, total):
        t = _bits(total, seed, j) % (j + 1)
        taken.append(j if t in taken else t)
    return taken


def _rows(layout):
    out = {}
    for r in layout.collect():
        out.setdefault((r.archive, r.seed), []).append(r.idx)
    return out


def test_draws_equal_plain_loops(spark):
    totals = spark.createDataFrame([("a", 1), ("b", 3), ("c", 50), ("none", 0)], "archive string, total int")
    got = _rows(erasure.random_layout(totals, 2 * F.col("total") + 1, 4, 10))
    want = {(a, s): _drawn(n, s, _bits("degree", n, s) % min(4, n) + 1) for a, n in (("a", 1), ("b", 3), ("c", 50)) for s in range(10, 11 + 2 * n)}
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert all(len(set(v)) == len(v) and all(0 <= i < dict(a=1, b=3, c=50)[k[0]] for i in v) for k, v in got.items())


def test_weights_of_degrees(spark):
    weights = erasure.soliton(spark.createDataFrame([(float(k),) for k in range(1, 21)], "k double"))
    cdf = {r.degree: r.cdf for r in weights.filter("k = 20").collect()}
    got = _rows(erasure.random_layout(spark.createDataFrame([(0, 1000)], "archive long, total int"), F.lit(4000), 20, cdf=weights))
    assert len(got) == 4000
    for degree in range(1, 21):
        share, expected = sum(len(v) == degree for v in got.values()) / 4000, cdf[degree] - cdf.get(degree - 1, 0)
        assert abs(share - expected) < 4 * (expected * (1 - expected) / 4000) ** 0.5 + 1e-3
    held = [i for v in got.values() for i in v]  # chunks are held alike
    assert max(held.count(i) for i in range(0, 1000, 50)) < 3 * len(held) / 1000


def test_symbols_and_recovery(spark):
    text = random.Random(3)
    payloads = {1: b"", 2: b"xy", 3: text.randbytes(32), 4: text.randbytes(32 * 40 + 5), 5: None}
    df = spark.createDataFrame(list(payloads.items()), "archive long, payload binary")
    made = kept(erasure.random_symbols(df, 3.0, 32), "symbols")
    rows, meta = erasure.chunks(df, 32), archive.metadata(df, archive.Config(32))
    index = kept(erasure.random_layout(meta.select("archive", "total"), erasure.symbol_count(F.col("total"), 3.0, 4, False)), "index")
    cells = {(r.archive, r.idx): int.from_bytes(bytes(r.payload).ljust(32, b"\0"), "big") for r in rows.collect()}
    want = {k: reduce(lambda x, y: x ^ y, (cells[k[0], i] for i in v)).to_bytes(32, "big") for k, v in _rows(index).items() if payloads[k[0]]}
    assert {(r.archive, r.seed): bytes(r.payload) for r in made.collect()} == want
    plain = erasure.symbols(rows, index, 32)
    assert {(r.archive, r.seed): bytes(r.payload) for r in plain.collect()} == want
    got = erasure.peeled(rows.filter("idx % 4 <> 1"), index, made, 32, kept)
    assert {r.archive: r.verified for r in archive.joined(got, meta).collect()} == {1: True, 2: True, 3: True, 4: True}


def test_interleaved_symbols_cut_in_place(spark):
    text = random.Random(4)
    df = spark.createDataFrame([(n, text.randbytes(n)) for n in (1, 31, 32, 33, 700)], "archive long, payload binary")
    totals = archive.metadata(df, archive.Config(32)).select("archive", "total")
    joined = erasure.symbols(erasure.chunks(df, 32), erasure.interleaved(totals, 3, 8), 32)
    rows = lambda x: sorted((r.archive, r.seed, bytes(r.payload)) for r in x.select("archive", "seed", "payload").collect())
    assert rows(erasure.interleaved_symbols(df, 3, 8, 32)) == rows(joined)


def test_no_payloads(spark):
    none = spark.createDataFrame([], "archive long, payload binary")
    assert erasure.random_symbols(none, 0.5, 32).count() == 0 and erasure.interleaved_symbols(none, 1, 8, 32).count() == 0
    assert erasure.random_layout(spark.createDataFrame([(1, 5)], "archive long, total int"), F.lit(0)).count() == 0


def test_peeling_writes_what_is_known_once(spark):
    names = []

    def keep(df, name):
        names.append(name)
        return kept(df, name)

    payloads = spark.createDataFrame([(k, bytes((k * j) % 251 for j in range(32 * 40))) for k in range(1, 6)], "archive long, payload binary")
    rows, totals = erasure.chunks(payloads, 32), archive.metadata(payloads, archive.Config(32)).select("archive", "total")
    index = kept(erasure.interleaved(totals, 3, 8), "index")
    got = erasure.peeled(rows.filter("idx not in (2, 17, 30)"), index, erasure.symbols(rows, index, 32), 32, keep)
    assert {(r.archive, r.idx, bytes(r.payload)) for r in got.collect()} == {(r.archive, r.idx, bytes(r.payload)) for r in rows.collect()}
    assert got.count() == 200 and names.count("known") == 1 and names.count("peeled") > 1
