"""Nearest references against all pairs, histograms of assignments, timeouts by innermost frame."""

import random

from strandspark.operators import analytics, similarity


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_nearest_references_are_those_of_all_pairs_in_any_blocks(spark):
    rng = random.Random(5)
    strand = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    refs = [(k, strand(rng.randint(8, 30))) for k in range(40)] + [(40, None), (41, "ACGTACGT"), (42, "ACGTACGT"), (43, "A" * 3000), (44, "")]
    reads = [(k, refs[k % 40][1][: 4 + k % 30] + strand(k % 6)) for k in range(90)] + [(90, None), (91, ""), (92, "ACGTACGT"), (93, "A" * 2900), (94, "  "), (95, reads0 := "ACGTACGA"), (96, reads0)]
    want = {}
    for i, s in reads:
        if s and s.strip():
            scored = [(1 - distance(s, t) / max(1, len(s), len(t)), -r) for r, t in refs if t is not None and abs(len(s) - len(t)) <= 0.4 * max(len(s), len(t))]
            top = max((x for x in scored if x[0] >= 0.7), default=(None, None))
            want[i] = (None if top[1] is None else -top[1], None if top[0] is None else round(top[0], 9))
    r, t = spark.createDataFrame(reads, "id long, seq string"), spark.createDataFrame(refs, "ref long, seq string")
    for block, most in ((200, 1 << 20), (3, 1 << 20), (2, 500)):
        got = similarity.nearest(r, t, 0.7, block, most).collect()
        assert len(got) == len(want) and {x.id: (x.ref, x.similarity and round(x.similarity, 9)) for x in got} == want
    none = similarity.nearest(r, t.limit(0)).collect()
    assert len(none) == len(want) and all(x.ref is None and x.similarity is None for x in none)
    assert similarity.nearest(r.limit(0), t).count() == 0


def test_timeouts_by_stage_and_innermost_frame(spark):
    stack = [("a.py", 1, "f"), ("b.py", None, "g")]
    rows = [
        ("m", True, False, "decode", stack), ("m", False, True, "decode", stack), ("m", False, True, None, []), ("m", None, True, "decode", None),
        ("m", True, True, "encode", stack[:1]), ("n", None, None, None, None), (None, True, None, None, None),
    ]
    t = spark.createDataFrame(rows, "method string, verified boolean, timed_out boolean, stage string, stack array<struct<file: string, line: int, function: string>>")
    got = {(r.method, r.kind, r.name): r.n for r in analytics.hotspots(t, ["method"]).collect()}
    assert got == {
        ("m", "trials", "all"): 5, ("m", "successes", "all"): 2, ("m", "timeouts", "all"): 4, ("m", "stage", "decode"): 2, ("m", "stage", "unknown"): 1, ("m", "stage", "encode"): 1,
        ("m", "location", "b.py:?:g"): 1, ("m", "location", "a.py:1:f"): 1, ("n", "trials", "all"): 1, (None, "trials", "all"): 1, (None, "successes", "all"): 1,
    }
    assert analytics.hotspots(t.limit(0), ["method"]).count() == 0


def test_histograms_of_assignments(spark):
    reads = spark.createDataFrame([(1, "ACG"), (2, "ACG"), (3, "")], "id long, seq string")
    assigned = spark.createDataFrame([(1, 7, 4, 0), (2, 7, 5, 0)], "id long, ref long, hits long, distance int")
    got = {tuple(r) for r in analytics.assignment_histograms(assigned, reads).collect()}
    assert got == {("read_length", 3, 2), ("read_length", 0, 1), ("anchor_hits", 4, 1), ("anchor_hits", 5, 1), ("distance", 0, 2), ("reads_of_reference", 2, 1)}
