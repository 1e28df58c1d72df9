"""Learner evaluation, designs, strata, breakdowns and nested documents against plain Python."""

import hashlib
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandspark.operators import analytics, learning, scoring
from strandspark.plans import inputs
from strandspark.sources import documents

SF = "/root/testdata/sf0.001"
RATES = dict.fromkeys(("substitution", "insertion", "deletion", "dropout"))


def trials(seed=0, n=600):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        policy = rng.choice([(48, 24, 3), (64, 16, 5), (96, 8, 8)])
        out.append((rng.randint(0, 4), f"s{rng.randint(0, 2)}", *(round(rng.random() / 20, 4) for _ in range(4)), *policy, rng.random() < 0.6, 1 + round(rng.random(), 2), round(rng.random() * 9, 2), float(rng.randint(100, 900)), k))
    return out


NAMES = "seed long, scenario string, substitution double, insertion double, deletion double, dropout double, chunk_size int, rs_nsym int, parity_group int, recovered boolean, overhead double, runtime double, nucleotides double, trial long"


@pytest.fixture(scope="module")
def observed(spark):
    return spark.createDataFrame(trials(), NAMES).repartition(3)


def features(r):
    error = r["substitution"] + r["insertion"] + r["deletion"]
    chunk, nsym, group = r["chunk_size"] / 100, r["rs_nsym"] / 32, r["parity_group"] / 8
    return [1, r["substitution"], r["insertion"], r["deletion"], r["dropout"], chunk, nsym, group, error * nsym, error * chunk, r["dropout"] / r["parity_group"], r["dropout"] * nsym]


def utility(rows):
    nt, rt = max(r["nucleotides"] for r in rows), max(r["runtime"] for r in rows)
    return [r["recovered"] - 0.2 * r["nucleotides"] / nt - 0.05 * r["runtime"] / rt for r in rows]


def test_leaving_out_a_fold_equals_fitting_the_others(observed):
    rows = [r.asDict() for r in observed.collect()]
    x, u = np.array([features(r) for r in rows]), np.array(utility(rows))
    fits = learning.ridge_without(observed, "seed", 0.01)
    assert sorted(fits) == [0, 1, 2, 3, 4]
    for fold, got in fits.items():
        own = np.array([r["seed"] != fold for r in rows])
        want = np.linalg.solve(x[own].T @ x[own] + 0.01 * np.eye(x.shape[1]), x[own].T @ u[own])
        assert np.allclose(x @ got, x @ want, atol=1e-6)
    predicted = {r.trial: r.predicted for r in learning.fitted_without(observed, "seed", 0.01).collect()}
    for r, f in zip(rows, x, strict=True):
        assert abs(predicted[r["trial"]] - f @ fits[r["seed"]]) < 1e-9


def test_means_without_a_fold(spark, observed):
    rows = [r.asDict() for r in observed.collect()]
    u = utility(rows)
    for r in learning.means_without(observed, "seed").collect():
        others = [v for v, x in zip(u, rows, strict=True) if x["seed"] != r.seed and x["chunk_size"] == r.chunk_size]
        assert abs(r.predicted - sum(others) / len(others)) < 1e-9
    assert [r.predicted for r in learning.means_without(observed.filter("seed = 1"), "seed").collect()] == [None] * 3


def test_evaluation_equals_plain_loops(observed):
    rows = [r.asDict() for r in learning.fitted_without(observed, "seed").collect()]
    want = {}
    for key in {(r["seed"], r["scenario"]) for r in rows}:
        own = [r for r in rows if (r["seed"], r["scenario"]) == key]
        policy = lambda r: (r["chunk_size"], r["rs_nsym"], r["parity_group"])
        if len({policy(r) for r in own}) < 2:
            continue
        o, t = max(r["overhead"] for r in own), max(r["runtime"] for r in own)
        worth = lambda r: r["recovered"] - 0.2 * r["overhead"] / o - 0.05 * r["runtime"] / t
        pick = min(own, key=lambda r: (-r["predicted"], policy(r), not r["recovered"], r["overhead"], r["runtime"], r["trial"]))
        want.setdefault(key[0], []).append((max(map(worth, own)) - worth(pick), pick["recovered"]))
    got = learning.evaluated(learning.fitted_without(observed, "seed"), "seed", ["scenario"], ["trial"]).collect()
    assert {r.seed: (r.groups, round(r.mean_regret, 9), round(r.recovery_rate, 9), round(r.accuracy, 9)) for r in got} == {
        s: (len(x), round(sum(max(0, a) for a, _ in x) / len(x), 9), round(sum(b for _, b in x) / len(x), 9), round(sum(a <= 0 for a, _ in x) / len(x), 9)) for s, x in want.items()
    }


def test_groups_of_one_policy_are_left_out(spark, observed):
    one = observed.filter("chunk_size = 48").withColumn("predicted", F.lit(1.0))
    assert learning.evaluated(one, "seed", ["scenario"], ["trial"]).count() == 0
    assert learning.evaluated(one.limit(0), "seed", ["scenario"], ["trial"]).count() == 0


def brute_strata(rows, quota, seed):
    strata = {}
    for key, stratum in rows:
        strata.setdefault(stratum, []).append((hashlib.sha256(f"{seed}:{key}".encode()).hexdigest(), key))
    order = {s: [k for _, k in sorted(v)] for s, v in strata.items()}
    out, turn = [], 0
    while len(out) < quota and any(turn < len(v) for v in order.values()):
        for s in sorted(order):
            if turn < len(order[s]) and len(out) < quota:
                out.append((order[s][turn], s, turn + 1))
        turn += 1
    return sorted(out)


@pytest.mark.parametrize("quota", [0, 1, 7, 40, 99, 100, 500])
def test_strata_take_turns_in_any_order(spark, quota):
    rng = random.Random(2)
    rows = [(k, rng.choice("aaaaaabbbc")) for k in range(100)]
    want = brute_strata(rows, quota, 5)
    for part in (1, 4):
        df = spark.createDataFrame(rng.sample(rows, len(rows)), "k long, s string").repartition(part)
        assert sorted((r.k, r.s, r.turn) for r in scoring.stratified(df, ["s"], ["k"], quota, 5).collect()) == want


def test_strata_of_no_rows(spark):
    assert scoring.stratified(spark.createDataFrame([], "k long, s string"), ["s"], ["k"], 5, 1).count() == 0


def test_gaps_and_gates(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2), ("c", 1), (None, 1)], "m string, k int")
    found = analytics.gaps(rows, analytics.design(spark, {"m": ["a", "b"], "k": [1, 2]}), ["m", "k"])
    assert {(r.m, r.k, r.reason, r.n) for r in found.collect()} == {("a", 1, "repeated", 2), ("a", 2, "missing", 0), ("b", 1, "missing", 0), ("c", 1, "surplus", 1), (None, 1, "surplus", 1)}
    x = analytics.gates(found, {"missing": 1, "surplus": 2, "repeated": 0}).first()
    assert x.failures == ["2 keys missing, at most 1", "1 keys repeated, at most 0"] and not x.passed
    whole = analytics.gaps(spark.createDataFrame([("a", 1)], "m string, k int"), analytics.design(spark, {"m": ["a"], "k": [1]}), ["m", "k"])
    x = analytics.gates(whole, {"missing": 0, "surplus": 0, "repeated": 0}).first()
    assert x.passed and x.failures == []


def test_terms_add_up_to_the_score(spark):
    w = inputs.workloads(spark, SF)
    index = {"ssd": 0.9, "object_archive": 0.4, "tape": 0.1, "dna_future": 1.0}
    for args in ((), (inputs.ASSUMPTIONS,), (inputs.ASSUMPTIONS, index, index)):
        terms = scoring.tier_terms(w, "workload", *args)
        scores = {(r.workload, r.tier): r.score for r in scoring.tier_scores(w, "workload", *args).collect()}
        rows = [r.asDict() for r in terms.collect()]
        assert len(rows) == len(scores) and len(terms.columns) == 2 + 8 + 2 + 4 + 1
        for r in rows:
            assert abs(max(0.0, sum(v for k, v in r.items() if k not in ("workload", "tier"))) - scores[r["workload"], r["tier"]]) < 1e-12


def test_nested_documents_and_broken_ones(spark):
    schema = "id bigint NOT NULL, best int, items array<struct<k: int NOT NULL, x: double>>"
    good = {"id": 1, "best": 2, "items": [{"k": 1, "x": 0.5}, {"k": 2, "x": None}], "more": "left out"}
    texts = [(0, json.dumps(good)), (1, None), (2, "{"), (3, json.dumps({"best": 1, "items": []})), (4, json.dumps({"id": 4, "items": [{"x": 1.0}]})), (5, json.dumps({"id": 5, "items": []})), (6, json.dumps({"id": "x"})), (7, "")]
    ok, bad = documents.parsed(spark.createDataFrame(texts, "n int, text string"), schema)
    assert {r.n: r.reason for r in bad.collect()} == {1: "no document", 2: "not of the schema", 3: "lacks id", 4: "lacks items.k", 6: "not of the schema", 7: "lacks id"}
    rows = {(r.n, r.place): (r["item"] and r["item"].k, r.selected) for r in documents.unnested(ok, "items", "best", "k").collect()}
    assert rows == {(0, 0): (1, False), (0, 1): (2, True), (5, None): (None, False)}
