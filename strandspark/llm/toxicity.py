"""Toxicity by cumulative-link ordinal regression on sparse text features.

P(grade > k) = sigmoid(w.x - theta_k) with one weight vector for all ordered thresholds; the severity is the expected grade.
Features are hashed presences of words and of words' first 3, 4 and 6 bytes, so that unseen inflections of an abusive stem
count. Grades: 0 for rows labelled clean; labelled toxic rows are 2 if they hold at least the median number of abusive marks
among toxic rows, else 1. Marks are the features that labelled toxic rows have far more often than clean ones.

The fit reads a bounded sample of labelled rows, those with the smallest hashes of their ids (SAMPLE); scoring reads all rows.
Defined results: a null or wordless text has the severity of no features; without two kinds of labels every severity is 0;
repeated rows give that row as often; a null id is kept; very long texts are scored whole; an empty table gives an empty table;
other columns are left out, whatever they are called.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .runtime import text_pieces

U = np.uint64
#: At most so many labelled rows are read for the fit.
SAMPLE = 6000
BITS = 20
PREFIXES = (3, 4, 6)


@dataclass
class Model:
    """Sparse weights by feature (a table of 2^BITS) and the ordered thresholds."""

    weights: np.ndarray
    thresholds: np.ndarray


def _features(raw: np.ndarray, offsets: np.ndarray, used: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, feature) pairs of a run of texts; with `used`, only those features."""
    start, end = W.spans(raw, offsets, W.PARTS)
    row = np.searchsorted(offsets, start, "right") - 1
    found = []
    for k, size in enumerate((0, *PREFIXES)):
        keep = slice(None) if not size else end - start >= size
        s = start[keep]
        h = W.hashes(raw, s, end[keep] if not size else s + size, W.LOWER)
        f = (W.mix(h + U(k)) >> U(64 - BITS)).astype(np.int64)
        r = row[keep]
        if used is not None:
            hit = used[f]
            f, r = f[hit], r[hit]
        found.append(r << BITS | f)
    both = np.unique(np.concatenate(found))
    return both >> BITS, both & ((1 << BITS) - 1)


def sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """(toxic, features) of the sampled labelled rows; features: little-endian int32s."""
    chosen = labels.filter("toxic is not null and doc_id is not null").select("doc_id", "toxic").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("toxic", "text")

    def run(batches):
        for batch in batches:
            at = 0
            for _, _, raw, offsets in text_pieces(batch.column(1)):
                n = len(offsets) - 1
                r, f = _features(raw, offsets)
                bounds = np.searchsorted(r, np.arange(n + 1))
                out = [f[bounds[k] : bounds[k + 1]].astype("<i4").tobytes() for k in range(n)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n).cast(pa.int32()), pa.array(out, pa.binary())], names=["toxic", "features"])
                at += n

    return rows.mapInArrow(run, "toxic int, features binary")


def fit(toxic: np.ndarray, features: list[np.ndarray], steps: int = 400, l1: float = 1e-3) -> Model:
    """Accelerated proximal gradient on the ordinal likelihood with an L1 penalty, which leaves most weights at zero."""
    size = 1 << BITS
    zero = Model(np.zeros(size, np.float32), np.array([30.0, 31.0]))
    if len(toxic) == 0 or toxic.min() == toxic.max():
        return zero
    row = np.repeat(np.arange(len(features)), [len(x) for x in features])
    col = np.concatenate(features)
    n1, n0 = max(1, int(toxic.sum())), max(1, int((1 - toxic).sum()))
    in1 = np.bincount(col[toxic[row] == 1], minlength=size)
    in0 = np.bincount(col[toxic[row] == 0], minlength=size)
    mark = (in1 >= 3) & ((in1 + 0.5) / n1 > 8 * (in0 + 0.5) / n0)
    marks = np.bincount(row[mark[col]], minlength=len(features))
    grade = np.where(toxic == 1, np.where(marks >= np.median(marks[toxic == 1]), 2, 1), 0)
    frequent = (in1 + in0) >= 3
    names = np.flatnonzero(frequent)
    place = np.full(size, -1)
    place[names] = np.arange(len(names))
    keep = frequent[col]
    row, col = row[keep], place[col[keep]]
    w, theta = np.zeros(len(names)), np.array([np.log(n0 / n1), np.log(n0 / n1) + 1.0])
    ahead, at, momentum = w.copy(), theta.copy(), 1.0
    rate = 4.0 / max(1.0, np.bincount(row, minlength=len(toxic)).mean())
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -35, 35)))
    balance = np.where(toxic == 1, len(toxic) / (2 * n1), len(toxic) / (2 * n0))
    for _ in range(steps):
        score = np.bincount(row, ahead[col], len(toxic))
        above = [np.ones(len(toxic)), sigmoid(score - at[0]), sigmoid(score - at[1]), np.zeros(len(toxic))]
        slope = [p * (1 - p) for p in above]
        p = np.maximum(np.choose(grade, above[:3]) - np.choose(grade, above[1:]), 1e-9)
        up, down = np.choose(grade, slope[:3]) / p, np.choose(grade, slope[1:]) / p
        g = balance * (down - up) / len(toxic)
        gw = np.bincount(col, g[row], len(w))
        gt = np.array([(balance * ((grade == 1) * up - (grade == 0) * down)).sum(), (balance * ((grade == 2) * up - (grade == 1) * down)).sum()]) / len(toxic)
        fresh = ahead - rate * gw
        fresh = np.sign(fresh) * np.maximum(np.abs(fresh) - rate * l1, 0)
        new_theta = at - 0.5 * gt
        new_theta[1] = max(new_theta[1], new_theta[0] + 0.1)
        following = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        ahead = fresh + (momentum - 1) / following * (fresh - w)
        at = new_theta
        w, theta, momentum = fresh, new_theta, following
    weights = np.zeros(size, np.float32)
    weights[names] = w
    return Model(weights, theta)


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Model:
    got = sample(docs, labels, most).toArrow()
    toxic = got.column("toxic").to_numpy().astype(np.int64)
    return fit(toxic, [np.frombuffer(x, "<i4").astype(np.int64) for x in got.column("features").to_pylist()])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, p_grade1, p_grade2, expected_severity, toxic): p_gradeK is the probability of at least grade K, toxic that of at least 1 being a half or more."""
    names = np.flatnonzero(model.weights).astype(np.int32)
    values, thresholds = model.weights[names], model.thresholds

    def run(batches):
        weights = np.zeros(1 << BITS, np.float32)
        weights[names] = values
        used = weights != 0
        for batch in batches:
            at = 0
            for _, _, raw, offsets in text_pieces(batch.column(1)):
                n = len(offsets) - 1
                r, f = _features(raw, offsets, used)
                z = np.bincount(r, weights[f], n)
                p1, p2 = (1 / (1 + np.exp(-np.clip(z - t, -35, 35))) for t in thresholds)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), pa.array(p1), pa.array(p2), pa.array(p1 + p2), pa.array(p1 >= 0.5)], names=["id", "p_grade1", "p_grade2", "expected_severity", "toxic"])
                at += n

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return out.mapInArrow(run, f"id {kind}, p_grade1 double, p_grade2 double, expected_severity double, toxic boolean").withColumnRenamed("id", id_col)
