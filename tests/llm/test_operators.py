"""The ten operators against brute force, round trips and held-out labels, and their edge cases."""

import hashlib
import random
import re
import zlib
from base64 import b32encode
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandspark.llm import decontam, html, linededup, minhash, packing, quality, sharding, tokens, toxicity, warc
from strandspark.llm import words as W

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Nulls, empties, wordless, repeated rows, a very long text, and extra columns whose names the operators use themselves.
EDGE = [
    (1, None, "en", "s", 1), (2, "", None, "s", 2), (3, " \n\t ", "en", None, 3), (4, "one two", "en", "s", 4), (4, "one two", "en", "s", 4), (5, "One  TWO", "en", "s", 5),
    (6, "word " * 300_000, "en", "s", 6), (7, "é ü naïve — “x” 日本語 \U0001f600 a'b c's", "fr", "s", 7), (None, "a text without an id", "en", "s", 8), (9, "<|endoftext|> x,'s y", "en", "s", 9),
]


@pytest.fixture(scope="module")
def edge(spark):
    df = spark.createDataFrame(EDGE, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("id", "key", "n", "label", "host", "line", "h", "size", "failed", "n_lines", "bytes", "shard", "length", "_bad", "_gone", "_id", "_t", "_host", "_left", "_sha", "first", "row", "part", "ledger", "t"):
        df = df.withColumn(name, F.lit(name))
    return df


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def shingles(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def classes(sets):
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                r, s = sorted((find(a), find(b)))
                root[s] = r
    return {i: find(i) for i in ids}


def test_minhash_equals_brute_force(spark, docs):
    got = {r.doc_id: r for r in minhash.near_duplicates(docs).collect()}
    sets = {r.doc_id: shingles(r.text) for r in docs.collect()}
    assert {i: r.component_id for i, r in got.items()} == classes(sets)
    assert all(r.n_shingles == len(sets[i]) and r.kept == (i == r.component_id) for i, r in got.items())


def test_minhash_large_noisy_group(spark):
    """A group of noisy copies with outliers: leaders join the core, rare shingles find the rest."""
    rng = random.Random(5)
    base = [f"w{rng.randint(0, 500)}" for _ in range(120)]
    texts = []
    for k in range(160):
        w = list(base)
        for _ in range(rng.choice([0, 0, 1, 2, 3, 4, 5, 9])):
            w[rng.randrange(len(w))] = f"x{rng.randint(0, 30)}"
        texts.append((k, " ".join(w)))
    df = spark.createDataFrame(texts, "doc_id long, text string")
    want = classes({k: shingles(t) for k, t in texts})
    for leaders in (1, 5):
        got = {r.doc_id: r.component_id for r in minhash.near_duplicates(df, p=minhash.Params(leaders=leaders)).collect()}
        assert got == want


def test_minhash_edges(spark, edge):
    got = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(edge).collect()]
    assert Counter(got)[(4, 1, 4, True)] == 2 and (5, 1, 4, False) in got and (1, 0, 1, True) in got and (None, 1, None, True) in got and len(got) == len(EDGE)
    assert minhash.near_duplicates(edge.limit(0)).count() == 0


def test_sketch_fills_every_coordinate():
    for n in (1, 2, 30, 1000):
        s = minhash.sketch(W.mix(np.arange(n, dtype=np.uint64)), np.array([0, n]), 128)
        assert (s != ~np.uint64(0)).all()
    a, b = W.mix(np.arange(1000, dtype=np.uint64)), W.mix(np.arange(100, 1100, dtype=np.uint64))
    x, y = (minhash.sketch(v, np.array([0, len(v)]), 128) for v in (a, b))
    assert abs((x == y).mean() - 900 / 1100) < 0.15


def test_quality_equals_brute_force(spark, docs, edge):
    for df in (docs, edge):
        got = quality.with_policies(quality.ledger(df)).collect()
        want = []
        for r in df.collect():
            text = r.text or ""
            w = WORD.findall(text)
            tri = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
            covered = {k + j for k in range(len(w) - 2) if tri[tuple(w[k : k + 3])] > 1 for j in range(3)}
            lines = [x for x in text.split("\n") if WORD.search(x)]
            want.append((r.doc_id, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)))
        key = lambda x: repr(x)
        assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got), key=key) == sorted(want, key=key)
        assert not [r for r in got if r.base_failed and r.kept]
    assert quality.ledger(edge.limit(0)).count() == 0


def test_quality_keeps_good_and_ablates(spark):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    ledger = quality.ledger(d).cache()
    got = quality.with_policies(ledger).join(labels, "doc_id").filter("n_words >= 50").toPandas()
    assert got[got.quality == 1].kept.mean() > 0.99 and got[got.quality == 0].kept.mean() < 0.05
    rows = ledger.toPandas()
    for r in quality.ablations(ledger).collect():
        bit = quality.bits((r.rule,))
        assert (r.n_failed, r.n_only) == (int((rows.failed & bit > 0).sum()), int((rows.failed == bit).sum()))


def test_line_dedup(spark, edge):
    rows = [(k, f"Menu \n unique {k}\nfooter" if k % 2 else f"unique {k}\n\nfooter ", "h") for k in range(20)] + [(50, "Menu", "other"), (51, "x\nx", None), (52, None, "h")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in linededup.drop_lines(df, max_ratio=0.5).collect()}
    assert got[1].text == "Menu \n unique 1" and got[2].text == "unique 2\n" and got[50].text == "Menu" and got[51].text == "x\nx" and got[52].text is None
    assert (got[2].n_lines, got[2].n_dropped) == (3, 1)
    out = linededup.drop_lines(edge)
    assert out.count() == len(EDGE) and linededup.drop_lines(edge.limit(0)).count() == 0
    assert {c: v for c, v in out.first().asDict().items() if c.startswith("_")} == {c: c for c in edge.columns if c.startswith("_")} and out.schema["n_lines"].dataType.simpleString() == "bigint"
    few = spark.createDataFrame([(1, "Menu\na", "h"), (2, "Menu\nb", "h"), (3, "c", "h")], "doc_id long, text string, source string")
    assert sorted(r.text for r in linededup.drop_lines(few).collect()) == ["a", "b", "c"]  # a line of one page alone stays on any host


def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.vocabulary())
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_token_files_round_trip(spark, docs, edge):
    encode = library()
    for df in (docs, edge):
        folder, files = tokens.write(df)
        got = tokens.read(spark, folder, files, tokens.bits_of(), with_ids=True).collect()
        order = sorted(df.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
        assert [r.id for r in sorted(got, key=lambda r: r.start)] == [r.doc_id for r in order]
        start = 0
        for r, d in zip(sorted(got, key=lambda r: r.start), order, strict=True):
            ids = [*encode(d.text), 2]
            assert r.ids == ids and r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
            assert (r.start, r.n_tokens) == (start, len(ids))
            start += len(ids)
    folder, files = tokens.write(edge.limit(0))
    assert files == [] and tokens.read(spark, folder, files).count() == 0


def test_forgetful_encoder(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 10)
    e = tokens.Encoder(tokens.vocabulary())
    texts = ["the quick brown fox, jumped over, 17 lazy dogs' l'été ", "and ran «away» quickly 42%"]
    raw = [t.encode() for t in texts]
    for _ in range(3):
        ids, bounds = e.encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), 2)
        assert [ids[bounds[k] : bounds[k + 1]].tolist() for k in range(2)] == [[*library()(t), 2] for t in texts]


def test_packing_places_everything_once(spark, docs, edge):
    encode = library()
    for df in (docs, edge):
        rows = packing.packed(df, with_ids=True).collect()
        by = {}
        for r in rows:
            by.setdefault(r.sequence_id, []).append(r)
        for own in by.values():
            at = 0
            for r in sorted(own, key=lambda r: r.offset):
                assert r.offset == at
                at += r.length
            assert at <= packing.LIMIT
        want = Counter()
        for d in df.collect():
            ids = [*encode(d.text), 0]
            for k in range(0, len(ids), packing.LIMIT):
                want[d.doc_id, k // packing.LIMIT, k, zlib.crc32(np.array(ids[k : k + packing.LIMIT], "<u4").tobytes())] += 1
        assert Counter((r.doc_id, r.piece, r.start, r.ids_crc32) for r in rows) == want
        assert all(len(r.ids) == r.length for r in rows)
        total = sum(r.length for r in rows)
        assert len(by) <= 1.001 * total / packing.LIMIT + 2
    assert packing.packed(edge.limit(0)).count() == 0


def test_packing_plans_use_the_histogram():
    rng = random.Random(2)
    for sizes in ([2048] * 5, [1], [1500] * 7 + [548] * 3, [rng.randint(1, 2048) for _ in range(3000)], [700] * 10, [min(2048, 1 + int(rng.expovariate(1 / 700))) for _ in range(20_000)]):
        made = packing.plan(dict(Counter(sizes)))
        plain = packing._best_fit(Counter(), dict(Counter(sizes)), packing.LIMIT)
        assert sum(n for _, n in made) <= 1.002 * sum(n for _, n in plain) + 1
        used = Counter()
        for lengths, n in made:
            assert sum(lengths) <= 2048
            for x in lengths:
                used[x] += n
        assert used == Counter(sizes)


def best(item, text):
    cost = [0] * (len(text) + 1)
    for i, w in enumerate(item, 1):
        last, cost = cost, [i]
        for j, x in enumerate(text, 1):
            cost.append(min(last[j - 1] + (w != x), last[j] + 1, cost[-1] + 1))
    return min(cost)


def edited(rng, words, n):
    """n words at different places replaced, removed, or with one more behind."""
    own = list(words)
    for at in rng.sample(range(len(own)), n):
        own[at] = rng.choice(["new", "", f"{own[at]} more"])
    return " ".join(own).split()


@pytest.mark.parametrize("low, high, share", [(1, 7, 0.0), (8, 15, 0.2), (16, 57, 0.2)])
def test_decontamination_finds_exact_and_edited(spark, edge, low, high, share):
    rng = random.Random(low)
    vocabulary = [f"v{k}" for k in range(300)]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.randint(low, high)))) for k in range(40)]
    rows, planted = [], set()
    for k in range(200):
        w = rng.choices(vocabulary, k=rng.randint(0, 200))
        if k % 2:
            item = rng.randrange(40)
            own = items[item][1].split()
            at = rng.randint(0, len(w))
            w[at:at] = edited(rng, own, int(share * len(own)))
            planted.add((k, item))
        rows.append((k, " ".join(w).upper() if k % 3 else ", ".join(w)))
    df, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.n_edits for r in decontam.matches(df, bench).collect()}
    texts = {k: re.findall(r"[a-z0-9]+", t.lower()) for k, t in rows}
    most = lambda t: int(0.2 * len(t)) if len(t) >= 8 else 0
    within = {(k, i) for k in texts for i, t in items if best(t.split(), texts[k]) <= most(t.split())}
    if high < 16:
        assert set(got) == within  # short items are found exactly
    assert set(got) <= within and len(planted & set(got)) >= 0.97 * len(planted) and planted <= within
    assert all(got[x] == best(items[x[1]][1].split(), texts[x[0]]) for x in got)
    assert decontam.matches(df, bench, p=decontam.Params(block=7)).count() >= 0.97 * len(got)
    kept = {r.doc_id for r in decontam.decontaminated(df, bench).collect()}
    assert kept == set(texts) - {k for k, _ in got}


def test_decontamination_edges(spark, edge):
    bench = spark.createDataFrame([(None, "naïve — “x” 日本語"), (1, None), (2, ""), (3, "one two"), (3, "one two")], "item_id long, text string")
    got = [(r.doc_id, r.item_id) for r in decontam.matches(edge, bench).collect()]
    assert Counter(got) == Counter([(4, 3)] * 4 + [(5, 3)] * 2 + [(7, None)])
    left = decontam.decontaminated(edge, bench)
    assert left.columns == edge.columns and Counter(r.doc_id for r in left.collect()) == Counter([1, 2, 3, 6, None, 9])
    assert decontam.matches(edge, bench.limit(0)).count() == 0 and decontam.decontaminated(edge.limit(0), bench).count() == 0


def test_toxicity_holds_out(spark, edge):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    train, test = labels.filter("doc_id % 2 = 0"), labels.filter("doc_id % 2 = 1")
    model = toxicity.train(d, train)
    assert model.thresholds[0] < model.thresholds[1]
    got = toxicity.score(d.join(test, "doc_id", "left_semi"), model).join(test.withColumnRenamed("toxic", "y"), "doc_id").toPandas()
    assert (got.toxic == (got.y == 1)).mean() > 0.97
    ranks = got.expected_severity.rank()
    pos = got.y == 1
    auc = (ranks[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())
    assert auc > 0.97 and got.p_grade2.le(got.p_grade1).all()
    none = toxicity.train(d, labels.limit(0))
    assert toxicity.score(edge, none).filter("toxic").count() == 0 and toxicity.score(edge, model).count() == len(EDGE)


def test_toxicity_equals_dense_scoring(spark, edge):
    """Scores by a plain loop over words, with the fitted model's weights by feature."""
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(d, labels)

    def feature(word, k):
        raw = np.frombuffer(word, np.uint8)
        h = W.hashes(raw, np.array([0]), np.array([len(raw)]), W.LOWER)
        return int(W.mix(h + np.uint64(k))[0] >> np.uint64(64 - toxicity.BITS))

    for df in (d.limit(60), edge.filter("doc_id is null or doc_id <> 6")):
        got = toxicity.score(df, model).collect()
        for r, want in zip(got, df.collect(), strict=True):
            words = re.findall(rb"[0-9A-Za-z\x80-\xff]+", (want.text or "").encode())
            own = {feature(w[:size] if size else w, k) for w in words for k, size in enumerate((0, *toxicity.PREFIXES)) if len(w) >= size}
            z = sum(float(model.weights[f]) for f in own)
            p1, p2 = (1 / (1 + np.exp(-(z - t))) for t in model.thresholds)
            assert r.doc_id == want.doc_id and r.toxic == (p1 >= 0.5) and r.expected_severity == pytest.approx(p1 + p2, abs=1e-5)
    assert toxicity.score(edge.limit(0), model).count() == 0
    same = toxicity.score(edge.filter("doc_id = 4"), model).select("expected_severity").distinct().count()
    assert same == 1


def test_sharding_fits_and_splits_hot_keys(spark, docs, edge):
    limit = 20_000
    got = sharding.shards(docs, limit=limit).toPandas()
    sums = got.groupby(["shard", "part"]).bytes.sum()
    assert len(got) == docs.count() and (sums == got.groupby(["shard", "part"]).shard_bytes.first()).all()
    alone = got.groupby(["shard", "part"]).bytes.count() == 1
    assert (sums[~alone] <= limit).all()
    names = sorted(set(got.shard))
    assert not [1 for a, b in zip(names, names[1:]) if b.startswith(a)]
    hot = spark.range(500).select(F.lit(7).alias("doc_id"), F.lit("x" * 300).alias("text"))
    parts = sharding.shards(hot, limit=4000).groupBy("shard", "part").agg(F.sum("bytes").alias("b"), F.max("shard_bytes").alias("s")).collect()
    assert sum(r.b for r in parts) == 150_000 and all(r.b == r.s and r.b <= 4000 for r in parts)
    assert sharding.shards(edge).count() == len(EDGE) and sharding.shards(edge.limit(0)).count() == 0
    path = sharding.write_shards(docs, limit=limit)
    assert spark.read.parquet(path).count() == docs.count()
    parts = spark.read.parquet(sharding.write_shards(hot, limit=4000)).groupBy("shard", "part").agg(F.sum(F.length("text")).alias("b")).collect()
    assert sum(r.b for r in parts) == 150_000 and max(r.b for r in parts) <= 4000
    assert spark.read.parquet(sharding.write_shards(edge)).count() == len(EDGE)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var x="</p><p>no";</script></head><body class="page">
<header><h1>Site</h1><ul class="menu"><li><a href="/">Home</a></li></ul></header><div class="cookie-notice">We use cookies.</div>
<div id="content"><article><header><h2>A&nbsp;title &amp; more</h2></header><p>First <b>bold</b>
 text.<br>Second line.<p>Short.</p><div class="ad">Buy now</div><ul><li>one<li>two</ul><aside>Related</aside><form><p>Name</p><input></form></article>
<section class="comments"><p>Reader: nice long comment about the text, which is long enough to look like prose.</p></section></div><footer>&copy; 2024</footer></body></html>"""


def test_html_extraction(spark):
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (None, "u", "<p>unclosed &lt;b&gt; <i>text"), (5, "u", "<article><p>x</article><nav>y</nav>"), (1, "u", PAGE)]
    got = html.extracted(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1))).collect()
    first = "A title & more\n\nFirst bold text. Second line.\n\nShort.\n\none\n\ntwo"
    assert [r.text for r in got if r.page_id == 1] == [first, first]
    assert {r.page_id: r.text for r in got if r.page_id in (2, 3, 5)} == {2: "", 3: "", 5: "x"} and all(r.n_chars == len(r.text) for r in got)


def test_minimum_cut_equals_enumeration():
    rng = random.Random(6)
    for _ in range(40):
        n = rng.randint(1, 9)
        unary = [rng.uniform(-2, 2) for _ in range(n)]
        ties = [{} for _ in range(n)]
        for k in range(1, n):
            ties[k][k - 1] = ties[k - 1][k] = 1.0
            j = rng.randrange(k)
            ties[k][j] = ties[j][k] = ties[k].get(j, 0.0) + 0.5

        def energy(side, unary=unary, ties=ties, n=n):
            return sum(-unary[k] for k in side if unary[k] < 0) + sum(unary[k] for k in range(n) if k not in side and unary[k] > 0) + sum(w for k in side for j, w in ties[k].items() if j not in side)

        cut = html._cut(list(range(n)), unary, ties)
        assert energy(cut) == pytest.approx(min(energy({k for k in range(n) if m >> k & 1}) for m in range(1 << n)))


def test_warc_round_trip(spark):
    rows = [(3, "http://x/é", "same"), (1, None, "same"), (2, "u", None), (4, "u", ""), (5, "u", "ünïque"), (5, "u", "ünïque"), (None, "u", "same"), (6, "u", "z" * 3_000_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder, files = warc.write(df)
    got = warc.read(spark, folder, files, with_payload=True).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    for i, url, page in rows:
        payload = (page or "").encode()
        r = by[i]
        assert (r.url, r.payload_bytes, r.payload_digest) == (url, len(payload), b32encode(hashlib.sha1(payload).digest()).decode())
    assert (by[3].record_type, by[3].refers_to, by[4].record_type, by[4].refers_to) == ("revisit", 1, "revisit", 2)
    assert [r.record_type for r in got if r.page_id in (None, 1, 2, 5, 6)] == ["response"] * 6
    assert bytes(by[1].payload) == b"same" and bytes(by[3].payload) == b""
    folder, files = warc.write(df, min_revisit=5)
    assert {r.record_type for r in warc.read(spark, folder, files).collect()} == {"response"}
    folder, files = warc.write(df.limit(0))
    assert warc.read(spark, folder, files).count() == 0


def test_warc_keeps_payloads_of_repeated_ids_and_odd_urls(spark):
    rows = [(1, "u", "A" * 99), (2, "u", "A" * 99), (2, "u", "B" * 99), (3, "a\nb%0A", "C"), (4, " u ", "C"), (5, "%0A", "D"), *((9, f"u{k}", f"page {k} " * 20) for k in range(30))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for name in ("first", "_id", "_sha", "id"):
        df = df.withColumn(name, F.lit(name))
    folder, files = warc.write(df)
    got = warc.read(spark, folder, files, with_payload=True).collect()
    assert Counter((r.page_id, r.url, r.record_type, r.refers_to) for r in got if r.page_id < 9) == Counter([(1, "u", "response", None), (2, "u", "revisit", 1), (2, "u", "response", None), (3, "a\nb%0A", "response", None), (4, " u ", "revisit", 3), (5, "%0A", "response", None)])
    assert {bytes(r.payload).decode() for r in got if r.record_type == "response"} == {x for _, _, x in rows}


def test_warc_rejects_broken_archives():
    import io

    import zstandard

    good = warc.header_frame(b"") + zstandard.ZstdCompressor(write_content_size=True).compress(warc.record("response", 1, "u", b"abc", "D", 3, None))
    assert [b for _, b in warc.Reader(io.BytesIO(good))] == [b"abc"]
    for bad in (good[8:], good[:-3], good + b"junk", good[:4]):
        with pytest.raises((warc.WarcError, zstandard.ZstdError)):
            list(warc.Reader(io.BytesIO(bad)))
    for data in (b"HTTP/1.1\r\n\r\n", warc.record("response", 1, "u", b"abc", "D", 3, None)[:-1], b"WARC/1.1\r\nA\r\n\r\n"):
        with pytest.raises(warc.WarcError):
            warc.parse(data)


def test_pipeline_equals_brute_force(spark):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.toPandas()
    kept = quality.with_policies(quality.ledger(docs)).filter("kept").toPandas().doc_id
    rows = rows[rows.doc_id.isin(kept)]
    pages = rows.groupby("source").doc_id.count()
    lines = Counter((r.source, x) for r in rows.itertuples() for x in {y.strip(" \t\n\r\x0b\x0c") for y in r.text.split("\n")} if x)
    bad = {k for k, n in lines.items() if n >= 2 and n / pages[k[0]] > 0.1}
    rows = rows.assign(text=["\n".join(x for x in r.text.split("\n") if (r.source, x.strip(" \t\n\r\x0b\x0c")) not in bad) for r in rows.itertuples()])
    roots = classes({r.doc_id: shingles(r.text) for r in rows.itertuples()})
    rows = rows[[roots[i] == i for i in rows.doc_id]]
    items = [re.findall(r"[a-z0-9\x80-\U0010ffff]+", t.lower()) for t in spark.read.parquet(f"{SF}/benchmark.parquet").toPandas().text]
    parts = re.compile("[a-z0-9\x80-\U0010ffff]+")

    def leaks(text):
        w = parts.findall(text.lower())
        have = set(w)
        return any(sum(x in have for x in i) >= 0.8 * len(i) and best(i, w) <= int(0.2 * len(i)) for i in items)

    rows = rows[[not leaks(t) for t in rows.text]]
    got = c.run(spark, SF).toPandas()
    assert set(got.doc_id) == set(rows.doc_id)
    encode = library()
    want = {(r.doc_id, k // packing.LIMIT): zlib.crc32(np.array(ids[k : k + packing.LIMIT], "<u4").tobytes()) for r in rows.itertuples() for ids in [[*encode(r.text), 0]] for k in range(0, len(ids), packing.LIMIT)}
    assert {(r.doc_id, r.piece): r.ids_crc32 for r in got.itertuples()} == want
    assert isinstance(got, pd.DataFrame) and [n for n, _ in c.STAGES] == ["quality rules", "line dedup", "near dedup", "decontamination", "packing"]


@pytest.mark.parametrize("wrapper", [
    "<div class='content-sidebar-wrap'>{}</div>", "<div class='site no-sidebar'>{}</div>", "<div class='page has-sidebar'>{}</div>", "<div class='right-sidebar layout'>{}</div>",
    "<div class='site-content no-comments'>{}</div>", "<div class='form-wrapper'>{}</div>", "<form id='f'>{}</form>", "<div class='sidebar'><main>{}</main></div>", "<div class='widget'><div role='main'>{}</div></div>",
])
@pytest.mark.parametrize("head", ["", "<h1>A title</h1>"])
def test_html_in_wrappers_named_after_their_layout(wrapper, head):
    prose = "Plain prose that a reader came for, " * 6
    page = f"<html><body><nav><a href='/'>Home</a></nav>{wrapper.format(f'{head}<p>{prose}</p><p>{prose}</p>')}<aside><p>Aside {prose}</p></aside><footer><p>Foot {prose}</p></footer></body></html>"
    got = html.main_text(page)
    assert got.count("Plain prose") == 12 and not re.search("Home|Aside|Foot", got)


def test_html_article_headers_and_what_stays_out():
    prose = "Plain prose that a reader came for, " * 6
    article = f"<article><header class='entry-header'><h1>A title</h1></header><p>{prose}</p></article>"
    comments = f"<section class='comments'><article><p>Reader {prose}</p></article><article><p>Reader {prose}</p></article><p>Reader {prose * 3}</p></section>"
    got = html.main_text(f"<body>{article}{comments}<aside><article><h2>Other</h2><p>Other {prose}</p></article></aside></body>")
    assert got.startswith("A title") and prose.strip() in got and not re.search("Other", got)
    assert not re.search("Reader", html.main_text(f"<body>{article}<section class='comments'><article class='comment'><p>Reader {prose * 9}</p></article></section></body>"))


def test_sharding_splits_large_cells_on_all_bits(spark):
    bits = lambda k: format(int(hashlib.md5(str(k).encode()).hexdigest()[:8], 16), "032b")
    first = bits(0)[:10]  # the cells of three shards' bytes have 8 bits
    near = [k for k in range(20_000) if bits(k).startswith(first)][:4]
    rows = [(k, "x" * 600) for k in near] + [(near[0], "x" * 600), (99_999, "y" * 50)]
    got = sharding.shards(spark.createDataFrame(rows, "doc_id long, text string"), limit=1000).collect()
    assert len(near) == 4 and len(got) == 6
    for r in got:
        assert bits(r.key).startswith(r.shard) and len(r.shard) == r.depth
        if r.key == near[0]:  # the same hash twice
            assert r.depth == 32 and r.part > 0 and r.shard_bytes == 600
        else:
            prefix = [sum(len(t) for k, t in rows if bits(k)[:d] == bits(r.key)[:d]) for d in range(33)]
            assert r.part == 0 and r.depth == next(d for d in range(33) if prefix[d] <= 1000) and r.shard_bytes == prefix[r.depth]


def test_labels_are_a_minimum_cut_of_whole_pages():
    rng = random.Random(9)
    parts = ["<p>Short.</p>", "<div>Plain words here</div>", "<ul><li><a href='x'>Link</a></li><li>Item</li></ul>", "<div class='ad'>Buy</div>", "<h2>Head</h2>", "<footer>Foot</footer>", "<div><a href='y'>More of this</a></div>", "<article><p>" + "long prose " * 20 + "</p></article>", "<section><div>One</div><div>Two</div></section>"]
    changed = 0
    for _ in range(60):
        found = html.blocks("<body>" + "".join(rng.choices(parts, k=rng.randint(1, 7))) + "</body>")
        unary, ties = html.graph(found)
        n = len(found)
        if n > 12:
            continue

        def energy(side, unary=unary, ties=ties, n=n):
            return sum(-unary[k] * side[k] if unary[k] < 0 else unary[k] * (not side[k]) for k in range(n)) + sum(w for k in range(n) for j, w in ties[k].items() if j < k and side[j] != side[k])

        own = html.labels(found)
        assert energy(own) == pytest.approx(min(energy([bool(m >> k & 1) for k in range(n)]) for m in range(1 << n)))
        changed += sum((u > 0) != x for u, x in zip(unary, own))
    assert changed > 0  # the cut decides blocks against their own odds


def test_html_short_texts_titles_and_long_pages(spark):
    assert html.main_text("<body><p>Short one.</p><p>Another short para.</p></body>") == "Short one.\n\nAnother short para."
    assert html.main_text("<article><div class='entry-header'><h1>Title</h1></div><p>Text</p></article>") == "Title\n\nText"
    assert html.main_text("<nav><ul><li><a href='/'>Home</a></li></ul></nav><p>Short article.</p><footer>f</footer>") == "Short article."
    page = "<nav>menu</nav><article>" + "<p>word</p>" * 20_000 + "</article>"
    rows = spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string").withColumn("id", F.lit(1)).withColumn("n_chars", F.lit("x"))
    assert html.extracted(rows).first().n_chars == 20_000 * 4 + 2 * 19_999 and html.extracted(rows.limit(0)).count() == 0


def test_pipeline_stages_judge_rows_not_ids(spark, tmp_path):
    import corpus_pipeline as c

    rng = random.Random(3)
    good = [" ".join(rng.choices([f"w{k}" for k in range(900)], k=80)) for _ in range(6)]
    near = good[0].replace(good[0].split()[40], "other", 1)
    item = " ".join(rng.choices([f"q{k}" for k in range(99)], k=20))
    rows = [(None, good[0]), (None, "bad"), (None, good[1] + " " + item), (5, good[2]), (5, "bad"), (7, good[3] + " " + item), (7, good[4]), (8, good[5]), (9, good[5]), (9, good[3]), (11, near), (12, None), (13, ""), (14, good[2].upper())]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("_bad", "_gone", "_id", "_t", "_host", "_left", "ledger", "n_lines", "n_dropped", "id", "row"):
        docs = docs.withColumn(name, F.lit(name))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    long_ones = [(i, t) for i, t in rows if t and len(t) > 9]
    want = {
        "quality rules": Counter(long_ones),
        "near dedup": Counter((i, t) for i, t in rows if (i, t) not in {(9, good[5]), (9, good[3]), (14, good[2].upper())}),  # (9, good[3]) is most of a text of 7
        "decontamination": Counter((i, t) for i, t in rows if not t or item not in t),
        "line dedup": Counter(rows),
    }
    for name, stage in c.STAGES[:-1]:
        if name == "line dedup":
            rows_in = docs.withColumn("source", F.concat("source", F.monotonically_increasing_id()))  # every page a site of its own
        else:
            rows_in = docs
        got = stage(spark, rows_in, str(tmp_path))
        assert got.columns == docs.columns
        found = got.collect()
        assert Counter((r.doc_id, r.text) for r in found) == want[name], name
        assert all(r[x] == x for r in found for x in ("_bad", "_gone", "_id", "n_dropped"))
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    packed = c.STAGES[-1][1](spark, docs, str(tmp_path))
    assert packed.count() == len(rows) and c.STAGES[-1][1](spark, docs.limit(0), str(tmp_path)).count() == 0


def test_minhash_repeated_ids_and_rows(spark):
    rng = random.Random(12)
    texts = [" ".join(rng.choices([f"w{k}" for k in range(500)], k=60)) for _ in range(5)]
    rows = [(5, texts[0]), (5, texts[1]), (2, texts[0]), (5, texts[0] + " more"), (7, texts[1])] + [(9, texts[2])] * 300 + [(8, texts[2] + " x")] * 2 + [(None, texts[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(df).collect())
    assert got == Counter({(5, 2, False): 2, (5, 5, True): 1, (2, 2, True): 1, (7, 5, False): 1, (9, 8, False): 300, (8, 8, True): 2, (None, None, True): 1})
    left = Counter((r.doc_id, r.text) for r in minhash.deduplicated(df).collect())
    assert left == Counter({(5, texts[1]): 1, (2, texts[0]): 1, (8, texts[2] + " x"): 2, (None, texts[0]): 1})
