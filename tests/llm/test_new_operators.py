"""Vector codes, ranked search and repeated strings against brute force, and their edge cases."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandspark.llm import ballkmeans, html, lexical, packing, suffixes

SF = "/root/testdata/sf0.001"
CLASHING = ("id", "doc", "t", "q", "codes", "error", "label_error", "part", "block", "m", "row", "terms", "spans", "runs", "key", "piece", "place", "rank", "score", "item", "c")


def with_more(df):
    for name in CLASHING:
        if name not in df.columns:
            df = df.withColumn(name, F.lit(name))
    return df


# ---- vector codes


def brute_codes(rows, parts=8, entries=16, rounds=6):
    """rows: (id, vector) of kept rows in ascending order. Every part is compared with every entry in Python integers."""
    q = [[math.floor(4096 * x) for x in v] for _, v in rows]
    width = len(q[0])
    cut = [k * width // parts for k in range(parts + 1)]
    books = [[list(v[cut[k] : cut[k + 1]]) for v in q[:entries]] for k in range(parts)]

    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(v[cut[k] : cut[k + 1]], e, strict=True)), j) for j, e in enumerate(books[k])) for k in range(parts)] for v in q]

    for _ in range(rounds):
        got = assign()
        for k in range(parts):
            for j in range(len(books[k])):
                own = [v[cut[k] : cut[k + 1]] for v, a in zip(q, got, strict=True) if a[k][1] == j]
                if own:
                    books[k][j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    got = assign()
    flat = ",".join(str(x) for book in books for e in book for x in e)
    return ["".join(f"{j:02x}" for _, j in a) for a in got], [sum(d for d, _ in a) for a in got], hashlib.sha256(flat.encode()).hexdigest()


def test_codes_equal_brute_force(spark):
    rng = random.Random(3)
    centres = [[rng.uniform(-1, 1) for _ in range(16)] for _ in range(6)]
    rows = [(i, [float(np.float32(x + rng.choice([0, 0, rng.gauss(0, 0.02)]))) for x in rng.choice(centres)], rng.choice([0, 1, None])) for i in range(300)]
    odd = [(-1, None, 1), (-2, [None] * 16, 1), (-3, [float("nan")] * 16, 1), (-4, [float("inf")] * 16, 1), (-5, [1.0], 1)]
    df = with_more(spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int").repartition(5))
    assert ballkmeans.compressed(df)[0].count() == 1  # a short vector with the smallest id decides the length
    df = df.filter("vec_id <> -5")
    table, books = ballkmeans.compressed(df)
    code, error, digest = brute_codes([(i, v) for i, v, _ in rows])
    total = Counter()
    for (_, _, label), e in zip(rows, error, strict=True):
        total[label] += e
    got = {r.id: (bytes(r.codes).hex(), r.error, r.label_error) for r in ballkmeans.with_label_error(table).collect()}
    assert got == {i: (c, e, total[label]) for (i, _, label), c, e in zip(rows, code, error, strict=True)}
    assert ballkmeans.fingerprint(books) == digest


def test_balls_skip_work_and_lose_nothing():
    rng = np.random.default_rng(1)
    book = rng.integers(-4000, 4000, (16, 8))
    part = book[rng.integers(0, 16, 5000)] + rng.integers(-300, 300, (5000, 8))
    full = ((part[:, None] - book) ** 2).sum(axis=2)
    all_moved, start = np.ones(16, bool), np.zeros(5000, np.uint8)
    codes, best, _ = ballkmeans.nearest(part, start, book, all_moved)
    assert (codes == full.argmin(axis=1)).all() and (best == full.min(axis=1)).all()
    again, _, work = ballkmeans.nearest(part, codes, book, all_moved)
    assert (again == codes).all() and work < 2 * len(part)  # most lie in stable cores; 16 a row without balls
    assert ballkmeans.nearest(part, codes, book, np.zeros(16, bool))[2] == len(part)


def test_codes_of_few_or_no_rows(spark):
    df = spark.createDataFrame([(None, [1.0] * 8, None), (2, [0.5] * 8, 3), (2, [0.5] * 8, 3)], "vec_id long, embedding array<float>, label int")
    table, books = ballkmeans.compressed(df)
    assert books.shape == (3, 8) and sorted(bytes(r.codes).hex() for r in table.collect()) == ["00" * 8, "00" * 8, "02" * 8]
    assert {(r.id, r.label_error) for r in ballkmeans.with_label_error(table).collect()} == {(None, 0), (2, 0)}
    table, books = ballkmeans.compressed(df.limit(0))
    assert table.count() == 0 and ballkmeans.fingerprint(books) == hashlib.sha256(b"").hexdigest() and ballkmeans.with_label_error(table).count() == 0


# ---- ranked search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute_ranking(docs, items, top=20):
    tf = [(i, Counter(terms(x))) for i, x in docs]
    tf = [(i, c, sum(c.values())) for i, c in tf if c]
    n_docs, n_terms, df = len(tf), sum(n for _, _, n in tf), Counter(t for _, c, _ in tf for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c, n in tf:
            m = 75 + 25 * n * n_docs // n_terms
            s = sum(k * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, k in Counter(terms(text)).items() if t in c)
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, k + 1, x[3], -x[0]) for k, x in enumerate(sorted(scores)[:top])]
    return sorted(out, key=str)


def ranking(spark, docs, items, **more):
    d = with_more(spark.createDataFrame(docs, "doc_id long, text string"))
    b = with_more(spark.createDataFrame(items, "item_id long, text string"))
    return sorted((tuple(r) for r in lexical.ranked(d, b, **more).collect()), key=str)


def test_ranking_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    docs += [(None, docs[3][1]), (900, None), (901, ""), (902, "... !"), (3, docs[3][1]), (903, "word " * 200_000 + docs[5][1])]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()][:12]
    items += [(None, docs[3][1]), (50, None), (51, "?!"), (52, "nowhereseen"), (1, items[0][1]), (53, "Æ æ É_é a-b")]
    assert ranking(spark, docs, items) == brute_ranking(docs, items)


def test_items_in_many_blocks(spark, monkeypatch):
    docs = [(i, f"alpha beta{i % 7} gamma{i % 3} " + "pad " * (i % 11)) for i in range(200)]
    items = [(i, f"alpha beta{i} gamma{i % 3} alpha") for i in range(6)]
    monkeypatch.setattr(lexical, "item_blocks", lambda *a, f=lexical.item_blocks: f(*a, most=30))
    assert ranking(spark, docs, items) == brute_ranking(docs, items)
    assert ranking(spark, docs[:0], items) == [] and ranking(spark, docs, items[:0]) == []


def test_bounds_stop_visits():
    p = lexical.Params(top=2)
    pool = lexical.pa.array(range(10))
    blocks = [lexical.Block(m, pool.slice(k, 1), np.array([0]), np.array([tf]), np.array([0, 1]), np.array([0]), p) for k, (m, tf) in enumerate([(75, 9), (80, 8), (900, 1), (950, 1)])]
    best = [lexical.Best(2)]
    assert lexical.visit(blocks, [(np.array([0]), np.array([700]))], best) == 2 and best[0].ids == [0, 1]


# ---- repeated strings


def brute_repeats(docs, length=100):
    """docs: (id, text), ascending. The earliest start of every string, then all others' bytes."""
    first, out = {}, {}
    for i, text in docs:
        raw = (text or "").encode()
        gone = np.zeros(len(raw) + 1, bool)
        for k in range(len(raw) - length + 1):
            if first.setdefault(raw[k : k + length], (i, k)) != (i, k):
                gone[k : k + length] = True
        edges = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        out[i] = (len(raw), int(gone.sum()), edges, hashlib.sha256(bytes(b for b, g in zip(raw, gone, strict=False) if not g)).hexdigest())
    return out


def passages(seed, n=60):
    """Documents that share passages at any offset, copies, periodic texts and texts of other scripts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9)))
    shared = [" ".join(word() for _ in range(rng.randint(15, 60))) for _ in range(6)]
    out = []
    for i in range(n):
        bits = [rng.choice(shared)[rng.randint(0, 20) : rng.randint(60, 400)] if rng.random() < 0.5 else " ".join(word() for _ in range(rng.randint(0, 40))) for _ in range(rng.randint(0, 5))]
        out.append((i, "".join(bits)))
    out += [(n, "ab" * 400), (n + 1, "a" * 500), (n + 2, out[3][1]), (n + 3, "日本語" * 60), (n + 4, None), (n + 5, ""), (n + 6, "x" * 99), (n + 7, "y" * 100), (n + 8, out[5][1] + " tail")]
    return out


@pytest.mark.parametrize(("seed", "hot"), [(1, 100_000), (2, 3), (3, 0)])
def test_repeats_equal_brute_force(spark, seed, hot):
    docs = passages(seed)
    df = with_more(spark.createDataFrame(docs, "doc_id long, text string").repartition(5))
    got = {r.doc_id: tuple(r)[1:] for r in suffixes.digest(df, suffixes.Params(hot=hot)).collect()}
    assert got == brute_repeats(docs)


def test_repeats_with_nulls_and_repeated_rows(spark):
    text = " ".join(f"w{k}" for k in range(80))
    docs = [(None, text), (1, text), (1, text), (2, text + " more"), (2, text + " less"), (3, "z " * 200_000)]
    got = [(r.doc_id, r.n_bytes, r.n_removed) for r in suffixes.kept_bytes(spark.createDataFrame(docs, "doc_id long, text string")).collect()]
    n = len(text)
    assert Counter(got) == Counter([(None, n, n), (1, n, 0), (1, n, 0), (2, n + 5, n), (2, n + 5, n + 1), (3, 400_000, 400_000 - 2)]) or Counter(got) == Counter([(None, n, n), (1, n, 0), (1, n, 0), (2, n + 5, n + 1), (2, n + 5, n), (3, 400_000, 400_000 - 2)])
    assert suffixes.digest(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_suffix_array():
    rng = random.Random(1)
    for _ in range(1500):
        s = [rng.randint(0, rng.choice([0, 1, 2, 5, 3_000_000])) for _ in range(rng.randint(0, 40))]
        assert suffixes.suffix_array(np.array(s, np.int64)).tolist() == sorted(range(len(s)), key=lambda i: s[i:])


# ---- main text by structure and whole names

PROSE = "Plain prose that a reader came for, " * 6


@pytest.mark.parametrize("name", ["post format-standard tag-news", "tag-a", "tag-b type-post", "hentry category-social", "side-story"])
def test_articles_of_common_class_names_stay(name):
    own = f"<article class='{name}'><h2>T</h2><p>{PROSE}</p></article>"
    for head in ("", "<h1>Blog</h1>"):
        assert html.main_text(f"<body>{head}<main>{own * 4}</main></body>").count("Plain prose") == 24


@pytest.mark.parametrize("name", ["post tag-a", "post", "story", "content", "entry", "text"])
def test_comments_and_notices_stay_out_however_long(name):
    page = f"<div class='{name}'><p>{PROSE}</p></div><div id='comments'><p>Reader {PROSE * 3}</p></div><div class='cookie-notice'><p>Cookie {PROSE * 9}</p></div>"
    got = html.main_text(page)
    assert got == PROSE.strip()


@pytest.mark.parametrize("name", ["id='related-work'", "id='search-methods'", "id='formulation'", "class='social-history'", "class='side-effects'", "class='legal-aspects'", "id='notice-of-meeting'"])
def test_sections_named_after_their_subject_stay(name):
    assert html.main_text(f"<article><p>{PROSE}</p><section {name}><h2>Head</h2><p>Section {PROSE}</p></section></article>").count("Plain prose") == 12


@pytest.mark.parametrize("name", ["post-tags", "tags", "search-box", "related-posts", "share-buttons", "comment-list", "nav-menu", "site-footer", "sidebar", "cookieNotice", "newsletter-signup", "AdBox", "socialLinks"])
def test_parts_named_against_content_go(name):
    assert html.main_text(f"<article><p>{PROSE}</p></article><div class='{name}'><p>Bad {PROSE}</p></div>") == PROSE.strip()


def test_lists_of_links_between_paragraphs_stay():
    links = "<ul><li><a href='x'>Paper one</a></li><li><a href='y'>Paper two</a></li></ul>"
    assert html.main_text(f"<p>{PROSE}</p>{links}<p>{PROSE}</p>").count("Paper") == 2
    assert "Paper" not in html.main_text(f"{links}<div><p>{PROSE}</p><p>{PROSE}</p></div>")


def test_elimination_finds_the_cut_of_large_pages():
    rng = random.Random(3)
    parts = ["<p>Short.</p>", "<div>Plain words here</div>", "<ul><li><a href='x'>Link</a></li><li>Item</li></ul>", "<div class='ad'>Buy</div>", "<h2>Head</h2>", "<div><a href='y'>More of this</a></div>", "<section><div>One</div><div><a href='q'>Two</a></div></section>"]
    for _ in range(100):
        found = html.blocks("<body>" + "".join(rng.choices(parts, k=rng.randint(1, 40))) + "</body>")
        unary, ties = html.graph(found)
        unary = [u + rng.uniform(-1.5, 1.5) for u in unary]
        n = len(found)

        def energy(c, unary=unary, ties=ties, n=n):
            return sum(max(-unary[k], 0) if k in c else max(unary[k], 0) for k in range(n)) + sum(w for k in range(n) for j, w in ties[k].items() if j < k and (j in c) != (k in c))

        assert energy(html._eliminated(list(range(n)), unary, ties)) == pytest.approx(energy(html._cut(list(range(n)), unary, ties)))
    found = html.blocks("<ul>" + "".join(f"<li><a href='x'>l{k}</a></li><li>plain {k} text</li>" for k in range(50_000)) + "</ul>")
    assert len(html.labels(found)) == 100_000  # in linear time; by augmenting paths alone it would not end


@pytest.mark.parametrize("draw", ["uniform", "normal", "few", "short"])
def test_packing_takes_the_better_of_patterns_and_best_fit(draw):
    rng = np.random.default_rng(5)
    lengths = {"uniform": rng.integers(1, 2049, 4000), "normal": np.clip(rng.normal(700, 150, 4000), 1, 2048).astype(int), "few": np.array([2048, 1025, 1024, 1023, 5]), "short": rng.integers(1, 40, 3000)}[draw]
    histogram = Counter(lengths.tolist())
    plan = packing.plan(histogram)
    used = Counter()
    for members, c in plan:
        assert sum(members) <= packing.LIMIT
        for n in members:
            used[n] += c
    assert used == histogram
    size = sum(c for _, c in plan)
    assert size <= sum(c for _, c in packing._best_fit(Counter(), dict(histogram), packing.LIMIT)) and size <= sum(c for _, c in packing._by_patterns(histogram, packing.LIMIT, packing.CLASSES))
    assert packing.plan({}) == []
