"""DuckDB statements with the rows of the registered queries."""

from __future__ import annotations

from ..operators import archive, scoring
from .inputs import ASSUMPTIONS, PAYLOADS, READS, TRIALS, WORD, WORKLOADS
from .queries import QUERY

_DNA = "hexed"
for _v in range(16):
    _DNA = f"replace({_DNA}, '{_v:x}', '{'ACGT'[_v >> 2]}{'ACGT'[_v & 3]}')"

_CELLS = f"""{PAYLOADS},
chunked AS (SELECT archive, size, greatest(1, (size + 31) // 32) AS total, hexed, unnest(range(0, greatest(1, (size + 31) // 32)))::INT AS idx FROM payloads),
chunks AS (SELECT archive, total::INT AS total, idx, substr(hexed, idx * 64 + 1, 64) AS x FROM chunked),
cells AS (SELECT archive, total, idx, pos, ('0x' || substr(x, pos * 2 + 1, 2))::INT AS v FROM (SELECT *, unnest(range(0, length(x) // 2)) AS pos FROM chunks))"""
_STRANDS = f"{_CELLS}, strands AS (SELECT archive, idx, {_DNA.replace('hexed', 'x')} AS seq FROM chunks)"
_GC = "CASE WHEN seq = '' THEN 0.0::DOUBLE ELSE length(translate(seq, 'AT', ''))::DOUBLE / length(seq) END"
_RUN = "coalesce(list_max(list_transform(regexp_extract_all(seq, '(A+|C+|G+|T+)'), lambda x: length(x))), 0)::INT"
_BLOCK = "rpad(string_agg(lpad(lower(to_hex(v)), 2, '0'), '' ORDER BY pos), 64, '0')"

# interleaved layers of 8 chunks: multiplier = smallest odd number from 2 * layer + 1, at least 3, without a common factor
_INDEX = f"""{PAYLOADS}, totals AS (SELECT archive, greatest(1, (size + 31) // 32)::BIGINT AS total FROM payloads),
layers AS (SELECT archive, total, unnest([1, 2]) AS layer FROM totals),
mults AS (SELECT archive, total, layer, CASE WHEN total <= 1 THEN 1 ELSE list_min(list_filter(list_transform(range(0, 64), lambda i: greatest(3, 2 * layer + 1) + 2 * i), lambda m: gcd(m, total) = 1)) END AS mult, (layer * 2654435761) % total AS shift FROM layers),
indexes AS (SELECT archive, layer, 1 + (layer - 1) * ((total + 7) // 8) + p // 8 AS seed, ((mult * p + shift) % total)::INT AS idx FROM (SELECT *, unnest(range(0, total)) AS p FROM mults))"""

# random symbols: degree and then chunk after chunk by Floyd's method from hashed numbers of 60 bits
_BITS = "('0x' || substr(md5({0}), 1, 15))::BIGINT"
_DRAWN = f"""drawn(total, seed, degree, j, taken) AS (SELECT total, seed, degree, total - degree, []::BIGINT[] FROM wanted
  UNION ALL SELECT total, seed, degree, j + 1, list_append(taken, CASE WHEN list_contains(taken, {_BITS.format("concat_ws(':', total, seed, j)")} % (j + 1)) THEN j ELSE {_BITS.format("concat_ws(':', total, seed, j)")} % (j + 1) END) FROM drawn WHERE j < total),
chosen AS MATERIALIZED (SELECT total, seed, degree, unnest(taken) AS idx FROM drawn WHERE j = total)"""
_SEEDS = "seeds AS (SELECT total, unnest(range(1, 1 + greatest(1, ceil(total * {0}::DOUBLE))::BIGINT)) AS seed FROM (SELECT DISTINCT total FROM totals))"
_SOLITON = """s AS (SELECT k, greatest(0.025 * ln(k / 0.001) * sqrt(k), 1e-12) AS s FROM ks),
m AS (SELECT k, s, greatest(1, least(floor(k / s), k)) AS m, unnest(range(1, k::BIGINT + 1)) AS degree FROM s),
w AS (SELECT k, degree, greatest(0.0, CASE WHEN degree = 1 THEN 1 / k ELSE 1.0::DOUBLE / (degree * (degree - 1)) END + CASE WHEN degree < m THEN s / (k * degree) WHEN degree = m THEN s / k * ln(s / 0.001) ELSE 0 END) AS w FROM m),
cdfs AS (SELECT k, degree, CASE WHEN degree = k THEN 1.0 ELSE sum(w) OVER (PARTITION BY k ORDER BY degree) / sum(w) OVER (PARTITION BY k) END AS cdf FROM w)"""
_TOTALS = "totals AS (SELECT archive, greatest(1, (size + 31) // 32)::BIGINT AS total FROM payloads)"

# pairs that reach the threshold keep enough common 8-grams: k edits spoil at most 8 k
# all pages as one file: chunks, runs of chunks, and the digests of digests
_FILE = """WITH whole AS (SELECT hex(encode(string_agg(coalesce(html, ''), '' ORDER BY page_id))) AS h FROM pages),
cut AS (SELECT unnest(list_transform(range(0, (len(h) + 2 * {chunk} - 1) // (2 * {chunk})), lambda i: {{'idx': i, 'x': substr(h, i * 2 * {chunk} + 1, 2 * {chunk})}}), recursive := true) FROM whole),
runs AS (SELECT idx // {span} AS run, count(*) AS chunks, sum(len(x) // 2)::BIGINT AS bytes, sha256(unhex(string_agg(sha256(unhex(x)), '' ORDER BY idx))) AS digest FROM cut GROUP BY 1),
whole_file AS (SELECT sha256(unhex(string_agg(digest, '' ORDER BY run))) AS file_digest FROM runs)"""

_EDGES = f"""{READS.replace('reads AS (', 'reads AS MATERIALIZED (').replace('FROM documents)', "FROM documents WHERE regexp_matches(text, '" + WORD + "'))")},
heads AS MATERIALIZED (SELECT seq, min(id) AS id, length(seq) AS n FROM reads GROUP BY seq),
grams AS MATERIALIZED (SELECT DISTINCT id, substr(seq, pos, 8) AS gram FROM (SELECT id, seq, unnest(range(1, n - 6)) AS pos FROM heads WHERE n >= 8)),
sizes AS MATERIALIZED (SELECT h.id, h.n, count(gram) AS g FROM heads h LEFT JOIN grams USING (id) GROUP BY ALL),
common AS MATERIALIZED (SELECT x.id AS a, y.id AS b, count(*) AS c FROM grams x JOIN grams y ON x.gram = y.gram AND x.id < y.id GROUP BY ALL),
near AS MATERIALIZED (SELECT x.id AS a, y.id AS b FROM sizes x JOIN sizes y ON x.id < y.id AND abs(x.n - y.n) <= floor(0.1 * greatest(x.n, y.n) + 1e-9) LEFT JOIN common ON common.a = x.id AND common.b = y.id
  WHERE coalesce(c, 0) >= greatest(x.g, y.g) - 8 * floor(0.1 * greatest(x.n, y.n) + 1e-9)),
edges AS MATERIALIZED (SELECT a.id AS src, b.id AS dst, 1 - levenshtein(a.seq, b.seq)::DOUBLE / greatest(a.n, b.n) AS weight FROM near JOIN heads a ON a.id = near.a JOIN heads b ON b.id = near.b
  WHERE levenshtein(a.seq, b.seq) <= floor((1 - 0.9::DOUBLE) * greatest(a.n, b.n) + 1e-12)
  UNION ALL SELECT h.id, r.id, 1.0 FROM reads r JOIN heads h ON r.seq = h.seq WHERE r.id <> h.id)"""
_CLASSES = f"""WITH RECURSIVE {_EDGES}, ways AS MATERIALIZED (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges),
reach(a, b) AS (SELECT id, id FROM reads UNION SELECT r.a, w.b FROM reach r JOIN ways w ON r.b = w.a),
classes AS MATERIALIZED (SELECT a AS id, min(b) AS component FROM reach GROUP BY 1),
clusters AS MATERIALIZED (SELECT component AS cluster, r.id, r.seq FROM classes c JOIN reads r ON c.id = r.id),
counts AS MATERIALIZED (SELECT cluster, seq, count(*) AS freq FROM clusters GROUP BY ALL),
costs AS MATERIALIZED (SELECT a.cluster, a.seq, sum(levenshtein(a.seq, b.seq) * b.freq) AS cost FROM counts a JOIN counts b ON a.cluster = b.cluster GROUP BY ALL),
medoids AS (SELECT cluster, seq AS medoid FROM costs QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY cost, length(seq), seq) = 1)"""

_ANCHORED = f"""WITH {READS}, directions AS (SELECT id, false AS reverse, seq FROM reads UNION ALL SELECT id, true, translate(reverse(seq), 'ACGT', 'TGCA') FROM reads),
g AS (SELECT id, substr(seq, pos + 1, 13) AS gram FROM (SELECT id, seq, unnest(range(20, length(seq) - 32, 8)) AS pos FROM reads WHERE length(seq) - 33 >= 20)),
u AS (SELECT gram, min(id) AS ref FROM g GROUP BY 1 HAVING count(DISTINCT id) = 1),
grams AS (SELECT id, reverse, substr(seq, pos, 13) AS gram FROM (SELECT id, reverse, seq, unnest(range(1, length(seq) - 11)) AS pos FROM directions WHERE length(seq) >= 13)),
hits AS (SELECT id, reverse, ref, count(*) AS hits FROM grams JOIN u USING (gram) GROUP BY ALL),
top AS (SELECT *, coalesce(lead(hits) OVER w, 0) AS nxt, row_number() OVER w AS nth FROM hits WINDOW w AS (PARTITION BY id, reverse ORDER BY hits DESC, ref)),
found AS MATERIALIZED (SELECT t.id, t.reverse, t.ref, t.hits, t.nxt, b.seq, r.seq AS target FROM top t JOIN directions b ON t.id = b.id AND t.reverse = b.reverse JOIN reads r ON r.id = t.ref WHERE nth = 1 AND hits >= 3 AND hits - nxt >= 1),
far AS MATERIALIZED (SELECT *, CASE WHEN seq = target THEN 0 WHEN length(seq) = length(target) AND list_sum(list_transform(range(1, length(seq) + 1), lambda i: (seq[i] <> target[i])::INT)) <= 15 THEN list_sum(list_transform(range(1, length(seq) + 1), lambda i: (seq[i] <> target[i])::INT))
  WHEN abs(length(seq) - length(target)) <= 15 AND levenshtein(seq, target) <= 15 THEN levenshtein(seq, target) END::INT AS distance FROM found),
anchored AS (SELECT id, ref, reverse, hits, distance FROM far WHERE distance IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY distance, hits DESC, nxt - hits, ref, seq, reverse) = 1)"""

_ROTATED = f"""{_CELLS}, trits AS (SELECT archive, idx, flatten(list_transform(range(0, (length(x) + 3) // 4), lambda p: list_transform(range(CASE WHEN length(substr(x, p * 4 + 1, 4)) = 4 THEN 0 ELSE 5 END, 11),
  lambda k: (('0x' || substr(x, p * 4 + 1, 4))::INT // (3 ** (10 - k))::INT % 3)::VARCHAR))) AS t FROM chunks),
strands AS (SELECT archive, idx, len(t) AS n, substr(list_reduce(list_concat(['A'], t), lambda s, v: s || substr(replace('ACGT', right(s, 1), ''), v::INT + 1, 1)), 2) AS seq FROM trits)"""

_ACGT = f"array_to_string(list_transform(regexp_extract_all(text, '{WORD}'), lambda w: 'ACGT'[length(w) % 4 + 1]), '')"


def _tier(values: dict[str, float]) -> str:
    return "CASE tier " + " ".join(f"WHEN '{t}' THEN {v}::DOUBLE" for t, v in values.items()) + " END"


def _trait(name: str) -> str:
    k = ("latency", "mutable", "durability", "idle_energy", "long_term", "redundancy").index(name)
    return _tier({t: v[k] for t, v in scoring.TIERS.items()})


_NEEDS = {"retention_need": "least(1.0, retention_years / 100)", "access_need": "least(1.0, accesses_per_year / 365)", "probability_need": "coalesce(access_probability, 0.0)"}
_SCORE = " + ".join(f"{w}::DOUBLE * {_trait(t)} * {_NEEDS.get(n, n)}" for w, t, n in scoring.TERMS) + " + 0.06 * 0.5 * cost_priority + 0.04 * 0.5 * cost_priority"
_PENALTY = "CASE WHEN tier = 'dna_future' THEN 0.25 * retrieval_urgency + 0.20 * mutability ELSE 0 END"
_A = [_tier({t: v[k] for t, v in ASSUMPTIONS.items()}) for k in range(5)]
_READ = "size_gb * accesses_per_year * retention_years"
_LIFE = f"""{WORKLOADS}, tiers AS (SELECT *, unnest(['ssd', 'object_archive', 'tape', 'dna_future']) AS tier FROM workloads),
life AS (SELECT *, size_gb * retention_years * {_A[0]} AS storage_cost, {_READ} * {_A[1]} AS retrieval_cost, size_gb / 1000 * retention_years * {_A[2]} + {_READ} * {_A[3]} AS energy_kwh,
  coalesce(access_probability, least(1.0, accesses_per_year)) * {_A[4]} AS latency_hours FROM tiers)"""


def _life_term(w, v, p):
    return f"{w} * CASE WHEN max({v}) OVER (PARTITION BY workload) <= 0 THEN 1.0 ELSE greatest(0.0, 1 - {v} / max({v}) OVER (PARTITION BY workload)) END * {p}"


_GAPS = """want AS (SELECT unnest(['fixed', 'adaptive', 'planned']) AS strategy, s.scenario, p.payload_size, d.seed FROM (SELECT 's' || unnest(range(8)) AS scenario) s, (SELECT 1024 * unnest(range(1, 7)) AS payload_size) p, (SELECT unnest(range(16)) AS seed) d),
have AS (SELECT strategy, scenario, payload_size, seed, count(*) AS n FROM trials GROUP BY ALL),
gaps AS (SELECT strategy, scenario, payload_size, seed, CASE WHEN n IS NULL THEN 'missing' WHEN w IS NULL THEN 'surplus' WHEN n > 1 THEN 'repeated' END AS reason, coalesce(n, 0) AS n
  FROM have FULL JOIN (SELECT *, true AS w FROM want) USING (strategy, scenario, payload_size, seed) WHERE n IS NULL OR w IS NULL OR n > 1)"""
_TERMS = " + ".join(_life_term(*x) for x in scoring.LIFECYCLE)

_OBSERVED = f"""{TRIALS}, e AS (SELECT *, substitution + insertion + deletion AS error, overhead - 0.2 AS durability, runtime / 60 AS overhead_priority FROM trials),
p AS (SELECT *, CASE WHEN error >= 0.02 THEN 48 WHEN error >= 0.005 THEN 64 ELSE 96 END AS chunk, CASE WHEN error >= 0.02 THEN 24 WHEN error >= 0.005 THEN 16 ELSE 8 END AS nsym,
  CASE WHEN dropout >= 0.10 THEN 3 WHEN dropout >= 0.03 THEN 5 ELSE 8 END AS grp FROM e),
q AS (SELECT *, CASE WHEN durability >= 0.85 AND nsym < 24 THEN nsym + 4 ELSE nsym END AS nsym2 FROM p),
observed AS (SELECT *, CASE WHEN durability >= 0.85 AND nsym < 24 THEN least(chunk, 80) ELSE chunk END AS chunk_size,
  CASE WHEN overhead_priority >= 0.7 AND error < 0.005 THEN greatest(6, nsym2 - 2) ELSE nsym2 END AS rs_nsym, CASE WHEN durability >= 0.85 THEN greatest(3, grp - 1) ELSE grp END AS parity_group,
  max(nucleotides) OVER () AS max_nt, max(runtime) OVER () AS max_rt FROM q)"""
_L1 = " + ".join(f"abs({c} - {v})" for c, v in QUERY.items())
_L2 = " + ".join(f"pow({c} - {v}, 2)" for c, v in QUERY.items())


def _wilson(sign: str) -> str:
    p, n, z = "(s::DOUBLE / n)", "n", "1.96::DOUBLE"
    return f"({p} + {z}*{z}/(2*{n})) / (1 + {z}*{z}/{n}) {sign} {z} * sqrt({p}*(1-{p})/{n} + {z}*{z}/(4*{n}*{n})) / (1 + {z}*{z}/{n})"


def _profiles() -> str:
    out = []
    for name in archive.PROFILES:
        c = archive.profile(name)
        o, w, g = c.layout.overhead, c.chunk_size, c.group
        n = f"greatest(1, (size + {w - 1}) // {w})"
        out.append(f"SELECT '{name}' AS profile, sum({n})::BIGINT AS data, sum(({n} + {g - 1}) // {g})::BIGINT AS parity, sum(4 * ({o} * {n} + size) + ({n} + {g - 1}) // {g} * 4 * {o + w})::BIGINT AS nucleotides FROM payloads")
    return f"WITH {PAYLOADS} " + " UNION ALL ".join(out)


SQL: dict[str, str] = {
    "dna_encode": f"WITH {PAYLOADS} SELECT archive, length({_DNA})::INT AS nt, sha256({_DNA}) AS digest FROM payloads",
    "dna_roundtrip": "SELECT doc_id AS archive, sha256(encode(text)) AS digest FROM documents",
    "sequence_metrics": f"WITH {PAYLOADS}, s AS (SELECT archive, {_DNA} AS seq FROM payloads), m AS (SELECT archive, {_GC} AS gc, {_RUN} AS run FROM s) SELECT archive, gc, run, abs(gc - 0.5) + 0.05 * greatest(0, run - 4) AS penalty FROM m",
    "strand_statistics": f"WITH {_STRANDS}, m AS (SELECT archive, length(seq) AS nt, {_GC} AS gc, {_RUN} AS run FROM strands) SELECT archive, count(*) AS strands, sum(nt)::BIGINT AS nucleotides, min(gc) AS min_gc, max(gc) AS max_gc, max(run) AS longest_run, avg((gc BETWEEN 0.35 AND 0.65 AND run <= 4)::INT) AS pass_rate FROM m GROUP BY 1",
    "constraint_violations": f"""WITH {_STRANDS}, m AS (SELECT {_GC} AS gc, {_RUN} AS run FROM strands) SELECT * FROM (SELECT 'below' AS side, 'gc' AS what, count(*) FILTER (gc < 0.35) AS n FROM m UNION ALL SELECT 'above', 'gc', count(*) FILTER (gc > 0.65) FROM m UNION ALL SELECT 'above', 'run', count(*) FILTER (run > 4) FROM m) WHERE n > 0""",
    "archive_counts": _profiles(),
    "chunk_digest": "WITH p AS (SELECT page_id AS archive, hex(encode(html)) AS h FROM pages), c AS (SELECT archive, h, unnest(range(0, greatest(1, (length(h) + 8191) // 8192)))::INT AS idx FROM p) SELECT archive, idx, sha256(unhex(substr(h, idx * 8192 + 1, 8192))) AS digest FROM c",
    "bundle_contents": f"""WITH {PAYLOADS}, n AS (SELECT sum((size + 31) // 32)::BIGINT AS records, sum(4 * size)::BIGINT AS nucleotides FROM payloads)
SELECT member, CASE member WHEN 'rejected' THEN 0 ELSE records END AS records, CASE member WHEN 'rejected' THEN 0 ELSE nucleotides END AS nucleotides, records AS declared FROM n, (SELECT unnest(['fasta', 'csv', 'rejected']) AS member)""",
    "mask_selectors": "WITH e AS (SELECT event_id, (event_id % 256)::INT AS mask FROM events) SELECT event_id, mask, CASE WHEN mask < 16 THEN mask + 176 WHEN mask < 192 THEN mask - 16 ELSE mask END::INT AS selector, mask AS back FROM e",
    "xor_parity": f"WITH {_CELLS}, x AS (SELECT archive, idx // 8 AS grp, pos, bit_xor(v) AS v FROM cells GROUP BY ALL) SELECT archive, grp::INT AS grp, {_BLOCK} AS block FROM x GROUP BY ALL",
    "xor_repair": "SELECT doc_id AS archive, sha256(encode(text)) AS digest, true AS verified FROM documents",
    "fountain_indexes": f"WITH {_INDEX} SELECT archive, seed, count(*) AS degree, sum(idx)::BIGINT AS total_idx, min(idx) AS least, max(idx) AS most FROM indexes GROUP BY ALL",
    "fountain_payloads": f"WITH {_CELLS}, {_INDEX[_INDEX.index('totals AS'):]}, x AS (SELECT c.archive, seed, pos, bit_xor(v) AS v FROM cells c JOIN indexes i ON c.archive = i.archive AND c.idx = i.idx AND layer = 1 GROUP BY ALL) SELECT archive, seed, {_BLOCK} AS block FROM x GROUP BY ALL",
    "random_fountain": f"""WITH RECURSIVE {_CELLS}, {_TOTALS}, {_SEEDS.format(0.35)}, wanted AS MATERIALIZED (SELECT total, seed, {_BITS.format("concat_ws(':', 'degree', total, seed)")} % least(4, total) + 1 AS degree FROM seeds), {_DRAWN},
x AS (SELECT c.archive, seed, pos, bit_xor(v) AS v FROM cells c JOIN chosen i ON c.total = i.total AND c.idx = i.idx GROUP BY ALL) SELECT archive, seed, {_BLOCK} AS block FROM x GROUP BY ALL""",
    "soliton_fountain": f"""WITH RECURSIVE {PAYLOADS}, {_TOTALS}, {_SEEDS.format(0.5)}, ks AS (SELECT unnest(range(1, 33))::DOUBLE AS k), {_SOLITON},
wanted AS MATERIALIZED (SELECT total, seed, min(degree) AS degree FROM (SELECT total, seed, {_BITS.format("concat_ws(':', 'degree', total, seed)")} / 1152921504606846976::DOUBLE AS u FROM seeds) JOIN cdfs ON k = least(32, total) AND u < cdf GROUP BY ALL), {_DRAWN},
each AS (SELECT archive, c.seed, any_value(degree) AS degree, sum(idx) AS s FROM totals t JOIN chosen c ON t.total = c.total GROUP BY ALL) SELECT degree, count(*) AS symbols, sum(s)::BIGINT AS total_idx FROM each GROUP BY 1""",
    "symbol_counts": f"WITH {PAYLOADS}, t AS (SELECT archive, greatest(1, (size + 31) // 32) AS n FROM payloads) SELECT archive, (3 * ((n + 7) // 8))::BIGINT AS interleaved, greatest(1, ceil(n * 0.35::DOUBLE))::BIGINT AS random FROM t",
    "peel_fixpoint": "SELECT true AS verified, count(*) AS n FROM documents",
    "soliton_cdf": f"WITH ks AS (SELECT DISTINCT p_size::DOUBLE AS k FROM part), {_SOLITON} SELECT k, degree, round(cdf, 9) AS cdf FROM cdfs",
    "archive_recover": "SELECT doc_id AS archive, sha256(encode(text)) AS digest, true AS verified FROM documents WHERE text IS NOT NULL",
    "qgram_postings": f"WITH {READS}, g AS (SELECT id, unnest(CASE WHEN length(seq) < 8 THEN [seq] ELSE list_transform(range(1, length(seq) - 6), lambda i: substr(seq, i, 8)) END) AS gram FROM reads) SELECT gram, count(DISTINCT id) AS reads, count(*) AS times FROM g GROUP BY 1",
    "file_ranges": f"""{_FILE.format(chunk=4096, span=16)} SELECT run, chunks, bytes, digest, file_digest FROM runs, whole_file""",
    "file_repair": f"""{_FILE.format(chunk=240, span=64)} SELECT run, chunks, bytes, digest, true AS same FROM runs""",
    "similarity_edges": f"WITH {_EDGES} SELECT src, dst, round(weight, 9) AS weight FROM edges",
    "similarity_classes": f"{_CLASSES} SELECT id, component FROM classes",
    "similarity_report": f"""{_CLASSES}, class_sizes AS (SELECT component, count(*) AS n FROM classes GROUP BY 1)
SELECT (SELECT count(*) FROM reads) AS nodes, (SELECT count(*) FROM heads) AS distinct_strands, (SELECT count(*) FROM edges) AS edges, count(*) AS components, count(*) FILTER (n = 1) AS singletons, max(n) AS largest FROM class_sizes""",
    "rescue_modes": f"""{_CLASSES.replace('clusters AS MATERIALIZED (', 'members AS MATERIALIZED (').replace('counts AS MATERIALIZED', 'clusters AS MATERIALIZED (SELECT * FROM members WHERE id <> cluster), counts AS MATERIALIZED')}, same AS (SELECT c.cluster, c.seq, medoid FROM clusters c JOIN medoids m ON c.cluster = m.cluster AND length(c.seq) = length(medoid)),
v AS (SELECT cluster, medoid, pos, seq[pos] AS base, count(*) AS n FROM (SELECT *, unnest(range(1, length(seq) + 1)) AS pos FROM same) GROUP BY ALL),
w AS (SELECT cluster, pos, base FROM v QUALIFY row_number() OVER (PARTITION BY cluster, pos ORDER BY n DESC, (base = medoid[pos]) DESC, base) = 1),
votes AS (SELECT cluster, string_agg(base, '' ORDER BY pos) AS voted FROM w GROUP BY 1),
r AS (SELECT m.cluster, m.seq, (SELECT count(*) FROM clusters c WHERE c.cluster = m.cluster) AS reads, m.seq IN (SELECT c.seq FROM clusters c WHERE c.cluster = m.cluster) AS direct FROM members m WHERE m.id = m.cluster),
f AS (SELECT r.cluster, reads, direct, coalesce(medoid = r.seq, false) AS medoid, coalesce(voted = r.seq, false) AS votes FROM r LEFT JOIN medoids ON r.cluster = medoids.cluster LEFT JOIN votes ON r.cluster = votes.cluster)
SELECT *, NOT direct AND medoid AS medoid_rescued, NOT direct AND votes AS votes_rescued FROM f""",
    "cluster_medoids": f"{_CLASSES} SELECT cluster, medoid FROM medoids",
    "cluster_votes": f"""{_CLASSES}, same AS (SELECT c.cluster, c.seq, medoid FROM clusters c JOIN medoids m ON c.cluster = m.cluster AND length(c.seq) = length(medoid)),
v AS (SELECT cluster, medoid, pos, seq[pos] AS base, count(*) AS n FROM (SELECT *, unnest(range(1, length(seq) + 1)) AS pos FROM same) GROUP BY ALL),
w AS (SELECT cluster, pos, base FROM v QUALIFY row_number() OVER (PARTITION BY cluster, pos ORDER BY n DESC, (base = medoid[pos]) DESC, base) = 1)
SELECT cluster, string_agg(base, '' ORDER BY pos) AS consensus FROM w GROUP BY 1""",
    "cluster_anchors": f"{_CLASSES} SELECT * FROM (SELECT cluster, seq, cost::BIGINT AS cost, row_number() OVER (PARTITION BY cluster ORDER BY cost, abs(length(seq) - 300), length(seq), seq)::INT AS nth FROM costs) WHERE nth <= 2",
    "nearest_reference": f"""WITH refs AS (SELECT item_id AS ref, {_ACGT} AS target FROM benchmark), turns AS (SELECT conv_id, turn, {_ACGT} AS seq FROM conversations),
s AS (SELECT conv_id, turn, ref, 1 - levenshtein(seq, target)::DOUBLE / greatest(1, length(seq), length(target)) AS similarity FROM turns, refs WHERE seq <> ''),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY similarity DESC, ref) = 1)
SELECT conv_id, turn, CASE WHEN similarity >= 0.5 THEN ref END AS ref, CASE WHEN similarity >= 0.5 THEN round(similarity, 9) END AS similarity FROM b""",
    "reverse_complements": f"WITH {READS} SELECT id, sha256(translate(reverse(seq), 'ACGT', 'TGCA')) AS digest FROM reads",
    "anchor_index": f"""WITH {READS}, g AS (SELECT id, substr(seq, pos + 1, 13) AS gram FROM (SELECT id, seq, unnest(range(20, length(seq) - 32, 8)) AS pos FROM reads WHERE length(seq) - 33 >= 20)),
u AS (SELECT gram, min(id) AS ref FROM g GROUP BY 1 HAVING count(DISTINCT id) = 1) SELECT ref, count(*) AS anchors FROM u GROUP BY 1""",
    "hash_ranked_turns": "SELECT * FROM (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY sha256('42:' || conv_id || ':' || turn), conv_id, turn)::INT AS nth FROM conversations) WHERE nth <= 2",
    "codec_policy": f"WITH {_OBSERVED} SELECT chunk_size, rs_nsym, parity_group, count(*) AS n FROM observed GROUP BY ALL",
    "tier_scores": f"WITH {WORKLOADS}, tiers AS (SELECT *, unnest(['ssd', 'object_archive', 'tape', 'dna_future']) AS tier FROM workloads) SELECT workload, tier, round(greatest(0.0, {_SCORE} - {_PENALTY}), 9) AS score FROM tiers",
    "tier_lifecycle": f"WITH {_LIFE} SELECT tier, round(sum(storage_cost), 3) AS storage_cost, round(sum(retrieval_cost), 3) AS retrieval_cost, round(sum(energy_kwh), 3) AS energy_kwh, round(sum(latency_hours), 3) AS latency_hours FROM life GROUP BY 1",
    "tier_winners": f"""WITH {_LIFE}, s AS (SELECT workload, tier, greatest(0.0, {_SCORE} + {_TERMS} - {_PENALTY}) AS score FROM life)
SELECT workload, tier, round(score, 9) AS score FROM s QUALIFY row_number() OVER (PARTITION BY workload ORDER BY score DESC, list_position(['ssd', 'object_archive', 'tape', 'dna_future'], tier)) = 1""",
    "candidate_grid": """WITH c AS (SELECT DISTINCT p_size + 16 AS chunk, p_partkey % 33 AS nsym, ['none', 'xor', 'fountain', 'hybrid'][p_partkey % 4 + 1] AS scheme, p_partkey % 7 + 2 AS grp FROM part)
SELECT scheme, count(*) AS n, round(avg(nsym::DOUBLE / (chunk + 18) + CASE WHEN scheme IN ('xor', 'hybrid') THEN 1.0::DOUBLE / grp ELSE 0 END + CASE WHEN scheme IN ('fountain', 'hybrid') THEN 0.35 ELSE 0 END), 9) AS mean_ratio FROM c WHERE chunk + nsym + 18 <= 255 GROUP BY 1""",
    "objective_rank": """WITH t AS (SELECT l_suppkey % 8 AS scenario, l_suppkey AS candidate, avg((l_quantity >= 12)::INT) AS recovery, avg(l_tax) AS instability, avg(l_discount) AS overhead, max(l_tax) AS redundancy, avg(l_extendedprice) AS runtime FROM lineitem GROUP BY ALL),
s AS (SELECT scenario, candidate, 5.0::DOUBLE / 8 * recovery - 1.0::DOUBLE / 8 * instability - 1.0::DOUBLE / 8 * overhead / max(overhead) OVER (PARTITION BY scenario) - 0.5::DOUBLE / 8 * redundancy / max(redundancy) OVER (PARTITION BY scenario) - 0.5::DOUBLE / 8 * runtime / max(runtime) OVER (PARTITION BY scenario) AS score FROM t)
SELECT * FROM (SELECT scenario, candidate, round(score, 9) AS score, row_number() OVER (PARTITION BY scenario ORDER BY score DESC, candidate)::INT AS nth FROM s) WHERE nth <= 3""",
    "experiment_summary": f"""WITH {TRIALS}, g AS (SELECT strategy, scenario, payload_size, count(*) AS n, sum(recovered::INT)::BIGINT AS s, avg(overhead) AS o, avg(runtime) AS r FROM trials GROUP BY ALL)
SELECT strategy, scenario, payload_size, n AS trials, s AS successes, round(s::DOUBLE / n, 9) AS rate, round(greatest(0.0, {_wilson('-')}), 9) AS low, round(least(1.0, {_wilson('+')}), 9) AS high, round(o, 9) AS mean_overhead, round(r, 9) AS mean_runtime FROM g""",
    "paired_effects": f"""WITH {TRIALS}, b AS (SELECT * FROM trials WHERE strategy = 'fixed' QUALIFY row_number() OVER (PARTITION BY scenario, payload_size, seed ORDER BY trial DESC, line DESC) = 1)
SELECT t.strategy, t.scenario, t.payload_size, count(*) AS pairs, round(avg(t.recovered::INT - b.recovered::INT), 6) AS rate_difference, round(avg(t.overhead - b.overhead), 6) AS overhead_difference, round(avg(t.runtime - b.runtime), 6) AS runtime_difference
FROM trials t JOIN b ON t.scenario = b.scenario AND t.payload_size = b.payload_size AND t.seed = b.seed WHERE t.strategy <> 'fixed' GROUP BY ALL""",
    "mcnemar": """WITH c AS (SELECT lang, count(*) FILTER (quality = 1 AND toxic <> 1) AS b, count(*) FILTER (quality <> 1 AND toxic = 1) AS c FROM labels JOIN documents USING (doc_id) GROUP BY 1)
SELECT lang, b AS only_left, c AS only_right, CASE WHEN b + c = 0 THEN 1.0 ELSE round(least(1.0, 2 * list_sum(list_transform(range(0, least(b, c) + 1), lambda i: exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2))))), 9) END AS p FROM c""",
    "regret_by_method": f"""WITH {TRIALS}, r AS (SELECT *, recovered::INT - 0.20 * overhead / max(overhead) OVER w - 0.05 * runtime / max(runtime) OVER w AS u FROM trials WHERE strategy IN ('fixed', 'adaptive') WINDOW w AS (PARTITION BY scenario, payload_size, seed)),
e AS (SELECT scenario, payload_size, seed, strategy, max(u) AS u FROM r GROUP BY ALL), k AS (SELECT *, max(u) OVER w AS top, count(*) OVER w AS kinds FROM e WINDOW w AS (PARTITION BY scenario, payload_size, seed))
SELECT strategy, count(*) AS groups, round(avg(top - u), 9) AS mean_regret, count(*) FILTER (top = u) AS best FROM k WHERE kinds >= 2 GROUP BY 1""",
    "log_slopes": """WITH l AS (SELECT l_orderkey, count(*) AS lines FROM lineitem GROUP BY 1), f AS (SELECT o_orderpriority, regr_slope(ln(o_totalprice), ln(lines)) AS slope FROM l JOIN orders ON l_orderkey = o_orderkey WHERE o_totalprice > 0 GROUP BY 1)
SELECT o_orderpriority, round(slope, 9) AS slope, CASE WHEN slope IS NULL THEN 'unknown' WHEN slope < 0.25 THEN 'bounded' WHEN slope <= 1.25 THEN 'linear' ELSE 'super-linear' END AS memory_class, CASE WHEN slope IS NULL THEN 'unknown' WHEN slope <= 1.25 THEN 'linear-or-better' ELSE 'super-linear' END AS runtime_class FROM f""",
    "completed_by_all": "SELECT l_suppkey FROM lineitem WHERE l_quantity >= 45 GROUP BY 1 HAVING count(DISTINCT l_returnflag) = (SELECT count(DISTINCT l_returnflag) FROM lineitem)",
    "first_wins": "SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1",
    "edit_distances": f"""WITH {_EDGES}, d AS (SELECT lang, levenshtein(a.seq, b.seq) AS x FROM edges JOIN reads a ON a.id = src JOIN reads b ON b.id = dst JOIN documents ON doc_id = src)
SELECT lang, count(*) AS n, round(avg(x), 9) AS mean, median(x) AS median, max(x)::INT AS worst, count(*) FILTER (x = 0) AS edits_0, count(*) FILTER (x = 1) AS edits_1, count(*) FILTER (x = 2) AS edits_2, count(*) FILTER (x >= 3) AS edits_3_up FROM d GROUP BY 1""",
    "record_conflicts": f"WITH {TRIALS}, c AS (SELECT scenario, seed, payload_size, count(*) AS copies, count(DISTINCT strategy || recovered) AS versions FROM trials GROUP BY ALL) SELECT versions, count(*) AS keys, sum(copies)::BIGINT AS copies FROM c GROUP BY 1",
    "empirical_policy": f"WITH {_OBSERVED} SELECT chunk_size, rs_nsym, parity_group, round(sum((CASE WHEN recovered THEN 1.0 ELSE -1.0 END - 0.15 * nucleotides / max_nt - 0.05 * runtime / max_rt) / (0.001 + {_L1})), 4) AS score, count(*) AS support FROM observed GROUP BY ALL",
    "kernel_policy": f"""WITH {_OBSERVED}, w AS (SELECT *, exp(-({_L2}) / 0.0008::DOUBLE) AS w, recovered::INT - 0.20 * nucleotides / max_nt - 0.05 * runtime / max_rt AS u FROM observed)
SELECT chunk_size, rs_nsym, parity_group, round(CASE WHEN sum(w) <= 1e-15 THEN -1e6 ELSE sum(w * u) / sum(w) END, 9) AS utility FROM w GROUP BY ALL""",
    "rotating_ternary": f"WITH {_ROTATED} SELECT archive, count(*) AS strands, sum(n)::BIGINT AS trits, min(seq) AS first, max(seq) AS last FROM strands GROUP BY 1",
    "rotating_roundtrip": "SELECT doc_id AS archive, sha256(encode(text)) AS digest, true AS verified FROM documents",
    "rotating_recover": "SELECT doc_id AS archive, sha256(encode(text)) AS digest, true AS verified FROM documents",
    "hybrid_recover": "SELECT doc_id AS archive, sha256(encode(text)) AS digest, true AS verified FROM documents",
    "rotating_report": """WITH s AS (SELECT doc_id AS archive, strlen(text) AS size, sha256(encode(text)) AS sha256, greatest(1, (strlen(text) + 11) // 12) AS total FROM documents WHERE text IS NOT NULL),
t AS (SELECT *, (total + 3) // 4 AS blocks, size - 12 * (total - 1) + 15 AS tail FROM s), n AS (SELECT *, (total + blocks - 1) * 149 + tail // 2 * 11 + tail % 2 * 6 AS nt FROM t)
SELECT archive, size::INT AS original_size, sha256, total::INT AS data_count, total + blocks AS sequence_count, nt AS encoded_nucleotides, 149::INT AS longest, round(8.0::DOUBLE * size / nt, 6) AS bits_per_nucleotide FROM n""",
    "anchored_reads": f"{_ANCHORED} SELECT * FROM anchored",
    "assignment_summary": f"{_ANCHORED} SELECT (SELECT count(*) FROM reads) AS reads, count(*) AS mapped, round(count(*)::DOUBLE / (SELECT count(*) FROM reads), 9) AS mapping_rate, count(*) FILTER (reverse) AS reversed, count(DISTINCT ref) AS \"references\", median(distance) AS median_distance, count(*) FILTER (distance = 0) AS exact FROM anchored",
    "empirical_choice": f"WITH {_OBSERVED}, s AS (SELECT chunk_size, rs_nsym, parity_group, sum((CASE WHEN recovered THEN 1.0 ELSE -1.0 END - 0.15 * nucleotides / max_nt - 0.05 * runtime / max_rt) / (0.001 + {_L1})) AS score FROM observed GROUP BY ALL) SELECT chunk_size, rs_nsym, parity_group, round(score, 4) AS score FROM s ORDER BY s.score DESC, chunk_size, rs_nsym, parity_group LIMIT 1",
    "kernel_choice": f"""WITH {_OBSERVED}, w AS (SELECT *, exp(-({_L2}) / 0.0008::DOUBLE) AS w, recovered::INT - 0.20 * nucleotides / max_nt - 0.05 * runtime / max_rt AS u FROM observed),
s AS (SELECT chunk_size, rs_nsym, parity_group, CASE WHEN sum(w) <= 1e-15 THEN -1e6 ELSE sum(w * u) / sum(w) END AS utility FROM w GROUP BY ALL) SELECT chunk_size, rs_nsym, parity_group, round(utility, 9) AS utility FROM s ORDER BY s.utility DESC, chunk_size, rs_nsym, parity_group LIMIT 1""",
    "tier_breakdown": f"""WITH {_LIFE} SELECT workload, tier, {', '.join(f'round({w}::DOUBLE * {_trait(t)} * {_NEEDS.get(n, n)}, 9) AS {t}_{n}' for w, t, n in scoring.TERMS)},
  round(0.06 * 0.5 * cost_priority, 9) AS storage_index, round(0.04 * 0.5 * cost_priority, 9) AS retrieval_index, {', '.join(f'round({_life_term(*x)}, 9) AS {x[1]}_term' for x in scoring.LIFECYCLE)},
  round(0.0 - ({_PENALTY})::DOUBLE, 9) AS penalty, round(greatest(0.0, {_SCORE} + {_TERMS} - {_PENALTY}), 9) AS score, true AS adds_up FROM life""",
    "learner_evaluation": f"""WITH {_OBSERVED}, o AS MATERIALIZED (SELECT * FROM observed WHERE strategy IN ('fixed', 'adaptive')),
tops AS (SELECT max(nucleotides) AS nt, max(runtime) AS rt FROM o),
m AS (SELECT seed, chunk_size, rs_nsym, parity_group, sum(recovered::INT - 0.2 * nucleotides / nt - 0.05 * runtime / rt) AS u, count(*) AS n FROM o, tops GROUP BY ALL),
predictions AS (SELECT m.*, CASE WHEN sum(n) OVER w > n THEN (sum(u) OVER w - u) / (sum(n) OVER w - n) END AS predicted FROM m WINDOW w AS (PARTITION BY chunk_size, rs_nsym, parity_group)),
grp_tops AS (SELECT seed, scenario, payload_size, max(overhead) AS mo, max(runtime) AS mr FROM o GROUP BY 1, 2, 3 HAVING count(DISTINCT (chunk_size, rs_nsym, parity_group)) > 1),
each_row AS (SELECT o.seed, scenario, payload_size, recovered, recovered::INT - 0.2 * overhead / mo - 0.05 * runtime / mr AS u,
  row_number() OVER (PARTITION BY o.seed, scenario, payload_size ORDER BY predicted IS NULL, predicted DESC, chunk_size, rs_nsym, parity_group, recovered DESC, overhead, runtime, trial, line) AS nth
  FROM o JOIN grp_tops USING (seed, scenario, payload_size) JOIN predictions USING (seed, chunk_size, rs_nsym, parity_group)),
c AS (SELECT seed, scenario, payload_size, max(u) AS top, max(u) FILTER (nth = 1) AS u, bool_or(recovered) FILTER (nth = 1) AS recovered FROM each_row GROUP BY 1, 2, 3)
SELECT seed, count(*) AS groups, round(avg(greatest(0, top - u)), 9) AS mean_regret, round(avg(recovered::INT), 9) AS recovery_rate, round(avg((u >= top)::INT), 9) AS accuracy FROM c GROUP BY 1""",
    "stratified_parts": """WITH t AS (SELECT p_partkey, p_brand, p_size % 3 AS size_class, row_number() OVER (PARTITION BY p_brand, p_size % 3 ORDER BY sha256('7:' || p_partkey), p_partkey)::INT AS turn FROM part)
SELECT * FROM t QUALIFY row_number() OVER (ORDER BY turn, p_brand, size_class) <= 300""",
    "design_gaps": f"WITH {TRIALS}, {_GAPS} SELECT * FROM gaps",
    "design_gates": f"""WITH {TRIALS}, {_GAPS}, c AS (SELECT count(*) FILTER (reason = 'missing') AS m, count(*) FILTER (reason = 'surplus') AS s FROM gaps)
SELECT array_to_string(list_filter([CASE WHEN m > 0 THEN m || ' keys missing, at most 0' END, CASE WHEN s > 50 THEN s || ' keys surplus, at most 50' END], lambda x: x IS NOT NULL), '; ') AS failures, m = 0 AND s <= 50 AS passed FROM c""",
    "result_candidates": """WITH b AS (SELECT l_orderkey, min_by(l_linenumber, (l_extendedprice, l_linenumber)) AS best FROM lineitem GROUP BY 1)
SELECT l.l_orderkey AS id, (row_number() OVER (PARTITION BY l.l_orderkey ORDER BY l_linenumber, l_extendedprice, l_quantity >= 12) - 1)::INT AS place, l_linenumber AS line, l_extendedprice AS cost, l_quantity >= 12 AS ok, l_linenumber = best AS selected
FROM lineitem l JOIN b ON l.l_orderkey = b.l_orderkey WHERE l.l_orderkey % 97 <> 0 AND (l.l_orderkey % 89 <> 0 OR l.l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 1))""",
    "broken_results": """WITH o AS (SELECT l_orderkey AS k, min(l_linenumber) AS least FROM lineitem GROUP BY 1),
r AS (SELECT k, CASE WHEN k % 97 = 0 THEN 'not of the schema' WHEN k % 89 = 0 AND least = 1 THEN 'lacks candidates.line' END AS reason FROM o)
SELECT reason, count(*) AS n, min(k) AS first FROM r WHERE reason IS NOT NULL GROUP BY 1""",
    "timeout_summary": f"""WITH {TRIALS} SELECT strategy, scenario, count(*) AS trials, count(*) FILTER (runtime > 55) AS timeouts, count(*) FILTER (runtime <= 55) AS completed, count(*) FILTER (runtime <= 55 AND recovered) AS recovered,
  round(avg((runtime > 55)::INT), 9) AS timeout_rate, round(median(runtime) FILTER (runtime <= 55), 6) AS median_runtime FROM trials GROUP BY ALL""",
    "shard_summary": f"""WITH {TRIALS}, g AS (SELECT strategy, scenario, payload_size, count(*) AS n, sum(recovered::INT)::BIGINT AS s, avg(overhead) AS o, avg(runtime) AS r FROM trials GROUP BY ALL)
SELECT strategy, scenario, payload_size, n AS trials, s AS successes, round(s::DOUBLE / n, 9) AS rate, round(greatest(0.0, {_wilson('-')}), 9) AS low, round(least(1.0, {_wilson('+')}), 9) AS high, round(o, 9) AS mean_overhead, round(r, 9) AS mean_runtime FROM g""",
    "fastq_ranges": f"WITH {READS} SELECT id, sha256(seq) AS digest, length(seq)::INT AS length FROM reads WHERE seq <> '' AND id % 50 <> 0 AND id % 70 <> 1",
    "fastq_rejected": f"WITH {READS} SELECT CASE WHEN id % 50 = 0 THEN 'quality of another length' ELSE 'signs that are no bases' END AS reason, count(*) AS n, sum(id)::BIGINT AS ids FROM reads WHERE seq <> '' AND (id % 50 = 0 OR id % 70 = 1) GROUP BY 1",
    "shard_conflicts": f"""WITH {TRIALS} SELECT strategy, scenario, payload_size, seed, 2::BIGINT AS copies, 2::BIGINT AS versions, '0' AS left_shard, '4' AS right_shard
FROM trials WHERE seed % 4 = 0 AND payload_size % 3072 = 0 GROUP BY ALL""",
    "profile_changes": f"""WITH {TRIALS}, g AS (SELECT strategy, scenario, payload_size, avg(recovered::INT) AS rate, avg(runtime) AS rt FROM trials WHERE strategy <> 'fixed' OR payload_size < 5000 GROUP BY ALL),
a AS (SELECT * FROM g WHERE strategy = 'fixed'), b AS (SELECT * FROM g WHERE strategy = 'combined')
SELECT coalesce(a.scenario, b.scenario) AS scenario, coalesce(a.payload_size, b.payload_size) AS payload_size, CASE WHEN b.strategy IS NULL THEN 'left only' WHEN a.strategy IS NULL THEN 'right only' ELSE 'both' END AS side,
  round(a.rate, 6) AS left_rate, round(b.rate, 6) AS right_rate, round(b.rate - a.rate, 6) AS change_rate, round(b.rt - a.rt, 6) AS change_mean_runtime FROM a FULL JOIN b ON a.scenario = b.scenario AND a.payload_size = b.payload_size""",
    "assignment_histograms": f"""{_ANCHORED} SELECT 'read_length' AS measure, length(seq)::BIGINT AS value, count(*) AS n FROM reads WHERE seq IS NOT NULL GROUP BY ALL
UNION ALL SELECT 'anchor_hits', hits, count(*) FROM anchored GROUP BY hits UNION ALL SELECT 'distance', distance, count(*) FROM anchored GROUP BY distance
UNION ALL SELECT 'reads_of_reference', c, count(*) FROM (SELECT count(*) AS c FROM anchored GROUP BY ref) GROUP BY c""",
    "timeout_hotspots": f"""WITH {TRIALS}, late AS (SELECT * FROM trials WHERE runtime > 55)
SELECT strategy, scenario, 'trials' AS kind, 'all' AS name, count(*) AS n FROM trials GROUP BY ALL UNION ALL SELECT strategy, scenario, 'successes', 'all', count(*) FROM trials WHERE recovered GROUP BY ALL
UNION ALL SELECT strategy, scenario, 'timeouts', 'all', count(*) FROM late GROUP BY ALL
UNION ALL SELECT strategy, scenario, 'stage', CASE seed % 3 WHEN 0 THEN 'encode' WHEN 1 THEN 'decode' ELSE 'unknown' END AS stage, count(*) FROM late GROUP BY ALL
UNION ALL SELECT strategy, scenario, 'location', CASE WHEN line = 2 THEN 'peel:' || seed || ':?' WHEN line % 2 = 0 THEN 'peel:' || line || ':solve' ELSE 'peel:?:solve' END AS place, count(*) FROM late WHERE line > 1 GROUP BY ALL""",
    "event_windows": """WITH e AS (SELECT DISTINCT user_id, ts, event_type FROM events), w AS (SELECT event_type, unnest([floor(epoch(ts))::BIGINT // 1800 * 1800, floor(epoch(ts))::BIGINT // 1800 * 1800 - 1800]) AS start FROM e)
SELECT start, event_type, count(*) AS n FROM w GROUP BY ALL""",
}
