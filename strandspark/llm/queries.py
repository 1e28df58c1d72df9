"""The registered queries of this package and, where SQL can express them, their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ballkmeans, decontam, html, lexical, linededup, minhash, packing, quality, sharding, suffixes, tokens, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its near-duplicate class."""
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The expected severity of every document, by a model fitted on the labelled sample."""
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


def op3_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document less the lines that are boilerplate of its source."""
    return linededup.drop_lines(_table(spark, sf_dir, "documents").select("doc_id", "source", "text")).drop("source")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule ledger of every document and the current policy's verdict."""
    return quality.with_policies(quality.ledger(_table(spark, sf_dir, "documents")))


def op5_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all documents, written and read back."""
    folder, files = tokens.write(_table(spark, sf_dir, "documents"))
    return tokens.read(spark, folder, files, tokens.bits_of()).withColumnRenamed("id", "doc_id")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of a document and a benchmark item that stands in it."""
    return decontam.matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in sequences of 2048 tokens."""
    return packing.packed(_table(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every document."""
    return sharding.shards(_table(spark, sf_dir, "documents")).withColumnRenamed("key", "doc_id")


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html.extracted(_table(spark, sf_dir, "pages"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archive record of every page, read back from the archives."""
    folder, files = warc.write(_table(spark, sf_dir, "pages"))
    return warc.read(spark, folder, files)


def op11_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The code and the error of every vector, its label's error, and a digest of the codebooks."""
    table, books = ballkmeans.compressed(_table(spark, sf_dir, "embeddings"))
    code = F.lower(F.hex("codes")).alias("code")
    return ballkmeans.with_label_error(table).select(F.col("id").alias("vec_id"), code, "error", "label_error", F.lit(ballkmeans.fingerprint(books)).alias("codebooks_sha256"))


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty best documents of every benchmark item."""
    return lexical.ranked(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without strings of 100 bytes that occur earlier."""
    return suffixes.digest(_table(spark, sf_dir, "documents"))


def _codes_sql() -> str:
    """Assignment and update of each round as common tables; floor division of a sum s by n is (s - ((s % n) + n) % n) // n."""
    rounds = []
    for r in range(7):
        rounds.append(f"""
a{r} AS (SELECT id, label, part, min_by(entry, (d, entry)) AS entry, min(d) AS d FROM (
  SELECT p.id, p.label, p.part, entry, list_sum(list_transform(range(1, len(p.q) + 1), lambda i: (p.q[i] - c.q[i]) * (p.q[i] - c.q[i])))::BIGINT AS d FROM p JOIN c{r} c ON p.part = c.part) GROUP BY ALL),""")
        if r < 6:
            rounds.append(f"""
m{r} AS (SELECT part, entry, i, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT a.part, a.entry, unnest(p.q) AS x, unnest(range(1, len(p.q) + 1)) AS i FROM a{r} a JOIN p ON a.id = p.id AND a.part = p.part) GROUP BY ALL),
u{r} AS (SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY i) AS q FROM m{r} GROUP BY ALL),
c{r + 1} AS (SELECT c.part, c.entry, coalesce(u.q, c.q) AS q FROM c{r} c LEFT JOIN u{r} u ON c.part = u.part AND c.entry = u.entry),""")
    return f"""
WITH k AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT id, label, part, v[part * len(v) // 8 + 1:(part + 1) * len(v) // 8] AS q FROM k, range(8) t(part)),
c0 AS (SELECT part, row_number() OVER (PARTITION BY part ORDER BY id) - 1 AS entry, q FROM p QUALIFY entry < 16),{"".join(rounds)}
b AS (SELECT sha256(string_agg(array_to_string(q, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c6),
e AS (SELECT id AS vec_id, label, string_agg(format('{{:02x}}', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a6 GROUP BY ALL)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM e, b"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_toxicity, op2_minhash, op3_linededup, op4_quality, op5_tokens, op6_decontamination, op7_packing, op8_sharding, op9_html, op10_warc, op11_codes, op12_search, op13_suffixes)
}

SQL: dict[str, str] = {
    "op11_codes": _codes_sql(),
    "op12_search": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM benchmark),
z AS (SELECT count(*) AS n_docs, sum(len(ts))::BIGINT AS n_terms FROM d WHERE len(ts) > 0),
q AS (SELECT item_id, t, count(*) AS c FROM (SELECT item_id, unnest(ts) AS t FROM i) GROUP BY 1, 2),
p AS (SELECT doc_id, n, t, count(*) AS tf FROM (SELECT doc_id, len(ts) AS n, unnest(ts) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY 1, 2, 3),
f AS (SELECT t, count(*) AS df FROM p GROUP BY 1),
x AS (SELECT doc_id, p.t, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * n_docs) // n_terms))) AS v FROM p JOIN f ON p.t = f.t, z),
s AS (SELECT item_id, doc_id, sum(c * v)::BIGINT AS score FROM q JOIN x ON q.t = x.t GROUP BY 1, 2 HAVING sum(c * v) > 0)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM s QUALIFY rank <= 20""",
    "op13_suffixes": r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, unnest(list_transform(range(0, len(h) // 2 - 99), lambda i: {'i': i, 'w': substr(h, 2 * i + 1, 200)}), recursive := true) FROM d WHERE len(h) >= 200),
f AS (SELECT w, min((doc_id, i)) AS first FROM w GROUP BY 1),
k AS (SELECT doc_id, i, (doc_id, i) <> first AS later FROM w JOIN f ON w.w = f.w),
r AS (SELECT doc_id, i, i > coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100, -1) AS fresh FROM k WHERE later),
g AS (SELECT doc_id, i, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM r),
s AS (SELECT doc_id, span, min(i) AS a, max(i) + 100 AS b FROM g GROUP BY 1, 2),
e AS (SELECT s.doc_id, a, b, substr(h, 2 * coalesce(lag(b) OVER (PARTITION BY s.doc_id ORDER BY a), 0) + 1, 2 * (a - coalesce(lag(b) OVER (PARTITION BY s.doc_id ORDER BY a), 0))) AS ahead FROM s JOIN d ON s.doc_id = d.doc_id),
t AS (SELECT doc_id, count(*) AS n_spans, sum(b - a)::BIGINT AS n_removed, string_agg(ahead, '' ORDER BY a) AS ahead, max(b) AS b FROM e GROUP BY 1)
SELECT d.doc_id, len(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(ahead || substr(h, 2 * b + 1), h))) AS kept_sha256
FROM d LEFT JOIN t ON d.doc_id = t.doc_id""",
    "op2_minhash": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS sh FROM w),
u AS (SELECT sh, min(doc_id) AS rep FROM (SELECT doc_id, list_sort(sh) AS sh FROM s WHERE len(sh) > 0) GROUP BY sh),
e AS (SELECT rep, len(sh) AS n, unnest(sh) AS h FROM u),
shared AS (SELECT x.rep AS a, y.rep AS b, any_value(x.n) AS na, any_value(y.n) AS nb, count(*) AS c
  FROM e x JOIN e y ON x.h = y.h AND x.rep < y.rep GROUP BY 1, 2),
links AS (SELECT a, b FROM shared WHERE 100 * c >= 75 * (na + nb - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT rep, rep FROM u UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a),
classes AS (SELECT a AS rep, min(b) AS component FROM reach GROUP BY 1)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, coalesce(c.component, s.doc_id) AS component_id,
  coalesce(c.component, s.doc_id) = s.doc_id AS kept
FROM s LEFT JOIN u ON list_sort(s.sh) = u.sh LEFT JOIN classes c ON c.rep = u.rep""",
    "op3_linededup": r"""
WITH l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM documents),
t AS (SELECT doc_id, source, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS line FROM l),
hosts AS (SELECT source, count(*) AS host_pages FROM documents GROUP BY 1),
bad AS (SELECT t.source, line FROM t JOIN hosts h ON t.source IS NOT DISTINCT FROM h.source WHERE line <> ''
  GROUP BY t.source, line, host_pages HAVING count(DISTINCT doc_id) >= 2 AND count(DISTINCT doc_id) > 0.1 * host_pages),
sets AS (SELECT source, list(line) AS bad FROM bad GROUP BY 1)
SELECT doc_id,
  CASE WHEN text IS NULL THEN NULL ELSE array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT list_contains(coalesce(bad, []), regexp_replace(x, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'))), chr(10)) END AS text,
  CAST(coalesce(len(string_split(text, chr(10))), 0) AS BIGINT) AS n_lines,
  CAST(coalesce(len(list_filter(string_split(text, chr(10)), lambda x: list_contains(coalesce(bad, []), regexp_replace(x, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')))), 0) AS BIGINT) AS n_dropped
FROM documents d LEFT JOIN sets s ON d.source IS NOT DISTINCT FROM s.source""",
    "op4_quality": r"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, unnest(list_transform(range(1, len(ws) - 1), lambda i: {'k': i, 'g': array_to_string(ws[i:i + 2], ' ')}), recursive := true) FROM w WHERE len(ws) > 2),
r AS (SELECT doc_id, k FROM (SELECT doc_id, k, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1),
n AS (SELECT doc_id, count(*) AS n_repeat_words FROM (SELECT DISTINCT doc_id, unnest([k, k + 1, k + 2]) AS k FROM r) GROUP BY 1),
m AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM w LEFT JOIN n ON w.doc_id = n.doc_id),
f AS (SELECT doc_id, n_words, word_chars, n_symbols, CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, n_repeat_words FROM m),
b AS (SELECT *, CAST((n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (100 * n_symbols > 10 * n_words)::INT + 8 * (100 * n_dup_lines > 40 * n_lines)::INT
  + 16 * (10 * word_chars < 30 * n_words)::INT + 32 * (10 * word_chars > 120 * n_words)::INT AS BIGINT) AS failed FROM f)
SELECT *, failed & 3 <> 0 AS base_failed, failed = 0 AS kept FROM b""",
    "op8_sharding": r"""
WITH d AS (SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS bytes, ('0x' || md5(coalesce(CAST(doc_id AS VARCHAR), chr(0)))[1:8])::BIGINT AS h FROM documents),
p AS (SELECT doc_id, bytes, unnest(range(0, 33))::INT AS depth, h FROM d),
b AS (SELECT doc_id, bytes, depth, h >> (32 - depth) AS bucket, sum(bytes) OVER (PARTITION BY depth, h >> (32 - depth)) AS total FROM p),
f AS (SELECT * FROM b WHERE total <= 4194304 OR depth = 32 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY depth) = 1)
SELECT doc_id, bytes, depth, right(lpad(bin(bucket), 40, '0'), depth) AS shard,
  CASE WHEN total <= 4194304 THEN 0 ELSE row_number() OVER (PARTITION BY depth, bucket ORDER BY bytes) END::INT AS part,
  CAST(CASE WHEN total <= 4194304 THEN total ELSE bytes END AS BIGINT) AS shard_bytes
FROM f""",
}
