"""Readers, sinks, streaming jobs and commands on small files."""

import gzip
import json
import random

import pytest
from pyspark.sql import functions as F

from strandspark import cli
from strandspark.sources import sequences as S
from strandspark.streaming import jobs


def test_fasta_and_fastq(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(">x\nacg\nT\n>y\nGG\n")
    with gzip.open(tmp_path / "b.fastq.gz", "wt") as f:
        f.write("@r\nACGT\n+\nIIII\n@s\nAC\n+s\nII\n")
    (tmp_path / "c.fa").write_text("")
    got = sorted((r.path.rsplit("/", 1)[1], r.ordinal, r.seq) for r in S.sequences(spark, str(tmp_path)).collect())
    assert got == [("a.fasta", 0, "ACGT"), ("a.fasta", 1, "GG"), ("b.fastq.gz", 0, "ACGT"), ("b.fastq.gz", 1, "AC")]
    assert S.sequences(spark, str(tmp_path), 1).count() == 2


@pytest.mark.parametrize("text", ["@r\nACGT\n+\nIII\n", "@r\nACGT\n+\n", "@r\nACGT\n-\nIIII\n", ">x\n>y\nAC\n", "ACGT\n"])
def test_malformed_files_fail(tmp_path, text):
    p = tmp_path / "x"
    p.write_text(text)
    with pytest.raises(S.FormatError):
        list(S.fasta_or_fastq(p.as_uri()))


def test_cluster_and_binned_files(spark, tmp_path):
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "x").write_text("=====\nAC\nGT\n=====\n=====\nTT\n")
    assert sorted((r.cluster, r.ordinal, r.seq) for r in S.cluster_file(spark, str(tmp_path / "c")).collect()) == [(0, 0, "AC"), (0, 1, "GT"), (1, 0, None), (2, 0, "TT")]
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "x").write_text("ACGT\n****\nACG\nACGT\n\nTT\n*\nT\n")
    assert sorted((r.cluster, r.reference, r.seq) for r in S.binned_file(spark, str(tmp_path / "b")).collect()) == [(0, "ACGT", "ACG"), (0, "ACGT", "ACGT"), (1, "TT", "T")]


def test_container_archive_and_sinks(spark, tmp_path):
    (tmp_path / "k").mkdir()
    (tmp_path / "k" / "x").write_bytes(S.container_bytes({"b": 1, "a": 2}, [b"\x1b", b"\x00\xff"]))
    got = S.container(spark, str(tmp_path / "k")).orderBy("ordinal").collect()
    assert [(r.metadata, r.seq) for r in got] == [('{"a": 2, "b": 1}', "ACGT"), ('{"a": 2, "b": 1}', "AAAATTTT")]
    with pytest.raises(S.FormatError):
        (tmp_path / "bad").write_bytes(S.container_bytes({}, [b"abc"])[:-1])
        list(S._container((tmp_path / "bad").as_uri()))
    body = {"metadata": {"format": "x", "original_size": 3, "sha256": "zz", "data_strands": 3, "parity_strands": 0, "fountain_strands": 0}, "strands": ["ACGT", "ACX"]}
    (tmp_path / "j.json").write_text(json.dumps(body, indent=1))
    problems = S.archive_problems(*S.archive_json(spark, str(tmp_path / "j.json"))).collect()
    assert len(problems) == 3
    strands = spark.createDataFrame([(1, "data", 0, "ACGT"), (0, "parity", 0, "GGGG")], "ordinal long, kind string, idx long, seq string")
    S.write_fasta(strands.coalesce(1), str(tmp_path / "f"))
    assert [r.seq for r in S.sequences(spark, str(tmp_path / "f" / "*.txt")).orderBy("ordinal").collect()] == ["GGGG", "ACGT"]
    S.write_oligo_csv(strands, str(tmp_path / "o"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "o")).count() == 2
    files = S.file_manifest(spark, str(tmp_path / "k"))
    want = files.select(F.lit("x").alias("name"), "sha256").unionByName(spark.createDataFrame([("y", "00")], "name string, sha256 string"))
    assert {r.name: r.ok for r in S.checked(files, want).collect()} == {"x": True, "y": False}


def test_archive_json_sink(spark, tmp_path):
    meta = spark.createDataFrame([("a/1", "x", 5, "ab" * 32, 3, 0, None), ("b", "x", 0, "cd" * 32, 0, 0, 0)], "archive string, format string, original_size long, sha256 string, data_strands long, parity_strands long, fountain_strands long")
    strands = spark.createDataFrame([("a/1", n, s) for n, s in ((2, "GG"), (0, "AC"), (10, "TT"))] + [("lost", 0, "A")], "archive string, ordinal long, seq string")
    out = str(tmp_path / "json")
    S.write_archive_json(meta, strands, out)
    back, own = S.archive_json(spark, out)
    assert sorted((r.sha256, r.original_size, r.data_strands, r.fountain_strands) for r in back.collect()) == [("ab" * 32, 5, 3, None), ("cd" * 32, 0, 0, 0)]
    assert [r.seq for r in own.orderBy("ordinal").collect()] == ["AC", "GG", "TT"]


def test_dataset_manifests(spark, tmp_path):
    import json

    good = {"dataset": "d", "doi": "10.1/x", "bioproject": "P", "run_accessions": ["R1", "R2"], "data_restrictions": "none", "reference_mapping_status": "mapped", "notes": ""}
    bad = {k: v for k, v in good.items() if k != "doi"} | {"dataset": "e", "run_accessions": ["R1", None]}
    for k, m in enumerate((good, bad)):
        (tmp_path / f"{k}.json").write_text(json.dumps(m, indent=2))
    got = {r.dataset: r for r in S.dataset_manifest(spark, str(tmp_path)).collect()}
    assert got["d"].problems == [] and got["d"].run_accessions == ["R1", "R2"] and got["d"].path.endswith("0.json")
    assert got["e"].problems == ["doi", "run_accessions"]


def test_event_stream(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    stream = spark.readStream.schema(events.schema).parquet("/root/testdata/sf0.001/events*.parquet")
    q = jobs.event_counts(stream).writeStream.outputMode("append").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    batch = jobs.event_counts(events)
    got = {(r.start, r.event_type): r.n for r in spark.table("counts").collect()}
    want = {(r.start, r.event_type): r.n for r in batch.collect()}
    assert got and all(want[k] == n for k, n in got.items())


def test_repair_stream(spark, tmp_path):
    from strandspark.operators import erasure

    p = spark.createDataFrame([("a", b"0123456789abcdefXYZ")], "archive string, payload binary")
    chunks = erasure.chunks(p, 4)
    par = erasure.parity(chunks, 2, 4).selectExpr("archive", "'parity' kind", "cast(grp as long) idx", "5 total", "payload")
    sent = chunks.filter("idx <> 2").selectExpr("archive", "'data' kind", "cast(idx as long) idx", "total", "payload").unionByName(par)
    sent.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(sent.schema).parquet(str(tmp_path / "in"))
    q = jobs.repaired_stream(stream, 2, 4).writeStream.outputMode("append").format("memory").queryName("fixed").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = {r.idx: (bytes(r.payload), r.repaired) for r in spark.table("fixed").collect()}
    assert got[2] == (b"89ab", True) and got[0] == (b"0123", False) and sorted(got) == [0, 1, 2, 3, 4]


def test_commands(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.txt").write_bytes(b"some words to keep for a long while" * 3)
    a, r, o = (str(tmp_path / x) for x in ("archive", "reads", "out"))
    cli.main(["encode", str(tmp_path / "in"), a, "--profile", "200-compact"])
    cli.main(["simulate", a, r, "--substitution", "0.001", "--copies", "3"])
    cli.main(["recover", a, o, "--reads", r])
    got = spark.read.parquet(o).collect()
    assert got[0].verified and bytes(got[0].payload).startswith(b"some words")
    cli.main(["inspect", a])


def _file_bytes(n):
    return bytes((7 * k + k // 251) % 256 for k in range(n))


def test_byte_ranges_of_any_split(spark, tmp_path):
    """The same chunks for any span; empty files are one empty chunk; no partition has more than its range."""
    from strandspark.sources import ranges

    (tmp_path / "sub").mkdir()
    want = {"a.bin": _file_bytes(10_007), "sub/b.bin": _file_bytes(64), "empty": b""}
    for name, data in want.items():
        (tmp_path / name).write_bytes(data)
    spark.dataSource.register(ranges.ByteRanges)
    for span in (1, 3, 1000):
        df = spark.read.format("byteranges").option("path", str(tmp_path)).option("chunk", 64).option("span", span).load()
        rows = sorted((r.file, r.idx, bytes(r.payload), r.size) for r in df.collect())
        assert {f: b"".join(p for g, _, p, _ in rows if g == f) for f in want} == want
        assert [i for f, i, _, _ in rows if f == "a.bin"] == list(range(157)) and all(s == len(want[f]) for f, _, _, s in rows)
        if span == 3:
            assert df.rdd.getNumPartitions() == 53 + 1 + 1


def test_parts_under_a_manifest(spark, tmp_path):
    """Files written in parts come back chunk by chunk; missing chunks are refused on writing, torn or foreign parts on reading; parts without a manifest are no bundle."""
    import json

    from strandspark.sources import ranges

    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    want = {"a": _file_bytes(5000), "b": b"short", "empty": b""}
    for name, data in want.items():
        (source / name).write_bytes(data)
    spark.dataSource.register(ranges.ByteRanges)
    chunks = spark.read.format("byteranges").option("path", str(source)).option("chunk", 100).load().repartition(7)
    ranges.written(chunks, str(out), span=8)
    back = ranges.read_back(spark, str(out))
    rows = sorted((r.file, r.idx, bytes(r.payload)) for r in back.collect())
    assert {f: b"".join(p for g, _, p in rows if g == f) for f in want} == want and rows == sorted((r.file, r.idx, bytes(r.payload)) for r in chunks.collect())
    made = ranges.manifest(str(out))
    digest = {r.file: r.digest for r in ranges.file_digests(ranges.digests(chunks, 8)).collect()}
    assert digest == {f["file"]: f["digest"] for f in made["files"]} and {f["file"]: f["size"] for f in made["files"]} == {k: len(v) for k, v in want.items()}
    assert all(p["chunks"] <= 8 for f in made["files"] for p in f["parts"])
    with pytest.raises(Exception, match="missing"):
        ranges.written(chunks.filter("not (file = 'a' and idx = 20)"), str(tmp_path / "gap"), span=8)
    assert not (tmp_path / "gap" / "manifest.json").exists()
    with pytest.raises(Exception, match="(?i)no such file|not exist|cannot open"):
        ranges.read_back(spark, str(tmp_path / "gap")).collect()
    part = out / next(p["name"] for f in made["files"] for p in f["parts"] if f["file"] == "a")
    data = part.read_bytes()
    part.write_bytes(data[:-1] + bytes([data[-1] ^ 1]))
    with pytest.raises(Exception, match="torn"):
        ranges.read_back(spark, str(out)).collect()
    part.write_bytes(data)
    made["files"][0]["parts"][0]["digest"] = "00" * 32
    (out / "manifest.json").write_text(json.dumps(made))
    with pytest.raises(Exception, match="digest"):
        ranges.read_back(spark, str(out)).collect()


def test_concatenation_of_rows(spark):
    """Rows of any size make one stream of chunks, in order, across partitions; nulls and empties add nothing."""
    from strandspark.plans.store import kept
    from strandspark.sources import ranges

    rng = random.Random(4)
    rows = [(k, None if k % 11 == 3 else rng.randbytes(rng.choice([0, 1, 5, 63, 64, 65, 700]))) for k in range(200)] + [(200, b"same"), (200, b"same")]
    df = spark.createDataFrame(rows, "k long, data binary").repartition(6)
    got = ranges.concatenated(df, ["k"], "data", 64, kept).orderBy("idx").collect()
    whole = b"".join(x or b"" for _, x in sorted(rows, key=lambda r: r[0]))
    assert [r.idx for r in got] == list(range(-(-len(whole) // 64))) and b"".join(bytes(r.payload) for r in got) == whole and all(len(r.payload) == 64 for r in got[:-1])
    assert ranges.concatenated(df.limit(0), ["k"], "data", 64, kept).count() == 0
