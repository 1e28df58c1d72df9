"""Shard files: repeats, conflicts, canonical signatures, metadata."""

import pytest
from pyspark.sql import functions as F

from strandspark.sources import shards

SCHEMA = "scenario string, size long, config struct<b: int, a: int, took: double>, scores array<struct<y: double, x: int>>, tags map<string, int>, took double"
ROW = ("s", 1, (2, 1, 0.5), [(0.1, 3)], {"k": 1, "l": 2}, 3.0)


def _write(spark, path, files):
    for shard, rows in files.items():
        df = spark.createDataFrame(rows, SCHEMA).withColumn("shard", F.lit(shard))
        df.write.mode("append").partitionBy("shard").option("ignoreNullFields", "false").json(path)
    return shards.read(spark, path, SCHEMA)


def test_repeats_merge_and_conflicts_do_not(spark, tmp_path):
    again = ("s", 1, (2, 1, 9.5), [(0.1, 3)], {"l": 2, "k": 1}, 8.0)  # other run times, another order
    other = [("t", 2, None, None, None, None), (None, None, (1, None, None), [], {}, 1.0)]
    wrong = ("u", 3, (1, 1, 1.0), [(0.1, 3)], {}, 1.0)
    rows = _write(spark, str(tmp_path / "x"), {0: [ROW, wrong, *other], 1: [again, ("u", 3, (1, 1, 1.0), [(0.2, 3)], {}, 1.0)], 2: [wrong, other[1]]})
    good, bad = shards.merged(rows, ["scenario", "size"], ["took"])
    got = {(r.scenario, r["size"]): r for r in good.collect()}
    assert {k: r.copies for k, r in got.items()} == {("s", 1): 2, ("t", 2): 1, (None, None): 2}
    assert got["s", 1].took == 3.0 and got["s", 1].config.took == 0.5  # those of the first file
    found = bad.collect()
    assert [(r.scenario, r["size"], r.copies, r.versions) for r in found] == [("u", 3, 3, 2)]
    assert {x.split("shard=")[1][0] for x in (found[0].left_file, found[0].right_file)} == {"0", "1"}
    with pytest.raises(shards.ShardConflict, match="scenario=u, size=3: 2 versions"):
        shards.checked(rows, ["scenario", "size"], ["took"])
    assert shards.checked(rows.filter("scenario <> 'u'"), ["scenario", "size"], ["took"]).count() == 2


def test_signature_depends_on_values_alone(spark):
    a = spark.createDataFrame([(1, (1, 2))], "p int, q struct<u: int, v: int>")
    b = spark.createDataFrame([((2, 1), 1, 7)], "q struct<v: int, u: int>, p int, z int")
    c = spark.createDataFrame([(1, (2, 1))], "p int, q struct<u: int, v: int>")
    sign = lambda df, out=(): df.select(shards.signature(df, list(out))).first()[0]
    assert sign(a) == sign(b, ["z"]) != sign(c) and sign(a) != sign(b)


def test_broken_shards_and_none(spark, tmp_path):
    (tmp_path / "y").mkdir()
    (tmp_path / "y" / "a.json").write_text('{"scenario": "s", "size": "many"}\n')
    with pytest.raises(Exception, match="MALFORMED_RECORD|Malformed|FAILFAST"):
        shards.read(spark, str(tmp_path / "y"), SCHEMA).collect()
    none = spark.createDataFrame([], f"{SCHEMA}, file string")
    assert [x.count() for x in shards.merged(none, ["scenario", "size"], ["took"])] == [0, 0]


def test_metadata_of_shards(spark):
    schema = "calibration array<int>, sizes array<int>, seeds array<int>, most int"
    rows = spark.createDataFrame([([1, 2], [1024], [3, 1], 5), ([1, 2], [512, 1024], [2], 9)], schema)
    assert tuple(shards.agreed(rows, ["calibration"], ["sizes", "seeds"], ["most"]).first()) == (2, [1, 2], [512, 1024], [1, 2, 3], 9, [])
    odd = rows.unionByName(spark.createDataFrame([([1], [], [], None)], schema))
    assert shards.agreed(odd, ["calibration"], ["sizes"], ["most"]).first().conflicts == ["calibration"]
    assert shards.agreed(rows.limit(0), ["calibration"], ["sizes"], ["most"]).count() == 0
