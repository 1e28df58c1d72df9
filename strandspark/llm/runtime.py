"""Shared folders, durable intermediates and size-checked broadcasts for the operators of this package."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join with at most so many rows of one or two longs (32 MB) is broadcast; a larger one is shuffled.
BROADCAST_ROWS = 2_000_000


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where it is unset on a local master a new temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def kept_table(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts the lineage and survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table from kept_table that nothing reads any more."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def small(ids: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint for a table of keys, given only when its count is within `most`."""
    return F.broadcast(ids) if ids.limit(most + 1).count() <= most else ids


def weighted_join(rows: DataFrame, table: DataFrame, keys: list[str], weight: str, how: str = "inner", total: int | None = None) -> DataFrame:
    """rows joined with a kept table that has one row for each key and in `weight` how many rows have it. The keys of more than a 10,000th of the total weight, of which there are at most 10,000, are
    broadcast, so that no task gets all rows of a hot key; the others meet in a broadcast within BROADCAST_ROWS or a shuffle."""
    most = (total if total is not None else table.agg(F.sum(weight)).first()[0] or 0) / 10_000
    hot, rest = F.broadcast(table.filter(F.col(weight) > most)), table.filter(F.col(weight) <= most)
    cold = rows.join(hot.select(*keys), keys, "left_anti")
    return rows.join(hot, keys).unionByName(cold.join(small(rest), keys, how))


def free_name(df: DataFrame, name: str) -> str:
    """name, or name with underscores behind it until df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_pieces(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string column into runs of whole rows of about `most` bytes: (first row, end row, bytes, offsets). A null counts as empty; a longer row comes alone."""
    column = column.cast(pa.large_string()) if column.type != pa.large_string() else column
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    first = 0
    while first < n:
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        end = min(end, n)
        yield first, end, raw[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def one_column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def filtered_rows(docs: DataFrame, text_col: str, keep) -> DataFrame:
    """The rows of docs for which keep says so; keep: (bytes, offsets) of a run of texts -> booleans. Rows are judged one by one, so ids may be null or repeated and columns may have any names."""
    place = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            good = [keep(raw, offsets) for _, _, raw, offsets in text_pieces(batch.column(place))]
            if good:
                yield batch.filter(pa.array(np.concatenate(good)))

    return docs.mapInArrow(run, docs.schema)
