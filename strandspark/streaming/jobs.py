"""Structured Streaming: events without repeats in windows, and repair of chunk streams as parity arrives."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def event_counts(events: DataFrame, late: str = "10 minutes", window: str = "1 hour", slide: str | None = None) -> DataFrame:
    """(start, event_type, n): events of a stream (user_id, ts, event_type), each (user, time, type) once, by window; what is later than the watermark is left out and its state let go."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicates(["user_id", "ts", "event_type"])
    counted = rows.groupBy(F.window("ts", window, slide or window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").alias("start"), "event_type", "n")


def repaired_stream(frames: DataFrame, group: int, width: int) -> DataFrame:
    """(archive, idx, payload, repaired) of a stream of frames (archive, kind data or parity, idx, total, payload): each data chunk the first time it comes, and a group's one
    missing chunk as soon as its parity and all others are there. A group's state is one XOR block and a bit for each chunk."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, block, parity, done = state.get if state.exists else (0, bytes(width), False, False)
        out = []
        for part in parts:
            for kind, idx, total, payload in part[["kind", "idx", "total", "payload"]].itertuples(index=False):
                own = bytes(payload)[:width].ljust(width, b"\0")
                size = min(group, int(total) - int(key[1]) * group)
                if kind == "parity" and not parity:
                    parity, block = True, bytes(a ^ b for a, b in zip(block, own, strict=True))
                elif kind == "data" and not seen >> (int(idx) % group) & 1:
                    seen, block = seen | 1 << int(idx) % group, bytes(a ^ b for a, b in zip(block, own, strict=True))
                    if not done:
                        out.append((key[0], int(idx), bytes(payload), False))
                missing = [k for k in range(size) if not seen >> k & 1]
                if parity and len(missing) == 1 and not done:
                    done = True
                    out.append((key[0], int(key[1]) * group + missing[0], block, True))
        state.update((seen, block, parity, done))
        yield pd.DataFrame(out, columns=["archive", "idx", "payload", "repaired"])

    grp = F.when(F.col("kind") == "parity", F.col("idx")).otherwise(F.floor(F.col("idx") / group)).cast("long")
    kind = frames.schema["archive"].dataType.simpleString()
    return frames.withColumn("grp", grp).groupBy("archive", "grp").applyInPandasWithState(
        run, f"archive {kind}, idx long, payload binary, repaired boolean", "seen long, block binary, parity boolean, done boolean", "append", GroupStateTimeout.NoTimeout
    )
