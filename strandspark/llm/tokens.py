"""Token-id files: flat unsigned integers with 64-bit document offsets, written by partition and memory-mapped.

Format, one pair of files for each partition in ascending document order: ids-NNNNN.bin holds the little-endian ids (16 bits where
the vocabulary allows, else 32) of whole documents, each closed by the end id; ids-NNNNN.idx holds rows of two little-endian
64-bit integers, document id and the count of ids of this file up to and with that document. A partition's base, the count of
ids before it, is a prefix sum over the partitions' totals.

Defined results: a null text is empty and gives the end id alone; a null document id is written as the smallest long, comes
first and reads back as null; rows of one id follow each other in the order of their texts' hashes, repeated rows are written as
often; very long texts are encoded whole; other columns are left out, so their names don't matter; empty input gives no files.
"""

from __future__ import annotations

import contextlib
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .runtime import shared_path, text_pieces

NO_ID = -(1 << 63)
#: Distinct units whose ids a worker remembers, in two generations.
REMEMBERED = 1_000_000


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Path of a public tokenizer's file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


#: Kinds of bytes between which the vocabulary's splitter always cuts: letters, digits, ASCII signs but the apostrophe. 0: no cut beside it.
_KIND = np.zeros(256, np.uint8)
_KIND[0x21:0x7F] = 3
_KIND[ord("'")] = 0
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = 1
_KIND[0x30:0x3A] = 2


def _units(raw: np.ndarray, offsets: np.ndarray, whole: bool) -> tuple[np.ndarray, np.ndarray]:
    """Spans that can be encoded by themselves: words at white space, and unless `whole` also cut between kinds. Latin letters of two bytes (C3 80 to C8 BF) count as letters, the signs among them (C3 97, C3 B7) as 0."""
    start, end = W.spans(raw, offsets)
    if whole or not len(start):
        return start, end
    kind = _KIND[raw]
    lead = np.flatnonzero((raw[:-1] >= 0xC3) & (raw[:-1] <= 0xC8))
    kind[lead] = kind[lead + 1] = ~((raw[lead] == 0xC3) & ((raw[lead + 1] == 0x97) | (raw[lead + 1] == 0xB7)))
    cut = (kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0)
    edge = offsets[1:-1]
    cut[edge[(edge > 0) & (edge < len(raw))] - 1] = False
    cut = np.flatnonzero(cut) + 1
    return np.sort(np.concatenate((start, cut))), np.sort(np.concatenate((end, cut)))


class _Known:
    """Ids of units by the units' hashes: ascending hashes, and beside each where its ids stand in a pool. Flat arrays hold a million units in some 25 MB."""

    def __init__(self, kind: type):
        self.key, self.at, self.length = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int32)
        self.pool, self.used = np.empty(1 << 16, kind), 0

    def __len__(self) -> int:
        return len(self.key)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, whether it is there) of each key."""
        if not len(self.key):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        place = np.minimum(np.searchsorted(self.key, keys), len(self.key) - 1)
        return place, self.key[place] == keys

    def add(self, keys: np.ndarray, ids: np.ndarray, length: np.ndarray) -> None:
        """Ascending keys that are not there yet, their ids one after the other."""
        size = len(self.pool)
        while self.used + len(ids) > size:
            size *= 2
        if size > len(self.pool):
            self.pool = np.concatenate((self.pool[: self.used], np.empty(size - self.used, self.pool.dtype)))
        self.pool[self.used : self.used + len(ids)] = ids
        at = self.used + np.cumsum(length) - length
        self.used += len(ids)
        where = np.searchsorted(self.key, keys)
        self.key, self.at, self.length = (np.insert(x, where, y) for x, y in ((self.key, keys), (self.at, at), (self.length, length)))

    def ids(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _gathered(self.pool, self.at[place], self.length[place].astype(np.int64))


def _gathered(pool: np.ndarray, at: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of a pool one after the other, and their lengths."""
    ends = np.cumsum(length)
    return pool[np.repeat(at - ends + length, length) + np.arange(int(length.sum()))], length


#: Units that the splitter takes as one word: Latin letters below U+0240 but the dotted capital I, whose lower case has a mark.
_ONE_WORD = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u023f]+")


class Encoder:
    """Ids of whole texts by the tokenizers library, for a vocabulary in lower case that drops white space and marks the ends of words. Its splitter never
    joins what _units parts, so each distinct unit is encoded once and remembered; where a special token's name stands in the
    text, units are whole words. New units that are single words go to the library many at a time, parted by spaces, and come
    apart at the ids that end words. Two generations of units are remembered: when the younger is full it becomes the older, and
    units met again move up, so that frequent ones are not lost and the memory is bounded."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(path)
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.kind = np.uint16 if len(vocabulary) <= 1 << 16 else np.uint32
        self.special = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.young, self.old = _Known(self.kind), _Known(self.kind)

    def _apart(self, texts: list[str]) -> Iterator[list[int]]:
        """The ids of each text; 500 at a time, as the library's results hold much more than ids."""
        for k in range(0, len(texts), 500):
            for found in self.library.encode_batch_fast(texts[k : k + 500], add_special_tokens=False):
                yield found.ids

    def _learned(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units one after the other, and their lengths."""
        if not all(map(_ONE_WORD.fullmatch, texts)):
            each = list(self._apart(texts))
            return np.array([i for x in each for i in x], self.kind), np.array([len(x) for x in each], np.int64)
        parts, lengths = [], []
        for k in range(0, len(texts), 500):
            some = texts[k : k + 500]
            ids = np.array(next(self._apart([" ".join(some)])), np.int64)
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != len(some) or ends[-1] != len(ids):
                each = list(self._apart(some))
                ids, ends = np.array([i for x in each for i in x], np.int64), np.cumsum([len(x) for x in each])
            parts.append(ids.astype(self.kind))
            lengths.append(np.diff(ends, prepend=0))
        return np.concatenate(parts), np.concatenate(lengths)

    def _slots(self, keys: np.ndarray, text_of) -> np.ndarray:
        """The places of ascending keys among the younger units, after what is missing there has come from the older ones or the library."""
        if len(self.young) and len(self.young) + len(keys) > REMEMBERED // 2:
            self.young, self.old = _Known(self.kind), self.young
        missing = np.flatnonzero(~self.young.find(keys)[1])
        if len(missing):
            place, there = self.old.find(keys[missing])
            if there.any():
                self.young.add(keys[missing[there]], *self.old.ids(place[there]))
            rest = missing[~there]
            texts = [text_of(k) for k in rest.tolist()]
            plain = np.fromiter((_ONE_WORD.fullmatch(t) is not None for t in texts), bool, len(texts))
            for chosen in (plain, ~plain):
                names = np.flatnonzero(chosen)
                if len(names):
                    self.young.add(keys[rest[names]], *self._learned([texts[k] for k in names.tolist()]))
        return self.young.find(keys)[0]

    def encode(self, raw: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a run of texts, end_id after each, and their offsets."""
        data = raw.tobytes()
        start, end = _units(raw, offsets, any(t in data for t in self.special))
        rows = len(offsets) - 1
        first = W.per_row(offsets, start)
        if not len(start):
            return np.full(rows, end_id, self.kind), np.arange(rows + 1)
        keys, example, inverse = np.unique(W.hashes(raw, start, end, W.LOWER), return_index=True, return_inverse=True)
        slot = self._slots(keys, lambda k: data[start[example[k]] : end[example[k]]].decode())[inverse]
        flat, n = _gathered(self.young.pool, self.young.at[slot], self.young.length[slot].astype(np.int64))
        bounds = np.concatenate(([0], np.cumsum(n)))[first]
        out = np.empty(len(flat) + rows, self.kind)
        out[np.arange(len(flat)) + np.repeat(np.arange(rows), np.diff(bounds))] = flat
        ends = bounds[1:] + np.arange(rows)
        out[ends] = end_id
        return out, np.concatenate(([0], ends + 1))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder for a vocabulary."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encoded(column: pa.Array, path: str, end_id: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of a text column: (first row, end row, ids, offsets)."""
    for first, end, raw, offsets in text_pieces(column):
        ids, bounds = encoder(path).encode(raw, offsets, end_id)
        yield first, end, ids, bounds


def _store(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if ":" in uri else (pafs.LocalFileSystem(), uri)


def write(docs: DataFrame, out: str | None = None, end_id: int = 2, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> tuple[str, list[tuple[str, int, int, int]]]:
    """Write all texts in ascending document order. Returns the folder and, for each file that has documents, (name, documents, ids, base).

    A task writes under a name of its own attempt and renames at its end, so a repeated or speculative task replaces its file
    with equal bytes."""
    tokenizer = tokenizer or vocabulary()
    out = out or shared_path(docs.sparkSession, "ids")

    def run(batches):
        store, folder = _store(out)
        store.create_dir(folder, recursive=True)
        task = TaskContext.get()
        name, own = f"ids-{task.partitionId():05d}", f".{task.taskAttemptId()}"
        total = count = 0
        with store.open_output_stream(f"{folder}/{name}.bin{own}") as data, store.open_output_stream(f"{folder}/{name}.idx{own}") as index:
            for batch in batches:
                for first, end, ids, bounds in encoded(batch.column(1), tokenizer, end_id):
                    data.write(ids.astype(ids.dtype.newbyteorder("<"), copy=False).tobytes())
                    rows = np.empty((end - first, 2), "<i8")
                    rows[:, 0] = batch.column(0).slice(first, end - first).fill_null(NO_ID).to_numpy()
                    rows[:, 1] = bounds[1:] + total
                    index.write(rows.tobytes())
                    total += int(bounds[-1])
                    count += end - first
        for kind in ("bin", "idx"):
            store.move(f"{folder}/{name}.{kind}{own}", f"{folder}/{name}.{kind}")
        yield pa.RecordBatch.from_pydict({"part": pa.array([task.partitionId()], pa.int32()), "name": [name], "docs": pa.array([count], pa.int64()), "ids": pa.array([total], pa.int64())})

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    # rows of one id, or of none, are spread by their texts' hashes, which also makes their order the same in every attempt
    order = [F.col("id").asc_nulls_first(), F.xxhash64("text").asc()]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    parts = ordered.mapInArrow(run, "part int, name string, docs long, ids long").collect()
    base, files = 0, []
    for r in sorted(parts, key=lambda r: r["part"]):  # sorted here: a range partitioning would run the writers twice
        if r["docs"]:
            files.append((r["name"], r["docs"], r["ids"], base))
        base += r["ids"]
    return out, files


@contextlib.contextmanager
def mapped(uri: str, kind):
    """A file's values as an array: memory-mapped where the store is a mounted folder, else read."""
    store, path = _store(uri)
    if isinstance(store, pafs.LocalFileSystem):
        yield np.memmap(path, kind, "r") if os.path.getsize(path) else np.empty(0, kind)
    else:
        with store.open_input_file(path) as f:
            yield np.frombuffer(f.read(), kind)


def read(spark: SparkSession, folder: str, files: list[tuple[str, int, int, int]], bits: int = 16, with_ids: bool = False) -> DataFrame:
    """(id, start, n_tokens, ids_crc32[, ids]) of every document of the files; start counts the ids of all documents before it."""
    kind = "<u2" if bits == 16 else "<u4"
    fields = "id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids

    def run(batches):
        for batch in batches:
            for k in batch.column(0).to_pylist():
                name, _, _, base = files[k]
                with mapped(f"{folder}/{name}.idx", "<i8") as index, mapped(f"{folder}/{name}.bin", kind) as data:
                    rows = index.reshape(-1, 2)
                    for a in range(0, len(rows), 2000):
                        part = np.asarray(rows[a : a + 2000])
                        start = np.concatenate(([rows[a - 1, 1] if a else 0], part[:-1, 1]))
                        own = [data[s:e].astype("<u4") for s, e in zip(start.tolist(), part[:, 1].tolist(), strict=True)]
                        columns = {"id": pa.array(part[:, 0], mask=part[:, 0] == NO_ID), "start": pa.array(start + base), "n_tokens": pa.array(part[:, 1] - start), "ids_crc32": pa.array([zlib.crc32(x.tobytes()) for x in own], pa.int64())}
                        if with_ids:
                            columns["ids"] = pa.array([x.astype(np.int32) for x in own], pa.list_(pa.int32()))
                        yield pa.RecordBatch.from_pydict(columns)

    return spark.range(0, len(files), 1, max(1, len(files))).mapInArrow(run, fields)


def bits_of(tokenizer: str | None = None) -> int:
    return 16 if encoder(tokenizer or vocabulary()).kind == np.uint16 else 32
