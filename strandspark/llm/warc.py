"""WARC archives under Zstandard with a shared dictionary, written and read by partition.

File format (.warc.zst): a skippable frame (magic 184D2A5D) holds the dictionary, itself a Zstandard frame or raw; then one frame
with content size and checksum for each record. A record is a WARC/1.1 header, an empty line, the block, and two empty lines.

Of pages with equal payloads that with the smallest id is a response; the others are revisits, which refer to it and hold no
payload. Payloads below min_revisit bytes are all responses.

Defined results: a null page is an empty payload; a null id can't be referred to: such rows are responses; repeated rows of
one id and payload are all responses where that id is the smallest, and share their record's id; rows of one id with different
payloads are told apart by their digests; a null url is written without a target and reads back as null; line feeds in a url are
percent-coded in the standard header and kept exactly in one of our own; very long pages are one record each; an empty table gives
no archives and no rows; other columns are left out, whatever they are called.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import free_name, kept_table, shared_path, small, weighted_join
from .tokens import _store

MAGIC = 0x184D2A5D
ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"
#: A dictionary is trained on at most so many pages, each cut to this many bytes, and is at most so large.
SAMPLE_PAGES, SAMPLE_BYTES, DICTIONARY_BYTES = 400, 16_384, 65_536
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = datetime(2024, 1, 1, tzinfo=timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


class WarcError(ValueError):
    """An archive that breaks the format."""


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def train_dictionary(pages: DataFrame, html_col: str = "html") -> bytes:
    """A dictionary from a bounded sample of pages, or nothing where they are too few to train on."""
    text = F.col(html_col)
    thin = pages.filter(F.octet_length(text) > 64).select(F.xxhash64(text).alias("h"))
    # the smallest hashes of different pages tell which to read; the pages themselves are then at most SAMPLE_PAGES
    chosen = [r["h"] for r in thin.groupBy("h").agg(F.lit(1)).select("h").orderBy("h").limit(SAMPLE_PAGES).collect()]
    if len(chosen) < 16:
        return b""
    rows = pages.filter(F.xxhash64(text) <= max(chosen)).filter(F.octet_length(text) > 64).groupBy(F.xxhash64(text).alias("h")).agg(F.min(F.substring(F.encode(text, "UTF-8"), 1, SAMPLE_BYTES)).alias("x")).orderBy("h").collect()
    samples = [bytes(r["x"]) for r in rows]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:  # samples too alike or too small
        return b""


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, digest: str, length: int, refers_to: int | None) -> bytes:
    """The bytes of one record; a revisit's block is empty and its payload's length stands in a header of our own."""
    exact = None
    target = None if url is None else url.encode().decode("latin-1").replace("\r", "%0D").replace("\n", "%0A")
    if target is not None and (target != url.encode().decode("latin-1") or target != target.strip(" \t")):
        exact = base64.b64encode(url.encode()).decode()  # a header line can't hold it as it is
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>", f"WARC-Date: {_DATE}"]
    if target is not None:
        lines.append(f"WARC-Target-URI: {target}")
        if exact:
            lines.append(f"X-Target-URI-Base64: {exact}")
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    block = payload
    if kind == "revisit":
        block = b""
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += [f"X-Payload-Length: {length}", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("latin-1") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and block of a record's bytes; the version, the names, the lengths and the end are checked."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("latin-1").split("\r\n")
    if not gap or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise WarcError("no WARC record")
    headers: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name.strip() or name.lower() in headers:
            raise WarcError(f"bad header line: {line[:80]!r}")
        headers[name.lower()] = value.strip(" \t")
    missing = {"warc-type", "warc-record-id", "warc-date", "content-length"} - headers.keys()
    if missing:
        raise WarcError(f"headers missing: {sorted(missing)}")
    if not headers["content-length"].isdigit() or len(rest) != int(headers["content-length"]) + 4 or not rest.endswith(b"\r\n\r\n"):
        raise WarcError("length differs from Content-Length")
    return headers, rest[:-4]


def header_frame(dictionary: bytes) -> bytes:
    """The leading skippable frame with the dictionary, compressed."""
    body = zstandard.ZstdCompressor(level=12).compress(dictionary) if dictionary else b""
    return struct.pack("<II", MAGIC, len(body)) + body


class Reader:
    """Records of an archive, one frame at a time."""

    def __init__(self, stream, most: int = 1 << 31):
        self.stream, self.most, self.rest = stream, most, b""
        head = stream.read(8)
        if len(head) < 8 or struct.unpack("<II", head)[0] != MAGIC:
            raise WarcError("no leading dictionary frame")
        size = struct.unpack("<II", head)[1]
        body = stream.read(size)
        if len(body) != size:
            raise WarcError("the dictionary frame is cut off")
        if body.startswith(ZSTD_MAGIC):
            body = zstandard.ZstdDecompressor().decompress(body, max_output_size=1 << 27)
        self.own = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(body)) if body else zstandard.ZstdDecompressor()

    def __iter__(self) -> Iterator[tuple[dict[str, str], bytes]]:
        data = self.rest or self.stream.read(1 << 20)
        while data:
            if not (data.startswith(ZSTD_MAGIC) or ZSTD_MAGIC.startswith(data[:4])):
                raise WarcError("no Zstandard frame")
            frame, parts, size = self.own.decompressobj(), [], 0
            while True:
                parts.append(frame.decompress(data))
                size += len(parts[-1])
                if size > self.most:
                    raise WarcError("a record is too long")
                if frame.eof:
                    data = frame.unused_data or self.stream.read(1 << 20)
                    break
                data = self.stream.read(1 << 20)
                if not data:
                    raise WarcError("a frame is cut off")
            yield parse(b"".join(parts))


def deduplicated(pages: DataFrame, first: str, min_revisit: int = 0, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """pages with a column `first`: the smallest id of the rows with the same payload, where it is not their own. Digests and ids are summed up before the shuffle; only the rows above their payload's first
    come back, by id and digest, so a payload that many rows share is no hot key of a join with the pages, and rows of one id keep each their own payload."""
    sha = F.sha1(F.coalesce(F.encode(F.col(html_col), "UTF-8"), F.lit(b"")))
    rows = kept_table(pages.select(F.col(id_col).cast("long").alias("id"), sha.alias("sha"), F.coalesce(F.octet_length(html_col), F.lit(0)).alias("size")), "digests")
    rows = rows.filter((F.col("size") >= min_revisit) & F.col("id").isNotNull()).select("id", "sha")
    firsts = rows.groupBy("sha").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.count(F.lit(1)).alias("n")).filter("least < most")
    again = weighted_join(rows, kept_table(firsts, "payloads"), ["sha"], "n", total=rows.count()).filter("id > least").select("id", "sha", "least").distinct()
    id_, sha_ = free_name(pages, "_id"), free_name(pages, "_sha")
    again = small(kept_table(again.select(F.col("id").alias(id_), F.col("sha").alias(sha_), F.col("least").alias(first)), "revisits"), 500_000)
    return pages.join(again, (pages[id_col].cast("long") == F.col(id_)) & (sha == F.col(sha_)), "left").drop(id_, sha_)


def write(pages: DataFrame, folder: str | None = None, min_revisit: int = 0, level: int = 3, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> tuple[str, list[str]]:
    """Write a record for each row into one archive per partition. Returns the folder and the file names. A repeated task replaces its file."""
    folder = folder or shared_path(pages.sparkSession, "warc")
    dictionary = train_dictionary(pages, html_col)
    first = free_name(pages, "first")
    rows = deduplicated(pages, first, min_revisit, id_col, html_col).select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"), F.col(first).alias("first"))

    def run(batches):
        store, path = _store(folder)
        store.create_dir(path, recursive=True)
        task = TaskContext.get()
        name = f"pages-{task.partitionId():05d}.warc.zst"
        own = f"{path}/{name}.{task.taskAttemptId()}"
        packer = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_checksum=True, write_content_size=True)
        n = 0
        with store.open_output_stream(own, compression=None) as out:
            out.write(header_frame(dictionary))
            for batch in batches:
                for k in range(batch.num_rows):
                    page_id, url, page, of = (batch.column(c)[k].as_py() for c in range(4))
                    payload = (page or "").encode()
                    out.write(packer.compress(record("response" if of is None else "revisit", page_id, url, payload, payload_digest(payload), len(payload), of)))
                    n += 1
        store.move(own, f"{path}/{name}")
        yield pa.RecordBatch.from_pydict({"name": [name], "n": pa.array([n], pa.int64())})

    files = rows.mapInArrow(run, "name string, n long").collect()
    return folder, sorted(r["name"] for r in files if r["n"])


_FIELDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _number(value: str | None) -> int | None:
    return None if value is None or value == "<urn:page:null>" else int(value.removeprefix("<urn:page:").removesuffix(">"))


def read(spark: SparkSession, folder: str, files: list[str], with_payload: bool = False) -> DataFrame:
    """The records of archives as rows; a response's payload is checked against its digest and length."""

    def run(batches):
        for batch in batches:
            for k in batch.column(0).to_pylist():
                store, path = _store(folder)
                with store.open_input_stream(f"{path}/{files[k]}", compression=None) as stream:
                    rows: list[tuple] = []
                    size = 0
                    for headers, block in Reader(stream):
                        kind, digest = headers["warc-type"], headers["warc-payload-digest"].removeprefix("sha1:")
                        if kind == "response" and (payload_digest(block) != digest or len(block) != int(headers["x-payload-length"])):
                            raise WarcError(f"payload differs from its digest: {headers['warc-record-id']}")
                        url = headers.get("warc-target-uri")
                        if "x-target-uri-base64" in headers:
                            url = base64.b64decode(headers["x-target-uri-base64"]).decode("utf-8").encode().decode("latin-1")
                        rows.append((_number(headers["warc-record-id"]), url and url.encode("latin-1").decode(), int(headers["x-payload-length"]), digest, kind, _number(headers.get("warc-refers-to")), *([block] if with_payload else [])))
                        size += len(block)
                        if len(rows) == 2000 or size > 1 << 24:
                            yield _batch(rows, with_payload)
                            rows, size = [], 0
                    if rows:
                        yield _batch(rows, with_payload)

    return spark.range(0, len(files), 1, max(1, len(files))).mapInArrow(run, _FIELDS + ", payload binary" * with_payload)


def _batch(rows: list[tuple], with_payload: bool) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), *([pa.binary()] if with_payload else [])]
    names = [x.split()[0] for x in _FIELDS.split(", ")] + ["payload"] * with_payload
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
