"""WARC records in seekable Zstandard bundles.

Records are grouped into independent Zstandard frames; a bundle is a file of frames that ends in a
seek table, a skippable frame with the compressed and plain size of every frame (the public
seekable layout), so any Zstandard tool reads the whole file and a reader that wants one record
reads one frame. The index maps each record id to bundle, frame and the offset inside the frame.

Payloads are compared by SHA-256 in the JVM. Only digests that occur under several page ids go on,
with the smallest id: a table of fixed-width rows, broadcast while it is small by count, else joined
with salted keys, so that no hot payload lands in one task; pages are never grouped. A task writes
the bundles of its rows and yields their index rows. Bundle names are new in every attempt, and
readers go by the index, which Spark commits, so files of lost attempts are never read.

Bundles are written and read through ``pyarrow.fs`` below the folder given, which must be one that
all executors see and pyarrow knows (``file``, ``s3``, ``gs``, ``hdfs``); without a folder it is
``spark.checkpoint.dir``.

Defined results: a NULL html is an empty payload; a NULL url has no target header, and control
characters and spaces of a url are percent-encoded; rows with the smallest page id of equal payloads
are all ``response`` (repeated rows too); a NULL page id counts as larger than any, and payloads that
occur under NULL ids only are all ``response``; empty tables give no records and no bundle. Columns
other than ``page_id``, ``url`` and ``html`` are not read.
"""

from __future__ import annotations

import hashlib
import struct
from typing import NamedTuple
from uuid import NAMESPACE_URL, uuid4, uuid5

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusprep.llm.common import fixed, map_rows, small_side
from corpusprep.session import ensure_checkpoint_dir

# Fixed values of the formats.
SEEK_MAGIC, SEEK_FOOTER, SKIPPABLE = 0x8F92EAB1, struct.Struct("<IBI"), struct.Struct("<II")
SKIPPABLE_MAGIC = 0x184D2A5E
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Plain bytes after which a frame ends, and compressed bytes after which a bundle ends.
FRAME_BYTES = 1 << 18
BUNDLE_BYTES = 1 << 26
#: Payloads below this many bytes are always stored.
MIN_REVISIT = 100
#: Ways a hot digest is dealt out where the table of repeated digests is not broadcast.
SALT = 16

INDEX = "record_id string, page_id long, bundle string, frame int, frame_start long, frame_bytes long, offset long, length long"


class Record(NamedTuple):
    record_id: str
    page_id: int | None
    url: str | None
    record_type: str
    refers_to: int | None
    payload: bytes
    payload_bytes: int
    payload_digest: str


def record_id(page_id, digest: str) -> str:
    return f"urn:uuid:{uuid5(NAMESPACE_URL, f'{page_id}/{digest}')}"


def _uri(url: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def to_record(page_id, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool,
              date: str = "1970-01-01T00:00:00Z") -> tuple[str, bytes]:
    """The id and the bytes of one record."""
    name = record_id(page_id, digest)
    body = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if not revisit:
        body += payload
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<{name}>"), ("WARC-Date", date),
              ("WARC-Target-URI", None if url is None else _uri(url)), ("WARC-Payload-Digest", f"sha256:{digest}"),
              ("X-Payload-Length", len(payload)), ("X-Page-ID", page_id)]
    if revisit:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<{record_id(refers_to, digest)}>"), ("X-Refers-To-Page-ID", refers_to)]
    fields += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", len(body))]
    head = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return name, f"WARC/1.1\r\n{head}\r\n".encode("utf-8", "surrogatepass") + body + b"\r\n\r\n"


def parse_records(data: bytes):
    """The records of a plain frame, one after the other; payloads that are there are digested anew."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:end].split(b"\r\n")
        if first != b"WARC/1.1":
            raise ValueError(f"no WARC record at offset {at}")
        f = dict(line.decode("utf-8", "surrogatepass").split(": ", 1) for line in lines)
        body = data[end + 4:end + 4 + int(f["Content-Length"])]
        at = end + 4 + len(body) + 4
        payload = body[body.index(b"\r\n\r\n") + 4:]
        digest, size = f["WARC-Payload-Digest"].removeprefix("sha256:"), int(f["X-Payload-Length"])
        if f["WARC-Type"] == "response":
            found = hashlib.sha256(payload).hexdigest()
            if found != digest or len(payload) != size:
                raise ValueError(f"{f['WARC-Record-ID']}: the payload is not the one that was written")
        page, ref = f.get("X-Page-ID"), f.get("X-Refers-To-Page-ID")
        yield Record(f["WARC-Record-ID"][1:-1], None if page is None else int(page), f.get("WARC-Target-URI"), f["WARC-Type"],
                     None if ref is None else int(ref), payload, size, digest)


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The closing skippable frame for frames of (compressed, plain) sizes."""
    body = b"".join(struct.pack("<II", c, n) for c, n in frames) + SEEK_FOOTER.pack(len(frames), 0, SEEK_MAGIC)
    return SKIPPABLE.pack(SKIPPABLE_MAGIC, len(body)) + body


def read_seek_table(f) -> list[tuple[int, int, int]]:
    """(start, compressed size, plain size) of the frames of an open bundle."""
    size = f.size()
    n, _, magic = SEEK_FOOTER.unpack(f.read_at(SEEK_FOOTER.size, size - SEEK_FOOTER.size))
    if magic != SEEK_MAGIC:
        raise ValueError("the bundle has no seek table")
    body = f.read_at(8 * n, size - SEEK_FOOTER.size - 8 * n)
    out, start = [], 0
    for c, plain in struct.iter_unpack("<II", body):
        out.append((start, c, plain))
        start += c
    return out


def _open(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def marked(pages: DataFrame) -> DataFrame:
    """``(page_id, url, payload, digest, refers_to, revisit)``."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    repeated = rows.where(F.octet_length("payload") >= MIN_REVISIT).groupBy("digest") \
        .agg(F.min("page_id").alias("first"), F.max("page_id").alias("last"), F.max(F.col("page_id").isNull()).alias("nameless")) \
        .where((F.col("first") < F.col("last")) | (F.col("nameless") & F.col("first").isNotNull())) \
        .select(F.col("digest").alias("d"), "first")
    repeated = fixed(repeated)
    small = small_side(repeated, 200_000)  # 72 bytes a row
    if small is not repeated:
        found = rows.join(small, F.col("digest") == F.col("d"), "left")
    else:
        ways = F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))
        salt = F.pmod(F.xxhash64("page_id") + F.spark_partition_id(), F.lit(SALT)).cast("int")
        found = rows.withColumn("salt", salt).join(repeated.withColumn("way", ways).hint("shuffle_hash"),
                                                   (F.col("digest") == F.col("d")) & (F.col("salt") == F.col("way")), "left")
    revisit = F.col("first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") != F.col("first")))
    return found.select("page_id", "url", "payload", "digest", F.when(revisit, F.col("first")).alias("refers_to"), revisit.alias("revisit"))


def write_bundles(pages: DataFrame, folder: str | None = None, frame_bytes: int = FRAME_BYTES,
                  bundle_bytes: int = BUNDLE_BYTES) -> tuple[str, DataFrame]:
    """Write a record per row of ``pages`` below ``folder``; returns the folder and the index
    (also written there, as Parquet in ``index``)."""
    spark = pages.sparkSession
    folder = folder or f"{ensure_checkpoint_dir(spark).rstrip('/')}/warc-{uuid4().hex}"

    def run(rows):
        import zstandard

        files, root = _open(folder)
        pack = zstandard.ZstdCompressor(level=3)
        out, name, sizes, start = None, "", [], 0
        held: list[tuple] = []  # records of the open frame: id, page, bytes

        def frame():
            nonlocal out, name, start
            if out is None:
                name = f"bundle-{uuid4().hex}.warc.zst"
                files.create_dir(root, recursive=True)
                out = files.open_output_stream(f"{root}/{name}", compression=None)
            plain = b"".join(r for _, _, r in held)
            data = pack.compress(plain)
            out.write(data)
            at = 0
            for rid, page, r in held:
                yield rid, page, name, len(sizes), start, len(data), at, len(r)
                at += len(r)
            sizes.append((len(data), len(plain)))
            start += len(data)
            held.clear()

        def close():
            nonlocal out, start
            out.write(seek_table(sizes))
            out.close()
            out, start = None, 0
            sizes.clear()

        n = 0
        for page, url, payload, digest, ref, revisit in rows:
            rid, data = to_record(page, url, payload, digest, ref, revisit)
            held.append((rid, page, data))
            n += len(data)
            if n >= frame_bytes:
                yield from frame()
                n = 0
                if start >= bundle_bytes:
                    close()
        if held:
            yield from frame()
        if out is not None:
            close()

    map_rows(marked(pages), run, INDEX).write.parquet(f"{folder}/index")
    return folder, spark.read.schema(INDEX).parquet(f"{folder}/index")


def read_back(folder: str, index: DataFrame) -> DataFrame:
    """All records of the bundles of an index, frame by frame: ``(record_id, page_id, url,
    record_type, refers_to, payload_bytes, payload_digest)``."""

    def run(rows):
        import zstandard

        files, root = _open(folder)
        unpack = zstandard.ZstdDecompressor()
        for (name,) in rows:
            with files.open_input_file(f"{root}/{name}") as f:
                for start, size, plain in read_seek_table(f):
                    for r in parse_records(unpack.decompress(f.read_at(size, start), max_output_size=plain)):
                        yield r.record_id, r.page_id, r.url, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest

    names = fixed(index.select("bundle").distinct())
    n = max(1, min(names.count(), 4 * index.sparkSession.sparkContext.defaultParallelism))
    return map_rows(names.repartition(n), run, "record_id string, page_id long, url string, record_type string, refers_to long, "
                                               "payload_bytes long, payload_digest string")


def fetch(folder: str, index: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(record_id, page_id, record_type, refers_to, payload)`` of the records whose ids are in
    ``wanted.record_id``: each frame that holds one is read once, and nothing else."""

    def run(rows):
        import zstandard

        files, root = _open(folder)
        unpack = zstandard.ZstdDecompressor()
        at, plain, f = None, b"", None
        try:
            for name, start, size, offset, length in rows:
                if at != (name, start):
                    if at is None or at[0] != name:
                        if f is not None:
                            f.close()
                        f = files.open_input_file(f"{root}/{name}")
                    plain, at = unpack.decompress(f.read_at(size, start)), (name, start)
                r = next(parse_records(plain[offset:offset + length]))
                yield r.record_id, r.page_id, r.record_type, r.refers_to, r.payload
        finally:
            if f is not None:
                f.close()

    places = index.join(wanted.select("record_id").distinct(), "record_id", "left_semi") \
        .select("bundle", "frame_start", "frame_bytes", "offset", "length").repartition("bundle", "frame_start") \
        .sortWithinPartitions("bundle", "frame_start", "offset")
    return map_rows(places, run, "record_id string, page_id long, record_type string, refers_to long, payload binary")


def archive(pages: DataFrame) -> DataFrame:
    """Write the archives of ``pages`` and read them back."""
    return read_back(*write_bundles(pages))
