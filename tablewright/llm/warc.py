"""WARC archives: one gzip member a record, written by tasks, read back by byte ranges."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAGIC = b"\x1f\x8b\x08"
READ, PIECE = 1 << 20, 1 << 14
SPLIT_BYTES = 8 << 20
LEAST_REVISIT_BYTES = 0
LEVEL = 6
DATE = "2026-01-01T00:00:00Z"
RECORD_ID = "<urn:x-page:%s>"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record: the response with its payload, or a revisit without it."""
    block = HTTP_HEAD % len(payload) + (b"" if revisit else payload)
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {RECORD_ID % page_id}", f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}", f"WARC-Payload-Length: {len(payload)}",
        "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {RECORD_ID % refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = LEVEL) -> bytes:
    """A gzip member; its bytes depend on the data alone."""
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def _open(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pa.fs.LocalFileSystem(), path)


def with_revisits(pages: DataFrame, page_id: str, html: str, least_bytes: int) -> DataFrame:
    """Pages with ``refers_to``: the largest id among equal payloads, null for that page itself.

    Only ids and digests are grouped (pre-aggregated, so that a payload that a third of all pages
    share is no hot group); the pages are then joined by id and digest, which no two groups share.
    """
    digest = F.concat(F.sha1(F.coalesce(html, F.lit("")).cast("binary")), F.lit(":"), F.octet_length(F.coalesce(html, F.lit(""))))
    narrow = pages.select(F.col(page_id).alias("own"), digest.alias("digest"), F.octet_length(F.coalesce(html, F.lit(""))).alias("bytes"))
    first = narrow.where(F.col("bytes") >= least_bytes).groupBy("digest").agg(F.max("own").alias("largest"), F.count("*").alias("n")).where("n > 1")
    later = narrow.join(first, "digest").where(~F.col("own").eqNullSafe(F.col("largest"))).select("own", "digest", "largest").distinct()
    keyed = pages.select(F.col(page_id).alias("page_id"), "url", F.coalesce(html, F.lit("")).alias("html"), digest.alias("digest_"))
    same = keyed["page_id"].eqNullSafe(later["own"]) & (keyed["digest_"] == later["digest"])
    return keyed.join(later, same, "left").select("page_id", "url", "html", F.col("largest").alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, page_id: str = "page_id", html: str = "html", least_bytes: int = LEAST_REVISIT_BYTES, level: int = LEVEL) -> list[tuple[str, int]]:
    """Write one archive a task below ``folder``; gives (path, bytes) of each.

    A null html is an empty payload. Of equal payloads of at least ``least_bytes`` the page with the
    largest id is the response and the others revisit it (a null id is smaller than any; rows that
    repeat the largest id are all responses). A task writes under a name of its own and renames
    when done, so a task that runs again or twice leaves one whole archive.
    """
    marked = with_revisits(pages.select(page_id, "url", html), page_id, html, least_bytes)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        store, root = _open(folder)
        store.create_dir(root)
        name = f"{root}/part-{TaskContext.get().partitionId():06d}.warc.gz"
        draft, out = f"{name}.{uuid.uuid4().hex}.draft", None
        for batch in batches:
            for i in range(batch.num_rows):
                own, url, text, refers_to, revisit = (batch.column(c)[i].as_py() for c in range(5))
                out = out or store.open_output_stream(draft)
                out.write(member(record(own, url, text.encode("utf-8", "surrogatepass"), refers_to, revisit), level))
        if out:
            size = out.tell()
            out.close()
            store.move(draft, name)
            yield pa.RecordBatch.from_pydict({"name": [name.rpartition("/")[2]], "bytes": pa.array([size], pa.int64())})

    rows = marked.select("page_id", "url", "html", "refers_to", F.col("refers_to").isNotNull().alias("revisit"))
    return sorted((f"{folder}/{r.name}", r.bytes) for r in rows.mapInArrow(write, "name string, bytes long").collect())


def head_of(plain: bytes) -> dict[str, str] | None:
    """Named fields of a record's header, None if this is not one."""
    if not re.match(rb"WARC/1\.\d\r\n", plain):
        return None
    lines = plain.partition(b"\r\n\r\n")[0].decode("utf-8", "replace").split("\r\n")[1:]
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    return fields if "warc-type" in fields and fields.get("content-length", "").isdigit() else None


class _Window:
    """Bytes of a file from a place on, read as they are needed and let go when passed."""

    def __init__(self, file, at: int):
        self.file, self.base, self.data = file, at, bytearray()
        file.seek(at)

    @property
    def end(self) -> int:
        return self.base + len(self.data)

    def more(self) -> bool:
        got = self.file.read(READ)
        self.data += got
        return bool(got)

    def piece(self, at: int) -> bytes:
        """Up to 16 KiB from a place on; empty at the end of the file."""
        while at >= self.end and self.more():
            pass
        return bytes(self.data[at - self.base : at - self.base + PIECE])

    def pass_to(self, at: int) -> None:
        if at - self.base > READ:
            del self.data[: at - self.base]
            self.base = at

    def find_magic(self, at: int, end: int) -> int | None:
        """First place of a gzip magic from ``at`` on and before ``end``."""
        while at < end:
            found = self.data.find(MAGIC, at - self.base)
            if found >= 0:
                return self.base + found if self.base + found < end else None
            at = max(at, self.end - len(MAGIC) + 1)
            self.pass_to(at)
            if not self.more():
                return None
        return None


def records_between(file, start: int, end: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Offset, header fields and block of each record whose member starts at start <= offset < end.

    A gzip magic in the range is only a candidate: the member counts if its plain text begins with
    the header of a WARC record and it ends with a right checksum. After a member the next one
    follows at once; anything else is scanned for the next magic.
    """
    window, at = _Window(file, start), start
    while (at := window.find_magic(at, end)) is not None:
        got = _member_at(window, at)
        if got is None:
            at += 1
            continue
        used, fields, block = got
        yield at, fields, block
        at += used
        window.pass_to(at)


def _member_at(window: _Window, at: int) -> tuple[int, dict[str, str], bytes] | None:
    """Length, header and block of the member that starts at a place, None if it is not a record."""
    unpack, plain, fed, fields = zlib.decompressobj(31), bytearray(), at, None
    while not unpack.eof:
        piece = window.piece(fed)
        if not piece:
            return None
        try:
            plain += unpack.decompress(piece)
        except zlib.error:
            return None
        fed += len(piece)
        if fields is None:
            if b"\r\n\r\n" in plain or unpack.eof:
                fields = head_of(bytes(plain))
                if fields is None:
                    return None
            elif not b"WARC/1.".startswith(plain[:7]):
                return None
    first = plain.find(b"\r\n\r\n") + 4
    block = bytes(plain[first : first + int(fields["content-length"])])
    used = fed - len(unpack.unused_data) - at
    return (used, fields, block) if len(block) == int(fields["content-length"]) else None


RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, path string, offset long"


def _number(field: str | None) -> int | None:
    found = re.fullmatch(r"<urn:x-page:(-?\d+)>", field or "")
    return int(found[1]) if found else None


def read_archives(spark: SparkSession, archives: list[tuple[str, int]], split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """One row a record of the archives (path, bytes), each found by the task whose byte range it starts in.

    The digest of a response is computed from the payload read and must be the header's; a
    revisit's digest and length are those its header names.
    """
    files = spark.createDataFrame(archives, "path string, bytes long")
    starts = files.select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split_bytes).cast("long"))).alias("start"))
    splits = starts.select("path", "start", F.least(F.col("start") + split_bytes, F.col("bytes")).alias("end"))
    count = sum(max(1, -(-size // split_bytes)) for _, size in archives)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start, end in zip(*(c.to_pylist() for c in batch.columns)):
                store, inside = _open(path)
                rows = []
                with store.open_input_file(inside) as file:
                    for offset, fields, block in records_between(file, start, end):
                        digest = fields["warc-payload-digest"].removeprefix("sha1:")
                        revisit = fields["warc-type"] == "revisit"
                        size = int(fields["warc-payload-length"])
                        if not revisit:
                            payload = block.partition(b"\r\n\r\n")[2]
                            if base32_sha1(payload) != digest or len(payload) != size:
                                raise ValueError(f"{path}: the payload at {offset} is not what its header says")
                        rows.append((_number(fields["warc-record-id"]), size, digest, fields["warc-type"], _number(fields.get("warc-refers-to")), path, offset))
                columns = list(zip(*rows)) or [()] * 7
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[f.split()[0] for f in RECORD.split(", ")])

    return splits.repartition(max(1, count)).mapInArrow(read, RECORD)
