"""WARC records in ZIP-packaged archives: writing, and reading without extraction.

A package is a ZIP file whose members are stored, not deflated: ``archive/data.warc.gz``
(one gzip member per record), ``indexes/index.cdx`` (one line per record: id, offset and
length inside the archive member, type) and ``datapackage.json``. The reader takes the end
of a file, follows the end record (with its ZIP64 form where a field is full) to the central
directory, finds where each stored member's bytes begin from its local header, and from then
on reads byte ranges only: index lines become rows, and a task reads the ranges of a bounded
stretch of one archive. Files are reached through Arrow's file systems by URI, so the folder
may be on any store they know.

Files are written under names of their own per task attempt. The list of files is a table
that is written once, and later steps read the files on that list alone; what a lost or
repeated attempt left behind is never read.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapscope.llm.common import cut, shared_folder

ARCHIVE, INDEX, PACKAGE = "archive/data.warc.gz", "indexes/index.cdx", "datapackage.json"
CRLF = b"\r\n"
STAMP = "2000-01-01T00:00:00Z"
PAGE = "urn:x-page:"
URI_SAFE = "%:/?#[]@!$&'()*+,;=~"
#: Archive bytes that one reading task takes, stretch after stretch.
TASK_BYTES = 256 << 20
#: Fixed values of the ZIP format: signatures and the marks of a field kept in a ZIP64 record.
END, END64, LOCATOR64, CENTRAL, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
FULL16, FULL32, EXTRA64 = 0xFFFF, 0xFFFFFFFF, 1
END_SIZE, LONGEST_COMMENT = 22, 0xFFFF


def open_store(uri: str):
    """(file system, path) of a URI or a plain path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if ":" in uri.split("/")[0] else (fs.LocalFileSystem(), uri)


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


# ------------------------------------------------------------------------------------- records


def record(kind: str, name: str, uri: str | None, payload: bytes, digest: str, refers_to: str | None = None) -> bytes:
    """A WARC 1.1 response or revisit record; a revisit holds the reply's header alone."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head + (payload if kind == "response" else b"")
    fields = [
        ("WARC-Type", kind), ("WARC-Record-ID", f"<{PAGE}{name}>"), ("WARC-Date", STAMP), ("WARC-Target-URI", quote(uri, safe=URI_SAFE) if uri else PAGE + name),
        ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block))),
    ]
    if kind == "revisit":
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<{PAGE}{refers_to}>")]
    named = "".join(f"{k}: {v}\r\n" for k, v in fields)
    return b"WARC/1.1\r\n" + named.encode() + CRLF + block + CRLF + CRLF


def headers(data: bytes) -> dict[str, str]:
    lines = data.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines) if k}


@dataclass
class Parsed:
    fields: dict[str, str]
    reply: dict[str, str]
    payload: bytes


def parse(data: bytes) -> Parsed:
    """One record, inflated."""
    if not data.startswith(b"WARC/1."):
        raise ValueError("not a WARC record")
    head, _, rest = data.partition(CRLF + CRLF)
    fields = headers(head)
    block = rest[: int(fields["content-length"])]
    reply, _, payload = block.partition(CRLF + CRLF)
    return Parsed(fields, headers(reply), payload)


# -------------------------------------------------------------------------------------- writing


class Counting(io.RawIOBase):
    """Passes writes on and knows how many bytes went by; cannot seek, so a member keeps its size in the directory."""

    def __init__(self, out: BinaryIO):
        self.out, self.at = out, 0

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        self.out.write(data)
        self.at += len(data)
        return len(data)

    def tell(self) -> int:
        return self.at


class PackageWriter:
    """Streams records into one package; only the index lines wait in memory."""

    def __init__(self, stream: BinaryIO, path: str):
        self.stream, self.path = stream, path
        self.zip = zipfile.ZipFile(Counting(self.stream), "w", zipfile.ZIP_STORED, allowZip64=True)
        self.member = self.zip.open(ARCHIVE, "w", force_zip64=True)
        self.at, self.lines = 0, []

    def add(self, name: str, kind: str, data: bytes) -> None:
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        packed = packer.compress(data) + packer.flush()
        self.member.write(packed)
        self.lines.append(f"{name} {self.at} {len(packed)} {kind}\n")
        self.at += len(packed)

    def close(self) -> tuple[str, int, int]:
        self.member.close()
        self.zip.writestr(INDEX, "".join(self.lines))
        self.zip.writestr(PACKAGE, json.dumps({"profile": "data-package", "created": STAMP, "resources": [{"path": ARCHIVE, "bytes": self.at}, {"path": INDEX}]}))
        self.zip.close()
        self.stream.close()
        return self.path, self.at, len(self.lines)


def with_first(pages: DataFrame, least: int = 0) -> DataFrame:
    """``pages`` (page_id, url, html) with ``digest`` and ``first``: the smallest page_id of equal payloads of at least ``least`` bytes.

    The digest is taken in the JVM; groups with one page only are not joined. A hot payload is
    a partial minimum, and the join on it can be split. Null ids are no group's first.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    known = pages.select("page_id", "url", "html", F.sha1(payload).alias("digest"))
    sizeable = known.where(F.octet_length(F.coalesce("html", F.lit(""))) >= least)
    firsts = cut(sizeable.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where((F.col("n") > 1) & F.col("first").isNotNull()).drop("n"))
    return known.join(firsts, "digest", "left")


def write_packages(pages: DataFrame, folder: str, max_bytes: int = 256 << 20) -> DataFrame:
    """Write ``with_first`` rows into packages of at most about ``max_bytes``; the table of (path, size, records)."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = open_store(folder)
        store.create_dir(root, recursive=True)
        writer, done = None, []
        for batch in batches:
            for page, url, html, first in zip(batch["page_id"], batch["url"], batch["html"], batch["first"]):
                name = page or "-"
                payload = (html or "").encode()
                kind = "response" if first in (None, page) else "revisit"
                data = record(kind, name, url, payload, base32_sha1(payload), first)
                if writer is None:
                    file = f"{uuid.uuid4().hex}.wacz"
                    writer = PackageWriter(store.open_output_stream(f"{root}/{file}"), f"{folder}/{file}")
                writer.add(name, kind, data)
                if writer.at >= max_bytes:
                    done.append(writer.close())
                    writer = None
        if writer:
            done.append(writer.close())
        yield pd.DataFrame(done, columns=["path", "size", "records"])

    plain = pages.select(F.col("page_id").cast("string").alias("page_id"), F.col("url").cast("string").alias("url"), "html", F.col("first").cast("string").alias("first"))
    return cut(plain.mapInPandas(write, "path string, size long, records long"))


# -------------------------------------------------------------------------------------- reading


@dataclass
class Member:
    name: str
    at: int  # of its first data byte
    size: int


def members(read, length: int) -> list[Member]:
    """Stored members of a ZIP file, given ``read(offset, size)`` and its length."""
    tail_size = min(length, END_SIZE + LONGEST_COMMENT)
    tail = read(length - tail_size, tail_size)
    end = tail.rfind(END)
    if end < 0:
        raise ValueError("no end record: not a ZIP file")
    count, size, at = struct.unpack_from("<HII", tail, end + 10)
    if FULL16 == count or FULL32 in (size, at):
        where = length - tail_size + end - 20
        locator = read(where, 20)
        if locator[:4] == LOCATOR64:
            (start,) = struct.unpack_from("<Q", locator, 8)
            record64 = read(start, 56)
            if record64[:4] != END64:
                raise ValueError("broken ZIP64 end record")
            count, size, at = struct.unpack_from("<QQQ", record64, 32)
    directory, out, k = read(at, size), [], 0
    for _ in range(count):
        if directory[k : k + 4] != CENTRAL:
            raise ValueError("broken central directory")
        flags, method = struct.unpack_from("<HH", directory, k + 8)
        packed, plain = struct.unpack_from("<II", directory, k + 20)
        n, extra, comment = struct.unpack_from("<HHH", directory, k + 28)
        (local,) = struct.unpack_from("<I", directory, k + 42)
        name = directory[k + 46 : k + 46 + n].decode("utf-8" if flags & 0x800 else "cp437")
        more, j = directory[k + 46 + n : k + 46 + n + extra], 0
        while j + 4 <= len(more):
            kind, held = struct.unpack_from("<HH", more, j)
            if kind == EXTRA64:
                # Only full fields are here, in this order.
                wide = iter(struct.unpack_from(f"<{held // 8}Q", more, j + 4))
                plain = next(wide) if plain == FULL32 else plain
                packed = next(wide) if packed == FULL32 else packed
                local = next(wide) if local == FULL32 else local
            j += 4 + held
        k += 46 + n + extra + comment
        if method == 0 and not name.endswith("/"):
            head = read(local, 30)
            if head[:4] != LOCAL:
                raise ValueError("broken local header")
            n_local, extra_local = struct.unpack_from("<HH", head, 26)
            out.append(Member(name, local + 30 + n_local + extra_local, packed))
    return out


def index(files: DataFrame, stretch: int = 8 << 20) -> DataFrame:
    """(path, at, size, part): where each record lies in its file; ``part`` numbers stretches of about ``stretch`` bytes."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                store, inner = open_store(path)
                with store.open_input_file(inner) as file:
                    found = {m.name: m for m in members(lambda at, n: file.read_at(n, at), file.size())}
                    base, lines = found[ARCHIVE].at, found[INDEX]
                    left, at, block = b"", lines.at, 4 << 20
                    while at < lines.at + lines.size:
                        data = left + file.read_at(min(block, lines.at + lines.size - at), at)
                        at += block
                        whole, _, left = data.rpartition(b"\n")
                        rows = [x.split(b" ") for x in whole.split(b"\n")] if whole else []
                        offsets = [int(r[1]) for r in rows]
                        yield pd.DataFrame({"path": path, "at": [base + o for o in offsets], "size": [int(r[2]) for r in rows], "part": [o // stretch for o in offsets]})

    return files.select("path").mapInPandas(find, "path string, at long, size long, part long")


RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, uri string, payload binary"


def read_records(located: DataFrame, keep_payload: bool = False, tasks: int | None = None) -> DataFrame:
    """Read each stretch of records by one range, inflate and parse them.

    Index rows are a few bytes and name a stretch of archive each, so their own size says nothing
    about the work; ``tasks`` sets how many tasks share the stretches (see ``reading_tasks``).
    """

    def number(name: str | None) -> int | None:
        tail = (name or "-").strip("<>").removeprefix(PAGE)
        return None if tail == "-" else int(tail)

    def read(stretch: pd.DataFrame) -> pd.DataFrame:
        stretch = stretch.sort_values("at")
        start = int(stretch["at"].iloc[0])
        store, inner = open_store(stretch["path"].iloc[0])
        with store.open_input_file(inner) as file:
            data = file.read_at(int(stretch["at"].iloc[-1]) + int(stretch["size"].iloc[-1]) - start, start)
        rows = []
        for at, size in zip(stretch["at"], stretch["size"]):
            r = parse(zlib.decompress(data[at - start : at - start + size], 31))
            kind, digest = r.fields["warc-type"], r.fields["warc-payload-digest"].removeprefix("sha1:")
            if kind == "response" and base32_sha1(r.payload) != digest:
                raise ValueError("payload and digest differ")
            page, first = number(r.fields["warc-record-id"]), number(r.fields.get("warc-refers-to"))
            rows.append((page, int(r.reply["content-length"]), digest, kind, first, r.fields["warc-target-uri"], r.payload if keep_payload else None))
        # Whole numbers throughout: a column with nulls must not turn into floats.
        columns = dict(zip((c.split()[0] for c in RECORD.split(", ")), zip(*rows)))
        return pd.DataFrame({k: pd.array(v, "Int64") if k in ("page_id", "refers_to") else list(v) for k, v in columns.items()})

    dealt = located.repartition(tasks, "path", "part") if tasks else located
    return dealt.groupBy("path", "part").applyInPandas(read, RECORD)


def reading_tasks(spark: SparkSession, archive_bytes: int) -> int:
    """A task for each ``TASK_BYTES`` of archives, and no fewer than can run at once."""
    return max(spark.sparkContext.defaultParallelism, -(-archive_bytes // TASK_BYTES))


def round_trip(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to: what the written archives say."""
    folder = f"{shared_folder(pages.sparkSession)}/packages-{uuid.uuid4().hex}"
    files = write_packages(with_first(pages), folder)
    written = files.agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("size")).first()
    # One file per task: the list is short, and each file's index is read by ranges.
    spread = files.repartition(max(1, written["files"]), "path")
    tasks = reading_tasks(pages.sparkSession, written["size"])
    return read_records(index(spread), tasks=tasks).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
