"""Legacy archive converter: ARC files of version 1 and 2 to WARC/1.0, and back to rows.

An ARC record is a header line and as many bytes as it declares.  The line's fields depend on the version that the file's
first record, the version block, states: 1 has five, 2 has ten.  The converter synthesises what WARC asks for: a record id
from the file's name and the record's offset, an ISO date from the 14 digits, a type, and SHA-1 digests of block and payload.

Of records with equal payloads of at least ``REVISIT_BYTES`` bytes, that with the largest page id is the response and the others
revisit it.  Payloads never leave the task that reads them: digests are indexed first, and a file's revisits, looked up in
the index, are handed to the task that converts the file.

Files have a gzip member a record and lie in the shared folder; they are written under a name of their attempt and moved into
place when whole.  A null html is an empty payload, a null url ``about:blank``; a null page_id has no id in the record, comes back as
null and is the largest of none.  Repeated rows are records of their own: of equal page ids the last record (by file and offset) is the response.
An empty table makes no files.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import file_system, map_arrow, put_in_place, scratch_path, written

REVISIT_BYTES, DATE = 1000, "20240101000000"
#: The fields of an ARC record's header line.
FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


def _member(data: bytes, level: int) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class Inflated:
    """A forward reader over gzip members, or over plain bytes; it holds one read's worth."""

    def __init__(self, stream: BinaryIO, step: int = 1 << 18):
        self.stream, self.step, self.left, self.z, self.at = stream, step, b"", None, 0
        first = stream.read(step)
        self.packed, self.raw = first[:2] == b"\x1f\x8b", first
        if not self.packed:
            self.left, self.raw = first, b""

    def _more(self) -> bool:
        if not self.packed:
            new = self.stream.read(self.step)
            self.left += new
            return bool(new)
        while True:
            if not self.raw:
                self.raw = self.stream.read(self.step)
            if not self.raw:
                if self.z is not None and not self.z.eof:
                    raise ValueError("a gzip member is cut off")
                return False
            if self.z is None or self.z.eof:
                self.z = zlib.decompressobj(31)
            new = self.z.decompress(self.raw)
            self.raw = self.z.unused_data
            if new:
                self.left += new
                return True

    def line(self) -> bytes:
        """Up to and with the next newline; what is left at the end."""
        while (k := self.left.find(b"\n")) < 0:
            if not self._more():
                break
        return self.take(k + 1 if k >= 0 else len(self.left))

    def take(self, n: int) -> bytes:
        if len(self.left) < n:
            parts = [self.left]
            have = len(self.left)
            while have < n:
                self.left = b""
                if not self._more():
                    raise ValueError("a record is shorter than it declares")
                parts.append(self.left)
                have += len(self.left)
            self.left = b"".join(parts)
        out, self.left = self.left[:n], self.left[n:]
        self.at += n
        return out


def arc_records(stream: BinaryIO) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset in the inflated file, header fields, body) of each record after the version block."""
    r = Inflated(stream)
    version = 0
    while True:
        at, line = r.at, r.line()
        if not line:
            return
        if line in (b"\n", b"\r\n"):
            continue
        parts = line.decode("utf-8", "surrogateescape").rstrip("\r\n").split(" ")
        if not version:
            if not line.startswith(b"filedesc://"):
                raise ValueError("an ARC file begins with a version block")
            block = r.take(int(parts[-1]))
            version = int(block.split(b" ", 1)[0])
            if version not in FIELDS:
                raise ValueError(f"ARC version {version} is unknown")
            continue
        names = FIELDS[version]
        if len(parts) != len(names) or not parts[-1].isdigit():
            raise ValueError(f"a header line of version {version} has {len(names)} fields and ends with a length: {line[:200]!r}")
        yield at, dict(zip(names, parts, strict=True)), r.take(int(parts[-1]))


def arc_bytes(name: str, version: int) -> bytes:
    """The version block."""
    block = f"{version} 0 granary\n{' '.join(FIELDS[version])}\n".encode()
    extra = "" if version == 1 else " 200 - - 0 " + name
    return f"filedesc://{name} 0.0.0.0 {DATE} text/plain{extra} {len(block)}\n".encode() + block + b"\n"


def arc_record(version: int, url: str, body: bytes, name: str, at: int) -> bytes:
    url = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) or "about:blank"
    extra = "" if version == 1 else f" 200 {base64.b16encode(hashlib.md5(body).digest()).decode().lower()} - {at} {name}"
    return f"{url} 0.0.0.0 {DATE} text/html{extra} {len(body)}\n".encode() + body + b"\n"


def split_http(body: bytes) -> tuple[bytes, bytes]:
    """The HTTP head of a body (empty if it has none) and its payload."""
    if body.startswith(b"HTTP/") and (k := body.find(b"\r\n\r\n")) >= 0:
        return body[: k + 4], body[k + 4 :]
    return b"", body


def _page_id(head: bytes) -> int | None:
    m = re.search(rb"\r\nX-Page-Id: (-?\d+)\r\n", head)
    return int(m[1]) if m else None


def sha1_name(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(file: str, at: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{file}#{at}')}>"


def iso(digits: str) -> str:
    """14 digits (12 and 8 are filled up) as the date of a WARC record."""
    d = (digits + "000000")[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def warc_record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return head.encode("utf-8", "surrogateescape") + b"\r\n" + block + b"\r\n\r\n"


def converted(file: str, at: int, fields: dict[str, str], body: bytes, revisits: tuple[str, str, str, int] | None) -> bytes:
    """The WARC record of an ARC record; `revisits`: id, URL, date and page id of the response with the same payload."""
    head, payload = split_http(body)
    kind = "response" if head else "resource"
    common = [
        ("WARC-Type", "revisit" if revisits else kind), ("WARC-Record-ID", record_id(file, at)), ("WARC-Date", iso(fields["Archive-date"])),
        ("WARC-Target-URI", fields["URL"]), ("WARC-IP-Address", fields["IP-address"]), ("WARC-Payload-Digest", sha1_name(payload))
    ]
    if revisits:
        common += [
            ("WARC-Profile", PROFILE), ("WARC-Refers-To", revisits[0]), ("WARC-Refers-To-Target-URI", revisits[1]),
            ("WARC-Refers-To-Date", iso(revisits[2])), ("X-Refers-To-Page-Id", str(revisits[3])), ("X-Payload-Length", str(len(payload)))
        ]
    block = head if revisits else body
    return warc_record(
        [*common, ("WARC-Block-Digest", sha1_name(block)), ("Content-Type", "application/http; msgtype=response" if head else fields["Content-type"])],
        block
    )


def warc_records(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields in lower case, block) of each record."""
    r = Inflated(stream)
    while line := r.line():
        if line in (b"\r\n", b"\n"):
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:80]!r}")
        fields: dict[str, str] = {}
        while (line := r.line()).strip():
            k, _, v = line.decode("utf-8", "surrogateescape").partition(":")
            fields[k.strip().lower()] = v.strip()
        yield fields, r.take(int(fields["content-length"]))


# ---- over tables --------------------------------------------------------------------------------------------------


class _Shard:
    """A file in the shared folder that appears when whole."""

    def __init__(self, folder: str, name: str):
        from pyspark import TaskContext

        self.fs, base = file_system(folder)
        self.part, self.name = f"{base}/.{name}-{TaskContext.get().taskAttemptId()}", f"{base}/{name}"
        self.out = self.fs.open_output_stream(self.part)

    def close(self) -> None:
        self.out.close()
        put_in_place(self.fs, self.part, self.name)


def _arc_writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        k = TaskContext.get().partitionId()
        name, version, shard, at = f"pages-{k:06d}.arc.gz", 1 + k % 2, None, 0
        for batch in batches:
            for page_id, url, html in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                if shard is None:
                    shard = _Shard(folder, name)
                    first = arc_bytes(name, version)
                    shard.out.write(_member(first, 1))
                    at = len(first)
                payload = html.encode()
                own = "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
                body = f"HTTP/1.1 200 OK\r\n{own}Content-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
                record = arc_record(version, url, body, name, at)
                shard.out.write(_member(record, 1))
                at += len(record)
        if shard is not None:
            shard.close()
            yield pa.RecordBatch.from_pydict({"file": [name]})

    return run


def write_arc(pages: DataFrame, folder: str | None = None) -> tuple[str, DataFrame]:
    """Writes rows (page_id, url, html) as ARC files, by turns of version 1 and 2; returns the folder and the files."""
    folder = folder or scratch_path(pages.sparkSession, "arc")
    rows = pages.select(F.col("page_id").cast("long"), F.coalesce("url", F.lit("about:blank")), F.coalesce("html", F.lit("")))
    return folder, written(map_arrow(rows, _arc_writer(folder), "file string"), "arc-files")


def _each_file(folder: str, rows, schema: pa.Schema, step: int = 4096):
    """A map function that runs `rows(fs, base, row)` for each input row and yields what it makes, in bounded batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = file_system(folder)
        held: list[tuple] = []

        def batch_of() -> pa.RecordBatch:
            columns = list(zip(*held, strict=True)) or [()] * len(schema)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

        for batch in batches:
            for row in batch.to_pylist():
                for made in rows(fs, base, row):
                    held.append(made)
                    if len(held) == step:
                        yield batch_of()
                        held.clear()
        yield batch_of()

    return run


def _index(fs, base: str, row: dict) -> Iterator[tuple]:
    with fs.open_input_stream(f"{base}/{row['file']}") as f:
        for at, fields, body in arc_records(f):
            head, payload = split_http(body)
            yield row["file"], at, _page_id(head), len(payload), hashlib.sha1(payload).hexdigest(), fields["URL"], fields["Archive-date"]


INDEX = pa.schema(
    [
        ("file", pa.string()), ("at", pa.int64()), ("page_id", pa.int64()), ("size", pa.int64()), ("digest", pa.string()), ("url", pa.string()),
        ("date", pa.string())
    ]
)


def index_arc(folder: str, files: DataFrame) -> DataFrame:
    """What a converter needs to know of each record: file, at, page_id, size, digest, url, date."""
    each = files.select("file").repartition(max(1, files.count()), "file")
    return written(
        map_arrow(each, _each_file(folder, _index, INDEX), "file string, at bigint, page_id bigint, size bigint, digest string, url string, date string"),
        "arc-index"
    )


def revisits(index: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """One row per file: the records that revisit others, as an array of (at, to_file, to_at, to_url, to_date, to_page).

    The response of a digest comes from a grouped maximum, summed up before the shuffle; the join on digests has it once, and AQE splits a hot digest.
    """
    large = index.filter((F.col("size") >= least) & F.col("page_id").isNotNull())
    order = F.struct("page_id", "file", "at")
    one = large.groupBy("digest").agg(
        F.max_by(F.struct("file", "at", "url", "date", "page_id"), order).alias("to"), F.count("*").alias("n")
    ).filter("n > 1").select(F.col("digest").alias("to_digest"), "to")
    again = large.join(one, F.col("digest") == F.col("to_digest")).filter("not (file = to.file and at = to.at)")
    entry = F.struct(
        "at", F.col("to.file").alias("to_file"), F.col("to.at").alias("to_at"), F.col("to.url").alias("to_url"), F.col("to.date").alias("to_date"),
        F.col("to.page_id").alias("to_page")
    )
    return again.groupBy("file").agg(F.collect_list(entry).alias("revisits"))


def _converter(target: str):
    def run(fs, base: str, row: dict) -> Iterator[tuple]:
        known = {x["at"]: (record_id(x["to_file"], x["to_at"]), x["to_url"], x["to_date"], x["to_page"]) for x in row["revisits"] or ()}
        name = re.sub(r"\.arc(\.gz)?$", "", row["file"]) + ".warc.gz"
        shard = _Shard(target, name)
        info = f"software: granary\r\nformat: WARC File Format 1.0\r\nconverted-from: {row['file']}\r\n".encode()
        shard.out.write(
            _member(
                warc_record(
                    [
                        ("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(name, 0)), ("WARC-Date", iso(DATE)), ("WARC-Filename", name),
                        ("Content-Type", "application/warc-fields")
                    ],
                    info
                ),
                3
            )
        )
        n = 0
        with fs.open_input_stream(f"{base}/{row['file']}") as f:
            for at, fields, body in arc_records(f):
                shard.out.write(_member(converted(row["file"], at, fields, body, known.get(at)), 3))
                n += 1
        shard.close()
        yield name, n

    return run


def convert(folder: str, files: DataFrame, target: str | None = None, least: int = REVISIT_BYTES) -> tuple[str, DataFrame]:
    """Converts the ARC files of a folder; returns the folder of the WARC files and (file, records)."""
    spark = files.sparkSession
    target = target or scratch_path(spark, "warc")
    again = revisits(index_arc(folder, files), least)
    work = files.select("file").join(again, "file", "left").repartition(max(1, files.count()), "file")
    schema = pa.schema([("file", pa.string()), ("records", pa.int64())])
    return target, written(map_arrow(work, _each_file(folder, _converter(target), schema), "file string, records bigint"), "warc-files")


def _read(fs, base: str, row: dict) -> Iterator[tuple]:
    with fs.open_input_stream(f"{base}/{row['file']}") as f:
        for fields, block in warc_records(f):
            if (kind := fields["warc-type"]) == "warcinfo":
                continue
            head, payload = split_http(block)
            said = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
            if kind != "revisit" and hashlib.sha1(payload).hexdigest() != said:
                raise ValueError(f"{fields['warc-record-id']} has not the payload that it declares")
            to = fields.get("x-refers-to-page-id")
            yield _page_id(head), int(fields["x-payload-length"]) if kind == "revisit" else len(payload), said, kind, int(to) if to is not None else None, fields["warc-target-uri"], fields["warc-record-id"], fields.get("warc-refers-to")


READ = pa.schema(
    [
        ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()),
        ("refers_to", pa.int64()), ("url", pa.string()), ("record_id", pa.string()), ("refers_to_record", pa.string())
    ]
)


def read_warc(spark: SparkSession, folder: str, files: DataFrame) -> DataFrame:
    """One row per record but warcinfo: page_id, payload_bytes, payload_digest, record_type, refers_to, url, record_id, refers_to_record."""
    each = files.select("file").repartition(max(1, files.count()), "file")
    return map_arrow(
        each, _each_file(folder, _read, READ),
        "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string, record_id string, refers_to_record string"
    )


SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS payload_digest, strlen(html) >= {REVISIT_BYTES} AND page_id IS NOT NULL AS large FROM p),
k AS (SELECT *, row_number() OVER (PARTITION BY payload_digest, large ORDER BY page_id DESC) AS place, max(page_id) OVER (PARTITION BY payload_digest, large) AS top FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN large AND place > 1 THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN large AND place > 1 THEN top END AS refers_to FROM k
"""
