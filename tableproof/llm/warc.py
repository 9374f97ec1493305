"""Operator 2: legacy ARC archives converted to WARC.

ARC header lines of version 1 (five fields) and version 2 (ten fields) are parsed by the version that
the archive's first block names, and bodies are cut by their declared lengths. WARC identifiers,
timestamps, types and digests are synthesised from them; of equal payloads one record is the response
and the others are revisits of it.

Archives are rows of a manifest (one row a file, a bounded size each), so listing, parsing, converting
and reading back are spread by file. Payloads never pass a shuffle: digests meet by group, and each file
gets back the marks of its own records. A task that is run again writes a file of another name; the
manifest, settled before it is used, says which files count."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableproof.llm.common import settled, store, work_dir

NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:tableproof:arc-record")
ROLL_BYTES = 128 << 20
PIECE = 1 << 20

#: The field lists that ARC archives of either version declare in their first block.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
MANIFEST = "file string, version int, records bigint, bytes bigint"
PARSED = ("file string, at bigint, uri string, ip string, date string, mime string, status string, page_id bigint, "
          "payload_bytes bigint, payload_digest string")
READ = ("file string, record_id string, record_type string, uri string, date string, page_id bigint, "
        "payload_bytes bigint, payload_digest string, refers_to_id string, refers_to bigint, digest_ok boolean")


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def rows_batch(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
    fields = [f.split() for f in ddl.split(", ")]
    return pa.RecordBatch.from_arrays(
        [pa.array([r[i] for r in rows], kinds[k]) for i, (_, k) in enumerate(fields)], [n for n, _ in fields])


def arc_head(version: int, uri: str, ip: str, date: str, mime: str, length: int, status: str = "200", at: int = 0,
             name: str = "-") -> bytes:
    middle = "" if version == 1 else f"{status} - - {at} {name} "
    return f"{uri} {ip} {date} {mime} {middle}{length}\n".encode()


def safe_uri(url: str | None, page_id: int | None) -> str:
    return quote(url, safe="%/:=&?~#+!$,;'@()*[]-._") if url else f"urn:page:{page_id}"


def arc_manifest(pages: DataFrame, date: str = "20200101000000", roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Pages (``page_id, url, html``) written as gzipped ARC archives; versions alternate by task.

    Null html is an empty payload, a null url a name made of the id. One row a file: its manifest."""
    root = work_dir(pages.sparkSession, "arc")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        version = 1 + TaskContext.get().partitionId() % 2
        system, base = store(root)
        system.create_dir(base, recursive=True)
        out, name, at, n, size = None, "", 0, 0, 0
        for batch in batches:
            for i in range(batch.num_rows):
                page_id, url, html = (batch.column(c)[i].as_py() for c in range(3))
                if out is None:
                    name, at, n, size = f"{uuid.uuid4().hex}.arc.gz", 0, 0, 0
                    out = system.open_output_stream(f"{base}/{name}")
                    block = f"{version} 0 tableproof\n{ARC_FIELDS[version]}\n".encode()
                    first = arc_head(version, f"filedesc://{name}", "0.0.0.0", date, "text/plain", len(block))
                    size += out.write(member(first + block + b"\n"))
                    at = len(first) + len(block) + 1
                payload = (html or "").encode("utf-8", "surrogatepass")
                mark = "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
                head = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n"
                        f"{mark}\r\n").encode()
                line = arc_head(version, safe_uri(url, page_id), "0.0.0.0", date, "text/html", len(head) + len(payload),
                                at=at, name=name)
                size += out.write(member(line + head + payload + b"\n"))
                at, n = at + len(line) + len(head) + len(payload) + 1, n + 1
                if at >= roll_bytes:
                    out.close()
                    yield rows_batch([(f"{root}/{name}", version, n, size)], MANIFEST)
                    out = None
        if out is not None:
            out.close()
            yield rows_batch([(f"{root}/{name}", version, n, size)], MANIFEST)

    return settled(pages.select("page_id", "url", "html").mapInArrow(work, MANIFEST), "arc-manifest")


def arc_records(stream) -> Iterator[tuple]:
    """``at, version, uri, ip, date, mime, status, body`` of every record but the first block."""

    at, version = 0, 0
    while text := stream.readline():
        start, at = at, at + len(text)
        if text in (b"\n", b"\r\n"):
            continue
        words = text.decode("utf-8", "replace").rstrip("\r\n")
        parts = words.rsplit(" ", 9 if version == 2 or (not version and words.count(" ") >= 9) else 4)
        length = int(parts[-1])
        body = stream.read(length)
        if len(body) != length:
            raise ValueError(f"record at {start} declares {length} bytes and has {len(body)}")
        at += length
        if not version:
            if not parts[0].startswith("filedesc:"):
                raise ValueError("an archive begins with a filedesc block")
            version = int(body.split(None, 1)[0])
            if version not in ARC_FIELDS:
                raise ValueError(f"archive version {version} is not known")
            continue
        yield start, version, parts[0], parts[1], parts[2], parts[3], parts[4] if version == 2 else None, body


def iso_date(digits: str) -> str:
    """ARC's 8 to 14 digits as a WARC timestamp; what is missing is the start of the period."""
    d = digits + "00000101000000"[len(digits):]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def split_http(body: bytes) -> tuple[bytes, bytes, int | None]:
    """Header block, payload, and the page id if the header carries one."""
    if not body.startswith(b"HTTP/"):
        return b"", body, None
    head, gap, payload = body.partition(b"\r\n\r\n")
    if not gap:
        return b"", body, None
    page = next((x.split(b":", 1)[1] for x in head.split(b"\r\n") if x.lower().startswith(b"x-page-id:")), None)
    return head + gap, payload, None if page is None else int(page)


def unpacked(system, name: str):
    """An archive's bytes as a stream; records of ``.gz`` archives are gzip members of their own."""
    raw = io.BufferedReader(system.open_input_stream(name), PIECE)
    return gzip.GzipFile(fileobj=raw) if name.endswith(".gz") else raw


def by_file(manifest: DataFrame) -> DataFrame:
    """The manifest dealt out a file a task."""
    return manifest.repartitionByRange(max(1, manifest.count()), "file")


def parse_arc(manifest: DataFrame) -> DataFrame:
    """What each ARC record says, and its payload's digest; payloads stay in the archive."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, name = store(path)
                rows = []
                with unpacked(system, name) as raw:
                    for at, _, uri, ip, date, mime, status, body in arc_records(raw):
                        _, payload, page = split_http(body)
                        rows.append((path, at, uri, ip, iso_date(date), mime, status, page, len(payload), sha1_base32(payload)))
                        if len(rows) >= 4096:
                            yield rows_batch(rows, PARSED)
                            rows = []
                yield rows_batch(rows, PARSED)

    return by_file(manifest).select("file").mapInArrow(work, PARSED)


def record_id(path: str, at: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, path.rsplit('/', 1)[-1] + ':' + str(at))}>"


def revisit_marks(parsed: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``file, marks``: of each archive, the records that revisit another one, and which.

    Of equal payloads of at least ``min_bytes`` bytes the one with the largest page id is the response;
    a repeated id is told apart by archive and offset. Digests are grouped with a map-side step; only
    records of shared payloads come back, by an equi join whose hot side adaptive execution splits."""
    keys = ["payload_digest", "payload_bytes"]
    known = parsed.filter(F.col("payload_bytes") >= min_bytes)
    groups = known.groupBy(*keys).agg(
        F.max(F.struct("page_id", "file", "at", "uri", "date")).alias("to"), F.count(F.lit(1)).alias("n")
    ).filter("n > 1").drop("n")
    # written, so that both sides of the join are dealt anew and a hot digest can be split
    groups = settled(groups, "shared-payloads")
    return (
        known.select(*keys, "file", "at").join(groups, keys)
        .filter((F.col("file") != F.col("to.file")) | (F.col("at") != F.col("to.at")))
        .groupBy("file").agg(F.collect_list(F.struct("at", "to")).alias("marks"))
    )


def warc_record(kind: str, rid: str, uri: str, date: str, ip: str, digest: str, head: bytes, payload: bytes,
                to: dict | None) -> bytes:
    block = head if to else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {rid}", f"WARC-Date: {date}", f"WARC-Target-URI: {uri}",
             f"WARC-IP-Address: {ip}", f"WARC-Block-Digest: sha1:{sha1_base32(block)}", f"WARC-Payload-Digest: sha1:{digest}",
             f"WARC-Payload-Length: {len(payload)}"]
    if to:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                  f"WARC-Refers-To: {record_id(to['file'], to['at'])}", f"WARC-Refers-To-Target-URI: {to['uri']}",
                  f"WARC-Refers-To-Date: {to['date']}"]
        if to["page_id"] is not None:
            lines.append(f"X-Refers-To-Page-Id: {to['page_id']}")
    lines += ["Content-Type: " + ("application/http; msgtype=response" if head else "application/octet-stream"),
              f"Content-Length: {len(block)}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def member(data: bytes, level: int = 1) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def convert_arc(manifest: DataFrame, min_bytes: int = 0) -> DataFrame:
    """ARC archives of the manifest converted, archive by archive, to gzipped WARC files in the shared folder;
    one row a file.

    A record with an HTTP header becomes a ``response``, one without it a ``resource``, and one whose payload
    is kept elsewhere a ``revisit``, which has the header block alone. Repeated records are records of their own; one record
    is held at a time, however long; an empty manifest gives no files."""
    spark = manifest.sparkSession
    root = work_dir(spark, "warc")
    marks = revisit_marks(settled(parse_arc(manifest), "arc-records"), min_bytes)
    given = manifest.select("file").join(marks, "file", "left").select("file", "marks")
    given = settled(given, "arc-marks").repartitionByRange(max(1, manifest.count()), "file")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                path, marks = batch.column(0)[i].as_py(), batch.column(1)[i].as_py() or []
                to_of = {m["at"]: m["to"] for m in marks}
                source, source_name = store(path)
                target, base = store(root)
                target.create_dir(base, recursive=True)
                name, n, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                with unpacked(source, source_name) as raw, target.open_output_stream(f"{base}/{name}") as out:
                    info = f"format: WARC File Format 1.1\r\nisPartOf: {path.rsplit('/', 1)[-1]}\r\n".encode()
                    first = (f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: {record_id(path, -1)}\r\n"
                             f"WARC-Filename: {name}\r\nContent-Type: application/warc-fields\r\n"
                             f"Content-Length: {len(info)}\r\n\r\n").encode() + info + b"\r\n\r\n"
                    out.write(member(first))
                    for at, _, uri, ip, date, _, _, body in arc_records(raw):
                        head, payload, _ = split_http(body)
                        to = to_of.get(at)
                        kind = "revisit" if to else "response" if head else "resource"
                        data = member(warc_record(kind, record_id(path, at), uri, iso_date(date), ip,
                                                  sha1_base32(payload), head, payload, to))
                        out.write(data)
                        n, size = n + 1, size + len(data)
                yield rows_batch([(f"{root}/{name}", 1, n, size)], MANIFEST)

    return settled(given.mapInArrow(work, MANIFEST), "warc-manifest")


def members(stream) -> Iterator[bytes]:
    """Every gzip member of a file, whole, read in pieces."""
    rest, ended = b"", False
    while True:
        packer, got = zlib.decompressobj(31), []
        while not packer.eof:
            if not rest:
                rest = stream.read(PIECE)
                if not rest:
                    ended = True
                    break
            got.append(packer.decompress(rest))
            rest = packer.unused_data
        if got:
            if not packer.eof:
                raise ValueError("an archive ends within a record")
            yield b"".join(got)
        if ended:
            return


def read_warc(manifest: DataFrame) -> DataFrame:
    """The records of the WARC files: identifiers, types, digests checked against the bytes that lie there.
    The block's length is the declared one; a revisit keeps the digest and length of the full payload."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, name = store(path)
                rows = []
                with system.open_input_stream(name) as raw:
                    for data in members(raw):
                        top, _, rest = data.partition(b"\r\n\r\n")
                        said = dict(x.split(": ", 1) for x in top.decode().split("\r\n")[1:])
                        kind = said["WARC-Type"]
                        if kind == "warcinfo":
                            continue
                        block = rest[: int(said["Content-Length"])]
                        head, payload, page = split_http(block)
                        digest = said["WARC-Payload-Digest"].removeprefix("sha1:")
                        good = said["WARC-Block-Digest"] == f"sha1:{sha1_base32(block)}" and len(rest) == len(block) + 4
                        n = int(said["WARC-Payload-Length"])
                        if kind != "revisit":
                            good, n = good and sha1_base32(payload) == digest and n == len(payload), len(payload)
                        to = said.get("X-Refers-To-Page-Id")
                        rows.append((path, said["WARC-Record-ID"], kind, said["WARC-Target-URI"], said["WARC-Date"], page, n,
                                     digest, said.get("WARC-Refers-To"), None if to is None else int(to), good))
                        if len(rows) >= 4096:
                            yield rows_batch(rows, READ)
                            rows = []
                yield rows_batch(rows, READ)

    return by_file(manifest).select("file").mapInArrow(work, READ)


def pages_to_warc(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Pages through ARC archives to WARC files, read back: one row a page, from the bytes of the files.

    Null html is an empty payload and shares its digest with the other empty ones; repeated rows are
    records of their own; an empty table gives no archive and no rows; further columns are not read."""
    return read_warc(convert_arc(arc_manifest(pages), min_bytes))
