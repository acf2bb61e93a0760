"""Legacy ARC archives: writing them, reading them, and converting them to WARC.

Archives are written with Spark's text writer: a row is a run of whole records, so files hold whole
records and stay small, and they are read as binary files and parsed by the lengths they declare."""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmill.llm.common import per_batch, saved
from gridmill.sources.shared import scratch

#: Bytes of records in a row, and rows in a file, at most besides the last record.
RUN, RUNS = 4 << 20, 4
#: Payloads shorter than this are never replaced by a revisit.
LEAST_REVISIT = 100
#: Revisits up to this number (about 150 bytes each) are broadcast; more are joined by shuffle.
BROADCAST_REFS = 1 << 17

# The field lines of both versions of the format.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}


class _Runs:
    """Records put together to runs, each run with `head` before it."""

    def __init__(self, head: bytes = b"", between: bytes = b""):
        self.head, self.between, self.held, self.size = head, between, [], 0

    def add(self, record: bytes) -> Iterator[bytes]:
        self.held.append(record)
        self.size += len(record)
        if self.size >= RUN:
            yield from self.rest()

    def rest(self) -> Iterator[bytes]:
        if self.held:
            yield self.head + self.between.join(self.held)
            self.held, self.size = [], 0


def _image(run: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([run], pa.binary())], ["value"])


def _write(images: DataFrame, path: str, end: bytes) -> None:
    """Writes runs of records as files; `end` follows the last record of each run.

    Archives are written once and read a few times, so they are packed at the fastest level."""
    rows = images.select(F.col("value").cast("string"))
    rows.write.option("lineSep", end.decode()).option("maxRecordsPerFile", RUNS).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")


def _content(raw: bytes) -> bytes:
    """The file's bytes, unpacked where they are one or more gzip members."""
    out = []
    while raw[:2] == b"\x1f\x8b":
        z = zlib.decompressobj(31)
        out.append(z.decompress(raw))
        raw = z.unused_data
    return b"".join(out) or raw


def page_block(page_id: int | None, html: str | None) -> bytes:
    """HTTP response with the page as its payload."""
    body = (html or "").encode("utf-8", "surrogatepass")
    who = "-" if page_id is None else str(page_id)
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\nX-Page-Id: {who}\r\n\r\n".encode() + body


#: The address of a version block.
_RESERVED = re.compile("^(filedesc):", re.IGNORECASE)


def write_arc(pages: DataFrame, path: str, version: int | str = 1, date: str = "20240101000000") -> None:
    """Writes pages (page_id, url, html) as ARC records.

    version: 1, 2, or a column that holds either; every run of records begins with its version's own
    block. Blanks and control characters in an address are percent-encoded, and so is the colon after
    filedesc, which is the name of version blocks; a null or empty address becomes urn:page:<id>; a
    null page is the empty payload."""

    def head(v: int) -> bytes:
        note = f"{v} 0 writer\n{FIELDS[v]}\n".encode()
        more = "" if v == 1 else "200 - - 0 pages.arc "
        return f"filedesc://pages.arc 0.0.0.0 {date} text/plain {more}{len(note)}\n".encode() + note + b"\n"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = {v: _Runs(head(v), b"\n") for v in FIELDS}
        for b in batches:
            for page_id, url, html, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3).to_pylist(), strict=True):
                block = page_block(page_id, html.as_py())
                where = quote(url, safe="".join(map(chr, range(33, 127)))) if url else f"urn:page:{page_id}"
                where = _RESERVED.sub(r"\1%3A", where)
                more = "" if v == 1 else "200 - - 0 pages.arc "
                yield from map(_image, runs[v].add(f"{where} 0.0.0.0 {date} text/html {more}{len(block)}\n".encode() + block))
        for r in runs.values():
            yield from map(_image, r.rest())

    kind = F.lit(version) if isinstance(version, int) else F.col(version)
    _write(per_batch(pages.select("page_id", "url", "html", kind.cast("int").alias("version")), run, "value binary"), path, b"\n")


_LINE = re.compile(rb"\n*([^\n]*)\n")
#: How the block of a version block begins: with its version, a number, and who wrote it.
_VERSION = re.compile(rb"([12]) \d+ [^\n]*\n")


def arc_records(raw: bytes) -> Iterator[dict]:
    """Records of an ARC file by their declared lengths; version blocks set the field layout.

    A version block has a filedesc: address, the type text/plain, and begins with its version; any
    other record of such an address is one like all others. A record cut off by the file's end comes
    with truncated set; a line that fits no layout is an error that names its place."""
    version, at = 1, 0
    while found := _LINE.match(raw, at):
        line = found[1].rstrip(b"\r").split(b" ")
        if line == [b""]:
            break
        reserved = line[0].startswith(b"filedesc:")
        layout = (1 if len(line) == 5 else 2) if reserved else version
        names = FIELDS[layout].split(" ")
        if len(line) != len(names) or not line[-1].isdigit():
            raise ValueError(f"no ARC header line of version {layout} at byte {found.start(1)}")
        fields = dict(zip(names, (x.decode("utf-8", "replace") for x in line), strict=True))
        start = found.end()
        block = raw[start : start + int(line[-1])]
        at = start + len(block)
        if reserved and fields["Content-type"] == "text/plain" and (declared := _VERSION.match(block)):
            version = int(declared[1])
            continue
        yield {"fields": fields, "block": block, "truncated": len(block) < int(line[-1])}


def _http(block: bytes) -> tuple[bytes, dict[str, str], bytes]:
    """Header part, its fields and the payload of an HTTP response; other blocks are all payload."""
    if not block.startswith(b"HTTP/") or b"\r\n\r\n" not in block:
        return b"", {}, block
    head, _, body = block.partition(b"\r\n\r\n")
    lines = (x.partition(b":") for x in head.split(b"\r\n")[1:])
    return head + b"\r\n\r\n", {k.decode("latin-1").lower(): v.decode("latin-1").strip() for k, _, v in lines}, body


def _identifier(*parts: str) -> str:
    """Record identifier that equal records share at every conversion."""
    return uuid.UUID(bytes=hashlib.sha256("\n".join(parts).encode("utf-8", "surrogatepass")).digest()[:16], version=5).urn


_RECORDS = "record_id string, uri string, date string, mime string, page_id long, digest string, size long, truncated boolean"


def _fields(raw: bytes) -> Iterator[tuple[dict, bytes]]:
    """The WARC fields that follow from each record of an ARC file, and its block."""
    for r in arc_records(raw):
        f = r["fields"]
        _, http, body = _http(r["block"])
        day = f["Archive-date"].ljust(14, "0")
        digest, page = hashlib.sha256(body).hexdigest(), http.get("x-page-id", "-")
        yield {
            "record_id": _identifier(f["URL"], day, page, digest), "uri": f["URL"], "date": f"{day[:4]}-{day[4:6]}-{day[6:8]}T{day[8:10]}:{day[10:12]}:{day[12:14]}Z",
            "mime": f["Content-type"], "page_id": int(page) if page.lstrip("-").isdigit() else None, "digest": digest, "size": len(body), "truncated": r["truncated"],
        }, r["block"]


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """Records of all ARC files under path: their file and the WARC fields that follow from them."""
    names = [x.split(" ")[0] for x in _RECORDS.split(", ")]
    kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, raw in zip(b.column(0), b.column(1), strict=True):
                rows = [r for r, _ in _fields(_content(raw.as_py()))]
                yield pa.RecordBatch.from_arrays([pa.array([file.as_py()] * len(rows), pa.string()), *(pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds, strict=True))], ["file", *names])

    return per_batch(_files(spark, path), run, "file string, " + _RECORDS)


def _record(kind: str, row: dict, block: bytes, refers_to: str | None, target: str | None) -> bytes:
    head, _, _ = _http(block)
    block = head if kind == "revisit" else block
    http = bool(head)
    lines = [
        ("WARC-Type", kind if http or kind == "revisit" else "resource"), ("WARC-Record-ID", f"<{row['record_id']}>"), ("WARC-Date", row["date"]), ("WARC-Target-URI", row["uri"]),
        ("WARC-Payload-Digest", f"sha256:{row['digest']}"), ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
        ("Content-Type", "application/http; msgtype=response" if http else row["mime"]), ("Content-Length", str(len(block))),
    ]
    if kind == "revisit":
        lines += [("WARC-Refers-To", f"<{refers_to}>"), ("WARC-Refers-To-Target-URI", target or ""), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    if row["truncated"]:
        lines.append(("WARC-Truncated", "length"))
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines) + "\r\n").encode() + block


def convert(spark: SparkSession, arc_path: str, warc_path: str) -> None:
    """Writes the ARC files under arc_path as WARC files.

    Of records with equal payloads of LEAST_REVISIT bytes or more, that with the smallest page id
    is a response and the others revisit it; records without a page id are never revisits. A file's
    revisits meet it as one array, no longer than the file has records."""
    heads = saved(read_arc(spark, arc_path), "heads")
    long_ = heads.where(F.col("page_id").isNotNull() & (F.col("size") >= LEAST_REVISIT))
    first = long_.groupBy("digest").agg(F.min(F.struct("page_id", "record_id", "uri")).alias("first"), F.count("*").alias("n")).where("n > 1")
    refs = long_.join(first, "digest").where("page_id <> first.page_id").select("file", "record_id", F.col("first.record_id").alias("refers_to"), F.col("first.uri").alias("target")).distinct()
    by_file = saved(refs.groupBy("file").agg(F.collect_list(F.struct("record_id", "refers_to", "target")).alias("refs"), F.count("*").alias("n")), "revisits")
    few = (by_file.agg(F.sum("n")).first()[0] or 0) <= BROADCAST_REFS
    by_file = by_file.select(F.col("file").alias("path"), "refs")
    files = _files(spark, arc_path).join(F.broadcast(by_file) if few else by_file, "path", "left").select("content", "refs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = _Runs(between=b"\r\n\r\n")
        for b in batches:
            for raw, refs_ in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                again = {r["record_id"]: r for r in refs_ or ()}
                for row, block in _fields(_content(raw.as_py())):
                    ref = again.get(row["record_id"])
                    made = _record("revisit", row, block, ref["refers_to"], ref["target"]) if ref else _record("response", row, block, None, None)
                    yield from map(_image, runs.add(made))
        yield from map(_image, runs.rest())

    _write(per_batch(files, run, "value binary"), warc_path, b"\r\n\r\n")


def warc_records(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-cased names) and block of each record, by the declared lengths."""
    at = 0
    while at < len(raw):
        end = raw.find(b"\r\n\r\n", at)
        lines = raw[at:end].decode("utf-8", "replace").split("\r\n")
        if end < 0 or not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        start = end + 4
        size = int(fields["content-length"])
        yield fields, raw[start : start + size]
        at = start + size + 4


_PAGES = "record_id string, page_id long, record_type string, payload_bytes long, payload_digest string, refers_id string"


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of all WARC files under path; a revisit has the length and digest of the full payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw in b.column(0):
                rows = []
                for fields, block in warc_records(_content(raw.as_py())):
                    _, http, body = _http(block)
                    page, again = http.get("x-page-id", "-"), fields["warc-type"] == "revisit"
                    size = int(http.get("content-length", 0)) if again else len(body)
                    digest = fields["warc-payload-digest"].partition(":")[2] if again else hashlib.sha256(body).hexdigest()
                    rows.append((fields["warc-record-id"].strip("<>"), int(page) if page.lstrip("-").isdigit() else None, fields["warc-type"], size, digest, fields.get("warc-refers-to", "").strip("<>") or None))
                kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], k) for i, k in enumerate(kinds)], names)

    names = [x.split(" ")[0] for x in _PAGES.split(", ")]
    return per_batch(_files(spark, path).select("content"), run, _PAGES)


def archived(pages: DataFrame) -> DataFrame:
    """Pages taken through ARC files of both versions into WARC files and read back.

    pages: page_id, url, html; other columns are ignored. A null page has the empty payload; a null
    page_id comes back null and is a response; rows with equal id and payload are each a response
    or each a revisit; an empty table gives no rows.
    Returns page_id, payload_bytes, payload_digest, record_type, refers_to (page_id of the response
    that a revisit stands for)."""
    spark = pages.sparkSession
    arc, warc = scratch(spark, "arc"), scratch(spark, "warc")
    version = F.when(F.col("page_id") % 2 != 0, 2).otherwise(1)
    write_arc(pages.select("page_id", "url", "html", version.alias("version")), arc, "version")
    convert(spark, arc, warc)
    rows = saved(read_warc(spark, warc), "archived")
    named = rows.where("record_type = 'response'").select(F.col("record_id").alias("refers_id"), F.col("page_id").alias("refers_to")).dropDuplicates(["refers_id"])
    again = rows.where("record_type = 'revisit'").join(named, "refers_id", "left")
    plain = rows.where("record_type <> 'revisit'").withColumn("refers_to", F.lit(None).cast("long"))
    out = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return plain.select(*out).unionByName(again.select(*out))
