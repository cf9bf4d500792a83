"""Web archives: legacy ARC files to WARC.

ARC records carry one header line, whose fields depend on the version that the file's first record declares, and a
declared length. The converter reads both, synthesises what WARC asks for (identifier, date, type, digests) and writes
archives with Spark's text writer: a row is a record without its closing \\r\\n\\r\\n, which is the line separator.
Archives are gzip files, read back as a stream of lines and cut by declared lengths, so no file is held in memory.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator
from datetime import datetime
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import written

#: Field names of ARC header lines by version: fixed values of the format.
ARC_FIELDS = {
    1: ("url", "ip", "date", "type", "length"),
    2: ("url", "ip", "date", "type", "result", "checksum", "location", "offset", "filename", "length"),
}
ARC_TITLES = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
END = b"\r\n\r\n"
#: An ARC file is closed once it holds so many bytes.
ARC_BYTES = 4 << 20
RECORD = "record_id string, url string, ip string, date string, type string, page_id long, http binary, payload binary, payload_bytes long, payload_digest string"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# --- ARC -------------------------------------------------------------------------------------------------------------


def to_arc(pages: DataFrame, date: str = "20240101000000") -> DataFrame:
    """name, content: ARC files of up to ARC_BYTES and one record, with the pages of a partition in their order.

    Files of version 1 and 2 alternate. A page's content is an HTTP response; its page_id travels in a header of that
    response. A null html is an empty payload, a null url is urn:page:<page_id>.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, n, parts, held = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            for page_id, url, html in zip(batch["page_id"], batch["url"], batch["html"], strict=True):
                version, name = n % 2 + 1, f"part-{part:06d}-{n:06d}.arc"
                if not parts:
                    first = f"{version} 0 shelfscope\n{ARC_TITLES[version]}\n".encode()
                    rest = {1: "text/plain", 2: f"text/plain 200 - - 0 {name}"}[version]
                    parts = [f"filedesc://{name} 0.0.0.0 {date} {rest} {len(first)}\n".encode(), first, b"\n"]
                number = "" if pd.isna(page_id) else str(int(page_id))
                payload = html.encode("utf-8", "surrogatepass") if isinstance(html, str) else b""
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\nX-Page-Id: {number}\r\n\r\n".encode()
                where = quote(url, safe="/:?#[]@!$&'()*+,;=%~") if isinstance(url, str) and url.strip() else f"urn:page:{number}"
                size = len(head) + len(payload)
                rest = {1: "text/html", 2: f"text/html 200 - - {held} {name}"}[version]
                parts += [f"{where} 0.0.0.0 {date} {rest} {size}\n".encode(), head, payload, b"\n"]
                held += size
                if held >= ARC_BYTES:
                    yield pd.DataFrame({"name": [name], "content": [b"".join(parts)]})
                    n, parts, held = n + 1, [], 0
        if parts:
            yield pd.DataFrame({"name": [f"part-{part:06d}-{n:06d}.arc"], "content": [b"".join(parts)]})

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInPandas(run, "name string, content binary")


#: Where an HTTP header ends: servers of the time of ARC closed lines by CRLF, by LF or by either.
HEADER_END = re.compile(rb"\r?\n\r?\n")
#: Header lines by version. Urls, types and redirect targets with spaces are told by the address, date and numbers around them.
ARC_LINES = {
    1: re.compile(r"(?P<url>.+) (?P<ip>[0-9A-Fa-f.:]+|-) (?P<date>[0-9]{4,14}) (?P<type>.*) (?P<length>[0-9]+)\r?"),
    2: re.compile(r"(?P<url>.+) (?P<ip>[0-9A-Fa-f.:]+|-) (?P<date>[0-9]{4,14}) (?P<type>.*?) (?P<result>[0-9]+|-) (?P<checksum>\S+) (?P<location>.*) (?P<offset>[0-9]+|-) (?P<filename>.+) (?P<length>[0-9]+)\r?"),
}
#: Where the next record may begin after one that cannot be read: a line that starts like a url and ends with a date, more fields and a length.
NEXT_LINE = re.compile(rb"\n(?=[a-z][a-z0-9+.-]*:[^\n]* [0-9]{8,14} [^\n]*[0-9]+\r?\n)")


def http_parts(block: bytes) -> tuple[bytes, bytes]:
    """HTTP header (lines closed by CRLF, the last one left open) and payload of a record's block. Only what begins with a status
    line has a header; of other records (dns:, whois:) the block is the payload."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    end = HEADER_END.search(block)
    head, payload = (block[: end.start()], block[end.end() :]) if end else (block.rstrip(b"\r\n"), b"")
    return b"\r\n".join(x.rstrip(b"\r") for x in head.split(b"\n")), payload


def http_fields(http: bytes) -> dict[str, str]:
    """Header fields by lower-case name, the first of each; bytes above ASCII are Latin-1."""
    fields: dict[str, str] = {}
    for line in http.decode("latin-1").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            fields.setdefault(name.strip().lower(), value.strip())
    return fields


def _arc_record(name: str, content: bytes, at: int, version: int | None) -> tuple[int, int, tuple | None]:
    """Version, end and row of the record that begins at `at`; no row for a version block."""
    end = content.find(b"\n", at)
    if end < 0:
        raise ValueError(f"{name}: a header line without end at {at}")
    text = content[at:end].decode("utf-8", "replace")
    if version is None:
        if not text.startswith("filedesc:"):
            raise ValueError(f"{name}: no version block")
        said = content[end + 1 : end + 20].split(b" ", 1)[0].decode("utf-8", "replace")
        if not said.isdigit() or int(said) not in ARC_FIELDS:
            raise ValueError(f"{name}: version {said!r} is unknown")
        version = int(said)
    line = ARC_LINES[version].fullmatch(text)
    if not line:
        raise ValueError(f"{name}: no header line of version {version} at {at}")
    head = line.groupdict()
    begin, at = end + 1, end + 1 + int(head["length"])
    if at > len(content):
        raise ValueError(f"{name}: a record of {head['length']} bytes passes the end")
    # a line end closes a record, but some writers count it as part of the block
    if content[at : at + 1] not in (b"", b"\n", b"\r") and not (content[at - 1 : at] == b"\n" and ARC_LINES[version].fullmatch(content[at : content.find(b"\n", at)].decode("utf-8", "replace"))):
        raise ValueError(f"{name}: a record at {begin} does not end after {head['length']} bytes")
    if head["url"].startswith("filedesc:"):
        return version, at, None
    http, payload = http_parts(content[begin:at])
    number = http_fields(http).get("x-page-id", "")
    d = head["date"].ljust(14, "0") if len(head["date"]) != 8 else head["date"] + "0" * 6  # seconds or times may be left out
    try:
        datetime.strptime(d, "%Y%m%d%H%M%S")
    except ValueError:
        raise ValueError(f"{name}: the date {head['date']!r} at {begin}") from None
    date = f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"
    record = uuid.uuid5(uuid.NAMESPACE_URL, f"{name}#{begin} {head['url']} {d}")
    url = quote(head["url"], safe="/:?#[]@!$&'()*+,;=%~")
    return version, at, (f"urn:uuid:{record}", url, head["ip"], date, head["type"], int(number) if number.isdigit() else None, http, payload, len(payload), digest(payload))


def arc_records(name: str, content: bytes, bad: list[tuple] | None = None) -> Iterator[tuple]:
    """Rows of RECORD for the records of one ARC file after its version block. Records that cannot be read raise ValueError; with
    a list `bad` they go there as (name, place, error, first bytes) and reading goes on at the next header line."""
    at, version = 0, None
    while at < len(content):
        if content[at : at + 1] in (b"\n", b"\r"):  # what closes a record
            at += 1
            continue
        try:
            version, at, row = _arc_record(name, content, at, version)
            if row:
                yield row
        except ValueError as e:
            if bad is None:
                raise
            bad.append((name, at, str(e), content[at : at + 200]))
            there = NEXT_LINE.search(content, at)
            if version is None or not there:
                return
            at = there.end()


def read_arc(files: DataFrame) -> DataFrame:
    """RECORD rows of ARC files (name, content). A record that cannot be read ends the job; see `read_arc_or_set_aside`."""
    return read_arc_or_set_aside(files, strict=True).select(*_names(RECORD))


BAD = "name string, place long, error string, bytes binary"


def _names(schema: str) -> list[str]:
    return [x.split(" ")[0] for x in schema.split(", ")]


def read_arc_or_set_aside(files: DataFrame, strict: bool = False) -> DataFrame:
    """RECORD rows of ARC files (name, content), and rows of BAD for records that cannot be read: where they begin, why, and
    their first bytes. Rows of records have no error, rows of errors no record_id. Null contents and empty files have no rows,
    a file without a version block is one error."""

    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(x.split(" ")[0], kinds[x.split(" ")[1]]) for x in f"{RECORD}, {BAD}".split(", ")])
    n_record, n_bad = len(_names(RECORD)), len(_names(BAD))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content"), strict=True):
                bad: list[tuple] = []
                rows = [(*r, *[None] * n_bad) for r in arc_records(name, content.as_py() or b"", None if strict else bad)]
                rows += [(*[None] * n_record, *r) for r in bad]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return files.select("name", "content").mapInArrow(run, f"{RECORD}, {BAD}")


# --- WARC ------------------------------------------------------------------------------------------------------------


def with_revisits(records: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Adds refers_to, refers_url and refers_date, null for responses.

    Of records with equal payloads of at least least_bytes bytes the one with the largest page_id (then the largest
    record_id; null ids come first) is the response. Only digests with two or more records take part in the join, whose
    sides adaptive execution can split if one payload holds a large part of all records.
    """
    first = F.max(F.struct("page_id", "record_id", "url", "date"))
    again = records.where(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest").agg(first.alias("r"), F.count("*").alias("n")).where("n > 1")
    again = written(again.select(F.col("payload_digest").alias("d"), "r"), "revisits")
    out = records.join(again, records["payload_digest"] == again["d"], "left")
    other = F.col("r.record_id") != F.col("record_id")
    return out.select(records["*"], *(F.when(other, F.col(f"r.{x}")).alias(y) for x, y in (("record_id", "refers_to"), ("url", "refers_url"), ("date", "refers_date"))))


def warc_record(r) -> bytes:
    """A record without its closing \\r\\n\\r\\n. A revisit keeps the HTTP header and leaves out the payload; a record without
    HTTP header is a resource of its own type, whole even if its payload was seen before."""
    plain = not r.http
    revisit = isinstance(r.refers_to, str) and not plain
    block = r.payload if plain else r.http + END + (b"" if revisit else r.payload)
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'resource' if plain else 'response'}",
        f"WARC-Record-ID: <{r.record_id}>",
        f"WARC-Date: {r.date}",
        f"WARC-Target-URI: {r.url}",
        f"WARC-IP-Address: {r.ip}",
        f"WARC-Payload-Digest: sha1:{r.payload_digest}",
        f"WARC-Block-Digest: sha1:{digest(block)}",
        f"Content-Type: {r.type}" if plain else "Content-Type: application/http; msgtype=response",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{r.refers_to}>", f"WARC-Refers-To-Target-URI: {r.refers_url}", f"WARC-Refers-To-Date: {r.refers_date}", f"X-Payload-Length: {r.payload_bytes}"]
    return "\r\n".join([*head, f"Content-Length: {len(block)}"]).encode() + END + block


def write_warc(records: DataFrame, path: str) -> None:
    """Writes one gzip WARC file per partition: a warcinfo record, then one record per row. Repeated rows are records of their
    own; partitions without rows give files without records; a null page_id or refers_to is left out. Columns other than
    those of RECORD and of with_revisits are not read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = True
        for batch in batches:
            out = [warc_record(r) for r in batch.itertuples(index=False)]
            if first and out:
                info = b"software: shelfscope\r\nformat: WARC File Format 1.1\r\n"
                name = uuid.uuid5(uuid.NAMESPACE_URL, batch["record_id"].iloc[0])
                head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{name}>\r\nWARC-Date: {batch['date'].iloc[0]}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}"
                out, first = [head.encode() + END + info, *out], False
            yield pd.DataFrame({"value": out})

    rows = records.mapInPandas(run, "value binary").select(F.col("value").cast("string"))  # bytes stay as they are
    rows.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


def warc_rows(lines: Iterator[bytes]) -> Iterator[tuple]:
    """Rows (type, record id, refers to, page_id, payload bytes, digest) of the lines of archives, by declared lengths."""
    held = bytearray()
    need = 0
    for line in lines:
        held += line + b"\n"
        while len(held) >= need:
            begin = held.find(END)
            if begin < 0:
                need = len(held) + 1
                break
            head = dict(x.split(": ", 1) for x in held[:begin].decode("utf-8", "replace").split("\r\n")[1:])
            begin += len(END)
            end = begin + int(head["Content-Length"])
            if len(held) < end + len(END):
                need = end + len(END)
                break
            if held[end : end + len(END)] != END:
                raise ValueError(f"{head['WARC-Record-ID']}: the declared length is wrong")
            block = bytes(held[begin:end])
            del held[: end + len(END)]
            need = 0
            if head["WARC-Type"] in ("response", "revisit", "resource"):
                http, _, payload = block.partition(END) if head["WARC-Type"] != "resource" else (b"", b"", block)
                http_head = http_fields(http)
                said = head["WARC-Payload-Digest"].removeprefix("sha1:")
                if head["WARC-Type"] != "revisit" and digest(payload) != said:
                    raise ValueError(f"{head['WARC-Record-ID']}: the payload does not match its digest")
                number, size = http_head.get("x-page-id", ""), str(len(payload))
                if head["WARC-Type"] == "revisit":  # its own record says how long the payload is; other writers leave that to the header
                    size = head.get("X-Payload-Length", http_head.get("content-length", ""))
                yield head["WARC-Type"], head["WARC-Record-ID"][1:-1], head.get("WARC-Refers-To", "<>")[1:-1] or None, int(number) if number.isdigit() else None, int(size) if size.isdigit() else None, said
            if not held:
                break
    if held:
        raise ValueError("an archive ends inside a record")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """record_type, record_id, refers_to, page_id, payload_bytes, payload_digest of responses, revisits and resources.

    A gzip file is one split, so a task sees the lines of whole files in order.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("value").cast("binary"))
    names = ["record_type", "record_id", "refers_to", "page_id", "payload_bytes", "payload_digest"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = []
        for row in warc_rows(line for batch in batches for line in batch["value"]):
            rows.append(row)
            if len(rows) == 2000:
                yield pd.DataFrame(rows, columns=names).astype({"page_id": "Int64", "payload_bytes": "Int64"})
                rows = []
        if rows:
            yield pd.DataFrame(rows, columns=names).astype({"page_id": "Int64", "payload_bytes": "Int64"})

    return lines.mapInPandas(run, "record_type string, record_id string, refers_to string, page_id long, payload_bytes long, payload_digest string")


def archived(pages: DataFrame, path: str, least_bytes: int = 0) -> DataFrame:
    """Converts pages to WARC archives at path and returns what they hold, revisits resolved to the page they repeat.

    Null html is an empty payload; null page_ids stay null; repeated rows are records of their own; an empty table gives
    no archive and no rows. Only page_id, url and html are read.
    """
    spark = pages.sparkSession
    write_warc(with_revisits(read_arc(to_arc(pages)), least_bytes), path)
    rows = written(read_warc(spark, path), "warc-rows")
    first = rows.where("record_type = 'response'").select(F.col("record_id").alias("__id"), F.col("page_id").alias("__page"))
    out = rows.join(first, rows["refers_to"] == first["__id"], "left")
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", F.col("__page").alias("refers_to"))
