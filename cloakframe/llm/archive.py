"""Legacy archive converter: ARC files to WARC records.

An ARC file opens with a version block, whose second line names the version: 1 has five fields in
a record's header line (URL, address, date, type, length), 2 has ten (result code, checksum,
location, offset and file name before the length). The header line is read around its address and date, so that
blanks in a URL or a type do no harm, and the declared length says where the next record starts.

Each record becomes the WARC record that says the same: the version block a ``warcinfo``, a block
that starts with an HTTP status line a ``response``, anything else a ``resource``. The date's digits
become an ISO time; the identifier is the name-based UUID of archive, offset and header line, so
that a second run gives the same; block and payload get SHA-1 digests in base 32.

Defined cases: null contents give no rows, nor do empty contents or empty tables; members compressed by gzip are
expanded a piece at a time; of a broken member what could be expanded is kept, reading goes on with the next member, and
the break counts in ``skipped`` like a line; a record that is cut short keeps what there is and says
``WARC-Truncated``; a line that isn't a header is skipped up to its end and counted in the next
row's ``skipped`` (at the end of an archive in a row of type null); a record whose date isn't one gets that of the version block,
or else of 1996-01-01, ``date_known`` is false and the field ``ARC-Date`` keeps the original; archives of any length are read whole;
repeated archives give repeated rows, null ids are kept. Other columns, whatever their names, aren't looked at.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
import zlib
from base64 import b32encode
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Records in a batch that goes back to Spark.
BATCH = 256

_NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:arc-record")
#: Bytes that are expanded at a time.
PIECE = 1 << 16
_MEMBER = b"\x1f\x8b\x08"
_NO_DATE = datetime(1996, 1, 1, tzinfo=timezone.utc)
_ADDRESS = rb"(?:\d{1,3}(?:\.\d{1,3}){3}|[0-9A-Fa-f]*:[0-9A-Fa-f:.]*|-)"
_TAILS = {1: rb"(.*) (\d+)", 2: rb"(.*) \S+ \S+ \S+ \S+ \S+ (\d+)"}
#: By version: with a full date behind an address, then with any date and address.
_HEADERS = {v: [re.compile(rb"(\S*:.*) (" + _ADDRESS + rb") (\d{14}) " + t), re.compile(rb"(\S*:.*) (\S+) (\d+) " + t)] for v, t in _TAILS.items()}

RECORD = (
    "record int, warc_type string, record_id string, target_uri string, ip_address string, warc_date timestamp, date_known boolean, content_type string, "
    "content_length long, block_digest string, payload_digest string, truncated boolean, skipped int, warc binary"
)


def segments(data: bytes) -> Iterator[tuple[bytes, int]]:
    """(contents, breaks) of the stretches between broken gzip members; bytes that aren't compressed as they are. ``breaks`` is
    1 for a stretch that ends in a broken member or in bytes that are none."""
    if data[:2] != b"\x1f\x8b":
        if data:
            yield data, 0
        return
    out, at, view = [], 0, memoryview(data)
    while at >= 0:
        z, start, whole = zlib.decompressobj(31), at, False
        try:
            while at < len(data) and not z.eof:
                out.append(z.decompress(view[at : at + PIECE]))
                at += PIECE
            whole = z.eof
        except zlib.error:
            pass
        if whole:
            at = min(at, len(data)) - len(z.unused_data)
            if data[at : at + 2] == b"\x1f\x8b":
                continue
            whole = not data[at:].strip(b"\0")
            start = at - 1
        if whole:
            break
        yield b"".join(out), 1
        out, at = [], data.find(_MEMBER, start + 1)
    if out:
        yield b"".join(out), 0


def expanded(data: bytes) -> bytes:
    """The contents behind any number of gzip members, as far as they are whole; bytes that aren't compressed as they are."""
    return b"".join(s for s, _ in segments(data))


def moment(digits: str) -> datetime | None:
    """An ARC date of 14 digits; shorter ones of 4, 6, 8, 10 or 12 mean the earliest such time."""
    if not digits.isascii() or not digits.isdigit() or len(digits) not in (4, 6, 8, 10, 12, 14):
        return None
    try:
        return datetime.strptime(digits + "00000101000000"[len(digits) :], "%Y%m%d%H%M%S").replace(tzinfo=timezone.utc)
    except ValueError:
        return None


def header(line: bytes, version: int) -> tuple[str, str, str, str, int] | None:
    """(url, address, date, type, length) of a header line, or None if it isn't one."""
    for form in _HEADERS[version]:
        if m := form.fullmatch(line.rstrip(b"\r")):
            url, address, date, kind = (x.decode("utf-8", "replace") for x in m.groups()[:4])
            return url, address, date, kind, int(m[5])
    return None


def records(data: bytes, version: int = 1, offset: int = 0, skipped: int = 0) -> Iterator[tuple[tuple | None, int, bytes, bool, int]]:
    """(header or None at the end, offset, block, truncated, skipped lines) of each record of an expanded archive."""
    at = 0
    while at < len(data):
        end = data.find(b"\n", at)
        if end < 0:
            end = len(data)
        line = data[at:end]
        if not line.strip():
            at = end + 1
            continue
        first = line.startswith(b"filedesc:")
        if first:
            version = _version(data, end)
        # The first header of a version 2 file may still be in the five fields of version 1.
        h = header(line, version) or (header(line, 1) if first else None)
        if h is None:
            skipped, at = skipped + 1, end + 1
            continue
        block = data[end + 1 : end + 1 + h[4]]
        yield h, offset + at, block, len(block) < h[4], skipped
        at, skipped = end + 1 + h[4], 0
    if skipped:
        yield None, offset + at, b"", False, skipped


def _version(data: bytes, end: int) -> int:
    return 2 if data[end + 1 : end + 2] == b"2" else 1


def archived(data: bytes) -> Iterator[tuple[tuple | None, int, bytes, bool, int]]:
    """What ``records`` gives, of an archive that may be compressed and broken; breaks count as skipped lines of what follows."""
    version, offset, skipped = 1, 0, 0
    for part, broken in segments(data):
        head = part.find(b"\n")
        if part.startswith(b"filedesc:") and head >= 0:
            version = _version(part, head)
        last = None
        for last in records(part, version, offset, skipped):
            skipped = 0
            if last[0] is not None:
                yield last
        # What is left over at a break counts in the record behind it.
        skipped = (last[4] if last and last[0] is None else skipped) + broken
        offset += len(part)
    if skipped:
        yield None, offset, b"", False, skipped


def _sha1(b: bytes) -> str:
    return "sha1:" + b32encode(hashlib.sha1(b).digest()).decode()


def _clean(value: str) -> str:
    return " ".join(value.split())


def converted(archive: str, number: int, found: tuple, otherwise: datetime = _NO_DATE) -> tuple:
    """The row, in the order of ``RECORD``, of what ``records`` yields; ``otherwise`` is the time of a record without one."""
    h, offset, block, cut, skipped = found
    if h is None:
        return number, None, None, None, None, None, None, None, None, None, None, None, skipped, None
    url, address, date, kind, _ = h
    known, payload = moment(date), None
    when = known or otherwise
    if url.startswith("filedesc:"):
        warc_type, content = "warcinfo", "application/warc-fields"
        body = f"software: ARC converter\r\nformat: WARC File Format 1.0\r\ndescription: {_clean(url)}\r\n".encode() + b"\r\n"
    elif block.startswith(b"HTTP/"):
        warc_type, content, body = "response", "application/http; msgtype=response", block
        split = min((i + len(s) for s in (b"\r\n\r\n", b"\n\n") if (i := block.find(s)) >= 0), default=len(block))
        payload = block[split:]
    else:
        warc_type, content, body = "resource", "text/dns" if url.startswith("dns:") else _clean(kind) or "application/octet-stream", block
        payload = block
    name = f"urn:uuid:{uuid.uuid5(_NAMESPACE, f'{archive}\0{offset}\0{url} {address} {date} {kind}')}"
    digest = _sha1(body)
    lines = ["WARC/1.0", f"WARC-Type: {warc_type}", f"WARC-Record-ID: <{name}>"]
    lines.append(f"WARC-Date: {when.year:04}-{when:%m-%dT%H:%M:%SZ}")
    if not known:
        lines.append(f"ARC-Date: {date}")
    if warc_type == "warcinfo":
        lines.append(f"WARC-Filename: {_clean(url.removeprefix('filedesc://'))}")
    else:
        lines.append(f"WARC-Target-URI: {_clean(url)}")
        if address and address not in ("0.0.0.0", "-"):
            lines.append(f"WARC-IP-Address: {_clean(address)}")
        lines.append(f"WARC-Payload-Digest: {_sha1(payload)}")
    if cut:
        lines.append("WARC-Truncated: unspecified")
    lines += [f"WARC-Block-Digest: {digest}", f"Content-Type: {content}", f"Content-Length: {len(body)}"]
    warc = "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"
    return number, warc_type, name, None if warc_type == "warcinfo" else url, address, when, known is not None, content, len(body), digest, None if payload is None else _sha1(payload), cut, skipped, warc


def convert(archives: DataFrame, id_col: str = "path", content_col: str = "content") -> DataFrame:
    """A row for each record of each archive: ``id_col`` and the fields of ``RECORD``; ``warc`` is the
    record in full, and concatenated they are a WARC file."""
    kind = archives.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, {RECORD}"
    narrow = archives.select(F.col(id_col).alias("id"), F.col(content_col).alias("content"))
    from pyspark.sql.pandas.types import to_arrow_schema

    empty = archives.sparkSession.createDataFrame([], schema)
    arrow = to_arrow_schema(empty.schema)

    def run(batches):
        for b in batches:
            rows, ids = [], []
            for key, content in zip(b.column(0).to_pylist(), b.column(1)):
                if not content.is_valid:
                    continue
                otherwise = _NO_DATE
                for number, found in enumerate(archived(content.as_py())):
                    if found[0] and found[0][0].startswith("filedesc:"):
                        otherwise = moment(found[0][2]) or otherwise
                    ids.append(key)
                    rows.append(converted(str(key), number, found, otherwise))
                    if len(rows) == BATCH:
                        yield _batch(ids, rows, arrow)
                        rows, ids = [], []
            if rows:
                yield _batch(ids, rows, arrow)

    return narrow.mapInArrow(run, schema)


def _batch(ids: list, rows: list[tuple], arrow: pa.Schema) -> pa.RecordBatch:
    columns = [ids, *map(list, zip(*rows))]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """The WARC records of all ARC files under ``path``, compressed or not."""
    return convert(spark.read.format("binaryFile").load(path))


def arc_file(name: str, entries: list[tuple[str, str, str, str, bytes]], version: int = 1, compress: bool = False) -> bytes:
    """An ARC file of (url, address, date, type, block) entries; compressed, each record is a gzip member of its own."""
    fields = b"URL IP-address Archive-date Content-type Archive-length\n"
    if version == 2:
        fields = b"URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length\n"
    member = (lambda b: gzip.compress(b, 1, mtime=0)) if compress else (lambda b: b)
    intro = b"%d 0 unknown\n" % version + fields
    parts = [member(b"filedesc://%s 0.0.0.0 19960101000000 text/plain %d\n" % (name.encode(), len(intro)) + intro + b"\n")]
    size = len(parts[0])
    for url, address, date, kind, block in entries:
        more = f" 200 - - {size} {name}" if version == 2 else ""
        parts.append(member(f"{url} {address} {date} {kind}{more} {len(block)}\n".encode() + block + b"\n"))
        size += len(parts[-1])
    return b"".join(parts)


#: Pages in an archive that ``arcs_of_pages`` makes.
PAGES = 100


def arcs_of_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", most: int = PAGES) -> DataFrame:
    """ARC files (``path``, ``content``) of up to ``most`` pages each, what a crawler of that time would have left: in the two versions
    and with or without compression by turns. They are named by their first page and how many came before in its partition.

    A null URL becomes ``unknown:``, a null page an empty block, a null id the time 1996-01-01.
    """

    def build(batches):
        made = 0
        for b in batches:
            names, out = [], []
            for k in range(0, b.num_rows, most):
                entries = []
                part = [c.to_pylist() for c in b.slice(k, most).columns]
                for key, url, html in zip(*part):
                    n = key if isinstance(key, int) else 0
                    date = datetime.fromtimestamp(820454400 + abs(n) % 1_000_000_000, timezone.utc)
                    block = b"HTTP/1.0 200 OK\r\nContent-Type: text/html\r\n\r\n" + html.encode() if html is not None else b""
                    entries.append(((url or "unknown:").replace("\n", "%0A"), "192.0.2.1", f"{date:%Y%m%d%H%M%S}", "text/html; charset=utf-8", block))
                compress = made // 2 % 2 == 1
                names.append(f"pages-{part[0][0]}-{made}.arc{'.gz' if compress else ''}")
                out.append(arc_file(names[-1], entries, 1 + made % 2, compress))
                made += 1
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(out, pa.binary())], ["path", "content"])

    return pages.select(id_col, url_col, html_col).mapInArrow(build, "path string, content binary")
