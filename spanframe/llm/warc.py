"""WARC archives: writing with segmentation and revisits, reading with segment reassembly.

Writing: of records with equal payloads of at least `REVISIT_BYTES` bytes the one with the largest id is stored, others
refer to it. A block longer than `SEGMENT_BYTES` is cut into a first record and continuation records, which the writer
puts into the archive after; payloads are in chunked transfer framing where they are long. An archive is one row (name,
data) of a table in shared storage, each record its own gzip member if asked for.

Reading: one scan parses records wherever they lie. Whole records are done at once; pieces are dealt by the id of the
record they began with, ordered by segment number and checked against the stated total length; then the HTTP head is cut
off, chunked framing is decoded and the payload's digest compared.

Defined cases: null payloads and addresses are empty; rows that repeat id and payload give one response and revisits of
it; damaged records, missing or repeated segments and wrong totals give a row with status other than "ok" and null
payload, and reading goes on at the next record; an empty table gives no archive and no record.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

REVISIT_BYTES = 1000
SEGMENT_BYTES = 4096
CHUNK_BYTES = 1500
ARCHIVE_BYTES = 8 << 20
#: Repeated payloads (some 60 bytes each) whose table is broadcast; with more, pages are dealt by digest.
BROADCAST_GROUPS = 200_000
_DATE = "2024-01-01T00:00:00Z"

# Records ------------------------------------------------------------------------------------------


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(c), c) for i in range(0, len(payload), size) for c in [payload[i : i + size]]]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunk(data: bytes) -> bytes:
    """The payload in chunked framing (extensions and trailers are passed over); ValueError if it is damaged."""
    out, at = [], 0
    while True:
        end = data.find(b"\r\n", at)
        if end < 0:
            raise ValueError("damaged chunk")
        size = int(data[at:end].split(b";")[0].strip() or b"x", 16)
        at = end + 2
        if not size:
            return b"".join(out)
        if data[at + size : at + size + 2] != b"\r\n":
            raise ValueError("damaged chunk")
        out.append(data[at : at + size])
        at += size + 2


def record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}"]
    return ("WARC/1.1\r\n" + "\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def page_records(page_id, url: str, payload: bytes, refers_to, is_revisit: bool, segment: int = SEGMENT_BYTES) -> list[bytes]:
    """The record of a page and its continuations."""
    sha = hashlib.sha1(payload)
    name = lambda i: f"<urn:page:{'' if i is None else i}:{sha.hexdigest()}>"
    digest = "sha1:" + base64.b32encode(sha.digest()).decode()
    headers = [("WARC-Record-ID", name(page_id)), ("WARC-Date", _DATE), ("WARC-Target-URI", re.sub(r"[\r\n]", "", url)), ("WARC-Payload-Digest", digest), ("Content-Type", "application/http; msgtype=response")]
    if is_revisit:
        headers[0] = ("WARC-Record-ID", name(page_id)[:-1] + ":revisit>")
        headers += [("WARC-Refers-To", name(refers_to)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
        return [record("revisit", headers, b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload))]
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if len(payload) > CHUNK_BYTES:
        block = head + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    else:
        block = head + b"Content-Length: %d\r\n\r\n" % len(payload) + payload
    if len(block) <= segment:
        return [record("response", headers, block)]
    pieces = [block[i : i + segment] for i in range(0, len(block), segment)]
    out = [record("response", [*headers, ("WARC-Segment-Number", "1")], pieces[0])]
    for n, piece in enumerate(pieces[1:], 2):
        more = [("WARC-Record-ID", f"{name(page_id)[:-1]}:{n}>"), ("WARC-Date", _DATE), ("WARC-Target-URI", headers[2][1]), ("WARC-Segment-Origin-ID", name(page_id)), ("WARC-Segment-Number", str(n))]
        if n == len(pieces):
            more.append(("WARC-Segment-Total-Length", str(len(block))))
        out.append(record("continuation", more, piece))
    return out


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with lower-case names, block) of every record, gzip members or plain; ValueError where it is damaged."""
    for headers, block in scan(data):
        if block is None:
            raise ValueError("damaged record")
        yield headers, block


_NEXT = re.compile(rb"WARC/\d|\x1f\x8b\x08")


def scan(data: bytes) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """Like parse, but a damaged record is (the headers it still has, None), and reading goes on at the next beginning of one."""
    at = 0
    while at < len(data):
        if data[at : at + 2] == b"\x1f\x8b":
            unzip = zlib.decompressobj(31)
            try:
                member = unzip.decompress(data[at:])
                if not unzip.eof:
                    raise zlib.error("cut off")
            except zlib.error:
                yield {}, None
                at = _next(data, at)
                continue
            at = len(data) - len(unzip.unused_data)
            yield from scan(member)
            continue
        end = data.find(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "replace").split("\r\n") if end >= 0 else [""]
        if not lines[0].startswith("WARC/"):
            yield {}, None
            at = _next(data, at)
            continue
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = headers.get("content-length", "")
        size = int(size) if size.isascii() and size.isdigit() and len(size) < 19 else -1
        if size < 0 or data[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
            yield headers, None
            at = _next(data, at)
            continue
        yield headers, data[end + 4 : end + 4 + size]
        at = end + 8 + size


def _next(data: bytes, at: int) -> int:
    found = _NEXT.search(data, at + 1)
    return found.start() if found else len(data)


def page_of(urn: str | None) -> int | None:
    m = re.match(r"<urn:page:(-?\d+):", urn or "")
    return int(m[1]) if m else None


def payload_of(block: bytes) -> tuple[dict[str, str], bytes]:
    """HTTP headers and payload of a response block."""
    end = block.find(b"\r\n\r\n")
    if end < 0:
        raise ValueError("no HTTP head")
    head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in block[:end].decode("latin-1").split("\r\n")[1:])}
    body = block[end + 4 :]
    return head, unchunk(body) if head.get("transfer-encoding", "").lower() == "chunked" else body


_DONE = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("status", pa.string())])
_DONE_DDL = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary, status string"


def _number(x: str | None) -> int | None:
    return int(x) if x and x.isascii() and x.isdigit() and len(x) < 10 else None


def finish(headers: dict[str, str], block: bytes | None, payload_too: bool, status: str = "ok") -> tuple:
    """The result row of a record whose block is whole (None: it could not be put together)."""
    kind, digest = headers.get("warc-type"), headers.get("warc-payload-digest", "").partition(":")[2]
    payload, size, found = None, None, None
    try:
        if digest:
            digest = base64.b32decode(digest).hex()
        if block is not None:
            head, payload = payload_of(block)
            if kind == "revisit":
                size, found, payload = int(head["content-length"]), digest, None
            else:
                size, found = len(payload), hashlib.sha1(payload).hexdigest()
                if digest and digest != found:
                    size, found, payload, status = None, None, None, "digest differs"
    except (ValueError, KeyError):
        size, found, payload, status = None, None, None, "damaged"
    return page_of(headers.get("warc-record-id")), headers.get("warc-target-uri"), size, found, kind, page_of(headers.get("warc-refers-to")), payload if payload_too else None, status


def reassemble(pieces: list[tuple[int, int | None, bytes]]) -> tuple[bytes | None, str]:
    """The block of (segment number, total length or None, piece) in any order, and a status."""
    pieces = sorted(pieces, key=lambda p: p[0])
    totals = [t for _, t, _ in pieces if t is not None]
    if [n for n, _, _ in pieces] != list(range(1, len(pieces) + 1)) or len(totals) != 1:
        return None, "segments missing"
    block = b"".join(p for _, _, p in pieces)
    return (block, "ok") if len(block) == totals[0] else (None, "wrong total length")


# DataFrames ---------------------------------------------------------------------------------------


def assign_revisits(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = REVISIT_BYTES) -> DataFrame:
    """(page_id, url, html as bytes, revisit, refers_to). Equal payloads are pre-aggregated by digest; payloads stay where they are unless repeated ones are too many to broadcast."""
    raw = F.coalesce(F.col(html).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.coalesce(url, F.lit("")).alias("url"), raw.alias("html"))
    long_enough = F.octet_length("html") >= least
    rows = rows.withColumn("_sha", F.when(long_enough, F.unhex(F.sha1("html"))))
    groups = rows.where(long_enough).groupBy("_sha", "page_id").agg(F.count("*").alias("n"))
    best = groups.groupBy("_sha").agg(F.sum("n").alias("_n"), F.max(F.struct("page_id", "n")).alias("_best")).where(F.col("_n") > 1)
    best = best.select("_sha", F.col("_best.page_id").alias("_page"), F.col("_best.n").alias("_ties"))
    best = C.write_table(best, "payloads")
    if best.count() <= BROADCAST_GROUPS:
        best = F.broadcast(best)
    joined = rows.join(best, "_sha", "left")
    is_best = F.col("page_id").eqNullSafe(F.col("_page"))
    tied = F.coalesce(is_best & (F.col("_ties") > 1), F.lit(False))
    single = joined.where(~tied).withColumn("revisit", F.col("_ties").isNotNull() & ~is_best)
    first = F.row_number().over(Window.partitionBy("_sha", "page_id").orderBy("url"))
    among = joined.where(tied).withColumn("revisit", first > 1)  # rows that repeat id and payload
    both = single.unionByName(among)
    return both.select("page_id", "url", "html", "revisit", F.when(F.col("revisit"), F.col("_page")).alias("refers_to"))


def write_archives(rows: DataFrame, compress: bool = False, segment: int = SEGMENT_BYTES, archive: int = ARCHIVE_BYTES) -> DataFrame:
    """A table (name, data) in shared storage with the records of assign_revisits' rows."""

    def run(batches):
        from pyspark import TaskContext

        part, n, now, size, later = TaskContext.get().partitionId(), 0, [], 0, []

        def close():
            nonlocal n, now, size
            data = b"".join(map(gzip.compress, now) if compress else now)
            name = f"pages-{part:06d}-{n:06d}.warc" + ".gz" * compress
            n, now, size = n + 1, [], 0
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([data], pa.binary())], names=["name", "data"])

        for batch in C.split_batches(batches, "html"):
            for page, url, html, revisit, to in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                first, *more = page_records(page, url, html, to, revisit, segment)
                now.append(first)
                later += more
                size += len(first) + sum(map(len, more))
                if size >= archive:
                    yield close()
                    now, later = later, []  # continuations lie in another archive than what they continue
        now += later
        if now:
            yield close()

    return C.write_table(rows.mapInArrow(run, "name string, data binary"), "warc")


_PIECE = pa.schema([("origin", pa.string()), ("segment", pa.int32()), ("total", pa.int64()), ("headers", pa.list_(pa.string())), ("block", pa.binary())])
_READ = pa.schema([*_PIECE, *_DONE])
_READ_DDL = f"origin string, segment int, total long, headers array<string>, block binary, {_DONE_DDL}"


def _records(payload: bool):
    """Whole records as they are returned, pieces of records as they are."""

    def run(batches):
        for batch in batches:
            for data in batch.column(0):
                out = []
                for headers, block in scan(data.as_py() or b""):
                    kind, segment = headers.get("warc-type"), headers.get("warc-segment-number")
                    if block is None or (segment is not None and _number(segment) is None):
                        out.append((None,) * 5 + finish(headers, None, payload, "damaged"))
                    elif kind not in ("response", "revisit", "continuation"):
                        continue
                    elif segment is None:
                        out.append((None,) * 5 + finish(headers, block, payload))
                    else:
                        origin = headers.get("warc-segment-origin-id") or headers.get("warc-record-id") or ""
                        flat = [x for kv in headers.items() for x in kv] if _number(segment) == 1 else None
                        out.append((origin, _number(segment), _number(headers.get("warc-segment-total-length")), flat, block) + (None,) * len(_DONE))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(_READ)], schema=_READ)

    return run


def _join(payload: bool):
    """Rows that come sorted by origin: whole records pass, pieces are put together."""

    def done(pieces: list[dict]) -> tuple:
        block, status = reassemble([(r["segment"], r["total"], r["block"]) for r in pieces])
        flat = next((r["headers"] for r in pieces if r["headers"]), None) or ["warc-record-id", pieces[0]["origin"]]
        return finish(dict(zip(flat[::2], flat[1::2], strict=True)), block, payload, status)

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_DONE)], schema=_DONE)

    def run(batches):
        now: list[dict] = []
        for batch in batches:
            piece = batch.column(0).is_valid()
            whole = batch.filter(pc.invert(piece)).select(_DONE.names)
            if whole.num_rows:
                yield whole.cast(_DONE)
            out = []
            for r in batch.filter(piece).select(_PIECE.names).to_pylist():
                if now and r["origin"] != now[0]["origin"]:
                    out.append(done(now))
                    now = []
                now.append(r)
            if out:
                yield table(out)
        if now:
            yield table([done(now)])

    return run


def read_archives(archives: DataFrame, payload: bool = True) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload, status of every record."""
    found = archives.select("data").mapInArrow(_records(payload), _READ_DDL)
    # whole records go anywhere; the pieces of one record meet in one task and follow each other there
    parts = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = found.repartition(parts, F.coalesce(F.when(F.col("origin").isNotNull(), F.xxhash64("origin")), F.xxhash64("page_id", "url", "payload_digest")))
    return dealt.sortWithinPartitions("origin", "segment").mapInArrow(_join(payload), _DONE_DDL)


def op10_warc(spark, sf_dir: str) -> DataFrame:
    archives = write_archives(assign_revisits(C.table(spark, sf_dir, "pages")))
    return read_archives(archives, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_ORACLE = f"""
with p as (select page_id, coalesce(html, '') as h, strlen(coalesce(html, ''))::bigint as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages),
b as (select h, max(page_id) as best from p where payload_bytes >= {REVISIT_BYTES} group by h),
r as (select *, row_number() over (partition by h, page_id) as rn from p)
select page_id, payload_bytes, payload_digest, case when best is null or (page_id = best and rn = 1) then 'response' else 'revisit' end as record_type,
       case when best is null or (page_id = best and rn = 1) then null else best end as refers_to
from r left join b using (h)"""

QUERIES = {"op10_warc": op10_warc}
ORACLES = {"op10_warc": _ORACLE}
