"""WARC archives: a writer with revisit records, and a reader that salvages damaged files.

Writer: each task writes its pages to files of about ``ROLL`` bytes in the given folder, one gzip member per record. Of
pages with equal payloads of ``REVISIT_FROM`` bytes or more the one with the smallest page_id is a response, the others are
revisit records that refer to it and carry its HTTP headers without the payload. Files are written under a
temporary name and renamed, and their content depends on the rows alone, so a task may run again.

Reader: a file is read piece by piece, as it is stored, and walked member by member (or record by record if it is not compressed); a
member may hold several records. A member that does not decompress, a record that ends early, lacks its headers or does not have the digest it
claims (of its block or payload; SHA-256, SHA-1, SHA-512 or MD5, in hex or base32) fails; the reader then searches for the next member, or
version line, that starts a valid record, goes on there, and logs the byte gap in between. So one damaged spot costs the records that it
touches. Records of any type are read; page_id is null for those of other writers. A revisit has no payload and tells its size and
digest as stated, if they are. A record of more than RECORD_BYTES counts as damaged, as it cannot be a row.

Null html is the empty payload, a null url is about:blank, control characters of urls are percent-encoded. A page_id of any type is
written as its text, percent-encoded, so that any text comes back as it was; a null one is told from an empty one. Pages with a
null page_id are responses. ``archived`` raises on a gap in what it wrote itself, and a record of more than RECORD_BYTES is refused at writing. Rows that repeat the smallest page_id of their payload are all
responses. An empty table gives no files and an empty result; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchloom.llm.common import look_up, materialize

REVISIT_FROM = 100
ROLL = 32 << 20
LEVEL = 1
STEP = 1 << 14
#: Bytes of a record's header, and of its block, at most.
HEAD_BYTES, RECORD_BYTES = 1 << 20, 1 << 30
#: Up to so many payloads with copies (about 100 bytes each) are broadcast to the writers; of more, only the hot ones are.
BROADCAST_PAYLOADS = 200_000
DATE = "2026-01-01T00:00:00Z"
MEMBER, VERSION = b"\x1f\x8b\x08", b"WARC/1."

RECORD = "file string, offset long, length long, position long, fault string, record_type string, page_id string, refers_to string, url string, payload_bytes long, payload_digest string, payload binary"


def file_system(path: str):
    """pyarrow's file system of a path or URI, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to=None) -> bytes:
    """One WARC record; a revisit if refers_to is given."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    if len(block) > RECORD_BYTES:
        raise ValueError(f"page {page_id}: a record of {len(block)} bytes, {RECORD_BYTES} are readable")
    name = f"urn:x-unnamed-page:{digest}" if page_id is None else f"urn:x-page:{quote(str(page_id), safe='')}"
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "about:blank")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{name}>",
        f"WARC-Target-URI: {uri}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha256:{digest}",
        *([f"WARC-Refers-To: <urn:x-page:{quote(str(refers_to), safe='')}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if refers_to is not None else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def marked(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest and refers_to (the page_id of the response, for revisits)."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    keyed = pages.select("page_id", "url", payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    shared = keyed.where(F.octet_length("payload") >= REVISIT_FROM).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    shared = materialize(shared, "payloads")
    if shared.count() <= BROADCAST_PAYLOADS:
        marked = keyed.join(F.broadcast(shared), "digest", "left")
    else:
        marked = look_up(keyed, shared, "digest", "first", "page_id")
    return marked.select("page_id", "url", "payload", "digest", F.expr("if(page_id <> first, first, null)").alias("refers_to"))


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Write pages as archives into a shared folder; returns the written (file, bytes) table."""

    def run(batches):
        system, base = file_system(folder)
        system.create_dir(base, recursive=True)
        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        done, number, out, size = [], 0, None, 0

        def close():
            nonlocal out, number
            out.close()
            name = f"part-{part:06d}-{number:04d}.warc.gz"
            system.move(f"{base}/.{part}-{number}-{attempt}", f"{base}/{name}")
            done.append((f"{folder}/{name}", size))
            out, number = None, number + 1

        for batch in batches:
            for page, url, payload, digest, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    out, size = system.open_output_stream(f"{base}/.{part}-{number}-{attempt}", compression=None), 0
                packer = zlib.compressobj(LEVEL, wbits=31)
                member = packer.compress(record(page, url, payload, digest, refers)) + packer.flush()
                out.write(member)
                size += len(member)
                if size >= ROLL:
                    close()
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], names=["file", "bytes"])

    texts = marked(pages).withColumns({c: F.col(c).cast("string") for c in ("page_id", "refers_to")})
    return materialize(texts.mapInArrow(run, "file string, bytes long"), "archives")


def digest_matches(stated: str | None, data: bytes) -> bool | None:
    """Whether data has the stated digest (algorithm:value, in hex or base32); None if there is none or its algorithm is unknown."""
    algorithm, _, value = (stated or "").partition(":")
    algorithm = algorithm.strip().lower().replace("-", "")
    if algorithm not in ("sha256", "sha1", "md5", "sha512") or not value:
        return None
    found = hashlib.new(algorithm, data).digest()
    return value.strip().lower() == found.hex() or value.strip().upper().rstrip("=") == base64.b32encode(found).decode().rstrip("=")


class Window:
    """The bytes from a record's start on, filled as they are asked for; ``pull`` gives the next piece, or nothing at the end."""

    def __init__(self, pull):
        self.pull, self.data, self.start, self.ended = pull, bytearray(), 0, False

    def fill(self, n: int) -> bool:
        """Whether there are n bytes."""
        while len(self.data) < n and not self.ended:
            piece = self.pull()
            self.data += piece
            self.ended = not piece
        return len(self.data) >= n

    def find(self, mark: bytes, at: int, most: int | None = None) -> int:
        """The place of mark from ``at`` on (it begins before ``most``), or -1."""
        while True:
            found = self.data.find(mark, at)
            if found >= 0 or (most is not None and len(self.data) > most + len(mark)) or self.ended:
                return found
            at = max(at, len(self.data) - len(mark) + 1)
            self.fill(len(self.data) + 1)

    def drop(self, n: int) -> None:
        del self.data[:n]
        self.start += n


def parse(window: Window, room: int | None = None) -> tuple[dict, bool]:
    """The record at the start of a window, and whether a digest of it was checked; ValueError or KeyError if it fails a check.

    room: the bytes that are left in its file, where that is known.
    """
    window.fill(len(VERSION))
    end = window.find(b"\r\n\r\n", 0, HEAD_BYTES)
    if not window.data.startswith(VERSION) or not 0 <= end <= HEAD_BYTES:
        raise ValueError("no record header")
    lines = bytes(window.data[:end]).decode("utf-8").split("\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    n = int(fields["content-length"])
    if not 0 <= n <= RECORD_BYTES or (room is not None and end + n + 8 > room):
        raise ValueError("record ends early or is too long")
    if not window.fill(end + n + 8) or window.data[end + 4 + n : end + n + 8] != b"\r\n\r\n":
        raise ValueError("record ends early")
    block = bytes(window.data[end + 4 : end + 4 + n])
    kind, stated, size = fields["warc-type"], fields.get("warc-payload-digest"), None
    checked = digest_matches(fields.get("warc-block-digest"), block)
    payload: bytes | None = block
    if fields.get("content-type", "").lower().startswith("application/http"):
        http, mark, payload = block.partition(b"\r\n\r\n")
        if not mark:
            raise ValueError("no HTTP header")
        if kind == "revisit":
            length = re.search(rb"(?im)^content-length:\s*(\d+)", http)
            size, payload = int(length[1]) if length else None, None
        elif (found := digest_matches(stated, payload)) is not None and not (found is False and re.search(rb"(?im)^transfer-encoding:.*chunked", http)):
            checked = found if checked is not False else False
    if checked is False:
        raise ValueError("digest differs")

    def own(x):
        found = re.fullmatch(r"<urn:x-page:(.*)>", x or "")
        return unquote(found[1]) if found else None

    name = stated.partition(":")[2] if payload is None and stated and stated.lower().startswith("sha256:") else hashlib.sha256(payload).hexdigest() if payload is not None else None
    row = {"record_type": kind, "page_id": own(fields.get("warc-record-id")), "refers_to": own(fields.get("warc-refers-to")), "url": fields.get("warc-target-uri")}
    return row | {"payload_bytes": size if payload is None else len(payload), "payload_digest": name, "payload": payload, "size": end + n + 8}, bool(checked)


def member(file, at: int, size: int):
    """A function that gives the next piece of the gzip member at an offset, and one that tells where the member ends."""
    unpack, read_to = zlib.decompressobj(wbits=31), at

    def pull() -> bytes:
        nonlocal read_to
        while not unpack.eof:
            file.seek(read_to)
            piece = unpack.unconsumed_tail or file.read(min(STEP, size - read_to))
            if not unpack.unconsumed_tail:
                read_to += len(piece)
            if not piece:
                raise ValueError("member ends early")
            if text := unpack.decompress(piece, STEP):
                return text
        return b""

    return pull, lambda: read_to - len(unpack.unused_data)


def seek_mark(file, mark: bytes, at: int, size: int) -> int:
    """The offset of the next mark from ``at`` on, or the file's size."""
    tail = b""
    while at < size:
        file.seek(at)
        data = tail + file.read(min(64 * STEP, size - at))
        if (found := data.find(mark)) >= 0:
            return at - len(tail) + found
        at = min(size, at + 64 * STEP)
        tail = data[1 - len(mark) :]
    return size


FAULTS = (ValueError, KeyError, TypeError, zlib.error)


def salvage(file, size: int) -> Iterator[tuple[int, int, int, dict | str]]:
    """(offset, length, position, record) of each valid record and (offset, length, position, fault) of each gap, in file order.

    file can seek and read. position is that in the decompressed member, 0 in a file that is not compressed. No more than a record
    (RECORD_BYTES at most) and a few pieces are in memory.
    """
    first = seek_mark(file, MEMBER, 0, size)
    zipped = first < size and first < seek_mark(file, VERSION, 0, min(first + len(VERSION), size))
    at, gap, fault = 0, None, ""
    while at < size:
        rows: list[tuple[int, int, int, dict | str]] = []
        try:
            if zipped:
                pull, end_of = member(file, at, size)
                window, done, lost = Window(pull), [], None
                try:
                    while window.fill(1):
                        try:
                            found, sure = parse(window)
                        except (ValueError, KeyError, TypeError) as e:
                            if window.ended is False and not window.data:
                                raise
                            lost = (window.start, str(e)) if lost is None else lost
                            step = window.find(VERSION, 1)
                            window.drop(step if step > 0 else len(window.data))
                            continue
                        if lost is not None:
                            done.append((lost[0], lost[1], True))
                            lost = None
                        done.append((window.start, found, sure))
                        window.drop(found["size"])
                    if lost is not None:
                        done.append((lost[0], lost[1], True))
                    end, broken = end_of(), None
                except (ValueError, zlib.error) as e:
                    # The member itself is damaged: what was checked by a digest stays, the rest is lost.
                    end, broken = None, str(e)
                    done = [x for x in done if x[2]]
                if broken is None:
                    if not any(isinstance(x[1], dict) for x in done):
                        raise ValueError(next((x[1] for x in done), "empty member"))
                    rows = [(at, end - at, place, found) for place, found, _ in done]
                else:
                    rows = [(at, 0, place, found) for place, found, _ in done if isinstance(found, dict)]
                    if not rows:
                        raise ValueError(broken)
            else:
                file.seek(at)
                window = Window(lambda: file.read(STEP))
                found, _ = parse(window, size - at)
                end, broken = at + found["size"], None
                rows = [(at, end - at, 0, found)]
        except FAULTS as e:
            gap, fault = (at, str(e)) if gap is None else (gap, fault)
            at = seek_mark(file, MEMBER if zipped else VERSION, at + 1, size)
            continue
        if gap is not None:
            yield gap, at - gap, 0, fault
            gap = None
        yield from rows
        if broken is None:
            at = end
        else:
            gap, fault = at, broken
            at = seek_mark(file, MEMBER, at + 1, size)
    if gap is not None:
        yield gap, size - gap, 0, fault


def read(spark: SparkSession, files: DataFrame, payloads: bool = True) -> DataFrame:
    """All records of the files (column ``file``), and their gaps (rows whose ``fault`` is not null)."""

    def run(batches):
        names = [x.split()[0] for x in RECORD.split(", ")]
        numbers = ("offset", "length", "position", "payload_bytes")
        schema = pa.schema([(n, pa.int64() if n in numbers else pa.binary() if n == "payload" else pa.string()) for n in names])
        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, place = file_system(path)
                with system.open_input_file(place) as stored, io.BufferedReader(stored, ROLL >> 5) as f:  # the bytes as they are, whatever the name says
                    rows, held = [], 0
                    for at, length, position, found in salvage(f, stored.size()):
                        row = {"file": path, "offset": at, "length": length, "position": position} | ({"fault": found} if isinstance(found, str) else found)
                        row["payload"] = row.get("payload") if payloads else None
                        rows.append(row)
                        held += len(row["payload"] or b"")
                        if held > ROLL or len(rows) >= 5_000:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                    yield pa.RecordBatch.from_pylist(rows, schema)

    n = max(1, files.count())
    return files.select("file").repartition(min(n, 10_000)).mapInArrow(run, RECORD)


def archived(pages: DataFrame, folder: str) -> DataFrame:
    """Write pages to archives, read them back: page_id, payload_bytes, payload_digest, record_type, refers_to of each record."""
    kind = pages.schema["page_id"].dataType
    records = read(pages.sparkSession, write(pages, folder), payloads=False)
    lost = F.raise_error(F.format_string("%s: %d bytes from %d on do not read back: %s", "file", "length", "offset", "fault")).cast("boolean")
    records = records.where(F.when(F.col("fault").isNull(), True).otherwise(lost))
    return records.select(F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))
