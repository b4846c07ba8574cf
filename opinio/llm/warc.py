"""WARC archives: a writer with revisit records and a reader that salvages damaged files.

Writing: rows are joined to the first page of their payload's digest (a
grouped, map-side combined table), and every task writes its rows as gzip
members, one record each, to files of its own under the shared folder. The
files' names hold the task attempt; the manifest that the job returns names
the files of the attempts that counted, so a retried or lost task leaves at
most files that nobody reads.

Reading: files are dealt over the tasks and streamed. A record must pass all
checks (gzip CRC, version line, lengths, block and payload digests). Where
one fails, the reader searches for the next gzip member or version line,
tries the checks there, and goes on until they hold; the bytes in between
become one gap row with the reason of the first failure.

A gzip member may hold many records and be of any size; it is unpacked in
pieces. Where a record in it fails, the search for the next version line goes
on in the unpacked bytes; such a gap has the member's place in the file, and
its reason names the unpacked bytes. A member that is cut short, or whose
CRC or coding is wrong, gives the records that are good by themselves: those
before a cut, and otherwise those whose block digest holds, if it has more
than one (of a single one, no digest covers the header). A gap row with the
reason covers the place of such a member.

A header line must have a token as its name and UTF-8 without control
characters as its value; WARC-Type, WARC-Record-ID and WARC-Date must be there
and of their form, as must WARC-Refers-To if it is there. Headers are read to
their end, up to ``MAX_HEADER`` bytes; a valid record of more than
``MAX_RECORD`` bytes is quarantined as a gap with that reason.

Cases: a null payload is empty; payloads below ``MIN_REVISIT`` bytes and
pages that repeat the smallest page_id of their payload are responses; a
null page_id comes last and refers to the smallest id; a null url is left
out of the record; control characters in urls are percent-encoded; a url of
more than ``MAX_URL`` bytes is named by its digest and length; an empty
table writes nothing and reads back as no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import python_step, read, staged

#: Smaller payloads are always stored in full.
MIN_REVISIT = 100
#: A task starts another file beyond this size.
FILE_BYTES = 64 << 20
#: A record that claims more is taken as damaged.
MAX_RECORD = 1 << 30
#: A header that is not ended by then is taken as damaged; longer urls are not written.
MAX_HEADER = 64 << 20
MAX_URL = 16 << 20
READ_BYTES = 256 << 10
#: A member that unpacks to more is unpacked twice: to check it, and for its records.
KEPT_BYTES = 4 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "file string, bytes long, records long"
ROWS = ("file string, start long, stop long, kind string, reason string, page_id long, url string, record_type string, "
        "refers_to long, payload_bytes long, payload_digest string, payload binary")
_CANDIDATE = re.compile(rb"\x1f\x8b\x08|WARC/1\.[0-9]\r\n")
_LENGTH = re.compile(rb"(?i)\r\ncontent-length:[ \t]*(\d{1,18})[ \t]*\r\n")
_VERSION = re.compile(rb"WARC/[0-9]+\.[0-9]+\r\n")
_TOKEN = r"[!#$%&'*+.^_`|~0-9A-Za-z-]+"
_ID = r"<[A-Za-z][A-Za-z0-9+.-]*:[^<>\s]+>"
_NAME = re.compile(_TOKEN.encode())
_CONTROL = re.compile(r"[\x00-\x08\x0a-\x1f\x7f]")
#: Fields with a form of their own, the first three of them required.
_FORMS = {"warc-type": _TOKEN, "warc-record-id": _ID,
          "warc-date": r"\d{4}(-\d\d(-\d\d(T\d\d:\d\d(:\d\d(\.\d{1,9})?)?Z)?)?)?", "warc-refers-to": _ID}


def _record_id(page_id) -> str:
    return f"<urn:x-page:{'none' if page_id is None else page_id}>"


def _page_of(record_id: str | None) -> int | None:
    m = re.fullmatch(r"<urn:x-page:(-?\d+)>", record_id or "")
    return int(m[1]) if m else None


def record(page_id, url, payload: bytes, digest: str, refers_to=None, revisit: bool = False,
           date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One record, not yet compressed; a revisit keeps the HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_record_id(page_id)}",
            f"WARC-Date: {date}"]
    if url is not None and len(url.encode()) > MAX_URL:
        url = f"urn:sha256:{hashlib.sha256(url.encode()).hexdigest()}:{len(url.encode())}"
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(refers_to)}"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
             "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write(pages: DataFrame, folder: str, file_bytes: int = FILE_BYTES, compressed: bool = True) -> DataFrame:
    """Write the archives below ``folder``; returns the manifest."""
    p = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    p = p.withColumn("digest", F.sha2("html", 256)).withColumn("size", F.octet_length("html"))
    first = p.where(F.col("size") >= MIN_REVISIT).groupBy(F.col("digest").alias("f_digest")).agg(
        F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL").drop("n")
    p = p.join(first, F.col("digest") == F.col("f_digest"), "left").withColumn(
        "revisit", F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")))

    def files(batches: Iterator):
        import pyarrow as pa
        from pyarrow import fs
        from pyspark import TaskContext
        task = TaskContext.get()
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        out, name, done, size, n = None, "", [], 0, 0
        for b in batches:
            for page_id, url, html, digest, first_id, revisit in zip(*(b.column(i).to_pylist() for i in range(6))):
                if out is None:
                    name = f"part-{task.partitionId():06d}-{len(done):03d}-{task.taskAttemptId()}.warc{'.gz' * compressed}"
                    out, size, n = store.open_output_stream(f"{root}/{name}", compression=None), 0, 0
                data = record(page_id, url, html.encode(), digest, first_id, revisit)
                if compressed:
                    z = zlib.compressobj(6, zlib.DEFLATED, 31)
                    data = z.compress(data) + z.flush()
                out.write(data)
                size, n = size + len(data), n + 1
                if size >= file_bytes:
                    out.close()
                    done.append((f"{folder}/{name}", size, n))
                    out = None
        if out is not None:
            out.close()
            done.append((f"{folder}/{name}", size, n))
        cols = list(zip(*done)) or [(), (), ()]
        yield pa.record_batch([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())],
                              names=["file", "bytes", "records"])

    return staged(python_step(p.select("page_id", "url", "html", "digest", "first", "revisit"), files, MANIFEST), "warc-manifest")


class Damaged(Exception):
    """A check failed."""

    #: How far the file was read.
    end = 0


class Cut(Damaged):
    """The file ends within a member: what was unpacked is right."""


def _parsed(data: bytes, at: int = 0) -> tuple[dict, bytes, int]:
    """Headers, block and end of the record at ``at``, all lengths and digests checked."""
    if not _VERSION.match(data, at):
        raise Damaged("no version line")
    stop = data.find(b"\r\n\r\n", at)
    if stop < 0:
        raise Damaged("header not ended")
    head = _fields(data[at:stop])
    length = head.get("content-length", "")
    if not re.fullmatch(r"\d{1,18}", length):
        raise Damaged("bad length")
    block = data[stop + 4:stop + 4 + int(length)]
    end = stop + 8 + int(length)
    if len(block) < int(length) or data[end - 4:end] != b"\r\n\r\n":
        raise Damaged("wrong length")
    for name, part in (("warc-block-digest", block), ("warc-payload-digest", _payload(block))):
        digest = head.get(name, "")
        if digest.startswith("sha256:") and not (name == "warc-payload-digest" and head.get("warc-type") == "revisit") \
                and hashlib.sha256(part).hexdigest() != digest[7:].lower():
            raise Damaged("wrong " + name[5:].replace("-", " "))
    return head, block, end


def _fields(header: bytes) -> dict:
    """The fields below the version line, names in lower case; folded lines are put together."""
    head = {}
    for line in re.sub(rb"\r\n[ \t]+", b" ", header).split(b"\r\n")[1:]:
        k, colon, v = line.partition(b":")
        try:
            value = v.decode().strip(" \t")
        except UnicodeDecodeError:
            raise Damaged("bad header value") from None
        if not colon or not _NAME.fullmatch(k):
            raise Damaged("bad header line")
        if _CONTROL.search(value):
            raise Damaged("bad header value")
        head[k.lower().decode()] = value
    for i, (name, form) in enumerate(_FORMS.items()):
        if not re.fullmatch(form, head.get(name, "")) and (i < 3 or name in head):
            raise Damaged("bad " + name)
    return head


def _payload(block: bytes) -> bytes:
    if not block.startswith(b"HTTP/"):
        return block
    stop = block.find(b"\r\n\r\n")
    return block[stop + 4:] if stop >= 0 else b""


def _proven(head: dict, block: bytes) -> bool:
    """Whether the record has a block digest that holds."""
    kind, _, digest = head.get("warc-block-digest", "").partition(":")
    if kind not in ("sha1", "sha256"):
        return False
    held = hashlib.new(kind, block)
    return digest.lower() == held.hexdigest() or digest.upper().rstrip("=") == base64.b32encode(held.digest()).decode().rstrip("=")


def _unpacked(f, at: int) -> Iterator[tuple[bytes, int]]:
    """The bytes of the gzip member at ``at`` in pieces, with how far the file is read; all bytes before a failure come first."""
    z, pos = zlib.decompressobj(31), at
    while not z.eof:
        f.seek(pos)
        raw = f.read(READ_BYTES)
        pos += len(raw)
        if not raw:
            while part := z.decompress(b"", 16 * READ_BYTES):
                yield part, pos
            raise Cut("member not ended")
        while raw and not z.eof:
            before = z.copy()
            try:
                part = z.decompress(raw, 16 * READ_BYTES)
            except zlib.error as e:
                parts, i = [], 0
                try:  # zlib keeps back what it unpacked in a call that fails
                    for i in range(len(raw)):
                        parts.append(before.decompress(raw[i:i + 1]))
                except zlib.error:
                    pass
                yield b"".join(parts), pos - len(raw) + i
                raise Damaged(f"gzip: {str(e)[:60]}") from None
            raw = z.unused_data if z.eof else z.unconsumed_tail  # at the end, the tail may hold the same bytes
            yield part, pos - len(raw)


def _records(parts: Iterator[bytes]) -> Iterator[tuple]:
    """(start, stop, header, block, None) per good record of unpacked bytes, (start, stop, None, None, reason) per gap.

    At most one record, of MAX_RECORD at most, is held at a time.
    """
    data, off, at, gap, ended = bytearray(), 0, 0, None, False  # data[0] is byte off, at counts in data

    def more(n: int) -> bool:
        """Have n bytes from ``at`` on, if there are as many."""
        nonlocal ended
        while len(data) - at < n and not ended:
            part = next(parts, None)
            ended = part is None
            data.extend(part or b"")
        return len(data) - at >= n

    while more(1):
        try:
            stop = -1
            if more(5) and data.startswith(b"WARC/", at):
                size, some = 1 << 10, True
                while stop < 0 and some and size <= MAX_HEADER:
                    some = more(size)
                    stop, size = data.find(b"\r\n\r\n", at), size * 4
                m = _LENGTH.search(data, at, stop + 2) if stop >= 0 else None
                if not m:
                    raise Damaged("header not ended" if stop < 0 else "bad length")
                need = stop + 8 - at + int(m[1])
                if need > MAX_RECORD or not more(need):
                    raise Damaged("wrong length")
                if data[at + need - 4:at + need] != b"\r\n\r\n":
                    raise Damaged("wrong length")
                head, block, n = _parsed(bytes(memoryview(data)[at:at + need]))
            else:
                raise Damaged("no version line")
        except Damaged as e:
            gap = gap or (off + at, str(e))
            at += 1
            while True:
                m = _VERSION.search(data, at)
                if m or ended:
                    at = m.start() if m else len(data)
                    break
                at = max(at, len(data) - 32)  # a version line may be cut by the end of the piece
                if at > READ_BYTES:
                    del data[:at]
                    off, at = off + at, 0
                more(len(data) - at + 1)
            continue
        if gap:
            yield gap[0], off + at, None, None, gap[1]
            gap = None
        yield off + at, off + at + n, head, block, None
        at += n
        if at > READ_BYTES or at == len(data):
            del data[:at]
            off, at = off + at, 0
    if gap:
        yield gap[0], off + at, None, None, gap[1]


def _member(f, at: int, marks: set) -> Iterator[tuple]:
    """What ``salvage`` gives for the gzip member at ``at``; raises Damaged if it is damaged or holds no record.

    A damaged member's good records come before that, their marks go to ``marks``.
    """
    kept, size, end, bad = [], 0, at, None
    try:
        for part, end in _unpacked(f, at):
            size += len(part)
            if size <= KEPT_BYTES:
                kept.append(part)
            else:
                kept.clear()
    except Damaged as e:
        bad = e

    def again():
        try:
            for part, _ in _unpacked(f, at):
                yield part
        except Damaged:
            pass

    whole = bad is None or isinstance(bad, Cut)
    good, gap = 0, None
    for start, stop, head, block, reason in _records(iter(kept) if size <= KEPT_BYTES else again()):
        if head is not None and not whole and (not _proven(head, block) or (start == 0 and stop == size and "check" in str(bad))):
            head, reason = None, f"not proven by a digest, {bad}"
        if head is None:
            gap = gap and (gap[0], stop, gap[2]) or (start, stop, reason)
            continue
        if gap:
            yield at, end, None, None, f"{gap[2]} (unpacked bytes {gap[0]} to {gap[1]})"
            gap = None
        if bad:
            marks.add(_mark(head, block))
        good += 1
        yield at, end, head, block, None
    if bad or not good:
        bad = bad or Damaged(gap[2] if gap else "empty member")
        bad.end = end
        raise bad
    if gap:
        yield at, end, None, None, f"{gap[2]} (unpacked bytes {gap[0]} to {gap[1]})"


def _mark(head: dict, block: bytes) -> bytes:
    return hashlib.sha256(repr(sorted(head.items())).encode() + block).digest()


def _plain(f, at: int, size: int) -> list:
    """What ``salvage`` gives for the record without compression at ``at``."""
    f.seek(at)
    data = f.read(READ_BYTES)
    while (stop := data.find(b"\r\n\r\n")) < 0 and len(data) < min(MAX_HEADER, size - at):
        data += f.read(3 * len(data))  # four times as much each time, so little is looked through twice
    m = _LENGTH.search(data, 0, stop + 2) if stop >= 0 else None
    if not m:
        raise Damaged("header not ended" if stop < 0 else "bad length")
    need = stop + 8 + int(m[1])
    if need > min(MAX_RECORD, size - at):
        raise Damaged("wrong length")
    if need > len(data):
        data += f.read(need - len(data))
    head, block, end = _parsed(data[:need])
    return [(at, at + end, head, block, None)]


def _next(f, at: int, size: int) -> int:
    """Where the next member or version line may begin, from ``at`` on."""
    while at < size:
        f.seek(at)
        raw = f.read(READ_BYTES + 16)
        m = _CANDIDATE.search(raw)
        if m and m.start() < READ_BYTES:
            return at + m.start()
        at += READ_BYTES
    return size


def salvage(f, size: int) -> Iterator[tuple]:
    """(start, stop, header, block, None) per good record, (start, stop, None, None, reason) per gap, in file order.

    Records have the place of their gzip member, as have gaps inside it.
    """
    at, gap = 0, None
    seen, past = set(), 0  # what damaged members gave, as their bytes up to past are searched once more
    while at < size:
        f.seek(at)
        magic = f.read(5)
        marks: set = set()
        try:
            if magic[:3] == b"\x1f\x8b\x08":
                found = _member(f, at, marks)
            elif magic == b"WARC/":
                found = iter(_plain(f, at, size))
            else:
                raise Damaged("no member or version line")
            for row in found:
                end = row[1]
                if at < past and row[2] is not None and _mark(row[2], row[3]) in seen:
                    continue
                if gap:
                    yield gap[0], at, None, None, gap[1]
                    gap = None
                yield row
        except Damaged as e:
            if marks:
                seen, past = marks | (seen if at < past else set()), max(past, e.end)
            gap = gap or (at, str(e))
            at = _next(f, at + 1, size)
            continue
        at = end
    if gap:
        yield gap[0], size, None, None, gap[1]


def read_archives(files: DataFrame, payloads: bool = False, tasks: int | None = None) -> DataFrame:
    """The columns of ROWS: a row per good record (``kind`` "record") and per quarantined byte gap ("gap").

    ``files`` has a column ``file``. One task reads a file at a time, in pieces.
    """

    def rows(batches: Iterator):
        import pyarrow as pa
        from pyarrow import fs
        names = [c.split()[0] for c in ROWS.split(", ")]
        kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
        types = [kinds[c.split()[1]] for c in ROWS.split(", ")]

        def batch(out):
            cols = list(zip(*out)) or [()] * len(names)
            return pa.record_batch([pa.array(c, t) for c, t in zip(cols, types)], names=names)

        for b in batches:
            for file in b.column(0).to_pylist():
                store, path = fs.FileSystem.from_uri(file)
                out, held = [], 0
                with store.open_input_file(path) as f:
                    for start, stop, head, block, reason in salvage(f, f.size()):
                        if head is None:
                            out.append((file, start, stop, "gap", reason, *[None] * 7))
                            continue
                        body = _payload(block)
                        revisit = head.get("warc-type") == "revisit"
                        n, digest = len(body), head.get("warc-payload-digest", "").removeprefix("sha256:").lower()
                        if revisit:
                            m = re.search(rb"(?i)\r\ncontent-length:[ \t]*(\d+)", block)
                            n = int(m[1]) if m else None
                        else:
                            digest = hashlib.sha256(body).hexdigest()
                        out.append((file, start, stop, "record", None, _page_of(head.get("warc-record-id")),
                                    head.get("warc-target-uri"), head.get("warc-type"), _page_of(head.get("warc-refers-to")),
                                    n, digest, body if payloads and not revisit else None))
                        held += len(body) if payloads else 100
                        if held > 4 << 20:
                            yield batch(out)
                            out, held = [], 0
                yield batch(out)

    n = tasks or max(1, files.sparkSession.sparkContext.defaultParallelism)
    return python_step(files.select("file").repartition(n), rows, ROWS)


def op5_warc(spark, sf_dir: str) -> DataFrame:
    folder = f"{scratch_path(spark, 'llm')}/warc-{uuid.uuid4().hex[:12]}"
    manifest = write(read(spark, sf_dir, "pages"), folder)
    rows = staged(read_archives(manifest), "warc-records")
    written, found = manifest.agg(F.sum("records")).first()[0] or 0, rows.where("kind = 'record'").count()
    if written != found:
        raise RuntimeError(f"{written} records written, {found} read back")
    return rows.where("kind = 'record'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
f AS (SELECT digest, min(page_id) AS first FROM p WHERE n >= {MIN_REVISIT} GROUP BY digest)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id IS DISTINCT FROM first AND first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM p LEFT JOIN f USING (digest)
"""
