"""WARC archives: writing, and a salvage reader.

Records are written as gzip members (one for each record), or plain, into archives of
bounded size, one run of archives for each task.  The reader checks every member (gzip
checksum, version line, Content-Length, block and payload digests).  Where a check fails,
it searches for the next valid member or version line, goes on from there, and reports the
bytes between as a quarantined gap.  It holds one record and one read buffer at a time, of
any length; a damaged length can make it hold the rest of one archive, no more.

Defined results: null html is an empty payload; null page_id is written as such and read
back as null; rows of equal page_id and payload that is the group's largest are each a
response; an empty table gives no record; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, slices, stage, table

ARCHIVE_BYTES = 64 << 20
READ_BYTES = 1 << 20
VERSION = b"WARC/1.1"
_MEMBER, _LINE = b"\x1f\x8b\x08", b"WARC/1."
FOUND = "archive string, at long, bytes long, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary, gap string"


def _digest(raw: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(raw).digest()).decode()


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def _page(urn: str | None) -> int | None:
    number = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number.lstrip("-").isdigit() else None


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One record: a response with its payload, or an identical-payload revisit without."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    target = "".join((url or "about:blank").split())
    head = [VERSION.decode(), f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {target}", "Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: {_digest(payload)}", f"WARC-Block-Digest: {_digest(block)}"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(refers_to)}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict, int]:
    """(fields, length) of the record at the start of raw; ValueError says what fails."""
    if not raw.startswith(_LINE):
        raise ValueError("no version line")
    cut = raw.find(b"\r\n\r\n")
    if cut < 0:
        raise ValueError("truncated header")
    head = {}
    for line in raw[:cut].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError("malformed header")
        head[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    if not head.get("content-length", "").isdigit():
        raise ValueError("no content length")
    size = int(head["content-length"])
    block = raw[cut + 4 : cut + 4 + size]
    if len(block) < size or raw[cut + 4 + size : cut + 8 + size] != b"\r\n\r\n":
        raise ValueError("truncated block")
    if head.get("warc-block-digest", _digest(block)) != _digest(block):
        raise ValueError("block digest differs")
    http, _, payload = block.partition(b"\r\n\r\n")
    kind = head.get("warc-type", "")
    if kind == "response":
        if head.get("warc-payload-digest", _digest(payload)) != _digest(payload):
            raise ValueError("payload digest differs")
        length = len(payload)
    else:
        payload = None
        said = [x.split(b":", 1)[1] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
        length = int(said[0]) if said else None
    sha1 = head.get("warc-payload-digest", "").removeprefix("sha1:")
    return {"page_id": _page(head.get("warc-record-id")), "payload_bytes": length, "payload_digest": base64.b32decode(sha1).hex() if sha1 else None, "record_type": kind, "refers_to": _page(head.get("warc-refers-to")), "payload": payload}, cut + 8 + size


class _Window:
    """A forward buffer over a stream: bytes before `at` are gone.  Read bytes are appended and
    passed ones cut off only when they are most of the buffer, so each is moved a few times at
    most, however long a record is."""

    def __init__(self, stream):
        self.stream, self.at, self.ended = stream, 0, False
        self.data, self.start = bytearray(), 0

    def __len__(self) -> int:
        return len(self.data) - self.start

    def fill(self, least: int) -> bool:
        while len(self) < least and not self.ended:
            more = self.stream.read(READ_BYTES)
            self.ended = not more
            self.data += more
        return len(self) >= least

    def skip(self, n: int) -> None:
        n = min(n, len(self))
        self.start, self.at = self.start + n, self.at + n
        if self.start > READ_BYTES and self.start > len(self):
            del self.data[: self.start]
            self.start = 0

    def find(self, what: bytes, begin: int = 0) -> int:
        return max(-1, self.data.find(what, self.start + begin) - self.start)

    def starts(self, what: bytes) -> bool:
        return self.data.startswith(what, self.start)

    def take(self, lo: int, hi: int) -> bytes:
        return bytes(memoryview(self.data)[self.start + lo : self.start + hi])


def _member(w: _Window) -> tuple[bytes, int]:
    """(content, length) of the gzip member at the window's start."""
    z, out, used = zlib.decompressobj(31), [], 0
    while not z.eof:
        if used == len(w) and not w.fill(used + READ_BYTES) and used == len(w):
            raise ValueError("truncated member")
        part = w.take(used, used + READ_BYTES)
        used += len(part)
        try:
            out.append(z.decompress(part))
        except zlib.error as e:
            raise ValueError(f"damaged member: {e}") from None
    return b"".join(out), used - len(z.unused_data)


def _plain(w: _Window) -> tuple[bytes, int]:
    """The plain record at the window's start, as far as its Content-Length says."""
    need, seen = 1 << 12, 0
    while True:
        w.fill(need)
        cut = w.find(b"\r\n\r\n", seen)
        if cut >= 0 or w.ended:
            break
        need, seen = need * 2, max(0, len(w) - 3)
    head = w.take(0, max(cut, 0)).lower()
    size = head.rpartition(b"\r\ncontent-length:")[2].split(b"\r\n")[0].strip()
    if cut < 0 or not size.isdigit():
        raise ValueError("malformed header")
    w.fill(cut + 8 + int(size))
    return w.take(0, cut + 8 + int(size)), cut + 8 + int(size)


def salvage(stream) -> Iterator[dict]:
    """Records and gaps of an archive in order: dicts with at, bytes, gap (None for records)."""
    w, gap = _Window(stream), None
    while w.fill(1):
        w.fill(len(_LINE))
        try:
            if w.starts(_MEMBER):
                raw, size = _member(w)
                found, end = parse(raw)
                if end != len(raw):
                    raise ValueError("bytes after the record")
            elif w.starts(_LINE):
                raw, size = _plain(w)
                found, _ = parse(raw)
            else:
                raise ValueError("no member or version line")
        except ValueError as e:
            gap = gap or (w.at, str(e))
            w.skip(1)
            while True:  # to the next place where a member or a version line may begin
                hits = [h for h in (w.find(_MEMBER), w.find(_LINE)) if h >= 0]
                if hits:
                    w.skip(min(hits))
                    break
                w.skip(max(0, len(w) - len(_LINE) + 1))
                if not w.fill(len(w) + 1):
                    w.skip(len(w))
                    break
            continue
        if gap:
            yield {"at": gap[0], "bytes": w.at - gap[0], "gap": gap[1]}
            gap = None
        yield found | {"at": w.at, "bytes": size, "gap": None}
        w.skip(size)
    if gap:
        yield {"at": gap[0], "bytes": w.at - gap[0], "gap": gap[1]}


def write_archives(pages: DataFrame, folder: str, compress: bool = True, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write pages (page_id, url, payload, revisit, refers_to) to archives under `folder`, a
    path that all executors reach; return the staged list (archive, records, bytes).

    An attempt writes names of its own; only archives in the list, which a task returns when
    it succeeds, count.  So a lost executor or a repeated task leaves no half-read archive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        out, name, count, size, done = None, "", 0, 0, []
        task = TaskContext.get()
        stem = f"{task.partitionId():06d}-{uuid.uuid4().hex}"
        for b in slices(batches, "payload", 8_000_000):
            for page_id, url, payload, revisit, refers_to in zip(*(b.column(i).to_pylist() for i in range(5))):
                raw = record(page_id, url, payload, refers_to, revisit)
                if compress:
                    z = zlib.compressobj(3, zlib.DEFLATED, 31)
                    raw = z.compress(raw) + z.flush()
                if out is None:
                    name, count, size = f"{root}/{stem}-{len(done):04d}.warc{'.gz' * compress}", 0, 0
                    out = fs.open_output_stream(name, compression=None)
                out.write(raw)
                count, size = count + 1, size + len(raw)
                if size >= archive_bytes:
                    out.close()
                    out = None
                    done.append((name, count, size))
        if out is not None:
            out.close()
            done.append((name, count, size))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*done), (pa.string(), pa.int64(), pa.int64()))], names=["archive", "records", "bytes"])

    cols = ["page_id", "url", "payload", "revisit", "refers_to"]
    return stage(pages.select(*cols).mapInArrow(run, "archive string, records long, bytes long"), "warc-list")


def read_archives(archives: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """Records and gaps (gap is not null) of the listed archives, one task for each few archives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(folder)
        names = [x.split()[0] for x in FOUND.split(", ")]
        kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
        types = [kinds[x.split()[1]] for x in FOUND.split(", ")]
        for b in batches:
            for name in b.column(0).to_pylist():
                rows, held = [], 0
                with fs.open_input_stream(name, compression=None) as stream:
                    for x in salvage(stream):
                        if not payloads:
                            x["payload"] = None
                        rows.append(x | {"archive": name})
                        held += 200 + len(x.get("payload") or b"")
                        if held > 8_000_000:
                            yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in zip(names, types)], names=names)
                            rows, held = [], 0
                yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in zip(names, types)], names=names)

    n = archives.count()
    return archives.select("archive").repartition(max(1, min(n, 100_000)), "archive").mapInArrow(run, FOUND)


def with_revisits(pages: DataFrame, least: int = 1000) -> DataFrame:
    """pages (page_id, url, payload) with revisit and refers_to: of equal payloads of at least
    `least` bytes, the largest page_id is the response and others revisit it.

    Counts per digest are pre-aggregated and staged, so that the join has a plain exchange on
    either side, which adaptive execution splits for a payload that very many pages share."""
    keyed = pages.withColumn("digest", F.when(F.length("payload") >= least, F.sha1("payload")))
    same = keyed.where("digest is not null").groupBy("digest").agg(F.max("page_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
    same = stage(same.where("copies > 1").drop("copies"), "warc-copies")
    out = keyed.join(same, "digest", "left")
    revisit = F.coalesce(F.col("page_id") != F.col("first_id"), F.col("first_id").isNotNull())
    return out.select("page_id", "url", "payload", revisit.alias("revisit"), F.when(revisit, F.col("first_id")).alias("refers_to"))


def op10_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    folder = fresh_path(spark, "warc")
    written = write_archives(with_revisits(pages), folder)
    found = stage(read_archives(written, folder), "warc-found").where("gap is null")
    n, got = written.agg(F.sum("records")).first()[0] or 0, found.count()
    if n != got:
        raise ValueError(f"{got} of {n} records were read back")
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP10_SQL = """
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> last_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> last_id THEN last_id END AS refers_to
FROM (SELECT page_id, payload_bytes, payload_digest, max(page_id) OVER (PARTITION BY payload_digest) AS last_id
      FROM (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes,
                   sha1(coalesce(html, '')) AS payload_digest FROM pages))
"""
