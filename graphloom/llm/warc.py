"""Web archives: records, and a normaliser for files that are one gzip stream.

A monolithic file can only be read from its start.  The normaliser inflates it once, rewrites each record as a gzip
member of its own and writes a sidecar index (offset and length of each member), after which any record is one
seek away.  Files live in the shared folder, under the name of the task's partition and attempt; the table of
finished files that the job returns names those that count, so retried and speculative tasks do no harm.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, col

VERSION, CHUNK, FILE_BYTES = b"WARC/1.1", 1 << 18, 128 << 20
_HEADER_END = b"\r\n\r\n"


def _files(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _safe(value: str) -> str:
    """A header value: control characters and what isn't ASCII as UTF-8 per cent signs."""
    return "".join(c if 0x20 < ord(c) < 0x7F else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in value)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: tuple[int | None] | None) -> bytes:
    """A response with its payload, or a revisit that has the HTTP head only and names the response."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    name = lambda i: f"<urn:page:{'none' if i is None else i}>"
    heads = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", name(page_id)), ("WARC-Date", "1970-01-01T00:00:00Z")]
    if url:
        heads.append(("WARC-Target-URI", _safe(url)))
    heads.append(("WARC-Payload-Digest", f"sha1:{payload_digest(payload)}"))
    if refers_to is not None:
        heads += [("WARC-Refers-To", name(refers_to[0])), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    block = http if refers_to is not None else http + payload
    heads += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return VERSION + b"\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in heads) + b"\r\n" + block + _HEADER_END


def parse(raw: bytes) -> dict:
    """The headers (names in lower case), the HTTP head and the payload of one record."""
    head, _, rest = raw.partition(_HEADER_END)
    lines = head.split(b"\r\n")
    if not lines[0].startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower().decode(): v.strip().decode() for k, _, v in (x.partition(b":") for x in lines[1:])}
    block = rest[: int(headers["content-length"])]
    if len(block) < int(headers["content-length"]):
        raise ValueError("a WARC record is cut short")
    http, _, payload = block.partition(_HEADER_END)
    return {"headers": headers, "http": http, "payload": payload}


def split_records(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Records of an inflated stream, each with the blank lines behind it; holds one record and one chunk at most."""
    held = bytearray()
    chunks = iter(chunks)

    def more() -> bool:
        part = next(chunks, None)
        if part is not None:
            held.extend(part)
        return part is not None

    while True:
        while held.find(_HEADER_END) < 0:
            if not more():
                if bytes(held).strip():
                    raise ValueError("the stream ends within a record's head")
                return
        at = held.find(_HEADER_END) + 4
        length = re.search(rb"(?im)^content-length:\s*(\d+)\s*$", held[:at].replace(b"\r\n", b"\n"))
        if not length:
            raise ValueError("a record without a length")
        end = at + int(length[1]) + 4
        while len(held) < end:
            if not more():
                raise ValueError("the stream ends within a record")
        yield bytes(held[:end])
        del held[:end]


def inflate(stream) -> Iterator[bytes]:
    """The content of a gzip file, one or many members, in bounded chunks."""
    unzip = zlib.decompressobj(31)
    while raw := stream.read(CHUNK):
        while raw:
            if out := unzip.decompress(raw, 4 * CHUNK):
                yield out
            if unzip.eof:
                raw, unzip = unzip.unused_data, zlib.decompressobj(31)
            else:
                raw = unzip.unconsumed_tail
    if out := unzip.flush():
        yield out


def member(raw: bytes, level: int = 6) -> bytes:
    zip_ = zlib.compressobj(level, zlib.DEFLATED, 31)
    return zip_.compress(raw) + zip_.flush()


def normalise(files, source: str, target: str) -> tuple[int, int]:
    """Rewrites one gzip file as a member for each record, with target + ".idx" beside it; (records, bytes).

    The index has a JSON line for each record: offset, length, type, id.
    """
    n = offset = 0
    with files.open_input_stream(source, compression=None) as stream, files.open_output_stream(target, compression=None) as out, files.open_output_stream(f"{target}.idx", compression=None) as index:
        for raw in split_records(inflate(stream)):
            head = parse(raw)["headers"]
            packed = member(raw)
            out.write(packed)
            index.write(json.dumps({"offset": offset, "length": len(packed), "type": head["warc-type"], "id": head["warc-record-id"]}).encode() + b"\n")
            n, offset = n + 1, offset + len(packed)
    return n, offset


def _write(root: str, file_bytes: int):
    """Writes a partition's records into monolithic files, normalises each and removes it; emits a row for each archive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        files, base = _files(root)
        task = TaskContext.get()
        prefix = f"{base}/part-{task.partitionId():06d}-{task.taskAttemptId()}"
        done: list[tuple[str, int]] = []
        stream = zip_ = None
        size = 0

        def close():
            stream.write(zip_.flush())
            stream.close()
            name = f"{prefix}-{len(done):04d}.warc.gz"
            records, _ = normalise(files, f"{name}.whole", name)
            files.delete_file(f"{name}.whole")
            done.append((name.removeprefix(f"{base}/"), records))

        for batch in batches:
            for page, url, html, revisit, target in zip(*(batch.column(c) for c in ("page_id", "url", "html", "revisit", "target")), strict=True):
                if stream is None:
                    stream, zip_, size = files.open_output_stream(f"{prefix}-{len(done):04d}.warc.gz.whole", compression=None), zlib.compressobj(1, zlib.DEFLATED, 31), 0
                raw = record(page.as_py(), url.as_py(), (html.as_py() or "").encode("utf-8", "surrogatepass"), (target.as_py(),) if revisit.as_py() else None)
                stream.write(zip_.compress(raw))
                size += len(raw)
                if size > file_bytes:
                    close()
                    stream = None
        if stream is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], names=["archive", "records"])

    return run


def _read(root: str, digest_only: bool):
    """Reads archives by their indexes, member by member."""

    def row(raw: bytes, archive: str, offset: int) -> tuple:
        r = parse(raw)
        h = r["headers"]
        length = int(re.search(rb"(?im)^content-length:\s*(\d+)", r["http"])[1])
        digest = h["warc-payload-digest"].removeprefix("sha1:")
        revisit = h["warc-type"] == "revisit"
        if not revisit and (payload_digest(r["payload"]) != digest or len(r["payload"]) != length):
            raise ValueError(f"{archive} at {offset}: the payload doesn't match its digest")
        number = lambda s: None if s == "<urn:page:none>" else int(s.removeprefix("<urn:page:").removesuffix(">"))
        return (number(h["warc-record-id"]), length, digest, h["warc-type"], number(h["warc-refers-to"]) if revisit else None, h.get("warc-target-uri"), None if revisit or digest_only else r["payload"], archive, offset)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _files(root)
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.string(), pa.int64()]
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload", "archive", "offset"]
        for batch in batches:
            for archive, records in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows, n, size = [], 0, 0
                with files.open_input_stream(f"{base}/{archive}.idx", compression=None) as index, files.open_input_file(f"{base}/{archive}") as data:
                    for line in _lines(index):
                        at = json.loads(line)
                        data.seek(at["offset"])
                        rows.append(row(zlib.decompress(data.read(at["length"]), 31), archive, at["offset"]))
                        n, size = n + 1, size + 200 + len(rows[-1][6] or b"")
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                            rows, size = [], 0
                if n != records:
                    raise ValueError(f"{archive} has {n} records, not {records}")
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return run


def _lines(stream) -> Iterator[bytes]:
    held = b""
    while raw := stream.read(CHUNK):
        *lines, held = (held + raw).split(b"\n")
        yield from lines
    if held:
        yield held


_ROW = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary, archive string, offset long"


def write_archives(pages: DataFrame, root: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes a record for each row and returns the lazy table of finished archives: archive, records.

    Of equal payloads of at least least_bytes, the row with the largest id is the response and the others revisit
    it; smaller ones are all responses.  Null payloads are empty.  Null ids rank below all others.  Rows that share the
    largest id are all responses.  Null urls leave the header out.
    """
    rows = pages.select(col(id_col).cast("long").alias("page_id"), col(url_col).cast("string").alias("url"), F.coalesce(col(payload_col).cast("string"), F.lit("")).alias("html"))
    rows = rows.select("*", F.unhex(F.sha1("html")).alias("digest"), F.octet_length("html").alias("bytes"))
    # only payloads that occur on two ids or more need the join's other side
    groups = rows.where(F.col("bytes") >= least_bytes).groupBy("digest").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1").select("digest", "last")
    work = Workspace(pages.sparkSession, "warc-groups")
    groups = work.save(groups, "groups")
    joined = rows.join(F.broadcast(groups) if groups.limit(500_001).count() <= 500_000 else groups, "digest", "left")
    revisit = F.col("last").isNotNull() & (F.col("bytes") >= least_bytes) & ~F.col("page_id").eqNullSafe(F.col("last"))
    return joined.select("page_id", "url", "html", revisit.alias("revisit"), F.col("last").alias("target")).mapInArrow(_write(root, file_bytes), "archive string, records long")


def read_archives(archives: DataFrame, root: str, digest_only: bool = False) -> DataFrame:
    """The records of the archives, checked against their digests: page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload, archive, offset."""
    return archives.select("archive", "records").mapInArrow(_read(root, digest_only), _ROW)


def archive_pages(pages: DataFrame, digest_only: bool = False, **kwargs) -> DataFrame:
    """write_archives() into the shared folder, then read_archives()."""
    work = Workspace(pages.sparkSession, "warc")
    root = work.path("archives")
    files, base = _files(root)
    files.create_dir(base)
    done = work.save(write_archives(pages, root, **kwargs), "index")
    spread = done.repartition(max(1, min(done.count(), 10_000)))
    return read_archives(spread, root, digest_only)


def _normalise_task(root: str):
    def run(batches):
        files, base = _files(root)
        for batch in batches:
            rows = []
            for source in batch.column(0).to_pylist():
                source_fs, path = _files(source)
                name = hashlib.md5(source.encode()).hexdigest() + ".warc.gz"
                if type(source_fs) is not type(files):
                    raise ValueError("source and target are on different stores")
                n, size = normalise(files, path, f"{base}/{name}")
                rows.append((source, name, n, size))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [()] * 4, (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["source", "archive", "records", "bytes"])

    return run


def normalise_archives(sources: DataFrame, root: str, path_col: str = "path") -> DataFrame:
    """Normalises existing gzip files (a column of their URIs), a file at a time in each task: source, archive, records, bytes."""
    files, base = _files(root)
    files.create_dir(base)
    return sources.select(col(path_col).cast("string").alias("path")).where("path is not null").mapInArrow(_normalise_task(root), "source string, archive string, records long, bytes long")
