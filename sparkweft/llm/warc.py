"""WARC archives: one gzip member per record, and a sequential reader that checks what it reads.

The writer is a map over the pages; each task writes archives of at most about ``ARCHIVE_BYTES`` to the
shared folder, under names that no other attempt uses, and the manifest lists those of the attempts
that counted. So a lost executor leaves at worst a file that nothing refers to. The reader inflates one
member at a time and frames each block by its Content-Length, in memory that doesn't follow the size of
an archive or a payload, and compares the SHA-1 of every full payload with its record.

Of equal payloads of at least ``REVISIT_BYTES`` the page with the largest id is written in full, the
others as revisits of it. Only (digest, id) are grouped; the payloads are not shuffled for it unless
the table of repeated digests is itself large.

Defined cases: null html is an empty payload; rows that repeat the response's page id and payload are
responses too; a null page id never is the one that others revisit, unless no equal payload has an id,
in which case all are responses; control characters in a URL are written as %XX, a null URL is left out.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweft.storage import materialise, scratch_path

ARCHIVE_BYTES = 64 << 20
REVISIT_BYTES = 1000
CHUNK = 1 << 18
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAME = "urn:x-page:"


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One uncompressed record; a revisit has the HTTP head of the payload but not the payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if kind == "revisit" else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{NAME}{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if kind == "revisit":
        lines += [f"WARC-Refers-To: <{NAME}{refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines += [f"WARC-Payload-Digest: {_sha1(payload)}", f"WARC-Block-Digest: {_sha1(block)}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    """A gzip member of its own, without a time stamp."""
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _info(date: str) -> bytes:
    body = b"software: sparkweft\r\nformat: WARC File Format 1.1\r\n"
    return f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <{NAME}info>\r\nWARC-Date: {date}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"


def write_archives(pages: DataFrame, folder: str | None = None, level: int = 6, archive_bytes: int = ARCHIVE_BYTES, date: str = "1970-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write ``pages`` and return the manifest (path, records, bytes), a table in the shared folder.

    ``folder`` is a URI that driver and executors share; by default a fresh one in the checkpoint folder.
    """
    spark = pages.sparkSession
    folder = folder or scratch_path(spark, "warc")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"))
    large = F.octet_length("payload") >= REVISIT_BYTES
    repeated = materialise(rows.filter(large).groupBy(F.sha1("payload").alias("digest")).agg(F.max("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 AND first IS NOT NULL").drop("n"), "repeated")
    # A small payload never revisits. It gets a key of its own, which meets no digest, so that these don't share a task.
    own = F.concat(F.lit("-"), F.xxhash64("page_id", "url", "payload").cast("string"))
    rows = rows.withColumn("digest", F.when(large, F.sha1("payload")).otherwise(own)).join(repeated, "digest", "left")
    rows = rows.select("page_id", "url", "payload", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        task = TaskContext.get()
        files, root = fs.FileSystem.from_uri(folder)
        files.create_dir(root, recursive=True)
        out, made, records, size = None, 0, 0, 0
        done: list[tuple[str, int, int]] = []

        def close() -> None:
            nonlocal out
            if out is not None:
                out.close()
                done.append((f"{folder}/{name}", records, size))
                out = None

        for batch in batches:
            for page_id, url, payload, refers_to in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "refers_to"))):
                if out is None:
                    name = f"pages-{task.partitionId():06d}-{task.taskAttemptId()}-{made:04d}.warc.gz"
                    out, made, records = files.open_output_stream(f"{root}/{name}", compression=None), made + 1, 0
                    size = out.write(member(_info(date), level))
                size += out.write(member(record("response" if refers_to is None else "revisit", page_id, url, payload, refers_to, date), level))
                records += 1
                if size >= archive_bytes:
                    close()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64())], ["path", "records", "bytes"])

    return materialise(rows.mapInArrow(run, "path string, records long, bytes long"), "manifest")


def read_records(stream, keep_payload: bool = True) -> Iterator[dict]:
    """Records of a WARC stream, from first to last. ``ok`` tells whether frame and digests hold.

    Without ``keep_payload`` a payload is only measured and hashed as it passes.
    """
    waiting = b""
    while True:
        inflate = zlib.decompressobj(31)
        data = bytearray()
        ended = False

        def more() -> bool:
            """Inflate another piece of this member into ``data``; False at its end."""
            nonlocal waiting, ended
            while not inflate.eof:
                piece = inflate.unconsumed_tail or waiting or stream.read(CHUNK)
                if not inflate.unconsumed_tail and waiting:
                    waiting = b""
                if not piece:
                    ended = True
                    return False
                got = inflate.decompress(piece, CHUNK)
                if inflate.eof:
                    waiting = inflate.unused_data
                if got:
                    data.extend(got)
                    return True
            return False

        while (cut := data.find(b"\r\n\r\n")) < 0:
            if not more():
                break
        if cut < 0:
            if ended and not data:
                return
            raise ValueError("a WARC record has no end of its header")
        lines = bytes(data[:cut]).decode("utf-8", "surrogatepass").split("\r\n")
        del data[: cut + 4]
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        length = int(fields["content-length"])
        block_hash, payload_hash = hashlib.sha1(), hashlib.sha1()
        http: bytes | None = None
        head = bytearray()
        kept: list[bytes] = []
        left, payload_bytes = length, 0
        while left:
            if not data and not more():
                break
            piece = bytes(data[:left])
            del data[:left]
            left -= len(piece)
            block_hash.update(piece)
            if http is None:
                head.extend(piece)
                at = head.find(b"\r\n\r\n")
                if at < 0:
                    continue
                http, piece = bytes(head[:at]), bytes(head[at + 4 :])
            payload_hash.update(piece)
            payload_bytes += len(piece)
            if keep_payload:
                kept.append(piece)
        while more():
            pass
        framed = not left and bytes(data) == b"\r\n\r\n" and inflate.eof
        kind = fields.get("warc-type", "")
        digest = lambda x: base64.b32decode(x.partition(":")[2]).hex() if x else None
        declared = digest(fields.get("warc-payload-digest"))
        ok = framed and digest(fields.get("warc-block-digest")) in (None, block_hash.hexdigest())
        if kind == "revisit":
            sizes = [x.partition(b":")[2] for x in (http or bytes(head)).split(b"\r\n") if x.lower().startswith(b"content-length:")]
            payload_bytes = int(sizes[0]) if sizes else 0
        else:
            ok = ok and declared in (None, payload_hash.hexdigest())
        page = lambda x: int(m[1]) if (m := re.fullmatch(rf"<{NAME}(-?\d+)>", x or "")) else None
        yield {"type": kind, "page_id": page(fields.get("warc-record-id")), "url": fields.get("warc-target-uri"), "payload_bytes": payload_bytes, "digest": declared or payload_hash.hexdigest(), "refers_to": page(fields.get("warc-refers-to")), "ok": ok, "payload": b"".join(kept) if keep_payload and kind != "revisit" else None}


def read_archives(archives: DataFrame, payloads: bool = False) -> DataFrame:
    """``archives`` (path) -> a row per response or revisit; ``payloads`` adds the bytes. One archive a task.

    A record whose frame or digest doesn't hold is returned with ``digest_ok`` false.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        def flush() -> pa.RecordBatch:
            columns = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("digest", pa.string()), ("type", pa.string()), ("refers_to", pa.int64()), ("ok", pa.bool_()), *[("payload", pa.binary())] * payloads]
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in held], t) for c, t in columns], names)

        held: list[dict] = []
        size = 0
        for batch in batches:
            for path in batch.column("path").to_pylist():
                files, at = fs.FileSystem.from_uri(path)
                with files.open_input_stream(at, compression=None) as stream:
                    for r in read_records(stream, payloads):
                        if r["type"] not in ("response", "revisit"):
                            continue
                        held.append(r)
                        size += len(r["payload"] or b"") + 200
                        if size > 4 << 20:
                            yield flush()
                            held, size = [], 0
        if held:
            yield flush()

    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "digest_ok", *["payload"] * payloads]
    n = max(1, archives.count())
    spread = archives.select("path").repartition(min(n, 10_000), "path")
    return spread.mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, digest_ok boolean" + ", payload binary" * payloads)


def round_trip(pages: DataFrame) -> DataFrame:
    """Archive the pages, read the archives back, and report each record."""
    return read_archives(write_archives(pages)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "digest_ok")


def archives_in(spark: SparkSession, pattern: str) -> DataFrame:
    """(path) of the archives that a Hadoop glob names, for :func:`read_archives`."""
    return spark.read.format("binaryFile").load(pattern).select("path")
