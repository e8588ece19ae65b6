"""WARC archives: a writer and a sequential reader, one gzip member per record.

The writer packs rows into archives of bounded size, one series of files per task. The reader takes a table of archive
paths and walks each file once: it inflates one gzip member at a time from blocks of bounded size, takes as many bytes as
the record's Content-Length says, checks the block and payload digests while they pass, and goes on with the next member.
Files are opened through the file system their address names, so the folder may lie in any store.

A payload that another record holds as well is written once: the record with the largest id is the response, the others
become revisit records that name it and carry its digest and length but no payload.

Cases. Null payloads are empty, null addresses leave the header out. Payloads below ``min_revisit_bytes`` are always
written. Rows that repeat an id and payload are written as often as they come; the reference then names the id they
share. An empty table gives no archive and no record. A damaged member ends its file with a row that tells the error,
after all records before it; other files are not affected.
"""

from __future__ import annotations

import base64
import hashlib
import os
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.common import stored
from shelfspark.session import scratch_path

BLOCK = 1 << 18
RECORD = (
    "path string, position long, record_type string, record_id string, target_uri string, refers_to string, "
    "payload_digest string, payload_bytes long, digest_ok boolean, error string"
)
_FIELDS = [f.split()[0] for f in RECORD.split(", ")]
_TYPES = [{"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}[f.split()[1]] for f in RECORD.split(", ")]


def open_folder(address: str) -> tuple[fs.FileSystem, str]:
    if "://" not in address and not address.startswith("file:"):
        address = f"file://{address}"
    return fs.FileSystem.from_uri(address.replace("file:///", "file:/").replace("file:/", "file:///"))


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_bytes(record_id: str, uri: str | None, payload: bytes, digest: str, length: int, refers_to: str | None) -> bytes:
    """One uncompressed record. For a revisit ``payload`` is empty, ``digest`` and ``length`` are those of the original."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to else 'response'}", f"WARC-Record-ID: <{record_id}>"]
    if uri is not None:
        lines.append("WARC-Target-URI: " + uri.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to:
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        lines.append(f"WARC-Refers-To: <{refers_to}>")
    lines += [
        "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: {digest}", f"WARC-Block-Digest: {_sha1(block)}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 16 + zlib.MAX_WBITS)
    return packer.compress(data) + packer.flush()


def _writer(folder: str, archive_bytes: int, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        store, root = open_folder(folder)
        out, held, number = None, 0, 0
        paths: list[str] = []

        def close() -> None:
            # The name tells the partition, not the attempt: a task that runs again replaces its own archives.
            nonlocal out, number
            if out is not None:
                out.close()
                name = f"{root}/part-{task.partitionId():06d}-{number:05d}.warc.gz"
                store.move(f"{root}/.attempt-{task.taskAttemptId()}", name)
                paths.append(f"{folder.rstrip('/')}/{os.path.basename(name)}")
                out, number = None, number + 1

        for batch in batches:
            for record_id, uri, refers_to, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                digest, length = _sha1(payload), len(payload)
                if out is None:
                    out, held = store.open_output_stream(f"{root}/.attempt-{task.taskAttemptId()}", compression=None), 0
                data = gzip_member(record_bytes(record_id, uri, b"" if refers_to else payload, digest, length, refers_to), level)
                out.write(data)
                held += len(data)
                if held >= archive_bytes:
                    close()
        close()
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string())], ["path"])

    return run


def revisit_plan(pages: DataFrame, min_revisit_bytes: int) -> DataFrame:
    """record_id, uri, payload, refers_to (null for responses) of every row of (id, url, payload)."""
    keyed = pages.withColumns({"digest": F.sha1("payload"), "length": F.octet_length("payload")})
    long_enough = keyed.select("id", "digest", "length").where(F.col("length") >= min_revisit_bytes)
    groups = long_enough.groupBy("digest").agg(F.max("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    # Shorter payloads can have no partner: null and empty pages get keys of their own instead of meeting in one task. A large
    # group of copies is split by adaptive execution.
    alone = F.concat(F.lit("-"), F.xxhash64("id", "url").cast("string"))
    sought = keyed.withColumn("digest", F.when(F.col("length") >= min_revisit_bytes, F.col("digest")).otherwise(alone))
    joined = sought.join(groups.drop("n"), "digest", "left")
    other = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first")) & (F.col("length") >= min_revisit_bytes)
    name = "urn:page:%s"
    return joined.select(
        F.format_string(name, F.coalesce(F.col("id").cast("string"), F.lit("null"))).alias("record_id"),
        F.col("url").alias("uri"),
        F.when(other, F.format_string(name, F.col("first").cast("string"))).alias("refers_to"),
        "payload",
    )


def write_archives(
    pages: DataFrame,
    folder: str | None = None,
    id_column: str = "page_id",
    url_column: str = "url",
    payload_column: str = "html",
    min_revisit_bytes: int = 1000,
    archive_bytes: int = 1 << 27,
    level: int = 6,
) -> DataFrame:
    """Write every row as one record; returns the table of archive paths."""
    folder = folder or scratch_path(pages.sparkSession, "warc")
    store, root = open_folder(folder)
    store.create_dir(root, recursive=True)
    rows = pages.select(
        F.col(id_column).alias("id"),
        F.col(url_column).alias("url"),
        F.coalesce(F.col(payload_column), F.lit("")).cast("binary").alias("payload"),
    )
    paths = revisit_plan(rows, min_revisit_bytes).mapInArrow(_writer(folder, archive_bytes, level), "path string")
    return stored(paths, "archives")


class MemberReader:
    """The uncompressed bytes of a file of gzip members, member by member, from blocks of bounded size."""

    def __init__(self, stream):
        self.stream, self.left, self.done = stream, b"", False
        self.inflate = None
        self.position = 0

    def next_member(self) -> bool:
        """Go to the next member; False at the end of the file."""
        if not self.left:
            self.left = self.stream.read(BLOCK)
        self.inflate = zlib.decompressobj(16 + zlib.MAX_WBITS)
        return bool(self.left)

    def read(self) -> bytes:
        """Some more bytes of the member; empty at its end."""
        while not self.inflate.eof:
            if not self.left:
                self.left = self.stream.read(BLOCK)
                if not self.left:
                    raise EOFError("the file ends inside a member")
            before = len(self.left)
            data = self.inflate.decompress(self.left, BLOCK)
            self.left = self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail
            self.position += before - len(self.left)
            if data:
                return data
        return b""


def read_records(stream) -> Iterator[dict]:
    """Records of one archive in order: headers, payload digest and length, and whether the digests hold."""
    reader = MemberReader(stream)
    while reader.next_member():
        at, data = reader.position, b""
        while b"\r\n\r\n" not in data:
            more = reader.read()
            if not more:
                raise ValueError("a member without a record header")
            data += more
        head, _, data = data.partition(b"\r\n\r\n")
        version, *lines = head.decode("utf-8", "replace").split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"not a record: {version[:40]}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        left = int(headers["content-length"])
        block, payload = hashlib.sha1(), hashlib.sha1()
        size, http, in_http = 0, b"", headers.get("content-type", "").startswith("application/http")
        while left:
            if not data:
                data = reader.read()
                if not data:
                    raise ValueError("a record shorter than its Content-Length")
            part, data = data[:left], data[left:]
            left -= len(part)
            block.update(part)
            if in_http:
                http += part
                if b"\r\n\r\n" not in http:
                    continue
                http, _, part = http.partition(b"\r\n\r\n")
                in_http = False
            payload.update(part)
            size += len(part)
        while more := reader.read():
            data += more
        if data != b"\r\n\r\n":
            raise ValueError("bytes after the record")
        stated, own = headers.get("warc-payload-digest"), payload.digest()
        ok = headers.get("warc-block-digest", "") in ("", "sha1:" + base64.b32encode(block.digest()).decode())
        if headers.get("warc-type") == "revisit":
            fields = dict(line.split(":", 1) for line in http.decode("latin-1").split("\r\n")[1:] if ":" in line)
            size = int({k.lower(): v for k, v in fields.items()}.get("content-length", 0))
            own = base64.b32decode(stated.partition(":")[2])
        elif stated:
            ok = ok and stated == "sha1:" + base64.b32encode(own).decode()
        yield {
            "position": at, "record_type": headers.get("warc-type"), "record_id": headers.get("warc-record-id", "").strip("<>"),
            "target_uri": headers.get("warc-target-uri"), "refers_to": headers.get("warc-refers-to", "").strip("<>") or None,
            "payload_digest": own.hex(), "payload_bytes": size, "digest_ok": ok, "error": None,
        }


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def batch(rows: list[dict]) -> pa.RecordBatch:
        columns = [pa.array([r.get(f) for r in rows], t) for f, t in zip(_FIELDS, _TYPES, strict=True)]
        return pa.RecordBatch.from_arrays(columns, _FIELDS)

    for paths in batches:
        for path in paths.column("path").to_pylist():
            store, name = open_folder(path)
            rows: list[dict] = []
            with store.open_input_stream(name, compression=None) as stream:
                try:
                    for record in read_records(stream):
                        rows.append(record | {"path": path})
                        if len(rows) == 1000:
                            yield batch(rows)
                            rows = []
                except (ValueError, EOFError, KeyError, zlib.error) as error:
                    rows.append({"path": path, "error": f"{type(error).__name__}: {error}"})
            if rows:
                yield batch(rows)


def read_archives(paths: DataFrame, most_tasks: int = 100_000) -> DataFrame:
    """Every record of the archives in a column ``path``; each archive is read by one task, in order.

    The archives are dealt to as many tasks as there are archives. The number is given, so that adaptive execution does not merge
    the few bytes of the paths into one task.
    """
    tasks = min(max(paths.count(), 1), most_tasks)
    return paths.select("path").repartition(tasks, "path").mapInArrow(_reader, RECORD)
