"""WARC archives whose records are Zstandard frames with a shared dictionary.

An archive begins with a skippable frame that holds the dictionary, built from records of that
archive; each record is a frame of its own. Payloads that occur more than once are
stored once: the record with the largest id is the response and the others revisit it.
"""

from __future__ import annotations

import base64
import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import filesystem, new_path, shuffle_partitions, written
from .textops import batches

#: Magic number of the skippable frame that holds a dictionary.
DICTIONARY_FRAME = 0x184D2A5D
DICTIONARY_BYTES = 64 << 10
#: Bytes of an archive's first records that its dictionary is built from.
SAMPLE_BYTES = 4 << 20
#: Uncompressed bytes of an archive, about.
ARCHIVE_BYTES = 256 << 20
LEVEL = 3
#: A fixed date keeps the archives the same when a task runs again.
DATE = "2024-01-01T00:00:00Z"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _uri(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'page:{page_id}')}>"


def _clean(value: str) -> str:
    return "".join(c if c.isprintable() else "%" + c.encode("utf-8", "replace").hex() for c in value)


def record(page_id, url, payload: bytes, digest: str, refers_to, is_revisit: bool, payload_bytes: int) -> bytes:
    """One record; a revisit holds the HTTP header only and names its original."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_bytes}\r\n\r\n".encode()
    body = http if is_revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if is_revisit else 'response'}", f"WARC-Record-ID: {_uri(page_id)}", f"WARC-Date: {DATE}",
        *([f"WARC-Target-URI: {_clean(url)}"] if url is not None else []), f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}",
        *([f"X-Page-ID: {page_id}"] if page_id is not None else []),
        *(["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_uri(refers_to)}", f"X-Refers-To-Page-ID: {refers_to}"] if is_revisit else []),
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def build_dictionary(records: list[bytes]) -> bytes:
    import zstandard as z

    try:
        return z.train_dictionary(DICTIONARY_BYTES, records, k=256, d=8).as_bytes()
    except z.ZstdError:  # too few or too small records
        return b"".join(records)[-DICTIONARY_BYTES:] or b"."


class Writer:
    """Writes one archive: records wait until the dictionary's sample is complete."""

    def __init__(self, out):
        self.out, self.waiting, self.size, self.compressor = out, [], 0, None

    def add(self, raw: bytes) -> None:
        self.size += len(raw)
        if self.compressor is None:
            self.waiting.append(raw)
            if self.size >= SAMPLE_BYTES:
                self._begin()
        else:
            self.out.write(self.compressor.compress(raw))

    def _begin(self) -> None:
        import zstandard as z

        dictionary = build_dictionary(self.waiting)
        self.out.write(DICTIONARY_FRAME.to_bytes(4, "little") + len(dictionary).to_bytes(4, "little") + dictionary)
        data = z.ZstdCompressionDict(dictionary)
        data.precompute_compress(level=LEVEL)
        self.compressor = z.ZstdCompressor(level=LEVEL, dict_data=data, write_checksum=True, write_content_size=True)
        for raw in self.waiting:
            self.out.write(self.compressor.compress(raw))
        self.waiting = []

    def close(self) -> None:
        if self.compressor is None:
            self._begin()
        self.out.close()


def read_archive(f):
    """Records (headers, body) of an archive, one frame at a time."""
    import zstandard as z

    head = f.read(8)
    if int.from_bytes(head[:4], "little") != DICTIONARY_FRAME:
        raise ValueError("the archive does not begin with a dictionary frame")
    size = int.from_bytes(head[4:], "little")
    decompressor = z.ZstdDecompressor(dict_data=z.ZstdCompressionDict(f.read(size)))
    pending = b""
    while True:
        frame, parts = decompressor.decompressobj(), []
        while not frame.eof:
            if not pending:
                pending = f.read(1 << 16)
                if not pending:
                    if parts:
                        raise ValueError("the archive ends inside a record")
                    return
            parts.append(frame.decompress(pending))
            pending = frame.unused_data
        raw = b"".join(parts)
        head, _, body = raw.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        fields = dict(line.split(": ", 1) for line in lines[1:])
        yield fields, body[: int(fields["Content-Length"])]


def write_archives(pages: DataFrame, path: str | None = None, least_bytes: int = 0, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Writes every page and returns the manifest: path, records, bytes.

    Null html is an empty payload. Payloads are equal if their SHA-256 is; of equal ones of at least
    ``least_bytes`` the row with the largest id is the response (null is the smallest id), rows that
    repeat that id and payload are responses too. Smaller ones are all responses. A task writes
    archives under names of its own, so a task that runs again leaves none in the manifest twice.
    """
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("p"), F.col(f"`{url}`").alias("u"), F.coalesce(F.col(f"`{html}`"), F.lit("")).cast("binary").alias("h"))
    mark = F.when(F.octet_length("h") >= least_bytes, F.sha2("h", 256)).alias("s")
    groups = rows.select("p", mark).where("s is not null").groupBy("s").agg(F.count(F.lit(1)).alias("n"), F.max("p").alias("r")).where("n > 1 and r is not null")
    out = rows.withColumn("s", mark).join(groups.select("s", "r"), "s", "left").select("p", "u", "h", "r")

    def run(batches_in):
        from pyspark import TaskContext

        fs, folder = filesystem(path)
        fs.create_dir(folder, recursive=True)
        part, serial, writer, name, count = TaskContext.get().partitionId(), 0, None, "", 0

        def done():
            writer.close()
            return pa.RecordBatch.from_pydict({"path": [f"{path}/{name}"], "records": [count], "bytes": [writer.size]}, pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

        for whole in batches_in:
            for batch in batches(whole, "h"):
                for p, u, h, r in zip(*(batch.column(c).to_pylist() for c in "puhr"), strict=True):
                    if writer is None:
                        name = f"part-{part:06d}-{serial:04d}-{uuid.uuid4().hex}.warc.zst"
                        writer, count = Writer(fs.open_output_stream(f"{folder}/{name}")), 0
                    writer.add(record(p, u, h, sha1_base32(h), r, r is not None and p != r, len(h)))
                    count += 1
                    if writer.size >= ARCHIVE_BYTES:
                        yield done()
                        writer, serial = None, serial + 1
        if writer is not None:
            yield done()

    return written(out.mapInArrow(run, "path string, records long, bytes long"), "manifest")


def read_archives(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """One row per record of the archives: page_id, url, record_type, payload (null in a revisit), payload_bytes, payload_digest, refers_to."""
    fields = [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())]

    def run(rows):
        for listing in rows:
            for path in listing.column("path").to_pylist():
                fs, name = filesystem(path)
                with fs.open_input_stream(name) as f:
                    held, size = [], 0
                    for head, body in read_archive(f):
                        http, _, payload = body.partition(b"\r\n\r\n")
                        kind, digest = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha1:")
                        n = int(http.rsplit(b"Content-Length: ", 1)[1])
                        if kind == "response" and (len(payload) != n or sha1_base32(payload) != digest):
                            raise ValueError(f"a record of {path} does not match its digest")
                        number = lambda k: int(head[k]) if k in head else None  # noqa: B023,E731
                        held.append((number("X-Page-ID"), head.get("WARC-Target-URI"), kind, payload if kind == "response" else None, n, digest, number("X-Refers-To-Page-ID")))
                        size += len(payload)
                        if size > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in held], t) for k, (_, t) in enumerate(fields)], [f for f, _ in fields])
                            held, size = [], 0
                    if held:
                        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in held], t) for k, (_, t) in enumerate(fields)], [f for f, _ in fields])

    # an archive a task, as long as there are shuffle partitions for that
    tasks = max(1, min(manifest.count(), shuffle_partitions(spark)))
    return manifest.select("path").repartitionByRange(tasks, "path").mapInArrow(run, "page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long")
