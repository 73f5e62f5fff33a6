"""Token files of directly addressable codes.

An id is split into 8-bit chunks, lowest first. Level k holds the k-th chunk of every id that
has one, with one continuation bit per chunk that says whether the id goes on, and a rank
directory with the number of set bits before each 512-bit line. Token i is read from level 0
at i, and from each next level at the rank of its continuation bit: no block is ever decoded.

File: magic, header length (u32), header (JSON: sizes and places of all parts), document ids
(i64, with a null bitmap), document ends (u64), then per level chunks, bits, ranks (u64).
All numbers are little-endian.
"""

from __future__ import annotations

import json
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import filesystem, new_path, shuffle_partitions, written
from .textops import batches
from .tokens import encoder as shared_encoder

MAGIC = b"DACTOK01"
LINE = 512
#: Tokens and documents of a file, about; a task that has more starts another file.
FILE_TOKENS, FILE_DOCS = 32_000_000, 500_000
#: Documents and tokens that are read at once.
READ_DOCS, READ_TOKENS = 2048, 8_000_000


def levels_of(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(chunks, bits, ranks) of each level."""
    out, rest = [], ids
    while True:
        more = rest > 0xFF
        bits = np.packbits(more, bitorder="little")
        pad = np.zeros(-len(bits) % (LINE // 8), np.uint8)
        lines = np.concatenate([bits, pad]).reshape(-1, LINE // 8)
        ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(lines).sum(axis=1, dtype=np.uint64))]).astype("<u8")
        out.append((rest.astype(np.uint8), bits, ranks))  # the cast keeps the low byte
        if not more.any():
            return out
        rest = rest[more] >> rest.dtype.type(8)


def to_bytes(doc_ids: list, ends: np.ndarray, ids: np.ndarray) -> bytes:
    """A whole file."""
    null = np.array([d is None for d in doc_ids], bool)
    parts = [np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.packbits(null, bitorder="little").tobytes(), ends.astype("<u8").tobytes()]
    for chunks, bits, ranks in levels_of(ids):
        parts += [chunks.tobytes(), bits.tobytes(), ranks.tobytes()]
    header = json.dumps({"docs": len(doc_ids), "tokens": len(ids), "sizes": [len(p) for p in parts]}).encode()
    return b"".join([MAGIC, len(header).to_bytes(4, "little"), header, *parts])


class TokenFile:
    """Random access to a file: ``token(i)``, ``tokens(a, b)`` and ``documents(a, b)``.

    ``source`` is the file's bytes, or an open file with ``read_at(n, place)``, of which only the ranges that are asked for are read.
    """

    def __init__(self, source):
        self._at = source.read_at if hasattr(source, "read_at") else lambda n, place: source[place : place + n]
        first = bytes(self._at(12, 0))
        if first[: len(MAGIC)] != MAGIC:
            raise ValueError("not a token file")
        n = int.from_bytes(first[8:12], "little")
        head = json.loads(bytes(self._at(n, 12)))
        self.starts = (12 + n + np.concatenate([[0], np.cumsum(head["sizes"])])).tolist()
        self.count, self.docs, self.depth = head["tokens"], head["docs"], (len(head["sizes"]) - 3) // 3

    def _part(self, part: int, kind: str, a: int, b: int) -> np.ndarray:
        """Items a..b-1 of a part of the file."""
        size = np.dtype(kind).itemsize
        return np.frombuffer(self._at((b - a) * size, self.starts[part] + a * size), kind)

    def _bits(self, level: int, a: int, b: int) -> np.ndarray:
        """Bytes a..b-1 of a level's continuation bits."""
        return self._part(4 + 3 * level, "u1", a, b)

    def documents(self, a: int, b: int) -> tuple[list, np.ndarray, np.ndarray]:
        """Ids of documents a..b-1, and the tokens at which each begins and ends."""
        null = np.unpackbits(self._part(1, "u1", a // 8, (b + 7) // 8), bitorder="little")[a % 8 : a % 8 + b - a]
        ids = [None if z else d for d, z in zip(self._part(0, "<i8", a, b).tolist(), null.tolist(), strict=True)]
        ends = self._part(2, "<u8", max(a - 1, 0), b).astype(np.int64)
        return (ids, ends[:-1], ends[1:]) if a else (ids, np.concatenate([[0], ends[:-1]]), ends)

    def _rank(self, level: int, i: int) -> int:
        """Set bits before bit i."""
        line = i // LINE
        bits = self._bits(level, line * (LINE // 8), (i + 7) // 8)
        before = int(np.bitwise_count(bits[: i // 8 - line * (LINE // 8)]).sum())
        last = (int(bits[-1]) & (1 << i % 8) - 1).bit_count() if i % 8 else 0
        return int(self._part(5 + 3 * level, "<u8", line, line + 1)[0]) + before + last

    def token(self, i: int) -> int:
        value, shift, level = 0, 0, 0
        while True:
            value |= int(self._part(3 + 3 * level, "u1", i, i + 1)[0]) << shift
            if not self._bits(level, i // 8, i // 8 + 1)[0] >> i % 8 & 1:
                return value
            i, level, shift = self._rank(level, i), level + 1, shift + 8

    def tokens(self, a: int, b: int) -> np.ndarray:
        """Ids a..b-1."""
        out = self._part(3, "u1", a, b).astype("<u4")
        at, low, high = None, a, b  # at: places in ``out`` of the ids that reach this level; none: all
        for level in range(self.depth - 1):
            more = np.unpackbits(self._bits(level, low // 8, (high + 7) // 8), bitorder="little")[low % 8 : low % 8 + high - low].view(bool)
            at = np.flatnonzero(more) if at is None else at[more]
            if not len(at):
                break
            low = self._rank(level, low)
            high = low + len(at)
            out[at] |= self._part(6 + 3 * level, "u1", low, high).astype(np.uint32) << np.uint32(8 * level + 8)
        return out


def write_tokens(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text: str = "text", end_id: int = 2, vocabulary: str | None = None, file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Writes all documents in ascending order of id and returns the manifest: part, serial, path, docs, tokens, start.

    A document is the ids of its whole text plus ``end_id``; null text counts as empty. Null ids come
    first; rows that repeat an id stand in the order of their texts' hashes. A task writes files of about
    ``file_tokens`` tokens under names of its own, so a task that runs again leaves no half file in the manifest.
    """
    spark = docs.sparkSession
    path = path or new_path(spark, "tokens")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("d"), F.col(f"`{text}`").alias("t"))
    # the second key parts the rows of an id that very many rows share
    ordered = rows.repartitionByRange("d", F.xxhash64("t")).sortWithinPartitions(F.col("d").asc_nulls_first(), F.xxhash64("t"))

    def run(batches_in):
        from pyspark import TaskContext

        encoder, part = shared_encoder(vocabulary), TaskContext.get().partitionId()
        fs, folder = filesystem(path)
        fs.create_dir(folder, recursive=True)
        held, ids, tokens, serial = [], [], 0, 0

        def flush():
            nonlocal serial
            ends = np.cumsum([len(x) for x in ids])
            name = f"{folder}/part-{part:06d}-{serial:04d}-{uuid.uuid4().hex}.dac"
            with fs.open_output_stream(name) as out:
                out.write(to_bytes(held, ends, np.concatenate(ids)))
            row = pa.RecordBatch.from_pydict({"part": [part], "serial": [serial], "path": [f"{path}/{name.rsplit('/', 1)[1]}"], "docs": [len(held)], "tokens": [int(ends[-1])]}, pa.schema([("part", pa.int32()), ("serial", pa.int32()), ("path", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64())]))
            serial += 1
            return row

        for whole in batches_in:
            for batch in batches(whole, "t", 1 << 20):
                for d, x in zip(batch.column("d").to_pylist(), encoder.encode([t or "" for t in batch.column("t").to_pylist()]), strict=True):
                    held.append(d)
                    ids.append(np.append(x, x.dtype.type(end_id)))
                    tokens += len(ids[-1])
                if tokens >= file_tokens or len(held) >= FILE_DOCS:
                    yield flush()
                    held, ids, tokens = [], [], 0
        if held:
            yield flush()

    manifest = written(ordered.mapInArrow(run, "part int, serial int, path string, docs long, tokens long"), "manifest")
    # one row per file: this window is over the file list, not over documents
    before = Window.orderBy("part", "serial").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def read_tokens(spark: SparkSession, manifest: DataFrame, with_ids: bool = True) -> DataFrame:
    """One row per document from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, ids.

    ids are unsigned 32-bit little-endian integers and ids_crc32 is their unsigned CRC-32. Without
    ``with_ids`` they are read and summed but not handed on (null). Files are dealt to as many tasks as there
    are shuffle partitions, one each if there are fewer, and read range by range.
    """

    def run(rows):
        for listing in rows:
            for path, start in zip(listing.column("path").to_pylist(), listing.column("start").to_pylist(), strict=True):
                fs, name = filesystem(path)
                with fs.open_input_file(name) as f:
                    file = TokenFile(f)
                    for at in range(0, file.docs, READ_DOCS):
                        yield from part(file, start, at, min(file.docs, at + READ_DOCS))

    def part(file: TokenFile, start: int, low: int, high: int):
        doc_ids, begin, end = file.documents(low, high)
        at = 0
        while at < len(doc_ids):  # a document that is larger than what is read at once is read alone
            to = max(at + 1, int(np.searchsorted(end, begin[at] + READ_TOKENS, "right")))
            a, b = begin[at:to], end[at:to]
            flat = file.tokens(int(a[0]), int(b[-1]))
            ids = [flat[x:y] for x, y in zip((a - a[0]).tolist(), (b - a[0]).tolist(), strict=True)]
            crc = pa.array([zlib.crc32(x) for x in ids], pa.int64())
            raw = pa.array([x.tobytes() for x in ids], pa.binary()) if with_ids else pa.nulls(len(ids), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids[at:to], pa.int64()), pa.array(a + start), pa.array(b - a), crc, raw], ["doc_id", "start", "n_tokens", "ids_crc32", "ids"])
            at = to

    tasks = max(1, min(manifest.count(), shuffle_partitions(spark)))
    listed = manifest.select("path", "start").repartitionByRange(tasks, "start")
    return listed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")
