"""Packing of tokenised documents by best-fit decreasing.

Each task tokenises its own rows, cuts overlong documents into full windows, and packs what
is left by best fit: pieces in falling order of length, each into the tightest window that
still takes it. A segment tree indexed by remaining capacity finds that window in
log2(window) steps. Nothing is shuffled, so the plan is one scan whatever the table's size;
a task keeps at most ``buffer_tokens`` tokens and packs and emits them when it has more.

The windows of a buffer that stay the least full are emptied into the gaps of the others
(their pieces are cut, which the contract allows), so that a buffer pads less than one window.

A sequence is padded to the window, unless its tokens number a power of two: then it stays as it is.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textops import batches, lean
from .tokens import REMEMBERED_BYTES
from .tokens import encoder as shared_encoder

WINDOW = 2048
#: Tokens that a task holds before it packs them: 16M are 32 MB.
BUFFER_TOKENS = 16_000_000
SCHEMA = "id_ {id_type}, start long, length long, ids binary, id_bytes int, ids_crc32 long, doc_tokens long, sequence_id long, offset long, window_tokens long, padded_tokens long"


def padded_length(tokens: int, window: int = WINDOW) -> int:
    """Length of a sequence once it is padded."""
    return tokens if tokens & (tokens - 1) == 0 else window


class CapacityTree:
    """Segment tree over remaining capacities 0..size; each leaf is a stack of open windows."""

    def __init__(self, size: int):
        self.leaves = 1
        while self.leaves <= size:
            self.leaves *= 2
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(size + 1)]

    def add(self, capacity: int, window: int) -> None:
        self.open[capacity].append(window)
        node = capacity + self.leaves
        while node:
            self.count[node] += 1
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Removes the window with the least capacity of at least ``need``: (capacity, window)."""
        node, count = need + self.leaves, self.count
        if not count[node]:
            while node > 1 and (node & 1 or not count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if count[2 * node] else 2 * node + 1
        capacity = node - self.leaves
        while node:
            count[node] -= 1
            node >>= 1
        return capacity, self.open[capacity].pop()


def best_fit_decreasing(lengths: list[int], window: int = WINDOW) -> list[list[int]]:
    """Windows as lists of piece numbers. ``lengths`` are 1..window; equal lengths keep their order."""
    tree, windows = CapacityTree(window), []
    for piece in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        found = tree.take(lengths[piece])
        if found is None:
            windows.append([])
            found = window, len(windows) - 1
        capacity, at = found
        windows[at].append(piece)
        if capacity > lengths[piece]:
            tree.add(capacity - lengths[piece], at)
    return windows


def pack(lengths: list[int], window: int = WINDOW) -> list[list[tuple[int, int, int]]]:
    """Windows of (piece, from, to): best fit decreasing, then the least full windows are cut into the others' gaps."""
    packed = [[(p, 0, lengths[p]) for p in w] for w in best_fit_decreasing(lengths, window)]
    used = [sum(hi - lo for _, lo, hi in w) for w in packed]
    order = sorted(range(len(packed)), key=lambda k: (used[k], k))
    donor, gaps = 0, [k for k in order[::-1] if used[k] < window]
    while gaps and donor < len(order) - 1:
        d = order[donor]
        room = sum(window - used[k] for k in gaps if k != d)
        if used[d] == window or room < used[d]:
            break
        parts, packed[d], used[d] = packed[d], [], window
        gaps = [k for k in gaps if k != d]
        for piece, lo, hi in parts:
            while lo < hi:
                g = gaps[0]
                step = min(hi - lo, window - used[g])
                packed[g].append((piece, lo, lo + step))
                used[g] += step
                lo += step
                if used[g] == window:
                    gaps.pop(0)
        donor += 1
    return [w for w in packed if w]


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = WINDOW, end_id: int = 1, vocabulary: str | None = None, buffer_tokens: int = BUFFER_TOKENS, remembered_bytes: int = REMEMBERED_BYTES) -> DataFrame:
    """One row per piece: id, start, length, ids (little-endian, id_bytes each), ids_crc32 (of the ids as unsigned 32-bit integers), doc_tokens, sequence_id, offset, window_tokens, padded_tokens.

    A document is its ids plus ``end_id``; start counts its ids before the piece, offset those before
    it in its sequence, window_tokens those that the sequence holds in all, padded_tokens its length once padded (see :func:`padded_sequences`). Null text counts as empty (one piece, the end id); a null id stays null;
    repeated rows are packed one by one; other columns are ignored.
    Texts of any length are encoded whole; an empty table gives an empty result. ``remembered_bytes`` bounds what a worker keeps of words and their ids, which it has until it ends or another operator's task begins in it.
    """
    id_type = docs.schema[id_col].dataType
    source = docs.select(F.col(f"`{id_col}`").alias("id_"), F.col(f"`{text}`").alias("t_"))

    def run(rows):
        from pyspark import TaskContext

        encoder = shared_encoder(vocabulary, remembered_bytes)
        task = TaskContext.get().partitionId() << 32
        serial, held, tokens = 0, [], 0
        arrow_id = None

        def emit():
            nonlocal serial
            out, rest, where = [], [], []
            for doc, ids in held:
                full = len(ids) // window * window
                for at in range(0, full, window):
                    out.append((doc, at, ids[at : at + window], len(ids), task + serial, 0, window))
                    serial += 1
                if full < len(ids):
                    rest.append(ids[full:])
                    where.append((doc, full, len(ids)))
            for parts in pack([len(r) for r in rest], window):
                offset, total = 0, sum(hi - lo for _, lo, hi in parts)
                for p, lo, hi in parts:
                    doc, full, n = where[p]
                    out.append((doc, full + lo, rest[p][lo:hi], n, task + serial, offset, total))
                    offset += hi - lo
                serial += 1
            for at in range(0, len(out), 4096):
                part = out[at : at + 4096]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[0] for x in part], arrow_id), *(pa.array([f(x) for x in part], t) for f, t in (
                        (lambda x: x[1], pa.int64()), (lambda x: len(x[2]), pa.int64()), (lambda x: x[2].tobytes(), pa.binary()), (lambda x: x[2].itemsize, pa.int32()), (lambda x: zlib.crc32(x[2].astype("<u4")), pa.int64()),
                        (lambda x: x[3], pa.int64()), (lambda x: x[4], pa.int64()), (lambda x: x[5], pa.int64()), (lambda x: x[6], pa.int64()), (lambda x: padded_length(x[6], window), pa.int64())))],
                    ["id_", "start", "length", "ids", "id_bytes", "ids_crc32", "doc_tokens", "sequence_id", "offset", "window_tokens", "padded_tokens"],
                )

        for whole in rows:
            arrow_id = whole.schema.field("id_").type
            for batch in batches(whole, "t_", 1 << 20):
                for doc, ids in zip(batch.column("id_").to_pylist(), encoder.encode([t or "" for t in batch.column("t_").to_pylist()]), strict=True):
                    ids = np.append(ids, ids.dtype.type(end_id))
                    held.append((doc, ids))
                    tokens += len(ids)
                if tokens >= buffer_tokens:
                    yield from emit()
                    held, tokens = [], 0
        if held:
            yield from emit()

    out = source.mapInArrow(lean(run, "encoder"), SCHEMA.format(id_type=id_type.simpleString()))
    return out.withColumnRenamed("id_", id_col)


def padded_sequences(pieces: DataFrame, pad_id: int = 0) -> DataFrame:
    """One row per sequence of :func:`pack_documents`: sequence_id, n_tokens, padded_tokens, ids (little-endian, as wide as the pieces').

    A sequence is the ids of its pieces in order, then ``pad_id`` up to padded_tokens. It holds at most a window, so a group is small.
    """
    part = F.struct("offset", F.hex("ids").alias("hex"))
    one = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(part)).alias("parts"), F.max("window_tokens").alias("n_tokens"), F.max("padded_tokens").alias("padded_tokens"), F.max("id_bytes").alias("width"))
    pad = F.when(F.col("width") == 2, pad_id.to_bytes(4, "little")[:2].hex()).otherwise(pad_id.to_bytes(4, "little").hex())
    whole = F.concat(F.array_join(F.transform("parts", lambda p: p["hex"]), ""), F.repeat(pad, (F.col("padded_tokens") - F.col("n_tokens")).cast("int")))
    return one.select("sequence_id", "n_tokens", "padded_tokens", F.unhex(whole).alias("ids"))
