"""Removal of repeated passages by a depth-limited radix sort of suffixes.

A byte goes if a string of ``WIDTH`` bytes that covers it starts anywhere else too. The suffixes of a text are ordered through ``WIDTH`` bytes
only, by passes over digits, and equal groups are exactly the repeated strings. Three things keep that small:

* Suffixes pass in runs. Among the places of a string's first ``SPANS[0]`` grams one is its mark, the first with the least hash, which depends on
  the string alone; strings of a text that share a mark are one run. Equal strings have their mark at the same place in them, so a run is compared
  only with runs of the same mark, by offset from it.
* The first digit of a run is its core, the bytes that all of its strings have in common (in every pass of one length, counted from the mark); the digit after it is
  all that its strings cover. Runs are dealt and sorted by these. A run whose core is nowhere else is done: none of its strings is repeated. A run
  that is elsewhere as a whole is done as well: all of them are. What is left is cut into blocks of 16 offsets and
  then of one, with longer cores, and sorted again; one of several equal runs goes with them as their partner. Where a repeated passage ends, two runs are left over, whatever its length.
* Digits are fingerprints: a string is the same if two fingerprints of 64 bits agree, of the core and of the whole, by unrelated sums over hashed grams.

Hot digits: a bounded sample of rows shows cores that very many runs have. Runs with such a core are dealt by both digits, and those of
which the sample holds two equal ones are known to be repeated and need no neighbour: they are dealt evenly. The sample decides where rows go,
never what is repeated.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import drop, shuffle_partitions, written
from .textops import batches, mix, utf8

#: Bytes of a string whose repetition counts.
WIDTH = 400
#: Offsets from the mark that a pass takes together.
SPANS = (256, 16, 1)
#: Bytes of a gram.
GRAM = 8
#: Strings hashed in one go.
SLICE = 1 << 20
#: Rows that the sample takes about, and the share of its runs from which a core is hot.
SAMPLE, HOT = 4000, 1 / 4000
#: Numbers that are broadcast at most: 16 MB. Where there are more, texts are moved, compressed.
BROADCAST_NUMBERS = 2_000_000
_B1, _B2 = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}
SETTLED, PARTNER, SPREAD = 1, 2, 4
REPEATED, OPEN = 1, 2


def _power(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of ``base`` and of its inverse modulo 2 ** 64."""
    known = _powers.get(base)
    if known is None or len(known[0]) < n:
        both = [np.full(max(n, SLICE + 4096), b, np.uint64) for b in (base, pow(base, -1, 1 << 64))]
        for p in both:
            p[0] = 1
            np.cumprod(p, out=p)
        known = _powers[base] = (both[0], both[1])
    return known


class Sums:
    """Fingerprints of any part of ``data`` from prefix sums over hashed grams."""

    def __init__(self, data: np.ndarray, gram: int):
        padded = np.zeros(len(data) + 16, np.uint8)
        padded[: len(data)] = data
        self.gram, n = gram, max(0, len(data) - gram + 1)
        grams = np.empty(n + 8, np.uint64)
        for r in range(8):
            own = grams[r::8]
            own[:] = 0
            view = padded[r : r + 8 * ((len(padded) - r) // 8)].view("<u8")[: len(own)]
            own[: len(view)] = view
        grams = grams[:n]
        if gram < 8:
            grams &= np.uint64((1 << (8 * gram)) - 1)
        self.hashed = mix(grams + np.uint64(_B1))
        self.sums = []
        for base, values in ((_B1, self.hashed), (_B2, (self.hashed >> np.uint64(32)) | (self.hashed << np.uint64(32)))):
            s = np.zeros(n + 1, np.uint64)
            np.cumsum(values * _power(base, n + 1)[0][:n], out=s[1:])
            self.sums.append((s, _power(base, n + 1)[1]))

    def of(self, which: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        s, inverse = self.sums[which]
        return mix((s[end - self.gram + 1] - s[start]) * inverse[start])

    def digits(self, mark: np.ndarray, block: np.ndarray, lo: np.ndarray, hi: np.ndarray, span: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(core, whole) of the strings at offsets lo to hi before the mark, in the block of ``span`` offsets that begins at ``block``."""
        core = self.of(0, mark - block, mark - block - span + 1 + width) ^ mix(block.astype(np.uint64))
        whole = self.of(1, mark - hi, mark - lo + width) ^ mix(((hi << 8) | lo).astype(np.uint64) + np.uint64(_B2))
        return core, whole


def runs(data: np.ndarray, offsets: np.ndarray, width: int, span: int, gram: int):
    """(row, mark in the row, lo, hi, core, whole) of each run of the texts of a batch, in slices."""
    starts, ends = offsets[:-1], offsets[1:]
    for at in range(0, max(len(data) - width + 1, 0), SLICE):
        part = data[at : at + SLICE + width - 1]
        first, last = np.searchsorted(ends, at, "right"), np.searchsorted(starts, at + len(part), "left")
        a, b = np.maximum(starts[first:last] - at, 0), np.minimum(ends[first:last] - width + 1 - at, len(part) - width + 1)
        some = b > a
        if not some.any():
            continue
        rows, a, b = np.arange(first, last)[some], a[some], b[some]
        sums = Sums(part, gram)
        n = len(sums.hashed)
        least = (sums.hashed >> np.uint64(22) << np.uint64(22)) | np.arange(n, dtype=np.uint64)  # the place is in the low bits: of equal ones the first
        reach = 1
        while reach < span:
            step = min(reach, span - reach)
            least = np.minimum(least[: len(least) - step], least[step:])
            reach += step
        counts = b - a
        i = np.arange(int(counts.sum())) + np.repeat(a - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
        mark = (least[i] & np.uint64((1 << 22) - 1)).astype(np.int64)
        new = np.ones(len(i), bool)
        new[1:] = (mark[1:] != mark[:-1]) | (i[1:] != i[:-1] + 1)
        head = np.flatnonzero(new)
        p, low, high = mark[head], i[head], i[np.append(head[1:], len(i)) - 1]
        row = rows[np.searchsorted(a, low, "right") - 1]
        core, whole = sums.digits(p, np.zeros(len(p), np.int64), p - high, p - low, span, width)
        yield row, p + at - starts[row], p - high, p - low, core, whole


def blocks(data: np.ndarray, offsets: np.ndarray, top: np.ndarray, row: np.ndarray, lo: np.ndarray, hi: np.ndarray, span: int, width: int, gram: int):
    """(index, lo, hi, core, whole) of the blocks of ``span`` offsets of each (row, lo, hi); a row's text begins at offset ``top`` before its mark."""
    count = hi // span - lo // span + 1
    index = np.repeat(np.arange(len(row)), count)
    block = (np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + (lo // span)[index]) * span
    low, high = np.maximum(lo[index], block), np.minimum(hi[index], block + span - 1)
    sums = Sums(data, gram)
    core, whole = sums.digits(offsets[row[index]] + top[row[index]], block, low, high, span, width)
    return index, low, high, core, whole


def _rows(names: list[str], refs: list[pa.Array], code: np.ndarray, flags: np.ndarray, core: np.ndarray, whole: np.ndarray, hot: dict) -> pa.RecordBatch:
    """Rows to be sorted, with ``part``, by which they are dealt."""
    core, whole = core.view(np.int64), whole.view(np.int64)
    part, flags = core.copy(), flags.astype(np.int32)
    if len(hot["cores"]):
        place = np.minimum(np.searchsorted(hot["cores"], core), len(hot["cores"]) - 1)
        spread = hot["cores"][place] == core
        flags[spread] |= SPREAD
        both = mix(core.view(np.uint64) + np.uint64(_B2) * whole.view(np.uint64)).view(np.int64)
        part[spread] = both[spread]
        known = spread & np.isin(both, hot["pairs"])
        settled = known & (flags & PARTNER == 0)
        flags[settled] |= SETTLED
        part[settled] = mix(np.arange(len(part), dtype=np.uint64) + code.view(np.uint64) * np.uint64(_B1)).view(np.int64)[settled]
        # of rows that are known to be repeated the sampled one is also the partner
        own = _reference(refs[0].to_numpy(zero_copy_only=False), code)
        twice = np.flatnonzero(settled & np.isin(own, hot["rows"]))
        if len(twice):
            twice = twice[np.unique(own[twice], return_index=True)[1]]
            everything = np.concatenate([np.arange(len(part)), twice])
            refs, code, core, whole = [r.take(pa.array(everything)) for r in refs], code[everything], core[everything], whole[everything]
            part, flags = np.concatenate([part, both[twice]]), np.concatenate([flags, np.full(len(twice), SPREAD | PARTNER, np.int32)])
    return pa.RecordBatch.from_arrays([*refs, *map(pa.array, (code, flags, core, whole, part))], [*names, "code", "flags", "core", "whole", "part"])


_ROW = "code long, flags int, core long, whole long, part long"
_NONE = {"cores": np.zeros(0, np.int64), "pairs": np.zeros(0, np.int64), "rows": np.zeros(0, np.int64)}


def _reference(first: np.ndarray, code: np.ndarray) -> np.ndarray:
    return mix(first.view(np.uint64) + np.uint64(_B1) * code.view(np.uint64)).view(np.int64)


def _hot(source: DataFrame, extract, schema: str, ref: str) -> dict:
    """Cores that very many runs of a sample have, and (core, whole) that the sample has twice."""
    n = source.count()
    sample = source if n <= SAMPLE else source.sample(SAMPLE / n, 5)
    pairs = sample.mapInArrow(extract(_NONE), schema).groupBy("core", "whole").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.col(ref).alias("ref"), "code")).alias("row"))
    pairs = written(pairs, "sampled")
    total = pairs.agg(F.sum("n")).first()[0] or 0
    least = max(16, int(total * HOT))
    cores = pairs.groupBy("core").agg(F.sum("n").alias("all")).where(F.col("all") >= least)
    found = [r.core for r in cores.collect()]  # at most 1 / HOT
    often = pairs.where(F.col("n") >= least).join(F.broadcast(cores), "core").select("core", "whole", "row.*").collect()
    drop(pairs)
    both = mix(np.array([r.core for r in often], np.int64).view(np.uint64) + np.uint64(_B2) * np.array([r.whole for r in often], np.int64).view(np.uint64)).view(np.int64)
    return {"cores": np.sort(np.array(found, np.int64)), "pairs": np.sort(both), "rows": _reference(np.array([r.ref for r in often], np.int64), np.array([r.code for r in often], np.int64))}


def _neighbours(names: list[str]):
    """Of rows sorted by core and whole, those that are repeated and those that are open, with their partners."""

    def settle(table: pa.Table, before: tuple | None, more: bool):
        core, whole, flags = (table.column(c).to_numpy() for c in ("core", "whole", "flags"))
        n = len(core)
        same_core, same = np.zeros(n + 1, bool), np.zeros(n + 1, bool)  # of a row and the one before it
        apart = flags & SETTLED  # settled rows stand behind the others
        same_core[1:n] = (core[1:] == core[:-1]) & (apart[1:] == apart[:-1])
        same[1:n] = same_core[1:n] & (whole[1:] == whole[:-1])
        if before is not None:
            same_core[0] = before[0] == core[0] and before[2] == apart[0]
            same[0] = same_core[0] and before[1] == whole[0]
        partner, settled, spread = (flags & f > 0 for f in (PARTNER, SETTLED, SPREAD))
        repeated = settled | same[:-1] | same[1:]
        mixed = (same_core[:-1] & ~same[:-1]) | (same_core[1:] & ~same[1:]) | (spread & ~same[:-1])
        status = np.zeros(n, np.int32)
        status[repeated & ~partner] = REPEATED
        status[~repeated & ~partner & (same_core[:-1] | same_core[1:] | spread)] = OPEN
        status[(repeated | partner) & ~settled & mixed] |= OPEN
        partners = ((repeated | partner) & (status & OPEN > 0)).astype(np.int32)
        keep = np.flatnonzero(status[: n - 1 if more else n])
        out = table.select([*names, "code"]).take(pa.array(keep))
        return out.append_column("status", pa.array(status[keep])).append_column("partner", pa.array(partners[keep])), (core[n - 2], whole[n - 2], apart[n - 2]) if n > 1 else before

    def run(found):
        held, before = None, None
        for batch in found:
            if batch.num_rows == 0:
                continue
            table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            out, before = settle(table, before, True)
            held = table.slice(table.num_rows - 1)
            yield from out.combine_chunks().to_batches()
        if held is not None:
            yield from settle(held, before, False)[0].combine_chunks().to_batches()

    return run


def _sorted(source: DataFrame, extract, refs: dict[str, str], name: str) -> DataFrame:
    """(refs, code, status, partner) of the runs that ``extract`` makes of ``source``."""
    schema = ", ".join([*(f"{k} {v}" for k, v in refs.items()), _ROW])
    rows = source.mapInArrow(extract(_hot(source, extract, schema, next(iter(refs)))), schema)
    dealt = rows.repartition(shuffle_partitions(source.sparkSession), "part").sortWithinPartitions(F.col("flags").bitwiseAND(SETTLED), "core", "whole")
    out = dealt.mapInArrow(_neighbours(list(refs)), ", ".join([*(f"{k} {v}" for k, v in refs.items()), "code long, status int, partner int"]))
    return written(out, name)


def _from_texts(width: int, span: int, gram: int):
    def extract(hot: dict):
        def run(found):
            for whole_batch in found:
                for batch in batches(whole_batch, "t_", 4 << 20):
                    data, offsets = utf8(batch.column("t_"))
                    for row, p, lo, hi, core, whole in runs(data, offsets, width, span, gram):
                        at = pa.array(row)
                        yield _rows(["k1", "k2"], [batch.column(k).take(at) for k in ("k1", "k2")], (p << 16) | (hi << 8) | lo, np.zeros(len(p), np.int32), core, whole, hot)

        return run

    return extract


def _from_pieces(width: int, span: int, gram: int):
    def extract(hot: dict):
        def run(found):
            for whole_batch in found:
                for batch in batches(whole_batch, "bytes", 1 << 20):
                    lists = batch.column("ranges")
                    if not len(lists.flatten()):
                        continue
                    row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
                    ranges = lists.flatten().to_numpy()
                    sizes = np.array([len(b) for b in batch.column("bytes").to_pylist()])
                    data = np.frombuffer(b"".join(batch.column("bytes").to_pylist()), np.uint8)
                    offsets = np.concatenate([[0], np.cumsum(sizes)])
                    top = (batch.column("code").to_numpy() >> 8) & 255
                    index, lo, hi, core, whole = blocks(data, offsets, top, row, ranges & 255, (ranges >> 8) & 255, span, width, gram)
                    flags = np.where(ranges[index] >> 16, PARTNER, 0)
                    yield _rows(["piece"], [batch.column("piece").take(pa.array(row[index]))], (hi << 8) | lo, flags, core, whole, hot)

        return run

    return extract


def _cut(width: int):
    """The pieces of texts that open runs cover."""

    def run(found):
        for batch in found:
            out = {k: [] for k in ("k1", "k2", "code", "partner", "bytes")}
            for k1, k2, text, items in zip(*(batch.column(c) for c in ("k1", "k2", "t_", "numbers"))):
                raw = _raw(text)
                for item in items.as_py() or ():
                    p, hi, lo = item >> 17, (item >> 9) & 255, (item >> 1) & 255
                    for k, v in zip(out, (k1.as_py(), k2.as_py(), item >> 1, item & 1, raw[p - hi : p - lo + width])):
                        out[k].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out["k1"], pa.int64()), pa.array(out["k2"], pa.int64()), pa.array(out["code"], pa.int64()), pa.array(out["partner"], pa.int32()), pa.array(out["bytes"], pa.binary())], list(out))

    return run


def _raw(text) -> bytes:
    """UTF-8 bytes of a text, or of a compressed one."""
    if isinstance(text, (pa.StringScalar, pa.LargeStringScalar)):
        buffer = text.as_buffer()
        return buffer.to_pybytes() if buffer is not None else b""
    packed = text.as_py()
    if packed is None:
        return b""
    import zstandard

    return zstandard.ZstdDecompressor().decompress(packed)


def _packed(found):
    import zstandard

    pack = zstandard.ZstdCompressor(level=1)
    for batch in found:
        texts = pa.array([None if not t.is_valid else pack.compress(_raw(t)) for t in batch.column("t_")], pa.binary())
        yield pa.RecordBatch.from_arrays([texts if k == "t_" else batch.column(k) for k in batch.schema.names], batch.schema.names)


def _with_numbers(docs: DataFrame, numbers: DataFrame, how: str) -> DataFrame:
    """``docs`` (id_, k1, k2, t_) with the array ``numbers`` of its keys. Few numbers go to the texts; otherwise texts, compressed, go to them."""
    size = numbers.agg(F.sum(F.size("numbers") + 4)).first()[0] or 0
    if size <= BROADCAST_NUMBERS:
        return docs.join(F.broadcast(numbers), ["k1", "k2"], how)
    schema = ", ".join(f"{f.name} {'binary' if f.name == 't_' else f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(_packed, schema).join(numbers, ["k1", "k2"], how)


def _merged(found):
    """Ranges of bytes (start << 16 | strings) as sorted disjoint ones: start, end, start, end."""
    for batch in found:
        out = []
        for spans in batch.column("numbers"):
            values = np.sort(spans.values.to_numpy())
            start, end = values >> 16, (values >> 16) + (values & 0xFFFF)
            last = np.maximum.accumulate(end)
            head = np.append(True, start[1:] > last[:-1])
            tail = np.append(head[1:], True)
            out.append(np.column_stack([start[head], last[tail]]).ravel())
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int32)), pa.array(np.concatenate(out) if out else np.zeros(0, np.int64), pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column("k1"), batch.column("k2"), lists], ["k1", "k2", "numbers"])


def _removed(id_col: str, with_kept: bool):
    def run(found):
        for whole in found:
            for batch in batches(whole, "t_"):
                cols: list[list] = [[], [], [], [], []]
                for text, spans in zip(batch.column("t_"), batch.column("numbers")):
                    raw, cuts = _raw(text), spans.as_py() or []
                    kept = b"".join(raw[a:b] for a, b in zip([0, *cuts[1::2]], [*cuts[::2], len(raw)])) if cuts else raw
                    for c, v in zip(cols, (len(raw), len(raw) - len(kept), len(cuts) // 2, hashlib.sha256(kept).hexdigest(), kept)):
                        c.append(v)
                arrays = [batch.column("id_"), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())]
                names = [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256"]
                if with_kept:
                    arrays, names = [*arrays, pa.array(cols[4], pa.binary())], [*names, "kept"]
                yield pa.RecordBatch.from_arrays(arrays, names)

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = WIDTH, spans: tuple[int, ...] = SPANS, gram: int = GRAM, with_kept: bool = True) -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, n_removed, n_spans (longest removed runs), kept_sha256 and, with ``with_kept``, kept (the bytes that stay, as binary: a cut may part a character).

    Texts are judged as UTF-8 bytes; a null text is empty, and texts shorter than ``width`` lose nothing. Repeats count within a text too, overlaps included.
    Rows that repeat an id and a text are repeats of one another like any others; null ids are ids. Every copy goes, the first one too: what stays
    has no string of ``width`` bytes that the input has twice. Texts of any length are hashed slice by slice. An empty table gives an empty result; other columns do not matter.

    ``spans`` ends with 1 and begins with 256 at most; ``spans[0] + gram`` must not exceed ``width`` + 1. In a text of one repeated byte every place is a mark, so that it makes as
    many rows as it has bytes; of any other period there is one in each period or span.
    """
    if not (spans[-1] == 1 and spans[0] <= 256 and spans[0] + gram <= width + 1 and 1 <= gram <= 8):
        raise ValueError("spans and gram do not fit the width")
    source = docs.select(F.col(f"`{id_col}`").alias("id_"), F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{id_col}`").isNull()).alias("k1"), F.xxhash64(F.col(f"`{text}`")).alias("k2"), F.col(f"`{text}`").alias("t_"))
    first = _sorted(source.drop("id_"), _from_texts(width, spans[0], gram), {"k1": "long", "k2": "long"}, "runs")
    code = F.col("code")
    top = lambda c: F.shiftright(c, 8).bitwiseAND(255)
    span = lambda mark, c: F.shiftleft(mark - top(c), 16) + (top(c) - c.bitwiseAND(255) + width)
    ranges = [first.where(F.col("status").bitwiseAND(REPEATED) > 0).select("k1", "k2", span(F.shiftright(code, 16), code).alias("range"))]
    scratch = [first]
    opened = first.where(F.col("status").bitwiseAND(OPEN) > 0).groupBy("k1", "k2").agg(F.collect_set(F.shiftleft(code, 1) + F.col("partner")).alias("numbers"))
    opened = written(opened, "open-runs")
    pieces = _with_numbers(source.select("k1", "k2", "t_"), opened, "inner").mapInArrow(_cut(width), "k1 long, k2 long, code long, partner int, bytes binary")
    pieces = written(pieces.withColumn("piece", F.monotonically_increasing_id()), "pieces")
    drop(opened)
    here = pieces.withColumn("ranges", F.array(code.bitwiseAND(0xFFFF) + F.shiftleft(F.col("partner").cast("long"), 16)))
    for level, size in enumerate(spans[1:], 1):
        found = _sorted(here.select("piece", "code", "bytes", "ranges"), _from_pieces(width, size, gram), {"piece": "long"}, f"blocks-{level}")
        scratch.append(found)
        repeated = found.where(F.col("status").bitwiseAND(REPEATED) > 0).select("piece", F.col("code").alias("c"))
        marks = pieces.select("piece", "k1", "k2", F.shiftright("code", 16).alias("mark"))
        ranges.append(repeated.join(marks, "piece").select("k1", "k2", span(F.col("mark"), F.col("c")).alias("range")))
        if size > 1:
            left = found.where(F.col("status").bitwiseAND(OPEN) > 0).groupBy("piece").agg(F.collect_set(code + F.shiftleft(F.col("partner").cast("long"), 16)).alias("ranges"))
            here = written(pieces.select("piece", "code", "bytes").join(left, "piece"), f"open-{level}")
            scratch.append(here)
    everything = ranges[0]
    for more in ranges[1:]:
        everything = everything.unionByName(more)
    gone = everything.groupBy("k1", "k2").agg(F.collect_set("range").alias("numbers")).mapInArrow(_merged, "k1 long, k2 long, numbers array<long>")
    gone = written(gone, "removed")
    drop(pieces, *scratch)
    kept = _with_numbers(source, gone, "left").select("id_", "t_", "numbers")
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return kept.mapInArrow(_removed(id_col, with_kept), schema + ", kept binary" * with_kept)
