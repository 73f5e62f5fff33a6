"""Benchmark decontamination by greedy string tiling.

Tokens that documents share with benchmark items are found by seeds (hashes of
``min_tile`` consecutive tokens); for each pair of document and item with enough seeds,
running Karp-Rabin matching marks the longest common runs that do not overlap, again and
again, until none of ``min_tile`` tokens is left. An item counts as contained if the tiles
cover ``threshold`` of its tokens, in whatever order they stand.

The benchmark is a stated query set: it is dealt into blocks of at most ``block_bytes`` of
text, each small enough to be sent to every task, and documents are scanned once per block.
Nothing of the documents is shuffled.
"""

from __future__ import annotations

import math
import unicodedata
from functools import cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .textops import NOT_ALNUM, _powers, batches, lean, window_hashes, word_hashes

MIN_TILE = 5
THRESHOLD = 0.5
#: Text of the benchmark that is sent to the tasks at once.
BLOCK_BYTES = 4 << 20
#: Code points that are put into tokens in one go.
SLICE = 1 << 19
#: Scripts written without blanks between words (Thai to Myanmar, Khmer, New Tai Lue to Tai Tham, kana, Han): each character is a token.
_UNSPACED = ((0x0E00, 0x1000), (0x1000, 0x10A0), (0x1780, 0x1800), (0x1950, 0x1AB0), (0x3005, 0x3008), (0x3021, 0x3030), (0x3031, 0x3100), (0x31F0, 0x3200), (0x3400, 0x4DC0), (0x4E00, 0xA4D0), (0xF900, 0xFB00), (0xFF66, 0xFFA0), (0x1B000, 0x1B170), (0x20000, 0x32000))
_BLANK = 0x20


@cache
def _classes() -> np.ndarray:
    """Code point -> 0 separator, 1 part of a word (letter, mark or number), 2 token of its own."""
    table = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        table[c] = unicodedata.category(chr(c))[0] in "LMN"
    for a, b in _UNSPACED:
        table[a:b] *= 2
    return table


def _folded(text: str | None) -> str:
    """Without case, and composed, so that canonically equal texts are equal."""
    if not text or text.isascii():
        return (text or "").lower()
    return unicodedata.normalize("NFC", unicodedata.normalize("NFC", text).casefold())


def token_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all tokens of all rows, and where each row's tokens begin; null counts as empty."""
    rows = [_folded(t) for t in column.to_pylist()]
    ends = np.cumsum([0] + [len(t) for t in rows])
    text = "".join(rows)
    if text.isascii():
        return word_hashes(np.frombuffer(text.encode(), np.uint8), ends, NOT_ALNUM)
    parts, offsets, size = [], np.zeros(len(ends), np.int64), 0
    for at in range(0, len(text), SLICE):
        codes = np.frombuffer(text[at : at + SLICE].encode("utf-32-le"), np.uint32)
        kind = _classes()[codes]
        alone = kind == 2
        # a blank on either side of a token of its own; the blank before it belongs to the same row
        place = np.arange(len(codes)) + 2 * np.cumsum(alone) - alone
        spaced = np.full(len(codes) + 2 * int(alone.sum()), _BLANK, np.uint32)
        spaced[place] = np.where(kind > 0, codes, np.uint32(_BLANK))
        bytes_ = np.concatenate([[0], np.cumsum(1 + (spaced >= 0x80) + (spaced >= 0x800) + (spaced >= 0x10000))])
        own = slice(*np.searchsorted(ends, [at, at + len(codes)]))
        offsets[own] = size + bytes_[(place - alone)[ends[own] - at]]
        parts.append(np.frombuffer(spaced.tobytes().decode("utf-32-le").encode(), np.uint8))
        size += int(bytes_[-1])
    offsets[ends == len(text)] = size
    return word_hashes(np.concatenate(parts), offsets, NOT_ALNUM)


def rolling(tokens: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hash of each window of ``size`` tokens."""
    n = len(tokens)
    if n < size:
        return np.zeros(0, np.uint64)
    powers, inverse = _powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(tokens * powers[:n], out=sums[1:])
    return (sums[size:] - sums[:-size]) * inverse[: n - size + 1]


def _clear(free: np.ndarray, size: int) -> np.ndarray:
    """Whether each window of ``size`` tokens is free."""
    taken = np.concatenate([[0], np.cumsum(~free)])
    return taken[size:] == taken[:-size]


def tiles(text: np.ndarray, item: np.ndarray, min_tile: int = MIN_TILE) -> list[tuple[int, int, int]]:
    """Tiles (start in text, start in item, length), longest first in each round, none overlapping."""
    free_t, free_i, found = np.ones(len(text), bool), np.ones(len(item), bool), []
    size = min(len(text), len(item))
    while size >= min_tile:
        at_t, at_i = np.flatnonzero(_clear(free_t, size)), np.flatnonzero(_clear(free_i, size))
        table: dict[int, list[int]] = {}
        for k, h in zip(at_i.tolist(), rolling(item, size)[at_i].tolist(), strict=True):
            table.setdefault(h, []).append(k)
        hashes = rolling(text, size)[at_t]
        hits = np.isin(hashes, np.fromiter(table, np.uint64, len(table)))
        matches = []
        for p, h in zip(at_t[hits].tolist(), hashes[hits].tolist(), strict=True):
            for q in table[h]:
                n, most = 0, min(len(text) - p, len(item) - q)
                while n < most and text[p + n] == item[q + n] and free_t[p + n] and free_i[q + n]:
                    n += 1
                if n >= size:
                    matches.append((n, p, q))
        # longest first; what is left of a match whose end was taken by a longer one waits for its turn again
        queue = [(-n, p, q) for n, p, q in matches]
        heapify(queue)
        while queue:
            n, p, q = heappop(queue)
            free = free_t[p : p - n] & free_i[q : q - n]
            left = -n if free.all() else int(free.argmin())
            if left == -n:
                free_t[p : p + left] = free_i[q : q + left] = False
                found.append((p, q, left))
            elif left >= size:
                heappush(queue, (-left, p, q))
        size = size // 2 if size > 2 * min_tile else min_tile if size > min_tile else 0
    return found


class Seeds:
    """Seeds of a block of benchmark items, sorted by hash."""

    def __init__(self, ids: list, texts: list, min_tile: int):
        words, begin = token_hashes(pa.array(texts, pa.string()))
        self.ids, self.min_tile = ids, min_tile
        self.items = [words[begin[k] : begin[k + 1]] for k in range(len(texts))]
        hashes = [window_hashes(w, min_tile) for w in self.items]
        h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        order = np.argsort(h, kind="stable")
        self.hash = h[order]
        self.item = np.repeat(np.arange(len(texts)), [len(x) for x in hashes])[order]
        self.place = np.concatenate([np.arange(len(x)) for x in hashes])[order] if hashes else np.zeros(0, int)
        #: Items too short for a seed, by length: hash of the whole item -> items.
        self.short: dict[int, dict[int, list[int]]] = {}
        for k, w in enumerate(self.items):
            if 0 < len(w) < min_tile:
                self.short.setdefault(len(w), {}).setdefault(int(window_hashes(w, len(w))[0]), []).append(k)

    def matches(self, words: np.ndarray, threshold: float):
        """(item number, coverage, tiles) of each item that ``words`` contains."""
        for size, known in self.short.items():
            h = window_hashes(words, size)
            places = np.flatnonzero(np.isin(h, np.fromiter(known, np.uint64, len(known))))
            first = np.unique(h[places], return_index=True)[1]
            for at in sorted(places[first].tolist()):
                yield from ((item, 1.0, [(at, 0, size)]) for item in known[int(h[at])])
        if len(self.hash) == 0:
            return
        h = window_hashes(words, self.min_tile)
        low = np.searchsorted(self.hash, h, "left")
        hit = np.flatnonzero((low < len(self.hash)) & (self.hash[np.minimum(low, len(self.hash) - 1)] == h))
        if not len(hit):
            return
        high = np.searchsorted(self.hash, h[hit], "right")
        at = np.concatenate([np.arange(a, b) for a, b in zip(low[hit].tolist(), high.tolist(), strict=True)])
        place = np.repeat(hit, high - low[hit])
        for item in np.unique(self.item[at]).tolist():
            own = self.item[at] == item
            tokens = self.items[item]
            reach = np.zeros(len(tokens), bool)
            for k in range(self.min_tile):
                reach[self.place[at[own]] + k] = True
            if reach.mean() < threshold:
                continue
            inside = np.zeros(len(words), bool)
            for k in range(self.min_tile):
                inside[place[own] + k] = True
            # only runs of seeds can hold a tile; a token of its own stands for what lies between them
            runs = np.flatnonzero(inside)
            gap = np.flatnonzero(np.diff(runs) > 1) + 1
            text = np.insert(words[runs], gap, np.uint64(0))
            found = tiles(text, tokens, self.min_tile)
            coverage = sum(n for _, _, n in found) / len(tokens)
            if coverage >= threshold:
                yield item, coverage, found


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", item_col: str = "item_id", item_text: str = "text", min_tile: int = MIN_TILE, threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per pair of document and benchmark item that it contains: id, item id, coverage, n_tiles, longest_tile, item_tokens.

    Tokens are runs of letters, marks and numbers of Unicode without case, and single characters in scripts without blanks. Items of fewer than ``min_tile``
    tokens are compared whole: a text that has all of their tokens in a row contains them. Null and empty texts match nothing; an empty benchmark, or an empty table, gives an empty result;
    texts of any length are read whole; of matches that tie the first in the text, then in the item, is marked first; repeated rows are reported each; other columns are ignored.
    """
    types = docs.schema[id_col].dataType, benchmark.schema[item_col].dataType
    schema = f"id_ {types[0].simpleString()}, item_ {types[1].simpleString()}, coverage double, n_tiles int, longest_tile int, item_tokens int"
    source = docs.select(F.col(f"`{id_col}`").alias("id_"), F.col(f"`{text}`").alias("t_"))
    out = None
    for seeds in _blocks(benchmark, item_col, item_text, min_tile, block_bytes):
        found = source.mapInArrow(lean(_scan(seeds, threshold, to_arrow_type(types[1]))), schema)
        out = found if out is None else out.unionByName(found)
    return out.withColumnsRenamed({"id_": id_col, "item_": item_col})


def _blocks(benchmark: DataFrame, item_col: str, item_text: str, min_tile: int, block_bytes: int):
    """Broadcast seeds of each block of the benchmark; there is one block at least."""
    items = benchmark.select(F.col(f"`{item_col}`").alias("i"), F.col(f"`{item_text}`").alias("t")).where("t is not null")
    size = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k).orderBy("i", "t").collect()
        yield benchmark.sparkSession.sparkContext.broadcast(Seeds([r.i for r in rows], [r.t for r in rows], min_tile))


def _scan(seeds, threshold: float, item_type: pa.DataType):
    def run(rows):
        s = seeds.value
        for whole in rows:
            for batch in batches(whole, "t_"):
                words, begin = token_hashes(batch.column("t_"))
                got = [(k, s.ids[i], cov, len(t), max(n for _, _, n in t), len(s.items[i])) for k in range(batch.num_rows) for i, cov, t in s.matches(words[begin[k] : begin[k + 1]], threshold)]
                if got:
                    at = pa.array([g[0] for g in got], pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("id_").take(at), pa.array([g[1] for g in got], item_type), pa.array([g[2] for g in got], pa.float64()), *(pa.array([g[k] for g in got], pa.int32()) for k in (3, 4, 5))],
                        ["id_", "item_", "coverage", "n_tiles", "longest_tile", "item_tokens"],
                    )

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_col: str = "item_id", item_text: str = "text", min_tile: int = MIN_TILE, threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows of ``docs`` that contain no benchmark item: a filter in the scan, without a shuffle; each row is judged by itself."""
    out = docs
    for seeds in _blocks(benchmark, item_col, item_text, min_tile, block_bytes):
        out = out.mapInArrow(lean(_clean(seeds, text, threshold)), docs.schema)
    return out


def _clean(seeds, text: str, threshold: float):
    def run(rows):
        s = seeds.value
        for whole in rows:
            for batch in batches(whole, text):
                words, begin = token_hashes(batch.column(text))
                keep = [next(s.matches(words[begin[k] : begin[k + 1]], threshold), None) is None for k in range(batch.num_rows)]
                yield batch.filter(pa.array(keep, pa.bool_()))

    return run
