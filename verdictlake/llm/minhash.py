"""Near-duplicate detection by b-bit MinHash.

Each distinct shingle set keeps the low 8 bits of 252 minima, packed into one signature; 36
bands of 7 fields give the candidate groups (the 56 bits of a band are the key itself), and
similarities are estimated by counting equal fields, corrected for chance agreement. Links
are confirmed on the full shingle sets. A pair at the threshold of 0.85 meets in no band
with a chance of 9e-7; the estimate's cut lies five standard errors below the threshold.

No table of pairs grows faster than the number of classes and members:
1. documents with equal sets collapse into one class;
2. each band group is led by the member whose groups are largest in total, which in a crowd of
   copies is the text they were copied from; each class is compared with one lead, the best of
   those of its groups, and confirmed links merge into components, which settles nearly all groups;
3. groups that still span components are compared inside tasks. A first pass over packed signatures
   names the members that may be linked with another component, a second one fetches their texts
   once per group, confirms on full sets and unites while it compares, so that a task emits fewer
   links than it has members. Large groups become blocks of ``BLOCK`` members or
   ``BLOCK_SHINGLES``, and each pair of blocks that can hold a link is a group of its own: members
   of the group's largest component meet the others only. What a group ships is its largest
   component once per block of the others, and the others once per block of all; what a task
   holds is two blocks. Comparisons inside tasks remain quadratic in the unlinked part of a group.
Components come from distributed label propagation with pointer jumping; nothing about
documents is collected to the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import drop, shuffle_partitions, written
from .textops import batches, lean, mix, shingle_set, utf8, word_hashes

ROWS, BANDS, BITS = 7, 36, 8
FIELDS = ROWS * BANDS
#: Members, and shingles in all, of a block in the comparison of groups that still span components.
BLOCK, BLOCK_SHINGLES = 1000, 2_000_000
_A = (mix(np.arange(1, FIELDS + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_B = (mix(np.arange(1001, FIELDS + 1001, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def signature(shingles: np.ndarray) -> np.ndarray:
    """Low 8 bits of the minima of 252 hash functions, as bytes."""
    least = np.full(FIELDS, 0xFFFFFFFF, np.uint32)
    small = (shingles >> np.uint64(32)).astype(np.uint32) ^ shingles.astype(np.uint32)
    for at in range(0, len(small), 2048):
        np.minimum(least, (small[at : at + 2048, None] * _A + _B).min(axis=0), out=least)
    least ^= least >> np.uint32(16)
    least *= np.uint32(0x7FEB352D)
    least ^= least >> np.uint32(15)
    return least.astype(np.uint8)


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """64-bit keys per signature: the band's number and its seven bytes."""
    n = len(signatures)
    keys = np.zeros((n, BANDS, 8), np.uint8)
    keys[:, :, :ROWS] = signatures.reshape(n, BANDS, ROWS)
    keys[:, :, 7] = np.arange(BANDS)
    return keys.reshape(n, -1).view("<i8")


def estimate(equal: np.ndarray) -> np.ndarray:
    """Similarity from the number of equal fields, corrected for fields equal by chance."""
    chance = 1 / (1 << BITS)
    return (equal / FIELDS - chance) / (1 - chance)


def cut_for(threshold: float) -> float:
    """Five standard errors below the threshold."""
    return threshold - 5 * (threshold * (1 - threshold) / FIELDS) ** 0.5


def _sets(batch: pa.RecordBatch, column: str, width: int):
    data, offsets = utf8(batch.column(column))
    words, begin = word_hashes(data, offsets)
    for k in range(batch.num_rows):
        yield shingle_set(words[begin[k] : begin[k + 1]], width)


def _describe(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n_shingles, k1, k2, sig): size, 128-bit identity and signature of each row's set."""

    def run(rows):
        for whole in rows:
            for batch in batches(whole, "text"):
                n, one, two, sigs = [], [], [], []
                for s in _sets(batch, "text", width):
                    n.append(len(s))
                    one.append(int(s.sum(dtype=np.uint64).astype(np.int64)))
                    two.append(int(mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64).astype(np.int64)))
                    sigs.append(signature(s).tobytes() if len(s) else None)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(sigs, pa.binary())], ["doc_id", "n_shingles", "k1", "k2", "sig"])

    return docs.mapInArrow(lean(run), "doc_id long, n_shingles long, k1 long, k2 long, sig binary")


def _bands(classes: DataFrame) -> DataFrame:
    def run(rows):
        for batch in rows:
            for part in (batch.slice(at, 2048) for at in range(0, batch.num_rows, 2048)):
                sigs = np.frombuffer(b"".join(part.column("sig").to_pylist()), np.uint8).reshape(part.num_rows, FIELDS)
                keys = band_keys(sigs)
                ids = np.repeat(part.column("c").to_numpy(), BANDS)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(ids)], ["key", "c"])

    return classes.select("c", "sig").mapInArrow(lean(run), "key long, c long")


def _estimated(pairs: DataFrame, classes: DataFrame, cut: float) -> DataFrame:
    """Pairs (a, b) whose signatures agree enough."""
    s = classes.select("c", "sig")
    both = pairs.join(s.withColumnRenamed("c", "a").withColumnRenamed("sig", "sa"), "a").join(s.withColumnRenamed("c", "b").withColumnRenamed("sig", "sb"), "b")

    def run(rows):
        for batch in rows:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, FIELDS) for k in ("sa", "sb"))
                yield batch.select(["a", "b"]).filter(pa.array(estimate((x == y).sum(axis=1)) >= cut))

    return both.mapInArrow(lean(run), "a long, b long")


def _confirmed(pairs: DataFrame, docs: DataFrame, per_cent: int, width: int) -> DataFrame:
    """Pairs whose full shingle sets are similar enough; texts come from one row of each class."""
    texts = docs.where(F.col("doc_id").isNotNull())
    both = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a")
    both = both.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b")

    def run(rows):
        for whole in rows:
            for batch in batches(whole, "ta", 1 << 20):
                keep, last, x = [], None, None
                a = batch.column("a").to_pylist()
                for k, (s, text) in enumerate(zip(a, batch.column("ta"), strict=True)):
                    if s != last:
                        one = pa.RecordBatch.from_arrays([pa.array([text.as_py()], pa.string())], ["t"])
                        x, last = next(_sets(one, "t", width)), s
                    y = next(_sets(batch.slice(k, 1), "tb", width))
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(100 * common >= per_cent * (len(x) + len(y) - common))
                yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "ta", "tb").mapInArrow(lean(run), "a long, b long").distinct()


def _dealt(members: DataFrame) -> DataFrame:
    """Members (key, c, comp, n, sig) of groups that span components, dealt to pairs of blocks (i, j).

    The group's largest component is dealt into blocks of its own, which meet the other blocks but not each other.
    """
    held = members.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("size"))
    split = lambda m, size: F.ceil(F.greatest(m / F.lit(BLOCK), size / F.lit(BLOCK_SHINGLES))).cast("int")
    top = F.max(F.struct("m", "size", (-F.col("comp")).alias("c")))
    sides = held.groupBy("key").agg(top.alias("top"), F.sum("m").alias("m"), F.sum("size").alias("size"))
    sides = sides.select("key", (-F.col("top.c")).alias("most"), split(F.col("m") - F.col("top.m"), F.col("size") - F.col("top.size")).alias("rest"), split(F.col("top.m"), F.col("top.size")).alias("main"))
    known = members.join(sides, "key")
    lot, inside = F.xxhash64("c", "key"), F.col("comp") == F.col("most")
    known = known.withColumn("own", F.when(inside, F.col("rest") + F.pmod(lot, F.col("main"))).otherwise(F.pmod(lot, F.col("rest"))).cast("int"))
    last = F.when(inside, F.col("rest")).otherwise(F.col("rest") + F.col("main")) - 1
    known = known.select("key", "c", "comp", "n", "sig", "own", F.explode(F.sequence(F.lit(0), last)).alias("other"))
    return known.select("key", "c", "comp", "n", "sig", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))


def _runs(rows):
    """Tables of consecutive rows that agree in key, i and j."""
    held: list[pa.RecordBatch] = []
    for batch in rows:
        if not batch.num_rows:
            continue
        marks = np.stack([batch.column(k).to_numpy() for k in ("key", "i", "j")])
        cuts = np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
            if held and any(held[-1].column(k)[-1].as_py() != batch.column(k)[a].as_py() for k in ("key", "i", "j")):
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _candidates(group: pa.Table, cut: float, per_cent: int):
    """(k, places, estimates): members of other components that member k may be linked with, each pair once."""
    n = group.num_rows
    comp, own, size = (group.column(k).to_numpy() for k in ("comp", "own", "n"))
    sigs = np.frombuffer(b"".join(group.column("sig").to_pylist()), np.uint8).reshape(n, FIELDS)
    bands, band = sigs.reshape(n, BANDS, ROWS), int(group.column("key")[0].as_py()) >> 56 & 0xFF
    across = group.column("i")[0].as_py() != group.column("j")[0].as_py()
    _, number, counts = np.unique(comp, return_inverse=True, return_counts=True)
    order = np.lexsort((number, counts[number]))  # the largest component comes last and is only met
    for place in range(n - int(counts.max())):
        k, rest = order[place], order[place + 1 :]
        ok = comp[rest] != comp[k]
        if across:
            ok &= own[rest] != own[k]
        ok &= 100 * np.minimum(size[rest], size[k]) >= per_cent * np.maximum(size[rest], size[k])
        at = rest[ok]
        if len(at):
            likeness = estimate((sigs[at] == sigs[k]).sum(axis=1))
            near = likeness >= cut
            at, likeness = at[near], likeness[near]
        if len(at) and band:  # pairs that meet in an earlier band are found there
            new = ~(bands[at][:, :band] == bands[k][:band]).all(axis=2).any(axis=1)
            at, likeness = at[new], likeness[new]
        if len(at):
            yield int(k), at, likeness


def _links_of(group: pa.Table, cut: float, per_cent: int, width: int) -> list[tuple[int, int]]:
    """Links between components of a group, confirmed on full sets, none that earlier ones make needless."""
    pairs = [(-e, k, int(x)) for k, at, likeness in _candidates(group, cut, per_cent) for x, e in zip(at, likeness, strict=True)]
    c, comp, texts = group.column("c").to_pylist(), group.column("comp").to_pylist(), group.column("text")
    root, sets, out = {x: x for x in comp}, {}, []

    def top(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    def shingles(k):
        if k not in sets:
            one = pa.RecordBatch.from_arrays([pa.array([texts[k].as_py()], pa.string())], ["t"])
            sets[k] = next(_sets(one, "t", width))
        return sets[k]

    for _, k, x in sorted(pairs):
        a, b = top(comp[k]), top(comp[x])
        if a != b:
            one, two = shingles(k), shingles(x)
            common = len(np.intersect1d(one, two, assume_unique=True))
            if 100 * common >= per_cent * (len(one) + len(two) - common):
                root[a] = b
                out.append((min(c[k], c[x]), max(c[k], c[x])))
    return out


def _across(members: DataFrame, docs: DataFrame, cut: float, per_cent: int, width: int) -> DataFrame:
    """Links (a, b) between components inside groups; members: key, c, comp, n, sig."""
    parts = shuffle_partitions(members.sparkSession)

    def dealt(df: DataFrame) -> DataFrame:
        # a fixed number of partitions: the rows are few bytes but much work, and would be merged into a few tasks by size
        return df.repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j")

    def name(rows):
        for group in _runs(rows):
            found = sorted({int(x) for k, at, _ in _candidates(group, cut, per_cent) for x in (k, *at)})
            if found:
                yield from group.take(pa.array(found)).combine_chunks().to_batches()

    def link(rows):
        for group in _runs(rows):
            found = _links_of(group, cut, per_cent, width)
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["a", "b"])

    schema = "key long, c long, comp long, n long, sig binary, own int, i int, j int"
    named = written(dealt(_dealt(members)).mapInArrow(lean(name), schema), "named")
    texts = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("c"), "text")
    out = written(dealt(named.join(texts, "c").select(*named.columns, "text")).mapInArrow(lean(link), "a long, b long").distinct(), "links")
    drop(named)
    return out


def components(links: DataFrame) -> DataFrame:
    """(c, comp) for each end of a link: the smallest end that can be reached. Every round halves what is left of a chain."""
    edges = written(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), "edges")
    labels = written(edges.groupBy(F.col("a").alias("c")).agg(F.least(F.min("a"), F.min("b")).alias("comp")), "labels")
    while True:
        ends = edges.join(labels.select(F.col("c").alias("b"), "comp"), "b").groupBy(F.col("a").alias("c")).agg(F.min("comp").alias("near"))
        # what the old root learns from any of its members (a root's label is the least of them)
        hung = ends.join(labels, "c").select("c", "comp", F.least("comp", "near").alias("low"))
        roots = hung.groupBy("comp").agg(F.min("low").alias("root"))
        moved = hung.join(roots, "comp").select("c", F.least("low", "root").alias("next"), F.col("comp").alias("old"))
        jump = moved.join(labels.select(F.col("c").alias("next"), F.col("comp").alias("far")), "next", "left")
        new = written(jump.select("c", "old", F.least("next", F.coalesce("far", "next")).alias("comp")), "labels")
        changed = new.where("old <> comp").limit(1).count()
        drop(labels)
        labels = new
        if not changed:
            drop(edges)
            return labels.select("c", "comp")


def _labelled(classes: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return classes.withColumn("comp", F.col("c"))
    return classes.join(labels, "c", "left").withColumn("comp", F.coalesce("comp", "c"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", per_cent: int = 85, width: int = 5) -> DataFrame:
    """One row per input row: id, n_shingles, component_id, kept.

    Words are longest runs of characters other than [\\x20\\x09-\\x0D], with A-Z lower-cased; a set
    has the distinct shingles of ``width`` words, or the whole sequence if there are fewer words.
    Two documents are linked if 100 * |intersection| >= per_cent * |union|; empty ones (null or
    no words) are linked with nothing. component_id is the smallest id that can be reached. Rows
    that share an id count as one document. A null id gets a null component and is kept.
    """
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    rows = written(_describe(source, width), "signatures")
    sets = rows.where("n_shingles > 0 and doc_id is not null")
    cut = cut_for(per_cent / 100)
    # equal sets have equal signatures
    classes = written(sets.groupBy("k1", "k2", "n_shingles").agg(F.min("doc_id").alias("c"), F.min("sig").alias("sig")), "classes")
    bands = written(_bands(classes), "bands")
    groups = written(bands.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "groups")
    members = written(bands.join(groups, "key").select("key", "m", "c"), "members")
    drop(bands, groups)

    weights = written(members.groupBy("c").agg(F.sum("m").alias("w")), "weights")
    best = F.max(F.struct("w", (-F.col("c")).alias("c")))
    leads = written(members.join(weights, "c").groupBy("key").agg(best.alias("lead")), "leads")
    led = members.join(leads, "key").where(F.col("c") != -F.col("lead.c")).groupBy(F.col("c").alias("b")).agg((-F.max("lead")["c"]).alias("a"))
    links = written(_confirmed(_estimated(led, classes, cut), source, per_cent, width), "links")
    labels = components(links)
    known = _labelled(members.select("key", "c"), labels)
    open_groups = known.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
    left = known.join(open_groups, "key").join(classes.select("c", F.col("n_shingles").alias("n"), "sig"), "c").select("key", "c", "comp", "n", "sig")
    left = written(left, "open-groups")
    more = _across(left, source, cut, per_cent, width)
    labels = components(links.unionByName(more))

    named = _labelled(classes.select("k1", "k2", "n_shingles", "c"), labels).select("k1", "k2", "n_shingles", F.col("comp").alias("component_id"))
    known = rows.where("n_shingles > 0 and doc_id is not null").join(named, ["k1", "k2", "n_shingles"]).select("doc_id", "n_shingles", "component_id")
    alone = rows.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    kept = F.col("component_id").isNull() | F.col("doc_id").eqNullSafe(F.col("component_id"))
    out = written(known.unionByName(alone).select(F.col("doc_id").alias(id_col), "n_shingles", "component_id", kept.alias("kept")), "near-duplicates")
    drop(rows, classes, members, weights, leads, links, left, more, labels)
    return out
