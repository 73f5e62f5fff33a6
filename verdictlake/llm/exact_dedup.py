"""Exact de-duplication by deterministic block naming.

The normalised text is cut into fixed-size blocks. Distinct blocks are sorted and named by
integers; then adjacent names are paired, distinct pairs are sorted and named, and so on
until each document has one name. Names come from equality alone, so two documents have
the same (levels, name) exactly if their normalised texts are equal.

A block's text is shuffled once, after map-side de-duplication (a block that a third of all
rows share leaves each map task once). Names travel back by a fingerprint of the block, 64 bits
of one hash and 60 of SHA-256; whether two distinct blocks share one is checked, in that case all of
SHA-256 is added, and should even that not part them the operator raises an error, so a collision
cannot merge two texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import drop, written

#: White space that normalisation deletes: [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"
#: Bytes in a block.
BLOCK_BYTES = 4096


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"[{BLANKS}]+", "")


def fingerprint(block: Column) -> tuple[Column, Column]:
    """Two halves of a block's fingerprint from unrelated hashes: 64 bits of xxHash64, 60 bits of SHA-256."""
    return F.xxhash64(block), F.conv(F.left(F.sha2(block, 256), F.lit(15)), 16, 10).cast("long")


def _named(distinct: DataFrame, keys: list[str]) -> DataFrame:
    """``distinct`` with an integer name per row: its place in the sort order of its partition, which a re-run repeats."""
    return distinct.sortWithinPartitions(*keys).withColumn("name", F.monotonically_increasing_id())


def document_names(docs: DataFrame, text: str = "text", block_bytes: int = BLOCK_BYTES, fingerprint=fingerprint) -> DataFrame:
    """One row per row of ``docs``: its columns but the text, n_chars_ (code points), raw_hash_ (of the text as it is), text_sha256, level and name.

    Two rows agree in (level, name) exactly if their normalised texts are equal. A null text
    counts as empty; an empty table gives an empty result. Columns of ``docs`` are kept under
    a struct ``row_`` so that none can clash.
    """
    block = F.lit(block_bytes)
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text]).alias("row_"), F.col(f"`{text}`").alias("t_"))
    base = base.withColumn("norm_", normalised(F.col("t_"))).withColumn("bin_", F.col("norm_").cast("binary"))
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.octet_length("bin_") - 1) / block)).cast("int")), lambda i: F.substring(F.col("bin_"), i * block + 1, block))
    base = base.withColumn("blocks_", blocks)

    # names of distinct blocks
    one, two = fingerprint(F.col("block"))
    distinct = base.select(F.explode("blocks_").alias("block")).select(one.alias("h1"), two.alias("h2"), "block").distinct()
    names = _named(distinct, ["h1", "h2", "block"])

    def shared(keys: list[str]) -> bool:
        return names.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count() > 0

    plain = names
    names = written(plain.select("h1", "h2", "name"), "block-names")
    ambiguous = shared(["h1", "h2"])
    if ambiguous:  # distinct blocks with the same fingerprint: a third, longer one tells them apart
        drop(names)
        names = written(plain.select("h1", "h2", "name", F.sha2("block", 256).alias("sum")), "block-names")
        if shared(["h1", "h2", "sum"]):
            raise ValueError("distinct blocks share all fingerprints")

    # slim table of rows, each with the fingerprints of its blocks
    halves = F.transform("blocks_", lambda b: F.struct(fingerprint(b)[0].alias("h1"), fingerprint(b)[1].alias("h2"), *([F.sha2(b, 256).alias("sum")] if ambiguous else [])))
    slim = base.select("row_", F.coalesce(F.length("t_"), F.lit(0)).cast("long").alias("n_chars_"), F.xxhash64("t_").alias("raw_hash_"), F.sha2("bin_", 256).alias("text_sha256"), halves.alias("marks")).withColumn("rid", F.monotonically_increasing_id())
    slim = written(slim, "rows")
    current = slim.select("rid", F.size("marks").alias("n"), F.posexplode("marks").alias("pos", "m")).select("rid", "n", "pos", "m.*")
    on = ["h1", "h2", *(["sum"] if ambiguous else [])]
    current = current.join(names.select(*on, "name"), on).select("rid", "n", "pos", "name")
    level, done, spent = 0, None, [names]
    top = slim.agg(F.max(F.size("marks"))).first()[0] or 0
    current = written(current, "level-0")
    kept = [slim, current]
    while True:
        ended = current.where("n = 1").select("rid", F.lit(level).alias("level"), "name")
        done = ended if done is None else done.unionByName(ended)
        if top <= 1:
            break
        halved = F.floor(F.col("pos") / 2).cast("int")
        pairs = current.where("n > 1").groupBy("rid", F.ceil(F.col("n") / 2).cast("int").alias("n"), halved.alias("pos"))
        pairs = pairs.agg(F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b"))
        pairs = written(pairs, "pairs")
        passing = written(_named(pairs.select("a", "b").distinct(), ["a", "b"]), "pair-names")
        level, top = level + 1, (top + 1) // 2
        kept.append(current := written(pairs.join(passing, ["a", "b"]).select("rid", "n", "pos", "name"), f"level-{level}"))
        spent += [pairs, passing]
    out = slim.select("rid", "row_", "n_chars_", "raw_hash_", "text_sha256").join(done, "rid").drop("rid")
    drop(*spent)
    out.scratch_tables = kept  # for callers that are done with the result
    return out


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES, fingerprint=fingerprint) -> DataFrame:
    """Groups rows with equal normalised texts and picks the row that stays.

    Of equal texts the row with the most code points in the original text stays, then the
    smallest id (null ids come last). Result, one row per input row: the id, keep_id, group_size,
    kept, text_sha256, n_chars, raw_hash (xxHash64 of the text as it is). Null text counts as empty. Rows that repeat an id and a
    text are all reported; each of them is ``kept`` if its id is the kept one and it has as many
    code points. Other columns of the input, whatever their names, do not matter.
    """
    found = document_names(docs.select(F.col(f"`{id_col}`").alias("id_"), F.col(f"`{text}`").alias("t")), "t", block_bytes, fingerprint)
    named = written(found.select(F.col("row_.id_").alias("id_"), "n_chars_", "raw_hash_", "text_sha256", "level", "name"), "names")
    drop(*found.scratch_tables)
    best = F.min(F.struct((-F.col("n_chars_")).alias("c"), F.col("id_").isNull().alias("z"), F.col("id_").alias("i")))
    # written, so that the join's sides are plain exchanges and a hot name's rows can be split
    groups = written(named.groupBy("level", "name").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size")), "groups")
    kept = F.col("id_").eqNullSafe(F.col("best.i")) & (F.col("n_chars_") == -F.col("best.c"))
    out = named.join(groups, ["level", "name"]).select(
        F.col("id_").alias(id_col), F.col("best.i").alias("keep_id"), "group_size", kept.alias("kept"), "text_sha256", F.col("n_chars_").alias("n_chars"), F.col("raw_hash_").alias("raw_hash")
    )
    out = written(out, "exact-dedup")
    drop(named, groups)
    return out
