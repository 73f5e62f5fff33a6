"""Merkle manifest of a dataset in higher-order SQL blocks.

Rows become leaves, hashed once. The leaves of a group are numbered in order and cut into fixed-size blocks of ``FANOUT ** LEVELS`` leaves; a
block is one ordered array, whose levels collapse inside one row by ``sequence``, ``transform``, ``slice`` and ``array_join``. Block roots are numbered
nodes like leaves, so the same step recurses over them until each group has one root, and once more over the groups' roots.

On the way down each block carries its path: for each level above it, the siblings left and right of it. A leaf's proof and its
recomputed root are made from its block's arrays and that path; nothing is looked up leaf by leaf.

No group is gathered: numbering is by a range partitioning with counts per partition, and a block holds at most 4,096 leaves, so
a group with a third of all rows is as many blocks as any others of that size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import evaluated
from .scratch import drop, shuffle_partitions, written

#: Consecutive nodes that become one, and levels inside a block.
FANOUT, LEVELS = 16, 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Rows of a table that is broadcast, at most: they hold two numbers and a group's name, or a path of some 5 KB.
BROADCAST_ROWS, BROADCAST_PATHS = 50_000, 2_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def field(value: Column) -> Column:
    """``-`` if null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def _small(df: DataFrame, most: int) -> DataFrame:
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows``, a written table, with ``at``: a row's place in its group, from 0. Sorted in parallel: a range partitioning, and counts per partition and group.

    ``order`` should part equal rows too, so that many of them do not meet in one task.
    """
    spark = rows.sparkSession
    dealt = rows.repartitionByRange(shuffle_partitions(spark), group, *order).sortWithinPartitions(group, *order)
    dealt = dealt.withColumn("part_", F.spark_partition_id()).withColumn("row_no_", F.monotonically_increasing_id() - F.shiftleft(F.col("part_").cast("long"), 33))
    dealt = written(dealt, "sorted")
    counts = dealt.groupBy(group, "part_").agg(F.min("row_no_").alias("first_"), F.count(F.lit(1)).alias("n_"))
    # one row per partition of a group: what comes before it in the group
    before = F.sum("n_").over(_window(group)) - F.col("n_")
    starts = counts.select(F.col(group).alias("group_"), F.col("part_").alias("p_"), (before - F.col("first_")).alias("shift_"))
    out = dealt.join(_small(starts, BROADCAST_ROWS), (F.col(group) == F.col("group_")) & (F.col("part_") == F.col("p_")))
    out = out.withColumn("at", F.col("row_no_") + F.col("shift_")).drop("group_", "p_", "shift_", "part_", "row_no_")
    out.scratch_tables = [dealt]
    return out


def _window(group: str):
    from pyspark.sql import Window

    return Window.partitionBy(group).orderBy("part_").rowsBetween(Window.unboundedPreceding, 0)


def _collapsed(nodes: Column) -> Column:
    """The next level of an array of digests: each run of ``FANOUT`` becomes its hash."""
    runs = F.sequence(F.lit(0), F.ceil(F.size(nodes) / FANOUT).cast("int") - 1)
    return F.transform(runs, lambda i: F.sha2(F.array_join(F.slice(nodes, i * FANOUT + 1, FANOUT), ""), 256))


def _beside(nodes: Column, i: Column) -> Column:
    """(l, r): the siblings of node ``i`` in its run, to its left and to its right, each as one text."""
    first = F.floor(i / FANOUT).cast("int") * FANOUT
    left, right = F.slice(nodes, first + 1, i - first), F.slice(nodes, i + 2, F.lit(FANOUT - 1) - (i - first))
    return F.struct(F.array_join(left, "").alias("l"), F.array_join(right, "").alias("r"))


def _blocks(nodes: DataFrame, keep: list[str]) -> DataFrame:
    """Blocks (group, block, last, nodes, v0..v3, depth, top) of numbered nodes (group, at, node, *keep).

    ``nodes`` is the ordered array of (at, node, *keep), ``v0`` to ``v3`` the levels, ``depth`` the number of them that are collapsed: all in a group of several blocks, else until one node is left.
    """
    size = FANOUT**LEVELS
    sizes = nodes.groupBy("group").agg(F.max("at").alias("last"))
    rows = nodes.groupBy("group", F.floor(F.col("at") / size).alias("block")).agg(F.array_sort(F.collect_list(F.struct((F.col("at") % size).cast("int").alias("i"), "node", *keep))).alias("nodes"))
    rows = rows.join(_small(sizes.withColumnRenamed("group", "g_"), BROADCAST_ROWS), F.col("group") == F.col("g_")).drop("g_")
    rows = evaluated(rows, {"v0": F.col("nodes.node")})
    for k in range(1, LEVELS + 1):
        rows = evaluated(rows, {f"v{k}": _collapsed(F.col(f"v{k - 1}"))})
    one = [F.when((F.col("last") < size) & (F.size(f"v{k}") == 1), k) for k in range(LEVELS)]
    rows = rows.withColumn("depth", F.coalesce(*one, F.lit(LEVELS)))
    return rows.withColumn("top", F.element_at(F.get(F.array(*[f"v{k}" for k in range(LEVELS + 1)]), F.col("depth")), 1))


def _path(i: Column) -> Column:
    """Siblings of node ``i`` of a block at each of its levels, from below."""
    levels = F.array(*[_beside(F.col(f"v{k}"), F.floor(i / FANOUT**k).cast("int")) for k in range(LEVELS)])
    return F.slice(levels, F.lit(1), F.col("depth"))


def _climbed(nodes: DataFrame) -> DataFrame:
    """(group, at, path, root) of numbered nodes (group, at, node): siblings at each level from below to the group's root."""
    blocks = written(_blocks(nodes, []), "blocks")
    ups = _above(blocks)
    out = _joined(blocks, ups).select("group", F.inline(F.transform("nodes", lambda x: F.struct((F.col("block") * FANOUT**LEVELS + x["i"]).alias("at"), F.concat(_path(x["i"]), F.col("up")).alias("path"), F.col("root").alias("root")))))
    out = written(out, "paths")
    drop(blocks, *ups.scratch_tables)
    return out


def _above(blocks: DataFrame) -> DataFrame:
    """(g_, b_, up, root) for each block: its path above, by recursion over block roots where a group has several."""
    size = FANOUT**LEVELS
    none = F.expr("cast(array() as array<struct<l:string,r:string>>)")
    alone = blocks.where(F.col("last") < size).select(F.col("group").alias("g_"), F.col("block").alias("b_"), none.alias("up"), F.col("top").alias("root"))
    several = blocks.where(F.col("last") >= size).select("group", F.col("block").alias("at"), F.col("top").alias("node"))
    if several.limit(1).count() == 0:
        alone.scratch_tables = []
        return alone
    higher = _climbed(several)
    out = alone.unionByName(higher.select(F.col("group").alias("g_"), F.col("at").alias("b_"), F.col("path").alias("up"), "root"))
    out.scratch_tables = [higher]
    return out


def _joined(blocks: DataFrame, ups: DataFrame) -> DataFrame:
    return blocks.join(_small(ups, BROADCAST_PATHS), (F.col("group") == F.col("g_")) & (F.col("block") == F.col("b_"))).drop("g_", "b_")


def manifest(docs: DataFrame, id_col: str = "doc_id", group_col: str = "source", fields: tuple[str, ...] = FIELDS, altered: dict[str, Column] | None = None, where: Column | None = None) -> DataFrame:
    """One row per row of ``docs``: id, leaf, subroot (of its group), root, proof_sha256, folded_root, verified.

    A leaf hashes ``fields``. ``altered`` gives other values of some fields, as they are found at verification (of rows of ``where``, or of all); the root is recomputed from the leaf of
    these and the siblings of the untouched tree, and ``verified`` says whether it is the same. Leaves ascend by id (null ids first); rows with the
    same id stand in the order of their leaves, so that equal rows have the same leaf and each its own place and proof. The null group is one like any
    other and comes first. Null and empty values differ. Texts of any length are hashed whole. An empty table gives an empty result. Other columns
    of ``docs``, whatever their names, do not matter.
    """
    given = [F.col(f"`{c}`") for c in dict.fromkeys((id_col, group_col, *fields))]
    leaf = F.sha2(F.concat(*[field(F.col(f"`{c}`")) for c in fields]), 256)
    found = F.sha2(F.concat(*[field((altered or {}).get(c, F.col(f"`{c}`"))) for c in fields]), 256) if altered else leaf
    found = found if where is None else F.when(where, found)
    group = F.when(F.col(f"`{group_col}`").isNull(), "").otherwise(F.concat(F.lit("="), F.col(f"`{group_col}`").cast("string")))
    leaves = docs.select(*given).select(F.col(f"`{id_col}`").alias("id_"), group.alias("group"), leaf.alias("node"), found.alias("found"), F.monotonically_increasing_id().alias("tie"))
    leaves = written(leaves.withColumn("found", F.when(F.col("found") != F.col("node"), F.col("found"))), "leaves")
    placed = numbered(leaves, "group", ["id_", "node", "tie"])
    blocks = written(_blocks(placed.select("group", "at", "node", "id_", "found"), ["id_", "found"]), "leaf-blocks")
    drop(leaves, *placed.scratch_tables)
    # from blocks to the groups' roots
    ups = written(_above(blocks), "block-paths")
    subroots = written(ups.groupBy(F.col("g_").alias("name")).agg(F.min("root").alias("node")).withColumn("group", F.lit("")), "subroots")
    ordered = numbered(subroots, "group", ["name"])
    tops = written(ordered.select("group", "at", "node", "name"), "ordered-subroots")
    climbed = _climbed(tops.select("group", "at", "node"))
    last = tops.join(_small(climbed.select("at", "path", F.col("root").alias("whole")), BROADCAST_PATHS), "at").select(F.col("name").alias("n_"), "path", "whole")
    ups = ups.join(_small(last, BROADCAST_PATHS), F.col("g_") == F.col("n_")).select("g_", "b_", "root", "whole", F.concat("up", "path").alias("up"))
    whole = _joined(blocks, ups)
    step = lambda node, x: F.sha2(F.concat(x["l"], node, x["r"]), 256)

    def proved(x: Column) -> Column:
        path = F.concat(_path(x["i"]), F.col("up"))
        both = F.transform(F.array(path), lambda p: F.struct(  # bound once
            F.sha2(F.array_join(F.transform(p, lambda s: F.concat(s["l"], s["r"])), ""), 256).alias("proof"), F.aggregate(p, F.coalesce(x["found"], x["node"]), step).alias("folded"),
        ))
        return F.struct(x["id_"].alias(id_col), x["node"].alias("leaf"), both[0].alias("p"))

    out = whole.select(F.col("root").alias("subroot"), F.col("whole").alias("root"), F.inline(F.transform("nodes", proved)))
    out = out.select(F.col(f"`{id_col}`"), "leaf", "subroot", "root", F.col("p.proof").alias("proof_sha256"), F.col("p.folded").alias("folded_root"), (F.col("p.folded") == F.col("root")).alias("verified"))
    return out


def lower_ascii(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)
