"""Documents to lines, sections, parent chunks and overlapping child windows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# Sizes in tokens.
PARENT_TOKENS, CHILD_TOKENS, CHILD_STEP = 512, 128, 96
#: A repeated edge line occurs on at least this many pages and this share of them.
LEAST_REPEATS, REPEAT_SHARE = 3, 0.20


def child_windows(parents: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = CHILD_TOKENS, step: int = CHILD_STEP) -> DataFrame:
    """(id, window, start, n_tokens, chunk): windows of ``size`` tokens every ``step`` tokens; none for texts without tokens."""
    t = parents.select(id_col, T.space_tokens(F.coalesce(text, F.lit(""))).alias("t")).where(F.size("t") > 0)
    w = t.select(id_col, "t", F.posexplode(F.sequence(F.lit(0), F.size("t") - 1, F.lit(step))).alias("window", "start"))
    part = F.slice("t", F.col("start") + 1, size)
    return w.select(id_col, "window", "start", F.size(part).alias("n_tokens"), F.array_join(part, "").alias("chunk"))


def _numbered(state_of) -> Column:
    """A function of two arrays of one row each, item by item: numbers that rise by one where ``state_of`` begins anew. Linear in the items."""
    @F.pandas_udf("array<int>")
    def number(first: pd.Series, second: pd.Series) -> pd.Series:
        out = []
        for one, two in zip(first, second, strict=True):
            begins, groups, group = state_of(), [], 0
            for x, y in zip(one, two, strict=True):
                group += begins(x, y)
                groups.append(group)
            out.append(groups)
        return pd.Series(out)

    return number


def pack_groups(sizes: Column, breaks: Column, limit: int = PARENT_TOKENS) -> Column:
    """Group number of each item of two arrays: an item joins the open group if their sizes stay within ``limit`` and it does not break.

    An item that is larger than the limit is a group of its own. What is kept is the state of one document only.
    """

    def state_of():
        used = 0

        def begins(size, breaks_):
            nonlocal used
            new = bool(breaks_) or used + size > limit
            used = size if new else used + size
            return int(new)

        return begins

    return _numbered(state_of)(sizes, breaks)


def parent_pack(items: DataFrame, doc: str, order: str, text: str, section: str, limit: int = PARENT_TOKENS) -> DataFrame:
    """(doc, parent, section, n_items, n_tokens, content) from ordered items; a new section begins a new parent. Items without text are left out.

    A document's items are gathered in one row; they are its own parts, so the row is as large as the document.
    """
    kept = items.where(F.coalesce(F.col(text), F.lit("")) != "")
    row = F.struct(F.col(order).alias("o"), F.col(section).alias("sec"), F.col(text).alias("t"), F.size(T.space_tokens(F.col(text))).alias("n"))
    docs = kept.groupBy(doc).agg(F.array_sort(F.collect_list(row)).alias("items"))
    docs = docs.withColumn("breaks", F.transform("items", lambda x, i: (i == 0) | ~x["sec"].eqNullSafe(F.get("items", i - 1)["sec"])))
    docs = docs.withColumn("groups", pack_groups(F.transform("items", lambda x: x["n"]), F.col("breaks"), limit))
    flat = docs.select(doc, F.posexplode(F.arrays_zip(F.col("groups").alias("g"), F.col("items").alias("x"))).alias("pos", "z"))
    out = flat.groupBy(doc, F.col("z.g").alias("parent")).agg(
        F.first("z.x.sec").alias("section"), F.count(F.lit(1)).alias("n_items"), F.sum("z.x.n").alias("n_tokens"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.col("z.x.t").alias("t")))), lambda r: r["t"]), "\n").alias("content"),
    )
    return out


def text_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, line_no, n_lines, line)."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    return docs.select(id_col, F.size(lines).alias("n_lines"), F.posexplode(lines).alias("line_no", "line"))


def edge_line_repeats(pages: DataFrame, file: str = "source", page: str = "doc_id", text: str = "text") -> DataFrame:
    """(file, edge, signature, n_pages, total_pages): first and last lines that a file repeats on enough of its pages."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    edges = pages.select(file, page, F.explode(F.array(F.struct(F.lit("header").alias("edge"), F.element_at(lines, 1).alias("line")), F.struct(F.lit("footer").alias("edge"), F.element_at(lines, -1).alias("line")))).alias("x"))
    edges = edges.select(file, page, "x.edge", T.line_signature(F.col("x.line")).alias("signature"), T.preserved_line(F.col("x.line")).alias("keep")).where("not keep and signature <> ''")
    counts = edges.groupBy(file, "edge", "signature").agg(F.count_distinct(page).alias("n_pages"))
    totals = pages.groupBy(file).agg(F.count_distinct(page).alias("total_pages"))
    least = F.greatest(F.lit(LEAST_REPEATS), F.bround(F.col("total_pages") * REPEAT_SHARE))
    return counts.join(totals, file).where(F.col("n_pages") >= least)


def sections(docs: DataFrame, id_col: str = "doc_id", text: str = "text", heading=T.is_heading) -> DataFrame:
    """(id, line_no, line, section): lines that are no heading, each with the last heading before it (null before the first), repeats within a section once."""
    lines = text_lines(docs, id_col, text).where(F.trim("line") != "")
    head = F.when(heading(F.col("line")), F.trim("line"))
    order = Window.partitionBy(id_col).orderBy("line_no")
    filled = lines.withColumn("head", head).withColumn("section", F.last("head", ignorenulls=True).over(order)).where("head is null")
    return filled.groupBy(id_col, "section", "line").agg(F.min("line_no").alias("line_no")).select(id_col, "line_no", "line", "section")


def table_records(found: DataFrame, doc: str, order: str, rows: str) -> DataFrame:
    """(doc, order, table_index, content_type, text) of the valid ones among found tables; the index runs through a document, and a table that is found twice counts once."""
    clean = T.evaluated(found.select(doc, order, rows), {"cells_": T.clean_cells(F.col(rows))})
    kept = T.evaluated(clean.where(T.valid_table(F.col("cells_"))), {"text": T.table_text(F.col("cells_"))})
    first = kept.groupBy(doc, "text").agg(F.min(order).alias(order))
    number = F.row_number().over(Window.partitionBy(doc).orderBy(order, "text"))
    return first.select(doc, order, number.alias("table_index"), F.lit("table").alias("content_type"), "text")


def group_lines(words: DataFrame, page: str, tolerance: float = 3.0) -> DataFrame:
    """(page, line, n_words, content) from words (page, top, x, word): a word joins the line while its top is near that of the line's first word."""
    row = F.struct(F.col("top"), F.col("x"), F.col("word"))
    pages = words.groupBy(page).agg(F.array_sort(F.collect_list(row)).alias("w"))

    def state_of():
        top = None

        def begins(at, _):
            nonlocal top
            if top is not None and abs(at - top) <= tolerance:
                return 0
            top = at
            return 1

        return begins

    tops = F.transform("w", lambda w: w["top"].cast("double"))
    flat = pages.select(page, F.explode(F.arrays_zip(_numbered(state_of)(tops, tops).alias("line"), F.col("w").alias("w"))).alias("z"))
    lined = flat.groupBy(page, F.col("z.line").alias("line")).agg(F.count(F.lit(1)).alias("n_words"), F.array_sort(F.collect_list(F.struct(F.col("z.w.x").alias("x"), F.col("z.w.word").alias("t")))).alias("ws"))
    return lined.select(page, "line", "n_words", F.array_join(F.transform("ws", lambda r: r["t"]), " ").alias("content"))


def outside_boxes(points: DataFrame, boxes: DataFrame, page: str) -> DataFrame:
    """Points (page, x, y) that lie in no box (page, x0, y0, x1, y1): a range anti-join within a page. Points without a place lie in none.

    A box stands in the cells, four at most, of a grid as coarse as the box is large; a point looks in one cell of each grid that has boxes. So
    points meet boxes of their own cell only, and a page with very many of both is as many keys as it has cells.
    """
    side = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.lit(1.0))
    grid = F.ceil(F.log2(side)).cast("int")
    cell = lambda c, g: F.floor(c / F.pow(F.lit(2.0), g)).cast("long")
    known = boxes.where("x0 <= x1 and y0 <= y1").select(F.col(page).alias("p_"), "x0", "y0", "x1", "y1", grid.alias("g_"))
    grids = [r.g_ for r in known.select("g_").distinct().collect()]  # one for each power of two between the smallest and the largest box
    if not grids:
        return points
    placed = known.select("*", F.explode(F.sequence(cell(F.col("x0"), F.col("g_")), cell(F.col("x1"), F.col("g_")))).alias("cx_")).select("*", F.explode(F.sequence(cell(F.col("y0"), F.col("g_")), cell(F.col("y1"), F.col("g_")))).alias("cy_"))
    asked = points.select(F.col(page).alias("q_"), F.col("x").alias("x_"), F.col("y").alias("y_")).distinct().select("*", F.explode(F.array(*[F.lit(g) for g in sorted(grids)])).alias("h_"))
    asked = asked.select("q_", "x_", "y_", "h_", cell(F.col("x_"), F.col("h_")).alias("dx_"), cell(F.col("y_"), F.col("h_")).alias("dy_"))
    same = [F.col("q_") == F.col("p_"), F.col("h_") == F.col("g_"), F.col("dx_") == F.col("cx_"), F.col("dy_") == F.col("cy_")]
    inside = asked.join(placed, [*same, F.col("x_").between(F.col("x0"), F.col("x1")), F.col("y_").between(F.col("y0"), F.col("y1"))], "left_semi").select("q_", "x_", "y_").distinct()
    return points.join(inside, [points[page] == inside["q_"], points["x"] == inside["x_"], points["y"] == inside["y_"]], "left_anti")


def page_regions(lines: DataFrame, pages: DataFrame, file: str = "file", page: str = "page", edge: float = 0.10, least_height: float = 0.70, parts: int | None = None) -> DataFrame:
    """(file, page, top, bottom): what is left of each page without repeated headers and footers.

    ``lines`` has (file, page, y0, y1, text), ``pages`` (file, page, height). Lines within ``edge`` of the height from the top or
    bottom are candidates; those whose signature enough pages of the file repeat are cut off with a margin of 2, unless
    less than ``least_height`` of the page would be left. Edge lines are dealt to ``parts`` partitions where given, else to as many as the session says.
    """
    deal = lambda df, *keys: df.repartition(parts, *keys) if parts else df
    both = lines.join(pages, [file, page])
    kind = F.when(F.col("y1") <= F.col("height") * edge, "header").when(F.col("y0") >= F.col("height") * (1 - edge), "footer")
    marked = T.evaluated(both, {"edge": kind, "signature": T.line_signature(F.col("text"))}).where(F.col("edge").isNotNull() & ~T.preserved_line(F.col("text")))
    counts = marked.groupBy(file, "edge", "signature").agg(F.count_distinct(page).alias("n"))
    totals = pages.groupBy(file).agg(F.count_distinct(page).alias("total"))
    repeated = counts.join(totals, file).where(F.col("n") >= F.greatest(F.lit(LEAST_REPEATS), F.bround(F.col("total") * REPEAT_SHARE))).select(file, "edge", "signature")
    found = deal(marked.select(file, page, "edge", "signature", "y0", "y1"), file, "edge", "signature").join(repeated, [file, "edge", "signature"], "left_semi")
    cut = deal(found.select(file, page, "edge", "y0", "y1"), file, page).groupBy(file, page)
    cut = cut.agg((F.max(F.when(F.col("edge") == "header", F.col("y1"))) + 2).alias("t"), (F.min(F.when(F.col("edge") == "footer", F.col("y0"))) - 2).alias("b"))
    out = pages.join(cut, [file, page], "left").withColumns({"t": F.coalesce("t", F.lit(0.0)), "b": F.coalesce("b", F.col("height").cast("double"))})
    kept = (F.col("b") - F.col("t")) >= F.col("height") * least_height
    return out.select(file, page, F.when(kept, F.col("t")).otherwise(0.0).alias("top"), F.when(kept, F.col("b")).otherwise(F.col("height").cast("double")).alias("bottom"))
