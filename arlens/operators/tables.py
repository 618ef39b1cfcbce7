"""Numeric tables rebuilt from span geometry.

Everything is per page (a page holds at most one table).  The spans within the
numeric extent of a page meet in one task by one exchange; groups, grid, trim,
numeric test and markdown then come from one pass over them (``grid``), from
which cells, tables and markdown are read off.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arlens.functions.text import cell_text, is_number_row, is_number_table
from arlens.operators import grid

PAGE = ["report", "page_no"]
#: A page's key as rows are sorted by it: numbers compare faster than names.
SORTED = ["page_no", "report"]
# Fixed values of the extent rule: keep 6 spans before the first number and 4
# after the last; the first span of a page is never in a table.
BEFORE, AFTER = 6, 5
DIV_OPEN = '\n<div class="markdown-table">\n'
DIV_CLOSE = "\n</div>\n"


def numeric_cells(spans: DataFrame) -> DataFrame:
    """Per block, lines after the first whose plain text (`` text `` per
    span, then , and space removed) is a number (S2).  The spans of a block meet
    by one exchange, which serves lines, their order and the block."""
    lines = spans.select(*PAGE, "block_no", "line_no", "span_no", "text").repartition(*PAGE, "block_no").groupBy(*PAGE, "block_no", "line_no").agg(
        F.sort_array(F.collect_list(F.struct("span_no", "text"))).alias("_s")
    ).select(*PAGE, "block_no", "line_no",
             F.array_join(F.transform("_s", lambda x: F.concat(F.lit(" "), x["text"], F.lit(" "))), "").alias("plain"))
    first = Window.partitionBy(*PAGE, "block_no").orderBy("line_no")
    lines = lines.withColumn("_k", F.row_number().over(first))
    return lines.groupBy(*PAGE, "block_no").agg(
        F.count(F.lit(1)).cast("bigint").alias("n_cells"),
        F.count_if((F.col("_k") > 1) & is_number_row(F.col("plain"))).cast("bigint").alias("n_numeric"),
    )


def table_extent(spans: DataFrame) -> DataFrame:
    """Spans of a page in order (idx), restricted to
    [max(1, first-6), min(last+5, n)) around the first and last numeric span
    (S1); pages with fewer than 3 positions between them give no rows.  The
    spans of a page are in one partition, where they meet for the windows: spans
    that are dealt by page already, or by a ``sheet`` of whole pages, stay there."""
    w = Window.partitionBy(*_sorted(spans)).orderBy("block_no", "line_no", "span_no")
    wp = Window.partitionBy(*_sorted(spans))
    s = spans.withColumn("idx", (F.row_number().over(w) - 1).cast("bigint"))
    s = s.withColumn("_num", F.when(is_number_table(F.col("text")), F.col("idx")))
    s = s.withColumns({"_n": F.count(F.lit(1)).over(wp), "_f": F.min("_num").over(wp), "_l": F.max("_num").over(wp)})
    keep = (
        F.col("_f").isNotNull() & (F.col("_f") <= F.col("_l") - 2)
        & (F.col("idx") >= F.greatest(F.lit(1), F.col("_f") - BEFORE))
        & (F.col("idx") < F.least(F.col("_l") + AFTER, F.col("_n")))
    )
    return s.where(keep).drop("_num", "_n", "_f", "_l")


def _sorted(spans: DataFrame) -> list[str]:
    """A page's key, and the ``sheet`` that pages lie together by where there is one."""
    return SORTED + [c for c in ["sheet"] if c in spans.columns]


def _in_order(spans: DataFrame, *more) -> DataFrame:
    """The extent's spans, page by page in order, with what ``grid`` reads.  The
    order asked for is the one that the extent's windows leave, so it is not made
    again."""
    ext = table_extent(spans).sortWithinPartitions(*_sorted(spans), "block_no", "line_no", "span_no")
    return ext.select(*PAGE, "idx", "x0", "x1", "y0", "y1", *more)


def _key(spans: DataFrame) -> str:
    return ", ".join(f"{c} {spans.schema[c].dataType.simpleString()}" for c in PAGE)


def interval_cover(spans: DataFrame) -> DataFrame:
    """(report, page_no, axis, idx, cover) of the spans of each page's extent:
    how many spans that start no later (the span itself included) reach its
    start, on both axes."""
    return _in_order(spans).mapInArrow(grid.cover_batches, f"{_key(spans)}, axis string, idx long, cover long")


def interval_groups(spans: DataFrame) -> DataFrame:
    """(report, page_no, axis, coord, grp) of every start coordinate.

    Spans sorted by start; the cut is the first position p >= 2 whose cover is
    below the one before it (a drop at position 1 is ignored); from there on only
    spans from the cut on count; a new group starts where the count does not
    grow.  Several spans with the same start take the group of the last.
    """
    return _in_order(spans).mapInArrow(grid.group_batches, f"{_key(spans)}, axis string, coord double, grp long")


def page_tables(spans: DataFrame, with_cells: bool = False) -> DataFrame:
    """(report, page_no, cells, table), one row for each page with an extent.

    cells (G4/F8/G5/S7, on demand): the compacted grid.  A cell is the pair of
    axis groups of its span's start, the last span wins, '', ' ', '  ' are blank;
    blank columns, then blank rows are removed.  Blank cells stay with null text
    when their row and column survive.

    table (F7/E18/G7, null where there is no numeric one): rows [a, b) from the
    first to the last with content outside column 0, heading (column 0 of row
    a - 1; '' when a = 0, null when blank), block range, share of numbers (S1)
    outside column 0, and the markdown.
    """
    cell = cell_text(F.col("text"))
    rows = _in_order(spans, F.col("block_no").cast("bigint").alias("block_no"), cell.alias("cell"), is_number_table(cell).alias("number"))
    return rows.mapInArrow(partial(grid.table_batches, with_cells=with_cells),
                           f"{_key(spans)}, cells array<struct<row:bigint,col:bigint,text:string,block_no:bigint>>, "
                           "table struct<a:bigint,b:bigint,n_cols:bigint,heading:string,block_a:bigint,block_b:bigint,numeric_share:double,markdown:string>")


def table_cells(pages: DataFrame) -> DataFrame:
    """The grid cells of ``page_tables(..., with_cells=True)``, one a row."""
    return pages.select(*PAGE, F.inline("cells"))


def numeric_tables(pages: DataFrame) -> DataFrame:
    """The numeric tables of ``page_tables``, one a row."""
    return pages.where(F.col("table").isNotNull()).select(*PAGE, "table.*")


def number_tables(tables: DataFrame) -> DataFrame:
    """table number in the report (pages in order, from 0)."""
    w = Window.partitionBy("report").orderBy("page_no")
    return tables.withColumn("table_no", (F.row_number().over(w) - 1).cast("bigint"))


def table_html(numbered: DataFrame) -> DataFrame:
    """G8 text of a table: title ``Table i: heading``, then the markdown in a div."""
    title = F.concat(F.lit("\n<b>Table "), F.col("table_no").cast("string"), F.lit(": "),
                     F.coalesce(F.col("heading"), F.lit("None")), F.lit("</b>\n\n"))
    return numbered.select(*PAGE, "block_a", "block_b", F.concat(title, F.lit(DIV_OPEN), F.col("markdown"), F.lit(DIV_CLOSE)).alias("table_html"))


def insert_tables(blocks_html: DataFrame, tables_html: DataFrame, page_col: str = "page_no", sheet: list[str] | None = None) -> DataFrame:
    """G8 (Z8 fixed): on each page with a table, block a becomes the table and
    blocks a+1..b-1 are dropped (exclusive end kept; a = b replaces block a).

    ``sheet``: columns of both that whole pages lie together by; the tables are
    brought there then and the blocks stay."""
    t = tables_html.withColumnRenamed("page_no", page_col) if page_col not in tables_html.columns else tables_html
    if sheet is None:
        j = blocks_html.join(t, ["report", page_col], "left")
    else:
        held = t.groupBy(*[F.col(c).alias(f"_s_{c}") for c in sheet]).agg(F.collect_list(F.struct(F.col("report").alias("report"), F.col(page_col).alias("page"), "block_a", "block_b", "table_html")).alias("_t"))
        own = F.try_element_at(F.filter("_t", lambda x: (x["report"] == F.col("report")) & (x["page"] == F.col(page_col))), F.lit(1))
        j = blocks_html.join(held, [F.col(c) == F.col(f"_s_{c}") for c in sheet], "left").withColumn("_t", own).select("*", "_t.block_a", "_t.block_b", "_t.table_html")
    inside = (F.col("block_no") > F.col("block_a")) & (F.col("block_no") < F.col("block_b"))
    j = j.where(F.col("block_a").isNull() | ~inside)
    html = F.when(F.col("block_no") == F.col("block_a"), F.col("table_html")).otherwise(F.col("html"))
    return j.select(*[c for c in blocks_html.columns if c != "html"], html.alias("html"))
