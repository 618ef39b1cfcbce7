"""Page layout: landscape pages split into two portrait halves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAGE = ["report", "page_no"]


def page_of(page_key: Column) -> Column:
    """The page that a page key of ``page_split`` belongs to: its halves share it."""
    return F.shiftright(page_key, 1)


def with_boxes(spans: DataFrame) -> DataFrame:
    """Line and block horizontal extents; taken from the input when present,
    else the union of the spans (windows over one line / one block)."""
    out = spans
    if "line_x0" not in spans.columns:
        wl = Window.partitionBy("report", "page_no", "block_no", "line_no")
        out = out.withColumn("line_x0", F.min("x0").over(wl)).withColumn("line_x1", F.max("x1").over(wl))
    if "block_x0" not in spans.columns:
        wb = Window.partitionBy("report", "page_no", "block_no")
        out = out.withColumn("block_x0", F.min("x0").over(wb)).withColumn("block_x1", F.max("x1").over(wb))
    return out


def page_split(spans: DataFrame) -> DataFrame:
    """Split every unblocked landscape page (width >= height, Z18) at the midline.

    A page is blocked when some block, one of its lines and one of that line's
    spans all strictly cross the midline.  Blocks of a split page go to the
    left half unless the block starts at or right of the midline; right-half
    coordinates are shifted by width/2.  The new page order key is
    ``page_key = 2 * page_no + half``, so the left half comes first without
    renumbering the whole report.
    """
    s = with_boxes(spans)
    mid = F.col("page_w") / 2
    cross = (
        (F.col("block_x0") < mid) & (mid < F.col("block_x1"))
        & (F.col("line_x0") < mid) & (mid < F.col("line_x1"))
        & (F.col("x0") < mid) & (mid < F.col("x1"))
    )
    wp = Window.partitionBy(*reversed(PAGE))  # sorted by page first: numbers compare faster than names
    s = s.withColumn("blocked", F.max(cross.cast("int")).over(wp) == 1)
    split = (F.col("page_w") >= F.col("page_h")) & ~F.col("blocked")
    half = F.when(split & (F.col("block_x0") >= mid), 1).otherwise(0)
    s = s.withColumn("split", split).withColumn("half", half)
    shift = F.col("half") * (F.col("page_w") / 2)
    return s.select(
        *[c for c in spans.columns if c not in ("x0", "x1", "page_w")],
        (F.col("page_no") * 2 + F.col("half")).cast("bigint").alias("page_key"),
        F.when(F.col("split"), F.col("page_w") / 2).otherwise(F.col("page_w")).alias("page_w"),
        (F.col("x0") - shift).alias("x0"),
        (F.col("x1") - shift).alias("x1"),
        "split",
        "half",
    )
