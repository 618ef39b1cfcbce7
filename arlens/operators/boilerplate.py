"""Repeated running headers and footers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arlens.functions.text import not_int, private_use_count, py_float_str, py_strip
from arlens.operators.sequence import in_page_sums, page_bases, running_sums

BLOCK = ["report", "page_key", "block_no"]
#: What a block row holds of each of its spans, in line and span order.
SPAN = ["line_no", "span_no", "text", "font", "size", "color", "x0", "y0", "x1", "y1"]
# Blocks of 1..5 lines are counted; a key seen more than 10 times is repeated.
MIN_LINES, MAX_LINES, REPEAT_LIMIT = 1, 5, 10


def blocks(spans: DataFrame) -> DataFrame:
    """One row per block: key (S6), line count, text length of ``getline`` (E10),
    plain length of ``analyze_block`` (F2: 1 + sum(len + 2)), private-use count (E11).

    S6: ``font + size + ':' + text`` of every span whose stripped text is
    non-empty and not an integer, in line/span order, joined by ``;``.

    The row holds the block's spans too (``spans``, see ``SPAN``), so that later
    steps read them without meeting again.  ``page_no`` is among the keys, as
    ``page_key`` follows from it: spans that the page split has brought together
    stay where they are, and rows stored by it stay there in later steps.
    """
    st = py_strip(F.col("text"))
    piece = F.when((F.length(st) > 0) & not_int(st), F.concat(F.col("font"), py_float_str(F.col("size")), F.lit(":"), F.col("text")))
    held = [c for c in SPAN if c in spans.columns]
    g = spans.groupBy("report", "page_no", *BLOCK[1:]).agg(
        F.sort_array(F.collect_list(F.struct("line_no", "span_no", piece.alias("p"), *held[2:]))).alias("_ps"),
        F.sum(F.length("text")).alias("_len"),
        F.count(F.lit(1)).alias("_n"),
        F.sum(private_use_count(F.col("text"))).alias("n_private"),
    ).withColumn("n_lines", F.size(F.array_distinct(F.transform("_ps", lambda x: x["line_no"]))))
    return g.select(
        *BLOCK,
        "page_no",
        F.array_join(F.transform("_ps", lambda x: x["p"]), ";").alias("block_key"),
        F.col("n_lines").cast("bigint").alias("n_lines"),
        (F.col("_len") + F.col("n_lines")).cast("bigint").alias("text_len"),
        (F.col("_len") + 2 * F.col("_n") + 1).cast("bigint").alias("plain_len"),
        F.col("n_private").cast("bigint").alias("n_private"),
        F.transform("_ps", lambda x: F.struct(*[x[c].alias(c) for c in held])).alias("spans"),
    )


def block_spans(blk: DataFrame) -> DataFrame:
    """The spans of block rows, one a row."""
    return blk.select(*BLOCK, F.inline("spans"))


def often_hashes(blk: DataFrame) -> DataFrame:
    """(_r, _k, _n): hashes of the keys of 1-5 line blocks that are seen more than
    10 times in a report; any key seen so often has its hash among them."""
    return _short(blk).groupBy(F.col("report").alias("_r"), F.col("_h").alias("_k")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > REPEAT_LIMIT)


def _short(blk: DataFrame) -> DataFrame:
    return blk.where(F.col("n_lines").between(MIN_LINES, MAX_LINES)).select("report", "block_key", F.xxhash64("block_key").alias("_h"))


def repeated_keys(blk: DataFrame, often: DataFrame | None = None) -> DataFrame:
    """Keys of 1-5 line blocks seen more than 10 times in a report (Z19: the
    empty key of number-only blocks counts too).  A mergeable count: a key that
    holds a third of all blocks still pre-aggregates per task.  Hashes of the
    keys are counted first, so that only texts whose hash repeats are exchanged;
    ``blk`` is read twice.  ``often`` is ``often_hashes(blk)``: where it is stored,
    its size is known before the join, and a small one is sent to the blocks."""
    short, often = _short(blk), often_hashes(blk) if often is None else often
    return (
        short.join(often, F.col("report").eqNullSafe(F.col("_r")) & (F.col("_h") == F.col("_k")), "left_semi")
        .groupBy("report", "block_key")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > REPEAT_LIMIT)
    )


def remove_repeated(blk: DataFrame, rep: DataFrame) -> DataFrame:
    """Drop blocks whose key is repeated, whatever their line count.

    Anti join on (report, key); AQE broadcasts the key table when it is small
    and splits a skewed key otherwise.
    """
    return blk.join(rep.select("report", "block_key"), ["report", "block_key"], "left_anti")


def document_status(kept_blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """E10-E12 per report: text length, private-use share, status.  The kept blocks
    may come summed up by page (``page_summary``).

    ``no content`` when no text is left, ``unreadable`` when more than 90% of
    the characters are private-use code points, else ``ok`` (Z14 fixed: a
    status column, not a one-section document).
    """
    n_blocks = F.sum("n_blocks") if "n_blocks" in kept_blocks.columns else F.count(F.lit(1))
    agg = kept_blocks.groupBy("report").agg(
        F.sum("text_len").alias("n_chars"), F.sum("n_private").alias("n_private"), n_blocks.alias("n_blocks")
    )
    reps = pages.select("report").distinct()
    r = reps.join(agg, "report", "left").fillna(0, ["n_chars", "n_private", "n_blocks"])
    share = F.try_divide(F.col("n_private").cast("double"), F.col("n_chars").cast("double"))
    return r.select(
        "report",
        F.col("n_blocks").cast("bigint").alias("n_blocks"),
        F.col("n_chars").cast("bigint").alias("n_chars"),
        F.col("n_private").cast("bigint").alias("n_private"),
        share.alias("private_share"),
        F.when(F.col("n_chars") == 0, "no content").when(share > 0.9, "unreadable").otherwise("ok").alias("status"),
    )


#: What is summed of the blocks of a page.
LENGTHS = ["text_len", "plain_len", "n_private"]
#: F1/F2: the offsets of a block in its document, and what they are sums of.
OFFSETS = {"end_off": ("text_len", True), "plain_before": ("plain_len", False)}


def offsets(kept_blocks: DataFrame) -> DataFrame:
    """F1/F2 of each kept block, in one pass: ``end_off``, the document text up to
    its end, and ``plain_before``, the plain text before it."""
    return running_sums(kept_blocks, ["report"], "page_key", ["block_no"], OFFSETS).select(*BLOCK, "end_off", "plain_before")


def page_summary(blk: DataFrame, rep: DataFrame) -> DataFrame:
    """What ``remove_repeated`` leaves of each page, one row a page: the number of
    kept blocks and the sums of their lengths (null where none), and the repeated
    keys that were on it (``dropped``).  The keys of blocks meet ``rep`` once,
    without the blocks' spans."""
    keys = rep.select(F.col("report").alias("_r"), F.col("block_key").alias("_k"), F.lit(True).alias("_rep"))
    narrow = blk.select("report", "page_no", "block_key", *LENGTHS)
    marked = narrow.join(keys, (F.col("report") == F.col("_r")) & (F.col("block_key") == F.col("_k")), "left")
    kept = F.col("_rep").isNull()
    return marked.groupBy("report", "page_no").agg(
        F.count_if(kept).alias("n_blocks"), *[F.sum(F.when(kept, F.col(c))).alias(c) for c in LENGTHS],
        F.collect_set(F.when(~kept, F.col("block_key"))).alias("dropped"))


def page_marks(summary: DataFrame, reports: DataFrame) -> DataFrame:
    """What decides on a page's blocks, one row for each page of ``reports`` that has
    kept blocks: its repeated keys (``dropped``) and its ``page_bases``."""
    pages = summary.where("n_blocks > 0").join(reports, "report", "left_semi")
    return page_bases(pages, ["report"], "page_no", OFFSETS, ["dropped"])


def kept_on_pages(blk: DataFrame, marks: DataFrame) -> DataFrame:
    """The kept blocks of the pages of ``marks``, with the columns of both: what
    ``remove_repeated`` keeps, found by the page, so that block rows that lie
    together by page are not exchanged with their spans."""
    return blk.join(marks, ["report", "page_no"]).where(~F.array_contains("dropped", F.col("block_key"))).drop("dropped")


def placed(kept: DataFrame) -> DataFrame:
    """``kept_on_pages`` with the offsets of each block (see ``offsets``)."""
    return in_page_sums(kept, ["report"], "page_no", ["page_key", "block_no"], OFFSETS).where(F.col("block_no").isNotNull())
