"""Blocks to HTML, document, sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arlens.functions.text import clean_newlines, page_title, styled
from arlens.operators.layout import page_of

ORD = ["page_key", "block_no", "line_no", "span_no"]

# Fixed values of the page around a document (B10), head and tail: table markdown needs its spacing kept; the
# tail closes body before html (Z23 fixed).
CSS = ".markdown-table { white-space: pre; font-family: monospace; }"
HTML_TAIL = "</body>\n</html>\n"


def block_html(kept_blocks: DataFrame, accepted: DataFrame) -> DataFrame:
    """G9/G10 (Z10, Z22 kept): one paragraph per block (``boilerplate.blocks``,
    whose rows hold their spans in order).

    Each span is `` styled `` (S8); an accepted heading span replaces what its
    line had so far by ``<h1>styled</h1>\\n``.  The block is ``\\n<p>`` + lines,
    closed with ``</p>`` unless its text already holds one.  A block has at
    most one accepted heading (the 1000-character gap).  The headings of a page
    are joined on the page, where block rows that are stored by page stay.
    """
    blk, page = ["report", "page_key", "block_no", "page_no"], ["page_no", "report"]
    acc = accepted.where("accepted").withColumn("page_no", page_of(F.col("page_key"))).groupBy(*page).agg(F.collect_list(F.struct("page_key", "block_no", "line_no", "span_no")).alias("_acc"))
    spans = F.transform("spans", lambda x: F.struct(x["line_no"].alias("line_no"), x["span_no"].alias("span_no"), styled(x["text"], x["font"]).alias("st")))
    s = kept_blocks.select(*blk, spans.alias("_ps")).join(acc, page, "left")
    s = s.withColumn("_h", F.try_element_at(F.filter("_acc", lambda a: (a["page_key"] == F.col("page_key")) & (a["block_no"] == F.col("block_no"))), F.lit(1)))

    def piece(x: Column) -> Column:
        in_line = F.col("_h").isNotNull() & (x["line_no"] == F.col("_h.line_no"))
        return (
            F.when(in_line & (x["span_no"] == F.col("_h.span_no")), F.concat(F.lit("<h1>"), x["st"], F.lit("</h1>\n")))
            .when(in_line & (x["span_no"] < F.col("_h.span_no")), F.lit(None))
            .otherwise(F.concat(F.lit(" "), x["st"], F.lit(" ")))
        )

    g = s.select(*blk, F.concat(F.lit("\n<p>"), F.array_join(F.transform("_ps", piece), "")).alias("body"))
    body = F.col("body")
    return g.select(
        *blk, F.when(body.contains("</p>"), body).otherwise(F.concat(body, F.lit("</p>"))).alias("html"),
    )


def section_pieces(blocks_html: DataFrame) -> DataFrame:
    """G12 on block level: each block's html split at ``<h1>``; piece j of a
    block belongs to section (number of <h1> before the block) + j.  Pieces of
    a section are joined in block order later."""
    from arlens.operators.sequence import running_sums

    # Blocks that say their page lie together by it, both halves of it.
    page, inner = ("page_no", ["page_key", "block_no"]) if "page_no" in blocks_html.columns else ("page_key", ["block_no"])
    n_h1 = ((F.length("html") - F.length(F.replace(F.col("html"), F.lit("<h1>"), F.lit("")))) / 4).cast("bigint")
    b = blocks_html.withColumn("n_h1", n_h1)
    b = running_sums(b, ["report"], page, inner, {"h1_before": ("n_h1", False)})
    return b.select(
        "report", "page_key", "block_no", "h1_before", F.posexplode(F.split("html", "<h1>", -1)).alias("j", "part")
    ).select("report", "page_key", "block_no", "j", (F.col("h1_before") + F.col("j")).alias("i"), "part")


def sections_from_pieces(pieces: DataFrame, clean: bool = True) -> DataFrame:
    """Sections (report, i, html): pieces joined in order, S10 applied (when
    ``clean``), the ``<h1>`` tag restored when the section holds ``</h1>``
    (unclosed loses it).  Each section is assembled from its own pieces only,
    so no row ever holds more than one section."""
    g = pieces.groupBy("report", "i").agg(
        F.sort_array(F.collect_list(F.struct("page_key", "block_no", "j", "part"))).alias("_ps")
    )
    joined = F.array_join(F.transform("_ps", lambda x: x["part"]), "")
    raw = clean_newlines(joined) if clean else joined
    return g.select(
        "report", F.col("i").cast("bigint").alias("i"),
        F.when(raw.contains("</h1>"), F.concat(F.lit("<h1>"), raw)).otherwise(raw).alias("html"),
    )


def split_sections(df: DataFrame, key: str, html: str) -> DataFrame:
    """G12 directly on an html column: (key, i, html) with Python's split
    semantics (a leading ``<h1>`` gives an empty first part)."""
    parts = df.select(F.col(key), F.posexplode(F.split(F.col(html), "<h1>", -1)).alias("i", "part"))
    return parts.select(
        key, F.col("i").cast("bigint").alias("i"),
        F.when(F.col("part").contains("</h1>"), F.concat(F.lit("<h1>"), F.col("part"))).otherwise(F.col("part")).alias("html"),
    )


def html_page(blocks_html: DataFrame, title: Column | None = None) -> DataFrame:
    """The whole document per report as an HTML page (head, title =
    base name of ``title``, style, body).  The body is the blocks in order, so a
    ``<h1>`` that the text holds unclosed stays in it."""
    g = blocks_html.groupBy("report").agg(F.sort_array(F.collect_list(F.struct("page_key", "block_no", "html"))).alias("_s"))
    body = clean_newlines(F.array_join(F.transform("_s", lambda x: x["html"]), ""))
    head = F.concat(
        F.lit("<!DOCTYPE html>\n<html>\n<head>\n<meta charset='utf-8'><title>"), page_title(F.col("report") if title is None else title),
        F.lit("</title>\n<style>\n" + CSS + "\n</style>\n</head>\n<body>\n"),
    )
    return g.select("report", F.concat(head, body, F.lit(HTML_TAIL)).alias("page"))


def write_pages(pages: DataFrame, folder: str) -> None:
    """One file per report below ``folder`` (a folder for each report)."""
    pages.select("report", "page").write.mode("overwrite").partitionBy("report").text(folder)


def read_pages(spark: SparkSession, folder: str) -> DataFrame:
    """The pages that ``write_pages`` wrote; the writer ends each with a newline."""
    text = spark.read.schema("value string, report string").text(folder, wholetext=True)
    return text.select("report", F.regexp_replace("value", "\n\\z", "").alias("page"))
