"""Span tree sources (A5): report files through an extractor, nested page JSON,
and the flat ``spans`` table."""

from __future__ import annotations

import gzip
import json
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BBOX = T.ArrayType(T.DoubleType())
SPAN = T.StructType([
    T.StructField("text", T.StringType()), T.StructField("font", T.StringType()),
    T.StructField("size", T.DoubleType()), T.StructField("color", T.IntegerType()), T.StructField("bbox", BBOX),
])
LINE = T.StructType([T.StructField("bbox", BBOX), T.StructField("spans", T.ArrayType(SPAN))])
BLOCK = T.StructType([T.StructField("number", T.LongType()), T.StructField("bbox", BBOX),
                      T.StructField("lines", T.ArrayType(LINE))])
PAGE = T.StructType([T.StructField("width", T.DoubleType()), T.StructField("height", T.DoubleType()),
                     T.StructField("blocks", T.ArrayType(BLOCK))])


#: What an extractor yields for a file, one row a page, and how it failed.
EXTRACTED = "path string, page_no bigint, page_json string, error string"
#: How a gzipped file begins.
GZIP = b"\x1f\x8b"
#: Rows of extracted pages handed on together.
PAGES = 64


def json_lines(content: bytes) -> Iterator[tuple[int, dict]]:
    """The extractor of files with one JSON page a line, gzipped or not: {"page_no", "page"}."""
    if content[:2] == GZIP:
        content = gzip.decompress(content)
    for line in content.decode().split("\n"):
        if line.strip():
            row = json.loads(line)
            yield row["page_no"], row["page"]


def extract_pages(files: DataFrame, extract: Callable[[bytes], Iterable[tuple[int, dict]]]) -> DataFrame:
    """A5: pages of report files (path, content as the ``binaryFile`` source
    gives them) by the caller's ``extract``: content -> (page number, page), a
    page being the tree of blocks, lines and spans.

    A file that ``extract`` fails on gives one row with the kind of error and no
    page; the pages it gave before the failure are not returned, so a document
    is whole or marked.  A file without pages gives no rows.  Files go one by one
    through Arrow batches; a task holds one file and its pages.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["path", "page_no", "page_json", "error"]
        kinds = [pa.string(), pa.int64(), pa.string(), pa.string()]
        for b in batches:
            for path, content in zip(b.column(0), b.column(1)):
                try:
                    rows = [(path.as_py(), int(n), json.dumps(page), None) for n, page in extract(content.as_py() or b"")]
                except Exception as e:  # whatever a user's codec raises is that file's error
                    rows = [(path.as_py(), None, None, type(e).__name__)]
                for k in range(0, len(rows), PAGES):
                    part = list(zip(*rows[k:k + PAGES]))
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(part, kinds)], names)

    return files.select("path", "content").mapInArrow(work, EXTRACTED)


def flatten_pages(pages: DataFrame, json_col: str = "page_json") -> DataFrame:
    """A5: (report, page_no, page_json) -> one row per span with geometry.

    Blocks without ``lines`` (images) give no rows.  Parsing and the three
    ``posexplode`` levels are per row, so pages spread over all tasks.
    """
    p = pages.select("report", "page_no", F.from_json(F.col(json_col), PAGE).alias("p"))
    b = p.select("report", "page_no", F.col("p.width").alias("page_w"), F.col("p.height").alias("page_h"),
                 F.explode("p.blocks").alias("b")).where(F.size(F.coalesce(F.col("b.lines"), F.array())) > 0)
    ln = b.select("*", F.posexplode("b.lines").alias("line_no", "l"))
    sp = ln.select("*", F.posexplode("l.spans").alias("span_no", "s"))
    return sp.select(
        "report", "page_no", "page_w", "page_h", F.col("b.number").alias("block_no"),
        F.col("line_no").cast("bigint").alias("line_no"), F.col("span_no").cast("bigint").alias("span_no"),
        F.col("s.text").alias("text"), F.col("s.font").alias("font"), F.col("s.size").alias("size"),
        F.col("s.color").alias("color"),
        F.col("s.bbox")[0].alias("x0"), F.col("s.bbox")[1].alias("y0"),
        F.col("s.bbox")[2].alias("x1"), F.col("s.bbox")[3].alias("y1"),
        F.col("l.bbox")[0].alias("line_x0"), F.col("l.bbox")[2].alias("line_x1"),
        F.col("b.bbox")[0].alias("block_x0"), F.col("b.bbox")[2].alias("block_x1"),
    )


def nest_pages(spans: DataFrame) -> DataFrame:
    """The inverse: flat spans -> one JSON document per page, with an image
    block (no lines) added to every page.  Grouping is per line, block and
    page, all physically small; the spans of a page meet by one exchange."""
    s = spans.repartition("report", "page_no").select("*", F.struct("text", "font", "size", "color", F.array("x0", "y0", "x1", "y1").alias("bbox")).alias("sp"))
    lines = s.groupBy("report", "page_no", "page_w", "page_h", "block_no", "line_no").agg(
        F.sort_array(F.collect_list(F.struct("span_no", "sp"))).alias("_s"),
        F.min("x0").alias("lx0"), F.min("y0").alias("ly0"), F.max("x1").alias("lx1"), F.max("y1").alias("ly1"),
    ).select("*", F.struct(F.array("lx0", "ly0", "lx1", "ly1").alias("bbox"),
                            F.transform("_s", lambda x: x["sp"]).alias("spans")).alias("ln"))
    blocks = lines.groupBy("report", "page_no", "page_w", "page_h", "block_no").agg(
        F.sort_array(F.collect_list(F.struct("line_no", "ln"))).alias("_l"),
        F.min("lx0").alias("bx0"), F.min("ly0").alias("by0"), F.max("lx1").alias("bx1"), F.max("ly1").alias("by1"),
    ).select("*", F.struct(F.col("block_no").alias("number"), F.array("bx0", "by0", "bx1", "by1").alias("bbox"),
                            F.transform("_l", lambda x: x["ln"]).alias("lines")).alias("blk"))
    image = F.struct(F.lit(-1).cast("bigint").alias("number"), F.array(F.lit(0.0), F.lit(0.0), F.lit(10.0), F.lit(10.0)).alias("bbox"),
                     F.lit(None).cast(T.ArrayType(LINE)).alias("lines"))
    pages = blocks.groupBy("report", "page_no", "page_w", "page_h").agg(
        F.sort_array(F.collect_list(F.struct("block_no", "blk"))).alias("_b")
    )
    return pages.select(
        "report", "page_no",
        F.to_json(F.struct(F.col("page_w").alias("width"), F.col("page_h").alias("height"),
                           F.concat(F.array(image), F.transform("_b", lambda x: x["blk"])).alias("blocks"))).alias("page_json"),
    )
