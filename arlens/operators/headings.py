"""Heading acceptance.

A span in the heading font becomes a section heading when it is the first
one, or when at least 1000 characters of plain text lie between it and the
last accepted heading and its normalised text (S9) was not used before.  The
decision depends on the previous *accepted* heading, so it is a fold, not a
window function: the heading-font spans of each report (a few per page at
most, by the 5% share rule of the font choice) stream past in document order,
and the state is the last heading's offset and the set of the keys used.  The
work is linear in the candidates; spill of the sort aside, a task holds one
batch and one report's used keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arlens.functions.text import font_key, heading_key, styled

# Fixed value: plain-text characters required between two headings.
MIN_GAP = 1000
ORD = ["page_key", "block_no", "line_no", "span_no"]


def in_heading_font(kept: DataFrame) -> DataFrame:
    """Block rows with those of their spans that are in the report's
    ``heading_font``."""
    return kept.withColumn("spans", F.filter("spans", lambda x: font_key(x["font"], x["size"], x["color"]) == F.col("heading_font")))


def heading_candidates(placed: DataFrame) -> DataFrame:
    """Spans in the report's heading font (``in_heading_font``) with their block's
    plain offset (F2, see ``boilerplate.placed``) and key."""
    c = placed.select("report", "page_key", "block_no", "plain_before", F.inline("spans"))
    return c.select(
        "report", *ORD, "plain_before", "text", "font",
        heading_key(styled(F.col("text"), F.col("font"))).alias("head_key"),
    )


def accept_headings(cands: DataFrame) -> DataFrame:
    """candidates with ``accepted`` (the greedy fold of the reference).  A
    span without text is no heading."""
    rows = cands.select("report", *ORD, "plain_before", "text", "font", "head_key")
    gap = MIN_GAP

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        began, report, last, used = False, None, None, set()
        for b in batches:
            flags = []
            for doc, at, key in zip(*(b.column(c).to_pylist() for c in ("report", "plain_before", "head_key"))):
                if not began or doc != report:
                    began, report, last, used = True, doc, None, set()
                take = key is not None and key not in used and (last is None or at - last >= gap)
                if take:
                    last = at
                    used.add(key)
                flags.append(take)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(flags, pa.bool_())], [*b.schema.names, "accepted"])

    ordered = rows.repartition("report").sortWithinPartitions("report", *ORD)
    return ordered.mapInArrow(fold, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", accepted boolean")
