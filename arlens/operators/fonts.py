"""Font index of a document and the choice of body and heading fonts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arlens.functions.text import font_key, py_strip

LINE = ["report", "page_key", "block_no", "line_no"]
# Fixed values of the heading rule: share < 0.05, more than 4 distinct texts,
# mean length in (10, 500), extent above the first passable of 0.8/0.6/0.4/0.2.
MAX_SHARE, MIN_DISTINCT, MIN_MEAN, MAX_MEAN = 0.05, 4, 10, 500
EXTENT_LEVELS = [0.8, 0.6, 0.4, 0.2]


def font_entries(kept: DataFrame, offsets: DataFrame | None = None) -> DataFrame:
    """One entry per line in a single font, else one per span.

    ``kept``: block rows with their spans in order and their offset
    (``boilerplate.placed``), which nothing is exchanged for; or spans, whose
    blocks' offsets are in ``offsets``.

    Positions are offsets in the running document text (``getline`` of the
    kept blocks, see ``boilerplate.offsets``): a single-font line gets the offset at its block's end, a
    mixed line's span gets that offset plus the running length of the line's
    span texts up to and including it.  Texts are stripped.  ``ord`` is the
    first-appearance order (page_key, block_no, line_no, span_no).
    """
    def entry(font: Column, pos: Column, text: Column, line_no: Column, span_no: Column) -> Column:
        return F.struct(font.alias("font_key"), pos.cast("bigint").alias("pos"), text.alias("text"), line_no.alias("line_no"), span_no.alias("span_no"))

    def of_line(t: Column, line_no: Column) -> Column:
        """The entries of a line from its spans (span_no, text, font_key) in order."""
        def mixed(x: Column, i: Column) -> Column:
            texts = F.filter(F.transform(F.slice(t, F.lit(1), i + 1), lambda y: y["text"]), lambda y: y.isNotNull())
            so_far = F.when(F.size(texts) > 0, F.length(F.array_join(texts, "")))
            return entry(x["font_key"], F.col("end_off") + so_far, x["text"], line_no, x["span_no"])

        first = F.get(t, F.lit(0))
        single = F.array(entry(first["font_key"], F.col("end_off"), F.array_join(F.transform(t, lambda x: x["text"]), ""), line_no, first["span_no"]))
        one = F.size(F.array_distinct(F.transform(t, lambda x: x["font_key"]))) == 1
        return F.when(one, single).otherwise(F.transform(t, mixed))

    def span(x: Column) -> Column:
        return F.struct(x["span_no"].alias("span_no"), x["text"].alias("text"), font_key(x["font"], x["size"], x["color"]).alias("font_key"))

    if offsets is None:
        # A block with as many lines as spans, as most are, needs no gathering.
        lines = F.array_distinct(F.transform("spans", lambda x: x["line_no"]))
        alone = F.transform("spans", lambda x: entry(font_key(x["font"], x["size"], x["color"]), F.col("end_off"), F.coalesce(x["text"], F.lit("")), x["line_no"], x["span_no"]))
        of = lambda k: F.sort_array(F.transform(F.filter("spans", lambda x: x["line_no"].eqNullSafe(k)), span))
        # A line's spans are gathered once, as an array of one line that is mapped.
        several = F.flatten(F.transform(lines, lambda k: F.flatten(F.transform(F.array(of(k)), lambda t: of_line(t, k)))))
        e = kept.select("report", "page_key", "block_no", F.inline(F.when(F.size(lines) == F.size("spans"), alone).otherwise(several)))
    else:
        ends = offsets.select("report", "page_key", "block_no", "end_off")
        s = kept.select(*LINE, "span_no", "text", font_key(F.col("font"), F.col("size"), F.col("color")).alias("font_key"))
        # Joined first: the spans of a line are together then, and are gathered once.
        s = s.join(ends, ["report", "page_key", "block_no"])
        line = s.groupBy(*LINE, "end_off").agg(F.sort_array(F.collect_list(F.struct("span_no", "text", "font_key"))).alias("_t"))
        e = line.select("report", "page_key", "block_no", F.inline(of_line(F.col("_t"), F.col("line_no"))))
    return e.select("report", "font_key", "pos", py_strip(F.col("text")).alias("text"), F.struct("page_key", "block_no", "line_no", "span_no").alias("ord"))


def font_stats(entries: DataFrame) -> DataFrame:
    """E14 per (report, font): entries, text length, share of all entry text,
    first/last relative offset and extent (may exceed 1), distinct texts,
    mean length, first appearance."""
    # Distinct texts counted over their 128-bit digests, on their own: the distinct
    # step shuffles 16 bytes per entry, neither whole lines nor the other sums.
    texts = entries.groupBy(F.col("report").alias("_r"), F.col("font_key").alias("_f")).agg(F.countDistinct(F.unhex(F.md5("text"))).alias("n_distinct"))
    per = entries.groupBy("report", "font_key").agg(
        F.count(F.lit(1)).alias("n_entries"),
        F.sum(F.length("text")).alias("text_len"),
        F.avg(F.length("text")).alias("mean_len"),
        F.min("pos").alias("first_pos"),
        F.max("pos").alias("last_pos"),
        F.min("ord").alias("first_ord"),
    )
    per = per.join(texts, F.col("report").eqNullSafe(F.col("_r")) & F.col("font_key").eqNullSafe(F.col("_f")))
    p = per.withColumn("totlen", F.sum("text_len").over(Window.partitionBy("report")))
    tl = F.col("totlen").cast("double")
    start = F.try_divide(F.col("first_pos").cast("double"), tl)
    end = F.try_divide(F.col("last_pos").cast("double"), tl)
    return p.select(
        "report", "font_key", F.col("n_entries").cast("bigint").alias("n_entries"),
        F.col("text_len").cast("bigint").alias("text_len"), F.col("n_distinct").cast("bigint").alias("n_distinct"),
        "mean_len", F.try_divide(F.col("text_len").cast("double"), tl).alias("share"),
        start.alias("start"), end.alias("end"), (end - start).alias("extent"), "first_ord",
    )


def body_font(stats: DataFrame) -> DataFrame:
    """E15 (Z21 kept): most entries, ties by first appearance."""
    pick = F.min(F.struct((-F.col("n_entries")).alias("a"), F.col("first_ord").alias("b"), F.col("font_key").alias("k")))
    return stats.groupBy("report").agg(pick["k"].alias("body_font"))


def heading_font(stats: DataFrame) -> DataFrame:
    """Among fonts with share < 0.05, > 4 distinct texts and mean length in
    (10, 500), those whose extent exceeds the highest level of 0.8/0.6/0.4/0.2
    that any of them passes; then fewest distinct texts, ties by most entries
    and first appearance.  '' when none."""
    ok = (
        (F.col("share") < MAX_SHARE) & (F.col("n_distinct") > MIN_DISTINCT)
        & (F.col("mean_len") > MIN_MEAN) & (F.col("mean_len") < MAX_MEAN)
    )
    level = None
    for lv in EXTENT_LEVELS:
        level = F.when(F.col("extent") > lv, lv) if level is None else level.when(F.col("extent") > lv, lv)
    c = stats.withColumn("level", F.when(ok, level)).withColumn("best", F.max("level").over(Window.partitionBy("report")))
    cand = F.col("level").isNotNull() & (F.col("extent") > F.col("best"))
    pick = F.min(
        F.when(cand, F.struct(
            F.col("n_distinct").alias("a"), (-F.col("n_entries")).alias("b"), F.col("first_ord").alias("c"),
            F.col("font_key").alias("k"),
        ))
    )
    return c.groupBy("report").agg(F.coalesce(pick["k"], F.lit("")).alias("heading_font"))
