"""Document plans: spans -> pages -> kept blocks -> fonts -> headings -> tables -> sections."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arlens.operators import boilerplate, fonts, headings, html, layout, tables
from arlens.operators.layout import page_of
from arlens.plans.joins import materialize, materialize_by, stored_input
from arlens.sources import fixtures

class DocPlan:
    """The frames of the document pipeline, each built when first asked for.

    The spans of a page meet once, when blocks are made of them; block rows hold
    their spans, and the later steps read these.  Blocks, page marks, tables and
    html are read by several later steps and are stored when one of these asks
    for them; nothing else runs before the caller's own action.

    Blocks and html are stored by page, and what later steps find about a page
    is brought to them there: no later step exchanges spans.
    """

    def __init__(self, spans: DataFrame, pages: DataFrame):
        self.input, self.pages = spans, pages

    @cached_property
    def spans(self) -> DataFrame:
        """Spans after the page split."""
        return layout.page_split(self.input)

    @cached_property
    def blocks(self) -> DataFrame:
        return materialize_by(boilerplate.blocks(self.spans), "page_no", "report")

    @cached_property
    def repeated(self) -> DataFrame:
        return materialize(boilerplate.repeated_keys(self.blocks, materialize(boilerplate.often_hashes(self.blocks))))

    @cached_property
    def kept_blocks(self) -> DataFrame:
        return boilerplate.remove_repeated(self.blocks, self.repeated)

    @cached_property
    def summary(self) -> DataFrame:
        """What is kept of each page."""
        return materialize(boilerplate.page_summary(self.blocks, self.repeated))

    @cached_property
    def status(self) -> DataFrame:
        return boilerplate.document_status(self.summary, self.pages)

    @cached_property
    def readable(self) -> DataFrame:
        return materialize(self.status.where("status = 'ok'").select("report"))

    @cached_property
    def marks(self) -> DataFrame:
        """What decides on the blocks of each page of readable reports, and where
        the page begins in its document."""
        return materialize(boilerplate.page_marks(self.summary, self.readable))

    @cached_property
    def kept_ok(self) -> DataFrame:
        """Kept blocks of readable reports."""
        return boilerplate.kept_on_pages(self.blocks, self.marks)

    @cached_property
    def entries(self) -> DataFrame:
        return fonts.font_entries(boilerplate.placed(self.kept_ok))

    @cached_property
    def stats(self) -> DataFrame:
        return fonts.font_stats(self.entries)

    @cached_property
    def body(self) -> DataFrame:
        return fonts.body_font(self.stats)

    @cached_property
    def heading(self) -> DataFrame:
        return fonts.heading_font(self.stats)

    @cached_property
    def accepted(self) -> DataFrame:
        marks = self.marks.join(materialize(self.heading), "report")
        kept = headings.in_heading_font(boilerplate.kept_on_pages(self.blocks, marks))
        return headings.accept_headings(headings.heading_candidates(boilerplate.placed(kept)))

    @cached_property
    def block_html(self) -> DataFrame:
        """Html of every kept block, before tables."""
        return html.block_html(self.kept_ok, self.accepted)

    @cached_property
    def tables(self) -> DataFrame:
        """(report, page_key, block_a, block_b, table_html) of the numeric
        tables on the kept spans of each page, numbered per report."""
        page = self.kept_ok.select("report", F.col("page_no").alias("sheet"), F.col("page_key").alias("page_no"), "block_no", F.inline("spans"))
        found = materialize(tables.numeric_tables(tables.page_tables(page)))
        out = tables.table_html(tables.number_tables(found))
        return out.withColumnRenamed("page_no", "page_key")

    @cached_property
    def document_html(self) -> DataFrame:
        """Html of every block with each table in place of its blocks."""
        found = self.tables.withColumn("page_no", page_of(F.col("page_key")))
        return materialize_by(tables.insert_tables(self.block_html, found, "page_key", ["page_no", "report"]), "page_no", "report")

    @cached_property
    def sections(self) -> DataFrame:
        return html.sections_from_pieces(html.section_pieces(self.document_html))


def fixture_plan(spark: SparkSession, sf_dir: str) -> DocPlan:
    spans = stored_input(spark, sf_dir, "doc_spans", fixtures.doc_spans)
    return DocPlan(spans, fixtures.doc_pages(spark, sf_dir))
