"""Query registry: one callable per Q-key of SURVEY section 2.

Each callable takes (spark, sf_dir) and returns a DataFrame.  Output
conventions shared with the DuckDB oracles (``plans.oracle``): dates are ISO
strings, statistics are rounded (6 decimals, p-values 8, rational fixture
columns 10), counts are bigint.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arlens.operators import factors, resolve
from arlens.plans import report
from arlens.plans.joins import materialize, stored_input
from arlens.sources import fixtures
from arlens.sources.reports import report_identity, scan_report_files
from arlens.sources.tables import read

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def q(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


def r6(c: str | Column) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def r8(c: str | Column) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 8)


def r10(c: str | Column) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 10)


def iso(c: str) -> Column:
    return F.date_format(F.col(c), "yyyy-MM-dd").alias(c)


# ------------------------------------------------- the fixtures as a user's frames


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.report_files(spark, sf_dir)


def _equity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In production a stored table; derived here once per session and folder."""
    return stored_input(spark, sf_dir, "equity", fixtures.equity)


def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.resolved(_reports(spark, sf_dir), _equity(spark, sf_dir), fixtures.all_isins(spark, sf_dir))


def _window_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.window_rows(_resolved(spark, sf_dir), _equity(spark, sf_dir))


def _result(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = fixtures.doc_spans(spark, sf_dir)  # read once
    return R.report_result(_reports(spark, sf_dir), _equity(spark, sf_dir), fixtures.all_isins(spark, sf_dir), spans, fixtures.doc_pages(spark, sf_dir))


# ---------------------------------------------------------------- step 1 / 2


@q
def reports_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1/A2: the files of a report folder with their size, year, ISIN and the
    three 1 June dates; what is no report has nulls, sub-folders are left out."""
    folder = INC.storage_path(spark, "files")
    fixtures.write_report_files(_reports(spark, sf_dir), folder)
    r = report_identity(scan_report_files(spark, folder))
    return r.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("n_bytes"), "year", "isin", iso("t0"), iso("t1"), iso("t2"))


@q
def equity_excess(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct regression columns with excess returns."""
    e = resolve.excess_returns(fixtures.equity(spark, sf_dir))
    return e.select(
        "isin", "name", iso("date"), r6("smb").alias("smb"), r6("hml").alias("hml"), r10("liq").alias("liq"),
        r8("mom").alias("mom"), r6("rx").alias("rx"), r6("rm").alias("rm"),
    )


@q
def equity_window_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of every (report, window), summarised per window."""
    wr = _window_rows(spark, sf_dir)
    return wr.groupBy("path", "horizon").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.date_format(F.min("date"), "yyyy-MM-dd").alias("first_date"),
        F.date_format(F.max("date"), "yyyy-MM-dd").alias("last_date"),
        r6(F.sum("rx")).alias("sum_rx"),
    )


@q
def numeric_coerce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coercion of cursor text to numbers (bad -> null) over every column
    of the regression rows, rendered as text first as the cursor delivers it."""
    from arlens.functions.text import to_number

    e = resolve.excess_returns(fixtures.equity(spark, sf_dir))
    cols = ["isin", "name", "date", "smb", "hml", "liq", "mom", "rx", "rm"]
    as_text = e.select(*[F.col(c).cast("string").alias(c) for c in cols])
    num = as_text.select(F.col("isin").alias("key"), *[to_number(F.col(c)).alias(f"v_{c}") for c in cols])
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    for c in cols:
        aggs.append(F.count(f"v_{c}").alias(f"n_{c}"))
    for c in ["smb", "hml", "rx", "rm"]:
        aggs.append(r6(F.sum(f"v_{c}")).alias(f"sum_{c}"))
    return num.groupBy(F.col("key").alias("isin")).agg(*aggs)


@q
def isin_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D1-D3 (+S16): company of every report."""
    r = _resolved(spark, sf_dir)
    return r.select("path", "isin", "name", "intcode", "sid", "isin_db", "sid_or_code")


def _ols_out(df: DataFrame) -> DataFrame:
    return df.select(
        "path", "horizon", "n_obs", "k", "df",
        r6("alpha").alias("alpha"), r6("beta").alias("beta"),
        r6("t_alpha").alias("t_alpha"), r6("t_beta").alias("t_beta"), "singular",
    )


@q
def factor_ols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OLS with listwise deletion over all five regressors."""
    return _ols_out(report.regression(_window_rows(spark, sf_dir), sparse=False))


@q
def factor_ols_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regressors missing in > 50% of a window dropped, then listwise deletion."""
    return _ols_out(report.regression(_window_rows(spark, sf_dir), sparse=True))


@q
def factor_pvalues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-sided Student t p-values of alpha and beta, on a log scale too so
    that the far tail is compared."""
    r = report.regression(_window_rows(spark, sf_dir), sparse=True)
    log = lambda c: r6(F.when(F.col(c) > 0, F.log10(c))).alias(f"log_{c}")
    return r.select("path", "horizon", "df", r8("pval_alpha").alias("pval_alpha"), r8("pval_beta").alias("pval_beta"), log("pval_alpha"), log("pval_beta"))


@q
def missing_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null counts and drop mask per report window."""
    p = factors.missing_profile(factors.mask_moments(_window_rows(spark, sf_dir)))
    return p.select("path", "horizon", "n_rows", "name", *[c for c in p.columns if c.startswith(("null_", "drop_"))])


# ------------------------------------------------------------ step 4: text

from arlens.functions import text as T  # noqa: E402
from arlens.operators import letters, scoring  # noqa: E402

# Token separators for the whole-text token tests (ASCII blanks).
TOKEN_SPLIT = "[ \\t\\n\\r\\f\\x0B]+"


@q
def is_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S1/S2/S3 over every token of every document (whole texts).

    Higher-order ``filter`` over the split tokens keeps the work per row: no
    explode, no shuffle.
    """
    d = read(spark, sf_dir, "documents").select("doc_id", "text")
    toks = F.filter(F.split(F.col("text"), TOKEN_SPLIT), lambda t: t != "")
    d = d.select("doc_id", toks.alias("toks"))
    # A token that has neither a digit nor nan/inf once the stripped characters
    # are gone is no number by any of the tests: this keeps the regexes off words.
    def maybe_number(t: Column) -> Column:
        bare = F.translate(t, ", $()%", "")
        return (F.translate(bare, "0123456789", "") != bare) | F.lower(bare).contains("nan") | F.lower(bare).contains("inf")

    maybe = F.filter("toks", maybe_number)
    d = d.select("doc_id", F.size("toks").alias("n"), maybe.alias("c"))
    return d.select(
        "doc_id",
        F.col("n").cast("bigint").alias("n_tokens"),
        F.size(F.filter("c", lambda t: T.is_number_table(t))).cast("bigint").alias("n_number_table"),
        F.size(F.filter("c", lambda t: T.is_number_row(t))).cast("bigint").alias("n_number_row"),
        F.size(F.filter("c", lambda t: ~T.not_int(t))).cast("bigint").alias("n_integer"),
    )


@q
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S10 over every document and page: newline normalisation, digest of the result."""
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit("doc").alias("kind"), "text")
    p = read(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.lit("page").alias("kind"), F.col("html").alias("text"))
    both = d.unionByName(p)
    c = T.clean_newlines(F.col("text"))
    return both.select(
        "id", "kind", F.length("text").cast("bigint").alias("n_in"), F.length(c).cast("bigint").alias("n_out"),
        F.md5(c).alias("md5_out"),
    )


@q
def grade_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S13 (L3 parse) over the response fixture."""
    return scoring.grades(fixtures.responses(spark, sf_dir)).select("report", "resp", "grade", "answer")


@q
def letter_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E21 (re-aimed): letter counts of every document against the English table."""
    return letters.letter_profile(read(spark, sf_dir, "documents"), "doc_id", "text").select(
        "doc_id", "n_letters", r6("chi2").alias("chi2")
    )


# ------------------------------------------------------------ step 5/6: documents

from arlens.operators import html as H  # noqa: E402
from arlens.plans import document  # noqa: E402


@q
def spans_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5: report files through the extractor (a broken file among them), then
    nested page -> block -> line -> span flattened; image blocks (no lines)
    dropped.  A file that fails gives one row with its error."""
    from arlens.sources.spans import extract_pages, flatten_pages, json_lines, nest_pages

    folder = INC.storage_path(spark, "documents")
    fixtures.write_page_files(nest_pages(fixtures.doc_spans(spark, sf_dir)), folder)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    pages = extract_pages(files, json_lines).withColumn("report", F.regexp_extract("path", "report=([^/]*)/", 1))
    pages = materialize(pages)
    flat = flatten_pages(pages.where("error is null")).select("report", "page_no", "block_no", "line_no", "span_no", "text", "font", r6("size").alias("size"))
    failed = pages.where("error is not null").select("report", "error")
    return flat.unionByName(failed, allowMissingColumns=True)


@q
def page_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans after the landscape split, new page key and x."""
    from arlens.operators.layout import page_split as split

    s = split(fixtures.doc_spans(spark, sf_dir))
    return s.select("report", "page_key", "block_no", "line_no", "span_no", r6("page_w").alias("page_w"),
                    r6("x0").alias("x0"), r6("x1").alias("x1"))


@q
def boilerplate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated block keys per report with their counts."""
    p = document.fixture_plan(spark, sf_dir)
    return p.repeated.select("report", "block_key", F.col("n").cast("bigint").alias("n"))


@q
def boilerplate_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocks that remain after removing repeated ones."""
    p = document.fixture_plan(spark, sf_dir)
    return p.kept_blocks.select("report", "page_key", "block_no", "n_lines", "text_len")


@q
def document_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of the document text per report (kept blocks)."""
    p = document.fixture_plan(spark, sf_dir)
    return p.status.select("report", "n_blocks", "n_chars")


@q
def unreadable_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Private-use share of the document text per report."""
    p = document.fixture_plan(spark, sf_dir)
    return p.status.select("report", "n_chars", "n_private", r6("private_share").alias("private_share"))


@q
def document_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ok / no content / unreadable per report."""
    return document.fixture_plan(spark, sf_dir).status.select("report", "status")


@q
def font_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Font index entries with offsets."""
    e = document.fixture_plan(spark, sf_dir).entries
    return e.select("report", "font_key", "pos", "text")


@q
def font_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics per font."""
    s = document.fixture_plan(spark, sf_dir).stats
    return s.select(
        "report", "font_key", "n_entries", "text_len", "n_distinct", r6("mean_len").alias("mean_len"),
        r6("share").alias("share"), r6("start").alias("start"), r6("end").alias("end"),
    )


@q
def body_font(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Body font per report."""
    return document.fixture_plan(spark, sf_dir).body


@q
def heading_font(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heading font per report ('' when none)."""
    return document.fixture_plan(spark, sf_dir).heading


@q
def heading_accept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """heading candidates, their plain offsets and the greedy acceptance."""
    a = document.fixture_plan(spark, sf_dir).accepted
    return a.select("report", "page_key", "block_no", "line_no", "span_no", "plain_before", "head_key", "accepted")


@q
def html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Html of every kept block."""
    return document.fixture_plan(spark, sf_dir).block_html.select("report", "page_key", "block_no", "html")


# Page ids that one document of a host spans.
HOST_RUN = 500


@q
def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G12 on raw web pages: every page's html split at <h1>, plus runs of each
    host's pages joined in page_id order."""
    pages = read(spark, sf_dir, "pages")
    pg = pages.select(F.col("page_id").cast("string").alias("doc"), "html")
    per_page = H.split_sections(pg, "doc", "html")
    # Sections of a whole host: pages in page_id order, split per page and
    # assembled per section (never one string per host).
    host = F.regexp_extract(F.col("url"), "^[a-z]+://([^/?#]+)", 1)
    blocks = pages.select(F.concat(F.lit("host:"), host, F.lit("#"), F.floor(F.col("page_id") / HOST_RUN).cast("string")).alias("report"), F.col("page_id").alias("page_key"),
                          F.lit(0).cast("bigint").alias("block_no"), "html")
    # A document is a run of a host's pages, so hosts grow in documents.
    byhost = H.sections_from_pieces(H.section_pieces(blocks), clean=False).withColumnRenamed("report", "doc")
    s = per_page.unionByName(byhost)
    return s.select("doc", "i", F.length("html").cast("bigint").alias("n_chars"), F.md5("html").alias("md5"))


@q
def document_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of every readable report."""
    s = document.fixture_plan(spark, sf_dir).sections
    return s.select("report", "i", F.length("html").cast("bigint").alias("n_chars"), F.md5("html").alias("md5"))


@q
def html_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The HTML page of every readable report, written as one file
    per report and read back (size and digest, title and tables in it)."""
    pages = H.html_page(document.fixture_plan(spark, sf_dir).document_html, F.concat(F.lit(fixtures.REPORT_DIR), F.col("report")))
    folder = INC.storage_path(spark, "pages")
    H.write_pages(pages, folder)
    pg = H.read_pages(spark, folder)
    n_tables = ((F.length("page") - F.length(F.replace("page", F.lit("<b>Table "), F.lit("")))) / 9).cast("bigint")
    return pg.select(n_tables.alias("n_tables"), F.regexp_extract("page", "<title>(.*?)</title>", 1).alias("title"), "report", F.length("page").cast("bigint").alias("n_chars"), F.md5("page").alias("md5"))


# ------------------------------------------------------------ step 8: scoring and the result row

from arlens.plans import result as R  # noqa: E402


def _doc_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document.fixture_plan(spark, sf_dir).sections


@q
def section_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prompts of every non-empty section, long ones in parts."""
    p = scoring.section_prompts(_doc_sections(spark, sf_dir))
    return p.select("report", "i", "part", "heading", F.length("prompt").cast("bigint").alias("n_chars"), F.md5("prompt").alias("md5"))


@q
def section_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L1: every section summarised by the (offline, extractive) scorer."""
    s = scoring.summarize_sections(_doc_sections(spark, sf_dir))
    return s.select("report", "i", "heading", F.length("res").cast("bigint").alias("n_chars"), F.md5("res").alias("md5"))


@q
def summary_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E20/L2 + L3: per report the concatenated summary, the conclusion and its grade."""
    c = scoring.conclude(scoring.summarize_sections(_doc_sections(spark, sf_dir)))
    return c.select("report", F.md5("summary").alias("summary_md5"), F.length("summary").cast("bigint").alias("n_chars"),
                    "grade", F.md5("answer").alias("answer_md5"))


@q
def report_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 16-column result row of every report (plus its path)."""
    r = _result(spark, sf_dir)
    return r.select("path", "ISIN", "ISIN_db", "Name",
                    *[(r8 if c.startswith("pval") else r6)(c).alias(c) for c in R.RESULT_COLS[3:15]], "Answer")


# ------------------------------------------------------------ step 7: tables

from arlens.operators import tables as TB  # noqa: E402


def _tspans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of the table pages, for queries that read them once."""
    return fixtures.table_spans(spark, sf_dir)


@q
def numeric_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numeric cells after the first per block row."""
    return TB.numeric_cells(_tspans(spark, sf_dir))


@q
def table_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans kept around the numeric extent of every page."""
    return TB.table_extent(_tspans(spark, sf_dir)).select("report", "page_no", "idx", "text")


@q
def interval_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cover count of every span start on both axes (before the cut)."""
    return TB.interval_cover(_tspans(spark, sf_dir))


@q
def interval_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """axis group of every start coordinate after the cut."""
    return TB.interval_groups(_tspans(spark, sf_dir)).withColumn("coord", r6("coord"))


@q
def table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compacted grid cells."""
    return TB.table_cells(TB.page_tables(_tspans(spark, sf_dir), with_cells=True))


@q
def table_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numeric tables with trimmed range, heading and block range."""
    t = TB.numeric_tables(TB.page_tables(_tspans(spark, sf_dir)))
    return t.drop("markdown").withColumn("numeric_share", r6("numeric_share"))


@q
def table_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown rendering of every numeric table."""
    t = TB.numeric_tables(TB.page_tables(_tspans(spark, sf_dir)))
    return t.select("report", "page_no", F.length("markdown").cast("bigint").alias("n_chars"), F.md5("markdown").alias("md5"))


@q
def table_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block html of the table pages with each table put in place of
    its block range (plain paragraphs, no headings)."""
    sp = _tspans(spark, sf_dir)
    th = TB.table_html(TB.number_tables(TB.numeric_tables(TB.page_tables(sp))))
    # The exchange that brings a page together serves its table, its blocks and the
    # page; only tables are brought to the blocks.
    blk = sp.select("report", "page_no", "block_no", "line_no", "span_no", "text").groupBy("report", "page_no", "block_no").agg(
        F.sort_array(F.collect_list(F.struct("line_no", "span_no", "text"))).alias("_s")
    ).select("report", "page_no", "block_no", F.concat(
        F.lit("\n<p>"), F.array_join(F.transform("_s", lambda x: F.concat(F.lit(" "), x["text"], F.lit(" "))), ""), F.lit("</p>")
    ).alias("html"))
    ins = TB.insert_tables(blk, th, sheet=["page_no"])
    pg = ins.groupBy("report", "page_no").agg(F.sort_array(F.collect_list(F.struct("block_no", "html"))).alias("_b"))
    page = F.array_join(F.transform("_b", lambda x: x["html"]), "")
    return pg.select("report", "page_no", F.length(page).cast("bigint").alias("n_chars"), F.md5(page).alias("md5"))


# ------------------------------------------------------------ step 3: sinks and incremental

from arlens.sources.ledger import read_ledger, write_ledger  # noqa: E402
from arlens.streaming import incremental as INC  # noqa: E402
from arlens.streaming import store  # noqa: E402

_RESULT_ROUND = {c: (8 if c.startswith("pval") else 6) for c in R.RESULT_COLS[3:15]}


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, _RESULT_ROUND[c]).alias(c) if c in _RESULT_ROUND else F.col(c) for c in df.columns])


def _stored_results(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str]:
    """Result rows of the reports up to 1997, stored by an earlier insert-if-absent run."""
    res = materialize(_result(spark, sf_dir).withColumn("year", report.report_identity_year("path")))
    path = INC.storage_path(spark, "results")
    INC.append_absent(spark, path, res.where(F.col("year") <= 1997), ["ISIN"], ["year", "path"])
    return res, path


@q
def ledger_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result rows, with a note of awkward text, written to the ';'
    ledger and read back typed."""
    note = F.concat(F.lit(' \t"'), "Name", F.lit('";\r\n\\ \'None\' '), "path", F.lit("\t "))
    res = _result(spark, sf_dir).withColumn("Note", note)
    cols = ["path"] + R.RESULT_COLS + ["Note"]
    path = INC.storage_path(spark, "ledger")
    write_ledger(res, path, cols)
    back = read_ledger(spark, path, res.select(*cols).schema)
    return _rounded(back)


@q
def result_insert_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored table after a second insert-if-absent run over all reports."""
    res, path = _stored_results(spark, sf_dir)
    INC.append_absent(spark, path, res, ["ISIN"], ["year", "path"])
    return _rounded(spark.read.parquet(path).select("path", "ISIN", "ISIN_db", "Name", "alpha_2", "Answer"))


@q
def result_key_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every report, whether its ISIN is already stored."""
    res, path = _stored_results(spark, sf_dir)
    return INC.key_exists(res.select("path", "ISIN"), spark.read.parquet(path), ["ISIN"])


@q
def result_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result table is created in the catalog, filled and dropped
    again; its columns (ordinal, name, type code and name, precision, length)
    with the non-null values in each."""
    from arlens.streaming import tables as CT

    name = f"arlens_results_{uuid.uuid4().hex}"
    columns = CT.create_result_table(spark, name, drop=True)
    try:
        _result(spark, sf_dir).select(*R.RESULT_COLS).write.insertInto(name)
        stored = spark.table(name).agg(*[F.count(c.name).alias(c.name) for c in columns]).first()
    finally:
        CT.drop_table(spark, name)
    if CT.table_exists(spark, name):
        raise RuntimeError(f"{name} was not dropped")
    rows = [(i, c.name, c.data_type, c.type_name, c.precision, c.length, stored[c.name]) for i, c in enumerate(columns)]
    return spark.createDataFrame(rows, "ordinal int, column_name string, data_type int, type_name string, column_precision int, column_length int, n_nonnull bigint")


@q
def key_uniqueness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of the result rows that occur more than once (the primary-key check)."""
    res = _result(spark, sf_dir)
    return res.groupBy("ISIN").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def _first_half() -> Column:
    """Reports that an earlier run has seen: half of them, by a digest of the name."""
    return F.substring(F.md5("report"), 1, 1) < "8"


def _sections_run(spark: SparkSession, sf_dir: str, reports: Column, folder: str) -> None:
    """Sections and status of the reports not seen yet are committed
    together.  The status table says what was seen, so unreadable and empty
    reports are not opened again either."""
    pages = fixtures.doc_pages(spark, sf_dir).where(reports)
    done = store.read(spark, folder, "status", "report string, status string")
    todo = materialize(INC.missing(pages.select("report").distinct(), done, ["report"]))
    spans = stored_input(spark, sf_dir, "doc_spans", fixtures.doc_spans)
    p = document.DocPlan(spans.join(todo, "report", "left_semi"), pages.join(todo, "report", "left_semi"))
    store.commit(spark, folder, {"sections": p.sections, "status": p.status.select("report", "status")})


@q
def incremental_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections stored for some reports are reused; only the reports that
    no run has seen go through the document pipeline.  ``n_opened`` counts how
    often a report was opened over three runs."""
    folder = INC.storage_path(spark, "sections")
    for reports in (_first_half(), F.lit(True), F.lit(True)):
        _sections_run(spark, sf_dir, reports, folder)
    opened = store.read(spark, folder, "status", "report string, status string").groupBy("report").agg(F.count("*").alias("n_opened"))
    s = store.read(spark, folder, "sections", "report string, i bigint, html string")
    return s.join(opened, "report").select("report", "i", F.length("html").cast("bigint").alias("n_chars"), F.md5("html").alias("md5"), "n_opened")


@q
def incremental_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries and conclusions stored by an earlier run are reused.
    For each report: sections summarised and conclusions drawn in the first run
    (half of the reports), in the second (all of them) and in the third, before
    which section 1 of that half was revised, and a digest of the conclusion that
    stands at the end."""
    folder = INC.storage_path(spark, "scores")
    secs = materialize(_doc_sections(spark, sf_dir))
    revised = secs.withColumn("html", F.when(_first_half() & (F.col("i") == 1) & (F.col("html") != ""), F.concat("html", F.lit(" Revised."))).otherwise(F.col("html")))
    counts = []
    for run, part in enumerate((secs.where(_first_half()), secs, revised), 1):
        summaries, new_s = INC.reuse(spark, folder, "summaries", part.where("html != ''"), ["report", "i"], scoring.summarize_sections)
        conclusions, new_c = INC.reuse(spark, folder, "conclusions", summaries, ["report"], scoring.conclude)
        counts += [new_s.groupBy("report").agg(F.count("*").alias(f"summaries_{run}")), new_c.groupBy("report").agg(F.count("*").alias(f"conclusions_{run}"))]
    out = secs.select("report").distinct()
    for c in counts:
        out = out.join(c, "report", "left")
    return out.fillna(0).join(conclusions.select("report", F.md5("summary").alias("summary_md5")), "report", "left")
