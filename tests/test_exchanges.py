"""Steps whose shuffled and written bytes must not grow beyond their input."""

import os

import numpy as np
from pyspark.sql import functions as F

SPAN = "report string, page_no long, page_w double, page_h double, block_no long, line_no long, span_no long, text string, font string, size double, color int, x0 double, y0 double, x1 double, y1 double"


def page_spans(spark, reports=4, pages=3):
    """Pages of three blocks: two lines of one span each, and one of two fonts."""
    rows = []
    for r in range(reports):
        for p in range(pages):
            cells = [(0, 0, 0, " head ", "B"), (0, 1, 0, "12", "B"), (1, 0, 0, "bold ", "B-Bold"), (1, 0, 1, " plain", "B"), (2, 0, 0, f"t{r}.{p}", "B")]
            for k, (b, line, s, text, font) in enumerate(cells):
                rows.append((f"r{r}", p, 500.0, 700.0, b, line, s, text, font, 10.0, 0, 10.0 * k, 10.0 * b, 10.0 * k + 5, 10.0 * b + 8))
    box = {f"{k}_{x}": F.col(x) for k in ("line", "block") for x in ("x0", "x1")}
    return spark.createDataFrame(rows, SPAN).withColumns(box)


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_blocks_need_only_the_exchange_of_the_page_split(spark):
    from arlens.operators import boilerplate, layout

    blk = boilerplate.blocks(layout.page_split(page_spans(spark)))
    assert exchanges(blk) == 1
    got = blk.where("report = 'r0' and page_key = 0").orderBy("block_no").collect()
    assert [(r.block_key, r.n_lines, r.text_len, r.plain_len, r.n_private) for r in got] == [("B10.0: head ", 2, 10, 13, 0), ("B-Bold10.0:bold ;B10.0: plain", 1, 12, 16, 0), ("B10.0:t0.0", 1, 5, 7, 0)]
    assert [[s.text for s in r.spans] for r in got] == [[" head ", "12"], ["bold ", " plain"], ["t0.0"]]


def test_font_entries_gather_lines_once(spark):
    from arlens.operators import boilerplate, fonts, layout
    from arlens.plans.joins import materialize

    blk = materialize(boilerplate.blocks(layout.page_split(page_spans(spark, 1, 1))))
    off = materialize(boilerplate.offsets(blk))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        e = fonts.font_entries(boilerplate.block_spans(blk), off)
        assert exchanges(e) == 2  # spans and offsets, each by block
        got = sorted((r.ord.block_no, r.ord.line_no, r.ord.span_no, r.font_key, r.pos, r.text) for r in e.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert got == [(0, 0, 0, "B:10.0:0", 10, "head"), (0, 1, 0, "B:10.0:0", 10, "12"), (1, 0, 0, "B-Bold:10.0:0", 27, "bold"), (1, 0, 1, "B:10.0:0", 33, "plain"), (2, 0, 0, "B:10.0:0", 27, "t0.0")]


def test_numeric_cells_meet_by_one_exchange(spark):
    from arlens.operators.tables import numeric_cells

    n = numeric_cells(page_spans(spark))
    assert exchanges(n) == 1
    assert sorted(map(tuple, n.where("report = 'r1' and page_no = 2").collect())) == [("r1", 2, 0, 2, 1), ("r1", 2, 1, 1, 0), ("r1", 2, 2, 1, 0)]


def test_pages_are_nested_by_one_exchange_and_written_as_a_file_for_each_report(spark, tmp_path):
    from arlens.sources.fixtures import write_page_files
    from arlens.sources.spans import flatten_pages, nest_pages

    spans = page_spans(spark, 6, 12).repartition(5)
    pages = nest_pages(spans)
    assert exchanges(pages) == 1
    assert flatten_pages(pages).count() == spans.count()
    folder = str(tmp_path / "documents")
    dealt = pages.repartition(8, F.rand(1))
    write_page_files(dealt, folder)
    files = {d: [f for f in os.listdir(f"{folder}/{d}") if f.startswith("part-")] for d in os.listdir(folder) if d.startswith("report=r")}
    assert len(files) == 6 and all(len(f) == 1 for f in files.values())


def test_stored_frames_are_compressed(spark):
    from arlens.plans.joins import materialize

    df = spark.range(20000).select(F.lit("the same words again and again ").alias("t"), "id")
    stored = materialize(df)
    assert stored.count() == 20000
    assert stored.inputFiles()
    assert sum(os.path.getsize(f.removeprefix("file://")) for f in stored.inputFiles()) < 20000 * 31


def test_every_window_trains_the_network():
    from arlens.llm import recurrent as R

    n = np.ones(R.OWN)
    net = R.new_net(n, np.ones(R.ENDINGS))
    rare = R.MEMBERS * 5 + 3  # of a class that comes behind the first window only
    text = np.ones(4 * R.WINDOW, np.int32)
    text[R.WINDOW + 2] = text[3 * R.WINDOW - 1] = rare
    text[-1] = 0
    got = R.train(net, [text])
    assert np.any(got.inner_b[5] != net.inner_b[5])


def test_table_pages_meet_once_and_are_sorted_once(spark):
    """The items of an order meet by one exchange, and the page stays together;
    the extent's order is the one that the geometry reads."""
    from arlens.operators import tables as TB
    from arlens.sources import fixtures

    made = TB.interval_cover(fixtures.table_spans(spark, "/root/testdata/sf0.001"))
    assert exchanges(made) == 1
    given = page_spans(spark)
    plan = TB.interval_cover(given)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 1


def test_table_spans_of_few_items(spark, tmp_path):
    """Header rows come once an order, the last row behind its last item; repeated
    items and orders without a key keep their rows."""
    from arlens.sources import fixtures

    rows = [(1, 2, 7, 3.0, 1234.5, 0.05), (1, 1, 7, 2.0, 10.0, 0.1), (1, 1, 7, 2.0, 10.0, 0.1), (20, 1, 7, 2.0, 10.0, 0.1), (5, 1, 7, 2.0, None, 0.1), (None, 1, 7, 2.0, 10.0, 0.1)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_quantity double, l_extendedprice double, l_discount double").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {}
    for r in fixtures.table_spans(spark, str(tmp_path)).orderBy("page_no", "block_no", "line_no").collect():
        got.setdefault(r.page_no, []).append((r.block_no, r.text))
    head = [(2, "Line"), (2, "Quantity"), (2, "Price"), (2, "Discount")]
    assert got[1] == [(0, "Lines"), (1, "Order lines 1"), *head, (3, "Item 1"), (3, "2"), (3, "10.00"), (3, "0.10"), (4, "Item 2"), (4, "2"), (4, "10.00"), (4, "0.10"),
                      (5, "Item 3"), (5, "3"), (5, "1,234.50"), (5, "0.05"), (6, "End of page")]
    assert got[20] == [(0, "Lines"), (1, "Order lines 20"), *head, (3, "Item 1"), (3, "qty"), (3, "price"), (3, "disc"), (4, "End of page")]
    assert got[5][6:] == [(3, "Item 1"), (3, "2"), (3, None), (3, ""), (4, "End of page")]
    assert got[None] == [(0, "Lines"), (1, None), *head, (3, "Item 1"), (3, "2"), (3, "10.00"), (3, "0.10"), (4, "End of page")]


def test_outputs_by_the_run_give_the_gradients_of_all(monkeypatch):
    """Positions are worked on in runs; runs of any length add up to the same."""
    from arlens.llm import recurrent as R

    rng = np.random.default_rng(3)
    net = R.new_net(rng.integers(1, 90, R.OWN).astype(float), np.full(R.ENDINGS, 9.0))
    net = R.Net(*[x + 0.2 * rng.standard_normal(x.shape).astype(np.float32) for x in net])
    h = np.tanh(rng.standard_normal((300, R.STATE))).astype(np.float32)
    target = rng.integers(0, R.OWN + R.ENDINGS, 300)
    got = []
    for run in (7, 300):
        monkeypatch.setattr(R, "OUTPUTS", run)
        grads: list = []
        got.append((R.predict(net, h, target, grads), *grads))
    for a, b in zip(*got):
        assert np.allclose(a, b, rtol=1e-4, atol=1e-4)
    assert np.allclose(got[0][0], R.predict(net, h, target), rtol=1e-5)


def test_long_texts_alone_are_scored_in_long_windows(monkeypatch):
    from arlens.llm import recurrent as R

    net = R.new_net(np.ones(R.OWN), np.ones(R.ENDINGS))
    text = np.append(np.ones(2047, np.int32), 0)
    calls, predict = [], R.predict
    monkeypatch.setattr(R, "predict", lambda *a: calls.append(len(a[2])) or predict(*a))
    R.log_likelihood(net, [text])
    assert sum(calls) == 2048 and len(calls) <= 8


def test_keys_of_blocks_stay_where_hashes_that_repeat_are_stored(spark):
    """Hashes that repeat are few and are stored first, so the join sends them to
    the blocks; the keys of all short blocks met by an exchange before."""
    from arlens.operators import boilerplate
    from arlens.plans.joins import materialize

    rows = [(f"r{k % 2}", k, 0, "head" if k % 3 else f"own{k}", 1 + k % 6) for k in range(60)]
    blk = materialize(spark.createDataFrame(rows, "report string, page_key long, block_no long, block_key string, n_lines long"))
    often = materialize(boilerplate.often_hashes(blk))
    rep = boilerplate.repeated_keys(blk, often)
    plan = rep._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and exchanges(rep) == 1
    want = {}
    for r, _, _, key, n in rows:
        want[r, key] = want.get((r, key), 0) + (n <= 5)
    assert sorted(map(tuple, rep.collect())) == sorted((*k, n) for k, n in want.items() if n > 10)
    assert sorted(map(tuple, boilerplate.repeated_keys(blk).collect())) == sorted(map(tuple, rep.collect()))


def test_distinct_texts_meet_as_digests_of_16_bytes(spark):
    from arlens.operators import fonts

    rows = [("r", "F", p, t, (0, p, 0, 0)) for p, t in enumerate(["a", "b", "a", "", None, "b"])]
    s = fonts.font_stats(spark.createDataFrame(rows, "report string, font_key string, pos long, text string, ord struct<page_key:long,block_no:long,line_no:long,span_no:long>"))
    assert "unhex(md5(" in s._jdf.queryExecution().executedPlan().toString()
    assert [(r.n_entries, r.n_distinct, r.text_len) for r in s.collect()] == [(6, 3, 4)]


def test_block_rows_stored_by_page_stay_where_they_are(spark):
    """What is known of a page comes to its stored blocks; entries, candidates,
    tables and html exchange no block row with its spans."""
    from arlens.operators import boilerplate, fonts, headings, html, layout, tables
    from arlens.plans.joins import materialize, materialize_by

    given = page_spans(spark, 2, 12).withColumn("text", F.when(F.col("text") == "t0.3", " head ").otherwise(F.col("text")))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        blk = materialize_by(boilerplate.blocks(layout.page_split(given)), "page_no", "report")
        rep = materialize(boilerplate.repeated_keys(blk).where("block_key not like 'B-Bold%'"))
        assert sorted(map(tuple, rep.collect())) == [("r0", "B10.0: head ", 13), ("r1", "B10.0: head ", 12)]
        reports = spark.createDataFrame([("r0",)], "report string")
        marks = materialize(boilerplate.page_marks(materialize(boilerplate.page_summary(blk, rep)), reports))
        kept = boilerplate.kept_on_pages(blk, marks)
        assert exchanges(kept) == 1  # of the marks
        placed = boilerplate.placed(kept)
        e = fonts.font_entries(placed)
        assert exchanges(e) == 1
        old = boilerplate.remove_repeated(blk, rep).where("report = 'r0'")
        want = fonts.font_entries(boilerplate.block_spans(old), boilerplate.offsets(old))
        assert sorted(map(tuple, e.collect())) == sorted(map(tuple, want.collect()))
        font = materialize(spark.createDataFrame([("r0", "B-Bold:10.0:0")], "report string, heading_font string"))
        cands = headings.heading_candidates(boilerplate.placed(headings.in_heading_font(boilerplate.kept_on_pages(blk, materialize(marks.join(font, "report"))))))
        assert exchanges(cands) == 1
        got = [(r.page_key, r.block_no, r.plain_before, r.text) for r in cands.orderBy("page_key").collect()]
        before = {(r.page_key, r.block_no): r.plain_before for r in boilerplate.offsets(old).collect()}
        assert got == [(2 * p, 1, before[2 * p, 1], "bold ") for p in range(12)]
        accepted = materialize(cands.withColumn("accepted", F.col("page_key") == 4))
        page = html.block_html(kept, accepted)
        assert exchanges(page) == 2  # of the marks and the headings
        made = {(r.page_key, r.block_no): r.html for r in page.collect()}
        assert len(made) == 23 and made[4, 1] == "\n<p><h1><b>bold </b></h1>\n  plain </p>" and made[0, 1] == "\n<p> <b>bold </b>   plain </p>"
        sheets = kept.select("report", F.col("page_no").alias("sheet"), F.col("page_key").alias("page_no"), "block_no", F.inline("spans"))
        assert exchanges(tables.interval_cover(sheets)) == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_tables_are_inserted_where_pages_lie(spark):
    from arlens.operators.tables import insert_tables

    blocks = spark.createDataFrame([("r", 5, 10 + h, b, f"{h}{b}") for h in (0, 1) for b in range(4)], "report string, page_no long, page_key long, block_no long, html string")
    found = spark.createDataFrame([("r", 11, 5, 1, 3, "T")], "report string, page_key long, page_no long, block_a long, block_b long, table_html string")
    want = insert_tables(blocks, found.drop("page_no"), "page_key")
    got = insert_tables(blocks, found, "page_key", ["page_no", "report"])
    alone = insert_tables(blocks, found, "page_key", ["page_no"])
    assert sorted(map(tuple, alone.collect())) == sorted(map(tuple, want.collect()))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert [r.html for r in got.orderBy("page_key", "block_no").collect()] == ["00", "01", "02", "03", "10", "T", "13"]


def test_table_insert_brings_tables_to_the_blocks(spark):
    """Items meet once, for tables and blocks; tables go by report for their number
    and by page to the blocks."""
    import __spark_entry__ as E

    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made = E.queries()["table_insert"](spark, "/root/testdata/sf0.001")
        assert exchanges(made) == 4  # the items, alike for tables and blocks, and the tables twice
        assert "table-" not in made._jdf.queryExecution().executedPlan().toString()  # no spans are stored
        assert made.count() > 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_page_files_are_gzipped_and_read_either_way(spark, tmp_path):
    import gzip

    from arlens.sources.fixtures import write_page_files
    from arlens.sources.spans import extract_pages, flatten_pages, json_lines, nest_pages

    spans = page_spans(spark, 2, 40)
    pages = nest_pages(spans)
    write_page_files(pages, f"{tmp_path}/documents")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{tmp_path}/documents")
    got = extract_pages(files, json_lines).withColumn("report", F.regexp_extract("path", "report=([^/]*)/", 1)).collect()
    assert [(r.report, r.error) for r in got if r.error] == [("broken", "JSONDecodeError")]
    made = spark.createDataFrame([(r.report, r.page_no, r.page_json) for r in got if not r.error], "report string, page_no long, page_json string")
    columns = ["report", "page_no", "block_no", "line_no", "span_no", "text", "x0"]
    assert sorted(map(tuple, flatten_pages(made).select(*columns).collect())) == sorted(map(tuple, spans.select(*columns).collect()))
    size = sum(r.length for r in files.select("length").collect())
    assert size < 0.2 * sum(len(r.page_json) for r in got if not r.error)
    line = b'{"page_no": 3, "page": {"blocks": []}}\n'
    assert list(json_lines(line)) == list(json_lines(gzip.compress(line))) == [(3, {"blocks": []})]


def test_security_rows_are_dealt_once_for_their_windows(spark):
    """Rows meet by security and fiscal year for the filter, the DISTINCT and the
    windows, which hold both of their ends; none is repeated before that."""
    import datetime as dt

    from arlens.plans import report

    days = [dt.date(2000, 5, 31), dt.date(2000, 6, 1), dt.date(2001, 5, 31), dt.date(2001, 6, 1), dt.date(2002, 6, 1), dt.date(2002, 6, 2), None]
    own = [("A", "n", d, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.0) for d in days]
    equity = spark.createDataFrame([*own, *own, ("B", "n", *own[1][2:])], "isin string, name string, date date, smb double, hml double, liq double, mom double, ln_delta_p double, ln_delta_mkt double, bills_ln_rate double")
    reports = spark.createDataFrame([("p", "A", 2000), ("q", "A", 1998), ("r", None, 2000), ("s", "A", None)], "path string, isin_db string, year int")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = report.window_rows(reports, equity)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 3 and plan.count("Generate explode(sequence") == 2  # rows once; windows for the filter and the join
        rows = sorted((r.path, r.horizon, r.date) for r in got.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert got.columns == ["isin", "name", "date", "smb", "hml", "liq", "mom", "rx", "rm", "path", "horizon"]
    assert rows == [*[("p", 1, d) for d in days[1:4]], *[("p", 2, d) for d in days[1:5]], *[("q", 2, d) for d in days[:2]]]
