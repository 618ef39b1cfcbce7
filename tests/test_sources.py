"""Report-file scan (A1/A2) and result-table management."""

import os

from arlens.sources.reports import report_identity, scan_report_files
from arlens.streaming import tables as RT


def test_scan_skips_directories_and_parses_names(spark, tmp_path):
    d = str(tmp_path)
    for name in ["2001_ar_x_y_z_NO0010096985_v1.pdf", "2003_a_b_c_d_BMG2786A1062_x.pdf", "bad.pdf"]:
        with open(os.path.join(d, name), "wb") as f:
            f.write(b"%PDF")
    os.mkdir(os.path.join(d, "2002_ar_x_y_z_SUBDIR_v1.pdf"))
    for sub in ("2002_ar_x_y_z_SUBDIR_v1.pdf", "year=2004"):
        os.makedirs(os.path.join(d, sub), exist_ok=True)
        with open(os.path.join(d, sub, "2004_ar_x_y_z_INNER_v1.pdf"), "wb") as f:
            f.write(b"%PDF")
    got = {r.isin: (r.year, str(r.t0), str(r.t2))
           for r in report_identity(scan_report_files(spark, d), "path").collect()}
    assert got["NO0010096985"] == (2001, "2001-06-01", "2003-06-01")
    assert got["BMG2786A1062"][0] == 2003
    assert None in got and got[None] == (None, "None", "None")  # unparsable name: nulls, no exception
    assert "SUBDIR" not in got and "INNER" not in got and len(got) == 3
    assert report_identity(scan_report_files(spark, f"file:{d}/")).count() == 3


def test_result_table_lifecycle(spark):
    name = "arlens_result_test"
    RT.drop_table(spark, name)
    assert not RT.table_exists(spark, name)
    cols = RT.create_result_table(spark, name)
    assert [c.name for c in cols][:3] == ["ISIN", "ISIN_db", "Name"] and len(cols) == 16
    assert cols[3][1:5] == (6, "double", 53, 8) and cols[15][1:5] == (4, "int", 10, 4) and cols[0][1:5] == (-9, "string", None, None)
    assert RT.table_exists(spark, name)
    RT.create_result_table(spark, name)  # idempotent
    RT.drop_table(spark, name)
    RT.drop_table(spark, name)  # missing table ignored
    assert not RT.table_exists(spark, name)


def test_column_metadata(spark):
    RT.drop_table(spark, "arlens_types_test")
    spark.sql("CREATE TABLE arlens_types_test (a decimal(12,3), b varchar(50), c char(3), d bigint, e date, f array<int>, g boolean, h timestamp) USING parquet")
    try:
        got = {c.name: c[1:] for c in RT.column_metadata(spark, "arlens_types_test")}
    finally:
        RT.drop_table(spark, "arlens_types_test")
    assert got["a"] == (3, "decimal", 12, 14, 3) and got["b"][:4] == (12, "varchar", 50, 200) and got["c"][:4] == (1, "char", 3, 12)
    assert got["d"] == (-5, "bigint", 19, 8, 0) and got["e"][1] == "date" and got["f"] == (None, "array", None, None, None)


def test_extractor_marks_broken_files(spark, tmp_path):
    """A user's extractor over binary files: pages of whole files, one row with
    the error of a file it fails on, nothing for an empty one."""
    from arlens.sources.spans import extract_pages, flatten_pages, json_lines

    page = '{"width": 5.0, "height": 6.0, "blocks": [{"number": 0, "bbox": [0,0,1,1]}, {"number": 1, "bbox": [0,0,1,1], "lines": [{"bbox": [0,0,1,1], "spans": [{"text": "a\u2028b", "font": "F", "size": 9.0, "color": 0, "bbox": [0,0,1,1]}]}]}]}'
    for name, content in (("ok", '{"page_no": 3, "page": %s}\n' % page), ("cut", '{"page_no": 1, "page": %s}\n{"page_no' % page), ("empty", ""), ("odd", '{"page": {}}')):
        (tmp_path / name).write_text(content)
    (tmp_path / "bytes").write_bytes(b"\xff\xfe")
    got = extract_pages(spark.read.format("binaryFile").load(str(tmp_path)), json_lines)
    rows = {r.path.rpartition("/")[2]: (r.page_no, r.error) for r in got.collect()}
    assert rows == {"ok": (3, None), "cut": (None, "JSONDecodeError"), "odd": (None, "KeyError"), "bytes": (None, "UnicodeDecodeError")}
    from pyspark.sql import functions as F

    flat = flatten_pages(got.where("error is null").withColumn("report", F.lit("r"))).collect()
    assert [(r.page_no, r.block_no, r.text, r.page_w) for r in flat] == [(3, 1, "a\u2028b", 5.0)]


def test_ledger_keeps_newlines_and_text(spark, tmp_path):
    from arlens.sources.ledger import read_ledger, write_ledger

    rows = [("a", "line\nbreak", 1.5), ("b", "None", None), ("c", None, 2.0), ("d", 'semi;colon "quoted"', 0.0), ("e", "\\None", 1.0), ("f", "", 3.0), (" g ", " a b ", 4.0), ("h", "tab\t", 5.0), ("i", "\t\"x\" \r", 6.0), ("j", " ", 7.0)]
    df = spark.createDataFrame(rows, "k string, t string, v double")
    write_ledger(df, str(tmp_path / "l"), ["k", "t", "v"])
    got = {r.k: (r.t, r.v) for r in read_ledger(spark, str(tmp_path / "l"), df.schema).collect()}
    assert got == {"a": ("line\rbreak", 1.5), "b": ("None", None), "c": (None, 2.0), "d": ('semi;colon "quoted"', 0.0), "e": ("\\None", 1.0), "f": ("", 3.0), " g ": (" a b ", 4.0), "h": ("tab\t", 5.0), "i": ("\t\"x\" \r", 6.0), "j": (" ", 7.0)}


def test_pages_one_file_per_report(spark, tmp_path):
    from arlens.operators.html import read_pages, write_pages

    pages = spark.createDataFrame([("r1", "<p>a\n\nb</p>\n"), ("r2", "x")], "report string, page string")
    write_pages(pages, str(tmp_path / "pages"))
    assert sorted(p.name for p in (tmp_path / "pages").iterdir() if p.is_dir()) == ["report=r1", "report=r2"]
    assert sorted(map(tuple, read_pages(spark, str(tmp_path / "pages")).collect())) == [("r1", "<p>a\n\nb</p>\n"), ("r2", "x")]


def test_page_keeps_an_unclosed_heading(spark):
    from arlens.operators.html import html_page

    blocks = spark.createDataFrame([("r", 0, 0, "\n<p>a <h1>open</p>"), ("r", 1, 0, "\n<p>b</p>")], "report string, page_key long, block_no long, html string")
    page = html_page(blocks).first().page
    assert "<p>a <h1>open</p>\n<p>b</p>" in page and page.endswith("</body>\n</html>\n")


def test_insert_into_catalog_table(spark):
    name = "arlens_insert_test"
    RT.create_result_table(spark, name, drop=True)
    cols = RT.result_schema()
    new = spark.createDataFrame([(None, None, "n", *[None] * 12, 1), ("A", "A", "x", *[1.0] * 12, 2)], cols)
    from pyspark.sql import functions as F

    new = new.withColumn("year", F.lit(2000))
    for _ in range(2):
        RT.insert_absent_into(spark, name, new, ["ISIN"], ["year"])
    assert spark.table(name).count() == 2
    RT.drop_table(spark, name)
