"""Running sums in document order without putting a document in one task.

Document order is (page, block) inside a report.  A running sum over a whole
report as one window would place every row of the report in a single task;
instead the sum is taken in two levels: page totals (a mergeable aggregate),
an exclusive running sum over the pages of a report (one row per page), and
a running sum inside each page, joined on (report, page).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def running_sums(df: DataFrame, part: list[str], page: str, inner: list[str], sums: dict[str, tuple[str, bool]]) -> DataFrame:
    """Adds a column for each ``out: (value, inclusive)`` of ``sums``: the sum of
    ``value`` over rows of the same ``part`` that come before (and, if
    ``inclusive``, at) each row in (page, *inner) order.  All of them share one
    pass: page totals, running totals of pages, and the sum inside the page."""
    return in_page_sums(df.join(page_bases(df, part, page, sums), [*part, page]), part, page, inner, sums)


def page_bases(df: DataFrame, part: list[str], page: str, sums: dict[str, tuple[str, bool]], more: list[str] | None = None) -> DataFrame:
    """One row a page with ``_b_{out}``, each sum over the pages before it.  ``more``:
    further columns of rows that are one a page already."""
    if more is None:
        totals = df.groupBy(*part, page).agg(*[F.sum(v).alias(f"_t_{out}") for out, (v, _) in sums.items()])
    else:
        totals = df.select(*part, page, *more, *[F.col(v).alias(f"_t_{out}") for out, (v, _) in sums.items()])
    before = Window.partitionBy(*part).orderBy(page).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(*part, page, *(more or []), *[F.coalesce(F.sum(f"_t_{out}").over(before), F.lit(0)).alias(f"_b_{out}") for out in sums])


def in_page_sums(df: DataFrame, part: list[str], page: str, inner: list[str], sums: dict[str, tuple[str, bool]]) -> DataFrame:
    """The running sums of rows that hold their page's ``page_bases``."""
    in_page = Window.partitionBy(page, *part).orderBy(*inner)
    for out, (v, inclusive) in sums.items():
        frame = in_page.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
        df = df.withColumn(out, (F.col(f"_b_{out}") + F.coalesce(F.sum(v).over(frame), F.lit(0))).cast("bigint"))
    return df.drop(*[f"_b_{out}" for out in sums])
