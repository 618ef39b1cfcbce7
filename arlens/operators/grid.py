"""Geometry of table pages in one pass.

The spans of a page reach a task together and in order; everything from axis
groups to markdown is computed there for many pages at once, on arrays in which
a page is a segment.  Cover counts come from a sweep: the spans started so far
less the ends passed, found by rank among the sorted ends, so a page of n spans
costs n log n.  A task holds some ``HELD`` spans and one page.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need no copy of it

# Fixed value: a table is numeric above this share of numbers.
NUMERIC_SHARE = 0.2
#: Spans gathered before pages are worked on.
HELD = 100_000


def whole_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Runs of complete pages with the first row of each page.  Batches hold the
    rows of each (report, page_no), their first two columns, next to each other."""
    held: list[pa.RecordBatch] = []
    size = 0

    def edges(t: pa.Table) -> np.ndarray:
        new = np.zeros(t.num_rows, bool)
        for k in (0, 1):
            code = t.column(k).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            new[1:] |= code[1:] != code[:-1]
        new[:1] = True
        return np.flatnonzero(new)

    for b in batches:
        held.append(b)
        size += b.num_rows
        if size >= HELD:
            table = pa.Table.from_batches(held)
            first = edges(table)
            if len(first) > 1:
                yield table.slice(0, first[-1]), first[:-1]
                table = table.slice(first[-1])
            held, size = table.to_batches(), 0  # a page longer than HELD waits for its end
    if held:
        table = pa.Table.from_batches(held)
        if table.num_rows:
            yield table, edges(table)


class Cover(NamedTuple):
    """Spans in order of page, start and place (``order`` leads there from the
    rows), their position in the page and how many spans cover their start."""

    order: np.ndarray
    page: np.ndarray
    pos: np.ndarray
    count: np.ndarray


def _passed(page: np.ndarray, key_a: np.ndarray, key_b: np.ndarray, pos: np.ndarray, valid: np.ndarray, own: np.ndarray, n_pages: int) -> np.ndarray:
    """For each start, the ends before it among the spans marked ``own`` that
    started no later.  An end before its own start is passed at that start."""
    ends = np.sort(key_b[valid & own])
    before = np.concatenate([[0], np.cumsum(np.bincount(page[valid & own], minlength=n_pages))])[page]
    odd = np.concatenate([[0], np.cumsum(own & ~valid)])
    at = np.arange(len(page))
    return np.searchsorted(ends, key_a, "left") - before + odd[at + 1] - odd[at - pos]


def cover(page: np.ndarray, a: np.ndarray, b: np.ndarray, n_pages: int) -> tuple[Cover, np.ndarray]:
    """How many spans q <= p (in order of start) have their end at or behind
    the start of p; and the same after the cut of F4, in that order.

    The cut is the first position p >= 2 of a page whose count is below the one
    before it; from there on only spans from the cut on count.
    """
    order = np.lexsort((a, page))  # stable: rows come in page order
    page, a, b = page[order], a[order], b[order]
    start = np.searchsorted(page, np.arange(n_pages))
    pos = np.arange(len(page)) - start[page]
    rank = np.unique(np.concatenate([a, b]), return_inverse=True)[1]
    wide = rank.max(initial=0) + 1
    key_a, key_b = page * wide + rank[:len(a)], page * wide + rank[len(a):]
    valid, every = b >= a, np.ones(len(page), bool)
    count = pos + 1 - _passed(page, key_a, key_b, pos, valid, every, n_pages)
    drop = np.flatnonzero((pos >= 2) & (count < np.concatenate([[0], count[:-1]])))
    cut = np.full(n_pages, np.iinfo(np.int64).max)
    np.minimum.at(cut, page[drop], pos[drop])
    behind = pos >= cut[page]
    late = pos - np.where(behind, cut[page], 0) + 1 - _passed(page, key_a, key_b, pos, valid, behind, n_pages)
    return Cover(order, page, pos, count), np.where(behind, late, count)


def groups(page: np.ndarray, a: np.ndarray, b: np.ndarray, n_pages: int) -> np.ndarray:
    """group of every row's start: a new one begins where the count does
    not grow; rows with the same start take the group of the last of them."""
    at, count = cover(page, a, b, n_pages)
    grown = count - np.where(at.pos > 0, np.concatenate([[0], count[:-1]]), 0)
    new = (at.pos > 0) & (grown <= 0)
    total = np.cumsum(new)
    grp = total - total[np.arange(len(page)) - at.pos]
    start = a[at.order]
    last = np.ones(len(page), bool)
    last[:-1] = (start[1:] != start[:-1]) | (at.page[1:] != at.page[:-1])
    end = np.flatnonzero(last)
    grp = grp[end[np.searchsorted(end, np.arange(len(page)))]]
    out = np.empty(len(page), np.int64)
    out[at.order] = grp
    return out


def _dense(page: np.ndarray, group: np.ndarray, n_pages: int) -> np.ndarray:
    """Rank of each group among the page's, from 0."""
    wide = group.max(initial=0) + 1
    key, at = np.unique(page * wide + group, return_inverse=True)
    return at - np.searchsorted(key // wide, np.arange(n_pages))[page]


class Cells(NamedTuple):
    """Compacted cells in order of page, row and column; text None where blank."""

    page: np.ndarray
    row: np.ndarray
    col: np.ndarray
    text: np.ndarray
    number: np.ndarray
    block: np.ndarray


def cells(page: np.ndarray, gx: np.ndarray, gy: np.ndarray, text: np.ndarray, number: np.ndarray, block: np.ndarray, n_pages: int) -> Cells:
    """One cell for each pair of groups, the last span of it (rows come
    in page order); blank columns, then blank rows go."""
    order = np.lexsort((gx, gy, page))
    p, x, y = page[order], gx[order], gy[order]
    last = np.ones(len(p), bool)
    last[:-1] = (p[1:] != p[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    order = order[last]
    p, x, y = p[last], x[last], y[last]
    said = np.array([None if t is None or t in ("", " ", "  ") else t for t in text[order]], object)
    full = np.array([t is not None for t in said], bool)
    for axis in (0, 1):
        group = (x, y)[axis]
        wide = group.max(initial=0) + 1
        key, at = np.unique(p * wide + group, return_inverse=True)
        keep = (np.bincount(at, full, len(key)) > 0)[at]
        p, x, y, said, full, order = (v[keep] for v in (p, x, y, said, full, order))
    return Cells(p, _dense(p, y, n_pages), _dense(p, x, n_pages), said, number[order] & full, block[order])


class Tables(NamedTuple):
    """Numeric tables: page, rows a to b, columns, heading, blocks, share, text."""

    page: np.ndarray
    a: np.ndarray
    b: np.ndarray
    n_cols: np.ndarray
    heading: list
    block_a: np.ndarray
    block_b: np.ndarray
    share: np.ndarray
    markdown: list


def markdown(row: np.ndarray, col: np.ndarray, text: np.ndarray, a: int, n_cols: int) -> str:
    """Column 0 left aligned, others right aligned, two wider than the
    longest text, a rule after row ``a``.  Columns without a cell in these rows
    are not written."""
    wide = [-1] * n_cols
    lines: dict[int, dict[int, str]] = {}
    for r, c, t in zip(row.tolist(), col.tolist(), text):
        t = t or ""
        wide[c] = max(wide[c], len(t))
        lines.setdefault(r, {})[c] = t
    used = [c for c in range(n_cols) if wide[c] >= 0]
    out = []
    for r in sorted(lines):
        own = lines[r]
        out.append("|" + "".join(f" {own.get(c, ''):<{wide[c] + 1}}|" if c == 0 else f" {own.get(c, ''):>{wide[c] + 1}}|" for c in used) + "\n")
        if r == a:
            out.append("|" + "".join(" " + "-" * wide[c] + " |" for c in used) + "\n")
    return "".join(out)


def tables(c: Cells, n_pages: int) -> Tables:
    """Of each page the rows from the first to the last with content
    outside column 0, the text in column 0 above them ('' at the top, None where
    blank), their blocks, and the share of numbers among their cells outside
    column 0, empty ones included; only shares above ``NUMERIC_SHARE`` stay."""
    big = np.iinfo(np.int64).max
    body = (c.col > 0) & np.array([t is not None for t in c.text], bool)
    a, b, most = np.full(n_pages, big), np.zeros(n_pages, np.int64), np.zeros(n_pages, np.int64)
    np.minimum.at(a, c.page[body], c.row[body])
    np.maximum.at(b, c.page[body], c.row[body] + 1)
    np.maximum.at(most, c.page, c.col)
    inside = (c.row >= a[c.page]) & (c.row < b[c.page])
    numbers = np.bincount(c.page[inside & (c.col > 0) & c.number], minlength=n_pages)
    share = numbers / np.maximum((b - np.minimum(a, b)) * most, 1)
    block_a, block_b = np.full(n_pages, big), np.full(n_pages, -big)
    np.minimum.at(block_a, c.page[inside], c.block[inside])
    np.maximum.at(block_b, c.page[inside], c.block[inside])
    found = np.flatnonzero((a < big) & (share > NUMERIC_SHARE))
    above = np.flatnonzero((c.col == 0) & (c.row == a[c.page] - 1))
    title = dict(zip(c.page[above].tolist(), c.text[above]))
    first, last = np.searchsorted(c.page, found), np.searchsorted(c.page, found, "right")
    text = []
    for p, z, e in zip(found, first, last):
        k = np.flatnonzero(inside[z:e]) + z
        text.append(markdown(c.row[k], c.col[k], c.text[k], int(a[p]), int(most[p]) + 1))
    heading = ["" if a[p] == 0 else title.get(p) for p in found.tolist()]
    return Tables(found, a[found], b[found], most[found] + 1, heading, block_a[found], block_b[found], share[found], text)


# ------------------------------------------------- frames' batches in and out
#
# Input columns: report, page_no, idx, x0, x1, y0, y1 and, for tables, block_no,
# cell (text), number (whether it is one).


def _pages(t: pa.Table, first: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(first)), np.diff(np.append(first, t.num_rows)))


def _column(t: pa.Table, name: str) -> np.ndarray:
    return t.column(name).to_numpy()


def cover_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """report, page_no, axis, idx, cover of every span on both axes."""
    for t, first in whole_pages(batches):
        page = _pages(t, first)
        for axis in ("x", "y"):
            at, _ = cover(page, _column(t, f"{axis}0"), _column(t, f"{axis}1"), len(first))
            rows = t.select(["report", "page_no", "idx"]).take(pa.array(at.order))
            yield from pa.table({"report": rows["report"], "page_no": rows["page_no"], "axis": [axis] * len(page), "idx": rows["idx"], "cover": at.count}).to_batches()


def group_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """report, page_no, axis, coord, grp: one row for each start of a page."""
    for t, first in whole_pages(batches):
        page = _pages(t, first)
        for axis in ("x", "y"):
            a = _column(t, f"{axis}0")
            grp = groups(page, a, _column(t, f"{axis}1"), len(first))
            order = np.lexsort((a, page))
            new = np.ones(len(page), bool)
            new[1:] = (a[order][1:] != a[order][:-1]) | (page[order][1:] != page[order][:-1])
            rows = t.select(["report", "page_no"]).take(pa.array(order[new]))
            yield from pa.table({"report": rows["report"], "page_no": rows["page_no"], "axis": [axis] * rows.num_rows, "coord": a[order[new]], "grp": grp[order[new]]}).to_batches()


def table_batches(batches: Iterator[pa.RecordBatch], with_cells: bool) -> Iterator[pa.RecordBatch]:
    """report, page_no, cells (null unless asked for) and table (null where the
    page has no numeric one); one row a page."""
    for t, first in whole_pages(batches):
        n, page = len(first), _pages(t, first)
        gx, gy = (groups(page, _column(t, f"{k}0"), _column(t, f"{k}1"), n) for k in "xy")
        c = cells(page, gx, gy, _column(t, "cell"), _column(t, "number"), _column(t, "block_no"), n)
        found = tables(c, n)
        key = t.select(["report", "page_no"]).take(pa.array(first)).combine_chunks()
        names = ("row", "col", "text", "block_no")
        kept = [pa.nulls(n, pa.list_(pa.struct([(k, pa.string() if k == "text" else pa.int64()) for k in names])))]
        if with_cells:
            flat = pa.StructArray.from_arrays([pa.array(c.row, pa.int64()), pa.array(c.col, pa.int64()), pa.array(c.text, pa.string()), pa.array(c.block, pa.int64())], list(names))
            kept = [pa.ListArray.from_arrays(pa.array(np.searchsorted(c.page, np.arange(n + 1)), pa.int32()), flat)]
        fields = [pa.array(found.a), pa.array(found.b), pa.array(found.n_cols), pa.array(found.heading, pa.string()), pa.array(found.block_a), pa.array(found.block_b), pa.array(found.share), pa.array(found.markdown, pa.string())]
        table = pa.StructArray.from_arrays(fields, ["a", "b", "n_cols", "heading", "block_a", "block_b", "numeric_share", "markdown"])
        at = np.searchsorted(found.page, np.arange(n))
        there = np.isin(np.arange(n), found.page)
        table = table.take(pa.array(np.minimum(at, max(len(found.page) - 1, 0)), mask=~there))
        yield pa.RecordBatch.from_arrays([key["report"].combine_chunks(), key["page_no"].combine_chunks(), *kept, table], ["report", "page_no", "cells", "table"])
