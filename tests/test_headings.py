"""Heading acceptance against a plain fold."""

import random

from arlens.operators.headings import MIN_GAP, accept_headings

COLS = "report string, page_key long, block_no long, line_no long, span_no long, plain_before long, text string, font string, head_key string"


def fold(rows):
    last, used, out = None, set(), []
    for r in sorted(rows, key=lambda r: r[1:5]):
        take = r[8] is not None and r[8] not in used and (last is None or r[5] - last >= MIN_GAP)
        if take:
            last = r[5]
            used.add(r[8])
        out.append((*r[:5], take))
    return out


def test_many_candidates_of_one_report(spark):
    """50,000 candidates in one report, beside small ones."""
    rng = random.Random(2)
    rows, at = [], 0
    for k in range(50_000):
        at += rng.randrange(0, 1500)
        rows.append(("big", k // 7, k % 7, 0, 0, at, "t", "F", None if k % 911 == 5 else f"h{rng.randrange(30_000)}"))
    small = [(f"r{k}", 0, j, 0, 0, 700 * j, "t", "F", f"h{j % 3}") for k in range(20) for j in range(9)]
    shuffled = rows + small
    rng.shuffle(shuffled)
    got = accept_headings(spark.createDataFrame(shuffled, COLS).repartition(5)).collect()
    want = fold(rows) + [x for k in range(20) for x in fold([r for r in small if r[0] == f"r{k}"])]
    assert sorted((r.report, r.page_key, r.block_no, r.line_no, r.span_no, r.accepted) for r in got) == sorted(want)


def test_no_candidates(spark):
    assert accept_headings(spark.createDataFrame([], COLS)).count() == 0
