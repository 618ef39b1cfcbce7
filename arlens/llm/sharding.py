"""Operator 9: shards of near-equal bytes by sampled splitters.

A size-weighted sample of the keys gives quantile boundaries; the rows are
range-partitioned by them; ranges that came out overfull are subdivided from a
second sample of their own rows.  The exact bytes and rows of every range (one
partial aggregate) then place each row in the global order, and a shard is a
contiguous part of that order.

The key is (hash of the text, row number), so equal texts are neighbours and
fall into one shard, while a text that holds a third of all rows can still be
split between rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arlens.llm.common import cut

#: Rows that one range should hold, the least number of ranges for each shard,
#: and sampled keys for each range.  The driver sees about SAMPLE keys a range.
ROWS_PER_RANGE = 2_000_000
RANGES_PER_SHARD = 8
SAMPLE = 24
#: A range is overfull beyond this many times the mean of all ranges.
OVERFULL = 3.0
#: Groups of equal texts up to this share of a shard are kept in one shard: the
#: shard's end moves to the nearer edge of the group, by half of it at most.  A
#: larger group alone would make shards uneven and is cut where a shard ends.
GROUP_SHARE = 1 / 3
_HASH_SPAN = float(2**63)


def _draw(rows: DataFrame, rate: float, salt: int) -> list:
    """Rows drawn with probability size * rate, by a hash and so repeatable."""
    u = F.xxhash64(F.lit(salt), "_key", "_row").cast("double") / _HASH_SPAN / 2 + F.lit(0.5)
    picked = rows.filter(u < F.col("_size") * F.lit(rate)).select("_key", "_row", "_size").collect()
    return sorted((r["_key"], r["_row"], max(1.0, r["_size"] * rate)) for r in picked)


def _quantiles(sample: list, parts: int) -> list[tuple[int, int]]:
    """Boundaries that cut the weighted, sorted sample into ``parts``.

    A boundary inside a run of equal keys moves to the start of the run, except
    where the run alone is wider than a part; there it cuts between its rows.
    """
    if not sample:
        return []
    weight = np.array([w for _, _, w in sample])
    before = np.cumsum(weight) - weight
    step = weight.sum() / parts
    run: dict[int, float] = {}
    for k, _, w in sample:
        run[k] = run.get(k, 0.0) + w
    out = set()
    for b in range(1, parts):
        k, row, _ = sample[min(int(np.searchsorted(before, b * step)), len(sample) - 1)]
        out.add((k, row) if run[k] > step else (k, -1))
    return sorted(out)


def _range_of(rows: DataFrame, bounds: list[tuple[int, int]]) -> DataFrame:
    """``_range``: how many boundaries are at or before the row's key.  The
    boundaries travel with the function; their number is bounded by the caller."""
    keys = np.array([k for k, _ in bounds], dtype=np.int64)
    at = np.array([r for _, r in bounds], dtype=np.int64)

    @F.pandas_udf("int")
    def place(key: pd.Series, row: pd.Series) -> pd.Series:
        k, r = key.to_numpy(), row.to_numpy()
        lo, hi = np.searchsorted(keys, k, "left"), np.searchsorted(keys, k, "right")
        for i in np.flatnonzero(hi > lo):
            lo[i] += np.searchsorted(at[lo[i]:hi[i]], r[i], "right")
        return pd.Series(lo.astype(np.int32))

    return rows.withColumn("_range", place("_key", "_row"))


def shard_by_bytes(df: DataFrame, key: F.Column, size: F.Column, shards: int = 40) -> DataFrame:
    """``df`` with ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0).

    key: long that equal records share; size: bytes of a record (at least 1).
    Every row is kept.  Null keys form one group (hash 0), empty tables give no
    rows, a repeated row is a row of its own; input columns named ``shard`` or
    ``slot`` are replaced.  Shards differ from the mean by at most half of
    GROUP_SHARE of a shard plus one record.
    """
    spark = df.sparkSession
    df = df.drop("shard", "slot")
    names = df.columns
    rows = cut(df.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_data"), F.coalesce(key, F.lit(0).cast("long")).alias("_key"), F.greatest(size.cast("long"), F.lit(1)).alias("_size"), F.monotonically_increasing_id().alias("_row")))
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("_size"), F.lit(0))).first()
    parts = max(shards * RANGES_PER_SHARD, -(-n // ROWS_PER_RANGE))
    bounds = _quantiles(_draw(rows, parts * SAMPLE / max(total, 1), 1), parts)
    for salt in range(2, 6):
        ranged = _range_of(rows, bounds)
        stats = sorted(ranged.groupBy("_range").agg(F.count("*").alias("n"), F.sum("_size").alias("b")).collect())
        wide = {s["_range"]: -(-s["b"] * parts // max(total, 1)) for s in stats if s["n"] > 1 and (s["b"] * parts > OVERFULL * total or s["n"] > OVERFULL * ROWS_PER_RANGE)}
        if not wide:
            break
        extra = []
        over = ranged.filter(F.col("_range").isin(list(wide)))
        drawn = _draw(over, parts * SAMPLE * 2 / max(total, 1), salt)
        edges = [(-(2**63), -1), *bounds, (2**63 - 1, 2**62)]
        for r, pieces in wide.items():
            inside = [x for x in drawn if edges[r] <= x[:2] < edges[r + 1]]
            extra += _quantiles(inside, int(max(2, pieces)))
        if not set(extra) - set(bounds):
            break
        bounds = sorted({*bounds, *extra})
    before_b = before_n = 0
    offsets = []
    for s in stats:
        offsets.append((s["_range"], before_n, before_b))
        before_n, before_b = before_n + s["n"], before_b + s["b"]
    # A group that boundaries cut lies in several ranges; these are as few as the boundaries.
    cut_keys = sorted({k for k, row in bounds if row >= 0})
    large = [k for k, b in ranged.filter(F.col("_key").isin(cut_keys)).groupBy("_key").agg(F.sum("_size")).collect() if b * shards > GROUP_SHARE * total] if cut_keys else []
    # one row a range: bounded by the number of boundaries
    offset = spark.createDataFrame(offsets, "_range int, _n0 long, _b0 long")
    in_order = Window.partitionBy("_range").orderBy("_key", "_row")
    whole = Window.partitionBy("_range", "_key")
    placed = (
        ranged.join(F.broadcast(offset), "_range")
        .withColumn("_at", F.col("_n0") + F.row_number().over(in_order) - 1)
        .withColumn("_to", F.col("_b0") + F.sum("_size").over(in_order))
        .withColumn("_group", F.sum("_size").over(whole))
        .withColumn("_from", F.min(F.col("_to") - F.col("_size")).over(whole))
    )
    kept = (F.col("_group") * shards <= F.lit(GROUP_SHARE * total)) & ~F.col("_key").isin(large)
    mid = F.when(kept, F.col("_from") + F.col("_group") / 2).otherwise(F.col("_to") - F.col("_size") / 2)
    placed = cut(placed.select("_data", "_at", F.least(F.floor(mid * shards / F.lit(max(total, 1))), F.lit(shards - 1)).cast("int").alias("shard")))
    first = placed.groupBy("shard").agg(F.min("_at").alias("_first"))
    return placed.join(F.broadcast(first), "shard").select("_data.*", "shard", (F.col("_at") - F.col("_first")).alias("slot"))
