"""Operator 12: importance resampling towards a target distribution.

Runs of one to three words are hashed into buckets.  A bucket's gain is the log
ratio of its share in the target texts to that in all documents; a document's
weight is the sum of its features' gains, and Gumbel noise from a hash of its id
turns the largest sums into a draw without replacement.

Features are made by Arrow kernels a batch at a time: lower case, split,
flatten, dictionary.  Shifted dictionary indices form the runs, a crc is taken
once for each distinct run, and gains are taken by bucket and reduced over each
document's segment.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arlens.llm.common import cut, slices

# Fixed values of the features, the gains and the draw.
BREAK = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
LONGEST, BUCKETS, SCALE = 3, 10_000, 1000
SEED, LEAST_WORDS, PERCENT = 42, 20, 5
#: Bytes of text taken at a time; a longer text is taken alone.
SLICE = 4_000_000


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, bucket) of every feature and the number of words of each
    text (no nulls among ``texts``)."""
    split = pc.split_pattern_regex(pc.ascii_lower(texts), BREAK)
    word, owner = pc.list_flatten(split), pc.list_parent_indices(split)
    some = pc.not_equal(word, "")
    coded = word.filter(some).dictionary_encode()
    owner = owner.filter(some).to_numpy(zero_copy_only=False)
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    spelt = [w.encode() for w in coded.dictionary.to_pylist()]
    behind = [b" " + w for w in spelt]
    crc = np.array([zlib.crc32(w) for w in spelt], np.int64)
    found = [(owner, crc[code] % BUCKETS)] if len(code) else []
    run = code
    for length in range(2, LONGEST + 1):
        if len(code) < length:
            break
        inside = owner[length - 1:] == owner[:len(owner) - length + 1]
        # a run is the run before it, already numbered, and one more word
        pair = pa.array(run[:len(code) - length + 1] * len(spelt) + code[length - 1:]).dictionary_encode()
        head, tail = np.divmod(pair.dictionary.to_numpy(), len(spelt))
        crc = np.fromiter((zlib.crc32(behind[t], c) for t, c in zip(tail.tolist(), crc[head].tolist())), np.int64, len(head))
        run = pair.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        found.append((owner[:len(run)][inside], crc[run[inside]] % BUCKETS))
    words = np.bincount(owner, minlength=len(texts))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), words
    return np.concatenate([o for o, _ in found]), np.concatenate([b for _, b in found]), words


def bucket_counts(texts: DataFrame, text_col: str = "text") -> np.ndarray:
    """Features in each bucket over all texts: a task sends one row a bucket."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for b in batches:
            for part in slices(b.column(0), SLICE):
                total += np.bincount(features(part)[1], minlength=BUCKETS)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "n"])

    rows = texts.select(F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(count, "bucket long, n long")
    out = np.zeros(BUCKETS, np.int64)
    for r in rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # BUCKETS rows at most
        out[r["bucket"]] = r["n"]
    return out


def bucket_gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Gain of every bucket, in thousandths, rounded down."""
    s, t = raw.astype(float), target.astype(float)
    return np.floor(SCALE * np.log((t + 1) * (s.sum() + BUCKETS) / ((s + 1) * (t.sum() + BUCKETS)))).astype(np.int64)


def weigh(text: Column, gains: np.ndarray) -> Column:
    """Struct (n_words, n_features, weight) of a text; null reads as empty, and a
    text without words has three zeros."""
    @F.arrow_udf("n_words long, n_features long, weight long")
    def rate(texts: pa.Array) -> pa.Array:
        out = []
        for part in slices(texts, SLICE):
            owner, bucket, words = features(part)
            order = np.argsort(owner, kind="stable")
            taken = np.concatenate([[0], np.cumsum(gains[bucket[order]])])
            n = np.bincount(owner, minlength=len(part))
            end = np.cumsum(n)
            out.append(np.stack([words, n, taken[end] - taken[end - n]]))
        every = np.concatenate(out, axis=1) if out else np.zeros((3, 0), np.int64)
        return pa.StructArray.from_arrays([pa.array(x.astype(np.int64)) for x in every], ["n_words", "n_features", "weight"])

    return rate(text.cast("string"))


def noise(key: Column, seed: int = SEED) -> Column:
    """Gumbel noise of a document, in thousandths, from a hash of its id (null
    reads as empty)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-SCALE * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def number_in_order(rows: DataFrame, order: list[Column], out: str) -> DataFrame:
    """``rows`` with their place (from 1) in a global order: range partitions,
    their sizes (one number a partition comes to the driver) and the place
    within each; no task holds more than one range."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = cut(rows)  # choosing the ranges reads the rows once more
    held = cut(rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    before, total = {}, 0
    for r in held.groupBy("_part").count().orderBy("_part").collect():
        before[r["_part"]] = total
        total += r["count"]
    if not before:
        return held.drop("_part").withColumn(out, F.lit(0).cast("long"))
    start = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return held.withColumn(out, (F.element_at(start, F.col("_part")) + place).cast("long")).drop("_part")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """``id_col``, n_features, weight, score and rank of every row of ``docs``.

    Of the rows with ``LEAST_WORDS`` words, ``percent`` in a hundred (rounded
    down) of largest score are drawn, ties to the smaller id (a null id last),
    and ranked from 1; rank is null for the others.  Repeated rows each take
    part.  Texts of ``target`` are read from its column ``text_col``.  Other
    columns are not read.
    """
    gains = bucket_gains(bucket_counts(docs, text_col), bucket_counts(target, text_col))
    rows = docs.select(F.col(f"`{id_col}`").alias("key"), weigh(F.col(f"`{text_col}`"), gains).alias("w"))
    rows = rows.select("key", (F.col("w.n_words") >= LEAST_WORDS).alias("able"), "w.n_features", "w.weight", (F.col("w.weight") + noise(F.col("key"))).alias("score"))
    placed = cut(number_in_order(rows, [F.col("able").desc(), F.col("score").desc(), F.col("key").asc_nulls_last()], "place"))
    able = placed.filter("able").count()
    drawn = F.col("able") & (F.col("place") <= percent * able // 100)
    return placed.select(F.col("key").alias(id_col), "n_features", "weight", "score", F.when(drawn, F.col("place")).alias("rank"))
