"""Operator 4: repeated substrings by bucket-pointer refinement.

Bytes covered by a LENGTH-byte string that also starts elsewhere are removed.
Every LENGTH-byte window is filed under the least hash of its GRAM-byte grams;
consecutive windows under one gram make a run, so equal windows always meet in
the bucket of one gram, whichever documents they come from.  Buckets with a
single run are done.  Runs that are equal as a whole are one class with a
weight.  Classes that differ are told apart by bucket-pointer refinement: the
positions of a bucket's runs start in buckets of their first 8 bytes and are
refined by sorting on the bucket at a later offset; each pass reuses the buckets
that the last one made, so the depth doubles to LENGTH.  A bucket of too many
runs or bytes for one task is not collected: its windows are counted by their
128-bit hashes, and those that occur once are known by the one run they are in.

Texts stay where they are: scans send hashes, then the runs of mixed buckets,
then the texts that are cut in part.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arlens.llm.common import cut, utf8

LENGTH = 400
GRAM = 32
#: Buckets of more than CROWD different runs, or of more than CHUNK bytes of them,
#: are decided by window hashes.  FINE is no longer read; a test sets it.
FINE, CROWD = 320, 4096
#: Windows in one batch of hashes.
WINDOWS = 100_000
#: Bytes that are refined together (twice that at most), and of run rows that one
#: task gets.
CHUNK = 2_000_000
TASK_BYTES = 24_000_000
#: Longest part of a text that is cut into runs at once; parts overlap.
PART = 1 << 20
_AT = np.uint64(2 * PART - 1)
#: Bits of the filters that tell which runs and texts are read again.
FILTER_BITS = 1 << 23
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)
_RUN = np.dtype([(n, "<i8") for n in ("key", "f0", "f1", "t0", "t1", "lo", "windows", "own")])


def _words(raw: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position as one number."""
    return np.ndarray((len(raw) - 7,), "<u8", raw.tobytes(), strides=(1,))


def gram_hashes(raw: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the ``gram`` bytes (a multiple of 8) from each position."""
    w = _words(raw) * _ODD[0]
    w ^= w >> np.uint64(29)
    n, out = len(raw) - gram + 1, None
    for k in range(0, gram, 8):
        out = w[k:k + n].copy() if out is None else out * _ODD[1] + w[k:k + n]
    out ^= out >> np.uint64(32)
    out *= _ODD[2]
    return out ^ (out >> np.uint64(29))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by block prefixes and suffixes."""
    n = len(x)
    pad = np.full(-n % width, np.iinfo(x.dtype).max, x.dtype)
    blocks = np.concatenate([x, pad]).reshape(-1, width)
    after = np.minimum.accumulate(blocks, axis=1).ravel()
    before = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(before[:n - width + 1], after[width - 1:n])


def runs(raw: bytes, length: int = LENGTH, gram: int = GRAM) -> list[tuple[int, int, int, bool]]:
    """(key, first window, windows, repeats within) of the runs of one text.

    The key of a window depends on its bytes alone.  A run repeats within if its
    gram occurs twice in it; other runs hold no two equal windows.
    """
    out = []
    whole = np.frombuffer(raw, np.uint8)
    for base in range(0, max(len(raw) - length + 1, 0), PART):
        part = whole[base:base + PART + length - 1]
        h = gram_hashes(part, gram)
        at = np.arange(len(h), dtype=np.uint64)
        high, width = h & ~_AT, length - gram + 1
        left = (sliding_min(high | at, width) & _AT).astype(np.int64)
        right = (_AT - (sliding_min(high | (_AT - at), width) & _AT)).astype(np.int64)
        key = h[left]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        last = np.r_[first[1:], len(key)] - 1
        out += zip(key[first].view(np.int64).tolist(), (first + base).tolist(), (last - first + 1).tolist(), (left[first] != right[last]).tolist())
    return out


def refine(rows: list[bytes], weight: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """For each row, whether each of its windows equals another window, a row of
    weight w standing for w rows.

    ``bucket`` holds each position's bucket at the depth reached, 0 where no
    other position shares it.
    """
    size = np.array([len(r) for r in rows], dtype=np.int64)
    start = np.concatenate([[0], np.cumsum(size)])
    raw = np.frombuffer(b"".join(rows) + bytes(8), np.uint8)
    end = np.repeat(start[1:], size)
    weight = np.repeat(weight, size)
    n = len(end)

    def buckets(where: np.ndarray, code: np.ndarray) -> np.ndarray:
        _, of, count = np.unique(code, return_inverse=True, return_counts=True)
        out = np.zeros(n, np.int64)
        shared = (count > 1)[of] | (weight[where] > 1)
        out[where[shared]] = of[shared] + 1
        return out

    active = np.flatnonzero(np.arange(n) + 8 <= end)
    depth = min(8, length)
    bucket = buckets(active, _words(raw)[active])
    while depth < length:
        step = min(depth, length - depth)  # the last pass overlaps its two halves
        active = np.flatnonzero(bucket)
        active = active[active + depth + step <= end[active]]
        later = bucket[active + step]
        active, later = active[later > 0], later[later > 0]
        bucket = buckets(active, bucket[active] * (n + 1) + later)
        depth += step
    alike = bucket > 0
    return [alike[a:b - length + 1] for a, b in zip(start, start[1:])]


def _rows(ids, kind: int, n: int, **given) -> pa.RecordBatch:
    given["kind"] = np.full(n, kind, np.int32)
    columns = [pa.array(given[c], t) if c in given else pa.nulls(n, t) for c, t in _COLUMNS]
    return pa.RecordBatch.from_arrays([ids if kind == 0 else pa.nulls(n, ids.type), *columns], ["id", *(c for c, _ in _COLUMNS)])


_COLUMNS = [("kind", pa.int32()), ("part", pa.int64()), ("size", pa.int64()), ("sha256", pa.string()), ("bits", pa.binary()), *((n, pa.int64()) for n in _RUN.names)]
_TYPES = "kind int, part long, size long, sha256 string, bits binary, " + ", ".join(f"{n} long" for n in _RUN.names)


def _shared(held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct runs by key, and whether each lies in a bucket that needs more:
    one with another run, or one that repeats within."""
    held = held[np.lexsort((held["lo"], held["t1"], held["t0"], held["key"]))]
    same = np.zeros(len(held), bool)
    same[1:] = np.all([held[c][1:] == held[c][:-1] for c in ("key", "t0", "t1", "lo")], axis=0)
    held = held[~same]
    start = np.r_[True, held["key"][1:] != held["key"][:-1]]
    size = np.diff(np.r_[np.flatnonzero(start), len(held)])
    return held, np.repeat(size > 1, size) | (held["own"] > 0)


def _text_name(raw: bytes) -> tuple[str, int, int]:
    digest = hashlib.sha256(raw)
    return digest.hexdigest(), *np.frombuffer(digest.digest()[:16], "<i8").tolist()


def _runs_of(raw: bytes, length: int) -> list[tuple[int, int, int, int, int, bool]]:
    """key, two halves of the run's own hash, first window, windows, repeats."""
    out = []
    for key, lo, n, own in runs(raw, length):
        f = np.frombuffer(xxhash.xxh3_128_digest(raw[lo:lo + n + length - 1]), "<i8")
        out.append((key, int(f[0]), int(f[1]), lo, n, own))
    return out


def _scan(parts: int, length: int):
    """Texts -> documents (kind 0), runs dealt by key to ``parts`` (kind 1), and
    runs whose bucket this batch alone shows to need more (kind 2).

    Runs are combined here: a text is shown once a batch, and of a bucket that
    the batch has filled only the first run is passed on.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            texts = utf8(batch.column(1))
            names = [_text_name(raw) for raw in texts]
            n = len(texts)
            yield _rows(ids, 0, n, part=np.arange(n) % parts, size=list(map(len, texts)), sha256=[x[0] for x in names], t0=[x[1] for x in names], t1=[x[2] for x in names])
            shown = {name: raw for name, raw in zip(names, texts) if len(raw) >= length}
            found = [(key, f0, f1, t0, t1, lo, k, own) for (_, t0, t1), raw in shown.items() for key, f0, f1, lo, k, own in _runs_of(raw, length)]
            if not found:
                continue
            held, more = _shared(np.array(found, dtype=_RUN))
            if more.any():
                yield _rows(ids, 2, int(more.sum()), part=np.arange(more.sum()) % parts, **{c: held[c][more] for c in _RUN.names})
            lead = held[np.r_[True, held["key"][1:] != held["key"][:-1]]]
            part = ((lead["key"].view("<u8") * _ODD[3]) >> np.uint64(33)) % np.uint64(parts)
            order = np.argsort(part, kind="stable")
            at, first = np.unique(part[order], return_index=True)
            yield _rows(ids, 1, len(at), part=at.astype(np.int64), bits=[x.tobytes() for x in np.split(lead[order], first[1:])])

    return run


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of one part -> those whose bucket needs more; other rows pass."""
    held: list[np.ndarray] = []
    ids = None
    for batch in batches:
        ids = batch.column(0)
        kind = batch.column(1).to_numpy()
        held += [np.frombuffer(b, _RUN) for b in batch.column(5).filter(pa.array(kind == 1)).to_pylist()]
        yield batch.filter(pa.array(kind != 1))
    if held:
        found, more = _shared(np.concatenate(held))
        held.clear()
        for at in np.array_split(np.flatnonzero(more), max(1, more.sum() // 50_000)):
            yield _rows(ids, 2, len(at), part=np.zeros(len(at), np.int64), **{c: found[c][at] for c in _RUN.names})


def _filter_of(df: DataFrame, name: str) -> np.ndarray:
    """Bits of the values of a long column, as a table of fixed size."""
    cells = df.select(F.pmod(F.col(name), F.lit(FILTER_BITS)).alias("c")).selectExpr("cast(c div 32 as int) w", "shiftleft(1L, cast(c % 32 as int)) v")
    words = cells.groupBy("w").agg(F.bit_or("v").alias("v")).toArrow()
    table = np.zeros(FILTER_BITS // 32, np.int64)
    table[words["w"].to_numpy()] = words["v"].to_numpy()
    return table.astype(np.uint32)


def _has(table: np.ndarray, value: int) -> bool:
    c = value % FILTER_BITS
    return bool(table[c // 32] >> (c % 32) & 1)


def _edges(alike: np.ndarray) -> list[list[int]]:
    """(start, end) of the stretches of ones."""
    return np.flatnonzero(np.diff(np.concatenate([[0], alike, [0]]))).reshape(-1, 2).tolist()


def _alike(asked: DataFrame, texts: DataFrame, length: int) -> DataFrame:
    """(key, f0, f1, first, last): windows of the asked classes of weight 1 that
    equal a window of another run of the same bucket, or of their own run.

    asked: key, f0, f1, weight, windows, big (the bucket is too large for a task).
    """
    table = _filter_of(asked, "f0")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[tuple[int, int, int], bytes] = {}
            for raw in {raw for raw in utf8(batch.column(0)) if len(raw) >= length}:
                for key, f0, f1, lo, n, _ in _runs_of(raw, length):
                    if _has(table, f0):
                        out[key, f0, f1] = raw[lo:lo + n + length - 1]
            keys = list(zip(*out)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([*(pa.array(k, pa.int64()) for k in keys), pa.array(list(out.values()), pa.binary())], ["key", "f0", "f1", "bytes"])

    got = texts.mapInArrow(fetch, "key long, f0 long, f1 long, bytes binary").join(asked, ["key", "f0", "f1"])
    one = got.groupBy("key", "f0", "f1", "weight", "big").agg(F.any_value("bytes").alias("bytes"))

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each window: its hash, its weight and where it is."""
        def close() -> pa.RecordBatch:
            h = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            many = [n for *_, n in runs_held]
            of = [np.repeat([r[k] for r in runs_held], many) for k in range(4)]
            at = of[3] + np.arange(len(h)) - np.repeat(np.cumsum(many) - many, many)
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (h[:, 0], h[:, 1], of[2], of[0], of[1], at)], ["h0", "h1", "n", "f0", "f1", "at"])

        digest = xxhash.xxh3_128_digest
        digests: list[bytes] = []
        runs_held: list[tuple[int, int, int, int, int]] = []
        for batch in batches:
            for f0, f1, weight, raw in zip(*(c.to_pylist() for c in batch.columns)):
                n = len(raw) - length + 1
                for lo in range(0, n, WINDOWS):
                    hi = min(lo + WINDOWS, n)
                    digests += [digest(raw[i:i + length]) for i in range(lo, hi)]
                    runs_held.append((f0, f1, weight, lo, hi - lo))
                    if len(digests) >= WINDOWS:
                        yield close()
                        digests, runs_held = [], []
        if digests:
            yield close()

    # counts are combined before they move; a window that occurs once needs no way back to several runs
    window = one.filter("big").select("f0", "f1", "weight", "bytes").mapInArrow(hashes, "h0 long, h1 long, n long, f0 long, f1 long, at long")
    once = window.groupBy("h0", "h1").agg(F.sum("n").alias("n"), *(F.min(c).alias(c) for c in ("f0", "f1", "at"))).filter("n = 1")
    alone = once.groupBy("f0", "f1").agg(F.collect_list("at").alias("alone"))

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The windows of each run that do not occur once."""
        for batch in batches:
            out = []
            for key, f0, f1, n, alone in zip(*(c.to_pylist() for c in batch.columns)):
                alike = np.ones(n, np.int8)
                alike[np.array(alone or [], np.int64)] = 0
                out += [(key, f0, f1, a, b - 1) for a, b in _edges(alike)]
            columns = list(zip(*out)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["key", "f0", "f1", "first", "last"])

    spans = "key long, f0 long, f1 long, first long, last long"
    large = asked.filter("big and weight = 1").join(alone, ["f0", "f1"], "left").select("key", "f0", "f1", "windows", "alone").mapInArrow(others, spans)
    small = one.filter("not big").select("key", "f0", "f1", "weight", "bytes")

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(rows: list[tuple]) -> pa.RecordBatch:
            found = refine([r[4] for r in rows], np.array([r[3] for r in rows]), length)
            out = []
            for (key, f0, f1, weight, _), alike in zip(rows, found):
                if weight == 1:
                    out += [(key, f0, f1, a, b - 1) for a, b in _edges(alike.view(np.int8))]
            columns = list(zip(*out)) or [[]] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["key", "f0", "f1", "first", "last"])

        rows: list[tuple] = []
        held = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held >= CHUNK and row[0] != rows[-1][0]:
                    yield close(rows)
                    rows, held = [], 0
                rows.append(row)
                held += len(row[4])
        if rows:
            yield close(rows)

    return small.repartition("key").sortWithinPartitions("key").mapInArrow(solve, spans).union(large)


def cut_spans(raw: bytes, spans: list[tuple[int, int]]) -> tuple[list[tuple[int, int]], bytes]:
    """Maximal runs of the union of ``spans``, and the bytes outside them."""
    merged: list[list[int]] = []
    for a, b in sorted(spans):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    edges = [0, *(x for pair in merged for x in pair), len(raw)]
    return [tuple(m) for m in merged], b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))


def repeated_substrings(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(id, n_bytes, text_sha256, spans, kept) of every row of ``df``.

    spans: maximal runs of removed bytes; kept: what is left, null where nothing
    was removed.  Texts are UTF-8 bytes, null reads as empty; texts shorter than
    ``length`` lose nothing; a text that occurs in two rows loses all of it if
    it is long enough, null and repeated ids included.  An empty table gives no
    rows; other columns are not read.
    """
    spark = df.sparkSession
    docs = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    texts = docs.select("text")
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    # a run of 64 bytes for about every 185 bytes of text
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total * 0.35 / TASK_BYTES))
    schema = T.StructType([T.StructField("id", docs.schema["id"].dataType), *T._parse_datatype_string(_TYPES).fields])
    met = cut(docs.mapInArrow(_scan(parts * 8, length), schema).repartition(parts, "part").mapInArrow(_meet, schema))
    rows = met.filter("kind = 0").select("id", "size", "sha256", "t0", "t1")
    copies = rows.groupBy("t0", "t1").agg(F.count("*").alias("copies"))
    occurring = cut(met.filter("kind = 2").select("key", "f0", "f1", "t0", "t1", "lo", "windows", "own").distinct().join(copies, ["t0", "t1"]))
    classes = occurring.groupBy("key", "f0", "f1").agg(F.sum("copies").alias("weight"), F.max("own").alias("own"), F.max("windows").alias("windows"))
    # of a class only its weight beyond one counts: it stands for "several"
    buckets = classes.groupBy("key").agg(F.count("*").alias("kinds"), F.min("weight").alias("least"), F.max("own").alias("any_own"), F.sum(F.col("windows") + (length - 1)).alias("bytes"))
    big = ((F.col("kinds") > CROWD) | (F.col("bytes") > CHUNK)).alias("big")
    asked = cut(classes.join(buckets.filter("least = 1 and (kinds > 1 or any_own > 0)"), "key").select("key", "f0", "f1", F.least("weight", F.lit(2)).cast("long").alias("weight"), "windows", big))
    some = _alike(asked, texts, length)
    # rows with copies are removed whole below; the others get their spans
    single = occurring.filter("copies = 1").drop("own", "copies")
    whole = single.join(classes.filter("weight > 1").select("key", "f0", "f1"), ["key", "f0", "f1"]).select("t0", "t1", F.col("lo").alias("a"), (F.col("lo") + F.col("windows") + (length - 1)).alias("b"))
    part = single.join(some, ["key", "f0", "f1"]).select("t0", "t1", (F.col("lo") + F.col("first")).alias("a"), (F.col("lo") + F.col("last") + length).alias("b"))
    # a text's own spans: as many as it has runs at most
    spans = cut(whole.union(part).groupBy("t0", "t1").agg(F.collect_list(F.struct("a", "b")).alias("spans")))
    table = _filter_of(spans, "t0")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            out = {}
            for raw in utf8(batch.column(0)):
                _, t0, t1 = _text_name(raw)
                if _has(table, t0):
                    out[t0, t1] = pack(raw)
            keys = list(zip(*out)) or [[], []]
            yield pa.RecordBatch.from_arrays([*(pa.array(k, pa.int64()) for k in keys), pa.array(list(out.values()), pa.binary())], ["t0", "t1", "text"])

    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            done = [cut_spans(unpack(raw), [(s["a"], s["b"]) for s in spans]) for spans, raw in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([[{"start": a, "end": b} for a, b in s] for s, _ in done], span_type), pa.array([k for _, k in done], pa.binary())], ["t0", "t1", "spans", "kept"])

    partly = spans.join(texts.mapInArrow(send, "t0 long, t1 long, text binary"), ["t0", "t1"]).select("t0", "t1", "spans", "text").mapInArrow(apply, "t0 long, t1 long, spans array<struct<start:long,end:long>>, kept binary")
    every = copies.join(partly, ["t0", "t1"], "left")
    out = rows.join(every, ["t0", "t1"])
    gone = (F.col("copies") > 1) & (F.col("size") >= length)
    all_of_it = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("size").alias("end")))
    return out.select(F.col("id").alias(id_col), F.col("size").alias("n_bytes"), F.col("sha256").alias("text_sha256"), F.when(gone, all_of_it).otherwise(F.coalesce("spans", F.array().cast("array<struct<start:long,end:long>>"))).alias("spans"), F.when(gone, F.lit(b"")).otherwise(F.col("kept")).alias("kept"))
