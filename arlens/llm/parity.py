"""Operator 3: near duplicates by a parity-sketch join.

A text's set is its distinct five-word shingles, each a 64-bit hash.  XOR-ing
every shingle into the block of a sketch that its hash names gives parities: if
two sets differ in d shingles, at most d blocks differ.  Sets of a size band
that are similar enough differ in at most D shingles, so with more than D
occupied blocks at least one is equal (pigeonhole), and equal blocks are joined.
Sets with too few occupied blocks also show their empty ones, which keeps this
true for every pair.

Candidates are pruned by a second sketch, one bit a shingle: the Hamming
distance of two such sketches is a lower bound of the symmetric difference.
What is left is verified on the sets.

In a bucket of equal blocks every set is first compared with the bucket's
smallest one only, then, where components still differ, with one drawn from the
bucket.  Buckets that hold several components even then are compared in full
between components, large ones split into squares of bounded side, so every link
is found and no bucket's pairs are written out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arlens.llm.common import cut, utf8, unused
from arlens.llm.components import components

SHINGLE = 5
#: Similarity of at least NUMERATOR / DENOMINATOR links two sets.
NUMERATOR, DENOMINATOR = 4, 5
#: Greatest over least size of a band, and blocks for each difference allowed.
BAND, BLOCKS = 1.7, 1.05
#: Bits of the pruning sketch for each shingle, before rounding up to 2 ** n, and
#: how far it is folded for buckets that are compared in full.
SKETCH, FOLD = 4, 2
#: Side of the squares into which a large bucket is split.
SIDE = 2048
#: Bytes of block rows that one task of the join gets.
TASK_BYTES = 24_000_000
#: Bits of the filter that tells which texts are read again to be verified.
FILTER_BITS = 1 << 23
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], dtype=np.uint64)


class _Hashes(dict):
    """word -> 64-bit hash; forgets everything when it has grown large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 500_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(31))) * _ODD[1]
    x = (x ^ (x >> np.uint64(29))) * _ODD[3]
    return x ^ (x >> np.uint64(32))


def shingles(raw: bytes, hashes: dict) -> np.ndarray:
    """Sorted set of shingle hashes; fewer words than SHINGLE make one shingle."""
    words = raw.lower().split()  # bytes: A-Z only, ASCII white space only
    n = len(words)
    w = np.array([hashes[x] for x in words], dtype=np.uint64)
    if n < SHINGLE:
        return mix((w * _ODD[:n]).sum(keepdims=True, dtype=np.uint64) + np.uint64(n)) if n else w
    out = w[:n - SHINGLE + 1] * _ODD[0]
    for i in range(1, SHINGLE):
        out += w[i:n - SHINGLE + 1 + i] * _ODD[i]
    return np.unique(mix(out))


def allowed(a: int, b: int) -> int:
    """Greatest symmetric difference of linked sets of these sizes."""
    return (a + b) * (DENOMINATOR - NUMERATOR) // (DENOMINATOR + NUMERATOR)


def bands(size: int) -> Iterator[tuple[int, int, int]]:
    """(least size, greatest partner, blocks) of the bands that a set joins.

    A band holds the pairs whose smaller set lies in [low, high]; the larger is
    at most DENOMINATOR / NUMERATOR as large.
    """
    low = 1
    while low <= size:
        high = max(low, int(low * BAND))
        top = high * DENOMINATOR // NUMERATOR
        if size <= top:
            yield low, top, math.ceil(allowed(high, top) * BLOCKS) + 1
        low = high + 1


def block_hashes(s: np.ndarray) -> np.ndarray:
    """One 64-bit name for each occupied block of each band; where so few blocks
    are occupied that all could differ, the empty ones too."""
    out = []
    for low, top, blocks in bands(len(s)):
        band = np.array([low], dtype=np.uint64)
        key = mix(s + band * _ODD[4])
        block = ((key >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
        order = np.argsort(block, kind="stable")
        block = block[order]
        first = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
        parity, own = np.bitwise_xor.reduceat(key[order], first), block[first]
        salt = band * _ODD[2]
        out.append(mix(mix(parity) + own * _ODD[0] + salt))
        if len(own) <= allowed(len(s), min(top, len(s) * DENOMINATOR // NUMERATOR)):
            empty = np.setdiff1d(np.arange(blocks, dtype=np.uint64), own)
            out.append(mix(empty * _ODD[5] + salt + np.uint64(1)))
    return np.concatenate(out)


def sketch(s: np.ndarray) -> bytes:
    """Parity of the shingles at each bit; the width is a power of two, so the
    sketch of a larger set folds down to that of a smaller one."""
    bits = max(64, 1 << (SKETCH * len(s) - 1).bit_length())
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").tobytes()


def fold(bits: bytes, width: int) -> np.ndarray:
    """A sketch as 64-bit words, folded down to ``width`` of them."""
    return np.bitwise_xor.reduce(np.frombuffer(bits, np.uint64).reshape(-1, width), axis=0)


def set_name(s: np.ndarray) -> int:
    """One 64-bit name of a whole set."""
    parts = np.array([np.bitwise_xor.reduce(s), s.sum(dtype=np.uint64), len(s)], dtype=np.uint64) * _ODD[:3]
    return int(mix(parts.sum(keepdims=True, dtype=np.uint64)).astype(np.int64)[0])


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * DENOMINATOR >= NUMERATOR * (len(a) + len(b) - both)


def _scan(parts: int):
    """Texts -> rows of documents (kind 0), of blocks dealt to ``parts`` (kind 1)
    and of buckets that this batch alone has filled (kind 2, packed).

    Blocks are combined here: a set is shown once a batch, and a block that
    several sets of the batch share is passed on for the smallest of them only.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in batches:
            ids = batch.column(0)
            size, name, text_hash, bits, coarse = [], [], [], [], []
            shown: dict[int, np.ndarray] = {}
            for raw in utf8(batch.column(1)):
                s = shingles(raw, hashes)
                size.append(len(s))
                text_hash.append(xxhash.xxh3_64_intdigest(raw) >> 1)
                name.append(set_name(s) if len(s) else None)
                bits.append(sketch(s) if len(s) else None)
                coarse.append(fold(bits[-1], max(1, len(bits[-1]) // 8 // FOLD)).tobytes() if len(s) else None)
                if len(s) and name[-1] not in shown:
                    shown[name[-1]] = block_hashes(s)
            k = len(size)
            yield _rows(ids, 0, np.arange(k) % parts, k, size=size, name=name, text_hash=text_hash, bits=bits, coarse=coarse)
            if not shown:
                continue
            block = np.concatenate(list(shown.values())).astype(np.int64)
            owner = np.repeat(np.array(list(shown), dtype=np.int64), [len(x) for x in shown.values()])
            block, owner, hub, many = _buckets(block, owner)
            if many.any():
                yield _rows(ids, 2, np.abs(block[:1]) % parts, 1, bits=[np.stack([block[many], owner[many], hub[many]], axis=1).tobytes()])
            lead = owner == hub
            block, owner = block[lead], owner[lead]
            part = (block.view(np.uint64) >> np.uint64(20)) % np.uint64(parts)
            order = np.argsort(part, kind="stable")
            at, first = np.unique(part[order], return_index=True)
            pairs = np.stack([block[order], owner[order]], axis=1)
            yield _rows(ids, 1, at.astype(np.int64), len(at), bits=[x.tobytes() for x in np.split(pairs, first[1:])])

    return run


def _buckets(block: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows sorted and distinct by (block, owner); the smallest owner of each
    row's block; whether the block has several owners."""
    order = np.lexsort((owner, block))
    block, owner = block[order], owner[order]
    new = np.r_[True, (block[1:] != block[:-1]) | (owner[1:] != owner[:-1])]
    block, owner = block[new], owner[new]
    start = np.r_[True, block[1:] != block[:-1]]
    first = np.flatnonzero(start)
    size = np.diff(np.r_[first, len(block)])
    return block, owner, np.repeat(owner[first], size), np.repeat(size > 1, size)


_COLUMNS = [("kind", pa.int32()), ("part", pa.int64()), ("size", pa.int64()), ("name", pa.int64()), ("text_hash", pa.int64()), ("bits", pa.binary()), ("coarse", pa.binary())]
_TYPES = "kind int, part long, size long, name long, text_hash long, bits binary, coarse binary"


def _rows(ids: pa.Array, kind: int, part: np.ndarray, n: int, **given) -> pa.RecordBatch:
    given |= {"kind": np.full(n, kind, np.int32), "part": part.astype(np.int64)}
    columns = [pa.array(given[c], t) if c in given else pa.nulls(n, t) for c, t in _COLUMNS]
    return pa.RecordBatch.from_arrays([ids if kind == 0 else pa.nulls(n, ids.type), *columns], ["id", *(c for c, _ in _COLUMNS)])


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of one part -> bucket rows; other rows pass through."""
    held: list[np.ndarray] = []
    ids = None
    for batch in batches:
        ids = batch.column(0)
        kind = batch.column(1).to_numpy()
        held += [np.frombuffer(b, np.int64).reshape(-1, 2) for b in batch.column(6).filter(pa.array(kind == 1)).to_pylist()]
        yield batch.filter(pa.array(kind != 1))
    if held:
        pairs = np.concatenate(held)
        held.clear()
        block, owner, hub, many = _buckets(pairs[:, 0], pairs[:, 1])
        for at in np.array_split(np.flatnonzero(many), max(1, many.sum() // 100_000)):
            yield _rows(ids, 2, np.zeros(1), 1, bits=[np.stack([block[at], owner[at], hub[at]], axis=1).tobytes()])


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bucket rows that ``_scan`` and ``_meet`` have packed."""
    for batch in batches:
        for packed in batch.column(0).to_pylist():
            rows = np.frombuffer(packed, np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([pa.array(rows[:, k]) for k in range(3)], ["block", "name", "hub"])


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b, sizes, sketches) that sizes and Hamming distances allow."""
    for batch in batches:
        a, b, na, nb, sa, sb = (c.to_pylist() for c in batch.columns)
        keep = []
        for k in range(len(a)):
            width = min(len(sa[k]), len(sb[k])) // 8
            far = min(na[k], nb[k]) * DENOMINATOR < max(na[k], nb[k]) * NUMERATOR
            keep.append(not far and int(np.bitwise_count(fold(sa[k], width) ^ fold(sb[k], width)).sum()) <= allowed(na[k], nb[k]))
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (block, row, column), with set, component, size, folded
    sketch and side -> pairs of different components that the Hamming distance
    allows.  In a square off the diagonal only its two sides are compared."""
    def square(name, comp, size, bits, side):
        n = len(name)
        if n < 2:
            return
        width = min(map(len, bits)) // 8
        x = np.stack([fold(b, width) for b in bits])
        name, comp, size, side = (np.array(v, dtype=np.int64) for v in (name, comp, size, side))
        step = max(1, 4_000_000 // (n * width))
        for lo in range(0, n, step):
            hi = min(n, lo + step)
            i, j = np.nonzero((comp[lo:hi, None] != comp[None]) & ((side[lo:hi, None] != side[None]) | (side[lo:hi, None] < 0)) & (name[lo:hi, None] < name[None]))
            i += lo
            for at in range(0, len(i), 4_000_000 // width + 1):
                p, q = i[at:at + 4_000_000 // width + 1], j[at:at + 4_000_000 // width + 1]
                ok = np.minimum(size[p], size[q]) * DENOMINATOR >= np.maximum(size[p], size[q]) * NUMERATOR
                p, q = p[ok], q[ok]
                ok = np.bitwise_count(x[p] ^ x[q]).sum(axis=1) <= (size[p] + size[q]) * (DENOMINATOR - NUMERATOR) // (DENOMINATOR + NUMERATOR)
                if ok.any():
                    yield pa.RecordBatch.from_arrays([pa.array(name[p[ok]]), pa.array(name[q[ok]])], ["a", "b"])

    key, group = None, ([], [], [], [], [])
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for row in zip(*columns):
            if row[:3] != key:
                yield from square(*group)
                key, group = row[:3], ([], [], [], [], [])
            for held, value in zip(group, row[3:]):
                held.append(value)
    yield from square(*group)


def _verify(pairs: DataFrame, sets: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) of sets that are linked, judged on the sets themselves.

    Texts are read once more; a filter of fixed size passes those that stand for
    a set in question (and a few others, which the joins drop), so only their
    sets are built and moved.
    """
    pairs = cut(pairs)
    if pairs.isEmpty():
        return pairs
    names = pairs.select(F.col("a").alias("name")).union(pairs.select(F.col("b").alias("name"))).distinct()
    asked = cut(names.join(sets.select("name", "text_hash"), "name"))
    bits = asked.select((F.col("text_hash") % FILTER_BITS).alias("c")).selectExpr("cast(c div 32 as int) w", "shiftleft(1L, cast(c % 32 as int)) v")
    words = bits.groupBy("w").agg(F.bit_or("v").alias("v")).toArrow()
    table = np.zeros(FILTER_BITS // 32, np.int64)
    table[words["w"].to_numpy()] = words["v"].to_numpy()
    table = table.astype(np.uint32)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in batches:
            out: dict[int, np.ndarray] = {}
            for raw in utf8(batch.column(0)):
                h = xxhash.xxh3_64_intdigest(raw) >> 1
                c = h % FILTER_BITS
                if h not in out and table[c // 32] >> (c % 32) & 1 and len(s := shingles(raw, hashes)):
                    out[h] = s
            yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int64()), pa.array([s.tobytes() for s in out.values()], pa.binary())], ["text_hash", "items"])

    found = docs.select("text").mapInArrow(build, "text_hash long, items binary")
    held = cut(asked.join(found, "text_hash").groupBy("name").agg(F.any_value("items").alias("items")))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (c.to_pylist() for c in batch.columns[2:])
            keep = [linked(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)) for p, q in zip(x, y)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(held.withColumnsRenamed({"name": "a", "items": "x"}), "a").join(held.withColumnsRenamed({"name": "b", "items": "y"}), "b")
    return cut(both.select("a", "b", "x", "y").mapInArrow(judge, "a long, b long"))


def _mixed(member: DataFrame, label: DataFrame) -> DataFrame:
    """(block, name, comp, n) of the buckets whose sets are of several components."""
    known = member.join(label.withColumnRenamed("node", "name"), "name", "left").select("block", "name", F.coalesce("label", "name").alias("comp"))
    several = known.groupBy("block").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("n")).filter("lo != hi")
    return known.join(several.select("block", "n"), "block")


def _squares(rows: DataFrame) -> DataFrame:
    """Bucket rows with (row, column, side) of each square they are in: one
    square for a bucket of up to SIDE sets, else all squares of its chunks."""
    chunks = F.ceil(F.col("n") / SIDE)
    mine = F.pmod(F.xxhash64("name"), chunks)
    spread = rows.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1)))
    row, column = F.least("mine", "other"), F.greatest("mine", "other")
    # on the diagonal all are compared with all (side -1)
    return spread.withColumns({"row": row, "column": column, "side": F.when(row == column, F.lit(-1).cast("long")).otherwise(F.col("mine"))})


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) of every row of ``df``.

    component_id is the smallest id that links reach, the row's own included.
    Rows without words have size 0 and are linked with nothing; a null id takes
    part and gets its group's smallest id; repeated rows are linked like any
    equal texts; an empty table gives no rows.  Other columns are not read.
    """
    spark = df.sparkSession
    docs = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    # about half a block of 16 bytes for each word of six bytes
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size * 4 / 3 / TASK_BYTES))
    schema = T.StructType([T.StructField("id", docs.schema["id"].dataType), *T._parse_datatype_string(_TYPES).fields])
    met = cut(docs.mapInArrow(_scan(parts * 8), schema).repartition(parts, "part").mapInArrow(_meet, schema))
    rows = met.filter("kind = 0").select("id", "size", "name", "text_hash", "bits", "coarse")
    bucket = met.filter("kind = 2").select("bits").mapInArrow(_unpack, "block long, name long, hub long")
    member = cut(bucket.select("block", "name").distinct())
    sets = cut(rows.filter("size > 0").groupBy("name").agg(F.min("id").alias("first"), F.first("size").alias("size"), F.min("text_hash").alias("text_hash"), F.any_value("bits").alias("bits"), F.any_value("coarse").alias("coarse")).join(member.select("name").distinct(), "name"))
    side = lambda c, x: sets.select(F.col("name").alias(c), F.col("size").alias("n" + c), F.col("bits").alias(x))

    def verified(pairs: DataFrame) -> DataFrame:
        return _verify(pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").select("a", "b", "na", "nb", "x", "y").mapInArrow(_near, "a long, b long"), sets, docs)

    links = verified(bucket.filter("name != hub").select(F.col("hub").alias("a"), F.col("name").alias("b")).distinct())
    label = components(links)
    # another member of each bucket, drawn by a hash of both: a set whose buckets
    # are led by sets just too far away meets as many others as it has buckets
    mixed = cut(_mixed(member, label))
    drawn = mixed.groupBy("block").agg(F.min_by(F.struct("name", "comp"), F.xxhash64("block", "name")).alias("drawn"))
    more = verified(mixed.join(drawn, "block").filter("comp != drawn.comp").select(F.col("drawn.name").alias("a"), F.col("name").alias("b")).distinct())
    if not more.isEmpty():
        links = cut(links.union(more))
        label = components(links)
        mixed = cut(_mixed(mixed.select("block", "name"), label))
    # buckets that still hold several components, compared in full across these
    left = _squares(mixed).join(sets.select("name", "size", "coarse"), "name").select("block", "row", "column", "name", "comp", "size", "coarse", "side")
    more = verified(left.repartition("block", "row", "column").sortWithinPartitions("block", "row", "column").mapInArrow(_across, "a long, b long").distinct())
    if not more.isEmpty():
        label = components(links.union(more))
    linked_sets = label.withColumnRenamed("node", "name").join(sets.select("name", "first"), "name")
    least = linked_sets.groupBy("label").agg(F.min("first").alias("component"))
    of_linked = linked_sets.join(least, "label").select("name", "component")
    every = rows.filter("size > 0").groupBy("name").agg(F.min("id").alias("first")).join(of_linked, "name", "left").select("name", F.coalesce("component", "first").alias("component"))
    out = rows.select("id", "size", "name").join(every, "name", "left")
    return out.select(F.col("id").alias(id_col), F.col("size").alias("n_shingles"), F.when(F.col("size") > 0, F.col("component")).otherwise(F.col("id")).alias("component_id"))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with one row of each group of near duplicates: the one of smallest
    id (null first; among equal ids, of smallest text hash).  Rows without words
    all stay, repeated ones too; columns stay as they are."""
    text = F.col(f"`{text_col}`").cast("string")
    keyed = df.select(F.struct(F.col(f"`{id_col}`").alias("i"), F.xxhash64(text).alias("h")).alias("key"), text.alias("text"))
    found = cut(near_duplicates(keyed, "key", "text").filter("n_shingles > 0").groupBy("key", "component_id").agg(F.count("*").alias("n")))
    i, h = unused(df, "_i"), unused(df, "_h")
    names = lambda rows: rows.select(F.col("key.i").alias(i), F.col("key.h").alias(h))
    same = df[id_col].eqNullSafe(F.col(i)) & (F.xxhash64(df[text_col].cast("string")) == F.col(h))
    kept = df.join(names(found.filter("key != component_id")), same, "left_anti")
    twice = names(found.filter("key = component_id and n > 1"))
    if twice.isEmpty():
        return kept
    # rows that are repeated as a whole: only these are brought together
    repeated = kept.join(twice, same, "left_semi").withColumn(h, F.xxhash64(text)).dropDuplicates([id_col, h]).drop(h)
    return kept.join(twice, same, "left_anti").unionByName(repeated)
