"""Operator 11: spelling variants by pairs of trie nodes.

The words of the corpus form a forward trie and a trie of their reversals,
both with numbered nodes.  A word with one position skipped is the integer pair
(node of what stands before, node of what stands behind); a word split at a
position is such a pair too.  Two words whose skips meet in a pair differ by a
replaced code point; a skip that meets a split is an insertion.  Numbers are
given by prefix, not by hash, so the pairs give exactly the words at distance
one.  A pair of nodes holds at most one word for each letter of the alphabet
and the one split there, which bounds every group by the alphabet.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arlens.llm.common import cut, utf8

# Fixed values of the words: their letters, one run in so many loses a code
# point, least length and least number of occurrences, and how many times more
# frequent a form must be.
LETTERS = "a-zÀ-ÿ"
TYPO, LENGTH, LEAST, TIMES = 199, 6, 5, 5
#: Different words that a task holds before it hands on their counts.
TALLY = 500_000
_PART = 40  # node and word numbers: the task's number above so many bits


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of all words of ``LENGTH`` code points that occur ``LEAST`` times.

    A run's crc32 with its document's id decides whether it loses a code point.
    A null text has no words, a null id reads as an empty one, repeated rows
    count each.
    """
    run = re.compile(f"[{LETTERS}]+")

    def batch(seen: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(seen.keys()), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in batches:
            for key, raw in zip(b.column(0).to_pylist(), utf8(b.column(1))):
                start = zlib.crc32(f"{key}:".encode())
                for word, n in Counter(run.findall(raw.lower().decode("utf-8", "replace"))).items():  # bytes.lower() knows A-Z only
                    h = zlib.crc32(word.encode(), start)
                    if h % TYPO == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1:]
                    if len(word) >= LENGTH:
                        seen[word] += n
                if len(seen) >= TALLY:
                    yield batch(seen)
                    seen = Counter()
        yield batch(seen)

    rows = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST)


def _number(words: DataFrame, key: str, path: str) -> DataFrame:
    """``words`` with the trie node of every prefix of ``key`` (array ``path``,
    the root first) and a number in key order (``id``), unique over all tasks.

    Words are range-partitioned and sorted, so those that share a prefix are
    neighbours: a word keeps its predecessor's nodes as far as both agree and
    opens new ones beyond.  What agrees across the edge of two tasks is settled
    by ``_aliases``.
    """
    from pyspark.sql import types as T

    kept = [c for c in words.columns if c != "id"]
    schema = T.StructType([words.schema[c] for c in kept] + [T.StructField("id", T.LongType()), T.StructField(path, T.ArrayType(T.LongType()))])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = (TaskContext.get().partitionId() + 1) << _PART
        node, row, before, nodes = first, first, "", [0]
        for b in batches:
            flat, ends = [], [0]
            for word in b.column(key).to_pylist():
                nodes = nodes[:len(commonprefix((before, word))) + 1]
                more = len(word) + 1 - len(nodes)
                nodes.extend(range(node + 1, node + 1 + more))
                node, before = node + more, word
                flat.extend(nodes)
                ends.append(len(flat))
            ids = pa.array(np.arange(row, row + b.num_rows, dtype=np.int64))
            row += b.num_rows
            yield pa.RecordBatch.from_arrays([b.column(c) for c in kept] + [ids, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))], schema.names)

    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(words.repartitionByRange(parts, key).sortWithinPartitions(key).mapInArrow(walk, schema))


def _aliases(numbered: DataFrame, key: str, path: str) -> dict[int, int]:
    """Nodes that a task opened for its first word though an earlier task has
    them, with the earlier number.  Two words for each task come to the driver."""
    row = F.struct("id", F.col(key).alias("word"), F.col(path).alias("nodes"))
    edges = numbered.groupBy(F.shiftright("id", _PART).alias("part")).agg(F.min_by(row, "id").alias("a"), F.max_by(row, "id").alias("z")).orderBy("part").collect()
    same: dict[int, int] = {}
    for left, right in zip(edges, edges[1:]):
        shared = len(commonprefix((left["z"]["word"], right["a"]["word"])))
        for d in range(1, shared + 1):
            there = left["z"]["nodes"][d]
            same[right["a"]["nodes"][d]] = same.get(there, there)
    return same


def _renamed(nodes: np.ndarray, same: dict[int, int]) -> np.ndarray:
    if not same:
        return nodes
    old = np.array(sorted(same), np.int64)
    new = np.array([same[x] for x in old.tolist()], np.int64)
    at = np.minimum(np.searchsorted(old, nodes), len(old) - 1)
    return np.where(old[at] == nodes, new[at], nodes)


def _pairs(words: DataFrame, forward: dict[int, int], backward: dict[int, int]) -> DataFrame:
    """p, q (nodes), kind, id, n: for each word its skips (kind 1 where the code
    point differs from the one before it, else 0) and its splits (kind 2)."""
    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 1000):
                b = whole.slice(k, 1000)
                word = b.column(0).to_pylist()
                size = np.array([len(w) + 1 for w in word], np.int64)
                start = np.repeat(np.cumsum(size) - size, size)
                at = np.arange(size.sum()) - start
                last = np.repeat(size - 1, size)
                p = _renamed(b.column(3).flatten().to_numpy(), forward)
                q = _renamed(b.column(4).flatten().to_numpy(), backward)[start + last - at]
                letter = np.frombuffer("".join(w + "\n" for w in word).encode("utf-32-le"), np.uint32)
                new = np.concatenate([[True], letter[1:] != letter[:-1]])
                skip = np.flatnonzero(at < last)
                row = np.repeat(np.arange(len(word)), size)
                row = np.concatenate([row[skip], row])
                kind = np.concatenate([new[skip].astype(np.int8), np.full(len(p), 2, np.int8)])
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate([p[skip], p])), pa.array(np.concatenate([q[skip + 1], q])), pa.array(kind),
                    b.column(1).take(pa.array(row)), b.column(2).take(pa.array(row))], ["p", "q", "kind", "id", "n"])

    return words.select("word", "id", "n", "forward", "backward").mapInArrow(pairs, "p long, q long, kind byte, id long, n long")


def _near(pairs: DataFrame) -> DataFrame:
    """id, n_near and the best near word (n, minus its id) of words that have one.

    Words that share a skip meet once, at the position that differs; a skip
    meets a split at the first of equal code points only, so each near word
    counts once.
    """
    rank = lambda x: F.struct(x["n"].alias("n"), (-x["id"]).alias("neg"))
    of = lambda *kinds: F.transform(F.filter("m", lambda x: x["kind"].isin(*kinds)), rank)
    met = pairs.groupBy("p", "q").agg(F.collect_list(F.struct("kind", "id", "n")).alias("m")).filter(F.size("m") > 1)
    met = met.select("m", F.sort_array(of(0, 1), False).alias("skips"), F.array_max(of(1)).alias("first"), F.size(of(1)).alias("n_first"), F.get(of(2), F.lit(0)).alias("split"))
    one = met.select(F.explode("m").alias("x"), F.get("skips", F.lit(0)).alias("top"), F.get("skips", F.lit(1)).alias("next"), F.size("skips").alias("n_skips"), "first", "n_first", "split")
    is_split, inserted = F.col("x.kind") == 2, F.when(F.col("x.kind") == 1, F.col("split"))
    other = F.when(F.col("top.neg") == -F.col("x.id"), F.col("next")).otherwise(F.col("top"))
    best = F.when(is_split, F.col("first")).otherwise(F.greatest(other, inserted))
    n = F.when(is_split, F.col("n_first")).otherwise(F.col("n_skips") - 1 + inserted.isNotNull().cast("int"))
    return one.select(F.col("x.id").alias("id"), n.alias("n"), best.alias("best")).filter("n > 0").groupBy("id").agg(F.sum("n").alias("n_near"), F.max("best").alias("best"))


def variants(words: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n for each row of ``words`` (word, n;
    words are distinct).

    The form is the near word of largest ``n`` (ties: smallest in code-point
    order) if that is ``TIMES`` the word's own; the root follows the forms to the
    last.  As ``n`` grows by that factor with every form, the number of doublings
    that reach all roots follows from the largest ``n``.
    """
    forward = _number(words.select("word", "n"), "word", "forward")
    both = _number(forward.withColumns({"own": F.col("id"), "reversed": F.reverse("word")}), "reversed", "backward")
    ends = _aliases(forward, "word", "forward"), _aliases(both, "reversed", "backward")
    words = both.drop("id", "reversed").withColumnRenamed("own", "id")
    near = _near(_pairs(words, *ends))
    formed = F.col("best.n") >= TIMES * F.col("n")
    known = cut(words.select("id", "word", "n").join(near, "id", "left").select(
        "id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, -F.col("best.neg")).alias("form_id"), F.when(formed, F.col("best.n")).alias("form_n")))
    most = known.agg(F.max("n")).first()[0] or 1
    step = known.filter("form_id is not null").select("id", F.col("form_id").alias("root_id"))
    for _ in range(math.ceil(math.log2(max(math.log(most, TIMES), 1))) + 1):
        on = step.select(F.col("id").alias("root_id"), F.col("root_id").alias("further"))
        step = cut(step.join(on, "root_id", "left").select("id", F.coalesce("further", "root_id").alias("root_id")))
    spelt = lambda c: known.select(F.col("id").alias(f"{c}_id"), F.col("word").alias(c))
    out = known.join(step, "id", "left").join(spelt("form"), "form_id", "left").join(spelt("root"), "root_id", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``variants`` of the words of ``docs``; an empty table gives no rows.  Other
    columns of ``docs`` are not read, whatever their names."""
    return variants(word_counts(docs, id_col, text_col))
