"""Operator 10: benchmark decontamination by BM25 with block-max WAND.

The test items, cut into units of at most UNIT words, form an inverted index of
BM25 impacts, each divided by the unit's score against its own text: 1 means
that a passage holds every term of the unit.  Every passage of every document
is a query; WAND skips units that cannot reach the threshold by the maxima of
terms and of posting blocks, and finds all units at or above it.  A hit counts
when the passage's text really holds the item: its question and its answer must
both overlap it in word trigrams.

Only the index travels, in shards of bounded size; documents never move.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from arlens.llm.common import cut

UNIT = 32
#: Words of half a passage; passages overlap by half, so that every run of up
#: to HALF words lies in one of them whole.
HALF = 32
THRESHOLD = 0.6
OVERLAP = 0.5
GRAM = 3
#: An item of fewer words is common speech: it counts as held only by a text that
#: is the item and nothing else.
SHORT = 4
K1, B = 1.2, 0.75
BLOCK = 4
#: Bytes of item texts in one index shard: the bound of what is sent to tasks.
SHARD_BYTES = 16_000_000
#: Cells (halves of a text by blocks of the index) whose bounds are held at once.
CELLS = 1 << 17

_WORD = re.compile(r"\w+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """The last sentence is the answer; of a single sentence, the last third."""
    parts = [w for w in map(words_of, _SENTENCE.split(text.strip())) if w]
    if len(parts) > 1:
        return [w for p in parts[:-1] for w in p], parts[-1]
    words = parts[0] if parts else []
    cut = len(words) - len(words) // 3
    return words[:cut], words[cut:]


def units_of(words: list[str]) -> list[list[str]]:
    """An item's words in pieces of near-equal length, ``UNIT`` words at most."""
    pieces = -(-len(words) // UNIT)
    return [words[len(words) * k // pieces:len(words) * (k + 1) // pieces] for k in range(pieces)]


def grams(words: list[str]) -> set[tuple[str, ...]]:
    n = min(GRAM, len(words))
    return {tuple(words[i:i + n]) for i in range(len(words) - n + 1)} if n else set()


def held(part: list[str], region: list[str]) -> float:
    """Share of a part's trigrams (of its words, if shorter) in the region; an
    empty part is held."""
    own = grams(part)
    n = min(GRAM, len(part))
    return len(own & {tuple(region[i:i + n]) for i in range(len(region) - n + 1)}) / len(own) if own else 1.0


class Index:
    """Inverted index of the units of some items, with block maxima."""

    def __init__(self, items: list[tuple[object, str]], statistics: tuple[int, float, dict[str, int]] | None = None):
        """items: (id, text).  statistics: number and mean length of the units of
        all items and in how many each term stands, where these are but a part."""
        self.items = []
        units: list[tuple[int, Counter]] = []
        for item, text in items:
            words = words_of(text)
            if not words:
                continue
            self.items.append((item, *question_and_answer(text), len(words)))
            units += [(len(self.items) - 1, Counter(unit)) for unit in units_of(words)]
        local = Counter(t for _, tf in units for t in tf)
        # units that share their commonest terms become neighbours, so blocks are alike
        units.sort(key=lambda u: sorted(u[1], key=lambda t: (-local[t], t))[:4])
        self.item_of = [i for i, _ in units]
        n = len(units)
        every, mean, df = statistics or (n, sum(tf.total() for _, tf in units) / max(n, 1), local)
        idf = {t: math.log(1 + (every - df[t] + 0.5) / (df[t] + 0.5)) for t in local}
        df = local
        self.vocabulary = {t: k for k, t in enumerate(df)}
        self.units: list[list[int]] = [[] for _ in df]
        self.impacts: list[list[float]] = [[] for _ in df]
        for u, (_, tf) in enumerate(units):
            norm = K1 * (1 - B + B * tf.total() / mean)
            impact = {t: idf[t] * f * (K1 + 1) / (f + norm) for t, f in tf.items()}
            own = sum(impact.values())
            for t, x in impact.items():
                self.units[self.vocabulary[t]].append(u)
                self.impacts[self.vocabulary[t]].append(x / own)
        self.most = np.array([max(x) for x in self.impacts], dtype=np.float64)
        self.block_most = [[max(x[i:i + BLOCK]) for i in range(0, len(x), BLOCK)] for x in self.impacts]
        # the same by aligned blocks of units, as one sparse matrix of terms by blocks
        wide: list[dict[int, float]] = [{} for _ in df]
        for t, (posts, x) in enumerate(zip(self.units, self.impacts)):
            for u, v in zip(posts, x):
                wide[t][u // BLOCK] = max(wide[t].get(u // BLOCK, 0.0), v)
        self.blocks = -(-n // BLOCK)
        self.wide_start = np.cumsum([0, *map(len, wide)])
        self.wide_block = np.array([b for row in wide for b in row], dtype=np.int64)
        self.wide_most = np.array([v for row in wide for v in row.values()])

    def search(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """All units whose summed impacts reach the threshold, by block-max WAND."""
        least = threshold - 1e-9
        at = dict.fromkeys(terms, 0)  # each term's cursor into its postings
        live = sorted(terms, key=lambda t: self.units[t][0])
        found = []
        while live:
            bound, pivot = 0.0, -1
            for k, t in enumerate(live):
                bound += self.most[t]
                if bound >= least:
                    pivot = k
                    break
            if pivot < 0:
                break
            unit = self.units[live[pivot]][at[live[pivot]]]
            while pivot + 1 < len(live) and self.units[live[pivot + 1]][at[live[pivot + 1]]] == unit:
                pivot += 1
            # block maxima at the pivot unit, without moving deep cursors
            bound, after = 0.0, math.inf
            for t in live[:pivot + 1]:
                posts = self.units[t]
                k = bisect_left(posts, unit, at[t])
                if k < len(posts):
                    bound += self.block_most[t][k // BLOCK]
                    after = min(after, posts[min((k // BLOCK + 1) * BLOCK, len(posts)) - 1] + 1)
            if bound < least:
                # no unit before the end of these blocks, nor before the next list, can reach it
                if pivot + 1 < len(live):
                    after = min(after, self.units[live[pivot + 1]][at[live[pivot + 1]]])
                target = int(max(after, unit + 1)) if after < math.inf else unit + 1
            else:
                total = 0.0
                for t in live[:pivot + 1]:
                    posts = self.units[t]
                    k = bisect_left(posts, unit, at[t])
                    if k < len(posts) and posts[k] == unit:
                        total += self.impacts[t][k]
                if total >= least:
                    found.append((unit, total))
                target = unit + 1
            for t in live[:pivot + 1]:
                at[t] = bisect_left(self.units[t], target, at[t])
            live = sorted((t for t in live if at[t] < len(self.units[t])), key=lambda t: self.units[t][at[t]])
        return found

    def candidates(self, half: np.ndarray, term: np.ndarray, least: float) -> np.ndarray:
        """Passages that some block's maxima allow to reach ``least``: WAND finds
        no pivot in a block whose term maxima together miss the threshold.

        half, term: the different terms of each half, by half.
        """
        passages = int(half[-1]) + 1
        step = max(1, CELLS // self.blocks)
        last = np.zeros((1, self.blocks))  # bounds of the half before the slice
        found = []
        for lo in range(0, passages + 1, step):
            rows = min(step, passages + 1 - lo)
            a, b = np.searchsorted(half, [lo, lo + rows])
            first = self.wide_start[term[a:b]]
            many = self.wide_start[term[a:b] + 1] - first
            ends = np.cumsum(many)
            entry = np.arange(many.sum()) + np.repeat(first - (ends - many), many)
            cell = np.repeat(half[a:b] - lo, many) * self.blocks + self.wide_block[entry]
            bound = np.concatenate([last, np.bincount(cell, self.wide_most[entry], minlength=rows * self.blocks).reshape(rows, self.blocks)])
            last = bound[-1:].copy()
            at = np.flatnonzero((bound[:-1] + bound[1:]).max(axis=1) >= least) + lo - 1
            found.append(at[at >= 0])  # before the text there is no passage
        return np.concatenate(found)

    def leaks(self, text: str | None, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> list[tuple]:
        """(item, score, first word of the passage, question and answer overlap)
        of every verified item, best passage each, by item order."""
        words = words_of(text)
        get = self.vocabulary.get
        term = np.array([get(w, -1) for w in words], dtype=np.int64)
        at = np.flatnonzero(term >= 0)
        if not len(at):
            return []
        n = len(self.vocabulary)
        pairs = np.unique(at // HALF * n + term[at])  # each term once in each half
        half, term = pairs // n, pairs % n
        best: dict[int, tuple] = {}
        for k in self.candidates(half, term, threshold - 1e-9):
            lo, hi = np.searchsorted(half, [k, k + 2])
            for unit, score in self.search(np.unique(term[lo:hi]).tolist(), threshold):
                i = self.item_of[unit]
                if i in best and best[i][1] >= score:
                    continue
                item, question, answer, size = self.items[i]
                if size < SHORT and words != [*question, *answer]:
                    continue
                region = words[max(0, k * HALF - size):(k + 2) * HALF + size]
                q, a = held(question, region), held(answer, region)
                if q >= overlap and a >= overlap:
                    best[i] = (item, score, int(k * HALF), q, a)
        return [best[i] for i in sorted(best)]


def shards(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> tuple[list[DataFrame], DataFrame | None]:
    """The items in parts of at most about ``shard_bytes`` of text, and the
    statistics of all of them where there are several parts."""
    items = benchmark.select(F.col(f"`{id_col}`").alias("item"), F.col(f"`{text_col}`").cast("string").alias("text")).filter(F.col("text").isNotNull())
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = -(-size // shard_bytes)
    if parts <= 1:
        return ([items] if parts else []), None
    return [items.filter(F.pmod(F.xxhash64("text"), F.lit(parts)) == k) for k in range(parts)], cut(_statistics(items))


def _statistics(items: DataFrame) -> DataFrame:
    """(term, n, size): in how many units of all items each term stands; on the
    row without a term the units and their words."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            df: Counter = Counter()
            n = size = 0
            for text in b.column(0).to_pylist():
                for unit in units_of(words_of(text)):
                    df.update(set(unit))
                    n, size = n + 1, size + len(unit)
            yield pa.RecordBatch.from_arrays([pa.array([None, *df], pa.string()), pa.array([n, *df.values()], pa.int64()), pa.array([size, *[0] * len(df)], pa.int64())], ["term", "n", "size"])

    return items.select("text").mapInArrow(count, "term string, n long, size long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("size").alias("size"))


def _index(part: DataFrame, statistics: DataFrame | None) -> Index:
    """The index of one shard.  Its items come to the driver, ``SHARD_BYTES`` of
    text at most, with the counts of their own terms."""
    known = None
    if statistics is not None:
        total = statistics.filter("term is null").first()

        def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array({w for t in b.column(0).to_pylist() for w in words_of(t)}, pa.string())], ["term"])

        own = part.select("text").mapInArrow(terms, "term string").distinct().join(statistics, "term").select("term", "n").toArrow()
        known = (total["n"], total["size"] / max(total["n"], 1), dict(zip(own["term"].to_pylist(), own["n"].to_pylist())))
    return Index([(r["item"], r["text"]) for r in part.orderBy("text", "item").collect()], known)


def _leaks_type(part: DataFrame) -> T.ArrayType:
    """One struct an item held; the item's id keeps its type."""
    names = [("item_id", part.schema["item"].dataType), ("score", T.DoubleType()), ("first_word", T.LongType()), ("question_overlap", T.DoubleType()), ("answer_overlap", T.DoubleType())]
    return T.ArrayType(T.StructType([T.StructField(n, t) for n, t in names]))


def _finder(text: Column, part: DataFrame, index: Index, threshold: float, overlap: float) -> Column:
    out = _leaks_type(part)
    kind = to_arrow_type(out)

    @F.arrow_udf(out)
    def find(texts: pa.Array) -> pa.Array:
        names = [f.name for f in kind.value_type]
        return pa.array([[dict(zip(names, x)) for x in index.leaks(t, threshold, overlap)] for t in texts.to_pylist()], kind)

    return find(text.cast("string"))


def _nothing(benchmark: DataFrame, id_col: str = "item_id", **_) -> Column:
    return F.array().cast(_leaks_type(benchmark.select(F.col(f"`{id_col}`").alias("item"))))


def leaks(text: Column, benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP, **items) -> Column:
    """Items of ``benchmark`` that a text holds, as an array of structs.

    Null and empty texts and items hold nothing; a null item id stays null;
    repeated items are reported each.  Texts are read whole.  As one expression
    it holds the indexes of all shards at once; ``found_items`` and
    ``drop_holders`` hold one.  Scores do not depend on the number of shards.
    """
    parts, statistics = shards(benchmark, **items)
    found = [_finder(text, part, _index(part, statistics), threshold, overlap) for part in parts]
    return reduce(lambda a, b: F.concat(a, b), found) if found else _nothing(benchmark, **items)


def found_items(docs: DataFrame, benchmark: DataFrame, keep: list[str], text_col: str = "text", threshold: float = THRESHOLD, overlap: float = OVERLAP, **items) -> DataFrame:
    """The columns ``keep`` and an item's, a row for each item that a row holds;
    one shard after another, each shard's rows kept before the next is indexed."""
    parts, statistics = shards(benchmark, **items)
    text = F.col(f"`{text_col}`")
    out = [docs.select(*keep, F.inline(_nothing(benchmark, **items)))] if not parts else []
    for k, part in enumerate(parts, 1):
        found = docs.select(*keep, F.inline(_finder(text, part, _index(part, statistics), threshold, overlap)))
        out.append(cut(found) if k < len(parts) else found)
    return reduce(DataFrame.union, out)


def drop_holders(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", threshold: float = THRESHOLD, overlap: float = OVERLAP, **items) -> DataFrame:
    """Rows that hold no item; one shard after another, over what the last left."""
    parts, statistics = shards(benchmark, **items)
    for k, part in enumerate(parts, 1):
        docs = docs.filter(F.size(_finder(F.col(f"`{text_col}`"), part, _index(part, statistics), threshold, overlap)) == 0)
        docs = cut(docs) if k < len(parts) else docs
    return docs
