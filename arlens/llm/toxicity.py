"""Operator 6: toxicity by class-conditional Kneser-Ney models.

Toxic and ordinary texts each have an interpolated Kneser-Ney model of how words
are spelt, over the symbols of a word from the blank before it to the one behind.
Only the highest order has counts of its own for each class; all lower orders
are continuation counts that both classes share, taken from all documents, so
expressions rare in one class fall back on the same distribution.

A word's evidence is the difference of its two log-likelihoods, a text's is that
difference over its number of words.  Each different word of a text counts once,
in training too, so a line repeated a hundred times is no more than one.  What
words say beyond a margin is averaged in the same way; the margin and the
logistic curve over both averages are fitted on labelled rows kept out of the
counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arlens.llm.common import cut, slices

ORDER = 6
DISCOUNT = 0.75
#: Occurrences that the shared distribution counts for in each class's context.
STRENGTH = 50.0
#: At most about so many labelled rows, half of them of one class at most unless
#: the other has fewer, give class counts and the curve; the shared counts come
#: from every document.
FIT_ROWS = 100_000
#: Parts of the n-grams, by the two symbols before the last; a context and its
#: continuations lie in one part.
PARTS = 64
#: N-grams that a task holds before it merges equal ones.
TALLY = 4_000_000
SLICE = 4_000_000
#: One in so many labelled rows fits margin and curve instead of the counts.
CURVE_FOLD = 5
#: Margins that are tried, in log-likelihood difference of a word.
MARGINS = (0.5, 1.0, 1.5, 2.0, 3.0, 4.0, 6.0)


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(text, word) of the different words of each text, and the words: runs
    between ASCII blanks, lower-cased."""
    split = pc.ascii_split_whitespace(pc.utf8_lower(texts))
    word, owner = pc.list_flatten(split), pc.list_parent_indices(split)
    some = pc.not_equal(word, "")
    coded = word.filter(some).dictionary_encode()
    owner = owner.filter(some).to_numpy(zero_copy_only=False).astype(np.int64)
    kinds = max(len(coded.dictionary), 1)
    pair = np.unique(owner * kinds + coded.indices.to_numpy(zero_copy_only=False))
    return pair // kinds, pair % kinds, coded.dictionary


def grams(word: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram that ends at each symbol of each word, 8 bits a symbol, oldest
    first, zero before the blank that a word starts with; and its word.

    Symbols are lower-cased code points as 7-bit classes: ASCII as it is, digits
    alike, others by remainder into 128 to 255.
    """
    if not len(word):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    size = pc.utf8_length(word).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    a = np.frombuffer((" " + " ".join(word.to_pylist()) + " ").encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    a = np.where(a < 128, a, 128 + a % 128)
    a = np.where((a >= 48) & (a <= 57), 48, np.maximum(a, 1))
    start = np.repeat(np.cumsum(size) - size, size)
    at = np.arange(size.sum()) + 1
    code = np.zeros(len(at), np.int64)
    for back in range(ORDER):
        from_ = at - back
        code |= np.where(from_ >= start, a[np.maximum(from_, 0)], 0) << (8 * back)
    return code, np.repeat(np.arange(len(word)), size)


def _suffix(code: np.ndarray, order: int) -> np.ndarray:
    return code & ((1 << (8 * order)) - 1)


class Model(NamedTuple):
    """gram, ratio: n-grams of either class and their log-likelihood ratio;
    context, backoff: contexts and the ratio for n-grams new to both; margin and
    the curve's constant, weight of the mean, weight of the mean excess."""

    gram: np.ndarray
    ratio: np.ndarray
    context: np.ndarray
    backoff: np.ndarray
    margin: float
    curve: tuple[float, float, float]


def _found(keys: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, code), max(len(keys) - 1, 0))
    return at, (keys[at] == code) if len(keys) else np.zeros(len(code), bool)


def word_evidence(word: pa.Array, model: Model) -> np.ndarray:
    """Log-likelihood of each word as a toxic text's less that as an ordinary's."""
    code, owner = grams(word)
    at, there = _found(model.gram, code)
    below, known = _found(model.context, code >> 8)
    r = np.zeros(len(code))
    r[known] = model.backoff[below[known]]
    r[there] = model.ratio[at[there]]
    return np.bincount(owner, r, len(word))


def evidence(texts: pa.Array, model: Model, margins: tuple[float, ...]) -> np.ndarray:
    """For each text the mean evidence of its words, then the mean excess over
    each margin; zeros for a text without words."""
    out = []
    for part in slices(texts, SLICE):
        owner, at, word = words(part)
        value = word_evidence(word, model)[at]
        n = np.maximum(np.bincount(owner, minlength=len(part)), 1)
        out.append(np.stack([np.bincount(owner, v, len(part)) / n for v in (value, *(np.maximum(value - m, 0) for m in margins))], axis=1))
    return np.concatenate(out) if out else np.zeros((0, 1 + len(margins)))


# -------------------------------------------------------------------- counting


def _merged(gram: np.ndarray, *counts: np.ndarray) -> tuple[np.ndarray, ...]:
    kinds, at = np.unique(gram, return_inverse=True)
    return kinds, *(np.bincount(at, c, len(kinds)).astype(np.int64) for c in counts)


_PACKED = "part int, gram binary, toxic binary, ordinary binary"


def _packed(part: int, gram: np.ndarray, toxic: np.ndarray, ordinary: np.ndarray) -> list:
    """One row: n-grams of a class first, with both counts, then all others."""
    own = toxic + ordinary > 0
    return [part, np.concatenate([gram[own], gram[~own]]).tobytes(), toxic[own].astype(np.int32).tobytes(), ordinary[own].astype(np.int32).tobytes()]


def _rows(rows: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), *[pa.large_binary()] * 3))], ["part", "gram", "toxic", "ordinary"])


def count_grams(rows: DataFrame) -> DataFrame:
    """The n-grams of all rows (``_label`` 1, 0 or null, ``_text``) in ``PARTS``
    packed rows: in how many texts and words of toxic and ordinary rows each
    stands; those of other rows have no counts.

    A task sends one row a part, sorted and merged, whatever its number of texts.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def merge() -> None:
            held[:] = [_merged(*map(np.concatenate, zip(*held)))]

        for b in batches:
            start = 0
            for part in slices(b.column(1), SLICE):
                label = b.column(0).slice(start, len(part)).fill_null(2).to_numpy(zero_copy_only=False)
                start += len(part)
                owner, at, word = words(part)
                code, of = grams(word)
                n = [np.bincount(at[label[owner] == k], minlength=len(word))[of] for k in (1, 0)]
                held.append(_merged(code, *n))
                if sum(len(h[0]) for h in held) > TALLY:
                    merge()
        if held:
            merge()
            gram, toxic, ordinary = held[0]
            part = _part(gram)
            order = np.argsort(part, kind="stable")
            edge = np.searchsorted(part[order], np.arange(PARTS + 1))
            for k in range(PARTS):
                own = order[edge[k]:edge[k + 1]]
                if len(own):
                    yield _rows([_packed(k, gram[own], toxic[own], ordinary[own])])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for b in batches:
            for k, gram, toxic, ordinary in zip(*(c.to_pylist() for c in b.columns)):
                held.setdefault(k, []).append(_unpacked(gram, toxic, ordinary))
                if sum(len(h[0]) for h in held[k]) > TALLY:
                    held[k] = [_merged(*map(np.concatenate, zip(*held[k])))]
        for k, own in held.items():
            yield _rows([_packed(k, *_merged(*map(np.concatenate, zip(*own))))])

    return rows.mapInArrow(count, _PACKED).repartition(PARTS, "part").mapInArrow(add, _PACKED)


def _part(gram: np.ndarray) -> np.ndarray:
    return (((gram >> 8) & 0xFFFF) * 40503 >> 5) % PARTS


def _unpacked(gram: bytes, toxic: bytes, ordinary: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    g = np.frombuffer(gram, np.int64)
    counts = []
    for raw in (toxic, ordinary):
        n = np.zeros(len(g), np.int64)
        own = np.frombuffer(raw, np.int32)
        n[:len(own)] = own
        counts.append(n)
    return g, *counts


def pair_counts(gram: np.ndarray) -> np.ndarray:
    """How many different symbols stand before each pair of symbols, as far as
    this part has them (256 x 256); each triple lies in one part."""
    return np.bincount(_suffix(np.unique(_suffix(gram, 3)), 2), minlength=1 << 16)


def _interpolated(n: np.ndarray, context: np.ndarray, below: np.ndarray) -> np.ndarray:
    kinds, at = np.unique(context, return_inverse=True)
    total = np.bincount(at, n)[at]
    return np.maximum(n - DISCOUNT, 0) / total + DISCOUNT * np.bincount(at)[at] / total * below


def pair_probabilities(n: np.ndarray) -> np.ndarray:
    """Shared probability of the second symbol of each pair behind the first."""
    pair = np.flatnonzero(n)
    last = np.unique(pair & 255, return_inverse=True)
    one = _interpolated(np.bincount(last[1]).astype(float), np.zeros(len(last[0])), np.full(len(last[0]), 1 / 256))
    out = np.zeros(1 << 16)
    out[pair] = _interpolated(n[pair].astype(float), pair >> 8, one[last[1]])
    return out


def ratios(gram: np.ndarray, toxic: np.ndarray, ordinary: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, ...]:
    """gram, ratio, context, backoff of the n-grams of a class in one part.

    Order by order from three symbols up to one below the highest, a shorter
    n-gram counts the different symbols that precede it; its probability is
    interpolated from the next shorter one's.
    """
    levels = {ORDER: np.unique(gram)}
    for order in range(ORDER - 1, 2, -1):
        levels[order] = np.unique(_suffix(levels[order + 1], order))
    p = pairs[_suffix(levels[3], 2)]
    for order in range(3, ORDER):
        own, longer = levels[order], _suffix(levels[order + 1], order)
        n = np.bincount(np.searchsorted(own, longer), minlength=len(own)).astype(float)
        if order > 3:
            p = p[np.searchsorted(levels[order - 1], _suffix(own, order - 1))]
        p = _interpolated(n, own >> 8, p)
    classed = toxic + ordinary > 0
    gram, counts = gram[classed], (toxic[classed].astype(float), ordinary[classed].astype(float))
    shared = p[np.searchsorted(levels[ORDER - 1], _suffix(gram, ORDER - 1))]
    context, at = np.unique(gram >> 8, return_inverse=True)
    log, rest = [], []
    for n in counts:
        total = np.bincount(at, n, len(context)) + STRENGTH
        left = (STRENGTH + DISCOUNT * np.bincount(at, n > 0, len(context))) / total
        log.append(np.log(np.maximum(n - DISCOUNT, 0) / total[at] + left[at] * shared))
        rest.append(np.log(left))
    return gram, log[0] - log[1], context, rest[0] - rest[1]


def _tables(rows: DataFrame) -> tuple[np.ndarray, ...]:
    """gram, ratio, context, backoff over all parts, sorted.  What comes to the
    driver are pairs of symbols (65,536 at most a part) and the n-grams of the
    labelled rows, which ``FIT_ROWS`` bounds."""
    parts = cut(count_grams(rows))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for b in batches:
            for raw in b.column(0).to_pylist():
                total += pair_counts(np.frombuffer(raw, np.int64))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["pair", "n"])

    got = parts.select("gram").mapInArrow(pairs, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros(1 << 16, np.int64)
    n[got["pair"].to_numpy()] = got["n"].to_numpy()
    sent = rows.sparkSession.sparkContext.broadcast(pair_probabilities(n))

    def table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, *raw in zip(*(c.to_pylist() for c in b.columns)):
                made = ratios(*_unpacked(*raw), sent.value)
                for kind, key, value in ((0, *made[:2]), (1, *made[2:])):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int8)), pa.array(key), pa.array(value)], ["kind", "key", "value"])

    out = parts.mapInArrow(table, "kind byte, key long, value double").toArrow()
    kind, key, value = (out[c].to_numpy() for c in ("kind", "key", "value"))
    tables = []
    for k in (0, 1):
        order = np.argsort(key[kind == k])
        tables += [key[kind == k][order], value[kind == k][order]]
    return tuple(tables)


# --------------------------------------------------------------------- the curve


def fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, tuple[float, float, float]]:
    """Margin and logistic weights (constant, mean, mean excess) that make the
    labels ``y`` likeliest; columns of ``x``: the mean, then the excess over each
    of ``MARGINS``.  A weak pull towards small weights keeps them finite."""
    best = (np.inf, MARGINS[0], (0.0, 0.0, 0.0))
    if not len(y):
        return MARGINS[0], (-1.0, 1.0, 1.0)
    for k, margin in enumerate(MARGINS):
        f = x[:, [0, k + 1]]
        middle, width = f.mean(axis=0), f.std(axis=0) + 1e-6
        z = np.column_stack([np.ones(len(y)), (f - middle) / width])
        w = np.zeros(3)
        pull = np.array([0.01, 0.1, 0.1])
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(pull), z.T @ (y - p) - pull * w)
            w = w + np.clip(step, -2, 2)
            if abs(step).max() < 1e-9:
                break
        p = np.clip(1 / (1 + np.exp(-np.clip(z @ w, -30, 30))), 1e-12, 1 - 1e-12)
        loss = -(y * np.log(p) + (1 - y) * np.log(1 - p)).sum() + 0.5 * (pull * w * w).sum()
        if loss < best[0]:
            slope = w[1:] / width
            best = (loss, margin, (float(w[0] - (slope * middle).sum()), float(slope[0]), float(slope[1])))
    return best[1], best[2]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS) -> Model | None:
    """Model from ``labels`` (id, ``label`` 0 or 1; other and null labels are
    skipped) and the whole texts of ``docs``.

    The shared orders are counted over all documents, labelled or not, and so
    grow with the input.  Labels beyond ``fit_rows`` are thinned by a hash of
    the id, each class by itself: a class with no more than half of them keeps
    all its rows.  This bounds what is broadcast to the scan and the class
    tables.  None unless both classes have rows; a document labelled both ways
    counts on both sides.
    """
    known = labels.filter(F.col("label").isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col("label").cast("int").alias("_label")).distinct()
    n = {r["_label"]: r["count"] for r in known.groupBy("_label").count().collect()}
    if len(n) < 2:
        return None
    # xxhash64 is independent of the crc32 folds by which callers split labels
    draw = lambda salt, mod: F.pmod(F.xxhash64("_id", F.lit(salt)), F.lit(mod))
    few = min(n.values())
    room = {k: fit_rows - min(few, fit_rows // 2) if v > few else fit_rows // 2 for k, v in n.items()}
    share = {k: int((1 << 30) * min(1.0, room[k] / v)) for k, v in n.items()}
    known = known.filter(draw(7, 1 << 30) < F.when(F.col("_label") == 1, F.lit(share[1])).otherwise(F.lit(share[0])))
    texts = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text"))
    aside = draw(11, CURVE_FOLD) == 0
    tables = _tables(texts.join(F.broadcast(known.filter(~aside)), "_id", "left").select("_label", "_text"))
    model = Model(*tables, MARGINS[0], (0.0, 0.0, 0.0))
    x = _evidence(F.col("_text"), model, MARGINS)
    got = texts.join(F.broadcast(known.filter(aside)), "_id").select("_label", x.alias("x")).toPandas()
    margin, curve = fit_curve(np.array(got["x"].tolist()).reshape(len(got), 1 + len(MARGINS)), got["_label"].to_numpy(float))
    return model._replace(margin=margin, curve=curve)


def _evidence(text: Column, model: Model, margins: tuple[float, ...]) -> Column:
    from pyspark.sql import SparkSession

    shared = SparkSession.getActiveSession().sparkContext.broadcast(model)

    @F.arrow_udf("array<double>")
    def rate(texts: pa.Array) -> pa.Array:
        x = evidence(texts, shared.value, margins)
        return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))

    return rate(text)


def score(text: Column, model: Model | None) -> Column:
    """Score of one text, 0 to 1, higher for toxic; null reads as empty, and an
    empty text has no evidence either way.  Without a model every score is 0."""
    if model is None:
        return F.lit(0.0)
    x = _evidence(text.cast("string"), model, (model.margin,))
    base, mean, excess = (F.lit(w) for w in model.curve)
    return 1 / (1 + F.exp(-(base + mean * x[0] + excess * x[1])))
