"""Operator 1: regularised quadratic discriminant for document quality.

Each whole text becomes a short vector of transformed statistics.  Labelled
rows give class means and covariances (sums that merge, so no rows travel);
each covariance is shrunk towards the pooled one and then towards a diagonal.
A score is the Mahalanobis log-density difference of the two classes plus the
log prior odds, computed with the inverse Cholesky factors kept in the model.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arlens.llm.common import utf8

#: At most about so many labelled rows are fitted, drawn by a hash of the id.
FIT_ROWS = 100_000
#: Weight of the pooled covariance, then of its diagonal, in a class covariance.
POOLED, DIAGONAL = 0.10, 0.05
#: Log-odds are divided by this before the logistic, as features are not
#: independent normals and raw quadratic log-odds overstate the evidence.
TEMPERATURE = 4.0
KEEP = 0.7

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True
_LETTER[128:] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>{}[]\\^~_=+@/")] = True
_MARK = np.zeros(256, bool)
_MARK[list(b".,;:!?'\"()-")] = True
NAMES = ["log_words", "word_bytes", "upper", "digits", "symbols", "marks", "distinct", "top_word", "ratio", "dup_lines", "line_words", "entropy"]


def _share(part: float, whole: float) -> float:
    """Log-odds of a share, smoothed so that short texts stay near the middle."""
    return math.log((part + 0.5) / (whole - part + 10.0))


def statistics(raw: bytes, pack) -> list[float]:
    """The vector of one text; empty texts have one too."""
    words = raw.split()
    n, size = len(words), len(raw)
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    letters = int(count[_LETTER].sum())
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    lines = [x for x in raw.split(b"\n") if x.strip()]
    p = count[count > 0] / max(size, 1)
    return [
        math.log1p(n),
        math.log((size - n + 10.0) / (n + 2.0)),
        _share(int(count[_UPPER].sum()), letters),
        _share(int(count[_DIGIT].sum()), size),
        _share(int(count[_SYMBOL].sum()), size),
        _share(int(count[_MARK].sum()), size),
        _share(len(seen), n),
        _share(max(seen.values(), default=0), n),
        math.log((len(pack(raw)) + 20.0) / (size + 40.0)),
        _share(len(lines) - len(set(lines)), len(lines)),
        math.log((n + 5.0) / (len(lines) + 1.0)),
        float(-(p * np.log(p)).sum()) if size else 0.0,
    ]


def _matrix(texts: pa.Array) -> np.ndarray:
    import zstandard

    pack = zstandard.ZstdCompressor(level=1, write_content_size=False, write_checksum=False).compress
    return np.array([statistics(raw, pack) for raw in utf8(texts)], dtype=float).reshape(-1, len(NAMES))


class Model(NamedTuple):
    """Means, inverse Cholesky factors and log terms of class 0 and class 1."""

    mean: tuple[np.ndarray, np.ndarray]
    factor: tuple[np.ndarray, np.ndarray]
    constant: tuple[float, float]

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        d = [c - 0.5 * (((x - m) @ f.T) ** 2).sum(axis=1) for m, f, c in zip(self.mean, self.factor, self.constant)]
        return d[1] - d[0]


def solve(n: np.ndarray, total: np.ndarray, outer: np.ndarray, pooled: float = POOLED, diagonal: float = DIAGONAL) -> Model | None:
    """Model from the counts, sums and sums of outer products of both classes;
    None unless both classes have rows."""
    if min(n) < 1:
        return None
    d = total.shape[1]
    mean = total / n[:, None]
    scatter = outer - n[:, None, None] * mean[:, :, None] * mean[:, None, :]
    common = scatter.sum(axis=0) / max(n.sum() - 2, 1) + 1e-6 * np.eye(d)
    factor, constant = [], []
    for k in (0, 1):
        weight = max(pooled, d / (d + n[k]))  # small classes lean on the pooled one
        cov = (1 - weight) * scatter[k] / max(n[k] - 1, 1) + weight * common
        cov = (1 - diagonal) * cov + diagonal * np.diag(np.diag(common))
        lower = np.linalg.cholesky(cov)
        factor.append(np.linalg.inv(lower))
        constant.append(float(math.log(n[k] / n.sum()) - np.log(np.diag(lower)).sum()))
    return Model((mean[0], mean[1]), (factor[0], factor[1]), (constant[0], constant[1]))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS) -> Model | None:
    """Model from ``labels`` (id, ``label`` 0 or 1; other and null labels are
    skipped) and the texts of ``docs``.

    More than ``fit_rows`` labels are thinned to about that many by a hash of
    the id, so the labels sent to the tasks have a bound; texts never move.
    A document labelled both ways counts on both sides.
    """
    known = labels.filter(F.col("label").isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col("label").cast("int").alias("_label")).distinct()
    n = known.count()
    if n > fit_rows:
        known = known.filter(F.pmod(F.xxhash64("_id", F.lit(7)), F.lit(1 << 30)) < int((1 << 30) * fit_rows / n))
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text")).join(F.broadcast(known), "_id").select("_label", "_text")
    d = len(NAMES)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((2, 1 + d + d * d))
        for b in batches:
            y, x = b.column(0).to_numpy(), _matrix(b.column(1))
            for k in (0, 1):
                z = x[y == k]
                out[k] += np.concatenate([[len(z)], z.sum(axis=0), (z.T @ z).ravel()])
        at = np.tile(np.arange(out.shape[1]), 2)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat([0, 1], out.shape[1])), pa.array(at), pa.array(out.ravel())], ["k", "at", "v"])

    found = rows.mapInArrow(sums, "k long, at long, v double").groupBy("k", "at").agg(F.sum("v").alias("v")).collect()
    total = np.zeros((2, 1 + d + d * d))
    for r in found:
        total[r["k"], r["at"]] = r["v"]
    return solve(total[:, 0], total[:, 1:1 + d], total[:, 1 + d:].reshape(2, d, d))


def score(text: Column, model: Model | None, temperature: float = TEMPERATURE) -> Column:
    """Score of one text, 0 to 1, higher for label 1; null reads as empty.
    Without a model (a class had no labelled rows) every score is 1."""
    if model is None:
        return F.lit(1.0)

    @F.arrow_udf("double")
    def rate(texts: pa.Array) -> pa.Array:
        odds = model.log_odds(_matrix(texts)) / temperature
        return pa.array(1.0 / (1.0 + np.exp(-np.clip(odds, -500, 500))))

    return rate(text.cast("string"))
