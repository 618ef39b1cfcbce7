"""Operator 2: quality rules with compression bands.

The zstandard ratio (compressed bytes over raw bytes) of the whole text and of
each fixed chunk must lie inside a band that depends on the length: repetitive
text falls below it, incompressible text above it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from arlens.llm.common import utf8

LEVEL = 3
CHUNK = 4096
#: (bytes up to, least ratio, greatest ratio) of whole texts and of chunks.
BANDS = [(128, 0.45, 12.0), (256, 0.42, 1.05), (512, 0.38, 0.95), (1024, 0.32, 0.85), (4096, 0.28, 0.80), (16384, 0.24, 0.75), (1 << 62, 0.20, 0.70)]
#: Share of chunks outside their band from which a text is rejected.
BAD_CHUNKS = 0.34
#: Fixed values of the base rules.
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
SHORT = 20
REPEAT_WINDOW = 8
REPEAT_PERCENT = 30


def repeated_words(words: list[bytes], width: int = REPEAT_WINDOW) -> int:
    """Words that lie in a ``width``-word window found twice or more.

    Exact: windows are named by doubling, so equal names mean equal windows.
    """
    n = len(words)
    if n <= width:
        return 0
    number: dict[bytes, int] = {}
    names = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64)
    if len(number) == n:
        return 0
    span = 1
    while span < width:
        pair = names[:-span] * (names.max() + 1) + names[span:]
        kinds, names = np.unique(pair, return_inverse=True)
        if len(kinds) == len(pair):
            return 0
        span *= 2
    many = np.bincount(names)[names] > 1
    cover = np.zeros(n + 1, dtype=np.int64)
    at = np.flatnonzero(many)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + width, -1)
    return int((np.cumsum(cover[:-1]) > 0).sum())


def counts(raw: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = raw.split()
    kept = raw.translate(None, SPACES)
    points = len(kept) if kept.isascii() else len(kept.decode("utf-8", "replace"))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return len(words), points, len(raw) - len(raw.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


def in_band(ratio: float, size: int, bands=BANDS) -> bool:
    low, high = next((lo, hi) for top, lo, hi in bands if size <= top)
    return low <= ratio <= high


def compression(raw: bytes, pack, chunk: int = CHUNK, bands=BANDS) -> tuple[float, int, int, bool]:
    """Ratio of the whole text, chunks, chunks outside their band, verdict."""
    if not raw:
        return 0.0, 0, 0, False
    whole = len(pack(raw)) / len(raw)
    if len(raw) <= chunk:
        ok = in_band(whole, len(raw), bands)
        return whole, 1, int(not ok), ok
    bad = pieces = 0
    for at in range(0, len(raw), chunk):
        piece = raw[at:at + chunk]
        pieces += 1
        bad += not in_band(len(pack(piece)) / len(piece), len(piece), bands)
    return whole, pieces, bad, in_band(whole, len(raw), bands) and bad < BAD_CHUNKS * pieces


_FIELDS = [("n_words", "long", pa.int64()), ("word_chars", "long", pa.int64()), ("n_symbols", "long", pa.int64()), ("n_dup_lines", "long", pa.int64()), ("n_repeat_words", "long", pa.int64()), ("zstd_ratio", "double", pa.float64()), ("n_chunks", "long", pa.int64()), ("bad_chunks", "long", pa.int64()), ("band_ok", "boolean", pa.bool_())]


def text_rules(text: Column) -> Column:
    """Struct of the base counts, the compression figures and ``band_ok``.

    Null and empty texts have no words and no ratio and are not ``band_ok``.
    Whole texts are read; words are runs of anything but ASCII white space.
    """
    @F.arrow_udf("struct<" + ",".join(f"{n}:{t}" for n, t, _ in _FIELDS) + ">")
    def measure(texts: pa.Array) -> pa.Array:
        import zstandard

        pack = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False).compress
        rows = [(*counts(raw), *compression(raw, pack)) for raw in utf8(texts)]
        columns = list(zip(*rows)) or [[] for _ in _FIELDS]
        return pa.StructArray.from_arrays([pa.array(c, t) for c, (_, _, t) in zip(columns, _FIELDS)], [n for n, _, _ in _FIELDS])

    return measure(text.cast("string"))


def base_failed(rules: Column) -> Column:
    return (rules["n_words"] < SHORT) | (rules["n_repeat_words"] * 100 > rules["n_words"] * REPEAT_PERCENT)
