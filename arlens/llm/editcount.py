"""Operator 5: token counts that follow edits.

A text is cut into leaves of about LEAF code points, each starting at a space
that follows a non-space: the tokenizer's pre-token pattern always breaks there,
whatever surrounds it, so a text's ids are its leaves' ids in sequence.  A
document keeps the leaves' lengths and counts and, above them, the sums of a
segment tree.  An edit re-encodes the leaves that it touches, out to the first
boundaries that it cannot disturb, and updates the sums above them.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from arlens.llm.packing import load_encoder, vocabulary_path

LEAF = 512
_BREAK = re.compile(r"(?<=\S) ")


def leaf_starts(text: str, leaf: int = LEAF) -> list[int]:
    """Starts of leaves; the first is 0, the others are safe breaks."""
    out, n = [0], len(text)
    while (m := _BREAK.search(text, min(out[-1] + leaf, n))) and m.start() > out[-1]:
        out.append(m.start())
    return out


def tree_of(counts: list[int]) -> list[int]:
    """Sums of a segment tree in heap order: node i has children 2i and 2i + 1,
    node 1 is the root, the leaves fill the last power of two."""
    width = 1 << max(len(counts) - 1, 0).bit_length()
    tree = np.zeros(2 * width, np.int64)
    tree[width:width + len(counts)] = counts
    while width > 1:
        tree[width // 2:width] = tree[width:2 * width].reshape(-1, 2).sum(axis=1)
        width //= 2
    return tree.tolist()


def build(text: str, encode) -> tuple[list[int], list[int]]:
    """Code points of each leaf, and the tree of their token counts."""
    starts = [*leaf_starts(text), len(text)]
    pieces = [text[a:b] for a, b in zip(starts, starts[1:])]
    return [len(p) for p in pieces], tree_of([len(encode(p)) for p in pieces])


def edit(text: str, lengths: list[int], tree: list[int], start: int, end: int, new: str, encode) -> tuple[str, list[int], list[int], int]:
    """text[start:end] replaced by ``new``: the text, leaf lengths and tree that
    result, and the code points that were encoded again.

    With as many leaves as before, only the sums above changed leaves are
    updated; else the sums are rebuilt from the kept counts, encoding nothing.
    """
    start = min(max(start, 0), len(text))
    end = min(max(end, start), len(text))
    starts = np.concatenate([[0], np.cumsum(lengths)])
    last = len(lengths)
    # a break at p stays one if p - 1 and p are both untouched
    i = max(int(np.searchsorted(starts[:last], start, "left")) - 1, 0)
    j = min(int(np.searchsorted(starts, end, "right")), last)
    after = text[:start] + new + text[end:]
    a, b = int(starts[i]), int(starts[j]) + len(new) - (end - start)
    region = after[a:b]
    if not region and last > j - i:  # nothing is left of these leaves
        fresh_lengths, fresh = [], []
    else:
        cuts = [*leaf_starts(region), len(region)]
        pieces = [region[x:y] for x, y in zip(cuts, cuts[1:])]
        fresh_lengths, fresh = [len(p) for p in pieces], [len(encode(p)) for p in pieces]
    width = len(tree) // 2
    out = [*lengths[:i], *fresh_lengths, *lengths[j:]]
    if len(fresh) == j - i:
        tree = list(tree)
        for k, n in enumerate(fresh, i):
            node, change = width + k, n - tree[width + k]
            while node and change:
                tree[node] += change
                node >>= 1
    else:
        tree = tree_of([*tree[width:width + i], *fresh, *tree[width + j:width + last]])
    return after, out, tree, len(region)


_TREE = "struct<lengths:array<int>,sums:array<int>>"
_EDITED = "struct<text:string,lengths:array<int>,sums:array<int>,encoded:long>"
_INTS = pa.list_(pa.int32())


def token_tree(text: Column, vocabulary: str | None = None) -> Column:
    """The tree of one text; ``sums[1]`` is its count.  Null reads as empty: one
    leaf of no tokens."""
    path = vocabulary or vocabulary_path()

    @F.arrow_udf(_TREE)
    def make(texts: pa.Array) -> pa.Array:
        encode = load_encoder(path)
        rows = [build(t or "", encode) for t in texts.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([r[0] for r in rows], _INTS), pa.array([r[1] for r in rows], _INTS)], ["lengths", "sums"])

    return make(text.cast("string"))


def apply_edit(text: Column, tree: Column, start: Column, end: Column, new: Column, vocabulary: str | None = None) -> Column:
    """One edit of one text, in code points: the new text, its tree, and the
    code points encoded again.

    Offsets are clipped to the text; a null offset or replacement reads as 0 or
    empty, a null text as empty.  Edits kept in a table are joined on the
    document's id first; several edits of a document are applied in turn.
    """
    path = vocabulary or vocabulary_path()

    @F.arrow_udf(_EDITED)
    def change(texts: pa.Array, lengths: pa.Array, sums: pa.Array, starts: pa.Array, ends: pa.Array, news: pa.Array) -> pa.Array:
        encode = load_encoder(path)
        rows = [edit(t or "", x, s, a or 0, b or 0, new or "", encode) for t, x, s, a, b, new in zip(*(c.to_pylist() for c in (texts, lengths, sums, starts, ends, news)))]
        kinds = [pa.string(), _INTS, _INTS, pa.int64()]
        return pa.StructArray.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["text", "lengths", "sums", "encoded"])

    return change(text.cast("string"), tree["lengths"], tree["sums"], start.cast("long"), end.cast("long"), new.cast("string"))


def count(tree: Column) -> Column:
    """Tokens of the whole text: the sum at the root."""
    return F.element_at(tree["sums"], 2).cast("long")
