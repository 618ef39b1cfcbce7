"""Operator 7: documents packed into token windows by best-fit decreasing.

Every task tokenises its own documents, cuts overlong ones into full windows
and packs the rests, longest first, each into the tightest open window.  A
segment tree indexed by remaining capacity finds that window in log(window)
steps.  Nothing is shuffled: a task's windows are numbered below its partition
number, so ids are unique over the job.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arlens.llm.common import utf8

WINDOW = 1024
END = 0
#: Tokens of rests that a task gathers before it packs them (4 bytes each).
PENDING = 8_000_000
#: Fixed value: the one special string of the vocabulary and its id.
SPECIAL = {"<|endoftext|>": 50256}


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def load_encoder(path: str):
    """text -> uint32 ids.  The rank file holds the vocabulary of
    ``byte_bpe_50k.json``; the ids are the same (held by a test)."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, f)}
    enc = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)
    special = next(iter(SPECIAL))

    def encode(text: str) -> np.ndarray:
        return enc.encode_to_numpy(text, allowed_special="all" if special in text else set(), disallowed_special=())

    return encode


class Capacities:
    """Open windows by remaining capacity; the tree holds, for each node, how
    many open windows lie below it."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def add(self, capacity: int, window: int) -> None:
        self.open[capacity].append(window)
        node = capacity + self.leaves
        while node:
            self.count[node] += 1
            node >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """Remove and return (capacity, window) of least capacity >= ``least``."""
        node = least + self.leaves
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        capacity = node - self.leaves
        while node:
            self.count[node] -= 1
            node >>= 1
        return capacity, self.open[capacity].pop()


def best_fit(lengths: list[int], window: int) -> tuple[list[tuple[int, int]], int]:
    """(window number, offset) of each length, and the number of windows."""
    place: list[tuple[int, int]] = [(0, 0)] * len(lengths)
    tree, used = Capacities(window), 0
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        capacity, at = tree.take(lengths[i]) or (window, used)
        used += at == used
        place[i] = (at, window - capacity)
        if capacity > lengths[i]:
            tree.add(capacity - lengths[i], at)
    return place, used


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end: int = END, pending: int = PENDING, vocabulary: str | None = None) -> DataFrame:
    """One row for each piece: id, ``start``, ``length``, ``ids`` (little-endian
    uint32), ``doc_tokens``, ``sequence_id``, ``offset``.

    A null or empty text is one piece, the end id alone.  A null id stays null;
    repeated rows are packed each on its own; an empty table gives no rows.
    Other columns are not read.  Memory: one Arrow batch and ``pending`` tokens.
    """
    path = vocabulary or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = load_encoder(path)
        sequence = TaskContext.get().partitionId() << 40
        out: list[tuple] = []
        rest: list[tuple] = []
        held = 0

        def emit() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
            out.clear()
            return batch

        def close() -> None:
            nonlocal sequence, held
            place, used = best_fit([x[2] for x in rest], window)
            out.extend((*x, sequence + at, offset) for x, (at, offset) in zip(rest, place))
            rest.clear()
            sequence, held = sequence + used, 0

        for batch in batches:
            for doc, raw in zip(batch.column(0).to_pylist(), utf8(batch.column(1))):
                ids = np.append(encode(raw.decode("utf-8", "replace")), np.uint32(end)).astype("<u4")
                n = len(ids)
                full = n - n % window
                for start in range(0, full, window):
                    out.append((doc, start, window, ids[start:start + window].tobytes(), n, sequence, 0))
                    sequence += 1
                if n > full:
                    rest.append((doc, full, n - full, ids[full:].tobytes(), n))
                    held += n - full
                if held >= pending:
                    close()
                if len(out) >= 4096:
                    yield emit()
        close()
        if out:
            yield emit()

    names = [id_col, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    id_type = df.schema[id_col].dataType
    arrow_id = {"string": pa.string(), "int": pa.int32()}.get(id_type.simpleString(), pa.int64())
    types = [arrow_id, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    schema = T.StructType([T.StructField(n, id_type if n == id_col else T.BinaryType() if n == "ids" else T.LongType()) for n in names])
    return df.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string")).mapInArrow(run, schema)
