"""Operator 13: gated recurrent language model.

Words that occur most have symbols of their own; all others share a symbol with
the words of like ending, and their share within it comes from counts of the
whole corpus.  A gated recurrent unit reads symbols and predicts the next one in
two factors: its class, then the word in that class.  It is trained by truncated
backpropagation in numpy.  Documents run side by side in lanes; a lane's state
goes on from window to window until its document ends, so the likelihood is that
of the complete document.

Training is spread over the tasks: in each round every task trains its own copy
on its documents, and the copies are averaged by the tokens that they saw.  Each
training document takes part in one round.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arlens.llm.common import cut, slices

#: Words whose counts travel to the tasks, most frequent first; counts of all
#: others are joined.  The first ``CLASSES * MEMBERS`` have symbols of their own.
COUNTED = 1 << 18
CLASSES, MEMBERS = 32, 64
#: Symbols of all other words, by a hash of their last two bytes.
ENDINGS = 64
OWN = CLASSES * MEMBERS
#: Values of the state; tokens of a window; documents side by side.
STATE, WINDOW, LANES, SCORE_LANES = 20, 16, 512, 256
ROUNDS = 4
#: Times that a window of few lanes is longer when texts are scored.
LONGER = 8
RATE, TABLE_RATE, CLIP = 0.03, 0.1, 5.0
#: Different words that a task holds before it hands on their counts, and tokens
#: that it holds before it trains on or scores them.
TALLY, HELD = 500_000, 2_000_000
#: Bytes of text split into words at a time; a longer text is taken alone.
SLICE = 4_000_000
#: Values of the model in one row when copies are averaged.
PIECE = 8192
#: Parts of the network that every window changes.
DENSE = ("wx", "u", "b", "top", "top_b")
END = b""  # the token behind each document; no word is empty


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Number of the text and of the word of every token but the ends, and the
    different words (as bytes).  Only A-Z are lower-cased; the six ASCII blanks
    part words."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    word, owner = pc.list_flatten(split), pc.list_parent_indices(split)
    some = pc.not_equal(word, "")
    coded = word.filter(some).dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return owner.filter(some).to_numpy(zero_copy_only=False).astype(np.int64), code, coded.dictionary.cast(pa.large_binary())


def ending(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % ENDINGS


# ---------------------------------------------------------------- the network


class Net(NamedTuple):
    """embed: input by symbol; wx, u, b: update, reset and new state; top, top_b:
    classes and endings; inner, inner_b: members of each class."""

    embed: np.ndarray
    wx: np.ndarray
    u: np.ndarray
    b: np.ndarray
    top: np.ndarray
    top_b: np.ndarray
    inner: np.ndarray
    inner_b: np.ndarray


def new_net(own: np.ndarray, rest: np.ndarray, state: int = STATE, seed: int = 1) -> Net:
    """A network whose outputs follow the counts of own symbols (``OWN`` at most)
    and endings before any training."""
    rng = np.random.default_rng(seed)
    n = np.zeros(OWN)
    n[:len(own)] = own
    n = n.reshape(CLASSES, MEMBERS)
    there = np.arange(OWN).reshape(CLASSES, MEMBERS) < len(own)
    share = lambda x, axis: np.log((x + 0.5) / (x + 0.5).sum(axis=axis, keepdims=True)).astype(np.float32)
    draw = lambda *shape: (rng.standard_normal(shape) / math.sqrt(state)).astype(np.float32)
    return Net(
        draw(OWN + ENDINGS, state), draw(state, 3 * state), draw(state, 3 * state), np.zeros(3 * state, np.float32),
        np.zeros((state, CLASSES + ENDINGS), np.float32), share(np.concatenate([n.sum(axis=1), rest]), 0),
        np.zeros((CLASSES, state, MEMBERS), np.float32), np.where(there, share(n, 1), np.float32(-30)))


def flat(net: Net) -> np.ndarray:
    return np.concatenate([x.ravel() for x in net])


def shaped(values: np.ndarray, like: Net) -> Net:
    out, at = [], 0
    for x in like:
        out.append(values[at:at + x.size].reshape(x.shape).astype(np.float32))
        at += x.size
    return Net(*out)


def lanes(texts: list[np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Symbols to predict and the number of their text, (time, lane); -1 where a
    lane has ended.  Long texts are placed first, each in the shortest lane;
    lanes are sorted by length, longest first."""
    import heapq

    n = min(n, len(texts))
    heap = [(0, k) for k in range(n)]
    held: list[list[int]] = [[] for _ in range(n)]
    for i in sorted(range(len(texts)), key=lambda i: -len(texts[i])):
        size, k = heapq.heappop(heap)
        held[k].append(i)
        heapq.heappush(heap, (size + len(texts[i]), k))
    size = np.array([sum(len(texts[i]) for i in own) for own in held])
    order = np.argsort(-size, kind="stable")
    symbol = np.full((size.max(initial=0), n), -1, np.int32)
    text = np.full(symbol.shape, -1, np.int32)
    for lane, k in enumerate(order):
        at = 0
        for i in held[k]:
            symbol[at:at + len(texts[i]), lane] = texts[i]
            text[at:at + len(texts[i]), lane] = i
            at += len(texts[i])
    return symbol, text


def _by_gate(x: np.ndarray) -> np.ndarray:
    """The columns of update, reset and new state apart, as ``recur`` reads them:
    the exponentials of a step are those of what it finds here, so signs are
    turned, and the new state's, a tanh, is doubled."""
    return x.reshape(*x.shape[:-1], 3, -1).swapaxes(0, -2) * np.array([-1, -1, -2], np.float32).reshape(3, *[1] * x.ndim)


def gate_inputs(net: Net, x: np.ndarray) -> np.ndarray:
    """What inputs (number, value) add to each gate: (gate, number, state)."""
    g = x @ _by_gate(net.wx)
    g += _by_gate(net.b[None])
    return g


def recur(net: Net, read: np.ndarray, h: np.ndarray, gates: np.ndarray | None = None, keep_all: bool = True):
    """States behind every symbol of ``read`` (time, lane), and what
    backpropagation needs.  The end symbol 0 starts a document: the state
    before it is dropped.  Gates lie apart, so a step works on whole arrays."""
    s, n = h.shape[1], len(read)
    x = net.embed[read.ravel()] if gates is None else None
    g = gate_inputs(net, x).reshape(3, *read.shape, s) if gates is None else gates[:, read]
    keep = (read != 0).astype(np.float32)[:, :, None]
    u = _by_gate(net.u)
    after = np.empty((*read.shape, s), np.float32)
    held = n if keep_all else 1
    before, new = (np.empty((held, *h.shape), np.float32) for _ in range(2))
    by_gate = np.empty((held, 3, *h.shape), np.float32)  # update, reset, -2 times the state's part of the new one
    for t in range(n):
        k = t if keep_all else 0
        old, own, fresh, out = before[k], by_gate[k], new[k], after[t]
        np.multiply(h, keep[t], out=old)
        np.matmul(old, u, out=own)
        zr = own[:2]
        zr += g[:2, t]
        np.exp(zr, out=zr)
        zr += 1
        np.divide(1, zr, out=zr)
        np.multiply(zr[1], own[2], out=fresh)
        fresh += g[2, t]
        np.exp(fresh, out=fresh)
        fresh += 1
        np.divide(2, fresh, out=fresh)
        fresh -= 1
        np.subtract(old, fresh, out=out)
        out *= zr[0]
        out += fresh
        h = out
    return after, (keep, before, by_gate, new, x)


#: Positions whose outputs are worked on at a time: they stay in the cache.
OUTPUTS = 1024


def _with_bias(weight: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """The bias as a last row of the weights."""
    return np.concatenate([weight, bias[..., None, :]], axis=-2)


def _share(e: np.ndarray, own: np.ndarray, learn: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """Outputs become their exponentials; the share of output ``own`` of each row.

    Biases are logs of shares and states lie in -1 to 1, so the exponentials stay
    in range.  To ``learn``, the sum of a row is taken off its own output, and
    its inverse returned: rows times that are the derivatives of minus the log.
    """
    np.clip(e, -60, 60, out=e)
    np.exp(e, out=e)
    total = e @ np.ones(e.shape[1], e.dtype)
    at = np.arange(0, e.size, e.shape[1]) + own
    flat_e = e.reshape(-1)
    mine = flat_e[at]
    if learn:
        flat_e[at] = mine - total
    total = 1 / total
    return mine * total, total[:, None] if learn else None


def predict(net: Net, h: np.ndarray, target: np.ndarray, grads: list | None = None) -> np.ndarray:
    """Log-probability of each target symbol behind its state.  With ``grads``
    (filled: dh, top, top_b, and class, inner, inner_b of the classes met) the
    derivative of the sum of minus these logs.  Positions are sorted by class, so
    those of a class are a slice, and classes are worked on by the run."""
    learn, s = grads is not None, h.shape[1]
    branch = np.where(target < OWN, target // MEMBERS, CLASSES + target - OWN)
    share = np.empty(len(target), np.float32)
    one = np.empty((len(target), s + 1), np.float32)  # a state and the 1 that its bias takes
    one[:, :s], one[:, s] = h, 1
    weight = _with_bias(net.top, net.top_b)
    dh, dtop = np.empty_like(one[:, :s]), np.zeros_like(weight)
    for a in range(0, len(target), OUTPUTS):
        z = a + OUTPUTS
        e = one[a:z] @ weight
        share[a:z], inverse = _share(e, branch[a:z], learn)
        if learn:
            np.multiply(e @ net.top.T, inverse, out=dh[a:z])
            dtop += (one[a:z] * inverse).T @ e
    order = np.argsort(branch.astype(np.int16), kind="stable")
    edge = np.searchsorted(branch[order], np.arange(CLASSES + 1)).tolist()
    order = order[:edge[-1]]
    member, one = target[order] % MEMBERS, one[order]
    within, back = np.empty(len(order), np.float32), np.empty((len(order), s), np.float32)
    met = [c for c in range(CLASSES) if edge[c] < edge[c + 1]]
    weight = _with_bias(net.inner, net.inner_b)
    dinner = np.empty((len(met), *weight.shape[1:]), np.float32)
    first = 0
    while first < len(met):
        a, last = edge[met[first]], first + 1
        while last < len(met) and edge[met[last] + 1] - a <= OUTPUTS:
            last += 1
        z = edge[met[last - 1] + 1]
        run = [(k, c, edge[c] - a, edge[c + 1] - a) for k, c in enumerate(met[first:last], first)]
        x, e = one[a:z], np.empty((z - a, MEMBERS), np.float32)
        for _, c, i, j in run:
            np.matmul(x[i:j], weight[c], out=e[i:j])
        within[a:z], inverse = _share(e, member[a:z], learn)
        if learn:
            x, into = x * inverse, back[a:z]
            for k, c, i, j in run:
                np.matmul(e[i:j], net.inner[c].T, out=into[i:j])
                np.matmul(x[i:j].T, e[i:j], out=dinner[k])
            into *= inverse
        first = last
    if learn:
        dh[order] += back
        grads += [dh, dtop[:s], dtop[s], met, dinner[:, :s], dinner[:, s]]
    out = np.log(share.astype(float))
    out[order] += np.log(within)
    return out


def gradient(net: Net, read: np.ndarray, target: np.ndarray, h: np.ndarray):
    """Log-likelihood of a window, the state behind it, and the derivatives of
    minus the former: dense ones by name, symbols with their rows of ``embed``,
    classes with theirs of ``inner``.  Targets of -1 do not count."""
    after, (keep, before, by_gate, new, embedded) = recur(net, read, h)
    s, shape = h.shape[1], target.shape
    real = np.flatnonzero(target.ravel() >= 0)
    grads: list = []
    if len(real) == target.size:
        logs = predict(net, after.reshape(-1, s), target.ravel(), grads)
        out = grads[0]
    else:
        logs = predict(net, after.reshape(-1, s)[real], target.ravel()[real], grads)
        out = np.zeros((target.size, s), np.float32)
        out[real] = grads[0]
    out = out.reshape(*shape, s)
    # All that multiplies the derivative by the state, made for the whole window:
    # what update, reset and the state's part of the new one get, and the state before.
    z, r, inner = by_gate[:, 0], by_gate[:, 1], by_gate[:, 2]
    not_z = 1 - z
    to_new = not_z * (1 - new * new)
    by = np.empty((*shape, 4, s), np.float32)
    np.multiply((before - new) * z, not_z, out=by[:, :, 0])
    np.multiply(to_new, r, out=by[:, :, 2])
    np.multiply(by[:, :, 2], inner * ((r - 1) / 2), out=by[:, :, 1])
    by[:, :, 3] = z
    back = np.vstack([net.u.T, np.eye(s, dtype=np.float32)])
    state = np.empty((*shape, s), np.float32)
    dh = np.zeros_like(h)
    for t in range(len(read) - 1, -1, -1):
        own = by[t]
        np.add(dh, out[t], out=state[t])
        own *= state[t][:, None]
        np.matmul(own.reshape(-1, 4 * s), back, out=dh)
        dh *= keep[t]
    da, x = by.reshape(-1, 4 * s)[:, :3 * s], read.ravel()
    du = before.reshape(-1, s).T @ da
    # What the input adds to the new state does not pass the reset gate.
    to_new *= state
    da[:, 2 * s:] = to_new.reshape(-1, s)
    dense = {"wx": embedded.T @ da, "u": du, "b": np.ones(len(da), np.float32) @ da, "top": grads[1], "top_b": grads[2]}
    de = da @ net.wx.T
    order = np.argsort(x.astype(np.uint16), kind="stable")
    x = x[order]
    first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
    return float(logs.sum()), after[-1], dense, (x[first], np.add.reduceat(de[order], first)), grads[3:]


def train(net: Net, texts: list[np.ndarray], rate: float = 1.0, spread: dict | None = None) -> Net:
    """One pass over ``texts`` (symbols, the end symbol last) with truncated
    backpropagation of every window, steps scaled by their gradients' history (``spread``)."""
    # One array for all that every window changes, and one for the classes with their biases.
    dense = np.concatenate([getattr(net, k).ravel() for k in DENSE])
    inner = _with_bias(net.inner, net.inner_b)
    embed, at = net.embed.copy(), 0
    net = net._replace(embed=embed, inner=inner[:, :-1], inner_b=inner[:, -1])
    for k in DENSE:
        like = getattr(net, k)
        net = net._replace(**{k: dense[at:at + like.size].reshape(like.shape)})
        at += like.size
    spread = {} if spread is None else spread
    for name, x in (("dense", dense), ("embed", embed), ("inner", inner)):
        spread.setdefault(name, np.full(x.shape, 1e-4, np.float32))
    symbol, _ = lanes(texts, LANES)
    scale = 1 / (WINDOW * LANES)

    def step(name: str, values: np.ndarray, at, g: np.ndarray, by: float) -> None:
        g = g * scale
        np.clip(g, -CLIP, CLIP, out=g)
        past = spread[name][at]
        past += g * g
        spread[name][at] = past
        g *= by * rate
        g /= np.sqrt(past)
        values[at] -= g

    read = np.vstack([np.zeros((1, symbol.shape[1]), np.int32), symbol[:-1]])
    h = np.zeros((symbol.shape[1], net.u.shape[0]), np.float32)
    for t in range(0, len(symbol), WINDOW):
        n = int((symbol[t] >= 0).sum())  # lanes end from the right
        z = t + WINDOW
        _, h, by_name, (row, de), (classes, di, db) = gradient(net, np.maximum(read[t:z, :n], 0), symbol[t:z, :n], h[:n])
        step("dense", dense, slice(None), np.concatenate([by_name[k].ravel() for k in DENSE]), RATE)
        step("embed", embed, row, de, TABLE_RATE)
        if classes:
            step("inner", inner, classes, _with_bias(di, db), RATE)
    return Net(*[np.ascontiguousarray(x) for x in net])


def log_likelihood(net: Net, texts: list[np.ndarray], n_lanes: int = SCORE_LANES, window: int = 32) -> np.ndarray:
    """Natural log-probability of the symbols of each text, its end included."""
    out = np.zeros(len(texts))
    if not texts:
        return out
    gates = gate_inputs(net, net.embed)
    symbol, text = lanes(texts, n_lanes)
    read = np.vstack([np.zeros((1, symbol.shape[1]), np.int32), symbol[:-1]])
    h = np.zeros((symbol.shape[1], net.u.shape[0]), np.float32)
    t = 0
    while t < len(symbol):
        n = int((symbol[t] >= 0).sum())
        z = t + window * min(max(n_lanes // n, 1), LONGER)  # states go on, so a window may be of any length
        after, _ = recur(net, np.maximum(read[t:z, :n], 0), h[:n], gates, False)
        h = after[-1]
        target = symbol[t:z, :n].ravel()
        real = np.flatnonzero(target >= 0)
        logs = predict(net, after.reshape(len(target), -1)[real], target[real])
        out += np.bincount(text[t:z, :n].ravel()[real], logs, len(texts))
        t = z
    return out


# ------------------------------------------------------------------- on Spark


class Lexicon(NamedTuple):
    """word, n: the ``COUNTED`` most frequent words and the end (first), with
    their counts; total, kinds: tokens and different ones in training; mass: the
    denominator of each ending's words."""

    word: list[bytes]
    n: np.ndarray
    total: int
    kinds: int
    mass: np.ndarray
    rest: np.ndarray


def token_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n) of all tokens of ``docs``, the end (an empty word) among them."""
    names = ["word", "n"]

    def merged(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        coded = pa.concat_arrays([b.column(0) for b in held]).dictionary_encode()
        n = np.bincount(coded.indices.to_numpy(zero_copy_only=False), np.concatenate([b.column(1).to_numpy() for b in held]))
        return pa.RecordBatch.from_arrays([coded.dictionary, pa.array(n.astype(np.int64))], names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            for part in slices(b.column(0), SLICE):
                _, code, word = tokens(part)
                held.append(pa.RecordBatch.from_arrays([word.cast(pa.binary()), pa.array(np.bincount(code, minlength=len(word)).astype(np.int64))], names))
                if sum(x.num_rows for x in held) >= 2 * TALLY:
                    held = [merged(held)]
                    if held[0].num_rows >= TALLY:
                        yield held.pop()
            held.append(pa.RecordBatch.from_arrays([pa.array([END], pa.binary()), pa.array([b.num_rows], pa.int64())], names))
        if held:
            yield merged(held)

    rows = docs.select(F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(count, "word binary, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).filter("n > 0")


def lexicon(counts: DataFrame) -> Lexicon:
    """What of the counts travels to the tasks: the words above the least number
    of occurrences that leaves no more than ``COUNTED``.  That number comes from
    how often each number of occurrences is met, a list as long as the square
    root of the tokens at most; no task sorts the vocabulary."""
    rare = counts.filter(F.col("word") != END)
    room, least = COUNTED - 1, 0
    for r in sorted(rare.groupBy("n").count().collect(), reverse=True):
        room -= r["count"]
        if room < 0:
            least = r["n"]
            break
    top = sorted(((-r["n"], bytes(r["word"])) for r in rare.filter(F.col("n") > least).collect()))
    sums = counts.agg(F.sum("n"), F.count("*"), F.sum(F.when(F.col("word") == END, F.col("n")))).first()
    word = [END, *(w for _, w in top)]
    n = np.array([sums[2] or 0, *(-k for k, _ in top)], np.int64)
    if len(word) >= OWN:
        last = int(n[OWN - 1])
        rare = rare.filter((F.col("n") < last) | ((F.col("n") == last) & (F.col("word") > F.lit(word[OWN - 1]))))
    else:
        rare = rare.filter(F.col("n") <= least)
    by = rare.groupBy((F.crc32(F.substring("word", -2, 2)) % ENDINGS).alias("e")).agg(F.sum("n").alias("n"), F.count("*").alias("k")).collect()
    rest, mass = np.zeros(ENDINGS), np.ones(ENDINGS)
    for r in by:
        rest[r["e"]], mass[r["e"]] = r["n"], r["n"] + r["k"] + 1
    return Lexicon(word, n, int(sums[0] or 0), int(sums[1]), mass, rest)


def encode(docs: DataFrame, train: Column, held_out: Column, lex: Lexicon, id_col: str, text_col: str) -> DataFrame:
    """_row, key, train, held_out, symbols (16 bits each), n_known and base (sums
    over counted tokens), rare (words that have to be joined, with occurrences).

    ``base`` holds the sum of log10(c + 1), ``own_base`` that of symbols shared
    by an ending less the log10 of the ending's denominator.
    """
    index = {w: i for i, w in enumerate(lex.word)}
    log_n = np.log10(lex.n + 1.0)
    ends = np.array([0 if i < OWN else ending(w) for i, w in enumerate(lex.word)], np.int64)
    log_mass = np.log10(lex.mass)
    sent = docs.sparkSession.sparkContext.broadcast((index, lex.n, log_n, ends, log_mass))
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(f"`{id_col}`").alias("key"), train.alias("train"), held_out.alias("held_out"), F.col(f"`{text_col}`").cast("string").alias("text"))
    rare = T.ArrayType(T.StructType([T.StructField("word", T.BinaryType()), T.StructField("m", T.LongType())]))
    schema = T.StructType(rows.schema.fields[:-1] + [T.StructField("symbols", T.BinaryType()), T.StructField("n_known", T.LongType()), T.StructField("base", T.DoubleType()), T.StructField("own_base", T.DoubleType()), T.StructField("rare", rare)])

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, n, log_n, ends, log_mass = sent.value
        for b in batches:
            start = 0
            for part in slices(b.column(4), SLICE):
                owner, code, word = tokens(part)
                spelt = word.to_pylist()
                at = np.fromiter((index.get(w, -1) for w in spelt), np.int64, len(spelt))
                lost, shared = at < 0, (at < 0) | (at >= OWN)
                end = np.where(lost, 0, ends[at])
                end[lost] = [ending(spelt[i]) for i in np.flatnonzero(lost).tolist()]
                log_c = np.where(lost, 0.0, log_n[at])
                by_text = lambda value, first: first + np.bincount(owner, value[code], len(part))  # noqa: E731, B023
                size = np.bincount(owner, minlength=len(part)) + 1
                edge = np.concatenate([[0], np.cumsum(size)])
                symbol = np.zeros(edge[-1], np.uint16)  # the end, 0, stands behind each text
                symbol[np.arange(len(code)) + owner] = np.where(shared, OWN + end, at)[code]
                unseen, times = np.unique((owner * max(len(spelt), 1) + code)[lost[code]], return_counts=True)
                of, what = np.divmod(unseen, max(len(spelt), 1))
                rare = pa.StructArray.from_arrays([word.take(pa.array(what)).cast(pa.binary()), pa.array(times.astype(np.int64))], ["word", "m"])
                yield pa.RecordBatch.from_arrays([*(c.slice(start, len(part)) for c in b.columns[:4]),
                    pa.array([symbol[a:z].tobytes() for a, z in zip(edge, edge[1:])], pa.binary()),
                    pa.array(by_text((~lost & (n[at] > 0)).astype(float), float(n[0] > 0)).astype(np.int64)),
                    pa.array(by_text(log_c, log_n[0])), pa.array(by_text(np.where(shared, log_c - log_mass[end], 0.0), 0.0)),
                    pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(len(part) + 1)), pa.int32()), rare)], schema.names)
                start += len(part)

    return cut(rows.mapInArrow(turn, schema))


def _held(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[list[np.ndarray], list[pa.RecordBatch]]]:
    """Texts as symbols in runs of about ``HELD`` tokens, with their batches."""
    texts: list[np.ndarray] = []
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        for k in range(0, b.num_rows, 256):
            part = b.slice(k, 256)
            new = [np.frombuffer(x, np.uint16).astype(np.int32) for x in part.column(column).to_pylist()]
            texts += new
            held.append(part)
            size += sum(map(len, new))
            if size >= HELD:
                yield texts, held
                texts, held, size = [], [], 0
    if texts:
        yield texts, held


def fit(encoded: DataFrame, lex: Lexicon, rounds: int = ROUNDS) -> Net:
    """The network trained on the rows of ``encoded`` that are marked ``train``.

    Round k takes the rows whose number hashes to k.  A task hands on its copy
    in pieces, weighted by its tokens; pieces of one place are added up as they
    arrive, so a task holds one model whatever the number of copies.
    """
    net = new_net(lex.n[:OWN].astype(float), lex.rest)
    size = flat(net).size
    spark = encoded.sparkSession

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for b in batches:
            for k, n, raw in zip(*(c.to_pylist() for c in b.columns)):
                mine = total.setdefault(k, [0.0, 0.0])
                mine[0] += n
                mine[1] = mine[1] + n * np.frombuffer(raw, np.float32).astype(float)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([float(n) for n, _ in total.values()]), pa.array([(x / n).astype(np.float32).tobytes() for n, x in total.values()], pa.binary())], ["piece", "n", "part"])

    for k in range(rounds):
        sent = spark.sparkContext.broadcast(flat(net))
        rate = 1.0 / (1 + k)

        def learn(batches: Iterator[pa.RecordBatch], sent=sent, rate=rate) -> Iterator[pa.RecordBatch]:
            mine, seen, spread = shaped(sent.value, net), 0, {}
            for texts, _ in _held(batches, 0):
                mine = train(mine, texts, rate, spread)
                seen += sum(map(len, texts))
            if seen:
                values = flat(mine)
                at = range(0, size, PIECE)
                yield pa.RecordBatch.from_arrays([pa.array(range(len(at)), pa.int32()), pa.array([float(seen)] * len(at)), pa.array([values[a:a + PIECE].tobytes() for a in at], pa.binary())], ["piece", "n", "part"])

        rows = encoded.filter(F.col("train") & (F.pmod(F.xxhash64("_row"), F.lit(rounds)) == k)).select("symbols")
        shape = "piece int, n double, part binary"
        got = {r["piece"]: r["part"] for r in rows.mapInArrow(learn, shape).repartition("piece").mapInArrow(add, shape).collect()}
        sent.unpersist()
        if got:
            net = shaped(np.concatenate([np.frombuffer(got[p], np.float32) for p in sorted(got)]), net)
    return net


def score_documents(docs: DataFrame, train: Column, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, held_out, n_tokens, n_known, train_tokens, base_score and score
    of every row of ``docs``; ``train`` marks the rows that counts and network
    learn from.

    A null text is an empty one: its one token is the end.  Repeated rows each
    have a result.  Words whose count does not travel are joined with the counts
    once for each document that holds them.  Without training rows every token
    has the same base score of 0 and the network is the untrained one.
    """
    train, held_out = F.coalesce(train, F.lit(False)), F.coalesce(held_out, F.lit(False))
    counts = cut(token_counts(docs.filter(train), text_col))
    lex = lexicon(counts)
    encoded = encode(docs, train, held_out, lex, id_col, text_col)
    net = fit(encoded, lex)
    sent = docs.sparkSession.sparkContext.broadcast(flat(net))
    like = new_net(lex.n[:OWN].astype(float), lex.rest)
    scored = T.StructType([encoded.schema[c] for c in ("_row", "key", "held_out", "n_known", "base", "own_base")] + [T.StructField("n_tokens", T.LongType()), T.StructField("log_p", T.DoubleType())])

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = shaped(sent.value, like)
        for texts, held in _held(batches, 6):
            logs, at = log_likelihood(mine, texts), 0
            for b in held:
                z = at + b.num_rows
                yield pa.RecordBatch.from_arrays(b.columns[:6] + [pa.array([len(x) for x in texts[at:z]], pa.int64()), pa.array(logs[at:z] / math.log(10))], scored.names)
                at = z

    rows = encoded.select("_row", "key", "held_out", "n_known", "base", "own_base", "symbols").mapInArrow(rate, scored)
    unseen = encoded.select("_row", F.explode("rare").alias("x")).select("_row", "x.word", "x.m").join(counts, "word", "left")
    c = F.coalesce("n", F.lit(0))
    more = unseen.groupBy("_row").agg(F.sum(F.col("m") * F.log10(c + 1.0)).alias("more"), F.sum(F.when(c > 0, F.col("m")).otherwise(0)).alias("more_known"))
    more_or = lambda c: F.coalesce(c, F.lit(0))
    out = rows.join(more, "_row", "left")
    return out.select(
        F.col("key").alias(id_col), "held_out", "n_tokens", (F.col("n_known") + more_or("more_known")).cast("long").alias("n_known"), F.lit(lex.total).cast("long").alias("train_tokens"),
        (F.col("base") + more_or("more") - F.col("n_tokens") * F.lit(math.log10(lex.total + lex.kinds + 1))).alias("base_score"),
        (F.col("log_p") + F.col("own_base") + more_or("more")).alias("score"))
