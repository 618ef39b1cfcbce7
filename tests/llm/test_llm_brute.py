"""Operators against brute force, exact round trips and held-out accuracy."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
import pytest

import corpus_pipeline
from arlens.llm import bands, bpr, decontam, editcount, packing, parity, quality, queries, secrets

from conftest import SF_SMALL

SF = "/root/testdata/sf0.01"
SPACE = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def texts():
    return pd.read_parquet(f"{SF_SMALL}/documents.parquet").set_index("doc_id")["text"]


@pytest.fixture(scope="module")
def more_texts():
    return pd.read_parquet(f"{SF}/documents.parquet").set_index("doc_id")["text"]


def held_out(spark, key, label, folder):
    got = queries.QUERIES[key](spark, folder).toPandas()
    truth = pd.read_parquet(f"{folder}/labels.parquet")
    return got[got.held_out].merge(truth, on="doc_id")[["score", "predicted", label]]


def auc(score, label):
    rank, ones = score.rank(), int((label == 1).sum())
    return (rank[label == 1].sum() - ones * (ones + 1) / 2) / (ones * (len(label) - ones))


def test_quality_on_held_out_rows(spark):
    got = held_out(spark, "op1_quadratic_discriminant", "quality", "/root/testdata/sf0.1")
    assert auc(got.score, got.quality) > 0.99 and (got.predicted == got.quality).mean() > 0.97


def test_quality_density_matches_direct_formula():
    rng = np.random.default_rng(1)
    x = [rng.normal(0, 1, (400, 3)), rng.normal(1, 2, (300, 3))]
    n = np.array([len(v) for v in x], float)
    model = quality.solve(n, np.stack([v.sum(0) for v in x]), np.stack([v.T @ v for v in x]), pooled=0.2, diagonal=0.1)
    scatter = [(v - v.mean(0)).T @ (v - v.mean(0)) for v in x]
    common = sum(scatter) / (n.sum() - 2) + 1e-6 * np.eye(3)
    z = rng.normal(0, 1, (5, 3))
    dens = []
    for v, s in zip(x, scatter):
        cov = 0.9 * (0.8 * s / (len(v) - 1) + 0.2 * common) + 0.1 * np.diag(np.diag(common))
        d = z - v.mean(0)
        dens.append(np.log(len(v) / n.sum()) - 0.5 * np.log(np.linalg.det(cov)) - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d))
    assert np.allclose(model.log_odds(z), dens[1] - dens[0])


def test_toxicity_on_held_out_rows(spark):
    got = held_out(spark, "op6_kneser_ney_toxicity", "toxic", "/root/testdata/sf0.1")
    caught = ((got.predicted == 1) & (got.toxic == 1)).sum()
    assert auc(got.score, got.toxic) > 0.95
    assert caught >= 0.85 * (got.toxic == 1).sum() and caught >= 0.85 * (got.predicted == 1).sum()


def test_base_rules(texts):
    pieces = ["a b c d e f g h " * 3, "x " * 40, "one\n\n \none\r\none\ntwo", "a b c d e f g h", "é b c d", *texts]
    for t in pieces:
        words = SPACE.findall(t)
        seen, dup = set(), 0
        for line in t.split("\n"):
            if SPACE.search(line):
                dup += line in seen
                seen.add(line)
        windows = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
        covered = {i + k for i in range(len(words) - 7) if windows[tuple(words[i:i + 8])] > 1 for k in range(8)}
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered))
        assert bands.counts(t.encode()) == want


def test_bands_query(spark, texts):
    import zstandard

    got = queries.op2_compression_bands(spark, SF_SMALL).toPandas().set_index("doc_id")
    size = lambda b: len(zstandard.ZstdCompressor(level=3, write_content_size=False).compress(b)) / len(b)
    band = lambda b: next(lo <= size(b) <= hi for top, lo, hi in bands.BANDS if len(b) <= top)
    for i, t in texts.items():
        raw = t.encode()
        chunks = [raw[a:a + bands.CHUNK] for a in range(0, len(raw), bands.CHUNK)]
        bad = sum(not band(c) for c in chunks)
        ok = band(raw) and (len(chunks) == 1 or bad < bands.BAD_CHUNKS * len(chunks))
        r = got.loc[i]
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert r.kept == (ok and not r.base_failed) and r.bad_chunks == bad


def groups_by_all_pairs(ids, sets):
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    where = defaultdict(list)
    for i, s in enumerate(sets):
        for v in s:
            where[v].append(i)
    both = Counter((a, b) for w in where.values() for k, b in enumerate(w) for a in w[:k])
    for (a, b), n in both.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            root[max(find(a), find(b))] = min(find(a), find(b))
    best = {}
    for i in range(len(sets)):
        best[find(i)] = min(best.get(find(i), ids[i]), ids[i])
    return {ids[i]: best[find(i)] for i in range(len(sets))}


def shingle_set(t):
    words = SPACE.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t))
    return {tuple(words)} - {()} if len(words) < 5 else {tuple(words[i:i + 5]) for i in range(len(words) - 4)}


def test_near_duplicates_query(spark, more_texts):
    got = queries.op3_parity_sketch_join(spark, SF).toPandas()
    sets = [shingle_set(t) for t in more_texts]
    assert dict(zip(got.doc_id, got.n_shingles)) == {i: len(s) for i, s in zip(more_texts.index, sets)}
    assert dict(zip(got.doc_id, got.component_id)) == groups_by_all_pairs(list(more_texts.index), sets)


def test_near_duplicates_of_edited_copies(spark):
    """Chains of copies near the threshold, short and long, beside texts that
    share a long passage; squares of a split bucket included."""
    rng = np.random.default_rng(3)
    texts = []
    passage = [f"p{i}" for i in range(60)]
    for k in range(60):
        base = [f"w{rng.integers(10**6)}" for _ in range(int(rng.integers(1, 120)))]
        for _ in range(4):
            texts.append(" ".join(base))
            for _ in range(int(rng.integers(0, 4))):
                base[int(rng.integers(len(base)))] = f"v{rng.integers(10**6)}"
        texts.append(" ".join(passage + base[:25]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = groups_by_all_pairs(list(range(len(texts))), [shingle_set(t) for t in texts])
    side, parity.SIDE = parity.SIDE, 7
    try:
        got = {r["doc_id"]: r["component_id"] for r in parity.near_duplicates(df).collect()}
    finally:
        parity.SIDE = side
    assert got == want


def test_pigeonhole_never_misses():
    """Linked sets always share a block name, and the sketch's Hamming distance
    never exceeds their symmetric difference."""
    rng = np.random.default_rng(5)
    for _ in range(3000):
        n = int(rng.integers(1, 90))
        a = parity.mix(rng.integers(0, 2**63, n).astype(np.uint64))
        drop = int(rng.integers(0, n // 5 + 2))
        b = np.unique(np.r_[a[drop:], parity.mix(rng.integers(0, 2**63, int(rng.integers(0, n // 5 + 2))).astype(np.uint64))])
        a = np.unique(a)
        if len(b) and parity.linked(a, b):
            assert set(parity.block_hashes(a).tolist()) & set(parity.block_hashes(b).tolist())
            x, y = parity.sketch(a), parity.sketch(b)
            width = min(len(x), len(y)) // 8
            far = int(np.bitwise_count(parity.fold(x, width) ^ parity.fold(y, width)).sum())
            assert far <= len(np.setxor1d(a, b)) <= parity.allowed(len(a), len(b))


def removed_by_all_windows(texts, length):
    raws = [t.encode() for t in texts]
    count = Counter(r[i:i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        cover = np.zeros(len(r) + 1, int)
        for i in range(len(r) - length + 1):
            if count[r[i:i + length]] > 1:
                cover[i] += 1
                cover[i + length] -= 1
        gone = np.cumsum(cover)[:-1] > 0
        edge = np.flatnonzero(np.diff(np.r_[0, gone.astype(int), 0])).reshape(-1, 2)
        out.append(([tuple(e) for e in edge.tolist()], bytes(np.frombuffer(r, np.uint8)[~gone])))
    return out


@pytest.mark.parametrize("crowd, chunk", [(4096, 2_000_000), (1, 2_000)])
def test_substrings_small(spark, crowd, chunk, monkeypatch):
    """Overlaps, periods, copies and shared passages; crowded buckets split."""
    rng = np.random.default_rng(8)
    word = lambda n: " ".join("".join(rng.choice(list("abcdé"), 3)) for _ in range(n))
    shared = [word(130) for _ in range(3)]
    texts = [word(int(rng.integers(0, 300))) for _ in range(25)]
    texts += [word(40) + s + word(int(rng.integers(0, 60))) for s in shared for _ in range(6)]
    texts += [texts[0], "ab" * 700, "xyz" * 100, word(30) + "qrs " * 150 + word(5), shared[0][:399], shared[0][:400], word(50) + shared[1][100:499] + word(20)]
    monkeypatch.setattr(bpr, "CROWD", crowd)
    monkeypatch.setattr(bpr, "CHUNK", chunk)
    monkeypatch.setattr(bpr, "FINE", 64)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r for r in bpr.repeated_substrings(df).collect()}
    for i, (spans, kept) in enumerate(removed_by_all_windows(texts, 400)):
        assert [(s["start"], s["end"]) for s in got[i]["spans"]] == spans, i
        assert (got[i]["kept"] if spans else texts[i].encode()) == kept


@pytest.mark.parametrize("crowd", [4096, 50])
def test_substrings_of_one_passage_in_many_texts(spark, crowd, monkeypatch):
    """The bucket of a passage's edges grows with the texts that hold it; no
    task refines more than a fixed number of bytes."""
    rng = np.random.default_rng(9)
    word = lambda n: " ".join("".join(rng.choice(list("abcdef"), 4)) for _ in range(n))
    shared = word(130)
    texts = [word(100) + shared[:int(rng.integers(380, 600))] + word(100) for _ in range(300)] + ["ab" * 9000, "ab" * 200 + word(90)]
    refine, most = bpr.refine, 20_000

    def bounded(rows, *args):
        assert sum(map(len, rows)) <= 2 * most, "a task refines more than its bound"
        return refine(rows, *args)

    monkeypatch.setattr(bpr, "refine", bounded)
    monkeypatch.setattr(bpr, "CROWD", crowd)
    monkeypatch.setattr(bpr, "CHUNK", most)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r for r in bpr.repeated_substrings(df).collect()}
    for i, (spans, kept) in enumerate(removed_by_all_windows(texts, 400)):
        assert [(s["start"], s["end"]) for s in got[i]["spans"]] == spans, i
        assert (got[i]["kept"] if spans else texts[i].encode()) == kept


def test_substrings_query(spark, texts):
    got = queries.op4_bucket_pointer_refinement(spark, SF_SMALL).toPandas().set_index("doc_id")
    for (i, t), (spans, kept) in zip(texts.items(), removed_by_all_windows(texts, 400)):
        r = got.loc[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(t.encode()), sum(b - a for a, b in spans), len(spans), hashlib.sha256(kept).hexdigest())


def test_runs_in_parts_hold_every_window():
    raw = bytes(np.random.default_rng(2).integers(97, 100, 5000, dtype=np.uint8))
    part, bpr.PART = bpr.PART, 1024
    try:
        cover = [(lo, n) for _, lo, n, _ in bpr.runs(raw)]
    finally:
        bpr.PART = part
    assert [lo + k for lo, n in cover for k in range(n)] == list(range(len(raw) - 399))


def test_edits_equal_full_counts(spark, texts):
    encode = packing.load_encoder(packing.vocabulary_path())
    rng = np.random.default_rng(4)
    alphabet = list("ab  \n'sé1.ñ,\t")
    for _ in range(4000):
        t = "".join(rng.choice(alphabet, int(rng.integers(0, 60))))
        starts = [*editcount.leaf_starts(t, 4), len(t)]
        pieces = [t[a:b] for a, b in zip(starts, starts[1:])]
        lengths, tree = [len(p) for p in pieces], editcount.tree_of([len(encode(p)) for p in pieces])
        for _ in range(3):
            a = int(rng.integers(0, 70))
            b, new = a + int(rng.integers(0, 20)), "".join(rng.choice(alphabet, int(rng.integers(0, 30))))
            t, lengths, tree, _ = editcount.edit(t, lengths, tree, a, b, new, encode)
            assert sum(lengths) == len(t) and tree[1] == len(encode(t))
    got = queries.op5_edit_aware_counts(spark, SF_SMALL).toPandas().set_index("doc_id")
    docs = pd.read_parquet(f"{SF_SMALL}/documents.parquet").set_index("doc_id")
    for i, t in texts.items():
        at = len(t) // 2
        after = t[:at] + f" note: {docs.lang[i]} {docs.source[i]}" + t[at + i % 40:]
        assert (got.n_tokens[i], got.n_tokens_after[i]) == (len(encode(t)), len(encode(after)))
        assert got.chars_encoded[i] < 4 * editcount.LEAF


def test_packing_round_trip(spark, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = queries.op7_best_fit_packing(spark, SF_SMALL).toPandas()
    for i, t in texts.items():
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for r in got[got.doc_id == i].sort_values("start").itertuples():
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at:at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert (s.offset == s.length.cumsum() - s.length).all() and s.length.sum() <= 1024
    assert got.length.sum() > 0.97 * 1024 * got.sequence_id.nunique()


def test_best_fit_is_tightest():
    rng = np.random.default_rng(6)
    for _ in range(100):
        lengths = rng.integers(1, 65, int(rng.integers(0, 60))).tolist()
        place, used = packing.best_fit(lengths, 64)
        room = {}
        for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
            at, offset = place[i]
            fits = [v for v in room.values() if v >= lengths[i]]
            assert (64 - offset == min(fits) == room[at]) if fits else (at not in room and offset == 0)
            room[at] = 64 - offset - lengths[i]
        assert len(room) == used


def der(tag, *parts):
    body = b"".join(parts)
    size = len(body)
    return bytes([tag]) + (bytes([size]) if size < 128 else bytes([0x82]) + size.to_bytes(2, "big")) + body


def test_structural_confirmation():
    import base64
    import json

    numbers = der(0x30, der(2, b"\0"), *(der(2, bytes([k]) * 60) for k in range(1, 8)))
    wrapped = der(0x30, der(0x30, der(6, b"\x2a\x86\x48\x86\xf7\x0d\x01\x01\x01"), b"\x05\0"), der(3, b"\0" + numbers))
    ssh = (7).to_bytes(4, "big") + b"ssh-rsa" + (3).to_bytes(4, "big") + b"\1\0\1" + (65).to_bytes(4, "big") + bytes(65)
    url = lambda b: base64.urlsafe_b64encode(b).rstrip(b"=").decode()
    token = f"{url(json.dumps({'alg': 'HS256'}).encode())}.{url(b'{}')}.{url(bytes(32))}"
    b64 = lambda b: base64.b64encode(b).decode()
    pem = f"-----BEGIN RSA PRIVATE KEY-----\n{b64(numbers)}\n-----END RSA PRIVATE KEY-----"
    kinds = lambda t: [(secrets.KINDS[k], t[s:e]) for s, k, e in secrets.spans_of(t) if k > 2]
    assert kinds(f"a {pem} b") == [("pem", pem)]
    assert kinds(f"a {token} b") == [("token", token)]
    assert kinds(f"a {b64(numbers)} b") == [("der", b64(numbers))]
    assert kinds(f"a {numbers.hex()} b") == [("der", numbers.hex())]
    # public material is told apart: an algorithm with bits, SSH wire strings, two numbers
    assert kinds(f"a {b64(wrapped)} b") == [("public", b64(wrapped))]
    assert kinds(f"ssh-rsa {b64(ssh)} x") == [("public", b64(ssh))]
    two = der(0x30, der(2, bytes([5]) * 90), der(2, b"\1\0\1"))
    assert kinds(f"a {b64(two)} b") == [("public", b64(two))]
    private = [der(0x30, der(2, b"\0"), der(0x30, der(6, b"\x2a\x86")), der(4, numbers)), der(0x30, der(2, b"\1"), der(4, bytes(32))), der(0x30, der(0x30, der(6, b"\x2a\x86\x48")), der(4, bytes(90)))]
    for raw in private:  # a version first, a version with octets, an encrypted key
        assert kinds(f"a {b64(raw)} b") == [("der", b64(raw))]
    container = b"openssh-key-v1\0" + bytes(60)
    assert kinds(f"a {b64(container)} b") == [("ssh", b64(container))]
    # glued to what base64 itself may hold, cut by an odd digit, wrapped into lines
    for glue in ("name_", "https://host/path/", "x-", "Zm9v/a_b-"):
        assert kinds(f"a {glue}{b64(numbers)} b") == [("der", b64(numbers))], glue
        assert kinds(f"a {glue}{b64(container)} b") == [("ssh", b64(container))], glue
    assert kinds(f"a f{numbers.hex()} b") == [("der", numbers.hex())]
    lines = "\n".join(b64(numbers)[k:k + 64] for k in range(0, len(b64(numbers)), 64))
    assert kinds(f"a\n{lines}\nb c") == [("der", lines)]
    assert kinds(f"a\n{lines[:80] + 'A' + lines[80:]}\nb c") == []
    # one wrong length, or no structure at all, is no secret
    assert kinds(f"a {b64(wrapped[:-1])} b") == [] and kinds("a " + "Qk" * 40 + " b") == []
    assert kinds("-----BEGIN RSA PRIVATE KEY-----\nAAAA\n-----END RSA PRIVATE KEY-----") == []


def test_long_runs_are_scanned_in_linear_time():
    import time

    began = time.time()
    for text in ("/MII" * 250_000, "_AAAA" * 200_000, "ab" * 500_000, "-----BEGIN A----- " * 20_000 + "A" * 400_000):
        secrets.spans_of(text)
    assert time.time() - began < 30


def test_redaction_leaves_public_keys(spark):
    import base64

    body = b"".join(der(2, bytes([k]) * 40) for k in range(1, 8))
    private, public = (base64.b64encode(der(0x30, *x)).decode() for x in ((der(2, b"\0"), body), (der(2, bytes([5]) * 90), der(2, b"\1\0\1"))))
    df = spark.createDataFrame([(1, f"k {private} p {public}"), (2, None), (3, "")], "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in secrets.redact(df).collect()} == {1: f"k [SECRET] p {public}", 2: None, 3: ""}


def test_secrets_query(spark, texts):
    base = {"assign": (r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8), "access": (r"AKIA[A-Z0-9]+", 16), "hex": (r"[0-9a-f]+", 32)}
    got = queries.op8_structural_secrets(spark, SF).toPandas().set_index("doc_id")
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    for i, t in zip(docs.doc_id, docs.text):
        spans = []
        for k, (kind, (pattern, least)) in enumerate(base.items()):
            found = [m for m in re.finditer(pattern, t, re.I | re.A if kind == "assign" else 0) if len(m[2] if kind == "assign" else m[0]) >= least]
            assert got.loc[i, f"n_{kind}"] == len(found)
            spans += [(m.start(), k, f"{kind}:{m.start()}:{m.end()}") for m in found]
        joined = ",".join(x for *_, x in sorted(spans))
        assert got.base_sha256[i] == hashlib.sha256(joined.encode()).hexdigest()
        assert set(filter(None, joined.split(","))) <= set(got.spans[i].split(","))
    assert got.n_hex.sum() > 0


def test_shards(spark):
    got = queries.op9_sampled_splitters(spark, SF).toPandas()
    docs = pd.read_parquet(f"{SF}/documents.parquet").set_index("doc_id")
    assert sorted(got.doc_id) == sorted(docs.index)
    for r in got.itertuples():
        raw = docs.text[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(raw) + 16, zlib.crc32(raw))
    total = got.groupby("shard")["size"].sum()
    assert len(total) == 40 and abs(total - total.mean()).max() <= got["size"].max() + 0.02 * total.mean()
    assert all(sorted(s.slot) == list(range(len(s))) for _, s in got.groupby("shard"))


def test_shards_of_one_hot_text(spark):
    from pyspark.sql import functions as F

    from arlens.llm import sharding

    df = spark.range(6000).select("id", F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("t"), "id")).alias("text"))
    rate, sharding.ROWS_PER_RANGE = sharding.ROWS_PER_RANGE, 300
    try:
        got = sharding.shard_by_bytes(df, F.xxhash64("text"), F.lit(100), 8).toPandas()
    finally:
        sharding.ROWS_PER_RANGE = rate
    n = got.groupby("shard").size()
    assert len(got) == 6000 and len(n) == 8 and n.max() <= 760 and n.min() >= 740


def test_wand_equals_full_scoring():
    items = [(i, t) for i, t in pd.read_parquet(f"{SF}/benchmark.parquet")[["item_id", "text"]].itertuples(index=False)]
    index = decontam.Index(items)
    rng = np.random.default_rng(7)
    for _ in range(200):
        unit = int(rng.integers(len(index.item_of)))
        terms = {int(t) for t in rng.choice(len(index.vocabulary), 40, replace=False)}
        terms |= {t for t, posts in enumerate(index.units) if unit in posts and rng.random() < 0.75}
        total = Counter()
        for t in terms:
            for u, x in zip(index.units[t], index.impacts[t]):
                total[u] += x
        for threshold in (0.1, 0.4, 0.6):
            assert sorted(u for u, _ in index.search(list(terms), threshold)) == sorted(u for u, x in total.items() if x >= threshold - 1e-9)


def test_decontamination_query(spark):
    got = queries.op10_block_max_wand(spark, SF).toPandas()
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    bench = pd.read_parquet(f"{SF}/benchmark.parquet")
    flat = lambda t: " " + " ".join(decontam.words_of(t)) + " "
    items = [(i, flat(t)) for i, t in zip(bench.item_id, bench.text)]
    want = {(d, i) for d, t in zip(docs.doc_id, map(flat, docs.text)) for i, q in items if q in t}
    assert set(zip(got.doc_id, got.item_id)) == want and len(want) > 10


def test_decontamination_of_edited_passages_and_index_shards(spark):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    words = decontam.words_of(bench.orderBy("item_id").first()["text"])
    edited = [w if k % 12 != 5 else "changed" for k, w in enumerate(words)]
    filler = [f"filler{k}" for k in range(300)]
    df = spark.createDataFrame([(1, " ".join(filler[:70] + edited + filler)), (2, " ".join(filler)), (3, " ".join(sorted(words)))], "doc_id long, text string")
    for size in (decontam.SHARD_BYTES, 2000):
        got = df.select("doc_id", decontam.leaks(df["text"], bench, shard_bytes=size).alias("l")).collect()
        assert [[x["item_id"] for x in r["l"]] for r in got] == [[0], [], []]


def test_decontamination_plans_hold_one_shard(spark, monkeypatch):
    """Query and stage run the shards in turn, with the hits of a single index."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    whole = {(r["doc_id"], r["item_id"]) for r in queries.op10_block_max_wand(spark, SF).collect()}
    shards = decontam.shards
    monkeypatch.setattr(decontam, "shards", lambda b, **kw: shards(b, shard_bytes=8000))
    query, stage = queries.op10_block_max_wand(spark, SF), corpus_pipeline.drop_contaminated(spark, docs, SF)
    assert [df._jdf.queryExecution().analyzed().toString().count("find(") for df in (query, stage)] == [1, 1]
    kept = {r["doc_id"] for r in stage.select("doc_id").collect()}
    assert {(r["doc_id"], r["item_id"]) for r in query.collect()} == whole
    assert kept == {r["doc_id"] for r in docs.select("doc_id").collect()} - {d for d, _ in whole}


def test_scores_do_not_depend_on_shards(spark):
    """A varied benchmark of 4,000 items in 1, 3 and 10 shards: the same hits
    with the same scores, near the threshold too; ids are texts."""
    rng = np.random.default_rng(3)
    common, rare = [f"c{k}" for k in range(300)], [f"r{k}" for k in range(20_000)]
    texts = [" ".join([*rng.choice(common, rng.integers(3, 30)), *rng.choice(rare, rng.integers(2, 12))]) for _ in range(4000)]
    bench = spark.createDataFrame([(f"item {k}", t) for k, t in enumerate(texts)], "item_id string, text string")
    docs = []
    for k in range(60):
        words = texts[k * 7].split()
        lost = rng.random(len(words)) < k / 100
        docs.append((k, " ".join([*rng.choice(common, 40), *("x" if z else w for w, z in zip(words, lost)), *rng.choice(common, 40)])))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    total = sum(len(t) for t in texts)
    found = []
    for shards in (1, 3, 10):
        got = decontam.found_items(df, bench, ["doc_id"], shard_bytes=total // shards + 1).collect()
        found.append({(r["doc_id"], r["item_id"]): round(r["score"], 9) for r in got})
    assert found[0] == found[1] == found[2] and len(found[0]) > 10
    assert {(0, "item 0"), (1, "item 7")} <= set(found[0])


def test_decontamination_memory_of_a_long_text():
    import tracemalloc

    rng = np.random.default_rng(12)
    vocabulary = np.array([f"w{k}" for k in range(400)])
    items = [(k, " ".join(rng.choice(vocabulary, 40))) for k in range(2000)]
    index = decontam.Index(items)
    words = rng.choice(vocabulary, 16_000).tolist()
    for k in (100, 8000, 15_900):
        words[k:k] = items[k % 2000][1].split()
    tracemalloc.start()
    try:
        found = {x[0] for x in index.leaks(" ".join(words))}
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert {100, 0, 1900} <= found and peak < 40_000_000


def test_pipeline_against_stages_by_hand(spark):
    """run() keeps what its stages' decisions, taken apart, say."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    pieces = corpus_pipeline.run(spark, SF).toPandas()
    kept = corpus_pipeline.drop_low_quality(spark, docs, SF).toPandas().set_index("doc_id")
    groups = groups_by_all_pairs(list(kept.index), [shingle_set(t) for t in kept.text])
    kept = kept[[groups[i] == i for i in kept.index]]
    flat = lambda t: " " + " ".join(decontam.words_of(t)) + " "
    items = [flat(t) for t in pd.read_parquet(f"{SF}/benchmark.parquet").text]
    kept = kept[[not any(q in flat(t) for q in items) for t in kept.text]]
    encode = packing.load_encoder(packing.vocabulary_path())
    mark = lambda t: re.sub(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{8,}|[0-9a-f]{32,}""", "[SECRET]", t)
    want = {i: encode(mark(t)).tobytes() + bytes(4) for i, t in kept.text.items()}
    got = pieces.sort_values(["doc_id", "start"]).groupby("doc_id").ids.apply(b"".join).to_dict()
    assert got == want
    labels = pd.read_parquet(f"{SF}/labels.parquet").set_index("doc_id").quality
    clean = [i for i in labels.index[labels == 1] if zlib.crc32(str(i).encode()) % 4 == 2]
    passed = corpus_pipeline.drop_low_quality(spark, docs, SF).toPandas().doc_id
    assert np.isin(clean, passed).mean() > 0.95
