"""Spelling variants, resampling and language-model scores against brute force
and on messy, empty and clashing input."""

import hashlib
import math
import re
import zlib
from collections import Counter
from os.path import commonprefix

import numpy as np
from pyspark.sql import functions as F

from arlens.llm import queries, recurrent, resampling, spelling

from conftest import SF_SMALL

ALPHABET = [chr(c) for c in (*range(97, 123), *range(0xC0, 0x100))]
#: Names that the operators use inside.
CLASH = "doc_id long, text string, id string, word string, n long, key string, able boolean, place long, _row long, _part int, train boolean, held_out boolean, p long, rank int"


def clash(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", 1, "k", True, 3, 4, 5, False, True, 6, 7) for i, t in rows], CLASH).repartition(3)


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


# ---------------------------------------------------------------- spelling variants


def brute_words(docs):
    n = Counter()
    for key, text in docs:
        for run in re.findall("[a-zÀ-ÿ]+", lower(text)):
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            if len(run) >= 6:
                n[run] += 1
    return {w: k for w, k in n.items() if k >= 5}


def brute_variants(n):
    def near(w):
        if len(w) > 1000:  # too long to spell all changes out
            return {v for v in n if v != w and abs(len(v) - len(w)) <= 1 and len(v) + len(w) - 2 * len(commonprefix((v, w))) - 2 * len(commonprefix((v[::-1], w[::-1]))) <= 2}
        out = {w[:i] + w[i + 1:] for i in range(len(w))}
        out |= {w[:i] + c + w[j:] for i in range(len(w) + 1) for j in (i, i + 1) for c in ALPHABET}
        return {x for x in out - {w} if x in n}

    met = {w: near(w) for w in n}
    best = {w: min(x, key=lambda v: (-n[v], v)) for w, x in met.items() if x}
    form = {w: v for w, v in best.items() if n[v] >= 5 * n[w]}
    out = set()
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n[w], len(met[w]), n.get(form.get(w))))
    return out


def as_set(df):
    return {(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def test_spelling_query_against_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op11_trie_node_pairs(spark, SF_SMALL)
    rows = got.collect()
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"] and len(rows) == len({r["word"] for r in rows})
    assert as_set(got) == brute_variants(brute_words(docs))


def test_variants_of_chains_ties_and_repeated_letters(spark):
    n = {"aaaaaa": 5, "aaaaaaa": 30, "aaaaaaaa": 200, "banana": 7, "bananas": 7, "bananna": 40, "bandana": 40, "xanana": 35, "ßßßßßß": 9, "ßßßßßßß": 45, "alone" + "z" * 300: 6, "alone" + "z" * 301: 90}
    got = as_set(spelling.variants(spark.createDataFrame(list(n.items()), "word string, n long").repartition(4)))
    assert got == brute_variants(n)
    by = {r[0]: r for r in got}
    assert by["aaaaaa"][1:3] == ("aaaaaaa", "aaaaaaaa") and by["banana"][1] == "bananna"


def test_variants_when_tasks_share_prefixes_and_suffixes(spark):
    """More tasks than words of a prefix: shared nodes are numbered once."""
    rng = np.random.default_rng(3)
    words = {"".join(rng.choice(list("ab"), rng.integers(6, 10))) for _ in range(500)}
    n = {w: int(rng.integers(5, 400)) for w in words}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "37")
        assert as_set(spelling.variants(spark.createDataFrame(list(n.items()), "word string, n long"))) == brute_variants(n)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_spelling_of_messy_rows(spark):
    rows = [(i, t) for i in (1, 2, 2, None) for t in (None, "", "Kettle kettles KETTLE naïveté×÷", "kettle " * 20_000 + "x" * 30_000)] * 2
    got = as_set(spelling.spelling_variants(clash(spark, rows)))
    assert got == brute_variants(brute_words(rows)) and {w for w, *_ in got} >= {"kettle", "naïveté×÷", "x" * 30_000}
    assert spelling.spelling_variants(clash(spark, rows).filter("false")).count() == 0


# ---------------------------------------------------------------------- resampling


def brute_features(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    return len(w), [zlib.crc32(" ".join(w[i:i + k]).encode()) % 10_000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def brute_resample(docs, target):
    raw, wanted = Counter(), Counter()
    made = [(key, *brute_features(text)) for key, text in docs]
    for _, _, f in made:
        raw.update(f)
    for text in target:
        wanted.update(brute_features(text)[1])
    s, t = sum(raw.values()), sum(wanted.values())
    gain = [math.floor(1000 * math.log((wanted[b] + 1) * (s + 10_000) / ((raw[b] + 1) * (t + 10_000)))) for b in range(10_000)]
    out = []
    for key, n, f in made:
        h = int(hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append((key, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    able = sorted((r for r in out if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0]))
    drawn = able[:5 * len(able) // 100]
    rest = list(out)
    for r in drawn:
        rest.remove(r)
    return Counter([(*r[:4], k) for k, r in enumerate(drawn, 1)] + [(*r[:4], None) for r in rest])


def test_resampling_query_against_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    got = queries.op12_importance_resampling(spark, SF_SMALL)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"] and {t for _, t in got.dtypes} == {"bigint"}
    assert Counter(map(tuple, got.collect())) == brute_resample(docs, target)


def test_resampling_of_messy_rows(spark):
    long = " ".join(f"word{i % 977} {i % 13}" for i in range(30_000))
    some = [None, "", " \n", "one", "One two", "Ünï 日本 \x80x\x7fy", "the quick brown fox " * 9, long]
    rows = [(i, t) for i in range(30) for t in some[i % 8:]] + [(5, "the quick brown fox " * 9)] * 40 + [(None, long), (None, long)]
    target = [long, None, "", "the quick"]
    texts = spark.createDataFrame([(t,) for t in target], "text string")
    got = resampling.resample(clash(spark, rows), texts).collect()
    assert Counter(map(tuple, got)) == brute_resample(rows, target)
    assert resampling.resample(clash(spark, rows).filter("false"), texts).count() == 0
    none = resampling.resample(clash(spark, rows), texts.filter("false")).collect()
    assert Counter(map(tuple, none)) == brute_resample(rows, [])


# ------------------------------------------------------------------ language model


def brute_base(docs, train):
    c = Counter()
    cut = lambda text: re.findall(r"[^\x20\x09-\x0D]+", lower(text)) + [""]
    for key, text in docs:
        if train(key):
            c.update(cut(text))
    n, v = sum(c.values()), len(c)
    return [(key, not train(key), len(w := cut(text)), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 6)) for key, text in docs]


def known(key):
    return key is None or zlib.crc32(str(key).encode()) % 7 != 2


def test_language_model_query(spark):
    """Base columns are exact; the model beats the base on held-out documents."""
    docs = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op13_gated_recurrent_lm(spark, SF_SMALL).collect()
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == Counter(brute_base(docs, known))
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held) + 0.005 * sum(r["n_tokens"] for r in held)
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)


def test_joined_counts_and_endings(spark, monkeypatch):
    """With few words sent along, most counts are joined; sums stay the same."""
    for name, value in (("COUNTED", 40), ("CLASSES", 4), ("MEMBERS", 8), ("OWN", 32), ("ROUNDS", 1)):
        monkeypatch.setattr(recurrent, name, value)
    docs = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").limit(60).collect()] + [(None, "a b ß"), (None, None), (7, ""), (7, "")]
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    got = recurrent.score_documents(clash(spark, docs), ~F.coalesce(fold, F.lit(False)), F.coalesce(fold, F.lit(False))).collect()
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == Counter(brute_base(docs, known))
    assert all(math.isfinite(r["score"]) for r in got)


def test_symbol_shares_add_up_to_one(spark):
    """Own words, and each ending's words with one unknown, are a distribution."""
    rng = np.random.default_rng(0)
    net = recurrent.new_net(rng.integers(1, 90, recurrent.OWN).astype(float), rng.integers(1, 9, recurrent.ENDINGS).astype(float))
    net = recurrent.Net(*[x + 0.2 * rng.standard_normal(x.shape).astype(np.float32) for x in net])
    h = rng.standard_normal((1, recurrent.STATE)).astype(np.float32)
    every = np.arange(recurrent.OWN + recurrent.ENDINGS)
    assert math.isclose(np.exp(recurrent.predict(net, np.repeat(h, len(every), 0), every)).sum(), 1, rel_tol=1e-4)
    docs = spark.createDataFrame([("b a ca da a b c",), ("xa b",), ("xa",)], "text string")
    lex = recurrent.lexicon(recurrent.token_counts(docs))
    assert (lex.total, lex.kinds, lex.word[0], int(lex.n[0])) == (13, 7, b"", 3) and (lex.mass == 1).all()


def test_ending_masses(spark, monkeypatch):
    for name, value in (("CLASSES", 1), ("MEMBERS", 2), ("OWN", 2)):
        monkeypatch.setattr(recurrent, name, value)
    n = Counter("z z z a ba xba xba ß ein kein mein".split())
    lex = recurrent.lexicon(recurrent.token_counts(spark.createDataFrame([(" ".join(n.elements()),)], "text string")))
    mass, rest = np.ones(recurrent.ENDINGS), np.zeros(recurrent.ENDINGS)
    for w, k in n.items():
        if w != "z":
            e = recurrent.ending(w.encode())
            mass[e] += k + 1
            rest[e] += k
    assert lex.word[:2] == [b"", b"z"] and np.array_equal(lex.rest, rest)
    assert np.array_equal(np.where(rest > 0, lex.mass, 1), mass)


def test_gradient_by_differences():
    rng = np.random.default_rng(5)
    net = recurrent.new_net(rng.integers(1, 90, recurrent.OWN).astype(float), np.full(recurrent.ENDINGS, 9.0), state=5)
    net = recurrent.Net(*[(x + 0.3 * rng.standard_normal(x.shape)).astype(float) for x in net])
    target = rng.integers(0, recurrent.OWN + recurrent.ENDINGS, (6, 4))
    target[rng.random(target.shape) < 0.3] = 0
    target[4:, 3] = -1
    read = np.vstack([np.zeros((1, 4), int), np.maximum(target[:-1], 0)])
    run = lambda net: recurrent.gradient(net, read, target, np.zeros((4, 5)))
    _, _, dense, (symbol, embed), (classes, inner, _) = run(net)
    places = [(name, np.unravel_index(np.abs(g).argmax(), g.shape), g.flat[np.abs(g).argmax()]) for name, g in dense.items()]
    places += [("embed", (symbol[-1], 2), embed[-1][2]), ("inner", (classes[0], 1, 3), inner[0][1, 3])]
    for name, at, g in places:
        moved = []
        for e in (0.01, -0.01):
            x = getattr(net, name).copy()
            x[at] += e
            moved.append(run(net._replace(**{name: x}))[0])
        assert math.isclose((moved[1] - moved[0]) / 0.02, g, rel_tol=0.01, abs_tol=1e-4), name


def test_state_is_carried_over_windows():
    """A document's likelihood is the same in any window and beside any others."""
    rng = np.random.default_rng(2)
    net = recurrent.new_net(rng.integers(1, 90, recurrent.OWN).astype(float), np.full(recurrent.ENDINGS, 9.0))
    net = recurrent.Net(*[x + 0.2 * rng.standard_normal(x.shape).astype(np.float32) for x in net])
    texts = [np.append(rng.integers(1, recurrent.OWN, n), 0).astype(np.int32) for n in (0, 1, 7, 31, 32, 33, 400, 5)]
    alone = [recurrent.log_likelihood(net, [t], 1, 10_000)[0] for t in texts]
    for n_lanes, window in ((3, 32), (8, 5), (1, 64)):
        assert np.allclose(recurrent.log_likelihood(net, texts, n_lanes, window), alone, rtol=1e-4)


def test_training_raises_likelihood():
    rng = np.random.default_rng(4)
    cycle = [np.append(np.resize(np.roll([3, 9, 27, 81], k), 60), 0).astype(np.int32) for k in rng.integers(0, 4, 400)]
    n = np.bincount(np.concatenate(cycle), minlength=recurrent.OWN)[:recurrent.OWN].astype(float)
    net = recurrent.new_net(n, np.zeros(recurrent.ENDINGS))
    after = recurrent.train(net, cycle * 3)
    assert recurrent.log_likelihood(after, cycle[:20]).sum() > 0.5 * recurrent.log_likelihood(net, cycle[:20]).sum()


def test_nothing_to_learn_from(spark):
    docs = clash(spark, [(1, "a b"), (2, None)])
    got = {r["doc_id"]: r for r in recurrent.score_documents(docs, F.lit(False), F.lit(True)).collect()}
    assert (got[1]["train_tokens"], got[1]["n_tokens"], got[1]["n_known"], got[1]["base_score"]) == (0, 3, 0, 0.0) and math.isfinite(got[2]["score"])
    assert recurrent.score_documents(docs.filter("false"), F.lit(True), F.lit(False)).count() == 0


def test_tokens_split_at_six_blanks():
    import pyarrow as pa

    texts = ["", "x" * 100_000, "Ab" * 10 + " \x1c c\x85d", "\t\n\x0b\x0c\r a  B\u00a0c \u2003 ÀÉ a "]
    owner, code, word = recurrent.tokens(pa.array(texts, pa.large_string()))
    got = [[word[int(c)].as_py().decode() for c in code[owner == i]] for i in range(len(texts))]
    assert got == [re.findall(r"[^\x20\x09-\x0D]+", lower(t)) for t in texts]
