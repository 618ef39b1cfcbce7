"""Class-conditional Kneser-Ney evidence against a plain version on dictionaries."""

import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from arlens.llm import toxicity as X

WORDS = "the cat sat on a mat idiots idiot IDIOT! trash trashy 12 345 naïve ÀÉÎ über the them then".split()


def symbols(word):
    out = []
    for c in (" " + word.lower() + " "):
        c = ord(c)
        c = c if c < 128 else 128 + c % 128
        out.append(48 if 48 <= c <= 57 else max(c, 1))
    return out


def spelt(word):
    a = [0] * (X.ORDER - 1) + symbols(word)
    return [tuple(a[i - X.ORDER + 1:i + 1]) for i in range(X.ORDER, len(a))]


def brute(rows):
    """Evidence of a word from (label, text) rows."""
    every, count = set(), {0: Counter(), 1: Counter()}
    for label, text in rows:
        for w in set((text or "").lower().split()):
            for g in spelt(w):
                every.add(g)
                if label is not None:
                    count[label][g] += 1
    level = {X.ORDER: every}
    for k in range(X.ORDER - 1, 0, -1):
        level[k] = {g[1:] for g in level[k + 1]}
    before = {k: Counter(g[1:] for g in level[k + 1]) for k in range(1, X.ORDER)}
    total, kinds = {}, {}
    for k, n in before.items():
        total[k], kinds[k] = defaultdict(int), defaultdict(int)
        for g, m in n.items():
            total[k][g[:-1]] += m
            kinds[k][g[:-1]] += 1

    def shared(g):
        if not g:
            return 1 / 256
        k, ctx = len(g), g[:-1]
        return max(before[k][g] - X.DISCOUNT, 0) / total[k][ctx] + X.DISCOUNT * kinds[k][ctx] / total[k][ctx] * shared(g[1:])

    def log_p(g, label):
        n = count[label]
        own = [m for h, m in n.items() if h[:-1] == g[:-1]]
        rest = (X.STRENGTH + X.DISCOUNT * len(own)) / (sum(own) + X.STRENGTH)
        if n[g] or count[1 - label][g]:
            return math.log(max(n[g] - X.DISCOUNT, 0) / (sum(own) + X.STRENGTH) + rest * shared(g[1:]))
        return math.log(rest)  # the shared part is the same for both classes

    return lambda word: sum(log_p(g, 1) - log_p(g, 0) for g in spelt(word))


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(0)
    out = [(int(k % 3 == 0) if k % 5 else None, " ".join(rng.choice(WORDS, rng.integers(1, 30)))) for k in range(120)]
    return out + [(None, None), (1, ""), (0, None), (1, "trash " * 50 + "x" * 3000)]


def model(spark, rows):
    df = spark.createDataFrame(rows, "_label int, _text string").repartition(5)
    return X.Model(*X._tables(df), 1.0, (0.0, 1.0, 1.0))


def test_word_evidence_against_dictionaries(spark, rows):
    found, want = model(spark, rows), brute(rows)
    probe = [w.lower() for w in WORDS] + ["unseen", "trashed", "x" * 3000, "é", "7"]
    assert np.allclose(X.word_evidence(pa.array(probe, pa.large_string()), found), [want(w) for w in probe])


def test_counts_do_not_depend_on_tasks_or_merging(spark, rows, monkeypatch):
    whole = model(spark, rows)
    monkeypatch.setattr(X, "TALLY", 50)
    monkeypatch.setattr(X, "SLICE", 64)
    for a, b in zip(whole[:4], model(spark, rows)[:4]):
        assert np.allclose(a, b)


def test_text_evidence_is_the_mean_over_different_words(spark, rows):
    found = model(spark, rows)
    texts = ["trash THE the cat trash", "", None, " \n", "idiot"]
    got = X.evidence(pa.array(texts), found, (0.5, 1.5))
    value = dict(zip(WORDS, X.word_evidence(pa.array([w.lower() for w in WORDS], pa.large_string()), found)))
    own = [value[w] for w in ("trash", "the", "cat")]
    assert np.allclose(got[0], [np.mean(own), *(np.mean(np.maximum(np.array(own) - m, 0)) for m in (0.5, 1.5))])
    assert (got[1:4] == 0).all() and np.isclose(got[4, 0], value["idiot"])


def test_rare_class_keeps_its_rows(spark):
    """5,000 ordinary labels, 30 toxic ones, room for 200: toxic rows all count."""
    toxic = [(k, f"you are trash number {k} of the day", 1) for k in range(30)]
    plain = [(100 + k, f"the cat sat on mat {k} of the day", 0) for k in range(5000)]
    df = spark.createDataFrame(toxic + plain, "doc_id long, text string, label int")
    found = X.fit(df, df.select("doc_id", "label"), fit_rows=200)
    scores = {r["label"]: r["s"] for r in df.groupBy("label").agg(F.avg(X.score(F.col("text"), found)).alias("s")).collect()}
    assert scores[1] > 0.8 and scores[0] < 0.05


def test_curve_picks_the_margin_that_explains():
    rng = np.random.default_rng(1)
    y = (rng.random(400) < 0.3).astype(float)
    x = rng.normal(size=(400, 1 + len(X.MARGINS))) * 0.1
    x[:, 4] += 2 * y  # the excess over the fourth margin
    margin, (base, mean, excess) = X.fit_curve(x, y)
    assert margin == X.MARGINS[3] and excess > 0
    assert X.fit_curve(x[:0], y[:0])[1] == (-1.0, 1.0, 1.0)
