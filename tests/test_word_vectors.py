"""Word vectors from counted pairs: every pair is counted, and rounds over counts get as far as rounds over words."""

import random

import numpy as np

from harrow.functions import text as T
from harrow.operators import wordvectors


def _lists(n, seed=5):
    pick = random.Random(seed)
    return [[f"w{8 * (k % 3) + pick.randrange(8)}" for _ in range(pick.randrange(0, 14))] for k in range(n)]


def _brute(lists, names, window):
    """Expected pairs of centre and context in a round, from every place of every word."""
    at, out = {w: k for k, w in enumerate(names)}, np.zeros((len(names), len(names)))
    for words in lists:
        ids = [at[w] for w in words if w in at]
        for i, a in enumerate(ids):
            for j, b in enumerate(ids):
                if i != j and abs(i - j) <= window:
                    out[a, b] += (window + 1 - abs(i - j)) / window
    return out


def test_every_pair_is_counted(spark, monkeypatch):
    lists = [*_lists(150), [], ["w1", "w1", "w1"], ["rare", "w2"]]
    words = spark.createDataFrame([(x,) for x in lists], "l array<string>").repartition(5)
    names, often = wordvectors.vocabulary(words, "l", 7)
    assert "rare" not in names and often.tolist() == sorted(often, reverse=True)
    want = _brute(lists, names, 6)
    for stretch, kept, rows in ((1 << 19, 1 << 22, 7), (10, 5, 24)):
        monkeypatch.setattr(wordvectors, "STRETCH", stretch)
        key, n = wordvectors.pair_counts(np.array([0, 1, 0, 2]), np.array([0, 0, 0, 1]), 6, 3)
        assert dict(zip(key.tolist(), n.tolist())) == {1: 12, 0: 5}
        found = np.zeros_like(want)
        table = wordvectors.blocks(wordvectors.counted(words, "l", names, 6), len(names), rows)
        for r in table.collect():
            block = found[r["g"] * rows : (r["g"] + 1) * rows]
            at = np.frombuffer(r["at"], np.int64)
            block[at // len(names), at % len(names)] += np.frombuffer(r["n"], np.int64) / 6
        assert np.allclose(found, want)


def _loss(own, other, pos, neg):
    z = (own @ other.T).astype(float)
    return (pos * np.logaddexp(0, -z) + neg * np.logaddexp(0, z)).sum() / pos.sum()


def test_a_step_never_leads_away():
    rng = np.random.default_rng(2)
    pos, neg = rng.poisson(2, (9, 30)) * 1e4, rng.random((9, 30)) * 1e3
    own, other = (rng.normal(0, 2, (k, 12)).astype(np.float32) for k in (9, 30))
    before = _loss(own, other, pos, neg)
    for rate in (1e-6, 0.025, 10):
        assert _loss(wordvectors.stepped(own, other, pos.astype(np.float32), neg.astype(np.float32), rate), other, pos, neg) < before


def test_rounds_over_counts_get_as_far_as_rounds_over_words(spark):
    lists, dim, window = _lists(240), 10, 6
    words = spark.createDataFrame([(x,) for x in lists], "l array<string>").repartition(3)
    names, own = wordvectors.trained(words, "l", dim=dim, window=window)
    assert own.shape == (24, dim) and np.isfinite(own).all()
    pos = _brute(lists, names, window)
    often = wordvectors.vocabulary(words, "l", 7)[1]
    odds = often**0.75 / (often**0.75).sum()
    neg = 5 * np.outer(pos.sum(1), odds)

    rng = np.random.default_rng(1)  # word by word: ten rounds, windows and negative samples drawn
    x, y = (rng.random((24, dim)) - 0.5) / dim, np.zeros((24, dim))
    at = {w: k for k, w in enumerate(names)}
    for k in range(10):
        for ids in ([at[w] for w in row] for row in lists):
            for i, a in enumerate(ids):
                reach = rng.integers(1, window + 1)
                for j in [*range(max(0, i - reach), i), *range(i + 1, min(len(ids), i + reach + 1))]:
                    to = np.array([ids[j], *rng.choice(24, 5, p=odds)])
                    g = 0.025 * (1 - k / 10) * ((np.arange(6) == 0) - 1 / (1 + np.exp(-y[to] @ x[a])))
                    step = g @ y[to]
                    np.add.at(y, to, g[:, None] * x[a])
                    x[a] += step

    def best(v):  # the contexts that suit these vectors best
        v, c = v.astype(np.float32), np.zeros((24, dim), np.float32)
        for _ in range(60):
            c = wordvectors.stepped(c, v, pos.T.astype(np.float32), neg.T.astype(np.float32), 1e3)
        return _loss(v, c, pos, neg)

    assert best(own) <= best(x) + 0.01
    group = lambda w: int(w[1:]) // 8
    for w in names:
        assert {group(o) for o, _ in wordvectors.near(names, own, w, 7)} == {group(w)}


def test_no_word_is_frequent_enough(spark):
    assert wordvectors.trained(spark.createDataFrame([(["a", "b"],)], "l array<string>"), "l")[0] == []


def test_training_goes_over_counts_not_words(spark, sf, monkeypatch):
    """Each word of the texts was gone over in each of ten rounds."""
    from pyspark.ml import feature

    from harrow.queries import learning

    monkeypatch.setattr(feature.Word2Vec, "fit", None)
    rows = learning.ml_w2v(spark, sf).collect()
    assert len(rows) == 20 and [r["similarity"] for r in rows] == sorted((r["similarity"] for r in rows), reverse=True)


def test_token_lists_are_those_of_token_list(spark, sf):
    odd = "NGOs S A Is IS it's menses women MEN mens assess Assesses boxes churches ies ties flies bus gas basis ss s 5a α5 a1 Éclairs naïves x-rays DNAs bSs Ss sS 1s men amen zes buzzes sches"
    texts = [(odd,), (None,), ("",), ("the",), ("Ça, l’été!",)] + [(r["abstract"],) for r in spark.read.parquet(f"{sf}/articles_df.parquet").select("abstract").collect()]
    df = spark.createDataFrame(texts, "t string").coalesce(1)
    assert [r["l"] for r in T.token_lists(df, "t").collect()] == [r["l"] for r in df.select(T.token_list("t").alias("l")).collect()]
