"""Word vectors, pooling and the network of the quality classifier against plain loops."""

import math

import numpy as np
from pyspark.sql import functions as F

from tilespark.llm import quality

TEXTS = ["a b c a", "b, c", None, "", "new words are new", "a a a a a b", "ü É a"]


def test_word_vectors_and_pooling_by_hand(spark):
    words = ["a", "b", ","]
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(3)
    got = quality.word_vectors(docs, "text", words)
    at, sign = quality.index_vectors(words)
    assert got.shape == (3 + quality.OTHERS, 2 * quality.DIMS + 1) and at.shape == (3 + quality.OTHERS, quality.NONZERO)
    index = np.zeros((len(at), quality.DIMS))
    for w in range(len(at)):
        for p, s in zip(at[w], sign[w]):
            index[w, p] += s
    place = quality._Places(words)
    ids = [place(t or "").tolist() for t in TEXTS]
    assert ids[1] == [1, 2, ids[0][2]] and ids[0][2] >= 3
    context, n = np.zeros_like(index), np.zeros(len(at))
    for own in ids:
        for k, w in enumerate(own):
            n[w] += 1
            for j in range(max(0, k - quality.REACH), min(len(own), k + quality.REACH + 1)):
                if j != k:
                    context[w] += index[own[j]]
    for w in sorted({w for own in ids for w in own}):
        size = math.sqrt((context[w] ** 2).sum()) or 1e-9
        assert np.allclose(got[w, : quality.DIMS], context[w] / size, atol=1e-5)
        assert np.allclose(got[w, quality.DIMS : -1], index[w] / 2, atol=1e-6)
        assert abs(got[w, -1] - 1e-3 / (1e-3 + n[w] / n.sum())) < 1e-6
    for own in ids:
        want = np.zeros(5 * quality.DIMS)
        if own:
            v, g = got[own, :-1].astype(float), got[own, -1].astype(float)
            mean = v.mean(0)
            spread = np.sqrt(np.maximum((v[:, : quality.DIMS] ** 2).mean(0) - mean[: quality.DIMS] ** 2, 0))
            want = np.concatenate([mean, (v * g[:, None]).sum(0) / g.sum(), spread])
        assert np.allclose(quality.pool(np.array(own, np.int64), got), want, atol=1e-3)


def test_vocabulary_has_words_of_two_texts(spark):
    rows = spark.createDataFrame([(t,) for t in [*TEXTS, "b"]], "_text string").repartition(2)
    assert quality.vocabulary(rows) == ["b", "a", "c"]
    assert quality.vocabulary(rows, 1) == ["b"] and quality.vocabulary(rows.filter("1 = 0")) == []


def test_network_learns_and_calibrates():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 6))
    chance = 1 / (1 + np.exp(-3 * x[:, 0] * np.sign(x[:, 1])))  # not linear in the inputs
    y = (rng.random(3000) < chance).astype(float)
    net = quality.Network(x[:2000], y[:2000], np.arange(2000) % 5 == 0)
    got = net.score(x[2000:])
    best = -np.log(np.where(y[2000:] > 0, chance[2000:], 1 - chance[2000:])).mean()
    assert -np.log(np.where(y[2000:] > 0, got, 1 - got)).mean() < best + 0.12
    for low, high in ((0, 0.2), (0.8, 1)):
        own = (got >= low) & (got <= high)
        assert abs(got[own].mean() - y[2000:][own].mean()) < 0.1


def test_keep_good_without_labels_keeps_all(spark):
    docs = spark.createDataFrame([(i, t, 1.0) for i, t in enumerate(TEXTS)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    out = quality.keep_good(docs, labels)
    assert out.columns == docs.columns and out.count() == len(TEXTS)
    assert quality.keep_good(docs.filter("1 = 0"), labels).count() == 0
    assert quality.keep_good(docs, labels.withColumn("quality", F.lit(None).cast("int"))).count() == len(TEXTS)
