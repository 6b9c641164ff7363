"""Cross-entropy on a vocabulary larger than any fixed table, against exact counts."""

import math
import random
from collections import Counter

from tilespark.llm import lm


def test_every_word_and_pair_has_its_own_counts(spark):
    rng = random.Random(9)
    texts = [" ".join(f"w{rng.randrange(300_000)}" if rng.random() < 0.8 else rng.choice(["the", "of", "The"]) for _ in range(rng.randrange(1, 2500))) for _ in range(200)] + [None, "", "new"]
    rows = list(enumerate(texts)) + [(3, texts[3]), (None, texts[4])]
    good = {i for i in range(0, 200, 3)}
    split = [(i, (t or "").lower().split()) for i, t in rows]
    uni, pair, total = ([Counter(), Counter()], [Counter(), Counter()], [0, 0])
    for i, w in split:
        for m in (0, 1)[: 1 + (i in good)]:
            uni[m].update(w)
            pair[m].update(zip(w, w[1:]))
            total[m] += len(w)

    def loss(m, i, w):
        """By the counts of model m without this very document."""
        mine = (Counter(w), Counter(zip(w, w[1:])), len(w)) if m == 0 or i in good else (Counter(), Counter(), 0)
        out = 0.0
        for k, x in enumerate(w):
            alone = (uni[m][x] - mine[0][x]) / max(1, total[m] - mine[2])
            before = uni[m][w[k - 1]] - mine[0][w[k - 1]] if k else 0
            two = (pair[m][w[k - 1], x] - mine[1][w[k - 1], x]) / before if before else alone
            out -= math.log(0.6 * two + 0.35 * alone + 0.05 / lm.WORDS)
        return out / max(1, len(w))

    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(i, 1) for i in sorted(good)], "doc_id long, quality int")
    got = lm.score(docs, labels).collect()
    assert len(got) == len(rows)
    want = sorted((i is None, i or 0, len(w), round(loss(0, i, w), 7), round(loss(1, i, w), 7)) for i, w in split)
    have = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_words"], round(r["background_loss"], 7), round(r["target_loss"], 7)) for r in got)
    for a, b in zip(want, have):
        assert a[:3] == b[:3] and abs(a[3] - b[3]) < 1e-6 and abs(a[4] - b[4]) < 1e-6
