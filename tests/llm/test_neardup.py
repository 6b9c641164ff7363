"""The pipeline's near-copy stage against all pairs by brute force."""

import random

import corpus_pipeline


def near(a, b):
    sets = []
    for t in (a, b):
        w = t.lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))})
    return 5 * len(sets[0] & sets[1]) >= 4 * len(sets[0] | sets[1])


def test_stage_links_all_near_copies(spark, sf_dir):
    rng = random.Random(5)
    texts = ["", " ", "one two", "ONE two"]
    for size in (30, 80, 300):
        for _ in range(6):
            base = [f"w{rng.randrange(5000)}" for _ in range(size)]
            texts.append(" ".join(base))
            for changes in (1, 2, 3, 4, 6, size // 30, size // 20):
                own = list(base)
                for k in rng.sample(range(size), changes):
                    own[k] = "x" + own[k]
                texts.append(" ".join(own))
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if near(texts[i], texts[j]) and root[i] != root[j]:
                lo, hi = sorted((root[i], root[j]))
                root = [lo if x == hi else x for x in root]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, texts[4], "y"), (5, texts[5], "x"), (9999, None, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = corpus_pipeline.near_dedup_stage(spark, docs, sf_dir)
    assert out.columns == docs.columns
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(set(root))
    assert corpus_pipeline.near_dedup_stage(spark, docs.filter("1 = 0"), sf_dir).count() == 0
