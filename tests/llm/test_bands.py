"""The compression bands decide on texts that pass the base rules."""

import base64
import random

from tilespark.llm import compression


def test_bands_reject_what_the_base_rules_pass(spark, sf_dir):
    rng = random.Random(4)
    letters = "etaoinshrdlucmfwypvbgkjqxz"
    weights = [1 / (k + 1.5) for k in range(26)]
    vocabulary = ["".join(rng.choices(letters, weights, k=rng.randint(2, 9))) for _ in range(3000)]
    prose = lambda n: " ".join(rng.choices(vocabulary, [1 / (k + 3) for k in range(3000)], k=n))
    noise = lambda n: " ".join(base64.b64encode(rng.randbytes(rng.randint(4, 12))).decode() for _ in range(n))
    again = lambda n: " ".join(w for w in prose(n).split() for _ in range(7))
    texts = [again(20), again(60), noise(60), noise(300), noise(3000), prose(150), prose(400), prose(1100), prose(3000), prose(800) + " " + noise(2000)]
    out = compression.rules(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    got = {r["doc_id"]: r for r in out}
    assert not any(r["base_failed"] for r in out)
    assert [got[k]["kept"] for k in range(10)] == [False] * 5 + [True] * 4 + [False]
    one = compression.rules(spark.createDataFrame([(0, prose(1100)[:4096]), (1, prose(1100)[:4106]), (2, "a" * 4096)], "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_chunks"], r["n_bad_chunks"]) for r in one} == {0: (1, 0), 1: (2, 0), 2: (1, 1)}
    docs, labels = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "labels"))
    good = compression.rules(docs).join(labels.filter("quality = 1"), "doc_id").filter("NOT base_failed")
    assert good.count() > 0 and good.filter("NOT kept").count() == 0
