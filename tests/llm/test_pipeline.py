"""The pipeline's stages: columns, effects and order."""

import corpus_pipeline
from pyspark.sql import functions as F

from tilespark.llm import decontaminate, pii, quality, queries


def least_of_groups(rows):
    """Least id of each group that a five-word Jaccard similarity of 0.8 links, by all pairs."""
    sets, root = {}, {r["doc_id"]: r["doc_id"] for r in rows}
    for r in rows:
        w = (r["text"] or "").lower().split()
        sets[r["doc_id"]] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    for i in sets:
        for j in sets:
            if j < i and root[i] != root[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                lo, hi = sorted((root[i], root[j]))
                root = {k: lo if v == hi else v for k, v in root.items()}
    return set(root.values())


def test_stages_take_effect(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, own = docs.columns, docs
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "simhash_near_dedup", "benchmark_decontamination", "pii", "packing"]
    bench, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("benchmark", "labels"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = own.cache()
        own = stage(spark, before, sf_dir).cache()
        assert own.columns == columns and 0 < own.count() <= before.count()
        if name == "quality_classifier":
            good = {r["doc_id"] for r in quality.classify(before, labels).filter("predicted = 1").collect()}
            assert {r["doc_id"] for r in own.collect()} == good
        if name == "simhash_near_dedup":
            assert least_of_groups(before.collect()) == {r["doc_id"] for r in own.collect()}
        if name == "benchmark_decontamination":
            gone = {r["doc_id"] for r in decontaminate.contamination(before, bench).filter("contaminated").collect()}
            assert {r["doc_id"] for r in own.collect()} == {r["doc_id"] for r in before.collect()} - gone
            assert decontaminate.contamination(own, bench).filter("n_hit > 0").count() == 0
        if name == "pii":
            assert own.count() == before.count()
            assert pii.find_pii(own).agg(F.sum(F.expr("n_email + n_ip + n_card + n_phone"))).collect()[0][0] == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, own, sf_dir)
    whole = corpus_pipeline.run(spark, sf_dir)
    key = lambda d: sorted(map(tuple, d.select("doc_id", "start", "length", "ids_crc32").collect()))
    totals = lambda d: sorted(map(tuple, d.groupBy("doc_id").agg(F.sum("length")).collect()))
    assert totals(packed) == totals(whole) and len(key(whole)) > 0


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
