"""Per-document operators against brute force, on awkward small tables."""

import base64
import hashlib
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tilespark.llm import compression, decontaminate, lm, pii, quality, tokens

TEXTS = [
    None,
    "",
    "   \n\t ",
    "word",
    "mail a.34@mail7.example.com or x@y.z@q.r, ip 10.0.0.256 and 192.168.1.17.5 +1 (017) 555-7713.",
    "card 4111 1111 1111 1111, not 4111111111111112; token = \"04dbebab91ab85687d33eeaaf9\" é日本",
    "a" * 5000 + "@",
    "1" * 4000 + ".2.3.4",
    "the cat sat on the mat " * 400,
    "Ünïcödé wörds ΑΣ İ don't they'll  <|endoftext|> 12345\x0b\x1c\x85 end",
    "the cat sat on the mat " * 400,
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i != 3 else None, t, "x", 1.0, i) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, score string, _pii double, n_words int")


def empty(docs):
    return docs.filter("1 = 0")


def brute_pii(text):
    text = text or ""
    e = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    ip = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    c = re.compile(r"[0-9]([\x20-]?[0-9])+")
    p = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
    digits = lambda s: re.sub("[^0-9]", "", s)

    def luhn(s):
        d = [int(x) for x in digits(s)][::-1]
        return 13 <= len(d) <= 19 and sum(sum(divmod(2 * x, 10)) if i % 2 else x for i, x in enumerate(d)) % 10 == 0

    tests = [("email", e, lambda s: True), ("ip", ip, lambda s: all(int(x[-4000:]) <= 255 for x in s.split("."))), ("card", c, luhn), ("phone", p, lambda s: 9 <= len(digits(s)) <= 15)]
    return [(k, *m.span()) for k, r, ok in tests for m in r.finditer(text) if ok(m.group())]


def test_pii_base_and_spans(docs):
    got = {i: r for i, r in enumerate(sorted(pii.find_pii(docs.withColumn("doc_id", F.col("n_words").cast("long"))).collect(), key=lambda r: r["doc_id"]))}
    for i, t in enumerate(TEXTS):
        want = brute_pii(t)
        listed = ",".join(f"{k}:{s}:{e}" for k, s, e in want)
        assert got[i]["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in pii.BASE_KINDS] == [sum(w[0] == k for w in want) for k in pii.BASE_KINDS]
        assert set(listed.split(",")) - {""} <= set(got[i]["spans"].split(","))
    assert "secret:" in got[5]["spans"]
    assert got[0]["spans"] == got[1]["spans"] == ""
    assert pii.find_pii(empty(docs)).count() == 0


def test_pii_finders_match_plain_patterns():
    rng = random.Random(5)
    alpha = "ab.@-+ 019(),_%é\n"
    for _ in range(3000):
        t = "".join(rng.choice(alpha) for _ in range(rng.randint(0, 30)))
        base, _ = pii.base_spans(t)
        assert [(k, s, e) for k in pii.BASE_KINDS for s, e in base[k]] == brute_pii(t), t


def test_pii_long_runs_take_linear_time():
    for t in ("1" * 300_000, "a" * 300_000, "+1" + "(" * 300_000, "1." * 100_000, "1 " * 100_000):
        pii.base_spans(t)


def test_pii_many_candidates_take_linear_time():
    extract = pii._extract()
    for t in ("a@b.cd 555-123-4567 " * 100_000, "password=abcdefgh1 x(at)y.com " * 50_000, "John Smith " * 100_000, "token = '" * 100_000, "a-" * 500_000 + "(at)b.com"):
        began = time.time()
        extract([t])
        assert time.time() - began < 30


def test_pii_wide_candidates():
    names = pii._name_finder()

    def found(t):
        return {(k, t[s:e]) for k, s, e in pii._wide(t, pii.fold(t), pii.base_spans(t)[1], names)}

    long = "Aa1" * 200
    assert ("secret", long) in found(f'TOKEN = "{long}"') and ("secret", long) in found(f"İ PASSWORD={long}.")
    assert ("secret", "AKIA" + "Z" * 16) in found("key AKIA" + "Z" * 16 + " end")
    assert ("email", "jo.do (at) site [dot] org") in found("to jo.do (at) site [dot] org now")
    assert ("person", "Mary " + "B" + "o" * 50) in found("by Mary B" + "o" * 50)
    assert pii.fold("İX") == "İx"


def test_label_model_recovers_reliabilities():
    rng = np.random.default_rng(8)
    truth = rng.random(20_000) < 0.5
    right, silent = np.array([0.95, 0.9, 0.8, 0.7, 0.6, 0.55]), np.array([0.1, 0.3, 0.3, 0.5, 0.2, 0.1])
    votes = np.where(rng.random((20_000, 6)) < right, truth[:, None], ~truth[:, None])
    x = np.where(rng.random((20_000, 6)) < silent, 2, np.where(votes, 0, 1))
    patterns, at, n = np.unique(x, axis=0, return_inverse=True, return_counts=True)
    p, theta = pii.expectation_maximisation(patterns, n.astype(float))
    share = theta[0, :, 0] / (theta[0, :, 0] + theta[0, :, 1])
    assert np.abs(share - right).max() < 0.06 and (np.diff(share) < 0.02).all()
    majority = (x == 0).sum(1) - (x == 1).sum(1)
    by_vote = np.where(majority == 0, rng.random(20_000) < 0.5, majority > 0)
    assert ((p[at] > 0.5) == truth).mean() > (by_vote == truth).mean() + 0.01


def test_span_classifier_uses_what_votes_do_not_say():
    """Equal votes, but one word before the span goes with personal data: the classifier generalises from the kinds' soft labels."""
    keys = [(f"phone|{v}|__m|1--|{w}", c) for v, w, c in (("+++000", 1, 500), ("---000", 2, 500), ("000000", 1, 20), ("000000", 2, 20))]
    soft = pii.fit_label_model(keys)
    assert soft[keys[2][0]] == soft[keys[3][0]]
    w = pii.fit_span_classifier(keys, soft)
    score = {k: float(pii._features(k) @ w) for k, _ in keys}
    assert score[keys[2][0]] > score[keys[3][0]] and pii.accept(keys[0][0], w, 0.5) and not pii.accept(keys[1][0], w, 0.5)


def test_redact_keeps_columns(spark, docs):
    assert pii.redact_pii(docs.filter("1 = 0")).count() == 0
    twice = pii.redact_pii(docs.unionByName(docs))
    assert twice.count() == 2 * len(TEXTS) and twice.distinct().count() == docs.distinct().count()
    out = pii.redact_pii(docs)
    assert out.columns == docs.columns and out.count() == len(TEXTS)
    texts = [r["text"] for r in out.collect()]
    assert texts.count(None) == 1
    assert not any(t and ("a.34@mail7" in t or "04dbebab" in t or "4111 1111" in t) for t in texts)
    assert pii.redact_text("ab@c.de x", "email:0:7") == "<EMAIL> x"


BENCH = [(None, "null ids hit as well"), ("1", " ".join(f"w{i}" for i in range(20))), ("2", "Short one here"), ("3", None), (None, "the cat"), ("10", "..."), ("2", "short ONE here!"), ("9", "x " * 14)]


def brute_scan(text, bench, n=13):
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    w, hit, items = words(text), set(), set()
    for item, t in bench:
        b = words(t)
        size = min(n, len(b))
        if not size:
            continue
        for win in {tuple(b[k : k + size]) for k in range(len(b) - size + 1)}:
            for k in range(len(w) - size + 1):
                if tuple(w[k : k + size]) == win:
                    hit |= set(range(k, k + size))
                    items.add(item)
    return len(w), len(hit), sorted(items - {None})


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_decontamination_against_brute_force(spark, block_bytes):
    texts = [None, "", "short one here", "A short one, here; and " + BENCH[1][1].upper() + " tail" * 30, "x " * 40, "the cat", "so NULL ids hit as well, do they", " ".join(f"w{i}" for i in range(3, 16)), "w1 w2"] + TEXTS[4:]
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, _scan int")
    bench = spark.createDataFrame(BENCH, "item_id string, text string")
    got = {r["doc_id"]: r for r in decontaminate.contamination(docs, bench, block_bytes=block_bytes).collect()}
    for i, t in enumerate(texts):
        n, h, items = brute_scan(t, BENCH)
        r = got[i]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) == (n, h, len(items), decontaminate.digest_items(items)), (i, t)
        assert r["contaminated"] == (h > 0 and 20 * h >= n)
    assert decontaminate.contamination(docs, bench.filter("1 = 0")).filter("n_hit > 0 OR contaminated").count() == 0
    assert decontaminate.contamination(docs.filter("1 = 0"), bench).count() == 0
    kept = decontaminate.decontaminate(docs, bench, block_bytes=block_bytes)
    assert kept.columns == docs.columns
    ids = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert set(ids) == {i for i in got if not got[i]["contaminated"]}
    assert all(brute_scan(t, BENCH)[1] == 0 for t in ids.values())


def test_remove_words():
    assert decontaminate.remove_words("Keep this, drop THAT part now.", [2, 3, 4]) == "Keep this,  now."


def brute_rules(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    wins = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    inside = {k + j for k, w in enumerate(wins) if wins.count(w) > 1 for j in range(8)}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside)


def test_compression_rules(spark, docs):
    rng = random.Random(2)
    texts = [t for t in TEXTS if not t or len(t) < 3000] + ["\n".join(rng.choice(["a b c", "", " ", "d|e <f>", "a b c"]) for _ in range(30)) for _ in range(20)]
    texts += [" ".join(rng.choice("abc") for _ in range(60)) for _ in range(20)]
    own = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, kept int")
    got = {r["doc_id"]: r for r in compression.rules(own).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute_rules(t), t
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
        assert not (r["kept"] and r["base_failed"])
    noise = " ".join(base64.b64encode(rng.randbytes(60)).decode() for _ in range(200))
    prose = " ".join(rng.choice("the of cat runs slow quick house many tree river stone".split()) + str(k % 7) for k in range(900))
    verdict = {r["doc_id"]: r["kept"] for r in compression.rules(spark.createDataFrame([(0, noise), (1, prose), (2, "ab " * 900 + prose[:200])], "doc_id long, text string")).collect()}
    assert verdict == {0: False, 1: True, 2: False}
    assert compression.rules(empty(docs)).count() == 0


def test_token_counts(spark, docs):
    rng = random.Random(3)
    alpha = list(" \n\t\r\x0b\x1c  abAB'!?.1²é́日<|>İΣ") + ["<|endoftext|>", "'s", "'ll", "  ", "the", " token"]
    texts = TEXTS + ["".join(rng.choice(alpha) for _ in range(rng.randint(0, 40))) for _ in range(800)]
    own = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    lib = Tokenizer.from_file(public_tokenizers.path(tokens.BYTE_FILE))
    for r in tokens.count_tokens(own).collect():
        t = texts[r["doc_id"]] or ""
        n = len(lib.encode(t, add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(t.encode()), n, n > 1024), t
    assert tokens.count_tokens(empty(docs)).count() == 0
    words = Tokenizer.from_file(public_tokenizers.path(tokens.WORD_FILE))
    for t, data in zip(texts, tokens.word_encoder()([t or "" for t in texts])):
        assert np.frombuffer(data, "<u4").tolist() == words.encode(t or "", add_special_tokens=False).ids, t


def test_whole_tokens_are_proved():
    whole = tokens.prove_whole_tokens(public_tokenizers.path(tokens.BYTE_FILE))
    lib = Tokenizer.from_file(public_tokenizers.path(tokens.BYTE_FILE))
    assert len(whole) > 40_000 and all(len(lib.encode(s, add_special_tokens=False).ids) == 1 for s in sorted(whole)[::500])


def test_quality(spark, sf_dir, docs):
    table = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    out = quality.classify(table("documents"), table("labels")).toPandas()
    assert len(out) == 200 and out.score.between(0, 1).all()
    assert (out.predicted == (out.score >= 0.5)).all()
    assert (out.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in out.doc_id]).all()
    both = out.merge(table("labels").toPandas(), on="doc_id").query("held_out")
    assert (both.predicted == both.quality).mean() > 0.85
    again = quality.classify(table("documents").repartition(3), table("labels").withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1, F.col("quality")).otherwise(1 - F.col("quality"))))
    assert np.allclose(again.toPandas().sort_values("doc_id").score, out.sort_values("doc_id").score, atol=1e-6)  # held-out labels don't matter
    labels = spark.createDataFrame([(0, 1), (0, 0), (None, 1), (2, None)], "doc_id long, quality int")
    rows = quality.classify(docs, labels).collect()
    assert len(rows) == len(TEXTS) and all(0 <= r["score"] <= 1 for r in rows)
    assert quality.classify(docs, labels.filter("1 = 0")).filter("score <> 0.5").count() == 0
    assert quality.classify(empty(docs), labels).count() == 0
    assert quality.keep_good(docs, labels).columns == docs.columns


def test_cross_entropy(spark, docs):
    good, other = "alpha beta gamma delta " * 20, "omega psi chi phi " * 20
    rows = [(0, good), (1, other), (2, other), (3, None), (4, ""), (5, "alpha beta gamma"), (6, "omega psi chi")]
    own = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1), (0, 1), (1, 0), (None, 1)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in lm.score(own, labels).collect()}
    assert got[5]["score"] > got[6]["score"] and got[3]["score"] == got[4]["score"] == 0.0
    assert got[0]["n_words"] == 80 and abs(got[5]["score"] - (got[5]["background_loss"] - got[5]["target_loss"])) < 1e-12
    assert lm.score(empty(docs), labels).count() == 0
    assert lm.score(docs, labels).count() == len(TEXTS)
