"""Operators that join, write or pack, against brute force and round trips."""

import base64
import gzip
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tilespark.llm import components, matrix, packing, simhash, tokens, warc
from tilespark.session import as_uri, ship


def near_texts():
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(500)]
    base = [" ".join(rng.choice(vocab) for _ in range(rng.randint(60, 300))) for _ in range(12)]
    out = [None, "", " \n", "one two", "ONE two", "one two three four", "x y z q"]
    for b in base:
        out.append(b)
        for _ in range(6):
            w = b.split()
            for _ in range(rng.choice([0, 1, 1, 2])):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            out.append(" ".join(w).upper() if rng.random() < 0.3 else " ".join(w))
    return out


def brute_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ")
    words = [w for w in words if w]
    if not words:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(words[k : k + 4]).encode(), 42) for k in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps, ids, radius=4):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    low = {}
    for i, d in enumerate(ids):
        r = find(i)
        low[r] = d if low.get(r) is None else low[r] if d is None else min(low[r], d)
    return [low[find(i)] for i in range(len(fps))]


def test_simhash_against_brute_force(spark):
    texts = near_texts()
    ids = [900 - 3 * i for i in range(len(texts))]
    docs = spark.createDataFrame([(d, t, "f", 1) for d, t in zip(ids, texts)], "doc_id long, text string, fingerprint string, _fp int")
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    fps = [brute_fingerprint(t) for t in texts]
    want = brute_components(fps, ids)
    assert len(got) == len(texts) and len(set(want)) < len(texts) - 20
    for d, f, c in zip(ids, fps, want):
        assert (got[d]["fingerprint"], got[d]["component_id"]) == (f"{f:016x}", c)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want))


def test_simhash_nulls_and_repeats(spark):
    docs = spark.createDataFrame([(None, "same text here now ok"), (5, "same text here now ok"), (5, "same text here now ok"), (None, "lonely words of its own kind"), (7, None), (8, "")], "doc_id long, text string")
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == 6
    assert {r["component_id"] for r in rows if r["doc_id"] == 5} == {5} and {r["component_id"] for r in rows if r["doc_id"] in (7, 8)} == {7}
    assert sorted(str(r["doc_id"]) for r in simhash.keep_one(docs).collect()) == ["5", "7", "None"]
    assert simhash.near_duplicates(docs.filter("1 = 0")).count() == 0 and simhash.keep_one(docs.filter("1 = 0")).count() == 0


@pytest.mark.parametrize("bucket_rows", [2048, 20])
def test_links_lose_nothing_in_large_buckets(spark, bucket_rows):
    rng = random.Random(6)
    center = rng.getrandbits(64)
    f = sorted({center ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for _ in range(300)} | {rng.getrandbits(64) for _ in range(100)})
    ship(spark)
    got = [(r["a"] % 2**64, r["b"] % 2**64) for r in simhash.links(spark.createDataFrame([(simhash.signed(x),) for x in f], "fp long").repartition(3), bucket_rows=bucket_rows).collect()]
    assert all((a ^ b).bit_count() <= 4 for a, b in got)
    want = brute_components(f, f)
    root = {x: x for x in f}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in got:
        root[max(find(a), find(b))] = min(find(a), find(b))
    assert [find(x) for x in f] == want


def test_covering_masks_cover():
    rng = random.Random(1)
    for bits in (64, 32, 9):
        masks = [int(m) for m in simhash.covering_masks(list(range(bits)))]
        for _ in range(2000):
            d = sum(1 << b for b in rng.sample(range(bits), 4))
            assert any(m & d == 0 for m in masks)


def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(k, k + 1) for k in range(1000, 1060)] + [(5000, 5000 + k) for k in range(1, 40)] + [(None, 3), (7, 7)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in list(root)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def pages_fixture(spark):
    rng = random.Random(8)
    rows = [(i, f"http://h/{i}\r\nX: y", rng.choice([None, "", "<p>é</p>", "same" * 300, f"<b>{i}</b>" * 50]), i) for i in range(400)]
    rows += [(399, "http://again", "same" * 300, 0), (399, "http://again", "same" * 300, 0), (None, None, "lost", 0), (None, "u", "same" * 300, 1), (-5, "u", None, 1)]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string, record_type int")


def test_warc_round_trip(spark, tmp_path):
    rows, pages = pages_fixture(spark)
    target = as_uri(str(tmp_path / "a"))
    manifest = warc.write_warc(pages.repartition(5), target, shard_bytes=20_000, roll_bytes=1500)
    assert manifest.count() > 5 and manifest.agg(F.sum("records")).collect()[0][0] == len(rows)
    got = warc.read_warc(spark, target).collect()
    assert len(got) == len(rows) and all(r["payload_ok"] for r in got)
    top = {}
    for i, _, h, _ in rows:
        top[h or ""] = max(top.get(h or "", -(10**9)), -(10**9) if i is None else i)
    responses = [r for r in got if r["record_type"] == "response"]
    assert len(responses) == len(top)
    by_digest = {base64.b32encode(hashlib.sha1(h.encode()).digest()).decode(): (i, len(h.encode())) for h, i in top.items()}
    for r in got:
        i, n = by_digest[r["payload_digest"]]
        assert r["payload_bytes"] == n
        if r["record_type"] == "response":
            assert (r["page_id"] if r["page_id"] is not None else -(10**9)) == i and r["refers_to"] is None
        else:
            assert r["refers_to"] == i
    # equal files from another layout of the same rows, when no ids are tied
    plain = pages.filter("page_id < 399")
    shas = []
    for k, n in enumerate((1, 7)):
        t = as_uri(str(tmp_path / f"b{k}"))
        shas.append(sorted((r["file"], r["sha256"]) for r in warc.write_warc(plain.repartition(n), t, shard_bytes=20_000, roll_bytes=1500).collect()))
    assert shas[0] == shas[1]
    name = manifest.collect()[0]["file"]
    data = (tmp_path / "a" / name).read_bytes()
    assert gzip.decompress(data).startswith(b"WARC/1.1\r\n") and not list((tmp_path / "a").glob("*.tmp"))
    assert warc.archive(pages.filter("1 = 0")).count() == 0


def ids_of(text):
    return Tokenizer.from_file(public_tokenizers.path(tokens.WORD_FILE)).encode(text or "", add_special_tokens=False).ids


def packing_docs(spark):
    rng = random.Random(12)
    texts = [None, "", "one", "word " * 9000, "<|endoftext|> x"] + [" ".join(rng.choice("the of cat running slowly, quick!".split()) for _ in range(rng.randint(1, 900))) for _ in range(60)]
    return texts, spark.createDataFrame([(i, t, 3) for i, t in enumerate(texts)], "doc_id long, text string, start int").repartition(3)


def test_packing_loses_no_id(spark):
    texts, docs = packing_docs(spark)
    lib = Tokenizer.from_file(public_tokenizers.path(tokens.WORD_FILE))
    want = {i: lib.encode(t or "", add_special_tokens=False).ids + [2] for i, t in enumerate(texts)}
    rows = packing.pack(docs, open_windows=4, merge_partitions=2, with_ids=True).collect()
    seen, windows = {}, {}
    for r in rows:
        ids = np.frombuffer(r["ids"], "<u4")
        assert ids.tolist() == want[r["doc_id"]][r["start"] : r["start"] + r["length"]] and zlib.crc32(r["ids"]) == r["ids_crc32"]
        assert r["doc_tokens"] == len(want[r["doc_id"]]) and r["length"] == len(ids)
        seen.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, ids in want.items():
        at = 0
        for s, n in sorted(seen[i]):
            assert s == at
            at += n
        assert at == len(ids)
    for w in windows.values():
        at = 0
        for o, n in sorted(w):
            assert o == at
            at += n
        assert at == 4096 or at & (at - 1) == 0
    assert packing.pack(docs.filter("1 = 0")).count() == 0
    nulls = spark.createDataFrame([(None, "a b"), (None, "a b")], "doc_id string, text string")
    assert packing.pack(nulls).agg(F.sum("length")).collect()[0][0] == 6


def test_best_fit_decreasing_matches_plain_search():
    rng = random.Random(3)
    for _ in range(40):
        row = rng.choice([16, 100, 2048])
        lengths = [rng.randint(1, row) for _ in range(rng.randint(0, 200))]
        rows = matrix.best_fit_decreasing(lengths, row)
        room = []
        for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
            fit = min((r for r in room if r >= lengths[i]), default=None)
            if fit is None:
                room.append(row - lengths[i])
            else:
                room[room.index(fit)] -= lengths[i]
        used = {}
        for n, r in zip(lengths, rows):
            used[r] = used.get(r, 0) + n
        assert all(n <= row for n in used.values()) and sorted(row - n for n in used.values()) == sorted(room)


def test_matrix_round_trip(spark, tmp_path):
    texts, docs = packing_docs(spark)
    lib = Tokenizer.from_file(public_tokenizers.path(tokens.WORD_FILE))
    want = {i: lib.encode(t or "", add_special_tokens=False).ids + [matrix.SEPARATOR] for i, t in enumerate(texts)}
    target = as_uri(str(tmp_path / "m"))
    segments = matrix.write_matrix(docs, target, row=512, block_tokens=4000).collect()
    files = {s["file"]: matrix.read_matrix(target, s["file"], 512) for s in segments}
    got = {}
    for s in segments:
        ids, cuts, resets = files[s["file"]]
        line, cut = ids[s["row"]], cuts[s["row"]]
        k, a = s["segment"], s["offset"]
        assert cut[k] == a and cut[k + 1] == a + s["length"] and tuple(resets[s["row"]][k]) == (a, s["start"])
        part = line[a : a + s["length"]]
        assert zlib.crc32(part.tobytes()) == s["ids_crc32"] and (line[cut[-1] :] == matrix.PAD).all()
        got.setdefault(s["doc_id"], []).append((s["start"], part.tolist()))
    assert {i: [x for _, p in sorted(v) for x in p] for i, v in got.items()} == want
    assert not list((tmp_path / "m").glob("*.tmp"))
    assert matrix.packed(docs.filter("1 = 0")).count() == 0
