"""Benchmark decontamination by n-gram windows.

Every run of ``n`` consecutive words of a benchmark item is a window; an item of
fewer words (but not none) is one window. The windows are indexed by a hash of
their normalised words in a broadcast table; the scan of a document looks up its
token windows, verifies each hit word by word and marks the words inside.

The benchmark is broadcast in blocks of at most ``block_bytes`` of text, filled one by
one while the driver reads the items; a larger benchmark takes several scans whose hits
are united per document, and an item longer than a block goes on in the next one, with
``n - 1`` words in both. The index is a few flat arrays, about three bytes for each of
text, and the different words. Documents never shuffle their texts.

Edge cases: null texts have no words; items without words have no windows; words in the
windows of an item with a null id are hit, but the item can't be listed; repeated items
and documents count like any others, repeated ids of items once; very long texts are
scanned in parts of 100,000 windows. An empty benchmark hits nothing. Only the named
columns are read.
"""

import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilespark.llm.common import ascii_lower, fresh, per_text
from tilespark.session import ship

N = 13
BLOCK_BYTES = 32 << 20

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_SCHEMA = "n_words long, hits array<int>, items array<string>"


def words_of(text: str) -> list:
    return _WORD.findall(ascii_lower(text))


class WindowIndex:
    """Windows of a block of items (id or None, text): words as numbers, and sorted hashes of the windows of each length."""

    def __init__(self, items: list, n: int = N):
        self.vocab: dict = {}
        self.n = n
        self.ids = sorted({i for i, _ in items if i is not None})
        place = {i: k for k, i in enumerate(self.ids)} | {None: -1}
        lists = [np.fromiter((self.vocab.setdefault(w, len(self.vocab)) for w in words_of(t)), np.int32) for _, t in items]
        owner = np.array([place[i] for i, _ in items], np.int32)
        lengths = np.array([len(x) for x in lists], np.int64)
        first = np.cumsum(lengths) - lengths
        self.codes = np.concatenate([*lists, np.zeros(0, np.int32)])
        self.windows: dict = {}
        for size in sorted(set(np.minimum(lengths, n).tolist()) - {0}):
            own = np.flatnonzero(np.minimum(lengths, n) == size)
            count = lengths[own] - size + 1
            starts = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count - first[own], count)
            self.windows[size] = self._sorted(starts.astype(np.int32), np.repeat(owner[own], count), size)
        self.shortest = min(self.windows, default=0)

    def _sorted(self, starts, items, size):
        """(hashes, starts, items) by hash and item, equal windows of an item once."""
        h = _window_hash(self.codes, starts, size)
        order = np.lexsort((items, h))
        h, starts, items = h[order], starts[order], items[order]
        again = np.zeros(len(h), bool)
        again[1:] = (h[1:] == h[:-1]) & (items[1:] == items[:-1])
        for k in range(size):
            again[1:] &= self.codes[starts[1:] + k] == self.codes[starts[:-1] + k]
        return h[~again], starts[~again], items[~again]

    def scan(self, text: str):
        """Number of words, positions of hit words, ids of items found."""
        words = words_of(text)
        if not self.windows or len(words) < self.shortest:
            return len(words), (), ()
        codes = np.fromiter(map(self.vocab.get, words, _repeat_minus), np.int64, len(words))
        if (codes >= 0).sum() < self.shortest:
            return len(words), (), ()
        hit, found = np.zeros(len(words), bool), set()
        known = np.concatenate([[0], np.cumsum(codes >= 0)])
        for size, (hashes, places, items) in self.windows.items():
            starts = np.flatnonzero(known[size:] - known[:-size] == size) if len(words) >= size else ()
            if not len(starts):
                continue
            for part in np.array_split(starts, len(starts) // 100_000 + 1):
                h = _window_hash(codes, part, size)
                low = np.searchsorted(hashes, h)
                for k in np.flatnonzero(hashes[np.minimum(low, len(hashes) - 1)] == h):
                    high = low[k] + np.searchsorted(hashes[low[k] :], h[k], "right")
                    at = places[low[k] : high]
                    same = (self.codes[at[:, None] + np.arange(size)] == codes[part[k] : part[k] + size]).all(1)  # verifies the hit
                    if same.any():
                        found.update(items[low[k] : high][same].tolist())
                        hit[part[k] : part[k] + size] = True
        return len(words), np.flatnonzero(hit), [self.ids[k] for k in sorted(found - {-1})]


class _Repeat:
    def __iter__(self):
        return self

    def __next__(self):
        return -1


_repeat_minus = _Repeat()


def _window_hash(codes: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """Hash of ``size`` codes from each start."""
    h = np.zeros(len(starts), np.uint64)
    for k in range(size):
        h = (h ^ codes[starts + k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def _parts(item, text: str, limit: int, n: int):
    """(item, part, bytes): an item longer than ``limit`` in parts that share n - 1 words."""
    data = len(text.encode("utf-8", "surrogatepass"))
    if data <= limit:
        yield item, text, data
        return
    words = words_of(text)
    k = 0
    while k == 0 or k + n - 1 < len(words):
        stop, size = k, 0
        while stop < len(words) and (size < limit or stop < k + n):
            size += len(words[stop]) + 1
            stop += 1
        yield item, b" ".join(words[k:stop]).decode("utf-8", "replace"), size
        k = max(k + 1, stop - n + 1)


def benchmark_blocks(benchmark: DataFrame, item_col: str, text_col: str, n: int, block_bytes: int):
    """Lists of (item id as string, text) of at most ``block_bytes``, or of one part that shares n - 1 long words."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    block, size = [], 0
    for r in items.toLocalIterator():
        for item, text, data in _parts(r["item"], r["text"], block_bytes, n):
            if block and size + data > block_bytes:
                yield block
                block, size = [], 0
            block.append((item, text))
            size += data
    if block:
        yield block


def _scanner(index):
    def make():
        own = index.value

        def batch(texts):
            cols = list(zip(*map(own.scan, texts))) or [(), (), ()]
            return [list(c) for c in cols]

        return batch

    return make


def _indexes(docs: DataFrame, benchmark: DataFrame, item_col: str = "item_id", item_text_col: str = "text", n: int = N, block_bytes: int = BLOCK_BYTES) -> list:
    """A broadcast index for each block of the benchmark, one at least."""
    spark = docs.sparkSession
    ship(spark)
    found = [spark.sparkContext.broadcast(WindowIndex(items, n)) for items in benchmark_blocks(benchmark, item_col, item_text_col, n, block_bytes)]
    return found or [spark.sparkContext.broadcast(WindowIndex([], n))]


def _scanned(docs: DataFrame, indexes: list, text_col: str, mark: str) -> DataFrame:
    out, cols = docs, []
    for index in indexes:
        cols.append(fresh(out, "_part"))
        out = out.withColumn(cols[-1], per_text(_scanner(index), _SCHEMA).asNondeterministic()(F.col(text_col)))
    if len(cols) == 1:
        return out.withColumnRenamed(cols[0], mark)
    union = lambda f: F.array_sort(F.array_distinct(F.flatten(F.array(*(F.col(c)[f] for c in cols)))))
    return out.withColumn(mark, F.struct(F.col(cols[0])["n_words"].alias("n_words"), union("hits").alias("hits"), union("items").alias("items"))).drop(*cols)


def scan(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", mark: str = "_scan", **options) -> DataFrame:
    """``docs`` with a struct ``mark``: n_words, hits (places of hit words, rising), items (found, as sorted strings)."""
    return _scanned(docs, _indexes(docs, benchmark, **options), text_col, mark)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: int = 20, **options) -> DataFrame:
    """Per document: words, hit words, items found and the verdict (``share`` * hits >= words)."""
    own = scan(docs.select(F.col(id_col), F.col(text_col)), benchmark, text_col, **options)
    n_hit = F.size("_scan.hits").cast("long")
    return own.select(
        id_col,
        F.col("_scan.n_words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("_scan.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_scan.items", ",").cast("binary"), 256).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * share >= F.col("_scan.n_words"))).alias("contaminated"),
    )


def remove_words(text: str, hits: list) -> str:
    """``text`` without the hit words; each run of them goes with what stands between."""
    if not hits:
        return text
    data = text.encode("utf-8", "surrogatepass")
    spans = [m.span() for m in _WORD.finditer(data.lower())]
    out, done, k = [], 0, 0
    while k < len(hits):
        last = k
        while last + 1 < len(hits) and hits[last + 1] == hits[last] + 1:
            last += 1
        out.append(data[done : spans[hits[k]][0]])
        done = spans[hits[last]][1]
        k = last + 1
    return b"".join([*out, data[done:]]).decode("utf-8", "surrogatepass")


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", share: int = 20, **options) -> DataFrame:
    """Contaminated documents go; from the others the hit spans are removed. Columns stay as they are.

    Edge cases are those of the module's text; a null text stays null.
    """
    mark, clean = fresh(docs, "_scan"), fresh(docs, "_clean")
    indexes, own = _indexes(docs, benchmark, **options), docs
    if len(indexes) > 1:
        own = _scanned(docs, indexes, text_col, mark)

    def verdict(text, words, hits):
        gone = len(hits) > 0 and len(hits) * share >= words
        return gone, None if gone else remove_words(text, list(hits))

    def scan_and_cut():
        found = indexes[0].value
        return lambda texts: [list(c) for c in zip(*(verdict(t, *found.scan(t)[:2]) for t in texts))] or [[], []]

    def cut():
        return lambda texts, n, hits: [list(c) for c in zip(*map(verdict, texts, n, hits))] or [[], []]

    schema = "gone boolean, text string"
    done = per_text(scan_and_cut, schema).asNondeterministic()(F.col(text_col)) if own is docs else per_text(cut, schema, 3).asNondeterministic()(F.col(text_col), F.col(mark)["n_words"], F.col(mark)["hits"])
    return own.withColumn(clean, done).filter(~F.col(clean)["gone"]).withColumn(text_col, F.when(F.col(text_col).isNotNull(), F.col(clean)["text"])).select(*docs.columns)


def digest_items(items: list) -> str:
    """The digest of found items, for tests."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
