"""Cross-entropy difference of two n-gram models (Moore and Lewis, 2010).

Target and background model are matched: one vocabulary, one bigram table, one
interpolation. The background counts all documents, the target those that the
labels mark as good. Every different word and pair of words has counts of its own
(keys are 64-bit hashes), so the tables grow with the corpus and nothing is
broadcast: documents are taken in chunks, each chunk asks once for each of its
different keys, the key ranges (``PART_BYTES`` of text each) are summed on the
cluster, and the answers meet the chunk again. A frequent key comes once per chunk,
so no task holds its occurrences.

A document's score is the mean over its words of background loss minus target
loss (nats): higher is closer to the target. Both models leave the document itself
out: its own counts are taken off where it was counted, so a document labelled good
isn't scored by a target that knows it, and all scores are alike out of sample. The
background isn't cut down to the target's size: its counts grow with the corpus.

Edge cases: null, empty and space-only texts have no words, zero losses and score
zero; null labels and null ids never make a target; repeated labels count once;
repeated rows count like any others (a copy is no longer left out with its twin); an
empty target leaves both models equal in form, with the target uniform; an empty table
gives no rows; very long texts are chunks of their own; only the named columns are read.
"""

import functools
import pickle
import uuid
from typing import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tilespark.llm.common import ascii_lower, tidy
from tilespark.session import materialise, ship

#: Words among which the uniform part of both models is spread.
WORDS = 1 << 16
WEIGHTS = (0.6, 0.35, 0.05)  # bigram, unigram, uniform
#: Target ids that may be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 2_000_000
#: Words and rows after which a chunk is closed; bytes of text for each key range.
CHUNK_WORDS, CHUNK_ROWS, PART_BYTES = 1 << 20, 50_000, 32 << 20
_DDL = "chunk string, part int, data binary"
_NAMES, _TYPES = ["chunk", "part", "data", "n", "m"], [pa.string(), pa.int32(), pa.binary(), pa.int64(), pa.int64()]


def _gram_keys(hashes: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """64-bit keys of the pairs ``before * len(hashes) + word``."""
    a, b = hashes[codes // len(hashes)], hashes[codes % len(hashes)]
    h = (a * np.uint64(0x9E3779B97F4A7C15) + b) ^ np.uint64(0x2545F4914F6CDD1D)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


class _Chunk:
    """Documents whose words are numbered together; keys are those of all its words, then of all its pairs."""

    def __init__(self, idx: np.ndarray, lengths: np.ndarray, hashes: np.ndarray):
        self.idx, self.lengths = idx, lengths
        self.first = np.zeros(len(idx), bool)
        self.first[(np.cumsum(lengths) - lengths)[lengths > 0]] = True
        self.inner = np.flatnonzero(~self.first)
        codes, self.pair = np.unique(self.idx[self.inner - 1] * len(hashes) + self.idx[self.inner], return_inverse=True)
        self.words = len(hashes)
        self.keys = np.concatenate([hashes, _gram_keys(hashes, codes)])
        self.order = np.argsort(self.keys, kind="stable")

    def counts(self, weight=None) -> np.ndarray:
        """Occurrences of each key; with a weight per word, their sum."""
        pair = np.bincount(self.pair, None if weight is None else weight[self.inner], len(self.keys) - self.words)
        return np.concatenate([np.bincount(self.idx, weight, self.words), pair]).astype(np.int64)

    def own(self) -> tuple:
        """Occurrences of each word, and of each inner word's pair, in the word's own document."""
        doc = np.repeat(np.arange(len(self.lengths)), self.lengths)
        out = []
        for at, codes, size in ((doc, self.idx, self.words), (doc[self.inner], self.pair, len(self.keys) - self.words)):
            _, place, n = np.unique(at * max(1, size) + codes, return_inverse=True, return_counts=True)
            out.append(n[place])
        return out[0], out[1], self.lengths[doc]

    def means(self, counts: np.ndarray, total: int, left_out: np.ndarray) -> np.ndarray:
        """Mean loss of each document under the corpus's counts of the keys, less its own where ``left_out`` says so."""
        word, gram, size = (x * m for x, m in zip(self._own, (left_out, left_out[self.inner], left_out)))
        rest = np.maximum(total - size, 1)
        known = counts[self.idx] - word
        alone = known / rest
        pair = alone.copy()
        before = known[self.inner - 1].astype(np.float64)
        both = counts[self.words + self.pair] - gram
        pair[self.inner] = np.where(before > 0, both / np.maximum(before, 1), alone[self.inner])
        loss = -np.log(WEIGHTS[0] * pair + WEIGHTS[1] * alone + WEIGHTS[2] / WORDS)
        ends = np.concatenate([[0.0], np.cumsum(loss)])
        at = np.cumsum(self.lengths)
        return (ends[at] - ends[at - self.lengths]) / np.maximum(self.lengths, 1)

    @functools.cached_property
    def _own(self) -> tuple:
        return self.own()


def _parts(keys: np.ndarray, parts: int) -> np.ndarray:
    """Number of the key range of each key."""
    return ((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)


def _pack(values: np.ndarray) -> bytes:
    """64-bit integers, byte planes apart."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.astype("<i8", copy=False).view(np.uint8).reshape(-1, 8).T).tobytes())


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, -1).T).view("<i8").ravel()


def _pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as differences."""
    return _pack(np.diff(keys, prepend=np.uint64(0)).view(np.int64))


def _unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(_unpack(data).view(np.uint64), dtype=np.uint64)


def _rows(rows: list, names: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], names=names)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text, good) rows -> chunks of numbered words (part -1) with their numbers of words and target words."""
    ids, good, lengths, idx, seen, total = [], [], [], [], {}, 0

    def done():
        sizes = np.array(lengths, np.int64)
        hashes = np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in seen), np.uint64, len(seen))
        blob = pickle.dumps((ids, np.array(good, bool), sizes, _pack(np.concatenate(idx)), hashes))
        return _rows([(uuid.uuid4().hex, -1, blob, total, int(sizes[np.array(good, bool)].sum()))], _NAMES)

    for b in batches:
        for i, t, g in zip(*(b.column(x).to_pylist() for x in range(3))):
            words = ascii_lower(t or "").split()
            ids.append(i)
            good.append(g)
            lengths.append(len(words))
            idx.append(np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int32, len(words)))
            total += len(words)
            if total >= CHUNK_WORDS or len(ids) >= CHUNK_ROWS:
                yield done()
                ids, good, lengths, idx, seen, total = [], [], [], [], {}, 0
    if ids:
        yield done()
    tidy()


def _ask(parts: int):
    """Chunks -> their keys and counts in each key range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(*(b.column(x).to_pylist() for x in (0, 2))):
                _, good, sizes, idx, hashes = pickle.loads(data)
                c = _Chunk(_unpack(idx), sizes, hashes)
                keys, every, target = c.keys[c.order], c.counts()[c.order], c.counts(np.repeat(good.astype(float), sizes))[c.order]
                cut = np.searchsorted(_parts(keys, parts), np.arange(parts + 1, dtype=np.uint64))
                rows = []
                for p in np.flatnonzero(np.diff(cut)).tolist():
                    own = slice(cut[p], cut[p + 1])
                    rows.append((name, p, pickle.dumps((_pack_keys(keys[own]), _pack(every[own]), _pack(target[own])))))
                for k in range(0, len(rows), 500):
                    yield _rows(rows[k : k + 500], _NAMES[:3])
        tidy()

    return run


def _sum_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks sorted by part -> for each block the whole corpus's counts of its keys, in the block's order."""
    part, held = None, []

    def done():
        keys = np.concatenate([k for _, k, _, _ in held])
        values, at = np.unique(keys, return_inverse=True)
        every, target = (np.zeros(len(values), np.int64) for _ in range(2))
        start = 0
        for _, k, n, m in held:
            own = at[start : start + len(k)]
            start += len(k)
            np.add.at(every, own, _unpack(n))
            np.add.at(target, own, _unpack(m))
        start = 0
        for name, k, _, _ in held:
            own = at[start : start + len(k)]
            start += len(k)
            yield _rows([(name, part, pickle.dumps((_pack(every[own]), _pack(target[own]))))], _NAMES[:3])

    for b in batches:
        for name, p, data in zip(*(b.column(x).to_pylist() for x in range(3))):
            if p != part:
                if held:
                    yield from done()
                part, held = p, []
            keys, n, m = pickle.loads(data)
            held.append((name, _unpack_keys(keys), n, m))
    if held:
        yield from done()
    tidy()


def _score_chunks(totals: tuple, id_type: pa.DataType, id_col: str):
    """Rows sorted by (chunk, part), each chunk's documents first -> scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, blob, held = None, None, []

        def done():
            ids, good, sizes, idx, hashes = pickle.loads(blob)
            background = target = np.zeros(len(ids))
            if sizes.sum():
                c = _Chunk(_unpack(idx), sizes, hashes)
                found = np.concatenate([[_unpack(x) for x in pickle.loads(h)] for h in held], 1)
                counts = np.empty_like(found)
                counts[:, c.order] = found
                counted = (np.ones(sizes.sum(), bool), np.repeat(good, sizes))
                background, target = (np.where(sizes > 0, c.means(n, t, m), 0.0) for n, t, m in zip(counts, totals, counted))
            cols = [pa.array(ids, id_type), pa.array(sizes), pa.array(target), pa.array(background), pa.array(background - target)]
            yield pa.RecordBatch.from_arrays(cols, names=[id_col, "n_words", "target_loss", "background_loss", "score"])

        for b in batches:
            for name, p, data in zip(*(b.column(x).to_pylist() for x in range(3))):
                if name != chunk:
                    if chunk is not None:
                        yield from done()
                    chunk, blob, held = name, data, []
                else:
                    held.append(data)
        if chunk is not None:
            yield from done()
        tidy()

    return run


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", label_id: str = "doc_id") -> DataFrame:
    """Words, both mean losses and their difference for every document."""
    spark = docs.sparkSession
    ship(spark)
    good = labels.filter(F.col(label_col) == 1).select(F.col(label_id).alias("_id")).filter("_id IS NOT NULL").distinct().withColumn("_good", F.lit(True))
    if good.count() <= BROADCAST_ROWS:
        good = F.broadcast(good)
    own = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(good, "_id", "left").select("_id", "_text", F.coalesce("_good", F.lit(False)).alias("_good"))
    size = docs.agg(F.sum(F.octet_length(F.col(text_col)))).collect()[0][0] or 0
    parts = 8 + size // PART_BYTES
    held = materialise(own.mapInArrow(_chunks, _DDL + ", n long, m long"), "chunks")
    n, m = held.agg(F.sum("n"), F.sum("m")).collect()[0]
    chunks = held.select("chunk", "part", "data")
    asked = chunks.mapInArrow(_ask(parts), _DDL).repartition("part").sortWithinPartitions("part")
    both = chunks.unionByName(asked.mapInArrow(_sum_part, _DDL))
    kind = docs.schema[id_col].dataType
    out = f"`{id_col}` {kind.simpleString()}, n_words long, target_loss double, background_loss double, score double"
    return both.repartition("chunk").sortWithinPartitions("chunk", "part").mapInArrow(_score_chunks((n or 0, m or 0), to_arrow_type(kind), id_col), out)
