"""Quality classifier: random-indexing word vectors, pooled, and a two-layer network.

Random indexing (Kanerva et al., 2000): each word has a sparse ternary index vector,
which follows from a hash of it; its context vector is the sum of the index vectors
around all its occurrences in **all** documents. The words of two texts or more
of the labelled sample (the ``VOCABULARY`` most frequent of them, which is all of them unless
the sample is very large) have context vectors of their own; a classifier that is fitted on the sample
can know no others, so their number doesn't follow the corpus. All other words
share ``OTHERS`` hashed places. A task adds its documents up and the tables
are summed on the cluster. A document is the frequency-weighted mean and spread of
its words' vectors.

The network (one tanh layer, one logistic output) is trained in numpy on at most
``SAMPLE`` labelled rows, those with the smallest hash of their id; a fifth of
them only set the temperature that calibrates the probabilities. Labels, ids,
languages and sources are never inputs of a score.

Edge cases: null and empty texts pool to zeros and get a score like any other;
null labels are ignored, of repeated labels the mean decides; repeated ids give
one output row each; without any labels all scores are 0.5 and :func:`keep_good` keeps
every document, as nothing says that one is bad. Null ids count as
not held out and never train. An empty table gives no rows; very long texts are
counted in parts; columns of any other name pass through or aren't read.
"""

import re
import zlib
from collections import Counter
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilespark.llm.common import fresh, per_text, release, tidy
from tilespark.llm.sums import DDL, collect_sum, to_blocks
from tilespark.session import discard, materialise, ship

VOCABULARY, OTHERS, DIMS, NONZERO, REACH = 1 << 17, 8192, 32, 4, 2
#: Tokens that are counted at a time.
TOKENS = 400_000
SAMPLE, HIDDEN, EPOCHS, SEED = 20_000, 32, 60, 7

_TOKEN = re.compile(r"\w+|[^\w\s]+")


def index_vectors(words: list) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the non-zero entries of the index vectors of the words, then of the shared places."""
    seeds = np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words] + list(range(OTHERS)), np.uint64)
    seeds[len(words) :] += np.uint64(1 << 32)
    h = (seeds[:, None] * np.uint64(NONZERO) + np.arange(NONZERO, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((h >> np.uint64(40)) % np.uint64(DIMS)).astype(np.int32), np.where(h >> np.uint64(63), 1, -1).astype(np.int32)


class _Places:
    """Row of each word in the tables; other strings are hashed once, in a bounded table."""

    def __init__(self, words: list):
        self.words, self.seen = words, {w: k for k, w in enumerate(words)}

    def __call__(self, text: str) -> np.ndarray:
        words, size = _TOKEN.findall(text), len(self.words)
        if len(self.seen) > size + 50_000:
            self.seen = {w: k for k, w in enumerate(self.words)}
        seen = self.seen
        for w in {w for w in words if w not in seen}:
            seen[w] = size + zlib.crc32(w.encode("utf-8", "surrogatepass")) % OTHERS
        return np.fromiter(map(seen.__getitem__, words), np.int32, len(words))


def vocabulary(texts: DataFrame, size: int = VOCABULARY) -> list:
    """The words of two texts or more (column ``_text``) in order of their number of texts; ``size`` is the bound of what the driver gets.

    A word of one labelled text alone is like the new words of other texts, so it shares a place as they do.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        found: Counter = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                found.update(set(_TOKEN.findall(t or "")))
            if len(found) > 200_000:
                yield rows(found)
                found.clear()
        yield rows(found)
        tidy()

    def rows(found):
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])

    counted = texts.select("_text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter("n > 1")
    return counted.orderBy(F.desc("n"), "word").limit(size).select("word").toArrow()["word"].to_pylist()


def _count(shared):
    """Context vectors and word counts of a partition: a flat table of DIMS + 1 columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        words = shared.value
        at, sign = index_vectors(words)
        places, size = _Places(words), len(at)
        table, own = np.zeros(size * DIMS, np.int32), np.zeros(size, np.int64)
        gap = np.full(REACH, -1, np.int32)

        def add(lists):
            ids = np.concatenate([x for i in lists for x in (i, gap)])
            own[:] += np.bincount(ids[ids >= 0], minlength=size)
            for d in range(1, REACH + 1):
                both = (ids[d:] >= 0) & (ids[:-d] >= 0)
                for word, near in ((ids[d:][both], ids[:-d][both]), (ids[:-d][both], ids[d:][both])):
                    np.add.at(table, (word[:, None] * np.int32(DIMS) + at[near]).ravel(), sign[near].ravel())

        held, total = [], 0
        for b in batches:
            for t in b.column(0).to_pylist():
                held.append(places(t or ""))
                total += len(held[-1])
                if total >= TOKENS:
                    add(held)
                    held, total = [], 0
        if held:
            add(held)
        flat = np.concatenate([table.reshape(size, DIMS), own[:, None]], 1).ravel()
        del table, places
        yield from to_blocks(flat)
        tidy()

    return run


def word_vectors(docs: DataFrame, text_col: str, words: list) -> np.ndarray:
    """(words and shared places, 2 * DIMS + 1): context vector, own index vector, weight."""
    ship(docs.sparkSession)
    size = len(words) + OTHERS
    shared = docs.sparkSession.sparkContext.broadcast(words)  # VOCABULARY words at most
    flat = collect_sum(docs.select(text_col).mapInArrow(_count(shared), DDL), size * (DIMS + 1)).reshape(size, DIMS + 1)
    n = flat[:, DIMS].astype(np.float32)
    out = np.zeros((size, 2 * DIMS + 1), np.float32)
    out[:, :DIMS] = flat[:, :DIMS]
    del flat
    out[:, :DIMS] /= np.maximum(np.linalg.norm(out[:, :DIMS], axis=1, keepdims=True), 1e-9)
    at, sign = index_vectors(words)
    for k in range(NONZERO):
        out[np.arange(size), DIMS + at[:, k]] += sign[:, k] / NONZERO**0.5
    out[:, -1] = 1e-3 / (1e-3 + n / max(1.0, float(n.sum(dtype=np.float64))))
    return out


def pool(ids: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Plain mean, weighted mean and spread of the words' vectors."""
    width = vectors.shape[1] - 1
    if not len(ids):
        return np.zeros(2 * width + DIMS, np.float32)
    used, n = np.unique(ids, return_counts=True)
    v, share = vectors[used, :width], (n / len(ids)).astype(np.float32)
    w = share * vectors[used, width]
    mean = share @ v
    spread = np.sqrt(np.maximum(share @ v[:, :DIMS] ** 2 - mean[:DIMS] ** 2, 0))
    return np.concatenate([mean, (w @ v) / max(w.sum(), 1e-9), spread]).astype(np.float32)


class Network:
    """Standardised inputs, one tanh layer, one logistic output, a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, calibrate: np.ndarray):
        rng = np.random.default_rng(SEED)
        self.mean, self.std = x.mean(0), x.std(0) + 1e-6
        z = (x - self.mean) / self.std
        p = [rng.normal(0, 1 / len(z[0]) ** 0.5, (len(z[0]), HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / HIDDEN**0.5, HIDDEN), np.zeros(1)]
        m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
        learn = np.flatnonzero(~calibrate)
        for _ in range(EPOCHS):
            for part in np.array_split(rng.permutation(learn), max(1, len(learn) // 256)):
                h = np.tanh(z[part] @ p[0] + p[1])
                out = 1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30)))
                d = (out - y[part]) / max(1, len(part))
                back = d[:, None] * p[2] * (1 - h**2)
                grads = [z[part].T @ back + 1e-3 * p[0], back.sum(0), h.T @ d + 1e-3 * p[2], np.array([d.sum()])]
                step += 1
                for k, g in enumerate(grads):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    p[k] = p[k] - 0.005 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        self.p, self.temperature = p, 1.0
        rows = np.flatnonzero(calibrate)
        if len(rows):
            logit = self.logit(x[rows])
            loss = lambda t: np.logaddexp(0, -np.where(y[rows] > 0.5, 1, -1) * logit / t).mean()
            self.temperature = float(min(np.geomspace(0.25, 8, 61), key=loss))

    def logit(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.std
        return np.tanh(z @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3][0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -30, 30)))


def remainder(column):
    """crc32 of the id as text, mod 3 (null for a null id)."""
    return F.crc32(column.cast("string").cast("binary")) % 3


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", label_id: str = "doc_id", sample: int = SAMPLE) -> dict:
    """Word vectors from all documents, the network from a bounded sample of labelled rows."""
    spark = docs.sparkSession
    ship(spark)
    known = labels.select(F.col(label_id).alias("_id"), F.col(label_col).cast("double").alias("_y")).filter("_y IS NOT NULL AND _id IS NOT NULL").filter(remainder(F.col("_id")) != 1)
    known = known.groupBy("_id").agg(F.avg("_y").alias("_y")).orderBy(F.xxhash64("_id"), "_id").limit(sample)  # bounded: broadcast below
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(known), "_id")
    rows = materialise(rows.groupBy("_id").agg(F.min("_text").alias("_text"), F.min("_y").alias("_y")), "labelled")
    words = vocabulary(rows)
    model = {"vectors": spark.sparkContext.broadcast((words, word_vectors(docs, text_col, words))), "network": None}  # VOCABULARY + OTHERS rows at most
    shared = model["vectors"]

    def make():
        words, vectors = shared.value
        places = _Places(words)
        return lambda texts: [[pool(places(t), vectors).tolist() for t in texts]]

    got = rows.select("_id", "_y", per_text(make, "x array<float>")(F.col("_text"))["x"].alias("x")).toArrow().sort_by("_id")
    discard(rows)
    y = (got["_y"].to_numpy() >= 0.5).astype(float)
    if len(got):
        x = got["x"].combine_chunks().flatten().to_numpy().reshape(len(got), -1).astype(np.float64)
        calibrate = np.array([zlib.crc32(f"t{i}".encode()) % 5 == 0 for i in got["_id"].to_pylist()])
        model["network"] = Network(x, y, calibrate)
    return model


def scorer(model: dict):
    """An Arrow UDF of a text column: struct of ``score``."""
    network, shared = model["network"], model["vectors"]

    def make():
        words, vectors = shared.value
        places = _Places(words)

        def batch(texts):
            if network is None or not texts:
                return [[0.5] * len(texts)]
            return [network.score(np.stack([pool(places(t), vectors) for t in texts]).astype(np.float64)).tolist()]

        return batch

    return per_text(make, "score double")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Score and prediction of every document; ``held_out`` marks ids that never train."""
    model = fit(docs, labels, id_col, text_col, **options)
    own = docs.select(F.col(id_col), F.coalesce(remainder(F.col(id_col)) == 1, F.lit(False)).alias("held_out"), scorer(model)(F.col(text_col))["score"].alias("score"))
    return own.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, **options) -> DataFrame:
    """The documents scored at ``threshold`` or above, columns as they are."""
    model = fit(docs, labels, id_col, text_col, **options)
    mark = fresh(docs, "_quality")
    scored = docs.withColumn(mark, scorer(model).asNondeterministic()(F.col(text_col)))  # so the filter doesn't score again
    return scored.filter(F.col(mark)["score"] >= threshold).select(*docs.columns)
