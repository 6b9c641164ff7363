"""Operator 5 at a given similarity: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Nodes are the different texts, by their 64-bit hash. Links are found in three steps, and
every one is verified on the shingles themselves, so none is wrong:

1. The covering masks of :mod:`simhash` link fingerprints of the shingle sets within
   ``RADIUS`` bits, as a spanning forest of each bucket: exact in bits, without all pairs.
2. A radius of 4 bits stands for a similarity of about 0.95; to reach 0.8 it would take
   about 18 of 64 bits and 2**19 tables. So the fingerprints are followed by MinHash
   bands: ``BANDS`` bands of ``ROWS`` minima, which a pair at 0.8 misses altogether with
   probability (1 - 0.8**5)**40 = 1.3e-7. A node is compared with one other: of the nodes that
   meet most others in a bucket, the one with which it shares most buckets.
3. Nodes in a bucket that still holds several components are open. Their shingles are
   put in one order, rare ones first (by a table of ``CELLS`` counts; any order gives the
   same result). Two sets at 0.8 share a shingle in the first fifth of both, and the first one
   that they share leaves room for the similarity behind it in both. Such pairs of
   different components are compared.
   So a crowd around one text costs as many rows as members, not as pairs.

Edge cases: null, empty and space-only texts are near copies of each other; texts
of fewer words than a shingle use all their words as one shingle; very long texts have
as many shingles as words, which lie in memory for one text at a time; of repeated rows
one stays; an empty table gives no rows; columns of any other name pass through.
"""

from typing import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilespark.llm import simhash, sums
from tilespark.llm.common import fresh, per_text, tidy
from tilespark.llm.components import components
from tilespark.session import discard, materialise, ship

SHINGLE, RADIUS, SEED = 5, 4, 42
#: Least similarity as a fraction.
NUM, DEN = 4, 5
BANDS, ROWS = 40, 5
CELLS = 1 << 21

_rng = np.random.default_rng(SEED)
_MUL = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)[:, None] | np.uint32(1)
_ADD = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)[:, None]


def shingles(text: str, size: int = SHINGLE) -> np.ndarray:
    """Sorted different hashes of the text's shingles."""
    return np.unique(simhash.shingle_hashes(text, size))


def bands(hashes: np.ndarray) -> bytes:
    """A 64-bit hash of each band's minima."""
    least = np.full(BANDS * ROWS, (1 << 32) - 1, np.uint32)
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    for k in range(0, len(short), 512):
        np.minimum(least, (short[k : k + 512] * _MUL + _ADD).min(1), out=least)
    rows = least.reshape(BANDS, ROWS)
    return b"".join(xxhash.xxh64_digest(r.tobytes(), k) for k, r in enumerate(rows))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return DEN * both >= NUM * (len(a) + len(b) - both)


def prefix(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first shingles in the order of ``counts``: any set at the least similarity has one of them among its own first."""
    order = np.lexsort((hashes, counts[(hashes % np.uint64(len(counts))).astype(np.int64)]))
    n = len(hashes)
    return hashes[order[: n - -(-n * NUM // DEN) + 1]]


def _text_hash(text_col: str):
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def _signatures():
    def batch(texts):
        sets = [shingles(t) for t in texts]
        return [[len(s) for s in sets], [simhash.signed(simhash.majority(s)) for s in sets], [np.frombuffer(bands(s), "<i8") for s in sets]]

    return batch


def _verify():
    def batch(left, right):
        return [[similar(shingles(a), shingles(b or "")) for a, b in zip(left, right)]]

    return batch


def _close(n, m):
    """Sizes that leave room for the least similarity."""
    return (DEN * F.least(n, m)) >= (NUM * F.greatest(n, m))


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) of nodes that are near copies; ``texts`` has k and t, once each."""
    count = pairs.count()
    left, right = (texts.select(F.col("k").alias(x), F.col("t").alias(f"t{x}")) for x in "ab")
    same = per_text(_verify, "same boolean", 2)(F.col("ta"), F.col("tb"))["same"]
    return materialise(pairs.join(left, "a").join(right, "b").select("a", "b", same.alias("same")).filter("same").select("a", "b"), "near", count)


def _texts(nodes: DataFrame, docs: DataFrame, text_col: str) -> DataFrame:
    """The texts of those nodes (column k), each once."""
    own = docs.select(_text_hash(text_col).alias("k"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    return materialise(own.join(nodes, "k", "left_semi").groupBy("k").agg(F.first("t").alias("t")), "texts")


def _roots(found: DataFrame, rows: int) -> DataFrame:
    return materialise(components(found).withColumnRenamed("node", "k"), "node_roots", rows)


def _fingerprint_pairs(nodes: DataFrame, rows: int) -> DataFrame:
    """Pairs (a, b) of nodes whose fingerprints are equal or linked by the covering masks."""
    least = materialise(nodes.groupBy("fp").agg(F.min("k").alias("rep")), "fingerprints", rows)
    found = simhash.links(least.select("fp"), RADIUS)
    reps = lambda x: least.select(F.col("fp").alias(x), F.col("rep").alias(f"r{x}"))
    far = found.select("a", "b").join(reps("a"), "a").join(reps("b"), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    same = nodes.join(least, "fp").filter("k <> rep").select(F.col("rep").alias("a"), F.col("k").alias("b"))
    return materialise(far.unionByName(same), "fingerprint_pairs", rows)


def _buckets(nodes: DataFrame, rows: int) -> DataFrame:
    """(bucket, k, a) of buckets with two nodes or more; ``a`` is the node there that meets most others in all its buckets."""
    each = nodes.select(F.posexplode("bands").alias("band", "h"), "k").select(F.xxhash64("band", "h").alias("bucket"), "k")
    several = each.groupBy("bucket").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    held = materialise(each.join(several, "bucket"), "buckets", BANDS * rows)
    known = held.groupBy("k").agg(F.sum("c").alias("met"))
    centre = held.join(known, "k").groupBy("bucket").agg(F.max_by("k", F.struct("met", "k")).alias("a"))
    return materialise(held.select("bucket", "k").join(centre, "bucket"), "centres", BANDS * rows)


def _count_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own = np.zeros(CELLS, np.int64)
    for b in batches:
        for t in b.column(0).to_pylist():
            np.add.at(own, (shingles(t) % np.uint64(CELLS)).astype(np.int64), 1)
    yield from sums.to_blocks(own)
    tidy()


def _open_pairs(nodes: DataFrame, texts: DataFrame, rows: int) -> DataFrame:
    """Pairs (a, b) of open nodes (k, root, n) of different components that may be near copies."""
    spark = nodes.sparkSession
    table = sums.collect_sum(texts.select("t").mapInArrow(_count_shingles, sums.DDL), CELLS)
    counts = spark.sparkContext.broadcast(np.minimum(table, 65535).astype(np.uint16))  # 2 * CELLS bytes

    def make():
        return lambda ts: [[prefix(shingles(t), counts.value).view(np.int64) for t in ts]]

    heads = materialise(texts.select("k", per_text(make, "head array<long>")(F.col("t"))["head"].alias("head")).join(nodes, "k"), "heads")
    each = heads.select(F.posexplode("head").alias("at", "token"), "k", "root", "n")
    roots = each.groupBy("token", "root").count().groupBy("token").agg(F.max_by("root", F.struct("count", "root")).alias("major"), F.count(F.lit(1)).alias("c")).filter("c > 1").select("token", "major")
    shared = materialise(each.join(roots, "token"), "shared_shingles", 20 * rows)
    minor = shared.filter("root <> major").select("token", *(F.col(c).alias(f"{c}_a") for c in ("k", "root", "n", "at")))
    all_ = shared.select("token", *(F.col(c).alias(f"{c}_b") for c in ("k", "root", "n", "at")))
    room = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b"))  # at the first shingle that both have, none before it is shared
    may = (F.col("root_a") != F.col("root_b")) & _close(F.col("n_a"), F.col("n_b")) & ((NUM + DEN) * room >= NUM * (F.col("n_a") + F.col("n_b")))
    met = minor.join(all_, (minor["token"] == all_["token"]) & may)
    out = materialise(met.select(F.least("k_a", "k_b").alias("a"), F.greatest("k_a", "k_b").alias("b")).distinct(), "open_pairs", rows)
    discard(heads)
    discard(shared)
    counts.unpersist()
    return out


def links(nodes: DataFrame, docs: DataFrame, text_col: str) -> DataFrame:
    """Verified links (a, b) that join all near copies; ``nodes`` has k, n (shingles), fp and bands."""
    count = nodes.count()
    near = _fingerprint_pairs(nodes.select("k", "fp"), count)
    rows = _buckets(nodes, count)
    sizes = nodes.select("k", "n")
    shared = rows.filter("k <> a").groupBy("k", "a").count()
    fits = shared.join(sizes, "k").join(sizes.select(F.col("k").alias("a"), F.col("n").alias("m")), "a").filter(_close(F.col("n"), F.col("m")))
    best = fits.groupBy("k").agg(F.max_by("a", F.struct("count", "a")).alias("a")).select("a", F.col("k").alias("b"))
    first = materialise(near.unionByName(best).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "first_pairs", count)
    compared = _texts(first.select(F.col("a").alias("k")).union(first.select("b")).distinct(), docs, text_col)
    found = _verified(first, compared)
    for t in (near, first, compared):
        discard(t)
    root = _roots(found, count)
    tied = rows.join(root, "k", "left").select("bucket", "k", F.coalesce("root", "k").alias("root"))
    mixed = tied.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("bucket")
    left = tied.join(mixed, "bucket", "left_semi").groupBy("k").agg(F.first("root").alias("root"))
    open_ = materialise(left.join(sizes, "k"), "open", count)
    discard(rows)
    texts = _texts(open_.select("k"), docs, text_col)
    pairs = _open_pairs(open_, texts, count)
    more = _verified(pairs, texts)
    for t in (root, open_, texts, pairs):
        discard(t)
    return found.unionByName(more)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near copies, chosen as in :func:`simhash.keep_one`."""
    ship(docs.sparkSession)
    mark = fresh(docs, "_fp")
    own = docs.withColumn(mark, _text_hash(text_col))
    sig = per_text(_signatures, "n long, fp long, bands array<long>")(F.col(text_col))
    signed = docs.select(_text_hash(text_col).alias("k"), F.col(id_col).alias("id"), sig.alias("s"))
    nodes = materialise(signed.groupBy("k").agg(F.min("id").alias("least"), F.first("s").alias("s")).select("k", "least", "s.*"), "nodes")
    return simhash.keep_first(docs, own, mark, nodes.select(F.col("k").alias("fp"), "least"), links(nodes, docs, text_col), id_col, text_col)
