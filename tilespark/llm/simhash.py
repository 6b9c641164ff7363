"""SimHash near-duplicates by covering locality-sensitive hashing.

Every text gets a 64-bit SimHash of its word shingles. Equal fingerprints are
first grouped by a partially aggregated group-by, so only different ones go on.
They are compared by the covering masks of Pagh ("CoveringLSH", 2016): each bit
position gets a non-zero vector of ``radius + 1`` bits and table v keeps the
positions whose vector has an odd inner product with v. For any ``radius``
positions some v is orthogonal to all their vectors, so two fingerprints that
differ there agree in table v: no link within the radius is ever missed.

A bucket's members meet sorted in one stream and are compared in blocks; only
the links found go on, as a spanning forest of each bucket. A bucket of over
``bucket_rows`` members isn't compared there: its members pass on to the next
level, which splits each bucket by the covering masks of the bits that the bucket
leaves free, again without losing a pair. Half of the free bits go at each level,
so buckets end small. Links become components by star contraction on the cluster.

Edge cases: null, empty and space-only texts have the fingerprint zero and link
like any other; texts of fewer words than a shingle use all their words; repeated
rows and null ids give one output row each (a component of null ids only has a
null id); an empty table gives no rows.
"""

from typing import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilespark.llm.common import ascii_lower, fresh, per_text
from tilespark.llm.components import components
from tilespark.session import materialise, ship

SHINGLE, RADIUS, SEED, BITS = 4, 4, 42, 64
BUCKET_ROWS = 2048


def shingle_hashes(text: str, size: int = SHINGLE) -> np.ndarray:
    """Hashes of the text's shingles in order, repeats included; the empty string's for a text without words."""
    words = ascii_lower(text).split()
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([digest(b" ".join(words), SEED)], np.uint64)
    data = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths)
    starts = (ends - lengths)[: len(words) - size + 1].tolist()
    stops = (ends[size - 1 :] - 1).tolist()
    return np.array([digest(data[a:b], SEED) for a, b in zip(starts, stops)], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """Bit i is set when over half of the hashes have it set."""
    ones = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        part = np.unpackbits(hashes[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += part.sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str, size: int = SHINGLE) -> int:
    """The majority of the shingles' hashes, zero for a text without words."""
    return majority(shingle_hashes(text, size)) if text.strip(" \t\n\r\x0b\x0c") else 0


def _fingerprints(size):
    return lambda: lambda texts: [[signed(fingerprint(t, size)) for t in texts]]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def covering_masks(positions: list, radius: int = RADIUS) -> np.ndarray:
    """Masks over the given bit positions such that any ``radius`` positions are all left out of some mask.

    Vectors are dealt in turn over all non-zero values, which balances the masks.
    """
    width = radius + 1
    vectors = [1 + k % ((1 << width) - 1) for k in range(len(positions))]
    masks = []
    for v in range(1, 1 << width):
        m = 0
        for p, a in zip(positions, vectors):
            if (v & a).bit_count() & 1:
                m |= 1 << p
        masks.append(m)
    return np.array(sorted(set(masks)), np.uint64)


def _forest(fps: np.ndarray, radius: int, block: int = 512):
    """Links of a bucket's members that join different trees; pairs are compared block by block."""
    root = np.arange(len(fps))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(0, len(fps), block):
        for j in range(i, len(fps), block):
            near = np.bitwise_count(fps[i : i + block, None] ^ fps[None, j : j + block]) <= radius
            for a, b in zip(*np.nonzero(near)):
                a, b = a + i, b + j
                if a < b:
                    x, y = find(a), find(b)
                    if x != y:
                        root[max(x, y)] = min(x, y)
                        yield fps[a], fps[b]


def _compare(radius: int, bucket_rows: int):
    """Sorted (bucket, fp, free) rows -> links (a, b) and, for large buckets, rows for the next level."""

    def links(keys, fps):
        """All buckets in hand: pairs by vectorised comparison, larger ones by forest."""
        cut = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1])]) if len(keys) else np.array([], int)
        size = np.diff(np.r_[cut, len(keys)])
        two = cut[size == 2]
        near = np.bitwise_count(fps[two] ^ fps[two + 1]) <= radius
        a, b = [fps[two[near]]], [fps[two[near] + 1]]
        for c, n in zip(cut[size > 2], size[size > 2]):
            for x, y in _forest(fps[c : c + n], radius):
                a.append(np.array([x], np.uint64))
                b.append(np.array([y], np.uint64))
        return np.concatenate(a), np.concatenate(b)

    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("bucket", pa.int64()), ("free", pa.int64())])

    def rows(a, b, bucket=None, free=None):
        none = pa.nulls(len(a), pa.int64())
        cols = [pa.array(a.view(np.int64)), none if b is None else pa.array(b.view(np.int64)), none if bucket is None else pa.array(bucket), none if free is None else pa.array(free)]
        return pa.RecordBatch.from_arrays(cols, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (np.array([], np.int64), np.array([], np.uint64), np.array([], np.int64))
        over = None  # the large bucket that is passing through
        for batch in batches:
            new = (batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64), batch.column(2).to_numpy(zero_copy_only=False))
            k, f, m = (np.concatenate([x, y]) for x, y in zip(held, new))
            if not len(k):
                continue
            if over is not None:
                n = int(np.searchsorted(k != over, True)) if k[0] == over else 0
                if k[0] == over and k[-1] == over:
                    n = len(k)
                if n:
                    yield rows(f[:n], None, k[:n], m[:n])
                    k, f, m = k[n:], f[n:], m[n:]
                if len(k):
                    over = None
                else:
                    held = (k, f, m)
                    continue
            # the last bucket may go on in the next batch; large buckets that are complete pass through as well
            cut = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
            size = np.diff(np.r_[cut, len(k)])
            whole = np.repeat(size <= bucket_rows, size)
            last = np.zeros(len(k), bool)
            last[cut[-1] :] = True
            ready = whole & ~last
            if ready.any():
                a, b = links(k[ready], f[ready])
                if len(a):
                    yield rows(a, b)
            big = ~whole
            if big.any():
                yield rows(f[big], None, k[big], m[big])
            if size[-1] > bucket_rows:
                over = k[-1]
                held = (k[:0], f[:0], m[:0])
            else:
                held = (k[last], f[last], m[last])
        if len(held[0]):
            a, b = links(held[0], held[1])
            if len(a):
                yield rows(a, b)

    return run


def _tables(radius: int):
    """(bucket, fp, free bits) -> a row per covering table of the free bits."""
    masks: dict = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bucket, fp, free = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            for value in np.unique(free):
                at = free == value
                bits = int(value) & ((1 << 64) - 1)
                if bits not in masks:
                    masks[bits] = covering_masks([i for i in range(64) if bits >> i & 1], radius)
                own, was = fp[at].view(np.uint64), bucket[at].view(np.uint64)
                for mask in masks[bits]:
                    h = was * np.uint64(0x9E3779B97F4A7C15) + mask
                    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
                    h = ((own & mask) + h) * np.uint64(0x94D049BB133111EB)
                    h ^= h >> np.uint64(29)
                    left = np.full(len(own), np.uint64(bits) & ~mask, np.uint64).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(own.view(np.int64)), pa.array(left)], names=["bucket", "fp", "free"])

    return run


def links(fingerprints: DataFrame, radius: int = RADIUS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Links (a, b) that join all different fingerprints (column ``fp``) within the radius.

    Bucket keys are 64-bit hashes: two buckets that share one are compared
    together, which costs time but adds no link, as every link is verified.
    """
    spark = fingerprints.sparkSession
    ship(spark)
    level = fingerprints.select(F.lit(0).cast("long").alias("bucket"), "fp", F.lit(-1).cast("long").alias("free"))
    found = []
    while True:
        spread = level.mapInArrow(_tables(radius), "bucket long, fp long, free long")
        near = spread.repartition("bucket").sortWithinPartitions("bucket")
        out = materialise(near.mapInArrow(_compare(radius, bucket_rows), "a long, b long, bucket long, free long"), "links")
        found.append(out.filter("b IS NOT NULL").select("a", "b"))
        level = out.filter("b IS NULL").select("bucket", F.col("a").alias("fp"), "free")
        if level.isEmpty():
            break
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    return every


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """Fingerprint and component (its smallest id) of every document."""
    spark = docs.sparkSession
    ship(spark)
    fp = per_text(_fingerprints(shingle), "fp long")(F.col(text_col))["fp"]
    own = materialise(docs.select(F.col(id_col), fp.alias("fp")), "fingerprints")
    nodes = materialise(own.groupBy("fp").agg(F.min(id_col).alias("least")), "nodes")
    roots = materialise(components(links(nodes.select("fp"), radius)).withColumnRenamed("node", "fp"), "roots")
    tied = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    group = tied.groupBy("root").agg(F.min("least").alias("component_id"))
    names = materialise(tied.select("fp", "root").join(group, "root").select("fp", "component_id"), "names")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return own.join(names, "fp").select(id_col, hexed.alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row of each group of near-duplicates, columns as they are.

    The row with the smallest id stays; of repeated ids in one group one row
    stays, the one with the smallest text. A null id ranks after all others.
    Groups are settled on fingerprints alone. The last join is keyed by
    (fingerprint, id), so the members of a large group spread over all tasks.
    """
    spark = docs.sparkSession
    ship(spark)
    mark = fresh(docs, "_fp")
    fp = per_text(_fingerprints(shingle), "fp long")(F.col(text_col))["fp"]
    own = docs.withColumn(mark, fp)  # worked out again for the last join, which is cheaper than storing the texts
    nodes = materialise(own.groupBy(F.col(mark).alias("fp")).agg(F.min(id_col).alias("least")), "nodes")
    return keep_first(docs, own, mark, nodes, links(nodes.select("fp"), radius), id_col, text_col)


def keep_first(docs: DataFrame, own: DataFrame, mark: str, nodes: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row of each component of the links ``found``; ``own`` is ``docs`` with its node ``mark``, ``nodes`` has fp and least id.

    Rows meet their winner and each other by one key of (node, id), so texts are shuffled once.
    """
    roots = materialise(components(found).withColumnRenamed("node", "fp"), "roots")
    tied = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    # the fingerprint that holds a group's smallest id, ties by fingerprint
    rank = F.struct(F.col("least").isNull(), F.col("least"), F.col("fp"))
    winners = tied.groupBy("root").agg(F.min(rank).alias("r")).select(F.struct(F.col("r.fp").alias("node"), F.col("r.least").alias("id")).alias("_key"))
    keyed = own.select(F.struct(F.col(mark).alias("node"), F.col(id_col).alias("id")).alias("_key"), F.struct(*docs.columns).alias("_row"))
    kept = keyed.join(materialise(winners, "winners"), "_key", "left_semi")
    first = kept.groupBy("_key").agg(F.min_by("_row", F.coalesce(F.col("_row")[text_col], F.lit(""))).alias("_row"))
    return first.select(*(F.col("_row")[c].alias(c) for c in docs.columns))
