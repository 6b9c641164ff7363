"""Connected components of a large edge table, on the cluster.

Alternates the large-star and small-star steps of Kiveris et al. ("Connected
Components in MapReduce and Beyond", 2014): every node is tied to the smallest
node it knows of until each component is one star. A step takes the minimum per
node with a partially aggregated group-by and joins it back by (node, salt), so no task
holds a node's neighbours. Each round is written to the shared folder, which cuts the
lineage; only row counts and checksums reach the driver.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilespark.session import discard, materialise

MOST_ROUNDS = 60
#: Tasks over which the edges of one node are dealt.
SALTS = 16


def _with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """``edges`` with ``m`` of their node ``a``; a node's edges are dealt over SALTS tasks."""
    salted = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    own = edges.withColumn("s", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))
    return own.join(salted, (own.a == salted.k) & (own.s == salted.salt)).select("a", "b", "k", "m")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
    joined = _with_least(both, least)
    return joined.filter("b > a AND b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """``edges`` point from the larger node ``a`` to the smaller ``b``."""
    least = edges.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "k")
    joined = _with_least(edges, least)
    moved = joined.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select(F.col("k").alias("a"), F.col("m").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) -> (node, root): the smallest node of each component, for every node that has an edge.

    Loops are ignored, repeated edges and both directions are allowed, nulls are
    dropped. Without edges the result is empty.
    """
    start = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, before = materialise(start, "edges"), None
    rows = now.count()
    for _ in range(MOST_ROUNDS):
        step = _small_star(_large_star(now)).distinct()
        new = materialise(step, "stars", 2 * rows)
        state = new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).collect()[0]
        discard(now)
        now, rows = new, state[0]
        if before == tuple(state):
            break
        before = tuple(state)
    else:
        raise RuntimeError("the components did not settle")
    roots = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
