"""Session-level helpers: shared storage, code shipping and table access.

Everything here works through Spark's own readers and writers, so inputs and
the shared folder may live in any store that Spark can reach.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_SHIPPED = "_tilespark_shipped"

#: Rows and bytes of one Arrow batch: texts may be long, so both are bounded.
ARROW_ROWS = 500
ARROW_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per SparkContext.

    Python workers then import it wherever they run, whether or not the
    repository is on their path. Arrow batches are bounded as well.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    sc = spark.sparkContext
    if getattr(sc, _SHIPPED, False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="tilespark-")  # the driver serves the archive from here
    path = os.path.join(folder, "tilespark_code.zip")
    with zipfile.ZipFile(path, "w") as z:
        for d, _, names in os.walk(root):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(d, n)
                    z.write(full, os.path.join("tilespark", os.path.relpath(full, root)))
    sc.addPyFile(path)
    setattr(sc, _SHIPPED, True)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only a local session without the setting gets a temporary folder; on a
    cluster the setting is required.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="tilespark-shared-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/tilespark/{name}-{uuid.uuid4().hex}"


#: Rows of a file, and files, up to which a table of known size is written by fewer tasks.
FILE_ROWS, FEW_FILES = 250_000, 8


def materialise(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage.

    Where ``rows`` bounds its size and that is small, the table gets ``FEW_FILES`` files at most
    instead of one for each task. It carries its path as ``_tilespark_path`` for :func:`discard`.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    if rows is not None and rows < FEW_FILES * FILE_ROWS:
        df = df.repartition(1 + rows // FILE_ROWS)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tilespark_path = path
    return out


def discard(df: DataFrame) -> None:
    """Remove what :func:`materialise` wrote, once nothing reads it any more."""
    path = getattr(df, "_tilespark_path", None)
    if path:
        remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def as_uri(path: str) -> str:
    """``file:/x`` and plain paths as ``file:///x``; other URIs as they are."""
    if path.startswith("file:"):
        return "file:///" + path[5:].lstrip("/")
    return path if "://" in path else "file://" + os.path.abspath(path)


def open_store(uri: str):
    """The Arrow file system of a URI and the path in it, for tasks that write files."""
    from pyarrow import fs

    for hadoop in ("s3a://", "s3n://"):
        if uri.startswith(hadoop):
            uri = "s3://" + uri[len(hadoop) :]
    return fs.FileSystem.from_uri(uri)
