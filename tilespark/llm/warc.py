"""Deterministic sharded WARC writer and reader.

Pages are sorted by id range into shards whose borders come from exact byte
histograms (no sampling), so the same table always gives the same files however
Spark splits the work. Each shard is written as gzip members (one per record)
and rolls to a new file once ``roll_bytes`` of compressed data are in the
current one. Headers and digests are made anew from the payload.

A file is written under a temporary name and renamed; every attempt at a task
writes the same bytes, so a repeated task replaces its files by equal ones. The
manifest (a table of file, records, bytes and SHA-256) is written last, and only
files that it lists count: an archive without its manifest is not committed.

Of pages with equal payloads the one with the largest id is a ``response``; the
others are ``revisit`` records that carry no payload. Texts shuffle once, to their
shard; of the ``HOT`` most shared payloads only the keeper's text does.

Edge cases: a null html is an empty payload; null ids sort first and lose to any
other id; of several rows with the largest id the one with the largest url is the
response, of equal rows any one; null urls are empty; extra columns are not
read. An empty table gives an empty archive.
"""

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from typing import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilespark.session import as_uri, open_store, scratch, ship

SHARD_BYTES, ROLL_BYTES = 64 << 20, 24 << 20
BUCKETS = 2048
#: Most shared payloads whose other pages leave their text before the shuffle.
HOT = 1000
NO_ID = -(1 << 63)  # stands for a null id, below all others
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, file string, payload_ok boolean"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _http(size: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()


def record(page_id: int, url: str, payload: bytes | None, size: int, sha1: str, refers_to: tuple | None, copy: int) -> bytes:
    """One uncompressed record; without ``payload`` a revisit of ``refers_to`` (id, url). ``copy`` tells equal pages apart."""
    head = _http(size)
    block = head if payload is None else head + payload
    name = lambda i, u, c: uuid.uuid5(uuid.NAMESPACE_URL, f"page:{i}:{sha1}:{c}:{u}")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if payload is None else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{name(page_id, url, copy)}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {url.translate(_ONE_LINE)}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{sha1}",
        f"WARC-Block-Digest: sha1:{digest(block)}",
    ]
    if page_id != NO_ID:
        lines.append(f"Page-ID: {page_id}")
    if payload is None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:uuid:{name(*refers_to, 0)}>"]
        lines += [f"Refers-To-Page-ID: {refers_to[0]}"] if refers_to[0] != NO_ID else []
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"


_ONE_LINE = {10: " ", 13: " "}


def parse(stream: io.BufferedIOBase) -> Iterator[tuple[dict, bytes]]:
    """Records of an uncompressed WARC stream: headers (lower-case names) and block."""
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        headers = {}
        while (line := stream.readline()).strip():
            k, _, v = line.decode("utf-8").partition(":")
            headers[k.strip().lower()] = v.strip()
        size = int(headers["content-length"])
        block = stream.read(size)
        if len(block) != size:
            raise ValueError("a record is cut short")
        yield headers, block


class _Roller:
    """Writes the files of one shard, rolling by compressed size."""

    def __init__(self, target: str, shard: int, roll_bytes: int):
        self.fs, self.base = open_store(target)
        self.fs.create_dir(self.base, recursive=True)
        self.shard, self.roll, self.part, self.out = shard, roll_bytes, 0, None

    def put(self, data: bytes) -> list:
        if self.out is None:
            self.name = f"shard-{self.shard:06d}-{self.part:04d}.warc.gz"
            self.temp = f"{self.base}/_{self.name}.{uuid.uuid4().hex}.tmp"
            self.out, self.size, self.records, self.sha = self.fs.open_output_stream(self.temp, compression=None), 0, 0, hashlib.sha256()
        member = gzip.compress(data, 6, mtime=0)
        self.out.write(member)
        self.sha.update(member)
        self.size += len(member)
        self.records += 1
        return self.close() if self.size >= self.roll else []

    def close(self) -> list:
        if self.out is None:
            return []
        self.out.close()
        self.fs.move(self.temp, f"{self.base}/{self.name}")
        self.out, self.part = None, self.part + 1
        return [(self.name, self.shard, self.records, self.size, self.sha.hexdigest())]


_MANIFEST = "file string, shard long, records long, bytes long, sha256 string"


def _writer(target: str, roll_bytes: int):
    """Rows sorted by shard, id, digest and url, each key's mark (if any) before its pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller, shard, done, key, copy, mark = None, None, [], None, 0, None
        for b in batches:
            for r in b.to_pylist():
                if (r["p"], r["sha1"], r["url"]) != key:
                    key, copy, mark = (r["p"], r["sha1"], r["url"]), 0, None
                if r["mark"]:
                    mark = (r["top_p"], r["top_url"])
                    continue
                if r["shard"] != shard:
                    done += roller.close() if roller else []
                    shard = r["shard"]
                    roller = _Roller(target, shard, roll_bytes)
                sha1 = base64.b32encode(bytes.fromhex(r["sha1"])).decode()
                of = mark or ((r["p"], r["url"]) if copy else None)  # equal rows revisit the first of them
                payload = None if of else r["html"].encode("utf-8", "surrogatepass")
                if payload is not None and digest(payload) != sha1:
                    raise ValueError("the payload does not match its digest")
                done += roller.put(record(r["p"], r["url"], payload, r["size"], sha1, of, copy))
                copy += 1
        done += roller.close() if roller else []
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names=["file", "shard", "records", "bytes", "sha256"])

    return run


def _borders(sizes: DataFrame, shard_bytes: int) -> list:
    """Rising first ids of the shards, from exact histograms of bytes by id.

    A bucket of over ``shard_bytes`` is split again, down to single ids. The
    driver holds at most BUCKETS rows a histogram, and a border a shard.
    """
    low, high = sizes.agg(F.min("page_id"), F.max("page_id")).collect()[0]
    if low is None:
        return []
    heavy, cells = [(low, high)], []
    while heavy:
        again = []
        for a, b in heavy:
            width = -(-(b - a + 1) // BUCKETS)
            inside = sizes.filter(F.col("page_id").between(a, b))
            cell = F.floor((F.col("page_id").cast("decimal(20,0)") - F.lit(a)) / F.lit(width)).cast("long") if b - a >= 1 << 62 else F.expr(f"(page_id - ({a}L)) div {width}L")
            for r in inside.groupBy(cell.alias("k")).agg(F.sum("size").alias("bytes")).collect():
                start, stop = a + r["k"] * width, min(b, a + (r["k"] + 1) * width - 1)
                if r["bytes"] > shard_bytes and start < stop:
                    again.append((start, stop))
                else:
                    cells.append((start, r["bytes"]))
        heavy = again
    borders, filled = [], None
    for start, size in sorted(cells):
        if filled is None or filled + size > shard_bytes:
            borders.append(start)
            filled = 0
        filled += size
    return borders


def write_warc(pages: DataFrame, target: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write the archive to ``target`` (a URI that all executors reach) and commit its manifest, which is returned."""
    spark = pages.sparkSession
    ship(spark)
    keyed = pages.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("p"),
        F.coalesce(F.col(url_col), F.lit("")).alias("url"),
        F.coalesce(F.col(html_col), F.lit("")).alias("html"),
    )
    keyed = keyed.withColumn("sha1", F.sha1(F.col("html").cast("binary"))).withColumn("size", F.octet_length("html").cast("long"))
    slim = keyed.drop("html")
    groups = slim.groupBy("sha1", "size").agg(F.max(F.struct("p", "url")).alias("top"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = groups.select(F.col("sha1").alias("g_sha1"), F.col("size").alias("g_size"), F.col("top.p").alias("top_p"), F.col("top.url").alias("top_url"), "n")
    same_payload = (F.col("sha1") == F.col("g_sha1")) & (F.col("size") == F.col("g_size"))
    is_top = (F.col("p") == F.col("top_p")) & (F.col("url") == F.col("top_url"))
    # marks tell the writer which rows revisit another; they carry no payload
    marks = slim.join(shared, same_payload).filter(~is_top).select("p", "url", "sha1", "size", F.lit(None).cast("string").alias("html"), F.lit(True).alias("mark"), "top_p", "top_url")
    # the most shared payloads leave before the shuffle: at most HOT rows are broadcast
    hot = F.broadcast(shared.orderBy(F.desc("n"), "g_sha1").limit(HOT).drop("n"))
    bodies = keyed.join(hot, same_payload, "left").select("p", "url", "sha1", "size", F.when(F.col("g_sha1").isNull() | is_top, F.col("html")).alias("html"), F.lit(False).alias("mark"), F.lit(None).cast("long").alias("top_p"), F.lit(None).cast("string").alias("top_url"))
    rows = marks.unionByName(bodies)
    borders = _borders(slim.select(F.col("p").alias("page_id"), (F.col("size") + 400).alias("size")), shard_bytes)
    number = spark.sparkContext.broadcast(borders)  # a border for each shard_bytes of pages

    @F.pandas_udf("long")
    def shard_of(ids):
        import numpy as np
        import pandas as pd

        at = np.searchsorted(np.array(number.value, np.int64), ids.to_numpy(np.int64), side="right")
        return pd.Series(np.maximum(at, 1) - 1)

    rows = rows.withColumn("shard", shard_of("p"))
    shards = max(1, len(borders))
    dealt = rows.repartitionByRange(shards, "shard").sortWithinPartitions("shard", "p", "sha1", "url", F.desc("mark"))
    manifest_path = f"{target}/_manifest"
    dealt.mapInArrow(_writer(target, roll_bytes), _MANIFEST).write.parquet(manifest_path)
    return spark.read.schema(_MANIFEST).parquet(manifest_path)


def read_warc(spark: SparkSession, target: str) -> DataFrame:
    """Records of a committed archive, read from its files; digests are checked against the payloads."""
    ship(spark)
    manifest = spark.read.schema(_MANIFEST).parquet(f"{target}/_manifest")
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("file", pa.string()), ("payload_ok", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, sha256 in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                store, name = open_store(f"{target}/{path}")
                seen, rows = hashlib.sha256(), []
                with store.open_input_stream(name, compression=None) as raw:
                    for headers, block in parse(io.BufferedReader(_Gunzip(raw, seen), 1 << 20)):
                        head, _, payload = block.partition(b"\r\n\r\n")
                        sizes = [x.partition(b":")[2] for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")]
                        sha1 = headers["warc-payload-digest"].partition(":")[2]
                        kind = headers["warc-type"]
                        ok = kind == "revisit" or digest(payload) == sha1 and len(payload) == int(sizes[0])
                        number = lambda k: int(headers[k]) if k in headers else None  # noqa: E731, B023
                        rows.append((number("page-id"), int(sizes[0]), sha1, kind, number("refers-to-page-id"), headers["warc-target-uri"], path, ok))
                        if len(rows) == 2000:
                            yield _batch(rows, schema)
                            rows = []
                if seen.hexdigest() != sha256:
                    raise ValueError(f"{path} does not match the manifest")
                if rows:
                    yield _batch(rows, schema)

    files = manifest.select("file", "sha256").repartition(max(1, manifest.count()), "file")
    return files.mapInArrow(run, _RECORDS)


def _batch(rows, schema):
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


class _Gunzip(io.RawIOBase):
    """Reads concatenated gzip members with bounded memory and hashes the compressed bytes."""

    def __init__(self, raw, sha):
        self.raw, self.sha, self.left, self.z, self.ready = raw, sha, b"", zlib.decompressobj(31), b""

    def readable(self):
        return True

    def readinto(self, buffer):
        while not self.ready:
            if not self.left:
                self.left = self.raw.read(1 << 18)
                self.sha.update(self.left)
                if not self.left:
                    return 0
            if self.z.eof:
                self.z = zlib.decompressobj(31)
            self.ready = self.z.decompress(self.left, 1 << 20)
            self.left = self.z.unconsumed_tail or self.z.unused_data
        n = min(len(buffer), len(self.ready))
        buffer[:n] = self.ready[:n]
        self.ready = self.ready[n:]
        return n


def archive(pages: DataFrame, **options) -> DataFrame:
    """Write ``pages`` to a new archive in the shared folder and read it back."""
    target = as_uri(scratch(pages.sparkSession, "warc"))
    write_warc(pages, target, **options)
    return read_warc(pages.sparkSession, target)

