"""Bounded-space online packing of token ids into fixed windows.

Each partition reads its documents as a stream and keeps ``open_windows``
windows. A document (its ids, then the separator) is cut into full windows
while it is longer than one; what is left goes into the open window with the
least room that still holds it whole (best fit). When none fits and all windows
are in use, the fullest is topped up with the start of the document and
emitted, so an emitted window has no padding. At the end of a partition its
open windows are merged into full ones, which leaves at most one short window;
those of up to ``merge_partitions`` partitions meet in one task that merges
them in the same way. The last short window of such a task is cut at powers of
two, which need no padding. Ids are never lost: each lies in exactly one piece.

Memory per task: one document and ``open_windows`` windows; a merging task reads
its short windows as a stream. Nothing is collected to the driver.

Edge cases: a null or empty text is a document of the separator alone; repeated
rows and null ids are packed like any others; an empty table gives no rows.
"""

import zlib
from typing import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilespark.llm.common import tidy
from tilespark.llm.tokens import word_encoder
from tilespark.session import materialise, ship

WINDOW = 4096
_ID_BYTES = 4


class Window:
    """Pieces in order: (id, start, ids as bytes, tokens of the document)."""

    __slots__ = ("pieces", "room")

    def __init__(self, size: int):
        self.pieces, self.room = [], size

    def add(self, doc_id, start, ids, total):
        self.pieces.append((doc_id, start, ids, total))
        self.room -= len(ids) // _ID_BYTES


class Packer:
    """The online packer; ``add`` and ``finish`` yield windows that are done."""

    def __init__(self, size: int = WINDOW, open_windows: int = 16):
        self.size, self.limit, self.open = size, open_windows, []

    def add(self, doc_id, start, ids, total) -> Iterator[Window]:
        while len(ids) // _ID_BYTES >= self.size:
            full = Window(self.size)
            full.add(doc_id, start, ids[: self.size * _ID_BYTES], total)
            start, ids = start + self.size, ids[self.size * _ID_BYTES :]
            yield full
        n = len(ids) // _ID_BYTES
        if not n:
            return
        best = min((w for w in self.open if w.room >= n), key=lambda w: w.room, default=None)
        if best is None:
            if len(self.open) < self.limit:
                best = Window(self.size)
                self.open.append(best)
            else:
                fullest = min(self.open, key=lambda w: w.room)
                cut = fullest.room
                fullest.add(doc_id, start, ids[: cut * _ID_BYTES], total)
                self.open.remove(fullest)
                yield fullest
                yield from self.add(doc_id, start + cut, ids[cut * _ID_BYTES :], total)
                return
        best.add(doc_id, start, bytes(ids), total)  # a copy, so the rest of the document isn't held
        if not best.room:
            self.open.remove(best)
            yield best

    def finish(self) -> Iterator[Window]:
        """Merge the open windows: full ones first, then at most one short one."""
        rest = sorted(self.open, key=lambda w: w.room)
        self.open = []
        while len(rest) > 1:
            top, last = rest[0], rest[-1]
            while top.room and last.pieces:
                doc_id, start, ids, total = last.pieces.pop()
                n = len(ids) // _ID_BYTES
                last.room += n
                if n > top.room:
                    keep = n - top.room
                    last.add(doc_id, start, ids[: keep * _ID_BYTES], total)
                    top.add(doc_id, start + keep, ids[keep * _ID_BYTES :], total)
                else:
                    top.add(doc_id, start, ids, total)
            if not top.room:
                yield rest.pop(0)
            if not last.pieces:
                rest.pop()
        if rest and rest[0].pieces:
            yield rest[0]


def powers_of_two(window: Window, size: int) -> Iterator[Window]:
    """Cut a short window at the binary digits of its length."""
    n = size - window.room
    pieces = list(reversed(window.pieces))
    for bit in range(n.bit_length() - 1, -1, -1):
        if n >> bit & 1:
            out = Window(1 << bit)
            while out.room:
                doc_id, start, ids, total = pieces.pop()
                cut = min(out.room, len(ids) // _ID_BYTES)
                out.add(doc_id, start, ids[: cut * _ID_BYTES], total)
                if len(ids) > cut * _ID_BYTES:
                    pieces.append((doc_id, start + cut, ids[cut * _ID_BYTES :], total))
            yield out


def _piece_schema(id_type: pa.DataType) -> pa.Schema:
    return pa.schema([("doc_id", id_type), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())])


class _Rows:
    """Numbers windows and gathers their pieces into Arrow batches."""

    def __init__(self, schema: pa.Schema, first_id: int, with_ids: bool, flush: int = 4096):
        self.schema, self.next, self.with_ids, self.flush, self.rows = schema, first_id, with_ids, flush, []

    def put(self, window: Window, final: bool = True):
        offset = 0
        for doc_id, start, ids, total in window.pieces:
            keep = bytes(ids) if self.with_ids or not final else None
            self.rows.append((doc_id, start, len(ids) // _ID_BYTES, zlib.crc32(ids), total, self.next if final else None, offset, keep))
            offset += len(ids) // _ID_BYTES
        self.next += final
        return self.take() if len(self.rows) >= self.flush else ()

    def take(self):
        if not self.rows:
            return ()
        cols, self.rows = list(zip(*self.rows)), []
        return (pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, self.schema)], schema=self.schema),)


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    encoder=word_encoder,
    separator: int = 2,
    window: int = WINDOW,
    open_windows: int = 16,
    merge_partitions: int = 64,
    with_ids: bool = False,
) -> DataFrame:
    """Pieces of all documents with their window (``sequence_id``) and place in it.

    ``with_ids`` adds the ids themselves (little-endian unsigned 32-bit).
    """
    spark = docs.sparkSession
    ship(spark)
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    end = int(separator).to_bytes(_ID_BYTES, "little")
    ddl = f"doc_id {own.schema['doc_id'].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer, rows = encoder(), Packer(window, open_windows), None
        number = TaskContext.get().partitionId() << 32
        for b in batches:
            rows = rows or _Rows(_piece_schema(b.schema.field(0).type), number, with_ids)
            texts = [t or "" for t in b.column(1).to_pylist()]
            for doc_id, own_ids in zip(b.column(0).to_pylist(), encode(texts)):
                ids = memoryview(own_ids + end)
                for w in packer.add(doc_id, 0, ids, len(ids) // _ID_BYTES):
                    yield from rows.put(w)
        if rows:
            for w in packer.finish():
                yield from rows.put(w, final=not w.room)
            yield from rows.take()
        tidy()

    packed = materialise(own.mapInArrow(first, ddl).withColumn("_group", F.when(F.col("sequence_id").isNull(), F.floor(F.spark_partition_id() / merge_partitions)).cast("long")).withColumn("_from", F.when(F.col("sequence_id").isNull(), F.spark_partition_id())), "packed")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, rows, group, numbers = Packer(window, open_windows), None, None, 0

        def close():
            for w in packer.finish():
                for done in powers_of_two(w, window) if w.room else (w,):
                    yield from rows.put(done)

        for b in batches:
            if rows is None:
                rows = _Rows(_piece_schema(b.schema.field(0).type), 0, with_ids)
            for r in b.to_pylist():
                if r["_group"] != group:
                    if group is not None:
                        yield from close()
                    group = r["_group"]
                    rows.next = (1 << 62) + (group << 32)
                    numbers += 1
                for w in packer.add(r["doc_id"], r["start"], r["ids"], r["doc_tokens"]):
                    yield from rows.put(w)
        if rows:
            yield from close()
            yield from rows.take()

    done = packed.filter("sequence_id IS NOT NULL").drop("_group", "_from")
    short = packed.filter("sequence_id IS NULL").repartition("_group").sortWithinPartitions("_group", "_from", "offset")
    out = done.unionByName(short.mapInArrow(merge, ddl))
    return out if with_ids else out.drop("ids")
