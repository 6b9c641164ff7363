"""Best-fit-decreasing packing, written as packed id matrices.

A task gathers documents until a block of ``block_tokens`` is full. Documents
longer than a row are split losslessly: full rows first, the rest is a piece like
any other. The pieces of a block are placed longest first, each into the row with
the least room that still holds it; a segment tree over the room sizes finds that
row in logarithmic time.

Each task writes, for its rows, the id matrix (16-bit, row-major, padded), the
cumulative segment lengths of each row and the places where positions start anew
together with the position there (a later piece of a document goes on counting).
Files are written under a temporary name, read back and checked, then renamed;
a repeated task writes equal files. The returned segments name file and row.

Edge cases: null and empty texts are documents of the separator alone; repeated
rows and null ids are packed like any others; an empty table gives no rows.
"""

import uuid
import zlib
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilespark.llm.common import tidy
from tilespark.llm.tokens import word_encoder
from tilespark.session import as_uri, open_store, scratch, ship

ROW, BLOCK_TOKENS, SEPARATOR, PAD = 2048, 1 << 20, 49407, 0


class RoomTree:
    """Rows by their room: ``take(n)`` gives a row with the least room of at least n."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.count = [0] * (2 * self.size)
        self.rows: list = [[] for _ in range(self.size)]

    def _change(self, room: int, by: int) -> None:
        k = room + self.size
        while k:
            self.count[k] += by
            k >>= 1

    def put(self, room: int, row: int) -> None:
        if room:
            self.rows[room].append(row)
            self._change(room, 1)

    def take(self, n: int):
        """(room, row), or None when no row has room for n."""
        k = n + self.size
        while not self.count[k]:
            while k & 1:
                k >>= 1
                if k <= 1:
                    return None
            if k == 0:
                return None
            k += 1
        while k < self.size:
            k = 2 * k if self.count[2 * k] else 2 * k + 1
        room = k - self.size
        self._change(room, -1)
        return room, self.rows[room].pop()


def best_fit_decreasing(lengths: list, row: int = ROW) -> list:
    """Row number of each piece; every length is between 1 and ``row``."""
    tree, out, rows = RoomTree(row), [0] * len(lengths), 0
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        found = tree.take(lengths[i])
        if found is None:
            found, rows = (row, rows), rows + 1
        out[i] = found[1]
        tree.put(found[0] - lengths[i], found[1])
    return out


def _pack_block(docs: list, row: int):
    """[(id, ids)] -> rows of pieces (id, start, ids, tokens of the document)."""
    pieces = []
    for doc_id, ids in docs:
        for k in range(0, len(ids), row):
            pieces.append((doc_id, k, ids[k : k + row], len(ids)))
    rows: dict = {}
    for p, r in zip(pieces, best_fit_decreasing([len(p[2]) for p in pieces], row)):
        rows.setdefault(r, []).append(p)
    return [rows[r] for r in sorted(rows)]


class _Files:
    """The three files of a task: written under temporary names, checked, renamed."""

    KINDS = ("ids", "lengths", "resets")

    def __init__(self, target: str, part: int):
        self.fs, base = open_store(target)
        self.fs.create_dir(base, recursive=True)
        self.names = {k: f"{base}/part-{part:06d}.{k}" for k in self.KINDS}
        mark = uuid.uuid4().hex
        self.temps = {k: f"{base}/_part-{part:06d}.{k}.{mark}.tmp" for k in self.KINDS}
        self.out = {k: self.fs.open_output_stream(t, compression=None) for k, t in self.temps.items()}
        self.crc = dict.fromkeys(self.KINDS, 0)

    def put(self, kind: str, data: bytes) -> None:
        self.out[kind].write(data)
        self.crc[kind] = zlib.crc32(data, self.crc[kind])

    def commit(self) -> None:
        for k in self.KINDS:
            self.out[k].close()
            crc = 0
            with self.fs.open_input_stream(self.temps[k], compression=None) as f:
                while data := f.read(1 << 20):
                    crc = zlib.crc32(data, crc)
            if crc != self.crc[k]:
                raise OSError(f"{self.temps[k]} reads back differently")
            self.fs.move(self.temps[k], self.names[k])


def write_matrix(docs: DataFrame, target: str, id_col: str = "doc_id", text_col: str = "text", encoder=word_encoder, separator: int = SEPARATOR, row: int = ROW, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Pack and write ``docs``; the segments (id, start, length, file, row, offset, ids_crc32, ...) are returned.

    Files appear when the result is computed; write it to commit. An id over 65535 is an error.
    ``lengths`` tells padding from ids, as the filler is the id 0.
    """
    ship(docs.sparkSession)
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = own.schema["doc_id"].dataType.simpleString()
    ddl = f"doc_id {kind}, start long, length long, doc_tokens long, file string, row long, sequence_id long, offset long, segment long, ids_crc32 long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        encode, files, number, block, held, schema = encoder(), None, 0, [], 0, None

        def flush():
            nonlocal number, block, held
            out = []
            for pieces in _pack_block(block, row):
                line, at = np.full(row, PAD, "<u2"), 0
                cuts, resets = [0], []
                for k, (doc_id, start, ids, total) in enumerate(pieces):
                    line[at : at + len(ids)] = ids
                    out.append((doc_id, start, len(ids), total, f"part-{part:06d}", number, (part << 32) + number, at, k, zlib.crc32(ids.tobytes())))
                    resets.append((at, start))
                    at += len(ids)
                    cuts.append(at)
                files.put("ids", line.tobytes())
                files.put("lengths", np.array([len(cuts), *cuts], "<u4").tobytes())
                files.put("resets", np.array([[len(resets), number], *resets], "<u4").tobytes())
                number += 1
            block, held = [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

        for b in batches:
            if schema is None:
                long, text = pa.int64(), pa.string()
                schema = pa.schema([("doc_id", b.schema.field(0).type), *((n, text if n == "file" else long) for n in "start length doc_tokens file row sequence_id offset segment ids_crc32".split())])
                files = _Files(target, part)
            texts = [t or "" for t in b.column(1).to_pylist()]
            for doc_id, data in zip(b.column(0).to_pylist(), encode(texts)):
                ids = np.append(np.frombuffer(data, "<u4"), np.uint32(separator))
                if ids.max() > 0xFFFF:
                    raise ValueError(f"token id {ids.max()} doesn't fit 16 bits")
                ids = ids.astype("<u2")
                block.append((doc_id, ids))
                held += len(ids)
                if held >= block_tokens:
                    yield flush()
        if files:
            if block:
                yield flush()
            files.commit()
        tidy()

    return own.mapInArrow(run, ddl)


def read_matrix(target: str, part: str, row: int = ROW):
    """(ids as rows, cumulative lengths per row, resets per row) of one part."""
    store, base = open_store(target)

    def load(kind):
        with store.open_input_stream(f"{base}/{part}.{kind}", compression=None) as f:
            return f.read()

    ids = np.frombuffer(load("ids"), "<u2").reshape(-1, row)
    flat, cuts, k = np.frombuffer(load("lengths"), "<u4"), [], 0
    while k < len(flat):
        cuts.append(flat[k + 1 : k + 1 + flat[k]])
        k += 1 + int(flat[k])
    flat, resets, k = np.frombuffer(load("resets"), "<u4").reshape(-1, 2), [], 0
    while k < len(flat):
        resets.append(flat[k + 1 : k + 1 + flat[k, 0]])
        k += 1 + int(flat[k, 0])
    return ids, cuts, resets


def packed(docs: DataFrame, **options) -> DataFrame:
    """Write the matrices to the shared folder; the segments come back from a committed table."""
    spark = docs.sparkSession
    target = as_uri(scratch(spark, "matrix"))
    out = write_matrix(docs, target, **options)
    out.write.parquet(f"{target}/_segments")
    return spark.read.schema(out.schema).parquet(f"{target}/_segments")
