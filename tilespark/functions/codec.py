"""The height-tile payload: 65 x 65 little-endian heights, a child byte and a mask.

An inflated tile has 8452 bytes (one mask byte) or 73987 (a mask of 256 x 256).
"""

import gzip
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

SIDE, CELLS = 65, 65 * 65
HEIGHT_BYTES = 2 * CELLS
SHORT, LONG = HEIGHT_BYTES + 2, HEIGHT_BYTES + 1 + 256 * 256
SW, SE, NW, NE = 1, 2, 4, 8
FLAGS = {"sw": SW, "se": SE, "nw": NW, "ne": NE}
SEA_LEVEL = 5000  # the code of 0 m
LAND, WATER = b"\x00", b"\x01"


def quantise(metres: Column) -> Column:
    """Fifths of a metre above -1000 m, in 32-bit floats, cut to 16 unsigned bits."""
    f = lambda v: F.lit(v).cast("float")
    code = ((metres.cast("float") + f(1000.0)) * f(5.0)).cast("double")
    return F.least(F.greatest(F.when(code >= 0, F.floor(code)).otherwise(F.ceil(code)), F.lit(0)), F.lit(65535)).cast("int")


def dequantise(code: Column) -> Column:
    return code / 5.0 - 1000.0


def has_children(children: Column) -> Column:
    return children != 0


def has_child(children: Column, which: str) -> Column:
    return children.bitwiseAND(F.lit(FLAGS[which])) == FLAGS[which]


def set_child(children: Column, which: str, on: bool = True) -> Column:
    return children.bitwiseOR(F.lit(FLAGS[which])) if on else children.bitwiseAND(F.lit(~FLAGS[which]))


def set_all_children(on: bool = True) -> Column:
    return F.lit(15 if on else 0)


def has_water_mask(mask: Column) -> Column:
    return F.octet_length(mask) > 1


def is_water(mask: Column) -> Column:
    return (F.octet_length(mask) == 1) & (F.hex(mask) == "01")


def is_land(mask: Column) -> Column:
    return (F.octet_length(mask) == 1) & (F.hex(mask) == "00")


def mask_booleans(mask: Column) -> Column:
    """One boolean per mask byte."""
    text = F.hex(mask)
    return F.transform(F.sequence(F.lit(0), F.octet_length(mask) - 1), lambda i: F.substring(text, 2 * i + 1, F.lit(2)) != "00")


def mask_kind(size: Column) -> Column:
    """``single``, ``grid`` or null when no tile has that many bytes."""
    return F.when(size == SHORT, "single").when(size == LONG, "grid")


def hex16(code: Column) -> Column:
    """A 16-bit number as four hex digits, low byte first."""
    return F.concat(F.lpad(F.hex(code.bitwiseAND(F.lit(255))), 2, "0"), F.lpad(F.hex(F.shiftright(code, 8)), 2, "0"))


def encode_raw(heights: Column, children: Column, mask: Column) -> Column:
    """The payload from an array of heights, by SQL functions only."""
    body = F.array_join(F.transform(heights, lambda h: hex16(h)), "")
    return F.unhex(F.concat(body, F.lpad(F.hex(children), 2, "0"), F.hex(mask)))


def raw_from_bytes(height_bytes: Column, children: Column, mask: Column) -> Column:
    """The payload from heights that are bytes already."""
    return F.concat(height_bytes, F.unhex(F.lpad(F.hex(children), 2, "0")), mask)


def _pack(cells: pa.Array, codes: pa.Array) -> pa.Array:
    out = []
    for i, h in zip(cells.to_pylist(), codes.to_pylist()):
        own = np.full(CELLS, SEA_LEVEL, "<u2")
        own[i] = h
        out.append(own.tobytes())
    return pa.array(out, pa.binary())


def pack_cells(cells: Column, codes: Column) -> Column:
    """Height bytes of a tile from arrays of cell numbers and codes; gaps are sea level."""

    @F.arrow_udf("binary")
    def pack(a: pa.Array, b: pa.Array) -> pa.Array:
        return _pack(a, b)

    return pack(cells, codes)


def gzip_bytes(raw: Column) -> Column:
    """Gzip without a time stamp, so equal tiles are equal files."""

    @F.arrow_udf("binary")
    def press(a: pa.Array) -> pa.Array:
        return pa.array([None if x is None else gzip.compress(x, 6, mtime=0) for x in a.to_pylist()], pa.binary())

    return press(raw)


def gunzip_bytes(data: Column) -> Column:
    @F.arrow_udf("binary")
    def inflate(a: pa.Array) -> pa.Array:
        return pa.array([None if x is None else zlib.decompress(x, 47) for x in a.to_pylist()], pa.binary())

    return inflate(data)


def unpack_heights(data: Column) -> Column:
    """Array of heights from height bytes."""

    @F.arrow_udf("array<int>")
    def read(a: pa.Array) -> pa.Array:
        return pa.array([None if x is None else np.frombuffer(x, "<u2").astype(np.int32) for x in a.to_pylist()], pa.list_(pa.int32()))

    return read(data)


def decode(raw: Column) -> Column:
    """Struct of heights (array), children and mask; an error for any other size."""

    @F.arrow_udf("heights array<int>, children int, mask binary")
    def read(a: pa.Array) -> pa.Array:
        heights, children, masks = [], [], []
        for x in a.to_pylist():
            if x is None or len(x) not in (SHORT, LONG):
                raise ValueError("a tile has 8452 or 73987 bytes")
            heights.append(np.frombuffer(x, "<u2", CELLS).astype(np.int32))
            children.append(x[HEIGHT_BYTES])
            masks.append(x[HEIGHT_BYTES + 1 :])
        return pa.StructArray.from_arrays([pa.array(heights, pa.list_(pa.int32())), pa.array(children, pa.int32()), pa.array(masks, pa.binary())], names=["heights", "children", "mask"])

    return read(raw)
