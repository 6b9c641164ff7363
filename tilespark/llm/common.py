"""Shared plumbing of the llm operators."""

import ctypes
from typing import Iterator

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


def tidy() -> None:
    """Give freed memory back: a Python worker lives on for the next stages' tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:  # another C library
        pass


_held: list = []


def hold(clear) -> None:
    """Register what empties a table that outlives a task of its operator."""
    _held.append(clear)


def release() -> None:
    """Empty such tables: another operator's task begins in this Python worker."""
    for clear in _held:
        clear()


def per_text(make, schema: str, columns: int = 1):
    """An Arrow UDF over texts: ``make()`` runs once per task and returns ``f``.

    ``f(texts)`` gets a batch of texts (null becomes empty) and returns one
    list per field of ``schema``. With ``columns > 1`` it gets one list per
    argument column, where only the first is a text. Tables that other operators
    hold in the worker are emptied, unless ``make.holds`` says that they are its own.
    """
    fields = [to_arrow_type(x.dataType) for x in T.StructType.fromDDL(schema)]
    names = T.StructType.fromDDL(schema).names

    def apply(f, args):
        first = [x or "" for x in args[0].to_pylist()]
        cols = f(first, *(a.to_pylist() for a in args[1:]))
        return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(cols, fields)], names=names)

    def begin():
        if not getattr(make, "holds", False):
            release()
        return make()

    if columns == 1:

        def run(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
            f = begin()
            for a in it:
                yield apply(f, (a,))
            tidy()
    else:

        def run(it: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
            f = begin()
            for a in it:
                yield apply(f, a)
            tidy()

    return F.arrow_udf(schema)(run)


def ascii_lower(text: str) -> bytes:
    """UTF-8 bytes with only A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").lower()


def fresh(df, name: str) -> str:
    """``name``, or a longer one that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
