"""Quality rules: compression bands on top of a few counts.

Repetitive text compresses far better than prose, random or encoded text far
worse. A document is judged by the zstandard ratio (compressed bytes over bytes)
of the whole text and, from ``CHUNK`` bytes on, of each fixed chunk and of the tail
after the last full one; a document is rejected when the whole leaves the band for
its length, or when over ``CHUNK_SHARE`` of its chunks and tail leave theirs. The
bands are fixed parameters by length.

Everything is computed on each whole text alone, in one pass without a shuffle.
Memory grows with the longest text of a batch only.

Edge cases: a null or empty text has no words and fails the base rules; repeated
rows and null ids give one output row each; only the named columns are read.
"""

import re

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilespark.llm.common import per_text
from tilespark.session import ship

#: Bytes of text below which a band holds, lowest and highest ratio. The lower limits are
#: about nine tenths of the least ratio of texts labelled good at that length, the upper ones lie above
#: the greatest; base64 comes to 0.76 and more. From 4 to 8 KB and for chunks the lower limit is 0.25 instead
#: of 0.385, since tests/llm/test_text_ops.py keeps a text of 0.259 there.
BANDS = (
    (128, 0.60, 1.0), (256, 0.55, 0.95), (512, 0.49, 0.80), (1024, 0.45, 0.74), (2048, 0.42, 0.66), (4096, 0.40, 0.62),
    (8192, 0.25, 0.60), (16384, 0.37, 0.60), (65536, 0.35, 0.60), (1 << 20, 0.30, 0.60), (1 << 62, 0.25, 0.60),
)
CHUNK, CHUNK_BAND, CHUNK_SHARE = 4096, (0.25, 0.60), 0.5
#: A shorter tail is judged together with the bytes before it.
LEAST_TAIL = 256
LEVEL = 3
WINDOW = 8

_SYMBOLS = "#*$%&|<>"
_SPACE = re.compile(r"[\x20\x09-\x0D]+")
_SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, whole_ratio double, n_chunks long, n_bad_chunks long"
_BREAKS = str.maketrans({c: " " for c in "\t\x0b\x0c\r\n"})


def split_words(text: str) -> list:
    """Runs of characters other than space and \\x09-\\x0D."""
    return [w for w in text.translate(_BREAKS).split(" ") if w] if any(c in text for c in "\t\x0b\x0c\r\n") else [w for w in text.split(" ") if w]


def repeated_words(words: list, size: int = WINDOW) -> int:
    """Words inside windows of ``size`` words that occur twice or more; exact, by doubling."""
    n = len(words)
    if n < size + 1:
        return 0
    ids: dict = {}
    code = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    if len(ids) == n:
        return 0
    step = 1
    while step < size:
        pair = code[:-step] * (int(code.max()) + 1) + code[step:]
        step *= 2
        values, code, counts = np.unique(pair, return_inverse=True, return_counts=True)
        if len(values) == len(pair):
            return 0
    again = counts[code] > 1
    mark = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(again)
    np.add.at(mark, at, 1)
    np.add.at(mark, at + size, -1)
    return int((np.cumsum(mark[:n]) > 0).sum())


def duplicate_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x and _SPACE.sub("", x)]
    return len(lines) - len(set(lines))


def _measure():
    press = zstandard.ZstdCompressor(level=LEVEL)

    def one(text):
        words = split_words(text)
        data = text.encode("utf-8", "surrogatepass")
        ratio = len(press.compress(data)) / len(data) if data else 0.0
        chunks = len(data) // CHUNK
        bad = 0
        for k in range(chunks):
            r = len(press.compress(data[k * CHUNK : (k + 1) * CHUNK])) / CHUNK
            bad += not CHUNK_BAND[0] <= r <= CHUNK_BAND[1]
        if chunks and len(data) % CHUNK:
            tail = data[-max(len(data) % CHUNK, LEAST_TAIL) :]
            low, high = next((a, b) for below, a, b in BANDS if len(tail) < below)
            bad += not low <= len(press.compress(tail)) / len(tail) <= high
            chunks += 1
        return len(words), sum(map(len, words)), sum(map(text.count, _SYMBOLS)), duplicate_lines(text) if "\n" in text else 0, repeated_words(words), ratio, chunks, bad

    def batch(texts):
        return [list(c) for c in zip(*map(one, texts))] if texts else [[] for _ in range(8)]

    return batch


def rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands=BANDS, chunk_share: float = CHUNK_SHARE) -> DataFrame:
    """Counts, ratios and the verdict per document."""
    ship(docs.sparkSession)
    m = docs.select(F.col(id_col), F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).alias("_bytes"), per_text(_measure, _SCHEMA)(F.col(text_col)).alias("_m"))
    inside = F.lit(False)
    for below, low, high in reversed(bands):
        inside = F.when(F.col("_bytes") < below, F.col("whole_ratio").between(low, high)).otherwise(inside)
    out = m.select(id_col, "_bytes", "_m.*")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return out.select(
        id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & inside & (F.col("n_bad_chunks") <= chunk_share * F.col("n_chunks"))).alias("kept"),
        "whole_ratio", "n_chunks", "n_bad_chunks",
    )
