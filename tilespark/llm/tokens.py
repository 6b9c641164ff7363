"""Token counts and ids with the whole-token shortcut.

A text is cut at places where the tokenizer always cuts too (before a space that
is followed by a non-space; for the word vocabulary at any white space), so each
unit can be handled alone. Each different unit is worked out once and kept in a table
of bounded size: a younger half takes what is met, an older one what was met before.

Byte-level vocabulary: :func:`prove_whole_tokens` finds offline which vocabulary
strings encode alone as one token. A pre-token that is such a string counts one
without any merging; only the rest run the merges.

Edge cases: a null text counts as empty (no bytes, no tokens); strings of special
tokens inside a text are handled as the library's default does; repeated rows and
null ids give one output row each; only the named columns are read.
"""

import functools
import gc
import re
import unicodedata

import numpy as np
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilespark.llm.common import hold, per_text
from tilespark.llm.merges import LONGEST, Merges, cut_at
from tilespark.session import ship

#: Units kept in a worker; those not met for long are forgotten, which costs time only.
UNITS_KEPT = 300_000

#: Signs that end a word and are pre-tokens of their own after letters.
_ENDS = frozenset(".,;:!?")

BYTE_FILE, WORD_FILE = "byte_bpe_50k.json", "word_bpe_49k.json"


#: Kinds of a sign in the word vocabulary's splitting rule: runs of letters, single numbers, runs of others.
_GAP, _LETTER, _NUMBER, _OTHER = range(4)


def _simple_signs():
    """Kind by code point, and the signs of plain Latin that lower-case to one of them.

    The apostrophe (contractions) and the bar (special strings) are left to the general way.
    """
    kinds, simple = np.zeros(0x250, np.uint8), []
    for c in map(chr, (*range(0x21, 0x7F), *range(0xA1, 0x250))):
        kind = {"L": _LETTER, "N": _NUMBER, "C": _GAP}.get(unicodedata.category(c)[0], _OTHER)
        kinds[ord(c)] = kind
        if kind and c not in "'|" and len(c.lower()) == 1 and ord(c.lower()) < 0x250 and unicodedata.is_normalized("NFC", c):
            simple.append(c)
    return kinds, "".join(simple)


def _load(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _byte_chars() -> dict:
    """Character -> byte of the byte-level alphabet, built by its published rule."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


def prove_whole_tokens(path: str) -> frozenset:
    """The vocabulary strings that, encoded alone, give exactly one token.

    Merges never look beyond a pre-token, so a pre-token equal to such a string
    is one token in any text. Strings that aren't valid UTF-8 can't be pre-tokens
    of a text and are left out, as are special tokens.
    """
    tok = _load(path)
    special = {t.content for t in tok.get_added_tokens_decoder().values()}
    to_byte, strings = _byte_chars(), []
    for shown in tok.get_vocab(with_added_tokens=False):
        if shown in special:
            continue
        try:
            strings.append(bytes(to_byte[c] for c in shown).decode("utf-8"))
        except (KeyError, UnicodeDecodeError):
            continue
    return frozenset(s for s, e in zip(strings, tok.encode_batch(strings, add_special_tokens=False)) if len(e.ids) == 1)


class _Units:
    """Works out each different unit of a batch once; ``seen`` keeps the results."""

    def __init__(self, path: str):
        self.tok, self.merges, self.seen, self.old, self.pieces = _load(path), Merges(path, _byte_chars()), {}, {}, {}
        hold(self.forget)
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()]

    def forget(self) -> None:
        """Empty the tables: they outlive a task, but not the operator's stage."""
        self.seen.clear()
        self.old.clear()
        self.pieces.clear()

    def _have(self, units: set) -> None:
        """Let ``seen`` hold all of ``units``: from the older half of the table, or learned."""
        new = units.difference(self.seen)
        if len(self.seen) + len(new) > UNITS_KEPT // 2:
            self.old, self.seen, new = self.seen, {}, units
        if new and self.old:
            known = {u: self.old[u] for u in new if u in self.old}
            self.seen.update(known)
            new = new.difference(known)
        if new:
            self._learn(new)

    def _learn(self, units: set) -> None:
        """Fill ``seen`` for the new units; equal pre-tokens are merged once."""
        gc.disable()  # hundreds of thousands of small lists, no cycles
        try:
            self._learn_all(units)
        finally:
            gc.enable()

    def _learn_all(self, units: set) -> None:
        if len(self.pieces) >= UNITS_KEPT:
            self.pieces.clear()
        pieces, pre = self.pieces, self._pre_tokens
        split = [(u, pre(u)) for u in units]
        new = [p for p in {p for _, q in split if q is not None for p in q if p not in pieces} if not self._direct(p)]
        data = [p.encode() for p in new]
        if max(map(len, data), default=0) > LONGEST:
            for p, b in zip(new, data):
                if len(b) > LONGEST:
                    pieces[p] = self._library(p)
            new = [p for p, b in zip(new, data) if len(b) <= LONGEST]
            data = [b for b in data if len(b) <= LONGEST]
        if new:
            self._merged(new, data)
        seen, join = self.seen, self._join
        for u, q in split:
            seen[u] = self._library(u) if q is None else pieces[q[0]] if len(q) == 1 else join([pieces[p] for p in q])

    def _direct(self, piece: str) -> bool:
        """Whether ``pieces`` got the pre-token without merging."""
        return False


class ByteCounter(_Units):
    """Counts tokens of the byte-level vocabulary.

    Keys of ``seen`` are units without their leading space, which each has but
    for the first unit of a text.
    """

    #: A space before a non-space always begins a pre-token.
    _cut = regex.compile(r"(?= [^\s])")

    def __init__(self, path: str, whole: frozenset):
        super().__init__(path)
        self.whole = whole
        self.pre = regex.compile(public_tokenizers.PATTERN)
        self.special = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None

    def _pre_tokens(self, unit: str) -> list:
        if unit.isalpha():
            return [" " + unit]
        if unit[-1:] in _ENDS and unit[:-1].isalpha():
            return [" " + unit[:-1], unit[-1]]
        return self.pre.findall(" " + unit)

    def _direct(self, piece: str) -> bool:
        if piece in self.whole:
            self.pieces[piece] = 1
            return True
        return False

    def _merged(self, pieces: list, data: list) -> None:
        self.pieces.update(zip(pieces, self.merges.encode(data, only_count=True)))

    def _library(self, piece: str) -> int:
        return len(self.tok.encode(piece, add_special_tokens=False).ids)

    def _join(self, counts: list) -> int:
        return sum(counts)

    def _alone(self, text: str) -> int:
        """For text without a leading space, or where spaces need care."""
        n = 0
        for p in self.pre.findall(text):
            if p not in self.pieces and not self._direct(p):
                self.pieces[p] = self._library(p)
            n += self.pieces[p]
        return n

    def _split(self, text: str):
        """The first unit, then the others without their space."""
        parts = text.split(" ")
        if "" in parts[1:] or any(p[0].isspace() for p in parts[1:]):
            units = [u for u in self._cut.split(text) if u]
            if units and units[0][:1] == " " and units[0][1:2].strip():
                units.insert(0, "")
            return units[0] if units else "", [u[1:] for u in units[1:]]
        return parts[0], parts[1:]

    def __call__(self, texts: list) -> list:
        plain, owner, n = [], [], [0] * len(texts)
        for i, t in enumerate(texts):
            if self.special and any(a in t for a in self.added):
                n[i] += len(self.special.findall(t))
                for x in self.special.split(t):
                    plain.append(x)
                    owner.append(i)
            else:
                plain.append(t)
                owner.append(i)
        cut = [self._split(t) for t in plain]
        self._have(set().union(*(rest for _, rest in cut)))
        get = self.seen.__getitem__
        for i, (first, rest) in zip(owner, cut):
            n[i] += (self._alone(first) if first else 0) + sum(map(get, rest))
        return n


class WordEncoder(_Units):
    """Ids of the word vocabulary as little-endian unsigned 32-bit bytes.

    White space only separates there, so units between spaces, tabs and line
    ends are independent. Units of plain Latin letters and signs are split and
    merged here, most of them as arrays; any others are encoded by the library, once each.
    """

    def __init__(self, path: str | None = None):
        super().__init__(path or public_tokenizers.path(WORD_FILE))
        self.pre = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        self.plain = re.compile("[\x21-\x7e\xa1-\xac\xae-\u024f]+")
        self.kinds, simple = _simple_signs()
        self.simple = re.compile(f"[{re.escape(simple)}]*")

    def _learn_all(self, units: set) -> None:
        """Units of simple signs are split and merged as arrays; the others one by one."""
        simple = list(units)
        if not self.simple.fullmatch("".join(simple)):
            simple = [u for u in simple if self.simple.fullmatch(u)]
        simple = self._learn_simple(simple)
        if len(simple) < len(units):
            super()._learn_all(units.difference(simple))

    def _learn_simple(self, units: list) -> list:
        """Learn the units of simple signs whose pre-tokens aren't too long; returns those learned."""
        if not units:
            return units
        text = "\n".join(units).lower() + "\n"
        points = np.frombuffer(text.encode("utf-16-le"), "<u2")
        kind = self.kinds[points]
        gap = kind == _GAP
        begin = ~gap
        begin[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == _NUMBER)
        edges = np.flatnonzero(begin | gap)
        piece = np.flatnonzero(begin[edges])
        width = 1 + (points >= 0x80)
        at = np.cumsum(width) - width
        starts = at[edges[piece]]
        lengths = at[edges[piece + 1]] - starts
        owner = np.cumsum(gap)[edges[piece]]
        if len(lengths) and lengths.max() > LONGEST:
            far = set(owner[lengths > LONGEST].tolist())
            return self._learn_simple([u for i, u in enumerate(units) if i not in far])
        flat, counts = self.merges.spans(np.frombuffer(text.encode(), np.uint8), starts, lengths)
        totals = np.bincount(owner, counts, len(units)).astype(np.int64)
        self.seen.update(zip(units, cut_at(flat, totals)))
        return units

    def _pre_tokens(self, unit: str) -> list | None:
        if not unit:
            return []
        if not self.plain.fullmatch(unit):
            return None
        low = unit.lower()
        if low.isalpha():
            return [low]
        if low[-1] in _ENDS and low[:-1].isalpha():
            return [low[:-1], low[-1]]
        return None if "<|" in low else self.pre.findall(low)

    def _merged(self, pieces: list, data: list) -> None:
        self.pieces.update(zip(pieces, self.merges.encode(data)))

    def _library(self, piece: str) -> bytes:
        return np.array(self.tok.encode(piece, add_special_tokens=False).ids, "<u4").tobytes()

    def _join(self, parts: list) -> bytes:
        return b"".join(parts)

    def __call__(self, texts: list) -> list:
        cut = [t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in texts]
        self._have(set().union(*cut))
        get = self.seen.__getitem__
        return [b"".join(map(get, units)) for units in cut]


@functools.cache
def word_encoder(path: str | None = None) -> WordEncoder:
    """One encoder for each Python worker, so later tasks find its tables filled."""
    return WordEncoder(path)


_counters: dict = {}


def byte_counter(path: str, whole: frozenset) -> ByteCounter:
    """One counter for each Python worker."""
    if path not in _counters:
        _counters[path] = ByteCounter(path, whole)
    return _counters[path]


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, limit: int = 1024) -> DataFrame:
    """Bytes and tokens of every text, and whether the tokens exceed ``limit``."""
    spark = docs.sparkSession
    ship(spark)
    file = path or public_tokenizers.path(BYTE_FILE)
    whole = spark.sparkContext.broadcast(prove_whole_tokens(file))  # at most the vocabulary

    def make():
        count = byte_counter(file, whole.value)
        return lambda texts: [count(texts)]

    make.holds = True

    n = per_text(make, "n_tokens long")(F.col(text_col))["n_tokens"]
    out = docs.select(F.col(id_col), F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long").alias("n_bytes"), n.alias("n_tokens"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
