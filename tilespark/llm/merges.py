"""Byte-pair merges for many short strings at once.

Strings become rows of symbols in a matrix. In each round every row that still
has a mergeable pair merges its leftmost pair of lowest rank; the pair ranks come
from a hash table looked up for the whole matrix. Rows are handled in groups of
like length, so a round costs a few numpy calls for thousands of strings.
"""

import json

import numpy as np

#: Longest string (in symbols) handled here; longer ones go to the library.
LONGEST = 48
_NONE = np.int32(2**31 - 1)
_GROUPS = (4, 6, 8, 10, 12, 16, 24, LONGEST)
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Merges:
    """The merges of a vocabulary file; ``byte_chars`` maps its characters to bytes."""

    def __init__(self, path: str, byte_chars: dict):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ", 1)) for m in model["merges"]]
        self.first = np.full(256, -1, np.int32)
        self.last = np.full(256, -1, np.int32)
        for c, b in byte_chars.items():
            self.first[b] = vocab.get(c, -1)
            self.last[b] = vocab.get(c + suffix, -1)
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self._index((left << 20) + right)

    def _index(self, keys: np.ndarray) -> None:
        """Open addressing with linear probing, a quarter full."""
        self.bits = int(len(keys) * 4 - 1).bit_length()
        size = 1 << self.bits
        self.keys, self.ranks = np.full(size, -1, np.int64), np.full(size, _NONE, np.int32)
        slots = self._slot(keys)
        for rank, (k, s) in enumerate(zip(keys.tolist(), slots.tolist())):
            while self.keys[s] != -1 and self.keys[s] != k:
                s = (s + 1) & (size - 1)
            if self.keys[s] == -1:
                self.keys[s], self.ranks[s] = k, rank

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _MIX) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, or ``_NONE``."""
        keys = (left.astype(np.int64) << 20) + right  # negative, so never found, next to a gap
        slot = self._slot(keys)
        found = self.keys.take(slot)
        same = found == keys
        out = np.where(same, self.ranks.take(slot), _NONE)
        todo = np.flatnonzero(~same & (found != -1))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & (len(self.keys) - 1)
            found = self.keys[slot[todo]]
            hit = found == keys[todo]
            out[todo[hit]] = self.ranks[slot[todo[hit]]]
            todo = todo[~hit & (found != -1)]
        return out

    def encode(self, strings: list, only_count: bool = False) -> list:
        """Ids of each string (bytes, 1 to LONGEST of them) as little-endian 32-bit bytes, or their number."""
        lengths = np.fromiter(map(len, strings), np.int64, len(strings))
        flat, counts = self.spans(np.frombuffer(b"".join(strings), np.uint8), np.cumsum(lengths) - lengths, lengths)
        return counts.tolist() if only_count else cut_at(flat, counts)

    def spans(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray):
        """Ids of the strings at ``starts`` of ``data`` (1 to LONGEST bytes each), one after the other, and their numbers."""
        counts, done, low = np.zeros(len(starts), np.int64), [], 0
        for high in _GROUPS:
            rows = np.flatnonzero((lengths > low) & (lengths <= high))
            for part in np.array_split(rows, max(1, len(rows) // 16384)):
                if len(part):
                    ids, counts[part] = self._merge(data, starts[part], lengths[part], high)
                    used = np.arange(high)[None, :] < counts[part][:, None]
                    done.append((part, used, ids[used]))
            low = high
        flat, begin = np.empty(counts.sum(), "<u4"), np.cumsum(counts) - counts
        for part, used, ids in done:
            flat[(begin[part][:, None] + np.arange(used.shape[1])[None, :])[used]] = ids
        return flat, counts

    def _merge(self, data, starts, lengths, width):
        cols = np.arange(width)
        inside = cols[None, :] < lengths[:, None]
        raw = data[np.minimum(starts[:, None] + cols[None, :], len(data) - 1)]
        sym = np.where(inside, self.first[raw], -1).astype(np.int32)
        at = np.arange(len(starts))
        sym[at, lengths - 1] = self.last[raw[at, lengths - 1]]
        rank = np.full(sym.shape, _NONE, np.int32)
        rank[:, :-1] = self.rank(sym[:, :-1].ravel(), sym[:, 1:].ravel()).reshape(len(starts), -1)
        counts = lengths.copy()
        live, s, r = at, sym, rank
        grid = np.arange(width - 1)
        #: Row j of each: where the columns come from once the pair at j is one symbol.
        move = np.minimum(grid[None, :] + (grid[None, :] > grid[:, None]), width - 1)
        move = np.concatenate([move, np.full((width - 1, 1), width - 1)], 1)
        move_r = np.concatenate([np.minimum(grid[None, :] + (grid[None, :] >= grid[:, None]), width - 1), np.full((width - 1, 1), width - 1)], 1)
        while len(live):
            j = r.argmin(1)
            row = np.arange(len(live)) * width
            best = r.ravel()[row + j]
            on = best != _NONE
            if not on.all():
                off = ~on
                sym[live[off]] = s[off]
                live, s, r, j, best = live[on], s[on], r[on], j[on], best[on]
                if not len(live):
                    break
                row = row[: len(live)]
            counts[live] -= 1
            s = s.ravel().take(row[:, None] + move[j])
            r = r.ravel().take(row[:, None] + move_r[j])
            s[:, -1] = -1
            flat, ranks, at_j = s.ravel(), r.ravel(), row + j
            flat[at_j] = self.made[best]
            has = np.flatnonzero(j > 0)
            new = self.rank(np.concatenate([flat[at_j], flat[at_j[has] - 1]]), np.concatenate([flat[at_j + 1], flat[at_j[has]]]))
            ranks[at_j] = new[: len(j)]
            ranks[at_j[has] - 1] = new[len(j) :]
        return sym, counts


def cut_at(flat: np.ndarray, counts: np.ndarray) -> list:
    """The bytes of ``flat`` cut into runs of ``counts`` ids."""
    data, ends = flat.tobytes(), np.cumsum(counts) * 4
    return [data[a:b] for a, b in zip((ends - 4 * counts).tolist(), ends.tolist())]
