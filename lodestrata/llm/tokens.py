"""Token ids of whole texts by a byte-level BPE tokenizer file, with each distinct piece of text encoded once a worker.

The pre-tokenizer of these files never joins a non-white-space character to white space that follows it:
a token boundary lies before every white space that follows a visible character, whatever surrounds it.
Text is cut at those places only, so the ids of a text are the ids of its pieces one after another; special
strings hold no white space and stay whole within a piece. Pieces go to the `tokenizers` library itself.
"""

from __future__ import annotations

import os

import numpy as np

from lodestrata.llm import textscan as ts

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

_WHITE = ~ts.SPACED
_VISIBLE = ts.byte_table(lambda b: 33 <= b <= 126)
_loaded: dict[str, object] = {}
_caches: dict[str, PieceCache] = {}


def tokenizer(path: str):
    if path not in _loaded:
        from tokenizers import Tokenizer

        _loaded[path] = Tokenizer.from_file(path)
    return _loaded[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def cuts(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Starts of the pieces of the documents in buf: their first bytes and every proven boundary."""
    w = _WHITE[buf]
    at = np.flatnonzero(w[1:] & ~w[:-1]) + 1
    before = buf[at - 1]
    lead = buf[np.maximum(at - 2, 0)]
    # a two-byte character from U+00C0 on is no white space; after other characters outside ASCII no cut is made
    proven = _VISIBLE[before] | ((before >= 0x80) & (before < 0xC0) & (lead >= 0xC3) & (lead <= 0xDF))
    firsts = off[:-1][np.diff(off) > 0]
    return np.union1d(at[proven], firsts)


class PieceCache:
    """Ids of pieces, in a two-way table of bounded size by their hashes; emptied when its pools are full. A piece found by its hash is compared byte by byte."""

    def __init__(self, path: str, slots: int = 1 << 21, pool: int = 12_000_000, pool_bytes: int = 96 << 20):
        self.path, self.slots, self.pool, self.pool_bytes = path, slots, pool, pool_bytes
        self.clear()

    def clear(self) -> None:
        self.keys, self.value = np.zeros(2 * self.slots, np.uint64), np.zeros(2 * self.slots, np.int32)
        self.ids, self.starts, self.used, self.n = np.zeros(1 << 20, np.uint16 if self.small() else np.uint32), np.zeros(1 << 19, np.int64), 0, 0
        self.lengths = np.zeros(1 << 19, np.int32)
        self.data, self.data_at = np.zeros(1 << 22, np.uint8), np.zeros((1 << 19) + 1, np.int64)

    def small(self) -> bool:
        return tokenizer(self.path).get_vocab_size() <= 65536

    def _add(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Encodes pieces of buf and keeps them; their numbers."""
        data = buf.tobytes()
        got = tokenizer(self.path).encode_batch_fast([data[x:y].decode() for x, y in zip(starts.tolist(), ends.tolist(), strict=True)], add_special_tokens=False)
        ids = [e.ids for e in got]
        lengths = np.fromiter(map(len, ids), np.int32, len(ids))
        flat = np.fromiter((i for x in ids for i in x), self.ids.dtype, int(lengths.sum()))
        said = ends - starts
        filled = int(self.data_at[self.n])
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.n + len(ids) > len(self.starts):
            self.starts, self.lengths = np.concatenate([self.starts, np.zeros_like(self.starts)]), np.concatenate([self.lengths, np.zeros_like(self.lengths)])
            self.data_at = np.concatenate([self.data_at, np.zeros(len(self.data_at) - 1, np.int64)])
        while filled + int(said.sum()) + 8 > len(self.data):
            self.data = np.concatenate([self.data, np.zeros_like(self.data)])
        new = np.arange(self.n, self.n + len(ids))
        self.ids[self.used : self.used + len(flat)] = flat
        self.lengths[new] = lengths
        self.starts[new] = self.used + np.cumsum(lengths) - lengths
        self.data[filled : filled + int(said.sum())] = buf[ts.spread(starts, said)]
        self.data_at[new + 1] = filled + np.cumsum(said)
        self.used, self.n = self.used + len(flat), self.n + len(ids)
        return new

    def look_up(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number in the cache of each piece, the first piece of each document and the number of pieces)."""
        if self.used > self.pool or self.data_at[self.n] > self.pool_bytes:
            self.clear()
        starts = cuts(buf, off)
        ends = np.append(starts[1:], len(buf)) if len(starts) else starts
        first = np.searchsorted(starts, off)
        first[-1] = len(starts)
        h = ts.hash_pieces(buf, starts, ends)
        h[h == 0] = 1
        slot = (h & np.uint64(self.slots - 1)).astype(np.int64)
        a = self.keys[slot] == h
        b = self.keys[slot + self.slots] == h
        piece = np.where(a, self.value[slot], self.value[slot + self.slots])
        found = np.flatnonzero(a | b)
        known = np.zeros(len(h), bool)
        known[found] = ts.same_pieces(buf, starts[found], ends[found], self.data, self.data_at[piece[found]], self.data_at[piece[found] + 1], spare=True)
        missing = np.flatnonzero(~known)
        if len(missing):
            u, one, back = np.unique(h[missing], return_index=True, return_inverse=True)
            rows = missing[one]
            new = self._add(buf, starts[rows], ends[rows])
            piece[missing] = new[back]
            s = slot[rows]
            s = s + self.slots * (self.keys[s] != 0)  # the second way takes what comes later
            self.keys[s], self.value[s] = u, new
            alike = rows[back]
            other = missing[~ts.same_pieces(buf, starts[missing], ends[missing], buf, starts[alike], ends[alike])]
            if len(other):  # different pieces of one hash
                piece[other] = self._add(buf, starts[other], ends[other])
        return piece.astype(np.int64), first

    def counts(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Tokens of each document."""
        piece, first = self.look_up(buf, off)
        total = np.concatenate([[0], np.cumsum(self.lengths[piece], dtype=np.int64)])
        return total[first[1:]] - total[first[:-1]]

    def encode(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all documents one after another, where each begins and the end)."""
        piece, first = self.look_up(buf, off)
        lengths = self.lengths[piece].astype(np.int64)
        total = np.concatenate([[0], np.cumsum(lengths)])
        return self.ids[ts.spread(self.starts[piece], lengths)].astype(np.uint32), total[first]


def cache(path: str) -> PieceCache:
    if path not in _caches:
        _caches[path] = PieceCache(path)
    return _caches[path]
