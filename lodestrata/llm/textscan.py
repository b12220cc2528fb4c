"""Words and window hashes of whole Arrow text columns, as numpy arrays.

A task hands over one Arrow batch; the functions here work on its UTF-8 bytes directly, in groups
of whole documents of about a megabyte, so that temporaries stay small. A word is hashed eight bytes
at a time: each eight are diffused under a key of the family before they meet the state, which is diffused again, so that a change
in one place can't be undone in the next but by chance. Long words go through BLAKE2. A window's hash joins those of its halves. `which` chooses one of two families, whose
keys and so whose states differ. Where bytes are at hand, `classes` numbers pieces exactly, whatever their hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: (multiplier of the length, key of eight bytes, key of the state, multiplier of a window's first half, of a window) of each family.
_FAMILIES = (
    (U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x2545F4914F6CDD1D), U(0x9FB21C651E98DF25), U(0xD6E8FEB86659FD93)),
    (U(0xA0761D6478BD642F), U(0x589965CC75374CC3), U(0x1D8E4E27C47D124F), U(0xC2B2AE3D27D4EB4F), U(0xE7037ED1A0B428DB)),
)
#: The first 0..8 bytes of a little-endian word.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=U)
#: Pieces of more bytes than this are hashed one by one.
LONG_PIECE = 256
GROUP_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: every input bit reaches every output bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def byte_table(is_word) -> np.ndarray:
    return np.array([bool(is_word(b)) for b in range(256)])


#: Bytes of words split at ASCII white space, and of words of ASCII digits, letters and all else outside ASCII.
SPACED = byte_table(lambda b: not (b == 32 or 9 <= b <= 13))
ALNUM = byte_table(lambda b: 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128)
_FOLDED = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)


def raw(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its offsets (int64, from 0); null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return buf, off - off[0]


def groups(off: np.ndarray, limit: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents that hold about limit bytes together, one document at least."""
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def lanes(buf: np.ndarray, spare: bool = False) -> np.ndarray:
    """The eight bytes from each place in buf on as a number; zeros follow the end. spare: the last eight bytes of buf are unused, and it needn't be copied."""
    padded = buf if spare else np.concatenate([buf, np.zeros(8, np.uint8)])
    return np.ndarray((len(padded) - 7,), "<u8", padded, 0, (1,))


def folded(buf: np.ndarray) -> np.ndarray:
    return _FOLDED[buf]


def hash_pieces(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """Hashes of pieces of buf."""
    by_length, key, step, _, _ = _FAMILIES[which]
    lane, n = lanes(buf), ends - starts
    h = mix(n.astype(U) * by_length ^ mix((lane[starts] & _FIRST[np.minimum(n, 8)]) + key))
    at, more = 8, np.flatnonzero((n > 8) & (n <= LONG_PIECE))
    while len(more):
        left = n[more] - at
        h[more] = mix((h[more] ^ mix((lane[starts[more] + at] & _FIRST[np.minimum(left, 8)]) + key)) + step)
        more, at = more[left > 8], at + 8
    for i in np.flatnonzero(n > LONG_PIECE).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(buf[starts[i] : ends[i]], digest_size=8, person=bytes([which])).digest(), "little")
    return h


def same_pieces(a: np.ndarray, a_starts: np.ndarray, a_ends: np.ndarray, b: np.ndarray, b_starts: np.ndarray, b_ends: np.ndarray, spare: bool = False) -> np.ndarray:
    """Whether each piece of a has the bytes of that of b; spare: as in lanes, for b."""
    n = a_ends - a_starts
    same = n == b_ends - b_starts
    x, y, at, more = lanes(a), lanes(b, spare), 0, np.flatnonzero(same & (n > 0) & (n <= LONG_PIECE))
    while len(more):
        left = n[more] - at
        mask = _FIRST[np.minimum(left, 8)]
        ok = (x[a_starts[more] + at] & mask) == (y[b_starts[more] + at] & mask)
        same[more[~ok]] = False
        more, at = more[ok & (left > 8)], at + 8
    for i in np.flatnonzero(same & (n > LONG_PIECE)).tolist():
        same[i] = np.array_equal(a[a_starts[i] : a_ends[i]], b[b_starts[i] : b_ends[i]])
    return same


def classes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, within: np.ndarray | None = None) -> np.ndarray:
    """A number for each piece, equal only for equal bytes (and equal `within`): hashes put equal pieces together, and each is compared with the one before it."""
    h = hash_pieces(buf, starts, ends)
    order = np.argsort(h, kind="stable") if within is None else np.lexsort((h, within))
    s, e = starts[order], ends[order]
    near = h[order][1:] == h[order][:-1]
    if within is not None:
        near &= within[order][1:] == within[order][:-1]
    at = np.flatnonzero(near)
    same = np.zeros(len(near), bool)
    same[at] = same_pieces(buf, s[at], e[at], buf, s[at + 1], e[at + 1])
    out = np.empty(len(h), np.int64)
    out[order] = np.concatenate([[0], np.cumsum(~same)]) if len(h) else 0
    if not same[at].all():  # one hash of different pieces: those of its run are told apart by their bytes
        run = np.concatenate([[0], np.cumsum(~near)])
        for r in np.unique(run[1:][near & ~same]).tolist():
            mine = order[np.flatnonzero(run == r)]
            known: dict[bytes, int] = {}
            for i in mine.tolist():
                out[i] = known.setdefault(buf[starts[i] : ends[i]].tobytes(), int(out[i]))
    return out


class Words:
    """starts, ends: byte places in buf; hash: of each word; first: the first word of each document, then the number of words."""

    __slots__ = ("buf", "ends", "first", "hash", "starts")

    def __init__(self, buf, starts, ends, hash_, first):
        self.buf, self.starts, self.ends, self.hash, self.first = buf, starts, ends, hash_, first

    def second(self) -> np.ndarray:
        """Each word's hash of the other family."""
        return hash_pieces(self.buf, self.starts, self.ends, which=1)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts())


def words(buf: np.ndarray, off: np.ndarray, table: np.ndarray = SPACED, fold: bool = False, hashed: bool = True) -> Words:
    """Words of the documents whose bytes lie one after another in buf; off: their places."""
    w = table[buf]
    s = w.copy()
    s[1:] &= ~w[:-1]
    inner = off[:-1][off[:-1] < len(buf)]
    s[inner] = w[inner]
    e = w.copy()
    e[:-1] &= ~w[1:]
    last = off[1:][off[1:] > 0] - 1
    e[last] = w[last]
    starts = np.flatnonzero(s)
    ends = np.flatnonzero(e) + 1
    first = np.searchsorted(starts, off)
    first[-1] = len(starts)
    said = folded(buf) if fold else buf
    return Words(said, starts, ends, hash_pieces(said, starts, ends) if hashed else None, first)


def windows(h: np.ndarray, first: np.ndarray, k: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of every window of k consecutive words that lies in one document; h: the words' hashes of family `which`."""
    at = spread(first[:-1], np.maximum(np.diff(first) - k + 1, 0))
    if not len(at):
        return at, np.zeros(0, U)
    *_, half, whole = _FAMILIES[which]

    def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x = a[: len(b)] * half
        x += b
        x ^= x >> U(31)
        x *= whole
        x ^= x >> U(29)
        return x

    # windows of 1, 2, 4, ... words; those that make up k are put one after another
    part, size, out, done = h, 1, None, 0
    while True:
        if k & size:
            out = part if out is None else joined(out, part[done:])
            done += size
        if done == k:
            return at, mix(out[at])
        part, size = joined(part, part[size:]), 2 * size


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each run, one run after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def covered(at: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of n words lie in a window of k words that starts at one of the places."""
    d = np.bincount(at, minlength=n + 1) - np.bincount(np.minimum(at + k, n), minlength=n + 1)
    return np.cumsum(d[:n]) > 0


def per_document(mask: np.ndarray, first: np.ndarray) -> np.ndarray:
    """How many of each document's words are marked."""
    total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    return total[first[1:]] - total[first[:-1]]


def order_of(key: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(an order in which equal pairs of hashes adjoin, whether each in it but the first equals the one before); sorted by key, equal pairs in their own order."""
    order = np.argsort(key, kind="stable")
    k, s = key[order], second[order]
    same, other = k[1:] == k[:-1], s[1:] != s[:-1]
    if (same & other).any():  # one hash says the same of different things
        order = np.lexsort((second, key))
        same, other = key[order[1:]] == key[order[:-1]], second[order[1:]] != second[order[:-1]]
    return order, same & ~other


def runs_of(said: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """A number for each run of k places from those of `at` on, equal only for equal numbers in them; said: under 2**31."""
    bits = int(said.max()).bit_length() if len(said) else 1
    out, used = said[at], bits
    for j in range(1, k):
        if used + bits > 62:
            out = np.unique(out, return_inverse=True)[1]
            used = len(out).bit_length()
        out, used = (out << bits) | said[at + j], used + bits
    return out


def again(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which keys occur twice or more in their document, which of those come after an equal one); doc ascends."""
    order = np.argsort(key, kind="stable")
    same = (key[order[1:]] == key[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]])
    edges = np.concatenate([[False], same, [False]]) if len(order) else np.zeros(1, bool)
    any_, later = np.zeros(len(order), bool), np.zeros(len(order), bool)
    any_[order] = edges[:-1] | edges[1:]
    later[order] = edges[:-1]
    return any_, later
