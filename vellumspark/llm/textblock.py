"""Vectorised word, line and hash arithmetic over Arrow text columns, used inside tasks.

A block holds some texts of one Arrow batch as a byte array with offsets; all results are
numpy arrays over the bytes or words of the block. Words are runs of characters other than
the six ASCII white-space characters (space, tab, \\n, \\v, \\f, \\r). A text longer than a
block is cut into parts behind white space, so the arrays over bytes stay as small as a block
(or the longest word) and only arrays over words grow with a text.

Hashes are polynomials over the bytes modulo two primes near 2**31, and the length: 62 bits
that no regular pattern of the bytes cancels out, as it would modulo 2**64.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Most bytes of text in one block or part.
BLOCK_BYTES = 512_000

U64 = np.uint64
_WS = np.zeros(256, bool)
_WS[[9, 10, 11, 12, 13, 32]] = True
#: (prime, base) of the two hashes.
_FIELDS = ((2147483647, 1327217885), (2147483629, 1804289383))
#: Bytes whose terms (under 2**39) add up in an int64.
_ADDABLE = 1 << 23


def tidied(work: Callable) -> Callable:
    """A function over a task's batches that gives freed memory back to the system when it ends."""

    @functools.wraps(work)
    def run(batches: Iterator, **options) -> Iterator:
        try:
            yield from work(batches, **options)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return run


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (murmur-style): spreads every input bit over the output."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


_POWERS: list[tuple[np.ndarray, np.ndarray]] = []


def _powers(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Powers 0..n of each field's base and of its inverse; kept up to a block's size."""

    def table(base: int, prime: int) -> np.ndarray:
        out, step = np.ones(1, np.int64), base
        while len(out) < n + 1:
            out = np.concatenate([out, out * step % prime])
            step = step * step % prime
        return out.astype(np.uint32)

    if _POWERS and len(_POWERS[0][0]) > n:
        return _POWERS
    made = [(table(b, p), table(pow(b, -1, p), p)) for p, b in _FIELDS]
    if n <= 2 * BLOCK_BYTES:
        _POWERS[:] = made
    return made


def seal(raw: tuple[np.ndarray, ...], length: np.ndarray) -> np.ndarray:
    """64-bit hashes from the fields' values and lengths."""
    return mix((raw[0].astype(U64) << U64(32)) | raw[1].astype(U64)) + mix(length.astype(U64) * U64(0x9FB21C651E98DF25))


def appended(left: tuple[int, ...], right: tuple[int, ...], length: int) -> tuple[int, ...]:
    """Field values of a span and, ``length`` bytes behind its start, another one, as one span."""
    return tuple((x + y * pow(b, length, p)) % p for x, y, (p, b) in zip(left, right, _FIELDS, strict=True))


class Block:
    """Some texts of a batch: ``first`` is the batch row of the first of them."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: int):
        self.data, self.starts, self.ends, self.first = data, starts, ends, first
        self.n = len(starts)

    def parts(self, most: int = BLOCK_BYTES) -> Iterator[Block]:
        """The block itself, or a long text in parts of about ``most`` bytes that end behind white space."""
        if len(self.data) <= most or self.n != 1:
            yield self
            return
        at, n = 0, len(self.data)
        while at < n:
            end = min(at + most, n)
            if end < n:
                blank = np.flatnonzero(_WS[self.data[at + most // 2 : end]])
                if len(blank):
                    end = at + most // 2 + int(blank[-1]) + 1
                else:
                    while end < n and not _WS[self.data[end - 1]]:
                        later = np.flatnonzero(_WS[self.data[end : end + most]])
                        end = end + int(later[0]) + 1 if len(later) else min(end + most, n)
            yield Block(self.data[at:end], np.zeros(1, np.int64), np.array([end - at]), self.first)
            at = end

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """Sum of a per-byte array over each text."""
        total = np.zeros(len(flags) + 1, np.int32 if len(flags) < 1 << 31 else np.int64)
        np.cumsum(flags, out=total[1:])
        return (total[self.ends] - total[self.starts]).astype(np.int64)

    def prefix_hash(self) -> list[np.ndarray]:
        """Prefix sums of both polynomials; see :meth:`span_hash`."""
        n, found = len(self.data), []
        value = self.data.astype(np.int64) + 1
        for (prime, _), (up, _) in zip(_FIELDS, _powers(n), strict=True):
            total = np.zeros(n + 1, np.int64)
            np.multiply(value, up[:n], out=total[1:])
            for at in range(0, n, _ADDABLE):
                part = total[at + 1 : at + 1 + _ADDABLE]
                part[0] += total[at] % prime
                np.cumsum(part, out=part)
            found.append(total)
        return found

    def span_raw(self, prefix: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
        """Values of both polynomials over the byte spans [a, b)."""
        tables = _powers(len(self.data))
        return tuple((total[b] - total[a]) % p * down[a] % p for total, (p, _), (_, down) in zip(prefix, _FIELDS, tables, strict=True))

    def span_hash(self, prefix: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """64-bit hashes of the byte spans [a, b), the same wherever a span stands."""
        return seal(self.span_raw(prefix, a, b), b - a)

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, text number) of every word, in order."""
        dark = ~_WS[self.data]
        begins = dark.copy()
        begins[1:] &= ~dark[:-1]
        stops = dark.copy()
        stops[:-1] &= ~dark[1:]
        full = self.ends > self.starts
        begins[self.starts[full]] = dark[self.starts[full]]
        stops[self.ends[full] - 1] = dark[self.ends[full] - 1]
        a, b = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        bounds = np.searchsorted(a, np.append(self.starts, len(self.data)))
        return a, b, np.repeat(np.arange(self.n), np.diff(bounds))

    def word_hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """(hash, text number) of every word, in order; a long text part by part."""
        hashes, owners = [np.zeros(0, U64)], [np.zeros(0, np.int64)]
        for part in self.parts():
            a, b, owner = part.words()
            hashes.append(part.span_hash(part.prefix_hash(), a, b))
            owners.append(owner)
        return np.concatenate(hashes), np.concatenate(owners)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, text number) of every \\n-separated line, in order; no text has no line."""
        cuts = np.flatnonzero(self.data == 10)
        owner = np.searchsorted(self.starts, cuts, side="right") - 1
        # an empty text shares its start with the next one: the last text that starts there owns the byte
        a = np.concatenate([self.starts, cuts + 1])
        b = np.concatenate([cuts, self.ends])
        who_a = np.concatenate([np.arange(self.n), owner])
        who_b = np.concatenate([owner, np.arange(self.n)])
        order_a, order_b = np.lexsort((a, who_a)), np.lexsort((b, who_b))
        return a[order_a], b[order_b], who_a[order_a]


def blocks(column: pa.Array, most: int = BLOCK_BYTES) -> Iterator[Block]:
    """Cut an Arrow string column into blocks; null texts count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i, n = 0, len(column)
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, side="right")) - 1)
        j = min(j, n)
        yield Block(raw[off[i] : off[j]], off[i:j] - off[i], off[i + 1 : j + 1] - off[i], i)
        i = j


def runs(sorted_values: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Number of each element within its run of equal (owner, value), from 0."""
    n = len(sorted_values)
    if n == 0:
        return np.zeros(0, np.int64)
    fresh = np.ones(n, bool)
    fresh[1:] = (sorted_values[1:] != sorted_values[:-1]) | (owner[1:] != owner[:-1])
    at = np.arange(n)
    return at - np.maximum.accumulate(np.where(fresh, at, 0))


def sort_each(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The values with every slice between consecutive bounds sorted."""
    out = values.copy()
    for i, j in zip(bounds[:-1], bounds[1:], strict=True):
        if j - i > 1:
            out[i:j].sort()
    return out


def bounds_of(owner: np.ndarray, n_texts: int) -> np.ndarray:
    """Slice bounds of each text in an array whose owners ascend."""
    return np.searchsorted(owner, np.arange(n_texts + 1))


def shingles(words: np.ndarray, owner: np.ndarray, n_texts: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of every window of ``size`` words; a shorter text is one window."""
    counts = np.bincount(owner, minlength=n_texts)
    begin = np.concatenate([[0], np.cumsum(counts)[:-1]])
    usable = np.where(counts == 0, 0, np.maximum(counts - size + 1, 1))
    who = np.repeat(np.arange(n_texts), usable)
    at = np.arange(len(who)) - np.repeat(np.cumsum(usable) - usable, usable) + begin[who]
    h = np.zeros(len(who), U64)
    padded = np.concatenate([words, np.zeros(size, U64)])
    left = counts[who]
    for k in range(size):
        part = padded[at + k]
        if (left <= k).any():
            part = np.where(k < left, part, U64(0))
        h = (h ^ part) * U64(0x9FB21C651E98DF25)
        h ^= h >> U64(32)
    return mix(h + U64(size)), who
