"""Byte-level BPE ids of whole Arrow text columns, one lookup per distinct piece.

Texts are split into the tokenizer's pieces (words with their leading space, digit runs,
punctuation runs, white space, English contractions) with array operations; each distinct
piece is encoded once and kept in a bounded cache. Texts with characters outside the range
for which the split is known here are encoded whole by the ``tokenizers`` library. Single
pieces may go to ``tiktoken`` with the same vocabulary as ranks, which has less overhead on
short strings; the tests hold all ids against the ``tokenizers`` library.
"""

from __future__ import annotations

import base64
import functools
import itertools
import os
import unicodedata

import numpy as np
import pyarrow as pa

from vellumspark.llm import textblock as tb

#: Code points up to here are split by array operations.
_KNOWN = 0x250
_LETTER, _NUMBER, _SPACE, _OTHER = 0, 1, 2, 3


def _kinds() -> np.ndarray:
    kinds = np.full(_KNOWN, _OTHER, np.int8)
    for cp in range(_KNOWN):
        category = unicodedata.category(chr(cp))
        if category[0] == "L":
            kinds[cp] = _LETTER
        elif category[0] == "N":
            kinds[cp] = _NUMBER
    kinds[[9, 10, 11, 12, 13, 32, 0x85, 0xA0]] = _SPACE
    return kinds


_KIND = _kinds()


def piece_starts(cp: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Flags of the code points that start a piece; texts are the spans [begin, end)."""
    n = len(cp)
    kind = _KIND[cp]
    first = np.zeros(n + 1, bool)
    full = end > begin
    first[begin[full]] = True
    last = np.zeros(n, bool)
    last[end[full] - 1] = True
    prev = np.full(n, -1, np.int8)
    prev[1:] = kind[:-1]
    prev[first[:n]] = -1
    before = np.zeros(n, cp.dtype)
    before[1:] = cp[:-1]
    blank = kind == _SPACE
    start = first[:n].copy()
    # a run of one kind starts a piece, at the plain space before it if there is one
    change = ~blank & (prev != kind) & (prev >= 0)
    spaced = change & (prev == _SPACE) & (before == 32)
    start |= change & ~spaced
    start[np.flatnonzero(spaced) - 1] = True
    # white space: the run is one piece up to its last character, which stands alone unless the text ends
    start |= blank & (prev != _SPACE) & (prev >= 0)
    final = blank & ~last
    final[:-1] &= ~(blank[1:] & ~first[1:n])
    start |= final
    # contractions at a piece's start: 's 't 'm 'd 're 've 'll
    quote = np.flatnonzero((cp == 39) & ((prev == _LETTER) | (prev == _NUMBER) | (prev == -1) | ((prev == _SPACE) & (before != 32))))
    if len(quote):
        stop = np.repeat(end[full], (end - begin)[full])
        padded = np.concatenate([cp, np.zeros(3, cp.dtype)])
        x, y = padded[quote + 1], padded[quote + 2]
        room = stop[quote] - quote
        one = np.isin(x, [ord(c) for c in "stmd"]) & (room >= 2)
        two = (((x == ord("r")) | (x == ord("v"))) & (y == ord("e")) | (x == ord("l")) & (y == ord("l"))) & (room >= 3)
        size = np.where(one, 2, np.where(two, 3, 0))
        hit, size = quote[size > 0], size[size > 0]
        start[hit] = True
        start[hit + 1] = False
        after = hit + size
        inside = (after < stop[hit])
        # what follows starts a piece, unless it is white space whose own rule decides
        nxt = after[inside]
        start[nxt[kind[nxt] != _SPACE]] = True
        three = hit[size == 3] + 2
        start[three] = False
    return start


def _place(name: str) -> str:
    """A file's place on this machine."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def _cuts(data: np.ndarray, most: int) -> list[int]:
    """Places of about every ``most`` bytes before which a text can be cut without changing its pieces.

    Such is a single space or line end between two letters (ASCII, or ideographs).
    """
    found, at, n = [0], 0, len(data)
    letter = np.zeros(256, bool)
    letter[[*range(65, 91), *range(97, 123)]] = True
    wide = np.zeros(256, bool)
    wide[0xE4:0xEA] = True
    while n - at > most:
        begin = at + most // 2
        while begin < n:
            view = data[begin : min(begin + most, n)]
            blank = begin + np.flatnonzero((view == 32) | (view == 10))
            blank = blank[(blank >= 3) & (blank < n - 1)]
            good = blank[(letter[data[blank - 1]] | wide[data[blank - 3]]) & (letter[data[blank + 1]] | wide[data[blank + 1]])]
            if len(good):
                at = int(good[np.searchsorted(good, at + most, side="right") - 1]) if good[0] <= at + most else int(good[0])
                found.append(at)
                break
            begin += most
        else:
            break
    return [*found, n]


class Encoder:
    """Ids of text columns, for one task. Files are named by their place on the worker, or by their name in ``public_tokenizers``."""

    def __init__(self, path: str, ranks: str | None = None, most: int = 100_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        path, ranks = _place(path), ranks and _place(ranks)
        self._load = Tokenizer.from_file
        self.path, self.most = path, most
        self.single = None
        if ranks:
            import tiktoken

            with open(ranks, "rb") as lines:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
            self.single = tiktoken.Encoding("pieces", pat_str=pattern, mergeable_ranks=table, special_tokens={}).encode_ordinary
        self.seen = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    @functools.cached_property
    def model(self):
        """The library's tokenizer; loaded where a text or a vocabulary without ranks needs it."""
        model = self._load(self.path)
        model.encode_special_tokens = True  # their strings in a text are ordinary text
        return model

    @staticmethod
    def _flat(found: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(itertools.chain.from_iterable(found), np.uint32, int(sizes.sum())), sizes

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self._flat([x.ids for x in self.model.encode_batch_fast(texts, add_special_tokens=False)])

    def _pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self._flat([self.single(x) for x in pieces]) if self.single else self._whole(pieces)

    def _lookup(self, h: np.ndarray, data: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids per piece) of pieces with hashes h at the bytes [a, b)."""
        values, index, inverse = np.unique(h, return_index=True, return_inverse=True)
        spot = np.searchsorted(self.seen, values)
        spot[spot == len(self.seen)] = 0
        known = self.seen[spot] == values if len(self.seen) else np.zeros(len(values), bool)
        new = np.flatnonzero(~known)
        raw = data.tobytes()
        ids, sizes = self._pieces([raw[i:j].decode() for i, j in zip(a[index[new]], b[index[new]], strict=True)])
        offset = np.zeros(len(values), np.int64)
        length = np.zeros(len(values), np.int64)
        offset[known], length[known] = self.at[spot[known]], self.size[spot[known]]
        offset[new], length[new] = len(self.ids) + np.cumsum(sizes) - sizes, sizes
        pool = np.concatenate([self.ids, ids])
        if len(self.seen) + len(new) <= self.most and len(new):
            seen = np.concatenate([self.seen, values[new]])
            by = np.argsort(seen)
            self.seen, self.ids = seen[by], pool
            self.at = np.concatenate([self.at, offset[new]])[by]
            self.size = np.concatenate([self.size, length[new]])[by]
        off, size = offset[inverse], length[inverse]
        total = np.cumsum(size)
        flat = np.arange(total[-1] if len(total) else 0) + np.repeat(off - (total - size), size)
        return pool[flat], size

    def encode(self, block: tb.Block, most: int = tb.BLOCK_BYTES) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each text) of a block; a long text is encoded in parts of about ``most`` bytes."""
        if len(block.data) <= most or block.n != 1:
            return self._encode(block)
        cuts = _cuts(block.data, most)
        parts = [self._encode(tb.Block(block.data[i:j], np.zeros(1, np.int64), np.array([j - i]), 0))[0] for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
        ids = np.concatenate(parts)
        return ids, np.array([len(ids)])

    def _encode(self, block: tb.Block) -> tuple[np.ndarray, np.ndarray]:
        lead = (block.data & 0xC0) != 0x80
        strange = np.zeros(len(block.data), bool)
        strange[block.data >= 0xC9] = True  # lead bytes from U+0240 on
        odd = block.per_text(strange) > 0
        counts = np.zeros(block.n, np.int64)
        at = np.flatnonzero(lead)
        cp = block.data[at].astype(np.int32)
        wide = np.flatnonzero((cp >= 0xC2) & (cp < 0xC9))
        cp[wide] = ((cp[wide] & 0x1F) << 6) | (block.data[at[wide] + 1] & 0x3F)
        cp[cp >= _KNOWN] = 0
        begin, end = np.searchsorted(at, block.starts), np.searchsorted(at, block.ends)
        start = piece_starts(cp, begin, end) if len(cp) else np.zeros(0, bool)
        if odd.any():
            skip = np.repeat(odd, end - begin)
            start &= ~skip
        s = np.flatnonzero(start)
        a = at[s]
        owner = np.searchsorted(block.starts, a, side="right") - 1
        limit = np.append(a[1:], len(block.data)) if len(a) else a
        b = np.minimum(limit, block.ends[owner])
        ids, size = self._lookup(block.span_hash(block.prefix_hash(), a, b), block.data, a, b)
        np.add.at(counts, owner, size)
        if not odd.any():
            return ids, counts
        raw = block.data.tobytes()
        whole, sizes = self._whole([raw[block.starts[i] : block.ends[i]].decode() for i in np.flatnonzero(odd)])
        counts[odd] = sizes
        out = np.zeros(int(counts.sum()), np.uint32)
        mask = np.repeat(odd, counts)
        out[mask], out[~mask] = whole, ids
        return out, counts
