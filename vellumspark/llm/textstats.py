"""Per-text counts shared by the quality rules and the quality classifier."""

from __future__ import annotations

import numpy as np

from vellumspark.llm import textblock as tb

#: Character classes by their first byte; every code point falls into exactly one.
CLASSES = ("lower", "upper", "digit", "space", "break", "stop", "shout", "quote", "symbol", "latin", "other", "control")
_CLASS = np.full(256, -1, np.int8)


def _assign(name: str, chars: str | range) -> None:
    _CLASS[[ord(c) if isinstance(c, str) else c for c in chars]] = CLASSES.index(name)


_assign("control", range(0, 32))
_assign("control", [127])
_assign("lower", range(97, 123))
_assign("upper", range(65, 91))
_assign("digit", range(48, 58))
_assign("space", [32, 9])
_assign("break", [10, 11, 12, 13])
_assign("stop", ".,;:")
_assign("shout", "!?")
_assign("quote", "'\"()-_/")
_assign("symbol", "#*$%&|<>@^~+=\\{}[]`")
_assign("latin", range(0xC2, 0xCA))
_assign("other", range(0xCA, 0xF8))
_LEAD = np.ones(256, bool)
_LEAD[0x80:0xC0] = False
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True


def _scan(block: tb.Block) -> dict[str, np.ndarray | tuple]:
    """Counts by text, words and lines of a block or part; lines keep their unsealed hashes."""
    n, data = block.n, block.data
    a, b, owner = block.words()
    prefix = block.prefix_hash()
    dark = ~tb._WS[data]
    la, lb, lowner = block.lines()
    inked = np.zeros(len(dark) + 1, np.int32)
    np.cumsum(dark, out=inked[1:])
    upper = np.zeros(len(dark) + 1, np.int32)
    np.cumsum((data >= 65) & (data <= 90), out=upper[1:])
    kinds = np.zeros((n, len(CLASSES)), np.int64)
    kind = _CLASS[data]
    for i in range(len(CLASSES)):
        kinds[:, i] = block.per_text(kind == i)
    return {
        "words": block.span_hash(prefix, a, b),
        "owner": owner,
        "size": (b - a).astype(np.int32),
        "upper": upper[b] - upper[a],
        "kinds": kinds,
        "word_chars": block.per_text(dark & _LEAD[data]),
        "n_symbols": block.per_text(_SYMBOLS[data]),
        "lines": (*block.span_raw(prefix, la, lb), lb - la, inked[lb] - inked[la], lowner),
    }


def _joined(parts: list[dict]) -> dict[str, np.ndarray | tuple]:
    """The scan of one text from the scans of its parts; a line may run over several parts."""
    lines = [[], [], [], []]
    for k, part in enumerate(parts):
        own = [x.tolist() for x in part["lines"][:4]]
        if k:
            x, y, length, ink = (v.pop() for v in lines)
            first = [v.pop(0) for v in own]
            x, y = tb.appended((x, y), (first[0], first[1]), length)
            for v, value in zip(lines, (x, y, length + first[2], ink + first[3]), strict=True):
                v.append(value)
        for v, more in zip(lines, own, strict=True):
            v.extend(more)
    out = {c: np.concatenate([p[c] for p in parts]) for c in ("words", "owner", "size", "upper")}
    out |= {c: sum(p[c] for p in parts) for c in ("kinds", "word_chars", "n_symbols")}
    return out | {"lines": (*[np.array(v, np.int64) for v in lines], np.zeros(len(lines[0]), np.int64))}


def base_counts(block: tb.Block, window: int = 8) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_lines (with a word), n_dup_lines, n_repeat_words, kinds
    (texts x classes numbers of code points), and arrays over words: words, owner, size, upper."""
    scans = [_scan(p) for p in block.parts()]
    found = scans[0] if len(scans) == 1 else _joined(scans)
    words, owner = found["words"], found["owner"]
    n_words = np.bincount(owner, minlength=block.n)

    lines = found.pop("lines")
    x, y, length, lowner = (v[lines[3] > 0] for v in (*lines[:3], lines[4]))
    lines = tb.sort_each(tb.seal((x, y), length), tb.bounds_of(lowner, block.n))
    dup = np.bincount(lowner[tb.runs(lines, lowner) > 0], minlength=block.n)

    repeat = np.zeros(block.n, np.int64)
    at = tb.bounds_of(owner, block.n)
    long_enough = n_words > window
    if long_enough.any():
        h = np.zeros(max(len(words) - window + 1, 0), np.uint64)
        for k in range(window):
            h = (h ^ words[k : k + len(h)]) * np.uint64(0x9FB21C651E98DF25)
            h ^= h >> np.uint64(32)
        for i in np.flatnonzero(long_enough):
            own = h[at[i] : at[i + 1] - window + 1]
            ordered = np.sort(own)
            twice = ordered[1:][ordered[1:] == ordered[:-1]]
            if len(twice):
                spot = np.searchsorted(twice, own)
                spot[spot == len(twice)] = 0
                hit = np.flatnonzero(twice[spot] == own)
                cover = np.zeros(len(own) + window, np.int32)
                np.add.at(cover, hit, 1)
                np.add.at(cover, hit + window, -1)
                repeat[i] = int((np.cumsum(cover) > 0).sum())
    return found | {"n_words": n_words, "n_lines": np.bincount(lowner, minlength=block.n), "n_dup_lines": dup, "n_repeat_words": repeat}


def word_hash(words: list[str]) -> np.ndarray:
    """Hashes of whole words, as in a block."""
    data = "".join(words).encode()
    lengths = np.array([len(w.encode()) for w in words], np.int64)
    ends = np.cumsum(lengths)
    block = tb.Block(np.frombuffer(data, np.uint8), np.zeros(1, np.int64), np.array([len(data)]), 0)
    return block.span_hash(block.prefix_hash(), ends - lengths, ends)


_MARK = np.zeros(256, bool)
_MARK[[c for c in range(33, 127) if not chr(c).isalnum()]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def bare_words(block: tb.Block) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of every word in small ASCII letters without ASCII marks at its ends.

    Words of marks only are left out.
    """
    hashes, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for part in block.parts():
        low = tb.Block(_LOWER[part.data], part.starts, part.ends, part.first)
        a, b, owner = low.words()
        mark = _MARK[low.data]
        at = np.arange(len(mark), dtype=np.int32)
        following = np.minimum.accumulate(np.where(mark, np.int32(len(mark)), at)[::-1])[::-1] if len(at) else at
        earlier = np.maximum.accumulate(np.where(mark, np.int32(-1), at)) if len(at) else at
        a, b = following[a].astype(np.int64), earlier[b - 1].astype(np.int64) + 1
        some = a < b
        hashes.append(low.span_hash(low.prefix_hash(), a[some], b[some]))
        owners.append(owner[some])
    return np.concatenate(hashes), np.concatenate(owners)
