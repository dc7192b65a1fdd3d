"""Column functions over text: trimming, ids, checksums, budgets, fences, assets, tags."""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Latin letters with marks and their plain letters, from Unicode's canonical decompositions.
_MARKED = [chr(c) for c in range(0xC0, 0x250) if len(unicodedata.normalize("NFD", chr(c))) > 1 and unicodedata.normalize("NFD", chr(c))[0].isascii()]
MARKED = "".join(_MARKED)
PLAIN = "".join(unicodedata.normalize("NFD", c)[0] for c in _MARKED)


def trimmed(c: Column) -> Column:
    """Text without Unicode white space at its ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def fold(c: Column) -> Column:
    """Small letters without Latin diacritics."""
    return F.translate(F.lower(c), MARKED, PLAIN)


def terms(c: Column) -> Column:
    """Index terms: runs of letters and digits, folded."""
    return F.regexp_extract_all(fold(c), F.lit(r"[\p{L}\p{N}]+"), 0)


def block_id(document: Column, sequence: Column, text: Column) -> Column:
    """Stable block id from its document, number and text."""
    return F.concat(F.lit("blk_"), F.sha2(F.concat_ws("\0", document.cast("string"), sequence.cast("string"), text), 256))


def doc_id(path: Column) -> Column:
    """Stable document id from its path."""
    return F.concat(F.lit("doc-uuid-"), F.sha2(path, 256))


def truncate_tokens(c: Column, tokens: int) -> Column:
    """At most 4 bytes a token, cut back to a whole character."""
    raw = c.cast("binary")
    cut = F.substring(raw, 1, 4 * tokens)
    choices = [F.substring(cut, 1, F.length(cut) - k) if k else cut for k in range(4)]
    whole = F.coalesce(*[F.when(F.is_valid_utf8(x.cast("string")), x.cast("string")) for x in choices])
    return F.when(F.length(raw) <= 4 * tokens, c).otherwise(whole)


def strip_fences(c: Column) -> Column:
    """Text without the Markdown code fence around it."""
    return trimmed(F.regexp_replace(F.regexp_replace(trimmed(c), r"^```[A-Za-z]*\s*", ""), r"\s*```$", ""))


def resolve_assets(c: Column, base: str) -> Column:
    """``local-asset://`` references replaced by a base directory; null becomes empty."""
    return F.coalesce(F.regexp_replace(c, "local-asset://", base.rstrip("/") + "/"), F.lit(""))


def asset_uris(c: Column) -> Column:
    """Distinct ``local-asset://`` references of a text, without the punctuation that follows them."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"local-asset://[^\s\"'\]\)<>]*[^\s\"'\]\)<>.,;:!?]"), 0))


def normalise_tag(c: Column) -> Column:
    """Small letters without white space."""
    return F.regexp_replace(F.lower(c), r"(?U)\s+", "")


def sanitise(c: Column) -> Column:
    """Query text with everything but word characters and white space blanked."""
    return F.trim(F.regexp_replace(c, r"[^\w\s]", " "))


def checksum(c: Column) -> Column:
    """32-bit multiply-and-xor checksum of the code points, hexadecimal without padding."""
    step = lambda h, x: (h * 33).bitwiseAND(4294967295).bitwiseXOR(F.ascii(x).cast("long"))
    start = F.lit(5381).cast("long")
    folded = F.when(c == "", start).otherwise(F.aggregate(F.split(c, ""), start, step))
    return F.lower(F.hex(folded))


#: Code points that :func:`_checksums` takes at once, rows filled up to the longest.
_CELLS = 1 << 20


def _checksums(texts: pd.Series) -> pd.Series:
    """Checksums of texts in UTF-32: of many texts, one place after the other, the longest first."""
    raw, sums = texts.to_numpy(), np.full(len(texts), None, dtype=object)
    sizes = np.array([-1 if r is None else len(r) // 4 for r in raw], dtype=np.int64)
    order = np.argsort(-sizes, kind="stable")[: int((sizes >= 0).sum())]
    while len(order):
        longest = int(sizes[order[0]])
        block, order = np.split(order, [max(1, _CELLS // max(1, longest))])
        held = np.zeros((len(block), longest), np.uint64)
        held[np.arange(longest) < sizes[block][:, None]] = np.frombuffer(b"".join(raw[block]), ">u4")
        at, h = np.ascontiguousarray(held.T), np.full(len(block), 5381, np.uint64)
        for place, n in zip(at, np.searchsorted(-sizes[block], -np.arange(longest)), strict=True):
            h[:n] = (h[:n] * np.uint64(33) & np.uint64(4294967295)) ^ place[:n]
        sums[block] = [f"{x:x}" for x in h.tolist()]
    return pd.Series(sums)


def packet_checksum(c: Column) -> Column:
    """:func:`checksum` for very many short texts, in Python; the session must have shipped this package."""
    return F.pandas_udf(_checksums, StringType())(F.encode(c, "UTF-32"))


def strip_elements(c: Column, names: tuple[str, ...] = ("head", "script")) -> Column:
    """HTML without the named elements; ``<header>`` is not ``<head>``."""
    for name in names:
        c = F.regexp_replace(c, rf"(?s)<{name}(?:>|[ \n][^>]*>).*?</{name}>", "")
    return c


def highlight_spans(c: Column) -> Column:
    """Texts inside ``<mark>`` and highlight ``<span>`` elements, without tags."""
    found = F.regexp_extract_all(c, F.lit(r'(?s)<(?:mark|span class="highlight")>(.*?)</(?:mark|span)>'), 1)
    return F.transform(found, lambda x: F.regexp_replace(x, "<[^>]*>", ""))


def word_count(c: Column) -> Column:
    """Number of runs of non-white-space."""
    return F.size(F.regexp_extract_all(c, F.lit(r"\S+"), 0))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 where a length differs, is 0, or a norm is 0."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)

    def norm(v: Column) -> Column:
        return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))

    scale = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (scale > 0), dot / scale).otherwise(F.lit(0.0))


def dot(a: Column, b: Column) -> Column:
    """Dot product; an error where the lengths differ."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), total).otherwise(F.raise_error(F.lit("vectors differ in length")).cast("double"))


def utc_time(c: Column) -> Column:
    """Time in UTC of a text ``YYYY-MM-DD HH:MM:SS`` or ISO-8601 with ``T``, fraction, ``Z`` or an offset; null for other texts.

    A text without an offset is in UTC, whatever the session's time zone.
    """
    zone = F.regexp_extract(c, r"(?:Z|[+-]\d{2}:?\d{2})$", 0)
    local = F.regexp_replace(c, r"(?<=:\d{2}|\.\d{1,9})(?:Z|[+-]\d{2}:?\d{2})$", "")
    whole = F.when(local.rlike(r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?$"), local)
    minutes = F.regexp_extract(zone, r"(\d{2}):?(\d{2})", 1).try_cast("int") * 60 + F.regexp_extract(zone, r"(\d{2}):?(\d{2})", 2).try_cast("int")
    ahead = F.when(zone.startswith("-"), -minutes).otherwise(minutes)
    return whole.try_cast("timestamp_ntz") - F.make_dt_interval(mins=F.coalesce(ahead, F.lit(0)))
