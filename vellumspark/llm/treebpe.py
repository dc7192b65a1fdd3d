"""Byte-level BPE encoding by tree concatenation, and decoding, of whole text columns.

A text of at most ``leaf`` characters is encoded as it is. A longer one is halved until its parts
are that short; the parts are rows of their own, encoded in parallel by any tasks. Then the halves
are joined, two by two, up to the whole text. At each join a window of the last ids of the left
and the first ids of the right half is encoded again and grows, doubling, until it agrees with
both halves:

- Inside one unsplit run (letters, digits or signs without apostrophes) the window's bytes are
  merged again; it agrees if it begins with the left half's and ends with the right half's own id.
  A sequence of BPE ids is the encoding of its bytes exactly if that holds for all neighbours, and
  all pairs but those inside the window stand unchanged in one of the halves.
- Elsewhere it agrees at a boundary on each side that the pre-tokenizer must cut whatever stands
  around it (a change of character class behind no white space and no apostrophe), where both
  halves cut as well; the text between the two is encoded again.

A window that has grown over both halves is the plain encoding. Special tokens cut a text before
anything else, as in the library. The vocabulary is a ``tokenizers`` file of a byte-level BPE.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumspark.llm import textblock as tb
from vellumspark.llm.bytepair import Encoder, _place
from vellumspark.session import materialise, ship

#: Ids on each side of a join in the first window.
REACH = 8


@functools.lru_cache(1)
def byte_chars() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


@functools.lru_cache(2)
def token_bytes(path: str) -> tuple[list[bytes], list[str]]:
    """(bytes of every id, special tokens) of a vocabulary file; ids that it lacks have no bytes."""
    with open(_place(path), encoding="utf-8") as file:
        found = json.load(file)
    of = {c: b for b, c in byte_chars().items()}
    added = found.get("added_tokens", [])
    table = [b""] * (1 + max([*found["model"]["vocab"].values(), *(t["id"] for t in added)]))
    for token, i in found["model"]["vocab"].items():
        table[i] = bytes(of[c] for c in token) if all(c in of for c in token) else token.encode()
    for t in added:
        table[t["id"]] = t["content"].encode()
    return table, [t["content"] for t in added]


class TreeEncoder(Encoder):
    """Ids as the library gives them, special tokens included, and joins of the ids of two texts."""

    def __init__(self, path: str, ranks: str | None = None):
        super().__init__(path, ranks)
        table, self.special = token_bytes(path)
        self.table, self.sizes = table, np.array([len(x) for x in table])

    @functools.cached_property
    def model(self):
        return self._load(self.path)

    def encode(self, block: tb.Block, most: int = tb.BLOCK_BYTES) -> tuple[np.ndarray, np.ndarray]:
        raw = block.data.tobytes()
        if not any(s.encode() in raw for s in self.special):
            return super().encode(block, most)
        return self._whole([raw[i:j].decode() for i, j in zip(block.starts, block.ends, strict=True)])

    def merged(self, raw: bytes) -> np.ndarray:
        """Ids of the bytes of one piece."""
        chars = byte_chars()
        return np.array([t.id for t in self.model.model.tokenize("".join([chars[b] for b in raw]))], np.uint32)

    def _cuts(self, x: str, y: str) -> bool:
        """Whether the pre-tokenizer cuts between two characters whatever stands around them."""
        return not x.isspace() and x != "'" and len(self.model.pre_tokenizer.pre_tokenize_str(x + y)) == 2

    def _one_run(self, text: str) -> bool:
        return "'" not in text and not any(c.isspace() for c in text) and len(self.model.pre_tokenizer.pre_tokenize_str(text)) == 1

    def joined(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ids of a text from those of its halves; the halves hold no special tokens."""
        if not len(left) or not len(right):
            return np.concatenate([left, right])
        reach = REACH
        while True:
            a, b = left[-reach:], right[:reach]
            all_left, all_right = reach >= len(left), reach >= len(right)
            before, behind = (b"".join(map(self.table.__getitem__, x.tolist())) for x in (a, b))
            try:
                x, y = before.decode(), behind.decode()
            except UnicodeDecodeError:  # an end of the window inside a character
                reach += 1
                continue
            text, cut = x + y, len(x)
            if self._one_run(text) and (cut >= 3 or all_left):
                ids = self.merged(before + behind)
                if (all_left or ids[0] == a[0]) and (all_right or ids[-1] == b[-1]):
                    return np.concatenate([left[: len(left) - len(a)], ids, right[len(b) :]])
            else:
                low = next((i for i in range(cut, 0, -1) if i < len(text) and self._cuts(text[i - 1], text[i])), 0 if all_left else None)
                high = next((i for i in range(cut, len(text)) if i and self._cuts(text[i - 1], text[i])), len(text) if all_right else None)
                if low is not None and high is not None:
                    middle = self._whole([text[low:high]])[0] if high > low else left[:0]
                    n = int(np.searchsorted(np.cumsum(self.sizes[a]), len(text[:low].encode()), side="left")) + 1 if low else 0
                    m = int(np.searchsorted(np.cumsum(self.sizes[b]), len(text[cut:high].encode()), side="left")) + 1 if high > cut else 0
                    return np.concatenate([left[: len(left) - len(a) + n], middle, right[m:]])
            reach *= 2

    def tree(self, parts: list[np.ndarray]) -> np.ndarray:
        """Ids of a text from those of its parts, in order, joined two by two."""
        while len(parts) > 1:
            pairs = [self.joined(parts[i], parts[i + 1]) for i in range(0, len(parts) - 1, 2)]
            parts = pairs + parts[2 * len(pairs) :]
        return parts[0]


@functools.lru_cache(1)
def _joiner(path: str) -> TreeEncoder:
    """The encoder of a worker's joins; it keeps the vocabulary alone."""
    return TreeEncoder(path)


def _ids_batch(first: pa.Array, ids: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
    return pa.RecordBatch.from_arrays([first, pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int32)))], ["id", "ids"])


@tb.tidied
def _encode(batches: Iterator[pa.RecordBatch], path: str, ranks: str | None) -> Iterator[pa.RecordBatch]:
    """(id, text) -> (id, ids)."""
    encoder = TreeEncoder(path, ranks)
    for batch in batches:
        for block in tb.blocks(batch.column(1)):
            yield _ids_batch(batch.column(0).slice(block.first, block.n), *encoder.encode(block))


@tb.tidied
def _encode_parts(batches: Iterator[pa.RecordBatch], path: str, ranks: str | None) -> Iterator[pa.RecordBatch]:
    """(id, row, unsplit, part, text) -> (id, row, unsplit, part, ids)."""
    encoder = TreeEncoder(path, ranks)
    for batch in batches:
        for block in tb.blocks(batch.column(4)):
            names = [batch.column(i).slice(block.first, block.n) for i in range(4)]
            ids = _ids_batch(names[0], *encoder.encode(block)).column(1)
            yield pa.RecordBatch.from_arrays([*names, ids], ["id", "row", "unsplit", "part", "ids"])


def halves(text: str, leaf: int) -> list[str]:
    """A text halved until every part has at most ``leaf`` characters; all parts are of one depth."""
    n, parts = len(text), 1
    while -(-n // parts) > leaf:
        parts *= 2
    at = [n * i // parts for i in range(parts + 1)]
    return [text[i:j] for i, j in zip(at[:-1], at[1:], strict=True)]


def unsplit(text: str, special: list[str]) -> list[str]:
    """A text cut around its special tokens: the longest one at the earliest place, as the library takes them."""
    found, at = [], 0
    while special:
        spots = [(text.find(s, at), -len(s)) for s in special]
        spots = [x for x in spots if x[0] >= 0]
        if not spots:
            break
        begin, size = min(spots)
        found += [text[at:begin], text[begin : begin - size]]
        at = begin - size
    return [x for x in [*found, text[at:]] if x]


@tb.tidied
def _halve(batches: Iterator[pa.RecordBatch], path: str, leaf: int) -> Iterator[pa.RecordBatch]:
    """(id, row, text) -> (id, row, unsplit, part, text), one row a part of at most ``leaf`` characters."""
    _, special = token_bytes(path)
    for batch in batches:
        for i in range(batch.num_rows):
            pieces = unsplit(batch.column(2)[i].as_py(), special)
            rows = [(k, j, part) for k, piece in enumerate(pieces) for j, part in enumerate([piece] if piece in special else halves(piece, leaf))]
            who = pa.array(np.full(len(rows), i))
            k, j, text = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(who), batch.column(1).take(who), pa.array(k, pa.int64()), pa.array(j, pa.int64()), pa.array(text, pa.string())],
                ["id", "row", "unsplit", "part", "text"],
            )


def encode(docs: DataFrame, vocabulary: str, ranks: str | None = None, id_col: str = "doc_id", text_col: str = "text", leaf: int = 32_768) -> DataFrame:
    """One row per row of ``docs``: [id_col, ids], as the library encodes the whole text without added special tokens.

    ``vocabulary`` is a ``tokenizers`` file of a byte-level BPE, by its place on the workers or its
    name in ``public_tokenizers``; ``ranks`` may name the same vocabulary for ``tiktoken``. The
    result doesn't depend on ``leaf``.

    Defined cases: a null text counts as empty and has no ids; strings of special tokens become
    their ids; a null id is kept as null; repeated rows are encoded each; a text of any length is
    encoded in parts, and only its ids come together in one task, as they are one row; an empty
    table gives an empty result; other columns are ignored.
    """
    ship(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    short = base.where(F.length("text") <= leaf).mapInArrow(partial(_encode, path=vocabulary, ranks=ranks), f"id {kind}, ids array<int>")
    named = f"id {kind}, row bigint, unsplit bigint, part bigint"
    long = base.where(F.length("text") > leaf).select("id", F.monotonically_increasing_id().alias("row"), "text")
    parts = materialise(long.mapInArrow(partial(_halve, path=vocabulary, leaf=leaf), named + ", text string"), "text-parts")
    # any task may encode any part; the ids of one text then meet in the task that writes its row
    ids = parts.repartition("row", "unsplit", "part").mapInArrow(partial(_encode_parts, path=vocabulary, ranks=ranks), named + ", ids array<int>")

    def whole(rows: pa.Table) -> pa.Table:
        encoder = _joiner(vocabulary)
        rows = rows.sort_by([("unsplit", "ascending"), ("part", "ascending")]).combine_chunks()
        at = rows["unsplit"].to_numpy()
        pieces = []
        for k in np.unique(at):
            own = [rows["ids"][int(i)].values.to_numpy().astype(np.uint32) for i in np.flatnonzero(at == k)]
            pieces.append(encoder.tree(own))
        found = np.concatenate(pieces)
        return pa.Table.from_batches([_ids_batch(rows["id"].slice(0, 1).combine_chunks(), found, np.array([len(found)]))])

    return short.unionByName(ids.groupBy("row").applyInArrow(whole, f"id {kind}, ids array<int>")).withColumnRenamed("id", id_col)


@tb.tidied
def _decode(batches: Iterator[pa.RecordBatch], path: str, passed: list[str]) -> Iterator[pa.RecordBatch]:
    """(ids, other columns) -> (other columns, text)."""
    table, _ = token_bytes(path)
    known = len(table)
    for batch in batches:
        ids = batch.column(0)
        texts = []
        for i in range(len(ids)):
            own = ids[i].values
            own = own.drop_null().to_numpy() if own is not None else np.zeros(0, np.int32)
            if len(own) and (own.min() < 0 or own.max() >= known):
                own = own[(own >= 0) & (own < known)]
            texts.append(b"".join(map(table.__getitem__, own.tolist())).decode("utf-8", "replace"))
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(texts, pa.string())], [*passed, "text"])


def decode(encoded: DataFrame, vocabulary: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """The other columns, and the text of ``ids_col`` as ``text_col``, special tokens written out.

    Defined cases: null and empty lists give an empty text; null ids and ids that the vocabulary
    lacks are left out; bytes that are no UTF-8 become U+FFFD; repeated rows are decoded each; an
    empty table gives an empty result; a column named as ``text_col`` is replaced.
    """
    ship(encoded.sparkSession)
    others = [c for c in encoded.columns if c not in (ids_col, text_col)]
    work = encoded.select(F.col(ids_col), *[F.col(c) for c in others])
    schema = "".join(f"`{c}` {t}, " for c, t in work.dtypes[1:]) + "text string"
    return work.mapInArrow(partial(_decode, path=vocabulary, passed=others), schema).withColumnRenamed("text", text_col)


def op12_encode_decode(spark, sf_dir: str) -> DataFrame:
    """Number and digest of the ids of every document, and the digest of the text that they decode to."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ids = encode(docs, "byte_bpe_50k.json", "byte_bpe_50k.tiktoken")
    # the digest of the ids is taken first, so that the decoder passes on a row's id and no second list
    digest = F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256)
    listed = ids.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest.alias("ids_sha256"), "ids")
    return decode(listed, "byte_bpe_50k.json").select("doc_id", "n_tokens", "ids_sha256", F.sha2("text", 256).alias("decoded_sha256"))
