"""Chunks by pointer doubling against the loop over paragraphs and sentences."""

import random
import re

import numpy as np
import pytest

from vellumspark.operators import extract as ex


def count(text: str) -> int:
    return len(re.findall(r"[^ \t\n\x0b\f\r]+", text))


def loop(text: str, most: int) -> list[tuple[str, int]]:
    """Paragraphs one by one; a large one sentence by sentence."""
    out, held, n = [], [], 0
    for paragraph in text.split("\n\n"):
        words = count(paragraph)
        if n + words <= most:
            held, n = [*held, paragraph], n + words
            continue
        if held:
            out.append(("\n\n".join(held), n))
        if words <= most:
            held, n = [paragraph], words
            continue
        group, n = [], 0
        for sentence in paragraph.split(". "):
            w = count(sentence)
            if group and n + w > most:
                out.append((". ".join(group), n))
                group, n = [], 0
            group, n = [*group, sentence], n + w
        held = [". ".join(group)]
    return [*out, ("\n\n".join(held), n)] if held else out


@pytest.mark.parametrize("most", [1, 3, 8, 150])
def test_chunks_equal_the_loop(spark, most):
    rng, texts = random.Random(most), ["", None, "\n\n", "\n\n\n\n", ". ", "a. b", "one " * 900, ". ".join(["x y z"] * 700), "\n\n".join(["a b. c d e. f"] * 50)]
    for _ in range(150):
        words = [rng.choice(["a", "bb", "ccc.", "d.", "\n\n", "\n\n", ".", "é\t", "\n"]) for _ in range(rng.randint(0, 60 if most < 150 else 900))]
        texts.append("".join(w if w in ("\n\n", "\n") else w + rng.choice([" ", " ", "  ", ""]) for w in words))
    docs = spark.createDataFrame(list(enumerate(texts)), "document_id int, text string")
    got: dict = {}
    for r in sorted(ex.chunk(docs, most).collect(), key=lambda r: (r.document_id, r.seq)):
        got.setdefault(r.document_id, []).append((r.text, r.word_count))
        assert r.seq == len(got[r.document_id]) - 1
    assert got == {i: loop(t or "", most) for i, t in enumerate(texts)}


def test_doubling_needs_few_rounds():
    words = np.ones(100_000, np.int64)
    starts = ex.chunk_starts(words, np.array([0, 60_000, 40_000]), 7)
    assert [x.tolist() for x in starts] == [[], list(range(0, 60_000, 7)), list(range(0, 40_000, 7))]
