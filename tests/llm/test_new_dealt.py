"""Periodic runs, tree encoding and spelling variants against brute force and the tokenizers library."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellumspark.llm import periodic, registry, search, spelling, treebpe

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LETTERS = re.compile("[A-Za-zÀ-ÿ]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def odd(spark):
    """Null and empty texts, ties, repeated rows, nulls in every column, and extra columns with clashing names."""
    rows = [
        (1, "alpha beta " * 9, "en", "a", 5), (1, "alpha beta " * 9, "en", "a", 5), (2, None, "en", "a", None), (3, "", None, None, 0), (4, " \t\n ", "xx", None, 4),
        (None, "misspelt " * 300, "de", "b", 1500), (5, "solo", "en", "c", 4), (6, "Grüße aus der wörtlichen Wörtlichkeit, wortlichkeit wortlichkeit", "de", "c", 4),
    ]
    extra = {c: F.lit(7) for c in ("id", "ids", "words", "word", "n", "runs", "row", "part", "key", "collapsed", "n_words")}
    return spark.createDataFrame(rows, DOCS).withColumns(extra)


# 11 periodic runs
def brute_runs(words: list[str], least: int) -> tuple[list, str]:
    """All runs, period by period, and the text without their repeats."""
    found: dict = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, 2 * q) and j > i:
                found.setdefault((i, j - i + q), q)
            i = j + 1
    runs = sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))
    dropped = {k for s, n, q in runs for k in range(s + q, s + n)}
    return runs, " ".join(w for k, w in enumerate(words) if k not in dropped)


def planted(doc_id: int, words: list[str]) -> list[str]:
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


@pytest.mark.parametrize("least", [12, 5])
def test_runs_of_random_words(spark, least):
    rng = random.Random(least)
    texts = []
    for _ in range(400):
        words = [rng.choice("abcdefgh"[: rng.choice([1, 2, 2, 3, 5])]) for _ in range(rng.choice([0, 1, 11, 12, 13, 40, 90]))]
        unit = words[: rng.randint(1, 8)] or ["z"]
        texts.append(rng.choice([" ", "\n", "\t "]).join(words + unit * rng.randint(0, 9) + words[: rng.randint(0, 5)] + unit * rng.randint(0, 6)))
    a, b = "a", "a b"
    while len(b) < 700:
        a, b = b, b + " " + a
    texts += [b, "x " * 500, "a b " * 100 + "c " + "a b " * 50, "é ü " * 30, " ".join(f"k{i} one two three four five six seven" for i in range(300))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in periodic.periodic_runs(docs, least=least).collect():
        runs, collapsed = brute_runs(WORD.findall(texts[r.doc_id]), least)
        assert ([tuple(x) for x in r.runs], r.collapsed) == (runs, collapsed)


def test_runs_of_long_texts(spark):
    rng = random.Random(1)
    word = [str(rng.random()) for _ in range(120_000)]
    texts = ["x " * 400_000, " ".join(word[:60_000] * 2), "y" * 3_000_000, " ".join(word[:70_000]) + " z" * 40]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: ([tuple(x) for x in r.runs], len(r.collapsed)) for r in periodic.periodic_runs(docs).collect()}
    assert found == {0: ([(0, 400_000, 1)], 1), 1: ([(0, 120_000, 60_000)], len(" ".join(word[:60_000]))), 2: ([], 3_000_000), 3: ([(70_000, 40, 1)], len(" ".join(word[:70_000])) + 2)}


def test_op11_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    found = {r.doc_id: r for r in registry.queries()["op11_periodic_runs"](spark, sf).collect()}
    assert len(found) == len(docs)
    some = 0
    for d in docs:
        runs, collapsed = brute_runs(planted(d.doc_id, WORD.findall(d.text or "")), 12)
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
        r = found[d.doc_id]
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (None if best[0] is None else 1000 * best[1] // best[2])
        assert r.runs_sha256 == sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)) and r.collapsed_sha256 == sha(collapsed)
        some += len(runs)
    assert some > 5


def test_runs_of_odd_inputs(spark):
    found = collections.Counter((r.doc_id, r.n_words, len(r.runs), r.collapsed) for r in periodic.periodic_runs(odd(spark)).collect())
    grüße = "Grüße aus der wörtlichen Wörtlichkeit, wortlichkeit wortlichkeit"
    assert found == {(1, 18, 1, "alpha beta"): 2, (2, 0, 0, ""): 1, (3, 0, 0, ""): 1, (4, 0, 0, ""): 1, (None, 300, 1, "misspelt"): 1, (5, 1, 0, "solo"): 1, (6, 7, 0, grüße): 1}
    assert periodic.periodic_runs(odd(spark).limit(0)).count() == 0
    assert periodic.with_periodic_tails(odd(spark)).where("doc_id IS NULL").first().text == "misspelt " * 300


# 12 encoding and decoding
@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


ALPHABETS = ["abcdefgh", " ab", "a1", "'sre ll'tve dm", "\n \t ab", "!?.,'a ", "中文字漢かな", "中。、文 ", "😀é́a ", "A", "   a", "\x1c\x1d a'", "0123456789", "͸׿'a"]


def random_texts(n: int, seed: int) -> list[str]:
    rng, texts = random.Random(seed), []
    for _ in range(n):
        text = "".join(rng.choice(rng.choice(ALPHABETS) if rng.random() < 0.1 else ALPHABETS[rng.randrange(len(ALPHABETS))]) for _ in range(rng.randint(0, 60)))
        one = rng.choice(ALPHABETS)
        text += "".join(rng.choice(one) for _ in range(rng.randint(0, 120))) + rng.choice(["", "'re", "really", "  x", "'"])
        at = rng.randint(0, len(text))
        texts.append(text[:at] + "<|endoftext|>" * (rng.random() < 0.2) + text[at:])
    return texts


@pytest.mark.parametrize("leaf", [1, 3, 16, 100_000])
def test_tree_encoding_equals_the_library(spark, library, leaf):
    texts = [*random_texts(400, leaf), "a" * 3000, " " * 3000, "'" * 999, "a1" * 999, "the end " * 500, "漢" * 2000, "<|endoftext|>" * 3]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ids = treebpe.encode(docs, "byte_bpe_50k.json", "byte_bpe_50k.tiktoken", leaf=leaf)
    expected = [library.encode(t, add_special_tokens=False).ids for t in texts]
    for r in treebpe.decode(ids.withColumn("kept", F.col("ids")), "byte_bpe_50k.json").collect():
        assert list(r.kept) == expected[r.doc_id]
        assert r.text == library.decode(expected[r.doc_id], skip_special_tokens=False) == texts[r.doc_id]


def test_windows_of_long_runs_stay_small(library):
    """A join inside a run of letters encodes a few ids again, not the run."""
    rng = random.Random(5)
    text = "".join(rng.choice("abcdefghijklmnop") for _ in range(200_000))
    encoder, seen = treebpe.TreeEncoder("byte_bpe_50k.json"), []
    plain = encoder.merged
    encoder.merged = lambda raw: (seen.append(len(raw)), plain(raw))[1]
    parts = [np.array(library.encode(x, add_special_tokens=False).ids, np.uint32) for x in treebpe.halves(text, 5000)]
    assert encoder.tree(parts).tolist() == library.encode(text, add_special_tokens=False).ids
    assert len(seen) >= 63 and sum(seen) < 10_000


def test_op12_against_the_library(spark, sf, library):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    found = {r.doc_id: r for r in registry.queries()["op12_encode_decode"](spark, sf).collect()}
    assert len(found) == len(docs)
    for d in docs:
        ids = library.encode(d.text or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        r = found[d.doc_id]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(text))


def test_encoding_of_odd_inputs(spark, library):
    for leaf in (4, 32_768):
        found = collections.Counter((r.doc_id, tuple(r.ids)) for r in treebpe.encode(odd(spark), "byte_bpe_50k.json", leaf=leaf).collect())
        expected = collections.Counter((r.doc_id, tuple(library.encode(r.text or "", add_special_tokens=False).ids)) for r in odd(spark).collect())
        assert found == expected
    assert treebpe.encode(odd(spark).limit(0), "byte_bpe_50k.json").count() == 0
    lists = spark.createDataFrame([(1, None), (2, []), (3, [None, 11, -5, 99_999_999, 11]), (4, [50256])], "doc_id long, ids array<int>").withColumn("text", F.lit(1))
    assert {r.doc_id: r.text for r in treebpe.decode(lists, "byte_bpe_50k.json").collect()} == {1: "", 2: "", 3: ",,", 4: "<|endoftext|>"}


# 13 spelling variants
def edits(word: str, letters: str) -> set[str]:
    found = {word[:i] + word[i + 1 :] for i in range(len(word))}
    for c in letters:
        found |= {word[:i] + c + word[i:] for i in range(len(word) + 1)} | {word[:i] + c + word[i + 1 :] for i in range(len(word))}
    return found - {word}


def brute_variants(n: dict[str, int]) -> set[tuple]:
    letters = "".join(sorted(set("".join(n))))
    near = {w: [x for x in edits(w, letters) if x in n] for w in n}
    best = {w: min(x, key=lambda v: (-n[v], v)) for w, x in near.items() if x}
    form = {w: x for w, x in best.items() if n[x] >= 10 * n[w]}

    def root(w: str) -> str:
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), n[w], len(near[w]), n[form[w]] if w in form else None) for w in n}


@pytest.mark.parametrize(("letters", "subtrie", "groups"), [("abcd", 10, 12), ("abcdefghijklmnop", 40, 6), ("ab", 20, 3), ("aé漢😀b", 1000, 5)])
def test_variants_of_random_words(spark, letters, subtrie, groups):
    rng, n = random.Random(subtrie), {}
    for _ in range(700):
        word = "".join(rng.choice(letters) for _ in range(rng.choice([1, 2, 5, 7, 8, 9])))
        for w in (word, word[1:], rng.choice(letters) + word, word[:2] + rng.choice(letters) + word[3:]):
            if w:
                n[w] = rng.choice([1, 2, 10, 30, 100, 1000, 20_000])
    words = spark.createDataFrame(list(n.items()), "word string, n long").withColumn("key", F.lit("clash"))
    found = {tuple(r) for r in spelling.variant_groups(words, groups=groups, subtrie=subtrie).collect()}
    assert found == brute_variants(n)


def test_op13_against_brute_force(spark, sf):
    counts: collections.Counter = collections.Counter()
    for d in spark.read.parquet(f"{sf}/documents.parquet").collect():
        for run in LETTERS.findall(d.text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{d.doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += len(run) >= 7
    expected = brute_variants({w: n for w, n in counts.items() if n >= 2})
    found = registry.queries()["op13_spelling_variants"](spark, sf).select("word", "form", "root", "n", "n_near", "form_n")
    rows = [tuple(r) for r in found.collect()]
    assert set(rows) == expected and len(rows) == len(expected) and any(r[1] for r in rows)


def test_variants_of_odd_inputs(spark):
    rows = {r.word: (r.form, r.root, r.n, r.n_near) for r in spelling.variant_groups(spelling.misspelt_words(odd(spark), occurrences=1)).collect()}
    assert rows["misspelt"][1:3] == ("misspelt", 300) and rows["wortlichkeit"][3] >= 1
    given = [(None, 4), ("", 9), ("alphabet", None), ("alphabet", 1), ("alphabet", 1), ("alphabets", 20), ("y" * 200_000, 3), ("y" * 200_001, 30), ("a", 1)]
    words = spark.createDataFrame(given, "word string, n long")
    rows = {r.word[:9] + str(len(r.word)): (len(r.root), r.n, r.n_near) for r in spelling.variant_groups(words).collect()}
    assert rows == {"alphabet8": (9, 2, 1), "alphabets9": (9, 20, 1), "yyyyyyyyy200000": (200_001, 3, 1), "yyyyyyyyy200001": (200_001, 30, 1), "a1": (1, 1, 0)}
    assert spelling.variant_groups(words.limit(0)).count() == 0


# 9 search
def test_pairs_of_buckets_in_lanes(spark, monkeypatch):
    """Many small buckets, dealt to lanes, give the exact products of a plain search; norms are all equal in half the rows."""
    for name, value in (("BUCKET_ROWS", 16), ("BLOCK_ROWS", 2), ("LANE_BUCKETS", 3)):
        monkeypatch.setattr(search, name, value)
    rng = np.random.default_rng(3)
    v = rng.normal(size=(500, 6))
    v[::2] /= np.linalg.norm(v[::2], axis=1)[:, None]
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(1000, [1.0, 2.0]), (1001, [3.0, 1.0])]
    found = search.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=4).collect()
    whole = np.floor(1024 * v).astype(np.int64)
    expected = {(1000, 1, 1001, 3072 * 1024 + 1024 * 2048)}
    for q in range(0, 500, 100):
        best = sorted((-int(s), i) for i, s in enumerate(whole @ whole[q]) if i != q)[:4]
        expected |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(best)}
    assert {tuple(r) for r in found} == expected
