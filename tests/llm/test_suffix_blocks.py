"""Repeated byte strings against a dictionary of all strings."""

import hashlib
import random

import pytest

from tidemill.llm import suffix_blocks

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def plain(texts, length):
    raws = [(t or "").encode() for t in texts]
    seen = {}
    for r in raws:
        for i in range(len(r) - length + 1):
            seen[r[i : i + length]] = seen.get(r[i : i + length], 0) + 1
    out = []
    for r in raws:
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(gone[i] and not (i and gone[i - 1]) for i in range(len(r)))
        kept = bytes(c for c, g in zip(r, gone) if not g)
        out.append((len(r), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def made(rng, length):
    def text(n, alphabet="abcdefgh é"):
        return "".join(rng.choice(alphabet) for _ in range(n))

    passages = [text(rng.randint(length - 3, 3 * length)) for _ in range(6)]
    docs = []
    for _ in range(60):
        parts = [text(rng.randint(0, length))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            cut = rng.randint(0, 5)
            parts += [p[cut : len(p) - rng.randint(0, 5)], text(rng.randint(0, 30))]
        docs.append("".join(parts))
    docs += [docs[3], docs[4], docs[4], "a" * (3 * length), "ab" * length, text(5 * length, "ab"), "", None, "x" * (length - 1)]
    docs.append(docs[7][:length] + "!" + docs[7][length:])
    docs.append(passages[0] + text(9) + passages[0])
    return docs


@pytest.mark.parametrize("bucket", [suffix_blocks.BUCKET, 1, 4])
def test_against_all_strings(spark, bucket):
    """Small bucket limits send the same contexts through hashed windows."""
    docs = made(random.Random(8), 60)
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(docs)], SCHEMA)
    got = suffix_blocks.dedup(df, 60, 20, bucket).orderBy("doc_id").collect()
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got] == plain(docs, 60)
    assert all(hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 for r in got)


def test_chunks(monkeypatch):
    import numpy as np

    rng = random.Random(2)
    data = np.frombuffer(bytes(rng.choice(b"abcd") for _ in range(5000)) + b"a" * 900, np.uint8)
    whole = suffix_blocks.anchors(data)
    monkeypatch.setattr(suffix_blocks, "_CHUNK", 1000)
    for a, b in zip(whole, suffix_blocks.anchors(data)):
        assert (a == b).all()


def test_odd_rows(spark):
    rows = [(None, None), (None, "b" * 900), (1, "c" * 500 + "d"), (1, "c" * 500 + "d"), (2, " ".join(f"w{i}" for i in range(40_000)))]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA).selectExpr("*", "1 as _w", "2 as n_bytes", "3 as kept")
    got = sorted((r.n_bytes, r.n_removed, r.n_spans) for r in suffix_blocks.dedup(df).collect())
    assert got == sorted((a, b, c) for a, b, c, _ in plain([t for _, t in rows], 400))
    assert suffix_blocks.dedup(df.limit(0)).count() == 0


def passages(texts, words):
    """Words in strings of ``words`` words that another row holds too."""
    split = [(t or "").split() for t in texts]
    held = {}
    for i, w in enumerate(split):
        for at in range(len(w) - words + 1):
            held.setdefault(tuple(w[at : at + words]), set()).add(i)
    out = []
    for w in split:
        covered = set()
        for at in range(len(w) - words + 1):
            if len(held[tuple(w[at : at + words])]) > 1:
                covered |= set(range(at, at + words))
        out.append(len(covered))
    return out


@pytest.mark.parametrize("bucket", [suffix_blocks.BUCKET, 1, 4])
def test_passages_against_all_word_strings(spark, bucket):
    rng = random.Random(5)
    word = lambda n, letters="abcd": ["".join(rng.choice(letters) for _ in range(rng.randint(1, 3))) for _ in range(n)]
    shared, own = [word(rng.randint(9, 30)) for _ in range(6)], word(12)
    docs = []
    for _ in range(60):
        parts = word(rng.randint(0, 15))
        for _ in range(rng.randint(0, 3)):
            p, cut = rng.choice(shared), rng.randint(0, 3)
            parts += p[cut : len(p) - rng.randint(0, 3)] + word(rng.randint(0, 6))
        docs.append(rng.choice([" ", "\n", "\t "]).join(parts))
    docs += [" ".join(own + word(3) + own), "ou " * 40, "ou " * 25 + "la", docs[3], docs[3], "", None, " \n"]
    docs += [" ".join(shared[0] + ["xy"] + shared[0]), " ".join(["zz"] * 11), " ".join(word(80, "a"))]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(docs)], SCHEMA)
    got = suffix_blocks.dedup(df, 60, 20, bucket, 10, 3, bucket).orderBy("doc_id").collect()
    assert [r.n_passage_words for r in got] == passages(docs, 10)
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got] == plain(docs, 60)


def test_passage_below_400_bytes(spark):
    rng = random.Random(6)
    word = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))
    shared = word(55)
    docs = [f"{word(70)} {shared} {word(90)}", f"{word(30)}\n{shared}\n{word(9)}", word(200), f"{word(60)} {shared[:150]} {word(60)}"]
    assert len(shared) < 390
    # Repeated in one document only.
    docs.append(f"{(again := word(54))} {word(7)} {again}")
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(docs)], SCHEMA)
    got = suffix_blocks.dedup(df).orderBy("doc_id").collect()
    assert [(r.n_removed, r.n_passage_words) for r in got] == [(0, 55), (0, 55), (0, 0), (0, 0), (0, 0)]
