"""The near-duplicate join against all pairs."""

import random

import numpy as np
import pytest

from tidemill.llm import near_join

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    words = (text or "").lower().split()
    n = min(5, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()


def plain(docs):
    """Links and classes by looking at every pair."""
    sets = [shingles(t) for _, t in docs]
    links, root = [0] * len(docs), list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                root[max(find(i), find(j))] = min(find(i), find(j))
    ids = {}
    for i, (d, _) in enumerate(docs):
        ids.setdefault(find(i), []).append(d)
    return sorted((d, min(ids[find(i)]), links[i]) for i, (d, _) in enumerate(docs))


def made(rng, families, size, words=120):
    docs, i = [], 0
    for _ in range(families):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(3, words))]
        for _ in range(rng.randint(1, size)):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
                text[rng.randrange(len(text))] = f"x{rng.randrange(10**6)}"
            docs.append((i, " ".join(text) if rng.random() < 0.8 else "  ".join(text).upper()))
            i += 1
    rng.shuffle(docs)
    return docs


def frame(spark, docs):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in docs], SCHEMA)


@pytest.mark.parametrize("block, hot", [(near_join.BLOCK, near_join.HOT), (7, near_join.HOT), (7, 3)])
def test_against_all_pairs(spark, monkeypatch, block, hot):
    """Small blocks send the same families over many cells; small bands count as hot and are split."""
    monkeypatch.setattr(near_join.in_cells, "__defaults__", (block,))
    monkeypatch.setattr(near_join, "HOT", hot)
    docs = made(random.Random(5), 40, 12) + made(random.Random(6), 1, 60)
    docs = [(i, t) for i, (_, t) in enumerate(docs)]
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in near_join.near_duplicates(frame(spark, docs)).collect())
    assert got == plain(docs)
    assert max(x[2] for x in got) > 5
    kept = {r.doc_id for r in near_join.keep_one(frame(spark, docs)).collect()}
    assert kept == {c for _, c, _ in got}


def test_pruning_keeps_similar_pairs():
    rng = np.random.default_rng(1)
    least, lost, pairs = near_join.least_matches(), 0, 300
    for _ in range(pairs):
        both = rng.integers(0, 2**63, 400, dtype=np.uint64)
        one, two = rng.integers(0, 2**63, 50, dtype=np.uint64), rng.integers(0, 2**63, 50, dtype=np.uint64)
        sig = np.vstack([near_join.signature(np.concatenate([both, x])) for x in (one, two)])
        lost += not len(near_join.likely_pairs(np.array([0]), np.array([1]), sig, least)[0])
    assert lost == 0  # similarity 0.8
    far = np.vstack([near_join.signature(rng.integers(0, 2**63, 300, dtype=np.uint64)) for _ in range(2)])
    assert not len(near_join.likely_pairs(np.array([0]), np.array([1]), far, least)[0])


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(None, None), (1, ""), (2, " \n"), (None, "a b"), (3, "a B"), (4, long), (4, long), (5, long + " end"), (None, "only null"), (None, "only null")]
    df = frame(spark, rows).selectExpr("*", "1 as _c", "2 as _label", "3 as class_id", "4 as n_links")
    got = sorted(((r.doc_id, r.class_id, r.n_links) for r in near_join.near_duplicates(df).collect()), key=repr)
    want = [(None, None, 0), (1, 1, 0), (2, 2, 0), (None, 3, 1), (3, 3, 1), (4, 4, 2), (4, 4, 2), (5, 4, 2), (None, None, 1), (None, None, 1)]
    assert got == sorted(want, key=repr)
    kept = sorted((repr(r.doc_id), (r.text or "")[:9]) for r in near_join.keep_one(df).collect())
    assert kept == sorted([("None", ""), ("1", ""), ("2", " \n"), ("3", "a B"), ("4", long[:9]), ("None", "only null")])
    assert near_join.near_duplicates(df.limit(0)).count() == 0


def test_rare_shingles_meet():
    """Sets at or above the threshold share a rare shingle, whatever the counters say."""
    rng = np.random.default_rng(2)
    for n in range(1, 80):
        both = rng.integers(0, 2**63, n, dtype=np.uint64)
        one, two = rng.integers(0, 2**63, n // 8, dtype=np.uint64), rng.integers(0, 2**63, n // 8, dtype=np.uint64)
        sets = [np.unique(np.concatenate([both, x])) for x in (one, two)]
        if 10 * n < 8 * len(np.union1d(*sets)):
            continue
        counts = rng.integers(2, 5, near_join.COUNTERS)
        assert len(np.intersect1d(*[near_join.rare_shingles(s, counts) for s in sets]))


def test_boilerplate_band(spark):
    """A passage that 12,000 unlike texts share makes hot bands; only near copies stay in them."""
    rng = random.Random(8)
    shared = " ".join(f"b{i}" for i in range(45))
    docs = [(i, shared + " " + " ".join(f"u{rng.randrange(10**8)}" for _ in range(15))) for i in range(12_000)]
    docs += [(12_000 + i, docs[i * 300][1] + " more") for i in range(40)]
    df = frame(spark, docs)
    reps = near_join.keyed_sets(df).groupBy("_c").agg(near_join.F.min(near_join._order()).alias("f"), near_join.F.first("_sig").alias("_sig"))
    bands = near_join.F.array(*[near_join.F.substring("_sig", 1 + 16 * i, 16) for i in range(near_join.BANDS)])
    banded = reps.select("_c", near_join.F.posexplode(bands).alias("i", "v")).selectExpr("_c", "xxhash64(i, v) as _band")
    members = near_join._groups(banded)
    assert members.agg({"_n": "max"}).first()[0] > near_join.HOT
    split = near_join.split_bands(df, members, reps.select("_c", "f.*"))
    assert split.agg({"_n": "max"}).first()[0] <= near_join.HOT
    got = {r.doc_id: (r.class_id, r.n_links) for r in near_join.near_duplicates(df).collect()}
    twins = {i * 300: (i * 300, 1) for i in range(40)} | {12_000 + i: (i * 300, 1) for i in range(40)}
    assert got == {i: twins.get(i, (i, 0)) for i, _ in docs}
