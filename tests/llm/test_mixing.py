"""Mixing: targets against a plain loop, sums near targets, nesting, odd rows."""

import math

import pytest

from tidemill.llm import mixing

SCHEMA = "doc_id long, text string, source string"


def words(n):
    return " ".join(["w"] * n)


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """Reshare the excess by weight until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    budget, free, out = share * sum(sizes.values()), set(order), {}
    while True:
        total = sum(w[s] for s in free)
        over = [s for s in free if budget * w[s] / total >= most * sizes[s]]
        if not over:
            break
        for s in over:
            out[s] = most * sizes[s]
            free.remove(s)
        budget = share * sum(sizes.values()) - sum(out.values())
        if not free:
            break
    return out | {s: budget * w[s] / sum(w[x] for x in free) for s in free}


@pytest.mark.parametrize(
    "per", [{"a": 300, "b": 300, "c": 300, "d": 300}, {"a": 20, "b": 900, "c": 5, None: 70, "e": 400}, {"x": 50}]
)
def test_targets_and_sums(spark, per):
    docs, i = [], 0
    for source, n in per.items():
        for k in range(n):
            docs.append((i, words(1 + (k * 7) % 23), source))
            i += 1
    got = mixing.mix(spark.createDataFrame(docs, SCHEMA)).collect()
    sizes = {}
    for _, t, s in docs:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    want = plain_targets(sizes)
    assert len(got) == len(docs)
    for s in per:
        mine = [r for r in got if r.source == s]
        assert mine[0].source_size == sizes[s]
        assert math.isclose(mine[0].target, want[s], rel_tol=1e-9)
        assert abs(sum(r.taken for r in mine) - want[s]) <= 12
        assert all(r.taken <= 2 * r.size for r in mine)


def test_larger_budget_takes_all_of_smaller(spark):
    docs = spark.createDataFrame([(i, words(1 + i % 9), "ab"[i % 2]) for i in range(400)], SCHEMA)
    less = {r.doc_id: r.copies for r in mixing.mix(docs, share=0.4).collect()}
    more = {r.doc_id: r.copies for r in mixing.mix(docs, share=0.7).collect()}
    assert all(more[i] >= c for i, c in less.items())


def test_odd_rows(spark):
    rows = [(None, None, None), (None, "a b", "s"), (1, "", "s"), (2, "x", "t"), (2, "x", "t"), (3, words(50_000), "t")]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as size", "2 as taken", "3 as _h", "4 as copies")
    got = mixing.mix(df).collect()
    assert len(got) == 6 and {r.size for r in got if r.doc_id is None} == {0, 2}
    assert len({r.copies for r in got if r.doc_id == 2}) == 1
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0


def test_apply_repeats_rows(spark):
    rows = [(i, words(5), "en", "ab"[i % 2], 9) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = mixing.apply_mix(docs)
    copies = {r.doc_id: r.copies for r in mixing.mix(docs).collect()}
    counts = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert counts == {i: c for i, c in copies.items() if c}


def test_empty_texts_get_no_extra_copies(spark):
    """A source of one word at its limit: its empty texts are taken twice, not three times."""
    rows = [(i, "", "en", "a", 0) for i in range(39)] + [(39, "word", "en", "a", 4), (40, "word " * 50, "en", "b", 250)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    copies = {r.doc_id: r.copies for r in mixing.mix(df).collect()}
    assert all(copies[i] <= 2 for i in range(40))
    counts = mixing.apply_mix(df).groupBy("doc_id").count().collect()
    assert {r["doc_id"]: r["count"] for r in counts} == {k: v for k, v in copies.items() if v}
