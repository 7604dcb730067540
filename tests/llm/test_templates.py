"""Template and plain windows: both ways to the same words, odd cases, and a plain version."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tidemill.llm import templates

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def found(spark, texts, items):
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS)
    bench = spark.createDataFrame([(100 + i, t) for i, t in enumerate(items)], ITEMS)
    return {(r.doc_id, r.item_id - 100): (r.n_windows, r.n_matched) for r in templates.leaks(docs, bench).collect()}


def test_both_ways_to_canonical_words(spark):
    rng = random.Random(1)
    parts = ["Anna", "ANNA", "anna", "Été", "é", "12", "1,200", "12.5", "3.", ",", ".", "kg", "Kg", "km2", "5km", "A", "AbC", "x1", "Xy2",
             "\x01", "\x05", "你好", "ไทย", "-", "'", "İx", "½", "7 km", "7km/h", "B2B", "99bottles"]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " ", " ", " ", "  ", "\n"]) for _ in range(rng.randint(0, 14))) for _ in range(600)]
    df = spark.createDataFrame([(t,) for t in [*texts, "", " . ", None]], "text string")
    c = templates.canonical_words(templates.raw_words(F.col("text")))
    rows = df.select("text", c.alias("a"), templates.template_words(F.col("text")).alias("b"), templates.raw_words(F.col("text")).alias("r"))
    for r in rows.collect():
        assert r.a == r.b and (r.a is None or len(r.a) == len(r.r)), tuple(r)


QUESTION = "If Paris sells 12 kg of apples at 3 dollars each and Lyon sells twice as many, how much do both earn in one day?"


@pytest.mark.parametrize("change", [str, str.lower, str.upper, str.title, str.swapcase])
def test_verbatim_copies_in_any_case(spark, change):
    filler = "some other words stand before and after it in the text"
    texts = [f"{filler}. {change(QUESTION)} {filler}", change(QUESTION), filler]
    assert set(found(spark, texts, [QUESTION])) == {(0, 0), (1, 0)}


def test_short_items_and_scripts_without_spaces(spark):
    chinese = "一个农民有十七只羊,除了九只以外都死了,还剩下几只羊?"
    items = ["What is 2+2?", "Name the capital of France", "yes", "Is it", chinese, "Who wrote the old song about the sea"]
    texts = [
        "We ask: what IS 2 + 2? Then go on.", "what is 2 or 2", "please name the capital of France now", "yes, is it so, yes",
        "前面的文字。" + chinese + "后面还有别的内容。", "一个农民有羊。还剩下几只鸡?", "who wrote the old SONG about the sea", None, "",
    ]
    assert set(found(spark, texts, items)) == {(0, 0), (2, 1), (4, 4), (6, 5)}


def plain_leaks(texts, items):
    """Plain words only: enough windows of an item by place, or thirteen words in a row."""
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    out = {}
    for d, text in enumerate(texts):
        w = words(text)
        places = {}
        for p in range(len(w) - 4):
            places.setdefault(tuple(w[p : p + 5]), []).append(p)
        for i, item in enumerate(items):
            v = words(item)
            n = len(v) - 4
            hits = [(q, p) for q in range(n) for p in places.get(tuple(v[q : q + 5]), [])]
            run = max((sum(1 for k in range(n - q) if (q + k, p + k) in set(hits)) if all((q + k, p + k) in set(hits) for k in range(9)) else 0
                       for q, p in hits), default=0)
            matched = len({q for q, _ in hits})
            if n > 0 and (matched >= 0.8 * n or run >= 9):
                out[d, i] = (n, matched)
    return out


def test_plain_words_equal_brute_force(spark):
    """Lower-case texts have no names; leaks are whole items or parts of at least nine words."""
    rng = random.Random(9)
    pool = [f"w{chr(97 + a)}{chr(97 + b)}" for a in range(12) for b in range(12)]
    say = lambda n: rng.choices(pool, k=n)
    items = [say(rng.randint(9, 40)) for _ in range(25)]
    texts = []
    for k in range(120):
        item = rng.choice(items)
        a = rng.randint(0, max(0, len(item) - 9))
        part = item if k % 3 == 0 else item[a : a + rng.randint(9, 40)] if k % 3 == 1 else say(9)
        texts.append(" ".join(say(rng.randint(0, 30)) + part + say(rng.randint(0, 30))))
    items = [" ".join(i) for i in items]
    texts += texts[:5] + [" ".join([items[0]] * 40)]
    want = plain_leaks(texts, items)
    got = found(spark, texts, items)
    assert got == want and 40 < len(want) < len(texts)


def test_slots_are_worked_out_for_suspects_only(spark):
    texts = ["Maria buys 9 kg of pears and Peter pays for it all at once"] + [f"plain text number {i} about nothing at all here" for i in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS).select("doc_id", *templates.content_key("doc_id", "text"), "text")
    bench = templates._Benchmark(spark.createDataFrame([(1, "Anna buys 5 kg of pears and John pays for it all at once")], ITEMS))
    assert templates.suspects(docs, bench, templates.SHARE).count() == 1
