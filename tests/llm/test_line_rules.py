"""Line rules against plain loops."""

import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from tidemill.llm import line_rules

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    hit = set()
    for i, g in enumerate(grams):
        if grams.count(g) > 1:
            hit |= set(range(i, i + 8))
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(hit)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n# é\x0b😀", max_size=120))
def test_counts(text):
    assert line_rules.count_text(text) == plain_counts(text)


def plain_verdict(docs):
    def key(x):
        return " ".join(x.split()).lower()

    texts, first = {}, {}
    for i, t, s in docs:
        for x in (t or "").split("\n"):
            if len(x.split()) >= 4:
                texts.setdefault((s, key(x)), set()).add(t)
                first[s, key(x)] = min(first.get((s, key(x)), 2**63), i)
    out = {}
    for i, t, s in docs:
        n, _, _, _, rep = plain_counts(t)
        gone = sum(
            len(x.split())
            for x in (t or "").split("\n")
            if len(x.split()) >= 4 and len(texts[s, key(x)]) > 10 and first[s, key(x)] != i
        )
        bad = n < 20 or 100 * rep > 30 * n
        out[i] = (bad, gone, not bad and n - gone >= 20 and n - gone >= 0.5 * n)
    return out


def test_frequent_lines(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(5))
    line = lambda n: " ".join(word() for _ in range(n))
    common, docs = [line(12) for _ in range(3)], []
    for i in range(90):
        body = [line(rng.randint(2, 9)) for _ in range(rng.randint(1, 8))]
        body += rng.sample(common, rng.randint(0, 3))
        rng.shuffle(body)
        docs.append((i, "\n".join(body).title() if i % 7 == 0 else "\n".join(body), ["x", "y", None][i % 3]))
    docs += [(200 + i, docs[0][1], "y") for i in range(20)]
    df = spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in docs], SCHEMA)
    got = {r.doc_id: (r.base_failed, r.n_removed, r.kept) for r in line_rules.judge(df).collect()}
    assert got == plain_verdict(docs)
    assert any(v[1] for v in got.values())
    out = {r.doc_id: r.text for r in line_rules.remove_lines(df).collect()}
    for i, t, _ in docs:
        assert len(t.split()) - len(out[i].split()) == got[i][1]


def test_odd_rows(spark):
    long = "one two three four five\n" * 3 + " ".join(f"w{i}" for i in range(60_000))
    rows = [(None, None, None), (None, "", "s"), (3, long, "s"), (3, long, "s"), (5, "\n \n", "s")]
    df = spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows], SCHEMA).selectExpr("*", "1 as _h", "2 as n_words", "0 as kept")
    got = line_rules.judge(df).collect()
    assert len(got) == 5
    assert sorted((r.n_words, r.kept) for r in got) == [(0, False)] * 3 + [(60_015, True)] * 2
    assert {r.n_dup_lines for r in got if r.doc_id == 3} == {2}
    assert line_rules.judge(spark.createDataFrame([], SCHEMA)).count() == 0
