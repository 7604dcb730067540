"""Personal data against plain regular expressions, and terms that give entities away."""

import hashlib
import random
import re
import time

import pytest

from tidemill.llm import pii
from tidemill.plans.registry import Query  # noqa: F401

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def good(kind, m):
    d = re.sub(r"[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        twice = [int(c) * 2 for c in d[-2::-2]]
        return 14 <= len(d) <= 19 and (sum(x - 9 if x > 9 else x for x in twice) + sum(int(c) for c in d[-1::-2])) % 10 == 0
    return kind != "phone" or 10 <= len(d) <= 15


def plain(text):
    spans = []
    for k, (kind, p) in enumerate(BASE.items()):
        spans += [(m.start(), k, m.end(), kind) for m in re.finditer(p, text or "") if good(kind, m[0])]
    return sorted(spans)


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)


def digest(found):
    return found.select("doc_id", *[pii.F.size(k).alias(k) for k in pii.KINDS[:4]], pii._joined(pii.KINDS[:4]).alias("b"))


def test_base_spans(spark):
    rng = random.Random(4)
    bits = ["a.b@c.de", "x@y", "@", "1.2.3.4", "300.1.1.1", "10.20.30.40.50.60.70.80", "4111 1111 1111 1111", "4111-1111-1111-1112",
            "+1 (555) 010-9999", "+49 30 123456", "+1", "0000000000000000", "7.7.7.7@host.org", "ß😀 ", "a@b.c.d_e@f.gh", "..", " ", "\n",
            "12345678901234567890", "+1234567890123456", "é@é.é", "-", "%+-@a-.b-"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) for _ in range(300)] + [None, "", "1" * 5000, "a." * 5000 + "@b" + ".c" * 5000]
    got = {r.doc_id: r for r in digest(pii.find(frame(spark, texts))).collect()}
    for i, t in enumerate(texts):
        want = plain(t)
        assert got[i].b == ",".join(f"{kind}:{s}:{e}" for s, _, e, kind in want), t
        for k in BASE:
            assert max(got[i][k] or 0, 0) == sum(x[3] == k for x in want)


def test_disclosing_terms(spark):
    rng = random.Random(1)
    filler = lambda n: " ".join(f"word{rng.randrange(40)}" for _ in range(n))
    texts = [f"{filler(20)} Zorblax director wrote from boss@corp.example.com {filler(20)}" for _ in range(6)]
    texts += [f"{filler(30)} director {filler(10)}" for _ in range(150)] + [filler(30) for _ in range(200)]
    found = {r.doc_id: r.term for r in pii.find(frame(spark, texts)).collect()}
    for i in range(6):
        words = {texts[i][x.s : x.e] for x in found[i] or []}
        assert "Zorblax" in words and "director" not in words and not any(w.startswith("word") for w in words)
    assert all(not v for i, v in found.items() if i >= 6)
    out = {r.doc_id: r.text for r in pii.redact(frame(spark, texts)).collect()}
    assert "Zorblax" not in out[0] and "boss@" not in out[0] and "<EMAIL>" in out[0] and "<TERM>" in out[0] and "director" in out[0]
    assert all(out[i] == texts[i] for i in range(6, len(texts)))


def test_terms_far_from_entities(spark):
    """Terms count in whole documents and are marked wherever they stand, without an entity too."""
    rng = random.Random(2)
    filler = lambda n: " ".join(f"word{rng.randrange(40)}" for _ in range(n))
    texts = [f"{filler(5)} Zorblax {filler(60)} boss@corp.example.com {filler(30)} zorblax, {filler(5)}" for _ in range(6)]
    texts += [f"{filler(30)} Zorblax {filler(10)}", "corp boss"] + [filler(30) for _ in range(300)]
    found = {r.doc_id: r.term for r in pii.find(frame(spark, texts)).collect()}
    want = lambda t: [m.span() for m in re.finditer("zorblax", t, re.I)]
    assert all([(x.s, x.e) for x in found[i] or []] == want(t) for i, t in enumerate(texts))
    out = {r.doc_id: r.text for r in pii.redact(frame(spark, texts)).collect()}
    assert all("zorblax" not in x.lower() for x in out.values()) and out[7] == texts[7] and out[6].count("<TERM>") == 1
    old, pii.BROADCAST_TERMS = pii.BROADCAST_TERMS, 0
    try:
        assert {r.doc_id: r.term for r in pii.find(frame(spark, texts)).collect()} == found
    finally:
        pii.BROADCAST_TERMS = old


def test_terms_in_quotes(spark):
    """Quotes and dashes around a term are no part of it."""
    rng = random.Random(3)
    filler = lambda n: " ".join(f"word{rng.randrange(40)}" for _ in range(n))
    forms = ["'Zorblax'", "--Zorblax--", "Zorblax", "9'Zorblax'"]
    texts = [f"{filler(20)} {forms[i % 4]} wrote from boss@corp.example.com {filler(20)}" for i in range(4)]
    texts += ["seen: 'zorblax' -zorblax-"] + [filler(30) for _ in range(200)]
    found = {r.doc_id: r.term for r in pii.find(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        assert [(x.s, x.e) for x in found[i] or [] if x.v == "zorblax"] == [m.span() for m in re.finditer("zorblax", t, re.I)], t


@pytest.mark.parametrize("text", ["x a@b.cd y", "1.2.3.4 +1 555 010 9999 z", "+4111 1111 1111 1111"])
def test_redact(spark, text):
    out = pii.redact(frame(spark, [text, None])).collect()
    got = {r.doc_id: r.text for r in out}
    assert got[1] is None and not plain(got[0]) and "<" in got[0]


def test_odd_rows(spark):
    rows = [(None, None), (None, "p@q.rs"), (1, ""), (1, "p@q.rs"), (1, "p@q.rs"), (2, "w " * 40_000 + "p@q.rs")]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA).selectExpr("*", "1 as email", "2 as term", "3 as _k1")
    got = digest(pii.find(df)).collect()
    assert sorted(r.b for r in got) == sorted(["", "", "email:0:6", "email:0:6", "email:0:6", "email:80000:80006"])
    assert pii.find(df.limit(0)).count() == 0 and pii.redact(df.drop("email", "term", "_k1")).count() == 6


def test_query_digest(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in pii.op2(spark, sf_dir).collect():
        base = ",".join(f"{kind}:{s}:{e}" for s, _, e, kind in plain(docs[r.doc_id]))
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert [x for x in r.spans.split(",") if x and not x.startswith("term")] == [x for x in base.split(",") if x]


def test_many_spans_in_one_text(spark):
    """More spans than a part holds, of all kinds and overlapping, and twenty thousand in seconds."""
    rng = random.Random(9)
    bits = ["a.b@c.de ", "1.2.3.4 ", "4111 1111 1111 1111 ", "+1 (555) 010-9999 ", "Zorblax ", "word, ", "+14111111111111111@x.de ", "x@4.3.2.1 "]
    texts = ["".join(rng.choice(bits) for _ in range(n)) for n in (1, pii.PART, pii.PART + 1, 700, 1500)]
    got = {r.doc_id: r for r in digest(pii.find(frame(spark, texts))).collect()}
    for i, t in enumerate(texts):
        assert got[i].b == ",".join(f"{kind}:{s}:{e}" for s, _, e, kind in plain(t))
    many = " ".join(f"user{i}@host{i % 700}.org" for i in range(20_000))
    began = time.monotonic()
    assert pii.find(frame(spark, [many])).select(pii.F.size("email").alias("n")).first().n == 20_000
    assert pii.redact(frame(spark, [many])).first().text == " ".join(["<EMAIL>"] * 20_000)
    assert time.monotonic() - began < 120


def test_terms_beside_entities(spark):
    """Terms that touch an entity are no spans, against a look at every pair."""
    rng = random.Random(3)
    kind = lambda k, rows: [(s, e, k, "v", None, None) for s, e in rows]
    rows = []
    for _ in range(60):
        cut = sorted(rng.sample(range(900), 2 * rng.randint(1, 200)))
        terms = [(a, b) for a, b in zip(cut[::2], cut[1::2])]
        spans = [(a, a + rng.randint(1, 40)) for a in rng.sample(range(900), rng.randint(0, 12))]
        rows.append((kind(0, spans[::2]) or None, kind(1, spans[1::2]), None, None, kind(4, terms)))
    df = spark.createDataFrame(rows, ", ".join(f"{k} array<{pii._SPAN}>" for k in pii.KINDS))
    got = df.select(pii.F.struct(*pii.KINDS[:2]).alias("e"), "term", pii._apart().alias("left")).collect()
    for r in got:
        spans = [*(r.e.email or []), *(r.e.ip or [])]
        assert r.left == [t for t in r.term if not any(x.s <= t.e and t.s <= x.e for x in spans)]
    assert sum(len(r.left) for r in got) > 100


def plain_disclosing(texts, support=3, alpha=0.9):
    """(entity, term) pairs above the threshold, by dictionaries; addresses of the kinds email and ip."""
    term = re.compile(r"[A-Za-z][A-Za-z0-9'-]+[A-Za-z0-9]")
    token = re.compile(rf"(?P<email>{BASE['email']})|{term.pattern}")
    held, close, meet, words = {}, {}, {}, []
    for d, text in enumerate(texts):
        words.append([m[0].lower() for m in token.finditer(text or "") if not m["email"]])
        for k, kind in enumerate(("email", "ip")):
            found = list(re.finditer(BASE[kind], text or ""))
            for i, m in enumerate(found):
                left = text[found[i - 1].end() if i else 0 : m.start()][-pii.NEAR :]
                right = text[m.end() : found[i + 1].start() if i + 1 < len(found) else len(text)][: pii.NEAR]
                entity, context = f"{k}:{m[0].lower()}", (left, right)
                if good(kind, m[0]):
                    held.setdefault(entity, {}).setdefault(d, context)
                    for side in (left, right):  # words at an edge may be cut, or part of the entity
                        for w in term.finditer(side):
                            if w.start() > 0 and w.end() < len(side):
                                close.setdefault((entity, w[0].lower()), set()).add(context)
    near = {pair for pair, contexts in close.items() if len(contexts) >= support}
    for entity, docs in held.items():
        if len(docs) >= support or any(e == entity for e, _ in near):
            for d, context in docs.items():
                for w in set(words[d]):
                    at = max(words[d].index(w) - pii.AROUND // 2, 0)
                    meet.setdefault((entity, w), []).append((context, tuple(words[d][at : at + pii.AROUND])))
    n_t = {w: sum(w in x for x in words) for w in {w for _, w in meet}}
    out = set()
    for (entity, w), rows in meet.items():
        contexts = max(len({c for c, _ in rows}), len({a for _, a in rows}))
        if (contexts >= support or (entity, w) in near) and len(rows) / n_t[w] >= (len(held[entity]) / len(texts)) ** (1 - alpha):
            out.add((entity, w))
    return out


def test_terms_equal_brute_force(spark):
    rng = random.Random(12)
    pool = [f"word{chr(97 + a)}{chr(97 + b)}" for a in range(6) for b in range(6)]
    people = [(f"P{i}.x@mail{i % 3}.org" if i % 2 else f"10.0.{i}.7", f"Name{i}", f"it's-nick{i}") for i in range(14)]
    texts = [None, ""]
    for k in range(260):
        say = lambda n: " ".join(rng.choices(pool, k=n))
        text = say(rng.randint(0, 20))
        for entity, name, nick in rng.sample(people, rng.choice([0, 0, 1, 1, 2])):
            text += f" {name} {say(rng.choice([1, 3, 30]))} {entity} " + rng.choice([nick, say(2), f"'{nick}' {entity}", ""])
        texts.append(text + rng.choice(["", " ", f" {rng.choice(people)[1]} again"]))
    docs = frame(spark, texts).select("doc_id", "text")
    for support, alpha in ((3, 0.9), (5, 0.8)):
        got = {(r.entity, r.term) for r in pii.disclosing(docs, pii.base_spans(docs), support, alpha).collect()}
        assert got == plain_disclosing(texts, support, alpha)
        assert {e for e, _ in got} and len(got) > 10
