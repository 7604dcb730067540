"""Toxicity, quality and language: held-out results, and rows that are odd."""

import math
import re

import numpy as np
import pytest

from tidemill.llm import language, quality_net, toxicity
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def auc(score, y):
    rank = np.argsort(np.argsort(score, kind="stable"))
    n = y.sum()
    return (rank[y == 1].sum() - n * (n - 1) / 2) / (n * (len(y) - n))


@pytest.mark.parametrize("op,label,parts,held,least", [(toxicity.op4, "toxic", 3, 1, 0.85), (quality_net.op5, "quality", 4, 2, 0.9)])
def test_held_out(spark, op, label, parts, held, least):
    import zlib

    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", F.col(label).alias("y"))
    got = op(spark, SF).join(labels, "doc_id", "left").toPandas()
    assert len(got) == 1000
    assert all(h == (zlib.crc32(str(i).encode()) % parts == held) for i, h in zip(got.doc_id, got.held_out))
    assert ((got.score >= 0) & (got.score <= 1)).all() and (got.predicted == (got.score >= 0.7)).all()
    test = got[got.held_out & got.y.notna()]
    assert auc(test.score.to_numpy(), test.y.to_numpy()) >= least


def test_labels_held_out_are_never_read(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    sample, totals = toxicity.labelled_sample(docs, labels, "toxic", 3, 1, 5, 7)
    import zlib

    assert len(sample) == 12 and sample.y.sum() == 5 and sum(totals.values()) > 200
    assert all(zlib.crc32(str(i).encode()) % 3 != 1 for i in sample.doc_id)


@pytest.mark.parametrize("module", [toxicity, quality_net])
def test_odd_rows(spark, module):
    rows = [(None, None), (None, "plain words"), (1, ""), (2, "plain words"), (2, "plain words"), (3, "w " * 60_000), (4, "# | ! *" * 50)]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA).selectExpr("*", "5 as score", "6 as held_out")
    labels = spark.createDataFrame([(2, 1, 0), (2, 0, 1), (None, 1, 1), (9, None, None)], "doc_id long, quality int, toxic int")
    got = module.classify(docs, labels).collect()
    assert len(got) == 7 and all(0 <= r.score <= 1 and math.isfinite(r.score) for r in got)
    assert len({r.score for r in got if r.doc_id == 2}) == 1 and all(not r.held_out for r in got if r.doc_id is None)
    assert module.classify(docs.limit(0), labels.limit(0)).count() == 0


def test_texts_are_scored_alone():
    """The score of a text doesn't depend on what stands next to it."""
    model = toxicity.TextCNN()
    texts = ["one", None, "two words here", "", "x " * 500]
    together = toxicity.Scorer(model).scores(texts)
    assert np.allclose(together, [toxicity.Scorer(model).scores([t])[0] for t in texts], atol=1e-5)


def test_contexts_by_counting():
    rng = np.random.default_rng(0)
    place, sign = quality_net.index_vectors()
    held = [rng.integers(0, 50, n) for n in (7, 0, 1, 12)]
    total = np.zeros((quality_net.BUCKETS, quality_net.DIM), np.int64)
    quality_net.add_contexts(total, np.concatenate(held), place, sign)
    quality_net._take_seams(total, held, place, sign)
    want = np.zeros_like(total)
    for ids in held:
        for i, w in enumerate(ids):
            for j in (i - 2, i - 1, i + 1, i + 2):
                if 0 <= j < len(ids):
                    np.add.at(want, (w, place[ids[j]]), sign[ids[j]])
    assert (total == want).all()


def test_language(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = language.op7(spark, SF)
    d = got.where("doc_id IS NOT NULL").join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    assert len(d) == docs.count()
    test = [r for r in d if len(r.text.split()) >= 20]
    assert sum(r.language == r.lang for r in test) >= 0.97 * len(test)
    truth = {r.page_id: re.search(r'<html lang="(\w+)"', r.html)[1] for r in pages.collect()}
    p = got.where("page_id IS NOT NULL").collect()
    assert len(p) == len(truth) and sum(r.language == truth[r.page_id] for r in p) >= 0.97 * len(p)
    assert all(0 < r.probability <= 1 for r in d + p)


def test_every_language_is_a_class(spark):
    """Rare languages, those with long texts only and those whose ids any split leaves out."""
    import zlib

    left_out = next(i for i in range(1000, 2000) if zlib.crc32(str(i).encode()) % 5 == 4)
    rows = [(2 * n + k, f"word{n} text", f"l{n:02}", "s", 0) for n in range(70) for k in range(2)]
    rows += [(500, "zz", "rare", "s", 0), (left_out, "yy", "split", "s", 0), (501, "long " * 5000, "long", "s", 0)]
    langs, table = language.train(spark.createDataFrame(rows, SCHEMA))
    assert langs == sorted({r[2] for r in rows}) and table.shape == (language.BUCKETS, 73)
    # Each has been trained on a text of its own.
    for i, text, lang, *_ in rows[140:]:
        assert langs[int(language.likelihood(text, table).argmax())] == lang


def test_language_evidence(spark):
    """Without text, the declaration, the suffix and the host decide."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    french = docs.where("lang = 'fr'").orderBy("doc_id").select("text").limit(30).collect()
    english = docs.where("lang = 'en'").orderBy("doc_id").select("text").limit(30).collect()
    page = lambda t, lang="": f"<html{lang}><body><article><p>{t}</p></article></body></html>"
    rows = [(i, f"http://a.shop.fr/{i}", page(r.text, ' lang="fr"')) for i, r in enumerate(french)]
    rows += [(100 + i, f"http://b.shop.com/{i}", page(r.text, " lang=en")) for i, r in enumerate(english)]
    rows += [(200, "http://new.fr/", page("")), (201, None, page("", " lang='fr'")), (202, "http://b.shop.com/x", page("")), (203, None, None), (None, "no address", ""), (None, "no address", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as host", "2 as _ll", "3 as language")
    got = language.identify(docs, pages)
    by = {r.page_id: r.language for r in got.where("page_id IS NOT NULL").collect()}
    assert by[200] == "fr" and by[201] == "fr" and by[202] == "en" and by[203] in ("en", "fr", "de", "es")
    assert got.count() == docs.count() + len(rows)
    assert language.identify(docs.limit(0), pages.limit(0)).count() == 0


def _fused_plainly(rows, langs):
    """Language and probability per row of (id, log likelihoods, host, domain, suffix, declared), by dictionaries."""
    def normal(ll):
        w = [math.exp(x - max(ll)) for x in ll]
        return [x / sum(w) for x in w]

    n, p = len(langs), [normal(r[1]) for r in rows]
    base = [1 + sum(q[i] for q in p) for i in range(n)]
    base = [x / sum(base) for x in base]
    out = {}
    for k, r in enumerate(rows):
        def rest(at):
            """Rows that share this row's value, and their mass per language, without the row."""
            others = [j for j, o in enumerate(rows) if j != k and r[at] is not None and o[at] == r[at]]
            return len(others), [sum(p[j][i] for j in others) for i in range(n)]

        log = []
        for i in range(n):
            count, mass = rest(3)
            domain = (mass[i] + language.HOST_WEIGHT * base[i]) / (count + language.HOST_WEIGHT)
            count, mass = rest(2)
            x = r[1][i] + math.log((mass[i] + language.HOST_WEIGHT * domain) / (count + language.HOST_WEIGHT))
            for at in (4, 5):
                count, mass = rest(at)
                if r[at] is not None:
                    x += math.log((mass[i] + language.VALUE_WEIGHT * base[i]) / (count + language.VALUE_WEIGHT) / base[i])
            log.append(x)
        best = max(log)
        out[r[0]] = langs[log.index(best)], 1 / sum(math.exp(x - best) for x in log)
    return out


def test_fusion_against_a_plain_version(spark):
    """Weak evidence, so that every term matters; nulls, values of one row, repeated rows and ties."""
    rng = np.random.default_rng(3)
    langs = ["de", "en", "es", "fr", "pt"]
    rows = []
    for i in range(60):
        h = int(rng.integers(6))
        host = [None, "a.x.de", "b.x.de", "x.fr", f"only{i}.org", "www.y.es"][h]
        domain = [None, "x.de", "x.de", "x.fr", f"only{i}.org", "y.es"][h]
        ll = [0.0] * 5 if i % 7 == 0 else [float(x) for x in rng.normal(0, 1.5, 5)]
        declared = [None, "de", "fr", "zz"][int(rng.integers(4))]
        rows.append((i, ll, host, domain, domain and domain.rsplit(".", 1)[1], declared))
    rows.append((60, *rows[8][1:]))
    fields = "_id long, _ll array<double>, host string, domain string, suffix string, declared string"
    got = {r["_id"]: r for r in language.fuse(spark.createDataFrame(rows, fields), langs).collect()}
    want = _fused_plainly(rows, langs)
    assert got.keys() == want.keys() and len({r.language for r in got.values()}) > 2
    assert min(r.probability for r in got.values()) < 0.7
    for i, (lang, chance) in want.items():
        assert got[i].language == lang and math.isclose(got[i].probability, chance, rel_tol=1e-9)


def test_hundreds_of_languages(spark):
    """The plan has no part that is there once per language."""
    langs = [f"l{i:03}" for i in range(300)]
    fields = "_id long, _ll array<double>, host string, domain string, suffix string, declared string"
    rows = [(i, [-0.01 * abs(j - i) for j in range(300)], f"h{i % 3}", None, None, None) for i in range(30)]
    few = [(i, [0.0, -1.0], f"h{i % 3}", None, None, None) for i in range(30)]
    plan = lambda r, names: language.fuse(spark.createDataFrame(r, fields), names)
    many = plan(rows, langs)
    # Names hold numbers of any length, so operators and columns are counted.
    size = lambda df: (len(df._jdf.queryExecution().analyzed().toString().splitlines()), len(df.columns))
    assert size(many) == size(plan(few, langs[:2]))
    got, want = {r["_id"]: r.language for r in many.collect()}, _fused_plainly(rows, langs)
    assert got == {i: lang for i, (lang, _) in want.items()}


def test_convolution_against_a_plain_version():
    """Every filter at every place of every text, by loops; empty texts, one word, repeats, and a text in pieces."""
    rng = np.random.default_rng(5)
    model = toxicity.TextCNN()
    model.bias[:] = rng.normal(0, 0.3, len(model.bias))
    model.shift[:] = 0.25
    words = [f"word{i}" for i in range(40)] + ["ähnlich", "x", "y"]
    texts = [[], ["x"], ["x", "x"], ["never", "seen"]] + [[words[i] for i in rng.integers(0, len(words), n)] for n in (3, 4, 9, 200)]

    def plain(text):
        vector = lambda w: sum(model.emb[b].astype(float) for b in toxicity.buckets(w)) if w else np.zeros(toxicity.DIM)
        padded = [vector(w) for w in text] + [vector("")] * max(toxicity.WIDTHS)
        z, col, unit = float(model.shift[0]), 0, 0
        for width in toxicity.WIDTHS:
            for f in range(toxicity.FILTERS):
                at = lambda k: model.conv[:, (col + k) * toxicity.FILTERS + f].astype(float)  # noqa: B023, E731
                best = max(sum(padded[p + k] @ at(k) for k in range(width)) for p in range(max(len(text), 1)))
                z += max(best + model.bias[unit], 0) * model.out[unit]
                unit += 1
            col += width
        return z

    want = [plain(t) for t in texts]
    assert np.allclose(model.scorer().logits(texts), want, atol=1e-4)
    # One after the other, the cache filled by those before.
    scorer = model.scorer()
    assert np.allclose([scorer.logits([t])[0] for t in texts], want, atol=1e-4)
    assert np.ptp(want) > 0.01 and len(scorer.logits([])) == 0


def test_training_moves_against_the_loss():
    """A word tells the label, whatever stands around it; training finds it and leaves row 0 empty."""
    rng = np.random.default_rng(9)
    other = [f"w{i}" for i in range(60)]
    texts, y = [], []
    for i in range(240):
        text = [other[j] for j in rng.integers(0, len(other), 12)]
        if i % 2:
            text[int(rng.integers(12))] = "vile"
        texts.append(text)
        y.append(i % 2)
    y = np.array(y)
    model = toxicity.TextCNN()
    model.fit(texts[:160], y[:160], np.ones(160, np.float32))
    z = model.scorer().logits(texts[160:])
    assert auc(z, y[160:]) > 0.95 and not model.emb[0].any()
