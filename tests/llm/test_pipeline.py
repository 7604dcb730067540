"""The pipeline, stage by stage, against plain versions on the smallest tables."""

import re

import corpus_pipeline as pipeline
from tidemill.llm import mixing, templates, toxicity
from tidemill.session import stage


def shingles(text):
    words = (text or "").lower().split()
    n = min(5, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = {}
    for name, step in pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        docs = stage(step(spark, docs, sf_dir), f"test-{name}")
        after = docs.collect()
        seen[name] = (before, after)
        if name != "mixing":
            assert docs.columns == list(pipeline.COLUMNS)

    before, after = seen["toxicity"]
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = toxicity.classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), labels).collect()
    assert {r.doc_id for r in after} == {r.doc_id for r in scored if r.predicted == 0}

    before, after = seen["near_duplicates"]
    sets = {i: shingles(r.text) for i, r in before.items()}
    root = {i: i for i in before}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in before:
        for j in before:
            if j < i and sets[i] and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert {r.doc_id for r in after} == {i for i in before if find(i) == i}

    before, after = seen["decontamination"]
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()
    plain = lambda t: " ".join(re.findall(r"[^\W_]+", (t or "").lower()))
    whole = {i for i, r in before.items() if any(plain(b.text) in plain(r.text) for b in items)}
    assert {r.doc_id for r in after} == before.keys() - whole

    before, after = seen["personal_data"]
    assert len(after) == len(before)
    for r in after:
        if r.text != before[r.doc_id].text:
            assert re.search(r"<(EMAIL|IP|CARD|PHONE|TERM)>", r.text) and r.n_chars == len(r.text)
        assert not re.search(r"[\w.]@[\w-]+\.\w", r.text or "")

    before, after = seen["mixing"]
    copies = {}
    for r in after:
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
        assert r.copy <= 2 and r.text == before[r.doc_id].text
    frame = spark.createDataFrame([tuple(r) for r in before.values()], docs.sparkSession.read.parquet(f"{sf_dir}/documents.parquet").schema)
    assert copies == {r.doc_id: r.copies for r in mixing.mix(frame).collect() if r.copies}


def test_leaks_with_other_parameters(spark):
    docs = [
        (1, "Before that. Yesterday farmer Smith sold 12 kg of ripe apples to farmer Jones, and then Smith walked home again. After"),
        (2, "x Yesterday farmer Miller sold 70 kg of ripe apples to farmer Brown, and then Miller walked home again. y"),
        (3, "so farmer Miller sold apples, but Brown kept pears because Carter liked them, and later Jones rested there"),
        (7, "so farmer Brown sold apples, but Brown kept pears because Brown liked them, and later Brown rested there"),
        (4, "Something else altogether was said about apples, farmers and the long way home that day."),
        (5, None),
        (6, "too short"),
    ]
    frame = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    item = "Yesterday farmer Smith sold 12 kg of ripe apples to farmer Jones, and then Smith walked home again."
    same = "so farmer Smith sold apples, but Smith kept pears because Smith liked them, and later Smith rested there"
    bench = spark.createDataFrame([(1, item), (5, same), (2, "four words only here"), (None, item), (3, None)], "item_id long, text string")
    found = {(r.doc_id, r.item_id): r.similarity for r in templates.leaks(frame.selectExpr("*", "1 as _pos", "2 as _n"), bench).collect()}
    # Document 3 puts four names where the item has one.
    assert found.keys() == {(1, 1), (2, 1), (7, 5)} and found[1, 1] == 1.0
    assert sorted(r.doc_id for r in templates.clean(frame.unionByName(frame), bench).collect()) == [3, 3, 4, 4, 5, 5, 6, 6]
    assert templates.leaks(frame.limit(0), bench).count() == 0 and templates.leaks(frame, bench.limit(0)).count() == 0
    wide = templates.leaks.__globals__
    old, wide["BROADCAST_WINDOWS"] = wide["BROADCAST_WINDOWS"], 0
    try:
        assert {(r.doc_id, r.item_id): r.similarity for r in templates.leaks(frame, bench).collect()} == found
    finally:
        wide["BROADCAST_WINDOWS"] = old


def test_leaks_with_other_forms(spark):
    """Names that begin sentences, numbers, names and units that are written in another way."""
    pairs = [
        ("Anna has 3 apples in a basket. Anna buys 5 at the market today.", "Maria has 4 apples in a basket. Maria buys 9 at the market today."),
        ("the shop near the river sold 900 loaves of bread during one long winter week to all", "the shop near the river sold 1,200 loaves of bread during one long winter week to all"),
        ("the tall man called Smith walked over the hills and came back home very late that", "the tall man called Mary Brown walked over the hills and came back home very late that"),
        ("a cart with 12 kg of coal rolled down the narrow street before it stopped at noon", "a cart with 30.5kg of coal rolled down the narrow street before it stopped at noon"),
    ]
    docs = spark.createDataFrame([(i, d) for i, (_, d) in enumerate(pairs)] + [(9, "Peter has 3 pears in a bag. Carl sold 5 at the market today.")], "doc_id long, text string")
    bench = spark.createDataFrame([(i, b) for i, (b, _) in enumerate(pairs)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in templates.leaks(docs, bench).collect()}
    assert got == {(i, i): 1.0 for i in range(len(pairs))}


def test_leaks_of_parts(spark):
    """A passage of a long item is a leak; fewer words in a row are none."""
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(200)]
    bench = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    texts = {1: words[20:170], 2: words[50:63], 3: words[50:62], 4: words[10:20] + ["x"] + words[20:30]}
    docs = spark.createDataFrame([(i, "so " + " ".join(t) + " yes") for i, t in texts.items()], "doc_id long, text string")
    assert {r.doc_id: r.n_matched for r in templates.leaks(docs, bench).collect()} == {1: 146, 2: 9}


def test_items_that_share_an_id(spark):
    """Every text of an id is looked for; one without an id only cleans."""
    texts = ["one red fox ran over the old bridge", "two grey birds sat on the tall tower", "my green boat lay under that warm sun"]
    docs = spark.createDataFrame([(i, f"so {t} yes") for i, t in enumerate(texts)] + [(7, "nothing of the kind was said in here")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, texts[0]), (1, texts[1]), (1, texts[1]), (None, texts[2])], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id, r.similarity) for r in templates.leaks(docs, bench).collect()) == [(0, 1, 1.0), (1, 1, 1.0)]
    assert [r.doc_id for r in templates.clean(docs, bench).collect()] == [7]


def test_run_with_odd_rows(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "", "en", "s", 0), (9, "only a.b@c.de", None, None, None)], docs.schema)
    docs.limit(30).unionByName(odd).unionByName(odd).coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    rows = pipeline.run(spark, str(tmp_path)).collect()
    assert rows and not any("@" in (r.text or "") for r in rows)
    assert pipeline.run(spark, str(tmp_path)).count() == len(rows)
