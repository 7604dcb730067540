"""The perfect hash alone, and line dedup against plain Python."""

import random

import numpy as np
import pytest

from tidemill.llm import line_index


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 30_000])
@pytest.mark.parametrize("levels", [0, 1, 48])
def test_every_key_has_its_own_number(n, levels):
    if n == 30_000 and levels < 48:
        pytest.skip("listed keys are looked up one at a time")
    rng = np.random.default_rng(n)
    h1, h2 = rng.integers(0, 2**64, (2, n), np.uint64)
    h1[: n // 2] = h1[0] if n else 0  # halves that agree are no clash
    hashed = line_index.PerfectHash.build(h1, h2, levels)
    assert hashed.n == n and sorted(hashed.number(h1, h2).tolist()) == list(range(n))
    if levels == 48 and n == 30_000:
        assert len(hashed.rest[0]) == 0 and len(hashed.bits) < 5 * n


def test_fingerprints_turn_others_away(spark):
    rng = np.random.default_rng(2)
    keys = rng.integers(-(2**63), 2**63, (2000, 2)).tolist()
    lines = spark.createDataFrame([(d, *k) for k in keys for d in (4, 3, 4)], "_doc long, h1 long, h2 long")
    index, shards = line_index.build_index(lines, shard_keys=300)
    rows = index.collect()
    assert shards == 7 and sum(r.n for r in rows) == 2000
    for r in rows:
        shard = line_index.Shard(r.asDict())
        mine = np.array([k for k in keys if k[0] % shards == r.shard]).view(np.uint64)
        count, first = shard.ask(mine[:, 0], mine[:, 1])
        assert (count == 2).all() and (first == 3).all()
        other = rng.integers(0, 2**64, (2, 5000), np.uint64)
        assert (shard.ask(*other)[0] == 0).all()
        # Four bytes of fingerprint and count and eight of id, and few bits for the hash.
        assert len(r.bits) < r.n


SPACE = " \t\n\x0b\x0c\r"


def plain(rows):
    """(doc_id, text) to (doc_id, n_lines, n_dropped, text)."""
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(SPACE))
    place = lambda d: 2**63 - 1 if d is None else d
    holders = {}
    for d, text in rows:
        for x in (text or "").split("\n"):
            holders.setdefault(key(x), set()).add(place(d))
    out = []
    for d, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or place(d) == min(holders[key(x)])]
        gone = len(lines) - len(kept)
        out.append((d, len(lines), gone, "\n".join(kept) if gone else text))
    return sorted(out, key=repr)


@pytest.mark.parametrize("shard_keys, part_lookups", [(250_000, 1_000_000), (20, 15)])
def test_lines_equal_brute_force(spark, shard_keys, part_lookups):
    rng = random.Random(6)
    pool = [" ".join(rng.choices("Straße été A bB over THE line".split(), k=rng.randint(1, 5))) for _ in range(60)]
    rows = [(k, "\n".join(
        rng.choice(["", " ", "\t", "\x0b"]) + (rng.choice(pool).upper() if rng.random() < 0.2 else rng.choice(pool)) + rng.choice(["", "\r", "  ", "\xa0"])
        for _ in range(rng.randint(0, 9)))) for k in range(150)]
    hot = "this line is on every page"
    rows = [(d, t + "\n" + hot) for d, t in rows]
    rows += [(None, rows[3][1]), (None, hot), (500, None), (501, ""), (502, "\n\n"), (503, "123456789"), (504, "1234567890"),
             (505, " 1234567890\x0c"), (506, "123456789 \n"), (-5, "ÀÉ" * 5), (507, "àé" * 5), (508, "ÀÉ" * 5), (509, hot.upper() + "\n" + hot)]
    rows += rows[:10] + [(2, "another text of document two\n" + hot), (1000, "another text of document two")]
    df = spark.createDataFrame([(a, b, 7, "x", 1) for a, b in rows], "doc_id long, text string, n_lines int, _pos string, h1 int")
    got = line_index.drop_lines(df.repartition(5), shard_keys=shard_keys, part_lookups=part_lookups)
    assert got.columns == ["doc_id", "text", "n_lines", "_pos", "h1", "n_dropped"]
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got.collect()), key=repr) == plain(rows)


def test_no_documents_and_very_long_text(spark):
    df = spark.createDataFrame([(1, "word " * 400_000), (2, "line of text\n" * 50_000), (3, "line of text")], "doc_id long, text string")
    got = {r.doc_id: (r.n_lines, r.n_dropped, len(r.text)) for r in line_index.drop_lines(df).collect()}
    assert got == {1: (1, 0, 2_000_000), 2: (50_001, 0, 650_000), 3: (1, 1, 0)}
    assert line_index.drop_lines(df.limit(0)).count() == 0
