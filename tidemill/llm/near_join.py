"""N-gram Jaccard self-join with Bayesian candidate pruning.

Texts are sets of hashed five-word shingles; texts with the same set are one class from
the start.  Bands of MinHash values give candidate groups.  Pairs within a group compare
their MinHash values a few at a time and are dropped as soon as the posterior probability
that they reach the threshold falls below a tolerance; the rest are verified exactly on
the shingle sets.

Work is shared out in cells.  A group of candidates is cut into blocks, and a cell holds
two blocks, so no task ever holds a whole large group.  Large bands are split first:
unlike texts meet in one through the passages they share, but a pair at the threshold also
shares one of its rarest shingles (prefix filter), so only members that those connect stay
together.  Pairs never become rows: a cell
gives each member its number of links and a root, and roots are joined into classes.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.session import stage

WORDS = 5
THRESHOLD = 0.8
ROWS = 4
BANDS = 24
#: A pair is dropped when the probability of reaching the threshold is below this.
TOLERANCE = 1e-6
#: MinHash values compared at a time.
STEP = 16
#: Members of a block; a cell holds at most two blocks.
BLOCK = 400
#: Bands of more members than this are split by the rare shingles that their members share.
HOT = 4 * BLOCK
#: Counters of the sketch that tells rare shingles from frequent ones.
COUNTERS = 2**20

HASHES = ROWS * BANDS
_MAX_MEMO = 400_000
_rng = np.random.default_rng(77)
_MUL = _rng.integers(1, 2**63, HASHES, dtype=np.uint64) | np.uint64(1)
_ADD = _rng.integers(0, 2**63, HASHES, dtype=np.uint64)


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


class Shingler:
    """Texts as sorted arrays of distinct 64-bit shingle hashes."""

    def __init__(self, words: int = WORDS):
        self.words, self.memo = words, _WordHash()

    def __call__(self, text: str | None) -> np.ndarray:
        """Lower-case words split at ASCII white space; fewer than ``words`` are one shingle."""
        tokens = text.lower().encode("utf-8", "surrogatepass").split() if text else []
        if not tokens:
            return np.zeros(0, np.uint64)
        if len(self.memo) > _MAX_MEMO:
            self.memo.clear()
        h = np.fromiter(map(self.memo.__getitem__, tokens), np.uint64, len(tokens))
        width = min(self.words, len(h))
        key = h[: len(h) - width + 1].copy()
        for k in range(1, width):
            key *= np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
            key += h[k : len(h) - width + 1 + k]
        return np.unique(key)


def signature(shingles: np.ndarray) -> np.ndarray:
    """HASHES MinHash values of 32 bits."""
    best = np.full(HASHES, 2**32 - 1, np.uint64)
    for at in range(0, len(shingles), 2048):
        part = shingles[at : at + 2048]
        mixed = part[None, :] * _MUL[:, None] + _ADD[:, None]
        best = np.minimum(best, (mixed >> np.uint64(32)).min(1))
    return best.astype(np.uint32)


@functools.lru_cache(4)
def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> np.ndarray:
    """For n compared values, the fewest matches at which a pair stays.

    With a uniform prior the similarity after m of n matches is Beta(m+1, n-m+1), and its
    tail from ``threshold`` is a binomial sum.
    """
    out = np.zeros(HASHES + 1, np.int64)
    for n in range(1, HASHES + 1):
        tail, m = 0.0, 0
        while m <= n:
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= tolerance:
                break
            m += 1
        out[n] = m
    return out


def likely_pairs(a: np.ndarray, b: np.ndarray, sig: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs (a[i], b[i]), those that the posterior does not rule out."""
    matches = np.zeros(len(a), np.int64)
    for at in range(0, HASHES, STEP):
        matches += (sig[a, at : at + STEP] == sig[b, at : at + STEP]).sum(1)
        ok = matches >= least[at + STEP]
        a, b, matches = a[ok], b[ok], matches[ok]
        if not len(a):
            break
    return a, b


def cell_pairs(block: np.ndarray, first: int, second: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of a cell, some rows at a time: within a block, or across its two."""
    if first == second:
        n = len(block)
        for at in range(0, n, 64):
            i, j = np.meshgrid(np.arange(at, min(at + 64, n)), np.arange(n), indexing="ij")
            keep = i < j
            yield i[keep], j[keep]
    else:
        left, right = np.flatnonzero(block == first), np.flatnonzero(block == second)
        for at in range(0, len(left), 64):
            i, j = np.meshgrid(left[at : at + 64], right, indexing="ij")
            yield i.ravel(), j.ravel()


class Roots:
    """Union-find over the members of a cell."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join_all(self, a: np.ndarray, b: np.ndarray) -> None:
        """Link pairs; each round draws every member to its smallest neighbour first."""
        for i, j in zip(a.tolist(), b.tolist()):
            x, y = self.find(i), self.find(j)
            if x != y:
                self.up[max(x, y)] = min(x, y)


Cell = dict[str, np.ndarray]


def by_cell(work: Callable[[Cell], Cell | None]) -> Callable:
    """A function for mapInPandas that gives ``work`` the columns of one whole cell at a time.

    Its input is partitioned by the cell and sorted by it; a cell may go on from one
    Arrow batch to the next.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Cell = {}

        def worked(cols: Cell, cuts: list[tuple[int, int]]) -> Iterator[pd.DataFrame]:
            out = [r for x, y in cuts if (r := work({k: v[x:y] for k, v in cols.items()})) is not None]
            if out:
                yield pd.DataFrame({k: np.concatenate([r[k] for r in out]) for k in out[0]})

        for batch in batches:
            if batch.empty:
                continue
            cols = {k: batch[k].to_numpy() for k in batch.columns}
            if held:
                cols = {k: np.concatenate([held[k], v]) for k, v in cols.items()}
            new = np.zeros(len(cols["_g"]) - 1, bool)
            for k in ("_g", "_i", "_j"):
                new |= cols[k][1:] != cols[k][:-1]
            cut = [0, *(np.flatnonzero(new) + 1).tolist()]
            yield from worked(cols, list(zip(cut[:-1], cut[1:])))
            held = {k: v[cut[-1] :].copy() for k, v in cols.items()}
        if held:
            yield from worked(held, [(0, len(held["_g"]))])

    return run


def in_cells(members: DataFrame, group: str, size: str, block: int = BLOCK) -> DataFrame:
    """``members`` once for every cell they belong to, as _g, _i, _j and _b (their block)."""
    blocks = F.ceil(F.col(size) / block).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("_nb") - 1))
    return (
        members.withColumn("_nb", blocks)
        .withColumn("_b", F.pmod(F.xxhash64("_c", F.lit("block")), F.col("_nb")).cast("int"))
        .withColumn("_o", other)
        .withColumn("_g", F.xxhash64(F.col(group)))
        .withColumn("_i", F.least("_b", "_o"))
        .withColumn("_j", F.greatest("_b", "_o"))
        .drop("_nb", "_o", group, size)
    )


def _dealt(cells: DataFrame) -> DataFrame:
    return cells.repartition("_g", "_i", "_j").sortWithinPartitions("_g", "_i", "_j")


def _edges_of_cell(cell: Cell) -> Cell | None:
    """Members and their root under the pairs that pruning leaves."""
    sig = np.frombuffer(b"".join(cell["_sig"]), np.uint32).reshape(len(cell["_c"]), HASHES)
    return _rooted(cell, *_gather(cell, sig))


def _gather(cell: Cell, sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    least, kept = least_matches(), []
    for a, b in cell_pairs(cell["_b"], int(cell["_i"][0]), int(cell["_j"][0])):
        kept.append(likely_pairs(a, b, sig, least))
    if not kept:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([x[0] for x in kept]), np.concatenate([x[1] for x in kept])


def _rooted(cell: Cell, a: np.ndarray, b: np.ndarray) -> Cell | None:
    if not len(a):
        return None
    roots = Roots(len(cell["_c"]))
    roots.join_all(a, b)
    member = np.unique(np.concatenate([a, b]))
    root = [roots.find(i) for i in member.tolist()]
    return {"_c": cell["_c"][member], "_root": cell["_c"][root]}


@functools.lru_cache(1)
def _task_shingler() -> Shingler:
    return Shingler()


def _links_of_cell(cell: Cell) -> Cell | None:
    """Members with their verified links, counted with copies, and their root."""
    sets = [_task_shingler()(t) for t in cell["_text"]]
    sig = np.vstack([signature(s) for s in sets])
    a, b = _gather(cell, sig)
    if not len(a):
        return None
    sizes = np.array([len(s) for s in sets])
    starts = np.concatenate([[0], np.cumsum(sizes)])
    vocab, flat = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(a, kind="stable")
    a, b = a[order], b[order]
    ok = np.zeros(len(a), bool)
    mark = np.zeros(len(vocab), bool)
    cut = np.flatnonzero(a[1:] != a[:-1]) + 1
    for x, y in zip([0, *cut], [*cut, len(a)]):
        mine = flat[starts[a[x]] : starts[a[x] + 1]]
        mark[mine] = True
        for z in range(x, y, 256):
            with_ = b[z : min(z + 256, y)]
            ids = np.concatenate([flat[starts[k] : starts[k + 1]] for k in with_])
            edge = np.concatenate([[0], np.cumsum(sizes[with_])[:-1]])
            both = np.add.reduceat(mark[ids].astype(np.int64), edge)
            union = len(mine) + sizes[with_] - both
            # In whole numbers, so that exactly 0.8 is not lost to rounding.
            ok[z : z + len(with_)] = 1000 * both >= round(1000 * THRESHOLD) * union
        mark[mine] = False
    a, b = a[ok], b[ok]
    rows = _rooted(cell, a, b)
    if rows is None:
        return None
    copies = cell["_copies"].astype(np.int64)
    links = np.zeros(len(copies), np.int64)
    np.add.at(links, a, copies[b])
    np.add.at(links, b, copies[a])
    rows["_links"] = links[np.unique(np.concatenate([a, b]))]
    return rows


def components(edges: DataFrame) -> DataFrame:
    """_c and _label, the smallest member of its component, from rows of _c and _root.

    Each round points every node at its smallest neighbour and contracts the edges to
    what is pointed at; edges within one label vanish, so there are fewer each time.
    Every round is written out, which cuts the lineage.
    """
    edges = stage(edges.select(F.col("_c").alias("_a"), F.col("_root").alias("_b")).where("_a <> _b").distinct(), "edges")
    labels = None
    while True:
        ends = edges.unionByName(edges.select(F.col("_b").alias("_a"), F.col("_a").alias("_b")))
        points = stage(ends.groupBy("_a").agg(F.least(F.col("_a"), F.min("_b")).alias("_to")), "points")
        if labels is None:
            labels = points.select(F.col("_a").alias("_c"), F.col("_to").alias("_label"))
        else:
            moved = labels.join(points.withColumnRenamed("_a", "_label"), "_label", "left")
            labels = stage(moved.select("_c", F.coalesce("_to", "_label").alias("_label")), "labels")
        other = points.select(F.col("_a").alias("_b"), F.col("_to").alias("_to_b"))
        edges = stage(
            edges.join(points, "_a").join(other, "_b")
            .select(F.col("_to").alias("_a"), F.col("_to_b").alias("_b")).where("_a <> _b").distinct(),
            "edges",
        )
        if edges.isEmpty():
            return labels


def _counter(shingles: np.ndarray) -> np.ndarray:
    """The counter of each shingle."""
    return ((shingles * _MUL[0]) >> np.uint64(44)).astype(np.int64)


def _count_shingles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The counters of a task's texts, those above zero."""
    shingler, total = Shingler(), np.zeros(COUNTERS, np.int64)
    for batch in batches:
        for text in batch["_text"]:
            np.add.at(total, _counter(shingler(text)), 1)
    used = np.flatnonzero(total)
    yield pd.DataFrame({"_k": used, "_n": total[used]})


def rare_shingles(shingles: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The rarest shingles of a set: two sets that reach THRESHOLD have one of theirs in common.

    They share THRESHOLD of either, so of its n shingles each must show the first
    n - ceil(THRESHOLD * n) + 1 in any order that is the same for all sets.  ``counts`` makes
    the order: its counters are shared and may be too high, which costs work and loses
    nothing.  They are never too low, so a shingle counted once is in no other set.
    """
    n = len(shingles)
    need = -(-round(1000 * THRESHOLD) * n // 1000)
    seen = counts[_counter(shingles)]
    first = np.lexsort((shingles, seen))[: n - need + 1]
    return shingles[first[seen[first] > 1]]


def connected(texts: DataFrame) -> DataFrame:
    """_c and _label for the rows of _c and _text that rare shingles connect; the others are left out."""
    # A fixed number of counters, whatever the texts are.
    sums = texts.select("_text").mapInPandas(_count_shingles, "_k long, _n long").groupBy("_k").agg(F.sum("_n").alias("_n"))
    some = sums.where("_n > 1").toPandas()
    counts = np.zeros(COUNTERS, np.int64)
    counts[some["_k"].to_numpy(np.int64)] = some["_n"].to_numpy(np.int64)
    shared = texts.sparkSession.sparkContext.broadcast(counts)

    def rare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler()
        for batch in batches:
            sets = [rare_shingles(shingler(t), shared.value).view(np.int64) for t in batch["_text"]]
            sizes = [len(s) for s in sets]
            yield pd.DataFrame({"_c": batch["_c"].repeat(sizes), "_s": np.concatenate(sets) if sets else np.zeros(0, np.int64)})

    rows = stage(texts.select("_c", "_text").mapInPandas(rare, "_c binary, _s long"), "rare-shingles")
    roots = rows.groupBy("_s").agg(F.min("_c").alias("_root"), F.count("*").alias("_n")).where("_n > 1").select("_s", "_root")
    return components(rows.join(roots, "_s").select("_c", "_root"))


def _groups(banded: DataFrame) -> DataFrame:
    """_c, _band and _n (its members) for bands of two and more.

    Bands that hold the very same members do the same work: one of them stays.
    """
    shared = (
        banded.groupBy("_band")
        .agg(F.count("*").alias("_n"), F.bit_xor(F.xxhash64("_c")).alias("_x"), F.bit_xor(F.xxhash64("_c", F.lit(1))).alias("_y"))
        .where("_n > 1")
        .groupBy("_n", "_x", "_y")
        .agg(F.min("_band").alias("_band"))
        .select("_band", "_n")
    )
    return banded.join(shared, "_band").select("_c", "_band", "_n")


def _with_text(docs: DataFrame, sets: DataFrame) -> DataFrame:
    """``sets``, which name a document by d, t1 and t2, with its _text; one row per _c."""
    keyed = docs.select(
        F.coalesce("doc_id", F.lit(2**63 - 1)).alias("d"), F.xxhash64("text").alias("t1"),
        F.xxhash64(F.lit("second"), "text").alias("t2"), F.col("text").alias("_text"),
    )
    return keyed.join(sets, ["d", "t1", "t2"]).drop("d", "t1", "t2").dropDuplicates(["_c"])


def split_bands(docs: DataFrame, members: DataFrame, first: DataFrame) -> DataFrame:
    """``members`` with bands of more than HOT members cut into parts that rare shingles connect."""
    hot = members.where(F.col("_n") > HOT)
    sets = stage(hot.select("_c").distinct(), "hot-sets")
    if sets.isEmpty():
        return members
    texts = stage(_with_text(docs, first.select("_c", "d", "t1", "t2").join(sets, "_c")), "hot-texts")
    parts = hot.join(connected(texts), "_c").select("_c", F.xxhash64("_band", "_label").alias("_band"))
    return members.where(F.col("_n") <= HOT).unionByName(_groups(stage(parts, "parts")))


def _read_sets(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    shingler = Shingler()
    for texts in batches:
        rows = []
        for t in texts:
            s = shingler(t)
            rows.append((xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None, signature(s).tobytes() if len(s) else None))
        yield pd.DataFrame(rows, columns=["_c", "_sig"])


def _order(doc_id: str = "doc_id"):
    """What comes first: the smallest id, null ids last, then by text."""
    return F.struct(F.coalesce(F.col(doc_id), F.lit(2**63 - 1)).alias("d"), F.col("_t1").alias("t1"), F.col("_t2").alias("t2"))


def keyed_sets(docs: DataFrame) -> DataFrame:
    """doc_id, _t1, _t2 (hashes of the text), _c (the shingle set, null if empty), _sig."""
    sets = F.pandas_udf(_read_sets, "_c binary, _sig binary")
    rows = docs.select(
        "doc_id", F.xxhash64("text").alias("_t1"), F.xxhash64(F.lit("second"), "text").alias("_t2"), sets("text").alias("_s")
    )
    return stage(rows.select("doc_id", "_t1", "_t2", "_s.*"), "shingle-sets")


def classes(docs: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """_c, _copies, _first (its first document), _links (of its set), _label (its class).

    One row per distinct shingle set that is not empty; ``_label`` is the set's own _c
    where it has no link.
    """
    rows = keyed_sets(docs) if rows is None else rows
    reps = stage(
        rows.where("_c IS NOT NULL").groupBy("_c").agg(
            F.count("*").alias("_copies"), F.min(_order()).alias("_first"), F.first("_sig").alias("_sig")
        ),
        "distinct-sets",
    )
    bands = F.array(*[
        F.xxhash64(F.lit(i), F.substring("_sig", 1 + 4 * ROWS * i, 4 * ROWS)) for i in range(BANDS)
    ])
    banded = reps.select("_c", F.explode(bands).alias("_band"))
    first = reps.select("_c", "_copies", "_first.*")
    members = split_bands(docs, stage(_groups(banded), "candidates"), first)
    cells = in_cells(members.join(reps.select("_c", "_sig"), "_c"), "_band", "_n")
    likely = _dealt(cells).mapInPandas(by_cell(_edges_of_cell), "_c binary, _root binary")
    grouped = components(likely)
    sized = grouped.join(grouped.groupBy("_label").agg(F.count("*").alias("_n")), "_label")
    texts = _with_text(docs, sized.join(first, "_c")).select("_c", "_label", "_n", "_copies", "_text")
    cells = in_cells(texts, "_label", "_n")
    verified = stage(
        _dealt(cells).mapInPandas(by_cell(_links_of_cell), "_c binary, _root binary, _links long"), "verified"
    )
    links = verified.groupBy("_c").agg(F.sum("_links").alias("_links"))
    labels = components(verified.select("_c", "_root"))
    return (
        reps.select("_c", "_copies", "_first")
        .join(links, "_c", "left")
        .join(labels, "_c", "left")
        .select("_c", "_copies", "_first", F.coalesce("_links", F.lit(0)).alias("_links"), F.coalesce("_label", "_c").alias("_label"))
    )


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, class_id and n_links for every row of ``docs``.

    ``n_links`` counts the other rows whose shingle sets reach a Jaccard similarity of
    THRESHOLD, copies included; ``class_id`` is the smallest id among all rows that links
    connect.  Null and blank texts have no shingles: they link to nothing and are their
    own class, as is a class of null ids only (class_id null).  Texts below five words
    are one shingle.  Repeated rows count as copies.  An empty table gives an empty
    result; other columns are ignored.
    """
    rows = keyed_sets(docs)
    sets = classes(docs, rows)
    tops = sets.groupBy("_label").agg(F.min("_first").alias("_top"))
    # Written, so that the last join has nothing but reads below it and skew can be split.
    known = stage(sets.join(tops, "_label").select("_c", "_copies", "_links", F.col("_top.d").alias("_top")), "classes")
    top = F.when(F.col("_top") < 2**63 - 1, F.col("_top"))
    return rows.join(known, "_c", "left").select(
        "doc_id",
        F.when(F.col("_c").isNull(), F.col("doc_id")).otherwise(top).alias("class_id"),
        F.coalesce(F.col("_links") + F.col("_copies") - 1, F.lit(0)).alias("n_links"),
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with the first document of every class: smallest id, null ids last.

    Blank texts are no copies of each other and stay.  Of rows alike in id and text one
    stays.
    """
    rows = keyed_sets(docs)
    sets = classes(docs, rows)
    firsts = sets.groupBy("_label").agg(F.min("_first").alias("_f")).select("_f.*")
    keyed = docs.select(
        "*", F.coalesce("doc_id", F.lit(2**63 - 1)).alias("_d"), F.xxhash64("text").alias("_t1"),
        F.xxhash64(F.lit("second"), "text").alias("_t2"),
    )
    blank = rows.where("_c IS NULL").select(_order().alias("_f")).select("_f.*").distinct()
    often = rows.where("_c IS NOT NULL").groupBy(_order().alias("_f")).count().where("count > 1").select("_f.*", F.lit(True).alias("_often"))
    stay = firsts.unionByName(blank).join(often, ["d", "t1", "t2"], "left")
    kept = keyed.join(
        stay.select(F.col("d").alias("_d"), F.col("t1").alias("_t1"), F.col("t2").alias("_t2"), "_often"), ["_d", "_t1", "_t2"]
    )
    single = kept.where("_often IS NULL").select(docs.columns)
    return single.unionByName(kept.where("_often").dropDuplicates(["_d", "_t1", "_t2"]).select(docs.columns))


def op8(spark, sf_dir: str) -> DataFrame:
    from tidemill.sources.tables import read_table

    return near_duplicates(read_table(spark, sf_dir, "documents"))


# All pairs that share a shingle, compared exactly; ids are unique in the given tables.
SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
  FROM documents),
starts AS (
  SELECT doc_id, words, unnest(generate_series(1, greatest(len(words) - 4, 1))) AS i FROM d WHERE len(words) > 0),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(words, i, i + 4), ' ') AS g FROM starts),
sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
  FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 10 * c >= 8 * (x.n + y.n - c)),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
classes AS (
  SELECT a AS doc_id, min(b) AS class_id FROM reach GROUP BY a),
counts AS (
  SELECT a AS doc_id, count(*) AS n_links FROM links GROUP BY a)
SELECT doc_id, class_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links FROM classes LEFT JOIN counts USING (doc_id)
"""
