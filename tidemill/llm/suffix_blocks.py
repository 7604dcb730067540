"""Exact removal of long repeated byte strings by blockwise suffix sorting.

Every string of LENGTH bytes has one anchor: the place of the smallest hash among the
GRAM-byte strings in it.  Equal strings have equal anchors at equal places, so only
suffixes around anchors with the same hash need comparing: those are the suffix buckets.
Anchors with the same bytes all around are settled by counting.  For the others the bytes
around the anchors are lined up and the suffixes sorted bucket by bucket, some columns at
a time.  A cover of sample columns is sorted first; suffixes that begin between two
samples share long ties, which the ranks at the next sample column resolve, so no
comparison ever runs over a whole suffix.  In a difference cover any two places meet a
sample after the same distance; lined up at their anchors, all suffixes of a bucket have
the same remainder, so the cover needs one residue, every COVER-th column.

Passages are found in the same way, with words in place of bytes: a string of WORDS words
that other documents hold too is often shorter than LENGTH bytes.  They are counted, not
removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import content_key
from tidemill.session import stage

LENGTH = 400
GRAM = 100
COVER = 50
#: Words of a passage, of the strings its anchors are chosen by, and between sample columns.
WORDS = 50
WORD_GRAM = 8
WORD_COVER = 20
#: Contexts of a bucket, of bytes and of words, that one task may sort; larger buckets are met by
#: hashing windows.  Words have fewer starts and need a tenth of the work.
BUCKET = 4000
WORD_BUCKET = 20_000
#: Contexts sorted together.
BATCH = 4000

#: Length of the strings and of their anchors and size of a bucket, in bytes and in words.
Strings = tuple[tuple[int, int, int], tuple[int, int, int]]
STRINGS: Strings = ((LENGTH, GRAM, BUCKET), (WORDS, WORD_GRAM, WORD_BUCKET))

_POS_BITS = 17
_CHUNK = (1 << _POS_BITS) - 1024


def _grams(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of every string of ``gram`` bytes or words, built by doubling."""
    base = 0x9E3779B97F4A7C15
    table = np.random.default_rng(31).integers(0, 2**63, 256, dtype=np.uint64)
    done: np.ndarray | None = None
    done_len, power, size = 0, table[data] if data.dtype == np.uint8 else data, 1
    while True:
        if gram & size:
            if done is None:
                done, done_len = power, size
            else:
                n = len(data) - done_len - size + 1
                done = done[:n] * np.uint64(pow(base, size, 2**64)) + power[done_len : done_len + n]
                done_len += size
        if size * 2 > gram:
            break
        n = len(power) - size
        power = power[:n] * np.uint64(pow(base, size, 2**64)) + power[size:]
        power ^= power >> np.uint64(31)
        size *= 2
    h = done * np.uint64(0xC2B2AE3D27D4EB4F)
    return h ^ (h >> np.uint64(32))


def _raw(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if text else b""


def _tokens(raw: bytes) -> np.ndarray:
    """A 64-bit hash of every word; ``split`` parts them at the white space of ``common.WORD``."""
    words = raw.split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def anchors(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Anchors of a text's bytes or words: place, first and last string start they stand for, hash.

    Among equal hashes the leftmost counts.  Long texts are read in overlapping chunks.
    """
    n, width = len(data), length - gram + 1
    places, hashes, first = [], [], []
    for at in range(0, max(0, n - length + 1), _CHUNK - length):
        part = data[at : at + _CHUNK]
        starts = min(len(part) - length + 1, _CHUNK - length)
        if starts <= 0:
            break
        h = _grams(part, gram)
        key = (h >> np.uint64(_POS_BITS) << np.uint64(_POS_BITS)) | np.arange(len(h), dtype=np.uint64)
        done, done_len, low, size = None, 0, key, 1
        while True:
            if width & size:
                if done is None:
                    done, done_len = low, size
                else:
                    m = len(key) - done_len - size + 1
                    done = np.minimum(done[:m], low[done_len : done_len + m])
                    done_len += size
            if size * 2 > width:
                break
            low = np.minimum(low[: len(low) - size], low[size:])
            size *= 2
        place = (done[:starts] & np.uint64((1 << _POS_BITS) - 1)).astype(np.int64)
        new = np.concatenate([[True], place[1:] != place[:-1]])
        first.append(np.flatnonzero(new) + at)
        places.append(place[new] + at)
        hashes.append(h[place[new]])
    if not places:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64)
    p, lo, f = np.concatenate(places), np.concatenate(first), np.concatenate(hashes)
    hi = np.append(lo[1:], n - length + 1) - 1
    # A chunk's edge may cut an anchor's strings in two.
    keep = np.concatenate([[True], p[1:] != p[:-1]])
    hi = hi[np.append(np.flatnonzero(keep)[1:] - 1, len(p) - 1)]
    return p[keep], lo[keep], hi, f[keep]


# The lowest bit of _f tells words (1) from bytes (0), so that their buckets never meet.
_ANCHOR = "_k1 long, _k2 long, _p int, _q int, _s int, _f long, _x long, _c int"


def _anchor_rows(data: np.ndarray, length: int, gram: int, unit: int) -> list[np.ndarray]:
    """_p, _q, _s, _f, _x and _c of a text: one row of those alike, and how many they are."""
    p, lo, hi, f = anchors(data, length, gram)
    raw, size = data.tobytes(), data.itemsize
    x = np.fromiter(
        (xxhash.xxh3_64_intdigest(raw[a * size : (b + length) * size]) for a, b in zip(lo.tolist(), hi.tolist())), np.uint64, len(lo)
    )
    rows = [p, p - lo, hi - lo + 1, (f & ~np.uint64(1) | np.uint64(unit)).view(np.int64), x.view(np.int64)]
    count = np.ones(len(p), np.int64)
    if len(np.unique(f)) < len(f):
        _, first, count = np.unique(np.stack(rows[1:], 1), axis=0, return_index=True, return_counts=True)
        rows = [c[first] for c in rows]
    # A document counts once for its passages, wherever it repeats them.
    return [*rows, np.ones_like(count) if unit else count]


def _read_anchors(strings: Strings):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cols: list[list[np.ndarray]] = [[] for _ in range(8)]
            for k1, k2, text in zip(batch["_k1"], batch["_k2"], batch["_t"]):
                raw = _raw(text)
                for unit, (length, gram, _) in enumerate(strings):
                    # A word takes a byte, and another that parts it from the next.
                    if len(raw) < (length, 2 * length - 1)[unit]:
                        continue
                    values = _anchor_rows(_tokens(raw) if unit else np.frombuffer(raw, np.uint8), length, gram, unit)
                    n = len(values[0])
                    for c, v in zip(cols, (np.full(n, k1), np.full(n, k2), *values)):
                        c.append(v)
            if cols[0]:
                names = [x.split()[0] for x in _ANCHOR.split(", ")]
                yield pd.DataFrame({k: np.concatenate(c) for k, c in zip(names, cols)})

    return run


_CONTEXT = "_f long, _n long, _k1 long, _k2 long, _lo int, _q int, _s int, _m long, _b binary"


def _read_contexts(strings: Strings):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k1, k2, text, wanted in zip(batch["_k1"], batch["_k2"], batch["_t"], batch["_w"]):
                raw = _raw(text)
                words = raw.split() if any(w["_f"] & 1 for w in wanted) else []
                for w in wanted:
                    unit, lo = w["_f"] & 1, w["_p"] - w["_q"]
                    hi = lo + w["_s"] - 1 + strings[unit][0]
                    # Words travel as text, which compresses better than their hashes.
                    part = b" ".join(words[lo:hi]) if unit else raw[lo:hi]
                    rows.append((w["_f"], w["_n"], k1, k2, lo, w["_q"], w["_s"], w["_m"], part))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in _CONTEXT.split(", ")])

    return run


def _ranks(rows: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows within buckets, and how many bytes or words each shares with the one before."""
    n, width = rows.shape
    size = width * rows.itemsize
    key = np.empty((n, size + 4), np.uint8)
    key[:, :4] = (bucket + 1).astype(">u4").view(np.uint8).reshape(n, 4)
    key[:, 4:] = np.ascontiguousarray(rows).view(np.uint8).reshape(n, size)
    order = np.argsort(np.ascontiguousarray(key).view(f"S{size + 4}").ravel(), kind="stable")
    shared = np.full(n, -1, np.int64)
    if n > 1:
        differ = rows[order[1:]] != rows[order[:-1]]
        same = bucket[order[1:]] == bucket[order[:-1]]
        shared[1:] = np.where(same, np.where(differ.any(1), differ.argmax(1), width), -1)
    return order, shared


def repeated_windows(bucket: np.ndarray, q: np.ndarray, s: np.ndarray, copies: np.ndarray, texts: list[bytes],
                     length: int = LENGTH, gram: int = GRAM, cover: int = COVER, docs: np.ndarray | None = None) -> np.ndarray:
    """For every context and start column, whether its ``length`` bytes occur twice in the bucket.

    Contexts are lined up so that their anchors stand in one column, ``length - gram``.
    With ``docs``, the documents of the contexts, they are words that must occur in two documents.
    """
    n, zero = len(bucket), length - gram
    kind = np.uint8 if docs is None else np.uint64
    lined = np.zeros((n, 2 * length), kind)
    for i, t in enumerate(texts):
        at, units = zero - q[i], np.frombuffer(t, kind) if docs is None else _tokens(t)
        lined[i, at : at + len(units)] = units
    out = np.zeros((n, zero + 1), bool)
    first, last = zero - q, zero - q + s - 1
    for column in range(0, zero + cover, cover):
        column = min(column, zero)
        low = max(0, column - cover + 1)
        rows = np.flatnonzero((first <= column) & (last >= low))
        if len(rows) < 2:
            continue
        mine = bucket[rows]
        right, right_shared = _ranks(lined[rows, column : column + length], mine)
        left, left_shared = _ranks(lined[rows, low:column][:, ::-1], mine) if column > low else (np.argsort(mine, kind="stable"), None)
        rank_r, rank_l = np.empty(len(rows), np.int64), np.empty(len(rows), np.int64)
        for start in range(low, column + 1):
            use = (first[rows] <= start) & (last[rows] >= start)
            if use.sum() < 2:
                continue
            rank_r[right] = np.cumsum(right_shared < start + length - column)
            if start == column:
                key = rank_r[use]
            else:
                rank_l[left] = np.cumsum(left_shared < column - start)
                key = rank_r[use] * (len(rows) + 1) + rank_l[use]
            _, same = np.unique(key, return_inverse=True)
            if docs is None:
                twice = np.bincount(same, copies[rows[use]]) >= 2
            else:
                mine_, some = docs[rows[use]], np.empty(same.max() + 1, docs.dtype)
                some[same] = mine_
                twice = np.bincount(same, (mine_ != some[same]) | (copies[rows[use]] > 1)) > 0
            out[rows[use], start] = twice[same]
    return out


def _intervals(flags: np.ndarray, lo: np.ndarray, q: np.ndarray, zero: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of flagged starts as (row, first start, last start) in the text."""
    padded = np.zeros((len(flags), flags.shape[1] + 2), np.int8)
    padded[:, 1:-1] = flags
    step = np.diff(padded, axis=1)
    row, a = np.nonzero(step == 1)
    _, b = np.nonzero(step == -1)
    shift = lo[row] + q[row] - zero
    return row, a + shift, b - 1 + shift


_FOUND = "_k1 long, _k2 long, _a int, _z int, _u int, _e boolean"


def _sort_buckets(strings: Strings):
    """Whole buckets, many at a time; input is partitioned and sorted by _f."""

    def settle(cols: dict[str, np.ndarray]) -> Iterator[pd.DataFrame]:
        for unit, (length, gram, _) in enumerate(strings):
            own = cols["_f"] & 1 == unit
            if own.any():
                yield settle_unit({k: v[own] for k, v in cols.items()}, length, gram, unit)

    def settle_unit(cols: dict[str, np.ndarray], length: int, gram: int, unit: int) -> pd.DataFrame:
        _, bucket = np.unique(cols["_f"], return_inverse=True)
        q, s, lo = (cols[k].astype(np.int64) for k in ("_q", "_s", "_lo"))
        cover, docs = (WORD_COVER, cols["_k1"]) if unit else (COVER, None)
        flags = repeated_windows(bucket, q, s, cols["_m"].astype(np.int64), list(cols["_b"]), length, gram, cover, docs)
        flags[cols["_m"] > 1] = False  # settled by counting; they are here for the others
        row, a, z = _intervals(flags, lo, q, length - gram)
        return pd.DataFrame({"_k1": cols["_k1"][row], "_k2": cols["_k2"][row], "_a": a, "_z": z, "_u": unit, "_e": unit == 1})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            cols = {k: batch[k].to_numpy() for k in batch.columns}
            if held:
                cols = {k: np.concatenate([held[k], v]) for k, v in cols.items()}
            f = cols["_f"]
            cut = np.concatenate([[0], np.flatnonzero(f[1:] != f[:-1]) + 1])
            at = 0
            for i in range(1, len(cut)):
                if cut[i] - at >= BATCH:
                    yield from settle({k: v[at : cut[i]] for k, v in cols.items()})
                    at = cut[i]
            # The last bucket may go on in the next batch.
            if cut[-1] > at:
                yield from settle({k: v[at : cut[-1]] for k, v in cols.items()})
            held = {k: v[cut[-1] :] for k, v in cols.items()}
        if held:
            yield from settle(held)

    return run


def _hash_windows(strings: Strings):
    """Every start of a context of a large bucket, with a hash of its bytes or words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = []
            for f, k1, k2, lo, s, m, b in zip(*(batch[c] for c in ("_f", "_k1", "_k2", "_lo", "_s", "_m", "_b"))):
                unit = f & 1
                size, length = (8 if unit else 1), strings[unit][0]
                b = _tokens(b).tobytes() if unit else b
                hashes = [xxhash.xxh3_128_digest(b[i * size : (i + length) * size], unit) for i in range(s)]
                parts.append(pd.DataFrame({"_k1": k1, "_k2": k2, "_m": m, "_u": unit, "_a": np.arange(lo, lo + s), "_h": hashes}))
            if parts:
                yield pd.concat(parts)

    return run


def repeats(keyed: DataFrame, strings: Strings = STRINGS) -> DataFrame:
    """_k1, _k2, _a, _z, _u, _e: runs of starts of repeated strings in the texts of ``keyed`` (_k1, _k2, _t).

    ``_u`` is 0 for bytes that also start anywhere else, 1 for words that another document holds.
    With ``_e`` the same strings may stand at more places of the document.
    """
    every = stage(keyed.mapInPandas(_read_anchors(strings), _ANCHOR), "anchors")
    # Written, so that the join has two plain reads and a hash that very many texts share
    # can be split over tasks.
    often = stage(every.groupBy("_f").agg(F.sum("_c").alias("_c")).where("_c > 1").select("_f"), "anchor-hashes")
    # Most anchors stand alone; the others go through two more shuffles.
    every = stage(every.join(often, "_f"), "shared-anchors")
    # A context is what all strings of an anchor cover; its copies are counted.
    contexts = every.groupBy("_f", "_q", "_s", "_x").agg(
        F.sum("_c").alias("_m"), F.min(F.struct("_k1", "_k2", "_p")).alias("_one")
    )
    contexts = stage(contexts.select("_f", "_q", "_s", "_x", "_m", "_one.*"), "contexts")
    copied = every.join(contexts.where("_m > 1").select("_f", "_q", "_s", "_x"), ["_f", "_q", "_s", "_x"]).select(
        "_k1", "_k2", (F.col("_p") - F.col("_q")).alias("_a"), (F.col("_p") - F.col("_q") + F.col("_s") - 1).alias("_z"), F.expr("int(_f & 1) AS _u"), F.expr("_f & 1 = 1 OR _c > 1 AS _e")
    )
    # Buckets in which some context stands alone need sorting.
    mixed = contexts.groupBy("_f").agg(F.count("*").alias("_n"), F.min("_m").alias("_least"))
    mixed = stage(mixed.where("_n > 1 AND _least = 1").select("_f", "_n"), "mixed-buckets")
    wanted = (
        contexts.join(mixed, "_f")
        .groupBy("_k1", "_k2")
        .agg(F.collect_list(F.struct("_f", "_n", "_p", "_q", "_s", "_m")).alias("_w"))
    )
    # One row of several alike is enough to read a context from.
    one = keyed.dropDuplicates(["_k1", "_k2"])
    bytes_ = stage(one.join(wanted, ["_k1", "_k2"]).mapInPandas(_read_contexts(strings), _CONTEXT), "context-bytes")
    most = F.when(F.col("_f").bitwiseAND(F.lit(1)) == 1, strings[1][2]).otherwise(strings[0][2])
    sorted_ = (
        bytes_.where(F.col("_n") <= most).repartition("_f").sortWithinPartitions("_f")
        .mapInPandas(_sort_buckets(strings), _FOUND)
    )
    hashed = bytes_.where(F.col("_n") > most).mapInPandas(
        _hash_windows(strings), "_k1 long, _k2 long, _m long, _u int, _a int, _h binary"
    )
    twice = (
        hashed.groupBy("_u", "_h")
        .agg(F.sum("_m").alias("_c"), (F.min("_k1") != F.max("_k1")).alias("_far"), F.max("_m").alias("_most"))
        .where("_c > 1 AND (_u = 0 OR _far OR _most > 1)")
        .select("_u", "_h")
    )
    large = hashed.where("_m = 1").join(twice, ["_u", "_h"]).select("_k1", "_k2", "_a", F.col("_a").alias("_z"), "_u", (F.col("_u") == 1).alias("_e"))
    return copied.unionByName(sorted_).unionByName(large)


_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, n_passage_words long"


def _spans(starts: list, n: int, length: int) -> list[tuple[int, int]]:
    """What strings of ``length`` cover that start in the runs ``starts``, of ``n`` places."""
    if not starts:
        return []
    cover = np.zeros(n + 1, np.int64)
    a = np.fromiter((x["_a"] for x in starts), np.int64, len(starts))
    z = np.fromiter((x["_z"] for x in starts), np.int64, len(starts))
    np.add.at(cover, a, 1)
    np.add.at(cover, z + length, -1)
    covered = np.concatenate([[0], (np.cumsum(cover)[:n] > 0).astype(np.int8), [0]])
    step = np.diff(covered.astype(np.int8))
    return list(zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist()))


def _cut(raw: bytes, gone: list[tuple[int, int]]) -> bytes:
    """A text without its repeated strings."""
    at, kept = 0, []
    for a, z in gone:
        kept.append(raw[at:a])
        at = z
    kept.append(raw[at:])
    return b"".join(kept)


def _everywhere(data: np.ndarray, starts: list, length: int) -> list:
    """``starts``, and in place of those with _e every run of starts of the same strings in the text."""
    some = [x for x in starts if x["_e"]]
    if not some:
        return starts
    hashes = _grams(data, length)
    found = np.isin(hashes, np.concatenate([hashes[x["_a"] : x["_z"] + 1] for x in some]))
    step = np.diff(np.concatenate([[0], found.astype(np.int8), [0]]))
    runs = zip(np.flatnonzero(step == 1).tolist(), (np.flatnonzero(step == -1) - 1).tolist())
    return [x for x in starts if not x["_e"]] + [{"_a": a, "_z": z} for a, z in runs]


def dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, bucket: int = BUCKET,
          words: int = WORDS, word_gram: int = WORD_GRAM, word_bucket: int = WORD_BUCKET) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes left) and n_passage_words for every row of ``docs``.

    Null texts count as empty; texts below ``length`` bytes lose nothing.  Rows alike in
    id and text are copies of each other, so both lose what is long enough.  An empty
    table gives an empty result; other columns are ignored.  ``n_passage_words`` is the number of
    words in strings of ``words`` words that another row holds too, whatever white space parts
    them; they stay unless their bytes are long enough.
    """
    keyed = docs.select("doc_id", F.col("text").alias("_t"), *content_key("doc_id", "text"))
    found = repeats(keyed.select("_k1", "_k2", "_t"), ((length, gram, bucket), (words, word_gram, word_bucket)))
    starts = found.distinct().groupBy("_k1", "_k2").agg(F.collect_list(F.struct("_a", "_z", "_u", "_e")).alias("_w"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, text, w in zip(batch["doc_id"], batch["_t"], batch["_w"]):
                raw = _raw(text)
                by_unit = [[x for x in w if x["_u"] == unit] if w is not None else [] for unit in (0, 1)]
                gone = _spans(_everywhere(np.frombuffer(raw, np.uint8), by_unit[0], length), len(raw), length)
                tokens = _tokens(raw) if by_unit[1] else np.zeros(0, np.uint64)
                passages = _spans(_everywhere(tokens, by_unit[1], words), len(tokens), words)
                kept = _cut(raw, gone)
                rows.append((doc_id, len(raw), sum(z - a for a, z in gone), len(gone), hashlib.sha256(kept).hexdigest(), kept,
                             sum(z - a for a, z in passages)))
            out = pd.DataFrame(rows, columns=[x.split()[0] for x in _RESULT.split(", ")])
            yield out.astype({"doc_id": "Int64"})

    return keyed.join(starts, ["_k1", "_k2"], "left").select("doc_id", "_t", "_w").mapInPandas(run, _RESULT)


def op6(spark, sf_dir: str) -> DataFrame:
    from tidemill.sources.tables import read_table

    return dedup(read_table(spark, sf_dir, "documents")).drop("kept")
