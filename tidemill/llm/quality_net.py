"""Quality: random-indexing word vectors, pooled per document, and a two-layer network.

Each word bucket has a sparse random index vector.  A word's vector is the sum of the
index vectors of the words next to it over the whole corpus: partial sums per task,
added up by bucket.  A document is the mean and spread of its words' vectors.  A network
of two layers, trained in numpy on a bounded sample of labelled documents, gives a
probability whose temperature is fitted on documents that training did not see.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.toxicity import labelled_sample, split_of

#: Documented bounds of the training sample.
SAMPLE_GOOD = 4000
SAMPLE_BAD = 3000
CUT = 0.7

BUCKETS = 4096
DIM = 32
NONZERO = 2
REACH = 2
HIDDEN = 24
EPOCHS = 60
MAX_CACHE = 300_000

_TOKEN = re.compile(r"\w+|[^\w\s]+")


class _Memo(dict):
    """Bucket of a token; an upper-case word has a bucket of its own shape as well."""

    def __missing__(self, token: str) -> int:
        if token.isupper() and len(token) > 1:
            token = f"\x00{token[:2]}"
        elif not token[0].isalnum():
            token = f"\x01{token[:3]}"
        self[token] = b = zlib.crc32(token.encode("utf-8", "surrogatepass")) % BUCKETS
        return b


class Reader:
    """Texts as bucket numbers."""

    def __init__(self):
        self.memo = _Memo()

    def ids(self, text: str | None) -> np.ndarray:
        tokens = _TOKEN.findall(text) if text else []
        if len(self.memo) > MAX_CACHE:
            self.memo.clear()
        return np.fromiter(map(self.memo.__getitem__, tokens), np.int64, len(tokens))


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of each bucket's index vector, from a fixed seed."""
    rng = np.random.default_rng(2024)
    place = np.argsort(rng.random((BUCKETS, DIM)), axis=1)[:, :NONZERO]
    return place, rng.choice([-1, 1], (BUCKETS, NONZERO))


def add_contexts(total: np.ndarray, ids: np.ndarray, place: np.ndarray, sign: np.ndarray) -> None:
    """Add to each word's row the index vectors of the words up to REACH places away."""
    size = total.size
    flat = total.reshape(-1)
    for d in range(1, REACH + 1):
        left, right = ids[:-d], ids[d:]
        if not len(left):
            continue
        for word, near in ((left, right), (right, left)):
            for j in range(NONZERO):
                flat += np.bincount(word * DIM + place[near, j], sign[near, j], size).astype(np.int64)


def context_sums(docs: DataFrame, text: str = "text") -> DataFrame:
    """bucket, n, c0 .. c31: occurrences and summed contexts over all documents."""
    names = ["n", *(f"c{i}" for i in range(DIM))]

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader, (place, sign) = Reader(), index_vectors()
        total, count = np.zeros((BUCKETS, DIM), np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            held: list[np.ndarray] = []
            for t in [*batch["_t"], None]:
                if t:
                    held.append(reader.ids(t))
                if held and (t is None or sum(map(len, held)) > 200_000):
                    # Texts are put end to end; what meets at the seams is taken off again.
                    ids = np.concatenate(held)
                    add_contexts(total, ids, place, sign)
                    count += np.bincount(ids, minlength=BUCKETS)
                    _take_seams(total, held, place, sign)
                    held = []
        seen = np.flatnonzero(count)
        if len(seen):
            out = pd.DataFrame(total[seen], columns=names[1:])
            out.insert(0, "n", count[seen])
            out.insert(0, "bucket", seen)
            yield out

    schema = "bucket long, " + ", ".join(f"{c} long" for c in names)
    parts = docs.select(F.col(text).alias("_t")).mapInPandas(partial, schema)
    return parts.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in names])


def _take_seams(total: np.ndarray, held: list[np.ndarray], place: np.ndarray, sign: np.ndarray) -> None:
    """Undo the contexts that run from one text into the next."""
    full = [h for h in held if len(h)]
    stream = np.concatenate(full) if full else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(full)), [len(h) for h in full])
    for d in range(1, REACH + 1):
        cross = np.flatnonzero(owner[:-d] != owner[d:]) if len(owner) > d else []
        for i in cross:
            for a, b in ((i, i + d), (i + d, i)):
                total[stream[a], place[stream[b]]] -= sign[stream[b]]


def word_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Unit vectors by bucket.  What comes to the driver has at most BUCKETS rows."""
    sums = context_sums(docs, text).toPandas().set_index("bucket").reindex(range(BUCKETS), fill_value=0)
    vec = sums.drop(columns="n").to_numpy(np.float64)
    # The mean context, which mostly tells how frequent words are, is taken out.
    n = sums["n"].to_numpy(np.float64)
    vec = vec / np.maximum(n, 1)[:, None]
    if n.sum():
        vec -= (n[:, None] * vec).sum(0) / n.sum()
    norm = np.linalg.norm(vec, axis=1, keepdims=True)
    return np.where(norm > 0, vec / np.maximum(norm, 1e-9), 0).astype(np.float32)


def pool(counts: list[np.ndarray], vec: np.ndarray) -> np.ndarray:
    """Mean and spread of the word vectors, and the logarithm of the length."""
    tf = np.vstack(counts).astype(np.float32)
    n = np.maximum(tf.sum(1, keepdims=True), 1)
    mean = tf @ vec / n
    spread = np.sqrt(np.maximum(tf @ (vec * vec) / n - mean * mean, 0))
    return np.hstack([mean * 4, spread * 4, np.log1p(tf.sum(1, keepdims=True)) / 8])


def features(texts, vec: np.ndarray, reader: Reader) -> Iterator[np.ndarray]:
    """Pooled vectors, 256 texts at a time."""
    rows: list[np.ndarray] = []
    for t in texts:
        rows.append(np.bincount(reader.ids(t), minlength=BUCKETS))
        if len(rows) == 256:
            yield pool(rows, vec)
            rows = []
    if rows:
        yield pool(rows, vec)


class Network:
    """Two layers; a probability with a fitted temperature."""

    def __init__(self, width: int, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.mean, self.std = np.zeros(width), np.ones(width)
        self.w1 = rng.normal(0, 1 / np.sqrt(width), (width, HIDDEN))
        self.b1, self.w2, self.b2 = np.zeros(HIDDEN), rng.normal(0, 0.3, HIDDEN), np.zeros(1)
        self.temperature, self.prior = 1.0, 0.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        h = np.maximum(((x - self.mean) / self.std) @ self.w1 + self.b1, 0)
        return h @ self.w2 + self.b2[0]

    def fit(self, x: np.ndarray, y: np.ndarray, seed: int = 6) -> None:
        self.mean, self.std = x.mean(0), x.std(0) + 1e-6
        x = (x - self.mean) / self.std
        rng = np.random.default_rng(seed)
        params = [self.w1, self.b1, self.w2, self.b2]
        m1, m2, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(x))
            for at in range(0, len(x), 64):
                i = order[at : at + 64]
                a = x[i] @ self.w1 + self.b1
                h = np.maximum(a, 0)
                z = h @ self.w2 + self.b2[0]
                dz = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[i]) / len(i)
                da = np.outer(dz, self.w2) * (a > 0)
                grads = [x[i].T @ da + 1e-4 * self.w1, da.sum(0), h.T @ dz, np.array([dz.sum()])]
                step += 1
                for p, g, u, v in zip(params, grads, m1, m2):
                    u *= 0.9
                    u += 0.1 * g
                    v *= 0.999
                    v += 0.001 * g * g
                    p -= 0.003 * (u / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)

    def calibrate(self, z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        """The temperature and offset of least weighted log loss."""
        best = np.inf
        for t in np.geomspace(0.25, 16, 37):
            for b in np.linspace(-3, 3, 25):
                p = np.clip(1 / (1 + np.exp(-np.clip(z / t + b, -30, 30))), 1e-6, 1 - 1e-6)
                loss = -(weight * np.where(y == 1, np.log(p), np.log(1 - p))).sum()
                if loss < best - 1e-9:
                    best, self.temperature, self.prior = loss, float(t), float(b)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature + self.prior, -30, 30)))


def train(sample: pd.DataFrame, totals: dict[int, int], vec: np.ndarray) -> Network:
    """Trained on four fifths of the sample, calibrated on the rest."""
    net = Network(2 * DIM + 1)
    if sample.empty or sample["y"].nunique() < 2:
        return net
    x = np.vstack(list(features(sample["text"], vec, Reader())))
    y = sample["y"].to_numpy(np.float64)
    rest = np.array([zlib.crc32(b"fold:%d" % i) % 5 == 0 for i in sample["doc_id"]])
    if min(y[rest].sum(), (1 - y[rest]).sum(), y[~rest].sum(), (1 - y[~rest]).sum()) < 3:
        rest = np.zeros(len(y), bool)
    net.fit(x[~rest], y[~rest])
    held = rest if rest.any() else ~rest
    real = np.array([totals.get(k, 1) / max(1, (y == k).sum()) for k in (0, 1)])
    net.calibrate(net.logits(x[held]), y[held], real[y[held].astype(int)])
    return net


def score(docs: DataFrame, net: Network, vec: np.ndarray, text: str = "text") -> DataFrame:
    """``docs`` with a column ``score``."""

    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        reader = Reader()
        for texts in batches:
            p = [net.probability(x) for x in features(texts, vec, reader)]
            yield pd.Series(np.concatenate(p) if p else [], dtype="float64")

    return docs.withColumn("score", F.pandas_udf(scored, "double")(F.col(text)))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``.

    Null and empty texts pool to zeros and are scored as such.  Rows with a null id are
    scored and never held out; repeated rows get equal scores.  Labels that are null, or
    of documents that are missing, are not used; a document labelled twice counts as good
    if one label says so.  Without labels of both kinds every score is that of an
    untrained network.  An empty table gives an empty result; extra columns are ignored.
    """
    plain = docs.select("doc_id", "text")
    vec = word_vectors(plain)
    net = train(*labelled_sample(plain, labels, "quality", 4, 2, SAMPLE_GOOD, SAMPLE_BAD), vec)
    held = F.coalesce(split_of("doc_id", 4) == 2, F.lit(False))
    return score(plain, net, vec).select(
        "doc_id", held.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted")
    )


def op5(spark, sf_dir: str) -> DataFrame:
    from tidemill.sources.tables import read_table

    return classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
