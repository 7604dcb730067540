"""Toxicity: a convolutional text classifier trained in numpy.

Words are embedded by hashing: a word's vector is the sum of the rows of its own bucket
and of the buckets of its beginnings, so inflected forms share what they have in common.
Filters of several widths run over the words, each filter keeps its largest response
(max pooling), and a linear layer turns the responses into a score.  A threshold per
language, chosen on documents that training did not see, is moved to the same score for
every language.  The language is guessed from the text's own function words.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Documented bounds of the training sample.
SAMPLE_TOXIC = 2500
SAMPLE_CLEAN = 3500
SAMPLE_CHARS = 40_000
#: With fewer labels of either kind nothing is learned and nothing called toxic.
MIN_LABELS = 5
#: The score from which a text counts as toxic.
CUT = 0.7

BUCKETS = 1 << 15
DIM = 16
WIDTHS = (1, 2, 3)
FILTERS = 12
EPOCHS = 12
BATCH = 64
BEGINNINGS = (3, 5, 7)
MAX_CACHE = 120_000

# A few function words by which a text's language is guessed.
FUNCTION_WORDS = {
    "en": ("the", "of", "and", "to", "is", "that", "it"),
    "de": ("der", "die", "und", "das", "ist", "nicht", "mit"),
    "fr": ("le", "les", "des", "et", "dans", "pas", "qui"),
    "es": ("el", "los", "las", "y", "por", "como", "para"),
}

_WORD = re.compile(r"\w+")
_OF_WORD = {w: i for i, ws in enumerate(FUNCTION_WORDS.values()) for w in ws}
LANGUAGES = (*FUNCTION_WORDS, "other")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def guess_language(words: list[str]) -> int:
    """Index into LANGUAGES by the most frequent function words; "other" without any."""
    counts = np.bincount([_OF_WORD[w] for w in words if w in _OF_WORD] or [len(LANGUAGES) - 1], minlength=len(LANGUAGES))
    return int(counts.argmax())


def buckets(word: str) -> tuple[int, ...]:
    """The rows of the embedding table whose sum is the word's vector; row 0 is empty."""
    raw = [word, *(f"{word[:n]}\x00{n}" if len(word) > n else "" for n in BEGINNINGS)]
    return tuple(zlib.crc32(x.encode("utf-8", "surrogatepass")) % (BUCKETS - 1) + 1 if x else 0 for x in raw)


def bounds(padded: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """First and last-but-one places where filters may begin, from the padded lengths of texts."""
    stop = np.cumsum(padded)
    starts = stop - padded
    return starts, np.maximum(stop - max(WIDTHS), starts + 1)


class TextCNN:
    """Hashed embeddings, filters of several widths, max pooling, a linear layer."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.emb = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
        self.emb[0] = 0
        # One column block per (width, offset); block k of width w sees the word k places on.
        self.conv = rng.normal(0, 0.3, (DIM, sum(WIDTHS) * FILTERS)).astype(np.float32)
        self.bias = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        self.out = rng.normal(0, 0.1, len(WIDTHS) * FILTERS).astype(np.float32)
        self.shift = np.zeros(1, np.float32)
        # Logit of each language's threshold; an untrained model calls nothing toxic.
        self.at = np.full(len(LANGUAGES), 2, np.float32)
        self.sharp = 1.0

    def pool(self, proj: np.ndarray, ids: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        """Largest response of every filter in every text, and all responses by width.

        ``ids`` holds the texts' words one after the other, each text followed by as many
        empty words (id 0) as the widest filter needs; a filter may begin at ``starts``
        and before ``ends``, which is a text's last word or its first empty one.
        """
        best, place = [], []
        col = 0
        for w in WIDTHS:
            r = proj[ids, col * FILTERS : (col + 1) * FILTERS]
            for k in range(1, w):
                r[:-k] += proj[ids[k:], (col + k) * FILTERS : (col + k + 1) * FILTERS]
            col += w
            top = np.maximum.reduceat(r, np.column_stack([starts, ends]).ravel())[::2]
            best.append(top)
            place.append(r)
        return np.hstack(best), place

    def fit(self, texts: Iterable[list[str]], y: np.ndarray, weight: np.ndarray, seed: int = 11) -> None:
        """Minibatch Adam on the weighted logistic loss."""
        vocab: dict[str, int] = {"": 0}
        docs = [np.array([vocab.setdefault(w, len(vocab)) for w in t] + [0] * max(WIDTHS), np.int32) for t in texts]
        table = np.array([buckets(w) if w else (0,) * (1 + len(BEGINNINGS)) for w in vocab], np.int64)
        rng = np.random.default_rng(seed)
        params = {"conv": self.conv, "bias": self.bias, "out": self.out, "shift": self.shift}
        m1 = {k: np.zeros_like(v) for k, v in params.items()}
        m2 = {k: np.zeros_like(v) for k, v in params.items()}
        g2 = np.zeros(BUCKETS, np.float32)  # Adagrad for the embedding rows
        step = 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(docs))
            for at in range(0, len(order), BATCH):
                pick = order[at : at + BATCH]
                ids = np.concatenate([docs[i] for i in pick])
                starts, ends = bounds([len(docs[i]) for i in pick])
                seen, local = np.unique(ids, return_inverse=True)
                vec = self.emb[table[seen]].sum(1)
                proj = vec @ self.conv
                top, responses = self.pool(proj, local, starts, ends)
                hidden = np.maximum(top + self.bias, 0)
                drop = (rng.random(hidden.shape) < 0.8).astype(np.float32) / 0.8
                z = (hidden * drop) @ self.out + self.shift[0]
                p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                dz = ((p - y[pick]) * weight[pick] / len(pick)).astype(np.float32)
                grads = {"out": (hidden * drop).T @ dz, "shift": np.array([dz.sum()], np.float32)}
                dtop = np.outer(dz, self.out) * drop * (top + self.bias > 0)
                grads["bias"] = dtop.sum(0)
                dconv, dvec = np.zeros_like(self.conv), np.zeros_like(vec)
                col = 0
                for i, w in enumerate(WIDTHS):
                    d = dtop[:, i * FILTERS : (i + 1) * FILTERS]
                    r = responses[i]
                    where = np.array([r[a:b].argmax(0) + a for a, b in zip(starts, ends)])
                    rows, fs = np.nonzero(d)
                    spot, dv = where[rows, fs], d[rows, fs]
                    for k in range(w):
                        ok = spot + k < len(local)
                        word, c = local[spot[ok] + k], (col + k) * FILTERS + fs[ok]
                        np.add.at(dconv.T, c, vec[word] * dv[ok, None])
                        np.add.at(dvec, word, self.conv[:, c].T * dv[ok, None])
                    col += w
                grads["conv"] = dconv
                step += 1
                for k, g in grads.items():
                    m1[k] = 0.9 * m1[k] + 0.1 * g
                    m2[k] = 0.999 * m2[k] + 0.001 * g * g
                    params[k] -= 0.01 * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
                hit = np.flatnonzero(np.abs(dvec).sum(1))
                rows = table[seen[hit]].ravel()
                g = np.repeat(dvec[hit], table.shape[1], axis=0)
                np.add.at(g2, rows, (g * g).mean(1))
                np.add.at(self.emb, rows, -0.1 * g / (np.sqrt(g2[rows])[:, None] + 1e-6))
                self.emb[0] = 0

    def scorer(self) -> Scorer:
        return Scorer(self)

    def calibrate(self, z: np.ndarray, lang: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        """A threshold per language: the best weighted F1, drawn to that of all where labels are few."""

        def best(z, y, w):
            order = np.argsort(-z, kind="stable")
            hit, all_ = np.cumsum((y * w)[order]), np.cumsum(w[order])
            f1 = 2 * hit / (all_ + (y * w).sum())
            k = int(f1.argmax())
            nxt = z[order[k + 1]] if k + 1 < len(order) else z[order[k]] - 2
            return float((z[order[k]] + max(nxt, z[order[k]] - 4)) / 2)

        every = best(z, y, weight) if y.any() else 0.0
        self.at[:] = every
        for i in range(len(LANGUAGES)):
            mine = lang == i
            n = y[mine].sum()
            if n:
                self.at[i] = (n * best(z[mine], y[mine], weight[mine]) + 20 * every) / (n + 20)


class Scorer:
    """Scores whole texts; keeps the filter responses of words it has met."""

    def __init__(self, model: TextCNN):
        self.model = model
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {"": 0}
        self.proj = np.zeros((4096, self.model.conv.shape[1]), np.float32)

    def _learn(self, new: Iterable[str]) -> None:
        new = list(new)
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            rows = self.model.emb[np.array([buckets(w) for w in part])].sum(1) @ self.model.conv
            n = len(self.known)
            while n + len(part) > len(self.proj):
                self.proj = np.vstack([self.proj, np.zeros_like(self.proj)])
            self.proj[n : n + len(part)] = rows
            self.known.update(zip(part, range(n, n + len(part))))

    def logits(self, texts: list[list[str]]) -> np.ndarray:
        """Raw scores, some texts at a time so that memory stays bounded by one text."""
        out, at = [], 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (size < 60_000 or end == at):
                size += len(texts[end])
                end += 1
            if len(self.known) > MAX_CACHE:
                self._clear()
            self._learn(set().union(*texts[at:end]) - self.known.keys())
            ids = np.concatenate(
                [np.array([*map(self.known.__getitem__, t), *([0] * max(WIDTHS))], np.int64) for t in texts[at:end]]
            )
            top, _ = self.model.pool(self.proj, ids, *bounds([len(t) + max(WIDTHS) for t in texts[at:end]]))
            out.append(np.maximum(top + self.model.bias, 0) @ self.model.out + self.model.shift[0])
            at = end
        return np.concatenate(out) if out else np.zeros(0)

    def scores(self, texts: Iterable[str | None]) -> np.ndarray:
        """Scores from 0 to 1, the language's threshold at CUT."""
        words = [words_of(t) for t in texts]
        z = self.logits(words)
        lang = np.array([guess_language(w) for w in words], np.int64)
        z = (z - self.model.at[lang] if len(z) else z) * self.model.sharp + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def split_of(id_col: str, parts: int):
    """crc32 of an id as text, modulo ``parts``; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % parts


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, parts: int, held: int,
                    positive: int, negative: int, chars: int = SAMPLE_CHARS) -> tuple[pd.DataFrame, dict[int, int]]:
    """A bounded sample of labelled training texts, and how many labels of each kind there are.

    Per class the rows of smallest hash, at most ``positive`` and ``negative`` of them and
    none longer than ``chars``; held-out ids are never read.
    """
    usable = (
        labels.where(split_of("doc_id", parts) != held)
        .where(F.col(label).isin(0, 1))
        .groupBy("doc_id")
        .agg(F.max(label).alias("_y"))
    )
    totals = {int(r["_y"]): int(r["n"]) for r in usable.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    order = [F.xxhash64("doc_id"), "doc_id"]
    picked = usable.where("_y = 1").orderBy(*order).limit(positive).unionByName(
        usable.where("_y = 0").orderBy(*order).limit(negative)
    )
    # At most positive + negative rows of two numbers: safe to broadcast.
    texts = (
        docs.select("doc_id", "text")
        .join(F.broadcast(picked), "doc_id")
        .where(F.length("text") <= chars)
        .groupBy("doc_id")
        .agg(F.first("_y").alias("y"), F.min("text").alias("text"))
        .orderBy("doc_id")
        .limit(positive + negative)
    )
    return texts.toPandas(), totals


def train(sample: pd.DataFrame, totals: dict[int, int]) -> TextCNN:
    """A model trained on four fifths of the sample; thresholds come from the rest."""
    model = TextCNN()
    if min((sample["y"] == k).sum() for k in (0, 1)) < MIN_LABELS:
        return model
    texts = sample["text"].tolist()
    y = sample["y"].to_numpy(np.float32)
    rest = np.array([zlib.crc32(b"fold:%d" % i) % 5 == 0 for i in sample["doc_id"]])
    if y[rest].sum() < 3 or y[~rest].sum() < 3:
        rest = np.zeros(len(y), bool)
    use = np.flatnonzero(~rest)
    balance = np.where(y == 1, len(use) / (2 * max(1, y[use].sum())), len(use) / (2 * max(1, (1 - y[use]).sum())))
    # One text's words at a time: the driver holds word numbers, not words.
    model.fit((words_of(texts[i]) for i in use), y[use], balance[use].astype(np.float32))
    check = np.flatnonzero(rest) if rest.any() else use
    held = [words_of(texts[i]) for i in check]
    real = np.array([totals.get(int(k), 1) / max(1, (y == k).sum()) for k in (0, 1)])
    model.calibrate(model.scorer().logits(held), np.array([guess_language(w) for w in held]), y[check], real[y[check].astype(int)])
    return model


def score(docs: DataFrame, model: TextCNN, text: str = "text") -> DataFrame:
    """``docs`` with a column ``score``."""

    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(model)
        for texts in batches:
            yield pd.Series(scorer.scores(texts), dtype="float64")

    return docs.withColumn("score", F.pandas_udf(scored, "double")(F.col(text)))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``.

    Null and empty texts have no words and get the score of no evidence.  Rows with a
    null id are scored and never held out; repeated rows get equal scores.  Labels that
    are null, or of documents that are missing, are not used; a document labelled twice
    counts as toxic if one label says so.  With fewer than MIN_LABELS of a
    kind the model stays untrained and predicts 0.  An empty table gives an empty result; extra columns are
    ignored.
    """
    model = train(*labelled_sample(docs, labels, "toxic", 3, 1, SAMPLE_TOXIC, SAMPLE_CLEAN))
    held = F.coalesce(split_of("doc_id", 3) == 1, F.lit(False))
    return score(docs.select("doc_id", "text"), model).select(
        "doc_id", held.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted")
    )


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the documents that the classifier calls toxic; see ``classify``."""
    model = train(*labelled_sample(docs, labels, "toxic", 3, 1, SAMPLE_TOXIC, SAMPLE_CLEAN))
    return score(docs, model).where(F.col("score") < CUT).select(docs.columns)


def op4(spark, sf_dir: str) -> DataFrame:
    from tidemill.sources.tables import read_table

    return classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
