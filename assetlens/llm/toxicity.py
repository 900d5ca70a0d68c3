"""Toxicity: subword-bag embeddings averaged into a linear softmax.

A word is the average of the embeddings of its character n-grams (hashed), a
window of words is the average of its words, and a linear softmax turns it
into two class probabilities; embeddings and softmax are trained jointly with
AdaGrad in numpy.  A misspelling never seen still shares most n-grams with
the words that were.

Labels are given per document while toxic words are few, so a document's
score is that of its most toxic window: after a first pass over random
windows, training goes on with the windows that the model itself picks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CACHE_ENTRIES, held_out, mixed, text_batches

FOLDS = 5
#: Bounds of the training sample: rows of each label, characters of a text.
SAMPLE_ROWS = 3_000
SAMPLE_CHARS = 20_000
BUCKET_BITS = 18
DIMENSIONS = 8
GRAMS = (3, 4, 5)
#: Words of a window, and the step from window to window.
WINDOW, STEP = 8, 4
FIRST_EPOCHS, EPOCHS = 2, 8
BATCH, RATE = 256, 0.3
PUNCTUATION = ".,;:!?\"'()[]{}|-"


def words_of(text: str | None) -> list[str]:
    return text.lower().split() if text else []


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, starts): the n-gram buckets of all words one after another,
    and where each word's buckets start.  Every word has at least one."""
    marked = ["<" + w.strip(PUNCTUATION) + ">" for w in words]
    sizes = np.fromiter(map(len, marked), np.int64, len(marked))
    code = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(marked)), sizes)
    found, owners = [], []
    for width in GRAMS:
        n = len(code) - width + 1
        if n <= 0:
            continue
        h = np.full(n, np.uint64(width))
        for k in range(width):
            h = h * np.uint64(0x9E3779B97F4A7C15) + code[k:k + n]
        inside = owner[:n] == owner[width - 1:width - 1 + n]
        found.append(h[inside])
        owners.append(owner[:n][inside])
    # The whole word is a feature of its own, also of words too short for n-grams.
    spread = mixed(code + (np.arange(len(code)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.uint64)
                   * np.uint64(1 << 32))
    found.append(np.add.reduceat(spread, np.cumsum(sizes) - sizes))
    owners.append(np.arange(len(marked)))
    owners, found = np.concatenate(owners), np.concatenate(found)
    order = np.argsort(owners, kind="stable")
    buckets = (mixed(found[order]) >> np.uint64(64 - BUCKET_BITS)).astype(np.int32)
    return buckets, np.searchsorted(owners[order], np.arange(len(marked)))


def window_starts(count: int) -> np.ndarray:
    """First words of the windows that cover ``count`` words."""
    return np.arange(0, max(count - (WINDOW - STEP), 1), STEP)


def best_window(scores: np.ndarray) -> tuple[int, float]:
    """(first word, mean score) of the best window of a document's words."""
    total = np.concatenate(([0.0], np.cumsum(scores)))
    first = window_starts(len(scores))
    last = np.minimum(first + WINDOW, len(scores))
    means = (total[last] - total[first]) / (last - first)
    at = int(np.argmax(means))
    return int(first[at]), float(means[at])


class Model:
    """Embeddings (buckets x dimensions) and a softmax (dimensions x 2)."""

    def __init__(self, prior: float = 0.0):
        rng = np.random.default_rng(7)
        self.embeddings = rng.uniform(-1, 1, (1 << BUCKET_BITS, DIMENSIONS)).astype(np.float32) / DIMENSIONS
        self.softmax = (rng.normal(size=(DIMENSIONS, 2)) / DIMENSIONS).astype(np.float32)
        self.bias = np.array([0.0, prior], np.float32)

    def frozen(self) -> tuple[np.ndarray, float]:
        """The score is linear in a window's n-grams: each bucket's share of
        the log-odds, and the constant."""
        direction = self.softmax[:, 1] - self.softmax[:, 0]
        return self.embeddings @ direction, float(self.bias[1] - self.bias[0])


def word_scores(words: list[str], shares: np.ndarray) -> np.ndarray:
    """Each word's share of the log-odds: the mean over its n-grams."""
    if not words:
        return np.empty(0)
    buckets, starts = subwords(words)
    counts = np.diff(np.append(starts, len(buckets)))
    return np.add.reduceat(shares[buckets].astype(np.float64), starts) / counts


class Trainer:
    """Joint training on labelled documents."""

    def __init__(self, texts: list[str | None], labels: list[int]):
        index: dict[str, int] = {}
        self.docs, self.labels = [], []
        for text, label in zip(texts, labels):
            words = words_of(text)
            if words:
                self.docs.append(np.array([index.setdefault(w, len(index)) for w in words]))
                self.labels.append(label)
        words = list(index)
        parts = [subwords(words[k:k + 20_000]) for k in range(0, len(words), 20_000)]
        if parts:
            shifts = np.cumsum([0] + [len(b) for b, _ in parts])
            self.buckets = np.concatenate([b for b, _ in parts])
            self.starts = np.concatenate([s + at for (_, s), at in zip(parts, shifts)])
            self.counts = np.diff(np.append(self.starts, len(self.buckets)))
        positive = sum(self.labels)
        self.one_class = positive in (0, len(self.labels))
        self.model = Model()
        if self.one_class:
            self.model.softmax[:] = 0
            self.model.bias[:] = 0, (5.0 if positive else -5.0)
        self.squares = [np.full(x.shape, 1e-3, np.float32)
                        for x in (self.model.embeddings, self.model.softmax, self.model.bias)]
        self.rng = np.random.default_rng(11)

    def windows(self, first: bool) -> tuple[list[np.ndarray], list[int]]:
        """Training windows of one epoch: random ones at first; later each
        document's best, and a random one of the documents that are clean."""
        shares = None if first else self.model.frozen()[0]
        scores = None if first else (np.add.reduceat(shares[self.buckets], self.starts) / self.counts)
        rows, labels = [], []
        for doc, label in zip(self.docs, self.labels):
            starts = window_starts(len(doc))
            if first:
                chosen = self.rng.choice(starts, min(6, len(starts)), replace=False)
            else:
                chosen = [best_window(scores[doc])[0]]
                if not label:
                    chosen.append(self.rng.choice(starts))
            rows += [doc[s:s + WINDOW] for s in chosen]
            labels += [label] * len(chosen)
        return rows, labels

    def step(self, rows: list[np.ndarray], labels: np.ndarray) -> None:
        words = np.concatenate(rows)
        lengths = np.fromiter(map(len, rows), np.int64, len(rows))
        sizes = self.counts[words]
        ends = np.cumsum(sizes)
        at = np.repeat(self.starts[words] - (ends - sizes), sizes) + np.arange(ends[-1])
        buckets = self.buckets[at]
        share = np.repeat(1.0 / (sizes * np.repeat(lengths, lengths)), sizes).astype(np.float32)
        row_sizes = np.add.reduceat(sizes, np.cumsum(lengths) - lengths)
        starts = np.cumsum(row_sizes) - row_sizes
        m = self.model
        hidden = np.add.reduceat(m.embeddings[buckets] * share[:, None], starts, axis=0)
        logits = hidden @ m.softmax + m.bias
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(rows)), labels] -= 1
        d_hidden = p @ m.softmax.T
        per_gram = np.repeat(d_hidden, row_sizes, axis=0) * share[:, None]
        held, where = np.unique(buckets, return_inverse=True)
        d_embeddings = np.stack([np.bincount(where, per_gram[:, k], len(held)) for k in range(DIMENSIONS)],
                                axis=1).astype(np.float32)
        for x, square, g, part in ((m.embeddings, self.squares[0], d_embeddings, held),
                                   (m.softmax, self.squares[1], hidden.T @ p / len(rows), slice(None)),
                                   (m.bias, self.squares[2], p.mean(axis=0), slice(None))):
            square[part] += g * g
            x[part] -= RATE * g / np.sqrt(square[part])

    def run(self) -> Model:
        if self.one_class:
            return self.model
        for epoch in range(FIRST_EPOCHS + EPOCHS):
            rows, labels = self.windows(epoch < FIRST_EPOCHS)
            labels = np.array(labels)
            order = self.rng.permutation(len(rows))
            for at in range(0, len(order), BATCH):
                part = order[at:at + BATCH]
                self.step([rows[k] for k in part], labels[part])
        return self.model


def training_sample(docs: DataFrame, labels: DataFrame, folds: int = FOLDS,
                    sample_rows: int = SAMPLE_ROWS) -> tuple[list[str], list[int]]:
    """Texts and labels of a bounded sample outside the held-out fold: of each
    label the first ``sample_rows`` ids in hash order whose texts have at most
    SAMPLE_CHARS characters.  The chosen ids are few by that bound, so they
    are broadcast and the texts are not shuffled."""
    known = (labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id")
             .agg(F.max("toxic").alias("toxic")).filter(~held_out(F.col("doc_id"), folds)))
    texts, marks = [], []
    for label in (1, 0):
        chosen = known.filter((F.col("toxic") > 0) == F.lit(label == 1)).orderBy(
            F.xxhash64("doc_id"), "doc_id").limit(sample_rows).select(F.col("doc_id").alias("__id"))
        rows = docs.filter(F.length("text") <= SAMPLE_CHARS).join(
            F.broadcast(chosen), F.col("doc_id") == F.col("__id")).select("doc_id", "text")
        part = sorted(((r["doc_id"], r["text"]) for r in rows.collect()))
        texts += [t for _, t in part]
        marks += [label] * len(part)
    return texts, marks


def fit(docs: DataFrame, labels: DataFrame, folds: int = FOLDS) -> tuple[np.ndarray, float]:
    """(bucket shares, constant) of a model trained outside the held-out fold."""
    return Trainer(*training_sample(docs, labels, folds)).run().frozen()


class Scorer:
    """Probabilities of whole texts, with a bounded cache of word scores."""

    def __init__(self, shares: np.ndarray, constant: float):
        self.shares, self.constant = shares, constant
        self.cache: dict[str, float] = {}

    def scores(self, texts: list[str | None]) -> list[float]:
        out = []
        for at in range(0, len(texts), 500):
            docs = [words_of(t) for t in texts[at:at + 500]]
            if len(self.cache) > CACHE_ENTRIES:
                self.cache.clear()
            new = list({w for words in docs for w in words if w not in self.cache})
            self.cache.update(zip(new, word_scores(new, self.shares).tolist()))
            for words in docs:
                best = 0.0
                if words:
                    values = np.fromiter(map(self.cache.__getitem__, words), np.float64, len(words))
                    best = best_window(values)[1]
                out.append(float(1.0 / (1.0 + np.exp(-(best + self.constant)))))
        return out


def score_toxicity(docs: DataFrame, shares: np.ndarray, constant: float, folds: int = FOLDS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, held_out, score,
    predicted.

    Whole texts are scored where they are read, without a shuffle; the model
    has a fixed size.  Null and empty texts get the model's constant (no
    toxic word speaks for label 1), repeated rows score alike, a null id
    counts as held out, an empty table gives no rows, and further columns are
    not read.  With labels of one kind or none the score is that kind's (none:
    clean) for all.
    """
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shares, constant)
        for ids, texts in text_batches(batches):
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()),
                                              "score": pa.array(scorer.scores(texts), pa.float64())})

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        score, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id"), folds).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, shares: np.ndarray, constant: float) -> DataFrame:
    """``docs`` without the rows that the model predicts toxic; all columns
    stay, and rows are judged and kept where they are read."""
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shares, constant)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            yield batch.filter(pa.array([s < 0.5 for s in scorer.scores(texts)], pa.bool_()))
    return docs.mapInArrow(keep, docs.schema)
