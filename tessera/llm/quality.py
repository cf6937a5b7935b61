"""Quality classifier with supervised subword embeddings.

A document is the average of learned vectors of its features: words, the words' own
character n-grams (with marks at both ends) and pairs of equal neighbouring words, all
hashed into one table. A softmax over that average gives the classes. Vectors and output
weights are trained together by numpy stochastic gradient descent on a bounded sample
of labelled rows. As the output is linear in the average, a trained model is folded
into one number per hashed feature, and a text's score is a mean of such numbers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from operator import eq
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import make_room, prepare, trim

#: The bound of the training sample: rows of each label, the first by hash of their id.
TRAIN_ROWS = 2000
BUCKETS, DIM, EPOCHS, RATE, SEED = 1 << 18, 12, 6, 0.6, 17
GRAMS = (3, 4)
#: Words whose sums a worker keeps; the store is emptied when it is full.
KEPT_WORDS = 800_000
_REPEAT = b"\x00repeat"


def features(word: str) -> list[int]:
    """Table rows of a word and of its character n-grams."""
    marked = f"<{word}>".encode("utf-16-le", "surrogatepass")  # two bytes a character
    rows = [crc32(marked) % BUCKETS]
    for n in GRAMS:
        rows += [crc32(marked[i : i + 2 * n]) % BUCKETS for i in range(0, len(marked) - 2 * n + 1, 2)]
    return rows


_REPEATED = crc32(_REPEAT) % BUCKETS


def _bag(text: str, known: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct table rows of a text and their shares of all its features."""
    words = text.split()
    for w in set(words):
        if w not in known:
            known[w] = np.array(features(w), np.int32)
    parts = [known[w] for w in words]
    if repeats := sum(map(eq, words, words[1:])):
        parts.append(np.full(repeats, _REPEATED, np.int32))
    if not parts:
        return np.empty(0, np.int32), np.empty(0)
    rows, n = np.unique(np.concatenate(parts), return_counts=True)
    return rows, n / n.sum()


def train(texts: list[str], labels: list[int], epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> tuple[np.ndarray, float]:
    """(weight of each table row, bias): a text's logit of label 1 is the mean weight of its features plus bias.

    Without rows of both labels every text gets the share of label 1 (one half without any rows).
    """
    y = np.array(labels, int)
    if len(set(labels)) < 2:
        share = 0.5 if not len(y) else min(max(float(y.mean()), 0.01), 0.99)
        return np.zeros(BUCKETS), math.log(share / (1 - share))
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM))
    out, bias = np.zeros((DIM, 2)), np.zeros(2)
    known: dict[str, np.ndarray] = {}
    bags = [_bag(t, known) for t in texts]
    del known
    share = np.array([(y == c).mean() for c in (0, 1)])
    pull = 0.5 / share  # both labels count alike
    steps, done = epochs * len(y), 0
    for _ in range(epochs):
        for i in rng.permutation(len(y)):
            rows, part = bags[i]
            speed = rate * pull[y[i]] * (1 - done / steps)
            done += 1
            own = vectors[rows]
            mean = part @ own if len(rows) else np.zeros(DIM)
            z = mean @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            if len(rows):
                # The share of a feature is tiny, so vectors take steps that do not shrink with the text's length.
                vectors[rows] = own - np.outer(np.minimum(part * 50, 1) * speed, out @ p)
            out -= speed * np.outer(mean, p)
            bias -= speed * p * 0.1
    return vectors @ (out[:, 1] - out[:, 0]), float(bias[1] - bias[0])


class Scorer:
    """Scores texts with a folded model."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights.astype(np.float64).tolist(), bias
        self.sums: dict[str, float] = {}
        self.counts: dict[str, int] = {}

    def score(self, text: str | None) -> float:
        words = (text or "").split()
        if not words:
            return 1 / (1 + math.exp(-self.bias))
        if len(self.sums) > KEPT_WORDS:
            self.sums.clear()
            self.counts.clear()
        sums, w = self.sums, self.weights
        for word in set(words):
            if word not in sums:
                rows = features(word)
                sums[word] = sum(map(w.__getitem__, rows))
                self.counts[word] = len(rows)
        repeats = sum(map(eq, words, words[1:]))
        total = math.fsum(map(sums.__getitem__, words)) + repeats * w[_REPEATED]
        z = self.bias + total / (sum(map(self.counts.__getitem__, words)) + repeats)
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def held_out(id_col: str = "doc_id") -> Column:
    """Rows never learned from: crc32 of the id as text leaves 1 modulo 3. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = TRAIN_ROWS) -> tuple[np.ndarray, float]:
    """Trains on at most ``rows`` labelled documents of each label, none of them held out.

    The sample is the first rows by a hash of the id, so it is bounded, depends on no order and
    may be broadcast. Null labels, ids and texts are left out; of a repeated id one row counts.
    """
    own = labels.select(F.col(id_col).alias("_t_id"), F.col(label_col).cast("int").alias("_t_label")).where(F.col("_t_id").isNotNull() & F.col("_t_label").isin(0, 1) & ~held_out("_t_id"))
    order = [F.xxhash64("_t_id"), F.col("_t_id")]
    picked = own.where("_t_label = 0").orderBy(*order).limit(rows).unionByName(own.where("_t_label = 1").orderBy(*order).limit(rows))
    texts = docs.select(F.col(id_col).alias("_t_id"), F.col(text_col).alias("_t_text")).where(F.col("_t_text").isNotNull())
    got = {r["_t_id"]: (r["_t_text"], r["_t_label"]) for r in texts.join(F.broadcast(picked), "_t_id").toLocalIterator()}
    sample = [got[k] for k in sorted(got)]
    trim(docs.sparkSession)
    return train([t for t, _ in sample], [y for _, y in sample])


def score(docs: DataFrame, model: tuple[np.ndarray, float], text_col: str = "text", out: str = "score") -> DataFrame:
    """Adds the column ``out`` (0 to 1) to every row; other columns stay as they are.

    Null and empty texts get the score of the bias alone.
    """
    spark = docs.sparkSession
    prepare(spark)
    sent = spark.sparkContext.broadcast((model[0].astype(np.float32), model[1]))

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        make_room()
        weights, bias = sent.value
        scorer = Scorer(weights, bias)
        for texts in batches:
            yield pd.Series([scorer.score(t) for t in texts], dtype="float64")
        del scorer
        make_room()

    return docs.withColumn(out, run(F.col(text_col)))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; an empty table gives an empty result."""
    scored = score(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_t_text")), fit(docs, labels, id_col, text_col), "_t_text")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int").alias("predicted"))
