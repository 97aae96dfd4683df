"""Quality classifier by supervised subword embeddings.

A document is the mean of the vectors of its words, of its words' character
n-grams and of its word bigrams, all hashed into tables; a softmax layer gives
the class. Vectors and layer are trained by stochastic gradient descent in
numpy on a bounded sample of labelled documents. A bigram's row is the XOR of
its words' hashes: it does not depend on their order, and a word that follows
itself always falls into row 0, so repetition has a vector of its own that is
learnt like any other. As the output is linear in the mean, the trained model
comes down to one number per table row, and scoring adds up one remembered
number per word and one per bigram.

Defined results: a null text is an empty one; a text without words gets the
score of the bias alone; without labels of both classes every score is the
share of label 1 (0.5 without any); label rows that are null or not 0 or 1,
or that contradict each other, are not learnt from; of several texts with one
labelled doc_id, the smallest is learnt from; a null doc_id is not held out and never
learnt from; rows with equal doc_id are scored one by one, also repeated ones;
texts are scored whole, whatever their length; ties of the sample's order go
by doc_id; an empty table gives no rows; lang, source and other columns are
never read, and a column named score is replaced.
"""

from __future__ import annotations

import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import read, small, texts_of

#: Labelled documents of each class that are learnt from at most.
SAMPLE_A_CLASS = 1_500
#: Rows for words and character n-grams, and for word bigrams after them.
BUCKETS, BIGRAMS = 1 << 18, 1 << 16
DIMENSION, EPOCHS, RATE = 12, 6, 0.4
SHORTEST, LONGEST = 3, 4
#: predicted is 1 from this score on.
THRESHOLD = 0.3
#: Words that a worker remembers.
WORDS_KEPT = 200_000


def features(word: str) -> list[int]:
    """Table rows of a word: its own and those of its character n-grams, ends marked."""
    crc = zlib.crc32
    marked = f"<{word}>".encode("utf-32-le")
    out = [crc(b"w" + marked) % BUCKETS]
    for n in range(SHORTEST, LONGEST + 1):
        out += [crc(marked[4 * k : 4 * (k + n)]) % BUCKETS for k in range(len(word) + 3 - n)]
    return out


def word_hash(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass"))


def bigram_rows(hashes: np.ndarray) -> np.ndarray:
    """Table rows of the bigrams of words with these hashes."""
    return BUCKETS + ((hashes[1:] ^ hashes[:-1]) % BIGRAMS)


def count_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Table rows of a text and the share of each."""
    words = text.split()
    rows, counts = [], []
    for word, n in Counter(words).items():
        own = features(word)
        rows += own
        counts += [n] * len(own)
    pairs = bigram_rows(np.array([word_hash(w) for w in words], np.int64)).tolist()
    ids, where = np.unique(np.array(rows + pairs, np.int64), return_inverse=True)
    shares = np.bincount(where, np.array(counts + [1] * len(pairs), np.float64), minlength=len(ids))
    return ids, (shares / max(shares.sum(), 1)).astype(np.float32)


@dataclass
class Model:
    """weights: what each table row adds to the logit of class 1 when it is the whole mean."""

    weights: np.ndarray
    bias: float

    def logit(self, text: str) -> float:
        ids, shares = count_features(text)
        return float(self.weights[ids] @ shares) + self.bias


def train(texts: list[str], labels: list[int], seed: int = 0) -> Model:
    classes = np.array(labels, np.int64)
    if len(set(labels)) < 2:
        # The share of label 1 is 0 or 1, or unknown.
        return Model(np.zeros(BUCKETS + BIGRAMS), float("inf") * (2 * labels[0] - 1) if labels else 0.0)
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / DIMENSION, 1 / DIMENSION, (BUCKETS + BIGRAMS, DIMENSION)).astype(np.float32)
    output, bias = np.zeros((2, DIMENSION), np.float32), np.zeros(2, np.float32)
    documents = [count_features(t) for t in texts]
    steps, done = EPOCHS * len(documents), 0
    for _ in range(EPOCHS):
        for k in rng.permutation(len(documents)):
            ids, shares = documents[k]
            rate = RATE * (1 - done / steps)
            done += 1
            mean = shares @ table[ids]
            z = output @ mean + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[classes[k]] -= 1
            back = p @ output
            output -= rate * np.outer(p, mean)
            bias -= rate * p
            # Shares are small for long texts; the table learns at a rate that makes up for it.
            table[ids] -= (rate * 20) * np.outer(np.minimum(shares * len(ids) ** 0.5, 1.0) / max(len(ids), 1) ** 0.5, back)
    return Model((table @ (output[1] - output[0])).astype(np.float64), float(bias[1] - bias[0]))


class Scorer:
    """Logits of texts. A word that was met has a place, with its hash and the sum of its rows' weights there."""

    def __init__(self, model: Model):
        self.model = model
        self.reset()

    def reset(self) -> None:
        self.place: dict[str, int] = {}
        self.sums, self.sizes, self.hashes = array("d"), array("q"), array("q")

    def meet(self, word: str) -> int:
        rows = features(word)
        self.sums.append(float(self.model.weights[rows].sum()))
        self.sizes.append(len(rows))
        self.hashes.append(word_hash(word))
        self.place[word] = len(self.sums) - 1
        return len(self.sums) - 1

    def logits(self, texts: list[str]) -> np.ndarray:
        if len(self.place) > WORDS_KEPT:
            self.reset()
        get, places, ends = self.place.get, array("q"), [0]
        for text in texts:
            for word in text.split():
                k = get(word)
                places.append(self.meet(word) if k is None else k)
            ends.append(len(places))
        at = np.frombuffer(places, np.int64) if places else np.zeros(0, np.int64)
        # The arrays grow in place, so copies are read.
        sums, sizes, hashes = (np.array(x)[at] for x in (self.sums, self.sizes, self.hashes))
        pairs = np.zeros(len(at))
        if len(at):
            pairs[1:] = self.model.weights[bigram_rows(hashes)]
        totals, counts = np.concatenate(([0.0], np.cumsum(sums + pairs))), np.concatenate(([0], np.cumsum(sizes)))
        ends = np.array(ends)
        first, last = ends[:-1], ends[1:]
        some = last > first
        # A text's first word has no bigram before it.
        total = totals[last] - totals[first] - np.where(some, pairs[np.minimum(first, max(len(pairs) - 1, 0))] if len(pairs) else 0.0, 0.0)
        count = counts[last] - counts[first] + np.maximum(last - first - 1, 0)
        return np.where(some, total / np.maximum(count, 1), 0.0) + self.model.bias


_SCORERS: dict[str, Scorer] = {}


def scorer(token: str, model: Model) -> Scorer:
    """One per worker process and model, with all words it has met so far."""
    if token not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[token] = Scorer(model)
    return _SCORERS[token]


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are kept for testing."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, a_class: int = SAMPLE_A_CLASS) -> pa.Table:
    """(text, label): up to a_class documents of each class, in the order of a hash, none held out; one text for each doc_id."""
    clean = labels.where(F.col("doc_id").isNotNull()).where(F.col(label).isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min(label).alias("label"), F.max(label).alias("most")).where("label = most")
    order = F.xxhash64("doc_id")
    parts = [clean.where(F.col("label") == c).orderBy(order, "doc_id").limit(a_class).select("doc_id", "label") for c in (0, 1)]
    # At most 2 * a_class ids, whatever the tables' size.
    chosen = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(parts[0].unionByName(parts[1])), "doc_id")
    return chosen.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label")).orderBy(order, "doc_id").select("text", "label").toArrow()


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    sample = labelled_sample(docs, labels, label)
    return train(texts_of(sample), sample["label"].to_pylist())


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Adds score, the probability of class 1, to docs (any columns, a text among them)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    token = sha256(model.weights.tobytes() + np.float64(model.bias).tobytes()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logits = scorer(token, shared.value).logits
        for b in small(batches):
            z = np.clip(logits(texts_of(b)), -500, 500)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(1 / (1 + np.exp(-z)), pa.float64())], [*b.schema.names, "score"])

    plain = docs.drop("score")
    return plain.mapInArrow(run, T.StructType([*plain.schema.fields, T.StructField("score", T.DoubleType())]))


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fit(docs, read(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
