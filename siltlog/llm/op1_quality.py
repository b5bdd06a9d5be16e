"""Quality classifier by supervised subword embeddings.

A text is the average of learned vectors of its words and of its character n-grams, both hashed into one table; a
softmax over that average gives the classes. Vectors and output weights are learned together by stochastic gradient
descent in numpy. The output is linear in the average, so for scoring each bucket's vector is multiplied by the
difference of the two classes' weights once, and a text's score needs one number for each feature.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltlog.llm.common import fresh, held_out, labelled_sample, table

NAME = "op1_quality"
#: The most labelled rows that are learned from.
TRAIN_ROWS = 3000
BUCKETS_LOG2 = 17
DIMENSIONS = 8
GRAMS = (3, 4)
EPOCHS = 6
RATE = 0.6
THRESHOLD = 0.7
#: Characters of texts worked on at a time.
STEP_CHARS = 1 << 20
#: Between two texts; no n-gram or word reaches over it.
GAP = max(GRAMS)
_PRIME = 0x100000001B3
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.isin(np.arange(256), [0, 9, 10, 11, 12, 13, 32])


def features(texts: list[str]):
    """(bucket, text number) arrays: the n-grams of characters, the words and the patterns of word pairs of each text."""
    data = np.frombuffer(("\0" * GAP).join([*texts, ""]).encode("utf-32-le", "surrogatepass"), "<u4")
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.concatenate([[0], np.cumsum(lengths + GAP)[:-1]]) if len(texts) else np.zeros(0, np.int64)
    wide = data.astype(np.uint64)
    h, kinds = wide + np.uint64(1), []
    inside = np.zeros(len(data), bool)
    owner = np.repeat(np.arange(len(texts)), lengths + GAP)[: len(data)]
    inside = np.arange(len(data)) - starts[owner] < lengths[owner] if len(data) else inside
    at = np.flatnonzero(inside)
    for n in range(2, GAP + 1):
        h = h * np.uint64(_PRIME)
        h[: len(h) - n + 1] += wide[n - 1 :] + np.uint64(1)
        if n in GRAMS:
            kinds.append((_bucket(h[at] + np.uint64(n)), owner[at]))
    space = _SPACE[np.minimum(data, 255)]
    first = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    if len(first):
        powers, inverse = (np.cumprod(np.full(len(data), x, np.uint64)) for x in (_PRIME, pow(_PRIME, -1, 1 << 64)))
        sums = np.add.reduceat(np.where(space, np.uint64(0), (wide + np.uint64(1)) * powers), first)
        # the same word gives the same number wherever it stands: its first byte's power is taken out again
        words, of = sums * inverse[first], owner[first]
        kinds.append((_bucket(words), of))
        # word pairs are hashed by their pattern: the second repeats the first, or not
        pair = of[1:] == of[:-1]
        kinds.append((_bucket(np.where((words[1:] == words[:-1])[pair], np.uint64(1), np.uint64(2))), of[1:][pair]))
    return kinds


def _bucket(h: np.ndarray) -> np.ndarray:
    return ((h * _MULTIPLIER) >> np.uint64(64 - BUCKETS_LOG2)).astype(np.int64)


@dataclass
class Model:
    """score = 1 / (1 + exp(-(mean of gains over a text's features + bias)))."""

    gains: np.ndarray
    bias: float

    def scores(self, texts: list[str]) -> np.ndarray:
        total, count = np.zeros(len(texts)), np.zeros(len(texts))
        for bucket, owner in features(texts):
            total += np.bincount(owner, self.gains[bucket], len(texts))
            count += np.bincount(owner, minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(total / np.maximum(count, 1) + self.bias, -60, 60)))


def train(sample: list[tuple[str, int]], seed: int = 7) -> Model:
    """Fits the model to (text, 0 or 1). With one class only, or none, every text gets the smoothed share of ones."""
    labels = np.array([y for _, y in sample], np.int64)
    if len(set(labels.tolist())) < 2:
        share = (labels.sum() + 1) / (len(labels) + 2)
        return Model(np.zeros(1 << BUCKETS_LOG2, np.float32), float(np.log(share / (1 - share))))
    rng = np.random.default_rng(seed)
    inputs = []
    for text, _ in sample:
        ids = np.concatenate([b for b, _ in features([text])])
        buckets, counts = np.unique(ids, return_counts=True)
        inputs.append((buckets.astype(np.int32), (counts / max(1, len(ids))).astype(np.float32)))
    vectors = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (1 << BUCKETS_LOG2, DIMENSIONS)).astype(np.float32)
    weights, prior = np.zeros((2, DIMENSIONS), np.float32), np.log((np.bincount(labels, minlength=2) + 1).astype(np.float32))
    steps, done = EPOCHS * len(sample), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(sample)):
            rate = np.float32(RATE * (1 - done / steps))
            done += 1
            buckets, share = inputs[i]
            x = share @ vectors[buckets]
            z = weights @ x + prior
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            # rows of a long text share one step; scaled up as if each feature had been drawn on its own
            vectors[buckets] -= np.outer(np.minimum(share * len(buckets), 4), rate * (p @ weights)).astype(np.float32)
            weights -= rate * np.outer(p, x)
    return Model(vectors @ (weights[1] - weights[0]), float(prior[1] - prior[0]))


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """The model from at most `rows` labelled rows of labels.quality; those with crc32(doc_id) mod 4 = 2 are never read."""
    return train(labelled_sample(docs, labels, "quality", 4, 2, rows))


def with_score(docs: DataFrame, model: Model, score_col: str = "score", text_col: str = "text") -> DataFrame:
    """All columns of docs, and the score of each whole text from 0 to 1, in place of a column of the name score_col if there is one.

    Null and empty texts have no features and get the classes' shares of the labels. Repeated rows stay; an empty table
    stays empty. Texts are never cut; memory follows the longest one.
    """
    docs = docs.drop(*(c for c in docs.columns if c.lower() == score_col.lower()))
    at = docs.schema.names.index(text_col)

    def run(batches):
        for batch in batches:
            texts = batch.column(at)
            scores, held, size = [], [], 0
            for i in range(len(texts)):
                held.append(texts[i].as_py() or "")
                size += len(held[-1])
                if size >= STEP_CHARS:
                    scores.append(model.scores(held))
                    held, size = [], 0
            scores.append(model.scores(held))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(scores), pa.float64())], names=[*batch.schema.names, score_col])

    from pyspark.sql.types import DoubleType, StructType

    return docs.mapInArrow(run, StructType([*docs.schema.fields]).add(score_col, DoubleType()))


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose text scores at least the threshold, with their columns unchanged, whatever their names.

    Null and empty texts go or stay with their score, repeated rows fare alike, an empty table stays empty.
    """
    name = fresh(docs.columns, "score")
    return with_score(docs, model, name).where(F.col(name) >= threshold).drop(name)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = with_score(read, model)
    return scored.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


#: SQL can't express the training; tests measure held-out accuracy.
ORACLE_SQL = None
