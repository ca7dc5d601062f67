"""Quality classifier on learned subword embeddings.

A document is the mean of the vectors of its words, a word the mean of the learned vectors of its
hashed form and of its hashed character n-grams; a softmax over the two labels stands on top. Vectors and
softmax are trained together by stochastic gradient descent on a bounded sample of labelled rows. Both are
linear in the document, so for scoring they fold into one number per bucket, which travels to the tasks.

Defined cases: an empty or null text has the score of the bias alone; repeated rows are scored each for
itself; ids, languages and sources are not features; without labelled rows of both kinds every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.llm import text as tx
from tideline.llm.labelled import Rows, fitted, sample
from tideline.llm.shared import small_batches
from tideline.llm.subwords import document_scores

BUCKETS = 1 << 17
DIM = 8
SIZES = (3, 4, 5)
#: bound on the labelled rows learnt from
SAMPLE = 6000
EPOCHS = 6
RATE = 1.0


def train(rows: Rows, buckets: int = BUCKETS, dim: int = DIM, epochs: int = EPOCHS, rate: float = RATE, seed: int = 7) -> np.ndarray:
    """Fits vectors and softmax by SGD; returns a weight per bucket, one for echoes and the bias, of label 1 against 0."""
    rows = [r for r in rows if r[1].size]
    kinds = {label for label, _, _ in rows}
    if kinds != {0.0, 1.0}:
        return np.zeros(buckets + 2)
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (buckets + 1, dim))
    out, bias = np.zeros((dim, 2)), np.zeros(2)
    steps, step = epochs * len(rows), 0
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            label, keys, shares = rows[k]
            pace = rate * (1 - step / steps)
            step += 1
            mean = shares @ vectors[keys]
            logits = mean @ out + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[int(label)] -= 1
            back = out @ p
            out -= pace * np.outer(mean, p)
            bias -= pace * 0.1 * p
            # a feature's share is small; its vector moves by the share, scaled up as for one word in a few
            vectors[keys] -= pace * np.outer(shares / shares.max(), back)
    return np.append(vectors @ (out[:, 1] - out[:, 0]), bias[1] - bias[0])


def fit_quality(docs: DataFrame, labels: DataFrame, label_col: str = "quality", rows: int = SAMPLE, folds: int = 4, held_out: int = 2) -> np.ndarray:
    """Model of label 1 against label 0, learnt outside the held-out fold of the ids."""
    return fitted(docs, sample(labels, label_col, rows, folds, held_out), train, BUCKETS, SIZES)


def score_quality(docs: DataFrame, model: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Probability of label 1 for every document, beside all of its columns."""
    return scored(docs, model, SIZES, text_col, "score")


def scored(docs: DataFrame, model: np.ndarray, sizes: tuple[int, ...], text_col: str, name: str) -> DataFrame:
    """Adds the logistic of the folded model, in place of a column so named.

    ``model`` has a weight per bucket, that of echoes, then the bias.
    """
    spark = docs.sparkSession
    docs = docs.drop(name)
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value[:-1], shared.value[-1]
        for batch in batches:
            parts = [document_scores(block, weights, sizes) for block in tx.blocks(batch.column(place))]
            logits = np.concatenate(parts) + bias if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-np.clip(logits, -700, 700))))], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Documents with score and predicted label."""
    found = score_quality(docs, fit_quality(docs, labels))
    return found.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))
