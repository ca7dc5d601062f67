"""Bounded samples of labelled documents, their features, and a model fitted on them in one task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm import text as tx
from tideline.llm.shared import fold, small_batches
from tideline.llm.subwords import document_features

Rows = list[tuple[float, np.ndarray, np.ndarray]]


def sample(labels: DataFrame, label_col: str, rows: int, folds: int, held_out: int, id_col: str = "doc_id") -> DataFrame:
    """At most ``rows`` labelled ids outside the held-out fold, those least in a hash of the id.

    An id labelled both ways, a null id and a label other than 0 and 1 are left out.
    """
    clear = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & (fold(id_col, folds) != held_out))
        .groupBy(id_col)
        .agg(F.min(label_col).alias("label"), F.max(label_col).alias("top"))
        .where("label = top")
    )
    return clear.select(id_col, "label").orderBy(F.xxhash64(F.col(id_col).cast("string"), F.lit(17)), id_col).limit(rows)


def fitted(docs: DataFrame, labels: DataFrame, fit: Callable[[Rows], np.ndarray], buckets: int, sizes: tuple[int, ...], id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """Parameters that ``fit`` learns from the features of the labelled documents, a vector of fixed size.

    Features are made where the documents are read; rows of one id are reduced to the one with the least digest of its
    text, so that at most one row for each id of the sample reaches the one task, where they meet in a fixed order.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col), F.col(text_col).alias("text")).join(labels, id_col).select("label", "text", F.col(id_col).cast("string").alias("key"), F.md5(F.coalesce("text", F.lit(""))).alias("digest"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in tx.blocks(batch.column(1)):
                found = document_features(block, buckets, sizes)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(block.first, block.size).cast(pa.float64()),
                        batch.column(2).slice(block.first, block.size),
                        batch.column(3).slice(block.first, block.size),
                        pa.array([k.tobytes() for k, _ in found], pa.binary()),
                        pa.array([s.tobytes() for _, s in found], pa.binary()),
                    ],
                    names=["label", "key", "digest", "buckets", "shares"],
                )

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            for r in batch.to_pylist():
                rows.append((r["key"], r["label"], r["buckets"], r["shares"]))
        rows.sort()
        model = fit([(label, np.frombuffer(b, np.int32), np.frombuffer(s, np.float32)) for _, label, b, s in rows])
        yield pa.RecordBatch.from_arrays([pa.array([np.asarray(model, np.float64).tobytes()], pa.binary())], names=["model"])

    found = texts.mapInArrow(features, "label double, key string, digest string, buckets binary, shares binary")
    found = found.groupBy("key").agg(F.min(F.struct("digest", "label", "buckets", "shares")).alias("row")).select("key", "row.label", "row.buckets", "row.shares")
    return np.frombuffer(found.repartition(1).mapInArrow(learn, "model binary").first()["model"], np.float64)
