"""Quality rules: counts over a text's words and lines, then a calibrated logistic regression.

The base rules fail a text of too few words, or one in which too many words stand in repeated windows of
five words. What passes them is scored by a logistic regression on hashed word and character n-grams, fitted
on labelled rows; its logits are calibrated on rows that the fit left out (Platt's scaling), and a text is
kept from a fixed probability on.

Defined cases: null and empty texts have no words, so the base fails them; repeated rows are judged each for
itself; without labelled rows of both kinds every probability is 0.5 and base decides alone.
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

LEAST_WORDS = 10
MOST_REPEATED_PERCENT = 20
WINDOW = 5
#: characters that count as symbols
SYMBOLS = "#*$%&|<>"
#: calibrated probability from which a text is kept
KEEP = 0.5

BUCKETS = 1 << 17
SIZES = (2, 3, 4)
SAMPLE = 6000
EPOCHS = 8
RATE = 40.0
DECAY = 1e-6

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True


def block_counts(block: tx.Block) -> dict[str, np.ndarray]:
    """Words, their characters, symbols, repeated lines and repeated words of every document of a block."""
    data = block.data
    w = tx.words(block, data, tx.SPACED)
    sums = tx.running(data)
    hashes = tx.span_hash(sums, w.start, w.end)
    chars = np.zeros(data.size + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=chars[1:])
    symbols = np.zeros(data.size + 1, np.int64)
    np.cumsum(_SYMBOL[data], out=symbols[1:])
    return {
        "n_words": w.counts,
        "word_chars": tx.per_document(chars[w.end] - chars[w.start], w.bounds),
        "n_symbols": symbols[block.offsets[1:]] - symbols[block.offsets[:-1]],
        "n_dup_lines": repeated_lines(block, w, sums),
        "n_repeat_words": tx.per_document(in_repeated_window(hashes, w, WINDOW), w.bounds),
    }


def in_repeated_window(hashes: np.ndarray, w: tx.Words, n: int) -> np.ndarray:
    """Which words lie in a window of ``n`` words that their document holds more than once."""
    at = np.flatnonzero(tx.within(w.doc, n))
    if at.size == 0:
        return np.zeros(hashes.size, bool)
    grams = tx.mix(tx.gram_hash(hashes, n)[at] + tx.mix(w.doc[at].astype(np.uint64) + np.uint64(1)))
    order = np.argsort(grams, kind="stable")
    ranked = grams[order]
    again = np.zeros(at.size, bool)
    again[1:] = ranked[1:] == ranked[:-1]
    again[:-1] |= again[1:]
    return tx.covered(at[order[again]], n, hashes.size)


def repeated_lines(block: tx.Block, w: tx.Words, sums: np.ndarray) -> np.ndarray:
    """Lines with a word that equal an earlier line of their document."""
    breaks = np.flatnonzero(block.data == 10)
    starts = np.union1d(block.offsets[:-1], breaks + 1)
    starts = starts[starts < block.data.size]
    if starts.size == 0:
        return np.zeros(block.size, np.int64)
    # a line ends at the next line feed or at the end of its document
    doc = np.searchsorted(block.offsets, starts, "right") - 1
    after = np.append(breaks, block.data.size)[np.searchsorted(breaks, starts)]
    ends = np.minimum(after, block.offsets[doc + 1])
    worded = np.searchsorted(w.start, ends) > np.searchsorted(w.start, starts)
    starts, ends, doc = starts[worded], ends[worded], doc[worded]
    keys = tx.mix(tx.span_hash(sums, starts, ends) + tx.mix(doc.astype(np.uint64) + np.uint64(1)))
    _, first = np.unique(keys, return_index=True)
    again = np.ones(keys.size, bool)
    again[first] = False
    return np.bincount(doc[again], minlength=block.size)


def train(rows: Rows, buckets: int = BUCKETS, epochs: int = EPOCHS, rate: float = RATE, decay: float = DECAY, seed: int = 11) -> np.ndarray:
    """Weights per bucket, that of echoes and the bias, calibrated on every fifth row, which the fit leaves out."""
    rows = [r for r in rows if r[1].size]
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    apart, learnt = [rows[k] for k in order[::5]], [rows[k] for n, k in enumerate(order) if n % 5]
    if {r[0] for r in learnt} != {0.0, 1.0} or {r[0] for r in apart} != {0.0, 1.0}:
        return np.zeros(buckets + 2)
    weights, bias = np.zeros(buckets + 1), 0.0
    steps, step = epochs * len(learnt), 0
    for _ in range(epochs):
        for k in rng.permutation(len(learnt)):
            label, keys, shares = learnt[k]
            pace = rate * (1 - step / steps)
            step += 1
            off = 1 / (1 + np.exp(-np.clip(shares @ weights[keys] + bias, -60, 60))) - label
            weights[keys] -= pace * (off * shares + decay * weights[keys])
            bias -= 0.001 * pace * off
    slope, shift = platt(np.array([s @ weights[k] + bias for _, k, s in apart]), np.array([r[0] for r in apart]))
    return np.append(weights * slope, bias * slope + shift)


def platt(logits: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the calibrated logit, by Newton's method on Platt's smoothed targets."""
    scale = max(float(np.abs(logits).max()), 1e-9)
    x = np.stack([logits / scale, np.ones_like(logits)], axis=1)
    plus, minus = labels.sum(), (1 - labels).sum()
    target = np.where(labels > 0, (plus + 1) / (plus + 2), 1 / (minus + 2))
    fit = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ fit, -60, 60)))
        slope = x.T @ (target - p) - 1e-3 * fit
        curve = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(curve, slope)
        fit += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return fit[0] / scale, fit[1]


def fit_rules(docs: DataFrame, labels: DataFrame, label_col: str = "quality", rows: int = SAMPLE, folds: int = 4, held_out: int = 2) -> np.ndarray:
    return fitted(docs, sample(labels, label_col, rows, folds, held_out), train, BUCKETS, SIZES)


def judge(docs: DataFrame, model: np.ndarray, text_col: str = "text") -> DataFrame:
    """The documents' other columns with the counts, the probability, base_failed and kept, in place of columns so named."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    own = [*counts, "probability", "base_failed", "kept"]
    rest = [c for c in docs.columns if c != text_col and c.lower() not in own]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value[:-1], shared.value[-1]
        for batch in batches:
            for block in tx.blocks(batch.column(0)):
                found = block_counts(block)
                logits = np.clip(document_scores(block, weights, SIZES) + bias, -60, 60)
                others = [c.slice(block.first, block.size) for c in batch.columns[1:]]
                yield pa.RecordBatch.from_arrays(
                    [*others, *(pa.array(found[c], pa.int64()) for c in counts), pa.array(1 / (1 + np.exp(-logits)))],
                    names=[*rest, *counts, "probability"],
                )

    kept = docs.select(text_col, *rest)
    fields = [docs.schema[c] for c in rest] + [T.StructField(c, T.LongType()) for c in counts]
    scored = kept.mapInArrow(run, T.StructType([*fields, T.StructField("probability", T.DoubleType())]))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    return scored.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("probability") >= KEEP))
