"""Benchmark decontamination by winnowing.

Of every ``SPAN - GRAM + 1`` consecutive word k-grams the ones with the least hash are kept as
fingerprints, on both sides. Two texts that share ``SPAN`` words therefore share a fingerprint inside
them. Fingerprints of documents meet those of the benchmark, and every meeting is extended to the
windows of ``SPAN`` words around it, compared word for word. An item of fewer words is one window and
its own fingerprint.

A bitmap of fixed size over the benchmark's fingerprints travels to the readers of the documents, so
only document fingerprints that may meet an item leave the scan. It grows neither with the documents
nor with the benchmark; a fuller bitmap lets more rows through and changes no result.

Defined cases: null and empty texts have no words and are never hit; an item without words matches
nothing; repeated documents are judged each for itself; of repeated items every id is named once, a
null id never; an empty benchmark hits nothing. Only the named columns are read, others are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm import text as tx
from tideline.llm.shared import SLOTS, bitmap_of, in_bitmap, small_batches, written

SPAN = 10
GRAM = 6
_CANDIDATE = pa.struct([("fp", pa.int64()), ("start", pa.int32()), ("len", pa.int32()), ("window", pa.binary())])
_SCHEMA = pa.schema([("uid", pa.int64()), ("n_words", pa.int64()), ("cands", pa.list_(_CANDIDATE))])
_SPARK_SCHEMA = "uid long, n_words long, cands array<struct<fp:long,start:int,len:int,window:binary>>"


def winnow(hashes: np.ndarray, doc: np.ndarray, span: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the k-grams that are least in some window of a whole span of words."""
    grams = tx.gram_hash(hashes, gram)
    wide = span - gram + 1
    size = max(hashes.size - span + 1, 0)
    whole = tx.within(doc, span)
    least = np.full(size, np.iinfo(np.uint64).max, np.uint64)
    for j in range(wide):
        np.minimum(least, grams[j: j + size], out=least)
    chosen = np.zeros(grams.size, bool)
    for j in range(wide):
        chosen[j: j + size] |= whole & (grams[j: j + size] == least)
    at = np.flatnonzero(chosen)
    return at, grams[at]


def block_candidates(block: tx.Block, span: int, gram: int, short: list[int], bitmap: np.ndarray | None):
    """(document, fingerprint, first word, words, window text) of one block, and its words per document.

    With no bitmap the block holds items: an item shorter than the span gives itself.
    """
    lower = tx.LOWER[block.data]
    w = tx.words(block, lower, tx.ALNUM)
    hashes = tx.span_hash(tx.running(lower), w.start, w.end)
    found: list[tuple[int, int, int, int]] = []
    at, fp = winnow(hashes, w.doc, span, gram)
    if bitmap is not None:
        keep = in_bitmap(bitmap, fp)
        at, fp = at[keep], fp[keep]
    for back in range(span - gram + 1):
        start = at - back
        ok = (start >= 0) & (start + span <= w.doc.size)
        ok[ok] &= w.doc[start[ok]] == w.doc[start[ok] + span - 1]
        ok[ok] &= w.doc[start[ok]] == w.doc[at[ok]]
        found += zip(w.doc[start[ok]].tolist(), fp[ok].astype(np.int64).tolist(), start[ok].tolist(), [span] * int(ok.sum()))
    for n in short:
        grams = tx.gram_hash(hashes, n)
        if bitmap is None:
            starts = w.bounds[:-1][w.counts == n]
        else:
            starts = np.flatnonzero(tx.within(w.doc, n) & in_bitmap(bitmap, grams))
        found += zip(w.doc[starts].tolist(), grams[starts].astype(np.int64).tolist(), starts.tolist(), [n] * starts.size)
    body = lower.tobytes()
    out: list[list[dict]] = [[] for _ in range(block.size)]
    for doc, value, start, n in found:
        window = b" ".join(body[a:b] for a, b in zip(w.start[start: start + n].tolist(), w.end[start: start + n].tolist()))
        out[doc].append({"fp": value, "start": int(start - w.bounds[doc]), "len": n, "window": window})
    return w.counts, out


def _scanner(span: int, gram: int, short: list[int], bitmap):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if bitmap is None else bitmap.value
        for batch in batches:
            for block in tx.blocks(batch.column(1)):
                counts, cands = block_candidates(block, span, gram, short, bits)
                rows = batch.column(0).slice(block.first, block.size)
                yield pa.RecordBatch.from_arrays([rows, pa.array(counts, pa.int64()), pa.array(cands, pa.list_(_CANDIDATE))], schema=_SCHEMA)

    return scan


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, gram: int = GRAM, slots: int = SLOTS) -> DataFrame:
    """One row per document: its id, n_words, n_hit, items (sorted ids as text) and spans [start, end) in words.

    ``items`` has item_id and text.
    """
    spark = docs.sparkSession
    small_batches(spark)
    known = items.select(F.col("item_id").cast("string").alias("uid"), "text").where("uid is not null")
    numbered = known.withColumn("item", F.col("uid")).select(F.monotonically_increasing_id().alias("uid"), "text", "item")
    scanned = numbered.select("uid", "text").mapInArrow(_scanner(span, gram, list(range(1, span)), None), _SPARK_SCHEMA)
    windows = (
        scanned.join(numbered.select("uid", "item"), "uid")
        .select("item", F.explode("cands").alias("c"))
        .groupBy("c.fp", "c.window")
        .agg(F.sort_array(F.collect_set("item")).alias("items"), F.first("c.len").alias("len"))
    )
    windows = written(windows, "windows")
    # at most span - 1 lengths
    short = [r["len"] for r in windows.where(F.col("len") < span).select("len").distinct().collect()]
    bitmap = spark.sparkContext.broadcast(bitmap_of(windows, "fp", slots))
    base = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    # the id rides along with its row: the numbers of a scan and of the same scan read again are not compared
    scan = _with_id(_scanner(span, gram, sorted(short), bitmap))
    found = base.mapInArrow(scan, f"doc {dict(base.dtypes)['doc']}, {_SPARK_SCHEMA}")
    hits = (
        found.select("uid", "doc", "n_words", F.explode_outer("cands").alias("c"))
        # rows without a candidate meet nothing; their own number as key spreads them over the tasks
        .select("uid", "doc", "n_words", F.coalesce("c.fp", "uid").alias("fp"), "c.start", "c.window")
        .join(windows, ["fp", "window"], "left")
        .groupBy("uid", "doc", "n_words")
        .agg(
            F.array_sort(F.collect_set(F.when(F.col("len").isNotNull(), F.struct(F.col("start"), (F.col("start") + F.col("len")).alias("end"))))).alias("spans"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        )
    )
    n_hit = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")),
        lambda a, s: F.struct(
            (a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], a["end"]))).cast("long").alias("n"),
            F.greatest(a["end"], s["end"]).alias("end"),
        ),
        lambda a: a["n"],
    )
    return hits.select(F.col("doc").alias(id_col), "n_words", n_hit.alias("n_hit"), "items", "spans")


def _with_id(scan):
    """Runs a scan of (uid, text) rows and puts the document's own id in front."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in scan(iter([pa.RecordBatch.from_arrays([batch.column(0), batch.column(2)], names=["uid", "text"])])):
                ids = batch.column(1).slice(at, part.num_rows)
                at += part.num_rows
                yield pa.RecordBatch.from_arrays([ids, *part.columns], names=["doc", *_SCHEMA.names])

    return run
