"""Exact repeats of long byte strings by distributed prefix doubling.

A suffix array orders all positions of a text; two equal strings of ``LENGTH`` bytes then lie beside each other. Sorting
every byte position of a corpus is what this operator avoids: it ranks anchors, positions that the text itself picks. The
anchor of a position is the leftmost place with the least k-gram hash among the next ``REACH`` positions, so it depends on
the bytes behind the position alone: two equal strings have the same first anchor, less than ``REACH`` bytes from their
start, and the same anchors behind it up to their last ``REACH`` bytes or so.

1. Rank of an anchor: the hash of the phrase up to the next anchor. Anchors whose rank is unique drop out.
2. Doubling: ranks of an anchor and of the one at the present offset form a pair, pairs are sorted and ranked anew, unique
   ones drop out, and the offset doubles, until the phrases are as many as every string of ``LENGTH`` bytes has whole behind
   its first anchor. Each round sees only anchors that are still repeated.
3. A string that starts d bytes before its first anchor repeats if it stands elsewhere, at the same d before an anchor of
   equal rank. An anchor answers for a range of d. Where the bytes that all strings of the range cover stand elsewhere at the
   same place, all of them repeat; where not even the bytes common to them do, none does. What is open is cut into ranges a
   quarter as wide, down to single strings. Equality of hashes decides, no pairs within a group are formed, and of a group
   that is decided only one member stays as a partner for the others.

Equal texts are one text with a number of copies, found by digest; such a text repeats wholly.

Documents without a repeated anchor leave the process at the scan: a bitmap of fixed size tells them, whatever the corpus. A
fuller bitmap lets more texts through and changes no result.

Defined cases: null and empty texts have no bytes and no repeats; a repeated row is a copy; other columns are ignored; a text
of one letter repeated has an anchor at every position.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm import text as tx
from tideline.llm.shared import bitmap_of, in_bitmap, small_batches, written

LENGTH = 400
REACH = 96
GRAM = 8
#: each round cuts open ranges into parts this many times narrower
NARROWER = 4
#: a rank that holds more than this part of all repeated places is dealt over ``SALTS`` tasks
FREQUENT, SALTS = 1024, 64
_U = np.uint64


def first_anchors(block: tx.Block, sums: np.ndarray, reach: int, gram: int) -> np.ndarray:
    """The anchor of every position; -1 where the run of ``reach`` k-grams passes the document's end.

    Hashes are compared by their upper 32 bits, equal ones by place.
    """
    n = block.data.size
    size = n - gram - reach + 2
    out = np.full(n, -1, np.int64)
    if size <= 0:
        return out
    at = np.arange(n - gram + 1)
    code = (tx.span_hash(sums, at, at + gram) & _U(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    # least of 1, 2, 4, ... positions, then of ``reach`` by joining such runs
    width, runs = 1, {1: code}
    while 2 * width <= reach:
        code = np.minimum(code[:-width], code[width:])
        width *= 2
        runs[width] = code
    least, have = runs[width], width
    while have < reach:
        width = max(w for w in runs if w <= reach - have)
        more = runs[width][have:]
        least = np.minimum(least[: more.size], more)
        have += width
    out[:size] = (least[:size] & _U(0xFFFFFFFF)).astype(np.int64)
    end = np.repeat(block.offsets[1:], np.diff(block.offsets))
    out[np.arange(n) + reach + gram - 1 > end] = -1
    return out


def block_anchors(block: tx.Block, sums: np.ndarray, length: int, reach: int, gram: int):
    """Anchors of a block: document, place, and least and greatest distance of the strings it is first in (least > greatest: none)."""
    first = first_anchors(block, sums, reach, gram)
    starts = np.flatnonzero(first >= 0)
    anchor = first[starts]
    doc = np.searchsorted(block.offsets, starts, "right") - 1
    head = np.ones(starts.size, bool)
    head[1:] = anchor[1:] != anchor[:-1]
    at = np.flatnonzero(head)
    place, doc = anchor[at], doc[at]
    last = np.append(starts[at[1:] - 1], starts[-1:])
    last = np.minimum(last, block.offsets[doc + 1] - length)
    return doc, place, place - last, place - starts[at]


def _scan_ranks(length: int, reach: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in tx.blocks(batch.column(1)):
                sums = tx.running(block.data)
                doc, place, _, _ = block_anchors(block, sums, length, reach, gram)
                phrase = np.flatnonzero(doc[:-1] == doc[1:]) if doc.size else np.zeros(0, np.int64)
                ranks = tx.span_hash(sums, place[phrase], place[phrase + 1]).astype(np.int64)
                bounds = np.searchsorted(doc[phrase], np.arange(block.size + 1))
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ranks, pa.int64()))
                sizes = pa.array(np.diff(block.offsets), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.first, block.size), sizes, lists], names=["key", "n_bytes", "ranks"])

    return run


def doubled(ranked: DataFrame, phrases: int) -> DataFrame:
    """(tid, idx) of anchors whose next ``phrases`` phrases stand elsewhere too; ``ranked`` has tid, idx and rank."""

    def repeated(rows: DataFrame) -> DataFrame:
        # each place has one rank, so more than one row of a rank is more than one place
        several = written(rows.groupBy("rank").agg(F.count("*").alias("n")).where("n > 1"), "several")
        total = several.agg(F.sum("n")).first()[0] or 0
        # fewer than FREQUENT ranks can each hold that share of the places, whatever the corpus
        frequent = several.where(F.col("n") * FREQUENT > total).select("rank", F.lit(True).alias("frequent"))
        salts = F.when(F.col("n") * FREQUENT > total, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
        salted = rows.join(F.broadcast(frequent), "rank", "left").withColumn(
            "salt", F.when(F.col("frequent"), F.pmod(F.xxhash64("tid", "idx"), F.lit(SALTS)).cast("int")).otherwise(0)
        )
        return salted.join(several.select("rank", F.explode(salts).alias("salt")), ["rank", "salt"]).drop("salt", "frequent")

    offset = 1
    left = written(repeated(ranked), "ranks")
    while offset < phrases:
        behind = left.select("tid", (F.col("idx") - offset).alias("idx"), F.col("rank").alias("behind"))
        left = written(repeated(left.join(behind, ["tid", "idx"]).select("tid", "idx", F.xxhash64("rank", "behind").alias("rank"))), "ranks")
        offset *= 2
    return left.select("tid", "idx")


_PIECE = "tid long, place int, near int, far int, part int, core long, hull long"
_PIECE_NAMES = ["tid", "place", "near", "far", "part", "core", "hull"]


def _digests(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64 bits of a digest of each range of bytes; unlike the polynomial hash, no two texts are built to share it."""
    body = data.tobytes()
    return np.frombuffer(b"".join(hashlib.blake2b(body[a:b], digest_size=8).digest() for a, b in zip(start.tolist(), end.tolist())), "<i8")


def _scan_pieces(width: int, length: int, reach: int, gram: int, from_index: bool):
    """Pieces of ``width`` distances of the anchors asked for: by number among the anchors, or by place and distances."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in tx.blocks(batch.column(1)):
                sums = tx.running(block.data)
                asked = batch.column(2).slice(block.first, block.size)
                tids = np.asarray(batch.column(0).slice(block.first, block.size))
                counts = np.asarray(pc.list_value_length(asked))
                doc = np.repeat(np.arange(block.size), counts)
                flat = pc.list_flatten(asked)
                if from_index:
                    of, places, nears, fars = block_anchors(block, sums, length, reach, gram)
                    begin = np.searchsorted(of, np.arange(block.size))
                    k = begin[doc] + np.asarray(flat)
                    place, near, far = places[k], nears[k], fars[k]
                else:
                    place = np.asarray(pc.struct_field(flat, "place")).astype(np.int64) + block.offsets[doc]
                    near, far = (np.asarray(pc.struct_field(flat, c)).astype(np.int64) for c in ("near", "far"))
                held = near <= far
                doc, place, near, far = doc[held], place[held], near[held], far[held]
                parts = far // width - near // width + 1
                ends = np.cumsum(parts)
                total = int(ends[-1]) if ends.size else 0
                part = np.repeat(near // width - (ends - parts), parts) + np.arange(total)
                doc, place, near, far = (np.repeat(x, parts) for x in (doc, place, near, far))
                near, far = np.maximum(near, part * width), np.minimum(far, part * width + width - 1)
                # common to all strings whose distance is in this part, whoever asks
                core = tx.span_hash(sums, place - part * width, place - part * width - width + 1 + length)
                hull = _digests(block.data, place - far, place - near + length)
                columns = [tids[doc], (place - block.offsets[doc]).astype(np.int32), near.astype(np.int32), far.astype(np.int32), part.astype(np.int32), core.astype(np.int64), hull]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=_PIECE_NAMES)

    return run


def settle(pieces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pieces all of whose strings repeat, and one member of each group that has to be looked at more closely.

    A hull is told apart within its core's class, and its digest has nothing to do with the core's polynomial hash, so two
    hashes of 64 bits have to agree, also where core and hull are the same bytes.
    """
    member = F.struct("tid", "place", "near", "far")
    groups = written(
        pieces.groupBy("part", "core", "hull").agg(F.min(member).alias("low"), F.max(member).alias("high"))
        .withColumn("settled", F.col("low") != F.col("high")),
        "hulls",
    )
    whole = pieces.join(groups.where("settled").select("part", "core", "hull"), ["part", "core", "hull"], "left_semi")
    mixed = groups.groupBy("part", "core").agg(F.count("*").alias("n"), F.min("settled").alias("all")).where("n > 1 and not all").select("part", "core")
    return whole, groups.join(mixed, ["part", "core"]).select("low.*")


def repeated_spans(docs: DataFrame, text_col: str = "text", length: int = LENGTH, reach: int = REACH, gram: int = GRAM) -> DataFrame:
    """(key, spans): distinct texts with repeated bytes, and the ranges that cover these bytes, unmerged; ``text_key`` names a text."""
    small_batches(docs.sparkSession)
    keyed = docs.select(text_key(text_col).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where("text <> ''")
    scanned = keyed.mapInArrow(_scan_ranks(length, reach, gram), "key binary, n_bytes long, ranks array<long>")
    one = scanned.groupBy("key").agg(F.count("*").alias("copies"), F.first("n_bytes").alias("n_bytes"), F.first("ranks").alias("ranks"))
    # numbered once and written, so that a number means the same text everywhere
    texts = written(one.withColumn("tid", F.monotonically_increasing_id()), "texts")
    ranked = texts.select("tid", F.posexplode("ranks").alias("idx", "rank"))
    # behind the first anchor a string has this many phrases whole: the rest of it, less what its last run may not fix
    sure = max(1, (length + 1 - reach - gram - (reach - 1)) // reach)
    anchors = doubled(ranked, 1 << (sure.bit_length() - 1))
    asked = anchors.groupBy("tid").agg(F.sort_array(F.collect_list("idx")).alias("asked"))
    asked = written(asked.join(texts.select("tid", "key"), "tid"), "asked")
    bodies = _passing(keyed, asked).groupBy("key").agg(F.first("text").alias("text"))
    bodies = written(bodies.join(asked, "key").select("tid", "text", "asked"), "bodies")
    pieces = bodies.mapInArrow(_scan_pieces(reach, length, reach, gram, True), _PIECE)
    width, spans = reach, []
    while True:
        pieces = written(pieces, "pieces")
        whole, todo = settle(pieces)
        spans.append(whole.select("tid", (F.col("place") - F.col("far")).alias("from"), (F.col("place") - F.col("near") + length).alias("to")))
        if width == 1:
            break
        width = max(1, width // NARROWER)
        todo = todo.groupBy("tid").agg(F.collect_list(F.struct("place", "near", "far")).alias("todo"))
        again = bodies.select("tid", "text").join(todo, "tid")
        pieces = again.mapInArrow(_scan_pieces(width, length, reach, gram, False), _PIECE)
    spans.append(texts.where(f"copies > 1 and n_bytes >= {length}").select("tid", F.lit(0).alias("from"), F.col("n_bytes").cast("int").alias("to")))
    rows = spans[0]
    for more in spans[1:]:
        rows = rows.unionByName(more)
    per_text = rows.groupBy("tid").agg(F.sort_array(F.collect_set(F.struct("from", "to"))).alias("spans"))
    return written(per_text.join(texts.select("tid", "key"), "tid").select("key", "spans"), "spans")


def text_key(text_col: str = "text"):
    return F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))


def _passing(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows whose key may be among ``keys``, by a bitmap of fixed size; all others are surely not."""
    spark = rows.sparkSession
    bits = spark.sparkContext.broadcast(bitmap_of(keys.select(F.xxhash64("key").alias("fp"))))
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = in_bitmap(bits.value, np.asarray(batch.column(0)).astype(np.int64).astype(np.uint64))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in batch.columns[1:]], names=names)

    return rows.select(F.xxhash64("key").alias("fp"), *names).mapInArrow(run, rows.schema)


def merged(spans: list[dict]) -> list[tuple[int, int]]:
    """Maximal runs of sorted ranges; ranges that touch are one run."""
    out: list[tuple[int, int]] = []
    for span in spans:
        if out and span["from"] <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], span["to"]))
        else:
            out.append((span["from"], span["to"]))
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, reach: int = REACH, gram: int = GRAM, keep_bytes: bool = False) -> DataFrame:
    """Per document: id, n_bytes, n_removed, n_spans and kept_sha256; with ``keep_bytes`` also the bytes that remain."""
    spans = repeated_spans(docs, text_col, length, reach, gram)
    spark = docs.sparkSession
    bits = spark.sparkContext.broadcast(bitmap_of(spans.select(F.xxhash64("key").alias("fp"))))
    base = docs.select(F.col(id_col).alias("doc"), text_key(text_col).alias("key"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    kind = dict(base.dtypes)["doc"]

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts that surely have no repeats are done here; only the others travel."""
        for batch in batches:
            maybe = in_bitmap(bits.value, np.asarray(batch.column(0)).astype(np.int64).astype(np.uint64))
            texts = batch.column(3)
            done = [None if m else hashlib.sha256(t.as_buffer()).hexdigest() for m, t in zip(maybe.tolist(), texts)]
            travel = texts if keep_bytes else pc.if_else(pa.array(maybe), texts, pa.scalar(None, texts.type))
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), batch.column(2), pc.binary_length(texts).cast(pa.int64()), travel, pa.array(done, pa.string())],
                names=["doc", "key", "n_bytes", "text", "done"],
            )

    first = base.select(F.xxhash64("key").alias("fp"), "doc", "key", "text").mapInArrow(digests, f"doc {kind}, key binary, n_bytes long, text binary, done string")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, runs, digest, bodies = [], [], [], []
            for text, done, spans in zip(batch.column(2), batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                own = merged(spans or [])
                body = text.as_py() if done is None or keep_bytes else None
                if done is None:
                    edges = [0, *(x for run in own for x in run), len(body)]
                    body = b"".join(body[a:b] for a, b in zip(edges[::2], edges[1::2]))
                    done = hashlib.sha256(body).hexdigest()
                removed.append(sum(b - a for a, b in own))
                runs.append(len(own))
                digest.append(done)
                bodies.append(body)
            columns = [batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(digest, pa.string())]
            names = ["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if keep_bytes:
                columns.append(pa.array(bodies, pa.binary()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"doc {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if keep_bytes else "")
    joined = first.join(spans, "key", "left").select("doc", "n_bytes", "text", "done", "spans")
    return joined.mapInArrow(cut, schema).withColumnRenamed("doc", id_col)
