"""Substring dedup of word windows by super-k-mer partitioning.

A window is ``WINDOW`` consecutive words of one document; a word goes if a window that covers it also starts in a document
with a smaller id. Equal windows have to meet without shipping every window with all its words:

1. The minimiser of a window is the least hash among its runs of ``GRAM`` words. Consecutive windows mostly share one, and
   all windows of such a stretch, a super-k-mer, travel as one packed string of words to the bucket of their minimiser. Equal
   windows have equal minimisers, so they meet in one bucket. Equal strings of a part of a task travel once, with the
   least and the greatest id that has them, and all strings of a task for one bucket are one compressed value.
2. In a bucket the windows of all its strings are sorted by hash; windows of equal hash are compared word by word, and every
   run of equal ones knows its least and greatest id. Strings with a window that some owner has to drop are named by digest,
   with the least id of each of their windows.
3. Documents are cut into the same strings again, those that are surely not named stay where they are read (a bitmap of fixed
   size), the others look up their least ids by digest, and what is covered by a window that stands in a document with a
   smaller id is dropped.

A minimiser that has too many strings for one bucket, such as that of a line in a third of all documents, is found by a count
before: its windows travel one by one as strings of their own, which Spark aggregates before and after the shuffle, so no group
of rows is ever held together. At most ``HOT_SHARE`` minimisers can be that frequent, so their list has a fixed bound. Buckets
grow in number, not in size. The list, the bitmap and the number of buckets change no result.

Defined cases: null and empty texts have no words, texts of less than a window drop nothing; rows that share an id drop nothing
of each other; a row without an id counts as one behind all others; ids are integers; other columns are ignored.
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

WINDOW = 13
GRAM = 3
#: a minimiser with more than a share of one in so many strings is split; so many, 512 KB, are the most there can be
HOT_SHARE = 1 << 16
#: strings of a bucket, some 6 MB
BUCKET = 50_000
#: bytes of strings that a task holds before it packs them, and rows handed over at once
HELD, HANDED = 1 << 25, 10_000
#: bytes whose words are looked at together; what is known of them takes some 200 times as much
PART = 1 << 18
LAST = (1 << 63) - 1
_U = np.uint64


def packed_words(data: np.ndarray, w: tx.Words, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The wanted words, each with one blank behind it, and where each begins."""
    lengths = w.end - w.start
    letters = data[tx.SPACED[data]]
    if not wanted.all():
        letters, lengths = letters[np.repeat(wanted, lengths)], lengths[wanted]
    at = np.append(0, np.cumsum(lengths + 1))
    packed = np.full(int(at[-1]), 32, np.uint8)
    packed[np.arange(letters.size) + np.repeat(np.arange(lengths.size), lengths)] = letters
    return packed, at


class Strings:
    """The packed strings of a block: first word, words, minimiser, document, and the text they are slices of."""

    def __init__(self, block: tx.Block, window: int, gram: int, hot: np.ndarray):
        w = tx.words(block, block.data, tx.SPACED)
        self.words = w
        packed, self.at = packed_words(block.data, w, np.ones(w.start.size, bool))
        self.packed = packed
        sums = tx.running(block.data)
        self.hashes = tx.span_hash(sums, w.start, w.end)
        grams = tx.gram_hash(self.hashes, gram)
        whole = tx.within(w.doc, window)
        least = np.full(whole.size, np.iinfo(np.uint64).max, np.uint64)
        for j in range(window - gram + 1):
            np.minimum(least, grams[j: j + whole.size], out=least)
        starts = np.flatnonzero(whole)
        mini = least[starts]
        head = np.ones(starts.size, bool)
        head[1:] = (mini[1:] != mini[:-1]) | (starts[1:] != starts[:-1] + 1)
        if hot.size:
            # windows of a frequent minimiser are strings of their own
            place = np.minimum(np.searchsorted(hot, mini), hot.size - 1)
            alone = hot[place] == mini
            head |= alone
        else:
            alone = np.zeros(starts.size, bool)
        heads = np.flatnonzero(head)
        self.first = starts[heads]
        self.n_words = np.diff(np.append(heads, starts.size)) + window - 1
        self.mini, self.hot = mini[heads], alone[heads]
        self.doc = w.doc[self.first]
        self.fp = tx.span_hash(tx.running(packed), self.at[self.first], self.at[self.first + self.n_words] - 1)

    def bodies(self, chosen: np.ndarray) -> list[bytes]:
        body = self.packed.tobytes()
        first, n = self.first[chosen], self.n_words[chosen]
        return [body[a:b] for a, b in zip(self.at[first].tolist(), (self.at[first + n] - 1).tolist())]


def string_key(body: bytes) -> bytes:
    return hashlib.blake2b(body, digest_size=16).digest()


def _count_minimisers(window: int, gram: int, share: int):
    """Strings of a task by minimiser, of those that have their share of the task; the row without a minimiser has the sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        minis, counts, total = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0
        for batch in batches:
            seen = []
            for block in tx.blocks(batch.column(1), PART):
                found = Strings(block, window, gram, np.zeros(0, np.uint64))
                # equal strings of a batch travel once
                _, one = np.unique(found.fp, return_index=True)
                seen.append(found.mini[one])
            new = np.concatenate([np.zeros(0, np.uint64), *seen])
            total += new.size
            minis, place = np.unique(np.concatenate([minis, new]), return_inverse=True)
            counts = np.bincount(place, np.concatenate([counts, np.ones(new.size, np.int64)]), minis.size).astype(np.int64)
        often = counts > max(1, total // share)
        yield pa.RecordBatch.from_arrays(
            [pa.array([None, *minis[often].astype(np.int64).tolist()], pa.int64()), pa.array([total, *counts[often].tolist()], pa.int64())], names=["mini", "n"]
        )

    return run


def pack(bodies: pa.Array, low: np.ndarray, high: np.ndarray) -> bytes:
    """Strings and their ids as one compressed string of bytes."""
    lengths = np.asarray(pc.binary_length(bodies)).astype("<i4")
    raw = b"".join([np.array([lengths.size], "<i8").tobytes(), low.astype("<i8").tobytes(), high.astype("<i8").tobytes(), lengths.tobytes(), *bodies.to_pylist()])
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes]:
    """Least ids, greatest ids, lengths and the joined strings."""
    raw = pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), "zstd", asbytes=True)
    n = int.from_bytes(raw[:8], "little")
    ids = np.frombuffer(raw, "<i8", 2 * n, 8)
    return ids[:n], ids[n:], np.frombuffer(raw, "<i4", n, 8 + 16 * n), raw[8 + 20 * n:]


def _emit(window: int, gram: int, hot: np.ndarray, buckets: int, most: int):
    """Per bucket the strings of a part of a task, packed; those of frequent minimisers one by one, without a bucket.

    Equal strings of a part, some ``most`` bytes, travel once, with the least and greatest id that has them.
    """

    def flush(parts: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        merged = pa.concat_tables(parts).group_by(["bucket", "body"], use_threads=False).aggregate([("doc", "min"), ("doc", "max")]).sort_by("bucket").combine_chunks()
        bucket = np.asarray(merged["bucket"].fill_null(-1))
        bodies, low, high = merged["body"].combine_chunks(), np.asarray(merged["doc_min"]), np.asarray(merged["doc_max"])
        alone = int((bucket < 0).sum())
        cold = bucket.size - alone
        heads = np.append(_runs(bucket[:cold]), cold)
        blobs = [pack(bodies.slice(x, y - x), low[x:y], high[x:y]) for x, y in zip(heads[:-1].tolist(), heads[1:].tolist())]
        nothing = [None] * len(blobs)
        names = ["bucket", "body", "low", "high"]
        yield pa.RecordBatch.from_arrays([pa.array(bucket[heads[:-1]]), pa.array(blobs, pa.binary()), pa.array(nothing, pa.int64()), pa.array(nothing, pa.int64())], names=names)
        for x in range(cold, bucket.size, HANDED):
            part = merged.slice(x, HANDED).rename_columns(names).combine_chunks()
            yield from part.to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in batches:
            ids = np.asarray(batch.column(0))
            for block in tx.blocks(batch.column(1), PART):
                found = Strings(block, window, gram, hot)
                if not found.first.size:
                    continue
                bucket = pa.array((found.mini % _U(buckets)).astype(np.int64), mask=found.hot)
                bodies = found.bodies(np.arange(found.first.size))
                parts.append(pa.table({"bucket": bucket, "body": pa.array(bodies, pa.binary()), "doc": ids[block.first + found.doc]}))
                size += parts[-1].nbytes
                if size >= most:
                    yield from flush(parts)
                    parts, size = [], 0
        if parts:
            yield from flush(parts)

    return run


def _runs(values: np.ndarray) -> np.ndarray:
    """First places of runs of equal values."""
    head = np.ones(values.size, bool)
    head[1:] = values[1:] != values[:-1]
    return np.flatnonzero(head)


def _word_numbers(data: np.ndarray, w: tx.Words, wanted: np.ndarray) -> np.ndarray:
    """A number for each wanted word, equal for equal words alone; -1 for the others."""
    at = np.flatnonzero(wanted)
    lengths = w.end[at] - w.start[at]
    ends = np.append(0, np.cumsum(lengths))
    letters = data[np.repeat(w.start[at] - ends[:-1], lengths) + np.arange(int(ends[-1]))]
    spans = pa.LargeBinaryArray.from_buffers(pa.large_binary(), at.size, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(letters)])
    out = np.full(wanted.size, -1, np.int64)
    out[at] = np.asarray(spans.dictionary_encode().indices)
    return out


def _classes(code: np.ndarray, several: np.ndarray, starts: np.ndarray, data: np.ndarray, w: tx.Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows in an order in which equal ones stand together, and a number that equal ones alone have in common.

    ``several`` come in the order of their hash; the words decide.
    """
    words = _word_numbers(data, w, tx.covered(starts[several], window, w.start.size))
    at = _runs(code[several])
    heads = several[at][np.repeat(np.arange(at.size), np.diff(np.append(at, several.size)))]
    same = np.ones(several.size, bool)
    for j in range(window):
        same &= words[starts[several] + j] == words[starts[heads] + j]
    if same.all():
        return several, code[several]
    number = np.unique(np.stack([words[starts[several] + j] for j in range(window)], axis=1), axis=0, return_inverse=True)[1].ravel()
    order = np.argsort(number)
    return several[order], number[order]


def _hashed_words(data: np.ndarray, ends: np.ndarray) -> tuple[tx.Words, np.ndarray]:
    """Words of strings that stand one behind the other, and their hashes, a part of the strings at a time."""
    spans = pa.LargeBinaryArray.from_buffers(pa.large_binary(), ends.size - 1, [None, pa.py_buffer(ends), pa.py_buffer(data)])
    start, end, counts, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for block in tx.blocks(spans, PART):
        w = tx.words(block, block.data, tx.SPACED)
        hashes.append(tx.span_hash(tx.running(block.data), w.start, w.end))
        start.append(w.start + ends[block.first])
        end.append(w.end + ends[block.first])
        counts.append(w.counts)
    each = np.concatenate(counts)
    return tx.Words(np.concatenate(start), np.concatenate(end), np.append(0, np.cumsum(each)), np.repeat(np.arange(each.size), each)), np.concatenate(hashes)


def bucket_lows(body: bytes, lengths: np.ndarray, low: np.ndarray, high: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, place of the window in it, least id with that window) of every window that some owner of its string drops.

    ``body`` holds the strings one behind the other, as long as ``lengths`` say.
    """
    data = np.frombuffer(body, np.uint8)
    w, hashes = _hashed_words(data, np.append(0, np.cumsum(lengths.astype(np.int64))))
    starts = np.flatnonzero(tx.within(w.doc, window))
    owner = w.doc[starts]
    least = low[owner]
    code = tx.gram_hash(hashes, window)[starts]
    order = np.argsort(code)
    twice = np.flatnonzero(code[order[1:]] == code[order[:-1]])
    paired = np.zeros(order.size, bool)
    paired[twice] = paired[twice + 1] = True
    if twice.size:
        several, number = _classes(code, order[paired], starts, data, w, window)
        at = _runs(number)
        least[several] = np.repeat(np.minimum.reduceat(low[owner[several]], at), np.diff(np.append(at, several.size)))
    chosen = np.flatnonzero(least < high[owner])
    return owner[chosen], starts[chosen] - w.bounds[owner[chosen]], least[chosen]


#: windows ``from .. to - 1`` of a string stand first in the document ``low``
_NAMED = "fp long, key binary, from int, to int, low long"


def _settle(window: int):
    def run(group: pa.Table) -> pa.Table:
        parts = [unpack(blob) for blob in group.column("body").to_pylist()]
        low, high, lengths = (np.concatenate([p[k] for p in parts]) for k in range(3))
        body = b"".join(p[3] for p in parts)
        string, place, least = bucket_lows(body, lengths, low, high, window)
        # stretches of windows with one least id
        head = np.ones(string.size, bool)
        head[1:] = (string[1:] != string[:-1]) | (place[1:] != place[:-1] + 1) | (least[1:] != least[:-1])
        at = np.flatnonzero(head)
        size = np.diff(np.append(at, string.size))
        ends = np.cumsum(lengths.astype(np.int64))
        named = [body[a:b] for a, b in zip((ends - lengths)[string[at]].tolist(), ends[string[at]].tolist())]
        columns = [pa.array(_body_hashes(named), pa.int64()), pa.array([string_key(b) for b in named], pa.binary()), pa.array(place[at], pa.int32()), pa.array(place[at] + size, pa.int32()), pa.array(least[at], pa.int64())]
        return pa.table(columns, names=["fp", "key", "from", "to", "low"])

    return run


def _body_hashes(bodies: list[bytes]) -> np.ndarray:
    """The hash that ``Strings`` gives the same bytes."""
    out = [np.zeros(0, np.int64)]
    for block in tx.blocks(pa.array(bodies, pa.large_binary()), PART):
        out.append(tx.span_hash(tx.running(block.data), block.offsets[:-1], block.offsets[1:]).astype(np.int64))
    return np.concatenate(out)


def _name_single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Names of the strings that are one window."""
    for batch in batches:
        bodies = batch.column(0).to_pylist()
        n = len(bodies)
        columns = [pa.array(_body_hashes(bodies), pa.int64()), pa.array([string_key(b) for b in bodies], pa.binary()), pa.array(np.zeros(n, np.int32)), pa.array(np.ones(n, np.int32)), batch.column(1)]
        yield pa.RecordBatch.from_arrays(columns, names=["fp", "key", "from", "to", "low"])


def _look_up(window: int, gram: int, hot: np.ndarray, bits):
    """Strings of the documents that may be named: key, id, text and first word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in tx.blocks(batch.column(1), PART):
                found = Strings(block, window, gram, hot)
                chosen = np.flatnonzero(in_bitmap(bits.value, found.fp))
                if not chosen.size:
                    continue
                rows = pa.array(block.first + found.doc[chosen])
                keys = pa.array([string_key(b) for b in found.bodies(chosen)], pa.binary())
                first = pa.array((found.first - found.words.bounds[found.doc])[chosen].astype(np.int32))
                yield pa.RecordBatch.from_arrays([keys, batch.column(0).take(rows), batch.column(2).take(rows), first], names=["key", "doc", "body_key", "first"])

    return run


def hot_minimisers(base: DataFrame, window: int, gram: int, share: int) -> tuple[np.ndarray, int]:
    """Minimisers of more than two in ``share`` strings, sorted, at most ``share`` of them, and the number of all strings."""
    counted = base.mapInArrow(_count_minimisers(window, gram, share), "mini long, n long").groupBy("mini").agg(F.sum("n").alias("n"))
    counted = written(counted, "minimisers")
    total = counted.where("mini is null").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    hot = counted.where("mini is not null").where(F.col("n") > max(1, total // share)).select("mini").collect()
    return np.sort(np.array([r.mini for r in hot], np.int64).astype(np.uint64)), total


def dropped_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, share: int = HOT_SHARE, bucket: int = BUCKET) -> DataFrame:
    """(doc, body_key, stretches): by id and text, ranges of first words of windows that stand in a document with a smaller id.

    A row without an id has the greatest integer as ``doc``.
    """
    spark = docs.sparkSession
    small_batches(spark)
    base = docs.select(owner(id_col).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), text_key(text_col).alias("body_key")).where("text <> ''")
    hot, total = hot_minimisers(base.select("doc", "text"), window, gram, share)
    buckets = max(1, -(-total // bucket))
    strings = base.select("doc", "text").mapInArrow(_emit(window, gram, hot, buckets, HELD), "bucket long, body binary, low long, high long")
    named = strings.where("bucket is not null").select("bucket", "body").groupBy("bucket").applyInArrow(_settle(window), _NAMED)
    if hot.size:
        single = strings.where("bucket is null").groupBy("body").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low < high")
        named = named.unionByName(single.select("body", "low").mapInArrow(_name_single, _NAMED))
    named = written(named, "named-strings")
    bits = spark.sparkContext.broadcast(bitmap_of(named))
    asked = base.mapInArrow(_look_up(window, gram, hot, bits), "key binary, doc long, body_key binary, first int")
    # stretches whose least id is below the document's own
    found = asked.join(named.drop("fp"), "key").where("low < doc")
    stretch = F.struct((F.col("first") + F.col("from")).alias("from"), (F.col("first") + F.col("to")).alias("to"))
    return found.select("doc", "body_key", stretch.alias("stretch")).groupBy("doc", "body_key").agg(F.collect_list("stretch").alias("stretches"))


def owner(id_col: str):
    return F.coalesce(F.col(id_col).cast("long"), F.lit(LAST))


def text_key(text_col: str):
    return F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))


def _kept(block: tx.Block, stretches: pa.Array | None, window: int) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Of a block's documents: words, dropped ones among them, and the rest joined by blanks."""
    w = tx.words(block, block.data, tx.SPACED)
    edge = np.zeros(w.start.size + 1, np.int64)
    if stretches is not None:
        lengths = np.asarray(pc.list_value_length(stretches).fill_null(0))
        flat, begin = pc.list_flatten(stretches), np.repeat(w.bounds[:-1], lengths)
        np.add.at(edge, begin + np.asarray(pc.struct_field(flat, "from")), 1)
        np.add.at(edge, begin + np.asarray(pc.struct_field(flat, "to")) + window - 1, -1)
    gone = np.cumsum(edge[:-1]) > 0
    packed, at = packed_words(block.data, w, ~gone)
    left = np.append(0, np.cumsum(~gone))[w.bounds]
    body = packed.tobytes()
    rest = [body[a: b - 1] if b > a else b"" for a, b in zip(at[left[:-1]].tolist(), at[left[1:]].tolist())]
    return w.counts, tx.per_document(gone, w.bounds), rest


def drop_repeated_windows(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, share: int = HOT_SHARE,
    bucket: int = BUCKET, keep_text: bool = False,
) -> DataFrame:
    """Per document: id, n_words, n_removed, kept_sha256; with ``keep_text`` also the words that remain, joined by blanks."""
    spark = docs.sparkSession
    found = written(dropped_windows(docs, id_col, text_col, window, gram, share, bucket), "dropped-windows")
    bits = spark.sparkContext.broadcast(bitmap_of(found.select(F.xxhash64("doc", "body_key").alias("fp"))))
    base = docs.select(F.col(id_col).alias("doc"), owner(id_col).alias("own"), text_key(text_col).alias("body_key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = dict(base.dtypes)["doc"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts that surely lose nothing are done here; only the others travel."""
        for batch in batches:
            maybe = in_bitmap(bits.value, np.asarray(batch.column(0)).astype(np.uint64))
            texts = batch.column(4)
            travel = pc.if_else(pa.array(maybe), texts, pa.scalar(None, texts.type))
            here = pc.if_else(pa.array(maybe), pa.scalar(None, texts.type), texts)
            words, digests, kept = [], [], []
            for block in tx.blocks(here, PART):
                counts, _, rest = _kept(block, None, window)
                words += counts.tolist()
                digests += [hashlib.sha256(b).hexdigest() for b in rest]
                kept += [b.decode() for b in rest] if keep_text else [None] * len(rest)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:4], travel, pa.array(words, pa.int64()), pa.array(digests, pa.string()), pa.array(kept, pa.string())],
                names=["doc", "own", "body_key", "text", "n_words", "digest", "kept"],
            )

    schema = f"doc {kind}, own long, body_key binary, text string, n_words long, digest string, kept string"
    first = base.select(F.xxhash64("own", "body_key").alias("fp"), "doc", "own", "body_key", "text").mapInArrow(scan, schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = pc.is_null(batch.column(1)).to_pylist()
            words, digests, kept = (batch.column(k).to_pylist() for k in (2, 3, 4))
            gone = [0] * len(done)
            for block in tx.blocks(batch.column(1), PART):
                counts, dropped, rest = _kept(block, batch.column(5).slice(block.first, block.size), window)
                for d, body in enumerate(rest):
                    k = block.first + d
                    if not done[k]:
                        words[k], gone[k], digests[k] = int(counts[d]), int(dropped[d]), hashlib.sha256(body).hexdigest()
                        kept[k] = body.decode() if keep_text else None
            columns = [batch.column(0), pa.array(words, pa.int64()), pa.array(gone, pa.int64()), pa.array(digests, pa.string()), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc", "n_words", "n_removed", "kept_sha256", "kept"])

    renamed = found.withColumnRenamed("doc", "own")
    joined = first.join(renamed, ["own", "body_key"], "left").select("doc", "text", "n_words", "digest", "kept", "stretches")
    out = joined.mapInArrow(cut, f"doc {kind}, n_words long, n_removed long, kept_sha256 string, kept string").withColumnRenamed("doc", id_col)
    return out if keep_text else out.drop("kept")
