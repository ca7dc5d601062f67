"""Language-model scores: an interpolated modified Kneser-Ney model of word pairs, counted in Spark.

Words are lower-cased (A-Z); every text ends with an end token, and a begin mark stands before its first word.

1. Vocabulary: tasks count the words of their texts, Spark deals the counts out by ranges of the word's hash, and every
   range is stored as a sorted array of hashes with counts. A word's number is its place in the whole order.
2. Pairs: tasks count pairs of word numbers through the stored vocabulary, Spark deals them out by ranges of the pair, cut by
   the tokens the vocabulary has in front of a pair, so that ranges are even and a frequent word spreads over several.
   Every range is stored as a sorted array of pairs with counts.
3. Per word, what the pairs say about it: distinct words in front (its continuation count), and the number of followers
   seen once, twice and more. Dealt out by ranges of word numbers and stored as arrays.
4. Scores: workers map these files into memory and look up only what their texts need.

All counts cover all training texts; nothing is pruned. Discounts follow from the counts of counts, the last weight of the
interpolation falls on a uniform distribution over the vocabulary and one unknown word, so probabilities of all words after
any word add up to one.

The files live in the shared folder, which has to be mounted on the workers, as mapping needs a file. Only the sizes of the
ranges and sums over them reach the driver.

Defined cases: null and empty texts have the end token alone; repeated rows count and are scored each for itself; without training
texts every probability is 1; other columns are ignored.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm import text as tx
from tideline.llm.shared import small_batches
from tideline.session import scratch_path, written

#: hashes of the begin mark and the end token; words are moved above them
BEGIN, END = 0, 1
#: bytes of text behind one range of the vocabulary, tokens behind one range of pairs, words in one range of statistics
VOCABULARY_BYTES = 1 << 26
PAIR_TOKENS = 1 << 22
WORD_RANGE = 1 << 20
#: tokens counted in a task before its counts leave it
FLUSH = 1 << 22

_U = np.uint64


def mounted(folder: str) -> str:
    """Path of a shared folder as a task sees it."""
    parts = urlsplit(folder)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"{folder}: a language model is mapped into memory, so its folder has to be a mounted one")
    return parts.path


def _save(folder: str, name: str, values: np.ndarray) -> None:
    """Stores an array under its name at once, so that a repeated task leaves the same file."""
    os.makedirs(folder, exist_ok=True)
    part = f"{folder}/.{name}.{uuid.uuid4().hex}"
    with open(part, "wb") as out:
        np.save(out, values)
    os.replace(part, f"{folder}/{name}.npy")


def _load(folder: str, name: str) -> np.ndarray:
    return np.load(f"{folder}/{name}.npy", mmap_mode="r")


def sequences(block: tx.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of begin mark, words and end of all documents in a row, places of what is predicted, and words per document."""
    lower = tx.LOWER[block.data]
    w = tx.words(block, lower, tx.SPACED)
    order = np.arange(block.size)
    out = np.empty(w.start.size + 2 * block.size, np.uint64)
    inner = np.ones(out.size, bool)
    first, last = w.bounds[:-1] + 2 * order, w.bounds[1:] + 2 * order + 1
    inner[first] = inner[last] = False
    out[first], out[last] = BEGIN, END
    out[inner] = np.maximum(tx.span_hash(tx.running(lower), w.start, w.end), _U(2))
    predicted = np.ones(out.size, bool)
    predicted[first] = False
    return out, np.flatnonzero(predicted), w.counts


def merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of the counts of each."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    if keys.size == 0:
        return keys, counts.astype(np.int64)
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(counts.astype(np.int64), first)


def _deal(shards: np.ndarray, keys: np.ndarray, counts: np.ndarray, names: list[str]) -> pa.RecordBatch:
    """One row per range: keys counted once, and the others with their counts. ``keys`` are in the order of ``shards``."""
    own = np.unique(shards)
    cuts = np.append(np.searchsorted(shards, own), shards.size)
    rows = []
    for a, b in zip(cuts[:-1], cuts[1:]):
        once = counts[a:b] == 1
        rows.append((keys[a:b][once].tobytes(), keys[a:b][~once].tobytes(), counts[a:b][~once].astype(np.int64).tobytes()))
    columns = [pa.array(own.astype(np.int32), pa.int32()), *(pa.array([r[k] for r in rows], pa.binary()) for k in range(3))]
    return pa.RecordBatch.from_arrays(columns, names=names)


_DEALT = "shard int, once binary, several binary, times binary"
_DEALT_NAMES = ["shard", "once", "several", "times"]


def _array(value: pa.BinaryScalar, kind) -> np.ndarray:
    body = value.as_buffer()
    return np.frombuffer(body, kind) if body.size else np.zeros(0, kind)


def _gather(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    once, several = ([_array(v, np.uint64) for v in table[name]] for name in ("once", "several"))
    times = [_array(v, np.int64) for v in table["times"]]
    keys = np.concatenate(once + several)
    counts = np.concatenate([np.ones(sum(o.size for o in once), np.int64), *times])
    return merged(keys, counts)


def _hash_shard(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Range of a hash among equal ranges."""
    return ((hashes >> _U(32)) * _U(shards) >> _U(32)).astype(np.int64)


def _counting(flush: int, encode, deal):
    """Counts the keys that ``encode`` makes of every block, and deals them out whenever enough have come together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in batches:
            for block in tx.blocks(batch.column(0)):
                keys, counts = merged(k := encode(block), np.ones(k.size, np.int64))
                parts.append((keys, counts))
                size += keys.size
                if size >= flush:
                    yield deal(*merged(*(np.concatenate(p) for p in zip(*parts))))
                    parts, size = [], 0
        if size:
            yield deal(*merged(*(np.concatenate(p) for p in zip(*parts))))

    return run


class Vocabulary:
    """Sorted hashes of all words with counts, in ranges mapped from files; ``sizes`` are words and tokens of each range."""

    def __init__(self, folder: str, sizes: list[tuple[int, int]]):
        self.folder, self.sizes = folder, sizes
        self.words = np.cumsum([0, *(s for s, _ in sizes)])
        self.tokens = np.cumsum([0, *(t for _, t in sizes)])
        self.files: dict[tuple[int, str], np.ndarray] = {}

    @property
    def size(self) -> int:
        return int(self.words[-1])

    def _file(self, shard: int, name: str) -> np.ndarray:
        if (shard, name) not in self.files:
            self.files[shard, name] = _load(self.folder, f"{name}-{shard}")
        return self.files[shard, name]

    def look_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers (-1: unknown), counts and tokens in front, of hashes in order."""
        number, count, before = np.full(hashes.size, -1, np.int64), np.zeros(hashes.size, np.int64), np.zeros(hashes.size, np.int64)
        shards = _hash_shard(hashes, len(self.sizes))
        own = np.unique(shards)
        cuts = np.append(np.searchsorted(shards, own), shards.size)
        for shard, a, b in zip(own.tolist(), cuts[:-1], cuts[1:]):
            if not self.sizes[shard][0]:
                continue
            known = self._file(shard, "word")
            at = np.minimum(np.searchsorted(known, hashes[a:b]), known.size - 1)
            hit = known[at] == hashes[a:b]
            count[a:b] = np.where(hit, self._file(shard, "count")[at], 0)
            before[a:b] = np.where(hit, self._file(shard, "before")[at], 0) + self.tokens[shard]
            number[a:b] = np.where(hit, at + self.words[shard], -1)
        return number, count, before

    def by_number(self, numbers: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
        """Counts and tokens in front, of numbers in order; the number behind the last word is the begin mark's."""
        count, before = np.full(numbers.size, texts, np.int64), np.full(numbers.size, self.tokens[-1], np.int64)
        cuts = np.searchsorted(numbers, self.words)
        for shard in np.flatnonzero(np.diff(cuts)).tolist():
            a, b = cuts[shard], cuts[shard + 1]
            at = numbers[a:b] - self.words[shard]
            count[a:b], before[a:b] = self._file(shard, "count")[at], self._file(shard, "before")[at] + self.tokens[shard]
        return count, before


@lru_cache(maxsize=2)
def _vocabulary(folder: str, sizes: tuple[tuple[int, int], ...]) -> Vocabulary:
    return Vocabulary(folder, list(sizes))


def _store_words(folder: str):
    def run(key, table):
        shard = key[0].as_py()
        words, counts = _gather(table)
        _save(folder, f"word-{shard}", words)
        _save(folder, f"count-{shard}", counts)
        _save(folder, f"before-{shard}", np.cumsum(counts) - counts)
        return pa.table({"shard": pa.array([shard], pa.int32()), "words": [words.size], "tokens": [int(counts.sum())]})

    return run


def pair_place(before: np.ndarray, count: np.ndarray, following: np.ndarray, size: int) -> np.ndarray:
    """Tokens in front of a pair, if a word's followers lay evenly over the vocabulary; rises with the pair."""
    return before + count * (following / max(size, 1))


def _numbered(block: tx.Block, vocabulary: Vocabulary, texts: int):
    """Per predicted token: its document, numbers of the word in front and of itself (-1: unknown), the pair's place, both counts."""
    sequence, predicted, words = sequences(block)
    distinct, which = np.unique(sequence, return_inverse=True)
    number, count, before = vocabulary.look_up(distinct)
    # the begin mark has the number behind the last word, and as many tokens as there are texts
    begin = distinct == BEGIN
    number[begin], count[begin], before[begin] = vocabulary.size, texts, vocabulary.tokens[-1]
    left, right = which[predicted - 1], which[predicted]
    place = pair_place(before[left], count[left], number[right], vocabulary.size)
    return np.repeat(np.arange(block.size), words + 1), number[left], number[right], place, count[left], count[right]


def _pair_keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return left.astype(np.uint64) << _U(32) | right.astype(np.uint64)


_WORD_STATS = "shard int, kind string, words binary, counts binary, size long, ones long, twos long, threes long, fours long"


def _store_pairs(folder: str, word_range: int):
    """Stores a range of pairs; returns what it says about words, by ranges of their numbers, and its counts of counts."""

    def run(key, table):
        shard = key[0].as_py()
        pairs, counts = _gather(table)
        _save(folder, f"pair-{shard}", pairs)
        # as wide as the greatest count needs: most ranges fit two bytes, none is cut
        _save(folder, f"times-{shard}", counts.astype(np.min_scalar_type(counts.max(initial=0))))
        rows = [(-1, "pairs", np.array([shard]), np.zeros(0), pairs.size, *(int((counts == n).sum()) for n in (1, 2, 3, 4)))]
        left, right = (pairs >> _U(32)).astype(np.int64), (pairs & _U(0xFFFFFFFF)).astype(np.int64)
        stats = []
        if pairs.size:
            first = np.flatnonzero(np.append(True, left[1:] != left[:-1]))
            stats.append(("followers", left[first], np.stack([np.add.reduceat((c(counts)).astype(np.int64), first) for c in (lambda x: x == 1, lambda x: x == 2, lambda x: x > 2)], axis=1)))
            words, times = np.unique(right, return_counts=True)
            stats.append(("fronts", words, times.astype(np.int64)[:, None]))
        for kind, words, values in stats:
            ranges = words // word_range
            for own in np.unique(ranges):
                held = slice(*np.searchsorted(ranges, [own, own + 1]))
                rows.append((int(own), kind, words[held], values[held], 0, 0, 0, 0, 0))
        return pa.table({
            "shard": pa.array([r[0] for r in rows], pa.int32()),
            "kind": [r[1] for r in rows],
            "words": pa.array([r[2].astype(np.uint32).tobytes() for r in rows], pa.binary()),
            "counts": pa.array([r[3].astype(np.uint32).tobytes() for r in rows], pa.binary()),
            **{name: pa.array([r[4 + k] for r in rows], pa.int64()) for k, name in enumerate(("size", "ones", "twos", "threes", "fours"))},
        })

    return run


def _store_word_stats(folder: str, word_range: int):
    def run(key, table):
        own = key[0].as_py()
        fronts, followers = np.zeros(word_range, np.int64), np.zeros((word_range, 3), np.int64)
        for kind, words, counts in zip(table["kind"].to_pylist(), table["words"], table["counts"]):
            at = _array(words, np.uint32).astype(np.int64) - own * word_range
            values = _array(counts, np.uint32).astype(np.int64)
            if kind == "fronts":
                fronts[at] += values
            else:
                followers[at] += values.reshape(-1, 3)
        _save(folder, f"fronts-{own}", fronts)
        _save(folder, f"followers-{own}", followers)
        return pa.table({
            "shard": pa.array([own], pa.int32()),
            **{name: [int((fronts == n).sum())] for n, name in ((1, "ones"), (2, "twos"), (3, "threes"), (4, "fours"))},
            "more": [int((fronts > 2).sum())],
        })

    return run


#: discounts where the counts of counts give none: too few texts, or none of some count
FALLBACK = (0.5, 1.0, 1.5)


def discounts(ones: int, twos: int, threes: int, fours: int) -> np.ndarray:
    """Discounts of counts 0, 1, 2 and 3 or more, from the counts of counts; each above 0 and below its count."""
    found = FALLBACK
    if ones and twos and threes:
        share = ones / (ones + 2 * twos)
        own = (1 - 2 * share * twos / ones, 2 - 3 * share * threes / twos, 3 - 4 * share * fours / threes)
        found = own if all(0 < d < n for n, d in enumerate(own, 1)) else FALLBACK
    return np.array([0.0, *found])


class Model:
    """A stored model, its files mapped when they are first needed."""

    def __init__(self, folder: str, meta: dict):
        self.folder, self.meta = folder, meta
        self.vocabulary = Vocabulary(folder, meta["vocabulary"])
        self.files: dict[str, np.ndarray | None] = {}

    def _file(self, name: str) -> np.ndarray | None:
        if name not in self.files:
            self.files[name] = _load(self.folder, name) if os.path.exists(f"{self.folder}/{name}.npy") else None
        return self.files[name]

    def _per_word(self, name: str, words: np.ndarray, width: int) -> np.ndarray:
        """Rows of a stored array by word number, zeros for -1 and for what is not stored."""
        out = np.zeros((words.size, width), np.int64)
        ranges = np.where(words < 0, -1, words // self.meta["word_range"])
        for own in np.unique(ranges).tolist():
            found = self._file(f"{name}-{own}") if own >= 0 else None
            if found is not None:
                held = ranges == own
                out[held] = np.asarray(found[words[held] - own * self.meta["word_range"]]).reshape(-1, width)
        return out

    def pair_counts(self, left: np.ndarray, right: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Training counts of pairs; 0 where a word is unknown."""
        out = np.zeros(left.size, np.int64)
        known = np.flatnonzero((left >= 0) & (right >= 0))
        keys = _pair_keys(left[known], right[known])
        order = np.argsort(keys, kind="stable")
        known, keys = known[order], keys[order]
        shards = (place[known] // self.meta["pair_tokens"]).astype(np.int64)
        own = np.unique(shards)
        cuts = np.append(np.searchsorted(shards, own), shards.size)
        for shard, a, b in zip(own.tolist(), cuts[:-1], cuts[1:]):
            pairs = self._file(f"pair-{shard}")
            if pairs is not None and pairs.size:
                at = np.minimum(np.searchsorted(pairs, keys[a:b]), pairs.size - 1)
                out[known[a:b]] = np.where(pairs[at] == keys[a:b], self._file(f"times-{shard}")[at], 0)
        return out

    def word_probability(self, fronts: np.ndarray) -> np.ndarray:
        """Lower order: probability of words by how many words stand in front of them."""
        meta, size = self.meta, self.vocabulary.size
        if not meta["pairs"]:
            return np.full(fronts.size, 1.0 / (size + 1))
        cut = np.array(meta["word_discounts"])
        rest = (cut[1:] * meta["word_kinds"]).sum() / meta["pairs"]
        return np.maximum(fronts - cut[np.minimum(fronts, 3)], 0) / meta["pairs"] + rest / (size + 1)

    def probabilities(self, left, right, place, left_count) -> np.ndarray:
        """Interpolated probability of each word after the one in front."""
        words, which = np.unique(right, return_inverse=True)
        below = self.word_probability(self._per_word("fronts", words, 1)[:, 0])[which]
        contexts, which = np.unique(left, return_inverse=True)
        cut = np.array(self.meta["pair_discounts"])
        mass = (self._per_word("followers", contexts, 3) @ cut[1:])[which]
        counts = self.pair_counts(left, right, place)
        total = np.maximum(left_count, 1)
        found = np.maximum(counts - cut[np.minimum(counts, 3)], 0) / total + mass / total * below
        return np.where(left_count > 0, found, below)


def fit(docs: DataFrame, text_col: str = "text", vocabulary_bytes: int = VOCABULARY_BYTES, pair_tokens: int = PAIR_TOKENS, word_range: int = WORD_RANGE, flush: int = FLUSH) -> tuple[str, dict]:
    """Counts and stores a model of all given texts; returns its folder and its sums."""
    spark = docs.sparkSession
    small_batches(spark)
    folder = mounted(scratch_path(spark, "language-model"))
    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = texts.agg(F.count("*").alias("texts"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    shards = max(1, -(-size.bytes // vocabulary_bytes))

    def words_of(block: tx.Block) -> np.ndarray:
        sequence, predicted, _ = sequences(block)
        return sequence[predicted]

    def deal_words(keys, counts):
        return _deal(_hash_shard(keys, shards), keys, counts, _DEALT_NAMES)

    counted = texts.mapInArrow(_counting(flush, words_of, deal_words), _DEALT)
    stored = written(counted.groupBy("shard").applyInArrow(_store_words(folder), "shard int, words long, tokens long"), "vocabulary")
    sizes = [(0, 0)] * shards
    for row in stored.collect():
        sizes[row.shard] = (row.words, row.tokens)
    n_texts, vocabulary_size = size.texts, sum(w for w, _ in sizes)
    if vocabulary_size >= 1 << 32:
        raise ValueError("more words than pair keys can number")

    def deal_pairs(keys, counts):
        vocabulary = _vocabulary(folder, tuple(sizes))
        left, right = (keys >> _U(32)).astype(np.int64), (keys & _U(0xFFFFFFFF)).astype(np.int64)
        count, before = vocabulary.by_number(left, n_texts)
        place = pair_place(before, count, right, vocabulary.size)
        return _deal((place // pair_tokens).astype(np.int64), keys, counts, _DEALT_NAMES)

    def pairs_of(block: tx.Block) -> np.ndarray:
        _, left, right, *_ = _numbered(block, _vocabulary(folder, tuple(sizes)), n_texts)
        return _pair_keys(left, right)

    counted = texts.mapInArrow(_counting(flush, pairs_of, deal_pairs), _DEALT)
    stats = written(counted.groupBy("shard").applyInArrow(_store_pairs(folder, word_range), _WORD_STATS), "pair-stats")
    names = ("ones", "twos", "threes", "fours")
    pairs = stats.where("kind = 'pairs'").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("size"), *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names]).first()
    per_word = stats.where("kind <> 'pairs'").select("shard", "kind", "words", "counts").groupBy("shard")
    words = written(per_word.applyInArrow(_store_word_stats(folder, word_range), "shard int, ones long, twos long, threes long, fours long, more long"), "word-stats")
    kinds = words.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in (*names, "more")]).first()
    return folder, {
        "vocabulary": sizes, "texts": n_texts, "tokens": sum(t for _, t in sizes), "pairs": pairs["size"],
        "pair_tokens": pair_tokens, "word_range": word_range,
        "pair_discounts": discounts(*(pairs[n] for n in names)).tolist(),
        "word_discounts": discounts(*(kinds[n] for n in names)).tolist(),
        "word_kinds": [kinds.ones, kinds.twos, kinds.more],
    }


def score(docs: DataFrame, folder: str, meta: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, n_tokens, n_known, train_tokens, base_score (smoothed word counts) and score, both log10."""
    spark = docs.sparkSession
    small_batches(spark)
    base = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    tokens, size = meta["tokens"], sum(w for w, _ in meta["vocabulary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(folder, meta)
        for batch in batches:
            for block in tx.blocks(batch.column(1)):
                owner, left, right, place, left_count, count = _numbered(block, model.vocabulary, meta["texts"])
                plain = np.log10((count + 0.1) / (tokens + 0.1 * (size + 1)))
                found = np.log10(model.probabilities(left, right, place, left_count))
                sums = [np.bincount(owner, weights=v, minlength=block.size) for v in (plain, found)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(block.first, block.size),
                        pa.array(np.bincount(owner, minlength=block.size), pa.int64()),
                        pa.array(np.bincount(owner, weights=count > 0, minlength=block.size).astype(np.int64)),
                        pa.array(np.full(block.size, tokens), pa.int64()),
                        pa.array(sums[0]),
                        pa.array(sums[1]),
                    ],
                    names=["doc", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    kind = f"doc {dict(base.dtypes)['doc']}, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return base.mapInArrow(run, kind).withColumnRenamed("doc", id_col)


def perplexity(column: str = "score", tokens: str = "n_tokens") -> Column:
    """Perplexity per token from a log10 probability."""
    return F.pow(F.lit(10.0), -F.col(column) / F.col(tokens))
