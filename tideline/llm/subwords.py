"""Hashed word and character n-gram features, counted per distinct word of a block.

Beside the hashed buckets stands one more, the share of words that equal the word before them: a run of
one word says the same whatever the word is.
"""

from __future__ import annotations

import numpy as np

from tideline.llm import text as tx

_U = np.uint64
_OPEN, _CLOSE = 0x110000, 0x110001


def feature_lists(data: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray, buckets: int, sizes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the given words: each word itself, then its character n-grams with word borders.

    Returns the buckets of all words, and where each word's list begins (one entry more than words).
    """
    count = start.size
    if count == 0:
        return np.zeros(0, np.int64), np.zeros(1, np.int64)
    # the words, one code point per entry, each with a border in front and behind
    length = end - start
    ends = np.cumsum(length)
    body = data[np.repeat(start - (ends - length), length) + np.arange(int(ends[-1]))]
    heads = (body & 0xC0) != 0x80
    points = np.frombuffer(body.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
    owner = np.repeat(np.arange(count), length)[heads]
    if owner.size != points.size:
        # bytes that are no UTF-8: each byte counts as a character
        points, owner = body.astype(np.uint32), np.repeat(np.arange(count), length)
    chars = np.bincount(owner, minlength=count)
    total = points.size + 2 * count
    code = np.empty(total, np.uint64)
    word = np.repeat(np.arange(count), chars + 2)
    first = np.zeros(count + 1, np.int64)
    np.cumsum(chars + 2, out=first[1:])
    inner = np.ones(total, bool)
    inner[first[:-1]] = False
    inner[first[1:] - 1] = False
    code[first[:-1]], code[first[1:] - 1], code[inner] = _OPEN, _CLOSE, points
    code = tx.mix(code + _U(1))
    lists, words = [(hashes % _U(buckets)).astype(np.int64)], [np.arange(count)]
    for n in sizes:
        inside = tx.within(word, n)
        grams = tx.gram_hash(code, n)[inside]
        lists.append((grams % _U(buckets)).astype(np.int64))
        words.append(word[: inside.size][inside])
    owner = np.concatenate(words)
    order = np.argsort(owner, kind="stable")
    bounds = np.zeros(count + 1, np.int64)
    np.cumsum(np.bincount(owner, minlength=count), out=bounds[1:])
    return np.concatenate(lists)[order], bounds


def distinct_words(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place of every distinct word, and each word's number among them."""
    _, first, number = np.unique(hashes, return_index=True, return_inverse=True)
    return first, number


def echoes(hashes: np.ndarray, w: tx.Words) -> np.ndarray:
    """Share of each document's words that equal the word before them."""
    same = np.zeros(hashes.size, np.int64)
    same[1:] = (hashes[1:] == hashes[:-1]) & (w.doc[1:] == w.doc[:-1])
    return tx.per_document(same, w.bounds) / np.maximum(w.counts, 1)


def document_features(block: tx.Block, buckets: int, sizes: tuple[int, ...]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of every document its buckets and their shares: words weigh equally, and features within a word do.

    The share of echoes is in bucket number ``buckets``.
    """
    w = tx.words(block, block.data, tx.SPACED)
    hashes = tx.span_hash(tx.running(block.data), w.start, w.end)
    first, number = distinct_words(hashes)
    lists, bounds = feature_lists(block.data, w.start[first], w.end[first], hashes[first], buckets, sizes)
    share = 1.0 / np.diff(bounds)
    echo = echoes(hashes, w)
    out = []
    for d in range(block.size):
        own, times = np.unique(number[w.bounds[d]: w.bounds[d + 1]], return_counts=True)
        if own.size == 0:
            out.append((np.zeros(0, np.int32), np.zeros(0, np.float32)))
            continue
        sizes_of = bounds[own + 1] - bounds[own]
        ends = np.cumsum(sizes_of)
        at = np.repeat(bounds[own] - (ends - sizes_of), sizes_of) + np.arange(int(ends[-1]))
        weight = np.repeat(times * share[own], sizes_of)
        keys, place = np.unique(lists[at], return_inverse=True)
        shares = np.bincount(place, weights=weight) / times.sum()
        if echo[d]:
            keys, shares = np.append(keys, buckets), np.append(shares, echo[d])
        out.append((keys.astype(np.int32), shares.astype(np.float32)))
    return out


def document_scores(block: tx.Block, weights: np.ndarray, sizes: tuple[int, ...]) -> np.ndarray:
    """Sum of feature shares times the weights of their buckets, per document; 0 without words.

    The last weight is that of the echoes.
    """
    w = tx.words(block, block.data, tx.SPACED)
    hashes = tx.span_hash(tx.running(block.data), w.start, w.end)
    if hashes.size == 0:
        return np.zeros(block.size)
    first, number = distinct_words(hashes)
    lists, bounds = feature_lists(block.data, w.start[first], w.end[first], hashes[first], weights.size - 1, sizes)
    each = np.add.reduceat(weights[lists], bounds[:-1]) / np.diff(bounds)
    sums = np.zeros(hashes.size + 1)
    np.cumsum(each[number], out=sums[1:])
    counts = w.counts
    return (sums[w.bounds[1:]] - sums[w.bounds[:-1]]) / np.maximum(counts, 1) + weights[-1] * echoes(hashes, w)
