"""Dropped windows against all windows in plain Python."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tideline.llm import superkmers as sk
from tideline.llm import text as tx
from tideline.llm.superkmers import bucket_lows, drop_repeated_windows

LAST = (1 << 63) - 1


def plain(rows, window):
    """Per row: words, dropped words, what remains."""
    split = [(LAST if d is None else d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    low: dict[tuple, int] = {}
    for d, words in split:
        for k in range(len(words) - window + 1):
            w = tuple(words[k: k + window])
            low[w] = min(low.get(w, d), d)
    out = []
    for d, words in split:
        gone = [False] * len(words)
        for k in range(len(words) - window + 1):
            if low[tuple(words[k: k + window])] < d:
                gone[k: k + window] = [True] * window
        out.append((len(words), sum(gone), " ".join(w for w, g in zip(words, gone) if not g)))
    return out


def made(seed):
    rnd = random.Random(seed)
    words = [rnd.choice("ab é漢") * rnd.randrange(1, 4) for _ in range(12)]
    sources = [[rnd.choice(words) for _ in range(80)] for _ in range(10)]
    line = [f"w{k}" for k in range(9)]
    texts = []
    for _ in range(150):
        out = []
        for _ in range(rnd.randrange(0, 5)):
            source = rnd.choice(sources)
            at = rnd.randrange(len(source))
            out += source[at: at + rnd.randrange(1, 40)]
            if rnd.random() < 0.5:
                out += line
        texts.append(rnd.choice([" ", "  ", "\n", " \t"]).join(out))
    texts += [None, "", " \n", "one", texts[3], texts[3], "x " * 3000, " ".join(line), "\n".join(line * 2)]
    rows = [(int(d), t) for d, t in zip(rnd.sample(range(-50, 10_000), len(texts)), texts)]
    # ids that several rows share, with the same and with other texts, and rows without one
    rows += [(rows[7][0], rows[8][1]), rows[9], rows[9], (None, rows[10][1]), (None, rows[10][1]), (None, " ".join(f"v{k}" for k in range(30)))]
    return rows


@pytest.mark.parametrize("window, gram, share, bucket", [(13, 3, 1 << 16, 50_000), (5, 2, 40, 30), (4, 1, 5, 7), (3, 3, 1 << 16, 100)])
def test_equal_to_all_windows(spark, window, gram, share, bucket):
    rows = made(window)
    docs = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, n_words int").repartition(5)
    got = drop_repeated_windows(docs, window=window, gram=gram, share=share, bucket=bucket, keep_text=True).collect()
    want = [(d, n, gone, hashlib.sha256(rest.encode()).hexdigest(), rest) for (d, _), (n, gone, rest) in zip(rows, plain(rows, window))]
    assert any(w[2] for w in want)
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_frequent_minimisers_are_found_and_bounded(spark):
    texts = [f"a{k} b{k} c{k} one two three four five six d{k} e{k} f{k}" for k in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc long, text string").repartition(4)
    hot, total = sk.hot_minimisers(docs, 5, 2, 20)
    assert 0 < hot.size <= 20 and total > 400


def test_windows_of_equal_hash_are_told_apart(monkeypatch):
    # every window has one hash, so only the words can tell them apart
    monkeypatch.setattr(tx, "gram_hash", lambda hashes, n: np.zeros(max(hashes.size - n + 1, 0), np.uint64))
    bodies = [b"a b c d", b"b c d e", b"x y z"]
    string, place, least = bucket_lows(b"".join(bodies), np.array([7, 7, 5]), np.array([4, 2, 1]), np.array([6, 2, 1]), 3)
    assert list(zip(string.tolist(), place.tolist(), least.tolist())) == [(0, 0, 4), (0, 1, 2)]


def test_packed_strings_come_back():
    bodies = pa.array([b"one two", b"", "é".encode()], pa.binary())
    low, high, lengths, body = sk.unpack(sk.pack(bodies, np.array([3, -1, 7]), np.array([4, LAST, 7])))
    assert (low.tolist(), high.tolist(), lengths.tolist(), body) == ([3, -1, 7], [4, LAST, 7], [7, 0, 2], "one twoé".encode())


def test_strings_cover_every_window_once():
    text = " ".join(random.Random(2).choices("abcdefg", k=500))
    block = next(tx.blocks(pa.array([text, "", "a b", text[:200]], pa.string())))
    none = np.zeros(0, np.uint64)
    for hot in (none, np.unique(sk.Strings(block, 13, 3, none).mini)[::2]):
        found = sk.Strings(block, 13, 3, hot)
        windows = [(f + k) for f, n in zip(found.first.tolist(), found.n_words.tolist()) for k in range(n - 12)]
        assert windows == np.flatnonzero(tx.within(found.words.doc, 13)).tolist()
        assert all(len(b.split()) == n for b, n in zip(found.bodies(np.arange(found.first.size)), found.n_words.tolist()))


def test_very_long_text_and_empty_table(spark):
    rnd = random.Random(1)
    long = " ".join(rnd.choices([f"w{k}" for k in range(5000)], k=300_000))
    docs = spark.createDataFrame([(1, long), (2, "new words in front " + long), (3, "short")], "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed) for r in drop_repeated_windows(docs).collect()}
    assert got == {1: (300_000, 0), 2: (300_004, 300_000), 3: (1, 0)}
    assert drop_repeated_windows(docs.where("false")).collect() == []


def test_a_bucket_is_hashed_in_parts(monkeypatch):
    """What is known of the bytes of a bucket is never held for all of them, and the parts change no result."""
    rnd = random.Random(4)
    words = [f"w{k}" for k in range(300)]
    bodies = [" ".join(rnd.choices(words[k % 7 * 40: k % 7 * 40 + 40], k=rnd.randrange(13, 30))).encode() for k in range(400)] * 3
    ids = np.array(rnd.sample(range(10_000), len(bodies)))
    given = (b"".join(bodies), np.array([len(b) for b in bodies]), ids, ids, 13)
    whole, seen, real = bucket_lows(*given), [], tx.running
    names = sk._body_hashes(bodies)
    monkeypatch.setattr(tx, "running", lambda data: seen.append(data.size) or real(data))
    monkeypatch.setattr(sk, "PART", 4096, raising=False)
    parts = bucket_lows(*given)
    assert whole[0].size and all((a == b).all() for a, b in zip(whole, parts, strict=True))
    assert (names == sk._body_hashes(bodies)).all() and max(seen) <= 4096
