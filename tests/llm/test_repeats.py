"""Removed repeats against every substring in plain Python."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tideline.llm import queries, repeats
from tideline.llm.repeats import merged, remove_repeats

SMALL = "/root/testdata/sf0.001"


def plain(texts, length):
    bodies = [(t or "").encode() for t in texts]
    seen = Counter(b[s: s + length] for b in bodies for s in range(len(b) - length + 1))
    out = []
    for b in bodies:
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            if seen[b[s: s + length]] > 1:
                gone[s: s + length] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone]) if b else b""
        runs = int(np.diff(gone.astype(int), prepend=0).clip(0).sum())
        out.append((len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("length, reach, gram", [(40, 10, 3), (60, 12, 4), (30, 7, 2)])
def test_equal_to_every_substring(spark, length, reach, gram):
    rnd = random.Random(length)
    sources = ["".join(rnd.choice("abcd é") for _ in range(rnd.randrange(20, 300))) for _ in range(12)]
    texts = []
    for _ in range(120):
        cuts = []
        for _ in range(rnd.randrange(0, 5)):
            source = rnd.choice(sources)
            at = rnd.randrange(len(source))
            cuts.append(source[at: at + rnd.randrange(1, 200)])
        texts.append("".join(cuts))
    texts += [None, "", "a" * 500, "a" * 300, "ab" * 200, "xyz" * 100, texts[3], texts[3]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in remove_repeats(docs, length=length, reach=reach, gram=gram).collect()}
    assert [got[k] for k in range(len(texts))] == plain(texts, length)


def test_query_on_the_small_documents(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = {r.doc_id: tuple(r)[1:] for r in queries.op9_suffix_repeats(spark, SMALL).collect()}
    assert got == dict(zip(texts, plain(texts.values(), 400)))


def test_kept_bytes_and_repeated_rows(spark):
    rnd = random.Random(3)
    passage = "".join(rnd.choice("abcdefgh ") for _ in range(450))
    rows = [(1, f"start {passage} end", 7), (2, f"other {passage} close", 8), (3, "alone", 9), (3, "alone", 9), (None, passage, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_bytes long")
    got = sorted((r.doc_id or 0, r.n_removed, r.n_spans, bytes(r.kept)) for r in remove_repeats(docs, keep_bytes=True).collect())
    # the blanks around the passage are the same in both, so they repeat with it
    assert got == [(0, 450, 1, b""), (1, 452, 1, b"startend"), (2, 452, 1, b"otherclose"), (3, 0, 0, b"alone"), (3, 0, 0, b"alone")]


def test_a_rank_of_a_third_of_all_places_and_many_rare_ones(spark, monkeypatch):
    monkeypatch.setattr(repeats, "FREQUENT", 4)
    monkeypatch.setattr(repeats, "SALTS", 3)
    rows = [(t, 0, 7) for t in range(40)] + [(t, 1, 100 + t // 2) for t in range(41)]
    ranked = spark.createDataFrame(rows, "tid long, idx int, rank long")
    got = sorted(tuple(r) for r in repeats.doubled(ranked, 1).collect())
    assert got == sorted([(t, 0) for t in range(40)] + [(t, 1) for t in range(40)])


def test_empty_table(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_touching_ranges_are_one_run():
    spans = [{"from": 0, "to": 5}, {"from": 5, "to": 7}, {"from": 6, "to": 6}, {"from": 9, "to": 10}]
    assert merged(spans) == [(0, 7), (9, 10)]


def test_strings_of_equal_polynomial_hash_are_no_repeat(spark):
    # these two strings of 2,048 letters agree in every polynomial hash modulo 2 ** 64
    bits = [bin(k).count("1") % 2 for k in range(2048)]
    texts = ["".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)]
    asked = pa.array([[{"place": 0, "near": 0, "far": 0}]] * 2, pa.list_(pa.struct([("place", pa.int32()), ("near", pa.int32()), ("far", pa.int32())])))
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(texts), asked], names=["tid", "text", "todo"])
    rows = [r for out in repeats._scan_pieces(1, 2048, 16, 8, False)(iter([batch])) for r in out.to_pylist()]
    assert len(rows) == 2 and rows[0]["core"] == rows[1]["core"]
    pieces = spark.createDataFrame([tuple(r.values()) for r in rows], repeats._PIECE)
    assert repeats.settle(pieces)[0].collect() == []
