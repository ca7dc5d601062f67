"""Token counts and byte-level BPE against the public libraries, and exact round trips."""

import base64
import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
import tiktoken

from tideline.llm import queries, tokens
from tideline.llm.bytebpe import codec, round_trip

SMALL = "/root/testdata/sf0.001"
PIECES = public_tokenizers.path("piece_bpe_32k.model")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def pieces():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts_of(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}


ODD = [None, "", " ", "   ", "\n\n a\n b \n", "<s>", "</s><unk>", "▁a ▁▁b", "日本語 テキスト", "é" * 30, "a  b   c    ", "\u0000x\u0001", "😀 👍🏽", "aaaa" * 50]


def test_counts_are_those_of_the_library(spark, pieces):
    texts = texts_of(spark)
    for r in queries.op5_token_counts(spark, SMALL).collect():
        body = texts[r.doc_id] or ""
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(body.encode()), len(pieces.encode(body)), len(pieces.encode(body)) > 4096)


def test_odd_texts(spark, pieces):
    docs = spark.createDataFrame([(k, t, "extra") for k, t in enumerate(ODD)], "doc_id long, text string, n_tokens string")
    got = {r.doc_id: r.n_tokens for r in tokens.count_tokens(docs, PIECES, chunk=8, overlap=2).collect()}
    assert got == {k: len(pieces.encode(t or "")) for k, t in enumerate(ODD)}


@pytest.mark.parametrize("chunk, overlap", [(40, 4), (100, 30), (300, 20), (64, 64)])
def test_spliced_chunks_are_the_whole_encoding(spark, pieces, chunk, overlap):
    rnd = random.Random(chunk)
    alphabet = ["a", "be", "the", " ", "  ", "\n", "é", "日", "▁", "-", "1"]
    bodies = ["".join(rnd.choice(alphabet) for _ in range(700)) for _ in range(20)]
    bodies += ["x" * 500, "no space " + "y" * 400 + " then words again and again", " lead" * 150]
    assert tokens.marks_begin_words(PIECES)
    for body in bodies:
        assert tokens.spliced(pieces, body, True, chunk, overlap) == pieces.encode(body)
        assert tokens.spliced(pieces, body, False, chunk, overlap) == pieces.encode(body)


def test_ids_are_those_of_the_reference_encoder(spark, reference):
    texts = texts_of(spark)
    for r in queries.op7_byte_bpe(spark, SMALL).collect():
        body = texts[r.doc_id] or ""
        ids = reference.encode_ordinary(body)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(body.encode()).hexdigest()


def test_random_texts_round_trip(reference):
    own, rnd = codec(RANKS, public_tokenizers.PATTERN), random.Random(4)
    for _ in range(1500):
        points = [rnd.randrange(1, 128) if rnd.random() < 0.6 else rnd.choice([rnd.randrange(128, 0xD800), rnd.randrange(0x10000, 0x110000)]) for _ in range(rnd.randrange(0, 50))]
        body = "".join(map(chr, points))
        text, ids = own.encode(body)
        assert ids.tolist() == reference.encode_ordinary(body) and text == ",".join(map(str, ids))
        assert own.decode(ids) == body.encode()


def test_odd_texts_keep_their_ids(spark, reference):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(ODD)] + [(None, "a b"), (1, "a b")], "doc_id long, text string")
    rows = round_trip(docs, RANKS, public_tokenizers.PATTERN, keep_ids=True).collect()
    assert len(rows) == len(ODD) + 2
    known = {(r.doc_id, r.n_tokens): r.ids for r in rows}
    for k, t in enumerate(ODD):
        ids = reference.encode_ordinary(t or "")
        assert known[k, len(ids)] == ids


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert tokens.count_tokens(docs, PIECES).collect() == [] and round_trip(docs, RANKS, public_tokenizers.PATTERN).collect() == []
