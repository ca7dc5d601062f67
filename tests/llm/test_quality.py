"""Classifier and rules: held-out accuracy, independence of other columns, counts against plain Python."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from tideline.llm import labelled, quality, queries, rules
from tideline.llm import text as tx

MIDDLE, SMALL = "/root/testdata/sf0.01", "/root/testdata/sf0.001"


def area(scores, labels):
    """Share of pairs of a good and a bad text that the scores order rightly."""
    good, bad = (np.array([s for s, y in zip(scores, labels) if y == k]) for k in (1, 0))
    return ((good[:, None] > bad).mean() + (good[:, None] == bad).mean() / 2).item()


def test_classifier_on_held_out_labels(spark):
    scored = {r.doc_id: r for r in queries.op2_quality(spark, MIDDLE).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in scored.items())
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in scored.values())
    held = [(scored[r.doc_id].score, r.quality) for r in spark.read.parquet(f"{MIDDLE}/labels.parquet").collect() if scored[r.doc_id].held_out]
    assert area(*zip(*held)) > 0.97


def test_rules_on_held_out_labels(spark):
    got = {r.doc_id: r for r in queries.op3_quality_rules(spark, MIDDLE).collect()}
    assert not any(r.kept and r.base_failed for r in got.values())
    held = [(got[r.doc_id], r.quality) for r in spark.read.parquet(f"{MIDDLE}/labels.parquet").collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    judged = [(int(r.kept), y) for r, y in held if not r.base_failed]
    assert sum(a == b for a, b in judged) > 0.95 * len(judged)


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    where = {}
    for k in range(len(words) - 4):
        where.setdefault(tuple(words[k: k + 5]), []).append(k)
    repeated = {p for at in where.values() if len(at) > 1 for k in at for p in range(k, k + 5)}
    seen, again = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
        seen.add(line)
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), again, len(repeated)]


def test_counts_of_odd_texts(spark):
    rnd = random.Random(9)
    texts = ["".join(rnd.choice(["a ", "b ", "é", "\n", "# ", "\x0b", "日 ", "| "]) for _ in range(rnd.randrange(0, 120))) for _ in range(150)]
    texts += [None, "", "\n\n", "a\na\n a\n", "x y z w v x y z w v", "a " * 12, "w " * 5000]
    docs = spark.createDataFrame([(k, t, 1.5, "z") for k, t in enumerate(texts)], "doc_id long, text string, n_words double, probability string")
    got = {r.doc_id: r for r in rules.judge(docs, np.zeros(rules.BUCKETS + 2)).collect()}
    for k, t in enumerate(texts):
        r, expected = got[k], plain_counts(t)
        assert [r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words] == expected
        failed = expected[0] < 10 or 100 * expected[4] > 20 * expected[0]
        assert (r.base_failed, r.kept, r.probability) == (failed, not failed, 0.5)


def test_small_blocks_count_the_same():
    texts = ["a b c a b c a b c a b", "", "x\ny\nx\n", None, "p q r s t p q r s t"]
    for limit in (1, 8, 1 << 20):
        found = [tuple(c) for block in tx.blocks(pa.array(texts), limit) for c in zip(*(v.tolist() for v in rules.block_counts(block).values()))]
        assert [list(c) for c in found] == [plain_counts(t) for t in texts]


def test_other_columns_do_not_move_scores(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    changed = docs.withColumns({"lang": F.lit(None).cast("string"), "source": F.lit("x"), "score": F.lit("text")})
    one, two = ({r.doc_id: r.score for r in quality.quality(d, labels).collect()} for d in (docs, changed))
    assert one == two


def test_without_labels_of_both_kinds(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (None, 0), (3, None), (4, 7)], "doc_id long, quality int")
    assert [r.score for r in quality.quality(docs, labels).collect()] == [0.5] * 3
    assert quality.quality(docs.where("doc_id > 5"), labels.where("doc_id > 9")).collect() == []


def test_bad_bytes_and_long_words_have_features():
    block = next(tx.blocks(pa.array(["x" * 20000 + " é 日本 \u0001"])))
    weights = np.zeros(66)
    weights[:] = 1.0
    assert np.allclose(quality.document_scores(block, weights, quality.SIZES), [1.0])


def test_pipeline_stage_keeps_the_columns(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = corpus_pipeline.keep_quality(spark, docs, SMALL)
    assert kept.columns == docs.columns and 0.7 * docs.count() < kept.count() < docs.count()


def test_repeated_ids_do_not_grow_the_sample(spark):
    rows = [(1, "good words here")] * 300 + [(1, "zz other text"), (2, "bad bad bad"), (None, "x"), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, label int")

    def learn(got):
        return np.array([len(got), sum(label for label, _, _ in got)], float)

    once = spark.createDataFrame([(1, min("good words here", "zz other text", key=lambda t: hashlib.md5(t.encode()).digest())), (2, "bad bad bad"), (3, "")], docs.schema)
    sized = [labelled.fitted(d, labels, learn, 1 << 10, (3,)).tolist() for d in (docs, once)]
    assert sized == [[3.0, 1.0]] * 2
    features = [labelled.fitted(d, labels, lambda got: np.concatenate([b for _, b, _ in got]).astype(float), 1 << 10, (3,)).tolist() for d in (docs, once)]
    assert features[0] == features[1]
