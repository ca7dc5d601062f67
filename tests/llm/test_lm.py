"""Language-model scores against the same model in plain Python."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tideline.llm import lm, queries


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + ["</s>"]


class Plain:
    def __init__(self, texts):
        self.pairs, self.count = Counter(), Counter()
        for text in texts:
            own = words(text)
            self.count.update(own)
            self.pairs.update(zip(["<s>", *own], own))
        self.fronts = Counter(w for _, w in self.pairs)
        self.total = Counter()
        self.kinds = defaultdict(lambda: [0, 0, 0, 0])
        for (v, _), c in self.pairs.items():
            self.total[v] += c
            self.kinds[v][min(c, 3)] += 1
        self.cut, self.word_cut = self.discounts(self.pairs), self.discounts(self.fronts)
        self.word_kinds = [sum(min(a, 3) == n for a in self.fronts.values()) for n in (1, 2, 3)]

    @staticmethod
    def discounts(counts):
        n = Counter(counts.values())
        if n[1] and n[2] and n[3]:
            y = n[1] / (n[1] + 2 * n[2])
            d = [1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2], 3 - 4 * y * n[4] / n[3]]
            if 0 < d[0] < 1 and 0 < d[1] < 2 and 0 < d[2] < 3:
                return [0, *d]
        return [0, 0.5, 1, 1.5]

    def below(self, w):
        size, total = len(self.count), len(self.pairs)
        if not total:
            return 1 / (size + 1)
        a = self.fronts[w]
        rest = sum(d * k for d, k in zip(self.word_cut[1:], self.word_kinds)) / total
        return max(a - self.word_cut[min(a, 3)], 0) / total + rest / (size + 1)

    def probability(self, v, w):
        if not self.total[v]:
            return self.below(w)
        c = self.pairs[v, w]
        mass = sum(self.cut[k] * self.kinds[v][k] for k in (1, 2, 3))
        return (max(c - self.cut[min(c, 3)], 0) + mass * self.below(w)) / self.total[v]

    def row(self, text):
        own, n, v = words(text), sum(self.count.values()), len(self.count)
        base = sum(math.log10((self.count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own)
        score = sum(math.log10(self.probability(a, b)) for a, b in zip(["<s>", *own], own))
        return len(own), sum(self.count[w] > 0 for w in own), n, base, score


def same(got, expected):
    return got[:3] == expected[:3] and all(abs(a - b) < 1e-6 * max(1, abs(b)) for a, b in zip(got[3:], expected[3:]))


@pytest.mark.parametrize("ranges", [{}, {"vocabulary_bytes": 300, "pair_tokens": 50, "word_range": 7, "flush": 40}])
def test_scores_equal_plain_counts(spark, ranges):
    rnd = random.Random(3)
    vocabulary = ["the", "The", "of", "é", "日本", "a,b", "x", "y", "zz", "longer"]
    texts = [" ".join(rnd.choice(vocabulary) for _ in range(rnd.randrange(0, 30))) for _ in range(80)] + [None, "", " \n", "the", "the"]
    train = spark.createDataFrame([(t,) for t in texts], "text string")
    ask = [*texts[:20], None, "", "unseen words here", "the unseen of"]
    docs = spark.createDataFrame(list(enumerate(ask)), "doc_id long, text string")
    folder, meta = lm.fit(train, **ranges)
    plain = Plain(texts)
    for row in lm.score(docs, folder, meta).collect():
        assert same(tuple(row)[1:], plain.row(ask[row.doc_id])), row
    total = sum(plain.probability("the", w) for w in plain.count) + plain.probability("the", "never seen")
    assert abs(total - 1) < 1e-9


def test_counts_beyond_32_bits_are_stored_whole(tmp_path):
    pairs, counts = np.array([3, 5], np.uint64), np.array([7, 5_000_000_000], np.int64)
    table = pa.table({"once": pa.array([b""], pa.binary()), "several": [pairs.tobytes()], "times": [counts.tobytes()]})
    lm._store_pairs(str(tmp_path), 7)((pa.scalar(0),), table)
    model = lm.Model(str(tmp_path), {"vocabulary": [(8, 0)], "pair_tokens": 10})
    zero = np.zeros(3, np.int64)
    assert model.pair_counts(zero, np.array([5, 3, 4]), zero).tolist() == [5_000_000_000, 7, 0]


def test_no_training_texts(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    rows = lm.score(docs, *lm.fit(docs.where("doc_id > 9"))).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in sorted(rows)] == [(3, 0, 0, 0.0, 0.0), (1, 0, 0, 0.0, 0.0)]


def test_query_over_the_small_documents(spark):
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in texts}
    plain = Plain([t for i, t in texts.items() if not held[i]])
    rows = queries.op10_lm_scores(spark, folder).select("doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score", "held_out").collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.held_out == held[r.doc_id] and same(tuple(r)[1:6], plain.row(texts[r.doc_id]))


def test_perplexity(spark):
    row = spark.sql("select -6.0D as score, 3L as n_tokens").select(F.round(lm.perplexity(), 6)).first()
    assert row[0] == 100
