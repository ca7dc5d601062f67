"""Benchmark windows against every window in plain Python; the query itself is compared with its SQL."""

import random
import re

import corpus_pipeline
from tideline.llm.decontaminate import decontaminate

SMALL = "/root/testdata/sf0.001"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(texts, items, span=10):
    windows = {}
    for item, text in items:
        own = words(text)
        n = min(len(own), span)
        for k in range(len(own) - n + 1 if n else 0):
            windows.setdefault(tuple(own[k: k + n]), set()).add(str(item))
    lengths = {len(w) for w in windows}
    out = []
    for text in texts:
        own, hit, found = words(text), set(), set()
        for n in lengths:
            for k in range(len(own) - n + 1):
                items_of = windows.get(tuple(own[k: k + n]))
                if items_of:
                    hit.update(range(k, k + n))
                    found |= items_of
        out.append((len(own), len(hit), sorted(found)))
    return out


def test_equal_to_every_window(spark):
    rnd = random.Random(6)
    vocabulary = ["a", "B", "c1", "é", "日本", "the"]
    items = [(k, " ".join(rnd.choice(vocabulary) for _ in range(rnd.choice([0, 1, 3, 9, 10, 11, 25])))) for k in range(25)]
    items += [(30, None), (31, "..."), (7, items[3][1]), (32, items[5][1])]
    texts = []
    for _ in range(60):
        parts = []
        for _ in range(rnd.randrange(0, 4)):
            parts.append(" ".join(rnd.choice(["q", "r", "s", "the", "a"]) for _ in range(rnd.randrange(0, 12))))
            own = words(rnd.choice(items)[1])
            at = rnd.randrange(len(own) + 1)
            parts.append(rnd.choice([" ", "-", ".\n"]).join(own[at: at + rnd.randrange(0, 30)]))
        texts.append(" ".join(parts))
    texts += [None, "", "!!!", texts[0], "x " * 3000 + (items[0][1] or "")]
    docs = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, n_hit int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in decontaminate(docs, bench).collect()}
    assert [got[k] for k in range(len(texts))] == plain(texts, items)
    # a bitmap so small that nearly all fingerprints pass changes nothing
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in decontaminate(docs, bench, slots=1).collect()}
    assert [got[k] for k in range(len(texts))] == plain(texts, items)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c"), (None, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert sorted((r.n_words, r.n_hit, r["items"]) for r in decontaminate(docs, none).collect()) == [(0, 0, []), (3, 0, [])]
    assert decontaminate(docs.where("doc_id > 5"), spark.createDataFrame([(1, "a b")], "item_id long, text string")).collect() == []


def test_pipeline_stage_drops_hit_documents_only(spark):
    item = spark.read.parquet(f"{SMALL}/benchmark.parquet").orderBy("item_id").first()
    rows = [(1, f"before {item.text} after"), (2, "a clean text of some words that no item holds in this order"), (3, None), (None, "without an id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id or 0) for r in corpus_pipeline.drop_contaminated(spark, docs, SMALL).collect()) == [0, 2, 3]


def test_pipeline_stage_judges_each_row_by_its_own_text(spark):
    item = spark.read.parquet(f"{SMALL}/benchmark.parquet").orderBy("item_id").first()
    dirty, clean = f"before {item.text} after", "a clean text of some words that no item holds in this order"
    rows = [(None, dirty, 1), (None, dirty, 2), (None, clean, 3), (7, dirty, 4), (7, clean, 5), (None, None, 6), (8, clean, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, hit int")
    kept = corpus_pipeline.drop_contaminated(spark, docs, SMALL)
    assert kept.columns == docs.columns and sorted(r.hit for r in kept.collect()) == [3, 5, 6, 7]
