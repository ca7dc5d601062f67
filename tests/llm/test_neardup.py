"""Near duplicates against all pairs in plain Python, and the pipeline's stage on them."""

import random
import re

import corpus_pipeline
from tideline.llm import neardup, queries
from tideline.llm.components import components
from tideline.llm.neardup import near_duplicates

SMALL = "/root/testdata/sf0.001"


def shingles(text, n=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < n:
        return {tuple(words)} if words else set()
    return {tuple(words[k: k + n]) for k in range(len(words) - n + 1)}


def plain(texts: dict, percent=85, n=3) -> dict:
    sets = {i: shingles(t, n) for i, t in texts.items()}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(sets[i]), root(i), root(i) == i) for i in ids}


def loose_group(rnd, vocabulary, size, words):
    """Copies of one text with a few words replaced: some pairs are similar enough, others only through a third text."""
    base = [rnd.choice(vocabulary) for _ in range(words)]
    out = []
    for _ in range(size):
        own = list(base)
        for _ in range(rnd.randrange(0, 9)):
            own[rnd.randrange(words)] = rnd.choice(vocabulary)
        out.append(" ".join(own))
    return out


def test_groups_equal_all_pairs(spark):
    rnd = random.Random(8)
    vocabulary = [f"w{k}" for k in range(400)]
    texts = [t for size, words in ((40, 60), (25, 90), (15, 150)) for t in loose_group(rnd, vocabulary, size, words)]
    texts += [" ".join(rnd.choice(vocabulary) for _ in range(50)) for _ in range(20)]
    texts += [None, "", " \n", "one", "ONE", "one two", "one  two", "one two three", texts[0], texts[0].upper(), texts[3]]
    rnd.shuffle(texts)
    given = dict(enumerate(texts))
    docs = spark.createDataFrame(list(given.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs).collect()}
    assert got == plain(given)


def test_query_on_the_small_documents(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in queries.op8_near_duplicates(spark, SMALL).collect()}
    assert got == plain(texts)


def test_rows_without_id_and_repeated_rows(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (4, "a b c d"), (4, "a b c d"), (2, "x y z w")], "doc_id long, text string")
    rows = sorted(tuple(r) for r in near_duplicates(docs).collect() if r.doc_id is not None)
    assert rows == [(2, 2, 2, True), (4, 2, 4, True), (4, 2, 4, True)]
    assert [r.kept for r in near_duplicates(docs).where("doc_id is null").collect()] == [True, True]


def test_keys_and_sets_that_spark_sizes_too_low_are_not_broadcast(spark, monkeypatch):
    rnd = random.Random(3)
    vocabulary = [f"w{k}" for k in range(300)]
    given = dict(enumerate(t for size, words in ((30, 60), (20, 90)) for t in loose_group(rnd, vocabulary, size, words)))
    plans, write = {}, neardup.written

    def noted(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return write(df, name)

    monkeypatch.setattr(neardup, "written", noted)
    docs = spark.createDataFrame(list(given.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs).collect()}
    assert got == plain(given)
    # tables of this size would be, if they were sized by the files they come from
    for name, held in (("members", "explode"), ("links", "shingles"), ("groups", "shingles")):
        assert held in plans[name] and "Broadcast" not in plans[name], name


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_other_columns_may_have_any_name(spark):
    docs = spark.createDataFrame([(1, "a b c", 5, "k"), (2, "a b c", 6, "l")], "doc_id long, text string, component_id int, key string")
    assert sorted((r.doc_id, r.component_id) for r in near_duplicates(docs).collect()) == [(1, 1), (2, 1)]


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(10, 40)] + [(100, k) for k in range(101, 130)] + [(5, 200), (200, 7), (9, 9)]
    rnd = random.Random(1)
    edges = [e if rnd.random() < 0.5 else e[::-1] for e in edges]
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    expected = {k: 10 for k in range(10, 41)} | {k: 100 for k in range(100, 130)} | {5: 5, 200: 5, 7: 5}
    assert found == expected


def test_pipeline_stage_keeps_one_of_each_group(spark):
    rnd = random.Random(2)
    base = [f"v{rnd.randrange(200)}" for _ in range(80)]
    near = [*base[:40], "changed", *base[41:]]
    rows = [(1, " ".join(base), "en", "s", 1), (2, " ".join(near), "en", "s", 2), (3, "quite another text of six words", "en", "s", 3), (3, "quite another text of six words", "en", "s", 3), (4, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, SMALL)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3, 4]
