"""The pipeline: stages on rows made for them, and the whole run on the small documents."""

import hashlib
import random

import corpus_pipeline
import public_tokenizers
import pytest
import tiktoken
from tiktoken.load import load_tiktoken_bpe

from tideline.llm import neardup

SMALL = "/root/testdata/sf0.001"


def prose(seed, n=60):
    rnd = random.Random(seed)
    return " ".join("".join(rnd.choices("abcdefghij", k=rnd.randrange(2, 8))) for _ in range(n))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "web", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_rows_of_one_id_are_judged_by_their_own_text(spark):
    a, b, c = prose(1), prose(2), prose(3)
    near = a.replace(a.split()[30], "changed", 1)
    rows = [(3, a), (7, b), (7, a), (9, near), (9, c), (9, c), (None, a), (None, a), (11, None), (12, "")]
    got = corpus_pipeline.drop_near_duplicates(spark, frame(spark, rows), SMALL)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    want = [(3, a), (7, b), (9, c), (None, a), (None, a), (11, None), (12, "")]
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == sorted(want, key=repr)


def test_ids_of_further_texts_are_numbers_of_their_own(spark):
    docs = frame(spark, [(5, "x"), (5, "y"), (5, "y"), (8, "z"), (None, "x")])
    rows = corpus_pipeline.with_text_ids(docs, "key").select("doc_id", "text", "key").collect()
    keys = {(r.doc_id, r.text): r.key for r in rows}
    assert len(rows) == 5 and keys[8, "z"] == 8 and keys[None, "x"] is None
    assert len({keys[5, "x"], keys[5, "y"]}) == 2 and 5 in (keys[5, "x"], keys[5, "y"]) and max(keys[5, "x"], keys[5, "y"]) > 8


def test_near_duplicate_stage_broadcasts_neither_keys_nor_sets(spark, monkeypatch):
    plans, write = {}, neardup.written

    def noted(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return write(df, name)

    monkeypatch.setattr(neardup, "written", noted)
    a, b = prose(1), prose(2)
    rows = [(1, a), (2, a.replace(a.split()[30], "changed", 1)), (3, b), (3, a), (None, b)]
    got = corpus_pipeline.drop_near_duplicates(spark, frame(spark, rows), SMALL)
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == sorted([(1, a), (3, b), (None, b)], key=repr)
    for name, held in (("members", "explode"), ("links", "shingles")):
        assert held in plans[name] and "Broadcast" not in plans[name], name


def test_stages_on_empty_tables(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").where("false")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL)
        assert out.collect() == [], name
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns, name


def test_encode_gives_the_ids_of_the_library(spark):
    ranks = load_tiktoken_bpe(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [None, "", " ", "Ünïcode 漢字 😀", "a" * 5000, prose(4)]
    got = corpus_pipeline.encode(spark, frame(spark, list(enumerate(texts)) + [(None, "x"), (1, "twice")]), SMALL).collect()
    rows = sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got)
    want = []
    for i, t in [*enumerate(texts), (None, "x"), (1, "twice")]:
        ids = coder.encode_ordinary(t or "")
        want.append((i is None, i or 0, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert rows == sorted(want)


@pytest.fixture(scope="module")
def steps(spark):
    """What each stage of a whole run returned."""
    docs, out = spark.read.parquet(f"{SMALL}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, SMALL), "tested-stage")
        out.append(docs)
    return out


def test_run_is_its_stages(spark, steps):
    assert sorted(map(tuple, corpus_pipeline.run(spark, SMALL).collect())) == sorted(map(tuple, steps[-1].collect()))


def test_each_stage_keeps_what_it_should(spark, steps):
    from tideline.llm import queries

    texts = [{r.doc_id: r.text for r in s.select("doc_id", "text").collect()} for s in steps[:4]]
    scored = {r.doc_id for r in queries.op2_quality(spark, SMALL).where("predicted = 1").collect()}
    assert set(texts[0]) == scored

    def shingles(text):
        words = text.translate({k: k + 32 for k in range(65, 91)}).split()
        return {tuple(words[k: k + 5]) for k in range(max(len(words) - 4, 1))} if words else set()

    # of each group linked at 0.8 the least id stays
    sets = {i: shingles(t) for i, t in texts[0].items()}
    links = {i: [j for j in sets if j != i and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])] for i in sets}
    least = {}
    for i in sorted(sets):
        todo = [i] if i not in least else []
        while todo:
            k = todo.pop()
            if k not in least:
                least[k] = i
                todo += links[k]
    assert set(texts[1]) == {i for i in sets if least[i] == i}
    hit = {r.doc_id for r in queries.op1_decontaminate(spark, SMALL).where("contaminated").collect()}
    assert set(texts[2]) == set(texts[1]) - hit
    assert set(texts[3]) == set(texts[2])
    spans = {r.doc_id: r.spans for r in queries.op6_secrets(spark, SMALL).collect()}
    assert all((texts[2][i] == texts[3][i]) == (not spans[i]) for i in texts[2])
