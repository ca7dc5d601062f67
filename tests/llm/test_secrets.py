"""Secret spans against the same rules in plain Python; the query itself is compared with its SQL."""

import random
import re

import pytest

import corpus_pipeline
from tideline.llm.secrets import ADDED, BASE, RULES, Rule, redact, scan_secrets, spellings, trigram_query


def plain(text, rules=RULES):
    spans = []
    for place, rule in enumerate(rules):
        for m in re.finditer(rule.pattern, text or "", re.ASCII | (re.IGNORECASE if rule.any_case else 0)):
            if len(m[rule.group]) >= rule.least:
                spans.append((m.start(), place, f"{rule.kind}:{m.start()}:{m.end()}"))
    return [label for *_, label in sorted(spans)]


def samples():
    rnd = random.Random(12)
    hexes = "".join(rnd.choice("0123456789abcdef") for _ in range(40))
    parts = [
        'password = "hunter22"', "Api_Key: abcdef123", "APIKEY=short", "secret:token", 'secret:token"=abcdefgh', "toKEN='x=y=zzz", "passwd  =  abc/def+g",
        "AKIA" + "A1" * 9, "AKIAAKIA" + "B" * 14, "AKIA123", hexes, hexes[:23], "z" + hexes + "g", "-----BEGIN RSA PRIVATE KEY-----", "-----BEGIN PRIVATE KEY-----",
        "ghp_" + "a1B2" * 9, "ghx_" + "a1B2" * 9, "xoxb-123456789-abc", "eyJhbGciOiJI.eyJzdWIiOiIx.c2lnbmF0dXJl", "AIza" + "x" * 35, "é日本 ", "plain words here", "\n", "ſecret=abcdefgh", "toKen=abcdefgh",
    ]
    texts = [" ".join(rnd.choice(parts) for _ in range(rnd.randrange(0, 8))) for _ in range(120)] + parts
    return [*texts, None, "", texts[0], texts[0], "token=abcdef1 " * 2000]


def test_spans_equal_plain_matching(spark):
    texts = samples()
    docs = spark.createDataFrame([(k, t, "x", 3) for k, t in enumerate(texts)], "doc_id long, text string, spans string, n_hex int")
    for r in scan_secrets(docs).collect():
        assert r["spans"] == plain(texts[r.doc_id])
        assert r.base_spans == plain(texts[r.doc_id], BASE)
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(s.startswith(kind + ":") for s in r.base_spans) for kind in ("assign", "access", "hex")]


def test_redaction_removes_spans_and_nothing_else(spark):
    texts = samples()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in redact(docs, mark="\u0002").collect():
        body = texts[r.doc_id]
        spans = sorted(tuple(map(int, s.split(":")[1:])) for s in plain(body))
        out, end = [], 0
        for a, b in spans:
            if a > end or (a == 0 and end == 0):
                out += [body[end:a], "\u0002"]
            end = max(end, b)
        assert r.text == (body if not spans else "".join(out) + body[end:])


@pytest.mark.parametrize("rule", RULES, ids=lambda r: r.kind)
def test_every_match_passes_its_query(rule):
    query = trigram_query(rule)
    for text in samples():
        for m in re.finditer(rule.pattern, text or "", re.ASCII | (re.IGNORECASE if rule.any_case else 0)):
            assert query is None or any(all(g in m[0].lower() for g in branch) for branch in query)


def test_queries_of_the_rules():
    assert trigram_query(BASE[2]) is None
    assert trigram_query(BASE[1]) == [("aki", "kia")]
    assert all(trigram_query(r) for r in (BASE[0], *ADDED))
    assert {"".join(way) for way in spellings("ab_?c")} == {"abc", "ab_c"}
    assert trigram_query(Rule("x", "[ab]cd+e")) == [("acd",), ("bcd",)]
    assert trigram_query(Rule("x", "abc|de")) is None


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert scan_secrets(docs).collect() == [] and redact(docs).collect() == []


def test_pipeline_stage_counts_the_new_characters(spark):
    docs = spark.createDataFrame([(1, "my password=abcdefgh ok", "en", "s", 23), (2, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(tuple(r) for r in corpus_pipeline.redact_secrets(spark, docs, "").collect())
    assert got == [(1, "my [secret] ok", "en", "s", 14), (2, None, None, None, None)]
