"""Surrogate keys: no two natural keys share a text, and the width of the digest is kept."""

import hashlib

from pyspark.sql import functions as F

from tideline.functions.numbers import KEY_TYPE, stable_key
from tideline.operators import facts, labeling


def plain(*parts):
    text = "".join("-" if p is None else f"{len(p)}:{p}" for p in parts)
    return int(hashlib.md5(text.encode()).hexdigest()[:30], 16)


def test_nulls_and_separators_inside_values(spark):
    pairs = [(None, "a"), ("a", None), ("", "a"), ("a", ""), (None, None), ("", ""), ("-", ""), ("a|b", "c"), ("a", "b|c"), ("1:a", "b"), ("a", "1:b"), ("a1:b", ""), ("é", "ü"), ("0:", None)]
    rows = spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "k int, a string, b string").select("k", stable_key(F.col("a"), F.col("b")).alias("sk"))
    assert dict(rows.dtypes)["sk"] == KEY_TYPE
    got = {r.k: int(r.sk) for r in rows.collect()}
    assert got == {k: plain(*p) for k, p in enumerate(pairs)}
    assert len(set(got.values())) == len(pairs)


def test_keys_are_wider_than_a_long(spark):
    keys = [int(r.sk) for r in spark.range(2000).select(stable_key(F.col("id")).alias("sk")).collect()]
    assert len(set(keys)) == 2000 and max(keys) >> 119 == 1 and len({k & (1 << 60) - 1 for k in keys}) == len({k >> 60 for k in keys}) == 2000


def test_stored_keys_stay_and_new_ones_widen(spark):
    stored = spark.createDataFrame([(3, "english")], "language_sk int, language_code string")
    seen = spark.createDataFrame([("english",), ("a|b",), (None,), ("",)], "language_code string")
    once = facts.upsert_languages(stored, seen)
    got = {r.language_code: int(r.language_sk) for r in once.collect()}
    assert got == {"english": 3, "a|b": plain("language", "a|b")}
    assert {r.language_code: int(r.language_sk) for r in facts.upsert_languages(once, seen).collect()} == got


def test_configurations_with_absent_parameters_differ(spark):
    schema = "llm_config_sk decimal(38,0), model string, system_prompt string, prompt_hash string, params string"
    wanted = spark.createDataFrame([("m", "p", None), ("m", "p", ""), ("m|", "p", "x"), ("m", "p", "|x")], "model string, system_prompt string, params string")
    out = labeling.ensure_config(spark.createDataFrame([], schema), wanted).collect()
    assert len({r.llm_config_sk for r in out}) == 4
