"""URL parts, rules and host reputation; the query itself is compared with its SQL."""

import pytest
from pyspark.sql import functions as F

from tideline.llm.queries import URL_RULES
from tideline.llm.urls import host_of, judge_urls, path_of, reputation


def test_parts_of_urls(spark):
    cases = {
        "http://A.Example.com/En/x?q#f": ("a.example.com", "/En/x"),
        "https://h": ("h", ""),
        "https://h?x=/y": ("h", ""),
        "https://h#/y": ("h", ""),
        "a://b://c/d": ("b:", "//c/d"),
        "no scheme/x": ("", ""),
        "x\n://h/p\nq?": ("h", "/p\nq"),
        "": ("", ""),
    }
    rows = spark.createDataFrame([(u,) for u in cases] + [(None,)], "url string").select("url", host_of().alias("h"), path_of().alias("p")).collect()
    assert {r.url: (r.h, r.p) for r in rows} == cases | {None: ("", "")}


def test_longest_rule_wins(spark):
    cases = {
        "http://x.com/": ("com/", "allow"),
        "http://com/a": ("com/", "allow"),
        "http://xcom/a": (None, "allow"),
        "http://a.example.com/en/1": ("example.com/en/", "block"),
        "http://notexample.com/en/1": ("com/", "allow"),
        "http://www.example.com/en/1": ("www.example.com/en/", "allow"),
        "http://m.www.example.com/en/1": ("www.example.com/en/", "allow"),
        "http://a.net/es/": ("net/es/", "block"),
        "http://a.net/ES/": (None, "allow"),
        "http://a.com": (None, "allow"),
    }
    pages = spark.createDataFrame(list(enumerate(cases)), "page_id long, url string")
    rows = judge_urls(pages, URL_RULES, F.lit(None)).collect()
    urls = list(cases)
    assert {urls[r.page_id]: (r.rule, r.verdict) for r in rows} == cases


def test_hosts_shrink_to_their_domain(spark):
    rows = [("bad.one.org", 1)] * 200 + [("good.one.org", 0)] * 200 + [("few.bad.info", 1)] + [("many.bad.info", 1)] * 300 + [("few.good.info", 1)] + [("many.good.info", 0)] * 300
    rows += [("new.bad.info", None), ("new.good.info", None), ("", None)]
    found = {r.host: r for r in reputation(spark.createDataFrame(rows, "host string, bad int"))[0].collect()}
    assert found["bad.one.org"].bound > 0.9 > 0.1 > found["good.one.org"].mean
    assert found["few.bad.info"].mean > found["few.good.info"].mean
    assert found["new.bad.info"].n == 0 and found["new.bad.info"].mean > found["new.good.info"].mean
    assert all(0 <= r.bound <= r.mean <= 1 for r in found.values())


def test_one_bad_page_does_not_block_a_host(spark):
    rows = [(k, f"http://h{k % 40}.org/", 0) for k in range(800)] + [(900, "http://h0.org/", 1)] + [(1000 + k, "http://farm.xyz/", 1) for k in range(60)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, bad int, host string")
    verdicts = {r.page_id: r.verdict for r in judge_urls(pages, (), F.col("bad"), limit=0.3).collect()}
    assert verdicts[0] == verdicts[900] == "allow" and verdicts[1000] == "block"


@pytest.mark.parametrize("bad", [2, 3, 4, 20, 39])
def test_hosts_of_one_rate_are_not_blocked(spark, bad):
    """40 hosts of 40 pages each, all at one rate: just below 5 %, at 5 % and above; and one host that is bad throughout."""
    rows = [(100 * h + k, f"http://h{h}.d{h % 8}.org/", int(k < bad)) for h in range(40) for k in range(40)]
    even = spark.createDataFrame(rows, "page_id long, url string, bad int")
    clean = spark.createDataFrame([(5000 + k, "http://clean.org/", 0) for k in range(13)], even.schema)
    verdicts = {r.page_id: r.verdict for r in judge_urls(even.unionByName(clean), (), F.col("bad")).collect()}
    assert all(verdicts[5000 + k] == "allow" for k in range(13))
    if bad <= 20:
        assert set(verdicts.values()) == {"allow"}
        farm = spark.createDataFrame([(9000 + k, "http://farm.org/", 1) for k in range(60)], even.schema)
        verdicts = {r.page_id: r.verdict for r in judge_urls(even.unionByName(farm), (), F.col("bad")).collect()}
        assert {v for p, v in verdicts.items() if p >= 9000} == {"block"} and {v for p, v in verdicts.items() if p < 9000} == {"allow"}
    else:
        assert {v for p, v in verdicts.items() if p < 5000} == {"block"}


def test_prior_rests_on_the_other_hosts(spark):
    """A domain of one host lends it nothing of its own; a host without own bad pages falls with a bad domain only where it has little to say."""
    rows = [("a.bad.org", 1)] * 50 + [("b.bad.org", 1)] * 50 + [("c.bad.org", 0)] * 100 + [("alone.org", 1)] * 2 + [(f"x{k}.ok.net", 0) for k in range(300)]
    found = {r.host: r for r in reputation(spark.createDataFrame(rows, "host string, bad int"))[0].collect()}
    assert found["a.bad.org"].bound > 0.8 and found["c.bad.org"].bound < 0.1
    assert found["alone.org"].mean > found["x0.ok.net"].mean and found["alone.org"].bound < found["a.bad.org"].bound


def test_empty_null_and_repeated_pages(spark):
    pages = spark.createDataFrame([(1, None), (None, "http://a.com/x"), (None, "http://a.com/x")], "page_id long, url string")
    rows = judge_urls(pages, URL_RULES, F.lit(None)).collect()
    assert sorted((r.host, r.path, r.rule or "", r.verdict) for r in rows) == [("", "", "", "allow"), ("a.com", "/x", "com/", "allow"), ("a.com", "/x", "com/", "allow")]
    assert judge_urls(pages.where("page_id > 9"), URL_RULES, F.lit(1)).collect() == []


def test_two_part_suffixes(spark):
    rows = spark.createDataFrame([("a.b.co.uk", 1), ("c.b.co.uk", 0), ("a.d.co.uk", 0)], "host string, bad int")
    assert reputation(rows, ("co.uk",))[0].count() == 3
