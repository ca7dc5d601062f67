"""URL filter: explicit rules first, then the reputation of hosts by empirical Bayes.

Labelled outcomes of pages are counted per host, registered domain, suffix and in all. A group gets a beta prior from the
group above it. Its mean is what the other members of that group show, so that no page speaks twice; its strength in
pages is estimated from the spread of the rates at this level (moments of the beta-binomial distribution), but never
exceeds the pages that the mean rests on: where groups do not differ beyond chance, the prior weighs as much as its own
evidence and no more. A host with few pages is thus shrunk to its domain, a domain to its suffix, a suffix to the whole.

A page is blocked where even the lower bound of its host's posterior is above the limit, so that a host is blocked on
evidence, not on doubt. The limit is the rate of the whole where that is higher, up to ``MOSTLY``: where bad pages are common
and spread evenly, no host stands out and none is blocked.

The registered domain is the last two labels of a host, the suffix the last one; with ``long_suffixes`` (co.uk, ...) one
label more each.

Defined cases: a url without :// or a null one has an empty host and path, fits no rule, and is judged as the host ""
is; a host without labelled pages takes its domain's prior; without any labelled page all is allowed; repeated pages
are each judged; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.shared import ascii_lower, written

#: a page is blocked from this lower bound of the share of bad pages on
LIMIT = 0.05
#: standard deviations below the posterior mean: about a 5 % bound
DEVIATIONS = 1.645
#: the limit never rises above this share, however bad the whole is
MOSTLY = 0.5
#: pages that a prior is worth at least
WEAKEST = 1.0


@dataclass(frozen=True)
class UrlRule:
    """Allows or blocks the urls on ``host`` and its subdomains whose path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: str = "url") -> Column:
    """Between the first :// and the next / ? # or the end, A-Z lower-cased."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: str = "url") -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(rules: tuple[UrlRule, ...], host: str = "host", path: str = "path") -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, null without one; of equal lengths the longer host's."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.text), len(r.host), r.text)):
        fits = ((F.col(host) == rule.host) | F.endswith(F.col(host), F.lit("." + rule.host))) & F.startswith(F.col(path), F.lit(rule.path))
        text, verdict = F.when(fits, F.lit(rule.text)).otherwise(text), F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return text, verdict


def domain_of(host: Column, long_suffixes: tuple[str, ...] = ()) -> Column:
    last = F.substring_index(host, ".", -2)
    return F.when(last.isin(list(long_suffixes)), F.substring_index(host, ".", -3)).otherwise(last) if long_suffixes else last


def suffix_of(host: Column, long_suffixes: tuple[str, ...] = ()) -> Column:
    last = F.substring_index(host, ".", -2)
    return F.when(last.isin(list(long_suffixes)), last).otherwise(F.substring_index(host, ".", -1)) if long_suffixes else F.substring_index(host, ".", -1)


def _strength(n: int, bad: int, k: int, nn: float, bb: float) -> float:
    """Pages that a prior is worth, from the spread of the groups' rates: few where they differ much, no end where by chance only."""
    if not n or k < 2 or not 0 < bad < n:
        return math.inf
    rate = bad / n
    spread = (bb - n * rate * rate) / (rate * (1 - rate))
    free = n - nn / n - (k - 1)
    within = (spread - (k - 1)) / free if free > 0 else 0.0
    return math.inf if within <= 0 else max((1 - within) / within, WEAKEST)


def _level(counts: DataFrame, name: str) -> DataFrame:
    return counts.where("n > 0").groupBy(F.lit(name).alias("level")).agg(
        F.sum("n").alias("n"),
        F.sum("bad").alias("bad"),
        F.count("*").alias("k"),
        F.sum(F.col("n").cast("double") * F.col("n")).alias("nn"),
        F.sum(F.col("bad").cast("double") * F.col("bad") / F.col("n")).alias("bb"),
    )


def _with_prior(groups: DataFrame, above: DataFrame, key: str, strength: float) -> DataFrame:
    """``groups`` with the mean and strength of their priors; ``above`` has n_up, bad_up, mean_up and pages_up per ``key``."""
    rest = F.col("n_up") - F.col("n") + F.col("pages_up")
    joined = groups.join(above, key)
    mean = (F.col("bad_up") - F.col("bad") + F.col("pages_up") * F.col("mean_up")) / rest
    return joined.select(*groups.columns, mean.alias("mean"), F.least(F.lit(strength), rest).alias("pages"))


def reputation(pages: DataFrame, long_suffixes: tuple[str, ...] = ()) -> tuple[DataFrame, float]:
    """Per host of ``pages`` (host, bad: 1, 0 or null without a label): labelled pages, posterior mean and lower bound; and the rate of the whole.

    Pages are read once: counts of hosts are written, and all levels build on them. Four rows at most come to the driver.
    """
    host = F.col("host")
    counted = pages.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    hosts = written(counted.withColumns({"domain": domain_of(host, long_suffixes), "suffix": suffix_of(host, long_suffixes)}), "hosts")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    levels = _level(hosts, "host").unionByName(_level(domains, "domain")).unionByName(_level(suffixes, "suffix"))
    found = {r.level: r for r in levels.collect()}
    whole = found.get("host")
    rate = whole.bad / whole.n if whole else 0.0
    strengths = {name: _strength(found[name].n, found[name].bad, found[name].k, found[name].nn, found[name].bb) if whole else math.inf for name in ("host", "domain", "suffix")}
    # the whole is known by its rate alone, which weighs as one page
    n_all, bad_all = (whole.n, whole.bad) if whole else (0, 0)
    rest = F.lit(n_all) - F.col("n") + WEAKEST
    suffix_prior = suffixes.select(
        "suffix", "n", "bad", ((F.lit(bad_all) - F.col("bad") + WEAKEST * rate) / rest).alias("mean"), F.least(F.lit(strengths["suffix"]), rest).alias("pages")
    )
    up = [F.col("n").alias("n_up"), F.col("bad").alias("bad_up"), F.col("mean").alias("mean_up"), F.col("pages").alias("pages_up")]
    domain_prior = _with_prior(domains, suffix_prior.select("suffix", *up), "suffix", strengths["domain"])
    host_prior = _with_prior(hosts, domain_prior.select("domain", *up), "domain", strengths["host"])
    bad = F.col("bad") + F.col("pages") * F.col("mean")
    good = F.col("n") - F.col("bad") + F.col("pages") * (1 - F.col("mean"))
    total, mean = good + bad, bad / (good + bad)
    bound = F.greatest(F.lit(0.0), mean - DEVIATIONS * F.sqrt(F.greatest(good * bad, F.lit(0.0)) / (total * total * (total + 1))))
    return host_prior.select("host", "n", mean.alias("mean"), bound.alias("bound")), rate


def judge_urls(pages: DataFrame, rules: tuple[UrlRule, ...], bad: Column, id_col: str = "page_id", url_col: str = "url", limit: float = LIMIT) -> DataFrame:
    """Per page: id, host, path, rule and verdict; ``bad`` labels pages (1, 0, or null where there is no label)."""
    read = pages.select(F.col(id_col), host_of(url_col).alias("host"), path_of(url_col).alias("path"), bad.cast("long").alias("bad"))
    hosts, rate = reputation(read.select("host", "bad"))
    known = hosts.select("host", (F.col("bound") > max(limit, min(rate, MOSTLY))).alias("blocked"))
    rule, verdict = fitting_rule(rules)
    judged = F.coalesce(verdict, F.when(F.col("blocked"), "block").otherwise("allow"))
    return read.join(known, "host", "left").select(id_col, "host", "path", rule.alias("rule"), judged.alias("verdict"))
