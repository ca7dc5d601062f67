"""One query per operator over the whole given tables, with production parameters, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import lm
from tideline.llm.bytebpe import round_trip
from tideline.llm.decontaminate import decontaminate
from tideline.llm.infill import fill_in_middle
from tideline.llm.neardup import near_duplicates
from tideline.llm.quality import quality
from tideline.llm.repeats import remove_repeats
from tideline.llm.rules import fit_rules, judge
from tideline.llm.secrets import scan_secrets
from tideline.llm.shared import fold, table
from tideline.llm.superkmers import drop_repeated_windows
from tideline.llm.tokens import count_tokens
from tideline.llm.turns import repair
from tideline.llm.urls import UrlRule, judge_urls

TOKEN_LIMIT = 4096


def op1_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP1_SQL = r"""
WITH doc AS (
  SELECT row_number() OVER () AS uid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
item AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL),
win AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS s
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM item WHERE len(w) > 0)),
size_of AS (SELECT DISTINCT n FROM win),
spot AS (
  SELECT uid, n, i, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM (SELECT uid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc, size_of WHERE len(w) >= n)),
hit AS (SELECT uid, i, spot.n, item FROM spot JOIN win USING (s) WHERE spot.n = win.n),
hit_words AS (SELECT uid, count(DISTINCT k) AS n_hit FROM (SELECT uid, unnest(range(i, i + n)) AS k FROM hit) GROUP BY uid),
hit_items AS (SELECT uid, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY uid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN hit_words USING (uid) LEFT JOIN hit_items USING (uid)
"""


def op2_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "labels")
    return quality(docs, labels).select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", "predicted")


def op3_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "labels")
    found = judge(docs, fit_rules(docs, labels))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


#: fixed values: the url rules
URL_RULES = (
    UrlRule("allow", "com", "/"),
    UrlRule("block", "example.com", "/en/"),
    UrlRule("allow", "www.example.com", "/en/"),
    UrlRule("block", "net", "/es/"),
    UrlRule("block", "net", "/fr/"),
)
#: a page is labelled bad if its markup holds at least so many runs of symbols
SYMBOL_RUNS = r"[#%*$]{3}|&&&|&amp;&amp;&amp;"
BAD_RUNS = 5


def op4_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    bad = F.when(F.col("html").isNotNull(), (F.regexp_count("html", F.lit(SYMBOL_RUNS)) >= BAD_RUNS).cast("int"))
    return judge_urls(table(spark, folder, "pages"), URL_RULES, bad)


OP4_SQL = r"""
WITH page AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
         CASE WHEN html IS NOT NULL THEN CAST(len(regexp_extract_all(html, '[#%*$]{3}|&&&|&amp;&amp;&amp;')) >= 5 AS INTEGER) END AS bad
  FROM pages),
rule (verdict, host, path) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
ruled AS (
  SELECT p.host, p.path, arg_max(r.host || r.path, (length(r.host || r.path), length(r.host))) AS rule, arg_max(r.verdict, (length(r.host || r.path), length(r.host))) AS verdict
  FROM (SELECT DISTINCT host, path FROM page) p JOIN rule r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
  GROUP BY ALL),
host AS (
  SELECT host, array_to_string(string_split(host, '.')[-2:], '.') AS domain, string_split(host, '.')[-1] AS suffix,
         count(bad) AS n, coalesce(sum(bad), 0) AS bad FROM page GROUP BY ALL),
domain AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM host GROUP BY ALL),
suffix AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domain GROUP BY ALL),
whole AS (SELECT n, bad, CASE WHEN n > 0 THEN bad / n ELSE 0 END AS r FROM (SELECT CAST(coalesce(sum(n), 0) AS DOUBLE) AS n, CAST(coalesce(sum(bad), 0) AS DOUBLE) AS bad FROM host)),
-- mean squared distance of the rates from the rate of the whole, in units of a single page's variance
apart AS (
  SELECT level, sum(g.n * pow(CAST(g.bad AS DOUBLE) / g.n - r, 2)) / nullif(any_value(r * (1 - r)), 0) AS spread, count(*) - 1 AS k,
         any_value(w.n) - sum(CAST(g.n AS DOUBLE) * g.n) / any_value(w.n) - (count(*) - 1) AS free
  FROM (SELECT 'host' AS level, n, bad FROM host UNION ALL SELECT 'domain', n, bad FROM domain UNION ALL SELECT 'suffix', n, bad FROM suffix) g, whole w
  WHERE g.n > 0 GROUP BY level),
worth AS (SELECT level, CASE WHEN k > 0 AND free > 0 AND spread > k THEN greatest(free / (spread - k) - 1, 1.0) END AS m FROM apart),
p_suffix AS (SELECT s.suffix, s.n, s.bad, (w.bad - s.bad + w.r) / (w.n - s.n + 1) AS mean, least(w.n - s.n + 1, (SELECT m FROM worth WHERE level = 'suffix')) AS pages FROM suffix s, whole w),
p_domain AS (SELECT d.domain, d.n, d.bad, (s.bad - d.bad + s.pages * s.mean) / (s.n - d.n + s.pages) AS mean, least(s.n - d.n + s.pages, (SELECT m FROM worth WHERE level = 'domain')) AS pages
             FROM domain d JOIN p_suffix s USING (suffix)),
p_host AS (SELECT h.host, h.n, h.bad, (d.bad - h.bad + d.pages * d.mean) / (d.n - h.n + d.pages) AS mean, least(d.n - h.n + d.pages, (SELECT m FROM worth WHERE level = 'host')) AS pages
           FROM host h JOIN p_domain d USING (domain)),
posterior AS (SELECT host, (bad + pages * mean) / (n + pages) AS q, n + pages AS weight FROM p_host),
judged AS (SELECT host, q - 1.645 * sqrt(greatest(q * (1 - q), 0) / (weight + 1)) > (SELECT greatest(0.05, least(r, 0.5)) FROM whole) AS blocked FROM posterior)
SELECT page_id, p.host, p.path, r.rule, coalesce(r.verdict, CASE WHEN blocked THEN 'block' ELSE 'allow' END) AS verdict
FROM page p LEFT JOIN ruled r ON p.host = r.host AND p.path = r.path LEFT JOIN judged j ON p.host = j.host
"""


def op5_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    counted = count_tokens(table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op6_secrets(spark: SparkSession, folder: str) -> DataFrame:
    found = scan_secrets(table(spark, folder, "documents"))
    return found.select(
        "doc_id",
        "n_assign",
        "n_access",
        "n_hex",
        F.sha2(F.array_join("base_spans", ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join("spans", ",").alias("spans"),
    )


OP6_SQL = r"""
WITH doc AS (SELECT row_number() OVER () AS uid, doc_id, coalesce(text, '') AS text FROM documents),
rule (place, kind, least, grp, pattern) AS (VALUES
  (0, 'assign', 6, 2, '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)'),
  (1, 'access', 20, 0, '(AKIA[A-Z0-9]+)'),
  (2, 'hex', 24, 0, '([0-9a-f]+)'),
  (3, 'private_key', 0, 0, '(-----BEGIN [A-Z ]*PRIVATE KEY-----)'),
  (4, 'github', 0, 0, '(gh[pousr]_[A-Za-z0-9]{36,})'),
  (5, 'slack', 0, 0, '(xox[abprs]-[A-Za-z0-9-]{10,})'),
  (6, 'web_token', 0, 0, '(eyJ[A-Za-z0-9_-]{8,}[.]eyJ[A-Za-z0-9_-]{8,}[.][A-Za-z0-9_-]{8,})'),
  (7, 'google', 0, 0, '(AIza[A-Za-z0-9_-]{35})')),
found AS (
  SELECT uid, place, kind, least, generate_subscripts(whole, 1) AS n, unnest(list_slice(pieces, 1, len(whole))) AS piece, unnest(whole) AS hit, unnest(part) AS part
  FROM (SELECT uid, place, kind, least, regexp_extract_all(text, pattern, 0) AS whole, regexp_extract_all(text, pattern, grp) AS part,
               string_split_regex(text, pattern) AS pieces
        FROM doc, rule)),
placed AS (SELECT *, sum(length(piece) + length(hit)) OVER (PARTITION BY uid, place ORDER BY n) AS stop FROM found),
span AS (SELECT uid, place, kind, CAST(stop - length(hit) AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop FROM placed WHERE length(part) >= least),
per_doc AS (
  SELECT uid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, place) FILTER (place < 3) AS base,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, place) AS spans
  FROM span GROUP BY uid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM doc LEFT JOIN per_doc USING (uid)
"""


def op7_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return round_trip(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"))


def op9_suffix_repeats(spark: SparkSession, folder: str) -> DataFrame:
    return remove_repeats(table(spark, folder, "documents"))


def op10_lm_scores(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    held_out = fold("doc_id", 10) == 0
    return lm.score(docs, *lm.fit(docs.where(~held_out))).withColumn("held_out", held_out)


def op11_superkmers(spark: SparkSession, folder: str) -> DataFrame:
    return drop_repeated_windows(table(spark, folder, "documents"))


OP11_SQL = r"""
WITH doc AS (
  SELECT row_number() OVER () AS uid, doc_id, coalesce(doc_id, 9223372036854775807) AS own, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
win AS (SELECT uid, own, i, array_to_string(w[i:i + 12], ' ') AS s FROM (SELECT uid, own, w, unnest(range(1, len(w) - 11)) AS i FROM doc WHERE len(w) >= 13)),
low AS (SELECT s, min(own) AS low FROM win GROUP BY s HAVING min(own) < max(own)),
gone AS (SELECT DISTINCT uid, unnest(range(i, i + 13)) AS k FROM win JOIN low USING (s) WHERE own > low),
per_doc AS (SELECT uid, list(k) AS ks FROM gone GROUP BY uid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(ks), 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(list_filter(w, lambda x, i: NOT list_contains(coalesce(ks, []), i)), ' ')) AS kept_sha256
FROM doc LEFT JOIN per_doc USING (uid)
"""


def op12_infill(spark: SparkSession, folder: str) -> DataFrame:
    return fill_in_middle(table(spark, folder, "documents"))


OP12_SQL = r"""
WITH doc AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
unit AS (
  SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS u, len(regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]')) AS n,
         CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4
  FROM doc),
cut AS (
  SELECT doc_id, text, n, array_to_string(u[1:least(h1 % (n + 1), h2 % (n + 1))], '') AS p, array_to_string(u[least(h1 % (n + 1), h2 % (n + 1)) + 1:greatest(h1 % (n + 1), h2 % (n + 1))], '') AS m,
         array_to_string(u[greatest(h1 % (n + 1), h2 % (n + 1)) + 1:], '') AS s,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM unit)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256
FROM cut
"""


def damaged(turns: DataFrame) -> DataFrame:
    """The turns as the contract damages them; nulls other than of ids and turns become one blank."""
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.crc32(name.cast("binary")) % 20).alias("damage")).where("damage <> 0")
    text = F.when(F.col("damage") == 1, "").when(F.col("damage") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("damage") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("damage") == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), times)).alias("copy")).drop("copy")


def op13_repair_turns(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations")
    found = repair(damaged(turns)).withColumnRenamed("conv_id", "conv")
    every = turns.select("conv_id").distinct()
    out = every.join(found, every["conv_id"].eqNullSafe(found["conv"]), "left").drop("conv")
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    return out.na.fill(0, ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]).na.fill("", ["audit"]).withColumn("repaired_sha256", F.coalesce("repaired_sha256", nothing))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_quality": op2_quality,
    "op3_quality_rules": op3_quality_rules,
    "op4_url_filter": op4_url_filter,
    "op5_token_counts": op5_token_counts,
    "op6_secrets": op6_secrets,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_near_duplicates": op8_near_duplicates,
    "op9_suffix_repeats": op9_suffix_repeats,
    "op10_lm_scores": op10_lm_scores,
    "op11_superkmers": op11_superkmers,
    "op12_infill": op12_infill,
    "op13_repair_turns": op13_repair_turns,
}

ORACLES: dict[str, str] = {
    "op1_decontaminate": OP1_SQL,
    "op4_url_filter": OP4_SQL,
    "op6_secrets": OP6_SQL,
    "op11_superkmers": OP11_SQL,
    "op12_infill": OP12_SQL,
}
