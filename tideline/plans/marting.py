"""Queries over the daily marts and the checks on them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.operators import facts, labeling, marts, quality
from tideline.plans.catalog import query
from tideline.plans.loading import STATIC_KEY

# --- review marts ---------------------------------------------------------------------------

LANGUAGES = "SELECT DISTINCT ascii(l_linestatus) AS language_sk, l_linestatus AS language_code FROM lineitem"
FACTS = """SELECT * EXCLUDE (k) FROM (
    SELECT r.*, coalesce(g.game_sk, -1) AS game_sk, ascii(r.language_code) AS language_sk,
           row_number() OVER (PARTITION BY r.recommendation_id ORDER BY r.fetched_at DESC, r.raw_id DESC) AS k
    FROM p_review r LEFT JOIN p_game g ON g.app_id = r.app_id AND r.created_at >= g.valid_from AND r.created_at < g.valid_to) WHERE k = 1"""
FLAT = f"""SELECT g.app_id, f.recommendation_id AS review_id, f.created_at, f.is_voted_up AS voted_up, l.language_code, CAST(f.created_at AS DATE) AS created_date
    FROM ({FACTS}) f JOIN p_game g USING (game_sk) JOIN ({LANGUAGES}) l USING (language_sk) WHERE g.app_id > 0"""


def core_languages(t):
    return t.table("lineitem").select(
        F.ascii("l_linestatus").alias("language_sk"), F.col("l_linestatus").alias("language_code")).distinct()


def core_facts(t):
    """The whole load: newest copy of each review, version of its day, language key."""
    newest = facts.latest_per_key(t.reviews, ["recommendation_id"], [F.desc("fetched_at"), F.desc("raw_id")])
    return facts.scd2_lookup(newest, t.games, "created_at").withColumn("language_sk", F.ascii("language_code"))


def core_flat(t):
    return marts.review_flat(core_facts(t), t.games, core_languages(t))


@query("review_flat", "p_review", "p_game", sql=FLAT)
def _(t):
    return core_flat(t).withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))


@query("review_daily", "p_review", "p_game", sql=f"""
    SELECT app_id, created_date AS "day", count(*) AS review_count, count(*) FILTER (WHERE voted_up) AS positive_count FROM ({FLAT}) GROUP BY 1, 2""")
def _(t):
    return marts.review_daily(core_flat(t))


@query("data_bounds", "p_flat", sql="SELECT app_id, min(created_at) AS data_from, max(created_at) AS data_to FROM p_flat GROUP BY 1")
def _(t):
    bounds = marts.data_bounds(t.flat)
    return bounds.select("app_id", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("data_from", "data_to")])


RATIO = """SELECT '{name}' AS table_name, count(*) FILTER (WHERE game_sk = -1)::DOUBLE / count(*) AS ratio FROM {rows}"""
RATIOS = RATIO.format(name="reviews", rows=f"({FACTS})") + " UNION ALL " + RATIO.format(name="patches", rows="p_patch")


def ratios(t):
    return marts.unknown_ratio(reviews=core_facts(t).select("game_sk"), patches=t.patches.select("game_sk"))


@query("unknown_member_ratio", "p_review", "p_game", "p_patch", sql=RATIOS)
def _(t):
    return ratios(t)


@query("dq_unknown_ratio", "p_review", "p_game", "p_patch", sql=f"SELECT * FROM ({RATIOS}) WHERE ratio > 0.03")
def _(t):
    return quality.dq_unknown_ratio(ratios(t), 0.03)


@query("union_marts", "p_daily", "t_den", sql="""
    SELECT 'review_daily' AS mart, app_id, day, review_count AS n FROM p_daily UNION ALL SELECT 'review_labeling_daily', app_id, day, review_count FROM t_den""")
def _(t):
    return marts.union_marts(
        t.daily.select(F.lit("review_daily").alias("mart"), "app_id", "day", F.col("review_count").alias("n")),
        t.t_den.select(F.lit("review_labeling_daily").alias("mart"), "app_id", "day", F.col("review_count").alias("n")))


@query("full_outer_reconcile", "p_daily", "t_review", sql="""
    SELECT coalesce(a.app_id, b.app_id) AS app_id, coalesce(a.day, b.day) AS "day", a.review_count AS expected, b.review_count AS found
    FROM p_daily a FULL JOIN (SELECT app_id, day, count(*) AS review_count FROM t_review GROUP BY 1, 2) b ON a.app_id = b.app_id AND a.day = b.day
    WHERE a.review_count IS DISTINCT FROM b.review_count""")
def _(t):
    other = t.t_review.groupBy("app_id", "day").agg(F.count("*").alias("review_count"))
    return marts.reconcile(t.daily, other, ["app_id", "day"], "review_count")


# --- labelled marts -------------------------------------------------------------------------


def configs(t):
    """Labeler configurations: one per customer, of five models."""
    return t.table("customer").select(
        F.col("c_custkey").alias("llm_config_sk"), F.concat(F.lit("model-"), (F.col("c_nationkey") % 5).cast("string")).alias("model"),
        F.md5("c_name").alias("prompt_hash"), F.col("c_mktsegment").alias("params"))


CONFIGS = "SELECT c_custkey AS llm_config_sk, concat('model-', CAST(c_nationkey % 5 AS VARCHAR)) AS model, md5(c_name) AS prompt_hash, c_mktsegment AS params FROM customer"


@query("active_label_config", sql=f"SELECT * FROM ({CONFIGS}) WHERE model = 'model-2' AND prompt_hash LIKE 'a%'")
def _(t):
    return marts.active_config(configs(t), "model-2", "a")


@query("dq_one_active_config", sql=f"SELECT count(*) AS n FROM ({CONFIGS}) WHERE model = 'model-2' AND prompt_hash LIKE 'a%' HAVING count(*) <> 1")
def _(t):
    return quality.dq_one_row(marts.active_config(configs(t), "model-2", "a"))


@query("content_by_day", "t_review", sql="SELECT app_id, day, count(*) AS content FROM t_review WHERE is_content GROUP BY 1, 2")
def _(t):
    return marts.content_by_day(t.t_review)


@query("review_labeled", "t_labeled", sql="SELECT * FROM t_labeled")
def _(t):
    return t.t_labeled


@query("config_day_grid", "t_den", sql="SELECT app_id, day, llm_config_sk, labeled_count FROM t_den")
def _(t):
    days = t.t_review.select("app_id", "day").distinct()
    return marts.config_day_grid(days, t.t_labeled).select("app_id", "day", "llm_config_sk", "labeled_count")


@query("review_labeling_daily", "t_den", sql="SELECT * FROM t_den")
def _(t):
    return t.t_den


@query("review_tags", "t_tags", sql="SELECT * FROM t_tags")
def _(t):
    return t.t_tags


@query("fold_sentiment", "t_tag", sql="""SELECT labeling_sk, CASE WHEN min(sentiment) = max(sentiment) THEN min(sentiment) ELSE '±' END AS sentiment FROM t_tag GROUP BY 1""")
def _(t):
    return t.t_tag.groupBy("labeling_sk").agg(marts.fold_sentiment().alias("sentiment"))


@query("aspects_per_review", "t_tags", sql="SELECT labeling_sk, count(*) AS review_aspects FROM t_tags GROUP BY 1")
def _(t):
    return marts.aspects_per_review(t.t_tags)


@query("review_aspect_tag", "t_aspect_tag", sql="SELECT * FROM t_aspect_tag")
def _(t):
    return t.t_aspect_tag


@query("review_aspect_daily", "t_aspect_daily", sql="SELECT * FROM t_aspect_daily")
def _(t):
    return t.t_aspect_daily


@query("review_category_daily", "t_category_daily", sql="SELECT * FROM t_category_daily")
def _(t):
    return t.t_category_daily


# --- checks ---------------------------------------------------------------------------------
# the tables as given hold offences for most rules, so the checks have something to report


@query("dq_unique", sql="SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def _(t):
    return quality.dq_unique(t.table("lineitem"), ["l_orderkey", "l_linenumber"])


@query("dq_not_null", "p_patch", sql="SELECT patch_sk, 'feedname' AS missing FROM p_patch WHERE feedname IS NULL")
def _(t):
    return quality.dq_not_null(t.patches, ["title", "feedname", "published_at"], ["patch_sk"])


SIGN_COLUMNS = "app_id, day, llm_config_sk, {key}, review_count, positive_count, negative_count, mixed_count, day_labeled_count"


@query("dq_sign_counts", "t_aspect_daily", "t_category_daily", sql=f"""
    SELECT {SIGN_COLUMNS.format(key='aspect_id AS key')} FROM t_aspect_daily WHERE positive_count + negative_count <> review_count OR review_count > day_labeled_count
    UNION ALL SELECT {SIGN_COLUMNS.format(key='category_id AS key')} FROM t_category_daily
    WHERE positive_count + negative_count + mixed_count <> review_count OR review_count > day_labeled_count""")
def _(t):
    # aspects are checked with the mixed count blanked out, so that the rule has offences to find
    blanked = t.t_aspect_daily.withColumn("mixed_count", F.lit(0).cast("bigint"))
    found = quality.dq_sign_counts(blanked, "aspect_id").withColumnRenamed("aspect_id", "key").drop("mixed_count")
    real = t.t_aspect_daily.select("app_id", "day", "llm_config_sk", F.col("aspect_id").alias("key"), "mixed_count")
    return found.join(real, ["app_id", "day", "llm_config_sk", "key"]).unionByName(
        quality.dq_sign_counts(t.t_category_daily, "category_id").withColumnRenamed("category_id", "key"))


@query("dq_nested_counts", "t_den", sql="""
    SELECT app_id, day, llm_config_sk, review_count, content_count, labeled_count FROM (
        SELECT app_id, day, llm_config_sk, review_count, content_count, labeled_count * 2 AS labeled_count FROM t_den)
    WHERE NOT (labeled_count <= content_count AND content_count <= review_count)""")
def _(t):
    return quality.dq_nested_counts(t.t_den.withColumn("labeled_count", F.col("labeled_count") * 2))


@query("dq_category_vs_aspects", "t_aspect_daily", "t_category_daily", sql="""
    SELECT coalesce(c.app_id, a.app_id) AS app_id, coalesce(c.day, a.day) AS "day", coalesce(c.llm_config_sk, a.llm_config_sk) AS llm_config_sk,
           coalesce(c.category_id, a.category_id) AS category_id, c.review_count, a.max_aspect, CAST(a.sum_aspects AS BIGINT) AS sum_aspects
    FROM (SELECT app_id, day, llm_config_sk, category_id, review_count + 1 AS review_count FROM t_category_daily) c
    FULL JOIN (SELECT app_id, day, llm_config_sk, category_id, max(review_count) AS max_aspect, sum(review_count) AS sum_aspects
               FROM t_aspect_daily GROUP BY 1, 2, 3, 4) a USING (app_id, day, llm_config_sk, category_id)
    WHERE c.review_count IS NULL OR a.max_aspect IS NULL OR c.review_count < a.max_aspect OR c.review_count > a.sum_aspects""")
def _(t):
    return quality.dq_category_vs_aspects(t.t_category_daily.withColumn("review_count", F.col("review_count") + 1), t.t_aspect_daily)


@query("dq_overall_alone", "t_tags", "t_aspect_daily", "t_category_daily", sql="""
    SELECT coalesce(e.mart, m.mart) AS mart, coalesce(e.app_id, m.app_id) AS app_id, coalesce(e.day, m.day) AS "day",
           coalesce(e.llm_config_sk, m.llm_config_sk) AS llm_config_sk, e.n AS expected, m.n AS found
    FROM (SELECT x.mart, app_id, day, llm_config_sk, count(*) AS n FROM (
              SELECT app_id, day, llm_config_sk, labeling_sk FROM t_tags GROUP BY 1, 2, 3, 4 HAVING count(*) = 1 AND max(aspect_id) = 'overall_impression'),
              (VALUES ('review_aspect_daily'), ('review_category_daily')) AS x(mart) GROUP BY 1, 2, 3, 4) e
    FULL JOIN (SELECT 'review_aspect_daily' AS mart, app_id, day, llm_config_sk, review_count AS n FROM t_aspect_daily WHERE aspect_id = 'overall_impression'
               UNION ALL SELECT 'review_category_daily', app_id, day, llm_config_sk, review_count + 1 FROM t_category_daily WHERE category_id = 'overall') m
      ON e.mart = m.mart AND e.app_id = m.app_id AND e.day = m.day AND e.llm_config_sk = m.llm_config_sk
    WHERE e.n IS DISTINCT FROM m.n""")
def _(t):
    shifted = t.t_category_daily.withColumn("review_count", F.col("review_count") + 1)
    return quality.dq_overall_alone(t.t_tags, t.t_aspect_daily, shifted)


@query("dq_note_only_other", "t_tags", sql="""
    SELECT labeling_sk, importance, aspect_id, note FROM (SELECT * REPLACE (CASE WHEN importance = 2 THEN ' ' ELSE note END AS note) FROM t_tags)
    WHERE (aspect_id = 'other') <> (nullif(trim(note, ' '), '') IS NOT NULL)""")
def _(t):
    return quality.dq_note_only_other(t.t_tags.withColumn("note", F.when(F.col("importance") == 2, " ").otherwise(F.col("note"))))


@query("dq_accepted_values", "t_label", sql="SELECT status, count(*) AS n FROM t_label WHERE status NOT IN ('labeled', 'no_opinion') GROUP BY 1")
def _(t):
    return quality.dq_accepted(t.t_label, "status", ["labeled", "no_opinion"])


@query("dq_foreign_keys", sql="SELECT event_id AS doc_id, count(*) AS n FROM events WHERE event_id NOT IN (SELECT doc_id FROM labels) GROUP BY 1")
def _(t):
    rated = t.table("events").select(F.col("event_id").alias("doc_id"))
    return quality.dq_foreign_key(rated, t.table("labels").select("doc_id"), "doc_id")


@query("dq_aspect_once", "t_tag", sql="""
    SELECT labeling_sk, aspect_sk, coalesce(note, '') AS note, count(*) AS n, count(*) FILTER (WHERE importance NOT BETWEEN 1 AND 5) AS bad_importance
    FROM t_tag GROUP BY 1, 2, 3 HAVING count(*) > 1 OR count(*) FILTER (WHERE importance NOT BETWEEN 1 AND 5) > 0""")
def _(t):
    return quality.dq_aspect_once(t.t_tag)


# --- stored labels, versions, taxonomy ------------------------------------------------------


@query("text_snapshot", "t_version", "t_text", sql="""
    SELECT recommendation_id, text_hash, is_current FROM (
        SELECT v.recommendation_id, v.text_hash, v.text_hash = md5(t.review_body) AS is_current FROM t_version v JOIN t_text t USING (recommendation_id)
        UNION ALL SELECT t.recommendation_id, md5(t.review_body), true FROM t_text t JOIN t_version v USING (recommendation_id) WHERE v.text_hash <> md5(t.review_body))""")
def _(t):
    stamped = t.t_fact.select("recommendation_id", "language_sk", F.col("created_at").alias("valid_from"))
    versions = t.t_version.join(stamped, "recommendation_id").select(
        "review_text_sk", "recommendation_id", "text_hash", "review_body", "language_sk", "valid_from", "is_current")
    texts = t.t_text.join(stamped, "recommendation_id")
    return labeling.text_snapshot(versions, texts).select("recommendation_id", "text_hash", "is_current")


@query("label_upsert", "t_label", sql="""
    SELECT review_text_sk, llm_config_sk, CASE WHEN status = 'failed' OR run_id = 'run-0' THEN 'labeled' ELSE status END AS status,
           CASE WHEN status = 'failed' OR run_id = 'run-0' THEN 'run-new' ELSE run_id END AS run_id FROM t_label""")
def _(t):
    columns = ["review_text_sk", "llm_config_sk", "status", "run_id"]
    # every text is labelled again; the labels of one run were never stored
    stored = t.t_label.filter("run_id <> 'run-0'").select(*columns)
    incoming = t.t_label.withColumn("status", F.lit("labeled")).withColumn("run_id", F.lit("run-new"))
    return labeling.upsert_labels(stored, incoming)


def taxonomy(t, parts=None):
    k = F.col("p_partkey").cast("string")
    return (t.table("part") if parts is None else parts).select(
        F.concat(F.lit("v"), (F.col("p_partkey") % 3).cast("string")).alias("codebook_version"), F.concat(F.lit("a"), k).alias("aspect_id"),
        F.col("p_name").alias("aspect_name"), F.col("p_type").alias("aspect_definition"), F.col("p_brand").alias("category_id"),
        F.col("p_brand").alias("category_name"), F.col("p_brand").alias("category_definition"))


@query("aspect_sync", sql="""
    SELECT concat('v', CAST(p_partkey % 3 AS VARCHAR)) AS codebook_version, concat('a', CAST(p_partkey AS VARCHAR)) AS aspect_id, p_name AS aspect_name,
           CASE WHEN p_size > 25 THEN CAST(p_partkey AS VARCHAR) ELSE {key} END AS aspect_sk
    FROM part""".format(key=STATIC_KEY.format("concat('2:v', CAST(p_partkey % 3 AS VARCHAR), length(CAST(p_partkey AS VARCHAR)) + 1, ':a', CAST(p_partkey AS VARCHAR))")))
def _(t):
    rows = taxonomy(t)
    stored = taxonomy(t, t.table("part").filter("p_size > 25")).withColumn("aspect_sk", F.substring("aspect_id", 2, 20).cast("bigint"))
    return labeling.sync_aspects(stored, rows).select("codebook_version", "aspect_id", "aspect_name", F.col("aspect_sk").cast("string").alias("aspect_sk"))


@query("aspect_conflicts", sql="""
    SELECT concat('v', CAST(p_partkey % 3 AS VARCHAR)) AS codebook_version, concat('a', CAST(p_partkey AS VARCHAR)) AS aspect_id
    FROM part WHERE p_partkey % 3 < 2 AND (p_size = 30 OR p_size > 40)""")
def _(t):
    # the file lacks a version and some aspects of the others; stored names and definitions of some have been changed
    part = t.table("part")
    rows = taxonomy(t, part.filter("p_size <> 30 AND p_partkey % 3 < 2"))
    changed = part.withColumn("p_name", F.expr("CASE WHEN p_size > 45 THEN concat(p_name, '.') ELSE p_name END")).withColumn(
        "p_type", F.expr("CASE WHEN p_size > 45 OR p_size <= 40 THEN p_type END"))
    return labeling.aspect_conflicts(taxonomy(t, changed.filter("p_size > 25")), rows)


@query("config_upsert", sql="""
    SELECT model, prompt_hash, params, min(stored) AS stored FROM (
        SELECT c_mktsegment AS model, sha256(c_name) AS prompt_hash, CAST(c_nationkey AS VARCHAR) AS params, CASE WHEN c_acctbal > 0 THEN 1 ELSE 2 END AS stored FROM customer) GROUP BY 1, 2, 3""")
def _(t):
    base = t.table("customer").select(
        "c_acctbal", F.col("c_custkey").alias("llm_config_sk"), F.col("c_mktsegment").alias("model"), F.lit("closed").alias("prompt_name"),
        F.lit("v1").alias("codebook_version"), F.col("c_name").alias("system_prompt"), F.sha2("c_name", 256).alias("prompt_hash"),
        F.col("c_nationkey").cast("string").alias("params"))
    stored = base.filter("c_acctbal > 0").drop("c_acctbal")
    wanted = base.drop("c_acctbal", "llm_config_sk", "prompt_hash")
    out = labeling.ensure_config(stored, wanted)
    # stored keys are customer numbers, new ones come from a hash and are far larger
    known = F.when(F.col("llm_config_sk") < 10**12, 1).otherwise(2)
    return out.select("model", "prompt_hash", "params", known.cast("int").alias("stored"))
