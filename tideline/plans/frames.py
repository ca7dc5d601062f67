"""Star-schema frames derived from the given tables, and the same derivations as SQL.

This is the only place that knows the driver's tables. ``Frames`` gives DataFrames, ``CTE`` gives the
matching common table expressions for the SQL oracle. Every frame covers its whole table.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.session import settle, written

SCHEMAS = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, o_orderdate TIMESTAMP, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, l_extendedprice DOUBLE, "
                "l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING, l_shipdate TIMESTAMP",
    "events": "event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
    "labels": "doc_id BIGINT, quality INT, toxic INT",
    "conversations": "conv_id BIGINT, turn BIGINT, role STRING, text STRING",
    "pages": "page_id BIGINT, url STRING, html STRING",
}

# derivations shared word for word by both engines: alias -> (source, columns)
REVIEW_SECONDS = "(l_partkey * 37 + l_orderkey * 11) % 86400"
EVENT_SECONDS = "(o_custkey * 61 + o_orderkey * 7) % 86400"
PATCH_KIND = ("CASE o_orderpriority WHEN '1-URGENT' THEN 'patch' WHEN '2-HIGH' THEN 'season_start' "
              "WHEN '3-MEDIUM' THEN 'marketing' WHEN '4-NOT SPECIFIED' THEN 'beta' ELSE 'unknown' END")
TITLE = """CASE CAST(o_orderkey % 18 AS INT)
    WHEN 0 THEN concat('Patch ', CAST(o_custkey % 130 AS STRING), '.', CAST(o_orderkey % 10 AS STRING), ' notes')
    WHEN 1 THEN concat('Season ', CAST(o_custkey % 9 AS STRING), ': Rising')
    WHEN 2 THEN concat('Mid-Season ', CAST(o_custkey % 9 AS STRING), ': Balance')
    WHEN 3 THEN concat('Season ', CAST(o_custkey % 9 AS STRING), ' is here')
    WHEN 4 THEN concat('Season ', CAST(o_custkey % 9 AS STRING), ': teaser')
    WHEN 5 THEN concat('Hotfix 1.', CAST(o_custkey % 20 AS STRING), '.3')
    WHEN 6 THEN concat('BETA build v0.', CAST(o_custkey % 20 AS STRING))
    WHEN 7 THEN concat('Experimental to stable v2.', CAST(o_custkey % 20 AS STRING))
    WHEN 8 THEN concat(CAST(o_custkey % 20 AS STRING), '.5 million sold')
    WHEN 9 THEN 'Weekend sale 50% off'
    WHEN 10 THEN 'Coming soon: the frozen coast'
    WHEN 11 THEN 'The expansion is out now'
    WHEN 12 THEN concat('Dev diary ', CAST(o_custkey % 20 AS STRING))
    WHEN 13 THEN 'Server maintenance'
    WHEN 14 THEN concat('Build v', CAST(o_custkey % 150 AS STRING), '.', CAST(o_orderkey % 7 AS STRING))
    WHEN 15 THEN 'Season of Storms'
    WHEN 16 THEN concat('Episode ', CAST(o_custkey % 9 AS STRING), ' and Season 4: out now')
    ELSE 'Lore of the north' END"""
BODY = "concat(o_orderpriority, ' ', o_orderstatus, repeat(' good', CAST(o_custkey % 6 AS INT)))"
PLATFORM_TITLE = ("CASE status WHEN 'F' THEN concat('Black friday sale ', CAST(yr AS STRING)) "
                  "WHEN 'O' THEN concat('Puzzle fest ', CAST(yr AS STRING)) "
                  "ELSE concat('The Steam Awards ', CAST(yr AS STRING)) END")
# review-like rows of lineitem; copies of a review share recommendation_id
REVIEW_COLUMNS = f"""
    CAST(l_suppkey % 5 + 1 AS INT) AS app_id,
    l_orderkey * 10 + l_linenumber AS recommendation_id,
    l_partkey * 1000000 + l_suppkey * 1000 + CAST(l_quantity AS BIGINT) AS raw_id,
    {{created}} AS created_at,
    {{fetched}} AS fetched_at,
    l_returnflag <> 'R' AS is_voted_up,
    l_linestatus AS language_code,
    CAST(l_quantity * 60 AS INT) AS playtime_at_review_min,
    CAST(CAST(floor(l_extendedprice) AS BIGINT) % 500 AS INT) AS votes_up
"""


def seconds_after(day: str, seconds: str, engine: str) -> str:
    if engine == "spark":
        return f"timestampadd(SECOND, CAST({seconds} AS INT), {day})"
    return f"({day} + to_seconds({seconds}))"


def _review_select(engine: str) -> str:
    created = seconds_after("l_shipdate", REVIEW_SECONDS, engine)
    fetched = seconds_after(
        "l_shipdate", "(CAST(l_quantity AS BIGINT) % 5 + 1) * 86400 + (l_suppkey % 24) * 3600 + 43200", engine)
    return REVIEW_COLUMNS.format(created=created, fetched=fetched)


def _patch_columns(engine: str) -> str:
    return f"""
    o_orderkey AS patch_sk, CAST(o_orderkey AS STRING) AS gid, 
    CASE WHEN o_custkey % 50 = 0 THEN -1 ELSE CAST(o_custkey % 5 + 1 AS INT) END AS app_id,
    CASE WHEN o_custkey % 50 = 0 THEN -1 ELSE CAST((o_custkey % 5) * 10 + 2 AS INT) END AS game_sk,
    {seconds_after("o_orderdate", EVENT_SECONDS, engine)} AS published_at,
    {TITLE} AS title, {PATCH_KIND} AS event_type,
    CAST(CASE WHEN o_orderstatus = 'P' THEN 0 ELSE 1 END AS INT) AS feed_type,
    CASE o_custkey % 10 WHEN 0 THEN 'SteamDB' WHEN 1 THEN NULL ELSE 'community' END AS feedname,
    CAST(floor(o_totalprice / 100) AS INT) * CAST(CASE WHEN o_custkey % 40 = 0 THEN 0 ELSE 1 END AS INT) AS body_length
"""


def _text_fact_columns(engine: str) -> str:
    return f"""
    o_orderkey AS recommendation_id,
    CASE WHEN o_custkey % 50 = 0 THEN -1 ELSE CAST((o_custkey % 5) * 10 + 2 AS INT) END AS game_sk,
    {seconds_after("o_orderdate", EVENT_SECONDS, engine)} AS created_at,
    ascii(o_orderstatus) AS language_sk, o_orderstatus <> 'F' AS is_voted_up,
    CAST(o_totalprice / 40 AS INT) AS playtime_at_review_min, CAST(o_custkey % 97 AS INT) AS votes_up
"""


GAME_ROWS = """
    SELECT CAST(r_regionkey * 10 + v AS INT) AS game_sk, CAST(r_regionkey + 1 AS INT) AS app_id, r_name AS game_name,
           'game' AS app_type, r_regionkey % 2 = 0 AS is_free, CAST(r_regionkey * v AS INT) AS required_age,
           CAST(70 + r_regionkey + v AS INT) AS metacritic_score, concat('https://reviews/', r_name) AS metacritic_url,
           v = 1 AS is_coming_soon, CAST(NULL AS STRING) AS release_date_raw,
           CAST('1995-06-01' AS DATE) AS release_date_parsed,
           CASE v WHEN 1 THEN CAST('1995-06-01' AS TIMESTAMP) ELSE {switch} END AS valid_from,
           CASE v WHEN 1 THEN {switch} ELSE CAST('2100-01-01' AS TIMESTAMP) END AS valid_to,
           v = 2 AS is_current,
           CASE CAST(r_regionkey % 3 AS INT) WHEN 0 THEN 'complete' WHEN 1 THEN 'partial' ELSE NULL END AS collection_status
    FROM {region} {versions}
    UNION ALL
    SELECT -1, -1, 'Unknown', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL,
           CAST('1970-01-01' AS TIMESTAMP), CAST('2100-01-01' AS TIMESTAMP), true, NULL
"""


def duck(sql: str) -> str:
    """Spark spelling of a few names in the shared derivations -> DuckDB spelling."""
    return sql.replace("AS STRING)", "AS VARCHAR)")


def with_ctes(*names: str, body: str) -> str:
    """Oracle statement: the named derivations (and what they build on) in front of ``body``."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for need in NEEDS.get(name, ()):
            add(need)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    ctes = ",\n".join(f"{n} AS ({CTE[n]})" for n in ordered)
    return f"WITH {ctes}\n{body}" if ordered else body


_SWITCH_DUCK = "CAST('1998-01-01' AS TIMESTAMP) + to_days(r_regionkey * 30)"
_SWITCH_SPARK = "CAST(date_add(DATE'1998-01-01', CAST(r_regionkey * 30 AS INT)) AS TIMESTAMP)"

CTE = {
    "p_review": f"SELECT {duck(_review_select('duck'))} FROM lineitem",
    "p_flat": "SELECT app_id, recommendation_id AS review_id, created_at, is_voted_up AS voted_up, language_code FROM p_review",
    "p_daily": "SELECT app_id, CAST(created_at AS DATE) AS day, count(*) AS review_count, "
               "count(*) FILTER (WHERE is_voted_up) AS positive_count FROM p_review GROUP BY 1, 2",
    "p_game": duck(GAME_ROWS.format(
        switch=_SWITCH_DUCK, region="region", versions=", (VALUES (1), (2)) AS t(v)")),
    "p_patch": f"SELECT {duck(_patch_columns('duck'))} FROM orders",
    "p_patch_weight": """
        SELECT p.*, CASE WHEN p.body_length > 0 AND p.game_sk <> -1 THEN
            ((400 * p.body_length + m.k) // (2 * m.k)) / 100.0::DOUBLE END AS weight
        FROM p_patch p LEFT JOIN (
            SELECT app_id, greatest(CAST(2 * coalesce(
                       quantile_cont(body_length, 0.5) FILTER (WHERE event_type = 'patch'),
                       quantile_cont(body_length, 0.5)) AS BIGINT), 2) AS k
            FROM p_patch WHERE body_length > 0 AND game_sk <> -1 GROUP BY 1) m USING (app_id)""",
    "p_event": "SELECT DISTINCT app_id, CAST(published_at AS DATE) AS day, event_type, title, weight FROM p_patch_weight WHERE app_id > 0",
    "p_platform": f"""
        SELECT CAST(month AS VARCHAR) AS gid, event_date,
               CASE status WHEN 'F' THEN 'sale' WHEN 'O' THEN 'fest' ELSE 'awards' END AS event_type,
               {duck(PLATFORM_TITLE)} AS title
        FROM (SELECT month, CAST(b.d AS DATE) AS event_date, b.s AS status, year(b.d) AS yr FROM (
            SELECT date_trunc('month', o_orderdate)::DATE AS month,
                   max(struct_pack(p := o_totalprice, k := o_orderkey, d := o_orderdate, s := o_orderstatus)) AS b
            FROM orders GROUP BY 1))""",
    "t_fact": f"SELECT {duck(_text_fact_columns('duck'))} FROM orders",
    "t_text": f"SELECT o_orderkey AS recommendation_id, {duck(BODY)} AS review_body FROM orders",
    "t_version": f"""SELECT o_orderkey AS review_text_sk, o_orderkey AS recommendation_id,
        md5(CASE WHEN o_custkey % 7 = 0 THEN concat({duck(BODY)}, '!') ELSE {duck(BODY)} END) AS text_hash,
        {duck(BODY)} AS review_body, true AS is_current FROM orders""",
    "t_label": """SELECT o_orderkey AS labeling_sk, o_orderkey AS review_text_sk, CAST(1 + o_orderkey % 2 AS INT) AS llm_config_sk,
        CASE WHEN o_custkey % 11 = 0 THEN 'failed' WHEN o_orderstatus = 'P' THEN 'no_opinion' ELSE 'labeled' END AS status,
        concat('run-', CAST(o_custkey % 3 AS VARCHAR)) AS run_id FROM orders""",
    "t_tag": """SELECT l_orderkey AS labeling_sk, l_linenumber AS importance, CAST(l_partkey % 45 AS INT) AS aspect_sk,
        CASE l_returnflag WHEN 'A' THEN '+' WHEN 'R' THEN '-' ELSE '±' END AS sentiment,
        CASE WHEN l_partkey % 45 = 44 THEN concat('note ', CAST(l_suppkey % 3 AS VARCHAR)) END AS note FROM lineitem""",
    "t_aspect": """SELECT DISTINCT CAST(p_partkey % 45 AS INT) AS aspect_sk,
        CASE p_partkey % 45 WHEN 0 THEN 'overall_impression' WHEN 44 THEN 'other'
             ELSE concat('aspect_', CAST(p_partkey % 45 AS VARCHAR)) END AS aspect_id,
        CASE p_partkey % 45 WHEN 0 THEN 'overall' WHEN 44 THEN 'other'
             ELSE concat('cat_', CAST(p_partkey % 45 % 11 AS VARCHAR)) END AS category_id FROM part""",
    "t_game": "SELECT * FROM p_game",
    "t_review": """SELECT g.app_id, CAST(f.created_at AS DATE) AS day, f.recommendation_id,
        length(trim(coalesce(t.review_body, ''), ' ')) >= 20 AS is_content
        FROM t_fact f JOIN p_game g USING (game_sk) LEFT JOIN t_text t USING (recommendation_id) WHERE g.app_id > 0""",
    "t_labeled": """SELECT app_id, CAST(created_at AS DATE) AS day, recommendation_id, llm_config_sk, labeling_sk
        FROM (SELECT * FROM t_label WHERE status IN ('labeled', 'no_opinion'))
        JOIN (SELECT review_text_sk, recommendation_id, text_hash FROM t_version WHERE is_current) USING (review_text_sk)
        JOIN (SELECT recommendation_id, md5(coalesce(review_body, '')) AS text_hash FROM t_text WHERE length(trim(coalesce(review_body, ''), ' ')) >= 20)
            USING (recommendation_id, text_hash)
        JOIN t_fact USING (recommendation_id) JOIN (SELECT game_sk, app_id FROM p_game WHERE app_id > 0) USING (game_sk)""",
    "t_den": """SELECT r.app_id, r.day, c.llm_config_sk, count(*) AS review_count, count_if(r.is_content) AS content_count,
               count(l.labeling_sk) AS labeled_count
        FROM t_review r JOIN (SELECT app_id, llm_config_sk FROM t_labeled GROUP BY ALL) c USING (app_id)
        LEFT JOIN t_labeled l ON l.recommendation_id = r.recommendation_id AND l.llm_config_sk = c.llm_config_sk GROUP BY ALL""",
    "t_tags": """SELECT r.app_id, r.day, r.llm_config_sk, r.labeling_sk, t.importance, a.category_id, a.aspect_id, t.sentiment, t.note
        FROM t_labeled r JOIN t_tag t USING (labeling_sk) JOIN t_aspect a USING (aspect_sk)""",
    "t_aspect_tag": """SELECT app_id, day, llm_config_sk, labeling_sk, category_id, aspect_id,
               CASE count(DISTINCT sentiment) WHEN 1 THEN any_value(sentiment) ELSE '±' END AS sentiment
        FROM t_tags WHERE aspect_id <> 'overall_impression' OR labeling_sk IN (SELECT labeling_sk FROM t_tags GROUP BY 1 HAVING count(*) = 1)
        GROUP BY ALL""",
    "t_aspect_daily": """SELECT a.app_id, a.day, a.llm_config_sk, a.category_id, a.aspect_id, count(*) AS review_count,
               count_if(sentiment = '+') AS positive_count, count_if(sentiment = '-') AS negative_count, count_if(sentiment = '±') AS mixed_count,
               any_value(d.review_count) AS day_review_count, any_value(d.content_count) AS day_content_count, any_value(d.labeled_count) AS day_labeled_count
        FROM t_aspect_tag a JOIN t_den d USING (app_id, day, llm_config_sk) GROUP BY ALL""",
    "t_category_daily": """SELECT a.app_id, a.day, a.llm_config_sk, a.category_id, count(*) AS review_count,
               count_if(signs = ['+']) AS positive_count, count_if(signs = ['-']) AS negative_count,
               count_if(len(signs) > 1 OR signs = ['±']) AS mixed_count,
               any_value(d.review_count) AS day_review_count, any_value(d.content_count) AS day_content_count, any_value(d.labeled_count) AS day_labeled_count
        FROM (SELECT app_id, day, llm_config_sk, labeling_sk, category_id, list(DISTINCT sentiment) AS signs FROM t_aspect_tag GROUP BY ALL) a
        JOIN t_den d USING (app_id, day, llm_config_sk) GROUP BY ALL""",
    # detector chain
    "d_bounds": "SELECT app_id, min(day) AS lo, max(day) AS hi FROM p_daily GROUP BY 1",
    "d_dense": """SELECT c.app_id, c.day, coalesce(d.review_count, 0) AS total, coalesce(d.positive_count, 0) AS positive
        FROM (SELECT app_id, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS day FROM d_bounds) c
        LEFT JOIN p_daily d ON d.app_id = c.app_id AND d.day = c.day""",
    "d_half": """SELECT s.*, m.median_volume, CASE WHEN median_volume >= 100 THEN 1 WHEN median_volume >= 30 THEN 3
        WHEN median_volume >= 10 THEN 7 ELSE 14 END AS half
        FROM d_dense s JOIN (SELECT app_id, list_sort(list(total))[len(list(total)) // 2 + 1] AS median_volume
                             FROM d_dense GROUP BY 1) m USING (app_id)""",
    "d_smooth": """SELECT app_id, day, total, positive, median_volume, half, wn AS window_n,
        CASE WHEN wn > 0 THEN floor(1000.0::DOUBLE * wp / wn + 0.5::DOUBLE) / 10.0::DOUBLE END AS pct
        FROM (SELECT *,
            CASE half WHEN 1 THEN sum(total) OVER w1 WHEN 3 THEN sum(total) OVER w3 WHEN 7 THEN sum(total) OVER w7 ELSE sum(total) OVER w14 END AS wn,
            CASE half WHEN 1 THEN sum(positive) OVER w1 WHEN 3 THEN sum(positive) OVER w3 WHEN 7 THEN sum(positive) OVER w7 ELSE sum(positive) OVER w14 END AS wp
            FROM d_half WINDOW
              w1 AS (PARTITION BY app_id ORDER BY day ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING),
              w3 AS (PARTITION BY app_id ORDER BY day ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING),
              w7 AS (PARTITION BY app_id ORDER BY day ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING),
              w14 AS (PARTITION BY app_id ORDER BY day ROWS BETWEEN 14 PRECEDING AND 14 FOLLOWING))""",
    "d_base": """SELECT *, floor((pct - base) * 10.0::DOUBLE + 0.5::DOUBLE) / 10.0::DOUBLE AS delta FROM (
        SELECT * EXCLUDE (hist), CASE WHEN pct IS NOT NULL AND len(hist) >= 14 THEN list_sort(hist)[len(hist) // 2 + 1] END AS base
        FROM (SELECT *, list(pct) FILTER (WHERE pct IS NOT NULL) OVER (PARTITION BY app_id ORDER BY day
                     ROWS BETWEEN 90 PRECEDING AND 1 PRECEDING) AS hist FROM d_smooth))""",
    "d_score": """SELECT *, CASE WHEN cb >= 3 AND ca >= 3 THEN floor((ma - mb) * 1e6::DOUBLE + 0.5::DOUBLE) / 1e6::DOUBLE END AS score
        FROM (SELECT *, avg(pct) OVER b AS mb, count(pct) OVER b AS cb, avg(pct) OVER a AS ma, count(pct) OVER a AS ca
              FROM d_smooth WINDOW
                b AS (PARTITION BY app_id ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING),
                a AS (PARTITION BY app_id ORDER BY day ROWS BETWEEN CURRENT ROW AND 6 FOLLOWING))""",
    "d_threshold": """SELECT app_id, count(*) AS n_days, count(score) AS scored_days,
        CASE WHEN count(score) >= 30 THEN floor((avg(abs(score)) + 1.5::DOUBLE * stddev_pop(abs(score))) * 1e6::DOUBLE + 0.5::DOUBLE)
             / 1e6::DOUBLE END AS threshold FROM d_score GROUP BY 1""",
    "d_candidate": """SELECT s.app_id, s.day, s.score, t.threshold FROM d_score s JOIN d_threshold t USING (app_id)
        WHERE abs(s.score) > t.threshold AND abs(s.score) >= 1.0""",
    "d_point": """SELECT app_id, u.d AS day, u.s AS score FROM (
        SELECT app_id, unnest(list_reduce(l, lambda acc, c: CASE WHEN len(list_filter(acc, lambda k: abs(date_diff('day', k.d, c[1].d)) < 7)) = 0
                   THEN list_concat(acc, c) ELSE acc END)) AS u
        FROM (SELECT app_id, list([struct_pack(d := day, s := score)] ORDER BY -abs(score), day) AS l FROM d_candidate GROUP BY 1))""",
}
NEEDS = {
    "p_flat": ("p_review",), "p_daily": ("p_review",), "p_patch_weight": ("p_patch",), "p_event": ("p_patch_weight",),
    "t_game": ("p_game",), "t_review": ("t_fact", "t_text", "p_game"),
    "t_labeled": ("t_label", "t_version", "t_fact", "t_text", "p_game"),
    "t_den": ("t_review", "t_labeled"), "t_tags": ("t_labeled", "t_tag", "t_aspect"), "t_aspect_tag": ("t_tags",),
    "t_aspect_daily": ("t_aspect_tag", "t_den"), "t_category_daily": ("t_aspect_tag", "t_den"),
    "d_bounds": ("p_daily",), "d_dense": ("d_bounds", "p_daily"), "d_half": ("d_dense",), "d_smooth": ("d_half",),
    "d_base": ("d_smooth",), "d_score": ("d_smooth",), "d_threshold": ("d_score",),
    "d_candidate": ("d_score", "d_threshold"), "d_point": ("d_candidate",),
}

WINDOWS_SQL = """SELECT * FROM (VALUES ('before_28', -28, 0, true), ('before_14', -14, 0, true), ('before_7', -7, 0, true),
    ('after_1', 0, 1, false), ('after_3', 0, 3, false), ('after_7', 0, 7, false), ('after_14', 0, 14, false))
    AS x(window_code, day_from, day_to, is_baseline)"""


class Frames:
    """The given tables and the frames derived from them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = settle(spark)
        self.folder = folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.folder}/{name}.parquet")

    def _sql(self, columns: str, table: str) -> DataFrame:
        return self.spark.sql(f"SELECT {columns} FROM {{src}}", src=self.table(table))

    @cached_property
    def reviews(self) -> DataFrame:
        return self._sql(_review_select("spark"), "lineitem")

    @cached_property
    def flat(self) -> DataFrame:
        return self.reviews.select(
            "app_id", F.col("recommendation_id").alias("review_id"), "created_at",
            F.col("is_voted_up").alias("voted_up"), "language_code")

    @cached_property
    def daily(self) -> DataFrame:
        from tideline.operators.marts import review_daily

        return review_daily(self.flat)

    @cached_property
    def games(self) -> DataFrame:
        return self.spark.sql(
            GAME_ROWS.format(switch=_SWITCH_SPARK, region="{src}", versions="LATERAL VIEW explode(array(1, 2)) t AS v"),
            src=self.table("region"))

    @cached_property
    def patches(self) -> DataFrame:
        return self._sql(_patch_columns("spark"), "orders")

    @cached_property
    def weighted(self) -> DataFrame:
        from tideline.operators.events import event_weight

        return event_weight(self.patches.drop("app_id"), self.games)

    @cached_property
    def events(self) -> DataFrame:
        from tideline.operators.events import distinct_events

        return distinct_events(self.weighted)

    @cached_property
    def platform(self) -> DataFrame:
        """The costliest order of each month stands for a platform event."""
        monthly = self.table("orders").groupBy(F.trunc("o_orderdate", "month").alias("month")).agg(
            F.max(F.struct("o_totalprice", "o_orderkey", "o_orderdate", "o_orderstatus")).alias("b"))
        rows = monthly.select(
            F.col("month").cast("string").alias("gid"), F.to_date("b.o_orderdate").alias("event_date"),
            F.col("b.o_orderstatus").alias("status"), F.year("b.o_orderdate").alias("yr"))
        return rows.select(
            "gid", "event_date",
            F.expr("CASE status WHEN 'F' THEN 'sale' WHEN 'O' THEN 'fest' ELSE 'awards' END").alias("event_type"),
            F.expr(PLATFORM_TITLE).alias("title"))

    @cached_property
    def t_fact(self) -> DataFrame:
        return self._sql(_text_fact_columns("spark"), "orders")

    @cached_property
    def t_text(self) -> DataFrame:
        return self._sql(f"o_orderkey AS recommendation_id, {BODY} AS review_body", "orders")

    @cached_property
    def t_version(self) -> DataFrame:
        return self._sql(f"""o_orderkey AS review_text_sk, o_orderkey AS recommendation_id,
            md5(CASE WHEN o_custkey % 7 = 0 THEN concat({BODY}, '!') ELSE {BODY} END) AS text_hash,
            {BODY} AS review_body, true AS is_current""", "orders")

    @cached_property
    def t_label(self) -> DataFrame:
        return self._sql("""o_orderkey AS labeling_sk, o_orderkey AS review_text_sk, CAST(1 + o_orderkey % 2 AS INT) AS llm_config_sk,
            CASE WHEN o_custkey % 11 = 0 THEN 'failed' WHEN o_orderstatus = 'P' THEN 'no_opinion' ELSE 'labeled' END AS status,
            concat('run-', CAST(o_custkey % 3 AS STRING)) AS run_id""", "orders")

    @cached_property
    def t_tag(self) -> DataFrame:
        return self._sql("""l_orderkey AS labeling_sk, l_linenumber AS importance, CAST(l_partkey % 45 AS INT) AS aspect_sk,
            CASE l_returnflag WHEN 'A' THEN '+' WHEN 'R' THEN '-' ELSE '±' END AS sentiment,
            CASE WHEN l_partkey % 45 = 44 THEN concat('note ', CAST(l_suppkey % 3 AS STRING)) END AS note""", "lineitem")

    @cached_property
    def t_aspect(self) -> DataFrame:
        return self._sql("""DISTINCT CAST(p_partkey % 45 AS INT) AS aspect_sk,
            CASE p_partkey % 45 WHEN 0 THEN 'overall_impression' WHEN 44 THEN 'other'
                 ELSE concat('aspect_', CAST(p_partkey % 45 AS STRING)) END AS aspect_id,
            CASE p_partkey % 45 WHEN 0 THEN 'overall' WHEN 44 THEN 'other'
                 ELSE concat('cat_', CAST(p_partkey % 45 % 11 AS STRING)) END AS category_id""", "part")

    @cached_property
    def t_review(self) -> DataFrame:
        from tideline.operators.marts import reviews_with_text

        return reviews_with_text(self.t_fact, self.games, self.t_text, 20)

    @cached_property
    def t_labeled(self) -> DataFrame:
        from tideline.operators.marts import review_labeled

        return review_labeled(self.t_label, self.t_version, self.t_fact, self.games, self.t_text)

    @cached_property
    def labeled_table(self) -> DataFrame:
        """The counted labels as a table: tags and denominators both read it."""
        return written(self.t_labeled, "labeled")

    @cached_property
    def t_den(self) -> DataFrame:
        from tideline.operators.marts import review_labeling_daily

        return review_labeling_daily(self.t_review, self.labeled_table)

    @cached_property
    def t_tags(self) -> DataFrame:
        from tideline.operators.marts import review_tags

        return review_tags(self.labeled_table, self.t_tag, self.t_aspect)

    @cached_property
    def t_aspect_tag(self) -> DataFrame:
        from tideline.operators.marts import review_aspect_tag

        return review_aspect_tag(self.t_tags)

    @cached_property
    def den_table(self) -> DataFrame:
        return written(self.t_den, "denominators")

    @cached_property
    def tag_table(self) -> DataFrame:
        """Folded tags as a table: both marts and the evidence read them."""
        return written(self.t_aspect_tag, "tags")

    @cached_property
    def t_aspect_daily(self) -> DataFrame:
        from tideline.operators.marts import review_aspect_daily

        return review_aspect_daily(self.tag_table, self.den_table)

    @cached_property
    def t_category_daily(self) -> DataFrame:
        from tideline.operators.marts import review_category_daily

        return review_category_daily(self.tag_table, self.den_table)

    @cached_property
    def bounds(self) -> DataFrame:
        from tideline.operators.events import series_bounds

        return series_bounds(self.daily)

    @cached_property
    def dense(self) -> DataFrame:
        from tideline.operators.series import densify

        return densify(self.daily)

    @cached_property
    def smoothed(self) -> DataFrame:
        from tideline.operators.series import half_window, smooth

        return smooth(half_window(self.dense))

    @cached_property
    def scored(self) -> DataFrame:
        from tideline.operators.series import shift_score

        return shift_score(self.smoothed)

    @cached_property
    def points(self) -> DataFrame:
        """Written once: jobs about points read them several times."""
        from tideline.operators.series import candidates, suppress

        return written(suppress(candidates(self.scored)), "points")
