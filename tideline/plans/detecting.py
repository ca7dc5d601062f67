"""Queries over the daily series: smoothing, change points, events around them, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.operators import events as ev
from tideline.operators import marts, reports, series
from tideline.plans.catalog import query
from tideline.plans.frames import WINDOWS_SQL


@query("calendar_densify", "d_dense", sql="SELECT app_id, day, CAST(total AS BIGINT) AS total, CAST(positive AS BIGINT) AS positive FROM d_dense")
def _(t):
    return t.dense


@query("adaptive_half_window", "d_half",
       sql="SELECT DISTINCT app_id, CAST(median_volume AS BIGINT) AS median_volume, CAST(half AS INT) AS half FROM d_half")
def _(t):
    return series.half_window(t.dense).select("app_id", "median_volume", F.col("half").cast("int").alias("half")).distinct()


@query("smoothed_share", "d_smooth", sql="SELECT app_id, day, CAST(total AS BIGINT) AS total, pct, CAST(window_n AS BIGINT) AS window_n FROM d_smooth")
def _(t):
    return t.smoothed.select("app_id", "day", "total", "pct", "window_n")


@query("baseline_deviation", "d_base", sql="SELECT app_id, day, pct, base, delta FROM d_base")
def _(t):
    return series.baseline(t.smoothed).select("app_id", "day", "pct", "base", "delta")


@query("sentiment_series", "d_base",
       sql="""SELECT app_id, day, CAST(total AS BIGINT) AS total, CAST(positive AS BIGINT) AS positive, pct,
              CAST(window_n AS BIGINT) AS window_n, base, delta FROM d_base""")
def _(t):
    return series.sentiment_series(t.daily).select("app_id", "day", "total", "positive", "pct", "window_n", "base", "delta")


@query("shift_score", "d_score", sql="SELECT app_id, day, pct, score FROM d_score")
def _(t):
    return t.scored.select("app_id", "day", "pct", "score")


@query("change_point_threshold", "d_threshold",
       sql="""SELECT app_id, n_days AS days, scored_days, threshold,
              CASE WHEN scored_days < 30 THEN 'too few scored days' END AS reason FROM d_threshold""")
def _(t):
    return series.threshold(t.scored)


@query("change_point_candidates", "d_candidate", sql="SELECT * FROM d_candidate")
def _(t):
    return series.candidates(t.scored)


@query("change_points", "d_point", sql="SELECT app_id, day, score FROM d_point")
def change_points(t):
    return series.change_points(t.smoothed)


@query("top_change_points", "d_point",
       sql="""SELECT * FROM (SELECT app_id, day, score, CAST(row_number() OVER (PARTITION BY app_id ORDER BY abs(score) DESC, day) AS INT) AS rank
              FROM d_point) WHERE rank <= 10""")
def _(t):
    return series.top_points(t.points)


# --- events ---------------------------------------------------------------------------------

SIGNIFICANT = """CASE WHEN event_type IN ('season_start', 'expansion') THEN true
    WHEN event_type IN ('marketing', 'blog', 'service') THEN false ELSE coalesce(weight, 0) >= 2 END"""
RESPONSE = """
    SELECT app_id, day, CAST(bt AS BIGINT) AS before_total, CAST(at_ AS BIGINT) AS after_total, coalesce(bn > 0 AND
        ((bt > 0 AND (at_::DOUBLE / an) / (bt::DOUBLE / bn) >= 2.0) OR
         (least(bt, at_) >= 30 AND abs(100.0::DOUBLE * ap / at_ - 100.0::DOUBLE * bp / bt) >= 12)), false) AS responsive
    FROM (SELECT app_id, day, sum(total) OVER b AS bt, sum(total) OVER a AS at_, sum(positive) OVER b AS bp,
                 sum(positive) OVER a AS ap, count(total) OVER b AS bn, count(total) OVER a AS an
          FROM d_dense WINDOW
            b AS (PARTITION BY app_id ORDER BY day ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING),
            a AS (PARTITION BY app_id ORDER BY day ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING))"""
CHART = f"""
    SELECT e.app_id, e.day, e.event_type, e.title, e.weight,
           (e.event_type IN ('season_start', 'expansion') OR r.responsive) AS always_show
    FROM p_event e JOIN ({RESPONSE}) r USING (app_id, day)
    WHERE always_show OR coalesce(e.weight, 0) >= """
NEAR = """
    SELECT p.app_id, p.day AS point_day, p.score, e.day AS event_day, e.event_type, e.title, e.weight
    FROM d_point p JOIN p_event e ON e.app_id = p.app_id AND abs(date_diff('day', p.day, e.day)) <= 3
    JOIN d_bounds b ON b.app_id = p.app_id AND e.day BETWEEN b.lo AND b.hi"""
NEAREST = """
    SELECT app_id, point_day, event_date, event_type, title FROM (
        SELECT p.app_id, p.day AS point_day, e.event_date, e.event_type, e.title,
               row_number() OVER (PARTITION BY p.app_id, p.day ORDER BY abs(date_diff('day', p.day, e.event_date)), e.event_date, e.title) AS k
        FROM d_point p JOIN p_platform e ON abs(date_diff('day', p.day, e.event_date)) <= 3
        JOIN d_bounds b ON b.app_id = p.app_id AND e.event_date BETWEEN b.lo AND b.hi) WHERE k = 1"""
EXPLAINED = f"""
    SELECT h.app_id, h.point_day, h.score, x.role, x.event_day, x.event_type, x.title, x.weight
    FROM (SELECT app_id, day AS point_day, floor(score * 10.0::DOUBLE + 0.5::DOUBLE) / 10.0::DOUBLE AS score FROM d_point) h
    LEFT JOIN (
        SELECT app_id, point_day, CASE WHEN {SIGNIFICANT} THEN 'major' ELSE 'minor' END AS role, event_day, event_type, title, weight FROM ({NEAR})
        UNION ALL
        SELECT app_id, point_day, 'platform', event_date, event_type, title, NULL FROM ({NEAREST})) x USING (app_id, point_day)"""
LABEL = """CASE event_type WHEN 'awards' THEN 'Steam Awards'
    WHEN 'sale' THEN CASE WHEN s = '' THEN 'Steam Sale' ELSE concat('Steam ', array_to_string(list_transform(string_split(s, ' '), lambda w: concat(upper(w[1]), w[2:])), ' '), ' Sale') END
    WHEN 'fest' THEN CASE WHEN f = '' THEN 'Steam Fest' ELSE concat(upper(f[1]), f[2:], ' Fest') END ELSE title END"""
LABEL_PARTS = r"""regexp_extract(title, '\b(summer|winter|spring|autumn|fall|holiday|black friday|halloween|lunar new year|chinese new year|christmas)\s+(?:steam\s+)?sale\b', 1, 'i') AS s,
    regexp_extract(title, '\b(\w+)\s+fest\b', 1, 'i') AS f"""
HEADLINE = f"""
    SELECT app_id, point_day, score, minor_events,
        CASE WHEN major IS NOT NULL THEN concat(major.event_type, ': ', major.title)
             WHEN platform IS NOT NULL THEN concat('platform: ', platform_label)
             WHEN minor_events > 0 THEN concat(CAST(minor_events AS VARCHAR), ' minor events') ELSE 'no events nearby' END AS headline
    FROM (SELECT *, (SELECT {LABEL} FROM (SELECT *, {LABEL_PARTS} FROM (SELECT platform.event_type AS event_type, platform.title AS title))) AS platform_label
          FROM (SELECT app_id, point_day, score,
                min(struct_pack(event_day := event_day, event_type := event_type, title := title, weight := coalesce(weight, -1))) FILTER (WHERE role = 'major') AS major,
                min(struct_pack(event_type := event_type, title := title)) FILTER (WHERE role = 'platform') AS platform,
                count(*) FILTER (WHERE role = 'minor') AS minor_events
                FROM ({EXPLAINED}) GROUP BY 1, 2, 3))"""


@query("event_weight", "p_patch_weight", sql="SELECT patch_sk, game_sk, event_type, body_length, weight FROM p_patch_weight")
def _(t):
    return t.weighted.select("patch_sk", "game_sk", "event_type", "body_length", F.col("weight").cast("double").alias("weight"))


@query("news_kind_distribution", "p_patch",
       sql="""SELECT event_type, n, CAST(sum(n) OVER () AS BIGINT) AS total, floor(100.0::DOUBLE * n / sum(n) OVER () * 10 + 0.5) / 10 AS percent
              FROM (SELECT event_type, count(*) AS n FROM p_patch GROUP BY 1)""")
def _(t):
    return ev.kind_distribution(t.patches)


@query("distinct_events", "p_event", sql="SELECT * FROM p_event")
def _(t):
    return t.events.withColumn("weight", F.col("weight").cast("double"))


@query("significant_event", "p_event", sql=f"SELECT *, {SIGNIFICANT} AS major FROM p_event")
def _(t):
    return t.events.withColumn("weight", F.col("weight").cast("double")).withColumn("major", ev.is_significant())


@query("event_response", "d_dense", sql=RESPONSE)
def _(t):
    return ev.event_response(t.dense)


@query("chart_events", "d_dense", "p_event", sql=CHART + "1.5")
def _(t):
    return ev.chart_events(t.events, t.dense, 1.5).withColumn("weight", F.col("weight").cast("double"))


@query("density_filter", "d_dense", "p_event", sql=f"SELECT * FROM ({CHART} 0) WHERE always_show OR coalesce(weight, 0) >= 2")
def _(t):
    return ev.density_filter(ev.chart_events(t.events, t.dense), 200).withColumn("weight", F.col("weight").cast("double"))


@query("platform_events_in_range", "p_daily", "p_platform",
       sql="""SELECT b.app_id, e.event_date, e.event_type, e.title FROM p_platform e
              JOIN (SELECT app_id, min(day) AS lo, max(day) AS hi FROM p_daily GROUP BY 1) b ON e.event_date BETWEEN b.lo AND b.hi""")
def _(t):
    return ev.platform_events_in_range(t.platform, t.daily)


@query("event_interval_join", "d_point", "p_event", sql=NEAR)
def _(t):
    return ev.nearby_events(t.points, t.events, t.bounds).select(
        "app_id", "point_day", "score", "event_day", "event_type", "title", F.col("weight").cast("double").alias("weight"))


@query("nearest_platform_event", "d_point", "p_platform", sql=NEAREST)
def _(t):
    return ev.nearest_platform_event(t.points, t.platform, t.bounds)


@query("explained_change_points", "d_point", "p_event", "p_platform", sql=EXPLAINED)
def _(t):
    return ev.explained_points(t.points, t.events, t.platform, t.bounds)


@query("main_event", "d_point", "p_event", "p_platform", sql=HEADLINE)
def _(t):
    return ev.main_event(ev.explained_points(t.points, t.events, t.platform, t.bounds))


@query("period_event_summary", "d_point", "p_event", "p_platform",
       sql=f"""SELECT app_id, point_day, CASE WHEN score < 0 THEN 'down' ELSE 'up' END AS direction, abs(score) AS size_pp, headline
               FROM ({HEADLINE}) WHERE point_day BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'""")
def _(t):
    return ev.period_summary(ev.explained_points(t.points, t.events, t.platform, t.bounds), "1996-01-01", "1999-12-31")


@query("point_news", "d_point", "p_event",
       sql=f"""SELECT n.app_id, n.point_day, d.news_day, n.title, n.event_type, n.weight, {SIGNIFICANT} AS major
               FROM ({NEAR}) n JOIN (
                   SELECT app_id, point_day, title, arg_min(event_day, struct_pack(a := abs(date_diff('day', point_day, event_day)), b := event_day)) AS news_day
                   FROM ({NEAR}) GROUP BY 1, 2, 3) d USING (app_id, point_day, title)""")
def _(t):
    return ev.point_news(t.points, t.events, t.bounds)


IMPACT = f"""
    SELECT q.patch_sk, q.app_id, window_code, day_from, day_to, is_baseline, hi.n - lo.n AS review_count, hi.p - lo.p AS positive_count, window_complete
    FROM (
        SELECT w.*, b.data_from <= w.first_at AND w.end_at <= b.data_to AS window_complete
        FROM (SELECT p.patch_sk, p.app_id, x.*, p.published_at + to_days(x.day_from) AS first_at, p.published_at + to_days(x.day_to) AS end_at
              FROM p_patch p, ({WINDOWS_SQL}) x) w
        JOIN (SELECT app_id, min(created_at) AS data_from, max(created_at) AS data_to FROM p_flat GROUP BY 1) b USING (app_id)) q
    ASOF JOIN running lo ON lo.app_id = q.app_id AND q.first_at > lo.created_at
    ASOF JOIN running hi ON hi.app_id = q.app_id AND q.end_at > hi.created_at"""
RUNNING = """
    running AS (
        SELECT app_id, created_at, CAST(max(n) AS BIGINT) AS n, CAST(max(p) AS BIGINT) AS p FROM (
            SELECT app_id, created_at, count(*) OVER w AS n, sum(CASE WHEN voted_up THEN 1 ELSE 0 END) OVER w AS p
            FROM p_flat WINDOW w AS (PARTITION BY app_id ORDER BY created_at ROWS UNBOUNDED PRECEDING))
        GROUP BY 1, 2
        UNION ALL SELECT DISTINCT app_id, TIMESTAMP '1900-01-01', 0, 0 FROM p_flat)"""


def _impact_sql(final: str) -> str:
    return f"SELECT * FROM (WITH {RUNNING}, impact AS ({IMPACT}) {final})"


@query("patch_impact", "p_patch", "p_flat", sql=_impact_sql("SELECT * FROM impact"))
def _(t):
    return ev.patch_impact(t.patches, t.flat)


DAILY_IMPACT = f"""
    SELECT w.patch_sk, w.app_id, w.window_code, w.day_from, w.day_to, w.is_baseline,
           CAST(coalesce(hi.n, 0) - coalesce(lo.n, 0) AS BIGINT) AS review_count,
           CAST(coalesce(hi.p, 0) - coalesce(lo.p, 0) AS BIGINT) AS positive_count,
           w.first_day >= b.lo AND w.last_day <= b.hi AS window_complete
    FROM (SELECT p.patch_sk, p.app_id, x.*,
                 CAST(p.published_at AS DATE) + x.day_from + CASE WHEN x.is_baseline THEN 0 ELSE 1 END AS first_day,
                 CAST(p.published_at AS DATE) + x.day_to - CASE WHEN x.is_baseline THEN 1 ELSE 0 END AS last_day
          FROM p_patch p, ({WINDOWS_SQL}) x) w
    JOIN (SELECT app_id, min(day) AS lo, max(day) AS hi FROM p_daily GROUP BY 1) b ON b.app_id = w.app_id
    ASOF LEFT JOIN run lo ON lo.app_id = w.app_id AND w.first_day > lo.day
    ASOF LEFT JOIN run hi ON hi.app_id = w.app_id AND w.last_day >= hi.day"""


@query("patch_impact_daily", "p_patch", "p_daily",
       sql=f"""SELECT * FROM (WITH run AS (SELECT app_id, day, sum(review_count) OVER w AS n, sum(positive_count) OVER w AS p FROM p_daily
               WINDOW w AS (PARTITION BY app_id ORDER BY day)) {DAILY_IMPACT})""")
def _(t):
    return ev.patch_impact_daily(t.patches, t.daily)


EVENT_IMPACT = """
    SELECT app_id, patch_sk, before_reviews, after_reviews, shift_pp, CAST(rank AS INT) AS rank FROM (
        SELECT *, row_number() OVER (PARTITION BY app_id ORDER BY abs(shift_pp) DESC, patch_sk) AS rank FROM (
            SELECT b.app_id, b.patch_sk, b.review_count AS before_reviews, a.review_count AS after_reviews,
                   floor((100.0::DOUBLE * a.positive_count / a.review_count - 100.0::DOUBLE * b.positive_count / b.review_count) * 1e6 + 0.5) / 1e6 AS shift_pp
            FROM impact b JOIN impact a USING (patch_sk)
            WHERE b.window_code = 'before_7' AND a.window_code = 'after_7' AND b.window_complete AND a.window_complete
              AND b.review_count >= 30 AND a.review_count >= 30) WHERE abs(shift_pp) >= 3) WHERE rank <= 20"""


@query("event_impact", "p_patch", "p_flat", sql=_impact_sql(EVENT_IMPACT))
def _(t):
    return ev.event_impact_now(t.patches, t.flat)


@query("daily_votes", "p_daily", sql="SELECT app_id, day, review_count AS total, review_count - positive_count AS negative FROM p_daily")
def _(t):
    return marts.daily_votes(t.daily)


@query("game_dashboard", "d_base", "d_point", "p_event", "p_platform",
       sql=f"""SELECT app_id, 'day' AS kind, day, pct AS value, CAST(total AS BIGINT) AS reviews, base, delta, NULL::VARCHAR AS detail, NULL::VARCHAR AS title FROM d_base
               UNION ALL SELECT app_id, 'event', day, weight, NULL, NULL, NULL, event_type, title FROM ({CHART} 2)
               UNION ALL SELECT b.app_id, 'platform', e.event_date, NULL, NULL, NULL, NULL, e.event_type, e.title FROM p_platform e
                   JOIN d_bounds b ON e.event_date BETWEEN b.lo AND b.hi
               UNION ALL SELECT app_id, 'point', point_day, score, NULL, NULL, NULL, headline, NULL FROM ({HEADLINE})""")
def _(t):
    return reports.game_dashboard(t.daily, t.events, t.platform, min_weight=2.0)
