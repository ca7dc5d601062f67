"""Queries over the evidence around change points and over stored verdicts."""

from __future__ import annotations

import json
from functools import cached_property, lru_cache

from pyspark.sql import functions as F

from tideline.operators import events as ev
from tideline.operators import evidence, planning, verdicts
from tideline.plans.catalog import query
from tideline.plans.detecting import NEAR, NEAREST, SIGNIFICANT
from tideline.plans.frames import with_ctes
from tideline.session import written

CONFIG = 1
PRICES = {"input": 0.3, "output": 1.2}
POINT = evidence.POINT


class Around:
    """Evidence frames of all points. Frames that several others read are written once, as marts are."""

    def __init__(self, t):
        self.t = t

    @cached_property
    def points(self):
        return self.t.points

    @cached_property
    def votes(self):
        return evidence.votes_before_after(self.t.daily, self.points)

    @cached_property
    def labeled(self):
        return self.t.labeled_table

    @cached_property
    def tags(self):
        return self.t.tag_table

    @cached_property
    def denominators(self):
        return self.t.den_table

    @cached_property
    def category_daily(self):
        return written(self.t.t_category_daily, "categories")

    @cached_property
    def aspect_daily(self):
        return written(self.t.t_aspect_daily, "aspects")

    def shares(self, mart, key, by):
        return evidence.weighted_topic_share(self.denominators, evidence.critique_rows(mart, key), self.points, CONFIG, by)

    @cached_property
    def categories(self):
        shift = evidence.topic_shift(self.shares(self.category_daily, "category_id", ("key",)))
        return written(evidence.without_service(shift), "shift")

    @cached_property
    def aspects(self):
        by = ("category_id", "key")
        return evidence.topic_shift(self.shares(self.aspect_daily, "aspect_id", by), by)

    @cached_property
    def labels(self):
        return written(evidence.shift_labels(self.votes, self.categories), "shift-labels")

    @cached_property
    def movers(self):
        return written(evidence.top_movers(self.categories, self.labels), "movers")

    @cached_property
    def support(self):
        return written(evidence.support_reviews(self.movers, self.labeled, self.tags, self.t.t_fact, CONFIG), "support")

    @cached_property
    def numbered(self):
        return written(evidence.number_support(self.support), "numbered")

    @cached_property
    def languages(self):
        return self.t.table("orders").select(
            F.ascii("o_orderstatus").alias("language_sk"),
            F.expr("CASE o_orderstatus WHEN 'O' THEN 'english' WHEN 'P' THEN 'russian' ELSE 'french' END").alias("language_code")).distinct()

    @cached_property
    def playtime(self):
        return evidence.playtime_segments(self.labeled, self.tags, self.t.t_fact, self.labels, CONFIG)

    @cached_property
    def bundle(self):
        t = self.t
        texts = evidence.with_texts(self.numbered, t.t_label, t.t_version)
        news = ev.point_news(self.points, t.events, t.bounds)
        platform = ev.nearest_platform_event(self.points, t.platform, t.bounds)
        return evidence.evidence_bundle(self.labels, self.movers, self.aspects, self.playtime, texts, news, platform, CONFIG)


BASE = ("d_point", "p_daily", "t_den", "t_category_daily", "t_aspect_daily")
R6 = "floor(({0}) * 1e6::DOUBLE + 0.5::DOUBLE) / 1e6::DOUBLE"


def _shares_sql(mart: str, keys: str) -> str:
    join = " AND ".join(f"s.{k} = k.{k}" for k in keys.split(", "))
    return f"""
    SELECT z.app_id, z.point_day, z.after, {', '.join('k.' + k for k in keys.split(', '))}, CASE WHEN z.den > 0 THEN coalesce(s.num, 0) / z.den END AS share,
           z.labeled, coalesce(s.crit, 0) AS crit
    FROM (SELECT p.app_id, p.day AS point_day, x.after, CAST(sum(d.content_count) AS DOUBLE) AS den, CAST(coalesce(sum(d.labeled_count), 0) AS BIGINT) AS labeled
          FROM d_point p CROSS JOIN (VALUES (false), (true)) AS x(after)
          LEFT JOIN t_den d ON d.app_id = p.app_id AND d.llm_config_sk = 1 AND d.labeled_count > 0
               AND CASE WHEN x.after THEN d.day >= p.day AND d.day < p.day + 7 ELSE d.day >= p.day - 7 AND d.day < p.day END GROUP BY 1, 2, 3) z
    JOIN (SELECT DISTINCT app_id, {keys} FROM {mart} WHERE llm_config_sk = 1) k ON k.app_id = z.app_id
    LEFT JOIN (SELECT p.app_id, p.day AS point_day, m.day >= p.day AS after, {keys},
                      sum(m.day_content_count::DOUBLE * (m.negative_count + m.mixed_count) / m.day_labeled_count) AS num,
                      CAST(sum(m.negative_count + m.mixed_count) AS BIGINT) AS crit
               FROM d_point p JOIN {mart} m ON m.app_id = p.app_id AND m.llm_config_sk = 1 AND m.day_labeled_count > 0 AND m.day >= p.day - 7 AND m.day < p.day + 7
               GROUP BY ALL) s ON s.app_id = z.app_id AND s.point_day = z.point_day AND s.after = z.after AND {join}"""


def _shift_sql(shares: str, keys: str) -> str:
    return f"""
    SELECT app_id, point_day, {keys}, {R6.format('b')} AS before, {R6.format('a')} AS after, {R6.format('a - b')} AS diff, crit_before, crit_after, labeled_before, labeled_after
    FROM (SELECT app_id, point_day, {keys}, max(share) FILTER (WHERE NOT after) AS b, max(share) FILTER (WHERE after) AS a,
                 max(crit) FILTER (WHERE NOT after) AS crit_before, max(crit) FILTER (WHERE after) AS crit_after,
                 max(labeled) FILTER (WHERE NOT after) AS labeled_before, max(labeled) FILTER (WHERE after) AS labeled_after
          FROM {shares} GROUP BY ALL) WHERE a IS NOT NULL AND b IS NOT NULL"""


VOTES = f"""
    SELECT app_id, point_day, CAST(bn AS BIGINT) AS before_reviews, CAST(an AS BIGINT) AS after_reviews,
           CASE WHEN bn > 0 THEN {R6.format('bneg::DOUBLE / bn')} END AS before_negative, CASE WHEN an > 0 THEN {R6.format('aneg::DOUBLE / an')} END AS after_negative
    FROM (SELECT p.app_id, p.day AS point_day, coalesce(sum(review_count) FILTER (WHERE d.day < p.day), 0) AS bn, coalesce(sum(review_count) FILTER (WHERE d.day >= p.day), 0) AS an,
                 coalesce(sum(review_count - positive_count) FILTER (WHERE d.day < p.day), 0) AS bneg, coalesce(sum(review_count - positive_count) FILTER (WHERE d.day >= p.day), 0) AS aneg
          FROM d_point p LEFT JOIN p_daily d ON d.app_id = p.app_id AND d.day >= p.day - 7 AND d.day < p.day + 7 GROUP BY 1, 2)"""
# the chain of evidence statements, each building on the ones before
CHAIN = {
    "votes": VOTES,
    "cat_shares": _shares_sql("t_category_daily", "category_id"),
    "cat_all": _shift_sql("cat_shares", "category_id"),
    "cats": "SELECT * FROM cat_all WHERE category_id NOT IN ('overall', 'other')",
    "asp_shares": _shares_sql("t_aspect_daily", "category_id, aspect_id"),
    "asps": _shift_sql("asp_shares", "category_id, aspect_id"),
    "nets": f"""SELECT v.*, coalesce(c.net, 0) AS net, coalesce(c.rise, 0) AS rise, coalesce(c.fall, 0) AS fall FROM votes v LEFT JOIN (
        SELECT app_id, point_day, {R6.format('sum(diff)')} AS net, sum(greatest(diff, 0)) AS rise, sum(least(diff, 0)) AS fall FROM cats GROUP BY 1, 2) c USING (app_id, point_day)""",
    "mains": """SELECT app_id, point_day, category_id, before, after, diff, crit_before, crit_after, labeled_before, labeled_after FROM (
        SELECT c.*, row_number() OVER (PARTITION BY c.app_id, c.point_day ORDER BY CASE WHEN n.net >= 0 THEN -c.diff ELSE c.diff END, c.category_id) AS k, n.net
        FROM cats c JOIN nets n USING (app_id, point_day)) WHERE k = 1 AND diff <> 0 AND (diff > 0) = (net >= 0)""",
    "lab": f"""
        SELECT app_id, point_day, direction, CASE WHEN NOT significant THEN 'undefined' WHEN focus >= 0.5 THEN 'focused' ELSE 'spread' END AS character,
               critique_up, focus, {R6.format('se')} AS se, significant, main, main_diff, volume, before_reviews, after_reviews, before_negative, after_negative
        FROM (SELECT *, CASE WHEN significant THEN {R6.format('main_diff / CASE WHEN critique_up THEN rise ELSE fall END')} END AS focus FROM (
            SELECT *, coalesce(abs(main_diff) >= 2 * se, false) AS significant FROM (
                SELECT n.*, n.net >= 0 AS critique_up, m.category_id AS main, m.diff AS main_diff,
                       CASE WHEN coalesce(after_negative, 0) - coalesce(before_negative, 0) > 0 AND net > 0 THEN 'worse'
                            WHEN coalesce(after_negative, 0) - coalesce(before_negative, 0) < 0 AND net < 0 THEN 'better' ELSE 'mixed' END AS direction,
                       CASE WHEN m.labeled_before > 0 AND m.labeled_after > 0 THEN floor(sqrt(m.before * (1 - m.before) / m.labeled_before + m.after * (1 - m.after) / m.labeled_after) * 1e9 + 0.5) / 1e9 END AS se,
                       CASE WHEN m.category_id IS NOT NULL THEN CASE WHEN greatest(m.crit_before, m.crit_after) < 10 THEN 'small' ELSE 'enough' END END AS volume
                FROM nets n LEFT JOIN mains m USING (app_id, point_day))))""",
    "movers": """SELECT app_id, point_day, side, CAST(rank AS INT) AS rank, category_id AS key, before, after, diff, crit_before, crit_after, critique_up FROM (
        SELECT *, row_number() OVER (PARTITION BY app_id, point_day, side ORDER BY abs(diff) DESC, category_id) AS rank FROM (
            SELECT c.*, l.critique_up, CASE WHEN c.diff > 0 AND l.direction <> 'better' THEN 'rising' WHEN c.diff < 0 AND l.direction <> 'worse' THEN 'falling' END AS side
            FROM cats c JOIN lab l USING (app_id, point_day)) WHERE side IS NOT NULL) WHERE rank <= 3""",
    "pool": """SELECT m.app_id, m.point_day, m.rank AS block, m.key AS category_id, g.labeling_sk, r.recommendation_id, f.votes_up,
               md5(concat(CAST(r.recommendation_id AS VARCHAR), CAST(m.point_day AS VARCHAR))) AS h
        FROM movers m JOIN (SELECT app_id, day, labeling_sk, category_id, CASE WHEN min(sentiment) = max(sentiment) THEN min(sentiment) ELSE '±' END AS sign
                            FROM t_aspect_tag WHERE llm_config_sk = 1 GROUP BY 1, 2, 3, 4) g
          ON g.app_id = m.app_id AND g.category_id = m.key AND g.day >= m.point_day AND g.day < m.point_day + 7
             AND CASE WHEN m.critique_up THEN g.sign IN ('-', '±') ELSE g.sign = '+' END
        JOIN t_labeled r ON r.labeling_sk = g.labeling_sk JOIN t_fact f ON f.recommendation_id = r.recommendation_id
        WHERE m.critique_up = (m.side = 'rising')""",
    "support": """SELECT app_id, point_day, block, category_id, labeling_sk, recommendation_id, votes_up, CAST(position AS INT) AS position FROM (
        SELECT *, CASE WHEN v <= 8 THEN v ELSE 8 + row_number() OVER (PARTITION BY app_id, point_day, block, v <= 8 ORDER BY h, recommendation_id) END AS position FROM (
            SELECT *, row_number() OVER (PARTITION BY app_id, point_day, block ORDER BY votes_up DESC, recommendation_id) AS v FROM pool)) WHERE position <= 15""",
    "numbered": """SELECT s.*, n.number FROM support s JOIN (
        SELECT app_id, point_day, recommendation_id, CAST(row_number() OVER (PARTITION BY app_id, point_day ORDER BY f.b, f.p) AS INT) AS number FROM (
            SELECT app_id, point_day, recommendation_id, min(struct_pack(b := block, p := position)) AS f FROM support GROUP BY 1, 2, 3)) n USING (app_id, point_day, recommendation_id)""",
    "spoken": """SELECT n.app_id, n.point_day, n.number, n.recommendation_id, n.votes_up,
               CASE f.language_sk WHEN ascii('O') THEN 'english' WHEN ascii('P') THEN 'russian' ELSE 'french' END AS language_code, x.review_body AS text
        FROM (SELECT DISTINCT app_id, point_day, number, recommendation_id, votes_up FROM numbered) n JOIN t_fact f USING (recommendation_id) JOIN t_text x USING (recommendation_id)""",
}
MATERIALIZED = ("cats", "lab", "movers", "pool", "support", "numbered", "asps")


def chain(until: str, final: str, *ctes: str) -> str:
    steps = []
    for name, sql in CHAIN.items():
        steps.append(f"{name} AS {'MATERIALIZED ' if name in MATERIALIZED else ''}({sql})")
        if name == until:
            break
    return with_ctes(*BASE, *ctes, body=f"SELECT * FROM (WITH {', '.join(steps)} {final})")


TEXTS = ("t_fact", "t_labeled", "t_aspect_tag", "t_text")


@query("votes_before_after", sql=chain("votes", "SELECT * FROM votes"))
def _(t):
    return Around(t).votes


@query("weighted_topic_share", sql=chain("cat_shares", f"SELECT app_id, point_day, after, category_id AS key, {R6.format('share')} AS share, labeled, crit FROM cat_shares"))
def _(t):
    a = Around(t)
    shares = a.shares(a.category_daily, "category_id", ("key",))
    return shares.withColumn("share", evidence.half_up(F.col("share"), 6))


@query("topic_shift", sql=chain("asps", """
    SELECT 'category' AS level, category_id, category_id AS key, * EXCLUDE (category_id) FROM cats UNION ALL BY NAME
    SELECT 'aspect' AS level, category_id, aspect_id AS key, * EXCLUDE (category_id, aspect_id) FROM asps"""))
def _(t):
    a = Around(t)
    return a.categories.withColumn("level", F.lit("category")).withColumn("category_id", F.col("key")).unionByName(
        a.aspects.withColumn("level", F.lit("aspect")))


@query("shift_labels", sql=chain("lab", "SELECT * FROM lab"))
def _(t):
    return Around(t).labels


@query("top_movers", sql=chain("movers", "SELECT * FROM movers"))
def _(t):
    return Around(t).movers


PLAYED = """SELECT l.app_id, l.point_day, l.main, x.playtime, x.after, count(r.labeling_sk) AS labeled,
        CASE WHEN count(r.labeling_sk) > 0 THEN floor(count(r.labeling_sk) FILTER (WHERE r.critical)::DOUBLE / count(r.labeling_sk) * 1e6 + 0.5) / 1e6 END AS share
    FROM lab l CROSS JOIN (SELECT * FROM (VALUES ('<10 h', 0, 600), ('10-100 h', 600, 6000), ('>=100 h', 6000, 1000000000)) AS g(playtime, lo, hi), (VALUES (false), (true)) AS s(after)) x
    LEFT JOIN (SELECT q.app_id, q.day, q.labeling_sk, f.playtime_at_review_min AS minutes, k.category_id, k.category_id IS NOT NULL AS critical, c.main
               FROM (SELECT DISTINCT app_id, main FROM lab WHERE main IS NOT NULL) c JOIN t_labeled q ON q.app_id = c.app_id AND q.llm_config_sk = 1
               JOIN t_fact f USING (recommendation_id)
               LEFT JOIN (SELECT DISTINCT labeling_sk, category_id FROM t_aspect_tag WHERE llm_config_sk = 1 AND sentiment IN ('-', '±')) k
                 ON k.labeling_sk = q.labeling_sk AND k.category_id = c.main) r
      ON r.app_id = l.app_id AND r.main = l.main AND r.minutes >= x.lo AND r.minutes < x.hi
         AND CASE WHEN x.after THEN r.day >= l.point_day AND r.day < l.point_day + 7 ELSE r.day >= l.point_day - 7 AND r.day < l.point_day END
    WHERE l.main IS NOT NULL GROUP BY ALL"""


@query("playtime_segments", sql=chain("lab", PLAYED, *TEXTS))
def _(t):
    return Around(t).playtime


@query("support_reviews", sql=chain("support", "SELECT * FROM support", *TEXTS))
def _(t):
    return Around(t).support


@query("support_numbering", sql=chain("numbered", "SELECT * FROM numbered", *TEXTS))
def _(t):
    return Around(t).numbered


@query("review_language_lookup", sql=chain("spoken", "SELECT app_id, point_day, number, recommendation_id, language_code FROM spoken", *TEXTS))
def _(t):
    a = Around(t)
    return evidence.support_languages(a.numbered, t.t_fact, a.languages)


@query("excerpt_pick", sql=chain("spoken", """
    SELECT app_id, point_day, CAST(k AS INT) AS excerpt_rank, number, votes_up, text FROM (
        SELECT *, row_number() OVER (PARTITION BY app_id, point_day ORDER BY lang, votes_up DESC, number) AS k, min(lang) OVER (PARTITION BY app_id, point_day) AS best FROM (
            SELECT *, CASE language_code WHEN 'russian' THEN 0 WHEN 'english' THEN 1 ELSE 2 END AS lang FROM spoken)
    ) WHERE k <= 3 AND (lang < 2 OR best = 2)""", *TEXTS))
def _(t):
    a = Around(t)
    numbered = a.numbered
    spoken = evidence.support_languages(numbered, t.t_fact, a.languages)
    texts = evidence.with_texts(numbered, t.t_label, t.t_version).select(*POINT, "number", "votes_up", "text").distinct()
    return verdicts.excerpt_pick(texts.join(spoken.select(*POINT, "number", "language_code"), [*POINT, "number"]), POINT)


@query("evidence_bundle", sql=chain("numbered", """
    SELECT l.app_id, l.point_day, l.direction, l.significant,
           (SELECT string_agg(key, ',' ORDER BY rank) FROM movers m WHERE m.app_id = l.app_id AND m.point_day = l.point_day AND side = 'rising') AS rising,
           (SELECT string_agg(key, ',' ORDER BY rank) FROM movers m WHERE m.app_id = l.app_id AND m.point_day = l.point_day AND side = 'falling') AS falling,
           CASE WHEN l.significant THEN (SELECT string_agg(aspect_id, ',' ORDER BY CASE WHEN l.critique_up THEN -diff ELSE diff END, aspect_id) FROM asps a
               WHERE a.app_id = l.app_id AND a.point_day = l.point_day AND a.category_id = l.main) END AS subaspects,
           CASE WHEN l.significant THEN (SELECT string_agg(CAST(recommendation_id AS VARCHAR), ',' ORDER BY number) FROM (SELECT DISTINCT number, recommendation_id, app_id, point_day FROM numbered) n
               WHERE n.app_id = l.app_id AND n.point_day = l.point_day) END AS reviews,
           (SELECT count(*) FROM p_event e JOIN d_bounds b ON b.app_id = e.app_id AND e.day BETWEEN b.lo AND b.hi
            WHERE e.app_id = l.app_id AND abs(date_diff('day', e.day, l.point_day)) <= 3) AS news_count
    FROM lab l""", *TEXTS, "p_event"))
def _(t):
    b = Around(t).bundle

    def keys(c):
        return F.array_join(F.transform(c, lambda r: r["key"]), ",").alias(c)

    return b.select(
        *POINT, "labels.direction", "labels.significant", keys("rising"), keys("falling"), keys("subaspects"),
        F.array_join(F.transform("reviews", lambda r: r["recommendation_id"].cast("string")), ",").alias("reviews"), "news_count")


def _text(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN '-' ELSE concat(CAST(length({x}) AS VARCHAR), ':', {x}) END"


def _plain(x: str) -> str:
    return f"coalesce(CAST({x} AS VARCHAR), '-')"


def _millionths(x: str) -> str:
    return f"coalesce(CAST(CAST(floor({x} * 1e6::DOUBLE + 0.5::DOUBLE) AS BIGINT) AS VARCHAR), '-')"


def _record(*parts: str) -> str:
    return "concat('(', " + ", ',', ".join(parts) + ", ')')"


def _list(name: str, item: str, order: str, rows: str) -> str:
    return f"{name} AS (SELECT app_id, point_day, concat('[', string_agg({item}, ',' ORDER BY {order}), ']') AS v FROM {rows} GROUP BY 1, 2)"


TOPIC = _record(_text("key"), *[_millionths(c) for c in ("before", "after", "diff")], _plain("crit_before"), _plain("crit_after"))
NEWS_LINE = _record(_plain("news_day"), _text("title"), _text("event_type"), _millionths("weight"), _plain("major"))
SHOWN = f"CASE WHEN length(review_body) > {evidence.REVIEW_CHARS} THEN concat(left(review_body, {evidence.REVIEW_CHARS}), '…') ELSE review_body END"
# every part of the record as text, a table per part
RECORD_PARTS = ", ".join((
    _list("rising", TOPIC, "rank", "(SELECT * FROM movers WHERE side = 'rising')"),
    _list("falling", TOPIC, "rank", "(SELECT * FROM movers WHERE side = 'falling')"),
    _list("subs", TOPIC, "place, key", """(SELECT a.*, a.aspect_id AS key, CASE WHEN l.critique_up THEN -a.diff ELSE a.diff END AS place
        FROM asps a JOIN lab l USING (app_id, point_day) WHERE l.significant AND a.category_id = l.main)"""),
    f"played AS ({PLAYED})",
    _list("play", _record(_text("playtime"), _plain("after"), _plain("labeled"), _millionths("share")), "playtime, after",
          "(SELECT p.* FROM played p JOIN lab l USING (app_id, point_day) WHERE l.significant)"),
    _list("texts", _record(_plain("number"), _plain("recommendation_id"), _text("body")), "number",
          f"""(SELECT n.*, {SHOWN} AS body FROM (SELECT DISTINCT app_id, point_day, number, recommendation_id FROM numbered) n
              JOIN lab l USING (app_id, point_day) JOIN t_text USING (recommendation_id) WHERE l.significant)"""),
    _list("blocks", _record(_plain("block"), _plain("number")), "block, position",
          "(SELECT n.* FROM numbered n JOIN lab l USING (app_id, point_day) WHERE l.significant)"),
    f"near AS ({NEAR})",
    f"""told AS (SELECT n.app_id, n.point_day, d.news_day, n.title, n.event_type, n.weight, {SIGNIFICANT} AS major FROM near n JOIN (
        SELECT app_id, point_day, title, arg_min(event_day, struct_pack(a := abs(date_diff('day', point_day, event_day)), b := event_day)) AS news_day
        FROM near GROUP BY 1, 2, 3) d USING (app_id, point_day, title))""",
    f"""digests AS (SELECT app_id, point_day, count(*) AS n, concat(CAST(sum(CAST(concat('0x', substr(h, 1, 15)) AS BIGINT)) AS VARCHAR), ':',
        CAST(sum(CAST(concat('0x', substr(h, 17, 15)) AS BIGINT)) AS VARCHAR)) AS digest FROM (SELECT *, md5({NEWS_LINE}) AS h FROM told) GROUP BY 1, 2)""",
    f"beside AS (SELECT app_id, point_day, {_record(_plain('event_date'), _text('event_type'), _text('title'))} AS v FROM ({NEAREST}))",
))
NEWS_FLAG = "CASE WHEN d.n > 0 THEN 'yes' ELSE 'no' END"
KIND = "CASE WHEN significant THEN CASE WHEN critique_up THEN 'complaints' ELSE 'praise' END END"
RECORD = _record(
    _plain("l.app_id"), _plain("l.point_day"), _plain("l.point_day - 7"), _plain("l.point_day + 7"), _plain(str(CONFIG)),
    _record(_plain("before_reviews"), _plain("after_reviews"), _millionths("before_negative"), _millionths("after_negative")),
    _record(_text("direction"), _text("character"), _plain("critique_up"), _millionths("focus"), _millionths("se"), _plain("significant"), _text("main"),
            _millionths("main_diff"), _text("volume"), _text(f"({NEWS_FLAG})")),
    *[f"coalesce({part}.v, '-')" for part in ("rising", "falling", "subs", "play")],
    _text(f"({KIND})"), "coalesce(texts.v, '-')", "coalesce(blocks.v, '-')", "CAST(coalesce(d.n, 0) AS VARCHAR)", _text("d.digest"), "coalesce(beside.v, '-')")


@query("evidence_hash", sql=chain("numbered", f""", {RECORD_PARTS}
    SELECT app_id, point_day, significant, sha256({RECORD}) AS evidence_hash FROM lab l LEFT JOIN digests d USING (app_id, point_day)
    {' '.join(f'LEFT JOIN {part} USING (app_id, point_day)' for part in ('rising', 'falling', 'subs', 'play', 'texts', 'blocks', 'beside'))}""",
    *TEXTS, "p_event", "p_platform"))
def _(t):
    return evidence.evidence_hash(Around(t).bundle).select(*POINT, "labels.significant", "evidence_hash")


@query("verdict_worklist", sql=chain("lab", """
    SELECT app_id, point_day, CASE day(point_day) % 3 WHEN 0 THEN 'same' WHEN 1 THEN 'changed' ELSE 'new' END AS state,
           CASE WHEN day(point_day) % 3 <> 0 THEN CASE WHEN significant THEN 'model' ELSE 'template' END END AS author FROM lab"""))
def _(t):
    # the labels alone stand for the evidence; stored verdicts know a third of the points, and another third by an older hash
    labels = Around(t).labels
    known = labels.withColumn("evidence_hash", F.sha2(F.to_json(F.struct(*labels.columns)), 256)).select(*POINT, "significant", "evidence_hash")
    third = F.dayofmonth("point_day") % 3
    older = known.select("app_id", F.col("point_day").alias("change_date"), F.lit(7).alias("llm_config_sk"),
                         F.when(third == 0, F.col("evidence_hash")).otherwise(F.lit("older")).alias("evidence_hash"), third.alias("_third"))
    return verdicts.verdict_worklist(known, older.filter("_third < 2").drop("_third"), 7)


def _pct(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN 'нет данных' ELSE concat(CAST(CAST(floor({x} * 100 + 0.5) AS INT) AS VARCHAR), '%') END"


@query("template_verdict", sql=chain("lab", f"""
    SELECT app_id, point_day, concat('Доля отзывов с оценкой «не рекомендую» - ', {_pct('before_negative')}, ' за 7 дней до и ', {_pct('after_negative')}, ' после',
        CASE WHEN before_negative IS NULL OR after_negative IS NULL THEN '' ELSE concat(' (', CASE WHEN after_negative - before_negative < 0 THEN '-' ELSE '+' END,
            CAST(CAST(floor(abs(after_negative - before_negative) * 100 + 0.5) AS INT) AS VARCHAR), ' п.п.)') END,
        '; ни одна категория разметки не изменилась значимо.') AS what_happened FROM lab WHERE NOT significant"""))
def _(t):
    return evidence.template_verdict(Around(t).labels)


# --- stored verdicts ------------------------------------------------------------------------


def stored(t):
    """One verdict per customer."""
    return t.spark.sql("""
        SELECT c_custkey AS verdict_sk, CAST(c_nationkey % 5 + 1 AS INT) AS app_id, date_add(DATE'1998-01-01', CAST(c_custkey % 40 AS INT)) AS change_date,
               date_add(DATE'1997-12-25', CAST(c_custkey % 40 AS INT)) AS before_from, date_add(DATE'1998-01-08', CAST(c_custkey % 40 AS INT)) AS after_to,
               CAST(c_custkey % 3 AS INT) AS llm_config_sk, CAST(c_custkey % 2 AS INT) AS labeling_config_sk,
               CASE WHEN c_custkey % 5 = 0 THEN 'template' ELSE 'model' END AS author, CASE WHEN c_custkey % 7 = 0 THEN 'final' ELSE 'preliminary' END AS status,
               concat(c_name, ' fell [1, 2] after') AS what_happened, CASE WHEN c_custkey % 5 <> 0 THEN concat(c_mktsegment, ' [3]. ') END AS what_players_say,
               c_custkey % 4 <> 0 AS checks_passed, CAST(c_custkey % 1000 AS DOUBLE) / 1000D AS before_negative,
               CASE WHEN c_custkey % 9 <> 0 THEN CAST(c_custkey % 200 AS DOUBLE) / 1000D END AS after_negative,
               array(named_struct('text', concat('q', c_custkey)), named_struct('text', c_mktsegment)) AS excerpts,
               md5(CAST(c_custkey % 2 AS STRING)) AS evidence_hash, date_add(DATE'1998-03-01', CAST(c_custkey % 50 AS INT)) AS created_at FROM {customer}""",
        customer=t.table("customer"))


STORED = """SELECT c_custkey AS verdict_sk, CAST(c_nationkey % 5 + 1 AS INT) AS app_id, DATE '1998-01-01' + CAST(c_custkey % 40 AS INT) AS change_date,
    DATE '1997-12-25' + CAST(c_custkey % 40 AS INT) AS before_from, DATE '1998-01-08' + CAST(c_custkey % 40 AS INT) AS after_to,
    CAST(c_custkey % 3 AS INT) AS llm_config_sk, CAST(c_custkey % 2 AS INT) AS labeling_config_sk,
    CASE WHEN c_custkey % 5 = 0 THEN 'template' ELSE 'model' END AS author, CASE WHEN c_custkey % 7 = 0 THEN 'final' ELSE 'preliminary' END AS status,
    concat(c_name, ' fell after') AS what_happened, CASE WHEN c_custkey % 5 <> 0 THEN concat(c_mktsegment, '.') END AS what_players_say,
    c_custkey % 4 <> 0 AS checks_passed, CAST(c_custkey % 1000 AS DOUBLE) / 1000.0::DOUBLE AS before_negative,
    CASE WHEN c_custkey % 9 <> 0 THEN CAST(c_custkey % 200 AS DOUBLE) / 1000.0::DOUBLE END AS after_negative,
    concat('q', CAST(c_custkey AS VARCHAR), '; ', c_mktsegment) AS excerpts, md5(CAST(c_custkey % 2 AS VARCHAR)) AS evidence_hash, DATE '1998-03-01' + CAST(c_custkey % 50 AS INT) AS created_at FROM customer"""
CURRENT = f"""SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY app_id, change_date ORDER BY created_at DESC, verdict_sk DESC) AS k
    FROM ({STORED}) WHERE llm_config_sk IN (1, 2) AND labeling_config_sk = 1) WHERE k = 1"""


def current(t):
    rows = stored(t)
    generation = rows.select("llm_config_sk").distinct().filter("llm_config_sk > 0")
    labelers = rows.select(F.col("labeling_config_sk").alias("llm_config_sk")).distinct().filter("llm_config_sk = 1")
    return verdicts.verdict_current(rows, generation, labelers)


@query("verdict_current", sql=f"SELECT verdict_sk, app_id, change_date, llm_config_sk, labeling_config_sk, checks_passed, created_at FROM ({CURRENT})")
def _(t):
    return current(t).select("verdict_sk", "app_id", "change_date", "llm_config_sk", "labeling_config_sk", "checks_passed", "created_at")


TODAY = "1998-02-01"


@query("late_window_status", sql=f"SELECT verdict_sk, CASE WHEN DATE '{TODAY}' >= change_date + 10 THEN 'final' ELSE 'preliminary' END AS status FROM ({STORED})")
def _(t):
    return stored(t).select("verdict_sk", verdicts.late_window_status(F.col("change_date"), F.lit(TODAY).cast("date")).alias("status"))


@query("verdict_finalize", sql=f"""SELECT * FROM (WITH s AS ({STORED}), same AS (
    SELECT verdict_sk FROM (SELECT verdict_sk, row_number() OVER (PARTITION BY app_id, change_date ORDER BY created_at DESC, verdict_sk DESC) AS k
        FROM s WHERE llm_config_sk = 1 AND evidence_hash = md5('1')) WHERE k = 1)
    SELECT verdict_sk, CASE WHEN verdict_sk IN (SELECT verdict_sk FROM same) AND DATE '{TODAY}' >= change_date + 10 THEN 'final' ELSE status END AS status,
           CASE WHEN verdict_sk IN (SELECT verdict_sk FROM same) AND verdict_sk % 3 = 0 THEN concat('n', CAST(verdict_sk AS VARCHAR)) ELSE excerpts END AS excerpts FROM s)""")
def _(t):
    rows = stored(t)
    fresh = rows.select("app_id", F.col("change_date").alias("point_day"), F.md5(F.lit("1")).alias("evidence_hash")).distinct()
    # a third of the verdicts have their excerpts picked anew; only those whose evidence still holds show them
    picked = rows.filter("verdict_sk % 3 = 0").select("verdict_sk", F.expr("array(named_struct('text', concat('n', verdict_sk)))").alias("excerpts"))
    shown = F.array_join(F.transform("excerpts", lambda e: e["text"]), "; ")
    return verdicts.verdict_finalize(rows, fresh, TODAY, 1, picked).select("verdict_sk", "status", shown.alias("excerpts"))


@query("verdict_report", sql=f"""SELECT app_id, change_date AS "day", before_from, after_to, status = 'preliminary' AS preliminary, checks_passed AS checked,
    CAST(floor(before_negative * 100 + 0.5) AS INT) AS negative_before, CAST(floor(after_negative * 100 + 0.5) AS INT) AS negative_after,
    CASE WHEN checks_passed THEN what_happened END AS what_happened, CASE WHEN checks_passed AND author = 'model' THEN what_players_say END AS what_players_say,
    CASE WHEN checks_passed AND author = 'model' THEN excerpts END AS excerpts FROM ({CURRENT})""")
def _(t):
    return verdicts.verdict_report(current(t)).withColumn("excerpts", F.array_join("excerpts", "; "))


@lru_cache(maxsize=1)
def _vocabulary() -> tuple:
    return tuple(f"aspect_{i}" for i in range(1, 44)) + tuple(f"cat_{i}" for i in range(11))


# generated texts with one fault each, and the rules that have to find them, written down by hand
LINT_RISE = "Негативных оценок стало больше: с 21% до 30% за неделю с 4 марта."
LINT_SERVERS = "Серверы упоминали 5% до и 19% после."
LINT_WHAT = f"{LINT_RISE} {LINT_SERVERS} Студия 2 марта опубликовала график работ."
LINT_TALK = "В отзывах ругают долгую очередь на вход и обрывы [2, 6]. Несколько человек просят вернуть прежний подбор команд [9]."
LINT_CASES = (
    (LINT_WHAT, LINT_TALK, ""),
    (f"{LINT_WHAT} Сбой спровоцировал волну отзывов.", LINT_TALK, "causal wording"),
    (f"{LINT_WHAT} Об этом пишут в [2, 6].", LINT_TALK, "review numbers"),
    (f"{LINT_WHAT} Сдвиг сфокусирован.", LINT_TALK, "label word"),
    (f"{LINT_RISE} Про серверы писали 5%, стало 19%.", LINT_TALK, "pair without before and after"),
    (f"{LINT_WHAT} Споры о серверах не увеличились.", LINT_TALK, "not grown while main topic grew"),
    (f"{LINT_WHAT} Вывод опирается на сотню отзывов.", LINT_TALK, "volume mentioned at enough volume"),
    ("Жалобы поднялись с 21% до 30% за неделю с 4 марта.", LINT_TALK, "vote share called complaints"),
    (f"{LINT_WHAT} График работ - удобный повод.", LINT_TALK, "occasion without news or with focus"),
    (f"{LINT_WHAT} Это заметили и в 东京.", LINT_TALK, "foreign letters"),
    (f"{LINT_WHAT} Тема server_load.", LINT_TALK, "taxonomy id"),
    (f"{LINT_RISE} Тему Queue and servers упоминали 5% до и 19% после.", LINT_TALK, "taxonomy name"),
    (LINT_WHAT, "Вход занимает час. Матчи обрываются [6].", "statement without support"),
    (LINT_WHAT, "Вход занимает час [2, 17].", "unknown review number"),
    (LINT_WHAT, "Вход занимает час [99999999999999999999999].", "unknown review number"),
    (LINT_WHAT, " ", "missing field"),
    (f"{LINT_WHAT} Сбой спровоцировал волну отзывов. Об этом пишут в [2, 6].", "Ошибка «接続» при входе.",
     "causal wording;foreign letters;review numbers;statement without support"),
)


def _lint_case(place: int) -> str:
    whens = " ".join(f"WHEN {i} THEN '{case[place]}'" for i, case in enumerate(LINT_CASES))
    return f"CASE CAST(c_custkey % {len(LINT_CASES)} AS INT) {whens} END"


@query("verdict_lint", sql=f"SELECT c_custkey, {_lint_case(2)} AS rules, {_lint_case(2)} = '' AS checks_passed FROM customer")
def _(t):
    """One generated text per customer; every rule fails some of them, and some are without fault."""
    texts = t.table("customer").select(
        "c_custkey", F.to_json(F.struct(F.expr(_lint_case(0)).alias("what_happened"), F.expr(_lint_case(1)).alias("what_players_say"))).alias("content"))
    facts = verdicts.verdict_fields(texts).select(
        "c_custkey", "what_happened", "what_players_say", F.lit("yes").alias("news"), F.lit("focused").alias("character"), F.lit("enough").alias("volume"),
        F.lit(0.14).alias("main_diff"), F.lit(0.21).alias("before_negative"), F.lit(0.30).alias("after_negative"),
        F.array(*[F.lit(n) for n in (2, 6, 9, 11)]).cast("array<bigint>").alias("known_numbers"))
    linted = verdicts.verdict_lint(facts, ["Queue and servers", "login_queue", "other"])
    rules = F.array_join(F.array_sort(F.array_distinct(F.transform("problems", lambda p: p["rule"]))), ";")
    return linted.select("c_custkey", rules.alias("rules"), "checks_passed")


LINT_CITED = {LINT_TALK: "2,6,9", "Вход занимает час. Матчи обрываются [6].": "6", "Вход занимает час [2, 17].": "2"}
LINT_SHOWN = {"2,6,9": "r6,r2", "6": "r6", "2": "r2"}
LINT_RAW = json.dumps({"what_happened": LINT_WHAT, "what_players_say": " "}, ensure_ascii=False)
CALL = {"prompt_tokens": 100, "completion_tokens": 10}


def lint_writer():
    """Stands in for the model: answers with the case its prompt names, every third case without fault when asked again.

    The faultless case is cut at first where the prompt says so, and case 4 has no usage. A nested function, so that it
    travels to the executors by value.
    """
    cases, call = [case[:2] for case in LINT_CASES], CALL

    def answer(prompt: str, attempt: int) -> tuple[str, str, dict]:
        import json

        number, cut = (int(x) for x in prompt.split())
        what, talk = cases[0 if attempt == 2 and number % 3 == 0 else number]
        content = json.dumps({"what_happened": what, "what_players_say": talk}, ensure_ascii=False)
        return content, "length" if cut and attempt == 1 else "stop", {} if number == 4 else call

    return answer


def _final_case(values: list[str]) -> str:
    whens = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE CASE WHEN number % 3 = 0 THEN 0 ELSE number END {whens} END"


FINAL_CITED = [LINT_CITED.get(talk, "") for _, talk, _ in LINT_CASES]


@query("verdict_run", sql=f"""
    SELECT app_id, point_day, CASE WHEN number < 0 THEN 'template' ELSE 'model' END AS author,
           CASE WHEN DATE '{TODAY}' >= point_day + 10 THEN 'final' ELSE 'preliminary' END AS status,
           CASE WHEN number < 0 THEN 'text of a template' ELSE {_final_case([LINT_RAW if talk == ' ' else what for what, talk, _ in LINT_CASES])} END AS what_happened,
           CASE WHEN number >= 0 THEN nullif({_final_case([talk.strip() for _, talk, _ in LINT_CASES])}, '') END AS what_players_say,
           CASE WHEN number < 0 THEN '' ELSE {_final_case([rules for _, _, rules in LINT_CASES])} END AS rules,
           CASE WHEN number < 0 THEN '' ELSE {_final_case(FINAL_CITED)} END AS cited,
           CASE WHEN number < 0 THEN '' ELSE {_final_case([LINT_SHOWN.get(c, '') for c in FINAL_CITED])} END AS excerpts,
           attempts, CASE WHEN number < 0 OR number = 4 THEN 0 ELSE 100 * attempts END::BIGINT AS input_tokens,
           CASE WHEN number < 0 OR number = 4 THEN 0 ELSE 10 * attempts END::BIGINT AS output_tokens,
           CASE WHEN number < 0 THEN 0 WHEN number <> 4 THEN 42 * attempts END::BIGINT AS micro_cost
    FROM (SELECT *, CAST(CASE WHEN number < 0 OR number = 0 AND c_custkey % {2 * len(LINT_CASES)} <> 0 THEN 1 ELSE 2 END AS INT) AS attempts
          FROM (SELECT c_custkey, CAST(c_custkey AS INT) AS app_id, DATE '1998-01-01' + CAST(c_custkey % 40 AS INT) AS point_day,
                       CASE WHEN c_custkey % 5 = 4 THEN -1 ELSE CAST(c_custkey % {len(LINT_CASES)} AS INT) END AS number FROM customer))""")
def _(t):
    """One point per customer: template texts, model texts that pass, pass when asked again, or stay with their faults."""
    customers = t.table("customer").select(
        F.col("c_custkey").cast("int").alias("app_id"), F.expr("date_add(DATE'1998-01-01', CAST(c_custkey % 40 AS INT))").alias("point_day"), "c_custkey")
    cases = len(LINT_CASES)
    points = customers.select(
        "app_id", "point_day", F.expr("CASE WHEN c_custkey % 5 = 4 THEN 'template' ELSE 'model' END").alias("author"), F.lit("text of a template").alias("template"),
        F.expr(f"concat(c_custkey % {cases}, ' ', CASE WHEN c_custkey % {2 * cases} = 0 THEN 1 ELSE 0 END)").alias("prompt"),
        F.lit("yes").alias("news"), F.lit("focused").alias("character"), F.lit("enough").alias("volume"),
        F.lit(0.14).alias("main_diff"), F.lit(0.21).alias("before_negative"), F.lit(0.30).alias("after_negative"),
        F.array(*[F.lit(n) for n in (2, 6, 9, 11)]).cast("array<bigint>").alias("known_numbers"))
    reviews = customers.select("app_id", "point_day", F.explode(F.array(*[
        F.struct(F.lit(n).cast("bigint").alias("number"), F.lit(n).alias("votes_up"), F.lit(language).alias("language_code"), F.lit(f"r{n}").alias("text"))
        for n, language in ((2, "english"), (6, "russian"), (9, "german"), (11, "russian"))])).alias("r")).select("app_id", "point_day", "r.*")
    run = verdicts.verdict_run(points, lint_writer(), ["Queue and servers", "login_queue", "other"], PRICES, TODAY)
    shown = verdicts.verdict_excerpts(run, reviews)
    return shown.select(
        "app_id", "point_day", "author", "status", "what_happened", "what_players_say",
        F.array_join(F.array_sort(F.array_distinct(F.transform("checks", lambda p: p["rule"]))), ";").alias("rules"),
        F.array_join(F.col("support_numbers").cast("array<string>"), ",").alias("cited"),
        F.array_join(F.transform(F.coalesce("excerpts", F.array().cast(shown.schema["excerpts"].dataType)), lambda e: e["text"]), ",").alias("excerpts"),
        "attempts", "input_tokens", "output_tokens", F.round(F.col("cost_usd") * 1e6).cast("bigint").alias("micro_cost"))


@query("verdict_cost_estimate", sql="""
    SELECT app_id, n, chars, floor(((n * 2000 + chars / 3.0::DOUBLE) * 0.3 + n * 350 * 1.2)::DOUBLE + 0.5) AS micro_cost
    FROM (SELECT CAST(c_nationkey % 5 + 1 AS INT) AS app_id, count(*) AS n, CAST(sum(length(c_name)) AS BIGINT) AS chars FROM customer GROUP BY 1)""")
def _(t):
    prompts = t.table("customer").select((F.col("c_nationkey") % 5 + 1).cast("int").alias("app_id"), F.col("c_name").alias("prompt"))
    cost = planning.estimate_verdicts(prompts, 11000, PRICES)
    return cost.select("app_id", "n", "chars", F.floor(F.col("cost") * 1e6 + 0.5).cast("double").alias("micro_cost"))


@query("verdict_lint_turns")
def _(t):
    """Whole conversation turns as generated texts: the user's turn says what happened, the answer what players say."""
    talk = t.table("conversations").groupBy("conv_id", F.floor(F.col("turn") / 2).alias("pair")).agg(
        F.max(F.when(F.col("turn") % 2 == 0, F.col("text"))).alias("even"), F.max(F.when(F.col("turn") % 2 == 1, F.col("text"))).alias("odd"))
    answers = talk.select("conv_id", "pair", F.to_json(F.struct(F.col("even").alias("what_happened"), F.col("odd").alias("what_players_say"))).alias("content"))
    facts = verdicts.verdict_fields(answers).select(
        "conv_id", "pair", "what_happened", "what_players_say", F.lit("no").alias("news"), F.lit("focused").alias("character"), F.lit("enough").alias("volume"),
        F.lit(0.1).alias("main_diff"), F.lit(0.11).alias("before_negative"), F.lit(0.14).alias("after_negative"),
        F.sequence(F.lit(1), F.lit(3)).cast("array<bigint>").alias("known_numbers"))
    linted = verdicts.verdict_lint(facts, list(_vocabulary()))
    return linted.select("conv_id", "pair", "checks_passed", F.inline_outer("problems"))
