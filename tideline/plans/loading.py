"""Queries over landing pages, dimensions, merges, incremental and streaming loads, scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.functions import dates, numbers, text, titles
from tideline.operators import facts, games, paging, quality
from tideline.plans.catalog import query
from tideline.plans.frames import BODY, TITLE, duck
from tideline.session import scratch_path, spread, written
from tideline.sources import dims, files, raw
from tideline.streaming import reviews as stream


def _ntz(name: str):
    return F.col(name).cast("timestamp_ntz").alias(name)


# --- landing pages --------------------------------------------------------------------------

EVENT_LANGUAGE = "CASE event_type WHEN 'view' THEN 'english' WHEN 'click' THEN 'russian' WHEN 'error' THEN '' ELSE event_type END"


def review_pages(t):
    """The events table as landing pages: one hundred reviews a page, one JSON document each."""
    item = F.struct(
        F.col("event_id").cast("string").alias("recommendationid"),
        F.expr(EVENT_LANGUAGE).alias("language"), F.col("props").alias("review"),
        F.unix_seconds("ts").alias("timestamp_created"),
        F.expr("CASE WHEN event_id % 3 = 0 THEN 0 ELSE unix_seconds(ts) + 60 END").alias("timestamp_updated"),
        F.lit(0).alias("timestamp_dev_responded"), (F.col("event_type") != "error").alias("voted_up"),
        F.floor("value").cast("int").alias("votes_up"),
        F.expr("CASE WHEN event_id % 4 <> 0 THEN CAST(event_id % 9 AS INT) END").alias("votes_funny"),
        F.expr("CAST(user_id % 5 AS INT)").alias("comment_count"), F.lit("0.52380001").alias("weighted_vote_score"),
        (F.col("event_type") == "purchase").alias("steam_purchase"), F.lit(False).alias("received_for_free"),
        F.lit(False).alias("written_during_early_access"),
        F.struct(
            F.expr("CASE WHEN user_id % 7 = 0 THEN '' ELSE CAST(user_id AS STRING) END").alias("steamid"),
            (F.col("user_id") * 10).cast("int").alias("playtime_at_review"),
            (F.col("user_id") * 20).cast("int").alias("playtime_forever")).alias("author"))
    page = F.floor(F.col("event_id") / 100).cast("bigint")
    return (
        t.table("events").groupBy(page.alias("raw_id"))
        .agg(F.max("ts").alias("fetched_at"), F.sort_array(F.collect_list(item)).alias("reviews"))
        .select("raw_id", (F.col("raw_id") % 5 + 1).cast("int").alias("app_id"), F.lit("*").alias("cursor_in"), "fetched_at",
                F.to_json(F.struct(F.lit("next").alias("cursor"), "reviews")).alias("payload"))
    )


def news_pages(t):
    """The orders table as news pages of one hundred items."""
    item = F.struct(
        F.col("patch_sk"), "gid", "title", F.concat(F.lit("https://news/"), "gid").alias("url"), "feedname",
        "feed_type", F.expr("repeat('b', CAST(body_length AS INT))").alias("contents"),
        F.unix_seconds("published_at").alias("date"))
    page = F.floor(F.col("patch_sk") / 100).cast("bigint")
    return (
        t.patches.groupBy(page.alias("raw_id"))
        .agg(F.max("published_at").alias("fetched_at"), F.sort_array(F.collect_list(item)).alias("newsitems"))
        .select("raw_id", (F.col("raw_id") % 5 + 1).cast("int").alias("app_id"), "fetched_at",
                F.to_json(F.struct(F.struct("newsitems").alias("appnews"))).alias("payload"))
    )


PAGES = "SELECT event_id // 100 AS raw_id, CAST(event_id // 100 % 5 + 1 AS INT) AS app_id, max(ts) AS fetched_at, count(*) AS items FROM events GROUP BY 1, 2"


@query("scan_raw_pages", sql=PAGES)
def _(t):
    path = scratch_path(t.spark, "landing")
    raw.append_raw(review_pages(t), path)
    return raw.read_raw(t.spark, path, "reviews").select(
        "raw_id", "app_id", _ntz("fetched_at"),
        F.json_array_length(F.get_json_object("payload", "$.reviews")).cast("bigint").alias("items"))


@query("append_raw_pages", sql="SELECT event_id // 100 AS raw_id, CAST(event_id // 100 % 5 + 1 AS INT) AS app_id FROM events GROUP BY 1, 2")
def _(t):
    path = scratch_path(t.spark, "landing")
    pages = written(review_pages(t), "fetched")
    # all pages are fetched again; only those with something new are appended
    for fetched in (pages.filter(F.col("fetched_at") < F.lit("2024-01-16").cast("timestamp")), pages):
        raw.append_new(fetched, raw.explode_reviews(fetched), path)
    return raw.read_raw(t.spark, path, "reviews").select("raw_id", "app_id")


@query("explode_reviews", sql=f"""
    SELECT event_id AS recommendation_id, event_id // 100 AS raw_id, CAST(event_id // 100 % 5 + 1 AS INT) AS app_id,
           nullif({EVENT_LANGUAGE}, '') AS language_code, props AS review_body,
           CASE WHEN user_id % 7 <> 0 THEN user_id END AS author_steam_id, date_trunc('second', ts) AS created_at,
           CASE WHEN event_id % 3 <> 0 THEN date_trunc('second', ts) + to_seconds(60) END AS updated_at,
           NULL::TIMESTAMP AS dev_responded_at, event_type <> 'error' AS is_voted_up, CAST(floor(value) AS INT) AS votes_up,
           CAST(CASE WHEN event_id % 4 <> 0 THEN event_id % 9 ELSE 0 END AS INT) AS votes_funny, CAST(user_id % 5 AS INT) AS comment_count,
           0.52380001::DOUBLE AS weighted_vote_score, CAST(user_id * 10 AS INT) AS playtime_at_review_min,
           NULL::INT AS playtime_last_two_weeks_min, event_type = 'purchase' AS steam_purchase FROM events""")
def _(t):
    r = raw.explode_reviews(review_pages(t))
    return r.select(
        "recommendation_id", "raw_id", "app_id", "language_code", "review_body", "author_steam_id", _ntz("created_at"),
        _ntz("updated_at"), _ntz("dev_responded_at"), "is_voted_up", "votes_up", "votes_funny", "comment_count",
        F.col("weighted_vote_score").cast("double").alias("weighted_vote_score"), "playtime_at_review_min",
        "playtime_last_two_weeks_min", "steam_purchase")


@query("explode_news", "p_patch", sql="""
    SELECT patch_sk // 100 AS raw_id, gid, title, feedname, feed_type, CAST(body_length AS INT) AS body_length, published_at FROM p_patch""")
def _(t):
    return raw.explode_news(news_pages(t)).select("raw_id", "gid", "title", "feedname", "feed_type", "body_length", _ntz("published_at"))


@query("exclude_feeds", "p_patch", sql="SELECT patch_sk, app_id, feedname FROM p_patch WHERE feedname NOT IN ('SteamDB') AND app_id <> 753")
def _(t):
    return raw.exclude_feeds(t.patches).select("patch_sk", "app_id", "feedname")


# --- product cards --------------------------------------------------------------------------

RELEASE_FORMATS = ("%-d %b, %Y", "%b %-d, %Y", "%-d %B, %Y", "%B %-d, %Y", "%Y")
SPARK_RELEASE_FORMATS = ("d MMM, yyyy", "MMM d, yyyy", "d MMMM, yyyy", "MMMM d, yyyy", "yyyy")


def _release_raw(engine: str) -> str:
    day = "date_add(DATE'2000-01-01', CAST(p_partkey AS INT))" if engine == "spark" else "(DATE '2000-01-01' + CAST(p_partkey AS INT))"
    fn, formats = ("date_format", SPARK_RELEASE_FORMATS) if engine == "spark" else ("strftime", RELEASE_FORMATS)
    whens = " ".join(f"WHEN {i} THEN {fn}({day}, '{f}')" for i, f in enumerate(formats))
    return f"CASE CAST(p_partkey % 7 AS INT) {whens} WHEN 5 THEN 'Coming soon' ELSE NULL END"


PARSED_RELEASE = """CASE WHEN p_partkey % 7 < 4 THEN DATE '2000-01-01' + CAST(p_partkey AS INT)
    WHEN p_partkey % 7 = 4 THEN make_date(year(DATE '2000-01-01' + CAST(p_partkey AS INT)), 1, 1) END"""
CARD_CASE = "CAST(p_partkey % 6 AS INT)"


def card_pages(t):
    """The part table as product cards, with the keys and inner ids landing pages really show."""
    part = spread(t.table("part")).withColumn("release_raw", F.expr(_release_raw("spark")))

    def card(inner):
        return F.struct(
            F.lit(True).alias("success"),
            F.struct(
                inner.alias("steam_appid"), F.col("p_name").alias("name"),
                F.expr("CASE WHEN p_size % 4 = 0 THEN 'dlc' ELSE 'game' END").alias("type"), (F.col("p_size") % 2 == 0).alias("is_free"),
                F.expr("CASE WHEN p_size % 3 = 0 THEN CAST(p_size AS STRING) END").alias("required_age"),
                F.struct(F.col("p_size").alias("score"), F.concat(F.lit("https://score/"), F.col("p_partkey").cast("string")).alias("url")).alias("metacritic"),
                F.struct(F.col("release_raw").alias("date"), F.expr("CASE WHEN p_partkey % 7 = 5 THEN true END").alias("coming_soon")).alias("release_date"),
                F.array("p_brand").alias("developers"), F.array("p_brand", "p_type", "p_brand").alias("publishers"),
                F.array(F.struct(F.col("p_size").cast("string").alias("id"), F.col("p_type").alias("description"))).alias("genres"),
                F.expr("CASE WHEN p_size % 5 <> 0 THEN array(struct(p_size + 100 AS id, p_brand AS description)) END").alias("categories"),
            ).alias("data"))

    key = F.col("p_partkey").cast("string")
    foreign = F.concat(F.lit("9"), key)
    inner = F.col("p_partkey").cast("int")
    none = F.lit(None).cast("int")
    other = F.map_from_arrays(F.array(F.lit("77"), key), F.array(card(F.lit(77)), card(inner)))
    payload = (
        F.when(F.expr(f"{CARD_CASE} = 0"), F.to_json(F.create_map(key, card(inner))))
        .when(F.expr(f"{CARD_CASE} = 1"), F.to_json(F.create_map(foreign, card(inner))))
        .when(F.expr(f"{CARD_CASE} = 2"), F.to_json(F.create_map(foreign, card(inner + 1))))
        .when(F.expr(f"{CARD_CASE} = 3"), F.to_json(F.create_map(key, F.struct(F.lit(False).alias("success")))))
        .when(F.expr(f"{CARD_CASE} = 4"), F.to_json(other))
        .otherwise(F.to_json(F.create_map(foreign, card(none)))))
    return part.select(
        F.col("p_partkey").alias("raw_id"), inner.alias("app_id"), F.lit("2024-01-01").cast("timestamp").alias("fetched_at"),
        F.lit(200).alias("http_status"), payload.alias("payload"))


PICKED = f"{CARD_CASE} IN (0, 1, 4, 5)"


@query("pick_app_card", sql=f"""
    SELECT CAST(p_partkey AS INT) AS app_id, CASE WHEN {PICKED} THEN true WHEN {CARD_CASE} = 3 THEN false END AS success,
           CASE WHEN {PICKED} THEN p_name END AS name, CASE WHEN {CARD_CASE} IN (0, 1, 4) THEN CAST(p_partkey AS VARCHAR) END AS inner_id FROM part""")
def _(t):
    return raw.pick_card(card_pages(t)).select(
        "app_id", F.col("card.success").alias("success"), F.col("card.data.name").alias("name"), F.col("card.data.steam_appid").alias("inner_id"))


@query("only_games", sql=f"""
    SELECT CAST(p_partkey AS INT) AS app_id, CASE WHEN NOT {PICKED} THEN 'no data' WHEN p_size % 4 = 0 THEN 'not a game: dlc' END AS refused FROM part""")
def _(t):
    return raw.only_games(raw.pick_card(card_pages(t))).select("app_id", "refused")


def picked_games(t):
    return raw.extract_game(raw.pick_card(raw.newest_cards(card_pages(t))).filter("card.success"))


GAME_FIELDS = f"""SELECT CAST(p_partkey AS INT) AS app_id, p_name AS game_name, CASE WHEN p_size % 4 = 0 THEN 'dlc' ELSE 'game' END AS app_type,
    p_size % 2 = 0 AS is_free, CAST(CASE WHEN p_size % 3 = 0 THEN p_size ELSE 0 END AS INT) AS required_age, p_size AS metacritic_score,
    concat('https://score/', CAST(p_partkey AS VARCHAR)) AS metacritic_url, p_partkey % 7 = 5 AS is_coming_soon,
    {_release_raw('duck')} AS release_date_raw, {PARSED_RELEASE} AS release_date_parsed FROM part WHERE {PICKED}"""


@query("extract_game_fields", sql=GAME_FIELDS)
def _(t):
    return picked_games(t).drop("fetched_at")


@query("extract_game_links", sql=f"""
    SELECT CAST(p_partkey AS INT) AS app_id, 'developer' AS link_type, NULL::INT AS link_id, p_brand AS link_name FROM part WHERE {PICKED}
    UNION ALL SELECT CAST(p_partkey AS INT), 'publisher', NULL, p_brand FROM part WHERE {PICKED}
    UNION ALL SELECT CAST(p_partkey AS INT), 'publisher', NULL, p_type FROM part WHERE {PICKED}
    UNION ALL SELECT CAST(p_partkey AS INT), 'genre', p_size, p_type FROM part WHERE {PICKED}
    UNION ALL SELECT CAST(p_partkey AS INT), 'category', p_size + 100, p_brand FROM part WHERE {PICKED} AND p_size % 5 <> 0""")
def _(t):
    return raw.extract_links(raw.pick_card(card_pages(t)))


# the surrogate key of a text whose parts are already marked by their lengths
STATIC_KEY = """CAST(CAST(concat('0x', substr(md5({0}), 1, 15)) AS BIGINT)::HUGEINT * 1152921504606846976
    + CAST(concat('0x', substr(md5({0}), 16, 15)) AS BIGINT) AS VARCHAR)"""


@query("link_dimensions", sql=f"""SELECT * FROM (WITH picked AS (SELECT * FROM part WHERE {PICKED}),
    told AS (SELECT 'genre' AS kind, p_size AS id, arg_max(p_type, p_partkey) AS name FROM picked GROUP BY 2
             UNION ALL SELECT 'category', p_size + 100, arg_max(p_brand, p_partkey) FROM picked WHERE p_size % 5 <> 0 GROUP BY 2)
    SELECT kind, CAST(id AS VARCHAR) AS id, name FROM told
    UNION ALL SELECT 'genre', CAST(r_regionkey AS VARCHAR), r_name FROM region WHERE r_regionkey NOT IN (SELECT id FROM told WHERE kind = 'genre')
    UNION ALL SELECT 'company', {STATIC_KEY.format("concat('7:company', length(name), ':', name)")}, name
    FROM (SELECT p_brand AS name FROM picked UNION SELECT p_type FROM picked))""")
def _(t):
    """Companies, genres and categories of all cards; stored names of genres are overwritten by the card read last."""
    # written once: every dimension reads the links again
    links = written(raw.extract_links(raw.pick_card(card_pages(t))), "links")
    ids = links.select("link_type", "app_id", F.col("link_id").alias("id"), F.col("link_name").alias("name"))
    stored = t.table("region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))
    genres = games.upsert_names(stored, ids.filter("link_type = 'genre'"), "id", "name", "app_id")
    categories = games.upsert_names(stored.filter("id < 0"), ids.filter("link_type = 'category'"), "id", "name", "app_id")
    none = t.spark.createDataFrame([], f"company_sk {numbers.KEY_TYPE}, company_name string")
    companies = games.upsert_companies(none, ids.filter("link_type IN ('developer', 'publisher')").select(F.col("name").alias("company_name")))
    return (
        genres.select(F.lit("genre").alias("kind"), F.col("id").cast("string").alias("id"), "name")
        .unionByName(categories.select(F.lit("category").alias("kind"), F.col("id").cast("string").alias("id"), "name"))
        .unionByName(companies.select(F.lit("company").alias("kind"), F.col("company_sk").cast("string").alias("id"), F.col("company_name").alias("name"))))


# --- files, calendar ------------------------------------------------------------------------


@query("load_aspect_codebook", sql="""
    SELECT 'v1' AS codebook_version, concat('a', CAST(n_nationkey AS VARCHAR)) AS aspect_id, n_name AS aspect_name,
           concat('About ', n_name) AS aspect_definition, concat('c', CAST(r_regionkey AS VARCHAR)) AS category_id, r_name AS category_name,
           concat('All of ', r_name) AS category_definition FROM nation JOIN region ON n_regionkey = r_regionkey
    UNION ALL SELECT 'v1', 'other', 'Other', 'Topic outside the codebook, named by a short label in note.', 'other', 'Other', 'Topics outside the codebook.'""")
def _(t):
    nation, region = t.table("nation"), t.table("region")
    sub = F.struct(F.concat(F.lit("a"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("name"),
                   F.concat(F.lit("About "), "n_name").alias("definition"))
    categories = nation.join(region, nation["n_regionkey"] == region["r_regionkey"]).groupBy("r_regionkey", "r_name").agg(
        F.sort_array(F.collect_list(sub)).alias("subaspects"))
    one = F.struct(F.concat(F.lit("c"), F.col("r_regionkey").cast("string")).alias("id"), F.col("r_name").alias("name"),
                   F.concat(F.lit("All of "), "r_name").alias("definition"), "subaspects")
    book = categories.groupBy().agg(F.sort_array(F.collect_list(one)).alias("categories")).select(F.lit("v1").alias("version"), "categories")
    path = scratch_path(t.spark, "codebook")
    book.write.json(path)
    return files.read_codebook(t.spark, path)


@query("load_gold_labels", sql="""
    SELECT l_orderkey AS recommendation_id, CAST(l_partkey % 45 AS VARCHAR) AS aspect_id,
           arg_max(l_returnflag, struct_pack(a := l_linenumber, b := l_partkey, c := l_suppkey, d := l_returnflag)) AS sentiment
    FROM lineitem GROUP BY 1, 2""")
def _(t):
    tag = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    nested = t.table("lineitem").groupBy(F.col("l_orderkey").cast("string").alias("id")).agg(F.sort_array(F.collect_list(tag)).alias("x"))
    gold = nested.select("id", F.transform("x", lambda x: F.struct(
        (x["l_partkey"] % 45).cast("string").alias("id"), x["l_returnflag"].alias("sentiment"))).alias("aspects"))
    path = scratch_path(t.spark, "gold")
    gold.write.json(path)
    return files.gold_rows(t.spark.read.schema(files.GOLD_SCHEMA).json(path))


@query("read_id_list", sql="SELECT doc_id AS recommendation_id FROM documents")
def _(t):
    line = F.expr("CASE WHEN doc_id % 3 = 0 THEN concat('# checked\\n  ', doc_id, '  ') WHEN doc_id % 3 = 1 THEN concat(doc_id, '\\n\\n') ELSE CAST(doc_id AS STRING) END")
    path = scratch_path(t.spark, "ids")
    t.table("documents").select(line.alias("value")).write.text(path)
    return files.read_ids(t.spark, path)


@query("dim_date", sql="""
    SELECT CAST(strftime(d, '%Y%m%d') AS INT) AS date_sk, d AS full_date, CAST(year(d) AS INT) AS year, CAST(quarter(d) AS INT) AS quarter,
           CAST(month(d) AS INT) AS month, strftime(d, '%B') AS month_name, CAST(day(d) AS INT) AS "day", CAST(isodow(d) AS INT) AS day_of_week,
           strftime(d, '%A') AS day_name, CAST(week(d) AS INT) AS week_of_year, isodow(d) >= 6 AS is_weekend, false AS is_holiday,
           coalesce(n, 0) AS news
    FROM (SELECT CAST(unnest(generate_series(min(o_orderdate), max(o_orderdate), INTERVAL 1 DAY)) AS DATE) AS d FROM orders)
    LEFT JOIN (SELECT CAST(o_orderdate AS DATE) AS od, count(*) AS n FROM orders GROUP BY 1) ON od = d""")
def _(t):
    orders = t.table("orders")
    bounds = orders.agg(F.to_date(F.min("o_orderdate")).alias("first_day"), F.to_date(F.max("o_orderdate")).alias("last_day"))
    per_day = orders.groupBy(F.to_date("o_orderdate").alias("full_date")).agg(F.count("*").alias("news"))
    return dims.calendar_between(bounds).join(per_day, "full_date", "left").withColumn("news", F.coalesce("news", F.lit(0)))


@query("dim_time", sql="""
    SELECT CAST(h AS SMALLINT) AS time_sk, concat(lpad(CAST(h AS VARCHAR), 2, '0'), ':00') AS hour_label,
           CASE WHEN h <= 5 THEN 'night' WHEN h <= 11 THEN 'morning' WHEN h <= 17 THEN 'day' ELSE 'evening' END AS daypart,
           h BETWEEN 17 AND 23 AS is_peak, (SELECT count(*) FROM events WHERE hour(ts) = h) AS reviews FROM range(24) AS r(h)""")
def _(t):
    counts = t.table("events").groupBy(dates.hour_key(F.col("ts")).alias("time_sk")).agg(F.count("*").alias("reviews"))
    return dims.dim_time(t.spark).join(counts, "time_sk", "left").withColumn("reviews", F.coalesce("reviews", F.lit(0)))


@query("write_mart", "p_daily", sql="SELECT * FROM p_daily")
def _(t):
    return files.write_mart(t.daily, scratch_path(t.spark, "mart"))


# --- facts ----------------------------------------------------------------------------------

NEWEST = """SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY recommendation_id ORDER BY fetched_at DESC, raw_id DESC) AS k
    FROM p_review {where}) WHERE k = 1"""


@query("latest_per_key", "p_review", sql=f"SELECT recommendation_id, app_id, raw_id, fetched_at, votes_up FROM ({NEWEST.format(where='')})")
def _(t):
    rows = facts.latest_per_key(t.reviews, ["recommendation_id"], [F.desc("fetched_at"), F.desc("raw_id")])
    return rows.select("recommendation_id", "app_id", "raw_id", _ntz("fetched_at"), "votes_up")


AS_OF = """SELECT r.raw_id, r.recommendation_id, coalesce(g.game_sk, -1) AS game_sk FROM p_review r
    LEFT JOIN p_game g ON g.app_id = r.app_id AND r.created_at >= g.valid_from AND r.created_at < g.valid_to"""


@query("scd2_asof_join", "p_review", "p_game", sql=AS_OF)
def _(t):
    return facts.scd2_lookup(t.reviews, t.games, "created_at").select("raw_id", "recommendation_id", "game_sk")


CUT = "1998-07-01 00:00:00"
_LEAN_FIRST = ("app_id", "created_at", "playtime_at_review_min")
_LEAN_LAST = ("votes_up", "is_voted_up", "loaded_from")


def _loaded(rows):
    newest = facts.latest_per_key(rows, ["recommendation_id"], [F.desc("fetched_at"), F.desc("raw_id")])
    return newest.withColumn("loaded_from", F.col("fetched_at")).select("recommendation_id", *_LEAN_FIRST, *_LEAN_LAST)


def _merged(t, first, second):
    return facts.merge_reviews(_loaded(t.reviews.filter(first)), _loaded(t.reviews.filter(second)),
                               immutable=_LEAN_FIRST, mutable=_LEAN_LAST).withColumn(
        "created_at", F.col("created_at").cast("timestamp_ntz")).withColumn("loaded_from", F.col("loaded_from").cast("timestamp_ntz"))


def _merge_sql(first: str, second: str) -> str:
    a, b = NEWEST.format(where=f"WHERE {first}"), NEWEST.format(where=f"WHERE {second}")
    last = ", ".join(f"CASE WHEN b.recommendation_id IS NOT NULL AND (a.recommendation_id IS NULL OR b.fetched_at >= a.fetched_at) THEN b.{c} ELSE a.{c} END AS {n}"
                     for c, n in (("votes_up", "votes_up"), ("is_voted_up", "is_voted_up"), ("fetched_at", "loaded_from")))
    first_cols = ", ".join(f"CASE WHEN a.recommendation_id IS NOT NULL THEN a.{c} ELSE b.{c} END AS {c}" for c in _LEAN_FIRST)
    return f"SELECT coalesce(a.recommendation_id, b.recommendation_id) AS recommendation_id, {first_cols}, {last} FROM ({a}) a FULL JOIN ({b}) b USING (recommendation_id)"


@query("review_merge", "p_review", sql=_merge_sql(f"fetched_at < TIMESTAMP '{CUT}'", f"fetched_at >= TIMESTAMP '{CUT}'"))
def _(t):
    cut = F.lit(CUT).cast("timestamp")
    return _merged(t, F.col("fetched_at") < cut, F.col("fetched_at") >= cut)


@query("backfill_guard", "p_review", sql=_merge_sql(f"fetched_at >= TIMESTAMP '{CUT}'", f"fetched_at < TIMESTAMP '{CUT}'"))
def _(t):
    cut = F.lit(CUT).cast("timestamp")
    return _merged(t, F.col("fetched_at") >= cut, F.col("fetched_at") < cut)


@query("new_records_antijoin", sql="""
    SELECT event_id // 100 AS page, count(*) AS ids, count(*) FILTER (WHERE doc_id IS NULL) AS new_ids, bool_and(doc_id IS NOT NULL) AS fully_known
    FROM events LEFT JOIN documents ON doc_id = event_id GROUP BY 1""")
def _(t):
    batch = t.table("events").select(F.floor(F.col("event_id") / 100).cast("bigint").alias("page"), F.col("event_id").alias("id"))
    return facts.new_records(batch, t.table("documents").select(F.col("doc_id").alias("id")), "id", "page")


BATCH = 1000


def _batches_sql(pages: str) -> str:
    """Batches one behind the other, each to the end of the page that holds its first row plus ``BATCH``."""
    return f"""RECURSIVE
    placed AS (SELECT fetched_at, page_rows, CAST(sum(page_rows) OVER (ORDER BY fetched_at) AS BIGINT) AS page_end, CAST(sum(page_rows) OVER () AS BIGINT) AS total FROM ({pages})),
    cut(batch, first, last, total) AS (
        SELECT CAST(0 AS BIGINT), CAST(0 AS BIGINT), coalesce(min(page_end) FILTER (page_end >= {BATCH}), max(total)), max(total) FROM placed
        UNION ALL
        SELECT c.batch + 1, c.last, coalesce(min(p.page_end), c.total), c.total
        FROM cut c LEFT JOIN placed p ON p.page_end >= c.last + {BATCH} WHERE c.last < c.total GROUP BY c.batch, c.last, c.total),
    numbered AS (SELECT fetched_at, page_rows, page_end, batch FROM placed JOIN cut ON page_end > first AND page_end <= last)"""


@query("page_aligned_batches", "p_review", sql=f"""SELECT * FROM (WITH {_batches_sql("SELECT fetched_at, count(*) AS page_rows FROM p_review GROUP BY 1")} SELECT * FROM numbered)""")
def _(t):
    return paging.page_batches(t.reviews, BATCH).withColumn("fetched_at", F.col("fetched_at").cast("timestamp_ntz"))


MARKS = "SELECT app_id, max(fetched_at) AS loaded_from FROM p_review WHERE app_id <> 3 AND created_at < TIMESTAMP '1997-01-01' + to_days(app_id * 200) GROUP BY 1"


def _marks(t):
    until = F.expr("CAST(date_add(DATE'1997-01-01', app_id * 200) AS TIMESTAMP)")
    return t.reviews.filter((F.col("app_id") != 3) & (F.col("created_at") < until)).groupBy("app_id").agg(F.max("fetched_at").alias("loaded_from"))


@query("incremental_pages", "p_review", sql=f"""
    SELECT r.app_id, r.recommendation_id, r.raw_id, r.fetched_at FROM p_review r LEFT JOIN ({MARKS}) m USING (app_id)
    WHERE m.loaded_from IS NULL OR r.fetched_at > m.loaded_from""")
def _(t):
    return facts.incremental_pages(t.reviews, _marks(t)).select("app_id", "recommendation_id", "raw_id", _ntz("fetched_at"))


@query("load_watermarks", "p_review", "p_game", sql=f"""
    SELECT g.app_id, max(r.fetched_at) AS loaded_from FROM (SELECT k.game_sk, p.fetched_at FROM ({AS_OF}) k
        JOIN p_review p USING (raw_id, recommendation_id)) r JOIN p_game g USING (game_sk) WHERE g.app_id > 0 GROUP BY 1""")
def _(t):
    rows = facts.scd2_lookup(t.reviews, t.games, "created_at").withColumn("loaded_from", F.col("fetched_at"))
    return facts.load_watermarks(rows, t.games).select("app_id", _ntz("loaded_from"))


@query("watermark_seed", "p_review", sql="""
    SELECT raw_id, recommendation_id, CASE WHEN recommendation_id % 3 = 0 THEN (SELECT min(fetched_at) FROM p_review) ELSE fetched_at END AS loaded_from FROM p_review""")
def _(t):
    known = t.reviews.withColumn("loaded_from", F.expr("CASE WHEN recommendation_id % 3 <> 0 THEN fetched_at END"))
    return facts.watermark_seed(known, t.reviews).select("raw_id", "recommendation_id", _ntz("loaded_from"))


@query("collection_depth_stop", sql="""
    SELECT app_id, count(*) AS pages, min(oldest) AS oldest, date_diff('day', min(oldest)::DATE, max(fetched_at)::DATE) AS days_held,
           min(CASE WHEN oldest < fetched_at - INTERVAL 10 DAY THEN page END) AS stop_page
    FROM (SELECT CAST(event_id // 100 % 5 + 1 AS INT) AS app_id, event_id // 100 AS page, min(ts) AS oldest, max(ts) + to_days(CAST(event_id // 100 % 20 AS INT)) AS fetched_at
          FROM events GROUP BY event_id // 100) GROUP BY 1""")
def _(t):
    page = F.floor(F.col("event_id") / 100).cast("bigint")
    pages = t.table("events").groupBy(page.alias("page")).agg(F.min("ts").alias("oldest"), F.max("ts").alias("newest")).select(
        (F.col("page") % 5 + 1).cast("int").alias("app_id"), "page", "oldest",
        (F.col("newest") + F.make_dt_interval((F.col("page") % 20).cast("int"))).alias("fetched_at"))
    return facts.depth_stop(pages, 10).withColumn("oldest", F.col("oldest").cast("timestamp_ntz")).withColumn(
        "days_held", F.col("days_held").cast("bigint"))


@query("language_upsert", sql=f"""
    SELECT DISTINCT CASE WHEN lang IN ('en', 'fr') THEN ascii(lang)::VARCHAR ELSE {STATIC_KEY.format("concat('8:language', length(lang), ':', lang)")} END AS language_sk,
           lang AS language_code FROM documents""")
def _(t):
    docs = t.table("documents").select(F.col("lang").alias("language_code"))
    stored = docs.filter("language_code IN ('en', 'fr')").distinct().select(F.ascii("language_code").cast("bigint").alias("language_sk"), "language_code")
    return facts.upsert_languages(stored, docs).withColumn("language_sk", F.col("language_sk").cast("string"))


@query("patch_merge", "p_patch", sql="""
    SELECT gid, game_sk, CASE WHEN published_at < TIMESTAMP '1997-01-01' THEN title ELSE upper(title) END AS title,
           CASE WHEN published_at < TIMESTAMP '1997-01-01' THEN body_length ELSE body_length + 1 END AS body_length FROM p_patch""")
def _(t):
    columns = ["gid", "game_sk", "title", "body_length"]
    # news up to 2000 are stored; those since 1997 arrive, some of them again
    stored = t.patches.filter("published_at < TIMESTAMP'2000-01-01'").select(*columns)
    batch = t.patches.filter("published_at >= TIMESTAMP'1997-01-01'").select(
        "gid", "game_sk", F.upper("title").alias("title"), (F.col("body_length") + 1).cast("int").alias("body_length"))
    return facts.merge_patches(stored, batch)


LOAD_CUT = "2024-01-16"


def recollected(pages):
    """Every third page as it is fetched again a month later: comments came in, and a flag that must not change did."""
    payload = F.replace(F.replace("payload", F.lit('"comment_count":0,'), F.lit('"comment_count":7,')), F.lit('"steam_purchase":true'), F.lit('"steam_purchase":false'))
    return pages.filter("raw_id % 3 = 0").withColumn("raw_id", F.col("raw_id") + 1000000000).withColumn(
        "fetched_at", F.col("fetched_at") + F.expr("INTERVAL 30 DAYS")).withColumn("payload", payload)


@query("review_load", "p_game", sql=f"""
    SELECT event_id AS recommendation_id, coalesce(g.game_sk, -1) AS game_sk, CAST(strftime(made, '%Y%m%d') AS INT) AS date_sk, CAST(hour(made) AS SMALLINT) AS time_sk,
           CASE WHEN lang IS NULL THEN '-1' ELSE {STATIC_KEY.format("concat('8:language', length(lang), ':', lang)")} END AS language_sk,
           CASE WHEN user_id % 7 <> 0 THEN user_id END AS author_steam_id, made AS created_at, event_type <> 'error' AS is_voted_up,
           CAST(floor(value) AS INT) AS votes_up, CAST(CASE WHEN again AND user_id % 5 = 0 THEN 7 ELSE user_id % 5 END AS INT) AS comment_count,
           CAST(user_id * 10 AS INT) AS playtime_at_review_min, event_type = 'purchase' AND NOT (again AND fetched_at >= TIMESTAMP '{LOAD_CUT}') AS steam_purchase,
           fetched_at + CASE WHEN again THEN INTERVAL 30 DAY ELSE INTERVAL 0 DAY END AS loaded_from, props AS review_body
    FROM (SELECT *, CAST(event_id // 100 % 5 + 1 AS INT) AS app_id, date_trunc('second', ts) AS made, nullif({EVENT_LANGUAGE}, '') AS lang,
                 event_id // 100 % 3 = 0 AS again, max(ts) OVER (PARTITION BY event_id // 100) AS fetched_at FROM events) e
    LEFT JOIN p_game g ON g.app_id = e.app_id AND made >= g.valid_from AND made < g.valid_to""")
def _(t):
    """Landing pages to facts in two loads: early pages first, then what each product's mark leaves, pages fetched again included."""
    path, pages = scratch_path(t.spark, "landing"), review_pages(t)
    raw.append_raw(pages.filter(F.col("fetched_at") < F.lit(LOAD_CUT).cast("timestamp")), path)
    early = raw.explode_reviews(raw.read_raw(t.spark, path, "reviews"))
    languages = facts.upsert_languages(t.spark.createDataFrame([], f"language_sk {numbers.KEY_TYPE}, language_code string"), early)
    store = written(facts.review_facts(early, t.games, languages), "facts")
    raw.append_raw(pages.filter(F.col("fetched_at") >= F.lit(LOAD_CUT).cast("timestamp")), path)
    raw.append_raw(recollected(pages), path)
    fresh = raw.explode_reviews(facts.incremental_pages(raw.read_raw(t.spark, path, "reviews"), facts.load_watermarks(store, t.games)))
    loaded = facts.merge_reviews(store, facts.review_facts(fresh, t.games, facts.upsert_languages(languages, fresh)))
    return loaded.select(
        "recommendation_id", "game_sk", "date_sk", "time_sk", F.col("language_sk").cast("string").alias("language_sk"), "author_steam_id", _ntz("created_at"), "is_voted_up", "votes_up",
        "comment_count", "playtime_at_review_min", "steam_purchase", _ntz("loaded_from"), "review_body")


@query("review_batches", "p_review", sql=f"""SELECT * FROM (WITH {_batches_sql("SELECT fetched_at, count(*) AS page_rows FROM (" + NEWEST.format(where="") + ") GROUP BY 1")}
    SELECT recommendation_id, raw_id, batch FROM ({NEWEST.format(where='')}) JOIN numbered USING (fetched_at))""")
def _(t):
    return paging.review_batches(t.reviews, BATCH).select("recommendation_id", "raw_id", "batch")


PLATFORM_ITEM = """CASE CAST(o_custkey % 6 AS INT) WHEN 0 THEN 'The Steam Awards are open' WHEN 1 THEN 'Summer Sale starts' WHEN 2 THEN 'Lunar New Year Steam Sale'
    WHEN 3 THEN 'Next Fest returns' WHEN 4 THEN 'A publisher steam sale' ELSE 'New hardware' END"""
PLATFORM_KIND = """CASE CAST(o_custkey % 6 AS INT) WHEN 0 THEN 'awards' WHEN 1 THEN 'sale' WHEN 2 THEN 'sale' WHEN 3 THEN 'fest' END"""


@query("platform_event_load", sql=f"""
    SELECT * FROM (
        SELECT CAST(o_custkey AS VARCHAR) AS gid, CAST(o_orderdate AS DATE) AS event_date, {PLATFORM_KIND} AS event_type, {PLATFORM_ITEM} AS title
        FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey DESC) AS k FROM orders WHERE o_orderstatus <> 'P')
        WHERE k = 1)
    WHERE event_type IS NOT NULL
    UNION ALL SELECT concat('old-', n_name), DATE '2015-01-01', 'fest', n_name FROM nation""")
def _(t):
    items = t.table("orders").select(
        F.lit(titles.PLATFORM_APP_ID).alias("app_id"), F.col("o_custkey").cast("string").alias("gid"), F.expr(PLATFORM_ITEM).alias("title"),
        F.lit(None).cast("string").alias("url"), F.lit("platform").alias("feedname"),
        F.expr("CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END").alias("feed_type"), F.col("o_orderdate").alias("published_at"),
        F.timestamp_seconds("o_totalprice").alias("fetched_at"), F.col("o_orderkey").alias("raw_id"))
    found = facts.platform_facts(items)
    stored = t.table("nation").select(
        F.concat(F.lit("old-"), "n_name").alias("gid"), F.lit("2015-01-01").cast("date").alias("event_date"), F.lit("fest").alias("event_type"),
        F.col("n_name").alias("title"), F.lit(None).cast("string").alias("url"), F.lit("platform").alias("source"))
    return facts.replace_by_key(stored, found, ["gid"]).select("gid", "event_date", "event_type", "title")


# --- the versioned dimension ----------------------------------------------------------------


@query("dim_game_current", "p_game", sql="""SELECT game_sk, app_id, game_name, app_type, is_free, metacritic_score, release_date_parsed, collection_status
    FROM p_game WHERE is_current AND app_id > 0""")
def _(t):
    return games.dim_game_current(t.games)


@query("game_list", "p_game", sql="SELECT app_id, game_name, collection_status FROM p_game WHERE is_current AND app_id > 0")
def _(t):
    return games.game_list(games.dim_game_current(t.games))


@query("known_games", "p_review", "p_game", sql="""
    SELECT r.app_id, coalesce(g.game_name, CAST(r.app_id AS VARCHAR)) AS game_name FROM (SELECT DISTINCT CAST(app_id * 2 AS INT) AS app_id FROM p_review) r
    LEFT JOIN p_game g ON g.app_id = r.app_id AND g.is_current""")
def _(t):
    return games.known_games(t.reviews.select((F.col("app_id") * 2).alias("app_id")), t.games)


@query("enabled_games", "p_daily", sql="SELECT * FROM p_daily WHERE app_id IN (SELECT r_regionkey + 1 FROM region WHERE r_regionkey % 2 = 0)")
def _(t):
    switch = t.table("region").select((F.col("r_regionkey") + 1).alias("app_id"), (F.col("r_regionkey") % 2 == 0).alias("enabled"))
    return games.enabled_games(t.daily, switch)


def _stored_games(picked):
    """Versions stored earlier: low scores are not known yet, high ones differ in a tracked attribute."""
    return picked.filter("metacritic_score > 10").select(
        F.col("app_id").alias("game_sk"), "app_id", F.concat(F.lit("old "), "game_name").alias("game_name"),
        F.lit("old link").alias("metacritic_url"), "app_type", "is_free",
        F.expr("CASE WHEN metacritic_score > 40 THEN required_age + 1 ELSE required_age END").alias("required_age"), "metacritic_score",
        "is_coming_soon", "release_date_raw", "release_date_parsed", F.lit("2000-01-01").cast("timestamp").alias("valid_from"),
        F.lit(games.OPEN_END).cast("timestamp").alias("valid_to"), F.lit(True).alias("is_current"), F.lit("complete").alias("collection_status"))


def _version_sql(where: str, name: str, link: str, age: str, since: str, until: str, current: str, status: str) -> str:
    return f"""SELECT app_id, {name} AS game_name, {link} AS metacritic_url, {age} AS required_age, '{since}' AS valid_from, '{until}' AS valid_to,
        {current} AS is_current, {status} AS collection_status FROM g WHERE {where}"""


NOW, OPEN, START = "2025-01-01 00:00:00", games.OPEN_END, "2000-01-01 00:00:00"


@query("scd2_apply", sql=f"""SELECT * FROM (WITH g AS ({GAME_FIELDS})
    {_version_sql("metacritic_score BETWEEN 11 AND 40", "game_name", "metacritic_url", "required_age", START, OPEN, "true", "'complete'")}
    UNION ALL {_version_sql("metacritic_score > 40", "concat('old ', game_name)", "'old link'", "required_age + 1", START, NOW, "false", "'complete'")}
    UNION ALL {_version_sql("metacritic_score > 40", "game_name", "metacritic_url", "required_age", NOW, OPEN, "true", "NULL")}
    UNION ALL {_version_sql("metacritic_score <= 10", "game_name", "metacritic_url", "required_age", START, OPEN, "true", "NULL")})""")
def _(t):
    # both sides read the cards several times
    picked = written(picked_games(t), "cards")
    out = games.scd2_apply(_stored_games(picked), picked, NOW)
    stamp = "yyyy-MM-dd HH:mm:ss"
    return out.select(
        "app_id", "game_name", "metacritic_url", "required_age", F.date_format("valid_from", stamp).alias("valid_from"),
        F.date_format("valid_to", stamp).alias("valid_to"), "is_current", "collection_status")


@query("bridge_replace", sql="""
    SELECT l_orderkey AS game_sk, concat('new', CAST(l_partkey % 7 AS VARCHAR)) AS link FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2
    UNION ALL SELECT l_orderkey, CAST(l_partkey AS VARCHAR) FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag IN ('R', 'A')) GROUP BY 1, 2""")
def _(t):
    line = t.table("lineitem")
    old = line.select(F.col("l_orderkey").alias("game_sk"), F.col("l_partkey").cast("string").alias("link")).distinct()
    new = line.filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("game_sk"), F.concat(F.lit("new"), (F.col("l_partkey") % 7).cast("string")).alias("link"))
    # returned and accepted lines touch their order, but only returned ones bring links
    touched = line.filter("l_returnflag IN ('R', 'A')").select(F.col("l_orderkey").alias("game_sk"))
    return games.bridge_replace(old, new, touched)


@query("collection_status", sql="""
    SELECT CAST(c_custkey AS INT) AS app_id, v AS version, CASE WHEN v = 2 AND c_acctbal > 0 AND c_mktsegment = 'BUILDING' THEN 'complete'
        WHEN v = 2 AND c_acctbal > 0 THEN 'partial' WHEN v = 1 THEN 'complete' END AS collection_status
    FROM customer, (VALUES (1), (2)) AS x(v)""")
def _(t):
    base = t.table("customer").withColumn("version", F.explode(F.array(F.lit(1), F.lit(2))))
    dim = base.select(F.col("c_custkey").cast("int").alias("app_id"), "version", (F.col("version") == 2).alias("is_current"),
                      F.expr("CASE version WHEN 1 THEN 'complete' END").alias("collection_status"))
    runs = t.table("customer").filter("c_acctbal > 0").select(
        F.col("c_custkey").cast("int").alias("app_id"), F.lit(True).alias("card_loaded"), (F.col("c_mktsegment") == "BUILDING").alias("all_steps"))
    return games.mark_status(dim, runs).select("app_id", "version", "collection_status")


def _broken_dim(t):
    """Three versions per customer whose starts were all overwritten with the same day."""
    base = t.table("customer").withColumn("v", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    return base.select(
        (F.col("c_custkey") * 3 + F.col("v")).alias("game_sk"), (F.col("c_custkey") + 1).alias("app_id"),
        F.lit("1995-01-01").cast("timestamp").alias("valid_from"),
        F.expr("CASE WHEN v = 3 THEN TIMESTAMP'2100-01-01' ELSE CAST(date_add(DATE'1995-01-01', CAST(v * 700 + c_custkey % 300 AS INT)) AS TIMESTAMP) END").alias("valid_to"),
        (F.col("v") == 3).alias("is_current"))


BROKEN = """SELECT c_custkey * 3 + v AS game_sk, c_custkey + 1 AS app_id, TIMESTAMP '1995-01-01' AS valid_from, v = 3 AS is_current,
    CASE WHEN v = 3 THEN TIMESTAMP '2100-01-01' ELSE TIMESTAMP '1995-01-01' + to_days(CAST(v * 700 + c_custkey % 300 AS INT)) END AS valid_to
    FROM customer, (VALUES (1), (2), (3)) AS x(v)"""


@query("scd2_repair", sql=f"""SELECT * FROM (WITH b AS ({BROKEN}), fixed AS (
        SELECT game_sk, app_id, coalesce(lag(valid_to) OVER (PARTITION BY app_id ORDER BY valid_to, game_sk), valid_from) AS valid_from, valid_to FROM b)
    SELECT o_orderkey, f.game_sk, CAST(f.valid_from AS DATE) AS valid_from FROM orders JOIN fixed f ON f.app_id = o_custkey + 1 AND o_orderdate >= f.valid_from AND o_orderdate < f.valid_to)""")
def _(t):
    fixed = games.repair_scd2(_broken_dim(t))
    orders = t.table("orders").select("o_orderkey", (F.col("o_custkey") * 3 + 1).alias("game_sk"), "o_orderdate")
    moved = games.repoint_facts(orders, fixed, "o_orderdate")
    return moved.join(fixed.select("game_sk", F.to_date("valid_from").alias("valid_from")), "game_sk").select("o_orderkey", "game_sk", "valid_from")


@query("dq_scd2_overlap", sql=f"""WITH b AS ({BROKEN})
    SELECT later.app_id, later.game_sk, later.valid_to, max(b.valid_to) AS earlier_to FROM b AS later JOIN b
        ON b.app_id = later.app_id AND (b.valid_from < later.valid_from OR b.valid_from = later.valid_from AND b.game_sk < later.game_sk)
    GROUP BY ALL HAVING bool_or(b.valid_to > later.valid_from)""")
def _(t):
    return quality.dq_scd2_overlap(_broken_dim(t)).select("app_id", "game_sk", _ntz("valid_to"), _ntz("earlier_to"))


@query("dq_single_current", sql="SELECT c_nationkey AS app_id, count(*) AS n FROM customer WHERE c_acctbal > 0 GROUP BY 1 HAVING count(*) > 1")
def _(t):
    dim = t.table("customer").select(F.col("c_nationkey").alias("app_id"), (F.col("c_acctbal") > 0).alias("is_current"))
    return quality.dq_single_current(dim, "app_id")


# --- scalar functions -----------------------------------------------------------------------


@query("utc_day_keys", sql="""SELECT event_id, CAST(ts AS DATE) AS "day", CAST(strftime(ts, '%Y%m%d') AS INT) AS date_sk, CAST(hour(ts) AS SMALLINT) AS time_sk FROM events""")
def _(t):
    ts = F.col("ts")
    return t.table("events").select("event_id", dates.utc_day(ts).alias("day"), dates.date_key(ts).alias("date_sk"), dates.hour_key(ts).alias("time_sk"))


@query("parse_release_date", sql=f"SELECT p_partkey, {_release_raw('duck')} AS raw, {PARSED_RELEASE} AS parsed FROM part")
def _(t):
    return t.table("part").select("p_partkey", F.expr(_release_raw("spark")).alias("raw")).withColumn("parsed", dates.parse_release_date(F.col("raw")))


# the expected kind of each title template, written independently of the pattern list
EXPECTED_KIND = """CASE WHEN o_orderstatus = 'P' THEN 'press' ELSE CASE CAST(o_orderkey % 18 AS INT)
    WHEN 0 THEN 'patch' WHEN 1 THEN 'season_start' WHEN 2 THEN 'unknown' WHEN 3 THEN 'season_start' WHEN 4 THEN 'unknown' WHEN 5 THEN 'patch'
    WHEN 6 THEN 'beta' WHEN 7 THEN 'patch' WHEN 8 THEN 'marketing' WHEN 9 THEN 'marketing' WHEN 10 THEN 'announce' WHEN 11 THEN 'expansion'
    WHEN 12 THEN 'blog' WHEN 13 THEN 'service' WHEN 14 THEN CASE WHEN o_custkey % 150 <= 100 THEN 'patch' ELSE 'unknown' END
    WHEN 15 THEN 'season_start' WHEN 16 THEN 'unknown' ELSE 'unknown' END END"""
EXPECTED_VERSION = """CASE WHEN o_orderstatus = 'P' THEN NULL ELSE CASE CAST(o_orderkey % 18 AS INT)
    WHEN 0 THEN CASE WHEN o_custkey % 130 <= 100 THEN concat(CAST(o_custkey % 130 AS VARCHAR), '.', CAST(o_orderkey % 10 AS VARCHAR)) END
    WHEN 5 THEN concat('1.', CAST(o_custkey % 20 AS VARCHAR), '.3') WHEN 6 THEN concat('0.', CAST(o_custkey % 20 AS VARCHAR))
    WHEN 7 THEN concat('2.', CAST(o_custkey % 20 AS VARCHAR))
    WHEN 14 THEN CASE WHEN o_custkey % 150 <= 100 THEN concat(CAST(o_custkey % 150 AS VARCHAR), '.', CAST(o_orderkey % 7 AS VARCHAR)) END END END"""


@query("classify_news_title", sql=f"SELECT o_orderkey, {duck(TITLE)} AS title, {EXPECTED_KIND} AS kind FROM orders")
def _(t):
    return t.patches.select(F.col("patch_sk").alias("o_orderkey"), "title", titles.news_kind(F.col("title"), F.col("feed_type")).alias("kind"))


@query("patch_load", "p_patch", "p_game", sql=f"""
    SELECT gid, coalesce(g.game_sk, -1) AS game_sk, CAST(strftime(published_at, '%Y%m%d') AS INT) AS date_sk, published_at, title, concat('https://news/', gid) AS url, feed_type,
           feedname, CAST(body_length AS INT) AS body_length, kind = 'patch' AS is_patch, kind AS event_type, version
    FROM (SELECT p.* EXCLUDE (app_id, game_sk), CAST(patch_sk // 100 % 5 + 1 AS INT) AS app_id, {EXPECTED_KIND} AS kind, {EXPECTED_VERSION} AS version
          FROM p_patch p JOIN orders ON o_orderkey = patch_sk WHERE feedname <> 'SteamDB') n
    LEFT JOIN p_game g ON g.app_id = n.app_id AND published_at >= g.valid_from AND published_at < g.valid_to""")
def _(t):
    """News pages to classified events in two loads that overlap."""
    # pages are parsed once, without their bodies; the batch is read by the merge twice
    items = written(raw.exclude_feeds(raw.explode_news(news_pages(t))), "items")
    store = facts.patch_facts(items.filter("published_at < TIMESTAMP'1998-01-01'"), t.games)
    batch = facts.patch_facts(items.filter("published_at >= TIMESTAMP'1996-01-01'"), t.games)
    return facts.merge_patches(store, batch).withColumn("published_at", F.col("published_at").cast("timestamp_ntz"))


@query("extract_version", sql=f"SELECT o_orderkey, {EXPECTED_VERSION} AS version FROM orders")
def _(t):
    return t.patches.select(F.col("patch_sk").alias("o_orderkey"), titles.news_version(F.col("title"), F.col("feed_type")).alias("version"))


@query("classify_platform_event", sql=f"SELECT o_orderkey, {PLATFORM_ITEM} AS title, {PLATFORM_KIND} AS kind FROM orders")
def _(t):
    return t.table("orders").select("o_orderkey", F.expr(PLATFORM_ITEM).alias("title")).withColumn("kind", titles.platform_kind(F.col("title")))


@query("platform_event_label", sql=f"""
    SELECT o_orderkey, CASE CAST(o_custkey % 6 AS INT) WHEN 0 THEN 'Steam Awards' WHEN 1 THEN 'Steam Summer Sale' WHEN 2 THEN 'Steam Lunar New Year Sale'
        WHEN 3 THEN 'Next Fest' WHEN 4 THEN 'A publisher steam sale' ELSE 'New hardware' END AS label FROM orders""")
def _(t):
    title = F.expr(PLATFORM_ITEM)
    return t.table("orders").select("o_orderkey", titles.platform_label(titles.platform_kind(title), title).alias("label"))


APP_REF = """CASE CAST(c_custkey % 5 AS INT) WHEN 0 THEN concat('https://store.steampowered.com/app/', CAST(c_custkey AS STRING), '/Name')
    WHEN 1 THEN concat('  ', CAST(c_custkey AS STRING), ' ') WHEN 2 THEN c_name WHEN 3 THEN '0' ELSE CAST(-c_custkey AS STRING) END"""


@query("normalize_app_ref", sql="SELECT c_custkey, CAST(CASE WHEN c_custkey % 5 <= 1 AND (c_custkey > 0 OR c_custkey % 5 = 0) THEN c_custkey END AS INT) AS app_id FROM customer")
def _(t):
    return t.table("customer").select("c_custkey", titles.app_reference(F.expr(APP_REF)).alias("app_id"))


@query("text_hash", sql="SELECT doc_id, md5(coalesce(text, '')) AS text_hash FROM documents UNION ALL SELECT conv_id * 1000000 + turn, md5(text) FROM conversations")
def _(t):
    docs = t.table("documents").select("doc_id", "text")
    talk = t.table("conversations").select((F.col("conv_id") * 1000000 + F.col("turn")).alias("doc_id"), "text")
    return docs.unionByName(talk).select("doc_id", text.text_hash(F.col("text")).alias("text_hash"))


@query("content_flag", sql="SELECT doc_id, CAST(length(trim(coalesce(text, ''), ' ')) AS INT) AS length, length(trim(coalesce(text, ''), ' ')) >= 20 AS is_content FROM documents")
def _(t):
    body = F.col("text")
    return t.table("documents").select("doc_id", text.trimmed_length(body).alias("length"), text.is_content(body).alias("is_content"))


@query("excerpt_text", sql=r"""
    SELECT doc_id, CASE WHEN length(f) <= 150 THEN f ELSE concat(regexp_replace(regexp_replace(left(f, 149), ' [^ ]*$', ''), '[ ,.;:\-]+$', ''), '…') END AS excerpt
    FROM (SELECT doc_id, trim(regexp_replace(replace(text, '…', ' '), '[\s\x0b\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g'), ' ') AS f FROM documents)""")
def _(t):
    return t.table("documents").select("doc_id", text.excerpt_text(F.col("text")).alias("excerpt"))


REFERRED = "concat(c_name, CASE CAST(c_custkey % 4 AS INT) WHEN 0 THEN ' [1]' WHEN 1 THEN ' [1, 22] and [3]. ' WHEN 2 THEN ' [a]' ELSE '' END)"


@query("strip_support_refs", sql="""SELECT c_custkey, concat(c_name, CASE CAST(c_custkey % 4 AS INT) WHEN 1 THEN ' and.' WHEN 2 THEN ' [a]' ELSE '' END) AS shown FROM customer""")
def _(t):
    return t.table("customer").select("c_custkey", text.strip_references(F.expr(REFERRED)).alias("shown"))


# --- streaming ------------------------------------------------------------------------------

STREAMED = """SELECT event_id AS recommendation_id, CAST(event_id // 100 % 5 + 1 AS INT) AS app_id, event_type <> 'error' AS is_voted_up,
    CAST(floor(value) AS INT) AS votes_up, props AS review_body FROM events"""


@query("stream_review_merge", sql=f"""SELECT event_id AS recommendation_id, is_voted_up, votes_up, review_body, CAST(strftime(ts, '%Y%m%d') AS INT) AS date_sk, CAST(hour(ts) AS INT) AS time_sk,
    CASE WHEN language = '' THEN '-1' ELSE {STATIC_KEY.format("concat('8:language', length(language), ':', language)")} END AS language_sk
    FROM ({STREAMED}) JOIN (SELECT event_id, ts, {EVENT_LANGUAGE} AS language FROM events) ON event_id = recommendation_id""")
def _(t):
    base = scratch_path(t.spark, "stream")
    # two landings: the second repeats every page, as an incremental collection does
    for _ in range(2):
        raw.append_raw(review_pages(t), f"{base}/landing")
        stream.stream_review_merge(
            stream.raw_stream(t.spark, f"{base}/landing", "reviews"), t.games, f"{base}/log", f"{base}/checkpoint").awaitTermination()
    # the first landings become the base; the last one repeats some pages and stays a delta behind it
    stream.compact(t.spark, f"{base}/log")
    raw.append_raw(review_pages(t).where("raw_id % 3 = 0"), f"{base}/landing")
    stream.stream_review_merge(stream.raw_stream(t.spark, f"{base}/landing", "reviews"), t.games, f"{base}/log", f"{base}/checkpoint").awaitTermination()
    state = stream.current_reviews(stream.read_log(t.spark, f"{base}/log"))
    return state.select("recommendation_id", "is_voted_up", "votes_up", "review_body", "date_sk", "time_sk", F.col("language_sk").cast("string").alias("language_sk"))


@query("stream_review_daily", sql="""
    SELECT CAST(user_id % 5 + 1 AS INT) AS app_id, CAST(ts AS DATE) AS "day", count(*) AS review_count, count(*) FILTER (WHERE event_type <> 'error') AS positive_count
    FROM events GROUP BY 1, 2""")
def _(t):
    base = scratch_path(t.spark, "stream-daily")
    events = t.table("events")
    # three landings: later days first, then earlier ones, then some reviews once more
    for part in (events.where("event_id % 2 = 1"), events.where("event_id % 2 = 0"), events.where("event_id % 3 = 0")):
        part.write.mode("append").parquet(f"{base}/landing")
        source = t.spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 4).parquet(f"{base}/landing")
        reviews = source.select(
            F.col("event_id").alias("recommendation_id"), (F.col("user_id") % 5 + 1).cast("int").alias("app_id"), F.col("ts").alias("created_at"),
            (F.col("event_type") != "error").alias("voted_up"), F.col("ts").alias("fetched_at"))
        stream.stream_review_daily(reviews, f"{base}/log", f"{base}/days", f"{base}/checkpoint").awaitTermination()
    return stream.read_daily(t.spark, f"{base}/days")
