"""Append-only landing pages (one JSON document per row) and their typed form."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.functions.dates import parse_release_date
from tideline.functions.titles import EXCLUDED_FEEDS, PLATFORM_APP_ID

# fixed values: landing columns and document layouts of the three page kinds
RAW_SCHEMAS = {
    "reviews": "raw_id BIGINT, app_id INT, cursor_in STRING, fetched_at TIMESTAMP, payload STRING",
    "news": "raw_id BIGINT, app_id INT, fetched_at TIMESTAMP, payload STRING",
    "appdetails": "raw_id BIGINT, app_id INT, fetched_at TIMESTAMP, http_status INT, payload STRING",
}
REVIEW_DOCUMENT = """
    cursor STRING,
    reviews ARRAY<STRUCT<
        recommendationid: STRING, language: STRING, review: STRING,
        timestamp_created: STRING, timestamp_updated: STRING, timestamp_dev_responded: STRING,
        voted_up: BOOLEAN, votes_up: STRING, votes_funny: STRING, comment_count: STRING,
        weighted_vote_score: STRING, steam_purchase: BOOLEAN, received_for_free: BOOLEAN,
        written_during_early_access: BOOLEAN,
        author: STRUCT<steamid: STRING, playtime_at_review: STRING, playtime_forever: STRING,
                       playtime_last_two_weeks: STRING>>>
"""
NEWS_DOCUMENT = """
    appnews STRUCT<newsitems: ARRAY<STRUCT<
        gid: STRING, title: STRING, url: STRING, feedname: STRING, feed_type: STRING,
        contents: STRING, date: STRING>>>
"""
CARD = """STRUCT<
    success: BOOLEAN,
    data: STRUCT<
        steam_appid: STRING, name: STRING, type: STRING, is_free: BOOLEAN, required_age: STRING,
        metacritic: STRUCT<score: INT, url: STRING>,
        release_date: STRUCT<date: STRING, coming_soon: BOOLEAN>,
        developers: ARRAY<STRING>, publishers: ARRAY<STRING>,
        genres: ARRAY<STRUCT<id: STRING, description: STRING>>,
        categories: ARRAY<STRUCT<id: STRING, description: STRING>>>>"""
CARD_DOCUMENT = f"MAP<STRING, {CARD}>"


def read_raw(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Landing pages of one kind; a filter on app_id prunes whole folders."""
    return spark.read.schema(RAW_SCHEMAS[kind]).parquet(path)


def append_raw(pages: DataFrame, path: str) -> None:
    """Land new pages; pages already there are never rewritten."""
    pages.write.mode("append").partitionBy("app_id").parquet(path)


def pages_with_news(pages: DataFrame, items: DataFrame, known_ids: DataFrame, page_key: str, id_col: str) -> DataFrame:
    """Pages holding at least one id that is not stored yet; the others are skipped."""
    fresh = (
        items.select(page_key, id_col).join(known_ids.select(id_col).distinct(), id_col, "left_anti")
        .select(page_key).distinct()
    )
    return pages.join(fresh, page_key, "left_semi")


#: folders that the ids of a landing log are dealt over
ID_BUCKETS = 64


def known_ids(spark: SparkSession, path: str, id_col: str = "recommendation_id") -> DataFrame:
    """(id, bucket) of everything landed with ``append_new``, from the small table beside the landing log."""
    schema = f"{id_col} bigint, bucket int"
    try:
        return spark.read.schema(schema).parquet(f"{path}.ids")
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def append_new(pages: DataFrame, items: DataFrame, path: str, page_key: str = "raw_id", id_col: str = "recommendation_id") -> DataFrame:
    """Lands the pages that hold an id never landed before, with their ids beside them; returns these pages.

    ``items`` has the page and id of everything on ``pages``. What is known comes from the ids alone, by their buckets, so no
    stored payload is read. Pages are written before their ids: a stop in between lands them once more, and loads take the
    newest copy of a review anyway.
    """
    from tideline.session import written

    spark = pages.sparkSession
    bucket = F.pmod(F.hash(F.col(id_col).cast("bigint")), F.lit(ID_BUCKETS)).cast("int")
    named = items.select(page_key, F.col(id_col).cast("bigint").alias(id_col), bucket.alias("bucket"))
    new = named.join(known_ids(spark, path, id_col), ["bucket", id_col], "left_anti")
    # written once: what is known changes with the first append
    new = written(new, "new-ids")
    fresh = written(pages.join(new.select(page_key).distinct(), page_key, "left_semi"), "new-pages")
    append_raw(fresh, path)
    new.select(id_col, "bucket").distinct().repartition("bucket").write.mode("append").partitionBy("bucket").parquet(f"{path}.ids")
    return fresh


def explode_reviews(raw: DataFrame) -> DataFrame:
    """One typed row per review of a page. Zero epochs mean "never", missing counters mean zero."""
    item = raw.select(
        "raw_id", "app_id", "fetched_at",
        F.explode(F.from_json("payload", REVIEW_DOCUMENT)["reviews"]).alias("r"),
    )
    r, author = F.col("r"), F.col("r.author")

    def instant(name: str):
        return F.timestamp_seconds(F.nullif(r[name].cast("bigint"), F.lit(0)))

    def counter(name: str):
        return F.coalesce(r[name].cast("int"), F.lit(0)).alias(name)

    return item.select(
        "raw_id", "app_id", "fetched_at",
        r["recommendationid"].cast("bigint").alias("recommendation_id"),
        F.nullif(r["language"], F.lit("")).alias("language_code"),
        r["review"].alias("review_body"),
        F.nullif(author["steamid"], F.lit("")).cast("bigint").alias("author_steam_id"),
        F.timestamp_seconds(r["timestamp_created"].cast("bigint")).alias("created_at"),
        instant("timestamp_updated").alias("updated_at"),
        instant("timestamp_dev_responded").alias("dev_responded_at"),
        r["voted_up"].alias("is_voted_up"),
        counter("votes_up"), counter("votes_funny"), counter("comment_count"),
        r["weighted_vote_score"].cast("decimal(10,8)").alias("weighted_vote_score"),
        author["playtime_at_review"].cast("int").alias("playtime_at_review_min"),
        author["playtime_forever"].cast("int").alias("playtime_forever_min"),
        author["playtime_last_two_weeks"].cast("int").alias("playtime_last_two_weeks_min"),
        r["steam_purchase"].alias("steam_purchase"),
        r["received_for_free"].alias("received_for_free"),
        r["written_during_early_access"].alias("written_during_early_access"),
    )


def explode_news(raw: DataFrame) -> DataFrame:
    """One typed row per news item of a page."""
    item = raw.select(
        "raw_id", "app_id", "fetched_at",
        F.explode(F.from_json("payload", NEWS_DOCUMENT)["appnews"]["newsitems"]).alias("n"),
    )
    return item.select(
        "raw_id", "app_id", "fetched_at",
        "n.gid", "n.title", "n.url", "n.feedname",
        F.col("n.feed_type").cast("int").alias("feed_type"),
        F.char_length("n.contents").alias("body_length"),
        F.timestamp_seconds(F.col("n.date").cast("bigint")).alias("published_at"),
    )


def exclude_feeds(items: DataFrame) -> DataFrame:
    """Without the aggregator feed, items that name no feed, and the platform's own product."""
    return items.filter(~F.col("feedname").isin(*EXCLUDED_FEEDS) & (F.col("app_id") != PLATFORM_APP_ID))


def newest_cards(raw: DataFrame) -> DataFrame:
    """The newest non-empty card page of each product; loading reads only that one."""
    order = Window.partitionBy("app_id").orderBy(F.desc("fetched_at"), F.desc("raw_id"))
    filled = raw.filter(F.col("payload").isNotNull())
    return filled.withColumn("_rank", F.row_number().over(order)).filter("_rank = 1").drop("_rank")


def pick_card(raw: DataFrame) -> DataFrame:
    """The card of the requested product in a ``key -> card`` document.

    A successful card with the product's own inner id wins, then the requested key, then the
    only entry unless its inner id belongs to another product.
    """
    wanted = F.col("app_id").cast("string")
    # a projection for each step, so that a document is parsed once however often its entries are looked at
    parsed = raw.withColumn("_cards", F.from_json("payload", CARD_DOCUMENT)).withColumn("_entries", F.map_entries("_cards"))
    own = F.filter("_entries", lambda e: e["value"]["success"] & (e["value"]["data"]["steam_appid"] == wanted))
    keyed = F.filter("_entries", lambda e: e["key"] == wanted)
    found = parsed.withColumn("_own", F.get(own, F.lit(0))).withColumn("_keyed", F.get(keyed, F.lit(0))).withColumn("_first", F.get("_entries", F.lit(0)))
    only, inner = F.col("_first.value"), F.col("_first.value.data.steam_appid")
    card = (
        F.when(F.col("_own").isNotNull(), F.col("_own.value"))
        .when(F.col("_keyed").isNotNull(), F.col("_keyed.value"))
        .when((F.size("_entries") == 1) & (inner.isNull() | (inner == wanted)), only)
    )
    return found.withColumn("card", card).drop("_cards", "_entries", "_own", "_keyed", "_first")


def only_games(cards: DataFrame) -> DataFrame:
    """Every card with the reason it is refused, null when it is a game and may be loaded."""
    kind = F.col("card.data.type")
    refused = (
        F.when(~F.coalesce(F.col("card.success"), F.lit(False)), "no data")
        .when(F.coalesce(kind, F.lit("")) != "game", F.concat(F.lit("not a game: "), F.coalesce(kind, F.lit("unknown"))))
    )
    return cards.withColumn("refused", refused)


def extract_game(cards: DataFrame) -> DataFrame:
    """Flat attributes of each card."""
    d = F.col("card.data")
    raw_date = d["release_date"]["date"]
    return cards.select(
        "app_id", "fetched_at",
        d["name"].alias("game_name"),
        d["type"].alias("app_type"),
        d["is_free"].alias("is_free"),
        F.coalesce(F.nullif(d["required_age"], F.lit("")).cast("int"), F.lit(0)).alias("required_age"),
        d["metacritic"]["score"].alias("metacritic_score"),
        d["metacritic"]["url"].alias("metacritic_url"),
        F.coalesce(d["release_date"]["coming_soon"], F.lit(False)).alias("is_coming_soon"),
        raw_date.alias("release_date_raw"),
        parse_release_date(raw_date).alias("release_date_parsed"),
    )


def extract_links(cards: DataFrame) -> DataFrame:
    """Companies, genres and categories of each card as (link_type, link_id, link_name) rows."""
    d = F.col("card.data")

    def named(values, kind: str):
        return F.transform(
            F.coalesce(values, F.array().cast("array<string>")),
            lambda name: F.struct(F.lit(kind).alias("link_type"), F.lit(None).cast("int").alias("link_id"), name.alias("link_name")),
        )

    def coded(values, kind: str):
        return F.transform(
            values,
            lambda v: F.struct(F.lit(kind).alias("link_type"), v["id"].cast("int").alias("link_id"), v["description"].alias("link_name")),
        )

    empty = F.array().cast("array<struct<link_type:string,link_id:int,link_name:string>>")
    links = F.concat(
        named(d["developers"], "developer"),
        named(d["publishers"], "publisher"),
        F.coalesce(coded(d["genres"], "genre"), empty),
        F.coalesce(coded(d["categories"], "category"), empty),
    )
    return cards.select("app_id", F.inline(F.array_distinct(links)))
