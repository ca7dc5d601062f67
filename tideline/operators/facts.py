"""Loading facts: newest copy per key, version lookup, merges, incremental reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.dates import date_key, hour_key, utc_day
from tideline.functions.numbers import stable_key
from tideline.functions.titles import PLATFORM_APP_ID, news_kind, news_version, platform_kind

UNKNOWN = -1
IMMUTABLE = (
    "game_sk", "date_sk", "time_sk", "language_sk", "author_steam_id", "created_at",
    "playtime_at_review_min", "playtime_forever_min", "playtime_last_two_weeks_min",
    "steam_purchase", "received_for_free", "written_during_early_access",
)
MUTABLE = (
    "votes_up", "votes_funny", "comment_count", "weighted_vote_score",
    "updated_at", "dev_responded_at", "is_voted_up", "loaded_from",
)


def latest_per_key(df: DataFrame, keys: list[str], newest_first: list[Column]) -> DataFrame:
    """The newest row of each key.

    Filtering the rank right above the window lets Spark keep one row per key before the
    shuffle, so a key with very many copies costs one row per input partition.
    """
    order = Window.partitionBy(*keys).orderBy(*newest_first)
    return df.withColumn("_rank", F.row_number().over(order)).filter("_rank = 1").drop("_rank")


def scd2_lookup(facts: DataFrame, dim: DataFrame, instant: str, key: str = "app_id") -> DataFrame:
    """Adds the surrogate key of the version valid at ``instant``; -1 when there is none.

    Versions are half-open, so an instant equal to ``valid_to`` belongs to the next one. The versions of a product are one
    sorted array, which meets its facts by an equality and is searched in place, so facts and versions make no pairs.
    """
    version = F.struct(F.col("valid_from").alias("since"), F.col("valid_to").alias("until"), F.col("game_sk").alias("sk"))
    packed = dim.groupBy(F.col(key).alias("_key")).agg(F.sort_array(F.collect_list(version)).alias("_versions"))
    at = facts[instant]
    joined = facts.join(packed, facts[key] == F.col("_key"), "left")
    valid = F.filter("_versions", lambda v: (at >= v["since"]) & (at < v["until"]))
    # overlapping versions, a fault that has a check of its own, give a row each
    return joined.withColumn("_valid", F.explode_outer(valid)).withColumn(
        "game_sk", F.coalesce(F.col("_valid.sk"), F.lit(UNKNOWN))).drop("_key", "_versions", "_valid")


def load_watermarks(facts: DataFrame, dim: DataFrame) -> DataFrame:
    """Newest page already loaded, per product. Facts without a page and the Unknown product do not count."""
    per_version = (
        facts.filter("loaded_from is not null").groupBy("game_sk").agg(F.max("loaded_from").alias("loaded_from"))
    )
    games = dim.filter("app_id > 0").select("game_sk", "app_id")
    return per_version.join(games, "game_sk").groupBy("app_id").agg(F.max("loaded_from").alias("loaded_from"))


def landing_index(raw: DataFrame) -> DataFrame:
    """(app_id, first_page, last_page): the page times of each product, a small table kept beside the landing log."""
    return raw.groupBy("app_id").agg(F.min("fetched_at").alias("first_page"), F.max("fetched_at").alias("last_page"))


def incremental_pages(
    raw: DataFrame,
    marks: DataFrame | None = None,
    since: str | None = None,
    until: str | None = None,
    full: bool = False,
    index: DataFrame | None = None,
) -> DataFrame:
    """Pages to load: everything, an explicit ``[since, until)``, or newer than each product's own mark.

    The landing index tells the products without a mark and those with nothing new, so all pages come from one scan
    that begins at the earliest page wanted. Without an index it is made here, which reads the page times of the log.
    Every page names its product.
    """
    if full:
        return raw
    if since is not None or until is not None:
        if since is not None:
            raw = raw.filter(F.col("fetched_at") >= F.lit(since).cast("timestamp"))
        if until is not None:
            raw = raw.filter(F.col("fetched_at") < F.lit(until).cast("timestamp"))
        return raw
    if marks is None:
        return raw
    own = marks.filter("loaded_from is not null").select("app_id", F.col("loaded_from").alias("_mark"))
    index = landing_index(raw) if index is None else index
    # pages behind the mark; of a product without one, all from the first on
    wanted = index.join(own, "app_id", "left").filter("_mark is null or last_page > _mark")
    wanted = wanted.select("app_id", "_mark", F.coalesce("_mark", "first_page").alias("_from"))
    least = wanted.agg(F.min("_from")).scalar()
    newer = F.col("_mark").isNull() | (F.col("fetched_at") > F.col("_mark"))
    return raw.filter(F.col("fetched_at") >= least).join(wanted, "app_id").filter(newer).drop("_mark", "_from")


def watermark_seed(facts: DataFrame, raw: DataFrame) -> DataFrame:
    """Facts of unknown origin get the earliest page time, so the first incremental run rereads everything."""
    earliest = raw.agg(F.min("fetched_at")).scalar()
    return facts.withColumn("loaded_from", F.coalesce(F.col("loaded_from"), earliest))


def review_facts(reviews: DataFrame, dim: DataFrame, languages: DataFrame) -> DataFrame:
    """Typed reviews -> fact rows with dimension keys (one row per review, from its newest page)."""
    newest = latest_per_key(reviews, ["recommendation_id"], [F.desc("fetched_at"), F.desc("raw_id")])
    keyed = scd2_lookup(newest, dim, "created_at")
    codes = languages.select(F.col("language_code").alias("_code"), "language_sk")
    return (
        keyed.join(codes, keyed["language_code"] == F.col("_code"), "left")
        .withColumn("language_sk", F.coalesce("language_sk", F.lit(UNKNOWN)))
        .withColumn("date_sk", date_key(F.col("created_at")))
        .withColumn("time_sk", hour_key(F.col("created_at")))
        .withColumn("loaded_from", F.col("fetched_at"))
        .select("recommendation_id", *IMMUTABLE, *MUTABLE, "review_body")
    )


def merge_reviews(store: DataFrame, batch: DataFrame, key: str = "recommendation_id",
                  immutable: tuple = IMMUTABLE, mutable: tuple = MUTABLE + ("review_body",)) -> DataFrame:
    """Upsert by review: immutable columns keep their first value, mutable ones follow the newest page.

    An older page never rolls counters back. Store and batch have one row per review and are read
    once each; a store bucketed by its key is not shuffled.
    """
    fresh = batch.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in immutable + mutable])
    joined = store.join(fresh, store[key] == F.col("_key"), "full")
    stored = F.col(key).isNotNull()
    newer = F.col("_key").isNotNull() & (
        ~stored | F.col("loaded_from").isNull() | (F.col("_loaded_from") >= F.col("loaded_from"))
    )
    return joined.select(
        F.coalesce(key, "_key").alias(key),
        *[F.when(stored, F.col(c)).otherwise(F.col(f"_{c}")).alias(c) for c in immutable],
        *[F.when(newer, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in mutable],
    )


def upsert_languages(dim: DataFrame, reviews: DataFrame) -> DataFrame:
    """Dimension with the new non-empty codes added."""
    codes = reviews.select("language_code").filter(F.col("language_code") != "").distinct()
    fresh = codes.join(dim, "language_code", "left_anti")
    return dim.select("language_sk", "language_code").unionByName(
        fresh.select(stable_key(F.lit("language"), F.col("language_code")).alias("language_sk"), "language_code")
    )


def patch_facts(items: DataFrame, dim: DataFrame) -> DataFrame:
    """News items -> one classified event per (news id, product), from the newest page."""
    newest = latest_per_key(items, ["gid", "app_id"], [F.desc("fetched_at"), F.desc("raw_id")])
    keyed = scd2_lookup(newest, dim, "published_at")
    kind = news_kind(F.col("title"), F.col("feed_type"))
    return keyed.withColumn("event_type", kind).select(
        "gid", "game_sk", date_key(F.col("published_at")).alias("date_sk"), "published_at", "title", "url",
        "feed_type", "feedname", "body_length", (F.col("event_type") == "patch").alias("is_patch"), "event_type",
        news_version(F.col("title"), F.col("feed_type")).alias("version"),
    )


def replace_by_key(store: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """Upsert where the incoming row overwrites the stored one as a whole."""
    kept = store.join(batch.select(*keys), keys, "left_anti")
    return kept.unionByName(batch.select(*store.columns))


def merge_patches(store: DataFrame, batch: DataFrame) -> DataFrame:
    return replace_by_key(store, batch, ["gid", "game_sk"])


def platform_facts(items: DataFrame) -> DataFrame:
    """Events of the platform itself: newest copy per news id, those that match no kind dropped."""
    own = items.filter((F.col("app_id") == PLATFORM_APP_ID) & (F.col("feed_type") == 0))
    newest = latest_per_key(own, ["gid"], [F.desc("fetched_at"), F.desc("raw_id")])
    return newest.select(
        "gid", utc_day(F.col("published_at")).alias("event_date"),
        platform_kind(F.col("title")).alias("event_type"), "title", "url", F.col("feedname").alias("source"),
    ).filter("event_type is not null")


def new_records(batch: DataFrame, store: DataFrame, key: str, page: str | None = None) -> DataFrame:
    """Ids of a fetched batch that the store lacks, or, per page, whether all of its ids are known."""
    if page is None:
        return batch.select(key).distinct().join(store.select(key), key, "left_anti")
    ids = batch.select(page, key).distinct()
    known = store.select(key).distinct().withColumn("_known", F.lit(True))
    return (
        ids.join(known, key, "left")
        .groupBy(page)
        .agg(
            F.count("*").alias("ids"),
            F.count_if(F.col("_known").isNull()).alias("new_ids"),
            F.bool_and(F.coalesce("_known", F.lit(False))).alias("fully_known"),
        )
    )


def depth_stop(pages: DataFrame, days_of_history: int) -> DataFrame:
    """Per product: history held by the pages, and the page on which it crosses the wanted depth.

    ``pages`` has (app_id, page, oldest, fetched_at); collection stops after the crossing page.
    """
    cutoff = F.col("fetched_at") - F.make_dt_interval(F.lit(days_of_history))
    crossed = F.when(F.col("oldest") < cutoff, F.col("page"))
    return pages.groupBy("app_id").agg(
        F.count("*").alias("pages"),
        F.min("oldest").alias("oldest"),
        F.date_diff(F.max("fetched_at"), F.min("oldest")).alias("days_held"),
        F.min(crossed).alias("stop_page"),
    )
