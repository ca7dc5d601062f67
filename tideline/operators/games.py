"""The versioned game dimension: current rows, type-2 changes, bridges, repair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.numbers import stable_key
from tideline.operators.facts import UNKNOWN

# fixed values: first version of any product starts here; open versions end here
FIRST_VERSION_FROM = "2000-01-01 00:00:00"
OPEN_END = "9999-12-31 23:59:59"
# fixed values: attributes whose change opens a new version
TRACKED = (
    "app_type", "is_free", "required_age", "metacritic_score", "is_coming_soon",
    "release_date_raw", "release_date_parsed",
)
FIELDS = ("app_id", "game_name", "metacritic_url") + TRACKED
VERSION = ("game_sk",) + FIELDS + ("valid_from", "valid_to", "is_current", "collection_status")


def dim_game_current(dim: DataFrame) -> DataFrame:
    return dim.filter(F.col("is_current") & (F.col("app_id") > 0)).select(
        "game_sk", "app_id", "game_name", "app_type", "is_free", "metacritic_score",
        "release_date_parsed", "collection_status",
    )


def known_games(raw: DataFrame, dim: DataFrame) -> DataFrame:
    """Products seen in the landing pages, named by the current version or by their id."""
    names = dim.filter("is_current").select("app_id", "game_name")
    return raw.select("app_id").distinct().join(names, "app_id", "left").select(
        "app_id", F.coalesce(F.nullif("game_name", F.lit("")), F.col("app_id").cast("string")).alias("game_name")
    )


def enabled_games(df: DataFrame, games: DataFrame) -> DataFrame:
    return df.join(games.filter("enabled").select("app_id"), "app_id", "left_semi")


def game_list(current: DataFrame) -> DataFrame:
    return current.select("app_id", "game_name", "collection_status").orderBy("game_name", "app_id")


def _version(fields, valid_from: Column) -> list[Column]:
    return [
        stable_key(F.col("app_id"), valid_from).alias("game_sk"), *[fields(c) for c in FIELDS],
        valid_from.alias("valid_from"), F.lit(OPEN_END).cast("timestamp").alias("valid_to"),
        F.lit(True).alias("is_current"), F.lit(None).cast("string").alias("collection_status"),
    ]


def scd2_apply(dim: DataFrame, incoming: DataFrame, now: str) -> DataFrame:
    """Applies newly read cards (one per product).

    A tracked attribute that changed closes the current version at ``now`` and opens the next;
    otherwise name and link are overwritten in place. The dimension has one row per version, the
    incoming side one row per product, and both meet on the product.
    """
    at = F.lit(now).cast("timestamp")
    cards = incoming.select(F.col("app_id").alias("_app_id"), *[F.col(c).alias(f"_{c}") for c in FIELDS[1:]])
    joined = dim.join(cards, F.col("is_current") & (F.col("app_id") == F.col("_app_id")), "left")
    same = F.lit(True)
    for c in TRACKED:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    matched = F.col("_app_id").isNotNull()
    changed = matched & ~same
    stored = joined.withColumn("_changed", changed).withColumn("_touched", matched & same)
    old = stored.select(
        "game_sk", "app_id",
        F.when(F.col("_touched"), F.col("_game_name")).otherwise(F.col("game_name")).alias("game_name"),
        F.when(F.col("_touched"), F.col("_metacritic_url")).otherwise(F.col("metacritic_url")).alias("metacritic_url"),
        *TRACKED, "valid_from",
        F.when(F.col("_changed"), at).otherwise(F.col("valid_to")).alias("valid_to"),
        (F.col("is_current") & ~F.col("_changed")).alias("is_current"),
        "collection_status",
    )
    opened = stored.filter("_changed").select(*_version(
        lambda c: F.col("app_id") if c == "app_id" else F.col(f"_{c}").alias(c), at))
    current = dim.filter("is_current").select("app_id")
    created = incoming.join(current, "app_id", "left_anti").select(*_version(
        F.col, F.lit(FIRST_VERSION_FROM).cast("timestamp")))
    return old.unionByName(opened).unionByName(created)


def bridge_replace(old: DataFrame, new: DataFrame, touched: DataFrame, key: str = "game_sk") -> DataFrame:
    """Bridge rows of the touched versions are rebuilt, those of other versions stay.

    ``touched`` names every version whose card was read, with links or without.
    """
    kept = old.join(touched.select(key).distinct(), key, "left_anti")
    return kept.unionByName(new.select(*old.columns).distinct())


def upsert_names(dim: DataFrame, incoming: DataFrame, key: str, name: str, stamp: str) -> DataFrame:
    """Genres or categories by id, with new ones added; of several names the one of the newest card counts, then the least."""
    latest = incoming.groupBy(key).agg(F.max(stamp).alias("_at"))
    told = incoming.join(latest, key).filter(F.col(stamp) == F.col("_at")).groupBy(key).agg(F.min(name).alias("_name"))
    return dim.join(told, key, "full").select(key, F.coalesce("_name", name).alias(name))


def upsert_companies(dim: DataFrame, incoming: DataFrame) -> DataFrame:
    """Companies by name, with new ones added."""
    fresh = incoming.select("company_name").distinct().join(dim, "company_name", "left_anti")
    return dim.select("company_sk", "company_name").unionByName(
        fresh.select(stable_key(F.lit("company"), F.col("company_name")).alias("company_sk"), "company_name"))


def mark_status(dim: DataFrame, runs: DataFrame) -> DataFrame:
    """Current versions become ``partial`` once the card is loaded and ``complete`` after all steps."""
    results = runs.select("app_id", "card_loaded", "all_steps")
    joined = dim.join(results, "app_id", "left")
    status = (
        F.when(F.col("is_current") & F.col("all_steps"), "complete")
        .when(F.col("is_current") & F.col("card_loaded"), "partial")
        .otherwise(F.col("collection_status"))
    )
    return joined.withColumn("collection_status", status).drop("card_loaded", "all_steps")


def repair_scd2(dim: DataFrame) -> DataFrame:
    """Each version starts where the previous one of its product ended."""
    order = Window.partitionBy("app_id").orderBy("valid_to", "game_sk")
    previous = F.when(F.col("app_id") > 0, F.lag("valid_to").over(order))
    return dim.withColumn("valid_from", F.coalesce(previous, "valid_from"))


def repoint_facts(facts: DataFrame, dim: DataFrame, instant: str) -> DataFrame:
    """Facts move to the version of their own product that was valid at their instant."""
    owner = dim.select("game_sk", F.col("app_id").alias("_owner"))
    versions = dim.filter("app_id > 0").select(
        F.col("app_id").alias("_app"), F.col("game_sk").alias("_to"), F.col("valid_from").alias("_from"),
        F.col("valid_to").alias("_until"))
    at = F.col(instant)
    joined = facts.join(owner, "game_sk", "left").join(
        versions, (F.col("_owner") == F.col("_app")) & (at >= F.col("_from")) & (at < F.col("_until")), "left")
    moved = F.when(F.col("game_sk") == UNKNOWN, F.col("game_sk")).otherwise(F.coalesce("_to", "game_sk"))
    return joined.withColumn("game_sk", moved).select(*facts.columns)
