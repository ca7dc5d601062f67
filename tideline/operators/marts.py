"""Daily marts. They hold counts, never shares; dividing comes last, on sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.dates import utc_day
from tideline.functions.text import MIN_CONTENT_LENGTH, is_content, text_hash
from tideline.operators.facts import UNKNOWN

# fixed values: the general-impression aspect and its category, the service categories, the signs
OVERALL = "overall_impression"
OVERALL_CATEGORY = "overall"
SERVICE = ("overall", "other")
SIGNS = ("+", "-", "±")
COUNTED_STATUS = ("labeled", "no_opinion")

DAY_KEYS = ["app_id", "day", "llm_config_sk"]


def active_config(configs: DataFrame, model: str, prompt_hash_prefix: str) -> DataFrame:
    return configs.filter((F.col("model") == model) & F.col("prompt_hash").startswith(prompt_hash_prefix))


def review_flat(facts: DataFrame, games: DataFrame, languages: DataFrame) -> DataFrame:
    """One row per review of a known product, with its product id, language code and UTC day."""
    known = games.filter("app_id > 0").select("game_sk", "app_id")
    return (
        facts.select("recommendation_id", "game_sk", "language_sk", "created_at", "is_voted_up")
        .join(known, "game_sk")
        .join(languages.select("language_sk", "language_code"), "language_sk")
        .select(
            "app_id", F.col("recommendation_id").alias("review_id"), "created_at",
            F.col("is_voted_up").alias("voted_up"), "language_code", utc_day(F.col("created_at")).alias("created_date"),
        )
    )


def review_daily(flat: DataFrame) -> DataFrame:
    return flat.groupBy("app_id", utc_day(F.col("created_at")).alias("day")).agg(
        F.count("*").alias("review_count"), F.count_if("voted_up").alias("positive_count")
    )


def data_bounds(flat: DataFrame) -> DataFrame:
    return flat.groupBy("app_id").agg(F.min("created_at").alias("data_from"), F.max("created_at").alias("data_to"))


def unknown_ratio(**facts: DataFrame) -> DataFrame:
    """Share of each fact table on the Unknown product."""
    rows = [
        df.agg((F.count_if(F.col("game_sk") == UNKNOWN) / F.nullif(F.count("*"), F.lit(0))).alias("ratio"))
        .select(F.lit(name).alias("table_name"), "ratio")
        for name, df in facts.items()
    ]
    return union_marts(*rows)


def union_marts(*marts: DataFrame) -> DataFrame:
    out = marts[0]
    for m in marts[1:]:
        out = out.unionByName(m)
    return out


def reviews_with_text(facts: DataFrame, games: DataFrame, texts: DataFrame, min_length: int) -> DataFrame:
    """(app_id, day, recommendation_id, is_content) of the reviews of known products.

    The flag is computed where the texts are read, so no text body is shuffled.
    """
    known = games.filter("app_id > 0").select("game_sk", "app_id")
    flags = texts.select("recommendation_id", is_content(F.col("review_body"), min_length).alias("_flag"))
    return (
        facts.select("recommendation_id", "game_sk", "created_at")
        .join(known, "game_sk")
        .join(flags, "recommendation_id", "left")
        .select(
            "app_id", utc_day(F.col("created_at")).alias("day"), "recommendation_id",
            F.coalesce("_flag", F.lit(min_length <= 0)).alias("is_content"),
        )
    )


def content_by_day(reviews: DataFrame) -> DataFrame:
    return reviews.filter("is_content").groupBy("app_id", "day").agg(F.count("*").alias("content"))


def review_labeled(
    labels: DataFrame, versions: DataFrame, facts: DataFrame, games: DataFrame, texts: DataFrame,
    min_length: int = MIN_CONTENT_LENGTH,
) -> DataFrame:
    """Labels that count: of the review's present text, not failed, long enough; one row per review and config.

    Texts are reduced to hash and flag before any join; their bodies stay where they are read.
    """
    body = F.col("review_body")
    present = texts.filter(is_content(body, min_length)).select("recommendation_id", text_hash(body).alias("text_hash"))
    current = versions.filter("is_current").select("review_text_sk", "recommendation_id", "text_hash")
    known = games.filter("app_id > 0").select("game_sk", "app_id")
    return (
        labels.filter(F.col("status").isin(*COUNTED_STATUS))
        .select("labeling_sk", "review_text_sk", "llm_config_sk")
        .join(current, "review_text_sk")
        .join(present, ["recommendation_id", "text_hash"])
        .join(facts.select("recommendation_id", "game_sk", "created_at"), "recommendation_id")
        .join(known, "game_sk")
        .select("app_id", utc_day(F.col("created_at")).alias("day"), "recommendation_id", "llm_config_sk", "labeling_sk")
    )


def config_day_grid(days: DataFrame, labeled: DataFrame) -> DataFrame:
    """Every day of a product for every config that ever labelled it; days without labels count zero."""
    counts = labeled.groupBy(*DAY_KEYS).agg(F.count("*").alias("labeled_count"))
    configs = counts.select("app_id", "llm_config_sk").distinct()
    return (
        days.join(configs, "app_id")
        .join(counts, DAY_KEYS, "left")
        .withColumn("labeled_count", F.coalesce("labeled_count", F.lit(0)))
    )


def review_labeling_daily(reviews: DataFrame, labeled: DataFrame) -> DataFrame:
    """The three denominators of a day and config: all reviews, those with content, those labelled."""
    days = reviews.groupBy("app_id", "day").agg(
        F.count("*").alias("review_count"), F.count_if("is_content").alias("content_count")
    )
    return config_day_grid(days, labeled).select(*DAY_KEYS, "review_count", "content_count", "labeled_count")


def fold_sentiment(sign: str = "sentiment") -> Column:
    """Aggregate: the common sign of a group, ``±`` when signs differ.

    Signs are folded as bits, an integer buffer that hash aggregation can hold; the smallest and
    largest of strings would need sorting.
    """
    bit = F.when(F.col(sign) == "+", 1).when(F.col(sign) == "-", 2).when(F.col(sign).isNotNull(), 4)
    folded = F.bit_or(bit)
    return F.when(folded == 1, "+").when(folded == 2, "-").otherwise("±")


def review_tags(labeled: DataFrame, tags: DataFrame, aspects: DataFrame) -> DataFrame:
    return (
        labeled.join(tags.select("labeling_sk", "importance", "aspect_sk", "sentiment", "note"), "labeling_sk")
        .join(aspects.select("aspect_sk", "aspect_id", "category_id"), "aspect_sk")
        .select("app_id", "day", "llm_config_sk", "labeling_sk", "importance", "category_id", "aspect_id", "sentiment", "note")
    )


def review_aspect_tag(tags: DataFrame) -> DataFrame:
    """One row per (label, aspect). The general impression stays only when it is the review's single tag.

    Tags come from their join sorted by label, so the count over a review runs over them as they come; folding first would
    take that order away and sort the folded rows once more.
    """
    keys = ["app_id", "day", "llm_config_sk", "labeling_sk", "category_id", "aspect_id"]
    counted = tags.withColumn("_all", F.count("*").over(Window.partitionBy("labeling_sk")))
    return (
        counted.filter((F.col("aspect_id") != OVERALL) | (F.col("_all") == 1))
        .groupBy(*keys).agg(fold_sentiment().alias("sentiment"))
    )


def aspects_per_review(tags: DataFrame) -> DataFrame:
    return tags.groupBy("labeling_sk").agg(F.count("*").alias("review_aspects"))


def _by_sign(tags: DataFrame, keys: list[str]) -> DataFrame:
    return tags.groupBy(*keys).agg(
        F.count("*").alias("review_count"),
        F.count_if(F.col("sentiment") == "+").alias("positive_count"),
        F.count_if(F.col("sentiment") == "-").alias("negative_count"),
        F.count_if(F.col("sentiment") == "±").alias("mixed_count"),
    )


def _with_denominators(counts: DataFrame, denominators: DataFrame) -> DataFrame:
    den = denominators.select(
        *DAY_KEYS, F.col("review_count").alias("day_review_count"),
        F.col("content_count").alias("day_content_count"), F.col("labeled_count").alias("day_labeled_count"),
    )
    return counts.join(den, DAY_KEYS)


def review_aspect_daily(aspect_tags: DataFrame, denominators: DataFrame) -> DataFrame:
    return _with_denominators(_by_sign(aspect_tags, DAY_KEYS + ["category_id", "aspect_id"]), denominators)


def review_category_daily(aspect_tags: DataFrame, denominators: DataFrame) -> DataFrame:
    """Different reviews per category: a review with two aspects of a category counts once."""
    per_review = aspect_tags.groupBy(*DAY_KEYS, "labeling_sk", "category_id").agg(fold_sentiment().alias("sentiment"))
    return _with_denominators(_by_sign(per_review, DAY_KEYS + ["category_id"]), denominators)


def daily_votes(daily: DataFrame) -> DataFrame:
    return daily.select(
        "app_id", "day", F.col("review_count").alias("total"),
        (F.col("review_count") - F.col("positive_count")).alias("negative"),
    )


def reconcile(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows where two aggregates disagree, a missing side included."""
    left = a.select(*keys, F.col(value).alias("expected"))
    right = b.select(*keys, F.col(value).alias("found"))
    return left.join(right, keys, "full_outer").filter(~F.col("expected").eqNullSafe(F.col("found")))
