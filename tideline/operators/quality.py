"""Data-quality checks. Each returns the offending rows; an empty result passes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.operators.marts import DAY_KEYS, OVERALL, OVERALL_CATEGORY, reconcile, union_marts

UNKNOWN_MAX_RATIO = 0.05


def dq_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def dq_not_null(df: DataFrame, columns: list[str], show: list[str]) -> DataFrame:
    """Rows with a null in a required column, with the first such column named."""
    missing = F.coalesce(*[F.when(F.col(c).isNull(), c) for c in columns])
    return df.select(*show, missing.alias("missing")).filter("missing is not null")


def dq_one_row(configs: DataFrame) -> DataFrame:
    return configs.agg(F.count("*").alias("n")).filter("n <> 1")


def dq_sign_counts(daily: DataFrame, key: str) -> DataFrame:
    """Signs must add up to the reviews, and reviews may not exceed the labelled ones."""
    signs = F.col("positive_count") + F.col("negative_count") + F.col("mixed_count")
    return daily.filter((signs != F.col("review_count")) | (F.col("review_count") > F.col("day_labeled_count"))).select(
        *DAY_KEYS, key, "review_count", "positive_count", "negative_count", "mixed_count", "day_labeled_count")


def dq_nested_counts(denominators: DataFrame) -> DataFrame:
    return denominators.filter(
        ~((F.col("labeled_count") <= F.col("content_count")) & (F.col("content_count") <= F.col("review_count"))))


def dq_category_vs_aspects(categories: DataFrame, aspects: DataFrame) -> DataFrame:
    """A category has at least the reviews of its largest aspect and at most their sum."""
    keys = [*DAY_KEYS, "category_id"]
    sums = aspects.groupBy(*keys).agg(F.max("review_count").alias("max_aspect"), F.sum("review_count").alias("sum_aspects"))
    joined = categories.select(*keys, "review_count").join(sums, keys, "full_outer")
    n = F.col("review_count")
    return joined.filter(
        n.isNull() | F.col("max_aspect").isNull() | (n < F.col("max_aspect")) | (n > F.col("sum_aspects")))


def dq_overall_alone(tags: DataFrame, aspect_daily: DataFrame, category_daily: DataFrame) -> DataFrame:
    """The general impression in both marts against a recount of reviews where it is the only tag."""
    alone = (
        tags.groupBy(*DAY_KEYS, "labeling_sk").agg(F.count("*").alias("_n"), F.max("aspect_id").alias("_aspect"))
        .filter((F.col("_n") == 1) & (F.col("_aspect") == OVERALL))
        .groupBy(*DAY_KEYS).agg(F.count("*").alias("n")))
    marts = F.array(F.lit("review_aspect_daily"), F.lit("review_category_daily"))
    expected = alone.withColumn("mart", F.explode(marts))
    found = union_marts(
        aspect_daily.filter(F.col("aspect_id") == OVERALL).select(
            F.lit("review_aspect_daily").alias("mart"), *DAY_KEYS, F.col("review_count").alias("n")),
        category_daily.filter(F.col("category_id") == OVERALL_CATEGORY).select(
            F.lit("review_category_daily").alias("mart"), *DAY_KEYS, F.col("review_count").alias("n")))
    return reconcile(expected, found, ["mart", *DAY_KEYS], "n")


def dq_note_only_other(tags: DataFrame) -> DataFrame:
    """A note belongs to ``other`` and is required there."""
    has_note = F.nullif(F.trim("note"), F.lit("")).isNotNull()
    return tags.filter((F.col("aspect_id") == "other") != has_note).select("labeling_sk", "importance", "aspect_id", "note")


def dq_unknown_ratio(ratios: DataFrame, most: float = UNKNOWN_MAX_RATIO) -> DataFrame:
    return ratios.filter(F.col("ratio") > most)


def dq_accepted(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    """Values outside the accepted ones, with how often they occur."""
    return df.filter(~F.col(column).isin(*values)).groupBy(column).agg(F.count("*").alias("n"))


def dq_foreign_key(facts: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """Keys of the facts that the dimension lacks, counted before the join."""
    used = facts.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    return used.join(dim.select(key), key, "left_anti")


def dq_aspect_once(tags: DataFrame) -> DataFrame:
    """An aspect (with its note) twice in one label, or a tag importance outside 1..5."""
    counted = tags.groupBy("labeling_sk", "aspect_sk", F.coalesce("note", F.lit("")).alias("note")).agg(
        F.count("*").alias("n"), F.count_if(~F.col("importance").between(1, 5)).alias("bad_importance"))
    return counted.filter("n > 1 or bad_importance > 0")


def dq_scd2_overlap(dim: DataFrame) -> DataFrame:
    """Versions that start before an earlier version of their product, any of them, has ended."""
    earlier = Window.partitionBy("app_id").orderBy("valid_from", "game_sk").rowsBetween(Window.unboundedPreceding, -1)
    return dim.filter("app_id > 0").withColumn("earlier_to", F.max("valid_to").over(earlier)).filter(
        F.col("valid_from") < F.col("earlier_to")).select("app_id", "game_sk", "valid_from", "valid_to", "earlier_to")


def dq_single_current(dim: DataFrame, key: str) -> DataFrame:
    return dq_unique(dim.filter("is_current"), [key])

