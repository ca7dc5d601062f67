"""Report frames over any set of products."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.operators import events as ev
from tideline.operators import series as sr
from tideline.session import written


def game_dashboard(
    daily: DataFrame, events: DataFrame, platform: DataFrame, smoothing: str | int = "auto",
    min_weight: float = 0.0, sensitivity: float = sr.SENSITIVITY,
) -> DataFrame:
    """Everything one screen shows, as rows of kind day, event, platform or point.

    ``value`` is the share, weight or shift; ``base`` and ``delta`` belong to days; ``detail`` the kind of event or headline of the point.
    """
    daily = written(daily, "daily")
    series = written(sr.sentiment_series(daily, smoothing), "series")
    points = written(sr.change_points(series, sensitivity=sensitivity), "points")
    none = F.lit(None)
    days = series.select(
        "app_id", F.lit("day").alias("kind"), "day", F.col("pct").alias("value"), F.col("total").cast("bigint").alias("reviews"),
        "base", "delta", none.cast("string").alias("detail"), none.cast("string").alias("title"))
    bare = [none.cast("bigint").alias("reviews"), none.cast("double").alias("base"), none.cast("double").alias("delta")]
    shown = ev.chart_events(events, series.select("app_id", "day", "total", "positive"), min_weight).select(
        "app_id", F.lit("event").alias("kind"), "day", F.col("weight").cast("double").alias("value"),
        *bare, F.col("event_type").alias("detail"), "title")
    beside = ev.platform_events_in_range(platform, daily).select(
        "app_id", F.lit("platform").alias("kind"), F.col("event_date").alias("day"), none.cast("double").alias("value"),
        *bare, F.col("event_type").alias("detail"), "title")
    explained = ev.explained_points(points, events, platform, ev.series_bounds(daily))
    heads = ev.main_event(explained).select(
        "app_id", F.lit("point").alias("kind"), F.col("point_day").alias("day"), F.col("score").alias("value"),
        *bare, F.col("headline").alias("detail"), none.cast("string").alias("title"))
    return days.unionByName(shown).unionByName(beside).unionByName(heads)
