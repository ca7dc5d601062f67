"""Generated calendar and hour dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: first and last day of the full calendar
CALENDAR = ("2003-01-01", "2030-12-31")


def calendar_columns(day: Column) -> list[Column]:
    weekday = F.extract(F.lit("DAYOFWEEK_ISO"), day)
    return [
        F.date_format(day, "yyyyMMdd").cast("int").alias("date_sk"),
        day.alias("full_date"),
        F.year(day).alias("year"),
        F.quarter(day).alias("quarter"),
        F.month(day).alias("month"),
        F.date_format(day, "MMMM").alias("month_name"),
        F.dayofmonth(day).alias("day"),
        weekday.cast("int").alias("day_of_week"),
        F.date_format(day, "EEEE").alias("day_name"),
        F.weekofyear(day).alias("week_of_year"),
        (weekday >= 6).alias("is_weekend"),
        F.lit(False).alias("is_holiday"),
    ]


def dim_date(spark: SparkSession, first: str = CALENDAR[0], last: str = CALENDAR[1]) -> DataFrame:
    return calendar_between(spark.range(1).select(
        F.lit(first).cast("date").alias("first_day"), F.lit(last).cast("date").alias("last_day")))


def calendar_between(bounds: DataFrame) -> DataFrame:
    """Calendar rows for each day between ``first_day`` and ``last_day`` of a one-row frame."""
    days = bounds.select(F.explode(F.sequence("first_day", "last_day")).alias("d"))
    return days.select(*calendar_columns(F.col("d")))


def dim_time(spark: SparkSession) -> DataFrame:
    h = F.col("id")
    return spark.range(24).select(
        h.cast("smallint").alias("time_sk"),
        F.concat(F.lpad(h.cast("string"), 2, "0"), F.lit(":00")).alias("hour_label"),
        F.when(h <= 5, "night").when(h <= 11, "morning").when(h <= 17, "day").otherwise("evening").alias("daypart"),
        h.between(17, 23).alias("is_peak"),
    )
