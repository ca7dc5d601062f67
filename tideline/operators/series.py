"""Daily share series and change points, for every product in one plan.

All windows are partitioned by product and ordered by day. Such a partition holds calendar days,
not reviews, so even the busiest product is a few thousand rows there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.numbers import half_up, share_pp

BASE_DAYS = 90
BASE_MIN_DAYS = 14
HALF_WINDOW = 7
MIN_GAP = 7
SENSITIVITY = 1.5
MIN_SHIFT_PP = 1.0
MIN_SCORED_DAYS = 30
# fixed values: (least median of daily reviews, half-window in days); below them all, the last half-window
VOLUME_STEPS = ((100, 1), (30, 3), (10, 7))
QUIET_HALF = 14


def _by_day() -> Window:
    return Window.partitionBy("app_id").orderBy("day")


def densify(daily: DataFrame) -> DataFrame:
    """Every day from a product's first to its last, with zeros on days without reviews.

    Each row is stretched up to the next one, which needs neither a separate pass for the bounds
    nor a join back to the daily counts.
    """
    following = F.lead("day").over(_by_day())
    last = F.coalesce(F.date_sub(following, 1), F.col("day"))
    spread = daily.withColumn("_last", last).withColumn("_day", F.explode(F.sequence("day", "_last")))
    real = F.col("_day") == F.col("day")
    return spread.select(
        "app_id", F.col("_day").alias("day"),
        F.when(real, F.col("review_count")).otherwise(F.lit(0)).alias("total"),
        F.when(real, F.col("positive_count")).otherwise(F.lit(0)).alias("positive"),
    )


def median_volume(column: str = "total") -> Column:
    """Upper median per product (of an even count, the larger middle value)."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {column} DESC) OVER (PARTITION BY app_id)").cast("bigint")


def half_window(series: DataFrame, smoothing: str | int = "auto") -> DataFrame:
    """Adds the median daily volume and the smoothing half-window it asks for."""
    with_median = series.withColumn("median_volume", median_volume())
    if smoothing == "off":
        half = F.lit(0)
    elif smoothing == "auto":
        half = F.lit(QUIET_HALF)
        for least, days in reversed(VOLUME_STEPS):
            half = F.when(F.col("median_volume") >= least, days).otherwise(half)
    else:
        half = F.lit(int(smoothing) // 2)
    return with_median.withColumn("half", half)


def smooth(series: DataFrame, smoothing: str | int = "auto") -> DataFrame:
    """Centred share of positives in percent, summed over the half-window on either side."""
    if smoothing == "auto":
        halves = [days for _, days in VOLUME_STEPS] + [QUIET_HALF]
    else:
        halves = [0 if smoothing == "off" else int(smoothing) // 2]

    def centred(column: str) -> Column:
        out = F.sum(column).over(_by_day().rowsBetween(-halves[-1], halves[-1]))
        for h in halves[:-1]:
            out = F.when(F.col("half") == h, F.sum(column).over(_by_day().rowsBetween(-h, h))).otherwise(out)
        return out

    sums = series.withColumn("_pos", centred("positive")).withColumn("window_n", centred("total"))
    return sums.withColumn("pct", share_pp(F.col("_pos"), F.col("window_n"))).drop("_pos")


def baseline(series: DataFrame) -> DataFrame:
    """Upper median of the shares of up to 90 days before, and the distance to it."""
    history = F.sort_array(F.collect_list("pct").over(_by_day().rowsBetween(-BASE_DAYS, -1)))
    with_history = series.withColumn("_history", history)
    n = F.size("_history")
    base = F.when(
        F.col("pct").isNotNull() & (n >= BASE_MIN_DAYS), F.get("_history", F.floor(n / 2).cast("int"))
    )
    return (
        with_history.withColumn("base", base)
        .withColumn("delta", half_up(F.col("pct") - F.col("base"), 1))
        .drop("_history")
    )


def sentiment_series(daily: DataFrame, smoothing: str | int = "auto") -> DataFrame:
    return baseline(smooth(half_window(densify(daily), smoothing), smoothing))


def shift_score(series: DataFrame, half: int = HALF_WINDOW) -> DataFrame:
    """Mean share of the next days (today included) minus that of the days before; null on thin windows."""
    before = _by_day().rowsBetween(-half, -1)
    after = _by_day().rowsBetween(0, half - 1)
    enough = (F.count("pct").over(before) >= half // 2) & (F.count("pct").over(after) >= half // 2)
    difference = F.avg("pct").over(after) - F.avg("pct").over(before)
    return series.withColumn("score", F.when(enough, half_up(difference, 6)))


def _with_threshold(scored: DataFrame, sensitivity: float) -> DataFrame:
    per_game = Window.partitionBy("app_id")
    size = F.abs("score")
    return scored.withColumn("scored_days", F.count("score").over(per_game)).withColumn(
        "threshold",
        F.when(
            F.col("scored_days") >= MIN_SCORED_DAYS,
            half_up(F.avg(size).over(per_game) + F.lit(float(sensitivity)) * F.stddev_pop(size).over(per_game), 6),
        ),
    )


def threshold(scored: DataFrame, sensitivity: float = SENSITIVITY) -> DataFrame:
    """Per product: scored days and the threshold, or why there is none."""
    size = F.abs("score")
    out = scored.groupBy("app_id").agg(
        F.count("*").alias("days"),
        F.count("score").alias("scored_days"),
        half_up(F.avg(size) + F.lit(float(sensitivity)) * F.stddev_pop(size), 6).alias("threshold"),
    )
    enough = F.col("scored_days") >= MIN_SCORED_DAYS
    return out.withColumn("threshold", F.when(enough, F.col("threshold"))).withColumn(
        "reason", F.when(~enough, "too few scored days"))


def candidates(scored: DataFrame, sensitivity: float = SENSITIVITY) -> DataFrame:
    size = F.abs("score")
    return _with_threshold(scored, sensitivity).filter((size > F.col("threshold")) & (size >= MIN_SHIFT_PP)).select(
        "app_id", "day", "score", "threshold")


def suppress(points: DataFrame, min_gap: int = MIN_GAP) -> DataFrame:
    """Greedy choice per product: strongest first, each at least ``min_gap`` days from those kept.

    The fold sees only candidate days of one product. Equal strengths go by the earlier day.
    """
    ranked = F.sort_array(F.collect_list(F.struct(
        (-F.abs("score")).alias("weakness"), F.col("day"), F.col("score"))))
    empty = F.array().cast("array<struct<day:date,score:double>>")
    kept = F.aggregate(
        "ranked", empty,
        lambda chosen, c: F.when(
            F.forall(chosen, lambda k: F.abs(F.date_diff(k["day"], c["day"])) >= min_gap),
            F.concat(chosen, F.array(F.struct(c["day"].alias("day"), c["score"].alias("score")))),
        ).otherwise(chosen),
    )
    return points.groupBy("app_id").agg(ranked.alias("ranked")).select("app_id", F.inline(kept))


def change_points(series: DataFrame, half: int = HALF_WINDOW, min_gap: int = MIN_GAP,
                  sensitivity: float = SENSITIVITY) -> DataFrame:
    return suppress(candidates(shift_score(series, half), sensitivity), min_gap)


def top_points(points: DataFrame, n: int = 10) -> DataFrame:
    order = Window.partitionBy("app_id").orderBy(F.desc(F.abs("score")), "day")
    return points.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)
