"""Detector and daily series on hand-made and random inputs."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tideline.operators import series

DAY = dt.date(2024, 1, 1)


def daily(spark, rows):
    return spark.createDataFrame(
        [(a, DAY + dt.timedelta(days=d), n, p) for a, d, n, p in rows],
        "app_id int, day date, review_count bigint, positive_count bigint")


def test_gaps_become_zeros(spark):
    rows = series.densify(daily(spark, [(1, 0, 5, 4), (1, 3, 2, 1), (2, 1, 1, 1)])).orderBy("app_id", "day").collect()
    assert [(r.app_id, (r.day - DAY).days, r.total, r.positive) for r in rows] == [
        (1, 0, 5, 4), (1, 1, 0, 0), (1, 2, 0, 0), (1, 3, 2, 1), (2, 1, 1, 1)]


@pytest.mark.parametrize("volumes, expected", [([1, 2, 3, 4], 3), ([1, 2], 2), ([5], 5), ([1, 2, 3], 2)])
def test_upper_median(spark, volumes, expected):
    df = daily(spark, [(1, i, v, 0) for i, v in enumerate(volumes)])
    assert series.half_window(series.densify(df)).first().median_volume == expected


@pytest.mark.parametrize("volume, half", [(100, 1), (99, 3), (30, 3), (29, 7), (10, 7), (9, 14)])
def test_half_window_by_volume(spark, volume, half):
    df = daily(spark, [(1, i, volume, 0) for i in range(3)])
    assert series.half_window(series.densify(df)).first().half == half


def test_explicit_and_switched_off_smoothing(spark):
    df = daily(spark, [(1, 0, 10, 10), (1, 1, 10, 0), (1, 2, 10, 10)])
    dense = series.densify(df)
    off = [r.pct for r in series.smooth(series.half_window(dense, "off"), "off").orderBy("day").collect()]
    assert off == [100.0, 0.0, 100.0]
    three = [r.pct for r in series.smooth(series.half_window(dense, 3), 3).orderBy("day").collect()]
    assert three == [50.0, 66.7, 50.0]


def test_baseline_needs_fourteen_days(spark):
    df = daily(spark, [(1, i, 100, 50 + i % 2) for i in range(20)])
    rows = series.sentiment_series(df, "off").orderBy("day").collect()
    assert [r.base is None for r in rows] == [True] * 14 + [False] * 6
    assert rows[14].base == 51.0 and rows[14].delta == -1.0


def test_flat_series_has_no_points(spark):
    df = daily(spark, [(1, i, 100, 70) for i in range(60)])
    assert series.change_points(series.sentiment_series(df)).count() == 0


def test_short_series_gives_a_reason(spark):
    # 35 days score on days 3..32: thirty windows; one day fewer is not enough
    for days, reason in ((35, None), (34, "too few scored days")):
        df = daily(spark, [(1, i, 100, 90 if i < 17 else 50) for i in range(days)])
        scored = series.shift_score(series.sentiment_series(df))
        row = series.threshold(scored).first()
        assert (row.scored_days, row.reason) == (days - 5, reason)
        assert (series.candidates(scored).count() > 0) == (reason is None)


def test_one_step_is_one_point(spark):
    df = daily(spark, [(1, i, 100, 90 if i < 40 else 50) for i in range(80)])
    points = series.change_points(series.sentiment_series(df)).collect()
    assert [(r.day - DAY).days for r in points] == [40]
    assert points[0].score < -30


def _python_points(rows, half=7, gap=7, k=1.5):
    """Plain restatement of the detector for one product, to check the plan against."""
    scores = []
    for i in range(len(rows)):
        before = [p for p in rows[max(0, i - half):i] if p is not None]
        after = [p for p in rows[i:i + half] if p is not None]
        scores.append(None if min(len(before), len(after)) < half // 2 else round(sum(after) / len(after) - sum(before) / len(before), 6))
    sizes = [abs(s) for s in scores if s is not None]
    if len(sizes) < 30:
        return []
    mean = sum(sizes) / len(sizes)
    limit = mean + k * (sum((x - mean) ** 2 for x in sizes) / len(sizes)) ** 0.5
    ranked = sorted((i for i, s in enumerate(scores) if s is not None and abs(s) > limit and abs(s) >= 1), key=lambda i: (-abs(scores[i]), i))
    kept = []
    for i in ranked:
        if all(abs(i - j) >= gap for j in kept):
            kept.append(i)
    return sorted(kept)


def test_points_of_random_series_match_a_plain_loop(spark):
    rng = random.Random(5)
    rows = []
    for app in range(1, 9):
        level = 70
        for d in range(160):
            if rng.random() < 0.03:
                level = rng.randint(30, 95)
            if rng.random() > 0.05:
                n = rng.randint(20, 200)
                rows.append((app, d, n, sum(rng.random() * 100 < level for _ in range(n))))
    smoothed = series.sentiment_series(daily(spark, rows))
    found = {a: [] for a in range(1, 9)}
    for r in series.change_points(smoothed).orderBy("app_id", "day").collect():
        found[r.app_id].append(r.day)
    for app in found:
        own = smoothed.filter(F.col("app_id") == app).orderBy("day").collect()
        assert found[app] == [own[i].day for i in _python_points([r.pct for r in own])]


def test_top_points_are_the_strongest(spark):
    points = spark.createDataFrame([(1, DAY + dt.timedelta(days=10 * i), float(s)) for i, s in enumerate([3, -9, 5, -5])], "app_id int, day date, score double")
    assert [r.score for r in series.top_points(points, 3).orderBy("rank").collect()] == [-9.0, 5.0, -5.0]
