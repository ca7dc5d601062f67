"""Nothing is cut, dropped or overwritten: limits, late days, repeated runs, long words, equal lines."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tideline.functions import titles
from tideline.operators import games, labeling, planning, quality, verdicts
from tideline.session import scratch_path
from tideline.streaming import reviews as stream


def candidates(spark, n):
    return spark.range(n).select(
        F.lit(1).alias("app_id"), F.col("id").alias("recommendation_id"), F.lit(dt.date(2020, 1, 1)).alias("day"),
        F.lit(50).alias("length"), F.lit(None).cast("string").alias("status"))


@pytest.mark.parametrize("limit", [10, 300, 1000])
def test_a_day_limit_is_used_as_given(spark, limit):
    limits = spark.createDataFrame([(1, dt.date(2020, 1, 1), limit)], "app_id int, day date, day_limit int")
    assert planning.label_plan(candidates(spark, 400), limits).count() == min(limit, 400)


def test_a_high_plain_limit(spark):
    assert planning.label_plan(candidates(spark, 400), day_limit=350).count() == 350


def test_adaptive_gain_counts_beyond_any_fixed_limit(spark):
    spike = spark.createDataFrame([(1, dt.date(2020, 1, 1), 400, 10.0, True, 390)], "app_id int, day date, content long, median double, spike boolean, day_limit int")
    assert planning.adaptive_gain(candidates(spark, 400), spike, day_limit=50).first().added == 340


def feed(spark, base, rows, checkpoint="checkpoint"):
    """Lands rows as one more file and runs the stream until nothing waits."""
    schema = "recommendation_id long, app_id int, created_at timestamp, voted_up boolean, fetched_at timestamp"
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{base}/landing")
    source = spark.readStream.schema(schema).parquet(f"{base}/landing")
    stream.stream_review_daily(source, f"{base}/log", f"{base}/days", f"{base}/{checkpoint}").awaitTermination()
    return {(r.app_id, r.day.day): (r.review_count, r.positive_count) for r in stream.read_daily(spark, f"{base}/days").collect()}


def review(number, day, up=True, fetched=1):
    return (number, 1, dt.datetime(2020, 1, day, 12), up, dt.datetime(2020, 2, fetched))


def test_late_days_and_repeated_reviews_count_once(spark):
    base = scratch_path(spark, "late")
    assert feed(spark, base, [review(k, 20) for k in range(3)]) == {(1, 20): (3, 3)}
    assert feed(spark, base, [review(10 + k, 10) for k in range(7)]) == {(1, 20): (3, 3), (1, 10): (7, 7)}
    # collected again with another vote, and an older copy that comes later
    assert feed(spark, base, [review(0, 20, False, 3), review(30, 21)]) == {(1, 20): (3, 2), (1, 10): (7, 7), (1, 21): (1, 1)}
    assert feed(spark, base, [review(0, 20, True, 2)]) == {(1, 20): (3, 2), (1, 10): (7, 7), (1, 21): (1, 1)}


def test_a_fresh_checkpoint_replaces_nothing(spark):
    base = scratch_path(spark, "fresh")
    feed(spark, base, [review(1, 5), review(2, 6)])
    assert feed(spark, base, [review(3, 7)], "other") == {(1, 5): (1, 1), (1, 6): (1, 1), (1, 7): (1, 1)}
    logged = spark.read.parquet(f"{base}/log")
    assert logged.select("run").distinct().count() == 2


def test_long_words_keep_their_letters(spark):
    word = "a" * 1500
    title = spark.range(1).select(F.lit(f"Steam {word} Fest").alias("title"), F.lit("fest").alias("kind"))
    label = title.select(titles.platform_label(F.col("kind"), F.col("title")).alias("l")).first().l
    assert label.lower().count("a") >= 1500


def test_overlap_with_any_earlier_version(spark):
    def day(n):
        return dt.datetime(2020, 1, 1) + dt.timedelta(days=n)

    dim = spark.createDataFrame([(1, 1, day(0), day(100)), (1, 2, day(10), day(20)), (1, 3, day(30), day(40)), (1, 4, day(100), day(110))], "app_id int, game_sk long, valid_from timestamp, valid_to timestamp")
    assert sorted(r.game_sk for r in quality.dq_scd2_overlap(dim).collect()) == [2, 3]


def test_a_touched_version_without_links_loses_its_old_ones(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "game_sk long, link string")
    new = spark.createDataFrame([(3, "c")], "game_sk long, link string")
    touched = spark.createDataFrame([(1,), (3,)], "game_sk long")
    assert sorted(tuple(r) for r in games.bridge_replace(old, new, touched).collect()) == [(2, "b"), (3, "c")]


def test_any_failure_of_a_call_is_a_null_answer(spark):
    def labeler(text):
        raise KeyError(text)

    batches = spark.createDataFrame([(1, 1, 3, "p")], "app_id int, batch int, size int, prompt string")
    row = labeling.label_infer(batches, labeler).first()
    assert row.content is None and row.finish == "error: KeyError"


def lint(spark, talk, known):
    schema = """what_happened string, what_players_say string, news string, character string, volume string, main_diff double,
        before_negative double, after_negative double, known_numbers array<bigint>"""
    rows = [("Something quiet.", talk, "yes", "broad", "few", 0.0, 0.1, 0.2, known)]
    return verdicts.verdict_lint(spark.createDataFrame(rows, schema), ["some_topic"]).first()


def test_references_of_any_length_and_without_known_numbers(spark):
    huge = "1" * 25
    for known in ([1], None):
        row = lint(spark, f"They wait [{huge}].", known)
        assert row.checks_passed is False and row.problems is not None
