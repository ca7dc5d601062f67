"""Streams: keyed state of the daily counts, and what a batch reads."""

import datetime as dt
import json
import random

import numpy as np
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tideline.session import scratch_path
from tideline.sources import raw
from tideline.streaming import reviews as stream

SCHEMA = "recommendation_id long, app_id int, created_at timestamp, voted_up boolean, fetched_at timestamp"


def counted(rows):
    """Daily counts of the newest copy of each review."""
    newest = {}
    for r in rows:
        if r[0] not in newest or (r[4], r[3]) >= (newest[r[0]][4], newest[r[0]][3]):
            newest[r[0]] = r
    out = {}
    for _, app, at, up, _ in newest.values():
        n, p = out.get((app, at.date()), (0, 0))
        out[app, at.date()] = (n + 1, p + up)
    return out


def land(spark, base, rows, checkpoint="checkpoint"):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{base}/landing")
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{base}/landing")
    query = stream.stream_review_daily(source, f"{base}/log", f"{base}/days", f"{base}/{checkpoint}", states=3)
    query.awaitTermination()
    return {(r.app_id, r.day): (r.review_count, r.positive_count) for r in stream.read_daily(spark, f"{base}/days").collect()}, query


def test_late_repeated_and_reversed_landings_equal_the_daily_counts(spark):
    rnd = random.Random(8)
    base = scratch_path(spark, "daily")
    day = {k: dt.datetime(2020, 1, 1 + rnd.randrange(6), 12) for k in range(60)}
    every = []
    # pages from the newest back to the oldest, some reviews again and with another vote
    for page in range(5):
        fetched = dt.datetime(2020, 2, 10 - page)
        rows = [(k, k % 3, day[k], rnd.random() < 0.5, fetched) for k in rnd.choices(range(60), k=40)]
        every += rows
        got, _ = land(spark, base, rows)
        assert got == counted(every)
    # a fresh checkpoint reads all pages again, knows what was counted, and goes on
    rows = [(k, k % 3, day[k], True, dt.datetime(2020, 3, 1)) for k in range(10)]
    got, _ = land(spark, base, rows, "other")
    assert got == counted(every + rows)


def test_a_batch_logs_its_own_changes_alone(spark):
    base = scratch_path(spark, "daily")
    many = [(k, 1, dt.datetime(2020, 1, 1 + k % 5), True, dt.datetime(2020, 2, 1)) for k in range(3000)]
    land(spark, base, many)
    _, query = land(spark, base, [(7, 1, many[7][2], False, dt.datetime(2020, 2, 2)), (8, 1, many[8][2], True, dt.datetime(2020, 2, 2))])
    assert query.lastProgress["numInputRows"] == 2
    last = spark.read.parquet(f"{base}/log").where("batch = 1")
    # review 8 voted as before but was fetched anew; only the other one changes a count
    assert last.agg(F.sum("review_count"), F.sum("positive_count"), F.sum(F.length("ids") / 8)).first()[:] == (0, -1, 2.0)


def test_corrections_of_one_state():
    known = (np.array([2, 5, 9]), np.array([10, 10, 10]), np.array([True, False, True]))
    new = (np.array([1, 2, 5, 9]), np.array([1, 11, 10, 9]), np.array([True, False, True, False]))
    after, changed, reviews, positive = stream.correct(known, new)
    assert [x.tolist() for x in after] == [[1, 2, 5, 9], [1, 11, 10, 10], [True, False, True, True]]
    assert changed[0].tolist() == [1, 2, 5] and (reviews, positive) == (1, 1)
    nothing = tuple(x[:0] for x in known)
    assert stream.correct(nothing, nothing)[2:] == (0, 0)
    assert stream.correct(nothing, new)[2:] == (4, 2)


def review_page(raw_id, fetched, votes, ids, language="english"):
    reviews = [{"recommendationid": str(i), "language": language, "review": f"text {raw_id}", "timestamp_created": 1700000000 + i, "voted_up": i % 2 == 0,
                "votes_up": votes, "author": {"steamid": str(i)}} for i in ids]
    return raw_id, 1, "*", fetched, json.dumps({"cursor": "x", "reviews": reviews})


def collect_pages(spark, base, pages, checkpoint="checkpoint"):
    dim = spark.createDataFrame([(5, 1, dt.datetime(2000, 1, 1), dt.datetime(2099, 1, 1))], "game_sk int, app_id int, valid_from timestamp, valid_to timestamp")
    languages = spark.createDataFrame([(3, "english")], "language_sk int, language_code string")
    raw.append_raw(spark.createDataFrame(pages, raw.RAW_SCHEMAS["reviews"]), f"{base}/landing")
    stream.stream_review_merge(stream.raw_stream(spark, f"{base}/landing", "reviews"), dim, f"{base}/log", f"{base}/{checkpoint}", languages).awaitTermination()


def state_of(spark, base):
    return sorted(tuple(r) for r in stream.current_reviews(stream.read_log(spark, f"{base}/log")).collect())


def test_compaction_keeps_the_state_while_a_batch_lands(spark):
    base, t0 = scratch_path(spark, "merge"), dt.datetime(2024, 1, 1)
    collect_pages(spark, base, [review_page(1, t0, 5, [1, 2, 3])])
    collect_pages(spark, base, [review_page(2, t0 + dt.timedelta(2), 7, [2, 4])])
    seen = stream.landed(spark, f"{base}/log")
    assert len(seen) == 2
    # an older copy, a newer one and a new review come while the first two batches are compacted
    collect_pages(spark, base, [review_page(3, t0 + dt.timedelta(1), 1, [2, 5], "klingon"), review_page(4, t0 + dt.timedelta(9), 9, [1], "")])
    before = state_of(spark, base)
    assert [(r[0], r[before_column("votes_up")], r[before_column("review_body")]) for r in before] == [
        (1, 9, "text 4"), (2, 7, "text 2"), (3, 5, "text 1"), (4, 7, "text 2"), (5, 1, "text 3")]
    assert stream.compact(spark, f"{base}/log", seen) == 0
    assert state_of(spark, base) == before
    log = stream.read_log(spark, f"{base}/log")
    assert (log.where("in_base").count(), log.where("not in_base").count()) == (4, 3)
    # a base without its list does not count, swept deltas are not missed, and the next base goes on from this one
    spark.range(1).write.parquet(f"{base}/log/base/gen=7/rows")
    stream.sweep(spark, f"{base}/log")
    assert len(stream.landed(spark, f"{base}/log")) == 1 and state_of(spark, base) == before
    assert stream.compact(spark, f"{base}/log") == 1 and state_of(spark, base) == before
    assert stream.read_log(spark, f"{base}/log").where("not in_base").count() == 0
    # another run lands behind the base
    collect_pages(spark, base, [review_page(5, t0 + dt.timedelta(20), 30, [3])], "other")
    after = {r[0]: r[before_column("votes_up")] for r in state_of(spark, base)}
    assert after == {1: 9, 2: 7, 3: 30, 4: 7, 5: 1}


def before_column(name):
    return [stream.KEY, *stream.FIRST_VALUE, *stream.NEWEST_VALUE].index(name)


def test_log_has_language_date_and_time_keys(spark):
    base = scratch_path(spark, "merge")
    collect_pages(spark, base, [review_page(1, dt.datetime(2024, 1, 1), 1, [1]), review_page(2, dt.datetime(2024, 1, 1), 1, [2], ""), review_page(3, dt.datetime(2024, 1, 1), 1, [3], "new")])
    rows = {r.recommendation_id: r for r in stream.current_reviews(stream.read_log(spark, f"{base}/log")).collect()}
    assert {(r.date_sk, r.time_sk) for r in rows.values()} == {(20231114, 22)}
    assert rows[1].language_sk == 3 and rows[2].language_sk == -1 and rows[3].language_sk > 3


def test_a_log_without_a_column_fails(spark):
    base = scratch_path(spark, "merge")
    collect_pages(spark, base, [review_page(1, dt.datetime(2024, 1, 1), 1, [1])])
    log = spark.read.parquet(f"{base}/log/deltas").drop("votes_up", "run", "batch")
    log.write.parquet(f"{base}/other/deltas/run=r/batch=0")
    with pytest.raises(AnalysisException):
        stream.read_log(spark, f"{base}/other")
