"""What the physical plans must and must not contain."""

import pytest
from __spark_entry__ import SMALL, queries

JOBS = queries()


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["latest_per_key", "label_plan", "top_change_points", "verdict_current"])
def test_ranks_are_cut_before_the_shuffle(spark, name):
    text = plan(JOBS[name](spark, SMALL))
    assert "row_number(), " in text and ", Partial" in text.replace("\n", " ")


def test_detector_shuffles_twice(spark):
    text = plan(JOBS["change_points"](spark, SMALL))
    assert text.count("Exchange hashpartitioning") == 2
    assert "l_extendedprice" not in text and "l_discount" not in text


def test_date_bounds_reach_the_scan(spark):
    from pyspark.sql import functions as F

    from tideline.plans.frames import Frames

    rows = Frames(spark, SMALL).table("orders").filter(F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp")).select("o_orderkey")
    text = plan(rows)
    assert "GreaterThanOrEqual(o_orderdate" in text and "ReadSchema: struct<o_orderkey:bigint,o_orderdate:timestamp>" in text


def test_answers_are_parsed_without_moving_rows(spark):
    from tideline.operators.labeling import label_parse

    df = spark.createDataFrame([(1, 1, 2, "[]")], "app_id int, batch int, size int, content string")
    assert "Exchange" not in plan(label_parse(df, ["a"]))


def test_text_bodies_are_not_shuffled(spark):
    """Between scan and join only hash and flag are left of a text."""
    from tideline.operators.marts import review_labeled

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        schema = "recommendation_id bigint, review_body string"
        texts = spark.createDataFrame([(1, "x" * 30)], schema)
        versions = spark.createDataFrame([(1, 1, "h", True)], "review_text_sk bigint, recommendation_id bigint, text_hash string, is_current boolean")
        labels = spark.createDataFrame([(1, 1, 1, "labeled")], "labeling_sk bigint, review_text_sk bigint, llm_config_sk int, status string")
        facts = spark.createDataFrame([(1, 1)], "recommendation_id bigint, game_sk int").selectExpr("*", "timestamp'2024-01-01' AS created_at")
        games = spark.createDataFrame([(1, 1)], "game_sk int, app_id int")
        lines = plan(review_labeled(labels, versions, facts, games, texts)).split("\n")
        for i, line in enumerate(lines):
            if "Exchange" in line:
                below = next(x for x in lines[i + 1:] if "Project" in x or "Scan" in x or "Filter" in x)
                assert "review_body" not in below.split("Project")[-1] or "md5" in below
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
