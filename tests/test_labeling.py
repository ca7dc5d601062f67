"""Planning and checking of labels: known answers and properties."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from tideline.operators import labeling, planning

DAY = dt.date(2024, 1, 1)


def content(spark, counts):
    return spark.createDataFrame([(1, DAY + dt.timedelta(days=d), n) for d, n in counts.items()], "app_id int, day date, content bigint")


def spikes(spark, counts, **kw):
    return {(r.day - DAY).days: r for r in planning.spike_days(content(spark, counts), **kw).collect()}


@pytest.mark.parametrize("level, last, expected", [(50, 100, True), (50, 99, False), (50, 60, False), (20, 59, False), (20, 60, True)])
def test_spike_thresholds(spark, level, last, expected):
    out = spikes(spark, {**{d: level for d in range(28)}, 28: last})
    assert out[28].spike is expected and out[28].median == level
    assert out[28].day_limit == (200 if expected else 30)


def test_gaps_count_as_zero(spark):
    out = spikes(spark, {7 * w: 70 for w in range(6)})
    assert out[21].median is None and not out[21].spike
    assert out[28].median == 0 and out[28].spike


def test_first_four_weeks_never_spike(spark):
    out = spikes(spark, {**{d: 10 for d in range(27)}, 27: 1000})
    assert out[27].median is None and not out[27].spike


def candidates(spark, rows):
    return spark.createDataFrame([(1, i, DAY + dt.timedelta(days=d), n, s) for i, d, n, s in rows],
                                 "app_id int, recommendation_id bigint, day date, length int, status string")


def test_short_reviews_only_count(spark):
    c = candidates(spark, [(1, 0, 5, None), (2, 0, 19, None), (3, 0, 20, None)])
    plan = planning.label_plan(c, day_limit=1)
    row = planning.plan_counts(c, plan).first()
    assert (row.too_short, row.to_label, row.over_limit) == (2, 1, 0)


def test_plan_does_not_depend_on_order_and_a_raised_limit_only_adds(spark):
    rows = [(i, 0, 50, None) for i in range(250)]
    first = planning.label_plan(candidates(spark, rows), day_limit=30).collect()
    again = planning.label_plan(candidates(spark, rows[::-1]), day_limit=30).collect()
    key = lambda r: (r.day_rank, r.recommendation_id)
    assert sorted(map(key, first)) == sorted(map(key, again))
    limits = spark.createDataFrame([(1, DAY, 200)], "app_id int, day date, day_limit int")
    more = planning.label_plan(candidates(spark, rows), limits, day_limit=30).collect()
    assert set(map(key, first)) < set(map(key, more)) and len(more) == 200
    done = {r.recommendation_id for r in first}
    labelled = candidates(spark, [(i, 0, 50, "labeled" if i in done else None) for i in range(250)])
    assert sorted(r.day_rank for r in planning.label_plan(labelled, limits, day_limit=30).collect()) == list(range(31, 201))


def test_failed_is_retried_and_done_is_not(spark):
    c = candidates(spark, [(1, 0, 50, "failed"), (2, 0, 50, "labeled"), (3, 0, 50, "no_opinion"), (4, 0, 50, None)])
    plan = {r.recommendation_id: r.retry for r in planning.label_plan(c).collect()}
    assert plan == {1: True, 4: False}


def test_run_cap_takes_newest_days_and_runs_cover_all_once(spark):
    todo = planning.label_plan(candidates(spark, [(i, i % 4, 50, None) for i in range(10)]))
    taken = planning.run_cap(todo, 3).collect()
    assert [(r.day - DAY).days for r in taken] == [3, 3, 2]
    seen, left = [], todo
    while True:
        part = planning.run_cap(left, 4).select("recommendation_id").collect()
        if not part:
            break
        seen += [r[0] for r in part]
        left = todo.filter(~F.col("recommendation_id").isin(seen))
    assert sorted(seen) == list(range(10))
    assert planning.run_left(todo, 4).first().left_over == 6


def test_batches_follow_work_order(spark):
    rng = random.Random(1)
    rows = [(i, rng.randint(0, 5), 50, None) for i in range(47)]
    plan = planning.label_plan(candidates(spark, rows))
    batched = planning.batch_rows(plan).orderBy("batch", "n").collect()
    order = sorted(plan.collect(), key=lambda r: (r.day, r.day_rank, r.recommendation_id))
    assert [r.recommendation_id for r in batched] == [r.recommendation_id for r in order]
    assert [(r.batch, r.n) for r in batched] == [(i // 10, i % 10 + 1) for i in range(47)]


def answer(items):
    return json.dumps(items, ensure_ascii=False)


def parse(spark, content, size=2, allowed=("a", "b", "c", "d", "e", "f")):
    df = spark.createDataFrame([(1, 1, size, content)], "app_id int, batch int, size int, content string")
    rows = labeling.label_parse(df, [*allowed, "other"]).orderBy("n").collect()
    problems = sorted(r.problem for r in labeling.answer_problems(df, [*allowed, "other"]).collect())
    return {r.n: (r.status, [(a.id, a.sentiment, a.note) for a in r.aspects or []]) for r in rows}, problems


def test_a_cut_answer_fails_its_batch_and_is_paid_for(spark):
    body = answer([{"n": 1, "aspects": []}, {"n": 2, "aspects": []}])

    def labeler(prompt):
        return body, "length" if "cut" in prompt else "stop", {"prompt_tokens": 5, "completion_tokens": len(prompt)}

    batches = spark.createDataFrame([(1, 1, 2, "cut"), (1, 2, 2, "whole")], "app_id int, batch int, size int, prompt string")
    answers = labeling.label_infer(batches, labeler)
    assert sorted((r.finish, r.prompt_tokens, r.completion_tokens) for r in answers.collect()) == [("length", 5, 3), ("stop", 5, 5)]
    rows = labeling.label_parse(labeling.whole_answers(answers), ["a"]).collect()
    assert sorted((r.batch, r.n, r.status) for r in rows) == [(1, 1, "failed"), (1, 2, "failed"), (2, 1, "no_opinion"), (2, 2, "no_opinion")]


def test_tags_keep_the_order_of_the_answer(spark):
    rows = spark.createDataFrame([(1, 0, 1, 70, "a"), (1, 0, 2, 71, None)], "app_id int, batch int, n int, recommendation_id bigint, review_body string")
    labels = spark.createDataFrame([(1, 0, 1, "labeled", [("b", "-", None), ("a", "+", None)]), (1, 0, 2, "failed", None)],
                                   "app_id int, batch int, n int, status string, aspects array<struct<id:string,sentiment:string,note:string>>")
    records = labeling.label_records(labels, rows, 4, "run")
    assert sorted((r.recommendation_id, r.status, r.llm_config_sk) for r in records.collect()) == [(70, "labeled", 4), (71, "failed", 4)]
    assert sorted((r.importance, r.aspect_id, r.sentiment) for r in labeling.label_tags(records).collect()) == [(1, "b", "-"), (2, "a", "+")]


def tags(*pairs):
    return [{"id": i, "sentiment": s} for i, s in pairs]


def test_good_answer_and_empty_list(spark):
    out, problems = parse(spark, answer([{"n": 1, "aspects": tags(("a", "+"), ("b", "±"))}, {"n": 2, "aspects": []}]))
    assert out == {1: ("labeled", [("a", "+", None), ("b", "±", None)]), 2: ("no_opinion", [])} and problems == []


def test_fenced_answer(spark):
    out, _ = parse(spark, "```json\n" + answer([{"n": 1, "aspects": []}, {"n": 2, "aspects": []}]) + "\n```")
    assert [s for s, _ in out.values()] == ["no_opinion", "no_opinion"]


@pytest.mark.parametrize("content, problem", [("not json", "not JSON"), ('{"n": 1}', "not an array"), ("", "not JSON"), (None, "not JSON")])
def test_unreadable(spark, content, problem):
    out, problems = parse(spark, content)
    assert [s for s, _ in out.values()] == ["failed", "failed"] and problems == [problem]


def test_repeated_missing_and_foreign_numbers(spark):
    out, problems = parse(spark, answer([{"n": 1, "aspects": tags(("a", "+"))}, {"n": 1, "aspects": []}, {"n": 7, "aspects": []}]))
    assert out[1] == ("labeled", [("a", "+", None)]) and out[2][0] == "failed"
    assert problems == ["number left out", "unexpected or repeated number", "unexpected or repeated number"]


def test_a_boolean_or_text_is_not_a_number(spark):
    out, _ = parse(spark, answer([{"n": True, "aspects": []}, {"n": "2", "aspects": []}]))
    assert [s for s, _ in out.values()] == ["failed", "failed"]


@pytest.mark.parametrize("bad", [tags(("zzz", "+")), tags(("a", "?")), [{"id": "other", "sentiment": "+"}],
                                 [{"id": "other", "sentiment": "+", "note": "one two three four"}], [5], [{"sentiment": "+"}]])
def test_one_bad_aspect_rejects_the_review(spark, bad):
    out, problems = parse(spark, answer([{"n": 1, "aspects": tags(("a", "+")) + bad}, {"n": 2, "aspects": []}]))
    assert out[1][0] == "failed" and out[2][0] == "no_opinion" and problems == ["bad aspects"]


def test_no_list_of_aspects(spark):
    out, problems = parse(spark, answer([{"n": 1, "aspects": "a"}, {"n": 2, "aspects": []}]))
    assert out[1][0] == "failed" and problems == ["no list of aspects"]


def test_other_notes_repeats_and_the_first_five(spark):
    other = [{"id": "other", "sentiment": "-", "note": " Load Times "}, {"id": "other", "sentiment": "+", "note": "load times"},
             {"id": "other", "sentiment": "+", "note": "mods"}]
    out, _ = parse(spark, answer([{"n": 1, "aspects": other}, {"n": 2, "aspects": tags(*((x, "+") for x in "abacdef"))}]))
    assert out[1][1] == [("other", "-", "load times"), ("other", "+", "mods")]
    assert [a for a, _, _ in out[2][1]] == ["a", "b", "c", "d", "e"]


def test_failures_are_retried_one_by_one(spark):
    def labeler(prompt):
        import json as js
        import re

        numbers = re.findall(r'<review n="(\d+)">([^<]*)', prompt)
        if "boom" in prompt and len(numbers) > 1:
            raise ConnectionError("down")
        return js.dumps([{"n": int(n), "aspects": [{"id": "a", "sentiment": "+"}]} for n, body in numbers if body != "never"]), "stop"

    rows = spark.createDataFrame([(1, 0, 1, "fine"), (1, 0, 2, "boom"), (1, 0, 3, "never"), (1, 1, 1, "fine")],
                                 "app_id int, batch bigint, n int, review_body string")
    out = labeling.label_run(rows, planning.label_batches(rows), labeler, ["a"])
    assert {(r.batch, r.n): r.status for r in out.collect()} == {
        (0, 1): "labeled", (0, 2): "labeled", (0, 3): "failed", (1, 1): "labeled"}


def usage(spark, **fields):
    schema = ("prompt_tokens bigint, completion_tokens bigint, prompt_cache_hit_tokens bigint, prompt_tokens_details struct<cached_tokens: bigint>, "
              "completion_tokens_details struct<reasoning_tokens: bigint>, cost double")
    return spark.createDataFrame([{k: fields.get(k) for k in ("prompt_tokens", "completion_tokens", "prompt_cache_hit_tokens", "prompt_tokens_details",
                                                              "completion_tokens_details", "cost")}], schema)


PRICE = {"input": 0.3, "output": 1.2, "input_cached": 0.03}


@pytest.mark.parametrize("cache", [{"prompt_cache_hit_tokens": 800}, {"prompt_tokens_details": {"cached_tokens": 800}}])
def test_cache_fields_of_two_providers(spark, cache):
    row = planning.usage_cost(usage(spark, prompt_tokens=1000, completion_tokens=50, **cache), PRICE).first()
    assert (row.input_tokens, row.cached_tokens, row.output_tokens) == (1000, 800, 50)


def test_cost_by_tokens_own_price_and_unknown(spark):
    full = usage(spark, prompt_tokens=1_000_000, completion_tokens=1_000_000, prompt_cache_hit_tokens=500_000)
    assert planning.usage_cost(full, PRICE).first().cost_usd == pytest.approx(0.5 * 0.3 + 0.5 * 0.03 + 1.2)
    assert planning.usage_cost(usage(spark, cost=0.0042, prompt_tokens=10), None).first().cost_usd == 0.0042
    assert planning.usage_cost(usage(spark, prompt_tokens=10), None).first().cost_usd is None


def test_estimate_counts_the_cache_after_the_first_batch(spark):
    plan = candidates(spark, [(i, 0, 0, None) for i in range(20)])
    cheap = planning.estimate_cost(plan, 5500, PRICE).first().cost
    full = planning.estimate_cost(plan, 5500, {**PRICE, "input_cached": 0.3}).first().cost
    assert cheap < full
    assert planning.estimate_cost(plan, 5500, None).first().cost is None


def test_frozen_taxonomy(spark):
    columns = ["codebook_version", "aspect_id", "aspect_name", "aspect_definition", "category_id", "category_name", "category_definition"]
    rows = spark.createDataFrame([("v1", "a", "A", "x", "c", "C", "y"), ("v1", "b", "B", "x", "c", "C", "y")], columns)
    stored = rows.filter("aspect_id = 'a'").withColumn("aspect_sk", F.lit(1).cast("bigint"))
    assert labeling.sync_aspects(stored, rows).count() == 2
    with pytest.raises(ValueError):
        labeling.sync_aspects(stored.withColumn("aspect_name", F.lit("changed")), rows)


def test_few_prompts_are_in_python_at_a_time(spark):
    """Rows that travel to Python come in small batches: ten thousand prompts of ten reviews each would be held at once."""
    from tideline.session import PYTHON_ROWS, settle

    settle(spark)

    def sizes(frames):
        for frame in frames:
            yield frame.assign(id=len(frame))

    assert max(r.id for r in spark.range(0, 5000, 1, 1).mapInPandas(sizes, "id long").collect()) <= PYTHON_ROWS


def marks(spark):
    rows = [("ann", 1, "overall_impression"), ("ann", 1, "a"), ("ann", 1, "a"), ("ann", 2, "overall_impression"), ("bob", 1, "a"), ("bob", 2, None),
            ("bob", 2, "overall_impression"), ("model", 1, "b"), ("model", 2, "overall_impression"), ("ann", 3, "a"), ("model", 3, "a"), ("bob", 3, "c"),
            ("ann", 3, "c"), (None, 4, "d"), ("ann", 5, "d")]
    return spark.createDataFrame(rows, "rater string, recommendation_id long, aspect_id string")


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_the_general_impression_beside_others_takes_one_shuffle_of_marks(spark):
    out = labeling.overall_violations(marks(spark))
    assert shuffles(out) == 2  # the marks by review, then counts by rater
    assert {r.rater: (r.reviews, r.with_overall, r.mixed) for r in out.collect()} == {
        "ann": (4, 2, 1), "bob": (3, 1, 0), "model": (3, 1, 0), None: (1, 0, 0)}


def test_bias_takes_one_shuffle_of_marks(spark):
    out = labeling.label_bias(marks(spark), ["ann", "bob"], "model")
    assert shuffles(out) == 3  # the marks by pair, counts by aspect, ranks by kind
    assert sorted((r.bias, r.aspect_id, r.n, r["rank"]) for r in out.collect()) == [("extra", "b", 1, 1), ("missed", "a", 1, 1), ("missed", "c", 1, 2)]
