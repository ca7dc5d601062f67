"""Choosing which reviews to label: daily limits, spikes, work order, batches, cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.dates import utc_day
from tideline.functions.text import MIN_CONTENT_LENGTH, text_hash, trimmed_length

DONE = ("labeled", "no_opinion")
SPIKE_WINDOW = 28
DAY_LIMIT = 30
SPIKE_LIMIT = 200
SPIKE_FACTOR = 2.0
SPIKE_MIN_ABS = 60
BATCH_SIZE = 10
# fixed values: estimate before any call
PROMPT_CHARS_PER_TOKEN = 5.5
TEXT_CHARS_PER_TOKEN = 3.0
OUTPUT_TOKENS_PER_REVIEW = 60
# fixed value: expected output of one verdict
VERDICT_OUTPUT_TOKENS = 350
REVIEW_TAG_CHARS = 25


def _is_done() -> Column:
    return F.coalesce(F.col("status").isin(*DONE), F.lit(False))


def candidate_reviews(
    facts: DataFrame, games: DataFrame, texts: DataFrame, versions: DataFrame, labels: DataFrame, config_sk: int,
    since: str | None = None, until: str | None = None, ids: DataFrame | None = None,
) -> DataFrame:
    """Reviews with day, length of the present text and its label status under one config (null: none yet)."""
    chosen = facts.select("recommendation_id", "game_sk", "created_at")
    if since is not None:
        chosen = chosen.filter(F.col("created_at") >= F.lit(since).cast("timestamp"))
    if until is not None:
        chosen = chosen.filter(F.col("created_at") < F.lit(until).cast("timestamp"))
    if ids is not None:
        chosen = chosen.join(ids.select("recommendation_id"), "recommendation_id", "left_semi")
    body = texts.select(
        "recommendation_id", trimmed_length(F.col("review_body")).alias("length"),
        text_hash(F.col("review_body")).alias("text_hash"))
    status = labels.filter(F.col("llm_config_sk") == config_sk).select("review_text_sk", "status")
    labelled = versions.select("recommendation_id", "text_hash", "review_text_sk").join(status, "review_text_sk")
    return (
        chosen.join(games.select("game_sk", "app_id"), "game_sk")
        .join(body, "recommendation_id")
        .join(labelled, ["recommendation_id", "text_hash"], "left")
        .select("app_id", "recommendation_id", utc_day(F.col("created_at")).alias("day"), "length", "status")
    )


def spike_days(
    content: DataFrame, day_limit: int = DAY_LIMIT, factor: float = SPIKE_FACTOR,
    min_abs: int = SPIKE_MIN_ABS, spike_limit: int = SPIKE_LIMIT,
) -> DataFrame:
    """Limit of each day with content. A spike is well above the median of the 28 calendar days before it.

    Days without reviews count as zero in the median; the first 28 days of a product have none.
    """
    by_day = Window.partitionBy("app_id").orderBy("day")
    until = F.coalesce(F.date_sub(F.lead("day").over(by_day), 1), F.col("day"))
    dense = (
        content.withColumn("_until", until)
        .withColumn("_day", F.explode(F.sequence("day", "_until")))
        .withColumn("_real", F.col("_day") == F.col("day"))
        .withColumn("_n", F.when(F.col("_real"), F.col("content")).otherwise(F.lit(0)))
        .select("app_id", F.col("_day").alias("day"), F.col("_n").alias("content"), "_real")
    )
    known = F.date_diff("day", F.min("day").over(Window.partitionBy("app_id"))) >= SPIKE_WINDOW
    median = F.percentile("content", F.lit(0.5)).over(by_day.rowsBetween(-SPIKE_WINDOW, -1))
    spike = F.coalesce(
        (F.col("content") >= factor * F.col("median")) & (F.col("content") >= min_abs), F.lit(False))
    return (
        dense.withColumn("median", F.when(known, median))
        .filter("_real")
        .withColumn("spike", spike)
        .withColumn("day_limit", F.when(F.col("spike"), spike_limit).otherwise(day_limit))
        .drop("_real")
    )


def _highest(limits: DataFrame | None, day_limit: int) -> int:
    """The highest limit of any day: one row, read while the plan is made so that the ranks can be cut by it early."""
    own = None if limits is None else limits.agg(F.max("day_limit")).first()[0]
    return max(day_limit, own or 0)


def _ranked(candidates: DataFrame, min_length: int, most: int) -> DataFrame:
    """The first ``most`` content reviews of each day, in an order that does not depend on loading."""
    order = Window.partitionBy("app_id", "day").orderBy(F.md5(F.col("recommendation_id").cast("string")), "recommendation_id")
    return (
        candidates.filter(F.col("length") >= min_length)
        .withColumn("day_rank", F.row_number().over(order))
        .filter(F.col("day_rank") <= most)
    )


def label_plan(
    candidates: DataFrame, limits: DataFrame | None = None, min_length: int = MIN_CONTENT_LENGTH,
    day_limit: int = DAY_LIMIT,
) -> DataFrame:
    """Reviews to label. Ranks count labelled reviews too, so a raised limit only adds the next ranks.

    ``limits`` gives (app_id, day, day_limit) in place of the plain limit, however high.
    """
    ranked = _ranked(candidates, min_length, _highest(limits, day_limit))
    if limits is not None:
        own = limits.select("app_id", "day", F.col("day_limit").alias("_limit"))
        ranked = ranked.join(own, ["app_id", "day"], "left").filter(
            F.col("day_rank") <= F.coalesce("_limit", F.lit(day_limit))).drop("_limit")
    return ranked.filter(~_is_done()).withColumn("retry", F.coalesce(F.col("status") == "failed", F.lit(False)))


def plan_counts(candidates: DataFrame, plan: DataFrame, min_length: int = MIN_CONTENT_LENGTH) -> DataFrame:
    """Per product: reviews too short, done, planned, retried and over the limit."""
    long_enough = F.col("length") >= min_length
    seen = candidates.groupBy("app_id").agg(
        F.count("*").alias("reviews"),
        F.count_if(~long_enough).alias("too_short"),
        F.count_if(long_enough & _is_done()).alias("done"))
    planned = plan.groupBy("app_id").agg(F.count("*").alias("to_label"), F.count_if("retry").alias("retry"))
    zero = F.lit(0).cast("bigint")
    return seen.join(planned, "app_id", "left").select(
        "app_id", "reviews", "too_short", "done", F.coalesce("to_label", zero).alias("to_label"),
        F.coalesce("retry", zero).alias("retry"),
        (F.col("reviews") - F.col("too_short") - F.col("done") - F.coalesce("to_label", zero)).alias("over_limit"))


def plan_listed(candidates: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For an explicit list: reviews to label (no length threshold, no limit) and ids the store lacks."""
    listed = candidates.join(ids.select("recommendation_id"), "recommendation_id", "left_semi")
    plan = (
        listed.filter(~_is_done())
        .withColumn("day_rank", F.lit(None).cast("int"))
        .withColumn("retry", F.coalesce(F.col("status") == "failed", F.lit(False)))
    )
    missing = ids.select("recommendation_id").distinct().join(
        candidates.select("recommendation_id"), "recommendation_id", "left_anti")
    return plan, missing


def adaptive_gain(
    candidates: DataFrame, limits: DataFrame, min_length: int = MIN_CONTENT_LENGTH,
    day_limit: int = DAY_LIMIT,
) -> DataFrame:
    """Per spike day with candidates: content, median, limit and how many reviews the spike limit adds."""
    open_rows = _ranked(candidates, min_length, _highest(limits, day_limit)).filter(~_is_done())
    spikes = limits.filter("spike").select("app_id", "day", "content", "median", F.col("day_limit").alias("spike_limit"))
    in_period = candidates.select("app_id", "day").distinct()
    added = open_rows.join(spikes.select("app_id", "day", "spike_limit"), ["app_id", "day"]).groupBy("app_id", "day").agg(
        (F.count_if(F.col("day_rank") <= F.col("spike_limit")) - F.count_if(F.col("day_rank") <= day_limit)).alias("added"))
    return (
        spikes.join(in_period, ["app_id", "day"], "left_semi")
        .join(added, ["app_id", "day"], "left")
        .withColumn("added", F.coalesce("added", F.lit(0).cast("bigint")))
    )


def run_cap(plan: DataFrame, limit: int) -> DataFrame:
    """At most ``limit`` reviews per run: newest day first, then rank, then id."""
    return plan.orderBy(F.desc("day"), F.coalesce("day_rank", F.lit(0)), "recommendation_id").limit(limit)


def run_left(plan: DataFrame, limit: int) -> DataFrame:
    """How many planned reviews stay for later runs."""
    total = F.count("*")
    return plan.agg(total.alias("planned"), F.greatest(total - limit, F.lit(0)).alias("left_over"))


def label_order(plan: DataFrame, scope: tuple = ("app_id",)) -> DataFrame:
    """Position of each planned review in work order: day, rank, id.

    Reviews are numbered inside their day (a planned day is bounded by its limit) and moved by the
    number of reviews on the days before, so there is no sort of the whole plan in one task.
    """
    in_day = Window.partitionBy(*scope, "day").orderBy(F.coalesce("day_rank", F.lit(0)), "recommendation_id")
    days_before = Window.partitionBy(*(scope or [F.lit(0)])).orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    starts = plan.groupBy(*scope, "day").agg(F.count("*").alias("_n")).select(
        *scope, "day", F.coalesce(F.sum("_n").over(days_before), F.lit(0)).alias("_before"))
    return (
        plan.withColumn("_in_day", F.row_number().over(in_day))
        .join(starts, [*scope, "day"])
        .withColumn("position", F.col("_before") + F.col("_in_day"))
        .drop("_before", "_in_day")
    )


def batch_rows(plan: DataFrame, size: int = BATCH_SIZE, scope: tuple = ("app_id",)) -> DataFrame:
    """Planned reviews with their batch and short number 1..N inside it."""
    zero_based = F.col("position") - 1
    return label_order(plan, scope).withColumn("batch", F.floor(zero_based / size).cast("bigint")).withColumn(
        "n", (zero_based % size + 1).cast("int"))


def label_batches(rows: DataFrame, scope: tuple = ("app_id",)) -> DataFrame:
    """One prompt text per batch; a batch holds at most ``size`` whole review texts."""
    one = F.struct("n", F.coalesce("review_body", F.lit("")).alias("text"))
    lines = F.transform(
        F.array_sort(F.collect_list(one)),
        lambda r: F.concat(F.lit('<review n="'), r["n"].cast("string"), F.lit('">'), r["text"], F.lit("</review>")))
    return rows.groupBy(*scope, "batch").agg(F.count("*").cast("int").alias("size"), F.array_join(lines, "\n").alias("prompt"))


def _price(n_in: Column, cached: Column, n_out: Column, prices: dict) -> Column:
    return (
        (n_in - cached) * prices["input"] + cached * prices.get("input_cached", prices["input"]) + n_out * prices["output"]
    ) / 1e6


def estimate_cost(plan: DataFrame, prompt_chars: int, prices: dict | None, size: int = BATCH_SIZE) -> DataFrame:
    """Expected price of labelling the plan, per product; null when prices are unknown."""
    out = plan.groupBy("app_id").agg(F.count("*").alias("n"), F.sum("length").cast("bigint").alias("chars"))
    if prices is None:
        return out.withColumn("cost", F.lit(None).cast("double"))
    batches = F.ceil(F.col("n") / size)
    prompt_tokens = F.lit(prompt_chars / PROMPT_CHARS_PER_TOKEN)
    n_in = batches * prompt_tokens + (F.col("chars") + F.col("n") * REVIEW_TAG_CHARS) / F.lit(TEXT_CHARS_PER_TOKEN)
    cached = (batches - 1) * prompt_tokens
    return out.withColumn("cost", _price(n_in, cached, F.col("n") * OUTPUT_TOKENS_PER_REVIEW, prices))


def estimate_verdicts(prompts: DataFrame, prompt_chars: int, prices: dict | None, output_tokens: int = VERDICT_OUTPUT_TOKENS) -> DataFrame:
    """Expected price of one verdict text per row of ``prompts``, per product; null when prices are unknown."""
    out = prompts.groupBy("app_id").agg(F.count("*").alias("n"), F.sum(F.char_length("prompt")).cast("bigint").alias("chars"))
    if prices is None:
        return out.withColumn("cost", F.lit(None).cast("double"))
    n_in = F.col("n") * F.lit(prompt_chars / PROMPT_CHARS_PER_TOKEN) + F.col("chars") / F.lit(TEXT_CHARS_PER_TOKEN)
    return out.withColumn("cost", _price(n_in, F.lit(0), F.col("n") * output_tokens, prices))


def call_price(prices: dict | None) -> Column:
    """Price of one call from prompt_tokens and completion_tokens; null where either, or the price list, is unknown."""
    if prices is None:
        return F.lit(None).cast("double")
    return _price(F.col("prompt_tokens"), F.lit(0), F.col("completion_tokens"), prices)


def usage_cost(usage: DataFrame, prices: dict | None) -> DataFrame:
    """Tokens and price of each call. The provider's own price wins; unknown prices give null, not zero."""
    zero = F.lit(0).cast("bigint")
    cached = F.coalesce(
        F.nullif(F.col("prompt_cache_hit_tokens"), F.lit(0)), F.col("prompt_tokens_details.cached_tokens"), zero)
    out = (
        usage.withColumn("input_tokens", F.coalesce("prompt_tokens", zero))
        .withColumn("cached_tokens", cached)
        .withColumn("output_tokens", F.coalesce("completion_tokens", zero))
        .withColumn("reasoning_tokens", F.coalesce("completion_tokens_details.reasoning_tokens", zero))
    )
    own = F.lit(None).cast("double") if prices is None else _price(
        F.col("input_tokens"), F.col("cached_tokens"), F.col("output_tokens"), prices)
    return out.withColumn("cost_usd", F.coalesce("cost", own))


def run_summary(calls: DataFrame) -> DataFrame:
    """Per run: outcome counts, tokens and price; the price is null as soon as one call's price is unknown."""
    return calls.groupBy("run_id").agg(
        F.sum("labeled").alias("labeled"), F.sum("no_opinion").alias("no_opinion"), F.sum("failed").alias("failed"),
        F.sum("input_tokens").alias("input_tokens"), F.sum("cached_tokens").alias("cached_tokens"),
        F.sum("output_tokens").alias("output_tokens"), F.sum("reasoning_tokens").alias("reasoning_tokens"),
        F.when(F.count_if(F.col("cost_usd").isNull()) == 0, F.sum("cost_usd")).alias("cost_usd"),
    )
