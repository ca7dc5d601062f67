"""Label answers: external calls, validation, stored labels, text versions, rater agreement."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from operator import and_, or_

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.numbers import half_up, stable_key
from tideline.functions.text import strip_all, text_hash
from tideline.operators.ledger import Ledger, answered, ask
from tideline.operators.marts import OVERALL, SIGNS

MAX_ASPECTS = 5
MAX_NOTE_WORDS = 3
OTHER = "other"
FINISHED = "stop"
ASPECT_ARRAY = "array<struct<id:string,sentiment:string,note:string>>"
ELEMENTS = f"array<struct<pos:int,n:int,problem:string,aspects:{ASPECT_ARRAY}>>"


def label_infer(batches: DataFrame, labeler: Callable[[str], tuple], keys: tuple = ("app_id", "batch"), ledger: Ledger | None = None) -> DataFrame:
    """Sends each batch text to ``labeler``; a failed call gives a null answer.

    ``labeler`` maps a text to (answer, finish reason) or (answer, finish reason, usage), where usage
    holds prompt_tokens and completion_tokens. The calls leave the cluster and are paid for: with a ``ledger`` each prompt
    is asked once, whatever tasks fail; without one, write the result before using it twice.
    """
    if ledger is not None:
        return answered(batches, labeler, keys, ledger).drop("asked")
    fields = {f.name: f.dataType.simpleString() for f in batches.schema.fields}
    schema = ", ".join(f"{k} {fields[k]}" for k in keys) + (
        ", size int, content string, finish string, prompt_tokens bigint, completion_tokens bigint")

    def call(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            answers = [ask(labeler, text) for text in frame["prompt"]]
            out = frame[[*keys, "size"]].copy()
            out["content"] = [a[0] for a in answers]
            out["finish"] = [a[1] for a in answers]
            out["prompt_tokens"] = pd.array([a[2] for a in answers], dtype="Int64")
            out["completion_tokens"] = pd.array([a[3] for a in answers], dtype="Int64")
            yield out

    return batches.select(*keys, "size", "prompt").mapInPandas(call, schema)


def whole_answers(answers: DataFrame) -> DataFrame:
    """Answers that did not come to their own end count as unreadable, whatever they begin with."""
    return answers.withColumn("content", F.when(F.col("finish") == FINISHED, F.col("content")))


def _unfenced(content: Column) -> Column:
    """Answer text without a surrounding code fence."""
    text = strip_all(F.coalesce(content, F.lit("")))
    opened = F.regexp_replace(text, r"^[^\n]*\n", "")
    closed = F.regexp_replace(opened, r"(?s)```(?:(?!```).)*$", "")
    return F.when(F.startswith(text, F.lit("```")), closed).otherwise(text)


def _read_aspect(a: Column) -> Column:
    note = F.lower(strip_all(F.coalesce(F.try_variant_get(a, "$.note", "string"), F.lit(""))))
    return F.struct(
        F.try_variant_get(a, "$.id", "string").alias("id"), F.try_variant_get(a, "$.sentiment", "string").alias("sentiment"), note.alias("note"))


def _check_aspect(a: Column, allowed: Column) -> Column:
    """One answered aspect as (id, sentiment, note, ok)."""
    note = a["note"]
    words = F.size(F.split(note, r"(?U)\s+"))
    other = F.coalesce(a["id"] == OTHER, F.lit(False))
    fits = F.when(other, (note != "") & (words <= MAX_NOTE_WORDS)).otherwise(F.array_contains(allowed, a["id"]))
    return F.struct(
        a["id"].alias("id"), a["sentiment"].alias("sentiment"), F.when(other, note).alias("note"),
        (F.coalesce(a["sentiment"].isin(*SIGNS), F.lit(False)) & F.coalesce(fits, F.lit(False))).alias("ok"),
    )


def _elements(size: Column, items: Column, allowed: list[str]) -> Column:
    """Elements of an answer as (pos, n, problem, aspects); ``n`` is null for an unexpected number.

    One bad aspect rejects the review, since a partial label would distort shares; a repeated aspect
    is dropped; of too many the first ones stay, as they come by importance.
    """
    known = F.array(*[F.lit(a) for a in allowed if a != OTHER])

    def element(item: Column, pos: Column) -> Column:
        tags = F.transform(F.try_variant_get(item, "$.aspects", "array<variant>"), _read_aspect)
        return F.struct(
            pos.alias("pos"), F.try_variant_get(item, "$.n", "double").alias("value"),
            F.schema_of_variant(F.try_variant_get(item, "$.n", "variant")).alias("kind"),
            F.transform(tags, lambda a: _check_aspect(a, known)).alias("tags"))

    def checked(e: Column) -> Column:
        tags, value = e["tags"], e["value"]
        number = e["kind"].isin("BIGINT", "DOUBLE") | F.startswith(e["kind"], F.lit("DECIMAL"))
        expected = number & (value == F.floor(value)) & (value >= 1.0) & (value <= size)
        repeated = lambda t, i: F.exists(
            F.slice(tags, F.lit(1), i), lambda u: (u["id"] == t["id"]) & u["note"].eqNullSafe(t["note"]))
        unique = F.filter(tags, lambda t, i: ~repeated(t, i))
        clean = F.transform(F.slice(unique, 1, MAX_ASPECTS), lambda t: F.struct(t["id"], t["sentiment"], t["note"]))
        problem = F.when(tags.isNull(), "no list of aspects").when(F.exists(tags, lambda t: ~t["ok"]), "bad aspects")
        return F.struct(e["pos"], F.when(expected, value.cast("int")).alias("n"), problem.alias("problem"), F.when(problem.isNull(), clean).cast(ASPECT_ARRAY).alias("aspects"))

    return F.transform(F.transform(items, element), checked)


def parsed_answers(answers: DataFrame, allowed: list[str], keys: tuple) -> DataFrame:
    """Answers with ``readable``, ``is_list`` and their ``elements``; no rows move between tasks."""
    document = F.try_parse_json(_unfenced(F.col("content")))
    return (
        answers.select(*keys, "size", document.alias("v"))
        .select(*keys, "size", F.col("v").isNotNull().alias("readable"), F.try_variant_get("v", "$", "array<variant>").alias("items"))
        .select(*keys, "size", "readable", F.col("items").isNotNull().alias("is_list"),
                F.coalesce(_elements(F.col("size"), F.col("items"), allowed), F.array().cast(ELEMENTS)).alias("elements"))
    )


def label_parse(answers: DataFrame, allowed: list[str], keys: tuple = ("app_id", "batch")) -> DataFrame:
    """One row per expected number: labeled, no_opinion or failed, with its aspects.

    Only the first element of a number counts.
    """
    parsed = parsed_answers(answers, allowed, keys)
    numbered = F.transform(F.sequence(F.lit(1), F.col("size")), lambda i: F.struct(
        i.alias("n"), F.get(F.filter("elements", lambda e: e["n"] == i), F.lit(0))["aspects"].alias("aspects")))
    return parsed.select(*keys, F.inline(numbered)).withColumn("status", label_status(F.col("aspects")))


def answer_problems(answers: DataFrame, allowed: list[str], keys: tuple = ("app_id", "batch")) -> DataFrame:
    """Everything wrong with the answers: unreadable ones, rejected elements, numbers left out."""
    parsed = parsed_answers(answers, allowed, keys)

    def issue(n: Column, problem: Column) -> Column:
        return F.struct(n.cast("int").alias("n"), problem.alias("problem"))

    def of_element(e: Column) -> Column:
        earlier = F.exists(F.slice(F.col("elements"), F.lit(1), e["pos"]), lambda x: x["n"] == e["n"])
        return issue(e["n"], F.when(e["n"].isNull() | earlier, "unexpected or repeated number").otherwise(e["problem"]))

    whole = F.when(~F.col("readable"), "not JSON").when(~F.col("is_list"), "not an array")
    left_out = F.array_except(F.sequence(F.lit(1), F.col("size")), F.transform("elements", lambda e: e["n"]))
    found = F.concat(
        F.transform("elements", of_element), F.transform(left_out, lambda n: issue(n, F.lit("number left out"))))
    issues = F.when(whole.isNotNull(), F.array(issue(F.lit(None), whole))).otherwise(F.filter(found, lambda x: x["problem"].isNotNull()))
    return parsed.select(*keys, F.inline(issues))


def label_status(aspects: Column) -> Column:
    return F.when(aspects.isNull(), "failed").when(F.size(aspects) == 0, "no_opinion").otherwise("labeled")


def label_run(rows: DataFrame, batches: DataFrame, labeler: Callable, allowed: list[str], ledger: Ledger | None = None) -> DataFrame:
    """The labels of ``label_run_calls`` alone."""
    return label_run_calls(rows, batches, labeler, allowed, ledger)[0]


def label_run_calls(rows: DataFrame, batches: DataFrame, labeler: Callable, allowed: list[str], ledger: Ledger | None = None) -> tuple[DataFrame, DataFrame]:
    """Labels every batch, then retries what failed one review at a time. ``rows`` is ``planning.batch_rows``.

    Returns the labels and the calls with what they spent. A cut answer fails its whole batch. A run that is started again
    with its ``ledger`` asks only what it has no answer to yet.
    """
    from tideline.session import written

    keys = ("app_id", "batch", "n")
    whole = written(label_infer(batches, labeler, ledger=ledger), "answers")
    first = label_parse(whole_answers(whole), allowed)
    again = rows.join(first.filter("status = 'failed'").select(*keys), [*keys], "left_semi")
    singles = again.select(
        *keys, F.lit(1).alias("size"),
        F.concat(F.lit('<review n="1">'), F.coalesce("review_body", F.lit("")), F.lit("</review>")).alias("prompt"))
    answers = written(label_infer(singles, labeler, keys, ledger), "retries")
    # the single review of a retry is number 1 of its own answer; its place in the batch is kept aside
    second = label_parse(whole_answers(answers).withColumnRenamed("n", "place"), allowed, ("app_id", "batch", "place")).drop("n")
    done = first.filter("status <> 'failed'").select(*keys, "status", "aspects")
    labels = done.unionByName(second.withColumnRenamed("place", "n").select(*keys, "status", "aspects"))
    spent = ["size", "finish", "prompt_tokens", "completion_tokens"]
    calls = whole.select(F.lit("batch").alias("kind"), *spent).unionByName(answers.select(F.lit("single").alias("kind"), *spent))
    return labels, calls


def label_records(labels: DataFrame, rows: DataFrame, config_sk: int, run_id: str) -> DataFrame:
    """Label rows of a run, ready for ``upsert_labels``: keyed by text version and configuration, with their aspects."""
    about = rows.select(
        "app_id", "batch", "n", "recommendation_id",
        stable_key(F.col("recommendation_id"), text_hash(F.col("review_body"))).alias("review_text_sk"))
    return labels.join(about, ["app_id", "batch", "n"]).select(
        stable_key(F.col("review_text_sk"), F.lit(config_sk)).alias("labeling_sk"), "review_text_sk", "recommendation_id",
        F.lit(config_sk).alias("llm_config_sk"), "status", F.lit(run_id).alias("run_id"), "aspects")


def label_tags(records: DataFrame) -> DataFrame:
    """One row per aspect of a label; importance is its place in the answer."""
    return records.select("labeling_sk", F.posexplode("aspects").alias("place", "a")).select(
        "labeling_sk", (F.col("place") + 1).alias("importance"), F.col("a.id").alias("aspect_id"), F.col("a.sentiment").alias("sentiment"),
        F.col("a.note").alias("note"))


def text_snapshot(versions: DataFrame, texts: DataFrame) -> DataFrame:
    """Adds missing text versions and makes the one equal to the present text current.

    Reviews outside ``texts`` keep their flags; an older version becomes current again if the text returned.
    """
    present = texts.select(
        "recommendation_id", text_hash(F.col("review_body")).alias("text_hash"),
        F.coalesce("review_body", F.lit("")).alias("review_body"), "language_sk", "valid_from")
    fresh = present.join(versions.select("recommendation_id", "text_hash"), ["recommendation_id", "text_hash"], "left_anti")
    added = fresh.select(
        stable_key(F.col("recommendation_id"), F.col("text_hash")).alias("review_text_sk"),
        "recommendation_id", "text_hash", "review_body", "language_sk", "valid_from", F.lit(False).alias("is_current"))
    now = present.select("recommendation_id", F.col("text_hash").alias("_now"))
    return (
        versions.unionByName(added)
        .join(now, "recommendation_id", "left")
        .withColumn("is_current", F.when(F.col("_now").isNotNull(), F.col("text_hash") == F.col("_now")).otherwise(F.col("is_current")))
        .drop("_now")
    )


def upsert_labels(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """One label per (text version, config); only a failed one is overwritten."""
    keys = ["review_text_sk", "llm_config_sk"]
    final = stored.filter("status <> 'failed'")
    usable = incoming.join(final.select(*keys), keys, "left_anti")
    retried = stored.filter("status = 'failed'").join(usable.select(*keys), keys, "left_anti")
    return final.unionByName(retried).unionByName(usable.select(*stored.columns))


def aspect_conflicts(stored: DataFrame, rows: DataFrame) -> DataFrame:
    """Stored aspects of a version that differ from its file, or that the file lacks."""
    texts = ["aspect_name", "aspect_definition", "category_id", "category_name", "category_definition"]
    keys = ["codebook_version", "aspect_id"]
    known = stored.join(rows.select("codebook_version").distinct(), "codebook_version", "left_semi")
    theirs = rows.select(*keys, F.struct(*texts).alias("_file"))
    return known.join(theirs, keys, "left").filter(~F.struct(*texts).eqNullSafe(F.col("_file"))).select(*keys)


def sync_aspects(stored: DataFrame, rows: DataFrame) -> DataFrame:
    """Adds missing taxonomy rows. A stored version is frozen: a difference is an error, not an update."""
    conflicts = aspect_conflicts(stored, rows).count()
    if conflicts:
        raise ValueError(f"stored taxonomy differs from its file in {conflicts} aspects, see aspect_conflicts")
    fresh = rows.join(stored, ["codebook_version", "aspect_id"], "left_anti")
    keyed = fresh.withColumn("aspect_sk", stable_key(F.col("codebook_version"), F.col("aspect_id")))
    return stored.unionByName(keyed.select(*stored.columns))


def ensure_config(configs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Adds labeler configurations not stored yet; the key is prompt hash, model and parameters."""
    keys = ["prompt_hash", "model", "params"]
    hashed = wanted.withColumn("prompt_hash", F.sha2("system_prompt", 256)).dropDuplicates(keys)
    fresh = hashed.join(configs.select(*keys), keys, "left_anti")
    keyed = fresh.withColumn("llm_config_sk", stable_key(*[F.col(k) for k in keys]))
    return configs.unionByName(keyed.select(*configs.columns))


def model_labels_current(versions: DataFrame, labels: DataFrame, tags: DataFrame, aspects: DataFrame, config_sk: int) -> DataFrame:
    """The model's aspects of current texts; of a repeated aspect the most important tag counts.

    A labelled review without aspects keeps one row with a null aspect.
    """
    current = versions.filter("is_current").select("review_text_sk", "recommendation_id")
    ok = labels.filter((F.col("llm_config_sk") == config_sk) & (F.col("status") != "failed")).select("labeling_sk", "review_text_sk")
    named = tags.select("labeling_sk", "importance", "aspect_sk", "sentiment").join(
        aspects.select("aspect_sk", "aspect_id"), "aspect_sk")
    return (
        current.join(ok, "review_text_sk").join(named, "labeling_sk", "left")
        .groupBy("recommendation_id", "aspect_id")
        .agg(F.min_by("sentiment", F.struct("importance", "sentiment")).alias("sentiment"))
    )


def _pair_counts(patterns: DataFrame, by: list[str]) -> DataFrame:
    """(pattern of raters, count) rows -> counts per rater and per pair of raters."""
    a = F.explode("raters").alias("rater_a")
    pairs = patterns.select(*by, "n", "raters", a).select(*by, "n", "rater_a", F.explode("raters").alias("rater_b"))
    return pairs.groupBy(*by, "rater_a", "rater_b").agg(F.sum("n").alias("n"))


def dice_agreement(labels: DataFrame) -> DataFrame:
    """2|A and B| / (|A| + |B|) for each pair of raters, per level, with and without the general impression.

    Each mark is reduced to the set of its raters and equal sets are counted, so what is paired up
    is the handful of rater combinations, not the marks.
    """
    specific = F.when(F.col("aspect_id") != OVERALL, F.col("rater"))

    def patterns(level: str, mark: str) -> DataFrame:
        sets = labels.groupBy("recommendation_id", mark).agg(
            F.sort_array(F.collect_set("rater")).alias("all"), F.sort_array(F.collect_set(specific)).alias("specific"))
        both = F.array(
            F.struct(F.lit(True).alias("with_overall"), F.col("all").alias("raters")),
            F.struct(F.lit(False).alias("with_overall"), F.col("specific").alias("raters")))
        return sets.select(F.inline(both)).groupBy("with_overall", "raters").agg(F.count("*").alias("n")).withColumn("level", F.lit(level))

    by = ["level", "with_overall"]
    counts = _pair_counts(patterns("aspect", "aspect_id").unionByName(patterns("category", "category_id")), by)
    # one row per level and scope from here on: the counts of every pair of the few raters
    pair = F.struct("rater_a", "rater_b", "n")
    own = F.filter("pairs", lambda p: p["rater_a"] == p["rater_b"])
    a, b = F.col("a"), F.col("b")
    shared = F.get(F.filter("pairs", lambda p: (p["rater_a"] == a["rater_a"]) & (p["rater_b"] == b["rater_a"])), F.lit(0))["n"]
    common = F.coalesce("shared", F.lit(0).cast("bigint"))
    return (
        counts.groupBy(*by).agg(F.collect_list(pair).alias("pairs"))
        .withColumn("a", F.explode(own)).withColumn("b", F.explode(own))
        .filter(a["rater_a"] < b["rater_a"])
        .withColumn("shared", shared)
        .select(*by, a["rater_a"].alias("rater_a"), b["rater_a"].alias("rater_b"), common.alias("common"),
                a["n"].alias("n_a"), b["n"].alias("n_b"), half_up(2.0 * common / (a["n"] + b["n"]), 6).alias("dice"))
    )


def sign_agreement(labels: DataFrame, with_overall: bool = False) -> DataFrame:
    """Of the aspects both raters gave to a review, how many carry the same sign."""
    rows = labels if with_overall else labels.filter(F.col("aspect_id") != OVERALL)
    patterns = (
        rows.groupBy("recommendation_id", "aspect_id")
        .agg(F.sort_array(F.collect_set(F.struct("rater", "sentiment"))).alias("raters"))
        .groupBy("raters").agg(F.count("*").alias("n")))
    pairs = _pair_counts(patterns, []).filter("rater_a.rater < rater_b.rater")
    same = F.col("rater_a.sentiment") == F.col("rater_b.sentiment")
    return pairs.groupBy(F.col("rater_a.rater").alias("rater_a"), F.col("rater_b.rater").alias("rater_b")).agg(
        F.coalesce(F.sum(F.when(same, F.col("n"))), F.lit(0).cast("bigint")).alias("same"), F.sum("n").alias("total"))


def rater_overlap(labels: DataFrame, a: str, b: str) -> DataFrame:
    """Sizes of the pair sets of two raters: both, only the first, only the second, either."""
    per_pair = labels.groupBy("recommendation_id", "aspect_id").agg(
        F.bool_or(F.col("rater") == a).alias("_a"), F.bool_or(F.col("rater") == b).alias("_b"))
    ina, inb = F.col("_a"), F.col("_b")
    return per_pair.agg(
        F.count_if(ina & inb).alias("common"), F.count_if(ina & ~inb).alias("only_a"),
        F.count_if(~ina & inb).alias("only_b"), F.count_if(ina | inb).alias("either"))


def label_bias(labels: DataFrame, people: list[str], model: str, top: int = 10) -> DataFrame:
    """Aspects only the model gives, and aspects all people give but the model misses, most frequent first.

    Each rater is one bit of a pair, so the pairs are shuffled once.
    """
    bits = [f"_person_{i}" for i in range(len(people))]
    per_pair = labels.filter(F.col("aspect_id") != OVERALL).groupBy("recommendation_id", "aspect_id").agg(
        F.bool_or(F.col("rater") == model).alias("_model"),
        *[F.bool_or(F.col("rater").eqNullSafe(F.lit(p))).alias(b) for p, b in zip(people, bits, strict=True)])
    anyone = reduce(or_, [F.col(b) for b in bits], F.lit(False))
    everyone = reduce(and_, [F.col(b) for b in bits], F.lit(True))
    kind = F.when(F.col("_model") & ~anyone, "extra").when(~F.col("_model") & everyone, "missed")
    counts = per_pair.withColumn("bias", kind).filter("bias is not null").groupBy("bias", "aspect_id").agg(F.count("*").alias("n"))
    order = Window.partitionBy("bias").orderBy(F.desc("n"), "aspect_id")
    return counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def overall_violations(labels: DataFrame) -> DataFrame:
    """Per rater: reviews with the general impression, and those where it stands beside specific aspects.

    Both are bits of a review, so the marks are shuffled once.
    """
    overall = F.col("aspect_id") == OVERALL
    per_review = labels.groupBy("rater", "recommendation_id").agg(F.bool_or(overall).alias("_overall"), F.bool_or(~overall).alias("_specific"))
    return per_review.groupBy("rater").agg(
        F.count("*").alias("reviews"), F.count_if("_overall").alias("with_overall"), F.count_if(F.col("_overall") & F.col("_specific")).alias("mixed"))
