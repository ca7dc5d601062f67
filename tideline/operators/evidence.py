"""What changed around a change point, as numbers: votes, topics, playtime, supporting reviews.

Every job handles all points of all products. Points are spread over the fourteen days of their
two windows and meet daily marts in equi joins; review rows are aggregated per day before that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.functions.numbers import half_up, percent
from tideline.operators.marts import DAY_KEYS, SERVICE, fold_sentiment

WINDOW = 7
TOP = 3
FOCUSED = 0.5
SIGNIFICANT_SE = 2.0
SMALL_VOLUME = 10
REVIEWS_PER_CATEGORY = 15
REVIEW_CHARS = 300
# fixed values: playtime groups in minutes: name, from, below
PLAYTIME = (("<10 h", 0, 600), ("10-100 h", 600, 6000), (">=100 h", 6000, None))
POINT = ["app_id", "point_day"]


def window_days(points: DataFrame) -> DataFrame:
    """(app_id, point_day, day, after): seven days before the point, seven from the point on."""
    spread = points.select("app_id", F.col("day").alias("point_day")).withColumn(
        "day", F.explode(F.sequence(F.date_sub("point_day", WINDOW), F.date_add("point_day", WINDOW - 1))))
    return spread.withColumn("after", F.col("day") >= F.col("point_day"))


def _side(after: bool, value: Column) -> Column:
    return F.when(F.col("after") == after, value)


def votes_before_after(daily: DataFrame, points: DataFrame) -> DataFrame:
    """Reviews and share of negative ones on each side, from sums over the days."""
    joined = window_days(points).join(daily, ["app_id", "day"], "left")
    negative = F.col("review_count") - F.col("positive_count")

    def total(after: bool, value: Column) -> Column:
        return F.coalesce(F.sum(_side(after, value)), F.lit(0).cast("bigint"))

    sums = joined.groupBy(*POINT).agg(
        total(False, F.col("review_count")).alias("before_reviews"), total(True, F.col("review_count")).alias("after_reviews"),
        total(False, negative).alias("_before"), total(True, negative).alias("_after"))

    def share(part: str, whole: str) -> Column:
        return F.when(F.col(whole) > 0, half_up(F.col(part).cast("double") / F.col(whole), 6))

    return sums.select(
        *POINT, "before_reviews", "after_reviews",
        share("_before", "before_reviews").alias("before_negative"), share("_after", "after_reviews").alias("after_negative"))


def critique_rows(mart: DataFrame, key: str) -> DataFrame:
    """Mart rows as (app_id, llm_config_sk, day, key, crit, content, labeled); crit counts - and ± reviews."""
    keep = ["category_id"] if key == "aspect_id" else []
    return mart.select(
        *DAY_KEYS, *keep, F.col(key).alias("key"),
        (F.col("negative_count") + F.col("mixed_count")).alias("crit"),
        F.col("day_content_count").alias("content"), F.col("day_labeled_count").alias("labeled"))


def weighted_topic_share(denominators: DataFrame, critique: DataFrame, points: DataFrame, config_sk: int,
                         by: tuple = ("key",)) -> DataFrame:
    """Share of reviews with complaints per point, topic and side.

    Days are weighted by their reviews with content, so a thinly labelled day counts by its size:
    sum(content * crit / labeled) / sum(content) over labelled days. Every topic the product has ever
    had appears, with zero where it is silent. A side without labelled days has a null share.
    """
    days = window_days(points)
    den = denominators.filter((F.col("llm_config_sk") == config_sk) & (F.col("labeled_count") > 0)).select(
        "app_id", "day", F.col("content_count").alias("content"), F.col("labeled_count").alias("labeled"))
    crit = critique.filter(F.col("llm_config_sk") == config_sk)
    sides = days.join(den, ["app_id", "day"], "left").groupBy(*POINT, "after").agg(
        F.sum("content").alias("den"), F.coalesce(F.sum("labeled"), F.lit(0).cast("bigint")).alias("labeled"))
    counted = crit.filter(F.col("labeled") > 0).select("app_id", "day", *by, "crit", "content", "labeled")
    sums = days.join(counted, ["app_id", "day"]).groupBy(*POINT, "after", *by).agg(
        F.sum(F.col("content").cast("double") * F.col("crit") / F.col("labeled")).alias("num"), F.sum("crit").alias("crit"))
    topics = crit.select("app_id", *by).distinct()
    return (
        sides.join(topics, "app_id")
        .join(sums, [*POINT, "after", *by], "left")
        .select(
            *POINT, "after", *by,
            F.when(F.col("den") > 0, F.coalesce("num", F.lit(0.0)) / F.col("den")).alias("share"),
            "labeled", F.coalesce("crit", F.lit(0).cast("bigint")).alias("crit"))
    )


def topic_shift(shares: DataFrame, by: tuple = ("key",)) -> DataFrame:
    """Share before and after per point and topic; topics without a share on either side are left out."""

    def pick(after: bool, c: str) -> Column:
        return F.max(_side(after, F.col(c)))

    wide = shares.groupBy(*POINT, *by).agg(
        pick(False, "share").alias("_b"), pick(True, "share").alias("_a"),
        pick(False, "crit").alias("crit_before"), pick(True, "crit").alias("crit_after"),
        pick(False, "labeled").alias("labeled_before"), pick(True, "labeled").alias("labeled_after"))
    return wide.filter("_b is not null and _a is not null").select(
        *POINT, *by, half_up(F.col("_b"), 6).alias("before"), half_up(F.col("_a"), 6).alias("after"),
        half_up(F.col("_a") - F.col("_b"), 6).alias("diff"),
        "crit_before", "crit_after", "labeled_before", "labeled_after")


def without_service(shifts: DataFrame) -> DataFrame:
    return shifts.filter(~F.col("key").isin(*SERVICE))


def shift_labels(votes: DataFrame, topics: DataFrame) -> DataFrame:
    """Decisions on each point: direction, main topic, its standard error, significance, focus, volume.

    ``topics`` is the category shift without service categories.
    """
    diff = F.col("diff")
    one = F.struct("key", "before", "after", "diff", "crit_before", "crit_after", "labeled_before", "labeled_after")
    per_point = topics.groupBy(*POINT).agg(
        half_up(F.sum("diff"), 6).alias("net"),
        F.sum(F.when(diff > 0, diff).otherwise(0.0)).alias("_rise"),
        F.sum(F.when(diff < 0, diff).otherwise(0.0)).alias("_fall"),
        F.min_by(one, F.struct((-diff).alias("d"), F.col("key"))).alias("_highest"),
        F.min_by(one, F.struct(diff.alias("d"), F.col("key"))).alias("_lowest"))
    joined = votes.join(per_point, POINT, "left").withColumn("net", F.coalesce("net", F.lit(0.0)))
    dv = F.coalesce("after_negative", F.lit(0.0)) - F.coalesce("before_negative", F.lit(0.0))
    up = F.col("net") >= 0
    main = F.when(up & (F.col("_highest.diff") > 0), F.col("_highest")).when(~up & (F.col("_lowest.diff") < 0), F.col("_lowest"))
    labelled = joined.withColumn("critique_up", up).withColumn("main", main).withColumn(
        "direction",
        F.when((dv > 0) & (F.col("net") > 0), "worse").when((dv < 0) & (F.col("net") < 0), "better").otherwise("mixed"))
    b, a = F.col("main.before"), F.col("main.after")
    enough = (F.col("main.labeled_before") > 0) & (F.col("main.labeled_after") > 0)
    se = F.sqrt(b * (1.0 - b) / F.col("main.labeled_before") + a * (1.0 - a) / F.col("main.labeled_after"))
    labelled = labelled.withColumn("_se", F.when(enough, half_up(se, 9)))
    significant = F.coalesce(F.abs("main.diff") >= SIGNIFICANT_SE * F.col("_se"), F.lit(False))
    total = F.when(F.col("critique_up"), F.col("_rise")).otherwise(F.col("_fall"))
    focus = F.when(F.col("significant"), half_up(F.try_divide(F.col("main.diff"), total), 6))
    character = (
        F.when(~F.col("significant"), "undefined").when(F.col("focus") >= FOCUSED, "focused").otherwise("spread"))
    small = F.greatest("main.crit_before", "main.crit_after") < SMALL_VOLUME
    return (
        labelled.withColumn("significant", significant)
        .withColumn("focus", focus)
        .withColumn("character", character)
        .withColumn("se", half_up(F.col("_se"), 6))
        .withColumn("volume", F.when(F.col("main").isNotNull(), F.when(small, "small").otherwise("enough")))
        .select(
            *POINT, "direction", "character", "critique_up", "focus", "se", "significant",
            F.col("main.key").alias("main"), F.col("main.diff").alias("main_diff"), "volume",
            "before_reviews", "after_reviews", "before_negative", "after_negative")
    )


def top_movers(topics: DataFrame, labels: DataFrame, top: int = TOP) -> DataFrame:
    """The categories that rose and fell most, up to three each; a clear direction hides the other side."""
    joined = topics.join(labels.select(*POINT, "direction", "critique_up"), POINT)
    side = (
        F.when((F.col("diff") > 0) & (F.col("direction") != "better"), "rising")
        .when((F.col("diff") < 0) & (F.col("direction") != "worse"), "falling"))
    order = Window.partitionBy(*POINT, "side").orderBy(F.desc(F.abs("diff")), "key")
    return (
        joined.withColumn("side", side).filter("side is not null")
        .withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
        .select(*POINT, "side", "rank", "key", "before", "after", "diff", "crit_before", "crit_after", "critique_up")
    )


def _playtime_group(minutes: Column) -> Column:
    group = None
    for name, low, below in PLAYTIME:
        hit = minutes >= low if below is None else (minutes >= low) & (minutes < below)
        group = F.when(hit, name) if group is None else group.when(hit, name)
    return group


def playtime_segments(labeled: DataFrame, aspect_tags: DataFrame, facts: DataFrame, points: DataFrame, config_sk: int) -> DataFrame:
    """Share of labelled reviews critical of the point's ``main`` category, by playtime and side.

    Only reviews of days some point asks about are read on; they are counted per day, playtime group
    and criticised category before they meet the points.
    """
    group = _playtime_group(F.col("playtime_at_review_min"))
    main = points.select("app_id", F.col("point_day"), "main").filter("main is not null")
    days = window_days(main.select("app_id", F.col("point_day").alias("day")).distinct())
    asked = days.select("app_id", "day").distinct()
    reviews = (
        labeled.filter(F.col("llm_config_sk") == config_sk)
        .join(asked, ["app_id", "day"], "left_semi")
        .join(facts.select("recommendation_id", "playtime_at_review_min"), "recommendation_id")
        .withColumn("playtime", group).filter("playtime is not null")
        .select("app_id", "day", "labeling_sk", "playtime"))
    critical = (
        aspect_tags.filter((F.col("llm_config_sk") == config_sk) & F.col("sentiment").isin("-", "±"))
        .join(asked, ["app_id", "day"], "left_semi")
        .select("labeling_sk", "category_id").distinct())
    all_days = reviews.groupBy("app_id", "day", "playtime").agg(F.count("*").alias("labeled"))
    critical_days = reviews.join(critical, "labeling_sk").groupBy("app_id", "day", "playtime", "category_id").agg(
        F.count("*").alias("critical"))
    groups = F.array(*[F.lit(name) for name, _, _ in PLAYTIME])
    grid = main.withColumn("playtime", F.explode(groups)).withColumn("after", F.explode(F.array(F.lit(False), F.lit(True))))
    n_all = days.join(all_days, ["app_id", "day"]).groupBy(*POINT, "after", "playtime").agg(F.sum("labeled").alias("labeled"))
    n_critical = (
        days.join(main, POINT).join(critical_days, ["app_id", "day"]).filter(F.col("category_id") == F.col("main"))
        .groupBy(*POINT, "after", "playtime", "main").agg(F.sum("critical").alias("critical")))
    zero = F.lit(0).cast("bigint")
    return (
        grid.join(n_all, [*POINT, "after", "playtime"], "left")
        .join(n_critical, [*POINT, "after", "playtime", "main"], "left")
        .select(
            *POINT, "main", "playtime", "after", F.coalesce("labeled", zero).alias("labeled"),
            F.when(F.col("labeled") > 0, half_up(F.coalesce("critical", zero).cast("double") / F.col("labeled"), 6)).alias("share"))
    )


def support_reviews(movers: DataFrame, labeled: DataFrame, aspect_tags: DataFrame, facts: DataFrame, config_sk: int,
                    per_category: int = REVIEWS_PER_CATEGORY) -> DataFrame:
    """Up to fifteen reviews of the week after per moved category: the most voted half, the rest at random.

    "At random" is the order of a hash of review and day, so it repeats. Both ranks are cut before the
    shuffle, and only ids and votes are ranked; texts are joined to the chosen rows afterwards.
    """
    most_voted = (per_category + 1) // 2
    moved = movers.filter(F.col("critique_up") == (F.col("side") == "rising")).select(
        *POINT, F.col("rank").alias("block"), F.col("key").alias("category_id"), "critique_up")
    days = moved.withColumn("day", F.explode(F.sequence("point_day", F.date_add("point_day", WINDOW - 1))))
    # tags meet the few days and categories asked about first; folding covers those alone
    signs = (
        aspect_tags.filter(F.col("llm_config_sk") == config_sk)
        .join(days, ["app_id", "day", "category_id"])
        .groupBy(*POINT, "block", "critique_up", "labeling_sk", "category_id").agg(fold_sentiment().alias("sign")))
    wanted = F.when(F.col("critique_up"), F.col("sign").isin("-", "±")).otherwise(F.col("sign") == "+")
    rows = (
        signs.filter(wanted)
        .join(labeled.select("labeling_sk", "recommendation_id"), "labeling_sk")
        .join(facts.select("recommendation_id", "votes_up"), "recommendation_id")
        .withColumn("h", F.md5(F.concat(F.col("recommendation_id").cast("string"), F.col("point_day").cast("string"))))
        .select(*POINT, "block", "category_id", "labeling_sk", "recommendation_id", "votes_up", "h"))
    group = Window.partitionBy(*POINT, "block")
    by_votes = group.orderBy(F.desc("votes_up"), "recommendation_id")
    by_hash = group.orderBy("h", "recommendation_id")
    top = rows.withColumn("position", F.row_number().over(by_votes)).filter(F.col("position") <= most_voted)
    drawn = rows.withColumn("position", F.row_number().over(by_hash)).filter(F.col("position") <= per_category)
    rest = drawn.drop("position").join(top.select(*POINT, "block", "recommendation_id"), [*POINT, "block", "recommendation_id"], "left_anti")
    tops = top.groupBy(*POINT, "block").agg(F.count("*").alias("_tops"))
    rest = rest.withColumn("_place", F.row_number().over(by_hash)).join(tops, [*POINT, "block"])
    rest = rest.withColumn("position", (F.col("_place") + F.col("_tops")).cast("int")).filter(
        F.col("position") <= per_category).drop("_place", "_tops")
    return top.unionByName(rest.select(*top.columns)).drop("h")


def with_texts(support: DataFrame, labels: DataFrame, versions: DataFrame, chars: int = REVIEW_CHARS) -> DataFrame:
    """Adds the labelled text version of each chosen review, shown up to ``chars`` characters."""
    body = F.col("review_body")
    shown = F.concat(F.left(body, F.lit(chars)), F.when(F.char_length(body) > chars, "…").otherwise(""))
    return (
        support.join(labels.select("labeling_sk", "review_text_sk"), "labeling_sk")
        .join(versions.select("review_text_sk", "review_body"), "review_text_sk")
        .withColumn("text", shown).drop("review_body", "review_text_sk")
    )


def number_support(support: DataFrame) -> DataFrame:
    """Numbers a point's supporting reviews by first appearance over its category blocks."""
    first = support.groupBy(*POINT, "recommendation_id").agg(F.min(F.struct("block", "position")).alias("_first"))
    order = Window.partitionBy(*POINT).orderBy("_first.block", "_first.position")
    numbers = first.select(*POINT, "recommendation_id", F.row_number().over(order).alias("number"))
    return support.join(numbers, [*POINT, "recommendation_id"])


def support_languages(numbered: DataFrame, facts: DataFrame, languages: DataFrame) -> DataFrame:
    """Language code of each numbered review."""
    return (
        numbered.select(*POINT, "number", "recommendation_id").distinct()
        .join(facts.select("recommendation_id", "language_sk"), "recommendation_id")
        .join(languages.select("language_sk", "language_code"), "language_sk")
        .select(*POINT, "number", "recommendation_id", "language_code")
    )


def _rows(df: DataFrame, name: str, order: list[Column], fields: list, keys: list[str] = POINT) -> DataFrame:
    """Bounded child rows of a point as one sorted array column."""
    packed = F.array_sort(F.collect_list(F.struct(*[c.alias(f"_o{i}") for i, c in enumerate(order)], F.struct(*fields).alias("r"))))
    return df.groupBy(*keys).agg(F.transform(packed, lambda x: x["r"]).alias(name))


def evidence_bundle(
    labels: DataFrame, movers: DataFrame, subaspects: DataFrame, playtime: DataFrame,
    numbered: DataFrame, news: DataFrame, platform: DataFrame, config_sk: int,
) -> DataFrame:
    """One nested record per point.

    The arrays are bounded by construction: three topics a side, the aspects of one category, three
    playtime groups, at most 45 reviews. News may be many, so the record holds their number and an
    order-free digest; the rows themselves stay in ``point_news``.
    """
    topic = ["key", "before", "after", "diff", "crit_before", "crit_after"]
    strong = labels.filter("significant").select(*POINT, "main", "critique_up")
    rising = _rows(movers.filter("side = 'rising'"), "rising", [F.col("rank")], topic)
    falling = _rows(movers.filter("side = 'falling'"), "falling", [F.col("rank")], topic)
    own = subaspects.join(strong, (subaspects["app_id"] == strong["app_id"]) & (subaspects["point_day"] == strong["point_day"])
                          & (subaspects["category_id"] == strong["main"])).select(subaspects["*"], strong["critique_up"])
    inner = _rows(own, "subaspects", [F.when(F.col("critique_up"), -F.col("diff")).otherwise(F.col("diff")), F.col("key")], topic)
    played = _rows(playtime.join(strong.select(*POINT), POINT, "left_semi"), "playtime", [F.col("playtime"), F.col("after")],
                   ["playtime", "after", "labeled", "share"])
    reviews = _rows(
        numbered.join(strong.select(*POINT), POINT, "left_semi").dropDuplicates([*POINT, "number"]), "reviews", [F.col("number")],
        ["number", "recommendation_id", "votes_up", "text"])
    # texts stay out of the block lists; those only need numbers
    blocks = _rows(numbered.join(strong.select(*POINT), POINT, "left_semi").select(*POINT, "block", "position", "number"),
                   "review_blocks", [F.col("block"), F.col("position")], ["block", "number"])
    told = news.select("news_day", "title", "event_type", "weight", "major")
    line = F.md5(canonical(F.struct(*told.columns), told.schema))
    # sums of two parts of a hash do not depend on the order, and equal lines do not cancel out
    sums = [F.sum(F.conv(F.substr(line, F.lit(at), F.lit(15)), 16, 10).cast("decimal(20,0)")).cast("string") for at in (1, 17)]
    about = news.groupBy(*POINT).agg(F.count("*").alias("news_count"), F.concat_ws(":", *sums).alias("news_digest"))
    beside = platform.select(*POINT, F.struct("event_date", "event_type", "title").alias("platform_event"))
    out = labels
    for part in (rising, falling, inner, played, reviews, blocks, about, beside):
        out = out.join(part, POINT, "left")
    return out.select(
        *POINT, F.date_sub("point_day", WINDOW).alias("before_from"), F.date_add("point_day", WINDOW).alias("after_to"),
        F.lit(config_sk).alias("labeling_config_sk"),
        F.struct("before_reviews", "after_reviews", "before_negative", "after_negative").alias("votes"),
        F.struct("direction", "character", "critique_up", "focus", "se", "significant", "main", "main_diff", "volume",
                 F.when(F.col("news_count") > 0, "yes").otherwise("no").alias("news")).alias("labels"),
        "rising", "falling", "subaspects", "playtime",
        F.when(F.col("significant"), F.when(F.col("critique_up"), "complaints").otherwise("praise")).alias("review_kind"),
        "reviews", "review_blocks", F.coalesce("news_count", F.lit(0).cast("bigint")).alias("news_count"), "news_digest", "platform_event",
    )


def canonical(value: Column, kind: T.DataType) -> Column:
    """One text per value that any engine can rebuild: texts after their length, fractions in millionths, ``-`` for null."""
    if isinstance(kind, T.StructType):
        parts = [canonical(value[f.name], f.dataType) for f in kind.fields]
        text = F.concat(F.lit("("), F.concat_ws(",", *parts), F.lit(")"))
    elif isinstance(kind, T.ArrayType):
        text = F.concat(F.lit("["), F.array_join(F.transform(value, lambda x: canonical(x, kind.elementType)), ","), F.lit("]"))
    elif isinstance(kind, T.StringType):
        text = F.concat(F.char_length(value).cast("string"), F.lit(":"), value)
    elif isinstance(kind, T.DoubleType):
        text = F.floor(value * F.lit(1e6) + F.lit(0.5)).cast("string")
    else:
        text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(text)


def evidence_hash(bundle: DataFrame) -> DataFrame:
    """Adds sha256 of the record's canonical text without vote counters, which grow with every collection."""
    still = F.transform("reviews", lambda r: F.struct(r["number"], r["recommendation_id"], r["text"]))
    fields = [still.alias(c) if c == "reviews" else F.col(c) for c in bundle.columns]
    record = F.struct(*fields)
    return bundle.withColumn("evidence_hash", F.sha2(canonical(record, bundle.select(*fields).schema), 256))


def percent_text(share: Column) -> Column:
    # fixed values: wording of figures in generated texts
    return F.when(share.isNull(), "нет данных").otherwise(F.concat(percent(share).cast("string"), F.lit("%")))


def points_text(diff: Column) -> Column:
    sign = F.when(diff < 0, "-").otherwise("+")
    return F.concat(sign, percent(F.abs(diff)).cast("string"), F.lit(" п.п."))


def template_verdict(labels: DataFrame) -> DataFrame:
    """Text for a point whose main topic did not change significantly, built from the numbers alone."""
    b, a = F.col("before_negative"), F.col("after_negative")
    change = F.when(a.isNull() | b.isNull(), "").otherwise(F.concat(F.lit(" ("), points_text(a - b), F.lit(")")))
    # fixed values: the template sentence
    text = F.concat(
        F.lit("Доля отзывов с оценкой «не рекомендую» - "), percent_text(b), F.lit(" за 7 дней до и "), percent_text(a),
        F.lit(" после"), change, F.lit("; ни одна категория разметки не изменилась значимо."))
    return labels.filter(~F.col("significant")).select(*POINT, text.alias("what_happened"))
