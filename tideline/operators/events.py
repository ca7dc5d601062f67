"""News and platform events: weights, response in the data, and what lies near a change point."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.dates import utc_day
from tideline.functions.numbers import half_up
from tideline.functions.titles import platform_label

NEAR_DAYS = 3
SIGNIFICANT_WEIGHT = 2
# fixed values: kinds that matter at any weight, and kinds that never do
ALWAYS_SIGNIFICANT = ("season_start", "expansion")
NEVER_SIGNIFICANT = ("marketing", "blog", "service")
RESPONSE_WINDOW = 3
RESPONSE_VOLUME_RATIO = 2.0
RESPONSE_SHIFT_PP = 12
RESPONSE_MIN_REVIEWS = 30
# fixed values: (days on screen, comparison, least weight shown)
DENSITY = ((365, "over", 5), (180, "from", 2), (60, "from", 1))
# fixed values: relative windows of the event-impact mart: code, first day, day after the last, baseline
WINDOWS = (
    ("before_28", -28, 0, True),
    ("before_14", -14, 0, True),
    ("before_7", -7, 0, True),
    ("after_1", 0, 1, False),
    ("after_3", 0, 3, False),
    ("after_7", 0, 7, False),
    ("after_14", 0, 14, False),
)
# fixed values: the windows whose shares are compared
SIDES = tuple(w for w in WINDOWS if w[0] in ("before_7", "after_7"))
# part of a day whose reviews and events one group counts, and the order of rows in it
BLOCK_SECONDS = 900
START, EDGE, REVIEW = 0, 1, 2
IMPACT_MIN_REVIEWS = 30
IMPACT_MIN_SHIFT_PP = 3
IMPACT_TOP = 20
DAY_SECONDS = 86400


def event_weight(patches: DataFrame, dim: DataFrame) -> DataFrame:
    """Body length over the product's median patch length (all bodies when it has no patch).

    Lengths are counted before the medians are taken, so a product's group holds distinct lengths only.
    The median is per product, not per version; the Unknown product and empty bodies get no weight.
    """
    games = dim.filter("app_id > 0").select("game_sk", "app_id")
    with_app = patches.join(games, "game_sk", "left")
    filled = F.col("body_length") > 0
    lengths = (
        with_app.filter(filled & F.col("app_id").isNotNull())
        .groupBy("app_id", "body_length")
        .agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "patch").alias("patches"))
    )
    medians = lengths.groupBy("app_id").agg(
        F.expr("percentile(body_length, 0.5, patches) FILTER (WHERE patches > 0)").alias("_patch"),
        F.expr("percentile(body_length, 0.5, n)").alias("_any"),
    ).select("app_id", F.greatest(F.coalesce("_patch", "_any"), F.lit(1.0)).alias("_median"))
    weight = F.when(filled, F.round(F.col("body_length").cast("decimal(18,0)") / F.col("_median").cast("decimal(18,1)"), 2))
    return with_app.join(medians, "app_id", "left").withColumn("weight", weight.cast("decimal(8,2)")).drop("_median")


def kind_distribution(events: DataFrame) -> DataFrame:
    """Count and percent per kind."""
    counts = events.groupBy("event_type").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    return counts.withColumn("total", total).withColumn("percent", half_up(100.0 * F.col("n") / F.col("total"), 1))


def distinct_events(patches: DataFrame) -> DataFrame:
    """One announcement may carry several news ids; it is one event of its day."""
    return patches.filter("app_id > 0").select(
        "app_id", utc_day(F.col("published_at")).alias("day"), "event_type", "title", "weight"
    ).distinct()


def is_significant() -> Column:
    kind = F.col("event_type")
    return (
        F.when(kind.isin(*ALWAYS_SIGNIFICANT), True)
        .when(kind.isin(*NEVER_SIGNIFICANT), False)
        .otherwise(F.coalesce(F.col("weight").cast("double"), F.lit(0.0)) >= SIGNIFICANT_WEIGHT)
    )


def event_response(series: DataFrame) -> DataFrame:
    """Days on which volume or share around the day moves unusually (sums over three days each side)."""
    by_day = Window.partitionBy("app_id").orderBy("day")
    before = by_day.rowsBetween(-RESPONSE_WINDOW, -1)
    after = by_day.rowsBetween(0, RESPONSE_WINDOW - 1)
    out = series.select(
        "app_id", "day",
        F.sum("total").over(before).alias("bt"), F.sum("total").over(after).alias("at"),
        F.sum("positive").over(before).alias("bp"), F.sum("positive").over(after).alias("ap"),
        F.count("total").over(before).alias("bn"), F.count("total").over(after).alias("an"),
    )
    bt, at = F.col("bt"), F.col("at")
    louder = (bt > 0) & (F.try_divide(at / F.col("an"), bt / F.col("bn")) >= RESPONSE_VOLUME_RATIO)
    shift = F.abs(F.try_divide(100.0 * F.col("ap"), at) - F.try_divide(100.0 * F.col("bp"), bt))
    moved = (F.least(bt, at) >= RESPONSE_MIN_REVIEWS) & (shift >= RESPONSE_SHIFT_PP)
    responsive = (F.col("bn") > 0) & F.coalesce(louder | moved, F.lit(False))
    return out.select("app_id", "day", bt.alias("before_total"), at.alias("after_total"), responsive.alias("responsive"))


def series_events(events: DataFrame, series: DataFrame) -> DataFrame:
    """Events on the days of the product's series, with the response of the data to their day."""
    days = event_response(series).select("app_id", "day", "responsive")
    return events.join(days, ["app_id", "day"])


def chart_events(events: DataFrame, series: DataFrame, min_weight: float = 0.0) -> DataFrame:
    """Events worth a marker: always-shown kinds, days with a response, or enough weight."""
    always = F.col("event_type").isin(*ALWAYS_SIGNIFICANT) | F.col("responsive")
    heavy = F.coalesce(F.col("weight").cast("double"), F.lit(0.0)) >= min_weight
    return (
        series_events(events, series)
        .withColumn("always_show", always)
        .filter(F.col("always_show") | heavy)
        .drop("responsive")
    )


def density_filter(events: DataFrame, days_visible: int) -> DataFrame:
    """On a wide range light events are hidden, unless they are always shown."""
    least = 0
    for days, how, weight in reversed(DENSITY):
        if days_visible > days or (how == "from" and days_visible == days):
            least = weight
    if not least:
        return events
    return events.filter(F.col("always_show") | (F.coalesce(F.col("weight").cast("double"), F.lit(0.0)) >= least))


def platform_events_in_range(platform: DataFrame, daily: DataFrame) -> DataFrame:
    """Platform events between a product's first and last day.

    Years of the product's range meet the event's year in an equi join; the exact days are checked after.
    """
    years = series_bounds(daily).withColumn("_year", F.explode(F.sequence(F.year("first_day"), F.year("last_day"))))
    return (
        years.join(platform.withColumn("_year", F.year("event_date")), "_year")
        .filter(F.col("event_date").between(F.col("first_day"), F.col("last_day")))
        .select("app_id", "event_date", "event_type", "title")
    )


def _around(df: DataFrame, day: str, reach: int = NEAR_DAYS) -> DataFrame:
    return df.withColumn("_near", F.explode(F.sequence(F.date_sub(day, reach), F.date_add(day, reach))))


def series_bounds(daily: DataFrame) -> DataFrame:
    """First and last day of each product's reviews; events outside have nothing to explain."""
    return daily.groupBy("app_id").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"))


def _inside(rows: DataFrame, day: str, bounds: DataFrame | None) -> DataFrame:
    if bounds is None:
        return rows
    return rows.join(bounds, "app_id").filter(F.col(day).between(F.col("first_day"), F.col("last_day"))).drop("first_day", "last_day")


def nearby_events(points: DataFrame, events: DataFrame, bounds: DataFrame | None = None, reach: int = NEAR_DAYS) -> DataFrame:
    """Events within ``reach`` days of each point (and inside ``bounds``, if given).

    A point is spread over its neighbouring days, so the match is an equi join on (product, day).
    """
    spread = _around(points.select("app_id", F.col("day").alias("point_day"), "score"), "point_day", reach)
    found = events.withColumnRenamed("day", "event_day")
    near = spread.join(
        found, (spread["app_id"] == found["app_id"]) & (spread["_near"] == found["event_day"])
    ).drop(found["app_id"]).drop("_near")
    return _inside(near, "event_day", bounds)


def nearest_platform_event(points: DataFrame, platform: DataFrame, bounds: DataFrame | None = None, reach: int = NEAR_DAYS) -> DataFrame:
    """The platform event closest to each point; of equally close ones the earlier, then by title."""
    spread = _around(points.select("app_id", F.col("day").alias("point_day")), "point_day", reach)
    near = _inside(spread.join(platform, spread["_near"] == platform["event_date"]), "event_date", bounds)
    rank = F.struct(F.abs(F.date_diff("event_date", "point_day")), F.col("event_date"), F.col("title"))
    return near.groupBy("app_id", "point_day").agg(
        F.min_by(F.struct("event_date", "event_type", "title"), rank).alias("e")
    ).select("app_id", "point_day", "e.event_date", "e.event_type", "e.title")


def explained_points(points: DataFrame, events: DataFrame, platform: DataFrame, bounds: DataFrame | None = None) -> DataFrame:
    """Each point with the events beside it, one row per event; a point without any keeps one row.

    ``role`` is major, minor or platform. Rows instead of nested lists keep a day crowded with news
    from becoming one oversized record.
    """
    near = nearby_events(points, events, bounds).select(
        "app_id", "point_day", F.when(is_significant(), "major").otherwise("minor").alias("role"),
        "event_day", "event_type", "title", F.col("weight").cast("double").alias("weight"))
    beside = nearest_platform_event(points, platform, bounds).select(
        "app_id", "point_day", F.lit("platform").alias("role"), F.col("event_date").alias("event_day"),
        "event_type", "title", F.lit(None).cast("double").alias("weight"))
    heads = points.select("app_id", F.col("day").alias("point_day"), half_up(F.col("score"), 1).alias("score"))
    return heads.join(near.unionByName(beside), ["app_id", "point_day"], "left")


def main_event(explained: DataFrame) -> DataFrame:
    """Headline of a point: its first major event, else the platform event, else how many minor ones."""
    first = F.struct("event_day", "event_type", "title", F.col("weight"))
    major = F.col("role") == "major"
    heads = explained.groupBy("app_id", "point_day", "score").agg(
        F.min(F.when(major, first)).alias("_major"),
        F.min(F.when(F.col("role") == "platform", F.struct("event_type", "title"))).alias("_platform"),
        F.count_if(F.col("role") == "minor").alias("minor_events"),
    )
    label = (
        F.when(F.col("_major").isNotNull(), F.concat_ws(": ", "_major.event_type", "_major.title"))
        .when(
            F.col("_platform").isNotNull(),
            F.concat_ws(": ", F.lit("platform"), platform_label(F.col("_platform.event_type"), F.col("_platform.title"))),
        )
        .when(F.col("minor_events") > 0, F.concat(F.col("minor_events").cast("string"), F.lit(" minor events")))
        .otherwise("no events nearby")
    )
    return heads.select("app_id", "point_day", "score", "minor_events", label.alias("headline"))


def point_news(points: DataFrame, events: DataFrame, bounds: DataFrame | None = None) -> DataFrame:
    """News of each point: kind, weight, whether major, and the nearest day that title was published."""
    near = nearby_events(points, events, bounds)
    distance = F.abs(F.date_diff("event_day", "point_day"))
    dated = near.groupBy("app_id", "point_day", "title").agg(
        F.min_by("event_day", F.struct(distance, F.col("event_day"))).alias("news_day"))
    named = dated.select(F.col("app_id").alias("_app"), F.col("point_day").alias("_point"), F.col("title").alias("_title"), "news_day")
    same = (F.col("app_id") == F.col("_app")) & (F.col("point_day") == F.col("_point")) & F.col("title").eqNullSafe(F.col("_title"))
    return near.join(named, same).select(
        "app_id", "point_day", "news_day", "title", "event_type",
        F.col("weight").cast("double").alias("weight"), is_significant().alias("major"))


def period_summary(explained: DataFrame, first: str, last: str) -> DataFrame:
    """Points of a date range with direction, size and headline."""
    inside = F.col("point_day").between(F.lit(first).cast("date"), F.lit(last).cast("date"))
    heads = main_event(explained.filter(inside))
    return heads.select(
        "app_id", "point_day", F.when(F.col("score") < 0, "down").otherwise("up").alias("direction"),
        F.abs("score").alias("size_pp"), "headline")


def windows_array() -> Column:
    return F.array(*[
        F.struct(F.lit(code).alias("window_code"), F.lit(a).alias("day_from"), F.lit(b).alias("day_to"),
                 F.lit(base).alias("is_baseline"))
        for code, a, b, base in WINDOWS
    ])


def _offsets(windows: tuple) -> list[int]:
    """Window edges, in days from the event: eight of all seven windows, since they share them."""
    return sorted({o for _, a, b, _ in windows for o in (a, b)})


def _windows_from_edges(at_edges: DataFrame, keys: list[str], bounds: DataFrame, windows: tuple) -> DataFrame:
    """Counts up to each edge -> one row an event: an array of the counts inside each window, and the bounds of the product."""
    per_event = at_edges.groupBy(*keys).agg(
        *[
            F.max(F.when(F.col("offset") == o, F.col(c))).alias(f"{c}_{o + 100}")
            for o in _offsets(windows)
            for c in ("upto_reviews", "upto_positives")
        ]
    )
    rows = F.array(*[
        F.struct(
            F.lit(code).alias("window_code"), F.lit(a).alias("day_from"), F.lit(b).alias("day_to"),
            F.lit(base).alias("is_baseline"),
            (F.col(f"upto_reviews_{b + 100}") - F.col(f"upto_reviews_{a + 100}")).alias("review_count"),
            (F.col(f"upto_positives_{b + 100}") - F.col(f"upto_positives_{a + 100}")).alias("positive_count"),
        )
        for code, a, b, base in windows
    ])
    return per_event.join(bounds, "app_id").select(*keys, "data_from", "data_to", rows.alias("windows"))


def _block(second: Column) -> Column:
    """Part of the day that a second lies in; all window edges of an event lie in the same one."""
    return F.floor(F.pmod(second, F.lit(DAY_SECONDS)) / BLOCK_SECONDS).cast("int")


def _counts_before_blocks(reviews: DataFrame, events: DataFrame, offsets: list[int]) -> DataFrame:
    """Reviews and positives ahead of each block that an edge lies in.

    Blocks are counted before anything is ordered, so a product's running count is over its calendar and not its reviews.
    """
    counted = reviews.groupBy("app_id", "day_no", "block").agg(F.count("*").alias("reviews"), F.count_if("voted_up").alias("positives"))
    asked = events.select("app_id", "day_no", "block").distinct().withColumn("offset", F.explode(F.array(*[F.lit(o) for o in offsets]))).select(
        "app_id", (F.col("day_no") + F.col("offset")).alias("day_no"), "block").distinct()
    zero = F.lit(0).cast("bigint")
    blocks = counted.withColumn("asked", F.lit(False)).unionByName(
        asked.select("*", zero.alias("reviews"), zero.alias("positives"), F.lit(True).alias("asked"))
    ).groupBy("app_id", "day_no", "block").agg(
        F.sum("reviews").alias("reviews"), F.sum("positives").alias("positives"), F.bool_or("asked").alias("asked"))
    before = Window.partitionBy("app_id").orderBy("day_no", "block").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.select(
        "app_id", "day_no", "block", "asked", F.coalesce(F.sum("reviews").over(before), zero).alias("reviews"),
        F.coalesce(F.sum("positives").over(before), zero).alias("positives")).filter("asked").drop("asked")


def event_windows(patches: DataFrame, flat: DataFrame, windows: tuple = WINDOWS) -> DataFrame:
    """One row an event: reviews and positives in the windows around it, to the second, as an array.

    Instead of a range join, every window edge is looked up in a running count, and a window is the difference of its two
    edges. All edges of an event have its time of day, so reviews and events are shuffled once, by product and block of
    the day, an event as one row: its edges are made, counted and brought together where it arrives. The running count
    inside a block starts from the count of all blocks before. Nothing grows with events x reviews.
    """
    offsets = _offsets(windows)
    second = F.unix_seconds("created_at")
    day_no = F.floor(F.col("second") / DAY_SECONDS).cast("int").alias("day_no")
    block = _block(F.col("second")).alias("block")
    placed = F.col("app_id").isNotNull() & F.col("second").isNotNull()
    reviews = flat.select("app_id", second.alias("second"), "voted_up").filter(placed).select("*", day_no, block)
    events = patches.select("app_id", F.unix_seconds("published_at").alias("second"), "patch_sk").filter(placed).select("*", day_no, block)

    none, zero = F.lit(None).cast(patches.schema["patch_sk"].dataType), F.lit(0).cast("bigint")
    # order in a block: its start, then by second; an edge comes before the reviews of its own second, since windows
    # include their start and exclude their end
    started = _counts_before_blocks(reviews, events, offsets).select(
        "app_id", "block", (F.col("day_no").cast("bigint") * DAY_SECONDS + F.col("block") * BLOCK_SECONDS).alias("second"), F.lit(START).alias("kind"),
        "reviews", "positives", none.alias("patch_sk"))
    asked = events.select("app_id", "block", "second", F.lit(EDGE).alias("kind"), zero.alias("reviews"), zero.alias("positives"), "patch_sk")
    given = reviews.select(
        "app_id", "block", "second", F.lit(REVIEW).alias("kind"), F.lit(1).cast("bigint").alias("reviews"),
        F.when(F.col("voted_up"), 1).otherwise(0).cast("bigint").alias("positives"), none.alias("patch_sk"))
    dealt = started.unionByName(asked).unionByName(given).repartition("app_id", "block")

    edges = F.when(F.col("kind") == EDGE, F.array(*[F.lit(o) for o in offsets])).otherwise(F.array(F.lit(0)))
    placed_edges = dealt.withColumn("offset", F.explode(edges)).select(
        "*", (F.col("second") + F.col("offset") * DAY_SECONDS).alias("at")).withColumn("day_no", F.floor(F.col("at") / DAY_SECONDS).cast("int"))
    in_block = Window.partitionBy("app_id", "block", "day_no").orderBy(F.col("kind") != START, "at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    upto = placed_edges.select(
        "app_id", "block", "patch_sk", F.col("second").alias("published"), "offset", "kind",
        F.sum("reviews").over(in_block).alias("upto_reviews"), F.sum("positives").over(in_block).alias("upto_positives")).filter(F.col("kind") == EDGE)

    bounds = reviews.groupBy("app_id").agg(F.min("second").alias("data_from"), F.max("second").alias("data_to"))
    return _windows_from_edges(upto, ["patch_sk", "app_id", "published", "block"], bounds, windows)


def patch_impact(patches: DataFrame, flat: DataFrame) -> DataFrame:
    """Reviews and positives in seven windows around each event, to the second; a row each."""
    impact = event_windows(patches, flat).select("patch_sk", "app_id", "published", "data_from", "data_to", F.inline("windows"))
    first = F.col("published") + F.col("day_from") * DAY_SECONDS
    end = F.col("published") + F.col("day_to") * DAY_SECONDS
    return impact.withColumn(
        "window_complete", (first >= F.col("data_from")) & (end <= F.col("data_to"))
    ).select("patch_sk", "app_id", "window_code", "day_from", "day_to", "is_baseline",
             "review_count", "positive_count", "window_complete")


def patch_impact_daily(patches: DataFrame, daily: DataFrame) -> DataFrame:
    """The same windows at day grain, from the daily mart; the event day belongs to neither side.

    ``before_7`` is the seven days before the event day and ``after_7`` the seven days after it.
    Running day totals turn each window into two equi-join look-ups.
    """
    events = patches.select("patch_sk", "app_id", utc_day(F.col("published_at")).alias("event_day"))
    # the after side starts one day later: offset 0 splits into "before the day" and "after the day"
    edge_days = sorted({a if base else a + 1 for _, a, _, base in WINDOWS} | {b if base else b + 1 for _, _, b, base in WINDOWS})
    edges = events.withColumn("offset", F.explode(F.array(*[F.lit(o) for o in edge_days]))).withColumn(
        "edge_day", F.date_add("event_day", F.col("offset")))
    upto_before = Window.partitionBy("app_id").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    asked = edges.select("app_id", F.col("edge_day").alias("day")).distinct().withColumn(
        "review_count", F.lit(0).cast("bigint")).withColumn("positive_count", F.lit(0).cast("bigint"))
    days = asked.unionByName(daily.select("app_id", "day", "review_count", "positive_count")).groupBy("app_id", "day").agg(
        F.sum("review_count").alias("review_count"), F.sum("positive_count").alias("positive_count"))
    running = days.select(
        "app_id", F.col("day").alias("edge_day"),
        F.coalesce(F.sum("review_count").over(upto_before), F.lit(0)).alias("upto_reviews"),
        F.coalesce(F.sum("positive_count").over(upto_before), F.lit(0)).alias("upto_positives"))
    at_edges = edges.join(running, ["app_id", "edge_day"])
    keys = ["patch_sk", "app_id", "event_day"]
    per_event = at_edges.groupBy(*keys).agg(*[
        F.max(F.when(F.col("offset") == o, F.col(c))).alias(f"{c}_{o + 100}")
        for o in edge_days for c in ("upto_reviews", "upto_positives")])

    def inside(c: str, a: int, b: int, base: bool) -> Column:
        shift = 0 if base else 1
        return F.col(f"{c}_{b + shift + 100}") - F.col(f"{c}_{a + shift + 100}")

    rows = F.array(*[
        F.struct(
            F.lit(code).alias("window_code"), F.lit(a).alias("day_from"), F.lit(b).alias("day_to"),
            F.lit(base).alias("is_baseline"), inside("upto_reviews", a, b, base).alias("review_count"),
            inside("upto_positives", a, b, base).alias("positive_count"))
        for code, a, b, base in WINDOWS])
    bounds = daily.groupBy("app_id").agg(F.min("day").alias("data_from"), F.max("day").alias("data_to"))
    side = F.when(F.col("is_baseline"), 0).otherwise(1)
    first = F.date_add("event_day", F.col("day_from") + side)
    last = F.date_add("event_day", F.col("day_to") + side - 1)
    return per_event.select(*keys, F.inline(rows)).join(bounds, "app_id").withColumn(
        "window_complete", (first >= F.col("data_from")) & (last <= F.col("data_to"))
    ).select("patch_sk", "app_id", "window_code", "day_from", "day_to", "is_baseline",
             "review_count", "positive_count", "window_complete")


def _largest_shifts(sides: DataFrame, top: int) -> DataFrame:
    """``sides`` has app_id, patch_sk, reviews and positives before (bn, bp) and after (an, ap), and complete; one row an event."""
    shift = half_up(100.0 * F.try_divide(F.col("ap"), F.col("an")) - 100.0 * F.try_divide(F.col("bp"), F.col("bn")), 6)
    order = Window.partitionBy("app_id").orderBy(F.desc(F.abs("shift_pp")), "patch_sk")
    return (
        sides.filter(F.col("complete") & (F.least("bn", "an") >= IMPACT_MIN_REVIEWS))
        .withColumn("shift_pp", shift)
        .filter(F.abs("shift_pp") >= IMPACT_MIN_SHIFT_PP)
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= top)
        .select("app_id", "patch_sk", F.col("bn").alias("before_reviews"), F.col("an").alias("after_reviews"), "shift_pp", "rank")
    )


def event_impact(impact: DataFrame, top: int = IMPACT_TOP) -> DataFrame:
    """Events whose week after differs most from the week before, at most ``top`` per product, from the stored mart."""

    def side(code: str, c: str) -> Column:
        return F.max(F.when(F.col("window_code") == code, F.col(c)))

    sides = impact.filter(F.col("window_code").isin("before_7", "after_7")).groupBy("app_id", "patch_sk").agg(
        side("before_7", "review_count").alias("bn"), side("before_7", "positive_count").alias("bp"),
        side("after_7", "review_count").alias("an"), side("after_7", "positive_count").alias("ap"),
        F.bool_and("window_complete").alias("complete"),
    )
    return _largest_shifts(sides, top)


def event_impact_now(patches: DataFrame, flat: DataFrame, top: int = IMPACT_TOP) -> DataFrame:
    """The same without the mart: only the two windows are counted, and an event's row stays where they meet."""
    first, last = (F.col("published") + days * DAY_SECONDS for days in (SIDES[0][1], SIDES[1][2]))
    before, after = F.col("windows")[0], F.col("windows")[1]
    sides = event_windows(patches, flat, SIDES).select(
        "app_id", "patch_sk", before["review_count"].alias("bn"), before["positive_count"].alias("bp"),
        after["review_count"].alias("an"), after["positive_count"].alias("ap"),
        ((first >= F.col("data_from")) & (last <= F.col("data_to"))).alias("complete"))
    return _largest_shifts(sides, top)
