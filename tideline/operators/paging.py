"""Batches of whole pages, cut one behind the other, without going through the pages one by one.

A batch begins where the last one ended, takes at least ``size`` rows, and ends with the page on which that many are reached.
Where a batch ends depends on where it begins, so all batches hang on the first one. Instead of following that chain, every
page gets a pointer to the page at which a batch that begins with it would be over. Doubling the pointers (one, two, four ...
batches ahead) marks the pages that do begin a batch, with the batch's number, in as many rounds as the number of batches
has binary digits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.operators.facts import latest_per_key
from tideline.session import written


def placed_pages(reviews: DataFrame) -> DataFrame:
    """(fetched_at, page_rows, page_start, page_end): rows of each page, before it and up to its end, in load order.

    The running total over all pages is built from sums at three grains (day, second, page), so no window partition is
    larger than the seconds of a day or the microseconds of a second, whatever the volume.
    """
    pages = (
        reviews.groupBy("fetched_at").agg(F.count("*").alias("page_rows"))
        .withColumn("_day", F.to_date("fetched_at"))
        .withColumn("_second", F.unix_seconds("fetched_at"))
    )
    seconds = pages.groupBy("_day", "_second").agg(F.sum("page_rows").alias("n"))
    days = seconds.groupBy("_day").agg(F.sum("n").alias("n"))

    def before(window):
        return F.coalesce(F.sum("n").over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    day_start = days.select("_day", before(Window.partitionBy(F.lit(0)).orderBy("_day")).alias("_days_before"))
    second_start = seconds.select(
        "_day", "_second", before(Window.partitionBy("_day").orderBy("_second")).alias("_seconds_before"))
    within = Window.partitionBy("_second").orderBy("fetched_at").rowsBetween(Window.unboundedPreceding, 0)
    numbered = (
        pages.withColumn("_upto", F.sum("page_rows").over(within))
        .join(second_start, ["_day", "_second"])
        .join(day_start, "_day")
    )
    page_end = F.col("_days_before") + F.col("_seconds_before") + F.col("_upto")
    return numbered.select("fetched_at", "page_rows", (page_end - F.col("page_rows")).alias("page_start"), page_end.alias("page_end"))


def _blocks(first, last, size: int):
    """Numbers of the stretches of ``size`` rows that a range of rows lies in."""
    return F.explode(F.sequence(F.floor(first / size), F.floor(last / size)))


def batch_pointers(pages: DataFrame, size: int, total: int) -> DataFrame:
    """(start, next): where a batch that begins with a page would end.

    The page that holds row ``start + size`` is looked up among the pages of its stretch of ``size`` rows. A stretch holds at
    most that many pages and as many that look for theirs, so its window is bounded, and a page of many rows is
    in as many stretches as it has rows for.
    """
    wanted = F.col("page_start") + size
    first, last = F.col("page_start") + 1, F.col("page_end")
    pieces = pages.select(_blocks(F.col("page_start"), last - 1, size).alias("block"), first.alias("row"), F.lit(0).alias("asks"), last.alias("end"), F.lit(None).cast("bigint").alias("start"))
    # a page that began in an earlier stretch is the first of this one
    pieces = pieces.withColumn("row", F.greatest("row", F.col("block") * size + 1))
    asks = pages.where(wanted < total).select(
        F.floor((wanted - 1) / size).alias("block"), wanted.alias("row"), F.lit(1).alias("asks"), F.lit(None).cast("bigint").alias("end"), F.col("page_start").alias("start"))
    order = Window.partitionBy("block").orderBy("row", "asks").rowsBetween(Window.unboundedPreceding, 0)
    found = pieces.unionByName(asks).withColumn("next", F.last("end", ignorenulls=True).over(order)).where("asks = 1").select("start", "next")
    rest = pages.where(wanted >= total).select(F.col("page_start").alias("start"), F.lit(total).cast("bigint").alias("next"))
    return found.unionByName(rest)


def batch_starts(pointers: DataFrame, size: int, total: int) -> DataFrame:
    """(start, next, batch) of the pages that begin a batch."""
    state = pointers.select("start", "next", F.col("next").alias("ahead"), F.when(F.col("start") == 0, 0).cast("bigint").alias("batch"))
    state = written(state, "pointers")
    for digit in range((-(-total // size) - 1).bit_length()):
        # batch numbers so far are below 2 ** digit, and ``ahead`` is that many batches ahead
        reached = state.where(F.col("batch").isNotNull() & (F.col("ahead") < total)).select(F.col("ahead").alias("start"), (F.col("batch") + (1 << digit)).alias("found"))
        onward = state.select(F.col("start").alias("ahead"), F.col("ahead").alias("beyond"))
        state = state.join(onward, "ahead", "left").join(reached, "start", "left").select(
            "start", "next", F.coalesce("beyond", F.lit(total)).alias("ahead"), F.coalesce("batch", "found").alias("batch"))
        state = written(state, "pointers")
    return state.where("batch is not null").select("start", "next", "batch")


def page_batches(reviews: DataFrame, size: int) -> DataFrame:
    """Batch number of each page in load order; a batch never splits a page and has ``size`` rows at least, the last one apart.

    An empty table has no pages. A page of more than ``size`` rows ends the batch that it is in.
    """
    if size < 1:
        raise ValueError("a batch has one row at least")
    pages = written(placed_pages(reviews), "pages")
    # one number, which bounds the rounds
    total = pages.agg(F.coalesce(F.max("page_end"), F.lit(0)).alias("total")).first().total
    starts = batch_starts(batch_pointers(pages, size, total), size, total)
    # a stretch of ``size`` rows meets three batches at most, so pages meet theirs by an equality
    pieces = starts.select("batch", "start", "next", _blocks(F.col("start"), F.col("next") - 1, size).alias("block"))
    here = pages.withColumn("block", F.floor(F.col("page_start") / size))
    inside = (F.col("start") <= F.col("page_start")) & (F.col("page_start") < F.col("next"))
    return here.join(pieces, "block").where(inside).select("fetched_at", "page_rows", "page_end", "batch")


def review_batches(reviews: DataFrame, size: int) -> DataFrame:
    """The newest copy of each review with the batch of its page; copies that are not loaded do not count."""
    newest = latest_per_key(reviews, ["recommendation_id"], [F.desc("fetched_at"), F.desc("raw_id")])
    return newest.join(page_batches(newest, size).select("fetched_at", "batch"), "fetched_at")
