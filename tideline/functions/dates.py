"""UTC day keys and loosely formatted release dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: release date formats in the order they are tried
RELEASE_DATE_FORMATS = ("d MMM, yyyy", "MMM d, yyyy", "d MMMM, yyyy", "MMMM d, yyyy", "yyyy")


def utc_day(ts: Column) -> Column:
    return F.to_date(ts)


def date_key(ts: Column) -> Column:
    """20240131 for an instant on 31 January 2024."""
    return F.date_format(ts, "yyyyMMdd").cast("int")


def hour_key(ts: Column) -> Column:
    return F.hour(ts).cast("smallint")


def parse_release_date(raw: Column) -> Column:
    text = F.regexp_replace(raw, r"^\s+|\s+$", "")
    return F.coalesce(*[F.try_to_date(text, fmt) for fmt in RELEASE_DATE_FORMATS])
