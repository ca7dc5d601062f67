"""Rounding and shares.

Python and SQL engines break ties differently, so every rounded figure goes through one
half-up rule on doubles that any engine can repeat exactly.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column, digits: int) -> Column:
    scale = F.lit(float(10**digits))
    return F.floor(x * scale + F.lit(0.5)).cast("double") / scale


def percent(share: Column) -> Column:
    """Whole percent of a share, halves up (0.025 -> 3)."""
    return F.floor(share * F.lit(100.0) + F.lit(0.5)).cast("int")


def share_pp(part: Column, whole: Column) -> Column:
    """Percentage with one decimal; null when there is nothing to divide by."""
    return F.when(whole > 0, F.floor(F.lit(1000.0) * part / whole + F.lit(0.5)).cast("double") / F.lit(10.0))


#: type of surrogate keys; keys stored as whole numbers widen to it
KEY_TYPE = "decimal(38,0)"


def stable_key(*cols: Column) -> Column:
    """Surrogate key that depends only on the natural key, so reruns and parallel loads agree.

    Parts are told apart by their lengths and nulls by a mark of their own, so different natural keys never share a text;
    the key is the first 120 bits of its digest, which is as much as whole hexadecimal digits in a decimal can hold.
    """
    parts = [c.cast("string") for c in cols]
    text = F.concat(*[F.coalesce(F.concat(F.length(p).cast("string"), F.lit(":"), p), F.lit("-")) for p in parts])
    high, low = (F.conv(F.substring(F.md5(text), first, 15), 16, 10).cast("decimal(20,0)") for first in (1, 16))
    return (high * F.lit(1 << 60).cast("decimal(20,0)") + low).cast(KEY_TYPE)
