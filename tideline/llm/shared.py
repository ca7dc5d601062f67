"""Settings and folders that the operators share."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.session import written

#: rows of a batch handed to Python; texts may be long, so batches stay small
BATCH_ROWS = 512


def small_batches(spark: SparkSession) -> None:
    """Bounds the bytes of text that one Arrow batch holds."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fold(column: str, parts: int) -> Column:
    """crc32 of a value's text, modulo ``parts``; null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % parts


def fold_of(text: str, parts: int) -> int:
    return zlib.crc32(text.encode()) % parts


#: 64-bit words of a bitmap: 2 MB, whatever the data
SLOTS = 1 << 18


def bitmap_of(rows: DataFrame, column: str = "fp", slots: int = SLOTS) -> np.ndarray:
    """Bitmap of a column of 64-bit hashes; at most ``slots`` rows reach the driver."""
    place = F.expr(f"{column} & {slots * 64 - 1}L")
    bits = rows.select(F.shiftright(place, 6).cast("int").alias("slot"), F.expr(f"shiftleft(1L, cast(({column} & 63L) as int))").alias("bit"))
    out = np.zeros(slots, np.uint64)
    for row in bits.groupBy("slot").agg(F.bit_or("bit").alias("bits")).collect():
        out[row.slot] = row.bits & (1 << 64) - 1
    return out


def in_bitmap(bitmap: np.ndarray, fp: np.ndarray) -> np.ndarray:
    """Which unsigned hashes may be in a bitmap; a hash that is in it always is."""
    bit = fp % np.uint64(bitmap.size * 64)
    return (bitmap[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) > 0


def ascii_lower(column: Column) -> Column:
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


__all__ = ["BATCH_ROWS", "SLOTS", "ascii_lower", "bitmap_of", "fold", "fold_of", "in_bitmap", "small_batches", "table", "written"]
