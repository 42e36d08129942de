"""Units as bitmaps: a (year, section) unit is a bit, 64 units are a long, and a set of units is rows of longs.

Counting units is counting the bits of an OR; leaving out a section or a year is an AND with a mask, without reading a text again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Units are numbered within so many slots at once, so that no single task numbers all of them. Numbers have few gaps.
SLOTS = 16
KEY = ["year", "section"]


def units(papers: DataFrame) -> DataFrame:
    """Distinct (year, section) of the papers; a null is a value of its own."""
    return papers.select(*KEY).distinct()


def numbered(papers: DataFrame) -> DataFrame:
    """year, section, w, bit of every unit: its long, and its bit within it."""
    slot = F.pmod(F.xxhash64(*KEY), F.lit(SLOTS))
    rank = F.row_number().over(W.partitionBy("slot").orderBy(*KEY)) - 1
    number = (rank * SLOTS + F.col("slot")).cast("long")
    rows = units(papers).withColumn("slot", slot).withColumn("unit", number)
    return rows.select(*KEY, F.shiftright("unit", 6).alias("w"), F.expr("shiftleft(1L, int(unit & 63))").alias("bit"))


def marked(rows: DataFrame, numbers: DataFrame) -> DataFrame:
    """rows with w and bit of their unit in place of year and section. The numbers are few; Spark broadcasts them by their measured size."""
    n = numbers.select(*[F.col(c).alias("__" + c) for c in KEY], "w", "bit")
    same = reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col("__" + c)) for c in KEY))
    return rows.join(n, same).drop(*KEY, *["__" + c for c in KEY])


def mask(numbers: DataFrame, kept: DataFrame) -> DataFrame:
    """w, mask: the bits of the units that occur in `kept`. A row for every 64 units."""
    k = units(kept).select(*[F.col(c).alias("__" + c) for c in KEY])
    same = reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col("__" + c)) for c in KEY))
    return numbers.join(k, same, "left_semi").groupBy("w").agg(F.bit_or("bit").alias("mask"))


def masked(rows: DataFrame, mask_: DataFrame) -> DataFrame:
    """Bitmap rows with the units of the mask alone; rows without any go. Other columns stay as they are."""
    return rows.join(mask_, "w").withColumn("bits", F.col("bits").bitwiseAND(F.col("mask"))).where("bits <> 0").drop("mask")


def size(rows: DataFrame, *keys: str) -> DataFrame:
    """keys, units: how many units the bitmaps of a key hold together."""
    return rows.groupBy(*keys, "w").agg(F.bit_or("bits").alias("bits")).groupBy(*keys).agg(F.sum(F.bit_count("bits")).cast("long").alias("units"))
