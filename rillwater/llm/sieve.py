"""Rows that may have one of a set of keys, told by a bitmap before anything is shuffled.

The keys' hashes set bits of a bitmap of bounded size; rows whose bit is not set have none of the keys. The others,
nearly all of them rows that do, are few where the keys are few, and an exact join follows. With so many keys
that the bitmap fills up all rows pass: the result of that join is the same, only its shuffle larger.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillwater.llm.tables import written

ROW_BITS = 32768  # of one bitmap, as Spark's bitmap functions cut them
MOST_ROWS = 8192  # bitmaps of 4 KB: 32 MB at most are sent to every executor
BITS_PER_KEY = 32


def _place(key: Column, bitmaps: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(97)), F.lit(bitmaps * ROW_BITS))


def split(rows: DataFrame, key: str, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that have none of the keys, rows that may have one); ``key`` names a column of both. A null is a key like others."""
    keys = written(keys.select(key).distinct(), "keys")
    wanted = max(1, keys.count() * BITS_PER_KEY // ROW_BITS)
    bitmaps = 1 << min(wanted, MOST_ROWS).bit_length()
    bitmaps = min(bitmaps, MOST_ROWS)
    place = _place(F.col(key), bitmaps)
    maps = keys.select(F.floor(place / ROW_BITS).cast("int").alias("__row"), F.pmod(place, F.lit(ROW_BITS)).alias("__bit"))
    maps = written(maps.groupBy("__row").agg(F.bitmap_construct_agg("__bit").alias("__map")), "bitmaps")
    marked = rows.withColumn("__place", place).withColumn("__row", F.floor(F.col("__place") / ROW_BITS).cast("int"))
    marked = marked.join(F.broadcast(maps), "__row", "left")  # MOST_ROWS rows at most
    bit = F.pmod(F.col("__place"), F.lit(ROW_BITS))
    byte = F.conv(F.hex(F.substring("__map", (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    there = F.coalesce((byte.bitwiseAND(F.lit(255)) / F.pow(F.lit(2), bit % 8)).cast("int") % 2 == 1, F.lit(False))
    marked = marked.withColumn("__there", there)
    return tuple(marked.where(F.col("__there") == found).select(*[F.col(f"`{c}`") for c in rows.columns]) for found in (False, True))


def semi(rows: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """The rows that have one of the keys; only these and the few that share a bit with them are shuffled."""
    return split(rows, key, keys)[1].join(keys.select(key).distinct(), key, "left_semi").select(*[F.col(f"`{c}`") for c in rows.columns])


def anti(rows: DataFrame, key: str, keys: DataFrame, all_keys: DataFrame) -> DataFrame:
    """The rows that have none of the keys.

    ``all_keys`` has the key of every row and little else: there it is found which rows only share
    a bit with one of the keys. Rows that do have one are never shuffled, so many of them cost no more than few.
    """
    without, maybe = split(rows, key, keys)
    spared = split(all_keys.select(key), key, keys)[1].join(keys.select(key).distinct(), key, "left_anti")
    return without.unionByName(semi(maybe, key, written(spared.distinct(), "spared")))


def text_key(*parts: Column) -> Column:
    """One text for several columns; nulls differ from all values."""
    return F.concat_ws("|", *[F.coalesce(F.concat(F.lit("="), F.replace(p.cast("string"), F.lit("|"), F.lit("||"))), F.lit("-")) for p in parts])
