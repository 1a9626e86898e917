"""A bitmap of fixed size, of hashes of keys, that tells which rows of a large table may have one of
them. Only those need travel to a join by key; where the bitmap is full, more rows do, never fewer.

Spark moves a left semi or anti join below the join with the bitmap, which would then spare nothing.
So the joins here are an inner join and an outer one with distinct keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.staging import Stage

FILTER_BUCKETS = 1024  # of 32768 bits: 4 MB
OWN = ["_spot", "_bucket", "_bits"]


def marked(rows: DataFrame, key: Column, keys: DataFrame) -> DataFrame:
    """``rows`` and ``_maybe``: false only where ``key`` is null or not in the one column of ``keys``."""
    spot = lambda c: F.pmod(F.xxhash64(c), F.lit(32768 * FILTER_BUCKETS)) + 1
    known = F.col(keys.columns[0])
    bits = keys.where(known.isNotNull()).select(spot(known).alias("x"))
    bits = bits.groupBy(F.bitmap_bucket_number("x").alias("_bucket"))
    bits = F.broadcast(bits.agg(F.bitmap_construct_agg(F.bitmap_bit_position("x")).alias("_bits")))
    rows = rows.withColumn("_spot", F.when(key.isNotNull(), spot(key)))
    rows = rows.withColumn("_bucket", F.bitmap_bucket_number("_spot"))
    byte = F.expr("CAST(conv(hex(substring(_bits, CAST(bitmap_bit_position(_spot) DIV 8 AS INT) + 1, 1)), 16, 10) AS INT)")
    found = F.expr("CAST(pow(2, bitmap_bit_position(_spot) % 8) AS INT)").bitwiseAND(byte) > 0
    return rows.join(bits, "_bucket", "left").withColumn("_maybe", F.coalesce(found, F.lit(False))).drop(*OWN)


def having(rows: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """The rows whose ``key`` is in the one column of ``keys``."""
    some = marked(rows, F.col(key), keys).where("_maybe").drop("_maybe")
    return some.join(keys.distinct().toDF(key), key).select(*rows.columns)


def lacking(rows: DataFrame, key: Column, keys: DataFrame) -> DataFrame:
    """The rows whose ``key`` is null or not in the one column of ``keys``. Rows are read twice; only those
    that may have a key are shuffled. Column names do not matter: rows are taken as a struct."""
    keys = Stage(rows.sparkSession).put(keys.distinct(), "keys")
    whole = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), key.alias("_key"))
    split = marked(whole, F.col("_key"), keys)
    gone = keys.toDF("_gone")
    asked = split.where("_maybe").join(gone, F.col("_key") == F.col("_gone"), "left").where("_gone IS NULL")
    return split.where("NOT _maybe").select("row.*").unionAll(asked.select("row.*"))
