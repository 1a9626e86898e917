"""Result rendering and the text sink."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The text of a result line and of the line for an empty result.
COMBO_LINE = "ColumnCombinationBitset {%s}"
EMPTY_LINE = "No unique column combinations found!"


def key_report(keys: DataFrame) -> DataFrame:
    """``combo, line, names``: one printable line per key, or the message when there is none."""
    lines = keys.select(
        "combo",
        F.format_string(COMBO_LINE, F.array_join(F.col("cols").cast("array<string>"), ", ")).alias("line"),
        F.array_join("names", ", ").alias("names"),
    )
    spark = keys.sparkSession
    any_key = lines.limit(1).select(F.lit(0).cast("bigint").alias("id"))
    message = spark.range(1).join(any_key, "id", "left_anti").select(
        F.lit("").alias("combo"), F.lit(EMPTY_LINE).alias("line"), F.lit("").alias("names")
    )
    return lines.unionByName(message)


def save_report(keys: DataFrame, path: str) -> None:
    """Write the report as text files, in the canonical order of the column sets across files.

    The sort is by ranges, so a large result is written by many tasks.
    """
    positions = F.transform(F.split("combo", ","), lambda x: x.try_cast("int"))
    report = key_report(keys).withColumn("positions", positions)
    report.orderBy(F.size("positions"), "positions").select("line").write.text(path)
