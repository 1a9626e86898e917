"""Table preparation: text form, trimming and row ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from keyloom.functions import values as V
from keyloom.staging import Stage


def trim_cells(df: DataFrame) -> DataFrame:
    """Strip leading and trailing characters up to U+0020 from every string column."""
    return df.select(
        *[
            V.trimmed(F.col(f"`{f.name}`")).alias(f.name)
            if isinstance(f.dataType, T.StringType)
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def as_text(df: DataFrame) -> DataFrame:
    """Every column as trimmed text, so that values compare the way a text file's would."""
    return df.select(
        *[V.trimmed(V.as_text(F.col(f"`{f.name}`"), f.dataType)).alias(f.name) for f in df.schema.fields]
    )


def with_row_id(df: DataFrame, name: str = "row_id", dense: bool = False, stage: Stage | None = None) -> DataFrame:
    """Add a unique BIGINT row id and write the table once, so the ids never change.

    Generated ids depend on how the rows are split and would differ if a lost partition
    were computed again. ``dense`` numbers the rows 0, 1, 2, ... in input order: the rows
    of each split are numbered by position, shifted by the size of the splits before it.
    """
    stage = stage or Stage(df.sparkSession)
    if not dense:
        return stage.put(df.withColumn(name, F.monotonically_increasing_id()), "rows")
    staged = stage.put(
        df.withColumn("_id", F.monotonically_increasing_id()).withColumn(
            "_split", F.call_function("shiftright", F.col("_id"), F.lit(33))
        ),
        "rows",
    )
    # one row per input split: its size and the rows before it
    sizes = staged.groupBy("_split").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select(
        "_split", (F.sum("_n").over(W.orderBy("_split")) - F.col("_n")).alias("_before")
    )
    within = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return staged.join(before, "_split").select(*df.columns, (F.col("_before") + within).alias(name))
