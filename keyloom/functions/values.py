"""Value expressions: text rendering, trimming and hashing that follow grouping equality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: the characters a whitespace trim removes, U+0000 to U+0020.
BLANKS = "".join(chr(i) for i in range(0x21))

_FIXED_WIDTH = (
    T.BooleanType,
    T.ByteType,
    T.ShortType,
    T.IntegerType,
    T.LongType,
    T.FloatType,
    T.DoubleType,
    T.DateType,
    T.TimestampType,
    T.TimestampNTZType,
    T.DayTimeIntervalType,
    T.YearMonthIntervalType,
)


def is_fixed_width(dtype: T.DataType) -> bool:
    """Types whose value fits eight bytes and can serve as its own code."""
    if isinstance(dtype, T.DecimalType):
        return dtype.precision <= 18
    return isinstance(dtype, _FIXED_WIDTH)


def canonical(col: Column, dtype: T.DataType) -> Column:
    """One form of equal values, at any depth: -0.0 becomes 0.0 and a map's entries are sorted, so that
    text and codes agree with grouping equality."""
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return (col + F.lit(0.0)).cast(dtype)
    if isinstance(dtype, T.ArrayType):
        return F.transform(col, lambda x: canonical(x, dtype.elementType))
    if isinstance(dtype, T.StructType):
        parts = [canonical(col[f.name], f.dataType).alias(f.name) for f in dtype.fields]
        return F.when(col.isNotNull(), F.struct(*parts))
    if isinstance(dtype, T.MapType):
        entries = F.transform(
            F.map_keys(col),
            lambda k: F.struct(
                canonical(k, dtype.keyType).alias("key"), canonical(F.element_at(col, k), dtype.valueType).alias("value")
            ),
        )
        # Keys differ, so the order never asks for values, which may have none.
        by_key = lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)
        return F.map_from_entries(F.array_sort(entries, by_key))
    return col


def trimmed(col: Column) -> Column:
    return F.btrim(col, F.lit(BLANKS))


def as_text(col: Column, dtype: T.DataType) -> Column:
    """One text per distinct value: cells need a single type."""
    if isinstance(dtype, T.BinaryType):
        return F.hex(col)
    if isinstance(dtype, (T.ArrayType, T.StructType, T.MapType)):
        return F.to_json(canonical(col, dtype))
    return canonical(col, dtype).cast("string")


def seeded_hash(col: Column, dtype: T.DataType, seed: int) -> Column:
    """64-bit hash that never skips a null inside a nested value.

    ``xxhash64`` passes over nulls, so ``[1, null]`` and ``[null, 1]`` would hash
    alike. Each nested element is hashed to a non-null BIGINT first.
    """
    head = F.lit(seed)
    if isinstance(dtype, T.ArrayType):
        items = F.transform(col, lambda x: seeded_hash(x, dtype.elementType, seed))
        return F.xxhash64(head, F.size(col), items)
    if isinstance(dtype, T.StructType):
        parts = [seeded_hash(col[f.name], f.dataType, seed) for f in dtype.fields]
        return F.xxhash64(head, col.isNull(), *parts)
    if isinstance(dtype, T.MapType):
        pairs = F.transform(
            F.array_sort(F.map_keys(col)),
            lambda k: F.xxhash64(
                head,
                seeded_hash(k, dtype.keyType, seed),
                seeded_hash(F.element_at(col, k), dtype.valueType, seed),
            ),
        )
        return F.xxhash64(head, F.size(col), pairs)
    return F.xxhash64(head, canonical(col, dtype))


def without_nulls(df: DataFrame, names: list[str]) -> DataFrame:
    """Rows without a null in the named columns; NaN is a value and stays."""
    for name in names:
        df = df.where(F.col(f"`{name}`").isNotNull())
    return df
