"""Collated strings as plain ones.

Under a collation different bytes can be equal values ('a' and 'A'), while hashes and texts go by
the bytes. So every value that is written in several ways is replaced by one of them, found by
grouping, which follows the collation; afterwards bytes decide. Tables without a collated column
are left as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyloom.functions import values as V
from keyloom.staging import Stage


def is_collated(dtype: T.DataType) -> bool:
    """Whether the type is or holds a string that is not compared by its bytes."""
    if isinstance(dtype, T.StringType):
        return dtype.collation != "UTF8_BINARY"
    if isinstance(dtype, T.ArrayType):
        return is_collated(dtype.elementType)
    if isinstance(dtype, T.MapType):
        return is_collated(dtype.keyType) or is_collated(dtype.valueType)
    if isinstance(dtype, T.StructType):
        return any(is_collated(f.dataType) for f in dtype.fields)
    return False


def _plain_type(dtype: T.DataType) -> T.DataType:
    if isinstance(dtype, T.StringType):
        return T.StringType()
    if isinstance(dtype, T.ArrayType):
        return T.ArrayType(_plain_type(dtype.elementType), dtype.containsNull)
    if isinstance(dtype, T.MapType):
        return T.MapType(_plain_type(dtype.keyType), _plain_type(dtype.valueType), dtype.valueContainsNull)
    if isinstance(dtype, T.StructType):
        return T.StructType([T.StructField(f.name, _plain_type(f.dataType), f.nullable) for f in dtype.fields])
    return dtype


def _comparable(col: Column, dtype: T.DataType) -> Column:
    """A form that joins accept: maps, at any depth, as their entries in order of the keys."""
    if isinstance(dtype, T.MapType):
        entries = F.transform(
            F.map_entries(V.canonical(col, dtype)),
            lambda e: F.struct(_comparable(e["key"], dtype.keyType), _comparable(e["value"], dtype.valueType)),
        )
        return entries
    if isinstance(dtype, T.ArrayType):
        return F.transform(col, lambda x: _comparable(x, dtype.elementType))
    if isinstance(dtype, T.StructType):
        return F.when(col.isNotNull(), F.struct(*[_comparable(col[f.name], f.dataType) for f in dtype.fields]))
    return V.canonical(col, dtype)


def plain(df: DataFrame, stage: Stage | None = None) -> DataFrame:
    """``df`` with plain strings that are equal just where the collated ones were.

    Only strings written in several ways are looked up; nested values all are. The looked-up ones are
    written first, so every job that reads the frame sees the same choice. Nulls stay.
    """
    names, types = df.columns, [f.dataType for f in df.schema.fields]
    chosen = [i for i, t in enumerate(types) if is_collated(t)]
    if not chosen:
        return df
    stage = stage or Stage(df.sparkSession)
    source = df.toDF(*[f"c{i}" for i in range(len(names))])
    out = source
    for i in chosen:
        col, to = F.col(f"c{i}"), _plain_type(types[i])
        key = _comparable(col, types[i])
        groups = source.where(col.isNotNull()).groupBy(key.alias(f"k{i}"))
        if isinstance(types[i], T.StringType):
            found = groups.agg(F.min(col.cast(to)).alias(f"v{i}"), F.max(col.cast(to)).alias("other"))
            found = found.where(F.col("other") != F.col(f"v{i}")).drop("other")
        else:
            found = groups.agg(F.first(col.cast(to)).alias(f"v{i}"))
        found = stage.put(found, "collated")
        out = out.join(found, key == F.col(f"k{i}"), "left").withColumn(f"c{i}", F.coalesce(f"v{i}", col.cast(to)))
    return out.select(*[f"c{i}" for i in range(len(names))]).toDF(*names)
