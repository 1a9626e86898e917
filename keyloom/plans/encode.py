"""Staging a table as narrow codes.

Discovery reads the same rows many times but only ever asks whether values are equal.
So the table is written once as codes: values of at most eight bytes as they are, wider
ones as two 64-bit hashes. The hash codes of each wide column are then *proved* to be
one-to-one on this table, in one job, so every later count on codes is exact. Texts stay where
they are in that job: up to 31 bytes are compared themselves, longer ones by their SHA-256 digest
(two texts could only pass as one if they broke SHA-256). Each candidate batch reads only the
code columns it needs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyloom.functions import values as V
from keyloom.operators import collations
from keyloom.staging import Stage, spread

SEEDS = (42, 1013)
DIGEST_BYTES = 32  # of SHA-256
ROW_ID = "rid"

# A staged table of at most this many rows is left in the few files it came in.
SPREAD_ABOVE = 5_000


@dataclass
class Codes:
    """A staged table: a row id and, for column ``i``, the code columns ``fields[i]``."""

    rows: DataFrame
    names: list[str]
    fields: list[list[str]]
    n_rows: int
    nulls_equal: bool

    @property
    def width(self) -> int:
        return len(self.names)

    def over(self, rows: DataFrame, n_rows: int) -> "Codes":
        return Codes(rows, self.names, self.fields, n_rows, self.nulls_equal)

    def same(self, column: int, other: dict[str, Column]) -> Column:
        """Whether a row and ``other`` agree on a column."""
        eq = F.lit(True)
        for f in self.fields[column]:
            eq = eq & (F.col(f).eqNullSafe(other[f]) if self.nulls_equal
                       else F.coalesce(F.col(f) == other[f], F.lit(False)))
        return eq


def _codes(col: Column, dtype, i: int, shift: int) -> list[Column]:
    if V.is_fixed_width(dtype):
        return [V.canonical(col, dtype).alias(f"a{i}")]
    return [
        F.when(col.isNotNull(), V.seeded_hash(col, dtype, seed + shift)).alias(f"{tag}{i}")
        for tag, seed in zip("ab", SEEDS)
    ]


def _proof(value: Column) -> Column:
    """At most 32 bytes that stand for a string or binary value: itself if it has less, else its digest."""
    plain = value.cast("binary")
    return F.when(F.octet_length(plain) < DIGEST_BYTES, plain).otherwise(F.unhex(F.sha2(plain, 8 * DIGEST_BYTES)))


def _code_proofs(df: DataFrame, coded: dict[int, list[Column]]) -> DataFrame:
    """``col_idx, a, b``: one row for each code of a hashed column and each value behind it.

    One scan for all string and binary columns together, and no whole text in the shuffle. Equal values
    fold map-side, so a frequent value travels once per split.
    """
    types = [f.dataType for f in df.schema.fields]
    value = {i: F.col(f"`{df.columns[i]}`") for i in coded}
    text = [i for i in coded if isinstance(types[i], (T.StringType, T.BinaryType))]

    def distinct_codes(rows: DataFrame) -> DataFrame:
        # grouping, unlike distinct(), also takes maps
        return rows.groupBy("col_idx", "a", "b", "v").count().select("col_idx", "a", "b")

    def record(i: int, v: Column) -> list[Column]:
        return [F.lit(i).alias("col_idx"), coded[i][0].alias("a"), coded[i][1].alias("b"), v.alias("v")]

    parts = []
    if text:
        records = F.array(*[F.struct(*record(i, _proof(value[i]))) for i in text])
        parts.append(distinct_codes(df.select(F.inline(records))))
    for i in sorted(set(coded) - set(text)):
        parts.append(distinct_codes(df.select(*record(i, value[i]))))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return found


def _collides(df: DataFrame, coded: dict[int, list[Column]]) -> bool:
    """Whether some code of a hashed column stands for two values."""
    return not _code_proofs(df, coded).groupBy("col_idx", "a", "b").count().where("count > 1").isEmpty()


def encode(df: DataFrame, stage: Stage, nulls_equal: bool = True) -> Codes:
    """Write ``df`` as codes. The source is read once to prove the codes of its wide columns
    and once to write; the rows are counted while they are written. Collated strings become plain
    ones first."""
    df = collations.plain(df, stage)
    types = [f.dataType for f in df.schema.fields]
    hashed = [i for i, t in enumerate(types) if not V.is_fixed_width(t)]
    for shift in range(3):
        coded = [_codes(F.col(f"`{c}`"), t, i, shift) for i, (c, t) in enumerate(zip(df.columns, types))]
        if not hashed or not _collides(df, {i: coded[i] for i in hashed}):
            break
    else:
        raise RuntimeError("no collision-free codes found; check for values Spark cannot compare")
    # the ids are generated once, in the job that writes the table
    rid = F.monotonically_increasing_id().alias(ROW_ID)
    columns = df.select(rid, *[e for col in coded for e in col])
    rows, n_rows = stage.put_counted(columns, "codes", F.lit(True))
    if SPREAD_ABOVE < n_rows and len(rows.inputFiles()) < rows.sparkSession.sparkContext.defaultParallelism:
        even = spread(rows, n_rows)
        rows = rows if even is rows else stage.put(even, "codes")
    fields = [[f"a{i}", f"b{i}"] if i in hashed else [f"a{i}"] for i in range(len(df.columns))]
    return Codes(rows, df.columns, fields, n_rows, nulls_equal)
