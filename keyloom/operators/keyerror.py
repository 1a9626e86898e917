"""Key error: how many rows would have to go for a column set to identify the rest.

``key_error = rows - distinct tuples = sum(n - 1)`` over the groups of the combo. Many
combos are counted together, and nothing but (combo, error) leaves a job.

A small table is grouped by grouping sets, which multiply its rows by the combos. A large one is not:

* combos of few possible groups are folded together, so the map side keeps what the shuffle carries small;
* all others share one shuffle per *pivot*, the column of theirs with the most values. Equal tuples then
  lie in one partition, where the combos are grouped without another shuffle;
* rows of a pivot's very frequent values, which no hash spreads, are grouped by grouping sets.

Distinct counts and frequent values are estimates. They choose how a combo is counted, not its error.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from math import ceil, prod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from keyloom.functions import colsets as cs
from keyloom.functions import values as V
from keyloom.operators.combos import combo_frame
from keyloom.staging import spread

# grouping_id() is a BIGINT with one bit per grouped expression.
GROUPING_BITS = 62
BATCH = 32

# Up to this many rows, multiplying them by the combos costs less than the jobs that avoid it.
PIVOT_ABOVE = 200_000

# Possible groups that combos folded together may have.
FOLDED = 150_000

# A pivot needs this many values to spread the rows. They are dealt into parts of about PART_RECORDS rows
# times combos, of which SLICE at most are counted in one loop.
PIVOT_VALUES = 1_000
PART_RECORDS = 500_000
SLICE = 16

# A value is very frequent when this many of a sample's rows have it.
SAMPLE = 100_000
FREQUENT = 400

Combo = tuple[int, ...]


def positions(df: DataFrame, combo: Iterable[int | str]) -> Combo:
    """Sorted positions of a combo given by position or by name."""
    names = df.columns
    return tuple(sorted({names.index(c) if isinstance(c, str) else int(c) for c in combo}))


def plain_fields(df: DataFrame) -> tuple[DataFrame, list[list[str]]]:
    """Rename to ``a0, a1, ...`` and return the fields that make up each column."""
    exprs = [
        V.canonical(F.col(f"`{f.name}`"), f.dataType).alias(f"a{i}")
        for i, f in enumerate(df.schema.fields)
    ]
    return df.select(*exprs), [[f"a{i}"] for i in range(len(exprs))]


def batches(combos: Sequence[Combo], fields: list[list[str]], size: int = BATCH) -> list[list[Combo]]:
    """Cut a list of combos so that each batch groups at most GROUPING_BITS fields."""
    out: list[list[Combo]] = []
    used: set[str] = set()
    for combo in combos:
        own = {f for c in combo for f in fields[c]}
        if not out or len(out[-1]) >= size or len(used | own) > GROUPING_BITS:
            out.append([])
            used = set()
        out[-1].append(combo)
        used |= own
    return out


def _batch_groups(rows: DataFrame, fields: list[list[str]], batch: list[Combo], nulls_equal: bool,
                  weight: str | None = None) -> DataFrame:
    """``combo, n`` for every group of every combo of the batch; a row may stand for ``weight`` rows."""
    n_rows = (F.sum(weight) if weight else F.count(F.lit(1))).alias("n")
    weights = [weight] if weight else []
    used = sorted({c for combo in batch for c in combo})
    names = [f for c in used for f in fields[c]]
    if len(names) > GROUPING_BITS:  # a single very wide combo
        wide = rows if nulls_equal else V.without_nulls(rows, names)
        return wide.groupBy(*names).agg(n_rows).select(
            F.lit(_text(batch[0])).alias("combo"), "n"
        )
    wanted = {}
    for combo in batch:
        inside = {f for c in combo for f in fields[c]}
        gid = sum(1 << (len(names) - 1 - i) for i, f in enumerate(names) if f not in inside)
        wanted[gid] = _text(combo)
    sets = [[F.col(f) for c in combo for f in fields[c]] for combo in batch]
    flags = [] if nulls_equal else [F.grouping(f).alias(f"out_{f}") for f in names]
    grouped = rows.select(*names, *weights).groupingSets(sets, *[F.col(f) for f in names]).agg(
        n_rows, F.grouping_id().alias("gid"), *flags
    )
    for f in [] if nulls_equal else names:
        # a null of the data, not of a column outside the grouping set
        grouped = grouped.where(F.col(f).isNotNull() | (F.col(f"out_{f}") == 1))
    labels = F.create_map(*[x for g, t in wanted.items() for x in (F.lit(g).cast("bigint"), F.lit(t))])
    return grouped.select(labels[F.col("gid").cast("bigint")].alias("combo"), "n")


def _errors_of(groups: DataFrame) -> DataFrame:
    return groups.groupBy("combo").agg(
        F.count_if(F.col("n") > 1).alias("n_clusters"),
        F.sum(F.col("n") - 1).cast("bigint").alias("key_error"),
    )


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _text(combo: Combo) -> str:
    return ",".join(map(str, combo))


@dataclass
class _Sizes:
    """Rows of a table and about how many values each column has; none where they cannot be sorted."""

    n_rows: int
    values: dict[int, int]

    def known(self, combo: Combo) -> bool:
        return all(c in self.values for c in combo)

    def groups(self, combo: Iterable[int]) -> int:
        return prod(self.values[c] + 1 for c in combo)

    def pivot(self, combo: Combo) -> int | None:
        """The column with the most values, if they are enough to spread the rows."""
        best = max(combo, key=lambda c: (self.values[c], -c))
        return best if self.values[best] >= PIVOT_VALUES else None


def _sortable(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.StringType):
        return dtype == T.StringType()  # sorted and hashed by its bytes
    if isinstance(dtype, T.YearMonthIntervalType):
        return False  # not known to Arrow
    return V.is_fixed_width(dtype) or isinstance(dtype, (T.BinaryType, T.DecimalType))


def _sizes(rows: DataFrame, fields: list[list[str]], combos: Sequence[Combo]) -> _Sizes:
    types = {f.name: f.dataType for f in rows.schema.fields}
    used = sorted({c for combo in combos for c in combo})
    used = [c for c in used if all(_sortable(types[f]) for f in fields[c])]
    counts = [F.approx_count_distinct(f).alias(f) for c in used for f in fields[c]]
    found = rows.agg(F.count(F.lit(1)).alias("n_rows"), *counts).first()
    return _Sizes(found.n_rows, {c: max(found[f] for f in fields[c]) for c in used})


def _folds(combos: list[Combo], sizes: _Sizes) -> list[list[Combo]]:
    """Combos whose columns together have few possible groups, side by side."""
    out: list[list[Combo]] = []
    for combo in sorted(combos, key=lambda c: (-sizes.groups(c), c)):
        for fold in out:
            if sizes.groups({c for s in (*fold, combo) for c in s}) <= FOLDED:
                fold.append(combo)
                break
        else:
            out.append([combo])
    return out


def _folded_errors(rows: DataFrame, fields: list[list[str]], fold: list[Combo], nulls_equal: bool,
                   batch: int) -> list[DataFrame]:
    names = [f for c in sorted({c for s in fold for c in s}) for f in fields[c]]
    if len(names) > GROUPING_BITS:
        return [_errors_of(_batch_groups(rows, fields, b, nulls_equal)) for b in batches(fold, fields, batch)]
    few = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("weight"))
    return [_errors_of(_batch_groups(few, fields, b, nulls_equal, "weight")) for b in batches(fold, fields, batch)]


def _pivot_errors(rows: DataFrame, fields: list[list[str]], pivot: int, combos: list[Combo],
                  nulls_equal: bool, sizes: _Sizes) -> DataFrame:
    """Errors of combos that hold the pivot, from one shuffle of the rows by it."""
    own = fields[pivot]
    more = [f for c in sorted({c for s in combos for c in s} - {pivot}) for f in fields[c]]
    rows = rows.select(*own, *more) if nulls_equal else V.without_nulls(rows.select(*own, *more), own)
    parts = max(ceil(sizes.n_rows * len(combos) / PART_RECORDS), rows.sparkSession.sparkContext.defaultParallelism)
    rows = rows.repartition(parts, *own)
    if 2 * sizes.values[pivot] > sizes.n_rows:
        # a row alone under the pivot is alone under every larger set
        together = F.count(F.lit(1)).over(W.partitionBy(*own))
        rows = rows.withColumn("together", together).where("together > 1").drop("together")
    types = {f.name: f.dataType for f in rows.schema.fields}
    records = []
    for combo in combos:
        inside = {f for c in combo for f in fields[c]}
        kept = [(F.col(f) if f in inside else F.lit(None).cast(types[f])).alias(f) for f in more]
        record = F.struct(F.lit(_text(combo)).alias("combo"), *kept)
        for f in [] if nulls_equal else [f for f in more if f in inside]:
            record = F.when(F.col(f).isNotNull(), record)
        records.append(record)
    # Rows of one group are in one partition already: grouping by the pivot, too, needs no other shuffle.
    held = rows.select(*[F.col(f).alias(f"own_{f}") for f in own], F.inline(F.array(*records)))
    held = held if nulls_equal else held.where(F.col("combo").isNotNull())
    groups = held.groupBy(*[f"own_{f}" for f in own], "combo", *more).agg(F.count(F.lit(1)).alias("n"))
    counted = _errors_of(groups)
    # where no row is left, nothing repeats
    none = combo_frame(rows.sparkSession, combos).select(
        "combo", F.lit(0).cast("bigint").alias("n_clusters"), F.lit(0).cast("bigint").alias("key_error"))
    return counted.unionByName(none)


def _frequent(rows: DataFrame, own: list[str], n_rows: int, often: int = FREQUENT) -> DataFrame | None:
    """The values of a pivot that many rows have: at most SAMPLE / often or so."""
    part = rows.select(*own).sample(fraction=min(1.0, SAMPLE / n_rows), seed=SAMPLE)
    found = part.groupBy(*own).count().where(F.col("count") >= often).drop("count")
    listed = found.toArrow()
    return rows.sparkSession.createDataFrame(listed) if listed.num_rows else None


def _pivoted_errors(rows: DataFrame, fields: list[list[str]], pivot: int, combos: list[Combo],
                    nulls_equal: bool, batch: int, sizes: _Sizes) -> list[DataFrame]:
    slices = [combos[i : i + SLICE] for i in range(0, len(combos), SLICE)]
    frequent = _frequent(rows, fields[pivot], sizes.n_rows, FREQUENT)
    if frequent is None:
        return [_pivot_errors(rows, fields, pivot, s, nulls_equal, sizes) for s in slices]
    listed = F.broadcast(frequent.toDF(*[f"hot_{f}" for f in fields[pivot]]))
    hot = F.lit(True)
    for f in fields[pivot]:
        hot = hot & F.col(f).eqNullSafe(F.col(f"hot_{f}"))
    many, others = rows.join(listed, hot, "left_semi"), rows.join(listed, hot, "left_anti")
    return [
        *[_pivot_errors(others, fields, pivot, s, nulls_equal, sizes) for s in slices],
        *[_errors_of(_batch_groups(many, fields, b, nulls_equal)) for b in batches(combos, fields, batch)],
    ]


def _shared_errors(rows: DataFrame, fields: list[list[str]], combos: Sequence[Combo], nulls_equal: bool,
                   batch: int, sizes: _Sizes) -> DataFrame:
    """Errors over a large table, without a copy of its rows for each combo."""
    few, plain, by_pivot = [], [], {}
    for combo in combos:
        if not combo or not sizes.known(combo):
            plain.append(combo)
        elif sizes.groups(combo) <= FOLDED:
            few.append(combo)
        elif (pivot := sizes.pivot(combo)) is None:
            plain.append(combo)
        else:
            by_pivot.setdefault(pivot, []).append(combo)
    parts = [_errors_of(_batch_groups(rows, fields, b, nulls_equal)) for b in batches(plain, fields, batch)]
    for fold in _folds(few, sizes):
        parts += _folded_errors(rows, fields, fold, nulls_equal, batch)
    for pivot, sets in sorted(by_pivot.items()):
        parts += _pivoted_errors(rows, fields, pivot, sets, nulls_equal, batch, sizes)
    # the rows of frequent values are counted apart
    return _all(parts).groupBy("combo").agg(
        F.sum("n_clusters").alias("n_clusters"), F.sum("key_error").alias("key_error")
    )


def count_errors(rows: DataFrame, fields: list[list[str]], combos: Sequence[Combo], nulls_equal: bool = True,
                 batch: int = BATCH) -> DataFrame:
    """``combo, n_clusters, key_error`` for combos of ``rows`` laid out as ``fields``."""
    sizes = _sizes(rows, fields, combos) if len(combos) > 1 else None
    if sizes and sizes.n_rows > PIVOT_ABOVE:
        counted = _shared_errors(rows, fields, combos, nulls_equal, batch, sizes)
    else:
        parts = batches(combos, fields, batch)
        counted = _all([_errors_of(_batch_groups(rows, fields, b, nulls_equal)) for b in parts])
    if not nulls_equal and not rows.isEmpty():
        # a combo that is null in every row has no group left; without rows no combo is counted
        asked = combo_frame(rows.sparkSession, combos).select("combo")
        counted = asked.join(counted, "combo", "left").fillna(0)
    return counted


def key_errors(df: DataFrame, combos: Sequence[Iterable[int | str]], nulls_equal: bool = True,
               batch: int = BATCH, n_rows: int | None = None) -> DataFrame:
    """``combo, cols, mask, size, n_clusters, key_error`` for each combo, exact.

    With ``n_rows`` known, a small table is spread over the cores before its rows are
    multiplied by the combos.
    """
    rows, fields = plain_fields(df)
    if n_rows is not None:
        rows = spread(rows, n_rows)
    wanted = list(dict.fromkeys(positions(df, c) for c in combos))
    counted = count_errors(rows, fields, wanted, nulls_equal, batch)
    return cs.describe(
        counted.withColumn("cols", cs.combo_cols(F.col("combo"))), "n_clusters", "key_error"
    )


def with_verdict(errors: DataFrame, tolerance: int = 0) -> DataFrame:
    """Add ``is_key``: at most ``tolerance`` rows stand in the way."""
    return errors.withColumn("is_key", F.col("key_error") <= tolerance)


def single_columns(df: DataFrame, nulls_equal: bool = True) -> DataFrame:
    """Key error of every single column, with its name."""
    errors = key_errors(df, [(i,) for i in range(len(df.columns))], nulls_equal)
    return errors.withColumn("col_idx", F.col("cols")[0]).withColumn(
        "col_name", F.array(*[F.lit(c) for c in df.columns])[F.col("col_idx")]
    )


def unique_columns(df: DataFrame, tolerance: int = 0, nulls_equal: bool = True) -> DataFrame:
    """Single columns that are keys."""
    return with_verdict(single_columns(df, nulls_equal), tolerance).where("is_key")


def nonkey_columns(df: DataFrame, tolerance: int = 0, nulls_equal: bool = True) -> DataFrame:
    """One row: the set of columns that are not keys by themselves."""
    rest = with_verdict(single_columns(df, nulls_equal), tolerance).where("not is_key")
    return cs.describe(rest.agg(F.sort_array(F.collect_set("col_idx")).alias("cols")))


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows"))


def pigeonhole(distinct: dict[int, int], n_rows: int, tolerance: int) -> Column:
    """Candidates that must be non-keys: fewer possible tuples than rows - tolerance.

    ``distinct`` counts null as a value, so this holds only when nulls are equal. Products
    past 1e15 are not judged, to stay clear of floating-point rounding.
    """
    counts = F.create_map(*[x for c, d in distinct.items() for x in (F.lit(c), F.lit(float(d)))])
    product = F.aggregate("cols", F.lit(1.0), lambda acc, c: acc * counts[c])
    return (product < min(n_rows - tolerance, 10**15))


def equivalent_columns(df: DataFrame, nulls_equal: bool = True) -> DataFrame:
    """Pairs of columns that split the rows into the same clusters.

    Two columns agree exactly when each alone and both together have the same number of
    distinct values, i.e. the same key error. Only pairs whose single errors are equal
    are counted together; the errors themselves are a schema-sized result.
    """
    singles = {r.col_idx: r.key_error for r in single_columns(df, nulls_equal).collect()}
    pairs = [(a, b) for a in singles for b in singles if a < b and singles[a] == singles[b]]
    names = F.array(*[F.lit(c) for c in df.columns])
    if not pairs:
        both = key_errors(df, [(0,)]).limit(0).withColumn("single", F.lit(0).cast("bigint"))
    else:
        single = F.create_map(*[x for c, e in singles.items() for x in (F.lit(c), F.lit(e))])
        both = key_errors(df, pairs, nulls_equal).withColumn("single", single[F.col("cols")[0]])
    return both.where("key_error = single").select(
        F.col("cols")[0].alias("a_idx"),
        F.element_at("cols", -1).alias("b_idx"),
        names[F.col("cols")[0]].alias("a_name"),
        names[F.element_at("cols", -1)].alias("b_name"),
        "key_error",
    )
