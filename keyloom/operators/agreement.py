"""Agree sets of a large table, from one shuffle for many column sets.

Rows that agree on a set agree on each of its columns. So the rows are dealt by one column, the *pivot*,
and all sets that hold it are settled inside the parts, of about ``PART_ROWS`` rows: no record travels
for each row and set. What leaves a part is columns that two of its rows really share, and the rows that
repeat under a failed set if they are few: its supersets are tested on those only.

Sets without a column of enough values, and the rows of a pivot's very frequent values, which no hash
spreads, are left to :func:`keyloom.operators.fingerprint.screen`. Distinct counts and frequent values are
estimates; they choose how a set is tested, not its verdict.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.operators import keyerror as K
from keyloom.plans.encode import Codes
from keyloom.staging import Stage

Combo = tuple[int, ...]

# Up to this many rows a record for each row and set costs less.
DEAL_ABOVE = 200_000
PART_ROWS = 200_000

# A value with more rows than this is very frequent; a sample must show it this often at least.
VALUE_ROWS = 1_000_000
SEEN_OFTEN = 40

# Agree sets kept per set, of each part and in all. More of them mean fewer rounds.
KEPT = 32


@dataclass
class Pivots:
    """What is known of the columns of one staged table."""

    codes: Codes
    sizes: K._Sizes | None = None
    hot: dict[int, DataFrame | None] = field(default_factory=dict)
    # Where failed sets repeat: the rows' table, the set's number in it and how many rows. Rows that agree on a
    # set agree on its subsets, so a superset can only repeat there.
    repeats: dict[Combo, tuple[DataFrame, int, int]] = field(default_factory=dict)

    def test(self, pivot: int, combos: list[Combo], stage: Stage) -> tuple[set[Combo], DataFrame | None]:
        """Agree sets of the sets that repeat, but for the rows of very frequent values, which are returned."""
        rows, frequent = self.split(pivot)
        found = stage.put(dealt(self.codes, rows, pivot, combos), "agreed")
        if frequent is None:
            of_rows = found.where(F.col("kind") > SET).groupBy("b")
            for r in of_rows.agg(F.max("kind").alias("kind"), F.count(F.lit(1)).alias("n")).collect():
                if r.kind == ROW:
                    self.repeats[combos[r.b]] = (found, r.b, r.n)
        return collected(found), frequent

    def narrowed(self, batch: list[Combo]) -> tuple[set[Combo], list[Combo]]:
        """Agree sets of the sets above one whose repeated rows are known, and the other sets."""
        parent = {}
        for combo in batch:
            below = [p for p in self.repeats if set(p) < set(combo)]
            if below:
                parent[combo] = min(below, key=lambda p: (self.repeats[p][2], p))
        if not parent:
            return set(), batch
        asked, rows, n_rows = {}, [], 0
        for p, known in enumerate(sorted(set(parent.values()))):
            table, b, n = self.repeats[known]
            rows.append(table.where((F.col("kind") == ROW) & (F.col("b") == b)).withColumn("p", F.lit(p)))
            asked[p] = [(k, c) for k, c in enumerate(batch) if parent.get(c) == known]
            n_rows += n
        whole = rows[0]
        for more in rows[1:]:
            whole = whole.unionByName(more)
        return collected(among(self.codes, whole, asked, n_rows)), [c for c in batch if c not in parent]

    def frequent(self, column: int) -> DataFrame | None:
        if column not in self.hot:
            n_rows = self.codes.n_rows
            often = max(SEEN_OFTEN, min(K.FREQUENT, VALUE_ROWS * K.SAMPLE // n_rows))
            self.hot[column] = K._frequent(self.codes.rows, self.codes.fields[column], n_rows, often)
        return self.hot[column]

    def deal(self, batch: list[Combo]) -> dict[int | None, list[Combo]]:
        """The sets of a batch by pivot: few pivots, those without very frequent values first."""
        if self.sizes is None:
            singles = [(c,) for c in range(self.codes.width)]
            self.sizes = K._sizes(self.codes.rows, self.codes.fields, singles)
        values = self.sizes.values
        left, out = list(batch), {}
        able = {c for combo in left for c in combo if values.get(c, 0) >= K.PIVOT_VALUES}
        even = {c for c in able if self.frequent(c) is None}
        for columns in (even, able):
            while held := {c: sum(c in combo for combo in left) for c in columns if any(c in combo for combo in left)}:
                pivot = max(held, key=lambda c: (held[c], values[c], -c))
                out.setdefault(pivot, []).extend(combo for combo in left if pivot in combo)
                left = [combo for combo in left if pivot not in combo]
        return {**out, **({None: left} if left else {})}

    def split(self, pivot: int) -> tuple[DataFrame, DataFrame | None]:
        """The rows to deal by a pivot, and those of its very frequent values."""
        rows, own, frequent = self.codes.rows, self.codes.fields[pivot], self.frequent(pivot)
        if frequent is None:
            return rows, None
        listed, hot = F.broadcast(frequent.toDF(*[f"hot_{f}" for f in own])), F.lit(True)
        for f in own:
            hot = hot & F.col(f).eqNullSafe(F.col(f"hot_{f}"))
        return rows.join(listed, hot, "left_anti"), rows.join(listed, hot, "left_semi")


class Part:
    """Rows as arrays: column ``i`` has the fields ``columns[i]`` and, where it has nulls, ``nulls[i]``."""

    def __init__(self, columns: list[list[np.ndarray]], nulls: list[np.ndarray], nulls_equal: bool):
        self.columns, self.nulls, self.nulls_equal = columns, nulls, nulls_equal
        self.hashes = []
        for i, (fields, null) in enumerate(zip(columns, nulls)):
            mixed = null.astype(np.uint64) + np.uint64(2 * i + 3)
            for values in fields:
                mixed = (mixed ^ values.view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                mixed ^= mixed >> np.uint64(29)
                mixed *= np.uint64(0xBF58476D1CE4E5B9)
            self.hashes.append(mixed ^ mixed >> np.uint64(32))

    def same(self, column: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        null = self.nulls[column]
        out = null[i] == null[j] if self.nulls_equal else ~(null[i] | null[j])
        for values in self.columns[column]:
            out &= values[i] == values[j]
        return out

    def without_singles(self, pivot: int) -> "Part":
        """A row alone under the pivot is alone under every larger set."""
        _, group, n = np.unique(self.hashes[pivot], return_inverse=True, return_counts=True)
        kept = n[group] > 1
        return Part([[v[kept] for v in vs] for vs in self.columns], [n[kept] for n in self.nulls], self.nulls_equal)

    def whole(self, combo: Combo, rows: np.ndarray) -> np.ndarray:
        return np.sum([self.hashes[c][rows] for c in combo], axis=0, dtype=np.uint64)

    def _neighbours(self, combo: Combo) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of rows, side by side in the order of the set's hashes, of which these are equal."""
        rows = np.arange(len(self.hashes[0]))
        if not self.nulls_equal:
            rows = rows[~np.any([self.nulls[c] for c in combo], axis=0)]
        whole = self.whole(combo, rows)
        order = np.argsort(whole)
        alike = np.flatnonzero(whole[order[1:]] == whole[order[:-1]])
        return rows[order[alike]], rows[order[alike + 1]]

    def alike(self, combo: Combo) -> np.ndarray:
        """Every row that repeats under the set, and perhaps some whose hashes collide."""
        return np.unique(np.concatenate(self._neighbours(combo)))

    def listed(self, fields: list[list[str]], combo: Combo, rows: np.ndarray) -> dict[str, pa.Array]:
        out = {G: pa.array(self.whole(combo, rows).view(np.int64))}
        for names, columns, null in zip(fields, self.columns, self.nulls):
            out |= {f: pa.array(values[rows], mask=null[rows]) for f, values in zip(names, columns)}
        return out

    def pairs(self, combo: Combo) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of rows that agree on the set: some if there are any."""
        left, right = self._neighbours(combo)
        i, j = self._agreeing(left, right, combo)
        if len(left) and not len(i):  # hashes collide: rows side by side by their values
            few = np.unique(np.concatenate([left, right]))
            keys = [x[few] for c in combo for x in (self.nulls[c], *self.columns[c])]
            few = few[np.lexsort(keys)]
            i, j = self._agreeing(few[:-1], few[1:], combo)
        return i, j

    def _agreeing(self, i: np.ndarray, j: np.ndarray, combo: Combo) -> tuple[np.ndarray, np.ndarray]:
        kept = np.all([self.same(c, i, j) for c in combo], axis=0)
        return i[kept], j[kept]

    def agree_sets(self, combo: Combo) -> list[list[int]]:
        """The largest sets of columns that such pairs share."""
        i, j = self.pairs(combo)
        if not len(i):
            return []
        shared = np.stack([self.same(c, i, j) for c in range(len(self.columns))], axis=1)
        shared = np.unique(shared, axis=0)
        largest = np.argsort(-shared.sum(axis=1), kind="stable")[:KEPT]
        return [np.flatnonzero(s).tolist() for s in shared[largest]]


def _part(table: pa.Table, fields: list[list[str]], nulls_equal: bool) -> Part:
    arrays = {f: table.column(f).combine_chunks() for fs in fields for f in fs}
    nulls = [arrays[fs[0]].is_null().to_numpy(zero_copy_only=False) for fs in fields]
    columns = [[arrays[f].fill_null(0).to_numpy(zero_copy_only=False) for f in fs] for fs in fields]
    return Part(columns, nulls, nulls_equal)


def _records(b: int, kind: int, names: list[str], cols=None, rows=None) -> pa.RecordBatch:
    """Agree sets ``cols``, or ``rows`` as columns by name; neither says that the set repeats too often."""
    n = len(cols) if cols is not None else len(rows[G]) if rows else 1
    columns = [pa.array([b] * n, pa.int32()), pa.array([kind] * n, pa.int32())]
    columns.append(pa.array(cols if cols is not None else [None] * n, pa.list_(pa.int32())))
    columns += [rows[f] if rows else pa.nulls(n, pa.int64()) for f in (G, *names)]
    return pa.record_batch(columns, names=["b", "kind", "cols", G, *names])


G = "g"  # hash of a repeated row's values in the set
SET, ROW, MANY = 0, 1, 2


def _schema(names: list[str]) -> str:
    return "b int, kind int, cols array<int>, " + ", ".join(f"{f} bigint" for f in (G, *names))


def _hashed(rows: DataFrame, names: list[str], *more: str) -> DataFrame:
    # xxhash64 maps one value of at most eight bytes one-to-one; before the shuffle it would spoil compression.
    return rows.select(*more, *[F.when(F.col(f).isNotNull(), F.xxhash64(f)).alias(f) for f in names])


def dealt(codes: Codes, rows: DataFrame, pivot: int, combos: list[Combo]) -> DataFrame:
    """``b, kind, cols, g`` and the codes' hashes, from one shuffle by the pivot: agree sets of ``rows`` for the
    sets that repeat, and the rows that do; of sets that repeat in many rows of a part, only that."""
    names, fields, nulls_equal = [f for fs in codes.fields for f in fs], codes.fields, codes.nulls_equal

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        part = _part(pa.Table.from_batches(held), fields, nulls_equal).without_singles(pivot)
        if not len(part.hashes[pivot]):
            return
        repeated = {}
        for b, combo in enumerate(combos):
            found = part.agree_sets(combo)
            if found:
                yield _records(b, SET, names, cols=found)
                repeated[b] = part.alike(combo)
        room = PART_ROWS // 10
        for b in sorted(repeated, key=lambda b: len(repeated[b])):
            room -= len(repeated[b])
            if room < 0:
                yield _records(b, MANY, names)
            else:
                yield _records(b, ROW, names, rows=part.listed(fields, combos[b], repeated[b]))

    parts = max(ceil(codes.n_rows / PART_ROWS), rows.sparkSession.sparkContext.defaultParallelism)
    spread = rows.select(*names).repartition(parts, *codes.fields[pivot])
    return _hashed(spread, names).mapInArrow(settle, _schema(names))


def among(codes: Codes, rows: DataFrame, combos: dict[int, list[tuple[int, Combo]]], n_rows: int) -> DataFrame:
    """``b, kind, cols``: agree sets of the numbered sets ``combos[p]`` among the ``rows`` of ``p``, dealt by ``g``."""
    names, fields, nulls_equal = [f for fs in codes.fields for f in fs], codes.fields, codes.nulls_equal

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        of = np.asarray(table.column("p"))
        for p in np.unique(of).tolist():
            part = _part(table.filter(pa.array(of == p)), fields, nulls_equal)
            for b, combo in combos[p]:
                found = part.agree_sets(combo)
                if found:
                    yield _records(b, SET, names, cols=found)

    parts = max(ceil(n_rows / PART_ROWS), rows.sparkSession.sparkContext.defaultParallelism)
    return rows.select("p", G, *names).repartition(parts, "p", G).mapInArrow(settle, _schema(names))


def collected(found: DataFrame) -> set[Combo]:
    """At most ``KEPT`` agree sets for each set that repeats, none for the others."""
    found = found.where(F.col("kind") == SET).select("b", "cols").distinct()
    kept = found.groupBy("b", F.pmod(F.hash("cols"), F.lit(KEPT)).alias("bucket")).agg(
        F.max(F.struct(F.size("cols").alias("size"), "cols")).alias("top")
    )
    return {tuple(r.cols) for r in kept.select("top.cols").distinct().collect()}
