"""Embedding whitening by a bit-sliced scatter.

Every entry c becomes the integer ``floor(64 * c)`` (plus a constant that no covariance sees). The
fit list is each distinct vector once. Its scatter is counted, not multiplied: in blocks of rows,
each dimension less its smallest value there is cut into bit planes, 64 rows to a word, and

    sum over rows of x_i * x_j = sum over planes p, q of 2^(p + q) * popcount(plane_ip AND plane_jq)

which is exact. Blocks are summed in whole numbers of any size, so that ``n * scatter - S * S^T``,
the centred scatter, is exact before its first rounding, the division by n^2. Only then comes
``eigh``. What travels to the driver is one matrix of the vectors' width, whatever the number of
rows; tasks hold one block of ``BLOCK`` rows.

Defined results: rows with a null vector, a null or non-finite entry, or fewer entries than the
widest whole vector are left out; rows that share an id or a vector are rows of their own, and an
entry that does not fit a long takes the nearest one. A deviation that does not fit a long is null.
A component without variance (up to rounding) has no whitened value (null) and explains 0; with one
distinct vector, explained is null, too. Without whole vectors the result is empty; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.staging import Stage

SCALE = 64
ORIGIN = 1_000_000  # of the contract's long; the scatter is about it
COMPONENTS = 16
BLOCK = 8192  # rows whose planes are counted together
LIMIT = 2**62
RESULT = "component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def numbers(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(kept, z): rows of ``column`` that are whole, and their integers less ORIGIN."""
    sizes = np.asarray(column.value_lengths().fill_null(-1))
    kept = np.flatnonzero(sizes == width)
    column = column.take(pa.array(kept))
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64)
    values = flat.reshape(len(kept), width)  # a null entry reads as NaN
    whole = np.isfinite(values).all(axis=1)
    scaled = np.floor(values[whole] * SCALE)
    return kept[whole], np.clip(scaled, -float(LIMIT), float(LIMIT)).astype(np.int64)


def packed(z: np.ndarray) -> list[bytes]:
    """Each row in the fewest bytes an entry that hold it: equal rows are equal bytes."""
    out: list[bytes] = [b""] * len(z)
    most = np.maximum(z.max(axis=1), -z.min(axis=1) - 1) if z.size else np.zeros(len(z), np.int64)
    todo = np.ones(len(z), bool)
    for kind in ("<i1", "<i2", "<i4", "<i8"):
        fit = todo & (most <= np.iinfo(kind).max)
        todo &= ~fit
        for k, row in zip(np.flatnonzero(fit).tolist(), z[fit].astype(kind)):
            out[k] = row.tobytes()
    return out


def unpacked(rows: list[bytes], width: int) -> np.ndarray:
    z = np.empty((len(rows), width), np.int64)
    sizes = np.array([len(r) // width for r in rows])
    for size in np.unique(sizes).tolist():
        here = np.flatnonzero(sizes == size)
        joined = b"".join(rows[k] for k in here.tolist())
        z[here] = np.frombuffer(joined, f"<i{size}").reshape(len(here), width)
    return z


def scatter(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact sums (width) and sums of products (width x width) of some rows, as Python integers."""
    n, width = z.shape
    low = z.min(axis=0)
    y = (z - low).astype(np.uint64)
    n_bits = int(y.max()).bit_length()
    words = -(-n // 64)
    planes = np.zeros((n_bits, width, words), np.uint64)
    padded = np.zeros((width, words * 64), np.uint8)
    for p in range(n_bits):
        padded[:, :n] = ((y >> np.uint64(p)) & np.uint64(1)).T
        planes[p] = np.packbits(padded, axis=1, bitorder="little").view(np.uint64)
    sums, products = np.zeros(width, object), np.zeros((width, width), object)
    for p in range(n_bits):
        sums += np.bitwise_count(planes[p]).sum(axis=1, dtype=np.int64).astype(object) << p
        for q in range(p + 1):
            both = np.empty((width, width), np.int64)
            for i in range(width):
                both[i] = np.bitwise_count(planes[p, i] & planes[q]).sum(axis=1, dtype=np.int64)
            counted = both.astype(object) << (p + q)
            products += counted if p == q else counted + counted.T
    low = low.astype(object)
    # y = z - low: back to z.
    products += np.outer(low, sums) + np.outer(sums, low) + n * np.outer(low, low)
    return sums + n * low, products


def _wide(values) -> bytes:
    return b"".join(int(v).to_bytes(24, "little", signed=True) for v in values)


def _narrow(data: bytes) -> np.ndarray:
    cut = range(0, len(data), 24)
    return np.array([int.from_bytes(data[k : k + 24], "little", signed=True) for k in cut], object)


@dataclass
class Whitening:
    """A fitted whitening: ``n`` distinct vectors, their sums, and the components by falling variance."""

    n: int
    sums: np.ndarray  # Python integers
    variances: np.ndarray
    axes: np.ndarray  # width x components, unit columns
    trace: float

    @property
    def factors(self) -> np.ndarray:
        """Columns that project and scale; NaN where a component has no variance."""
        floor = self.variances.max(initial=0) * len(self.sums) * np.finfo(float).eps
        solid = np.where(self.variances > floor, self.variances, np.nan)
        return self.axes / np.sqrt(solid)

    def centred(self, z: np.ndarray) -> np.ndarray:
        """n * z - sums, exactly: int64, or Python integers where those do not fit."""
        most = int(np.abs(z).max(initial=0)) * self.n + max(abs(int(s)) for s in self.sums)
        if most < LIMIT:
            return z * self.n - self.sums.astype(np.int64)
        return z.astype(object) * self.n - self.sums

    def apply(self, z: np.ndarray) -> tuple[np.ndarray, list[int | None]]:
        """(whitened rows, deviations)."""
        far = self.centred(z)
        rough = (far.astype(float) ** 2).sum(axis=1)
        if far.dtype == object or rough.max(initial=0) > LIMIT:
            exact = (far.astype(object) ** 2).sum(axis=1).tolist()
            deviations = [d if d < 2**63 else None for d in exact]
        else:
            deviations = (far * far).sum(axis=1).tolist()
        return (far.astype(float) / self.n) @ self.factors, deviations


def vectors(rows: DataFrame, column: str = "embedding") -> tuple[DataFrame, int]:
    """The rows' ids and vectors (vec_id, vector), and the width of the widest whole vector."""
    vector = F.col(column).cast("array<double>").alias("vector")
    found = rows.select("vec_id", vector)
    whole = F.forall("vector", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return found, found.where(whole).agg(F.max(F.size("vector"))).first()[0] or 0


def fit_list(found: DataFrame, width: int, stage: Stage) -> DataFrame:
    """x: each distinct whole vector once, packed."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, z = numbers(batch.column(0), width)
            yield pa.record_batch([pa.array(packed(z), pa.binary())], names=["x"])

    # Copies fold before they travel.
    return stage.put(found.select("vector").mapInArrow(pack, "x binary").distinct(), "fit")


def fit(fitted: DataFrame, width: int, components: int = COMPONENTS) -> Whitening | None:
    """Components of a fit list; None for an empty one."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, products = 0, np.zeros(width, object), np.zeros((width, width), object)
        for batch in batches:
            for k in range(0, batch.num_rows, BLOCK):
                z = unpacked(batch.column(0).slice(k, BLOCK).to_pylist(), width)
                s, c = scatter(z)
                n, sums, products = n + len(z), sums + s, products + c
        if n:
            lines = [_wide([n, sums[i], *products[i]]) for i in range(width)]
            yield pa.record_batch(
                [pa.array(range(width), pa.int32()), pa.array(lines, pa.binary())], names=["i", "line"]
            )

    def add(group: pa.Table) -> pa.Table:
        total = sum(_narrow(line) for line in group.column("line").to_pylist())
        return pa.table({"i": group.column("i").slice(0, 1), "line": pa.array([_wide(total)], pa.binary())})

    schema = "i int, line binary"
    lines = fitted.mapInArrow(count, schema).groupBy("i").applyInArrow(add, schema).collect()
    if not lines:
        return None
    table = np.stack([_narrow(r.line) for r in sorted(lines)])  # n, sum, products: one line a dimension
    n, sums, products = int(table[0, 0]), table[:, 1], table[:, 2:]
    centred = n * products - np.outer(sums, sums)
    covariance = (centred / (n * n)).astype(float)
    values, axes = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[:components]
    return Whitening(n, sums, np.maximum(values[order], 0), axes[:, order], float(np.trace(covariance)))


def identity_error(fitted: DataFrame, width: int, whitening: Whitening) -> float | None:
    """Largest entry of the whitened fit list's covariance less the identity."""
    k = np.flatnonzero(~np.isnan(whitening.factors).any(axis=0))
    if not len(k):
        return None

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(k) + 1, len(k)))  # sums, then products
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                z = unpacked(batch.column(0).slice(at, BLOCK).to_pylist(), width)
                w = whitening.apply(z)[0][:, k]
                total += np.concatenate([w.sum(axis=0)[None], w.T @ w])
        places = np.arange(total.size, dtype=np.int32)
        yield pa.record_batch([pa.array(places), pa.array(total.ravel())], names=["place", "v"])

    found = fitted.mapInArrow(measure, "place int, v double").groupBy("place").agg(F.sum("v").alias("v"))
    total = np.array([r.v for r in found.orderBy("place").collect()]).reshape(len(k) + 1, len(k))
    mean, products = total[0] / whitening.n, total[1:] / whitening.n
    return float(np.abs(products - np.outer(mean, mean) - np.eye(len(k))).max())


def whitened(rows: DataFrame, components: int = COMPONENTS, column: str = "embedding") -> DataFrame:
    """One row per whole vector and component: vec_id, component, n, deviation, whitened, explained,
    identity_error."""
    spark = rows.sparkSession
    found, width = vectors(rows, column)
    schema = f"vec_id {found.schema['vec_id'].dataType.simpleString()}, {RESULT}"
    fitted = fit_list(found, width, Stage(spark)) if width else None
    model = fit(fitted, width, components) if width else None
    if model is None:
        return spark.createDataFrame([], schema)
    error = identity_error(fitted, width, model)
    solid = ~np.isnan(model.factors).any(axis=0)
    explained = [float(e) / model.trace if ok else 0.0 for e, ok in zip(model.variances, solid)]
    explained = pa.array(explained if model.trace > 0 else [None] * len(solid), pa.float64())
    each = len(solid)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                kept, z = numbers(part.column(1), width)
                if not len(kept):
                    continue
                values, deviations = model.apply(z)
                n = len(kept) * each
                copies = np.repeat(np.arange(len(kept)), each)
                components_of = np.tile(np.arange(each), len(kept))
                yield pa.record_batch(
                    [
                        part.column(0).take(pa.array(kept[copies])),
                        pa.array((components_of + 1).astype(np.int32)),
                        pa.array(np.full(n, model.n)),
                        pa.array(deviations, pa.int64()).take(pa.array(copies)),
                        pa.array(values.ravel(), pa.float64(), from_pandas=True),
                        explained.take(pa.array(components_of)),
                        pa.array([error] * n, pa.float64()),
                    ],
                    names=["vec_id", *[f.split()[0] for f in RESULT.split(", ")]],
                )

    return found.mapInArrow(project, schema)
