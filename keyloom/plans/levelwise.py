"""Level-wise discovery with exact errors for every combo that is counted.

Level k+1 holds the sets whose k-column subsets are all non-keys, so each key found is
minimal by construction. Valid for any tolerance because the error never rises when a
column is added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.functions import colsets as cs
from keyloom.operators import combos as C
from keyloom.operators import keyerror as K
from keyloom.plans.encode import Codes
from keyloom.plans.hitting import single_sets
from keyloom.staging import Stage, spread

# A batch multiplies the rows it reads by its number of combos; the product is kept near
# this many records per core and job, whatever the table's size.
RECORDS_PER_CORE = 50_000_000

# Rows of the sample that rules combos out before the whole table is counted.
SAMPLE = 100_000

VERDICTS = "combo string, cols array<int>, key_error bigint, is_key boolean, how string"


def batch_size(codes: Codes, most: int) -> int:
    cores = codes.rows.sparkSession.sparkContext.defaultParallelism
    return max(1, min(most, RECORDS_PER_CORE * cores // max(codes.n_rows, 1)))


def next_level(nonkeys: DataFrame, width: int) -> DataFrame:
    """Sets one column larger whose every direct subset is among ``nonkeys``."""
    above = F.filter(cs.universe(width), lambda x: x > F.element_at("cols", -1))
    grown = nonkeys.select("cols", F.explode(above).alias("x")).select(
        F.array_append("cols", F.col("x")).alias("cols")
    )
    parts = grown.select(
        cs.combo_text(F.col("cols")).alias("combo"), "cols", F.explode("cols").alias("x")
    ).select("combo", "cols", cs.combo_text(cs.drop(F.col("cols"), F.col("x"))).alias("part"))
    return (
        parts.join(nonkeys.select(F.col("combo").alias("part")), "part", "left_semi")
        .groupBy("combo", "cols")
        .agg(F.count(F.lit(1)).alias("known"))
        .where(F.col("known") == F.size("cols"))
        .select("combo", "cols")
    )


def _verdict_rows(counted: DataFrame, tolerance: int) -> DataFrame:
    return counted.select(
        "combo",
        cs.combo_cols(F.col("combo")).alias("cols"),
        "key_error",
        (F.col("key_error") <= tolerance).alias("is_key"),
        F.lit("counted").alias("how"),
    )


def _ruled_out(level: DataFrame, how: str) -> DataFrame:
    return level.select(
        "combo",
        "cols",
        F.lit(None).cast("bigint").alias("key_error"),
        F.lit(False).alias("is_key"),
        F.lit(how).alias("how"),
    )


def _sample(codes: Codes, stage: Stage, n_rows: int) -> Codes | None:
    if codes.n_rows < 8 * n_rows:
        return None
    part = codes.rows.sample(fraction=n_rows / codes.n_rows, seed=n_rows)
    return codes.over(stage.put(spread(part, n_rows), "sample"), n_rows)


def run(codes: Codes, stage: Stage, tolerance: int = 0, max_size: int | None = None,
        use_bounds: bool = True, exclude: Column | None = None, sample: int = SAMPLE) -> DataFrame:
    """Verdicts (``combo, cols, key_error, is_key, how``) for every set that had to be decided.

    ``how`` is ``counted``, or, for non-keys settled without counting the table (their
    error stays null): ``bound`` when the distinct counts leave too few tuples, ``sample``
    when a part of the rows already has more than ``tolerance`` repeats. Errors only grow
    with rows, so both hold for the whole table; keys are always counted over all rows.
    """
    spark = codes.rows.sparkSession
    at_once = batch_size(codes, K.BATCH)
    out = stage.path("verdicts")
    verdicts = spark.read.schema(VERDICTS)
    level = single_sets(spark, codes.width)
    stage.append(_ruled_out(level.limit(0), "bound"), out)
    part = _sample(codes, stage, sample) if use_bounds else None
    bounds: Column | None = None
    for size in range(1, min(codes.width, max_size or codes.width) + 1):
        if exclude is not None:
            level = cs.describe(level).where(~exclude).select("combo", "cols")
        level = stage.put(level, "level")
        if level.isEmpty():
            break
        if bounds is not None:
            stage.append(_ruled_out(level.where(bounds), "bound"), out)
            level = level.where(~bounds)
        # The driver asks for the sets of one batch at a time: they name the plan that counts them.
        n_batches = -(-level.count() // at_once)
        number = F.pmod(F.xxhash64("combo"), F.lit(max(n_batches, 1)))
        for k in range(n_batches):
            chunk = sorted(tuple(r.cols) for r in level.where(number == k).collect())
            if not chunk:
                continue
            if part is not None and size > 1:
                seen = K.count_errors(part.rows, codes.fields, chunk, codes.nulls_equal, at_once)
                failed = seen.where(F.col("key_error") > tolerance).select("combo")
                failed = {tuple(int(x) for x in r.combo.split(",")) for r in failed.collect()}
                stage.append(_ruled_out(C.combo_frame(spark, failed), "sample"), out)
                chunk = [c for c in chunk if c not in failed]
                if not chunk:
                    continue
            counted = K.count_errors(codes.rows, codes.fields, chunk, codes.nulls_equal, at_once)
            stage.append(_verdict_rows(counted, tolerance), out)
        done = verdicts.parquet(out).where(F.size("cols") == size)
        if size == 1 and use_bounds and codes.nulls_equal:
            # one number per column of the table
            distinct = {r.cols[0]: codes.n_rows - r.key_error for r in done.collect()}
            if distinct:
                bounds = K.pigeonhole(distinct, codes.n_rows, tolerance)
        level = next_level(done.where("not is_key").select("combo", "cols"), codes.width)
    return verdicts.parquet(out)
