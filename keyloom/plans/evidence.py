"""Evidence-driven discovery of keys, exact or with a tolerance.

1. Start from what is known to fail (at first only the empty set).
2. The candidates are the minimal sets that leave every known non-key.
3. Test a batch of candidates. One that repeats is answered with agree sets: columns that
   two rows really share. They are new known non-keys, usually far larger than the
   candidate, and change the candidates of step 2.
4. Stop when every candidate has been tested over all rows without repeating. Those are
   the minimal keys, and the largest agree sets are the maximal non-keys.

The loop first runs on a sample of the rows, then on larger ones, at last on the whole
table. A sample can only refute: two rows that agree in it agree in the table. Every
reported key has been counted over all rows, so the result does not depend on the
sample; it only decides how many candidates ever reach the full table.

With a tolerance, a candidate fails when its key error is larger, also in a sample, because
errors only grow with rows. No two rows are evidence then; instead a failed set is grown:
columns are added along a chain of supersets, counted together, as long as the error stays
too large. What it ends in is a largest failing set of that rung and takes the place of an
agree set. Candidates, non-keys and passed sets are rows of staged tables in either case; the
driver sees one batch at a time.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.functions import colsets as cs
from keyloom.operators import agreement as A
from keyloom.operators import combos as C
from keyloom.operators import fingerprint as P
from keyloom.operators import keyerror as K
from keyloom.plans import hitting
from keyloom.plans.encode import Codes
from keyloom.plans.levelwise import batch_size
from keyloom.staging import Stage, spread

FIRST_SAMPLE = 10_000
SAMPLE_STEP = 8
BATCH = 64
DEALT = 512  # candidates of a batch that share their shuffles
GROWN = 6  # failed sets that are grown together


@dataclass
class Found:
    keys: DataFrame  # combo, cols, key_error
    nonkeys: DataFrame  # combo, cols
    tested: dict[str, int]  # candidates tested per rung
    rounds: int


def _rungs(codes: Codes, stage: Stage, first_sample: int) -> list[tuple[str, Codes]]:
    """Growing samples of the staged table, then all of it.

    Each sample is drawn from the next larger one, so the table is read once for them all.
    """
    sizes = []
    size = first_sample
    while size * SAMPLE_STEP // 2 <= codes.n_rows:
        sizes.append(size)
        size *= SAMPLE_STEP
    larger, samples = codes, []
    for size in reversed(sizes):
        part = larger.rows.sample(fraction=size / larger.n_rows, seed=size)
        larger = codes.over(stage.put(spread(part, size), "sample"), size)
        samples.insert(0, larger)
    samples = samples or [codes]
    return [(f"sample {i + 1}", s) for i, s in enumerate(samples)] + [("table", codes)]


class _State:
    """Known non-keys and current candidates, as staged frames."""

    def __init__(self, width: int, stage: Stage, spark, max_size: int | None, exclude: Column | None):
        self.width, self.stage, self.max_size, self.exclude = width, stage, max_size, exclude
        self.nonkeys = C.combo_frame(spark, []).select("combo", "cols")
        self.candidates = self._allowed(hitting.single_sets(spark, width))

    def _allowed(self, sets: DataFrame) -> DataFrame:
        if self.exclude is None:
            return sets
        return cs.describe(sets).where(~self.exclude).select("combo", "cols")

    def learn(self, agree: set[P.Combo]) -> None:
        """Add agree sets; replace the candidates that lie inside one of them."""
        spark = self.candidates.sparkSession
        new = C.combo_frame(spark, [a for a in agree if a]).select("combo", "cols")
        self.nonkeys = self.stage.put(
            C.maximal(self.nonkeys.unionByName(new)).select("combo", "cols"), "nonkeys"
        )
        broken = C.below(self.candidates, new, "left_semi")
        kept = C.below(self.candidates, new, "left_anti")
        grown = hitting.grow(broken, self.nonkeys, self.width, self.stage, self.max_size)
        self.candidates = self.stage.put(
            self._allowed(kept.unionByName(grown)).dropDuplicates(["combo"]), "candidates"
        )


def _refute(codes: Codes, batch: list[P.Combo]) -> tuple[set[P.Combo], list[P.Combo]]:
    """Quick test on the smallest sample: a candidate passes when no evidence was met."""
    agree = P.neighbour_agree_sets(codes, batch)
    passed = [c for c in batch if not any(set(c) <= set(a) for a in agree)]
    return agree, passed


def _test_dealt(codes: Codes, batch: list[P.Combo], stage: Stage, seen: P.Repeats,
                pivots: A.Pivots) -> tuple[set[P.Combo], list[P.Combo]]:
    """Exact test over all rows of a large table: a shuffle for each pivot, not for each candidate."""
    agree, rest = pivots.narrowed(batch)
    for pivot, combos in pivots.deal(rest).items():
        if pivot is None:
            agree |= _records(codes, combos, stage, seen)
            continue
        found, frequent = pivots.test(pivot, combos, stage)
        agree |= found
        if frequent is not None:
            many, n_many = stage.put_counted(frequent, "frequent", F.lit(True))
            agree |= _records(codes.over(many, n_many), combos, stage, P.Repeats()) if n_many else set()
    return agree, [c for c in batch if not any(set(c) <= set(a) for a in agree)]


def _records(codes: Codes, combos: list[P.Combo], stage: Stage, seen: P.Repeats) -> set[P.Combo]:
    at_once, agree = batch_size(codes, BATCH), set()
    for k in range(0, len(combos), at_once):
        agree |= _test(codes, combos[k : k + at_once], stage, seen)[0]
    return agree


def _test(codes: Codes, batch: list[P.Combo], stage: Stage, seen: P.Repeats) -> tuple[set[P.Combo], list[P.Combo]]:
    """Exact test over all rows of ``codes``."""
    screened = P.screen(codes, batch, stage, seen)
    passed = [c for c in batch if not screened.repeats[c]]
    agree = P.agree_sets(codes, [w for c in screened.witnesses for w in screened.witnesses[c]])
    # Where hashes collide no two rows agree on the candidate: count it by its codes.
    unproven = [c for c in screened.witnesses if not any(set(c) <= set(a) for a in agree)]
    if unproven:
        counted = K.count_errors(codes.rows, codes.fields, unproven, codes.nulls_equal)
        for r in counted.collect():
            combo = tuple(int(x) for x in r.combo.split(","))
            if r.key_error:
                agree.add(combo)
            else:
                passed.append(combo)
    return agree, passed


def _errors(codes: Codes, sets: list[P.Combo]) -> dict[P.Combo, int]:
    """Key errors of one round's sets."""
    if not sets:
        return {}
    counted = K.count_errors(codes.rows, codes.fields, sets, codes.nulls_equal)
    return {tuple(int(x) for x in r.combo.split(",")): r.key_error for r in counted.collect()}


def _with(combo: P.Combo, more) -> P.Combo:
    return tuple(sorted({*combo, *more}))


def _grown(codes: Codes, failing: list[P.Combo], tolerance: int) -> set[P.Combo]:
    """Largest failing sets above the failing ones, one for each.

    Chains start at another column for each set, so that several sets end in several places.
    A column that stops a chain stops it for every larger set, too, so it is asked once.
    """
    width = codes.width
    turn = [[(k + i) % width for i in range(width)] for k in range(len(failing))]
    todo = {c: [x for x in t if x not in c] for c, t in zip(failing, turn)}
    done: set[P.Combo] = set()
    while todo:
        chains = {c: [_with(c, rest[: k + 1]) for k in range(len(rest))] for c, rest in todo.items()}
        errors = _errors(codes, sorted({s for chain in chains.values() for s in chain}))
        following: dict[P.Combo, list[int]] = {}
        for combo, chain in chains.items():
            n = next((k for k, s in enumerate(chain) if errors.get(s, 0) <= tolerance), len(chain))
            rest = todo[combo]
            top, left = _with(combo, rest[:n]), rest[n + 1 :]
            if left:
                following[top] = [x for x in following.get(top, left) if x in left]
            else:
                done.add(top)
        done |= {c for c, left in following.items() if not left}
        todo = {c: left for c, left in following.items() if left}
    return done


def _test_tolerant(
    codes: Codes, batch: list[P.Combo], tolerance: int
) -> tuple[set[P.Combo], dict[P.Combo, int]]:
    """Failing sets grown from the batch, and the errors of those that pass."""
    errors = _errors(codes, batch)
    # A sample may be empty; then nothing fails in it.
    passed = {c: errors.get(c, 0) for c in batch if errors.get(c, 0) <= tolerance}
    grown: set[P.Combo] = set()
    failing = [c for c in batch if c not in passed]
    while failing:
        # What a few end in holds many of the others.
        grown |= _grown(codes, failing[:GROWN], tolerance)
        failing = [c for c in failing if not any(set(c) <= set(g) for g in grown)]
    return grown, passed


PASSED = "combo string, key_error bigint"


def run(codes: Codes, stage: Stage, max_size: int | None = None, exclude: Column | None = None,
        first_sample: int = FIRST_SAMPLE, log=None, tolerance: int = 0) -> Found:
    spark = codes.rows.sparkSession
    state = _State(codes.width, stage, spark, max_size, exclude)
    tested: dict[str, int] = {}
    rounds = 0
    for name, rung in _rungs(codes, stage, first_sample):
        if tolerance and rung is codes and name != "table":
            continue  # no sample is smaller than the table
        seen = P.Repeats()
        large = not tolerance and rung.n_rows > A.DEAL_ABOVE
        pivots = A.Pivots(rung)
        at_once = DEALT if large else batch_size(rung, K.BATCH if tolerance else BATCH)
        passed_path = stage.path("passed")
        stage.append(spark.createDataFrame([], PASSED), passed_path)
        while True:
            passed_so_far = spark.read.schema(PASSED).parquet(passed_path)
            todo = state.candidates.join(passed_so_far, "combo", "left_anti")
            batch = [tuple(r.cols) for r in todo.orderBy(F.size("cols"), "cols").limit(at_once).collect()]
            if not batch:
                break
            rounds += 1
            tested[name] = tested.get(name, 0) + len(batch)
            if tolerance:
                agree, passed = _test_tolerant(rung, batch, tolerance)
            else:
                test = partial(_test_dealt, pivots=pivots) if large else _test
                test = _refute if name == "sample 1" else partial(test, stage=stage, seen=seen)
                agree, passed = test(rung, batch)
                passed = dict.fromkeys(passed, 0)
            if log:
                log(f"{name}: tested {len(batch)}, passed {len(passed)}, agree sets {len(agree)}")
            if passed:
                texts = [(",".join(map(str, c)), e) for c, e in passed.items()]
                stage.append(spark.createDataFrame(texts, PASSED), passed_path)
            if agree:
                state.learn(agree)
    keys = state.candidates.join(passed_so_far, "combo").select("combo", "cols", "key_error")
    return Found(keys, state.nonkeys, tested, rounds)
