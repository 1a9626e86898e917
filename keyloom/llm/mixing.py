"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

The size of a document is its number of words ``[^\\x20\\x09-\\x0D]+``. Each source has a weight
and shares the size of all documents by weight, but a target stops at ``max_epochs`` times the
source's size; the excess is shared anew among the others.

1. *Blocks.* Every document falls into a block of its source by a seeded hash, about
   ``block_words`` words each. The blocks of a source, in the order of their own hash, are its
   permutation; the order inside a block is by hash too.
2. *Quotas.* A target is a number of whole epochs and a remainder. An epoch draws every block; the
   remainder draws blocks in permuted order up to the one where it ends, of which it takes the
   documents, in the order of their hash, up to the one that passes the remainder's middle. So a
   source's taken words miss its target by half a document.
3. *Splitting tree.* The exact numbers of drawn blocks per source are split among the output
   shards: a node gives its left half a multivariate hypergeometric draw of the node's blocks.
   Draws are seeded by the node, so each shard walks from the root to its leaf by itself.
4. *Draws.* Shard k gets the next run of each source's permuted draws: disjoint by construction.
   Inside a shard rows are ordered by hash.

Block tables are joined on (source, block), so a source with a third of all rows is spread over
its blocks; the only tables handled whole are the list of sources and the list of blocks, of which
every row stands for ``block_words`` words.

Defined results: a null or empty text has size 0 and is drawn like its block, adding no words; a
null source is a source of its own, last in order; rows that repeat everything fall into the same
block and place; an empty table gives no rows; other columns are kept by :func:`mixed` unless
they clash with its own names, which then win.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom.staging import Stage

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
BLOCK_WORDS = 20_000
SHARD_BLOCKS = 64
SEED = 20_240_601
GENERATOR_LIMIT = 1_000_000_000  # of NumPy's hypergeometric draws


def size_of(text: Column) -> Column:
    parts = F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+")
    return F.size(F.filter(parts, lambda w: w != "")).cast("bigint")


def targets(
    sizes: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS
) -> DataFrame:
    """From (source, size): source, source_size, weight, target. One row per source."""
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # The list of sources in order; a window without partitions over one row per source.
    order = Window.orderBy(F.col("source").isNull(), "source")
    place = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    w = F.array(*[F.lit(float(x)) for x in weights])
    s = sums.withColumn("weight", F.get(w, place))
    cap = max_epochs * F.col("source_size")
    # Sources are capped in order of cap / weight, up to the first whose fair share fits.
    rank = Window.orderBy(cap / F.col("weight"), F.col("source").isNull(), "source")
    before = rank.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(Window.partitionBy()) - F.coalesce(
        F.sum(cap).over(before), F.lit(0)
    )
    rest = F.sum("weight").over(rank.rowsBetween(0, Window.unboundedFollowing))
    s = s.withColumn("fair", F.greatest(left, F.lit(0)) / rest)
    fits = F.col("fair") * F.col("weight") <= cap
    s = s.withColumn("fits", fits).withColumn("k", F.row_number().over(rank))
    level = F.min(F.when(F.col("fits"), F.struct("k", "fair"))).over(Window.partitionBy())["fair"]
    share = F.least(F.col("weight") * level, cap.cast("double"))
    return s.select(
        "source",
        "source_size",
        "weight",
        F.coalesce(share, cap.cast("double")).alias("target"),
    )


def _documents(docs: DataFrame, seed: int) -> DataFrame:
    """doc_id, source, size, mark: what the draws need of a row."""
    mark = F.xxhash64(F.lit(seed), "doc_id", "source", "text")
    return docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), mark.alias("mark"))


def _block(block_words: int) -> Column:
    n = F.greatest(F.ceil(F.col("source_size") / F.lit(block_words)), F.lit(1)).cast("bigint")
    return F.pmod(F.col("mark"), n)


def draws(
    docs: DataFrame,
    weights=WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
    block_words: int = BLOCK_WORDS,
    shard_blocks: int = SHARD_BLOCKS,
    seed: int = SEED,
) -> tuple[DataFrame, DataFrame]:
    """(sources, drawn). ``drawn`` has a row per drawn copy of a row of ``docs``: doc_id, source,
    size, mark, epoch, shard, place (the order inside the shard)."""
    spark = docs.sparkSession
    stage = Stage(spark)
    own = stage.put(_documents(docs, seed), "sizes")
    sources = stage.put(targets(own, weights, max_epochs), "sources")
    same_source = F.col("source").eqNullSafe(F.col("_source"))
    split = sources.select(
        F.col("source").alias("_source"), "source_size", "target"
    )
    # One row per source; Spark broadcasts it if its measured size allows.
    placed = stage.put(
        own.join(split, same_source)
        .withColumn("block", _block(block_words))
        .select("doc_id", "source", "size", "mark", "block"),
        "placed",
    )
    blocks = (
        placed.groupBy("source", "block")
        .agg(F.sum("size").alias("words"))
        .join(split, same_source)
        .drop("_source")
    )
    epochs = F.least(
        F.floor(F.col("target") / F.greatest("source_size", F.lit(1)) + 1e-9), F.lit(max_epochs)
    )
    rest = F.greatest(F.col("target") - epochs * F.col("source_size"), F.lit(0.0))
    rest = F.when(epochs >= max_epochs, 0.0).otherwise(rest)
    order = Window.partitionBy("source").orderBy(F.xxhash64(F.lit(seed), "source", "block"), "block")
    before = F.coalesce(
        F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    blocks = blocks.select(
        "source",
        "block",
        "words",
        epochs.cast("int").alias("epochs"),
        (rest - before).alias("wanted"),  # words the remainder still wants when it gets here
        (F.row_number().over(order) - 1).alias("place"),
    )
    blocks = stage.put(blocks, "blocks")
    copies = F.col("epochs") + (F.col("wanted") > 0).cast("int")
    quotas = blocks.groupBy("source").agg(F.sum(copies).cast("bigint").alias("quota"))
    total = quotas.agg(F.sum("quota").alias("n")).first().n or 0
    n_shards = max(1, -(-int(total) // shard_blocks))
    runs = stage.put(_shard_runs(quotas, n_shards, seed), "runs")

    # Draw number of each copy of a block: epochs one after the other, permuted order inside.
    numbered = blocks.select(
        "source", "block", "words", "wanted", "epochs", "place", F.explode(
            F.sequence(F.lit(0), F.col("epochs"))
        ).alias("epoch")
    ).where((F.col("epoch") < F.col("epochs")) | (F.col("wanted") > 0))
    n_blocks = blocks.groupBy("source").agg(F.count(F.lit(1)).alias("n_blocks"))
    n_blocks = n_blocks.withColumnRenamed("source", "_source")
    numbered = numbered.join(n_blocks, same_source).withColumn(
        "draw", F.col("epoch") * F.col("n_blocks") + F.col("place")
    )
    # Runs are cut into pieces of ``shard_blocks`` draws, so an equi-join finds a draw's shard.
    pieces = runs.withColumn(
        "piece",
        F.explode(
            F.sequence(
                F.floor(F.col("first") / shard_blocks), F.floor((F.col("end") - 1) / shard_blocks)
            )
        ),
    ).withColumnRenamed("source", "_source")
    drawn = (
        numbered.drop("_source")
        .withColumn("_piece", F.floor(F.col("draw") / shard_blocks))
        .join(
            pieces,
            same_source
            & (F.col("_piece") == F.col("piece"))
            & (F.col("draw") >= F.col("first"))
            & (F.col("draw") < F.col("end")),
        )
        .select("source", "block", "words", "wanted", "epochs", "epoch", "shard")
    )
    drawn = stage.put(drawn, "draws").withColumnsRenamed({"source": "_source", "block": "_block"})
    here = same_source & (F.col("block") == F.col("_block"))
    # In the block where the remainder ends, documents are taken up to its middle.
    ends = F.col("wanted").isNotNull() & (F.col("wanted") > 0) & (F.col("wanted") < F.col("words"))
    joined = placed.join(drawn, here).drop("_source", "_block")
    last = joined.where(ends & (F.col("epoch") == F.col("epochs")))
    inside = Window.partitionBy("source", "block").orderBy("mark", "doc_id", "size")
    last = last.withColumn(
        "until", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    ).where(F.col("until") - F.col("size") / 2 <= F.col("wanted"))
    whole = joined.where(~(ends & (F.col("epoch") == F.col("epochs"))))
    place = F.xxhash64(F.lit(seed), "shard", "epoch", "mark").alias("place")
    cols = ["doc_id", "source", "size", "mark", "epoch", "shard"]
    return sources, whole.select(*cols, place).unionAll(last.select(*cols, place))


def _shard_runs(quotas: DataFrame, n_shards: int, seed: int) -> DataFrame:
    """source, shard, first, end: the run of the source's draws that the shard gets."""
    spark = quotas.sparkSession
    listed = [
        (r.source, int(r.quota))
        for r in quotas.orderBy(F.col("source").isNull(), "source").collect()
    ]  # one row per source
    pool = np.array([q for _, q in listed], dtype=np.int64)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for leaf in batch["id"]:
                low, high, have, first = 0, n_shards, pool, np.zeros_like(pool)
                while high - low > 1:
                    middle = (low + high) // 2
                    rng = np.random.default_rng([seed, low, high])
                    share = int(have.sum()) * (middle - low) // (high - low)
                    left = split_counts(rng, have, share)
                    if leaf < middle:
                        have, high = left, middle
                    else:
                        have, first, low = have - left, first + left, middle
                out += [(i, leaf, f, f + n) for i, (f, n) in enumerate(zip(first, have)) if n]
            yield pd.DataFrame(out, columns=["i", "shard", "first", "end"]).astype("int64")

    names = spark.createDataFrame(
        [(i, s) for i, (s, _) in enumerate(listed)], "i bigint, source string"
    )
    parts = min(n_shards, 4 * spark.sparkContext.defaultParallelism)
    leaves = spark.range(0, n_shards, 1, parts)
    runs = leaves.mapInPandas(walk, "i bigint, shard bigint, first bigint, end bigint")
    return runs.join(names, "i").select("source", "shard", "first", "end")


def split_counts(rng: np.random.Generator, have: np.ndarray, share: int) -> np.ndarray:
    """A multivariate hypergeometric draw of ``share`` blocks, one source after the other."""
    left, rest = np.zeros_like(have), int(have.sum())
    for i, n in enumerate(have):
        rest -= int(n)
        taken = share if rest == 0 else _hypergeometric(rng, int(n), rest, share)
        left[i] = taken
        share -= taken
    return left


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, sample: int) -> int:
    if good == 0 or sample == 0:
        return 0
    if max(good, bad) < GENERATOR_LIMIT:
        return int(rng.hypergeometric(good, bad, sample))
    return _by_inversion(rng.random(), good, bad, sample)


def _by_inversion(u: float, good: int, bad: int, sample: int) -> int:
    """A hypergeometric draw of any size by its distribution function, from ratios of neighbouring
    probabilities. Numbers further than 12 standard deviations from the mean, together less likely
    than a double can tell from 0, are left out."""
    total = good + bad
    mean = sample * good / total
    spread = (mean * (bad / total) * ((total - sample) / max(total - 1, 1))) ** 0.5
    reach = int(12 * spread) + 40
    low = max(0, sample - bad, int(mean) - reach)
    high = min(good, sample, int(mean) + reach)
    k = np.arange(low, high, dtype=np.float64)
    steps = np.log((good - k) / (k + 1)) + np.log((sample - k) / (bad - sample + k + 1))
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    below = np.cumsum(np.exp(logs - logs.max()))
    return low + min(int(np.searchsorted(below, u * below[-1], side="right")), high - low)


def taken(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken: one row per row of ``docs``."""
    sources, drawn = draws(docs, **options)
    seed = options.get("seed", SEED)
    own = _documents(docs, seed)
    sums = drawn.groupBy("doc_id", "source", "mark").agg(F.sum("size").alias("t"))
    # Rows that repeat everything share what their copies took.
    n = own.groupBy("doc_id", "source", "mark", "size").agg(F.count(F.lit(1)).alias("n"))
    sums = sums.withColumnsRenamed({"doc_id": "_id", "source": "_s", "mark": "_m"})
    same = (
        F.col("doc_id").eqNullSafe(F.col("_id"))
        & F.col("source").eqNullSafe(F.col("_s"))
        & (F.col("mark") == F.col("_m"))
    )
    split = sources.withColumnRenamed("source", "_source")
    got = F.coalesce(F.col("t"), F.lit(0)).cast("bigint")
    each = F.floor(got / F.col("n")) + F.when(F.col("k") <= got % F.col("n"), 1).otherwise(0)
    return (
        n.join(sums, same, "left")
        .join(split, F.col("source").eqNullSafe(F.col("_source")))
        .withColumn("k", F.explode(F.sequence(F.lit(1).cast("bigint"), "n")))
        .select("doc_id", "size", "source_size", "target", each.cast("bigint").alias("taken"))
    )


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix: every drawn copy with all columns of ``docs``, whatever their names, in ``row``, and its
    epoch, shard and place. Null texts, sources and ids are drawn like any other."""
    drawn = draws(docs, **options)[1]
    key = ["doc_id", "source", "mark"]
    copies = drawn.dropDuplicates([*key, "epoch"]).select(*key, "epoch", "shard", "place")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    mark = F.xxhash64(F.lit(options.get("seed", SEED)), "doc_id", "source", "text")
    kept = docs.select(row.alias("row"), mark.alias("own_mark"))
    same = (
        F.col("row.doc_id").eqNullSafe(F.col("doc_id"))
        & F.col("row.source").eqNullSafe(F.col("source"))
        & (F.col("own_mark") == F.col("mark"))
    )
    return kept.join(copies, same).select("row", "epoch", "shard", "place")


def shuffled(docs: DataFrame, **options) -> DataFrame:
    """The mix with the columns of ``docs`` and their values: shards one after the other in the
    partitions, rows in the order of their place. An empty table gives an empty one."""
    mix = mixed(docs, **options)
    return mix.repartition("shard").sortWithinPartitions("shard", "place").select("row.*")
