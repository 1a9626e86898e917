"""Benchmark decontamination by a prefix-filtered set join.

A benchmark item is cut into its windows of ten words (an item of fewer words is one window).
A window is a set of shingles with positions; since it must be contained whole, one shingle is a
sufficient prefix. Shingles are ordered by rarity, counted over all documents, and the rarest one
of each window is joined. Length and position bounds drop matches that would stick out of the
text, and the words around each match, carried along, verify the window word by word.

The benchmark is the stated query set: its distinct shingles are taken in blocks of at most
``block_shingles`` rows, each joined with the shingles of all documents by a broadcast of that
proven size. Only matches leave the scan, so a passage in a third of all documents costs rows in
proportion to its hits and no task gets them all.

Words: A-Z lower-cased, then ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``. Only DataFrame functions
are used.

Defined results: null or empty texts have no words, are never hit, and as items have no window;
a null item id counts as the empty string; items that repeat an id count once; rows that repeat
``doc_id`` and text get equal rows; an empty benchmark leaves every document clean; other columns
are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom.llm.key_filter import lacking
from keyloom.llm.quality import let
from keyloom.staging import Stage

WINDOW = 10
SHINGLE = 4
BLOCK_SHINGLES = 1_000_000  # rows of a broadcast: two longs each

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RAW_GAPS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # the same before lower-casing
# Characters beyond ASCII that lower() would change too.
OTHER_CASE = r"[\p{Lu}\p{Lt}\p{Nl}\p{So}&&[^\x00-\x7F]]"


def lowered(text: Column) -> Column:
    plain = F.coalesce(text, F.lit(""))
    return F.when(plain.rlike(OTHER_CASE), F.translate(plain, UPPER, LOWER)).otherwise(
        F.lower(plain)
    )


def words_of(text: Column) -> Column:
    return F.filter(F.split(lowered(text), GAPS), lambda w: w != "")


def n_words(text: Column) -> Column:
    parts = F.split(F.coalesce(text, F.lit("")), RAW_GAPS)
    return F.size(F.filter(parts, lambda w: w != "")).cast("bigint")


def shingles(words: Column, size: int) -> Column:
    """Hashes of all runs of ``size`` words, by start position."""

    def runs(h: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(h) - size)
        found = F.transform(
            at, lambda i: F.xxhash64(F.lit(size), *[F.get(h, i + j) for j in range(size)])
        )
        none = F.array().cast("array<bigint>")
        return F.when(F.size(h) >= size, found).otherwise(none)

    return let(F.transform(words, lambda w: F.xxhash64(w)), runs)


def windows(items: DataFrame, width: int = WINDOW) -> DataFrame:
    """item (string), window (its words): distinct."""
    ids = F.coalesce(F.col("item_id").cast("string"), F.lit(""))
    words = items.select(ids.alias("item"), words_of(F.col("text")).alias("w"))
    runs = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size("w") - width + 1, F.lit(1))),
        lambda i: F.slice("w", i, width),
    )
    return words.where(F.size("w") > 0).select("item", F.explode(runs).alias("window")).distinct()


def _window_shingles(wins: DataFrame, sizes: list[int], shingle: int) -> DataFrame:
    """window, off, token: the shingles of every distinct window."""
    out = None
    for size in sizes:
        own = F.size("window") >= shingle if size == shingle else F.size("window") == size
        part = (
            wins.select("window")
            .distinct()
            .where(own)
            .select("window", F.posexplode(shingles(F.col("window"), size)).alias("off", "token"))
        )
        out = part if out is None else out.unionAll(part)
    return out


def hits(
    docs: DataFrame,
    items: DataFrame,
    width: int = WINDOW,
    shingle: int = SHINGLE,
    block_shingles: int = BLOCK_SHINGLES,
) -> tuple[DataFrame, DataFrame]:
    """(spans, pairs): every occurrence as doc_id, text_hash, start, length; and the items that
    have windows in a document as doc_id, text_hash, item."""
    stage = Stage(docs.sparkSession)
    wins = stage.put(windows(items, width), "windows")
    sizes = sorted(
        r[0]
        for r in wins.select(F.least(F.size("window"), F.lit(shingle)).alias("n"))
        .distinct()
        .collect()
    )  # at most ``shingle`` numbers
    key = [F.col("doc_id"), F.xxhash64("text").alias("text_hash")]
    if not sizes:
        none = docs.where(F.lit(False)).select(*key)
        spans = none.select("*", F.lit(0).alias("start"), F.lit(0).alias("length"))
        return spans, none.select("*", F.lit("").alias("item"))
    inner = stage.put(_window_shingles(wins, sizes, shingle), "window-shingles")
    tokens = inner.select("token").distinct()
    n_blocks = -(-max(1, tokens.count()) // block_shingles)
    tokens = tokens.withColumn("block", F.pmod(F.hash("token"), F.lit(2 * n_blocks)))

    worded = docs.select(*key, words_of(F.col("text")).alias("w"))
    reach = width - 1  # a window around a match starts at most so many words before it
    found = None
    for block in range(2 * n_blocks if n_blocks > 1 else 1):
        asked = tokens.where(F.col("block") == block) if n_blocks > 1 else tokens
        for size in sizes:
            spots = worded.select(
                "*", F.posexplode(shingles(F.col("w"), size)).alias("pos", "token")
            )
            first = F.greatest(F.col("pos") - reach, F.lit(0))
            part = spots.join(F.broadcast(asked.select("token")), "token").select(
                "doc_id",
                "text_hash",
                "pos",
                "token",
                first.alias("first"),
                F.slice("w", first + 1, 2 * reach + shingle).alias("around"),
            )
            found = part if found is None else found.unionAll(part)
    found = stage.put(found, "matches")

    # Rarity over all documents; the rarest shingle of a window is its prefix.
    rarity = found.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    prefix = (
        inner.join(rarity, "token")
        .groupBy("window")
        .agg(F.min(F.struct("n", "token", "off")).alias("p"), F.count(F.lit(1)).alias("seen"))
        # A window with a shingle that no document has cannot occur.
        .where(F.col("seen") == F.greatest(F.size("window") - shingle + 1, F.lit(1)))
        .select("window", F.size("window").alias("length"), "p.token", "p.off")
    )
    start = F.col("pos") - F.col("off")
    matched = (
        found.join(prefix, "token")
        .where(start >= F.col("first"))
        .where(start - F.col("first") + F.col("length") <= F.size("around"))
        .where(F.slice("around", start - F.col("first") + 1, F.col("length")) == F.col("window"))
        .select("doc_id", "text_hash", start.alias("start"), "length", "window")
    )
    matched = stage.put(matched, "occurrences")
    spans = matched.select("doc_id", "text_hash", "start", "length").distinct()
    in_docs = matched.select("doc_id", "text_hash", "window").distinct()
    pairs = in_docs.join(wins, "window").select("doc_id", "text_hash", "item").distinct()
    return spans, pairs


def contamination(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_hash, n_words, n_hit, items (sorted)."""
    spans, pairs = hits(docs, items, **options)
    end = F.col("start") + F.col("length")
    by_doc = Window.partitionBy("doc_id", "text_hash").orderBy("start", "length")
    reached = F.max(end).over(by_doc.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.lit(0), end - F.greatest("start", F.coalesce(reached, F.lit(0))))
    n_hit = (
        spans.withColumn("fresh", fresh)
        .groupBy("doc_id", "text_hash")
        .agg(F.sum("fresh").alias("n_hit"))
    )
    listed = pairs.groupBy("doc_id", "text_hash").agg(
        F.sort_array(F.collect_set("item")).alias("items")
    )
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), n_words(F.col("text")))
    texts = texts.toDF("doc_id", "text_hash", "n_words")
    for more in (n_hit, listed):
        more = more.withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash"})
        same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))
        texts = texts.join(more, same, "left").drop("_id", "_hash")
    return texts.select(
        "doc_id",
        "text_hash",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def digest(docs: DataFrame, items: DataFrame) -> DataFrame:
    return contamination(docs, items).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that no window occurs in, with all their columns, whatever their names. Rows
    without words stay, a null id is an id like any other, and without rows or items ``docs`` stays."""
    # A struct is never null, and nulls in it equal each other.
    dirty = hits(docs, items, **options)[0].select(F.struct("doc_id", "text_hash").alias("key"))
    return lacking(docs, F.struct("doc_id", F.xxhash64("text").alias("text_hash")), dirty)
