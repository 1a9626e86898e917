"""Quality rules: distance of a document's character and word profile from its language.

Every document gets two histograms: its characters over six classes and its words over
twelve frequent words of its language. The references are the same histograms summed over
*all* documents of that language, at most five rows (four languages and the rest), so they
may be broadcast. A document is dropped when the Jensen-Shannon distance (base 2, 0..1) of
either histogram from its reference exceeds a limit, unless it is too short for that
histogram to mean anything (the minimum-length guards), or when it fails the base rules.

Words are ``[^\\x20\\x09-\\x0D]+``. Only DataFrame functions are used. The features of a row
are computed inside the row; nothing is shuffled but five partial sums per task.

Defined results: a null or empty text has no words and is dropped (``n_words < 20``); a null or
unknown ``lang`` belongs to the rest, which has a character reference but no word test; rows
are judged one by one, so repeated rows get equal verdicts and null ids stay; an empty table
gives an empty result; other columns of the table are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.staging import Stage

# Frequent words of the languages.
COMMON = {
    "en": "the of and to in is that for it as with was".split(),
    "de": "der die und in den von zu das mit sich des ist".split(),
    "fr": "de la le et les des en un du une que est".split(),
    "es": "de la que el en y a los se del las un".split(),
}
REST = "rest"
BLANK = r"[\x20\x09-\x0D]+"
MAX_CHAR_DISTANCE = 0.32
MAX_WORD_DISTANCE = 0.275
MIN_CHARS = 200  # guard of the character histogram
MIN_WORDS = 100  # guard of the word histogram
WINDOW = 8


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, also where lambdas inside use it."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANK), lambda w: w != "")


def repeat_words(words: Column, width: int = WINDOW) -> Column:
    """Words inside windows of ``width`` words that the text holds twice or more."""
    zero = F.lit(0).cast("bigint")

    def windows(hashed: Column) -> Column:
        at = F.sequence(F.lit(1), F.size(hashed) - width + 1)
        found = F.transform(at, lambda i: F.xxhash64(F.slice(hashed, i, width)))
        return F.when(F.size(hashed) >= width, let(found, covered)).otherwise(zero)

    def covered(found: Column) -> Column:
        pairs = F.array_sort(F.transform(found, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        some = F.size(F.array_distinct(found)) < F.size(found)
        return F.when(some, let(pairs, marked)).otherwise(zero)

    def marked(pairs: Column) -> Column:
        def twice(p: Column, k: Column) -> Column:
            before = F.coalesce(F.get(pairs, k - 1)["x"] == p["x"], F.lit(False))
            return before | F.coalesce(F.get(pairs, k + 1)["x"] == p["x"], F.lit(False))

        spots = F.array_sort(F.transform(F.filter(pairs, twice), lambda p: p["i"]))
        return let(spots, lengths)

    def lengths(spots: Column) -> Column:
        end = F.lit(width)
        parts = F.transform(
            spots, lambda i, k: F.least(end, F.coalesce(F.get(spots, k + 1) - i, end))
        )
        return F.aggregate(parts, zero, lambda a, x: a + x)

    return let(F.transform(words, lambda w: F.xxhash64(w)), windows)


def features(docs: DataFrame, whole: bool = False) -> DataFrame:
    """row (doc_id, or all columns of ``docs``), lang_key, counts and the two histograms; one row
    per row of ``docs``."""
    row = F.struct(*[F.col(f"`{c}`") for c in (docs.columns if whole else ["doc_id"])])
    text = F.coalesce(F.col("text"), F.lit(""))
    kind = F.when(F.col("lang").isin(*COMMON), F.col("lang")).otherwise(REST)
    d = docs.select(
        row.alias("row"), kind.alias("lang_key"), text.alias("text"), words_of(text).alias("w")
    )
    listed = F.lit(None).cast("array<string>")
    for lang, words in COMMON.items():
        listed = F.when(
            F.col("lang_key") == lang, F.array(*[F.lit(w) for w in words])
        ).otherwise(listed)
    d = d.withColumn("listed", listed)
    spoken = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = d.select(
        "row",
        "lang_key",
        F.size("w").cast("bigint").alias("n_words"),
        F.aggregate("w", F.lit(0).cast("bigint"), lambda a, x: a + F.length(x)).alias(
            "word_chars"
        ),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
        (F.size(spoken) - F.size(F.array_distinct(spoken))).cast("bigint").alias("n_dup_lines"),
        repeat_words(F.col("w")).alias("n_repeat_words"),
        F.length("text").cast("bigint").alias("n_all"),
        F.regexp_count("text", F.lit("[0-9]")).cast("bigint").alias("n_digits"),
        F.regexp_count("text", F.lit("[A-Z]")).cast("bigint").alias("n_upper"),
        F.regexp_count("text", F.lit("""[.,;:!?'"()-]""")).cast("bigint").alias("n_marks"),
        let(
            F.col("listed"),
            lambda known: F.filter(
                F.transform("w", lambda x: F.array_position(known, x)), lambda i: i > 0
            ),
        ).alias("spots"),
    )
    letters = (
        F.col("word_chars")
        - F.col("n_symbols")
        - F.col("n_digits")
        - F.col("n_upper")
        - F.col("n_marks")
    )
    bins = let(
        F.coalesce("spots", F.array().cast("array<bigint>")),
        lambda spots: F.transform(
            F.sequence(F.lit(1), F.lit(12)),
            lambda k: F.size(F.filter(spots, lambda i: i == k)).cast("bigint"),
        ),
    )
    return d.select(
        "row",
        "lang_key",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "n_all",
        F.array(
            F.col("n_all") - F.col("word_chars"),
            "n_symbols",
            "n_digits",
            "n_upper",
            "n_marks",
            letters,
        ).alias("chars"),
        F.concat(bins, F.array((F.col("n_words") - F.greatest(F.size("spots"), F.lit(0))).cast("bigint"))).alias(
            "common"
        ),
    )


def references(feats: DataFrame) -> DataFrame:
    """One row per language key that occurs: the summed histograms of all its documents."""
    sums = [F.sum(F.col("chars")[i]).alias(f"c{i}") for i in range(6)]
    sums += [F.sum(F.col("common")[i]).alias(f"w{i}") for i in range(13)]
    summed = feats.groupBy("lang_key").agg(*sums)
    return summed.select(
        "lang_key",
        F.array(*[f"c{i}" for i in range(6)]).alias("ref_chars"),
        F.array(*[f"w{i}" for i in range(13)]).alias("ref_common"),
    )


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of counts; null if one of them sums to 0."""

    def total(x: Column) -> Column:
        return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)

    def part(x: Column, m: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)

    def distance(x: Column, y: Column) -> Column:
        terms = F.zip_with(x, y, lambda a, b: (part(a, (a + b) / 2) + part(b, (a + b) / 2)) / 2)
        return F.sqrt(F.greatest(total(terms), F.lit(0.0)))

    def shares(x: Column) -> Column:
        return let(total(x), lambda n: F.transform(x, lambda v: v / n))

    both = (total(p) > 0) & (total(q) > 0)
    return F.when(both, let(shares(p), lambda x: let(shares(q), lambda y: distance(x, y))))


def judge(
    docs: DataFrame,
    max_char_distance: float = MAX_CHAR_DISTANCE,
    max_word_distance: float = MAX_WORD_DISTANCE,
    min_chars: int = MIN_CHARS,
    min_words: int = MIN_WORDS,
) -> DataFrame:
    """doc_id, base counts, ``char_distance``, ``word_distance``, ``base_failed``, ``kept``."""
    feats = Stage(docs.sparkSession).put(features(docs), "features")
    limits = (max_char_distance, max_word_distance, min_chars, min_words)
    return _verdicts(feats, references(feats), *limits).select("row.*", *COUNTS, *JUDGED)


def keep(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns. The texts are read twice, for
    the references and for the verdicts, and never shuffled."""
    refs = Stage(docs.sparkSession).put(references(features(docs)), "references")
    limits = (MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE, MIN_CHARS, MIN_WORDS)
    return _verdicts(features(docs, whole=True), refs, *limits).where("kept").select("row.*")


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
JUDGED = ["char_distance", "word_distance", "base_failed", "kept"]


def _verdicts(feats, refs, max_char_distance, max_word_distance, min_chars, min_words) -> DataFrame:
    d = feats.join(F.broadcast(refs), "lang_key", "left")
    d = d.withColumns(
        {
            "char_distance": F.when(
                F.col("n_all") >= min_chars, js_distance(F.col("chars"), F.col("ref_chars"))
            ),
            "word_distance": F.when(
                (F.col("n_words") >= min_words) & (F.col("lang_key") != REST),
                js_distance(F.col("common"), F.col("ref_common")),
            ),
            "base_failed": (F.col("n_words") < 20)
            | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")),
        }
    )
    far = F.coalesce(F.col("char_distance") > max_char_distance, F.lit(False)) | F.coalesce(
        F.col("word_distance") > max_word_distance, F.lit(False)
    )
    return d.select(
        "row", *COUNTS, *JUDGED[:-1], (~F.col("base_failed") & ~far).alias("kept")
    )
