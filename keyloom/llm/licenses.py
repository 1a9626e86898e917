"""License scan: lines, whole texts and word windows against licence templates by the Dice coefficient.

Texts are normalised (A-Z lower-cased, other ASCII than letters and digits separates words) and
turned into word bigrams (64-bit hashes); a single word is its own bigram. Sets of them are compared.

A unit is a line or the whole text. Two sets of sizes a and b can only reach a Dice coefficient t if
``a * t / (2 - t) <= b <= a * (2 - t) / t``, so a unit is compared only with the templates whose size
bounds hold its own: an equi-join on the size with a table that has one row per template and size
and only the template's number, then one with the templates.

Windows find notices that are wrapped over lines or stand inside a longer line. A window is looked
for in the words of the whole text, whatever the line breaks: it starts at a bigram of the template
and ends at the last one within the template's number of words. To reach t it must hold
``need = ceil(m * t / (2 - t))`` of the template's m bigrams, so at least one of any
``m - need + 1`` of them: the rarest-looking ones propose the templates (a prefix filter, which
loses nothing), ``need`` template bigrams within reach propose the places. Of windows that overlap,
the best stays; it belongs to the line it starts in. A text that reaches a template as a whole
is not searched for windows of that template, and a template of one word has no windows.

Both tables are as long as the templates, which are a parameter and not data, so they may be
broadcast. Everything is compared inside its row's task; nothing but the matches is shuffled.

Defined results: null or empty texts have one empty unit that matches nothing; rows that repeat
get equal rows; null ids stay; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from math import ceil
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm.decontaminate import lowered
from keyloom.llm.quality import COMMON, let

THRESHOLD = 0.8
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Notices and short licence texts in public use.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file'
        " except in compliance with the License. You may obtain a copy of the License at"
        " http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this"
        ' software and associated documentation files (the "Software"), to deal in the Software'
        " without restriction, including without limitation the rights to use, copy, modify,"
        " merge, publish, distribute, sublicense, and/or sell copies of the Software, and to"
        " permit persons to whom the Software is furnished to do so, subject to the following"
        " conditions:",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms"
        " of the GNU General Public License as published by the Free Software Foundation, either"
        " version 3 of the License, or (at your option) any later version.",
    ],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0."],
    "BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are"
        " permitted provided that the following conditions are met:"
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or"
        " without fee is hereby granted, provided that the above copyright notice and this"
        " permission notice appear in all copies."
    ],
}


def with_full_texts(templates: dict) -> dict:
    """The templates and the full licence texts in ``license_texts``, one file a licence."""
    full = {f.stem: f.read_text() for f in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))}
    return {
        name: [*templates.get(name, []), *([full[name]] if name in full else [])]
        for name in [*templates, *(n for n in full if n not in templates)]
    }


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, GAPS), lambda x: x != "")


def hashed(words: Column) -> Column:
    return F.transform(words, lambda x: F.xxhash64(x))


def bigrams(hashes: Column) -> Column:
    """Word bigrams by place as hashes; of one word, that word's; empty without words."""

    def pairs(h: Column) -> Column:
        at = F.sequence(F.lit(0), F.greatest(F.size(h) - 2, F.lit(0)))
        both = F.transform(at, lambda i: F.xxhash64(F.get(h, i), F.coalesce(F.get(h, i + 1), F.lit(0))))
        none = F.array().cast("array<bigint>")
        return F.when(F.size(h) > 0, both).otherwise(none)

    return let(hashes, pairs)


def template_rows(spark: SparkSession, templates: dict, threshold: float) -> list[tuple]:
    """(license, n_words, grams, need, rare) of each template that has words."""
    texts = [(name, text) for name, texts in templates.items() for text in texts]
    worded = spark.createDataFrame(texts, "license string, text string").select(
        "license", words_of(lowered(F.col("text"))).alias("w")
    )
    common = {w for words in COMMON.values() for w in words}
    rows = []
    for name, words, seq in worded.select("license", "w", bigrams(hashed(F.col("w")))).collect():
        if not words:
            continue
        pair = {g: words[i : i + 2] for i, g in enumerate(seq)}
        need = max(1, ceil(len(pair) * threshold / (2 - threshold) - 1e-9))
        looks = sorted(pair, key=lambda g: (sum(w in common for w in pair[g]), -sum(map(len, pair[g])), g))
        rows.append((name, len(words), list(pair), need, looks[: len(pair) - need + 1]))
    return rows


def template_tables(spark: SparkSession, rows: list[tuple], threshold: float) -> tuple[DataFrame, DataFrame]:
    """(keys, templates): key, number, one row per template and set size it can match, with the size
    as key, and one for its windows, with -1 - number as key; and number, license, n_words, grams,
    need."""
    sets = spark.createDataFrame(
        [(i, *row[:4]) for i, row in enumerate(rows)],
        "number int, license string, n_words int, grams array<bigint>, need int",
    )
    bounds = spark.createDataFrame(
        [(i, row[3], int(len(row[2]) * (2 - threshold) / threshold + 1e-9)) for i, row in enumerate(rows)],
        "number int, low int, high int",
    )
    keys = F.concat(F.sequence("low", "high"), F.array(-1 - F.col("number")))
    return bounds.select(F.explode(keys).alias("key"), "number"), sets


def dice(a: Column, b: Column) -> Column:
    return 2 * F.size(F.array_intersect(a, b)) / (F.size(a) + F.size(b))


def units(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, unit (line number, or -1 for the whole text), words (their hashes),
    lines (the number of words of each, if the unit is all of the text)."""
    lines = F.transform(F.split(lowered(F.col("text")), "\n"), lambda x: hashed(words_of(x)))

    def parts(cut: Column) -> Column:
        sizes = F.transform(cut, lambda x: F.size(x))
        no_sizes = F.lit(None).cast("array<int>")
        only = F.size(cut) == 1
        each = F.transform(
            cut,
            lambda x, i: F.struct(
                i.alias("unit"), x.alias("words"), F.when(only, F.array(F.size(x))).otherwise(no_sizes).alias("lines")
            ),
        )
        whole = F.struct(F.lit(-1).alias("unit"), F.flatten(cut).alias("words"), sizes.alias("lines"))
        return F.when(only, each).otherwise(F.concat(each, F.array(whole)))

    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.inline(let(lines, parts)))


def _longs(values) -> str:
    return ", ".join(f"cast('{v}' as bigint)" if v == -(2**63) else f"{v}L" for v in values)


def asked(cut: DataFrame, rows: list[tuple]) -> DataFrame:
    """The units with one row per key of the template table to compare them with."""
    rare = sorted({g for row in rows if row[1] > 1 for g in row[4]})
    size = F.size(F.array_distinct("seq"))
    if not rare:
        return cut.withColumn("key", size)
    spoken = F.expr(f"CASE WHEN lines IS NOT NULL THEN filter(seq, x -> x IN ({_longs(rare)})) END")
    cut = cut.withColumn("spoken", spoken)
    proposed = [
        f"CASE WHEN arrays_overlap(spoken, array({_longs(row[4])})) THEN {-1 - i} END"
        for i, row in enumerate(rows)
        if row[1] > 1
    ]
    windows = F.expr(f"CASE WHEN size(spoken) > 0 THEN array_compact(array({', '.join(proposed)})) ELSE array() END")
    return cut.withColumn("key", F.explode(F.concat(F.array(size), windows))).drop("spoken")


def _line_of(place: Column, lines: Column) -> Column:
    """The line of a word of the text."""
    start = F.struct(place.cast("int").alias("left"), F.lit(0).alias("line"))
    passed = F.aggregate(
        lines,
        start,
        lambda a, n: F.when(
            a["left"] >= n, F.struct((a["left"] - n).alias("left"), (a["line"] + 1).alias("line"))
        ).otherwise(F.struct(F.lit(-1).alias("left"), a["line"].alias("line"))),
    )
    return passed["line"]


def _windows(seq: Column, grams: Column, n_words: Column, need: Column, lines: Column, threshold: float) -> Column:
    """array<struct<unit, dice>>: the best of the overlapping windows that reach the threshold."""
    reach = n_words - 2  # from a window's first bigram to the last it can have

    def window(spots: Column, j: Column) -> Column:
        first = F.get(spots, j)
        near = F.slice(spots, j + 1, n_words - 1)
        last = F.array_max(F.filter(near, lambda x: x <= first + reach))
        own = F.array_distinct(F.slice(seq, first + 1, last - first + 1))
        return F.struct((-dice(own, grams)).alias("d"), first.alias("s"), last.alias("e"))

    def best(spots: Column) -> Column:
        begins = F.filter(
            F.sequence(F.lit(0), F.size(spots) - need),
            lambda j: F.get(spots, j + need - 1) - F.get(spots, j) <= reach,
        )
        found = F.filter(F.transform(begins, lambda j: window(spots, j)), lambda w: -w["d"] >= threshold)
        return F.aggregate(
            F.array_sort(found),
            F.array().cast("array<struct<d:double,s:int,e:int>>"),
            lambda kept, w: F.when(
                F.exists(kept, lambda k: (k["s"] <= w["e"]) & (w["s"] <= k["e"])), kept
            ).otherwise(F.concat(kept, F.array(w))),
        )

    at = F.sequence(F.lit(0), F.size(seq) - 1)
    spots = F.filter(at, lambda i: F.array_contains(grams, F.get(seq, i)))
    places = F.transform(
        let(spots, best), lambda k: F.struct(_line_of(k["s"], lines).alias("unit"), (-k["d"]).alias("dice"))
    )
    in_all = F.size(F.array_intersect(seq, grams))
    whole = 2 * in_all / (F.size(F.array_distinct(seq)) + F.size(grams))
    return F.when((in_all >= need) & (whole < threshold), places)


def matches(docs: DataFrame, templates=None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, text_hash, unit, license, dice: the best template of each licence that a unit, or a
    window that starts in it, reaches the threshold with."""
    spark = docs.sparkSession
    rows = template_rows(spark, with_full_texts(TEMPLATES) if templates is None else templates, threshold)
    cut = units(docs).select(
        "doc_id", "text_hash", "unit", "lines", bigrams(F.col("words")).alias("seq")
    )
    keys, sets = template_tables(spark, rows, threshold)
    pairs = asked(cut, rows).join(F.broadcast(keys), "key").join(F.broadcast(sets), "number")
    score = dice(F.array_distinct("seq"), F.col("grams"))
    unit = let(
        score,
        lambda d: F.when(d >= threshold, F.array(F.struct(F.col("unit").alias("unit"), d.alias("dice")))),
    )
    windows = _windows(*map(F.col, ("seq", "grams", "n_words", "need", "lines")), threshold)
    found = pairs.select(
        "doc_id",
        "text_hash",
        "license",
        F.inline(F.when(F.col("key") >= 0, unit).otherwise(windows)),
    )
    return found.groupBy("doc_id", "text_hash", "unit", "license").agg(F.max("dice").alias("dice"))


def scan(docs: DataFrame, templates=None, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_lines, n_matches (units that match or
    that a matching window starts in), licenses."""
    found = matches(docs, templates, threshold)
    listed = found.groupBy("doc_id", "text_hash").agg(
        F.countDistinct("unit").alias("n_matches"),
        F.array_join(F.sort_array(F.collect_set("license")), ",").alias("licenses"),
    )
    listed = listed.withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash"})
    own = docs.select(
        "doc_id",
        F.xxhash64("text").alias("text_hash"),
        F.size(F.split(F.coalesce("text", F.lit("")), "\n")).cast("bigint").alias("n_lines"),
    )
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))
    return own.join(listed, same, "left").select(
        "doc_id",
        "n_lines",
        F.coalesce("n_matches", F.lit(0)).cast("bigint").alias("n_matches"),
        F.coalesce("licenses", F.lit("")).alias("licenses"),
    )
