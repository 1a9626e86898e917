"""Readers for delimited text, on Spark's text source.

Every field is a trimmed string and quotes have no meaning. Rows with too few or too many
fields are set apart as rejects; blanks around a value go, an empty value stays (as the
empty string, also at the end of a line). A blank line is a line like any other: one empty field
without a separator in it, so a row of a one-column table and a reject elsewhere. Lines may have
any number of fields.

Files may be many: each has its own header line, its first. Headers that name other columns, or the
same in another order, are an error. Equal lines cannot be told apart in what is returned, so of the
lines that are equal to a header line as many are left out as there are files that begin with it.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.functions import values as V


@dataclass
class Parsed:
    """``good`` rows with one string per column; ``rejects`` with the whole ``line``."""

    good: DataFrame
    rejects: DataFrame


def _heads(spark: SparkSession, path: str, known: str, check: Callable[[str], None]) -> dict[str, tuple[int, int]]:
    """The distinct first lines of the files: how many files begin with each, and how many lines are equal to it.

    One scan, in which the lines equal to the ``known`` header are counted, too; files whose header is
    written in another way cost a second one. ``check`` may raise at any first line; no more are fetched then.
    """
    lines = spark.read.text(path)
    same, place = F.col("value") == F.lit(known), F.col("_metadata.file_block_start")
    near = lines.select(
        "value", F.col("_metadata.file_path").alias("file"), place.alias("place"), F.monotonically_increasing_id().alias("id")
    ).where((F.col("place") == 0) | same)
    first = near.groupBy("file").agg(F.min_by("value", F.struct("place", "id")).alias("value"), F.count_if(same).alias("same"))
    begins, n_known = {}, 0
    for r in first.groupBy("value").agg(F.count(F.lit(1)).alias("n"), F.sum("same").alias("same")).toLocalIterator():
        check(r.value)
        begins[r.value] = r.n
        n_known += r.same
    count = {known: n_known}
    if others := [h for h in begins if h != known]:
        found = lines.where(F.col("value").isin(*others)).groupBy("value").agg(F.count(F.lit(1)).alias("n"))
        count |= {r.value: r.n for r in found.collect()}
    return {h: (n, count[h]) for h, n in begins.items()}


def _body(spark: SparkSession, path: str, first_line: str, split: Callable[[str], list[str]]) -> DataFrame:
    """The lines without the header lines, in one scan. Further lines that are equal to a header are
    made again from their number."""
    names = split(first_line)

    def check(head: str) -> None:
        if split(head) != names:
            raise ValueError(f"headers differ in {path}: {names} and {split(head)}")

    heads = _heads(spark, path, first_line, check)
    body = spark.read.text(path).select("value").where(~F.col("value").isin(*heads))
    for head, (n_files, n_lines) in heads.items():
        if n_lines > n_files:
            body = body.unionAll(spark.range(n_lines - n_files).select(F.lit(head).alias("value")))
    return body


def _split(lines: DataFrame, names: Sequence[str], sep: str) -> Parsed:
    fields = lines.select("value", F.split("value", re.escape(sep), -1).alias("f"))
    whole = F.size("f") == len(names)
    return Parsed(
        good=fields.where(whole).select(*[V.trimmed(F.col("f")[i]).alias(n) for i, n in enumerate(names)]),
        rejects=fields.where(~whole).select(F.col("value").alias("line")),
    )


def _first_line(spark: SparkSession, path: str) -> str:
    head = spark.read.text(path).head()
    if head is None:
        raise ValueError(f"no header line in {path}")
    return head.value


def _unique(names: Sequence[str]) -> list[str]:
    """Column names as Spark can address them: a repeated name gets its position added, and marks until
    no name of the header or before it is the same."""
    count: dict[str, int] = {}
    for n in names:
        count[n.lower()] = count.get(n.lower(), 0) + 1
    taken = {n for n, k in count.items() if k == 1}
    out = []
    for i, n in enumerate(names):
        if count[n.lower()] > 1:
            n = f"{n}{i}"
            while n.lower() in taken:
                n += "_"
            taken.add(n.lower())
        out.append(n)
    return out


def read_comma(spark: SparkSession, path: str, n_columns: int = -1) -> Parsed:
    """Comma-separated text whose first line names the columns; optionally the first N only.

    A line is judged against the whole header, also when only some columns are kept.
    """
    def split(line: str) -> list[str]:
        return [n.strip() for n in line.split(",")]

    first = _first_line(spark, path)
    parsed = _split(_body(spark, path, first, split), _unique(split(first)), ",")
    return Parsed(first_n_columns(parsed.good, n_columns), parsed.rejects)


def read_tab(spark: SparkSession, path: str, n_columns: int = -1) -> Parsed:
    """Tab-separated text; the header line is split on any whitespace."""
    first = _first_line(spark, path)
    parsed = _split(_body(spark, path, first, str.split), _unique(first.split()), "\t")
    return Parsed(first_n_columns(parsed.good, n_columns), parsed.rejects)


# Fixed value: the columns of the headerless layout.
PERSON_COLUMNS = ("Age", "Name", "Job", "Country")


def read_fixed(spark: SparkSession, path: str, names: Sequence[str] = PERSON_COLUMNS, sep: str = ",") -> Parsed:
    """Headerless text with known column names."""
    return _split(spark.read.text(path).select("value"), list(names), sep)


def first_n_columns(df: DataFrame, n: int) -> DataFrame:
    """The N leftmost columns; -1 keeps all. The scan below reads only these."""
    if n == -1:
        return df
    if not 0 < n <= len(df.columns):
        raise ValueError(f"{n} columns asked for, the table has {len(df.columns)}")
    return df.select(*[F.col(f"`{c}`") for c in df.columns[:n]])
