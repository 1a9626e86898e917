"""

The SQL decides uniqueness by brute force: it counts every column set of a table with
GROUPING SETS and reads keys, non-keys and their borders off the counts.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.functions import colsets as cs
from keyloom.operators import cells as L
from keyloom.operators import combos as C
from keyloom.operators import keyerror as K
from keyloom.plans import discover as D
from keyloom.plans.hitting import hitting_sets
from keyloom.sources import delimited, prepare, report
from keyloom.staging import Stage

# The training-data operators may be taken away as a whole (subpackage llm and the pipeline), or lack
# a library that they need.
try:
    from keyloom.llm import queries as llm
except ImportError:
    llm = None
try:
    import corpus_pipeline as pipeline
except ImportError:
    pipeline = None

SMOKE_DIR = "/root/testdata/sf0.001"

# Columns of the tables whose keys are searched, in table order.
COLUMNS = {
    "region": "r_regionkey r_name",
    "nation": "n_nationkey n_name n_regionkey",
    "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment",
    "supplier": "s_suppkey s_name s_nationkey s_acctbal",
    "part": "p_partkey p_name p_brand p_type p_size p_retailprice",
    "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice "
    "l_discount l_tax l_returnflag l_linestatus l_shipdate",
    "events": "event_id ts user_id event_type value props",
    "documents": "doc_id text lang source n_chars",
    "embeddings": "vec_id embedding label",
    "pages": "page_id url html",
    "benchmark": "item_id text",
    "labels": "doc_id quality toxic",
    "conversations": "conv_id turn role text",
}
COLUMNS = {t: c.split() for t, c in COLUMNS.items()}
ORDERS_CELLS = ["o_custkey", "o_orderstatus", "o_orderpriority"]
ORDERS_ALL_CELLS = COLUMNS["orders"][1:]
TOLERANCE = 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def all_sets(width: int, sizes=None) -> list[tuple[int, ...]]:
    sizes = sizes or range(1, width + 1)
    return [c for s in sizes for c in combinations(range(width), s)]


def entry(spark: SparkSession) -> DataFrame:
    """Minimal keys of ``orders``."""
    return _keys(D.minimal_keys(table(spark, SMOKE_DIR, "orders")))


# --- output shapes ----------------------------------------------------------------


def _keys(found: DataFrame) -> DataFrame:
    return found.select("combo", F.array_join("names", ",").alias("names"), "mask", "size", "key_error")


def _sets(found: DataFrame) -> DataFrame:
    return found.select("combo", "mask", "size")


def _orders_with_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` with the customer of open and the price of low-priority orders unknown."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.when(F.col("o_orderstatus") != "O", F.col("o_custkey")).alias("custkey"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_totalprice")).alias("price"),
        F.col("o_orderdate").alias("day"),
        F.col("o_orderpriority").alias("priority"),
    )


# --- building blocks the set queries start from -----------------------------------


def _errors(spark, sf_dir, name, sizes=None) -> DataFrame:
    """Errors of the column sets of a table, written once: the set queries read them twice."""
    df = table(spark, sf_dir, name)
    errors = K.key_errors(df, all_sets(len(df.columns), sizes), n_rows=df.count())
    return Stage(spark).put(errors, "errors")


def _pairs(spark, sf_dir, name, keys: bool) -> DataFrame:
    """Pairs of columns that are keys / non-keys."""
    return _errors(spark, sf_dir, name, [2]).where((F.col("key_error") == 0) == F.lit(keys))


def _cells(spark, sf_dir, columns=ORDERS_CELLS) -> DataFrame:
    return L.cells(table(spark, sf_dir, "orders"), "o_orderkey", columns)


def _member(spark, sf_dir, combo) -> DataFrame:
    return L.membership_of_combo(table(spark, sf_dir, "orders"), "o_orderkey", combo)


# --- queries ----------------------------------------------------------------------


def _row_ids(spark, sf_dir):
    rows = prepare.with_row_id(table(spark, sf_dir, "orders"), dense=True)
    return rows.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min("row_id").alias("min_id"),
        F.max("row_id").alias("max_id"),
        F.count_distinct("row_id").alias("n_ids"),
        F.sum("o_orderkey").alias("key_sum"),
    )


def _cluster_rows(spark, sf_dir):
    shown = L.cluster_rows(L.membership(_cells(spark, sf_dir)), show=5)
    return shown.select(
        "col_idx", "cluster_id", F.array_join(F.col("rows").cast("array<string>"), ",").alias("rows")
    )


def _cells_all_columns(spark, sf_dir):
    return _cells(spark, sf_dir, ORDERS_ALL_CELLS)


def _cluster_members(spark, sf_dir):
    return L.cluster_members(L.membership(_cells_all_columns(spark, sf_dir)))


def _intersect_all_columns(spark, sf_dir):
    """Each column with the next one, the last with the first."""
    m = L.membership(_cells_all_columns(spark, sf_dir))
    out, n = None, len(ORDERS_ALL_CELLS)
    for i in range(n):
        both = L.intersect(m.where(F.col("col_idx") == i), m.where(F.col("col_idx") == (i + 1) % n))
        both = both.withColumn("col_idx", F.lit(i))
        out = both if out is None else out.unionByName(both)
    return out


def _intersect(spark, sf_dir):
    m = L.membership(_cells(spark, sf_dir))
    return L.intersect(m.where("col_idx = 1"), m.where("col_idx = 2"))


def _intersect_three(spark, sf_dir):
    m = L.membership(_cells(spark, sf_dir))
    two = L.intersect_membership(m.where("col_idx = 1"), m.where("col_idx = 2"))
    return L.intersect(two, m.where("col_idx = 0")).select("cluster_id", "n")


def _same_clusters(spark, sf_dir):
    """Pairs of columns of ``customer``, and one beside the same split under another name."""
    df = table(spark, sf_dir, "customer").withColumn("segment_code", F.xxhash64("c_mktsegment"))
    pairs = [("c_mktsegment", "segment_code"), ("c_mktsegment", "c_nationkey"), ("c_acctbal", "c_name")]
    out = None
    for a, b in pairs:
        members = [L.membership_of_combo(df, "c_custkey", [c]) for c in (a, b)]
        one = L.same_clusters(*members).select(F.lit(a).alias("a"), F.lit(b).alias("b"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def _cells_of_maps(spark, sf_dir):
    """Equal maps with their entries in another order, nested zeros of either sign."""
    o = table(spark, sf_dir, "orders")
    status, zero = F.col("o_orderstatus"), F.lit(0.0) * F.when(F.col("o_orderkey") % 2 == 0, 1).otherwise(-1)
    turned = F.when(F.col("o_orderkey") % 3 == 0, F.create_map(F.lit("z"), zero, status, F.lit(1.0)))
    maps = F.coalesce(turned, F.create_map(status, F.lit(1.0), F.lit("z"), zero))
    return L.clusters(L.cells(o.select("o_orderkey", maps.alias("m"), F.array(zero).alias("a")), "o_orderkey"))


def _minimal_keys_tolerant_part(spark, sf_dir):
    return _keys(D.minimal_keys(table(spark, sf_dir, "part"), tolerance=TOLERANCE))


def _key_error(spark, sf_dir):
    return K.single_columns(table(spark, sf_dir, "lineitem")).select(
        "col_idx", "col_name", "n_clusters", "key_error"
    )


def _key_error_pairs(spark, sf_dir):
    return _errors(spark, sf_dir, "lineitem", [2]).select("combo", "mask", "n_clusters", "key_error")


def _is_key(spark, sf_dir, tolerance=0):
    errors = _errors(spark, sf_dir, "orders", [1, 2])
    return K.with_verdict(errors, tolerance).select("combo", "key_error", "is_key")


def _nulls_distinct(spark, sf_dir):
    df = _orders_with_nulls(spark, sf_dir)
    return K.key_errors(df, all_sets(4), nulls_equal=False).select("combo", "n_clusters", "key_error")


def _unique_columns(spark, sf_dir):
    return K.unique_columns(table(spark, sf_dir, "customer")).select("col_idx", "col_name")


def _nonunique_mask(spark, sf_dir):
    return K.nonkey_columns(table(spark, sf_dir, "lineitem")).select("combo", "mask", "size")


def _equivalent(spark, sf_dir):
    # the market segment of each customer, and the same split under another name
    df = table(spark, sf_dir, "customer").withColumn("segment_code", F.xxhash64("c_mktsegment"))
    return K.equivalent_columns(df)


def _combos_of_size(spark, sf_dir):
    return _sets(C.combos_of_size(K.nonkey_columns(table(spark, sf_dir, "lineitem")), 2))


def _combos_containing(spark, sf_dir):
    return _sets(C.combos_containing(K.nonkey_columns(table(spark, sf_dir, "lineitem")), [1, 8], 4))


def _direct_supersets(spark, sf_dir):
    return _sets(C.direct_supersets(_pairs(spark, sf_dir, "part", False), cs.universe(6)))


def _direct_subsets(spark, sf_dir):
    triples = _errors(spark, sf_dir, "part", [3]).where("key_error = 0")
    return _sets(C.direct_subsets(triples, keep=[4]))


def _implied_subsets(spark, sf_dir):
    return _sets(C.all_subsets(D.maximal_nonkeys(table(spark, sf_dir, "orders")), 6))


def _implied_supersets(spark, sf_dir):
    return _sets(C.all_supersets(D.minimal_keys(table(spark, sf_dir, "orders")), 6))


def _combo_members(spark, sf_dir):
    return C.members(_pairs(spark, sf_dir, "orders", True), 6)


def _prune_by_known(spark, sf_dir):
    errors = _errors(spark, sf_dir, "orders", [1, 2])
    triples = C.combos_of_size(errors.agg(F.lit(None)).select(cs.universe(6).alias("cols")), 3)
    quads = _errors(spark, sf_dir, "orders", [4]).where("key_error > 0")
    return _sets(C.undecided(triples, errors.where("key_error = 0"), quads))


def _known_lookup(spark, sf_dir):
    singles = K.unique_columns(table(spark, sf_dir, "orders"))
    supersets = C.direct_supersets(singles, cs.universe(6))
    return _sets(C.known(supersets, _pairs(spark, sf_dir, "orders", True)))


def _minimal_combos(spark, sf_dir):
    return _sets(C.minimal(_errors(spark, sf_dir, "orders").where("key_error = 0")))


def _maximal_combos(spark, sf_dir):
    return _sets(C.maximal(_errors(spark, sf_dir, "orders").where("key_error > 0")))


def _complement(spark, sf_dir):
    return _sets(C.complement(_pairs(spark, sf_dir, "part", False), cs.universe(6)))


def _key_overlap(spark, sf_dir, at_least=1, sizes=[2]):
    errors = _errors(spark, sf_dir, "orders", sizes)
    pairs = C.overlapping(errors.where("key_error = 0"), errors.where("key_error > 0"), at_least)
    both = C.combine(pairs, "a_cols", "b_cols")
    return both.select(
        *[
            cs.combo_text(F.col(c)).alias(n)
            for c, n in [
                ("a_cols", "key"), ("b_cols", "nonkey"), ("union_cols", "together"),
                ("common_cols", "common"), ("only_cols", "key_only"),
            ]
        ]
    )


def _key_overlap_two(spark, sf_dir):
    return _key_overlap(spark, sf_dir, 2, [2, 3])


def _keys_ordered(spark, sf_dir):
    return _sets(C.canonical_order(_errors(spark, sf_dir, "orders").where("key_error = 0")))


def _combo_set_ops(spark, sf_dir):
    errors = _errors(spark, sf_dir, "orders", [1, 2, 3])
    exact = errors.where("key_error = 0")
    near = errors.where((F.col("key_error") <= TOLERANCE) & (F.col("size") >= 2))
    return (
        _sets(C.union(exact, near)).withColumn("op", F.lit("union"))
        .unionByName(_sets(C.difference(near, exact)).withColumn("op", F.lit("difference")))
    )


def _minimal_keys(name):
    return lambda spark, sf_dir: _keys(D.minimal_keys(table(spark, sf_dir, name)))


def _maximal_nonkeys(name):
    return lambda spark, sf_dir: _sets(D.maximal_nonkeys(table(spark, sf_dir, name)))


def _minimal_keys_tolerant(spark, sf_dir):
    return _keys(D.minimal_keys(table(spark, sf_dir, "orders"), tolerance=TOLERANCE))


def _maximal_nonkeys_tolerant(spark, sf_dir):
    return _sets(D.maximal_nonkeys(table(spark, sf_dir, "orders"), tolerance=TOLERANCE))


def _minimal_keys_levels(spark, sf_dir):
    return _keys(D.minimal_keys(table(spark, sf_dir, "part"), method="levels"))


def _minimal_keys_evidence(spark, sf_dir):
    return _keys(D.minimal_keys(table(spark, sf_dir, "orders"), method="evidence"))


def _maximal_nonkeys_of_two(spark, sf_dir):
    return _sets(D.maximal_nonkeys(table(spark, sf_dir, "orders"), max_size=2))


def _maximal_nonkeys_without(spark, sf_dir):
    """No set that holds both the customer and the order's date."""
    both = F.array_contains("cols", 1) & F.array_contains("cols", 4)
    return _sets(D.maximal_nonkeys(table(spark, sf_dir, "orders"), exclude=both))


def _minimal_keys_any_order(spark, sf_dir):
    """Rows dealt anew and columns from right to left, the result in the table's own positions."""
    df = table(spark, sf_dir, "part")
    n = len(df.columns)
    found = D.minimal_keys(df.repartition(7, "p_size").select(*reversed(df.columns)))
    own = F.array_sort(F.transform("cols", lambda c: n - 1 - c))
    named = F.transform("own", lambda c: F.array(*[F.lit(x) for x in df.columns])[c])
    found = found.select(own.alias("own"), "key_error")
    return _keys(cs.describe(found.select(F.col("own").alias("cols"), named.alias("names"), "key_error"), "names", "key_error"))


def _maximal_nonkeys_evidence(spark, sf_dir):
    return _sets(D.maximal_nonkeys(table(spark, sf_dir, "part"), method="evidence"))


def _minimal_keys_first_n(spark, sf_dir):
    first = delimited.first_n_columns(table(spark, sf_dir, "lineitem"), 6)
    return _keys(D.minimal_keys(first))


def _minimal_keys_filtered(spark, sf_dir):
    return _keys(D.minimal_keys(table(spark, sf_dir, "part"), exclude=F.array_contains("cols", 0)))


def _minimal_keys_nulls_distinct(spark, sf_dir):
    return _keys(D.minimal_keys(_orders_with_nulls(spark, sf_dir), nulls_equal=False))


def _minimal_keys_text(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    return _keys(D.minimal_keys(prepare.as_text(df)))


def _minimal_keys_text_all_columns(spark, sf_dir):
    return _keys(D.minimal_keys(prepare.as_text(table(spark, sf_dir, "customer"))))


def _verdicts(spark, sf_dir):
    return D.verdicts(table(spark, sf_dir, "orders")).select("combo", "size", "key_error", "is_key")


def _key_count(spark, sf_dir):
    return D.key_count(table(spark, sf_dir, "part"))


def _hitting_sets(spark, sf_dir):
    nonkeys = C.maximal(_errors(spark, sf_dir, "part").where("key_error > 0"))
    return _sets(hitting_sets(nonkeys, 6))


def _key_report(spark, sf_dir):
    return report.key_report(D.minimal_keys(table(spark, sf_dir, "part")))


def _key_report_empty(spark, sf_dir):
    flags = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber")
    return report.key_report(D.minimal_keys(flags))


def _saved_report(spark, sf_dir):
    path = Stage(spark).path("report")
    report.save_report(D.minimal_keys(table(spark, sf_dir, "customer")), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


TEXT_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]


def _as_lines(spark, sf_dir, sep: str, header: str | None) -> str:
    """``orders`` as delimited text with padded fields; every tenth customer's rows are ragged."""
    o = table(spark, sf_dir, "orders").select(*TEXT_COLUMNS)
    padded = [F.concat(F.lit(" "), F.col(c).cast("string"), F.lit("  ")) for c in TEXT_COLUMNS]
    short, long = padded[:3], [*padded, F.lit("more")]
    line = (
        F.when(F.col("o_custkey") % 10 == 3, F.concat_ws(sep, *short))
        .when(F.col("o_custkey") % 10 == 7, F.concat_ws(sep, *long))
        .otherwise(F.concat_ws(sep, *padded))
    )
    path = Stage(spark).path("lines")
    lines = o.select(line.alias("value"))
    if header is None:
        lines.write.text(path)
    else:
        lines.select(F.col("value").alias(header)).write.csv(
            path, header=True, quote="", sep="\u0001", ignoreLeadingWhiteSpace=False,
            ignoreTrailingWhiteSpace=False,
        )
    return path


def _read_comma(spark, sf_dir):
    path = _as_lines(spark, sf_dir, ",", " o_orderkey ,o_custkey, o_orderstatus,o_orderpriority ")
    return delimited.read_comma(spark, path).good


def _read_comma_first_n(spark, sf_dir):
    path = _as_lines(spark, sf_dir, ",", "o_orderkey,o_custkey,o_orderstatus,o_orderpriority")
    return delimited.read_comma(spark, path, 2).good


def _read_rejects(spark, sf_dir):
    path = _as_lines(spark, sf_dir, ",", "o_orderkey,o_custkey,o_orderstatus,o_orderpriority")
    rejects = delimited.read_comma(spark, path).rejects
    n_fields = F.size(F.split("line", ","))
    return rejects.groupBy(n_fields.alias("n_fields")).agg(F.count(F.lit(1)).alias("n_rows"))


def _read_tab(spark, sf_dir):
    path = _as_lines(spark, sf_dir, "\t", "o_orderkey o_custkey  o_orderstatus o_orderpriority")
    return delimited.read_tab(spark, path).good


def _read_fixed(spark, sf_dir):
    path = _as_lines(spark, sf_dir, ",", None)
    return delimited.read_fixed(spark, path).good


def _read_all_columns(spark, sf_dir):
    """All columns of ``orders``, written and read."""
    o = table(spark, sf_dir, "orders")
    path = Stage(spark).path("lines")
    line = F.concat_ws(",", *[F.concat(F.lit(" "), F.col(c).cast("string")) for c in o.columns])
    o.select(line.alias(",".join(o.columns))).write.csv(
        path, header=True, quote="", sep="\u0001", ignoreLeadingWhiteSpace=False
    )
    return delimited.read_comma(spark, path).good


def _as_blank_lines(spark, sf_dir) -> str:
    """The customers of ``orders`` as lines, those of open orders blank."""
    path = Stage(spark).path("lines")
    customer = F.col("o_custkey").cast("string")
    table(spark, sf_dir, "orders").select(
        F.when(F.col("o_orderstatus") == "O", "").otherwise(customer).alias("value")
    ).write.text(path)
    return path


def _read_blank_lines(spark, sf_dir):
    """Blank lines of a one-column text are rows."""
    path = _as_blank_lines(spark, sf_dir)
    return delimited.read_fixed(spark, path, ["custkey"]).good


def _read_blank_rejects(spark, sf_dir):
    """Read with two columns, every such line is a reject, blank ones too."""
    path = _as_blank_lines(spark, sf_dir)
    return delimited.read_fixed(spark, path, ["custkey", "more"]).rejects


def _trim_cells(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(
        "doc_id", F.concat(F.lit(" \t"), "text", F.lit("\n \r")).alias("text")
    )
    return prepare.trim_cells(d)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = own_queries()
    if llm:
        found |= llm.queries()
    if pipeline:
        found["pipeline"] = pipeline.run
    return found


def oracle_sql() -> dict[str, str]:
    found = own_sql()
    if llm:
        found |= llm.oracle_sql()
    if pipeline and pipeline.ORACLE_SQL:
        found["pipeline"] = pipeline.ORACLE_SQL
    return found


def own_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {f"minimal_keys_{t}": _minimal_keys(t) for t in COLUMNS if t != "orders"}
    found |= {f"maximal_nonkeys_{t}": _maximal_nonkeys(t) for t in ("part", "events", "lineitem")}
    return {
        "row_ids": _row_ids,
        "first_n_columns": lambda s, d: delimited.first_n_columns(table(s, d, "customer"), 3),
        "trim_cells": _trim_cells,
        "read_comma": _read_comma,
        "read_comma_first_n": _read_comma_first_n,
        "read_rejects": _read_rejects,
        "read_tab": _read_tab,
        "read_fixed": _read_fixed,
        "read_all_columns": _read_all_columns,
        "read_blank_lines": _read_blank_lines,
        "read_blank_rejects": _read_blank_rejects,
        "row_count": lambda s, d: K.row_count(table(s, d, "lineitem")),
        "cells": _cells,
        "clusters": lambda s, d: L.clusters(_cells(s, d)),
        "membership": lambda s, d: L.membership(_cells(s, d)),
        "cluster_rows": _cluster_rows,
        "cluster_intersect": _intersect,
        "cluster_intersect_three": _intersect_three,
        "cells_all_columns": _cells_all_columns,
        "clusters_all_columns": lambda s, d: L.clusters(_cells_all_columns(s, d)),
        "cluster_members": _cluster_members,
        "cluster_intersect_all_columns": _intersect_all_columns,
        "clusters_of_combo": lambda s, d: L.clusters_of_combo(
            table(s, d, "orders"), "o_orderkey", ["o_custkey", "o_orderpriority"]
        ),
        "membership_of_combo": lambda s, d: _member(s, d, ["o_custkey", "o_orderpriority"]),
        "key_error": _key_error,
        "key_error_pairs": _key_error_pairs,
        "key_error_nulls_distinct": _nulls_distinct,
        "is_key": _is_key,
        "is_key_tolerant": lambda s, d: _is_key(s, d, TOLERANCE),
        "unique_columns": _unique_columns,
        "nonunique_mask": _nonunique_mask,
        "equivalent_columns": _equivalent,
        "combos_of_size": _combos_of_size,
        "combos_containing": _combos_containing,
        "direct_supersets": _direct_supersets,
        "direct_subsets": _direct_subsets,
        "implied_subsets": _implied_subsets,
        "implied_supersets": _implied_supersets,
        "combo_members": _combo_members,
        "prune_by_known": _prune_by_known,
        "known_lookup": _known_lookup,
        "minimal_combos": _minimal_combos,
        "maximal_combos": _maximal_combos,
        "complement": _complement,
        "key_overlap": _key_overlap,
        "key_overlap_two": _key_overlap_two,
        "keys_ordered": _keys_ordered,
        "combo_set_ops": _combo_set_ops,
        "minimal_keys": _minimal_keys("orders"),
        **found,
        "minimal_keys_levels": _minimal_keys_levels,
        "minimal_keys_evidence": _minimal_keys_evidence,
        "maximal_nonkeys_evidence": _maximal_nonkeys_evidence,
        "maximal_nonkeys_of_two": _maximal_nonkeys_of_two,
        "maximal_nonkeys_without": _maximal_nonkeys_without,
        "minimal_keys_any_order": _minimal_keys_any_order,
        "minimal_keys_tolerant": _minimal_keys_tolerant,
        "minimal_keys_tolerant_part": _minimal_keys_tolerant_part,
        "same_clusters": _same_clusters,
        "cells_of_maps": _cells_of_maps,
        "minimal_keys_first_n": _minimal_keys_first_n,
        "minimal_keys_filtered": _minimal_keys_filtered,
        "minimal_keys_nulls_distinct": _minimal_keys_nulls_distinct,
        "minimal_keys_text": _minimal_keys_text,
        "minimal_keys_text_all_columns": _minimal_keys_text_all_columns,
        "maximal_nonkeys": _maximal_nonkeys("orders"),
        "maximal_nonkeys_tolerant": _maximal_nonkeys_tolerant,
        "verdicts": _verdicts,
        "key_count": _key_count,
        "hitting_sets": _hitting_sets,
        "key_report": _key_report,
        "key_report_empty": _key_report_empty,
        "saved_report": _saved_report,
    }


# --- DuckDB SQL -------------------------------------------------------------------


def _counts(source: str, columns: list[str], sizes=None) -> str:
    """CTEs ``e(mask, combo, size, n_clusters, key_error)`` over column sets of ``source``."""
    n = len(columns)
    sets = ", ".join("(" + ", ".join(columns[i] for i in c) + ")" for c in all_sets(n, sizes))
    return f"""
g AS (SELECT grouping_id({", ".join(reversed(columns))}) AS gid, count(*) AS n
      FROM {source} GROUP BY GROUPING SETS ({sets})),
e0 AS (SELECT CAST({2**n - 1} - gid AS BIGINT) AS mask,
              CAST(count(*) FILTER (WHERE n > 1) AS BIGINT) AS n_clusters,
              CAST(sum(n - 1) AS BIGINT) AS key_error FROM g GROUP BY gid),
e AS (SELECT mask, {_combo("mask", n)} AS combo, CAST(bit_count(mask) AS INTEGER) AS size,
             n_clusters, key_error FROM e0)"""


def _combo(mask: str, n: int) -> str:
    return f"array_to_string([i FOR i IN range({n}) IF ({mask} >> i) & 1 = 1], ',')"


def _with(ctes: str, body: str) -> str:
    return f"WITH {ctes.strip()}\n{body}"


def _minimal_where(k: int = 0) -> str:
    return (
        f"key_error <= {k} AND NOT EXISTS (SELECT 1 FROM e v WHERE v.key_error <= {k} "
        "AND v.mask <> u.mask AND (u.mask & v.mask) = v.mask)"
    )


def _maximal_where(k: int = 0) -> str:
    return (
        f"key_error > {k} AND NOT EXISTS (SELECT 1 FROM e v WHERE v.key_error > {k} "
        "AND v.mask <> u.mask AND (u.mask & v.mask) = u.mask)"
    )


def _names(columns: list[str]) -> str:
    listed = ", ".join(f"'{c}'" for c in columns)
    n = len(columns)
    return f"array_to_string([[{listed}][i + 1] FOR i IN range({n}) IF (mask >> i) & 1 = 1], ',')"


def _sql_keys(source: str, columns: list[str], k: int = 0, extra: str = "") -> str:
    return _with(
        _counts(source, columns),
        f"SELECT combo, {_names(columns)} AS names, mask, size, key_error FROM e u "
        f"WHERE {_minimal_where(k)} {extra}",
    )


def _sql_same(a: str, b: str) -> str:
    def members(c: str) -> str:
        return (
            f"(SELECT * FROM (SELECT c_custkey, min(c_custkey) OVER (PARTITION BY {c}) AS k, "
            f"count(*) OVER (PARTITION BY {c}) AS n FROM "
            "(SELECT *, hash(c_mktsegment) AS segment_code FROM customer)) WHERE n > 1)"
        )

    return (
        f"SELECT '{a}' AS a, '{b}' AS b, count(x.c_custkey) AS n_a, count(y.c_custkey) AS n_b, "
        "count(*) FILTER (x.k IS DISTINCT FROM y.k) = 0 AS same_signature, "
        "count(*) FILTER (x.k IS DISTINCT FROM y.k) AS n_other, "
        "count(*) FILTER (x.k IS DISTINCT FROM y.k) = 0 AS same "
        f"FROM {members(a)} x FULL JOIN {members(b)} y USING (c_custkey)"
    )


def _sql_nonkeys(source: str, columns: list[str], k: int = 0) -> str:
    return _with(
        _counts(source, columns), f"SELECT combo, mask, size FROM e u WHERE {_maximal_where(k)}"
    )


def _sql_sets(source: str, n: int, body: str, sizes=None, columns=None) -> str:
    """Column sets computed as masks: ``body`` yields ``mask`` and may read ``e`` and ``all_sets``."""
    return _with(
        _counts(source, columns or COLUMNS[source], sizes)
        + f",\nall_sets AS (SELECT CAST(i AS BIGINT) AS mask FROM range(1, {2**n}) r(i)),\n"
        + f"s AS ({body})",
        f"SELECT DISTINCT {_combo('mask', n)} AS combo, mask, CAST(bit_count(mask) AS INTEGER) AS size FROM s",
    )


_CELLS_SQL = """
cells AS (
  SELECT o_orderkey AS row_id, CAST(0 AS INTEGER) AS col_idx, 'o_custkey' AS col_name,
         CAST(o_custkey AS VARCHAR) AS value FROM orders
  UNION ALL SELECT o_orderkey, 1, 'o_orderstatus', o_orderstatus FROM orders
  UNION ALL SELECT o_orderkey, 2, 'o_orderpriority', o_orderpriority FROM orders),
clusters AS (
  SELECT col_idx, col_name, value, min(row_id) AS cluster_id, count(*) AS n
  FROM cells GROUP BY ALL HAVING count(*) > 1),
membership AS (
  SELECT c.col_idx, c.col_name, c.row_id, k.cluster_id
  FROM cells c JOIN clusters k ON c.col_idx = k.col_idx AND c.value IS NOT DISTINCT FROM k.value)"""

_ALL_CELLS_SQL = (
    "all_cells AS ("
    + " UNION ALL ".join(
        f"SELECT o_orderkey AS row_id, CAST({i} AS INTEGER) AS col_idx, '{c}' AS col_name, "
        f"CAST({c} AS VARCHAR) AS value FROM orders"
        for i, c in enumerate(ORDERS_ALL_CELLS)
    )
    + """),
all_clusters AS (
  SELECT col_idx, col_name, value, min(row_id) AS cluster_id, count(*) AS n
  FROM all_cells GROUP BY ALL HAVING count(*) > 1),
all_members AS (
  SELECT c.col_idx, c.col_name, c.row_id, k.cluster_id FROM all_cells c
  JOIN all_clusters k ON c.col_idx = k.col_idx AND c.value IS NOT DISTINCT FROM k.value)"""
)

_GOOD = "o_custkey % 10 <> 3 AND o_custkey % 10 <> 7"

_NULL_ORDERS = """(SELECT CASE WHEN o_orderstatus <> 'O' THEN o_custkey END AS custkey,
 CASE WHEN o_orderpriority <> '5-LOW' THEN o_totalprice END AS price,
 o_orderdate AS day, o_orderpriority AS priority FROM orders)"""
_NULL_COLUMNS = ["custkey", "price", "day", "priority"]


def _sql_nulls_distinct() -> str:
    """CTE ``e`` where a row with a null in the set repeats nothing."""
    parts = []
    for c in all_sets(4):
        cols = ", ".join(_NULL_COLUMNS[i] for i in c)
        full = " AND ".join(f"{_NULL_COLUMNS[i]} IS NOT NULL" for i in c)
        parts.append(
            f"SELECT CAST({sum(1 << i for i in c)} AS BIGINT) AS mask, "
            f"'{','.join(map(str, c))}' AS combo, CAST({len(c)} AS INTEGER) AS size, "
            "CAST(count(*) FILTER (WHERE n > 1) AS BIGINT) AS n_clusters, "
            "CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS key_error "
            f"FROM (SELECT count(*) AS n FROM t WHERE {full} GROUP BY {cols})"
        )
    return f"t AS {_NULL_ORDERS}, e AS ({' UNION ALL '.join(parts)})"


def own_sql() -> dict[str, str]:
    part, orders, customer, lineitem = (
        COLUMNS[t] for t in ("part", "orders", "customer", "lineitem")
    )
    found = {f"minimal_keys_{t}": _sql_keys(t, c) for t, c in COLUMNS.items() if t != "orders"}
    found |= {f"maximal_nonkeys_{t}": _sql_nonkeys(t, COLUMNS[t]) for t in ("part", "events", "lineitem")}
    line_single = _counts("lineitem", lineitem, [1])
    nonkey_columns = "SELECT CAST(sum(mask) AS BIGINT) AS m FROM e WHERE key_error > 0"
    report_line = "'ColumnCombinationBitset {' || replace(combo, ',', ', ') || '}' AS line"
    text_columns = ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in TEXT_COLUMNS)
    customer_text = ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"]
    return {
        "row_ids": "SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS min_id, count(*) - 1 AS max_id, "
        "count(*) AS n_ids, CAST(sum(o_orderkey) AS BIGINT) AS key_sum FROM orders",
        "first_n_columns": "SELECT c_custkey, c_name, c_nationkey FROM customer",
        "trim_cells": "SELECT doc_id, regexp_replace(text, '^[\\x00-\\x20]+|[\\x00-\\x20]+\\z', '', 'g') "
        "AS text FROM documents",
        "read_comma": f"SELECT {text_columns} FROM orders WHERE {_GOOD}",
        "read_comma_first_n": "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, "
        f"CAST(o_custkey AS VARCHAR) AS o_custkey FROM orders WHERE {_GOOD}",
        "read_rejects": "SELECT CAST(CASE o_custkey % 10 WHEN 3 THEN 3 ELSE 5 END AS INTEGER) AS n_fields, "
        "count(*) AS n_rows FROM orders WHERE o_custkey % 10 IN (3, 7) GROUP BY 1",
        "read_tab": f"SELECT {text_columns} FROM orders WHERE {_GOOD}",
        "read_fixed": "SELECT CAST(o_orderkey AS VARCHAR) AS Age, CAST(o_custkey AS VARCHAR) AS Name, "
        f'o_orderstatus AS Job, o_orderpriority AS Country FROM orders WHERE {_GOOD}',
        "read_all_columns": "SELECT " + ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in orders) + " FROM orders",
        "read_blank_lines": "SELECT CASE WHEN o_orderstatus = 'O' THEN '' ELSE CAST(o_custkey AS VARCHAR) END "
        "AS custkey FROM orders",
        "read_blank_rejects": "SELECT CASE WHEN o_orderstatus = 'O' THEN '' ELSE CAST(o_custkey AS VARCHAR) END "
        "AS line FROM orders",
        "row_count": "SELECT count(*) AS n_rows FROM lineitem",
        "cells": _with(_CELLS_SQL, "SELECT * FROM cells"),
        "clusters": _with(_CELLS_SQL, "SELECT * FROM clusters"),
        "membership": _with(_CELLS_SQL, "SELECT * FROM membership"),
        "cluster_rows": _with(
            _CELLS_SQL,
            "SELECT col_idx, cluster_id, string_agg(CAST(row_id AS VARCHAR), ',' ORDER BY row_id) AS rows "
            "FROM (SELECT *, row_number() OVER (PARTITION BY col_idx, cluster_id ORDER BY row_id) AS r "
            "FROM membership) WHERE r <= 5 GROUP BY ALL",
        ),
        "cluster_intersect": _with(
            _CELLS_SQL,
            "SELECT a.cluster_id AS cluster_a, b.cluster_id AS cluster_b, min(a.row_id) AS cluster_id, "
            "count(*) AS n FROM membership a JOIN membership b ON a.row_id = b.row_id "
            "WHERE a.col_idx = 1 AND b.col_idx = 2 GROUP BY 1, 2 HAVING count(*) > 1",
        ),
        "cluster_intersect_three": "SELECT min(o_orderkey) AS cluster_id, count(*) AS n FROM orders "
        "GROUP BY o_custkey, o_orderstatus, o_orderpriority HAVING count(*) > 1",
        "cells_all_columns": _with(_ALL_CELLS_SQL, "SELECT * FROM all_cells"),
        "clusters_all_columns": _with(_ALL_CELLS_SQL, "SELECT * FROM all_clusters"),
        "cluster_members": _with(
            _ALL_CELLS_SQL, "SELECT col_idx, col_name, cluster_id, row_id FROM all_members"
        ),
        "cluster_intersect_all_columns": _with(
            _ALL_CELLS_SQL,
            "SELECT a.cluster_id AS cluster_a, b.cluster_id AS cluster_b, min(a.row_id) AS cluster_id, "
            "count(*) AS n, a.col_idx FROM all_members a JOIN all_members b ON a.row_id = b.row_id "
            f"AND b.col_idx = (a.col_idx + 1) % {len(ORDERS_ALL_CELLS)} GROUP BY 1, 2, 5 HAVING count(*) > 1",
        ),
        "clusters_of_combo": "SELECT o_custkey, o_orderpriority, min(o_orderkey) AS cluster_id, "
        "count(*) AS n FROM orders GROUP BY 1, 2 HAVING count(*) > 1",
        "membership_of_combo": "SELECT row_id, cluster_id FROM (SELECT o_orderkey AS row_id, "
        "min(o_orderkey) OVER w AS cluster_id, count(*) OVER w AS n FROM orders "
        "WINDOW w AS (PARTITION BY o_custkey, o_orderpriority)) WHERE n > 1",
        "key_error": _with(
            line_single,
            "SELECT CAST(combo AS INTEGER) AS col_idx, "
            f"{_names(lineitem)} AS col_name, n_clusters, key_error FROM e",
        ),
        "key_error_pairs": _with(
            _counts("lineitem", lineitem, [2]), "SELECT combo, mask, n_clusters, key_error FROM e"
        ),
        "key_error_nulls_distinct": _with(
            _sql_nulls_distinct(), "SELECT combo, n_clusters, key_error FROM e"
        ),
        "is_key": _with(
            _counts("orders", orders, [1, 2]), "SELECT combo, key_error, key_error <= 0 AS is_key FROM e"
        ),
        "is_key_tolerant": _with(
            _counts("orders", orders, [1, 2]),
            f"SELECT combo, key_error, key_error <= {TOLERANCE} AS is_key FROM e",
        ),
        "unique_columns": _with(
            _counts("customer", customer, [1]),
            f"SELECT CAST(combo AS INTEGER) AS col_idx, {_names(customer)} AS col_name "
            "FROM e WHERE key_error = 0",
        ),
        "nonunique_mask": _with(
            line_single + f", m AS ({nonkey_columns})",
            f"SELECT {_combo('m', 11)} AS combo, m AS mask, CAST(bit_count(m) AS INTEGER) AS size FROM m",
        ),
        "equivalent_columns": _with(
            "t AS (SELECT *, hash(c_mktsegment) AS segment_code FROM customer),"
            + _counts("t", [*customer, "segment_code"], [1, 2])
            + f", c AS (SELECT i AS idx, [{', '.join(repr(c) for c in [*customer, 'segment_code'])}][i + 1] AS name "
            "FROM range(6) r(i))",
            "SELECT CAST(a.idx AS INTEGER) AS a_idx, CAST(b.idx AS INTEGER) AS b_idx, a.name AS a_name, "
            "b.name AS b_name, ab.key_error FROM c a JOIN c b ON a.idx < b.idx "
            "JOIN e ea ON ea.mask = 1 << a.idx JOIN e eb ON eb.mask = 1 << b.idx "
            "JOIN e ab ON ab.mask = (1 << a.idx) + (1 << b.idx) "
            "WHERE ab.key_error = ea.key_error AND ab.key_error = eb.key_error",
        ),
        "combos_of_size": _sql_sets(
            "lineitem", 11,
            f"SELECT mask FROM all_sets, ({nonkey_columns}) WHERE bit_count(mask) = 2 AND (mask & m) = mask",
            [1],
        ),
        "combos_containing": _sql_sets(
            "lineitem", 11,
            f"SELECT mask FROM all_sets, ({nonkey_columns}) WHERE bit_count(mask) = 4 "
            f"AND (mask & m) = mask AND (mask & {(1 << 1) + (1 << 8)}) = {(1 << 1) + (1 << 8)}",
            [1],
        ),
        "direct_supersets": _sql_sets(
            "part", 6,
            "SELECT a.mask FROM all_sets a JOIN e ON e.key_error > 0 "
            "AND (a.mask & e.mask) = e.mask AND bit_count(a.mask) = 3",
            [2],
        ),
        "direct_subsets": _sql_sets(
            "part", 6,
            "SELECT a.mask FROM all_sets a JOIN e ON e.key_error = 0 "
            "AND (a.mask & e.mask) = a.mask AND bit_count(a.mask) = 2 AND (a.mask & 16) = 16",
            [3],
        ),
        "implied_subsets": _with(
            _counts("orders", orders), "SELECT combo, mask, size FROM e WHERE key_error > 0"
        ),
        "implied_supersets": _with(
            _counts("orders", orders), "SELECT combo, mask, size FROM e WHERE key_error = 0"
        ),
        "combo_members": _with(
            _counts("orders", orders, [2]),
            "SELECT combo, size, CAST(i AS INTEGER) AS col_idx, (mask >> i) & 1 = 1 AS is_member "
            "FROM e, range(6) r(i) WHERE key_error = 0",
        ),
        "prune_by_known": _sql_sets(
            "orders", 6,
            "SELECT mask FROM all_sets a WHERE bit_count(mask) = 3 "
            "AND NOT EXISTS (SELECT 1 FROM e WHERE size < 3 AND key_error = 0 AND (a.mask & e.mask) = e.mask) "
            "AND NOT EXISTS (SELECT 1 FROM e WHERE size = 4 AND key_error > 0 AND (a.mask & e.mask) = a.mask)",
            [1, 2, 4],
        ),
        "known_lookup": _sql_sets(
            "orders", 6,
            "SELECT p.mask FROM e p WHERE p.size = 2 AND p.key_error = 0 AND EXISTS "
            "(SELECT 1 FROM e u WHERE u.size = 1 AND u.key_error = 0 AND (p.mask & u.mask) = u.mask)",
            [1, 2],
        ),
        "minimal_combos": _with(
            _counts("orders", orders), f"SELECT combo, mask, size FROM e u WHERE {_minimal_where()}"
        ),
        "maximal_combos": _sql_nonkeys("orders", orders),
        "complement": _sql_sets(
            "part", 6, "SELECT CAST(63 - mask AS BIGINT) AS mask FROM e WHERE key_error > 0", [2]
        ),
        "key_overlap": _with(
            _counts("orders", orders, [2]),
            f"SELECT k.combo AS key, n.combo AS nonkey, {_combo('(k.mask | n.mask)', 6)} AS together, "
            f"{_combo('(k.mask & n.mask)', 6)} AS common, {_combo('(k.mask & (63 - n.mask))', 6)} AS key_only "
            "FROM e k JOIN e n ON k.key_error = 0 AND n.key_error > 0 AND (k.mask & n.mask) <> 0",
        ),
        "key_overlap_two": _with(
            _counts("orders", orders, [2, 3]),
            f"SELECT k.combo AS key, n.combo AS nonkey, {_combo('(k.mask | n.mask)', 6)} AS together, "
            f"{_combo('(k.mask & n.mask)', 6)} AS common, {_combo('(k.mask & (63 - n.mask))', 6)} AS key_only "
            "FROM e k JOIN e n ON k.key_error = 0 AND n.key_error > 0 AND bit_count(k.mask & n.mask) >= 2",
        ),
        "keys_ordered": _with(
            _counts("orders", orders),
            "SELECT combo, mask, size FROM e WHERE key_error = 0 ORDER BY size, combo",
        ),
        "combo_set_ops": _with(
            _counts("orders", orders, [1, 2, 3])
            + f", near AS (SELECT * FROM e WHERE key_error <= {TOLERANCE} AND size >= 2)",
            "SELECT combo, mask, size, 'union' AS op FROM e WHERE key_error = 0 "
            f"OR (key_error <= {TOLERANCE} AND size >= 2) "
            "UNION ALL SELECT combo, mask, size, 'difference' FROM near WHERE key_error > 0",
        ),
        "minimal_keys": _sql_keys("orders", orders),
        **found,
        "minimal_keys_levels": _sql_keys("part", part),
        "minimal_keys_evidence": _sql_keys("orders", orders),
        "maximal_nonkeys_evidence": _sql_nonkeys("part", part),
        "maximal_nonkeys_of_two": _with(
            _counts("orders", orders, [1, 2]), f"SELECT combo, mask, size FROM e u WHERE {_maximal_where()}"
        ),
        "maximal_nonkeys_without": _with(
            _counts("orders", orders) + ", a AS (SELECT * FROM e WHERE (mask & 18) <> 18)",
            f"SELECT combo, mask, size FROM a u WHERE {_maximal_where().replace('FROM e ', 'FROM a ')}",
        ),
        "minimal_keys_any_order": _sql_keys("part", part),
        "minimal_keys_tolerant": _sql_keys("orders", orders, TOLERANCE),
        "minimal_keys_tolerant_part": _sql_keys("part", part, TOLERANCE),
        "same_clusters": " UNION ALL ".join(
            _sql_same(*pair)
            for pair in [("c_mktsegment", "segment_code"), ("c_mktsegment", "c_nationkey"), ("c_acctbal", "c_name")]
        ),
        "cells_of_maps": """
SELECT 0 AS col_idx, 'm' AS col_name, '{"' || o_orderstatus || '":1.0,"z":0.0}' AS value,
    min(o_orderkey) AS cluster_id, count(*) AS n FROM orders GROUP BY o_orderstatus HAVING count(*) > 1
UNION ALL SELECT 1, 'a', '[0.0]', min(o_orderkey), count(*) FROM orders HAVING count(*) > 1""",
        "minimal_keys_first_n": _sql_keys("lineitem", lineitem[:6]),
        "minimal_keys_filtered": _sql_keys("part", part, extra="AND (mask & 1) = 0"),
        "minimal_keys_nulls_distinct": _with(
            _sql_nulls_distinct(),
            f"SELECT combo, {_names(_NULL_COLUMNS)} AS names, mask, size, key_error FROM e u "
            f"WHERE {_minimal_where()}",
        ),
        "minimal_keys_text": _sql_keys("customer", customer_text),
        "minimal_keys_text_all_columns": _sql_keys("customer", customer),
        "maximal_nonkeys": _sql_nonkeys("orders", orders),
        "maximal_nonkeys_tolerant": _sql_nonkeys("orders", orders, TOLERANCE),
        "verdicts": _with(
            _counts("orders", orders),
            "SELECT combo, size, key_error, key_error <= 0 AS is_key FROM e u WHERE NOT EXISTS "
            "(SELECT 1 FROM e v WHERE v.key_error = 0 AND v.mask <> u.mask AND (u.mask & v.mask) = v.mask)",
        ),
        "key_count": _with(
            _counts("part", part), f"SELECT count(*) AS n_keys FROM e u WHERE {_minimal_where()}"
        ),
        "hitting_sets": _with(
            _counts("part", part), f"SELECT combo, mask, size FROM e u WHERE {_minimal_where()}"
        ),
        "key_report": _with(
            _counts("part", part),
            f"SELECT combo, {report_line}, replace({_names(part)}, ',', ', ') AS names FROM e u "
            f"WHERE {_minimal_where()}",
        ),
        "key_report_empty": _with(
            _counts("lineitem", ["l_returnflag", "l_linestatus", "l_linenumber"])
            + f", k AS (SELECT * FROM e u WHERE {_minimal_where()})",
            f"SELECT combo, {report_line}, '' AS names FROM k UNION ALL "
            "SELECT '', 'No unique column combinations found!', '' WHERE NOT EXISTS (SELECT 1 FROM k)",
        ),
        "saved_report": _with(
            _counts("customer", customer), f"SELECT {report_line} FROM e u WHERE {_minimal_where()}"
        ),
    }
