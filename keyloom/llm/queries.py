"""The registered queries of this subpackage and the DuckDB SQL of those SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm import (
    decontaminate,
    html_text,
    licenses,
    line_dedup,
    mixing,
    near_dedup,
    packing,
    prefix_trie,
    quality,
    suffix_dedup,
    token_counts,
    token_store,
    whitening,
)
from keyloom.staging import Stage

VOCABULARY = "word_bpe_49k.json"  # of the public tokenizers
BYTE_VOCABULARY = "byte_bpe_50k.json"


def vocabulary(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark, sf_dir):
    return suffix_dedup.digest(table(spark, sf_dir, "documents"))


def op2_decontaminate(spark, sf_dir):
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontaminate.digest(docs, items)


def op3_quality_rules(spark, sf_dir):
    judged = quality.judge(table(spark, sf_dir, "documents"))
    return judged.drop("char_distance", "word_distance")


def op4_token_counts(spark, sf_dir):
    return token_counts.counts(table(spark, sf_dir, "documents"), vocabulary())


def op5_html_text(spark, sf_dir):
    return html_text.extract(table(spark, sf_dir, "pages"))


def op6_mixing(spark, sf_dir):
    return mixing.taken(table(spark, sf_dir, "documents"))


def op7_near_dedup(spark, sf_dir):
    return near_dedup.groups(table(spark, sf_dir, "documents"))


def op8_token_store(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return token_store.read_documents(token_store.write_shards(docs, Stage(spark), vocabulary()))


def op9_license_scan(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"))


def op10_line_dedup(spark, sf_dir):
    return line_dedup.digest(table(spark, sf_dir, "documents"))


def op11_best_fit_packing(spark, sf_dir):
    return packing.digest(table(spark, sf_dir, "documents"), vocabulary(BYTE_VOCABULARY))


def op12_prefix_trie(spark, sf_dir):
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


def op13_whitening(spark, sf_dir):
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_suffix_dedup": op1_suffix_dedup,
        "op2_decontaminate": op2_decontaminate,
        "op3_quality_rules": op3_quality_rules,
        "op4_token_counts": op4_token_counts,
        "op5_html_text": op5_html_text,
        "op6_mixing": op6_mixing,
        "op7_near_dedup": op7_near_dedup,
        "op8_token_store": op8_token_store,
        "op9_license_scan": op9_license_scan,
        "op10_line_dedup": op10_line_dedup,
        "op11_best_fit_packing": op11_best_fit_packing,
        "op12_prefix_trie": op12_prefix_trie,
        "op13_whitening": op13_whitening,
    }


# ---- SQL ---------------------------------------------------------------------------------------

_GAP = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _ctes(parts: dict[str, str], prefix: str = "") -> str:
    return ",\n".join(f"{prefix}{name} AS MATERIALIZED ({sql})" for name, sql in parts.items())


def sql_decontaminate(source: str = "documents") -> dict[str, str]:
    """CTEs; the last, ``d_rows``, has the rows of op2."""
    low = _LOWER.format("text")
    return {
        "d_docs": f"SELECT doc_id, regexp_extract_all({low}, '{_GAP}') AS w FROM {source}",
        "d_items": f"SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, "
        f"regexp_extract_all({low}, '{_GAP}') AS w FROM benchmark",
        "d_windows": "SELECT DISTINCT item, w[i:i + 9] AS win, len(w[i:i + 9]) AS n FROM "
        "(SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM d_items "
        "WHERE len(w) > 0)",
        "d_found": "SELECT DISTINCT p.doc_id, p.i, v.n, v.item FROM "
        "(SELECT d.doc_id, d.w, s.n, unnest(range(1, len(d.w) - s.n + 2)) AS i FROM d_docs d, "
        "(SELECT DISTINCT n FROM d_windows) s WHERE len(d.w) >= s.n) p "
        "JOIN d_windows v ON v.n = p.n AND v.win = p.w[p.i:p.i + p.n - 1]",
        "d_spots": "SELECT doc_id, count(DISTINCT k) AS n_hit FROM "
        "(SELECT doc_id, unnest(range(i, i + n)) AS k FROM d_found) GROUP BY doc_id",
        "d_listed": "SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS l "
        "FROM (SELECT DISTINCT doc_id, item FROM d_found) GROUP BY doc_id",
        "d_rows": "SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, "
        "CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit, "
        "CAST(coalesce(l.n_items, 0) AS BIGINT) AS n_items, "
        "sha256(coalesce(l.l, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated "
        "FROM d_docs d LEFT JOIN d_spots h USING (doc_id) LEFT JOIN d_listed l USING (doc_id)",
    }


def _js(p: str, q: str, n: int) -> str:
    """Jensen-Shannon distance of two lists of counts, as text."""
    terms = []
    for i in range(1, n + 1):
        x, y = f"({p}[{i}] / list_sum({p}))", f"({q}[{i}] / list_sum({q}))"
        for a, b in ((x, y), (y, x)):
            terms.append(f"CASE WHEN {a} > 0 THEN {a} * log2({a} / (({a} + {b}) / 2)) ELSE 0 END")
    return (
        f"CASE WHEN list_sum({p}) > 0 AND list_sum({q}) > 0 THEN "
        f"sqrt(greatest(({' + '.join(terms)}) / 2, 0)) END"
    )


def sql_quality(source: str = "documents") -> dict[str, str]:
    """CTEs; the last, ``q_rows``, has the rows of op3."""
    lists = "CASE lang_key " + "".join(
        f"WHEN '{lang}' THEN {list(words)} " for lang, words in quality.COMMON.items()
    )
    counts = {
        "n_symbols": "[#*$%&|<>]",
        "n_digits": "[0-9]",
        "n_upper": "[A-Z]",
        "n_marks": """[.,;:!?''"()-]""",
    }
    found = ", ".join(
        f"len(regexp_extract_all(text, '{cls}')) AS {name}" for name, cls in counts.items()
    )
    c_sums = ", ".join(f"sum(chars[{i}])" for i in range(1, 7))
    w_sums = ", ".join(f"sum(common[{i}])" for i in range(1, 14))
    bins = ", ".join(f"len(list_filter(w, lambda x: x = known[{i}]))" for i in range(1, 13))
    return {
        "q_docs": "SELECT doc_id, coalesce(text, '') AS text, "
        "CASE WHEN lang IN ('en', 'de', 'fr', 'es') THEN lang ELSE 'rest' END AS lang_key, "
        r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w "
        f"FROM {source}",
        "q_wins": "SELECT doc_id, i, w[i:i + 7] AS win FROM (SELECT doc_id, w, "
        "unnest(range(1, len(w) - 6)) AS i FROM q_docs WHERE len(w) >= 8)",
        "q_twice": "SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS next FROM "
        "(SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM q_wins) "
        "WHERE n > 1",
        "q_repeats": "SELECT doc_id, sum(least(8, coalesce(next - i, 8))) AS n FROM q_twice "
        "GROUP BY doc_id",
        "q_base": "SELECT d.*, len(w) AS n_words, "
        "coalesce(list_sum(list_transform(w, lambda x: len(x))), 0) AS word_chars, "
        f"{found}, coalesce(r.n, 0) AS n_repeat_words, "
        "list_filter(string_split(text, chr(10)), "
        r"lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS spoken, "
        f"{lists} END AS known FROM q_docs d LEFT JOIN q_repeats r USING (doc_id)",
        "q_feats": "SELECT *, [len(text) - word_chars, n_symbols, n_digits, n_upper, n_marks, "
        "word_chars - n_symbols - n_digits - n_upper - n_marks] AS chars, "
        f"CASE WHEN known IS NULL THEN [{', '.join('0' * 12)}, len(w)] ELSE list_concat([{bins}], "
        "[len(list_filter(w, lambda x: NOT list_contains(known, x)))]) END AS common FROM q_base",
        "q_refs": f"SELECT lang_key, [{c_sums}] AS rc, [{w_sums}] AS rw FROM q_feats "
        "GROUP BY lang_key",
        "q_far": "SELECT f.*, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, "
        f"CASE WHEN len(text) >= {quality.MIN_CHARS} THEN {_js('chars', 'rc', 6)} END AS cd, "
        f"CASE WHEN n_words >= {quality.MIN_WORDS} AND lang_key <> 'rest' "
        f"THEN {_js('common', 'rw', 13)} END AS wd FROM q_feats f JOIN q_refs USING (lang_key)",
        "q_rows": "SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, "
        "CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, "
        "CAST(len(spoken) - len(list_distinct(spoken)) AS BIGINT) AS n_dup_lines, "
        "CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, "
        f"NOT base_failed AND NOT coalesce(cd > {quality.MAX_CHAR_DISTANCE}, false) "
        f"AND NOT coalesce(wd > {quality.MAX_WORD_DISTANCE}, false) AS kept FROM q_far",
    }


def sql_licenses(source: str = "documents") -> str:
    rows = ", ".join(
        "('{}', '{}')".format(name, text.replace("'", "''"))
        for name, texts in licenses.TEMPLATES.items()
        for text in texts
    )
    low = _LOWER.format("text")
    grams = (
        "CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1] || ' '] ELSE list_distinct("
        "list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END"
    )
    return f"""
WITH t AS (SELECT name, {grams} AS g FROM (SELECT name, regexp_extract_all({low}, '{_GAP}') AS w
    FROM (VALUES {rows}) v(name, text))),
lines AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS l
    FROM {source}),
units AS (SELECT doc_id, unnest(l) AS text, unnest(range(len(l))) AS unit FROM lines
    UNION ALL SELECT doc_id, text, -1 FROM lines WHERE len(l) > 1),
own AS (SELECT doc_id, unit, {grams} AS g FROM
    (SELECT doc_id, unit, regexp_extract_all({low}, '{_GAP}') AS w FROM units)),
found AS (SELECT doc_id, unit, name FROM own o, t WHERE len(o.g) > 0
    AND 2.0 * len(list_intersect(o.g, t.g)) / (len(o.g) + len(t.g)) >= {licenses.THRESHOLD}),
listed AS (SELECT doc_id, count(DISTINCT unit) AS n,
    string_agg(DISTINCT name, ',' ORDER BY name) AS names FROM found GROUP BY doc_id)
SELECT doc_id, CAST(len(l) AS BIGINT) AS n_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_matches,
    coalesce(names, '') AS licenses FROM lines LEFT JOIN listed USING (doc_id)"""


def sql_line_dedup() -> str:
    blank = r"[\x20\x09-\x0D]+"
    key = _LOWER.format(f"regexp_replace(line, '^{blank}|{blank}$', '', 'g')")
    return f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
lines AS (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS i FROM d),
keyed AS MATERIALIZED (SELECT doc_id, i, line, {key} AS k FROM lines),
frequent AS (SELECT k FROM keyed WHERE k <> '' GROUP BY k
    HAVING count(DISTINCT doc_id) >= {line_dedup.MIN_DOCS})
SELECT doc_id, count(*) AS n_lines, count(f.k) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (f.k IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN frequent f ON f.k = keyed.k GROUP BY doc_id"""


# CRC-32 of a text, bit by bit.
_CRC = (
    "xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), "
    "list_transform(range(1, len({0}) + 1), lambda i: CAST(ord({0}[i]) AS BIGINT))), "
    "lambda a, c: list_reduce([xor(a, c), 0, 0, 0, 0, 0, 0, 0, 0], "
    "lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)))"
)


def sql_prefix_trie() -> str:
    return f"""
WITH own AS (SELECT conv_id, list({{'r': coalesce(role, ''), 'x': coalesce(text, '')}}
    ORDER BY turn NULLS FIRST) AS w FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
taken AS (SELECT *, {_CRC.format("CAST(conv_id AS VARCHAR)")} % 9 AS h, conv_id - conv_id % 5 AS origin
    FROM own),
built AS (SELECT t.conv_id, list_concat(coalesce(o.w, [])[1:t.h], t.w[t.h + 1:]) AS path
    FROM taken t LEFT JOIN own o ON o.conv_id = t.origin),
prefixes AS (SELECT conv_id, path, unnest(range(len(path) + 1)) AS d FROM built),
nodes AS MATERIALIZED (SELECT d, path[1:d] AS pre, min(conv_id) AS low, count(*) AS n,
    string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len(path) = d) AS ends
    FROM prefixes GROUP BY ALL),
kids AS (SELECT d - 1 AS d, pre[1:d - 1] AS pre, count(*) AS k FROM nodes WHERE d > 0 GROUP BY ALL),
full_nodes AS (SELECT nodes.*, coalesce(k, 0) AS k FROM nodes LEFT JOIN kids USING (d, pre)),
above AS (SELECT *, unnest(range(d + 1)) AS a FROM full_nodes),
sums AS (SELECT a AS d, pre[1:a] AS pre, sum(CAST(k = 0 AS BIGINT)) AS leaves,
    sum(CASE WHEN d > 0 THEN (n - 1) * strlen(pre[d].x) ELSE 0 END) AS saved FROM above GROUP BY ALL)
SELECT f.low AS conv_id, f.d AS depth, p.low AS parent_conv_id, f.n AS n_convs, f.k AS n_children,
    CAST(s.leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens,
    sha256(coalesce(f.ends, '')) AS ends_sha256
FROM full_nodes f JOIN sums s ON s.d = f.d AND s.pre = f.pre
LEFT JOIN nodes p ON p.d = f.d - 1 AND p.pre = f.pre[1:f.d - 1]"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_decontaminate": f"WITH {_ctes(sql_decontaminate())}\nSELECT * FROM d_rows",
        "op3_quality_rules": f"WITH {_ctes(sql_quality())}\nSELECT * FROM q_rows",
        "op9_license_scan": sql_licenses(),
        "op10_line_dedup": sql_line_dedup(),
        "op12_prefix_trie": sql_prefix_trie(),
    }
