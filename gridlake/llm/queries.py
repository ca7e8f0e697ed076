"""The operators as queries over the tables of a folder, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import fmindex, forest, lattice, mixing, packing, quality, rules, suffix, toxicity, warc


def _read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_quality_classifier(spark, folder):
    return quality.quality_classifier(_read(spark, folder, "documents"), _read(spark, folder, "labels"))


def op2_toxicity(spark, folder):
    return toxicity.toxicity(_read(spark, folder, "documents"), _read(spark, folder, "labels"))


def op3_packing(spark, folder):
    return packing.packed_digest(spark, _read(spark, folder, "documents"))


def op4_embedding_near_dedup(spark, folder):
    return lattice.embedding_near_dups(spark, _read(spark, folder, "embeddings"))


def op5_warc(spark, folder):
    return warc.archive_round_trip(spark, _read(spark, folder, "pages"))


def op6_substring_dedup(spark, folder):
    return fmindex.repeated_words(spark, _read(spark, folder, "documents"))


def op7_quality_rules(spark, folder):
    return rules.quality_rules(_read(spark, folder, "documents"))


def op8_suffix_array_dedup(spark, folder):
    return suffix.repeated_bytes(spark, _read(spark, folder, "documents"))


def op9_minhash_near_dedup(spark, folder):
    return forest.near_duplicates(spark, _read(spark, folder, "documents"))


def op10_mixing(spark, folder):
    return mixing.mix(spark, _read(spark, folder, "documents"))


def queries() -> dict:
    every = (
        op1_quality_classifier, op2_toxicity, op3_packing, op4_embedding_near_dedup, op5_warc, op6_substring_dedup,
        op7_quality_rules, op8_suffix_array_dedup, op9_minhash_near_dedup, op10_mixing,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    """SQL for the operators that it can express, in DuckDB's dialect.

    The others are compared in the tests with brute force (3, 8, 10), by their rules and by held-out
    accuracy (1, 2).
    """
    return SQL


#: Words in RE2's syntax, and the reach of each vertex of ``links`` (a, b; both directions) among ``nodes`` (id).
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_REACH = """reach AS (SELECT id, id AS v FROM nodes UNION SELECT r.id, l.b FROM reach r JOIN links l ON l.a = r.v),
least AS (SELECT id, min(v) AS component_id FROM reach GROUP BY 1)"""
_RULE = "CASE WHEN {b} > 0 THEN {a} / {b}::DOUBLE ELSE 0.0::DOUBLE END AS {name}"


def _rules_sql() -> str:
    stop = ", ".join(f"'{w}'" for w in sorted(set(rules.STOP_WORDS)))
    count = lambda of, test: f"len(list_filter({of}, lambda x: {test}))"
    ratios = (
        ("mean_word_length", "word_chars", "n_words"), ("symbol_ratio", "n_symbols", "n_words"), ("exclamation_ratio", "(length(t) - length(replace(t, '!', '')))", "n_words"),
        ("upper_ratio", count("w", "x = upper(x) AND x <> lower(x)"), "n_words"), ("stop_word_ratio", count("w", f"lower(x) IN ({stop})"), "n_words"),
        ("dup_line_ratio", "n_dup_lines", "len(rows)"), ("bullet_line_ratio", count("rows", r"regexp_matches(x, '^[ \t\n\x0B\f\r]*[-*•]')"), "len(rows)"),
        ("ellipsis_line_ratio", count("rows", r"regexp_matches(x, '(\.\.\.|…)[ \t\n\x0B\f\r]*$')"), "len(rows)"),
    )
    within = [f"{c} >= {lo}" for c, lo, _ in rules.THRESHOLDS if lo is not None] + [f"{c} <= {hi}" for c, _, hi in rules.THRESHOLDS if hi is not None]
    return f"""WITH p AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS rows FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM p WHERE len(w) > 2),
h AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM g),
r AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS k FROM h WHERE n > 1) GROUP BY 1),
b AS (SELECT p.*, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
 len(rows) - len(list_distinct(rows)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words FROM p LEFT JOIN r USING (doc_id)),
s AS (SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {", ".join(_RULE.format(name=n, a=a, b=b) for n, a, b in ratios)},
 n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b)
SELECT *, NOT base_failed AND {" AND ".join(within)} AS kept FROM s"""


def _base32(sha: str) -> str:
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    return f"list_reduce(list_transform(range(32), lambda k: substr('{letters}', ((('0x' || substr({sha}, (k // 4 * 5 + 1)::INT, 5))::BIGINT >> (15 - 5 * (k % 4))) & 31)::INT + 1, 1)), lambda x, y: x || y)"


SQL: dict[str, str] = {
    "op4_embedding_near_dedup": f"""WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
nodes AS (SELECT vec_id AS id FROM v),
u AS (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS e FROM v
 WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_sum(list_transform(e, lambda y: y * y)) > 0),
links AS (SELECT p.vec_id AS a, q.vec_id AS b FROM u p JOIN u q ON p.vec_id <> q.vec_id AND len(p.e) = len(q.e) WHERE list_inner_product(p.e, q.e) >= 0.95),
n AS (SELECT a, count(*) AS n FROM links GROUP BY 1), {_REACH}
SELECT id AS vec_id, coalesce(n.n, 0) AS n_links, component_id, id = component_id AS kept FROM least LEFT JOIN n ON a = id""",
    "op5_warc": f"""WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS s FROM pages),
g AS (SELECT s, max(page_id) AS answer FROM p GROUP BY 1)
SELECT page_id, octet_length(encode(h)) AS payload_bytes, {_base32("p.s")} AS payload_digest,
 CASE WHEN page_id = answer THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> answer THEN answer END AS refers_to FROM p JOIN g USING (s)""",
    "op6_substring_dedup": f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS i, w FROM d WHERE len(w) >= 20),
h AS (SELECT doc_id, i, row_number() OVER (PARTITION BY md5(array_to_string(w[i:i + 19], ' ')) ORDER BY doc_id, i) AS k FROM g),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS place FROM h WHERE k > 1),
x AS (SELECT doc_id, list(place) AS gone FROM c GROUP BY 1),
y AS (SELECT doc_id, len(w) AS n, CASE WHEN gone IS NULL THEN w ELSE list_select(w, list_sort(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(gone, i)))) END AS kept FROM d LEFT JOIN x USING (doc_id))
SELECT doc_id, n AS n_words, n - len(kept) AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM y""",
    "op7_quality_rules": _rules_sql(),
    "op9_minhash_near_dedup": f"""WITH RECURSIVE d AS (SELECT doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
nodes AS (SELECT id FROM d),
s AS (SELECT DISTINCT id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT p.id AS a, q.id AS b, count(*) AS c FROM s p JOIN s q ON p.g = q.g AND p.id <> q.id GROUP BY 1, 2),
links AS (SELECT a, b FROM c JOIN n p ON p.id = a JOIN n q ON q.id = b WHERE 100 * c >= 85 * (p.n + q.n - c)), {_REACH}
SELECT least.id AS doc_id, coalesce(n.n, 0) AS n_shingles, component_id, least.id = component_id AS kept FROM least LEFT JOIN n ON n.id = least.id""",
}
