"""Quality rules: a threshold table compiled into one projection of built-in functions.

Words are runs of characters other than ASCII white space, lines are split at newlines. Nothing
here leaves the JVM: the text is read once, split into words and lines once, and every ratio is an
expression over those arrays. No row is shuffled.

Null or empty text has no words: all counts are 0, so ``base_failed`` is true and ``kept`` false.
Repeated rows give repeated results. An empty table gives an empty table with the same columns.
Extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD

#: Common function words of the four languages served.
STOP_WORDS = (
    "the of and to in is that for it with as on be by this are or an a at from was which "
    "der die das und ist von zu den mit ein auf im "
    "le la les des est et un une que de par dans "
    "el los las y es por con para una del que en"
).split()

#: (statistic, lowest, highest): a document is kept when every statistic lies in its closed range.
THRESHOLDS = (
    ("n_words", 50, 1_000_000),
    ("mean_word_length", 3.0, 7.0),
    ("symbol_ratio", None, 0.1),
    ("exclamation_ratio", None, 0.2),
    ("upper_ratio", None, 0.3),
    ("stop_word_ratio", 0.02, None),
    ("dup_line_ratio", None, 0.4),
    ("bullet_line_ratio", None, 0.9),
    ("ellipsis_line_ratio", None, 0.3),
)


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once: as the variable of a lambda over one element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeated(words: Column) -> Column:
    """Words covered by a 3-word window that is found at least twice.

    Windows are compared by a 64-bit hash of their three words. Most texts repeat none, which one
    hash set tells. Else the windows are sorted with their positions; equal neighbours mark the
    repeated ones, and the union of [i, i+2] over their sorted positions is the sum of
    min(3, gap to the next).
    """

    def count(w: Column) -> Column:
        hashes = F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
        return _let(F.slice(hashes, 1, F.size(w) - 2), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(several(h)))

    def several(h: Column) -> Column:
        return _let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), starts)

    def starts(s: Column) -> Column:
        def marked(h: Column) -> Column:
            return F.filter(s, lambda x, k: x["h"].eqNullSafe(F.get(h, k + 1)) | x["h"].eqNullSafe(F.get(h, k - 1)))

        return _let(F.sort_array(_let(s["h"], marked)["i"]), covered)

    def covered(at: Column) -> Column:
        n = F.size(at)
        gaps = F.transform(F.slice(at, 2, n - 1), lambda b, k: F.least(b - F.get(at, k), F.lit(3)))
        return F.when(n < 2, 3 * n).otherwise(3 + F.aggregate(gaps, F.lit(0), lambda x, y: x + y))

    return F.when(F.size(words) < 4, F.lit(0)).otherwise(_let(words, count))


def statistics(text: Column) -> Column:
    """One struct of all counts of a text."""
    stop = sorted(set(STOP_WORDS))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))

    def body(p: Column) -> Column:
        words, lines = p["words"], p["lines"]
        n, chars, rows = F.size(words), F.length(F.array_join(words, "")), F.size(lines)
        n_symbols = F.length(p["text"]) - F.length(F.regexp_replace(p["text"], "[#*$%&|<>]+", ""))
        dup = rows - F.size(F.array_distinct(lines))
        return F.struct(
            n.cast("long").alias("n_words"),
            chars.cast("long").alias("word_chars"),
            n_symbols.cast("long").alias("n_symbols"),
            dup.cast("long").alias("n_dup_lines"),
            _repeated(words).cast("long").alias("n_repeat_words"),
            ratio(chars, n).alias("mean_word_length"),
            ratio(n_symbols, n).alias("symbol_ratio"),
            ratio(F.length(p["text"]) - F.length(F.replace(p["text"], F.lit("!"), F.lit(""))), n).alias("exclamation_ratio"),
            ratio(F.size(F.filter(words, lambda w: (w == F.upper(w)) & (w != F.lower(w)))), n).alias("upper_ratio"),
            ratio(F.size(F.filter(words, lambda w: F.lower(w).isin(stop))), n).alias("stop_word_ratio"),
            ratio(dup, rows).alias("dup_line_ratio"),
            ratio(F.size(F.filter(lines, lambda x: x.rlike(r"^\s*[-*•]"))), rows).alias("bullet_line_ratio"),
            ratio(F.size(F.filter(lines, lambda x: x.rlike(r"(\.\.\.|…)\s*$"))), rows).alias("ellipsis_line_ratio"),
        )

    text = F.coalesce(text, F.lit(""))
    parsed = F.struct(
        text.alias("text"),
        F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1)).alias("words"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD)).alias("lines"),
    )
    return _let(parsed, body)


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", thresholds=THRESHOLDS) -> DataFrame:
    """Every document with its statistics, ``base_failed`` and ``kept``.

    ``base_failed``: fewer than 50 words, or over half of them in repeated 3-word windows.
    ``kept``: not ``base_failed``, and every statistic within the table's range.
    """
    out = docs.select(F.col(id_col), statistics(F.col(text_col)).alias("s")).select(id_col, "s.*")
    out = out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    within = [F.col(c) >= lo for c, lo, _ in thresholds if lo is not None] + [F.col(c) <= hi for c, _, hi in thresholds if hi is not None]
    return out.withColumn("kept", ~F.col("base_failed") & reduce(lambda a, b: a & b, within))
