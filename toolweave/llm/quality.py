"""Line-first cleaning with DataFrame expressions only.

Every line is judged by three rules: punctuation (a tenth of its characters or more are symbols and exclamation
marks), navigation (a menu of separators, or a few words without an end mark) and boilerplate (a known phrase).
Failing lines go; a document that loses more than half of its characters that way is rejected, and so is one that
fails the base limits on length and repetition. Everything is computed inside the row: no shuffle at any size, and
time and memory follow the length of a text (n log n for a text with repeated windows).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from toolweave.llm.common import table, without

SPACE = r"[ \t-\r]"
# Fixed phrases of page furniture.
BOILERPLATE = (
    "all rights reserved",
    "click here",
    "cookie policy",
    "cookies",
    "enable javascript",
    "lorem ipsum",
    "powered by",
    "privacy policy",
    "sign up",
    "subscribe",
    "terms of service",
    "terms of use",
)
SYMBOLS = r"[^#*$%&|<>]+"
MARKS = r"[^#*$%&|<>!]+"
END_MARK = r"[.!?:;,\x22')\]»…。！？]\s*$"
FEW_WORDS = 3
OUTPUTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_lines", "lost_chars", "line_chars", "kept_text", "kept")


def _others(text: Column, rest: str) -> Column:
    """How many characters of text are not of the pattern `rest`."""
    return F.length(F.regexp_replace(text, rest, ""))


def _fails(line: Column) -> Column:
    words = F.size(F.split(F.trim(F.regexp_replace(line, SPACE + "+", " ")), " "))
    punctuation = 10 * _others(line, MARKS) >= F.length(line)
    navigation = (3 * _others(line, r"[^|»›·]+") >= words) & line.rlike("[|»›·]") | (words <= FEW_WORDS) & ~line.rlike(END_MARK)
    boilerplate = line.rlike("(?i)" + "|".join(BOILERPLATE))
    return punctuation | navigation | boilerplate


def judge(docs: DataFrame, text_col: str = "text", least_words: int = 10, window: int = 5, most_repeated: int = 20, most_lost: int = 50) -> DataFrame:
    """docs with counts, kept_text (the lines that pass, joined by \\n) and kept.

    A null or empty text has no words, fails the base limits and has an empty kept_text. Repeated rows are judged
    alike. Input columns named like an output are replaced.
    """
    docs = without(docs, *(n for n in OUTPUTS if n != text_col))
    names = [c for c in docs.columns if c not in OUTPUTS]
    text = F.coalesce(F.col(text_col), F.lit(""))
    cut = docs.withColumns(
        {
            "__t": text,
            "__w": F.array_remove(F.split(text, SPACE + "+"), ""),
            "__lines": F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^ \t-\r]")),
        }
    )
    n_windows = F.size("__w") - (window - 1)
    hashes = F.when(n_windows > 1, F.transform(F.sequence(F.lit(1), n_windows), lambda i: F.xxhash64(*[F.get("__w", i + (k - 1)) for k in range(window)])))
    counted = cut.withColumns(
        {
            "__h": hashes,
            "__judged": F.transform("__lines", lambda x: F.struct(x.alias("line"), F.length(x).alias("size"), _fails(x).alias("fails"))),
        }
    )
    places = F.when(
        F.size(F.array_distinct("__h")) < F.size("__h"),
        F.sort_array(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
    )
    sorted_ = counted.withColumn("__s", places)
    again = F.filter(
        F.transform(
            "__s",
            lambda x, k: F.when(
                (F.get("__s", k - 1)["h"] == x["h"]) | (F.get("__s", k + 1)["h"] == x["h"]),
                x["i"],
            ),
        ),
        lambda x: x.isNotNull(),
    )
    repeated = sorted_.withColumn("__r", F.sort_array(again))
    covered = F.aggregate(
        F.transform("__r", lambda x, k: F.least(F.lit(window), F.coalesce(F.get("__r", k + 1) - x, F.lit(window)))),
        F.lit(0).cast("long"),
        lambda a, x: a + x,
    )
    measured = repeated.select(
        *[F.col(f"`{c}`") for c in names],
        F.size("__w").cast("long").alias("n_words"),
        F.length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        _others(F.col("__t"), SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("__lines").cast("long").alias("n_lines"),
        F.aggregate("__judged", F.lit(0).cast("long"), lambda a, x: a + F.when(x["fails"], x["size"]).otherwise(0)).alias("lost_chars"),
        F.aggregate("__judged", F.lit(0).cast("long"), lambda a, x: a + x["size"]).alias("line_chars"),
        F.array_join(F.transform(F.filter("__judged", lambda x: ~x["fails"]), lambda x: x["line"]), "\n").alias("kept_text"),
    )
    base_failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    return measured.withColumn("base_failed", base_failed).withColumn(
        "kept", ~F.col("base_failed") & (100 * F.col("lost_chars") <= most_lost * F.col("line_chars"))
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


ORACLE_SQL = r"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
words AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM docs),
windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS win
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM words WHERE len(w) >= 5)),
twice AS (SELECT doc_id, win FROM windows GROUP BY doc_id, win HAVING count(*) > 1),
repeated AS (
  SELECT doc_id, count(DISTINCT p) AS n
  FROM (SELECT w.doc_id, unnest(range(w.i, w.i + 5)) AS p FROM windows w JOIN twice t ON w.doc_id = t.doc_id AND w.win = t.win) GROUP BY doc_id),
lines AS (
  SELECT doc_id, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM docs) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
judged AS (
  SELECT doc_id, line, length(line) AS size,
    10 * length(regexp_replace(line, '[^#*$%&|<>!]+', '', 'g')) >= length(line)
    OR (3 * length(regexp_replace(line, '[^|»›·]+', '', 'g')) >= n AND regexp_matches(line, '[|»›·]'))
    OR (n <= 3 AND NOT regexp_matches(line, '[.!?:;,\x22'')\]»…。！？]\s*$'))
    OR regexp_matches(line, '(?i)all rights reserved|click here|cookie policy|cookies|enable javascript|lorem ipsum|powered by|privacy policy|sign up|subscribe|terms of service|terms of use')
    AS fails FROM lines),
by_line AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS dup, sum(CASE WHEN fails THEN size ELSE 0 END) AS lost, sum(size) AS chars FROM judged GROUP BY doc_id),
counts AS (
  SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(length(array_to_string(w.w, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(w.t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(b.dup, 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, coalesce(b.lost, 0) AS lost, coalesce(b.chars, 0) AS chars
  FROM words w LEFT JOIN repeated r USING (doc_id) LEFT JOIN by_line b USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND 100 * lost <= 50 * chars AS kept
FROM counts
"""
