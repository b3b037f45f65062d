"""Quality rules by line-first cleaning; DataFrame functions only.

Each line is judged by itself, and lines that fail are taken out of the text:

* punctuation: a line must end like a sentence, and may hold no more than a mark of exclamation
  or question for two words nor a symbol for three words (two of either are always allowed);
* navigation: separators stand between its words (two or more, one for four words), or it is a
  short line that says no more than the name of a link;
* boilerplate: a line of at most forty words with a notice of rights, licences, cookies and the like.

A document that loses more than ``max_lost`` of its characters (white space aside) with these lines
is rejected; so is one that fails the base rules: fewer than 50 words, or more than half
of the words in windows of three words that its text holds twice or more.

All of it is a projection: lines and words are arrays within their row, so nothing is shuffled,
and repeated windows are found by sorting the windows of a text with their places.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavemill.llm.common import word_count

SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
ENDS = ".!?…。！？؟।"  # a line ends with one of these,
CLOSERS = " \t\n\x0b\f\r\"'”’»)]"  # but for some of these after it
MARK = r"[!?！？]"
SEPARATOR = r"[\x20\x09][|>»›•·/]+[\x20\x09]"
LINK = r"(?i)^[\x20\x09-\x0D]*(home|menu|log ?in|sign ?in|sign up|register|search|next|previous|prev|read more|show more|back to top|go back|share|print|sitemap|contact us|about us|skip to content|skip to main content)[\x20\x09-\x0D.…!?>»]*$"
NOTICES = (
    "all rights reserved", "copyright ©", "copyright (c)", "copyright 19", "copyright 20", "© 19", "© 20", "©19", "©20", "licensed under", "licenced under",
    "released under the", "this work is licensed", "terms of use", "terms of service", "privacy policy", "cookie policy", "use of cookies", "uses cookies", "accept cookies",
    "accept all cookies", "enable javascript", "powered by", "subscribe to our", "sign up for our", "follow us on", "lorem ipsum",
)
MIN_WORDS, WINDOW = 50, 3


def line_facts(line: Column) -> Column:
    """What the rules ask of a line, counted once."""
    counts = {"marks": MARK, "symbols": SYMBOL, "separators": SEPARATOR}
    return F.struct(line.alias("line"), word_count(line).alias("n"), *(F.regexp_count(line, F.lit(p)).alias(c) for c, p in counts.items()))


def failing_rule(facts: Column) -> Column:
    """The rule that a line of these facts fails (punctuation, navigation or boilerplate), or
    null; a line without words fails none."""
    line, n, marks, symbols, separators = (facts[c] for c in ("line", "n", "marks", "symbols", "separators"))
    notice = reduce(Column.__or__, (F.contains(F.lower(line), F.lit(x)) for x in NOTICES))
    ends = F.right(F.rtrim(line, F.lit(CLOSERS)), F.lit(1)).isin(*ENDS)
    return (
        F.when(n == 0, F.lit(None).cast("string"))
        .when((n <= 40) & notice, F.lit("boilerplate"))
        .when((separators >= 2) & (4 * separators >= n) | (n <= 5) & line.rlike(LINK), F.lit("navigation"))
        .when(~ends | (marks > 2) & (2 * marks > n) | (symbols > 2) & (3 * symbols > n), F.lit("punctuation"))
    )


def sorted_windows(words: Column, n: Column) -> Column:
    """Windows of three words with their places, in the order of their words."""
    last = F.greatest(n - WINDOW + 1, F.lit(1)).cast("int")
    return F.sort_array(F.arrays_zip(*(F.slice(words, i + 1, last).alias(f"w{i}") for i in range(WINDOW)), F.sequence(F.lit(0), last - 1).alias("at")))


def repeated_words(ordered: Column, n: Column) -> Column:
    """How many of a text's n words lie in windows that it holds twice or more."""
    size = F.size(ordered)
    pairs = F.arrays_zip(F.slice(ordered, F.lit(1), size - 1).alias("a"), F.slice(ordered, F.lit(2), size - 1).alias("b"))
    same = F.filter(pairs, lambda p: (p["a"]["w0"] == p["b"]["w0"]) & (p["a"]["w1"] == p["b"]["w1"]) & (p["a"]["w2"] == p["b"]["w2"]))
    covered = F.flatten(F.transform(same, lambda p: F.array(*(p[side]["at"] + i for side in "ab" for i in range(WINDOW)))))
    return F.when(n > WINDOW, F.size(F.array_distinct(covered))).otherwise(0).cast("long")


def clean_lines(docs: DataFrame, max_lost: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, n_failed_lines, lost_chars, kept, text (its lines that passed).

    A null text counts as empty; a text without words fails the base rules.  Rows that repeat
    are judged each, a null id stays null, other columns are not read, and an empty table
    gives no rows.  Texts are read whole, of any length that a row can hold."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    rows = rows.withColumn("words", F.regexp_extract_all("t", F.lit(WORD), F.lit(0))).withColumn("lines", F.split("t", "\n"))
    rows = rows.withColumn("n_words", F.size("words").cast("long")).withColumn("full", F.filter("lines", lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    # What is used twice stands in a projection of its own, so that Spark computes it once.
    rows = rows.withColumn("facts", F.transform("lines", line_facts)).withColumn("ordered", sorted_windows(F.col("words"), F.col("n_words")))
    rows = rows.withColumn("failed", F.transform(F.filter("facts", lambda x: failing_rule(x).isNotNull()), lambda x: x["line"]))
    chars = lambda text: F.length(F.regexp_replace(text, SPACE + "+", "")).cast("long")
    rows = rows.select(
        "doc_id", "n_words", chars(F.col("t")).alias("word_chars"), F.regexp_count("t", F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        (F.size("full") - F.size(F.array_distinct("full"))).cast("long").alias("n_dup_lines"), repeated_words(F.col("ordered"), F.col("n_words")).alias("n_repeat_words"),
        F.size("failed").cast("long").alias("n_failed_lines"), chars(F.array_join("failed", " ")).alias("lost_chars"),
        F.array_join(F.transform(F.filter("facts", lambda x: failing_rule(x).isNull()), lambda x: x["line"]), "\n").alias("text"),
    )
    rows = rows.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    kept = ~F.col("base_failed") & (F.col("lost_chars") <= F.lit(float(max_lost)) * F.col("word_chars"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_failed_lines", "lost_chars", kept.alias("kept"), "text")


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_NOTICE = " OR ".join(f"contains(lower(x), {_quoted(p)})" for p in NOTICES)
_CLOSERS = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || " + _quoted("".join(c for c in CLOSERS if c >= " "))


ORACLE_SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT doc_id, t, regexp_extract_all(t, {_quoted(WORD)}) AS words, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, {_quoted(WORD)})) AS lines FROM d
), k AS (
  SELECT row_number() OVER () AS k, * FROM w
), win AS (
  SELECT k, i, list_slice(words, i, i + 2) AS v FROM (SELECT k, words, unnest(range(1, len(words) - 1)) AS i FROM k)
), rep AS (
  SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, v) AS m FROM win) WHERE m > 1
), cov AS (
  SELECT k, count(DISTINCT p) AS n FROM (SELECT k, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY k
), l AS (
  SELECT k, x, len(regexp_extract_all(x, {_quoted(WORD)})) AS n, len(regexp_extract_all(x, {_quoted(MARK)})) AS marks,
    len(regexp_extract_all(x, {_quoted(SYMBOL)})) AS symbols, len(regexp_extract_all(x, {_quoted(SEPARATOR)})) AS seps
  FROM (SELECT k, unnest(lines) AS x FROM k)
), bad AS (
  SELECT k, count(*) AS n, sum(length(regexp_replace(x, {_quoted(SPACE + '+')}, '', 'g'))) AS lost FROM l
  WHERE (n <= 40 AND ({_NOTICE})) OR (seps >= 2 AND 4 * seps >= n) OR (n <= 5 AND regexp_matches(x, {_quoted(LINK)}))
    OR NOT contains({_quoted(ENDS)}, right(rtrim(x, {_CLOSERS}), 1)) OR rtrim(x, {_CLOSERS}) = '' OR (marks > 2 AND 2 * marks > n) OR (symbols > 2 AND 3 * symbols > n)
  GROUP BY k
), f AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, {_quoted(SPACE + '+')}, '', 'g')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(t, {_quoted(SYMBOL)})) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(bad.n, 0) AS BIGINT) AS n_failed_lines, CAST(coalesce(bad.lost, 0) AS BIGINT) AS lost_chars
  FROM k LEFT JOIN cov USING (k) LEFT JOIN bad USING (k)
), b AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f
)
SELECT *, NOT base_failed AND lost_chars <= 0.5 * word_chars AS kept FROM b
"""
