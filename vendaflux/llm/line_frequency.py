"""Quality rules: measures of each text, and lines that too many documents of one host share.

Lines are normalised (white space to one space, lower case) and hashed; Spark counts for each host and line the
distinct documents that hold it, documents with one text counting once.  A line is above the limits if more than
``SHARE`` of the host's distinct documents and more than ``LEAST`` of them hold it.  Such lines are removed; a document
that keeps less than ``REMAINS`` of its words is depleted and rejected.  The host of a document is its source.

Only DataFrame functions are used.  Words and windows of a text are handled as arrays within its row; between rows move
only (host, line hash, text hash), combined before they are shuffled.  Windows and lines are compared by 64-bit hashes.

Cases: a null or empty text has no words, all measures are 0, and it fails the base rules.  A null source is a host of
its own.  Repeated rows, and rows with a null id, give a row each.  Extra columns are ignored.  No rows give no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vendaflux.llm.common import SPACE, text_of, written

#: White space of the contract, and characters that count as symbols (fixed values).
BLANKS, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
#: Words in a window; least words of a text; share of repeated words, in percent, above which a text fails.
WINDOW, LEAST_WORDS, REPEATED_PERCENT = 3, 50, 50
#: A line is boilerplate above this share of its host's documents, and above this many of them.
SHARE, LEAST = 0.05, 20
#: A document that keeps a smaller share of its words is depleted.
REMAINS = 0.3


def words_of(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once: a name in a lambda is bound, a column is put in wherever it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words that lie in a window found twice or more.  ``words`` must be bound (see ``let``)."""
    def covered(prints: Column) -> Column:
        placed = F.sort_array(F.transform(prints, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
        return let(placed, lambda p: let(F.sort_array(F.transform(F.filter(p, lambda x, i: twin(p, x, i)), lambda x: x["at"])), total))

    def twin(placed: Column, x: Column, i: Column) -> Column:
        beside = [F.coalesce(x["h"] == F.get(placed, i + k)["h"], F.lit(False)) for k in (-1, 1)]
        return beside[0] | beside[1]

    def total(starts: Column) -> Column:
        fresh = F.transform(starts, lambda a, i: F.least(F.lit(window), F.coalesce(F.get(starts, i + 1) - a, F.lit(window))))
        return F.aggregate(fresh, F.lit(0), lambda s, x: s + x)

    prints = F.transform(words, lambda w, i: F.xxhash64(w, *[F.get(words, i + k) for k in range(1, window)]))
    windows = F.slice(prints, F.lit(1), F.greatest(F.size(words) - (window - 1), F.lit(0)))
    return let(windows, lambda p: F.when(F.size(F.array_distinct(p)) < F.size(p), covered(p)).otherwise(0))


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Per row: ``row, doc_id, host, print`` (of the text), the measures, and ``lines``: hash and number of words of each
    line that has a word."""
    def of_words(words: Column) -> Column:
        return F.struct(F.size(words).alias("n"), F.aggregate(words, F.lit(0), lambda s, w: s + F.length(w)).alias("chars"), repeated_words(words).alias("repeated"))

    def of_lines(split: Column) -> Column:
        normal = F.transform(split, lambda x: F.lower(F.regexp_replace(F.btrim(x, F.lit(BLANKS)), SPACE, " ")))
        return F.struct((F.size(split) - F.size(F.array_distinct(split))).alias("twice"),
                        F.transform(normal, lambda x: F.struct(F.xxhash64(x).alias("line"), (F.length(x) - F.length(F.replace(x, F.lit(" "))) + 1).alias("words"))).alias("lines"))

    text = F.col("text")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), text_of(text_col).alias("text"))
    split = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    return rows.select(
        "row", "doc_id", "host", F.xxhash64("text").alias("print"), let(words_of(text), of_words).alias("w"), let(split, of_lines).alias("l"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"))


def common_lines(measured: DataFrame, share: float = SHARE, least: int = LEAST) -> DataFrame:
    """``host, line`` of the lines above the limits."""
    documents = measured.groupBy("host").agg(F.count_distinct("print").alias("documents"))
    held = measured.select("host", "print", F.explode(F.array_distinct(F.transform("lines", lambda x: x["line"]))).alias("line"))
    counted = held.groupBy("host", "line").agg(F.count_distinct("print").alias("n")).where(F.col("n") > least)
    return (counted.alias("c").join(documents.alias("d"), F.col("c.host").eqNullSafe(F.col("d.host")))
            .where(F.col("n") > share * F.col("documents")).select("c.host", "line"))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Per row: ``doc_id``, the measures, ``base_failed``, ``removed_words`` (of lines above the limits) and ``kept``."""
    measured = written(measures(docs, id_col, text_col, host_col), "quality_rows")
    measured = measured.select("row", "doc_id", "host", "print", F.col("l.lines").alias("lines"), "n_symbols", *[F.col(x).cast("long").alias(name) for name, x in (
        ("n_words", "w.n"), ("word_chars", "w.chars"), ("n_repeat_words", "w.repeated"), ("n_dup_lines", "l.twice"))])
    common = written(common_lines(measured), "quality_lines")
    lines = measured.select("row", "host", F.explode("lines").alias("x")).select("row", "host", "x.line", "x.words")
    # a host's lines above the limits number at most 1 / SHARE times the lines of its mean document
    removed = (lines.alias("a").join(common.alias("b"), (F.col("a.line") == F.col("b.line")) & F.col("a.host").eqNullSafe(F.col("b.host")))
               .groupBy("row").agg(F.sum("words").alias("removed_words")))
    n = F.col("n_words")
    failed = (n < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * n)
    judged = measured.drop("lines").join(removed, "row", "left").withColumn("removed_words", F.coalesce("removed_words", F.lit(0).cast("long")))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "removed_words",
                         (~failed & (n - F.col("removed_words") >= REMAINS * n)).alias("kept"))


#: The same rows from DuckDB, which compares lines and windows themselves.
SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, source,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents
), w AS (
  SELECT r, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM d
), g AS (
  SELECT r, pos, count(*) OVER (PARTITION BY r, word, w2, w3) AS n
  FROM (SELECT r, pos, word, lead(word) OVER o AS w2, lead(word, 2) OVER o AS w3 FROM w WINDOW o AS (PARTITION BY r ORDER BY pos)) WHERE w3 IS NOT NULL
), again AS (
  SELECT r, count(DISTINCT pos + k) AS n_repeat_words FROM (SELECT r, pos, unnest([0, 1, 2]) AS k FROM g WHERE n > 1) GROUP BY r
), l AS (
  SELECT r, source, text, line, lower(trim(regexp_replace(line, '[\\x20\\x09-\\x0D]+', ' ', 'g'))) AS normal
  FROM (SELECT r, source, text, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')
), twice AS (
  SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM l GROUP BY r
), common AS (
  SELECT source, normal, count(DISTINCT text) AS n FROM l GROUP BY ALL
), hosts AS (
  SELECT source, count(DISTINCT text) AS documents FROM d GROUP BY source
), above AS (
  SELECT c.source, normal FROM common c JOIN hosts h ON c.source IS NOT DISTINCT FROM h.source WHERE n > {LEAST} AND n > {SHARE} * documents
), removed AS (
  SELECT r, sum(len(string_split(l.normal, ' '))) AS removed_words FROM l JOIN above a ON a.normal = l.normal AND a.source IS NOT DISTINCT FROM l.source GROUP BY r
), m AS (
  SELECT r, doc_id, len(words) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols FROM d
), j AS (
  SELECT m.*, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, CAST(coalesce(removed_words, 0) AS BIGINT) AS removed_words,
         n_words < {LEAST_WORDS} OR 100 * coalesce(n_repeat_words, 0) > {REPEATED_PERCENT} * n_words AS base_failed
  FROM m LEFT JOIN twice USING (r) LEFT JOIN again USING (r) LEFT JOIN removed USING (r)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, removed_words,
       NOT base_failed AND n_words - removed_words >= {REMAINS} * n_words AS kept FROM j
"""
