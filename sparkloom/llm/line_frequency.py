"""Cross-document line frequency, in DataFrame operations only.

Lines are normalised (lower case, white space runs as one space, trimmed) and hashed. For each host (column `source`) and
line the distinct documents that hold it are counted; a line in more documents than the limit is removed, and a
document that loses over half of its words is depleted and rejected. Documents are told apart by their text, so exact
copies count as one. The limit is a number of documents, whatever the size of the host, as in published line filters: a
share of the host would let boilerplate of thousands of documents through where most of them lie. Beside that stand base
rules on words, symbols and repetition within a document.

The hot part is a count per (host, line), pre-aggregated before the shuffle and spread by the line's hash, however large
the host. Only lines above a limit are joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import sized_broadcast, staged, table

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: A line may be in so many distinct documents of a host.
MAX_DOCS = 20
MIN_WORDS, MAX_REPEATED = 20, 30


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def _normal_lines(text: Column) -> Column:
    """Normalised lines: lower case, runs of white space as one space (single spaces need no change), trimmed."""
    spaced = F.regexp_replace(F.lower(text), r"[\x20\x09\x0B-\x0D]{2,}|[\x09\x0B-\x0D]", " ")
    return F.transform(F.split(spaced, "\n"), F.trim)


def base_rules(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, source) -> its rows with text as "" for null, host, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed. A null source is the host "".
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.coalesce("source", F.lit("")).alias("host"))
    rows = rows.withColumn("words", _words(F.col("text")))
    words = F.col("words")
    windows = F.when(F.size(words) > WINDOW, F.transform(F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW))))
    worded = F.filter(F.split("text", "\n"), lambda line: F.length(F.translate(line, " \t\n\x0b\f\r", "")) > 0)
    rows = rows.select(
        "doc_id",
        "text",
        "host",
        F.size(words).cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        worded.alias("lines"),
        windows.alias("windows"),
    )
    rows = rows.withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long")).drop("lines")
    rows = rows.withColumn("windows", F.when(F.size(F.array_distinct("windows")) < F.size("windows"), F.col("windows")))
    ranked = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = rows.withColumn("ranked", F.when(F.col("windows").isNotNull(), ranked)).drop("windows")
    twice = F.filter("ranked", lambda s, k: F.coalesce(F.get("ranked", k - 1)["h"] == s["h"], F.lit(False)) | F.coalesce(F.get("ranked", k + 1)["h"] == s["h"], F.lit(False)))
    rows = rows.withColumn("at", F.when(F.col("ranked").isNotNull(), F.sort_array(F.transform(twice, lambda s: s["i"])))).drop("ranked")
    gaps = F.transform("at", lambda i, k: F.least(F.lit(WINDOW), F.coalesce(F.get("at", k + 1) - i, F.lit(WINDOW))))
    covered = F.when(F.col("at").isNotNull(), F.aggregate(gaps, F.lit(0), lambda total, gap: total + gap)).otherwise(0)
    rows = rows.withColumn("n_repeat_words", covered.cast("long")).drop("at")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    return rows.withColumn("base_failed", failed)


def _lines(rows: DataFrame) -> DataFrame:
    """(doc_id, host, digest of the text, line number, line hash, its words) of the lines that hold a word."""
    line = F.posexplode(_normal_lines(F.coalesce("text", F.lit("")))).alias("line_no", "line")
    lines = rows.select("doc_id", F.coalesce("source", F.lit("")).alias("host"), F.xxhash64("text").alias("copy"), line)
    n = F.length("line") - F.length(F.replace("line", F.lit(" "))) + 1
    return lines.where("line <> ''").select("doc_id", "host", "copy", "line_no", F.xxhash64("line").alias("hash"), n.alias("n"))


def frequent_lines(docs: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """(host, hash, n_docs) of the lines above the limit, staged."""
    counted = _lines(docs).groupBy("host", "hash").agg(F.count_distinct("copy").alias("n_docs"))
    return staged(counted.where(F.col("n_docs") > max_docs), "line-frequent")


def removed_lines(docs: DataFrame, frequent: DataFrame) -> DataFrame:
    """(doc_id, host, copy, lost words, lost line numbers) of the documents that lose a line; one row per doc_id, host and text."""
    hit = _lines(docs).join(sized_broadcast(frequent), ["host", "hash"]).select("doc_id", "host", "copy", "line_no", "n").distinct()
    return hit.groupBy("doc_id", "host", "copy").agg(F.sum("n").alias("lost"), F.collect_set("line_no").alias("line_nos"))


def verdicts(docs: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """docs(doc_id, text, source, ...) -> one row per row: doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, n_lost_words.

    Null text has no words and fails. Null doc_ids are matched like values; rows that repeat doc_id, source and text get
    the same result each. Other columns are ignored.
    """
    return _judged(docs, frequent_lines(docs, max_docs)).drop("host", "copy")


def _judged(docs: DataFrame, frequent: DataFrame) -> DataFrame:
    """Staged, as a filter that is pushed into the rules would repeat their nested expressions many times over."""
    gone = removed_lines(docs, frequent)
    gone = gone.select(F.col("doc_id").alias("g_id"), F.col("host").alias("g_host"), F.col("copy").alias("g_copy"), "lost")
    rows = base_rules(docs).withColumn("copy", F.xxhash64("text")).drop("text")
    same = F.col("doc_id").eqNullSafe(F.col("g_id")) & (F.col("host") == F.col("g_host")) & (F.col("copy") == F.col("g_copy"))
    rows = rows.join(gone, same, "left").withColumn("n_lost_words", F.coalesce("lost", F.lit(0)).cast("long"))
    kept = ~F.col("base_failed") & (2 * F.col("n_lost_words") <= F.col("n_words"))
    out = rows.select("doc_id", "host", "copy", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "n_lost_words")
    return staged(out, "line-verdicts")


def cleaned(docs: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """docs without its rejected rows, and without the removed lines in `text`; all columns stay, whatever their names.

    Null and empty texts have too few words and go. Null doc_ids and sources are matched like values; rows that repeat
    doc_id, source and text stay or go together. Very long texts are cleaned whole. A line at the limit stays, one above goes. An empty
    table gives none.
    """
    frequent = frequent_lines(docs, max_docs)
    key = lambda host, copy: F.struct(F.col("doc_id").alias("a"), host.alias("b"), copy.alias("c")).alias("row")
    found = key(F.col("host"), F.col("copy"))
    gone = removed_lines(docs, frequent).select(found, "line_nos")
    held = docs.select(F.struct(*docs.columns).alias("held"), key(F.coalesce("source", F.lit("")), F.xxhash64(F.coalesce("text", F.lit("")))))
    kept = _judged(docs, frequent).where("kept").select(found).distinct()
    held = held.alias("x").join(gone.alias("y"), F.col("x.row").eqNullSafe(F.col("y.row")), "left").select("x.held", "x.row", "y.line_nos")
    held = held.alias("x").join(kept.alias("y"), F.col("x.row").eqNullSafe(F.col("y.row")), "left_semi")
    lines = F.filter(F.split("held.text", "\n"), lambda _, k: ~F.coalesce(F.array_contains("line_nos", k), F.lit(False)))
    return held.select(*[F.array_join(lines, "\n").alias(c) if c == "text" else F.col(f"held.`{c}`").alias(c) for c in docs.columns])


def op2_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(table(spark, sf_dir, "documents"))


_SQL_SPACE = r"[\x20\x09-\x0D]+"
OP2_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS host FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '{_SQL_SPACE}'), lambda x: x <> '') AS words,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
u AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM w),
g AS (SELECT doc_id, pos, word, lead(word, 1) OVER o AS w1, lead(word, 2) OVER o AS w2, lead(word, 3) OVER o AS w3, lead(word, 4) OVER o AS w4,
        lead(word, 5) OVER o AS w5, lead(word, 6) OVER o AS w6, lead(word, 7) OVER o AS w7 FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
r AS (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, word, w1, w2, w3, w4, w5, w6, w7) AS n FROM g WHERE w7 IS NOT NULL),
p AS (SELECT doc_id, least(8, coalesce(lead(pos) OVER (PARTITION BY doc_id ORDER BY pos) - pos, 8)) AS gap FROM r WHERE n > 1),
c AS (SELECT doc_id, sum(gap) AS covered FROM p GROUP BY doc_id),
l AS (SELECT doc_id, host, text, trim(regexp_replace(lower(unnest(string_split(text, chr(10)))), '{_SQL_SPACE}', ' ', 'g')) AS line FROM d),
n AS (SELECT host, line, count(DISTINCT text) AS n_docs FROM l WHERE line <> '' GROUP BY host, line),
f AS (SELECT host, line FROM n WHERE n_docs > {MAX_DOCS}),
t AS (SELECT doc_id, sum(len(string_split(line, ' '))) AS lost FROM l JOIN f USING (host, line) GROUP BY doc_id),
b AS (SELECT w.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
        coalesce(covered, 0)::BIGINT AS n_repeat_words, coalesce(lost, 0)::BIGINT AS n_lost_words
      FROM w LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words) AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words) AND 2 * n_lost_words <= n_words AS kept, n_lost_words
FROM b
"""
