"""Quality rules: a threshold table compiled into Spark columns, without user functions and without a shuffle.

A rule bounds measure / base between two values in thousandths. Measures are whole-text counts; the table
is data, so other thresholds or languages need no code.

Defined results: null text counts as empty; an empty or short text fails the length rule; null doc_id and
repeated rows are judged row by row; an empty table: no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
STOP_WORDS = "the of and to in that is was for on with de la que le et les des der die und den von zu el en los se del las un a".split()
MOST_REPEATS = 64


@dataclass(frozen=True)
class Rule:
    """least <= 1000 * measure / base <= most; base may be "one"."""

    measure: str
    base: str
    least: int | None = None
    most: int | None = None


RULES = (
    Rule("word_chars", "n_words", 2500, 12000),
    Rule("n_symbols", "n_words", None, 100),
    Rule("n_upper", "word_chars", None, 250),
    Rule("n_bangs", "n_words", None, 100),
    Rule("n_stop", "n_words", 60, None),
    Rule("n_dup_lines", "n_lines", None, 500),
)


def sql_of(rules: tuple[Rule, ...] = RULES) -> str:
    """The table as one boolean expression."""
    parts = []
    for r in rules:
        base = "1" if r.base == "one" else r.base
        parts += [f"1000 * {r.measure} >= {r.least} * {base}"] * (r.least is not None)
        parts += [f"1000 * {r.measure} <= {r.most} * {base}"] * (r.most is not None)
    return " AND ".join(parts) or "true"


def _without(column: str, chars: str) -> F.Column:
    return F.translate(F.col(column), chars, "")


def _let(value: F.Column, body) -> F.Column:
    """body of the value, which is evaluated once, also where the optimiser moves the expression into a filter."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeat_words(words: F.Column) -> F.Column:
    """Number of words that lie in a window of three words found twice or more."""
    windows = lambda w: F.transform(F.slice(w, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
    twice = lambda h: _let(F.sort_array(h), lambda o: F.array_distinct(F.filter(o, lambda x, i: (i > 0) & (x == F.get(o, i - 1)))))
    few = lambda h, t: F.filter(F.transform(h, lambda x, i: F.when(F.array_contains(t, x), i)), lambda i: i.isNotNull())
    # Where many windows repeat, positions are ordered by window; looking each up in a short list is cheaper else.
    beside = lambda p, x, i: (F.get(p, i + 1)["h"] == x["h"]) | ((i > 0) & (F.get(p, F.greatest(i - 1, F.lit(0)))["h"] == x["h"]))
    placed = lambda h: F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    many = lambda h: _let(placed(h), lambda p: F.sort_array(F.transform(F.filter(p, lambda x, i: F.coalesce(beside(p, x, i), F.lit(False))), lambda x: x["i"])))
    starts = lambda h, t: F.when(F.size(t) == 0, F.array().cast("array<int>")).when(F.size(t) <= MOST_REPEATS, few(h, t)).otherwise(many(h))
    covered = lambda s: F.aggregate(F.transform(s, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(s, i + 1) - x, F.lit(3)))), F.lit(0).cast("long"), lambda a, x: a + x)
    return _let(words, lambda w: _let(windows(w), lambda h: _let(twice(h), lambda t: _let(starts(h, t), covered))))


def measures(docs: DataFrame) -> DataFrame:
    """doc_id and every measure of docs (doc_id, text)."""
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    d = d.withColumn("solid", _without("text", BLANKS))
    d = d.withColumn("words", F.filter(F.split("text", SPACE), lambda x: x != "")).withColumn("n_words", F.size("words").cast("long"))
    d = d.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: F.translate(x, BLANKS, "") != ""))
    stop = F.size(F.filter("words", lambda x: F.translate(F.lower(x), ".,;:!?", "").isin(STOP_WORDS)))
    return d.select(
        "doc_id",
        "n_words",
        F.length("solid").cast("long").alias("word_chars"),
        (F.length("text") - F.length(_without("text", SYMBOLS))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("words")).alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.length("text") - F.length(_without("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))).cast("long").alias("n_upper"),
        (F.length("text") - F.length(_without("text", "!"))).cast("long").alias("n_bangs"),
        stop.cast("long").alias("n_stop"),
    )


BASE_FAILED = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """measures(docs) with base_failed (too short, or mostly repeated words) and kept (no rule broken)."""
    return measures(docs).withColumn("base_failed", F.expr(BASE_FAILED)).withColumn("kept", ~F.col("base_failed") & F.expr(sql_of(rules)))


def op10_rules(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_STOP_SQL = ", ".join(f"'{w}'" for w in STOP_WORDS)
OP10_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT rid, generate_subscripts(ws, 1) AS pos, unnest(ws) AS word
  FROM (SELECT rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d)),
tri AS (
  SELECT rid, pos, word, lead(word, 1) OVER o AS w2, lead(word, 2) OVER o AS w3 FROM w WINDOW o AS (PARTITION BY rid ORDER BY pos)),
flag AS (SELECT *, w3 IS NOT NULL AND count(*) OVER (PARTITION BY rid, word, w2, w3) > 1 AS twice FROM tri),
covered AS (
  SELECT rid, word, twice OR coalesce(lag(twice, 1) OVER o, false) OR coalesce(lag(twice, 2) OVER o, false) AS rep
  FROM flag WINDOW o AS (PARTITION BY rid ORDER BY pos)),
per AS (
  SELECT rid, count(*) AS n_words, sum(length(word))::BIGINT AS word_chars, count(*) FILTER (rep) AS n_repeat_words,
    count(*) FILTER (translate(lower(word), '.,;:!?', '') IN ({_STOP_SQL})) AS n_stop
  FROM covered GROUP BY rid),
ln AS (
  SELECT rid, count(*) AS n_lines, count(DISTINCT line) AS n_distinct
  FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
m AS (
  SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(n_lines - n_distinct, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
    length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_upper, length(text) - length(regexp_replace(text, '!', '', 'g')) AS n_bangs, coalesce(n_stop, 0) AS n_stop
  FROM d LEFT JOIN per USING (rid) LEFT JOIN ln USING (rid))
SELECT *, {BASE_FAILED} AS base_failed, NOT ({BASE_FAILED}) AND {sql_of()} AS kept FROM m
"""
