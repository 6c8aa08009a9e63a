"""URL filters: list rules, and gradient-boosted trees on lexical features for all other URLs.

Features of a URL: lengths, path depth, digit ratio, character entropy, parameter count, hyphens and labels of
the host, and statistics of the host's suffix and of the path's first part (their share of the labelled URLs, and of
those blocked). The statistics are counted over all labelled URLs; for a URL that the trees are fitted on, without those of its
own fold of hosts, so that no label is in a feature of its own. The trees are Spark
ML's, fitted on at most SAMPLE distinct labelled URLs, those with the smallest hashes.

Labelled URLs are an argument. The table of pages has none, so the query takes as labels what the list rules say of
the URLs that they fit; README.md has the precision and recall on hosts that were held out.

Defined results: null url or no "://": empty host and path, no rule; repeated rows: row by row; labels of
one kind only: that verdict for all; no labels: allow; a URL with two labels: bad; an empty table: no rows.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle

SAMPLE = 20_000
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
#: Suffixes or first parts, of those with labels, whose statistics are sent to every executor.
MOST_SENT = 100_000
#: Folds of hosts: a URL that is fitted on has the statistics of the other folds.
FOLDS = 5
FEATURES = ("url_length", "host_length", "path_length", "depth", "digit_ratio", "entropy", "parameters", "hyphens", "labels", "longest_label", "suffix_share", "suffix_blocked", "head_share", "head_blocked")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(urls: DataFrame) -> DataFrame:
    """urls with host and path."""
    rest = F.when(F.instr("url", "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return urls.withColumn("host", F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))).withColumn("path", F.coalesce(path, F.lit("")))


def rule_of(rules: tuple[tuple[str, str], ...]) -> tuple[F.Column, F.Column]:
    """The longest rule that fits host and path, and its verdict; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: len(r[0])):
        name, slash, rest = text.partition("/")
        fits = ((F.col("host") == name) | F.endswith("host", F.lit(f".{name}"))) & F.startswith("path", F.lit(slash + rest))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def lexical(rows: DataFrame) -> DataFrame:
    """rows (url, host, path) with the features that the URL alone gives, its suffix and the path's first part."""
    url = F.coalesce("url", F.lit(""))
    n = F.greatest(F.length(url), F.lit(1))
    share = lambda c: (F.length(url) - F.length(F.replace(url, c, F.lit("")))) / n
    entropy = -F.aggregate(F.transform(F.array_distinct(F.split(url, "")), lambda c: F.when(F.length(c) > 0, share(c) * F.log2(share(c))).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x)
    labels = F.split("host", r"\.")
    return rows.select(
        "*",
        F.length(url).cast("double").alias("url_length"),
        F.length("host").cast("double").alias("host_length"),
        F.length("path").cast("double").alias("path_length"),
        (F.length("path") - F.length(F.translate("path", "/", ""))).cast("double").alias("depth"),
        ((F.length(url) - F.length(F.translate(url, "0123456789", ""))) / n).alias("digit_ratio"),
        F.coalesce(entropy, F.lit(0.0)).alias("entropy"),
        F.when(F.instr(url, "?") > 0, 1.0 + F.length(url) - F.length(F.translate(url, "&", ""))).otherwise(0.0).alias("parameters"),
        (F.length("host") - F.length(F.translate("host", "-", ""))).cast("double").alias("hyphens"),
        F.size(labels).cast("double").alias("labels"),
        F.array_max(F.transform(labels, lambda x: F.length(x))).cast("double").alias("longest_label"),
        F.element_at(labels, -1).alias("suffix"),
        F.regexp_extract("path", "^/([^/]*)", 1).alias("head"),
    )


def model_of(labelled: DataFrame, sample: int = SAMPLE):
    """A function that gives rows (url, host, path) the column bad by the trees; labelled: url, bad (0 or 1)."""
    known = labelled.filter("url is not null and bad is not null").groupBy("url").agg(F.max(F.col("bad").cast("double")).alias("bad"))
    known = settle(lexical(parts(known)), "labelled")
    every = known.agg(F.count("*").alias("n"), F.sum("bad").alias("n_bad")).first()
    if not every.n or every.n_bad in (0, every.n):
        return lambda rows: rows.withColumn("bad", F.lit(1.0 if every.n and every.n_bad else 0.0))
    rate, tables = every.n_bad / every.n, {}
    known = known.withColumn("fold", F.pmod(F.xxhash64("host"), F.lit(FOLDS)).cast("int"))
    for key in ("suffix", "head"):
        # At most FOLDS rows a key.
        folds = known.groupBy(key, "fold").agg(F.count("*").alias("n"), F.sum("bad").alias("bad"))
        stats = folds.groupBy(key).agg(F.sum("n").alias(f"{key}_n"), F.sum("bad").alias(f"{key}_bad"), F.map_from_entries(F.collect_list(F.struct("fold", F.struct("n", "bad")))).alias(f"{key}_folds"))
        stats = settle(stats, key)
        tables[key] = F.broadcast(stats) if stats.count() <= MOST_SENT else stats

    def full(rows: DataFrame, own: bool = False) -> DataFrame:
        """rows with the statistics of their keys; own: without what the labels of a row's own fold, and so its own label, add."""
        for key, stats in tables.items():
            rows = rows.join(stats, key, "left")
            mine = F.try_element_at(f"{key}_folds", "fold") if own else F.lit(None).cast("struct<n:bigint,bad:double>")
            n, bad = (F.coalesce(F.col(f"{key}_{c}"), F.lit(0)) - F.coalesce(mine[c], F.lit(0)) for c in ("n", "bad"))
            rows = rows.withColumns({f"{key}_share": n / every.n, f"{key}_blocked": (bad + rate) / (n + 1)})
        return rows

    assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    drawn = settle(known.orderBy(F.xxhash64("url"), "url").limit(sample), "drawn")
    trees = GBTClassifier(featuresCol="features", labelCol="bad", maxIter=10, maxDepth=3, seed=7).fit(assembler.transform(full(drawn, own=True)).select("features", "bad"))
    return lambda rows: trees.transform(assembler.transform(full(lexical(rows)))).withColumn("bad", F.col("prediction"))


def judge(urls: DataFrame, labelled: DataFrame | None = None, rules: tuple[tuple[str, str], ...] = RULES, sample: int = SAMPLE) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of urls (page_id, url); labelled: url, bad (0 or 1), by default ruled(urls)."""
    scored = model_of(ruled(urls, rules) if labelled is None else labelled, sample)(parts(urls.select("page_id", "url")))
    rule, verdict = rule_of(rules)
    says = F.when(F.col("bad") > 0.5, F.lit("block")).otherwise("allow")
    return scored.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, says).alias("verdict"))


def ruled(urls: DataFrame, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """url, bad for the urls that a rule fits."""
    _, verdict = rule_of(rules)
    return parts(urls.select("url")).select("url", (verdict == "block").cast("int").alias("bad")).filter("bad is not null")


def op4_urls(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"))
