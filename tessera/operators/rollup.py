"""Evidence items rolled up to episodes and seasons, their timeline, layers, conflicts and lineage.

Items are rows (season, episode, chunk, pos, item). Copies of an item meet in partial minima before the shuffle,
so a frequent item or a hot episode costs one row for each task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T

EPISODE = ("season", "episode")


def items(chunks: DataFrame) -> DataFrame:
    """chunks (season, episode, chunk, text) as items, one for each sentence; null or blank texts give none."""
    return chunks.select(*EPISODE, "chunk", F.posexplode(T.sentences(F.col("text"))).alias("pos", "item"))


def first_seen(rows: DataFrame, keys: tuple[str, ...], order: tuple[str, ...] = ("chunk", "pos"), value: str = "item") -> DataFrame:
    """Distinct values for each key: copies and at, the first place in order."""
    return rows.groupBy(*keys, value).agg(F.count("*").alias("copies"), F.min(F.struct(*order)).alias("at"))


def joined(rows: DataFrame, keys: tuple[str, ...], separator: str = " | ", value: str = "item") -> DataFrame:
    """first_seen() rows as one text for each key, with n_items (copies counted) and n_distinct."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("at", value))), lambda x: x[value])
    return rows.groupBy(*keys).agg(F.sum("copies").alias("n_items"), F.count("*").alias("n_distinct"), F.array_join(parts, separator).alias("items"))


def episode_rollup(chunks: DataFrame) -> DataFrame:
    """One row per episode: n_chunks, n_items, n_distinct and its distinct items in order of first appearance."""
    counts = chunks.groupBy(*EPISODE).agg(F.count("*").alias("n_chunks"))
    return counts.join(joined(first_seen(items(chunks), EPISODE), EPISODE), list(EPISODE), "left").fillna({"n_items": 0, "n_distinct": 0, "items": ""})


def season_rollup(chunks: DataFrame) -> DataFrame:
    """One row per season: episodes, chunks, items and distinct items over episodes."""
    counts = chunks.groupBy(*EPISODE).agg(F.count("*").alias("n")).groupBy("season").agg(F.count("*").alias("n_episodes"), F.sum("n").alias("n_chunks"))
    rows = items(chunks).groupBy("season", "item").agg(F.count("*").alias("n")).groupBy("season").agg(F.sum("n").alias("n_items"), F.count("*").alias("n_distinct"))
    return counts.join(rows, "season", "left").fillna(0)


def season_background(chunks: DataFrame, most: int | None = None) -> DataFrame:
    """One text per season: each episode and its distinct items, all or the first so many."""
    seen = first_seen(items(chunks), EPISODE)
    top = seen.withColumn("k", F.row_number().over(Window.partitionBy(*EPISODE).orderBy("at")))
    if most is not None:
        top = top.filter(F.col("k") <= most)
    lines = top.groupBy(*EPISODE).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "item"))), lambda x: x["item"]), "; ").alias("line"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("episode", "line"))), lambda x: F.concat(x["episode"].cast("string"), F.lit(": "), x["line"]))
    return lines.groupBy("season").agg(F.count("*").alias("n_episodes"), F.array_join(parts, " | ").alias("background"))


def term_timeline(chunks: DataFrame, terms: list[str]) -> DataFrame:
    """A step for each episode with items of the terms: its count, the running count, and new distinct items so far."""
    found = items(chunks).filter(T.has_term(F.col("item"), terms))
    steps = found.groupBy(*EPISODE).agg(F.count("*").alias("n_items"))
    first = found.groupBy("season", "item").agg(F.min("episode").alias("episode")).groupBy(*EPISODE).agg(F.count("*").alias("new"))
    so_far = Window.partitionBy("season").orderBy("episode").rowsBetween(Window.unboundedPreceding, 0)
    out = steps.join(first, list(EPISODE), "left")
    return out.select(*EPISODE, "n_items", F.sum("n_items").over(so_far).alias("evidence_count"), F.sum(F.coalesce("new", F.lit(0))).over(so_far).alias("distinct_count"))


def evidence_layers(chunks: DataFrame, direct: list[str], mention: list[str], causal: list[str]) -> DataFrame:
    """Each episode once: direct, else causal (a mention beside a causal word), else mention, else none."""
    rows = chunks.select(*EPISODE, F.explode_outer(T.sentences(F.col("text"))).alias("item"))
    c = F.col("item")
    hit = rows.groupBy(*EPISODE).agg(
        F.coalesce(F.bool_or(T.has_term(c, direct)), F.lit(False)).alias("direct"),
        F.coalesce(F.bool_or(T.has_term(c, mention)), F.lit(False)).alias("mention"),
        F.coalesce(F.bool_or(T.has_term(c, mention) & T.has_term(c, causal)), F.lit(False)).alias("causal"),
        F.count("item").alias("n_items"),
    )
    layer = F.when(F.col("direct"), "direct").when(F.col("causal"), "causal").when(F.col("mention"), "mention").otherwise("none")
    return hit.select(*EPISODE, layer.alias("layer"), "n_items")


def profile(rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Histograms over each column in one pass: dimension, value, n."""
    sets = [F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in columns]
    return rows.select(F.explode(F.array(*sets)).alias("s")).groupBy("s.dimension", "s.value").agg(F.count("*").alias("n"))


def conflict_groups(rows: DataFrame, terms: list[str], most: int = 20) -> DataFrame:
    """The first most distinct items with one of the terms, by lower case, over all episodes: position, count, item."""
    found = rows.filter(T.has_term(F.col("item"), terms)).withColumn("key", F.lower("item"))
    groups = found.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct(*EPISODE, "chunk", "pos", "item")).alias("first"))
    return groups.orderBy("first").limit(most).select("first.season", "first.episode", "first.chunk", "first.pos", "first.item", "n")


def target_candidates(rows: DataFrame, most: int = 120) -> DataFrame:
    """The first most distinct name prefixes of items, up to a colon or bracket, in order of appearance."""
    name = T.strip(F.regexp_extract("item", r"^[^:：(<（]*", 0))
    named = rows.withColumn("name", name).filter("name <> ''")
    return named.groupBy("name").agg(F.min(F.struct(*EPISODE, "chunk", "pos")).alias("at"), F.count("*").alias("n")).orderBy("at").limit(most).select("name", "n", "at.episode")


def lineage(refs: DataFrame, key: str, kind: str, ref: str) -> DataFrame:
    """Per key: distinct references, references in all, and whether one kind or more feed it."""
    counts = refs.groupBy(key, kind, ref).agg(F.count("*").alias("n")).groupBy(key, kind).agg(F.count("*").alias("d"), F.sum("n").alias("n"))
    return counts.groupBy(key).agg(F.sum("d").alias("n_distinct"), F.sum("n").alias("n_refs"), F.when(F.count("*") > 1, "mixed").otherwise(F.min(kind)).alias("source_kind"))


def overlap(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """Per key: the sizes of its two sets of values, the shared values and their share of the larger set; no pairs are made."""
    sides = left.select(key, value, F.lit(1).alias("l"), F.lit(0).alias("r")).union(right.select(key, value, F.lit(0).alias("l"), F.lit(1).alias("r")))
    sets = sides.groupBy(key, value).agg(F.max("l").alias("l"), F.max("r").alias("r"))
    out = sets.groupBy(key).agg(F.sum("l").alias("n_left"), F.sum("r").alias("n_right"), F.sum(F.col("l") * F.col("r")).alias("shared"))
    return out.withColumn("score", F.col("shared") / F.greatest("n_left", "n_right", F.lit(1)))


def flag(condition: Column, code: str) -> Column:
    return F.when(condition, code)
