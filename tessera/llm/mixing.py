"""Mixing sources to target weights, with DataFrame functions only.

Words are laid out in equal blocks. Sainte-Lague apportionment (highest quotients weight / (2 k - 1)) deals the
blocks of the whole mix to sources by their targets, then each source's blocks to its shards by their words,
so that every shard has an integer quota. A shard orders its documents by a seeded hash and takes its quota
of blocks at a seeded, even spacing; a quota above the shard's blocks takes every block once before any twice.

The quotients are not ranked one by one: all seats below the quotient that any apportionment must reach are
dealt by rounding, and only about one seat for each party is left to rank, however many blocks there are.

Defined results: null or empty text: size 0, nothing taken; null source: a source of its own, last in order;
null doc_id and repeated rows: each row counts for itself; an empty table: no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, WORD, settle

BLOCK_WORDS = 64
#: Documents of a shard, about: bounds the rows that one window orders.
SHARD_DOCS = 2048
SEED = "mix-1"


def _hash(*parts) -> F.Column:
    """60 bits of the MD5 of the seed and parts."""
    joined = F.concat_ws("|", F.lit(SEED), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(joined), 1, 15), 16, 10).cast("long")


def source_targets(sources: DataFrame, weights: tuple[int, ...], share: float, most: int) -> DataFrame:
    """target for each row (source, source_size, ...) of a table with one row per source.

    The level at which min(most * size, weight * level) adds up to share * all sizes: sources in order of
    size / weight fill first, the others share what is left.
    """
    table = F.array(*[F.lit(w) for w in weights])
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sources.withColumn("weight", F.get(table, (F.row_number().over(by_name) - 1) % len(weights)))
    ranked = ranked.withColumn("ceiling", F.col("source_size") * most).withColumn("ratio", F.col("ceiling") / F.col("weight"))
    everything = Window.partitionBy()
    before = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranked.withColumn("total", F.sum("source_size").over(everything) * F.lit(share))
    left = F.col("total") - F.coalesce(F.sum("ceiling").over(before), F.lit(0))
    level = left / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    ranked = ranked.withColumn("level", level)
    found = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(everything)["level"]
    return ranked.withColumn("target", F.least(F.col("ceiling").cast("double"), F.col("weight") * F.coalesce(found, F.col("level")))).drop("ceiling", "ratio", "level", "weight")


def sainte_lague(parties: DataFrame, group: list[str], key: list[str], weight: str, total: str, seats: str) -> DataFrame:
    """parties with quota: seats of each group dealt by the highest quotients weight / (2 k - 1); ties by key."""
    of = Window.partitionBy(*group)
    half = F.sum(F.when(F.col(weight) > 0, 1).otherwise(0)).over(of) / 2
    ideal = lambda n: F.floor(F.greatest(F.coalesce(F.col(weight) * n / F.expr(f"nullif({total}, 0)"), F.lit(0.0)), F.lit(0.0)) + 0.5)
    p = parties.withColumn("low", ideal(F.col(seats) - half)).withColumn("high", ideal(F.col(seats) + half) + 1)
    p = p.withColumn("open", F.col(seats) - F.sum("low").over(of))
    tried = p.filter(F.col(weight) > 0).select(*group, *key, weight, "open", F.explode(F.sequence(F.col("low") + 1, F.col("high"))).alias("_seat"))
    order = Window.partitionBy(*group).orderBy((F.col(weight) / (2 * F.col("_seat") - 1)).desc(), *[F.col(k).asc_nulls_last() for k in key], "_seat")
    names = [*group, *key]
    won = tried.withColumn("place", F.row_number().over(order)).filter("place <= open").groupBy(*names).agg(F.count("*").alias("won"))
    won = won.select(*[F.col(c).alias(f"won_{c}") for c in names], "won")
    condition = F.lit(True)
    for c in names:
        condition = condition & F.col(c).eqNullSafe(F.col(f"won_{c}"))
    return p.join(won, condition, "left").select(*parties.columns, (F.col("low") + F.coalesce("won", F.lit(0))).alias("quota"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2, block: int = BLOCK_WORDS, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs (doc_id, source, text): doc_id, source, size, source_size, target, spans; and carried, a struct of the columns to carry.

    spans: array of (start, length, times), the runs of the document's words that the mix takes, and how often.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")
    sizes = settle(docs.select("doc_id", "source", size), "sizes")
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    sources = source_targets(sources, weights, share, most).withColumn("shards", F.ceil(F.col("n") / SHARD_DOCS).cast("long")).withColumn("seats", F.floor(F.col("total") / block + 0.5)).withColumn("all", F.lit(1))
    sources = settle(sainte_lague(sources, ["all"], ["source"], "target", "total", "seats"), "sources").select("source", "source_size", "target", "shards", F.col("quota").alias("source_quota"))
    s = sources.select(F.col("source").alias("name"), "source_size", "target", "shards", "source_quota")
    placed = sizes.join(s, F.col("source").eqNullSafe(F.col("name"))).withColumn("h", _hash(F.col("doc_id"))).withColumn("shard", F.col("h") % F.col("shards"))
    laid = placed
    if carry:
        laid = docs.select("doc_id", "source", size, F.struct(*carry).alias("carried")).join(s, F.col("source").eqNullSafe(F.col("name"))).withColumn("h", _hash(F.col("doc_id"))).withColumn("shard", F.col("h") % F.col("shards"))
    shards = placed.groupBy("source", "shard").agg(F.sum("size").alias("words"), F.first("source_size").alias("all_words"), F.first("source_quota").alias("source_quota"))
    shards = sainte_lague(shards, ["source"], ["shard"], "words", "all_words", "source_quota")
    blocks = F.ceil(F.col("words") / block)
    shards = shards.withColumn("blocks", blocks).select(F.col("source").alias("of"), F.col("shard").alias("part"), "blocks", F.least(F.col("quota"), 2 * F.col("blocks")).alias("quota"), (_hash(F.col("source"), F.col("shard")) % F.greatest(F.col("blocks"), F.lit(1))).alias("phase"))
    shards = settle(shards, "shards")
    last = [F.xxhash64("carried")] if carry else []
    order = Window.partitionBy("source", "shard").orderBy("h", "doc_id", "size", *last).rowsBetween(Window.unboundedPreceding, -1)
    laid = laid.withColumn("begin", F.coalesce(F.sum("size").over(order), F.lit(0)))
    laid = laid.join(shards, F.col("source").eqNullSafe(F.col("of")) & (F.col("shard") == F.col("part")))
    begun = lambda b: F.call_function("div", b * F.col("quota") + F.col("phase"), F.col("blocks"))

    def span(b):
        start = F.greatest(b * block, F.col("begin"))
        stop = F.least((b + 1) * block, F.col("begin") + F.col("size"))
        return F.struct((start - F.col("begin")).alias("start"), (stop - start).alias("length"), (begun(b + 1) - begun(b)).alias("times"))

    touched = F.sequence(F.expr(f"begin div {block}"), F.expr(f"(begin + size - 1) div {block}"))
    none = F.array().cast("array<struct<start:bigint,length:bigint,times:bigint>>")
    spans = F.when(F.col("size") > 0, F.filter(F.transform(touched, span), lambda x: x["times"] > 0)).otherwise(none)
    return laid.select("doc_id", "source", "size", "source_size", "target", spans.alias("spans"), *["carried"] * bool(carry))


def take(docs: DataFrame, **options) -> DataFrame:
    """The columns of docs for what mix() takes: a row for each time that some of a text is taken, with the words taken
    (and the blanks after them) as text and n_chars set anew."""
    mixed = mix(docs, carry=tuple(docs.columns), **options).withColumn("time", F.explode(F.sequence(F.lit(1), F.array_max(F.transform("spans", lambda x: x["times"])))))
    text = F.col("carried.text")
    chosen = F.filter("spans", lambda x: x["times"] >= F.col("time"))
    whole = (F.size(chosen) > 0) & (F.aggregate(chosen, F.lit(0).cast("long"), lambda a, x: a + x["length"]) == F.col("size"))
    words = F.regexp_extract_all(text, F.lit(f"({WORD}{SPACE[:-1]}*)"), F.lit(1))
    part = F.get(F.transform(F.array(words), lambda w: F.array_join(F.flatten(F.transform(chosen, lambda x: F.slice(w, (x["start"] + 1).cast("int"), x["length"].cast("int")))), "")), F.lit(0))
    out = mixed.select("carried", F.when(whole, text).otherwise(part).alias("text"))
    anew = {"text": F.col("text"), "n_chars": F.length("text").cast(docs.schema["n_chars"].dataType if "n_chars" in docs.columns else "long")}
    return out.select(*[anew.get(c, F.col(f"carried.{c}")).alias(c) for c in docs.columns])


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    mixed = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    taken = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["length"] * x["times"])
    return mixed.select("doc_id", "size", "source_size", "target", taken.alias("taken"))


OP1_SQL = f"""
WITH sizes AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
    ('0x' || substr(md5('{SEED}|' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
  FROM documents),
src AS (
  SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n,
    [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight
  FROM sizes GROUP BY source),
lev AS (
  SELECT *, 2 * source_size AS ceiling, 2 * source_size / weight AS ratio, sum(source_size) OVER () * 1.5::DOUBLE AS total,
    (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(2 * source_size) OVER w, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS level
  FROM src WINDOW w AS (ORDER BY 2 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
tgt AS (
  SELECT source, source_size, n, total, least(ceiling::DOUBLE, weight * (SELECT arg_min(level, ratio) FROM lev WHERE level <= ratio)) AS target,
    ceil(n / {SHARD_DOCS})::BIGINT AS shards, floor(total / {BLOCK_WORDS} + 0.5)::BIGINT AS seats
  FROM lev),
q1 AS (
  SELECT source, target, k, row_number() OVER (ORDER BY target / (2 * k - 1) DESC, source NULLS LAST, k) AS place, seats
  FROM tgt, LATERAL (SELECT unnest(generate_series(1, (target / {BLOCK_WORDS})::BIGINT + 3)) AS k)
  WHERE target > 0),
sq AS (SELECT t.*, (SELECT count(*) FROM q1 WHERE q1.source IS NOT DISTINCT FROM t.source AND place <= q1.seats) AS source_quota FROM tgt t),
placed AS (SELECT s.*, q.source_size, q.target, q.source_quota, h % q.shards AS shard FROM sizes s JOIN sq q ON s.source IS NOT DISTINCT FROM q.source),
sh AS (SELECT source, shard, sum(size)::BIGINT AS words, any_value(source_quota) AS source_quota, any_value(source_size) AS all_words FROM placed GROUP BY source, shard),
q2 AS (
  SELECT source, shard, source_quota, row_number() OVER (PARTITION BY source ORDER BY words / (2 * k - 1) DESC, shard, k) AS place
  FROM sh, LATERAL (SELECT unnest(generate_series(1, (source_quota * words / greatest(all_words, 1))::BIGINT + 3)) AS k)
  WHERE words > 0),
won AS (SELECT source, shard, count(*) AS won FROM q2 WHERE place <= source_quota GROUP BY source, shard),
quota AS (
  SELECT sh.source, sh.shard, ceil(words / {BLOCK_WORDS})::BIGINT AS blocks, least(coalesce(won, 0), 2 * ceil(words / {BLOCK_WORDS})::BIGINT) AS quota,
    ('0x' || substr(md5('{SEED}|' || coalesce(sh.source, '') || '|' || sh.shard), 1, 15))::BIGINT % greatest(ceil(words / {BLOCK_WORDS})::BIGINT, 1) AS phase
  FROM sh LEFT JOIN won ON sh.source IS NOT DISTINCT FROM won.source AND sh.shard = won.shard),
laid AS (
  SELECT p.*, q.blocks, q.quota, q.phase,
    coalesce(sum(size) OVER (PARTITION BY p.source, p.shard ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS begin_at
  FROM placed p JOIN quota q ON p.source IS NOT DISTINCT FROM q.source AND p.shard = q.shard)
SELECT doc_id, size, source_size, target, CASE WHEN size = 0 THEN 0 ELSE (
    SELECT sum((least((b + 1) * {BLOCK_WORDS}, begin_at + size) - greatest(b * {BLOCK_WORDS}, begin_at)) * (((b + 1) * quota + phase) // blocks - (b * quota + phase) // blocks))
    FROM (SELECT unnest(generate_series(begin_at // {BLOCK_WORDS}, (begin_at + size - 1) // {BLOCK_WORDS})) AS b))::BIGINT END AS taken
FROM laid
"""
