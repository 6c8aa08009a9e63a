"""Queries of the knowledge base that Spark writes from tables and reads again, each beside its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.order import placed, shared_dir, written
from tessera.plans.registry import query
from tessera.sources import knowledge as K


def _saved(rows: DataFrame) -> DataFrame:
    """rows written to a new knowledge base in the shared folder, and its files, listed and read once."""
    spark = rows.sparkSession
    root = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/kb-{uuid.uuid4().hex}"
    K.save(rows, root)
    return written(K.store(spark, root), "kb-files")


def _place(kind: str, season=None, episode=None, item=None) -> list:
    ids = ((n, c if c is not None else F.lit(None).cast("string")) for n, c in (("season_id", season), ("episode_id", episode), ("item_id", item)))
    return [F.lit(kind).alias("kind"), F.lit("p").alias("project_id"), *[c.alias(n) for n, c in ids]]


@query("s37_store_reads", """WITH c AS (SELECT conv_id, turn, 's' || conv_id // 50 AS season_id, 'e' || conv_id AS episode_id, coalesce(text, '') AS text FROM conversations)
SELECT 'chunk' AS kind, season_id, episode_id, 'c' || turn AS item_id, CASE WHEN turn % 5 = 3 THEN 'corrupt' ELSE sha256(text) END AS said FROM c
UNION ALL SELECT DISTINCT 'episode_content', season_id, episode_id, NULL, sha256('e' || conv_id) FROM c UNION ALL SELECT DISTINCT 'season_summary', season_id, NULL, NULL, sha256(season_id) FROM c""")
def s37(spark, d):
    c = spark.read.parquet(f"{d}/conversations.parquet")
    season, episode = F.concat(F.lit("s"), F.floor(F.col("conv_id") / 50).cast("string")), F.concat(F.lit("e"), F.col("conv_id").cast("string"))
    said = lambda x: F.to_json(F.struct(F.coalesce(x, F.lit("")).alias("said")))
    chunks = c.select(*_place("chunk", season, episode, F.concat(F.lit("c"), F.col("turn").cast("string"))), F.when(F.col("turn") % 5 == 3, F.lit("{")).otherwise(said(F.col("text"))).alias("text"))
    contents = c.select(*_place("episode_content", season, episode), said(episode).alias("text")).distinct()
    seasons = c.select(*_place("season_summary", season), said(season).alias("text")).distinct()
    files = _saved(chunks.unionByName(contents).unionByName(seasons))
    good, issues = K.current(files)
    ids = ["kind", "season_id", "episode_id", "item_id"]
    corrupt = files.join(issues.select("path"), "path").select(*ids, F.lit("corrupt").alias("said"))
    return good.select(*ids, F.sha2(K.field("$.said"), 256).alias("said")).unionByName(corrupt)


@query("s42_card_summaries", """SELECT 'k' || s_suppkey AS card_id, CASE WHEN s_suppkey % 3 = 0 THEN 'k' || s_suppkey ELSE s_name END AS display_name, 't' || s_nationkey AS tags, CASE WHEN s_suppkey % 2 = 0 THEN 'p/character_cards/k' || s_suppkey || '/c.png' ELSE '' END AS cover_path,
 row_number() OVER (ORDER BY s_suppkey % 28 DESC, 'k' || s_suppkey) AS place FROM supplier WHERE s_suppkey % 7 <> 0""")
def s42(spark, d):
    i = F.col("s_suppkey")
    card = F.struct(
        F.when(i % 7 == 0, "preview").otherwise("OFFICIAL").alias("card_kind"), F.struct(F.when(i % 3 == 0, "").otherwise(F.col("s_name")).alias("display_name")).alias("identity"), F.struct(F.array(F.concat(F.lit("t"), F.col("s_nationkey").cast("string"))).alias("tags")).alias("user_metadata"),
        F.struct(F.when(i % 2 == 0, "c.png").otherwise("").alias("cover_path")).alias("assets"), F.format_string("2024-01-%02dT00:00:00", i % 28 + 1).alias("updated_at"),
    )
    files = _saved(spark.read.parquet(f"{d}/supplier.parquet").select(*_place("card", None, None, F.concat(F.lit("k"), i.cast("string"))), F.to_json(card).alias("text")))
    rows = K.card_summaries(K.current(files)[0])
    rows = placed(rows, [-F.unix_micros("updated_at"), F.col("card_id")], name="cards")
    return rows.select("card_id", "display_name", F.array_join("tags", ",").alias("tags"), "cover_path", "place")


@query("s52_reused_manifests", """WITH s AS (SELECT p_partkey AS k, p_partkey % 6 AS c FROM part)
SELECT 'raw/' || k || '.zip' AS raw_path, CASE WHEN c IN (0, 1) THEN 'm' || k || CASE c WHEN 0 THEN 'b' ELSE 'a' END END AS manifest, CASE c WHEN 0 THEN 'reused' WHEN 1 THEN 'reused' WHEN 2 THEN 'source_changed' WHEN 3 THEN 'derived_files_changed' WHEN 4 THEN 'manifest_invalid' ELSE 'manifest_missing' END AS reason FROM s""")
def s52(spark, d):
    part = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("k"), (F.col("p_partkey") % 6).alias("c"), "p_size")
    key, raw = F.col("k").cast("string"), F.concat(F.lit("raw/"), F.col("k").cast("string"), F.lit(".zip"))
    now, file = F.sha2(key, 256), F.concat(F.lit("text/"), key, F.lit(".txt"))
    mark = F.concat(F.lit("sha256:"), F.sha2(file, 256))
    # Copy a is the older one; of case 1 the newer one no longer holds.
    copies = part.filter("c <> 5").select("*", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("copy"))
    newer = F.col("copy") == "b"
    size = F.when((F.col("c") == 3) | (F.col("c") == 1) & newer, F.col("p_size") + 1).otherwise(F.col("p_size"))
    hash_ = F.when(F.col("c") == 2, F.sha2(raw, 256)).when(F.col("c") == 4, "x").otherwise(now)
    record = F.struct(file.alias("material_relative_path"), size.alias("size_bytes"), mark.alias("fingerprint"))
    text = F.to_json(F.struct(raw.alias("source_raw_path"), hash_.alias("source_hash"), F.array(record).alias("derived_materials")))
    manifests = copies.select(F.concat(F.lit("m"), key, "copy").alias("path"), F.timestamp_seconds(F.when(newer, 2).otherwise(1)).alias("modified"), text.alias("text"))
    return K.reusable(manifests, part.select(raw.alias("raw_path"), now.alias("hash")), part.select(file.alias("path"), F.col("p_size").alias("size"), mark.alias("fingerprint")))
