"""Sharding by extendible hashing, with DataFrame functions.

A directory is indexed by the first bits of a document's hash. It starts at depth 0 and only a bucket whose
bytes exceed the limit is split on one more bit, until every shard fits. The bytes of all depths of a step
come from one aggregation into cells a few bits finer than the expected depth; only rows of cells that are
still too large go on to the next step.

Defined results: a null text counts 0 bytes; rows with a null doc_id are hashed by their text; rows that no hash
bit parts (one row larger than the limit, or rows equal in id) stay one shard above the limit; an empty table: no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle

BITS = 60
STEP = 6
LIMIT_BYTES = 1 << 20


def hash_bits(doc_id: str, text: str) -> F.Column:
    """60 bits of the MD5 of the id, or of the text where the id is null."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(doc_id).cast("string"), F.col(text), F.lit(""))), 1, 15), 16, 10).cast("long")


def _head(depth) -> F.Column:
    return F.expr(f"shiftright(h, {BITS} - {depth})")


def shard(docs: DataFrame, limit: int = LIMIT_BYTES) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_bytes, shard (its hash-prefix bits), depth, shard_bytes."""
    return _sharded(docs, limit).drop("h")


def _sharded(docs: DataFrame, limit: int) -> DataFrame:
    """The rows of shard() with their hash bits h, which decide the shard."""
    rows = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), hash_bits("doc_id", "text").alias("h"))
    rows = settle(rows, "rows")
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    depth, parts = 0, []
    while True:
        fine = min(BITS, (math.ceil(math.log2(max(1, total / limit))) if depth == 0 else depth) + STEP)
        cells = rows.groupBy(_head(fine).alias("cell")).agg(F.sum("n_bytes").alias("bytes"), F.min("h").alias("lo"), F.max("h").alias("hi"))
        cells = settle(cells, "cells")
        least = 0 if depth == 0 else depth + 1
        up = cells.select("*", F.explode(F.sequence(F.lit(least), F.lit(fine))).alias("depth"))
        prefix = F.expr(f"shiftright(cell, {fine} - depth)")
        sums = up.groupBy("depth", prefix.alias("prefix")).agg(F.sum("bytes").alias("shard_bytes"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        fits = sums.filter((F.col("shard_bytes") <= limit) | (F.col("lo") == F.col("hi"))).select("depth", "prefix", "shard_bytes")
        at = up.select("cell", "depth", prefix.alias("prefix")).join(fits, ["depth", "prefix"])
        found = settle(at.groupBy("cell").agg(F.min(F.struct("depth", "prefix", "shard_bytes")).alias("s")), "directory")
        parts.append(rows.withColumn("cell", _head(fine)).join(found, "cell").select("doc_id", "n_bytes", "h", "s.*"))
        over = cells.join(found, "cell", "left_anti").select("cell")
        if fine == BITS or not over.limit(1).count():
            break
        rows = settle(rows.withColumn("cell", _head(fine)).join(over, "cell", "left_semi").drop("cell"), "rows")
        depth = fine
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    bits = F.expr(f"CASE WHEN depth = 0 THEN '' ELSE lpad(bin(prefix), depth, '0') END")
    return out.select("doc_id", "n_bytes", "h", bits.alias("shard"), "depth", "shard_bytes")


def write_shards(docs: DataFrame, path: str, limit: int = LIMIT_BYTES) -> None:
    """Write docs, all rows and columns, as Parquet under path, one folder for each shard."""
    keys = _sharded(docs, limit).select(F.col("h").alias("h_"), "shard").distinct()
    docs.withColumn("h_", hash_bits("doc_id", "text")).join(keys, "h_").drop("h_").repartition("shard").write.partitionBy("shard").parquet(path)


def op8_sharding(spark, sf_dir: str) -> DataFrame:
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP8_SQL = f"""
WITH rows AS (
  SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, text, '')), 1, 15))::BIGINT AS h
  FROM documents),
up AS (SELECT *, d AS depth, h >> ({BITS} - d) AS prefix FROM rows, (SELECT unnest(generate_series(0, 40))::INTEGER AS d)),
sums AS (SELECT depth, prefix, sum(n_bytes)::BIGINT AS shard_bytes, min(h) AS lo, max(h) AS hi FROM up GROUP BY depth, prefix),
best AS (
  SELECT doc_id, h, min(depth) AS depth FROM up JOIN sums USING (depth, prefix)
  WHERE shard_bytes <= {LIMIT_BYTES} OR lo = hi GROUP BY doc_id, h)
SELECT r.doc_id, r.n_bytes, CASE WHEN b.depth = 0 THEN '' ELSE lpad(bin(r.h >> ({BITS} - b.depth)), b.depth, '0') END AS shard, b.depth, s.shard_bytes
FROM rows r JOIN best b ON r.h = b.h AND r.doc_id IS NOT DISTINCT FROM b.doc_id JOIN sums s ON s.depth = b.depth AND s.prefix = r.h >> ({BITS} - b.depth)
"""
