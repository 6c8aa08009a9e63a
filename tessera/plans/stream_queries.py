"""Queries of the streaming operators over finished tables, each beside its SQL."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans.registry import query
from tessera.streaming import readiness as R

_READY = """e AS (SELECT 'a' || user_id AS artifact_id, epoch_us(ts) AS us, event_id, CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'transcript' ELSE 'request' END AS kind, event_id % 4 AS paths, event_id % 50 AS segments, 'w' || event_id % 3 AS warning FROM events),
j AS (SELECT *, CASE kind WHEN 'request' THEN 0 WHEN 'failed' THEN 1 ELSE 2 END AS r, CASE WHEN kind = 'request' AND paths = 0 THEN 'missing' WHEN kind = 'request' THEN 'pending' WHEN kind = 'failed' THEN 'failed' ELSE 'ready' END AS status, CASE WHEN kind = 'request' AND paths = 0 THEN 'no_material_paths' WHEN kind = 'failed' THEN warning END AS told FROM e),
l AS (SELECT artifact_id, us, status, CASE WHEN kind = 'transcript' THEN segments ELSE 0 END AS segments FROM j QUALIFY row_number() OVER (PARTITION BY artifact_id ORDER BY us DESC, r DESC, CASE WHEN kind = 'transcript' THEN segments ELSE 0 END DESC, paths DESC) = 1),
w AS (SELECT artifact_id, string_agg(told, ',' ORDER BY f, told) AS warnings FROM (SELECT artifact_id, told, min(us) AS f FROM j WHERE told IS NOT NULL GROUP BY ALL) GROUP BY artifact_id),
g AS (SELECT l.*, coalesce(warnings, '') AS warnings, status = 'pending' AND us + 21600000000 < (SELECT max(us) - 3600000000 FROM e) AS gone FROM l LEFT JOIN w USING (artifact_id)),
ready AS (SELECT artifact_id, CASE WHEN gone THEN 'failed' ELSE status END AS status, segments, CASE WHEN gone THEN concat_ws(',', CASE WHEN warnings <> '' THEN warnings END, 'transcription_timeout') ELSE warnings END AS warnings FROM g)"""


def _ready(spark, d) -> DataFrame:
    i = F.col("event_id")
    kind = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "transcript").otherwise("request")
    events = spark.read.parquet(f"{d}/events.parquet").select(F.concat(F.lit("a"), F.col("user_id").cast("string")).alias("artifact_id"), F.col("ts").alias("at"), kind.alias("kind"), (i % 4).alias("paths"), (i % 50).alias("segments"), F.concat(F.lit("w"), (i % 3).cast("string")).alias("warning"))
    return R.readiness(events, timedelta(hours=6), timedelta(hours=1))


@query("r10_readiness", f"WITH {_READY} SELECT * FROM ready")
def r10(spark, d):
    return _ready(spark, d).withColumn("warnings", F.array_join("warnings", ","))


@query("j15_text_units", f"""WITH {_READY}, a AS (SELECT DISTINCT 'a' || user_id AS artifact_id, user_id // 5 AS episode, user_id % 2 = 0 AS has FROM events),
u AS (SELECT episode, artifact_id, 'video_' || artifact_id AS unit, NULL AS status, NULL AS segments, row_number() OVER (PARTITION BY episode ORDER BY artifact_id) * 2 AS place FROM a
UNION ALL SELECT episode, artifact_id, 'text', status, segments, CASE WHEN has THEN row_number() OVER (PARTITION BY episode ORDER BY artifact_id) * 2 + 1 END FROM a JOIN ready USING (artifact_id))
SELECT episode::VARCHAR AS episode_id, artifact_id, CASE unit WHEN 'text' THEN 'unit_' || substr(sha1('transcript:' || artifact_id), 1, 12) ELSE unit END AS unit_id, status, segments, row_number() OVER (PARTITION BY episode ORDER BY place NULLS LAST, CASE unit WHEN 'text' THEN 'unit_' || substr(sha1('transcript:' || artifact_id), 1, 12) END) AS pos
FROM u WHERE unit <> 'text' OR status = 'ready' OR status = 'pending' AND place IS NOT NULL""")
def j15(spark, d):
    users = spark.read.parquet(f"{d}/events.parquet").select("user_id").distinct()
    artifacts = users.select("user_id", F.concat(F.lit("a"), F.col("user_id").cast("string")).alias("artifact_id"), F.lit("s").alias("season_id"), F.floor(F.col("user_id") / 5).cast("string").alias("episode_id"))
    # A unit of video for each artifact, and for every second one a text that is there already.
    at = F.row_number().over(Window.partitionBy("episode_id").orderBy("artifact_id")) * 2
    base = artifacts.withColumn("pos", at)
    old = base.filter("user_id % 2 = 0").select("season_id", "episode_id", (F.col("pos") + 1).alias("pos"), F.lit("old").alias("unit_id"), F.lit("transcript_text").alias("unit_kind"), "artifact_id")
    units = base.select("season_id", "episode_id", "pos", F.concat(F.lit("video_"), "artifact_id").alias("unit_id"), F.lit("video").alias("unit_kind"), "artifact_id").unionByName(old)
    return R.text_units(units, artifacts, _ready(spark, d)).select("episode_id", "artifact_id", "unit_id", "status", "segments", "pos")
