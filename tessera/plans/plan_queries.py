"""Queries of whole scans and run plans, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import nesting
from tessera.plans import run_queries, scan_queries  # noqa: F401  (their SQL)
from tessera.plans.registry import ORACLES, query
from tessera.sources import media, scans

_files, _FILES = scan_queries._files, scan_queries._FILES


def _natural(c: str) -> str:
    return f"list_transform(regexp_extract_all({c}, '[0-9]+|[^0-9]+'), lambda x: CASE WHEN regexp_matches(x, '^[0-9]') THEN '0' || lpad(x, 12, '0') ELSE '1' || lower(x) END)"


@query("s09_material_scan", f"""WITH v AS ({ORACLES["s06_formal_scan"]}), i AS ({ORACLES["s11_image_pages"]}), s AS ({ORACLES["s12_single_units"]}),
d AS (SELECT episode_path AS directory, any_value(season_id) AS season_id, any_value(episode_id) AS episode_id FROM v GROUP BY episode_path),
a AS (SELECT d.season_id, d.episode_id, s.path, s.unit_kind FROM s JOIN d ON d.directory = rtrim(regexp_extract(s.path, '^(.*/)?[^/]*$', 1), '/') WHERE regexp_matches(s.path, '[.](srt|lrc)$')),
u AS (SELECT season_id, episode_id, path, 'video' AS m, 'video_chunk' AS unit_kind, 'unknown' AS content_form, NULL::BIGINT AS page, 0 AS g, chunk_id AS c, '' AS warning FROM v
UNION ALL SELECT season_id, episode_id, path, 'text', unit_kind, 'script', NULL, 1, '', '' FROM a UNION ALL SELECT 'season_materials', episode_id, path, 'image', unit_kind, content_form, page, 0, '', '' FROM i
UNION ALL SELECT season_id, episode_id, path, media_type, unit_kind, content_form, NULL, 0, '', CASE WHEN regexp_matches(path, '[.](srt|lrc)$') THEN 'timed_text_episode_alignment_unmatched' ELSE '' END FROM s WHERE path NOT IN (SELECT path FROM a)),
k AS (SELECT season_id, episode_id, min(CASE WHEN season_id = 'season_materials' THEN m || ':' || lower(CASE WHEN m = 'image' THEN CASE WHEN contains(path, '/') THEN regexp_extract(path, '^(.*)/', 1) ELSE '.' END ELSE path END) END) AS key FROM u WHERE g = 0 GROUP BY ALL),
n AS (SELECT season_id, episode_id, row_number() OVER (ORDER BY key IS NOT NULL, CASE WHEN key IS NULL THEN season_id END, CASE WHEN key IS NULL THEN episode_id END, {_natural("coalesce(key, '')")}, key, episode_id) AS episode_no FROM k)
SELECT season_id, episode_id, episode_no, row_number() OVER (PARTITION BY season_id, episode_id ORDER BY g, c, page NULLS FIRST, {_natural("path")}, path) AS unit_no, 'unit_' || m || '_' || substr(sha1('unit:' || m || ':' || path), 1, 12) AS unit_id, path, unit_kind, content_form, page, warning FROM u JOIN n USING (season_id, episode_id)""")
def s09(spark, d):
    files = _files(spark, d)
    number = F.regexp_extract("path", "([0-9]+)[.][A-Za-z0-9]+$", 1).cast("long")
    known = files.filter(F.startswith("path", F.lit("derived_inputs/")) & ((number % 2 == 0) | (media.medium(F.col("path")) == "image")))
    indexed = known.select("path", F.lit("setting_book").alias("hint"), F.lit(None).cast("int").alias("page_number"), F.lit("f").alias("fingerprint"), F.create_map(F.lit("origin"), F.lit("x")).alias("metadata"))
    rows = scans.material_scan(files, indexed)
    return rows.select("season_id", "episode_id", "episode_no", F.col("unit_no").cast("long").alias("unit_no"), "unit_id", "path", "unit_kind", "content_form", F.col("page").cast("long").alias("page"), F.array_join("warnings", ",").alias("warning"))


@query("s18_uncovered", f"""WITH {_FILES} SELECT path FROM p WHERE NOT (starts_with(path, 'dir1/') OR starts_with(path, 'Dir2/sub/') OR starts_with(path, 'derived_inputs/x3/') OR (event_id % 7 = 0 AND event_id % 3 = 1))""")
def s18(spark, d):
    files = _files(spark, d)
    number = F.regexp_extract("path", "([0-9]+)[.][A-Za-z0-9]+$", 1).cast("long")
    single = files.filter((number % 7 == 0) & (number % 3 == 1)).select("path")
    roots = spark.createDataFrame([("dir1/",), ("Dir2\\sub",), ("derived_inputs/x3",), ("dir",)], "path string").unionByName(single)
    return scans.uncovered(files, roots)


_LEVELS = [(["season_id"], "episodes"), (["episode_id"], "units")]
_UNITS = """u AS (SELECT o_custkey AS season_id, l_orderkey AS episode_id, l_linenumber AS n, l_returnflag AS media, 'p' || l_partkey AS path, l_orderkey * 10 + l_linenumber AS o FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def _units(spark, d):
    orders, lines = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("orders", "lineitem"))
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select(F.col("o_custkey").alias("season_id"), F.col("l_orderkey").alias("episode_id"), F.col("l_returnflag").alias("media"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("path"), F.struct((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("n"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("p"), "l_returnflag").alias("at"))


@query("p25_manifest", f"""WITH {_UNITS}, e AS (SELECT season_id, episode_id, count(*) AS n, count(DISTINCT path) AS paths, min(o) AS o FROM u GROUP BY ALL)
SELECT season_id, count(*) AS episode_count, sum(n)::BIGINT AS unit_count, string_agg(episode_id || ':' || n || ':' || paths, ',' ORDER BY o) AS episodes FROM e GROUP BY season_id""")
def p25(spark, d):
    rows = nesting.manifest(nesting.nest(_units(spark, d), _LEVELS, "at"))
    told = F.array_join(F.transform("episodes", lambda e: F.concat_ws(":", e["episode_id"].cast("string"), e["unit_count"].cast("string"), F.size(e["paths"]).cast("string"))), ",")
    return rows.select("season_id", F.col("episode_count").cast("long").alias("episode_count"), F.col("unit_count").cast("long").alias("unit_count"), told.alias("episodes"))


@query("p31_handler_units", f"""WITH {_UNITS}, k AS (SELECT * FROM u WHERE media = 'R'), e AS (SELECT season_id, episode_id, string_agg(path, ',' ORDER BY o, path) AS paths FROM k GROUP BY ALL) SELECT season_id, episode_id, paths FROM e""")
def p31(spark, d):
    part = nesting.pruned(nesting.nest(_units(spark, d), _LEVELS, "at"), _LEVELS, lambda u: u["media"] == "R")
    return part.select("season_id", F.explode("episodes").alias("e")).select("season_id", "e.episode_id", F.array_join(F.transform("e.units", lambda u: u["path"]), ",").alias("paths"))


@query("a16_chunk_inputs", f"""WITH {_UNITS} SELECT season_id, episode_id, path, media, row_number() OVER (PARTITION BY season_id ORDER BY first, o, path, media) AS place FROM (SELECT *, min(o) OVER (PARTITION BY season_id, episode_id) AS first FROM u)""")
def a16(spark, d):
    nested = nesting.nest(_units(spark, d), _LEVELS, "at")
    # The places of the nested lists, episode after episode.
    flat = nested.select("season_id", F.posexplode("episodes").alias("i", "e")).select("season_id", "i", "e.episode_id", F.posexplode("e.units").alias("j", "u"))
    place = F.row_number().over(Window.partitionBy("season_id").orderBy("i", "j")).cast("long")
    return flat.select("season_id", "episode_id", "u.path", "u.media", place.alias("place"))
