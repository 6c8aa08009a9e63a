"""Queries of runs, transcripts, sources and samples, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import runs as N
from tessera.plans.registry import query
from tessera.plans.scan_queries import _FILES, _files
from tessera.sources import scans, stores


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("a18_run_counts", "SELECT user_id, count(*) AS total, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'error') AS error FROM events GROUP BY user_id")
def a18(spark, d):
    return N.counts(table(spark, d, "events"), "user_id", "event_type", ("click", "error"))


@query("a20_warnings", "SELECT user_id, string_agg(w, ',' ORDER BY event_id, p) AS warnings FROM (SELECT user_id, w, event_id, p FROM (SELECT user_id, event_id, unnest([event_type, 'k' || event_id % 3]) AS w, unnest([0, 1]) AS p FROM events) QUALIFY row_number() OVER (PARTITION BY user_id, w ORDER BY event_id, p) = 1) GROUP BY user_id")
def a20(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_id", F.array("event_type", F.concat(F.lit("k"), (F.col("event_id") % 3).cast("string"))).alias("w"))
    return N.warnings(rows, "user_id", "event_id", "w").select("user_id", F.array_join("warnings", ",").alias("warnings"))


@query("j05_material_transcripts", """WITH s AS (SELECT conv_id AS episode, turn AS segment, turn * 10.0 AS a, CASE WHEN turn % 4 = 3 THEN 0 ELSE turn * 10 + 8.5 END AS b, trim(substr(replace(text, chr(10), ' '), 1, 20)) AS t FROM conversations),
m AS (SELECT DISTINCT conv_id AS episode, unnest(['A.mp4', 'b.MP4', 'c.mp4', 'D.mp4']) AS material FROM conversations), r AS (SELECT *, CASE lower(material) WHEN 'a.mp4' THEN 0 WHEN 'b.mp4' THEN 25 END AS lo, CASE lower(material) WHEN 'a.mp4' THEN 12 WHEN 'b.mp4' THEN 41 END AS hi FROM m),
f AS (SELECT episode, material, string_agg('[' || printf('%02d:%02d', floor(a)::BIGINT // 60, floor(a)::BIGINT % 60) || '-' || printf('%02d:%02d', floor(b)::BIGINT // 60, floor(b)::BIGINT % 60) || '] ' || t, chr(10) ORDER BY segment) AS told FROM r JOIN s USING (episode) WHERE lo IS NOT NULL AND (b = 0 OR b >= lo) AND a <= hi AND t <> '' GROUP BY ALL),
x AS (SELECT r.episode, r.material, CASE WHEN lo IS NOT NULL THEN coalesce(told, '') WHEN r.material = 'c.mp4' THEN 'plain ' || r.episode || repeat(' text', 30) ELSE '' END AS v FROM r LEFT JOIN f USING (episode, material)) SELECT episode, material, CASE WHEN length(v) <= 100 THEN v ELSE rtrim(substr(v, 1, 97)) || '...' END AS text FROM x""")
def j05(spark, d):
    c = table(spark, d, "conversations").withColumn("episode", F.col("conv_id"))
    t = F.col("turn")
    segments = c.select("episode", t.alias("segment"), (t * 10.0).alias("start"), F.when(t % 4 == 3, 0.0).otherwise(t * 10 + 8.5).alias("end"), F.substring(F.replace("text", F.lit("\n"), F.lit(" ")), 1, 20).alias("text"))
    episodes = c.select("episode").distinct()
    materials = episodes.withColumn("material", F.explode(F.array(*map(F.lit, ("A.mp4", "b.MP4", "c.mp4", "D.mp4")))))
    row = lambda pos, path, lo, hi: F.struct(F.lit(pos).alias("pos"), F.lit(path).alias("path"), F.lit(lo).alias("start"), F.lit(hi).alias("end"))
    ranges = episodes.withColumn("r", F.explode(F.array(row(1, "a.MP4", 0.0, 12.0), row(3, "B.mp4", 0.0, 99.0), row(2, "b.mp4", 25.0, 41.0)))).select("episode", "r.*")
    plain = episodes.select("episode", F.explode(F.array(F.lit("C.mp4"), F.lit("a.mp4"))).alias("path"), F.concat(F.lit("plain "), F.col("episode").cast("string"), F.lit(" text" * 30)).alias("text"))
    return N.material_transcripts(materials, ranges, segments, plain, 100)


@query("j10_earlier_seasons", "SELECT a.user_id, a.season, coalesce(string_agg(b.season || ':' || b.n, ',' ORDER BY b.season), '') AS earlier FROM (SELECT user_id, ts::DATE::VARCHAR AS season FROM events GROUP BY ALL) a LEFT JOIN (SELECT user_id, ts::DATE::VARCHAR AS season, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 1) b ON a.user_id = b.user_id AND b.season < a.season GROUP BY a.user_id, a.season")
def j10(spark, d):
    rows = table(spark, d, "events").groupBy("user_id", F.to_date("ts").cast("string").alias("season")).agg(F.count("*").alias("n"))
    rows = rows.withColumn("background", F.when(F.col("n") > 1, F.col("n").cast("string")).otherwise(" "))
    out = N.earlier_seasons(rows, "user_id", "season", "season", "background")
    return out.select("user_id", "season", F.array_join(F.transform("earlier", lambda x: F.concat_ws(":", x["season"], x["background"])), ",").alias("earlier"))


@query("j16_state_for_name", "SELECT p_type, min(p_partkey) AS p_partkey, arg_min(p_name, p_partkey) AS p_name FROM part WHERE contains(lower(p_name), 'cold') OR contains('a large bolt and more', lower(p_name)) GROUP BY p_type")
def j16(spark, d):
    return N.state_for(table(spark, d, "part").select("p_type", "p_partkey", "p_name"), "p_type", "p_partkey", "p_name", ["COLD", " a Large bolt and more ", "x"])


@query("s17_source_states", """WITH t AS (SELECT event_id, user_id % 50 AS source, event_id % 7 > 0 AS raw_exists, user_id % 5 = 0 AS cleaned, event_id % 11 > 0 AS processed, user_id % 10 = 0 AS has_material, event_id % 97 = 1 AS newer FROM events WHERE user_id % 50 < 45),
g AS (SELECT source, count(*) AS n, bool_and(cleaned AND has_material) AS gone, count(*) FILTER (raw_exists) AS raw, bool_or(raw_exists AND newer) AS newer, bool_and(NOT raw_exists OR processed) AS done FROM t WHERE source % 3 > 0 OR raw_exists AND event_id % 11 > 0 GROUP BY source)
SELECT s.source, CASE WHEN n IS NULL THEN 'new' WHEN gone THEN 'raw_cleaned' WHEN raw = 0 THEN 'new' WHEN raw < n THEN 'stale' WHEN newer THEN 'stale' WHEN done THEN 'processed' ELSE 'stale' END AS status FROM (SELECT DISTINCT user_id % 50 AS source FROM events) s LEFT JOIN g USING (source)""")
def s17(spark, d):
    e = table(spark, d, "events").withColumn("source", F.col("user_id") % 50)
    i, u = F.col("event_id"), F.col("user_id")
    t = e.filter("source < 45").select("source", "event_id", (i % 7 > 0).alias("raw_exists"), (u % 5 == 0).alias("cleaned"), (i % 11 > 0).alias("processed"), (u % 10 == 0).alias("has_material"), (i % 97 == 1).alias("newer"))
    return N.source_states(e.select("source").distinct(), t.filter((F.col("source") % 3 > 0) | F.col("raw_exists") & (i % 11 > 0)))


@query("s46_packages", """WITH r AS (SELECT user_id AS sample, event_id AS pos, 'materials/f' || event_id AS label, ['copy_allowed', 'index_only_large', 'missing', 'outside_project'][1 + event_id % 4] AS policy, event_id % 9 > 0 AS there, event_id % 100 AS size FROM events),
k AS (SELECT *, CASE WHEN policy = 'missing' THEN 'missing' WHEN policy = 'outside_project' THEN 'indexed' WHEN NOT there THEN 'missing' WHEN size > 50 THEN 'indexed' ELSE 'copied' END AS kind FROM r)
SELECT sample, coalesce(string_agg('materials/f' || pos, ',' ORDER BY pos) FILTER (kind = 'copied'), '') AS copied, coalesce(string_agg(label, ',' ORDER BY pos) FILTER (kind = 'indexed'), '') AS indexed, coalesce(string_agg(label, ',' ORDER BY pos) FILTER (kind = 'missing'), '') AS missing,
 coalesce(string_agg(CASE WHEN policy = 'outside_project' THEN 'material not copied due to outside_project: ' || label ELSE 'material exceeds copy limit and was indexed only: ' || label END, ',' ORDER BY pos) FILTER (policy = 'outside_project' OR kind = 'indexed'), '') AS warnings FROM k GROUP BY sample""")
def s46(spark, d):
    i = F.col("event_id")
    policy = N.copy_policy(i % 4 != 3, i % 4 == 3, i % 4 != 2, F.when(i % 4 == 1, 99).otherwise(1), 50)
    refs = table(spark, d, "events").select(F.col("user_id").alias("sample"), i.alias("pos"), F.concat(F.lit("materials/f"), i.cast("string")).alias("label"), policy.alias("policy"), (i % 9 > 0).alias("exists"), (i % 100).alias("size"))
    out = N.packaged(refs, True, 50)
    return out.select("sample", *[F.array_join(c, ",").alias(c) for c in ("copied", "indexed", "missing", "warnings")])


@query("s06_formal_scan", f"""WITH {_FILES}, v AS (SELECT *, length(path) - length(replace(path, '/', '')) AS depth, split_part(path, '/', 1) AS top, starts_with(lower(name), 'segment_') AS seg FROM p WHERE ending IN ('.mp4', '.mkv')),
d AS (SELECT directory, bool_or(seg) AS cut FROM v WHERE depth > 0 GROUP BY directory), w AS (SELECT directory AS top FROM d WHERE cut AND NOT contains(directory, '/')),
r AS (SELECT CASE WHEN depth = 0 THEN '.' ELSE top END AS season, path AS episode_path, 'chunk_0001' AS chunk_id, path FROM v WHERE depth = 0 OR depth = 1 AND top NOT IN (SELECT top FROM w)
 UNION ALL SELECT CASE WHEN depth = 1 THEN '.' ELSE top END, directory, printf('chunk_%04d', row_number() OVER (PARTITION BY directory ORDER BY lower(name), path)), path FROM v WHERE seg AND (depth = 1 OR depth = 2 AND top NOT IN (SELECT top FROM w))),
s AS (SELECT season, row_number() OVER (ORDER BY season <> '.', lower(season), season) AS s FROM (SELECT DISTINCT season FROM r)), e AS (SELECT season, episode_path, row_number() OVER (PARTITION BY season ORDER BY lower(episode_path), episode_path) AS e FROM (SELECT DISTINCT season, episode_path FROM r))
SELECT printf('season_%03d', s) AS season_id, printf('episode_%03d', e) AS episode_id, chunk_id, episode_path, path FROM r JOIN s USING (season) JOIN e USING (season, episode_path)""")
def s06(spark, d):
    return scans.formal_scan(_files(spark, d))


@query("s25_book_order", """WITH i AS (SELECT l_orderkey AS book, l_linenumber AS pos, 'i' || l_linenumber AS item_id, 'c' || l_linenumber % 5 AS entry FROM lineitem), sp AS (SELECT l_orderkey AS book, 10 - l_linenumber AS pos, 'i' || l_linenumber AS item_id, CASE WHEN l_returnflag = 'N' THEN 'NO' END AS lin FROM lineitem WHERE l_orderkey % 4 > 0),
r AS (SELECT book, 0 AS kind, sp.pos, entry FROM sp JOIN i USING (book, item_id) WHERE lin IS NULL UNION ALL SELECT book, 1, pos, entry FROM i), b AS (SELECT book, entry, min(pos) AS pos FROM (SELECT * FROM r QUALIFY kind = min(kind) OVER (PARTITION BY book)) GROUP BY ALL), t AS (SELECT *, entry <> 'c3' AS there FROM b)
SELECT book, row_number() OVER (PARTITION BY book ORDER BY pos, entry) AS chapter, entry, NULL AS warning FROM t WHERE there UNION ALL SELECT book, NULL, entry, 'epub_entry_missing' FROM t WHERE NOT there""")
def s25(spark, d):
    l = table(spark, d, "lineitem")
    n, item = F.col("l_linenumber"), F.concat(F.lit("i"), F.col("l_linenumber").cast("string"))
    items = l.select(F.col("l_orderkey").alias("book"), n.alias("pos"), item.alias("item_id"), F.concat(F.lit("c"), (n % 5).cast("string")).alias("entry"))
    spine = l.filter("l_orderkey % 4 > 0").select(F.col("l_orderkey").alias("book"), (10 - n).alias("pos"), item.alias("item_id"), F.when(F.col("l_returnflag") == "N", "NO").alias("linear"))
    return scans.book_order(items, spine, items.filter("entry <> 'c3'").select("book", "entry")).withColumn("chapter", F.col("chapter").cast("long"))


@query("s29_material_index", """WITH m AS (SELECT user_id % 30 AS f, event_id, event_type = 'click' AS complete, event_id % 3 AS v FROM events), g AS (SELECT f, max(event_id) AS event_id FROM m WHERE complete AND v = 1 GROUP BY f)
SELECT 'derived/f' || f || '/' || n AS path, 'raw' || f AS raw_path, 'zip' AS preprocessor, 'e' || event_id AS entry, 'zip' AS container_format, sha256('1') AS source_hash, 'script' AS hint FROM g, (VALUES ('a'), ('b')) x(n)""")
def s29(spark, d):
    f, v = (F.col("user_id") % 30).cast("string"), (F.col("event_id") % 3).cast("string")
    root = F.concat(F.lit("derived/f"), f)
    one = lambda n: F.struct(F.concat(root, F.lit(n)).alias("material_relative_path"), F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("source_entry_path"), F.lit("script").alias("content_form_hint"))
    rows = table(spark, d, "events").select(F.col("event_id").alias("manifest"), F.col("event_id").alias("pos"), F.concat(F.lit("raw"), f).alias("source_raw_path"), F.sha2(v, 256).alias("source_hash"), root.alias("output_root"), F.lit("zip").alias("preprocessor"), F.lit(".zip").alias("source_suffix"), (F.col("event_type") == "click").alias("complete"), F.array(one("/a"), one("/b"), one("/../x"), one("x/y")).alias("derived"))
    raw = rows.select(F.col("source_raw_path").alias("path"), F.sha2(F.lit("1"), 256).alias("hash")).distinct()
    return stores.material_index(rows, raw)


@query("s41_configs", """SELECT page_id::VARCHAR AS path, CASE WHEN page_id % 5 IN (0, 4) THEN 'p' || page_id END AS project_id, CASE page_id % 5 WHEN 1 THEN 'not_a_json_object' WHEN 2 THEN 'project_id_missing' WHEN 3 THEN 'updated_at_invalid' END AS issue FROM pages""")
def s41(spark, d):
    i = F.col("page_id").cast("string")
    texts = F.array(F.concat(F.lit('{"project_id": "p'), i, F.lit('", "name": " n ", "updated_at": "2024-01-02T03:04:05"}')), F.lit("[1]"), F.lit('{"updated_at": "2024-01-02"}'), F.lit('{"project_id": "x", "updated_at": "soon"}'))
    text = F.when(F.col("page_id") % 5 == 4, F.get(texts, F.lit(0))).otherwise(F.get(texts, (F.col("page_id") % 5).cast("int")))
    good, bad = stores.configs(table(spark, d, "pages").select(i.alias("path"), text.alias("text")))
    return good.select("path", "project_id", F.lit(None).cast("string").alias("issue")).unionByName(bad.select("path", F.lit(None).cast("string").alias("project_id"), "issue"))


@query("s43_imports", """WITH c AS (SELECT page_id, page_id % 4 AS k, printf('%06d', page_id) AS path FROM pages), g AS (SELECT *, CASE WHEN row_number() OVER (ORDER BY path) = 1 THEN 2 ELSE 2 + row_number() OVER (ORDER BY path) END AS no FROM c WHERE k < 2)
SELECT path, 'prj' AS project_id, 'ann-lee-' || no AS card_id, 'c' || page_id AS imported_card_id, CASE k WHEN 0 THEN 'Ann  Lee' ELSE 'ann lee' END AS name, CASE k WHEN 0 THEN 'DRAFT' ELSE 'COMPILED' END AS compile_status, NULL AS error FROM g
UNION ALL SELECT path, 'prj', NULL, CASE k WHEN 2 THEN 'c' || page_id ELSE '' END, 'Imported Character', NULL, CASE k WHEN 2 THEN 'card_format_unknown' ELSE 'card_unreadable' END FROM c WHERE k >= 2""")
def s43(spark, d):
    i = F.col("page_id").cast("string")
    card = lambda rest: F.concat(F.lit('{"card_id": "c'), i, F.lit('", ' + rest + "}"))
    texts = F.array(card('"format": "x.card", "identity": {"character_name": "Ann  Lee"}, "compile_status": "PREVIEW"'), card('"format": "x.card", "identity": {"character_name": " ", "display_name": "ann lee"}, "compile_status": "COMPILED"'), card('"format": "y"'), F.lit("{"))
    rows = table(spark, d, "pages").select(F.format_string("%06d", "page_id").alias("path"), F.get(texts, (F.col("page_id") % 4).cast("int")).alias("text"))
    return stores.imported(rows, "prj", "x.card", spark.createDataFrame([("ann-lee",), ("ann-lee-3",), ("bob",)], "card_id string"))


@query("s45_failure_records", """WITH r AS (SELECT event_id, 'x sk-*** ' || event_type AS e FROM events), j AS (SELECT event_id, '{"error_summary":"' || e || '","error_type":"T","metadata":{"api_key":"<redacted>","n":"' || event_id || '"},"model_name":"m","project_id":"p","prompt_purpose":"q","provider":"v","source_path":"<outside_project>/f.txt"}' AS json, e FROM r)
SELECT event_id, e AS error_summary, substr(sha256('salt:' || json), 1, 16) AS sample_hash FROM j""")
def s45(spark, d):
    i = F.col("event_id").cast("string")
    text = lambda v, n: F.lit(v).alias(n)
    rows = table(spark, d, "events").select(text("p", "project_id"), text("/home/me/f.txt", "source_path"), text("q", "prompt_purpose"), text("v", "provider"), text("m", "model_name"), text("T", "error_type"), F.concat(F.lit("x  sk-abcdefghij "), "event_type").alias("error_summary"), F.create_map(F.lit("n"), i, F.lit("api_key"), F.lit("k")).alias("metadata"))
    return stores.failure_records(rows, "salt").select(F.col("metadata")["n"].cast("long").alias("event_id"), "error_summary", "sample_hash")


@query("a07_traces", """WITH r AS (SELECT l_orderkey AS k, l_linenumber * 1000000000000 + l_partkey * 1000000 + l_suppkey AS pos, ['material', 'unit', 'derived', 'material'][1 + l_linenumber % 4] AS kind, CASE WHEN l_partkey % 3 = 0 THEN '' ELSE 'x' || l_partkey % 5 END AS id, 'p' || l_partkey % 2 AS path, CASE l_suppkey % 3 WHEN 0 THEN 'video' WHEN 1 THEN 'text' END AS m FROM lineitem),
q AS (SELECT k, kind, CASE WHEN kind = 'material' AND id = '' THEN path ELSE id END AS key, pos, m FROM r), d AS (SELECT k, kind, key, min(pos) AS first, arg_min(coalesce(m, ''), pos) AS m FROM q WHERE key <> '' GROUP BY k, kind, key), c AS (SELECT k, m, count(*) AS n FROM d WHERE kind = 'material' AND m <> '' GROUP BY ALL), j AS (SELECT k, string_agg(m || ':' || n, ',' ORDER BY m) AS media, count(*) AS x, min(m) AS one FROM c GROUP BY k)
SELECT k, count(*) FILTER (kind = 'material') AS materials, count(*) FILTER (kind = 'unit') AS units, count(*) FILTER (kind = 'derived') AS derived, coalesce(string_agg(key, ',' ORDER BY first) FILTER (kind = 'unit'), '') AS unit_refs, coalesce(any_value(media), '') AS media, CASE any_value(x) WHEN 1 THEN any_value(one) ELSE CASE WHEN any_value(x) > 1 THEN 'mixed' ELSE 'unknown' END END AS source_kind FROM d LEFT JOIN j USING (k) GROUP BY k""")
def a07(spark, d):
    n, p = F.col("l_linenumber"), F.col("l_partkey")
    kind = F.element_at(F.array(*map(F.lit, ("material", "unit", "derived", "material"))), n % 4 + 1)
    refs = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), (n * 1_000_000_000_000 + p * 1_000_000 + F.col("l_suppkey")).alias("pos"), kind.alias("kind"), F.when(p % 3 == 0, "").otherwise(F.concat(F.lit("x"), (p % 5).cast("string"))).alias("id"), F.concat(F.lit("p"), (p % 2).cast("string")).alias("path"), F.when(F.col("l_suppkey") % 3 == 0, "video").when(F.col("l_suppkey") % 3 == 1, "text").alias("media_type"))
    out = N.traces(refs, "k")
    media = F.array_join(F.transform(F.array_sort(F.map_entries("media_counts")), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ",")
    return out.select("k", "materials", "units", "derived", F.array_join("unit_refs", ",").alias("unit_refs"), media.alias("media"), "source_kind")


@query("r12_unit_events", """SELECT p_partkey, CASE WHEN p_partkey % 6 = 0 THEN 'unsupported' WHEN p_partkey % 5 = 0 THEN 'skipped' WHEN p_partkey % 2 = 0 THEN 'completed' WHEN p_partkey % 3 = 0 THEN 'failed' ELSE 'no_result' END AS event,
 CASE WHEN p_partkey % 6 > 0 AND p_partkey % 5 > 0 AND p_partkey % 2 = 1 AND p_partkey % 3 = 0 THEN 'first' END AS error, CASE WHEN p_partkey % 2 = 0 THEN 3 ELSE 0 END AS chunks FROM part""")
def r12(spark, d):
    i = F.col("p_partkey")
    parts = table(spark, d, "part").select(i.alias("unit_id"))
    u = F.col("unit_id")
    units = parts.select("unit_id", F.when(u % 6 > 0, "text").alias("handler"), (u % 5 == 0).alias("skipped"))
    results = parts.filter(u % 2 == 0).select("unit_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("chunks"))
    failures = parts.filter(u % 3 == 0).select("unit_id", F.explode(F.array(F.struct(F.lit(2).alias("pos"), F.lit("second").alias("error")), F.struct(F.lit(1).alias("pos"), F.lit("first").alias("error")))).alias("f")).select("unit_id", "f.*")
    return N.unit_events(units, results, failures).withColumnRenamed("unit_id", "p_partkey")


@query("w07_earlier_chunks", """WITH s AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 1 THEN '' ELSE 'i' || turn END AS i FROM conversations), b AS (SELECT a.conv_id, a.turn, b.turn AS t, b.i FROM s a JOIN s b ON a.conv_id = b.conv_id AND b.turn < a.turn), l AS (SELECT conv_id, turn, string_agg(i, ',' ORDER BY t) AS insights FROM (SELECT * FROM b WHERE i <> '' QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY t DESC) <= 3) GROUP BY ALL)
SELECT s.conv_id, s.turn, (SELECT count(*) FROM b WHERE b.conv_id = s.conv_id AND b.turn = s.turn) AS earlier, coalesce(insights, '') AS insights FROM s LEFT JOIN l ON l.conv_id = s.conv_id AND l.turn = s.turn""")
def w07(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 3 == 1, " ").otherwise(F.concat(F.lit(" i"), F.col("turn").cast("string"))).alias("insight"))
    return N.earlier_chunks(rows, ["conv_id"], "turn", "insight").withColumn("insights", F.array_join("insights", ","))


@query("j06_merge_inputs", "SELECT o_orderkey, CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 25) AND o_custkey % 2 = 0 THEN 'both' ELSE 'missing' END AS state FROM orders")
def j06(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    contents = table(spark, d, "lineitem").filter("l_quantity > 25").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("run", F.lit("r1"))
    summaries = o.select("o_orderkey", F.when(F.col("o_custkey") % 2 == 0, "r1").otherwise("r0").alias("run"))
    both, missing = N.merge_inputs(o, contents, summaries, ["o_orderkey"])
    return both.select("o_orderkey", F.lit("both").alias("state")).union(missing.select("o_orderkey", F.lit("missing")))
