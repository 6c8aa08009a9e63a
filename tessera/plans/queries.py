"""The library's queries over the driver's tables, each beside the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import responses
from tessera.functions import text as T
from tessera.operators import context, dispatch, joins, rollup
from tessera.plans.registry import query
from tessera.sources import files, media
from tessera.streaming import events as streams

SEASON = 10
TERMS, CAUSAL = ["que", "und", "the"], ["les", "der", "of"]
BUDGET = 2000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as chunks: ten conversations a season."""
    rows = table(spark, sf_dir, "conversations")
    return rows.select(F.floor(F.col("conv_id") / SEASON).cast("long").alias("season"), F.col("conv_id").alias("episode"), F.col("turn").alias("chunk"), "text")


_CHUNKS = f"""chunks AS (SELECT conv_id // {SEASON} AS season, conv_id AS episode, turn AS chunk, text FROM conversations),
raw AS (SELECT season, episode, chunk, regexp_split_to_array(replace(coalesce(text, ''), chr(10), ' '), '[.!?]') AS parts FROM chunks),
cut AS (SELECT season, episode, chunk, generate_subscripts(parts, 1) AS pos, trim(unnest(parts)) AS item FROM raw),
items AS (SELECT * FROM cut WHERE item <> '')"""
_SEEN = f"{_CHUNKS}, seen AS (SELECT season, episode, item, count(*) AS copies, min((chunk, pos)) AS place FROM items GROUP BY ALL)"


def _terms(column: str, terms: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower({column}), '{t}')" for t in terms) + ")"


@query("a01_episode_rollup", f"""WITH {_SEEN},
per AS (SELECT season, episode, sum(copies)::BIGINT AS n_items, count(*) AS n_distinct, string_agg(item, ' | ' ORDER BY place) AS items FROM seen GROUP BY ALL),
n AS (SELECT season, episode, count(*) AS n_chunks FROM chunks GROUP BY ALL)
SELECT n.season, n.episode, n_chunks, coalesce(n_items, 0) AS n_items, coalesce(n_distinct, 0) AS n_distinct, coalesce(items, '') AS items
FROM n LEFT JOIN per USING (season, episode)""")
def a01(spark, d):
    return rollup.episode_rollup(chunks(spark, d))


@query("a04_season_rollup", f"""WITH {_CHUNKS}
SELECT c.season, n_episodes, n_chunks, coalesce(n_items, 0) AS n_items, coalesce(n_distinct, 0) AS n_distinct
FROM (SELECT season, count(DISTINCT episode) AS n_episodes, count(*) AS n_chunks FROM chunks GROUP BY season) c
LEFT JOIN (SELECT season, count(*) AS n_items, count(DISTINCT item) AS n_distinct FROM items GROUP BY season) i USING (season)""")
def a04(spark, d):
    return rollup.season_rollup(chunks(spark, d))


@query("a05_season_background", f"""WITH {_SEEN},
top AS (SELECT *, row_number() OVER (PARTITION BY season, episode ORDER BY place) AS k FROM seen),
lines AS (SELECT season, episode, string_agg(item, '; ' ORDER BY k) AS line FROM top GROUP BY ALL)
SELECT season, count(*) AS n_episodes, string_agg(episode || ': ' || line, ' | ' ORDER BY episode) AS background FROM lines GROUP BY season""")
def a05(spark, d):
    return rollup.season_background(chunks(spark, d))


@query("w01_term_timeline", f"""WITH {_CHUNKS}, found AS (SELECT * FROM items WHERE {_terms("item", TERMS)}),
steps AS (SELECT season, episode, count(*) AS n_items FROM found GROUP BY ALL),
fresh AS (SELECT season, episode, count(*) AS n FROM (SELECT season, item, min(episode) AS episode FROM found GROUP BY ALL) GROUP BY ALL)
SELECT season, episode, n_items, sum(n_items) OVER w::BIGINT AS evidence_count, sum(coalesce(n, 0)) OVER w::BIGINT AS distinct_count
FROM steps LEFT JOIN fresh USING (season, episode) WINDOW w AS (PARTITION BY season ORDER BY episode)""")
def w01(spark, d):
    return rollup.term_timeline(chunks(spark, d), TERMS)


_LAYERS = f"""{_CHUNKS},
layers AS (SELECT c.season, c.episode, CASE WHEN bool_or({_terms("item", TERMS[:1])}) THEN 'direct' WHEN bool_or({_terms("item", TERMS[1:])} AND {_terms("item", CAUSAL)}) THEN 'causal'
  WHEN bool_or({_terms("item", TERMS[1:])}) THEN 'mention' ELSE 'none' END AS layer, count(item) AS n_items
  FROM (SELECT DISTINCT season, episode FROM chunks) c LEFT JOIN items i ON c.season = i.season AND c.episode = i.episode GROUP BY ALL)"""


@query("a10_evidence_layers", f"WITH {_LAYERS} SELECT * FROM layers")
def a10(spark, d):
    return rollup.evidence_layers(chunks(spark, d), TERMS[:1], TERMS[1:], CAUSAL)


@query("a11_evidence_profile", "WITH p AS (SELECT lang, source FROM documents) SELECT 'lang' AS dimension, lang AS value, count(*) AS n FROM p GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM p GROUP BY source")
def a11(spark, d):
    return rollup.profile(table(spark, d, "documents"), ("lang", "source"))


@query("a12_conflict_groups", f"""WITH {_CHUNKS}
SELECT f.season, f.episode, f.chunk, f.pos - 1 AS pos, f.item, n FROM (
  SELECT lower(item) AS key, count(*) AS n, min({{'season': season, 'episode': episode, 'chunk': chunk, 'pos': pos, 'item': item}}) AS f
  FROM items WHERE {_terms("item", CAUSAL)} GROUP BY key ORDER BY f LIMIT 20)""")
def a12(spark, d):
    return rollup.conflict_groups(rollup.items(chunks(spark, d)), CAUSAL)


@query("a13_target_candidates", f"""WITH {_CHUNKS}, named AS (SELECT *, trim(regexp_extract(item, '^[^:：(<（]*')) AS name FROM items),
best AS (SELECT name, count(*) AS n, min((season, episode, chunk, pos)) AS place, min(episode) AS episode FROM named WHERE name <> '' GROUP BY name)
SELECT name, n, episode FROM best ORDER BY place LIMIT 120""")
def a13(spark, d):
    return rollup.target_candidates(rollup.items(chunks(spark, d)))


@query("a14_review_reasons", """WITH r AS (SELECT d.doc_id, concat_ws(',', CASE WHEN text IS NULL OR trim(text) = '' THEN 'empty' END, CASE WHEN length(text) < 200 THEN 'short' END,
  CASE WHEN quality = 0 THEN 'low_quality' END, CASE WHEN toxic = 1 THEN 'toxic' END) AS reasons FROM documents d LEFT JOIN labels USING (doc_id))
SELECT doc_id, reasons, reasons <> '' AS needs_review FROM r""")
def a14(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    checks = [(F.col("text").isNull() | (F.trim("text") == ""), "empty"), (F.length("text") < 200, "short"), (F.col("quality") == 0, "low_quality"), (F.col("toxic") == 1, "toxic")]
    reasons = F.concat_ws(",", *[rollup.flag(c, code) for c, code in checks])
    return rows.select("doc_id", reasons.alias("reasons")).withColumn("needs_review", F.col("reasons") != "")


@query("a07_lineage", """SELECT l_orderkey, count(DISTINCT (l_shipmode, l_partkey)) AS n_distinct, count(*) AS n_refs, CASE WHEN count(DISTINCT l_shipmode) > 1 THEN 'mixed' ELSE min(l_shipmode) END AS source_kind
FROM (SELECT *, l_returnflag AS l_shipmode FROM lineitem) GROUP BY l_orderkey""")
def a07(spark, d):
    return rollup.lineage(table(spark, d, "lineitem"), "l_orderkey", "l_returnflag", "l_partkey")


@query("a09_usage_totals", """SELECT event_type, count(*) AS n, sum(coalesce(json_extract_string(props, '$.k')::BIGINT, 0))::BIGINT AS prompt_tokens, sum(ceil(value)::BIGINT)::BIGINT AS completion_tokens,
sum(coalesce(json_extract_string(props, '$.k')::BIGINT, 0) + ceil(value)::BIGINT)::BIGINT AS total_tokens FROM events GROUP BY event_type""")
def a09(spark, d):
    k, v = F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(0)), F.ceil("value").cast("long")
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("prompt_tokens"), F.sum(v).alias("completion_tokens"), F.sum(k + v).alias("total_tokens"))


@query("j07_missing_chunks", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45 AND l_orderkey IS NOT NULL)")
def j07(spark, d):
    found = table(spark, d, "lineitem").filter("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return joins.missing(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), found, "o_orderkey")


@query("j01_align_exactly_one", """WITH s AS (SELECT s_suppkey, s_suppkey % 997 AS stem, (s_suppkey * 7 + s_nationkey) % 1201 AS folder FROM supplier), c AS (SELECT c_custkey, c_custkey % 997 AS stem, (c_custkey * 7 + c_nationkey) % 1201 AS folder FROM customer),
hits AS (SELECT s_suppkey, c_custkey, 'stem' AS rule FROM s JOIN c USING (stem) UNION ALL SELECT s_suppkey, c_custkey, 'folder' FROM s JOIN c USING (folder)),
per AS (SELECT s_suppkey, min(c_custkey) AS lo, max(c_custkey) AS hi, rule FROM hits GROUP BY s_suppkey, rule QUALIFY row_number() OVER (PARTITION BY s_suppkey ORDER BY rule DESC) = 1)
SELECT s.s_suppkey, CASE WHEN lo = hi THEN lo END AS c_custkey, CASE WHEN lo IS NULL THEN 'unmatched' WHEN lo < hi THEN 'ambiguous' ELSE 'matched' END AS status, CASE WHEN lo = hi THEN rule END AS rule FROM s LEFT JOIN per USING (s_suppkey)""")
def j01(spark, d):
    keys = lambda key, nation: (F.col(key), (F.col(key) % 997).alias("stem"), ((F.col(key) * 7 + F.col(nation)) % 1201).alias("folder"))
    left, right = table(spark, d, "supplier").select(*keys("s_suppkey", "s_nationkey")), table(spark, d, "customer").select(*keys("c_custkey", "c_nationkey"))
    return joins.exactly_one(left, right, "s_suppkey", ["stem", "folder"], "c_custkey")


_SPANS = """e AS (SELECT user_id, event_id, event_type, epoch_us(ts) / 1000000.0 AS t, value FROM events)"""


@query("j04_interval_overlap", f"""WITH {_SPANS}, r AS (SELECT user_id, event_id AS range_id, t AS lo, t + 3600 AS hi FROM e WHERE event_type = 'error'), s AS (SELECT user_id, event_id AS span_id, t AS a, CASE WHEN event_id % 5 = 0 THEN 0 ELSE t + value * 60 END AS b FROM e WHERE event_type = 'purchase')
SELECT r.user_id, range_id, span_id FROM r JOIN s ON r.user_id = s.user_id AND (s.b = 0 OR s.b >= r.lo) AND s.a <= r.hi""")
def j04(spark, d):
    e = table(spark, d, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 1000000.0)
    ranges = e.filter("event_type = 'error'").select("user_id", F.col("event_id").alias("range_id"), F.col("t").alias("lo"), (F.col("t") + 3600).alias("hi"))
    spans = e.filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("span_id"), F.col("t").alias("start"), F.when(F.col("event_id") % 5 == 0, 0.0).otherwise(F.col("t") + F.col("value") * 60).alias("end"))
    return joins.overlapping(ranges, spans, "user_id", 3600).select("user_id", "range_id", "span_id")


@query("j09_previous_season", """WITH y AS (SELECT o_orderpriority AS kind, year(o_orderdate)::BIGINT AS season, count(*) AS n FROM orders GROUP BY ALL)
SELECT a.kind, a.season, a.n, b.n AS previous_n FROM y a LEFT JOIN y b ON a.kind = b.kind AND b.season = a.season - 1""")
def j09(spark, d):
    y = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("kind"), F.year("o_orderdate").cast("long").alias("season")).agg(F.count("*").alias("n"))
    return joins.predecessor(y, "kind", "season", "n")


@query("j11_last_completed", """SELECT event_id, user_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_done FROM events""")
def j11(spark, d):
    return joins.last_where(table(spark, d, "events"), "user_id", ("ts", "event_id"), F.col("event_type") == "purchase", "event_id", "last_done", F.to_date("ts")).select("event_id", "user_id", "last_done")


@query("j08_prior_episodes", f"""WITH {_CHUNKS}, n AS (SELECT season, episode, count(*) AS n_chunks FROM chunks GROUP BY ALL)
SELECT *, count(*) OVER w AS n_before, coalesce(sum(n_chunks) OVER w, 0)::BIGINT AS sum_before FROM n WINDOW w AS (PARTITION BY season ORDER BY episode ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def j08(spark, d):
    n = chunks(spark, d).groupBy("season", "episode").agg(F.count("*").alias("n_chunks"))
    return joins.earlier(n, "season", "episode", "n_chunks")


@query("j17_set_overlap", """WITH f AS (SELECT l_suppkey, l_partkey, bool_or(l_discount > 0.05) AS a, bool_or(l_discount <= 0.05) AS b FROM lineitem GROUP BY ALL)
SELECT l_suppkey, count(*) FILTER (a) AS n_left, count(*) FILTER (b) AS n_right, count(*) FILTER (a AND b) AS shared, round(count(*) FILTER (a AND b) / greatest(count(*) FILTER (a), count(*) FILTER (b), 1), 6) AS score
FROM f GROUP BY l_suppkey""")
def j17(spark, d):
    rows = table(spark, d, "lineitem")
    return rollup.overlap(rows.filter("l_discount > 0.05"), rows.filter("l_discount <= 0.05"), "l_suppkey", "l_partkey").withColumn("score", F.round("score", 6))


@query("w04_context_scores", """WITH o AS (SELECT o_custkey, o_orderkey, o_totalprice, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS distance FROM orders)
SELECT o_custkey, o_orderkey, distance, round(least(1.0, greatest(0.0, 0.25 * (1.0 / distance) + 0.30 * (CASE WHEN o_orderpriority = '1-URGENT' THEN 1.0 ELSE 0.0 END)
 + 0.10 * least(1.0, floor(o_totalprice / 20000) / 20.0) + CASE WHEN distance = 1 THEN 0.15 ELSE 0.0 END)), 6) AS relevance FROM o""")
def w04(spark, d):
    from pyspark.sql import Window

    o = table(spark, d, "orders").withColumn("distance", F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))).cast("long"))
    zero = F.lit(0)
    scores = {"recency": 1.0 / F.col("distance"), "characters": F.when(F.col("o_orderpriority") == "1-URGENT", 1.0).otherwise(0.0), "importance": context.importance(F.floor(F.col("o_totalprice") / 20000), zero, zero, zero)}
    return o.select("o_custkey", "o_orderkey", "distance", F.round(context.relevance(scores, F.col("distance") == 1), 6).alias("relevance"))


@query("w05_greedy_context", f"""WITH RECURSIVE {_CHUNKS},
e AS (SELECT season, episode, sum(length(text))::BIGINT AS cost FROM chunks GROUP BY ALL),
c AS (SELECT *, row_number() OVER (PARTITION BY season ORDER BY episode DESC) AS k FROM e),
fold(season, k, candidate, used, view) AS (
  SELECT season, 0::BIGINT, NULL::BIGINT, 0::BIGINT, NULL::INTEGER FROM c WHERE k = 1
  UNION ALL
  SELECT f.season, c.k, c.episode, f.used + CASE WHEN f.used + cost <= {BUDGET} THEN cost WHEN f.used + cost // 4 <= {BUDGET} THEN cost // 4 WHEN f.used + cost // 16 <= {BUDGET} THEN cost // 16 ELSE 0 END,
    CASE WHEN f.used + cost <= {BUDGET} THEN 0 WHEN f.used + cost // 4 <= {BUDGET} THEN 1 WHEN f.used + cost // 16 <= {BUDGET} THEN 2 END
  FROM fold f JOIN c ON c.season = f.season AND c.k = f.k + 1)
SELECT season, candidate, view, used FROM fold WHERE view IS NOT NULL""")
def w05(spark, d):
    e = chunks(spark, d).groupBy("season", F.col("episode").alias("candidate")).agg(F.sum(F.length("text")).alias("full"))
    e = e.withColumn("long", F.expr("full div 4")).withColumn("brief", F.expr("full div 16"))
    return context.greedy(e, "season", (-F.col("candidate"),), ("full", "long", "brief"), BUDGET)


@query("f01_clip", r"SELECT doc_id, CASE WHEN length(t) <= 120 THEN t ELSE substr(t, 1, 117) || '...' END AS clipped FROM (SELECT doc_id, trim(regexp_replace(text, '[\x20\x09-\x0D]+', ' ', 'g')) AS t FROM documents)")
def f01(spark, d):
    return table(spark, d, "documents").select("doc_id", T.clip(F.col("text"), 120).alias("clipped"))


_TOKENS = r"""(SELECT doc_id, (12 * (length(regexp_replace(text, '[^\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}]', '', 'g'))
 + coalesce(list_sum(list_transform(regexp_extract_all(text, '[^\x20\x09-\x0D\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}]+'), lambda x: (length(x) + 3) // 4)), 0)::BIGINT) + 9) // 10 AS tokens, text FROM documents)"""


@query("f02_token_estimate", f"SELECT doc_id, tokens::BIGINT AS tokens FROM {_TOKENS}")
def f02(spark, d):
    return table(spark, d, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


@query("f03_output_budget", f"SELECT doc_id, least(16384, greatest(2048, 4096 + 2 * 512 + tokens // 8))::BIGINT AS budget FROM {_TOKENS}")
def f03(spark, d):
    return table(spark, d, "documents").select("doc_id", T.output_budget("formal_episode_content_merge", F.lit(3), T.token_estimate(F.col("text")))["budget"].alias("budget"))


@query("f06_clock", "SELECT event_id, printf('%02d:%02d:%02d.%03d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000) AS clock FROM (SELECT event_id, round(greatest(value, 0) * 100 * 1000)::BIGINT AS ms FROM events)")
def f06(spark, d):
    return table(spark, d, "events").select("event_id", T.clock(F.col("value") * 100).alias("clock"))


@query("f07_stable_ids", "SELECT page_id, substr(sha1('text:' || url), 1, 12) AS material_id FROM pages")
def f07(spark, d):
    return table(spark, d, "pages").select("page_id", T.stable_id("text", F.col("url")).alias("material_id"))


@query("f08_fingerprints", "SELECT sha256(text) AS fingerprint, count(*) AS n, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def f08(spark, d):
    rows = table(spark, d, "documents").filter("text is not null").groupBy(F.sha2("text", 256).alias("fingerprint"))
    return rows.agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).filter("n > 1")


@query("f09_redact", r"""SELECT doc_id, sha256(regexp_replace(replace(regexp_replace(regexp_replace(regexp_replace(text, '([A-Za-z][A-Za-z0-9+.-]*://)([^/\s:@]+(?::[^/\s@]*)?@)', '\1***:***@', 'g'), '(Authorization:\s*Bearer\s+|Bearer\s+)([A-Za-z0-9._~+/=-]+)', '\1***', 'g'),
 '\bsk-[A-Za-z0-9_-]{8,}\b', 'sk-***', 'g'), 'ution', '***'), '(token\s*=\s*")[0-9a-fA-F]+(")', '\1***\2', 'g')) AS redacted FROM documents""")
def f09(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(T.mask_tokens(T.redact(F.col("text"), secrets=("ution", "e"))), 256).alias("redacted"))


@query("f10_mask_query", r"SELECT page_id, regexp_replace(url, '([?&](?:ref|page)=)[^&#]*', '\1***', 'g') AS url FROM pages")
def f10(spark, d):
    return table(spark, d, "pages").select("page_id", T.mask_query(F.col("url"), ("ref", "page")).alias("url"))


@query("f12_slug", "SELECT page_id, regexp_replace(regexp_replace(url, '[^0-9A-Za-z._-]+', '_', 'g'), '^[._-]+|[._-]+$', '', 'g') AS slug FROM pages")
def f12(spark, d):
    return table(spark, d, "pages").select("page_id", T.slug(F.col("url")).alias("slug"))


@query("w11_fixed_chunks", """WITH t AS (SELECT doc_id, text, length(text) AS n FROM documents),
c AS (SELECT doc_id, text, unnest(generate_series(0, CASE WHEN n <= 1200 THEN CASE WHEN n > 0 THEN 0 ELSE -1 END ELSE ((n - 100 + 1099) // 1100) - 1 END)) AS idx FROM t)
SELECT doc_id, idx, idx * 1100 AS start, sha256(substr(text, idx * 1100 + 1, 1200)) AS part FROM c WHERE trim(substr(text, idx * 1100 + 1, 1200)) <> ''""")
def w11(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.explode(T.fixed_chunks(F.col("text"), 1200, 100)).alias("c"))
    return rows.select("doc_id", F.col("c.idx").cast("long").alias("idx"), F.col("c.start").cast("long").alias("start"), F.sha2("c.part", 256).alias("part"))


@query("o01_natural_rank", "SELECT p_partkey, p_brand, rank() OVER (PARTITION BY p_type ORDER BY regexp_extract(p_brand, '[0-9]+')::BIGINT, p_partkey) AS rank FROM part")
def o01(spark, d):
    return files.numbered(table(spark, d, "part"), "p_type", [T.natural_key(F.col("p_brand")), F.col("p_partkey")], "rank").select("p_partkey", "p_brand", F.col("rank").cast("long").alias("rank"))


_SUFFIXES = (".txt", ".PNG", ".mp4", ".wav", ".bin", "", ".gif", ".bmp", ".srt", ".ASS", ".vtt", ".lrc", ".json", ".cbz", ".m4v", ".opus", ".webp", ".7z", ".wma", ".html")


@query("s01_suffix_profile", f"""WITH f AS (SELECT page_id, {list(_SUFFIXES)}[1 + page_id % 20] AS s FROM pages), t AS (SELECT *, lower(s) AS suffix FROM f)
SELECT page_id, suffix, CASE WHEN suffix IN ('.mp4', '.m4v') THEN 'video' WHEN suffix IN ('.png', '.gif', '.bmp', '.webp') THEN 'image' WHEN suffix IN ('.wav', '.opus', '.wma') THEN 'audio' WHEN suffix IN ('.txt', '.srt', '.ass', '.vtt', '.lrc', '.json') THEN 'text' END AS media_type,
 CASE WHEN suffix IN ('.srt', '.ass', '.vtt', '.lrc') THEN 'script' ELSE 'unknown' END AS content_form_hint, suffix NOT IN ('.bin', '.cbz', '.7z', '.html') AS import_supported,
 CASE WHEN suffix IN ('.mp4', '.m4v', '.png', '.webp', '.wav', '.opus', '.wma', '.srt', '.ass') THEN 'supported' WHEN suffix IN ('.txt', '.json') THEN 'planned' ELSE 'unsupported' END AS preview_support, preview_support AS formal_support,
 CASE suffix WHEN '' THEN 'extensionless_source_unclassified' WHEN '.gif' THEN 'animated_image_not_supported' WHEN '.bmp' THEN 'bmp_image_not_supported' WHEN '.vtt' THEN 'vtt_timed_text_not_supported' WHEN '.lrc' THEN 'lrc_timed_text_not_supported' WHEN '.json' THEN 'controlled_json_only'
  WHEN '.cbz' THEN 'comic_archive_not_supported' WHEN '.7z' THEN 'comic_archive_not_supported' WHEN '.bin' THEN 'unknown_source_suffix' WHEN '.html' THEN 'unknown_source_suffix' WHEN '.wav' THEN 'transcript_required' WHEN '.opus' THEN 'transcript_required' WHEN '.wma' THEN 'transcript_required' ELSE '' END AS reason,
 CASE suffix WHEN '.cbz' THEN 'cbz' WHEN '.7z' THEN 'archive' END AS preprocessor_key, import_supported OR suffix IN ('.cbz', '.7z') AS project_input FROM t""")
def s01(spark, d):
    path = F.concat(F.lit("a.d/b"), F.element_at(F.array(*map(F.lit, _SUFFIXES)), (F.col("page_id") % 20 + 1).cast("int")))
    rows = table(spark, d, "pages").select("page_id", path.alias("path"))
    return rows.select("page_id", media.suffix(F.col("path")).alias("suffix"), media.profile(F.col("path")).alias("p"), media.container(F.col("path"))["preprocessor_key"].alias("preprocessor_key"), media.project_input(F.col("path")).alias("project_input")).select("page_id", "suffix", "p.*", "preprocessor_key", "project_input")


@query("s04_collections", """WITH f AS (SELECT user_id * 400 + dayofyear(ts) AS folder, event_id || CASE event_type WHEN 'error' THEN '.mkv' WHEN 'click' THEN '.jpg' WHEN 'purchase' THEN '.srt' WHEN 'signup' THEN '.xyz' ELSE '.ass' END AS path, event_type AS t FROM events),
g AS (SELECT folder, count(*) AS n, bool_or(t = 'error') AS v, bool_or(t = 'click') AS i, bool_or(t NOT IN ('error', 'click', 'signup')) AS x, bool_or(t = 'signup') AS u, string_agg(path, ',' ORDER BY path) FILTER (t = 'signup') AS unsupported FROM f GROUP BY folder)
SELECT folder, n, concat_ws(',', CASE WHEN v THEN 'video' END, CASE WHEN i THEN 'image' END, CASE WHEN x THEN 'text' END) AS media,
 CASE WHEN v::INT + i::INT + x::INT > 1 THEN 'mixed' WHEN i AND n > 1 THEN 'image_set' WHEN x AND NOT u THEN 'script' ELSE 'unknown' END AS hint, coalesce(unsupported, '') AS unsupported FROM g""")
def s04(spark, d):
    ending = dispatch.first_case([(F.col("event_type") == "error", ".mkv"), (F.col("event_type") == "click", ".jpg"), (F.col("event_type") == "purchase", ".srt"), (F.col("event_type") == "signup", ".xyz")], ".ass")
    rows = table(spark, d, "events").select((F.col("user_id") * 400 + F.dayofyear("ts")).alias("folder"), F.concat(F.col("event_id").cast("string"), ending).alias("path"))
    return media.collections(rows, "folder", "path")


@query("p12_dispatch", """SELECT event_id, 'media' AS handler FROM events WHERE event_type IN ('click', 'purchase') UNION ALL SELECT event_id, 'text' FROM events WHERE value > 50
UNION ALL SELECT event_id, 'unsupported' FROM events WHERE event_type NOT IN ('click', 'purchase') AND value <= 50""")
def p12(spark, d):
    rules = [("media", F.col("event_type").isin("click", "purchase")), ("text", F.col("value") > 50)]
    return dispatch.routes(table(spark, d, "events"), rules).select("event_id", "handler")


@query("o04_preview", """WITH t AS (SELECT doc_id, CASE lang WHEN 'en' THEN 8 WHEN 'fr' THEN 12 ELSE 20 END AS cost, n_chars % 2 AS produced FROM documents ORDER BY cost, doc_id LIMIT 4),
b AS (SELECT *, row_number() OVER w AS attempt, coalesce(sum(produced) OVER (ORDER BY cost, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM t WINDOW w AS (ORDER BY cost, doc_id))
SELECT doc_id, cost, produced, attempt FROM b WHERE before < 2""")
def o04(spark, d):
    cost = F.when(F.col("lang") == "en", 8).when(F.col("lang") == "fr", 12).otherwise(20)
    rows = table(spark, d, "documents").select("doc_id", cost.alias("cost"), (F.col("n_chars") % 2).alias("produced"))
    return dispatch.top_with_attempts(rows, [F.col("cost"), F.col("doc_id")], 4, "produced", 2)


_SAID = ("I  CANNOT\nassist with", "我无法帮助", "i must\trefuse", "fine", "お手伝いできません")


@query("p15_refusals", "SELECT conv_id, turn, length(trim(regexp_replace(text, '[\\x20\\x09-\\x0D]+', ' ', 'g'))) + CASE turn % 5 WHEN 0 THEN 21 WHEN 1 THEN 6 WHEN 2 THEN 14 WHEN 3 THEN 5 ELSE 10 END <= 400 AND turn % 5 <> 3 AS refused FROM conversations WHERE text IS NOT NULL AND trim(text) <> ''")
def p15(spark, d):
    said = F.element_at(F.array(*map(F.lit, _SAID)), (F.col("turn") % 5 + 1).cast("int"))
    rows = table(spark, d, "conversations").filter("text is not null and trim(text) <> ''")
    return rows.select("conv_id", "turn", T.refuses(F.concat("text", F.lit(" \n"), said), most=400).alias("refused"))


_KINDS = (*responses.EXCEPTIONS, "model_call", "model_call", "model_call", "other")
_WHY = ("provider_policy_refusal", "nothing", None, "unsupported_capability")


@query("p17_failures", """WITH e AS (SELECT event_id, event_id % 11 AS k, event_id % 4 AS w, event_type FROM events),
c AS (SELECT event_id, CASE k WHEN 0 THEN 'model_text_refusal' WHEN 1 THEN 'output_truncated' WHEN 2 THEN 'json_parse_failure' WHEN 3 THEN 'user_override_regression' WHEN 4 THEN 'content_requires_manual_review' WHEN 5 THEN 'local_processing_failure' WHEN 6 THEN 'local_processing_failure' WHEN 10 THEN 'unknown_failure'
 ELSE CASE WHEN w = 0 THEN 'provider_policy_refusal' WHEN w = 3 THEN 'unsupported_capability' WHEN event_type = 'error' THEN 'provider_policy_refusal' ELSE 'transport_or_auth_failure' END END AS category,
 CASE k WHEN 0 THEN 'model_text_marker' WHEN 1 THEN 'output_limit_finish_reason' WHEN 2 THEN 'formal_json_parse_error' WHEN 3 THEN 'explicit_override_error' WHEN 4 THEN 'explicit_manual_review' WHEN 5 THEN 'audio_transcription_error' WHEN 6 THEN 'local_processing_error' WHEN 10 THEN 'unclassified_exception'
 ELSE CASE WHEN w IN (0, 3) THEN 'middleware_category' WHEN event_type = 'error' THEN 'legacy_policy_marker' ELSE 'model_call_error' END END AS reason_code FROM e)
SELECT *, category IN ('provider_policy_refusal', 'model_text_refusal') AS prompt_tuning_candidate, category IN ('provider_policy_refusal', 'model_text_refusal', 'content_requires_manual_review') AS requires_manual_review FROM c""")
def p17(spark, d):
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (F.col("event_id") % n + 1).cast("int"))
    says = F.when(F.col("event_type") == "error", "HTTP 400: Inappropriate CONTENT").otherwise("HTTP 401")
    return table(spark, d, "events").select("event_id", responses.failure(pick(_KINDS, 11), pick(_WHY, 4), says).alias("f")).select("event_id", "f.*")


@query("p16_provider_failures", """WITH e AS (SELECT event_id, event_id % 6 AS k, event_id % 3 AS s FROM events)
SELECT event_id, CASE k WHEN 0 THEN 'content_filter' WHEN 1 THEN 'bad' ELSE '' END AS code, CASE k WHEN 0 THEN 'stopped' WHEN 1 THEN 'It does NOT support audio' WHEN 2 THEN 'top' WHEN 3 THEN 'no json: moderation' WHEN 4 THEN '' ELSE '[1]' END AS message,
 CASE WHEN k IN (0, 3) THEN 'provider_policy_refusal' WHEN k = 1 THEN 'unsupported_capability' WHEN s > 0 THEN 'transport_or_auth_failure' ELSE '' END AS category FROM e""")
def p16(spark, d):
    bodies = ('{"error": {"code": "", "type": "content_filter", "message": "stopped"}}', '{"error": {"code": "bad"}, "message": "It does NOT support audio"}', '{"error": "x", "message": " top "}', "no json: moderation", "", "[1]")
    body = F.element_at(F.array(*map(F.lit, bodies)), (F.col("event_id") % 6 + 1).cast("int"))
    rows = table(spark, d, "events").select("event_id", responses.error_details(body).alias("e"), F.when(F.col("event_id") % 3 > 0, 400).alias("status"))
    return rows.select("event_id", "e.*", responses.provider_failure(F.col("status"), F.col("e.code"), F.col("e.message")).alias("category"))


@query("p18_gallery", "SELECT c_custkey, c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE contains(lower(concat_ws(' ', c_name, n_name, c_mktsegment)), '1') AND c_mktsegment <> 'BUILDING'")
def p18(spark, d):
    rows = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    text = F.concat_ws(" ", "c_name", "n_name", "c_mktsegment")
    return rows.filter(F.contains(F.lower(text), F.lit("1")) & (F.col("c_mktsegment") != "BUILDING")).select("c_custkey", "c_name", "n_name")


@query("r01_stream_upsert", "SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def r01(spark, d):
    return streams.latest(table(spark, d, "events"), "user_id", ("ts", "event_id")).select("user_id", "event_id", "event_type", "value")


@query("w14_progress", """WITH u AS (SELECT user_id, ts, event_id, floor(value)::INTEGER AS value, CASE WHEN event_type = 'purchase' AND event_id % 7 = 0 THEN 'success' END AS terminal FROM events),
x AS (SELECT *, coalesce(bool_or(terminal IS NOT NULL) OVER (p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS ended,
 CASE WHEN terminal = 'success' THEN 100 ELSE least(99, max(greatest(0, value)) OVER (p ROWS UNBOUNDED PRECEDING)) END AS shown FROM u WINDOW p AS (PARTITION BY user_id ORDER BY ts, event_id)),
y AS (SELECT *, lag(shown) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS last FROM x WHERE NOT ended)
SELECT user_id, event_id, shown FROM y WHERE last IS NULL OR shown > last""")
def w14(spark, d):
    ends = F.when((F.col("event_type") == "purchase") & (F.col("event_id") % 7 == 0), "success")
    rows = table(spark, d, "events").select("user_id", "ts", "event_id", F.floor("value").cast("int").alias("value"), ends.alias("terminal"))
    return streams.progress(rows, "user_id", ("ts", "event_id"), "value", "terminal", F.to_date("ts")).select("user_id", "event_id", "shown")


@query("r07_stale", """WITH m AS (SELECT user_id, max(ts) AS t FROM events WHERE event_type = 'error' GROUP BY user_id)
SELECT c_custkey, CASE WHEN t > TIMESTAMP '2024-01-20' THEN 'STALE' ELSE 'COMPILED' END AS status, CASE WHEN t > TIMESTAMP '2024-01-20' THEN 'newer evidence' END AS reason FROM customer LEFT JOIN m ON c_custkey = user_id""")
def r07(spark, d):
    cards = table(spark, d, "customer").select("c_custkey", F.lit("COMPILED").alias("status"), F.lit("2024-01-20").cast("timestamp_ntz").alias("compiled_at"))
    changes = table(spark, d, "events").filter("event_type = 'error'").select(F.col("user_id").alias("c_custkey"), F.col("ts").cast("timestamp_ntz").alias("changed_at"))
    return dispatch.stale(cards, changes, "c_custkey").drop("compiled_at")


@query("r06_cache_miss", "SELECT item_id FROM benchmark WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE text IS NOT NULL)")
def r06(spark, d):
    known = table(spark, d, "documents").select(F.sha2("text", 256).alias("key"))
    return joins.missing(table(spark, d, "benchmark").select("item_id", F.sha2("text", 256).alias("key")), known, "key").select("item_id")


@query("x01_daily_windows", "SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def x01(spark, d):
    return streams.windowed_counts(table(spark, d, "events")).withColumn("total", F.round("total", 2)).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("o08_newest_first", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50")
def o08(spark, d):
    return table(spark, d, "orders").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(50).select("o_orderkey", "o_orderdate")
