"""Queries of text, value and response functions, of subtitles and of units, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import responses as R
from tessera.functions import text as T
from tessera.operators import units as U
from tessera.plans.registry import query
from tessera.sources import subtitles


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: tuple, by: str) -> F.Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.col(by) % len(values) + 1).cast("int"))


@query("f03_budgets", """WITH e AS (SELECT event_id, event_id % 40 AS items, floor(value * 300)::BIGINT AS tokens, CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 0 WHEN 2 THEN 9000 ELSE 3000 END AS win FROM events),
w AS (SELECT *, least(greatest(2048 + greatest(items - 1, 0) * 128 + tokens // 16, 1024), 8192) AS wanted, win - 500 - 1024 AS room FROM e)
SELECT event_id, CASE WHEN win IS NULL OR win <= 0 THEN wanted WHEN room < 1024 THEN 1024 ELSE least(wanted, room) END::BIGINT AS budget,
 CASE WHEN win > 0 AND room < 1024 THEN 'text_merge_output_budget_below_minimum:purpose=formal_episode_summary,requested=' || wanted || ',available=' || room || ',minimum=1024' ELSE '' END AS warning FROM w""")
def f03(spark, d):
    window = F.when(F.col("event_id") % 4 == 0, None).when(F.col("event_id") % 4 == 1, 0).when(F.col("event_id") % 4 == 2, 9000).otherwise(2500).cast("long")
    window = F.when(F.col("event_id") % 4 == 3, 3000).otherwise(window)
    b = T.output_budget("formal_episode_summary", F.col("event_id") % 40, F.floor(F.col("value") * 300), window, F.lit(500))
    return table(spark, d, "events").select("event_id", b.alias("b")).select("event_id", "b.*")


@query("f04_video_tokens", """WITH e AS (SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 'x' ELSE (event_id * 7 % 10000 - 50)::VARCHAR END AS per, CASE WHEN event_id % 8 = 0 THEN NULL ELSE value - 5 END AS sec FROM events),
t AS (SELECT *, coalesce(CASE WHEN try_cast(per AS BIGINT) > 0 THEN least(8192, greatest(128, round_even(try_cast(per AS BIGINT) / 128, 0) * 128)) END, 2048)::BIGINT AS tokens FROM e)
SELECT event_id, tokens, greatest(1, floor(tokens * CASE WHEN sec > 0 THEN sec ELSE 60 END / 60 + 0.5))::BIGINT AS output, least(8192, greatest(128, ceil(greatest(event_id % 5000, 1024) * 60.0 / CASE WHEN sec > 0 THEN sec ELSE 60 END / 128) * 128))::BIGINT AS recommended FROM t""")
def f04(spark, d):
    per = F.when(F.col("event_id") % 9 == 0, "x").otherwise((F.col("event_id") * 7 % 10000 - 50).cast("string"))
    sec = F.when(F.col("event_id") % 8 == 0, None).otherwise(F.col("value") - 5)
    return table(spark, d, "events").select("event_id", T.tokens_per_minute(per).alias("tokens"), T.video_tokens(per, sec).alias("output"), T.recommended_per_minute(sec, F.col("event_id") % 5000, 1024).alias("recommended"))


@query("f05_clocks", """WITH e AS (SELECT event_id, event_id % 200 AS h, event_id % 60 AS m, event_id * 7 % 60 AS s, event_id % 1000 AS f FROM events)
SELECT event_id, CASE WHEN event_id % 10 = 0 THEN NULL ELSE h * 3600 + m * 60 + s + f / 1000.0 END::DOUBLE AS srt, CASE WHEN event_id % 10 = 0 THEN NULL ELSE h * 3600 + m * 60 + s + f / 100.0 END::DOUBLE AS ass,
 CASE WHEN event_id % 10 = 0 THEN 0 ELSE h * 3600 + m * 60 + s END::DOUBLE AS whole, (m * 60 + s)::DOUBLE AS minutes, printf('%02d:%02d', (h * 3600 + m * 60 + s) // 60, s) AS short, printf('%02d:%02d:%02d', h, m, s) AS long,
 rtrim(rtrim(printf('%.3f', f / 8), '0'), '.') AS number FROM e""")
def f05(spark, d):
    i = F.col("event_id")
    parts = (i % 200, i % 60, i * 7 % 60)
    clock = F.when(i % 10 == 0, "1:2").otherwise(F.format_string("%d:%02d:%02d,%d", *parts, i % 1000))
    plain, seconds = F.when(i % 10 == 0, "a:b:c").otherwise(F.format_string("%d:%d:%d", *parts)), parts[0] * 3600 + parts[1] * 60 + parts[2]
    return table(spark, d, "events").select("event_id", T.clock_seconds(clock, 1000).alias("srt"), T.clock_seconds(clock, 100).alias("ass"), T.seconds_of(plain, 3).alias("whole"), T.seconds_of(F.format_string("%d:%d", parts[1], parts[2]), 2).alias("minutes"), T.clock_minutes(seconds + 0.9).alias("short"), T.clock_whole(seconds + 0.9).alias("long"), T.short_number(i % 1000 / 8).alias("number"))


@query("f10_sanitize_url", r"""WITH p AS (SELECT page_id, split_part(url, '#', 1) AS u, CASE WHEN contains(url, '#') THEN '#' || split_part(url, '#', 2) ELSE '' END AS frag FROM pages),
q AS (SELECT page_id, regexp_replace(split_part(u, '?', 1), '^(https?)://', '\1://***:***@') AS base, split_part(u, '?', 2) AS query, frag FROM p)
SELECT page_id, base || '?' || concat_ws('&', nullif(query, ''), 'api-KEY=***', 'x_token=***', 'q=a+b%2F~') || frag AS url FROM q""")
def f10(spark, d):
    with_user = F.regexp_replace("url", "^(https?)://", "$1://me:pw@")
    cut = F.split(with_user, "#")
    joint = F.when(F.contains(F.get(cut, F.lit(0)), F.lit("?")), "&").otherwise("?")
    full = F.concat(F.get(cut, F.lit(0)), joint, F.lit("api-KEY=1&&x_token=%31&q=a%20b/~"), F.coalesce(F.concat(F.lit("#"), F.get(cut, F.lit(1))), F.lit("")))
    return table(spark, d, "pages").select("page_id", T.sanitize_url(full).alias("url"))


@query("f11_metadata", r"""SELECT event_id, '<redacted>' AS password, substr('key sk-*** of ' || event_type || repeat(' and more', 50), 1, 297) || '...' AS note, 4 AS n FROM events""")
def f11(spark, d):
    note = F.concat(F.lit("key\tsk-abcdefgh12345 of  "), "event_type", F.lit(" and more" * 50))
    values = F.create_map(F.lit(" Db_Password "), F.lit("x"), F.lit("note"), note, F.lit(" "), F.lit("gone"), F.lit("none"), F.lit(None).cast("string"), F.lit("my_Token"), F.lit("y"))
    rows = table(spark, d, "events").select("event_id", T.safe_metadata(values).alias("m"))
    return rows.select("event_id", F.col("m")["Db_Password"].alias("password"), F.col("m")["note"].alias("note"), F.size("m").alias("n"))


@query("f12_names", """SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'materials/s/p' || page_id || '.txt' ELSE 's/p' || page_id || '.txt' END AS archive, 's/p' || page_id || '.txt' AS label,
 CASE WHEN page_id % 2 = 0 THEN 'materials/s/p' || page_id || '.txt' ELSE '<outside_project>/p' || page_id || '.txt' END AS shown, printf('20240131T%02d3000Z', page_id % 24) AS at, CASE WHEN page_id % 2 = 0 THEN 's/p' || page_id || '.txt' ELSE '/s/p' || page_id || '.txt' END AS relative FROM pages""")
def f12(spark, d):
    even, name = F.col("page_id") % 2 == 0, F.concat(F.lit("p"), F.col("page_id").cast("string"), F.lit(".txt"))
    odd = F.concat(F.lit("/./s//../"), name)
    archive = F.when(even, F.concat(F.lit("materials\\s\\"), name)).otherwise(odd)
    shown = F.when(even, F.concat(F.lit("materials\\s\\"), name)).otherwise(F.concat(F.lit("/s/"), name))
    moment = F.format_string("2024-01-31T%02d:30:00Z", F.col("page_id") % 24)
    return table(spark, d, "pages").select("page_id", T.archive_name(archive).alias("archive"), T.material_label(F.when(even, F.concat(F.lit("/materials/s/"), name)).otherwise(F.concat(F.lit("raw\\s\\"), name))).alias("label"), T.display_path(shown).alias("shown"), T.compact_time(moment).alias("at"), T.relative_path(shown, "materials/").alias("relative"))


@query("f14_json_repair", """SELECT event_id, CASE event_id % 5 WHEN 0 THEN '{"a": ' || event_id || ', "profile": {"b": 2}}' WHEN 1 THEN '{"a": [1, 2]}' WHEN 2 THEN '{"profile": 1}' WHEN 3 THEN '{"x": 1}' END AS payload,
 CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'code_block,trailing_comma' WHEN 2 THEN 'embedded_json' WHEN 3 THEN '' END AS repairs, CASE event_id % 5 WHEN 0 THEN '{"a": ' || event_id || ', "profile": {"b": 2}}' WHEN 2 THEN '{"y": 2}' WHEN 3 THEN '{"x": 1}' END AS last FROM events""")
def f14(spark, d):
    i = F.col("event_id").cast("string")
    texts = F.array(F.concat(F.lit(' {"profile": {"b": 2}, "a": '), i, F.lit("}")), F.lit('Sure:\n```json\n{"a": [1, 2,],}\n``` {'), F.lit('Here {"profile": 1} or {"y": 2}'), F.lit('json\n{"x": 1}'), F.lit("no object {here"))
    rows = table(spark, d, "events").select("event_id", F.element_at(texts, (F.col("event_id") % 5 + 1).cast("int")).alias("t"))
    found = rows.select("event_id", R.repaired_object(F.col("t"), ("profile",)).alias("r"), R.found_object(F.col("t")).alias("last"))
    return found.select("event_id", "r.payload", F.array_join("r.repairs", ",").alias("repairs"), "last")


@query("f15_responses", """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'plain' WHEN 1 THEN 'a' || chr(10) || 'b' END AS content, CASE event_id % 4 WHEN 2 THEN 'model_text_refusal' WHEN 3 THEN 'json_parse_failure' ELSE '' END AS failure, CASE event_id % 4 WHEN 0 THEN 'length' WHEN 3 THEN 'stop' ELSE '' END AS finish,
 CASE event_id % 4 WHEN 0 THEN event_id WHEN 1 THEN 7 END AS prompt_tokens, CASE event_id % 4 WHEN 0 THEN 5 END AS completion_tokens, CASE event_id % 4 WHEN 0 THEN event_id + 5 WHEN 1 THEN 9 END AS total_tokens, CASE event_id % 4 WHEN 2 THEN 'xy' ELSE '' END AS added FROM events""")
def f15(spark, d):
    i = F.col("event_id").cast("string")
    raw = F.array(
        F.concat(F.lit('{"choices": [{"finish_reason": " Length ", "message": {"content": "plain"}}], "usage": {"input_tokens": '), i, F.lit(', "output_tokens": 5}}')),
        F.lit('{"choices": [{"message": {"content": [{"type": "text", "text": "a"}, {"type": "image"}, {"text": "b"}]}}], "usage": {"prompt_tokens": 7, "total_tokens": 9}}'),
        F.lit('{"choices": [{"message": {"refusal": "no", "content": "x"}, "delta": {"content": [{"text": "x"}, {"text": "y"}]}}]}'),
        F.lit('{"output": {"choices": [{"finish_reason": "stop"}]}}'),
    )
    rows = table(spark, d, "events").select("event_id", F.element_at(raw, (F.col("event_id") % 4 + 1).cast("int")).alias("raw"))
    r = F.col("raw")
    return rows.select("event_id", R.message(r).alias("m"), R.finish_reason(r).alias("finish"), R.usage(r).alias("u"), R.delta(r).alias("added")).select("event_id", "m.*", "finish", "u.*", "added")


@query("f16_templates", "SELECT p_partkey, 'Part ' || p_name || ' {of} {' || p_brand || '} {missing}' AS line FROM part")
def f16(spark, d):
    return table(spark, d, "part").select("p_partkey", T.rendered(F.lit("Part {name} {{of}} {{{brand}}} {missing}"), F.create_map(F.lit("name"), "p_name", F.lit("brand"), "p_brand")).alias("line"))


@query("f17_lists", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'a|b' WHEN 1 THEN event_type WHEN 2 THEN '' ELSE '' END AS list, event_type || '|x' AS folded, event_type || '|' || substr(event_type, 1, 2) AS capped FROM events WHERE length(event_type) <= 6")
def f17(spark, d):
    t = F.col("event_type")
    value = F.when(F.col("event_id") % 4 == 0, '[" a ", "", "b"]').when(F.col("event_id") % 4 == 1, F.concat(F.lit('" '), t, F.lit(' "'))).when(F.col("event_id") % 4 == 2, "3").otherwise("not json")
    items = F.array(t, F.concat(F.lit(" "), F.upper(t)), F.lit("x"), F.lit(" "), F.lit("X"))
    rows = table(spark, d, "events").filter(F.length("event_type") <= 6)
    capped = T.capped(F.array(t, F.concat(t, F.lit(" ")), F.substring(t, 1, 2), F.lit("more")), 2, 10)
    return rows.select("event_id", F.array_join(T.string_list(value), "|").alias("list"), F.array_join(T.folded_distinct(items), "|").alias("folded"), F.array_join(capped, "|").alias("capped"))


@query("f20_merged", "SELECT p_partkey, 'new ' || p_name AS name, p_brand AS brand, p_type AS type FROM part")
def f20(spark, d):
    old = F.create_map(F.lit("name"), "p_name", F.lit("brand"), "p_brand")
    new = F.create_map(F.lit("name"), F.concat(F.lit("new "), "p_name"), F.lit("type"), "p_type")
    rows = table(spark, d, "part").select("p_partkey", T.merged(old, new).alias("m"))
    return rows.select("p_partkey", *[F.col("m")[k].alias(k) for k in ("name", "brand", "type")])


_MARK = " ".join(f"WHEN contains(w, {m}) THEN low + length(w) - instr(reverse(w), reverse({m})) - length({m}) + 1 + length({m})" for m in ("chr(10) || chr(10)", "chr(10)", "'。'", "'！'", "'？'", "'. '", "'! '", "'? '", "' '"))


@query("w11_chunks", f"""WITH RECURSIVE t AS (SELECT doc_id, text, length(text)::BIGINT AS n FROM documents WHERE text <> ''),
c(doc_id, text, n, start, stop) AS (
 SELECT doc_id, text, n, 0::BIGINT, CASE WHEN n <= 600 THEN n ELSE CASE {_MARK} ELSE 600 END END FROM (SELECT *, substr(text, 361, 240) AS w, 360 AS low FROM t)
 UNION ALL SELECT doc_id, text, n, pl, CASE WHEN pl + 600 >= n THEN n ELSE CASE {_MARK} ELSE pl + 600 END END FROM (SELECT doc_id, text, n, greatest(start + 1, stop - 50) AS pl, greatest(start + 1, stop - 50) + 360 AS low, substr(text, greatest(start + 1, stop - 50) + 361, 240) AS w FROM c WHERE stop < n)),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start) AS idx FROM c WHERE regexp_matches(substr(text, start + 1, stop - start), '[^\\x20\\x09-\\x0D]'))
SELECT doc_id, idx, start, stop, sha256(substr(text, start + 1, stop - start)) AS part FROM k WHERE idx <= 20""")
def w11(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.explode(T.chunks(F.col("text"), 600, 50, 20)["parts"]).alias("c"))
    return rows.select("doc_id", F.col("c.idx").cast("long").alias("idx"), F.col("c.start").cast("long").alias("start"), F.col("c.stop").cast("long").alias("stop"), F.sha2("c.part", 256).alias("part"))


def _subtitles(spark, d) -> DataFrame:
    """Conversations as SRT (even) and ASS (odd) files, a cue for each turn; the text of every fifth turn is empty."""
    rows = table(spark, d, "conversations").filter("text is not null")
    t = F.col("turn")
    said = F.when(t % 5 == 4, "").otherwise(F.trim(F.substring(F.regexp_replace("text", "[^A-Za-z ]+", ""), 1, 30)))
    clock = lambda s, dot, n: F.concat(F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60), F.lit(dot), F.format_string(f"%0{n}d", t % 10))
    srt = F.concat((t + 1).cast("string"), F.lit("\r\n"), clock(t * 10, ",", 3), F.lit(" --> "), clock(t * 10 + 7, ",", 3), F.lit("\r\n<i>"), said, F.lit("</i>\r\n\r\n"))
    ass = F.concat(F.lit("Dialogue: 0,"), clock(t * 10, ".", 2), F.lit(","), clock(t * 10 + 7, ".", 2), F.lit(",Role,{\\b1}"), said, F.lit("\n"))
    even = F.col("conv_id") % 2 == 0
    files = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.when(even, srt).otherwise(ass).alias("line")))).alias("lines"))
    body = F.array_join(F.transform("lines", lambda x: x["line"]), "")
    path = F.concat(F.col("conv_id").cast("string"), F.when(even, ".srt").otherwise(".ASS"))
    return files.select(path.alias("path"), F.when(even, body).otherwise(F.concat(F.lit("[Script Info]\nDialogue: skip\n[Events]\nFormat: Layer, Start, End, Name, Text\n"), body)).alias("text"))


_CUES = """s AS (SELECT conv_id, turn, CASE WHEN turn % 5 = 4 THEN '' ELSE trim(substr(regexp_replace(text, '[^A-Za-z ]+', '', 'g'), 1, 30)) END AS said, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations WHERE text IS NOT NULL),
q AS (SELECT conv_id || CASE WHEN conv_id % 2 = 0 THEN '.srt' ELSE '.ASS' END AS path, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS cue, CASE WHEN conv_id % 2 = 0 THEN r * 4 - 2 ELSE r + 4 END AS source_line,
 CASE WHEN conv_id % 2 = 0 THEN turn * 10 + (turn % 10) / 1000 ELSE turn * 10 + (turn % 10) / 100 END AS start, said AS text, CASE WHEN conv_id % 2 = 0 THEN '' ELSE 'Role' END AS speaker FROM s WHERE said <> ''),
r AS (SELECT *, start + 7 AS stop, '[cue=' || cue || ' line=' || source_line || ' time=' || printf('%02d:%02d:%02d.%03d', round(start * 1000)::BIGINT // 3600000, round(start * 1000)::BIGINT // 60000 % 60, round(start * 1000)::BIGINT // 1000 % 60, round(start * 1000)::BIGINT % 1000)
 || '-' || printf('%02d:%02d:%02d.%03d', round((start + 7) * 1000)::BIGINT // 3600000, round((start + 7) * 1000)::BIGINT // 60000 % 60, round((start + 7) * 1000)::BIGINT // 1000 % 60, round((start + 7) * 1000)::BIGINT % 1000) || ' speaker=' || CASE WHEN speaker = '' THEN 'unknown' ELSE speaker END || ']' || chr(10) || text AS rendered FROM q),
o AS (SELECT *, coalesce(sum(length(rendered) + 1) OVER (PARTITION BY path ORDER BY cue ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_offset FROM r)"""


@query("s32_subtitle_cues", f"WITH {_CUES} SELECT path, cue, source_line, round(start, 6) AS start, round(stop, 6) AS stop, text, speaker, rendered, start_offset, start_offset + length(rendered) AS end_offset FROM o")
def s32(spark, d):
    rows = subtitles.document(subtitles.cues(_subtitles(spark, d)))
    return rows.select("path", F.col("cue").cast("long").alias("cue"), F.col("source_line").cast("long").alias("source_line"), F.round("start", 6).alias("start"), F.round("end", 6).alias("stop"), "text", "speaker", "rendered", F.col("start_offset").cast("long").alias("start_offset"), F.col("end_offset").cast("long").alias("end_offset"))


@query("s33_subtitle_warnings", """WITH s AS (SELECT conv_id, turn, trim(substr(regexp_replace(text, '[^A-Za-z ]+', '', 'g'), 1, 30)) AS said, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations WHERE text IS NOT NULL),
w AS (SELECT conv_id, r, turn % 5 = 4 OR said = '' AS gone FROM s), p AS (SELECT *, conv_id || CASE WHEN conv_id % 2 = 0 THEN '.srt' ELSE '.ASS' END AS path FROM w)
SELECT path, CASE WHEN conv_id % 2 = 0 THEN 'srt_empty_cue_skipped:line=' || (r * 4 - 2) ELSE 'ass_empty_dialogue_skipped:line=' || (r + 4) END AS warning FROM p WHERE gone
UNION ALL SELECT path, CASE WHEN conv_id % 2 = 0 THEN 'srt_no_usable_segments' ELSE 'ass_no_usable_segments' END FROM p GROUP BY path, conv_id HAVING bool_and(gone)""")
def s33(spark, d):
    return subtitles.cues(_subtitles(spark, d)).filter("warning is not null").select("path", "warning")


@query("w12_cue_chunks", f"""WITH RECURSIVE {_CUES}, e AS (SELECT *, start_offset + length(rendered) AS end_offset FROM o),
g(path, cue, chunk, pl) AS (SELECT path, cue, 1, start_offset FROM e WHERE cue = 1
 UNION ALL SELECT e.path, e.cue, CASE WHEN e.end_offset - g.pl > 300 THEN g.chunk + 1 ELSE g.chunk END, CASE WHEN e.end_offset - g.pl > 300 THEN e.start_offset ELSE g.pl END FROM g JOIN e ON e.path = g.path AND e.cue = g.cue + 1)
SELECT path, chunk, round(arg_min(start, cue), 6) AS start, round(max(stop), 6) AS stop, min(start_offset) AS start_offset, max(end_offset) AS end_offset, count(*) AS cues, 'lines=' || min(source_line) || '-' || max(source_line) || ';time=' || printf('%.3f', arg_min(start, cue)) || '-' || printf('%.3f', max(stop)) AS locator
FROM g JOIN e USING (path, cue) WHERE chunk <= 3 GROUP BY path, chunk""")
def w12(spark, d):
    rows = subtitles.packed(subtitles.document(subtitles.cues(_subtitles(spark, d))), 300, 3)
    return subtitles.chunk_places(rows).select("path", "chunk", F.round("start", 6).alias("start"), F.round("end", 6).alias("stop"), F.col("start_offset").cast("long").alias("start_offset"), F.col("end_offset").cast("long").alias("end_offset"), "cues", "locator")


def _units(spark, d) -> DataFrame:
    """Events as extraction units."""
    i = F.col("event_id")
    path = F.concat(F.lit("m/U"), i.cast("string"), _pick((".mp4", ".srt", ".PNG", ".wav", ".vtt", ".gif", ".txt"), "event_id"))
    return table(spark, d, "events").select(
        F.format_string("s%02d", F.col("user_id") % 5).alias("season_id"), F.format_string("e%04d", F.col("user_id")).alias("episode_id"), F.format_string("u%07d", i).alias("unit_id"), i.alias("pos"), path.alias("path"),
        _pick(("video", "text", "image", "audio", "text", "image", "text"), "event_id").alias("media_type"),
        _pick(("video_chunk", "subtitle_text", "image_page", "audio_source", "subtitle_text", "image_source", "document_text"), "event_id").alias("unit_kind"),
        F.when(i % 7 == 6, F.when(i % 21 == 6, "script")).alias("content_form"), (F.col("event_type") == "click").alias("transcript_candidate"), F.when(i % 7 == 4, " vtt_timed_text_not_supported ").otherwise("").alias("support_reason"),
    )


_UNITS = """u AS (SELECT printf('u%07d', event_id) AS unit_id, event_id % 7 AS k, event_type = 'click' AS cand, event_id, printf('s%02d', user_id % 5) AS season_id, printf('e%04d', user_id) AS episode_id FROM events)"""


@query("p12_formal_dispatch", f"""WITH {_UNITS} SELECT unit_id, 'video' AS handler, NULL AS reason FROM u WHERE k = 0 UNION ALL SELECT unit_id, NULL, 'native_off' FROM u WHERE k IN (0, 3) UNION ALL SELECT unit_id, 'text', NULL FROM u WHERE k IN (1, 6)
UNION ALL SELECT unit_id, 'image', NULL FROM u WHERE k = 2 UNION ALL SELECT unit_id, 'audio_transcript', NULL FROM u WHERE k = 3 AND cand UNION ALL SELECT unit_id, NULL, CASE k WHEN 4 THEN 'vtt_timed_text_not_supported' ELSE 'formal_handler_not_available' END FROM u WHERE k IN (4, 5)""")
def p12(spark, d):
    return U.dispatch(_units(spark, d), True, F.lit("native_off")).select("unit_id", "handler", "reason")


@query("p13_preview", f"""WITH {_UNITS}, p AS (SELECT *, CASE WHEN k = 0 THEN 'video' WHEN k = 1 THEN 'timed_text' WHEN k = 3 AND cand THEN 'audio_transcript' WHEN k = 6 AND event_id % 21 = 6 THEN 'timed_text' WHEN k = 6 THEN 'text' END AS kind FROM u)
SELECT unit_id, kind, CASE kind WHEN 'timed_text' THEN 8 WHEN 'text' THEN 12 WHEN 'audio_transcript' THEN 30 WHEN 'video' THEN 40 END AS cost, CASE WHEN kind IS NULL THEN CASE k WHEN 2 THEN 'model_image_input_not_supported' WHEN 4 THEN 'vtt_timed_text_not_supported' ELSE 'preview_handler_not_available' END END AS reason FROM p""")
def p13(spark, d):
    return U.preview(_units(spark, d), False).select("unit_id", "kind", "cost", "reason")


@query("o03_preview_order", f"""WITH {_UNITS} SELECT unit_id, row_number() OVER (ORDER BY CASE WHEN k = 1 OR k = 6 AND event_id % 21 = 6 THEN 8 WHEN k = 6 THEN 12 WHEN k = 2 THEN 20 WHEN k = 3 THEN 30 ELSE 40 END, season_id, episode_id, lower('m/U' || event_id || CASE k WHEN 1 THEN '.srt' WHEN 6 THEN '.txt' WHEN 2 THEN '.PNG' WHEN 3 THEN '.wav' ELSE '.mp4' END), unit_id) AS place
FROM u WHERE k IN (0, 1, 2, 6) OR k = 3 AND cand ORDER BY place LIMIT 100""")
def o03(spark, d):
    from pyspark.sql import Window

    rows = U.preview(_units(spark, d), True).filter("kind is not null").orderBy(*U.preview_order()).limit(100)
    return rows.select("unit_id", F.row_number().over(Window.orderBy(*U.preview_order())).cast("long").alias("place"))


@query("a25_run_keys", f"""WITH {_UNITS}, e AS (SELECT season_id, episode_id, min(event_id) AS first, count(*) AS units FROM u GROUP BY ALL), s AS (SELECT season_id, row_number() OVER (ORDER BY min(first)) AS season_no FROM e GROUP BY season_id)
SELECT season_id, episode_id, first, units, season_no FROM e JOIN s USING (season_id)""")
def a25(spark, d):
    return U.run_keys(_units(spark, d), "pos").withColumnRenamed("at", "first").withColumn("season_no", F.col("season_no").cast("long"))


@query("a21_first_seen", "SELECT event_type, min(event_id) AS event_id FROM events GROUP BY event_type")
def a21(spark, d):
    return U.first_seen(table(spark, d, "events"), "event_type", "event_id")


@query("w09_part_offsets", """WITH p AS (SELECT DISTINCT user_id, date_trunc('day', ts)::DATE AS day FROM events), g AS (SELECT event_id, user_id, date_trunc('day', ts)::DATE AS day, value AS a, CASE WHEN event_id % 5 = 0 THEN 0 ELSE value + 3 END AS b FROM events WHERE event_type <> 'click'),
l AS (SELECT user_id, day, max(greatest(a, b)) AS len FROM g GROUP BY ALL), o AS (SELECT user_id, day, coalesce(sum(coalesce(len, 0)) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM p LEFT JOIN l USING (user_id, day))
SELECT event_id, round(a + off, 4) AS start, round(CASE WHEN b <> 0 THEN b + off ELSE 0 END, 4) AS stop FROM g JOIN o USING (user_id, day)""")
def w09(spark, d):
    e = table(spark, d, "events").withColumn("day", F.to_date("ts"))
    segments = e.filter("event_type <> 'click'").select("user_id", "day", "event_id", F.col("value").alias("start"), F.when(F.col("event_id") % 5 == 0, 0.0).otherwise(F.col("value") + 3).alias("end"))
    return U.part_offsets(e, segments, "user_id", "day").select("event_id", F.round("start", 4).alias("start"), F.round("end", 4).alias("stop"))


@query("w16_image_places", "SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'page=' || page_id WHEN 1 THEN 'region=1,2,3,4,px' ELSE 'full_image' END AS locator, 'a.png' || CASE page_id % 3 WHEN 0 THEN '#page=' || page_id WHEN 1 THEN '#image&region=1,2,3,4,px' ELSE '#image' END AS evidence FROM pages")
def w16(spark, d):
    page, region = F.when(F.col("page_id") % 3 == 0, F.col("page_id")), F.when(F.col("page_id") % 3 == 1, "1,2,3,4,px")
    return table(spark, d, "pages").select("page_id", U.locator(page, region).alias("locator"), U.image_evidence(F.lit("a.png"), page, region).alias("evidence"))


@query("r02_stream_events", """WITH l AS (SELECT user_id, event_id, CASE WHEN event_id % 3 = 0 THEN '' WHEN event_id % 97 = 1 THEN 'data: [DONE]' WHEN event_id % 3 = 1 THEN 'data: ' || event_type ELSE 'event: x' END AS line FROM events),
e AS (SELECT *, coalesce(sum((line = '')::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS event FROM l),
g AS (SELECT user_id, event, string_agg(substr(line, 7), chr(10) ORDER BY event_id) AS data FROM e WHERE starts_with(line, 'data: ') GROUP BY ALL), z AS (SELECT user_id, min(event) AS last FROM g WHERE data = '[DONE]' GROUP BY user_id)
SELECT user_id, event, data FROM g LEFT JOIN z USING (user_id) WHERE last IS NULL OR event < last""")
def r02(spark, d):
    i = F.col("event_id")
    line = F.when(i % 3 == 0, "\r").when(i % 97 == 1, "data: [DONE]").when(i % 3 == 1, F.concat(F.lit("data: "), "event_type")).otherwise("event: x")
    return R.stream_events(table(spark, d, "events").withColumn("line", line), "user_id", "event_id", "line")


@query("j14_upsert", "SELECT p_partkey, p_name || ' new' AS p_name FROM part WHERE p_size > 40 UNION ALL SELECT p_partkey, p_name FROM part WHERE p_size <= 40 AND p_partkey % 2 = 0")
def j14(spark, d):
    rows = table(spark, d, "part").select("p_partkey", "p_name", "p_size")
    old, new = rows.filter("p_partkey % 2 = 0").drop("p_size"), rows.filter("p_size > 40").select("p_partkey", F.concat("p_name", F.lit(" new")).alias("p_name"))
    return U.upsert(old, new, ["p_partkey"])
