"""Queries of answers and payloads built from whole tables, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import payloads as P
from tessera.plans.registry import query


@query("p26_chunk_rows", r"""WITH c AS (SELECT conv_id, turn, role, coalesce(regexp_replace(text, '^[\x09-\x0D\x1C-\x20]+|[\x09-\x0D\x1C-\x20]+$', '', 'g'), '') AS said, 'm/' || conv_id || '.txt' AS path, strlen(coalesce(text, ''))::BIGINT AS n FROM conversations),
p AS (SELECT *, turn % 7 = 5 AS bad, CASE WHEN turn % 3 = 0 THEN path || '#time=' || printf('%.3f', turn::DOUBLE) || '-' || printf('%.3f', n + 0.5) || '&lines=' || turn || '-' || turn + 1 WHEN turn % 3 = 1 THEN path || '#text=' || turn || '-' || n ELSE path || '#page=' || turn || '&region=1,2,3,4,px' END AS own FROM c)
SELECT conv_id::VARCHAR AS episode_id, turn::VARCHAR AS chunk_id, CASE WHEN bad THEN '' ELSE sha256(CASE WHEN said <> '' THEN said || '|x' ELSE 'x' END) END AS facts, CASE WHEN bad THEN '' ELSE role END AS relationships, CASE WHEN bad THEN '' WHEN turn % 2 = 0 THEN said ELSE turn::VARCHAR END AS insight_summary,
 CASE WHEN bad THEN own WHEN turn % 4 = 1 THEN own || '|r' ELSE 'r|' || own END AS evidence_refs, CASE turn % 3 WHEN 0 THEN 2 WHEN 1 THEN 0 END AS segments, CASE WHEN turn % 3 = 2 THEN 1 END AS pages, bad AS malformed FROM p""")
def p26(spark, d):
    turn, text = F.col("turn"), F.coalesce("text", F.lit(""))
    path, n = F.concat(F.lit("m/"), F.col("conv_id").cast("string"), F.lit(".txt")), F.octet_length(text).cast("long")
    line = lambda k: F.struct((turn + k).cast("int").alias("source_line"), (turn + k).cast("double").alias("start"), (n + 0.5 - k).cast("double").alias("end"))
    one = lambda c: F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")
    # Lists with items that are no texts, and one list under its other name.
    facts = F.concat(F.lit('{"facts": ['), one(text), F.lit(', 5, null, " ", " x\\t", ["y"]], "'), F.when(turn % 2 == 0, "relationships").otherwise("relationship_interactions"), F.lit('": ["'), "role", F.lit('"], "conflicts": {}, "insight_summary": '), F.when(turn % 2 == 0, one(F.concat(F.lit(" "), text))).otherwise(turn.cast("string")))
    own = F.concat(path, F.lit("#text="), turn.cast("string"), F.lit("-"), n.cast("string"))
    payload = F.when(turn % 7 == 5, F.lit("[1]")).otherwise(F.concat(facts, F.lit(', "evidence_refs": '), F.to_json(F.when(turn % 4 == 1, F.array(F.when(turn % 3 == 1, own).otherwise(F.lit("own")), F.lit("r"))).otherwise(F.array(F.lit("r")))), F.lit("}")))
    units = spark.read.parquet(f"{d}/conversations.parquet").select(
        F.lit("s").alias("season_id"), F.col("conv_id").cast("string").alias("episode_id"), turn.cast("string").alias("chunk_id"), F.lit("full").alias("extraction_stage"), F.lit("r").alias("extraction_run_id"), F.lit("u").alias("unit_id"), F.lit("text").alias("unit_kind"), F.when(turn % 3 == 2, "image").otherwise("text").alias("medium"),
        path.alias("relative_path"), turn.cast("long").alias("start_offset"), n.alias("end_offset"), F.when(turn % 3 == 0, F.array(line(0), line(1))).alias("segments"), turn.cast("int").alias("page"), F.struct(*[F.lit(i).alias(k) for i, k in enumerate(("x", "y", "width", "height"), 1)], F.lit("px").alias("unit")).alias("region"), payload.alias("payload"), "role",
    )
    rows = P.chunk_rows(units)
    listed = lambda c: F.array_join(c, "|")
    return rows.select("episode_id", "chunk_id", F.when(F.col("malformed"), "").otherwise(F.sha2(listed("facts"), 256)).alias("facts"), listed("relationship_interactions").alias("relationships"), "insight_summary", listed("evidence_refs").alias("evidence_refs"), F.col("source_counts")["timed_text_segments"].alias("segments"), F.col("source_counts")["pages"].alias("pages"), "malformed")


@query("p30_source_metadata", """WITH l AS (SELECT l_orderkey AS k, l_linenumber AS n, CASE l_returnflag WHEN 'A' THEN 'audio' WHEN 'N' THEN 'text' ELSE 'pdf' END AS medium, l_linestatus AS form, l_quantity::BIGINT AS quantity FROM lineitem WHERE l_orderkey IS NOT NULL),
f AS (SELECT k, medium, min(n) AS first, max(quantity) > 25 AS large FROM l GROUP BY ALL), m AS (SELECT k, string_agg(medium, ',' ORDER BY first, medium) FILTER (medium <> 'pdf') AS listed, string_agg(medium, ',' ORDER BY medium) FILTER (medium <> 'pdf' AND large) AS counted FROM f GROUP BY k),
o AS (SELECT k, string_agg(form, ',' ORDER BY first, form) AS forms FROM (SELECT k, form, min((n, medium)) AS first FROM l GROUP BY ALL) GROUP BY k), c AS (SELECT k, count(*) AS lines FROM l GROUP BY k)
SELECT k AS l_orderkey, CASE WHEN k % 4 < 2 THEN coalesce(listed, 'image') WHEN k % 4 = 2 THEN coalesce(counted, 'image') ELSE 'image' END AS media_types, forms AS content_forms, lines::VARCHAR AS n_lines, CASE WHEN k % 2 = 0 THEN 'run' || k END AS extraction_run_id FROM m JOIN o USING (k) JOIN c USING (k)""")
def p30(spark, d):
    medium = F.when(F.col("l_returnflag") == "A", "audio").when(F.col("l_returnflag") == "N", "text").otherwise("pdf")
    rows = spark.read.parquet(f"{d}/lineitem.parquet").filter("l_orderkey is not null").select(F.col("l_orderkey").alias("k"), F.struct(F.col("l_linenumber").alias("n"), medium.alias("medium"), F.col("l_linestatus").alias("form"), F.col("l_quantity").cast("long").alias("quantity")).alias("x"))
    # An order has few lines.
    orders = rows.groupBy("k").agg(F.array_sort(F.collect_list("x")).alias("x"))
    media = F.transform("x", lambda x: x["medium"])
    many = lambda m: F.coalesce(F.array_max(F.transform(F.filter("x", lambda x: x["medium"] == m), lambda x: x["quantity"])) > 25, F.lit(False)).cast("int")
    refs = F.transform("x", lambda x: F.struct(x["form"].alias("content_form")))
    header = F.when(F.col("k") % 4 == 0, media)
    breakdown = F.when(F.col("k") % 4 == 2, F.struct(F.struct(*[many(m).alias(m) for m in ("audio", "pdf", "text")]).alias("media_types")))
    trace = F.struct(F.when(F.col("k") % 4 == 1, media).alias("media_types"), breakdown.alias("source_breakdown"), F.slice(refs, 1, 2).alias("material_refs"))
    chunks = F.transform(refs, lambda r: F.struct(F.struct(F.array(r).alias("material_refs")).alias("source_trace")))
    payload = F.to_json(F.struct(F.lit("image ").alias("source_kind"), header.alias("media_types"), trace.alias("source_trace"), chunks.alias("chunk_results"), F.struct(F.size("x").alias("lines")).alias("source_counts"), F.when(F.col("k") % 2 == 0, F.concat(F.lit("run"), F.col("k").cast("string"))).alias("extraction_run_id")))
    out = P.source_metadata(orders.select("k", payload.alias("payload")))
    return out.select(F.col("k").alias("l_orderkey"), F.array_join("media_types", ",").alias("media_types"), F.array_join("content_forms", ",").alias("content_forms"), F.col("source_counts")["lines"].alias("n_lines"), "extraction_run_id")
