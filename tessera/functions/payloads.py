"""Answers of models and stored payloads as typed values: each is parsed once to a VARIANT and navigated from there.

Defined results: a payload that is no JSON object, a null one included, has empty values; a list keeps its texts only, trimmed and without
empty ones; what isn't of the kind that is looked for counts as absent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T

#: Lists of an answer, and media in canonical form.
LISTS = ("facts", "behavior_traits", "dialogue_style", "relationship_interactions", "conflicts", "character_state_changes")
#: Other names that a list may have.
ALIASES = {"relationship_interactions": ("relationships",)}
MEDIA = ("video", "image", "audio", "text")
#: What a payload's source keeps at most of its refs, and of its units and derived files.
MOST_REFS, MOST_UNITS = 20, 48


#: The characters of T.BLANK.
BLANKS = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def strip(text: Column) -> Column:
    """T.strip for short texts: no expression is searched for at each of their places."""
    return F.btrim(text, F.lit(BLANKS))


def trimmed(items: Column) -> Column:
    """T.trimmed for short texts."""
    return F.filter(F.transform(items, strip), lambda x: x != "")


def none() -> Column:
    return F.array().cast("array<string>")


def parsed(payload: Column) -> Column:
    """A payload as a VARIANT; null unless it is an object."""
    return T.let(F.try_parse_json(payload), lambda v: F.when(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), v))


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _items(v: Column) -> Column:
    return F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array().cast("array<variant>"))


def strings(v: Column) -> Column:
    """The texts of a VARIANT list."""
    return trimmed(F.transform(F.filter(_items(v), lambda x: _kind(x) == "STRING"), lambda x: F.variant_get(x, "$", "string")))


def printed(v: Column) -> Column:
    """The texts, numbers and truth values of a VARIANT list, as texts."""
    return trimmed(F.transform(F.filter(_items(v), lambda x: ~F.rlike(_kind(x), F.lit("^(OBJECT|ARRAY|VOID)"))), lambda x: F.variant_get(x, "$", "string")))


def at(v: Column, *path: str) -> Column:
    """What lies at the first of several paths that is there (a JSON null is); null if none is."""
    return F.coalesce(*[F.try_variant_get(v, p, "variant") for p in path])


def said(v: Column, path: str) -> Column:
    """A text or number, trimmed; empty for anything else."""
    text = T.let(F.try_variant_get(v, path, "variant"), lambda x: F.when(~F.rlike(_kind(x), F.lit("^(OBJECT|ARRAY|VOID)")), F.try_variant_get(x, "$", "string")))
    return strip(F.coalesce(text, F.lit("")))


def first_filled(*lists: Column) -> Column:
    """The first list that isn't empty: a table of precedence."""
    return F.coalesce(*[T.let(x, lambda y: F.when(F.size(y) > 0, y)) for x in lists], none())


def with_fallback(refs: Column, fallback: Column) -> Column:
    """Refs with one of their own at the end, unless they have it."""
    return F.when(F.array_contains(refs, fallback), refs).otherwise(F.array_append(refs, fallback))


def place(path: Column, medium: Column, start: Column, end: Column, segments: Column, page: Column, region: Column) -> Column:
    """Where a chunk lies, as evidence of its own: a time and lines of segments (source_line, start, end), a range of text, or a page and region."""
    lines = F.filter(F.transform(segments, lambda s: s["source_line"]), lambda n: n.isNotNull())
    seconds = lambda c: F.format_string("%.3f", c)
    timed = F.concat(path, F.lit("#time="), seconds(F.get(segments, F.lit(0))["start"]), F.lit("-"), seconds(F.array_max(F.transform(segments, lambda s: s["end"]))), F.when(F.size(lines) > 0, F.concat(F.lit("&lines="), F.element_at(lines, 1).cast("string"), F.lit("-"), F.element_at(lines, -1).cast("string"))).otherwise(""))
    text = F.concat(path, F.lit("#text="), start.cast("string"), F.lit("-"), end.cast("string"))
    where = F.when(region.isNull(), "").otherwise(F.concat(F.lit("&region="), F.concat_ws(",", *[region[n].cast("string") for n in ("x", "y", "width", "height", "unit")])))
    image = F.concat(path, F.when(page.isNull(), "#image").otherwise(F.concat(F.lit("#page="), page.cast("string"))), where)
    return F.when(medium == "image", image).when(F.size(segments) > 0, timed).otherwise(text)


def chunk_rows(units: DataFrame) -> DataFrame:
    """Answers about units as typed chunk rows.

    units: season_id, episode_id, chunk_id, extraction_stage, extraction_run_id, unit_id, unit_kind, medium, relative_path, start_offset, end_offset,
    segments (array of source_line, start, end; null: none), page, region (x, y, width, height, unit), payload (JSON). Adds the lists,
    insight_summary, evidence_refs (the chunk's own place last, unless it is there), source_kind, source_path, source_counts and malformed.
    """
    segments = F.coalesce("segments", F.filter("segments", lambda s: F.lit(False)), F.array().cast(units.schema["segments"].dataType))
    rows = units.withColumn("_payload", parsed(F.col("payload"))).withColumn("_segments", segments)
    lists = [strings(at(F.col("_payload"), f"$.{name}", *[f"$.{a}" for a in ALIASES.get(name, ())])).alias(name) for name in LISTS]
    own = place(F.col("relative_path"), F.col("medium"), F.col("start_offset"), F.col("end_offset"), F.col("_segments"), F.col("page"), F.col("region"))
    refs = T.let(strings(at(F.col("_payload"), "$.evidence_refs")), lambda r: with_fallback(r, own))
    one, n = F.lit(1).cast("long"), F.size("_segments").cast("long")
    has = lambda c: F.col(c).isNotNull().cast("long")
    counted = F.when(F.col("medium") == "image", _counts(materials=one, units=one, images=one, pages=has("page"), regions=has("region"))).otherwise(
        _counts(materials=one, units=one, text_ranges=one, timed_text_segments=n, transcript_segments=F.when(F.col("unit_kind") == "transcript_text", n).otherwise(0))
    )
    ids = ["season_id", "episode_id", "chunk_id", "extraction_stage", "extraction_run_id", "unit_id"]
    return rows.select(*ids, F.col("relative_path").alias("source_path"), F.col("medium").alias("source_kind"), counted.alias("source_counts"), *lists, said(F.col("_payload"), "$.insight_summary").alias("insight_summary"), refs.alias("evidence_refs"), F.col("_payload").isNull().alias("malformed"))


def _counts(**counts: Column) -> Column:
    return F.create_map(*[x for k, c in counts.items() for x in (F.lit(k), c.cast("long"))])


def source_metadata(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """payloads with source_kind, media_types, content_forms, source_counts (JSON by key), evidence_refs, extraction_run_id, unit_refs, derived_refs.

    media_types: those of the header, else of the trace, else the trace's counted ones that are positive, else the one source kind; canonical ones only.
    content_forms: of the header, the trace's materials and the traces of chunks, distinct.
    """
    v = F.col("_payload")
    canonical = lambda x: F.array_distinct(F.filter(x, lambda m: m.isin(*MEDIA)))
    breakdown = "$.source_trace.source_breakdown.media_types"
    # A VARIANT sorts its keys; the payload's text has their order.
    order = F.map_keys(F.from_json(F.get_json_object(F.col(payload), breakdown), "map<string,string>"))
    count = lambda k: F.element_at(F.col("_counts"), k)
    positive = lambda k: F.when(_kind(count(k)) == "BOOLEAN", F.try_variant_get(count(k), "$", "boolean")).when(_kind(count(k)) == "BIGINT", F.try_variant_get(count(k), "$", "bigint") > 0).otherwise(False)
    counted = F.transform(F.filter(F.coalesce(order, none()), positive), strip)
    kind = said(v, "$.source_kind")
    forms = lambda trace: F.filter(F.transform(_items(F.try_variant_get(trace, "$.material_refs", "variant")), lambda m: said(m, "$.content_form")), lambda f: f != "")
    of_chunks = F.flatten(F.transform(_items(at(v, "$.chunk_results")), lambda c: forms(F.try_variant_get(c, "$.source_trace", "variant"))))
    counts = F.coalesce(F.try_variant_get(v, "$.source_counts", "map<string,variant>"), F.create_map().cast("map<string,variant>"))
    rows = payloads.withColumn("_payload", parsed(F.col(payload))).withColumn("_counts", F.try_variant_get(v, breakdown, "map<string,variant>"))
    distinct = lambda p: F.slice(F.array_distinct(printed(at(v, p))), 1, MOST_UNITS)
    return rows.withColumns({
        "source_kind": kind,
        "media_types": first_filled(canonical(printed(at(v, "$.media_types"))), canonical(printed(at(v, "$.source_trace.media_types"))), canonical(counted), canonical(F.array(kind))),
        "content_forms": F.array_distinct(F.concat(printed(at(v, "$.content_forms")), forms(F.try_variant_get(v, "$.source_trace", "variant")), of_chunks)),
        "source_counts": F.transform_values(F.map_filter(counts, lambda _, x: _kind(x) != "VOID"), lambda _, x: F.to_json(x)),
        "evidence_refs": T.capped(printed(at(v, "$.evidence_refs")), MOST_REFS),
        "extraction_run_id": F.nullif(said(v, "$.extraction_run_id"), F.lit("")),
        "unit_refs": distinct("$.source_trace.unit_refs"),
        "derived_refs": distinct("$.source_trace.derived_artifact_refs"),
    }).drop("_payload", "_counts")
