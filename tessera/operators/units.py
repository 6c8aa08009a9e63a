"""Extraction units: which handler takes them, what a preview tries first, and their places in a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources import media

#: Kinds of units that the text, image and native media handlers take.
TEXT_KINDS = ("document_text", "controlled_json_text", "transcript_text")
TIMED_KINDS = ("subtitle_text",)
IMAGE_KINDS = ("image_source", "image_page")
NATIVE_KINDS = ("audio_source", "video_chunk")
#: Cost of a preview by kind.
COSTS = {"timed_text": 8, "transcript": 10, "text": 12, "image": 20, "audio_transcript": 30, "video": 40}


def takes_text(kind: Column, path: Column, documents: tuple[str, ...] = TEXT_KINDS, timed: tuple[str, ...] = TIMED_KINDS) -> Column:
    """Whether the text handler takes a unit: documents, or timed text in a format that is read."""
    return kind.isin(*documents) | kind.isin(*timed) & media.suffix(path).isin(*media.TIMED_TEXT)


def takes_image(kind: Column, path: Column, kinds: tuple[str, ...] = IMAGE_KINDS) -> Column:
    return kind.isin(*kinds) & media.suffix(path).isin(*media.STATIC_IMAGE)


def takes_native(medium: Column, kind: Column, kinds: tuple[str, ...] = NATIVE_KINDS) -> Column:
    return medium.isin("audio", "video") & kind.isin(*kinds)


def dispatch(units: DataFrame, image_input: bool, native: Column | None = None) -> DataFrame:
    """A row for each unit and handler, and for each reason why a handler doesn't take it: columns of units, handler, reason.

    units: season_id, episode_id, unit_id, media_type, unit_kind, path, transcript_candidate, support_reason. A video or audio unit can
    go to two handlers. native: the reason why native media aren't handled, null where they are; None: no such handler, so all are.
    """
    kind, path, medium = F.col("unit_kind"), F.col("path"), F.col("media_type")
    why = F.coalesce(F.when(F.trim("support_reason") != "", F.trim("support_reason")), F.lit("formal_handler_not_available"))
    refused = native if native is not None else F.lit(None).cast("string")
    to = lambda name: F.struct(F.lit(name).cast("string").alias("handler"), F.lit(None).cast("string").alias("reason"))
    not_for = lambda reason: F.struct(F.lit(None).cast("string").alias("handler"), reason.cast("string").alias("reason"))
    considered = takes_native(medium, kind)
    media_row = F.when(considered, F.when(refused.isNull(), to("native_media")).otherwise(not_for(refused)))
    candidate = F.coalesce("transcript_candidate", F.lit(False))
    first = (
        F.when(medium == "video", to("video"))
        .when(medium == "text", F.when(takes_text(kind, path), to("text")).otherwise(not_for(why)))
        .when(medium == "image", F.when(~takes_image(kind, path), not_for(why)).when(F.lit(not image_input), not_for(F.lit("model_image_input_not_supported"))).otherwise(to("image")))
        .when(medium == "audio", F.when(candidate, to("audio_transcript")).when(~considered, not_for(why)))
        .otherwise(not_for(why))
    )
    rows = units.withColumn("to", F.explode(F.filter(F.array(first, media_row), lambda x: x.isNotNull())))
    return rows.select(*units.columns, "to.handler", "to.reason")


def preview(units: DataFrame, image_input: bool) -> DataFrame:
    """units with kind and cost of a preview, or the reason why there is none; audio of episodes with a transcript stays out.

    units: as for dispatch, with content_form. The episodes with transcripts are joined, so an episode's units need no window.
    """
    told = units.filter("unit_kind = 'transcript_text'").select("season_id", "episode_id").distinct().withColumn("told", F.lit(True))
    kind, path, medium = F.col("unit_kind"), F.col("path"), F.col("media_type")
    why = F.coalesce(F.when(F.trim("support_reason") != "", F.trim("support_reason")), F.lit("preview_handler_not_available"))
    text = F.when(~takes_text(kind, path), None).when(kind == "transcript_text", "transcript").when(kind.isin("subtitle_text", "lyrics_text") | (F.col("content_form") == "script"), "timed_text").otherwise("text")
    image = F.when(takes_image(kind, path) & F.lit(image_input), "image")
    sound = F.when(F.coalesce("transcript_candidate", F.lit(False)), "audio_transcript")
    found = F.when(medium == "text", text).when(medium == "image", image).when(medium == "audio", sound).when(medium == "video", "video")
    reason = F.when(F.col("kind").isNull(), F.when((medium == "image") & takes_image(kind, path), "model_image_input_not_supported").otherwise(why))
    cost = F.element_at(F.create_map(*[F.lit(x) for pair in COSTS.items() for x in pair]), F.col("kind"))
    rows = units.join(told, ["season_id", "episode_id"], "left").filter((medium != "audio") | F.col("told").isNull()).withColumn("kind", found)
    return rows.select(*units.columns, "kind", cost.alias("cost"), reason.alias("reason"))


def preview_order() -> list[Column]:
    """Cheapest candidates first, then by season, episode, path without case, and unit."""
    return [F.col("cost").asc_nulls_last(), F.col("season_id"), F.col("episode_id"), F.lower("path"), F.col("unit_id")]


def locator(page: Column, region: Column) -> Column:
    """Where an image's evidence stands: page, region (x,y,width,height,unit; null: none), or the full image."""
    found = F.concat_ws(";", F.concat(F.lit("page="), page.cast("string")), F.concat(F.lit("region="), region))
    return F.when(found == "", "full_image").otherwise(found)


def image_evidence(path: Column, page: Column, region: Column) -> Column:
    at = F.when(page.isNull(), "#image").otherwise(F.concat(F.lit("#page="), page.cast("string")))
    return F.concat(path, at, F.coalesce(F.concat(F.lit("&region="), region), F.lit("")))


def first_seen(rows: DataFrame, value: str, position: str) -> DataFrame:
    """Distinct non-null values with the first position of each."""
    return rows.filter(F.col(value).isNotNull()).groupBy(value).agg(F.min(position).alias(position))


def run_keys(units: DataFrame, position: str) -> DataFrame:
    """Episodes of a run by first appearance, with the place of their season among seasons: season_id, episode_id, season_no, units."""
    e = units.groupBy("season_id", "episode_id").agg(F.min(position).alias("at"), F.count("*").alias("units"))
    s = e.groupBy("season_id").agg(F.min("at").alias("first"))
    # One row a season.
    return e.join(s.withColumn("season_no", F.row_number().over(Window.orderBy("first"))).drop("first"), "season_id")


def part_offsets(parts: DataFrame, segments: DataFrame, by: str, part: str) -> DataFrame:
    """segments (by, part, start, end, ...) in the time of the whole: each part begins where the parts before it end; an end of 0 stays 0.

    A part lasts until its last start or end; parts without segments last no time.
    """
    last = segments.groupBy(by, part).agg(F.max(F.greatest("start", "end")).alias("length"))
    before = Window.partitionBy(by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offset = parts.select(by, part).distinct().join(last, [by, part], "left").withColumn("offset", F.coalesce(F.sum(F.coalesce("length", F.lit(0.0))).over(before), F.lit(0.0))).drop("length")
    moved = segments.join(offset, [by, part])
    return moved.withColumn("start", F.col("start") + F.col("offset")).withColumn("end", F.when(F.col("end") != 0, F.col("end") + F.col("offset")).otherwise(0.0))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new, and those of old whose key new lacks."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def restricted(units: DataFrame, artifacts: DataFrame, unit_id: str) -> tuple[DataFrame, DataFrame]:
    """A run plan cut to one unit: the unit, and the derived artifacts (artifact_id, unit_refs) that it names or that name it."""
    one = units.filter(F.col("unit_id") == unit_id)
    named = one.select(F.explode("derived_refs").alias("artifact_id")).distinct().withColumn("named", F.lit(True))
    kept = artifacts.join(named, "artifact_id", "left").filter(F.col("named") | F.array_contains("unit_refs", unit_id)).drop("named")
    return one, kept
