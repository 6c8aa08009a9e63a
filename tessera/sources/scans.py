"""Listings of files as seasons, episodes, collections and extraction units.

A listing has relative paths with forward slashes, as of the binaryFile source. Numbers of files are windows within their own
directory; numbers of directories are windows over one row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators.joins import exactly_one
from tessera.operators.order import placed, written
from tessera.sources import media

#: The season of everything that is no video, and names of videos cut or transcoded before.
GENERIC_SEASON = "season_materials"
SEGMENT, TRANSCODED = "segment_", "transcoded.mp4"


def name(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def parent(path: Column) -> Column:
    """The directory of a path; a dot at the top."""
    found = F.regexp_extract(path, "^(.*)/[^/]*$", 1)
    return F.when(found == "", ".").otherwise(found)


def stable_id(kind: str, medium: Column, path: Column) -> Column:
    """material, episode or unit id of a path: the kind, the medium and 12 hex digits."""
    typed = medium if kind == "material" else F.concat(F.lit(f"{kind}:"), medium)
    return F.concat_ws("_", F.lit(kind), medium, T.stable_id(typed, path))


def active(files: DataFrame, indexed: DataFrame) -> DataFrame:
    """files (path) outside derived_inputs/, and those inside that the index of preprocessed files (path, ...) has, with its columns."""
    rows = files.join(indexed.withColumn("_known", F.lit(True)), "path", "left")
    return rows.filter(~F.startswith("path", F.lit("derived_inputs/")) | F.col("_known")).drop("_known")


def seasons(files: DataFrame) -> DataFrame:
    """Videos right below first-level directories: season_id, episode_id, title, path, numbered by name without case."""
    parts = F.split("path", "/")
    rows = files.filter(F.size(parts) > 1).select("path", F.get(parts, F.lit(0)).alias("folder"), F.size(parts).alias("depth"))
    folders = rows.select("folder").distinct().withColumn("no", F.row_number().over(Window.orderBy(F.lower("folder"), "folder")))
    videos = rows.filter((F.col("depth") == 2) & media.suffix(F.col("path")).isin(*media.VIDEO))
    place = F.row_number().over(Window.partitionBy("folder").orderBy(F.lower(name(F.col("path"))), "path"))
    return videos.join(folders, "folder").select(F.format_string("season_%03d", "no").alias("season_id"), F.format_string("episode_%03d", place).alias("episode_id"), name(F.col("path")).alias("title"), "path")


def episode_chunks(files: DataFrame) -> DataFrame:
    """Video chunks by directory: its segments if it has any, else its one transcoded video; other directories are no episodes.

    Columns: directory, chunk_id (by name without case, from 1), path.
    """
    videos = files.filter(media.suffix(F.col("path")).isin(*media.VIDEO)).select("path", parent(F.col("path")).alias("directory"), F.lower(name(F.col("path"))).alias("low"))
    segment = F.startswith("low", F.lit(SEGMENT))
    kinds = videos.groupBy("directory").agg(F.bool_or(segment).alias("cut"), F.min(F.when(F.col("low") == TRANSCODED, F.col("path"))).alias("whole"))
    kept = videos.join(kinds, "directory").filter(F.col("cut") & segment | ~F.col("cut") & (F.col("path") == F.col("whole")))
    place = F.row_number().over(Window.partitionBy("directory").orderBy("low", "path"))
    return kept.select("directory", F.format_string("chunk_%04d", place).alias("chunk_id"), "path")


def preview_videos(files: DataFrame, limit: int) -> DataFrame:
    """The first videos by path without case."""
    return files.filter(media.suffix(F.col("path")).isin(*media.VIDEO)).orderBy(F.lower("path"), "path").limit(limit)


def image_pages(files: DataFrame) -> DataFrame:
    """Images as pages of their directory's collection, in natural order: episode_id, page, path, unit_kind, content_form, size, supported.

    A collection with more than one page of a supported format is a manga, else a set of images.
    """
    images = files.filter(media.medium(F.col("path")) == "image").select("path", parent(F.col("path")).alias("directory"), (media.profile(F.col("path"))["formal_support"] == "supported").cast("long").alias("good"))
    sums = images.groupBy("directory").agg(F.count("*").alias("size"), F.sum("good").alias("supported"))
    page = F.row_number().over(Window.partitionBy("directory").orderBy(T.natural_key(name(F.col("path"))), "path"))
    rows = images.withColumn("page", page).join(sums, "directory")
    form, kind = F.when(F.col("supported") > 1, "manga").otherwise("image_set"), F.when(F.col("size") > 1, "image_page").otherwise("image_source")
    return rows.select(stable_id("episode", F.lit("image"), F.col("directory")).alias("episode_id"), "directory", "page", "path", kind.alias("unit_kind"), form.alias("content_form"), "size", "supported")


def content_form(path: Column, hint: Column | None = None) -> Column:
    """novel, script, setting_book, audio_drama or image_set: by a hint (texts only), medium, suffix and words of the name."""
    medium, stem = media.medium(path), F.lower(F.regexp_replace(name(path), r"\.[^.]*$", ""))
    told = (medium == "text") & F.coalesce(hint, F.lit("")).isin("novel", "script", "setting_book") if hint is not None else F.lit(False)
    holds = lambda *words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(stem, w))
    timed = media.suffix(path).isin(*media.TIMED_TEXT, *media.OTHER_TIMED_TEXT)
    by_name = F.when(timed | holds("script", "screenplay", "台本", "剧本"), "script").when(holds("setting", "profile", "设定", "资料"), "setting_book").otherwise("novel")
    return F.when(told, hint if hint is not None else F.lit("")).when(medium == "audio", "audio_drama").when(medium == "image", "image_set").otherwise(by_name)


def unit_kind(path: Column) -> Column:
    s = media.suffix(path)
    text = F.when(s.isin(".srt", ".ass", ".vtt"), "subtitle_text").when(s == ".lrc", "lyrics_text").when(s == ".json", "controlled_json_text").otherwise("document_text")
    medium = media.medium(path)
    return F.when(medium == "text", text).when(medium == "audio", "audio_source").when(medium == "image", "image_source").when(medium == "video", "video_chunk")


def single_units(files: DataFrame, indexed: DataFrame | None = None) -> DataFrame:
    """Each text and audio file as an episode of its own: season_id, episode_id, unit_id, material_id, path, media_type, unit_kind, content_form.

    indexed: path, hint of preprocessed files; files below derived_inputs/ that it lacks stay out.
    """
    rows = active(files.select("path"), indexed.select("path", "hint")) if indexed is not None else files.select("path", F.lit(None).cast("string").alias("hint"))
    p, medium = F.col("path"), media.medium(F.col("path"))
    ids = [stable_id(k, medium, p).alias(f"{k}_id") for k in ("episode", "unit", "material")]
    return rows.filter(medium.isin("text", "audio")).select(F.lit(GENERIC_SEASON).alias("season_id"), *ids, "path", medium.alias("media_type"), unit_kind(p).alias("unit_kind"), content_form(p, F.col("hint")).alias("content_form"))


def latest_results(listed: DataFrame) -> DataFrame:
    """Chunk files by lower-case name, one for each resolved path; files below a season go before those at the top.

    listed: path, resolved.
    """
    depth = F.size(F.split("path", "/"))
    best = listed.groupBy("resolved").agg(F.max_by("path", F.struct(depth, "path")).alias("path"))
    return best.select("path", F.lower(name(F.col("path"))).alias("sort_key"))


def aligned(timed: DataFrame, videos: DataFrame) -> DataFrame:
    """Subtitles (path) with the one episode that they belong to: path, episode_id, status, rule.

    videos: episode_id, path, episode_path (as of formal_scan). A subtitle belongs to an episode with a video of its directory and stem (case
    aside), else to the episode that its directory is; of two such episodes, to none (ambiguous).
    """
    stem = F.concat_ws("/", parent(F.col("path")), F.lower(F.regexp_replace(name(F.col("path")), r"\.[^.]*$", "")))
    subtitles = timed.filter(media.suffix(F.col("path")).isin(*media.TIMED_TEXT, *media.OTHER_TIMED_TEXT)).select("path", stem.alias("same_stem"), parent(F.col("path")).alias("same_episode_directory"))
    return exactly_one(subtitles, videos.select("episode_id", stem.alias("same_stem"), F.col("episode_path").alias("same_episode_directory")), "path", ["same_stem", "same_episode_directory"], "episode_id")


def attached(files: DataFrame, alignment: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Subtitles as units of their episodes (episode_id, path, unit_kind), and the files (path) that stand alone: all that were not matched."""
    matched = alignment.filter("status = 'matched'").select("episode_id", "path")
    return matched.withColumn("unit_kind", unit_kind(F.col("path"))), files.join(matched.select("path"), "path", "left_anti")


def formal_scan(files: DataFrame) -> DataFrame:
    """Videos as a manifest: season_id, episode_id, chunk_id, episode_path, path, with contiguous numbers in order of path without case.

    An episode is a video, or a directory of video chunks (as of episode_chunks). Those at the top are season 1 where there are any; each other
    first-level directory with episodes is a season.
    """
    videos = files.filter(media.suffix(F.col("path")).isin(*media.VIDEO)).select("path", F.size(F.split("path", "/")).alias("depth"), F.get(F.split("path", "/"), F.lit(0)).alias("top"))
    cut = episode_chunks(files).select("directory", "chunk_id", "path")
    folders = cut.select(F.col("directory").alias("top")).distinct().withColumn("_whole", F.lit(True))
    # A first-level directory that is an episode itself is no season.
    marked = videos.join(folders, "top", "left")
    single = marked.filter((F.col("depth") == 1) | (F.col("depth") == 2) & F.col("_whole").isNull())
    single = single.select(F.when(F.col("depth") == 1, ".").otherwise(F.col("top")).alias("season"), F.col("path").alias("episode_path"), F.lit("chunk_0001").alias("chunk_id"), "path")
    depth = F.size(F.split("directory", "/"))
    first = F.get(F.split("directory", "/"), F.lit(0))
    parts = cut.filter(F.col("directory") != ".").withColumn("top", first).join(folders, "top", "left")
    parts = parts.filter((depth == 1) | (depth == 2) & F.col("_whole").isNull())
    parts = parts.select(F.when(depth == 1, ".").otherwise(F.col("top")).alias("season"), F.col("directory").alias("episode_path"), "chunk_id", "path")
    rows = single.unionByName(parts)
    # One row a season, and one an episode within its season.
    seasons_ = rows.select("season").distinct().withColumn("s", F.row_number().over(Window.orderBy(F.col("season") != ".", F.lower("season"), "season")))
    episodes = rows.select("season", "episode_path").distinct().withColumn("e", F.row_number().over(Window.partitionBy("season").orderBy(F.lower("episode_path"), "episode_path")))
    out = rows.join(seasons_, "season").join(episodes, ["season", "episode_path"])
    return out.select(F.format_string("season_%03d", "s").alias("season_id"), F.format_string("episode_%03d", "e").alias("episode_id"), "chunk_id", "episode_path", "path")


def book_order(items: DataFrame, spine: DataFrame, entries: DataFrame) -> DataFrame:
    """Chapters of books in reading order: book, chapter (from 1), entry, and what is missing as warning.

    items: book, pos, item_id, entry. spine: book, pos, item_id, linear. entries: book, entry (those in the container). Items that aren't
    linear stay out, a repeated entry counts once, one that the container lacks leaves a warning; a book without a usable spine takes its items' order.
    """
    read = spine.filter(F.coalesce(F.lower("linear"), F.lit("yes")) != "no").join(items.select("book", "item_id", "entry"), ["book", "item_id"]).select("book", "entry", F.lit(True).alias("read"), "pos")
    rows = read.unionByName(items.filter("book is not null").select("book", "entry", F.lit(False).alias("read"), "pos"))
    # Both orders of an entry in one row, so that nothing is joined with itself and each book is sorted once.
    firsts = rows.groupBy("book", "entry").agg(F.bool_or("read").alias("read"), F.min(F.when(F.col("read"), F.col("pos"))).alias("by_spine"), F.min(F.when(~F.col("read"), F.col("pos"))).alias("by_item"))
    known = firsts.join(entries.select("book", "entry").distinct().withColumn("there", F.lit(True)), ["book", "entry"], "left").withColumn("there", F.coalesce("there", F.lit(False)))
    known = known.withColumn("spine", F.max("read").over(Window.partitionBy("book"))).filter("read or not spine").withColumn("pos", F.when(F.col("spine"), F.col("by_spine")).otherwise(F.col("by_item")))
    chapter = F.row_number().over(Window.partitionBy("book", "there").orderBy("pos", "entry"))
    return known.withColumn("chapter", chapter).select("book", F.when(F.col("there"), F.col("chapter")).alias("chapter"), "entry", F.when(~F.col("there"), "epub_entry_missing").alias("warning"))


#: Why a subtitle stands alone.
ALIGNMENT = {"ambiguous": "timed_text_episode_alignment_ambiguous", "unmatched": "timed_text_episode_alignment_unmatched"}


def _unit(path: Column, medium: Column) -> dict[str, Column]:
    """What every unit has by its path: ids, handler options and metadata of its own."""
    kind, timed = media.profile(path), media.suffix(path).isin(*media.TIMED_TEXT, *media.OTHER_TIMED_TEXT)
    no = F.create_map().cast("map<string,string>")
    options = F.map_concat(
        F.create_map(F.lit("preview_support"), kind["preview_support"], F.lit("formal_support"), kind["formal_support"]),
        F.when(medium == "audio", F.create_map(F.lit("transcript_candidate"), F.lit("true"))).otherwise(no),
        F.when(timed, F.create_map(F.lit("timed_text_format"), F.substring(media.suffix(path), 2, 9), F.lit("speaker_policy"), F.lit("explicit_only"))).otherwise(no),
    )
    own = F.map_concat(F.create_map(F.lit("display_title"), name(path), F.lit("sort_key"), F.lower(path), F.lit("support_reason"), kind["reason"]), F.when(timed, F.create_map(F.lit("timed_text_supported"), media.suffix(path).isin(*media.TIMED_TEXT).cast("string"))).otherwise(no))
    return {"unit_id": stable_id("unit", medium, path), "material_id": stable_id("material", medium, path), "handler_options": options, "own_metadata": own}


def material_scan(files: DataFrame, indexed: DataFrame) -> DataFrame:
    """A listing as one plan of units, all media: season_id, episode_id, episode_no, title, unit_no, unit_id, material_id, path, media_type, unit_kind,
    content_form, page, fingerprint, handler_options, metadata, warnings.

    indexed: path, hint, page_number, fingerprint, metadata (map of texts) of preprocessed files. Videos are episodes as of formal_scan, with
    the subtitles that align to them; images are pages of their directory; all other files are episodes of their own. Episodes are
    numbered by one pass over all: videos in order of season and episode, then the rest in natural order of medium and path. Of
    metadata, what preprocessing says gives way to the unit's own, and that to what the scan found out. The same listing gives the same rows.
    """
    index = indexed.select("path", F.col("hint").alias("_hint"), F.col("page_number").alias("_page"), F.col("fingerprint").alias("_fingerprint"), F.col("metadata").alias("_metadata"))
    medium = media.medium(F.col("path"))
    # Each of these is read several times.
    videos = written(formal_scan(files), "videos")
    others = written(active(files.filter(medium.isNotNull() & (medium != "video")).select("path"), index), "others")
    # An episode's id is its season's; both name it here.
    of = F.concat_ws("/", "season_id", "episode_id")
    alignment = written(aligned(others, videos.select(of.alias("episode_id"), "path", "episode_path")), "alignment")
    matched, failed = alignment.filter("status = 'matched'"), alignment.filter("status <> 'matched'").select("path", F.col("status").alias("_status"))
    nothing = F.create_map().cast("map<string,string>")
    text = lambda c: c.cast("string")

    own = videos.select("season_id", "episode_id", "path", name(F.col("episode_path")).alias("title"), F.lit("video").alias("media_type"), F.lit("video_chunk").alias("unit_kind"), F.lit("unknown").alias("content_form"), F.lit(None).cast("int").alias("page"), F.lit(0).alias("group"), F.col("chunk_id").alias("chunk"), nothing.alias("found"), F.lit(None).cast("string").alias("warning"))
    episodes = videos.groupBy(of.alias("of")).agg(F.first("season_id").alias("season_id"), F.first("episode_id").alias("episode_id"), F.min(name(F.col("episode_path"))).alias("title"))
    said = F.create_map(F.lit("associated_video_episode"), F.lit("true"), F.lit("matched_by"), F.col("rule"), F.lit("status"), F.lit("matched"))
    attached = matched.withColumnRenamed("episode_id", "of").join(episodes, "of").select("season_id", "episode_id", "path", "title", F.lit("text").alias("media_type"), unit_kind(F.col("path")).alias("unit_kind"), F.lit("script").alias("content_form"), F.lit(None).cast("int").alias("page"), F.lit(1).alias("group"), F.lit("").alias("chunk"), said.alias("found"), F.lit(None).cast("string").alias("warning"))

    pages = image_pages(others)
    place = F.create_map(F.lit("chapter_path"), F.col("directory"), F.lit("page_number"), text(F.col("page")), F.lit("image_collection_size"), text(F.col("size")), F.lit("supported_page_count"), text(F.col("supported")), F.lit("manga_candidate"), text(F.col("supported") > 1))
    images = pages.select(F.lit(GENERIC_SEASON).alias("season_id"), "episode_id", "path", name(F.col("directory")).alias("title"), F.lit("image").alias("media_type"), "unit_kind", "content_form", "page", F.lit(0).alias("group"), F.lit("").alias("chunk"), place.alias("found"), F.lit(None).cast("string").alias("warning"))

    rest = others.filter(media.medium(F.col("path")) != "image").join(matched.select("path"), "path", "left_anti").join(failed, "path", "left")
    reason = F.when(F.col("_status") == "ambiguous", ALIGNMENT["ambiguous"]).when(F.col("_status") == "unmatched", ALIGNMENT["unmatched"])
    alone = F.when(reason.isNull(), nothing).otherwise(F.create_map(F.lit("status"), F.col("_status"), F.lit("reason"), reason))
    singles = rest.select(F.lit(GENERIC_SEASON).alias("season_id"), stable_id("episode", medium, F.col("path")).alias("episode_id"), "path", name(F.col("path")).alias("title"), medium.alias("media_type"), unit_kind(F.col("path")).alias("unit_kind"), content_form(F.col("path"), F.col("_hint")).alias("content_form"), F.lit(None).cast("int").alias("page"), F.lit(0).alias("group"), F.lit("").alias("chunk"), alone.alias("found"), reason.alias("warning"))

    units = written(own.unionByName(attached).unionByName(images).unionByName(singles), "units")
    sort_key = F.concat(F.col("media_type"), F.lit(":"), F.lower(F.when(F.col("media_type") == "image", parent(F.col("path"))).otherwise(F.col("path"))))
    firsts = units.filter("group = 0").groupBy("season_id", "episode_id").agg(F.min(F.when(F.col("season_id") == GENERIC_SEASON, sort_key)).alias("key"))
    numbered = placed(firsts, [F.col("key").isNotNull(), F.when(F.col("key").isNull(), F.col("season_id")), F.when(F.col("key").isNull(), F.col("episode_id")), T.natural_key(F.col("key")), F.col("key"), F.col("episode_id")], name="episodes")
    by = Window.partitionBy("season_id", "episode_id").orderBy("group", "chunk", F.col("page").asc_nulls_first(), T.natural_key(F.col("path")), "path")
    ids = _unit(F.col("path"), F.col("media_type"))
    out = units.withColumn("unit_no", F.row_number().over(by)).join(numbered.select("season_id", "episode_id", F.col("place").alias("episode_no")), ["season_id", "episode_id"]).join(index, "path", "left")
    known = F.coalesce("_metadata", nothing)
    return out.select(
        "season_id", "episode_id", "episode_no", "title", "unit_no", ids["unit_id"].alias("unit_id"), ids["material_id"].alias("material_id"), "path", "media_type", "unit_kind", "content_form", F.coalesce("page", F.col("_page").cast("int")).alias("page"), F.coalesce("_fingerprint", F.lit("")).alias("fingerprint"), ids["handler_options"].alias("handler_options"),
        T.merged(T.merged(known, ids["own_metadata"]), F.col("found")).alias("metadata"), F.filter(F.array("warning"), lambda w: w.isNotNull()).alias("warnings"),
    )


def episode_paths(units: DataFrame, episodes: DataFrame, files: DataFrame) -> DataFrame:
    """Per episode (season_id, episode_id, episode_path) the paths to read: those of its units' files that are there, in order, else its own path if that is there."""
    there = files.select("path").distinct()
    chunks = units.filter("media_type = 'video'").join(there, "path", "left_semi").groupBy("season_id", "episode_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("unit_no", "path"))), lambda x: x["path"]).alias("paths"))
    own = there.select(F.col("path").alias("episode_path"), F.array("path").alias("own"))
    rows = episodes.select("season_id", "episode_id", "episode_path").distinct().join(chunks, ["season_id", "episode_id"], "left").join(own, "episode_path", "left")
    return rows.select("season_id", "episode_id", F.coalesce("paths", "own", F.array().cast("array<string>")).alias("paths"))


def uncovered(files: DataFrame, roots: DataFrame) -> DataFrame:
    """files (path) that no root (path) covers, by being it or a directory above it. Each path is joined by its own ancestors, never with all roots."""
    flat = lambda c: F.regexp_replace(F.translate(c, "\\", "/"), "/+$", "")
    parts = F.split(flat(F.col("path")), "/")
    above = files.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("_above"))
    shadowed = above.join(roots.select(flat(F.col("path")).alias("_above")).distinct(), "_above", "left_semi").select("path").distinct()
    return files.join(shadowed, "path", "left_anti")
