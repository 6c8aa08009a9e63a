"""What a file's suffix says of it: medium, support, container format; and what a collection of files is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Suffixes of each medium, static images, subtitles that are read and that are not, and archives of comics.
VIDEO = (".mp4", ".mkv", ".mov", ".avi", ".webm", ".flv", ".wmv", ".m4v")
IMAGE = (".png", ".jpg", ".jpeg", ".webp", ".bmp", ".gif")
STATIC_IMAGE = (".png", ".jpg", ".jpeg", ".webp")
AUDIO = (".wav", ".mp3", ".m4a", ".aac", ".flac", ".ogg", ".opus", ".wma")
TIMED_TEXT = (".srt", ".ass")
OTHER_TIMED_TEXT = (".vtt", ".lrc")
TEXT = (".txt", ".md", ".json", *TIMED_TEXT, *OTHER_TIMED_TEXT)
COMIC_ARCHIVE = (".cbz", ".cbr", ".zip", ".rar", ".7z")
#: Container formats by suffix: tools, key of the preprocessor, key of the name.
CONTAINERS = {
    ".zip": ("standard_library_zip", "zip", "project.inputFormat.zip"),
    ".cbz": ("standard_library_zip", "cbz", "project.inputFormat.cbz"),
    ".epub": ("standard_library_zip", "epub", "project.inputFormat.epub"),
    ".pdf": ("pdf", "pdf", "project.inputFormat.pdf"),
    ".7z": ("archive", "archive", "project.inputFormat.7z"),
    ".rar": ("archive", "archive", "project.inputFormat.rar"),
    ".cbr": ("archive", "archive", "project.inputFormat.cbr"),
}
MEDIA = ("video", "image", "audio", "text")

_PROFILE = "struct<media_type:string,content_form_hint:string,import_supported:boolean,preview_support:string,formal_support:string,reason:string>"


def _profile(media: str | None, form: str, imported: bool, support: str, reason: str = "") -> Column:
    return F.struct(F.lit(media), F.lit(form), F.lit(imported), F.lit(support), F.lit(support), F.lit(reason)).cast(_PROFILE)


#: Profiles by suffix, the first that fits.
PROFILES = (
    (VIDEO, ("video", "unknown", True, "supported")),
    ((".gif",), ("image", "unknown", True, "unsupported", "animated_image_not_supported")),
    ((".bmp",), ("image", "unknown", True, "unsupported", "bmp_image_not_supported")),
    (IMAGE, ("image", "unknown", True, "supported")),
    (AUDIO, ("audio", "unknown", True, "supported", "transcript_required")),
    (TIMED_TEXT, ("text", "script", True, "supported")),
    ((".vtt",), ("text", "script", True, "unsupported", "vtt_timed_text_not_supported")),
    ((".lrc",), ("text", "script", True, "unsupported", "lrc_timed_text_not_supported")),
    ((".json",), ("text", "unknown", True, "planned", "controlled_json_only")),
    (TEXT, ("text", "unknown", True, "planned")),
    (COMIC_ARCHIVE, (None, "unknown", False, "unsupported", "comic_archive_not_supported")),
)


def suffix(path: Column) -> Column:
    """The lower-case suffix of the last path part, dot included; empty where there is none."""
    return F.lower(F.regexp_extract(path, r"[^/\\](\.[^./\\]+)$", 1))


def _known(path: Column, values: dict[str, Column]) -> Column:
    """The value of a path's suffix, which is worked out once and looked up; null for others."""
    return F.try_element_at(F.create_map(*[x for s, v in values.items() for x in (F.lit(s), v)]), suffix(path))


#: The first profile that fits each suffix.
_BY_SUFFIX = {s: values for suffixes, values in reversed(PROFILES) for s in suffixes}


def profile(path: Column) -> Column:
    """(media_type, content_form_hint, import_supported, preview_support, formal_support, reason) of a path or suffix."""
    # A suffix alone becomes a path of that suffix.
    named = F.when(F.rlike(path, F.lit(r"^\.[^./\\]+$")), F.concat(F.lit("_"), path)).otherwise(path)
    other = F.when(suffix(named) == "", _profile(None, "unknown", True, "unsupported", "extensionless_source_unclassified")).otherwise(_profile(None, "unknown", False, "unsupported", "unknown_source_suffix"))
    return F.coalesce(_known(named, {s: _profile(*v) for s, v in _BY_SUFFIX.items()}), other)


def medium(path: Column) -> Column:
    """video, image, audio or text by suffix, else null."""
    return profile(path)["media_type"]


def container(path: Column) -> Column:
    """(suffix, toolchain, state, preprocessor_key, display_name_key) of a container format, else null."""
    row = lambda name, tools, key, label: F.struct(F.lit(name).alias("suffix"), F.lit(tools).alias("toolchain"), F.lit("enabled").alias("state"), F.lit(key).alias("preprocessor_key"), F.lit(label).alias("display_name_key"))
    return _known(path, {name: row(name, *values) for name, values in CONTAINERS.items()})


def project_input(path: Column) -> Column:
    """Whether a project takes a file: one that can be imported, or a container that is unpacked first."""
    return profile(path)["import_supported"] | container(path).isNotNull()


def collections(files: DataFrame, key: str, path: str) -> DataFrame:
    """Per collection: n, media (in fixed order), hint (mixed, image_set, script or unknown) and the paths that can't be imported, sorted."""
    p = files.select(key, F.col(path).alias("path"), profile(F.col(path)).alias("p"))
    counts = p.groupBy(key).agg(
        F.count("*").alias("n"),
        F.collect_set("p.media_type").alias("kinds"),
        F.bool_and(F.col("p.content_form_hint") == "script").alias("script"),
        F.array_sort(F.collect_list(F.when(~F.col("p.import_supported"), F.col("path")))).alias("unsupported"),
    )
    media = F.filter(F.array(*[F.lit(m) for m in MEDIA]), lambda m: F.array_contains("kinds", m))
    only = lambda m: (F.size(media) == 1) & (F.get(media, F.lit(0)) == m)
    hint = F.when(F.size(media) > 1, "mixed").when(only("image") & (F.col("n") > 1), "image_set").when(only("text") & F.col("script"), "script").otherwise("unknown")
    return counts.select(key, "n", F.array_join(media, ",").alias("media"), hint.alias("hint"), F.array_join("unsupported", ",").alias("unsupported"))
