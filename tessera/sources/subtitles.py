"""Subtitles as tables: cues of SRT and ASS files, the rendered document, and chunks of cues with their time and place."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T

_CLOCK = r"(\d{1,2}):(\d{2}):(\d{2})[,.](\d{1,3})"
SRT_TIME = re.compile(rf"\s*{_CLOCK}\s*-->\s*{_CLOCK}(?:\s.*)?$")
#: What a line ends with, as Python's splitlines has it.
LINE_END = r"\r\n|[\n\x0B\x0C\r\x1C-\x1E\x{85}\x{2028}\x{2029}]"


def srt(text: str) -> Iterator[tuple]:
    """(line, start, end, text, raw, speaker, None) for each cue, and (line, ..., warning) for what is skipped."""
    block: list[tuple[int, str]] = []
    for number, line in [*enumerate(text.splitlines(), 1), (0, "")]:
        if line.strip():
            block.append((number, line))
            continue
        if not block:
            continue
        first = block[0][0]
        if block[0][1].strip().isdigit() and len(block) > 1:
            block = block[1:]
        at, timing = block[0]
        raw = "\n".join(x for _, x in block[1:]).strip()
        found, block = SRT_TIME.match(timing), []
        if not found:
            yield first, None, None, None, None, None, f"srt_cue_skipped:line={first}"
            continue
        h1, m1, s1, f1, h2, m2, s2, f2 = map(int, found.groups())
        start, end = (h1 * 60 + m1) * 60 + s1 + f1 / 1000, (h2 * 60 + m2) * 60 + s2 + f2 / 1000
        plain = re.sub(r"<[^>]+>", "", html.unescape(raw)).strip()
        if plain:
            yield at, start, max(start, end), plain, raw, "", None
        else:
            yield at, None, None, None, None, None, f"srt_empty_cue_skipped:line={at}"


_ROWS = pa.schema([("path", pa.string()), ("format", pa.string()), ("cue", pa.int32()), ("source_line", pa.int32()), ("start", pa.float64()), ("end", pa.float64()), ("text", pa.string()), ("raw", pa.string()), ("speaker", pa.string()), ("warning", pa.string())])


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, text in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist()):
            kind = (path or "").rpartition(".")[2].lower()
            rows, cue = [], 0
            for line, *rest, warning in srt(text or "") if kind == "srt" else [(None, None, None, None, None, None, "timed_text_format_not_supported")]:
                cue += warning is None
                rows.append((path, kind, cue if warning is None else None, line, *rest, warning))
            if not cue and kind == "srt":
                rows.append((path, kind, None, None, None, None, None, None, None, "srt_no_usable_segments"))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ROWS.types)], schema=_ROWS)


def _clock(value: Column) -> Column:
    """Seconds of h:m:s with hundredths (the first three digits of a fraction count in these); null for anything else."""
    found = lambda i: F.regexp_extract(value, r"^\s*([+-]?[0-9]+)\s*:\s*([+-]?[0-9]+)\s*:\s*([+-]?[0-9]+)\s*(?:[.,]([0-9]{0,2}$|[0-9]{3}).*)?$", i)
    hours, minutes, whole = (found(i).try_cast("double") for i in (1, 2, 3))
    return hours * 3600 + minutes * 60 + whole + F.coalesce(found(4).try_cast("double"), F.lit(0.0)) / 100


def _ass(files: DataFrame) -> DataFrame:
    """The dialogues of ASS files: lines explode, and a line's section and format are the last ones before it in its file."""
    lines = files.select("path", F.posexplode(F.split(F.coalesce("text", F.lit("")), LINE_END)).alias("n", "line")).select("path", (F.col("n") + 1).alias("source_line"), T.strip(F.col("line")).alias("line"))
    before = Window.partitionBy("path").orderBy("source_line").rowsBetween(Window.unboundedPreceding, 0)
    is_header = F.startswith("line", F.lit("[")) & F.endswith("line", F.lit("]"))
    lines = lines.withColumn("section", F.last(F.when(is_header, F.lower("line")), ignorenulls=True).over(before)).filter((F.col("section") == "[events]") & ~is_header & F.contains("line", F.lit(":")))
    lines = lines.select("path", "source_line", F.lower(T.strip(F.substring_index("line", ":", 1))).alias("key"), F.expr("substr(line, instr(line, ':') + 1)").alias("value"))
    names = F.transform(F.split("value", ","), lambda x: F.lower(T.strip(x)))
    lines = lines.withColumn("names", F.last(F.when(F.col("key") == "format", names), ignorenulls=True).over(before)).filter("key = 'dialogue'")
    lines = lines.withColumn("fields", F.split(F.regexp_replace("value", f"^{T.BLANK}+", ""), ",", F.size("names")))
    # Of fields with one name, the last counts.
    field = lambda n: F.coalesce(F.get(F.reverse("fields"), F.array_position(F.reverse("names"), n).cast("int") - 1), F.lit(""))
    rows = lines.withColumns({"start": _clock(field("start")), "stop": _clock(field("end")), "raw": T.strip(field("text")), "speaker": T.strip(field("name"))})
    plain = F.regexp_replace("raw", r"\{[^{}]*\}", "")
    for mark, shown in (("\\N", "\n"), ("\\n", "\n"), ("\\h", " ")):
        plain = F.replace(plain, F.lit(mark), F.lit(shown))
    rows = rows.withColumn("text", T.strip(plain))
    why = F.when(F.col("names").isNull(), "ass_dialogue_skipped_without_format").when(F.size("fields") != F.size("names"), "ass_dialogue_field_mismatch").when(F.col("start").isNull() | F.col("stop").isNull(), "ass_dialogue_time_invalid").when(F.col("text") == "", "ass_empty_dialogue_skipped")
    rows = rows.withColumn("why", why)
    cue = F.when(F.col("why").isNull(), F.sum(F.col("why").isNull().cast("int")).over(before).cast("int"))
    good = lambda c: F.when(F.col("why").isNull(), c)
    out = rows.select("path", F.lit("ass").alias("format"), cue.alias("cue"), "source_line", good(F.col("start")).alias("start"), good(F.greatest("start", "stop")).alias("end"), good(F.col("text")).alias("text"), good(F.col("raw")).alias("raw"), good(F.col("speaker")).alias("speaker"), F.concat("why", F.lit(":line="), F.col("source_line").cast("string")).alias("warning"))
    empty = files.select("path").join(rows.filter("why is null").select("path").distinct(), "path", "left_anti")
    none = [F.lit(None).cast(t).alias(c) for c, t in (("cue", "int"), ("source_line", "int"), ("start", "double"), ("end", "double"), ("text", "string"), ("raw", "string"), ("speaker", "string"))]
    return out.unionByName(empty.select("path", F.lit("ass").alias("format"), *none, F.lit("ass_no_usable_segments").alias("warning")))


def cues(files: DataFrame) -> DataFrame:
    """files (path, text) as rows (path, format, cue, source_line, start, end, text, raw, speaker, warning), by the format of the suffix.

    A cue has a number from 1 and no warning; what is skipped has a warning and no number. A null text has no cue.
    """
    is_ass = F.lower(F.substring_index("path", ".", -1)) == "ass"
    schema = "path string, format string, cue int, source_line int, start double, end double, text string, raw string, speaker string, warning string"
    others = files.filter(~F.coalesce(is_ass, F.lit(False))).select("path", "text").mapInArrow(_parsed, schema)
    return others.unionByName(_ass(files.filter(is_ass).select("path", "text")))


def document(rows: DataFrame) -> DataFrame:
    """cues() with rendered (place, time and speaker before the text) and its start and stop in the file's document.

    The running sum goes over the cues of one file.
    """
    speaker = F.coalesce(F.when(F.col("speaker") != "", F.col("speaker")), F.lit("unknown"))
    head = F.concat_ws(" ", F.concat(F.lit("cue="), F.col("cue").cast("string")), F.concat(F.lit("line="), F.col("source_line").cast("string")), F.concat(F.lit("time="), T.clock(F.col("start")), F.lit("-"), T.clock(F.col("end"))), F.concat(F.lit("speaker="), speaker))
    c = rows.filter("cue is not null").withColumn("rendered", F.concat(F.lit("["), head, F.lit("]\n"), F.col("text")))
    # One line break parts a cue from the one before it.
    before = F.coalesce(F.sum(F.length("rendered") + 1).over(Window.partitionBy("path").orderBy("cue").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return c.withColumn("start_offset", before.cast("int")).withColumn("end_offset", (before + F.length("rendered")).cast("int"))


def packed(rows: DataFrame, size: int = 12_000, most: int = 128) -> DataFrame:
    """document() rows with chunk, from 1: cues in order while they fit in size characters; those after most chunks have null.

    One fold over the cues of a file: a chunk's end depends on where it began.
    """
    entry = F.struct("cue", "start_offset", "end_offset")
    start = F.struct(F.lit(0).alias("chunk"), F.lit(0).alias("at"), F.array().cast("array<struct<cue:int,chunk:int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        fresh = (acc["chunk"] == 0) | (x["end_offset"] - acc["at"] > size)
        chunk = acc["chunk"] + fresh.cast("int")
        row = F.struct(x["cue"].alias("cue"), F.when(chunk <= most, chunk).alias("chunk"))
        return F.struct(chunk.alias("chunk"), F.when(fresh, x["start_offset"]).otherwise(acc["at"]).alias("at"), F.concat(acc["out"], F.array(row)).alias("out"))

    of = rows.groupBy("path").agg(F.array_sort(F.collect_list(entry)).alias("all")).select("path", F.explode(F.aggregate("all", start, step)["out"]).alias("p")).select("path", "p.cue", "p.chunk")
    return rows.join(of, ["path", "cue"])


def chunk_places(rows: DataFrame) -> DataFrame:
    """packed() rows as chunks: start of the first cue, latest end, offsets, number of cues and the locator of lines and time."""
    c = rows.filter("chunk is not null").groupBy("path", "chunk").agg(
        F.min_by("start", "cue").alias("start"), F.max("end").alias("end"), F.min("start_offset").alias("start_offset"), F.max("end_offset").alias("end_offset"), F.count("*").alias("cues"), F.min_by("source_line", "cue").alias("first_line"), F.max_by("source_line", "cue").alias("last_line")
    )
    lines = F.concat(F.lit("lines="), F.col("first_line").cast("string"), F.lit("-"), F.col("last_line").cast("string"))
    time = F.format_string("time=%.3f-%.3f", "start", "end")
    return c.withColumn("locator", F.concat_ws(";", lines, time))


def pack_warnings(rows: DataFrame, size: int = 12_000, most: int = 128) -> DataFrame:
    """What packing had to say of each file: cues larger than a chunk, chunks beyond the limit, and how many chunks there are."""
    large = rows.filter((F.col("end_offset") - F.col("start_offset")) > size).select("path", F.concat(F.lit("timed_text_segment_exceeds_budget:line="), F.col("source_line").cast("string"), F.lit(":chars="), (F.col("end_offset") - F.col("start_offset")).cast("string")).alias("warning"))
    sums = rows.groupBy("path").agg(F.max("chunk").alias("n"), F.sum(F.col("chunk").isNull().cast("int")).alias("left"))
    limit = F.concat(F.lit(f"timed_text_chunk_limit_reached:max_chunks={most}:remaining_segments="), F.col("left").cast("string"))
    told = F.when(F.col("left") > 0, limit).when(F.col("n") > 1, F.concat(F.lit("timed_text_split_into_chunks:count="), F.col("n").cast("string")))
    return large.union(sums.select("path", told.alias("warning")).filter("warning is not null"))
