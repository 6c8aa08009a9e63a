"""Contents of files: decoded text, XHTML, transcripts, images and checks of containers. Python reads one file at a time inside tasks."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from html.parser import HTMLParser
from itertools import accumulate

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tessera.sources import media

#: Encodings in order of trial.
ENCODINGS = ("utf-8-sig", "utf-8", "gb18030", "shift_jis")
#: Elements of XHTML for the head and title, without text, annotations, and blocks.
HEAD, TITLE = frozenset(["head"]), frozenset(["title"])
SKIPPED = frozenset("script style svg math".split())
RUBY = frozenset("rt rp".split())
BLOCKS = frozenset("address article aside blockquote dd div dl dt figcaption figure footer h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split())
#: File names that a system keeps for devices.
RESERVED = ("CON", "PRN", "AUX", "NUL", *(f"{d}{i}" for d in ("COM", "LPT") for i in range(1, 10)))
IMAGE_BYTES = 20 << 20


def decode(raw: bytes, path: str) -> tuple[str | None, str | None, str | None, str | None]:
    """text, encoding, warning, error of a text file; JSON is laid out anew with sorted keys, its top an object or a list."""
    for encoding in ENCODINGS:
        try:
            text = raw.decode(encoding)
            break
        except UnicodeDecodeError:
            continue
    else:
        return None, None, None, "text_encoding_unsupported"
    warning = None if encoding.startswith("utf-8") else f"text_decoded_with_fallback:{encoding}"
    if path.lower().endswith(".json"):
        try:
            value = json.loads(text)
        except (ValueError, RecursionError):
            return None, encoding, warning, "controlled_json_invalid"
        if not isinstance(value, (dict, list)):
            return None, encoding, warning, "controlled_json_scalar"
        text = json.dumps(value, ensure_ascii=False, indent=2, sort_keys=True)
    return text, encoding, warning, None


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [decode(raw or b"", path or "") for path, raw in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column("path"), *[pa.array([r[i] for r in rows], pa.string()) for i in range(4)]], names=["path", "text", "encoding", "warning", "error"])


def decoded(files: DataFrame) -> DataFrame:
    """files (path, content) as path, text, encoding, warning, error."""
    return files.select("path", "content").mapInArrow(_decoded, "path string, text string, encoding string, warning string, error string")


class _Events(HTMLParser):
    """A page as a table of events (step, tag, text): 1 opens the tag, -1 closes it, 0 is text or an image's alternative text."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[tuple[int, str, str]] = []

    def handle_starttag(self, tag, attrs):
        self.rows.append((1, tag, ""))
        if tag == "img":
            self.rows.append((0, tag, (dict(attrs).get("alt") or "").strip()))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.rows.append((-1, tag, ""))

    def handle_data(self, data):
        self.rows.append((0, "", data))

    def parse_marked_section(self, i, report=1):
        """A declaration that the parser gives up on ends at its bracket, and the page goes on."""
        try:
            return super().parse_marked_section(i, report)
        except AssertionError:
            return self.rawdata.find(">", i) + 1 or -1


def _inside(rows: list[tuple[int, str, str]], tags: frozenset) -> list[bool]:
    """Whether each event lies in an element of these tags. What closes more than is open counts for nothing."""
    return [n > 0 for n in accumulate((step * (tag in tags) for step, tag, _ in rows), lambda n, step: max(0, n + step))]


def tidy(text: str) -> str:
    """Blanks within lines as one, lines trimmed, runs of empty lines as one."""
    lines = [re.sub(r"[ \t\f\v]+", " ", x).strip() for x in text.replace("\r\n", "\n").replace("\r", "\n").replace("\xa0", " ").split("\n")]
    return "\n".join(x for i, x in enumerate(lines) if x or i and lines[i - 1]).strip()


def xhtml(page: str | None) -> tuple[str, str]:
    """text and title of a page."""
    events = _Events()
    events.feed(page or "")
    events.close()
    rows, text, title = events.rows, [], []
    for (step, tag, said), head, named, skipped, ruby in zip(rows, *(_inside(rows, t) for t in (HEAD, TITLE, SKIPPED, RUBY))):
        if step:
            text.append("\n" if tag in BLOCKS or tag == "br" and step > 0 else "")
        elif tag:
            text.append(f"\n[Image: {said}]\n" if said and not (head or skipped) else "")
        else:
            title.append(said if named else "")
            text.append("" if head or skipped or ruby else said)
    return tidy("".join(text)), tidy("".join(title)).replace("\n", " ")


def _pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [xhtml(x) for x in batch.column("xhtml").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("path"), *[pa.array([r[i] for r in rows], pa.string()) for i in range(2)]], names=["path", "text", "title"])


def xhtml_texts(pages: DataFrame) -> DataFrame:
    """pages (path, xhtml) as path, text, title: no scripts or annotations, a line for each block, images by their alternative text."""
    return pages.select("path", "xhtml").mapInArrow(_pages, "path string, text string, title string")


def _offset(value: Column) -> Column:
    """Seconds of a number; above 1,000 it counts milliseconds."""
    n = value.try_cast("double")
    return F.when(n > 1000, n / 1000).otherwise(n)


def _stamp(value: Column) -> Column:
    """Seconds of h:m:s, m:s or s with a fraction."""
    parts = F.split(F.replace(F.trim(value), F.lit(","), F.lit(".")), ":")
    n = F.transform(parts, lambda p: p.try_cast("double"))
    good = (F.size(parts) <= 3) & F.forall(n, lambda x: x.isNotNull())
    return F.when(good, F.aggregate(n, F.lit(0.0), lambda a, x: a * 60 + x))


def transcripts(files: DataFrame) -> DataFrame:
    """files (path, json) of recognised speech as path, segment, start, end, text: by timestamps, else offsets, else start and end, else t0 and t1."""
    one = "struct<text:string,timestamps:struct<from:string,to:string>,offsets:struct<from:double,to:double>,start:double,end:double,t0:double,t1:double>"
    parsed = files.select("path", F.from_json("json", f"struct<transcription:array<{one}>,segments:array<{one}>>").alias("j"))
    rows = parsed.select("path", F.posexplode(F.coalesce("j.transcription", "j.segments")).alias("pos", "s")).withColumn("text", F.trim("s.text")).filter("text <> ''")
    pair = lambda start, end: F.when(start.isNotNull() | end.isNotNull(), F.struct(F.coalesce(start, F.lit(0.0)).alias("start"), F.coalesce(F.when(end != 0, end), start, F.lit(0.0)).alias("end")))
    s = lambda c: F.col(f"s.{c}")
    plain = (F.coalesce(_offset(s("start")), _offset(s("t0"))), F.coalesce(_offset(s("end")), _offset(s("t1"))))
    found = F.coalesce(pair(_stamp(s("timestamps.from")), _stamp(s("timestamps.to"))), pair(_offset(s("offsets.from")), _offset(s("offsets.to"))), pair(*plain), F.struct(F.lit(0.0).alias("start"), F.lit(0.0).alias("end")))
    return rows.withColumn("f", found).select("path", F.row_number().over(_by_path()).alias("segment"), F.col("f.start").alias("start"), F.col("f.end").alias("end"), "text")


def _by_path():
    from pyspark.sql import Window

    return Window.partitionBy("path").orderBy("pos")


def images(files: DataFrame, most: int = IMAGE_BYTES) -> DataFrame:
    """files (path, content) of images as path, mime, bytes, width, height (of PNG), error."""
    c, s = F.col("content"), media.suffix(F.col("path"))
    starts = lambda hexes: F.startswith(F.hex(F.substring(c, 1, 16)), F.lit(hexes))
    webp = starts("52494646") & (F.hex(F.substring(c, 9, 4)) == "57454250")
    right = F.when(s == ".png", starts("89504E470D0A1A0A")).when(s.isin(".jpg", ".jpeg"), starts("FFD8FF")).when(s == ".webp", webp)
    n = F.coalesce(F.octet_length(c), F.lit(0))
    error = F.when(right.isNull() & ~s.isin(*media.STATIC_IMAGE), "image_suffix_unsupported").when(n > most, "image_too_large").when(n == 0, "image_empty").when(~right, "image_signature_mismatch")
    size = lambda at: F.when((s == ".png") & (n >= 24) & error.isNull(), F.conv(F.hex(F.substring(c, at, 4)), 16, 10).cast("int"))
    mime = F.when(s == ".png", "image/png").when(s.isin(".jpg", ".jpeg"), "image/jpeg").when(s == ".webp", "image/webp")
    return files.select("path", F.when(error.isNull(), mime).alias("mime"), n.alias("bytes"), size(17).alias("width"), size(21).alias("height"), error.alias("error"))


def normal_path(path: str) -> str:
    """A container's path in composed form without case, by which entries collide."""
    return unicodedata.normalize("NFC", path.replace("\\", "/")).casefold()


def unsafe_path(entry: Column) -> Column:
    """Whether an entry's path is empty, absolute, of a drive, climbs, or has a part that some system can't hold."""
    flat = F.translate(entry, "\\", "/")
    parts = F.split(flat, "/")
    bad = F.exists(parts, lambda p: p.isin("", ".", "..") | F.rlike(p, F.lit(r"[. ]$|:|[\x00-\x1f]")) | F.upper(F.regexp_extract(p, r"^([^.]*)", 1)).isin(*RESERVED))
    return F.coalesce((entry == "") | bad, F.lit(True))


def checked_entries(entries: DataFrame, most_entries: int = 4096, most_bytes: int = 4 << 30, most_entry: int = 512 << 20, most_ratio: int = 200) -> DataFrame:
    """entries of containers with the code that rejects each, or null; a container with too many entries or bytes rejects all of its own.

    entries: path (container), pos, entry, size, packed, encrypted, special, directory. Of entries that collide, the first passes.
    """
    sums = entries.groupBy("path").agg(F.count("*").alias("_n"), F.sum(F.when(~F.col("directory"), F.col("size"))).alias("_bytes"))
    rows = entries.join(sums, "path")
    candidate = F.when(F.col("directory"), F.regexp_replace("entry", r"[/\\]+$", "")).otherwise(F.col("entry"))
    whole = F.when(F.col("_n") > most_entries, "entry_count_limit_exceeded").when(F.col("_bytes") > most_bytes, "expanded_size_limit_exceeded")
    own = F.when(unsafe_path(candidate), "entry_path_unsafe").when(F.col("directory"), None).when(F.col("special"), "entry_type_unsupported").when(F.col("encrypted"), "entry_encrypted")
    own = own.when(F.col("size") > most_entry, "entry_size_limit_exceeded").when(F.col("size") / F.greatest("packed", F.lit(1)) > most_ratio, "compression_ratio_limit_exceeded")
    rows = rows.withColumn("_code", F.coalesce(whole, own)).withColumn("_key", _keys(F.regexp_replace("entry", r"[/\\\\]+$", "")))
    met = _met(rows.filter("_code is null and not directory").select("path", "pos", "_key"))
    rows = rows.join(met.withColumn("_met", F.lit(True)), ["path", "pos"], "left")
    return rows.select(*entries.columns, F.coalesce("_code", F.when(F.col("_met"), "entry_path_collision")).alias("rejected"))


@F.pandas_udf(StringType())
def _keys(entries: pd.Series) -> pd.Series:
    return entries.map(normal_path, na_action="ignore")


def _met(rows: DataFrame) -> DataFrame:
    """The entries (path, pos) of rows (path, pos, _key) that collide with an earlier one that passes: the same path, or one inside the other.

    Only entries that meet any other at all are folded, in order; a container has few.
    """
    parts = F.split("_key", "/")
    above = rows.select("path", F.col("pos").alias("low"), F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("_key"))
    pairs = above.join(rows, ["path", "_key"]).filter("low <> pos")
    some = pairs.select("path", "pos").union(pairs.select("path", F.col("low").alias("pos"))).distinct()
    lists = rows.join(some, ["path", "pos"]).groupBy("path").agg(F.array_sort(F.collect_list(F.struct(F.col("pos").cast("long").alias("pos"), "_key"))).alias("e"))

    def step(done: Column, x: Column) -> Column:
        key = x["_key"]
        meets = F.exists(done["kept"], lambda k: (k == key) | F.startswith(k, F.concat(key, F.lit("/"))) | F.startswith(key, F.concat(k, F.lit("/"))))
        return F.struct(F.when(meets, done["kept"]).otherwise(F.concat(done["kept"], F.array(key))).alias("kept"), F.when(meets, F.concat(done["met"], F.array(x["pos"]))).otherwise(done["met"]).alias("met"))

    none = F.struct(F.array().cast("array<string>").alias("kept"), F.array().cast("array<bigint>").alias("met"))
    return lists.select("path", F.explode(F.aggregate("e", none, step)["met"]).alias("pos"))
