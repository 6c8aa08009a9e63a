"""Containers and books as rows: ZIP, CBZ and EPUB files of the binaryFile source, read entry by entry inside tasks.

A container is listed, its entries are checked and dealt a place by Spark's joins and windows, and then only the accepted ones are
read, each in blocks under a bound of its own, so a bomb is never unpacked. A container has few entries (checks reject
larger ones as a whole), so what is put together by container is bounded. Books add their package: container.xml,
manifest and spine become rows, and the order of chapters is a join of these.

Defined results: a null or broken container is one row with an error; nulls in entries don't occur.
"""

from __future__ import annotations

import hashlib
import io
import re
import stat
import zipfile
import zlib
from collections.abc import Iterator
from urllib.parse import unquote, urlsplit
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators.order import written
from tessera.sources import media, texts

#: Names and limits of the book format.
MIMETYPE, CONTAINER_XML, DRM = b"application/epub+zip", "META-INF/container.xml", ("meta-inf/encryption.xml", "meta-inf/rights.xml")
DOCUMENT_SUFFIXES, DOCUMENT_TYPES, DOCUMENT_BYTES = (".xhtml", ".html", ".htm"), ("application/xhtml+xml", "text/html"), 16 << 20
#: Folders of what is read, by medium.
FOLDERS = {"image": "images", "audio": "audio", "text": "text"}
ENTRY_BYTES, TOTAL_BYTES = 512 << 20, 4 << 30
STEP = 1 << 20
UNSAFE = re.compile(rb"<!\s*(?:DOCTYPE|ENTITY)\b", re.I)
ENCODING = re.compile(rb"encoding\s*=\s*['\"]([A-Za-z0-9._-]+)['\"]", re.I)
#: What a damaged container or entry raises.
DAMAGE = (zipfile.BadZipFile, zipfile.LargeZipFile, OSError, EOFError, NotImplementedError, RuntimeError, ValueError, zlib.error)

_LISTING = pa.schema([("path", pa.string()), ("pos", pa.int32()), ("entry", pa.string()), ("size", pa.int64()), ("packed", pa.int64()), ("encrypted", pa.bool_()), ("special", pa.bool_()), ("directory", pa.bool_())])


def _opened(content: bytes | None) -> tuple[zipfile.ZipFile | None, list[zipfile.ZipInfo]]:
    try:
        archive = zipfile.ZipFile(io.BytesIO(content or b""))
        return archive, archive.infolist()
    except DAMAGE:
        return None, []


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column("path"), batch.column("content")):
            archive, infos = _opened(content.as_py())
            rows = [{"path": path.as_py(), "pos": -1}] if archive is None else []
            for pos, e in enumerate(infos):
                kind = stat.S_IFMT(e.external_attr >> 16)
                rows.append({"path": path.as_py(), "pos": pos, "entry": e.filename, "size": e.file_size, "packed": e.compress_size, "encrypted": bool(e.flag_bits & 1), "special": not e.is_dir() and kind not in (0, stat.S_IFREG), "directory": e.is_dir()})
            yield pa.RecordBatch.from_pylist(rows, schema=_LISTING)


def listing(files: DataFrame) -> DataFrame:
    """files (path, content) as their entries: path, pos, entry, size, packed, encrypted, special, directory; pos -1 and no entry for a broken container."""
    return files.select("path", "content").mapInArrow(_listed, "path string, pos int, entry string, size long, packed long, encrypted boolean, special boolean, directory boolean")


def checked(files: DataFrame, **limits: int) -> DataFrame:
    """The listing of files with rejected: the code that rejects each entry, or null. limits: as of texts.checked_entries."""
    rows = written(listing(files), "listing")
    good = texts.checked_entries(rows.filter("pos >= 0"), **limits)
    return written(good.unionByName(rows.filter("pos < 0").withColumn("rejected", F.lit("container_invalid"))), "entries")


def materials(entries: DataFrame) -> DataFrame:
    """Checked entries of ZIP and CBZ files with their policy: path, pos, entry, media_type, content_form_hint, page_number, output, rejected.

    Directories go. Of a CBZ only images are taken, as pages in natural order; of others no containers, no videos, and only known media.
    """
    s, comic = media.suffix(F.col("entry")), media.suffix(F.col("path")) == ".cbz"
    kind = media.profile(F.col("entry"))
    policy = F.when(s.isin(*media.CONTAINERS), "nested_container_not_supported").when(comic & ~s.isin(*media.IMAGE), "cbz_entry_not_image").when(~comic & s.isin(*media.VIDEO), "container_video_requires_explicit_import")
    policy = policy.when(~comic & ~s.isin(*media.IMAGE, *media.AUDIO, *media.TEXT), "entry_suffix_unsupported")
    rows = entries.filter(~F.coalesce("directory", F.lit(False))).withColumn("rejected", F.coalesce("rejected", policy))
    taken = rows.filter("rejected is null")
    page = F.row_number().over(Window.partitionBy("path").orderBy(T.natural_key(F.col("entry")), "pos"))
    pages = taken.filter(comic).select("path", "pos", page.alias("page_number"))
    folder = F.lit(None).cast("string")
    for medium, name in FOLDERS.items():
        folder = F.when(kind["media_type"] == medium, name).otherwise(folder)
    flat = F.regexp_replace(F.translate("entry", "\\", "/"), "^/+|/+$", "")
    output = F.when(comic, F.concat(F.lit("images/pages/page_"), F.lpad(F.col("page_number").cast("string"), F.greatest(F.lit(4), F.length(F.col("page_number").cast("string"))), F.lit("0")), s)).otherwise(F.concat_ws("/", folder, flat))
    of_taken = lambda c: F.when(F.col("rejected").isNull(), c)
    return rows.join(pages, ["path", "pos"], "left").select("path", "pos", "entry", of_taken(kind["media_type"]).alias("media_type"), of_taken(F.when(comic, "manga").otherwise(kind["content_form_hint"])).alias("content_form_hint"), "page_number", of_taken(output).alias("output"), "rejected")


def _entry(archive: zipfile.ZipFile, info: zipfile.ZipInfo, most: int) -> bytes | None:
    """An entry's bytes, read in steps; null where it is damaged or larger than it may be."""
    try:
        with archive.open(info) as source:
            parts, size = [], 0
            while part := source.read(STEP):
                size += len(part)
                if size > most:
                    return None
                parts.append(part)
            return b"".join(parts)
    except DAMAGE:
        return None


_READ = pa.schema([("path", pa.string()), ("pos", pa.int32()), ("content", pa.binary()), ("size", pa.int64()), ("sha256", pa.string())])


def _reader(most: int, keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content, wanted in zip(batch.column("path"), batch.column("content"), batch.column("wanted")):
                archive, infos = _opened(content.as_py())
                for pos in wanted.as_py():
                    raw = _entry(archive, infos[pos], most) if archive and pos < len(infos) else None
                    row = {"path": path.as_py(), "pos": pos, "content": raw if keep else None, "size": None if raw is None else len(raw), "sha256": None if raw is None else hashlib.sha256(raw).hexdigest()}
                    # A batch an entry: a task holds one at a time.
                    yield pa.RecordBatch.from_pylist([row], schema=_READ)

    return run


def _with_wanted(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """files (path, content) that have wanted entries (path, pos), with their list."""
    return files.select("path", "content").join(wanted.groupBy("path").agg(F.array_sort(F.collect_list("pos")).alias("wanted")), "path")


def read(files: DataFrame, wanted: DataFrame, most: int = ENTRY_BYTES, keep: bool = True) -> DataFrame:
    """The wanted entries (path, pos) of files: path, pos, content (null without keep), size, sha256; nulls for one that can't be read within most bytes."""
    schema = "path string, pos int, content binary, size long, sha256 string"
    return _with_wanted(files, wanted).mapInArrow(_reader(most, keep), schema)


def extracted(files: DataFrame, **limits: int) -> DataFrame:
    """ZIP and CBZ files unpacked: the columns of materials, and content, size and sha256 of what was taken."""
    rows = written(materials(checked(files, **limits)), "materials")
    found = read(files, rows.filter("rejected is null"), limits.get("most_entry", ENTRY_BYTES))
    out = rows.join(found, ["path", "pos"], "left")
    failed = F.when(F.col("rejected").isNull() & F.col("size").isNull(), "entry_read_failed")
    of_read = lambda c: F.when(failed.isNull(), F.col(c)).alias(c)
    return out.select("path", "pos", "entry", of_read("media_type"), of_read("content_form_hint"), of_read("page_number"), of_read("output"), F.coalesce("rejected", failed).alias("rejected"), "content", "size", "sha256")


def resolved(folder: str, href: str) -> str | None:
    """A book's reference from a folder as a path in the container; null where it leaves it or is no path."""
    try:
        link = urlsplit(href)
    except ValueError:
        return None
    way = unquote(link.path).replace("\\", "/")
    if link.scheme or link.netloc or not way or way.startswith("/"):
        return None
    parts: list[str] = []
    for part in [*folder.split("/"), *way.split("/")]:
        if part == ".." and not parts:
            return None
        parts = parts[:-1] if part == ".." else parts if part in ("", ".") else [*parts, part]
    return "/".join(parts) or None


def _elements(raw: bytes | None) -> list[tuple[str, dict]] | None:
    """An XML document's elements, names in lower case and without namespaces; null where it is unsafe or malformed."""
    if raw is None or UNSAFE.search(raw):
        return None
    try:
        return [(str(e.tag).rpartition("}")[2].lower(), e.attrib) for e in ElementTree.fromstring(raw).iter()]
    except ElementTree.ParseError:
        return None


_PACKAGE = pa.schema([("path", pa.string()), ("kind", pa.string()), ("n", pa.int32()), ("id", pa.string()), ("entry", pa.string()), ("type", pa.string()), ("linear", pa.string())])


def _package(path: str, archive: zipfile.ZipFile, known: dict[str, zipfile.ZipInfo]) -> Iterator[dict]:
    """A book's metadata as rows: warnings, manifest items and spine references, in the order of the document."""
    say = lambda code, entry=None: {"path": path, "kind": "warning", "n": 0, "id": code, "entry": entry}
    small = lambda name, most: _entry(archive, known[name], most)
    if "mimetype" not in known:
        yield say("epub_mimetype_missing")
    elif (raw := small("mimetype", 1024)) is not None and raw.strip() != MIMETYPE:
        yield say("epub_mimetype_invalid", "mimetype")
    if CONTAINER_XML not in known:
        yield say("epub_opf_missing_fallback", CONTAINER_XML)
        return
    elements = _elements(small(CONTAINER_XML, DOCUMENT_BYTES))
    if elements is None:
        yield say("epub_container_metadata_invalid", CONTAINER_XML)
        return
    places = [p for tag, a in elements if tag == "rootfile" and (p := resolved("", a.get("full-path", "").strip()))]
    if not places or places[0] not in known:
        yield say("epub_opf_missing_fallback", places[0] if places else CONTAINER_XML)
        return
    elements = _elements(small(places[0], DOCUMENT_BYTES))
    if elements is None:
        yield say("epub_opf_invalid_fallback", places[0])
        return
    folder = places[0].rpartition("/")[0]
    yield {"path": path, "kind": "package", "n": 0, "entry": places[0]}
    for n, (tag, a) in enumerate(elements):
        if tag == "item":
            name, href = a.get("id", "").strip(), a.get("href", "").strip()
            entry = resolved(folder, href)
            yield {"path": path, "kind": "item", "n": n, "id": name, "entry": entry, "type": a.get("media-type", "").strip().lower()} if name and entry else say("epub_manifest_item_invalid", href or None)
        elif tag == "itemref":
            yield {"path": path, "kind": "itemref", "n": n, "id": a.get("idref", "").strip(), "linear": a.get("linear", "yes").lower()}


def _packages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content, wanted in zip(batch.column("path"), batch.column("content"), batch.column("wanted")):
            archive, infos = _opened(content.as_py())
            known = {infos[p].filename.replace("\\", "/"): infos[p] for p in wanted.as_py() if p < len(infos)}
            yield pa.RecordBatch.from_pylist(list(_package(path.as_py(), archive, known)) if archive else [], schema=_PACKAGE)


def _decoded(raw: bytes) -> str:
    if raw[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return raw.decode("utf-16", "replace")
    named = None if raw.startswith(b"\xef\xbb\xbf") else ENCODING.search(raw[:512])
    try:
        return raw.decode(named[1].decode() if named else "utf-8-sig")
    except (LookupError, UnicodeDecodeError):
        return raw.decode("utf-8", "replace").removeprefix("\ufeff")


_TEXTS = pa.schema([("path", pa.string()), ("pos", pa.int32()), ("text", pa.string()), ("title", pa.string()), ("state", pa.string()), ("malformed", pa.bool_())])


def _chapters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content, wanted in zip(batch.column("path"), batch.column("content"), batch.column("wanted")):
            archive, infos = _opened(content.as_py())
            for pos in wanted.as_py():
                raw, text, title, malformed = _entry(archive, infos[pos], DOCUMENT_BYTES) if archive and pos < len(infos) else None, None, None, None
                state = "read_failed" if raw is None else "unsafe_declaration" if UNSAFE.search(raw) else ""
                if not state:
                    page = _decoded(raw)
                    text, title = texts.xhtml(page)
                    try:
                        malformed = ElementTree.fromstring(page) is None
                    except (ElementTree.ParseError, ValueError):
                        malformed = True
                    state = "" if text else "empty"
                yield pa.RecordBatch.from_pylist([{"path": path.as_py(), "pos": pos, "text": text, "title": title, "state": state, "malformed": malformed}], schema=_TEXTS)


def _capped(rows: DataFrame, most: int) -> DataFrame:
    """rows (path, chapter, bytes) with fits: whether a text fits into what its book may still hold; one that doesn't takes nothing.

    A container's entries are bounded, and so is the list of a book's sizes.
    """
    sizes = rows.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("chapter", "bytes"))).alias("sizes"))

    def step(done: Column, x: Column) -> Column:
        fits = done["total"] + x["bytes"] <= most
        return F.struct((done["total"] + F.when(fits, x["bytes"]).otherwise(F.lit(0))).alias("total"), F.concat(done["fit"], F.array(F.struct(x["chapter"].alias("chapter"), fits.alias("fits")))).alias("fit"))

    none = F.struct(F.lit(0).cast("long").alias("total"), F.array().cast("array<struct<chapter:int,fits:boolean>>").alias("fit"))
    return sizes.select("path", F.explode(F.aggregate("sizes", none, step)["fit"]).alias("f")).select("path", "f.chapter", "f.fits")


def books(files: DataFrame, most_text: int = TOTAL_BYTES, **limits: int) -> tuple[DataFrame, DataFrame]:
    """EPUB files as chapters (path, chapter, entry, title, text, output, status, order) and warnings (path, code, entry).

    Chapters go in the order of the spine (items that aren't linear stay out, a repeated entry counts once), else of the manifest,
    else of the documents' paths: order says which. A book with DRM or encrypted entries, or rejected as a whole, has warnings alone.
    """
    entries = checked(files, **limits)
    say = lambda rows, code: rows.select("path", F.lit(code).alias("code") if isinstance(code, str) else code.alias("code"), F.col("entry").alias("entry"))
    rejected = say(entries.filter("rejected is not null"), F.when(F.col("rejected") == "container_invalid", "epub_container_invalid").otherwise(F.col("rejected")))
    locked = entries.filter("rejected = 'entry_encrypted'").select("path").distinct().withColumn("entry", F.lit(None).cast("string"))
    safe = entries.filter("rejected is null and not directory").withColumn("name", F.translate("entry", "\\", "/"))
    drm = safe.join(locked.select("path"), "path", "left_anti").filter(F.lower("name").isin(*DRM)).select("path").distinct().withColumn("entry", F.lit(None).cast("string"))
    closed = locked.select("path").union(drm.select("path"))
    safe = written(safe.join(closed, "path", "left_anti").select("path", "pos", "name"), "safe")
    package = _with_wanted(files, safe).mapInArrow(_packages, "path string, kind string, n int, id string, entry string, type string, linear string")
    package = written(package, "package")

    items = package.filter("kind = 'item'")
    is_document = F.col("type").isin(*DOCUMENT_TYPES) | media.suffix(F.col("entry")).isin(*DOCUMENT_SUFFIXES)
    # Of items with one id, the last counts.
    by_id = items.groupBy("path", "id").agg(F.max_by(F.struct("entry", "type"), "n").alias("i")).select("path", "id", "i.*")
    spine = package.filter("kind = 'itemref' and linear <> 'no'").select("path", "id", "n").join(by_id, ["path", "id"])
    no_spine = package.filter("kind = 'package'").join(spine.select("path").distinct(), "path", "left_anti").select("path", "entry")
    ordered = spine.select("path", "n", "entry", "type", F.lit("spine").alias("order")).unionByName(items.join(no_spine.select("path"), "path", "left_semi").select("path", "n", "entry", "type", F.lit("manifest").alias("order")))
    ordered = ordered.filter(is_document)
    missing = ordered.join(safe.select("path", F.col("name").alias("entry")), ["path", "entry"], "left_anti")
    no_package = safe.join(package.filter("kind = 'package'").select("path"), "path", "left_anti")
    fallback = no_package.filter(media.suffix(F.col("name")).isin(*DOCUMENT_SUFFIXES))
    firsts = ordered.groupBy("path", "entry", "order").agg(F.min("n").alias("n")).join(safe.select("path", F.col("name").alias("entry"), "pos"), ["path", "entry"])
    chosen = firsts.select("path", "pos", "entry", "order", F.struct(F.col("n").alias("n"), F.lit("").alias("key"), F.col("entry").alias("entry")).alias("at"))
    chosen = chosen.unionByName(fallback.select("path", "pos", F.col("name").alias("entry"), F.lit("path").alias("order"), F.struct(F.lit(0).alias("n"), F.lower("name").alias("key"), F.col("name").alias("entry")).alias("at")))
    chosen = written(chosen.withColumn("chapter", F.row_number().over(Window.partitionBy("path").orderBy("at"))).drop("at"), "chosen")

    # Entries are read and parsed in one worker: one that reads and hands on holds them twice.
    found = written(_with_wanted(files, chosen).mapInArrow(_chapters, "path string, pos int, text string, title string, state string, malformed boolean"), "texts")
    rows = chosen.join(found, ["path", "pos"]).withColumn("bytes", F.octet_length("text").cast("long") + 1)
    fits = _capped(rows.filter("state = ''").select("path", "chapter", "bytes"), most_text)
    rows = rows.join(fits, ["path", "chapter"], "left")
    status = F.when(F.col("state") != "", F.col("state")).when(~F.col("fits"), "size_limit_exceeded").otherwise("materialized")
    done = status == "materialized"
    chapters = rows.select("path", "chapter", "entry", "title", F.when(done, F.col("text")).alias("text"), F.when(done, F.format_string("text/chapters/chapter_%04d.txt", "chapter")).alias("output"), status.alias("status"), "order")
    codes = {"read_failed": "epub_entry_read_failed", "unsafe_declaration": "epub_xhtml_unsafe_declaration", "empty": "epub_chapter_empty", "size_limit_exceeded": "expanded_size_limit_exceeded"}
    code = F.lit(None).cast("string")
    for s, c in codes.items():
        code = F.when(F.col("status") == s, c).otherwise(code)
    whole = entries.select("path").distinct().join(closed, "path", "left_anti").join(entries.filter("rejected in ('container_invalid', 'entry_count_limit_exceeded', 'expanded_size_limit_exceeded')").select("path").distinct(), "path", "left_anti")
    unread = whole.join(chapters.filter("status = 'materialized'").select("path").distinct(), "path", "left_anti").withColumn("entry", F.lit(None).cast("string"))
    warnings = [
        rejected, say(locked, "epub_encryption_unsupported"), say(drm, "epub_drm_unsupported"), say(package.filter("kind = 'warning'"), F.col("id")), say(no_spine, "epub_spine_missing_fallback"), say(missing, "epub_spine_entry_missing"),
        say(fallback.select("path").distinct().withColumn("entry", F.lit(None).cast("string")), "epub_document_order_fallback"), say(chapters, code).filter("code is not null"), say(rows.filter("malformed"), "epub_xhtml_malformed_fallback"), say(unread, "epub_no_readable_chapters"),
    ]
    out = warnings[0]
    for one in warnings[1:]:
        out = out.unionByName(one)
    return chapters, out
