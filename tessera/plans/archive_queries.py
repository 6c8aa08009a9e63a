"""Queries of containers and books that Spark packs from documents, each beside its SQL."""

from __future__ import annotations

import html
import io
import zipfile
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.order import written
from tessera.plans.registry import query
from tessera.sources import archives

#: Documents of a container.
PER = 8
_ODD = r"[\x00-\x20\x7F-\x{A0}\x{1680}\x{2000}-\x{200F}\x{2028}-\x{202F}\x{205F}\x{3000}\x{FEFF}]+"
_FLAT_SQL = r"trim(regexp_replace(coalesce(text, ''), '[\x00-\x20\x7F-\x{A0}\x{1680}\x{2000}-\x{200F}\x{2028}-\x{202F}\x{205F}\x{3000}\x{FEFF}]+', ' ', 'g'))"


def _packed(entries: Callable[[list[tuple]], list[tuple[str, str]]]):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        rows = sorted(zip(table.column("doc_id").to_pylist(), table.column("text").to_pylist()))
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
            for name, content in entries(rows):
                z.writestr(zipfile.ZipInfo(name), content)
        return pa.table({"path": [key[0].as_py()], "content": pa.array([out.getvalue()], pa.binary())})

    return run


def _containers(docs: DataFrame, path: str, entries: Callable) -> DataFrame:
    block = F.floor(F.col("doc_id") / PER)
    # Written, as files would be: what reads them several times doesn't pack them again, and holds no packer's worker beside its own.
    return written(docs.select(F.format_string(path, block).alias("path"), "doc_id", "text").groupBy("path").applyInArrow(_packed(entries), "path string, content binary"), "files")


def _mixed(rows: list[tuple]) -> list[tuple[str, str]]:
    comic = rows[0][0] // PER % 3 == 0
    out = []
    for i, text in rows:
        name = f"p{i}.png" if comic else f"d{i}.txt"
        name = f"x{i}.zip" if i % 7 == 0 else f"../{i}.txt" if i % 11 == 0 else f"m{i}.mp4" if i % 13 == 0 else name
        out += [(name, text or ""), *[(name.upper(), "")] * (i % 5 == 0)]
    return out


@query("s22_extracted", f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, doc_id // {PER} AS b, (doc_id // {PER}) % 3 = 0 AS comic FROM documents),
n AS (SELECT *, CASE WHEN doc_id % 7 = 0 THEN 'x' || doc_id || '.zip' WHEN doc_id % 11 = 0 THEN '../' || doc_id || '.txt' WHEN doc_id % 13 = 0 THEN 'm' || doc_id || '.mp4' WHEN comic THEN 'p' || doc_id || '.png' ELSE 'd' || doc_id || '.txt' END AS entry FROM d),
e AS (SELECT *, printf('box_%06d', b) || CASE WHEN comic THEN '.cbz' ELSE '.zip' END AS path, CASE WHEN doc_id % 7 = 0 THEN 'nested_container_not_supported' WHEN doc_id % 11 = 0 THEN 'entry_path_unsafe' WHEN comic AND doc_id % 13 = 0 THEN 'cbz_entry_not_image' WHEN doc_id % 13 = 0 THEN 'container_video_requires_explicit_import' END AS code FROM n),
p AS (SELECT doc_id, row_number() OVER (PARTITION BY path ORDER BY doc_id) AS page FROM e WHERE comic AND code IS NULL)
SELECT path, entry, code AS rejected, CASE WHEN code IS NULL AND comic THEN printf('images/pages/page_%04d.png', page) WHEN code IS NULL THEN 'text/' || entry END AS output, CASE WHEN code IS NULL THEN strlen(text)::BIGINT END AS size, CASE WHEN code IS NULL THEN sha256(text) END AS sha256 FROM e LEFT JOIN p USING (doc_id)
UNION ALL SELECT path, upper(entry), CASE WHEN code = 'entry_path_unsafe' THEN code ELSE 'entry_path_collision' END, NULL, NULL, NULL FROM e WHERE doc_id % 5 = 0""")
def s22(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    comic = F.floor(F.col("doc_id") / PER) % 3 == 0
    files = _containers(docs.filter(comic), "box_%06d.cbz", _mixed).unionByName(_containers(docs.filter(~comic), "box_%06d.zip", _mixed))
    return archives.extracted(files).select("path", "entry", "rejected", "output", "size", "sha256")


def _book(rows: list[tuple]) -> list[tuple[str, str]]:
    book = rows[0][0] // PER
    pages = [(f"text/c{i}.xhtml", f"<html><head><title>T{i}</title></head><body><p>{html.escape(text)}</p></body></html>") for i, text in rows]
    items = "".join(f'<item id="c{i}" href="../text/c{i}.xhtml" media-type="application/xhtml+xml"/>' for i, _ in rows)
    spine = "".join(f'<itemref idref="c{i}"' + (' linear="no"/>' if i % 4 == 3 else "/>") for i, _ in rows[::-1])
    package = [] if book % 5 == 0 else [("META-INF/container.xml", '<c><rootfile full-path="opf/p.opf"/></c>'), ("opf/p.opf", f"<package><manifest>{items}</manifest><spine>{spine if book % 5 != 1 else ''}</spine></package>")]
    locks = [("META-INF/encryption.xml", "")] if book % 9 == 8 else []
    return [("mimetype", "application/epub+zip"), *package, *locks, *pages]


_BOOKS = f"""d AS (SELECT doc_id, {_FLAT_SQL} AS text, doc_id // {PER} AS b FROM documents),
c AS (SELECT *, CASE WHEN b % 5 = 0 THEN 'path' WHEN b % 5 = 1 OR NOT bool_or(doc_id % 4 <> 3) OVER (PARTITION BY b) THEN 'manifest' ELSE 'spine' END AS "order" FROM d WHERE b % 9 <> 8),
o AS (SELECT *, CASE WHEN text = '' THEN 'empty' ELSE 'materialized' END AS status, row_number() OVER (PARTITION BY b ORDER BY CASE "order" WHEN 'spine' THEN -doc_id WHEN 'manifest' THEN doc_id ELSE 0 END, 'text/c' || doc_id || '.xhtml') AS chapter FROM c WHERE "order" <> 'spine' OR doc_id % 4 <> 3)"""


def _books(spark, d) -> tuple[DataFrame, DataFrame]:
    docs = spark.read.parquet(f"{d}/documents.parquet").withColumn("text", F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), _ODD, " ")))
    return archives.books(_containers(docs, "book_%06d.epub", _book))


@query("s26_book_chapters", f"""WITH {_BOOKS} SELECT printf('book_%06d.epub', b) AS path, chapter, 'text/c' || doc_id || '.xhtml' AS entry, 'T' || doc_id AS title, CASE WHEN text <> '' THEN sha256(text) END AS text, CASE WHEN text <> '' THEN printf('text/chapters/chapter_%04d.txt', chapter) END AS output, status, "order" FROM o""")
def s26(spark, d):
    return _books(spark, d)[0].withColumn("text", F.sha2("text", 256))


@query("s25_book_warnings", f"""WITH {_BOOKS}, n AS (SELECT DISTINCT b FROM d), r AS (SELECT b FROM o GROUP BY b HAVING count(*) FILTER (text <> '') > 0)
SELECT printf('book_%06d.epub', b) AS path, code, entry FROM (SELECT b, 'epub_drm_unsupported' AS code, NULL AS entry FROM n WHERE b % 9 = 8
UNION ALL SELECT b, 'epub_opf_missing_fallback', 'META-INF/container.xml' FROM n WHERE b % 5 = 0 AND b % 9 <> 8 UNION ALL SELECT b, 'epub_document_order_fallback', NULL FROM n WHERE b % 5 = 0 AND b % 9 <> 8
UNION ALL SELECT DISTINCT b, 'epub_spine_missing_fallback', 'opf/p.opf' FROM c WHERE "order" = 'manifest' UNION ALL SELECT b, 'epub_chapter_empty', 'text/c' || doc_id || '.xhtml' FROM o WHERE text = ''
UNION ALL SELECT b, 'epub_no_readable_chapters', NULL FROM n WHERE b % 9 <> 8 AND b NOT IN (SELECT b FROM r))""")
def s25(spark, d):
    return _books(spark, d)[1]
