import hashlib
import io
import zipfile

import pyarrow as pa

from tessera.plans import archive_queries
from tessera.sources import archives, texts


def packed(entries, compression=zipfile.ZIP_DEFLATED):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", compression) as z:
        for name, content in entries:
            z.writestr(zipfile.ZipInfo(name) if isinstance(name, str) else name, content, compression)
    return out.getvalue()


def frame(spark, files):
    return spark.createDataFrame([(p, bytearray(c) if c is not None else None) for p, c in files], "path string, content binary")


def special(name):
    info = zipfile.ZipInfo(name)
    info.external_attr = 0o120777 << 16
    return info


def test_what_is_taken_of_containers(spark):
    mixed = packed([("a.txt", "one"), ("A.TXT", "two"), ("dir/", ""), ("dir/b.png", b"x"), ("../c.txt", ""), ("d.zip", ""), ("e.mp4", ""), ("f.exe", ""), ("g.txt/h.txt", "in"), ("g.txt", "out"), ("cafe\u0301.md", "1"), ("caf\u00e9.md", "2"), (special("link.txt"), "a.txt"), ("bomb.txt", b"0" * 300_000), ("x/con.txt", "")])
    got = {r.pos: (r.entry, r.output, r.rejected, bytes(r.content).decode() if r.content is not None else None) for r in archives.extracted(frame(spark, [("m.zip", mixed)])).collect()}
    assert got == {
        0: ("a.txt", "text/a.txt", None, "one"), 1: ("A.TXT", None, "entry_path_collision", None), 3: ("dir/b.png", "images/dir/b.png", None, "x"), 4: ("../c.txt", None, "entry_path_unsafe", None), 5: ("d.zip", None, "nested_container_not_supported", None),
        6: ("e.mp4", None, "container_video_requires_explicit_import", None), 7: ("f.exe", None, "entry_suffix_unsupported", None), 8: ("g.txt/h.txt", "text/g.txt/h.txt", None, "in"), 9: ("g.txt", None, "entry_path_collision", None), 10: ("cafe\u0301.md", "text/cafe\u0301.md", None, "1"),
        11: ("caf\u00e9.md", None, "entry_path_collision", None), 12: ("link.txt", None, "entry_type_unsupported", None), 13: ("bomb.txt", None, "compression_ratio_limit_exceeded", None), 14: ("x/con.txt", None, "entry_path_unsafe", None),
    }


def test_pages_of_comics_are_numbered_naturally(spark):
    comic = packed([("p10.png", "c"), ("p2.JPG", "b"), ("notes.txt", ""), ("p1.png", "a")])
    rows = archives.extracted(frame(spark, [("c.cbz", comic), ("broken.cbz", comic[:60]), ("none.zip", None)])).collect()
    assert sorted((r.page_number, r.output, r.content.decode(), r.content_form_hint, r.sha256) for r in rows if r.output) == [(i, f"images/pages/page_{i:04d}{s}", c, "manga", hashlib.sha256(c.encode()).hexdigest()) for i, s, c in ((1, ".png", "a"), (2, ".jpg", "b"), (3, ".png", "c"))]
    assert sorted((r.path, r.rejected) for r in rows if r.rejected) == [("broken.cbz", "container_invalid"), ("c.cbz", "cbz_entry_not_image"), ("none.zip", "container_invalid")]


def test_limits_and_damage(spark):
    good = packed([(f"{i}.txt", "word " * 20) for i in range(5)], zipfile.ZIP_STORED)
    damaged = bytearray(good)
    damaged[40] ^= 255
    rows = archives.extracted(frame(spark, [("a.zip", good), ("b.zip", bytes(damaged))]), most_entry=100).collect()
    assert [(r.path, r.entry) for r in rows if r.rejected] == [("b.zip", "0.txt")] and sum(r.size or 0 for r in rows) == 900
    assert {r.rejected for r in archives.extracted(frame(spark, [("a.zip", good)]), most_entries=4).collect()} == {"entry_count_limit_exceeded"}
    assert {r.rejected for r in archives.extracted(frame(spark, [("a.zip", good)]), most_bytes=499).collect()} == {"expanded_size_limit_exceeded"}


OPF = """<package xmlns="http://www.idpf.org/2007/opf"><manifest><item id="a" href="t/one.xhtml" media-type="application/xhtml+xml"/><item id="b" href="two%%20x.html" media-type="text/html"/>
<item id="c" href="../out/three.htm" media-type="x"/><item id="css" href="s.css" media-type="text/css"/><item id="bad" href="../../../x"/><item id="gone" href="gone.xhtml" media-type="text/html"/><item id="n" href="note.xhtml" media-type="text/html"/></manifest>%s</package>"""
SPINE = '<spine><itemref idref="c"/><itemref idref="a" linear="YES"/><itemref idref="css"/><itemref idref="c"/><itemref idref="gone"/><itemref idref="n" linear="no"/><itemref idref="b"/><itemref idref="zzz"/></spine>'
ROOT = '<container><rootfiles><rootfile full-path="OEBPS/p.opf"/></rootfiles></container>'
PAGES = [("OEBPS/t/one.xhtml", "<html><head><title>One</title></head><body><p>first</p></body></html>"), ("OEBPS/two x.html", "<p>second &nbsp; two<br>line"), ("out/three.htm", "<html><body><p>third</p></body></html>"), ("OEBPS/note.xhtml", "<p>note</p>"), ("OEBPS/s.css", "p {}")]


def book(opf, *more, root=ROOT, mimetype="application/epub+zip"):
    return packed([("mimetype", mimetype), ("META-INF/container.xml", root), ("OEBPS/p.opf", opf), *PAGES, *more])


def told(rows):
    return sorted((r.path, r.code, r.entry) for r in rows.collect())


def test_books_in_order_of_the_spine(spark):
    chapters, warnings = archives.books(frame(spark, [("s.epub", book(OPF % SPINE)), ("m.epub", book(OPF % "", mimetype="x"))]))
    rows = [(r.path, r.chapter, r.entry, r.title, r.text, r.output, r.status, r.order) for r in chapters.orderBy("path", "chapter").collect()]
    three, one, two, note = (("out/three.htm", "", "third"), ("OEBPS/t/one.xhtml", "One", "first"), ("OEBPS/two x.html", "", "second two\nline"), ("OEBPS/note.xhtml", "", "note"))
    want = lambda path, order, entries: [(path, n, *e, f"text/chapters/chapter_{n:04d}.txt", "materialized", order) for n, e in enumerate(entries, 1)]
    assert rows == want("m.epub", "manifest", [one, two, three, note]) + want("s.epub", "spine", [three, one, two])
    bad = [("epub_manifest_item_invalid", "../../../x"), ("epub_spine_entry_missing", "OEBPS/gone.xhtml"), ("epub_xhtml_malformed_fallback", "OEBPS/two x.html")]
    assert told(warnings) == sorted([("m.epub", *b) for b in [*bad, ("epub_mimetype_invalid", "mimetype"), ("epub_spine_missing_fallback", "OEBPS/p.opf")]] + [("s.epub", *b) for b in bad])


def test_books_without_a_package_and_with_locks(spark):
    locked = bytearray(book(OPF % SPINE))
    for mark, at in ((b"PK\x01\x02", 8), (b"PK\x03\x04", 6)):
        locked[locked.index(mark) + at] |= 1
    files = [("drm.epub", book(OPF % SPINE, ("META-INF/Encryption.xml", ""))), ("locked.epub", bytes(locked)), ("n.epub", packed([("b/Z.html", "<p>z"), ("a.xhtml", "<!DOCTYPE x><p>a</p>"), ("c.htm", "<p> </p>")])), ("bad.epub", b"no"), ("root.epub", book(OPF, root="<a")), ("opf.epub", book("<!ENTITY x>"))]
    chapters, warnings = archives.books(frame(spark, files))
    rows = sorted((r.path, r.chapter, r.entry, r.text, r.status) for r in chapters.collect() if r.path == "n.epub")
    assert rows == [("n.epub", 1, "a.xhtml", None, "unsafe_declaration"), ("n.epub", 2, "b/Z.html", "z", "materialized"), ("n.epub", 3, "c.htm", None, "empty")]
    codes = {p: sorted(c for q, c, _ in told(warnings) if q == p) for p, _ in files}
    assert codes["drm.epub"] == ["epub_drm_unsupported"] and codes["locked.epub"] == ["entry_encrypted", "epub_encryption_unsupported"] and codes["bad.epub"] == ["epub_container_invalid"]
    assert codes["n.epub"] == sorted(["epub_mimetype_missing", "epub_opf_missing_fallback", "epub_document_order_fallback", "epub_xhtml_unsafe_declaration", "epub_chapter_empty", "epub_xhtml_malformed_fallback", "epub_xhtml_malformed_fallback"][:-1])
    assert "epub_container_metadata_invalid" in codes["root.epub"] and "epub_opf_invalid_fallback" in codes["opf.epub"]
    assert [r.entry for r in chapters.filter("path = 'opf.epub'").orderBy("chapter").collect()] == ["OEBPS/note.xhtml", "OEBPS/t/one.xhtml", "OEBPS/two x.html", "out/three.htm"]


def test_a_chapter_beyond_the_cap_takes_nothing(spark):
    pages = packed([(f"{i}.html", f"<p>{'x' * n}</p>") for i, n in enumerate([9, 30, 9, 4])])
    chapters, warnings = archives.books(frame(spark, [("b.epub", pages)]), most_text=25)
    assert [r.status for r in chapters.orderBy("chapter").collect()] == ["materialized", "size_limit_exceeded", "materialized", "materialized"]
    assert ("b.epub", "expanded_size_limit_exceeded", "1.html") in told(warnings)


def test_references_stay_inside(spark):
    assert archives.resolved("OEBPS", "../a/./b%20c.html#x") == "a/b c.html"
    assert [archives.resolved("a", h) for h in ("../../x", "/x", "http://h/x", "", "#a", "..")] == [None] * 6


def test_collisions_follow_what_passes(spark):
    names = ["a/b", "a", "a/c", "B", "b/x", "b"]
    rows = spark.createDataFrame([("z", i, n, 1, 1, False, False, False) for i, n in enumerate(names)], "path string, pos int, entry string, size long, packed long, encrypted boolean, special boolean, directory boolean")
    got = [r.rejected for r in texts.checked_entries(rows).orderBy("pos").collect()]
    assert got == [None, "entry_path_collision", None, None, "entry_path_collision", "entry_path_collision"]
    assert archives.checked(frame(spark, [])).count() == 0


def test_containers_are_packed_once_and_parsed_where_they_are_read(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(20)], "doc_id long, text string")
    files = archive_queries._containers(docs, "b%06d.epub", archive_queries._book)
    assert "FlatMapGroups" not in files._jdf.queryExecution().executedPlan().toString()
    raw = files.filter("path = 'b000000.epub'").first().content
    names = zipfile.ZipFile(io.BytesIO(raw)).namelist()
    at = [names.index("text/c0.xhtml"), names.index("text/c3.xhtml")]
    batch = pa.RecordBatch.from_pylist([{"path": "b", "content": bytes(raw), "wanted": at}])
    assert [(r["pos"], r["text"], r["title"], r["state"]) for b in archives._chapters(iter([batch])) for r in b.to_pylist()] == [(at[0], "text 0", "T0", ""), (at[1], "text 3", "T3", "")]
