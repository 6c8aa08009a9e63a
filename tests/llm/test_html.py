import html as entities
import re

from pyspark.sql import functions as F

from tessera.llm import html

SF = "/root/testdata/sf0.01"


def template(page):
    """The article of the generated pages: blocks are h1 and p."""
    body = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    blocks = re.split(r"</?(?:h1|p)>", body)
    return "\n".join(t for t in (" ".join(entities.unescape(re.sub(r"<[^>]*>", " " if "br" in b else "", b)).split()) for b in blocks) if t)


def test_generated_pages(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = html.op9_html(spark, SF).collect()
    assert len(rows) == len(pages)
    assert all(r.text == template(pages[r.page_id]) and r.n_chars == len(r.text) for r in rows)


PAGE = """<!doctype html><html><head><title>T</title><style>a{}</style></head><body class="home">
<header><h2>Site name</h2></header><nav><a href=/>Home</a> <a>News</a></nav>
<div class="cookie-notice">We use cookies on this site for many reasons, and you agree to that.</div>
<div id="wrap"><div class="post"><h1>Head&shy;line &amp; more</h1><p>First paragraph with <b>bold</b> text, long enough to count as content.
<p>Short.<ul><li>One item<li>Two item</ul><table><tr><td>cell a<td>cell b</table>
<p>Last paragraph, again long enough to be content for any ratio of text to tags.<script>if (a<b) { x("</p>") }</script></div>
<aside>Aside text that should not be there at all, however long it may be.</aside>
<section id="comments"><p>A reader comment that is long enough to look like content, by itself.</p></section></div>
<form><label>Mail</label><input></form><div style="display:none">hidden words</div><footer>&copy; 2020</footer></body></html>"""


def test_structure():
    assert html.main_text(PAGE).split("\n") == ["Head\xadline & more", "First paragraph with bold text, long enough to count as content.", "Short.", "One item", "Two item", "cell a", "cell b", "Last paragraph, again long enough to be content for any ratio of text to tags."]


def test_edge_rows(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "v", "plain text only"), (3, "w", "<p>a<p>b"), (3, "w", "<p>a<p>b"), (4, "x", "<div><nav>menu</nav></div>"), (5, "y", "<article><p>" + "long &lt;text&gt; " * 20_000), (6, "z", "<![if x]><!-- open <p>q</p>"), (7, "q", "<p>one&#0;two</p></div></p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1)).withColumn("n_chars", F.lit("clash"))
    got = html.extract(pages).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    by = {(r.page_id, r.url): r.text for r in got}
    assert by[1, "u"] == by[2, None] == by[4, "x"] == "" and by[None, "v"] == "plain text only" and by[3, "w"] == "a\nb"
    assert by[5, "y"] == " ".join(["long <text>"] * 20_000)
    assert html.extract(pages.limit(0)).count() == 0


def test_title_and_lead_stay_beside_a_long_part():
    parts = {
        "div": '<div class="text">' + "".join(f"<p>Paragraph {i}, long enough to be content of this page by any ratio.</p>" for i in range(30)) + "</div>",
        "ul": "<ul>" + "".join(f"<li>Entry {i}, long enough to be content of this page by any ratio.</li>" for i in range(30)) + "</ul>",
        "section": "<section>" + "".join(f"<p>Paragraph {i}, long enough to be content of this page by any ratio.</p>" for i in range(30)) + "</section>",
    }
    for part in parts.values():
        long = [t for t in re.split(r"<[^>]*>", part) if t]
        for outer in ("article", "main", "div"):
            page = f"<html><body><div><a href=/>Home</a> <a href=/n>News and more</a></div><nav>menu</nav><{outer}><h1>Title</h1><p>The lead.</p>{part}<p>The end.</p></{outer}><footer>foot</footer></body></html>"
            assert html.main_text(page).split("\n") == ["Title", "The lead.", *long, "The end."]


LONG = "This sentence of the article is long enough to stand for a paragraph of any page of text."


def opaque(body):
    return f"""<html><body><div class=x1><div class=x2><span>Home</span></div><div class=x2><span>Sport</span></div><div class=x2><span>Money</span></div></div>
<div class=x3><div class=x4>{body}</div></div>
<div class=x7><div class=x8>All rights kept</div><div class=x8>Imprint</div><div class=x8>About us</div></div></body></html>"""


def test_classes_that_say_nothing():
    """Only the clusters tell menus and the closing lines from the article here, and keep what lies inside it."""
    body = f"<h1>Title</h1><p>Lead.</p><div class=q>" + "".join(f"<p>{i} {LONG}</p>" for i in range(6)) + "<p>Short.</p></div><p>The end.</p>"
    assert html.main_text(opaque(body)).split("\n") == ["Title", "Lead.", *[f"{i} {LONG}" for i in range(6)], "Short.", "The end."]
    shared = "<ul class=z>" + "".join(f"<li><a href=/{i}>Send by {i}</a></li>" for i in range(4)) + "</ul>"
    body = f"<h1>Title</h1><div class=q><p>0 {LONG}</p>{shared}" + "".join(f"<p>{i} {LONG}</p>" for i in range(1, 6)) + '<p><a href="/x">Read all of it</a></p></div>'
    lines = html.main_text(opaque(body)).split("\n")
    assert lines[0] == "Title" and [t for t in lines if LONG in t] == [f"{i} {LONG}" for i in range(6)] and "Read all of it" in lines
    assert not {"Home", "Imprint", "All rights kept"} & set(lines)


def test_without_clusters_the_rest_of_the_page_stays(monkeypatch):
    body = "".join(f"<p>{i} {LONG}</p>" for i in range(6))
    assert "Imprint" not in html.main_text(opaque(body))
    monkeypatch.setattr(html, "threshold", lambda level: -1.0)
    assert "Imprint" in html.main_text(opaque(body))


def test_deep_nesting_takes_time_in_proportion():
    import time

    def took(n):
        begun = time.process_time()
        assert html.main_text("<div>" * n + f"<p>{LONG}</p>" + "<b>x<div>y" * n).startswith(LONG)
        return time.process_time() - begun

    took(100)
    assert took(40_000) < 8 * took(10_000) + 0.5
    assert html.main_text("<div>" * 200_000 + f"<p>{LONG}</p>" + "</x>" * 200_000) == LONG


def paragraphs(n=6):
    return "".join(f"<p>{i} {LONG}</p>" for i in range(n))


SAID = [f"{i} {LONG}" for i in range(6)]


def test_page_goes_on_after_a_bad_declaration():
    assert html.main_text(f"<body><div><h1>Title</h1><![x y><p>0 {LONG}</p><!y [z]><p>1 {LONG}</p></div></body>").split("\n") == ["Title", *SAID[:2]]


def test_a_form_around_the_page_is_no_form():
    page = f"<body><form action=x><nav>menu</nav><div><h1>Title</h1>{paragraphs()}</div><div class=social-links>Share it</div></form><footer>foot</footer></body>"
    assert html.main_text(page).split("\n") == ["Title", *SAID]
    small = f"<body><div><h1>Title</h1>{paragraphs()}</div><form><p>Your mail address, which we need for a reply to you.</p><input></form></body>"
    assert html.main_text(small).split("\n") == ["Title", *SAID]


def test_doubtful_names_are_judged_by_what_they_hold():
    for name in ("social-studies", "cookie-recipes", "notice-board", "shared"):
        assert html.main_text(f"<body><div>Home</div><article><div class={name}><h1>Title</h1>{paragraphs()}</div></article></body>").split("\n") == ["Title", *SAID]
        beside = f"<body><article><h1>Title</h1><p>Short one.</p></article><div class={name}>{paragraphs()}</div></body>"
        assert html.main_text(beside).split("\n") == ["Title", "Short one."]
        assert html.main_text(f"<body><div><h1>Title</h1>{paragraphs()}<div class={name}><p>{LONG}</p></div></div></body>").split("\n") == ["Title", *SAID]
    assert html.main_text(f"<body><div class=comments>{paragraphs()}</div></body>") == ""
    deep = "<div class=social>" * 40 + f"<p>{LONG}</p>" * 9
    assert html.main_text(deep) == ""


def test_a_title_beside_the_article_stays():
    for head in ("<h1>Title</h1>", "<header><h1>Title</h1></header>"):
        page = f"<body><header><h1>Site</h1></header><main>{head}<article>{paragraphs()}</article><section class=comments><p>{LONG}</p></section></main></body>"
        assert html.main_text(page).split("\n") == ["Title", *SAID]
    own = f"<body><main><h1>List</h1><article><h1>Title</h1>{paragraphs()}</article></main></body>"
    assert html.main_text(own).split("\n")[0] == "Title"
